"""Readers and writers of plotfiles and of chunk archives."""
