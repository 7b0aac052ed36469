"""BPE encoding and decoding of document texts: speculate with greedy longest match, verify pairs, merge the rest exactly."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbpe import encoder

#: Documents whose chunks are looked up before the new ones among them are encoded together.
STEP = 400


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, token ids (null text: none). Rows are independent: repeated, null and tied ids stay as they are."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for part, numbers in looked_up(enc, batch):
                ids = [enc.tokens(x) for x in numbers]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, decoded text: the tokens' names with one space between (null ids: empty)."""

    def run(batches):
        names = encoder(path).bpe.names
        for batch in batches:
            texts = [" ".join([names[i] for i in ids]) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").select(F.col("id").alias(id_col), F.col("text").alias("decoded"))


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text; id, n_tokens, and SHA-256 of the decimal ids and of the decoded text."""

    def run(batches):
        enc = encoder(path)
        names, decimals = enc.bpe.names, [str(i) for i in range(enc.bpe.size)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for part, numbers in looked_up(enc, batch):
                n, of_ids, of_text = [], [], []
                for x in numbers:
                    ids = enc.tokens(x).tolist()
                    n.append(len(ids))
                    of_ids.append(sha(" ".join(map(decimals.__getitem__, ids))))
                    of_text.append(sha(" ".join(map(names.__getitem__, ids))))
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def looked_up(enc, batch: pa.RecordBatch, text_at: int = 1):
    """Slices of the batch with their texts' chunk numbers, all encoded. A number is valid until the next slice is asked for."""
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, STEP)
        if part.column(text_at).nbytes > 16 << 20:
            part = batch.slice(at, 20)
        numbers = [enc.look(t) for t in part.column(text_at).to_pylist()]
        enc.encode_fresh()
        yield part, numbers
        if enc.full():
            enc.reset()
        at += part.num_rows
