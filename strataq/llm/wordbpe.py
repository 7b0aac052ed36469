"""Word-level byte-pair encoding, as a vocabulary file of the tokenizers library describes it.

A word is written over 512 symbols: chr(b) for a byte b inside it, chr(256 + b) for its last byte. In this writing a token
is a plain string, a token that closes a word can only match at a word's end, and words can be laid end to end without
separators.

Encoding is speculative. Greedy longest match proposes tokens for many words in one pass; a vectorised check then tests
every adjacent pair; words with a pair that exact merging would not leave standing are merged exactly, all at once.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from itertools import chain

import ahocorasick
import numpy as np
import regex

#: The pieces that the vocabulary's pre-tokenizer cuts a text into, and its white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
#: From here on, versions of Unicode differ in what is a letter; the library itself cuts chunks that hold such characters.
NEWER = regex.compile(r"[\u0530-\U0010ffff]")
SPACES = regex.compile(r"\s+")
#: str.split() also splits at these four; the vocabulary's white space does not hold them.
ODD_SPACES = regex.compile(r"[\x1c-\x1f]")
NONE = np.int64(1) << 60
LONG_WORD = 200


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """The vocabulary at `path`, and exact encoding of words with it."""

    END = "</w>"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.library = path, None
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        self.byte_of = symbols
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.names = [""] * self.size
        self.strings = [""] * self.size
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.base = np.full(512, -1, np.int64)
        for name, i in vocab.items():
            closed = name.endswith(self.END)
            b = [symbols[c] for c in (name[: -len(self.END)] if closed else name)]
            if closed:
                b[-1] += 256
            self.strings[i] = "".join(map(chr, b))
            if len(b) == 1:
                self.base[b[0]] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if not (np.diff(made) > 0).all() or (made <= np.maximum(left, right)).any():
            raise ValueError("ids must follow the order of the merges")
        self.first = int(made[0])  # smaller ids are single symbols
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.left[made], self.right[made] = left, right
        order = np.argsort(left << 20 | right)
        self.keys, self.merged = (left << 20 | right)[order], made[order]
        self.rank = dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True))
        self.lengths = np.array([len(s) for s in self.strings], np.int64)
        # only tokens that exact merging makes of their own symbols may be proposed
        some = [i for i, s in enumerate(self.strings) if s]
        ids, counts = self.merge_exactly(*pack([self.strings[i] for i in some]))
        starts = np.cumsum(counts) - counts
        self.greedy = ahocorasick.Automaton()
        for i, n, at in zip(some, counts.tolist(), starts.tolist(), strict=True):
            if n == 1 and ids[at] == i:
                self.greedy.add_word(self.strings[i], i)
        self.greedy.make_automaton()
        # the proposed tokens that close a word, as if they stood inside one
        self.closers = ahocorasick.Automaton()
        for i in self.greedy.values():
            if ord(self.strings[i][-1]) >= 256:
                self.closers.add_word(self.strings[i][:-1] + chr(ord(self.strings[i][-1]) - 256), i)
        self.closers.make_automaton()

    # -- text to words -------------------------------------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space and around special strings; chunks encode independently of each other."""
        if "<|" in text:
            for s in self.special:
                text = text.replace(s, f" {s} ")
        return SPACES.split(text) if ODD_SPACES.search(text) else text.split()

    def words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of chunks: their symbols end to end, their sizes, and for each word the number of its chunk."""
        text = "\n".join(chunks)
        odd = NEWER.search(text) is not None
        if odd:
            apart = {i: c for i, c in enumerate(chunks) if NEWER.search(c)}
            text = "\n".join("" if i in apart else c for i, c in enumerate(chunks))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        pieces = [p.encode() for p in PIECES.findall(text.lower())]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        # a line feed stands alone between chunks, as no chunk holds one
        breaks = (sizes == 1) & (raw[np.cumsum(sizes) - sizes] == 10) if len(pieces) else np.zeros(0, bool)
        owner = np.cumsum(breaks)[~breaks]
        sizes, raw = sizes[~breaks], raw[raw != 10]
        if odd:
            more = [(i, p) for i, c in apart.items() for p in self.library_pieces(c)]
            raw = np.concatenate([raw, np.frombuffer(b"".join(p for _, p in more), np.uint8)])
            sizes = np.concatenate([sizes, np.array([len(p) for _, p in more], np.int64)])
            owner = np.concatenate([owner, np.array([i for i, _ in more], np.int64)])
            order = np.argsort(owner, kind="stable")
            raw = raw[spans((np.cumsum(sizes) - sizes)[order], sizes[order])]
            sizes, owner = sizes[order], owner[order]
        symbols = raw.astype(np.uint16)
        symbols[np.cumsum(sizes) - 1] += 256
        return symbols, sizes, owner

    def library_pieces(self, chunk: str) -> list[bytes]:
        from tokenizers import Tokenizer

        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(self.byte_of[c] for c in piece) for piece, _ in cut]

    # -- words to tokens -----------------------------------------------------------------------------------------

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that merging a and b makes, NONE if there is none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def merge_exactly(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words and their count for each word: in each round, each unfinished word's first merge is done."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        ids = self.base[symbols]
        done_ids, done_word = [], []
        if (sizes > LONG_WORD).any():
            at = np.cumsum(sizes) - sizes
            for i in np.flatnonzero(sizes > LONG_WORD):
                done_ids.append(np.array(self.merge_long(ids[at[i] : at[i] + sizes[i]].tolist()), np.int64))
                done_word.append(np.full(len(done_ids[-1]), i))
            short = (sizes <= LONG_WORD)[word]
            ids, word = ids[short], word[short]
        while len(ids):
            n = len(ids)
            rank = np.full(n, NONE)
            same = word[1:] == word[:-1]
            rank[:-1][same] = self.lookup(ids[:-1][same], ids[1:][same])
            starts = np.flatnonzero(np.r_[True, ~same])
            best = np.minimum.reduceat(np.where(rank == NONE, NONE, rank * n + np.arange(n)), starts)
            going = best != NONE
            at = best[going] % n
            ids[at] = best[going] // n
            stays = np.ones(n, bool)
            stays[at + 1] = False
            live = np.repeat(going, np.diff(np.r_[starts, n]))
            done_ids.append(ids[~live])
            done_word.append(word[~live])
            ids, word = ids[live & stays], word[live & stays]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))

    def merge_long(self, ids: list[int]) -> list[int]:
        """Exact merging of the symbols of one long word with a heap, in n log n."""
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(m, i) for i in range(n - 1) if (m := self.rank.get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or self.rank.get(ids[i] << 20 | ids[j]) != m:
                continue
            ids[i], alive[j], after[i] = m, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if x := self.rank.get(m << 20 | ids[after[j]]):
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := self.rank.get(ids[before[i]] << 20 | m)):
                heapq.heappush(heap, (x, before[i]))
        return [t for t, live in zip(ids, alive, strict=True) if live]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether exact merging, given the symbols of a and then b, ends at just these two tokens.

        Merges are done in the order of their ids. Going back in time, the right edge of a and the left edge of b are
        taken apart, the younger first; at each moment the two edges must have no merge that came before either of them
        was itself merged away (of equal merges, the left one comes first).
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        until = np.full(len(a), NONE)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            bad = self.lookup(x, y) < until[live]
            good[live[bad]] = False
            go = ~bad & ((x >= self.first) | (y >= self.first))
            live, x, y = live[go], x[go], y[go]
            undo_x = x > y
            # x is gone from its own merge on; y still has its turn at the very merge that takes it
            until[live] = np.where(undo_x, x, y + 1)
            a[live], b[live] = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def encode_words(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of all words, their count for each word, and how many words had to be merged exactly."""
        if not len(sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        found = self.greedy.iter_long(symbols.tobytes().decode("utf-16-le"))
        ends, got = np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2).T
        word = np.repeat(np.arange(len(sizes)), sizes)[ends]
        failed = np.bincount(word, self.lengths[got], len(sizes)) != sizes  # symbols without a token
        inside = np.flatnonzero(word[1:] == word[:-1])
        pair, where = np.unique(got[inside] << 20 | got[inside + 1], return_inverse=True)
        ok = self.compatible(pair >> 20, pair & ((1 << 20) - 1))
        failed[word[inside[~ok[where]]]] = True
        counts = np.bincount(word, minlength=len(sizes))
        if failed.any():
            again, more = self.merge_exactly(symbols[np.repeat(failed, sizes)], sizes[failed])
            kept = got[~failed[word]]
            counts[failed] = more
            exact = np.repeat(failed, counts)
            got = np.empty(len(exact), np.int64)
            got[exact], got[~exact] = again, kept
        return got, counts, int(failed.sum())

    def count_prefixes(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Dynamic programming over prefixes: at each symbol of each word, the exact number of tokens up to and with it.

        The last token of a prefix is the one token ending there that fits the last token of the prefix before it; so one
        token of the prefix's encoding is known at each symbol, and its count is one more than that of the prefix before.
        All words advance together, symbol by symbol. Inside a word a prefix is counted as unfinished (its last symbol
        doesn't close a word); finished_prefixes() has the other counts.
        """
        return self.prefixes(symbols, sizes)[0]

    def prefixes(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of count_prefixes() and the last token of each prefix."""
        n = len(symbols)
        count = np.zeros(n, np.int64)
        if not n:
            return count, count
        found = self.greedy.iter(symbols.tobytes().decode("utf-16-le"))
        ends, token = np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2).T
        starts = ends - self.lengths[token] + 1
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = starts >= first[ends]
        ends, token, starts = ends[inside], token[inside], starts[inside]
        depth = np.arange(n) - first  # of each symbol in its word
        last = np.full(n, -1, np.int64)
        head = starts == first[ends]
        last[ends[head]], count[ends[head]] = token[head], 1
        rest = np.flatnonzero(~head)
        rest = rest[np.argsort(depth[ends[rest]], kind="stable")]
        steps = np.flatnonzero(np.diff(depth[ends[rest]], prepend=-1)).tolist()
        for lo, hi in zip(steps, [*steps[1:], len(rest)] if steps else [], strict=True):
            at = rest[lo:hi]
            before = last[starts[at] - 1]
            pair, where = np.unique(before << 20 | token[at], return_inverse=True)
            at = at[self.compatible(pair >> 20, pair & ((1 << 20) - 1))[where]]
            last[ends[at]], count[ends[at]] = token[at], count[starts[at] - 1] + 1
        return count, last

    def finished_prefixes(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """At each symbol of each word, the exact number of tokens of the word's prefix up to and with it, taken as a whole word:
        its last token is the closing one that ends there and fits the last token of the unfinished prefix before it."""
        n = len(symbols)
        out = np.zeros(n, np.int64)
        if not n:
            return out
        symbols = symbols % 256
        count, last = self.prefixes(symbols, sizes)
        found = self.closers.iter(symbols.astype(np.uint16).tobytes().decode("utf-16-le"))
        ends, token = np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2).T
        starts, first = ends - self.lengths[token] + 1, np.repeat(np.cumsum(sizes) - sizes, sizes)
        head = starts == first[ends]
        rest = np.flatnonzero(starts > first[ends])
        pair, where = np.unique(last[starts[rest] - 1] << 20 | token[rest], return_inverse=True)
        rest = rest[self.compatible(pair >> 20, pair & ((1 << 20) - 1))[where]]
        out[ends[rest]] = count[starts[rest] - 1] + 1
        out[ends[head]] = 1
        return out


def pack(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words over the 512 symbols, as encode_words() takes them."""
    return np.frombuffer("".join(words).encode("utf-16-le"), np.uint16), np.array([len(w) for w in words], np.int64)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each span, one span after the other."""
    if not lengths.sum():
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - first, lengths)


class Chunks(dict):
    """Chunk -> number, given at first sight; fresh holds the numbers' chunks that aren't encoded yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n


class ChunkEncoder:
    """Encodes texts chunk by chunk and remembers chunks, at most about `limit` of them and `room` bytes of chunks and tokens;
    then it starts anew."""

    def __init__(self, bpe: WordBpe, limit: int = 1_000_000, room: int = 128 << 20):
        self.bpe, self.limit, self.room = bpe, limit, room
        self.reset()

    def reset(self) -> None:
        self.known = Chunks()
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)
        self.used = self.chars = 0
        self.texts: list[str] = []  # chunk by number, for callers that keep more for each chunk

    def look(self, text: str) -> np.ndarray:
        """The numbers of the text's chunks; encode_fresh() must follow before they are used."""
        c = self.bpe.chunks(text)
        return np.fromiter(map(self.known.__getitem__, c), np.int32, len(c))

    def full(self) -> bool:
        return len(self.known) > self.limit or self.chars + 4 * self.used > self.room

    def encode_fresh(self) -> range:
        """Encodes what look() has met; the numbers of those chunks."""
        fresh, self.known.fresh = self.known.fresh, []
        first = len(self.known) - len(fresh)
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            counts, ids = self.encode_chunks(part)
            k, n = first + at, len(ids)
            while len(self.count) < k + len(part):
                self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
            while len(self.ids) < self.used + n:
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + n] = ids
            self.count[k : k + len(part)] = counts
            self.start[k : k + len(part)] = self.used + np.cumsum(counts) - counts
            self.used += n
        self.texts += fresh
        self.chars += sum(map(len, fresh))
        return range(first, first + len(fresh))

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts by chunk, and all tokens."""
        special = [(i, self.bpe.special[c]) for i, c in enumerate(chunks) if c in self.bpe.special]
        for i, _ in special:
            chunks = [*chunks[:i], "", *chunks[i + 1 :]]
        symbols, sizes, owner = self.bpe.words(chunks)
        ids, by_word, _ = self.bpe.encode_words(symbols, sizes)
        counts = np.bincount(owner, by_word, len(chunks)).astype(np.int64)
        for i, t in special:  # its token goes in where its chunk begins
            ids = np.insert(ids, counts[:i].sum(), t)
            counts[i] = 1
        return counts, ids

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        """The tokens of chunks, one after the other."""
        return self.ids[spans(self.start[numbers], self.count[numbers].astype(np.int64))]


_loaded: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This process's encoder for a vocabulary file; Python workers are used again, and so is what they know."""
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(WordBpe(path))
    return _loaded[path]
