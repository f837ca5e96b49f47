"""Packing token sequences into windows by non-negative least squares.

A document's ids fill whole windows first; what is left of each is one piece shorter than a window. The histogram of
those lengths (one count for each length under the window: a fixed size) is all that the driver gets. There every
combination of two or three lengths that fills a window exactly is enumerated, their repeat counts are solved for by
non-negative least squares against the histogram (multiplicative updates), rounded, and held to what the histogram has.
The n-th piece of a length then finds its window by arithmetic alone, because pieces are numbered within their length in
a distributed way. Residual pieces are packed greedily, longest first, end to end, and cut where a window is full; the last
window is cut into powers of two, which need no padding. So every id lies in exactly one piece and nothing is padded.

Ids are the tokenizer's own without the special tokens it would add around a text; the string of an added token inside a
text is that token, as the tokenizer has it. Null and empty texts have the closing id only. Repeated rows are packed each.
An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_columns, numbered, table

WINDOW, END_ID = 2048, 1
ROUNDS = 60
#: Distinct chunks that a worker remembers the ids of.
REMEMBER = 700_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _class(kind: str) -> str:
    """The characters under PLAIN_END of a general category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == kind)


#: Texts of these characters only (no controls, no combining marks, nothing that gets a mark when lower-cased) are split
#: here; others as a whole by the tokenizer.
PLAIN_END = 0x250
NOT_PLAIN = re.compile("[^\t\n\r\\x20-\\x7e\u00a1-\u012f\u0131-\u024f]")
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^ \\t\\n\\r{_class('L')}{_class('N')}]+")
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Chunks(dict):
    """Ids (as little-endian 16-bit integers) of what the tokenizer encodes by itself: the matches of its splitting
    pattern. In a plain text they are found here, after A-Z is lower-cased as the tokenizer would; any other text is one
    chunk. New chunks are encoded together, one text of them all, and told apart by the tokens that end a word."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the tokenizer takes out of a text before it splits it, in either case.
        added = sorted(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)
        start = os.path.commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.mark = start if start.lower() == start.upper() else ""  # a text without it has none of them
        vocabulary = self.tokenizer.get_vocab()
        if len(vocabulary) > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2")

    def learn(self, pieces: list[str]) -> None:
        ids = self.encode(" ".join(pieces))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(pieces):
            data, at = ids.tobytes(), 0
            for piece, stop in zip(pieces, (stops * 2).tolist(), strict=True):
                self[piece] = data[at:stop]
                at = stop
        else:  # not a vocabulary whose words end in a marked token
            for piece in pieces:
                self[piece] = self.encode(piece).tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u2")
        if NOT_PLAIN.search(text) or (self.mark in text and self.added.search(text)):
            return self.encode(text)
        pieces = PIECES.findall(text.encode().translate(ASCII_LOWER).decode())
        parts = list(map(self.get, pieces))
        if None in parts:
            new = {p for p, ids in zip(pieces, parts, strict=True) if ids is None}
            if len(self) + len(new) > REMEMBER:
                self.clear()
                new = set(pieces)
            self.learn(list(new))
            parts = list(map(self.__getitem__, pieces))
        return np.frombuffer(b"".join(parts), "<u2")


@lru_cache(maxsize=2)
def chunks_of(path: str) -> Chunks:
    return Chunks(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, ids) of the whole windows and the rest of each text; ids (16-bit,
    little-endian) for the rests only, which may still be cut."""

    def pieces(keys, texts):
        memo, rows = chunks_of(path), []
        for k, t in zip(keys, texts, strict=True):
            ids = np.append(memo.ids(t), np.uint16(END_ID))
            for start in range(0, len(ids), WINDOW):
                own = ids[start : start + WINDOW]
                rows.append((k, start, len(own), crc(own), len(ids), own.tobytes() if len(own) < WINDOW else None))
        return [list(c) for c in zip(*rows, strict=True)]

    kind = dict(df.dtypes)[key]
    return map_columns(df.select(key, text), lambda: pieces, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def combinations(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Every pair and triple of the lengths (falling) that fills the window exactly, a 0 in place of a third."""
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    pairs = lengths[(lengths * 2 >= window) & (lengths < window)]
    pairs = pairs[has[window - pairs]]
    out = [np.c_[pairs, window - pairs, np.zeros_like(pairs)]]
    for a in lengths[lengths * 3 >= window]:
        b = lengths[(lengths <= a) & (lengths * 2 >= window - a) & (lengths < window - a)]
        b = b[has[window - a - b]]
        out.append(np.c_[np.full_like(b, a), b, window - a - b])
    return np.concatenate(out)


def solved(histogram: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and whole repeat counts, together within the histogram (counts by length)."""
    lengths = np.flatnonzero(histogram[:window])
    combos = combinations(lengths[lengths > 0], window)
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    slots = [combos[:, k] for k in range(3)]
    weight = np.where(np.arange(window + 1) > 0, 1.0, 0.0)
    h = histogram.astype(float) * weight
    back = lambda y: sum((y * weight)[s] for s in slots)
    forth = lambda x: sum(np.bincount(s, x, window + 1) for s in slots) * weight
    x, target = np.full(len(combos), h.sum() / (3.0 * len(combos))), back(h)
    for _ in range(ROUNDS):
        x *= target / np.maximum(back(forth(x)), 1e-12)
    times, left = np.zeros(len(combos), np.int64), histogram.copy()
    want = np.rint(x).astype(np.int64)
    for i in np.argsort(-x, kind="stable"):
        if want[i] < 1:
            break
        own, need = np.unique(combos[i][combos[i] > 0], return_counts=True)
        times[i] = n = max(0, min(want[i], int((left[own] // need).min())))
        left[own] -= n * need
    return combos[times > 0], times[times > 0]


class Plan:
    """Where the n-th piece of a length goes. Sequence ids: whole windows, then combinations, then the residual stream."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        combos, times = solved(histogram, window)
        base = int(histogram[window]) + np.concatenate([[0], np.cumsum(times)])
        used, segments = np.zeros(window + 1, np.int64), {}
        for combo, n, first in zip(combos.tolist(), times.tolist(), base.tolist(), strict=False):
            offset = 0
            for length in combo:
                if length:
                    segments.setdefault(length, []).append((int(used[length]), first, offset))
                    used[length] += n
                    offset += length
        self.window, self.used = window, used
        self.segments = {k: np.array(v, np.int64) for k, v in segments.items()}
        rest = histogram - used
        rest[window] = 0
        tokens = rest * np.arange(window + 1)
        self.before = np.cumsum(tokens[::-1])[::-1] - tokens  # tokens of longer residual pieces
        self.total, self.first = int(tokens.sum()), int(base[-1])
        tail, at = self.total % window, self.total - self.total % window
        self.cuts = []  # ends of the last sequences, powers of two
        for bit in range(window.bit_length() - 1, -1, -1):
            if tail >> bit & 1:
                at += 1 << bit
                self.cuts.append(at)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(from, length, sequence, offset) of the parts of a piece, one unless the residual stream cuts it."""
        if length == self.window:
            return [(0, length, rank, 0)]
        if rank < self.used[length]:
            own = self.segments[length]
            start, first, offset = own[np.searchsorted(own[:, 0], rank, side="right") - 1].tolist()
            return [(0, length, first + rank - start, offset)]
        at = begin = int(self.before[length]) + (rank - int(self.used[length])) * length
        end, out, whole = begin + length, [], self.total - self.total % self.window
        while at < end:
            if at < whole:
                sequence, low = divmod(at, self.window)
                stop, start = (sequence + 1) * self.window, at - low
            else:
                k = int(np.searchsorted(self.cuts, at, side="right"))
                sequence, stop, start = whole // self.window + k, self.cuts[k], self.cuts[k - 1] if k else whole
            stop = min(stop, end)
            out.append((at - begin, stop - at, self.first + sequence, at - start))
            at = stop
        return out


def packed_pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of every piece; ids are null for pieces that
    are as tokenized (their text gives them), and those of the part for pieces that were cut."""
    pieces = durable(tokenized(df, path, key, text), "pieces")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most WINDOW rows
    histogram = np.zeros(WINDOW + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["n"]
    plan = df.sparkSession.sparkContext.broadcast(Plan(histogram))
    ranked = numbered(pieces, ["length"], [key, "start", "ids_crc32"], "rank")
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

    def place(keys, starts, lengths, crcs, totals, ids, ranks):
        rows = []
        for k, start, length, c, total, own, rank in zip(keys, starts, lengths, crcs, totals, ids, ranks, strict=True):
            parts = plan.value.place(length, rank)
            for at, n, sequence, offset in parts:
                cut = np.frombuffer(own, "<u2")[at : at + n] if len(parts) > 1 else None
                rows.append((k, start + at, n, c if cut is None else crc(cut), total, sequence, offset, None if cut is None else cut.tobytes()))
        return [list(c) for c in zip(*rows, strict=True)]

    return map_columns(ranked.select(key, "start", "length", "ids_crc32", "doc_tokens", "ids", "rank"), lambda: place, schema)


def op5_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed."""
    return packed_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path()).drop("ids")
