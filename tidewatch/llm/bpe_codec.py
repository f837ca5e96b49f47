"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file.

Texts over ``CUT`` characters are first cut by a regex at places that no match of the splitting pattern reaches across:
where one kind of character (letter, number, white space, other) ends and another begins, but not after white space, which
may belong to the word behind it, nor between other and letter, where a contraction may stand. Kinds are those of Unicode
3.2 for characters that have not changed since, so that they are the library's too. Every match lies on one side of such a
place and those on the right are found as in the whole text, so the ids are those of the whole text. What has no such
place, a run of one kind, is one match of the pattern and is encoded in one piece; a white-space run of ``RUN`` or more,
which the library's regex can't look behind the end of, is cut as the pattern says (its last character goes with what follows) and
encoded as the one match it is. Null texts count as empty (no ids); repeated rows are encoded each; an empty table
gives no rows. Decoding joins raw token bytes, so any id sequence decodes, also one cut inside a character.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_columns, table

CUT, RUN = 20_000, 10_000
#: Unicode's White_Space, fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_SPACE = re.compile(f"[{SPACE}]{{{RUN},}}")


@lru_cache(maxsize=1)
def safe() -> re.Pattern:
    """Matches, empty, at the places where a text may be cut."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "O": []}
    space, last, start = re.compile(f"[{SPACE}]"), None, 0
    for c in range(sys.maxunicode + 2):
        kind = None
        if c <= sys.maxunicode and not space.match(chr(c)):
            old, new = unicodedata.ucd_3_2_0.category(chr(c))[0], unicodedata.category(chr(c))[0]
            kind = None if old != new or unicodedata.ucd_3_2_0.category(chr(c)) in ("Cn", "Cs", "Co") else new if new in "LN" else "O"
        if kind != last:
            if last:
                kinds[last].append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            last, start = kind, c
    letter, number, other = ("".join(kinds[k]) for k in "LNO")
    return re.compile(f"(?<=[{letter}])(?=[{number}{other}{SPACE}])|(?<=[{number}])(?=[{letter}{other}{SPACE}])|(?<=[{other}])(?=[{number}{SPACE}])")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    """One tiktoken encoding per worker and rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, cut: int = CUT) -> list[tuple[str, bool]]:
    """The text in pieces of about ``cut`` characters, cut only at safe places; marked: white space that is one match."""
    out, start = [], 0

    def add(start: int, stop: int) -> None:
        while stop - start > cut and (m := safe().search(text, start + cut, stop)):
            out.append((text[start : m.start()], False))
            start = m.start()
        if start < stop:
            out.append((text[start:stop], False))

    for run in LONG_SPACE.finditer(text) if len(text) >= RUN else ():
        stop = run.end() - (run.end() < len(text))
        add(start, run.start())
        out.append((text[run.start() : stop], True))
        start = stop
    add(start, len(text))
    return out


def encode(text: str | None, path: str, cut: int = CUT) -> list[int]:
    enc, ids = encoding(path), []
    for piece, one_match in pieces(text or "", cut):
        ids += enc._encode_single_piece(piece) if one_match else enc.encode_ordinary(piece)
    return ids


def encoded(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row."""
    kind = dict(df.dtypes)[key]
    return map_columns(df.select(key, text), lambda: lambda keys, texts: [keys, [encode(t, path) for t in texts]], f"`{key}` {kind}, ids array<int>")


def decoded(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes binary) of every row of ids; null ids decode to no bytes."""
    kind = dict(df.dtypes)[key]
    return map_columns(df.select(key, ids), lambda: lambda keys, rows: [keys, [encoding(path).decode_bytes(r or []) for r in rows]], f"`{key}` {kind}, bytes binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded in one pass: counts and digests of the ids and of the decoded bytes."""
    path = ranks_path()

    def make():
        enc = encoding(path)

        def digests(keys, texts):
            counts, ids_sha, bytes_sha = [], [], []
            for t in texts:
                ids = encode(t, path)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                bytes_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            return [keys, counts, ids_sha, bytes_sha]

        return digests

    return map_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
