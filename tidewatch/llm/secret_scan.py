"""Secret scans with structural confirmation.

Base patterns (assignments, access keys, long hex) report as they match. Further candidates report only once decoded and
parsed. ``der``: base64 (either alphabet) or hex, on one line, wrapped over lines or with colons, anywhere in a run (also
behind ``0x`` or a path), that opens a DER value whose nested lengths all close and whose fields are those of a private
key: PKCS#1, DSA, SEC1, PKCS#8 or encrypted PKCS#8. The DER length says where the key ends. Certificates and public keys
are none. ``pem``: a PEM block, also with escaped line ends, that holds such a key, an OpenSSH key frame or, under
Proc-Type and DEK-Info headers, whole cipher blocks. ``jwt``: a token whose header is JSON with an ``alg``. A key
inside a PEM block is reported once, as ``pem``. Offsets are code points, end exclusive. Null and empty texts hold nothing;
every text is scanned whole; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession

from .common import map_columns, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A run that is too short holds no longer one, so these minima drop the same matches as a later test of the length.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----")
#: A line end, also an escaped one, with what may surround it in source code.
WRAP = r"""(?:(?:["'][ \t]*[+,.\\]?)?[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*(?:[+.]?[ \t]*["'])?)"""
BROKEN = re.compile(WRAP)
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?")
#: Runs that may hold a key, and where in a run one may start: 0x30 and a length, in base64 and in hex.
BLOB = re.compile(rf"[A-Za-z0-9+/_-]{{24,}}(?:{WRAP}[A-Za-z0-9+/_-]+)*")
BLOB_START = re.compile("M[A-I]")
HEXES = re.compile(rf"[0-9a-fA-F]{{24,}}(?:{WRAP}[0-9a-fA-F]+)*|(?:[0-9a-fA-F]{{2}}:\s*){{15,}}[0-9a-fA-F]{{2}}")
COLONS = re.compile(r":\s*")
HEX_START = re.compile("(?=30)")
STANDARD = str.maketrans("-_", "+/")
KINDS = ("assign", "access", "hex", "pem", "jwt", "der")
SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06
#: Prefixes of the object identifiers of password-based encryption: PKCS#5 and PKCS#12, fixed values.
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def value(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, stop) of the DER value at ``at``; None unless its header is whole and its content ends by ``end``."""
    if end - at < 2 or data[at] & 0x1F == 0x1F:
        return None
    size, start = data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > end:
            return None
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
    return (data[at], start, start + size) if start + size <= end else None


def values(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER values that fill data[at:end] exactly, or None."""
    out = []
    while at < end:
        found = value(data, at, end)
        if found is None:
            return None
        out.append(found)
        at = found[2]
    return out


def der_closes(data: bytes) -> bool:
    """Whether the data are DER values whose lengths, also all those nested, close exactly."""
    waiting = [(0, len(data))]
    while waiting:
        found = values(data, *waiting.pop())
        if found is None:
            return False
        waiting += [(start, stop) for tag, start, stop in found if tag & 0x20]
    return len(data) > 0


def is_key(data: bytes) -> bool:
    """One private key, by its fields: PKCS#1 or DSA (a version and integers), SEC1, PKCS#8 or encrypted PKCS#8."""
    outer = values(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE or not der_closes(data):
        return False
    fields = values(data, *outer[0][1:])
    tags, parts = [t for t, _, _ in fields], [data[a:b] for _, a, b in fields]
    if len(tags) < 2:
        return False
    inner = values(data, *fields[tags.index(SEQUENCE)][1:]) if SEQUENCE in tags[:2] else None
    named = bool(inner) and inner[0][0] == OID
    if tags == [SEQUENCE, OCTETS]:
        return named and data[slice(*inner[0][1:])].startswith(PASSWORD_BASED) and len(parts[1]) >= 8
    if tags[0] != INTEGER or parts[0] not in (b"\0", b"\1"):
        return False
    if tags[1:3] == [SEQUENCE, OCTETS]:
        return named and len(parts[2]) >= 16 and all(t & 0xC0 == 0x80 for t in tags[3:])
    if tags[1] == OCTETS:
        return parts[0] == b"\1" and len(parts[1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    whole = [p for t, p in zip(tags, parts, strict=True) if t == INTEGER]
    return (len(whole) == len(tags) == 6 or len(whole) >= 9 and tags[9:] in ([], [SEQUENCE])) and len(whole[1]) >= 32


def is_openssh(data: bytes) -> bool:
    """An OpenSSH frame: cipher, key derivation and its options, public keys and the private part, which ends the data."""
    head = b"openssh-key-v1\0"
    if not data.startswith(head):
        return False
    at, keys, seen = len(head), None, 0
    while at + 4 <= len(data):
        if seen == 3 and keys is None:
            keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            continue
        at, seen = at + 4 + int.from_bytes(data[at : at + 4], "big"), seen + 1
    return at == len(data) and keys is not None and keys > 0 and seen == 4 + keys


def unbase64(text: str) -> bytes:
    text = text.rstrip("=").translate(STANDARD)
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def from_base64(text: str, size: int) -> bytes:
    """The first ``size`` bytes."""
    return unbase64(text[: -(-size * 4 // 3)])[:size]


def from_hex(text: str, size: int) -> bytes:
    return bytes.fromhex(text[: 2 * size - len(text[: 2 * size]) % 2])


def keys_in(run: str, starts: re.Pattern, decode, room) -> list[tuple[int, int]]:
    """Spans in a run of digits that decode to one private key; room(digits): the bytes that they make."""
    out, at = [], 0
    while m := starts.search(run, at):
        at = m.start() + 1
        rest = run[m.start() : m.start() + 96]
        head = decode(rest, min(64, room(len(rest))))
        if len(head) < 8 or head[0] != SEQUENCE:
            continue
        n = head[1] & 0x7F if head[1] >= 0x80 else 0
        size = (int.from_bytes(head[2 : 2 + n], "big") if n else head[1]) + 2 + n
        # The first field says already whether this may be a key: a version, or an algorithm's sequence.
        if n > 4 or (n == 0 and head[1] >= 0x80) or size < 24 or size > room(len(run) - m.start()) or head[2 + n : 5 + n] not in (b"\2\1\0", b"\2\1\1") and head[2 + n] != SEQUENCE:
            continue
        digits = -(-size * 4 // 3) if room(4) == 3 else 2 * size
        if is_key(decode(run[m.start() : m.start() + digits], size)):
            out.append((m.start(), m.start() + digits))
            at = m.start() + digits
    return out


def key_spans(text: str) -> list[tuple[int, int]]:
    """Spans of private keys in base64 or hex; padding signs behind base64 belong to it."""
    out = []
    for pattern, starts, decode, room in ((BLOB, BLOB_START, from_base64, lambda n: n * 3 // 4), (HEXES, HEX_START, from_hex, lambda n: n // 2)):
        for m in pattern.finditer(text):
            whole, froms, tos, size, at, parts = m[0], [0], [m.start()], 0, 0, []
            for b in (COLONS if ":" in whole else BROKEN).finditer(whole):
                parts.append(whole[at : b.start()])
                size, at = size + b.start() - at, b.end()
                froms.append(size)
                tos.append(m.start() + at)
            run = "".join([*parts, whole[at:]])
            place = lambda i: tos[k := bisect_right(froms, i) - 1] + i - froms[k]  # noqa: B023, E731
            for a, b in keys_in(run, starts, decode, room):
                stop = place(b - 1) + 1
                if pattern is BLOB:
                    while text[stop : stop + 1] == "=" and stop - place(b - 1) <= 2:
                        stop += 1
                out.append((place(a), stop))
    return out


def is_pem_key(label: str, body: str) -> bool:
    """Whether the body of a PEM block, its headers aside, is a private key."""
    lines = [x.strip() for x in re.split(r"\r?\n|\\r\\n|\\n", body)]
    headers = [x for x in lines if ":" in x]
    data = unbase64(re.sub(r"\s+", "", "".join(x for x in lines if ":" not in x)))
    if any(x.startswith("Proc-Type") and "ENCRYPTED" in x for x in headers) and any(x.startswith("DEK-Info") for x in headers):
        return label.endswith("PRIVATE KEY") and len(data) >= 16 and len(data) % 8 == 0
    return is_key(data) or is_openssh(data)


def pem_spans(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while m := BEGIN.search(text, at):
        end, close = f"-----END {m[1]}-----", text.find("-----", m.end())
        at = m.end()
        if close >= 0 and text.startswith(end, close) and is_pem_key(m[1], text[m.end() : close]):
            out.append((m.start(), close + len(end)))
            at = close + len(end)
    return out


def is_token(text: str) -> bool:
    try:
        header = json.loads(unbase64(text.split(".", 1)[0]))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    blocks = pem_spans(text) if "-----BEGIN " in text else []
    found = [(a, b, "pem") for a, b in blocks]
    if "ey" in text or "ew" in text:
        found += [(m.start(), m.end(), "jwt") for m in TOKEN.finditer(text) if is_token(m[0])]
    return found + [(a, b, "der") for a, b in key_spans(text) if not any(x <= a and b <= y for x, y in blocks)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def masked(text: str | None) -> str | None:
    """The text with every span, overlapping ones merged, replaced by a mark of its kind; a text without is unchanged."""
    if not text:
        return text
    spans = sorted(base_spans(text) + confirmed_spans(text))
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k, end = k + 1, max(end, spans[k + 1][1])
        out += [text[at:start], f"[{kind}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def secret_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind, start, stop>>) of every row, empty where nothing is found."""

    def scan(keys, texts):
        rows = [sorted(base_spans(t) + confirmed_spans(t)) if t else [] for t in texts]
        return [keys, [[{"kind": k, "start": a, "stop": b} for a, b, k in r] for r in rows]]

    return map_columns(df.select(key, text), lambda: scan, f"`{key}` {dict(df.dtypes)[key]}, spans array<struct<kind:string,start:int,stop:int>>")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document text scanned once."""

    def scan(keys, texts):
        counts, shas, spans = {k: [] for k in KINDS[:3]}, [], []
        for t in texts:
            base = base_spans(t) if t else []
            for k in counts:
                counts[k].append(sum(s[2] == k for s in base))
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(base + confirmed_spans(t)) if t else "")
        return [keys, *counts.values(), shas, spans]

    return map_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda: scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
