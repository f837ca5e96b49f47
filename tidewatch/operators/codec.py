"""The sample codec after Gorilla (Pelkonen et al., 2015): delta of deltas for times, XOR of bits for values.

Parquet stores the samples; the codec is there to report encoded sizes and to exchange chunks. Times must not go back.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widths of a delta of deltas: (bits of the prefix, prefix, bits of the number).
TIME_WIDTHS = ((2, 0b10, 7), (3, 0b110, 9), (4, 0b1110, 12))
MASK = (1 << 64) - 1


def bits_of(x: float) -> int:
    return struct.unpack(">Q", struct.pack(">d", x))[0]


def float_of(bits: int) -> float:
    return struct.unpack(">d", struct.pack(">Q", bits))[0]


class Writer:
    """Samples into bits, most significant first."""

    def __init__(self, keep: bool = True):
        self.parts, self.size, self.count, self.keep = [], 0, 0, keep
        self.time = self.delta = self.bits = 0
        self.lead, self.trail = 0, -1  # the open window; trail -1: none

    def _put(self, value: int, width: int) -> None:
        self.size += width
        if self.keep and width:
            self.parts.append(format(value & ((1 << width) - 1), f"0{width}b"))

    def push(self, time: int, value: float) -> None:
        bits = bits_of(value)
        if not self.count:
            self._put(time, 64)
            self._put(bits, 64)
        else:
            delta = time - self.time
            self._time(delta - self.delta)
            self.delta = delta
            self._value(bits ^ self.bits)
        self.time, self.bits, self.count = time, bits, self.count + 1

    def _time(self, change: int) -> None:
        if not change:
            return self._put(0, 1)
        for n, prefix, width in TIME_WIDTHS:
            if -(1 << width - 1) <= change < 1 << width - 1:
                self._put(prefix, n)
                return self._put(change, width)
        self._put(0b1111, 4)
        self._put(change, 64)

    def _value(self, xor: int) -> None:
        if not xor:
            return self._put(0, 1)
        lead, trail = min(64 - xor.bit_length(), 31), (xor & -xor).bit_length() - 1
        if self.trail >= 0 and lead >= self.lead and trail >= self.trail:
            self._put(0b10, 2)
            return self._put(xor >> self.trail, 64 - self.lead - self.trail)
        self.lead, self.trail = lead, trail
        width = 64 - lead - trail
        self._put(0b11, 2)
        self._put(lead, 5)
        self._put(width - 1, 6)
        self._put(xor >> trail, width)

    @property
    def bytes_used(self) -> int:
        return -(-self.size // 8)

    def data(self) -> bytes:
        text = "".join(self.parts)
        return int(text.ljust(self.bytes_used * 8, "0"), 2).to_bytes(self.bytes_used, "big") if text else b""


def decode(data: bytes, count: int) -> list[tuple[int, float]]:
    """The first ``count`` samples; fewer if the data end before."""
    text, at, out = "".join(format(b, "08b") for b in data), 0, []

    def take(width: int) -> int:
        nonlocal at
        if at + width > len(text):
            raise EOFError
        at += width
        return int(text[at - width : at], 2) if width else 0

    signed = lambda x, width: x - (1 << width) if x >> width - 1 else x
    time = delta = bits = lead = width = 0
    try:
        while len(out) < count:
            if not out:
                time, bits = signed(take(64), 64), take(64)
            else:
                ones = 0
                while ones < 4 and take(1):
                    ones += 1
                size = (0, 7, 9, 12, 64)[ones]
                delta += signed(take(size), size) if size else 0
                time += delta
                if take(1):
                    if take(1):
                        lead, width = take(5), take(6) + 1
                    bits ^= take(width) << 64 - lead - width
            out.append((time, float_of(bits)))
    except EOFError:
        pass
    return out


def _chunks(metrics: DataFrame, keep: bool, schema: str, most: int | None = None) -> DataFrame:
    names = [p.split(" ")[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, writer = object(), None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (last, writer.count, writer.data() if keep else writer.bytes_used)], names=names)
        for batch in batches:
            for series, time, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if series != last or writer.count == most:
                    if writer:
                        yield row()
                    last, writer = series, Writer(keep)
                writer.push(time, value)
        if writer:
            yield row()

    ordered = metrics.select("series_id", "ts_ms", "value", "seq").repartition("series_id").sortWithinPartitions("series_id", "ts_ms", "seq")
    return ordered.select("series_id", "ts_ms", "value").mapInArrow(run, schema)


def encoded_sizes(metrics: DataFrame) -> DataFrame:
    """(series_id, samples, bytes) of every series; the bits are counted, not kept."""
    return _chunks(metrics, False, "series_id long, samples long, bytes long")


def encoded(metrics: DataFrame, most: int = 1 << 16) -> DataFrame:
    """(series_id, samples, chunk) of every series, in chunks of at most ``most`` samples, so that neither side holds more."""
    return _chunks(metrics, True, "series_id long, samples long, chunk binary", most)


def decoded(chunks: DataFrame) -> DataFrame:
    """(series_id, ts_ms, value) of every sample of the chunks."""

    def run(batches):
        for batch in batches:
            for series, count, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = decode(data, count)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([series] * len(found)), pa.array([t for t, _ in found]), pa.array([v for _, v in found])], names=["series_id", "ts_ms", "value"])

    return chunks.select("series_id", "samples", "chunk").mapInArrow(run, "series_id long, ts_ms long, value double")


def time_bits(ts: str = "ts_ms") -> Column:
    """Bits of a delta of deltas column named ``change``."""
    out = F.lit(68)
    for n, _, width in reversed(TIME_WIDTHS):
        out = F.when(F.col("change").between(-(1 << width - 1), (1 << width - 1) - 1), n + width).otherwise(out)
    return F.when(F.col("change") == 0, 1).otherwise(out)


def time_sizes(metrics: DataFrame) -> DataFrame:
    """(series_id, bits) that the times of each series take, without Python."""
    w = Window.partitionBy("series_id").orderBy("ts_ms", "seq")
    rows = metrics.withColumn("delta", F.col("ts_ms") - F.lag("ts_ms").over(w))
    rows = rows.withColumn("change", F.col("delta") - F.coalesce(F.lag("delta").over(w), F.lit(0)))
    return rows.groupBy("series_id").agg(F.first("labels").alias("labels"), F.sum(F.when(F.col("delta").isNull(), 64).otherwise(time_bits())).alias("bits"))
