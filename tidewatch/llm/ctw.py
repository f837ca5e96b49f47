"""Language-model scores by context-tree weighting (Willems, Shtarkov and Tjalkens, 1995) over binary-decomposed bytes.

A text is its words (runs of other bytes than ASCII white space, A-Z lower-cased) joined by one blank, then one end byte.
Each byte is eight binary decisions; each decision has its own tree of the ``DEPTH`` bytes before it, nearest first. A
node holds a Krichevsky-Trofimov estimate of its two counts, and every node of depth under DEPTH mixes its estimate with
the product of its children's mixtures, half and half, so all depths take part with their posterior weights.

How it is spread out. Each input partition sorts its grams (DEPTH context bytes and the next one) and emits every
distinct gram once, in blocks by the three nearest context bytes; so whole subtrees below depth 3 meet in one shard, which
computes them alone, and no common pair of bytes is one shard's. There are as many shards as input partitions, so what a task
reads doesn't grow with the table. The nodes of depth 2 are summed over shards by key, and each shard gets those that it has
grams under; depths 0 and 1 (256 x 255 nodes, a fixed size) are broadcast. Each shard then prices every gram that was
asked for, in doubles, and each input partition gets the prices of its own grams back, one partition a task. Words travel
the same way for the base score. Counts cover all training texts; nothing is capped, and memory per task is bounded by the
distinct grams of a shard or of one input partition (whose size spark.sql.files.maxPartitionBytes sets).

Null and empty texts have the end byte only. Repeated rows are scored alike and each counts. An empty table gives no
rows. If no text is for training, every estimate is one half and the base score has N = 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, durable, grouped_rows, map_columns, shuffle_width, small_batches, table

#: Context bytes, and how many of them, the nearest, name a shard.
DEPTH, NEAR = 5, 3
#: Positions that a task sorts at a time.
SORT_AT = 4 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\n"
U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8; bytes.split() splits at exactly the six ASCII white-space bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def grams_of(streams: list[bytes]) -> np.ndarray:
    """The grams of all positions of all streams, in order: nearest context byte highest, next byte lowest."""
    pad = b"\0" * DEPTH
    flat = np.frombuffer(pad + pad.join(streams), np.uint8)
    n = len(flat) - DEPTH
    keys = flat[DEPTH:].astype(U)
    for back in range(1, DEPTH + 1):
        keys |= flat[DEPTH - back : DEPTH - back + n].astype(U) << U(8 * (DEPTH + 1 - back))
    sizes = np.array([len(s) for s in streams], np.int64)
    real = np.ones(n, bool)
    ends = np.cumsum(sizes + DEPTH) - DEPTH
    for k in range(DEPTH):
        real[(ends[:-1] + k)] = False
    return keys[real]


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted tables of distinct keys and counts as one."""
    if not len(a[0]):
        return b
    keys, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    return zlib.compress(np.diff(keys, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel().astype(U), dtype=U)


def shard_of_key(keys: np.ndarray, shards: int) -> np.ndarray:
    top = (keys >> U(8 * (DEPTH + 1 - NEAR))) * U(0x9E3779B97F4A7C15)
    return ((top >> U(40)) % U(shards)).astype(np.int64)


_STEPS = 1 << 16
_LOG_HALF = np.r_[0.0, np.cumsum(np.log(np.arange(_STEPS) + 0.5))]
_LOG_FULL = np.r_[0.0, np.cumsum(np.log(np.arange(_STEPS) + 1.0))]


def _log_rising(n: np.ndarray, start: float, small: np.ndarray) -> np.ndarray:
    """log(start * (start+1) * ... n factors): from the table, beyond it by Stirling's series."""
    out = small[np.minimum(n, _STEPS)]
    big = n > _STEPS
    if big.any():
        series = lambda x: (x - 0.5) * np.log(x) - x + 1 / (12 * x)
        out[big] = small[_STEPS] + series(n[big] + start) - series(_STEPS + start)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return _log_rising(n0, 0.5, _LOG_HALF) + _log_rising(n1, 0.5, _LOG_HALF) - _log_rising(n0 + n1, 1.0, _LOG_FULL)


class Level:
    """The nodes of one depth and one bit position: codes (context prefix, bits before), counts and mixtures."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, bit: int):
        sides = symbols >> U(7 - bit)
        first = np.flatnonzero(np.r_[True, sides[1:] != sides[:-1]])
        side, n = sides[first], np.add.reduceat(counts, first)
        node = side >> U(1)
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        self.codes, at = node[start], np.cumsum(np.r_[False, node[1:] != node[:-1]])
        self.n = np.zeros((len(start), 2), np.int64)
        self.n[at, (side & U(1)).astype(np.int64)] = n
        self.kt = log_kt(self.n[:, 0], self.n[:, 1])
        self.mix = self.kt

    def find(self, codes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, codes)

    def weigh(self, below: np.ndarray) -> None:
        self.mix = np.log(0.5) + np.logaddexp(self.kt, below)


def levels(keys: np.ndarray, counts: np.ndarray, lowest: int = NEAR) -> dict[tuple[int, int], Level]:
    """All nodes of depths ``lowest`` to DEPTH of a shard's grams, mixtures computed from the leaves up."""
    out = {}
    for depth in range(DEPTH, lowest - 1, -1):
        symbols = (keys >> U(8 * (DEPTH + 1 - depth))) << U(8) | (keys & U(255))
        order = np.argsort(symbols, kind="stable")
        symbols, n = symbols[order], counts[order]
        for bit in range(8):
            own = out[depth, bit] = Level(symbols, n, bit)
            if depth < DEPTH:
                child = out[depth + 1, bit]
                up = (child.codes >> U(bit + 8)) << U(bit) | (child.codes & U((1 << bit) - 1))
                own.weigh(np.bincount(own.find(up), child.mix, len(own.codes)))
    return out


def upper_rows(tree: dict[tuple[int, int], Level]) -> dict[str, np.ndarray]:
    """What a shard adds to the nodes of depth 2: counts, and the logs of its depth-3 mixtures."""
    parts = []
    for bit in range(8):
        low = tree[NEAR, bit]
        code = (low.codes >> U(bit + 8)) * U(256) + (U(1 << bit) | (low.codes & U((1 << bit) - 1)))
        parts.append((code.astype(np.int64), low.n[:, 0], low.n[:, 1], low.mix))
    code, n0, n1, mix = (np.concatenate(c) for c in zip(*parts, strict=True))
    node, at = np.unique(code, return_inverse=True)
    return {"node": node, "n0": np.bincount(at, n0).astype(np.int64), "n1": np.bincount(at, n1).astype(np.int64), "mix": np.bincount(at, mix)}


def weighed(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mixture, weight of the node's own estimate, estimated probability of a one) of nodes with counts and children's mixtures."""
    kt = log_kt(n0, n1)
    whole = np.log(0.5) + np.logaddexp(kt, below)
    return whole, np.exp(np.log(0.5) + kt - whole), (n1 + 0.5) / (n0 + n1 + 1)


def top_tables(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, mix: np.ndarray) -> dict[str, np.ndarray]:
    """Per depth 0 and 1 the weight of the node's own estimate and the estimated probability of a one. 65,536 nodes."""
    c0, c1, below = np.zeros(65536, np.int64), np.zeros(65536, np.int64), np.zeros(65536)
    c0[node], c1[node], below[node] = n0, n1, mix
    whole, w1, p1 = weighed(c0, c1, below)
    c0, c1, below = (x.reshape(256, 256).sum(0) for x in (c0, c1, np.where(np.isin(np.arange(65536), node), whole, 0.0)))
    _, w0, p0 = weighed(c0, c1, below)
    return {"w1": w1, "p1": p1, "w0": w0, "p0": p0}


def prices(keys: np.ndarray, counts: np.ndarray, upper: tuple[np.ndarray, np.ndarray, np.ndarray], top: dict[str, np.ndarray]) -> np.ndarray:
    """log10 of the predictive probability of each gram's next byte after its context. upper: the nodes of depth 2, sorted,
    their weights and estimates."""
    tree, x, total = levels(keys, counts), keys & U(255), np.zeros(len(keys))
    near = (keys >> U(8 * DEPTH)).astype(np.int64)
    two = (keys >> U(8 * (DEPTH - 1))).astype(np.int64)
    for bit in range(8):
        one = ((x >> U(7 - bit)) & U(1)).astype(bool)
        before = x >> U(8 - bit)
        p = None
        for depth in range(DEPTH, NEAR - 1, -1):
            own = tree[depth, bit]
            at = own.find((keys >> U(8 * (DEPTH + 1 - depth))) << U(bit) | before)
            n = own.n[at]
            here = (n[:, 1] + 0.5) / (n.sum(1) + 1)
            if p is None:
                p = here
            else:
                w = np.exp(np.log(0.5) + own.kt[at] - own.mix[at])
                p = w * here + (1 - w) * p
        heap = (1 << bit) | before.astype(np.int64)
        at = np.searchsorted(upper[0], two * 256 + heap)
        p = upper[1][at] * upper[2][at] + (1 - upper[1][at]) * p
        p = top["w1"][near * 256 + heap] * top["p1"][near * 256 + heap] + (1 - top["w1"][near * 256 + heap]) * p
        p = top["w0"][heap] * top["p0"][heap] + (1 - top["w0"][heap]) * p
        total += np.log10(np.where(one, p, 1 - p))
    return total


#: Blocks: words = 0 for grams, 1 for words; keys are packed grams, or words joined by blanks; values go with the keys.
BLOCK = "words int, shard int, pid int, keys binary, n binary"


def _columns(shape: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, shape, strict=True)], schema=shape)


def _emit(shape: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return _columns(shape, list(zip(*rows, strict=True)))


def asked(df: DataFrame, shards: int) -> DataFrame:
    """BLOCK rows of each input partition: its distinct grams and words with the counts from training rows (0: none)."""
    shape = arrow_schema(BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, grams = TaskContext.get().partitionId(), (np.zeros(0, U), np.zeros(0, np.int64))
        words, asked_only = Counter(), set()
        waiting: dict[bool, list[bytes]] = {True: [], False: []}

        def sort_in(grams):
            for train, streams in waiting.items():
                if streams:
                    keys, n = np.unique(grams_of(streams), return_counts=True)
                    grams = merged(grams, (keys, n.astype(np.int64) * train))
                    streams.clear()
            return grams

        size = 0
        for batch in batches:
            for text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words_of(text)
                stream = b" ".join(found) + END
                waiting[not held].append(stream)
                size += len(stream)
                (asked_only if held else words).update(found)
                (asked_only if held else words).update((END,))
                if size > SORT_AT:
                    grams, size = sort_in(grams), 0
        grams = sort_in(grams)
        if len(grams[0]):
            home = shard_of_key(grams[0], shards)
            for s in np.unique(home):
                yield _emit(shape, [(0, int(s), pid, packed(grams[0][home == s]), zlib.compress(grams[1][home == s].astype("<i8").tobytes(), 1))])
        words.update(dict.fromkeys(asked_only, 0))
        by: dict[int, list[bytes]] = {}
        for w in words:
            by.setdefault(zlib.crc32(w) % shards, []).append(w)
        for s, own in by.items():
            yield _emit(shape, [(1, s, pid, zlib.compress(b" ".join(own), 1), zlib.compress(np.array([words[w] for w in own], "<i8").tobytes(), 1))])

    small_batches(df.sparkSession)
    return df.select("text", "held_out").mapInArrow(run, BLOCK)


def counts_in(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8").astype(np.int64)


def word_list(data: bytes) -> list[bytes]:
    return zlib.decompress(data).split(b" ")


MODEL = "words int, shard int, pid int, keys binary, n binary, top binary"


def by_shard(df: DataFrame, shards: int) -> DataFrame:
    """Each kind and shard in a task of its own, in the order of pid."""
    return df.repartitionById(2 * shards, (F.col("words") * shards + F.col("shard")).cast("int")).sortWithinPartitions("words", "shard", "pid")


def merged_shards(blocks: DataFrame, shards: int) -> DataFrame:
    """One MODEL row (pid -1) a shard: its distinct keys with their counts over all partitions, and its part of depth 2 (of
    words: how many are known, and how often)."""
    shape = arrow_schema(MODEL)

    def run(batches):
        for (kind, shard), rows in grouped_rows(batches, 2):
            if kind == 0:
                table, waiting = (np.zeros(0, U), np.zeros(0, np.int64)), []
                for _, keys, n in rows:
                    table = merged(table, (unpacked(keys), counts_in(n)))
                top = upper_rows(levels(*table))
                data = b"".join(np.ascontiguousarray(top[k]).tobytes() for k in ("node", "n0", "n1", "mix"))
                yield _emit(shape, [(0, shard, -1, packed(table[0]), zlib.compress(table[1].astype("<i8").tobytes(), 1), data)])
            else:
                words: dict[bytes, int] = {}
                for _, keys, n in rows:
                    for w, c in zip(word_list(keys), counts_in(n).tolist(), strict=True):
                        words[w] = words.get(w, 0) + c
                n = np.array(list(words.values()), "<i8")
                yield _emit(shape, [(1, shard, -1, zlib.compress(b" ".join(words), 1), zlib.compress(n.tobytes(), 1), np.array([(n > 0).sum(), n.sum()], "<i8").tobytes())])

    return by_shard(blocks, shards).mapInArrow(run, MODEL)


PART = "words int, shard int, node long, n0 long, n1 long, mix double"
NODE = "node long, n0 long, n1 long, whole double, w double, p double"


def upper_nodes(model: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray], int, int]:
    """BLOCK rows (pid -2) of the nodes of depth 2 for each shard that has grams under them; the tables of depths 0 and 1
    (a fixed size); V and N."""

    shape = arrow_schema(PART)

    def parts(batches):
        for b in batches:
            for kind, shard, top in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 1:
                    columns = [np.array([-1]), *np.frombuffer(top, "<i8").reshape(2, 1), np.zeros(1)]
                else:
                    flat = np.frombuffer(top, np.uint8).reshape(4, -1).copy()
                    columns = [flat[0].view(np.int64), flat[1].view(np.int64), flat[2].view(np.int64), flat[3].view(np.float64)]
                n = len(columns[0])
                for k in range(0, n, 1 << 16):
                    own = [np.full(min(n, k + (1 << 16)) - k, x) for x in (kind, shard)] + [c[k : k + (1 << 16)] for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(own, shape, strict=True)], schema=shape)

    def weigh(node, n0, n1, mix):
        n0, n1 = np.array(n0, np.int64), np.array(n1, np.int64)
        return [node, n0, n1, *weighed(n0, n1, np.array(mix))]

    def pack(shards, rows):
        flat = [np.array([(r["node"], r["w"], r["p"]) for r in row]).T for row in rows]
        return [[0] * len(shards), shards, [-2] * len(shards), [f[0].astype("<i8").tobytes() for f in flat], [f[1:].astype("<f8").tobytes() for f in flat]]

    each = model.select("words", "shard", "top").mapInArrow(parts, PART)
    summed = each.where("words = 0").groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("mix").alias("mix"))
    two = durable(map_columns(summed, lambda: weigh, NODE), "ctw-nodes")
    known = each.where("words = 1").agg(F.sum("n0"), F.sum("n1")).first()
    one = F.shiftright("node", 16) * 256 + F.col("node").bitwiseAND(255)
    rows = two.groupBy(one.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("whole").alias("mix")).toPandas()
    top = top_tables(rows.node.to_numpy(np.int64), rows.n0.to_numpy(np.int64), rows.n1.to_numpy(np.int64), rows.mix.to_numpy(float))
    wanted = each.where("words = 0").select("shard", "node").join(two.select("node", "w", "p"), "node")
    # At most 256 x 255 nodes a row.
    wanted = wanted.groupBy("shard", F.shiftright("node", 16)).agg(F.collect_list(F.struct("node", "w", "p")).alias("rows"))
    return map_columns(wanted.select("shard", "rows"), lambda: pack, BLOCK), top, int(known[0] or 0), int(known[1] or 0)


def answered(blocks: DataFrame, model: DataFrame, upper: DataFrame, top: dict[str, np.ndarray], shards: int) -> DataFrame:
    """BLOCK rows for each input partition again, with the prices (grams, float64) or training counts (words) as n."""
    shape, held = arrow_schema(BLOCK), blocks.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        for (kind, shard), rows in grouped_rows(batches, 2):
            known: dict[bytes, int] = {}
            keys, price, nodes, values = None, None, [], []
            for pid, data, n in rows:
                if pid == -2:
                    nodes.append(np.frombuffer(data, "<i8"))
                    values.append(np.frombuffer(n, "<f8").reshape(2, -1))
                elif pid < 0 and kind == 0:
                    keys, flat, both = unpacked(data), np.concatenate(nodes), np.concatenate(values, 1)
                    order = np.argsort(flat)
                    price = prices(keys, counts_in(n), (flat[order], *both[:, order]), held.value)
                elif pid < 0:
                    known = dict(zip(word_list(data), counts_in(n).tolist(), strict=True))
                elif kind == 0:
                    yield _emit(shape, [(0, shard, pid, data, price[np.searchsorted(keys, unpacked(data))].astype("<f8").tobytes())])
                else:
                    yield _emit(shape, [(1, shard, pid, data, zlib.compress(np.array([known[w] for w in word_list(data)], "<i8").tobytes(), 1))])

    return by_shard(model.drop("top").unionByName(upper).unionByName(blocks), shards).mapInArrow(run, BLOCK)


SCORE = "n_tokens long, n_known long, base double, score double"


def ctw_scores(df: DataFrame, key: str = "doc_id", text: str = "text", held_out=None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows where ``held_out`` holds
    do not teach the model. df has to give the same rows in the same partitions whenever it is read, as a table does."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), (held_out if held_out is not None else F.lit(False)).alias("held_out"))
    partitions = max(1, rows._jdf.queryExecution().toRdd().getNumPartitions())
    shards = max(shuffle_width(spark), partitions)
    blocks = durable(asked(rows, shards), "ctw-blocks")
    model = durable(merged_shards(blocks, shards), "ctw-model")
    upper, top, v, n_train = upper_nodes(model)
    back = answered(blocks, model, upper, top, shards)
    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, held_out boolean, {SCORE}"
    shape, floor = arrow_schema(schema), np.log10(max(1, n_train + v + 1))

    def run(batches):
        for (_,), rows in grouped_rows(batches, 1):
            codes, values, words, docs, size = [], [], {}, [], 0
            table = None

            def flush():
                streams = [b" ".join(w) + END for _, _, w in docs]
                grams = grams_of(streams)
                # Sorted, so that the search runs through the table instead of jumping in it.
                order = np.argsort(grams)
                at = np.minimum(np.searchsorted(table[0], grams[order]), len(table[0]) - 1)
                if (table[0][at] != grams[order]).any():
                    raise RuntimeError("the input gave other rows when it was read again")
                price = np.empty(len(grams))
                price[order] = table[1][at]
                starts = np.cumsum([0, *(len(s) for s in streams[:-1])])
                scores = np.add.reduceat(price, starts)
                sizes = np.array([len(own) + 1 for _, _, own in docs])
                c = np.fromiter(map(words.__getitem__, (w for _, _, own in docs for w in (*own, END))), np.int64)
                first = np.cumsum(sizes) - sizes
                known, base = np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(np.log10(c + 1) - floor, first)
                keys, held, _ = zip(*docs, strict=True)
                docs.clear()
                return _columns(shape, [keys, held, sizes, known, base, scores])

            for words_kind, k, text, held, data, n in rows:
                if words_kind == 0:
                    codes.append(unpacked(data))
                    values.append(np.frombuffer(n, "<f8"))
                elif words_kind == 1:
                    words.update(zip(word_list(data), counts_in(n).tolist(), strict=True))
                else:
                    if table is None:
                        flat = np.concatenate(codes)
                        order = np.argsort(flat)
                        table = flat[order], np.concatenate(values)[order]
                        codes, values = [], []
                    docs.append((k, held, words_of(text)))
                    size += len(text or "") + 1
                    if size > SORT_AT:
                        yield flush()
                        size = 0
            if docs:
                yield flush()

    small_batches(spark)
    texts = rows.select(F.spark_partition_id().alias("pid"), F.lit(2).alias("words"), "key", "text", "held_out", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("n"))
    blank = back.select("pid", "words", F.lit(None).cast(kind).alias("key"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("held_out"), "keys", "n")
    out = blank.unionByName(texts).repartitionById(partitions, "pid").sortWithinPartitions("pid", "words").mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op4_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those whose crc32(doc_id as text) mod 7 is 2 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return ctw_scores(docs, held_out=held)
