"""Exact top-k by inner product with Fagin's threshold algorithm.

Components become integers, floor(64 x) with x as double, so scores are exact. Candidates are dealt evenly into blocks of
about ``BLOCK`` rows. A block deals its rows to groups that lie close together; each group sorts its rows once by every
dimension. A group's bound for a query is the sum over dimensions of its component times the best value of the list, which no
row of the group can exceed. A query takes the groups with its best bounds first, then the others, and passes those whose
bound is below its k-th score so far. In a group it walks the lists of its nonzero dimensions from their best end, scores
the newly seen rows, and stops once its k-th score is above what any unseen row can reach (the same sum with the
values where the walk stands). With a score equal to the bound it goes on, since an unseen row with a smaller id may tie.
Depths double, so a walk of a group has a logarithmic number of steps. Queries walk a group together, each until its own
bound ends it; a score that a query's walk has not come to is never used. Nothing but the bound ends a walk early. The
blocks' lists of k are merged by a windowed limit, one row a query, block and rank.

Vectors that are null or empty or hold null or non-finite components, and rows with a null id, take no part; vectors meet
only vectors of their length. Ties go to the smaller id. A query's own row is every row with its id. Rows equal in id and
vector are one query, but each is a candidate; rows equal in id alone are queries with k rows each. Fewer than k candidates
give fewer rows; an empty table gives none. Components of any finite size are exact: where doubles could not hold a
score, Python's integers do, and a score beyond a long counts as the end of the longs that it passed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, grouped_rows, shuffle_width, small_batches, table

K, BLOCK, GROUP = 20, 8192, 32
#: Groups that a query takes by its own order before all others, and queries that walk together.
FIRST, TOGETHER = 4, 1024
LEAST, MOST = -(2**63), 2**63 - 1


def whole_steps(vector: list[float]) -> list[int]:
    """floor(64 x) of each component, exactly; a double of 2^53 or more is an integer already."""
    return [int(x) * 64 if abs(x) >= 2.0**53 else int(np.floor(x * 64)) for x in vector]


def exact_in_doubles(steps: np.ndarray) -> np.ndarray:
    """Whether inner products among such rows keep to integers that doubles hold."""
    return np.abs(steps).max(1) < np.sqrt(2.0**52 / steps.shape[1])


class Group:
    """Candidates with their lists by dimension, of doubles or, where these are not exact, of Python's integers."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").T
        self.values = np.take_along_axis(rows, self.order.T, axis=0).T
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.broadcast_to(np.arange(len(ids)), self.order.shape), 1)

    def walk(self, query: np.ndarray, up: np.ndarray, down: np.ndarray, kth, better) -> int:
        """Calls better(ids, scores), which returns the k-th score so far (None: fewer than k), for the rows as they are
        seen; the number of rows seen when the bound, or the end of the lists, ended the walk."""
        n = len(self.ids)
        if not len(up) + len(down):
            better(self.ids, np.zeros(n))
            return n
        seen, done, depth, count = np.zeros(n, bool), 0, 1, 0
        while True:
            fresh = np.zeros(n, bool)
            fresh[self.order[up, n - depth : n - done]] = True
            fresh[self.order[down, done:depth]] = True
            fresh &= ~seen
            seen |= fresh
            at = np.flatnonzero(fresh)
            count += len(at)
            if len(at):
                kth = better(self.ids[at], self.rows[at] @ query)
            if count == n:
                return n
            reach = query[up] @ self.values[up, n - depth - 1] + query[down] @ self.values[down, depth]
            if kth is not None and kth > reach:
                return count
            done, depth = depth, min(n, depth * 2)


class Block:
    """Candidates in groups of about GROUP near a pivot; rows that need Python's integers are groups of their own."""

    def __init__(self, ids: list[int], vectors: list[list[float]]):
        ids, steps = np.array(ids, np.int64), np.floor(np.array(vectors, np.float64) * 64)
        narrow = exact_in_doubles(steps)
        self.groups = [(Group(ids[own], steps[own])) for own in self.dealt(np.flatnonzero(narrow), steps)]
        wide = np.flatnonzero(~narrow)
        for start in range(0, len(wide), GROUP):
            own = wide[start : start + GROUP]
            self.groups.append(Group(ids[own], np.array([whole_steps(vectors[i]) for i in own], object)))
        self.sized = [np.stack([g.values[:, k] for g in self.groups]) for k in (0, -1)]
        self.rows, self.narrow = len(ids), not len(wide)

    @staticmethod
    def dealt(members: np.ndarray, steps: np.ndarray) -> list[np.ndarray]:
        """Halved between two far members until a part has GROUP rows at most; equal rows are cut anywhere."""
        parts, out = [members], []
        while parts:
            own = parts.pop()
            if len(own) <= GROUP:
                out += [own] if len(own) else []
                continue
            rows = steps[own]
            a = rows[((rows - rows[0]) ** 2).sum(1).argmax()]
            b = rows[((rows - a) ** 2).sum(1).argmax()]
            side = np.argsort(rows @ (b - a), kind="stable")
            cut = int(np.clip((rows @ (b - a) < (a + b) @ (b - a) / 2).sum(), GROUP // 4, len(own) - GROUP // 4))
            parts += [own[side[:cut]], own[side[cut:]]]
        return out

    def best(self, own: int, vector: list[float], k: int = K) -> tuple[list[tuple[int, int]], int]:
        """(id, score) of the k best rows but those of the query's id, ties to the smaller id; and how many rows were seen."""
        query = np.floor(np.array(vector, np.float64) * 64)
        exact = bool(exact_in_doubles(query[None])[0])
        if not exact:
            query = np.array(whole_steps(vector), object)
        up, down = (np.flatnonzero(np.array(x, bool)) for x in (query > 0, query < 0))
        ids, scores, kth, seen = np.zeros(0, np.int64), np.zeros(0, object if not exact else np.float64), None, 0

        def better(fresh_ids, fresh_scores):
            nonlocal ids, scores, kth
            if kth is not None and fresh_scores.max() < kth:
                return kth
            mine = fresh_ids != own
            ids, scores = np.concatenate([ids, fresh_ids[mine]]), np.concatenate([scores, fresh_scores[mine]])
            if len(ids) > k:
                at = np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k])
                ids, scores = ids[at], scores[at]
            kth = scores.min() if len(ids) == k else None
            return kth

        low, high = self.sized
        bounds = high[:, up] @ query[up] + low[:, down] @ query[down]
        for g in np.argsort(-bounds, kind="stable"):
            if kth is not None and kth > bounds[g]:
                break
            group = self.groups[g]
            seen += group.walk(query, up, down, kth, better)
        found = [(i, min(MOST, max(LEAST, int(s)))) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return sorted(found, key=lambda f: (-f[1], f[0])), seen


class Walks:
    """The walks of many queries through a block whose rows, as they themselves, are exact in doubles."""

    def __init__(self, block: Block, own: np.ndarray, queries: np.ndarray, k: int):
        self.own, self.queries, self.k, n = own, queries, k, len(own)
        self.up, self.down = (queries > 0).astype(np.float32), (queries < 0).astype(np.float32)
        self.positive, self.negative = np.maximum(queries, 0), np.minimum(queries, 0)
        self.ids, self.scores = np.full((n, k), MOST), np.full((n, k), -np.inf)
        self.seen, visited = np.zeros(n, np.int64), np.zeros((n, len(block.groups)), bool)
        bounds = self.positive @ block.sized[1].T + self.negative @ block.sized[0].T
        first = np.argsort(-bounds, 1, kind="stable")[:, :FIRST]
        turns = [(g, np.flatnonzero(turn == g)) for turn in first.T for g in np.unique(turn)]
        for g, rows in [*turns, *((g, np.arange(n)) for g in range(len(block.groups)))]:
            rows = rows[~visited[rows, g] & (bounds[rows, g] >= self.scores[rows, -1])]
            visited[rows, g] = True
            self.walk(block.groups[g], rows)

    def walk(self, group: Group, live: np.ndarray) -> None:
        n, depth = len(group.ids), 1
        seen = np.zeros((len(live), n), bool)
        while len(live):
            hit = self.up[live] @ (group.rank >= n - depth).astype(np.float32) + self.down[live] @ (group.rank < depth).astype(np.float32) > 0
            hit |= (depth >= n) | ~self.queries[live].any(1)[:, None]
            fresh = hit & ~seen
            at = np.flatnonzero(fresh.any(0))
            fresh = fresh[:, at]
            self.seen[live] += fresh.sum(1)
            scores = np.where(fresh & (group.ids[at] != self.own[live][:, None]), self.queries[live] @ group.rows[at].T, -np.inf)
            better = np.flatnonzero((scores.max(1, initial=-np.inf) >= self.scores[live, -1]) & (scores > -np.inf).any(1))
            if len(better):
                rows = live[better]
                both = np.concatenate([self.scores[rows], scores[better]], 1)
                names = np.concatenate([self.ids[rows], np.broadcast_to(group.ids[at], (len(rows), len(at)))], 1)
                best = np.lexsort((names, -both), axis=-1)[:, : self.k]
                self.scores[rows], self.ids[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
            seen = hit
            if depth >= n:
                return
            reach = self.positive[live] @ group.values[:, n - depth - 1] + self.negative[live] @ group.values[:, depth]
            on = ~hit.all(1) & (self.scores[live, -1] <= reach)
            live, seen, depth = live[on], seen[on], depth * 2
            depth = min(depth, n)

    def found(self) -> list[tuple[list[tuple[int, int]], int]]:
        out = []
        for ids, scores, seen in zip(self.ids.tolist(), self.scores.tolist(), self.seen.tolist(), strict=True):
            out.append(([(i, int(s)) for i, s in zip(ids, scores, strict=True) if s > -np.inf], seen))
        return out


def answers(block: Block, asked: list[tuple[int, list[float]]], k: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Block.best() of each (own id, vector), together where doubles are exact."""
    steps = np.floor(np.array([v for _, v in asked], np.float64) * 64)
    if not block.narrow or not exact_in_doubles(steps).all():
        return [block.best(i, v, k) for i, v in asked]
    return Walks(block, np.array([i for i, _ in asked], np.int64), steps, k).found()


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & ~bad)


def walks(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, same, rank, id, score, seen, rows) of each block's k best for every query; same: a hash of its vector. Of a
    walk's rows in the block it had seen so many when its bound ended it; rank 0 says so for walks without any result."""
    spark = df.sparkSession
    rows = whole_vectors(df, key, vector)
    blocks = max(1, -(-rows.count() // BLOCK))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(blocks))
    candidates = rows.select(F.size("v").alias("d"), spread.alias("block"), F.lit(0).alias("query"), "id", F.lit(0).cast("long").alias("same"), "v")
    # Sums from 0.0 turn the negative zero into the other, which it equals.
    asked = rows.where(is_query).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()
    queries = asked.select(F.size("v").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("query"), "id", F.xxhash64("v").alias("same"), "v")
    schema = "query_id long, same long, rank long, id long, score long, seen long, rows long"
    shape = arrow_schema(schema)

    def run(batches):
        for _, part in grouped_rows(batches, 2):
            ids, vectors, block, out, asked = [], [], None, [], []

            def answer():
                for (i, same, _), (found, seen) in zip(asked, answers(block, [(i, v) for i, _, v in asked], k), strict=True):
                    out.extend([(i, same, n, *f, seen, block.rows) for n, f in enumerate(found, 1)] or [(i, same, 0, None, None, seen, block.rows)])
                asked.clear()

            for query, i, same, v in part:
                if not query:
                    ids.append(i)
                    vectors.append(v)
                    continue
                if block is None:
                    block = Block(ids, vectors) if ids else False
                    ids = vectors = None
                if block:
                    asked.append((i, same, v))
                    if len(asked) >= TOGETHER:
                        answer()
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=shape)
                        out.clear()
            if asked:
                answer()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=shape)

    small_batches(spark)
    return candidates.unionByName(queries).repartition(max(blocks, shuffle_width(spark)), "d", "block").sortWithinPartitions("d", "block", "query").mapInArrow(run, schema)


def top_k(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, id, score) of the k best of all rows for every row where ``is_query`` (a condition on id) holds."""
    found = walks(df, is_query, key, vector, k).where("rank > 0").select("query_id", "same", "id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id", "same").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def walk_report(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """One row: walks (a query and a block), those that the bound ended before all rows were seen, and the share of rows seen."""
    each = walks(df, is_query, key, vector, k).where("rank <= 1")
    return each.agg(F.count(F.lit(1)).alias("walks"), F.count_if(F.col("seen") < F.col("rows")).alias("ended"), (F.sum("seen") / F.sum("rows")).alias("seen"))


def op7_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all others."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (
  SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 20 = 0
), s AS (
  SELECT a.vec_id AS query_id, a.q AS query, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
