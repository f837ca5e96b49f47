"""Near-duplicate embeddings through hierarchical navigable small-world graphs, one a shard.

Vectors of one label that are equal after scaling to length one collapse to one representative with its count. The
representatives of a label are dealt into shards of about ``SHARD``; each shard builds a layered graph by insertion (Malkov
and Yashunin, 2018): a node descends greedily from the top to its own highest layer and from there on finds, with a beam
of ``BUILD``, the neighbours it links to; a node whose links overflow keeps the nearest that no nearer link leads to. Nodes
are inserted in rounds, at most as many at a time as the graph has, and see the other nodes of their round directly.

Every representative of the label is a query to every shard: greedy descent through the upper layers, then a beam over
the lowest one; once a beam is full of linked vectors, the links among these are followed to their end, so a large group
is found whole. The beam is audited against an exact scan on hashed samples of the shard's own vectors, of the label's
queries from other shards and of vectors moved a little. Recall is a query's, without self-matches, and its mean has to be
``RECALL`` in every stratum of queries of one kind and about one number of links; until then the beam doubles. Only
a beam that has grown to a share ``WHOLE`` of the shard and still fails the audit gives way to the scan of it.
``recalls`` reports for each shard the beam, the recall that its audit measured, and whether it was scanned.
Every reported link is decided by the cosine in double precision: a cosine of exactly the threshold links, none below does.

A shard unites its own links first. A query then reports its number of linked vectors in the shard and one link to each
component of the shard it touches: never all pairs. Those links are united by distributed connected components.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing and
are their own component. Vectors meet only vectors of their length. Repeated rows link with each other; rows with a null id
count as links but name no component. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, durable, grouped_rows, map_columns, shuffle_width, small_batches, table
from .components import components

COSINE, SHARD = 0.98, 4096
#: Links of a node in an upper layer (twice as many in the lowest), the beam of insertion and the first beam of queries.
LINKS, BUILD, BEAM = 12, 48, 24
#: The audit: vectors drawn of a kind, rows of a stratum, their recall, and the share of a shard that a beam may grow to.
POOL, AUDIT, RECALL, WHOLE = 1024, 64, 0.995, 0.25
#: Queries that walk together, and nodes that are inserted together.
TOGETHER, ROUND = 1024, 256


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: a[i] with each of b[i]."""
    return np.matmul(b, a[:, :, None])[:, :, 0]


class Graph:
    """A layered graph over unit vectors, in order of insertion (a hash order: random). The node i is in the layers up to the
    number of times that LINKS divides i, the first node in all. links[layer][i]: its neighbours, padded with i itself."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, n, i = vectors, len(vectors), np.arange(len(vectors))
        self.level, step = np.zeros(n, np.int64), LINKS
        while step < n:
            self.level += i % step == 0
            step *= LINKS
        self.level[:1] = top = int(self.level.max(initial=0))
        self.links = [np.repeat(i[:, None], LINKS * (2 if layer == 0 else 1), 1) for layer in range(top + 1)]
        self.done, start = min(n, 1), 1
        while start < n:
            stop = min(n, start + min(ROUND, start))
            self._insert(np.arange(start, stop))
            self.done = start = stop

    def _insert(self, new: np.ndarray) -> None:
        at = np.zeros(len(new), np.int64)
        for layer in range(len(self.links) - 1, -1, -1):
            below = self.level[new] < layer
            at[below] = self._descend(self.vectors[new[below]], at[below], layer)
            own = np.flatnonzero(~below)
            if not len(own):
                continue
            nodes = new[own]
            found, like = self._beam(self.vectors[nodes], at[own], BUILD, layer)
            at[own] = found[np.arange(len(own)), like.argmax(1)]
            peers = self.vectors[nodes] @ self.vectors[nodes].T
            np.fill_diagonal(peers, -3)
            found, like = np.concatenate([found, np.broadcast_to(nodes, peers.shape)], 1), np.concatenate([like, peers], 1)
            chosen = self._chosen(found, like, LINKS)
            self.links[layer][nodes, :LINKS] = np.where(chosen >= 0, chosen, nodes[:, None])
            self._link_back(np.repeat(nodes, LINKS)[chosen.ravel() >= 0], chosen.ravel()[chosen.ravel() >= 0], layer)

    def _chosen(self, found: np.ndarray, like: np.ndarray, most: int) -> np.ndarray:
        """For each row up to ``most`` of the found nodes (like < -2: none), nearest first: those to which no kept node is
        nearer, then the nearest of the others; -1 where there are no more."""
        width = min(found.shape[1], 2 * most)
        if width < found.shape[1]:
            top = np.argpartition(-like, width - 1, 1)[:, :width]
            found, like = np.take_along_axis(found, top, 1), np.take_along_axis(like, top, 1)
        order = np.argsort(-like, 1, kind="stable")
        found, like = np.take_along_axis(found, order, 1), np.take_along_axis(like, order, 1)
        v = self.vectors[found]
        between, keep, count = np.matmul(v, v.transpose(0, 2, 1)), np.zeros(found.shape, bool), np.zeros(len(found), int)
        for j in range(width):
            free = (like[:, j] > -2) & ~(keep[:, :j] & (between[:, j, :j] > like[:, j : j + 1])).any(1) & (count < most)
            keep[:, j] = free
            count += free
        rank = np.argsort(~keep, 1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(like, rank, 1) > -2, np.take_along_axis(found, rank, 1), -1)
        return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link_back(self, source: np.ndarray, target: np.ndarray, layer: int) -> None:
        """Adds target -> source; a target with too many links chooses among the old and the new ones."""
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first = np.unique(target, return_index=True)
        slot = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
        fresh = np.full((len(nodes), int(slot.max(initial=0)) + 1), -1)
        fresh[np.searchsorted(nodes, target), slot] = source
        old = self.links[layer][nodes]
        fresh[(fresh[:, :, None] == old[:, None, :]).any(2)] = -1
        both = np.concatenate([np.where(old == nodes[:, None], -1, old), fresh], 1)
        like = np.where(both >= 0, dots(self.vectors[nodes], self.vectors[both]), -3.0)
        chosen = self._chosen(both, like, old.shape[1])
        self.links[layer][nodes] = np.where(chosen >= 0, chosen, nodes[:, None])

    def _descend(self, queries: np.ndarray, at: np.ndarray, layer: int) -> np.ndarray:
        """Greedy steps in a layer until no neighbour is nearer."""
        at, moving = at.copy(), np.arange(len(at))
        now = np.einsum("qd,qd->q", queries, self.vectors[at])
        while len(moving):
            around = self.links[layer][at[moving]]
            like = dots(queries[moving], self.vectors[around])
            best = like.argmax(1)
            row = np.arange(len(moving))
            better = like[row, best] > now[moving]
            at[moving[better]], now[moving[better]] = around[row, best][better], like[row, best][better]
            moving = moving[better]
        return at

    def _beam(self, q: np.ndarray, at: np.ndarray, beam: int, layer: int = 0, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``beam`` nearest nodes that a walk from ``at`` finds, and their cosines (-3: none); ``seen``
        gets the cosines of all nodes that it visits."""
        links, m = self.links[layer], len(q)
        like = np.full((m, len(self.vectors)), -2.0, np.float32) if seen is None else seen
        done, rows = np.zeros(like.shape, bool), np.arange(m)
        like[rows, at] = np.einsum("qd,qd->q", q, self.vectors[at])
        heap, value = np.repeat(at[:, None], beam, 1), np.full((m, beam), -3.0)
        value[:, 0] = like[rows, at]
        live, step = rows, min(4, beam)
        while True:
            held, worth = heap[live], value[live]
            waiting = np.where((worth > -2) & ~done[live[:, None], held], worth, -3.0)
            pick = np.argpartition(-waiting, step - 1, 1)[:, :step]
            good = np.take_along_axis(waiting, pick, 1) > -3
            on = good.any(1)
            live, held, pick, good = live[on], held[on], pick[on], good[on]
            if not len(live):
                return heap, value
            node = np.take_along_axis(held, pick, 1)
            node = np.where(good, node, node[np.arange(len(pick)), good.argmax(1)][:, None])
            done[live[:, None], node] = True
            around = np.sort(links[node].reshape(len(live), -1), 1)
            fresh = like[live[:, None], around] <= -2
            fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
            row, col = np.nonzero(fresh)
            who, what = live[row], around[row, col]
            like[who, what] = np.einsum("kd,kd->k", q[who], self.vectors[what])
            now = np.where(fresh, like[live[:, None], around], -3.0)
            joint, worth = np.concatenate([heap[live], around], 1), np.concatenate([value[live], now], 1)
            best = np.argpartition(-worth, beam - 1, 1)[:, :beam]
            heap[live], value[live] = np.take_along_axis(joint, best, 1), np.take_along_axis(worth, best, 1)

    def search(self, queries: np.ndarray, beam: int) -> list[np.ndarray]:
        """For each query the nodes with a cosine of COSINE or more that its beam finds."""
        links, n, out = self.links[0], len(self.vectors), []
        for start in range(0, len(queries), TOGETHER):
            q = queries[start : start + TOGETHER]
            at = np.zeros(len(q), np.int64)
            for layer in range(len(self.links) - 1, 0, -1):
                at = self._descend(q, at, layer)
            like = np.full((len(q), n), -2.0, np.float32)
            _, value = self._beam(q, at, min(beam, n), 0, like)
            # A beam full of linked nodes may have more behind it: follow all links between linked nodes.
            for i in np.flatnonzero(value.min(1) >= COSINE):
                found = like[i] >= COSINE
                edge = np.flatnonzero(found)
                while len(edge):
                    new = np.unique(links[edge])
                    new = new[like[i, new] <= -2]
                    like[i, new] = self.vectors[new] @ q[i]
                    edge = new[like[i, new] >= COSINE]
            out += [np.flatnonzero(row >= COSINE - 1e-6) for row in like]
        return out

    def scan(self, queries: np.ndarray) -> list[np.ndarray]:
        """What search() gives, by scoring every node."""
        parts = (queries[k : k + TOGETHER] @ self.vectors.T for k in range(0, len(queries), TOGETHER))
        return [np.flatnonzero(row >= COSINE - 1e-6) for part in parts for row in part]

    def audited(self, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, their exact links by node, stratum) of the audit: members without their self-matches, ``others`` from
        outside the graph, and members moved to a cosine over COSINE, so that queries from outside are never missing. A
        stratum is a kind of query with about one number of links; it has AUDIT rows at most, and all of them have links."""
        draw = np.random.default_rng(len(self.vectors))
        own = draw.permutation(len(self.vectors))[:POOL]
        moved = self.vectors[own[:AUDIT]]
        aside = draw.normal(size=moved.shape)
        aside -= np.einsum("qd,qd->q", aside, moved)[:, None] * moved
        cosine = draw.uniform(COSINE, 1, (len(moved), 1))
        moved = cosine * moved + np.sqrt(1 - cosine**2) * aside / np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-30)
        kinds = [self.vectors[own], moved] + ([others] if others is not None and len(others) else [])
        queries = np.concatenate(kinds)
        truth = queries @ self.vectors.T >= COSINE
        truth[np.arange(len(own)), own] = False
        links = truth.sum(1)
        strata = 64 * np.repeat(np.arange(len(kinds)), [len(k) for k in kinds]) + np.log2(np.maximum(links, 1)).astype(int) // 2
        picked = np.concatenate([np.flatnonzero((strata == s) & (links > 0))[:AUDIT] for s in np.unique(strata)])
        return queries[picked], truth[picked], strata[picked]

    def beam(self, others: np.ndarray | None = None) -> tuple[int, float, int]:
        """(beam, recall, audited queries): the narrowest beam, doubled from BEAM, whose mean recall of a query's links is
        RECALL in every stratum, and the mean recall that it had; beam 0: none up to WHOLE of the shard, so scan."""
        queries, truth, strata = self.audited(others)
        beam, least = BEAM, 1.0
        while True:
            found = self.search(queries, beam)
            recall = np.array([t[f].sum() / t.sum() for t, f in zip(truth, found, strict=True)])
            least = min((recall[strata == s].mean() for s in np.unique(strata)), default=1.0)
            if least >= RECALL:
                return beam, float(recall.mean()) if len(recall) else 1.0, len(recall)
            if beam > WHOLE * len(self.vectors):
                return 0, 1.0, len(recall)
            beam *= 2


def united(n: int, pairs: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The smallest node of each node's component."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, others in pairs:
        for b in others.tolist():
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(n)], np.int64)


def units(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, unit, same) of every row; unit: the scaled vector as binary doubles and same its digest, null where the
    row links with nothing."""
    def scale(ids, labels, vectors):
        out, names = [], []
        for lab, v in zip(labels, vectors, strict=True):
            x = None if lab is None or not v or any(c is None for c in v) else np.array(v, np.float64)
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                x = None if x is None or not np.isfinite(x).all() or not x.any() else x / np.abs(x).max()
            if x is not None:
                x = (x / np.sqrt(x @ x)).tobytes()
            out.append(x)
            names.append(x and hashlib.blake2b(x, digest_size=16).digest())
        return [ids, labels, out, names]

    return map_columns(df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")), lambda: scale, f"id long, label {dict(df.dtypes)[label]}, unit binary, same binary")


FOUND = "kind int, node long, other long, links long, recall double"


def shard_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reps, found): the representatives (label, same, n, least, unit, node), and what the shards report, a FOUND row each:
    kind 0, a link from a node to a component of a shard; kind 1, a node's linked vectors in a shard; kind 2, a shard's audit:
    its vectors, its beam (0: scanned), its audited queries and their recall."""
    spark = rows.sparkSession
    real = rows.where("same IS NOT NULL")
    # The node's name: 63 bits of label and digest; the whole digest decides what collapses.
    reps = durable(real.groupBy("label", "same").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("unit").alias("unit")).withColumn("node", F.shiftrightunsigned(F.xxhash64("label", "same"), 1)), "vectors")
    shards = reps.groupBy("label", F.length("unit").alias("size")).agg(F.expr(f"count(1) div {SHARD} + 1").alias("shards"), F.expr(f"count(1) div {POOL} + 1").alias("pools"))
    held = reps.withColumn("size", F.length("unit")).join(shards, ["label", "size"])
    members = held.select("label", "size", F.pmod("node", "shards").alias("shard"), F.lit(0).alias("query"), "node", "n", "unit")
    asked_of = held.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    # About POOL queries from other shards come first: they are audited before they are answered.
    audited = (F.pmod("node", "shards") != F.col("shard")) & (F.pmod(F.xxhash64("node", "shard"), "pools") == 0)
    queries = asked_of.select("label", "size", "shard", F.when(audited, 1).otherwise(2).alias("query"), "node", "n", "unit")
    shape = arrow_schema(FOUND)

    def run(batches):
        for _, part in grouped_rows(batches, 3):
            nodes, counts, data, graph, find, comp, out, asked = [], [], [], None, None, None, [], []

            def answer():
                nonlocal find, comp
                if find is None:
                    outside = b"".join(u for q, _, u in asked if q == 1)
                    beam, recall, drawn = graph.beam(np.frombuffer(outside, np.float64).reshape(-1, graph.vectors.shape[1]))
                    out.append((2, len(nodes), beam, drawn, recall))
                    find = (lambda q: graph.search(q, beam)) if beam else graph.scan
                    own = find(graph.vectors)
                    comp = united(len(nodes), [(i, h[graph.vectors[h] @ graph.vectors[i] >= COSINE]) for i, h in enumerate(own)])
                found = find(np.frombuffer(b"".join(u for _, _, u in asked), np.float64).reshape(len(asked), -1))
                for (_, node, unit), hits in zip(asked, found, strict=True):
                    exact = graph.vectors[hits] @ np.frombuffer(unit, np.float64)
                    hits = hits[exact >= COSINE]
                    hits = hits[nodes[hits] != node]
                    if len(hits):
                        touched = np.unique(comp[hits])
                        out.extend((0, node, int(nodes[c]), 0, None) for c in touched if nodes[c] != node)
                        out.append((1, node, node, int(counts[hits].sum()), None))
                asked.clear()

            def emitted():
                batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)
                out.clear()
                return batch

            for query, node, n, unit in part:
                if not query:
                    nodes.append(node)
                    counts.append(n)
                    data.append(unit)
                    continue
                if graph is None:
                    if not nodes:
                        break
                    order = np.argsort(np.array(nodes), kind="stable")
                    nodes, counts = np.array(nodes, np.int64)[order], np.array(counts, np.int64)[order]
                    graph = Graph(np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)[order])
                    data = None
                asked.append((query, node, unit))
                # The audit waits for all of its queries.
                if len(asked) >= TOGETHER and query > 1:
                    answer()
                    if out:
                        yield emitted()
            if asked:
                answer()
            if out:
                yield emitted()

    small_batches(spark)
    found = members.unionByName(queries).repartition(shuffle_width(spark), "label", "size", "shard").sortWithinPartitions("label", "size", "shard", "query", "node").mapInArrow(run, FOUND)
    return reps, durable(found, "embedding-links")


def recalls(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vectors, beam, audited, recall) of every shard: its beam (0: scanned), the audited queries that have links, and the mean
    share of these links that the beam found."""
    _, found = shard_links(durable(units(df, key, vector, label), "units"))
    return found.where("kind = 2").select(F.col("node").alias("vectors"), F.col("other").alias("beam"), F.col("links").alias("audited"), "recall")


def near_embeddings(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component, kept) of every row."""
    rows = durable(units(df, key, vector, label), "units")
    reps, found = shard_links(rows)
    linked = found.where("kind = 1").groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.where("kind = 0").select(F.col("node").alias("a"), F.col("other").alias("b"))).select("node", "component")
    known = reps.join(linked, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = known.groupBy("component").agg(F.min("least").alias("smallest"))
    known = known.join(smallest, "component").select("label", "same", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "smallest")
    out = rows.select("id", "label", "same").join(known, ["label", "same"], "left")
    component = F.coalesce("smallest", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op9_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings against all of their label."""
    return near_embeddings(table(spark, sf_dir, "embeddings")).withColumnRenamed("component", "component_id")


#: Every pair of a label, then what each row reaches by links; rows are told apart by number, so repeated ones link.
OP9_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS MATERIALIZED (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (
  SELECT r, r AS seen FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.seen = links.a
), comp AS (
  SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.seen GROUP BY reach.r
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM v JOIN comp ON comp.r = v.r LEFT JOIN counted ON counted.a = v.r
"""
