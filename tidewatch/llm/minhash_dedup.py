"""Near-duplicates by weighted MinHash (BagMinHash; Ertl, 2018) over multisets of five-word shingles.

Two texts are near-duplicates if the weighted Jaccard similarity of their multisets of runs of five words (split at
white space, lower-cased; a shorter text is one run) is ``SIMILARITY`` or more: shared occurrences over all occurrences.

Signatures. A shingle with count w stands for the interval [0, w) of a Poisson process in time and weight. The weight
axis is split hierarchically at powers of two; every block's points come from a generator seeded by shingle and block, so
two texts see the same points wherever their intervals overlap, and a point beyond w is discarded. Each point falls on a
random component, which keeps its earliest point; the chance that a component agrees is the weighted Jaccard similarity.
Time is bounded so that the work after the first arrival of each block is small, and doubled until no component is open.

Candidates share one of ``BANDS`` bands of ``ROWS`` components: a pair at 0.8 is missed with chance 5e-5. Every
candidate whose signatures agree well enough (at least ``LIKELY``: 4 standard deviations under 0.8) is decided on the
texts' exact multisets, unless its two texts are in one component already. So: equal word sequences collapse first; then
each text is compared with its two likeliest of the bucket's first texts and neighbours, verified links give
components; then every remaining likely pair across components is decided, bucket by bucket, in cells bounded in texts and in
words. No pairs within a component are listed and no bucket is capped. A bucket of n different texts that stay unlinked
sends each text's signature to about n / ``PART`` cells.

Null texts and texts without words have no shingles, link with nothing and stay. Repeated rows are equal texts, of which one
stays. The class id is the smallest doc_id of the class; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, durable, grouped_rows, hot_join, in_slots, map_columns, repeated, shuffle_width, small_batches, table
from .components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 26, 5
SIZE = BANDS * ROWS
#: Agreement of signatures (of one byte a component, so 1/256 by chance) below which a candidate is not decided exactly.
LIKELY = 0.65
#: Members that are compared with each other in the first round, and about the most members of a bucket in a part of it.
BLOCK, NEAR_PART = 128, 256
#: About the most members, and words, of a side of a cell in the second round.
PART, PART_WORDS = 1024, 1 << 20
#: Texts that are signed together.
SIGN_AT = 256
#: Pairs that one task compares with one text.
SPREAD = 512
U = np.uint64


class WordHash(dict):
    """Word -> 64-bit hash, remembered while there is room."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 300_000:
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str | None, memo: WordHash) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, (text or "").lower().split()), U)


def shingles(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their counts."""
    if not len(hashes):
        return np.zeros(0, U), np.zeros(0, np.int64)
    n = min(WORDS, len(hashes))
    out = np.zeros(len(hashes) - n + 1, U)
    for k in range(n):
        out = mixed(out * U(3) + hashes[k : len(hashes) - n + 1 + k] + U(0x9E3779B97F4A7C15))
    keys, counts = np.unique(out, return_counts=True)
    return keys, counts


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """The components' hashes (uint64), a row a bag: what was drawn for the earliest point of each. No bag is empty."""
    keys, counts = (np.concatenate([b[k] for b in bags]) for k in (0, 1))
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    top = np.ceil(np.log2(counts)).astype(np.int64)  # block 0 is [0, 1), block j >= 1 is [2^(j-1), 2^j)
    parts = [(keys, np.zeros(len(keys)), np.ones(len(keys)), counts, owner)]
    for j in range(1, int(top.max()) + 1):
        own = np.flatnonzero(top >= j)
        low = np.full(len(own), 2.0 ** (j - 1))
        parts.append((mixed(keys[own] + U(j * 0xD1342543DE82EF95 % 2**64)), low, low, counts[own], owner[own]))
    seed, low, width, weight, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    unit = lambda x: ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
    limit = size * (np.log(size) + 4) / np.bincount(owner, np.where(low == 0, weight, 0), len(bags))
    out, open_bags = np.zeros((len(bags), size), U), np.ones(len(bags), bool)
    while open_bags.any():
        live = np.flatnonzero(open_bags[owner])
        state, time, slots, times, draws = seed[live], np.zeros(len(live)), [], [], []
        while len(live):
            state = mixed(state + U(0x9E3779B97F4A7C15))
            time = time - np.log(unit(state)) / width[live]
            keep = time <= limit[owner[live]]
            state, time, live = state[keep], time[keep], live[keep]
            draw = mixed(state ^ U(0xA0761D6478BD642F))
            inside = low[live] + unit(mixed(draw + U(1))) * width[live] < weight[live]
            slots.append(owner[live[inside]] * size + (draw[inside] % U(size)).astype(np.int64))
            times.append(time[inside])
            draws.append(mixed(draw[inside]))
        slots, times, draws = (np.concatenate(x) for x in (slots, times, draws))
        best = np.full(len(bags) * size, np.inf)
        np.minimum.at(best, slots, times)
        won = times == best[slots]
        out.reshape(-1)[slots[won]] = draws[won]
        open_bags &= ~np.isfinite(best.reshape(len(bags), size)).all(1)
        limit = np.where(open_bags, limit * 1.5, limit)
    return out


def signature(keys: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    return signatures([(keys, counts)], size)[0]


def bands_of(marks: np.ndarray) -> np.ndarray:
    """A row of BANDS hashes for each row of components."""
    out = np.repeat((np.arange(BANDS).astype(U) * U(0x9E3779B97F4A7C15))[None], len(marks), 0)
    for k in range(ROWS):
        out = mixed(out * U(5) + marks.reshape(len(marks), BANDS, ROWS)[:, :, k])
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets with sorted keys; 0 if both are empty."""
    at = np.searchsorted(b[0], a[0])
    if not len(b[0]) or not len(a[0]):
        return 0.0
    at = np.minimum(at, len(b[0]) - 1)
    same = b[0][at] == a[0]
    shared = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, same, words, bands, sig) of each row: a 128-bit digest of the words (null: no words), their number, the bands and
    one byte a component."""

    def make():
        memo = WordHash()

        def run(keys, texts):
            hashes = [word_hashes(t, memo) for t in texts]
            same = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in hashes]
            first = {d: k for k, d in reversed(list(enumerate(same))) if d}
            # Short texts take many steps of few points: texts of about one length are signed together.
            names, made = sorted(first, key=lambda d: len(hashes[first[d]])), {}
            for start in range(0, len(names), SIGN_AT):
                own = names[start : start + SIGN_AT]
                marks = signatures([shingles(hashes[first[d]]) for d in own])
                for d, bands, mark in zip(own, bands_of(marks).astype("<u8"), (marks & U(255)).astype(np.uint8), strict=True):
                    made[d] = bands.tobytes(), mark.tobytes()
            return [keys, same, [len(h) for h in hashes], *([d and made[d][k] for d in same] for k in (0, 1))]

        return run

    return map_columns(df.select(key, text), make, f"`{key}` {dict(df.dtypes)[key]}, same binary, words long, bands binary, sig binary")


def buckets(texts: DataFrame) -> DataFrame:
    """(band, id, sig, words, n, first) of every text in every bucket of n >= 2 members; first: the bucket's smallest id."""

    def split(ids, bands):
        flat = [np.frombuffer(b, "<u8").view("<i8") for b in bands]
        return [pa.array(np.concatenate(flat)) if flat else [], pa.array(np.repeat(np.array(ids, np.int64), BANDS))]

    keyed = durable(map_columns(texts.select("id", "bands"), lambda: split, "band long, id long"), "bands")
    several = durable(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1").withColumn("weight", F.col("n")), "several")
    joined = hot_join(keyed, several, "band", "weight", keyed.count())
    return joined.join(texts.select("id", "sig", "words"), "id").select("band", "id", "sig", "words", "n", "first")


def _signatures(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, SIZE)


def _stream(df: DataFrame, by: list[str], rows_of, schema: str) -> DataFrame:
    """rows_of(key, columns of one group) -> list of rows, for groups of bounded size; rows are passed on as they gather."""
    shape, columns = arrow_schema(schema), [c for c in df.columns if c not in by]

    def run(batches):
        out: list = []
        for key, rows in grouped_rows(batches, len(by)):
            out += rows_of(key, list(zip(*rows, strict=True)))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    small_batches(df.sparkSession)
    return df.select(*by, *columns).repartition(shuffle_width(df.sparkSession), *by).sortWithinPartitions(*by, *columns[:2]).mapInArrow(run, schema)


def _near(columns: list[tuple]) -> dict:
    """First round in one part of a bucket: all with the bucket's first, and each with its likeliest before it in its block."""
    ids, sigs, pairs = np.array(columns[0], np.int64), _signatures(columns[1]), {}
    like = (sigs == sigs[0]).mean(1)
    pairs.update({(int(ids[0]), int(x)): float(v) for x, v in zip(ids[1:], like[1:], strict=True) if v >= LIKELY})
    for start in range(0, len(ids), BLOCK):
        own = ids[start : start + BLOCK]
        like = np.tril((sigs[start : start + BLOCK, None, :] == sigs[None, start : start + BLOCK, :]).mean(2), -1)
        best = like.argmax(1)
        pairs.update({(int(own[j]), int(own[i])): float(like[i, j]) for i, j in enumerate(best) if like[i, j] >= LIKELY})
    return pairs


def near_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b, at most two a for each b: enough to find most links; the second round compares all that is left. A
    bucket is dealt in parts of about NEAR_PART members, each with the bucket's first (the smallest id) added."""
    part = F.pmod(F.xxhash64("id"), F.expr(f"n div {NEAR_PART} + 1"))
    dealt = members.where("id <> first").select("band", part.alias("part"), "id", "sig")
    heads = members.where("id = first").select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {NEAR_PART}"))).alias("part"), "id", "sig")
    pairs = lambda _, columns: [(*ab, v) for ab, v in _near(columns).items()]
    found = _stream(dealt.unionByName(heads), ["band", "part"], pairs, "a long, b long, likeness double").distinct()
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("likeness"), "a"))
    return found.withColumn("rank", best).where("rank <= 2").select("a", "b")


def _involved(columns: list[tuple]) -> list[int]:
    """The members of a cell that have a likely partner of another component: side 0 with side 1, and within side 0 where
    the cell says so."""
    sides, ids, comps, within = (np.array(columns[k], np.int64) for k in (0, 1, 3, 4))
    sigs, hit = _signatures(columns[2]), np.zeros(len(ids), bool)
    for i in np.flatnonzero(sides == 0):
        against = np.flatnonzero((comps != comps[i]) & ((sides == 1) | (within[i] == 1)))
        likely = against[(sigs[against] == sigs[i]).mean(1) >= LIKELY]
        hit[likely] = True
        hit[i] |= len(likely) > 0
    return np.flatnonzero(hit).tolist()


def _cell_links(rows: list[tuple], memo: WordHash) -> list[tuple[int, int]]:
    """Links that join different components in a cell of (side, id, component, within, text).

    Candidates come from prefixes: with tokens ordered by their frequency in the cell, two bags that share SIMILARITY of
    their weight share a token among the rarest ones that make up the rest, so a text with many words of its own meets
    nobody. Each candidate is decided exactly, unless an earlier link has joined its component already.
    """
    sides, ids, comps, within = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2, 3))
    bags = [shingles(word_hashes(r[4], memo)) for r in rows]
    weight = np.array([int(n.sum()) for _, n in bags])
    owner = np.repeat(np.arange(len(bags)), [len(k) for k, _ in bags])
    tokens, at, often = np.unique(np.concatenate([k for k, _ in bags]), return_inverse=True, return_counts=True)
    del tokens
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    token, counts = rank[at], np.concatenate([n for _, n in bags])
    order = np.lexsort((token, owner))
    token, counts, owner = token[order], counts[order], owner[order]
    before = np.cumsum(counts) - counts
    before -= before[np.searchsorted(owner, owner)]
    # A token counts as prefix while what follows it, itself included, could hold all of the needed overlap.
    prefix = weight[owner] - before >= np.ceil(SIMILARITY * weight[owner] - 1e-9)
    p_token, p_owner = token[prefix], owner[prefix]
    by_owner = np.searchsorted(p_owner, np.arange(len(bags) + 1))
    order = np.argsort(p_token, kind="stable")
    i_token, i_owner = p_token[order], p_owner[order]
    links = []
    for x in np.flatnonzero(sides == 0):
        own = p_token[by_owner[x] : by_owner[x + 1]]
        low, high = np.searchsorted(i_token, own), np.searchsorted(i_token, own, side="right")
        found = np.unique(np.concatenate([i_owner[a:b] for a, b in zip(low, high, strict=True)])) if len(own) else own
        size_fits = np.minimum(weight[found], weight[x]) >= SIMILARITY * np.maximum(weight[found], weight[x]) - 1e-9
        found = found[size_fits & ((sides[found] == 1) | ((within[x] == 1) & (found > x)))]
        for y in found.tolist():
            if comps[x] != comps[y] and similarity(bags[x], bags[y]) >= SIMILARITY:
                links.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
                comps[comps == comps[y]] = comps[x]
    return links


def far_links(members: DataFrame, comps: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links (a, b) that join components: in every bucket all likely pairs of different components are decided. No pairs
    are listed: members with a likely partner carry their text to their cell, and the cell gives the links that it needs."""
    cells = far_cells(members, comps)
    by = ["band", "i", "j", "others"]
    pick = lambda key, columns: [(*key, *(columns[c][k] for c in (0, 1, 3, 4))) for k in _involved(columns)]
    wanted = _stream(cells, by, pick, "band long, i long, j long, others boolean, side int, id long, component long, within int")
    carried = wanted.join(bodies.select("id", "text"), "id").select(*by, "side", "id", "component", "within", "text")
    shape = arrow_schema("a long, b long")

    def run(batches):
        memo = WordHash()
        for _, rows in grouped_rows(batches, len(by)):
            links = _cell_links(list(rows), memo)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], schema=shape)

    return carried.repartition(shuffle_width(members.sparkSession), *by).sortWithinPartitions(*by, "side", "id").mapInArrow(run, "a long, b long")


def far_cells(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Cells (band, i, j, others) of (side, id, sig, component, within) for the second round. The members of a bucket's largest component are
    one side, all others the other; both are dealt in blocks of about PART, and every pair of blocks that holds pairs of
    different components is one cell. Members of the largest component are never compared with each other."""
    placed = lambda rows: rows.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed(members.select("band", "id", "words")).groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    mixed_bands = sizes.groupBy("band").agg(F.max(F.struct("n", "component", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    parts = lambda n, w: F.expr(f"greatest({n} div {PART}, {w} div {PART_WORDS}) + 1")
    mixed_bands = mixed_bands.select("band", F.col("top.component").alias("main"), parts("top.n", "top.w").alias("gm"), parts("(n - top.n)", "(w - top.w)").alias("go"), F.col("n").alias("weight"))
    mixed = hot_join(members.select("band", "id", "sig"), durable(mixed_bands, "mixed-bands"), "band", "weight", members.count())
    held = placed(mixed).withColumn("is_main", F.col("component") == F.col("main"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    block = F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("gm")).otherwise(F.col("go")))
    held = held.withColumn("block", block)
    columns = ["id", "sig", "component"]
    main = held.where("is_main").select("band", F.explode(upto(F.col("go"))).alias("i"), F.col("block").alias("j"), F.lit(False).alias("others"), F.lit(1).alias("side"), *columns, F.lit(0).alias("within"))
    other = held.where("not is_main").select("*", F.explode(upto(F.col("gm"))).alias("k"))
    with_main = other.select("band", F.col("block").alias("i"), F.col("k").alias("j"), F.lit(False).alias("others"), F.lit(0).alias("side"), *columns, (F.col("k") == 0).cast("int").alias("within"))
    several = held.where("not is_main and go > 1").select("*", F.explode(upto(F.col("go"))).alias("k")).where("k <> block")
    with_others = several.select("band", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), F.lit(True).alias("others"), (F.col("block") > F.col("k")).cast("int").alias("side"), *columns, F.lit(0).alias("within"))
    cells = main.unionByName(with_main).unionByName(with_others)
    return cells.select("band", "i", "j", "others", "side", *columns, "within")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity is enough. Each pair goes to the one of its texts with more pairs; that text
    travels once for every ``SPREAD`` of them, the other text once a pair."""
    shape = arrow_schema("a long, b long")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.join(degree.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    a_leads = F.col("na") >= F.col("nb")
    dealt = both.select(F.when(a_leads, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(a_leads, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("na", "nb").alias("n"))
    salt = F.pmod(F.xxhash64("other"), F.expr(f"(n div {SPREAD}) + 1"))
    dealt = dealt.select("hub", "other", salt.alias("salt"))
    hubs = dealt.select("hub", "salt").distinct().join(texts.select(F.col("id").alias("hub"), "text"), "hub").select("hub", "salt", F.lit(-1).cast("long").alias("other"), "text")
    others = dealt.join(texts.select(F.col("id").alias("other"), "text"), "other").select("hub", "salt", "other", "text")

    def run(batches):
        memo = WordHash()
        for (hub, _), rows in grouped_rows(batches, 2):
            own, hits = None, []
            for other, text in rows:
                bag = shingles(word_hashes(text, memo))
                if other < 0:
                    own = bag
                elif similarity(own, bag) >= SIMILARITY:
                    hits.append(other)
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array([min(hub, x) for x in hits], pa.int64()), pa.array([max(hub, x) for x in hits], pa.int64())], schema=shape)

    small_batches(pairs.sparkSession)
    rows = hubs.unionByName(others).repartition(shuffle_width(pairs.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "other")
    return rows.mapInArrow(run, "a long, b long")


def near_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, same, n, component, lead) of every distinct key and digest of words: its number of rows, the smallest key of
    its class (its own where it has no words) and whether it is the class's first by (key, digest). Keys are integers; a
    null key is a class's first only where all its keys are null, and the class then has a null id."""
    rows = durable(signed(df.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)), key, text), "bags")
    named = rows.where(F.col("same").isNotNull()).groupBy("same").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("weight"), F.first("words").alias("words"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # 63 bits of the digest name a text; the whole digest decides equality.
    texts = durable(named.withColumn("id", F.shiftrightunsigned(F.xxhash64("same"), 1)), "texts")
    members = durable(buckets(texts), "buckets")
    # Only texts with a candidate travel: one row of each, by key and digest of its words.
    near = durable(near_pairs(members), "near")
    wanted = members.select("id").distinct().join(texts.select("id", "least", "same"), "id")
    source = df.select(F.col(key).cast("long").alias("least"), F.col(text).alias("text"))
    keyed = map_columns(in_slots(source.where("least IS NOT NULL"), wanted, "least")[0], _digests, "least long, same binary, text string")
    # Texts that occur only under null keys are found by their words.
    unkeyed = map_columns(source.where("least IS NULL"), _digests, "least long, same binary, text string")
    found = keyed.join(wanted, ["least", "same"]).select("id", "text").unionByName(unkeyed.join(wanted.where("least IS NULL").select("id", "same"), "same").select("id", "text"))
    bodies = durable(found.groupBy("id").agg(F.first("text").alias("text")), "bodies")
    links = durable(verified(near, bodies), "links")
    comps = components(links).select(F.col("node").alias("id"), "component")
    links = links.unionByName(durable(far_links(members, comps, bodies), "far"))
    comps = components(links).select(F.col("node").alias("id"), "component")
    classes = texts.select("id", "same", "least", "weight").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lead = classes.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("unkeyed"), "least", "same")).alias("lead"))
    classes = durable(classes.join(lead, "component").select("same", "weight", F.col("lead.least").alias("_lead"), F.col("lead.same").alias("_lead_same")), "classes")
    counted = rows.groupBy(key, "same").agg(F.count(F.lit(1)).alias("n"))
    counted = durable(counted, "counted")
    classed = hot_join(counted.where("same IS NOT NULL"), classes, "same", "weight", rows.count())
    out = classed.unionByName(counted.where("same IS NULL"), allowMissingColumns=True)
    first = F.col("same").isNull() | (F.col(key).eqNullSafe(F.col("_lead")) & F.col("same").eqNullSafe(F.col("_lead_same")))
    return out.select(key, "same", "n", F.when(F.col("same").isNull(), F.col(key)).otherwise(F.col("_lead")).alias("component"), first.alias("lead"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, same, component, first) of every row: the digest of its words, the smallest key of its class and whether it is the
    one row of its class that stays; of rows equal in key and words one is. Rows without words all stay."""
    each = repeated(near_classes(df, key, text), "n", "_i")
    return each.select(key, "same", "component", (F.col("lead") & (F.col("same").isNull() | (F.col("_i") == 0))).alias("first"))


def _digests():
    memo = WordHash()

    def run(keys, texts):
        hashes = [word_hashes(t, memo) for t in texts]
        return [keys, [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in hashes], texts]

    return run


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class: the smallest doc_id of its near-duplicates, and whether it is the one to keep."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("component").alias("component_id"), F.col("first").alias("kept"))


#: Every pair that shares a shingle, decided exactly, then what each row reaches by links. The white space of the class is
#: that of Python's split().
OP10_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x09-\x0D\x1C-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT r, unnest(list_transform(range(1, len(w) - least({WORDS}, len(w)) + 2), lambda i: list_aggregate(w[i:i + {WORDS} - 1], 'string_agg', ' '))) AS shingle FROM d WHERE len(w) > 0
), bags AS MATERIALIZED (
  SELECT r, shingle, count(*) AS c FROM s GROUP BY r, shingle
), sizes AS MATERIALIZED (
  SELECT r, sum(c) AS n FROM bags GROUP BY r
), shared AS (
  SELECT a.r AS a, b.r AS b, sum(least(a.c, b.c)) AS n FROM bags a JOIN bags b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY a.r, b.r
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE shared.n >= {SIMILARITY} * (x.n + y.n - shared.n)
), reach AS (
  SELECT r, r AS seen FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.seen = links.a
), comp AS (
  SELECT reach.r, min(reach.seen) AS class, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.seen GROUP BY reach.r
)
SELECT doc_id, component_id, row_number() OVER (PARTITION BY class ORDER BY doc_id NULLS LAST) = 1 AS kept FROM d JOIN comp ON comp.r = d.r
"""
