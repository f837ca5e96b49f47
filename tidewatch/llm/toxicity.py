"""Toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, of words after the word before, each interpolated from four orders (Kneser and Ney, 1995).
Every order counts continuations, never occurrences: in how many different settings of the next larger one something is
seen. So copies of a text, and passages that texts share, add nothing, and an expression counts for the variety of its uses.

- The pair order counts the different words before a pair. It subtracts the discount from each count and gives what it
  took, the context's mass times discount x kinds / total, to the word order. Pairs with fewer than ``KEEP`` words before
  them, in both classes together, are cut off: all their mass goes to the word order.
- The word order counts the different words before a word, discounted likewise.
- The stem order (a stem is a word's first ``STEM`` characters) counts the different words of a stem, and spreads a stem's
  probability evenly over its words known to either class and one unknown: inflected and made-up forms meet there.
- The lowest order is one for both classes: in how many of them a stem is seen, discounted, and the rest spread evenly over
  all stems and one unknown. What one class alone has seen once or twice thus says little, whatever the sizes of the classes.

Each model's probabilities sum to one in every context.

Discounts are estimated from the numbers of counts of one and two, per class and order. A text's evidence is the
length-normalised log-likelihood ratio of the whole text, and that of its most telling word in its context (so that a long
text does not dilute a short insult); a logistic curve, fitted on labelled rows that the counts have not seen, makes
it a score.

The models are fitted on a bounded sample: at most ``FIT_ROWS`` documents and ``FIT_BYTES`` bytes of whole texts a class,
by hash of the id. The fitted model is of a bounded size and is broadcast; every text is scored whole. Null and empty
texts have no evidence and get the score of evidence zero. An id with several labels counts as toxic if one says so;
null ids and labels teach nothing; repeated rows are scored alike and teach once; an empty table gives no rows. Without rows
of both classes the score is the share of toxic rows, 0 if there are none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_durable, durable, map_columns, table

FIT_ROWS, FIT_BYTES, KEEP, STEM = 8000, 64 << 20, 6, 4
WORD = re.compile(r"\w+")
#: Words that a worker remembers the hash or the place of.
REMEMBER = 200_000
#: The context of a text's first word.
START = 0


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Hashes(dict):
    """Word -> 63-bit hashes of it and of its stem, remembered while there is room."""

    def __missing__(self, word: str) -> tuple[int, int]:
        found = hash_of(word), hash_of(word[:STEM])
        if len(self) < REMEMBER:
            self[word] = found
        return found


def sketch(text: str | None) -> int:
    """The smallest hash of the text's runs of five words: a MinHash of one component."""
    found = words(text)
    runs = (" ".join(found[k : k + 5]) for k in range(max(1, len(found) - 4)))
    return min(xxhash.xxh3_64_intdigest(r.encode("utf-8", "surrogatepass")) for r in runs) >> 1


def discount(ones: int, twos: int) -> float:
    """Ney's estimate; within bounds where a small sample has no counts of one or two."""
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


def estimate(count: np.ndarray) -> float:
    return discount(int((count == 1).sum()), int((count == 2).sum()))


@dataclass
class Counts:
    """words, stems: sorted hashes; stem: each word's place in stems. By class, a row each: follows (kinds of words before a
    word), total (of a word as a context), forms (kinds of words of a stem), count (kinds of words before a kept pair).
    first, second: the kept pairs' places in words. seen: discounts of the pair order."""

    words: np.ndarray
    stems: np.ndarray
    stem: np.ndarray
    follows: np.ndarray
    total: np.ndarray
    forms: np.ndarray
    first: np.ndarray
    second: np.ndarray
    count: np.ndarray
    seen: tuple[float, float]


class KneserNey:
    """One class's probabilities: of each word and of another word of each stem (the last: of any other stem), of what a
    context leaves to the words, and of the kept pairs."""

    def __init__(self, c: Counts, k: int):
        lowest = (c.forms > 0).sum(0).astype(float)
        d, kinds = estimate(lowest), (lowest > 0).sum()
        even = d * kinds / (kinds + 1) / lowest.sum()
        shared = np.where(lowest > 0, (lowest - d) / lowest.sum() + even, 0.0)
        stem, other = self.mixed(c.forms[k], shared, even)
        each = np.bincount(c.stem, (c.follows > 0).any(0), len(c.stems)) + 1
        word, left = self.mixed(c.follows[k], np.where((c.follows > 0).any(0), (stem / each)[c.stem], 0.0), 1.0)
        self.word, self.other = word, np.r_[left * stem / each, left * other]
        n, d = c.count[k].astype(float), c.seen[k]
        kept = np.where(n > 0, n - d, 0) / np.maximum(c.total[k], 1)[c.first]
        #: What the context leaves: its discounts and the pairs cut off; a context never seen leaves all.
        self.left = 1 - np.bincount(c.first, kept, len(c.words))
        self.pair = kept + self.left[c.first] * self.word[c.second]

    @staticmethod
    def mixed(count: np.ndarray, below: np.ndarray, rest: float) -> tuple[np.ndarray, float]:
        """The order of these counts over the order below; and what is left of ``rest``."""
        size, d = int(count.sum(dtype=np.int64)), estimate(count)
        left = d * (count > 0).sum() / size if size else 1.0
        return np.maximum(count - d, 0) / max(1, size) + left * below, left * rest


@dataclass
class Model:
    """Log-likelihood ratios, toxic over ordinary: by word, then by stem for its other words, the last for any other; of what
    contexts leave (0 for those); of pairs by their key."""

    words: np.ndarray
    stems: np.ndarray
    word: np.ndarray
    left: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray
    curve: tuple[float, ...] = field(default=(0.0, 1.0, 0.0))


def model_of(c: Counts) -> Model:
    ordinary, toxic = (KneserNey(c, k) for k in (0, 1))
    # A stem of words that are contexts only has no words; such a word begins texts and is never asked for as another.
    ratio = lambda a, b: np.where((a > 0) & (b > 0), np.log(np.where(a > 0, a, 1.0)) - np.log(np.where(b > 0, b, 1.0)), 0.0)
    word = np.r_[ratio(toxic.word, ordinary.word), ratio(toxic.other, ordinary.other)]
    left = np.r_[np.log(np.maximum(toxic.left, 1e-12)) - np.log(np.maximum(ordinary.left, 1e-12)), np.zeros(len(c.stems) + 1)]
    key = c.first * len(c.words) + c.second
    order = np.argsort(key)
    return Model(c.words, c.stems, word.astype(np.float32), left.astype(np.float32), key[order], np.log(toxic.pair / ordinary.pair)[order].astype(np.float32))


def hash_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


class Lookup(dict):
    """Word -> its place in the model: among the words, or behind them that of its stem, or the last."""

    def __init__(self, model: Model):
        super().__init__()
        self.words, self.stems = model.words, model.stems

    def __missing__(self, word: str) -> int:
        at = place_of(self.words, hash_of(word))
        if at == len(self.words):
            at += place_of(self.stems, hash_of(word[:STEM]))
        if len(self) < REMEMBER:
            self[word] = at
        return at


def place_of(names: np.ndarray, name: int) -> int:
    at = int(np.searchsorted(names, name))
    return at if at < len(names) and names[at] == name else len(names)


def evidence(text: str | None, lookup: Lookup, model: Model) -> list[float]:
    """Length-normalised log-likelihood ratios of the whole text and of its most telling word."""
    ids, n = np.fromiter(map(lookup.__getitem__, words(text)), np.int64), len(model.words)
    if not len(ids):
        return [0.0, 0.0]
    start = place_of(model.words, START)
    before = np.r_[start if start < n else len(model.left) - 1, ids[:-1]]
    each = (model.word[ids] + model.left[before]).astype(np.float64)
    if len(model.pairs):
        key = before * n + ids
        at = np.minimum(np.searchsorted(model.pairs, key), len(model.pairs) - 1)
        hit = (model.pairs[at] == key) & (before < n) & (ids < n)
        each[hit] = model.pair[at[hit]]
    return [float(each.mean()), float(each.max())]


def scores_of(texts: list[str | None], lookup: Lookup, model: Model) -> list[float]:
    x = np.array([[1.0, *evidence(t, lookup, model)] for t in texts]).reshape(len(texts), -1)
    return (1 / (1 + np.exp(-np.clip(x @ np.array(model.curve), -40, 40)))).tolist() if texts else []


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    a = np.c_[np.ones(len(x)), x]
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(b)), a.T @ (y - p) - ridge * b)
        b += step
        if abs(step).max() < 1e-6:
            break
    return tuple(b.tolist())


def sampled(docs: DataFrame, labels: DataFrame, teaches=None, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> tuple[list[tuple[int, int]], list[int]]:
    """(doc_id, toxic) of the sample: by hash of the id, ids whose documents still fit ``rows`` and ``size`` of their class; and
    the labelled documents of each class."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if teaches is not None:
        marks = marks.where(teaches)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).join(marks, "doc_id")
    sizes = durable(sizes.groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).withColumn("h", F.xxhash64("doc_id")), "toxicity-sizes")
    total = {r["toxic"]: r["n"] for r in sizes.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    out = []
    for k in (0, 1):
        left, room = rows, size
        for r in sizes.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(rows).collect():
            if r["n"] <= left and r["size"] <= room:
                left, room = left - r["n"], room - r["size"]
                out.append((r["doc_id"], k))
    drop_durable(sizes)
    return out, [total.get(k, 0) for k in (0, 1)]


def counted(texts: DataFrame) -> Counts:
    """The counts of texts (toxic, text). Only words, stems and kept pairs reach the driver."""

    def make():
        memo = Hashes()

        def uses(toxic, texts):
            out = []
            for k, t in zip(toxic, texts, strict=True):
                found = words(t)
                if found:
                    ids = np.array([memo[w] for w in found], np.int64)
                    before = np.r_[START, START, ids[:, 0]]
                    out.append(np.unique(np.c_[np.full(len(ids), k), before[:-2], before[1:-1], ids], axis=0))
            flat = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
            return [flat[:, 0].astype(np.int32), *flat[:, 1:].T.copy()]

        return uses

    by_class = lambda what, name: [F.count_if(what(k)).alias(f"{name}{k}") for k in (0, 1)]
    uses = map_columns(texts, make, "k int, u long, v long, w long, stem long").distinct()
    pairs = durable(uses.groupBy("v", "w", "stem").agg(*by_class(lambda k: F.col("k") == k, "c")), "toxicity-pairs")
    follows = pairs.groupBy("w", "stem").agg(*by_class(lambda k: F.col(f"c{k}") > 0, "f"))
    after = pairs.groupBy(F.col("v").alias("w")).agg(*(F.sum(f"c{k}").alias(f"t{k}") for k in (0, 1)))
    small = lambda names: [F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in names]
    alone = follows.join(after, "w", "full").select("w", F.coalesce("stem", F.lit(START)).alias("stem"), *small(["f0", "f1", "t0", "t1"])).toArrow()
    few = pairs.agg(*(F.count_if(F.col(f"c{k}") == n) for k in (0, 1) for n in (1, 2))).first()
    kept = pairs.where(F.col("c0") + F.col("c1") >= KEEP).select("v", "w", *small(["c0", "c1"])).toArrow()
    drop_durable(pairs)
    column = lambda table, name: table.column(name).to_numpy()
    order = np.argsort(column(alone, "w"))
    names, by_word = column(alone, "w")[order], lambda name: np.stack([column(alone, name + k)[order] for k in "01"])
    stems, stem = np.unique(column(alone, "stem")[order], return_inverse=True)
    follows, total = by_word("f"), by_word("t")
    del alone, order
    forms = np.stack([np.bincount(stem, f > 0, len(stems)).astype(np.int64) for f in follows])
    first, second = (np.searchsorted(names, column(kept, c)) for c in "vw")
    count = np.stack([column(kept, "c" + k) for k in "01"])
    return Counts(names, stems, stem, follows, total, forms, first, second, count, (discount(*few[:2]), discount(*few[2:])))


def fitted(docs: DataFrame, labels: DataFrame, teaches=None, rows: int = FIT_ROWS) -> Model | float:
    """The model of documents (doc_id, text) and labels (doc_id, toxic); ``teaches``: a condition on doc_id. Four fifths
    of the sample make the counts, one fifth the curve."""
    sample, labelled = sampled(docs, labels, teaches, rows)
    if len({k for _, k in sample}) < 2:
        return float(np.mean([k for _, k in sample])) if sample else 0.0
    spark = docs.sparkSession
    # At most 2 x rows ids: the bound of the sample is what makes this side small enough to broadcast.
    held = spark.createDataFrame(sample, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int")
    found = docs.select("doc_id", "text").join(F.broadcast(held), "doc_id")

    # Near copies mostly share their sketch and so are never on both sides of the split.
    texts = durable(map_columns(found.select("toxic", "text"), lambda: lambda toxic, texts: [toxic, [sketch(t) for t in texts], texts], "toxic int, sketch long, text string"), "toxicity-sample")
    folded = texts.withColumn("fold", F.pmod(F.xxhash64("sketch"), F.lit(5)))
    model = model_of(counted(folded.where("fold > 0").select("toxic", "text")))
    sent = spark.sparkContext.broadcast(model)

    def make():
        lookup = Lookup(sent.value)
        return lambda toxic, texts: [toxic, [evidence(t, lookup, sent.value) for t in texts]]

    curve = map_columns(folded.where("fold = 0").select("toxic", "text"), make, "toxic int, x array<double>").toPandas()
    drop_durable(texts)
    if curve.toxic.nunique() == 2:
        y = curve.toxic.to_numpy().astype(float)
        base, *slopes = logistic(np.stack(curve.x), y)
        # The classes are sampled at different rates: the odds are moved to those of all labelled documents.
        model.curve = (base + float(np.log(labelled[1] / labelled[0]) - np.log(y.sum() / (1 - y).sum())), *slopes)
    return model


def toxicity_scores(df: DataFrame, model: Model | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row: the probability of label 1."""
    if not isinstance(model, Model):
        return df.select(key, F.lit(float(model)).alias("score"))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        lookup = Lookup(sent.value)
        return lambda keys, texts: [keys, scores_of(texts, lookup, sent.value)]

    return map_columns(df.select(key, text), make, f"`{key}` {dict(df.dtypes)[key]}, score double")


def fold_of(key: str = "doc_id"):
    """crc32 of the id as text, mod 5; a null id has none and is not held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; labels whose fold is 0 teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"), fold_of() != 0)
    scored = toxicity_scores(docs, model)
    return scored.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
