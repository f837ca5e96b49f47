"""A corpus pipeline over ``documents``: toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the next stage reads its output as
Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import minhash_dedup, packing, secret_scan, toxicity
from tidewatch.llm.common import durable, hot_join, in_slots, map_columns, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half. All labels teach; the model is fitted on the documents of this stage. Null and
    empty texts have no evidence and get the score of evidence zero; without labels of both classes nothing is dropped."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    if not isinstance(model, toxicity.Model):
        return docs.select(*COLUMNS)
    sent = spark.sparkContext.broadcast(model)

    def make():
        lookup = toxicity.Lookup(sent.value)

        def keep(*columns):
            scores = toxicity.scores_of(columns[1], lookup, sent.value)
            return [[x for x, s in zip(c, scores, strict=True) if s < 0.5] for c in columns]

        return keep

    return map_columns(docs.select(*COLUMNS), make, docs.select(*COLUMNS)._jdf.schema().toDDL())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the first by doc_id; of rows equal in doc_id and words, one. Documents
    without words, null texts among them, have no class and all stay."""
    name = F.concat("same", F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "UTF-8"))
    # Only what is not a single first row is told to the documents.
    found = minhash_dedup.near_classes(docs.select("doc_id", "text")).where("same IS NOT NULL AND (NOT lead OR n > 1)")
    found = durable(found.select("doc_id", name.alias("name"), "n", "lead"), "pipeline-classes")
    schema = docs.select(*COLUMNS)._jdf.schema().toDDL()

    def make():
        inner = minhash_dedup._digests()

        def run(*columns):
            return [*columns, inner(columns[0], columns[1])[1]]

        return run

    # Texts are moved, and once, only where their doc_id may be found; all others stay as they are.
    asked, others = in_slots(docs.select(*COLUMNS), found, "doc_id")
    marked = map_columns(asked, make, f"{schema}, same binary").withColumn("name", name)
    flagged = hot_join(marked, found.select("name", "lead", F.col("n").alias("weight")), "name", "weight", docs.count(), "left")
    flagged = durable(flagged.where("lead IS NULL OR lead").select(*COLUMNS, "name", "lead"), "pipeline-flagged")
    one = flagged.where("lead").groupBy("name").agg(F.min(F.struct(*COLUMNS)).alias("r"))
    return others.unionByName(flagged.where("lead IS NULL").select(*COLUMNS)).unionByName(one.select("r.*"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret found replaced by a mark of its kind and n_chars following the new text. Texts without
    secrets, null and empty ones among them, are as they were."""

    def mask(ids, texts, langs, sources, sizes):
        new = [secret_scan.masked(t) for t in texts]
        return [ids, new, langs, sources, [n if a == t else len(a) for a, t, n in zip(new, texts, sizes, strict=True)]]

    return map_columns(docs.select(*COLUMNS), lambda: mask, docs.select(*COLUMNS)._jdf.schema().toDDL())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; null and empty texts have their closing id."""
    return packing.packed_pieces(docs.select("doc_id", "text"), packing.vocabulary_path()).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Tokens, trained models and signatures are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
