"""URL filters by a sort-merge range join, in DataFrame functions only.

Two sorted sweeps, over hosts and over paths. A host's labels, reversed and each closed by the separator, make a canonical
key, so that a rule's host and all its subdomains are one interval of keys, and the intervals of two hosts are nested or
apart; so are those of two path prefixes of one host, as bytes. Every interval's ends become breakpoints. In the first
sweep a breakpoint carries the stack of the rule hosts active from there on, at most one a label of the host; a running
last value hands each URL the stack at its key. Then a URL meets each host of its stack, and in the second sweep a
breakpoint carries the innermost rule of that host active from there on: the rule itself at its start, the next shorter
prefix's at its end. So a host may have any number of path rules, and none is looked at but the one that fits best; the
longest over the stack wins.

A sweep is a window per top-level label, or per rule host, and salt: one with many of the URLs is dealt over salts in
proportion to them, and its breakpoints, as few as its rules, are repeated for each. Those with many are fewer than
four times the shuffle partitions, which bounds their broadcast. Only host, path and id are sorted; html is never read.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path follows up to ``?``,
``#`` or the end. A null URL or one without ``://`` has both empty and no rule. The longest rule is the one with most
characters of host and path, then of host; of equal rules with two actions ``block`` wins. Rules with a null part fit
nothing. Repeated rows are judged each; an empty table gives no rows; without a rule the verdict is ``DEFAULT``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import repeated, shuffle_width, table

DEFAULT = "allow"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Closes a label in a key; what follows it in order ends the interval. Both are escaped inside labels.
SEP, AFTER = "\u0000", "\u0001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """The labels from the top, each escaped and closed by SEP."""
    safe = F.replace(F.replace(host, F.lit("\u0001"), F.lit("\u0001\u0002")), F.lit(SEP), F.lit("\u0001\u0003"))
    return F.concat(F.array_join(F.reverse(F.split(safe, r"\.")), SEP), F.lit(SEP))


def top_of(key: Column) -> Column:
    return F.substring_index(key, SEP, 1)


#: What every key of bytes that starts as a prefix does is under: no UTF-8 text holds this byte.
LAST = "X'FF'"


def host_breakpoints(rules: DataFrame) -> DataFrame:
    """(key, stack) of each end of each rule host's interval; stack: the keys of the rule hosts active from there on."""
    hosts = rules.select("key").distinct()
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), SEP)
    around = hosts.select("key", F.posexplode(labels).alias("n", "label"), labels.alias("parts")).select("key", F.concat(F.array_join(F.expr("slice(parts, 1, n + 1)"), SEP), F.lit(SEP)).alias("outer"))
    active = around.join(hosts.withColumnRenamed("key", "outer"), "outer").groupBy("key").agg(F.collect_list("outer").alias("stack"))
    ends = active.select(F.expr("concat(substring(key, 1, length(key) - 1), '\u0001')").alias("key"), F.array_remove("stack", F.col("key")).alias("stack"))
    return active.select("key", "stack").unionByName(ends)


def path_breakpoints(rules: DataFrame) -> DataFrame:
    """(outer, at, won) of each end of the interval of each rule's path, for the rule host with the key ``outer``; won: the
    innermost rule active from there on, null where none is."""
    won = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "action")
    # Rules that end where a shorter one goes on: a path's longest proper prefix that is a rule's path of the host.
    held = rules.select("key", "path", won.alias("won"))
    shorter = held.select("key", "path", F.explode(F.expr("CASE WHEN length(path) > 0 THEN sequence(0, length(path) - 1) ELSE array() END")).alias("n"))
    shorter = shorter.select("key", "path", F.expr("substring(path, 1, n)").alias("prefix"))
    inner = shorter.join(held.select("key", F.col("path").alias("prefix"), F.col("won").alias("outside")), ["key", "prefix"]).groupBy("key", "path").agg(F.max("outside").alias("outside"))
    ends = held.select("key", "path").join(inner, ["key", "path"], "left").select(F.col("key").alias("outer"), F.concat(F.encode("path", "UTF-8"), F.expr(LAST)).alias("at"), F.col("outside").alias("won"))
    return held.select(F.col("key").alias("outer"), F.encode("path", "UTF-8").alias("at"), "won").unionByName(ends)


def salted(rows: DataFrame, marks: DataFrame, by: str, total: int) -> tuple[DataFrame, DataFrame]:
    """rows and marks with a salt within ``by``: groups with many of the ``total`` rows are dealt over salts, and their marks
    repeated for each of these."""
    part = max(1, total // (4 * shuffle_width(rows.sparkSession)))
    many = F.broadcast(rows.groupBy(by).agg(F.expr(f"count(1) div {part}").alias("_n")).where("_n > 0"))
    width = F.coalesce("_n", F.lit(0)) + 1
    dealt = rows.join(many, by, "left").withColumn("salt", F.pmod(F.xxhash64("id", "host", "path"), width)).drop("_n")
    return dealt, marks.join(many, by, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), width - 1))).drop("_n")


def swept(rows: DataFrame, marks: DataFrame, by: str, at: str, value: str, total: int) -> DataFrame:
    """rows with ``value`` of the last of the marks at or before ``at``, within ``by``."""
    dealt, ends = salted(rows, marks, by, total)
    lone = ends.select(*(F.lit(None).cast(t).alias(c) if c not in (by, at, "salt") else F.col(c) for c, t in dealt.dtypes), F.lit(0).alias("_row"), value)
    both = dealt.withColumn("_row", F.lit(1)).withColumn(value, F.lit(None).cast(dict(marks.dtypes)[value])).unionByName(lone)
    sweep = Window.partitionBy(by, "salt").orderBy(at, "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The value is wrapped: a mark that says "none from here on" is not skipped as a row without a mark is.
    said = F.last(F.when(F.col("_row") == 0, F.struct(F.col(value).alias("v"))), ignorenulls=True).over(sweep)
    return both.withColumn("_said", said).where("_row = 1").withColumn(value, F.col("_said.v")).drop("_said", "_row", "salt")


def judged(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """(key, host, path, rule, verdict) of every row. rules: (host, path, action)."""
    known = rules.select("host", "path", "action").where("host IS NOT NULL AND path IS NOT NULL AND action IS NOT NULL")
    # "block" is the greater of the two actions.
    known = known.groupBy("host", "path").agg(F.max("action").alias("action")).withColumn("key", key_of(F.col("host")))
    rows = urls.select(F.col(key).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows, total = rows.groupBy("id", "host", "path").agg(F.count(F.lit(1)).alias("n")), urls.count()
    # An end's key has AFTER in place of the last SEP; its top label is that of its start.
    top = F.regexp_extract("key", "(?s)^((?:[^\u0000\u0001]|\u0001[\u0002\u0003])*)", 1)
    hosts = swept(rows.withColumn("key", key_of(F.col("host"))).withColumn("top", top), host_breakpoints(known).withColumn("top", top), "top", "key", "stack", total)
    met = hosts.where("size(stack) > 0").select("id", "host", "path", F.explode("stack").alias("outer"), F.encode("path", "UTF-8").alias("at"))
    fits = swept(met, path_breakpoints(known), "outer", "at", "won", total).where("won IS NOT NULL")
    best = fits.groupBy("id", "host", "path").agg(F.max("won").alias("won"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("id", "host", "path")]
    out = rows.alias("a").join(best.alias("b"), same[0] & same[1] & same[2], "left").select("a.*", "b.won")
    out = out.select(F.col("id").alias(key), "host", "path", "n", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))
    return repeated(out, "n", "_i").drop("_i")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the fixed rules."""
    rules = " UNION ALL ".join(f"SELECT '{h}' AS host, '{p}' AS path, '{a}' AS action" for h, p, a in RULES)
    return judged(table(spark, sf_dir, "pages"), spark.sql(rules))


OP8_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rule_host, rule_path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), f AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, action
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(action, length(rule)), 'allow') AS verdict
FROM f GROUP BY page_id, host, path
"""
