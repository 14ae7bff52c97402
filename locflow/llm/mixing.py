"""Operator 7: mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected ``rate = target / source size`` times
(at most ``cap`` times). Its copies come from a prefix sum: with the
documents of a source in one fixed order, ``k`` the position and ``u`` one
offset per source in [0, 1), document ``k`` is emitted once for every integer
crossed between ``rate * (k - 1) + u`` and ``rate * k + u``.

The order is by size class (eight classes per doubling), then by a hash
bucket of the id, then by size, id and text hash, so every size is drawn at the same
rate and the taken words come near the target. The prefix sum is made in
three levels, none of which holds an unbounded group: positions inside one
(source, class, bucket), counts over the 256 buckets of one sixteenth of a
class, and counts over the sixteenths of a source's classes (some 8,000 at
most). A source with a third of all rows is thus dealt over thousands of
groups.

Defined cases: a null or empty text has size 0 (it may be drawn; it takes no
words); a null source is a source of its own, last in order; a null id is
ordered first; repeated rows are drawn one by one; sources without words
have target 0; an empty table gives no rows; columns of any other names
travel inside a struct, so no name can clash. The offset is a hash of the
seed and the source, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locflow.llm.shared import written

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix"
BUCKET_DIGITS = 3           # hex digits of an id's MD5: 4,096 buckets; the first digit is the sixteenth

SOURCE = ["s_null", "s_name"]
GROUP = [*SOURCE, "class", "bucket"]


def sized(df: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The kept columns as ``row`` beside each document's size and place in the drawing order."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("bigint")
    bits = F.length(F.bin("size"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return df.select(F.struct(*keep).alias("row"), size.alias("size"), key.alias("id_text"),
                     F.xxhash64(F.col(text_col)).alias("tie"),
                     F.col(source_col).isNull().alias("s_null"),
                     F.coalesce(F.col(source_col), F.lit("")).alias("s_name")).select(
        "row", "size", "id_text", "tie", *SOURCE,
        (bits * 16 + F.call_function("shiftright", F.col("size"), F.greatest(bits - 4, F.lit(0))))
        .cast("bigint").alias("class"),
        F.substring(F.md5("id_text"), 1, BUCKET_DIGITS).alias("bucket"))


def offset(name: Column, seed: str) -> Column:
    """One number in [0, 1) per source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double") / float(2 ** 52)


def targets(counts: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per source: ``source_size, target, rate, u``.

    Sources in order of their name take the weights in turn. A target is the
    common level times the weight, at most the cap; the level rises until all
    shares are handed out, which is where resharing the excess by weight ends.
    """
    per = counts.groupBy(*SOURCE).agg(F.sum("words").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))   # one row per source
    place = F.row_number().over(everything.orderBy(*SOURCE)) - 1
    per = per.select("*", (F.col("source_size") * cap).alias("most"),
                     F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).alias("w"))
    before = everything.orderBy(F.col("most") / F.col("w"), *SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("*", (F.sum("source_size").over(everything) * share).alias("all_words"),
                     F.sum("w").over(everything).alias("all_w"),
                     F.coalesce(F.sum("most").over(before), F.lit(0)).alias("most_before"),
                     F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"))
    full = (F.col("all_words") - F.col("most_before")) * F.col("w") >= F.col("most") * (F.col("all_w") - F.col("w_before"))
    per = per.withColumn("full", full)
    rest = F.col("all_words") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything)
    rest_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(rest * F.col("w") / rest_w)
    name = F.concat(F.when(F.col("s_null"), "null:").otherwise("name:"), F.col("s_name"))
    return per.select(*SOURCE, "source_size", target.alias("target"), offset(name, seed).alias("u")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def draw(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``sized`` rows with ``source_size``, ``target`` and ``copies`` (0 to ``cap``)."""
    counts = written(rows.groupBy(*GROUP).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-counts")
    plan = written(targets(counts, weights, share, cap, seed), "mix-targets")
    counts = counts.withColumn("part", F.substring("bucket", 1, 1))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy(*SOURCE, "class", "part").agg(F.sum("n").alias("n"))
    parts = parts.select(*SOURCE, "class", "part", before(Window.partitionBy(*SOURCE).orderBy("class", "part")).alias("parts_before"))
    buckets = counts.select(*GROUP, "part", before(
        Window.partitionBy(*SOURCE, "class", "part").orderBy("bucket")).alias("buckets_before"))
    starts = buckets.join(parts, [*SOURCE, "class", "part"]).select(
        *GROUP, (F.col("parts_before") + F.col("buckets_before")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*GROUP).orderBy("size", "id_text", "tie"))
    placed = rows.withColumn("inside", inside).join(starts, GROUP).join(plan, SOURCE)
    k = F.col("before") + F.col("inside")
    crossed = F.floor(F.col("rate") * k + F.col("u")) - F.floor(F.col("rate") * (k - 1) + F.col("u"))
    return placed.select("row", "size", "source_size", "target", F.least(crossed, F.lit(cap)).cast("bigint").alias("copies"))


def mix_plan(df: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    rows = draw(written(sized(df, ["doc_id"]), "mix-sized"))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(df: DataFrame, **settings) -> DataFrame:
    """The mixed table: every document as often as it is drawn, with the columns of ``df``."""
    rows = draw(sized(df, df.columns), **settings)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rows.where("copies > 0").select("row", copies.alias("copy")).select("row.*")


def oracle(documents: str = "documents") -> str:
    """The same mix in DuckDB SQL over a table of documents."""
    return rf"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(doc_id::VARCHAR, '') AS id_text, source IS NULL AS s_null, coalesce(source, '') AS s_name
  FROM {documents}),
p AS (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class,
         substr(md5(id_text), 1, 3) AS bucket FROM d),
r AS (
  SELECT *, row_number() OVER (PARTITION BY s_null, s_name ORDER BY class, bucket, size, id_text) AS k FROM p),
s0 AS (SELECT s_null, s_name, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
s1 AS (
  SELECT *, 2 * source_size AS most,
         [3, 1, 2][(row_number() OVER (ORDER BY s_null, s_name) - 1) % 3 + 1] AS w FROM s0),
s2 AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS all_words, sum(w) OVER () AS all_w,
         coalesce(sum(most) OVER o, 0) AS most_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM s1 WINDOW o AS (ORDER BY most::DOUBLE / w, s_null, s_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (all_words - most_before) * w >= most * (all_w - w_before) AS is_full FROM s2),
s4 AS (
  SELECT *, CASE WHEN is_full THEN most::DOUBLE
    ELSE (all_words - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ()) * w
         / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM s3),
s5 AS (
  SELECT s_null, s_name, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('{SEED}:' || CASE WHEN s_null THEN 'null:' ELSE 'name:' END || s_name), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496 AS u FROM s4)
SELECT doc_id, size, source_size, target,
       least((floor(rate * k + u) - floor(rate * (k - 1) + u))::BIGINT, 2) * size AS taken
FROM r JOIN s5 USING (s_null, s_name)"""
