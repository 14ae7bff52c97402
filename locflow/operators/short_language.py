"""Language of short texts by character trigrams (LNG-01 where token profiles see nothing).

A profile holds the ``n`` most frequent trigrams of a language with a weight,
the thousandfold log-likelihood that they have above a trigram that the
profile lacks, and under the empty trigram that unseen one's own. A text's
score for a language is the sum of its trigrams' weights; the best language
must lead by ``MARGIN`` (odds of e^3 to 1), else the text stays ``und``. All
numbers are integers, so scores do not depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locflow.session import stage

GRAMS = 1500
MARGIN = 3000


def trigrams(text: Column) -> Column:
    """Trigrams of the letters, words set apart by one blank, one at either end; none without letters."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]++", " ")
    chars = F.split(F.concat(F.lit(" "), F.btrim(clean), F.lit(" ")), "", -1)

    # characters are split off once; cutting trigrams from the text would search each from its start
    def grams(chars: Column) -> Column:
        letters = F.filter(chars, lambda c: c != "")
        return F.transform(F.array(letters), lambda l: F.when(F.size(l) > 2, F.transform(
            F.sequence(F.lit(0), F.size(l) - 3), lambda i: F.concat(l[i], l[i + 1], l[i + 2]))).otherwise(F.array().cast("array<string>")))[0]

    return F.transform(F.array(chars), grams)[0]


def build_gram_profiles(labelled: DataFrame, n: int = GRAMS, text_col: str = "text", lang_col: str = "lang",
                        buckets: int = 64) -> DataFrame:
    """``profiles(lang, gram, weight)``; top ``n`` in two rounds as for the token profiles."""
    counts = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(trigrams(F.col(text_col))).alias("gram")).groupBy(
        "lang", "gram").agg(F.count("*").alias("c"))
    counts = stage(counts, "gram-counts")       # read three times below; the texts are cut once
    totals = counts.groupBy("lang").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    order = [F.desc("c"), F.col("gram")]
    local = counts.withColumn("b", F.pmod(F.xxhash64("gram"), F.lit(buckets))).withColumn(
        "r", F.row_number().over(Window.partitionBy("lang", "b").orderBy(*order))).where(F.col("r") <= n).drop("b", "r")
    top = local.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= n)
    log = lambda x: F.floor(F.log(x.cast("double")) * 1000).cast("bigint")
    unseen = -log(F.col("total") + F.col("kinds"))
    seen = top.join(totals, "lang").select("lang", "gram", log(F.col("c") + 1).alias("weight"))
    return seen.unionByName(totals.select("lang", F.lit("").alias("gram"), unseen.alias("weight")))


def detect_short(texts: DataFrame, profiles: DataFrame, id_cols=("doc_id",), text_col: str = "text",
                 margin: int = MARGIN) -> DataFrame:
    """``(<id>, detected, lead)``: the language of each text and by how much it leads; ``und`` under ``margin``.

    Profiles become one row per trigram with a weight per language, so a row
    per trigram of a text meets one row at most, and one more, the empty
    trigram, stands for all of the text's length. Only the names of the
    languages reach the driver.
    """
    ids = list(id_cols)
    langs = sorted(r.lang for r in profiles.select("lang").distinct().collect())
    if not langs:
        return texts.select(*ids, F.lit("und").alias("detected"), F.lit(0).cast("bigint").alias("lead"))
    names = [f"_w{i}" for i in range(len(langs))]
    weights = profiles.groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == lang, F.col("weight")).otherwise(0)).alias(n)
                                             for lang, n in zip(langs, names)])
    grams = texts.select(*ids, F.inline(F.array(F.struct(trigrams(F.col(text_col)).alias("grams"))))).where(F.size("grams") > 0)
    rows = grams.select(*ids, F.size("grams").cast("bigint").alias("_n"), F.explode(F.concat("grams", F.array(F.lit("")))).alias("gram"))
    times = F.when(F.col("gram") == "", F.col("_n")).otherwise(F.lit(1))
    scores = rows.join(weights, "gram").groupBy(*ids).agg(*[F.sum(F.col(n) * times).alias(n) for n in names])
    order = F.array_sort(F.array(*[F.struct((-F.col(n)).alias("score"), F.lit(lang).alias("lang")) for lang, n in zip(langs, names)]))
    ranked = scores.select(*ids, F.inline(F.array(F.struct(order.alias("_o")))))
    lead = F.col("_o")[1]["score"] - F.col("_o")[0]["score"] if len(langs) > 1 else F.lit(margin)
    found = ranked.select(*ids, F.col("_o")[0]["lang"].alias("best"), lead.cast("bigint").alias("lead"))
    out = texts.select(*ids).join(found, ids, "left")
    return out.select(*ids, F.when(F.col("lead") >= margin, F.col("best")).otherwise("und").alias("detected"),
                      F.coalesce("lead", F.lit(0)).cast("bigint").alias("lead"))
