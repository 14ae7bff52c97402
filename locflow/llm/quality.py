"""Operator 5: quality classifier as a sparse ensemble of rules.

Shallow trees are grown on statistics of labelled texts; every path from a
root to a node is a rule, a conjunction of ``statistic <= threshold`` and
``statistic > threshold``. A lasso logistic regression weighs the rules, and
those of non-zero weight are compiled into one Spark column expression over
the statistics. Statistics and score are column expressions too, evaluated
where the rows are; scoring needs no shuffle and no Python.

Fitting uses at most ``SAMPLE_ROWS`` labelled rows: the first ones in the
order of a hash of their id, from all rows that are not held out. Only these
ids and labels (two numbers a row) are broadcast to the documents.

Defined cases: a null or empty text has statistics of 0 and a score like any
other; a null id is not held out; repeated labels of one id count as the
lowest; labels that are null are not learnt from; where one of the two
labels is missing or no statistic parts them, every score is the share of
label 1 (1 without any label); an empty table gives no
rows; the caller's columns travel inside a struct, so no name can clash.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locflow.llm.shared import written

SAMPLE_ROWS = 20_000        # labelled rows to fit on
TREES, DEPTH = 24, 3        # at most 24 * 14 rules
PENALTY = 0.001             # of the lasso
THRESHOLD = 0.7             # a score from here on predicts label 1
SEED = 7

SPACE = r"[\x20\x09-\x0D]+"
#: characters whose share of the text is a statistic
SYMBOLS = {"bangs": "!", "bars": "|", "marks": "*#$%&", "ends": ".", "digits": "0123456789"}
STATISTICS = ("log_words", "word_chars", "distinct_words", "line_words", "distinct_lines", "capitals", "symbols",
              *SYMBOLS)


class Rule(NamedTuple):
    """Bounds on statistics, and the weight."""
    bounds: tuple[tuple[str, str, float], ...]
    weight: float


class Model(NamedTuple):
    """The constant, the rules of non-zero weight, and a fixed score where nothing could be learnt."""
    constant: float
    rules: tuple[Rule, ...]
    fixed: float | None = None


def crc_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def statistics(df: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The kept columns, and ``s``: the statistics of the whole text.

    Each step is a one-row generator, so that what later expressions use
    several times is computed once and filters are not pushed into it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    parts = F.struct(words.alias("words"), F.split(text, "\n").alias("lines"), F.length(text).alias("chars"),
                     F.regexp_replace(text, r"[\p{L}\p{M}\x20\x09-\x0D]+", "").alias("rest"),
                     F.length(F.regexp_replace(text, r"\P{Lu}+", "")).alias("upper"))
    df = df.select(*keep, F.explode(F.array(parts)).alias("t"))
    counted = F.struct(F.size("t.words").alias("words"), F.size(F.array_distinct("t.words")).alias("distinct_words"),
                       F.size("t.lines").alias("lines"), F.size(F.array_distinct("t.lines")).alias("distinct_lines"),
                       F.col("t.chars"), F.col("t.upper"), F.length("t.rest").alias("rest"),
                       F.aggregate("t.words", F.lit(0), lambda a, w: a + F.length(w)).alias("word_chars"),
                       *((F.length("t.rest") - F.length(F.translate("t.rest", c, ""))).alias(n)
                         for n, c in SYMBOLS.items()))
    names = [f for f in df.columns if f != "t"]
    df = df.select(*names, F.explode(F.array(counted)).alias("c"))
    share = lambda a, b: F.col(f"c.{a}") / F.greatest(F.col(f"c.{b}"), F.lit(1))
    made = [F.log1p("c.words").alias("log_words"), share("word_chars", "words").alias("word_chars"),
            share("distinct_words", "words").alias("distinct_words"), share("words", "lines").alias("line_words"),
            share("distinct_lines", "lines").alias("distinct_lines"), share("upper", "chars").alias("capitals"),
            share("rest", "chars").alias("symbols"), *(share(n, "chars").alias(n) for n in SYMBOLS)]
    return df.select(*names, F.explode(F.array(F.struct(*made))).alias("s"))


def paths(trees: str) -> list[tuple[tuple[str, str, float], ...]]:
    """The distinct conjunctions on the paths of a forest's description."""
    found, path = {}, []
    for line in trees.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.eE]+)\)", line)
        if not m:
            continue
        depth = len(m.group(1))
        path = [x for x in path if x[0] < depth] + [(depth, (STATISTICS[int(m.group(2))], m.group(3), float(m.group(4))))]
        bounds: dict[tuple[str, str], float] = {}
        for _, (name, sign, at) in path:    # of bounds on one statistic the tighter one counts
            old = bounds.get((name, sign), at)
            bounds[name, sign] = min(old, at) if sign == "<=" else max(old, at)
        found[tuple(sorted((n, s, at) for (n, s), at in bounds.items()))] = None
    return list(found)


def holds(bounds) -> Column:
    """A conjunction as a column expression over the statistics."""
    out = F.lit(True)
    for name, sign, at in bounds:
        stat = F.col(f"s.{name}")
        out = out & (stat <= at if sign == "<=" else stat > at)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Rules and weights from the labelled rows that are not held out."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = labels.where(~crc_held_out()).groupBy("doc_id").agg(F.min("quality").alias("label")).where("label is not null")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = written(statistics(chosen, [F.col("doc_id"), F.col("label").cast("double").alias("label")]), "quality-sample")
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = seen.get(1.0, 0) / sum(seen.values()) if seen else 1.0
    if len(seen) < 2:
        return Model(0.0, (), share)
    rows = rows.repartition(1).sortWithinPartitions("doc_id", "label", "s")    # bounded; makes the fit repeatable
    stats = VectorAssembler(inputCols=[f"f_{n}" for n in STATISTICS], outputCol="features")
    flat = stats.transform(rows.select("label", *(F.col(f"s.{n}").alias(f"f_{n}") for n in STATISTICS))).cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5, maxBins=64,
                                    featureSubsetStrategy="0.5", subsamplingRate=0.7).fit(flat.select("features", "label"))
    flat.unpersist()
    conjunctions = paths(forest.toDebugString)
    if not conjunctions:        # too few rows to part them by anything
        return Model(0.0, (), share)
    rules = VectorAssembler(inputCols=[f"r{k}" for k in range(len(conjunctions))], outputCol="features")
    hits = rules.transform(rows.select("label", *(holds(b).cast("double").alias(f"r{k}") for k, b in enumerate(conjunctions))))
    hits = hits.select("features", "label").cache()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=100, standardization=False).fit(hits)
    hits.unpersist()
    weights = [round(float(w), 6) for w in lasso.coefficients.toArray()]
    return Model(round(float(lasso.intercept), 6),
                 tuple(Rule(b, w) for b, w in zip(conjunctions, weights) if w != 0.0))


def score(model: Model) -> Column:
    """The compiled rules: a column between 0 and 1 over the statistics ``s``."""
    if model.fixed is not None:
        return F.lit(float(model.fixed))
    total = F.lit(model.constant)
    for r in model.rules:
        total = total + F.when(holds(r.bounds), F.lit(r.weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it is held out, its score and the predicted label."""
    model = fit(docs, labels)
    out = statistics(docs, [F.col("doc_id"), crc_held_out().alias("held_out")]).select(
        "doc_id", "held_out", score(model).alias("score"))
    return out.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    model = fit(docs, labels)
    rows = statistics(docs, [F.struct("*").alias("row"), F.col("text")])
    return rows.where(score(model) >= THRESHOLD).select("row.*")
