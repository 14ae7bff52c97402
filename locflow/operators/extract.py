"""Literal extraction and the per-file text jobs around it.

EXT-01/02/03/04/05/06/07/08/09, FLT-01/03/04/05, AGG-02/03, SET-01, STR-07.

Tokenising is one ``regexp_extract_all`` (the tokens) plus one ``split`` on
the same pattern (the gaps between them): ``len(gaps) == len(tokens) + 1`` and
interleaving the two rebuilds the input exactly, which is what rewriting and
the balance check rely on. Everything up to the explode is narrow; the only
shuffle is the optional position window, keyed by file, which downstream
per-file jobs (distinct texts, report) reuse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locflow.functions import text as T
from locflow.functions.tokens import CONST_LINE, LITERALS, LOOKUP_PREFIXES, OPENERS, PROFILES
from locflow.operators.context import token_contexts
from locflow.operators.skew import hot_keys, salted_join

TOKS, GAPS = "_toks", "_gaps"


def tokenize(df: DataFrame, text_col: str = "content", profile: str = "code") -> DataFrame:
    """Add ``_toks`` and ``_gaps`` arrays (narrow).

    The arrays come out of a one-row ``inline`` generator rather than a plain
    projection: a later filter on them (the balance check) then stays above
    the generator instead of being inlined into the scan, which would run the
    regex twice per file.
    """
    if TOKS in df.columns and GAPS in df.columns:
        return df
    pattern = PROFILES[profile]
    arrays = F.struct(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0).alias(TOKS),
                      F.split(F.col(text_col), pattern, -1).alias(GAPS))
    return df.select("*", F.inline(F.array(arrays)))


def stray_openers(gaps, profile: str = "code") -> F.Column:
    """Quotes and block comment openers that stand in no token; gaps are set apart so that two of them make no opener."""
    return openers_in(F.array_join(gaps, "\n"), profile)


def openers_in(outside, profile: str = "code") -> F.Column:
    """Quotes and block comment openers of a text."""
    return sum(((F.length(outside) - F.length(F.replace(outside, F.lit(o), F.lit("")))) / len(o) for o in OPENERS[profile]),
               F.lit(0)).cast("bigint")


def balance(df: DataFrame, text_col: str = "content", profile: str = "code") -> DataFrame:
    """Per file: token count, quotes left outside any token, and ``balanced`` (AGG-02).

    A quote (in code of either kind, or ``/*``) that no token consumed opens
    something that never closes (FLT-03); counting those replaces the
    reference's parity test on live quotes.
    """
    t = tokenize(df, text_col, profile)
    return (t.withColumn("n_tokens", F.size(TOKS).cast("bigint"))
             .withColumn("stray_quotes", stray_openers(F.col(GAPS), profile))
             .withColumn("balanced", F.col("stray_quotes") == 0))


def quarantine_unbalanced(df: DataFrame, text_col: str = "content", id_cols=("path",),
                          profile: str = "code"):
    """Split sources into ``(ok, rejects)`` in one pass (FLT-03).

    ``ok`` keeps the token arrays so extraction does not tokenise again;
    ``rejects(stage, path, detail)`` names the file and its stray quote count.
    """
    b = balance(df, text_col, profile)
    ok = b.filter("balanced").drop("n_tokens", "stray_quotes", "balanced")
    rejects = (b.filter(~F.col("balanced"))
                .select(F.lit("unbalanced").alias("stage"),
                        F.concat_ws("/", *[F.col(c).cast("string") for c in id_cols]).alias("path"),
                        F.concat(F.lit("stray quotes: "), F.col("stray_quotes").cast("string")).alias("detail")))
    return ok, rejects


def extract_literals(df: DataFrame, text_col: str = "content", id_cols=("path",),
                     profile: str = "code", prefixes=LOOKUP_PREFIXES, positions: bool = True,
                     line_rule: bool = False, keep_comments: bool = False, context: bool = False) -> DataFrame:
    """``literals(<id>, ordinal, kind, raw, text, wrapped[, context][, offset, line_no])`` (EXT-01/02/09, FLT-04/05).

    * ``ordinal``: 0-based index among all tokens of the file (comments, characters and preprocessor lines included).
    * ``kind``: ``regular`` | ``verbatim`` | ``interpolated``; with ``keep_comments`` also ``comment``, ``block``,
      ``char`` and ``directive``.
    * ``context``: where the literal stands (``operators.context``); found within the file's row, no shuffle.
    * ``text``: characters between the quotes (EXT-09).
    * ``wrapped``: the literal sits right behind a lookup prefix (FLT-05).
    * ``offset``/``line_no``: code-point offset of the token and its 1-based line
      (EXT-03); computed by one running-sum window per file.
    * ``line_rule=True`` applies the reference's line-wide comment rule: a
      literal on a line holding ``//`` is dropped unless the line mentions
      ``http`` or ``ftp`` (Q1/Q2 behaviour, off by default).
    """
    ids = list(id_cols)
    t = tokenize(df, text_col, profile)
    parts = [F.slice(F.col(GAPS), 1, F.size(TOKS)).alias("gap"), F.col(TOKS).alias("raw")]
    if context:
        t = t.select("*", F.inline(F.array(F.struct(token_contexts(F.col(GAPS), profile).alias("_contexts")))))
        parts.append(F.col("_contexts").alias("context"))
    pairs = F.arrays_zip(*parts)
    cols = ids + [F.posexplode(pairs).alias("pos", "tk")]
    if line_rule:
        lines = F.split(F.col(text_col), "\n", -1)
        flags = F.transform(lines, lambda l: (F.instr(l, "//") > 0)
                            & ~(l.contains("http") | l.contains("ftp")))
        cols.append(flags.alias("_line_flags"))
    x = t.select(*cols)
    raw = F.col("tk.raw")
    gap = F.col("tk.gap")
    kind = T.token_kind(raw)
    wrapped = F.lit(False)
    for p in prefixes:
        wrapped = wrapped | gap.endswith(p)
    # behind generators, so that the kind and the text of a token are made once, whatever is asked of them later
    rest = [*(["_line_flags"] if line_rule else [])]
    x = x.select(*ids, F.col("pos").cast("bigint").alias("ordinal"), *rest, F.inline(F.array(F.struct(
        kind.alias("kind"), raw.alias("raw"), wrapped.alias("wrapped"), gap.alias("_gap"),
        *([F.col("tk.context").alias("context")] if context else [])))))
    x = x.select("*", F.inline(F.array(F.struct(T.inner_text("raw", "kind").alias("text")))))
    if positions or line_rule:
        # Only lengths and line-break counts cross the shuffle, not the gap text.
        x = (x.withColumn("_glen", F.length("_gap")).withColumn("_gnl", T.newlines("_gap"))
              .withColumn("_step", F.col("_glen") + F.length("raw"))
              .withColumn("_stepnl", F.col("_gnl") + T.newlines("raw")).drop("_gap"))
        before = Window.partitionBy(*ids).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
        x = x.select("*", F.sum("_step").over(before).alias("_pl"), F.sum("_stepnl").over(before).alias("_pn"))
        x = (x.withColumn("offset", (F.coalesce(F.col("_pl"), F.lit(0)) + F.col("_glen")).cast("bigint"))
              .withColumn("line_no", (F.coalesce(F.col("_pn"), F.lit(0)) + F.col("_gnl") + 1).cast("bigint"))
              .drop("_glen", "_gnl", "_step", "_stepnl", "_pl", "_pn"))
    else:
        x = x.drop("_gap")
    if line_rule:
        x = x.filter(~F.coalesce(F.element_at("_line_flags", F.col("line_no").cast("int")), F.lit(False)))
        x = x.drop("_line_flags")
        if not positions:
            x = x.drop("offset", "line_no")
    if not keep_comments:
        x = x.filter(F.col("kind").isin(*LITERALS))
    return x


def distinct_texts(literals: DataFrame, id_cols=("path",), text_col: str = "text") -> DataFrame:
    """Distinct non-blank first lines per file with first ordinal and use count (EXT-04, FLT-01, SET-01).

    Map-side partial aggregation, then one shuffle on ``(<id>, text)``;
    when the literals come hash-partitioned by file (position window) Spark
    reuses that partitioning and adds no exchange.
    """
    keep = literals.filter(~T.is_blank(text_col))
    if "kind" in literals.columns:
        keep = keep.filter(F.col("kind").isin(*LITERALS))
    if "wrapped" in literals.columns:
        keep = keep.filter(~F.col("wrapped"))
    return (keep.withColumn(text_col, T.first_line(text_col))
                .groupBy(*id_cols, text_col)
                .agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("uses")))


def split_edges(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``prefix``, ``core``, ``suffix`` (EXT-07), narrow."""
    return df.select("*", F.inline(F.array(T.edges(text_col))))     # behind a generator, so that the parts are made once


def split_values(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``prefix``, ``core``, ``suffix`` of bold and edge split together (EXT-06, EXT-07), narrow."""
    return df.select("*", F.inline(F.array(T.split_value(text_col))))


def core_variants(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per ``(core, spelling)`` with uses and the number of spellings of the core.

    So ``Hello``, ``Hello:`` and ``/Hello`` are seen as one entry. Partial
    aggregation by ``(core, text)``, then a count per core joined back; no
    per-core list is collected, so a core with very many spellings stays
    spread over tasks.
    """
    texts = df.filter(~T.is_blank(text_col)).select(F.col(text_col).alias("text"))
    per_text = (split_edges(texts, "text").filter(F.length("core") > 0)
                .groupBy("core", "text").agg(F.count(F.lit(1)).alias("uses")))
    spellings = per_text.groupBy("core").agg(F.count(F.lit(1)).alias("spellings"))
    return salted_join(per_text, spellings, ["core"], "inner", hot=hot_keys(spellings, ["core"], "spellings"),
                       salt_cols=["core", "text"])


def bold_literals(literals: DataFrame, text_col: str = "text") -> DataFrame:
    """Literals wrapped in ``<b>..</b>`` with their parts (EXT-06)."""
    b = T.bold_parts(text_col)
    return (literals.withColumn("_b", b).filter(F.col("_b").isNotNull())
                    .select("*", F.col("_b.open").alias("open_tag"), F.col("_b.core").alias("core"),
                            F.col("_b.close").alias("close_tag")).drop("_b"))


def clean_lines(lines: DataFrame, id_cols=("path",), line_col: str = "line") -> DataFrame:
    """Cleaned distinct lines per file with uses (EXT-08); blank results are dropped."""
    c = (lines.filter(~T.is_blank(line_col))
              .withColumn("cleaned", T.clean_line(line_col))
              .filter(~T.is_blank("cleaned")))
    return (c.groupBy(*id_cols, "cleaned")
             .agg(F.count(F.lit(1)).alias("uses"), F.min("line_no").alias("first_line_no")))


def extract_constants(lines: DataFrame, id_cols=("path",), line_col: str = "line") -> DataFrame:
    """``constants(<id>, line_no, key, value)`` from declaration lines (SRC-07, EXT-05), narrow."""
    return (lines.filter(F.col(line_col).rlike(CONST_LINE))
                 .select(*id_cols, "line_no",
                         F.regexp_extract(line_col, CONST_LINE, 1).alias("key"),
                         F.regexp_extract(line_col, CONST_LINE, 2).alias("value")))


def first_constants(constants: DataFrame, id_cols=("path",)) -> DataFrame:
    """Topmost constant line per file (AGG-03)."""
    return constants.groupBy(*id_cols).agg(F.min("line_no").alias("first_line_no"),
                                           F.count(F.lit(1)).alias("constants"))


PROPERTY_TEMPLATE = "public static string {key} { get { return {lookup}; } }"


def migrate_constants(sources: DataFrame, text_col: str = "content",
                      template: str = PROPERTY_TEMPLATE) -> DataFrame:
    """Replace constant declarations by lookup properties (EXT-05), narrow per file.

    Declaration lines are removed; the generated properties are inserted as
    one block where the topmost declaration was, in reverse line order as the
    reference emits them (Q21). Files without declarations pass unchanged.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    is_const = lambda l: l.rlike(CONST_LINE)
    head, rest = template.split("{key}", 1)
    mid, tail = rest.split("{lookup}", 1)

    def prop(l):
        key = F.regexp_extract(l, CONST_LINE, 1)
        return F.concat(F.lit(head), key, F.lit(mid), T.lookup_expr(key), F.lit(tail))

    props = F.reverse(F.filter(F.transform(lines, lambda l: F.when(is_const(l), prop(l))),
                               lambda p: p.isNotNull()))
    first = F.array_position(F.transform(lines, is_const), True)
    n = F.size(lines)
    rebuilt = F.concat(F.slice(lines, 1, first - 1), F.array(F.array_join(props, "\n")),
                       F.filter(F.slice(lines, first + 1, F.greatest(n - first, F.lit(1))),
                                lambda l: ~is_const(l)))
    return sources.withColumn(text_col, F.when(first > 0, F.array_join(rebuilt, "\n"))
                              .otherwise(F.col(text_col)))


def normalise_escapes(sources: DataFrame, text_col: str = "content") -> DataFrame:
    """Regular all-backslash literals to the verbatim form (STR-07), token by token, narrow."""
    t = tokenize(sources, text_col, "code")
    toks = F.transform(F.col(TOKS), T.backslash_verbatim)
    parts = F.zip_with(F.col(GAPS), F.concat(toks, F.array(F.lit(""))), lambda g, tok: F.concat(g, tok))
    return t.withColumn(text_col, F.array_join(parts, "")).drop(TOKS, GAPS)
