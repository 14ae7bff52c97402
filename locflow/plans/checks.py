"""Registered queries: one Spark job per operator group, each with a DuckDB twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs on the whole driver tables;
``ORACLE[name]`` is the same question in DuckDB SQL over the same Parquet
views. Column names agree so results can be compared by value.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locflow.functions import text as T
from locflow.operators import catalog as C
from locflow.operators import classify as K
from locflow.operators import extract as X
from locflow.operators import language as L
from locflow.operators import memory as M
from locflow.operators import report as R
from locflow.operators import review as V
from locflow.operators import rewrite as W
from locflow.plans import fixtures as FX
from locflow.plans import oracle as O
from locflow.session import ensure_checkpoint_dir, stage
from locflow.sources.files import to_lines
from locflow.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- shared bits

def _page_literals(spark, sf_dir, positions=False):
    return X.extract_literals(FX.pages(spark, sf_dir), "html", ("page_id",), "markup", positions=positions)


def _page_classified(spark, sf_dir):
    return K.classify(_page_literals(spark, sf_dir), K.stoplist(spark))


def _code_literals(spark, sf_dir, positions=True):
    return X.extract_literals(FX.code_sources(spark, sf_dir), "content", ("doc_id",), "code",
                              positions=positions)


def _doc_keys(spark, sf_dir):
    return C.derive_keys(FX.doc_texts(spark, sf_dir), order_cols=("doc_id", "line_no"))


PAGE_STOP = O.stop_cte()
PAGE_LITS = O.literals_cte("plit", "pg", ["page_id"], "html", "markup", positions=False)
PAGE_CLS = (f"{PAGE_STOP}, {PAGE_LITS}, "
            f"pcls AS (SELECT l.*, {O.reason('text')} AS reason FROM plit l LEFT JOIN stop s ON l.text = s.token), "
            "pcls2 AS (SELECT *, reason = 'text' AS translatable FROM pcls)")
DOC_STOP = O.stop_cte()
CODE_LITS = O.literals_cte('lit', 'code', ['doc_id'], 'content', 'code', positions=False)


# ---------------------------------------------------------------- flagship

FLAGSHIP_SQL = f"""
WITH {O.pages_cte()}, {O.literals_cte('plit', 'pg', ['page_id', 'page_lang'], 'html', 'markup', positions=False)},
{O.code_cte()}, {O.literals_cte('clit', 'code', ['doc_id', 'lang'], 'content', 'code', positions=False)},
{DOC_STOP},
l AS (SELECT page_lang, text, wrapped FROM plit
      UNION ALL SELECT lang, {O.literal_value('kind', 'text')}, wrapped FROM clit WHERE kind IN ('regular', 'verbatim')),
c AS (SELECT l.*, {O.reason('text')} = 'text' AS translatable FROM l LEFT JOIN stop s ON l.text = s.token),
d AS (SELECT page_lang, translatable, {O.first_line('text')} AS text, count(*) AS uses
      FROM c WHERE NOT {O.blank('text')} AND NOT wrapped GROUP BY ALL),
k AS (SELECT *, {O.pascal('text')} AS key FROM d)
SELECT page_lang, translatable, count(*) AS texts, count(DISTINCT key) FILTER (WHERE key <> '') AS keys,
       CAST(sum(uses) AS BIGINT) AS uses
FROM k GROUP BY page_lang, translatable
"""


@register("q_flagship", FLAGSHIP_SQL)
def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and code → literals → values → classify → distinct texts → keys, summarised per language."""
    pages = X.extract_literals(FX.pages(spark, sf_dir), "html", ("page_id", "page_lang"), "markup", positions=False)
    code = X.extract_literals(FX.code_sources(spark, sf_dir), "content", ("doc_id", "lang"), "code", positions=False)
    lit = pages.select("page_lang", "text", "wrapped").unionByName(
        code.filter(F.col("kind") != "interpolated").select(
            F.col("lang").alias("page_lang"), T.literal_value("text", "kind").alias("text"), "wrapped"))
    c = K.classify(lit, K.stoplist(spark))
    d = (c.filter(~T.is_blank("text") & ~F.col("wrapped"))
          .withColumn("text", T.first_line("text"))
          .groupBy("page_lang", "translatable", "text").agg(F.count(F.lit(1)).alias("uses"))
          .withColumn("key", T.pascal_key("text")))
    return (d.groupBy("page_lang", "translatable")
             .agg(F.count(F.lit(1)).alias("texts"),
                  F.countDistinct(F.when(F.col("key") != "", F.col("key"))).alias("keys"),
                  F.sum("uses").cast("bigint").alias("uses")))


# ---------------------------------------------------------------- sources

@register("q_lines", f"""
WITH {O.doc_lines_cte()}
SELECT doc_id, lang, line_no, line, CAST(length(line) AS BIGINT) AS n_chars FROM doc_lines
""")
def q_lines(spark, sf_dir):
    """SRC-05/06: every line of every document with its length."""
    return FX.doc_lines(spark, sf_dir).withColumn("n_chars", F.length("line").cast("bigint"))


# ---------------------------------------------------------------- extraction

@register("q_literals", f"""
WITH {O.pages_cte()}, {O.literals_cte('lit', 'pg', ['page_id'], 'html', 'markup')}
SELECT page_id, ordinal, "offset", line_no, text FROM lit
""")
def q_literals(spark, sf_dir):
    """EXT-01/03/09 on pages: every quoted run with its offset and line."""
    return _page_literals(spark, sf_dir, positions=True).select("page_id", "ordinal", "offset", "line_no", "text")


@register("q_code_literals", f"""
WITH {O.code_cte()}, {O.literals_cte('lit', 'code', ['doc_id'], 'content', 'code')}
SELECT doc_id, ordinal, kind, line_no, text, wrapped FROM lit
""")
def q_code_literals(spark, sf_dir):
    """EXT-01/02/09, FLT-04/05 on the code view: regular and verbatim literals, comments skipped."""
    return _code_literals(spark, sf_dir).select("doc_id", "ordinal", "kind", "line_no", "text", "wrapped")


@register("q_unbalanced", f"""
WITH {O.code_cte()},
t AS (SELECT doc_id, regexp_extract_all(content, {O.q(O.TOKENS['code'])}) AS toks, {O.stray('content')} AS stray FROM code)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(stray AS BIGINT) AS stray_quotes, stray = 0 AS balanced
FROM t
""")
def q_unbalanced(spark, sf_dir):
    """FLT-03, AGG-02: quotes and comment openers outside any token per file; unbalanced files are set aside."""
    return X.balance(FX.code_sources(spark, sf_dir)).select("doc_id", "n_tokens", "stray_quotes", "balanced")


@register("q_distinct_texts", f"""
WITH {O.pages_cte()}, {O.literals_cte('lit', 'pg', ['page_id'], 'html', 'markup', positions=False)}
SELECT page_id, {O.first_line('text')} AS text, min(ordinal) AS first_ordinal, count(*) AS uses
FROM lit WHERE NOT {O.blank('text')} AND NOT wrapped
GROUP BY page_id, {O.first_line('text')}
""")
def q_distinct_texts(spark, sf_dir):
    """EXT-04, FLT-01, SET-01: distinct non-blank first lines per page."""
    return X.distinct_texts(_page_literals(spark, sf_dir), ("page_id",))


_BOLD_SELECT = (f"SELECT doc_id, ordinal, text, {O.bold('text', 1)} AS open_tag, {O.bold('text', 2)} AS core, "
                f"{O.bold('text', 3)} AS close_tag FROM lit WHERE {O.bold_hit('text')}")


@register("q_bold", f"""
WITH {O.code_cte()}, {O.literals_cte('lit', 'code', ['doc_id'], 'content', 'code', positions=False)}
{_BOLD_SELECT}
""")
def q_bold(spark, sf_dir):
    """EXT-06: bold-wrapped literals split into tag, core, tag."""
    return X.bold_literals(_code_literals(spark, sf_dir, positions=False)).select(
        "doc_id", "ordinal", "text", "open_tag", "core", "close_tag")


_P, _C, _S = O.edges("text")


@register("q_padding", f"""
WITH {O.doc_lines_cte()}
SELECT doc_id, line_no, text, {_P} AS prefix, {_C} AS core, {_S} AS suffix FROM doc_texts
""")
def q_padding(spark, sf_dir):
    """EXT-07: edge characters split off every document line (lossless)."""
    return X.split_edges(FX.doc_texts(spark, sf_dir), "text").select(
        "doc_id", "line_no", "text", "prefix", "core", "suffix")


@register("q_core_variants", f"""
WITH {O.pages_cte()}, {O.literals_cte('lit', 'pg', ['page_id'], 'html', 'markup', positions=False)},
e AS (SELECT text, {_C} AS core FROM lit WHERE NOT {O.blank('text')}),
pt AS (SELECT core, text, count(*) AS uses FROM e WHERE length(core) > 0 GROUP BY core, text)
SELECT core, text, uses, count(*) OVER (PARTITION BY core) AS spellings FROM pt
""")
def q_core_variants(spark, sf_dir):
    """EXT-07: spellings of the same core among page literals (``/The`` and ``The``)."""
    return X.core_variants(_page_literals(spark, sf_dir), "text")


@register("q_clean_lines", f"""
WITH {O.code_cte()},
c AS (SELECT doc_id, line_no, regexp_replace({O.ws_trim("split_part(line, '//', 1)")}, ',+$', '') AS cleaned
      FROM code_lines WHERE NOT {O.blank('line')})
SELECT doc_id, cleaned, count(*) AS uses, min(line_no) AS first_line_no FROM c
WHERE NOT {O.blank('cleaned')} GROUP BY doc_id, cleaned
""")
def q_clean_lines(spark, sf_dir):
    """EXT-08: lines cut at ``//``, trimmed, trailing commas dropped, distinct per file."""
    return X.clean_lines(FX.code_lines(spark, sf_dir), ("doc_id",))


_CONSTS = (f"consts AS (SELECT doc_id, line_no, {O.const_key('line')} AS key, {O.const_value('line')} AS value "
           f"FROM code_lines WHERE {O.const_hit('line')})")


@register("q_constants", f"""
WITH {O.code_cte()}, {_CONSTS}
SELECT doc_id, line_no, key, value FROM consts
""")
def q_constants(spark, sf_dir):
    """SRC-07, EXT-05: declared constants (key, value) per file."""
    return X.extract_constants(FX.code_lines(spark, sf_dir), ("doc_id",))


@register("q_first_constant", f"""
WITH {O.code_cte()}, {_CONSTS}
SELECT doc_id, min(line_no) AS first_line_no, count(*) AS constants FROM consts GROUP BY doc_id
""")
def q_first_constant(spark, sf_dir):
    """AGG-03: topmost constant line per file."""
    return X.first_constants(X.extract_constants(FX.code_lines(spark, sf_dir), ("doc_id",)), ("doc_id",))


# ---------------------------------------------------------------- classify, decide

@register("q_classify", f"""
WITH {O.pages_cte()}, {O.literals_cte('plit', 'pg', ['page_id'], 'html', 'markup', positions=False)},
{O.code_cte()}, {CODE_LITS}, {DOC_STOP},
l AS (SELECT 'page' AS src, page_id AS id, ordinal, text FROM plit
      UNION ALL SELECT 'code', doc_id, ordinal, {O.literal_value('kind', 'text')} FROM lit WHERE kind IN ('regular', 'verbatim')),
c AS (SELECT l.*, {O.reason('text')} AS reason FROM l LEFT JOIN stop s ON l.text = s.token)
SELECT src, id, ordinal, text, reason = 'text' AS translatable, reason FROM c
""")
def q_classify(spark, sf_dir):
    """SRC-09, FLT-06: every page and code literal's value with its verdict and the rule that gave it."""
    pages = _page_literals(spark, sf_dir).select(F.lit("page").alias("src"), F.col("page_id").alias("id"), "ordinal", "text")
    code = _code_literals(spark, sf_dir, positions=False).filter(F.col("kind") != "interpolated").select(
        F.lit("code").alias("src"), F.col("doc_id").alias("id"), "ordinal", T.literal_value("text", "kind").alias("text"))
    return K.classify(pages.unionByName(code), K.stoplist(spark)).select(
        "src", "id", "ordinal", "text", "translatable", "reason")


@register("q_classify_places", f"""
WITH {O.pages_cte()}, {O.literals_cte('plit', 'pg', ['page_id'], 'html', 'markup', positions=False)},
{O.code_cte()}, {CODE_LITS}, {DOC_STOP},
l AS (SELECT 'page' AS src, page_id AS id, ordinal, text, context FROM plit
      UNION ALL SELECT 'code', doc_id, ordinal, {O.literal_value('kind', 'text')}, context FROM lit WHERE kind IN ('regular', 'verbatim')),
c AS (SELECT l.*, {O.reason('text', O.place_rules())} AS reason FROM l LEFT JOIN stop s ON l.text = s.token)
SELECT src, id, ordinal, text, context, reason = 'text' AS translatable, reason FROM c
""")
def q_classify_places(spark, sf_dir):
    """FLT-06 with the position: the place of every page and code literal takes part in its verdict, so one text
    (``Pick 7``) is translatable in one call and not in another."""
    pages = X.extract_literals(FX.pages(spark, sf_dir), "html", ("page_id",), "markup", positions=False, context=True).select(
        F.lit("page").alias("src"), F.col("page_id").alias("id"), "ordinal", "text", "context")
    code = X.extract_literals(FX.code_sources(spark, sf_dir), "content", ("doc_id",), "code", positions=False, context=True)
    code = code.filter(F.col("kind") != "interpolated").select(
        F.lit("code").alias("src"), F.col("doc_id").alias("id"), "ordinal", T.literal_value("text", "kind").alias("text"), "context")
    return K.classify(pages.unionByName(code), K.stoplist(spark), context_col="context").select(
        "src", "id", "ordinal", "text", "context", "translatable", "reason")


@register("q_decisions", f"""
WITH {O.doc_lines_cte()}, {DOC_STOP},
c AS (SELECT d.doc_id, d.text, {O.reason('d.text', "WHEN line_no = 1 THEN 'heading'")} = 'text' AS translatable
      FROM doc_texts d LEFT JOIN stop s ON d.text = s.token),
pf AS (SELECT doc_id, text, bool_or(translatable) AS in_bet, bool_or(NOT translatable) AS in_not FROM c GROUP BY doc_id, text),
dec AS (SELECT d.text, CASE WHEN l.toxic = 1 THEN 'manual_no' WHEN l.quality = 0 THEN 'auto_no' ELSE 'auto_yes' END AS verdict
        FROM doc_texts d JOIN labels l USING (doc_id)),
fl AS (SELECT text, bool_or(verdict = 'manual_no') AS manual_no, bool_or(verdict = 'auto_no') AS auto_no,
              bool_or(verdict = 'auto_yes') AS auto_yes FROM dec GROUP BY text),
v AS (SELECT pf.doc_id, pf.text,
        CASE WHEN NOT in_bet THEN 'not_translatable' WHEN coalesce(manual_no, false) THEN 'manual_no'
             WHEN coalesce(auto_no, false) THEN 'auto_no' WHEN in_not AND NOT coalesce(auto_yes, false) THEN 'also_not'
             ELSE 'kept' END AS verdict
      FROM pf LEFT JOIN fl USING (text))
SELECT doc_id, text, verdict = 'kept' AS kept, verdict FROM v
""")
def q_decisions(spark, sf_dir):
    """SRC-08, SET-02: stored decisions from labels applied to each document's lines; a user rule sets first
    lines aside, so a line that also occurs further down is in both sets."""
    texts = FX.doc_texts(spark, sf_dir)
    classified = stage(K.classify(texts, K.stoplist(spark), rules=[("heading", F.col("line_no") == 1)]).select(
        "doc_id", "text", "translatable"), "classified")
    return K.apply_decisions(classified, FX.labelled_decisions(spark, sf_dir), ("doc_id",))


@register("q_path_guard", f"""
WITH {O.pages_cte()}, {O.literals_cte('plit', 'pg', ['page_id'], 'html', 'markup', positions=False)},
{O.code_cte()}, {CODE_LITS},
l AS (SELECT 'page' AS src, page_id AS id, ordinal, text FROM plit
      UNION ALL SELECT 'code', doc_id, ordinal, {O.literal_value('kind', 'text')} FROM lit WHERE kind IN ('regular', 'verbatim')),
listing AS (SELECT url AS p FROM pages UNION SELECT 'f' || doc_id || '.cs' FROM documents)
SELECT src, id, ordinal, text, text IN (SELECT p FROM listing WHERE p IS NOT NULL) AS is_path FROM l WHERE NOT {O.blank('text')}
""")
def q_path_guard(spark, sf_dir):
    """FLT-02: page and code literals that are themselves a listed path (page URLs and source file names, whole)."""
    listing = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).unionByName(
        FX.code_sources(spark, sf_dir).select(F.regexp_extract("path", "[^/]*$", 0).alias("path")))
    pages = _page_literals(spark, sf_dir).select(F.lit("page").alias("src"), F.col("page_id").alias("id"), "ordinal", "text")
    code = _code_literals(spark, sf_dir, positions=False).filter(F.col("kind") != "interpolated").select(
        F.lit("code").alias("src"), F.col("doc_id").alias("id"), "ordinal", T.literal_value("text", "kind").alias("text"))
    lit = stage(pages.unionByName(code).filter(~T.is_blank("text")), "literals")
    return K.flag_path_like(lit, listing).select("src", "id", "ordinal", "text", "is_path")


@register("q_report", f"""
WITH {O.pages_cte()}, {PAGE_CLS},
v AS (SELECT page_id, {O.first_line('text')} AS text, translatable FROM pcls2 WHERE NOT {O.blank('text')}),
per AS (SELECT page_id,
          count(DISTINCT text) FILTER (WHERE translatable) AS n_translate,
          count(DISTINCT text) FILTER (WHERE NOT translatable) AS n_not,
          list_sort(list_distinct(list(text) FILTER (WHERE translatable))) AS yes,
          list_sort(list_distinct(list(text) FILTER (WHERE NOT translatable))) AS no
        FROM v GROUP BY page_id)
SELECT pg.page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '\\.[^.]*$', ''), '2+$', '') AS stem,
       'ok' AS status, CAST(coalesce(n_translate, 0) AS BIGINT) AS n_translate, CAST(coalesce(n_not, 0) AS BIGINT) AS n_not,
       CASE WHEN len(coalesce(yes, [])) > 0 THEN array_to_string(yes, chr(10)) ELSE '!zero elements' END AS to_translate,
       CASE WHEN len(coalesce(no, [])) > 0 THEN array_to_string(no, chr(10)) ELSE '!zero elements' END AS not_to_translate
FROM pg LEFT JOIN per USING (page_id)
""")
def q_report(spark, sf_dir):
    """SNK-03, AGG-01: per page, the sorted lists of texts to translate and not."""
    v = (_page_classified(spark, sf_dir).filter(~T.is_blank("text"))
         .select("page_id", T.first_line("text").alias("text"), "translatable"))
    return R.split_report(FX.pages(spark, sf_dir).select("page_id", "url"), v, ("page_id",), path_col="url")


# ---------------------------------------------------------------- keys and catalogs

_KEYS = (f"kd AS (SELECT lang, text, count(*) AS uses, min((doc_id, line_no)) AS first_seen FROM doc_texts GROUP BY lang, text), "
         f"kk AS (SELECT *, {O.pascal('text')} AS key FROM kd), "
         "keys AS (SELECT *, count(*) OVER (PARTITION BY lang, key) AS texts_per_key FROM kk WHERE length(key) > 0)")


@register("q_keys", f"""
WITH {O.doc_lines_cte()}, {_KEYS}
SELECT lang, text, key, uses, texts_per_key FROM keys
""")
def q_keys(spark, sf_dir):
    """STR-03: PascalCase key per distinct document line and how many texts share it."""
    return _doc_keys(spark, sf_dir).select("lang", "text", "key", "uses", "texts_per_key")


@register("q_key_conflicts", f"""
WITH {O.doc_lines_cte()}, {_KEYS},
sh AS (SELECT * FROM keys WHERE texts_per_key > 1),
w AS (SELECT lang, key, arg_min(text, (first_seen, text)) AS winner FROM sh GROUP BY lang, key)
SELECT sh.lang, sh.key, sh.text, w.winner FROM sh JOIN w USING (lang, key) WHERE sh.text <> w.winner
""")
def q_key_conflicts(spark, sf_dir):
    """Q12: texts that lose their key to an earlier text."""
    return C.key_conflicts(_doc_keys(spark, sf_dir))


_UPSERT = (f"r AS (SELECT lang, {O.pascal('text')} AS key, text AS target, doc_id, line_no FROM doc_texts), "
           "rows AS (SELECT * FROM r WHERE length(key) > 0), "
           "ex AS (SELECT lang, key, arg_min(target, (doc_id, line_no)) AS existing FROM rows "
           "WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang, key), "
           "win AS (SELECT lang, key, arg_min(target, (doc_id, line_no)) AS target, "
           "arg_min(doc_id, (doc_id, line_no)) AS doc_id, arg_min(line_no, (doc_id, line_no)) AS line_no "
           "FROM rows GROUP BY lang, key)")


def _upsert(spark, sf_dir):
    texts = FX.doc_texts(spark, sf_dir)     # lines are split twice; to write and read them would cost more
    labelled = texts.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    existing = C.first_wins(C.catalog_rows(labelled, order_cols=("doc_id", "line_no"), origin="existing"))
    batch = C.catalog_rows(texts, order_cols=("doc_id", "line_no"))
    return C.upsert_catalog(existing, batch, materialize=True)


@register("q_upsert", f"""
WITH {O.doc_lines_cte()}, {_UPSERT}
SELECT lang, key, target, doc_id, line_no FROM win ANTI JOIN ex USING (lang, key)
""")
def q_upsert(spark, sf_dir):
    """JN-02, SET-03: new document lines inserted into the catalog of labelled documents, first wins."""
    inserted, _ = _upsert(spark, sf_dir)
    return inserted.select("lang", "key", "target", F.col("seq.doc_id").alias("doc_id"),
                           F.col("seq.line_no").alias("line_no"))


@register("q_upsert_conflicts", f"""
WITH {O.doc_lines_cte()}, {_UPSERT}
SELECT w.lang, w.key, ex.existing AS kept, w.target AS dropped, 'catalog' AS against
FROM win w JOIN ex USING (lang, key) WHERE ex.existing <> w.target
UNION ALL
SELECT d.lang, d.key, w.target AS kept, d.target AS dropped, 'batch' AS against
FROM (SELECT DISTINCT lang, key, target FROM rows) d JOIN win w USING (lang, key) WHERE d.target <> w.target
""")
def q_upsert_conflicts(spark, sf_dir):
    """Q12: batch texts that lose their key, to the catalog or to an earlier batch text."""
    _, conflicts = _upsert(spark, sf_dir)
    return conflicts


_CAT_KEYS = (f"{O.code_cte()}, {_CONSTS}, "
             f"bal AS (SELECT doc_id FROM code WHERE {O.stray('content')} = 0), "
             f"{O.doc_lines_cte()}, {_KEYS}, "
             "cat AS (SELECT key FROM consts WHERE doc_id IN (SELECT doc_id FROM bal) "
             "UNION SELECT key FROM keys)")


def _catalog_and_constants(spark, sf_dir):
    """Catalog keys: constants migrated from balanced code files plus the keys of all document lines."""
    code = X.balance(FX.code_sources(spark, sf_dir)).select("doc_id", "content", "balanced")
    lines = to_lines(code, "content", keep=("doc_id", "balanced"))
    # the code view is made and tokenised once; what is read again are its constants
    constants = stage(X.extract_constants(lines, ("doc_id", "balanced")).select("doc_id", "balanced", "key"), "constants")
    ok = constants.filter("balanced").select("doc_id").distinct()
    migrated = constants.join(ok, "doc_id", "left_semi").select("key")
    return migrated.unionByName(C.key_set(FX.doc_texts(spark, sf_dir))), constants


@register("q_missing_constants", f"""
WITH {_CAT_KEYS}
SELECT DISTINCT key FROM cat WHERE key NOT IN (SELECT key FROM consts)
""")
def q_missing_constants(spark, sf_dir):
    """JN-03: catalog keys with no declared constant."""
    cat, constants = _catalog_and_constants(spark, sf_dir)
    return C.missing_constants(cat, constants)


@register("q_compare_keys", f"""
WITH {_CAT_KEYS},
a AS (SELECT DISTINCT key FROM cat), b AS (SELECT DISTINCT key FROM consts)
SELECT coalesce(a.key, b.key) AS key,
       CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN 'both' WHEN a.key IS NOT NULL THEN 'only_catalog'
            ELSE 'only_constants' END AS side
FROM a FULL OUTER JOIN b ON a.key = b.key
""")
def q_compare_keys(spark, sf_dir):
    """SET-04: catalog keys against declared constants."""
    cat, constants = _catalog_and_constants(spark, sf_dir)
    return C.compare_keys(cat, constants)


@register("q_render", f"""
WITH {_CAT_KEYS},
m AS (SELECT DISTINCT key FROM cat WHERE key NOT IN (SELECT key FROM consts))
SELECT key, {O.const_decl('key')} AS declaration, {O.lookup('key')} AS lookup FROM m
""")
def q_render(spark, sf_dir):
    """STR-04/05, SNK-04: declarations and lookups for the missing constants."""
    cat, constants = _catalog_and_constants(spark, sf_dir)
    return C.render_declarations(C.missing_constants(cat, constants))


@register("q_trim", f"""
WITH {O.doc_lines_cte()},
u AS (SELECT doc_id, line_no, CASE WHEN line_no = 1 THEN chr(160) || text || chr(9) ELSE text END AS target FROM doc_texts)
SELECT doc_id, line_no, {O.ws_trim('target')} AS target, target <> {O.ws_trim('target')} AS changed FROM u
""")
def q_trim(spark, sf_dir):
    """STR-01: catalog texts trimmed of Unicode white space; first lines carry stray padding."""
    u = FX.doc_texts(spark, sf_dir).select(
        "doc_id", "line_no",
        F.when(F.col("line_no") == 1, F.concat(F.lit("\u00a0"), F.col("text"), F.lit("\t")))
         .otherwise(F.col("text")).alias("target"))
    return C.trim_units(u, cols=("target",)).select("doc_id", "line_no", "target", "changed")


# ---------------------------------------------------------------- language, memory, routing

@register("q_lang_detect", f"""
WITH {O.profiles_cte('documents', 'lang', 'text')}, {O.detect_cte('det', 'documents', ['doc_id'], 'text')}
SELECT det.doc_id, d.lang, det.detected, det.hits FROM det JOIN documents d USING (doc_id)
""")
def q_lang_detect(spark, sf_dir):
    """LNG-01: language of every document from the top-50 token profiles."""
    docs = FX.documents(spark, sf_dir)
    profiles = L.build_profiles(docs, 50)
    det = L.detect_language(docs, profiles, ("doc_id",))
    return det.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "detected", "hits")


_MEM = (f"{O.doc_lines_cte()}, "
        "cl AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, "
        "CAST(generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS BIGINT) AS line_no, "
        "unnest(string_split_regex(text, '\\r?\\n')) AS text FROM conversations), "
        f"ut AS (SELECT * FROM cl WHERE NOT {O.blank('text')} "
        "UNION ALL SELECT doc_id, -1, line_no, text FROM doc_texts WHERE doc_id IN (SELECT doc_id FROM labels)), "
        "ml AS (SELECT doc_id AS conv_id, line_no AS turn, line AS text FROM doc_lines WHERE doc_id NOT IN (SELECT doc_id FROM labels)), "
        "mem AS (SELECT s.text AS src_text, arg_min(n.text, (s.conv_id, s.turn)) AS tgt_text FROM ml s "
        "JOIN ml n ON n.conv_id = s.conv_id AND n.turn = s.turn + 1 GROUP BY s.text)")
_TEXT_IDS = ["conv_id", "turn", "line_no"]


def _texts_and_memory(spark, sf_dir):
    """Texts to look up, and a memory made from other documents; both are read by several branches."""
    texts = stage(FX.lookup_texts(spark, sf_dir), "texts")
    memory = stage(M.memory_from_turns(FX.aligned_lines(spark, sf_dir)), "memory")
    return texts, memory


def _profiles(spark, sf_dir):
    return stage(L.build_profiles(FX.documents(spark, sf_dir), 50), "profiles")


@register("q_memory", f"""
WITH {_MEM}
SELECT ut.conv_id, ut.turn, ut.line_no, ut.text, {O.carry_capital('ut.text', 'mem.tgt_text')} AS translation
FROM ut JOIN mem ON ut.text = mem.src_text
""")
def q_memory(spark, sf_dir):
    """JN-04, STR-02: lines found in the translation memory, capital carried over."""
    translated, _ = M.translate_from_memory(*_texts_and_memory(spark, sf_dir))
    return translated.select(*_TEXT_IDS, "text", "translation")


@register("q_untranslated", f"""
WITH {_MEM}
SELECT conv_id, turn, line_no, text FROM ut WHERE text NOT IN (SELECT src_text FROM mem)
""")
def q_untranslated(spark, sf_dir):
    """JN-04: lines with no memory hit."""
    _, missing = M.translate_from_memory(*_texts_and_memory(spark, sf_dir))
    return missing.select(*_TEXT_IDS, "text")


_MASK = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({t}), '\{{[^{{}}]*\}}|%[0-9]*[sd]', '{{}}', 'g'), '[0-9]+(?:[.,][0-9]+)*', '0', 'g'), '\s+', ' ', 'g'))"
_NUMBERS = "regexp_extract_all({c}, '[0-9]+(?:[.,][0-9]+)*')"


@register("q_memory_near", f"""
WITH {_MEM},
asked AS (SELECT DISTINCT text, {_MASK.format(t='text')} AS mask FROM ut WHERE text NOT IN (SELECT src_text FROM mem)),
known AS (SELECT mask, min((src_text, tgt_text)) AS m FROM (SELECT *, {_MASK.format(t='src_text')} AS mask FROM mem WHERE NOT {O.blank('src_text')}) GROUP BY mask),
am AS (SELECT mask, list_distinct(regexp_extract_all(mask, '[\\p{{L}}\\p{{N}}]+|\\{{\\}}')) AS ws FROM (SELECT DISTINCT mask FROM asked) WHERE mask NOT IN (SELECT mask FROM known)),
km AS (SELECT mask, list_distinct(regexp_extract_all(mask, '[\\p{{L}}\\p{{N}}]+|\\{{\\}}')) AS ws FROM known),
pair AS (SELECT a.mask AS am, k.mask AS km, count(*) AS shared, any_value(a.n) + any_value(k.n) AS total
         FROM (SELECT mask, unnest(ws) AS w, len(ws) AS n FROM am) a JOIN (SELECT mask, unnest(ws) AS w, len(ws) AS n FROM km) k
           ON a.w = k.w AND a.n * 100 >= k.n * 60 AND k.n * 100 >= a.n * 60 GROUP BY a.mask, k.mask),
close AS (SELECT am, km, levenshtein(am, km) AS d, greatest(octet_length(encode(am)), octet_length(encode(km))) AS longer FROM pair WHERE shared * 160 >= total * 60),
best AS (SELECT am AS mask, min((ceil(d * 100 / longer)::BIGINT - 100, km)) AS b FROM close WHERE d * 100 <= longer * 30 GROUP BY am),
hit AS (SELECT mask, -b[1] AS score, b[2] AS km FROM best UNION ALL SELECT DISTINCT mask, 100, mask FROM asked WHERE mask IN (SELECT mask FROM known)),
f AS (SELECT asked.text, k.m[1] AS match, score, k.m[2] AS tgt FROM asked JOIN hit USING (mask) JOIN known k ON k.mask = hit.km),
g AS (SELECT *, {_NUMBERS.format(c='match')} AS nm, {_NUMBERS.format(c='text')} AS nt, {_NUMBERS.format(c='tgt')} AS ng,
             string_split_regex(tgt, '[0-9]+(?:[.,][0-9]+)*') AS gaps FROM f),
h AS (SELECT *, CASE WHEN len(nm) = len(nt) THEN array_to_string(list_transform(range(1, len(gaps) + 1), lambda i:
             gaps[i] || coalesce(CASE WHEN list_contains(nm, ng[i]) THEN nt[list_position(nm, ng[i])] ELSE ng[i] END, '')), '') ELSE tgt END AS filled FROM g)
SELECT text, match, score::BIGINT AS score, {O.carry_capital('text', 'filled')} AS translation FROM h
""")
def q_memory_near(spark, sf_dir):
    """JN-04 beyond equal texts: for every line that the memory lacks, its nearest source text with the numbers carried over."""
    from locflow.operators.near_memory import near_matches
    texts, memory = _texts_and_memory(spark, sf_dir)
    _, missing = M.translate_from_memory(texts, memory)
    return near_matches(missing, memory)


@register("q_lang_short", f"""
WITH {O.doc_lines_cte()},
clean AS (SELECT 'train' AS part, 0 AS line_no, doc_id, lang, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS t
          FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang IS NOT NULL
          UNION ALL SELECT 'ask', line_no, doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ' FROM doc_texts),
split AS (SELECT part, doc_id, line_no, lang, regexp_extract_all(t, '(?s).') AS cs FROM clean),
grams AS (SELECT part, doc_id, line_no, lang, unnest(list_transform(range(1, len(cs) - 1), lambda i: cs[i] || cs[i + 1] || cs[i + 2])) AS gram FROM split),
c AS (SELECT lang, gram, count(*) AS c FROM grams WHERE part = 'train' GROUP BY lang, gram),
tot AS (SELECT lang, sum(c) AS total, count(*) AS kinds FROM c GROUP BY lang),
top AS (SELECT lang, gram, floor(ln((c + 1)::DOUBLE) * 1000)::BIGINT AS weight
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, gram) AS r FROM c) WHERE r <= 1500),
seen AS (SELECT doc_id, line_no, top.lang, sum(weight) AS s FROM grams JOIN top USING (gram) WHERE part = 'ask' GROUP BY ALL),
n AS (SELECT doc_id, line_no, count(*) AS n FROM grams WHERE part = 'ask' GROUP BY ALL),
score AS (SELECT n.doc_id, n.line_no, tot.lang, coalesce(s, 0) - n * floor(ln((total + kinds)::DOUBLE) * 1000)::BIGINT AS score
          FROM n CROSS JOIN tot LEFT JOIN seen ON seen.doc_id = n.doc_id AND seen.line_no = n.line_no AND seen.lang = tot.lang),
best AS (SELECT doc_id, line_no, list(lang ORDER BY score DESC, lang) AS langs, list(score ORDER BY score DESC) AS scores FROM score GROUP BY ALL)
SELECT d.doc_id, d.line_no, d.lang, CASE WHEN scores[1] - scores[2] >= 3000 THEN langs[1] ELSE 'und' END AS detected,
       coalesce(scores[1] - scores[2], 0)::BIGINT AS lead
FROM doc_texts d LEFT JOIN best USING (doc_id, line_no)
""")
def q_lang_short(spark, sf_dir):
    """LNG-01 by trigrams: profiles of the documents without a label, asked for every line of all documents."""
    from locflow.operators.short_language import build_gram_profiles, detect_short
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    profiles = stage(build_gram_profiles(FX.documents(spark, sf_dir).join(labels, "doc_id", "left_anti")), "grams")
    texts = FX.doc_texts(spark, sf_dir)
    det = detect_short(texts, profiles, ("doc_id", "line_no"))
    return texts.select("doc_id", "line_no", "lang").join(det, ["doc_id", "line_no"])


# A turn of the system is English whatever its words look like: the override of STM-04.
_OVERRIDE = "CASE WHEN ut.turn = 0 THEN 'en' ELSE det.detected END"


@register("q_bilingual", f"""
WITH {_MEM}, {O.profiles_cte('documents', 'lang', 'text')}, {O.detect_cte('det', 'ut', _TEXT_IDS, 'text')},
t AS (SELECT ut.conv_id, ut.turn, ut.line_no, ut.text, {_OVERRIDE} AS lang,
             {O.carry_capital('ut.text', 'mem.tgt_text')} AS translation
      FROM ut JOIN det USING (conv_id, turn, line_no) LEFT JOIN mem ON ut.text = mem.src_text),
k AS (SELECT *, {O.pascal(f"CASE WHEN translation IS NULL OR {O.blank('translation')} THEN text ELSE translation END")} AS key FROM t),
r AS (SELECT conv_id, turn, line_no, key, lang, text AS target FROM k
      UNION ALL
      SELECT conv_id, turn, line_no, key, 'en' AS lang, translation AS target FROM k
      WHERE lang <> 'en' AND translation IS NOT NULL AND NOT {O.blank('translation')})
SELECT * FROM r
""")
def q_bilingual(spark, sf_dir):
    """JN-05, STM-04: lines routed to catalog rows by language (pivot ``en``); first turns override the detection."""
    texts, mem = _texts_and_memory(spark, sf_dir)
    texts = texts.withColumn("forced", F.when(F.col("turn") == 0, F.lit("en")))
    det = L.detect_language(texts, _profiles(spark, sf_dir), _TEXT_IDS, override_col="forced")
    t = (M.lookup_memory(texts.drop("forced"), mem).join(det, _TEXT_IDS)
          .withColumn("key", T.key_for("text", "translation"))
          .select(*_TEXT_IDS, "key", F.col("detected").alias("lang"), "text", "translation"))
    return C.to_catalog_rows(t).select(*_TEXT_IDS, "key", "lang", "target")


@register("q_new_captures", f"""
WITH {O.doc_lines_cte()}, {_KEYS},
cap AS (SELECT conv_id, turn, CAST(generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS BIGINT) AS line_no,
               unnest(string_split_regex(text, '\\r?\\n')) AS captured FROM conversations),
cl AS (SELECT conv_id, turn, line_no, regexp_replace(regexp_replace(captured, '^"+|"+$', '', 'g'), ':+$', '') AS text FROM cap),
ck AS (SELECT *, {O.pascal('text')} AS key FROM cl WHERE NOT {O.blank('text')})
SELECT conv_id, turn, line_no, text, key, key IN (SELECT key FROM keys) AS known FROM ck WHERE length(key) > 0
""")
def q_new_captures(spark, sf_dir):
    """STR-06, STM-01 (batch twin of the stream): captured lines cleaned and keyed, and whether ``new_captures``
    keeps them next to the catalog keys."""
    from locflow.streaming.captures import clean_captures, new_captures
    caps = FX.capture_lines(spark, sf_dir)
    known = stage(C.key_set(FX.doc_texts(spark, sf_dir)), "known")
    fresh = new_captures(caps, known, "captured").select("conv_id", "turn", "line_no", F.lit(False).alias("_new"))
    cl = clean_captures(caps, "captured").join(fresh, ["conv_id", "turn", "line_no"], "left")
    return cl.select("conv_id", "turn", "line_no", F.col("cleaned").alias("text"), "key",
                     F.coalesce("_new", F.lit(True)).alias("known"))


# ---------------------------------------------------------------- rewrite, review

@register("q_rewrite", f"""
WITH t AS (SELECT page_id, regexp_extract_all(html, {O.q(O.TOKENS['markup'])}) AS toks,
                  string_split_regex(html, {O.q(O.TOKENS['markup'])}) AS gaps FROM pages),
x AS (SELECT page_id, unnest(gaps) AS gap, generate_subscripts(gaps, 1) AS i, toks FROM t),
y AS (SELECT page_id, i, gap, CASE WHEN i <= len(toks) THEN toks[i] END AS tok FROM x),
z AS (SELECT *, substr(tok, 2, length(tok) - 2) AS inner_text FROM y),
r AS (SELECT page_id, i, gap, tok,
        CASE WHEN tok IS NOT NULL AND starts_with(inner_text, '/') AND length({O.pascal('inner_text')}) > 0
             THEN {O.lookup(O.pascal('inner_text'))} END AS rep FROM z)
SELECT page_id, string_agg(gap || coalesce(rep, tok, ''), '' ORDER BY i) AS rewritten,
       CAST(count(rep) AS BIGINT) AS replaced
FROM r GROUP BY page_id
""")
def q_rewrite(spark, sf_dir):
    """JN-06, SNK-02: pages with every literal that starts with ``/`` replaced by its lookup."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return W.rewrite_sources(p, select=lambda t: t.startswith("/"), text_col="html",
                             profile="markup").select("page_id", "rewritten", "replaced")


@register("q_review", """
WITH a AS (SELECT event_id, user_id AS actor, ts,
                  CASE event_type WHEN 'view' THEN 'propose' WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'decline' END AS action
           FROM events WHERE event_type IN ('view', 'purchase', 'error')),
p AS (SELECT *, lag(action) OVER (PARTITION BY actor ORDER BY ts, event_id) AS prev FROM a)
SELECT event_id, actor, action,
  CASE WHEN action = 'propose' THEN CASE WHEN prev = 'propose' THEN 'rejected_busy' ELSE 'opened' END
       WHEN action = 'accept' THEN CASE WHEN prev = 'propose' THEN 'accepted' ELSE 'ignored' END
       ELSE CASE WHEN prev = 'propose' THEN 'declined' ELSE 'ignored' END END AS outcome
FROM p
""")
def q_review(spark, sf_dir):
    """STM-03 (batch form): one-slot review outcomes per actor over ``events``."""
    acts = V.actions_from_events(table(spark, sf_dir, "events"))
    return V.review_outcomes(acts).select("event_id", "actor", "action", "outcome")


# ---------------------------------------------------------------- flows

_FLOW_BASE = (f"{O.code_cte()}, {CODE_LITS}, "
              f"bal AS (SELECT doc_id FROM code WHERE {O.stray('content')} = 0), "
              f"val AS (SELECT doc_id, ordinal, {O.literal_value('kind', 'text')} AS text, context FROM lit "
              "WHERE kind IN ('regular', 'verbatim') AND NOT wrapped AND doc_id IN (SELECT doc_id FROM bal)), "
              f"cand AS (SELECT * FROM val WHERE NOT {O.blank('text')}), "
              f"{DOC_STOP}, "
              f"cls0 AS (SELECT c.*, {O.reason('c.text', O.place_rules())} = 'text' AS translatable FROM cand c LEFT JOIN stop s ON c.text = s.token), "
              f"{O.split_cte('cls', 'cls0')}")


@register("q_split_files", f"""
WITH {_FLOW_BASE},
per AS (SELECT doc_id,
          count(DISTINCT text) FILTER (WHERE translatable) AS n_translate,
          count(DISTINCT text) FILTER (WHERE NOT translatable) AS n_not,
          list_sort(list_distinct(list(text) FILTER (WHERE translatable))) AS yes,
          list_sort(list_distinct(list(text) FILTER (WHERE NOT translatable))) AS no
        FROM (SELECT doc_id, split_part(CASE WHEN translatable THEN core ELSE text END, chr(10), 1) AS text, translatable FROM cls) GROUP BY doc_id),
st AS (SELECT doc_id, path, doc_id NOT IN (SELECT doc_id FROM bal) AS rej FROM code)
SELECT st.doc_id, regexp_replace(regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '\\.[^.]*$', ''), '2+$', '') AS stem,
       CASE WHEN rej THEN 'unbalanced' ELSE 'ok' END AS status,
       CAST(coalesce(n_translate, 0) AS BIGINT) AS n_translate, CAST(coalesce(n_not, 0) AS BIGINT) AS n_not,
       CASE WHEN len(coalesce(yes, [])) > 0 THEN array_to_string(yes, chr(10)) WHEN rej THEN '!null' ELSE '!zero elements' END AS to_translate,
       CASE WHEN len(coalesce(no, [])) > 0 THEN array_to_string(no, chr(10)) WHEN rej THEN '!null' ELSE '!zero elements' END AS not_to_translate
FROM st LEFT JOIN per USING (doc_id)
""")
def q_split_files(spark, sf_dir):
    """Flow B on the code view: per file, texts to translate and not; unbalanced files marked."""
    from locflow.plans.flows import split_files
    _, report, _, _ = split_files(FX.code_sources(spark, sf_dir), K.stoplist(spark), ("doc_id",),
                                  path_col="path")
    return report


_KEPT = f"""
WITH {_FLOW_BASE}, {O.doc_lines_cte()},
pf AS (SELECT doc_id, text, core, bool_or(translatable) AS in_bet, bool_or(NOT translatable) AS in_not FROM cls GROUP BY doc_id, text, core),
dec AS (SELECT d.text, CASE WHEN l.toxic = 1 THEN 'manual_no' WHEN l.quality = 0 THEN 'auto_no' ELSE 'auto_yes' END AS verdict
        FROM doc_texts d JOIN labels l USING (doc_id)),
fl AS (SELECT text, bool_or(verdict = 'manual_no') AS manual_no, bool_or(verdict = 'auto_no') AS auto_no,
              bool_or(verdict = 'auto_yes') AS auto_yes FROM dec GROUP BY text),
kept0 AS (SELECT pf.doc_id, pf.text, {O.pascal(O.first_line('pf.core'))} AS key FROM pf LEFT JOIN fl USING (text)
          WHERE in_bet AND NOT coalesce(manual_no, false) AND NOT coalesce(auto_no, false)
            AND (NOT in_not OR coalesce(auto_yes, false))),
kept AS (SELECT * FROM kept0 WHERE length(key) > 0),
pos AS (SELECT c.doc_id, c.ordinal, k.key, c.core AS text, c.prefix, c.suffix, code.lang
        FROM cls c JOIN kept k USING (doc_id, text) JOIN code USING (doc_id)),
ex AS (SELECT lang, {O.pascal('text')} AS key, arg_min(text, (doc_id, line_no)) AS existing FROM doc_texts
       WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL),
win AS (SELECT lang, key, arg_min(text, (doc_id, ordinal)) AS target, arg_min(doc_id, (doc_id, ordinal)) AS doc_id,
               arg_min(ordinal, (doc_id, ordinal)) AS ordinal FROM pos GROUP BY lang, key)"""


def _labelled_catalog(spark, sf_dir):
    """First-wins catalog of the labelled documents' lines."""
    doc = FX.doc_texts(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    rows = C.catalog_rows(doc.join(labels, "doc_id", "left_semi"), order_cols=("doc_id", "line_no"), origin="existing")
    return C.first_wins(rows)


def _translated(spark, sf_dir, only):
    from locflow.plans.flows import translate_files
    return translate_files(FX.code_sources(spark, sf_dir), K.stoplist(spark), FX.labelled_decisions(spark, sf_dir),
                           _labelled_catalog(spark, sf_dir), ("doc_id",), only=only)


@register("q_translate_files", f"""{_KEPT},
t AS (SELECT doc_id, regexp_extract_all(content, {O.q(O.TOKENS['code'])}) AS toks,
             string_split_regex(content, {O.q(O.TOKENS['code'])}) AS gaps FROM code WHERE doc_id IN (SELECT doc_id FROM bal)),
x AS (SELECT doc_id, unnest(gaps) AS gap, generate_subscripts(gaps, 1) AS i, toks FROM t),
y AS (SELECT x.doc_id, x.i, x.gap, CASE WHEN x.i <= len(x.toks) THEN x.toks[x.i] END AS tok, p.key, p.prefix, p.suffix
      FROM x LEFT JOIN pos p ON p.doc_id = x.doc_id AND p.ordinal = x.i - 1)
SELECT doc_id, string_agg(gap || coalesce({O.split_lookup()}, tok, ''), '' ORDER BY i) AS rewritten,
       CAST(count(key) AS BIGINT) AS replaced
FROM y GROUP BY doc_id
""")
def q_translate_files(spark, sf_dir):
    """Flow A on the code view: kept literals replaced by their lookups, per balanced file."""
    return _translated(spark, sf_dir, "rewritten")[0].select("doc_id", "rewritten", "replaced")


@register("q_translate_inserted", f"""{_KEPT}
SELECT lang, key, target, doc_id, ordinal FROM win ANTI JOIN ex USING (lang, key)
""")
def q_translate_inserted(spark, sf_dir):
    """Flow A, JN-02: catalog rows that the kept literals add, with their whole values."""
    return _translated(spark, sf_dir, "catalog")[1].select("lang", "key", "target", F.col("seq.doc_id").alias("doc_id"),
                                                F.col("seq.ordinal").alias("ordinal"))


@register("q_translate_conflicts", f"""{_KEPT}
SELECT w.lang, w.key, ex.existing AS kept, w.target AS dropped, 'catalog' AS against
FROM win w JOIN ex USING (lang, key) WHERE ex.existing <> w.target
UNION ALL
SELECT d.lang, d.key, w.target, d.text, 'batch'
FROM (SELECT DISTINCT lang, key, text FROM pos) d JOIN win w USING (lang, key) WHERE d.text <> w.target
""")
def q_translate_conflicts(spark, sf_dir):
    """Flow A, Q12: literals whose key stands for another text."""
    return _translated(spark, sf_dir, "catalog")[2]


@register("q_translate_rejects", f"""
WITH {_FLOW_BASE}
SELECT doc_id, NULL::BIGINT AS ordinal, 'unbalanced' AS reason FROM code WHERE doc_id NOT IN (SELECT doc_id FROM bal)
UNION ALL
SELECT doc_id, ordinal, 'interpolated' FROM lit WHERE kind = 'interpolated' AND doc_id IN (SELECT doc_id FROM bal)
""")
def q_translate_rejects(spark, sf_dir):
    """Flow A, FLT-03: unbalanced files, and interpolated literals, which no lookup can stand for."""
    from locflow.plans.flows import split_files
    return split_files(FX.code_sources(spark, sf_dir), K.stoplist(spark), ("doc_id",))[2]


@register("q_escapes", f"""
WITH {O.code_cte()}, {CODE_LITS},
v AS (SELECT doc_id, ordinal, kind, text, raw, {O.literal_value('kind', 'text')} AS value FROM lit WHERE kind IN ('regular', 'verbatim'))
SELECT doc_id, ordinal, kind, text, value, '"' || {O.escape('value')} || '"' AS regular,
       CASE WHEN regexp_matches(raw, '^"(\\\\\\\\){{1,4}}"$') THEN '@"' || substr(raw, 2, (length(raw) - 2) // 2) || '"' ELSE raw END AS normalised
FROM v
""")
def q_escapes(spark, sf_dir):
    """STR-07/08/09: every code literal's value, its regular form, and its all-backslash form both ways."""
    lit = _code_literals(spark, sf_dir, positions=False).filter(F.col("kind") != "interpolated")
    return lit.select("doc_id", "ordinal", "kind", "text", T.literal_value("text", "kind").alias("value"),
                      T.regular_form("text", "kind").alias("regular"), T.backslash_verbatim("raw").alias("normalised"))


@register("q_normalise_escapes", f"""
WITH {O.code_cte()},
t AS (SELECT doc_id, regexp_extract_all(content, {O.q(O.TOKENS['code'])}) AS toks,
             string_split_regex(content, {O.q(O.TOKENS['code'])}) AS gaps FROM code),
x AS (SELECT doc_id, unnest(gaps) AS gap, generate_subscripts(gaps, 1) AS i, toks FROM t),
y AS (SELECT doc_id, i, gap, CASE WHEN i <= len(toks) THEN toks[i] END AS tok FROM x)
SELECT doc_id, string_agg(gap || coalesce(CASE WHEN regexp_matches(tok, '^"(\\\\\\\\){{1,4}}"$')
         THEN '@"' || substr(tok, 2, (length(tok) - 2) // 2) || '"' ELSE tok END, ''), '' ORDER BY i) AS content
FROM y GROUP BY doc_id
""")
def q_normalise_escapes(spark, sf_dir):
    """STR-07: every code file with its all-backslash literals in verbatim form."""
    return X.normalise_escapes(FX.code_sources(spark, sf_dir)).select("doc_id", "content")


_ADDED = f"""
WITH {_MEM}, {O.profiles_cte('documents', 'lang', 'text')}, {O.detect_cte('det', 'ut', _TEXT_IDS, 'text')},
known AS (SELECT DISTINCT {O.pascal('text')} AS key FROM doc_texts WHERE line_no = 1),
t AS (SELECT ut.conv_id, ut.turn, ut.line_no, ut.text, det.detected AS lang,
             {O.carry_capital('ut.text', 'mem.tgt_text')} AS translation
      FROM ut JOIN det USING (conv_id, turn, line_no) LEFT JOIN mem ON ut.text = mem.src_text),
k0 AS (SELECT *, {O.pascal(f"CASE WHEN translation IS NULL OR {O.blank('translation')} THEN text ELSE translation END")} AS key FROM t),
k AS (SELECT * FROM k0 WHERE length(key) > 0 AND key NOT IN (SELECT key FROM known)),
r0 AS (SELECT conv_id, turn, line_no, key, lang, text AS target FROM k
       UNION ALL
       SELECT conv_id, turn, line_no, key, 'en' AS lang, translation AS target FROM k
       WHERE lang <> 'en' AND translation IS NOT NULL AND NOT {O.blank('translation')}),
r AS (SELECT * FROM r0 WHERE NOT {O.blank('target')}),
win AS (SELECT lang, key, arg_min(target, (conv_id, turn, line_no)) AS target, min((conv_id, turn, line_no)) AS seq
        FROM r GROUP BY lang, key),
ex AS (SELECT lang, {O.pascal('text')} AS key, arg_min(text, (doc_id, line_no)) AS existing FROM doc_texts
       WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL)"""


def _added(spark, sf_dir):
    from locflow.plans.flows import add_texts
    texts = stage(FX.lookup_texts(spark, sf_dir), "texts")
    mem = M.memory_from_turns(FX.aligned_lines(spark, sf_dir))      # read once, as its aggregation has dealt it
    doc = FX.doc_texts(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    rows = C.catalog_rows(doc.join(labels, "doc_id", "left_anti"), order_cols=("doc_id", "line_no"), origin="existing")
    catalog = C.first_wins(rows.select("lang", "key", "target", "seq"))
    constants = C.key_set(doc.filter(F.col("line_no") == 1))
    return add_texts(texts, catalog, constants, mem, _profiles(spark, sf_dir), id_cols=_TEXT_IDS)


@register("q_add_texts", f"""{_ADDED}
SELECT lang, key, target, seq[1] AS conv_id, seq[2] AS turn, seq[3] AS line_no FROM win ANTI JOIN ex USING (lang, key)
""")
def q_add_texts(spark, sf_dir):
    """Flow C: lines of turns and of labelled documents → language → memory → keys → known-key test against the
    constants declared for first lines → routed rows, inserted first-wins into the catalog of the other documents."""
    return _added(spark, sf_dir)[0].select("lang", "key", "target", *(F.col(f"seq.{c}").alias(c) for c in _TEXT_IDS))


@register("q_add_texts_conflicts", f"""{_ADDED}
SELECT w.lang, w.key, ex.existing AS kept, w.target AS dropped, 'catalog' AS against FROM win w JOIN ex USING (lang, key) WHERE ex.existing <> w.target
UNION ALL
SELECT d.lang, d.key, w.target, d.target, 'batch'
FROM (SELECT DISTINCT lang, key, target FROM r) d JOIN win w USING (lang, key) WHERE d.target <> w.target
""")
def q_add_texts_conflicts(spark, sf_dir):
    """Flow C, Q12: texts whose key stands for another text, in the catalog or earlier in the batch."""
    return _added(spark, sf_dir)[1]


@register("q_add_texts_constants", f"""{_ADDED}
SELECT DISTINCT key, {O.const_decl('key')} AS declaration FROM win ANTI JOIN ex USING (lang, key)
""")
def q_add_texts_constants(spark, sf_dir):
    """Flow C, STR-05: the constants to declare for what was inserted."""
    return _added(spark, sf_dir)[2]


@register("q_insert_declarations", f"""
WITH {O.code_cte()}, {_CONSTS}, {O.doc_lines_cte()},
k AS (SELECT DISTINCT doc_id, {O.pascal('text')} AS key FROM doc_texts),
f AS (SELECT doc_id, min(line_no) AS first FROM consts GROUP BY doc_id)
SELECT doc_id, line_no AS pos, 1 AS sub, '' AS key, line FROM code_lines
UNION ALL
SELECT doc_id, first, 0, key, {O.const_decl('key')} FROM k JOIN f USING (doc_id) WHERE length(key) > 0
""")
def q_insert_declarations(spark, sf_dir):
    """SNK-04: declarations for the keys of a document's lines put before the first constant of its code file; the ordered lines."""
    lines = FX.code_lines(spark, sf_dir)
    first = X.first_constants(X.extract_constants(lines, ("doc_id",)), ("doc_id",))
    keys = FX.doc_texts(spark, sf_dir).filter(T.has_key("text")).select("doc_id", T.pascal_key("text").alias("key")).distinct()
    decls = keys.select("doc_id", "key", T.const_decl("key").alias("declaration"))
    return C.insert_declarations(lines, decls, first, path_col="doc_id")


@register("q_xliff_roundtrip", f"""
WITH {O.doc_lines_cte()},
r AS (SELECT lang, {O.pascal('text')} AS key, text AS target, doc_id, line_no FROM doc_texts)
SELECT lang, key, arg_min(target, (doc_id, line_no)) AS target FROM r WHERE length(key) > 0 GROUP BY lang, key
""")
def q_xliff_roundtrip(spark, sf_dir):
    """SNK-01, SRC-03/04, SET-03: the first-wins catalog of all document lines written as XLIFF parts
    into the session's checkpoint folder and read back through the XML source."""
    from locflow.sources import xliff
    path = _folder(spark, "xliff")
    rows = C.catalog_rows(FX.doc_texts(spark, sf_dir), order_cols=("doc_id", "line_no"))
    catalog = stage(C.first_wins(rows.select("lang", "key", "target", "translate", "seq")).drop("seq"), "catalog")
    xliff.write_catalog(catalog.withColumn("source", F.col("target")), path, compression="gzip")    # a text is its own source
    back, _ = xliff.read_catalogs(spark, path, tags=("en", "fr", "de", "es"), glob="part-*",
                                  lang_from="attribute")
    return back.select("lang", "key", "target")


@register("q_xliff_named", f"""
WITH {O.doc_lines_cte()},
r AS (SELECT lang, {O.pascal('text')} AS key, text AS target, doc_id, line_no,
             CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END AS part FROM doc_texts)
SELECT lang, key, arg_min(target, (part, doc_id, line_no)) AS target FROM r
WHERE length(key) > 0 AND lang IN ('en', 'de') GROUP BY lang, key
""")
def q_xliff_named(spark, sf_dir):
    """SRC-01..04: catalogs named by language, several files each (documents without a label in one folder, labelled
    ones in the next), read back by name: all files of a language, first wins, other tags set aside."""
    from locflow.sources import xliff
    path = _folder(spark, "named")
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("part", F.lit(1))
    doc = FX.doc_texts(spark, sf_dir).join(labels, "doc_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    rows = C.catalog_rows(doc, order_cols=("part", "doc_id", "line_no")).where("lang in ('en', 'de', 'fr')")
    # the first of each folder and language, found at once
    won = rows.groupBy("seq.part", "lang", "key").agg(F.min(F.struct("seq", "target", "translate")).alias("w"))
    won = stage(won.select("part", "lang", "key", "w.target", "w.translate"), "units").withColumn("source", F.col("target"))
    for part in (0, 1):
        for lang in ("en", "de", "fr"):     # fr is not among the tags asked for
            own = won.filter((F.col("part") == part) & (F.col("lang") == lang)).drop("part")
            xliff.write_catalog(own, f"{path}/{part}/app.{lang}-XX.xlf", buckets=4, compression="gzip")
    back, _ = xliff.read_catalogs(spark, path, tags=("en", "de"), glob="part-*", recursive=True)
    return back.select("lang", "key", "target")


_CATALOG_FILES = f"""
WITH {O.doc_lines_cte()},
r AS (SELECT lang, {O.pascal('text')} AS key, text AS target, 'app' || doc_id || '.' || lang || '-XX.xlf' AS file, line_no
      FROM doc_texts WHERE lang IS NOT NULL),
f AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang),
k AS (SELECT * FROM f WHERE lang IN ('en', 'de', 'fr'))
SELECT 'unit' AS what, lang, key, arg_min(target, (file, line_no)) AS target, 1::BIGINT AS n
FROM r WHERE length(key) > 0 AND lang IN ('en', 'de', 'fr') GROUP BY lang, key
UNION ALL SELECT 'listed', lang, '', '', n FROM k
UNION ALL SELECT 'catalog_name', lang, 'unknown language tag: ' || lang, '', n FROM f WHERE lang NOT IN ('en', 'de', 'fr')
UNION ALL SELECT 'catalog_scope', lang, 'out of scope: target-language ' || lang || '-XX, original APP/OTHER.RESX', '', n FROM k
UNION ALL SELECT 'catalog_element', lang, 'not the first element of its file', '', n FROM k
UNION ALL SELECT 'catalog_group', lang, 'groups after the first: 1', '', n FROM k
"""


def _catalog_files(spark, sf_dir, read):
    """Every document's catalog as a file of its own; what is listed, read and set aside, all in one table."""
    from locflow.sources import xliff
    from locflow.sources.tree import write_tree
    path = _folder(spark, "catalogs")
    write_tree(FX.document_catalogs(spark, sf_dir), path)
    tags = ("en", "de", "fr")
    catalog, rejects = read(spark, path, tags=tags)
    listed, _ = xliff.list_catalog_files(spark, path, tags=tags)
    nothing, one = F.lit(""), F.lit(1).cast("bigint")
    name = F.element_at(F.split("path", r"[.-]"), -3)
    return catalog.select(F.lit("unit").alias("what"), "lang", "key", "target", one.alias("n")).unionByName(
        listed.groupBy("lang").agg(F.count("*").alias("n")).select(F.lit("listed").alias("what"), "lang", nothing.alias("key"),
                                                                   nothing.alias("target"), "n")).unionByName(
        rejects.groupBy(F.col("stage").alias("what"), name.alias("lang"), F.col("detail").alias("key")).agg(F.count("*").alias("n")).select(
            "what", "lang", "key", nothing.alias("target"), "n"))


@register("q_catalog_files", _CATALOG_FILES)
def q_catalog_files(spark, sf_dir):
    """SRC-01..04, FLT-08, TOP-01: a folder of catalogs listed and read, first element and group, with all rejects."""
    from locflow.sources.xliff import read_catalogs
    return _catalog_files(spark, sf_dir, read_catalogs)


@register("q_catalog_units", _CATALOG_FILES)
def q_catalog_units(spark, sf_dir):
    """SRC-03 unit by unit: the same folder, cut at every unit by all splits (chunks of 3 units), gives the same."""
    from locflow.sources.xliff_units import read_units
    return _catalog_files(spark, sf_dir, lambda spark, path, tags: read_units(spark, path, tags, units_per_chunk=3))


@register("q_source_files", f"""
WITH {O.code_cte()},
f AS (SELECT doc_id, content || chr(10) AS content FROM code),
t AS (SELECT doc_id, content, regexp_extract_all(content, {O.q(O.TOKENS['code'])}) AS toks, {O.stray('content')} AS stray FROM f)
SELECT doc_id, CAST(length(content) AS BIGINT) AS n_chars, CAST(len(toks) AS BIGINT) AS n_tokens, stray = 0 AS balanced
FROM t
""")
def q_source_files(spark, sf_dir):
    """SRC-05/06, FLT-07: the code view written as one file per document, all in one folder, read back whole
    (recursive listing, glob filter) and tokenised; a file's note names its document."""
    from locflow.sources.files import read_sources
    from locflow.sources.tree import write_tree
    path = _folder(spark, "sources")
    # staged and named by the tasks: Spark's own writer would have the driver rename one file after the other
    name = F.concat(F.concat_ws("-", F.lit("f"), F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string")), F.lit(".txt"))
    write_tree(FX.code_sources(spark, sf_dir).select(name.alias("path"), F.concat("content", F.lit("\n")).alias("content")), path)
    # a split holds some tens of small files; a task takes many splits, one after the other
    src = read_sources(spark, path, glob="*.txt").coalesce(spark.sparkContext.defaultParallelism * 8)
    doc_id = F.regexp_extract("content", r'// "note (-?[0-9]+)"', 1).cast("bigint")
    b = X.balance(src.withColumn("doc_id", doc_id))
    return b.select("doc_id", F.length("content").cast("bigint").alias("n_chars"), "n_tokens", "balanced")


@register("q_rewritten_files", f"""{_KEPT},
t AS (SELECT doc_id, path, regexp_extract_all(content, {O.q(O.TOKENS['code'])}) AS toks,
             string_split_regex(content, {O.q(O.TOKENS['code'])}) AS gaps FROM code WHERE doc_id IN (SELECT doc_id FROM bal)),
x AS (SELECT doc_id, path, unnest(gaps) AS gap, generate_subscripts(gaps, 1) AS i, toks FROM t),
y AS (SELECT x.doc_id, x.path, x.i, x.gap, CASE WHEN x.i <= len(x.toks) THEN x.toks[x.i] END AS tok, p.key, p.prefix, p.suffix
      FROM x LEFT JOIN pos p ON p.doc_id = x.doc_id AND p.ordinal = x.i - 1),
z AS (SELECT path, string_agg(gap || coalesce({O.split_lookup()}, tok, ''), '' ORDER BY i) AS body FROM y GROUP BY path)
SELECT path, octet_length(encode(body))::BIGINT AS bytes, sha256(body) AS sha256 FROM z
""")
def q_rewritten_files(spark, sf_dir):
    """SNK-02: the rewritten code files written one by one under their own paths, and read back as bytes."""
    from locflow.sources.tree import read_tree, write_tree
    rewritten = _translated(spark, sf_dir, "rewritten")[0]
    path = _folder(spark, "files")
    write_tree(rewritten, path, text_col="rewritten")
    return read_tree(spark, path).select("path", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@register("q_split_tokens", f"""
WITH {O.code_cte()}, {CODE_LITS}
SELECT kind, text, wrapped, count(*) AS n FROM lit GROUP BY ALL
""")
def q_split_tokens(spark, sf_dir):
    """SRC-05, EXT-01: the code view written as one large file per source and task, tokenised by splits at once (chunks of
    500 lines); the literals are those of the documents' own files."""
    from locflow.operators.splits import split_literals
    path = _folder(spark, "large")
    (FX.code_sources(spark, sf_dir).select(F.regexp_extract("path", "src/([^/]*)/", 1).alias("source"), "content")
        .write.partitionBy("source").text(path))
    lit, _ = split_literals(spark, path, glob="*.txt", chunk_lines=500, only_balanced=False)
    return lit.groupBy("kind", "text", "wrapped").agg(F.count("*").alias("n"))


def _folder(spark, name):
    """A fresh folder under the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise RuntimeError(f"set spark.checkpoint.dir to a shared folder: the {name} files are written there")
    return f"{base.rstrip('/')}/locflow-{name}-{uuid.uuid4().hex}"


_PROP = ("'public static string ' || regexp_extract(l, " + O.q(O.CONST_LINE) + ", 1) || ' { get { return ' || "
         + O.lookup("regexp_extract(l, " + O.q(O.CONST_LINE) + ", 1)") + " || '; } }'")


@register("q_migrate_constants", f"""
WITH {O.code_cte()},
m AS (SELECT doc_id, string_split_regex(content, chr(10)) AS ls FROM code),
n AS (SELECT doc_id, ls,
             list_position(list_transform(ls, lambda l: regexp_matches(l, {O.q(O.CONST_LINE)})), true) AS first,
             list_reverse(list_filter(list_transform(ls, lambda l: CASE WHEN regexp_matches(l, {O.q(O.CONST_LINE)})
                                                                   THEN {_PROP} END),
                                      lambda x: x IS NOT NULL)) AS props
      FROM m)
SELECT doc_id,
       CASE WHEN first IS NULL OR first = 0 THEN array_to_string(ls, chr(10))
            ELSE array_to_string(list_concat(ls[1:first - 1], [array_to_string(props, chr(10))],
                                             list_filter(ls[first + 1:], lambda l: NOT regexp_matches(l, {O.q(O.CONST_LINE)}))),
                                 chr(10)) END AS content
FROM n
""")
def q_migrate_constants(spark, sf_dir):
    """EXT-05: every code file with its constant declarations replaced by lookup properties at the first one."""
    return X.migrate_constants(FX.code_sources(spark, sf_dir)).select("doc_id", "content")


_MIGRATED = f"""
WITH {O.code_cte()}, {O.doc_lines_cte()}, {_CONSTS},
rows AS (SELECT code.lang, key, {O.unescape('value')} AS target, doc_id, line_no FROM consts JOIN code USING (doc_id)),
r AS (SELECT * FROM rows WHERE NOT {O.blank('target')}),
win AS (SELECT lang, key, arg_min(target, (doc_id, line_no)) AS target, arg_min(doc_id, (doc_id, line_no)) AS doc_id,
               arg_min(line_no, (doc_id, line_no)) AS line_no FROM r GROUP BY lang, key),
ex AS (SELECT lang, {O.pascal('text')} AS key, arg_min(text, (doc_id, line_no)) AS existing FROM doc_texts
       WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL)"""


@register("q_migrate_catalog", f"""{_MIGRATED}
SELECT lang, key, target, doc_id, line_no FROM win ANTI JOIN ex USING (lang, key)
""")
def q_migrate_catalog(spark, sf_dir):
    """EXT-05: the values of migrated constants as new catalog units under the constants' names."""
    from locflow.plans.flows import migrate_catalog
    _, inserted, _ = migrate_catalog(FX.code_sources(spark, sf_dir), _labelled_catalog(spark, sf_dir), ("doc_id",))
    return inserted.select("lang", "key", "target", F.col("seq.doc_id").alias("doc_id"), F.col("seq.line_no").alias("line_no"))


@register("q_migrate_conflicts", f"""
WITH {O.code_cte()}, {_CONSTS},
named AS (SELECT code.lang, regexp_extract(key, '^K[0-9]+') AS key, {O.unescape('value')} AS target, doc_id, line_no FROM consts JOIN code USING (doc_id)),
r AS (SELECT * FROM named WHERE NOT {O.blank('target')}),
win AS (SELECT lang, key, arg_min(target, (doc_id, line_no)) AS target FROM r GROUP BY lang, key)
SELECT d.lang, d.key, w.target AS kept, d.target AS dropped, 'batch' AS against
FROM (SELECT DISTINCT lang, key, target FROM r) d JOIN win w USING (lang, key) WHERE d.target <> w.target
""")
def q_migrate_conflicts(spark, sf_dir):
    """EXT-05, Q12: with one name for all constants of a file, the values that lose it to the file's first."""
    from locflow.plans.flows import migrate_catalog
    code = FX.code_sources(spark, sf_dir).withColumn("content", F.regexp_replace("content", r"(const string K[0-9]+)_[0-9]+ = ", "$1 = "))
    empty = C.first_wins(C.catalog_rows(FX.doc_texts(spark, sf_dir), order_cols=("doc_id", "line_no"))).limit(0)
    return migrate_catalog(code, empty, ("doc_id",))[2]
