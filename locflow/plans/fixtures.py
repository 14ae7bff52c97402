"""Inputs derived from the driver tables for the registered queries.

Every input here is computed by Spark from the whole tables, so its size
grows with them. Splits that a check needs (an existing catalog next to a new
batch, balanced next to unbalanced files) come from the data itself: labels,
digits in a text, language tags. Nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locflow.functions import text as T
from locflow.sources.files import to_lines
from locflow.sources.tables import table

# The `code` view. Each document becomes a C#-like file: a
# constant per line of its text (quotes and backslashes escaped), then lines
# that exercise comments of both kinds, character literals, preprocessor
# lines, escapes, verbatim, multi-line and interpolated strings (literals in their holes too), bold markup,
# an existing lookup, and every rule, place and vocabulary of the classifier. Documents whose text holds a digit also get a literal that
# never closes.
CODE_HEAD = ("namespace N {",)
CODE_TAIL = (
    'var u = "http://x/{id}" + "y{id}"; // tail "c"',
    'var e = "a\\"b{id}";',
    'var v = @"c:\\d{id}\\";',
    'var w = "<b>Item {id}</b>";',
    'var r = RLData.en["K{id}_1"];',
    'var m = @"First {id}\nsecond ""line"" of {id}";',
    'var f = $"Hello {name} {id}";',
    'var g = $@"Dir {name}\\{id}";',
    'var i = $"Is {(ok ? "yes {id}" : "no")} or {m["k\\""]:N1}, {(c == \'"\' ? 1 : 2)} {{{id}}}" + "then {id}";',
    'var s = "Tab\\there\\n\\u00e9\\x41\\U0001F600\\uD83D\\uDE00 \\\\ done\\0 {id} \\q\\uD800";',
    'var b = "\\\\\\\\" + @"\\\\" + "\\\\x";',
    'var n = "{id}.5" + "user_name{id}" + "*** --- ***" + "./up/{id}";',
    'var h = "href" + "table" + ".css" + "hidden" + "report{id}.xml" + "f{id}.cs";',
    'var k = "Saved.ok" + "Say \\"hi\\"" + "Label {id}:";',
    "char q = '\"'; var d = \"after {id}\"; char e = '\"', f2 = '\\'', g2 = '\\\\', h2 = '\\u0022';",
    '/* block "quoted {id}"\n it\'s "two" // lines **/ var p = "behind {id}"; // it\'s "one"',
    '#region don\'t "touch" {id}',
    'var t = a/"slash {id}"*2; /**/ var o = "/* no comment {id} */"; /***"x"***/',
    '  # endregion "',
    '[Obsolete("Use other {id}")]',
    'if (x.StartsWith("Pick {id}") || m["Item {id}"] == "Done {id}" && "Yes {id}" != y) Show("Pick {id}", /* and */ "Done {id}");',
    'switch (x) { case "Case {id}": Add(key, "Case {id}" + "tail {id}"); break; }',
    'w = w.Replace(\'a\', "Repl {id}").Replace("old {id}", "new {id}" + n);',
)
CODE_OPEN = 'var z = "open'
CODE_END = "}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, line_no, line)`` for every line of every document."""
    return to_lines(documents(spark, sf_dir).select("doc_id", "lang", "text"), "text",
                    keep=("doc_id", "lang"))


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank document lines as texts: ``(doc_id, lang, line_no, text)``."""
    return (doc_lines(spark, sf_dir).filter(~T.is_blank("line"))
            .withColumnRenamed("line", "text"))


def _fill(template: str, doc_id) -> F.Column:
    parts = template.split("{id}")
    out = [F.lit(parts[0])]
    for p in parts[1:]:
        out += [doc_id.cast("string"), F.lit(p)]
    return F.concat(*out)


def code_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``code`` view: ``(doc_id, lang, path, content)``."""
    # always dealt by id, whatever the input's size: the view is far larger and dearer to tokenise than its documents.
    # As many parts as a shuffle has, so that a join by file does not deal the far larger contents once more
    parts = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = documents(spark, sf_dir).repartition(parts, "doc_id")
    doc_id = F.col("doc_id")
    text = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    clean = F.split(text, "\r?\n", -1)
    consts = F.array_join(F.transform(clean, lambda l, i: F.concat(
        F.lit("    public const string K"), doc_id.cast("string"), F.lit("_"), (i + 1).cast("string"),
        F.lit(' = "'), l, F.lit('";'))), "\n")
    note = F.concat(F.lit('// "note '), doc_id.cast("string"), F.lit('"'))
    content = F.concat_ws("\n", *[F.lit(h) for h in CODE_HEAD], note, consts,
                          *[_fill(t, doc_id) for t in CODE_TAIL],
                          F.when(F.col("text").rlike("[0-9]"), F.lit(CODE_OPEN)), F.lit(CODE_END))
    path = F.concat(F.lit("src/"), F.col("source"), F.lit("/f"), doc_id.cast("string"), F.lit(".cs"))
    return d.select("doc_id", "lang", path.alias("path"), content.alias("content"))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_lines(code_sources(spark, sf_dir), "content", keep=("doc_id",))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with the page language from ``<html lang="..">``."""
    p = table(spark, sf_dir, "pages")
    return p.withColumn("page_lang", F.regexp_extract("html", '<html lang="([a-z]+)"', 1))


def labelled_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``decisions(text, verdict)`` from ``labels`` (SRC-08 input).

    Every line of a labelled document gets its document's verdicts:
    toxic → ``manual_no``; low quality, not toxic → ``auto_no``; good and not
    toxic → ``auto_yes``.
    """
    labels = table(spark, sf_dir, "labels")
    verdict = (F.when(F.col("toxic") == 1, "manual_no")
                .when(F.col("quality") == 0, "auto_no")
                .otherwise("auto_yes"))
    return (doc_texts(spark, sf_dir).join(labels, "doc_id")
            .select("text", verdict.alias("verdict")))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured texts: every line of every conversation turn."""
    c = conversations(spark, sf_dir).select("conv_id", "turn", "text")
    return (to_lines(c, "text", keep=("conv_id", "turn"), line_col="captured"))


def lookup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, line_no, text)``: every line of every turn, and of every labelled document (turn -1)."""
    turns = capture_lines(spark, sf_dir).filter(~T.is_blank("captured")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "line_no", F.col("captured").alias("text"))
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = doc_texts(spark, sf_dir).join(labels, "doc_id", "left_semi").select(
        F.col("doc_id").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"), "line_no", "text")
    return turns.unionByName(labelled)


def aligned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, role, text)`` for a memory: lines of the documents without a label, each before the next."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    rest = doc_lines(spark, sf_dir).join(labels, "doc_id", "left_anti")
    return rest.select(F.col("doc_id").alias("conv_id"), F.col("line_no").alias("turn"), F.lit("user").alias("role"),
                       F.col("line").alias("text"))


# A catalog of one document. An element out of scope, one with the document's units, a commented unit and
# a second group, and a later element.
CATALOG_HEAD = ('<?xml version="1.0" encoding="utf-8"?>\n<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2">\n'
                '<file original="APP/OTHER.RESX" source-language="en" target-language="{tag}" datatype="xml"><body><group id="A">'
                '<trans-unit id="Other"><source>o</source><target>o</target></trans-unit></group></body></file>\n'
                '<file original="APP/RESOURCES/R.RESX" source-language="en" target-language="{tag}" datatype="xml"><body>\n'
                '<group id="G"><!-- <trans-unit id="Gone"><source>g</source><target>g</target></trans-unit> -->\n')
CATALOG_TAIL = ('</group>\n<group id="H"><trans-unit id="Late"><source>l</source><target>l</target></trans-unit></group></body></file>\n'
                '<file original="APP/RESOURCES/S.RESX" source-language="en" target-language="{tag}" datatype="xml"><body>'
                '<trans-unit id="Later"><source>x</source><target>x</target></trans-unit></body></file>\n</xliff>\n')


def document_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)``: per document a catalog file named by its language, its lines as units under their keys."""
    xml = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.split("text", "\r?\n", -1), T.has_key)
    unit = lambda l: F.concat(F.lit('<trans-unit id="'), T.pascal_key(l), F.lit('" translate="yes"><source>'), xml(l),
                              F.lit("</source><target>"), xml(l), F.lit("</target></trans-unit>\n"))
    tag = F.concat("lang", F.lit("-XX"))
    fill = lambda t: F.replace(F.lit(t), F.lit("{tag}"), tag)
    return documents(spark, sf_dir).where("lang is not null").select(
        F.concat(F.lit("app"), F.col("doc_id").cast("string"), F.lit("."), tag, F.lit(".xlf")).alias("path"),
        F.concat(fill(CATALOG_HEAD), F.array_join(F.transform(lines, unit), ""), fill(CATALOG_TAIL)).alias("content"))
