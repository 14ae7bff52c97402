"""File sources and sinks, and the three flows end to end on small fixtures."""

import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locflow.functions import text as T
from locflow.operators import catalog as C
from locflow.operators import classify as K
from locflow.operators import language as L
from locflow.operators import report as R
from locflow.plans import flows
from locflow.sources import files

CAT = "lang string, key string, source string, target string, translate boolean, origin string, seq struct<id:bigint>"


def _tree(tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "a", "b"))
    srcs = {"a/one.cs": 'class A { string s = "Hello world"; string t = "utf-8"; }\n',
            "a/b/two2.cs": 'var x = "Save file"; // "comment"\nvar y = RLData.en["K"];\n',
            "a/b/bad.cs": 'var z = "open\n',
            "a/skip.txt": '"not read"'}
    for p, body in srcs.items():
        with open(os.path.join(tmp_dir, p), "w") as f:
            f.write(body)
    return tmp_dir


def test_read_sources_whole_files(spark, tmp_dir):
    root = _tree(tmp_dir)
    df = files.read_sources(spark, root)
    names = sorted(os.path.basename(r.path) for r in df.collect())
    assert names == ["bad.cs", "one.cs", "two2.cs"]
    lines = files.to_lines(df)
    assert lines.filter(F.col("path").endswith("two2.cs")).count() == 3  # trailing newline → empty last line
    assert files.only_extension(df, ".txt").count() == 0


def test_flow_b_report_and_sinks(spark, tmp_dir):
    root = _tree(tmp_dir)
    src = files.read_sources(spark, root)
    classified, report, rejected, _ = flows.split_files(src, K.stoplist(spark), ("path",), path_col="path")
    rows = {r.stem: r for r in report.collect()}
    assert rows["one"].to_translate == "Hello world" and rows["one"].not_to_translate == "utf-8"
    assert rows["two"].to_translate == "Save file" and rows["two"].not_to_translate == R.ZERO_ELEMENTS
    assert rows["bad"].status == "unbalanced" and rows["bad"].to_translate == R.NULL_MARKER
    out = os.path.join(tmp_dir, "report")
    R.write_report(report, out)
    assert spark.read.json(out).count() == 3


def test_flow_a_rewrites_and_inserts(spark, tmp_dir):
    root = _tree(tmp_dir)
    src = files.read_sources(spark, root, lang="en")
    decisions = spark.createDataFrame([("Save file", "manual_no")], "text string, verdict string")
    empty = spark.createDataFrame([], "lang string, key string, source string, target string, translate boolean, "
                                      "origin string, seq struct<path:string,ordinal:bigint>")
    rewritten, inserted, conflicts, rejected = flows.translate_files(src, K.stoplist(spark), decisions, empty,
                                                                     materialize=True)
    got = {os.path.basename(r.path): r.rewritten for r in rewritten.collect()}
    assert got["one.cs"] == 'class A { string s = sess.i18n(XlfKeys.HelloWorld); string t = "utf-8"; }\n'
    assert got["two2.cs"].startswith('var x = "Save file";')  # manual_no keeps it
    assert "bad.cs" not in got
    assert [(r.lang, r.key, r.target) for r in inserted.collect()] == [("en", "HelloWorld", "Hello world")]
    assert conflicts.count() == 0 and rejected.count() == 1
    out = os.path.join(tmp_dir, "rewritten")
    files.write_sources(rewritten, out)
    assert spark.read.parquet(out).count() == 2


def test_flow_c_add_texts(spark, tmp_dir):
    texts = spark.createDataFrame([(1, "Ahoj svete"), (2, "Hello there"), (3, "Nashle")], "id long, text string")
    profiles = spark.createDataFrame([("cs", "ahoj", 1, 1), ("cs", "nashle", 1, 2), ("en", "hello", 1, 1)],
                                     "lang string, token string, n long, rank long")
    memory = spark.createDataFrame([("cs", "en", "Ahoj svete", "hello world")], "src_lang string, tgt_lang string, src_text string, tgt_text string")
    catalog = spark.createDataFrame([("en", "HelloThere", "x", "Hello there", True, "old", (0,))], CAT)
    constants = spark.createDataFrame([("HelloWorld",)], "key string")
    ins, conf, new_consts = flows.add_texts(texts, catalog, constants, memory, profiles)
    rows = sorted((r.lang, r.key, r.target) for r in ins.collect())
    assert rows == [("cs", "Nashle", "Nashle")]     # HelloWorld is a declared constant: known, not added
    assert conf.count() == 0
    assert [(r.key, r.declaration) for r in new_consts.collect()] == [("Nashle", 'public const string Nashle = "Nashle";')]
    none = spark.createDataFrame([], "key string")
    ins, _, new_consts = flows.add_texts(texts, catalog, none, memory, profiles,
                                         listing=spark.createDataFrame([("Nashle",)], "path string"))
    rows = sorted((r.lang, r.key, r.target) for r in ins.collect())
    assert rows == [("cs", "HelloWorld", "Ahoj svete"), ("en", "HelloWorld", "Hello world")]    # both rows, one key; no path
    assert [r.key for r in new_consts.collect()] == ["HelloWorld"]


LITERALS = r"""var a = @"First line
second line kept";
var b = $"Hello {name}";
var c = $@"Dir {name}\x"; var d = @$"Dir {name}";
var e = "Hello\nWorld";
var f = "Say \"hi\"";
var g = "Saved.ok";
var h = @"C:\dir\file"; var i = "report.xml";
"""


def test_flow_a_loses_nothing(spark):
    """Multi-line, escaped and interpolated literals: whatever is replaced has its whole value in the catalog."""
    src = spark.createDataFrame([("one", "en", LITERALS)], "path string, lang string, content string")
    empty = spark.createDataFrame([], "lang string, key string, source string, target string, translate boolean, "
                                      "origin string, seq struct<path:string,ordinal:bigint>")
    none = spark.createDataFrame([], "text string, verdict string")
    rewritten, inserted, conflicts, rejected = flows.translate_files(src, K.stoplist(spark), none, empty)
    rows = {r.key: r.target for r in inserted.collect()}
    assert rows == {"FirstLine": "First line\nsecond line kept", "Hello": "Hello\nWorld", "SayHi": 'Say "hi', "SavedOk": "Saved.ok"}
    text = rewritten.first().rewritten
    for k in ("FirstLine", "Hello", "SavedOk"):
        assert f"= sess.i18n(XlfKeys.{k});" in text
    assert '= (sess.i18n(XlfKeys.SayHi) + "\\"");' in text
    for kept in ('$"Hello {name}"', '$@"Dir {name}\\x"', '@$"Dir {name}"', '@"C:\\dir\\file"', '"report.xml"'):
        assert kept in text
    assert sorted((r.ordinal, r.reason) for r in rejected.collect()) == [(1, "interpolated"), (2, "interpolated"), (3, "interpolated")]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from('aB é\\"\n{}$@/.:1_'), min_size=1, max_size=12), min_size=1, max_size=5))
def test_every_replaced_value_is_in_the_catalog(spark, values):
    """Property: literals written from values; each replaced one is found in the catalog or among the conflicts, whole."""
    body = "".join('x = @"' + v.replace('"', '""') + '";\n' for v in values)
    src = spark.createDataFrame([("one", "en", body)], "path string, lang string, content string")
    empty = spark.createDataFrame([], "lang string, key string, source string, target string, translate boolean, "
                                      "origin string, seq struct<path:string,ordinal:bigint>")
    none = spark.createDataFrame([], "text string, verdict string")
    rewritten, inserted, conflicts, _ = flows.translate_files(src, K.stoplist(spark), none, empty)
    out = rewritten.first().rewritten
    stored = {r.target for r in inserted.collect()} | {r.dropped for r in conflicts.collect()}
    replaced = [v for v in values if 'x = @"' + v.replace('"', '""') + '";\n' not in out]
    assert out.count("sess.i18n(") == len(replaced)
    for v in replaced:      # the core is stored whole, and what stands around it is in the source
        cores = [c for c in stored if c in v]
        assert any(all(p == "" or '"' + escaped(p) + '"' in out for p in v.split(c, 1)) for c in cores), v


def escaped(part):
    """A part as the body of a regular literal."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        part = part.replace(a, b)
    return part


def test_split_values_are_lossless(spark):
    values = ["Label:", "<b>Item</b>", " <b>(x)</b> ", "--Hello!", "!!", "a", "", "<b>--</b>", "x\n<b>y</b>"]
    df = spark.createDataFrame([(v,) for v in values], "text string").select("text", T.split_value("text").alias("s"))
    got = {r.text: (r.s.prefix, r.s.core, r.s.suffix) for r in df.collect()}
    assert all("".join(p) == v for v, p in got.items())
    assert got["Label:"] == ("", "Label", ":") and got["<b>Item</b>"] == ("<b>", "Item", "</b>")
    assert got[" <b>(x)</b> "] == (" <b>(", "x", ")</b> ") and got["!!"] == ("", "!!", "") and got["<b>--</b>"] == ("", "<b>--</b>", "")


def test_migrated_constants_reach_the_catalog(spark):
    src = spark.createDataFrame([("k.cs", "en", 'class K {\n  public const string Hello = "He said \\"x\\"";\n}\n')],
                                "path string, lang string, content string")
    empty = spark.createDataFrame([], "lang string, key string, source string, target string, translate boolean, "
                                      "origin string, seq struct<path:string,line_no:bigint>")
    rewritten, inserted, _ = flows.migrate_catalog(src, empty)
    assert [(r.lang, r.key, r.target) for r in inserted.collect()] == [("en", "Hello", 'He said "x"')]
    assert "sess.i18n(XlfKeys.Hello)" in rewritten.first().content


def test_write_declarations_sorted(spark, tmp_dir):
    keys = spark.createDataFrame([(k,) for k in ["Zeta", "Alpha", "Mid"]], "key string")
    out = os.path.join(tmp_dir, "decl")
    C.write_declarations(C.render_declarations(keys), out, parts=2)
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    lines = [l for p in parts for l in open(os.path.join(out, p)).read().splitlines()]
    assert lines == [f'public const string {k} = "{k}";' for k in ["Alpha", "Mid", "Zeta"]]


def test_profiles_are_bounded(spark):
    docs = spark.createDataFrame([(1, "en", "the cat the dog"), (2, "fr", "le chat le chien")], "doc_id long, lang string, text string")
    prof = L.build_profiles(docs, 2)
    assert prof.groupBy("lang").count().filter("count > 2").count() == 0
