"""Literal extraction, balance, constants, rewrite (FIXTURES §4, SURVEY §5 properties)."""

from pyspark.sql import functions as F

from conftest import SF01
from locflow.operators import extract as X
from locflow.operators import rewrite as W


def _lits(spark, rows, **kw):
    df = spark.createDataFrame(rows, "path string, content string")
    return X.extract_literals(df, **kw)


def test_golden_tokens(spark):
    rows = [("a", 'a = "x\\"y" + "b"; // "no"'), ("b", 'u = "http://q" + "z";'),
            ("c", 'p = @"c:\\d\\" + "k";'), ("d", 'w = "\\\\\\\\" + "v";'), ("e", 'v = @"a""b";'),
            ("f", 'odd " one')]
    got = {}
    for r in _lits(spark, rows, keep_comments=True).orderBy("path", "ordinal").collect():
        got.setdefault(r.path, []).append((r.kind, r.raw))
    assert got["a"] == [("regular", '"x\\"y"'), ("regular", '"b"'), ("comment", '// "no"')]
    assert got["b"] == [("regular", '"http://q"'), ("regular", '"z"')]
    assert got["c"] == [("verbatim", '@"c:\\d\\"'), ("regular", '"k"')]
    assert got["d"] == [("regular", '"\\\\\\\\"'), ("regular", '"v"')]
    assert got["e"] == [("verbatim", '@"a""b"')]
    assert "f" not in got
    bal = {r.path: r.balanced for r in X.balance(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert bal == {"a": True, "b": True, "c": True, "d": True, "e": True, "f": False}


def test_positions_and_wrapped(spark):
    rows = [("g", 'x\nvar r = RLData.en["K1"];\n  "two" // c "q"')]
    got = [(r.text, r.offset, r.line_no, r.wrapped) for r in _lits(spark, rows).orderBy("ordinal").collect()]
    assert got == [("K1", 20, 2, True), ("two", 29, 3, False)]
    strict = [r.text for r in _lits(spark, rows, line_rule=True).collect()]
    assert strict == ["K1"]


def test_quarantine_splits_all_rows(spark):
    df = spark.createDataFrame([("a", '"x"'), ("b", '"y'), ("c", "none")], "path string, content string")
    ok, rej = X.quarantine_unbalanced(df)
    assert sorted(r.path for r in ok.collect()) == ["a", "c"]
    assert [(r.stage, r.path) for r in rej.collect()] == [("unbalanced", "b")]


def test_tokens_and_gaps_rebuild_input(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    t = X.tokenize(pages, "html", "markup")
    rebuilt = F.array_join(F.zip_with(F.col("_gaps"), F.concat(F.col("_toks"), F.array(F.lit(""))),
                                      lambda g, k: F.concat(g, k)), "")
    assert t.filter(rebuilt != F.col("html")).count() == 0
    assert t.filter(F.size("_gaps") != F.size("_toks") + 1).count() == 0


def test_constants_and_migration(spark):
    src = "\n".join(["namespace N {", '    public const string Hello = "He \\"x\\" y";', "int a;",
                     '    public const string Bye = "Bye";', "}"])
    df = spark.createDataFrame([("f.cs", src)], "path string, content string")
    lines = df.select("path", F.posexplode(F.split("content", "\n")).alias("p", "line")) \
              .select("path", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")
    consts = [(r.key, r.value, r.line_no) for r in X.extract_constants(lines).orderBy("line_no").collect()]
    assert consts == [("Hello", 'He \\"x\\" y', 2), ("Bye", "Bye", 4)]
    assert X.first_constants(X.extract_constants(lines)).collect()[0].first_line_no == 2
    out = X.migrate_constants(df).collect()[0].content.split("\n")
    assert out == ["namespace N {",
                   "public static string Bye { get { return sess.i18n(XlfKeys.Bye); } }",
                   "public static string Hello { get { return sess.i18n(XlfKeys.Hello); } }",
                   "int a;", "}"]


def test_rewrite_by_position_keeps_comments(spark):
    df = spark.createDataFrame([("f", 'x = "a" + "b"; // "a"')], "path string, content string")
    out = W.rewrite_sources(df, select=lambda t: t == "a", key=lambda t: F.lit("K")).collect()[0]
    assert out.rewritten == 'x = sess.i18n(XlfKeys.K) + "b"; // "a"'
    assert out.replaced == 1
    keys = spark.createDataFrame([("f", 0, "K")], "path string, ordinal long, key string")
    out2 = W.rewrite_with_keys(df, keys).collect()[0]
    assert out2.rewritten == out.rewritten


def test_clean_lines(spark):
    lines = spark.createDataFrame([("p", 1, "name, // note"), ("p", 2, "name,"), ("p", 3, "   "), ("p", 4, "// x")],
                                  "path string, line_no long, line string")
    got = [(r.cleaned, r.uses, r.first_line_no) for r in X.clean_lines(lines).collect()]
    assert got == [("name", 2, 1)]


CHARS = """char c = '"'; var d = "after"; char e = '"', f = '\\'', g = '\\\\';
/* a "quoted" note
   it's "more" **/ var h = "behind"; // it's
#region don't "touch"
var i = x/*"y"*/ + "last";
"""


def test_characters_comments_and_directives_hold_no_literals(spark):
    df = spark.createDataFrame([("f", CHARS), ("open", 'a = "x"; /* "y"'), ("odd", "it's")], "path string, content string")
    assert {r.path: r.stray_quotes for r in X.balance(df).collect()} == {"f": 0, "open": 1, "odd": 1}
    got = _lits(spark, [("f", CHARS)], keep_comments=True).orderBy("ordinal").collect()
    assert [r.text for r in got if r.kind == "regular"] == ["after", "behind", "last"]
    assert [(r.kind, r.text) for r in got if r.kind not in ("regular", "comment")] == [
        ("char", '"'), ("char", '"'), ("char", "\\'"), ("char", "\\\\"), ("block", ' a "quoted" note\n   it\'s "more" *'),
        ("directive", 'region don\'t "touch"'), ("block", '"y"')]
    assert [r.text for r in _lits(spark, [("f", CHARS)]).orderBy("ordinal").collect()] == ["after", "behind", "last"]
    out = W.rewrite_sources(spark.createDataFrame([("f", CHARS)], "path string, content string"), select=lambda t: F.lit(True)).first()
    want = CHARS
    for t in ("after", "behind", "last"):
        want = want.replace(f'"{t}"', f"sess.i18n(XlfKeys.{t.title()})")
    assert out.rewritten == want and out.replaced == 3


HOLES = """var a = $"Is {(ok ? "yes" : "no")} or {m["k\\""]:N1}" + "behind";
var b = $"{(c == '"' ? "x" : $"y {n}")}" + "last"; var d = $"{{" + "open {" + $"{n}}}";
var e = $"a { b" + "odd";
"""


def test_literals_in_the_holes_of_an_interpolated_one(spark):
    got = _lits(spark, [("f", HOLES)]).orderBy("ordinal").collect()
    assert [r.text for r in got if r.kind == "regular"] == ["behind", "last", "open {", "odd"]
    assert [r.text for r in got if r.kind == "interpolated"] == [
        'Is {(ok ? "yes" : "no")} or {m["k\\""]:N1}', """{(c == '"' ? "x" : $"y {n}")}""", "{{", "{n}}}", "a { b"]
    out = W.rewrite_sources(spark.createDataFrame([("f", HOLES)], "path string, content string"), select=lambda t: F.lit(True)).first()
    want = HOLES
    for t, k in (("behind", "Behind"), ("last", "Last"), ("open {", "Open"), ("odd", "Odd")):
        want = want.replace(f'"{t}"', f"sess.i18n(XlfKeys.{k})")
    assert out.rewritten == want and out.replaced == 4
    deep = "$\"" + "{(a ? \"b\" : 'c')} \\n " * 50_000 + "\""
    assert [r.raw for r in _lits(spark, [("f", deep + " + \"z\"")]).orderBy("ordinal").collect()] == [deep, '"z"']


PLACES = """[Obsolete("a0")] class A {
if (x.StartsWith("call") || m["index"] == "cmp" && "cmp2" != y) Show("shown", /* , */ 'c', "shown2" + "shown3");
case "label": y[0] = "plain"; F(a, b[1], "arg2"); s.Replace('x', "repl").Trim ( "t" );
[B][Display(Name = "no place")]
[Other( "a1", "a2")]
w = x == null ? "yes" : "no" == z ? Equals(x, "eq" + n + "eq2") : f("v") + "w";"""


def test_places(spark):
    got = {r.text: r.context for r in _lits(spark, [("f", PLACES)], context=True).collect()}
    assert got == {"a0": "attribute", "call": "call:StartsWith", "index": "index", "cmp": "compare", "cmp2": "compare",
                   "shown": "call:Show", "shown2": "call:Show", "shown3": "call:Show", "label": "case", "plain": "", "arg2": "call:F",
                   "repl": "call:Replace", "t": "call:Trim", "no place": "", "a1": "attribute", "a2": "attribute", "yes": "", "no": "compare",
                   "eq": "call:Equals", "eq2": "", "v": "call:f", "w": ""}
    page = spark.createDataFrame([("p", '<a href="h" title = "t">"q"</a><img ALT="x" class="c d">')], "path string, content string")
    got = {r.text: r.context for r in X.extract_literals(page, profile="markup", context=True).collect()}
    assert got == {"h": "attr:href", "t": "attr:title", "q": "", "x": "attr:alt", "c d": "attr:class"}


def test_places_of_many_tokens_and_of_none(spark):
    long = "F(" + ", ".join(f'"v{k}"' for k in range(30_000)) + ");"
    df = spark.createDataFrame([("long", long), ("none", "x"), ("empty", ""), ("null", None)], "path string, content string")
    got = X.extract_literals(df, context=True, positions=False).groupBy("path", "context").count().collect()
    assert [(r.path, r.context, r["count"]) for r in got] == [("long", "call:F", 30_000)]
