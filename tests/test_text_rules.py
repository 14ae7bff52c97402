"""Golden rows for the column rules (FIXTURES §4)."""

from pyspark.sql import functions as F

from locflow.functions import text as T
from locflow.operators import classify as K


def one_col(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(expr(F.col("t"))).collect()]


def test_edges_lossless(spark):
    vals = ["--Hello!", "(x", "Hi there...", "!?", "x-y", "", "a"]
    got = one_col(spark, vals, T.edges)
    assert [tuple(r) for r in got[:5]] == [("--", "Hello", "!"), ("(", "x", ""), ("", "Hi there.", ".."),
                                           ("!?", "", ""), ("", "x-y", "")]
    for v, r in zip(vals, got):
        assert r.prefix + r.core + r.suffix == v


def test_bold(spark):
    got = one_col(spark, [" <b>Hi</b> ", "<b>x", "a <b>x</b>"], T.bold_parts)
    assert tuple(got[0]) == ("<b>", "Hi", "</b>") and got[1] is None and got[2] is None


def test_clean_capture(spark):
    assert one_col(spark, ['"Name:"', "Name::", '":a"'], T.clean_capture) == ["Name", "Name", ":a"]


def test_ws_trim_unicode(spark):
    v = "\u00a0\u2003a b\t\u3000\u0085\n"
    assert one_col(spark, [v, "  ", "x"], T.ws_trim) == ["a b", "", "x"]
    assert one_col(spark, ["  ", None, "x"], T.is_blank) == [True, True, False]


def test_lookup_and_decl(spark):
    assert one_col(spark, ["Hello"], T.lookup_expr) == ["sess.i18n(XlfKeys.Hello)"]
    assert one_col(spark, ["Hello"], T.const_decl) == ['public const string Hello = "Hello";']


def test_carry_capital(spark):
    df = spark.createDataFrame([("Ahoj", "hello"), ("ahoj", "hello"), ("Éa", "élan")], "s string, t string")
    assert [r[0] for r in df.select(T.carry_capital("s", "t")).collect()] == ["Hello", "hello", "Élan"]


def test_backslash_literals_to_verbatim(spark):
    """Whole tokens only, regular → verbatim: a literal that merely begins with backslashes keeps its form."""
    raw = [r'"\\"', r'"\\\\"', '"' + "\\" * 8 + '"', r'"\\x"', r'@"\"', r'"\"', '"' + "\\" * 10 + '"', '"a"', "// c"]
    want = [r'@"\"', r'@"\\"', r'@"\\\\"', r'"\\x"', r'@"\"', r'"\"', '"' + "\\" * 10 + '"', '"a"', "// c"]
    assert one_col(spark, raw, T.backslash_verbatim) == want


def test_escapes_of_the_language(spark):
    body = [r"a\nb", r"\t\r\0\a\b\f\v\'", r"\"q\" \\ \\n", r"\u00e9\u0041\x41b\x9", r"\U0001F600 \uD83D\uDE00",
            r"\q \uD800 \u12", "plain", "end\\"]
    want = ["a\nb", "\t\r\0\a\b\f\v'", '"q" \\ \\n', "éA\u041b\t", "😀 😀", r"\q \uD800 \u12", "plain", "end\\"]
    assert one_col(spark, body, T.unescape_text) == want
    back = [v for v in want if "\\q" not in v]
    assert one_col(spark, back, lambda c: T.unescape_text(T.escape_text(c))) == back
    assert one_col(spark, ["a\nb"], T.escape_text) == [r"a\nb"]


def test_values_by_kind(spark):
    rows = [(r"a\nb", "regular"), ('say ""hi"" \\n', "verbatim"), (r"a\nb", "interpolated"), (r"a\nb", None)]
    df = spark.createDataFrame(rows, "t string, k string")
    assert [r[0] for r in df.select(T.literal_value("t", "k")).collect()] == ["a\nb", 'say "hi" \\n', r"a\nb", r"a\nb"]
    assert [r[0] for r in df.select(T.regular_form("t", "k")).collect()][:2] == [r'"a\nb"', r'"say \"hi\" \\n"']


def test_long_texts_take_linear_time(spark):
    """A megabyte of blanks, of dotted names and of base64 each end at once."""
    import time
    n = 1_000_000
    texts = ["x" + " " * n + "y", "a." * (n // 2) + "a", "QUJD" * (n // 4) + "=", "1" * n + "a", "\\n" * (n // 2), "a_" * (n // 2) + "!"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    began = time.time()
    got = [tuple(r) for r in K.classify(df.withColumn("trimmed", T.ws_trim("text")), K.stoplist(spark)).select(
        "reason", F.length("trimmed"), F.length(T.unescape_text("text"))).collect()]
    assert time.time() - began < 20
    assert {g[0] for g in got} <= {"text", "path"}
    assert sorted(g[2] for g in got) == sorted([len(t) for t in texts if "\\" not in t] + [n // 2])


def test_clean_line(spark):
    assert one_col(spark, ["name, // note", "  a,,  ", "x // y, z"], T.clean_line) == ["name", "a", "x"]


def test_pascal_key(spark):
    got = one_col(spark, ["hello wORLD", "12 ab", "ßtraße Öl", "!?", "x-y z"], T.pascal_key)
    assert got == ["HelloWorld", "_12Ab", "SstrasseÖl", "", "XYZ"]


def test_key_for(spark):
    df = spark.createDataFrame([("Ahoj", "Hello", None), ("Ahoj", " ", None), ("x", "y", "Given")],
                               "t string, tr string, k string")
    assert [r[0] for r in df.select(T.key_for("t", "tr", "k")).collect()] == ["Hello", "Ahoj", "Given"]
    blank = spark.createDataFrame([("Ahoj", None, " "), ("Ahoj", None, "")], "t string, tr string, k string")
    assert [r[0] for r in blank.select(T.key_for("t", "tr", "k")).collect()] == ["Ahoj", "Ahoj"]


def test_escape_round_trip(spark):
    v = 'a "q" \\ b'
    assert one_col(spark, [v], lambda c: T.unescape_text(T.escape_text(c))) == [v]
    assert one_col(spark, [v], T.escape_text) == ['a \\"q\\" \\\\ b']
