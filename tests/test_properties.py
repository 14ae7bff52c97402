"""Properties, checked against brute force on generated inputs."""

import os
import tempfile

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF01
from locflow.functions import text as T
from locflow.operators import catalog as C
from locflow.operators import extract as X
from locflow.operators.splits import split_literals
from locflow.plans import fixtures as FX
from locflow.sources.files import read_sources


def scan(s: str):
    """Brute-force scanner for the code grammar, one state after the other, character by character."""
    def verbatim(i):
        """End of a verbatim literal whose first quote is at ``i``; a doubled quote goes on."""
        i += 1
        while i < len(s):
            if s[i] == '"':
                if s[i + 1:i + 2] != '"':
                    return i + 1
                i += 1
            i += 1
        return -1

    def quoted(i, mark):
        """End of what ``mark`` opens at ``i``, on its line, with backslash escapes."""
        i += 1
        while i < len(s) and s[i] != "\n":
            if s[i] == mark:
                return i + 1
            if s[i] == "\\":
                if s[i + 1:i + 2] in ("", "\n"):
                    return -1
                i += 1
            i += 1
        return -1

    def interpolated(i):
        """End of an interpolated literal whose quote is at ``i``; its holes may hold literals and characters."""
        i += 1
        while i < len(s) and s[i] not in '"\n':
            if s[i] == "\\":
                if s[i + 1:i + 2] in ("", "\n"):
                    return -1
                i += 2
            elif s.startswith("{{", i):
                i += 2
            elif s[i] == "{":
                i += 1
                while i < len(s) and s[i] != "}":
                    if s[i] in "{\n":
                        return -1
                    i = quoted(i, '"') if s[i] == '"' else character(i) if s[i] == "'" else i + 1
                    if i < 0:
                        return -1
                i += 1
            else:
                i += 1
        return i + 1 if s[i:i + 1] == '"' else -1

    def character(i):
        end = quoted(i, "'")
        body = s[i + 1:end - 1]
        return end if end > 0 and (len(body) == 1 or body[:1] == "\\" and "\\" not in body[2:]) else -1

    toks, i = [], 0
    while i < len(s):
        end = -1
        if s.startswith(('$@"', '@$"', '@"'), i):
            end = verbatim(s.index('"', i))
        if end < 0 and s.startswith('$"', i):
            end = interpolated(i + 1)
        if end < 0 and s.startswith(('"', '$"'), i):
            end = quoted(s.index('"', i), '"')
        if end < 0 and s.startswith("//", i):
            end = s.find("\n", i) if "\n" in s[i:] else len(s)
        if end < 0 and s.startswith("/*", i) and "*/" in s[i + 2:]:
            end = s.index("*/", i + 2) + 2
        if end < 0 and s[i] == "'":
            end = character(i)
        if end < 0 and (i == 0 or s[i - 1] == "\n") and s[i:].split("\n")[0].lstrip(" \t").startswith("#"):
            end = s.find("\n", i) if "\n" in s[i:] else len(s)
        if end < 0:
            i += 1
        else:
            toks.append(s[i:end])
            i = end
    return toks


ALPHABET = st.sampled_from(list('ab"\\@/\n x$') + ["'", "*", "#", "/*", "*/", '@"', "'\"'", "\n#", "\\'", "{", "}", '$"', '{"', '"}', "{{"])
CODE = st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=60, max_size=120)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(CODE)
def test_tokens_match_brute_force_and_rebuild(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "path long, content string")
    t = X.tokenize(df, "content", "code")
    rebuilt = F.array_join(F.zip_with(F.col("_gaps"), F.concat(F.col("_toks"), F.array(F.lit(""))),
                                      lambda g, k: F.concat(g, k)), "")
    rows = t.select("path", "content", "_toks", rebuilt.alias("r")).collect()
    for r in rows:
        assert r.r == r.content
        assert list(r._toks) == scan(r.content), r.content


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(CODE, st.sampled_from([("37", 1), ("64", 2), ("128m", 3)]))
def test_split_tokens_equal_those_of_whole_files(spark, texts, cut):
    """Any splits, any chunks: the same tokens, ordinals and positions, and the same files set aside."""
    folder = tempfile.mkdtemp(prefix="locflow-splits-")
    for k, t in enumerate(texts):
        with open(os.path.join(folder, f"f{k}.cs"), "w", newline="") as f:
            f.write(t)
    whole = read_sources(spark, folder)
    cols = ["path", "ordinal", "kind", "raw", "text", "wrapped", "offset", "line_no"]
    ok, rejects = X.quarantine_unbalanced(whole)
    want = sorted(map(tuple, X.extract_literals(ok, keep_comments=True).select(*cols).collect()))
    size, lines = cut
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lit, out = split_literals(spark, folder, chunk_lines=lines, keep_comments=True)
        assert sorted(map(tuple, lit.select(*cols).collect())) == want
        assert sorted(r.path for r in out.collect()) == sorted(r.path for r in rejects.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab-!.:  1é")), max_size=12), min_size=20, max_size=40))
def test_edges_lossless_and_keys(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.edges("t").alias("e"), T.pascal_key("t").alias("k")).collect():
        assert r.e.prefix + r.e.core + r.e.suffix == r.t
        assert len(r.e.prefix) <= 2 and len(r.e.suffix) <= 2
        words = "".join(ch if (ch.isalnum()) else " " for ch in r.t.replace("ß", "ss")).split()
        want = "".join(w[0].upper() + w[1:].lower() for w in words)
        assert r.k == ("_" + want if want[:1].isdigit() else want)


def test_upsert_covers_the_batch(spark):
    texts = FX.doc_texts(spark, SF01)
    labelled = texts.join(spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    existing = C.first_wins(C.catalog_rows(labelled, order_cols=("doc_id", "line_no")))
    batch = C.catalog_rows(texts, order_cols=("doc_id", "line_no"))
    inserted, conflicts = C.upsert_catalog(existing, batch)
    covered = (inserted.select("lang", "key", "target")
               .unionByName(conflicts.select("lang", "key", F.col("dropped").alias("target")))
               .unionByName(existing.select("lang", "key", "target"))).distinct()
    missing = batch.select("lang", "key", "target").distinct().exceptAll(covered)
    assert missing.count() == 0
    # inserted keys are new and unique
    assert inserted.join(existing, ["lang", "key"], "left_semi").count() == 0
    assert inserted.groupBy("lang", "key").count().filter("count > 1").count() == 0
