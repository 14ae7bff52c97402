"""Files tokenised by splits: a chunk is tokenised once as from code; other runs end where they meet that one."""

import os
import random

import pytest
from pyspark.sql import functions as F

from locflow.functions.tokens import CODE_TOKEN
from locflow.operators import extract as X
from locflow.operators import splits as S
from locflow.sources.files import read_sources

PARTS = ['a = "b";', 'x @"v ""w"" ', '";', "/* c", "*/", "// it's \"d\"", "'\"'", "#if \"", '$"e {f["g"]} h"', '$@"i', "j", "", ' k "', "/", "*", '\0"l\0"', "é\"ř\""]


def code(seed: int, lines: int) -> str:
    r = random.Random(seed)
    # long runs without a quote or a comment's end, too
    return "\n".join("" if r.random() < 0.3 else " ".join(r.choices(PARTS if r.random() < 0.7 else PARTS[10:12], k=r.randint(1, 4))) for _ in range(lines))


@pytest.mark.parametrize("chunk_lines", [9, 40, 200])
def test_runs_that_meet_give_the_tokens_of_whole_files(spark, tmp_dir, chunk_lines):
    for k in range(12):
        with open(os.path.join(tmp_dir, f"f{k}.cs"), "w", newline="") as f:
            f.write(code(k, 300))
    whole = read_sources(spark, tmp_dir)
    cols = ["path", "ordinal", "kind", "raw", "text", "wrapped", "offset", "line_no"]
    ok, rejects = X.quarantine_unbalanced(whole)
    lit, out = S.split_literals(spark, tmp_dir, chunk_lines=chunk_lines, keep_comments=True)
    assert sorted(map(tuple, lit.select(*cols).collect())) == sorted(map(tuple, X.extract_literals(ok, keep_comments=True).select(*cols).collect()))
    assert sorted(r.path for r in out.collect()) == sorted(r.path for r in rejects.collect())


def chunks(spark):
    texts = [code(k, 400) + "\n" for k in range(40)]
    return spark.createDataFrame([(f"f{k}", 0, 0, t) for k, t in enumerate(texts)], "path string, split long, chunk long, content string")


def test_outcomes_equal_those_of_whole_chunks(spark):
    c = F.col("content")
    rows = S.cut_chunks(chunks(spark)).join(chunks(spark), ["path", "split", "chunk"]).select(
        "f", F.array(*[S._run(c, s) for s in (S.CODE, S.BLOCK, S.VERBATIM)]).alias("want"), "gaps", "toks",
        S._joined("gaps", "toks").alias("joined"), "content", F.regexp_extract_all("content", F.lit(f"{CODE_TOKEN}|{S._OPEN}"), F.lit(0)).alias("plain"))
    for r in rows.collect():
        assert r.f == r.want
        assert r.joined == r.content and len(r.gaps) == len(r.toks) + 1 and r.toks == r.plain
    assert len({tuple(x.state for x in r.f) for r in rows.collect()}) > 1


def test_chunks_are_cut_once_and_tokens_stay_in_place(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "f.cs"), "w") as f:
        f.write(code(1, 50))
    lit, _ = S.split_literals(spark, tmp_dir, only_balanced=False)
    plan = lit.groupBy("kind", "text", "wrapped").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan                         # no token is moved to find where its pieces stand
    assert "toks#" in plan and "content#" not in plan   # the tokens from code are read, not searched again


def test_lines_are_put_together_in_their_task(spark, tmp_dir):
    for k in range(3):
        with open(os.path.join(tmp_dir, f"f{k}.cs"), "w") as f:
            f.write("\n".join(f"line {k} {n}" for n in range(10 * k + 5)))
    got = S.read_chunks(spark, tmp_dir, chunk_lines=10)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((os.path.basename(r.path), r.chunk, r.content.count("\n")) for r in got.collect()) == [
        ("f0.cs", 0, 5), ("f1.cs", 0, 10), ("f1.cs", 1, 5), ("f2.cs", 0, 10), ("f2.cs", 1, 10), ("f2.cs", 2, 5)]
    assert {r.content for r in got.where("chunk = 2").collect()} == {"".join(f"line 2 {n}\n" for n in range(20, 25))}
