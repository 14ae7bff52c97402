"""Every registered query against its DuckDB twin at sf0.001, plus plan checks."""

import hashlib
import os

import duckdb
import pytest

from conftest import SF001
from __spark_entry__ import entry, oracle_sql, queries
from locflow.sources.tables import TABLES

from locflow.plans.checks import ORACLE, QUERIES
from locflow.plans.jobs import all_plans

NAMES = sorted(QUERIES)     # the optional training-data queries have their own tests


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF001, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x01".join("\x00" if r[i] is None else str(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["page_lang", "translatable", "texts", "keys", "uses"]


def test_every_query_has_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


def test_no_split_is_one_sided(spark):
    """Each verdict, rule, vocabulary and side occurs in the registered results."""
    values = lambda name, col: {r[0] for r in queries()[name](spark, SF001).select(col).distinct().collect()}
    assert values("q_classify", "reason") == {"text", "url", "path", "number", "identifier", "no_letter", "stop:tag",
                                              "stop:attr", "stop:value", "stop:ext"}
    places = queries()["q_classify_places"](spark, SF001).where("src = 'code' AND text IN ('Pick 7', 'Done 7')")
    assert sorted(map(tuple, places.select("text", "translatable", "reason").collect())) == [
        ("Done 7", False, "context:compare"), ("Done 7", True, "text"), ("Pick 7", False, "context:call"), ("Pick 7", True, "text")]
    assert {"context:call", "context:case", "context:index", "context:compare", "context:attribute", "context:attr"} <= values("q_classify_places", "reason")
    assert values("q_flagship", "translatable") == {True, False}
    assert {"kept", "manual_no", "auto_no", "not_translatable"} <= values("q_decisions", "verdict")
    assert values("q_path_guard", "is_path") == {True, False}
    assert len(values("q_report", "to_translate")) > 1
    assert values("q_translate_rejects", "reason") == {"unbalanced", "interpolated"}
    for name in ("q_memory", "q_untranslated", "q_translate_inserted", "q_migrate_catalog", "q_add_texts"):
        assert queries()[name](spark, SF001).limit(1).count() == 1, name


@pytest.mark.parametrize("salted", [False, True], ids=["plain", "salted"])
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name, salted):
    # salted: every key with more than one row is treated as hot, so the
    # salted join paths must give the same answer
    if salted:
        spark.conf.set("locflow.skew.hotRows", "1")
        spark.conf.set("locflow.skew.salts", "4")
    try:
        df = queries()[name](spark, SF001)
        srows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("locflow.skew.hotRows")
        spark.conf.unset("locflow.skew.salts")
    rel = duck.sql(oracle_sql()[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert _digest(srows, df.columns) == _digest(drows, rel.columns)


FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_python_or_cartesian(spark, name):
    _, plans = all_plans(lambda: queries()[name](spark, SF001))
    for op in FORBIDDEN:
        assert not any(op in plan for plan in plans), f"{name}: {op}"
