import os

from pyspark.sql import functions as F

from locflow.operators.catalog import trim_units
from locflow.sources import xliff

CATALOG = """<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2">
  <file datatype="xml" source-language="en-US" target-language="cs-CZ" original="APP/RESOURCES/R.RESX">
    <body><group id="G" datatype="resx">
      <trans-unit id="Hello" translate="yes"><source></source><target> Ahoj </target></trans-unit>
      <trans-unit id="Bye" translate="yes"><source>Bye</source><target>Nashle</target></trans-unit>
      <trans-unit id="Bye" translate="yes"><source>Bye</source><target>Later</target></trans-unit>
    </group></body></file>
  <file datatype="xml" source-language="en-US" target-language="en-US" original="APP/OTHER/R.RESX">
    <body><group id="G" datatype="resx"><trans-unit id="X" translate="yes"><source>x</source><target>x</target></trans-unit></group></body></file>
</xliff>
"""

EN = CATALOG.replace('target-language="cs-CZ"', 'target-language="en-US"').replace(" Ahoj ", "Hello")


def _folder(tmp_dir):
    for name, body in (("app.cs-CZ.xlf", CATALOG), ("app.en-US.xlf", EN), ("app.xx.xlf", CATALOG),
                       ("zz.cs-CZ.xlf", CATALOG.replace("Nashle", "Other").replace('id="Hello"', 'id="New"').replace(" Ahoj ", "Jen tady"))):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(body)
    return tmp_dir


def test_lang_from_filename(spark):
    df = spark.createDataFrame([("app.cs-CZ.xlf",), ("app.en-US.xlf",), ("docs.en.xlf",), ("app.xx.xlf",), ("app.xlf",)], "n string")
    got = [r[0] for r in df.select(xliff.lang_from_filename(F.col("n"))).collect()]
    assert got == ["cs", "en", "en", "xx", ""]


def test_read_catalogs_scope_first_wins_and_rejects(spark, tmp_dir):
    folder = _folder(tmp_dir)
    cat, rejects = xliff.read_catalogs(spark, folder)
    rows = sorted((r.lang, r.key, r.target) for r in cat.collect())
    # second <file> (no /RESOURCES/) out of scope; all physical files of a language; first unit per id
    assert rows == [("cs", "Bye", "Nashle"), ("cs", "Hello", " Ahoj "), ("cs", "New", "Jen tady"), ("en", "Bye", "Nashle"),
                    ("en", "Hello", "Hello")]
    why = sorted((os.path.basename(r.path), r.stage) for r in rejects.collect())
    assert why == [("app.cs-CZ.xlf", "catalog_scope"), ("app.en-US.xlf", "catalog_scope"), ("app.xx.xlf", "catalog_name"),
                   ("zz.cs-CZ.xlf", "catalog_scope")]
    files, rej2 = xliff.list_catalog_files(spark, folder)
    assert sorted((r.lang, os.path.basename(r.path)) for r in files.collect()) == [
        ("cs", "app.cs-CZ.xlf"), ("cs", "zz.cs-CZ.xlf"), ("en", "app.en-US.xlf")]
    assert rej2.count() == 1


UNIT = '<trans-unit id="{k}" translate="yes"><source>s</source><target>{k}</target></trans-unit>'
FILE = '<file target-language="{t}" original="A/RESOURCES/R"><body>{body}</body></file>'


def test_groups_elements_and_plain_units(spark, tmp_dir):
    """The first group of the first element counts; units directly under body are read; the rest is named."""
    unit = lambda k: UNIT.format(k=k)
    group = lambda *ks: "<group>" + "".join(map(unit, ks)) + "</group>"
    files = {
        "two.en.xlf": FILE.format(t="en", body=group("A", "B") + group("C")) + FILE.format(t="en", body=group("D")),
        "plain.en.xlf": FILE.format(t="en-GB", body=unit("E") + unit("F")),
        "none.en.xlf": '<file original="A/RESOURCES/R"><body>' + group("G") + "</body></file>",
        "empty.en.xlf": FILE.format(t="en", body=""),
    }
    for name, body in files.items():
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(f'<xliff version="1.2">{body}</xliff>')
    cat, rejects = xliff.read_catalogs(spark, tmp_dir)
    assert sorted(r.key for r in cat.collect()) == ["A", "B", "E", "F"]
    assert sorted((os.path.basename(r.path), r.stage) for r in rejects.collect()) == [
        ("none.en.xlf", "catalog_scope"), ("two.en.xlf", "catalog_element"), ("two.en.xlf", "catalog_group")]


def test_write_catalog_uses_a_task_per_language_and_bucket(spark, tmp_dir):
    rows = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "cs").otherwise("en").alias("lang"), F.concat(F.lit("K"), F.col("id")).alias("key"),
        F.lit("s").alias("source"), F.repeat(F.lit("t"), F.lit(50)).alias("target"), F.lit(True).alias("translate"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = os.path.join(tmp_dir, "many")
        xliff.write_catalog(rows, out, buckets=16)
        parts = [p for p in os.listdir(out) if p.startswith("part-")]
        assert len(parts) > 2       # more tasks wrote than there are languages
        sized = os.path.join(tmp_dir, "sized")
        xliff.write_catalog(rows, sized, bytes_per_file=2000)
        text = "".join(open(os.path.join(sized, p)).read() for p in os.listdir(sized) if p.startswith("part-"))
        assert text.count("<file ") >= 16
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    back, _ = xliff.read_catalogs(spark, out, glob="part-*", lang_from="attribute")
    assert back.count() == 400


def test_trim_and_round_trip(spark, tmp_dir):
    folder = _folder(tmp_dir)
    cat, _ = xliff.read_catalogs(spark, folder)
    trimmed = trim_units(cat)
    changed = {r.key for r in trimmed.filter("changed").collect()}
    assert changed == {"Hello"} or changed == {"Hello"}
    out = os.path.join(tmp_dir, "out")
    xliff.write_catalog(trimmed.drop("changed"), out, buckets=2)
    back, _ = xliff.read_catalogs(spark, out, glob="part-*", lang_from="attribute")
    a = sorted((r.lang, r.key, r.source, r.target) for r in trimmed.collect())
    b = sorted((r.lang, r.key, r.source, r.target) for r in back.collect())
    assert a == b
    assert ("cs", "Hello", "", "Ahoj") in b
