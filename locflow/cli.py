"""Command line: the reference's menu operations, over folders, as Spark jobs.

    python -m locflow split SOURCES OUT
    python -m locflow translate SOURCES CATALOGS OUT [--decisions FILE.jsonl] [--lang en]
    python -m locflow missing-constants CATALOGS CONSTANTS_FILE OUT
    python -m locflow migrate-constants SOURCES OUT [--catalogs CATALOGS] [--lang en]
    python -m locflow add-texts TEXTS_FILE CATALOGS CONSTANTS_FILE OUT [--memory FILE.jsonl] [--lang LANG]
    python -m locflow clean-lines SOURCES OUT

Run under ``spark-submit`` on a cluster or plainly for ``local[*]``. Outputs
are written under OUT (never over the inputs): JSON reports, rewritten
sources as Parquet ``(path, content)`` and as files under their own names
(``OUT/files``), XLIFF parts for catalog rows, ordered text for constants
files, and what was set aside (``OUT/rejects``).
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import functions as F

from locflow.operators import catalog as C
from locflow.operators import classify as K
from locflow.functions import text as T
from locflow.operators import extract as X
from locflow.operators import language as L
from locflow.operators.report import write_report
from locflow.plans import flows
from locflow.session import build_session, stage
from locflow.sources import xliff
from locflow.sources.files import below, read_sources, to_lines, write_sources
from locflow.sources.tree import write_tree

DECISIONS_SCHEMA = "text string, verdict string"
MEMORY_SCHEMA = "src_text string, tgt_text string"
CATALOG_SCHEMA = ("lang string, key string, source string, target string, translate boolean, origin string, "
                  "seq struct<path:string,line_no:bigint>")
PIVOT = "en"


def _decisions(spark, path):
    if not path:
        return spark.createDataFrame([], DECISIONS_SCHEMA)
    return spark.read.schema(DECISIONS_SCHEMA).json(path)


def _catalogs(spark, a):
    """The catalogs with every language that occurs (or those of ``--tags``), and what was set aside."""
    return xliff.read_catalogs(spark, a.catalogs, tags=a.tags.split(",") if a.tags else None)


def _write_catalog(catalog, inserted, a):
    """The catalog as it stands after the insert: existing units of every language plus the new ones."""
    unit = ["lang", "key", "source", "target", "translate"]
    merged = stage(catalog.select(*unit).unionByName(inserted.select(*unit)), "merged")
    xliff.write_catalog(merged, os.path.join(a.out, "catalog"))


def _write_sources(rewritten, a, text_col):
    """Rewritten sources as a table, and as files below ``files`` under the names that they have below the sources."""
    table = os.path.join(a.out, "sources")
    write_sources(rewritten, table, text_col)
    written = rewritten.sparkSession.read.parquet(table)
    write_tree(written.select(below(a.sources).alias("path"), "content"), os.path.join(a.out, "files"), overwrite=True)


def _write_rejects(rejects, a):
    rejects.select("stage", "path", "detail").write.mode("overwrite").json(os.path.join(a.out, "rejects"))


def cmd_split(spark, a):
    src = read_sources(spark, a.sources, a.glob)
    _, report, _, _ = flows.split_files(src, K.stoplist(spark), ("path",), path_col="path")
    write_report(report, os.path.join(a.out, "report"))


def cmd_translate(spark, a):
    src = read_sources(spark, a.sources, a.glob, lang=a.lang)
    catalog, cat_rejects = _catalogs(spark, a)
    catalog = stage(catalog, "catalog")
    rewritten, inserted, conflicts, rejected = flows.translate_files(
        src, K.stoplist(spark), _decisions(spark, a.decisions), catalog, materialize=True)
    _write_sources(rewritten, a, "rewritten")
    _write_catalog(catalog, inserted, a)
    conflicts.write.mode("overwrite").json(os.path.join(a.out, "conflicts"))
    rejects = rejected.select(F.col("reason").alias("stage"), "path", F.concat(
        F.lit("token "), F.col("ordinal").cast("string")).alias("detail"))
    _write_rejects(rejects.unionByName(cat_rejects), a)


def _constants_file(spark, a):
    """Lines, constants and topmost constant of the constants file, and its path as Spark names it (one row)."""
    folder, name = os.path.split(os.path.abspath(a.constants_file))
    lines = to_lines(read_sources(spark, folder, glob=name, recursive=False))
    constants = X.extract_constants(lines)
    first = X.first_constants(constants)
    target = first.select("path").first()
    if target is None:
        raise SystemExit(f"no constant declaration in {a.constants_file}")
    return lines, constants, first, target.path


def cmd_missing_constants(spark, a):
    catalog, cat_rejects = _catalogs(spark, a)
    _write_rejects(cat_rejects, a)
    catalog = catalog.filter(F.col("lang") == PIVOT)    # constants are declared for the pivot's keys
    lines, constants, first, path = _constants_file(spark, a)
    decls = C.render_declarations(C.missing_constants(catalog, constants)).withColumn("path", F.lit(path))
    ordered = C.insert_declarations(lines, decls, first)
    C.write_ordered_lines(ordered, os.path.join(a.out, "constants"))


def cmd_migrate_constants(spark, a):
    src = read_sources(spark, a.sources, a.glob, lang=a.lang)
    if a.catalogs:
        catalog, cat_rejects = _catalogs(spark, a)
        catalog = stage(catalog, "catalog")
        _write_rejects(cat_rejects, a)
    else:
        catalog = spark.createDataFrame([], CATALOG_SCHEMA)
    rewritten, inserted, conflicts = flows.migrate_catalog(src, catalog)
    _write_sources(rewritten, a, "content")
    _write_catalog(catalog, inserted, a)
    conflicts.write.mode("overwrite").json(os.path.join(a.out, "conflicts"))


def cmd_add_texts(spark, a):
    """Flow C: a file of texts, one a line, into the catalog and the constants file."""
    texts = spark.read.text(a.texts).select(F.col("value").alias("text")).filter(~T.is_blank("text")).distinct()
    texts = stage(texts.withColumn("id", F.xxhash64("text")), "texts")
    catalog, cat_rejects = _catalogs(spark, a)
    catalog = stage(catalog, "catalog")
    _write_rejects(cat_rejects, a)
    memory = spark.read.schema(MEMORY_SCHEMA).json(a.memory) if a.memory else spark.createDataFrame([], MEMORY_SCHEMA)
    profiles = stage(L.build_profiles(catalog, text_col="target"), "profiles")
    lines, constants, first, path = _constants_file(spark, a)
    inserted, conflicts, new = flows.add_texts(texts.withColumn("_lang", F.lit(a.lang)), catalog, constants, memory, profiles,
                                               override_col="_lang" if a.lang else None)
    _write_catalog(catalog, inserted, a)
    conflicts.write.mode("overwrite").json(os.path.join(a.out, "conflicts"))
    C.write_ordered_lines(C.insert_declarations(lines, new.withColumn("path", F.lit(path)), first),
                          os.path.join(a.out, "constants"))


def cmd_clean_lines(spark, a):
    src = read_sources(spark, a.sources, a.glob)
    X.clean_lines(to_lines(src)).write.mode("overwrite").json(os.path.join(a.out, "lines"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locflow")
    sub = p.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("split"); s.add_argument("sources"); s.add_argument("out")
    t = sub.add_parser("translate"); t.add_argument("sources"); t.add_argument("catalogs"); t.add_argument("out")
    t.add_argument("--decisions"); t.add_argument("--lang", default="en")
    m = sub.add_parser("missing-constants"); m.add_argument("catalogs"); m.add_argument("constants_file")
    m.add_argument("out")
    g = sub.add_parser("migrate-constants"); g.add_argument("sources"); g.add_argument("out")
    g.add_argument("--catalogs"); g.add_argument("--lang", default=PIVOT)
    n = sub.add_parser("add-texts"); n.add_argument("texts"); n.add_argument("catalogs"); n.add_argument("constants_file")
    n.add_argument("out"); n.add_argument("--memory"); n.add_argument("--lang")
    for x in (t, m, g, n):
        x.add_argument("--tags", help="only catalogs of these languages, comma-separated; the others are named in the rejects")
    c = sub.add_parser("clean-lines"); c.add_argument("sources"); c.add_argument("out")
    for x in (s, t, g, c):
        x.add_argument("--glob", default="*.cs")
    return p


COMMANDS = {"split": cmd_split, "translate": cmd_translate, "missing-constants": cmd_missing_constants,
            "migrate-constants": cmd_migrate_constants, "clean-lines": cmd_clean_lines, "add-texts": cmd_add_texts}


def main(argv=None, spark=None) -> None:
    a = parser().parse_args(argv)
    spark = spark or build_session(app=f"locflow-{a.cmd}")
    COMMANDS[a.cmd](spark, a)


if __name__ == "__main__":
    main()
