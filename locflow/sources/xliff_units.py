"""XLIFF catalogs read unit by unit (SRC-03, SRC-04 for files of any size).

``xliff.read_catalogs`` takes a whole ``file`` element as one row. Here a
catalog is cut at every ``<trans-unit`` by as many tasks as the file has
splits, so one element of a gigabyte is read by many. Chunks of units learn
whether they begin inside a comment (``splits.entered``), comments are taken
out, and what is left is a sequence of events: ``file`` and ``group`` tags and
whole units. A unit's place comes from running sums, within its chunk and over
the chunks of its file: the number of its ``file`` element and the depth of
groups around it. Elements are told from their tags alone, one small table,
that the units are joined to.

The catalog and the rejects are those of ``read_catalogs``; besides, a file is
named (``catalog_unit``) where units are cut short, by the file's end or by a
``<trans-unit`` inside CDATA. Element names are looked for without a prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locflow.operators.splits import entered, read_chunks
from locflow.session import stage
from locflow.sources.xliff import DEFAULT_TAGS, RESOURCES_MARKER, UNIT, lang_from_filename

MARK = "<trans-unit"
UNITS = 4096
_TAG = r"""\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_EVENTS = (rf"<file{_TAG}|<group{_TAG}|</group\s*+>|" + MARK + r"""\b(?:[^>"'/]++|"[^"]*+"|'[^']*+'|/(?!>))*+/>|"""
           + MARK + r"\b[\s\S]*?</trans-unit\s*+>")
# Comments, and CDATA so that none is seen inside it; by the state a chunk begins in (0 markup, 1 comment).
_CUT = r"<!--[\s\S]*?(?:-->|\z)|(<!\[CDATA\[[\s\S]*?(?:\]\]>|\z))"
_CUTS = (_CUT, r"\A[\s\S]*?(?:-->|\z)|" + _CUT)
XML = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}
FILE_TAG = "`_target-language` string, `_original` string"


def events(spark: SparkSession, path: str, glob: str, recursive: bool, units: int) -> tuple[DataFrame, DataFrame]:
    """``path, n, pos, event`` of all files, and ``path, lost``: units that are no event."""
    chunks = stage(read_chunks(spark, path, glob, recursive, units, mark=MARK, leads=True), "catalog-chunks")

    # most chunks hold no comment; what the patterns would find in them is known without a search
    plain = ~F.col("content").contains("<!--") & ~F.col("content").contains("<![CDATA[")

    def left(state: int):
        last = F.try_element_at(F.regexp_extract_all("content", F.lit(_CUTS[state]), F.lit(0)), F.lit(-1))
        opened = (last == F.col("content")) if state else F.lit(False)
        none = F.when(plain, 0) if state == 0 else F.when(~F.col("content").contains("-->"), 1).when(plain, 0)
        return none.when((last.startswith("<!--") | opened) & ~last.endswith("-->"), 1).otherwise(0)

    states = stage(entered(chunks.select("path", "split", "chunk", F.array(left(0), left(1)).alias("to")), 2).drop("to"), "catalog-states")
    c = chunks.join(states, ["path", "split", "chunk"])
    # the first record of a file had no mark before it
    text = F.when(F.col("n") == 1, F.col("content").substr(F.lit(len(MARK) + 1), F.length("content"))).otherwise(F.col("content"))
    clean = F.when((F.col("state") == 0) & plain, text).when(F.col("state") == 0, F.regexp_replace(text, _CUTS[0], "$1")).otherwise(F.regexp_replace(text, _CUTS[1], "$1"))
    c = c.select("path", "n", F.inline(F.array(F.struct(clean.alias("clean")))))
    found = F.regexp_extract_all("clean", F.lit(_EVENTS), F.lit(0))
    c = stage(c.select("path", "n", found.alias("events"),
                       ((F.length("clean") - F.length(F.replace("clean", F.lit(MARK), F.lit("")))) / len(MARK)).cast("bigint").alias("marks")),
              "catalog-events")
    units_of = F.size(F.filter("events", lambda e: e.startswith(MARK)))
    lost = c.groupBy("path").agg(F.sum(F.col("marks") - units_of).alias("lost")).where("lost > 0")
    return c.select("path", "n", F.posexplode("events").alias("pos", "event")), lost


def read_units(spark: SparkSession, path: str, tags=DEFAULT_TAGS, glob: str = "*.xlf", recursive: bool = False,
               lang_from: str = "name", units_per_chunk: int = UNITS):
    """``(catalog, rejects)`` of ``xliff.read_catalogs``, for catalogs whose elements don't fit a row."""
    e, lost = events(spark, path, glob, recursive, units_per_chunk)
    event = F.col("event")
    empty = event.endswith("/>")
    e = e.select("path", "n", "pos", F.when(event.startswith(MARK), "unit").when(event.startswith("<file"), "file")
                 .when(event.startswith("<group"), "group").otherwise("end").alias("kind"),
                 F.when(event.startswith("<group") & ~empty, 1).when(event.startswith("</group"), -1).otherwise(0).alias("step"),
                 F.when(event.startswith("<file"), 1).otherwise(0).alias("opens"), "event")
    chunk = e.groupBy("path", "n").agg(F.sum("step").alias("step"), F.sum("opens").alias("opens"))
    earlier = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunk.select("path", "n", F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("depth0"),
                         F.coalesce(F.sum("opens").over(earlier), F.lit(0)).alias("file0"))
    here = Window.partitionBy("path", "n").orderBy("pos")
    e = e.select("*", F.coalesce(F.sum("step").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("d"),
                 F.sum("opens").over(here.rowsBetween(Window.unboundedPreceding, 0)).alias("f")).join(carry, ["path", "n"])
    e = stage(e.select("path", F.struct("n", "pos").alias("at"), "kind", "event", (F.col("depth0") + F.col("d")).alias("depth"),
                       (F.col("file0") + F.col("f")).alias("file_no")), "catalog-placed")

    # one row per element: its tag, and where its first and second group begin
    tag = F.from_xml(F.when(event.endswith("/>"), event).otherwise(F.concat(F.regexp_replace("event", r">\z", ""), F.lit("/>"))), FILE_TAG, XML)
    groups = e.where("kind = 'group' and depth = 0").select("path", "file_no", "at")
    first = groups.groupBy("path", "file_no").agg(F.min("at").alias("first"), F.count("*").alias("groups"))
    second = groups.join(first, ["path", "file_no"]).where("at > first").groupBy("path", "file_no").agg(F.min("at").alias("second"))
    files = e.where("kind = 'file'").select("path", "file_no", F.inline(F.array(tag))).join(first, ["path", "file_no"], "left").join(
        second, ["path", "file_no"], "left").withColumn("groups", F.coalesce("groups", F.lit(0)))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    attribute = lang_from == "attribute"
    every = F.lit(attribute) | name.startswith("part-")
    language = F.col("`_target-language`")
    folder = F.when(name.startswith("part-"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)).otherwise(name)
    files = files.withColumn("lang", F.lower(F.split(language, "-").getItem(0)) if attribute else lang_from_filename(folder))
    known = F.coalesce(F.col("lang") != "" if tags is None else F.col("lang").isin(list(tags)), F.lit(False))
    scope = F.coalesce(F.lower(language).startswith(F.col("lang")) & F.col("_original").contains(RESOURCES_MARKER), F.lit(False))
    files = files.withColumns({"known": known, "scope": scope, "every": every})
    chosen = files.where("known and scope").groupBy("path").agg(F.min("file_no").alias("chosen"))
    files = stage(files.join(chosen, "path", "left"), "catalog-elements")
    late = ~F.col("every") & (F.col("file_no") > F.col("chosen"))
    why = (F.when(~F.col("known"), F.struct(F.lit("catalog_name").alias("stage"), F.concat(
                F.lit("unknown language tag: "), F.coalesce("lang", F.lit(""))).alias("detail")))
            .when(~F.col("scope"), F.struct(F.lit("catalog_scope").alias("stage"), F.concat(
                F.lit("out of scope: target-language "), F.coalesce(language, F.lit("missing")),
                F.lit(", original "), F.coalesce("_original", F.lit("missing"))).alias("detail")))
            .when(late, F.struct(F.lit("catalog_element").alias("stage"), F.lit("not the first element of its file").alias("detail")))
            .when(F.col("groups") > 1, F.struct(F.lit("catalog_group").alias("stage"), F.concat(
                F.lit("groups after the first: "), (F.col("groups") - 1).cast("string")).alias("detail"))))
    rejects = files.withColumn("why", why).where("why is not null").select("why.stage", "path", "why.detail").distinct().unionByName(
        lost.select(F.lit("catalog_unit").alias("stage"), "path", F.concat(F.lit("units cut short: "), F.col("lost").cast("string")).alias("detail")))

    used = files.where("known and scope").where(F.col("every") | (F.col("file_no") == F.col("chosen"))).select(
        "path", "file_no", "lang", "first", "second", "groups")
    inside = F.when(F.col("groups") == 0, F.col("depth") == 0).otherwise(
        (F.col("depth") == 1) & (F.col("at") > F.col("first")) & (F.col("second").isNull() | (F.col("at") < F.col("second"))))
    units = e.where("kind = 'unit'").join(used, ["path", "file_no"]).where(inside)
    units = units.select("lang", "path", "at", F.inline(F.array(F.from_xml("event", UNIT.simpleString(), XML))))
    rows = units.select("lang", F.col("_id").alias("key"), F.struct(F.col("path").alias("file"), "at.n", "at.pos").alias("seq"),
                        F.coalesce("source", F.lit("")).alias("source"), F.coalesce("target", F.lit("")).alias("target"),
                        (F.lower(F.coalesce("_translate", F.lit("yes"))) != "no").alias("translate"), F.col("path").alias("origin"))
    win = rows.groupBy("lang", "key").agg(F.min(F.struct("seq", "source", "target", "translate", "origin")).alias("w"))
    return win.select("lang", "key", "w.source", "w.target", "w.translate", "w.origin", "w.seq"), rejects
