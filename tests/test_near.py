"""Nearest source texts of a memory, and the language of short texts (JN-04, LNG-01)."""

import random
import re

from pyspark.sql import functions as F

from conftest import SF01
from locflow.operators import near_memory as N
from locflow.operators import short_language as S


def mask(t):
    t = re.sub(r"\{[^{}]*\}|%[0-9]*[sd]", "{}", t.lower())
    return re.sub(r"\s+", " ", re.sub(N.NUMBER.replace("*+", "*"), "0", t)).strip(" ")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(texts, memory):
    known = {}
    for s, t in sorted(memory):
        known.setdefault(mask(s), (s, t))
    words = lambda m: set(re.findall(r"[^\W_]+|\{\}", m))
    out = {}
    for text in texts:
        m, best = mask(text), None
        if m in known:
            best = (-100, m)
        else:
            for k in known:
                a, b = words(m), words(k)
                if a and b and 100 * len(a & b) >= 60 * len(a | b):
                    x, y = m.encode(), k.encode()
                    d, longer = distance(x, y), max(len(x), len(y))
                    if d * 100 <= longer * 30:
                        best = min(best or (0, ""), (-(100 + -d * 100 // longer), k))
        if best:
            out[text] = (known[best[1]][0], -best[0])
    return out


def test_near_matches_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["save", "file", "the", "a", "of", "to", "open", "{name}", "report", "düne", "x1", "é"] + [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(vocabulary[:rng.choice([9, 52])]) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    memory = [(t, t.upper()) for t in texts[:70]] + [("Item 5 of 7", "Kus 5 ze 7"), ("!!", "??")]
    asked = set()
    for t in texts:
        ws = t.split()
        for _ in range(rng.randrange(3)):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        asked.add(" ".join(ws))
    asked |= {"Item 12 of 30", "ITEM  1 of 2", "!!", "--", "", "Save the file 3"}
    a = spark.createDataFrame([(t,) for t in asked] + [(None,)], "text string").repartition(4)
    b = spark.createDataFrame(memory + [(None, "x"), (" ", "y")], "src_text string, tgt_text string")
    got = {r.text: (r.match, r.score) for r in N.near_matches(a, b).collect()}
    want = brute([t for t in asked if t.strip()], memory)
    assert got == want and any(s < 100 for _, s in got.values())
    told = {r.text: r.translation for r in N.near_matches(a, b).collect()}
    assert told["Item 12 of 30"] == "Kus 12 ze 30" and told["ITEM  1 of 2"] == "Kus 1 ze 2"
    spark.conf.set("locflow.skew.hotRows", "1")
    try:
        assert {r.text: (r.match, r.score) for r in N.near_matches(a, b).collect()} == want
    finally:
        spark.conf.unset("locflow.skew.hotRows")
    none = spark.createDataFrame([], "src_text string, tgt_text string")
    assert N.near_matches(a, none).count() == 0 and N.near_matches(a.limit(0), b).count() == 0


def test_short_texts_get_a_language(spark):
    """Held-out lines: profiles come from the documents without a label, the lines from those with one."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id").distinct()
    profiles = S.build_gram_profiles(docs.join(labels, "doc_id", "left_anti")).cache()
    assert profiles.where("gram <> ''").groupBy("lang").count().where(F.col("count") > S.GRAMS).count() == 0
    lines = docs.join(labels, "doc_id", "left_semi").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    det = S.detect_short(lines, profiles, ("doc_id", "k")).join(lines, ["doc_id", "k"]).where(F.col("text").rlike("[a-z]"))
    right, und = det.agg(F.avg((F.col("detected") == F.col("lang")).cast("int")), F.avg((F.col("detected") == "und").cast("int"))).first()
    assert right > 0.98 and und < 0.01
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "1 2 3"), (4, "x"), (5, "the " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.detected for r in S.detect_short(odd, profiles).collect()}
    assert [got[k] for k in (1, 2, 3)] == ["und"] * 3 and got[5] == "en"


def test_units_of_broken_and_odd_catalogs(spark, tmp_dir):
    """Cut at every unit and anywhere in between, a catalog reads as when its elements are whole."""
    import os

    from locflow.sources import xliff
    from locflow.sources.xliff_units import read_units
    unit = lambda k, t="t", extra="": f'<trans-unit id="{k}"{extra}><source>s &amp; {k}</source><target>{t}</target></trans-unit>'
    file = lambda tag, body, original="a/RESOURCES/b": f'<file original="{original}" target-language="{tag}" note="a>b">{body}</file>'
    head, tail = '<?xml version="1.0"?>\n<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2">', "</xliff>"
    cats = {
        "one.cs.xlf": file("cs", "<body>" + "".join(unit(f"K{k}", f" v {k} ") for k in range(30)) + "</body>"),
        "two.cs-CZ.xlf": file("cs", f"<body><group id='x'>{unit('K1', 'late')}{unit('A')}</group><group>{unit('B')}</group>{unit('C')}</body>"),
        "old.en.xlf": file("en", f"<body>{unit('Out')}</body>", "elsewhere") + file("en", "<body><!-- " + unit("No") + "\n" + unit("No2")
                           + " --><group>" + unit("Yes", "", ' translate="no" note="/>"') + '<trans-unit id="Bare"/>' + "</group></body>") + file("en", f"<body>{unit('Late')}</body>"),
        "cdata.en.xlf": file("en", "<body><group id='e'/>" + "<trans-unit id='X'><source><![CDATA[<b> <!-- ]]></source></trans-unit>" + "</body>"),
        "cdata2.en.xlf": file("en", "<body><trans-unit id='X'><source><![CDATA[<b> <!-- ]]></source></trans-unit>" + unit("Y") + "</body>"),
        "named.fr.xlf": file("fr", f"<body>{unit('F')}</body>"), "none.en.xlf": "",
    }
    for name, body in cats.items():
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(head + body + tail)
    cols = ["lang", "key", "source", "target", "translate", "origin"]
    read = lambda pair: tuple(sorted(map(tuple, x.collect())) for x in (pair[0].select(*cols), pair[1]))
    want = read(xliff.read_catalogs(spark, tmp_dir))
    assert {k for _, k, *_ in want[0]} >= {"K29", "A", "Yes", "Bare", "Y"} and not {"No", "No2", "Late", "B", "C"} & {k for _, k, *_ in want[0]}
    for size, units in (("64", 1), ("700", 2), ("128m", 4096)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            assert read(read_units(spark, tmp_dir, units_per_chunk=units)) == want, size
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    with open(os.path.join(tmp_dir, "torn.en.xlf"), "w") as f:
        f.write(head + file("en", f"<body>{unit('T1')}{unit('T2')[:30]}"))
    _, rejects = read_units(spark, tmp_dir)
    assert [(r.stage, r.detail) for r in rejects.where("path like '%torn%'").collect()] == [("catalog_unit", "units cut short: 1")]
