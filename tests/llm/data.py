"""Small inputs that hold the defined cases: nulls, empty and long texts, ties, repeats, clashing column names."""

import os
import random

from pyspark.sql import types as T

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
# columns that operators use themselves under these names
CLASHES = ["id", "row", "size", "label", "v", "s", "bucket", "address", "class_id", "copies", "u", "tie"]
DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                         T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                         T.StructField("n_chars", T.LongType())]
                        + [T.StructField(c, T.StringType()) for c in CLASHES])

BASE = ("The quick brown fox jumps over the lazy dog while seven wizards quietly brew a strong potion for the "
        "queen of the northern hills and her loyal knights. ")
TEXTS = [
    None, "", " ", "\n\t ", "one", "two words", "a b c d", BASE, BASE, "  " + BASE.replace(" ", "  ") + "\n",
    BASE.upper(), BASE * 3, BASE + "extra", "x" * 30_000, "word " * 5_000, BASE * 300,
    "Licensed under CC BY-NC 4.0. All rights reserved. GNU General Public License, version 3.",
    "cc by cc by CC-BY all rights reserved all rights", "naïve café 日本語 テスト 😀  nbsp  em ▁▁ <|endoftext|> <s>",
    "tabs\tand\vverticals\ffeeds\rreturns", "0123456789 " * 20, "THE!! THAT!! FOR!! " * 40, "a | b | c | d |\n" * 30,
]
SOURCES = ["src1", None, "src0", "", "src2"]


def document_rows(extra=()):
    rows = [(k, t, "en" if k % 3 else None, SOURCES[k % 5], len(t) if t else None) for k, t in enumerate([*TEXTS, *extra])]
    rows.append((3, TEXTS[3], None, "src0", None))          # a repeated row
    rows.append((None, BASE, "en", "src1", 5))              # a null id
    rows.append((None, None, None, None, None))
    return rows


def documents(spark, extra=(), rows=None):
    rows = document_rows(extra) if rows is None else rows
    return spark.createDataFrame([(*r, *(c + "!" for c in CLASHES)) for r in rows], DOCUMENT)


def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


def near_copies(n=40, seed=5):
    """Chains of edited copies, unrelated texts and texts that share a passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    out, passage = [], words(60)
    for _ in range(n // 8):
        doc = words(rng.randrange(30, 120))
        for _ in range(5):
            out.append(" ".join(doc))
            doc = list(doc)
            for _ in range(rng.randrange(1, 4)):
                doc[rng.randrange(len(doc))] = rng.choice(vocabulary)
        out.append(" ".join(passage + words(rng.randrange(5, 60))))
        out.append(" ".join(words(50)).title())
        out.append(" ".join(words(3)))
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def path(name):
    return os.path.join(SF001, f"{name}.parquet")
