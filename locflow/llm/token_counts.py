"""Operator 9: token counts by a two-tier lookup on the map side.

Under this family of models (BPE pieces, identity normaliser, white space
escaped) no piece holds a word character followed by a space, so a text falls
into *pre-tokens* (the spaces before a word, and the word) whose token counts
simply add up. Line breaks that no longer piece contains are pre-tokens too.

Tier one is a compact table of the corpus's frequent pre-tokens with their
token counts, broadcast to the workers. It comes from a first pass over all
documents: each task keeps a bounded summary of heavy hitters, and only these
summary rows (at most ``SUMMARY_ROWS`` per task) are added up. Tier two is a
bounded cache in each worker for the pre-tokens that miss, encoded there by
the library. Pre-tokens themselves are never shuffled. The table changes the
speed, never the counts.

Defined cases: a null or empty text has 0 bytes and 0 tokens; null ids are
kept; repeated rows give equal rows; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locflow.llm.shared import pieces

BLOCK_CHARS = 1 << 20
SUMMARY_ROWS = 4096         # heavy hitters that one task reports
SUMMARY_HELD = 200_000      # counters that one task holds
TABLE_ROWS = 32_768         # entries of the broadcast table
TABLE_WORD = 64             # characters of its longest entry: at most 64 × 4 bytes × 32,768 = 8 MB in all
CACHE_WORDS = 300_000       # misses that a worker remembers


class Counts:
    """The model without its leading dummy space, and the cut into pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        pieces_ = [p.piece for p in model.pieces if p.type in (1, 4)]
        if (norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or any("▁" in p.lstrip("▁") for p in pieces_)):
            raise ValueError("this model's pieces cross word borders; its texts can't be cut into pre-tokens")
        self.prefix = " " if norm.add_dummy_prefix else ""
        norm.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        alone = not any("\n" in p and len(p) > 1 for p in pieces_)
        self.words = re.compile(r" *[^ \n]+| +|\n" if alone else r" *[^ ]+| +")
        self.cache: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        return self.words.findall(self.prefix + text.replace("▁", " ")) if text else []

    def lengths(self, words: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(words, num_threads=1)]


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(path)


class TwoTier(dict):
    """Word → tokens: the broadcast table first, the worker's cache filled on a miss."""

    def __init__(self, table: dict[str, int], model: Counts):
        super().__init__(table)
        self.model = model

    def __missing__(self, word: str) -> int:
        cache = self.model.cache
        n = cache.get(word)
        if n is None:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            n = len(self.model.model.encode(word))
            if len(word) <= TABLE_WORD:
                cache[word] = n
        return n


def frequent(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The corpus's frequent pre-tokens: ``word, n_tokens, uses`` (at most ``TABLE_ROWS`` rows, all text read)."""
    def run(batches):
        model, held = counts(path), Counter()
        for batch in batches:
            for rows in pieces(batch, ("text",), lambda r: len(r[0]), BLOCK_CHARS):
                for (text,) in rows:
                    held.update(model.cut(text))
                if len(held) > SUMMARY_HELD:    # lossy counting: the rare half goes, its weight bounds the error
                    held = Counter(dict(held.most_common(SUMMARY_HELD // 2)))
        top = [(w, n) for w, n in held.most_common(SUMMARY_ROWS) if len(w) <= TABLE_WORD and n > 1]
        yield pa.RecordBatch.from_pydict({
            "word": pa.array([w for w, _ in top], pa.string()),
            "n_tokens": pa.array(model.lengths([w for w, _ in top]), pa.int64()),
            "uses": pa.array([n for _, n in top], pa.int64())})

    text = df.select(F.col(text_col).alias("text")).where("text is not null")
    summary = text.mapInArrow(run, "word string, n_tokens bigint, uses bigint")
    return (summary.groupBy("word", "n_tokens").agg(F.sum("uses").alias("uses"))
            .orderBy(F.desc("uses"), "word").limit(TABLE_ROWS))


def token_counts(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (``n_tokens > limit``)."""
    spark = df.sparkSession
    table = {r["word"]: r["n_tokens"] for r in frequent(df, path, text_col).collect()}  # ≤ TABLE_ROWS rows
    shared = spark.sparkContext.broadcast(table)
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        model = counts(path)
        tiers = TwoTier(shared.value, model)
        for batch in batches:
            id_type = batch.schema.field("id").type
            for rows in pieces(batch, ("id", "text"), lambda r: len(r[1]), BLOCK_CHARS):
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([r[0] for r in rows], id_type),
                    "n_bytes": pa.array([len(r[1].encode()) for r in rows], pa.int64()),
                    "n_tokens": pa.array([sum(map(tiers.__getitem__, model.cut(r[1]))) for r in rows], pa.int64())})

    out = source.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
