"""Operator 13: ranked lexical search on a length-stratified index.

Documents of one normaliser ``m`` form a stratum. A stratum is laid out in
pieces of at most ``PIECE_DOCS`` documents and about ``PIECE_POSTINGS``
postings; a piece is one row: its documents, and postings grouped by term and
then by ``tf``, so that the impact ``(10^9 tf) div (1000 tf + 20 m)`` is
computed once per ``tf`` of the stratum and not per posting. The layout comes
from one range partitioning by ``(m, hash of the id)``: a stratum that holds a
third of all documents is dealt over as many tasks.

The most that a query can score in a piece is the sum, over its terms, of
weight times the impact of the piece's largest ``tf``; the largest of these is
the stratum's bound. Bounds order the visits. First a query visits its strata
of the highest bounds until they hold ``FIRST_DOCS`` documents; the k-th score
found there is its floor. Then every piece whose bound reaches the floor is
visited, which leaves out none of the k best, and within a task the floor
rises with what the task has found. A task keeps k rows a query.

Queries are answered in blocks of at most ``BLOCK_QUERIES`` and about
``BLOCK_TERMS`` terms; a block's terms and weights are broadcast. The index may
be restricted to a set of terms; they are broadcast if they have at most
``TERMS_BYTES``, otherwise the index takes in all terms. Either way the
statistics cover all documents and results are the same. What reaches the
driver: two sums, a block's terms, and two numbers per query of a block.

Defined cases: null and empty texts and texts without a term are no documents
(they count in nothing); very long texts are cut at blanks while being
counted; repeated rows are documents of their own, each ranked; a null id is
ranked behind all ids of its score; every query row is answered on its own, a
null or empty query by no row; ids are integers; an empty table gives no rows;
columns of other names are left alone.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locflow.llm.shared import written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 50
PIECE_DOCS = 4096
PIECE_POSTINGS = 1 << 20
FIRST_DOCS = 4096
BLOCK_QUERIES = 512
BLOCK_TERMS = 1 << 18
TERMS_BYTES = 32 << 20
TEXT_BYTES = 4 << 20
CELLS = 1 << 21             # postings times queries worked on at once
POOL = 1 << 19              # candidates held before a task keeps the best only
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTS = "doc_id bigint, n bigint, terms array<string>, tfs array<int>"
INDEX = "m bigint, docs array<bigint>, terms array<string>, tfs array<int>, dfs array<int>, ords array<int>"
FOUND = "q int, item_id bigint, doc_id bigint, score bigint"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def cleaner() -> bytes:
    """Byte by byte: A-Z lower-cased, what ends a term made blank; the bytes of other characters belong to terms."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(table)


def parts(text: bytes):
    """The terms of a cleaned text, in lists of about ``TEXT_BYTES``."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + TEXT_BYTES) if at + TEXT_BYTES < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(documents: DataFrame, only: set[bytes] | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term; of ``only`` these terms, if given (``n`` counts all)."""
    spark = documents.sparkSession
    kept = spark.sparkContext.broadcast(only) if only is not None else None

    def run(batches):
        table = cleaner()
        for batch in batches:
            ids, ns, lens, terms, tfs = [], [], [0], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, counts = 0, Counter()
                for words in parts((text or b"").translate(table)):
                    n += len(words)
                    counts.update(words)
                if not n:
                    continue
                if kept is not None:
                    counts = {t: counts[t] for t in kept.value & counts.keys()}
                ids.append(doc)
                ns.append(n)
                terms.extend(counts.keys())
                tfs.extend(counts.values())
                lens.append(len(terms))
            cuts = pa.array(lens, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n": pa.array(ns, pa.int64()),
                "terms": pa.ListArray.from_arrays(cuts, pa.array(terms, pa.binary()).cast(pa.string())),
                "tfs": pa.ListArray.from_arrays(cuts, pa.array(tfs, pa.int32()))})

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, COUNTS)


def laid_out(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index: one row per piece of a stratum."""
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    rows = counts.where(F.size("terms") > 0).select(m.alias("m"), "doc_id", "terms", "tfs", F.xxhash64("doc_id", "n").alias("tie"))
    dealt = rows.repartitionByRange("m", "tie").sortWithinPartitions("m", "tie").drop("tie")

    def piece(m, held):
        docs, terms, tfs = (pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "terms", "tfs"))
        codes = terms.flatten().dictionary_encode()
        code, tf = codes.indices.to_numpy(), tfs.flatten().to_numpy()
        ords = np.repeat(np.arange(len(docs), dtype=np.int32), pc.list_value_length(terms).to_numpy())
        order = np.lexsort((ords, tf, code))
        code, tf, ords = code[order], tf[order], ords[order]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])])
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        return pa.RecordBatch.from_pydict({
            "m": pa.array([m], pa.int64()), "docs": one(docs, pa.int64()),
            "terms": pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), codes.dictionary.take(pa.array(code[first]))),
            "tfs": one(tf[first], pa.int32()), "dfs": one(np.diff(np.r_[first, len(code)]).astype(np.int32), pa.int32()),
            "ords": one(ords, pa.int32())})

    def run(batches):
        held, at, docs, postings = [], None, 0, 0
        for batch in batches:
            start, sizes = 0, pc.list_value_length(batch.column("terms")).to_pylist()
            for k, m in enumerate(batch.column("m").to_pylist()):
                if docs and (m != at or docs == PIECE_DOCS or postings + sizes[k] > PIECE_POSTINGS):
                    if k > start:
                        held.append(batch.slice(start, k - start))
                    yield piece(at, held)
                    held, docs, postings, start = [], 0, 0, k
                at, docs, postings = m, docs + 1, postings + sizes[k]
            if batch.num_rows > start:
                held.append(batch.slice(start))
        if docs:
            yield piece(at, held)

    return dealt.mapInArrow(run, INDEX)


class Index:
    """The written pieces, and the numbers of documents and terms of the collection."""

    def __init__(self, documents: DataFrame, only: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text"):
        counts = written(term_counts(documents, only, id_col, text_col), "lexical-counts")
        self.n_docs, self.n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.pieces = written(laid_out(counts, self.n_docs, self.n_terms), "lexical-index")

    def weights(self, wanted: DataFrame) -> DataFrame:
        """``wanted(q, term)`` with ``w``, the weight of a term by the documents that hold it; terms of none are left out."""
        each = self.pieces.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term"))
        df = each.agg(F.sum("t.dfs").alias("df"))
        w = F.floor(F.lit(1000) * F.log((F.lit(2 * self.n_docs + 2)).cast("double") / (F.col("df") * 2 + 1).cast("double")))
        return wanted.join(df, "term").select("q", "term", w.cast("bigint").alias("w")).where("w > 0")


class Block:
    """The terms of a block of queries as arrays: of term ``t`` the queries and weights ``at[t]`` to ``at[t + 1]``."""

    def __init__(self, rows: list[tuple[int, str, int]], items: list[int | None]):
        rows = sorted(rows, key=lambda r: r[1])
        names = [r[1] for r in rows]
        first = [k for k in range(len(rows)) if not k or names[k] != names[k - 1]]
        self.terms = pa.array([names[k] for k in first], pa.string())
        self.at = np.array([*first, len(rows)], dtype=np.int64)
        self.q = np.array([r[0] for r in rows], dtype=np.int64)
        self.w = np.array([r[2] for r in rows], dtype=np.int64)
        self.items = items

    def pairs(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every term of ``t`` and every query that has it: the term's place in ``t`` and the place in ``q`` and ``w``."""
        n = self.at[t + 1] - self.at[t]
        of = np.repeat(np.arange(len(t)), n)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[t], n)


class Piece:
    """One row of the index met by a block of queries: runs of equal term and tf whose term some query has."""

    def __init__(self, block: Block, m: int, terms: pa.Array, tfs: np.ndarray):
        t = pc.index_in(terms, value_set=block.terms)
        self.hit = np.flatnonzero(t.is_valid().to_numpy(zero_copy_only=False))
        self.term = t.drop_null().to_numpy().astype(np.int64)
        each, which = np.unique(tfs[self.hit].astype(np.int64), return_inverse=True)
        self.impact = ((10 ** 9 * each) // (1000 * each + 20 * m))[which]
        self.block = block

    def bounds(self) -> np.ndarray:
        """The most that each query can score here; a term's last run has its largest tf."""
        last = np.flatnonzero(np.r_[self.term[1:] != self.term[:-1], True][:len(self.term)])
        of, at = self.block.pairs(self.term[last])
        out = np.zeros(len(self.block.items), dtype=np.int64)
        np.add.at(out, self.block.q[at], self.block.w[at] * self.impact[last][of])
        return out

    def scores(self, queries: np.ndarray, dfs: np.ndarray, ords: np.ndarray, n_docs: int) -> np.ndarray:
        """Scores of all documents of the piece, a row for each of ``queries``."""
        place = np.full(len(self.block.items), -1)
        place[queries] = np.arange(len(queries))
        starts = (np.cumsum(dfs) - dfs)[self.hit]
        of, at = self.block.pairs(self.term)
        row = place[self.block.q[at]]
        of, at, row = of[row >= 0], at[row >= 0], row[row >= 0]
        value, n, start = self.block.w[at] * self.impact[of], dfs[self.hit][of].astype(np.int64), starts[of].astype(np.int64)
        out = np.zeros(len(queries) * n_docs, dtype=np.int64)
        total, a = np.cumsum(n), 0
        while a < len(n):
            b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + CELLS, side="right")), a + 1)
            k, m = n[a:b], int(n[a:b].sum())
            inside = np.arange(m) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[a:b], k)
            np.add.at(out, np.repeat(row[a:b] * n_docs, k) + ords[inside], np.repeat(value[a:b], k))
            a = b
        return out.reshape(len(queries), n_docs)


class Best:
    """The k best documents of every query that a task has seen, and the score that a further one has to reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k, self.held, self.n = floor.copy(), k, [], 0

    def add(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        self.held.append((q, score, doc, known))
        self.n += len(q)
        if self.n > POOL:
            self.keep()

    def keep(self) -> tuple[np.ndarray, ...]:
        q, score, doc, known = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((doc, ~known, -score, q))
        q, score, doc, known = q[order], score[order], doc[order], known[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        full = rank == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], score[full])
        best = rank < self.k
        self.held, self.n = [(q[best], score[best], doc[best], known[best])], int(best.sum())
        return self.held[0]


def rows_of(batch, columns):
    """Row by row: the numpy views of a batch's list columns."""
    lists = {c: batch.column(c) for c in columns}
    for k, m in enumerate(batch.column("m").to_pylist()):
        yield m, {c: a[k].values for c, a in lists.items()}


def bounds(index: Index, block) -> DataFrame:
    """``q, m, bound, docs``: the most that a query can score in a stratum, and the stratum's documents."""
    def run(batches):
        def out(m, best, docs):
            q = np.flatnonzero(best)
            return pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int32()), "m": pa.array(np.full(len(q), m), pa.int64()),
                                               "bound": pa.array(best[q], pa.int64()), "docs": pa.array(np.full(len(q), docs), pa.int64())})

        at, best, docs = None, None, 0
        for batch in batches:
            for (m, x), n in zip(rows_of(batch, ("terms", "tfs")), batch.column("n").to_pylist()):
                if m != at and at is not None:
                    yield out(at, best, docs)
                    best, docs = None, 0
                here = Piece(block.value, m, x["terms"], x["tfs"].to_numpy()).bounds()
                at, best, docs = m, here if best is None else np.maximum(best, here), docs + n
        if at is not None:
            yield out(at, best, docs)

    rows = index.pieces.select("m", "terms", "tfs", F.size("docs").alias("n"))
    return rows.mapInArrow(run, "q int, m bigint, bound bigint, docs bigint").groupBy("q", "m").agg(
        F.max("bound").alias("bound"), F.sum("docs").alias("docs"))


def visit(index: Index, block, floor: np.ndarray, reach: np.ndarray, k: int) -> DataFrame:
    """The best documents of each task among pieces whose bound is ``reach`` or more, with a score of ``floor`` or more."""
    def run(batches):
        best = Best(floor, k)
        for batch in batches:
            for m, x in rows_of(batch, ("docs", "terms", "tfs", "dfs", "ords")):
                piece = Piece(block.value, m, x["terms"], x["tfs"].to_numpy())
                queries = np.flatnonzero(piece.bounds() >= np.maximum(best.floor, reach))
                if not len(queries):
                    continue
                known = x["docs"].is_valid().to_numpy(zero_copy_only=False)
                docs = x["docs"].fill_null(0).to_numpy()
                scores = piece.scores(queries, x["dfs"].to_numpy(), x["ords"].to_numpy(), len(docs))
                row, doc = np.nonzero(scores >= best.floor[queries][:, None])
                if len(row):
                    best.add(queries[row], scores[row, doc], docs[doc], known[doc])
        if best.held:
            q, score, doc, known = best.keep()
            items = pa.array(block.value.items, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "q": pa.array(q, pa.int32()), "item_id": items.take(pa.array(q)),
                "doc_id": pa.array(doc, pa.int64(), mask=~known), "score": pa.array(score, pa.int64())})

    return index.pieces.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def answered(index: Index, block, k: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` of one block of queries."""
    n = len(block.value.items)
    order = Window.partitionBy("q").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    first = bounds(index, block).withColumn("before", F.coalesce(F.sum("docs").over(order), F.lit(0))).where(F.col("before") < FIRST_DOCS)
    floor, reach = np.ones(n, dtype=np.int64), np.full(n, 1 << 62, dtype=np.int64)
    for q, b in first.groupBy("q").agg(F.min("bound")).collect():           # one number a query
        reach[q] = b
    for q, s in ranked(visit(index, block, floor, reach, k), k).where(F.col("rank") == k).select("q", "score").collect():
        floor[q] = s
    return ranked(visit(index, block, floor, floor, k), k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(documents: DataFrame, queries: DataFrame, k: int = K, item_col: str = "item_id", query_col: str = "text",
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for every query row the ``k`` best documents with a score above 0."""
    spark = documents.sparkSession
    asked = written(queries.select(F.col(item_col).cast("bigint").alias("item_id"),
                                   F.array_distinct(terms_of(F.coalesce(F.col(query_col), F.lit("")))).alias("terms"))
                    .where(F.size("terms") > 0).withColumn("q", F.monotonically_increasing_id()), "lexical-queries")
    wanted = asked.select("q", F.explode("terms").alias("term"))
    vocabulary = written(wanted.select("term").distinct(), "lexical-terms")
    size, = vocabulary.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()
    only = {r.term.encode() for r in vocabulary.collect()} if size <= TERMS_BYTES else None
    index = Index(documents, only, id_col, text_col)
    weights = written(index.weights(wanted), "lexical-weights")
    n_queries, n_terms = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(math.ceil(n_queries / BLOCK_QUERIES), math.ceil(n_terms / BLOCK_TERMS), 1)
    mine = lambda b: F.pmod(F.xxhash64("q"), F.lit(blocks)) == b
    out = None
    for b in range(blocks):
        number, items = {}, []
        for q, item in asked.where(mine(b)).select("q", "item_id").collect():
            number[q] = len(items)
            items.append(item)
        rows = [(number[q], term, w) for q, term, w in weights.where(mine(b)).select("q", "term", "w").collect()]
        if rows:
            one = answered(index, spark.sparkContext.broadcast(Block(rows, items)), k)
            one = written(one, "lexical-answers") if blocks > 1 else one
            out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out


def oracle(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """The same ranking in DuckDB SQL, every score computed."""
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS ts FROM {documents}),
e AS (SELECT *, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM e),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM e) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
q AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({terms})) AS term FROM {benchmark}),
s AS (SELECT q.q, q.item_id, p.r, e.doc_id,
             sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + ((50 * e.n * c.n_docs) // c.n_terms)))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN e USING (r), c GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= {K}"""
