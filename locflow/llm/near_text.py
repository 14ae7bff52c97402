"""Operator 10: near-duplicate documents by a multi-index Hamming join over MinHash signatures.

A document's set holds the hashes of its distinct word shingles; documents
of equal sets, told by a 128-bit digest, form one class, and all further work
is on classes, numbered by 64 bits that are made distinct. A
signature has ``SYMBOLS`` symbols of 16 bits; two sets of similarity J
disagree in a symbol with probability 1 - J. Pairs whose signatures differ in
at most ``DISTANCE`` symbols are candidates; at J = 0.8 a pair lies beyond it
with probability 1e-6.

The join is exact under that distance. The symbols are split into ``CHUNKS``
chunks; as ``DISTANCE < 2 * CHUNKS``, two candidates differ by at most one
symbol in some chunk (pigeonhole), so every class is filed under each chunk
with each one of its symbols left out: one key per symbol. A key is therefore
a bucket, and candidates share one.

No bucket is expanded into pairs. A pre-aggregated pass finds the smallest
and the largest class of every bucket, and every member is compared to these
two; links are confirmed on the full sets and joined to components. Only
buckets that still hold members of different components are then searched
whole, in blocks of rows, for pairs across components within the distance,
each pair looked at in the first of its common buckets only. There the
members bring their sets with every hash cut to 16 bits (32 for large sets);
equal sets stay equal when cut, so what two cut sets have in common is never
less than what the sets have, and a pair whose cut sets stay below the
threshold is no link. Of pairs clearly above it only a spanning forest is
passed on, of pairs near it every one, and these are confirmed like the
others. So no link is lost, and what leaves a bucket is in proportion to its
members.

Defined cases: null and empty texts, and texts of white space, have an empty
set and link with nothing; a text with fewer words than a shingle has the
whole sequence as its one shingle; a null id links with nothing and has a
null component; rows that repeat an id and a text share their class; an empty
table gives no rows; other columns are not read by ``near_groups`` and travel
unchanged in ``keep_one``. Where an id repeats with several texts, ``keep_one``
removes those that go and no other.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locflow.llm.components import Union, components
from locflow.llm.shared import numbered, pieces, written

SYMBOLS, CHUNKS, DISTANCE = 64, 15, 29
BLOCK_CHARS = 1 << 20
BLOCK_ROWS = 4096           # rows of one bucket that are compared to one another at a time
BLOCK_BYTES = 4 << 20       # and what their cut sets hold
CACHE_WORDS = 200_000       # words whose hashes a worker remembers, some 150 bytes each
SET_ROWS = 1 << 11          # shingles handled at a time while signing
NARROW = 2048               # largest set whose hashes are cut to 16 bits; chance adds under 3 % of it to a comparison
CLEAR = 0.04                # similarity above the threshold at which a comparison of cut sets is taken as a link

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD,
                0xC4CEB9FE1A85EC53, 0x2127599BF4325C37, 0x880355F21E6D1965], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


SLOPE = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * ODD[0]) | np.uint64(1)
SHIFT = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * ODD[1])
SLOPE_32, SHIFT_32 = SLOPE.astype(np.uint32), SHIFT.astype(np.uint32)
CHUNK_OF = np.array([k * CHUNKS // SYMBOLS for k in range(SYMBOLS)])
CHUNK_START = np.flatnonzero(np.r_[True, CHUNK_OF[1:] != CHUNK_OF[:-1]])


class Words(dict):
    """Word → 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def word_hashes() -> Words:
    return Words()


def shingles(text: str, width: int) -> np.ndarray:
    """The set of a text: sorted distinct hashes of its shingles of ``width`` words."""
    words = text.encode("utf-8", "replace").lower().split()     # A-Z only; splits at blanks and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    rows = len(h) - n + 1
    total = np.full(rows, n, np.uint64) * ODD[7]
    for k in range(n):
        total = mix(total + h[k:k + rows] * ODD[k % 7])
    return np.unique(total)


def digest_of(found: np.ndarray) -> bytes | None:
    """128-bit hash of a set."""
    from xxhash import xxh3_128_digest
    return xxh3_128_digest(found.tobytes()) if len(found) else None


def class_ids(digest: str, attempt: int):
    """A class's number, from its digest. The attempt goes first: hashes are chained, what collides before it still would."""
    return F.xxhash64(F.lit(attempt), F.col(digest))


def sign(found: np.ndarray) -> bytes:
    """The signature: for each symbol 16 bits of the smallest value of the set under one hash function."""
    least = np.full(SYMBOLS, np.iinfo(np.uint32).max, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), SET_ROWS):
        least = np.minimum(least, (short[k:k + SET_ROWS, None] * SLOPE_32 + SHIFT_32).min(axis=0))
    return (mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def cut_set(found: np.ndarray) -> bytes:
    """The set with its hashes cut short, sorted; repeated values are kept."""
    kind = "<u2" if len(found) <= NARROW else "<u4"
    return np.sort(found.astype(kind)).tobytes()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    if not len(a) or not len(b):
        return 0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    if (a[1:] != a[:-1]).all() and (b[1:] != b[:-1]).all():
        return int((both[1:] == both[:-1]).sum())
    values, n_a = np.unique(a, return_counts=True)
    others, n_b = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    return int(np.minimum(n_a[i], n_b[j]).sum())


def sketches(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n_shingles, digest, signature`` per document (digest and signature null for an empty set)."""
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            id_type = batch.schema.field("id").type
            for rows in pieces(batch, ("id", "text"), lambda r: len(r[1]), BLOCK_CHARS):
                sets = [shingles(r[1], width) for r in rows]
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([r[0] for r in rows], id_type),
                    "n_shingles": pa.array(map(len, sets), pa.int64()),
                    "digest": pa.array(map(digest_of, sets), pa.binary()),
                    "signature": pa.array([sign(s) if len(s) else None for s in sets], pa.binary())})

    return source.mapInArrow(run, f"id {kind}, n_shingles bigint, digest binary, signature binary")


def signature_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """Rows × symbols: the key of each row's chunk with that symbol left out."""
    weighed = mix((signatures.astype(np.uint64) + np.uint64(1)) * SLOPE)
    out = np.empty(signatures.shape, np.uint64)
    for c in range(CHUNKS):
        own = np.flatnonzero(CHUNK_OF == c)
        whole = weighed[:, own].sum(axis=1, dtype=np.uint64)
        for k in own:
            out[:, k] = mix(whole - weighed[:, k] + SHIFT[k])
    return out.view(np.int64)


def filed(classes: DataFrame) -> DataFrame:
    """``bucket, place, id``: each class under its keys; ``place`` is the symbol that the key leaves out."""
    def run(batches):
        places = np.arange(SYMBOLS, dtype=np.int8)
        for batch in batches:
            if batch.num_rows:
                ids = np.asarray(batch.column("id"), dtype=np.int64)
                keys = bucket_keys(signature_rows(batch.column("signature")))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(keys.ravel()),
                                                  "place": pa.array(np.tile(places, len(ids))),
                                                  "id": pa.array(np.repeat(ids, SYMBOLS))})

    return classes.select("id", "signature").mapInArrow(run, "bucket bigint, place tinyint, id bigint")


def within(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a < b`` within the signature distance whose set sizes allow the similarity."""
    one = lambda x: classes.select(F.col("id").alias(x), F.col("signature").alias(f"{x}_signature"),
                                   F.col("n_shingles").alias(f"{x}_n"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    both = both.where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                far = (signature_rows(batch.column("a_signature")) != signature_rows(batch.column("b_signature"))).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(far <= DISTANCE))

    return both.select("a", "b", "a_signature", "b_signature").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    one = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"{x}_text"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").sortWithinPartitions("b")

    def run(batches):
        known_id, known = None, None
        for batch in batches:
            a, b, good = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            a_text, b_text = batch.column("a_text"), batch.column("b_text")
            for k in range(len(a)):
                if b[k] != known_id:
                    known_id, known = b[k], shingles(b_text[k].as_py(), width)
                other = shingles(a_text[k].as_py(), width)
                common = len(np.intersect1d(known, other, assume_unique=True))
                good.append(100 * common >= percent * (len(known) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def cut_sets(texts: DataFrame, width: int) -> DataFrame:
    """``id, cut``: the cut set of each text."""
    def run(batches):
        for batch in batches:
            cut = [cut_set(shingles(t.as_py(), width)) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "cut": pa.array(cut, pa.binary())})

    return texts.mapInArrow(run, "id bigint, cut binary")


def pairs_of(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Pairs of one block of a bucket that are links or may be: across components, within the distance."""
    own, i, j = (np.asarray(table.column(c)) for c in ("own", "i", "j"))
    place = int(table.column("place")[0].as_py())
    ids, component = np.asarray(table.column("id")), np.asarray(table.column("component"))
    size = np.asarray(table.column("n_shingles"))
    sig = signature_rows(table.column("signature"))
    same = i[0] == j[0]
    left = np.flatnonzero(own == i[0])
    right = left if same else np.flatnonzero(own == j[0])
    near: list[np.ndarray] = []
    for x in left:
        y = right[right > x] if same else right
        y = y[component[y] != component[x]]
        y = y[np.minimum(size[y], size[x]) * 100 >= np.maximum(size[y], size[x]) * percent]
        if not len(y):
            continue
        differs = sig[y] != sig[x]
        far = differs.sum(axis=1)
        close = far <= DISTANCE
        y, differs = y[close], differs[close]
        if len(y):      # the pair's first bucket: of the first chunk with at most one difference, that symbol left out
            chunk = (np.add.reduceat(differs, CHUNK_START, axis=1) <= 1).argmax(axis=1)
            inside = differs & (CHUNK_OF == chunk[:, None])
            first = np.where(inside.any(axis=1), inside.argmax(axis=1), CHUNK_START[chunk])
            here = first == place
            near.append(np.stack([far[close][here], np.full(here.sum(), x), y[here]]))
    if not near:
        return []
    far, xs, ys = np.concatenate(near, axis=1)
    cuts = table.column("cut")
    sets: dict[int, np.ndarray] = {}

    def cut(k):
        if k not in sets:
            sets[k] = np.frombuffer(cuts[k].as_py(), "<u2" if size[k] <= NARROW else "<u4")
        return sets[k]

    clear, out = Union(), []
    for k in np.argsort(far, kind="stable"):        # nearest first, so that most others are joined already
        x, y = int(xs[k]), int(ys[k])
        if clear.root(int(component[x])) == clear.root(int(component[y])):
            continue
        a, b = cut(x), cut(y)
        if a.dtype != b.dtype:
            a, b = np.sort(a.astype("<u2")), np.sort(b.astype("<u2"))
        n = common(a, b)
        total = len(a) + len(b) - n
        if 100 * n >= percent * total:
            out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
            if n >= (percent / 100 + CLEAR) * total:
                clear.join(int(component[x]), int(component[y]))
    return out


def across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a < b`` of one bucket but different components that have to be confirmed; see ``pairs_of``.

    ``members``: ``bucket, place, id, component, signature, n_shingles, cut``. A bucket is dealt
    over blocks of about ``BLOCK_ROWS`` rows and ``BLOCK_BYTES`` of sets (at least one), and each pair
    of blocks is compared in one place.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), F.sum(F.octet_length("cut")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = members.join(sizes, "bucket").select(
        "*", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"))
    rows = rows.select("bucket", "place", "id", "component", "signature", "n_shingles", "cut", "own",
                       F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
        "place", "id", "component", "signature", "n_shingles", "cut")
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def emit(found):
        rows = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"a": pa.array(rows[:, 0]), "b": pa.array(rows[:, 1])})

    def run(batches):
        rest = None             # the last group of a batch may go on in the next
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            keys = np.stack([np.asarray(table.column(c)).astype(np.int64) for c in ("bucket", "i", "j")])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            found = []
            for s, e in zip(starts[:-1], starts[1:]):
                if e - s > 1:
                    found += pairs_of(table.slice(s, e - s), percent)
            rest = table.slice(starts[-1])
            yield emit(found)
        if rest is not None and rest.num_rows > 1:
            yield emit(pairs_of(rest, percent))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def texts_of(df: DataFrame, needed: DataFrame, classes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id, text``: the text of each needed class, taken from the document of its smallest id."""
    wanted = needed.join(classes.select("id", "doc", "digest"), "id").select(
        F.col("id").alias("class_id"), F.col("doc").alias("doc_id"), "digest")
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = docs.join(wanted, "doc_id")

    def run(batches):       # where a document id repeats with other texts, only the class's own text stays
        for batch in batches:
            mine = [digest_of(shingles(t.as_py(), width)) == d.as_py()
                    for t, d in zip(batch.column("text"), batch.column("digest"))]
            yield batch.select(["class_id", "text"]).filter(pa.array(mine, pa.bool_())).rename_columns(["id", "text"])

    return found.dropDuplicates(["doc_id", "class_id", "text"]).mapInArrow(run, "id bigint, text string")


def near_groups(df: DataFrame, width: int = 4, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_shingles, component, kept``."""
    return classed(df, width, percent, id_col, text_col).drop("digest")


def classed(df: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: ``id, n_shingles, component, kept, digest``."""
    sketch = written(sketches(df, width, id_col, text_col), "near-sketch")
    classes = numbered(sketch.where("digest is not null and id is not null").groupBy("digest").agg(
        F.min("id").alias("doc"), F.count("*").alias("copies"), F.first("signature").alias("signature"),
        F.first("n_shingles").alias("n_shingles")), lambda attempt: class_ids("digest", attempt), "near")

    # buckets of two or more classes, and their members
    buckets = written(filed(classes).groupBy("bucket").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).where("low <> high"), "near-buckets")
    members = written(filed(classes).join(buckets, "bucket"), "near-members")

    # every member against the smallest and the largest of its bucket
    stars = members.select("id", F.explode(F.array("low", "high")).alias("other")).where("id <> other")
    stars = stars.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    close = written(within(stars, classes, percent), "near-close")
    crowded = members.where("size > 3")
    needed = (close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id")))
              .unionByName(crowded.select("id")).distinct())
    texts = written(texts_of(df, needed, classes, width, id_col, text_col), "near-texts")
    links = written(confirmed(close, texts, width, percent), "near-links")
    joined = written(components(links), "near-components")

    # what the stars left apart: members of other components in one bucket
    placed = crowded.where("id <> low and id <> high").join(joined, "id", "left").select(
        "bucket", "place", "id", F.coalesce("component", "id").alias("component"))
    apart = placed.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
    rest = written(placed.join(written(apart, "near-apart").select("bucket"), "bucket"), "near-rest")
    cut = written(cut_sets(texts.join(rest.select("id").distinct(), "id", "left_semi"), width), "near-cut")
    rest = rest.join(cut, "id").join(classes.select("id", "signature", "n_shingles"), "id")
    more = written(across(rest, percent).distinct(), "near-across")
    more = written(confirmed(more, texts, width, percent), "near-links")
    stars = joined.select(F.col("id").alias("a"), F.col("component").alias("b"))
    joined = written(components(stars.unionByName(more)), "near-components")

    # components by their smallest document
    placed = classes.join(joined, "id", "left").select("digest", "doc", "copies", F.coalesce("component", "id").alias("component"))
    placed = written(placed, "near-placed")
    heads = placed.groupBy("component").agg(F.min("doc").alias("head"))
    final = placed.join(heads, "component").where("copies > 1 or head <> doc").select("digest", "head")
    out = sketch.select("id", "n_shingles", "digest").join(written(final, "near-final"), "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("head", "id"))
    return out.select("id", "n_shingles", component.alias("component"), component.eqNullSafe(F.col("id")).alias("kept"),
                      "digest")


def near_duplicates(df: DataFrame) -> DataFrame:
    """Per document: the size of its set, the smallest document that links reach, and whether it stays."""
    return near_groups(df).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def keep_one(df: DataFrame, width: int = 4, percent: int = 80, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one document of each group, with their columns."""
    found = written(classed(df, width, percent, id_col, text_col).select("id", "digest", "kept"), "near-found")
    gone = found.where("not kept").select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    gone = written(gone, "near-gone")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"))
    # ids that repeat, with one text that goes and another that stays
    split = gone.join(found.where("kept").select(F.col("id").alias("gone_id")), "gone_id", "left_semi")
    split = written(split, "near-split")
    if split.isEmpty():
        return rows.join(gone.select("gone_id").distinct(), F.col("id") == F.col("gone_id"), "left_anti").select("row.*")

    def digests(batches):
        for texts in batches:
            yield pa.array([digest_of(shingles(t.as_py(), width)) if t.is_valid else None for t in texts], pa.binary())

    mixed = split.select(F.col("gone_id").alias("mixed_id")).distinct()
    rows = rows.join(mixed, F.col("id") == F.col("mixed_id"), "left")
    text = F.when(F.col("mixed_id").isNotNull(), F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")))
    rows = rows.withColumn("digest", F.arrow_udf(digests, "binary", F.ArrowUDFType.SCALAR_ITER)(text))
    whole = gone.join(split.select("gone_id"), "gone_id", "left_anti").select("gone_id").distinct()
    rows = rows.join(whole, F.col("id") == F.col("gone_id"), "left_anti")
    same = (F.col("id") == F.col("gone_id")) & (F.col("digest") == F.col("gone_digest"))
    return rows.join(split, same, "left_anti").select("row.*")
