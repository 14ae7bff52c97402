"""Operator 6: near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are compared within a label. Equal vectors of a label form one
class, found by the vectors themselves and numbered by 64 bits that are made
distinct; members find their class's result by a 128-bit hash. The unit vectors are turned into the principal axes of the whole
table (the turn leaves products as they are), so the leading coordinates
carry most of a product. Two unit vectors of cosine c lie at most
sqrt(2 - 2c) apart, so with cells of that width along the ``GRID`` leading
axes only neighbouring cells can hold a pair. A vector stands in its own cell
and visits the one below along each axis; two vectors meet in the cell that is
the lower of theirs along every axis, and there only, as two visitors along
one axis are not compared. Cells are dealt into tiles.

No vector is copied per tile pair. First only the heads meet, the ``STEP``
leading coordinates in single precision and the norm of the rest: a tile pair
names its members whose head product plus the product of the two suffix norms
reaches the threshold with anyone. Only these come back with their whole
vectors: products are accumulated ``STEP`` axes at a time, the rest of each
product is bounded by the suffix norms, and a pair is given up as soon as
product plus bound can't reach the threshold. What survives is decided by the
cosine of the original components in double precision.

A tile holds ``TILE_BYTES`` of whole vectors, so what a task holds is bounded
for any vector length, and the heads of a cell are copied once per
``TILE_BYTES`` of its vectors. A tile pair returns, per class, how many
vectors it is linked to, and a spanning forest of its links, never the pairs
themselves; links are joined to components as written tables.

Defined cases: a null label, a null or zero vector and one with a null or
non-finite component link with nothing (a component of their own); vectors of
different length never link; equal vectors of a label link with each other;
rows that repeat an id count as vectors of their own; null ids link with
nothing and have a null component; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locflow.llm.components import Union, components
from locflow.llm.shared import numbered, written

COSINE = 0.98
GRID = 2                    # leading axes that are cut into cells
TILE_BYTES = 16 << 20       # whole vectors of one tile
AT_ONCE = 512               # rows of a tile that are compared with as many others in one go
STEP = 16                   # axes per round of accumulation, and of a head
SLACK = 1e-9                # far above rounding, far below what the threshold could notice
HEAD_SLACK = 1e-5           # the same for heads, in single precision


def raw_rows(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def class_hash(attempt: int):
    """64 bits of a label and a vector; hashes are chained, so the attempt goes first."""
    return F.xxhash64(F.lit(attempt), F.col("label"), F.col("v"))


def classes_of(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All vectors as ``id, label, v`` (v null where it can't link), and the classes ``class_id, label, dim, v, doc, copies``."""
    ok = (F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vec_col) > 0)
          & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
          & F.exists(vec_col, lambda x: x != 0))
    v = F.when(F.coalesce(ok, F.lit(False)), F.col(vec_col).cast("array<double>"))
    vectors = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    classes = vectors.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("doc"), F.count("*").alias("copies"))
    classes = classes.select("label", F.size("v").alias("dim"), "v", "doc", "copies")
    return vectors, numbered(classes, class_hash, "vector", "class_id")


def packed(df: DataFrame) -> DataFrame:
    """``v`` as little-endian doubles."""
    def run(batches):
        for batch in batches:
            v = batch.column("v").to_pylist()
            k = batch.schema.get_field_index("v")
            yield batch.set_column(k, "v", pa.array([np.asarray(x, "<f8").tobytes() for x in v], pa.binary()))

    kinds = ", ".join(f"{f.name} {'binary' if f.name == 'v' else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, kinds)


def axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of all unit vectors of length ``dim``, the strongest first; d * d numbers reach the driver."""
    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = raw_rows(batch.column("v"), dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                total += x.T @ x
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i), "j": pa.array(j), "m": pa.array(total[i, j])})

    part = classes.where(F.col("dim") == dim).select("v").mapInArrow(run, "i bigint, j bigint, m double")
    moment = np.zeros((dim, dim))
    for r in part.groupBy("i", "j").agg(F.sum("m").alias("m")).collect():
        moment[r["i"], r["j"]] = moment[r["j"], r["i"]] = r["m"]
    return np.linalg.eigh(moment)[1][:, ::-1].copy()


def celled(classes: DataFrame, turn: np.ndarray, width: float, grid: int) -> DataFrame:
    """``class_id, label, head, c0, ...``: the classes' heads and their own cells along the leading axes."""
    dim = len(turn)

    def run(batches):
        for batch in batches:
            x = raw_rows(batch.column("v"), dim)
            z = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn
            cells = np.floor(z[:, :grid] / width).astype(np.int32)
            head = np.column_stack([z[:, :STEP], suffix_norms(z, STEP)]).astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_id"), batch.column("label"), pa.array([h.tobytes() for h in head], pa.binary()),
                 *(pa.array(np.ascontiguousarray(cells[:, k])) for k in range(grid))],
                names=["class_id", "label", "head", *(f"c{k}" for k in range(grid))])

    label = classes.schema["label"].dataType.simpleString()
    return classes.where(F.col("dim") == dim).select("class_id", "label", "v").mapInArrow(
        run, f"class_id bigint, label {label}, head binary, " + ", ".join(f"c{k} int" for k in range(grid)))


def suffix_norms(z: np.ndarray, k: int) -> np.ndarray:
    return np.sqrt(np.maximum((z[:, k:] ** 2).sum(axis=1), 0.0))


def blocks(is_left: np.ndarray, same: bool):
    """Row numbers to compare with one another, ``AT_ONCE`` by ``AT_ONCE``, and whether both are the same rows."""
    left = np.arange(len(is_left)) if same else np.flatnonzero(is_left)
    right = left if same else np.flatnonzero(~is_left)
    for p in range(0, len(left), AT_ONCE):
        for q in range(p if same else 0, len(right), AT_ONCE):
            yield left[p:p + AT_ONCE], right[q:q + AT_ONCE], same and p == q


def met(li: np.ndarray, ri: np.ndarray, visits: np.ndarray, same: bool) -> np.ndarray:
    """Which pairs are compared here: not two visitors along one axis, and each pair of the same rows once."""
    here = (visits[li][:, None] & visits[ri][None, :]) == 0
    return np.triu(here, 1) if same else here


def compare(x: np.ndarray, z: np.ndarray, li: np.ndarray, ri: np.ndarray, here: np.ndarray, cosine: float):
    """Row numbers of the pairs among ``here`` whose cosine reaches the threshold; ``z``: ``x`` of unit length, turned."""
    dim, zl, zr = z.shape[1], z[li], z[ri]
    step = min(STEP, dim)
    partial = zl[:, :step] @ zr[:, :step].T
    i, j = np.nonzero(here & (partial + np.outer(suffix_norms(zl, step), suffix_norms(zr, step)) >= cosine - SLACK))
    so_far = partial[i, j]
    for k in range(step, dim, STEP):
        if not len(i):
            break
        so_far = so_far + np.einsum("ij,ij->i", zl[i, k:k + STEP], zr[j, k:k + STEP])
        stays = so_far + suffix_norms(zl, k + STEP)[i] * suffix_norms(zr, k + STEP)[j] >= cosine - SLACK
        i, j, so_far = i[stays], j[stays], so_far[stays]
    i, j = li[i], ri[j]
    norm = np.linalg.norm(x, axis=1)
    found = [np.empty((2, 0), np.int64)]
    for k in range(0, len(i), 1 << 14):                 # a dense block holds up to AT_ONCE squared pairs
        a, b = i[k:k + (1 << 14)], j[k:k + (1 << 14)]
        good = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= cosine
        found.append(np.stack([a[good], b[good]]))
    return np.concatenate(found, axis=1)


def tile_pairs(cells: DataFrame, grid: int, tile_rows: int) -> DataFrame:
    """The heads in every tile pair they belong to: ``label, c0, ..., i, j, own, visits, class_id, head``."""
    cell = [f"c{k}" for k in range(grid)]
    masks = F.explode(F.array(*(F.lit(m) for m in range(1 << grid))))
    stands = cells.select("label", "class_id", "head", *cell, masks.alias("visits")).select(
        "label", "class_id", "head", "visits",
        *((F.col(f"c{k}") - F.col("visits").bitwiseAND(1 << k).cast("boolean").cast("int")).alias(f"c{k}") for k in range(grid)))
    sizes = written(stands.groupBy("label", *cell).agg(
        F.count("*").alias("size"), F.bit_and("visits").alias("visitors")).where("size > 1 and visitors = 0").select(
        "label", *cell, F.ceil(F.col("size") / tile_rows).cast("int").alias("tiles")), "vector-cells")
    rows = stands.join(sizes, ["label", *cell]).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("tiles")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    return rows.select("label", *cell, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       "own", "visits", "class_id", "head")


def near_heads(pairs: DataFrame, head_width: int, cosine: float, grid: int) -> DataFrame:
    """Of every tile pair the members whose head lets them reach the threshold with another member."""
    key = ["label", *(f"c{k}" for k in range(grid)), "i", "j"]
    keep = [*key, "own", "visits", "class_id"]

    def run(table):
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        own, visits = (table.column(c).to_numpy() for c in ("own", "visits"))
        h = np.frombuffer(b"".join(table.column("head").to_pylist()), "<f4").reshape(-1, head_width)
        near = np.zeros(len(own), bool)
        for li, ri, alike in blocks(own == table.column("i")[0].as_py(), same):
            reach = h[li] @ h[ri].T >= np.float32(cosine - HEAD_SLACK)  # coordinates and suffix norms in one product
            if reach.any():
                reach &= met(li, ri, visits, alike)
                near[li] |= reach.any(axis=1)
                near[ri] |= reach.any(axis=0)
        return table.select(keep).filter(pa.array(near))

    kinds = ", ".join(f"{f} {pairs.schema[f].dataType.simpleString()}" for f in keep)
    return pairs.groupBy(*key).applyInArrow(run, kinds)


def tile_links(cells: DataFrame, flat: DataFrame, turn: np.ndarray, cosine: float, grid: int) -> DataFrame:
    """``a, b, n``: with b null, class a is linked to n further vectors; else a link of the spanning forest."""
    dim = len(turn)
    tile_rows = max(TILE_BYTES // (8 * dim), 1)
    near = written(near_heads(tile_pairs(cells, grid, tile_rows), min(STEP, dim) + 1, cosine, grid), "vector-near")

    def run(table):
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        own, visits, ids, copies = (table.column(c).to_numpy() for c in ("own", "visits", "class_id", "copies"))
        x = raw_rows(table.column("v"), dim)
        z = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn
        count, found = np.zeros(len(ids), np.int64), Union()
        for li, ri, alike in blocks(own == table.column("i")[0].as_py(), same):
            i, j = compare(x, z, li, ri, met(li, ri, visits, alike), cosine)
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            for a, b in zip(ids[i].tolist(), ids[j].tolist()):
                found.join(a, b)
        links = found.links()
        linked = np.flatnonzero(count)
        return pa.table({
            "a": pa.array([*ids[linked].tolist(), *(a for a, _ in links)], pa.int64()),
            "b": pa.array([*([None] * len(linked)), *(b for _, b in links)], pa.int64()),
            "n": pa.array([*count[linked].tolist(), *([0] * len(links))], pa.int64())})

    whole = near.join(flat.select("class_id", "v", "copies"), "class_id")
    return whole.groupBy("label", *(f"c{k}" for k in range(grid)), "i", "j").applyInArrow(run, "a bigint, b bigint, n bigint")


def near_vectors(df: DataFrame, cosine: float = COSINE, grid: int = GRID, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``id, n_links, component, kept``."""
    vectors, classes = classes_of(df, id_col, vec_col, label_col)
    flat = packed(classes)
    width = math.sqrt(max(2 - 2 * cosine, 0.0)) + 1e-6
    spark, found = df.sparkSession, None
    for (dim,) in sorted(map(tuple, classes.select("dim").distinct().collect())):   # vector lengths: a handful
        turn = axes(flat, dim)
        g = min(grid, dim)
        part = tile_links(written(celled(flat, turn, width, g), "vector-celled"), flat, turn, cosine, g)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a bigint, b bigint, n bigint")
    found = written(found, "vector-links")
    joined = written(components(found.where("b is not null").select("a", "b")), "vector-components")
    hashes = [class_hash(8 + k).alias(f"hash{k}") for k in range(2)]     # of a vector, wherever it stands
    degree = found.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n"))
    placed = classes.join(degree, "class_id", "left").join(
        joined.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select(
        *hashes, "doc", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "class_id").alias("component"))
    placed = written(placed, "vector-placed")
    heads = placed.groupBy("component").agg(F.min("doc").alias("head"))
    placed = written(placed.join(heads, "component").where("n_links > 0").select("hash0", "hash1", "n_links", "head"), "vector-heads")
    keyed = vectors.select("id", *(F.when(F.col("v").isNotNull(), h).alias(f"hash{k}") for k, h in enumerate(hashes)))
    component = F.when(F.col("id").isNotNull(), F.coalesce("head", "id"))
    return keyed.join(placed, ["hash0", "hash1"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component"),
        component.eqNullSafe(F.col("id")).alias("kept"))


def near_duplicates(df: DataFrame) -> DataFrame:
    """Per vector: direct links, the smallest vector that links reach, and whether it stays."""
    return near_vectors(df).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def oracle(embeddings: str = "embeddings") -> str:
    """Brute force in DuckDB: all pairs of a label, then components by repeated minimum (for small tables)."""
    return f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, label, CASE WHEN label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
         AND list_aggregate(list_transform(embedding, lambda x: (x IS NOT NULL AND isfinite(x))::INT), 'min') = 1
         AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0
       THEN embedding::DOUBLE[] END AS x FROM {embeddings}),
e AS (
  SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.label = b.label AND a.k <> b.k AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
c AS (
  SELECT k, k AS other FROM v
  UNION
  SELECT c.k, e.b FROM c JOIN e ON c.other = e.a)
SELECT vec_id, coalesce(n, 0) AS n_links, CASE WHEN vec_id IS NOT NULL THEN m END AS component_id,
       CASE WHEN vec_id IS NOT NULL THEN m END IS NOT DISTINCT FROM vec_id AS kept
FROM v LEFT JOIN (SELECT a AS k, count(*) AS n FROM e GROUP BY 1) USING (k)
JOIN (SELECT c.k, min(o.vec_id) AS m FROM c JOIN v o ON o.k = c.other GROUP BY 1) USING (k)"""
