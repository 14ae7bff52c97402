"""Operator 4: exact duplicates by an extendible-hash index on shared files.

The address of a text is the 64-bit hash of its normalised form. A directory
of ``2^g`` slots maps the first ``g`` bits of an address to a bucket; it
starts with one bucket and, while a bucket holds more than ``BUCKET_BYTES``
of distinct texts, splits it by its next bit, doubling the directory where
the bucket's own depth has reached ``g``. What the buckets hold is known
beforehand from a count of the distinct addresses per prefix (at most
``2^PREFIX_BITS`` rows, however large the corpus). A bucket still overfull at
that depth goes on splitting by its further bits; as addresses are hashes, its
texts spread evenly over them, so its count says how often. Neighbouring
buckets share a task where there are more than ``TASKS`` of them.

Every task first joins the equal texts it meets (a text that a third of all
rows share thus leaves each task as one entry per 64 MB), then sends each
text once to the owner of its bucket, that is of a range of addresses. The
owner reads its entries in address order, chains entries of equal address,
compares their bytes, and writes one index row per distinct text into the
shared folder. The documents, as addresses and digests, are joined to the
index rows of more than one document; both sides are plain files, so AQE
splits a hot text over many tasks. An owner's memory holds one chain.

Defined cases: null counts as the empty text; a null id counts as larger
than any other and is kept only in a group without any id; repeated rows are
members of one group, and rows that repeat the smallest id are all marked
kept, as are all of a group without any id; of these ``keep_first`` lets one
stay. An empty table gives no rows; other columns are not read by ``groups``
and travel unchanged in ``keep_first``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locflow.llm.shared import written

BUCKET_BYTES = 16 << 20     # capacity of a bucket, in bytes of distinct texts
PREFIX_BITS = 14            # address bits that are counted: 16,384 counts
TASKS = 1 << 16             # most owner tasks, each with a range of addresses
COMBINE_BYTES = 64 << 20    # texts that a task holds while joining equal ones

#: all runs of white space that are not one blank already
RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
TOP = 1 << 63


class Directory:
    """Slots to buckets: buckets are (first address prefix, depth, bytes) and split while overfull."""

    def __init__(self, weights: np.ndarray, capacity: int = BUCKET_BYTES):
        self.bits, self.capacity = int(len(weights)).bit_length() - 1, capacity
        self.sums = np.concatenate([[0], np.cumsum(weights)])
        self.depth = 0                      # global depth
        self.slots = [0]
        self.buckets = [(0, 0)]             # prefix and local depth
        waiting = [0]
        while waiting:
            b = waiting.pop()
            if self.weight(b) > capacity and self.buckets[b][1] < self.bits:
                waiting += [b, self.split(b)]

    def weight(self, b: int) -> int:
        prefix, depth = self.buckets[b]
        wide = self.bits - depth
        return int(self.sums[(prefix + 1) << wide] - self.sums[prefix << wide])

    def split(self, b: int) -> int:
        prefix, depth = self.buckets[b]
        if depth == self.depth:             # doubling
            self.slots = [x for x in self.slots for _ in (0, 1)]
            self.depth += 1
        new = len(self.buckets)
        self.buckets[b] = (prefix * 2, depth + 1)
        self.buckets.append((prefix * 2 + 1, depth + 1))
        wide = self.depth - depth - 1
        first = (prefix * 2 + 1) << wide
        for k in range(first, first + (1 << wide)):
            self.slots[k] = new
        return new

    def further(self, b: int) -> int:
        """Address bits by which a bucket goes on splitting below the counted ones."""
        over = -(-self.weight(b) // max(self.capacity, 1)) if self.buckets[b][1] == self.bits else 1
        return min(max(over - 1, 0).bit_length(), 64 - self.bits)

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """Slot → its bucket's first owner, and the further bits that number its owners; in address order."""
        bits = {b: self.further(b) for b in dict.fromkeys(self.slots)}
        first = dict(zip(bits, np.cumsum([0, *(1 << k for k in bits.values())]).tolist()))
        return np.array([first[b] for b in self.slots]), np.array([bits[b] for b in self.slots])

    def tasks(self) -> int:
        first, bits = self.owners()
        return min(int(first[-1]) + (1 << int(bits[-1])), TASKS)

    def task_of(self):
        """A function from addresses (unsigned) to owner tasks."""
        first, bits = self.owners()
        depth, owners, tasks = self.depth, int(first[-1]) + (1 << int(bits[-1])), self.tasks()

        def of(addresses: np.ndarray) -> np.ndarray:
            slot = (addresses >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(addresses), np.int64)
            more = bits[slot]
            below = (addresses << np.uint64(depth)) >> np.uint64(1) >> (63 - more).astype(np.uint64)
            return (((first[slot] + below.astype(np.int64)) * tasks) // owners).astype(np.int32)

        return of


def addressed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), RUNS, " ")
    return df.select(F.col(id_col).alias("id"), norm.alias("norm")).select(
        "id", F.xxhash64("norm").alias("address"), F.unhex(F.sha2("norm", 256)).alias("sha"), "norm")


def directory(addresses: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> Directory:
    """The directory for the distinct addresses of a table ``address, n_bytes``."""
    prefix = F.shiftrightunsigned("address", 64 - PREFIX_BITS).cast("int").alias("prefix")
    held = (addresses.groupBy("address").agg(F.max("n_bytes").alias("n_bytes"))
            .groupBy(prefix).agg(F.sum("n_bytes").alias("n_bytes")))
    weights = np.zeros(1 << PREFIX_BITS, dtype=np.int64)
    for r in held.collect():                # at most 2^PREFIX_BITS rows
        weights[r["prefix"]] = r["n_bytes"]
    return Directory(weights, bucket_bytes)


def build_index(docs: DataFrame, found: Directory) -> DataFrame:
    """Index rows, one per distinct text: ``address, sha, chain, keep_id, group_size``, written to shared files."""
    kind = docs.schema["id"].dataType.simpleString()
    task_of = found.task_of()
    entry = f"owner int, address bigint, sha binary, norm binary, keep_id {kind}, group_size bigint"

    def combine(batches):
        held: dict = {}
        size, id_type = 0, None

        def flush():
            addresses = np.array([k[0] for k in held], dtype=np.int64).view(np.uint64)
            out = pa.RecordBatch.from_pydict({
                "owner": pa.array(task_of(addresses), pa.int32()), "address": pa.array(addresses.view(np.int64)),
                "sha": pa.array([v[2] for v in held.values()], pa.binary()),
                "norm": pa.array([k[1] for k in held], pa.binary()),
                "keep_id": pa.array([v[0] for v in held.values()], id_type),
                "group_size": pa.array([v[1] for v in held.values()], pa.int64())})
            held.clear()
            return out

        for batch in batches:
            id_type = batch.schema.field("id").type
            columns = (batch.column(c).to_pylist() for c in ("id", "address", "sha", "norm"))
            for i, address, sha, norm in zip(*columns):
                old = held.get((address, norm))
                if old is None:
                    held[address, norm] = [i, 1, sha]
                    size += len(norm) + 200
                    if size > COMBINE_BYTES:
                        yield flush()
                        size = 0
                else:
                    old[1] += 1
                    if i is not None and (old[0] is None or i < old[0]):
                        old[0] = i
        if held:
            yield flush()

    def own(batches):
        address, chain = None, []           # of one address: bytes, keep_id, group_size, sha
        id_type = None

        def rows(chains):
            flat = [(a, e[3], n, e[1], e[2]) for a, es in chains for n, e in enumerate(es)]
            return pa.RecordBatch.from_pydict({
                "address": pa.array([r[0] for r in flat], pa.int64()), "sha": pa.array([r[1] for r in flat], pa.binary()),
                "chain": pa.array([r[2] for r in flat], pa.int32()), "keep_id": pa.array([r[3] for r in flat], id_type),
                "group_size": pa.array([r[4] for r in flat], pa.int64())})

        done = []
        for batch in batches:
            id_type = batch.schema.field("keep_id").type
            columns = (batch.column(c).to_pylist() for c in ("address", "sha", "norm", "keep_id", "group_size"))
            for a, sha, norm, i, n in zip(*columns):
                if a != address:
                    if chain:
                        done.append((address, [(None, *e[1:]) for e in chain]))
                    address, chain = a, []
                for e in chain:
                    if e[0] == norm:        # the bytes decide
                        e[1] = i if e[1] is None else e[1] if i is None else min(e[1], i)
                        e[2] += n
                        break
                    if e[3] == sha:
                        raise ValueError("two texts share their address and their digest")
                else:
                    chain.append([norm, i, n, sha])
            if done:
                yield rows(done)
                done = []
        if chain:
            yield rows([(address, chain)])

    entries = docs.select("id", "address", "sha", F.col("norm").cast("binary").alias("norm")).mapInArrow(combine, entry)
    owned = entries.repartitionById(found.tasks(), F.col("owner")).sortWithinPartitions("address", "sha")
    return written(owned.mapInArrow(own, f"address bigint, sha binary, chain int, keep_id {kind}, group_size bigint"),
                   "dedup-index")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: ``id, address, sha, keep_id, group_size, kept``."""
    docs = addressed(df, id_col, text_col)
    addresses = written(docs.select("id", "address", "sha", F.octet_length("norm").alias("n_bytes")), "dedup-addresses")
    index = build_index(docs, directory(addresses, bucket_bytes)).where("group_size > 1")
    found = addresses.select("id", "address", "sha").join(
        index.select("address", "sha", "keep_id", "group_size"), ["address", "sha"], "left")
    size = F.coalesce("group_size", F.lit(1)).cast("bigint")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select("id", "address", "sha", keep.alias("keep_id"), size.alias("group_size"),
                        F.col("id").eqNullSafe(keep).alias("kept"))


def exact_groups(df: DataFrame) -> DataFrame:
    """Per document: the document that stays for it, the group's size, and the digest of the normalised text."""
    return groups(df).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                             F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one of each text, with their columns."""
    found = groups(df, id_col, text_col).where("group_size > 1").select(
        F.col("id").alias("gone_id"), F.col("address").alias("gone_address"), "sha", "kept")
    found = written(found, "dedup-found")
    # rows that repeat the id that stays for their text
    again = written(found.where("kept").groupBy("gone_id", "gone_address", "sha").count().where("count > 1").select(
        "gone_id", "gone_address").distinct(), "dedup-again")
    gone = written(found.where("not kept").select("gone_id", "gone_address").unionByName(again).distinct(), "dedup-gone")
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), RUNS, " ")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(norm).alias("address"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("address") == F.col("gone_address"))
    kept = rows.join(gone, same, "left_anti").select("row.*")
    if again.isEmpty():
        return kept
    norm = F.regexp_replace(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), RUNS, " ")
    copies = rows.join(again, same, "left_semi").withColumn("sha", F.sha2(norm, 256))
    one = copies.groupBy("id", "address", "sha").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.unionByName(one.select("row.*"))


def oracle(documents: str = "documents") -> str:
    return rf"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM {documents})
WINDOW g AS (PARTITION BY norm)"""
