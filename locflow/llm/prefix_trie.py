"""Operator 12: the trie of conversation prefixes, measured by an Euler tour.

A node is a distinct sequence of first turns (role, text). Its key is the
depth and four running sums of 32-bit hashes of ``(position, turn digest)``,
128 bits in all, so a prefix's key comes from a prefix sum and no text leaves
its row but as a digest and a length. Keys are counted (partial aggregation:
a prefix that a third of all conversations share costs a row a task).

Euler tour: every node has an enter and an exit arc. The arc after an enter is
that of the first child, or the own exit; after an exit that of the next
sibling, or the parent's exit. Siblings are in order of a hash bucket, then of
their number, so that the root's children are never one sorted group: a window
runs within each of ``FAN ** 2`` buckets, another over the buckets of one of
``FAN`` groups, a last one over a parent's groups.

List ranking: sums of arc weights from an arc to the end of the tour, by
pointer jumping in two stages. Every 32nd arc, by a hash, is a post. First
every arc jumps until it points to a post; an arc that does is written once
and leaves the rounds. Then only the posts jump, to the end. An arc's sum is
that to its post plus the post's. Work is some ten passes over the arcs and a
logarithm of passes over a 32nd of them; each round is a join of written
tables, none is larger than the arcs. A node's subtree sum is the sum at its
enter arc less that at its exit arc.

Conversations of any length: positions and running sums are made within
blocks of ``BLOCK`` turns and carried on over blocks, so a conversation that
holds a third of all rows is dealt over its blocks. The ids that end at a node
are sorted by range over all tasks and joined to pieces of text there; only
these pieces, ``CHUNK`` ids a row, meet at the node's hash, streamed.

Defined cases: null roles and texts are empty ones; turns are in order of
``turn`` (null first), equal ones in order of their digest; repeated rows are
turns of their own; rows without ``conv_id`` belong to no conversation and are
left out; an empty table has no nodes; columns of other names are left alone.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locflow.llm.shared import written

BLOCK = 1024
FAN = 256
POSTS = 32
CHUNK = 4096
LANES = ["l0", "l1", "l2", "l3"]
SUMS = ["s0", "s1", "s2", "s3"]


def key(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums]))


def root_key() -> Column:
    return key(F.lit(0), [F.lit(0)] * len(SUMS))


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv, k, digest, bytes`` per turn: its position from 1, the digest of role and text, the text's UTF-8 bytes."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = empty("role"), empty("text")
    turns = written(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes")).withColumn(
        "block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))), "trie-turns")
    counts = turns.groupBy("conv", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv", "block", F.sum("n").over(earlier).alias("before")).where("before > 0")
    inside = F.row_number().over(Window.partitionBy("conv", "block").orderBy("turn", "digest"))
    return turns.select("*", inside.alias("inside")).join(starts, ["conv", "block"], "left").select(
        "conv", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("k"), "digest", "bytes")


def steps(turns: DataFrame) -> DataFrame:
    """``conv, k, n, bytes, node, parent`` of ``turns(conv, k, digest, bytes, n)``, ``n`` the conversation's turns."""
    mixed = F.md5(F.concat_ws(":", F.col("k").cast("string"), F.col("digest")))
    lanes = [F.conv(F.substring(mixed, 8 * i + 1, 8), 16, 10).cast("bigint").alias(x) for i, x in enumerate(LANES)]
    t = turns.select("conv", "k", "n", "bytes", *lanes, F.floor((F.col("k") - 1) / BLOCK).alias("block"))
    blocks = t.where(F.col("n") > BLOCK).groupBy("conv", "block").agg(*[F.sum(x).alias(x) for x in LANES])
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv", "block", *[F.sum(x).over(earlier).alias(f"c{x}") for x in LANES]).where("cl0 is not null")
    inside = Window.partitionBy("conv", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("*", *[F.sum(x).over(inside).alias(s) for x, s in zip(LANES, SUMS)]).join(carried, ["conv", "block"], "left")
    t = t.select("conv", "k", "n", "bytes", *LANES, *[(F.col(s) + F.coalesce(f"c{x}", F.lit(0))).alias(s) for x, s in zip(LANES, SUMS)])
    return t.select("conv", "k", "n", "bytes", key(F.col("k"), [F.col(s) for s in SUMS]).alias("node"),
                    key(F.col("k") - 1, [F.col(s) - F.col(x) for x, s in zip(LANES, SUMS)]).alias("parent"))


def linked(arcs: DataFrame, stop: Column, name: str) -> DataFrame:
    """Pointer jumping of ``arcs(arc, next, leaves, saved)`` until ``next`` is null or ``stop`` holds for it.

    The sums run from an arc up to, without, its ``next``. An arc that has
    stopped is written once; only the others are written again.
    """
    ended = F.col("next").isNull() | stop
    done, left = [written(arcs.where(ended), name)], written(arcs.where(~ended), name)
    while not left.isEmpty():
        now = left
        for d in done:
            now = now.unionByName(d)
        hop = now.select(F.col("arc").alias("next"), F.col("next").alias("then"), F.col("leaves").alias("more_leaves"),
                         F.col("saved").alias("more_saved"))
        left = written(left.join(hop, "next").select("arc", F.col("then").alias("next"), (F.col("leaves") + F.col("more_leaves")).alias("leaves"),
                                                     (F.col("saved") + F.col("more_saved")).alias("saved")), name)
        done.append(left.where(ended))
        left = left.where(~ended)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def ranked(arcs: DataFrame) -> DataFrame:
    """``arc, leaves, saved``: sums of the weights of ``arcs(arc, next, leaves, saved)`` from an arc to the end of its list."""
    post = lambda c: F.pmod(F.xxhash64(c), F.lit(POSTS)) == 0
    near = written(linked(arcs, post("next"), "trie-near"), "trie-near")
    far = linked(near.where(post("arc")), F.lit(False), "trie-far").select(
        F.col("arc").alias("next"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    more = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0))
    return near.join(far, "next", "left").select("arc", more("leaves").alias("leaves"), more("saved").alias("saved"))


def following(level: DataFrame) -> DataFrame:
    """``id, after``: the last child of a bucket and the first of the next bucket of its group (``pid, group, bucket, first, last``)."""
    order = Window.partitionBy("pid", "group").orderBy("bucket")
    return level.select(F.col("last").alias("id"), F.lead("first").over(order).alias("after")).where("after is not null")


def tour(nodes: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The Euler tour's arcs and, per node with children, their number.

    ``nodes(id, n_convs, bytes)``, ``children(id, pid)``. Arc ``2 * id`` enters
    a node, ``2 * id + 1`` leaves it. The weights stand at the enter arcs.
    """
    c = children.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(FAN * FAN)))
    level = written(c.groupBy("pid", "bucket").agg(F.min("id").alias("first"), F.max("id").alias("last"),
                                                   F.count("*").alias("n")), "trie-buckets")
    family = level.groupBy("pid").agg(F.min(F.struct("bucket", "first")).alias("f"), F.sum("n").alias("n_children")).select(
        F.col("pid").alias("id"), F.col("f.first").alias("child"), "n_children")
    group = F.floor(F.col("bucket") / FAN)
    after = following(level.withColumn("group", group)).unionByName(following(
        level.groupBy("pid", group.alias("bucket")).agg(F.min_by("first", "bucket").alias("first"), F.max_by("last", "bucket").alias("last"))
        .withColumn("group", F.lit(0))))
    sibling = c.select("id", "pid", F.lead("id").over(Window.partitionBy("pid", "bucket").orderBy("id")).alias("sibling")).join(
        after, "id", "left").select("id", "pid", F.coalesce("sibling", "after").alias("sibling"))
    n = nodes.join(family, "id", "left").join(sibling, "id", "left")
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    zero = F.lit(0).cast("bigint")
    arcs = n.select(F.inline(F.array(
        F.struct(enter.alias("arc"), F.coalesce(F.col("child") * 2, leave).alias("next"),
                 F.when(F.col("child").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"),
                 ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")),
        F.struct(leave.alias("arc"), F.coalesce(F.col("sibling") * 2, F.col("pid") * 2 + 1).alias("next"),
                 zero.alias("leaves"), zero.alias("saved")))))
    return arcs, family.select("id", "n_children")


def joined_ids(rows: DataFrame) -> DataFrame:
    """``node, first, ids``: the conversation ids of ``rows(node, conv)`` in order, comma-joined, ``CHUNK`` of them a row."""
    def run(batches):
        node, ids = None, []

        def row():
            return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.string()), "first": pa.array([ids[0]], pa.int64()),
                                               "ids": pa.array([",".join(map(str, ids))], pa.string())})

        for batch in batches:
            for name, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist()):
                if ids and (name != node or len(ids) == CHUNK):
                    yield row()
                    ids = []
                node = name
                ids.append(conv)
        if ids:
            yield row()

    dealt = rows.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    return dealt.mapInArrow(run, "node string, first bigint, ids string")


def digests(pieces: DataFrame) -> DataFrame:
    """``node, ends_sha256``: the digest of each node's pieces in order, streamed."""
    def run(batches):
        node, sha = None, None
        for batch in batches:
            out = []
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if name == node:
                    sha.update(b"," + ids.encode())
                    continue
                if sha is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = name, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict({"node": pa.array([x for x, _ in out], pa.string()),
                                              "ends_sha256": pa.array([x for _, x in out], pa.string())})
        if sha is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([node]), "ends_sha256": pa.array([sha.hexdigest()])})

    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(run, "node string, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie: one row each, with counts, subtree sums and the digest of the ids that end there.

    ``turns(conv, k, digest, bytes, n)`` are the turns, ``convs(conv, n)`` all
    conversations, also those without a turn. A node is known by its smallest
    member's id and its depth.
    """
    s = written(steps(turns), "trie-steps")
    inner = s.groupBy("node").agg(F.min("conv").alias("conv_id"), F.min("k").alias("depth"), F.min("parent").alias("parent"),
                                  F.min("bytes").alias("bytes"), F.count("*").alias("n_convs"))
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        root_key().alias("node"), "conv_id", zero.alias("depth"), F.lit(None).cast("string").alias("parent"),
        zero.alias("bytes"), "n_convs")
    # numbers are given as the rows are written: whoever reads them reads the same files
    nodes = written(inner.select(*root.columns).unionByName(root).withColumn("id", F.monotonically_increasing_id()), "trie-nodes")
    parents = nodes.select(F.col("node").alias("parent"), F.col("id").alias("pid"), F.col("conv_id").alias("parent_conv_id"))
    children = written(nodes.where("depth > 0").select("id", "parent").join(parents, "parent").drop("parent"), "trie-children")
    arcs, family = tour(nodes, children)
    sums = ranked(written(arcs, "trie-arcs"))
    sign = F.when(F.col("arc") % 2 == 0, 1).otherwise(-1)
    below = sums.groupBy(F.floor(F.col("arc") / 2).alias("id")).agg(
        F.sum(F.col("leaves") * sign).alias("n_leaves"), F.sum(F.col("saved") * sign).alias("saved_tokens"))
    ends = digests(joined_ids(s.where("k = n").select("node", "conv").unionByName(
        convs.where("n = 0").select(root_key().alias("node"), "conv"))))
    out = nodes.join(below, "id").join(family, "id", "left").join(children.select("id", "parent_conv_id"), "id", "left").join(
        ends, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                      "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "node")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv").agg(F.count("*").alias("n"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are (``conv_id, turn, role, text``)."""
    turns = written(numbered(conversations), "trie-numbered")
    convs = lengths(turns)
    return trie(turns.join(convs, "conv"), convs).drop("node")


def rebuilt(turns: DataFrame, group: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin alike: ``turns(conv, k, digest, bytes, n)`` and ``convs(conv, n)``.

    Every conversation takes the first ``h`` turns of the conversation whose
    id is its own less the remainder by ``group``, then its own turns after
    its first ``h``; ``h`` is CRC-32 of its id by ``spread``.
    """
    convs = lengths(turns)
    own = convs.select("conv", F.col("n").alias("own"), (F.col("conv") - F.col("conv") % group).alias("base"),
                       (F.crc32(F.col("conv").cast("string").cast("binary")) % spread).alias("h"))
    plan = own.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("theirs")), "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("theirs", F.lit(0))).alias("m"), "own")
    plan = written(plan.withColumn("n", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-plan")
    rest = turns.join(plan.select("conv", "h", "m", "n"), "conv").where("k > h").select(
        "conv", (F.col("m") + F.col("k") - F.col("h")).alias("k"), "digest", "bytes", "n")
    begun = turns.where(F.col("k") < spread).withColumnRenamed("conv", "base").join(
        plan.select("conv", "base", "m", "n"), "base").where("k <= m").select("conv", "k", "digest", "bytes", "n")
    return written(rest.unionByName(begun), "trie-rebuilt"), plan.select("conv", "n")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    turns, convs = rebuilt(written(numbered(conversations), "trie-numbered"))
    return trie(turns, convs).drop("node")


def oracle(conversations: str = "conversations") -> str:
    """The same nodes in DuckDB SQL: prefixes as lists of turn digests, subtrees by comparing prefixes."""
    byte = "list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, y: xor(b >> 1, (b & 1) * 3988292384))"
    codes = "list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, x: {byte}), 4294967295)"
    return f"""
WITH r AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations} WHERE conv_id IS NOT NULL),
g AS (SELECT c, turn, md5(length(role) || ':' || role || text) AS g, octet_length(encode(text))::BIGINT AS b FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS k FROM g),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
p AS (SELECT n.c, n.c - n.c % 5 AS base, {crc.replace('c::VARCHAR', 'n.c::VARCHAR')} % 9 AS h, n.n AS own FROM n),
q AS (SELECT p.*, least(h, coalesce(n.n, 0)) AS m FROM p LEFT JOIN n ON n.c = p.base),
s AS (SELECT q.c, m + k - h AS k, g, b FROM q JOIN t ON t.c = q.c WHERE k > h
      UNION ALL SELECT q.c, k, g, b FROM q JOIN t ON t.c = q.base WHERE k <= m),
v AS (SELECT q.c, coalesce(list(s.g ORDER BY s.k) FILTER (s.k IS NOT NULL), []) AS gs,
             coalesce(list(s.b ORDER BY s.k) FILTER (s.k IS NOT NULL), []) AS bs FROM q LEFT JOIN s ON s.c = q.c GROUP BY q.c),
e AS (SELECT c, gs, bs, unnest(range(0, len(gs) + 1)) AS d FROM v),
w AS (SELECT d, array_to_string(gs[:d], '') AS key, array_to_string(gs[:d - 1], '') AS up, coalesce(bs[d], 0) AS b, c, len(gs) = d AS over FROM e),
x AS (SELECT d, key, min(CASE WHEN d > 0 THEN up END) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(b) AS saved,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (over), '')) AS ends_sha256 FROM w GROUP BY d, key),
y AS (SELECT x.*, (SELECT count(*) FROM x z WHERE z.d = x.d + 1 AND z.up = x.key) AS n_children FROM x)
SELECT y.conv_id, y.d::BIGINT AS depth, (SELECT z.conv_id FROM x z WHERE z.d = y.d - 1 AND z.key = y.up) AS parent_conv_id, y.n_convs,
       y.n_children, count(*) FILTER (u.n_children = 0) AS n_leaves, sum(u.saved)::BIGINT AS saved_tokens, y.ends_sha256
FROM y JOIN y u ON u.d >= y.d AND starts_with(u.key, y.key)
GROUP BY ALL"""
