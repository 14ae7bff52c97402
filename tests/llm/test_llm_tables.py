"""Operators 3, 4, 6, 7 and 10, components and the pipeline: results against brute force and SQL."""

import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from data import SF001, TEXTS, documents, document_rows, empty, near_copies, path, rows_of

import corpus_pipeline
from locflow.llm import exact_dedup, mixing, near_text, near_vectors, quality, warc
from locflow.llm.components import components
from locflow.llm.queries import ORACLE, QUERIES


def by_str(rows):
    return sorted(rows, key=str)


def duck(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df)
    return con.execute(sql).fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path(t)}'")
    df = QUERIES[name](spark, SF001)
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert by_str(rows_of(df)) == by_str(tuple(r[i] for i in order) for r in rel.fetchall())


# --- components

def brute_components(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in up)


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(1, 2), (2, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)],
    [(random.Random(1).randrange(100), random.Random(k).randrange(100)) for k in range(80)],
    [(-5, 3), (3, 9), (7, -8)], [(k, (k * 7) % 53) for k in range(53)],
], ids=range(8))
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert sorted(rows_of(components(df))) == brute_components([x for x in links if x[0] != x[1]])


# --- operator 3

def page_rows():
    fake = f"{warc.MAGIC}WARC-Type: response\r\nContent-Length: 5\r\n\r\nHTTP/\r\n\r\n"
    inside = f"<p>{fake}</p>{warc.MAGIC}{fake * 3}tail"
    texts = [None, "", "a", "a", "<p>é日</p>\r\n\r\n", inside, inside + "x", inside, fake, warc.MAGIC, "x" * 5000, "WARC/1.1", None]
    rows = [(k, f"http://x/{k}" if k % 4 else None, t, "u") for k, t in enumerate(texts)]
    return rows + [(2, "http://again", "a", "u"), (None, "line\r\nend", "a", "u"), (None, None, None, "u"), (-7, "u", "a", "u")]


def brute_warc(rows):
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        revisit = (h or "") in first and i != first[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response",
                    first[h or ""] if revisit else None))
    return by_str(out)


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_warc_round_trip(spark, split):
    """Payloads hold the magic and whole false records; with small splits records are torn between tasks."""
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        assert by_str(rows_of(warc.round_trip(pages))) == brute_warc(rows)
        assert warc.round_trip(pages.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_warc_torn_records_in_one_file(spark, monkeypatch):
    """Many torn records and cuts in one file, met block by block, also records longer than a block."""
    monkeypatch.setattr(warc, "BLOCK", 64)
    rows = [(k, "u", warc.MAGIC * (k % 5) + f"text {k // 2}" * (k % 40), "") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").coalesce(1)
    assert by_str(rows_of(warc.round_trip(pages))) == brute_warc(rows)


def test_warc_ids_of_other_types(spark):
    names = ["a b", "x>y", "é日", "100%+", "", "-7", None, "line\nend"]
    rows = [(name, None, "same" if k % 2 else f"own {k}", "") for k, name in enumerate(names)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, payload string")
    assert by_str(rows_of(warc.round_trip(pages))) == brute_warc(rows)


def test_warc_files_are_well_formed(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string, payload string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"), records_per_file=4)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 3
    records = 0
    for f in files:
        data, at = f.read_bytes(), 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            end = data.index(b"\r\n\r\n", at)
            length = int(re.search(rb"Content-Length: (\d+)", data[at:end]).group(1))
            at = end + 4 + length
            assert data[at:at + 4] == b"\r\n\r\n"
            at += 4
            records += 1
    assert records == len(page_rows())


# --- operator 4

def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    ids = {}
    for n, r in zip(norm, rows):
        ids.setdefault(n, []).append(r[0])
    out = []
    for n, r in zip(norm, rows):
        known = [i for i in ids[n] if i is not None]
        keep = min(known) if known else None
        out.append((r[0], keep, len(ids[n]), r[0] == keep, hashlib.sha256(n.encode()).hexdigest()))
    return by_str(out)


@pytest.mark.parametrize("bucket_bytes, bits, tasks", [(exact_dedup.BUCKET_BYTES, 14, 99), (200, 14, 99), (200, 2, 99), (50, 1, 7)])
def test_exact_groups(spark, monkeypatch, bucket_bytes, bits, tasks):
    monkeypatch.setattr(exact_dedup, "PREFIX_BITS", bits)
    monkeypatch.setattr(exact_dedup, "TASKS", tasks)
    rows = document_rows([f"text {k % 50}  of many" for k in range(300)])
    docs = documents(spark, rows=rows).repartition(6)
    got = exact_dedup.groups(docs, bucket_bytes=bucket_bytes)
    got = [(r["id"], r["keep_id"], r["group_size"], r["kept"], r["sha"].hex()) for r in got.collect()]
    assert by_str(got) == brute_exact(rows)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert by_str(r["doc_id"] for r in kept.collect()) == by_str(r[0] for r in brute_exact(rows) if r[3])
    assert exact_dedup.exact_groups(empty(spark)).count() == 0 and exact_dedup.keep_first(empty(spark)).count() == 0


def test_keep_first_of_a_table_that_came_twice(spark):
    rows = [(k, f"text {k % 4}") for k in range(8)] + [(None, "no id"), (None, "no  id"), (9, None), (9, ""), (10, "alone")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(5)
    kept = rows_of(exact_dedup.keep_first(docs))
    assert by_str((i, re.sub(" +", " ", t or "")) for i, t in kept) == by_str(
        [(0, "text 0"), (1, "text 1"), (2, "text 2"), (3, "text 3"), (None, "no id"), (9, ""), (10, "alone")])
    assert by_str(kept) == by_str(rows_of(exact_dedup.keep_first(docs)))


def test_directory_doubling():
    rng = np.random.default_rng(3)
    weights = rng.integers(0, 50, 1 << exact_dedup.PREFIX_BITS)
    weights[77] = 10_000        # one address more than a bucket holds
    d = exact_dedup.Directory(weights, 2_000)
    assert len(d.slots) == 1 << d.depth
    for slot, b in enumerate(d.slots):
        prefix, depth = d.buckets[b]
        assert slot >> (d.depth - depth) == prefix
    for b, (prefix, depth) in enumerate(d.buckets):
        assert d.weight(b) <= 2_000 or depth == d.bits
    assert sum(d.weight(b) for b in range(len(d.buckets))) == weights.sum()
    first, bits = d.owners()
    assert list(first) == sorted(first) and {s for s in range(len(bits)) if bits[s]} == {77}


def test_directory_goes_on_below_the_counted_bits(monkeypatch):
    """Overfull buckets at the deepest counted level split on, no owner gets more than it holds, ranges stay in order."""
    addresses = np.sort(np.random.default_rng(4).integers(0, 1 << 64, 200_000, dtype=np.uint64))
    weights = np.bincount((addresses >> np.uint64(61)).astype(int), minlength=8) * 100
    weights[5] = 0
    addresses = addresses[addresses >> np.uint64(61) != 5]
    d = exact_dedup.Directory(weights, 50_000)
    owner = d.task_of()(addresses)
    assert d.tasks() > 300 and owner.min() == 0 and owner.max() == d.tasks() - 1
    assert (np.diff(owner) >= 0).all() and np.bincount(owner).max() * 100 < 1.5 * 50_000
    monkeypatch.setattr(exact_dedup, "TASKS", 10)
    owner = d.task_of()(addresses)
    assert (np.diff(owner) >= 0).all() and set(owner) == set(range(10))


def test_equal_addresses_are_chained(spark):
    docs = spark.createDataFrame([(k, 5, bytes([k % 3]), f"text {k % 3}") for k in range(9)],
                                 "id long, address long, sha binary, norm string").repartition(4)
    index = exact_dedup.build_index(docs, exact_dedup.Directory(np.zeros(1 << exact_dedup.PREFIX_BITS)))
    rows = sorted((r["keep_id"], r["group_size"], r["chain"]) for r in index.collect())
    assert [r[:2] for r in rows] == [(0, 3), (1, 3), (2, 3)] and sorted(r[2] for r in rows) == [0, 1, 2]


# --- operator 6

def vector_rows():
    rng = np.random.default_rng(11)
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            base = rng.normal(size=16)
            for step in range(6):       # a chain: each near the one before
                rows.append((k, base.tolist(), label))
                k += 1
                base = base + rng.normal(size=16) * 0.14 * (step % 3)
    same = rows[0][1]
    rows += [(900 + j, same, 0) for j in range(30)] + [(950, same, None), (951, None, 0), (952, [0.0] * 16, 0),
             (953, [float("nan"), *same[1:]], 0), (954, [None, *same[1:]], 0), (955, [], 0), (956, same[:3], 0),
             (957, [2 * x for x in same], 0), (958, [float("inf"), *same[1:]], 0), (3, rows[3][1], 0)]
    return rows


def brute_vectors(rows):
    good = []
    for i, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, float) if ok else None)
    links, n = [], [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            x, y = good[a], good[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) \
                    and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= near_vectors.COSINE:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    root = dict(brute_components(links))
    least = {}
    for a, r in enumerate(rows):
        least[root.get(a, a)] = min(least.get(root.get(a, a), r[0]), r[0])
    return sorted((r[0], n[a], least[root.get(a, a)], least[root.get(a, a)] == r[0]) for a, r in enumerate(rows))


@pytest.mark.parametrize("tile, grid, at_once", [(1024, 2, 512), (5, 2, 512), (5, 3, 2), (7, 1, 3), (1024, 2, 4)])
def test_near_vectors(spark, monkeypatch, tile, grid, at_once):
    monkeypatch.setattr(near_vectors, "TILE_BYTES", tile * 8 * 16)
    monkeypatch.setattr(near_vectors, "AT_ONCE", at_once)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, class_id int")
    assert sorted(rows_of(near_vectors.near_vectors(df, grid=grid))) == brute_vectors(rows)


def test_vector_classes_that_would_share_a_number(spark, monkeypatch):
    plain = near_vectors.class_hash
    monkeypatch.setattr(near_vectors, "class_hash", lambda attempt: plain(attempt) if attempt else plain(0) % 5)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(rows_of(near_vectors.near_vectors(df))) == brute_vectors(rows)


def test_near_vectors_ship_heads_only(spark, monkeypatch):
    """Vectors without near ones: each stands in 2 ** GRID cells by its head, however many there are, and none comes back whole."""
    x = np.random.default_rng(5).normal(size=(4_000, 64))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    seen = {}

    def spied(pairs, width, cosine, grid):
        seen["heads"] = pairs.count()
        near = plain(pairs, width, cosine, grid)
        seen["near"] = near.count()
        return near

    plain = near_vectors.near_heads
    monkeypatch.setattr(near_vectors, "near_heads", spied)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert near_vectors.near_vectors(df).where("n_links > 0").count() == 0
    assert seen["heads"] <= len(rows) * 2 ** near_vectors.GRID and seen["near"] < len(rows) // 10


def test_near_vectors_defined_cases(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert near_vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, None, None)], schema)
    assert by_str(rows_of(near_vectors.near_duplicates(df))) == by_str(
        [(None, 0, None, True), (1, 0, 1, True), (2, 0, 2, True)])


# --- operator 7

def test_mix_against_sql(spark):
    docs = documents(spark, [f"{'w ' * (k % 90)}" for k in range(400)])
    want = duck(mixing.oracle("d"), d=docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    got = rows_of(mixing.mix_plan(docs))
    assert by_str(got) == by_str((i, s, ss, t, n) for i, s, ss, t, n in want)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    sizes = {}
    for _, size, _, _, taken in got:
        sizes[size] = sizes.get(size, 0) + taken
    assert sum(len(re.findall(mixing.WORDS, r["text"] or "")) for r in mixed.select("text").collect()) == sum(sizes.values())
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    first, second = (sorted(rows_of(mixing.mix_plan(docs))) for _ in range(2))
    assert first == second
    rows = pd.DataFrame(first, columns=["doc_id", "size", "source_size", "target", "taken"])
    assert (rows.taken <= 2 * rows["size"]).all()
    per = rows.groupby(["source_size", "target"]).agg(taken=("taken", "sum"), most=("size", "max")).reset_index()
    assert (per.target <= 2 * per.source_size + 1e-6).all()
    assert abs(per.target.sum() - 1.5 * rows["size"].sum()) < 1e-3
    assert (abs(per.taken - per.target) <= 2 * per.most + 1).all()


def test_mix_runs_no_python(spark):
    from locflow.llm.queries import op7_systematic_mix
    plan = op7_systematic_mix(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- operator 10

def brute_sets(texts, width):
    out = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        out.append({tuple(w[k:k + width]) for k in range(max(len(w) - width, 0) + 1)} if w else set())
    return out


def brute_near(ids, texts, width, percent=80):
    sets = brute_sets(texts, width)
    links = [(a, b) for a in range(len(ids)) for b in range(a)
             if ids[a] is not None and ids[b] is not None and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = dict(brute_components(links))
    least = {}
    for a, i in enumerate(ids):
        r = root.get(a, a)
        least[r] = i if i is None else min(least.get(r, i), i)
    return by_str((i, len(sets[a]), least[root.get(a, a)], least[root.get(a, a)] == i) for a, i in enumerate(ids))


@pytest.mark.parametrize("width, block", [(4, 512), (5, 3)])
def test_near_groups(spark, monkeypatch, width, block):
    monkeypatch.setattr(near_text, "BLOCK_ROWS", block)
    rows = document_rows(near_copies(160))
    docs = documents(spark, rows=rows).repartition(5)
    got = near_text.near_groups(docs, width=width)
    want = brute_near([r[0] for r in rows], [r[1] for r in rows], width)
    assert by_str(rows_of(got)) == want
    kept = near_text.keep_one(docs, width=width)
    assert kept.columns == docs.columns
    assert by_str(r["doc_id"] for r in kept.collect()) == by_str(r[0] for r in want if r[3])
    assert near_text.near_duplicates(empty(spark)).count() == 0 and near_text.keep_one(empty(spark)).count() == 0


def test_keep_one_where_an_id_has_two_texts(spark):
    copied, other, alone = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(1, copied), (2, copied), (2, other), (2, None), (3, other), (3, copied), (4, alone), (4, alone), (5, copied),
            (None, copied)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(1, copied), (2, other), (2, None), (4, alone), (4, alone), (None, copied)]
    assert by_str(rows_of(near_text.keep_one(docs))) == by_str(want)


def test_near_dense_group(spark):
    """Many edited copies of one text: pairs of copies lie on both sides of the threshold."""
    rng = random.Random(2)
    base = [f"v{k}" for k in range(120)]
    texts = []
    for _ in range(120):
        doc = list(base)
        for _ in range(rng.randrange(0, 5)):
            doc[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(doc))
    ids = list(range(100, 220))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    assert by_str(rows_of(near_text.near_duplicates(docs))) == brute_near(ids, texts, 4)


def test_classes_that_would_share_a_number(spark, monkeypatch):
    plain = near_text.class_ids
    monkeypatch.setattr(near_text, "class_ids", lambda digest, attempt: plain(digest, attempt) % (5 if not attempt else 1 << 60))
    rows = document_rows(near_copies(40))
    got = near_text.near_groups(documents(spark, rows=rows).repartition(3))
    assert by_str(rows_of(got)) == brute_near([r[0] for r in rows], [r[1] for r in rows], 4)


def test_numbers_of_further_attempts_do_not_hang_on_the_first(spark):
    """Hashes are chained: digests that collide under one seed do so whatever is hashed behind them, so the seed comes first."""
    rows = spark.createDataFrame([(b"x",)], "digest binary")
    plan = rows.select(near_text.class_ids("digest", 3))._jdf.queryExecution().analyzed().toString()
    assert "xxhash64(3, digest" in plan


def test_signatures_at_the_threshold_are_within_the_distance():
    """Pairs of sets whose similarity is 0.8 exactly: how far their signatures lie apart."""
    rng = np.random.default_rng(6)
    far = []
    for _ in range(3_000):
        words = rng.integers(0, 1 << 64, 300, dtype=np.uint64)      # 240 in common, 30 of each alone
        a, b = (near_text.sign(np.sort(x)) for x in (words[:270], np.r_[words[:240], words[270:]]))
        far.append(int((np.frombuffer(a, "<u2") != np.frombuffer(b, "<u2")).sum()))
    assert 12 < np.mean(far) < 13.6 and max(far) <= near_text.DISTANCE


def test_pigeonhole_guarantees_a_common_bucket():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (300, near_text.SYMBOLS)).astype("<u2")
    b = a.copy()
    for row in b:       # as many differences as are allowed
        at = rng.choice(near_text.SYMBOLS, near_text.DISTANCE, replace=False)
        row[at] ^= rng.integers(1, 1 << 16, near_text.DISTANCE).astype("<u2")
    x, y = near_text.bucket_keys(a), near_text.bucket_keys(b)
    assert (x == y).any(axis=1).all()
    assert not (x[:-1] == y[1:]).any()
    assert near_text.DISTANCE < 2 * near_text.CHUNKS


# --- pipeline

def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    good = {r["doc_id"] for r in quality.scored(docs, labels).where("predicted = 1").collect()}
    rows = [tuple(r) for r in docs.collect() if r["doc_id"] in good]
    kept = {r[0] for r in brute_exact(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    kept = {r[0] for r in brute_near([r[0] for r in rows], [r[1] for r in rows], 5) if r[3]}
    frame = pd.DataFrame([r for r in rows if r[0] in kept], columns=docs.columns)
    taken = duck(mixing.oracle("d"), d=frame)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, text = [], dict(zip(frame.doc_id, frame.text))
    for i, size, _, _, words in taken:
        ids = library.encode(text[i], add_special_tokens=False).ids
        row = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
               hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want += [row] * (words // size)
    got = rows_of(corpus_pipeline.run(spark, SF001))
    assert sorted(got) == sorted(want)
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_pipeline_stages_keep_columns(spark):
    docs = documents(spark, rows=document_rows(near_copies(40)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns, name
        assert stage(spark, empty(spark), SF001).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF001).count() == docs.count()
    assert len(TEXTS) > 20
