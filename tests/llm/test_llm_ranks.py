"""Operators 11 to 13: results against brute force, the defined cases and the size of what is held."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from data import document_rows, documents, empty, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locflow.llm import chat_format, lexical, prefix_trie

CLASH = "conv_id long, turn int, role string, text string, k string, n string, node string, escapes string, q string, m string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], CLASH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- operator 11

MARKS = ["### ", "</turn>", "\\", "\n", ": ", "#", "<", "user", "x", "é😀", "\\b", "\\c", ":", "### user: ", "\n</turn>\n", "\\\\### "]
NASTY = [
    (1, 0, "system", "### user: hi</turn>"), (1, 1, "user", "\\### x"), (1, 2, "assistant", "\\\\</turn>\\"), (1, 3, "assistant", ""),
    (2, 1, "assistant", "second"), (2, None, "user", "first"), (2, 1, "assistant", "second"), (2, 1, "a tie", "third"),
    (3, 0, None, None), (3, 1, "a: b", "x"), (3, 2, "### ", "\n</turn>\n"), (3, 3, "\\c</turn>", "y"), (3, 4, "end\\", "\\"),
    (None, 0, "assistant", "nobody's"), (None, 1, "user", "é😀\u2028"), (-9, 0, "assistant", "word " * 30_000 + "</turn>" * 500),
    (4, 0, "assistant", "ends in ###"), (4, 1, "####", "#### </turn></turn>"),
]


def parsed(formatted):
    """The grammar, read by hand."""
    out, at = [], 0
    control = lambda mark, begin: next((m.start() for m in re.finditer(r"(?<!\\)" + re.escape(mark), formatted) if m.start() >= begin), -1)
    while at < len(formatted):
        assert control("### ", at) == at
        stop = control("</turn>", at)
        following = control("### ", at + 1)
        assert stop > 0 and formatted[stop - 1] == "\n" and formatted[stop + 7] == "\n"
        assert following in (-1, stop + 8)
        role, text = formatted[at + 4:stop - 1].split(": ", 1)
        for char, code in reversed(chat_format.ROLE_ESCAPES):
            role = role.replace(code, char)
        out.append((role, text.replace("\\### ", "### ").replace("\\</turn>", "</turn>")))
        at = stop + 8
    return out


def in_order(rows):
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        chats[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [x[1:] for x in sorted(v)] for c, v in chats.items()}


def brute_digests(rows):
    out = {}
    for conv, turns in in_order(rows).items():
        said = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said))
    return out


def check_chats(spark, rows):
    chats = chat_format.format_chats(chat_format.turns_of(conversations(spark, rows)))
    source = in_order(rows)
    seen = chats.collect()
    assert sorted((c.conv_id for c in seen), key=str) == sorted(source, key=str)
    for c in seen:
        assert parsed(c.formatted) == source[c.conv_id]
        cut = [c.formatted[s.start:s.stop].replace("\\### ", "### ").replace("\\</turn>", "</turn>") for s in c.loss]
        assert cut == [t for r, t in source[c.conv_id] if r == "assistant"]
    got = {r[0]: r[1:5] for r in rows_of(chat_format.digests(chats))}
    assert got == brute_digests(rows)
    return {c.conv_id: c for c in seen}


def test_chats_defined_cases(spark):
    seen = check_chats(spark, NASTY)
    assert seen[2].n_escaped == 0 and seen[1].n_escaped == 3
    assert seen[3].formatted.startswith("### : \n</turn>\n### a\\c b: x\n</turn>\n")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.lists(st.sampled_from(MARKS), max_size=4).map("".join),
                          st.lists(st.sampled_from(MARKS), max_size=6).map("".join)), min_size=1, max_size=40))
def test_chats_round_trip(spark, rows):
    check_chats(spark, rows)


def test_chat_parser_refuses_other_texts(spark):
    broken = ["x", "### user hi\n</turn>\n", "### user: hi</turn>\n", "### user: hi\n</turn>", "### user: hi\n</turn>\n### ", " ### a: b\n</turn>\n"]
    df = spark.createDataFrame([(b,) for b in broken], "f string").select(chat_format.parse(F.col("f")).alias("t"))
    assert all(r.t is None or None in r.t for r in df.collect())


def test_chat_query_on_nothing_and_without_python(spark):
    df = chat_format.formatted_conversations(spark, conversations(spark, []))
    said = "\\### Assistant: </turn> ok"
    assert [r[:5] for r in rows_of(df)] == [(-7, 2, sha(f"user\n{said}\nassistant\n{said}\n"), len(said), sha(said))]
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    assert chat_format.format_chats(chat_format.turns_of(conversations(spark, []))).count() == 0


# --- operator 12

def brute_trie(convs):
    """``convs``: id → list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = own + sum(saved[c] for c in children[node])
    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n],
                   saved[n], sha(",".join(map(str, ends[n])))) for n in members)


def brute_rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = int(math.fmod(c, 5))
        out[c] = convs.get(c - base, [])[:h] + turns[h:]
    return out


def chat_rows(n, seed, long=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        base = rng.choice([c, c, rng.randrange(n)])
        say = random.Random(base)
        for k in range(say.randrange(1, 9)):
            rows.append((c * 3 - 20, k, say.choice(["user", "assistant", None]), say.choice(["a", "b", "é", None, "long text"])))
    return rows + [(1000, k, "user", f"turn {k % 7}") for k in range(long)] + [(1001, k, "user", f"turn {k % 7}") for k in range(long - 5)]


@pytest.mark.parametrize("n, seed, long", [(1, 0, 0), (60, 1, 0), (200, 2, 90)])
def test_trie_against_brute_force(spark, monkeypatch, n, seed, long):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)       # blocks, pieces and buckets of more than one
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "FAN", 3)
    monkeypatch.setattr(prefix_trie, "POSTS", 4)
    rows = chat_rows(n, seed, long)
    df = conversations(spark, rows).repartition(5)
    convs = {c: t for c, t in in_order(rows).items()}
    assert sorted(rows_of(prefix_trie.rebuilt_trie(df))) == brute_trie(brute_rebuilt(convs))
    if long:
        assert sorted(rows_of(prefix_trie.conversation_trie(df))) == brute_trie(convs)


def test_trie_defined_cases(spark):
    rows = [(5, 1, "user", "x"), (5, None, "user", "y"), (5, 1, "user", "x"), (7, 0, None, None), (8, 3, "", ""), (None, 0, "user", "x"),
            (9, 0, "us", "erx"), (10, 0, "user", "x"), (11, 0, "user", "x" * 100_000)]
    convs = {c: t for c, t in in_order(rows).items() if c is not None}
    assert sorted(rows_of(prefix_trie.conversation_trie(conversations(spark, rows)))) == brute_trie(convs)
    assert prefix_trie.conversation_trie(conversations(spark, [])).count() == 0
    assert prefix_trie.rebuilt_trie(conversations(spark, [])).count() == 0


def test_list_ranking(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "POSTS", 5)
    order = random.Random(3).sample(range(500), 300)
    rows = [(a, b, a % 7, a % 3) for a, b in zip(order, [*order[1:], None])]
    got = {r.arc: (r.leaves, r.saved) for r in prefix_trie.ranked(
        spark.createDataFrame(rows, "arc long, next long, leaves long, saved long").repartition(4)).collect()}
    leaves = saved = 0
    for a in reversed(order):
        leaves, saved = leaves + a % 7, saved + a % 3
        assert got.pop(a) == (leaves, saved)
    assert not got


# --- operator 13

def brute_search(docs, items, k=50):
    words = lambda t: re.findall(lexical.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scored = set(words(text)), []
        for doc, c, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in asked if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, gone, doc) in enumerate(sorted(scored)[:k]):
            out.append((item, rank + 1, None if gone else doc, -score))
    return sorted(out, key=str)


def queries(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], "item_id long, text string, term string, w string")


def test_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(3000)]
    texts = [" ".join(rng.choice(words).title() for _ in range(rng.choice([1, 3, 20, 20, 20, 90]))) for _ in range(400)]
    rows = [(k, texts[k % 370], "en", "s", 0) for k in range(400)] + [(k, texts[5], "en", "s", 0) for k in range(900, 1100)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 30])))) for k in range(60)]
    monkeypatch.setattr(lexical, "PIECE_DOCS", 16)
    monkeypatch.setattr(lexical, "CELLS", 64)
    monkeypatch.setattr(lexical, "POOL", 200)
    monkeypatch.setattr(lexical, "FIRST_DOCS", 60)
    docs = documents(spark, rows=rows).repartition(7)
    want = brute_search([r[:2] for r in rows], items)
    assert sorted(rows_of(lexical.search(docs, queries(spark, items))), key=str) == want
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 25)       # several blocks, and an index of all terms
    monkeypatch.setattr(lexical, "TERMS_BYTES", 0)
    assert sorted(rows_of(lexical.search(docs, queries(spark, items))), key=str) == want
    assert sorted(rows_of(lexical.search(docs, queries(spark, items), k=3)), key=str) == brute_search([r[:2] for r in rows], items, 3)


def test_search_defined_cases(spark):
    rows = document_rows(["İstanbul K\u212a ÀÉ zoë", "zero\x00byte a_b c-d"])
    items = [(1, "the quick BROWN fox"), (2, None), (3, ""), (4, "!!"), (None, "word words naïve"), (1, "the quick BROWN fox"),
             (6, "zoë àé istanbul k\u212a byte b a"), (7, "日本語 0123456789"), (8, "nowhere"), (9, "word " * 5000)]
    got = sorted(rows_of(lexical.search(documents(spark, rows=rows), queries(spark, items))), key=str)
    assert got == brute_search([r[:2] for r in rows], items)
    assert lexical.search(empty(spark), queries(spark, items)).count() == 0
    assert lexical.search(documents(spark), queries(spark, [])).count() == 0


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(lexical, "TEXT_BYTES", 10)
    text = ("Ab, cé " * 50 + "x" * 100 + " end").encode().translate(lexical.cleaner())
    parts = list(lexical.parts(text))
    assert len(parts) > 20 and sum(parts, []) == text.split()


def test_piece_bounds_hold_for_every_document():
    import pyarrow as pa
    block = lexical.Block([(0, "a", 5), (1, "a", 7), (1, "b", 2), (0, "z", 9)], [10, 11])
    piece = lexical.Piece(block, 70, pa.array(["a", "a", "c", "b"]), np.array([1, 3, 9, 2]))
    scores = piece.scores(np.array([0, 1]), np.array([2, 1, 1, 2]), np.array([0, 1, 2, 0, 1, 2]), 3)
    impact = lambda tf: 10 ** 9 * tf // (1000 * tf + 1400)
    assert scores.tolist() == [[5 * impact(1), 5 * impact(1), 5 * impact(3)],
                               [7 * impact(1), 7 * impact(1) + 2 * impact(2), 7 * impact(3) + 2 * impact(2)]]
    assert (piece.bounds() >= scores.max(axis=1)).all()
    assert piece.bounds().tolist() == [5 * impact(3), 7 * impact(3) + 2 * impact(2)]
