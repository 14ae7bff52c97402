"""Operators 1, 2, 5, 8 and 9: licences, BPE, quality, main text, token counts."""

import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from data import SF01, TEXTS, documents, empty, path, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locflow.llm import bpe, html_text, licences, quality, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def all_documents(spark):
    more = [r["text"] for r in spark.read.parquet(path("documents")).collect()]
    return documents(spark, more)


# --- operator 1

def base_places(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = []
    for phrase, label in licences.BASE.items():
        want = phrase.split(" ")
        found += [(k, label) for k in range(len(words)) if words[k:k + len(want)] == want]
    return len(words), found


def test_licences_base_against_brute_force(spark):
    docs = all_documents(spark)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    got = licences.summary(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        options = []
        for t in texts[r["doc_id"]]:
            n, found = base_places(t)
            starts = [k for k, _ in found]
            options.append((n, len(found), min(starts, default=None), max(starts, default=None),
                            ",".join(sorted({x for _, x in found}))))
        assert tuple(r)[1:6] in options
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert licences.summary(empty(spark)).count() == 0


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("SPDX-License-Identifier: GPL-2.0-only", {"gpl-2.0-only"}),
    ("licensed under the GNU General Public License, version 3", {"gpl", "gpl-3.0"}),
    ("Creative Commons Attribution-ShareAlike 4.0 International", {"cc-by-sa-4.0"}),
    ("CC BY-NC 4.0", {"cc-by", "cc-by-nc-4.0"}),
    ("Released under the MIT License.", {"mit"}),
    ("the cat sat on the mat", set()),
])
def test_licence_suppression(text, labels):
    assert {d[0] for d in licences.detect(text)[1]} == labels


def test_licence_rules_are_ordered():
    rules = licences.rules()
    assert len(rules) > 300
    assert [r.priority for r in rules] == sorted(r.priority for r in rules)
    for r in rules:     # a rule can only match where its keyword is a word
        assert re.fullmatch(rb"[0-9a-z]+", r.keyword)
        assert r.keyword in r.pattern.pattern


# --- operator 2

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BPE)


def test_bpe_against_library(spark, library):
    docs = all_documents(spark)
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(rows_of(bpe.digests(docs, BPE)), key=str) == sorted(want, key=str)
    assert bpe.digests(empty(spark), BPE).count() == 0


def test_bpe_decode_is_the_inverse(spark):
    docs = documents(spark)
    back = bpe.decode(bpe.encode(docs, BPE), BPE)
    want = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert sorted(rows_of(back), key=str) == sorted(want, key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_bpe_any_text(text):
    from tokenizers import Tokenizer
    lib = test_bpe_any_text.__dict__.setdefault("lib", Tokenizer.from_file(BPE))
    ids = bpe.encoder(BPE).ids_of([text])[0]
    assert memoryview(ids).cast("I").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert bpe.encoder(BPE).text_of(ids) == text


def test_bpe_long_text_in_blocks(monkeypatch, library):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 7)
    text = "".join(t for t in TEXTS if t and len(t) < 1000)
    assert memoryview(bpe.Encoder(BPE).ids_of([text, "", text])[2]).cast("I").tolist() == \
        library.encode(text, add_special_tokens=False).ids


# --- operator 9

def test_token_counts_against_library(spark):
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=PIECES)
    docs = all_documents(spark)
    want = []
    for r in docs.collect():
        text = r["text"] or ""
        n = len(model.encode(text))
        want.append((r["doc_id"], len(text.encode()), n, n > 4096))
    assert sorted(rows_of(token_counts.token_counts(docs, PIECES)), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(empty(spark), PIECES).count() == 0
    assert any(w[3] for w in want) and not all(w[3] for w in want)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n▁\t.é日😀<s>12"), max_size=30))
def test_pre_tokens_add_up(text):
    from sentencepiece import SentencePieceProcessor
    lib = test_pre_tokens_add_up.__dict__.setdefault("lib", SentencePieceProcessor(model_file=PIECES))
    model = token_counts.counts(PIECES)
    assert sum(model.lengths(model.cut(text))) == len(lib.encode(text))


# --- operator 5

def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = quality.scored(docs, labels).collect()
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) >= 0.95
    again = quality.scored(docs, labels).collect()
    assert sorted(rows) == sorted(again)


def test_quality_defined_cases(spark):
    docs = documents(spark)
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    everything = quality.scored(docs, label([]))
    assert everything.count() == docs.count() and everything.where("predicted = 1").count() == docs.count()
    one = quality.scored(docs, label([(7, 0, 0), (8, 0, None), (9, None, 0)]))
    assert {r["score"] for r in one.collect()} == {0.0}
    both = label([(k, int(k < 20), 0) for k in range(23)] + [(4, 1, 0), (None, 1, 0)])
    kept = quality.keep_good(docs, both)
    assert kept.columns == docs.columns
    good = quality.scored(docs, both).where("predicted = 1").count()
    assert kept.count() == good
    assert quality.scored(empty(spark), both).count() == 0 and quality.keep_good(empty(spark), both).count() == 0


def test_compiled_rules_equal_their_meaning(spark):
    rules = (quality.Rule((("capitals", "<=", 0.5), ("log_words", ">", 1.0)), 1.5),
             quality.Rule((("distinct_words", ">", 0.5),), -2.0))
    model = quality.Model(0.25, rules)
    rows = quality.statistics(documents(spark), []).select("s", quality.score(model).alias("score")).collect()
    for r in rows:
        z = 0.25 + 1.5 * (r["s"]["capitals"] <= 0.5 and r["s"]["log_words"] > 1) - 2 * (r["s"]["distinct_words"] > 0.5)
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-12


def test_paths_of_a_forest():
    text = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 0.0
"""
    a, b = quality.STATISTICS[:2]
    assert set(quality.paths(text)) == {((a, "<=", 0.5),), ((a, ">", 0.5),), tuple(sorted([(a, "<=", 0.5), (b, "<=", 2.0)])),
                                        tuple(sorted([(a, "<=", 0.5), (b, ">", 2.0)]))}


# --- operator 8

def article_of(page):
    inner = re.search(r"<article>(.*?)</article>", page, flags=re.S).group(1)
    blocks = re.split(r"<(?:/?p|/?h1|br)>", re.sub(r"</?b>", "", inner))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_main_text_of_the_pages(spark):
    for r in html_text.extract(spark.read.parquet(path("pages"))).collect():
        page = duckdb.sql(f"select html from '{path('pages')}' where page_id = {r['page_id']}").fetchall()[0][0]
        assert r["text"] == article_of(page) and r["n_chars"] == len(r["text"])


LONG = "Some sentence of the article goes on and on. " * 8
BODY = f"<h1>Title &amp; more</h1><p>{LONG}</p><p>short</p>"
WANT = f"Title & more\n{LONG.strip()}\nshort"


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a&nbsp;b<p>c  d\n e", "a b\nc d e"),
    (f"<body><div class='site-nav'><a href=1>x</a></div><div id=content>{BODY}</div><div class=sidebar><p>{LONG}</p></div>"
     f"<section class='comments'><p>{LONG * 3}</p></section></body>", WANT),
    (f"<main>{BODY}<aside>{LONG}</aside><form><p>{LONG}</p></form></main><footer>{LONG}</footer>", WANT),
    (f"<div><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><div>{BODY}</div></div>", WANT),
    (f"<article>{BODY}<article class=comment><p>{LONG}</p></article></article>", WANT),
    (f"<article class='post has-sidebar'>{BODY}<div class='cookie-notice'>{LONG}</div></article>", WANT),
    (f"<header>{LONG}</header><article>{BODY}<script>var a = '<p>{LONG}</p>';</script><style>p{{}}</style></article>", WANT),
    (f"<article>{BODY}<!-- {LONG} --><div hidden>{LONG}</div></article", WANT),
    ("<div>" * 2000 + "deep", "deep"), ("<a \"><b 'x>foo", "foo"), ("<script>never closed", ""),
])
def test_main_text_of(page, want):
    assert html_text.main_text(page or "") == want


def test_main_text_defined_cases(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", f"<article>{BODY}</article>", "y"), (1, None, None, "x")],
                                  "page_id long, url string, html string, text string")
    assert sorted(rows_of(html_text.extract(pages)), key=str) == sorted(
        [(1, None, "", 0), (1, None, "", 0), (None, "u", WANT, len(WANT))], key=str)
    assert html_text.extract(pages.where(F.lit(False))).count() == 0


OTHER = "Quite another part tells more of the same story here. " * 6
TEASERS = "<div class=col2><p>Teaser one. <a>more</a></p><p>Teaser two. <a>more</a></p></div>"
AROUND = "<div>A slogan</div><div><a>Home</a> <a>News</a></div>{}" + TEASERS + "<div>Copyright by us. Legal terms apply.</div>"


@pytest.mark.parametrize("page, want", [
    ("<body>" + AROUND.format(f"<div id=x>{BODY}</div>") + "</body>", WANT),
    ("<body><div>" + AROUND.format(f"<div id=x>{BODY}</div>") + "</div></body>", WANT),
    ("<body>" + AROUND.format(BODY) + "</body>", WANT),
    (f"<body><div>A slogan</div><div>{LONG}<br>{OTHER}</div>{TEASERS}</body>", f"{LONG.strip()}\n{OTHER.strip()}"),
    (f"<body><div>A slogan</div><div><h1>T</h1><p>lead</p><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{OTHER}</p></div></div>"
     f"{TEASERS}</body>", f"T\nlead\n{LONG.strip()}\n{LONG.strip()}\n{OTHER.strip()}"),
    (f"<body>bare {LONG}</body>", f"bare {LONG.strip()}"),
])
def test_density_leaves_out_unnamed_parts(page, want):
    assert html_text.main_text(page) == want


ARTICLES = f"<article><p>{LONG}</p><p>{LONG}</p><p>x</p><p>{LONG}</p></article><article><p>{OTHER}</p></article>"
PARTS = "\n".join([LONG.strip(), LONG.strip(), "x", LONG.strip(), OTHER.strip()])


@pytest.mark.parametrize("page, want", [
    (f"<body><main><h1>T</h1><p>lead</p>{ARTICLES}<article><p>tiny</p></article>{TEASERS}</main></body>",
     f"T\nlead\n{PARTS}\ntiny"),
    (f"<body><div><h1>T</h1>{ARTICLES}</div>{TEASERS}</body>", f"T\n{PARTS}"),
    (f"<body><article>{OTHER * 4}</article><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>short</p></div></body>",
     f"{(OTHER * 4).strip()}\nT\n{LONG.strip()}\n{LONG.strip()}\nshort"),
    (f"<body>{TEASERS}<article>{BODY}<div>a short part</div></article>{TEASERS}</body>", f"{WANT}\na short part"),
])
def test_articles_only_bound_the_widening(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("attributes, hidden", [
    ('title="the hidden cost of it"', False), ("data-title='a hidden valley'", False), ("title=hidden", False),
    ('style="overflow: hidden !important"', False), ("data-hidden=1", False), ("hidden", True), ("class=a hidden", True),
    ('hidden=""', True), ("id='x'hidden", True), ("hidden=until-found", True),
])
def test_hidden_is_an_attribute_name(attributes, hidden):
    assert html_text.main_text(f"<article>{BODY}<p {attributes}>more</p></article>") == WANT + ("" if hidden else "\nmore")


@pytest.mark.parametrize("page, want", [
    (f"<body><div class='layout-sidebar-right'><div>{BODY}</div></div></body>", WANT),
    (f"<body><div>Site</div><div id=page class=sidebar-right>{BODY}<div class=sidebar><p>{OTHER}</p></div></div></body>", WANT),
    (f"<body><div class=widget><p>{LONG}</p><p>{OTHER}</p></div></body>", f"{LONG.strip()}\n{OTHER.strip()}"),
    (f"<article>{BODY}<section class=related-work><p>{OTHER}</p></section><div class=social-history><p>old</p></div>"
     "<div id=cookie-recipe>flour</div></article>", f"{WANT}\n{OTHER.strip()}\nold\nflour"),
    (f"<article>{BODY}<div class=related-posts><a>p</a></div><div class='share-buttons'>q</div><div class=menu-fixed><a>m</a></div>"
     f"<div class=cookie-notice>{OTHER}</div></article>", WANT),
    (f"<body><div>{BODY}</div><section class=comments><article><p>{LONG * 9}</p></article></section></body>", WANT),
    (f"<body><div class=comments-area><div>{BODY}</div></div></body>", WANT),
])
def test_class_words_are_weighed(page, want):
    assert html_text.main_text(page) == want


LINKS = "<li><a>s 1</a></li><li><a>s 2</a></li><li><a>s 3</a></li>"


@pytest.mark.parametrize("page", [
    f"<body><ul>{LINKS}</ul><article>{BODY}<h2>Sources</h2><ol>{LINKS}</ol></article><div><ul>{LINKS}</ul></div></body>",
    f"<body><ul>{LINKS}</ul><div>{BODY}<h2>Sources</h2><ul>{LINKS}</ul></div>{TEASERS}</body>",
    f"<body><ul>{LINKS}</ul><main>{BODY}<h2>Sources</h2><div><ul>{LINKS}</ul></div></main></body>",
    f"<article>{BODY}<h2>Sources</h2><table><tr><td><a>s 1</a><tr><td><a>s 2</a><tr><td><a>s 3</a></table></article>",
    f"<body><ul>{LINKS}</ul>{BODY}<h2>Sources</h2><ul>{LINKS}</ul></body>",
])
def test_linked_sources_stay(page):
    assert html_text.main_text(page) == f"{WANT}\nSources\ns 1\ns 2\ns 3"


@pytest.mark.parametrize("text, want", [
    ("GNU General Public License v3.0", "gpl,gpl-3.0"), ("Mozilla Public License v2.0", "mpl-2.0"),
    ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"), ("GPL version 2 or later", "gpl-2.0-or-later"),
    ("under the GPL v3", "gpl,gpl-3.0"), ("LGPLv2.1+", "lgpl-2.1"), ("GNU LGPL v2.1", "lgpl-2.1"), ("It is BSD licensed.", "bsd"),
    ("MIT-licensed code", "mit"), ("Apache License, Version 2.0", "apache-2.0"), ("GPLv3", "gpl-3.0"), ("GPL-3.0-only", "gpl-3.0-only"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Python 2.0 was released", ""), ("since php 3.0", ""), ("room mit 0", ""), ("commercial license plates", ""),
    ("the public domain of mathematics", ""), ("This work is in the public domain.", "public-domain"),
    ("SPDX-License-Identifier: PHP-3.0", "php-3.0"), ("licensed under python 2.0", "python-2.0"),
    ("Copyright (c) 2019, 2021 A. All rights reserved", "copyright,reserved"), ("cc by 4.0 cc0", "cc-by,cc-by-4.0,cc0-1.0"),
])
def test_licence_labels(text, want):
    found = {d[0] for d in licences.detect(text)[1]}
    assert found == set(filter(None, want.split(",")))


def test_licence_rules_are_many_and_their_keywords_needed():
    """Each rule's keyword is a word of whatever its expression matches, or the rule could never be tried."""
    hand = [x.split("|", 2) for x in licences.NAMES.strip().splitlines()]
    assert len(hand) > 200 and len({tuple(x) for x in hand}) == len(hand)
    assert len(licences.rules()) > 500
    for label, keyword, expression in hand:
        assert re.search(rf"(?<![a-z0-9]){keyword}(?![a-z0-9])", expression.replace("?", " ").replace("|", " ")), (label, keyword)


def test_several_added_tokens(tmp_path):
    """Added tokens keep their own ids, each at its place."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer
    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    first = spec["added_tokens"][0]
    new = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    spec["added_tokens"].append({**first, "id": new, "content": "<|second|>"})
    p = tmp_path / "two.json"
    p.write_text(json.dumps(spec), encoding="utf-8")
    text = f"a{first['content']}b <|second|>{first['content']} c<|second|>"
    library = Tokenizer.from_file(str(p))
    want = library.encode(text, add_special_tokens=False).ids
    enc = bpe.Encoder(str(p))
    got = memoryview(enc.ids_of([text])[0]).cast("I").tolist()
    assert got == want and want.count(new) == 2
    assert enc.text_of(enc.ids_of([text])[0]) == text


def test_long_texts_of_later_scripts_are_cut_safely(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 7)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, enc = Tokenizer.from_file(path), bpe.Encoder(path)
    for text in ("日本 語の テスト  です。 a b  c\n d 's it's 1 2 ", "שלום עולם " * 40, "日本" * 50, "क ख  ग " * 9 + "é’s x", "ab cd\u2003ef 日 gh  ij",
                 "今日は良い天気です。明日も、きっと" * 40, "日本!!?。。1,2.x's,'s。it's' _,_。 。 。", "नमस्ते। ก็ดี,ค่ะ. 한국어!나" * 9):
        assert "".join(bpe.cut_safely(text, 7)) == text
        assert memoryview(enc.ids_of([text])[0]).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(list(bpe.cut_safely("שלום עולם " * 40, 7))) > 20
    assert len(list(bpe.cut_safely("今日は良い天気です。明日も、きっと" * 40, 7))) > 20


def test_open_elements_are_closed_in_linear_time():
    import time
    page = "<table><tr><td><table>" + "<b>" * 40_000 + "<tr></tr>" * 40_000 + "<li>x</li>" * 40_000
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 3


@pytest.mark.parametrize("inner, kept", [
    ("<p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>x+1</annotation></math> be</p>", "Let x+1 be"),
    ("<p>Press <button>Go</button> now</p>", "Press Go now"), ("<menu><li>one thing</li><li>two things</li></menu>", "one thing\ntwo things"),
    ('<p style="color: red; display : none">no</p>', ""), ('<p style="visibility:hidden">no</p>', ""), ('<p style="display:block">yes</p>', "yes"),
    ("<button>Buy</button>", ""),
])
def test_words_in_controls_and_formulas(inner, kept):
    assert html_text.main_text(f"<body><article>{BODY}{inner}</article></body>") == WANT + ("\n" + kept if kept else "")


def test_article_that_stands_for_scripts():
    assert html_text.main_text(f"<body><div id=app></div><noscript><article><h1>T</h1>{BODY}</article></noscript></body>") == "T\n" + WANT
    assert html_text.main_text(f"<body><noscript>Please turn scripts on.</noscript><article>{BODY}</article></body>") == WANT
