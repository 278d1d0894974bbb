"""Each training-data operator against brute force, and on nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm.graph import components
from quarry.llm import chat, decontaminate, html, licences, neardup, oracles, packing, pii, quality, substrings, urls

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls and odd white space."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or i < 6:
            text = " ".join(rng.choices(vocabulary, k=rng.choice([1, 30, 120, 200])))
        elif kind == 1:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 2:
            w = words(rows[rng.randrange(len(rows))][1])
            w = [rng.choice(vocabulary) if rng.random() < 0.03 else x for x in w]
            text = " ".join(w)
        elif kind == 3:
            text = " ".join(rng.choices(vocabulary, k=20)) + "\n" + passage + "\t" + " ".join(rng.choices(vocabulary, k=20))
        elif kind == 4:
            text = rng.choice([None, "", " \n", "one", "Ａ b é", "A a A a " * 40])
        else:
            text = " ".join(rng.choices(vocabulary, k=90)).upper()
        rows.append((i, text))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# --- quality


def brute_repeats(w):
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 3)})


def test_quality_counts(spark, docs):
    for r in quality.document_stats(docs).join(docs, "doc_id").collect():
        t, w = r["text"] or "", words(r["text"])
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), brute_repeats(w))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))


def test_quality_learns_and_keeps_clean(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 8)))
    good = [" ".join(word() for _ in range(80)) for _ in range(120)]
    bad = [" ".join(word() + "###" for _ in range(80)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(good + bad)), DOCS)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    judged = quality.judge(rows, labels).collect()
    assert sum(r["kept"] == (r["doc_id"] < 120) for r in judged) >= 178
    clashing = rows.withColumn("n_words", F.lit("x")).withColumn("stats", F.lit(1)).withColumn("kept", F.lit(None).cast("string"))
    out = quality.filter_documents(clashing, labels)
    assert out.columns == clashing.columns and 118 <= out.count() <= 122
    assert quality.judge(empty(spark), labels.limit(0)).count() == 0
    assert quality.judge(rows, labels.limit(0)).where("kept").count() == 180


def test_labels_of_absent_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" + "###" * (i % 2) for j in range(80))) for i in range(100)], DOCS)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(100)] + [(i, 1, 0) for i in range(1000, 3000)], "doc_id long, quality int, toxic int")
    assert len(quality.fit_rules(docs, labels, sample_rows=100)) > 0


def test_quality_on_held_out_labels(spark):
    """Learned on two thirds of the given labels; the list rejects the bad and keeps the good documents of the rest."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    judged = quality.judge(docs, labels.where("doc_id % 3 > 0")).where("not base_failed").join(labels.where("doc_id % 3 = 0 and quality is not null"), "doc_id")
    got = {r["quality"]: (r["n"], r["kept"]) for r in judged.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert got[1][0] >= 50 and got[1][1] >= 0.98 * got[1][0]
    assert got[0][0] >= 5 and got[0][1] <= 0.1 * got[0][0]


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(spark, docs, tokenizer, capacity):
    rows = packing.pack_documents(docs, capacity).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    texts = dict(corpus())
    assert set(by_doc) == set(texts)
    total = 0
    for doc_id, pieces in by_doc.items():
        ids = tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        pieces.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // capacity)
        assert all(p["length"] == capacity for p in pieces[1:])
        at = 0
        for p in pieces:
            part = ids[at : at + p["length"]]
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += p["length"]
        assert at == len(ids)
    for pieces in by_bin.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    assert len(by_bin) <= -(-total // capacity) + 1 + (capacity == 16)


def test_fullest_bin_against_all_combinations():
    """The longest length left, and of all combinations of the others that fit beside it one of the largest sum."""
    rng = random.Random(31)
    for _ in range(300):
        capacity = rng.randint(4, 40)
        held = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {k: held.count(k) for k in set(held)}
        got = packing.fullest(counts, capacity)
        rest = sorted(held)[:-1]
        best = max(s for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if (s := sum(c)) <= capacity - max(held))
        assert sum(k * n for k, n in got.items()) == max(held) + best and all(n <= counts[k] for k, n in got.items()) and max(held) in got


def test_token_bytes_agree_on_odd_texts(tokenizer):
    import public_tokenizers as P

    encode = packing.TokenBytes(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), remembered=3)
    for t in ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "a\tb c", "a \tb", "it's we'll\nx y", "é b c", "a b \n c", "x " * 50 + "y", "1 2\n3", "日本 語"]:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert encode(t) == b"".join(x.to_bytes(4, "little") for x in want), repr(t)


@pytest.mark.parametrize("as_text", [True, False])
def test_strings_of_added_tokens(as_text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    encode = packing.TokenBytes(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), added_as_text=as_text)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = as_text
    for t in ["<|endoftext|>", "a <|endoftext|> b", "a\n<|endoftext|>\n\nb  c"]:
        want = library.encode(t, add_special_tokens=False).ids
        assert encode(t) == b"".join(x.to_bytes(4, "little") for x in want) and (50256 in want) != as_text


def test_packing_empty(spark):
    assert packing.pack_documents(empty(spark)).count() == 0


# --- html


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><p>Header text, long, with, many, commas, here.</p></header><nav><ul><li><a href=/>Home</a></li><li><a>B</a></li></ul></nav>
    <div class="ad">Buy, now, this, great, thing, today, at once, please.</div><div class="cookie-notice">We use cookies, you know.</div>
    <article class="post"><h1>Title &amp;  one</h1><p>First <b>bold</b> paragraph, with commas,
    and more text &lt;here&gt;.<p>Second&nbsp;one, unclosed<br>line.</p><ul><li>Item a</li><li>Item b</li></ul><form><p>Sign up, now, here.</p></form>
    <div class="comments"><p>Reader says, hello, world, to, all.</p></div></article>
    <aside><p>Side, bar, text, of, length.</p></aside><footer>&copy; foot</footer></body></html>"""
    want = "Title & one\n\nFirst bold paragraph, with commas, and more text <here>.\n\nSecond one, unclosed line.\n\nItem a\n\nItem b"
    assert html.main_text(page) == want
    assert html.main_text(page[: page.index("</ul><form>")]).startswith("Title & one")
    for cut in range(0, len(page), 37):
        html.main_text(page[:cut])
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "just text")], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract_pages(rows).collect()]
    assert got == [(1, want, len(want)), (2, "", 0), (3, "", 0), (3, "just text", 9)]
    plain = "<div>" + "".join(f"<p>Paragraph {i}, which has some length, and commas.</p>" for i in range(9)) + "</div>"
    assert html.main_text(f"<body><div class=menu><a>x</a></div>{plain}</body>").count("\n\n") == 8
    assert html.main_text("<div>" * 3000 + "deep") == "deep"


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
def test_html_keeps_divided_articles(frame):
    long = "".join(f"<p>Paragraph {i}, of some length, with commas, and more, and more, and more of it.</p>" for i in range(12))
    inner = f"<h1><a>Head</a></h1>Bare text.<section>{long}</section><h2>Next</h2><section><p>Short part.</p></section><ul><li>Item</li></ul><table><tr><td>Cell</td></tr></table><figure><figcaption>Caption</figcaption></figure><ul><li><a>L1</a></li><li><a>L2</a></li><li><a>L3</a></li></ul><div class=ad>Buy</div><p>End.</p>"
    got = html.main_text(f"<body><nav>Menu</nav><div><a>Home</a> <a>About</a></div>{frame.format(inner)}<footer>foot</footer></body>").split("\n\n")
    assert got[:2] == ["Head", "Bare text."] and got[14:] == ["Next", "Short part.", "Item", "Cell", "Caption", "End."] and len(got) == 20


LONG = "".join(f"<p>Paragraph {i}, of some length, with commas, and more, and more, and more of it.</p>" for i in range(6))


@pytest.mark.parametrize(
    ("page", "words", "without"),
    [
        (f'<body><div class="post ad-free">{LONG}</div></body>', ["Paragraph 0", "Paragraph 5"], []),
        (f'<body><article>{LONG}<p id="market-share">Share rose.</p><h2 class="header">Head</h2></article></body>', ["Share rose.", "Head", "Paragraph 5"], []),
        (f'<body><article>{LONG}<figure><img><figcaption>A caption.</figcaption></figure></article></body>', ["A caption."], []),
        (f'<body><div class="widget">{LONG}</div></body>', ["Paragraph 5"], []),
        (f'<body><article><p>Short article, yes.</p></article><div class="sidebar">{LONG}</div><div id="comments">{LONG}</div></body>', ["Short article"], ["Paragraph"]),
        (f'<body><div>{LONG}</div><div class="side-bar">Side text, long, with, many, commas.</div><div class="cookie-notice-box"><p>We use cookies, yes.</p></div><div class="ad-free-links"><a>One</a> <a>Two</a></div><ul class="share list"><li>Tweet</li></ul></body>', ["Paragraph 5"], ["Side", "cookies", "One", "Tweet"]),
    ],
)
def test_html_words_of_class_names(page, words, without):
    got = html.main_text(page)
    assert all(w in got for w in words) and not any(w in got for w in without)


def test_html_of_the_given_pages(spark):
    """Every block of a result is a run of the page's own words, in page order; nothing of its menu, advert or scripts is left."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.extract_pages(pages).collect():
        page = source[r["page_id"]] or ""
        body = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", page)
        plain, at = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split()), 0
        compact = "".join(plain.split())
        for block in r["text"].split("\n\n") if r["text"] else []:
            assert block == " ".join(block.split())
            at = compact.find("".join(block.split()), at)
            assert at >= 0, block
        assert r["n_chars"] == len(r["text"]) and not any("".join(re.sub("<[^>]*>", "", x).split()) and re.sub("<[^>]*>", "", x).strip() in r["text"].split("\n\n") for x in re.findall(r'(?s)<div class="ad">(.*?)</div>', page))


PROSE = "A sentence of the story, long enough to count, with commas, and more words. " * 3


@pytest.mark.parametrize(("page", "want"), [
    (f'<body><form id="aspnetForm"><div class="content"><p>{PROSE}</p><p>{PROSE}</p></div><input><button>go</button></form></body>', f"{PROSE.strip()}\n\n{PROSE.strip()}"),
    (f"<body><form><fieldset><div><p>{PROSE}</p></div></fieldset></form></body>", PROSE.strip()),
    (f"<main><article><p>{PROSE}</p></article><article><p>Second, {PROSE}</p></article></main>", f"{PROSE.strip()}\n\nSecond, {PROSE.strip()}"),
    (f'<article><p>{PROSE}</p><h2>Sources</h2><ul><li><a href="1">one</a></li><li><a href="2">two</a></li><li><a href="3">three</a></li></ul></article>', f"{PROSE.strip()}\n\nSources\n\none\n\ntwo\n\nthree"),
    (f'<article><p>{PROSE}</p><p class="side">an aside of the author</p><p class="search">how to look it up</p><p class="advert">Buy!</p></article>', f"{PROSE.strip()}\n\nan aside of the author\n\nhow to look it up"),
    (f'<main><p>{PROSE}</p><article class="comment"><p>{PROSE} said a reader</p></article></main>', PROSE.strip()),
    (f'<article><p>{PROSE}</p><form><label>Mail</label><input><p>Sign up</p></form></article>', PROSE.strip()),
])
def test_html_keeps_whole_articles(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("page", [
    "<p>" + '<a"' * 1_600_000, "<div>" * 300_000 + "x</p>" * 900_000, "<p>x" + "</ " * 1_600_000 + ">", "<a '" * 1_200_000 + ">y", "<!x" * 1_600_000, "<" * 3_000_000, "<section>" * 200_000 + "<li>x" * 400_000 + "</section>" * 300_000,
], ids=["quotes", "stray", "bogus", "odd quotes", "declarations", "angles", "deep"])
def test_html_of_bad_markup_is_read_in_linear_time(page):
    start = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - start < 30


def test_html_keeps_every_word_of_plain_paragraphs():
    """Pages of paragraphs, headings and lists and nothing else, against a plain stripper of tags."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdeé,.", k=rng.randint(1, 9)))
    for _ in range(200):
        blocks = [(rng.choice(["p", "p", "p", "h2", "blockquote", "li"]), " ".join(word() for _ in range(rng.randint(1, 60)))) for _ in range(rng.randint(1, 12))]
        page = "<html><body>" + "".join(f"<{t}>{x}</{t}>" for t, x in blocks) + "</body></html>"
        assert html.main_text(page) == "\n\n".join(" ".join(re.sub("<[^>]*>", " ", x).split()) for _, x in blocks if x.split())


def test_html_of_a_very_long_page():
    page = "<article>" + "<p>word, word <b>bold</b> &amp; more</p>" * 40_000 + "</article>"
    assert html.main_text(page).count("\n\n") == 39_999


# --- licences


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "nothing here " * 20), (3, "a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."), (4, "a/b/c/d/y.txt", None),
        (5, "z/y.txt", "x " * 90 + "\nThis work is licensed under the GNU General Public License, version 3."), (6, None, "no"), (7, "ab/x.txt", ""), (4, "a/b/c/d/y.txt", None),
    ]
    got = {r["doc_id"]: (r["licence"], r["found"]) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("mit", "own"), 2: ("mit", "inherited"), 3: ("apache-2.0", "own"), 4: ("apache-2.0", "inherited"), 5: ("gpl-3.0", "own"), 6: (None, "none"), 7: (None, "none")}
    assert licences.scan_licences(empty(spark, "doc_id long, path string, text string")).count() == 0
    plan = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, path string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("times", [1, 30])
def test_licence_scores_do_not_depend_on_corpus_size(spark, times):
    lines = ["All rights reserved.", "Licensed under CC BY-NC 4.0.", "Copyright notice kept here, all rights reserved."]
    texts = [*lines, *["here is a notice kept"] * 97, *["the plain words"] * 100]
    rows = spark.createDataFrame([(i + len(texts) * k, t) for k in range(times) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: (r["licence"], r["cosine"]) for r in licences.own_licences(rows).collect()}
    assert len(got) == 3 * times and got[0] == ("all-rights-reserved", 1.0) and got[1] == ("cc-by-nc-4.0", 1.0)
    assert got[2] == ("all-rights-reserved", pytest.approx(0.968, abs=2e-3))


def test_licence_files_of_any_length(spark):
    full = {name: text for name, text, whole in licences.templates() if whole}
    assert {"mit", "apache-2.0", "gpl-2.0", "gpl-3.0", "agpl-3.0", "mpl-2.0"} <= set(full)
    mit = full["mit"].replace("<year> <owner>", "2021 Jane Roe and Richard Doe")
    rows = [
        (1, "m/doc_1", mit), (2, "m/src/x.py", "code " * 40), (3, "g/COPYING", full["gpl-3.0"]), (4, "g/a/b.c", "int main"), (5, "f/COPYING.txt", full["agpl-3.0"]),
        (6, "n/LICENSE.md", "Creative Commons Attribution-NonCommercial 4.0 International Public License\n" + "terms of use " * 60), (7, "n/a/b", "text"),
        (8, "p/story.txt", "prose " * 90 + "\nReleased under the MIT License."), (9, "p/other.txt", "prose"),
    ]
    got = {r["doc_id"]: (r["licence"], r["found"]) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("mit", "own"), 2: ("mit", "inherited"), 3: ("gpl-3.0", "own"), 4: ("gpl-3.0", "inherited"), 5: ("agpl-3.0", "own"),
        6: ("cc-by-nc-4.0", "own"), 7: ("cc-by-nc-4.0", "inherited"), 8: ("mit", "own"), 9: (None, "none"),
    }


def test_licence_headers_tags_and_ties(spark):
    full = {name: text for name, text, whole in licences.templates() if whole}
    gpl = """# This program is free software: you can redistribute it and/or modify
#  it under the terms of the GNU General Public License as published by
#  the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
    apache = """/*
 * Copyright 2020 Somebody
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 */
"""
    code = "\n".join(f"value_{i} = compute({i})" for i in range(300))
    comment = "".join(f"// {x}\n" for x in full["mit"].replace("<year> <owner>", "2021 Jane Roe").split("\n"))
    rows = [
        (1, "a/x.py", gpl + code), (2, "a/y.java", apache + code), (3, "a/z.c", "// SPDX-License-Identifier: MIT\n" + code), (4, "a/w.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */\n" + code), (5, "a/v.js", comment + code),
        (6, "t/LICENSE", "Licensed under CC0 1.0"), (7, "t/COPYING", "Released under the MIT License"), (8, "t/u/v/file", code), (9, "s/LICENSE", full["bsd-3-clause"]), (10, "s/COPYING", full["gpl-2.0"]), (11, "s/file", code), (None, "q/LICENSE", full["mit"]), (12, "q/file", code), (13, "r/file", "// SPDX-License-Identifier:\n"),
        (14, "big/file", ("a line on the licence terms\n" * 60_000)), (15, "big/other", "licence " * 200_000),
    ]
    got = {r["doc_id"]: (r["licence"], r["found"], r["cosine"]) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["gpl-3.0", "apache-2.0", "mit", "gpl-2.0", "mit"] and all(got[i][1] == "own" for i in range(1, 6))
    assert got[6][2] == got[7][2] == 1.0 and got[8] == ("cc0-1.0", "inherited", 1.0)  # a tie: the lowest id
    assert got[9][0] == "bsd-3-clause" and got[10][0] == "gpl-2.0" and got[11][0] == max((got[i][2], -i, got[i][0]) for i in (9, 10))[2]
    assert got[12][1] == "none" and got[13][1] == got[14][1] == got[15][1] == "none"


# --- near copies


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies(spark, docs, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_copies(docs, k).collect()}
    assert got == brute_components(corpus(), k)


def test_near_copies_where_nodes_are_much_work(spark, monkeypatch):
    """Many texts that share boilerplate and are not linked: what the walk leaves open is settled, pair for pair."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    shared, rows = rng.choices(vocabulary, k=100), []
    for i in range(80):
        w = shared + rng.choices(vocabulary, k=16)
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join([*w[:-6], *rng.choices(vocabulary, k=6)])), (3 * i + 2, " ".join([*rng.choices(vocabulary, k=8), *w[8:-5], *rng.choices(vocabulary, k=5)]))]
    documents = spark.createDataFrame(rows, DOCS)
    sets = spark.createDataFrame([(i, sorted({zlib.crc32(" ".join(w[j : j + 2]).encode()) for j in range(len(w) - 1)})) for i, t in rows for w in [t.split()]], "id long, values array<bigint>")
    values = {r["id"]: set(r["values"]) for r in sets.collect()}
    near = {(a, b) for a in values for b in values if a < b and 100 * len(values[a] & values[b]) >= 80 * len(values[a] | values[b])}
    sets = sets.withColumn("form", F.col("id"))
    members = neardup.own_shingles(sets).withColumn("component", F.col("id"))
    met = {(r["a"], r["b"]) for r in neardup.prefix_pairs(members, sets, 80).collect()}
    assert near and near <= met
    answer = lambda: {r["doc_id"]: r["component_id"] for r in neardup.near_copies(documents, k=2).collect()}
    want = answer()
    monkeypatch.setattr(neardup, "WORK", -1)
    monkeypatch.setattr(neardup, "WORK_EACH", 0)
    assert answer() == want


@pytest.mark.parametrize("work", [-1, 10**12])
def test_near_copies_of_deep_walks_and_large_nodes(spark, monkeypatch, work):
    """Depth two and nodes of a few members already large: the links are those of brute force, whichever way open nodes are settled."""
    rng = random.Random(17)
    vocabulary = [f"u{i}" for i in range(2000)]
    shared, rows = rng.choices(vocabulary, k=90), []
    for i in range(70):
        w = shared + rng.choices(vocabulary, k=rng.choice([8, 20, 30]))
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join([*w[:-5], *rng.choices(vocabulary, k=5)])), (3 * i + 2, " ".join(rng.choices(vocabulary, k=4) + w[4:]))]
    depth = 2
    trees = math.ceil(math.log(1e-6) / math.log(1 - neardup.meet_probability(0.8, depth)))
    monkeypatch.setattr(neardup, "plan_trees", lambda n, threshold, recall: (depth, trees))
    monkeypatch.setattr(neardup, "LEAF", 4)
    monkeypatch.setattr(neardup, "WORK", work)
    monkeypatch.setattr(neardup, "WORK_EACH", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_copies(spark.createDataFrame(rows, DOCS), 2).collect()}
    assert got == brute_components(rows, 2)


@pytest.mark.parametrize("depth", [None, 4])
def test_recall_of_planted_pairs_near_the_threshold(spark, monkeypatch, depth):
    """Pairs of similarity 0.80 to 0.85 that nothing else joins, at the depth of their number and at that of four million classes."""
    rng = random.Random(23)
    rows, pairs = [], []
    shingles = lambda w: set(zip(w, w[1:], strict=False))
    while len(pairs) < 2000:
        n = rng.randint(40, 200)
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = [f"w{rng.randrange(10**6)}" if rng.random() < 0.05 else x for x in a]
        both, either = len(shingles(a) & shingles(b)), len(shingles(a) | shingles(b))
        if 80 * either <= 100 * both <= 85 * either:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    if depth:
        trees = math.ceil(math.log(1e-6) / math.log(1 - neardup.meet_probability(0.8, depth)))
        monkeypatch.setattr(neardup, "plan_trees", lambda n, threshold, recall: (depth, trees))
    of = {r["doc_id"]: r["component_id"] for r in neardup.near_copies(spark.createDataFrame(rows, DOCS), 2).collect()}
    recall = sum(of[a] == of[b] for a, b in pairs) / len(pairs)
    print(f"recall {recall:.4f} of {len(pairs)} pairs")
    assert recall >= 0.99
    assert all(of[i] in (i, i - i % 2) for i in of)


def test_texts_of_one_document_are_one(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = spark.createDataFrame([(5, a), (5, b), (2, a), (7, b + " more"), (9, "other words"), (5, None)], DOCS)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_copies(rows, 2).collect())
    assert [x for x in got if x[0] != 5] == [(2, 2, True), (7, 2, False), (9, 9, True)] and {x[1] for x in got if x[0] == 5} >= {2}


def test_near_copies_of_one_large_group(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(x if rng.random() > rng.choice([0.0, 0.02, 0.06, 0.1]) else f"n{rng.randrange(10**6)}" for x in base)) for i in range(160)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_copies(spark.createDataFrame(rows, DOCS), 2).collect()}
    assert got == brute_components(rows, 2)


def test_components_of_long_paths(spark):
    """Rounds go on until nothing changes: a path of 3000 links in mixed order, a star and a cycle."""
    rng = random.Random(8)
    names = rng.sample(range(10_000, 90_000), 3001)
    links = list(zip(names, names[1:], strict=False)) + [(5, i) for i in range(6, 40)] + [(i, 100 + (i - 99) % 50) for i in range(100, 150)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    of = lambda ids: {found.get(i, i) for i in ids}  # noqa: E731  the least of a component is not listed
    assert of(names) == {min(names)} and of(range(5, 40)) == {5} and of(range(100, 150)) == {100}


def test_near_copies_edges(spark):
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (3, None), (4, "a b c")], DOCS).withColumn("component_id", F.lit("x"))
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_copies(rows, 2).orderBy("doc_id").collect()]
    assert got == [(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 1, False)]
    kept = neardup.keep_one(rows, 2)
    assert kept.columns == rows.columns and kept.count() == 5
    assert neardup.near_copies(empty(spark), 2).count() == 0


# --- chat


CHAT_ROWS = [(1, 0, "system", "s\\"), (1, 1, "user", "<<SYS>> [INST] \\[INST]"), (1, 2, "assistant", None), (1, 3, None, "x"), (1, 4, "assistant", "[ROLE]a[/ROLE]</s><s>"), (2, 0, "user", "u"), (1, 4, "assistant", "[ROLE]a[/ROLE]</s><s>"), (None, None, "tool", "t"), (1, 9, "user", "[")]
CHAT = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("page_turns", [2, 3, 256])
def test_chat(spark, page_turns):
    table = spark.createDataFrame(CHAT_ROWS, CHAT).withColumn("segment", F.lit("z")).withColumn("pages", F.lit("z"))
    examples = chat.prefix_examples(table, page_turns)
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    for conv in (1, 2, None):
        turns = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in CHAT_ROWS if c == conv)
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv]["formatted_chars"] == sum(len(chat.format_turn(r, x)[0]) for _, r, x in turns)
    texts = {r["example"]: r for r in chat.example_texts(examples).where("conv_id = 1").collect()}
    turns = sorted((t, r or "", x or "") for c, t, r, x in CHAT_ROWS if c == 1)
    targets = [i for i, (_, r, _) in enumerate(turns) if r == "assistant"]
    assert len(texts) == len(targets) == 3 and got[1]["example_chars"] == sum(len(r["text"]) for r in texts.values())
    for e, i in enumerate(targets):
        assert chat.parse_turns(texts[e]["text"]) == [(r, x) for _, r, x in turns[: i + 1]]
        assert chat.unescape(texts[e]["text"][texts[e]["loss_start"] : texts[e]["loss_end"]]) == turns[i][2]
    for said in ("</s>[INST] ok [/INST]", "\\\\", "<<s>", "[[INST]]"):
        assert chat.unescape(chat.escape(said)) == said and not re.search(r"<s>|</s>|\[/?INST\]|<</?SYS>>", chat.escape(said))
    assert chat.read_back(chat.prefix_examples(empty(spark, CHAT))).count() == 0


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "[ROLE]", "<s>\\"]), st.text(alphabet="<>/s[]INSTROLEY\\ \n", max_size=30)), max_size=6))
def test_formatted_turns_read_back(turns):
    assert chat.parse_turns("".join(chat.format_turn(*t)[0] for t in turns)) == turns


def test_chat_without_escaping_does_not_read_back(monkeypatch):
    said = "</s>[INST] ok [/INST]"
    turns = [("user", said), ("assistant", said)]
    assert chat.parse_turns("".join(chat.format_turn(*t)[0] for t in turns)) == turns
    monkeypatch.setattr(chat, "escape", lambda text: text)
    assert chat.parse_turns("".join(chat.format_turn(*t)[0] for t in turns)) != turns


# --- decontamination


def test_decontamination(spark):
    rng = random.Random(2)
    item = [f"q{i}" for i in range(30)]
    noise = lambda n: [f"z{rng.randrange(10**6)}" for _ in range(n)]
    rows = [
        (1, " ".join(noise(50) + item + noise(50))), (2, " ".join(noise(9) + item[15:] + noise(40) + item[:15])), (3, " ".join(noise(20) + item[:12] + noise(20))), (4, None), (5, " ".join(item).upper()),
        (6, " ".join(x for i in range(0, 30, 4) for x in [*item[i : i + 4], "gap"])), (7, "tiny one"), (1, "clean"), (8, " ".join(noise(5) + item[:20] + ["typo"] + item[21:])),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("c0", F.lit(1)).withColumn("coverage", F.lit("x"))
    items = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, ""), (13, "Tiny One")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["covered_words"], r["n_tiles"]) for r in decontaminate.find_contamination(docs, items).collect()}
    assert got == {(1, 10): (30, 1), (2, 10): (30, 2), (5, 10): (30, 1), (7, 13): (2, 1), (8, 10): (29, 2)}
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 6]
    assert decontaminate.find_contamination(empty(spark), items).count() == 0 and decontaminate.drop_contaminated(docs, items.limit(0)).count() == 9


def test_tiles_are_greedy_and_disjoint():
    tiles = decontaminate.tile([(0, 0, 8), (5, 20, 9), (0, 40, 6)], 14, 3)
    assert (5, 20, 9) in tiles and sum(t[2] for t in tiles) == 14
    covered = [i for a, _, n in tiles for i in range(a, a + n)]
    assert len(covered) == len(set(covered))


def brute_tiles(a, b, least):
    """Greedy string tiling by its definition: the longest free match again and again, ties by place."""
    tiles, ua, ub = [], set(), set()
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ua and j + n not in ub:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return tiles
        tiles.append(best)
        ua |= set(range(best[0], best[0] + best[2]))
        ub |= set(range(best[1], best[1] + best[2]))


def test_tiling_against_brute_force(monkeypatch):
    rng = random.Random(12)
    for n in range(60):
        letters = "ab" if n % 2 else "abcdefg"
        a, b = ([rng.choice(letters) for _ in range(rng.randint(1, 28))] for _ in range(2))
        if n % 3:
            b = b + a[len(a) // 2 :] + a[: len(a) // 2]
        want = brute_tiles(a, b, min(3, len(a)))
        hashes = [decontaminate.word_hashes(" ".join(x).encode()) for x in (a, b)]
        assert sorted(decontaminate.tiles_by_length(*hashes, min(3, len(a)))) == sorted(want), (a, b)
        covered = sum(t[2] for t in want)
        for listed in (0, 10**9):
            monkeypatch.setattr(decontaminate, "LISTED", listed)
            got = decontaminate.Items([(7, " ".join(a).encode())], 3).found(hashes[1], 0.6)
            assert got == ([(7, len(a), covered, covered / len(a), len(want), max(t[2] for t in want))] if covered >= 0.6 * len(a) else [])


@pytest.mark.parametrize("bits", [8, 26])
def test_seed_join_against_brute_force(spark, monkeypatch, bits):
    """Items and documents over few words, with passages that most share, short and repeated items: found as by tiling every document with every item."""
    monkeypatch.setattr(decontaminate, "GATE_BITS", bits)
    monkeypatch.setattr(decontaminate, "GROUP", 3)
    rng = random.Random(77)
    common = [f"c{i}" for i in range(9)]
    some = lambda n: [rng.choice("abcdefghijkl") for _ in range(n)]
    items = [(i, (common if i % 3 == 0 else []) + some(rng.randint(1, 14))) for i in range(24)]
    items += items[:3]
    docs = []
    for i in range(40):
        words_in = some(rng.randint(0, 10)) + (common if i % 2 else [])
        for _, w in rng.sample(items, rng.randint(0, 6)):
            cut = rng.randint(0, len(w))
            words_in += w[cut:] + some(2) + w[:cut] if rng.random() < 0.5 else w
        docs.append((i // 2, " ".join(words_in)))
    docs += docs[:2]
    want = []
    for doc_id, text in docs:
        for item_id, w in items:
            tiles = brute_tiles(w, text.split(), min(5, len(w)))
            covered = sum(t[2] for t in tiles)
            if covered and covered >= 0.6 * len(w):
                want.append((doc_id, item_id, len(w), covered, covered / len(w), len(tiles), max(t[2] for t in tiles)))
    frame = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = [tuple(r) for r in decontaminate.find_contamination(*frame).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
    hit = {(doc_id, text) for doc_id, text in docs if any(decontaminate.Items([(1, " ".join(w).encode())], 5).found(decontaminate.word_hashes(text.encode()), 0.6) for _, w in items)}
    assert sorted(tuple(r) for r in decontaminate.drop_contaminated(*frame).collect()) == sorted(x for x in docs if x not in hit)


def test_frequent_seeds_meet_nothing(spark):
    """A passage that all items and documents share brings no item and document together unless it is most of the item."""
    shared = " ".join(f"s{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"{shared} d{i}") for i in range(300)] + [(999, shared + " " + " ".join(f"own7-{j}" for j in range(30)))], "doc_id long, text string")
    items = spark.createDataFrame([(i, shared + " " + " ".join(f"own{i}-{j}" for j in range(30))) for i in range(50)], "item_id long, text string")
    seeds = decontaminate.item_seeds(items.selectExpr("item_id as item", "text as item_text"), 5)
    gate = decontaminate.gate_of(seeds)
    held = decontaminate.document_seeds(decontaminate.shared_words(docs, gate, [5]).withColumn("row", F.monotonically_increasing_id()), gate, [5])
    rare = decontaminate.rare_seeds(seeds.join(held.groupBy("seed").agg(F.count("*").alias("n")), "seed"), 0.6)
    assert held.join(rare, "seed").select("row", "item").distinct().count() == 1
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(docs, items).collect()] == [(999, 7)]


def test_very_long_texts_of_one_word():
    items = decontaminate.Items([(1, b"same " * 2000), (2, b"same other " * 900)], 5)
    assert items.found(decontaminate.word_hashes(b"same " * 1_000_000), 0.6) == [(1, 2000, 2000, 1.0, 1, 2000)]


# --- substrings


def brute_removed(rows, n):
    first = {}
    for i, t in sorted(rows):
        w = words(t)
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {p for s in range(len(w) - n + 1) if first[tuple(w[s : s + n])] < i for p in range(s, s + n)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("window", "k"), [(50, 16), (12, 5)])
def test_substrings(spark, docs, window, k):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeat_report(docs, window, k).collect()}
    assert got == brute_removed(corpus(), window)


def test_substrings_branching(spark):
    rng = random.Random(8)
    parts = [[f"p{i}_{j}" for j in range(rng.randint(6, 30))] for i in range(6)]
    rows = [(i, " ".join(x for p in rng.choices(parts, k=8) for x in p)) for i in range(40)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeat_report(spark.createDataFrame(rows, DOCS), 20, 6).collect()}
    assert got == brute_removed(rows, 20)


def test_paths_are_compacted(spark):
    """Copies of one long passage make one path whose head stands for all its edges; a repeat inside a document is a branch."""
    rng = random.Random(14)
    passage = [f"s{i}" for i in range(700)]
    other = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    rows = [(i, " ".join(other(30) + passage + other(30))) for i in range(4)] + [(4, "loop " * 300), (5, "loop " * 400), (6, " ".join(passage[:300] + other(40) + passage[300:]))]
    documents = spark.createDataFrame(rows[:4], DOCS)
    spans = substrings.repeated_spans(documents).collect()
    for i in (1, 2, 3):
        of = [r for r in spans if r["doc_id"] == i]
        assert len({at for r in of for at in range(r["lo"], r["hi"] + 1)}) == 651 and max(r["hi"] - r["lo"] for r in of) > 500
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeat_report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_removed(rows, 50)


def test_words_decide_not_hashes(spark, monkeypatch):
    """Where the hashes of all words collide, nothing is removed that is not the same words."""
    monkeypatch.setattr(substrings, "read_sources", lambda docs, spans, window, f=substrings.read_sources: f(docs.withColumn("text", F.concat("text", F.lit(" x"))).withColumn("text", F.when(F.col("doc_id") == 1, F.regexp_replace("text", "q7 ", "other ")).otherwise(F.col("text"))), spans, window))
    text = " ".join(f"q{i}" for i in range(80))
    got = {r["doc_id"]: r["n_removed"] for r in substrings.repeat_report(spark.createDataFrame([(1, text), (2, text)], DOCS)).collect()}
    assert got == {1: 0, 2: 0}  # the source's words at the coordinates are others than the edges said


def test_substrings_edges(spark):
    text = " ".join(f"x{i}" for i in range(60))
    rows = spark.createDataFrame([(None, text), (2, text), (2, text), (3, text), (4, None)], DOCS).withColumn("spans", F.lit(0))
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.remove_repeats(rows).collect())
    assert got == [(0, 0), (2, 0), (2, 0), (3, 60), (4, 0)]
    assert substrings.repeat_report(empty(spark)).count() == 0


# --- urls


def test_urls(spark):
    rows = [
        (1, "https://Sub.Example.ORG/es/x?q#f"), (2, "http://example.org/en/15"), (3, "http://a.com/fr/"), (4, "http://a.com/DE/"), (5, "http://com/de/x"), (6, "x.org"), (7, None), (8, "http://free-bets.net/x"), (9, "http://x.net/casinos"),
        (10, "http://x.net?responsible-gambling&casino"), (11, "http://notexample.org"), (8, "http://free-bets.net/x"), (12, "http://z.org/casino"),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("token", F.lit("t"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(table).collect()}
    assert got == {
        1: ("sub.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/15", "example.org/en/1", "block"), 3: ("a.com", "/fr/", "com/fr/", "allow"), 4: ("a.com", "/DE/", None, "allow"), 5: ("com", "/de/x", "com/de/", "block"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("free-bets.net", "/x", None, "block"), 9: ("x.net", "/casinos", None, "allow"), 10: ("x.net", "", None, "allow"), 11: ("notexample.org", "", None, "allow"), 12: ("z.org", "/casino", "org/", "allow"),
    }
    assert urls.filter_urls(table).count() == 13 and urls.filter_urls(table.limit(0)).count() == 0
    lines = spark.createDataFrame([("^free-bets^",), ("ab*cd^ef",), ("@@||Site.net^",), ("! note",), ("",), (None,)], "value string")
    assert [(r["verdict"], r["tokens"]) for r in urls.pattern_rules(lines).collect()] == [("block", ["free", "bets"]), ("block", []), ("allow", ["site", "net"])]
    assert len(urls.PATTERN_RULES) > 150


def test_very_long_urls(spark):
    health = "http://a.net/" + "health/x-pills-y/" * 60_000
    rows = [(1, health + "casino"), (2, "http://" + "poker-." * 100_000 + "net/"), (3, "x" * 1_000_000), (4, "http://a.net/" + "play/" * 100_000)]
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "allow"}


@pytest.mark.parametrize("few", [10**9, 0])
def test_url_index_against_all_rules(spark, monkeypatch, tmp_path, few):
    """The indexed rules decide as trying every rule on every url does, also where rules have no token and are too many to broadcast."""
    monkeypatch.setattr(urls, "BROADCAST_RULES", few)
    rng = random.Random(31)
    part = lambda: "".join(rng.choices(["ab", "cd", "x1", "-", ".", "/", "ef", "?", "ünï", "A"], k=rng.randint(2, 7)))
    rows = [(i, f"http://{part()}.net/{part()}") for i in range(150)]
    lines = sorted({"".join(rng.choices(["^", "*", "ab", "cd", "x1", "-", "/", "ef", "@@", "||"], weights=[4, 2, 3, 3, 3, 1, 1, 3, 0, 0], k=rng.randint(2, 5))) for _ in range(50)})
    lines = [f"{rng.choice(['', '', '@@'])}{rng.choice(['', '', '||'])}{x}" for x in lines] + ["^ef-cd^"]
    (tmp_path / "rules.txt").write_text("\n".join(lines))
    tried = [(re.compile(oracles._pattern(x)), x.startswith("@@")) for x in lines]
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), urls.read_rules(spark, str(tmp_path / "rules.txt"))).collect()}
    for i, url in rows:
        fits = [ok for r, ok in tried if r.search(url.lower())]
        assert got[i] == ("block" if False in fits and True not in fits else "allow"), url[:80]


# --- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or "", re.A):
            d = re.sub(r"\D", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def pii_rows():
    rng = random.Random(4)
    alphabet = "ab1.@+-( )459%_\n🙂é"
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 120)))) for i in range(150)]
    fixed = ["4111 1111 1111 1111 and 4111111111111112", "x 10.0.0.256 1.2.3.4.5 01.002.3.255", "+1 (017) 555-7713, +12345678", "a@b.c_d@e.f a@b..c", "🙂 me@x.org 🙂", None, "", "9" * 30000, "a." * 20000 + "@", "1-1" * 9000, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    return rows + [(1000 + i, t) for i, t in enumerate(fixed)] + [(1000, fixed[0])]


def test_base_spans(spark):
    rows = pii_rows()
    table = spark.createDataFrame(rows, DOCS).withColumn("base", F.lit("x"))
    got = {r["doc_id"]: r for r in pii.find_pii(table).collect()}
    for i, t in rows:
        want = brute_base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (i, t and t[:80], want)
        assert want == "" or got[i]["spans"].startswith(want)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [want.count(k) for k in pii.KINDS]
    assert pii.find_pii(empty(spark)).count() == 0


def test_texts_of_very_many_matches(spark):
    """Time grows with the matches of a text, not with their square; positions stay exact over the segments, and nothing leaves the JVM."""
    took = []
    for n in (5_000, 20_000):
        text = " ".join(f"u{i}@m.org" if i % 3 else f"10.0.{i % 300}.7, +1 555 {i:07d};" for i in range(n)) + "🙂 é"
        docs = spark.createDataFrame([(1, text)], DOCS)
        start = time.perf_counter()
        row = pii.find_pii(docs).first()
        took.append(time.perf_counter() - start)
        assert row["base_sha256"] == hashlib.sha256(brute_base(text).encode()).hexdigest() and row["n_email"] == n - -(-n // 3)
    assert took[1] < 8 * took[0] + 10
    cleaned = pii.redact(docs)
    assert cleaned.first()["text"].count("[EMAIL]") == row["n_email"] and cleaned.first()["text"].endswith("🙂 é")
    assert not re.search("Python|Arrow", cleaned._jdf.queryExecution().toString())


def test_segments_cut_no_match(spark):
    """Every segment ends where no pattern goes on; together they are the text."""
    rng = random.Random(12)
    pieces = ["4111 1111 1111 1111", "+1 (555) 010-2030", "10.0.0.1", "a.b@c.de", "x@y", "word", ", ", "; ", " ", "\n", "é ", "(", ") ", "- ", "k=0123456789abcdef0 "]
    text = "".join(rng.choices(pieces, k=4000))
    parts = pii.segmented(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "7" * 9000)], DOCS)).select("doc_id", "_parts").collect()
    assert ["".join(p["text"] for p in r["_parts"]) for r in parts] == [text, "", "", "7" * 9000] and len(parts[0]["_parts"]) > 5
    ends = {p["at"] + len(p["text"]) for p in parts[0]["_parts"]}
    for pattern in [*BASE.values(), r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}", r"[A-Za-z0-9_+/=-]{16,}", r"[^\x20\x09-\x0D\"'<>(),;:@]+@[^\x20\x09-\x0D\"'<>(),;:@]+"]:
        assert not any(m.start() < e < m.end() for m in re.finditer(pattern, text, re.A) for e in ends if m.start() < e < m.end())
    for p, q in zip(parts[0]["_parts"], parts[0]["_parts"][1:], strict=False):
        assert q["before"] == text[: q["at"]][-16:] and p["after"] == q["text"][0]


def test_learned_spans_and_redaction(spark):
    rng = random.Random(6)
    rows = []
    for i in range(240):
        key = "".join(rng.choices("0123456789abcdef", k=40))
        rows.append((i, f"some words token = \"{key}\" more" if i % 4 == 0 else f"write to user{i}@mail.example.com now" if i % 4 == 1 else f"build 20240{i:03d}1{i:03d} done" if i % 4 == 2 else "plain words only", 7))
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("added", F.lit("x"))
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(table).collect()}
    assert sum("secret" in found[i] for i in range(0, 240, 4)) >= 55 and sum(found[i] != "" for i in range(3, 240, 4)) == 0
    out = pii.redact(table)
    assert out.columns == table.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] == "write to [EMAIL] now" and got[3] == "plain words only" and "[SECRET]" in got[0]
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_unnamed_secrets_are_found_by_format(spark):
    """Labels come from named secrets; what is measured are the unnamed ones, which no rule sees."""
    rng = random.Random(21)
    text = lambda letters, n: "".join(rng.choices(letters, k=n))
    rows = []
    for i in range(600):
        key, ssn = text("0123456789abcdef", 40), f"{text('123456789', 3)}-{text('0123456789', 2)}-{text('0123456789', 4)}"
        rows.append((i, [f"my token = {key} keep", f"the value {key} was used", f"ssn {ssn} on file", f"then {ssn} came up", f"order 20{text('0123456789', 10)} shipped", f"see {text('abcdefghijklmnop', 20)}-{text('0123456789', 2)} for more"][i % 6]))
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    caught = lambda k, kind: sum(kind in found[i] for i in range(k, 600, 6))
    assert caught(1, "secret") >= 90 and caught(3, "number") >= 90
    assert caught(4, ":") + caught(5, ":") <= 10
    figures = pii.held_out(docs)
    assert {"secret", "number"} <= set(figures) and all(f["precision"] >= 0.9 and f["recall"] >= 0.8 for f in figures.values())


def test_spans_are_learned_from_all_candidates(spark):
    """Each candidate of a distinct text counts, however many there are, and repeated rows count once."""
    n = 9000
    key = F.concat(F.lit("k"), F.translate(F.sha1(F.col("id").cast("string")), "01234", "ghijk"))
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("my token = "), key)).otherwise(F.concat(F.lit("see abcdefghijklmnopqrst-"), F.col("id").cast("string"), F.lit(" for more")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    counts = pii.counted(pii.described(docs.union(docs), ("at",)))
    assert counts.agg(F.sum("n")).first()[0] == n
    held = docs.where(F.pmod(F.xxhash64("text"), F.lit(3)) == 0).count()
    figures = pii.held_out(docs)
    assert figures["secret"] == {"precision": 1.0, "recall": 1.0, "candidates": held} and held > 2500
    found = pii.find_pii(docs).groupBy((F.col("doc_id") % 2).alias("odd"), (F.col("spans") != "").alias("spans")).count().collect()
    assert {(r["odd"], r["spans"]): r["count"] for r in found} == {(0, True): n // 2, (1, False): n // 2}


def brute_trees(x, y, rounds):
    """Scores of greedy boosting row by row; gradients in whole units, as sums of these are exact."""
    whole = lambda a: np.floor(a * pii.UNIT + 0.5)
    share, term = y.mean(), lambda g, h: g * g / (h + 1)
    f = np.full(len(x), np.log(share / (1 - share)))

    def grown(rows, g, h, depth):
        best, (tg, th) = (1e-6, None), (g[rows].sum() / pii.UNIT, h[rows].sum() / pii.UNIT)
        for j in range(x.shape[1]) if depth else ():
            values = np.unique(x[rows, j])
            for cut in (values[1:] + values[:-1]) / 2:
                left = rows[x[rows, j] < cut]
                lg, lh = g[left].sum() / pii.UNIT, h[left].sum() / pii.UNIT
                gain = term(lg, lh) + term(tg - lg, th - lh) - term(tg, th)
                if gain > best[0]:
                    best = (gain, (j, cut))
        if best[1] is None:
            f[rows] += 0.3 * tg / (th + 1)
        else:
            low = x[rows, best[1][0]] < best[1][1]
            grown(rows[low], g, h, depth - 1)
            grown(rows[~low], g, h, depth - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        grown(np.arange(len(x)), whole(y - p), whole(p * (1 - p)), 2)
    return f


def test_trees_against_brute_force(spark):
    """Counted and grouped by Spark, the trees are those of a search over all rows and cuts, however the rows lie."""
    rng = random.Random(3)
    rows = [[float(rng.randint(0, 6)) for _ in pii.FEATURES] for _ in range(150)]
    rows = [[*r, int(r[0] > 3 and r[4] < 5 or rng.random() < 0.15), rng.randint(1, 4)] for r in rows]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pii.FEATURES) + ", y int, n long")
    model = pii.Boosted(rounds=5).fit(table)
    assert model.trees == pii.Boosted(rounds=5).fit(table.repartition(7, "digits")).trees
    got = table.select(*table.columns, model.column({c: F.col(c) for c in pii.FEATURES}).alias("f")).collect()
    every = [r for r in got for _ in range(r["n"])]
    want = brute_trees(np.array([r[: len(pii.FEATURES)] for r in every]), np.array([r["y"] for r in every], float), 5)
    assert np.abs(np.array([r["f"] for r in every]) - want).max() < 1e-6
    same = spark.createDataFrame([[1.0] * len(pii.FEATURES) + [y, 50] for y in (0, 1)], table.schema)
    assert not any(isinstance(t, tuple) for t in pii.Boosted(rounds=2).fit(same).trees)


def test_labels_and_limits_against_brute_force(spark):
    rng = random.Random(8)
    rows = [[float(rng.randint(0, 2)) for _ in pii.FEATURES] + [rng.choice(pii.ADDED), rng.random() < 0.05, rng.random() < 0.3, False, rng.randint(0, 2), rng.randint(1, 3)] for _ in range(400)]
    rows = [[*([2.0] * 6 if i < 200 else r[:6]), *r[6:]] for i, r in enumerate(rows)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pii.FEATURES) + ", kind string, inside boolean, named boolean, over boolean, part long, n long")
    shape = lambda r: (r["generator"], r["length"], r["digits"] > 0, r["letters"] > 0, r["uppers"] > 0, r["hexes"] == r["length"], r["separators"])
    given, times, agreed, checked = table.collect(), Counter(), Counter(), set()
    for r in given:
        times[shape(r)] += r["n"]
        agreed[shape(r)] += r["n"] * r["named"]
        checked |= {shape(r)} if r["inside"] else set()
    want = Counter(
        (*r, int(r["named"] or r["inside"] or shape(r) not in checked and times[shape(r)] > 3 and agreed[shape(r)] - r["named"] >= pii.AGREEING * (times[shape(r)] - 1))) for r in given
    )
    got = pii.weak_labels(table)
    assert Counter(tuple(r) for r in got.collect()) == want and any(k[-1] and not k[-6] and not k[-5] for k in want)
    scores = [(rng.choice(pii.ADDED[:2]), rng.randint(-40, 40) / 160, rng.randint(1, 3), int(rng.random() < 0.5)) for _ in range(300)]
    scores = [(k, s, n, y if s < 0.05 else 1) for k, s, n, y in scores] + [("handle", 1.0, 9, 0)]
    found = {r["kind"]: r for r in pii.limits(spark.createDataFrame(scores, "kind string, score double, n long, y int"), 0.8)}
    for kind in pii.ADDED:
        mine = [x for x in scores if x[0] == kind]
        down = {s: (sum(n for _, t, n, _ in mine if t >= s), sum(n * y for _, t, n, y in mine if t >= s)) for _, s, _, _ in mine}
        good = [s for s, (n, true) in down.items() if true / n >= 0.8]
        assert (found[kind]["n"], found[kind]["true"]) == down[min(down)]
        assert (tuple(found[kind]["least"]) if good else found[kind]["least"]) == ((min(good), *down[min(good)]) if good else None)


def test_ties_in_score(spark, monkeypatch):
    """Overlapping candidates of one score: the earlier, then the longer span stays."""
    monkeypatch.setattr(pii.Boosted, "column", lambda self, candidate: F.lit(1.0))
    monkeypatch.setattr(pii, "fit", lambda rows, precision=0.9: (pii.Boosted(), {kind: 0.0 for kind in pii.ADDED}, {}))
    got = pii.find_pii(spark.createDataFrame([(1, "a 1234567-abcdefghijklmnop b"), (2, "x" * 1_000_000 + "1")], DOCS)).collect()
    assert {r["doc_id"]: r["spans"] for r in got} == {1: "secret:2:26", 2: "secret:0:1000001"}


# --- pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    clean = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(90))
    texts = [clean() for _ in range(30)]
    passage = " ".join(f"item{i}" for i in range(20))
    texts += [texts[0], texts[1] + " extra", texts[2] + " " + passage, "short", None]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r["doc_id"] for r in packed.select("doc_id").distinct().collect()}
    assert kept == set(range(30))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in columns.split(", ")]
        assert set(range(3, 30)) <= {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_stages_at_the_edges(spark, tmp_path):
    """Empty input, repeated rows and ids, nulls and clashing columns: every stage keeps the columns, and rows of one id and text share a fate."""
    rng = random.Random(19)
    clean = lambda: " ".join("".join(rng.choices("klmnopqrst", k=rng.randint(3, 8))) for _ in range(80))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [clean() for _ in range(6)]
    rows = [(i, t, None, "s", len(t)) for i, t in enumerate(texts)] + [(2, texts[2], None, "s", len(texts[2])), (None, clean(), "en", None, None), (3, clean(), "en", "s", 1), (9, None, None, None, None), (10, "", "en", "s", 0)]
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(None, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, columns).withColumns({c: F.lit("x") for c in ("stats", "kept", "_text", "base", "added", "spans", "c0", "_id", "component_id", "coverage")})
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0, name
        if name == "packing":
            packed = stage(spark, docs, str(tmp_path)).collect()
            assert sum(r["doc_id"] == 2 for r in packed) == 2
            break
        assert none.columns == docs.columns
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        ids = [r["doc_id"] for r in out.collect()]
        assert ids.count(2) == 2 and {0, 1, 3, 4, 5, None} <= set(ids), name
        docs = out
