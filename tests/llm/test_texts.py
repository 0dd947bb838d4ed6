"""Tokens, word pieces, media, pages and mixing."""

import base64
import hashlib
import random
import zlib
from fractions import Fraction

import public_tokenizers as P
import pytest
import regex
import tiktoken

from tidepool.llm import html, mixing, mpeg, queries, tokens, wordpiece

ODD = [None, "", " ", "\n\n", "a", "É ß x", "😀 'tis don't 12345  x", "x" * 3000, "word " * 9000, "​﻿"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, size string")


# ---------------------------------------------------------------- byte-level BPE


def plain_encoding():
    with open(P.path(queries.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, small):
    plain = plain_encoding()
    texts = ODD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = tokens.encode_documents(frame(spark, texts), P.path(queries.RANKS), P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        want = plain.encode_ordinary(t)
        assert (r.n_tokens, r.ids) == (len(want), want)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_parts_change_nothing():
    rng, plain = random.Random(1), plain_encoding()
    text = "".join(rng.choice(["word", "It's", " ", "  ", "\n", "\n\n", "9", "é", "!", " \t", "Zürich"]) for _ in range(5000))
    parts = list(tokens.safe_parts(text, 50))
    assert len(parts) > 50
    assert "".join(parts) == text
    assert [i for p in parts for i in plain.encode_ordinary(p)] == plain.encode_ordinary(text)
    assert list(tokens.safe_parts("x" * 500, 50)) == ["x" * 500]


# ---------------------------------------------------------------- word pieces


def greedy(vocabulary, word):
    symbols, n = (*word, wordpiece.END), 0
    while symbols:
        k = next((k for k in range(len(symbols), 1, -1) if symbols[:k] in vocabulary), 1)
        n += symbols[:k] != (wordpiece.END,)
        symbols = symbols[k:]
    return n


def test_word_pieces_equal_greedy_matching(spark, small):
    vocabulary = wordpiece.read_vocabulary(P.path(queries.WORDS))
    known = set(vocabulary)
    texts = ODD[:8] + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    rows = wordpiece.count_tokens(frame(spark, texts), P.path(queries.WORDS)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = [w for c in (texts[r.doc_id] or "").lower().split() for w in wordpiece.WORD.findall(c)]
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(known, w.encode()) for w in words))


def test_automaton_on_random_vocabularies():
    rng = random.Random(2)
    for _ in range(60):
        vocabulary = {tuple(rng.choice(b"ab") for _ in range(rng.randrange(1, 6))) + (wordpiece.END,) * rng.randrange(2) for _ in range(12)}
        machine = wordpiece.Automaton(vocabulary)
        for _ in range(40):
            word = bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 14)))
            assert machine.count(word) == greedy(vocabulary, word)


# ---------------------------------------------------------------- MPEG audio


def test_media_round_trip(spark):
    texts = ODD + ["\0\xff" * 700, "y" * 64, "z" * 63]
    for r in mpeg.media_column(frame(spark, texts)).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        audio = mpeg.read(bytes(r.media))
        assert audio.skipped == audio.failed == 0
        assert audio.table["frames"] == len(audio.offsets)
        assert audio.table["bytes"] == sum(audio.sizes) + audio.offsets[0] - r.media.index(b"\xff\xfa")
        assert audio.duration == Fraction(1152 * len(audio.offsets), 48000)
        assert (r.duration_ticks, r.frame_offsets) == (audio.duration * mpeg.TICKS, audio.offsets)
        assert r.feature == mpeg.feature(audio)


def test_media_resynchronises_and_checks():
    media = mpeg.write(bytes(range(256)) * 40)
    whole = mpeg.read(media)
    noisy = b"\xff\xfb\x00junk" + media
    audio = mpeg.read(noisy)
    assert audio.offsets == [o + 7 for o in whole.offsets] or len(audio.offsets) == len(whole.offsets)
    damaged = bytearray(media)
    damaged[whole.offsets[2] + 8] ^= 1
    assert mpeg.read(bytes(damaged)).failed == 1
    lost = media[: whole.offsets[3]] + b"\xff" * 5 + media[whole.offsets[4] :]
    assert len(mpeg.read(lost).offsets) == len(whole.offsets) - 1
    assert mpeg.read(lost).skipped == 5
    assert mpeg.read(media + b"TAG" + b"A title".ljust(125, b"\0")).tags["title"] == "A title"
    assert mpeg.read(b"").offsets == []
    assert mpeg.feature(mpeg.read(b"nothing here")) == "none"
    assert [whole.seek(Fraction(k * 1152, 48000)) for k in range(len(whole.offsets))] == whole.offsets
    assert whole.seek(whole.duration) is None


def test_media_headers_of_all_kinds():
    assert mpeg.read_header(b"\xff\xfb\x90\x00").size == 417
    assert mpeg.read_header(b"\xff\xfd\x80\x00").size == 144 * 128000 // 44100
    assert mpeg.read_header(b"\xff\xf3\x80\xc0").samples == 576
    assert mpeg.read_header(b"\xff\xff\x90\x00").size == 12 * 288000 // 44100 * 4
    for bad in (b"\xff\xe9\x90\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xf9\x90\x00", b"\xfe\xfb\x90\x00", b"\xff"):
        assert mpeg.read_header(bad) is None
    assert mpeg.crc16(b"123456789") == 0xAEE7


# ---------------------------------------------------------------- pages


def text_of(page):
    return html.blocks(html.parse(page))


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body>
    <header>Site</header><nav><ul><li>Home</li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; line</h1><p>One\n two&nbsp;three<br>four <b>five</b></p><p>Six<ul><li>seven<li>eight</ul>
    <aside>Also read</aside><form><input><label>Name</label></form><div class="comments"><p>First!</p></div><p>&lt;nine&gt; &#233;</article>
    <section id="comments">me too</section><footer>&copy; 2020</footer></body></html>"""
    assert text_of(page) == ["Head & line", "One two three four five", "Six", "seven", "eight", "<nine> é"]


def test_names_of_the_layout_and_of_comments():
    page = """<body class="no-sidebar"><div class="wrap has-sidebar"><div class="page header">Top</div><article class="post"><h1>T</h1><p>x</p>
    <p class="notice">n</p><h2 class="header">H</h2><ol class="commentlist"><li>c</li></ol><article class="comment"><p>me</p></article></article>
    <article id="comment-7"><p>too</p></article><div class="sidebarLeft"><article><p>also</p></article></div></div></body>"""
    assert text_of(page) == ["T", "x", "H", "also"]
    assert text_of('<div class="content has-sidebar"><h1>T</h1><p>x</p></div><div class="sidebar"><p>y</p></div>') == ["T", "x"]
    assert text_of("<aside><article><p>teaser</p></article></aside><p>x</p>") == ["x"]


def test_odd_pages():
    assert text_of("") == []
    assert text_of("just text") == ["just text"]
    assert text_of("<p>a<p>b") == ["a", "b"]
    assert text_of("a < b and <b>c</b> <!-- no --> d") == ["a < b and c d"]
    assert text_of("<body><div>left</div><main><p>x</p></main></body>") == ["x"]
    assert text_of("<script>never ends <p>x") == []
    assert text_of("<p class=shadow>header advertises</p>") == ["header advertises"]
    assert text_of("<div>" * 3000 + "deep") == ["deep"]


def test_templates_are_counted_by_host(spark):
    def page(k, own, host="a.example"):
        return (k, f"https://{host}/{k}", f"<body><div><p>Welcome to the site</p></div><div class=x><p>{own}</p></div><div>Ring us</div></body>", "clash")

    rows = [page(k, f"text number {k}") for k in range(8)] + [page(20, "alone", "b.example"), page(21, "alone", "b.example")]
    rows += [(30 + k, "https://c.example/", f"<article><p>same line</p><p>own {k}</p><div>Template</div></article>", "") for k in range(8)]
    rows += [(50 + k, "https://d.example/", "<div><p>a copied page</p></div>", "") for k in range(9)]
    rows += [(60, None, None, ""), (61, "no url", "<p>x</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.main_texts(pages).collect()}
    assert len(got) == len(rows)
    assert [got[k].text for k in range(8)] == [f"text number {k}" for k in range(8)]
    assert got[20].text == "Welcome to the site\n\nalone\n\nRing us"
    assert [got[30 + k].text for k in range(8)] == [f"same line\n\nown {k}" for k in range(8)]
    assert {got[50 + k].text for k in range(9)} == {"a copied page"}
    assert (got[60].text, got[60].n_chars, got[61].text) == ("", 0, "x")


def test_given_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    texts = {r.page_id: r.text for r in html.main_texts(pages).collect()}
    for r in pages.collect():
        import html as references
        import re

        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [" ".join(references.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert texts[r.page_id].split("\n\n") == [p for p in parts if p] or texts[r.page_id] == "" and not any(parts)


# ---------------------------------------------------------------- mixing


def water(sizes, weights, limit=3.0):
    target, free, budget = {}, [s for s in sizes if sizes[s]], float(sum(sizes.values()))
    while free:
        unit = budget / sum(weights[s] for s in free)
        full = [s for s in free if weights[s] * unit > limit * sizes[s]]
        for s in full or free:
            target[s] = limit * sizes[s] if full else weights[s] * unit
        budget -= sum(target[s] for s in full)
        free = [s for s in free if s in full or s not in target] if full else []
        free = [s for s in free if s not in full]
    return {s: target.get(s, 0.0) for s in sizes}


@pytest.mark.parametrize("seed", range(6))
def test_budgets_equal_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 1000, 50000]) for s in rng.sample(["a", "B", "é", "zz", "", "m", "n"], rng.randrange(1, 7))}
    sizes[None] = rng.randrange(500)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    got = mixing.budgets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    assert {r.source: r.weight for r in got} == weights
    want = water(sizes, weights)
    assert {r.source: r.target for r in got} == pytest.approx(want)


def test_mix_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix(docs, narrow=True).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == len(texts)
    again = mixing.mix(docs.repartition(3), narrow=True).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}
    taken, size = {}, {}
    for r in rows:
        t = texts[r.doc_id]
        assert r.size == len(regex.findall(rb"[^\x20\x09-\x0D]+", (t.text or "").encode()))
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0
        taken[t.source] = taken.get(t.source, 0) + r.taken
        size.setdefault(t.source, []).append(r.size)
    target = {texts[r.doc_id].source: r.target for r in rows}
    for s, words in taken.items():
        epochs = int(target[s] // sum(size[s]))
        left = [r.size for r in rows if r.size and texts[r.doc_id].source == s and r.taken == epochs * r.size]
        more = [r.size for r in rows if r.size and texts[r.doc_id].source == s and r.taken > epochs * r.size]
        gap = target[s] - words
        # no document more, less, or in place of another would come nearer
        assert all(abs(gap) <= abs(gap - add + drop) + 1e-5 for add in [0, *left] for drop in [0, *more])
        assert {r.taken // r.size for r in rows if r.size and texts[r.doc_id].source == s} <= {epochs, epochs + 1}
    assert len(mixing.repeated(mixing.mix(docs), docs.columns).collect()) == sum(r.taken // r.size for r in rows if r.size)


def test_every_source_comes_near_its_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).toDF("source", "taken", "target").collect()
    assert len(got) == 20
    assert all(abs(r.taken - r.target) <= 0.01 * r.target for r in got)


def test_mix_of_odd_rows(spark):
    rows = [(1, None, None), (2, "", "b"), (3, "a b c", None), (3, "a b c", None), (4, "x y", "b"), (None, "q", "a"), (5, " ", "empty")]
    docs = spark.createDataFrame([(i, t, s, "clash", 5.0) for i, t, s in rows], "doc_id long, text string, source string, taken string, target double")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.size == len((r.text or "").split())
        assert r.taken <= 3 * r.size
    assert mixing.mix(docs.limit(0)).count() == 0
