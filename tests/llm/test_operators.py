"""The operators on small tables with every awkward case, against brute force, and over a whole small corpus."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordermill.llm import common, components, fingerprints, html, language, licenses, mixing, ngram_join, packing, quality, topk, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "der lange text " * 3000
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE.upper() + " twentyone", "en", "b"),
    (4, None, "en", "a"),
    (5, "", None, None),
    (6, " \n\t ", "de", "b"),
    (7, LONG, "de", "c"),
    (8, "Ein Wort", "de", "a"),
    (8, "Ein Wort", "de", "a"),
    (9, "123 456 !!", "en", "é"),
    (None, BASE, "en", "a"),
    (10, "zwei drei vier fünf sechs sieben acht neun zehn elf", "de", "b"),
    (12, "Licensed under the Apache License, Version 2.0. und mehr Text hier", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size string, score string, node string, _bucket string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2, "x") for i in (1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10, 12)] + [(None, 1, 1, "x"), (99, None, None, "x")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def corpus(spark):
    return common.table(spark, SF, "documents")


def rows(df):
    return [r.asDict() for r in df.collect()]


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(pairs):
    """By row: (doc_id, text) to (size, component), with all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        if pairs[i][0] is not None:
            for x in s:
                inverted[x].append(i)
    for i, s in enumerate(sets):
        if pairs[i][0] is None:
            continue
        for j, n in Counter(j for x in s for j in inverted[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, len(sets[i]), min(least[find(i)]) if d is not None else None) for i, (d, _) in enumerate(pairs)), key=repr)


# --- words ------------------------------------------------------------------------------------------------------------


def test_word_hashes_agree_however_texts_are_cut(monkeypatch):
    texts = [x.encode() for x in ("A b  c\n", "", "ü b", "x" * 50, " ", "end a")]
    whole, at = common.word_hashes(texts)
    assert np.diff(at).tolist() == [3, 0, 2, 1, 0, 2]
    assert whole[0] == whole[-1] and whole[1] == whole[4]
    monkeypatch.setattr(common, "BLOCK", 4)
    common._POWERS.clear()
    cut, again = common.word_hashes(texts)
    assert cut.tolist() == whole.tolist() and again.tolist() == at.tolist()


# --- 1 HTML -----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="sidebar">aside text</div>
<div id="content"><h1>Title &amp; more</h1><p>First   paragraph, with, commas and enough of a text to count as one.<br>More&nbsp;here
<p><b>Second paragraph</b> is <a href=x>linked</a>, and it goes on for a while &lt;tag&gt;.</p><!-- <p>hidden</p> --><ul><li>a point<li>another</ul>
<form><input name=q>Search</form><div class="ad">Buy now, please, please, please</div><blockquote>quoted, yes</blockquote></div>
<section class="comments"><p>I disagree, strongly, with, all, of, this, and more.</p></section><footer>&copy; site</footer></body></html>"""


def test_main_text_keeps_the_article_alone():
    assert html.main_text(PAGE).split("\n") == [
        "Title & more", "First paragraph, with, commas and enough of a text to count as one. More here",
        "Second paragraph is linked, and it goes on for a while <tag>.", "a point", "another", "quoted, yes",
    ]


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p>", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<article><p>cut off in the mid", "cut off in the mid"), ("<nav>x", ""), ("<p>1 &lt 2 &#233;", "1 < 2 é"), ("<div " * 50, "")])
def test_main_text_of_odd_pages(page, text):
    assert html.main_text(page) == text


WORDS = "a paragraph of an article, with commas, that goes on for long enough to earn all of its points, as most of them do in practice"


def test_main_text_keeps_short_sections_of_long_articles():
    long = f"<p>{WORDS}</p>" * 20
    want = [WORDS] * 20 + ["Closing remark."]
    for tag in ("article", "main"):
        assert html.main_text(f"<{tag}><div>{long}</div><div><p>Closing remark.</p></div></{tag}>").split("\n") == want
    assert html.main_text(f"<div><section>{long}</section><section><p>Closing remark.</p></section></div>").split("\n") == want


@pytest.mark.parametrize("cut, rest", [("<p class=byline>By X", f"<p>{WORDS}"), ("<p hidden>By X", f"<p>{WORDS}"), ("<ul><li class=share>Share<li>a point</ul>", f"<p>{WORDS}"), ("<div><nav>Home</div>", f"<p>{WORDS}")])
def test_main_text_after_a_cut_part_without_its_end_tag(cut, rest):
    want = ["T", *(["a point"] if "point" in cut else []), WORDS, WORDS]
    assert html.main_text(f"<body><article><h1>T</h1>{cut}{rest}<p>{WORDS}</article></body>").split("\n") == want
    assert html.main_text(f"<head><title>t</title><body><p>{WORDS}<p>{WORDS}").split("\n") == [WORDS, WORDS]


@pytest.mark.parametrize("opening, closing", [('<div class="content-sidebar-wrap"><article>', "</article></div>"), ('<div class="layout with-sidebar"><main>', "</main></div>"), ('<div class="layout with-sidebar">', "</div>"), ('<div class="post has-comments">', "</div>"), ('<article><section class="social-issues">', "</section></article>"), ('<h1>T</h1><div class="has-comments">', "</div>")])
def test_main_text_of_wrappers_with_unlikely_names(opening, closing):
    page = f"<body>{opening}<p>{WORDS}</p><p>{WORDS}</p><div class='ad'>Buy now</div>{closing}<div class='comments'><p>I disagree, with all.</p></div></body>"
    assert html.main_text(page).split("\n")[-3:][:2] == [WORDS, WORDS] or html.main_text(page).split("\n")[-2:] == [WORDS, WORDS]
    assert html.main_text(f"<article><h1>T</h1><p>{WORDS}</p><div class='share'><a href=x>Share</a></div></article>").split("\n") == ["T", WORDS]


def plain_scores(html_text):
    """Tree scoring in its plain form, over Python's own parser: points of paragraphs to their ancestors, the best of these."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.nodes = [("root", None, [])], []

        def handle_starttag(self, tag, attributes):
            node = (tag, dict(attributes).get("id"), [])
            self.open[-1][2].append(node)
            self.open.append(node)

        def handle_endtag(self, tag):
            self.open.pop()

        def handle_data(self, data):
            self.open[-1][2].append(data)

    tree = Tree()
    tree.feed(html_text)
    scores = Counter()

    def text(node, links=None):
        return "".join(c if isinstance(c, str) and links in (None, node[0] == "a") else "" if isinstance(c, str) else text(c, None if links and c[0] == "a" else links) for c in node[2])

    def walk(node, above):
        if node[0] == "p":
            whole = text(node)
            points = (1 + whole.count(",") + min(len(whole) / 100, 3)) * (1 - len(text(node, True)) / max(1, len(whole)))
            part = 1.0
            for level, x in enumerate(above[::-1][:5]):
                scores[x[1] or x[0]] += points * part
                part = 0.5 if level == 0 else part * 0.4
        for c in node[2]:
            if not isinstance(c, str):
                walk(c, [*above, node])

    def discounted(node):
        name = node[1] or node[0]
        scores[name] *= 1 - len(text(node, True)) / max(1, len(text(node)))
        for c in node[2]:
            if not isinstance(c, str) and c[0] == "div":
                discounted(c)

    walk(tree.open[0], [])
    discounted(tree.open[0])
    return scores


def test_best_container_is_that_of_the_plain_scheme():
    """Among boxes of random paragraphs, the one with most points wins by itself where the others are far behind."""
    rng, won = np.random.default_rng(9), 0
    for _ in range(60):
        boxes = []
        for b in range(4):
            n = int(rng.integers(1, 9))
            ps = "".join(f"<p>{'word, ' * int(rng.integers(0, 6))}box{b} " + "text " * int(rng.integers(3, 60)) + (f"<a href=x>{'link ' * int(rng.integers(1, 80))}</a>" if rng.random() < 0.3 else "") + "</p>" for _ in range(n))
            boxes.append(f"<div id=b{b}>{ps}</div>")
        page = f"<div id=wrap1>{boxes[0]}</div><div id=wrap2>{boxes[1]}</div><div id=wrap3><div id=deep>{boxes[2]}</div></div><div id=wrap4>{boxes[3]}</div>"
        scores = plain_scores(page)
        best, second = sorted((f"b{b}" for b in range(4)), key=lambda x: -scores[x])[:2]
        if scores[best] < 1.05 * scores[second]:
            continue
        text = html.main_text(page)
        assert f"box{best[1]}" in text
        others = [scores[f"wrap{i + 1}"] for i in range(4) if f"b{i}" != best]
        won += text.count("box") == text.count(f"box{best[1]}") and max(others) < scores[best]
    assert won > 10


COMMENT = "<article class='comment'><p>I disagree, with, all, of this, strongly and at some length, as readers of such pages do.</p></article>"


@pytest.mark.parametrize("page", [f"<article><p>{WORDS}</p><p>{WORDS}</p></article>{COMMENT}", f"<div id=story><p>{WORDS}</p><p>{WORDS}</p></div>{COMMENT}", f"<article class='post has-comments'><p>{WORDS}</p><p>{WORDS}</p>{COMMENT}{COMMENT}</article>"])
def test_comments_in_articles_of_their_own_are_cut(page):
    assert html.main_text(page).split("\n") == [WORDS, WORDS]


@pytest.mark.parametrize("page", ["<div>x " * 50_000, "<p>x</b> " * 50_000, "<b>" * 50_000 + "<hr>" * 50_000, "<ul><li>x" * 50_000, "<b>x<div class=ad>" + "<div>" * 50_000 + "y</b>" * 50_000])
def test_deep_pages_take_time_by_their_length(page):
    import time

    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 5


def test_extraction_of_tables(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (3, "v", "<p>" + "word " * 50_000, "x")], "page_id long, url string, html string, text string")
    got = rows(html.extract_main_text(pages))
    assert len(got) == 4 and sorted(got[0]) == ["n_chars", "page_id", "text", "url"]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and max(r["n_chars"] for r in got) == 249_999
    assert html.extract_main_text(pages.limit(0)).count() == 0


def test_extraction_equals_the_articles_of_the_corpus(spark):
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in common.table(spark, SF, "pages").collect()}
    for r in html.op1_html_extraction(spark, SF).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", body)
        want = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>|<[^>]*\Z", " ", b))).strip() for b in blocks]
        assert r["text"] == "\n".join(x for x in want if x)


# --- 2 fingerprints ---------------------------------------------------------------------------------------------------


def check_edits(got, texts):
    order = sorted(texts, reverse=True)
    assert len(got) == len(texts)
    for r in got:
        text, after = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_fingerprints_of_the_corpus(spark, corpus):
    got = rows(fingerprints.op2_fingerprints(spark, SF))
    check_edits(got, {r["doc_id"]: r["text"] for r in corpus.collect()})
    assert np.mean([r["near_edited"] for r in got]) > 0.4 and np.mean([r["near_next"] for r in got]) < 0.05
    by_text = defaultdict(set)
    for d, t in {r["doc_id"]: r["text"] for r in corpus.collect()}.items():
        by_text[t].add(next(r["fingerprint"] for r in got if r["doc_id"] == d))
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_of_awkward_rows(spark, docs):
    got = rows(fingerprints.fingerprint_edits(docs))
    assert len(got) == len(ROWS)
    assert [r["near_next"] for r in got if r["doc_id"] is None] == [None]
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_edits(rows(fingerprints.fingerprint_edits(unique)), {r["doc_id"]: r["text"] or "" for r in unique.collect()})
    assert fingerprints.fingerprint_edits(docs.limit(0)).count() == 0
    alone = rows(fingerprints.fingerprint_edits(docs.filter("doc_id = 1")))
    check_edits(alone, {1: BASE})


def brute_fingerprint(spark, text):
    """The same scheme in plain Python: only the hash function is Spark's."""
    words = [y for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x for y in (x if len(x) > fingerprints.LONG else [x])]
    words = [""] * 4 + words if words else []
    hashed = dict(spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", F.xxhash64("w")).collect()) if words else {}
    runs = [(hashed[a], hashed[b]) for a, b in zip(words, words[1:])]
    of_run = dict(zip(runs, (r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(runs)], "i long, a long, b long").coalesce(1).sortWithinPartitions("i").select(F.xxhash64("a", "b")).collect()))) if runs else {}
    s = [of_run[r] for r in runs]
    chosen = [(s[i], s[i + 2], s[i + 3]) for i in range(len(words) - 4) if min(s[i : i + 4]) in (s[i], s[i + 3])]
    if not chosen:
        return []
    got = spark.createDataFrame(chosen, "a long, b long, c long").select(F.xxhash64("a", "b", "c")).collect()
    return sorted({(r[0] % (1 << 64)) >> 32 for r in got})[: fingerprints.SKETCH]


def brute_likeness(a, b):
    least = sorted({*a, *b})[: fingerprints.SKETCH]
    return len({*a} & {*b} & {*least}) / len(least) if least else 1.0


def test_fingerprints_equal_the_plain_scheme(spark, corpus):
    texts = [r["text"] or "" for r in corpus.orderBy("doc_id").limit(6).collect()] + ["", " ", "one", "one two", "one two three", "x" * 30, "One two  THREE four\nfive six é ü", "漢字" * 20 + " word"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: r["f"] for r in fingerprints.with_fingerprint(df, "t", "f").collect()}
    want = [brute_fingerprint(spark, t) for t in texts]
    assert [got[i] for i in range(len(texts))] == want
    pairs = df.select(F.col("i").alias("j"), F.col("t").alias("u")).crossJoin(df)
    both = fingerprints.with_fingerprint(fingerprints.with_fingerprint(pairs, "t", "x"), "u", "y").select("i", "j", fingerprints.likeness(F.col("x"), F.col("y")).alias("l"), fingerprints.printed(F.col("x")).alias("p")).collect()
    assert all(r["l"] == brute_likeness(want[r["i"]], want[r["j"]]) and r["p"] == "".join(f"{x:08x}" for x in want[r["i"]]) for r in both)


def test_near_copies_of_any_length_are_alike(spark):
    rng = np.random.default_rng(11)
    texts = []
    for i in range(40):
        text = ""
        while len(text) < 60 + 12 * i:
            text += f"{'abcdefghijklmnopqrstuvwxyz'[rng.integers(26)]}{rng.integers(10_000)} "
        texts.append((i, text.strip(), text + "and one or two words"))
    unspaced = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 260))
    df = spark.createDataFrame([*texts, (50, unspaced[:250], unspaced)], "id long, a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "x"), "b", "y")
    got = {r["id"]: r["likeness"] for r in df.select("id", fingerprints.likeness(F.col("x"), F.col("y")).alias("likeness")).collect()}
    assert np.mean([got[i] for i, *_ in texts]) > 0.75 and min(got.values()) > 0.4


def test_texts_without_syncmers_are_not_alike(spark):
    texts = [f"{a * 60} {b * 60} {c * 60} {d * 60} {e * 60}" for a, b, c, d, e in ("abcde", "fghij", "klmno", "pqrst", "uvwxy", "12345")]
    df = spark.createDataFrame([(a, b) for a in ["", "one two three", *texts] for b in texts if a != b], "a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "x"), "b", "y")
    assert {r[0] for r in df.select(fingerprints.likeness(F.col("x"), F.col("y"))).collect()} == {0.0}


def test_anchors_depend_on_their_own_words_alone(spark):
    text = " ".join(f"w{i * 7919 % 101}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, "some other words first " + text + " and after")], "doc_id long, text string")
    found = defaultdict(set)
    for r in fingerprints.anchors(df).collect():
        found[r["doc_id"]].add((r["position"] - 4 * (r["doc_id"] == 2), r["hash"]))
    assert found[1] and found[1] <= found[2]


# --- 3, 6, 7 classifiers ----------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, labels):
    got = rows(toxicity.score_toxicity(docs, labels))
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert toxicity.score_toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_is_learned():
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ara", "oro", "ulu", "ele", "isi")]
    make = lambda bad: " ".join([*rng.choice(words, 60), *(["nasty", "awful"] if bad else [])])
    train = [(make(i % 4 == 0), int(i % 4 == 0), "xx") for i in range(300)]
    model = toxicity.fit(train)
    fresh = [(make(i % 2), i % 2) for i in range(100)]
    got = toxicity.scores(model, [t for t, _ in fresh]) >= toxicity.THRESHOLD
    assert np.mean(got == [y for _, y in fresh]) > 0.95
    assert np.isfinite(toxicity.scores(model, [None, "", "123"])).all()


def test_toxicity_is_calibrated_on_all_rows(monkeypatch):
    seen, train = [], toxicity._train
    monkeypatch.setattr(toxicity, "_train", lambda ids, y: seen.append(len(ids)) or train(ids[:60], y[:60]))
    toxicity.fit([(f"word{i % 50} " + "nasty" * (i % 4 == 0), int(i % 4 == 0), "xx") for i in range(5250)])
    assert seen == [3500] * 3 + [5250]


def test_toxicity_scores_are_those_of_a_plain_forward_pass():
    rng = np.random.default_rng(2)
    texts = ["", None, "one two three four", "nasty words, and NASTY ones " * 20, "été über 12 a-b"]
    words = [f"w{chr(97 + i)}" for i in range(20)]
    model = toxicity.fit([(" ".join(rng.choice([*words, *(["nasty"] if i % 3 == 0 else [])], 12)), int(i % 3 == 0), "xy"[i % 2]) for i in range(200)])
    for text, got in zip(texts, toxicity.scores(model, texts), strict=True):
        ids, _ = toxicity.word_ids([text or ""])
        z = model["c"]
        for w, tables in enumerate(model["tables"], 1):
            for f in range(toxicity.FILTERS):
                top = max(sum(float(tables[j][ids[i + j, 0], f]) + float(tables[j][ids[i + j, 1], f]) for j in range(w)) for i in range(len(ids) - w + 1))
                k = (w - 1) * toxicity.FILTERS + f
                z += max(top + model["bias"][k], 0) * model["out"][k]
        lang = np.argmax([sum(float(model["words"][i, g]) for i in ids[:, 0]) for g in range(2)])
        z += math.log(0.7 / 0.3) - model["shift"][lang]
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_toxicity_is_learned_in_a_task_and_travels_small(spark, monkeypatch):
    import pickle

    from ordermill.llm import learning

    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    want = toxicity.fit(learning.labelled_sample(docs, labels, "toxic", ~common.held_out(3, 1)))
    monkeypatch.setattr(toxicity, "fit", lambda rows, real=toxicity.fit, here=os.getpid(): real(rows) if os.getpid() != here else pytest.fail("learned on the driver"))
    got = toxicity.train(docs, labels)
    assert len(pickle.dumps(got)) < len(pickle.dumps(want)) / 4
    full = toxicity.unpacked(toxicity.packed(want))
    assert all((a == b).all() for x, y in zip(full["tables"], want["tables"], strict=True) for a, b in zip(x, y, strict=True))
    assert (full["words"] == want["words"]).all() and (full["shift"] == want["shift"]).all() and toxicity.packed(got) is got
    texts = [r["text"] for r in docs.limit(100).collect()]
    assert np.abs(toxicity.scores(got, texts) - toxicity.scores(want, texts)).mean() < 0.01  # sums of 32 bits come in another order


def test_samples_are_whole_texts_in_the_order_of_hashes(spark):
    from ordermill.llm import learning

    docs = spark.createDataFrame([(i, "x" * 10, "en") for i in range(50)] + [(7, "a", "en"), (None, "y", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = learning.labelled_sample(docs, labels, "toxic", F.lit(True))
    assert len(got) == 50 and sorted({len(t) for t, *_ in got}) == [1, 10]
    assert learning.labelled_sample(docs, labels, "toxic", F.lit(True), chars=95) == got[:9] or len(learning.labelled_sample(docs, labels, "toxic", F.lit(True), chars=95)) in (9, 10)
    assert len(learning.labelled_sample(docs, labels, "toxic", F.lit(True), rows=5)) <= 5


def plain_features(text):
    """The shares of quality.features one by one."""
    data, out = (text or "").encode(), [0.0] * 19
    kinds = Counter(int(quality._KIND[b]) for b in data)
    words = [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in WORD.findall(text or "")]
    n, m = max(1, len(data)), max(1, len(words))
    for k in range(9):
        out[k] = kinds[k] / n
    out[9], out[10] = kinds[2] / max(1, kinds[1] + kinds[2]), (kinds[7] + kinds[8]) / m
    if words:
        runs = [tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        out[11], out[12], out[13] = sum(a == b for a, b in zip(words, words[1:])) / m, 1 - len(set(words)) / m, max(Counter(words).values()) / (m + 20)
        out[14], out[17], out[18] = 1 - len(set(runs)) / len(runs), math.log1p(len(words)) / 10, min(1.0, n / m / 20)
    lines = data.split(b"\n")
    out[15], out[16] = 1 - len(set(lines)) / len(lines), min(1.0, len(lines) / m)
    return np.array(out)


def test_quality_is_that_of_plain_features_and_weights(corpus):
    texts = [r["text"] for r in corpus.limit(30).collect()] + [None, "", " ", "a", "A a a\nA a a\n| ! é 1"]
    x = np.array([plain_features(t) for t in texts])
    x = np.concatenate([x, np.sqrt(np.abs(x)), x > 0.05], axis=1)
    assert np.allclose(quality.features(texts), x)
    y = np.arange(len(texts)) % 3 > 0
    model = quality.fit(x, y.astype(int))
    for row, got in zip(x, quality.scores(model, texts), strict=True):
        s = sum(min(8, max(-8, (v - c) / u)) * w for v, c, u, w in zip(row, model["centre"], model["scale"], model["weights"], strict=True))
        assert got == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, (s - model["cut"]) / model["unit"])))))


def test_quality_weights_are_at_the_minimum_of_the_pairs_loss():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(size=300) > 0).astype(int)
    model = quality.fit(x, y)
    z = (x - model["centre"]) / model["scale"]
    draw = np.random.default_rng(5)
    d = np.clip(z[draw.choice(np.flatnonzero(y == 1), quality.PAIRS)] - z[draw.choice(np.flatnonzero(y == 0), quality.PAIRS)], -8, 8)
    loss = lambda w: np.mean(np.log1p(np.exp(-(d @ w)))) + quality.RIDGE / 2 * w @ w
    assert all(loss(model["weights"]) <= loss(model["weights"] + step) + 1e-9 for step in 0.01 * rng.normal(size=(20, 3)))


def test_language_is_that_of_a_plain_kernel():
    def grams(text):
        codes = common.letters(f" {text} ")
        codes = [int(c) for i, c in enumerate(codes) if c or i == 0 or codes[i - 1]]
        return [{tuple(codes[i : i + n]) for i in range(len(codes) - n + 1) if any(codes[i : i + n])} for n in (1, 2, 3)]

    texts = ["the quick brown fox and the dog", "der schnelle braune Fuchs und der Hund", "a b", "the end"]
    sets, marks = [grams(t) for t in texts], language.normed(language.presence(texts))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            want = sum(len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y))) for x, y in zip(a, b, strict=True))
            assert float(marks[i] @ marks[j]) == pytest.approx(want, abs=0.15)  # n-grams are hashed into columns
    langs = ["en", "de"] * 8
    model = language.fit(language.presence([texts[0] + f" {'x' * i}" if i % 2 == 0 else texts[1] + f" {'y' * i}" for i in range(16)]), langs)
    names, scores, leads = language.predict(model, [*texts, None, "12"])
    raw = (language.normed(language.presence(texts)) @ model["landmarks"].T) @ model["weights"]
    assert names[:2] == ["en", "de"] and names[4:] == ["und", "und"] and list(scores[4:]) == [0, 0]
    assert np.allclose(scores[:4], [1 / sum(math.exp(4 * (v - max(r))) for v in r) for r in raw]) and np.allclose(leads[:4], [abs(r[0] - r[1]) for r in raw])


def test_rare_languages_are_learned(spark):
    words = {"aa": "ka la ma na pa ra", "bb": "sto bra tri vlo", "cc": "oui euh aie", "dd": "xyz zyx qqq"}
    rng = np.random.default_rng(6)
    rows_ = [(i, " ".join(rng.choice(words[g].split(), 12)), g) for i, g in enumerate(["aa"] * 2500 + ["bb"] * 30 + ["cc"] * 12 + ["dd"] * 8)]
    got = language.identify(spark.createDataFrame(rows_, "doc_id long, text string, lang string")).collect()
    want = {i: g for i, _, g in rows_}
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in got]) > 0.99


def test_quality_is_learned_from_all_labels(spark, monkeypatch):
    """More rows than any sample, with pairs, weights and threshold as worked out from all of them at hand."""
    monkeypatch.setattr(quality, "PAIRS", 300)
    monkeypatch.setattr(quality, "RANKED", 50)
    monkeypatch.setattr(quality, "FEW", 20)
    rng = np.random.default_rng(3)
    y = (rng.random(9001) < 0.8).astype(int)
    x = rng.random((9001, 19)) * 0.2 + 0.05 * y[:, None] * (np.arange(19) < 3)
    found = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(3, [9.0] * 19), (None, [9.0] * 19)], "doc_id long, x array<double>").repartition(3)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 1), (2, None), (99999, 0)], "doc_id long, quality int")
    learned = np.array([i for i in range(9001) if zlib.crc32(str(i).encode()) % 3 != 1])
    x, y = quality.widened(x[learned]), y[learned]
    counts = {k: int((y == k).sum()) for k in (0, 1)}
    table = spark.createDataFrame([(int(i), int(k), v[:19].tolist()) for i, k, v in zip(learned, y, x, strict=True)], "doc_id long, y int, x array<double>")
    both = [(tuple(r["good"]), tuple(r["bad"])) for r in quality.pairs(table, counts).collect()]
    good, bad = ({tuple(v[:19]) for v in x[y == k]} for k in (1, 0))
    assert len(both) == counts[1] and {g for g, _ in both} == good and {b for _, b in both} == bad
    model = quality.train(found, labels)
    assert np.allclose(model["centre"], x.mean(axis=0)) and np.allclose(model["scale"], x.std(axis=0) + 1e-6)
    d = np.clip((quality.widened(np.array([g for g, _ in both])) - quality.widened(np.array([b for _, b in both]))) / model["scale"], -8, 8)
    want = quality._minimum(57, len(d), lambda w: quality._slopes(d, w))
    assert np.allclose(model["weights"], want, atol=1e-6)
    s = np.clip((x - model["centre"]) / model["scale"], -8, 8) @ model["weights"]
    assert model["cut"] == pytest.approx(np.quantile(s, (y == 0).mean())) and model["unit"] == pytest.approx(s.std() / 2)
    assert quality.nth(spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 50, "s double"), 49) == 1.0 and quality.nth(spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 50, "s double"), 50) == 2.0
    few = spark.createDataFrame([(i, int(i == 4), [0.1 * i] * 19) for i in range(9)], "doc_id long, y int, x array<double>")
    assert quality.pairs(few, {0: 8, 1: 1}).count() == 38 * 8 and quality.pairs(few, {0: 8, 1: 1}).distinct().count() == 8


def test_quality(spark, docs, labels):
    got = rows(quality.score_quality(docs, labels))
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality.score_quality(docs.limit(0), labels).count() == 0 and quality.score_quality(docs, labels.limit(0)).count() == len(ROWS)


@pytest.mark.parametrize("query, label", [(quality.op6_quality, "quality"), (toxicity.op3_toxicity, "toxic")])
def test_held_out_accuracy(spark, query, label):
    sf = SF.replace("0.001", "0.01")
    got = query(spark, sf).join(common.table(spark, sf, "labels"), "doc_id").filter("held_out").selectExpr(f"avg(cast(predicted = {label} as int)) a").first()["a"]
    assert got > 0.85


def test_language(spark, docs):
    got = rows(language.identify(docs))
    assert len(got) == len(ROWS) and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6, 9)} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0
    sf = SF.replace("0.001", "0.01")
    x = language.op7_language_id(spark, sf).join(common.table(spark, sf, "documents"), "doc_id").filter("held_out")
    assert x.filter("lang = lang_pred").count() > 0.97 * x.count()


def test_language_of_a_text_in_parts(monkeypatch):
    whole = language.presence(["a quick brown fox, über alles " * 30])
    monkeypatch.setattr(language, "_CHARS", 50)
    assert (language.presence(["a quick brown fox, über alles " * 30]) == whole).all()


# --- 4 licenses -------------------------------------------------------------------------------------------------------


def test_licenses(spark, docs, corpus):
    assert [(r["doc_id"], r["license"], r["start_word"]) for r in rows(licenses.scan_licenses(docs))] == [(12, "Apache-2.0", 0)]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    scanner = licenses.Scanner()
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    want = {(d, m[0], m[1]) for d, t in texts.items() for s in licenses.shingle_hashes([t]) for m in scanner.matches(s, range(len(scanner.templates)))}
    got = {(r["doc_id"], r["license"], r["start_word"]) for r in licenses.op4_license_scan(spark, SF).collect()}
    assert got == want and want


def plain_scan(text):
    """Containment of every template in plain Python: words, runs of five, stretches of a template's runs."""
    words = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", (text or "").lower())
    runs = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    best = {}
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            w = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", notice.lower())
            own = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
            stretch = []
            for i in [i for i, r in enumerate(runs) if r in own] + [len(runs) + 10**9]:
                if stretch and i - stretch[-1] > len(own):
                    share = len({runs[j] for j in stretch}) / len(own)
                    if share >= 0.75:
                        key, found = (name, stretch[0]), (stretch[-1] - stretch[0] + 5, share)
                        best[key] = max(best.get(key, found), found)
                    stretch = []
                stretch.append(i)
    return sorted((*k, *v) for k, v in best.items())


def test_licenses_equal_plain_containment(spark, corpus):
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    rng = np.random.default_rng(8)
    notices = [n for group in licenses.TEMPLATES.values() for n in group]
    for i in range(60):
        words = " ".join(f"w{x}" for x in rng.integers(0, 99, int(rng.integers(0, 60)))).split()
        for n in rng.choice(len(notices), 2):
            w = notices[n].split()
            a = int(rng.integers(0, 1 + len(w) // 3))
            words += [*w[a : len(w) - int(rng.integers(0, 1 + len(w) // 6))], *(f"v{x}" for x in rng.integers(0, 99, int(rng.integers(0, 40))))]
        texts[10**6 + i] = " ".join(words)
    got = defaultdict(list)
    for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["license"], r["start_word"], r["n_words"], r["containment"]))
    want = {d: found for d, t in texts.items() if (found := plain_scan(t))}
    assert {d: sorted(x) for d, x in got.items()} == want and len(want) > 30


def test_license_retrieval_of_damaged_notices():
    scanner, rng = licenses.Scanner(), np.random.default_rng(3)
    texts, want = [], []
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            w = notice.split()
            if len(w) > 40:
                w[len(w) // 2] = "changed"
            texts.append(" ".join([*(f"x{i}" for i in rng.integers(0, 999, 70)), *w, *(f"y{i}" for i in rng.integers(0, 999, 90))]))
            want.append(name)
    found = scanner.scan([None, *texts, ""])
    assert all(name in {m[0] for m in x} for name, x in zip(want, found[1:-1], strict=True))


# --- 5 top-k ----------------------------------------------------------------------------------------------------------


def brute_top_k(vectors, every=50, k=5):
    q = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors]
    out = []
    for i, v in q:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, u)), j) for j, u in q if j != i and len(u) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(i, vectors[3][1]) for i in range(400, 460)]  # ties
    odd = [(1000, None), (1050, [float("nan")] * 8), (1100, [1.0] * 7 + [None]), (1150, [float("inf")] * 8), (None, [1.0] * 8)]
    short = [(1200, [1.0, 2.0]), (1201, [float(1 << 45), 1.0]), (1202, [-1.0, 1.0]), (1250, []), (1251, []), (1300, [0.0]), (1350, [3.0, -0.001])]
    df = spark.createDataFrame([(*r, "x", "x") for r in vectors + odd + short], "vec_id long, embedding array<float>, pivot string, score string")
    monkeypatch.setattr(topk, "CHUNK", 8)
    monkeypatch.setattr(topk, "ANNULUS", 32)
    found = lambda x: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(x).collect())
    got = found(df)
    assert got == brute_top_k(vectors + short)
    assert any(q == 1200 and r == 1 and v == 1201 for q, r, v, _ in got)
    few = df.filter("vec_id in (0, 1, 50, 100)")
    assert topk.top_k(few).count() == 9
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(few.filter("vec_id = 0")).count() == 0
    twice = few.unionByName(few.filter("vec_id = 50"))
    assert sum(r[0] == 0 for r in found(twice)) == 4 and sum(r[0] == 50 for r in found(twice)) == 3


def test_top_k_equals_its_sql_where_products_are_wide(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(3)
    rows_ = [(i, [float(x) for x in rng.integers(-(1 << 18), 1 << 18, 3)]) for i in range(40)] + [(100 + i, [float(rng.integers(1 << 35)), float(rng.integers(8)), 0.0]) for i in range(20)]
    rows_ += [(150, [float(1 << 44), 1.0]), (151, [1.0, 2.0]), (152, [2.0, 1.0]), (200, []), (201, [])]
    rows_ = [(i, [x / 4096 if len(v) == 3 and i >= 100 else x for x in v]) for i, v in rows_]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted(con.execute(topk.OP5_SQL).fetchall())
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect()) == want and max(abs(r[3]) for r in want) > 1 << 53
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(50, [1e200]), (51, [1e200])], "vec_id long, embedding array<double>"))


def test_top_k_of_cells_out_of_distance_order(spark, monkeypatch):
    """A task may read the index's files, and so the pieces of a cell, in any order."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    build = topk.build_index
    monkeypatch.setattr(topk, "build_index", lambda *a: build(*a).coalesce(1).sortWithinPartitions("pivot", F.xxhash64("vec_id")))
    monkeypatch.setattr(topk, "ANNULUS", 16)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect())
    assert got == brute_top_k(vectors)


# --- 8 mixing ---------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    total = sum(sizes.values())
    while True:
        left, shares = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        goal = {s: 3 * sizes[s] if s in capped else left * weight[s] / shares for s in names}
        above = {s for s in names if s not in capped and goal[s] > 3 * sizes[s]}
        if not above:
            return goal
        capped |= above


@pytest.mark.parametrize("whole", [True, False])
def test_mixing(spark, docs, corpus, whole):
    df = corpus if whole else docs
    got = rows(mixing.mix_sources(df))
    given = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in df.collect()]
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((d, n) for d, _, n in given if d is not None) and len(got) == len(given)
    sizes: Counter = Counter()
    for _, s, n in given:
        sizes[s] += n
    goal = brute_targets(sizes)
    source = {d: s for d, s, _ in given}
    taken: Counter = Counter()
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s]) and r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(n for _, x, n in given if x == s) / 2 + 1
    assert sorted(map(repr, rows(mixing.mix_sources(df.repartition(3))))) == sorted(map(repr, got))


def test_mixed_documents(spark, docs):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    taken = sum(r["taken"] for r in mixing.mix_sources(docs).collect())
    assert sum(len(WORD.findall(r["text"] or "")) for r in got.collect()) == taken
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


# --- 9 n-gram join ----------------------------------------------------------------------------------------------------


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_join_of_awkward_rows(spark, docs):
    assert result(ngram_join.jaccard_components(docs)) == brute_components([(d, t) for d, t, *_ in ROWS])
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
    assert ngram_join.jaccard_components(docs.filter("doc_id in (4, 5)")).count() == 2


@pytest.mark.parametrize("stars, members", [(1, 4), (1, 256), (3, 2), (3, 256)])
def test_join_of_near_copies_about_the_limit(spark, monkeypatch, stars, members):
    """Chains and families of copies whose similarity lies on both sides of three quarters."""
    monkeypatch.setattr(ngram_join, "STARS", stars)
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    monkeypatch.setattr(ngram_join, "RANGE", 500)
    monkeypatch.setattr(ngram_join, "SETS", 20)
    rng = np.random.default_rng(5)
    pairs, n = [], 0
    for family in range(12):
        size = int(rng.integers(6, 160))
        text = [f"f{family}w{i}" for i in range(size)]
        for _ in range(25):
            x = list(text)
            for _ in range(int(rng.integers(0, max(2, size // 25)))):
                x[int(rng.integers(0, len(x)))] = f"new{rng.integers(1 << 30)}"
            pairs.append((n, " ".join(x)))
            n += 1
            if rng.random() < 0.3:
                text = x
    got = result(ngram_join.jaccard_components(spark.createDataFrame(pairs, "doc_id long, text string")))
    assert got == brute_components(pairs)


def rows_made(spark, first: int, keys: str) -> list[int]:
    """Rows out of each inner join by these keys alone, in the SQL executions from `first` on."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, found = spark._jsparkSession.sharedState().statusStore(), []
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        if run < first:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if re.fullmatch(rf"\w+Join {keys}, {keys}, Inner(, Build\w+)?(, false)?", re.sub(r"#\d+L?", "", node.desc())):
                metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                counts = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                found += [int(x.get().replace(",", "")) for x in counts if x.isDefined()]
    return found


def test_members_of_open_clusters_are_joined_once(spark, monkeypatch):
    """A large group of near copies, some of them out of reach of the others: once before and once after the likeliest links."""
    rng = np.random.default_rng(8)
    pairs = []
    for n in range(300):
        x = [f"w{i}" for i in range(100)]
        for _ in range(int(rng.integers(0, 7))):
            x[int(rng.integers(0, len(x)))] = f"v{rng.integers(300)}"
        pairs.append((n, " ".join(x)))
    members = []

    def sharing(*args):
        found = common.materialize(sharing_before(*args), "sharing")
        members.append(found.count())
        return found

    sharing_before = ngram_join.sharing
    monkeypatch.setattr(ngram_join, "sharing", sharing)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    first = max((runs.apply(i).executionId() for i in range(runs.size())), default=-1) + 1
    assert result(ngram_join.jaccard_components(spark.createDataFrame(pairs, "doc_id long, text string"))) == brute_components(pairs)
    made = rows_made(spark, first, r"\[cluster\]")
    assert len(made) == 2 and 0 < sum(made) <= 2 * members[0]


def test_join_over_the_corpus(spark, corpus):
    assert result(ngram_join.op9_ngram_jaccard_join(spark, SF)) == brute_components([(r["doc_id"], r["text"]) for r in corpus.collect()])


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for size in [3, 4, 5, 7, 9, 12, 17, 25, 40, 77, 150, 400, 1500]:
        for _ in range(25):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            gone, new = int(rng.integers(0, size // 4 + 1)), int(rng.integers(0, size // 3 + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 75 * (len(a) + len(b) - shared) and len(a) != shared | len(b):
                if shared < max(len(a), len(b)):
                    assert len(np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(b)))


def test_bitmaps_never_rule_out_too_much():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (5, 6), (30, 40), (63, 65), (400, 300), (1000, 1300)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, m - n // 2, dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        assert shared <= ngram_join.most_shared(ngram_join.sketch(a), len(a), ngram_join.sketch(b), len(b)) <= min(len(a), len(b))


def test_one_row_of_each_component_stays(spark, docs):
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    stay = {c for _, n, c in brute_components([(d, t) for d, t, *_ in ROWS]) if n and c is not None}
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None and i not in (4, 5, 6)) == sorted(stay) and {4, 5, 6, None} <= set(ids)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (300, 100), (7, 7)] + [(1000, i) for i in range(1001, 1100)]
    got = {r["id"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100} | {i: 1000 for i in range(1000, 1100)}


# --- 10 packing -------------------------------------------------------------------------------------------------------


def check_packing(got, texts, capacity=packing.CAPACITY):
    """texts: by doc_id. The pieces rebuild every document, and fill sequences without gaps."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 0], 0
        for i, r in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            assert i == 0 or r["length"] == capacity
            at += r["length"]
        assert at == len(ids) and len(by_doc[d]) == -(-len(ids) // capacity)
    for x in by_sequence.values():
        at = 0
        for r in sorted(x, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence), sum(r["length"] for r in got)


def test_packing_of_the_corpus(spark, corpus):
    n, total = check_packing(rows(packing.op10_best_fit_packing(spark, SF)), {r["doc_id"]: r["text"] for r in corpus.collect()})
    assert n <= 1.02 * total / packing.CAPACITY + 1


def test_packing_of_awkward_rows(spark, docs):
    got = rows(packing.pack(docs))
    assert sum(r["doc_id"] is None for r in got) == 1 and sum(r["doc_id"] == 8 for r in got) == 2
    texts = ["  two  spaces ", "\n\n\nlines\n\n", "a\tb\r\nc", "<|endoftext|> x", "tail \n", "don't we'll 12 34%", " nb　sp", "a\n\nb", "\x1c\x85", "x" * 5000, "é" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packing(rows(packing.pack(df)), dict(enumerate(texts)))
    assert packing.pack(docs.limit(0)).count() == 0


def test_words_have_the_tokenizers_ids(corpus):
    ids = packing._Ids(packing.default_tokenizer())
    assert ids.merged is not None
    for r in corpus.limit(60).collect():
        assert ids.of(r["text"]) == ids.plain(r["text"])
    for text in ("it's don't I'LL we'd'", "a.b c!d e?! f-g_h ...", "x1 2y 3,4 é1", "\nnew line's\nend!!", "ʰª ǅ ñ's %%% #a", "'s 't a' b''", "中文 字, ß."):
        assert ids.of(text) == ids.plain(text)


def test_words_that_begin_with_nul_keep_it():
    ids = packing._Ids(packing.default_tokenizer())
    for text in ("a \0b c", "a \0 b", "\0", "\0a \0", "a\0b \0\0c", "x\n\0y"):
        assert ids.of(text) == ids.plain(text)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_few_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = Counter(map(int, rng.integers(1, 101, 400) if seed % 2 else rng.choice([7, 30, 33, 50, 51, 99, 100], 300)))
    plan = packing.plan(dict(lengths), 100)
    used: Counter = Counter()
    for filled, n in plan:
        assert sum(filled) <= 100 and n > 0
        for x in filled:
            used[x] += n
    assert used == lengths
    bins, least = sum(n for _, n in plan), -(-sum(k * v for k, v in lengths.items()) // 100)
    assert bins >= least and bins <= 1.05 * max(least, sum(v for k, v in lengths.items() if k > 50)) + 2
