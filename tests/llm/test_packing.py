"""Packing: ids of odd texts against the tokenizer, and the reduction against the best packing there is."""

from __future__ import annotations

import numpy as np
import pytest

from ordermill.llm import packing


@pytest.fixture(scope="module")
def ids():
    return packing._Ids(packing.default_tokenizer())


@pytest.mark.parametrize("chunk", [7, 64, packing.CHUNK])
def test_ids_of_any_text_are_the_tokenizers(ids, monkeypatch, chunk):
    """Random texts of words, control characters, white space of all kinds and special strings."""
    monkeypatch.setattr(packing.chunks, "__defaults__", (chunk,))
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    rng = np.random.default_rng(chunk)
    pieces = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\0", "\x01", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "<|endoftext|>", "<|", "it's", "'ll", "word", "Ärger", "12", "?!", "中文", "a", "…", "​", "﻿", "é" * 40]
    for _ in range(400):
        text = "".join(rng.choice(pieces, int(rng.integers(1, 30))))
        assert ids.of(text) == ids.plain(text), repr(text)
        text = " ".join(rng.choice(pieces[16:], int(rng.integers(1, 30))))
        assert ids.of(text) == ids.plain(text), repr(text)


def test_chunks_rebuild_the_text():
    text = "ab cd  ef\n\ngh\tij   " * 50
    for most in (1, 5, 33, 5000):
        parts = list(packing.chunks(text, most))
        assert "".join(parts) == text and all(p[0] in " \n" for p in parts[1:])


def fewest(pieces, capacity):
    """The least number of bins, by trying all."""
    pieces, least = sorted(pieces, reverse=True), [len(pieces)]

    def place(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(pieces):
            least[0] = len(bins)
            return
        for b in {x: n for n, x in enumerate(bins)}.values():
            if bins[b] + pieces[i] <= capacity:
                bins[b] += pieces[i]
                place(i + 1, bins)
                bins[b] -= pieces[i]
        bins.append(pieces[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return least[0]


def test_reduction_never_costs_a_bin():
    rng, triples = np.random.default_rng(1), 0
    for _ in range(600):
        capacity = int(rng.integers(8, 40))
        pieces = [int(x) for x in rng.integers(int(rng.integers(1, max(2, capacity // 3))), capacity + 1, int(rng.integers(1, 10)))]
        left = np.bincount(pieces, minlength=capacity + 1)
        fixed = packing.reduced(left, capacity)
        rest = [x for x in range(capacity + 1) for _ in range(int(left[x]))]
        triples += sum(len(x) == 3 for x, _ in fixed)
        assert sum(n for _, n in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(pieces, capacity)
    assert triples


def test_reduction_fixes_what_it_says():
    left = np.bincount([60, 39, 10, 10], minlength=101)
    fixed = packing.reduced(left, 100)
    assert ((60, 39), 1) in fixed and not left.any()


def test_many_pieces_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    df = spark.createDataFrame([(i % 5, "same text" if i % 3 else "another text here") for i in range(100)], "doc_id long, text string")
    got = [r.asDict() for r in packing.pack(df, capacity=16).collect()]
    assert len(got) == 100
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 16
