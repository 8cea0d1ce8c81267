"""The pipeline's stages against brute force, each over what the one before kept."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ordermill.llm import language, packing, toxicity
from ordermill.llm.common import held_out, materialize, table

from .test_operators import WORD, brute_components, check_packing

SF = "/root/testdata/sf0.001"


def pieces_of(text, ids):
    """(piece, start, length, crc) of a text, by the tokenizer alone."""
    found, out, at = [*ids.encode(text or "", add_special_tokens=False).ids, 0], [], 0
    while at < len(found):
        n = (len(found) - 1) % 2048 + 1 if at == 0 else 2048
        out.append((len(out), at, n, zlib.crc32(np.array(found[at : at + n], "<u4").tobytes())))
        at += n
    return out


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = docs.collect()
        assert {tuple(r) for r in after} <= {tuple(r) for r in before} and after
        kept[name] = (before, after)
    before, after = kept["toxicity"]
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not scored[r["doc_id"]]}
    before, after = kept["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} <= {r["doc_id"] for r in before if len(r["text"] or "") < 50}
    before, after = kept["near_duplicates"]
    want = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in before])}
    assert sorted(r["doc_id"] for r in after) == sorted(want)
    before, after = kept["mixing"]
    taken, there = defaultdict(int), {r["doc_id"]: len(WORD.findall(r["text"])) for r in before}
    for r in after:
        taken[r["doc_id"]] += there[r["doc_id"]]
    assert all(n <= 3 * there[d] for d, n in taken.items())
    got = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()]
    ids = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter((r["doc_id"], *p) for r in after for p in pieces_of(r["text"], ids))  # repeated documents as often
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_of_single_copies(spark):
    docs = table(spark, SF, "documents").limit(50)
    got = [r.asDict() for r in corpus_pipeline.pack(spark, docs, SF).collect()]
    check_packing(got, {r["doc_id"]: r["text"] for r in docs.collect()})


@pytest.mark.parametrize("which", ["empty", "null", "odd"])
def test_stages_over_odd_corpora(spark, which):
    """No rows; rows of nothing but nulls; nulls, repeats, odd and long texts, and a column more."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    long = "ein langer text mit vielen wörtern " * 20_000
    rows = {"empty": [], "null": [(None,) * 6] * 3, "odd": [(1, "one two three four five six", "en", "a", 1, "x"), (1, "one two three four five six", "en", "a", 1, "x"), (2, None, None, None, None, None), (3, "", "en", "b", 0, "y"), (None, "text without an id", "en", "a", 1, "z"), (4, long, "de", "b", 1, ""), (5, "\0 a\0", "xx", "b", 1, ""), (6, "１２ !!", "en", "c", 1, "")]}[which]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
    kept = docs.collect()
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert bool(got) == bool(kept) and {r["doc_id"] for r in got} == {r["doc_id"] for r in kept}


def test_what_has_no_language_goes(spark):
    docs = spark.createDataFrame([(i, "the quick brown fox jumps over the lazy dog", "en") for i in range(20)] + [(i, "der schnelle braune fuchs springt über den hund", "de") for i in range(20, 40)] + [(50, "12 34", "en"), (51, None, None), (52, "the fox", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in language.with_language(docs).collect()} == {*range(40), 52}
    assert docs.filter(held_out(4, 2)).count() and docs.select(F.max("doc_id")).first()[0] == 52
