import os

import pytest

from codeloom.llm import mixing
from codeloom.llm.mixing import TOKENIZER, mix, sized_texts, water_fill
from tests.conftest import rows

SCHEMA, TARGETS = "doc_id long, text string, source string, n_tokens string, repeats int", "source string, target_share double, max_repeats int, epochs string"


def test_water_filling():
    assert water_fill({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}) == {"a": 1.0, "b": 1.0}
    got = water_fill({"a": 10, "b": 100, "c": 100}, {"a": 0.6, "b": 0.2, "c": 0.2}, {"a": 3, "b": 5, "c": 5})
    assert got == {"a": 3.0, "b": 0.9, "c": 0.9}
    assert water_fill({"a": 10}, {"a": 0.5, "gone": 0.5}, {"a": 2, "gone": 4}, 1000) == {"a": 2.0, "gone": 0.0}
    assert water_fill({}, {}, {}) == {} and water_fill({"a": 1}, {"a": 0.0}, {"a": 1}) == {"a": 0.0}


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")
def test_shares_caps_and_copies(spark):
    docs = [(i, f"text number {i} of source a with some words", " A ") for i in range(400)] + [(1000 + i, f"another text {i} in source b", "b") for i in range(40)]
    docs += [(5000, "text number 3 of source a with some words", "b"), (5001, None, "a"), (5002, "", "b"), (5003, "no target", "z"), (5004, "no source", None)]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in docs], SCHEMA)
    goals = spark.createDataFrame([("a", 0.5, 1, "x"), ("B ", 0.4, 3, "x"), ("none", 0.1, 2, "x")], TARGETS)
    assert sized_texts(docs).count() == 442  # the copied text counts once, in its first source
    chosen, shares = mix(docs, goals)
    per = {r.source: r for r in shares.collect()}
    assert per["b"].epochs == 3.0 and per["none"].share == 0.0 and abs(sum(r.share for r in per.values()) - 1) < 1e-9
    got = chosen.collect()
    assert {r.repeats for r in got if r.source == "b"} == {3} and {r.repeats for r in got if r.source == "a"} == {1}
    assert 5000 not in {r.doc_id for r in got} and rows(mix(docs, goals)[0]) == rows(chosen)
    assert sum(r.repeats * r.n_tokens for r in got) == sum(r.tokens for r in per.values())


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")
def test_fractions_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"document {i} holds these words", "a" if i % 2 else "b", "", 1) for i in range(4000)], SCHEMA)
    goals = spark.createDataFrame([("a", 0.8, 3, ""), ("b", 0.2, 1, "")], TARGETS)
    shares = {r.source: r.share for r in mix(docs, goals)[1].collect()}
    assert abs(shares["a"] - 0.8) < 0.02
    assert rows(mix(docs.where("doc_id < 0"), goals)[0]) == [] and rows(mix(docs, goals.where("source = 'q'"))[0]) == []


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")
def test_copies_in_sources_without_target(spark):
    docs = [(1, "one shared text", "z"), (2, "one shared text", "b"), (3, "text without a source", None), (4, "text without a source", "A"), (5, "text of a source of no share", "zero"), (6, "text of a source of no share", "a")]
    docs += [(7, "text of two targets", "b"), (8, "text of two targets", "a"), (9, "text of no target", "z"), (10, "only in a source of no share", "zero")]
    docs = spark.createDataFrame([(*x, "", 1) for x in docs], SCHEMA)
    goals = spark.createDataFrame([("a", 0.5, 5, ""), ("b", 0.5, 5, ""), ("zero", 0.0, 5, "")], TARGETS)
    chosen, shares = mix(docs, goals)
    size = {r.source: r.size_tokens for r in shares.collect()}
    sized = {r.doc_id: r.n_tokens for r in sized_texts(docs.where("doc_id in (2, 4, 6, 7, 10)")).collect()}
    assert size == {"a": sized[4] + sized[6], "b": sized[2] + sized[7], "zero": sized[10]}
    assert {r.doc_id for r in chosen.collect()} <= {2, 4, 6, 7}


def test_both_kinds_of_vocabulary_count_alike():
    counter, path = mixing.counter, mixing.TOKENIZER
    texts = ["", "plain words", "naïve café — 你好 <|endoftext|>", "x = 1\n\n\ty\r\n", "  lead and trail  ", "a" * 5000, "it's 12345 we'll"]
    assert counter(path)(texts) == counter(path.replace(".tiktoken", ".json"))(texts)
