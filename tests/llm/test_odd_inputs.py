"""Inputs that earlier versions did not take: labels of any type, many host labels, nothing to learn from."""

from __future__ import annotations

import time

import pytest

from ledgerline.llm import embeddings, language, preference, url_filter


@pytest.mark.parametrize("kind, one, two", [("double", 1.2, 1.7), ("string", "a", "b")])
def test_labels_of_any_type_and_ids_with_several_vectors(spark, kind, one, two):
    rows = [(1, [1.0, 0.1], one), (2, [1.0, 0.11], two), (3, [1.0, 0.1], two), (3, [0.0, 1.0], one), (4, [0.0, 1.0], one)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df).collect())
    assert got == [(1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False), (3, 1, 3, True), (4, 1, 3, False)]


def test_a_host_with_many_labels(spark):
    urls = ["x://" + "a." * 20_000 + "com/en/1", "x://com/en/", "x://a..com/en/", "x://.com/en/", "x://com./en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, None)], "page_id long, url string")
    begun = time.time()
    got = {r.page_id: r.rule for r in url_filter.judge(pages).collect()}
    assert got == {0: "com/en/", 1: "com/en/", 2: "com/en/", 3: "com/en/", 4: None, None: None}
    assert time.time() - begun < 20


def test_nothing_to_learn_from_is_an_error_only_where_it_matters(spark):
    schema = "doc_id long, text string, lang string"
    with pytest.raises(ValueError, match="no labelled text"):
        language.identify(spark.createDataFrame([(1, "word", None)], schema))
    quiet = language.identify(spark.createDataFrame([(1, "12", None), (None, None, None)], schema)).collect()
    assert [r.lang_pred for r in quiet] == ["und", "und"]
    assert language.identify(spark.createDataFrame([], schema)).count() == 0


def test_other_answers_beside_columns_of_the_same_names(spark):
    rows = [(2, 0, "user", "q", "x"), (2, 1, "assistant", "a", "x"), (3, 0, "assistant", "b", "y"), (None, 0, "assistant", "c", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, last string")
    got = preference.with_other_answers(df).where("conv_id IS NOT NULL").collect()
    assert sorted(map(tuple, got)) == [(2, 0, "user", "q"), (2, 1, "assistant", "b"), (3, 0, "assistant", "a")]


def test_url_rules_are_those_of_the_contract(spark):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    pages = spark.createDataFrame([(rule, f"https://{rule}") for rule in contract], "page_id string, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {rule: (rule, verdict) for rule, verdict in contract.items()}
