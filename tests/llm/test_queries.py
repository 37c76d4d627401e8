"""Queries of the text operators against SQL, and the pipeline against a brute-force version."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm import queries, quality, secrets, shared
from ledgerline.llm.shared import table
from tests import oracle

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the supplied tables")


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), queries.QUERIES[name], queries.CHECKS[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.CHECKS)))
def test_query_covers_all_documents(spark, name):
    got = queries.QUERIES[name](spark, SF).select("doc_id").distinct().count()
    assert got == table(spark, SF, "documents").select("doc_id").distinct().count()


def test_native_queries_run_no_python(spark):
    for name in ("op3_preference_format", "op8_quality_rules"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def five_word_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_equals_plain_steps(spark):
    rows = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    held = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    good = {r["doc_id"] for r in quality.judge(table(spark, SF, "documents")).where("kept").collect()}
    held = {i: t for i, t in held.items() if i in good}
    sets = {i: five_word_shingles(t) for i, t in held.items()}
    first = {i: i for i in held}
    near = [
        (i, j)
        for i in held
        for j in held
        if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    ]
    for _ in held:
        before = dict(first)
        for i, j in near:
            first[i] = first[j] = min(first[i], first[j])
        if first == before:
            break
    held = {i: t for i, t in held.items() if first[i] == i}
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == set(held)
    sizes = got.groupby("doc_id").length.sum()
    clean = {i: secrets.redacted(t, secrets.base_findings(t)) for i, t in held.items()}
    library = Tokenizer.from_file(shared.tokenizer_file(shared.BYTE_BPE))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert sizes.to_dict() == want
    assert (got.groupby("sequence_id").length.sum() <= 1024).all()


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS
