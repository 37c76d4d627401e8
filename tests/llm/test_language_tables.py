"""Parsers of both layouts agree with a plain search, and many signs do not take much memory."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerline.llm import language


def _phrases(text: str, known: str) -> int:
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in known:
            end += 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("cells", [0, 1 << 26])
def test_layouts_equal_a_plain_search_and_choose_the_cheapest_language(monkeypatch, cells):
    monkeypatch.setattr(language, "TABLE_CELLS", cells)
    rng = random.Random(5)
    say = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"a": say("abcd ", 300), "b": say("cdef ", 300), "z": say([chr(0x4E00 + i) for i in range(200)], 400)}
    samples = {lang: " ".join(text.split()) for lang, text in samples.items()}
    parser = language.CrossParser(samples)
    assert all(isinstance(p, language.DenseParser if cells else language.SparseParser) for p in parser.parsers)
    pieces = [samples["a"][9:40], samples["b"][3:50], samples["z"][7:20], "q", "é x", " "]
    texts = [" ".join("".join(rng.choices(pieces, k=k)).split()) for k in range(1, 12) for _ in range(3)]
    want = np.array([[_phrases(t, samples[lang]) for lang in sorted(samples)] for t in texts])
    assert (parser.phrases(*parser.symbols(texts)) == want).all()
    cost = want * np.array([np.log2(len(samples[lang]) + 1) for lang in sorted(samples)])
    langs, score, _ = parser.predict(texts)
    for text, row, lang, s in zip(texts, cost, langs, score):
        if any(c.isalpha() for c in text):
            assert lang == sorted(samples)[int(row.argmin())]
            assert s == pytest.approx(1 / sum(2 ** (-(c - row.min()) / 8) for c in row))
        else:
            assert lang == "und" and s == 0


def test_twenty_languages_of_three_thousand_signs():
    rng = random.Random(6)
    samples = {f"l{k:02d}": "".join(chr(0x4E00 + 500 * k + rng.randrange(3_000)) for _ in range(8_000)) for k in range(20)}
    parser = language.CrossParser(samples)
    held = sum(a.nbytes for p in parser.parsers for a in vars(p).values() if isinstance(a, np.ndarray))
    assert held + sum(c.nbytes for c in parser.columns) < 300 << 20
    assert parser.predict([samples["l03"][100:150], samples["l11"][7:90]])[0] == ["l03", "l11"]


def test_too_many_labels_are_an_error_that_names_them(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    monkeypatch.setattr(language, "TRAIN_DOCS", 1)
    rows = [(i, "word", f"l{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sum(not r[0] for r in docs.select(language.held_out(docs.doc_id)).collect())
    with pytest.raises(ValueError, match=f"{kept} labels"):
        language.training_sample(docs)


def test_columns_of_the_added_names_null_ids_and_repeats(spark):
    rows = [(None, "der die das", "de", "x", 1.5), (1, "the and of", "en", "y", 2.5), (1, "the and of", "en", "y", 2.5), (7, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = language.identify(docs, {"de": "der die das", "en": "the and of"}).collect()
    assert sorted(map(str, ((r.doc_id, r.held_out, r.lang_pred) for r in got))) == sorted(
        map(str, [(None, False, "de"), (1, False, "en"), (1, False, "en"), (7, got[-1].held_out, "und")])
    )
