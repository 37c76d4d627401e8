"""Merge-path alignment of two tokenizations against a walk over both."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerline.llm import alignment, boundaries, piece_ids, shared

A = Tokenizer.from_file(shared.tokenizer_file(shared.BYTE_BPE))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=shared.tokenizer_file(alignment.PIECE_BPE))
BYTE = shared.byte_of_symbol()


def spelled(text):
    """Ids and bytes of both sides, from the libraries."""
    ours = A.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(BYTE[s] for s in A.id_to_token(i))) for i in ours.ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    ok = text and b"".join(t for _, t in a) == want and b"".join(t for _, t in b) == want
    return (a, b) if ok else ([], [])


def walked(a, b):
    """Links and groups, token by token."""
    owner_a = [k for k, (_, t) in enumerate(a) for _ in t]
    owner_b = [k for k, (_, t) in enumerate(b) for _ in t]
    links = sorted(set(zip(owner_a, owner_b)))
    groups, from_a, from_b = [], 0, 0
    for at in range(len(owner_a)):
        last = at + 1 == len(owner_a)
        if last or (owner_a[at] != owner_a[at + 1] and owner_b[at] != owner_b[at + 1]):
            groups.append((a[from_a : owner_a[at] + 1], b[from_b : owner_b[at] + 1]))
            from_a, from_b = owner_a[at] + 1, owner_b[at] + 1
    text = ";".join("|".join(",".join(str(i) for i, _ in side) for side in g) for g in groups)
    return links, groups, text


def texts():
    rng = random.Random(11)
    alphabet = " \n\tabABé中\U0001f642▁<0x41>|,;1"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(60)]
    return [None, "", " ", "a", "<|endoftext|> x<s>", "the cat " * 3_000, "z" * 20_000, "same text", "same text", "\x00", *odd]


@pytest.mark.parametrize("steps", [1, 7, 64])
def test_overlaps_of_random_ends(steps):
    rng = np.random.default_rng(steps)
    for n in (1, 5, 300):
        a = np.unique(rng.integers(1, 900, n))
        b = np.unique(rng.integers(1, 900, max(1, n // 3)))
        a, b = (np.append(side[side < 900], 900) for side in (a, b))
        begin_a, begin_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if begin_a[i] < b[j] and begin_b[j] < a[i]]
        assert list(zip(*map(np.ndarray.tolist, alignment.overlaps(a, b, steps)))) == want


def test_crossings_are_those_of_the_merge():
    a, b = np.array([2, 4, 4, 9]), np.array([1, 4, 9])
    path = sorted([(e, 0) for e in a] + [(e, 1) for e in b])
    want = [sum(side == 0 for _, side in path[:d]) for d in range(8)]
    assert alignment.crossings(a, b, np.arange(8)).tolist() == want


@pytest.mark.parametrize("limit", [alignment.COMMON, 60, 0])
def test_documents_equal_a_walk(spark, limit):
    docs = list(enumerate(texts())) + [(None, "null id"), (3, "a")]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, pair string, row int, b int")
    sides = [spelled(t or "") for _, t in docs]
    walks = [walked(*s) for s in sides]
    counts = Counter((a[i][0], b[j][0]) for (a, b), (links, *_) in zip(sides, walks) for i, j in links)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    want = []
    for (doc, _), (a, b), (links, groups, text) in zip(docs, sides, walks):
        of = [counts[a[i][0], b[j][0]] for i, j in links]
        best = sum(counts[a[i][0], b[j][0]] == most[b[j][0]] for i, j in links)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        want.append((doc, len(a), len(b), len(groups), len(links), best, sum(of), digest))
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted((tuple(r) for r in alignment.scored(df, limit=limit).collect()), key=key) == sorted(want, key=key)
    assert sum(n == 0 for _, n, *_ in want) >= 3  # null, empty, and what a side does not spell


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.scored(df).count() == 0


def test_piece_ids_equal_the_library():
    rng = random.Random(3)
    kinds = boundaries.code_classes()
    path = shared.tokenizer_file(shared.BYTE_BPE)
    plain = piece_ids.PieceIds(path, kinds, plain=True)
    marked = piece_ids.PieceIds(path, kinds)
    library = Tokenizer.from_file(path)
    for alphabet in ("ab", " a", "ea t", "aB1 ", "'s t", "éa中 ", "!?= \n"):
        some = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) + "<|endoftext|>" * (k % 2) for k in range(60)]
        assert [x.tolist() for x in plain.ids(some)] == [A.encode(t, add_special_tokens=False).ids for t in some]
        assert [x.tolist() for x in marked.ids(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert plain.ids([]) == [] and plain.ids([""])[0].tolist() == []


def test_pieces_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(piece_ids, "piece_names", lambda codes, begins, ends: np.zeros(len(begins), np.uint64))
    own = piece_ids.PieceIds(shared.tokenizer_file(shared.BYTE_BPE), boundaries.code_classes(), plain=True)
    assert [x.tolist() for x in own.ids(["one two one", "two!"])] == [
        A.encode(t, add_special_tokens=False).ids for t in ("one two one", "two!")
    ]
