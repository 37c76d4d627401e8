"""The network sees every part of every candidate, and can find keys that no pattern marks."""

from __future__ import annotations

import random

import numpy as np

from ledgerline.llm import secrets

KEY = "q7Zk2Xv9Lw4Rt8Yb3Nc6Md1P"


class Finds:
    """Scores 1 where a window holds the key."""

    threshold = 0.5

    def __init__(self, key):
        self.key = secrets.encode([secrets.window(key, 0, len(key))])[0, secrets.BEFORE : secrets.BEFORE + len(key)]

    def scores(self, kinds):
        inside = kinds[:, secrets.BEFORE : secrets.BEFORE + secrets.INSIDE]
        at = range(secrets.INSIDE - len(self.key) + 1)
        return np.array([float(any((row[i : i + len(self.key)] == self.key).all() for i in at)) for row in inside])


def covers(text, found, key):
    at = text.index(key)
    return any(kind == 3 and start <= at and end >= at + len(key) for start, kind, end, _ in found)


def test_every_part_of_a_run_is_seen():
    url = f"https://hooks.example.com/services/T00000000/B00000000/{KEY}"
    run = "A" * 301 + KEY + "B" * 77
    texts = [f"see {url} now", run, f"x {'0123456789abcdef' * 2}{KEY} y"]
    scanner = secrets.Scanner(Finds(KEY))
    for text, found in zip(texts, scanner.scan(texts)):
        assert covers(text, found, KEY)
        assert KEY not in secrets.redacted(text, found)
    short = f"use {KEY[:7]} here"
    assert covers(short, secrets.Scanner(Finds(KEY[:7])).scan([short])[0], KEY[:7])


def test_lookup_by_pairs_gives_the_same_logits():
    rng = random.Random(2)
    net = secrets._fit(np.array([[rng.randrange(2 * secrets.N_CLASSES) for _ in range(secrets.LENGTH)] for _ in range(64)]),
                       np.arange(64) % 2 * 1.0)
    kinds = np.array([[rng.randrange(2 * secrets.N_CLASSES) for _ in range(secrets.LENGTH)] for _ in range(9)])
    assert np.allclose(net.logits(kinds), net.fast_logits(kinds), atol=1e-3)


def test_unmarked_keys_are_found(spark):
    """Keys with a vendor prefix and upper-case hex that no pattern knows, each kind many times in the sample."""
    rng = random.Random(5)
    syllables = ["an", "ver", "ti", "on", "ment", "re", "qua", "li", "ty", "ing", "com", "pu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 6)))
    prose = lambda: " ".join(word() for _ in range(40))
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows, keys = [], {}
    for i in range(300):
        if i % 3 == 0:
            marked = f'token = "{draw("0123456789abcdef", 40)}"'
        elif i % 3 == 1:
            keys[i] = rng.choice(["vk1" + draw("0123456789abcdef", 18), draw("0123456789ABCDEF", 28)])
            marked = keys[i]
        else:
            marked = f"mail{rng.randrange(9)}.example.com"
        rows.append((i, f"{prose()} {marked} {prose()}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = secrets.trained(docs)
    found = dict(zip(range(len(rows)), secrets.Scanner(net).scan([t for _, t in rows])))
    assert sum(covers(rows[i][1], found[i], key) for i, key in keys.items()) >= 0.9 * len(keys)
    wrong = sum(kind == 3 for i, f in found.items() if i not in keys for _, kind, _, _ in f)
    assert wrong <= 20  # of over 10,000 words
