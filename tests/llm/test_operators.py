"""Each operator against a brute-force version on small inputs with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from ledgerline.llm import (
    boundaries,
    byte_bpe,
    components,
    embeddings,
    language,
    packing,
    preference,
    quality,
    secrets,
    shared,
    simhash,
    token_counts,
    url_filter,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, _len int, failed string"
TOKENIZER = Tokenizer.from_file(shared.tokenizer_file(shared.BYTE_BPE))
EN = "the cat and the dog saw that other thing in the house while they were there with their mother "
DE = "der hund und die katze sehen das haus nicht weil sie schon über die brücke gegangen sind "
HEX = "0123456789abcdef0123456789abcdef"


def docs_of(spark, texts, langs=None):
    rows = [
        (i, t, (langs or {}).get(i, "en"), "s", None, 7, 8, "x") for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alphabet = " \n\t'strvelmdxABé1٣!?#　漢🙂\r"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(40)]
    return [None, "", " ", "a", "x <|endoftext|> y<|endoftext|>", "word" * 5_000, EN * 300, EN, EN, DE, *odd]


def test_token_counts_equal_library(spark, texts):
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"]) == (want, len((text or "").encode())), repr(text)[:50]
        assert got[i]["over_limit"] == (want > 1024)


def test_chunk_borders_and_forgetting_change_no_count(texts, monkeypatch):
    path, kinds = shared.tokenizer_file(shared.BYTE_BPE), boundaries.code_classes()
    want = token_counts.TokenCounter(path, kinds).counts([t or "" for t in texts]).tolist()
    monkeypatch.setattr(boundaries, "CHUNK", 3)
    monkeypatch.setattr(token_counts, "MAX_STATES", 20)
    monkeypatch.setattr(token_counts, "MAX_KNOWN", 5)
    assert token_counts.TokenCounter(path, kinds).counts([t or "" for t in texts]).tolist() == want


def test_packing_places_every_token_once(spark, texts):
    got = packing.pack_documents(docs_of(spark, texts), 64).toPandas()
    for i, text in enumerate(texts):
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and mine.length.max() <= 64
        assert (mine.length[1:] == 64).all() and mine.piece.tolist() == list(range(len(mine)))
        for row in mine.itertuples():
            part = np.array(ids[row.start : row.start + row.length], "<u4").tobytes()
            assert row.ids_crc32 == zlib.crc32(part)
    placed = got.sort_values(["sequence_id", "offset"])
    sums = placed.groupby("sequence_id").length
    assert (sums.cumsum() - placed.length == placed.offset).all() and sums.sum().max() <= 64


def test_plan_is_close_to_the_least_number_of_bins():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([10, 37, 100])
        histogram = {rng.randrange(1, capacity + 1): rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))}
        rows = packing.plan(histogram, capacity)
        cover = {size: 0 for size in histogram}
        fill, at = {}, {}
        for size, lo, hi, qty, first, offset in rows:
            cover[size] += hi - lo
            for rank in range(lo, hi):
                b = first + (rank - lo) // qty
                fill[b] = fill.get(b, 0) + size
                at.setdefault(b, []).append((offset + (rank - lo) % qty * size, size))
        assert cover == histogram and max(fill.values()) <= capacity
        for places in at.values():
            end = 0
            for offset, size in sorted(places):
                assert offset == end
                end += size
        least = -(-sum(s * n for s, n in histogram.items()) // capacity)
        halves = sum(n for s, n in histogram.items() if 2 * s > capacity)
        assert len(fill) <= 1.3 * max(least, halves) + 1


def test_dominance_fixes_exact_pairs():
    planner = packing.Planner({60: 5, 40: 5, 7: 3}, 100)
    planner.reduce()
    assert sum(b.n for b in planner.closed if b.room == 0) == 5


def test_language(spark):
    rng = random.Random(1)
    def say(text):
        words = text.split()
        return " ".join(rng.choice(words) for _ in range(60))
    many = [say(EN) if i % 2 else say(DE) for i in range(80)]
    langs = {i: "en" if i % 2 else "de" for i in range(80)} | dict.fromkeys(range(80, 85))
    texts = [*many, None, "", "12 %% 34", "漢字", "der die das und nicht " * 4_000]
    got = language.identify(docs_of(spark, texts, langs)).toPandas().set_index("doc_id")
    assert all(got.lang_pred[i] == langs[i] for i in range(80))
    assert got.lang_pred[80:83].tolist() == ["und"] * 3 and got.lang_pred[83] in ("de", "en") and got.lang_pred[84] == "de"
    assert got.score.between(0, 1).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got.index)


def test_cross_parse_counts_longest_matches():
    parser = language.CrossParser({"a": "abcab", "b": "xyz"})
    def phrases(text, known):
        n, at = 0, 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at : end + 1] in known:
                end += 1
            n, at = n + 1, end
        return n
    for text in ["abcab", "cabx", "xyzab", "zzz", "ab cab", "q"]:
        symbols, sizes = parser.symbols([text])
        assert parser.phrases(symbols, sizes).tolist() == [[phrases(text, "abcab"), phrases(text, "xyz")]], text


def test_fingerprints_and_groups(spark, texts):
    rng = random.Random(2)
    base = [" ".join(rng.choice(EN.split()) + str(rng.randrange(50)) for _ in range(200)) for _ in range(12)]
    near = [t.rsplit(" ", 1)[0] for t in base]
    all_texts = [*texts, *base, *near, *base[:3], "One two", "ONE TWO"]
    got = simhash.near_duplicates(docs_of(spark, all_texts)).toPandas().set_index("doc_id").sort_index()

    def sign(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    signs = [sign(t) for t in all_texts]
    assert got.fingerprint.tolist() == [f"{s:016x}" for s in signs]
    component = list(range(len(signs)))
    for _ in signs:
        for i, a in enumerate(signs):
            for j, b in enumerate(signs):
                if (a ^ b).bit_count() <= 3:
                    component[i] = min(component[i], component[j])
    assert got.component_id.tolist() == component


def test_probes_find_every_link(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    values = {s for s in seeds}
    for s in seeds[:10]:
        for _ in range(60):
            for bit in rng.sample(range(64), rng.randrange(1, 4)):
                s ^= 1 << bit
            values.add(s)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    for masks_for in (len(signed), 10**9):  # few parts, and many masked ones
        n, both = simhash.bit_counts(fps)
        masks = simhash.probe_masks(masks_for, both * masks_for / n, 3)
        pairs = [(a, b) for a in list(values)[:150] for b in values if (a ^ b).bit_count() <= 3]
        assert all(any((a ^ b) & m == 0 for m in masks) for a, b in pairs), masks_for


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (1, 2), (2, 1)], "a long, b long")
    got = dict(map(tuple, components.components(links).collect()))
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(200, 260)} | {7: 7, 1: 1, 2: 1}
    assert got == want


def test_quality_equals_plain_version(spark, texts):
    lines = "a line that comes again\n" * 9 + EN
    got = quality.judge(docs_of(spark, [*texts, lines, EN * 2])).toPandas().set_index("doc_id")
    for i, text in enumerate([*texts, lines, EN * 2]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        counts = {}
        for w in windows:
            counts[w] = counts.get(w, 0) + 1
        covered = {k + d for k, w in enumerate(windows) if counts[w] > 1 for d in range(3)}
        filled = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        row = got.loc[i]
        assert row.n_words == len(words) and row.word_chars == sum(map(len, words))
        assert row.n_repeat_words == len(covered) and row.n_dup_lines == len(filled) - len(set(filled))
        assert row.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert row.base_failed == failed and not (failed and row.kept)


def test_quality_policies_and_ablation(spark):
    rows = quality.ledger(docs_of(spark, [EN * 9, "%%% ### " * 30, "short", None]))
    kept = quality.apply_policy(rows, "base").toPandas().set_index("doc_id").kept
    assert not kept[2] and not kept[3]
    found = {r["rule"]: r for r in quality.ablation(rows, "base").collect()}
    assert found["few_words"]["n_failed"] == 2 and found["few_words"]["n_only"] == 2
    assert found["many_symbols"]["n_failed"] == 1 and not found["many_symbols"]["enforced"]


def test_byte_bpe_round_trip(spark, texts):
    ranks = byte_bpe.read_ranks(shared.tokenizer_file(byte_bpe.RANKS))
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data = docs_of(spark, texts)
    got = byte_bpe.round_trip(data).toPandas().set_index("doc_id")
    for i, text in enumerate(texts):
        ids = plain.encode_ordinary(text or "")
        assert got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode(byte_bpe.encode(data)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_safe_parts_do_not_change_ids(texts):
    own = byte_bpe.codec(shared.tokenizer_file(byte_bpe.RANKS))
    for text in texts:
        parts = list(byte_bpe.safe_parts(text or "", 7))
        assert "".join(parts) == (text or "")
        assert sum((own.encoding.encode_ordinary(p) for p in parts), []) == own.encoding.encode_ordinary(text or "")


def test_secret_findings(spark):
    texts = [
        None, "", f'a token = "{HEX}" b', "password: short", "API_KEY=abcdef", f"x AKIA{'A1' * 8}B y", "ab" * 11,
        f"Secret='{HEX[:8]}' {HEX} {HEX}", "AKIAAKIA",
    ]
    got = secrets.counted(secrets.findings(docs_of(spark, texts), None)).toPandas().set_index("doc_id")
    assert got.n_assign.tolist() == [0, 0, 1, 0, 1, 0, 0, 1, 0]
    assert got.n_access.tolist() == [0, 0, 0, 0, 0, 1, 0, 0, 0]
    assert got.n_hex.tolist() == [0, 0, 1, 0, 0, 0, 0, 2, 0]
    assert got.spans[2] == f"assign:2:{11 + 32},hex:11:43"
    assert got.base_sha256[0] == hashlib.sha256(b"").hexdigest()
    assert got.base_sha256[2] == hashlib.sha256(got.spans[2].encode()).hexdigest()


def test_network_learns_and_only_adds(spark):
    rng = random.Random(9)
    def key():
        return "".join(rng.choice("0123456789abcdef") for _ in range(32))
    texts = [f'{EN} token = "{key()}" {EN[:20]} {rng.randrange(10**15, 10**16)}' for _ in range(120)]
    texts += [f"{EN} x-{key()[:20]}" + "Z" * 2 for _ in range(5)] + [EN, None, ""]
    data = docs_of(spark, texts)
    windows, labels = secrets.training_findings(data)
    net = secrets.train(windows, labels)
    scores = net.scores(secrets.encode(windows))
    truth = np.array(labels) == 1
    assert (scores[truth] >= net.threshold).mean() >= 0.95 and (scores[~truth] >= net.threshold).mean() <= 0.1
    plain = secrets.findings(data, None).toPandas().set_index("doc_id").findings
    more = secrets.findings(data, net).toPandas().set_index("doc_id").findings
    for i in plain.index:
        assert {tuple(f) for f in plain[i]} <= {tuple(f) for f in more[i]}
    clean = secrets.redact(data, net).toPandas().set_index("doc_id")
    assert clean.text[121 + 4 + 1] is None and not clean.text[:120].str.contains("[0-9a-f]{24}").any()
    assert secrets.train(["x" * secrets.LENGTH], [1]) is None


URLS = [
    None, "", "no scheme", "http://Example.COM/en/7817?x", "https://a.b.example.com/en/8", "https://xexample.com/en/7",
    "http://example.com/en", "http://example.net/de/8#a", "http://net/de/", "ftp://m.example.org/es/?u=http://x", "://", "http:///en/",
    "http://com/en/1", "a://b://c/en/",
]


def test_url_rules(spark):
    rows = [(i, u, "h", "p") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, keys string")
    got = url_filter.judge(pages).toPandas().set_index("page_id").sort_index()
    rules = dict(url_filter.RULES)
    for i, url in enumerate(URLS * 2):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = []
        for rule in rules:
            own, _, tail = rule.partition("/")
            if (host == own or host.endswith("." + own)) and path.startswith("/" + tail):
                fits.append(rule)
        best = max(fits, key=len, default=None)
        assert (got.host[i], got.path[i]) == (host, path), url
        assert got.rule[i] == best and got.verdict[i] == rules.get(best, "allow"), url
    table = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    lengths = sorted({len(r) - len(r.split("/")[0]) for r in rules})
    joined = url_filter.judge_joined(pages, table, lengths, [1, 2, 3]).toPandas().set_index("page_id").sort_index()
    assert joined[["host", "path", "rule", "verdict"]].equals(got[["host", "path", "rule", "verdict"]])


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda text: 1)
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda data, seed: 1)
    path = tmp_path / "rules.bin"
    path.write_bytes(url_filter.DigestArray.pack([("a/", "block"), ("bb/", "allow"), ("c/", "block")]))
    stored = url_filter.DigestArray(str(path))
    place = stored.find(["c/", "x/", "bb/"])
    assert place[1] == -1 and [int(stored.blocks[p]) for p in place[[0, 2]]] == [1, 0]


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    seeds = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(seeds)]
    for k in range(120):
        near = seeds[k % 20] + rng.normal(size=16) * 0.05
        rows.append((1_000 + k, [float(x) for x in near], (k % 20) % 3))
    rows += [(2_000 + k, rows[4][1], rows[4][2]) for k in range(30)]
    rows += [(2_100, [x * 1e3 for x in rows[4][1]], rows[4][2]), (2_100, [x * 1e3 for x in rows[4][1]], rows[4][2])]
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0], [1.0, 2.0001]]
    rows += [(3_000 + k, v, 1) for k, v in enumerate(odd)] + [(4_000, rows[4][1], None), (None, rows[4][1], rows[4][2])]
    schema = "vec_id long, embedding array<float>, label int"
    frame = spark.createDataFrame(rows, schema)
    stored = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    got = embeddings.near_duplicates(frame).toPandas()
    ok = [
        i for i, (d, v, lab) in enumerate(stored)
        if d is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links, comp = {i: 0 for i in range(len(stored))}, {i: stored[i][0] for i in range(len(stored))}
    pairs = []
    for i in ok:
        for j in ok:
            a, b = stored[i], stored[j]
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[i] += 1
                    pairs.append((i, j))
    for _ in range(20):
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    key = lambda t: str(t)
    want = sorted(((stored[i][0], links[i], comp[i]) for i in links), key=key)
    have = [(None if v != v else int(v), int(n), None if c != c else int(c)) for v, n, c in got[["vec_id", "n_links", "component_id"]].itertuples(index=False)]
    assert sorted(have, key=key) == want
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_long_lists_are_cut_without_losing_pairs(spark, monkeypatch):
    from ledgerline.llm import blocks

    rng = np.random.default_rng(8)
    seed = rng.normal(size=8)
    rows = [(i, [float(x) for x in seed + rng.normal(size=8) * 0.01], 1) for i in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(blocks.in_blocks, "__defaults__", (16, False))
    got = embeddings.near_duplicates(frame).toPandas()
    assert (got.n_links == 89).all() and (got.component_id == 0).all()


def test_preference_pairs(spark):
    schema = "pair_id long, turn long, role string, text string, prompt string"
    chosen = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "good", ""), (1, 1, "assistant", "good", ""), (2, 0, "user", None, ""),
              (3, 0, "user", "same", ""), (None, 0, "user", "x", ""), (4, None, "user", "x", "")]
    rejected = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "bad", ""), (1, 2, "user", "why", ""), (3, 0, "user", "same", ""), (5, 0, "assistant", "a", "")]
    got = {r["pair_id"]: r for r in preference.preference_pairs(
        spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()}
    assert set(got) == {1, 2, 3, 5}
    one = got[1]
    assert one["n_shared"] == 1 and one["prompt"] == "<|user|>\nhi<|end|>\n"
    assert one["chosen"] == "<|assistant|>\ngood<|end|>\n"
    span = one["chosen_mask"][0]
    assert one["chosen"][span["start"] : span["end"]] == "good<|end|>" and len(one["rejected_mask"]) == 1
    assert got[3]["n_shared"] == 1 and got[3]["chosen"] == got[3]["rejected"] == ""
    assert got[5]["n_shared"] == 0 and got[5]["chosen"] == "" and got[5]["prompt"] == ""


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    assert token_counts.token_counts(docs).count() == 0
    assert packing.pack_documents(docs).count() == 0
    assert language.identify(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert quality.judge(docs).count() == 0
    assert byte_bpe.round_trip(docs).count() == 0
    assert secrets.trained(docs) is None and secrets.findings(docs, None).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(vectors).count() == 0
    turns = spark.createDataFrame([], "pair_id long, turn long, role string, text string")
    assert preference.preference_pairs(turns, turns).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, EN), (None, None), (3, EN)], "doc_id long, text string")
    assert token_counts.token_counts(docs).where("doc_id is null").count() == 2
    assert packing.pack_documents(docs).where("doc_id is null").count() == 2
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(None, 3), (3, 3), (None, None)}
    assert quality.judge(docs).where("doc_id is null").count() == 2
