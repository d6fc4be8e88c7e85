import random
import re

import pytest

from tipstaff.llm import near_duplicates as nd


def rows(seed, n=220):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            base = rng.choice(out)[2].split()
            for _ in range(rng.randrange(8)):
                k = rng.randrange(len(base))
                base[k : k + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
            out.append((i, rng.choice(["A Act", "B Act", None]), " ".join(base)))
        else:
            out.append((i, "A Act", " ".join(rng.choices(vocab, k=rng.choice([30, 46, 60, 90, 250, 700])))))
    return out + [(n, None, None), (n + 1, "x", ""), (n + 2, *out[0][1:]), (n + 3, *out[0][1:]), (n + 4, "long", " ".join(f"v{i % 9000}" for i in range(30_000)))]


def brute(data, threshold=0.6):
    sets = {}
    for i, a, t in data:
        if len(re.findall("[a-z0-9]+", (t or "").lower())) >= 45:
            w = re.findall("[a-z0-9]+", f"{a or ''} {t}".lower())
            sets[i] = set(zip(w, w[1:], w[2:]))
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def table(spark, data):
    return spark.createDataFrame(data, "position bigint, act string, text string").selectExpr("*", "1 as class_hash", "2 as a", "3 as b")


@pytest.mark.parametrize("split, rare, tile", [(512, 32, 1_000), (2, 32, 3), (512, 1, 1_000), (2, 1, 1_000), (512, 10_000, 1_000)])
def test_pairs_against_brute_force(spark, monkeypatch, split, rare, tile):
    """With SPLIT 2 nearly every shared signature goes tile by tile; with RARE 1 only pairs of features sign, with 10,000 only single ones."""
    monkeypatch.setattr(nd, "SPLIT", split)
    monkeypatch.setattr(nd, "RARE", rare)
    monkeypatch.setattr(nd, "TILE", tile)
    data = rows(5)
    got = [(r.position_a, r.position_b) for r in nd.near_duplicate_pairs(table(spark, data), "position", "act", "text").collect()]
    want = brute(data)
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_short_sets_and_other_thresholds(spark, monkeypatch, threshold):
    """Sets of four to forty features from a small vocabulary, so that most features are frequent."""
    monkeypatch.setattr(nd, "RARE", 2)
    rng = random.Random(3)
    data = []
    for i in range(160):
        words = [f"q{rng.randrange(12)}" for _ in range(rng.randrange(4, 40))] if i % 3 == 0 or not data else data[-1][2].split()
        words = list(words)
        words[rng.randrange(len(words))] = f"q{rng.randrange(12)}"
        data.append((i, None, " ".join(words)))
    sets = {i: set(zip(w, w[1:], w[2:])) for i, _, t in data for w in [t.split()]}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    got = {(r.position_a, r.position_b) for r in nd.near_duplicate_pairs(table(spark, data), "position", "act", "text", threshold, 3, 3).collect()}
    assert len(want) > 10 and got == want


def test_no_pair_at_the_threshold_is_lost(spark):
    """Short texts, two fifths of them a phrase that all share, just above 0.6: little of what they share is rare."""
    rng = random.Random(9)
    phrase, data = " ".join(f"p{i}" for i in range(20)), []
    for i in range(150):
        own = [f"w{rng.randrange(5_000)}" for _ in range(26)]
        at = rng.randrange(3, 12)
        for text in (own, own[:at] + [f"c{i}x{k}" for k in range(9)] + own[at + 9 :]):
            data.append((len(data), None, f"{phrase} {' '.join(text)}"))
    want = brute(data)
    got = {(r.position_a, r.position_b) for r in nd.near_duplicate_pairs(table(spark, data), "position", "act", "text").collect()}
    assert len(want) == 150 and got == want


def test_last_class_of_a_wide_signature_is_kept(spark, monkeypatch):
    monkeypatch.setattr(nd, "SPLIT", 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        sigs = spark.createDataFrame([(5 << 8, 1, 60, 0, 0), (5 << 8, 2, 60, 0, 0)] + [(7 << 8, c, 60, 0, 0) for c in range(10, 19)], "signature bigint, c bigint, s0 bigint, s1 bigint, s2 bigint")
        got = {(r.a, r.b) for r in nd.candidates(sigs, 0.6, 11).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {(1, 2)} | {(a, b) for a in range(10, 19) for b in range(a + 1, 19)}


def test_groups_lose_no_link(spark):
    data = rows(6, 120)
    got = {r.position: r for r in nd.near_duplicate_groups(table(spark, data), "position", "act", "text").collect()}
    assert got[0].class_id == got[122].class_id == got[123].class_id == 0 and got[0].copies >= 2
    assert sum(r.links > 0 for r in got.values()) == len({x for a, b in brute(data) for x in (a, b) if got[a].class_id != got[b].class_id})


def test_empty_and_short(spark):
    data = rows(7, 30)
    assert nd.near_duplicate_pairs(table(spark, data).limit(0), "position", "act", "text").count() == 0
    assert nd.near_duplicate_pairs(table(spark, [(1, None, None), (2, "a", "few words")]), "position", "act", "text").count() == 0


def test_sketches_refuse_no_true_pair():
    import numpy as np
    import pyarrow as pa

    data = [r for r in rows(8, 150) if r[2]]
    batch = pa.record_batch([pa.array([r[0] for r in data]), pa.array([r[1] for r in data]), pa.array([r[2] for r in data])], names=["k", "a", "t"])
    sets = nd.Sets(batch, 45, 3)
    words = nd._sketch(sets)
    place = {data[r][0]: i for i, r in enumerate(sets.rows)}
    pairs = np.array([(place[x], place[y]) for x, y in brute(data)])
    zero = np.zeros(len(pairs), np.int64)
    kept = nd._plausible([w[pairs[:, 0]] for w in words], [w[pairs[:, 1]] for w in words], zero, zero, 0.6)
    assert len(kept) == len(pairs) > 50
