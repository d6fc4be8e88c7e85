import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tipstaff.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_plan_packs_every_item_once(items, capacity):
    lengths, n = np.unique(np.array(items, dtype=np.int64), return_counts=True)
    lookup, windows = packing.plan(capacity, lengths, n)
    full, seen = [0] * windows, []
    for length, count in zip(lengths, n):
        mine = np.flatnonzero(lookup["length"] == length)
        for rank in range(count):
            at = mine[np.searchsorted(lookup["rank"][mine], rank, side="right") - 1]
            past = rank - lookup["rank"][at]
            w = int(lookup["window"][at] + past // lookup["per"][at])
            seen.append((w, int(lookup["slot"][at] + past % lookup["per"][at])))
            full[w] += int(length)
    assert len(seen) == len(set(seen)) == len(items) and all(0 < f <= capacity for f in full)
    assert sum(f * 2 <= capacity for f in full) <= 1


def test_exact_combinations():
    counts = np.zeros(11, dtype=np.int64)
    counts[[10, 7, 3, 5, 4, 2]] = [2, 3, 2, 2, 3, 1]
    got = packing.exact_combinations(10, counts)
    assert all(sum(x) == 10 for _, x in got) and (2, [10]) in got and (2, [7, 3]) in got
    assert (counts >= 0).all()


def test_windows(spark):
    rows = [(i, n) for i, n in enumerate([0, 5, 5, 5, 5, 3, 7, 10, 23, 30, 1, 1, None])] + [(5, 3)]
    tokens = spark.createDataFrame(rows, "doc_id bigint, tokens bigint")
    df = tokens.selectExpr("doc_id", "'x' as text", "'c' as spec_name", "1 as rank")
    out = packing.pack(df, "doc_id", "text", [("ten", 10), ("none", 0), (None, 5), ("ten", 10)], tokens=tokens)
    got = out.groupBy("window_no").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.count_distinct("slot").alias("s")).collect()
    assert all(r.t <= 10 and r.n == r.s for r in got) and sorted(r.window_no for r in got) == list(range(len(got)))
    by = {(r.doc_id, r.t) for r in out.groupBy("doc_id").agg(F.sum("tokens").alias("t")).collect()}
    assert by == {(1, 5), (2, 5), (3, 5), (4, 5), (5, 6), (6, 7), (7, 10), (8, 23), (9, 30), (10, 1), (11, 1)}
    assert sorted((r.piece, r.start_token, r.tokens) for r in out.where("doc_id = 8").collect()) == [(0, 0, 10), (1, 10, 10), (2, 20, 3)]
    assert packing.pack_report(out, [("ten", 10)]).first()["least_windows"] == 10


def test_real_tokens_and_empty(spark):
    df = spark.createDataFrame([(1, "some words here"), (2, None), (3, ""), (4, "<|endoftext|> " * 50)], "doc_id bigint, text string")
    out = packing.pack(df, "doc_id", "text", [("w", 16)])
    assert {r.doc_id for r in out.collect()} == {1, 4}
    assert packing.pack(df.limit(0), "doc_id", "text", [("w", 16)]).count() == 0
    assert packing.pack(df, "doc_id", "text", []).count() == 0


def test_hot_length_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 700)
    rows = spark.range(5_000).select(F.lit(7).alias("v"), F.xxhash64("id").alias("h"))
    ranks = sorted(r["rank"] for r in packing.ranked(rows, "v", "h", 5_000).collect())
    assert ranks == list(range(5_000))
