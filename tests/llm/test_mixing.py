import numpy as np
import pytest
from pyspark.sql import functions as F

from tipstaff.llm import mixing

TARGETS = [("m", "a", 0.5, 2), ("m", "b", 0.3, 4), ("m", "gone", 0.2, 3), ("one", "a", 1.0, 1), ("m", None, 0.1, 1), ("m", "c", 0.0, 1)]


def docs(spark):
    rows = [(i, "word " * (3 + i % 40), "a" if i % 3 else "b") for i in range(600)] + [(600, None, "a"), (601, "", "b"), (602, "text", None), (603, "text", "other")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "9 as shard", "'m' as mix_name", "5 as tokens")


def test_shares_and_repeats(spark):
    drawn, targets = mixing.mix(docs(spark), "doc_id", "text", "source", TARGETS)
    drawn = drawn.cache()
    report = {(r.mix_name, r.source): r for r in mixing.mix_report(drawn, "doc_id", targets).collect()}
    assert abs(report["m", "a"].actual_share - 0.625) < 0.01 and abs(report["m", "b"].actual_share - 0.375) < 0.01
    assert report["m", "gone"].actual_share == 0 and report["one", "a"].actual_share == 1
    assert all(r.most_repeats <= r.max_repeats for r in report.values())
    assert drawn.groupBy("mix_name", "doc_id", "copy_no").count().where("count > 1").count() == 0
    places = drawn.groupBy("mix_name", "shard").agg(F.count("*").alias("n"), F.max("place").alias("p"), F.count_distinct("place").alias("d")).collect()
    assert all(r.n == r.p + 1 == r.d for r in places)
    again, _ = mixing.mix(docs(spark), "doc_id", "text", "source", TARGETS)
    key = lambda d: sorted((r.mix_name, r.doc_id, r.copy_no, r.shard, r.place) for r in d.collect())
    assert key(drawn) == key(again)


def test_many_shards_share_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 1_500)
    drawn, _ = mixing.mix(docs(spark), "doc_id", "text", "source", TARGETS)
    sizes = [r.t for r in drawn.where("mix_name = 'm'").groupBy("shard").agg(F.sum("tokens").alias("t")).collect()]
    assert len(sizes) > 4 and max(sizes) < 2.5 * np.mean(sizes)


@pytest.mark.parametrize("few, bits, cap", [(4_096, 9, 4_000_000), (3, 2, 700), (1, 9, 700)])
def test_cut_is_at_the_nearest_document(spark, monkeypatch, few, bits, cap):
    """However many steps the search of the cut takes, quotas are met to half a document; enough shards that the tree is deep."""
    for name, value in (("FEW", few), ("DIGIT_BITS", bits), ("SHARD_TOKENS", cap)):
        monkeypatch.setattr(mixing, name, value)
    targets = [("m", "a", 0.37, 3), ("m", "b", 0.63, 7)]
    drawn, _ = mixing.mix(docs(spark), "doc_id", "text", "source", targets)
    have = {r.source: r.n for r in mixing.mix(docs(spark), "doc_id", "text", "source", [("x", "a", 0.5, 1), ("x", "b", 0.5, 1)])[0].groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    have |= {r.source: r.n for s in "ab" for r in mixing.mix(docs(spark), "doc_id", "text", "source", [("x", s, 1.0, 1)])[0].groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    got = {r.source: r.n for r in drawn.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    total = min(have["a"] * 3 / 0.37, have["b"] * 7 / 0.63)
    assert abs(got["a"] - 0.37 * total) <= 22 and abs(got["b"] - 0.63 * total) <= 22
    whole = drawn.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("copy_no").alias("m")).groupBy("source").agg(F.max("n").alias("most"), F.min("n").alias("least")).collect()
    assert all(r.most - r.least <= 1 for r in whole)


def test_tree_keeps_quotas_and_asks_nodes_alone():
    counts = [100, 7, 0, 513]
    source = np.repeat(np.arange(4), counts)
    place = np.concatenate([np.arange(n) for n in counts])
    shard = mixing.Tree("m", counts, 13, 2).shard_of(source, place)
    table = np.array([np.bincount(shard[source == s], minlength=13) for s in range(4)]).T
    assert (table.sum(0) == counts).all() and np.ptp(table.sum(1)) <= 4
    assert all((np.diff(shard[source == s]) >= 0).all() for s in range(4))  # disjoint runs
    alone = [mixing.Tree("m", counts, 13, 2).shard_of(source[i : i + 1], place[i : i + 1])[0] for i in range(0, 620, 31)]
    assert alone == list(shard[::31])


def test_draw_beyond_the_generator():
    counts = np.array([3_000_000_001, 7, 0, 2_000_000_000])
    left = mixing.draw(counts, 5, 11, np.random.default_rng(1))
    assert left.sum() == round(int(counts.sum()) * 5 / 11) and (left <= counts).all() and (left >= 0).all()


def test_fill():
    tokens, place = np.array([900, 40, 500, 30, 7]), np.array([1, 2, 3, 4, 5])
    assert list(mixing.fill(place, tokens, 80)) == [False, True, False, True, True]  # the long ones are passed over
    assert list(mixing.fill(place, tokens, 4)) == [False, False, False, False, True]  # nearer with the least than without
    assert not mixing.fill(place, tokens, 3).any()


def test_source_named_twice(spark):
    drawn, targets = mixing.mix(docs(spark), "doc_id", "text", "source", [("m", "a", 0.5, 4), ("m", "a", 0.5, 2)])
    assert targets == [("m", "a", 1.0, 2)] and drawn.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2


def test_empty(spark):
    drawn, targets = mixing.mix(docs(spark).limit(0), "doc_id", "text", "source", TARGETS)
    assert drawn.count() == 0 and mixing.mix_report(drawn, "doc_id", targets).agg(F.sum("tokens")).first()[0] == 0
    assert mixing.mix(docs(spark), "doc_id", "text", "source", [])[0].count() == 0
