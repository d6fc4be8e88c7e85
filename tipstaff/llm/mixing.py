"""Problem 7: mixing sources to target shares of the total size, with a cap on repeats.

Method: multivariate-hypergeometric splitting tree. The largest total that keeps every source within its
repeats fixes each source's quota in tokens: whole passes over the source and one part of a pass. A hash puts
the documents of a source into permuted order; the part pass is a beginning of that order. Where
it ends is found digit by digit: token sums of at most 2 ** DIGIT_BITS ranges of the order a source reach the
driver, then those of the range that holds the end, until it holds at most FEW documents. Of these the ones that
still fit are taken in their order, so the source ends within half its least document of its quota. The order is also cut into blocks, at least two a shard and source. The blocks of all passes are
permuted and split between the output shards by a binary tree: at each node the left half draws its blocks from
the node's counts by a multivariate hypergeometric draw, so every shard gets a fair share of every source and
the quotas stay exact. A shard holds about SHARD_TOKENS tokens, however many shards that makes. Nobody holds
the table of blocks: a draw depends on the seed and the node alone, so every task walks its documents down the
tree, and documents are first brought together by their place among the shards, so that a task sees few nodes.
Shards take disjoint runs of each source's permuted blocks, and documents are ordered within a shard by a hash.

Defined results. Null and empty texts have no tokens and are not drawn. A target source without tokens
cannot have its share: it is reported with 0, and the other shares keep their proportions. Documents of
sources outside a mix, or with null source, are not in it. Targets with null or non-positive share are
left out; a null or non-positive repeat cap counts as 1; shares of a source named twice in a mix add up and
the lower cap holds. No document stands in a mix more than
max_repeats times; copies are numbered from 0. Equal rows are different documents. Empty tables give no
rows. Same input and seed, same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .tokens import VOCABULARY, token_counts

#: Blocks a pass over a source is cut into where there are documents enough; twice the shards where that is more.
BLOCKS = 512
#: Tokens of an output shard aimed at.
SHARD_TOKENS = 4_000_000
#: Ranges (as a power of two) looked at a step when a cut is searched, and documents among which it is then found at once.
DIGIT_BITS, FEW = 9, 4_096
#: Shards whose documents are brought together before they walk down the tree.
TOGETHER = 16
#: Blocks beyond which a node is split in proportion (the generator draws from fewer than this).
DRAWABLE = 10**9


def draw(counts: np.ndarray, left: int, shards: int, rng: np.random.Generator) -> np.ndarray:
    """How many blocks of each source go to the left of a node's shards."""
    total = int(counts.sum())
    wanted = round(total * left / shards)
    if total < DRAWABLE:
        return rng.multivariate_hypergeometric(counts, wanted, method="marginals") if total else counts * 0
    exact = counts * (left / shards)
    taken = np.floor(exact).astype(np.int64)
    taken[np.argsort(taken - exact, kind="stable")[: max(wanted - int(taken.sum()), 0)]] += 1
    return np.minimum(taken, counts)


class Tree:
    """The splitting tree of a mix: the same draws wherever and whenever a node is asked."""

    def __init__(self, name: str, counts: list[int], shards: int, seed: int):
        self.name, self.counts, self.shards, self.seed = name, np.array(counts, np.int64), shards, seed
        self.known: dict[tuple[int, int], np.ndarray] = {}

    def _left(self, first: int, shards: int, counts: np.ndarray) -> np.ndarray:
        if (first, shards) not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            rng = np.random.default_rng([self.seed, first, shards, *self.name.encode()])
            self.known[first, shards] = draw(counts, shards // 2, shards, rng)
        return self.known[first, shards]

    def shard_of(self, source: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The shard that takes the block at a place of its source's permuted blocks."""
        out = np.zeros(len(source), np.int64)
        todo = [(0, self.shards, self.counts, np.zeros(len(self.counts), np.int64), np.arange(len(source)))]
        while todo:
            first, shards, counts, before, rows = todo.pop()
            if shards == 1 or not len(rows):
                out[rows] = first
                continue
            left = self._left(first, shards, counts)
            goes = place[rows] < (before + left)[source[rows]]
            half = shards // 2
            todo.append((first, half, left, before, rows[goes]))
            todo.append((first + half, shards - half, counts - left, before + left, rows[~goes]))
        return out


def quotas(targets: list[tuple[str, str, float, int]], have: dict[str, int]) -> list[tuple[str, str, int, int]]:
    """(mix, source, copies of whole passes, tokens of the part pass) of the largest mixes that the repeats allow."""
    rows = []
    for name in sorted({m for m, *_ in targets}):
        own = [(s, p, r) for m, s, p, r in targets if m == name and have.get(s)]
        if own:
            share = sum(p for _, p, _ in own)
            total = min(have[s] * r * share / p for s, p, r in own)
            for s, p, r in own:
                quota = total * p / share
                passes = min(int(quota / have[s] + 1e-9), r)
                rows.append((name, s, passes, int(round(quota - passes * have[s])) if passes < r else 0))
    return rows


def cuts(docs: DataFrame, parts: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(target, first and last place of the range that holds its cut, tokens still wanted of it, -1 for all) for the part passes."""
    spark = docs.sparkSession
    found, shift = [], 63 - DIGIT_BITS
    open_ = {t: (0, (1 << 63) - 1, wanted) for t, wanted in parts.items() if wanted > 0}
    while open_:
        asked = spark.createDataFrame([(t, lo, hi) for t, (lo, hi, _) in open_.items()], "target int, lo bigint, hi bigint")
        inside = docs.join(F.broadcast(asked), "target").where("place between lo and hi")  # at most one row a target
        sums = inside.groupBy("target", F.shiftright("place", shift).alias("digit")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
        held: dict[int, list] = {t: [] for t in open_}
        for r in sums.collect():  # at most 2 ** DIGIT_BITS rows a target
            held[r["target"]].append((r["digit"], r["tokens"], r["n"]))
        after = {}
        for t, (lo, hi, wanted) in open_.items():
            ranges = sorted(held[t])
            for at, (digit, tokens, n) in enumerate(ranges):
                first, last = max(digit << shift, lo), min(((digit + 1) << shift) - 1, hi)
                if tokens > wanted:
                    if n > FEW and shift:
                        after[t] = (first, last, wanted)
                        break
                    for further, _, more in ranges[at + 1 :]:  # as many to choose from as are few
                        if (n := n + more) > FEW:
                            break
                        last = min(((further + 1) << shift) - 1, hi)
                    found.append((t, first, last, wanted))
                    break
                wanted -= tokens
            else:  # all of it is wanted
                found.append((t, hi, hi, -1))
        open_, shift = after, max(shift - DIGIT_BITS, 0)
    return found


def fill(place: np.ndarray, tokens: np.ndarray, wanted: int) -> np.ndarray:
    """Which documents are taken: in order of place what still fits, then the least of the others if that comes nearer."""
    taken = np.zeros(len(place), bool)
    for i in np.lexsort((tokens, place)):
        if tokens[i] <= wanted:
            taken[i] = True
            wanted -= int(tokens[i])
    others = np.flatnonzero(~taken)
    if len(others) and wanted > 0:
        least = others[np.lexsort((place[others], tokens[others]))[0]]
        taken[least] = tokens[least] - wanted < wanted
    return taken


def mix(df: DataFrame, key: str, text: str, source: str, targets: list[tuple[str, str, float, int]], seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, list[tuple]]:
    """Drawn copies (mix_name, shard, place, key, source, copy_no, tokens), and the targets used (mix_name, source, share, repeats)."""
    spark = df.sparkSession
    targets = [(m, s, float(p), max(int(r or 1), 1)) for m, s, p, r in targets if m is not None and s is not None and p and p > 0]
    targets = [(m, s, sum(p for a, b, p, _ in targets if (a, b) == (m, s)), min(r for a, b, _, r in targets if (a, b) == (m, s))) for m, s in dict.fromkeys((m, s) for m, s, *_ in targets)]
    sources = sorted({s for _, s, _, _ in targets})
    base = df.select(df[key].alias(key), df[source].cast("string").alias("source"), df[text].alias("_t"))
    counted = materialize(token_counts(base.where(F.col("source").isin(sources)), "_t", [key, "source"], vocabulary).where("tokens > 0"), "sized")
    kind = counted.schema[key].dataType.simpleString()
    have = {r["source"]: (r["n"], r["docs"]) for r in counted.groupBy("source").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()}  # one row a target source
    rows = quotas(targets, {s: n for s, (n, _) in have.items()})
    if not rows:
        return spark.createDataFrame([], f"mix_name string, shard bigint, place bigint, `{key}` {kind}, source string, copy_no int, tokens bigint"), targets
    shards = {name: max(sum(have[s][0] * k + part for m, s, k, part in rows if m == name) // SHARD_TOKENS, 1) for name in {m for m, *_ in rows}}
    blocks = [max(min(max(BLOCKS, 2 * shards[m]), have[s][1] // 4), 1) for m, s, *_ in rows]
    # One row a target: passes and blocks of a pass.
    plan = spark.createDataFrame([(i, m, s, k, b) for i, ((m, s, k, _), b) in enumerate(zip(rows, blocks))], "target int, mix_name string, source string, passes int, blocks bigint")
    salted = lambda *c: F.xxhash64(F.lit(seed), *c)
    docs = counted.join(F.broadcast(plan), "source").withColumn("place", F.shiftrightunsigned(salted(F.col(key), F.col("mix_name")), 1))
    found = cuts(docs.select("target", "place", "tokens"), {i: part for i, (*_, part) in enumerate(rows)})
    block_of = lambda place, n: ((place >> 31) * n) >> 32
    # Blocks that a part pass reaches into; all blocks of a source, permuted by a linear map; where they begin.
    reached = {t: block_of(last, blocks[t]) + 1 for t, first, last, wanted in found}
    counts = [k * b + reached.get(i, 0) for i, ((_, _, k, _), b) in enumerate(zip(rows, blocks))]
    steps = []
    for i, n in enumerate(counts):
        rng = np.random.default_rng([seed, i, *f"{rows[i][0]}/{rows[i][1]}".encode()])
        step = int(rng.integers(1, max(n, 2)))
        while gcd(step, max(n, 1)) != 1:
            step += 1
        steps.append((i, n, step, int(rng.integers(0, max(n, 1))), shards[rows[i][0]]))
    cut = spark.createDataFrame([(t, first, last, wanted) for t, first, last, wanted in found], "target int, first bigint, last bigint, wanted bigint")
    placed = docs.join(F.broadcast(cut), "target", "left").join(F.broadcast(spark.createDataFrame(steps, "target int, n bigint, step bigint, begin bigint, shards bigint")), "target")
    # The few documents of the range with the cut are taken in their order while they fit what is wanted.
    edge = placed.where("wanted > 0 and place between first and last").withColumn("_in", F.lit(False))
    edge = edge.groupBy("target").applyInPandas(lambda few: few.assign(_in=fill(few["place"].to_numpy(), few["tokens"].to_numpy(), int(few["wanted"].iloc[0]))), edge.schema)
    rest = placed.where("wanted is null or wanted <= 0 or place not between first and last")
    rest = rest.withColumn("_in", F.expr("coalesce(if(wanted < 0, place <= last, place < first), false)"))
    drawn = rest.unionByName(edge).withColumn("_copies", F.col("passes") + F.col("_in").cast("int")).where("_copies > 0")
    drawn = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    number = F.col("copy_no") * F.col("blocks") + F.shiftright(F.shiftright("place", 31) * F.col("blocks"), 32)
    drawn = drawn.withColumn("r", F.pmod(number * F.col("step") + F.col("begin"), F.col("n")))
    near = F.floor(F.col("r") / F.col("n") * F.ceil(F.col("shards") / TOGETHER))
    drawn = drawn.select("mix_name", "target", "r", key, "source", "copy_no", "tokens", F.col("place").alias("_h"), near.alias("_near")).repartition("mix_name", "_near").drop("_near")
    trees = [(m, [i for i, x in enumerate(rows) if x[0] == m], shards[m]) for m in sorted(shards)]
    schema = f"mix_name string, shard bigint, `{key}` {kind}, source string, copy_no int, tokens bigint, _h bigint"

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(np.array(own), Tree(m, [counts[i] for i in own], n, seed)) for m, own, n in trees]
        for batch in batches:
            target, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            shard = np.zeros(len(target), np.int64)
            for own, tree in known:
                at = np.flatnonzero((target >= own[0]) & (target <= own[-1]))  # targets of a mix stand side by side
                if len(at):
                    shard[at] = tree.shard_of(target[at] - own[0], place[at])
            yield pa.record_batch([batch.column(0), pa.array(shard), *(batch.column(c) for c in range(3, 8))], names=["mix_name", "shard", key, "source", "copy_no", "tokens", "_h"])

    told = drawn.mapInArrow(down, schema)
    local = Window.partitionBy("mix_name", "shard").orderBy(salted(F.col("_h"), F.col("copy_no")), key, "copy_no")
    return told.select("mix_name", "shard", (F.row_number().over(local) - 1).cast("bigint").alias("place"), key, "source", "copy_no", "tokens"), targets


def mix_report(drawn: DataFrame, key: str, targets: list[tuple]) -> DataFrame:
    """Per mix and source: target and reached share, tokens, rows, the most copies of a document and the cap."""
    spark = drawn.sparkSession
    wanted = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    per = drawn.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), (F.max("copy_no") + 1).alias("most_repeats"))
    out = F.broadcast(wanted).join(per, ["mix_name", "source"], "left").fillna(0, ["tokens", "copies", "most_repeats"])
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return out.withColumn("actual_share", F.coalesce(F.col("tokens") / total, F.lit(0.0)))
