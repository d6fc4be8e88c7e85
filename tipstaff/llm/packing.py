"""Problem 6: filling windows of fixed capacity with documents, splitting only what is longer than a window.

Method: exact-complement hashing. How many items there are of each length decides everything, and there
are at most as many lengths as the capacity, so the plan is made on that histogram: lengths that fill a
window alone, pairs and triples whose sums fill it exactly (the third length is looked up by its
complement) are consumed while both counts last, and the rest goes best-fit, longest first. The histogram
and the plan have a size bound given by the capacity, not by the data.

The items themselves never meet the driver. Each gets its rank among the items of its length, from counts
per length and hash bucket and a rank within the bucket, so a length that a third of all documents share
is ranked by many tasks. Length and rank then give window and slot by a lookup in the plan.

A document longer than the capacity becomes full windows of its own and one remainder that is an item.

Defined results. Null and empty texts have no tokens and go in no window. Every other row is packed once,
repeated rows each. Ties between equal lengths are settled by a hash of the id. An empty table or a spec
without a positive capacity gives no rows; of repeated specs one is used. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .tokens import VOCABULARY, token_counts

#: Items of one length (or pieces of one spec) that one task ranks.
BUCKET_ROWS = 200_000


def exact_combinations(capacity: int, counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """(windows, lengths) of windows filled exactly by one, two or three items; counts is left with the rest."""
    out: list[tuple[int, list[int]]] = []

    def take(*lengths: int) -> None:
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        n = min(int(counts[x]) // k for x, k in need.items())
        if n > 0:
            for x, k in need.items():
                counts[x] -= n * k
            out.append((n, list(lengths)))

    if counts[capacity]:
        take(capacity)
    for a in range(capacity - 1, (capacity - 1) // 2, -1):
        if counts[a] and counts[capacity - a]:
            take(a, capacity - a)
    for a in range(capacity - 2, 0, -1):
        if not counts[a]:
            continue
        # second lengths from long to short; the third is the exact complement
        high = min(a, capacity - a - 1)
        b = np.arange(high, (capacity - a - 1) // 2, -1)
        c = capacity - a - b
        for i in np.flatnonzero((counts[b] > 0) & (counts[c] > 0)):
            take(a, int(b[i]), int(c[i]))
            if not counts[a]:
                break
    return out


def best_fit(capacity: int, counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(windows, [(length, items)]) for the rest: longest first into the smallest space that holds it.

    Windows of equal content are one group, so the work follows the number of lengths and not of items.
    """
    spaces: list[int] = []
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    for a in range(capacity, 0, -1):
        n = int(counts[a])
        while n > 0:
            at = bisect_left(spaces, a)
            if at < len(spaces):
                space = spaces[at]
                windows, content = groups[space].pop()
                if not groups[space]:
                    spaces.pop(at)
            else:
                space, windows, content = capacity, n, []
            per = min(space // a, n)
            used = min(windows, n // per)
            if used < windows and content:
                if not groups[space]:
                    insort(spaces, space)
                groups[space].append((windows - used, content))
            left = space - per * a
            n -= used * per
            if not groups[left]:
                insort(spaces, left)
            groups[left].append((used, [*content, (a, per)]))
        counts[a] = 0
    return [g for space in groups.values() for g in space]


def plan(capacity: int, lengths: np.ndarray, items: np.ndarray, first_window: int = 0) -> tuple[dict[str, np.ndarray], int]:
    """The lookup from length and rank to window, sorted by length and rank, and the number of windows."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[lengths] = items
    recipes = [(n, sorted(((x, ls.count(x)) for x in set(ls)), reverse=True)) for n, ls in exact_combinations(capacity, counts)]
    recipes += best_fit(capacity, counts)
    rows, used, window = [], defaultdict(int), first_window
    for n, content in recipes:
        slot = 0
        for length, per in content:
            rows.append((length, used[length], per, window, slot))
            used[length] += n * per
            slot += per
        window += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "per", "window", "slot"), table.T)), window - first_window


def ranked(items: DataFrame, by: str, id_hash: str, most: int) -> DataFrame:
    """items with rank, from 0, among the rows of equal `by`, of which there are at most `most`; no task sees more than a bucket of a value."""
    buckets = max(-(-most // BUCKET_ROWS), 1)
    rows = items.withColumn("_b", F.pmod(F.col(id_hash), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_b").orderBy(id_hash)) - 1)
    return within.join(offsets, [by, "_b"]).withColumn("rank", F.col("_r") + F.col("_before")).drop("_b", "_r", "_before")


def pack(df: DataFrame, key: str, text: str, specs: list[tuple[str, int]], vocabulary: str = VOCABULARY, tokens: DataFrame | None = None) -> DataFrame:
    """One row per piece: spec_name, window_no, slot, key, piece, start_token, tokens."""
    spark = df.sparkSession
    specs = sorted({n: int(c) for n, c in specs if n is not None and c and c > 0}.items())
    counted = tokens if tokens is not None else materialize(token_counts(df, text, [key], vocabulary), "tokens")
    kind = counted.schema[key].dataType.simpleString()
    schema = f"spec_name string, window_no bigint, slot bigint, `{key}` {kind}, piece bigint, start_token bigint, tokens bigint"
    if not specs:
        return spark.createDataFrame([], schema)
    caps = F.create_map(*[x for n, c in specs for x in (F.lit(n), F.lit(c))])
    rows = counted.where("tokens > 0").withColumn("_h", F.xxhash64(key)).withColumn("spec_name", F.explode(F.array(*[F.lit(n) for n, _ in specs])))
    rows = rows.withColumn("_cap", F.element_at(caps, F.col("spec_name")).cast("bigint"))
    # A document's last piece is an item like any other; the full pieces before it are windows of their own.
    rows = rows.withColumn("_full", F.floor((F.col("tokens") - 1) / F.col("_cap"))).withColumn("length", F.col("tokens") - F.col("_full") * F.col("_cap"))
    items = rows.withColumn("_what", F.col("spec_name"))
    histogram = items.groupBy("spec_name", "length").agg(F.count(F.lit(1)).alias("n"), F.sum("_full").alias("full")).collect()  # at most the capacity's number of rows a spec
    plans, whole = {}, {}
    for name, capacity in specs:
        own = [r for r in histogram if r["spec_name"] == name]
        lookup, windows = plan(capacity, np.array([r["length"] for r in own], dtype=np.int64), np.array([r["n"] for r in own], dtype=np.int64))
        plans[name], whole[name] = lookup, windows
    shared = spark.sparkContext.broadcast(plans)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            window, slot = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            for name, t in shared.value.items():
                mine = np.flatnonzero(names == name)
                if not len(mine):
                    continue
                # the last plan row of that length whose first rank is not beyond the item's
                order = t["length"] * (1 << 40) + t["rank"]
                at = np.searchsorted(order, length[mine] * (1 << 40) + rank[mine], side="right") - 1
                past = rank[mine] - t["rank"][at]
                window[mine], slot[mine] = t["window"][at] + past // t["per"][at], t["slot"][at] + past % t["per"][at]
            yield pa.record_batch(
                [batch.column(0), pa.array(window), pa.array(slot), batch.column(1), batch.column(4), batch.column(5), batch.column(2)],
                names=["spec_name", "window_no", "slot", key, "piece", "start_token", "tokens"],
            )

    placed = ranked(items.withColumn("_by", F.struct("spec_name", "length")), "_by", "_h", max((r["n"] for r in histogram), default=0))
    last = placed.select("spec_name", key, "length", F.col("rank").cast("bigint"), F.col("_full").cast("bigint").alias("piece"), (F.col("_full") * F.col("_cap")).cast("bigint").alias("start_token"))
    out = last.mapInArrow(place, schema)
    # Full pieces: numbered after the planned windows, distributed by partition-independent ranks of their documents.
    long = rows.where("_full > 0").select("spec_name", key, "_cap", "_full", "_h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full") - 1)).alias("piece"))
    long = ranked(long.withColumn("_hp", F.xxhash64("_h", "piece")), "spec_name", "_hp", max((sum(r["full"] for r in histogram if r["spec_name"] == n) for n, _ in specs), default=0))
    planned = F.element_at(F.create_map(*[x for n, w in whole.items() for x in (F.lit(n), F.lit(w))]), F.col("spec_name"))
    full = long.select(
        "spec_name", (planned + F.col("rank")).cast("bigint").alias("window_no"), F.lit(0).cast("bigint").alias("slot"), key,
        F.col("piece").cast("bigint"), (F.col("piece") * F.col("_cap")).cast("bigint").alias("start_token"), F.col("_cap").cast("bigint").alias("tokens"),
    )
    return out.unionByName(full)


def pack_report(packed: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """Per spec: windows, tokens, the fewest windows possible by volume, and the share of space filled."""
    caps = F.create_map(*[x for n, c in specs for x in (F.lit(n), F.lit(int(c)))])
    totals = packed.groupBy("spec_name").agg((F.max("window_no") + 1).alias("windows"), F.sum("tokens").alias("tokens"))
    cap = F.element_at(caps, F.col("spec_name"))
    return totals.select("spec_name", cap.alias("capacity_tokens"), "windows", "tokens", F.ceil(F.col("tokens") / cap).alias("least_windows"), F.round(F.col("tokens") / (F.col("windows") * cap), 6).alias("filled"))
