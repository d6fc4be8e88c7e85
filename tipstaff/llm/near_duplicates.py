"""Problem 3: records that carry almost the same text: subsets of a partitioned feature domain as signatures, exact.

A record's features are the distinct runs of three successive words of its act and text, as 50-bit hashes.
Records of equal feature sets form a class, named by a 64-bit hash of the set; everything up to the last
step works on classes, so copies cost nothing more.

Method. As in PartEnum the feature domain is partitioned (by hash, into PARTS parts) and subsets within the
partition are enumerated, so that two sets that are similar enough must share one signature. PartEnum's own
signatures are whole projections on several parts, which a single differing feature spoils: at a shared share
of 0.6 two sets may differ in half as many features as either has, so the projections that must still agree
hold about one feature or none, and empty ones agree for all sets. Here a signature is a subset that both
sets hold, whatever else stands in the part:

* All features stand in one order, rare ones first. Two sets u and v that reach the threshold t share
  o >= t / (1 + t) * (|u| + |v|) features, so u lacks at most |u| - o of its own in v, and the first PARTS + 1
  shared ones stand among its first |u| - o + PARTS + 1. As o >= t * |u|, each set knows how far that reaches.
* If the first shared feature is rare (in at most RARE sets), it is a signature by itself in both sets.
* If it is not, all shared features are frequent, and two of the first PARTS + 1 fall into the same part: that
  pair is a signature in both sets. Every pair of frequent features of one part within reach is enumerated.
  Pairs of frequent features are far rarer than the features, which keeps the lists short as the data grow.
* Sets so small that they need not share PARTS + 1 features also sign each single feature within reach.

So no pair is lost, whatever the order. How rare a feature is is read from a table of slots, which hold how
often the features hashed into them were seen; its size does not grow with the records. Slots shared by
several features make a rare one count as frequent, which costs signatures and no pairs. A slot seen once
holds a feature of one set, which can have no partner by it and is no signature.

Signatures are shuffled once and sorted; pairs are formed inside the sorted stream. Each row carries how deep
in the set the signature lies, the set's size and a parity sketch of its features. A pair is refused where the
signature lies too deep for the two sizes (then another one is shared, or none is due) or where the sketches
differ in more bits than the sets may differ in features; neither refuses a true pair. Partitions are sized
from the number of sets. A signature with more than SPLIT classes is not paired in that task: its members are
joined tile by tile of SPLIT by SPLIT in a further step. The remaining pairs are checked exactly on the full
sets, which are computed again only for classes that stand in a candidate pair. Where pairs of records are
wanted, classes of many copies meet in tiles of about TILE by TILE records.

Defined results. Null act counts as empty, null text as no words. Records with fewer than min_words words
are in no pair and no class. Equal sets share 1.0; a record is never its own partner. Empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import runs

#: Parts of the feature domain that frequent features are paired within, and the sets up to which a feature is rare.
PARTS, RARE = 12, 64
#: Slots (as a power of two) of the table that says how rare a feature is: bounds what is broadcast.
RANK_BITS = 21
#: Classes of one signature that are paired within a task; wider ones are paired tile by tile.
SPLIT = 512
#: Records of a class that meet those of another (or its own copies) in one tile.
TILE = 1_000
#: Records whose signatures one task sorts and pairs.
SETS_A_TASK = 40_000
#: Rows of the sorted stream that are paired at once.
RUN = 150_000
#: Slots of the filter that keeps classes without candidates out of the last step: bounds what is broadcast.
SLOTS = 1 << 21
#: Rows whose sets are worked on at once; 50 bits are left for a feature beside 14 for the row.
CHUNK = 8_192
#: Bits of the parity sketch: three words, of which 16 bits hold the size, up to MOST.
SKETCH, MOST = 176, 65_535
U = np.uint64


class Sets:
    """The feature sets of one chunk of rows (key, act, text): only rows with enough words have one."""

    def __init__(self, chunk: pa.RecordBatch, min_words: int, width: int):
        act, text = pc.fill_null(chunk.column(1), ""), pc.fill_null(chunk.column(2), "")
        row, start, stop, raw = runs.words(pc.binary_join_element_wise(act, text, "\x01"), runs.LETTERS_DIGITS)
        # words past the mark between act and text count as the text's
        mark = np.flatnonzero(raw == 1)[: chunk.num_rows] if (raw == 1).sum() == chunk.num_rows else None
        if mark is None:
            alone, *_ = runs.words(text, runs.LETTERS_DIGITS)
            enough = np.bincount(alone, minlength=chunk.num_rows) >= min_words
        else:
            enough = np.bincount(row[start > mark[row]], minlength=chunk.num_rows) >= min_words
        use = enough[row]
        row, start, stop = row[use], start[use], stop[use]
        keys = np.zeros(0, U)
        if len(row) >= width:
            h = runs.word_hashes(start, stop, raw)
            n = len(h) - width + 1
            run = np.zeros(n, U)
            for i in range(width):
                run = runs.mix(run * U(3) + h[i : i + n])
            same = row[:n] == row[width - 1 :]
            keys = np.sort((row[:n][same].astype(U) << U(50)) | (run[same] >> U(14)))
            keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
        self.owner = (keys >> U(50)).astype(np.int64)
        self.feature = keys & U((1 << 50) - 1)
        self.rows, self.start = np.unique(self.owner, return_index=True)
        self.size = np.diff(np.concatenate((self.start, [len(keys)]))).astype(np.int64)
        mixed = runs.mix(self.feature)
        sums = np.add.reduceat(mixed, self.start) if len(keys) else np.zeros(0, U)
        self.name = runs.mix(sums + self.size.astype(U))
        self.index = np.repeat(np.arange(len(self.rows)), self.size)

    def keep(self, wanted: np.ndarray) -> None:
        """Only the sets named by a mask, each name once."""
        _, first = np.unique(self.name, return_index=True)
        once = np.zeros(len(self.name), bool)
        once[first] = True
        wanted = wanted & once
        inside = wanted[self.index]
        self.feature = self.feature[inside]
        self.rows, self.size, self.name = self.rows[wanted], self.size[wanted], self.name[wanted]
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)[: len(self.size)]
        self.index = np.repeat(np.arange(len(self.rows)), self.size)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            yield batch.slice(at, CHUNK)


def _base(df: DataFrame, key: str, act: str, text: str) -> DataFrame:
    return df.select(df[key], df[act].cast("string").alias("_a"), df[text].cast("string").alias("_t"))


def _slot(mixed: np.ndarray) -> np.ndarray:
    return (mixed >> U(64 - RANK_BITS)).astype(np.int64)


def survey(base: DataFrame, min_words: int, width: int) -> DataFrame:
    """One pass, written once: key and class_hash of every record with enough words, and slot and n, how often the slot's features were seen."""
    key = base.columns[0]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, names = np.zeros(1 << RANK_BITS, np.int64), [key, "class_hash", "slot", "n"]
        kind = None
        for chunk in _chunks(batches):
            sets = Sets(chunk, min_words, width)
            kind, rows = chunk.schema.field(0).type, len(sets.rows)
            yield pa.record_batch([chunk.column(0).take(pa.array(sets.rows)), pa.array(sets.name.view(np.int64)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64())], names=names)
            sets.keep(np.ones(len(sets.name), bool))  # copies count once a chunk
            seen += np.bincount(_slot(runs.mix(sets.feature)), minlength=len(seen))
        slot = np.flatnonzero(seen)
        if len(slot):
            yield pa.record_batch([pa.nulls(len(slot), kind), pa.nulls(len(slot), pa.int64()), pa.array(slot.astype(np.int32)), pa.array(seen[slot])], names=names)

    return materialize(base.mapInArrow(per_batch, f"`{key}` {base.schema[0].dataType.simpleString()}, class_hash bigint, slot int, n bigint"), "survey")


def _ranks(surveyed: DataFrame) -> np.ndarray:
    """One byte a slot, rare features first: 0 for a slot seen at most once, else eight steps a doubling."""
    counts = surveyed.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n"))
    rows = counts.where("n > 1").select("slot", F.least(F.round(8 * F.log2("n")), F.lit(255)).cast("int").alias("rank")).toPandas()  # at most 1 << RANK_BITS
    ranks = np.zeros(1 << RANK_BITS, np.uint8)
    ranks[rows["slot"].to_numpy(dtype=np.int64)] = rows["rank"].to_numpy(dtype=np.uint8)
    return ranks


def least_shared(a, b, threshold: float):
    """Features that two sets of these sizes must share to reach the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def _signed(sets: Sets, ranks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Set and signature (40 bits of hash, 8 of how deep it lies; short, as they are all that differs between the rows of a set), rows of a set side by side."""
    mixed = runs.mix(sets.feature)
    # 13 bits for the set in its chunk, 8 for the rank, 43 of the hash; equal ones only make more candidates
    key = np.sort((sets.index.astype(U) << U(51)) | (ranks[_slot(mixed)].astype(U) << U(43)) | (mixed >> U(21)))
    place = np.arange(len(key)) - np.repeat(sets.start, sets.size)
    rank, hashed = (key >> U(43)) & U(0xFF), key & U((1 << 43) - 1)
    lacks = sets.size - np.ceil(threshold * sets.size - 1e-9).astype(np.int64)  # features of a set that a partner may lack
    small = threshold * sets.size < PARTS + 1
    near = place <= np.repeat(lacks, sets.size)
    rare = rank <= U(round(8 * np.log2(RARE)))
    alone = np.flatnonzero(near & (rank > U(0)) & (rare | np.repeat(small, sets.size)))
    at, signature, depth = [sets.index[alone]], [runs.mix(hashed[alone])], [place[alone]]
    # Pairs of frequent features: only where the rare ones alone do not reach beyond what may be lacking.
    open_ = np.bincount(sets.index[rare], minlength=len(sets.size)) <= lacks
    use = np.flatnonzero(~rare & np.repeat(open_, sets.size) & (place <= np.repeat(lacks + PARTS, sets.size)))
    group = sets.index[use] * PARTS + (runs.mix(hashed[use]) % U(PARTS)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    use, group = use[order], group[order]
    first, step = np.arange(len(use)), 1
    while len(first):
        first = first[first + step < len(use)]
        first = first[group[first] == group[first + step]]
        x, y = use[first], use[first + step]
        at.append(sets.index[x])
        signature.append(runs.mix(hashed[x] * U(3) + runs.mix(hashed[y])))
        depth.append(np.maximum(place[y] - PARTS, 0))
        step += 1
    at, signature, depth = np.concatenate(at), np.concatenate(signature), np.concatenate(depth)
    order = np.argsort(at, kind="stable")
    return at[order], (signature[order] >> U(24) << U(8)) | np.minimum(depth[order], 255).astype(U)


def _sketch(sets: Sets) -> list[np.ndarray]:
    """Size (16 bits) with 48 parity bits, and 128 further parity bits, of every set."""
    if not len(sets.start):
        return [np.zeros(0, U)] * 3
    bit = runs.mix(sets.feature ^ U(0x3C3C)) % U(SKETCH) + U(16)
    words = [np.bitwise_xor.reduceat(np.where(bit // U(64) == U(k), U(1) << (bit % U(64)), U(0)), sets.start) for k in range(3)]
    words[0] |= np.minimum(sets.size, MOST).astype(U)
    return words


_SIGNED = ["signature", "c", "s0", "s1", "s2"]
_PAIRED = ["kind", "x", "y", "s0", "s1", "s2", "depth"]


def signatures(base: DataFrame, ranks: np.ndarray, threshold: float, min_words: int, width: int) -> DataFrame:
    """signature, c (class) and the three words of its sketch; a class has each signature once a chunk."""
    shared = base.sparkSession.sparkContext.broadcast(ranks)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            sets = Sets(chunk, min_words, width)
            sets.keep(np.ones(len(sets.name), bool))
            words = _sketch(sets)
            at, sig = _signed(sets, shared.value, threshold)
            yield pa.record_batch([pa.array(x.view(np.int64)) for x in (sig, sets.name[at], *(w[at] for w in words))], names=_SIGNED)

    return base.mapInArrow(per_batch, ", ".join(f"{c} bigint" for c in _SIGNED))


def _plausible(a: list[np.ndarray], b: list[np.ndarray], depth_a, depth_b, threshold: float) -> np.ndarray:
    """Places of the pairs that sizes, depths and sketches (three words each) do not rule out."""
    size_a, size_b = (a[0] & U(MOST)).astype(np.int64), (b[0] & U(MOST)).astype(np.int64)
    capped = np.maximum(size_a, size_b) >= MOST
    most = least_shared(size_a, size_b, threshold)
    good = np.flatnonzero(capped | ((np.minimum(size_a, size_b) >= most) & (depth_a <= size_a - most) & (depth_b <= size_b - most)))
    differ = np.bitwise_count((a[0][good] ^ b[0][good]) >> U(16)).astype(np.int64)
    for k in (1, 2):
        differ += np.bitwise_count(a[k][good] ^ b[k][good])
    return good[capped[good] | (differ <= size_a[good] + size_b[good] - 2 * most[good])]


def _plausible_rows(threshold: float) -> Column:
    """The same test on columns as0..as2, ad (sketch, depth) and bs0..bs2, bd."""
    size_a, size_b = (F.col(c).bitwiseAND(F.lit(MOST)) for c in ("as0", "bs0"))
    most = F.ceil(F.lit(threshold / (1 + threshold)) * (size_a + size_b) - 1e-9)
    differ = F.bit_count(F.shiftrightunsigned(F.col("as0").bitwiseXOR(F.col("bs0")), 16)) + F.bit_count(F.col("as1").bitwiseXOR(F.col("bs1"))) + F.bit_count(F.col("as2").bitwiseXOR(F.col("bs2")))
    near = (F.least(size_a, size_b) >= most) & (F.col("ad") <= size_a - most) & (F.col("bd") <= size_b - most) & (differ <= size_a + size_b - 2 * most)
    return (F.greatest(size_a, size_b) >= MOST) | near


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of at least RUN rows at once."""
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False).view(U) for i in range(batch.num_columns)])
        n += batch.num_rows
        if n >= RUN:
            yield [np.concatenate(x) for x in zip(*held)]
            held, n = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def candidates(sigs: DataFrame, threshold: float, sets: int) -> DataFrame:
    """Distinct pairs (a < b) of classes that share a signature and may reach the threshold."""
    tasks = max(int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sets // SETS_A_TASK))
    stream = sigs.repartition(tasks, F.shiftright("signature", 8)).sortWithinPartitions("signature")  # one column: sorted by radix

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows kind 0: a pair (x, y) of classes; kind 1: a member (signature, class, sketch) of a wide signature."""
        left = None
        wide = None  # the wide signature whose members are passing
        for batch in itertools.chain(_gathered(batches), [None]):
            if batch is not None:
                rows = batch
                rows = [np.concatenate((x, y)) for x, y in zip(left, rows)] if left is not None else rows
            elif left is not None:
                rows = left
            else:
                return
            if not len(rows[0]):
                continue
            order = np.lexsort((rows[1], rows[0].view(np.int64)))
            new = np.concatenate(([True], (np.diff(rows[0][order]) != 0) | (np.diff(rows[1][order]) != 0)))  # copies of a class pass once
            rows = [x[order[new]] for x in rows]
            sig = rows[0] >> U(8)
            other = np.flatnonzero(sig != sig[-1])
            end = len(sig) if batch is None else int(other[-1]) + 1 if len(other) else 0
            # at the close nothing follows: the row held back goes out, as wide where its signature was
            flow = sig[-1] if batch is not None and (len(sig) - end > SPLIT or (wide is not None and sig[-1] == wide)) else None
            if flow is not None:
                end = len(sig) - 1  # one row stays to see whether the signature goes on
            left = [x[end:] for x in rows]
            rows, sig = [x[:end] for x in rows], sig[:end]
            if not len(sig):
                wide = flow if flow is not None else wide
                continue
            depth = (rows[0] & U(0xFF)).astype(np.int64)
            depth[depth == 255] = 0  # deeper than is told: not refused
            change = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            count = np.diff(np.concatenate((change, [len(sig)])))
            spread = count > SPLIT
            for known in (wide, flow):
                if known is not None:
                    spread |= sig[change] == known
            is_wide = np.repeat(spread, count)
            wide = flow if flow is not None else wide
            a, b = [], []
            at, step = np.flatnonzero(~is_wide), 1
            while len(at):
                at = at[at + step < len(sig)]
                at = at[sig[at] == sig[at + step]]
                good = at[_plausible([w[at] for w in rows[2:]], [w[at + step] for w in rows[2:]], depth[at], depth[at + step], threshold)]
                a.append(rows[1][good].view(np.int64))
                b.append(rows[1][good + step].view(np.int64))
                step += 1
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
                pairs = pairs[:, pairs[0] != pairs[1]]
                none = pa.nulls(pairs.shape[1], pa.int64())
                yield pa.record_batch([pa.array(np.zeros(pairs.shape[1], np.int32)), pa.array(pairs[0]), pa.array(pairs[1]), none, none, none, none], names=_PAIRED)
            if is_wide.any():
                yield pa.record_batch([pa.array(np.ones(int(is_wide.sum()), np.int32)), *(pa.array(x[is_wide].view(np.int64)) for x in (sig, *rows[1:])), pa.array(depth[is_wide])], names=_PAIRED)

    out = materialize(stream.mapInArrow(pair_up, "kind int, " + ", ".join(f"{c} bigint" for c in _PAIRED[1:])), "paired")
    near = out.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"))
    if out.where("kind = 1").isEmpty():
        return near.distinct()
    # Wide signatures: a member of block i meets block j >= i in tile (i, j).
    rows = out.where("kind = 1").select(F.col("x").alias("signature"), F.col("y").alias("c"), "s0", "s1", "s2", "depth").distinct()
    blocks = rows.groupBy("signature").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("blocks"))
    rows = rows.join(blocks, "signature").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))

    def side(x: str, tile: Column) -> DataFrame:
        cols = [F.col("c").alias(x), F.col("depth").alias(f"{x}d"), *(F.col(w).alias(f"{x}{w}") for w in ("s0", "s1", "s2"))]
        return rows.select("signature", F.explode(tile).alias("tile"), F.col("own").alias(f"{x}o"), *cols)

    one = side("a", F.transform(F.sequence(F.col("own"), F.col("blocks") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))))
    two = side("b", F.transform(F.sequence(F.lit(0), F.col("own")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))))
    met = one.join(two, ["signature", "tile"]).where(_plausible_rows(threshold) & ((F.col("ao") != F.col("bo")) | (F.col("a") < F.col("b"))))
    return near.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")).distinct()


def class_links(df: DataFrame, key: str, act: str, text: str, threshold: float, min_words: int, width: int) -> tuple[DataFrame, DataFrame]:
    """key and class_hash of every record with enough words; a, b, shared: pairs of classes (a < b) whose shared share is at least the threshold, checked exactly."""
    base = _base(df, key, act, text)
    surveyed = survey(base, min_words, width)
    people = surveyed.where("slot is null").select(key, "class_hash")
    ranks, sets = _ranks(surveyed), people.count()
    pairs = materialize(candidates(signatures(base, ranks, threshold, min_words, width), threshold, sets), "candidates")
    slots = pairs.select(F.explode(F.array("a", "b")).alias("c")).select(F.pmod("c", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy()  # at most SLOTS
    filled = np.zeros(SLOTS // 8, np.uint8)
    np.bitwise_or.at(filled, slots // 8, np.left_shift(1, slots % 8).astype(np.uint8))
    shared = df.sparkSession.sparkContext.broadcast(filled)

    def sets_of_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            sets = Sets(chunk, min_words, width)
            slot = np.mod(sets.name.view(np.int64), SLOTS)
            sets.keep((shared.value[slot // 8] >> (slot % 8).astype(np.uint8)) & 1 == 1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate((sets.start, [len(sets.feature)])).astype(np.int32)), pa.array(sets.feature.view(np.int64)))
            yield pa.record_batch([pa.array(sets.name.view(np.int64)), lists], names=["c", "features"])

    held = base.mapInArrow(sets_of_candidates, "c bigint, features array<bigint>").dropDuplicates(["c"])
    met = pairs.join(held.select(F.col("c").alias("a"), F.col("features").alias("_fa")), "a")
    met = met.join(held.select(F.col("c").alias("b"), F.col("features").alias("_fb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            na, nb = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
            rows = np.concatenate((np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)))
            feature = np.concatenate((a.flatten().to_numpy(), b.flatten().to_numpy()))
            both_keys = np.sort((rows.astype(U) << U(50)) | feature.view(U))
            twice = both_keys[1:][both_keys[1:] == both_keys[:-1]]
            both = np.bincount((twice >> U(50)).astype(np.int64), minlength=len(na))
            share = both / np.maximum(na + nb - both, 1)
            good = np.flatnonzero(share >= threshold - 1e-12)
            yield pa.record_batch([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(share[good])], names=["a", "b", "shared"])

    return people, met.select("a", "b", "_fa", "_fb").mapInArrow(lambda it: check(_chunks(it)), "a bigint, b bigint, shared double")


def near_duplicate_pairs(df: DataFrame, key: str, act: str, text: str, threshold: float = 0.6, min_words: int = 45, width: int = 3) -> DataFrame:
    """Every pair of records with a shared share of at least the threshold: {key}_a < {key}_b, shared."""
    people, links = class_links(df, key, act, text, threshold, min_words, width)
    sizes = people.groupBy("class_hash").agg(F.count(F.lit(1)).alias("n"))
    cells = sizes.select("class_hash", "n", F.ceil(F.col("n") / TILE).cast("int").alias("cells"))
    # Classes meet tile by tile: cell i of one and cell j of the other; a class of copies meets itself for i <= j.
    many = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    tiles = links.join(cells.select(F.col("class_hash").alias("a"), F.col("cells").alias("_ca")), "a").join(cells.select(F.col("class_hash").alias("b"), F.col("cells").alias("_cb")), "b")
    tiles = tiles.withColumn("i", F.explode(many("_ca"))).withColumn("j", F.explode(many("_cb"))).select("a", "b", "i", "j", "shared")
    own = cells.where("n > 1").withColumn("i", F.explode(many("cells"))).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("cells") - 1)))
    tiles = tiles.unionByName(own.select(F.col("class_hash").alias("a"), F.col("class_hash").alias("b"), "i", "j", F.lit(1.0).alias("shared")))
    placed = people.join(cells, "class_hash").select(key, "class_hash", F.pmod(F.xxhash64(key), F.col("cells")).cast("int").alias("cell"))
    left = placed.select(F.col(key).alias("_l"), F.col("class_hash").alias("a"), F.col("cell").alias("i"))
    right = placed.select(F.col(key).alias("_r"), F.col("class_hash").alias("b"), F.col("cell").alias("j"))
    met = tiles.join(left, ["a", "i"]).join(right, ["b", "j"]).where("a <> b or i <> j or _l < _r")
    return met.select(F.least("_l", "_r").alias(f"{key}_a"), F.greatest("_l", "_r").alias(f"{key}_b"), "shared")


def near_duplicate_groups(df: DataFrame, key: str, act: str, text: str, threshold: float = 0.6, min_words: int = 45, width: int = 3) -> DataFrame:
    """One row per record with enough words: key, class_id (least key of its class), copies (others of its class), links (classes similar to it)."""
    people, links = class_links(df, key, act, text, threshold, min_words, width)
    ends = links.select(F.explode(F.array("a", "b")).alias("class_hash")).groupBy("class_hash").agg(F.count(F.lit(1)).alias("links"))
    heads = people.groupBy("class_hash").agg(F.min(key).alias("class_id"), (F.count(F.lit(1)) - 1).alias("copies"))
    return people.join(heads.join(ends, "class_hash", "left"), "class_hash").select(key, "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
