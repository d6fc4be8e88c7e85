"""Problem 1: how strongly each term marks a record against the whole collection.

Every term of a record gets the log-likelihood ratio of the two-by-two table

    term in record      | other terms in record
    term in the rest    | other terms in the rest

with a sign: negative where the record holds the term less often than the collection does.

Plan. One pass over the texts counts terms per Arrow batch, so the shuffle carries one row per distinct
term and batch and not one per occurrence. A second pass emits the (record, term) rows asked for. They
meet the statistics in two ways: terms that hold at least 1/HEAVY of all postings (by that definition
never more than HEAVY terms) are joined by broadcast, all others by a shuffle on the term, so the words
that stand in every record never gather in one task.

Defined results. Null text or heading counts as empty. A record without terms gives no row. Equal records
keep their own rows; ids are not assumed unique, a repeated row is a further record of the collection, and
its rows are then repeated too. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from ..runtime import materialize

#: A term with at least 1/HEAVY of all postings is joined by broadcast: at most HEAVY rows.
HEAVY = 2_000


def _counted(batch: pa.RecordBatch, chars: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of a batch (key, text...): row, term code and count of each posting, words per row, the terms."""
    parts = [pc.fill_null(batch.column(i), "") for i in range(1, batch.num_columns)]
    text = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
    row, start, stop, raw = runs.words(text, chars)
    coded = runs.word_strings(start, stop, raw).dictionary_encode()
    codes, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    pairs, tf = np.unique(row * max(len(terms), 1) + codes, return_counts=True)
    return pairs // max(len(terms), 1), pairs % max(len(terms), 1), tf, np.bincount(row, minlength=batch.num_rows), terms


def _stats(df: DataFrame, chars: str) -> DataFrame:
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, codes, tf, _, terms = _counted(batch, chars)
            n = len(terms)
            yield pa.record_batch(
                [terms, pa.array(np.bincount(codes, tf, n).astype(np.int64)), pa.array(np.bincount(codes, minlength=n).astype(np.int64))],
                names=["term", "cf", "df"],
            )

    return df.mapInArrow(per_batch, "term string, cf bigint, df bigint").groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _postings(df: DataFrame, key: str, chars: str, min_tf: int) -> DataFrame:
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, codes, tf, size, terms = _counted(batch, chars)
            keep = tf >= min_tf
            row, codes, tf = row[keep], codes[keep], tf[keep]
            yield pa.record_batch(
                [batch.column(0).take(pa.array(row)), terms.take(pa.array(codes)), pa.array(tf.astype(np.int64)), pa.array(size[row].astype(np.int64))],
                names=[key, "term", "tf", "record_terms"],
            )

    kind = df.schema[0].dataType.simpleString()
    return df.mapInArrow(per_batch, f"`{key}` {kind}, term string, tf bigint, record_terms bigint")


def log_likelihood(tf, cf, size, total):
    """Signed log-likelihood ratio of the two-by-two table as a column."""
    a, b = tf.cast("double"), (cf - tf).cast("double")
    c, d = (size - tf).cast("double"), (total - size - cf + tf).cast("double")
    x = lambda v: F.when(v > 0, v * F.log(v)).otherwise(F.lit(0.0))
    g = 2 * (x(a) + x(b) + x(c) + x(d) - x(a + b) - x(c + d) - x(a + c) - x(b + d) + x(a + b + c + d))
    more = a * (b + d) >= b * (a + c)
    return F.when(more, F.greatest(g, F.lit(0.0))).otherwise(-F.greatest(g, F.lit(0.0)))


def distinctive_terms(df: DataFrame, key: str, texts: list[str], min_tf: int = 1, max_df: int | None = None, chars: str = runs.LETTERS) -> DataFrame:
    """One row per record and term: key, term, tf, df, cf, record_terms, llr.

    min_tf keeps terms that stand at least so often in the record, max_df those in at most so many records;
    counts and scores are over the whole collection either way.
    """
    base = df.select(df[key], *[df[t].cast("string").alias(f"text_{i}") for i, t in enumerate(texts)])
    stats = materialize(_stats(base, chars), "terms")
    postings, total = stats.agg(F.sum("df"), F.sum("cf")).first()
    if not postings:
        found = _postings(base.limit(0), key, chars, min_tf)
        return found.select(key, "term", "tf", F.lit(0).cast("bigint").alias("df"), F.lit(0).cast("bigint").alias("cf"), "record_terms", F.lit(0.0).alias("llr"))
    bar = max(postings / HEAVY, 1)
    heavy, light = stats.where(F.col("df") >= bar), stats.where(F.col("df") < bar)
    rows = _postings(base, key, chars, min_tf)
    split = rows.join(F.broadcast(heavy.select("term", F.col("cf").alias("h_cf"), F.col("df").alias("h_df"))), "term", "left")
    cols = [key, "term", "tf", "df", "cf", "record_terms"]
    if max_df is not None:
        light = light.where(F.col("df") <= max_df)
    out = split.where("h_df is null").join(light, "term").select(*cols)
    if max_df is None or max_df >= bar:
        often = split.where("h_df is not null").select(key, "term", "tf", F.col("h_df").alias("df"), F.col("h_cf").alias("cf"), "record_terms")
        out = out.unionByName(often if max_df is None else often.where(F.col("df") <= max_df))
    return out.withColumn("llr", log_likelihood(F.col("tf"), F.col("cf"), F.col("record_terms"), F.lit(total)))
