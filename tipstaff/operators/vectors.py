"""Exact nearest vectors by cosine: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2_048


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """query_id, {key}, cosine, rank of the k rows most like each query, itself left out; ties by key.

    Queries reach the driver and travel in blocks of about BLOCK vectors; every task keeps its best k per query, so what is shuffled is
    k rows per query and batch. Null vectors and vectors of length 0 are near nothing.
    """
    good = queries.where(F.col(vector).isNotNull()).select(key, vector)
    blocks = max(-(-good.count() // BLOCK), 1)
    base = rows.where(F.col(vector).isNotNull()).select(key, vector)
    out = None
    for block in range(blocks):
        part = good.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block).toPandas()  # about BLOCK queries at a time
        names = part[key].to_numpy(dtype=np.int64)
        matrix = np.array([np.asarray(v, dtype=np.float64) for v in part[vector]]) if len(part) else np.zeros((0, 1))
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = rows.sparkSession.sparkContext.broadcast((names, matrix / np.where(length > 0, length, 1)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            who, q = shared.value
            for batch in batches:
                if not batch.num_rows or not len(who):
                    continue
                own = batch.column(0).to_numpy(zero_copy_only=False)
                m = np.array([np.asarray(v, dtype=np.float64) for v in batch.column(1).to_pylist()])
                n = np.linalg.norm(m, axis=1, keepdims=True)
                s = np.round(q @ (m / np.where(n > 0, n, 1)).T, 4)
                s[who[:, None] == own[None, :]] = -np.inf
                s[:, n[:, 0] == 0] = -np.inf
                top = np.lexsort((np.broadcast_to(own, s.shape), -s))[:, :k]
                qi = np.repeat(np.arange(len(who)), top.shape[1])
                ri = top.ravel()
                keep = np.isfinite(s[qi, ri])
                yield pa.record_batch([pa.array(who[qi][keep]), pa.array(own[ri][keep]), pa.array(s[qi, ri][keep])], names=["query_id", key, "cosine"])

        found = base.mapInArrow(best, f"query_id bigint, `{key}` bigint, cosine double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)
