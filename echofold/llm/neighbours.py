"""Approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

_BITS = 60


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    """Random hyperplanes, one for each bit of each tree's hash string."""
    return np.random.default_rng(seed).standard_normal((dim, trees * _BITS))


def hash_strings(vectors: np.ndarray, centre: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """A long hash string for each vector and tree, its first bit the highest of an integer."""
    bits = ((vectors - centre) @ normals > 0).reshape(len(vectors), -1, _BITS)
    return bits @ (1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64))


class Forest:
    """Sorted arrays of the long hash strings of a block of entries, one array for each tree."""

    def __init__(self, strings: np.ndarray):
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def candidates(self, strings: np.ndarray, wanted: int):
        """The places of each query's candidates in the block.

        In every tree a query's longest-prefix matches are one range of the sorted array.  All trees ascend
        together, one bit at a time, until their ranges hold ``wanted`` places in total or everything.
        """
        n, trees = self.sorted.shape
        lo, hi = np.zeros((len(strings), trees), np.int64), np.full((len(strings), trees), n, np.int64)
        left = np.arange(len(strings))
        for bits in range(_BITS, -1, -1):
            if not len(left):
                break
            low = (strings[left] >> (_BITS - bits)) << (_BITS - bits)
            for t in range(trees):
                lo[left, t] = np.searchsorted(self.sorted[:, t], low[:, t], "left")
                hi[left, t] = np.searchsorted(self.sorted[:, t], low[:, t] + (1 << (_BITS - bits)), "left")
            left = left[(hi[left] - lo[left]).sum(axis=1) < wanted]
        for i in range(len(strings)):
            mask = np.zeros(n, bool)
            for t in range(trees):
                mask[self.order[lo[i, t] : hi[i, t], t]] = True
            yield np.flatnonzero(mask)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, trees: int = 32, share: float = 0.9, at_least: int = 1024, block: int = 8192, query_block: int = 8192, fit_rows: int = 10000, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of all rows to each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Nearness is Euclidean distance in doubles on the original vectors, ties to the smaller id.

    1. Equal vectors become one entry with its k + 1 smallest ids, which is all that a result can use.
    2. Each tree hashes a vector, less the mean of a sample of at most fit_rows rows, to a string of
       60 bits (signs of random projections).
    3. Entries are dealt over blocks of about ``block`` rows, queries over blocks of ``query_block``.
       Each pair of blocks is one task's forest: sorted arrays of the strings, one for each tree.
       Queries descend to their longest-prefix matches, and all trees ascend together until their
       ranges hold ``share`` times the block's entries (``at_least`` in any case) in total.
    4. Exact distances of all candidates give each block's k best entries, and those the result.

    The share is what recall asks for: vectors without clusters have no short lists that hold their
    neighbours.  On clustered vectors a far smaller one does.

    Rows with a null id, or with vectors that are null, empty, zero, or hold null or non-finite components, take
    no part; nor do vectors of another length than the commonest in the sample.  Repeated ids with
    different vectors are rows of their own; a query meets every row with an id other than its own.
    """
    spark = vectors.sparkSession
    x = F.col("v")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)
    rows = rows.where(fine)
    sample = rows.select("v").limit(fit_rows).toPandas()["v"]
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = int(sample.map(len).mode()[0])
    centre = np.mean([v for v in sample if len(v) == dim], axis=0)
    rows = rows.where(F.size("v") == dim).withColumn("v", F.transform(x, lambda e: e + F.lit(0.0)))
    keyed = rows.withColumn("h", F.struct(F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")))
    least = keyed.select("h", "vec_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    ids = least.groupBy("h").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = staged(keyed.groupBy("h").agg(F.any_value("v").alias("v")).join(ids, "h").select(F.xxhash64("h").alias("e"), "v", "ids"), "entries")
    queries = staged(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v").distinct(), "queries")
    blocks, query_blocks = max(1, -(-entries.count() // block)), max(1, -(-queries.count() // query_block))
    normals = planes(dim, trees, seed)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            have, want = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            own = left["ids"].to_numpy()
            first = np.array([x[0] for x in own])
            forest = Forest(hash_strings(have, centre, normals))
            found = forest.candidates(hash_strings(want, centre, normals), max(at_least, int(share * len(have))))
            for i, places in enumerate(found):
                d = np.sqrt(((have[places] - want[i]) ** 2).sum(axis=1))
                # an entry may hold the query alone, so one more than k; ties at the edge stay in order of id
                best = np.lexsort((first[places], d))[: k + 1]
                query = int(right["vec_id"].iloc[i])
                out += [(query, int(v), float(d[j])) for j in best.tolist() for v in own[places[j]] if v != query]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    dealt = entries.withColumn("b", F.pmod("e", F.lit(blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    found = dealt.groupBy("b", "qb").cogroup(asked.groupBy("b", "qb")).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    each = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
