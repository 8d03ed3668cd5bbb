"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by three rounds of random signs and a fast
Hadamard transform and hashes them to the nearest signed axis.  With more rows
a table concatenates several such hashes, so buckets stay small.  Rows go to
their own bucket in every table; a query probes the buckets nearest to it.  How
many hashes and probes, a bounded sample of queries decides: the longest hash
for which few enough probes reach the wanted recall of their true neighbours.
All candidates are ranked by their exact inner product in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.scratch import discard, materialize
from lectern.llm.vectors import by_dimension, matrix, norm, smallest, unit, usable
from lectern.llm.workers import map_batches

SEED = 10
TABLES = 8
#: Rows that a bucket should hold; the hash is as long as that allows.
BUCKET = 256
#: Queries whose true neighbours decide hash length and probes, the share of those to find, and the most probes of a longer hash.
SAMPLE, RECALL, MOST_PROBES = 128, 0.96, 128
#: Rows of a bucket that one task holds at a time; larger buckets are dealt to several.
BLOCK = 4096


@dataclass(frozen=True)
class Hashing:
    """How vectors of one dimension are hashed; ``longest`` is null if all are equally long."""

    dim: int
    tables: int
    length: int
    probes: int
    seed: int
    longest: float | None

    @property
    def width(self) -> int:
        return 1 << max(1, (self.dim + (self.longest is not None) - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotate(points: np.ndarray, width: int, seed: list[int]) -> np.ndarray:
    """One pseudo-rotation; points are padded with zeros to ``width``, a power of two."""
    x = np.zeros((len(points), width))
    x[:, : points.shape[1]] = points
    for signs in np.random.default_rng(seed).integers(0, 2, size=(3, width)) * 2 - 1:
        x = hadamard(x * signs)
    return x


def axes(rotated: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` nearest signed axes of each row, nearest first (2 * axis + 1 if negative), and how much farther than the nearest."""
    width = rotated.shape[1]
    both = np.empty((len(rotated), 2 * width))
    both[:, 0::2], both[:, 1::2] = rotated, -rotated
    count = min(count, 2 * width)
    near = np.argpartition(-both, count - 1, axis=1)[:, :count]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(both, near, axis=1), axis=1, kind="stable"), axis=1)
    value = np.take_along_axis(both, near, axis=1)
    return near, value[:, :1] - value


def points(x: np.ndarray, how: Hashing, query: bool) -> np.ndarray:
    """Unit vectors whose angles order the rows of a query by inner product.

    Rows of different lengths get one more coordinate that makes all as long
    as the longest; a query has 0 there.
    """
    if how.longest is None or query:
        return unit(x)
    x = x / how.longest
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def _combinations(length: int, most: int, width: int) -> Iterator[tuple[int, ...]]:
    """Places of axes in each hash that the ``most`` nearest buckets can have.

    Before a bucket come all those that are nearer in every hash, so the
    product of its places, counted from one, is at most ``most``.
    """
    if not length:
        yield ()
        return
    for i in range(min(most, width)):
        for rest in _combinations(length - 1, most // (i + 1), width):
            yield (i, *rest)


def spots(x: np.ndarray, how: Hashing, query: bool) -> np.ndarray:
    """Bucket numbers of each row: one a table, or for a query ``probes`` a table, nearest first."""
    p, width = points(x, how, query), how.width
    probes = min(how.probes, (2 * width) ** how.length) if query else 1
    combos = np.array(list(_combinations(how.length, probes, 2 * width)))
    out = []
    for table in range(how.tables):
        number, far = np.full((len(p), len(combos)), table, np.int64), np.zeros((len(p), len(combos)))
        for k in range(how.length):
            near, gap = axes(rotate(p, width, [how.seed, table, k, width]), probes)
            number = number * (2 * width) + near[:, combos[:, k]]
            far += gap[:, combos[:, k]] ** 2
        if how.length > 1:
            number = np.take_along_axis(number, np.argsort(far, axis=1, kind="stable")[:, :probes], axis=1)
        out.append(number)
    return np.stack(out, axis=1)


def _hashed(df: DataFrame, hashing: dict[int, Hashing], query: bool) -> DataFrame:
    """Adds ``spots``: the buckets of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            found: list = [None] * batch.num_rows
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                if dim in hashing:
                    numbers = spots(matrix(batch.column("v").take(pa.array(rows))), hashing[dim], query)
                    for r, s in zip(rows, numbers.reshape(len(rows), -1), strict=True):
                        found[r] = s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "spots"])

    return map_batches(df, run, T.StructType([*df.schema.fields, T.StructField("spots", T.ArrayType(T.LongType()))]))


def fitted(rows: DataFrame, asked: DataFrame, k: int, tables: int, seed: int, recall: float, block: int, bucket: int) -> dict[int, Hashing]:
    """The hashing of every dimension, by the true neighbours of at most ``SAMPLE`` queries.

    Their neighbours are found by comparing them with all rows, in blocks.  A
    hash of one part reaches any recall: it can probe all its buckets.
    """
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm("v")).alias("longest"), F.min(norm("v")).alias("shortest")).collect()
    few = materialize(smallest(asked, SAMPLE, "id", "v").select("id", "v", "dim"), "sample")
    spread = materialize(rows.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks")), "blocks")
    all_rows, against = _dealt(rows, few.withColumnRenamed("id", "query_id"), spread, ["dim"])
    truth = _ranked(_compared(against, all_rows, ["dim", "block"], rows.schema["id"].dataType, k), k)
    truth = truth.join(few.select(F.col("id").alias("query_id"), F.col("v").alias("q"), "dim"), "query_id").join(rows.select("id", "v", "dim"), ["id", "dim"]).select("dim", "q", "v").toArrow()
    out = {}
    for s in sizes:
        longest = s.longest if np.isfinite(s.longest) and s.shortest < 0.999 * s.longest else None
        own = truth.filter(pa.array(truth.column("dim").to_numpy() == s.dim))
        base = Hashing(s.dim, tables, 1, 1, seed, longest)
        longer = max(1, round(math.log(max(1.0, s.n / bucket)) / math.log(2 * base.width)))
        q, v = matrix(own.column("q")), matrix(own.column("v"))
        for length in range(longer, 0, -1):
            most = 2 * base.width if length == 1 else MOST_PROBES
            how = Hashing(s.dim, tables, length, most, seed, longest)
            if not own.num_rows:
                out[s.dim] = how
                break
            probed, at = spots(q, how, True), spots(v, how, False)
            met = probed == at
            nth = np.where(met.any(axis=2), met.argmax(axis=2), most).min(axis=1)
            probes = int(np.sort(nth)[min(len(nth) - 1, math.ceil(recall * len(nth)) - 1)]) + 1
            if probes <= most:
                out[s.dim] = Hashing(s.dim, tables, length, probes, seed, longest)
                break
    discard(few)
    discard(spread)
    return out


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, recall: float = RECALL, seed: int = SEED, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """The ``k`` nearest rows of ``corpus`` found for each row of ``queries``.

    Returns query_id, rank (from 1), ``id_col`` and score, the inner product of
    the original vectors in double precision, added up in one fixed way, so
    equal vectors score alike; larger first, ties to the smaller id.  A row is
    no candidate of a query with its own id.  Vectors that are null, empty or
    zero, or hold null or non-finite parts, and rows with a null id take no
    part; vectors of different lengths are never compared.  Repeated rows are
    one candidate; of rows with one id and different vectors the best counts,
    and so for queries.  If the candidates found are fewer than ``k``, the
    query is compared with all rows; queries that find nothing have no rows.
    Empty tables give none; other columns are not read.
    """
    ready = lambda df: by_dimension(df.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")), "v")
    rows = materialize(ready(corpus), "rows")
    asked = materialize(ready(queries), "queries")
    hashing = fitted(rows, asked, k, tables, seed, recall, block, bucket)
    sent = _hashed(rows, hashing, False).select("id", "v", "dim", F.explode("spots").alias("spot"))
    probing = _hashed(asked, hashing, True).select(F.col("id").alias("query_id"), "v", "dim", F.explode("spots").alias("spot"))
    # Buckets are dealt in blocks of about `block` rows: one row per bucket tells how many.
    blocks = _hashed(rows, hashing, False).select("dim", F.explode("spots").alias("spot")).groupBy("dim", "spot").agg(F.ceil(F.count("*") / block).alias("blocks"))
    blocks = materialize(blocks, "blocks")
    sent, probing = _dealt(sent, probing, blocks, ["dim", "spot"])
    id_type = rows.schema["id"].dataType
    found = _compared(probing, sent, ["dim", "spot", "block"], id_type, k)
    best = materialize(_ranked(found, k), "nearest")
    discard(blocks)

    # Queries short of k candidates: exactly, against all rows in blocks.
    short = asked.select(F.col("id").alias("query_id"), "v", "dim").join(best.where(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    if short.isEmpty():
        return best.withColumnRenamed("id", id_col)
    spread = rows.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks"))
    all_rows, against = _dealt(rows, short, materialize(spread, "blocks"), ["dim"])
    rest = _ranked(_compared(against, all_rows, ["dim", "block"], id_type, k), k)
    return best.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(rest).withColumnRenamed("id", id_col)


def _dealt(rows: DataFrame, queries: DataFrame, blocks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each row in one block of its key, each query in all blocks of its key."""
    own = lambda name: blocks.select(*(F.col(k).alias(k) for k in keys), F.col("blocks").alias(name))
    dealt = rows.join(own("of"), keys).withColumn("block", F.pmod(F.xxhash64("id"), "of")).drop("of")
    asked = queries.join(own("upto"), keys).withColumn("block", F.explode(F.expr("sequence(0L, upto - 1)"))).drop("upto")
    return dealt, asked


def _exact(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``i`` of ``x`` and ``j`` of ``y``, each added up alike."""
    step = max(1, 4_000_000 // max(1, x.shape[1]))
    return np.concatenate([(x[i[at : at + step]] * y[j[at : at + step]]).sum(axis=1) for at in range(0, len(i), step)] or [np.empty(0)])


def best_pairs(asked: np.ndarray, y: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best ids of each query row; ids may repeat, a query's own id is none."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    keep = min(k, len(starts))
    # The fast product is off by less than this: rows that near the k-th are judged exactly.
    off = 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(y, axis=1) * np.linalg.norm(x, axis=1).max()
    parts: list[tuple] = []
    for at in range(0, len(y), 512):
        own = slice(at, at + 512)
        scores = y[own] @ x.T
        scores[asked[own, None] == ids[None, :]] = -np.inf
        top = np.maximum.reduceat(scores, starts, axis=1) if len(starts) < len(ids) else scores
        edge = np.partition(top, len(starts) - keep, axis=1)[:, len(starts) - keep]
        i, j = np.nonzero((scores >= (edge - 2 * off[own])[:, None]) & (scores > -np.inf))
        exact = _exact(y[own], i, x, j)
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        if len(starts) < len(ids):  # of one id the best, which comes first
            once = np.sort(np.unique(i * np.int64(len(ids)) + np.searchsorted(starts, j, side="right"), return_index=True)[1])
            i, j, exact = i[once], j[once], exact[once]
        first = np.searchsorted(i, i)
        inside = np.arange(len(i)) - first < k
        parts.append((asked[own][i[inside]], ids[j[inside]], exact[inside]))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _compared(queries: DataFrame, rows: DataFrame, keys: list[str], id_type: T.DataType, k: int) -> DataFrame:
    """The k best (query_id, id, score) of each query in each block."""
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in (q.schema.field("query_id"), r.schema.field("id"))} | {"score": pa.array([], pa.float64())})
        found = best_pairs(q.column("query_id").to_numpy(), matrix(q.column("v")), r.column("id").to_numpy(), matrix(r.column("v")), k)
        return pa.table(dict(zip(("query_id", "id", "score"), found, strict=True)))

    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
