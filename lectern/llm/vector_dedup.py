"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits the vectors again and again by a random direction near the
median of what a bounded sample projects on it.  Vectors close to a split go
to both sides (spill).  A node that no tried direction splits with its spill,
as in the midst of many near copies, stays one leaf whatever its size; other
leaves that hold too many get trees of their own.  Vectors of one label are
compared within leaves; links found in any tree count once and
are united.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.components import connected_components
from lectern.llm.scratch import discard, materialize
from lectern.llm.vectors import by_dimension, matrix, smallest, unit, usable
from lectern.llm.workers import map_batches

THRESHOLD = 0.98
TREES = 5
#: Vectors of a label that a leaf should hold; leaves that hold more than BLOCK are compared in blocks.
LEAF = 1000
BLOCK = 4096
#: Splits are fitted on about so many vectors, by a hash of their ids, and on at most so many numbers.
SAMPLE, SAMPLE_NUMBERS = 20_000, 8_000_000
#: Leaves of over so many times ``LEAF`` are split further, by about so many vectors of their own, in at most so many rounds.
REFINE, OWN_SAMPLE, ROUNDS = 4, 2000, 8
#: Half the width of the strip around a split that goes to both sides, and the most of a node that a side may get of it.
SPILL = 0.015
SHRINK = 0.7
#: Directions that a node tries before it stays a leaf.
TRIES = 8
SEED = 6


class Tree:
    """Splits fitted on unit vectors; ``route`` gives the leaves of others."""

    def __init__(self, units: np.ndarray, leaf: int, seed: list[int]):
        self.seed, self.leaf, self.splits, self.leaves = seed, leaf, {}, {}
        self._fit(units, 1)

    def _fit(self, units: np.ndarray, node: int) -> None:
        if len(units) <= self.leaf:
            self.leaves[node] = len(self.leaves)
            return
        rng = np.random.default_rng([*self.seed, node])
        for _ in range(TRIES):
            direction = rng.standard_normal(units.shape[1])
            direction /= np.linalg.norm(direction)
            at = units @ direction
            cut = float(np.quantile(at, rng.uniform(0.45, 0.55)))
            left, right = at <= cut + SPILL, at > cut - SPILL
            if max(left.sum(), right.sum()) <= SHRINK * len(units):
                break
        else:
            self.leaves[node] = len(self.leaves)
            return
        self.splits[node] = (direction, cut)
        self._fit(units[left], 2 * node)
        self._fit(units[right], 2 * node + 1)

    def route(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs; every row is in at least one leaf."""
        rows, leaves = [], []
        todo = [(1, np.arange(len(units)))]
        while todo:
            node, own = todo.pop()
            if node in self.leaves:
                rows.append(own)
                leaves.append(np.full(len(own), self.leaves[node]))
                continue
            direction, cut = self.splits[node]
            at = units[own] @ direction
            todo += [(2 * node, own[at <= cut + SPILL]), (2 * node + 1, own[at > cut - SPILL])]
        return np.concatenate(rows), np.concatenate(leaves)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under links ``a``-``b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _pairs(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at ``threshold`` or more, within ``x`` or between ``x`` and ``y``."""
    other = x if y is None else y
    for at in range(0, len(x), 512):
        cosine = x[at : at + 512] @ other.T
        i, j = np.nonzero(cosine >= threshold - 1e-9)
        c = cosine[i, j]
        i += at
        near = np.abs(c - threshold) < 1e-9
        if near.any():  # exactly on the edge the order of additions decides: one way for all
            c[near] = (x[i[near]] * other[j[near]]).sum(axis=1)
        ok = c >= threshold
        if y is None:
            ok &= i < j
        yield i[ok], j[ok]


def _link_leaf(threshold: float, id_type: pa.DataType):
    """Compare one leaf, or two blocks of it.  Gives id, other (its local root), links."""

    def run(table: pa.Table) -> pa.Table:
        spot, side = table.column("spot")[0].as_py(), table.column("block").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        order = np.argsort(side, kind="stable")
        table = table.take(pa.array(order))
        cut = int((side == lo).sum())
        x, copies = unit(matrix(table.column("v"))), table.column("copies").to_numpy()
        spots = table.column("spots").to_pylist()
        wide = np.full((len(spots), max(map(len, spots))), -1)
        for r, s in enumerate(spots):
            wide[r, : len(s)] = s
        links, root = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        if any((wide == s).any(axis=1).all() for s in wide[0] if 0 <= s < spot):  # all met in one leaf before
            return pa.table({"id": pa.array([], id_type), "other": pa.array([], id_type), "links": pa.array([], pa.int64())})
        for i, j in _pairs(x[:cut], None if lo == hi else x[cut:], threshold):
            j = j if lo == hi else j + cut
            earlier = np.zeros(len(i), dtype=bool)  # met in an earlier leaf: counted there
            for k in range(wide.shape[1]):
                own = wide[i, k]
                mine = (own >= 0) & (own < spot)
                if mine.any():
                    earlier[mine] |= (wide[j[mine]] == own[mine, None]).any(axis=1)
            i, j = i[~earlier], j[~earlier]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            # United as they come: the pairs of a block of near copies are too many to hold.
            root = local_roots(len(x), np.concatenate([np.arange(len(x)), i]), np.concatenate([root, j]))
        own = np.flatnonzero(links)
        ids = table.column("id")
        return pa.table({"id": ids.take(pa.array(own)).cast(id_type), "other": ids.take(pa.array(root[own])).cast(id_type), "links": pa.array(links[own])})

    return run


def _routed(nodes: DataFrame, forest: dict[int, list[Tree]]) -> DataFrame:
    """Adds ``spots``: tree * 2^24 + leaf, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            spots: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                u = unit(matrix(batch.column("v").take(pa.array(rows))))
                for t, tree in enumerate(forest.get(int(dim), ())):
                    for r, leaf in zip(*tree.route(u), strict=True):
                        spots[rows[r]].append((t << 24) + int(leaf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sorted(s) for s in spots], pa.list_(pa.int64()))], names=[*batch.schema.names, "spots"])

    return map_batches(nodes, run, T.StructType([*nodes.schema.fields, T.StructField("spots", T.ArrayType(T.LongType()))]))


def _own_trees(leaves: DataFrame, leaf: int, seed: int) -> DataFrame:
    """``(label, dim, spot, tree)``: splits of each large leaf by a sample of its vectors; an empty tree where none keeps its spill.

    ``leaves`` holds the sampled rows with the number ``n`` of all.
    """
    keys = ["label", "dim", "spot"]

    def fit(table: pa.Table) -> pa.Table:
        units = unit(matrix(table.column("v")))
        spot, n = table.column("spot")[0].as_py(), table.column("n")[0].as_py()
        tree = Tree(units, max(16, int(leaf * len(units) / n)), [seed, units.shape[1], spot % (1 << 63)])
        packed = pickle.dumps(tree) if tree.splits else b""
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "tree": pa.array([packed], pa.binary())})

    schema = T.StructType([*(leaves.schema[k] for k in keys), T.StructField("tree", T.BinaryType())])
    return leaves.select(*keys, "n", "v").groupBy(*keys).applyInArrow(fit, schema)


def _split_further(members: DataFrame) -> DataFrame:
    """``(row, spot)`` of the vectors of leaves that have a tree of their own; spots are hashes of leaf and leaf within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[bytes, Tree] = {}
        for batch in batches:
            row, spot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            packed = batch.column(3).dictionary_encode()
            codes = packed.indices.to_numpy()
            rows, spots = [], []
            trees = {x: trees.get(x) or pickle.loads(x) for x in packed.dictionary.to_pylist()}
            for k, tree in enumerate(trees[x] for x in packed.dictionary.to_pylist()):
                own = np.flatnonzero(codes == k)
                at, leaves = tree.route(unit(matrix(batch.column(2).take(pa.array(own)))))
                rows.append(row[own[at]])
                spots.append(_hash(spot[own[at]], leaves))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows) if rows else [], pa.int64()), pa.array(np.concatenate(spots) if spots else [], pa.int64())], names=["row", "spot"])

    return map_batches(members.select("row", "spot", "v", "tree"), run, "row bigint, spot bigint")


def _hash(spot: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """A number for a leaf within a leaf; where two agree by chance, their vectors are compared together."""
    x = spot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + leaf.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def _refined(routed: DataFrame, leaf: int, seed: int, own_sample: int) -> DataFrame:
    """``routed`` with leaves that hold too many split by trees of their own, round by round.

    The first trees know a bounded sample, so with very many vectors their
    leaves are large.  No split is collected: every leaf's are fitted in a
    task and meet its vectors by a join.
    """
    keys = ["label", "dim", "spot"]
    closed = None
    for _ in range(ROUNDS):
        sent = routed.select("row", "label", "dim", F.explode("spots").alias("spot"))
        large = sent.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > REFINE * leaf)
        if closed is not None:
            large = large.join(closed, keys, "left_anti")
        large = materialize(large, "large")
        if large.isEmpty():
            return routed
        members = sent.join(large, keys).join(routed.select("row", "v"), "row")
        chance = F.pmod(F.xxhash64("row", "spot"), F.lit(1 << 30)) * F.col("n") < F.lit(float(own_sample * (1 << 30)))
        trees = materialize(_own_trees(members.where(chance), leaf, seed), "trees")
        open_ = trees.where("length(tree) > 0")
        ended = large.join(open_.select(*keys), keys, "left_anti").select(*keys)
        closed = materialize(ended if closed is None else closed.unionByName(ended), "closed")
        moved = _split_further(members.join(open_, keys))
        stayed = sent.join(open_.select(*keys), keys, "left_anti").select("row", "spot")
        spots = stayed.unionByName(moved).groupBy("row").agg(F.array_sort(F.collect_set("spot")).alias("spots"))
        before, routed = routed, materialize(routed.drop("spots").join(spots, "row"), "routed")
        discard(before)
        discard(large)
        discard(trees)
    return routed


def vector_groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE, own_sample: int = OWN_SAMPLE, seed: int = SEED) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Only vectors with equal, non-null labels and equal lengths are compared.
    Vectors that are null, empty or zero or hold null or non-finite parts, and
    rows with a null label or id, link with nothing: n_links 0, themselves
    their component, kept.  Equal vectors are one node with a number of copies,
    linked with each other; repeated rows count as copies.  Other columns are
    not read.  An empty table gives no rows.
    """
    spark = df.sparkSession
    every = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(usable(vector_col), F.col(vector_col).cast("array<double>")).alias("v"))
    takes_part = F.expr("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    every = materialize(every, "vectors")
    alike = every.where(takes_part).groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    nodes = materialize(by_dimension(alike, "v").withColumn("row", F.monotonically_increasing_id()), "nodes")

    sizes = {r.dim: r.n for r in nodes.groupBy("dim", "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()}
    forest: dict[int, list[Tree]] = {}
    for dim, most in sizes.items():
        most_sampled = max(1, min(sample, SAMPLE_NUMBERS // max(1, dim)))
        units = unit(matrix(smallest(nodes.where(F.col("dim") == dim), most_sampled, "id", "label").select("id", "label", "v").toArrow().sort_by([("id", "ascending"), ("label", "ascending")]).column("v")))
        # Of the largest label, a leaf with so many sampled vectors holds about `leaf`.
        forest[dim] = [Tree(units, max(16, int(leaf * len(units) / most)), [seed, dim, t]) for t in range(trees)]

    routed = _refined(materialize(_routed(nodes, forest), "routed"), leaf, seed, own_sample)
    sent = routed.select("*", F.explode("spots").alias("spot"))
    counts = routed.select("label", "dim", F.explode("spots").alias("spot")).groupBy("label", "dim", "spot").agg(F.ceil(F.count("*") / block).alias("blocks"))
    # Leaves too large for a task: all pairs of their blocks, a task each.
    dealt = sent.join(materialize(counts, "leaves"), ["label", "dim", "spot"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("against"))
    dealt = dealt.select("label", "dim", "spot", F.least("block", "against").alias("lo"), F.greatest("block", "against").alias("hi"), "block", "id", "copies", "v", "spots")
    id_type = nodes.schema["id"].dataType
    found_type = T.StructType([T.StructField("id", id_type), T.StructField("other", id_type), T.StructField("links", T.LongType())])
    arrow_type = pa.int64() if isinstance(id_type, T.LongType) else pa.int32() if isinstance(id_type, T.IntegerType) else pa.string()
    found = materialize(dealt.groupBy("label", "dim", "spot", "lo", "hi").applyInArrow(_link_leaf(threshold, arrow_type), found_type), "found")

    labels = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    judged = nodes.join(links, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    judged = judged.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = every.where(takes_part).join(judged, ["label", "v"]).select("id", "n_links", "component_id")
    alone = every.where(~takes_part | takes_part.isNull()).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: What the links and components are when every pair is compared.
ORACLE = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
  r(s, t) AS (SELECT a, b FROM l UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.t)
  SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, least(e.vec_id, coalesce((SELECT min(t) FROM r WHERE r.s = e.vec_id), e.vec_id)) AS component_id,
    least(e.vec_id, coalesce((SELECT min(t) FROM r WHERE r.s = e.vec_id), e.vec_id)) = e.vec_id AS kept FROM embeddings e"""
