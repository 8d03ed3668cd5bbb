"""Near-duplicates by SimHash, found with meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from lectern.llm.components import connected_components
from lectern.llm.scratch import free_shuffles, materialize
from lectern.llm.workers import map_batches

SEED = 42
#: Fingerprints that a task expands into their balls.
EXPAND = 50_000


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint, unsigned.

    A-Z are lower-cased, words are runs without ASCII white space, shingles
    are ``shingle`` consecutive words joined by a space and count as often as
    they occur.  A shorter text is one shingle; a text without words (or null)
    has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # bounds the unpacked bits of a very long text
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id_col, version, fp)`` for every row; ``fp`` is the fingerprint as a signed long, ``version`` a hash that tells texts apart."""
    key = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["id", "version", "fp"])

    schema = T.StructType([T.StructField("id", key.dataType), T.StructField("version", T.LongType(), False), T.StructField("fp", T.LongType(), False)])
    return map_batches(docs.select(F.col(id_col).alias("id"), _version(text_col).alias("version"), F.col(text_col).cast("string").alias("text")), run, schema).withColumnRenamed("id", id_col)


def _version(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def ball() -> Column:
    """The bits by which the values within one bit differ: -1 for none, and 0 to 63."""
    return F.explode(F.sequence(F.lit(-1), F.lit(63)))


def _flipped(value: str, bit: str) -> Column:
    return F.expr(f"CASE WHEN {bit} < 0 THEN {value} ELSE {value} ^ shiftleft(1L, {bit}) END")


def links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` whose closure is that of all pairs at 2 or fewer differing bits.

    ``distinct`` holds one row per fingerprint ``fp``.  Two fingerprints differ
    in at most two bits exactly if their one-bit balls meet, so each sends its
    65 variants to a shuffle on the variant.  A variant that several sent has
    at most 65 senders, and all of them lie within two bits of each other: a
    star around the smallest stands for all their pairs.  The senders are read
    back from the variant (its own ball), not collected.
    """
    # A row becomes 65: dealt out first, so that no task expands too many.
    spread = distinct.select("fp").repartition(max(1, -(-distinct.count() // EXPAND)))
    sent = spread.select("fp", ball().alias("bit")).select("fp", _flipped("fp", "bit").alias("variant"))
    met = sent.groupBy("variant").agg(F.min("fp").alias("hub"), F.max("fp").alias("last")).where("hub < last")
    met = materialize(met.select("variant", "hub"), "met")
    back = met.select("hub", "variant", ball().alias("bit")).select("hub", _flipped("variant", "bit").alias("fp"))
    # Statistics don't see the expansion of `back`, so the join is told not to broadcast.
    pairs = back.join(distinct.select("fp").hint("merge"), "fp").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return pairs.where("a <> b AND bit_count(a ^ b) <= 2")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: ``id_col``, ``version``, ``fp`` and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most two
    differing bits, the document itself included.  Equal fingerprints are one
    node, so copies cost nothing however many there are.  Null and empty texts
    have fingerprint 0 and link like any other; repeated rows each give a row;
    rows with a null id take part and get the smallest id of the others, or
    null if there is none.  Other columns of ``docs`` are not read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    labels = connected_components(links(nodes))
    free_shuffles(docs.sparkSession)
    rooted = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(id_col, "version", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest id of their group, all columns kept.

    A row without an id can't be told from others, so it stays.  Rows equal in
    id and text stay or go together; of rows with one id and different texts
    each follows the group of its own text.
    """
    groups = simhash_groups(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    gone = groups.where(f"component_id <> `{id_col}`").select(F.col(id_col).alias("_gone"), F.col("version").alias("_version")).distinct()
    return docs.join(gone, (F.col(id_col) == F.col("_gone")) & (_version(text_col) == F.col("_version")), "left_anti")
