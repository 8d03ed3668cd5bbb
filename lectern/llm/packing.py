"""Best-fit packing of tokenized documents into fixed-length sequences.

The method is large-item matching: pieces above a third of the capacity are
matched greedily, at most two to a sequence, and smaller pieces best-fit the
gaps that remain.  Piece lengths are whole numbers up to the capacity, so the
whole decision depends on one count per length: the driver packs that
histogram (at most ``capacity`` numbers, whatever the corpus holds) into
patterns with multiplicities, and every piece finds its place by its rank
among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.scratch import materialize
from lectern.llm.workers import map_batches

CAPACITY = 1024
END_ID = 2

_encoders: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level BPE vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """tiktoken over the vocabulary of a byte-level BPE file; ids equal the file's own.

    Ranks are the ids, which such files number in merge order.  The file's added
    tokens are split out of texts and get their ids, as ``tokenizers`` does.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"]: x["id"] for x in model.get("added_tokens", ())}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        _encoders[path] = tiktoken.Encoding("from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` ids; only the first may be short."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: every document's ids, cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(encoder(tokenizer).encode, allowed_special="all")
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
            key = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([key, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, run, f"id {source.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_histogram(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns for ``counts[length]`` pieces: ``(((length, times), ...), sequences)``.

    Large lengths (above a third of the capacity) go first, longest first, each
    with the longest large partner that fits.  Small lengths follow, longest
    first, each into the tightest gap that holds it; only when none does, new
    sequences are opened.
    """
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths must be in 1..{capacity}")
    large = sorted(n for n in left if 3 * n > capacity)
    gaps: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    order: list[int] = []

    def put(pattern: tuple[tuple[int, int], ...], times: int, gap: int) -> None:
        if times:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((pattern, times))

    while large:
        n = large[-1]
        at = min(bisect_left(large, capacity - n + 1), len(large)) - 1
        partner = large[at] if at >= 0 else None
        if partner == n and left[n] == 1:
            partner = large[at - 1] if at else None
        if partner is None:
            put(((n, 1),), left[n], capacity - n)
            left[n] = 0
        elif partner == n:
            put(((n, 2),), left[n] // 2, capacity - 2 * n)
            left[n] %= 2
        else:
            times = min(left[n], left[partner])
            put(((n, 1), (partner, 1)), times, capacity - n - partner)
            left[n] -= times
            left[partner] -= times
        large = [x for x in large if left[x]]

    for n in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(order, n)
            if at == len(order):  # nothing holds it: open as many sequences as these pieces need
                each = capacity // n
                put((), -(-todo // each), capacity)
                continue
            gap = order[at]
            pattern, times = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // n
            full = min(times, todo // each)
            put((*pattern, (n, each)), full, gap - each * n)
            todo -= full * each
            rest = times - full
            if rest and 0 < todo < each:  # the last one gets what is left
                put((*pattern, (n, todo)), 1, gap - todo * n)
                todo, rest = 0, rest - 1
            put(pattern, rest, gap)
    return [(pattern, times) for gap in order for pattern, times in gaps[gap] if pattern]


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, last rank, first sequence, times in a sequence, offset)``.

    Ranks of one slot fill its sequences one after another, ``times`` each.
    """
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, many in patterns:
        offset = 0
        for n, times in pattern:
            lo = rank.get(n, 0)
            rank[n] = lo + times * many
            out.append((n, lo, rank[n] - 1, sequence, times, offset))
            offset += n * times
        sequence += many
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds only ``end_id``.  Documents
    longer than ``capacity`` ids are cut into pieces of ``capacity``, the first
    of which may be shorter; no other is cut.  Repeated rows and null ids are
    packed like any others.  An empty table gives no rows.  Further columns of
    ``docs`` are not read.
    """
    spark = docs.sparkSession
    cut_up = tokenized_pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), capacity, end_id)
    pieces = materialize(cut_up.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(slots(pack_histogram(counts, capacity)), "length bigint, lo bigint, hi bigint, first bigint, times bigint, at bigint")

    # Pieces of one length are numbered side by side: as many parts as each has pieces, so neither grows with the corpus alone.
    chunks = 1 + isqrt(max(counts.values(), default=0))
    numbered = pieces.withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.lit(chunks)))
    per_chunk = numbered.groupBy("length", "_chunk").agg(F.count("*").alias("n"))
    before = per_chunk.select("length", "_chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("_chunk")) - F.col("n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("_row")) - 1
    ranked = numbered.withColumn("_within", within).join(before, ["length", "_chunk"]).withColumn("rank", F.col("_within") + F.col("_before"))
    # At most a few slots for each of the capacity's lengths, so the broadcast side is bounded.
    placed = ranked.join(F.broadcast(places), "length").where("rank BETWEEN lo AND hi")
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("times"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + F.col("length") * (nth % F.col("times"))).cast("bigint").alias("offset"),
    )
