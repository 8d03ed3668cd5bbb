"""Fuzzy line deduplication: of lines alike anywhere in the corpus one stays.

Lines are lower-cased with white space squeezed and turned into sets of
character shingles.  One-permutation MinHash signatures (empty bins borrow
from hashed others) are cut into bands; lines that share a band are verified
by the exact Jaccard similarity of their shingle sets; links are united by
distributed union-find.  The first line of a component, by document id and
position, stays.

One pass over the texts writes every line to a file of its task and sends the
lines' bands, packed, to where equal bands meet.  From then on only lines that
met another travel; their texts are fetched from the files that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from lectern.llm.components import connected_components
from lectern.llm.scratch import commit, delete, discard, filesystem, free_shuffles, materialize, new_folder
from lectern.llm.workers import map_batches

SIMILARITY = 0.8
SHINGLE = 6
#: A pair at the threshold shares one of 16 bands of 5 values with probability 0.9983, one at 0.9 with 0.999999.
BANDS, ROWS = 16, 5
#: Members of a band's bucket that a task compares at a time; larger buckets are compared block by block.
BLOCK = 500
#: Cells that shingles are counted in: pairs whose counts rule them out are not compared. A power of two.
CELLS = 256
#: Lines and characters that are compared at a time, unless a block alone holds more.
TOGETHER_ROWS, TOGETHER_CHARS = 4000, 1_000_000
#: Band keys that a task packs at a time; bytes of documents (by Catalyst's estimate) behind one part of the keys; the most parts.
PACK, PART_BYTES, MOST_PARTS = 1_000_000, 2 << 20, 1 << 18
#: Bytes of a band key and of a line's name that travel. Lines with equal names are fetched together and told apart by their text.
KEY_BYTES, NAME_BYTES = 5, 6
EMPTY = np.uint32(0xFFFFFFFF)
#: What a task's file holds of a line besides its document and text.
FILED = [("pos", T.IntegerType()), ("line", T.BinaryType()), ("name", T.LongType()), ("spot", T.LongType())]
MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def normal(line: str) -> str:
    """Lower case, single spaces."""
    low = line.strip().lower()
    if low.isprintable() and "  " not in low:  # printable: the only white space is the space
        return low
    return " ".join(low.split())


def normal_lines(text: str) -> list[str]:
    """``normal`` of every line, tested once for the whole text where that will do."""
    low = text.lower()
    if "  " not in low and low.replace("\n", "").isprintable():
        return [x.strip() for x in low.split("\n")]
    return [normal(x) for x in text.split("\n")]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    """Character shingles of a normal line; a shorter line is one."""
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _windows(body: str, size: int) -> np.ndarray:
    """A number for the characters from every place on: character j times 256 to the j, summed."""
    n = len(body) - size + 1
    try:
        data = body.encode("latin-1") + bytes(8 - size)
    except UnicodeEncodeError:
        points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes = points[:n].copy()
        for j in range(1, size):
            codes += points[j : j + n] << np.uint64(8 * j)
        return codes
    return np.ndarray(n, "<u8", data, strides=(1,)) & np.uint64((1 << 8 * size) - 1)


def signatures(lines: list[str], bins: int = BANDS * ROWS, size: int = SHINGLE) -> np.ndarray:
    """One-permutation MinHash: per line the smallest shingle hash of each bin, none empty."""
    lengths = np.array([max(size, len(x)) for x in lines])
    hashes = _windows("".join(x.ljust(size, "\0") for x in lines), size)
    hashes *= MIX[2]
    hashes ^= hashes >> np.uint64(32)
    hashes *= MIX[0]
    cell = hashes >> np.uint64(32)
    cell *= np.uint64(bins)
    cell >>= np.uint64(32)
    cell = cell.astype(np.int64)
    cell += np.repeat(np.arange(len(lines)) * bins, lengths)[: len(cell)]
    inner = np.cumsum(lengths)[:-1, None] - np.arange(1, size)
    cell[inner.ravel()] = len(lines) * bins  # shingles that run into the next line
    out = np.full(len(lines) * bins + 1, EMPTY)
    np.minimum.at(out, cell, np.minimum(hashes.astype(np.uint32), EMPTY - np.uint32(1)))
    return _filled(out[:-1].reshape(-1, bins))


@cache
def _probe(attempt: int, bins: int) -> np.ndarray:
    """The bin that each bin turns to on its nth attempt."""
    return (mixed(np.arange(bins, dtype=np.uint64) + np.uint64(attempt * 1_000_003)) % np.uint64(bins)).astype(np.int64)


def _filled(signature: np.ndarray) -> np.ndarray:
    """Empty bins take the value of another, tried in an order that depends on the bin alone."""
    row, bin_ = np.nonzero(signature == EMPTY)
    full, attempt = signature.copy(), 0
    while len(row):
        attempt += 1
        value = signature[row, _probe(attempt, signature.shape[1])[bin_]]
        found = value != EMPTY
        full[row[found], bin_[found]] = value[found] + np.uint32(attempt)
        row, bin_ = row[~found], bin_[~found]
    return full


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Keys of each line's bands."""
    values = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), values.shape[:2]).copy()
    for r in range(ROWS):
        keys = mixed(keys * MIX[2] + values[:, :, r])
    return keys


def _packed(keys: np.ndarray, names: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, pairs) of each part: the last bytes of keys and names side by side."""
    part = (keys % np.uint64(parts)).astype(np.uint32)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    pairs = np.empty((len(keys), KEY_BYTES + NAME_BYTES), np.uint8)
    pairs[:, :KEY_BYTES] = (keys >> np.uint64(64 - 8 * KEY_BYTES))[order].view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    pairs[:, KEY_BYTES:] = names[order].view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES]
    own, starts = np.unique(part[order], return_index=True)
    for p, lo, hi in zip(own.tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        yield p, pairs[lo:hi].tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES + NAME_BYTES)
    wide = np.zeros((2, len(pairs), 8), np.uint8)
    wide[0, :, :KEY_BYTES], wide[1, :, :NAME_BYTES] = pairs[:, :KEY_BYTES], pairs[:, KEY_BYTES:]
    keys, names = wide.view(np.int64)[:, :, 0]
    return keys, names


class _Lines:
    """The lines of one batch: columns of its file, and what its distinct lines send."""

    def __init__(self, batch: pa.RecordBatch, spot: int):
        seen: dict[str, int] = {}
        row, pos, which, fresh = [], [], [], []
        for i, text in enumerate(batch.column(2)):
            for k, line in enumerate(normal_lines(text.as_py() or "")):
                if line:
                    fresh.append(line not in seen)
                    which.append(seen.setdefault(line, len(seen)))
                    row.append(i)
                    pos.append(k)
        self.distinct = list(seen)
        names = np.frombuffer(b"".join(xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in self.distinct), np.uint8).reshape(-1, 16)
        wide = np.zeros((len(names), 8), np.uint8)
        wide[:, :NAME_BYTES] = names[:, :NAME_BYTES]
        self.names = wide.view(np.int64)[:, 0]
        code, new = np.array(which, np.int64), np.array(fresh, bool)
        #: Distinct lines, and once more those that occur again.
        self.met = np.concatenate([self.names, self.names[np.flatnonzero(np.bincount(code, minlength=len(names)) > 1)]])
        key = pa.array(row, pa.int64())
        first = pa.array(code, mask=~new)
        columns = [batch.column(0).take(key), batch.column(1).take(key), pa.array(pos, pa.int32()), pa.array([x.tobytes() for x in names], pa.binary()).take(pa.array(code)), pa.array(self.names[code]), pa.array(code + spot, mask=~new), pa.array(self.distinct, pa.string()).take(first)]
        self.table = pa.Table.from_arrays(columns, names=["id", "version", "pos", "line", "name", "spot", "text"])


def _file(folder: str, task: int) -> str:
    return f"{folder}/part-{task:06d}.parquet"


def _scanned(docs: DataFrame, folder: str, parts: int) -> DataFrame:
    """``(part, pairs, again)``: (band key, name) of all lines, and their names alone, packed by part.

    Every task writes its lines to a file of ``folder``: id, version, pos, line
    (128 bits of hash), name (some of them), and where a batch has a line for
    the first time its spot (task and number) and text.  A task that runs again
    writes the same file; it gets its name when complete.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        task = TaskContext.get()
        writer, count = None, 0
        keys: list[np.ndarray] = []
        names: list[np.ndarray] = []
        again: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            sent = dict(_packed(np.concatenate(keys), np.concatenate(names), parts)) if keys else {}
            seen = np.concatenate(again) if again else np.empty(0, np.int64)
            part = mixed(seen.view(np.uint64)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            own, starts = np.unique(part[order], return_index=True)
            alone = dict(zip(own.tolist(), (x.tobytes() for x in np.split(seen[order], starts[1:])), strict=True)) if len(own) else {}
            for held in (keys, names, again):
                held.clear()
            every = sorted(sent.keys() | alone.keys())
            return pa.RecordBatch.from_arrays([pa.array(every, pa.int64()), pa.array([sent.get(p, b"") for p in every], pa.binary()), pa.array([alone.get(p, b"") for p in every], pa.binary())], names=["part", "pairs", "again"])

        path, partial = _file(root, task.partitionId()), f"{root}/_{task.partitionId()}-{task.taskAttemptId()}"
        for batch in batches:
            lines = _Lines(batch, (task.partitionId() << 40) + count)
            if not lines.distinct:
                continue
            writer = writer or pq.ParquetWriter(partial, lines.table.schema, filesystem=fs, compression="zstd", use_dictionary=False, write_statistics=False, store_schema=False)
            writer.write_table(lines.table)
            count += len(lines.distinct)
            # Slices keep the arrays of shingles within a processor's cache.
            for at in range(0, len(lines.distinct), 100):
                found = band_keys(signatures(lines.distinct[at : at + 100]))
                keys.append(found.ravel())
                names.append(np.repeat(lines.names[at : at + 100], BANDS))
            again.append(lines.met)
            if sum(map(len, keys)) >= PACK:
                yield flush()
        if writer:
            writer.close()
            commit(fs, partial, path)
            yield flush()

    return map_batches(docs.select("id", "version", "text"), run, "part bigint, pairs binary, again binary")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(keys)])


class _Buckets:
    """Collects (key, name) pairs of one part and gives the buckets of two names or more.

    Memory holds ``most`` pairs and what arrived last: when more come, keys
    with over ``hold`` lines are passed on as they are and no longer kept.
    """

    def __init__(self, hold: int, most: int):
        self.hold, self.most = hold, most
        self.kept = (np.empty(0, np.int64), np.empty(0, np.int64))
        self.news: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.large = np.empty(0, np.int64)

    def add(self, packed: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.news.append(_unpacked(packed))
        self.waiting += len(self.news[-1][0])
        if self.waiting > self.most:
            yield from self._settle(last=False)
            self.most = max(self.most, 2 * len(self.kept[0]))

    def _settle(self, last: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, names = (np.concatenate(x) for x in zip(self.kept, *self.news, strict=True))
        self.news, self.waiting = [], 0
        order = np.argsort(keys)
        keys, names = keys[order], names[order]
        if last:  # most keys are alone: they need no second order
            starts, size = _runs(keys)
            met = np.repeat(size > 1, size)
            keys, names = keys[met], names[met]
        order = np.lexsort((names, keys))
        keys, names = keys[order], names[order]
        once = np.r_[True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])] if len(keys) else np.empty(0, bool)
        keys, names = keys[once], names[once]
        starts, size = _runs(keys)
        self.large = np.union1d(self.large, keys[starts[size > self.hold]])
        passed = np.isin(keys, self.large)
        if passed.any():
            yield keys[passed], names[passed]
        self.kept = (keys[~passed], names[~passed])

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The rest; buckets of equal members get one name, so lines that share many bands are compared once."""
        yield from self._settle(last=True)
        keys, names = self.kept
        if not len(keys):
            return
        starts, size = _runs(keys)
        bucket = mixed(np.add.reduceat(mixed(names.view(np.uint64)), starts) + size.astype(np.uint64)).view(np.int64)
        keep = np.repeat(size > 1, size)
        yield np.repeat(bucket, size)[keep], names[keep]


class _Seen:
    """Collects names and gives those that come twice or more."""

    def __init__(self, most: int):
        self.most, self.kept, self.news, self.waiting = most, np.empty(0, np.int64), [], 0

    def add(self, packed: bytes) -> None:
        self.news.append(np.frombuffer(packed, np.int64))
        self.waiting += len(self.news[-1])
        if self.waiting > self.most:
            self._settle()
            self.most = max(self.most, 2 * len(self.kept))

    def _settle(self) -> None:
        names = np.sort(np.concatenate([self.kept, *self.news]))
        starts, size = _runs(names)
        self.news, self.waiting, self.kept = [], 0, np.repeat(names[starts], np.minimum(size, 2))

    def close(self) -> np.ndarray:
        self._settle()
        return self.kept[1:][self.kept[1:] == self.kept[:-1]]


def _met(packed: DataFrame, hold: int = 4096, most: int = 2_000_000) -> DataFrame:
    """``(bucket, name)`` of every band key with two names or more, and ``(null, name)`` of names that occur again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, buckets, seen = None, _Buckets(hold, most), _Seen(most)

        def out(bucket: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(names)], names=["bucket", "name"])

        def close() -> Iterator[pa.RecordBatch]:
            for found in buckets.close():
                yield out(*found)
            names = seen.close()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.int64()), pa.array(names)], names=["bucket", "name"])

        for batch in batches:
            for own, pairs, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != part:
                    yield from close()
                    part, buckets, seen = own, _Buckets(hold, most), _Seen(most)
                for found in buckets.add(pairs):
                    yield out(*found)
                seen.add(again)
        yield from close()

    return map_batches(packed.repartition("part").sortWithinPartitions("part").select("part", "pairs", "again"), run, "bucket bigint, name bigint")


def _fetched(requests: DataFrame, folder: str, tasks: int) -> DataFrame:
    """``(line, name, text)`` of the lines at ``spot``, from the files that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        file, groups, spots, texts = None, iter(()), np.empty(0, np.int64), pa.array([], pa.string())

        def read(path: str) -> Iterator[pa.Table]:
            with pq.ParquetFile(path, filesystem=fs) as f:
                for g in range(f.num_row_groups):
                    yield f.read_row_group(g, columns=["spot", "text"])

        for batch in batches:
            asked = batch.column(2).to_numpy()
            at = 0
            while at < len(asked):
                if asked[at] >> 40 != file:
                    file, spots = int(asked[at] >> 40), np.empty(0, np.int64)
                    groups = read(_file(root, file))
                if not len(spots) or spots[-1] < asked[at]:
                    group = next(groups).drop_null()
                    spots, texts = group.column("spot").to_numpy(), group.column("text").combine_chunks()
                    continue
                upto = at + int(np.searchsorted(asked[at:], spots[-1], side="right"))
                found = texts.take(pa.array(np.searchsorted(spots, asked[at:upto])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), batch.column(1).slice(at, upto - at), found], names=["line", "name", "text"])
                at = upto

    dealt = requests.repartition(tasks, F.shiftright("spot", 40)).sortWithinPartitions("spot")
    return map_batches(dealt.select("line", "name", "spot"), run, "line binary, name bigint, text string")


def _numbered(texts: list[str], size: int = SHINGLE) -> np.ndarray:
    """Distinct shingles of up to 65,536 texts as sorted numbers: the text's place, then 48 bits that name the shingle."""
    lengths = np.array([max(size, len(x)) for x in texts])
    body = "".join(x.ljust(size, "\0") for x in texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(48), lengths)
    try:
        body.encode("latin-1")
        codes = _windows(body, size) | owner[: len(body) - size + 1]
        inner = np.ones(len(codes), bool)
        inner[(np.cumsum(lengths)[:-1, None] - np.arange(1, size)).ravel()] = False
        codes = codes[inner]
    except UnicodeEncodeError:  # six characters that need more than six bytes: numbered as they come
        known: dict[str, int] = {}
        each = [[known.setdefault(y, len(known)) for y in shingles(x, size)] for x in texts]
        codes = np.array([y for x in each for y in x], np.uint64) | np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(48), [len(x) for x in each])
    codes.sort()
    return codes[np.r_[True, codes[1:] != codes[:-1]]]


class _Sets:
    """Shingle sets of texts, and the exact Jaccard similarity of many pairs at once."""

    def __init__(self, texts: list[str]):
        codes = _numbered(texts)
        self.codes = codes & np.uint64((1 << 48) - 1)
        self.sizes = np.bincount((codes >> np.uint64(48)).astype(np.int64), minlength=len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        cell = (codes >> np.uint64(48)).astype(np.int64) * CELLS + (self.codes * MIX[2] >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)
        self.cells = np.bincount(cell, minlength=len(texts) * CELLS).astype(np.uint32).reshape(-1, CELLS)

    def _most(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At most so many shingles can be in both: cell by cell the smaller count."""
        step = [slice(at, at + 2048) for at in range(0, len(i), 2048)]
        return np.concatenate([np.minimum(self.cells[i[s]], self.cells[j[s]]).sum(axis=1, dtype=np.int64) for s in step])

    def _of(self, rows: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The shingles of ``rows``, each with its pair's place in the high bits."""
        sizes = self.sizes[rows]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes)
        return self.codes[at] | np.repeat(nth.astype(np.uint64) << np.uint64(48), sizes)

    def alike(self, i: np.ndarray, j: np.ndarray, similarity: float, most: int = 500_000) -> np.ndarray:
        """True for the pairs whose similarity is ``similarity`` or more."""
        x, y = self.sizes[i], self.sizes[j]
        out = np.zeros(len(i), bool)
        todo = np.flatnonzero(np.minimum(x, y) >= similarity * np.maximum(x, y))
        if len(todo):
            most_both = self._most(i[todo], j[todo])
            todo = todo[most_both / (x[todo] + y[todo] - most_both) >= similarity]
        part = np.cumsum(x[todo] + y[todo]) // most
        for own in np.split(todo, np.flatnonzero(np.diff(part)) + 1):
            for k in range(0, len(own), 1 << 16):
                at = own[k : k + (1 << 16)]
                nth = np.arange(len(at))
                merged = np.concatenate([self._of(i[at], nth), self._of(j[at], nth)])
                merged.sort()
                again = merged[1:][merged[1:] == merged[:-1]]
                both = np.bincount((again >> np.uint64(48)).astype(np.int64), minlength=len(at))
                out[at] = both / (x[at] + y[at] - both) >= similarity
        return out


class _LongSets:
    """The same for texts too long to hold all their sets: those of a pair at a time."""

    def __init__(self, texts: list[str]):
        self.texts = texts

    def alike(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        pair = lambda a, b: _Sets([self.texts[a], self.texts[b]]).alike(np.array([0]), np.array([1]), similarity)[0]
        return np.array([pair(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)


class _Group:
    """Lines that lie together: a bucket's block, or two blocks of it."""

    __slots__ = ("block", "labels", "left", "lines", "start", "two", "wide")

    def __init__(self, rows: list[tuple], start: int):
        self.start, self.wide, self.two = start, rows[0][3] > 1, rows[0][1] != rows[0][2]
        self.lines, self.block = [r[6] for r in rows], np.array([r[4] for r in rows])
        known: dict[bytes, int] = {}
        #: Lines with the same known root are connected from the start.
        self.labels = np.array([known.setdefault(r[6] if r[5] is None else r[5], k) for k, r in enumerate(rows)])
        self.left = len(known)

    def open(self, i: int, many: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ``many`` lines from ``i`` on and later ones that they are not connected with; of two blocks, from both."""
        own = np.arange(i, min(i + many, len(self.lines)))[:, None]
        far = (self.labels[own] != self.labels) & (own < np.arange(len(self.lines)))
        if self.two:
            far &= self.block[own] != self.block
        x, y = np.nonzero(far)
        return x + i, y

    def join(self, i: int, j: int) -> bool:
        x, y = self.labels[i], self.labels[j]
        if x != y:
            self.labels[self.labels == max(x, y)] = min(x, y)
            self.left -= 1
        return bool(x != y)


def _united(groups: list[_Group], texts: list[str], similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that connect what is alike in each group.

    The first line of every group is compared with all later ones, then the
    second and so on, more at a time, with those that they are not connected
    with; a group is done when it is one component.
    """
    sets = (_Sets if sum(map(len, texts)) <= 8 * TOGETHER_CHARS else _LongSets)(texts)
    links: list[tuple[bytes, bytes]] = []
    i, many = 0, 1
    todo = [g for g in groups if g.left > 1]
    while todo:
        pairs = [g.open(i, many) for g in todo]
        at, to = (np.concatenate([p[side] + g.start for g, p in zip(todo, pairs, strict=True)]) for side in (0, 1))
        alike = sets.alike(at, to, similarity)
        done = 0
        for g, (x, y) in zip(todo, pairs, strict=True):
            found = alike[done : done + len(x)]
            for a, b in zip(x[found].tolist(), y[found].tolist(), strict=True):
                if g.join(a, b):
                    links.append((g.lines[a], g.lines[b]))
            done += len(x)
        i += many
        many = min(2 * many, 64) if i > 2 else 1
        todo = [g for g in todo if g.left > 1 and i + 1 < len(g.lines)]
    return links


def _verified(rows: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of rows that lie together by (bucket, lo, hi), and the roots of large buckets' blocks.

    The latter have their bucket: ``a`` is a line of it, ``b`` the first line
    that it is connected with there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[_Group] = []
        texts: list[str] = []
        held: list[tuple] = []
        chars = 0

        def close() -> None:
            nonlocal chars
            if len(held) > 1 or held and held[0][3] > 1:
                groups.append(_Group(held, len(texts)))
                texts.extend(r[7] for r in held)
                buckets.extend([held[0][0]] if groups[-1].wide else [None])
                chars += sum(len(r[7]) for r in held)
            held.clear()

        buckets: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal chars
            out = [(None, a, b) for a, b in _united(groups, texts, similarity)] if groups else []
            for bucket, g in zip(buckets, groups, strict=True):
                if g.wide and not g.two:
                    out += [(bucket, line, g.lines[k]) for line, k in zip(g.lines, g.labels.tolist(), strict=True)]
            for x in (groups, texts, buckets):
                x.clear()
            chars = 0
            kinds = (pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(3)], names=["bucket", "a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    close()
                    if len(texts) >= TOGETHER_ROWS or chars >= TOGETHER_CHARS:
                        yield flush()
                held.append(row)
        close()
        yield flush()

    keys = ["bucket", "lo", "hi"]
    together = rows.select(*keys, "blocks", "block", "root", "line", "text").repartition(*keys).sortWithinPartitions(*keys)
    return map_batches(together, run, "bucket bigint, a binary, b binary")


def _blocks(count: str, block: int) -> Column:
    return F.ceil(F.expr(count) / block)


def _own_block(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("line"), "blocks"))


def _crossed(rows: DataFrame) -> DataFrame:
    """Each row once for every other block of its bucket: ``lo < hi``, one of which is its own."""
    against = F.explode(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda b: b != F.col("block")))
    dealt = _own_block(rows).withColumn("against", against)
    return dealt.withColumns({"lo": F.least("block", "against"), "hi": F.greatest("block", "against")}).drop("against")


def _within(rows: DataFrame) -> DataFrame:
    return _own_block(rows).withColumns({"lo": F.col("block"), "hi": F.col("block")})


def _links(buckets: DataFrame, texts: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links ``(a, b)`` that connect what is alike in each bucket, by exact similarity.

    A bucket of up to ``block`` lines is compared at once.  A larger one is
    dealt in blocks, each compared within; then one line of each component of
    a block is compared with the other blocks' (near copies of one line are one
    component after that).  Only buckets that still hold several are compared
    block against block, lines of one component not at all.
    """
    sizes = buckets.groupBy("bucket").agg(_blocks("count(*)", block).alias("blocks"))
    members = buckets.join(sizes, "bucket").join(texts, "name").withColumn("root", F.lit(None).cast("binary"))
    first = materialize(_verified(_within(members), similarity), "found")
    links = lambda found: found.where("bucket IS NULL").select("a", "b")
    large = first.where("bucket IS NOT NULL").select("bucket", F.col("a").alias("line"), F.col("b").alias("own"))
    if large.isEmpty():
        return links(first)

    nothing = F.lit(None).cast("binary")
    centres = large.where("line = own").select("bucket", "line").join(texts.select("line", "text"), "line").withColumn("root", nothing)
    many = centres.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", _blocks("n", block).alias("blocks"))
    centres = centres.join(many, "bucket")
    # Centres that fill one block say by themselves which buckets are one component: those are done.
    second = materialize(_verified(_within(centres).withColumn("blocks", F.col("blocks") + 1).unionByName(_crossed(centres)), similarity), "found")
    joined = second.where("bucket IS NOT NULL").select("bucket", F.col("a").alias("own"), F.col("b").alias("root"))
    apart = joined.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    apart = materialize(apart, "apart")
    both = links(first).unionByName(links(second))
    if apart.isEmpty():
        return both
    members = large.join(apart, "bucket").join(sizes, "bucket").join(joined, ["bucket", "own"]).join(texts.select("line", "text"), "line")
    third = materialize(_verified(_crossed(members), similarity), "found")
    return both.unionByName(links(third))


def similar_lines(met: DataFrame, places: DataFrame, folder: str, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``(line, component)`` for lines that are linked and not the smallest of their component."""
    requests = places.where("near AND spot IS NOT NULL").groupBy("line", "name").agg(F.min("spot").alias("spot"))
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = materialize(_fetched(requests, folder, tasks), "texts")
    delete(places.sparkSession, folder)
    labels = connected_components(_links(met.where("bucket IS NOT NULL"), texts, similarity, block))
    discard(texts)
    return labels.withColumnRenamed("node", "line")


def _parts(docs: DataFrame) -> int:
    """So many that a task can hold a part's band keys, however many lines there are."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, size // PART_BYTES))


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(id, version, drop)``: positions to drop of each document that loses lines."""
    spark = docs.sparkSession
    folder = new_folder(spark, "lines")
    met = materialize(_met(_scanned(docs, folder, _parts(docs))).distinct(), "met")
    free_shuffles(spark)
    schema = T.StructType([docs.schema["id"], docs.schema["version"], *(T.StructField(k, t) for k, t in FILED)])
    # A table of its own, so that a common line's places can be split from both sides of the join.
    needed = materialize(met.groupBy("name").agg(F.max(F.col("bucket").isNotNull()).alias("near")), "needed")
    places = materialize(spark.read.schema(schema).parquet(folder).join(needed, "name"), "places")
    free_shuffles(spark)
    labels = similar_lines(met, places, folder, similarity)
    discard(met)
    discard(needed)
    # The first place of a component in three steps of plain minima: id, then version and position within it.
    each = places.groupBy("line").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    grouped = each.join(labels, "line", "left").select("line", "id", "n", F.coalesce("component", "line").alias("component"))
    grouped = materialize(grouped, "grouped")
    first = grouped.groupBy("component").agg(F.min("id").alias("first_id"), F.sum("n").alias("n")).where("n > 1").drop("n")
    first = materialize(first, "first")  # on its own, as above: a component may hold very many lines
    alike = grouped.select("line", "component").join(first, "component").select("line", "component", "first_id")
    at = places.select("id", "version", "pos", "line").join(alike, "line")
    at = materialize(at.select("id", "version", "pos", "component", F.col("id").eqNullSafe(F.col("first_id")).alias("near")), "alike")
    kept = at.where("near").groupBy("component").agg(F.min(F.struct("version", "pos")).alias("first"))
    # Places in other documents go without being joined, so a common line's many places stay where they are.
    beside = at.where("near").join(kept, "component").where("NOT (version = first.version AND pos = first.pos)")
    again = at.where("NOT near").select("id", "version", "pos").unionByName(beside.select("id", "version", "pos"))
    out = materialize(again.groupBy("id", "version").agg(F.collect_set("pos").alias("drop")), "removed")
    for done in (places, grouped, first, at):
        discard(done)
    free_shuffles(spark)
    return out


def _kept(lines: Column, drop: Column) -> Column:
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, with repeated lines taken out of ``text_col``, and ``n_lines`` and ``n_removed``.

    Columns of ``docs`` that already have one of those two names are replaced.
    A null text stays null and has 0 lines; blank lines are never compared and
    always stay.  The first of alike lines is that of the smallest id (null
    last) and then position.  Rows equal in id and text are one document: all
    of them keep what one keeps.  A document may end up empty; none is dropped.
    An empty table gives no rows.
    """
    version = F.xxhash64(F.col(text_col).cast("string"))
    keyed = docs.select(F.col(id_col).alias("id"), version.alias("version"), F.col(text_col).cast("string").alias("text"))
    gone = removed_lines(keyed, similarity).select(F.col("id").alias("_id"), F.col("version").alias("_version"), F.col("drop").alias("_drop"))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_id")) & (version == F.col("_version")), "left")
    # A column of its own: inside the function that picks lines it would be split again for each of them.
    joined = joined.withColumn("_lines", F.when(F.col("_drop").isNotNull(), F.split(text_col, "\n", -1)))
    text = F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(_kept(F.col("_lines"), F.col("_drop")))
    total = F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    dropped = F.coalesce(F.size("_drop"), F.lit(0))
    counted = joined.withColumns({"n_lines": total, "n_removed": F.greatest(dropped, F.lit(0)).cast("bigint"), text_col: text})
    return counted.drop("_id", "_version", "_drop", "_lines")
