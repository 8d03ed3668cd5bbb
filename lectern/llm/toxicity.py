"""Toxicity by a bidirectional gated recurrent network, trained and run in numpy.

Texts are lower-cased words.  A word's input is its embedding, how much oftener
toxic documents have it than others (for a training document counted without
its own fold), and the mean of its characters' pair embeddings, so unseen
spellings have an input too.  Windows of ``WINDOW`` words, each overlapping the next by half, run
through a GRU in both directions and are pooled by attention; a document's
score is that of its worst window, and it learns from that window as well
(multiple-instance learning: labels are of documents, not of passages).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.simhash_dedup import simhash
from lectern.llm.workers import give_back, map_batches

WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 16, 16, 16, 16
VOCABULARY, CHAR_PAIRS = 20_000, 4096
#: A word needs so many sampled texts; its class statistics are what a z-score exceeds chance by, scaled and cut, cross-fitted in parts.
LEAST_TEXTS, Z_CHANCE, Z_SCALE, Z_MOST, PARTS = 3, 3.5, 2.0, 3.0, 5
#: The network is fitted on at most so many labelled documents of each class, none longer than so many characters.
SAMPLE, SAMPLE_CHARS = 2500, 50_000
EPOCHS, DOCS_PER_STEP, RATE, EMBEDDING_RATE = 6, 32, 0.01, 0.01
#: Windows that go through the network at a time.
AT_ONCE = 512
#: Few labels are gone through more often: at least so many steps, over at most so many epochs.
LEAST_STEPS, MOST_EPOCHS = 400, 60
#: One sampled text in so many only decides when to stop, after so many epochs without a better loss.
HELD_IN, PATIENCE = 10, 2
#: One document in so many, by the CRC-32 of its id, is held out of all fitting.
FOLDS = 5
SEED = 1
F32 = np.float32


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(words per text, code of each word, distinct words); null is empty."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), r"[^\pL\pN]+", " ")
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(spaced))
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    if len(flat) and pc.any(pc.equal(flat, "")).as_py():  # an empty text splits into one empty word
        owner = np.repeat(np.arange(len(counts)), counts)
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        counts = np.bincount(owner[real], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    return counts, coded.indices.to_numpy(), coded.dictionary.to_pylist()


def char_pairs(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed neighbouring characters (with both ends) of each word, and where each word's begin."""
    marked = [f"<{w}>" for w in distinct]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum([len(w) for w in marked])
    pair = ((points[:-1] * np.uint64(0x9E3779B1) + points[1:]) * np.uint64(0x85EBCA6B) >> np.uint64(13)) % np.uint64(CHAR_PAIRS)
    inner = np.ones(len(pair), dtype=bool)
    inner[ends[:-1] - 1] = False  # pairs across two words
    starts = np.r_[0, ends[:-1]] - np.arange(len(ends))
    return pair[inner].astype(np.int64), starts


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, length) of every window; a text without words has one of length 0."""
    many = np.where(counts <= WINDOW, 1, -(-(counts - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    offset = (np.cumsum(counts) - counts)[owner]
    return owner, offset + nth * STRIDE, np.minimum(WINDOW, counts[owner] - nth * STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _add_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds each of ``values`` to its row; rows may repeat."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    into[rows[starts]] += np.add.reduceat(values[order], starts, axis=0)


class _Sample:
    """The words of sampled texts, split and looked up once for all epochs."""

    def __init__(self, column: pa.Array, vocabulary: dict[str, int]):
        known: dict[str, int] = {}
        counts, codes = [], []
        for at in range(0, len(column), 500):
            n, c, distinct = words(column.slice(at, 500))
            counts.append(n)
            codes.append(np.array([known.setdefault(w, len(known)) for w in distinct], np.int64)[c])
        self.counts, self.codes = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (counts, codes))
        self.starts = np.cumsum(self.counts) - self.counts
        self.ids = np.fromiter((vocabulary.get(w, -1) for w in known), dtype=np.int64, count=len(known))
        self.pairs, self.pair_starts = char_pairs(list(known)) if known else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.pair_sizes = np.diff(np.r_[self.pair_starts, len(self.pairs)])
        del known
        give_back()

    def texts(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words per text, code of each word, the distinct words' numbers)."""
        counts = self.counts[docs]
        at = np.arange(counts.sum()) + np.repeat(self.starts[docs] - (np.cumsum(counts) - counts), counts)
        distinct, codes = np.unique(self.codes[at], return_inverse=True)
        return counts, codes, distinct

    def characters(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = self.pair_sizes[distinct]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.pair_starts[distinct] - starts, sizes)
        return self.pairs[at], starts, sizes.astype(F32)[:, None]


class Network:
    def __init__(self, vocabulary: dict[str, int], prior: float = 0.5, seed: int = SEED):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(F32)
        self.vocabulary, self.prior, self.fitted = vocabulary, prior, False
        dim = WORD_DIM + CHAR_DIM
        self.standing = np.zeros(len(vocabulary) + 1, F32)
        self.word = (rng.standard_normal((len(vocabulary) + 1, WORD_DIM - 1)) * 0.02).astype(F32)
        self.word[-1] = 0  # words outside the vocabulary
        self.char = (rng.standard_normal((CHAR_PAIRS, CHAR_DIM)) * 0.1).astype(F32)
        # Input weights of both directions side by side; each is update, reset, candidate.
        self.dense = {"wx": init(dim, 6 * HIDDEN), "bx": np.zeros(6 * HIDDEN, F32), "uf": init(HIDDEN, 3 * HIDDEN), "ub": init(HIDDEN, 3 * HIDDEN), "wa": init(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, F32), "va": init(ATTENTION), "wo": init(2 * HIDDEN), "bo": np.zeros(1, F32)}

    def inputs(self, distinct: list[str], standing: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in distinct), dtype=np.int64, count=len(distinct))
        pairs, starts = char_pairs(distinct)
        sizes = np.diff(np.r_[starts, len(pairs)]).astype(F32)[:, None]
        known = self.standing if standing is None else standing
        return self._inputs(ids, pairs, starts, sizes, known), ids, (pairs, starts), sizes

    def _inputs(self, ids: np.ndarray, pairs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.concatenate([known[ids, None], self.word[ids], np.add.reduceat(self.char[pairs], starts, axis=0) / sizes], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input part of all gates, with a row of zeros for padding at the end."""
        p = x @ self.dense["wx"] + self.dense["bx"]
        return np.concatenate([p, np.zeros((1, p.shape[1]), F32)])

    def _direction(self, gates: np.ndarray, u: np.ndarray, codes: np.ndarray, mask: np.ndarray, steps: range, trace: list | None) -> np.ndarray:
        """States after each step; ``codes`` and ``mask`` are time by window."""
        h = np.zeros((codes.shape[1], HIDDEN), F32)
        states = np.empty((*codes.shape, HIDDEN), F32)
        for t in steps:
            x, hu = gates[codes[t]], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if not mask[t].all():
                new = np.where(mask[t, :, None], new, h)
            if trace is not None:
                trace.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
            states[t] = h = new
        return states

    def forward(self, gates: np.ndarray, codes: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """One logit per window."""
        d, steps = self.dense, range(len(codes))
        f, b = ([], []) if trace is not None else (None, None)
        states = np.concatenate([self._direction(np.ascontiguousarray(gates[:, : 3 * HIDDEN]), d["uf"], codes, mask, steps, f), self._direction(np.ascontiguousarray(gates[:, 3 * HIDDEN :]), d["ub"], codes, mask, steps[::-1], b)], axis=2)
        felt = np.tanh(states @ d["wa"] + d["ba"])
        weight = np.where(mask, felt @ d["va"], F32(-1e9))
        weight = np.exp(weight - weight.max(axis=0)) * mask
        weight /= np.maximum(weight.sum(axis=0), F32(1e-9))
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if trace is not None:
            trace |= {"f": f, "b": b, "states": states, "felt": felt, "weight": weight, "pooled": pooled}
        return pooled @ d["wo"] + d["bo"]

    def backward(self, grad: np.ndarray, codes: np.ndarray, mask: np.ndarray, trace: dict, rows: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense weights and of the projected inputs, from those of the logits."""
        d, g = self.dense, {}
        states, felt, weight, pooled = (trace[k] for k in ("states", "felt", "weight", "pooled"))
        g["wo"], g["bo"] = pooled.T @ grad, grad.sum(keepdims=True)
        d_pooled = grad[:, None] * d["wo"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", d_score, felt)
        d_felt = d_score[:, :, None] * d["va"] * (1 - felt**2)
        g["wa"], g["ba"] = np.einsum("tnh,tna->ha", states, d_felt), d_felt.sum(axis=(0, 1))
        d_states = weight[:, :, None] * d_pooled + d_felt @ d["wa"].T
        # All steps' gradients, to be summed up by input at the end.
        each = np.zeros((*codes.shape, 6 * HIDDEN), F32)
        for at, (steps, u) in enumerate(((trace["f"], "uf"), (trace["b"], "ub"))):
            dh, du = np.zeros((codes.shape[1], HIDDEN), F32), np.zeros_like(d[u])
            for t, h, z, r, n, hn in reversed(steps):
                dh = dh + d_states[t, :, at * HIDDEN : (at + 1) * HIDDEN]
                on = np.where(mask[t, :, None], dh, 0)
                dn = on * (1 - z) * (1 - n**2)
                dz, dr = on * (h - n) * z * (1 - z), dn * hn * r * (1 - r)
                through = np.concatenate([dz, dr, dn * r], axis=1)
                du += h.T @ through
                each[t, :, at * 3 * HIDDEN : (at + 1) * 3 * HIDDEN] = np.concatenate([dz, dr, dn], axis=1)
                dh = np.where(mask[t, :, None], on * z + through @ d[u].T, dh)
            g[u] = du
        d_gates = np.zeros((rows + 1, 6 * HIDDEN), F32)
        _add_rows(d_gates, codes.ravel(), each.reshape(-1, 6 * HIDDEN))
        return g, d_gates[:rows]

    def logits(self, column: pa.Array, step: int = 2048) -> np.ndarray:
        """The largest window logit of each text."""
        if not self.fitted:
            return np.full(len(column), np.log(self.prior / (1 - self.prior)) if 0 < self.prior < 1 else (np.inf if self.prior else -np.inf))
        return self._logits(column, None, step)

    def _logits(self, column: pa.Array, known: np.ndarray | None, step: int = 2048) -> np.ndarray:
        counts, codes, distinct = words(column)
        gates = self.project(self.inputs(distinct, known)[0]) if distinct else np.zeros((1, 6 * HIDDEN), F32)
        owner, first, length = windows(counts)
        best = np.full(len(counts), -np.inf)
        for at in range(0, len(owner), step):
            own = slice(at, at + step)
            c, m = self._grid(codes, first[own], length[own], len(gates) - 1)
            np.maximum.at(best, owner[own], self.forward(gates, c, m))
        return best

    def _slices(self, windows: np.ndarray, codes: np.ndarray, first: np.ndarray, length: np.ndarray, padding: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for own in np.array_split(windows, -(-len(windows) // AT_ONCE)):
            yield own, *self._grid(codes, first[own], length[own], padding)

    @staticmethod
    def _grid(codes: np.ndarray, first: np.ndarray, length: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
        t = np.arange(max(1, length.max()))[:, None]
        mask = t < length
        if not len(codes):
            return np.full(mask.shape, padding), mask
        return np.where(mask, codes[np.minimum(first + t, len(codes) - 1)], padding), mask

    def fit(self, texts: list[str | None], toxic: list[int], seed: int = SEED) -> Network:
        """Adam on the dense weights, Adagrad on the embeddings, by documents' worst windows.

        One text in ``HELD_IN`` makes no step: when the loss of these has not
        fallen for ``PATIENCE`` epochs, the weights of the best epoch are taken.
        """
        rng = np.random.default_rng(seed)
        column, y = pa.array(texts, pa.string()), np.array(toxic, dtype=F32)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.dense.items()}
        seen = {"word": np.full_like(self.word, 1e-4), "char": np.full_like(self.char, 1e-4)}
        epochs = min(MOST_EPOCHS, max(EPOCHS, -(-LEAST_STEPS * DOCS_PER_STEP // max(1, len(y)))))
        part = rng.permutation(len(y)) % PARTS
        counts_of = self._class_counts(column, y, part, firsts(texts))
        self.standing = standing(counts_of.sum(axis=0))
        without = [standing(counts_of.sum(axis=0) - counts_of[k]) for k in range(PARTS)]
        sample = _Sample(column, self.vocabulary)
        steps, best, kept, since = 0, np.inf, self._weights(), 0
        watched = rng.permutation(len(y)) % HELD_IN == 0
        for epoch in range(epochs):
            batches = [own[at : at + DOCS_PER_STEP] for k in range(PARTS) for own in [rng.permutation(np.flatnonzero((part == k) & ~watched))] for at in range(0, len(own), DOCS_PER_STEP)]
            for b in rng.permutation(len(batches)):
                docs = batches[b]
                counts, codes, distinct = sample.texts(docs)
                if not len(distinct):
                    continue
                ids, (pairs, starts, sizes) = sample.ids[distinct], sample.characters(distinct)
                x = self._inputs(ids, pairs, starts, sizes, without[part[docs[0]]])
                gates = self.project(x)
                owner, first, length = windows(counts)
                # Windows go through in slices, so a step with long texts needs no more memory than another.
                logit = np.concatenate([self.forward(gates, c, m) for _, c, m in self._slices(np.arange(len(owner)), codes, first, length, len(distinct))])
                # The worst windows of each text: a soft choice at first, then nearly the worst alone.
                sharp = F32(1 + EPOCHS * epoch / epochs)
                top = np.full(len(docs), -np.inf, F32)
                np.maximum.at(top, owner, logit)
                share = np.exp(sharp * (logit - top[owner]))
                share /= np.bincount(owner, share, minlength=len(docs))[owner]
                text_logit = np.bincount(owner, share * logit, minlength=len(docs))
                error = (_sigmoid(text_logit) - y[docs]) / len(docs)
                grad = (error[owner] * share).astype(F32)
                used = np.flatnonzero(np.abs(grad) > 1e-6)
                if not len(used):
                    continue
                g, d_gates = {}, np.zeros((len(distinct), 6 * HIDDEN), F32)
                for own, c, m in self._slices(used, codes, first, length, len(distinct)):
                    trace: dict = {}
                    self.forward(gates, c, m, trace)
                    more, d_more = self.backward(grad[own], c, m, trace, len(distinct))
                    g = {k: g[k] + v if k in g else v for k, v in more.items()}
                    d_gates += d_more
                g["wx"], g["bx"] = x.T @ d_gates, d_gates.sum(axis=0)
                dx = d_gates @ self.dense["wx"].T
                steps += 1
                for k, v in g.items():
                    m1, m2 = moments[k]
                    m1 += 0.1 * (v - m1)
                    m2 += 0.001 * (v * v - m2)
                    self.dense[k] -= (RATE * (m1 / (1 - 0.9**steps)) / (np.sqrt(m2 / (1 - 0.999**steps)) + 1e-8)).astype(F32)
                known = ids >= 0
                self._adagrad("word", seen, ids[known], dx[known, 1:WORD_DIM])
                spread = np.repeat(dx[:, WORD_DIM:] / sizes, sizes[:, 0].astype(np.int64), axis=0)
                rows, inverse = np.unique(pairs, return_inverse=True)
                summed = np.zeros((len(rows), CHAR_DIM), F32)
                _add_rows(summed, inverse, spread)
                self._adagrad("char", seen, rows, summed)
            loss = self._loss(column, y, part, watched, without)
            since += 1
            if loss < best:
                best, kept, since = loss, self._weights(), 0
            if since >= PATIENCE:
                break
        self.dense, self.word, self.char = kept
        self.fitted = True
        return self

    def _weights(self) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        return {k: v.copy() for k, v in self.dense.items()}, self.word.copy(), self.char.copy()

    def _loss(self, column: pa.Array, y: np.ndarray, part: np.ndarray, watched: np.ndarray, without: list[np.ndarray]) -> float:
        """Mean log-loss of the watched texts, their words' statistics counted without their part."""
        total = 0.0
        for k in range(PARTS):
            own = np.flatnonzero(watched & (part == k))
            if len(own):
                logit = self._logits(column.take(pa.array(own)), without[k])
                total += float(np.logaddexp(0, np.where(y[own] == 1, -logit, logit)).sum())
        return total / max(1, int(watched.sum()))

    def _class_counts(self, column: pa.Array, y: np.ndarray, part: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Texts that have each word, by part and class, copies once; the last column counts all texts."""
        out = np.zeros((PARTS, 2, len(self.vocabulary) + 1))
        for at in range(0, len(y), 500):
            counts, codes, distinct = words(column.slice(at, 500))
            ids = np.fromiter((self.vocabulary.get(w, -1) for w in distinct), dtype=np.int64, count=len(distinct))
            owner = np.repeat(np.arange(len(counts)), counts) + at
            once = np.unique(owner * max(1, len(distinct)) + codes)
            text, word = once // max(1, len(distinct)), ids[once % max(1, len(distinct))]
            keep = (word >= 0) & first[text]
            text, word = text[keep], word[keep]
            np.add.at(out, (part[text], y[text].astype(int), word), 1)
        np.add.at(out[:, :, -1], (part[first], y[first].astype(int)), 1)
        return out

    def _adagrad(self, name: str, seen: dict[str, np.ndarray], rows: np.ndarray, grad: np.ndarray) -> None:
        seen[name][rows] += grad**2
        getattr(self, name)[rows] -= EMBEDDING_RATE * grad / np.sqrt(seen[name][rows])


def firsts(texts: list[str | None], bits: int = 8) -> np.ndarray:
    """True for texts without an earlier copy or near copy, by their SimHash."""
    prints = np.array([simhash(t) for t in texts], dtype=np.uint64)
    return np.array([not (np.bitwise_count(prints[:i] ^ prints[i]) <= bits).any() for i in range(len(prints))], dtype=bool)


def standing(counts: np.ndarray) -> np.ndarray:
    """How much oftener texts of class 1 have each word: how far the z-score of the difference of shares is from chance; 0 for other words."""
    n0, n1 = np.maximum(counts[:, -1], 1)
    share = counts.sum(axis=0) / (n0 + n1)
    z = (counts[1] / n1 - counts[0] / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n0 + 1 / n1))
    z[-1] = 0
    return np.clip(np.sign(z) * np.maximum(np.abs(z) - Z_CHANCE, 0) / Z_SCALE, -Z_MOST, Z_MOST).astype(F32)


def vocabulary(texts: list[str | None], size: int = VOCABULARY) -> dict[str, int]:
    """The most frequent words of those that at least ``LEAST_TEXTS`` texts have."""
    held: Counter[str] = Counter()
    for at in range(0, len(texts), 500):
        counts, codes, distinct = words(pa.array(texts[at : at + 500], pa.string()))
        owner = np.repeat(np.arange(len(counts)), counts)
        once = np.unique(owner * max(1, len(distinct)) + codes) % max(1, len(distinct))
        for i, n in enumerate(np.bincount(once, minlength=len(distinct))):
            held[distinct[i]] += int(n)
    found = {w: i for i, (w, n) in enumerate(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:size]) if n >= LEAST_TEXTS}
    del held
    give_back()
    return found


def held_out(id_col: str) -> F.Column:
    """True for the fold that no fitting sees; rows without an id are in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, seed: int = SEED) -> Network:
    """Fit on a bounded sample of labelled documents outside the held-out fold.

    At most ``sample`` documents of each class (those with the smallest hashes
    of their ids, from all labels), without those over ``sample_chars``
    characters.  Where a class has none, the network is not fitted and every
    score is the toxic share of the labels.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts = docs.where(F.coalesce(F.length(text_col), F.lit(0)) <= sample_chars).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # The sample is bounded by its parameters, whatever the tables hold.
    rows = texts.join(F.broadcast(picked), "id").select("id", "text", "label").toArrow().sort_by([("id", "ascending"), ("label", "ascending"), ("text", "ascending")])
    label = rows.column("label").to_pylist()
    texts_, prior = rows.column("text").to_pylist(), sum(label) / len(label) if label else 0.0
    if not 0 < prior < 1:
        return Network({}, prior)
    network = Network(vocabulary(texts_), prior, seed).fit(texts_, label, seed)
    del rows, texts_
    give_back()  # the driver has work to do after this
    return network


def score(docs: DataFrame, network: Network, text_col: str = "text", score_col: str = "score", rows_at_once: int = 500) -> DataFrame:
    """``docs`` with the score (0 to 1) of the whole text; a column that has its name already is replaced."""
    docs = docs.drop(score_col)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                column = part.column(part.schema.get_field_index(text_col))
                scores = _sigmoid(network.logits(column))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores.astype(np.float64))], names=[*columns, score_col])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Null and empty texts get the score of a window without words.  Repeated
    rows each give a row with the same score; an empty table gives none.
    Labels other than 0 and 1 teach nothing.  Further columns of either table,
    whatever their names, are not read.
    """
    network = train(docs, labels, id_col, text_col, label_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = _scores(texts, network)
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def _scores(texts: DataFrame, network: Network, rows_at_once: int = 500) -> DataFrame:
    """``(id, score)``: the texts don't travel back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [_sigmoid(network.logits(batch.column(1).slice(at, rows_at_once))) for at in range(0, batch.num_rows, rows_at_once)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores).astype(np.float64) if scores else [], pa.float64())], names=["id", "score"])

    return map_batches(texts, run, T.StructType([texts.schema["id"], T.StructField("score", T.DoubleType())]))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The documents that are not predicted toxic, all columns kept."""
    scored = score(docs, train(docs, labels, id_col, text_col, label_col), text_col, "_toxicity")
    return scored.where("_toxicity < 0.5").select(docs.columns)
