"""Corpus operators against brute force, round trips and held-out accuracy, with odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict


import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import ann, html_extract, line_dedup, mixing, packing, queries, secret_scan, simhash_dedup, toxicity, vector_dedup, warc
from lectern.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def odd_docs(spark):
    """Nulls, empties, repeated rows, a very long text, and clashing column names."""
    rows = [(1, "the same words here", "a"), (1, "the same words here", "a"), (2, None, None), (None, "no id at all", "a"), (3, "", "b"), (4, "word " * 30_000, "b"), (5, "  \n\n ", None), (None, None, None)]
    return docs_of(spark, rows).withColumns({c: F.lit("x") for c in ("fp", "n_lines", "score", "size", "id", "row", "label", "version", "component_id", "target")})


def union_find(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    want = union_find({x for p in pairs for x in p}, pairs)
    edges = spark.createDataFrame([*pairs, (None, 3)], "a int, b int")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {n: got.get(n, n) for n in want} == want
    assert connected_components(edges.where("false")).count() == 0


# 1 toxicity


def test_toxicity_learns_held_out_documents(spark):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        if bad := i % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "rotten"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 0, int(bad)))
    labels += [(1, 0, None), (2, 0, 7), (None, 0, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.score_documents(docs_of(spark, rows), table).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_odd_inputs(spark):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score_documents(odd_docs(spark), labels).collect()
    assert len(got) == 8 and all(r.score == 0 for r in got)  # one class only: its share
    kept = toxicity.keep_clean(odd_docs(spark), labels)
    assert kept.columns == odd_docs(spark).columns and kept.count() == 8
    assert toxicity.score_documents(odd_docs(spark).where("false"), labels).count() == 0


def test_windows_cover_every_word_and_overlap():
    owner, first, length = toxicity.windows(np.array([0, 5, toxicity.WINDOW + 1, 100]))
    assert Counter(owner) == {0: 1, 1: 1, 2: 2, 3: 6} and length[0] == 0
    for text, n in ((2, toxicity.WINDOW + 1), (3, 100)):
        base = first[owner == text][0]
        covered = {w for f, k in zip(first[owner == text], length[owner == text], strict=True) for w in range(f - base, f - base + k)}
        assert covered == set(range(n))


def test_network_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network({f"w{i}": i for i in range(8)})
    net.dense = {k: v.astype(np.float64) for k, v in net.dense.items()}
    words = [f"w{i}" for i in range(8)]
    x = net.inputs(words)[0].astype(np.float64)
    codes, mask = rng.integers(0, 8, (5, 3)), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], dtype=bool)
    up = rng.standard_normal(3)
    value = lambda: float(net.forward(net.project(x), codes, mask) @ up)
    trace = {}
    net.forward(net.project(x), codes, mask, trace)
    grads, _ = net.backward(up, codes, mask, trace, 8)
    for name, g in grads.items():
        at = tuple(rng.integers(0, s) for s in net.dense[name].shape)
        net.dense[name][at] += 1e-3
        more = value()
        net.dense[name][at] -= 2e-3
        less = value()
        net.dense[name][at] += 1e-3
        assert g[at] == pytest.approx((more - less) / 2e-3, rel=0.05, abs=2e-3), name


def logit_by_loops(net, words):
    """One window's logit with nothing but scalars."""
    import math

    h_, d = toxicity.HIDDEN, {k: v.tolist() for k, v in net.dense.items()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    inputs = []
    for w in words:
        i = net.vocabulary.get(w, -1)
        marked = f"<{w}>"
        pairs = [((ord(a) * 0x9E3779B1 + ord(b)) * 0x85EBCA6B % 2**64 >> 13) % toxicity.CHAR_PAIRS for a, b in itertools.pairwise(marked)]
        chars = [sum(float(net.char[p][k]) for p in pairs) / len(pairs) for k in range(toxicity.CHAR_DIM)]
        inputs.append([float(net.standing[i]), *map(float, net.word[i]), *chars])

    def run(order, at, u):
        h, out = [0.0] * h_, {}
        for t in order:
            x = [sum(a * d["wx"][j][at + k] for j, a in enumerate(inputs[t])) + d["bx"][at + k] for k in range(3 * h_)]
            hu = [sum(h[j] * d[u][j][k] for j in range(h_)) for k in range(3 * h_)]
            z, r = [sig(x[k] + hu[k]) for k in range(h_)], [sig(x[h_ + k] + hu[h_ + k]) for k in range(h_)]
            n = [math.tanh(x[2 * h_ + k] + r[k] * hu[2 * h_ + k]) for k in range(h_)]
            out[t] = h = [n[k] + z[k] * (h[k] - n[k]) for k in range(h_)]
        return out

    forward, backward = run(range(len(words)), 0, "uf"), run(reversed(range(len(words))), 3 * h_, "ub")
    states = [forward[t] + backward[t] for t in range(len(words))]
    felt = [sum(math.tanh(sum(s[j] * d["wa"][j][k] for j in range(2 * h_)) + d["ba"][k]) * d["va"][k] for k in range(toxicity.ATTENTION)) for s in states]
    weight = [math.exp(f - max(felt)) for f in felt]
    pooled = [sum(w * s[k] for w, s in zip(weight, states, strict=True)) / sum(weight) for k in range(2 * h_)]
    return sum(p * w for p, w in zip(pooled, d["wo"], strict=True)) + d["bo"][0]


def test_scores_match_plain_loops():
    import pyarrow as pa

    rng = random.Random(3)
    known = [f"w{i}" for i in range(30)] + ["naïve", "x2"]
    net = toxicity.Network({w: i for i, w in enumerate(known)})
    net.fitted = True
    net.standing = np.random.default_rng(1).standard_normal(len(known) + 1).astype(np.float32)
    net.word = np.random.default_rng(2).standard_normal(net.word.shape).astype(np.float32)
    texts = [" ".join(rng.choice([*known, "unseen", "Wörter"]) for _ in range(n)) for n in (1, 5, 31, 32, 33, 70)]
    got = net.logits(pa.array(texts, pa.string()))
    for text, logit in zip(texts, got, strict=True):
        split = text.lower().split()
        last = max(0, -(-(len(split) - toxicity.WINDOW) // toxicity.STRIDE))
        parts = [split[i * toxicity.STRIDE : i * toxicity.STRIDE + toxicity.WINDOW] for i in range(last + 1)]
        assert logit == pytest.approx(max(logit_by_loops(net, p) for p in parts), abs=1e-4)


# 2 secrets


def spans_by_python(text):
    found = []
    for order, (kind, pattern) in enumerate((("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))):
        for m in re.finditer(pattern, text or ""):
            if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def test_base_secrets_match_python(spark):
    rng = random.Random(5)
    parts = ['token: "token" : abcdef', "Secret=abc", "password = 'hunter22'", "api_key=" + "f" * 30, "AKIA" + "Z9" * 10, "AKIAshort", "0" * 23, "deadbeef" * 3, "é😀", "\n", " x ", "token=password=longvalue"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12))), "s") for i in range(150)]
    for r in secret_scan.scan_secrets(docs_of(spark, rows)).collect():
        want = spans_by_python(rows[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k + ":") for w in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_weak_candidates_need_their_complement(spark):
    key = "aB3" * 12
    rows = [(1, "user=alice", "s"), (2, "user=alice password=hunter22", "s"), (3, f"blob {key}", "s"), (4, f"AKIA{'X' * 16} blob {key} at https://h.example/x", "s"), (5, "https://h.example password=hunter22", "s"), (6, "user=alice" + " " * 2 * secret_scan.SCOPE + "password=hunter22", "s")]
    kinds = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in secret_scan.scan_secrets(docs_of(spark, rows)).collect()}
    assert kinds == {1: [], 2: ["identifier", "assign"], 3: [], 4: ["access", "key", "endpoint"], 5: ["assign"], 6: ["assign"]}


def test_weak_candidates_that_hold_base_spans_count(spark):
    hexed, key = "0123456789abcdef" * 2, "aB3" * 12
    rows = [(1, f"https://h/x?token=abcdef123 for AKIA{'X' * 16} with {key}", "s"), (2, f"user={hexed} and {key}", "s"), (3, f"user={hexed}", "s")]
    spans = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in secret_scan.scan_secrets(docs_of(spark, rows)).collect()}
    assert spans == {1: ["endpoint", "assign", "access", "key"], 2: ["identifier", "hex", "key"], 3: ["identifier", "hex"]}


def test_secrets_odd_inputs(spark):
    got = secret_scan.scan_secrets(odd_docs(spark)).collect()
    assert len(got) == 8 and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert secret_scan.scan_secrets(odd_docs(spark).where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_corpus_queries_match_sql(name, spark, data):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = queries.QUERIES[name](spark, data)
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, cursor.fetchall()))


# 3 mixing


def targets_by_python(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, share, target = sum(sizes.values()), dict.fromkeys(names), {}
    while share:
        total = sum(weight[s] for s in share)
        over = [s for s in share if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in share}
        for s in over:
            target[s] = 3 * sizes[s]
            share.pop(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


def test_mix_meets_targets_and_agrees_with_itself(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randrange(1, 60)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(1500)] + [(9000, "x " * 900, "c"), (9001, "tiny", "z")]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    sizes, taken, largest, target = Counter(), Counter(), Counter(), {}
    for r in got:
        assert r.size == len(rows[[x[0] for x in rows].index(r.doc_id)][1].split()) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
    want = targets_by_python(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(largest[s] / 2, 60), s
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_meetings_conserve_words_and_are_unbiased(spark):
    leaves, sizes, part = 3000, [1, 2, 3, 5, 8, 13, 21, 34], 0.37
    rows = [("s", leaf, 0, (hash((leaf, i)) % 1000, leaf * 100 + i, size, 0, 1, size * part)) for leaf in range(leaves) for i, size in enumerate(sizes)]
    table = spark.createDataFrame(rows, "source string, leaf int, whole int, member struct<u:bigint,id:bigint,size:bigint,version:bigint,copy:bigint,mass:double>")
    met = table.groupBy("source", "leaf").agg(F.collect_list("member").alias("members")).select("leaf", mixing._meet(20, "bigint").alias("m")).select("leaf", "m.out", "m.rest").collect()
    got = np.zeros((leaves, len(sizes)))
    for r in met:
        assert len(r.out) == len(sizes) - 1 and all(o.extra in (0, 1) for o in r.out) and -1e-9 <= r.rest.mass <= r.rest.size + 1e-9
        for o in r.out:
            got[r.leaf, o.id % 100] = o.extra * o.size
        got[r.leaf, r.rest.id % 100] = r.rest.mass
        assert got[r.leaf].sum() == pytest.approx(part * sum(sizes))  # what one loses another gets
    for i, size in enumerate(sizes):
        off = got[:, i].mean() - part * size
        assert abs(off) < 4.5 * size * 0.5 / leaves**0.5, size


def test_targets_of_many_sources_match(spark):
    rng = random.Random(4)
    sizes = {f"{rng.choice('abc')}{rng.choice(['', 'é', 'zz'])}{i}": rng.randrange(0, 10 ** rng.randrange(1, 6)) for i in range(300)} | {None: 777}
    sized = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    want = targets_by_python(sizes)
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    assert got == {s: pytest.approx(t) for s, t in want.items()}


def test_mix_odd_inputs(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    assert len(got) == 8 and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(odd_docs(spark).where("false")).count() == 0
    assert mixing.mixed_documents(odd_docs(spark)).count() == sum(r.copies for r in got)


# 4 SimHash


def simhash_by_python(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_the_definition():
    for t in ("", None, "One", "a B c", "a\tb\x0bc d\x1ce É", "x y " * 50, "ÀÉ ß ẞ İ k K"):
        assert simhash_dedup.simhash(t) == simhash_by_python(t)


def test_links_reach_all_pairs_within_two_bits(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:40]:
        for _ in range(4):
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                v ^= 1 << b
            values.add(v)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    pairs = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    want = union_find(signed, pairs)
    labels = connected_components(simhash_dedup.links(spark.createDataFrame([(v,) for v in signed], "fp bigint")))
    got = {r.node: r.component for r in labels.collect()}
    assert {v: got.get(v, v) for v in signed} == want


def test_simhash_odd_inputs(spark):
    got = simhash_dedup.simhash_groups(odd_docs(spark)).collect()
    assert len(got) == 8
    assert {r.component_id for r in got if r.fp == 0} == {2}
    kept = simhash_dedup.keep_one(odd_docs(spark))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "4", "None", "None"]
    assert simhash_dedup.simhash_groups(odd_docs(spark).where("false")).count() == 0


def test_one_id_with_two_texts_follows_each_text(spark):
    rows = [(1, "alpha beta gamma delta epsilon", "s"), (2, "alpha beta gamma delta epsilon", "s"), (2, "one two three four five six", "s"), (3, "one two three four five six", "s"), (None, "alpha beta gamma delta epsilon", "s")]
    kept = simhash_dedup.keep_one(docs_of(spark, rows))
    assert sorted((str(r.doc_id), r.text[:3]) for r in kept.collect()) == [("1", "alp"), ("2", "one"), ("None", "alp")]


# 5 HTML

LONG = "Plain sentences with commas, clauses, and enough words to be read as an article by anyone who looks."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        (f"<body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<p>Two<br>lines</article><footer>f</footer></body>", f"T & U\n{LONG}\nTwo lines"),
        (f"<body><div class=menu><a>x</a></div><div id=content><h2>T</h2><p>{LONG}</p><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></div><div class=sidebar><p>{LONG}</p></div></body>", f"T\n{LONG}\n{LONG}"),
        (f"<article><header><h1>Head</h1></header><script>var a='</p>';</script><p>{LONG}</p><form><p>{LONG}</p></form><aside>no</aside></article>", f"Head\n{LONG}"),
        (f"<article><p>{LONG} &lt;b&gt; caf&eacute;&nbsp; x<!-- no --></p><ul><li>one<li>two</ul></article>", f"{LONG} <b> café x\none\ntwo"),
        (f"<div><p>{LONG}</p><p hidden>{LONG}</p><p style='display:none'>no</p></div>", LONG),
    ],
)
def test_main_text(page, text):
    assert html_extract.extract(page) == text


def test_broken_and_deep_html_ends():
    assert html_extract.extract("<div>" * 3000 + LONG) == LONG
    assert html_extract.extract("<script>" + LONG) == ""
    assert html_extract.extract("<" + "a" * 100) == ""
    html_extract.extract("<p <b 'x=\"" * 2000)


PROSE = "Some words that make a paragraph long enough, with commas, and more."


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<p title="the hidden door">FIRST {PROSE}</p>', f"FIRST {PROSE}"),
        (f"<p title=it's>Hello {PROSE}", f"Hello {PROSE}"),
        (f'<a title="x>text</a> {PROSE}', f"text {PROSE}"),
        (f"<main><article><p>A {PROSE}</p></article><article><p>B {PROSE}</p></article></main>", f"A {PROSE}\nB {PROSE}"),
        (f"<body><article class=teaser><p>T {PROSE * 5}</p></article><div class=content><p>C {PROSE}</p><p>{PROSE}</p></div>", f"C {PROSE}\n{PROSE}"),
        (f'<article><p>A {PROSE}</p><section class="article-notice"><p>N {PROSE}</p></section><p class="share-price">P {PROSE}</p><section id="comments-policy"><p>Q {PROSE}</p></section></article>', f"A {PROSE}\nP {PROSE}\nQ {PROSE}"),
        (f'<article><h2 class="section-header">H</h2><p class="side">{PROSE}</p><table><tr><td class=header>c<td>d</table><ul><li class="menu-item">e</ul></article>', f"H\n{PROSE}\nc\nd\ne"),
        (f"<article><p>x {PROSE}<![CDATA[zzz]]> y</p></article>", f"x {PROSE} y"),
        (f"<article><h1>T</h1><div><p>one {PROSE}</p><p>two {PROSE}</p></div><p>short.</p><nav>n</nav>tail <b>bold</b></article>", f"T\none {PROSE}\ntwo {PROSE}\nshort.\ntail bold"),
        (f"<article><p>a <math><mi>x</mi></math> <object>fb</object> b {PROSE}</p></article>", f"a x fb b {PROSE}"),
        (f'<div class="has-sidebar"><div class="post"><p>{PROSE}</p></div><div class="sidebar-2"><p>S {PROSE}</p></div></div>', PROSE),
        (f'<div id=comments><article class="comment"><p>C {PROSE * 9}</p></article></div><article><p>{PROSE}</p></article>', PROSE),
        ("<article><p>Sh is.</p></article><div>x</div>", "Sh is."),
        (f'<article><p class="notice">N {PROSE}</p><p class="cookie-notice">C {PROSE}</p><h3 class="comments">Comments</h3><p class="notice-board">{PROSE}</p></article>', PROSE),
        (f"<head><title>t</title><p>{PROSE}<svg><title>s</title><text>t</text></svg><template><p>no</template>", PROSE),
    ],
)
def test_main_text_of_hard_pages(page, text):
    assert html_extract.extract(page) == text


def made_page(rng):
    """A page and its main text, both from one description."""
    word = lambda: rng.choice(["stone", "ha", "l&eacute;ger", "x&lt;y", "Ort", "and,"]) + rng.choice(["", "", ","])
    plain = {"l&eacute;ger": "léger", "x&lt;y": "x<y"}
    want = []

    def prose(n):
        words = [word() for _ in range(n)]
        text = " ".join(words)
        for k, v in plain.items():
            text = text.replace(k, v)
        marked = [f"<{t}>{w}</{t}>" if (t := rng.choice(["b", "i", "", "", "a href='#'"])) and " " not in t else w for w in words]
        return rng.choice([" ", "\n  ", "<!-- x -->\t"]).join(marked), text

    def block():
        kind = rng.randrange(6)
        if kind < 3:
            html, text = prose(rng.randrange(8, 60))
            want.append(text)
            return f"<p>{html}" + rng.choice(["</p>", "", "</p>\n"])
        if kind == 3:
            items = [prose(rng.randrange(2, 9)) for _ in range(rng.randrange(1, 4))]
            want.extend(t for _, t in items)
            return "<ul>" + "".join(f"<li>{h}" for h, _ in items) + "</ul>"
        if kind == 4:
            html, text = prose(4)
            want.append(text)
            return f"<h2>{html}</h2>"
        return rng.choice(["<aside><p>aside, aside, aside, aside, aside, aside</p></aside>", "<div class='related-posts'><p>more, more, more, more, more</p></div>", "<script>var x = '<p>no</p>';</script>", "<section class='comments'><p>I, for one, agree, and so, and on.</p></section>", "<form><p>name, street, town, country, phone</p></form>"])

    head, title = prose(5)
    want.append(title)
    body = "".join(block() for _ in range(rng.randrange(4, 12)))
    html, text = prose(50)
    want.append(text)
    page = f"<html><body><header><p>Site, of sites, of all sites, welcome</p></header><nav><ul><li><a href=/>home</a></ul></nav><div class='cookie-banner'>We, like all, use cookies, biscuits, and such</div><article><h1>{head}</h1>{body}<p>{html}</p></article><div id='sidebar'><p>left, right, left, right, left, right</p></div><footer>all rights, reserved, of course</footer>"
    return page, "\n".join(want)


def test_made_pages_give_back_their_text():
    rng = random.Random(8)
    for _ in range(300):
        page, text = made_page(rng)
        assert html_extract.extract(page) == text


def test_broken_pages_take_time_in_proportion():
    import time

    n = 20_000
    for page in ("<div>" * n + "</p>" * n, "<div>" * n + "</span>" * n, "<b>" * n + "<p>" * n, "<header>" * n, "<!--" * n, "<a href='" * n, "<table><tr><td>" * n + "</div>" * n, '<a b="c>' * n, "<script>" * n, "<noscript>" * n):
        began = time.perf_counter()
        html_extract.extract(page + PROSE)
        assert time.perf_counter() - began < 3, page[:20]


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, f"<p>{LONG}", "x"), (2, None, f"<p>{LONG}", "x")], "page_id int, url string, html string, text string")
    got = html_extract.extract_pages(pages, "html", "page_id", "url").collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "", 0), (2, LONG, len(LONG)), (2, LONG, len(LONG))]


# 6 vectors


def vector_rows(seed=4):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((400, 16))
    near = base[:120] + 0.06 * rng.standard_normal((120, 16))
    hub = base[0] + 0.05 * rng.standard_normal((80, 16))
    x = np.concatenate([base, near, hub, base[:30] * 2, base[5:6], base[5:6]])
    return [(i, [float(v) for v in row], int(i % 2) if i < 400 else int((i - 400) % 2)) for i, row in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("leaf, block", [(1000, 4096), (40, 16)])
def test_vector_links_match_brute_force(spark, leaf, block):
    rows = vector_rows()
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    c = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    label = np.array([r[2] for r in rows])
    linked = (c >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    want = union_find(range(len(x)), zip(*np.nonzero(linked), strict=True))
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [1.0] * 3, 1), (9005, [1.0] * 16, None), (9006, [], 1), (9007, [None] * 16, 1)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r for r in vector_dedup.vector_groups(table, leaf=leaf, block=block).collect()}
    assert len(got) == len(rows) + len(odd)
    n_links = np.array([got[i].n_links for i in range(len(x))])
    assert n_links.sum() >= 0.99 * linked.sum() and (n_links <= linked.sum(axis=1)).all()
    assert np.mean([got[i].component_id == want[i] for i in range(len(x))]) > 0.99
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i, *_ in odd)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert vector_dedup.vector_groups(table.where("false")).count() == 0


def test_large_groups_of_near_vectors_keep_their_links(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 64))
    x[:2000] = x[0] / np.linalg.norm(x[0]) + 0.12 * rng.standard_normal((2000, 64)) / 8
    x = x[rng.permutation(6000)].astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(axis=1) - 1
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in vector_dedup.vector_groups(table, leaf=250, block=1000).collect()}
    n_links = np.array([got[i] for i in range(6000)])
    assert want.sum() > 3_000_000 and n_links.sum() >= 0.999 * want.sum() and (n_links <= want).all()
    assert len(vector_dedup.Tree(u, 250, [1]).leaves) > 4


def test_large_leaves_get_trees_of_their_own(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((6000, 24))
    x[3000:4500] = x[:1500] + 0.08 * rng.standard_normal((1500, 24))
    x[4500:5000] = x[0] + 0.06 * rng.standard_normal((500, 24))
    x = x[rng.permutation(6000)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = (np.arange(6000) % 10 == 0).astype(int)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(6000, dtype=bool)
    table = spark.createDataFrame([(i, v, k) for (i, v), k in zip(enumerate(x.tolist()), label.tolist(), strict=True)], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_dedup.vector_groups(table, leaf=60, sample=40, own_sample=500).collect()}
    n_links = np.array([got[i].n_links for i in range(6000)])
    assert len(got) == 6000 and n_links.sum() >= 0.99 * near.sum() and (n_links <= near.sum(axis=1)).all()

    nodes = spark.createDataFrame([(i, 0, 24, v) for i, v in enumerate(x[:3000].tolist())], "row bigint, label int, dim int, v array<double>")
    refined = vector_dedup._refined(nodes.withColumn("spots", F.array(F.lit(7).cast("bigint"))), 60, 1, 500)
    sizes = refined.select("row", F.explode("spots").alias("s")).groupBy("s").count()
    assert refined.count() == 3000 and sizes.count() > 10 and sizes.agg(F.max("count")).first()[0] < 1000


# 7 lines


def kept_by_brute_force(rows):
    lines = [(i, k, line_dedup.normal(x)) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    texts = sorted({x[2] for x in lines})
    sets = {t: line_dedup.shingles(t) for t in texts}
    comp = union_find(texts, ((a, b) for a, b in itertools.combinations(texts, 2) if line_dedup.jaccard(sets[a], sets[b]) >= line_dedup.SIMILARITY))
    first = {}
    for i, k, t in sorted(lines):
        first.setdefault(comp[t], (i, k))
    dropped = {(i, k) for i, k, t in lines if first[comp[t]] != (i, k)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in dropped) for i, t in rows}


@pytest.mark.parametrize("block", [500, 3])
def test_lines_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(line_dedup.similar_lines, "__defaults__", (line_dedup.SIMILARITY, block))
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    stock = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(60)]

    def line():
        words = rng.choice(stock).split()
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words) if rng.random() < 0.8 else "  " + " ".join(words).upper()

    rows = [(i, "\n".join(line() if rng.random() < 0.9 else "" for _ in range(rng.randrange(0, 8)))) for i in range(80)] + [(900, None), (901, ""), (902, "\n\n")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()}
    want = kept_by_brute_force(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_lines - r.n_removed == len(want[i].split("\n")) for i, r in got.items() if want[i] and not r.n_removed)


def test_lines_odd_inputs(spark):
    got = line_dedup.dedup_lines(odd_docs(spark)).collect()
    assert len(got) == 8 and all(isinstance(r.n_lines, int) for r in got)
    assert [r.text for r in got if r.doc_id == 1] == ["the same words here"] * 2
    assert line_dedup.dedup_lines(odd_docs(spark).where("false")).count() == 0


def test_signatures_of_short_lines_are_full():
    s = line_dedup.signatures(["a", "ab", "abc def", "x" * 500])
    assert (s != line_dedup.EMPTY).all() and len(np.unique(line_dedup.band_keys(s))) == 4 * line_dedup.BANDS


def test_lines_at_the_threshold_share_a_band():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    pairs = []
    while len(pairs) < 3000:
        a = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 40))]
        b = list(a)
        for _ in range(rng.randrange(1, max(2, len(a) // 8))):
            b[rng.randrange(len(b))] = rng.choice(vocabulary)
        x, y = " ".join(a), " ".join(b)
        if 0.8 <= line_dedup.jaccard(line_dedup.shingles(x), line_dedup.shingles(y)) < 0.82:
            pairs.append((x, y))
    left, right = (line_dedup.band_keys(line_dedup.signatures([p[i] for p in pairs])) for i in (0, 1))
    assert (left == right).any(axis=1).mean() > 0.997


# 8 WARC


def test_archives_round_trip(spark, tmp_path):
    big = "é<p>" * 400
    rows = [(1, "http://a\r\nb", big, "x"), (7, "u7", big, "x"), (3, None, big, "x"), (None, "n", big, "x"), (2, "s", "small", "x"), (4, "s2", "small", "x"), (5, "e", None, "x"), (7, "u7", big, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, row string")
    folder = f"file://{tmp_path}/warc"
    got = warc.archive_and_read(pages, folder=folder).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter({(1, "revisit", 7): 1, (3, "revisit", 7): 1, (None, "revisit", 7): 1, (7, "response", None): 1, (7, "revisit", 7): 1, (2, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1})
    assert {r.payload_digest for r in got if r.payload_bytes == len(big.encode())} == {hashlib.sha1(big.encode()).hexdigest()}
    assert warc.archive_and_read(pages.where("false")).count() == 0


def test_archives_keep_string_ids_and_name_records_once(spark, tmp_path):
    ids = ["a", " a ", "a\r\nb: c", "100%", "%20", "é\t", "", None]
    pages = spark.createDataFrame([(i, f"http://x/{i}", "page") for i in ids], "page_id string, url string, html string")
    got = warc.archive_and_read(pages, folder=f"file://{tmp_path}/a").collect()
    assert Counter(r.page_id for r in got) == Counter(ids)
    records = [r.record_id for folder in "ab" for r in warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/{folder}")).collect()]
    assert len(set(records)) == 2 * len(ids)


def test_archives_lead_with_their_dictionary(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    files = [r.path for r in warc.write_archives(pages, f"file://{tmp_path}/w").collect()]
    for f in files:
        head = open(f.removeprefix("file://"), "rb").read(12)
        assert int.from_bytes(head[:4], "little") == warc.SKIPPABLE and int.from_bytes(head[8:12], "little") == 0xEC30A437
    with open(files[0].removeprefix("file://"), "rb") as f:
        fields = [warc.parse_record(r)[0]["WARC-Type"] for r in warc.read_records(f)]
    assert fields[0] == "warcinfo" and set(fields[1:]) <= {"response", "revisit"}
    with pytest.raises(ValueError):
        warc.parse_record(b"HTTP/1.1 200 OK\r\n\r\n")


# 9 packing


def check_packing(counts, capacity):
    patterns = packing.pack_histogram(counts, capacity)
    used = Counter()
    for pattern, times in patterns:
        assert sum(n * k for n, k in pattern) <= capacity and sum(k for n, k in pattern if 3 * n > capacity) <= 2
        for n, k in pattern:
            used[n] += k * times
    assert used == Counter({n: c for n, c in counts.items() if c})
    return sum(times for _, times in patterns)


def test_histogram_packing_is_complete_and_tight():
    rng = random.Random(9)
    assert packing.pack_histogram({}, 10) == []
    assert check_packing({10: 3, 5: 2, 6: 1, 4: 1}, 10) == 5
    assert check_packing({1: 25}, 10) == 3
    for _ in range(40):
        counts = Counter(rng.randrange(1, 101) for _ in range(rng.randrange(1, 800)))
        bins, words = check_packing(counts, 100), sum(n * c for n, c in counts.items())
        large = sum(c for n, c in counts.items() if n > 50)
        assert bins <= max(words / 100, large) * 1.12 + 2
    with pytest.raises(ValueError):
        packing.pack_histogram({11: 1}, 10)


def test_pieces_match_the_tokenizer_and_fill_sequences(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    docs = spark.read.parquet(f"{data}/documents.parquet").unionByName(docs_of(spark, [(9001, None, "s"), (9002, "", "s"), (9003, "<|endoftext|> é😀\t\n x" * 900, "s"), (9001, None, "s")]))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = packing.pack_documents(docs).collect()
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in texts.items()}
    by_sequence = defaultdict(list)
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, dtype="<u4").tobytes()) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0 and (r.length == len(ids[r.doc_id]) or len(ids[r.doc_id]) > 1024)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, ids.values())) + 1
    assert sum(r.length for r in got) == total and len(by_sequence) <= total / 1024 * 1.05 + 2
    assert packing.pack_documents(docs.where("false")).count() == 0
    assert packing.pack_documents(odd_docs(spark)).count() >= 8


def test_pieces_hold_the_ids_of_added_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n\n é", "<|endoftext |> <|endoftext|", " <|endoftext|>'s 12 😀" * 300]
    got = packing.pack_documents(docs_of(spark, [(i, x, "s") for i, x in enumerate(texts)])).collect()
    ids = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert ids[0] == [31373, 220, 50256, 2124, 2]
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, dtype="<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, ids))


# 10 nearest neighbours


def test_rotations_keep_lengths_and_axes_are_nearest():
    x = np.random.default_rng(0).standard_normal((20, 12))
    r = ann.rotate(x, 16, [3])
    assert np.allclose(np.linalg.norm(r, axis=1), np.linalg.norm(x, axis=1))
    best, gap = ann.axes(r, 1)
    assert all(abs(r[i, b // 2]) == np.abs(r[i]).max() and (r[i, b // 2] < 0) == b % 2 for i, b in enumerate(best[:, 0])) and not gap.any()
    five, gaps = ann.axes(r, 5)
    assert (five[:, 0] == best[:, 0]).all() and (np.diff(gaps, axis=1) >= 0).all()


def test_probes_of_long_hashes_are_the_nearest_buckets():
    x = np.random.default_rng(2).standard_normal((6, 5))
    how = ann.Hashing(5, 2, 2, 30, 7, None)
    width, probed = how.width, ann.spots(x, how, True)
    assert probed.shape == (6, 2, 30) and (probed[:, :, 0] == ann.spots(x, how, False)[:, :, 0]).all()
    for i, table in itertools.product(range(6), range(2)):
        far = []
        for k in range(2):
            r = ann.rotate(ann.points(x[i : i + 1], how, True), width, [7, table, k, width])[0]
            value = np.stack([r, -r], axis=1).ravel()
            far.append((value.max() - value) ** 2)
        total = {(table * 2 * width + a) * 2 * width + b: far[0][a] + far[1][b] for a in range(2 * width) for b in range(2 * width)}
        assert np.allclose([total[n] for n in probed[i, table].tolist()], sorted(total.values())[:30])
    assert set(ann._combinations(3, 5, 4)) == {c for c in itertools.product(range(4), repeat=3) if (c[0] + 1) * (c[1] + 1) * (c[2] + 1) <= 5}


def test_equal_vectors_tie_to_smaller_ids_in_every_block(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 19))
    x = np.concatenate([base[rng.integers(0, 40, 560)], rng.standard_normal((40, 19))])
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(5, x[9].tolist()), (7, x[7].tolist())], "vec_id bigint, embedding array<double>")
    rows = [(i, v) for i, v in enumerate(x)] + [(5, x[9])]
    got = defaultdict(list)
    for r in ann.nearest(table, table.where("vec_id % 20 = 0"), 20, block=37, recall=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float((x[q] * v).sum()))
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and all(best[i] == score for i, score in found)
        hits += len(set(found) & set(want[:20]))
    assert len(got) == 30 and hits >= 0.95 * 600


def test_lengths_decide_as_well_as_directions(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 24))
    x *= np.exp(rng.standard_normal((1500, 1)) * 0.8) / np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>")
    got = ann.nearest(table, table.where("vec_id % 20 = 0"), 20).collect()
    scores = x @ x.T - np.diag([np.inf] * 1500)
    truth = {q: set(np.argsort(-scores[q])[:20].tolist()) for q in range(0, 1500, 20)}
    assert sum(r.vec_id in truth[r.query_id] for r in got) >= 0.9 * 20 * len(truth)


def test_hashes_grow_with_clustered_rows(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((300, 16)), 20, axis=0) + 0.1 * rng.standard_normal((6000, 16))
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>")
    asked = table.where("vec_id % 20 = 0")
    ready = lambda df: df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.size("embedding").alias("dim"))
    how = ann.fitted(ready(table), ready(asked), 10, 8, 1, 0.95, 4096, 8)[16]
    assert how.length == 2 and how.probes <= ann.MOST_PROBES
    got = ann.nearest(table, asked, 10, bucket=8).collect()
    scores = x @ x.T - np.diag([np.inf] * 6000)
    truth = {q: set(np.argsort(-scores[q])[:10].tolist()) for q in range(0, 6000, 20)}
    assert sum(r.vec_id in truth[r.query_id] for r in got) >= 0.9 * 10 * len(truth)


@pytest.mark.parametrize("block", [4096, 50])
def test_neighbours_reach_recall(spark, block):
    x = np.random.default_rng(1).standard_normal((1500, 32))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(7000, None), (7020, [0.0] * 32), (7040, [float("inf")] * 32), (None, [1.0] * 32), (7060, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(table, table.where("vec_id % 20 = 0"), 20, block=block).collect()
    by_query = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query[r.query_id].append((r.vec_id, r.score))
    assert set(by_query) == set(range(0, 1500, 20))
    hits = 0
    for q, found in by_query.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        assert len(found) == 20 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(s == pytest.approx(scores[i], abs=1e-12) for i, s in found)
        hits += len({i for i, _ in found} & set(np.argsort(-scores)[:20]))
    assert hits / (20 * len(by_query)) >= 0.9


def test_few_candidates_are_all_found(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = ann.nearest(table, table.where("vec_id % 20 = 0"), 20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 3), (0, 2, 4), (0, 3, 20), (20, 1, 3), (20, 2, 4), (20, 3, 0)]
    assert ann.nearest(table.where("false"), table, 5).count() == 0


# long texts and the pipeline


def test_batches_of_long_texts_pass_whole(spark):
    """Hundreds of megabytes in one partition: batches are bounded by bytes as well as by rows."""
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("lorem ipsum dolor "), 70_000)).alias("text"), F.lit("s").alias("source"))
    got = simhash_dedup.fingerprints(docs)
    assert got.count() == 300 and got.select("fp").distinct().count() == 1


def test_very_long_texts_are_read_to_their_end(spark):
    filler = "plain words of no harm, line by line " * 60_000
    rows = [(1, filler + "\nthe very last line of this long document\n", "s"), (2, "the very last line of this long document", "s"), (3, filler + " token=abcdef123", "s"), (4, None, "s")]
    docs = docs_of(spark, rows)
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert kept[2] == "" and kept[1].split("\n")[1] == rows[1][1] and kept[4] is None
    spans = {r.doc_id: r.spans for r in secret_scan.scan_secrets(docs).collect()}
    assert spans[3] == f"assign:{len(filler) + 1}:{len(filler) + 16}" and spans[1] == ""
    taken = {r.doc_id: r.size for r in mixing.mix(docs).collect()}
    assert taken[3] == len(rows[2][1].split()) and taken[4] == 0


@pytest.mark.parametrize("rows", [[], [(1, None, None), (None, "", "s"), (2, "same words in a row " * 9, "s"), (2, "same words in a row " * 9, "s"), (3, "same words in a row " * 9, "t")]])
def test_pipeline_takes_odd_and_empty_tables(spark, tmp_path, rows):
    import corpus_pipeline

    docs = docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("fp", "version", "score", "n_lines", "copies", "id")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Of the copies one row's text stays; the mix takes empty texts as often as others of their source, and nothing of a source without words.
    assert {r.doc_id for r in got} == ({2, None} if rows else set())



def test_pipeline_stages_do_their_work(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = [r.asDict() for r in stage(spark, out[-1], data).collect()]
        out.append(spark.createDataFrame(rows, docs.schema))
        assert out[-1].columns == docs.columns
    clean, shorter, single, mixed = (df.collect() for df in out[1:])
    texts = {r.doc_id: r.text for r in docs.collect()}
    scored = toxicity.score_documents(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()
    assert {r.doc_id for r in clean} == {r.doc_id for r in scored if not r.predicted}
    want = kept_by_brute_force(sorted((r.doc_id, texts[r.doc_id]) for r in clean))
    assert {r.doc_id: r.text for r in shorter} == want and all(r.n_chars == len(r.text) for r in shorter)
    fps = {r.doc_id: simhash_by_python(r.text) for r in shorter}
    comp = union_find(fps, ((a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2))
    assert sorted(r.doc_id for r in single) == sorted({*comp.values()})
    sizes = Counter()
    for r in single:
        sizes[r.source] += len(r.text.split())
    taken = Counter()
    for r in mixed:
        taken[r.source] += len(r.text.split())
    for s, t in targets_by_python(dict(sizes)).items():
        assert abs(taken[s] - t) <= max(len(r.text.split()) for r in single if r.source == s)
    packed = corpus_pipeline.STAGES[-1][1](spark, out[-1], data)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed}
