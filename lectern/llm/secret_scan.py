"""Secret scans with multipart credential linking, in DataFrame operations only.

Base kinds (``assign``, ``access``, ``hex``) are always reported.  Weak kinds
(``identifier``, ``key``, ``endpoint``) would be noise alone: one of them is
reported only when the parts that complete it as a credential lie in its
scope, the ``SCOPE`` code points on either side of its start:

* an identifier needs a secret (assign, hex or key),
* a key needs an identifier (access or identifier),
* an endpoint needs both.

The interval join that decides this is an equi-join on (row, block of
``SCOPE`` code points).  Each block keeps only the first and last start of
each part, which is all that a candidate in the same or a neighbouring block
has to know, so no pairs are formed however many parts a text holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.scratch import materialize

SCOPE = 400


@dataclass(frozen=True)
class Kind:
    """``ok`` judges a match ``m`` with group ``g``; ``hint`` is a cheap test that some match may be."""

    name: str
    part: str
    pattern: str
    group: int
    hint: str
    ok: str
    base: bool = False


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    Kind("assign", "secret", ASSIGN, 2, r"""(?i:ssword|sswd|secret|token|key)["']?\x20*[:=]""", "length(g) >= 6", True),
    Kind("access", "id", r"AKIA[A-Z0-9]+", 0, r"AKIA[A-Z0-9]{16}", "length(m) >= 20", True),
    Kind("hex", "secret", r"[0-9a-f]+", 0, r"[0-9a-f]{24}", "length(m) >= 24", True),
    Kind("identifier", "id", r"""((?i:access_?key_?id|client_?id|user_?name|user_?id|user|login|account_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, r"""(?i:id|user|user_?name|login|account)["']?\x20*[:=]""", "length(g) >= 3"),
    Kind("key", "secret", r"[A-Za-z0-9+/_-]+", 0, r"[A-Za-z0-9+/_-]{32}", "length(m) >= 32 AND m RLIKE '[0-9]' AND m RLIKE '[A-Z]' AND m RLIKE '[a-z]'"),
    Kind("endpoint", "url", r"""(?:https?|s?ftp|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x20\x09-\x0D"'<>]+""", 0, r"://", "true"),
)
NAMES = [k.name for k in KINDS]


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _candidates(kind: Kind, ordinal: int) -> Column:
    """Lengths of the matches and of what lies between them, null without a hint."""
    p = _quoted(kind.pattern)
    return F.expr(
        f"""CASE WHEN text RLIKE {_quoted(kind.hint)} THEN named_struct('kind', {ordinal},
            'gaps', transform(split(text, {p}, -1), x -> length(x)),
            'found', zip_with(regexp_extract_all(text, {p}, 0), regexp_extract_all(text, {p}, {kind.group}),
                (m, g) -> named_struct('size', length(m), 'ok', {kind.ok}))) END"""
    )


def _named(ordinal: str) -> str:
    return f"element_at(array({', '.join(repr(n) for n in NAMES)}), {ordinal} + 1)"


def _listing(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat({_named('s.kind')}, ':', s.start, ':', s.end)), ',')"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: a row number for every row, and all reported spans.

    ``spans`` has row, kind (position in ``KINDS``), base, start and end in
    code points, end exclusive.  Weak spans within a base span are part of it
    and not reported again, but they complete others as any part does.
    """
    base = ", ".join(str(i) for i, k in enumerate(KINDS) if k.base)
    part = lambda name: ", ".join(str(i) for i, k in enumerate(KINDS) if k.part == name)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    scanned = texts.select(F.monotonically_increasing_id().alias("row"), "id", F.array_compact(F.array(*(_candidates(k, i) for i, k in enumerate(KINDS)))).alias("candidates"))
    rows = materialize(scanned, "scanned")

    each = rows.where("size(candidates) > 0").select("row", F.explode("candidates").alias("c"))
    each = each.select("row", "c.kind", F.posexplode(F.arrays_zip("c.gaps", "c.found")).alias("i", "x"))
    upto = Window.partitionBy("row", "kind").orderBy("i")
    start = F.sum("x.gaps").over(upto) + F.sum(F.coalesce("x.found.size", F.lit(0))).over(upto) - F.coalesce("x.found.size", F.lit(0))
    found = each.select("row", "kind", start.alias("start"), F.col("x.found.size").alias("size"), F.col("x.found.ok").alias("ok")).where("ok")
    found = found.selectExpr("row", "kind", f"kind IN ({base}) AS base", "start", "start + size AS end", f"start div {int(scope)} AS block")
    # Base kinds come first where starts are equal, so a weak span lies in a base span if one so far ends where it does or later.
    inside = F.max(F.expr("IF(base, end, NULL)")).over(Window.partitionBy("row").orderBy("start", "kind")) >= F.col("end")
    found = found.withColumn("reported", F.col("base") | ~F.coalesce(inside, F.lit(False)))
    found = materialize(found, "spans")

    blocks = found.groupBy("row", F.col("block").alias("near")).agg(*(f(F.expr(f"IF(kind IN ({part(p)}), start, NULL)")).alias(f"{p}_{side}") for p in ("id", "secret") for side, f in (("lo", F.min), ("hi", F.max))))
    weak = found.where("reported AND NOT base").select("*", F.explode(F.expr("array(block - 1, block, block + 1)")).alias("near"))
    reach = lambda p: f"coalesce(bool_or(CASE WHEN near < block THEN {p}_hi >= start - {int(scope)} WHEN near > block THEN {p}_lo <= start + {int(scope)} ELSE {p}_lo IS NOT NULL END), false)"
    judged = weak.join(blocks, ["row", "near"]).groupBy("row", "kind", "base", "start", "end").agg(F.expr(reach("id")).alias("has_id"), F.expr(reach("secret")).alias("has_secret"))
    rule = {"id": "has_secret", "secret": "has_id", "url": "has_id AND has_secret"}
    linked = judged.where(" OR ".join(f"(kind = {i} AND {rule[k.part]})" for i, k in enumerate(KINDS) if not k.base))
    columns = ["row", "kind", "base", "start", "end"]
    return rows.select("row", "id"), found.where("base").select(*columns).unionByName(linked.select(*columns))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    A null text counts as empty; an empty text has no spans, counts 0 and the
    hash of the empty string.  Repeated rows and null ids each give a row, an
    empty table gives none.  Further columns of ``docs`` are not read.
    """
    rows, spans = find_spans(docs, id_col, text_col, scope)
    counts = [F.expr(f"count_if(kind = {i})").alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base]
    per_row = spans.groupBy("row").agg(
        *counts,
        F.expr("count_if(NOT base)").alias("n_linked"),
        F.expr("array_sort(collect_list(named_struct('start', start, 'kind', kind, 'end', end, 'base', base)))").alias("found"),
    )
    nothing = "CAST(array() AS array<struct<start:bigint,kind:int,end:bigint,base:boolean>>)"
    joined = rows.join(per_row, "row", "left").withColumn("found", F.expr(f"coalesce(found, {nothing})"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return joined.select(
        F.col("id").alias(id_col), *(zero(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(F.expr(_listing("filter(found, s -> s.base)")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_listing("found")).alias("spans"),
        zero("n_linked"),
    )


def _oracle() -> str:
    def scan(i: int, k: Kind) -> str:
        p = k.pattern.replace("(?i:", "(?i:").replace("'", "''")
        ok = k.ok
        for letter in "[0-9]", "[A-Z]", "[a-z]":
            ok = ok.replace(f"m RLIKE '{letter}'", f"regexp_matches(m, '{letter}')")
        return f"""SELECT row, {i} AS kind, {str(k.base).lower()} AS base, i, gaps, ms, ms[i] AS m, gs[i] AS g, {ok} AS ok
          FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT row, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {k.group}) AS gs
            FROM d WHERE regexp_matches(t, '{p}')))"""

    part = lambda name: ", ".join(str(i) for i, k in enumerate(KINDS) if k.part == name)
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
    near = lambda p: f"EXISTS (SELECT 1 FROM f p WHERE p.row = f.row AND p.kind IN ({part(p)}) AND abs(p.s - f.s) <= {SCOPE})"
    every = " UNION ALL ".join(scan(i, k) for i, k in enumerate(KINDS))
    counts = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS if k.base)
    own = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k.name}" for i, k in enumerate(KINDS) if k.base)
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    a AS MATERIALIZED ({every}),
    o AS MATERIALIZED (SELECT row, kind, base, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s, length(m) AS n FROM a WHERE ok),
    f AS MATERIALIZED (SELECT row, kind, base, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e, base OR NOT EXISTS (SELECT 1 FROM o b WHERE b.base AND b.row = w.row AND b.s <= w.s AND w.s + w.n <= b.s + b.n) AS reported FROM o w),
    r AS (SELECT * FROM f WHERE base OR reported AND CASE WHEN kind IN ({part('id')}) THEN {near('secret')} WHEN kind IN ({part('secret')}) THEN {near('id')} ELSE {near('id')} AND {near('secret')} END),
    g AS (SELECT row, {own}, count(*) FILTER (NOT base) AS n_linked,
      string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (base) AS b, string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM r GROUP BY row)
    SELECT doc_id, {counts}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM d LEFT JOIN g USING (row)"""


ORACLE = _oracle()
