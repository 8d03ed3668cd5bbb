"""Mixing sources to target weights by pivotal rounding, in DataFrame operations only.

A source's target in words, divided by its size, is the number of copies that
each of its documents is expected to have.  The whole part is certain.  The
fractional parts are rounded dependently: two documents meet, words move from
one to the other (by chance, without bias) until one of them is wholly in or
wholly out, and the other goes on with what remains.  So a source's words stay
constant through all meetings but the last rounding.  Documents meet in leaves
of about ``LEAF``; what each leaf leaves over meets again, level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.scratch import materialize
from lectern.operators.relations import numbered

LEAF = 64
#: Documents above one part in so many of their source are rounded before the rest.
BIG = 200
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def _version(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(id, source, size, version, copy)``: words per row; equal rows get copy numbers 1, 2, ..."""
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"), _version(text_col).alias("version"))
    keys = ["id", "source", "size", "version"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.explode(F.expr("sequence(1L, n)")).alias("copy"))


def targets(sized: DataFrame) -> DataFrame:
    """``(source, source_size, n, target)``, one row per source.

    Weights are 1, 2, 3, 1, ... by code point order of the source, null last.
    With shares capped at ``MOST`` sizes, target = least(cap, level * weight)
    for the one level at which targets add up to all sizes.  The level rises
    from the one without caps, by what they leave over, until no more sources
    reach theirs.  Sources are numbered side by side and summed up, so they may
    be as many as hosts are.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per_source = materialize(per_source, "sources")
    named = numbered(per_source.where("source IS NOT NULL").withColumn("_name", F.col("source").cast("string")), "_name", name="_nth").drop("_name")
    last = per_source.where("source IS NULL").withColumn("_nth", F.lit(per_source.count()).cast("bigint"))
    weighed = named.unionByName(last).withColumn("weight", (F.col("_nth") - 1) % 3 + 1).withColumn("cap", MOST * F.col("source_size"))
    weighed = materialize(weighed.drop("_nth"), "weighed")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        found = weighed.agg(F.count_if(full).alias("capped"), F.sum(F.when(full, F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if found.capped == capped or not found.weights:
            break
        level, capped = (total - (found.caps or 0)) / found.weights, found.capped
    return weighed.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))).select("source", "source_size", "n", "target")


def _chance(seed: int, *keys: str) -> str:
    return f"(pmod(xxhash64({seed}L, {', '.join(keys)}), 9007199254740992L) / 9007199254740992D)"


def _meet(seed: int, id_type: str) -> Column:
    """Fold the members of a leaf: (decided documents, the one that goes on)."""
    member = f"struct<u:bigint,id:{id_type},size:bigint,version:bigint,copy:bigint,mass:double>"
    decided = f"array<struct<id:{id_type},size:bigint,version:bigint,copy:bigint,extra:int>>"
    taken = lambda m, extra: f"named_struct('id', {m}.id, 'size', {m}.size, 'version', {m}.version, 'copy', {m}.copy, 'extra', {extra})"
    on = lambda m, mass: f"named_struct('u', {m}.u, 'id', {m}.id, 'size', {m}.size, 'version', {m}.version, 'copy', {m}.copy, 'mass', {mass})"
    step = lambda out, rest: f"named_struct('out', concat(s.out, array({out})), 'rest', {rest})"
    both = "(s.rest.mass + x.mass)"
    lo, hi = f"greatest(0D, {both} - x.size)", f"least(CAST(s.rest.size AS DOUBLE), {both})"
    up = f"{_chance(seed, 's.rest.id', 's.rest.copy', 'x.id', 'x.copy')} * ({hi} - {lo}) < s.rest.mass - {lo}"
    return F.expr(
        f"""aggregate(array_sort(members), named_struct('out', CAST(array() AS {decided}), 'rest', CAST(NULL AS {member})), (s, x) -> CASE
            WHEN s.rest IS NULL THEN named_struct('out', s.out, 'rest', x)
            WHEN {up} THEN IF(s.rest.size <= {both}, {step(taken('s.rest', 1), on('x', f'{both} - s.rest.size'))}, {step(taken('x', 0), on('s.rest', both))})
            ELSE IF({both} >= x.size, {step(taken('x', 1), on('s.rest', f'{both} - x.size'))}, {step(taken('s.rest', 0), on('x', both))}) END)"""
    )


def _copies(share: Column) -> tuple[Column, Column]:
    """Certain copies, and the fraction that is left to chance."""
    whole = F.floor(share + 1e-12)
    return whole, F.greatest(F.lit(0.0), share - whole)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 20, leaf: int = LEAF) -> DataFrame:
    """One row per input row: id, source, version (a hash of the text), size, source_size, target, copies.

    ``copies`` whole copies of a document are taken, never over ``MOST``.  Documents above ``1 / BIG`` of their
    source (fewer than ``BIG`` of them) are rounded first; what that rounding
    misses is spread evenly over the others' probabilities.  The last document
    left in each of both parts is rounded to the nearer side, so a source that
    has smaller documents too misses its target by about half of one of those.
    Choices depend on ids and ``seed`` alone, so reruns agree.  Documents
    without words (null, empty or white space) are taken 0 times over.
    Repeated rows are documents of their own; null ids and a null source are
    values like others.  An empty table gives no rows; further columns are not
    read.
    """
    sized = materialize(sizes(docs, id_col, text_col, source_col), "sizes")
    per_source = materialize(targets(sized), "targets")
    id_type = sized.schema["id"].dataType.simpleString()
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.xxhash64(F.lit(seed), "id", "size", "version", "copy")
    member = F.struct(place.alias("u"), "id", "size", "version", "copy", (F.col("size") * F.col("part")).alias("mass"))
    nearer = F.when(F.col("rest.mass") * 2 >= F.col("rest.size"), 1).otherwise(0)
    decided_columns = ["id", "source", "size", "version", "copy", "whole", "extra"]

    def with_source(rows: DataFrame, known: DataFrame) -> DataFrame:
        known = known.withColumnRenamed("source", "_source")
        return rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def meet(level: DataFrame) -> DataFrame:
        met = level.groupBy("source", "leaf", "whole").agg(F.collect_list("member").alias("members"))
        met = met.select("source", "leaf", "whole", _meet(seed, id_type).alias("m"))
        return materialize(met.select("source", "leaf", "whole", "m.out", "m.rest"), "met")

    def members_out(met: DataFrame) -> DataFrame:
        return met.select("source", "whole", F.explode("out").alias("o")).select("o.id", "source", "o.size", "o.version", "o.copy", "whole", "o.extra")

    def last_out(met: DataFrame) -> DataFrame:
        return met.select("rest.id", "source", "rest.size", "rest.version", "rest.copy", "whole", nearer.alias("extra"))

    whole, part = _copies(share)
    known = per_source.select("source", "source_size", whole.alias("whole"), part.alias("part"))
    each = with_source(sized, known)
    is_big = F.col("size") * BIG > F.col("source_size")
    big = each.where(is_big)
    settled = big.where("part <= 1e-12").withColumn("extra", F.lit(0))
    met = meet(big.where("part > 1e-12").select("source", F.lit(0).alias("leaf"), "whole", member.alias("member")))
    outcomes = [settled.select(decided_columns), members_out(met), last_out(met)]

    # What the big documents of a source have got too much, as a share of its other documents.
    got = outcomes[1].unionByName(outcomes[2]).groupBy("source").agg(F.sum(F.col("size") * F.col("extra")).alias("got"), F.sum("size").alias("big_open"))
    rest_words = sized.join(per_source.select(F.col("source").alias("_source"), "source_size"), F.col("source").eqNullSafe(F.col("_source"))).where(~is_big).groupBy(F.col("source")).agg(F.sum("size").alias("rest_words"))
    small = per_source.withColumn("share", share)
    for more in (got, rest_words):
        small = small.join(more.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    over = F.coalesce(F.col("got") - F.col("big_open") * part, F.lit(0.0))
    moved = F.when(F.col("rest_words") > 0, F.col("share") - over / F.col("rest_words")).otherwise(F.col("share"))
    whole, part = _copies(F.least(F.greatest(moved, F.lit(0.0)), F.lit(float(MOST))))
    leaves = F.ceil(F.col("n") / leaf)
    small = materialize(small.select("source", "source_size", whole.alias("whole"), part.alias("part"), leaves.alias("leaves")), "small")

    each = with_source(sized, small).where(~is_big)
    open_ = F.expr("part > 1e-12 AND size > 0")
    outcomes.append(each.where(~open_).withColumn("extra", F.lit(0)).select(decided_columns))
    level = each.where(open_).select("source", F.pmod(place, "leaves").alias("leaf"), "whole", member.alias("member"))
    most = small.agg(F.max("leaves")).first()[0] or 0
    while most:
        met = meet(level)
        outcomes.append(members_out(met))
        if most == 1:
            outcomes.append(last_out(met))
            break
        most = -(-most // leaf)
        level = met.select("source", F.floor(F.col("leaf") / leaf).alias("leaf"), "whole", F.col("rest").alias("member"))
    decided = outcomes[0]
    for more in outcomes[1:]:
        decided = decided.unionByName(more)
    out = with_source(decided, per_source.select("source", "source_size", "target"))
    copies = (F.col("whole") + F.col("extra")).cast("int")
    return out.select("id", "source", "version", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 20) -> DataFrame:
    """``decide`` as a report: id, size, source_size, target, taken (words, repeats counted), source, copies."""
    decided = decide(docs, id_col, text_col, source_col, seed=seed)
    taken = (F.col("size") * F.col("copies")).cast("bigint")
    return decided.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), F.col("source").alias(source_col), "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 20) -> DataFrame:
    """The mix itself: every document as many times as ``decide`` takes it, all columns kept.

    Rows equal in id, source and text stand for each other: together they
    occur as often as all of them are taken.
    """
    decided = decide(docs, id_col, text_col, source_col, seed=seed)
    total = decided.groupBy(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("version").alias("_version")).agg(F.sum("copies").alias("_taken"), F.count("*").alias("_rows")).where("_taken > 0")
    total = materialize(total, "taken")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).eqNullSafe(F.col("_source")) & (_version(text_col) == F.col("_version"))
    joined = docs.join(total, same)
    each = joined.where("_taken >= _rows").withColumn("_nth", F.explode(F.expr("sequence(1L, _taken div _rows)")))
    rest = joined.where("_taken % _rows > 0").dropDuplicates(["_id", "_source", "_version"]).withColumn("_nth", F.explode(F.expr("sequence(1L, _taken % _rows)")))
    return each.unionByName(rest).select(docs.columns)
