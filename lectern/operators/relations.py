"""Joins, windows, orders and set operations that the other operators and callers share.

All are lazy DataFrame operations: a key is a partition of a window or a join,
never a loop, and every order is total where it decides a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# numbering


def numbered(rows: DataFrame, first: str, *rest: str, name: str = "nth", prefix: int = 4) -> DataFrame:
    """Rows numbered from 1 in order of ``first`` (a string, null first) and ``rest``.

    No task sees all rows: those whose first column starts alike are numbered
    among themselves, after the counts of the starts before, of which there is
    a row each.
    """
    started = rows.withColumn("_start", F.left(F.col(first), F.lit(prefix)))
    counts = started.groupBy(F.col("_start").alias("_s")).agg(F.count("*").alias("_n"))
    before = counts.select("_s", (F.sum("_n").over(Window.orderBy("_s")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_start").orderBy(first, *rest))
    ranked = started.withColumn("_within", within).join(before, F.col("_start").eqNullSafe(F.col("_s")))
    return ranked.withColumn(name, F.col("_within") + F.col("_before")).drop("_start", "_s", "_n", "_before", "_within")


def positions(rows: DataFrame, key: str, order: str, name: str = "nth", start: int = 1) -> DataFrame:
    """The place of every row among those of its key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)) + (start - 1))


def ranks(rows: DataFrame, key: str, order: str, name: str = "rank") -> DataFrame:
    """The rank of a value among the distinct ones of its key, without gaps."""
    return rows.withColumn(name, F.dense_rank().over(Window.partitionBy(key).orderBy(order)))


# looking back and ahead


def as_of(rows: DataFrame, key: str, at: str, value: str, when: Column, name: str) -> DataFrame:
    """The ``value`` of the last row that fulfils ``when``, at or before each row of its key.

    Of rows at one time the largest value counts; there is no join, so the two
    sides can't differ in partitioning.
    """
    upto = Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.max(F.when(when, F.struct(at, value))).over(upto)[value])


def last_known(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value that is not null, up to each row of its key."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, True).over(upto))


def look_ahead(rows: DataFrame, key: str, order: str, column: str, name: str) -> DataFrame:
    """The next row's value; null at the end of a key."""
    return rows.withColumn(name, F.lead(column).over(Window.partitionBy(key).orderBy(order)))


def runs(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Stretches of one value: key, ``column``, the order at their start and how many rows; null is a value like others."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.col(column).eqNullSafe(F.lag(column).over(w)) & (F.row_number().over(w) > 1)
    marked = rows.withColumn("_starts", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_starts").over(w))
    return marked.groupBy(key, "_run", column).agg(F.min(order).alias("start"), F.count("*").alias("n")).drop("_run")


# counts


def shares(rows: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """Rows per value and their share of all; one row per value meets in one task."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), digits))


def largest_groups(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The groups with most rows, ties in order of their keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(most)


def groups_over(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Groups of more than ``least`` rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least)


def tallied(base: DataFrame, rows: DataFrame, key: str, **counts: Column) -> DataFrame:
    """Rows of ``base`` with aggregates over those of ``rows`` that have their key; 0 where there are none.

    All aggregates come from one pass and one join, however many they are.
    """
    found = rows.groupBy(key).agg(*(c.alias(name) for name, c in counts.items()))
    return base.join(found, key, "left").fillna(0, list(counts))


def counted_tables(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Rows per table (collection, n); an absent one has 0."""
    some = next(df for df in tables.values() if df is not None)
    nothing = some.limit(0)
    each = [(nothing if df is None else df).agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def whole_numbers(rows: DataFrame, column: Column, name: str) -> DataFrame:
    """Distinct whole numbers among texts; what is none is left out."""
    return rows.select(column.try_cast("int").alias(name)).where(F.col(name).isNotNull()).distinct()


def last_page(rows: DataFrame, key: Column, page: Column, name: str) -> DataFrame:
    """Pages per book by the largest page number, 0 if there is none."""
    return rows.groupBy(key.alias(name)).agg(F.coalesce(F.max(page), F.lit(0)).alias("pages"))


# joins


def with_fields(rows: DataFrame, about: DataFrame, key: str, **defaults: object) -> DataFrame:
    """Rows with fields of ``about``; the default where a row has no partner, or a null or empty one."""
    joined = rows.join(about.select(key, *defaults), key, "left")
    for name, value in defaults.items():
        filled = F.nullif(F.col(name), F.lit("")) if isinstance(value, str) else F.col(name)
        joined = joined.withColumn(name, F.coalesce(filled, F.lit(value)))
    return joined


def presence(first: DataFrame, second: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Every key of either side, and which side has it."""
    a, b = (df.select(key).distinct().withColumn(n, F.lit(True)) for df, n in zip((first, second), names, strict=True))
    return a.join(b, key, "full_outer").fillna(False, list(names))


def on_either(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """A row for each distinct value in ``columns``, so that a join on any of them has one key."""
    return rows.withColumn(name, F.explode(F.array_distinct(F.array_compact(F.array(*columns)))))


def first_of(rows: DataFrame, key: str, value: str, *tables: DataFrame) -> DataFrame:
    """Rows with the ``value`` of the first table that has one for their key."""
    out = rows
    for i, t in enumerate(tables):
        out = out.join(t.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left")
    return out.select(*rows.columns, F.coalesce(*(F.col(f"_v{i}") for i in range(len(tables)))).alias(value))


# sets


def tagged_union(column: str, **parts: DataFrame) -> DataFrame:
    """All rows of all parts, each with its part's name in ``column``."""
    return reduce(DataFrame.unionByName, (df.withColumn(column, F.lit(name)) for name, df in parts.items()))


def keys_of_all(key: str, *tables: DataFrame) -> DataFrame:
    """Distinct keys of all tables together."""
    return reduce(DataFrame.union, (t.select(key) for t in tables)).distinct()


def keys_of_each(key: str, *tables: DataFrame) -> DataFrame:
    """Distinct keys that every table has."""
    return reduce(DataFrame.intersect, (t.select(key) for t in tables))


def keys_only_in(key: str, first: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct keys of the first table that no other has."""
    return reduce(DataFrame.subtract, (t.select(key) for t in (first, *others)))


def unmatched(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows, repeated ones too, whose key ``others`` does not have."""
    return rows.join(others.select(key), key, "left_anti")


# orders


def listed_in_order(rows: DataFrame, key: str, order: str, name: str, between: str = ",") -> DataFrame:
    """The numbers of each key as one text, in numeric order: 10 follows 9."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(order)).cast("array<string>"), between).alias(name))


def by_score(rows: DataFrame, key: str, last: Column | None = None, score: str = "score") -> list[Column]:
    """An order: best score first, then those that are not ``last``, then the key."""
    return [F.desc(score), *([] if last is None else [F.coalesce(last, F.lit(False)).asc()]), F.col(key)]


def first_books(books: DataFrame, condition: Column, key: str, most: int) -> DataFrame:
    """The first so many books that fulfil a condition, by id."""
    return books.where(condition).orderBy(key).limit(most)
