"""Group profiles: counts, distinct counts, means and most common values of several columns in one pass.

Every row is turned into one ``(group, facet, value)`` entry per facet value plus one bare entry. A first aggregation
counts the entries and is combined in the map tasks, so a group that holds a third of all rows is spread over as many
entries as it has different values and shrinks before the shuffle. The second aggregation works on those counts:
distinct counts become row counts and the most common value a maximum. Neither joins nor repeated scans are needed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = ""


def facet_counts(df: DataFrame, group: dict[str, Column], facets: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """``(group, facet, value, n, measure sums, first_pos)``.

    ``facets`` are arrays of strings. ``first_pos`` orders values by first appearance: ``seq``, a number or a struct,
    then array position.
    """
    entry = lambda facet: lambda v, i: F.struct(F.lit(facet).alias("facet"), v.alias("value"), i.alias("i"))
    bare = F.array(F.struct(F.lit(ROW).alias("facet"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("i")))
    entries = F.concat(bare, *[F.transform(values, entry(name)) for name, values in facets.items()])
    rows = df.select(
        *[c.alias(name) for name, c in group.items()],
        "seq",
        *[c.alias(name) for name, c in measures.items()],
        F.explode(entries).alias("e"),
    )
    return rows.groupBy(*group, F.col("e.facet").alias("facet"), F.col("e.value").alias("value")).agg(
        F.count("*").alias("n"),
        *[F.sum(name).alias(name) for name in measures],
        F.min(_position(df.schema["seq"].dataType)).alias("first_pos"),
    )


def _position(kind: T.DataType) -> Column:
    """``seq``, then array position: one decimal where ``seq`` is a number, since hash aggregation cannot hold structs."""
    if isinstance(kind, T.IntegralType):
        return F.col("seq").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("e.i")
    return F.struct("seq", "e.i")


def rows_sum(name: str) -> Column:
    """Sum of a counted column over the rows of a group."""
    return F.sum(F.when(F.col("facet") == ROW, F.col(name)))


def n_rows() -> Column:
    return rows_sum("n")


def n_distinct(facet: str) -> Column:
    return F.count_if(F.col("facet") == facet)


def most_common(facet: str) -> Column:
    """Most frequent value of a facet; ties go to the value seen first."""
    of_facet = F.col("facet") == facet
    return F.min_by(F.when(of_facet, F.col("value")), F.when(of_facet, F.struct((-F.col("n")).alias("n"), "first_pos")))


def one(c: Column) -> Column:
    """A single value as a facet; NULL and empty are no value."""
    return F.when(F.coalesce(F.length(c) > 0, F.lit(False)), F.array(c)).otherwise(F.array().cast("array<string>"))


def most_common_per_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent ``value`` per ``group``; ties go to the value seen first (lowest ``seq``)."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return counts.groupBy(group).agg(
        F.min_by(value, F.struct((-F.col("n")).alias("n"), "first_seq")).alias("most_common"), F.max("n").alias("n")
    )
