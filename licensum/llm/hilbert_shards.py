"""Sharding in the order of a Hilbert curve over several metadata columns, so that files can be pruned by any of them."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from licensum.llm.common import offsets, stored

BITS = 5


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of points (a row each) with coordinates of ``bits`` bits."""
    x = [c.astype(np.int64) for c in coordinates.T]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            high = (x[i] >> level & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
            else:
                x[0] ^= swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] >> level & 1, (1 << level) - 1, 0)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            out = out << 1 | (c ^ turn) >> level & 1
    return out


def text_steps(docs: DataFrame, column: str, bits: int) -> Column:
    """The step of a text column among 2^bits of equal numbers of rows, in the order of whole values; NULL is the least.

    Values are counted, sorted by Spark and numbered by the rows before them; the first value of each step, 2^bits at
    most, comes to the driver.
    """
    counts = docs.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).filter("value IS NOT NULL")
    ordered = stored(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    sums = offsets(ordered.groupBy("part").agg(F.sum("n").alias("rows")), "part", "rows").selectExpr("part", "before", "sum(rows) OVER () AS total")
    ranked = ordered.join(F.broadcast(sums), "part").selectExpr("value", "total", "before + coalesce(sum(n) OVER (PARTITION BY part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rank")
    first = ranked.selectExpr("value", f"(rank * {2**bits}) DIV total AS step").groupBy("step").agg(F.min("value").alias("value")).collect()
    step = F.lit(-1)
    for r in sorted(first, key=lambda r: r.step):
        step = F.when(F.col(column) >= F.lit(r.value), F.lit(r.step)).otherwise(step)
    return step.cast("long")


def sort_key(docs: DataFrame, column: str, bits: int) -> Column:
    """A long in the order of the column: numbers as they are, texts by their step; NULL first."""
    if isinstance(docs.schema[column].dataType, T.StringType):
        return text_steps(docs, column, bits)
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**62)))


def curve(rows: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """Adds ``curve``: keys are quantised to 2^bits steps at their quantiles, and indexed along the curve.

    Only the quantiles, 2^bits - 1 numbers for each key, come to the driver.
    """
    shares = [i / 2**bits for i in range(1, 2**bits)]
    # A key that holds more than its share of rows takes several equal quantiles and is one step.
    found = rows.agg(*(F.percentile_approx(k, shares, 10_000).alias(k) for k in keys)).first()
    steps = [np.unique(np.array(found[k] or [], np.int64)) for k in keys]

    @F.pandas_udf("long")
    def index(*columns):
        import pandas as pd

        return pd.Series(hilbert_index(np.stack([np.searchsorted(s, c.to_numpy(), "left") for s, c in zip(steps, columns, strict=True)], axis=1), bits))

    return rows.withColumn("curve", index(*keys))


def assign(docs: DataFrame, *, shards: int, dimensions: Sequence[str] = ("lang", "source"), id_column: str = "doc_id", text_column: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) for every row of ``docs``.

    The rows are sorted by their place on the curve over ``dimensions`` and the size, then by the hash of the text and
    the id, and cut into ``shards`` runs whose lengths differ by one at most; slot counts within the run. Equal texts
    with equal metadata are neighbours; a group of copies larger than a shard is cut like anything else. The sort keys
    are all but unique, so no value of any column, however frequent, gathers in one task. NULL metadata sort first,
    NULL texts count as empty, and rows that are equal in all keys take any order.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    keys = {f"key{i}": sort_key(docs, c, bits) for i, c in enumerate(dimensions)}
    size = (F.octet_length(text) + 16).cast("long")
    slim = stored(docs.select(F.col(id_column).cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *(v.alias(k) for k, v in keys.items())))
    ordered = curve(slim, [*keys, "size"], bits).drop(*keys).repartitionByRange("curve", "text_crc32", "doc_id").sortWithinPartitions("curve", "text_crc32", "doc_id")
    placed = stored(ordered.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))

    # One row for each partition of the sort.
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = offsets(counts, "part", "n").select("part", "before", F.expr("sum(n) OVER ()").alias("total"))
    rank = placed.join(F.broadcast(before), "part").withColumn("rank", F.expr("before + (place & 8589934591)"))
    shard = F.expr(f"(rank * {shards}) DIV total")
    start = F.expr(f"(shard * total + {shards - 1}) DIV {shards}")
    return rank.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - start).select("doc_id", "size", "text_crc32", "curve", "shard", "slot")


def write(rows: DataFrame, path: str) -> None:
    """Writes rows with ``shard`` and ``slot`` as a folder for each shard, sorted, so that files have narrow value ranges."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
