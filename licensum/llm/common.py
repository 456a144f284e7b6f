"""What several operators of this subpackage share."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from licensum.session import shared_folder

SPACES = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The runs of characters between spaces, tabs and line ends; NULL and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def addressed(docs: DataFrame) -> DataFrame:
    """(row, file, line) for a table as it is read from files: all its columns as a struct, and where each row lies.

    Every read gives a row the same address, whatever the splits and executors, so that decisions can be made on narrow
    rows and taken back to the whole ones. A frame without files is stored first. A frame that repeats or joins rows of
    files has no such addresses: store it before.
    """
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select(F.struct(*docs.columns).alias("row"), place["file_path"].alias("file"), place["row_index"].alias("line"))
    except AnalysisException:
        docs = stored(docs)
    place = docs.metadataColumn("_metadata")
    return docs.select(F.struct(*docs.columns).alias("row"), place["file_path"].alias("file"), place["row_index"].alias("line"))


def remainder(doc_id: str, by: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``by``; NULL without an id."""
    return F.crc32(F.col(doc_id).cast("string")) % by


def pieces(batch: pa.RecordBatch, column: int, most: int = 4_000_000, rows: int = 1 << 30):
    """Slices of a batch with about ``most`` bytes in a string column, or one row where a row alone is larger, and ``rows`` rows at most."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > most or i - start == rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def raw(array: pa.Array) -> list[bytes]:
    """Texts as bytes, NULL as empty."""
    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]


def offsets(totals: DataFrame, order: str, amount: str) -> DataFrame:
    """``totals`` (a row for each partition, so few) with ``before``: the sum of ``amount`` in all earlier rows."""
    return totals.selectExpr("*", f"coalesce(sum(`{amount}`) OVER (ORDER BY `{order}` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
