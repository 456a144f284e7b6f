"""Readers of register files. Every reader declares its schema; a missing path gives an empty table."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from licensum import schemas, vocab
from licensum.operators import councils


def _timestamps(c: Column, kind: T.DataType) -> Column:
    """Turn the timestamp texts inside a value into timestamps."""
    if isinstance(kind, T.TimestampNTZType):
        return c.try_cast("timestamp_ntz")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(c, lambda e: _timestamps(e, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [_timestamps(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    extra = [c for c in df.columns if c not in schema.names]
    return df.select(*[_timestamps(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields], *extra)


def read_json(spark: SparkSession, path, schema: T.StructType, *, lines: bool = False) -> DataFrame:
    """JSON documents (an array or object per file) or, with ``lines``, one object per line.

    A document file is read by one task; large volumes should be many files or JSON lines. Broken records keep their
    text in ``_corrupt_record``.
    """
    wire = T.StructType([*schemas.wire(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.read.schema(wire).option("mode", "PERMISSIVE").option("multiLine", not lines)
    try:
        return _typed(reader.json(path), schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return _typed(spark.createDataFrame([], wire), schema)


def read_extraction_results(spark, path, **kw) -> DataFrame:
    return read_json(spark, path, schemas.EXTRACTION_RESULT, **kw)


def read_councils(spark, path, **kw) -> DataFrame:
    return read_json(spark, path, schemas.COUNCIL, **kw)


def read_page_analyses(spark, path, **kw) -> DataFrame:
    return read_json(spark, path, schemas.PAGE_ANALYSIS, **kw)


def read_processed(spark, path, **kw) -> tuple[DataFrame, DataFrame]:
    """Licences and summary of processed-data documents ``{summary, licences}``."""
    document = T.StructType(
        [T.StructField("summary", schemas.PROCESSING_SUMMARY), T.StructField("licences", T.ArrayType(schemas.LICENCE_ENRICHED))]
    )
    df = read_json(spark, path, document, **kw)
    licences = df.select(F.explode("licences").alias("l")).select("l.*")
    return licences, df.filter("summary IS NOT NULL").select("summary.*")


def read_register_files(spark, path) -> DataFrame:
    """Councils of official register files; the region comes from the file path."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return councils.parse_register(files.withColumn("seq", F.monotonically_increasing_id()))


def seed_councils(spark, rows=vocab.SEED_COUNCILS) -> DataFrame:
    """The built-in councils, in order."""
    numbered = [(i, *row) for i, row in enumerate(rows)]
    df = spark.createDataFrame(numbered, "seq bigint, name string, website_url string, region string, code string")
    return councils.with_info_length(df, ["name", "website_url", "region", "code"])


def read_pages(spark, path) -> DataFrame:
    return spark.read.parquet(path)


def list_snapshots(spark, path, glob: str = "*") -> DataFrame:
    """``(path, modified)`` of every file below a folder. File contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    try:
        found = files.load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, modified timestamp_ntz")
    return found.select("path", F.col("modificationTime").cast("timestamp_ntz").alias("modified"))


def latest_snapshot(spark, path, glob: str = "*") -> str:
    """Path of the newest file of a folder; only that one name reaches the driver."""
    row = list_snapshots(spark, path, glob).agg(F.max_by("path", F.struct("modified", "path")).alias("p")).first()
    if row is None or row.p is None:
        raise FileNotFoundError(f"no processed data below {path}")
    return row.p


def latest_partition(df: DataFrame, column: str = "snapshot_date") -> DataFrame:
    """Rows of the newest snapshot of a partitioned table. The filter prunes all other folders."""
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())
