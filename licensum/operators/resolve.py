"""De-duplication: exact copies within a council, and the same premises across councils."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from licensum.functions import scoring, text

MATCH_KEY = "match_key"


def drop_exact_copies(licences: DataFrame) -> DataFrame:
    """First row per council, name and address (case and outer blanks ignored).

    ``row_number() = 1`` lets Spark keep one row per key in every map task before the shuffle, so a key that holds
    many copies never travels whole to one task.
    """
    key = F.concat(
        F.lower(text.strip(F.col("premises_name"))), F.lit("|"), F.lower(text.strip(F.col("premises_address")))
    )
    first = Window.partitionBy("council_name", key).orderBy("seq")
    return licences.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def with_match_key(licences: DataFrame) -> DataFrame:
    """Add the identity of the premises: normalised name and postcode, or normalised address without one."""
    place = F.when(text.truthy(F.col("postcode")), F.col("postcode")).otherwise(
        text.normalize_for_matching(F.col("premises_address"))
    )
    key = F.concat(text.normalize_for_matching(F.col("premises_name")), F.lit("|"), place)
    return licences.withColumn(MATCH_KEY, key)


def with_score(licences: DataFrame) -> DataFrame:
    """Add the completeness score; a missing optional column counts as empty."""
    missing = {"opening_hours": F.lit(None).cast("map<string,string>")}
    absent = {c: v for c, v in missing.items() if c not in licences.columns}
    return licences.withColumns(absent).withColumn("score", scoring.completeness_score()).drop(*absent)


def best_per_key(scored: DataFrame, key: str = MATCH_KEY) -> DataFrame:
    """Best row per key: highest ``score``, then lowest ``seq``.

    Adds ``first_seq`` (first appearance of the key) and ``copies`` (rows seen). All three aggregates are combined in
    the map tasks and can be merged again, so rows already merged once may be passed in.
    """
    first = F.col("first_seq") if "first_seq" in scored.columns else F.col("seq")
    copies = F.col("copies") if "copies" in scored.columns else F.lit(1)
    names = [c for c in scored.columns if c not in (key, "first_seq", "copies")]
    best = scored.groupBy(key).agg(
        F.min_by(F.struct(*names), F.struct((-F.col("score")).alias("score"), "seq")).alias("best"),
        F.min(first).alias("first_seq"),
        F.sum(copies).alias("copies"),
    )
    return best.select(key, "best.*", "first_seq", "copies")


def resolve_entities(licences: DataFrame) -> DataFrame:
    """One row per premises across all councils, the most complete one."""
    return best_per_key(with_score(with_match_key(licences)))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key in the given order, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def newest_first(licences: DataFrame) -> DataFrame:
    """Presentation order: effective date descending, then first appearance."""
    when = text.effective_date(F.col("granted_date"), F.col("application_date"), F.col("scraped_at"))
    tie = "first_seq" if "first_seq" in licences.columns else "seq"
    return licences.orderBy(when.desc(), F.col(tie).asc())
