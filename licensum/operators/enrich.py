"""Enrichment of licence rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum import vocab
from licensum.functions import scoring, text


def enrich_licences(
    licences: DataFrame, *, business_words=vocab.BUSINESS_TYPE_WORDS, category_words=vocab.CATEGORY_WORDS
) -> DataFrame:
    """Add business type, licence categories, risk score and the effective date that reports filter on."""
    activities = F.col("licensable_activities")
    kind = scoring.business_type(F.col("premises_name"), activities, business_words)
    return licences.withColumns(
        {
            "business_type": kind,
            "licence_categories": scoring.categories(activities, category_words),
            "effective_ts": text.effective_date(F.col("granted_date"), F.col("application_date"), F.col("scraped_at")),
        }
    ).withColumn("risk_score", scoring.risk_score(F.col("business_type"), activities, F.col("conditions")))
