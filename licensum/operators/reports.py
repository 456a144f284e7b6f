"""Report tables over enriched licences. Numbers are left unrounded; rounding belongs to whoever shows them.

The input should be a stored table: every report is its own scan of the few columns it needs.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from licensum import vocab
from licensum.functions import text
from licensum.operators import facets as X


def _kind() -> Column:
    return F.coalesce("business_type", F.lit("Unknown"))


def _risk() -> Column:
    return F.coalesce("risk_score", F.lit(5)).cast("bigint")


def _activities() -> Column:
    return F.coalesce("licensable_activities", F.array().cast("array<string>"))


def _effective() -> Column:
    return text.effective_date(F.col("granted_date"), F.col("application_date"), F.col("scraped_at"))


def _in_week(as_of) -> Column:
    when = _effective()
    return F.coalesce((when >= text.week_start(as_of)) & (when < text.week_end(as_of)), F.lit(False))


def week_of(licences: DataFrame, as_of) -> DataFrame:
    """Licences whose effective date lies in the Monday-to-Sunday week of ``as_of``."""
    return licences.filter(_in_week(as_of))


def _count(licences: DataFrame, key: Column, name: str) -> DataFrame:
    return licences.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def _ordered(counts: DataFrame, k: int | None = None) -> DataFrame:
    out = counts.orderBy(F.col("n").desc(), F.col("first_seq").asc())
    return (out.limit(k) if k else out).drop("first_seq")


def council_counts(licences: DataFrame, *, k: int | None = None) -> DataFrame:
    """Licences per council, most first; ties in order of first appearance."""
    return _ordered(_count(licences, F.col("council_name"), "council_name"), k)


def business_type_counts(licences: DataFrame) -> DataFrame:
    return _ordered(_count(licences, _kind(), "business_type"))


def status_counts(licences: DataFrame) -> DataFrame:
    return _ordered(_count(licences, F.col("licence_status"), "licence_status"))


def date_range(licences: DataFrame) -> DataFrame:
    """Earliest and latest granted or application date and the whole days between; no row without dates."""
    when = text.effective_date(F.col("granted_date"), F.col("application_date"))
    out = licences.agg(F.min(when).alias("earliest"), F.max(when).alias("latest"))
    days = text.whole_days_between(F.col("earliest"), F.col("latest"))
    return out.filter(F.col("earliest").isNotNull()).withColumn("span_days", days)


def activity_counts(licences: DataFrame, *, k: int | None = 10) -> DataFrame:
    """Most mentioned activities; ties in order of first mention."""
    mentions = licences.select("seq", F.posexplode(_activities()).alias("i", "activity"))
    counts = mentions.groupBy("activity").agg(
        F.count("*").alias("n"), F.min(F.struct("seq", "i")).alias("first_seq")
    )
    return _ordered(counts, k)


def processing_summary(raw: DataFrame, final: DataFrame) -> DataFrame:
    """Rows before and after processing and the share that was dropped."""
    original = raw.agg(F.count("*")).scalar()
    out = final.agg(F.count("*").alias("final_count")).withColumn("original_count", original)
    dropped = (F.col("original_count") - F.col("final_count")) / F.col("original_count")
    return out.withColumn("reduction_rate", F.when(F.col("original_count") > 0, dropped).otherwise(F.lit(0.0)))


def _zero_filled(licences: DataFrame, column: str, domain) -> DataFrame:
    """Count per value of a fixed domain in one aggregation, one row per value."""
    counts = licences.agg(*[F.count_if(F.col(column) == v).alias(v) for v in domain])
    return counts.unpivot([], list(domain), column, "n")


def type_counts(licences: DataFrame, *, types=vocab.LICENCE_TYPES) -> DataFrame:
    return _zero_filled(licences, "licence_type", types)


def status_counts_filled(licences: DataFrame, *, statuses=vocab.LICENCE_STATUSES) -> DataFrame:
    return _zero_filled(licences, "licence_status", statuses)


def top_councils(licences: DataFrame, *, k: int = 10) -> DataFrame:
    return council_counts(licences, k=k)


def weekly_stats(licences: DataFrame, *, as_of) -> DataFrame:
    """Key figures of the week against all other rows, in one pass. Columns of hours may be absent."""
    has_hours = F.lit(False)
    for c in {"opening_hours", "alcohol_hours"} & set(licences.columns):
        has_hours = has_hours | text.filled(F.col(c))
    w = _in_week(as_of)
    in_week = lambda c: F.when(w, c)
    out = licences.agg(
        F.count("*").alias("total_licences"),
        F.count_if(w).alias("new_licences"),
        F.count_distinct(in_week(F.nullif(F.col("postcode"), F.lit("")))).alias("unique_postcodes"),
        F.avg(in_week(F.size(_activities()))).alias("avg_activities"),
        F.count_if(w & text.filled(F.col("conditions"))).alias("premises_with_conditions"),
        F.count_if(w & has_hours).alias("premises_with_hours"),
        F.avg(in_week(_risk())).alias("avg_risk"),
        F.count_if(w & (_risk() >= 8)).alias("high_risk_premises"),
    )
    before = F.col("total_licences") - F.col("new_licences")
    change = (F.col("new_licences") - before) / before * 100
    return out.select(
        "total_licences",
        "new_licences",
        F.when(before > 0, change).otherwise(F.lit(0.0)).alias("weekly_change_percent"),
        "unique_postcodes",
        F.coalesce("avg_activities", F.lit(0.0)).alias("avg_activities_per_licence"),
        "premises_with_conditions",
        "premises_with_hours",
        F.coalesce("avg_risk", F.lit(5.0)).alias("avg_risk_score"),
        "high_risk_premises",
    )


def weekly_trend(licences: DataFrame) -> DataFrame:
    """Licences per week of their effective date, with the change to the week before.

    The window runs over one row per week, a table of some hundred rows, after the aggregation.
    """
    weeks = licences.groupBy(text.week_start(_effective()).alias("week_start")).agg(F.count("*").alias("n"))
    previous = weeks.select(
        (F.col("week_start") + F.expr("INTERVAL 7 DAYS")).alias("week_start"), F.col("n").alias("previous")
    )
    change = (F.col("n") - F.col("previous")) / F.col("previous") * 100
    return weeks.join(previous, "week_start", "left").select(
        "week_start", "n", F.coalesce("previous", F.lit(0)).alias("previous"), change.alias("change_percent")
    )


def weekly_header(licences: DataFrame, *, as_of) -> DataFrame:
    """Report period, totals and number of councils."""
    per_council = licences.groupBy("council_name").agg(F.count("*").alias("n"), F.count_if(_in_week(as_of)).alias("w"))
    return per_council.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_licences"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("new_licences"),
        F.count("*").alias("councils_scraped"),
        F.count_if(text.truthy(F.col("council_name"))).alias("councils_successful"),
    ).select(text.week_start(as_of).alias("period_start"), text.week_end(as_of).alias("period_end"), "*")


_EXECUTIVE = [
    ("New Licences This Week", "new_licences"),
    ("Total Licences in Database", "total_licences"),
    ("Councils Monitored", "councils_scraped"),
    ("Weekly Change", "weekly_change_percent"),
    ("Average Activities per Licence", "avg_activities_per_licence"),
    ("Premises with Operating Conditions", "premises_with_conditions"),
    ("High Risk Premises (Score ≥8)", "high_risk_premises"),
    ("Average Risk Score", "avg_risk_score"),
]


def executive_summary(licences: DataFrame, *, as_of, top: int = 5) -> DataFrame:
    """Key figures of the week as ``(section, ord, metric, value)`` rows, then the top councils of the week."""
    councils = weekly_header(licences, as_of=as_of).select("councils_scraped")
    wide = weekly_stats(licences, as_of=as_of).withColumn("councils_scraped", councils.scalar())
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(label).alias("metric"), F.col(c).cast("double").alias("value"))
            for i, (label, c) in enumerate(_EXECUTIVE, 1)
        ]
    )
    figures = wide.select(F.explode(rows).alias("r")).select(F.lit("metrics").alias("section"), "r.*")
    best = top_councils(week_of(licences, as_of), k=top).withColumnRenamed("council_name", "metric")
    # At most `top` rows, numbered by their own order.
    listed = best.select(F.collect_list(F.struct("metric", F.col("n").cast("double").alias("value"))).alias("r"))
    ranked = listed.select(F.posexplode("r").alias("ord", "e")).select(
        F.lit("top_councils").alias("section"), (F.col("ord") + 1).alias("ord"), "e.metric", "e.value"
    )
    return figures.unionByName(ranked)


def business_type_share(licences: DataFrame) -> DataFrame:
    """Licences per business type and their percentage of all."""
    total = licences.agg(F.count("*")).scalar()
    return _count(licences, _kind(), "business_type").select(
        "business_type", "n", (F.col("n") / total * 100).alias("percentage")
    ).orderBy(F.col("n").desc(), "business_type")


def weekly_business_type_share(licences: DataFrame, *, as_of) -> DataFrame:
    return business_type_share(week_of(licences, as_of))


def weekly_top_activities(licences: DataFrame, *, as_of, k: int = 10) -> DataFrame:
    """Most mentioned activities of the week, with the text shown beside them."""
    return activity_counts(week_of(licences, as_of), k=k).withColumn(
        "premises", F.concat(F.col("n").cast("string"), F.lit(" premises"))
    )


def trends(licences: DataFrame, *, as_of) -> DataFrame:
    """This week against all time as ``(metric, this_week, all_time)``, in one pass."""
    w, n_acts = _in_week(as_of), F.size(_activities())
    a = licences.agg(
        F.count_if(w).alias("w"), F.count("*").alias("a"),
        F.avg(F.when(w, _risk())).alias("wr"), F.avg(_risk()).alias("ar"),
        F.avg(F.when(w, n_acts)).alias("wa"), F.avg(n_acts).alias("aa"),
    )
    weekly = F.when(F.col("a") > 52, F.floor(F.col("a") / 52)).otherwise(F.col("a"))
    row = lambda label, this, ever: F.struct(
        F.lit(label).alias("metric"),
        F.coalesce(this.cast("double"), F.lit(0.0)).alias("this_week"),
        F.coalesce(ever.cast("double"), F.lit(0.0)).alias("all_time"),
    )
    rows = F.array(
        row("Licences per Week", F.col("w"), weekly),
        row("Average Risk Score", F.col("wr"), F.col("ar")),
        row("Avg Activities per Licence", F.col("wa"), F.col("aa")),
    )
    return a.select(F.explode(rows).alias("r")).select("r.*")


def dataset_summary(licences: DataFrame) -> DataFrame:
    """Totals and date range of the whole dataset; its business types are in :func:`business_type_share`."""
    when = text.effective_date(F.col("granted_date"), F.col("application_date"))
    out = licences.agg(
        F.count("*").alias("total_licences"),
        F.count_distinct("council_name").alias("councils_covered"),
        F.count_distinct(F.nullif(F.col("postcode"), F.lit(""))).alias("unique_postcodes"),
        F.min(when).alias("lo"),
        F.max(when).alias("hi"),
    )
    period = F.concat(text.day_text(F.col("lo")), F.lit(" to "), text.day_text(F.col("hi")))
    return out.select(
        "total_licences", "councils_covered", "unique_postcodes",
        F.when(F.col("lo").isNotNull(), period).otherwise(F.lit("Unknown")).alias("date_range"),
    )


def council_analysis(licences: DataFrame, *, as_of) -> DataFrame:
    """Per council: size, status, variety, risk, conditions, grants of the last 30 days."""
    recent = F.col("granted_date") > text.as_ntz(as_of) - F.expr("INTERVAL 30 DAYS")
    flag = lambda c: F.when(c, 1).otherwise(0)
    counts = X.facet_counts(
        licences,
        {"council_name": F.col("council_name")},
        {"type": X.one(_kind())},
        {
            "granted": flag(F.col("licence_status") == "granted"),
            "pending": flag(F.col("licence_status") == "pending"),
            "risk": _risk(),
            "with_conditions": flag(text.filled(F.col("conditions"))),
            "recent_activity": flag(recent),
        },
    )
    return (
        counts.groupBy("council_name")
        .agg(
            X.n_rows().alias("total_licences"),
            X.rows_sum("granted").alias("granted"),
            X.rows_sum("pending").alias("pending"),
            X.n_distinct("type").alias("unique_business_types"),
            (X.rows_sum("risk") / X.n_rows()).alias("avg_risk_score"),
            X.rows_sum("with_conditions").alias("with_conditions"),
            X.rows_sum("recent_activity").alias("recent_activity"),
        )
        .orderBy(F.col("total_licences").desc(), "council_name")
    )


def business_type_analysis(licences: DataFrame) -> DataFrame:
    """Per business type: size, share, risk, conditions, postcode areas, most common activity."""
    counts = X.facet_counts(
        licences,
        {"business_type": _kind()},
        {"activity": _activities(), "area": X.one(text.postcode_area(F.col("postcode")))},
        {"risk": _risk(), "n_conditions": text.count_of(F.col("conditions"))},
    )
    return (
        counts.groupBy("business_type")
        .agg(
            X.n_rows().alias("n"),
            (X.rows_sum("risk") / X.n_rows()).alias("avg_risk_score"),
            (X.rows_sum("n_conditions") / X.n_rows()).alias("avg_conditions"),
            X.n_distinct("area").alias("geographic_areas"),
            F.coalesce(X.most_common("activity"), F.lit("None")).alias("most_common_activity"),
        )
        .withColumn("percentage", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)
        .orderBy(F.col("n").desc(), "business_type")
    )


def activity_analysis(licences: DataFrame) -> DataFrame:
    """Per activity mention: count, share of all mentions, risk, councils, business types."""
    mentions = licences.select(
        "council_name", "seq", _kind().alias("business_type"), _risk().alias("risk"),
        F.explode(_activities()).alias("activity"),
    )
    counts = X.facet_counts(
        mentions,
        {"activity": F.col("activity")},
        {"council": X.one(F.col("council_name")), "type": X.one(F.col("business_type"))},
        {"risk": F.col("risk")},
    )
    return (
        counts.groupBy("activity")
        .agg(
            X.n_rows().alias("n"),
            (X.rows_sum("risk") / X.n_rows()).alias("avg_risk_score"),
            X.n_distinct("council").alias("councils"),
            X.most_common("type").alias("most_common_business_type"),
            X.n_distinct("type").alias("business_types"),
        )
        .withColumn("percentage", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)
        .orderBy(F.col("n").desc(), "activity")
    )


def geographic_analysis(licences: DataFrame) -> DataFrame:
    """Per postcode area: size, risk, distinct activities, councils and business types."""
    counts = X.facet_counts(
        licences.filter(text.truthy(F.col("postcode"))),
        {"postcode_area": text.postcode_area(F.col("postcode"))},
        {"council": X.one(F.col("council_name")), "type": X.one(_kind()), "activity": _activities()},
        {"risk": _risk()},
    )
    return (
        counts.groupBy("postcode_area")
        .agg(
            X.n_rows().alias("n"),
            (X.rows_sum("risk") / X.n_rows()).alias("avg_risk_score"),
            X.n_distinct("activity").alias("unique_activities"),
            X.n_distinct("council").alias("councils"),
            X.most_common("type").alias("most_common_business_type"),
            X.n_distinct("type").alias("business_types"),
        )
        .orderBy(F.col("n").desc(), "postcode_area")
    )


def licence_listing(licences: DataFrame) -> DataFrame:
    """The 14 columns of the licence sheets."""
    acts = _activities()
    shown = F.concat(F.array_join(F.slice(acts, 1, 3), ", "), F.when(F.size(acts) > 3, F.lit("...")).otherwise(F.lit("")))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c) if c in licences.columns else F.lit("").alias(c)
    return licences.select(
        F.col("council_name").alias("council"),
        "premises_name",
        F.col("premises_address").alias("address"),
        blank("postcode"),
        _kind().alias("business_type"),
        "licence_type",
        F.col("licence_status").alias("status"),
        text.day_text(F.col("application_date")).alias("application_date"),
        text.day_text(F.col("granted_date")).alias("granted_date"),
        shown.alias("activities"),
        F.coalesce("risk_score", F.lit(5)).alias("risk_score"),
        blank("designated_premises_supervisor").alias("dps"),
        text.count_of(F.col("conditions")).alias("conditions_count"),
        blank("source_url"),
    )


def no_licences_message(licences: DataFrame) -> DataFrame:
    """One ``message`` row when there are no licences, none otherwise."""
    return licences.select(F.lit(1)).limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit("No new licences found for this period").alias("message")
    )


def raw_export(licences: DataFrame) -> DataFrame:
    """All columns flat: lists joined by ``|``, maps as JSON, dates as ISO text, NULL as empty text."""
    has = set(licences.columns)
    col = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    plain = lambda c: F.coalesce(col(c, "string"), F.lit(""))
    joined = lambda c: F.array_join(F.coalesce(col(c, "array<string>"), F.array().cast("array<string>")), "|")
    hours = lambda c: F.when(text.filled(col(c, "map<string,string>")), F.to_json(col(c, "map<string,string>"))).otherwise(F.lit(""))
    stamp = lambda c: text.iso_text(col(c, "timestamp_ntz"))
    out = {
        "licence_id": F.col("licence_id"),
        "council": F.col("council_name"),
        "council_code": plain("council_code"),
        "premises_name": F.col("premises_name"),
        "address": F.col("premises_address"),
        "postcode": plain("postcode"),
        "business_type": _kind(),
        "licence_type": F.col("licence_type"),
        "status": F.col("licence_status"),
        "application_date": stamp("application_date"),
        "granted_date": stamp("granted_date"),
        "effective_date": stamp("effective_date"),
        "activities": joined("licensable_activities"),
        "opening_hours": hours("opening_hours"),
        "alcohol_hours": hours("alcohol_hours"),
        "dps": plain("designated_premises_supervisor"),
        "dps_licence_number": plain("dps_personal_licence_number"),
        "conditions": joined("conditions"),
        "variations": joined("variations"),
        "risk_score": F.coalesce("risk_score", F.lit(5)),
        "licence_categories": joined("licence_categories"),
        "source_url": plain("source_url"),
        "scraped_at": stamp("scraped_at"),
    }
    return licences.select(*[c.alias(name) for name, c in out.items()])
