"""Completeness score, business type, categories and risk as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from licensum import vocab
from licensum.functions.text import contains_any, count_of, filled, let, truthy


def completeness_score() -> Column:
    """How complete a licence row is; granted licences and dated rows weigh most."""
    points = lambda cond, n: F.when(cond, F.lit(n)).otherwise(F.lit(0))
    return (
        points(F.col("granted_date").isNotNull(), 10)
        + points(F.col("application_date").isNotNull(), 5)
        + points(truthy(F.col("postcode")), 3)
        + points(truthy(F.col("designated_premises_supervisor")), 2)
        + count_of(F.col("licensable_activities"))
        + F.floor(count_of(F.col("conditions")) / 2).cast("int")
        + points(filled(F.col("opening_hours")), 2)
        + points(F.col("licence_status") == "granted", 5)
    )


def lowered(activities: Column) -> Column:
    return F.transform(F.coalesce(activities, F.array().cast("array<string>")), F.lower)


def business_type(
    name: Column,
    activities: Column,
    words=vocab.BUSINESS_TYPE_WORDS,
    needs=vocab.TAKEAWAY_NEEDS,
    excludes=vocab.TAKEAWAY_EXCLUDES,
) -> Column:
    takeaway = lambda acts: F.array_contains(acts, needs) & ~F.array_contains(acts, excludes)

    def cascade(low):
        (label, label_words), *others = words
        branch = F.when(contains_any(low, label_words), F.lit(label))
        for label, label_words in others:
            branch = branch.when(contains_any(low, label_words), F.lit(label))
        return branch.when(let(lowered(activities), takeaway), F.lit("Takeaway")).otherwise(F.lit("Other"))

    return let(F.lower(name), cascade)


def any_activity(acts: Column, words) -> Column:
    """True when any of the lower-cased activities contains one of the words."""
    return F.exists(acts, lambda a: contains_any(a, words))


def categories(activities: Column, words=vocab.CATEGORY_WORDS, default=vocab.DEFAULT_CATEGORY) -> Column:
    hits = lambda acts: F.filter(
        F.array(*[F.when(any_activity(acts, w), F.lit(label)) for label, w in words]), lambda x: x.isNotNull()
    )
    named = lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))
    return let(let(lowered(activities), hits), named)


def risk_score(kind: Column, activities: Column, conditions: Column) -> Column:
    """Base 5, moved by late refreshment, music or dance, kind of business and number of conditions; 1 to 10."""
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    of_activities = lambda acts: (
        points(F.array_contains(acts, vocab.TAKEAWAY_NEEDS), 1) + points(any_activity(acts, ["music", "dance"]), 1)
    )
    total = (
        F.lit(5)
        + let(lowered(activities), of_activities)
        + points(kind.isin("Club", "Bar"), 2)
        + points(kind == "Takeaway", 1)
        + points(kind.isin("Hotel", "Restaurant"), -1)
        + points(count_of(conditions) > 5, -1)
    )
    return F.greatest(F.lit(1), F.least(F.lit(10), total))
