from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from licensum.operators import clean, enrich, facets, reports, resolve
from licensum.plans.processing import process_licences
from licensum.schemas import LICENCE

AS_OF = datetime(2024, 6, 12)
DAYS = lambda n: AS_OF - timedelta(days=n)


def licence(seq, name="Some Premises", address="12 Long Street, Leeds", **over):
    row = dict.fromkeys(LICENCE.names)
    row |= {
        "licence_id": f"L{seq}", "council_name": "Leeds City Council", "premises_name": name, "premises_address": address,
        "licence_type": "new", "licence_status": "granted", "licensable_activities": [], "conditions": [], "variations": [],
        "scraped_at": AS_OF, "seq": seq,
    } | over
    return row


def table(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in LICENCE.names) for r in rows], LICENCE)


@pytest.fixture
def demo(spark):
    alcohol, live, recorded = "Sale of Alcohol", "Live Music", "Recorded Music"
    return table(
        spark,
        [
            licence(0, "Velvet Fox", council_name="Exeter City Council", postcode="EX1 9ZZ", application_date=DAYS(30), granted_date=DAYS(15), licensable_activities=[alcohol, live, recorded], conditions=["Music stops at ten in the evening", "At most sixty guests at a time"]),
            licence(1, "Marble Spoon", council_name="Camden Council", postcode="NW5 9ZZ", application_date=DAYS(45), granted_date=DAYS(20), licensable_activities=[alcohol, "Late Night Refreshment"], conditions=["Vans may unload from nine onwards"]),
            licence(2, "Moonlight Club", council_name="Norwich City Council", postcode="NR2 9ZZ", application_date=DAYS(60), granted_date=DAYS(35), licensable_activities=[alcohol, live, recorded, "Performance of Dance"], conditions=["a" * 11, "b" * 11, "c" * 11]),
            licence(3, "Olive Grove Restaurant", council_name="Derby City Council", postcode="DE1 9ZZ", licence_type="variation", licence_status="pending", application_date=DAYS(10), licensable_activities=[alcohol, live], conditions=["Drinks are served at tables only"]),
            licence(4, "Daily Basket", postcode="LS9 9ZZ", application_date=DAYS(25), granted_date=DAYS(5), licensable_activities=[alcohol], conditions=["Spirits are kept behind the counter", "Staff training twice a year"]),
        ],
    )


def test_demo_enrichment(demo):
    rows = enrich.enrich_licences(demo).orderBy("seq").collect()
    assert [r.business_type for r in rows] == ["Other", "Other", "Club", "Restaurant", "Other"]
    assert [r.risk_score for r in rows] == [6, 6, 8, 5, 5]
    assert [r.licence_categories for r in rows] == [
        ["Alcohol", "Entertainment"], ["Alcohol", "Late Night Refreshment"], ["Alcohol", "Entertainment"], ["Alcohol", "Entertainment"], ["Alcohol"],
    ]


def test_demo_reports(demo):
    enriched = enrich.enrich_licences(demo)
    stats = reports.weekly_stats(enriched, as_of=AS_OF).first()
    assert (stats.new_licences, stats.weekly_change_percent, stats.avg_risk_score) == (0, -100.0, 5.0)
    recent = {r.council_name for r in reports.council_analysis(enriched, as_of=AS_OF).collect() if r.recent_activity}
    assert recent == {"Exeter City Council", "Camden Council", "Leeds City Council"}
    assert reports.no_licences_message(reports.week_of(enriched, AS_OF)).count() == 1
    assert reports.no_licences_message(enriched).count() == 0


def test_cleaning_takes_postcode_from_address(demo):
    assert clean.clean_licences(demo).filter("postcode IS NOT NULL").count() == 0
    assert clean.clean_licences(demo, keep_supplied_postcode=True).filter("postcode IS NULL").count() == 0


@pytest.mark.parametrize(
    "over, reasons",
    [
        ({"application_date": AS_OF + timedelta(days=30)}, 0),
        ({"application_date": AS_OF + timedelta(days=30, microseconds=1)}, 1),
        ({"granted_date": AS_OF + timedelta(days=31)}, 1),
        ({"name": "Research Arms"}, 1),
        ({"name": "AB"}, 1),
        ({"address": " 1 St    "}, 1),
        ({"council_name": ""}, 1),
        ({"name": None, "address": None}, 2),
    ],
)
def test_rules(spark, over, reasons):
    df = table(spark, [licence(1, **over)])
    checked = clean.check_licences(df, as_of=AS_OF)
    assert len(checked.first().reject_reasons) == reasons
    assert clean.valid_licences(df, as_of=AS_OF).count() == (reasons == 0)
    assert clean.quarantined_licences(df, as_of=AS_OF).count() == (reasons > 0)


def test_equal_scores_go_to_the_lowest_seq(spark):
    out = resolve.resolve_entities(table(spark, [licence(7), licence(3)])).first()
    assert (out.seq, out.first_seq, out.copies) == (3, 3, 2)


def test_better_copy_wins_and_order_is_of_the_key(spark):
    out = resolve.resolve_entities(table(spark, [licence(3), licence(7, granted_date=DAYS(3))])).first()
    assert (out.seq, out.first_seq) == (7, 3)


def many(spark, n=3000):
    # A third of all rows is one premises.
    rows = [
        licence(i, "The Hot Spot" if i % 3 == 0 else f"Place {i % 97}", f"{i % 5 if i % 3 else 1} Long Street, Leeds", granted_date=DAYS(i % 50) if i % 2 else None)
        for i in range(n)
    ]
    return table(spark, rows)


def test_resolution_does_not_depend_on_partitioning(spark):
    df = many(spark)
    key = ["match_key", "seq", "first_seq", "copies"]
    once = resolve.resolve_entities(df.repartition(1)).select(key)
    spread = resolve.resolve_entities(df.repartition(64)).select(key)
    assert sorted(once.collect()) == sorted(spread.collect())


def test_resolution_can_be_merged_and_repeated(spark):
    df = resolve.with_score(resolve.with_match_key(many(spark)))
    whole = resolve.best_per_key(df)
    parts = resolve.best_per_key(df.filter("seq % 2 = 0")).unionByName(resolve.best_per_key(df.filter("seq % 2 = 1")))
    cols = ["match_key", "seq", "first_seq", "copies"]
    assert sorted(resolve.best_per_key(parts).select(cols).collect()) == sorted(whole.select(cols).collect())
    assert sorted(resolve.best_per_key(whole).select(cols).collect()) == sorted(whole.select(cols).collect())


def test_drop_exact_copies_is_first_and_per_council(spark):
    rows = [licence(5, " HOT Spot"), licence(2, "hot spot "), licence(1, "hot spot", council_name="Other Council")]
    assert sorted(r.seq for r in resolve.drop_exact_copies(table(spark, rows)).collect()) == [1, 2]


def test_most_common_tie_goes_to_first_seen(spark):
    df = spark.createDataFrame([("g", "b", 0), ("g", "a", 1), ("g", "b", 2), ("g", "a", 3)], "g string, v string, seq long")
    assert facets.most_common_per_group(df, "g", "v").first().most_common == "b"


def test_business_type_cascade(spark):
    names = ["Dinner Place", "Barber Shop", "Harbour Bar", "Kebab House"]
    acts = [[], [], [], ["Late Night Refreshment"]]
    df = table(spark, [licence(i, n, licensable_activities=a) for i, (n, a) in enumerate(zip(names, acts))])
    assert [r.business_type for r in enrich.enrich_licences(df).orderBy("seq").collect()] == ["Pub", "Bar", "Bar", "Takeaway"]


def test_reports_on_empty_data(spark):
    empty = enrich.enrich_licences(table(spark, []))
    for report in (reports.activity_analysis, reports.geographic_analysis, reports.business_type_analysis, reports.date_range):
        assert report(empty).count() == 0
    assert reports.dataset_summary(empty).first().date_range == "Unknown"
    assert reports.weekly_stats(empty, as_of=AS_OF).first().weekly_change_percent == 0.0


def test_process_keeps_every_premises(spark):
    out = process_licences(many(spark), as_of=AS_OF)
    assert out.agg(F.sum("copies")).first()[0] == 3000


@pytest.mark.parametrize("value", [None, "", "plain", "it's", 'it\'s "x"', "a\tb\nc\r\\", "\x00\x1f\x7f\x85\xa0\xad", "zero\u200bwidth \u2028 \ufeff", "e\u0301 \U0001f600 \U000e0001", "日本 ü"])
def test_printed_length(one, value):
    from licensum.operators.councils import printed_length

    assert one(printed_length(F.col("c")), value) == len(repr(value))
