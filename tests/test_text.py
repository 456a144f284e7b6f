from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from licensum.functions import text

C = F.col("c")


@pytest.mark.parametrize(
    "value, expected",
    [("  a \tb &amp;lt; c\u0001 ", "a b < c"), (None, ""), ("", ""), ("a\xa0 b", "a b"), ("\x1c x\x1fy", "x y"), ("&nbsp;&nbsp;a", "a")],
)
def test_clean_text(one, value, expected):
    assert one(text.clean_text(C), value) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("1 St John's Rd", "1 Street John's Road"), ("2 East Drive", "2 East Drive"), ("3 the ct, Sq", "3 the Court, Square"), (None, "")],
)
def test_clean_address(one, value, expected):
    assert one(text.clean_address(C), value) == expected


@pytest.mark.parametrize("value, expected", [("12 high street w1d2ht", "W1D 2HT"), ("FLAT1 2AB", "AT1 2AB"), ("none", None), (None, None), ("x M1  1JQ y", "M1 1JQ")])
def test_extract_postcode(one, value, expected):
    assert one(text.extract_postcode(C), value) == expected


@pytest.mark.parametrize("value, expected", [("Dr. MARIA o'neil Jr.", "Maria O'Neil"), ("mr john V smith-jones", "John Smith-Jones"), ("Sir", "")])
def test_clean_person_name(one, value, expected):
    assert one(text.clean_person_name(C), value) == expected


@given(st.text(alphabet="aBc é'ß3-x ", max_size=20))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_title_case_is_str_title(one, value):
    assert one(text.title_case(C), value) == value.title()


def test_clean_activities(one):
    given_ = ["Supply of alcohol", "retail sale of alcohol", "quiz night", "quiz night", "darts"]
    assert one(text.clean_activities(C), given_, "array<string>") == ["Sale of Alcohol", "Quiz Night", "Quiz Night"]
    assert one(text.clean_activities(C), None, "array<string>") == []


def test_standardize_hours(one):
    hours = {"mon": "11:00-23:00", "Monday ": "12:00-22:00", "bank holiday": "", "sun": " 12:00  - 21:00 "}
    assert one(text.standardize_hours(C), hours, "map<string,string>") == {"Monday": "12:00-22:00", "Sunday": "12:00 - 21:00"}
    assert one(text.standardize_hours(C), {}, "map<string,string>") == {}
    assert one(text.standardize_hours(C), None, "map<string,string>") is None


@pytest.mark.parametrize("value, expected", [("The Red Lion Pub Ltd.", "red lion"), ("Bathe Inn", "bainn"), ("  A\xa0 B! ", "a b"), (None, "")])
def test_normalize_for_matching(one, value, expected):
    assert one(text.normalize_for_matching(C), value) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("31/02/2024", None), ("5 JANUARY 2024", datetime(2024, 1, 5)), ("2024-01-05T00:00:00", None), (" 2024-1-5 ", datetime(2024, 1, 5)),
        ("May 3, 2024", datetime(2024, 5, 3)), ("March 3, 2024", datetime(2024, 3, 3)), ("3  Mar\t2024", datetime(2024, 3, 3)), ("", None), (None, None),
        ("001/02/2024", None),
    ],
)
def test_parse_date(one, value, expected):
    assert one(text.parse_date(C), value) == expected


@pytest.mark.parametrize("value, expected", [("not granted", "granted"), ("", "pending"), (None, "pending"), ("Under Review", "under_review")])
def test_map_licence_status(one, value, expected):
    assert one(text.map_licence_status(C), value) == expected


@pytest.mark.parametrize("value, expected", [("Minor VARIATION review", "variation"), (None, "new"), ("x", "new")])
def test_map_licence_type(one, value, expected):
    assert one(text.map_licence_type(C), value) == expected


def test_week_and_iso(one):
    when = datetime(2024, 6, 12, 10, 30, 0, 500)
    assert one(text.week_start(C), when, "timestamp_ntz") == datetime(2024, 6, 10)
    assert one(text.week_end(C), datetime(2024, 6, 16, 23, 59), "timestamp_ntz") == datetime(2024, 6, 17)
    assert one(text.iso_text(C), when, "timestamp_ntz") == when.isoformat()
    assert one(text.iso_text(C), datetime(2024, 6, 12), "timestamp_ntz") == "2024-06-12T00:00:00"


def test_truncate(one):
    assert one(text.truncate(C, 3), "abcd") == "abc..."
    assert one(text.truncate(C, 4), "abcd") == "abcd"
    assert one(text.truncate(C, 3, ""), "abcd") == "abc"
