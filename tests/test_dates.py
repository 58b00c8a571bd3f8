"""Dates in texts that follow the rules one by one, on a fixed day."""

from __future__ import annotations

from datetime import date
from itertools import product

import pytest

from docloom.functions.dates import LABELS, LEFT, RIGHT, extract_dates, found_dates, labelled_dates

TODAY = date(2019, 9, 30)
FAR = "lorem ipsum dolor sit amet consectetur " * 2


def labels(text, *more):
    found = extract_dates(text, TODAY, more)
    return {k: str(v) for k, v in found.items() if v and k != "identified_dates"}, len(found["identified_dates"])


@pytest.mark.parametrize("name", LABELS)
def test_every_phrase_labels_the_date_behind_it(name):
    for phrase in LABELS[name]:
        told = phrase.replace(r"\b", "").replace("\\", "")
        for sign in (" ", ": ", " on ", "\n"):
            assert extract_dates(f"{told}{sign}11/17/2018", TODAY)[name] == date(2018, 11, 17), told


@pytest.mark.parametrize(
    ("text", "expected", "n"),
    [
        # the nearest phrase, before or a little behind
        ("The tariff was posted 3/9/2015 and revised 6/21/2017.", {"published_date": "2015-03-09", "last_updated_date": "2017-06-21"}, 2),
        ("Sheet of 14 March 2016 (issued), renewed", {"published_date": "2016-03-14"}, 1),
        ("current as of 2018-07-02; expires 2020-08-01; annual review in 10/2020", {"last_updated_date": "2018-07-02", "end_date": "2020-08-01", "next_review_date": "2020-10-01"}, 3),
        # behind another date a phrase belongs to the date that follows
        ("7/7/2011 devised 8/8/2012", {"published_date": "2012-08-08"}, 2),
        # a label on the line before
        ("Latest review took place on\n5.19.2014", {"last_reviewed_date": "2014-05-19"}, 1),
        # the latest past date of two that are labelled alike, the earliest of ends, and effective dates by their nearness to the day
        ("version 2/2/2010\nversion 4/4/2013\nversion 1/1/2012", {"last_updated_date": "2013-04-04"}, 3),
        ("through 12/30/2020\nthrough 6/29/2020\nthrough 6/29/2021", {"end_date": "2020-06-29"}, 2),
        ("eff 1/1/2001\neff 10/1/2019\neff 1/1/2012", {"effective_date": "2019-10-01"}, 3),
        # a nearer label goes before a farther one
        (f"updated {FAR}9/9/2016\nupdated 3/3/2009", {"last_updated_date": "2009-03-03"}, 2),
        # two dates with a dash between, of any kind, whatever stands around
        ("rates 2/3/2014 - 4/5/2016 apply", {"effective_date": "2014-02-03", "end_date": "2016-04-05"}, 2),
        ("rates June 2011 – August 2012", {"effective_date": "2011-06-01", "end_date": "2012-08-01"}, 2),
        ("rates November 4 — December 6, 2013", {"effective_date": "2013-11-04", "end_date": "2013-12-06"}, 2),
        ("rates August 9 \xad October 2, 2017", {"effective_date": "2017-08-09", "end_date": "2017-10-02"}, 2),
        # dates of a list share the label of the first
        ("Reviewed 1/4/2011, 2/5/2012 and 3/6/2013", {"last_reviewed_date": "2013-03-06"}, 3),
        # a line that ends in a comma goes on
        ("Publication date,\n8/23/2017", {"published_date": "2017-08-23"}, 1),
    ],
)
def test_labels(text, expected, n):
    found, count = labels(text)
    assert {k: found.get(k) for k in expected} == expected
    assert count == n


def test_labels_that_are_none():
    assert "published_date" not in labels(f"8/8/2016 {'x ' * RIGHT} issued")[0]
    assert "end_date" not in labels("breakthrough 4/7/2018")[0]  # within a word
    assert "end_date" not in labels("3/3/2011 - or else 4/4/2012")[0]  # more than a dash
    assert "last_reviewed_date" not in labels("reviewed 10/1/2019")[0]  # to come
    assert labels("room 88, call 4417009921345") == ({}, 0)
    assert LEFT > RIGHT


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


@pytest.mark.parametrize(
    "form",
    ["{y}-{m:02}-{d:02}", "{y}.{m}.{d}", "{y}/{m:02}/{d:02}", "{y}|{m}|{d}", "{m:02}-{d:02}-{y}", "{m}/{d}/{y}", "{m}.{d:02}.{s:02}", "{m}|{d}|{s:02}", "{N} {d}, {y}", "{N} {d}th {y}", "{n} {d} {y}", "{n}. {d:02}, {y}", "{d} {N} {y}", "{d:02} {n}. {y}", "{m:02}{d:02}{y}", "{y}{m:02}{d:02}", "{m:02}{d:02}{s:02}"],
)
def test_every_format_of_a_day(form):
    for m, (y, d) in product(range(1, 13), ((1999, 23), (2014, 27))):
        if y > 1999 or "{s" not in form:
            told = form.format(y=y, s=y % 100, m=m, d=d, N=MONTHS[m - 1], n=MONTHS[m - 1][:3])
            assert found_dates(f"(see {told})") == [(5, 5 + len(told), date(y, m, d))], told


@pytest.mark.parametrize("form", ["{m:02}/{y}", "{m}-{y}", "{m}.{y}", "{m:02}|{y}", "{N} {y}", "{N}, {y}", "{n}. {y}", "{m}/{s:02}", "{m:02}-{s:02}", "{y}{n}", "{y}{m:02}", "{m:02}{y}"])
def test_every_format_of_a_month(form):
    for m in range(1, 13):
        told = form.format(y=2016, s=16, m=m, N=MONTHS[m - 1], n=MONTHS[m - 1][:3])
        assert [x[2] for x in found_dates(f"in {told} again")] == [date(2016, m, 1)], told


def test_what_is_no_date():
    assert found_dates("doses of 12/15 mg, $ 7/12, 9/11% a year, 31/31/2011, 7/1980, 2/30/2015, 77777777") == []
    assert labels("OMB approval until 6/6/2018\nrow 7|19|18")[1] == 1
    assert labels("12/5/2016 first\n  REFERENCES:\nupdated 1/2/2017")[1] == 1
    assert labels("the references of 2011\nrevised 5/5/2015")[0]["last_updated_date"] == "2015-05-05"


def test_fallbacks_of_the_effective_date():
    assert labels("none", "Catalogue of May 2017")[0] == {"effective_date": "2017-05-01"}
    assert labels("Bulletin, Q4 2014") == ({"effective_date": "2014-10-01"}, 1)
    assert labels(f"Bulletin 7/8/2016\n{FAR * 3}\n3/4/2012")[0] == {"effective_date": "2016-07-08"}
    assert labels(f"{FAR * 3}\n11/12/2013")[0] == {"effective_date": "2013-11-12"}
    assert labels(f"{FAR * 3}\n11/12/2013 1/2/2014")[0] == {}
    assert labels("Fees 2015 and rules")[0] == {"effective_date": "2015-01-01"} and labels(f"{FAR * 3}\nyear 2015")[1] == 0


def test_quarters_stand_for_their_first_days():
    told = {"1st quarter 2013": (2013, 1), "Q2 2018": (2018, 4), "the third qtr of 2009": (2009, 7), "2011, quarter 4": (2011, 10)}
    for text, (year, month) in told.items():
        assert extract_dates(text, TODAY)["identified_dates"] == [date(year, month, 1)]
    assert extract_dates("2010: Q3, 2012: Q1", TODAY)["identified_dates"] == [date(2010, 1, 1), date(2012, 7, 1)]


def test_dates_as_a_column(spark):
    rows = [(1, "revised 4/13/2016"), (2, None), (3, ""), (4, "without a digit"), (5, "y 7/4/2015 " * 4000)]
    df = spark.createDataFrame(rows, "k long, text string")
    out = {r.k: r.d for r in df.select("k", labelled_dates("text", str(TODAY)).alias("d")).collect()}
    assert str(out[1].last_updated_date) == "2016-04-13" and str(out[5].identified_dates[0]) == "2015-07-04"
    assert all(out[k].effective_date is None and out[k].identified_dates == [] for k in (2, 3, 4))
