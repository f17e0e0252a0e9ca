"""Hand-made ingredient lines, quantities and pages."""

import pytest

from larder.functions import lines, quantities as Q, text as T
from larder.functions.dialect import SPARK
from larder.sources import payloads

LINES = [
    ("2 cups oat flour, sifted", 2, 2, "cup", "oat flour", "sifted", None, False),
    ("1½ lbs. carrots", 1.5, 1.5, "pound", "carrots", None, None, False),
    ("3-4 Cloves garlic (about a tablespoon), minced", 3, 4, "clove", "garlic", "minced", "about a tablespoon", False),
    ("salt to taste", None, None, None, "salt", "to taste", None, False),
    ("1 c. milk (optional)", 1, 1, "cup", "milk", None, None, True),
    ("freshly ground black pepper", None, None, None, "black pepper", "freshly ground", None, False),
    ("1 1/2 to 2 tbsp honey", 1.5, 2, "tablespoon", "honey", None, None, False),
    ("4 lemons, juice only", 4, 4, None, "lemons, juice only", None, None, False),
    ("", None, None, None, "", None, None, False),
]


def test_parse_lines(spark):
    df = spark.createDataFrame([(k, x[0]) for k, x in enumerate(LINES)], "k int, raw string")
    df.createOrReplaceTempView("raws")
    got = {r.k: tuple(r)[1:] for r in spark.sql(lines.parsed(SPARK, "select * from raws", "k")).collect()}
    for k, (_, *want) in enumerate(LINES):
        assert list(got[k]) == want, LINES[k][0]


@pytest.mark.parametrize("x, shown", [("0.5", "1/2"), ("1.5", "1 1/2"), ("2.0", "2"), ("1.7", "1.7"), ("0.333", "1/3"), ("2.99", "3"), ("0", "0")])
def test_format_quantity(spark, x, shown):
    assert spark.sql(f"select {Q.format_quantity(f'cast({x} as double)')}").first()[0] == shown


@pytest.mark.parametrize("qty, unit, best", [(0.25, "cup", "cup"), (48, "teaspoon", "cup"), (16, "ounce", "pound"), (2, "clove", "clove"), (0.0625, "cup", "tablespoon")])
def test_best_unit(spark, qty, unit, best):
    assert spark.sql(f"select {Q.best_unit(f'cast({qty} as double)', repr(unit))}").first()[0] == best


@pytest.mark.parametrize("x, want", [("berries", "berry"), ("halves", "half"), ("tomatoes", "tomato"), ("bunches", "bunch"), ("hummus", "hummus"), ("Eggs ", "egg"), ("gas", "gas")])
def test_name_key(spark, x, want):
    assert spark.sql(f"select {Q.name_key(repr(x))}").first()[0] == want


def test_durations(spark):
    assert spark.sql(f"select {T.iso_minutes(SPARK, repr('P1DT2H5M40S'))}").first()[0] == 1440 + 125 + 1
    assert spark.sql(f"select {T.informal_minutes(SPARK, repr('1.5 hr 30 min'))}").first()[0] == 120
    assert spark.sql(f"select {T.informal_minutes(SPARK, repr('soon'))}").first()[0] is None


def test_unsafe_urls(spark):
    for url, unsafe in (("http://192.168.1.4/", True), ("https://a.example.com/x", False), ("ftp://a.example.com", True), ("x", True), ("http://localhost:80/", True)):
        assert spark.sql(f"select {T.is_unsafe(SPARK, repr(url))}").first()[0] is unsafe


def test_archives_skip_bad_members():
    import gzip

    whole = gzip.compress(b'{"name": "a"}') + b"noise" + gzip.compress(b"not json") + gzip.compress(b'{"name": "b"}')
    assert payloads.members(whole) == ['{"name": "a"}', '{"name": "b"}']
    assert payloads.members(b"") == []
