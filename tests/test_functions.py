"""Tables of inputs and expected values for the column helpers."""

import datetime

import pytest
from pyspark.sql import functions as F

from hubmetrics import rules
from hubmetrics.functions import geo as G
from hubmetrics.functions import lines as L
from hubmetrics.functions import names as N
from hubmetrics.functions import parse as P
from hubmetrics.operators import score as S


def apply(spark, values, *columns, schema="x string"):
    rows = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema).coalesce(1)
    return [tuple(r) if len(columns) > 1 else r[0] for r in rows.select(*columns).collect()]


@pytest.fixture(scope="module", autouse=True)
def column_x(spark):
    """The column all tables of values use; columns need a running session."""
    globals()["X"] = F.col("x")


def test_normalize_name(spark):
    cases = {
        "Clark/Lake": "clark lake", "O'Hare": "ohare", "Washington & Wabash": "washington and wabash",
        "Jefferson Park": "jefferson park", "O'Hare Airport": "ohare airport", "Belmont-O'Hare": "belmont ohare",
        "95th/Dan Ryan": "95th dan ryan", "Belmont (Red/Brown/Purple)": "belmont red brown purple", "Union Station": "union",
        "Stationary-Station": "stationary", "Oakton–Skokie": "oaktonskokie", "NATION_0": "nation_0", "": "", "  a \t b\n": "a b",
    }
    assert apply(spark, list(cases), N.normalize_name(X)) == list(cases.values())


def test_split_infer_strip(spark):
    cases = [
        ("Addison-O'Hare", "Addison", "O'Hare", "Blue"), ("California/Milwaukee", "California", "Milwaukee", "Blue"),
        ("Kedzie-Homan-Forest Park", "Kedzie-Homan", "Forest Park", "Blue"),
        ("Cermak-McCormick Place", "Cermak", "McCormick Place", "Green"), ("Wilson", "Wilson", "", ""), ("/Lake", "/Lake", "", ""),
        ("-Foo/Bar", "-Foo", "Bar", ""), ("Sox-35th-Dan Ryan Line", "Sox-35th", "Dan Ryan Line", ""),
        ("Main-Purple Express", "Main", "Purple Express", "Purple"),
    ]
    cut = N.split_name(X)
    got = apply(spark, [c[0] for c in cases], X, cut["base"], cut["suffix"], N.infer_line(cut["suffix"], rules.LINE_HINTS))
    assert got == cases
    parens = {"Harlem (Blue - O'Hare Branch)": "Harlem", "(Blue)": "(Blue)", "A (b) (c)": "A (b)", "Plain": "Plain"}
    assert apply(spark, list(parens), N.strip_paren(X)) == list(parens.values())


def test_parse_dates_and_counts(spark):
    day = datetime.date(2024, 1, 2)
    dates = {"01/02/2024": day, "2024-01-02": day, "1/2/2024": None, "13/45/2024": None, "2024-13-01": None, "": None,
             "02/30/2024": None, "2024-1-2": None, "2024-01-02x": None}
    assert apply(spark, list(dates), P.parse_service_date(X)) == list(dates.values())
    stamps = {"2024-01-05T00:00:00.000": datetime.date(2024, 1, 5), "2024-01-05": None, "2024-02-30T00:00:00.000": None, "x": None}
    assert apply(spark, list(stamps), P.parse_iso_day(X)) == list(stamps.values())
    counts = {" 5 ": (5, 0), "5": (5, 5), "+5": (5, 5), "-3": (-3, -3), "5.0": (None, 0), "1,000": (None, 0), "x": (None, 0),
              "": (None, 0), "99999999999999999999": (None, 0)}
    assert apply(spark, list(counts), P.parse_count(X), P.parse_count_or_zero(X)) == list(counts.values())
    places = {"41.5": 41.5, " -87.6 ": -87.6, "": None, "north": None}
    assert apply(spark, list(places), P.parse_coordinate(X)) == list(places.values())


def test_json_helpers(spark):
    shapes = {'["a"]': ("LOOKS_LIKE_JSON", False, 1), "": ("EMPTY", False, 0), None: ("NULL", False, 0), "a": ("NOT_JSON", True, 0),
              "[[1]]": ("LOOKS_LIKE_JSON", True, 1), "{}": ("NOT_JSON", True, 0)}
    got = apply(spark, list(shapes), P.json_shape(X), P.malformed_json(X), F.size(P.json_lines(X)))
    assert got == list(shapes.values())


def test_rounding(spark):
    halves = {-2.5: -2, 2.5: 3, 12.5: 13, -2.6: -3, 0.49: 0}
    assert apply(spark, list(halves), P.round_half_up(X), schema="x double") == list(halves.values())


def test_lines_from_loose_fields(spark):
    """Columns: name, lines text, lines array, line, routes array, line_summary; lines, clean name, raw text."""
    cases = [
        # separators, one rule each; the order of the result is the fixed one
        ("Ash", "Pink/Red", None, None, None, None, ["Red", "Pink"], "Ash", "Pink/Red"),
        ("Ash", "Pink, Green", None, None, None, None, ["Green", "Pink"], "Ash", "Pink, Green"),
        ("Ash", "Orange and Red", None, None, None, None, ["Red", "Orange"], "Ash", "Orange and Red"),
        # an alias, alone and beside the line it stands for
        ("Elm", None, ["Purple Express", "Purple"], None, None, None, ["Purple"], "Elm", None),
        # repeats in any case, and words that are no line
        ("Fir", None, ["pink", "PINK", "Pink", "Mauve"], None, None, None, ["Pink"], "Fir", None),
        ("Fir", "Mauve", None, None, None, None, [], "Fir", "Mauve"),
        # a line in parentheses leaves the name, another word stays
        ("Oak (Pink)", None, None, None, None, None, ["Pink"], "Oak", "Pink"),
        ("Oak (Depot)", None, ["Green"], None, None, None, ["Green"], "Oak (Depot)", None),
        ("Oak (Orange)", None, ["Green"], None, None, None, ["Green", "Orange"], "Oak", "Orange"),
        # the other fields
        ("Yew", None, None, "Brown", None, None, ["Brown"], "Yew", "Brown"),
        ("Yew", None, None, None, ["Yellow", "Blue"], None, ["Blue", "Yellow"], "Yew", None),
        ("Yew", None, None, None, None, "Green/Pink", ["Green", "Pink"], "Yew", "Green/Pink"),
        # nothing
        ("Yew", None, [], None, None, None, [], "Yew", None),
        (None, None, None, None, None, None, [], "", None),
    ]
    texts, arrays = "name string, lines {}, line string, routes array<string>, line_summary string", []
    for kind, at in (("string", 1), ("array<string>", 2)):
        rows = [c for c in cases if c[3 - at] is None and (at == 2 or c[1] is not None)]
        df = spark.createDataFrame([(c[0], c[at], c[3], c[4], c[5]) for c in rows], texts.format(kind)).coalesce(1)
        got = L.normalize_station_lines(df).select("station_lines", "clean_name", "raw_line_text").collect()
        assert [tuple(r) for r in got] == [c[6:] for c in rows]
        arrays += rows
    assert {id(c) for c in arrays} == {id(c) for c in cases}


def test_name_contains_line(spark):
    names = {"Chicago": False, "Howard": False, "Station (Terminal)": False, "Test (Red)": True, "A (x) (Red)": False}
    assert apply(spark, list(names), L.name_contains_line(X)) == list(names.values())


def test_line_order_filter_search(spark):
    lines = F.split(X, ",")
    assert apply(spark, ["Pink,Mauve,Red,Blue"], L.canonical_order(lines)) == [["Mauve", "Red", "Blue", "Pink"]]
    assert apply(spark, ["Red,Blue", "Pink"], L.any_line_active(lines, ["Blue"])) == [True, False]
    assert apply(spark, ["Red", "Lake"], L.search_match(X, F.array(F.lit("Blue")), "LAK")) == [False, True]
    assert apply(spark, ["Red"], L.search_match(X, F.array(F.lit("Blue")), "lu")) == [True]
    assert apply(spark, ["Red"], L.search_match(X, F.array(F.lit("Blue")), "")) == [True]
    described = {"Pink Line": ["Pink", "Purple"], "Green and Yellow": ["Green", "Yellow"], "brn": []}
    assert apply(spark, list(described), L.described_lines(X)) == list(described.values())
    strict = {"Pink Line": ["Pink"], "G, Brn": ["Brown", "Green"]}
    assert apply(spark, list(strict), L.described_lines(X, strict=True)) == list(strict.values())
    assert apply(spark, ["Austin-Blue", "Harlem-O'Hare", "Plain", "A-b"], L.suffix_line(X)) == ["Blue", "Blue", None, None]


def test_geometry(spark):
    schema = "a double, b double, c double, d double"
    p, q = G.point(F.col("a"), F.col("b")), G.point(F.col("c"), F.col("d"))
    rows = [(-87.63, 41.88, -87.62, 41.88), (-87.63, 41.88, -87.63, 41.89)]
    assert apply(spark, rows, F.round(G.haversine_m(p, q), 3), schema=schema) == [827.896, 1111.949]
    rows = [(-87.700001, 41.9, -87.71, 41.95), (-87.71, 41.95, -87.700001, 41.9)]
    assert len(set(apply(spark, rows, G.segment_key(p, q), schema=schema))) == 1
    coarse = apply(spark, [(-87.63004, 41.88004, -87.63104, 41.88104)], G.segment_key(p, q), schema=schema)
    assert coarse == ["-87.63100,41.88100_-87.63000,41.88000"]
    straight = apply(spark, [(0.0, 1.0, 3.0, 4.0)], G.line_distance(p, G.point(F.lit(0.0), F.lit(0.0)), G.point(F.lit(2.0), F.lit(0.0))), schema=schema)
    assert straight == [1.0]


def test_corridor(spark):
    cases = {
        "Brown,Purple": "North Main", "Brown,Pink,Purple": "Loop", "Green,Red": "South Side", "Blue,Pink": "Forest Park",
        "Green,Pink": "West Side", "Blue,Red": "Shared", "Red": "Red", "Blue,Brown,Purple": "North Main",
    }
    assert apply(spark, list(cases), G.corridor(F.split(X, ","))) == list(cases.values())


def test_bands_and_texts(spark):
    assert apply(spark, [80, 79, 60, 40, 20, 19, -1], S.score_band(X), schema="x int") == [1, 2, 2, 3, 4, 5, 5]
    assert apply(spark, [81, 80, 60, 40], S.score_band(X, True, (80, 60, 40)), schema="x int") == [1, 2, 3, 4]
    less = S.percent_less(F.lit(100.0), X)
    texts = apply(spark, [75.0, 200.0, 0.0, None], S.comparison_text(less), schema="x double")
    assert texts[0] == "This station has 25% less ridership than the system average"
    assert texts[1].startswith("This station has -100% less") and texts[2:] == ["No ridership data available"] * 2


@pytest.mark.parametrize("values", [("a", "b"), ("b", "a")])
def test_surrogate_key_is_stable(spark, values):
    once = apply(spark, [values], N.surrogate_key(F.col("x"), F.col("y")), schema="x string, y string")
    assert once == apply(spark, [values], N.surrogate_key(F.col("x"), F.col("y")), schema="x string, y string")
