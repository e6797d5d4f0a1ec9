"""Matching against the rules spelled out, and against a row-by-row reading of them on random names."""

import itertools

from pyspark.sql import functions as F

from hubmetrics import rules
from hubmetrics.operators import maintain as U
from hubmetrics.operators import match as X
from hubmetrics.operators import quality as Q
from hubmetrics.storage import lookup_table

STATION = "station_id string, city_code string, ridership_id string, name string, lines array<string>"
ADDISON = [("A", "Addison (Blue)", ["Blue"]), ("B", "Addison (Red)", ["Red"]), ("C", "Addison", [])]


def stations(spark, rows, ids=()):
    known = dict(ids)
    return spark.createDataFrame([(i, "x", known.get(i), n, ls) for i, n, ls in rows], STATION)


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "stationname string")


def scored(spark, rows, *values):
    found = X.scored_names(names(spark, *values), stations(spark, rows)).collect()
    return {r.stationname: (r.station_id, r.match_score) for r in found}


def test_scores(spark):
    assert scored(spark, ADDISON, "Addison-O'Hare", "Addison-North Main", "Addison", "Nowhere") == {
        "Addison-O'Hare": ("A", 3), "Addison-North Main": ("B", 3), "Addison": ("C", 4), "Nowhere": (None, 0),
    }
    assert scored(spark, ADDISON[1:2], "Addison-O'Hare", "Addison/Nowhere") == {
        "Addison-O'Hare": (None, 0), "Addison/Nowhere": ("B", 1),
    }
    assert scored(spark, ADDISON[1:], "Addison-O'Hare") == {"Addison-O'Hare": ("C", 2)}
    library = [("L", "Harold Washington Library-State/Van Buren", ["Brown"])]
    assert scored(spark, library, "Library") == {"Library": ("L", 4)}


def test_reasons(spark):
    unmatched = names(spark, "Addison-O'Hare", "Nowhere")
    got = {r.stationname: r.reason for r in X.unmatched_reasons(unmatched, stations(spark, ADDISON[1:2])).collect()}
    assert got == {
        "Addison-O'Hare": "Base name matches 'Addison (Red)' but line mismatch (expected: Blue, found: [Red])",
        "Nowhere": "No station found with matching base name",
    }


def test_two_passes_and_learning(spark):
    table = stations(spark, ADDISON, {"B": "900"})
    records = spark.createDataFrame(
        [("1", "Addison-O'Hare"), ("1", "Something else"), ("2", "Nowhere"), ("900", "Whatever")], "ridership_id string, stationname string"
    )
    got = {(r.ridership_id, r.stationname): r.station_id for r in X.match_by_score(records, table).collect()}
    assert got == {("1", "Addison-O'Hare"): "A", ("1", "Something else"): "A", ("2", "Nowhere"): None, ("900", "Whatever"): "B"}
    learned = X.learned_ids(records, table)
    assert {tuple(r) for r in U.store_learned_ids(table, learned).select("station_id", "ridership_id").collect()} == {
        ("A", "1"), ("B", "900"), ("C", None),
    }
    summary = Q.match_summary(X.match_by_score(records, table)).first()
    assert (summary.fetched, summary.inserted, summary.skipped, summary.match_rate) == (4, 3, 1, 100.0)
    assert round(summary.true_match_rate, 2) == 66.67
    more = records.unionByName(records).unionByName(spark.createDataFrame([(None, "Nowhere"), (None, None)], records.schema))
    whole = Q.match_summary(X.match_by_score(more, table)).first()
    assert Q.match_summary(X.match_by_score(X.pair_counts(more), table), rows="n").first() == whole and whole.fetched == 10


def test_exact_aliases_do_not_multiply(spark):
    names = spark.createDataFrame([("x",)] * 3 + [("y",), ("z",), (None,)], "stationname string")
    aliases = spark.createDataFrame([("x", "A")] * 4 + [("y", "A"), ("y", "B"), ("y", "B")], "alias_name string, station_id string")
    got = X.match_exact_alias(names, aliases, stations(spark, ADDISON)).collect()
    assert sorted((r.stationname or "", r.station_id or "") for r in got) == [
        ("", ""), ("x", "A"), ("x", "A"), ("x", "A"), ("y", "A"), ("y", "B"), ("z", "")]


def test_one_repeated_alias_is_dealt_over_tasks(spark):
    table = stations(spark, [("s0", "Same Name", ["Red"])])
    names = spark.createDataFrame([("Same Name",)] * 100, "stationname string").coalesce(1)
    got = X.match_exact_alias(names, X.station_aliases(table), table)
    assert got.where("station_name = 'Same Name'").count() == 100
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_stations_of_one_alias_meet_the_names_as_lists(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(X, "lookup_table", lambda df, label: kept.append(lookup_table(df, label)) or kept[-1])
    table = stations(spark, [(f"s{i:04}", "Same Name" if i % 3 else "Other Name", []) for i in range(3000)])
    aliases = spark.createDataFrame(
        [("a", f"s{i:04}") for i in range(3000)] * 2 + [("a", None), ("a", "gone"), ("b", None), (None, "s0001")],
        "alias_name string, station_id string")
    names = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "stationname string, row int")
    got = X.match_exact_alias(names, aliases, table)
    assert got.columns == ["stationname", "row", "station_id", "alias_name", "station_name"]
    own = [("a", f"s{i:04}", "Same Name" if i % 3 else "Other Name") for i in range(3000)] + [("a", None, None), ("a", "gone", None)]
    want = [("a", row, s, a, n) for row in (1, 2) for a, s, n in own] + [
        ("b", 3, None, "b", None), ("c", 4, None, None, None), (None, 5, None, None, None)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    (lists,) = kept
    assert lists.where("alias_name = 'a'").count() < 30


def test_repeated_names_do_not_multiply_rows(spark):
    many = [(f"s{i:03}", "Same Name (Red)", ["Red"]) for i in range(300)]
    records = spark.createDataFrame([(str(i), "Same Name-State") for i in range(500)], "ridership_id string, stationname string")
    assert {r.station_id for r in X.match_by_score(records, stations(spark, many)).collect()} == {"s000"}
    assert X.match_by_score(records, stations(spark, many)).count() == 500


def test_prefix_and_rules(spark):
    table = stations(spark, [("1", "Belmont (Red/Brown/Purple)", []), ("2", "Belmont Avenue West", []), ("3", "Midway", [])])
    wanted = spark.createDataFrame(
        [("B", "Belmont"), ("M", "Midway"), ("W", "Belmont Avenue"), ("N", "Belm")], "alias_name string, canonical string"
    )
    got = {r.alias_name: r.station_id for r in X.match_by_prefix(wanted, table).collect()}
    assert got == {"B": "2", "M": "3", "W": "2", "N": None}
    made = {tuple(r) for r in X.aliases_by_rule(rules.ALIAS_RULES, table).collect()}
    assert made == {("1", "Belmont-North Main", "belmont north main"), ("3", "Midway Airport", "midway airport")}
    assert X.aliases_by_rule(rules.BRANCH_ALIAS_RULES, table).count() == 0


def test_known_aliases_resolve(spark):
    table = stations(spark, [("1", "Kedzie-Homan", []), ("2", "Midway", [])])
    wanted = spark.createDataFrame(rules.KNOWN_ALIASES, "alias_name string, canonical string")
    found = {r.alias_name: r.station_id for r in X.match_by_prefix(wanted, table).where("station_id is not null").collect()}
    assert found == {"Kedzie-Homan-Forest Park": "1", "Kedzie-Lake": "1", "Homan": "1", "Midway Airport": "2"}


def test_alias_paths(spark):
    table = stations(spark, ADDISON)
    aliases = X.station_aliases(table)
    records = names(spark, "ADDISON (blue)", "Addison", "Other", "Other")
    got = sorted((r.stationname, r.station_id) for r in X.match_by_alias(records, aliases).collect())
    assert got == [("ADDISON (blue)", "A"), ("Addison", "C"), ("Other", None), ("Other", None)]
    lost = Q.unmatched_names(X.unmatched_by_alias(records, aliases)).collect()
    assert [tuple(r) for r in lost] == [("Other", 2)]
    twin = aliases.unionByName(aliases.withColumn("station_id", F.lit("Z")))
    assert X.ambiguous_aliases(twin).count() == 3


def test_scores_against_row_by_row_reading(spark):
    """All stations against all names, scored one by one as the rules say."""
    lines = [[], ["Red"], ["Blue"], ["Blue", "Green"]]
    table = [(f"{i:02}", base + tail, ls) for i, (base, tail, ls) in enumerate(
        itertools.product(["Lake", "Main St", "King"], ["", " (Red)", " (Blue)"], lines))]
    asked = [b + s for b in ["Lake", "MAIN ST.", "King", "Queen"] for s in ["", "-State", "/Milwaukee", "-Lake", "-Nothing"]]
    norm = lambda s: " ".join("".join(c for c in s.lower().replace("-", " ").replace("/", " ") if c.isalnum() or c == " ").split())
    got = scored(spark, table, *asked)
    for name in asked:
        base, suffix = name, ""
        for separator in "-/":
            if name.rfind(separator) > 0:
                base, suffix = name.rsplit(separator, 1)
                break
        line = rules.LINE_HINTS.get(suffix, "")
        best = (None, 0)
        for station, full, ls in table:
            score = 0
            if norm(full.split(" (")[0]) == norm(base):
                score = 3 if line and line in ls else 2 if not ls else 1 if not line else 0
            if norm(full) == norm(name):
                score = 4
            if score > best[1]:
                best = (station, score)
        assert got[name] == best, name


def test_hot_name_is_split_over_tasks(spark):
    """With broadcasts off, adaptive execution splits the partition of a name that most records carry."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        hot = F.when(F.col("id") % 10 < 8, F.lit("Addison")).otherwise(F.concat(F.lit("Name "), (F.col("id") % 500).cast("string")))
        records = spark.range(0, 200_000, 1, 16).select(
            F.col("id").cast("string").alias("payload"), F.lit("7").alias("ridership_id"), hot.alias("stationname")
        )
        table = stations(spark, ADDISON)
        for matched in (X.match_by_alias(records, X.station_aliases(table)), X.match_by_score(records, table)):
            found = matched.where("stationname = 'Addison'").groupBy("station_id").count().collect()
            assert [tuple(r) for r in found] == [("C", 160_000)]
            rows = matched.select("payload", "station_id")
            rows.collect()
            assert "SortMergeJoin(skew=true)" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_missing_and_blank_ids_find_by_name_and_teach_nothing(spark):
    known = stations(spark, [("s1", "Addison", ["Red"]), ("s2", "Belmont", ["Red"])])
    records = spark.createDataFrame(
        [(None, "Addison"), ("", "Belmont"), ("", "nowhere"), (None, "nowhere"), ("7", "Belmont"), ("7", "elsewhere")],
        "ridership_id string, stationname string")
    found = {(r.ridership_id, r.stationname): r.station_id for r in X.match_by_score(records, known).collect()}
    assert found == {
        (None, "Addison"): "s1", ("", "Belmont"): "s2", ("", "nowhere"): None, (None, "nowhere"): None,
        ("7", "Belmont"): "s2", ("7", "elsewhere"): "s2",
    }


def test_upsert_without_an_order_does_not_depend_on_it(spark):
    facts = spark.createDataFrame([], "station_id string, service_date date, entries long")
    rows = [("a", 9), ("a", 5)]
    for given in (rows, rows[::-1]):
        batch = spark.createDataFrame(given, "station_id string, entries long").selectExpr(
            "station_id", "DATE'2024-01-01' AS service_date", "entries").coalesce(1)
        assert [r.entries for r in U.upsert_daily(facts, batch).collect()] == [9]


def test_line_rules_ignore_case(spark):
    named = spark.createDataFrame([("Kedzie (blue)", ["X"]), ("Other", ["X"])], "name string, lines array<string>")
    found = {r.name: r.lines for r in U.assign_lines(named, [(["%(Blue)%"], ["Blue"])]).collect()}
    assert found == {"Kedzie (blue)": ["Blue"], "Other": ["X"]}


def test_many_keys_are_looked_up_without_sorting(spark, monkeypatch):
    records = spark.createDataFrame([(None, "a", 1), ("1", "a", 2), ("1", None, 3), ("2", "b", 4), ("1", "a", 5)], "i string, n string, v int")
    resolved = spark.createDataFrame([(None, "a", "A"), ("1", "a", "B"), ("1", None, "C")], "i string, n string, station_id string")
    few = X.keep_all(records, resolved, ["i", "n"])
    monkeypatch.setattr(X, "MANY_KEYS", 1)
    many = X.keep_all(records, resolved, ["i", "n"])
    assert "ShuffledHashJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, many.collect())) == sorted(map(repr, few.collect())) and many.where("station_id IS NULL").first().v == 4
