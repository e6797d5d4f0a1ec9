"""Resolving free-text names to stations.

No operator compares names pairwise. The station side is reduced to one best station per lookup key first, so every join
has a unique side and its result is as large as its input, however often a name or a normal form repeats.
Among stations that fit equally well the smallest id wins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubmetrics import rules
from hubmetrics.functions.lines import contains_line
from hubmetrics.functions.names import infer_line, normalize_name, split_name, strip_paren
from hubmetrics.storage import lookup_table, materialize

#: From this many keys on ``keep_all`` looks them up in a hash table for each partition, and neither side is sorted.
MANY_KEYS = 1_000_000

#: Into how many parts the names of one spelling are dealt where each meets all stations of its alias.
DEALS = 16

#: So many stations of one alias and one name at most are one row, with a list of ids, until they meet the names.
LISTED = 1024

NO_BASE = "No station found with matching base name"


def station_aliases(stations: DataFrame) -> DataFrame:
    """Each station's own name as an alias."""
    return stations.select("station_id", F.col("name").alias("alias_name"), normalize_name(F.col("name")).alias("normalized"))


def alias_index(aliases: DataFrame) -> DataFrame:
    """One station per normal form, and how many stations share it."""
    return aliases.groupBy("normalized").agg(
        F.min("station_id").alias("station_id"), F.count_distinct("station_id").alias("n_stations")
    )


def ambiguous_aliases(aliases: DataFrame) -> DataFrame:
    return alias_index(aliases).where(F.col("n_stations") > 1)


def _resolve(records: DataFrame, name: str, keys: Mapping[str, Column], index: DataFrame) -> DataFrame:
    """Look up each distinct name once and join the outcome back."""
    names = records.select(name).distinct().withColumns(dict(keys))
    resolved = names.join(lookup_table(index, "index"), list(keys), "left").drop(*keys)
    return records.join(lookup_table(resolved, "names"), name, "left")


def match_by_alias(records: DataFrame, aliases: DataFrame, name: str = "stationname") -> DataFrame:
    """Add the matched ``station_id``, NULL where no alias has the record's normal form."""
    index = alias_index(aliases).select("normalized", "station_id")
    return _resolve(records, name, {"normalized": normalize_name(F.col(name))}, index)


def unmatched_by_alias(records: DataFrame, aliases: DataFrame, name: str = "stationname") -> DataFrame:
    """Records whose normal form no alias has."""
    return match_by_alias(records, aliases, name).where(F.col("station_id").isNull()).drop("station_id")


def match_by_alias_or_name(names: DataFrame, aliases: DataFrame, stations: DataFrame, name: str = "stationname") -> DataFrame:
    """Aliases first, then stations whose own name has the same normal form."""
    by_alias = alias_index(aliases).select("normalized", F.col("station_id").alias("_by_alias"))
    by_name = alias_index(station_aliases(stations)).select("normalized", F.col("station_id").alias("_by_name"))
    index = by_alias.join(by_name, "normalized", "full_outer").select(
        "normalized", F.coalesce("_by_alias", "_by_name").alias("station_id")
    )
    return _resolve(names, name, {"normalized": normalize_name(F.col(name))}, index)


def match_exact_alias(names: DataFrame, aliases: DataFrame, stations: DataFrame, name: str = "stationname") -> DataFrame:
    """All stations an alias of exactly this spelling belongs to; names without one are kept.

    A row of ``names`` comes once for each different station of its alias, however often the alias is listed.
    """
    listed = aliases.select("alias_name", "station_id").distinct()
    named = listed.join(stations.select("station_id", F.col("name").alias("station_name")), "station_id", "left")
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["alias_name", "station_name", "station_id"]
    ranked = named.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn(
        "_list", F.floor(F.monotonically_increasing_id() / LISTED))
    # collect_list leaves NULL ids out, so each id goes into a list of its own first.
    lists = lookup_table(ranked.groupBy("alias_name", "station_name", "_list").agg(
        F.flatten(F.collect_list(F.array("station_id"))).alias("_ids")).drop("_list"), "aliases")
    # The rows multiply in the last step only, and the names of one spelling are dealt over several tasks for it.
    # Their number is given, because adaptive execution would join small partitions and cannot tell what they grow to.
    dealt = names.withColumn("_deal", F.monotonically_increasing_id() % DEALS).repartition(tasks, name, "_deal")
    every = lists.withColumn(name, F.col("alias_name")).withColumn(
        "_deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DEALS - 1).cast("bigint"))))
    met = dealt.join(every.hint("merge"), [name, "_deal"], "left")
    others = [c for c in names.columns if c != name]
    return met.select(name, *others, F.explode_outer("_ids").alias("station_id"), "alias_name", "station_name")


def match_by_id(records: DataFrame, stations: DataFrame) -> DataFrame:
    """Add the station that carries the record's ``ridership_id``, NULL if none does."""
    return records.join(lookup_table(by_ridership_id(stations), "known"), "ridership_id", "left")


def by_ridership_id(stations: DataFrame) -> DataFrame:
    known = stations.where(F.col("ridership_id").isNotNull())
    return known.groupBy("ridership_id").agg(F.min("station_id").alias("station_id"))


def _special_targets(spark, special: Mapping[str, Sequence[str]]) -> DataFrame:
    """The special names as rows (raw name, normal form of a possible station name); the table is as small as the rules."""
    rows = [(raw, target) for raw, targets in special.items() for target in targets] or [(None, None)]
    table = spark.createDataFrame(rows, "raw string, target string")
    return table.select("raw", normalize_name(F.col("target")).alias("normalized")).distinct()


def _station_index(stations: DataFrame, special: Mapping[str, Sequence[str]]) -> DataFrame:
    """The best station (kind, key, line, station_id) for each way in which a name can match, written once.

    Kinds: "full" the whole normal form, "special" the raw name of a special rule, "line" base name and line, "plain"
    base name of a station without lines, "any" base name. Stations of one spelling and the same lines match alike, so their
    smallest id stands for all of them and each spelling is brought into its normal form once.
    """
    spelled = stations.groupBy("name", F.coalesce("lines", F.array().cast("array<string>")).alias("lines")).agg(
        F.min("station_id").alias("station_id"))
    named = spelled.select(
        "station_id", "lines", normalize_name(F.col("name")).alias("full"), normalize_name(strip_paren(F.col("name"))).alias("base"))
    nothing = F.lit(None).cast("string")

    def entry(kind: str, key: Column, line: Column = nothing) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), line.alias("line"))

    entries = F.concat(
        F.array(entry("full", F.col("full")), entry("any", F.col("base"))),
        F.when(F.size("lines") == 0, F.array(entry("plain", F.col("base")))).otherwise(
            F.transform("lines", lambda line: entry("line", F.col("base"), F.lower(line)))
        ),
    )
    keys = named.select("station_id", F.explode(entries).alias("e")).select("e.*", "station_id")
    by_rule = named.join(
        F.broadcast(_special_targets(stations.sparkSession, special)), F.col("full") == F.col("normalized")
    ).select(F.lit("special").alias("kind"), F.col("raw").alias("key"), nothing.alias("line"), "station_id")
    best = keys.unionByName(by_rule).groupBy("kind", "key", "line").agg(F.min("station_id").alias("station_id"))
    return lookup_table(best, "index")


def scored_names(
    names: DataFrame, stations: DataFrame, hints: Mapping[str, str] = rules.LINE_HINTS,
    special: Mapping[str, Sequence[str]] = rules.SPECIAL_NAMES, name: str = "stationname",
) -> DataFrame:
    """For distinct names: ``base, line, station_id, match_score``.

    Score 4: the full normal forms are equal, or a special rule names the station. Score 3: same base name and the
    station has the inferred line. Score 2: same base name, station without lines. Score 1: same base name and no line
    could be inferred. Otherwise there is no match.
    """
    index = _station_index(stations, special)

    def best(kind: str, key: str, column: str) -> DataFrame:
        return index.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("station_id").alias(column))

    by_line = index.where(F.col("kind") == "line").select(
        F.col("key").alias("base"), F.col("line").alias("_line_key"), F.col("station_id").alias("_on_line")
    )
    cut = split_name(F.col(name))
    keyed = names.select(name).distinct().withColumns({
        "normalized": normalize_name(F.col(name)),
        "base": normalize_name(cut["base"]),
        "line": infer_line(cut["suffix"], hints),
    }).withColumn("_line_key", F.lower("line"))
    joined = (
        keyed.join(best("full", "normalized", "_equal"), "normalized", "left")
        .join(best("special", name, "_special"), name, "left")
        .join(best("plain", "base", "_without_lines"), "base", "left")
        .join(best("any", "base", "_any"), "base", "left")
        .join(by_line, ["base", "_line_key"], "left")
    )
    candidates = [
        (4, F.least("_equal", "_special")),
        (3, F.col("_on_line")),
        (2, F.col("_without_lines")),
        (1, F.when(F.col("line") == "", F.col("_any"))),
    ]
    score = F.coalesce(*[F.when(c.isNotNull(), F.lit(s)) for s, c in candidates], F.lit(0))
    return joined.select(
        name, "normalized", "base", "line",
        F.coalesce(*[c for _, c in candidates]).alias("station_id"), score.cast("int").alias("match_score"),
    )


def pair_counts(records: DataFrame) -> DataFrame:
    """Records as distinct (ridership_id, stationname) with their number ``n``, written once: what matching depends on."""
    return lookup_table(records.groupBy("ridership_id", "stationname").agg(F.count(F.lit(1)).alias("n")), "pairs")


def match_by_score(
    records: DataFrame, stations: DataFrame, hints: Mapping[str, str] = rules.LINE_HINTS,
    special: Mapping[str, Sequence[str]] = rules.SPECIAL_NAMES,
) -> DataFrame:
    """Add ``station_id`` to records (ridership_id, stationname, ...): known id, else scored name, else learned id.

    A name that matched teaches its ridership id to the station; all other names with that id then resolve by it. The
    result does not depend on the order of the records.
    """
    resolved = lookup_table(resolve_pairs(records, stations, hints, special), "resolved")
    return keep_all(records, resolved, ["ridership_id", "stationname"])


def keep_all(records: DataFrame, resolved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which a missing key equals a missing key; all conditions stay equalities of columns.

    ``resolved`` is a written table with one row per key, so its number of rows is known without reading it, and a partition
    of its keys is small however often a key occurs in the records.
    """
    theirs = resolved.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in resolved.columns if c not in keys])
    if resolved.count() >= MANY_KEYS:
        theirs = theirs.hint("shuffle_hash")
    same = F.lit(True)
    for k in keys:
        same = same & records[k].eqNullSafe(theirs[f"_r_{k}"])
    return records.join(theirs, same, "left").drop(*[f"_r_{k}" for k in keys])


def resolve_pairs(
    records: DataFrame, stations: DataFrame, hints: Mapping[str, str] = rules.LINE_HINTS,
    special: Mapping[str, Sequence[str]] = rules.SPECIAL_NAMES,
) -> DataFrame:
    """The match of every distinct (ridership_id, stationname). The distinct pairs are written once and used often.

    A missing or blank id is no id: it finds by name, teaches nothing and learns nothing. Only pairs that found no station look
    for a learned one.
    """
    pairs = materialize(records.select("ridership_id", "stationname").distinct(), "pairs")
    known = by_ridership_id(stations).withColumnRenamed("station_id", "_known")
    named = scored_names(pairs, stations, hints, special).select("stationname", F.col("station_id").alias("_named"))
    first = pairs.join(known, "ridership_id", "left").join(named, "stationname", "left").select(
        "ridership_id", "stationname", F.coalesce("_known", "_named").alias("_found")
    )
    first = materialize(first, "first")
    found, lost = first.where("_found IS NOT NULL"), first.where("_found IS NULL").drop("_found")
    learned = found.where(F.trim("ridership_id") != "").groupBy("ridership_id").agg(F.min("_found").alias("_found"))
    return found.unionByName(lost.join(lookup_table(learned, "learned"), "ridership_id", "left")).withColumnRenamed("_found", "station_id")


def learned_ids(
    records: DataFrame, stations: DataFrame, hints: Mapping[str, str] = rules.LINE_HINTS,
    special: Mapping[str, Sequence[str]] = rules.SPECIAL_NAMES,
) -> DataFrame:
    """The ridership id to store with each station that had none and was matched by name (the smallest, if several)."""
    matched = resolve_pairs(records, stations, hints, special).where(F.col("station_id").isNotNull())
    new = matched.groupBy("station_id").agg(F.min("ridership_id").alias("ridership_id"))
    return new.join(stations.where(F.col("ridership_id").isNull()).select("station_id"), "station_id", "left_semi")


def unmatched_reasons(
    names: DataFrame, stations: DataFrame, hints: Mapping[str, str] = rules.LINE_HINTS, name: str = "stationname"
) -> DataFrame:
    """Add ``reason`` to names that did not match: the wrong line, or no such base name.

    Line mismatch is said only if none of the stations with that base name has the line.
    """
    seen = stations.select(
        "station_id", F.col("name").alias("_name"), "lines", normalize_name(strip_paren(F.col("name"))).alias("_base")
    )
    by_base = lookup_table(seen.groupBy("_base").agg(
        F.min_by(F.struct("_name", "lines"), "station_id").alias("_seen"),
        F.array_distinct(F.flatten(F.collect_set(F.transform("lines", F.lower)))).alias("_served"),
    ), "bases")
    cut = split_name(F.col(name))
    keyed = names.withColumns({"_base": normalize_name(cut["base"]), "_line": infer_line(cut["suffix"], hints)})
    mismatch = F.format_string(
        "Base name matches '%s' but line mismatch (expected: %s, found: [%s])",
        F.col("_seen._name"), F.col("_line"), F.concat_ws(" ", F.col("_seen.lines")),
    )
    wrong_line = F.col("_seen").isNotNull() & (F.col("_line") != "") & ~contains_line(F.col("_served"), F.col("_line"))
    return (
        keyed.join(by_base, "_base", "left")
        .withColumn("reason", F.when(wrong_line, mismatch).otherwise(NO_BASE))
        .drop("_base", "_line", "_seen", "_served")
    )


def match_by_prefix(aliases: DataFrame, stations: DataFrame) -> DataFrame:
    """Resolve rows (alias_name, canonical): a station with that normal form, else the shortest that starts with it.

    "Starts with" means whole words, so each station offers the leading word sequences of its own name as keys, and the
    lookup is an equality join.
    """
    own = stations.select("station_id", normalize_name(F.col("name")).alias("_full"))
    words = F.split("_full", " ")
    leading = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    best = (
        own.withColumn("_key", F.explode(leading))
        .groupBy("_key")
        .agg(F.min(F.struct(F.length("_full").alias("n"), F.col("_full"), F.col("station_id"))).alias("_best"))
        .select("_key", F.col("_best.station_id").alias("station_id"))
    )
    return (
        aliases.withColumn("_key", normalize_name(F.col("canonical")))
        .join(best, "_key", "left").drop("_key")
        .withColumn("normalized", normalize_name(F.col("alias_name")))
    )


def aliases_by_rule(alias_rules: Sequence[tuple[str, str]], stations: DataFrame) -> DataFrame:
    """Aliases (station_id, alias_name, normalized) for all stations named exactly as a rule says."""
    table = stations.sparkSession.createDataFrame(list(alias_rules), "alias_name string, name string")
    return (
        stations.select("station_id", "name").join(F.broadcast(table), "name")
        .select("station_id", "alias_name", normalize_name(F.col("alias_name")).alias("normalized"))
        .distinct()
    )
