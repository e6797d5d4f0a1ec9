"""Lines of a station: reading them from loose fields, canonical order, filters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubmetrics import rules
from hubmetrics.functions.names import literal_map, strip

_PAREN = r"^(.+?)\s*\(([^)]+)\)\s*$"


def _no_lines() -> Column:
    return F.array().cast("array<string>")


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def parse_lines(text: Column) -> Column:
    """The parts between '/', ',', '&' or the word 'and', trimmed, without empty ones."""
    parts = F.transform(F.split(text, r"(?i)[/,&]|\s+and\s+"), strip)
    return F.coalesce(F.filter(parts, lambda part: part != ""), _no_lines())


def normalize_line(
    name: Column, aliases: Mapping[str, str] = rules.LINE_ALIASES, canonical: Sequence[str] = rules.LINE_ORDER
) -> Column:
    """The valid line a spelling stands for, else NULL."""
    folded = strip(F.lower(name))
    titled = F.concat(F.upper(F.substring(folded, 1, 1)), F.substring(folded, 2, 2**31 - 1))
    valid = F.when(titled.isin(list(canonical)), titled)
    return F.coalesce(F.try_element_at(literal_map(aliases), folded), valid)


def _has_valid_line(text: Column, aliases: Mapping[str, str], canonical: Sequence[str]) -> Column:
    return F.exists(parse_lines(text), lambda part: normalize_line(part, aliases, canonical).isNotNull())


def paren_lines(
    name: Column, aliases: Mapping[str, str] = rules.LINE_ALIASES, canonical: Sequence[str] = rules.LINE_ORDER
) -> Column:
    """A struct ``clean_name, line_text``: the closing parenthesis is cut off where it names a valid line."""
    content = F.regexp_extract(name, _PAREN, 2)
    found = name.rlike(_PAREN) & _has_valid_line(content, aliases, canonical)
    return F.struct(
        F.when(found, strip(F.regexp_extract(name, _PAREN, 1))).otherwise(F.coalesce(name, F.lit(""))).alias("clean_name"),
        F.when(found, content).alias("line_text"),
    )


def name_contains_line(
    name: Column, aliases: Mapping[str, str] = rules.LINE_ALIASES, canonical: Sequence[str] = rules.LINE_ORDER
) -> Column:
    """Whether the first parenthesis in the name holds a valid line."""
    content = F.regexp_extract(name, r"\(([^)]+)\)", 1)
    return F.coalesce(_has_valid_line(content, aliases, canonical), F.lit(False))


def normalize_station_lines(
    stations: DataFrame, aliases: Mapping[str, str] = rules.LINE_ALIASES, canonical: Sequence[str] = rules.LINE_ORDER
) -> DataFrame:
    """Add ``station_lines, clean_name, raw_line_text`` from whichever loose fields the table has.

    Text fields: name, lines, line, routes, route, line_summary, lines_display. The fields lines and routes may be
    arrays instead. Columns that are absent count as empty.
    """
    kinds = {f.name: f.dataType.typeName() for f in stations.schema.fields}
    paren = F.col("_paren")
    texts, parts = [paren["line_text"]], [parse_lines(paren["line_text"])]
    for field in ("lines", "line", "routes", "route", "line_summary", "lines_display"):
        if kinds.get(field) == "array":
            parts.append(F.coalesce(F.col(field), _no_lines()))
        elif field in kinds:
            texts.append(F.when(F.col(field) != "", F.col(field)))
            parts.append(parse_lines(F.col(field)))
    valid = F.transform(F.concat(*parts), lambda part: normalize_line(part, aliases, canonical))
    name = F.col("name") if "name" in kinds else F.lit("")
    return stations.withColumn("_paren", paren_lines(name, aliases, canonical)).withColumns({
        "station_lines": F.array_intersect(string_array(canonical), valid),
        "clean_name": paren["clean_name"],
        "raw_line_text": F.coalesce(*texts),
    }).drop("_paren")


def canonical_order(lines: Column, canonical: Sequence[str] = rules.LINE_ORDER) -> Column:
    """Lines in canonical order, unknown ones in front and otherwise as they came."""
    order = string_array(canonical)
    numbered = F.transform(lines, lambda x, i: F.struct(F.array_position(order, x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(numbered), lambda s: s["x"])


def contains_line(lines: Column, line: Column) -> Column:
    """Whether a list has a line, whatever the case of either; no list or no line has none."""
    return F.coalesce(F.exists(lines, lambda x: F.lower(x) == F.lower(line)), F.lit(False))


def any_line_active(lines: Column, active: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(lines, string_array(active)), F.lit(False))


def search_match(name: Column, lines: Column, query: str) -> Column:
    """Whether the query occurs in the name or in a line, upper or lower case alike; '' keeps all."""
    if query == "":
        return F.lit(True)
    wanted = F.lit(query.lower())
    in_line = F.coalesce(F.exists(lines, lambda x: F.lower(x).contains(wanted)), F.lit(False))
    return F.lower(name).contains(wanted) | in_line


def suffix_line(name: Column, table: Mapping[str, str] = rules.NAME_SUFFIX_LINES) -> Column:
    """The line named by the text after the last hyphen, else NULL."""
    return F.when(name.contains("-"), F.try_element_at(literal_map(table), F.substring_index(name, "-", -1)))


def described_lines(text: Column, codes: Mapping[str, str] = rules.ROUTE_LINES, strict: bool = False) -> Column:
    """Lines whose code or name occurs in a description, sorted.

    Codes are matched as plain substrings, so a single letter may hit by chance; ``strict`` asks for whole words.
    """
    def hit(token: str) -> Column:
        return text.rlike(rf"(?<!\w){re.escape(token)}(?!\w)") if strict else text.contains(token)

    found = F.array(*[F.when(hit(code) | hit(line), F.lit(line)) for code, line in codes.items()])
    return F.array_sort(F.array_distinct(F.array_compact(found)))
