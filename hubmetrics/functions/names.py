"""Station names: normal form, compound names, inferred lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The feeds' rules speak of ASCII word characters and ASCII white space, so both are spelled out.
_NOT_WORD_OR_SPACE = r"[^0-9A-Za-z_\t\n\f\r ]"
_SPACES = r"[\t\n\f\r ]+"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_name(name: Column) -> Column:
    """The form in which names are compared: lower case, no punctuation, no word 'station', single blanks."""
    spaced = F.translate(F.replace(F.lower(name), F.lit("&"), F.lit("and")), "/-", "  ")
    words = F.regexp_replace(F.regexp_replace(spaced, _NOT_WORD_OR_SPACE, ""), r"\bstation\b", "")
    return F.trim(F.regexp_replace(words, _SPACES, " "))


def split_name(name: Column) -> Column:
    """A struct ``base, suffix``: cut at the last hyphen, else at the last slash, unless that is the first character."""
    def cut(separator: str) -> Column:
        pattern = rf"(?s)^(.+){separator}([^{separator}]*)$"
        return F.struct(
            strip(F.regexp_extract(name, pattern, 1)).alias("base"),
            strip(F.regexp_extract(name, pattern, 2)).alias("suffix"),
        )

    return (
        F.when(name.rlike(r"(?s)^.+-[^-]*$"), cut("-"))
        .when(name.rlike(r"(?s)^.+/[^/]*$"), cut("/"))
        .otherwise(F.struct(name.alias("base"), F.lit("").alias("suffix")))
    )


def strip_paren(name: Column) -> Column:
    """The name before its last opening parenthesis, unless that is the first character."""
    return F.when(name.rlike(r"(?s)^.+\("), strip(F.regexp_extract(name, r"(?s)^(.+)\(", 1))).otherwise(name)


def literal_map(pairs: Mapping[str, str]) -> Column:
    """A map column with fixed entries; Catalyst folds it into one literal."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def infer_line(suffix: Column, hints: Mapping[str, str]) -> Column:
    """The line a suffix points to: as a whole, else by its first known word, else ''."""
    table = literal_map(hints)
    by_word = F.filter(
        F.transform(F.split(suffix, " "), lambda word: F.try_element_at(table, word)), lambda line: line.isNotNull()
    )
    return F.coalesce(F.try_element_at(table, suffix), F.get(by_word, 0), F.lit(""))


def surrogate_key(*parts: Column) -> Column:
    """A key that is the same in every run."""
    return F.sha2(F.concat_ws("|", *parts), 256)
