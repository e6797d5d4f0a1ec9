"""Feed values: dates, counts, coordinates. What cannot be read becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hubmetrics.functions.names import strip

_INTEGER = r"^[+-]?[0-9]+$"


def parse_service_date(text: Column) -> Column:
    """``MM/dd/yyyy`` where a slash occurs, else ``yyyy-MM-dd``; both with leading zeros."""
    american = F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(text, "MM/dd/yyyy"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.when(text.contains("/"), american).otherwise(iso)


def parse_iso_day(text: Column) -> Column:
    """The day of ``yyyy-MM-ddTHH:mm:ss.SSS``. The form is fixed by the expression, up to the very end, so that a cast reads it."""
    whole = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}\z")
    return F.when(whole, text.try_cast("timestamp").cast("date"))


def parse_count(text: Column) -> Column:
    """A whole number with blanks around it allowed (CSV feed)."""
    trimmed = strip(text)
    return F.when(trimmed.rlike(_INTEGER), trimmed.try_cast("bigint"))


def parse_count_or_zero(text: Column) -> Column:
    """A whole number without blanks; anything else counts as 0 (JSON feed)."""
    return F.coalesce(F.when(text.rlike(_INTEGER), text.try_cast("bigint")), F.lit(0).cast("bigint"))


def parse_coordinate(text: Column) -> Column:
    """A coordinate, NULL where it cannot be read, so that the gap stays visible."""
    return strip(text).try_cast("double")


def json_lines(text: Column) -> Column:
    """The array in a JSON text; an empty array where the text is no such array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_shape(text: Column) -> Column:
    """What a text that should hold a JSON array looks like."""
    return (
        F.when(text.isNull(), "NULL")
        .when(text == "", "EMPTY")
        .when(text.like("[%") & text.like("%]"), "LOOKS_LIKE_JSON")
        .otherwise("NOT_JSON")
    )


def malformed_json(text: Column) -> Column:
    """Whether a non-empty text lacks the outer brackets or nests further ones."""
    bad = ~text.like("[%") | ~text.like("%]") | text.like("%[%[%") | text.like("%]%]%")
    return text.isNotNull() & (text != "") & bad


def round_half_up(x: Column) -> Column:
    """Halves go up also below zero (-2.5 gives -2), as in browser arithmetic."""
    return F.floor(x + F.lit(0.5))


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def month_day_text(day: Column) -> Column:
    return F.date_format(day, "MMM d")
