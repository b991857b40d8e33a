"""Date and time text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedwright.registry import operator

# Shapes of dates and times in feeds. Only the shape counts: month 99 passes.
TIMESTAMP_SHAPE = r"(?i)^\d+[-/]\d+[-/]\d+\s\d+:?\d+:?[\d.]+\s?(?:AM|PM)?$"
DATE_SHAPE = r"^\d+[-/]\d+[-/]\d+$"
DATE_OR_TIMESTAMP_SHAPE = r"(?i)^\d+[-/]\d+[-/]\d+(?:\s\d+:?\d+:?[\d.]+\s?(?:AM|PM)?)?$"

# Order of the date parts and the pattern that reads it.
DATE_STYLES = {
    "YMD": "y-M-d",
    "YDM": "y-d-M",
    "DMY": "d-M-y",
    "MDY": "M-d-y",
    "DYM": "d-y-M",
    "MYD": "M-y-d",
}


@operator("normalise_extract_date")
def normalise_extract_date(text: Column, fallback: Column | None = None) -> Column:
    """``YYYYMMDD[hhmmss]`` with optional ``-`` ``/`` ``:`` anywhere in the text, as ``YYYY-MM-DD[ hh:mm:ss]``.

    Text that holds no date gives ``fallback`` (NULL by default, so a caller that needs the load order can fail).
    """
    day = r"(\d{4})[-/]*(\d{2})[-/]*(\d{2})"
    full = day + r".*(\d{2})[:]*(\d{2})[:]*(\d{2})"

    def part(pattern: str, index: int) -> Column:
        return F.regexp_extract(text, pattern, index)

    date_of = lambda pattern: F.concat_ws("-", part(pattern, 1), part(pattern, 2), part(pattern, 3))
    time_of = F.concat_ws(":", part(full, 4), part(full, 5), part(full, 6))
    return (
        F.when(text.rlike(full), F.concat_ws(" ", date_of(full), time_of))
        .when(text.rlike(day), date_of(day))
        .otherwise(fallback if fallback is not None else F.lit(None).cast("string"))
    )


@operator("ampm_to_timestamp")
def ampm_to_timestamp(text: Column, date_style: str = "YMD") -> Column:
    """Timestamp from text that may carry AM/PM, may be a bare date, or may be too short to be either (NULL)."""
    pattern = DATE_STYLES[date_style]
    cleaned = F.translate(F.upper(F.trim(text)), "/", "-")
    marked = F.regexp_replace(cleaned, r"\s*(AM|PM)$", " $1")

    def read(column: Column, *times: str) -> Column:
        return F.coalesce(*[F.try_to_timestamp(column, F.lit(f"{pattern}{time}")) for time in times])

    return (
        F.when(F.length(text) < 6, F.lit(None).cast("timestamp"))
        .when(F.right(cleaned, F.lit(2)).isin("AM", "PM"), read(marked, " h:mm:ss a", " h:mm a"))
        .when(F.length(text) < 11, read(cleaned, ""))
        .otherwise(read(cleaned, " H:mm:ss", " H:mm:ss.SSS", " H:mm", ""))
    )
