"""Column functions over numbers and coded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from songloom import fixed


def literal_map(mapping: dict) -> Column:
    """A small constant lookup, folded into the plan."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: dict, key: Column) -> Column:
    """Value of ``key`` in a constant map, null when absent."""
    return F.try_element_at(literal_map(mapping), key)


def to_number(col: Column) -> Column:
    """Lenient cast: text that is no number becomes null."""
    return col.try_cast("double")


def is_missing(col: Column) -> Column:
    """Null or NaN."""
    return col.isNull() | F.isnan(col)


def parse_loudness(col: Column) -> Column:
    """``-5.2 dB`` as a number."""
    return to_number(F.regexp_replace(col, "(?i)db", ""))


def pitch_of_key(col: Column) -> Column:
    """Written key such as ``F# min`` as pitch class / 11."""
    root = F.element_at(F.split(F.trim(col), r"\s+"), 1)
    return F.coalesce(lookup(fixed.PITCH_CLASSES, root), F.lit(fixed.UNKNOWN_PITCH)) / F.lit(11.0)


def wrap(col: Column, size: int) -> Column:
    """Number text as an integer modulo ``size``; missing counts as zero."""
    return F.pmod(F.coalesce(to_number(col), F.lit(0.0)).cast("int"), F.lit(size))


def key_index(col: Column) -> Column:
    """Index of a sharp key name or of a number 0-11; anything else is 0."""
    names = {name: i for i, name in enumerate(fixed.SHARP_KEYS)} | {str(i): i for i in range(12)}
    return F.coalesce(lookup(names, col), F.lit(0))


def emotion_code(col: Column) -> Column:
    """Code of a known emotion in any case, else null."""
    return lookup(fixed.EMOTION_CODES, F.lower(col))


def emotion_code_lenient(col: Column) -> Column:
    """As above; a missing emotion counts as joy, an unknown one as code 0."""
    return F.coalesce(emotion_code(F.coalesce(col, F.lit("joy"))), F.lit(0))


def year_of(col: Column) -> Column:
    """Year of a date given as text, null when it is no date."""
    return F.year(F.to_date(F.try_to_timestamp(col)))


def decade_of(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def minutes(length_ms: Column) -> Column:
    return length_ms / F.lit(60000.0)


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + F.lit(fixed.EPSILON))


def distance_score(distance: Column) -> Column:
    """1 / (1 + d), four digits."""
    return F.round(F.lit(1.0) / (F.lit(1.0) + distance), 4)


def relative_score(x: Column, lo: Column, hi: Column, bottom: float, top: float) -> Column:
    """``x`` moved from [lo, hi] to [bottom, top]; a flat set gets the middle."""
    span = hi - lo
    scaled = F.lit(bottom) + (x - lo) / span * F.lit(top - bottom)
    return F.when(span < 1e-9, F.lit(round((top + bottom) / 2, 4))).otherwise(F.round(scaled, 4))
