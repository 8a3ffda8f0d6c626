"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from songloom import fixed

# --- fixed values: cleaning patterns, applied in this order -----------------
URL_PATTERN = r"https?://\S+|www\.\S+"
TAG_PATTERN = r"<[^>]+>"
MARKER_PATTERN = r"\[.*?\]"
NOT_KEPT_PATTERN = r"""[^\p{L}\p{N}_'".,!?]+"""


def clean_text(text: Column) -> Column:
    """Lower-case text without links, tags, section markers or symbols.

    Symbols and blanks become one blank per run, whatever the run is made of.
    """
    out = F.coalesce(text, F.lit(""))
    for pattern in (URL_PATTERN, TAG_PATTERN, MARKER_PATTERN):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(F.lower(out), NOT_KEPT_PATTERN, " "))


def combine_text(lyrics: Column, emotion: Column, genre: Column) -> Column:
    """Lyrics led by their emotion and genre tags; empty parts leave no gap."""

    def tagged(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"[{name}: "), value, F.lit("]")))

    return F.concat_ws(" ", tagged("EMOTION", emotion), tagged("GENRE", genre), F.when(lyrics != "", lyrics))


def merge_key(artist: Column, song: Column) -> Column:
    """The case-insensitive ``artist|song`` key; a null part counts as empty."""

    def part(col: Column) -> Column:
        return F.trim(F.lower(F.coalesce(col, F.lit(""))))

    return F.concat(part(artist), F.lit("|"), part(song))


def song_id(artist: Column, song: Column) -> Column:
    """The ``artist|song`` id, case kept."""
    return F.concat(F.trim(artist), F.lit("|"), F.trim(song))


def clean_artist(artist: Column) -> Column:
    """``"['A', 'B']"`` becomes ``A, B``; any other string is only trimmed."""
    stripped = F.trim(artist)
    inner = F.trim(stripped.substr(F.lit(2), F.length(stripped) - 2))
    names = F.transform(
        F.split(inner, ","),
        lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^'+|'+$", ""), r'^"+|"+$', ""),
    )
    listed = F.array_join(F.filter(names, lambda x: x != ""), ", ")
    return F.when(stripped.startswith("[") & stripped.endswith("]"), listed).otherwise(stripped)


def is_non_original(song: Column) -> Column:
    """True where the name holds one of the version markers."""
    name = F.lower(song)
    hit = F.lit(False)
    for marker in fixed.NON_ORIGINAL_MARKERS:
        hit = hit | name.contains(marker)
    return hit


def search_url(song: Column, artist: Column, prefix: str) -> Column:
    """Fallback link: the prefix and the query with spaces escaped and nothing else."""
    query = F.trim(F.concat(song, F.lit(" "), F.coalesce(artist, F.lit(""))))
    return F.concat(F.lit(prefix), F.replace(query, F.lit(" "), F.lit("%20")))


def time_ago(ts: Column, as_of: Column) -> Column:
    """Relative age label; both arguments are timestamps."""
    secs = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    secs = secs / F.lit(1_000_000.0)

    def label(size: int, unit: str) -> Column:
        return F.concat(F.floor(secs / size).cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(secs < 60, F.lit("Just now"))
        .when(secs < 3600, label(60, "m"))
        .when(secs < 86400, label(3600, "h"))
        .otherwise(label(86400, "d"))
    )


def format_duration(ms: Column) -> Column:
    """``m:ss`` with rounded seconds; nothing for a missing or zero length."""
    minutes = F.floor(ms / 60000)
    seconds = F.floor((ms - minutes * 60000) / 1000 + 0.5)
    text = F.concat(minutes.cast("string"), F.lit(":"), F.lpad(seconds.cast("string"), 2, "0"))
    return F.when(ms.isNull() | (ms == 0), F.lit("")).otherwise(text)
