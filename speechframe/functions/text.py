"""Column functions over text: timestamps of subtitles, Unicode trim, URLs, model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLE_MAX = 1.7976931348623157e308


def _clock(seconds: Column, mark: str) -> Column:
    ms = F.greatest(F.lit(0).cast("long"), F.round(seconds * 1000).cast("long"))
    hour, minute, second = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", hour, minute, second, ms % 1000)


def srt_timestamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm; rounded half away from zero, negatives as zero, hours as long as they are."""
    return _clock(seconds, ",")


def vtt_timestamp(seconds: Column) -> Column:
    return _clock(seconds, ".")


def unicode_trim(text: Column) -> Column:
    """Without White_Space at either end; Spark's own trim knows the space only."""
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def end_or_start(start: Column, end: Column) -> Column:
    return F.coalesce(end, start)


def end_or_max(end: Column) -> Column:
    return F.coalesce(end, F.lit(DOUBLE_MAX))


def is_url(path: Column) -> Column:
    return path.startswith("http://") | path.startswith("https://")


def url_extension(url: Column) -> Column:
    """Lower-case extension of the last path part, without query and fragment; null where it has no dot."""
    bare = F.substring_index(F.substring_index(url, "?", 1), "#", 1)
    name = F.substring_index(bare, "/", -1)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))


def path_extension(path: Column) -> Column:
    return F.when(is_url(path), url_extension(path)).otherwise(url_extension(F.regexp_replace(path, "[?#]", "_")))


def is_english_only_model(name: Column) -> Column:
    return F.substring_index(name, ".", -1) == "en"


def speaker_label(number: Column) -> Column:
    return F.format_string("SPEAKER_%02d", number)
