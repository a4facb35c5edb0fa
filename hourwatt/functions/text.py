"""Labels, record ids and timestamp text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_MESSAGE_LIMIT = 2000
HIGH_CONFIDENCE = 0.75
MEDIUM_CONFIDENCE = 0.5
REGIME_LABELS = ("low", "medium_low", "medium_high", "high")
OFFSET_PATTERN = r"(Z|[+-]\d{2}:?\d{2})$"
MINUTES_ONLY_PATTERN = r"(T\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2}|)$"


def iso_utc(ts: Column) -> Column:
    """``2024-01-01T05:00:00+00:00`` (session time zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def record_id(*parts: Column | str) -> Column:
    """Join id parts with ``:``; strings are literals."""
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def iso_timestamp(text: Column) -> Column:
    """ISO text to a timestamp; seconds may be missing, and text without an offset is UTC."""
    return F.regexp_replace(text, MINUTES_ONLY_PATTERN, "$1:00$2").try_cast("timestamp")


def parse_offset_timestamp(text: Column) -> Column:
    """ISO text with an explicit offset (or Z) to a UTC timestamp; text without one gives null."""
    return F.when(text.rlike(OFFSET_PATTERN), iso_timestamp(text))


def price_direction(change: Column) -> Column:
    return (
        F.when(change.isNull(), "unknown")
        .when(change > 0, "increase")
        .when(change < 0, "decrease")
        .otherwise("flat")
    )


def direction_correct(predicted_label: Column, actual_label: Column, previous_value: Column) -> Column:
    """1.0 / 0.0, or null where no previous-day value exists."""
    return F.when(previous_value.isNotNull(), (predicted_label == actual_label).cast("double"))


def confidence_label(score: Column) -> Column:
    return (
        F.when(score >= HIGH_CONFIDENCE, "high")
        .when(score >= MEDIUM_CONFIDENCE, "medium")
        .otherwise("low")
    )


def regime_label(value: Column, q1: Column, q2: Column, q3: Column) -> Column:
    """Quartile regime; the bins are closed on the right. A null value has none."""
    low, medium_low, medium_high, high = REGIME_LABELS
    return (
        F.when(value <= q1, low)
        .when(value <= q2, medium_low)
        .when(value <= q3, medium_high)
        .when(value > q3, high)
    )


def metric_name(text: Column) -> Column:
    """Lower-case metric name; space, slash, dash and colon become underscores."""
    return F.lower(F.translate(text, " /-:", "____"))


def scenario_title(name: Column) -> Column:
    """``clean_first`` to ``Clean First``; the other letters keep their case."""
    words = F.split(name, "_")
    titled = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(titled, " ")


def truncate_message(message: Column) -> Column:
    return F.substring(message, 1, ERROR_MESSAGE_LIMIT)
