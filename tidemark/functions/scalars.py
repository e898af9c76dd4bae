"""Scalar expressions: time parts, distances, ratios, masking, redaction, identifiers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.settings import DAY_US


def hour_of(ts: str) -> Column:
    return F.hour(ts)


def weekday_of(ts: str) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(ts)


def night(hour: str | Column) -> Column:
    h = F.col(hour) if isinstance(hour, str) else hour
    return F.when((h >= 21) | (h < 6), 1).otherwise(0)


def cyclic(hour: Column) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.lit(math.pi) * hour / F.lit(24.0)
    return F.sin(angle), F.cos(angle)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance; the root's argument is held at 1, beyond which rounding could push it."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def online(category: Column, strict: bool = False) -> Column:
    """Whether a category ends in one character and 'net' (strict: in '_net')."""
    return (category.endswith("_net") if strict else category.like("%_net")).cast("int")


def z_score(amt: Column, mean: Column, std: Column, n: Column, least: int = 5) -> Column:
    return F.when((n < least) | (std == 0), 0.0).otherwise((amt - mean) / F.greatest(std, F.lit(1.0)))


def over_mean(amt: Column, mean: Column, n: Column) -> Column:
    return F.when(n == 0, 1.0).otherwise(amt / F.greatest(mean, F.lit(1.0)))


def canonical_json(**fields: Column) -> Column:
    """JSON text with sorted keys and no blanks; null fields are written as null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(c: Column) -> Column:
    """A string as a JSON string; control characters are escaped, others stay as they are."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for i in range(32):
        escaped = F.replace(escaped, F.lit(chr(i)), F.lit(_SHORT.get(chr(i), f"\\u{i:04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def canonical_text(c: Column) -> Column:
    """A JSON text with sorted keys and no blanks; a text that is no JSON gives null. Numbers are written in Spark's way."""
    return F.to_json(F.try_parse_json(c))


def mask_pan(pan: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(pan.cast("string"), F.lit("")), r"\D", "")
    n = F.length(digits)
    return F.when(n == 0, "N/A").when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.lit("**** **** **** "), F.substr(digits, n - 3, F.lit(4))))


def mask_name(first: Column, last: Column) -> Column:
    f, s = F.trim(F.coalesce(first, F.lit(""))), F.trim(F.coalesce(last, F.lit("")))
    initial = F.when(f != "", F.concat(F.substring(f, 1, 1), F.lit(".")))
    return F.when((f == "") & (s == ""), "N/A").otherwise(F.concat_ws(" ", initial, F.when(s != "", s)))


# Patterns of secrets and card numbers, and the markers put in their place.
SECRETS = (r"\b(?:sk|pk)_(?:test|live)_[A-Za-z0-9_-]+\b", r"\bAKIA[0-9A-Z]{16}\b")
BEARER = r"(?i)(authorization\s*[:=]\s*bearer\s+)[A-Za-z0-9._~+/-]+=*"
CARD = r"(?<!\d)(?:\d[ -]?){12,19}(?!\d)"


def redact(text: Column) -> Column:
    """Secrets go, a bearer token keeps what names it, then card numbers go."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return F.regexp_replace(F.regexp_replace(text, BEARER, "$1[REDACTED]"), CARD, "[REDACTED_PAN]")


def hours_between(start: Column, end: Column) -> Column:
    """Hours from one ISO-8601 time to another, 0 at least."""
    us = F.unix_micros(F.to_timestamp(end)) - F.unix_micros(F.to_timestamp(start))
    return F.greatest(us / F.lit(3_600_000_000.0), F.lit(0.0))


def elapsed_days(first_us: Column, last_us: Column) -> Column:
    """Whole periods of 24 hours between two times, 1 at least."""
    return F.greatest(F.floor((last_us - first_us) / DAY_US), F.lit(1))


# What identifiers and path segments may hold.
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:@/-]{1,127}$"
SEGMENT = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


def valid_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(IDENTIFIER), F.lit(False))


def valid_segment(c: Column) -> Column:
    return F.coalesce(c.rlike(SEGMENT), F.lit(False))


def valid_rationale(c: Column, least: int = 20) -> Column:
    return F.coalesce(F.length(F.trim(c)) >= least, F.lit(False))


def label_votes(scores: dict[str, Column], fallback: str, least: float = 0.5) -> Column:
    """The names of the scores above ``least``, or a fallback text."""
    named = F.filter(F.array(*[F.when(s > least, F.lit(n)) for n, s in scores.items()]), lambda x: x.isNotNull())
    return F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise(fallback)


# What may leave the boundary towards a narrative writer, and what never may.
ALLOWED = ("trans_num", "trans_date_trans_time", "cc_num", "merchant", "category", "amt", "distance_km", "night", "card_mean_amt", "amt_z_card", "txns_24h", "txns_7d", "category_risk")
PROHIBITED = ("first", "last", "gender", "job", "dob", "street", "city", "state", "zip", "lat", "long", "merch_lat", "merch_long")


def minimize(df: DataFrame, allowed: Sequence[str] = ALLOWED, prohibited: Sequence[str] = PROHIBITED) -> DataFrame:
    """The allowed columns alone; those that are absent are null."""
    out = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in allowed])
    leaked = set(out.columns) & set(prohibited)
    if leaked:  # an allow-list of the caller's own
        raise ValueError(f"prohibited columns: {sorted(leaked)}")
    return out


def substituted(features: Sequence[str], serving: dict[str, str]) -> list[Column]:
    """The features by name, each read from its serving column if it has one."""
    return [F.col(serving.get(f, f)).alias(f) for f in features]
