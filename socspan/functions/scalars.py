"""Scalar building blocks: null-safe times, guards, ids, hashes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # of RFC 4122


def to_utc(c: Column) -> Column:
    """FN-01: text or time as a UTC timestamp, null where it can't be read; the session zone must be UTC."""
    return F.try_to_timestamp(c.cast("string"))


def minutes_between(start: Column, end: Column) -> Column:
    """FN-02: (end - start) in minutes as a double; null if either is."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(6e7)


def finite(c: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(~F.isnan(c) & ~c.isin(float("inf"), float("-inf")), c)


def safe_mean(c: Column) -> Column:
    """FN-03: mean of finite values, 0 when there is none."""
    return F.coalesce(F.avg(finite(c)), F.lit(0.0))


def safe_median(c: Column) -> Column:
    """FN-03: median of finite values, 0 when there is none."""
    return F.coalesce(F.median(finite(c)), F.lit(0.0))


def safe_p90(c: Column) -> Column:
    """FN-03: 90th percentile with linear interpolation, 0 when there is none."""
    return F.coalesce(F.percentile(finite(c), F.lit(0.9)), F.lit(0.0))


def clean_float(c: Column, default: float = 0.0) -> Column:
    """FN-06: default in place of null, NaN and infinities."""
    return F.coalesce(finite(c), F.lit(default))


def clamp01(c: Column) -> Column:
    """FN-06: clamped to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def share(condition: Column, among: Column | None = None) -> Column:
    """Share of rows that meet a condition (null counts as no), 0 without rows; among restricts the rows."""
    hit = F.coalesce(condition, F.lit(False)).cast("double")
    return F.coalesce(F.avg(hit if among is None else F.when(among, hit)), F.lit(0.0))


def uuid5(name: Column) -> Column:
    """FN-07: name-based UUID in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    digit = F.substring(variant, (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), digit, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def finding_id(signal: Column, entity: Column, window: Column, seed: int = 42) -> Column:
    """FN-07: id of a finding, from signal, entity, window and seed."""
    return uuid5(F.concat_ws("|", signal, entity, window, F.lit(str(seed))))


def evidence_id(row_ids: Column) -> Column:
    """FN-07: id of an evidence bundle, from its sorted row ids."""
    return F.sha2(F.array_join(F.array_sort(row_ids), "|"), 256)


def hmac_sha256(data: Column, key: str) -> Column:
    """FN-08: HMAC-SHA256 as hex; the key pads are literals of the plan."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(data, "UTF-8")), 256))), 256)


def hmac_matches(data: Column, key: str, signature: Column) -> Column:
    """FN-08: whether a signature is that of data; null signatures don't match."""
    return F.coalesce(hmac_sha256(data, key) == F.lower(signature), F.lit(False))


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    """FN-09: two-sided p-value of a normal z; Spark has no erfc. Meant for rows of entities and metrics."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")


def tokens(text: Column) -> Column:
    """FN-10: lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def pseudonym(value: Column, salt: str = "") -> Column:
    """MAP-04: sha256 of value and salt."""
    return F.sha2(F.concat(value, F.lit(salt)), 256)


def strip_formula(value: Column) -> Column:
    """MAP-06: without the leading characters that make a spreadsheet read a cell as a formula."""
    return F.regexp_replace(value, "^[=+\\-@\\t\\r]+", "")
