"""Column-level helpers (F8-F11 and time conversions).

Every function returns a ``Column`` built from built-in Spark expressions so
that it stays inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate import schema as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def minute_trunc(ts) -> Column:
    """TRUNCATE(MINUTE, ts)."""
    return F.date_trunc("minute", _c(ts)).cast(T.TimestampType())


def ts_literal(value) -> Column:
    """A point in time as a TIMESTAMP literal.  Accepts a datetime (UTC when
    naive), an ISO string or epoch microseconds."""
    if isinstance(value, Column):
        return value
    if isinstance(value, int):
        return F.timestamp_micros(F.lit(value))
    if isinstance(value, _dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=_dt.timezone.utc)
        micros = int(value.timestamp()) * 1_000_000 + value.microsecond
        return F.timestamp_micros(F.lit(micros))
    return F.to_timestamp(F.lit(str(value)))


def date_shift(ts, minutes: int = 0, seconds: int = 0, millis: int = 0) -> Column:
    """DATEADD over minutes / seconds / milliseconds (negative = back).
    ``ts`` is a column (or column name), or a datetime / epoch microseconds."""
    out = ts_literal(ts) if isinstance(ts, (int, _dt.datetime)) else _c(ts)
    micros = ((minutes * 60 + seconds) * 1000 + millis) * 1000
    if micros:
        out = F.timestamp_micros(F.unix_micros(out) + F.lit(micros))
    return out


def null_default(c, default=0) -> Column:
    """nvl(x, default)."""
    return F.coalesce(_c(c), F.lit(default))


def micros(ts) -> Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ column (UTC)."""
    return F.unix_micros(_c(ts).cast(T.TimestampType()))


def to_ntz(df: DataFrame) -> DataFrame:
    """Cast every TIMESTAMP column to TIMESTAMP_NTZ (session zone UTC) so that
    results compare with engines that have no zoned timestamps."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            cols.append(F.col(f"`{f.name}`").cast(T.TimestampNTZType()).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def ts_text(ts) -> Column:
    """Timestamp as text, ``yyyy-MM-dd HH:mm:ss.SSSSSS`` in UTC (the format the
    status strings embed)."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def user_json(userid, name=S.LOYALTY_SCHEME_NAME, number=None) -> Column:
    """The user JSON payload built from its three fields, in declared order."""
    number = F.shiftright(_c(userid).cast("long"), 1) if number is None else _c(number)  # two users share a card
    return F.to_json(F.struct(
        _c(userid).cast("string").alias(S.JSON_FIELDS[0]),
        F.lit(name).alias(S.JSON_FIELDS[1]),
        number.cast("long").alias(S.JSON_FIELDS[2]),
    ))


def loyalty_number_text(json_col) -> Column:
    """F2 key: field(json, 'loyaltySchemeNumber') as text."""
    return F.get_json_object(_c(json_col), "$.loyaltySchemeNumber")


def parse_long_strict(text) -> Column:
    """A long parsed the way Long.parseLong does: optional sign then digits,
    no blanks, within range; NULL otherwise."""
    t = _c(text)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def loyalty_delta_update(old_json, payload) -> Column:
    """F8: NEW_LOYALTY_NUMBER delta.  Parse the old JSON into its three fields,
    set the number from ``payload`` and serialise again (unknown fields are
    dropped, NULL fields omitted).  NULL when the payload is not a number or
    the old JSON is not an object; callers turn NULL into an error row."""
    parsed = F.from_json(_c(old_json), S.USER_JSON)
    num = parse_long_strict(payload)
    updated = parsed.withField(S.JSON_FIELDS[2], num)
    return F.when(json_is_object(old_json) & num.isNotNull(), F.to_json(updated))


def json_is_object(text) -> Column:
    """True when the text is a JSON object (from_json alone yields a struct of
    NULLs for arrays and malformed text)."""
    return F.json_object_keys(_c(text)).isNotNull()
