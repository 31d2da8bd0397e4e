"""Time Column builders.

All calendar maths works on integer ``ts_epoch`` seconds so results never
depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

DAY = 86400

# Parse formats for text timestamps that do not follow ISO-8601 (ISO strings are handled by the cast
# path first), ordered, by the beginning that a text needs for any of them: a format that fails costs an
# exception, so a text meets only those it can fit.  No text has two of these beginnings.
_ZONED_FORMATS = {
    r"^[-+]?\d+-\d": [
        "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS]XXX",
        "yyyy-MM-dd HH:mm[:ss][.SSSSSSSSS]XXX",
        "yyyy-MM-ddXXX",
        "yyyy-MM-dd h:mm[:ss] aXXX",
    ],
    r"^[-+]?\d{4,}/": ["yyyy/MM/dd HH:mm[:ss][.SSSSSSSSS]XXX"],
    r"^[-+]?\d{1,3}/": [
        "M/d/yyyy h:mm[:ss] aXXX",
        "M/d/yyyy H:mm[:ss]XXX",
        "M/d/yyyyXXX",
    ],
    r"^[-+]?\d+\.[-+]?\d+\.[-+]?\d{4}": ["d.M.yyyy H:mm[:ss]XXX"],
    r"^[-+]?\d+-[A-Za-z]": [
        "d-MMM-yyyy H:mm[:ss]XXX",
        "d-MMM-yyyyXXX",
    ],
    r"^[-+]?\d+ [A-Za-z]": ["d MMM yyyy H:mm[:ss]XXX"],
    r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) ": [
        "MMM d, yyyy h:mm[:ss] aXXX",
        "MMM d, yyyy H:mm[:ss]XXX",
        "MMM d, yyyyXXX",
    ],
    r"(?i)^[-+]?\d+T": ["yyyyMMdd'T'HHmmssXXX"],
}
#: What any text begins with that can be cast to a timestamp or fits a format.
_POSSIBLE = (r"(?i)^(?:[\x00-\x20\x7f]*[-+t:]*\d+(?:[^.@\da-f]|\.[-+]?\d+\.[-+]?\d{4}|$)"
             r"|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) )")

_HAS_ZONE = r"(?i)(\d\s*(z|utc|gmt)|\d\s*[+-]\d{2}:?\d{2})$"


def days_of(epoch) -> Column:
    """Floor division of epoch seconds by one day (exact for negatives too)."""
    e = col_(epoch)
    return ((e - F.pmod(e, F.lit(DAY))) / F.lit(DAY)).cast("long")


def epoch_date(epoch) -> Column:
    """UTC calendar date of an epoch (DATE)."""
    return F.date_from_unix_date(days_of(epoch).cast("int"))


def epoch_date_str(epoch) -> Column:
    return epoch_date(epoch).cast("string")


def epoch_hour(epoch) -> Column:
    return (F.pmod(col_(epoch), F.lit(DAY)) / F.lit(3600)).cast("long")


def epoch_dow(epoch) -> Column:
    """Day of week, 0 = Sunday (1970-01-01 was a Thursday)."""
    return F.pmod(days_of(epoch) + F.lit(4), F.lit(7))


def iso_from_epoch(epoch) -> Column:
    """Epoch seconds -> ``YYYY-MM-DDTHH:MM:SS+00:00``; NULL -> ''."""
    e = col_(epoch)
    sod = F.pmod(e, F.lit(DAY))
    txt = F.format_string(
        "%sT%02d:%02d:%02d+00:00",
        epoch_date_str(e),
        (sod / 3600).cast("int"),
        (F.pmod(sod, F.lit(3600)) / 60).cast("int"),
        F.pmod(sod, F.lit(60)).cast("int"),
    )
    return F.when(e.isNull(), F.lit("")).otherwise(txt)


def parse_epoch(text, digits: bool = True) -> Column:
    """Mixed-format timestamp text -> epoch seconds (LONG); unparseable -> NULL.

    Text without an offset is taken as UTC.  With ``digits``, epoch digits (10
    or 13) are read as seconds / milliseconds.  A time without a date is NULL,
    never the day of the run.
    """
    trimmed = s = F.trim(col_(text))
    s = F.when(~s.rlike(r"(?i)^t?\d{1,2}:\d{2}") & ~s.rlike(r"^\d+$" if not digits else r"^$"), s)
    # fast path: ISO text with an explicit zone (``Z`` or ``+hh:mm``) casts directly
    explicit = (s.endswith("Z") | (F.substring(s, -6, 1).isin("+", "-") & (F.substring(s, -3, 1) == ":")
                                   & (F.substring(s, 11, 1).isin("T", " "))))
    fast = F.when(explicit & (F.length(s) >= 20), F.try_to_timestamp(s))
    zoned = F.when(s.rlike(_HAS_ZONE), s).otherwise(F.concat(s, F.lit("Z")))
    # one lambda over the text: the formats are written out once, not with the whole text expression each

    def formats(z):
        cast = F.try_to_timestamp(F.regexp_replace(z, r"(?i)\s*(utc|gmt)$", "Z"))
        return F.coalesce(cast, *[F.when(z.rlike(begin), F.coalesce(*[F.try_to_timestamp(z, F.lit(fmt)) for fmt in own]))
                                  for begin, own in _ZONED_FORMATS.items()])

    ts = F.coalesce(fast, F.get(F.transform(F.array(zoned), formats), F.lit(0)))
    from_ts = F.unix_seconds(ts)
    possible = trimmed.rlike(_POSSIBLE)  # outermost, as the rest names the text many times
    if not digits:
        return F.when(possible, from_ts)
    epoch = F.when(s.rlike(r"^\d{13}$"), F.floor(s.cast("double") / 1000).cast("long")).when(
        s.rlike(r"^\d{10}$"), s.cast("long"))
    return F.when(possible, F.coalesce(F.when(~s.rlike(r"^\d+$"), from_ts), epoch))


def epoch_from_ntz(ts) -> Column:
    """TIMESTAMP_NTZ (wall clock taken as UTC) -> epoch seconds, independent of the session zone.

    Built from the NTZ calendar date and time-of-day fields, which carry no
    zone; sub-second parts are dropped (floor for post-1970 values).
    """
    c = col_(ts)
    return (F.unix_date(F.to_date(c)).cast("long") * F.lit(DAY) + F.hour(c).cast("long") * 3600
            + F.minute(c).cast("long") * 60 + F.second(c).cast("long"))


def epoch_of(df, ts: str) -> Column:
    """Epoch seconds of a timestamp column: NTZ wall clock as UTC, or an instant as is."""
    from pyspark.sql.types import TimestampNTZType
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        return epoch_from_ntz(ts)
    return F.unix_seconds(F.col(ts))
