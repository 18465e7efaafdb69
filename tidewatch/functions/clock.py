"""Time helpers. Clock-dependent operators take `as_of`; None means now."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment(as_of: Column | dt.datetime | None) -> Column:
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def before(as_of, *, days: float = 0, hours: float = 0, minutes: float = 0) -> Column:
    """`as_of` minus a duration."""
    span = dt.timedelta(days=days, hours=hours, minutes=minutes)
    return moment(as_of) - F.lit(span)


def last_time(df: DataFrame, column: str = "timestamp") -> Column:
    """The newest time of a table, as a scalar subquery."""
    return df.select(F.max(column)).scalar()


def delay_ms(processed: Column, event: Column, exact: bool = False) -> Column:
    """Delay in ms from whole seconds; `exact` keeps the sub-second part."""
    processed, event = processed.cast("timestamp"), event.cast("timestamp")
    if exact:
        return F.unix_millis(processed) - F.unix_millis(event)
    return (F.unix_seconds(processed) - F.unix_seconds(event)) * F.lit(1000).cast("long")


def compact_stamp(time: Column) -> Column:
    return F.date_format(time, "yyyyMMddHHmmss")


def clock_label(time: Column) -> Column:
    return F.date_format(time, "HH:mm:ss")


def iso_text(time: Column) -> Column:
    """ISO-8601 text; the fraction is left out when it is zero."""
    return F.when(
        F.date_format(time, "SSSSSS") == "000000", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
