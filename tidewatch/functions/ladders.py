"""Category ladders: the first strict upper bound above the value names it.

A NULL value compares to no bound and so lands on the top label.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import constants as K


def ladder(value: Column | str, steps: tuple[list[tuple[float, str]], str]) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    bounds, top = steps
    chain = F
    for bound, label in bounds:
        chain = chain.when(value < F.lit(bound), F.lit(label))
    return chain.otherwise(F.lit(top))


def reading_category(sensor_type="sensor_type", value="value") -> Column:
    kind = F.col(sensor_type)
    return (
        F.when(kind == "temperature", ladder(value, K.TEMPERATURE_STEPS))
        .when(kind == "humidity", ladder(value, K.HUMIDITY_STEPS))
        .otherwise(F.lit("normal"))
    )


def engagement_level(count="engagement_count") -> Column:
    return ladder(count, K.ENGAGEMENT_STEPS)


def price_movement(percent="price_change_percent") -> Column:
    return ladder(percent, K.PRICE_STEPS)


def trading_activity(volume="volume") -> Column:
    return ladder(volume, K.VOLUME_STEPS)


def severity_label(severity="severity") -> Column:
    level = F.col(severity) if isinstance(severity, str) else severity
    return (
        F.when(level > K.HIGH_SEVERITY, F.lit("HIGH"))
        .when(level > K.MEDIUM_SEVERITY, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
