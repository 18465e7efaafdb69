"""From scored rows to alerts: threshold, cooldown, message, payload."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions import text
from tidewatch.functions.clock import moment
from tidewatch.functions.ladders import severity_label
from tidewatch.operators.cooldown import alert_key, cooldown
from tidewatch.operators.detect import zscore
from tidewatch.session import written_once

Z_AT_FULL_SEVERITY = 6.0


def severity_of_score(score="anomaly_score", full: float = Z_AT_FULL_SEVERITY) -> Column:
    """A z-score has no upper bound; alerting wants 0 to 1."""
    return F.least(F.lit(1.0), F.col(score) / F.lit(full))


def candidates(df: DataFrame, min_severity: float = K.MIN_SEVERITY) -> DataFrame:
    """Rows severe enough to alert on, with their severity label."""
    return df.filter(F.col("severity") >= min_severity).withColumn("severity_label", severity_label())


def with_message(df: DataFrame) -> DataFrame:
    columns = [name for name in df.columns if name not in ("severity", "severity_label")]
    return df.withColumns(
        {"alert_text": text.alert_text(columns), "subject": text.subject_line(columns)}
    )


def payload(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The body posted to a webhook, as columns and as one JSON text. `fields`
    are the columns of the anomaly itself."""
    score = F.coalesce(F.col("anomaly_score"), F.lit(0.0))
    body = df.select(
        F.col("alert_text").alias("text"),
        text.present(df.columns, "source", K.MISSING_TEXT).alias("source"),
        F.col("timestamp"),
        F.struct(*fields).alias("anomaly"),
        score.alias("severity"),
    )
    formats = {
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    }
    return body.withColumn("payload", F.to_json(F.struct(*body.columns), formats))


def check_requests(df: DataFrame, as_of=None) -> DataFrame:
    """Check alert requests: message, source and severity must be there and the
    severity a number. Good rows gain `manual` and a timestamp; bad ones say why."""
    missing = F
    for name in K.ALERT_FIELDS:
        missing = missing.when(F.col(name).isNull(), F.lit(K.MISSING_FIELD_TEXT.format(field=name)))
    parsed = F.col("severity").try_cast("double")
    error = missing.when(parsed.isNull(), F.lit("Severity is not a number"))
    checked = df.withColumns({"error": error, "severity": parsed})
    good = F.col("error").isNull()
    return checked.withColumns(
        {
            "valid": good,
            "manual": F.when(good, F.lit(True)),
            "timestamp": F.when(good, moment(as_of)),
        }
    )


def requested_alerts(
    df: DataFrame,
    order: Sequence[str],
    as_of=None,
    min_severity: float = K.MIN_SEVERITY,
    minutes: float = K.COOLDOWN_MINUTES,
) -> DataFrame:
    """Alerts asked for by hand: the valid requests go through the threshold
    and the cooldown like any other. A request names no entity, so all of one
    source share a cooldown."""
    good = check_requests(df, as_of).filter("valid").drop("error", "valid")
    keyed = candidates(good, min_severity).withColumn(
        "alert_key", F.concat(F.col("source"), F.lit(f":{K.MISSING_TEXT}"))
    )
    return with_message(cooldown(keyed, "alert_key", ["timestamp", *order], minutes))


def score_to_alerts(
    df: DataFrame,
    key: str,
    value: str,
    order: Sequence[str],
    min_severity: float = K.MIN_SEVERITY,
    minutes: float = K.COOLDOWN_MINUTES,
    full: float = Z_AT_FULL_SEVERITY,
    **detector,
) -> DataFrame:
    """Score a series, keep severe anomalies, apply the cooldown, write the text.

    The cooldown reads its alerts more than once, so the severe ones, a small
    share of the rows, are written out to save scoring the series again.
    """
    scored = zscore(df, key, value, order, **detector)
    flagged = scored.filter("is_anomaly = true").withColumn("severity", severity_of_score(full=full))
    keyed = candidates(flagged, min_severity).withColumn("alert_key", alert_key("source", key))
    return with_message(cooldown(written_once(keyed, "alerts"), "alert_key", order, minutes))
