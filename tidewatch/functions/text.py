"""Alert and table texts, and the naming rules of stored tables."""

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.clock import iso_text
from tidewatch.functions.ladders import severity_label


def present(columns, name: str, default: str) -> Column:
    """The column as text, or `default` where it is NULL or not in the table."""
    if name not in columns:
        return F.lit(default)
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def filled(template: str, field: Callable[[str], Column]) -> Column:
    """A template with each {name} replaced by the text of `field(name)`."""
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(field(name))
    return F.concat(*pieces)


def by_source(source: Column, texts: dict[str, Column], other: Column) -> Column:
    chosen = F
    for name, text in texts.items():
        chosen = chosen.when(source == name, text)
    return chosen.otherwise(other)


def alert_text(columns, severity: Column | str = "severity") -> Column:
    """The message of an alert; `columns` are the columns the anomaly row has."""
    score = F.col("anomaly_score").cast("double") if "anomaly_score" in columns else F.lit(None)
    made = {
        "severity_label": severity_label(severity),
        "anomaly_score": F.format_string(K.SCORE_FORMAT, F.coalesce(score, F.lit(0.0))),
        "timestamp": F.coalesce(iso_text(F.col("timestamp")), F.lit(K.MISSING_TEXT)),
        "unit": present(columns, "unit", ""),
        "details": F.to_json(F.struct(*columns)),
    }

    def field(name: str) -> Column:
        return made[name] if name in made else present(columns, name, K.MISSING_TEXT)

    def message(lines: list[str]) -> Column:
        return F.concat_ws("\n", *[filled(line, field) for line in lines])

    texts = {source: message(lines) for source, lines in K.ALERT_TEXTS.items()}
    return by_source(field("source"), texts, message(K.OTHER_ALERT_TEXT))


def subject_line(columns) -> Column:
    return filled(K.SUBJECT_TEXT, lambda name: present(columns, name, K.MISSING_SOURCE_IN_SUBJECT))


def number_text(value: Column) -> Column:
    """A number as a browser prints it: whole numbers carry no fraction."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def table_cells() -> tuple[Column, Column]:
    """Details and value cells of the anomaly table, by source."""
    numbers = ("value", "engagement_count", "price", "price_change_percent")

    def field(name: str) -> Column:
        return number_text(F.col(name)) if name in numbers else F.col(name)

    cells = [
        by_source(
            F.col("source"),
            {source: filled(pair[at], field) for source, pair in K.TABLE_CELLS.items()},
            F.lit(""),
        )
        for at in (0, 1)
    ]
    return cells[0], cells[1]


def short_source(source="source") -> Column:
    return F.regexp_replace(F.col(source), K.SOURCE_SUFFIX, "")


def stored_name(name: str, prefix: str = "tidewatch_") -> str:
    """Stored tables carry a prefix; add it where it is missing."""
    return name if name.startswith(prefix) else f"{prefix}{name}"


def restore_target(archive_path: str, prefix: str = "tidewatch_") -> str:
    """The table an archive belongs to: the folder below `archives`."""
    parts = [part for part in archive_path.split("/") if part]
    if "archives" not in parts or parts.index("archives") + 1 >= len(parts) - 1:
        raise ValueError(f"no target table in archive path {archive_path}")
    return stored_name(parts[parts.index("archives") + 1], prefix)
