"""Rows by age, keyed changes, and the arithmetic of archive and retention."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.clock import before, compact_stamp, iso_text, moment


def with_created(df: DataFrame, as_of=None) -> DataFrame:
    """Rows gain `created_at` where they have none."""
    now = moment(as_of)
    if "created_at" not in df.columns:
        return df.withColumn("created_at", now)
    return df.withColumn("created_at", F.coalesce(F.col("created_at"), now))


def older_than(df: DataFrame, days: float = K.ARCHIVE_DAYS, as_of=None) -> DataFrame:
    return df.filter(F.col("created_at") < before(as_of, days=days))


def not_older_than(df: DataFrame, days: float, as_of=None) -> DataFrame:
    """What a retention of `days` keeps: rows without a creation time stay."""
    old = F.coalesce(F.col("created_at") < before(as_of, days=days), F.lit(False))
    return df.filter(~old)


def delete_where(df: DataFrame, where: Column) -> DataFrame:
    """All rows but those the predicate holds for; unknown is kept."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def delete_one(df: DataFrame, where: Column, order: Sequence[str]) -> DataFrame:
    """All rows but the first match along `order`, which must tell rows apart.
    The match is a single row, so it is sent to every task."""
    match = df.filter(where).orderBy(*order).limit(1).select(*[F.col(c).alias(f"_{c}") for c in order])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order]
    return df.join(F.broadcast(match), same, "left_anti")


def update_first(
    table: DataFrame, where: Column, values: dict[str, Column], order: Sequence[str], as_of=None, insert: dict[str, Column] | None = None
) -> DataFrame:
    """Set columns in the first match along `order`, which must tell rows apart,
    and stamp `updated_at`. Without a match nothing changes, or a row of
    `insert` and `values` is added. The match is one row, sent to every task."""
    now = moment(as_of)
    match = table.filter(where).orderBy(*order).limit(1)
    chosen = match.select(*[F.col(c).alias(f"_{c}") for c in order], F.lit(True).alias("_chosen"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order]
    joined = table.join(F.broadcast(chosen), same, "left")
    changed = F.coalesce(F.col("_chosen"), F.lit(False))
    stamped = {**values, "updated_at": now}
    columns = table.columns + [c for c in stamped if c not in table.columns]

    def current(name: str) -> Column:
        old = F.col(name) if name in table.columns else F.lit(None)
        return F.when(changed, stamped[name]).otherwise(old) if name in stamped else old

    updated = joined.select(*[current(name).alias(name) for name in columns])
    if insert is None:
        return updated
    added = table.sparkSession.range(1).select(
        F.lit(True).alias("_new"), *[column.alias(name) for name, column in {**insert, **stamped}.items()]
    )
    found = chosen.select(F.col("_chosen").alias("_any"))
    missing = added.join(F.broadcast(found), F.col("_new") == F.col("_any"), "left_anti").drop("_new")
    return updated.unionByName(missing, allowMissingColumns=True)


def upsert(
    table: DataFrame,
    changes: DataFrame,
    key: str,
    as_of=None,
    insert_missing: bool = True,
    order: Sequence[str] = (),
) -> DataFrame:
    """Set the columns of `changes` in the rows with the same key and stamp
    `updated_at`; keys the table lacks become new rows. A NULL change clears
    the column. Of several changes of a key the last along `order`, then along
    all columns, counts. A NULL key is a key. The table holds each key once.

    The table is only ever the left side of a join, so few changes are sent
    to its rows instead of shuffling it; a full outer join could not do that.
    """
    now = moment(as_of)
    whole = F.struct(*changes.columns)
    last = F.max_by(whole, F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*order, *changes.columns])]))
    changes = changes.groupBy(F.col(key).alias("_key")).agg(last.alias("_last")).select("_last.*")
    columns = table.columns + [c for c in changes.columns if c not in table.columns]
    if "updated_at" not in columns:
        columns.append("updated_at")

    new = changes.select(*[F.col(c).alias(f"_new_{c}") for c in changes.columns], F.lit(True).alias("_changed"))
    joined = table.join(new, F.col(key).eqNullSafe(F.col(f"_new_{key}")), "left")
    changed = F.coalesce(F.col("_changed"), F.lit(False))

    def current(name: str) -> Column:
        old = F.col(name) if name in table.columns else F.lit(None)
        if name == "updated_at":
            return F.when(changed, now).otherwise(old)
        return F.when(changed, F.col(f"_new_{name}")).otherwise(old) if name in changes.columns else old

    updated = joined.select(*[current(name).alias(name) for name in columns])
    if not insert_missing:
        return updated
    wanted = changes.select(F.col(key).alias("_wanted"))
    found = table.select(F.col(key).alias("_found")).join(wanted, F.col("_found").eqNullSafe(F.col("_wanted")), "left_semi")
    inserted = changes.join(found, F.col(key).eqNullSafe(F.col("_found")), "left_anti").withColumn("updated_at", now)
    return updated.unionByName(inserted, allowMissingColumns=True)


def archive_entry(archived: DataFrame, table: str, days: float = K.ARCHIVE_DAYS, as_of=None) -> DataFrame:
    """Description of an archive: table, record count, archive date, cutoff.
    No row when there is nothing to archive."""
    return (
        archived.agg(F.count(F.lit(1)).alias("record_count"))
        .filter(F.col("record_count") > 0)
        .select(
            F.lit(table).alias("collection"),
            F.col("record_count").cast("string").alias("record_count"),
            compact_stamp(moment(as_of)).alias("archive_date"),
            iso_text(before(as_of, days=days)).alias("cutoff_date"),
        )
    )


def reconcile(
    table: DataFrame, archived: DataFrame, key: str, days: float = K.ARCHIVE_DAYS, as_of=None
) -> DataFrame:
    """The table after archiving: rows leave it only if the archive has them.
    Only rows old enough to be archived are looked up."""
    left = older_than(table, days, as_of).join(archived.select(key), key, "left_anti")
    return not_older_than(table, days, as_of).unionByName(left)
