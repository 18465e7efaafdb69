"""Looking up one row for each group, when a few groups may hold most rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def look_up(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Every row with the columns of its group; `groups` has one row for each value of `keys`.

    Groups of at least one row in `HOT_SHARE` go to every task: `size` counts the
    rows of a group, so there are at most `HOT_SHARE` of these, however many rows
    there are. All others are joined by a shuffle, in which no key has more than
    that share. Null keys meet null keys. Both tables are read twice: give tables
    that are stored.
    """
    total = groups.agg(F.sum(F.col(size).cast("decimal(38,0)"))).first()[0] or 0
    heavy = F.col(size) * F.lit(HOT_SHARE).cast("decimal(38,0)") >= F.lit(total)
    names = {key: f"_group_{key}" for key in keys}
    keyed = groups.withColumnsRenamed(names)
    same = None
    for key, name in names.items():
        one = rows[key].eqNullSafe(F.col(name))
        same = one if same is None else same & one
    hot, cold = F.broadcast(keyed.where(heavy)), keyed.where(~heavy)
    spread = rows.join(hot.select(*names.values()), same, "left_anti")
    found = rows.join(hot, same).unionByName(spread.join(cold, same))
    return found.drop(*names.values())
