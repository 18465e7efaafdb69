"""Connected components of a graph given as a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written_once


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `root` for every node of the links; equal roots mean connected.

    Each round ranks all nodes anew by a hash. Every node joins its first
    neighbour, or none if it comes before them all; the links are renamed to
    what their ends joined, and links within one node go. Whatever the order of
    the given numbers, a rank is as good as random, so a constant share of the
    nodes goes in a round and few rounds are needed. A round takes minima that combine
    before the shuffle; no node's neighbours are ever gathered. Rounds are cut by
    tables in the shared folder. Null ends are no nodes; self links and repeated links
    change nothing. A root is any node of its component.
    """
    given = links.select(a, b).dropna().select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = written_once(given.distinct(), "components-links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = links.where("a <> b")
    names, rounds = None, 0
    while not links.isEmpty():
        rounds += 1
        ranked = [F.struct(F.xxhash64(end, F.lit(rounds)).alias("rank"), F.col(end).alias("node")) for end in ("a", "b")]
        ends = F.array(*[F.struct(F.col(end).alias("node"), F.least(*ranked).alias("first")) for end in ("a", "b")])
        joined = written_once(
            links.select(F.explode(ends).alias("x"))
            .groupBy(F.col("x.node").alias("node"))
            .agg(F.min("x.first").alias("first"))
            .select("node", F.col("first.node").alias("next")),
            "components-joined",
        )
        links = (
            links.join(joined.select(F.col("node").alias("a"), F.col("next").alias("next_a")), "a")
            .join(joined.select(F.col("node").alias("b"), F.col("next").alias("next_b")), "b")
            .where("next_a <> next_b")
            .select(F.least("next_a", "next_b").alias("a"), F.greatest("next_a", "next_b").alias("b"))
            .distinct()
        )
        links = written_once(links, "components-links")
        if names is None:
            names = joined.select("node", F.col("next").alias("root"))
        else:
            names = written_once(
                names.join(joined.select(F.col("node").alias("root"), "next"), "root", "left").select(
                    "node", F.coalesce("next", "root").alias("root")
                ),
                "components-names",
            )
    if names is None:
        return nodes.select("node", F.col("node").alias("root"))
    return nodes.join(names, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
