"""Groups of linked rows: connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.sources.tables import written


def linked_groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(member, group) of every row with a link; a group is named by its least member.

    A round hands every member the least name among itself and its neighbours, points all neighbours at it, and
    goes on with these pointers; long chains halve their length. Rounds end when every pointer names a root, so
    their number follows the logarithm of the longest chain. Each is two aggregates with partial sums and one join
    on the member, written to the shared folder.
    """
    one, two = F.col(a), F.col(b)
    now = links.filter(one != two).select(F.greatest(one, two).alias("member"), F.least(one, two).alias("group")).distinct()
    now = written(now, "links")
    while True:
        both = now.unionByName(now.select(F.col("group").alias("member"), F.col("member").alias("group")))
        least = both.groupBy("member").agg(F.least(F.min("group"), F.col("member")).alias("least"))
        # larger neighbours follow the least one, the others follow their own least one
        moved = both.join(least, "member").select(F.greatest("group", "least").alias("member"), F.least("group", "least").alias("group"))
        after = written(moved.unionByName(least.select("member", F.col("least").alias("group"))).filter("member <> group").distinct(), "links")
        pending = after.groupBy("member").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("member").unionByName(
            after.select("member").join(after.select(F.col("group").alias("member")), "member", "left_semi")
        )
        now = after
        if not pending.limit(1).count():
            break
    return now.unionByName(now.select(F.col("group").alias("member"), "group").distinct())
