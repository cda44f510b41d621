"""Connected components of a link table, by large-star and small-star steps.

Every step is a few joins; the links of a step are written to the shared folder
and read back, so lineage stays short and nothing but two numbers per step
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jamscope.llm.common import staged


def _least(links: DataFrame) -> DataFrame:
    """Links ``u, v`` with ``least``, the smallest end among ``u`` and its neighbours."""
    smallest = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(smallest, "u").select(
        "u", "v", F.least("u", "m").alias("least")
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _least(down)
    again = starred.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return again.unionByName(starred.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of a link; ``root`` is the smallest node reachable.

    The roots themselves are not listed.  Links of a node with itself and NULL
    ends say nothing; repeated links count once; no links give an empty table.
    """
    current = staged(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "links",
    )
    seen = None
    while True:
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == seen or not state[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)
        current = staged(_small_star(_large_star(current).distinct()), "links")
