"""Connected components of a link table, as alternating star contractions.

Each round lets every node point its larger neighbours (large star) and then its smaller ones (small star) at the
smallest node it knows; a component ends as a star around its smallest node after about log2 squared rounds. Links never
leave the executors; each round is written to the shared folder, so lineage stays short and lost executors cost no more
than a round. A hub's links are dealt over SALTS parts by their other end: parts are folded to their least neighbour first,
and the node's least one goes back to the parts that exist, so no task holds all links of a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Rounds after which something must be wrong: enough for paths of 2 to the 40 nodes and more.
MOST = 60
#: Parts of a hub's links.
SALTS = 256


def _star(links: DataFrame, small: bool) -> DataFrame:
    """links: (a, b) with a > b. One contraction; gives (a, b) with a > b again, without repeats."""
    near = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = near.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = near.groupBy("a", "s").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("s").alias("of")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "of")
    met = near.join(least.select("u", "m", F.explode("of").alias("t")), (F.col("a") == F.col("u")) & (F.col("s") == F.col("t")))
    if small:
        out = met.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
    else:
        out = met.filter("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    return out.filter("x > y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that is linked to a smaller one; root is the smallest node of its component.

    links: (a, b) of one orderable type; order, repeats and links of a node to itself don't matter, nulls are dropped.
    """
    now = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(MOST):
        # A node with two smaller neighbours, or a root that is itself linked to a smaller node, means work is left.
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = stored(_star(_star(now, small=False), small=True))
    raise RuntimeError("components did not settle")
