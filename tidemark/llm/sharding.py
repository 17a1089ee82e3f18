"""Shards by a hierarchical weighted hash tree.

Inner nodes are regions and racks, leaves are shards. A document descends from the root: at each node every child draws
-ln(u) / weight with u from the MD5 of (document key, child name), and the smallest draw wins, so children are chosen in
proportion to their weights. A draw depends on the child's own name and weight alone: where weights of one subtree
change, documents move into or out of that subtree only. `grow` adds a shard as a region of its own, whose draw enters
at the root while all others stay as they are; documents move into the new shard and nowhere else. Each level of the
descent is a column of SQL functions.

`tree_of(n)` is the tree for n shards: the first BASE in regions of RACKS x SHARDS, every later one a region of its own
(below BASE all of them are), so that any step from BASE upwards only fills the new shard.

Law of the query: `key`. Defined results: null doc_ids hash as the word "null"; repeated ids go to the same shard; a null
text has no bytes (size 8, CRC 0); an empty table gives an empty result; slots are gapless from 0 in every shard.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE, RACKS, SHARDS = 24, 2, 3
#: Hexadecimal digits of the buckets for numbering slots: one group is a 4096th of a shard.
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Node:
    """A leaf has a shard and a weight, an inner node has children; its weight is the sum of theirs."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    own: float = 1.0

    @cached_property
    def weight(self) -> float:
        return math.fsum(c.weight for c in self.children) if self.children else self.own

    @property
    def shards(self) -> list[int]:
        return [s for c in self.children for s in c.shards] if self.children else [self.shard]

    def grow(self, shard: int, weight: float = 1.0) -> "Node":
        """One more shard, as a region of its own."""
        return Node(self.name, (*self.children, _alone(shard, weight)))

    def reweigh(self, shard: int, weight: float) -> "Node":
        """Another weight for one shard: documents move between its subtree and the rest at each level, nowhere else."""
        if self.children:
            return Node(self.name, tuple(c.reweigh(shard, weight) for c in self.children))
        return Node(self.name, shard=self.shard, own=weight) if self.shard == shard else self


def _alone(shard: int, weight: float = 1.0) -> Node:
    return Node(f"region-of-{shard}", (Node(f"rack-of-{shard}", (Node(f"shard-{shard}", shard=shard, own=weight),)),))


def tree_of(n: int) -> Node:
    if n < 1:
        raise ValueError("a tree needs at least one shard")
    regions = []
    if n >= BASE:
        per = RACKS * SHARDS
        for r in range(BASE // per):
            racks = tuple(Node(f"region-{r}/rack-{k}", tuple(Node(f"shard-{s}", shard=s) for s in range(r * per + k * SHARDS, r * per + (k + 1) * SHARDS))) for k in range(RACKS))
            regions.append(Node(f"region-{r}", racks))
    first = BASE if n >= BASE else 0
    return Node("root", (*regions, *(_alone(s) for s in range(first, n))))


#: Hexadecimal digits of the MD5 that make a draw: whole numbers below 2 to the 52, exact as doubles.
DIGITS = 13


def _draw(key: str, node: Node) -> float:
    """Exponential with the node's weight as its rate: the smallest of several wins in proportion to the weights."""
    u = int(hashlib.md5(f"{key}/{node.name}".encode()).hexdigest()[:DIGITS], 16)
    return -math.log((u + 0.5) / 16.0**DIGITS) / node.weight


def _live(node: Node) -> list[Node]:
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError(f"no weight below {node.name}")
    return live


def place(tree: Node, key: str) -> int:
    """The shard of a document key: one draw for each child on the way down. The scalar form of `shard_sql`."""
    while tree.children:
        live = _live(tree)
        tree = live[0] if len(live) == 1 else min(live, key=lambda c: _draw(key, c))
    return tree.shard


def _number(of: Column) -> Column:
    return F.conv(F.substring(F.md5(of), 1, DIGITS), 16, 10).cast("double")


def with_shard(rows: DataFrame, tree: Node, name: str) -> DataFrame:
    """Adds place() of the column _key. A level is a column: the draws of the children of the node that won above."""
    nodes, depth, level = [tree], 0, [tree]
    while level := [c for n in level for c in n.children]:
        nodes, depth = nodes + level, depth + 1
    number = {id(n): k for k, n in enumerate(nodes)}
    child = "struct<name:string,weight:double,node:int>"
    below = [F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(c.weight).alias("weight"), F.lit(number[id(c)]).alias("node")) for c in _live(n))) if n.children else F.array() for n in nodes]
    below = F.array(*(x.cast(f"array<{child}>") for x in below))
    draw = lambda c: -F.log((_number(F.concat(F.col("_key"), F.lit("/"), c["name"])) + 0.5) / 16.0**DIGITS) / c["weight"]
    rows = rows.withColumn("_node", F.lit(0))
    for _ in range(depth):
        drawn = F.transform(F.get(below, F.col("_node")), lambda c: F.struct(draw(c).alias("draw"), c["node"].alias("node")))
        rows = rows.withColumn("_node", F.coalesce(F.array_min(drawn)["node"], F.col("_node")))
    return rows.withColumn(name, F.get(F.array(*(F.lit(n.shard) for n in nodes)), F.col("_node")).cast("int")).drop("_node")


def with_slots(rows: DataFrame, shard: str, *order: Column) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, ordered by a key bucket and then `order`.

    No task sorts a whole shard: rows are numbered inside (shard, bucket), and the bucket's first slot comes from the
    counts, at most 4096 rows a shard.
    """
    counts = rows.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(shard).alias("_shard"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order)
    numbered = rows.withColumn("_rn", F.row_number().over(inside))
    out = numbered.join(F.broadcast(first), (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_of")))
    return out.withColumn("slot", (F.col("_first") + F.col("_rn") - 1).cast("long")).drop("_rn", "_shard", "_of", "_first", "_bucket")


def shards(docs: DataFrame, n: int = BASE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    tree = tree_of(n)
    key, crc = F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("null")), F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(docs["text"]), F.lit(0)) + 8).cast("long").alias("size"),
        crc.cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.substring(F.md5(F.concat(key, F.lit("/slot/"), crc.cast("string"))), 1, BUCKET_DIGITS).alias("_bucket"),
        key.alias("_key"),
    )
    rows = with_shard(with_shard(rows, tree, "shard"), tree.grow(n), "grown_shard").drop("_key")
    out = with_slots(rows, "shard", F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _oracle() -> str:
    """The draws as a relation, level by level, and CRC-32 byte by byte over a table that SQL builds from its rule."""
    draw = lambda name, weight: f"-ln((CAST('0x' || substr(md5(k || '/' || {name}), 1, {DIGITS}) AS BIGINT) + 0.5) / {16**DIGITS}.0) / {weight}"
    regions = BASE // (RACKS * SHARDS)
    steps = ", ".join(f"t{i} AS (SELECT c, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM t{i - 1})" for i in range(1, 9))
    return f"""
WITH t0 AS (SELECT range AS c, CAST(range AS BIGINT) AS x FROM range(256)), {steps},
crc_table AS (SELECT list(x ORDER BY c) AS tbl FROM t8),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS t FROM documents),
bytes AS (SELECT rid, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST(CAST('0x' || h AS INT) AS BIGINT)) AS b FROM d),
crc AS (SELECT rid, xor(list_reduce(b, lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM bytes, crc_table),
region AS (SELECT rid, arg_min(r, w) AS r, min(w) AS w FROM (SELECT rid, r, {draw("'region-' || r", f"{RACKS * SHARDS}.0")} AS w FROM d, range({regions}) x(r)) GROUP BY rid),
rack AS (SELECT rid, arg_min(a, w) AS a FROM (SELECT rid, a, {draw("'region-' || r || '/rack-' || a", f"{SHARDS}.0")} AS w FROM d JOIN region USING (rid), range({RACKS}) x(a)) GROUP BY rid),
leaf AS (SELECT rid, arg_min(s, w) AS s FROM (SELECT rid, s, {draw("'shard-' || s", "1.0")} AS w
         FROM (SELECT rid, k, r * {RACKS * SHARDS} + a * {SHARDS} + i AS s FROM d JOIN region USING (rid) JOIN rack USING (rid), range({SHARDS}) x(i))) GROUP BY rid),
placed AS (SELECT doc_id, k, CAST(strlen(t) + 8 AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, CAST(s AS INT) AS shard,
                  CAST(CASE WHEN {draw(f"'region-of-{BASE}'", "1.0")} < w THEN {BASE} ELSE s END AS INT) AS grown_shard
           FROM d JOIN crc USING (rid) JOIN region USING (rid) JOIN leaf USING (rid))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || '/slot/' || text_crc32), 1, {BUCKET_DIGITS}), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM placed
"""


ORACLE_SQL = _oracle()
