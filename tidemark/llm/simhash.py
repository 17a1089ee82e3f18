"""Near-duplicates by SimHash fingerprints and a hierarchical index in Gray order.

Fingerprint: ASCII letters lower-cased, words between white space, shingles of SHINGLE words with repeats, XXH64 with
seed 42 of each; a bit is set where over half the hashes set it. Documents link when fingerprints differ in at most
DISTANCE = 2 bits.

Distinct fingerprints meet in buckets: of four 16-bit blocks two at least are equal in a linked pair, so six tables keyed
by two blocks hold every pair together. A bucket with more than HOT fingerprints is dealt anew by two of the four bytes
that are left, again in six ways; then it holds at most 65,536 distinct fingerprints, so nothing is ever cut off.
In a bucket, fingerprints sorted by Gray rank form a tree: each node holds the bits that all below it share (mask and
pattern), queries walk down adding up the differences in shared bits, and a whole group goes once they exceed DISTANCE.
Only links of a spanning forest leave a bucket.

Defined results: null and empty texts have fingerprint zero and link like any other; a text shorter than a shingle is
one shingle; equal texts and repeated rows share a component; a null doc_id is never a component's id unless there is no
other (then the id is null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, lean_batches, stored
from tidemark.llm.components import components

SHINGLE, DISTANCE, SEED = 3, 2, 42
HOT = 4096
FAN = 8
#: Queries that walk down a tree together.
TOGETHER = 512


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :])), np.uint64, len(words) - k + 1)


def fingerprint(text: str) -> int:
    h = shingle_hashes(text)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        counts += np.unpackbits(h[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(h)).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield batch.drop_columns(["text"]).append_column("fp", pa.array(fp.view(np.int64), pa.int64()))


def gray_rank(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayTree:
    """Distinct fingerprints in Gray order under nodes of FAN children."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        mask, pattern = np.full(len(fps), ~np.uint64(0)), self.fps
        self.levels = [(mask, pattern)]
        while len(pattern) > FAN:
            at = np.arange(0, len(pattern), FAN)
            both, either = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
            mask = np.bitwise_and.reduceat(mask, at) & ~(both ^ either)
            pattern = both & mask
            self.levels.append((mask, pattern))

    def pairs(self, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j in Gray order, of all pairs within the distance."""
        for first in range(0, len(self.fps), TOGETHER):
            asked = np.arange(first, min(len(self.fps), first + TOGETHER))
            top = len(self.levels[-1][1])
            q, node = np.repeat(asked, top), np.tile(np.arange(top), len(asked))
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, pattern = self.levels[depth]
                # Shared bits of a node include those of its parent: the count so far, plus the bits factored out here.
                near = np.bitwise_count((self.fps[q] ^ pattern[node]) & mask[node]) <= distance
                near &= (node + 1) * FAN**depth > q  # nothing behind the query: seen from the other side
                q, node = q[near], node[near]
                if depth:
                    width = len(self.levels[depth - 1][1])
                    q, node = np.repeat(q, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                    q, node = q[node < width], node[node < width]
            yield q[node > q], node[node > q]


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints."""
    tree, parent = GrayTree(fps), list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    a, b = [], []
    for qs, nodes in tree.pairs(distance):
        for i, j in zip(qs.tolist(), nodes.tolist()):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(i)
                b.append(j)
    return tree.fps[a], tree.fps[b]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, sub): each bucket is held by itself, at most one at a time besides the batch."""

    def links(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return forest(np.unique(np.concatenate(parts)).view(np.uint64))

    held, name = [], None
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if found:
            a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        found.clear()
        size = 0

    for batch in batches:
        if not batch.num_rows:
            continue
        key, sub, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sub", "fp"))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(fp)]
        for s, e in zip(bounds, bounds[1:]):
            now = (int(key[s]), int(sub[s]))
            if now != name:
                if sum(map(len, held)) > 1:
                    found.append(links(held))
                    size += len(found[-1][0])
                held, name = [], now
            held.append(fp[s:e])
        if size > 10_000:
            yield from flush()
    if sum(map(len, held)) > 1:
        found.append(links(held))
    yield from flush()


def _part(column, low: int, bits: int):
    return F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _keys(nodes: DataFrame) -> DataFrame:
    """(key, rest, fp): one row for each of the six tables; rest is the pair of blocks that the key leaves out."""
    tables = []
    for t, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = (x for x in range(4) if x not in (i, j))
        two = lambda x, y: F.shiftleft(_part(F.col("fp"), 16 * x, 16), 16).bitwiseOR(_part(F.col("fp"), 16 * y, 16))
        tables.append(F.struct((F.lit(t * 2**32).cast("long") + two(i, j)).alias("key"), two(k, m).alias("rest")))
    return nodes.select("fp", F.explode(F.array(*tables)).alias("t")).select("t.key", "t.rest", "fp")


def _dealt(keys: DataFrame) -> DataFrame:
    """(key, sub, fp): hot buckets once for each pair of the four bytes that are left, others with sub -1."""
    counted = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # Never by broadcast: Spark takes the six exploded rows of a fingerprint for one and a fraction of the stored file, so
    # under its default threshold tens of millions of rows would go to the driver.
    known = keys.hint("merge").join(counted, "key")  # buckets of one go
    subs = [F.lit(t * 2**16) + (F.shiftleft(_part(F.col("rest"), 8 * x, 8), 8).bitwiseOR(_part(F.col("rest"), 8 * y, 8))).cast("int") for t, (x, y) in enumerate(combinations(range(4), 2))]
    return known.select("key", F.explode(F.when(F.col("n") > HOT, F.array(*subs)).otherwise(F.array(F.lit(-1)))).alias("sub"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints that connect what any chain of links connects."""
    dealt = _dealt(_keys(fps.select("fp").distinct()))
    shuffled = dealt.repartition("key", "sub").sortWithinPartitions("key", "sub")
    return shuffled.mapInArrow(lean_batches(_bucket_links), "a long, b long")


def _rooted(fps: DataFrame) -> DataFrame:
    """(fp, first, n, root) for each distinct fingerprint: its smallest doc_id, its rows, the component's smallest fingerprint."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return nodes.join(components(links(fps)), F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, n_docs (of the component) for every row of docs."""
    fps = stored(id_and_text(docs).mapInArrow(lean_batches(_fingerprints), "doc_id long, fp long"))
    rooted = stored(_rooted(fps))
    whole = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").cast("long").alias("n_docs"))
    of = rooted.join(whole, "root").select(F.col("fp").alias("_fp"), "component_id", "n_docs")
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(of, F.col("fp") == F.col("_fp")).select("doc_id", hex16.alias("fingerprint"), "component_id", "n_docs")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: one row of each component, with all its columns.

    A row is known by its doc_id and text together. The row with the smallest doc_id stays (nulls last; of different texts
    under one id the one with the smallest digest), and of rows that repeat both id and text any one. Rows without an id are
    compared, but all of them stay. Null and empty texts are one component; an empty table stays empty.
    """
    known_by = lambda i, t: F.unhex(F.md5(F.concat(F.coalesce(i.cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(t, F.lit("")))))
    ided = id_and_text(docs).select("doc_id", known_by(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    fps = stored(ided.mapInArrow(lean_batches(_fingerprints), "doc_id long, row_key binary, fp long"))
    # Equal fingerprints are folded before they meet their component.
    order = lambda: F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    heads = fps.groupBy("fp").agg(F.min(order()).alias("head"))
    of = _rooted(fps).select(F.col("fp").alias("_fp"), "root")
    chosen = heads.join(of, F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min("head").alias("head")).select(F.col("head.row_key").alias("_kept"))
    rows = docs.select(F.struct("*").alias("_row"), known_by(docs["doc_id"], docs["text"]).alias("_key"))
    ided = rows.filter("_row.doc_id IS NOT NULL").join(chosen, F.col("_key") == F.col("_kept"), "left_semi").dropDuplicates(["_key"])
    return ided.select("_row.*").unionByName(rows.filter("_row.doc_id IS NULL").select("_row.*"))
