"""Runs of documents that ask one another about shared keys.

A run is a set of documents of about RUN_BYTES of text, chosen by a hash of the id: large enough for numpy, small enough
for one Python worker. To learn something about the keys of all documents (how often a word occurs, who had a passage
first), each run sends every distinct key once, in order, cut into buckets by the key's leading bits; a bucket folds the
values of equal keys and answers each run in the order of its keys. A key that a third of all rows hold costs one entry a
run, so no group grows with a key's frequency, and no document travels for its keys.

Keys are 64-bit hashes whose leading bits are uniform.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, lean, pieces, release_shuffles, text_bytes

RUN_BYTES = 8_000_000

_MULTIPLIERS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLIERS[0]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLIERS[1]
    return x ^ (x >> np.uint64(31))


def in_runs(docs: DataFrame, each: int = RUN_BYTES, *more: Column) -> tuple[DataFrame, int]:
    """(run, doc_id, text, more...) and the number of runs. Rows without an id are spread by their text."""
    release_shuffles(docs.sparkSession)  # those of an earlier stage
    n = pieces(text_bytes(docs), each)
    return dealt(docs, n, *more), n


def dealt(docs: DataFrame, n: int, *more: Column) -> DataFrame:
    """(run, doc_id, text, more...) over n runs."""
    rows = id_and_text(docs)
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text")))
    return rows.select(F.pmod(key, F.lit(n)).cast("int").alias("run"), "doc_id", "text", *more)


def bucket_bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets begins in sorted keys: bucket b holds the keys with floor(key / 2^32 x n / 2^32) = b."""
    return np.searchsorted(((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


Asked = tuple[np.ndarray, dict[str, np.ndarray]]

_ASK = "bucket int, run int, cols binary"
_ANSWER = "run int, bucket int, answer binary"


def pack(columns: dict[str, np.ndarray]) -> bytes:
    import zstandard

    head = ";".join(f"{k},{v.dtype.str},{v.size}" for k, v in columns.items())
    body = b"".join(np.ascontiguousarray(v).view(np.uint8).reshape(v.size, -1).T.tobytes() for v in columns.values())  # by byte planes: ids and positions compress well
    return zstandard.compress(head.encode() + b"\n" + body, 1)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    import zstandard

    head, _, body = zstandard.decompress(blob).partition(b"\n")
    out, at = {}, 0
    for part in head.decode().split(";") if head else []:
        name, kind, size = part.split(",")
        size, width = int(size), np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(body, np.uint8, size * width, at).reshape(width, size).T).view(kind).reshape(size)
        at += size * width
    return out


def ask(runs: DataFrame, n_buckets: int, keys_of: Callable[[pa.Table], Asked], fold: Callable[[np.ndarray, dict[str, np.ndarray], int], dict[str, np.ndarray]], own: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], dict[str, np.ndarray]] | None = None, mark_once: bool = False) -> DataFrame:
    """(run, bucket, answer): what the fold of each key says, in the order of a run's sorted distinct keys.

    keys_of gives a run's sorted distinct keys and columns of the same length; fold(inverse, columns, n) gives columns
    by distinct key of a bucket; own(asked, folded) may say what of them a run is told. With mark_once, "once" is true
    for each key in one run's answer alone, so that sums over all answers take every key once.
    """

    def out(table: pa.Table) -> pa.Table:
        keys, columns = keys_of(table)
        bounds, run = bucket_bounds(keys, n_buckets), table.column("run")[0].as_py()
        rows = [(b, s, e) for b, (s, e) in enumerate(zip(bounds, bounds[1:])) if e > s]
        return pa.table({
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
            "run": pa.array([run] * len(rows), pa.int32()),
            "cols": pa.array([pack({"step": np.diff(keys[s:e], prepend=np.uint64(0))} | {k: v[s:e] for k, v in columns.items()}) for _, s, e in rows], pa.binary()),
        })

    def back(table: pa.Table) -> pa.Table:
        columns = [unpack(x) for x in table.column("cols").to_pylist()]
        keys = [np.cumsum(c.pop("step"), dtype=np.uint64) for c in columns]
        distinct, at_first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        once = np.zeros(len(inverse), bool)
        once[at_first] = True
        joined = {k: np.concatenate([c[k] for c in columns]) for k in columns[0]}
        folded = fold(inverse, joined, len(distinct))
        told, at = [], 0
        for k, c in zip(keys, columns):
            here = {name: v[inverse[at : at + len(k)]] for name, v in folded.items()}
            here = own(c, here) if own else here
            told.append(pack(here | {"once": once[at : at + len(k)]} if mark_once else here))
            at += len(k)
        return pa.table({"run": table.column("run"), "bucket": table.column("bucket"), "answer": pa.array(told, pa.binary())})

    return runs.groupBy("run").applyInArrow(lean(out), _ASK).groupBy("bucket").applyInArrow(lean(back), _ANSWER)


def answers(table: pa.Table) -> dict[str, np.ndarray]:
    """The answers of one run, in the order of its sorted keys."""
    parts = [unpack(b) for _, b in sorted(zip(table.column("bucket").to_pylist(), table.column("answer").to_pylist()))]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def with_answers(runs: DataFrame, replies: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f(documents of a run, rows of replies for it), for every run."""
    return runs.groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(lean(f), schema)


def _sliding(best: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, w: int) -> np.ndarray:
    """best over x[p : p + w] for each p: windows of doubling width, then two that overlap."""
    have = 1
    while 2 * have <= w:
        x = best(x[: len(x) - have], x[have:])
        have *= 2
    return best(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


#: Values that the sliding windows hold at once, whatever the length of a run.
STRETCH = 1 << 18


def minimizers(x: np.ndarray, w: int) -> np.ndarray:
    """Positions whose value is the least of some window of w values (ties are all taken)."""
    found = [_minimizers(x, w, s, min(len(x), s + STRETCH)) for s in range(0, len(x), STRETCH)] if len(x) >= w else []
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _minimizers(x: np.ndarray, w: int, s: int, e: int) -> np.ndarray:
    """Those between s and e: a position's windows reach w - 1 values to either side."""
    a = max(0, s - w + 1)
    part = x[a : min(len(x), e + w - 1)]
    if len(part) < w:
        return np.zeros(0, np.int64)
    low, pad = _sliding(np.minimum, part, w), np.zeros(w - 1, x.dtype)
    # No window that holds a position has a larger minimum than its value; one has that very value.
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate((pad, low, pad)), w) == part) + a
    return at[(at >= s) & (at < e)]
