"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared by characters, with ASCII letters lower-cased and runs of white space as one space. A document leaks a
benchmark item if some region of it is within the item's edit budget e = floor(EDITS x m) of the whole item (m its
characters). Such a region shares at least T = m - q + 1 - q e q-grams with the item, all on diagonals within e of each
other. Diagonals are cut into bands of 2 (e + 1) that overlap by half, so one band holds all of them; bands with T hits or
more are kept, two that overlap as one, and verified by an alignment whose table has the band's diagonals and e more on
either side, a row for each character of the item. Alignments of like size run together. e is lowered where T would fall
below 1, and items shorter than q must occur as they are. Nothing is sampled or cut: every q-gram of every text is looked
up, and hits are counted in pieces of PIECE, so that memory does not grow with the items that share a q-gram.

Items are a stated query set. They go to the executors in blocks of at most BLOCK characters, one block after the other
with the documents written between, so that a worker holds one block however many items there are.

Defined results: null and empty texts leak nothing; null and empty items are leaked by nothing; items with equal texts
are all reported; every document row gives one row, repeated rows too; without documents or items the result is empty or
clean; other columns, whatever their names, are ignored by `decontamination` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean_batches, pieces, stored

Q = 10
EDITS = 0.08
#: Characters of items that a worker holds at once.
BLOCK = 4_000_000
#: Characters of documents whose q-grams are looked up together, hits that are counted together, cells of tables aligned together.
CHUNK, PIECE, CELLS = 1_000_000, 1_000_000, 500_000
_M = 0x9E3779B97F4A7C15
#: No text holds this code point: no q-gram spans two documents and matches.
_EDGE = np.uint32(0xFFFFFFFF)


def folded(text: str | None) -> str:
    return b" ".join((text or "").encode().lower().split()).decode()


def points(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def budget(m: int) -> int:
    """Edits allowed for an item of m characters; the lemma's threshold stays at 1 or more."""
    return max(0, min(int(EDITS * m), (m - Q) // Q))


def _grams(a: np.ndarray) -> np.ndarray:
    """A 64-bit code for the Q characters from each position on: windows of doubling length, put together."""
    if len(a) < Q:
        return np.zeros(0, np.uint64)
    x, out, width, at = a.astype(np.uint64) + np.uint64(1), None, 1, 0
    power = lambda n: np.uint64(pow(_M, n, 2**64))
    while True:
        if Q & width:
            part = x[at : len(a) - Q + at + 1]
            out = part if out is None else out * power(width) + part
            at += width
        if 2 * width > Q:
            break
        x = x[:-width] * power(width) + x[width:]
        width *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(_M)
    return out ^ (out >> np.uint64(32))


class Items:
    """A block of items with an index of their q-grams."""

    BITS = 22

    def __init__(self, rows: list[tuple[int, str]]):
        texts: dict[bytes, list[int]] = {}
        for i, t in rows:
            if f := folded(t):
                texts.setdefault(f, []).append(i)
        self.ids, self.texts = list(texts.values()), list(texts)
        self.points = [points(t) for t in self.texts]
        m = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(x) for x in m], np.int64)
        self.need = m - Q + 1 - Q * self.edits
        self.short = [k for k, t in enumerate(self.texts) if len(t) < Q]
        codes, item, pos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, t in enumerate(self.points):
            g = _grams(t)
            codes.append(g)
            item.append(np.full(len(g), k))
            pos.append(np.arange(len(g)))
        codes, item, pos = (np.concatenate(x) for x in (codes, item, pos))
        order = np.argsort(codes, kind="stable")
        self.codes, self.item, self.pos = codes[order], item[order], pos[order]
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[codes >> np.uint64(64 - self.BITS)] = True

    def bands(self, all_points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(document, item, band) with as many hits as the lemma asks for, sorted."""
        g = _grams(all_points)
        at = np.flatnonzero(self.seen[g >> np.uint64(64 - self.BITS)])
        lo, hi = (np.searchsorted(self.codes, g[at], side=s) for s in ("left", "right"))
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        ends = np.cumsum(n)
        rows, count = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        s = 0
        while s < len(at):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PIECE, side="right")))
            where = np.repeat(at[s:e], n[s:e])
            entry = np.repeat(lo[s:e] - (ends[s:e] - n[s:e]) + (ends[s] - n[s]), n[s:e]) + np.arange(len(where))
            doc, item = np.searchsorted(starts, where, side="right") - 1, self.item[entry]
            diagonal = where - starts[doc] - self.pos[entry] + 2**40  # above 0
            band = diagonal // (self.edits[item] + 1)
            found = np.concatenate((rows, np.stack((doc, item, band), 1), np.stack((doc, item, band - 1), 1)))
            weight = np.concatenate((count, np.ones(2 * len(doc), np.int64)))
            order = np.lexsort(found.T[::-1])
            found, weight = found[order], weight[order]
            first = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]).any(1)])
            rows, count = found[first], np.add.reduceat(weight, first)
            s = e
        return rows[count >= self.need[rows[:, 1]]]

    def find(self, docs: list[str]) -> list[set[int]]:
        """Indexes of the items that each document leaks."""
        out: list[set[int]] = [set() for _ in docs]
        for k in self.short:
            for d, t in enumerate(docs):
                if self.texts[k] in t:
                    out[d].add(k)
        if not len(self.codes):
            return out
        parts = [points(t) for t in docs]
        starts = np.cumsum([0] + [len(t) + 1 for t in parts])[:-1]
        rows = self.bands(np.concatenate([x for t in parts for x in (t, [_EDGE])]).astype(np.uint32), starts)
        # Overlapping bands as one: (document, item, first diagonal, diagonals), each with e more on either side.
        asked, k = [], 0
        listed = rows.tolist()
        while k < len(listed):
            d, i, b = listed[k]
            two = k + 1 < len(listed) and listed[k + 1] == [d, i, b + 1]
            e = int(self.edits[i])
            asked.append((d, i, b * (e + 1) - 2**40 - e, (3 if two else 2) * (e + 1) + 2 * e))
            k += 2 if two else 1
        left = []
        for d, i, low, width in asked:
            if i in out[d]:
                continue
            if self.texts[i] in docs[d][max(0, low) : max(0, low + width + len(self.texts[i]))]:
                out[d].add(i)
            elif self.edits[i]:
                left.append((d, i, low, width))
        left.sort(key=lambda x: (len(self.texts[x[1]]), x[3]))
        k = 0
        while k < len(left):
            to = k + 1
            while to < len(left) and (to + 1 - k) * (left[to][3] + (m := len(self.texts[left[to][1]]))) <= CELLS and m <= 1.25 * len(self.texts[left[k][1]]) + 8:
                to += 1
            own = left[k:to]
            near = within([self.points[i] for _, i, _, _ in own], [parts[d] for d, _, _, _ in own], [x[2] for x in own], max(x[3] for x in own), [int(self.edits[x[1]]) for x in own])
            for (d, i, _, _), yes in zip(own, near.tolist()):
                if yes:
                    out[d].add(i)
            k = to
        return out


def within(items: list[np.ndarray], docs: list[np.ndarray], low: list[int], width: int, edits: list[int]) -> np.ndarray:
    """Whether some substring of each document is within so many edits of its item, on diagonals low to low + width - 1.

    Banded alignment of several pairs at once: a row of the table holds the diagonals of the band alone. Before its start
    and behind its end a document goes on with characters that match nothing, which can only cost more.
    """
    n, m = len(items), np.array([len(x) for x in items])
    most = int(m.max())
    text = np.full((n, most + width), _EDGE, np.uint32)
    item = np.full((n, most), _EDGE - np.uint32(1), np.uint32)
    for k, (x, d, a) in enumerate(zip(items, docs, low)):
        item[k, : len(x)] = x
        s, e = max(0, a), min(len(d), a + most + width)
        if e > s:
            text[k, s - a : e - a] = d[s:e]
    steps = np.arange(width, dtype=np.int32)
    row, best, live = np.zeros((n, width), np.int32), np.full(n, 2**30), np.arange(n)
    edits = np.array(edits)
    for k in range(most):
        new = row + (text[live, k : k + width] != item[live, k : k + 1])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, 1) + steps  # gaps along the document
        least = row.min(1)
        done = m[live] == k + 1
        best[live[done]] = least[done]
        keep = ~done & (least <= edits[live])
        if not keep.all():
            row, live = row[keep], live[keep]
            if not len(live):
                break
    return best <= edits


def _leaks(items_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(items_of.value)
        for batch in batches:
            texts = [folded(t) for t in batch.column("_text").to_pylist()]
            found, k = [], 0
            while k < len(texts):
                size, end = len(texts[k]), k + 1
                while end < len(texts) and size + len(texts[end]) < CHUNK:
                    size += len(texts[end])
                    end += 1
                found += items.find(texts[k:end])
                k = end
            ids = [sorted(old + [i for x in new for i in items.ids[x]]) for old, new in zip(batch.column("item_ids").to_pylist(), found)]
            yield batch.set_column(batch.schema.get_field_index("item_ids"), "item_ids", pa.array(ids, pa.list_(pa.int64())))

    return run


def with_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: _row (all its columns) and item_ids, the sorted ids of the items it leaks."""
    spark = docs.sparkSession
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    blocks = pieces(2 * total, block) if total > block else 1 if total else 0
    rows = docs.select(F.struct("*").alias("_row"), docs["text"].alias("_text"), F.array().cast("array<long>").alias("item_ids"))
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        held = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.collect()])  # a block: half of BLOCK on average
        rows = rows.mapInArrow(lean_batches(_leaks(held)), rows.schema)
        if b + 1 < blocks:
            rows = stored(rows)
    return rows.select("_row", "item_ids")


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids for every row of docs."""
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    found = with_leaks(slim, benchmark)
    return found.select(F.col("_row.doc_id").alias("doc_id"), (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, with all their columns; repeated rows stay repeated, null and empty texts stay."""
    return with_leaks(docs, benchmark).filter(F.size("item_ids") == 0).select("_row.*")
