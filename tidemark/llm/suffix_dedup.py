"""Exact substring dedup: a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of LENGTH bytes covers it that also starts earlier. Sorting every suffix is not needed for that:
in any such string the GRAM-byte grams are hashed, and those with the least hash are its anchors. Equal strings have
their anchors at the same places, so it is enough to sort the suffixes that begin at anchors, each with the bytes
before it. Anchors whose gram occurs once in all documents are dropped first (tidemark.llm.runs asks for that).

Each run sorts its distinct anchored suffixes and sends them to buckets front-coded: the length of the prefix shared with
the suffix before, and the rest. A bucket merges its runs with a loser tree whose nodes remember how long the loser's
common prefix with the winner is: two heads are compared only from there on. The merge gives the common prefix of
neighbours, so equal suffixes and groups with the same gram come out together. Suffixes that repeat inside a run travel
once, with their first place; the answer comes back once a run and is spread over the places there.

In a group with several different suffixes (edges of repeated passages), the strings of LENGTH bytes around the anchor
are told apart by the common prefixes that the merge found and those of the bytes before the anchor, byte for byte.
Groups are settled as the merge goes on, so a bucket holds its coded runs and few suffixes besides. A gram with more than
HOT anchors (a passage in very many documents) makes no group: each string of LENGTH bytes around its anchors is sorted
by itself, in the bucket of its own bytes, and a run sends those it has several times once.

Order: doc_id (nulls last), then, among rows that repeat an id, the text's hash and the row's number, then the start.
Defined results: null and empty texts have no bytes; repeated rows are documents like any others; texts shorter than
LENGTH stay whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, pieces
from tidemark.llm.runs import answers, ask, bucket_bounds, in_runs, minimizers, mixed, pack, unpack, with_answers

LENGTH, GRAM = 100, 50
#: Bytes before an anchor that a string of LENGTH bytes can hold.
BEFORE = LENGTH - GRAM
#: Ends a side that the document's edge cuts short; no UTF-8 text holds it.
EDGE = b"\xff"
WIDTH = LENGTH + BEFORE
_B = 0x5851F42D4C957F2D
_INVERSE = pow(_B, -1, 2**64)
BLOCK = 1 << 18
#: Bytes of text in a run: a worker holds a few numbers for each byte.
RUN_BYTES = 3_000_000
_POWERS, _INVERSES = (np.concatenate((np.ones(1, np.uint64), np.full(BLOCK, b, np.uint64))).cumprod(dtype=np.uint64) for b in (_B, _INVERSE))
#: Anchors of one gram beyond which its windows travel one by one, each to the bucket of its own bytes.
HOT = 50_000


def gram_hashes(text: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of the k bytes from each position on, block by block so that arrays stay small."""
    out, step = [], BLOCK - k
    for at in range(0, len(text) - k + 1, step):
        x = text[at : at + step + k - 1].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * _POWERS[: len(x)], dtype=np.uint64)))
        out.append(mixed((sums[k:] - sums[:-k]) * _INVERSES[: len(x) - k + 1]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Run:
    """The documents of a run as one buffer, in a fixed order, with their anchors."""

    def __init__(self, table: pa.Table):
        ids = [(i is None, i or 0) for i in table.column("doc_id").to_pylist()]
        raw = [t.encode() for t in table.column("text").to_pylist()]
        tie = [xxhash.xxh64_intdigest(t) >> 16 for t in raw]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], tie[k]))
        self.run = table.column("run")[0].as_py()
        self.none = np.array([ids[k][0] for k in order], bool)
        self.doc_id = np.array([ids[k][1] for k in order], np.int64)
        self.text = [raw[k] for k in order]
        # Rows that repeat an id are in one run, so their number there orders them; rows without an id are spread by their text.
        copy = np.zeros(len(order), np.int64)
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            copy[k] = copy[k - 1] + 1 if ids[a] == ids[b] and (not ids[a][0] or tie[a] == tie[b]) else 0
        self.tie = np.where(self.none, np.array([tie[k] for k in order], np.int64) * 2**15, 0) + np.where(self.none, np.minimum(copy, 2**15 - 1), copy)
        self.buffer = np.frombuffer(EDGE.join(self.text) + EDGE, np.uint8)
        lengths = np.array([len(t) for t in self.text], np.int64)
        self.start = np.cumsum(lengths + 1) - lengths - 1
        self.end = self.start + lengths

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys of their grams; grams over an edge take no part. Least hashes are small, so they are mixed once more."""
        h = gram_hashes(self.buffer)
        edges = np.flatnonzero(self.buffer == 0xFF)
        for e in edges[edges < len(h) + GRAM - 1].tolist():
            h[max(0, e - GRAM + 1) : e + 1] = ~np.uint64(0)
        at = minimizers(h, LENGTH - GRAM + 1)
        at = at[h[at] != ~np.uint64(0)]
        return at, mixed(h[at])


def _short(h: np.ndarray) -> np.ndarray:
    """48 bits of the keys: enough to drop nearly all grams that occur once; grams that agree in them count as one."""
    return h >> np.uint64(16) << np.uint64(16)


def _grams(table: pa.Table):
    _, h = Run(table).anchors()
    keys, n = np.unique(_short(h), return_counts=True)
    return keys, {"n": n.astype(np.uint32)}


def _repeated(hot: int):
    def fold(inverse: np.ndarray, columns: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
        """0 for a gram that occurs once, 1 for others, 2 for those with more than `hot` anchors."""
        total = np.bincount(inverse, columns["n"], n)
        return {"again": (total > 1).astype(np.uint8) + (total > hot)}

    return fold


def front_coded(strings: list[bytes]) -> dict[str, np.ndarray]:
    """Sorted strings as lengths, prefix lengths shared with the string before, and the bytes that are left."""
    n = len(strings)
    length = np.array([len(s) for s in strings], np.uint8)
    table = np.zeros((n, WIDTH + 2), np.uint8)
    table[np.arange(WIDTH + 2) < length[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    shared = np.zeros(n, np.int64)
    if n > 1:
        differ = table[1:] != table[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), WIDTH + 2)
        shared[1:] = np.minimum(shared[1:], np.minimum(length[1:], length[:-1]))
    rest = table[(np.arange(WIDTH + 2) >= shared[:, None]) & (np.arange(WIDTH + 2) < length[:, None])]
    return {"length": length, "shared": shared.astype(np.uint8), "rest": rest}


def decoded(coded: dict[str, np.ndarray]) -> Iterator[tuple[bytes, int]]:
    """(string, prefix length shared with the one before) in order."""
    rest, at, before = coded["rest"].tobytes(), 0, b""
    for n, k in zip(coded["length"].tolist(), coded["shared"].tolist()):
        before = before[:k] + rest[at : at + n - k]
        at += n - k
        yield before, k


def _common(a: bytes, b: bytes, k: int) -> int:
    """Length of the common prefix, known to be at least k."""
    n = min(len(a), len(b))
    while k + 16 <= n and a[k : k + 16] == b[k : k + 16]:
        k += 16
    while k < n and a[k] == b[k]:
        k += 1
    return k


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """(string, prefix shared with the string before, run, place in the run), sorted: a loser tree over sorted runs.

    `known[r]` is the common prefix of the head of run r and the last winner it met, which is that of the output so far
    for every head on the winner's path. The head with the longer known prefix is smaller; only for equal ones are bytes
    compared, from the known prefix on.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    heads: list[bytes | None] = [None] * size
    known, place = [0] * size, [0] * size
    for r, it in enumerate(runs):
        heads[r] = next(it, (None, 0))[0]

    def beats(a: int, b: int) -> bool:
        """Whether head a goes before head b; the loser's known prefix becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        if known[a] != known[b]:
            return known[a] > known[b]
        k = _common(x, y, known[a])
        if k == len(x) == len(y):
            first = a < b
        else:
            first = k == len(x) or (k < len(y) and x[k] < y[k])
        known[b if first else a] = k
        return first

    losers, winners = [0] * size, list(range(size))
    while len(winners) > 1:
        half = len(winners) // 2
        up = []
        for k in range(half):
            a, b = winners[2 * k], winners[2 * k + 1]
            won = beats(a, b)
            losers[half + k] = b if won else a
            up.append(a if won else b)
        winners = up
    best = winners[0]
    while (head := heads[best]) is not None:
        yield head, known[best], best, place[best]
        heads[best], known[best] = next(runs[best], (None, 0))
        place[best] += 1
        node = (best + size) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


_WORK = "kind int, run int, bucket int, blob binary"


def _suffixes(n_buckets: int):
    """Kind 0: front-coded suffixes for a bucket, with first places. Kind 1: what the run needs when the answers come."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"kind": pa.array([], pa.int32()), "run": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        docs = Run(table)
        at, h = docs.anchors()
        rows: list[tuple[int, int, int, bytes]] = []
        members: list[np.ndarray] = []
        sole: list[int] = []
        again = answers(replies)["again"][np.unique(_short(h), return_inverse=True)[1]] if len(at) else np.zeros(0, np.uint8)
        at, h, again = at[again > 0], h[again > 0], again[again > 0]
        doc = doc_of(docs, at)
        low, high = np.maximum(docs.start[doc], at - BEFORE), np.minimum(docs.end[doc], at + LENGTH)
        fits = high - low >= LENGTH
        hot = fits & (again > 1)
        if hot.any():  # every window around, by itself
            offset = np.arange(BEFORE + 1)
            window = at[hot][:, None] - offset
            window = np.unique(window[(window >= low[hot][:, None]) & (window + LENGTH <= high[hot][:, None])])
            parts = (window, gram_hashes(docs.buffer, LENGTH)[window], window, window + LENGTH, np.ones(len(window), np.uint8))
        else:
            parts = (at[:0], h[:0], at[:0], at[:0], np.zeros(0, np.uint8))
        own = fits & ~hot
        at, h, low, high, alone = (np.concatenate(x) for x in zip((at[own], h[own], low[own], high[own], np.zeros(own.sum(), np.uint8)), parts))
        order = np.argsort(h, kind="stable")
        bounds = bucket_bounds(h[order], n_buckets)
        whole = docs.buffer.tobytes()
        for b in range(n_buckets):
            own = order[bounds[b] : bounds[b + 1]]
            if not len(own):
                continue
            places: dict[bytes, list[int]] = {}
            for k, p, lo, hi in zip(own.tolist(), at[own].tolist(), low[own].tolist(), high[own].tolist()):
                s = whole[p:hi] + EDGE * (hi - p < LENGTH) + whole[lo:p][::-1] + EDGE * (p - lo < BEFORE)
                places.setdefault(s, []).append(k)
            strings = sorted(places)
            found = [np.sort(at[places[s]]) for s in strings]  # documents lie in order, so the first place is the least
            first = np.array([f[0] for f in found])
            d = doc_of(docs, first)
            blob = pack(front_coded(strings) | {"doc_id": docs.doc_id[d], "none": docs.none[d].view(np.uint8), "tie": docs.tie[d], "at": first - docs.start[d]})
            rows.append((0, docs.run, b, blob))
            members += found
            sole += [alone[places[s][0]] for s in strings]
        flagged = np.unique(doc_of(docs, np.concatenate(members))) if members else np.zeros(0, np.int64)
        has = np.zeros(len(docs.text), bool)
        has[flagged] = True
        new_start = np.cumsum(np.where(has, docs.end - docs.start, 0)) - np.where(has, docs.end - docs.start, 0)
        state = {
            "doc_id": docs.doc_id, "none": docs.none, "size": docs.end - docs.start, "start": new_start, "has": has,
            "sha": [None if x else hashlib.sha256(t).hexdigest() for x, t in zip(has, docs.text)],
            "text": b"".join(t for x, t in zip(has, docs.text) if x),
            "counts": np.array([len(m) for m in members], np.int32), "sole": np.array(sole, bool),
            "members": moved(docs, members, new_start).astype(np.int32),
        }
        rows.append((1, docs.run, -1, zstandard.compress(pickle.dumps(state, protocol=5), 3)))
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("kind", pa.int32()), ("run", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())))})

    return run


def doc_of(docs: Run, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(docs.start, at, side="right") - 1


def moved(docs: Run, members: list[np.ndarray], new_start: np.ndarray) -> np.ndarray:
    """Places in the buffer of the documents that are kept for the last step."""
    at = np.concatenate(members) if members else np.zeros(0, np.int64)
    d = doc_of(docs, at)
    return at - docs.start[d] + new_start[d]


def _sides(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of bytes after the anchor, those before it as a table (nearest first), and how many these are."""
    left = np.zeros((len(strings), BEFORE), np.uint8)
    r, n = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
    for k, s in enumerate(strings):
        cut = s.find(EDGE, 0, LENGTH + 1)
        r[k] = LENGTH if cut < 0 or cut >= LENGTH else cut
        rest = s[r[k] + (r[k] < LENGTH) :]
        n[k] = len(rest) - rest.endswith(EDGE)
        left[k, : n[k]] = np.frombuffer(rest, np.uint8, n[k])
    return r, left, n


def _left_order(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their bytes, and the prefix that each shares with the one before in that order."""
    wide = np.zeros((len(left), -(-BEFORE // 8) * 8), np.uint8)
    wide[:, :BEFORE] = left
    order = np.lexsort(wide.view(">u8").astype(np.uint64).T[::-1])
    shared = np.zeros(len(left), np.int64)
    if len(left) > 1:
        differ = left[order[1:]] != left[order[:-1]]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), BEFORE)
    return order, shared


def first_windows(strings: list[bytes], shared: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the least and the largest offset of its anchor in a window that a suffix of smaller rank also has.

    Both are 255 where there is none. The suffixes are sorted and distinct; `shared` is the prefix that each has in common
    with the one before, as the merge found it. A window with the anchor at offset o is LENGTH - o bytes behind the anchor
    and o before it: suffixes share the former if no `shared` between them is shorter, and the latter by the like rule in
    the order of the bytes before the anchor. So equal windows are those of equal numbers on both sides, byte for byte; one
    offset is looked at after the other, so that memory stays at a few numbers a suffix.
    """
    size = len(strings)
    r, left, n = _sides(strings)
    by_left, left_shared = _left_order(left)
    order = np.argsort(rank, kind="stable")
    least, most = np.full(size, 255, np.int64), np.full(size, 255, np.int64)
    before = np.empty(size, np.int64)
    for o in range(BEFORE + 1):
        new = np.r_[True, shared[1:] < LENGTH - o]
        alone = new & np.r_[new[1:], True]
        behind = np.cumsum(new)
        new = np.r_[True, left_shared[1:] < o]
        before[by_left] = np.cumsum(new)
        alone[by_left] |= new & np.r_[new[1:], True]
        rows = order[(~alone & (n >= o) & (r >= LENGTH - o))[order]]
        if len(rows) < 2:
            continue
        _, first = np.unique(behind[rows] * (size + 1) + before[rows], return_index=True)
        again = np.ones(len(rows), bool)
        again[first] = False  # rows come by rank: all but the first of a window start later
        rows = rows[again]
        least[rows] = np.where(least[rows] == 255, o, least[rows])
        most[rows] = o
    return least, most


#: Distinct suffixes after which a merge settles the groups that it holds. A group has HOT anchors at most.
TOGETHER = 20_000


class _Groups:
    """Distinct suffixes of whole groups as the merge brings them, with the runs that have them; settled block by block."""

    def __init__(self, coded: list[dict[str, np.ndarray]]):
        self.coded = coded
        # 254: another run has the suffix first, so all its windows start earlier elsewhere
        self.least, self.most = ([np.full(len(c["length"]), 254, np.uint8) for c in coded] for _ in range(2))
        self.clear()

    def clear(self) -> None:
        self.strings: list[bytes] = []
        self.shared, self.group, self.run, self.place, self.which = ([] for _ in range(5))

    def add(self, s: bytes, k: int, r: int, i: int) -> None:
        if not (self.strings and k == len(s) == len(self.strings[-1])):
            new = k < GRAM or not self.strings
            if new and len(self.strings) >= TOGETHER:
                self.settle()
            self.group.append((self.group[-1] if self.strings else 0) + new)
            self.strings.append(s)
            self.shared.append(k)
        self.run.append(r)
        self.place.append(i)
        self.which.append(len(self.strings) - 1)

    def settle(self) -> None:
        if not self.strings:
            return
        run, place, which, group = (np.array(x, np.int64) for x in (self.run, self.place, self.which, self.group))
        by_run = np.argsort(run, kind="stable")
        parts = [(r, by_run[i:j]) for r, i, j in zip(np.unique(run).tolist(), *_bounds(run[by_run]))]
        columns = {}
        for name in ("at", "tie", "doc_id", "none"):
            columns[name] = np.empty(len(run), np.int64)
            for r, own in parts:
                columns[name][own] = self.coded[r][name][place[own]]
        order = np.lexsort(tuple(columns.values()))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        best = np.full(len(self.strings), len(order), np.int64)
        np.minimum.at(best, which, rank)
        least, most = np.full(len(self.strings), 255, np.int64), np.full(len(self.strings), 255, np.int64)
        own = np.flatnonzero(np.bincount(group)[group] > 1)
        if len(own):
            least[own], most[own] = first_windows([self.strings[k] for k in own.tolist()], np.array(self.shared, np.int64)[own], best[own])
        first = rank == best[which]
        for r, own in parts:
            mine = own[first[own]]
            self.least[r][place[mine]], self.most[r][place[mine]] = least[which[mine]], most[which[mine]]
        self.clear()


def _bounds(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Where each stretch of equal values begins and ends."""
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]).tolist()
    return at, [*at[1:], len(x)]


def _merge(table: pa.Table) -> pa.Table:
    coded = [unpack(b) for b in table.column("blob").to_pylist()]
    groups = _Groups(coded)
    for s, k, r, i in merged([decoded(c) for c in coded]):
        groups.add(s, k, r, i)
    groups.settle()
    out = [pack({"least": a, "most": b}) for a, b in zip(groups.least, groups.most)]
    return pa.table({"run": table.column("run"), "bucket": table.column("bucket"), "answer": pa.array(out, pa.binary())})


_ANSWER = pa.schema([("run", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _removed(states: pa.Table, replies: pa.Table) -> pa.Table:
    if not states.num_rows:
        return _RESULT.empty_table()
    s = pickle.loads(zstandard.decompress(states.column("blob")[0].as_py()))
    size, start, has = s["size"], s["start"], s["has"]
    n_removed, n_spans, sha = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), list(s["sha"])
    if has.any():
        told = answers(replies)
        at, counts = s["members"].astype(np.int64), s["counts"].astype(np.int64)
        first = np.zeros(len(at), bool)
        first[np.cumsum(counts) - counts] = True
        held = np.flatnonzero(has)
        d = held[np.searchsorted(start[held], at, side="right") - 1]
        inside = at - start[d]
        # All windows that hold the anchor, as offsets of the anchor in them.
        sole = np.repeat(s["sole"], counts)
        lo = np.where(sole, 0, np.maximum(0, LENGTH - np.minimum(LENGTH, size[d] - inside)))
        hi = np.where(sole, 0, np.minimum(BEFORE, inside))
        least, most = (np.repeat(told[k].astype(np.int64), counts) for k in ("least", "most"))
        none = first & (least == 255)
        some = first & (least < 254)
        lo, hi = np.where(some, least, lo), np.where(some, most, hi)
        change = np.zeros(len(s["text"]) + 1, np.int64)
        np.add.at(change, (at - hi)[~none], 1)
        np.add.at(change, (at + LENGTH - lo)[~none], -1)
        gone = np.cumsum(change)[:-1] > 0
        text = np.frombuffer(s["text"], np.uint8)
        for k in held.tolist():
            own = gone[start[k] : start[k] + size[k]]
            n_removed[k] = own.sum()
            n_spans[k] = (own[1:] & ~own[:-1]).sum() + (own[:1].sum())
            sha[k] = hashlib.sha256(text[start[k] : start[k] + size[k]][~own].tobytes()).hexdigest()
    ids = pa.array(s["doc_id"], pa.int64(), mask=s["none"])
    return pa.table([ids, pa.array(size), pa.array(n_removed), pa.array(n_spans), pa.array(sha, pa.string())], schema=_RESULT)


def _merge_work(work: pa.Table) -> pa.Table:
    """The merge of a bucket; a run's own state has nothing to merge."""
    own = work.filter(pc.equal(work.column("kind"), 0))
    return _merge(own) if own.num_rows else _ANSWER.empty_table()


def _removed_work(work: pa.Table, replies: pa.Table) -> pa.Table:
    return _removed(work.filter(pc.equal(work.column("kind"), 1)), replies)


def repeated_bytes(docs: DataFrame, run_bytes: int = RUN_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    runs, n = in_runs(docs, run_bytes)
    n_buckets = pieces(n, 2)
    work = with_answers(runs, ask(runs, n_buckets, _grams, _repeated(hot)), _suffixes(n_buckets), _WORK)
    # Suffixes are dealt by bucket and states by run, in one exchange that both readers share, so all is one job.
    work = work.withColumn("to", F.when(F.col("kind") == 0, F.col("bucket")).otherwise(n_buckets + F.col("run")))
    told = work.groupBy("to").applyInArrow(lean(_merge_work), "run int, bucket int, answer binary").withColumn("to", n_buckets + F.col("run"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return work.groupBy("to").cogroup(told.groupBy("to")).applyInArrow(lean(_removed_work), schema)
