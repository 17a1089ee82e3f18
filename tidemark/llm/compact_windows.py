"""Near-duplicate passages by compact windows.

The method named for this operator, Cartesian trees over the min-hashes of several functions, loses pairs at the bound of
similarity however many functions there are, and with the few that fit its messages it lost real ones. So the windows here
are those of the OWN + 1 least tokens (a bottom-k sketch, in one order) instead of the least of each function, which loses
none; a window is again the interval of starts whose passages have the token in their sketch, and windows are joined by
token as intervals.

Tokens are hashes of shingles of SHINGLE words (ASCII letters lower-cased). Two passages of PASSAGE tokens whose sets are
SIMILARITY alike share all but a few of their tokens (41 of 46 different ones), so in any one order of all tokens they
share one of the few least of each. The order is by how often a token occurs in the corpus (tidemark.llm.runs asks for
that), rare ones first: a passage with too many tokens of its own needs no comparison, and common lines build few pairs.

A token that is among the least of some passages around it stands for their interval of starts (a compact window).
Windows of one token meet in a bucket. Those that are equal but for tokens that occur nowhere else are alike to each other
and to the same others, so they are folded to their first holder (smallest doc_id, then start) and ask it alone; every
other window asks all earlier first holders of its token, or, where those are more than MANY, a few of them. Each
candidate is verified by the exact Jaccard similarity of the shingle sets, SIMILARITY or more.

A second round asks the rest where an answer could change the result. What the first one found gives each document its
words and its class so far; a window whose words are all told asks only holders of other classes, every other one asks all
earlier holders. So near copies of one another, however many, don't all meet in pairs, and no word and no class is lost.

The words of a verified passage repeat an earlier passage: earlier by doc_id, or in the same document without overlap.

Defined results: null and empty texts and texts under SHINGLE + PASSAGE - 1 words have no passages; rows without an id
neither repeat nor are repeated; rows that repeat an id are not compared with one another at the same place, and others
are compared with the first of them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, lean_batches, pieces, release_shuffles, stored
from tidemark.llm.components import components
from tidemark.llm.runs import _sliding, bucket_bounds, dealt, in_runs, mixed, pack, unpack, with_answers

SHINGLE, SIMILARITY = 5, 0.8
#: Tokens of the shortest passage: 50 words.
PASSAGE = 46
#: Tokens that a passage of PASSAGE different ones may have and a similar passage of that length not.
OWN = PASSAGE - math.ceil(2 * SIMILARITY / (1 + SIMILARITY) * PASSAGE - 1e-9)
#: Tokens of the earlier document, on each side, within which an aligned passage may have shifted.
SLACK = 8
#: Bytes of spans that go to every executor instead of moving the texts.
FEW = 32_000_000
#: Bits of a token that do not travel to be compared: passages are compared one by one, for which 48 bits tell shingles apart.
SPARED = np.uint64(16)
#: Earlier first holders of a token that a window asks in the first round; of more it asks EARLIEST, those that most windows equal, and the NEAREST before it.
MANY, EARLIEST, EQUALLED, NEAREST = 8, 2, 3, 3
#: Pairs of windows that are compared at once in the second round.
AT_ONCE = 1 << 21
#: Bytes of text in a run.
RUN_BYTES = 4_000_000
_STEPS = [np.uint64(xxhash.xxh64_intdigest(b"place", k) | 1) for k in range(SHINGLE)]


#: Bytes that are hashed together; words over a border are hashed by themselves.
BLOCK = 1 << 18
_B = 0x9E3779B97F4A7C15
_POWERS, _INVERSES = (np.concatenate((np.ones(1, np.uint64), np.full(BLOCK, b, np.uint64))).cumprod(dtype=np.uint64) for b in (_B, pow(_B, -1, 2**64)))
_LOWER = np.array([c + 33 if 65 <= c <= 90 else c + 1 for c in range(256)], np.uint64)
_SPACE = np.array([c in b" \t\n\x0b\x0c\r" for c in range(256)], bool)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word: a polynomial over lower-cased bytes from prefix sums, the word's length mixed in."""
    space = np.concatenate((np.ones(1, bool), _SPACE[raw], np.ones(1, bool)))
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(raw), BLOCK):
        part = _LOWER[raw[at : at + BLOCK]]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * _POWERS[: len(part)], dtype=np.uint64)))
        lo, hi = np.searchsorted(starts, at), np.searchsorted(starts, at + len(part))
        s, e = starts[lo:hi] - at, np.minimum(ends[lo:hi] - at, len(part))
        out[lo:hi] = (sums[e] - sums[s]) * _INVERSES[s]
        if hi > lo and ends[hi - 1] > at + len(part):  # the rest of a word that the border cuts
            value, power = int(out[hi - 1]), pow(_B, int(len(part) - s[-1]), 2**64)
            for c in raw[at + len(part) : ends[hi - 1]].tolist():
                value, power = (value + int(_LOWER[c]) * power) % 2**64, power * _B % 2**64
            out[hi - 1] = value
    return starts, mixed(out + (ends - starts).astype(np.uint64) * _STEPS[0])


class Shingles:
    """Tokens of all documents of a run, one behind another, in the order of doc_id."""

    def __init__(self, table: pa.Table):
        ids = [(i is None, i or 0) for i in table.column("doc_id").to_pylist()]
        raw = [t.encode() for t in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], raw[k]))
        self.run = table.column("run")[0].as_py()
        self.held = np.array([not ids[k][0] for k in order], bool)
        self.doc_id = np.array([ids[k][1] for k in order], np.int64)
        #: Rows that repeat an id are told apart by their text.
        self.text_md5 = [hashlib.md5(raw[k]).digest() for k in order]
        begins = np.cumsum([0, *(len(raw[k]) + 1 for k in order)])
        starts, w = word_hashes(np.frombuffer(b" ".join(raw[k] for k in order), np.uint8))
        first = np.searchsorted(starts, begins)
        self.n_words = np.diff(first)
        self.size = np.maximum(0, self.n_words - SHINGLE + 1)
        self.start = np.cumsum(self.size) - self.size
        n = max(0, len(w) - SHINGLE + 1)
        tokens = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            tokens += w[k : k + n] * _STEPS[k]
        # Shingles over the end of a document go.
        inside = np.ones(n, bool)
        last = first[1:] - SHINGLE + 1
        for k in range(SHINGLE - 1):
            at = last + k
            inside[at[(at >= first[:-1]) & (at < n)]] = False
        self.tokens = mixed(tokens[inside])

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """Documents of token positions; documents without tokens hold none."""
        return np.searchsorted(self.start, at, side="right") - 1


_ROWS = "bucket int, run int, blob binary"


def _rows(rows: list[tuple[int, int, bytes]], *names: str) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], pa.binary() if n == "blob" else pa.int32()) for k, n in enumerate(names)})


def _short(s: Shingles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 40-bit tokens of a run's documents with ids, how often each occurs, and the place of every token in them."""
    held = np.repeat(s.held, s.size)
    keys, inverse = np.unique(s.tokens >> np.uint64(24), return_inverse=True)
    return keys, np.bincount(inverse[held], minlength=len(keys)), inverse


def _distinct(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        s = Shingles(table)
        keys, n, _ = _short(s)
        bounds = bucket_bounds(keys << np.uint64(24), n_buckets).tolist()
        return _rows([(b, s.run, pack({"step": np.diff(keys[i:j], prepend=np.uint64(0)), "n": n[i:j]})) for b, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i], "bucket", "run", "blob")

    return run


def _counted(table: pa.Table) -> pa.Table:
    """How often each token of a run occurs in all: the bits of that number. Tokens that agree in 40 bits count as one."""
    asked = [unpack(b) for b in table.column("blob").to_pylist()]
    keys = [np.cumsum(a["step"], dtype=np.uint64) for a in asked]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([a["n"] for a in asked]), len(distinct))
    bits, ends = np.frexp(total)[1].astype(np.uint8)[inverse], np.cumsum([len(k) for k in keys])
    told = [pack({"bits": bits[e - len(k) : e]}) for k, e in zip(keys, ends.tolist())]
    return _rows(list(zip(table.column("run").to_pylist(), table.column("bucket").to_pylist(), told)), "run", "bucket", "blob")


def windows(s: Shingles, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first start, last start, content) of tokens that are among the least of passages that start between.

    bits: of the number of times that each token occurs, 1 for once. Windows of equal content are equal but for tokens that
    occur once, and so few of those that all their passages are alike; other windows have a content of their own.
    """
    n, m = len(s.tokens), len(s.tokens) - PASSAGE + 1
    none = np.zeros(0, np.int64)
    held = np.flatnonzero(s.held & (s.size >= PASSAGE))
    if not len(held):
        return none, none, none, np.zeros(0, np.uint64)
    once = bits < 2
    rank = (bits.astype(np.uint64) << np.uint64(56)) | (s.tokens >> np.uint64(8))
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, s.start[held], 1)
    np.add.at(step, s.start[held] + s.size[held] - PASSAGE + 1, -1)
    ok = np.cumsum(step)[:m] > 0

    def within(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate((np.zeros(1, np.int64), np.cumsum(flags)))
        return c[PASSAGE:] - c[:-PASSAGE]

    order = np.argsort(s.tokens, kind="stable")
    near = (s.tokens[order[1:]] == s.tokens[order[:-1]]) & (np.diff(order) < PASSAGE)
    again = np.zeros(n, bool)
    again[order[1:][near]] = True
    own, plain = within(once), within(again) == 0
    # The largest rank by which a passage is found; 0 if too many of its tokens occur nowhere else.
    most, loose = np.zeros(m, np.uint64), np.zeros(m, bool)
    view = np.lib.stride_tricks.sliding_window_view(rank, PASSAGE)
    at = np.flatnonzero(ok & plain & (own <= OWN))
    for k in range(0, len(at), 1 << 14):
        p = at[k : k + (1 << 14)]
        most[p] = np.partition(view[p], OWN, axis=1)[:, OWN]
    at = np.flatnonzero(ok & ~plain & (own < PASSAGE))
    for k in range(0, len(at), 1 << 14):  # tokens that come again in a passage count once
        p = at[k : k + (1 << 14)]
        x = np.sort(view[p], axis=1)
        nth = np.cumsum(np.concatenate((np.zeros((len(p), 1), bool), x[:, 1:] != x[:, :-1]), 1), axis=1)
        size = nth[:, -1] + 1
        spare = np.where(size == PASSAGE, OWN, size - np.ceil(SIMILARITY * size - 1e-9).astype(np.int64))
        value = x[np.arange(len(p)), np.argmax(nth >= spare[:, None], axis=1)]
        most[p] = np.where(value >> np.uint64(56) >= 2, value, 0)
        loose[p] = size - own[p] < 2 * SIMILARITY / (1 + SIMILARITY) * size - 1e-9
    edge = np.zeros(PASSAGE - 1, np.uint64)
    most = np.concatenate((edge, most, edge))
    at = np.flatnonzero((_sliding(np.maximum, most, PASSAGE) >= rank) & ~once)
    first, last = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(most, PASSAGE)
    for k in range(0, len(at), 1 << 16):
        c = at[k : k + (1 << 16)]
        found = view[c] >= rank[c][:, None]
        first[k : k + (1 << 16)] = c - PASSAGE + 1 + np.argmax(found, 1)
        last[k : k + (1 << 16)] = c - np.argmax(found[:, ::-1], 1)
    masked = np.where(once, np.uint64(0), s.tokens)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(masked[:-1] * _STEPS[0] + masked[1:]), dtype=np.uint64)))
    content = mixed(sums[last + PASSAGE - 1] - sums[first] + (at - first).astype(np.uint64) * _STEPS[1] + (last - at).astype(np.uint64) * _STEPS[2])
    n_loose = np.concatenate((np.zeros(1, np.int64), np.cumsum(loose)))
    alone = mixed(content + at.astype(np.uint64) * _STEPS[3] + mixed(s.doc_id[s.doc_of(at)].view(np.uint64)))
    return at, first, last, np.where(n_loose[last + 1] > n_loose[first], alone, content)


def _windows(n_buckets: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        if table.num_rows and replies.num_rows:
            s = Shingles(table)
            bits = np.concatenate([unpack(b)["bits"] for _, b in sorted(zip(replies.column("bucket").to_pylist(), replies.column("blob").to_pylist()))])
            at, first, last, content = windows(s, bits[_short(s)[2]])
            key, d = mixed(s.tokens[at]), s.doc_of(at)
            order = np.lexsort((at, key))
            key, at, first, last, content, d = (v[order] for v in (key, at, first, last, content, d))
            lead = np.r_[True, s.doc_id[1:] != s.doc_id[:-1]]
            columns = {
                "doc": s.doc_id[d], "d": d.astype(np.int32), "at": (at - s.start[d]).astype(np.int32), "before": (at - first).astype(np.uint8),
                "behind": (at - last).astype(np.uint8), "content": content >> np.uint64(16), "lead": lead[d],
            }
            bounds = bucket_bounds(key, n_buckets).tolist()
            for b, (i, j) in enumerate(zip(bounds, bounds[1:])):
                if j > i:
                    rows.append((b, s.run, pack({"step": np.diff(key[i:j], prepend=np.uint64(0))} | {k: v[i:j] for k, v in columns.items()})))
        return _rows(rows, "bucket", "run", "blob")

    return run


def apart(doc: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether window b is earlier than a: in a smaller doc_id, or in the same document without overlap."""
    return (doc[b] < doc[a]) | ((doc[b] == doc[a]) & (at[b] <= at[a] - PASSAGE))


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, size of them."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def met(key: np.ndarray, content: np.ndarray, doc: np.ndarray, at: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(asking window, earlier window) of one key, then which windows are first holders and which have more to ask.

    A window asks its content's first holder, or else every content's earlier first holder; of more than MANY only some.
    Sorted by (key, doc, at). Only rows that are the first of their id (lead) are asked.
    """
    n = len(key)
    order = np.lexsort((np.arange(n), ~lead, content, key))
    fresh = np.r_[True, (np.diff(content[order]) != 0) | (np.diff(key[order]) != 0)][:n]
    heads = order[np.flatnonzero(fresh)]
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(fresh) - 1
    first = heads[group]
    every = np.arange(n)
    known = lead[first] & apart(doc, at, every, first)
    # All first holders of a key before a place, for windows whose own first holder is none.
    is_first = lead & (first == every)
    so_far, firsts = np.cumsum(is_first) - is_first, np.flatnonzero(is_first)
    begin = so_far[np.searchsorted(key, key, side="left")]
    asking = np.flatnonzero(~known)
    size = so_far[asking] - begin[asking]
    more = np.zeros(n, bool)
    more[asking[size > MANY]] = True
    few, some = asking[size <= MANY], asking[size > MANY]
    a = [np.repeat(few, size[size <= MANY])]
    b = [firsts[ranges(begin[few], size[size <= MANY])]]
    for k in range(EARLIEST):
        a.append(some)
        b.append(firsts[begin[some] + k])
    for k in range(NEAREST):
        a.append(some)
        b.append(firsts[so_far[some] - 1 - k])
    # First holders by how many windows equal them, most first, the keys in their order.
    ranked = firsts[np.lexsort((firsts, -np.bincount(group, minlength=len(heads))[group[firsts]], key[firsts]))]
    for k in range(EQUALLED):
        a.append(some)
        b.append(ranked[begin[some] + k])
    pair = np.unique(np.concatenate(a) * n + np.concatenate(b)) if n else np.zeros(0, np.int64)
    a, b = pair // max(1, n), pair % max(1, n)
    keep = apart(doc, at, a, b)
    return np.concatenate((every[known], a[keep])), np.concatenate((first[known], b[keep])), is_first, more


_MET = "run int, bucket int, kind int, blob binary"


def _met(table: pa.Table) -> pa.Table:
    """Questions (kind 0), and the windows of keys where some have more to ask (kind 1), to the runs that hold them."""
    got = [unpack(b) for b in table.column("blob").to_pylist()]
    key = np.concatenate([np.cumsum(g["step"], dtype=np.uint64) for g in got])
    c = {k: np.concatenate([g[k] for g in got]) for k in got[0]} | {"run": np.repeat(np.array(table.column("run").to_pylist()), [len(g["d"]) for g in got])}
    order = np.lexsort((~c["lead"].astype(bool), c["at"], c["doc"], key))
    key, c = key[order], {k: v[order] for k, v in c.items()}
    a, b, is_first, more = met(key, c["content"], c["doc"], c["at"], c["lead"].astype(bool))
    open_key = np.zeros(len(key), bool)
    fresh = np.flatnonzero(np.r_[True, np.diff(key) != 0])
    open_key = np.repeat(np.logical_or.reduceat(more, fresh), np.diff(np.r_[fresh, len(key)]))
    left = np.flatnonzero(open_key & (is_first | more))
    left = left[np.argsort(c["run"][left], kind="stable")]
    order = np.lexsort((c["at"][a], c["doc"][b], c["d"][a], c["run"][a]))
    a, b = a[order], b[order]
    run, bucket, rows = c["run"][a], table.column("bucket")[0].as_py(), []
    for r in np.unique(run).tolist():
        i, j = np.searchsorted(run, [r, r + 1])
        rows.append((r, bucket, 0, pack({k: c[k][a[i:j]] for k in ("d", "at", "before", "behind")} | {"other": c["doc"][b[i:j]], "other_at": c["at"][b[i:j]]})))
    run = c["run"][left]
    for r in np.unique(run).tolist():
        w = left[slice(*np.searchsorted(run, [r, r + 1]))]
        rows.append((r, bucket, 1, pack({"step": np.diff(key[w], prepend=np.uint64(0)), "first": is_first[w], "more": more[w]} | {k: c[k][w] for k in ("doc", "d", "at", "before", "behind")})))
    return _rows(rows, "run", "bucket", "kind", "blob")


_WORK = "kind int, run int, bucket int, blob binary"

#: Document, first start, last start, earlier doc_id, shift, windows that agree, and from where to where the earlier passages lie.
Candidate = tuple[int, int, int, int, int, int, int, int]


def candidates(told: dict[str, np.ndarray]) -> list[Candidate]:
    """Passages of PASSAGE tokens that start between and an earlier document that may have the like, windows that touch as one.

    shift is the earlier document's position less the document's own.
    """
    at, d, other, other_at = told["at"].astype(np.int64), told["d"], told["other"], told["other_at"].astype(np.int64)
    first, last, shift = at - told["before"], at - told["behind"], other_at - at
    order = np.lexsort((first, shift // SLACK, other, d))
    at, d, other, other_at, first, last, shift = (v[order] for v in (at, d, other, other_at, first, last, shift))
    lead = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (np.diff(other) != 0) | (np.diff(shift // SLACK) != 0) | (first[1:] > last[:-1] + 1)][: len(d)])
    if not len(lead):
        return []
    n = np.diff(np.r_[lead, len(d)])
    high = np.maximum.reduceat(last, lead)
    low_at, high_at = np.maximum(0, np.minimum.reduceat(other_at, lead) - PASSAGE + 1), np.maximum.reduceat(other_at, lead) + PASSAGE
    found = zip(d[lead].tolist(), first[lead].tolist(), high.tolist(), other[lead].tolist(), shift[lead + n // 2].tolist(), n.tolist(), low_at.tolist(), high_at.tolist())
    return sorted(found, key=lambda c: (c[0], c[1], -c[5], c[3:]))


def run_of(doc_id: np.ndarray, n: int) -> np.ndarray:
    """The run of each id, as in_runs has it: XXH64 of the id's eight bytes with seed 42, modulo n, not negative."""
    h = np.array([xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), 42) for x in doc_id.tolist()], np.uint64)
    return (h.view(np.int64) % n).astype(np.int64)


def merged_ranges(found: list[Candidate]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(doc_id, low, high) of earlier documents' stretches, overlapping ones as one, and each candidate's (row, from, to).

    A stretch travels once to a run, however many candidates look at it.
    """
    wanted = [(c[3], c[6], c[7]) for c in found]
    rows: list[list[int]] = []
    at: list[tuple[int, int, int]] = [(0, 0, 0)] * len(found)
    for k in sorted(range(len(found)), key=wanted.__getitem__):
        doc, low, high = wanted[k]
        if rows and rows[-1][0] == doc and low <= rows[-1][2]:
            rows[-1][2] = max(rows[-1][2], high)
        else:
            rows.append([doc, low, high])
        at[k] = (len(rows) - 1, low - rows[-1][1], max(low, high) - rows[-1][1])
    return np.array(rows, np.int64).reshape(-1, 3), at


def _proposed(n_runs: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, bytes]] = []
        if table.num_rows:
            s = Shingles(table)
            left = replies.filter(pc.equal(replies.column("kind"), 1))
            told = [unpack(b) for b in replies.filter(pc.equal(replies.column("kind"), 0)).column("blob").to_pylist()]
            again = bool(told) and "nth" in told[0]  # in the second round a document is known by its id and its place among rows of that id
            if again:
                held = s.doc_id[s.held]
                told = [t | {"d": np.searchsorted(held, t["doc"]) + t["nth"]} for t in told]
            found = candidates({k: np.concatenate([t[k] for t in told]) for k in told[0]}) if told else []
            own = sorted({c[0] for c in found})
            asked, at = merged_ranges(found)
            state = {
                "doc_id": s.doc_id, "held": s.held, "text_md5": s.text_md5, "n_words": s.n_words, "found": found, "at": at,
                "tokens": {d: s.tokens[s.start[d] : s.start[d] + s.size[d]] >> SPARED for d in own},
                "left": list(zip(left.column("bucket").to_pylist(), left.column("blob").to_pylist())),
            }
            if again:
                strange = {x for t in told for x in zip(t["d"][~t["same"]].tolist(), t["other"][~t["same"]].tolist())}
                state["same"] = [(c[0], c[3]) not in strange for c in found]
            rows.append((1, s.run, -1, zstandard.compress(pickle.dumps(state, protocol=5), 3)))
            if len(asked):
                to = run_of(asked[:, 0], n_runs)
                for b in np.unique(to).tolist():
                    k = np.flatnonzero(to == b)
                    rows.append((0, b, s.run, pack({"k": k, "doc": asked[k, 0], "low": asked[k, 1], "high": asked[k, 2]})))
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("kind", pa.int32()), ("run", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())))})

    return run


def _served(table: pa.Table, requests: pa.Table) -> pa.Table:
    """Tokens of the asked stretches, back to the runs that asked."""
    out: list[tuple[int, int, bytes]] = []
    if requests.num_rows and table.num_rows:
        s = Shingles(table)
        at: dict[int, int] = {}
        for k in np.flatnonzero(s.held).tolist():
            at.setdefault(int(s.doc_id[k]), k)
        for run, blob in zip(requests.column("bucket").to_pylist(), requests.column("blob").to_pylist()):
            r = unpack(blob)
            parts, sizes = [], []
            for doc, low, high in zip(r["doc"].tolist(), r["low"].tolist(), r["high"].tolist()):
                d = at.get(doc)
                part = s.tokens[s.start[d] + min(low, s.size[d]) : s.start[d] + min(high, s.size[d])] if d is not None else s.tokens[:0]
                parts.append(part >> SPARED)
                sizes.append(len(part))
            out.append((run, s.run, pack({"k": r["k"], "size": np.array(sizes, np.int64), "tokens": np.concatenate(parts)})))
    return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate((("run", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())))})


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, y = set(a.tolist()), set(b.tolist())
    both = len(x & y)
    return both / max(1, len(x) + len(y) - both)


def _among(a: np.ndarray, b: set[int]) -> np.ndarray:
    """Which of a are in b: passages are short, so sets beat sorting."""
    return np.fromiter(map(b.__contains__, a.tolist()), bool, len(a))


def _sums(flags: np.ndarray) -> np.ndarray:
    """Of each PASSAGE flags."""
    c = np.concatenate((np.zeros(1, np.int64), np.cumsum(flags)))
    return c[PASSAGE:] - c[:-PASSAGE]


def verified(mine: np.ndarray, begin: int, end: int, other: np.ndarray, align: int) -> list[tuple[int, int]]:
    """Token ranges of mine[begin:end] that near-duplicate a passage of `other`: SIMILARITY of the sets or more.

    other[align] stands where mine[begin] does. The ends are cut to the first and last shared token; if the whole isn't
    similar enough, the stretches are tried in which every passage of PASSAGE tokens shares enough, and in those that are
    not similar enough either their parts that share every token and each passage of PASSAGE tokens. Length and similarity
    are those of the passage before its ends are cut.
    """
    if not len(other):
        return []  # a passage at the start of its own document has nothing before it
    own = mine[begin:end]
    if align >= 0 and np.array_equal(own, other[align : align + len(own)]):
        return [(begin, end)]  # word for word
    shared = _among(own, set(other.tolist()))
    lo, hi = max(0, -align), min(len(own), len(other) - align)
    if hi - lo >= PASSAGE:
        same = np.flatnonzero(own[lo:hi] == other[align + lo : align + hi])
        # One stretch, word for word, and nothing shared beside it, as there is behind an inserted word.
        if len(same) >= PASSAGE and same[-1] - same[0] + 1 == len(same) == shared.sum():
            return [(begin + lo + int(same[0]), begin + lo + int(same[-1]) + 1)]
    if shared.sum() < 2 * SIMILARITY / (1 + SIMILARITY) * PASSAGE - 1e-9:
        return []
    places: dict[int, list[int]] = {}
    for k, t in enumerate(other.tolist()):
        places.setdefault(t, []).append(k)

    def inside(low: int, high: int, i: int, j: int) -> bool:
        """Whether own[i:j], shorter than PASSAGE, is what a passage in own[low:high] shares with one of `other`."""
        for k in places[int(own[i])]:
            for q in range(max(0, k + j - i - PASSAGE), min(k, len(other) - PASSAGE) + 1):
                there = other[q : q + PASSAGE]
                if any(similarity(own[p : p + PASSAGE], there) >= SIMILARITY for p in range(max(low, j - PASSAGE), min(i, high - PASSAGE) + 1)):
                    return True
        return False

    def trimmed(i: int, j: int) -> list[tuple[int, int]]:
        where = np.flatnonzero(shared[i:j])
        if not len(where):
            return []
        low, high = i, j
        i, j = i + int(where[0]), i + int(where[-1]) + 1
        if j - i < PASSAGE:
            return [(begin + i, begin + j)] if inside(low, high, i, j) else []
        # Between the first and the last shared token, each taken where it stands nearest to its place in `mine`.
        p = min(places[int(own[i])], key=lambda k: abs(k - i - align))
        q = min(places[int(own[j - 1])], key=lambda k: abs(k - p - (j - 1 - i)))
        if q >= p and similarity(own[i:j], other[p : q + 1]) >= SIMILARITY:
            return [(begin + i, begin + j)]
        # Or all of `other` that shares something: words that come round again have no one place.
        met = np.flatnonzero(_among(other, set(own[i:j].tolist())))
        return [(begin + i, begin + j)] if similarity(own[i:j], other[met[0] : met[-1] + 1]) >= SIMILARITY else []

    if out := trimmed(0, len(own)):
        return out
    share = _sums(shared) >= 2 * SIMILARITY / (1 + SIMILARITY) * PASSAGE - 1e-9
    edges = np.flatnonzero(np.diff(np.r_[False, share, False].astype(np.int8)))
    out = []
    for i, j in zip(edges[::2].tolist(), (edges[1::2] + PASSAGE - 1).tolist()):
        found = trimmed(i, j)
        if not found:  # passages without a break inside a stretch that differs too often as a whole
            breaks = np.flatnonzero(~np.r_[False, shared[i:j], False])
            found = [r for a, b in zip(breaks.tolist(), breaks[1:].tolist()) if b - a - 1 >= PASSAGE for r in trimmed(i + a, i + b - 1)]
            for k in range(i, j - PASSAGE + 1):  # and the others one by one
                if not any(a <= begin + k and begin + k + PASSAGE <= b for a, b in found):
                    found += trimmed(k, k + PASSAGE)
        out += found
    return out


def repeats(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether a passage of PASSAGE tokens of `a` near-duplicates one of `b`: the one that shares most, where it stands."""
    if min(len(a), len(b)) < PASSAGE:
        return False
    if np.array_equal(a, b):
        return True
    shared = _among(a, set(b.tolist()))
    p = int(np.argmax(_sums(shared)))
    if shared[p : p + PASSAGE].sum() < SIMILARITY * PASSAGE:
        return False
    k = p + int(np.argmax(shared[p : p + PASSAGE]))
    q = min(max(0, int(np.argmax(b == a[k])) - (k - p)), len(b) - PASSAGE)
    return similarity(a[p : p + PASSAGE], b[q : q + PASSAGE]) >= SIMILARITY


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64())]))), ("repeats_of", pa.list_(pa.int64())), ("text_md5", pa.binary())])
_RESULT_DDL = "doc_id long, n_words long, spans array<struct<first_word:long,last_word:long>>, repeats_of array<long>, text_md5 binary"


def _judged(states: pa.Table, replies: pa.Table) -> pa.Table:
    return _judged_and_left(states, replies)[0]


def _judged_and_left(states: pa.Table, replies: pa.Table) -> tuple[pa.Table, list[tuple[int, bytes]]]:
    """What is found, and by bucket the windows that have more to ask or may be asked."""
    if not states.num_rows:
        return _RESULT.empty_table(), []
    s = pickle.loads(zstandard.decompress(states.column("blob")[0].as_py()))
    got: dict[int, np.ndarray] = {}
    for blob in replies.column("blob").to_pylist():
        r = unpack(blob)
        ends = np.cumsum(r["size"])
        for k, a, b in zip(r["k"].tolist(), (ends - r["size"]).tolist(), ends.tolist()):
            got[k] = r["tokens"][a:b]
    spans: dict[int, set[tuple[int, int]]] = {}
    sources: dict[int, set[int]] = {}
    linked: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    covered = {d: np.zeros(len(t), bool) for d, t in s["tokens"].items()}
    same = s.get("same", [False] * len(s["found"]))  # of one class by the first round: only words can come, no link
    for k, (d, first, last, other, shift, _, low, _) in enumerate(s["found"]):
        row, begin, end = s["at"][k]
        theirs = got[row][begin:end] if row in got else ()
        if not len(theirs):
            continue
        if other == int(s["doc_id"][d]):  # inside a document: only what lies before the passage
            theirs = theirs[: max(0, first - low)]
        heads, known, all_told = linked.setdefault(d, []), sources.setdefault(d, set()), bool(covered[d][first : last + PASSAGE].all())
        # A document that repeats a linked one here is linked to it by itself. Where all tokens are told already and no
        # link can come, verifying could not change anything.
        represented = other in known or same[k]
        if all_told:
            represented = represented or any(x <= last and first <= y and repeats(theirs, there) for x, y, there in heads)
            if represented:
                continue
        found = verified(s["tokens"][d], first, last + PASSAGE, theirs, first + shift - low)
        spans.setdefault(d, set()).update((a, b + SHINGLE - 1) for a, b in found)
        for a, b in found:
            covered[d][a:b] = True
        if found and not same[k] and other not in known and (all_told or not any(x <= last and first <= y and repeats(theirs, there) for x, y, there in heads)):
            known.add(other)
            heads.append((first, last, theirs))
    rows = []
    for d in range(len(s["doc_id"])):
        joined: list[list[int]] = []
        for a, b in sorted(spans.get(d, ())):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        i = int(s["doc_id"][d]) if s["held"][d] else None
        rows.append((i, int(s["n_words"][d]), [{"first_word": a, "last_word": b - 1} for a, b in joined], sorted(sources.get(d, ())), s["text_md5"][d]))
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_RESULT)], schema=_RESULT), _left(s, covered)


def _left(s: dict, covered: dict[int, np.ndarray]) -> list[tuple[int, bytes]]:
    out, held = [], s["doc_id"][np.asarray(s["held"], bool)]
    untold = {d: np.concatenate((np.zeros(1, np.int64), np.cumsum(~c))) for d, c in covered.items()}
    for bucket, blob in s.get("left", ()):
        w = unpack(blob)
        at, told = w["at"].astype(np.int64), np.zeros(len(w["d"]), bool)
        first, last = at - w["before"], at - w["behind"] + PASSAGE
        order = np.argsort(w["d"], kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(w["d"][order]) != 0])
        for k in np.split(order, cuts[1:]):
            u = untold.get(int(w["d"][k[0]]))
            if u is not None:
                told[k] = u[last[k]] == u[first[k]]
        nth = (w["d"] - np.searchsorted(held, w["doc"])).astype(np.int32)
        out.append((bucket, pack({k: w[k] for k in ("step", "first", "more", "doc", "at", "before", "behind")} | {"nth": nth, "told": told})))
    return out


def _served_work(table: pa.Table, work: pa.Table) -> pa.Table:
    return _served(table, work.filter(pc.equal(work.column("kind"), 0)))


_FOUND = pa.schema([*_RESULT, ("run", pa.int32()), ("bucket", pa.int32()), ("left", pa.binary())])
_FOUND_DDL = f"{_RESULT_DDL}, run int, bucket int, left binary"


def _judged_work(work: pa.Table, replies: pa.Table) -> pa.Table:
    """A row for each document, and rows that hold no document but the windows left for a bucket."""
    states = work.filter(pc.equal(work.column("kind"), 1))
    found, left = _judged_and_left(states, replies)
    run = states.column("run")[0].as_py() if states.num_rows else None
    n, m = found.num_rows, len(left)
    columns = {f.name: pa.chunked_array([*found.column(f.name).chunks, pa.nulls(m, f.type)], f.type) for f in _RESULT}
    more = {"run": [run] * (n + m), "bucket": [None] * n + [b for b, _ in left], "left": [None] * n + [x for _, x in left]}
    return pa.table(columns | {k: pa.array(v, _FOUND.field(k).type) for k, v in more.items()}, schema=_FOUND)


def _classed(left: pa.Table, classes: pa.Table) -> pa.Table:
    """The windows left, with the class of their document: its own id where it is linked to no smaller one."""
    known = classes.sort_by("_id")
    ids, roots = (known.column(k).to_numpy().astype(np.int64) for k in ("_id", "root"))
    rows = []
    for run, bucket, blob in zip(*(left.column(k).to_pylist() for k in ("run", "bucket", "left"))):
        w = unpack(blob)
        own = w["doc"]
        if len(ids):
            k = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            own = np.where(ids[k] == own, roots[k], own)
        rows.append((bucket, run, pack(w | {"of": own})))
    return _rows(rows, "bucket", "run", "blob")


def left_over(key: np.ndarray, of: np.ndarray, doc: np.ndarray, at: np.ndarray, first: np.ndarray, more: np.ndarray, told: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asking window, earlier first holder) of one key that the first round may not settle, AT_ONCE or a window's at a time.

    Windows with all words told ask those of other classes (of), others ask all. Sorted by (key, of).
    """
    firsts = np.flatnonzero(first)
    count = np.concatenate((np.zeros(1, np.int64), np.cumsum(first)))
    fresh = np.r_[True, np.diff(key) != 0][: len(key)]
    kinds = fresh | np.r_[True, np.diff(of) != 0][: len(key)]

    def bounds(lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins, group = np.flatnonzero(lead), np.cumsum(lead) - 1
        return count[begins][group], count[np.r_[begins[1:], len(key)]][group]

    (low, high), (from_, to) = bounds(fresh), bounds(kinds)
    asking = np.flatnonzero(more)
    skip_from, skip_to = np.where(told, from_, high)[asking], np.where(told, to, high)[asking]
    low, high = low[asking], high[asking]
    total = np.cumsum(skip_from - low + high - skip_to)
    start = 0
    while start < len(asking):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + AT_ONCE, side="right")))
        w = slice(start, end)
        a = np.concatenate((np.repeat(asking[w], (skip_from - low)[w]), np.repeat(asking[w], (high - skip_to)[w])))
        b = firsts[np.concatenate((ranges(low[w], (skip_from - low)[w]), ranges(skip_to[w], (high - skip_to)[w])))]
        keep = apart(doc, at, a, b)
        yield a[keep], b[keep]
        start = end


_LEFT = "run int, bucket int, kind int, blob binary, ids array<long>"


def _met_again(table: pa.Table) -> pa.Table:
    """Questions of the second round, and with them the ids of the documents they touch."""
    got = [unpack(b) for b in table.column("blob").to_pylist()]
    key = np.concatenate([np.cumsum(g["step"], dtype=np.uint64) for g in got])
    c = {k: np.concatenate([g[k] for g in got]) for k in got[0]} | {"run": np.repeat(np.array(table.column("run").to_pylist()), [len(g["at"]) for g in got])}
    order = np.lexsort((c["at"], c["doc"], c["of"], key))
    key, c = key[order], {k: v[order] for k, v in c.items()}
    bucket, rows = table.column("bucket")[0].as_py(), []
    for a, b in left_over(key, c["of"], c["doc"], c["at"].astype(np.int64), c["first"], c["more"], c["told"]):
        order = np.lexsort((c["at"][a], c["doc"][b], c["nth"][a], c["doc"][a], c["run"][a]))
        a, b = a[order], b[order]
        run = c["run"][a]
        for r in np.unique(run).tolist():
            i, j = np.searchsorted(run, [r, r + 1])
            x, y = a[i:j], b[i:j]
            blob = pack({k: c[k][x] for k in ("doc", "nth", "at", "before", "behind")} | {"other": c["doc"][y], "other_at": c["at"][y], "same": c["of"][x] == c["of"][y]})
            rows.append((r, bucket, 0, blob, np.union1d(c["doc"][x], c["doc"][y]).tolist()))
    out = _rows([r[:4] for r in rows], "run", "bucket", "kind", "blob")
    return out.append_column("ids", pa.array([r[4] for r in rows], pa.list_(pa.int64())))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans and links of both rounds as one."""
    for batch in batches:
        spans, links = batch.column("spans").to_pylist(), batch.column("repeats_of").to_pylist()
        for k, (more, others) in enumerate(zip(batch.column("_spans").to_pylist(), batch.column("_links").to_pylist())):
            if more or others:
                links[k] = sorted({*links[k], *others})
                joined: list[dict[str, int]] = []
                for x in sorted(spans[k] + more, key=lambda x: x["first_word"]):
                    if joined and x["first_word"] <= joined[-1]["last_word"] + 1:
                        joined[-1]["last_word"] = max(joined[-1]["last_word"], x["last_word"])
                    else:
                        joined.append(dict(x))
                spans[k] = joined
        columns = {f.name: batch.column(f.name) for f in _RESULT} | {"spans": pa.array(spans, _RESULT.field("spans").type), "repeats_of": pa.array(links, pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_pydict(columns, schema=_RESULT)


def _rounds(docs: DataFrame, run_bytes: int, classes: bool) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, n_words, spans, repeats_of, text_md5) and, with classes, (node, root) of linked documents.

    Without classes the second round looks for words alone.
    """
    runs, n = in_runs(docs, run_bytes)
    buckets = pieces(n, 2)
    counted = runs.groupBy("run").applyInArrow(lean(_distinct(buckets)), _ROWS).groupBy("bucket").applyInArrow(lean(_counted), "run int, bucket int, blob binary")
    replies = with_answers(runs, counted, _windows(buckets), _ROWS).groupBy("bucket").applyInArrow(lean(_met), _MET)
    both = stored(_answered(runs, replies, n))
    found, left = both.filter("left IS NULL"), both.filter("left IS NOT NULL").select("run", "bucket", "left")
    result = found.select(*_RESULT.names)
    roots = _roots(result) if classes else None
    if left.isEmpty():
        return result, roots
    of = found.filter("doc_id IS NOT NULL").select(F.col("run").alias("_run"), F.col("doc_id").alias("_id")).distinct()
    of = of.join(roots, F.col("_id") == F.col("node")) if classes else of.withColumn("root", F.lit(0).cast("long"))
    release_shuffles(docs.sparkSession)
    asked = stored(left.groupBy("run").cogroup(of.groupBy("_run")).applyInArrow(lean(_classed), _ROWS).groupBy("bucket").applyInArrow(lean(_met_again), _LEFT))
    if asked.isEmpty():
        return result, roots
    ids = stored(asked.select(F.explode("ids").alias("_id")).distinct())
    release_shuffles(docs.sparkSession)
    few = dealt(docs.join(ids, docs["doc_id"].cast("long") == ids["_id"], "left_semi"), n)
    again = _answered(few, asked.select("run", "bucket", "kind", "blob"), n).filter("size(spans) > 0")
    again = again.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), F.col("spans").alias("_spans"), F.col("repeats_of").alias("_links"))
    again = stored(again.dropDuplicates(["_id", "_md5"]))
    result = stored(result.join(again, (F.col("doc_id") == F.col("_id")) & (F.col("text_md5") == F.col("_md5")), "left").mapInArrow(lean_batches(_united), _RESULT_DDL))
    return result, _roots(result) if classes else None


def _answered(runs: DataFrame, replies: DataFrame, n: int) -> DataFrame:
    # Requests are dealt by the run they ask, states by their own: one exchange serves both readers, and as all is one job
    # the documents are dealt once.
    work = with_answers(runs, replies, _proposed(n), _WORK)
    served = with_answers(runs, work, _served_work, "run int, bucket int, blob binary")
    return with_answers(work, served, _judged_work, _FOUND_DDL)


def _roots(found: DataFrame) -> DataFrame:
    return components(found.select(F.col("doc_id").alias("a"), F.explode("repeats_of").alias("b")))


def passages(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """doc_id, n_words, spans (words of passages that near-duplicate earlier ones, from 0, last included), repeats_of, text_md5."""
    return _rounds(docs, run_bytes, classes=False)[0]


def near_duplicate_passages(docs: DataFrame) -> DataFrame:
    """passages(), with n_repeated (words in spans), n_links and class_id: the smallest doc_id that links lead to.

    A document that repeats a passage is linked to its earlier holders, but for those that repeat a linked one there and,
    where a token has many holders, those that are of its class by other links.
    """
    found, roots = _rounds(docs, RUN_BYTES, classes=True)
    roots = roots.select(F.col("node").alias("_node"), "root")
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last_word"] - x["first_word"] + 1)
    out = found.join(roots, F.col("doc_id") == F.col("_node"), "left")
    return out.select("doc_id", "n_words", words.alias("n_repeated"), F.size("repeats_of").cast("long").alias("n_links"), F.coalesce("root", "doc_id").alias("class_id"), "spans", "repeats_of")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without(text: str, spans: list[dict[str, int]]) -> str:
    """text without the words of the spans and the white space between them; other characters stay as they are."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["first_word"]][0]])
        at = places[s["last_word"]][1]
    return "".join((*out, text[at:]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.schema.get_field_index("text")
        texts = [without(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
        yield batch.set_column(k, batch.schema.field(k), pa.array(texts, pa.string()))


def cut(docs: DataFrame) -> DataFrame:
    """docs without the words of near-duplicate passages; a document that loses all its words goes, n_chars follows.

    A row is known by its doc_id and text together, so that of rows that repeat an id each loses its own words; rows that
    repeat both lose the same. Rows without an id, with a null text or without passages stay as they are; so does an empty table.
    """
    marked = passages(docs).filter("size(spans) > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), F.col("spans").alias("_spans"))
    marked = stored(marked.dropDuplicates(["_id", "_md5"]))
    release_shuffles(docs.sparkSession)
    # Texts need not move if the spans are few; beyond that both sides meet by key.
    size = marked.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("_spans")), F.lit(0)).alias("spans")).first()
    if 100 * size["rows"] + 16 * size["spans"] <= FEW:
        marked = F.broadcast(marked)
    rows = docs.select(F.struct("*").alias("_row"), docs["doc_id"].cast("long").alias("_doc"), F.unhex(F.md5(docs["text"])).alias("_of"), docs["text"].alias("_text"))
    joined = rows.join(marked, (F.col("_doc") == F.col("_id")) & (F.col("_of") == F.col("_md5")), "left").select("_row", F.col("_text").alias("text"), F.col("_spans").alias("spans"))
    done = joined.mapInArrow(lean_batches(_cut), joined.schema)
    left = done.filter(F.col("spans").isNull() | (F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")) != ""))
    names = docs.columns
    columns = [F.col("text") if c == "text" else F.when(F.col("spans").isNull(), F.col("_row.n_chars")).otherwise(F.length("text")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in names]
    return left.select(*columns)
