"""Byte-level BPE over a monoid tree: halves are encoded by themselves, neighbours are joined at their boundary.

A text is halved down to leaves of LEAF characters; the leaves of many texts are encoded together. A node holds the pre-tokens of its stretch with their ids, from a scan
that began at the stretch's first character, and the place `rest` from which on nothing is settled. What a pattern without
lookbehind matches from a place on depends only on characters that it looks at. A branch of the pattern takes each of them
by a repeated character class or by one of at most k other atoms (`branches` reads both off the pattern), so it can reach
the end of a stretch only if all characters up to there, but for k, are of its repeated classes. Before the last place where
that holds for some branch every pre-token is settled, whatever text follows.

`join` scans on from the left node's rest into a window of the right node and doubles the window until a pre-token begins
where one of the right node begins: from there on the right node's pre-tokens provably stay, and only the window is
encoded anew. Joining is associative and the empty text is its identity. The root scans its rest to the true end.

Pre-tokens are merged here by the ranks: the whole pre-token if it has a rank, else the pair of lowest rank first, the
leftmost of equals; the new pre-tokens of a batch take their steps side by side in numpy (`merge_all`), long ones by a heap
(`merged`). Letters and digits are those of the tiktoken library, whose tables may differ from the regex module's.
Decoding concatenates bytes up a tree of halves.

Defined results: null and empty texts have no ids; each row gives one row; texts of any length are encoded whole;
characters that the split pattern does not match have no ids; a pattern that looks behind, repeats a group without end,
looks at line ends or may match the empty text is refused with ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import id_and_text, lean_batches

#: Characters in a leaf of the tree, and ids in a leaf of decoding.
LEAF = 1024
#: Characters of a boundary window at first.
WINDOW = 32
#: Pre-tokens after which a worker forgets those not met since it last did so, and the length of the longest; bounds memory, not results.
MEMORY, LONGEST = 200_000, 64
#: Bits of an id, and the rank of a pair that makes no token.
BITS, NONE = 24, 1 << 24
#: Bytes of the longest pre-token that is merged side by side with others, and characters of texts whose leaves are.
SHORT, TOGETHER = 64, 1_000_000
_ATOM = re.compile(r"\\[pP]\{\^?\w+\}|\\[^pP\d]|\[\^?\]?(?:\\.|[^\]\\])*\]|[^\\\[\]()|?*+{}^$]", re.S)
_REPEAT = re.compile(r"(?:([?*+])|\{(\d+)(,?)(\d*)\})[?+]?")
_OPEN = re.compile(r"\((?:\?(?:[ims]*:|[=!>]))?")


def branches(pattern: str) -> list[tuple[str, int]]:
    """For each alternative the classes that it repeats without end (as one class pattern, maybe empty) and the most
    characters that its other atoms take or look at. ValueError where the pattern allows no such bound."""

    def refuse(why: str) -> None:
        raise ValueError(f"the split pattern {why}: {pattern}")

    def counted(at: int) -> tuple[int | None, int]:
        m = _REPEAT.match(pattern, at)
        if not m:
            return 1, at
        most = {"?": 1, "*": None, "+": None}[m[1]] if m[1] else int(m[4]) if m[4] else None if m[3] else int(m[2])
        return most, m.end()

    def alternatives(at: int) -> tuple[list[tuple[list[str], int]], int]:
        out: list[tuple[list[str], int]] = [([], 0)]
        while at < len(pattern) and pattern[at] != ")":
            classes, k = out[-1]
            if pattern[at] == "|":
                out.append(([], 0))
                at += 1
            elif m := _OPEN.match(pattern, at):
                inner, at = alternatives(m.end())
                if at >= len(pattern):
                    refuse("leaves a group open")
                most, at = counted(at + 1)
                if most is None:
                    refuse("repeats a group without end")
                out[-1] = (classes + [c for x, _ in inner for c in x], k + most * max(n for _, n in inner))
            elif (m := _ATOM.match(pattern, at)) and not (m[0][0] == "\\" and m[0][1] in "bBAGKmMzZXR"):
                most, at = counted(m.end())
                out[-1] = (classes + [m[0]], k) if most is None else (classes, k + most)
            else:
                refuse("looks behind or has parts unknown here")
        return out, at

    found, at = alternatives(0)
    if at < len(pattern):
        refuse("closes a group that is not open")
    return [("|".join(dict.fromkeys(classes)), k) for classes, k in found]


class Node(NamedTuple):
    """Pre-tokens of a stretch: where each begins, and its ids (four bytes each); the stretch's rest is not settled."""

    starts: list[int]
    pieces: list[bytes]
    rest: int
    end: int


@lru_cache(maxsize=4)
def _stand_ins(pattern: str) -> dict[str, str]:
    """Characters that the tiktoken library takes for letters or digits and the regex module doesn't, or the reverse.

    Each with a character that both take for the library's kind. The kinds are those the pattern names.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    one_byte = {bytes([b]): b for b in range(256)}
    kinds = {k: c for k, c in ((r"\p{L}", "ä"), (r"\p{N}", "½"), (r"\s", " ")) if k in pattern}
    known = []
    for kind, like in kinds.items():
        bpe = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=one_byte, special_tokens={})
        known.append((like, set(bytes(bpe.encode_ordinary(every)).decode()), set(regex.findall(kind, every))))
    odd = set().union(*(theirs ^ ours for _, theirs, ours in known))
    return {c: next((like for like, theirs, _ in known if c in theirs), "§") for c in odd}


class Pairs:
    """Rank of every pair of tokens that make one, which is that one's id: an open hash table for numpy."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: dict[int, int]):
        self.shift = np.uint64(64 - max(8, (4 * len(pairs)).bit_length()))
        self.keys, self.ranks = np.zeros(1 << (64 - int(self.shift)), np.uint64), np.full(1 << (64 - int(self.shift)), NONE, np.int32)
        keys, ranks = (np.fromiter(x, t, len(pairs)) for x, t in ((pairs.keys(), np.uint64), (pairs.values(), np.int32)))
        keys += np.uint64(1)  # 0 is a free place
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = keys[left[free]]
            put = self.keys[at[left]] == keys[left]
            self.ranks[at[left[put]]] = ranks[left[put]]
            left = left[~put]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.FACTOR) >> self.shift).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(BITS) | b.astype(np.uint64)) + np.uint64(1)
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], np.int32(NONE))
        left = np.flatnonzero((found != keys) & (found != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (found != 0)]
        return out


class Tree:
    def __init__(self, ranks_file: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import regex

        if regex.match(pattern, ""):
            raise ValueError("the split pattern may match the empty text")
        most: dict[str, int] = {}
        for classes, k in branches(pattern):
            most[classes] = max(k, most.get(classes, 0))
        #: For the classes that alternatives repeat, what finds the last character outside them, and how many such they may pass.
        self.passes = [(regex.compile(f"(?rs)(?!{classes})." if classes else "(?rs)."), k) for classes, k in most.items()]
        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        by_id = dict(sorted((i, b) for b, i in self.ranks.items()))
        #: The bytes of all tokens one behind another, and where each id's begin.
        self.spelt = np.frombuffer(b"".join(by_id.values()), np.uint8)
        self.sizes = np.zeros(max(by_id) + 1, np.int64)
        self.sizes[list(by_id)] = [len(b) for b in by_id.values()]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs: dict[int, int] = {}
        for t, i in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    self.pairs[a << BITS | b] = i
        self.table = Pairs(self.pairs)
        self.pattern, self.odd = regex.compile(pattern), _stand_ins(pattern)
        self.groups = self.pattern.groups
        self.strange, self.translated = frozenset(self.odd), str.maketrans(self.odd)
        self.leaf, self.window = max(1, leaf), max(1, window)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, raw: bytes) -> bytes:
        """Ids of one pre-token: a heap of pairs (rank, place, first part, second part); one counts if its parts are still there."""
        if (i := self.ranks.get(raw)) is not None:
            return i.to_bytes(4, "little")
        ids, rank = self.single[np.frombuffer(raw, np.uint8)].tolist(), self.pairs.get
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank(a << BITS | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, x, y = heapq.heappop(heap)
            m = after[k]
            if ids[k] != x or m >= n or ids[m] != y:
                continue
            ids[k], ids[m], after[k] = r, -1, after[m]
            if (q := after[k]) < n:
                before[q] = k
                if (s := rank(r << BITS | ids[q])) is not None:
                    heapq.heappush(heap, (s, k, r, ids[q]))
            if (p := before[k]) >= 0 and (s := rank(ids[p] << BITS | r)) is not None:
                heapq.heappush(heap, (s, p, ids[p], r))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """merged() of words of SHORT bytes at most, none of which has a rank: each step merges one pair of every word."""
        length = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), length)
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        done_word, done_ids = [], []

        def ranks(at: np.ndarray) -> np.ndarray:
            """Of the pairs that begin at these places, NONE behind a word's last part."""
            to = np.minimum(at + 1, len(ids) - 1)
            return np.where((word[at] == word[to]) & (to > at), self.table.of(ids[at], ids[to]), np.int32(NONE))

        near = ranks(np.arange(len(ids)))
        while len(ids):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(near, begin), np.diff(np.r_[begin, len(ids)]))
            live = least < NONE
            done_word.append(word[~live])
            done_ids.append(ids[~live])
            word, ids, near, least = word[live], ids[live], near[live], least[live]
            at = np.flatnonzero(near == least)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]][: len(at)]]  # the leftmost of each word
            ids[at] = least[at]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            word, ids, near = word[stays], ids[stays], near[stays]
            at -= np.arange(len(at))  # parts that went before
            if len(at):
                near[at] = ranks(at)
                left = at[at > 0] - 1
                near[left] = ranks(left)
        done = np.concatenate(done_word) if done_word else word
        order = np.argsort(done, kind="stable")
        raw = np.concatenate(done_ids)[order].astype("<u4").tobytes() if done_ids else b""
        ends = 4 * np.cumsum(np.bincount(done, minlength=len(words)))
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, words: set[str]) -> None:
        """Remembers the ids of new pre-tokens."""
        new = words.difference(self.known)
        if len(self.known) + len(new) >= MEMORY:
            self.known, self.older, new = {}, self.known, words
        old, rest, raws = self.older.get, [], []
        for w in new:
            if (ids := old(w)) is not None:
                self.known[w] = ids
            elif len(w) <= LONGEST:
                raw = w.encode()
                if raw in self.ranks or len(raw) > SHORT:
                    self.known[w] = self.merged(raw)
                else:
                    rest.append(w)
                    raws.append(raw)
        self.known.update(zip(rest, self.merge_all(raws)))

    def ids_of(self, piece: str) -> bytes:
        return self.known.get(piece) or self.older.get(piece) or self.merged(piece.encode())

    def settled(self, view: str) -> int:
        """The last place from which no alternative of the pattern can reach the end of the text; -1 if there is none."""
        least = len(view)
        for outside, k in self.passes:
            place = len(view)
            for _ in range(k + 1):
                m = outside.search(view, 0, place)
                if not m:
                    return -1
                place = m.start()
            least = min(least, place)
        return least

    def words(self, text: str, view: str, start: int, end: int, last: bool = False) -> tuple[list[int], list[str], int]:
        """Settled pre-tokens of text[start:end] (all of them if the text ends there) with their starts, and the rest."""
        part = view[start:end]
        words = self.pattern.findall(part)
        starts = list(accumulate(map(len, words), initial=start))
        if starts[-1] != end or self.groups:  # characters between the pre-tokens
            spans = [m.span() for m in self.pattern.finditer(part)]
            starts, ends = [start + a for a, _ in spans], [start + b for _, b in spans]
            words = [text[a:b] for a, b in zip(starts, ends)]
        else:
            ends = starts[1:]
            if view is not text:
                words = [text[a:b] for a, b in zip(starts, ends)]
        if not last:
            n = bisect_right(starts, start + self.settled(part), 0, len(words))
            del words[n:]
        return starts[: len(words)], words, ends[len(words) - 1] if words else start

    def scanned(self, text: str, view: str, start: int, end: int, last: bool = False) -> Node:
        starts, words, rest = self.words(text, view, start, end, last)
        return Node(starts, [self.ids_of(w) for w in words], rest, end)

    def join(self, text: str, view: str, a: Node, b: Node) -> Node:
        begin, width, k = a.end, self.window, 0
        starts, pieces, rest = a.starts, a.pieces, a.rest
        while True:
            to = min(b.end, begin + width)
            more = self.scanned(text, view, rest, to)
            for at, p in enumerate(more.starts):
                while k < len(b.starts) and b.starts[k] < p:
                    k += 1
                if k < len(b.starts) and b.starts[k] == p:
                    return Node(starts + more.starts[:at] + b.starts[k:], pieces + more.pieces[:at] + b.pieces[k:], b.rest, b.end)
            starts, pieces, rest = starts + more.starts, pieces + more.pieces, more.rest
            if to == b.end:
                return Node(starts, pieces, rest, b.end)
            width *= 2

    def _halved(self, start: int, end: int) -> list[tuple[int, int]]:
        """The leaves' stretches, from the left."""
        if end - start <= self.leaf:
            return [(start, end)]
        half = (start + end) // 2
        return self._halved(start, half) + self._halved(half, end)

    def _reduced(self, text: str, view: str, start: int, end: int, leaves: Iterator[Node]) -> Node:
        if end - start <= self.leaf:
            return next(leaves)
        half = (start + end) // 2
        left = self._reduced(text, view, start, half, leaves)
        return self.join(text, view, left, self._reduced(text, view, half, end, leaves))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each: leaves first, all of them together, then up each text's tree."""
        views = [t if t.isascii() or self.strange.isdisjoint(t) else t.translate(self.translated) for t in texts]
        found = [[(*self.words(t, v, a, b), b) for a, b in self._halved(0, len(t))] for t, v in zip(texts, views)]
        self.learn(set(chain.from_iterable(words for leaves in found for _, words, _, _ in leaves)))
        out, known = [], self.known.get
        for t, v, leaves in zip(texts, views, found):
            nodes = []
            for starts, words, rest, end in leaves:
                pieces = list(map(known, words))
                nodes.append(Node(starts, [p or self.ids_of(w) for p, w in zip(pieces, words)] if None in pieces else pieces, rest, end))
            root = self._reduced(t, v, 0, len(t), iter(nodes))
            out.append(b"".join(root.pieces + self.scanned(t, v, root.rest, len(t), last=True).pieces))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if len(ids) > self.leaf:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        size = self.sizes[ids]
        ends = np.cumsum(size)
        return self.spelt[np.repeat(self.begins[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes() if len(ids) else b""


@lru_cache(maxsize=1)
def _tree(ranks_file: str, pattern: str) -> Tree:
    """A worker's tree: what it remembers serves its next task too."""
    return Tree(ranks_file, pattern)


def _coded(ranks_file: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(ranks_file, pattern)
        for batch in batches:
            texts, coded, k = batch.column("text").to_pylist(), [], 0
            while k < len(texts):
                size, to = len(texts[k]), k + 1
                while to < len(texts) and size + len(texts[to]) <= TOGETHER:
                    size += len(texts[to])
                    to += 1
                coded += tree.encode_all(texts[k:to])
                k = to
            decoded = [hashlib.sha256(tree.decode(np.frombuffer(c, "<u4"))).hexdigest() for c in coded]
            columns = {
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(c) // 4 for c in coded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()), "decoded_sha256": pa.array(decoded, pa.string()),
            }
            if with_ids:
                ends = np.cumsum([0] + [len(c) // 4 for c in coded])
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids; ranks_file is a path every executor can open."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_and_text(docs).mapInArrow(lean_batches(_coded(ranks_file, pattern, with_ids)), schema)
