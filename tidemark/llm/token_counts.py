"""Token counts for a BPE piece model, through whole-token shortcuts.

The model turns every space into its word mark and adds one mark before a text. No piece holds a mark after another
character, so no merge crosses the place before a mark that follows another character: the text falls apart there into
pre-tokens (marks, then other characters) that encode independently, and the counts add up. `Proof` checks that property
for the given vocabulary, and finds by encoding it which pre-token is one token by itself. The driver proves once and
sends the result, at most the vocabulary. Executors count those pre-tokens directly; all others are merged by the library,
once for each distinct pre-token that a worker remembers.

Defined results: null and empty texts have no tokens; every row gives one row; a text of any length is counted whole.
"""

from __future__ import annotations

from collections import Counter as Tally
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tidemark.llm.common import id_and_text, lean_batches

MARK = "▁"
#: Tokens beyond which a document counts as over the limit.
LIMIT = 4096
#: Distinct pre-tokens that a worker remembers before it forgets all of them; bounds memory, not results.
MEMORY = 200_000


@lru_cache(maxsize=2)
def _model(path: str):
    """A worker's or the driver's model, loaded once."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Proof(NamedTuple):
    """What holds of a vocabulary."""

    #: Whether texts fall apart before marks: no piece has a mark behind another character, spaces become marks one by one, one mark is added.
    splits: bool
    #: Pre-tokens, without their first mark, that encode as one token.
    whole: frozenset[str]

    @staticmethod
    def of(model: str) -> "Proof":
        sp = _model(model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        splits = not any(MARK in p.lstrip(MARK) for p in plain) and sp.encode("a  b ", out_type=str) == sp.encode(f"a{MARK}{MARK}b{MARK}", out_type=str) and len(sp.encode(" ")) == len(sp.encode(MARK))
        # The model must leave characters as they are: every character of its own pieces, and some that normal forms change.
        kept = sorted({c for p in plain for c in p if c != MARK} | set("ﬁÅA\u0301Ａ①\u00ad\u200b"))
        splits = splits and all(sp.decode(ids) == c or sp.unk_id() in ids for c in kept for ids in [sp.encode(c)])
        return Proof(splits, frozenset(p[1:] for p in plain if p[0] == MARK and len(p) > 1 and len(sp.encode(p[1:])) == 1))


class Counter:
    def __init__(self, model: str, proof: Proof | None = None):
        self.sp = _model(model)
        self.splits, self.whole = proof or Proof.of(model)
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.sp.encode(text))
        # The mark that the model adds and a first space of the text make one pre-token of marks; single spaces inside
        # give a pre-token each. A run of n spaces belongs to the word behind it, so it stays with that word.
        total, known = 0, self.known
        parts = text.replace(MARK, " ").split(" ")
        if "" in parts[:-1] or not parts[-1]:
            parts = _with_runs(parts)
        for part, n in Tally(parts).items():
            if part in self.whole:
                total += n
                continue
            k = known.get(part)
            if k is None:
                if len(known) >= MEMORY:
                    known.clear()
                k = len(self.sp.encode(part)) if part else 1
                if len(part) < 200:
                    known[part] = k
            total += n * k
        return total


def _with_runs(parts: list[str]) -> list[str]:
    """Pre-tokens without their first mark, from a split at single spaces in which empty parts stand for longer runs.

    parts[k] stands behind one mark. Empty parts are further marks that belong to the next word; at the end of the text
    they are a pre-token of marks alone.
    """
    out, marks = [], 0
    for p in parts:
        if p:
            out.append(" " * marks + p)
            marks = 0
        else:
            marks += 1
    if marks:
        out.append(" " * (marks - 1))
    return out


def _counted(model: str, proof: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model, proof.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > LIMIT for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; `model` is a path that every executor can open."""
    proof = docs.sparkSession.sparkContext.broadcast(Proof.of(model))  # no larger than the vocabulary
    return id_and_text(docs).mapInArrow(lean_batches(_counted(model, proof)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
