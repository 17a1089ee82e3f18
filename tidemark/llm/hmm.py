"""A hidden Markov language model over all documents.

Tokens are words with ASCII letters lower-cased and one end a document. Events are the V distinct training tokens and
one for every unknown word. Each event has a class: the end has one, tokens seen once share one with the unknown word,
all others fall into CLASSES by their length and last three bytes. A hidden state emits one of the classes that hold an
event, and the class its event by its training counts (the class of rare events: half to the unknown word, half to the
tokens seen once, all to the unknown word if there are none), so that all probabilities of a step add up to 1 while the parameters to train stay STATES x CLASSES however many words there are.

Counts of words come through tidemark.llm.runs: each run sends its distinct words with its training counts and gets the
totals. Baum-Welch runs over all training documents: every partition adds up expected counts by the forward-backward
recursion, the sums are added by number on the executors, and the driver sees STATES x (STATES + CLASSES + 1) numbers a
round. The final pass computes exact likelihoods of all documents by the scaled forward recursion.

Defined results: null and empty texts are one end; a null doc_id is a training document; rows repeat as they come (and
count as often); without training tokens the model keeps its first rates; other columns, whatever their names, are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, lean_batches, pieces, stored
from tidemark.llm.runs import RUN_BYTES, answers, ask, in_runs, unpack, with_answers

STATES, CLASSES, ROUNDS, SEED = 8, 4096, 4, 7
RARE, END = 0, 1
FOLDS, HELD = 7, 2
#: Key of the end: words hash with another seed.
END_KEY = np.uint64(xxhash.xxh64_intdigest(b"", 1))
#: Tokens that walk through the recursions together.
TOGETHER = 1_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def class_of(word: bytes) -> int:
    return 2 + zlib.crc32(word[-3:], len(word) if len(word) < 4 else 4) % (CLASSES - 2)


class Words:
    """Words of a run: distinct ones by sorted key, and each document as places in that order, the end last."""

    def __init__(self, table: pa.Table):
        seen: dict[bytes, int] = {}
        docs = []
        for t in table.column("text").to_pylist():
            docs.append([seen.setdefault(w, len(seen)) for w in t.encode().lower().split()])
        keys = np.array([xxhash.xxh64_intdigest(w, 0) for w in seen] + [int(END_KEY)], np.uint64)
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys = keys[order]
        self.classes = np.array([class_of(w) for w in seen] + [END], np.uint16)[order]
        self.docs = [place[np.array(d + [len(seen)], np.int64)] for d in docs]
        self.train = ~np.array(table.column("held_out").to_pylist(), bool)


def _counts(table: pa.Table):
    words = Words(table)
    n = np.zeros(len(words.keys), np.int64)
    if words.train.any():
        n += np.bincount(np.concatenate([d for d, t in zip(words.docs, words.train) if t]), minlength=len(n))
    return words.keys, {"n": n, "c": words.classes}


def _totals(inverse: np.ndarray, columns: dict[str, np.ndarray], size: int) -> dict[str, np.ndarray]:
    n = np.zeros(size, np.int64)
    np.add.at(n, inverse, columns["n"])
    c = np.zeros(size, np.uint16)
    c[inverse] = columns["c"]
    return {"n": n, "c": c}


def _reported(table: pa.Table) -> pa.Table:
    """Bucket totals by class: events with counts of 2 and more, and rare ones; read from the answers."""
    sums = np.zeros((CLASSES, 2), np.int64)
    for blob in table.column("answer").to_pylist():
        a = unpack(blob)
        n, c = a["n"][a["once"]], a["c"][a["once"]].astype(np.int64)
        c = np.where((n == 1) & (c != END), RARE, c)
        np.add.at(sums, c[n > 0], np.stack((n, np.ones_like(n)), 1)[n > 0])
    held = np.flatnonzero(sums[:, 1])
    return pa.table({"c": pa.array(held, pa.int64()), "n": pa.array(sums[held, 0]), "v": pa.array(sums[held, 1])})


def _encoded(total: int, distinct: int, mass: np.ndarray, rare: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _ENCODED.empty_table()
        words, told = Words(table), answers(replies)
        n = told["n"]
        c = np.where(n <= 1, RARE, words.classes)
        c[words.classes == END] = END
        base = np.log10((n + 1) / (total + distinct + 1))
        unknown = 0.5 if rare else 1.0
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = np.where(n > 1, np.log10(n / mass[c]), np.log10(np.where(n == 1, (1 - unknown) / max(1, rare), unknown)))
        inside[c == END] = 0.0
        rows = [(len(d), int((n[d] > 0).sum()), float(base[d].sum()), float(inside[d].sum()), c[d].astype("<u2").tobytes()) for d in words.docs]
        return pa.table([table.column("doc_id"), table.column("held_out"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())))], schema=_ENCODED)

    return run


_ENCODED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("inside", pa.float64()), ("classes", pa.binary())])
_ENCODED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, classes binary"


class Model:
    """start (S), step (S x S), emit (S x CLASSES): rows of probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @staticmethod
    def first(weight: np.ndarray, states: int = STATES) -> "Model":
        """The classes' own rates, shaken so that states can part; states tend to stay. A weight of -1: a class without events."""
        rng = np.random.default_rng(SEED)
        emit = (weight + 1) * np.exp(rng.normal(0, 0.5, (states, len(weight))))
        step = np.full((states, states), 0.2 / max(1, states - 1)) + np.eye(states) * 0.8
        return Model(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @staticmethod
    def of_counts(flat: np.ndarray, weight: np.ndarray, states: int = STATES) -> "Model":
        """The M step; a little of the classes' own rates keeps every event possible."""
        start, step, emit = flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(states, -1)
        prior = (weight + 1) / (weight + 1).sum()
        norm = lambda x: x / x.sum(-1, keepdims=True)
        return Model(norm(start + 0.1), norm(step + 0.1), norm(emit + prior))


def class_weights(mass: np.ndarray, types: np.ndarray) -> np.ndarray:
    """Training tokens of each class, -1 for a class that holds no event; unknown words and ends are always possible."""
    holds = types > 0
    holds[[RARE, END]] = True
    return np.where(holds, mass, -1.0)


def groups(docs: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of like length, about TOGETHER tokens at once: (their places, tokens one behind another, lengths, starts)."""
    order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
    at = 0
    while at < len(order):
        size, to = 0, at
        while to < len(order) and (to == at or size + len(docs[order[to]]) <= TOGETHER):
            size += len(docs[order[to]])
            to += 1
        own = order[at:to]
        lengths = np.array([len(docs[k]) for k in own])
        yield own, np.concatenate([docs[k] for k in own]), lengths, np.cumsum(lengths) - lengths
        at = to


def forward(model: Model, tokens: np.ndarray, lengths: np.ndarray, starts: np.ndarray, keep: bool = False, kind=np.float64):
    """log10 likelihood of each sequence (longest first) by the scaled recursion; with `keep`, also states and scales."""
    emit, step = np.ascontiguousarray(model.emit.T.astype(kind)), model.step.astype(kind)
    states = len(model.start)
    total = np.zeros(len(lengths))
    alpha = np.empty((len(tokens), states), kind) if keep else None
    scale = np.empty(len(tokens), kind) if keep else None
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    a = np.broadcast_to(model.start.astype(kind), (len(lengths), states))
    for t, n in enumerate(live.tolist()):
        at = starts[:n] + t
        a = (a[:n] @ step if t else a[:n]) * emit[tokens[at]]
        c = a.sum(1)
        a = a / c[:, None]
        total[:n] += np.log10(c)
        if keep:
            alpha[at], scale[at] = a, c
    return total, alpha, scale, live


def expected(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Expected counts of starts, steps and emissions, flat; single precision inside a sequence, double in the sums."""
    states, classes = model.emit.shape
    start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
    b, a = np.ascontiguousarray(model.emit.T.astype(np.float32)), model.step.astype(np.float32)
    for _, tokens, lengths, starts in groups(docs):
        _, alpha, scale, live = forward(model, tokens, lengths, starts, keep=True, kind=np.float32)
        beta = np.ones((len(lengths), states), np.float32)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            at = starts[:n] + t
            here = beta[:n]  # sequences that end here still have their ones
            if t:
                onward = here * b[tokens[at]] / scale[at][:, None]
                step += alpha[at - 1].T @ onward
            alpha[at] *= here  # from here on: how likely each state is
            if t:
                beta[:n] = onward @ a.T
            else:
                start += alpha[at].sum(0)
        for s in range(states):
            emit[s] += np.bincount(tokens, alpha[:, s], classes)
    return np.concatenate((start, (step * model.step).ravel(), emit.ravel()))


def _expected(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            docs = [np.frombuffer(c, "<u2").astype(np.int64) for c in batch.column("classes").to_pylist()]
            if docs:
                counts = expected(model, docs)
                total = counts if total is None else total + counts
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["at", "n"])

    return run


def _scores(model: Model, n_train: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [np.frombuffer(c, "<u2").astype(np.int64) for c in batch.column("classes").to_pylist()]
            score = batch.column("inside").to_numpy().copy()
            for own, tokens, lengths, starts in groups(docs):
                score[own] += forward(model, tokens, lengths, starts)[0]
            kept = batch.select(["doc_id", "held_out", "n_tokens", "n_known"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(len(score), n_train), pa.int64()), batch.column("base_score"), pa.array(score, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def scores(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES, run_bytes: int = RUN_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    runs, n = in_runs(docs, run_bytes, held_out(F.col("doc_id")).alias("held_out"))
    replies = stored(ask(runs, pieces(n, 2), _counts, _totals, mark_once=True))
    by_class = replies.groupBy("bucket").applyInArrow(lean(_reported), "c long, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    mass, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in by_class.collect():  # at most CLASSES rows
        mass[r["c"]], types[r["c"]] = r["n"], r["v"]
    total = int(mass.sum())
    encoded = stored(with_answers(runs, replies, _encoded(total, int(types.sum()), mass, int(types[RARE])), _ENCODED_DDL))
    weight = class_weights(mass, types)
    model = Model.first(weight, states)
    train = encoded.filter("NOT held_out").select("classes")
    for _ in range(rounds if total else 0):
        got = train.mapInArrow(lean_batches(_expected(model)), "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        flat = np.zeros(states + states**2 + states * CLASSES)  # as many rows come at most
        flat[got.column("at").to_numpy()] = got.column("n").to_numpy()
        model = Model.of_counts(flat, weight, states)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return encoded.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "inside", "classes").mapInArrow(lean_batches(_scores(model, total)), schema)
