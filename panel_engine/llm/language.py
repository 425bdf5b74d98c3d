"""Language identification by a linear-chain conditional random field over the words of a text.

Each word is a position, each language a state. Emission features are the word's affixes, its character
n-grams and whether the word itself is in the lexicon learned from the labelled texts; transitions are
learned too. Training ascends the conditional log-likelihood in full-batch rounds: Spark sums the gradients of the labelled
words, which forward-backward gives, over all partitions. Labelling runs forward-backward over the whole text; the document's
language is the one with most expected words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panel_engine.llm.repeats import U, mixed
from panel_engine.llm.text import cut, whole

#: Words are runs of letters (combining marks included), lower-cased.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Feature slots; a word's features share them by hash.
SLOTS = 1 << 15
#: Documents that the weights are fitted on: at most so many, drawn evenly by a hash from those labelled.
TRAIN_DOCS = 1200
#: Words remembered with their features by a task; the memory starts anew beyond it.
REMEMBERED = 1 << 18


def held_out(key: str, of: int, fold: int) -> Column:
    """CRC-32 of the key as text, modulo ``of``, is ``fold``; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of == fold, F.lit(False))


def feature_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the features of lower-cased words, and the number of the word that each belongs to.

    A word is framed by two marks. Features are its n-grams of two and three characters, of which those at
    the marks are its short affixes, the longer affixes of three letters, and its lexicon entry.
    """
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), "<u4").astype(U)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    slots, of = [np.fromiter((zlib.crc32(w.encode()) % SLOTS for w in words), np.int64, len(words))], [np.arange(len(words))]

    def add(first: np.ndarray, n: int) -> None:
        h = np.full(len(first), n, U)
        for i in range(n):
            h = mixed(h * U(0x100000001B3) + codes[first + i])
        slots.append((h % U(SLOTS)).astype(np.int64))
        of.append(owner[first])

    place = np.arange(len(codes))
    for n in (2, 3):
        add(place[place + n <= end[owner]], n)
    long = np.flatnonzero(sizes > 4)
    add((end - sizes)[long], 4)
    add(end[long] - 4, 4)
    return np.concatenate(slots), np.concatenate(of)


def features(word: str) -> list[int]:
    return feature_slots([word])[0].tolist()


class Vocabulary:
    """Distinct words of a task, each with its feature slots and its scores, computed once."""

    def __init__(self, weights: np.ndarray, keep_slots: bool = False):
        self.weights, self.keep_slots = weights, keep_slots
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.slots: list[tuple[np.ndarray, np.ndarray]] = []
        self.scores = np.empty((0, self.weights.shape[1]))

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = list(set(words).difference(known))
        if new:
            base = len(known)
            known.update(zip(new, range(base, base + len(new))))
            slots, of = feature_slots(new)
            norm = np.sqrt(np.bincount(of, minlength=len(new)))
            sums = [np.bincount(of, column[slots], len(new)) / norm for column in self.weights.T]
            self.scores = np.concatenate([self.scores, np.stack(sums, axis=1) if sums else np.empty((len(new), 0))])
            if self.keep_slots:
                self.slots.append((slots, of + base))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State marginals of each word and the summed pair marginals of several texts, laid end to end.

    Scaled forward-backward runs over all texts at once, longest first, so that step i covers those
    with more than i words. ``lengths`` are positive.
    """
    n, k = scores.shape
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max(initial=0.0))
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # texts with more than i words
    forward, backward = np.empty((n, k)), np.ones((n, k))
    a = emit[starts] / emit[starts].sum(axis=1, keepdims=True)
    forward[starts] = a
    for i in range(1, longest):
        at = starts[:active[i]] + i
        a = (a[:active[i]] @ move) * emit[at]
        a /= a.sum(axis=1, keepdims=True)
        forward[at] = a
    for i in range(longest - 2, -1, -1):
        at = starts[:active[i + 1]] + i
        b = (backward[at + 1] * emit[at + 1]) @ move.T
        backward[at] = b / b.sum(axis=1, keepdims=True)
    gamma = forward * backward
    gamma /= gamma.sum(axis=1, keepdims=True)
    inner = np.ones(n, bool)
    inner[np.cumsum(lengths) - 1] = False
    p = np.flatnonzero(inner)
    total = np.zeros((k, k))
    for s in range(0, len(p), 1 << 15):
        q = p[s:s + (1 << 15)]
        pairs = forward[q][:, :, None] * move * (emit[q + 1] * backward[q + 1])[:, None, :]
        total += (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return gamma, total


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # slots x labels
    transitions: np.ndarray  # labels x labels


def gradient(texts: Sequence[str], labels: Sequence[int], model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient of the log-likelihood of texts with every word labelled alike, and the number of words."""
    k = len(model.labels)
    split = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in split])
    truth = np.repeat(np.asarray(labels), lengths)
    vocabulary = Vocabulary(model.weights, keep_slots=True)
    ids = vocabulary.numbers([w for ws in split for w in ws])
    grad, move = np.zeros_like(model.weights), np.zeros((k, k))
    if not len(ids):
        return grad, move, 0
    gamma, pairs = marginals(vocabulary.scores[ids], lengths[lengths > 0], model.transitions)
    residual = -gamma
    residual[np.arange(len(ids)), truth] += 1
    slots, of = (np.concatenate(x) for x in zip(*vocabulary.slots))
    norm = np.sqrt(np.bincount(of))
    for j in range(k):
        per_word = np.bincount(ids, residual[:, j], len(norm)) / norm
        grad[:, j] = np.bincount(slots, per_word[of], len(grad))
    np.add.at(move, (np.asarray(labels)[lengths > 0],) * 2, lengths[lengths > 0] - 1)
    return grad, move - pairs, len(ids)


def fit(
    docs: DataFrame, text: str = "text", label: str = "lang", rounds: int = 5, train_docs: int = TRAIN_DOCS,
) -> Model:
    """Model from the rows with a non-null label; a text in one language lends its label to each word.

    At most ``train_docs`` texts are fitted (one for each label at least), those of each label with the smallest hashes,
    evenly over the labels; copies of a text count once. Each round sums the gradient over
    the partitions in Spark and steps the weights scaled by each weight's past gradients.
    """
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(label).alias("l"))
    labelled = labelled.withColumn("h", F.xxhash64("t"))
    labels = sorted(r.l for r in labelled.select("l").distinct().collect())  # one row per language
    if not labels:
        return Model([], np.zeros((SLOTS, 0)), np.zeros((0, 0)))
    each = max(1, train_docs // len(labels))
    # the last hash drawn of each language; copies have one hash and count once
    ranked = labelled.select("l", "h").distinct().withColumn("i", F.row_number().over(Window.partitionBy("l").orderBy("h")))
    upto = F.lit(None).cast("long")
    for r in ranked.where(F.col("i") <= each).groupBy("l").agg(F.max("h").alias("h")).collect():
        upto = F.when(F.col("l") == r.l, F.lit(r.h)).otherwise(upto)
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("l")).cast("int") - 1
    drawn = labelled.where(F.col("h") <= upto).dropDuplicates(["l", "h"])
    sample = cut(drawn.select("t", number.alias("y")).repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism)))

    model = Model(labels, np.zeros((SLOTS, len(labels))), np.zeros((len(labels), len(labels))))
    past_w, past_t = np.full_like(model.weights, 1e-8), np.full_like(model.transitions, 1e-8)
    for step in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: slots x languages

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad = move = None
            n = 0
            for batch in batches:
                for i in range(0, batch.num_rows, 64):
                    g, m, k = gradient(batch.column(0)[i:i + 64].to_pylist(), batch.column(1)[i:i + 64].to_pylist(), shared.value)
                    grad, move, n = (g, m, k) if grad is None else (grad + g, move + m, n + k)
            if grad is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grad.astype("<f4").tobytes()]), pa.array([move.astype("<f8").tobytes()]), pa.array([n], pa.int64())], names=["g", "m", "n"])

        # one gradient of fixed size per partition of the bounded sample
        parts = sample.mapInArrow(run, "g binary, m binary, n long").collect()
        total = max(1, sum(p.n for p in parts))
        grad = sum((np.frombuffer(p.g, "<f4").reshape(model.weights.shape).astype(float) for p in parts), np.zeros_like(model.weights)) / total
        move = sum((np.frombuffer(p.m, "<f8").reshape(model.transitions.shape) for p in parts), np.zeros_like(model.transitions)) / total
        past_w += grad ** 2
        past_t += move ** 2
        model = Model(labels, model.weights + grad / np.sqrt(past_w) / np.sqrt(step + 1), model.transitions + 0.5 * move / np.sqrt(past_t))
        shared.unpersist()
    return model


def label(docs: DataFrame, model: Model, key: Sequence[str] = ("doc_id",), text: str = "text", rows: int = 1024) -> DataFrame:
    """``key`` columns, ``lang_pred``, ``score`` (share of expected words in that language), ``n_letter_words``, ``switches``.

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned. Ties go to the
    language first in code-point order. ``switches``: neighbours whose likeliest languages differ.
    ``rows`` texts are taken at once: fewer need less memory and more steps.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        vocabulary = Vocabulary(own.weights)
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                pred, score, count, switches = judged(part.column(part.num_columns - 1).to_pylist(), own, vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(pred, pa.string()), pa.array(score), pa.array(count), pa.array(switches)],
                    names=[*part.schema.names[:-1], "lang_pred", "score", "n_letter_words", "switches"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*key).schema]
    return docs.select(*key, whole(text).alias("__text")).mapInArrow(
        run, ", ".join([*kinds, "lang_pred string, score double, n_letter_words long, switches long"]))


def judged(texts: Sequence[str], model: Model, vocabulary: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, number of words and switches of each text."""
    if len(vocabulary.known) > REMEMBERED:
        vocabulary.clear()
    split = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    pred, score, switches = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    some = np.flatnonzero(lengths)
    if len(some) and model.labels:
        ids = vocabulary.numbers([w for ws in split for w in ws])
        gamma, _ = marginals(vocabulary.scores[ids], lengths[some], model.transitions)
        ends = np.cumsum(lengths[some])
        share = np.add.reduceat(gamma, ends - lengths[some]) / lengths[some][:, None]
        best = share.argmax(axis=1)
        score[some] = np.minimum(1.0, share[np.arange(len(some)), best])
        for i, b in zip(some, best):
            pred[i] = model.labels[b]
        likeliest = gamma.argmax(axis=1)
        turns = np.append(likeliest[1:] != likeliest[:-1], False)
        turns[ends - 1] = False
        switches[some] = np.add.reduceat(turns.astype(np.int64), ends - lengths[some])
    return pred, score, lengths, switches
