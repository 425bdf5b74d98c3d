"""Toxic passages by maximum-scoring segment search over token log-odds.

Token scores are log-odds of toxic against other texts under Dirichlet priors, learned from labelled rows
for words and, for words too rare to score, for what they begin with.
One linear scan over a text finds all maximal scoring segments. How high a segment a clean text reaches by chance is
known: the extreme-value law of maximal segment sums, whose rate lambda solves E[exp(lambda s)] = 1 and
whose scale K is fitted on the clean labelled texts, gives each segment an expected number of chance segments as good, and the document
one p-value. A document's score is the chance that it is toxic at that calibrated value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panel_engine.llm.text import cut, whole

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Rows that scores are learned from: at most about so many of each label, drawn by a hash of the text.
TRAIN_DOCS = 8_000
#: Tokens with scores, at most: those furthest from zero. Others score the default.
MODEL_TOKENS = 50_000


#: Standard errors from zero that a token's log-odds must lie.
LEAST_Z = 4.0
#: Words remembered with their scores by a task; the memory starts anew beyond it.
REMEMBERED = 1 << 18


@dataclass
class Model:
    scores: dict[str, float]
    default: float
    rate: float  # lambda
    log_scale: float  # log K
    slope: float
    offset: float
    known: dict[str, float] = field(default_factory=dict, compare=False)

    def of(self, words: list[str]) -> np.ndarray:
        """A word's own score, or that of the longest beginning that has one, or the default."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = next((self.scores[f] for f in names(w) if f in self.scores), self.default)
        return np.fromiter(map(known.__getitem__, words), float, len(words))


def names(word: str) -> list[str]:
    """The word, then its true beginnings of nine to six letters."""
    return [word, *[f"{word[:k]}*" for k in range(min(9, len(word) - 1), 5, -1)]]


def tokens(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), in order, by one linear scan.

    Of candidates kept on a stack, each with the running totals before and after it, a new one joins
    the nearest earlier one that starts lower, if that one also ends lower.
    """
    out: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    back: list[int] = []  # nearest earlier candidate with a lower total before
    before = np.cumsum(scores) - scores
    for i in np.flatnonzero(scores > 0).tolist():
        total = float(before[i])
        start, end, low, high = i, i + 1, total, total + float(scores[i])
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j = back[j]
            if j < 0 or out[j][3] >= high:
                out.append((start, end, low, high))
                back.append(j)
                break
            start, low = out[j][0], out[j][2]
            del out[j:], back[j:]
    return [(s, e, h - l) for s, e, l, h in out]


def judged(text: str | None, model: Model, alpha: float = 0.05) -> tuple[float, list[tuple[int, int, float]], float, int]:
    """Evidence, significant segments (start, end in tokens, expected number by chance), best sum, tokens.

    The evidence is the sum over significant segments of minus the log of their expected number.
    """
    words = tokens(text)
    if not words:
        return 0.0, [], 0.0, 0
    found, evidence, best = [], 0.0, 0.0
    for start, end, total in segments(model.of(words)):
        log_e = model.log_scale + math.log(len(words)) - model.rate * total
        best = max(best, total)
        if log_e < math.log(alpha):
            found.append((start, end, math.exp(max(log_e, -700.0))))
            evidence -= log_e
    return evidence, found, best, len(words)


def learn_tokens(rows: DataFrame, prior: float = 0.1, drift: float = 0.1) -> tuple[dict[str, float], float]:
    """Scores of words and beginnings, and the default, from rows (text, y).

    Log-odds of the two labels under a Dirichlet prior of ``prior`` times all counts, spread as they
    occur; what lies within ``LEAST_Z`` standard errors of zero is left at the default, minus ``drift``.
    A text counts once for each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in set(tokens(t)) for f in names(w)}:
                    seen.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), *[pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1)]], names=["w", "c", "t"])

    counts = rows.select("text", "y").mapInArrow(run, "w string, c long, t long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    counts = cut(counts.where(F.col("c") + F.col("t") > 1))
    total = counts.agg(F.sum("c"), F.sum("t")).first()
    n_clean, n_toxic = total[0] or 0, total[1] or 0
    if not n_clean or not n_toxic:
        return {}, -drift
    a0 = prior * (n_clean + n_toxic)
    a = (F.col("c") + F.col("t")) * prior

    def odds(n, of):
        return F.log(n + a) - F.log(of + a0 - n - a)

    scored = counts.withColumn("d", odds(F.col("t"), n_toxic) - odds(F.col("c"), n_clean)).withColumn(
        "z", F.col("d") / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a)))
    kept = scored.where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "w").limit(MODEL_TOKENS).collect()  # a fixed bound
    return {r.w: r.d - drift for r in kept}, -drift


def solve_rate(value: np.ndarray, share: np.ndarray) -> float:
    """Positive lambda at which E[exp(lambda s)] is 1 over scores ``value`` of probability ``share``."""
    def excess(rate: float) -> float:
        return float((share * np.exp(np.minimum(rate * value, 500.0))).sum()) - 1.0

    low, high = 1e-6, 20.0
    if not len(value) or excess(low) >= 0 or excess(high) <= 0:  # no drift downwards, or nothing above zero
        return 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    """Model from the labelled rows of ``docs``; a key labelled twice is toxic if one label says so.

    At most about ``train_docs`` rows of each label, drawn by a hash of the key. Token scores come
    from two thirds of them; the extreme-value scale and the final calibration from the other third.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    share = F.lit(0.0)
    for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect():  # two rows
        share = F.when(F.col("y") == r.y, F.lit(min(1.0, train_docs / r.n))).otherwise(share)
    drawn = own.where(F.pmod(F.xxhash64("k", F.lit("draw")), F.lit(1 << 30)) < share * (1 << 30))
    # at most about two times train_docs keys
    rows = docs.select(F.col(key).alias("k"), whole(text).alias("text")).join(F.broadcast(drawn), "k")
    rows = cut(rows.withColumn("fold", F.pmod(F.xxhash64("k", F.lit("fold")), F.lit(3))))
    scores, default = learn_tokens(rows.where("fold > 0"))
    spread = docs.sparkSession.sparkContext.broadcast(Model(scores, default, 1.0, 0.0, 0.0, 0.0))

    def distribution(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.concatenate([[], *[spread.value.of(tokens(t)) for t in batch.column(0).to_pylist()]])
            s, n = np.unique(np.round(value, 2), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n)], names=["s", "n"])

    # scores are log-odds rounded to hundredths, so the rows are bounded
    seen = rows.where("y = 0").select("text").mapInArrow(distribution, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    value, number = (np.array([getattr(r, c) for r in seen], float) for c in ("s", "n"))
    # one token more of the highest score, as a score that clean texts do not show is rare there, not impossible
    value, number = np.append(value, max(scores.values(), default=0.0)), np.append(number, 1.0)
    rate = solve_rate(value, number / number.sum())
    plain = Model(scores, default, rate, 0.0, 0.0, 0.0)

    def calibration(model: Model) -> list:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [judged(t, shared.value) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array([g[0] for g in got]), pa.array([g[3] * math.exp(-shared.value.rate * g[2]) for g in got])], names=["y", "x", "m"])

        found = rows.where("fold = 0").select("text", "y").mapInArrow(run, "y int, x double, m double")
        # evidence is rounded and cut at 50, so the rows are bounded
        return found.groupBy("y", F.round(F.least("x", F.lit(50.0)), 1).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m")).collect()

    clean = [r for r in calibration(plain) if r.y == 0]
    mass = sum(r.m for r in clean)
    scaled = Model(scores, default, rate, math.log(sum(r.n for r in clean) / mass) if mass > 0 else 0.0, 0.0, 0.0)
    slope, offset = logistic(*(np.array([getattr(r, c) for r in calibration(scaled)], float) for c in ("x", "y", "n")))
    return Model(scores, default, rate, scaled.log_scale, slope, offset)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of weighted points by Newton steps, with a weak pull to slope 0.5."""
    b = np.array([0.5, -1.0])
    if not len(x):
        return 0.5, -1.0
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        slope = design.T @ (n * (y - p)) - 0.1 * (b - [0.5, -1.0])
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        b = b + np.clip(step, -2, 2)
    return max(float(b[0]), 0.0), float(b[1])


def score(docs: DataFrame, model: Model, key: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``key`` columns, ``score`` (0 to 1) and ``passages``: array of (start, end, expected) in code points.

    Every significant passage of the whole text is listed. Null and empty texts have none and the
    score of a text without evidence. Keys may be null or repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_TOKENS entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("expected", pa.float64())]))
        for batch in batches:
            scores, passages = [], []
            for value in batch.column(batch.num_columns - 1):
                t = value.as_py()
                evidence, found, _, _ = judged(t, own)
                z = own.slope * min(evidence, 50.0) + own.offset
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                at = [m.span() for m in LETTERS.finditer(t.lower())] if found else []
                passages.append([{"start": at[s][0], "end": at[e - 1][1], "expected": x} for s, e, x in found])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(passages, kind)], names=[*batch.schema.names[:-1], "score", "passages"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*key).schema]
    return docs.select(*key, whole(text).alias("__text")).mapInArrow(
        run, ", ".join([*kinds, "score double, passages array<struct<start:int,end:int,expected:double>>"]))
