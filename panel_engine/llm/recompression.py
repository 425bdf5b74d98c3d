"""Long repeated word sequences by recompression.

Words are level-zero symbols. A round names, over the whole corpus alike, first the runs of equal
neighbours and then pairs: a coin tossed on each name says left or right, and a left one followed by a
right one becomes one symbol. A name is a hash of what it stands for, so equal substrings get equal
interior symbols everywhere, without asking. For every symbol the stretch is kept that its name and
its ends depend on. A window's anchor is the least symbol, of the highest level, whose stretch lies in it;
windows that share it are compared, as ``repeats`` says, and those with several surroundings by
their own hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panel_engine.llm.repeats import Ranges, Records, U, by_document, covered, mixed, numbered, records, runs, squeezed, unsqueezed
from panel_engine.llm.text import cut
from panel_engine.sources.scratch import materialize

WIDTH, ROUNDS = 13, 2


def words_of(text: str) -> list[bytes]:
    return text.encode().split()  # bytes: the six ASCII blanks only


def hashed(words: list[bytes]) -> np.ndarray:
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), U, len(words))


class Level:
    """Symbols in order: name, the words [at, end) they stand for, the stretch [low, high) they depend on."""

    def __init__(self, name, at, end, low, high):
        self.name, self.at, self.end, self.low, self.high = name, at, end, low, high

    def runs(self, doc: np.ndarray) -> Level:
        """Runs of equal neighbours become one symbol; every symbol now depends on both its neighbours."""
        n = len(self.name)
        new = np.flatnonzero(np.append(True, (self.name[1:] != self.name[:-1]) | (doc[self.at[1:]] != doc[self.at[:-1]]))[:n])
        last = np.append(new[1:], n) - 1
        size = (last - new + 1).astype(U)
        name = np.where(size > 1, mixed(self.name[new] ^ mixed(size)), self.name[new])
        low = np.append(-1, self.low[new[1:] - 1]) if n else self.low
        high = np.append(self.high[new[1:]], len(doc) + 1) if n else self.high
        return Level(name, self.at[new], self.end[last], low, high)

    def pairs(self, doc: np.ndarray, salt: int) -> Level:
        """A left symbol before a right one become one; others depend on the neighbour they might have joined."""
        n = len(self.name)
        right = (mixed(self.name ^ U(salt)) >> U(63)).astype(bool)
        joins = np.zeros(n, bool)
        if n:
            joins[:-1] = ~right[:-1] & right[1:] & (doc[self.at[1:]] == doc[self.at[:-1]])
        second = np.append(False, joins[:-1])[:n]
        keep = np.flatnonzero(~second)
        after, before = np.minimum(keep + 1, n - 1), np.maximum(keep - 1, 0)
        joined, rightward = joins[keep], right[keep]
        name = np.where(joined, mixed(self.name[keep] * U(3) + mixed(self.name[after])), self.name[keep])
        end = np.where(joined, self.end[after], self.end[keep])
        low = np.where(rightward & ~joined, np.where(keep > 0, self.low[before], -1), self.low[keep])
        high = np.where(joined, self.high[after], np.where(rightward, self.high[keep], np.where(keep < n - 1, self.high[after], len(doc) + 1)))
        return Level(name, self.at[keep], end, low, high)


def levels(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    place = np.arange(len(words))
    out = [Level(words, place, place + 1, place, place + 1)]
    for r in range(rounds):
        out.append(out[-1].runs(doc).pairs(doc, 0x5851F42D4C957F2D * (r + 1) & 0xFFFFFFFFFFFFFFFF))
    return out


def find(docs: np.ndarray, texts: list[str], width: int = WIDTH) -> Records:
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split])
    words = hashed([w for ws in split for w in ws])
    doc_at = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    whole_windows = np.maximum(sizes - width + 1, 0)
    starts = np.repeat(doc_at - (np.cumsum(whole_windows) - whole_windows), whole_windows) + np.arange(whole_windows.sum())
    anchor, low, high = np.full(len(starts), -1), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    todo = np.arange(len(starts))
    for level_no, level in reversed(list(enumerate(levels(words, doc)))):
        if not len(todo):
            break
        s = starts[todo]
        # stretches advance with the symbols, so those inside a window are neighbours: [first, last)
        first = np.cumsum(np.bincount(np.clip(level.low + 1, 0, len(words) + 1), minlength=len(words) + 2))[s]
        last = np.cumsum(np.bincount(np.clip(level.high, 0, len(words) + 1), minlength=len(words) + 2))[s + width]
        order = mixed(level.name ^ U(level_no + 1))
        best, at = np.full(len(s), ~U(0)), np.full(len(s), -1)
        for j in range(int((last - first).max(initial=0))):
            in_ = first + j < last
            value = order[np.minimum(first + j, len(order) - 1)]
            better = in_ & ((value < best) | (at < 0))
            best[better], at[better] = value[better], (first + j)[better]
        hit = at >= 0
        where, symbol = todo[hit], at[hit]
        anchor[where], low[where], high[where] = level.at[symbol], level.low[symbol], level.high[symbol]
        todo = todo[~hit]
    # a short document before a longer one must not lend its place: owners are those with words
    some = sizes > 0
    return records(anchor, low, high, starts, docs[some], doc_at[some], Ranges(words), width)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept`` (the kept words joined by a blank) of every row.

    Words in a window of ``width`` words that also starts in a row with a smaller key go; windows are
    judged on the input. Null and blank texts have no words. Rows that share a key are one document's
    copies: neither is smaller. A row with a null key loses nothing and takes nothing from others.
    """
    rows = numbered(docs, key, text)
    texts = squeezed(rows)
    found = materialize(runs(rows.where(F.col("doc").isNotNull()), lambda d, t: find(d, t, width)), "runs")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, places, values = [], [], []
            for d, z, asked in zip(*[c.to_pylist() for c in batch.columns]):
                hashes = Ranges(hashed(unsqueezed(z).split()))
                at = np.concatenate([np.arange(r >> 32, (r >> 32) + (r & 0xFFFFFFFF)) for r in asked])
                at = at[at + width < len(hashes.upto)]
                docs_.append(np.full(len(at), d))
                places.append(at)
                values.append(hashes.of(at, at + width))
            if docs_:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(values).view(np.int64)), pa.array(np.concatenate(docs_)), pa.array(np.concatenate(places).astype(np.int32))], names=["h", "doc", "start"])

    asked = by_document(found.where("open"))
    each = cut(texts.join(asked, "doc").select("doc", "z", "runs").mapInArrow(windows, "h long, doc long, start int"))
    least = each.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("h", "least")
    closer = each.join(least, "h").where("doc > least").select("doc", "start", F.lit(1).alias("n"))
    gone = by_document(found.where("not open").select("doc", "start", "n").unionByName(closer))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, removed, kept = [], [], []
            for z, runs_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                w = unsqueezed(z).split()
                n_words.append(len(w))
                if runs_:
                    lost = covered(np.array(runs_), len(w), width)
                    removed.append(int(lost.sum()))
                    w = [x for x, out in zip(w, lost.tolist()) if not out]
                else:
                    removed.append(0)
                kept.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[key, "n_words", "n_removed", "kept"])

    return texts.join(gone, "doc", "left").select(F.col("doc").alias(key), "z", "runs").mapInArrow(
        keep, f"`{key}` long, n_words long, n_removed long, kept string")
