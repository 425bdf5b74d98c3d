from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from panel_engine.llm import packing, queries
from tests.llm.cases import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_ids(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def brute_sum_of_squares(lengths, size):
    """Tries every place for every piece and adds all squares anew."""
    gaps, where = [], []
    for n in lengths:
        choices = []
        for b, gap in [*{g: (b, g) for b, g in reversed(list(enumerate(gaps))) if g >= n}.values(), (len(gaps), size)]:
            after = [*gaps, size] if b == len(gaps) else list(gaps)
            after[b] = gap - n
            squares = sum(after.count(g) ** 2 for g in set(after) if g)
            choices.append((squares, b == len(gaps), gap, b))
        best = min(choices)
        where.append(best[:3])
        if best[1]:
            gaps.append(size)
        # any bin of that gap: the gaps left are the same
        gaps[best[3]] = best[2] - n
    return sorted(gaps)


def check(rows, texts, size):
    """``texts``: list of (key, text); rows of the same key are told apart by nothing, so they must be alike."""
    ids = defaultdict(list)
    for key, text in texts:
        ids[key].append(brute_ids(text))
    by_key, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_key[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_key) == set(ids)
    for key, many in ids.items():
        want = sorted((k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
                      for one in many for k, at in enumerate(range(0, len(one), size)) for part in [one[at:at + size]])
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_key[key]) == want
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
    return len(by_sequence)


def test_each_piece_goes_where_the_squares_become_least():
    rnd = random.Random(3)
    for _ in range(60):
        size = rnd.choice([7, 12, 30])
        lengths = [rnd.randint(1, size - 1) for _ in range(rnd.randint(0, 40))]
        bins, offsets, gaps = packing.sum_of_squares(lengths, size)
        assert sorted(gaps.tolist()) == brute_sum_of_squares(lengths, size)
        filled = defaultdict(int)
        for n, b, at in zip(lengths, bins, offsets):
            assert filled[b] == at
            filled[b] += n
        assert all(size - filled[b] == g for b, g in enumerate(gaps.tolist()))


def test_rounds_fill_what_shards_leave_open(spark):
    rnd = random.Random(5)
    lengths = [(i, min(2048, int(rnd.lognormvariate(5.8, 1.0)) + 1)) for i in range(20000)]
    df = spark.createDataFrame(lengths, "row long, length long").repartition(6)
    placed = packing.place(df, shard_pieces=1500).join(df, "row").collect()
    assert sorted((r.row, r.length) for r in placed) == lengths
    bins = defaultdict(list)
    for r in placed:
        bins[r.sequence_id].append(r)
    for held in bins.values():
        assert sum(r.length for r in held) <= 2048
    least = -(-sum(n for _, n in lengths) // 2048)
    assert len(bins) <= 1.005 * least + 1


def test_pieces_that_fit_nowhere_end_the_rounds(spark):
    df = spark.createDataFrame([(i, 1500) for i in range(4000)], "row long, length long")
    placed = packing.place(df, shard_pieces=500)
    assert placed.select("sequence_id").distinct().count() == placed.count() == 4000


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 as row", "2 as length", "3 as ids", "4 as `offset`")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    packed = packing.pack(docs, PATH, size=64, shard_pieces=8)
    rows = packed.collect()
    check(rows, texts, 64)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert packing.pack(empty(spark), PATH).count() == 0


def test_words_apart_are_the_text_whole(spark):
    texts = ["It's the DOG's day\x0b\x1c\x85x", "á e ́  wide", "<|endoftext|> is text", "1234 ½ ǅ ΑΣ Σ ß İ", "x" * 700, "\u0000 ​'ll 'S", "| a|b || c|", ""]
    coded = packing.WordEncoder(PATH).packed([t.encode() for t in texts])
    for text, got in zip(texts, coded):
        assert np.frombuffer(got, "<u4").tolist() == brute_ids(text)[:-1]
    alone = packing.WordEncoder(PATH)
    alone.mark = np.array([1, 2], "<u4")  # as if the mark were no token of its own
    assert alone.packed([t.encode() for t in texts]) == coded


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = queries.op11(spark, path).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    used = check(rows, texts, 2048)
    assert used <= 1.01 * sum(r.length for r in rows) / 2048 + 1
