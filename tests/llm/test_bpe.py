from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from panel_engine.llm import bpe
from panel_engine.llm.queries import op4
from tests.llm.cases import LOREM, awkward, empty

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(rnd, n):
    return "".join(rnd.choice(["a", "Z", " ", "  ", "\n", "1", "'s", "'ll", "é", "世", "\U0001f600", "<|endoftext|>", "word ", "…", "\u0000", "​"]) for _ in range(n))


def test_merge_equals_library(ranks, library):
    rnd = random.Random(5)
    own = bpe.Encoder(ranks, PATTERN)
    for text in ["", LOREM, "a" * 3000, " " * 700, "ab" * 900, *[noise(rnd, rnd.randint(1, 300)) for _ in range(60)]]:
        assert own.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("chunk,overlap", [(40, 12), (64, 32)])
def test_chunked_texts(spark, ranks, library, chunk, overlap):
    rnd = random.Random(chunk)
    texts = [noise(rnd, rnd.randint(1, 400)) for _ in range(25)] + ["b" * 500, " " * 400 + "x", "it's " * 100, "'s" * 200, LOREM * 5, ("y" * 90 + " ok ") * 6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = bpe.decode(bpe.encode(docs, ranks, PATTERN, chunk=chunk, overlap=overlap), ranks).collect()
    assert len(coded) == len(texts)
    for r in coded:
        assert r.ids == library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.data).decode() == texts[r.doc_id]
    parts = bpe.pieces(docs, PATTERN, chunk=chunk, overlap=overlap).where("doc_id = 27").count()
    assert parts > 5  # ordinary texts are cut


def test_a_long_run_joins_only_the_chunks_it_covers(spark, ranks, library):
    body = LOREM * 40
    texts = [body[:990] + " " * 150 + body[:3000], body[:1950] + "z" * 2300 + body, "".join(body[:880] + " " * 160 for _ in range(6)), body]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.pieces(docs, PATTERN, chunk=1000, overlap=100).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.part, r.piece) for r in rows if r.doc_id == i)
        assert "".join(p for _, p in mine) == t
        assert [x for _, p in mine for x in library.encode_ordinary(p)] == library.encode_ordinary(t)
    sizes = [max(len(r.piece) for r in rows if r.doc_id == i) for i in range(len(texts))]
    assert sizes[0] <= 2200 and sizes[1] <= 4200 and sizes[3] <= 1100
    assert sum(r.doc_id == 0 for r in rows) == 4


def test_awkward_rows(spark, ranks, library):
    docs = awkward(spark).selectExpr("*", "array(1) as ids", "'x' as data", "'y' as __k")
    coded = bpe.decode(bpe.encode(docs, ranks, PATTERN, chunk=1000, overlap=100), ranks)
    rows = coded.collect()
    assert len(rows) == docs.count() and sorted(coded.columns) == sorted(docs.columns)
    assert all(r.ids == library.encode_ordinary(r.text or "") for r in rows)
    assert bpe.encode(empty(spark), ranks, PATTERN).count() == 0


def test_query_equals_library(spark, library, tmp_path):
    docs = awkward(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op4(spark, str(tmp_path)).collect():
        text = [d.text for d in docs.collect() if d.doc_id == r.doc_id][0] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
