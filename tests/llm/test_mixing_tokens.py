import gc
import weakref
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from diffquarry.llm import mixing, token_store
from diffquarry.llm.common import send

SCHEMA = "doc_id long, text string, source string"


def water(sizes, weights, share, most):
    """The level at which sources stop, found by bisection."""
    lo, hi = 0.0, 1e9
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(min(most * s, w * mid) for s, w in zip(sizes, weights, strict=True)) < share * sum(sizes):
            lo = mid
        else:
            hi = mid
    return [min(most * s, w * lo) for s, w in zip(sizes, weights, strict=True)]


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_water_fill(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    assert mixing.water_fill(sizes, weights, 1.5, 2.0) == pytest.approx(water(sizes, weights, 1.5, 2.0), rel=1e-6, abs=1e-3)


@settings(max_examples=60, deadline=None)
@given(votes=st.lists(st.integers(1, 500), min_size=1, max_size=8), seats=st.integers(0, 60))
def test_sainte_lague_takes_the_highest_quotients(votes, seats):
    got = mixing.sainte_lague([float(v) for v in votes], seats)
    best = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(seats)))[:seats]
    assert got == [sum(i == j for _, j in best) for i in range(len(votes))]


def test_selection_gives_exactly_its_words():
    import random

    for size in (1, 7, 64, 100):
        for words in range(0, 2 * size + 1):
            passes, n, a, b, full, part = mixing._selection(size, words, 8, random.Random(words))
            taken = passes * size
            for i in range(n):
                length, rank = min(8, size - 8 * i), (a * i + b) % max(n, 1)
                taken += length if rank < full else min(part, length) if rank == full else 0
            assert taken == words


def test_mix(spark):
    rows = [(i, "w " * (i % 40), ("a", "b", None)[i % 7 % 3]) for i in range(400)] + [(1, "w " * 1, "b"), (None, "x y z", "a"), (900, None, "b"), (901, "", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("target", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("a", "b", None)}
    want = dict(zip(("a", "b", None), water(list(sizes.values()), [3, 1, 2], 1.5, 2), strict=True))
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]} and own[0].target == pytest.approx(want[s], rel=1e-6)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1.5
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    whole = mixing.copies(docs)
    assert whole.columns == docs.columns and whole.count() > 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sources_smaller_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 1)
    monkeypatch.setattr(mixing, "MOST_IN_BLOCK", 1000)
    monkeypatch.setattr(mixing, "LEAST_IN_SHARD", 700)
    rows = [(i, "w " * 50, "big") for i in range(100)] + [(1000 + i, "w " * 7, "small") for i in range(20)] + [(2000, "one", "tiny"), (2001, "two words", "tiny")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    want = dict(zip(("big", "small", "tiny"), water([5000, 140, 3], [3, 1, 2], 1.5, 2), strict=True))
    for s, target in want.items():
        assert abs(sum(r.taken for r in got if r.source == s) - target) <= 1.5
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert {r.source for r in mixing.copies(docs).collect()} == set(want)


TEXTS = ["Hello world", "", None, "a  b\n\n c", " lead", "trail \n", "it's don't we'll", "x\ty z w", "naïve café — 12,5%!!", "<|endoftext|> ok", "a <|endoftext|> b", "x<|endoftext|>\ny", "a \x1c b", "a\xa0b", "a  b\tc", "ab\ncd\nef.", "\n", " ", "a\n b", "Ünï. \"quoted\", (par) it's.", "é ​ z", "日本語 text。", "a" * 3000, "word " * 3000, "x\0 y"]


def test_pieces_equal_whole_encoding():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_store.vocabulary())
    enc = token_store.Encoder(token_store.vocabulary())
    for t in TEXTS:
        assert np.frombuffer(enc.encode(t or ""), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="ab'sé.,!1 \n\t ́中", max_size=40))
def test_any_text_encodes_alike(text):
    enc = token_store.encoder(token_store.vocabulary())
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_store_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i * 3 % 19 if i < 19 else None, t) for i, t in enumerate(TEXTS)] + [(0, "Hello world")], "doc_id long, text string").withColumn("n", F.lit("clash"))
    token_store.write_store(docs, str(tmp_path / "s"), token_store.vocabulary())
    back = token_store.read_store(spark, str(tmp_path / "s"))
    rows = sorted(back.collect(), key=lambda r: r.start)
    enc, at = token_store.encoder(token_store.vocabulary()), 0
    want = sorted(((-1 if k is None else k, np.frombuffer(enc.encode(t or ""), "<u4").tolist() + [2]) for k, t in docs.select("doc_id", "text").collect()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in rows) == want
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_store.with_crc(back).collect()}
    assert all(crc[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    empty = token_store.store(spark.createDataFrame([], "doc_id long, text string"), token_store.vocabulary())
    assert token_store.with_crc(empty).count() == 0


def test_remembered_pieces_go_when_another_stage_begins(spark):
    """A worker that runs a stage with a model of its own doesn't hold the pieces of an earlier one beside it."""
    path = token_store.vocabulary()
    held = weakref.ref(token_store.encoder(path))
    assert token_store.encoder(path) is held()
    get = send(spark, "a model")
    assert held() is not None and get() == "a model"
    gc.collect()
    assert held() is None
    held = weakref.ref(token_store.encoder(path))
    assert get() == "a model" and token_store.encoder(path) is held()
