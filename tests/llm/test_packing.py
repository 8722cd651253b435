"""Packing: every id in one piece, full sequences, the ids of the tokenizer itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import SF, awkward_dir
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkarray.llm import packing


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(tok, text) -> np.ndarray:
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")


def held(spark, tok, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = packing.op9_packing(spark, sf_dir).collect()
    by_place = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    place = 0
    for r in by_place:
        assert r.sequence_id * packing.WINDOW + r.offset == place and r.length > 0
        place += r.length
        assert r.offset + r.length <= packing.WINDOW
    want = Counter()
    for d, x in zip(t["doc_id"], t["text"]):
        want[d, ids_of(tok, x).tobytes()] += 1
    assert place == sum(len(x) // 4 * n for (_, x), n in want.items())
    # Pieces of one document follow each other in the stream, so they can be told apart even if ids repeat.
    found, open_ = Counter(), defaultdict(list)
    for r in by_place:
        open_[r.doc_id].append(r)
        if r.start + r.length == r.doc_tokens:
            found[r.doc_id, tuple((p.start, p.length, p.ids_crc32) for p in open_.pop(r.doc_id))] += 1
    assert not open_
    for (d, pieces), n in found.items():
        whole = [x for (e, x), _ in want.items() if e == d and len(x) // 4 == sum(m for _, m, _ in pieces) and all(zlib.crc32(x[4 * s : 4 * (s + m)]) == c for s, m, c in pieces)]
        assert whole
        want[d, whole[0]] -= n
    assert not any(want.values())


def test_small(spark, tok):
    held(spark, tok, SF)


def test_awkward(spark, tok, tmp_path):
    held(spark, tok, awkward_dir(tmp_path))


def test_sequences(spark, tok):
    texts = ["one two", "three " * 50, "", None, "four"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = packing.pack_sequences(docs, window=16).orderBy("sequence_id").collect()
    stream = np.concatenate([ids_of(tok, t) for t in texts])
    assert [x for r in got for x in r.input_ids] == stream.tolist()
    assert [r.n_tokens for r in got] == [16] * (len(stream) // 16) + [len(stream) % 16] * (len(stream) % 16 > 0)


def test_sequences_of_many_partitions(spark, tok):
    """Windows inside a partition are done there; those that borders cut meet their other parts, short partitions included."""
    rng = np.random.default_rng(2)
    texts = [" ".join(["word"] * int(n)) for n in rng.choice([0, 1, 3, 30, 200], 120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    for window in (8, 64, 5000):
        got = packing.pack_sequences(docs, window=window).orderBy("sequence_id").collect()
        total = sum(len(ids_of(tok, t)) for t in texts)
        assert [r.sequence_id for r in got] == list(range(-(-total // window)))
        assert [r.n_tokens for r in got] == [len(r.input_ids) for r in got] == [window] * (total // window) + [total % window] * (total % window > 0)
        stream = [x for r in got for x in r.input_ids]
        ends = [k for k, x in enumerate(stream) if x == packing.END_ID]
        assert sorted(stream[a + 1 : b + 1] for a, b in zip([-1, *ends], ends)) == sorted(ids_of(tok, t).tolist() for t in texts)
        starts = [r.sequence_id * window + s for r in got for s in r.doc_starts]
        assert starts == sorted({0, *(e + 1 for e in ends[:-1]), *range(0, total, window)})


def test_a_tokenizer_of_another_kind_is_given_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = f"{tmp_path}/t.json"
    tok = Tokenizer(models.WordLevel({"[UNK]": 0, "one": 1, "Two": 2, " ": 3, ",": 4}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Split(" ", "isolated")
    tok.save(path)
    assert packing.takes_pieces(packing.default_tokenizer()) and not packing.takes_pieces(path)
    texts = ["one Two  one", None, "two,", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(path, pa.array(texts))] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


LETTERS = "abcXYZ 0159.,-'\"!?@#_\n\t\r\x0b\x1c éßÀİıǅμ中文한ё́​﻿\U0001f600<>|/s[]INSTpadukmask"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(LETTERS, max_size=40), st.text(max_size=20)), min_size=1, max_size=6))
def test_ids_are_the_tokenizers(texts):
    from tokenizers import Tokenizer

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(packing.default_tokenizer(), pa.array(texts, pa.string()))]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
