"""Exact substring removal against counting all 200-byte strings."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import SF, awkward_dir, prose, repeated_bytes

from sparkarray.llm import suffix_dedup


def held(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = sorted((d is not None, d or 0, *r) for d, r in zip(docs["doc_id"], repeated_bytes(docs["text"])))
    got = suffix_dedup.op2_suffix_dedup(spark, sf_dir).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_small(spark):
    held(spark, SF)


def test_awkward(spark, tmp_path):
    held(spark, awkward_dir(tmp_path))


def against(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == [(k, *r) for k, r in enumerate(repeated_bytes(texts))]


def planted() -> list[str]:
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    passage, long = letters(260), letters(900)
    out = [letters(300) + passage + letters(250), passage, letters(100) + passage[:200] + letters(10), letters(90) + passage[:199] + letters(90)]
    out += [long + letters(40) + long, letters(30) + long[100:700] + letters(30) + long[650:], long[:450] + "#" + long[451:]]
    out += ["ab" * 400, "ab" * 99 + "a", "ab" * 100, "ab" * 100 + "c", "z" * 199, "z" * 200, "z" * 201, "z" * 1000]
    out += [("é" * 150), "x" + "é" * 99 + "y", "é" * 100 + "中" * 100, "中" * 67]
    out += [prose(rng, 400), "", None, prose(rng, 30)]
    out += [letters(7) + (p := prose(rng, 80)) + letters(9), p + letters(3), letters(1) + p]
    return out


def test_planted(spark):
    against(spark, planted())


def test_periodic_texts_that_differ_in_the_middle(spark):
    """A repeated line keeps one name over thousands of bytes; what differs far from both ends of it counts."""
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    texts = []
    for period in (40, 61, 137, 200):
        line = letters(period - 1) + "\n"
        for at in (1500, 1503, 1700):
            text = line * (3000 // period)
            texts.append(text[:at] + "#" + text[at + 1 :])
        texts.append(letters(period) * 6)
    texts += [t + "tail" for t in ("-" * 900 + "+" + "-" * 900, "-" * 901 + "+" + "-" * 899, "-" * 900 + "*" + "-" * 900)]
    against(spark, texts)


def test_a_shared_and_a_different_middle(spark):
    """A long ruled text around a word that all have and one that differs: the latter stays."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 20))
    for _ in range(3):
        shared = word()
        against(spark, [")" * 100 + shared + ")" * 100 + shared + ")" * 100 + own + ")" * 100 + shared + ")" * 100 + shared + ")" * 100 for own in (word(), word())])


@pytest.mark.parametrize("seed", range(4))
def test_ruled_and_periodic_texts(spark, seed):
    """Rules, padding, tables and repeated lines with odd bytes in them, cut and joined at random."""
    rng = np.random.default_rng(100 + seed)
    pick = lambda x: x[int(rng.integers(0, len(x)))]
    parts = ["-" * 80 + "\n", "| a | b |\n", " " * 150, "=" * 37, "ab" * 70, "x", "é" * 40, "line of text\n" * 9, "".join(chr(97 + x) for x in rng.integers(0, 26, 90)), "0" * 210]
    texts = ["".join(pick(parts) for _ in range(int(rng.integers(4, 40)))) for _ in range(25)]
    texts += [t[: int(rng.integers(1, len(t)))] + "!" + t[int(rng.integers(0, len(t))) :] for t in texts]
    against(spark, texts)


@pytest.mark.parametrize("period, seed", [(40, 1), (61, 4), (100, 3)])
def test_runs_have_one_hash_for_one_text_only(period, seed):
    """Two texts of which a byte differs: a run's name, hash and length tell all its bytes."""
    line = bytes(np.random.default_rng(seed).integers(97, 123, period, dtype="u1"))
    seen: dict[tuple[int, int], bytes] = {}
    for at in range(1300, 1300 + 3 * period, 7):
        for c in b"#", b"*":
            text = line * (3000 // period)
            text = text[:at] + c + text[at + 1 :]
            start, count, name, whole, _ = suffix_dedup.runs(np.frombuffer(text, "u1"), np.array([len(text)]))
            for s, k, v, t in zip(start.tolist(), count.tolist(), name.tolist(), whole.tolist()):
                own = text[s : s + k + suffix_dedup.LENGTH - 1]
                assert seen.setdefault((v, t), own) == own


def test_names_with_many_runs(spark, monkeypatch):
    """A short passage in hundreds of texts: its names have a run of their own in each, and are divided."""
    monkeypatch.setattr(suffix_dedup, "MANY", 8)
    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 3000)
    rng = np.random.default_rng(8)
    common, other = prose(rng, 30), prose(rng, 45)
    texts = [prose(rng, int(rng.integers(5, 60))) + " " + (common if k % 2 else other) + " " + prose(rng, int(rng.integers(5, 60))) for k in range(60)]
    texts += [texts[0][:400], texts[1][:400], *planted()]
    against(spark, texts)


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_merge_of_transforms(shards):
    """The interleaved transforms give the repeats of a plain count."""
    rng = np.random.default_rng(shards)
    pieces = [bytes(rng.integers(0, 2, int(rng.integers(200, 420)), dtype="u1") + 97) for _ in range(30)]
    pieces += [pieces[3], pieces[4][20:], b"a" * 230, pieces[5][:100] + pieces[6][:150]]
    n = np.array([len(p) for p in pieces])
    ends = np.cumsum(n)
    text = np.frombuffer(b"".join(pieces), "u1")
    starts = np.concatenate([np.arange(e - k, e - 199) for e, k in zip(ends, n)])
    strings: dict[bytes, list[int]] = {}
    for s in starts:
        strings.setdefault(text[s : s + 200].tobytes(), []).append(int(s))
    want = sorted(s for g in strings.values() if len(g) > 1 for s in g)
    at, block = suffix_dedup.merge_repeats(text, np.repeat(ends, n), starts, shards)
    assert sorted(at.tolist()) == want
    groups = {}
    for a, b in zip(at.tolist(), block.tolist()):
        groups.setdefault(b, []).append(a)
    assert sorted(sorted(g) for g in groups.values()) == sorted(g for g in strings.values() if len(g) > 1)
