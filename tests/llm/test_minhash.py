"""Near-duplicates against all pairs; signatures against the similarity they stand for."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from brute import SF, awkward_dir, jaccard, near_groups, prose, shingle_counts

from sparkarray.llm import minhash


def compared(spark, docs: list[tuple], got) -> None:
    """docs: doc_id, text, unique ids."""
    want = near_groups([t for _, t in docs])
    least: dict[int, int] = {}
    first: dict[str, int] = {}
    for (d, t), g in zip(docs, want):
        least[g] = min(d, least.get(g, d))
        first[t or ""] = min(d, first.get(t or "", d))
    expected = {d: (first[t or ""], least[g], d == least[g]) for (d, t), g in zip(docs, want)}
    assert {r.doc_id: (r.class_id, r.component_id, r.kept) for r in got} == expected


def test_small(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    compared(spark, list(zip(t["doc_id"], t["text"])), minhash.op5_minhash(spark, SF).collect())


def chain(rng) -> list[str]:
    """Texts of which each is near the next only, and groups around them."""
    w = prose(rng, 300).split()
    out = [" ".join(w)]
    for k in range(6):
        w = w.copy()
        for i in range(4):
            w[40 * k + 9 * i] = f"new{k}-{i}"
        out.append(" ".join(w))
    return out


def test_chains_and_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = np.random.default_rng(6)
    texts = chain(rng) + chain(rng)
    base = prose(rng, 120).split()
    for k in range(25):
        w = base.copy()
        w[int(rng.integers(0, 119))] = f"odd{k}"
        texts.append(" ".join(w))
    texts += [texts[3]] * 4 + ["", None, "\n ", "one two three", "one two three", "one  two three", "spam " * 500, "spam " * 520, "spam " * 900]
    docs = list(enumerate(texts, 100))
    got = minhash.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    compared(spark, docs, got)


def test_keep_one(spark, tmp_path):
    d = awkward_dir(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in docs.collect()]
    text = docs.columns.index("text")
    groups = near_groups([r[text] for r in rows])
    best: dict[int, tuple] = {}
    for r, g in zip(rows, groups):
        key = (r[0] is None, r[0] or 0)
        if g not in best or key < best[g]:
            best[g] = key
    got = [tuple(r) for r in kept.collect()]
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted(best.values())
    assert all(r in rows for r in got)


def test_signatures_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(9)
    for change in (3, 12, 40):
        a = prose(rng, 400).split()
        b = a.copy()
        for i in rng.choice(400, change, replace=False):
            b[i] = f"x{i}"
        a, b = " ".join(a + ["again and again"] * 20), " ".join(b + ["again and again"] * 30)
        doc, unit = minhash.units(*minhash.shingles(pa.array([a, b])))
        s = minhash.signatures(doc, unit, 2, k=4096, darts=32768)
        agree = ((s[0] == s[1]) & (s[0] > 0)).sum() / ((s[0] > 0) | (s[1] > 0)).sum()
        assert abs(agree - jaccard(shingle_counts(a), shingle_counts(b))) < 0.04


def test_recall_by_similarity(spark):
    """Pairs in bands of similarity: all that reach the threshold are found, none below it."""
    rng = np.random.default_rng(17)
    texts, bands = [], []
    for k in range(150):
        a = [f"p{k}-{x}" for x in rng.integers(0, 10**6, int(rng.integers(60, 400)))]
        b = a.copy()
        for at in rng.choice(len(a), int(rng.integers(1, max(2, len(a) // 25))), replace=False):
            b[at] = f"x{at}"
        texts += [" ".join(a), " ".join(b)]
        bands.append(jaccard(shingle_counts(texts[-2]), shingle_counts(texts[-1])))
    got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = [got[2 * k] == got[2 * k + 1] for k in range(150)]
    for lo, hi in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        own = [f for f, s in zip(found, bands) if lo <= s < hi]
        assert len(own) >= 10 and all(own), (lo, sum(own), len(own))
    assert not any(f for f, s in zip(found, bands) if s < 0.8)
