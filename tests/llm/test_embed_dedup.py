"""Near-duplicate vectors against all cosines."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import SF, awkward_dir, union_find

from sparkarray.llm import embed_dedup


def brute(vecs: list, cosine: float = 0.95):
    dim = max((len(v) for v in vecs if v), default=1)
    x = np.zeros((len(vecs), dim))
    ok = np.zeros(len(vecs), bool)
    for k, v in enumerate(vecs):
        if v and all(a is not None and np.isfinite(a) for a in v) and any(v):
            x[k, : len(v)] = v
            ok[k] = True
    u = x / np.where(ok, np.linalg.norm(x, axis=1), 1)[:, None]
    near = (u @ u.T >= cosine) & ok[:, None] & ok[None, :]
    np.fill_diagonal(near, False)
    return near


def expected(ids: list[int], near: np.ndarray) -> list[tuple]:
    find, join = union_find(len(ids))
    for a, b in zip(*np.nonzero(near)):
        join(int(a), int(b))
    least: dict[int, int] = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, int(near[k].sum()), least[find(k)], i == least[find(k)]) for k, i in enumerate(ids))


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_all_pairs(spark, tmp_path, which):
    d = SF if which == "small" else awkward_dir(tmp_path)
    t = pq.read_table(f"{d}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.op10_embed_dedup(spark, d).collect())
    assert got == expected(t["vec_id"], brute(t["embedding"]))


def test_cells_and_blocks(spark, monkeypatch, tmp_path):
    """Many cells and blocks: no false link, and a recall of 0.99 at least."""
    monkeypatch.setattr(embed_dedup, "CELL", 100)
    monkeypatch.setattr(embed_dedup, "BLOCK", 64)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    y = x[:1200] + rng.normal(size=(1200, 64)) * rng.uniform(0.1, 0.38, (1200, 1))
    z = np.repeat(rng.normal(size=(3, 64)), 100, axis=0) + rng.normal(size=(300, 64)) * 0.15
    vecs = np.concatenate([x, y, z]).astype("f4")
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(vecs))), "embedding": pa.array(list(vecs), pa.list_(pa.float32()))}), f"{tmp_path}/e.parquet")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.read.parquet(f"{tmp_path}/e.parquet")).collect()}
    near = brute(vecs.astype("f8").tolist())
    links = near.sum(axis=1)
    found = np.array([got[k].n_links for k in range(len(vecs))])
    assert (found <= links).all()
    assert found.sum() >= 0.99 * links.sum()
    want = {i: c for i, _, c, _ in expected(list(range(len(vecs))), near)}
    whole = [k for k in want if found[k] == links[k]]
    assert len(whole) > 0.98 * len(vecs)
    assert sum(got[k].component_id == want[k] for k in want) >= 0.98 * len(want)
    assert all(got[k].kept == (got[k].component_id == k) for k in want)


def run(spark, path, rows):
    t = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([list(map(float, r[1])) for r in rows], pa.list_(pa.float32()))})
    pq.write_table(t, f"{path}/e.parquet")
    return embed_dedup.near_duplicates(spark.read.parquet(f"{path}/e.parquet")).collect()


def test_ids_that_are_shared_or_null(spark, tmp_path):
    """A class is a vector, whatever its ids: the links of one vector never pass to another with the same id."""
    rng = np.random.default_rng(3)
    a, b, c = (rng.normal(size=16) for _ in range(3))
    near = lambda v: v + rng.normal(size=16) * 0.02
    got = run(spark, tmp_path, [(1, a), (1, b), (2, near(a))])
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    got = run(spark, tmp_path, [(0, a), (None, b), (2, near(a)), (7, c), (None, near(c)), (9, near(c))])
    assert sorted((r.vec_id is not None, r.vec_id or 0, r.n_links, r.component_id is not None, r.component_id or 0, r.kept) for r in got) == [
        (False, 0, 0, False, 0, True), (False, 0, 2, True, 7, False), (True, 0, 1, True, 0, True), (True, 2, 1, True, 0, False), (True, 7, 2, True, 7, True), (True, 9, 2, True, 7, False),
    ]
    got = run(spark, tmp_path, [(None, a), (None, near(a)), (3, b)])
    assert sorted((r.n_links, r.component_id is not None, r.kept) for r in got) == [(0, True, True), (1, False, True), (1, False, True)]


@pytest.mark.parametrize("kind", ["few dimensions", "flat", "clusters", "along the borders"])
def test_recall_on_uneven_vectors(spark, monkeypatch, tmp_path, kind):
    """Vectors and differences that lie along few directions: recall stays 0.99 at least with many cells."""
    monkeypatch.setattr(embed_dedup, "CELL", 60)
    rng = np.random.default_rng(8)
    dim = 6 if kind == "few dimensions" else 48
    scale = np.ones(dim) if kind in ("few dimensions", "clusters") else 0.75 ** np.arange(dim)
    x = rng.normal(size=(1200, dim)) * scale
    if kind == "clusters":
        x = rng.normal(size=(12, dim))[rng.integers(0, 12, 1200)] * 2 + x * 0.7
    step = rng.normal(size=(1200, dim)) * scale
    if kind == "along the borders":
        step = np.roll(x, 7, axis=0) - x
    y = x + step * (rng.uniform(0.05, 0.33, (1200, 1)) * np.linalg.norm(x, axis=1, keepdims=True) / np.linalg.norm(step, axis=1, keepdims=True))
    vecs = np.concatenate([x, y]).astype("f4")
    got = {r.vec_id: r for r in run(spark, tmp_path, list(enumerate(vecs)))}
    links = brute(vecs.astype("f8").tolist()).sum(axis=1)
    found = np.array([got[k].n_links for k in range(len(vecs))])
    assert links.sum() > 500 and (found <= links).all()
    assert found.sum() >= 0.99 * links.sum(), found.sum() / links.sum()


def test_the_exact_margin_loses_nothing(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(embed_dedup, "CELL", 60)
    monkeypatch.setattr(embed_dedup, "DEVIATIONS", 1e9)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 5))
    vecs = np.concatenate([x, x + rng.normal(size=x.shape) * 0.2]).astype("f4")
    got = {r.vec_id: r for r in run(spark, tmp_path, list(enumerate(vecs)))}
    assert [got[k].n_links for k in range(len(vecs))] == brute(vecs.astype("f8").tolist()).sum(axis=1).tolist()
