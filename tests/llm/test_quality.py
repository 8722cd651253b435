"""Quality rules: base counts read off the text, outliers planted in clean groups. The verdicts are held against SQL in test_sql."""

import numpy as np
import pyarrow.parquet as pq
import re
from brute import SF, awkward_dir, prose, words

from sparkarray.llm import quality


def base(text):
    w = words(text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p for g in at.values() if len(g) > 1 for i in g for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark, tmp_path):
    for d in (SF, awkward_dir(tmp_path)):
        t = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
        want = sorted((i is not None, i or 0, *base(x)) for i, x in zip(t["doc_id"], t["text"]))
        got = quality.op4_quality(spark, d).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert not any(r.kept for r in got if r.base_failed)


def planted(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(240):
        text = prose(rng, int(rng.integers(60, 200)))
        rows.append((k, text, ("en", "de")[k % 2], f"s{k % 2}", k % 20 != 7))
    for k in range(240):
        if not rows[k][4]:
            text = rows[k][1]
            text = " ".join("#|" + w for w in text.split()) if k % 40 == 7 else " ".join(w + "longer" * 30 for w in text.split())
            rows[k] = (k, text, *rows[k][2:])
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, clean boolean")


def test_outliers_go_and_clean_texts_stay(spark):
    rows, docs = planted(spark)
    got = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert got == {r[0]: r[4] for r in rows}


def test_keep_good(spark, tmp_path):
    rows, docs = planted(spark)
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == [r[0] for r in rows if r[4]]
    docs = spark.read.parquet(f"{awkward_dir(tmp_path)}/documents.parquet")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    own = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in kept.collect()]
    text = docs.columns.index("text")
    assert got and all(r in own and not base(r[text])[5] for r in got)
    assert sum(r[0] == 8 for r in got) == 3  # repeated rows stay, each


def independent_mcd(x: np.ndarray, share: float = 0.75, starts: int = 300, seed: int = 0):
    """Plain minimum covariance determinant with reweighting: random subsets of five, steps until nothing changes."""
    rng = np.random.default_rng(seed)
    floor = np.diag((np.array(quality.FLOOR) * quality.UNIT) ** 2)
    estimate = lambda y: (y.mean(axis=0), np.cov(y, rowvar=False, bias=True) + floor)
    far = lambda c, s: np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(s), x - c)
    best = None
    for _ in range(starts):
        c, s = estimate(x[rng.choice(len(x), 5, replace=False)])
        last = np.inf
        while True:
            c, s = estimate(x[np.argsort(far(c, s))[: int(np.ceil(share * len(x)))]])
            det = np.linalg.det(s)
            if det >= last * (1 - 1e-12):
                break
            last = det
        if best is None or last < best[0]:
            best = (last, c, s)
    c, s = estimate(x[far(*best[1:]) <= quality.NEAR])
    return c, s, far(c, s)


def test_fit_against_an_independent_estimate(spark):
    """Clusters of outliers of up to a fifth of a group: centre, covariance and verdicts are those of a plain search."""
    rng = np.random.default_rng(12)
    shape = np.array([[60.0, 0, 0, 0], [20, 80, 0, 0], [0, 30, 150, 0], [10, 0, 40, 120]])
    rows, parts = [], {}
    for g, (n, bad) in enumerate([(400, 0.0), (400, 0.1), (600, 0.2), (300, 0.2), (200, 0.05)]):
        clean = rng.normal(size=(n, 4)) @ shape.T + (1600, 200, 300, 250)
        k = int(n * bad)
        clean[:k] = rng.normal(size=(k, 4)) * 15 + np.array((1600, 200, 300, 250)) + np.array((700, 900, -600, 1100))[rng.permutation(4)]
        x = np.rint(clean).astype("i8")
        parts[f"s{g}"] = (x, k)
        rows += [(f"l{g}", f"s{g}", int(len(rows) + i), *map(int, v)) for i, v in enumerate(x)]
    stats = spark.createDataFrame(rows, "lang string, source string, seed long, x1 long, x2 long, x3 long, x4 long")
    got = {r.source: r for r in quality.fit(stats)[0].filter("source is not null").collect()}
    for name, (x, k) in parts.items():
        c, s, d2 = independent_mcd(x.astype("f8"))
        r = got[name]
        low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        mine = np.array([r[f"m{i}"] for i in range(1, 5)])
        scale = np.sqrt(np.diag(s))
        assert (np.abs(mine - c) <= 0.1 * scale).all(), name
        assert (np.abs(low @ low.T - s) <= 0.15 * np.outer(scale, scale)).all(), name
        z = np.linalg.solve(low, (x - mine).T)
        gone = (z * z).sum(axis=0) > quality.CUTOFF
        assert gone[:k].all() and not gone[k:].any() and (gone == (d2 > quality.CUTOFF)).all(), name


def test_repeated_lines_alone_and_few_of_them(spark):
    """Mostly repeated lines that pass the base rules go; short clean texts with a repeated line stay."""
    rng = np.random.default_rng(5)
    rows = [(k, prose(rng, int(rng.integers(60, 150))), "en", "s") for k in range(200)]
    # Nine of ten lines are one of two short ones, a fifth of the words is repeated with them.
    long = [prose(rng, 60) for _ in range(6)]
    rows.append((300, "\n".join([*long, *["ab cd ef", "gh ij"] * 30]), "en", "s"))
    rows.append((301, "\n".join([prose(rng, 30), "a closing line", *[prose(rng, 9) for _ in range(4)], "a closing line"]), "en", "s"))
    rows.append((302, "\n".join(["head", *[prose(rng, 20) for _ in range(4)], "head"]), "en", "s"))
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[300].base_failed and not got[300].kept
    assert got[301].kept and got[302].kept and all(got[k].kept for k in range(200))
