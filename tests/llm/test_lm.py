"""Language model: counted figures exactly, probabilities that sum to one, held-out texts better than by word counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from brute import SF, awkward_dir

from sparkarray.llm import lm

LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def counted(docs):
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "\n"] for _, t in docs]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, _ in docs]
    c = Counter(x for t, h in zip(toks, held) if not h for x in t)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t) for t in toks]
    return [(d, h, len(t), sum(c[x] > 0 for x in t), n, b) for (d, _), h, t, b in zip(docs, held, toks, base)]


def check(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = sorted(counted(list(zip(t["doc_id"], t["text"]))), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
    got = sorted(lm.op3_lm(spark, sf_dir).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score))
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [r[:5] for r in want]
    assert np.allclose([r.base_score for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    return got


def test_small(spark):
    got = check(spark, SF)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_awkward(spark, tmp_path):
    check(spark, awkward_dir(tmp_path))


def test_held_out_only(spark):
    ids = [d for d in range(200) if zlib.crc32(str(d).encode()) % 5 == 1][:6]
    docs = spark.createDataFrame([(d, "some words here") for d in ids], "doc_id long, text string")
    got = lm.score_documents(docs).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in got) and len(got) == 6


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    counts = np.sort(rng.integers(1, 1000, 60))[::-1]
    m = rng.integers(0, 30, (lm.KINDS, 60)).astype("f8")
    cls = lm.classes(m, counts)
    inner = 10.0 ** lm.within(m, cls, counts)
    for c in np.unique(cls):
        assert np.allclose(inner[:, cls == c].sum(axis=1), 1, atol=1e-4)
    w = rng.normal(size=(lm.CLASSES, sum(lm.ROWS))).astype("f4")
    rows = lm.features(rng.integers(0, 1000, 500), rng.integers(0, 1000, 500))
    assert np.allclose(lm.softmax(w, np.zeros(lm.CLASSES, "f4"), rows).sum(axis=0), 1, atol=1e-4)


def test_sums_of_tasks_do_not_depend_on_how_they_are_grouped(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(s), int(k), 1, rng.integers(0, 9, 5).astype("f8").tobytes()) for s in range(12) for k in rng.choice(8, 4, replace=False)]
    df = spark.createDataFrame(rows, lm.SUMS).repartition(9)
    got = lm.summed(df, "f8", 3)
    want = {}
    for _, k, _, d in rows:
        want[k] = want.get(k, 0) + np.frombuffer(d, "f8")
    assert {k: x.tolist() for k, x in zip(got["name"].to_pylist(), lm.numbers(got, "f8"))} == {k: x.tolist() for k, x in want.items()}
    assert sum(got["n"].to_pylist()) == len(rows)


def test_histories_stay_in_their_text():
    ids, doc = np.array([3, 4, 0, 5, 0]), np.array([0, 0, 0, 1, 1])
    one, two, _ = lm.history(ids, doc, None)
    assert one.tolist() == [0, 3, 4, 0, 5] and two.tolist() == [0, 0, 3, 0, 0]


def test_commonest_words(spark):
    rng = np.random.default_rng(2)
    rows = [(f"w{k}", int(c)) for k, c in enumerate(np.concatenate([rng.integers(1, 6, 300), rng.integers(200, 100_000, 60)]))]
    counts = spark.createDataFrame(rows, "word string, c long")
    for most in (0, 5, 40, 100, 200, 1000):
        got = list(zip(*(lm.commonest(counts, most)[c].to_pylist() for c in ("word", "c"))))
        want = sorted(rows, key=lambda r: (-r[1], r[0]))
        assert got == want[: len(got)] and len(got) <= most
        if most >= len(rows):
            assert len(got) == len(rows)
        elif got:
            assert got[-1][1] > want[len(got)][1] or len(got) == most


def test_scores_are_those_of_the_model(monkeypatch):
    """For fixed weights, token by token: class softmax over hashed features, then the word in its class."""
    import math
    import re
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    head, n = 30, len(words) + 1
    counts = np.concatenate([[9], rng.integers(1, 50, len(words))]).astype("i8")
    cls = np.concatenate([[0], rng.integers(1, lm.CLASSES - 1, head - 1)])
    w, bias = rng.normal(size=(lm.CLASSES, sum(lm.ROWS))).astype("f4") * 0.3, rng.normal(size=lm.CLASSES).astype("f4")
    inner = -rng.random((lm.KINDS, head)).astype("f4")
    totals = {"base": 4000.0, "tail": 700.0}
    texts = ["w1 W2  w59\tw40 zz\nw3 w1", "", None, "unknown Words w0 w0 w0 w31", "w5 " * 40, " \r\n"]
    box = lambda x: SimpleNamespace(value=x)
    run = lm._score(box(lm.Vocabulary(words, counts)), cls, box((w, bias, inner)), totals)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts)], ["doc_id", "held_out", "text"])
    got = [r for b in run(iter([batch])) for r in b.to_pylist()]
    ids = {x: k + 1 for k, x in enumerate(words)}
    for text, r in zip(texts, got):
        found = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        score, base, rare = 0.0, 0.0, {}
        before = [0, 0]
        for token in [*found, None]:
            own = 0 if token is None else ids.get(token)
            one, two = before
            kind = one if one < lm.KINDS // 2 else lm.KINDS // 2 + one % (lm.KINDS // 2)
            a, b = one * 0x9E3779B1 % 0xFFFFFFFB, two * 0x85EBCA6B % 0xFFFFFFFB
            rows = [a % lm.ROWS[0], lm.ROWS[0] + b % lm.ROWS[1], lm.ROWS[0] + lm.ROWS[1] + (a * 31 + b) % 0xFFFFFFFB % lm.ROWS[2]]
            z = bias.astype("f8") + sum(w[:, k].astype("f8") for k in rows)
            p = np.exp(z - z.max())
            p /= p.sum()
            y = cls[own] if own is not None and own < head else lm.CLASSES - 1
            score += math.log10(p[y])
            if own is None:
                rare[token] = rare.get(token, 0) + 1
            else:
                base += math.log10((counts[own] + 0.5) / totals["base"])
                score += inner[kind, own] if own < head else math.log10((counts[own] if counts[own] > 1 else 0.5) / totals["tail"])
            at = own
            if own is None:
                last = token.encode()[-2:]
                at = lm.LOOKUP + 1 + (last[-1] * 31 + last[0]) % lm.SUFFIXES
            before = [at, one]
        assert abs(r["score"] - score) < 1e-3 and abs(r["base"] - base) < 1e-9 and r["n_tokens"] == len(found) + 1
        assert dict(zip(r["words"], r["counts"])) == rare
    assert n == 61
