"""The pipeline against brute-force versions of its stages, one after the other."""

import hashlib
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import SF, awkward_dir, mixed_copies, near_groups
from test_pii import redacted
from test_quality import base

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

from sparkarray.llm import mixing, packing, quality  # noqa: E402


def vector(text):
    n, chars, symbols, dup, repeat, _ = base(text)
    lines = sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in (text or "").split("\n"))
    x = (np.log(max(chars, 1) / max(n, 1)), np.sqrt(symbols / max(chars, 1)), np.sqrt(dup / max(lines, 1)), np.sqrt(repeat / max(n, 1)))
    return [int(np.floor(quality.UNIT * v + 0.5)) for v in x]


def fitted(x: np.ndarray):
    """Centre, Cholesky factor and determinant of the documents chosen."""
    m = x.mean(axis=0)
    c = x.T @ x / len(x) - np.outer(m, m) + np.diag((np.array(quality.FLOOR) * quality.UNIT) ** 2)
    low = np.linalg.cholesky(c)
    return m, low, np.prod(np.diag(low))


def far(x, p):
    return (np.linalg.solve(p[1], (x - p[0]).T) ** 2).sum(axis=0)


def nearer(x, p):
    """From the share of the documents that is nearest by bins of the distance."""
    q = np.floor(np.minimum(far(x, p), 1e9) * 64).astype(int)
    bins = np.array([v if v < 16 else v.bit_length() * 16 + (v >> (v.bit_length() - 5) & 15) for v in q.tolist()])
    cut = next(b for b in sorted(set(bins.tolist())) if (bins <= b).sum() >= len(x) * quality.SHARE)
    return fitted(x[bins <= cut])


def good(rows):
    """rows: doc_id, text, lang, source. Whether the quality stage keeps each."""
    failed = np.array([base(r[1])[5] for r in rows])
    x = np.array([vector(r[1]) for r in rows], "f8")
    seed = np.array([int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16) for r in rows])
    member = defaultdict(list)
    for k, (_, _, lang, source) in enumerate(rows):
        if not failed[k]:
            member[lang or "", source or ""].append(k)
            member[lang or "", None].append(k)
    best = {}
    for g, own in member.items():
        own = np.array(own)
        if len(own) < quality.LEAST:
            continue
        fits = []
        for start in range(quality.STARTS + 1):
            left = [(s % quality.PRIME * quality.TIMES[start] + 7919 * start) % quality.PRIME for s in seed[own].tolist()]
            first = own if start == 0 else own[[v * len(own) < quality.FIRST * quality.PRIME for v in left]]
            if len(first):
                p = fitted(x[first])
                for _ in range(quality.EARLY):
                    p = nearer(x[own], p)
                fits.append((p[2], start, p))
        fits = sorted(fits, key=lambda f: f[:2])[: quality.BEST]
        for _ in range(quality.MOST):
            fits = [min(((q := nearer(x[own], p))[2], start, q), (det, start, p), key=lambda f: f[0]) for det, start, p in fits]
        p = min(fits, key=lambda f: f[:2])[2]
        best[g] = fitted(x[own[far(x[own], p) <= quality.NEAR]])
    out = []
    for k, (_, _, lang, source) in enumerate(rows):
        p = best.get((lang or "", source or ""), best.get((lang or "", None)))
        out.append(not failed[k] and (p is None or far(x[k : k + 1], p)[0] <= quality.CUTOFF))
    return out


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_run(spark, tmp_path, which):
    d = SF if which == "small" else awkward_dir(tmp_path)
    cols = ["doc_id", "text", "lang", "source"]
    t = pq.read_table(f"{d}/documents.parquet", columns=cols).to_pydict()
    rows = list(zip(*(t[c] for c in cols)))
    rows = [r for r, keep in zip(rows, good(rows)) if keep]
    best = {}
    for r, g in zip(rows, near_groups([r[1] for r in rows])):
        best[g] = min(best.get(g, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    rows = list(best.values())
    rows = [(r[0], x, *r[2:]) for r, x in zip(rows, redacted([r[1] for r in rows]))]
    copies = mixed_copies(rows, mixing.WEIGHTS, corpus_pipeline.SHARE, corpus_pipeline.EPOCHS, mixing.SEED)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r, n in zip(rows, copies):
        want[r[0], np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, packing.END_ID], "<u4").tobytes()] += n
    got = corpus_pipeline.run(spark, d).collect()
    pieces = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        pieces[r.doc_id].append(r)
    for (i, ids), n in want.items():
        for _ in range(n):
            at = 0
            while at < len(ids) // 4:
                p = pieces[i].pop(0)
                assert p.start == at and p.doc_tokens == len(ids) // 4 and zlib.crc32(ids[4 * at : 4 * (at + p.length)]) == p.ids_crc32
                at += p.length
    assert not any(pieces.values())


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{awkward_dir(tmp_path)}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()


def test_stages_on_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{awkward_dir(tmp_path, empty=True)}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert not stage(spark, docs, str(tmp_path)).collect()
