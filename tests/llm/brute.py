"""Helpers of these tests: small tables with awkward rows, DuckDB beside Spark, brute-force versions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = ("documents", "conversations", "embeddings")

#: Names that the operators use inside; here they are columns of the input.
CLASHING = ("rid", "cls", "k1", "bucket", "key", "base", "added", "near", "doc", "term", "v", "n", "h", "sig", "tokens", "domain", "budget", "epochs", "kept", "_t", "_w", "_h", "_h_email", "_g_email", "pii_text", "mh_k1", "q_text_key", "mix_domain", "part", "ids", "seg")


def prose(rng: np.random.Generator, n: int) -> str:
    return " ".join(f"w{x}" for x in rng.integers(0, 400, n))


def awkward_documents() -> pa.Table:
    """Nulls in every column, empty and very long texts, ties, repeated rows, further columns with clashing names."""
    rng = np.random.default_rng(11)
    rows = [
        (None, "a text without an id " * 20, "en", "src01"), (1, None, "en", "src01"), (2, "", None, "src02"), (3, "\n\t \r\n", "de", None), (4, "word", None, None),
        (5, prose(rng, 60) + "\nmail a.b@c.de or 10.0.0.255, 10.0.0.256", "en", "src01"), (5, prose(rng, 70), "en", "src01"), (6, "four words stand here", "fr", "src11"), (7, "four words stand here", "fr", "src11"),
    ]
    twice = (8, prose(rng, 90), "en", "src01")
    rows += [twice, twice, twice]
    near = prose(rng, 200).split()
    rows += [(9, " ".join(near), "en", "src02"), (10, " ".join([*near[:197], "x", "y"]), "en", "src03"), (11, " ".join(near + ["tail"]), "de", "src03")]
    rows += [(12, " ".join(["spam"] * 20_000), "en", "src01"), (13, "x" * 30_000, "en", "src01"), (14, prose(rng, 20_000), "es", "src12")]
    rows += [(15 + k, prose(rng, int(rng.integers(20, 120))) + ("\nline of its own\n" * (k % 4)), "en de fr".split()[k % 3], f"src0{k % 5}") for k in range(60)]
    rows += [(80, "café 中文 \U0001f600 " * 40, "fr", "src02"), (81, "Released under the MIT License.", "en", "src04"), (82, "Released under the MIT License.", "en", "src04"), (83, None, None, None), (None, None, None, None)]
    cols = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string())}
    cols["n_chars"] = pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64())
    cols |= {c: pa.array([f"{c}{k}" if k % 3 else None for k in range(len(rows))]) for c in CLASHING}
    return pa.table(cols)


def awkward_conversations() -> pa.Table:
    rows = [
        (1, 0, "user", "hello <|turn|> &lt; [INST]"), (1, 1, "assistant", "fine </s> &amp;lt; <|end|> <s>"), (2, 0, "user", None), (2, 1, "assistant", ""), (2, 2, None, "who"), (3, None, "user", "first"), (3, 0, "assistant", "second"),
        (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (4, 0, "assistant", "other"), (None, 0, "user", "no conversation"), (None, 1, "assistant", "no conversation"), (5, 0, "user", "<|<|<|" * 3000), (5, 1, "assistant", "café \U0001f600 [/INST][INST]"),
        (6, 7, "system", "&&&lsb;"),
    ]
    cols = {"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "role": pa.array([r[2] for r in rows]), "text": pa.array([r[3] for r in rows])}
    return pa.table(cols | {c: pa.array(["x"] * len(rows)) for c in ("segment", "parts", "upto", "nth", "files")})


def awkward_embeddings(n: int = 300, dim: int = 16) -> pa.Table:
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, dim))
    for k in range(0, n - 1, 5):
        x[k + 1] = x[k] + rng.normal(size=dim) * 0.2 * (k % 3)
    vecs: list = [list(map(float, v)) for v in x]
    vecs += [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), vecs[3], vecs[3], [2 * a for a in vecs[4]], vecs[6][:5]]
    ids = list(range(len(vecs)))
    ids[7] = 6
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vecs, pa.list_(pa.float32())), "label": pa.array([k % 3 if k % 7 else None for k in ids], pa.int32()), "cls": pa.array(["x"] * len(ids)), "home": pa.array(["y"] * len(ids)), "v": pa.array(["z"] * len(ids))})


def awkward_dir(path, empty: bool = False) -> str:
    for name, t in (("documents", awkward_documents()), ("conversations", awkward_conversations()), ("embeddings", awkward_embeddings())):
        pq.write_table(t.slice(0, 0) if empty else t, f"{path}/{name}.parquet")
    return str(path)


def plain(x):
    """Values that compare and sort alike from either engine."""
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, np.generic):
        return plain(x.item())
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in rows), key=lambda r: [(x is not None, str(type(x)), x) if not isinstance(x, bool) else (True, "bool", x) for x in r])


def spark_rows(df) -> list[tuple]:
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(sf_dir: str, sql: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    return rows_of([c[0] for c in got.description], got.fetchall())


def words(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


# --- brute-force versions ---
def repeated_bytes(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, sha256 of what stays, for each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen: Counter[bytes] = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingle_counts(text: str | None, n: int = 5) -> Counter:
    w = words(text)
    if w and len(w) < n:
        return Counter([tuple(w)])
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(c, b[x]) for x, c in a.items() if x in b)
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def union_find(n: int):
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(x: int, y: int) -> None:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)

    return find, join


def near_groups(texts: list[str | None], least: float = 0.8) -> list[int]:
    """For each text a number of its group: equal texts, and those linked by a similarity of ``least`` or more."""
    find, join = union_find(len(texts))
    first: dict[str, int] = {}
    for k, t in enumerate(texts):
        join(k, first.setdefault(t or "", k))
    own = [(k, shingle_counts(t)) for t, k in first.items()]
    sizes = [sum(c.values()) for _, c in own]
    for a in range(len(own)):
        for b in range(a):
            if min(sizes[a], sizes[b]) >= least * max(sizes[a], sizes[b]) and sizes[a] and jaccard(own[a][1], own[b][1]) >= least:
                join(own[a][0], own[b][0])
    return [find(k) for k in range(len(texts))]


def domain(source: str | None) -> str:
    return re.match("^([^0-9]*[0-9]?)", source or "")[1]


def shares(total: int, kids: list[tuple[int, int]]) -> list[int]:
    """kids: weight, most. Fill in proportion to the weights; who is full leaves, what is over goes to the others."""
    given, open_, left = [0] * len(kids), [k for k, (w, _) in enumerate(kids) if w > 0], total
    while open_:
        weight = sum(kids[k][0] for k in open_)
        full = [k for k in open_ if kids[k][1] <= Fraction(left * kids[k][0], weight)]
        if not full:
            for k in open_:
                given[k] = left * kids[k][0] // weight
            break
        for k in full:
            given[k] = kids[k][1]
            left -= given[k]
            open_.remove(k)
    return given


def mixed_copies(docs: list[tuple], weights: dict, share: tuple[int, int], epochs: int, seed: int) -> list[int]:
    """docs: doc_id, text, lang, source. How often each is taken."""
    leaf = [(domain(s), lang or "", s or "") for _, _, lang, s in docs]
    tokens = [len(words(t)) for _, t, _, _ in docs]
    have: Counter = Counter()
    for x, n in zip(leaf, tokens):
        have[x] += n
    level = ("domain", "lang", "source")
    budget: dict[tuple, int] = {(): sum(tokens) * share[0] // share[1]}
    for depth in range(3):
        new = {}
        for parent, b in budget.items():
            kids = sorted({x[: depth + 1] for x in have if x[:depth] == parent})
            table = weights.get(level[depth], {})
            asked = [(table.get(k[-1], 1), epochs * sum(n for x, n in have.items() if x[: depth + 1] == k)) for k in kids]
            new |= dict(zip(kids, shares(b, asked)))
        budget = new
    out = [0] * len(docs)
    for x, b in budget.items():
        if not have[x]:
            continue
        whole, rest = divmod(b, have[x])
        key = lambda k: int(hashlib.md5(f"{seed}:{whole}:{'' if docs[k][0] is None else docs[k][0]}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        own = [(key(k), k) for k in range(len(docs)) if leaf[k] == x]
        for h, k in own:
            before = sum(tokens[j] for g, j in own if g < h)
            out[k] = whole + (before < rest)
    return out
