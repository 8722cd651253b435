"""Personal data: base spans by the patterns as they are stated, disclosing terms by counting."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
from brute import SF, awkward_dir, prose

from sparkarray.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def passes(kind: str, m: str) -> bool:
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base(text):
    return [(kind, m.start(), m.end(), m[0]) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(kind, m[0])]


def split(text):
    return re.split(r"[\x20\x09-\x0D]+", text.lower())


def others(text, spans):
    """The words that no span touches."""
    out, at = "", 0
    for a, b in sorted((a, b) for _, a, b, _ in spans):
        if a >= at:
            out += text[at:a] + "\0"
        at = max(at, b)
    return {w for w in split(out + text[at:]) if w and "\0" not in w}


def added(texts):
    """For each text the spans that the method adds."""
    n = len(texts)
    spans = [base(t) for t in texts]
    n_entity, n_term, n_both, support = Counter(), Counter(), Counter(), defaultdict(set)
    for t, s in zip(texts, spans):
        n_term.update(set(split(t or "")))
        own = {e for *_, e in s}
        n_entity.update(own)
        for x in ((e, w) for e in own for w in others(t, s)):
            n_both[x] += 1
            support[x].add(t)
    strong = set()
    for (e, w), c in n_both.items():
        if len(support[e, w]) >= pii.SUPPORT and n > n_entity[e] and math.log2(c * n / (n_entity[e] * n_term[w])) / math.log2(n / n_entity[e]) >= pii.DISCLOSURE:
            strong.add(w)
    kind = lambda w: "general" if n_term[w] / n > pii.COMMON else "term"
    return [sorted((kind(m[0].lower()), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "") if m[0].lower() in strong) for t in texts]


def redacted(texts):
    out = []
    for t, more in zip(texts, added(texts)):
        spans = base(t)
        if not spans and not more:
            out.append(t)
            continue
        new, at = "", 0
        for a, b, k in sorted([(a, b, k) for k, a, b, _ in spans] + [(a, b, k) for k, a, b in more]):
            if a >= at:
                new += t[at:a] + {"term": "", "general": "[WORD]"}.get(k, f"[{k.upper()}]")
            at = max(at, b)
        out.append(new + t[at:])
    return out


def planted() -> list[str]:
    rng = np.random.default_rng(4)
    out = [f"{prose(rng, 12)} agent Zorba{k % 3} mail zorba{k % 3}@example.com today {prose(rng, 9)}" for k in range(30)]
    out += [f"{prose(rng, 20)} call +44 20 7946 09{k:02d} now {prose(rng, 5)}" for k in range(6)]
    out += ["a@b.c", "a@b", "x@@y.z a.b@c-d.e.f@g.h", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111000", "+1 (234) 567-8901) +12 +1234567890123456 +1+23456789", "é\U0001f600 a@b.cc 10.0.0.1"]
    # Terms far from what they give away, in other places of the text, in texts without any match, in other cases, next to signs.
    out += [f"Quorn{k % 2}.\\E {prose(rng, 60)} {k}@quorn{k % 2}.org q{k % 2}@all.org {prose(rng, 40)} QUORN{k % 2}.\\e" for k in range(8)]
    out += ["only quorn0.\\e here, no match", "quorn1.\\Ex quorn1.\\E (quorn1.\\E)", "the agent zorba1 himself"]
    out += ["a" * 20_000 + " @ b@c.d", "1" * 20_000 + " 1.2.3.4", "12 " * 9000 + "4111111111111111", "a@b" + ".c" * 9000, "+1" + "(" * 9000, None, "", *["w@x.yz same words here"] * 4]
    return out


def held(spark, d):
    t = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    join = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in s)
    more = added(t["text"])
    want = []
    for i, x, m in zip(t["doc_id"], t["text"], more):
        s = base(x)
        n = Counter(k for k, *_ in s)
        want.append((i is not None, i or 0, *(n[k] for k in PATTERNS), hashlib.sha256(join(s).encode()).hexdigest(), join([*s, *m])))
    got = pii.op8_pii(spark, d).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got) == sorted(want)
    return more


def test_small(spark):
    held(spark, SF)


def test_awkward(spark, tmp_path):
    held(spark, awkward_dir(tmp_path))


def test_planted(spark, tmp_path):
    import pyarrow as pa

    texts = planted()
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), f"{tmp_path}/documents.parquet")
    more = held(spark, str(tmp_path))
    assert all(any(texts[k][a:b].startswith("Zorba") for _, a, b in more[k]) for k in range(30))
    words = [[texts[k][a:b] for _, a, b in more[k]] for k in range(len(texts))]
    first = next(k for k, t in enumerate(texts) if t and t.startswith("Quorn"))
    assert all(sum(w.lower() == f"quorn{k % 2}.\\e" for w in words[first + k]) == 2 for k in range(8))
    assert words[first + 8 : first + 11] == [["quorn0.\\e"], ["quorn1.\\E"], ["zorba1"]]


def test_shuffled_instead_of_broadcast(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    texts = planted()
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), f"{tmp_path}/documents.parquet")
    held(spark, str(tmp_path))


def test_redact(spark, tmp_path):
    d = awkward_dir(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    own = [tuple(r) for r in docs.collect()]
    text = docs.columns.index("text")
    new = redacted([r[text] for r in own])
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(((*r[:text], x, *r[text + 1 :]) for r, x in zip(own, new)), key=str)
    del key
