"""Mixing against budgets worked out node by node and leaves sorted whole."""

import pyarrow.parquet as pq
import pytest
from brute import SF, awkward_dir, mixed_copies, words

from sparkarray.llm import mixing

COLS = ["doc_id", "text", "lang", "source"]


def documents(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=COLS).to_pydict()
    return list(zip(*(t[c] for c in COLS)))


def test_copies(spark):
    docs = documents(SF)
    want = dict(zip((d[0] for d in docs), mixed_copies(docs, mixing.WEIGHTS, mixing.SHARE, mixing.EPOCHS, mixing.SEED)))
    got = mixing.op1_mixing(spark, SF).collect()
    assert {r.doc_id: r.n_copies for r in got} == want
    assert {r.doc_id: r.tokens for r in got} == {d[0]: len(words(d[1])) for d in docs}


@pytest.mark.parametrize(("share", "epochs", "weights"), [((1, 2), 1, {}), ((9, 10), 2, mixing.WEIGHTS), ((5, 1), 4, {"lang": {"en": 0, "de": 9}}), ((0, 1), 1, {})])
def test_mix(spark, tmp_path, share, epochs, weights):
    d = awkward_dir(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    own = documents(d)
    copies = mixed_copies(own, weights, share, epochs, 3)
    mixed = mixing.mix(docs, weights, share, epochs, 3)
    assert mixed.columns == docs.columns
    want = sorted((x[0] is None, x[0] or 0, x[1] or "") for x, n in zip(own, copies) for _ in range(n))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in mixed.select("doc_id", "text").collect()) == want


def test_siblings_before_ancestors(spark):
    """A language that falls short is made up for by its sibling languages, not by the other domain."""
    rows = [(k, "a b c d e f g h i j", lang, source) for k, (lang, source) in enumerate([("de", "src0x")] + [("en", "src0y")] * 20 + [("en", "src1z")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plan, _ = mixing.plan_mix(mixing.sizes(docs), {}, (1, 2), 1, 1)
    got = {r.source: r.budget for r in plan.collect()}
    assert got == {"src0x": 10, "src0y": 92, "src1z": 102}
