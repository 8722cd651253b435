"""Mixing sources to target weights by hierarchical budgets.

The leaves of a tree (domain, language, source) hold documents. A total budget of tokens is handed down: at every node the
children share its budget by weight, none beyond what its subtree can give (its tokens times the most epochs), and what a
child can't give goes to its siblings first; only what a whole subtree can't give reaches the siblings of its parent. The
share at which children with room level off follows in closed form from sums in the order of capacity over weight, so a
level is one window over the small table of nodes.

A leaf with budget B and T tokens gives B div T whole epochs and, of one more, the token-prefix of B mod T in that epoch's
seeded order. The order is a hash, so the prefix ends at a hash value: eight bits at a time, leaf sums by digit find the
digit in which it ends, and only the last, small digit is put in order. No leaf is ever sorted whole, and applying the mix
is a filter by (leaf, hash).

Edge cases: null level values count as the empty string; a null text has no tokens; a null doc_id hashes as the empty
string; repeated rows share a hash and stay or go together, so a prefix may exceed its budget by the last such block; nodes
of weight 0 give nothing; an empty table gives no rows; clashing names of further columns are evaded.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkarray.llm.common import WORD, col, free_name, n_words, table, written

LEVELS = ("domain", "lang", "source")
#: A plan of at most so many leaves is broadcast; a larger one is joined by a shuffle.
BROADCAST_LEAVES = 50_000
BITS = 8


def domain_of(source: Column) -> Column:
    """A source's domain: its name up to and with its first digit."""
    return F.regexp_extract(F.coalesce(source, F.lit("")), "^([^0-9]*[0-9]?)", 1)


def weight_of(name: Column, weights: Mapping[str, int], default: int) -> Column:
    if not weights:
        return F.lit(float(default))
    table_ = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.element_at(table_, name), F.lit(float(default)))


def seeded(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch's order: 60 bits."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def hand_down(leaves: DataFrame, total: Column, weights: Mapping[str, Mapping[str, int]], default: int = 1) -> DataFrame:
    """leaves: the levels, tokens, cap. Adds budget to each."""
    nodes = leaves.withColumn("budget", total.cast("double"))
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        path = [*parent, level]
        # The children of every parent, each with its subtree's capacity.
        kids = nodes.groupBy(*path).agg(F.sum("cap").cast("double").alias("c"), F.first("budget").alias("b"))
        kids = kids.withColumn("w", weight_of(F.col(level), weights.get(level, {}), default)).filter("w > 0")
        order = W.partitionBy(*(parent or [F.lit(0)])).orderBy(F.col("c") / F.col("w"), level)
        whole = W.partitionBy(*(parent or [F.lit(0)]))
        kids = kids.withColumn("c0", F.sum("c").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("c"))
        kids = kids.withColumn("w0", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
        kids = kids.withColumn("full", F.col("c") * F.col("w0") <= (F.col("b") - F.col("c0")) * F.col("w"))
        kids = kids.withColumn("cf", F.sum(F.when(F.col("full"), F.col("c")).otherwise(0.0)).over(whole)).withColumn("wf", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(whole))
        share = F.floor((F.col("b") - F.col("cf")) * F.col("w") / F.when(F.col("full"), 1.0).otherwise(F.col("wf"))).cast("double")
        kids = kids.select(*path, F.when(F.col("full"), F.col("c")).otherwise(share).alias("budget"))
        nodes = nodes.drop("budget").join(kids, path)
    return nodes.withColumn("budget", F.col("budget").cast("long"))


def _joined(big: DataFrame, small: DataFrame, on: list[str], n: int) -> DataFrame:
    return big.join(F.broadcast(small) if n <= BROADCAST_LEAVES else small, on)


def plan_mix(sized: DataFrame, weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], max_epochs: int, seed: int) -> tuple[DataFrame, int]:
    """sized: the levels, doc_id, tokens. Gives for each leaf tokens, budget, epochs (whole ones) and cutoff (of one more; -1: none)."""
    leaves = sized.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs)
    leaves, _ = written(leaves, "mixing-leaves")
    total = leaves.agg(F.sum("tokens").alias("t")).select(F.floor(F.coalesce("t", F.lit(0)) * share[0] / share[1]).alias("total"))
    budget = hand_down(leaves.crossJoin(F.broadcast(total)), F.col("total"), weights).filter("tokens > 0")
    plan, _ = written(
        budget.select(*LEVELS, "tokens", "budget", F.expr("budget div tokens").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest")), "mixing-plan"
    )
    n = plan.count()
    here = _joined(sized, plan.filter("rest > 0").select(*LEVELS, "epochs", "rest"), list(LEVELS), n)
    here = here.select(*LEVELS, "tokens", seeded(seed, F.col("epochs"), F.col("doc_id")).alias("h"), "rest")
    by = W.partitionBy(*LEVELS)
    for depth in range(2):
        digit = F.shiftrightunsigned("h", 60 - BITS * (depth + 1)).bitwiseAND((1 << BITS) - 1)
        here = here.withColumn("digit", digit)
        sums = here.groupBy(*LEVELS, "digit").agg(F.sum("tokens").alias("t"), F.first("rest").alias("r"))
        sums = sums.withColumn("before", F.sum("t").over(by.orderBy("digit").rowsBetween(W.unboundedPreceding, 0)) - F.col("t"))
        edge = sums.filter("before < r and before + t >= r").select(*LEVELS, "digit", (F.col("r") - F.col("before")).alias("left"))
        here = _joined(here, edge, [*LEVELS, "digit"], n).select(*LEVELS, "tokens", "h", F.col("left").alias("rest"))
        here, _ = written(here, "mixing-digit")
    before = F.coalesce(F.sum("tokens").over(by.orderBy("h").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = here.withColumn("before", before).filter("before < rest").groupBy(*LEVELS).agg(F.max("h").alias("cutoff"))
    plan = plan.join(cut, list(LEVELS), "left").select(*LEVELS, F.col("tokens").alias("leaf_tokens"), "budget", "epochs", F.coalesce("cutoff", F.lit(-1).cast("long")).alias("cutoff"))
    return written(plan, "mixing-plan")[0], n


def level_columns(docs: DataFrame) -> list[Column]:
    return [domain_of(col("source")).alias("domain"), F.coalesce(col("lang"), F.lit("")).alias("lang"), F.coalesce(col("source"), F.lit("")).alias("source")]


def sizes(docs: DataFrame) -> DataFrame:
    """One narrow row for each document: levels, doc_id, tokens (words)."""
    return written(docs.select(*level_columns(docs), col("doc_id").alias("doc_id"), n_words(col("text")).alias("tokens")), "mixing-sizes")[0]


def copies(seed: int) -> Column:
    """How often a document is taken, given its leaf's plan."""
    return F.col("epochs").cast("long") + (seeded(seed, F.col("epochs"), F.col("doc_id")) <= F.col("cutoff")).cast("long")


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], share: tuple[int, int] = (1, 1), max_epochs: int = 1, seed: int = 0) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with its own columns."""
    plan, n = plan_mix(sizes(docs), weights, share, max_epochs, seed)
    names = free_name(docs, *(f"mix_{x}" for x in LEVELS), "mix_doc", "mix_copies", "mix_nth")
    keyed = docs.select(*[col(c) for c in docs.columns], *[c.alias(x) for c, x in zip(level_columns(docs), names)], col("doc_id").alias(names[3]))
    renamed = plan.select(*[F.col(x).alias(y) for x, y in zip(LEVELS, names)], F.col("epochs").alias(f"{names[0]}_epochs"), F.col("cutoff").alias(f"{names[0]}_cutoff"))
    out = _joined(keyed, renamed, names[:3], n)
    epochs, cutoff = F.col(f"{names[0]}_epochs"), F.col(f"{names[0]}_cutoff")
    taken = epochs + (seeded(seed, epochs, F.col(names[3])) <= cutoff).cast("long")
    out = out.withColumn(names[4], taken).filter(F.col(names[4]) > 0)
    return out.select(*[col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(names[4]).cast("int"))).alias(names[5])).select(*[col(c) for c in docs.columns])


WEIGHTS = {"domain": {"src0": 3, "src1": 6}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
SHARE, EPOCHS, SEED = (3, 2), 3, 7


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its leaf's tokens and budget and how often it is taken."""
    sized = sizes(table(spark, sf_dir, "documents"))
    plan, n = plan_mix(sized, WEIGHTS, SHARE, EPOCHS, SEED)
    small = F.broadcast(plan) if n <= BROADCAST_LEAVES else plan
    out = sized.join(small, list(LEVELS), "left")
    return out.select("doc_id", *LEVELS, "tokens", F.coalesce("leaf_tokens", F.lit(0)).alias("leaf_tokens"), F.coalesce("budget", F.lit(0)).alias("leaf_budget"), F.coalesce(copies(SEED), F.lit(0)).alias("n_copies"))


QUERIES = {"op1_mixing": op1_mixing}


def _case(level: str, default: int = 1) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items()) + f" ELSE {default} END" if WEIGHTS.get(level) else str(default)


def _oracle() -> str:
    ctes, before = [], "leaves0"
    for depth, level in enumerate(LEVELS):
        part = f"PARTITION BY {', '.join(LEVELS[:depth])}" if depth else ""
        path = ", ".join(LEVELS[: depth + 1])
        ctes.append(f"""
k{depth} AS (SELECT {path}, CAST(sum(cap) AS DOUBLE) AS c, any_value(budget) AS b, CAST({_case(level)} AS DOUBLE) AS w FROM {before} GROUP BY {path}),
s{depth} AS (SELECT *, coalesce(sum(c) OVER ({part} ORDER BY c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
                    sum(w) OVER ({part} ORDER BY c / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w0 FROM k{depth} WHERE w > 0),
f{depth} AS (SELECT *, c * w0 <= (b - c0) * w AS is_full FROM s{depth}),
g{depth} AS (SELECT *, sum(CASE WHEN is_full THEN c ELSE 0.0::DOUBLE END) OVER ({part}) AS cf, sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE w END) OVER ({part}) AS wf FROM f{depth}),
leaves{depth + 1} AS (SELECT l.* EXCLUDE (budget), CASE WHEN is_full THEN c ELSE floor((b - cf) * w / CASE WHEN is_full THEN 1.0::DOUBLE ELSE wf END) END AS budget
                      FROM {before} l JOIN g{depth} USING ({path}))""")
        before = f"leaves{depth + 1}"
    h = f"('0x' || substr(md5('{SEED}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract(coalesce(source, ''), '^([^0-9]*[0-9]?)', 1) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT {', '.join(LEVELS)}, CAST(sum(tokens) AS BIGINT) AS leaf_tokens, CAST(sum(tokens) * {EPOCHS} AS BIGINT) AS cap FROM d GROUP BY ALL),
leaves0 AS (SELECT *, CAST(floor((SELECT sum(leaf_tokens) FROM leaf) * {SHARE[0]} / {SHARE[1]}) AS DOUBLE) AS budget FROM leaf),
{','.join(c.strip() for c in ctes)},
plan AS (SELECT {', '.join(LEVELS)}, leaf_tokens, CAST(budget AS BIGINT) AS leaf_budget, CAST(budget AS BIGINT) // leaf_tokens AS epochs, CAST(budget AS BIGINT) % leaf_tokens AS rest
         FROM {before} WHERE leaf_tokens > 0),
j AS (SELECT d.*, coalesce(leaf_tokens, 0) AS leaf_tokens, coalesce(leaf_budget, 0) AS leaf_budget, epochs, rest, {h} AS h FROM d LEFT JOIN plan USING ({', '.join(LEVELS)})),
p AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {', '.join(LEVELS)} ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j)
SELECT doc_id, {', '.join(LEVELS)}, tokens, leaf_tokens, leaf_budget,
       CAST(coalesce(epochs + CASE WHEN before < rest THEN 1 ELSE 0 END, 0) AS BIGINT) AS n_copies FROM p"""


ORACLE = {"op1_mixing": _oracle()}
