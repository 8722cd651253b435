"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Every text gives counts of words, symbols, repeated lines and repeated three-word windows. Those that pass the base rules
give a vector of four transformed statistics (log of the mean word length; square roots of the shares of symbols, repeated
lines and repeated words), in fixed point so that all sums are exact and the same in any order. For each language and
source, concentration steps look for the ``SHARE`` of documents whose covariance has the least determinant: a step groups
documents by the bin of their squared Mahalanobis distance, with counts and cross sums for each bin, and running sums over
the bins of a group give the next centre and covariance. A group is never sorted or gathered; what meets in a window is a
few hundred bins. The search begins with all documents and with ``STARTS`` seeded random subsets of some ``FIRST`` documents
each, small enough that some hold none of a cluster of outliers; after ``EARLY`` steps the ``BEST`` of them go on until no
determinant falls any more (``MOST`` steps at most), and the least wins. As is usual the estimate is then reweighted: centre
and covariance come anew from all documents within ``NEAR`` of it. A document is rejected when its distance exceeds
``CUTOFF``; groups under ``LEAST`` documents fall back to their language, and languages under it reject nothing.

Covariances have the squares of ``FLOOR`` added, so that a statistic that is zero in most texts of a group does not reject
all others. A text with half of its lines or a third of its words repeated, or with an eighth of its characters symbols, lies
beyond the cutoff by that statistic alone in a group where it is usually zero.

Edge cases: a null or empty text has no words and fails the base rules; null language or source counts as empty;
repeated rows count each; an empty table gives no rows; very long texts are treated whole; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkarray.llm.common import WORD, ascii_words, col, cols, table, written

SHARE, STARTS, FIRST, EARLY, BEST, MOST, LEAST = 0.75, 8, 8, 2, 2, 6, 40
#: Chi-square with 4 degrees of freedom at 0.975 and 0.999999, times the consistency factors of a 0.75 and a 0.975 subset.
NEAR, CUTOFF = 11.143 * 1.486, 33.4 * 1.0645
#: One unit of a statistic in fixed point, and the least standard deviations.
UNIT, FLOOR = 1024, (0.035, 0.06, 0.12, 0.1)
#: Random subsets: documents whose seed, times a number of the start, leaves little modulo a prime.
PRIME, TIMES = 1_000_003, (0, 611_953, 224_737, 350_377, 86_028, 999_331, 479_909, 715_225, 15_485)
BROADCAST_GROUPS = 50_000
X = ("x1", "x2", "x3", "x4")
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
#: Up to so many distinct repeated windows a text's windows are looked up among them one by one.
FEW = 16


def counts(docs: DataFrame, text: Column, keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` and the base counts of every text. Windows are compared by 64-bit hashes of their three words."""
    t = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(text, F.lit("")).alias("_t"))
    t = t.withColumn("_w", ascii_words(F.col("_t"))).withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)))
    t = t.withColumn("_h", F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    t = t.withColumn("_s", F.sort_array("_h"))
    t = t.withColumn("_d", F.array_distinct(F.filter("_s", lambda x, i: (i > 0) & (x == F.get("_s", i - 1)))))
    few = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: F.array_contains("_d", F.get("_h", i)))
    t = t.withColumn("_p", F.when(F.size("_d") > FEW, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    many = F.sort_array(F.transform(F.filter("_p", lambda x, i: (x["h"] == F.get("_p", i - 1)["h"]) | (x["h"] == F.get("_p", i + 1)["h"])), lambda x: x["i"]))
    t = t.withColumn("_r", F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(F.size("_d") <= FEW, few).otherwise(many))
    covered = F.aggregate(F.transform("_r", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_r", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    t = t.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )
    return t.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


# The arithmetic below is SQL text that both Spark and the test engine read: doubles, the same order of operations.
def _vector() -> dict[str, str]:
    fixed = lambda x: f"CAST(floor({UNIT} * {x} + CAST(0.5 AS DOUBLE)) AS BIGINT)"
    d = lambda x: f"CAST({x} AS DOUBLE)"
    share = lambda a, b: f"sqrt({d(a)} / {d(f'greatest({b}, 1)')})"
    return {
        "x1": fixed(f"ln({d('greatest(word_chars, 1)')} / {d('greatest(n_words, 1)')})"),
        "x2": fixed(share("n_symbols", "word_chars")),
        "x3": fixed(share("n_dup_lines", "n_lines")),
        "x4": fixed(share("n_repeat_words", "n_words")),
    }


def _fit() -> dict[str, str]:
    """Centre, covariance, its Cholesky factor and determinant from n, s1..4 and q_ij, as successive layers of columns."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    out = {f"m{i + 1}": f"{d(f's{i + 1}')} / {d('n')}" for i in range(4)}
    for i, j in PAIRS:
        floor = f" + {d((FLOOR[i] * UNIT) ** 2)}" if i == j else ""
        out[f"c{i}{j}"] = f"{d(f'q{i}{j}')} / {d('n')} - m{i + 1} * m{j + 1}{floor}"
    for j in range(4):
        inner = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        out[f"l{j}{j}"] = f"sqrt(greatest(c{j}{j}{inner}, {d(1)}))"
        for i in range(j + 1, 4):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out[f"l{i}{j}"] = f"(c{i}{j}{inner}) / l{j}{j}"
    out["det"] = "l00 * l11 * l22 * l33"
    return out


def _distance() -> dict[str, str]:
    out = {}
    for i in range(4):
        inner = "".join(f" - l{i}{k} * z{k}" for k in range(i))
        out[f"z{i}"] = f"(CAST({X[i]} AS DOUBLE) - m{i + 1}{inner}) / l{i}{i}"
    out["d2"] = "z0 * z0 + z1 * z1 + z2 * z2 + z3 * z3"
    return out


_PARAMS = [*(f"m{i + 1}" for i in range(4)), *(f"l{i}{j}" for i, j in PAIRS), "det"]
_SUMS = ["n", *(f"s{i + 1}" for i in range(4)), *(f"q{i}{j}" for i, j in PAIRS)]
#: Sixteen bins for each doubling of the distance, by whole numbers only.
_Q = "CAST(floor(least(d2, CAST(1000000000 AS DOUBLE)) * 64) AS BIGINT)"


def _layers(df: DataFrame, new: dict[str, str]) -> DataFrame:
    for name, sql in new.items():
        df = df.withColumn(name, F.expr(sql))
    return df


def _sums() -> list[Column]:
    return [
        F.count("*").alias("n"),
        *[F.sum(x).alias(f"s{i + 1}") for i, x in enumerate(X)],
        *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS],
    ]


def _grouped(rows: DataFrame, key: list[str]) -> DataFrame:
    return _layers(rows.groupBy(*key).agg(*_sums()), _fit()).select(*key, *_PARAMS)


def _step(both: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """The next parameters of every group and start."""
    key = ["lang", "source", "start"]
    far = _layers(_same(both, F.broadcast(params) if few else params, key[:2]), _distance())
    far = far.withColumn("q", F.expr(_Q)).withColumn("len", F.length(F.bin("q")))
    far = far.withColumn("bin", F.when(F.col("q") < 16, F.col("q")).otherwise(F.col("len").cast("long") * 16 + F.expr("shiftright(q, len - 5)").bitwiseAND(15)))
    bins = far.groupBy(*key, "bin").agg(*_sums())
    by = W.partitionBy(*key).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    upto = bins.select(*key, "bin", *[F.sum(c).over(by).alias(c) for c in _SUMS], F.sum("n").over(W.partitionBy(*key)).alias("all"))
    chosen = upto.filter(F.col("n") >= F.col("all") * SHARE).groupBy(*key).agg(F.min_by(F.struct(*_SUMS), "bin").alias("s")).select(*key, "s.*")
    return _layers(chosen, _fit()).select(*key, *_PARAMS)


def fit(stats: DataFrame) -> tuple[DataFrame, int]:
    """stats: lang, source, seed (long), x1..x4 of documents that pass the base rules. Gives a row of parameters for each group.

    A group is (lang, source) or, with source null, a language.
    """
    group, key = ["lang", "source"], ["lang", "source", "start"]
    both = stats.withColumn("source", F.explode(F.array(F.col("source"), F.lit(None).cast("string"))))
    size, _ = written(both.groupBy(*group).agg(F.count("*").alias("docs")), "quality-groups")
    n_groups = size.count()
    few = n_groups * (STARTS + 1) <= BROADCAST_GROUPS
    sized = _same(both, F.broadcast(size) if few else size, group)
    # A row is made for the starts that have it only: of random ones a few rows in all.
    left = lambda k: F.pmod(F.pmod(F.col("seed"), F.lit(PRIME)) * F.lit(TIMES[k]).cast("long") + 7919 * k, F.lit(PRIME))
    has = [F.when(left(k) * F.col("docs") < FIRST * PRIME, F.lit(k)) for k in range(1, STARTS + 1)]
    starts = F.array_compact(F.array(F.lit(0), *has))
    params, _ = written(_grouped(sized.withColumn("start", F.explode(starts)), key), "quality-fit")
    for _ in range(EARLY):
        params, _ = written(_step(both, params, few), "quality-fit")
    rank = F.row_number().over(W.partitionBy(*group).orderBy("det", "start"))
    params, _ = written(params.withColumn("rank", rank).filter(F.col("rank") <= BEST).drop("rank"), "quality-fit")
    for _ in range(MOST):
        new = _step(both, params, few).select(*key, F.struct(*_PARAMS).alias("new"))
        pair = _same(params.select(*key, F.struct(*_PARAMS).alias("old")), new, key)
        pair, _ = written(pair.withColumn("less", F.col("new.det") < F.col("old.det")), "quality-fit")
        params = pair.select(*key, F.when(F.col("less"), F.col("new")).otherwise(F.col("old")).alias("p")).select(*key, "p.*")
        if not pair.filter("less").limit(1).count():
            break
    best = params.groupBy(*group).agg(F.min_by(F.struct(*_PARAMS), F.struct("det", "start")).alias("p")).select(*group, "p.*")
    near = _layers(_same(both, F.broadcast(best) if few else best, group), _distance()).filter(F.col("d2") <= NEAR)
    final = _same(_grouped(near.select(*group, *X), group), size, group).filter(F.col("docs") >= LEAST)
    return written(final, "quality-fit")[0], n_groups


def _same(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null."""
    r = right.select(*[F.col(k).alias(f"{k}_r") for k in key], *[c for c in right.columns if c not in key])
    on = None
    for k in key:
        one = F.col(k).eqNullSafe(F.col(f"{k}_r"))
        on = one if on is None else on & one
    return left.join(r, on, how).drop(*[f"{k}_r" for k in key])


def _stats(counted: DataFrame) -> DataFrame:
    return _layers(counted.filter(~F.col("base_failed")), _vector()).select("lang", F.coalesce("source", F.lit("")).alias("source"), "seed", *X)


def _verdict(counted: DataFrame, params: DataFrame, n_groups: int) -> DataFrame:
    """Adds kept."""
    own = params.filter("source is not null")
    lang = params.filter("source is null").drop("source")
    hint = (lambda p: F.broadcast(p)) if n_groups <= BROADCAST_GROUPS else (lambda p: p)
    own = own.select(F.col("lang"), F.col("source"), F.struct(*_PARAMS).alias("own"))
    lang = lang.select("lang", F.struct(*_PARAMS).alias("wide"))
    joined = counted.withColumn("source", F.coalesce("source", F.lit("")))
    joined = _same(_same(joined, hint(own), ["lang", "source"], "left"), hint(lang), ["lang"], "left")
    joined = joined.withColumn("p", F.coalesce("own", "wide"))
    joined = _layers(joined, _vector()).select("*", "p.*")
    far = _layers(joined, _distance())
    return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True)))


def _counted(docs: DataFrame) -> DataFrame:
    key = {"doc_id": col("doc_id"), "lang": F.coalesce(col("lang"), F.lit("")), "source": F.coalesce(col("source"), F.lit(""))}
    got = counts(docs, col("text"), key)
    return written(got.withColumn("seed", F.coalesce("doc_id", F.lit(0)).cast("long")), "quality-counts")[0]


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the verdict of every document."""
    counted = _counted(docs)
    return _verdict(counted, *fit(_stats(counted))).select("doc_id", *BASE)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns: verdicts are a function of a text, its language and its source.

    The counts are written beside the documents, so the verdict is a filter and no text moves between machines.
    """
    digest = F.conv(F.substring(F.md5(F.coalesce(col("text"), F.lit(""))), 1, 15), 16, 10).cast("long")
    key = {"document": F.struct(*cols(docs.columns)), "seed": digest, "lang": F.coalesce(col("lang"), F.lit("")), "source": F.coalesce(col("source"), F.lit(""))}
    counted, _ = written(counts(docs, col("text"), key), "quality-counts")
    kept = _verdict(counted, *fit(_stats(counted))).filter("kept")
    return kept.select(*[F.col("document")[c].alias(c) for c in docs.columns])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op4_quality": op4_quality}


def _nest(src: str, new: dict[str, str]) -> str:
    """Each layer may use the ones before it."""
    for name, sql in new.items():
        src = f"(SELECT *, {sql} AS {name} FROM {src})"
    return src


def _oracle() -> str:
    sums = ["count(*) AS n", *(f"CAST(sum({x}) AS BIGINT) AS s{i + 1}" for i, x in enumerate(X)), *(f"CAST(sum({X[i]} * {X[j]}) AS BIGINT) AS q{i}{j}" for i, j in PAIRS)]
    params = ", ".join(_PARAMS)
    def step(k: int, p: str) -> str:
        far = _nest(f"(SELECT b.*, p.* EXCLUDE (lang, source) FROM b JOIN {p} p ON b.lang = p.lang AND b.source IS NOT DISTINCT FROM p.source)", _distance() | {"q": _Q})
        return f"""
f{k} AS (SELECT *, CASE WHEN q < 16 THEN q ELSE length(bin(q)) * 16 + ((q >> (length(bin(q)) - 5)) & 15) END AS bin FROM {far}),
h{k} AS (SELECT lang, source, start, bin, {', '.join(sums)} FROM f{k} GROUP BY lang, source, start, bin),
u{k} AS (SELECT lang, source, start, bin, {', '.join(f'CAST(sum({c}) OVER w AS BIGINT) AS {c}' for c in _SUMS)}, sum(n) OVER (PARTITION BY lang, source, start) AS al
         FROM h{k} WINDOW w AS (PARTITION BY lang, source, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e{k} AS (SELECT * FROM u{k} WHERE n >= al * {SHARE} QUALIFY row_number() OVER (PARTITION BY lang, source, start ORDER BY bin) = 1),
n{k} AS MATERIALIZED (SELECT lang, source, start, {params} FROM {_nest(f'e{k}', _fit())})"""

    steps, at = [], "p0"
    for k in range(EARLY):
        steps.append(step(k, at))
        at = f"n{k}"
    steps.append(f"g{EARLY} AS MATERIALIZED (SELECT * FROM {at} QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY det, start) <= {BEST})")
    for k in range(EARLY, EARLY + MOST):
        steps.append(step(k, f"g{k}"))
        steps.append(f"g{k + 1} AS MATERIALIZED (SELECT o.lang, o.source, o.start, {', '.join(f'CASE WHEN n.det < o.det THEN n.{x} ELSE o.{x} END AS {x}' for x in _PARAMS)} FROM g{k} o JOIN n{k} n ON o.lang = n.lang AND o.source IS NOT DISTINCT FROM n.source AND o.start = n.start)")
    times = "[" + ", ".join(map(str, TIMES)) + "]"
    near = _nest("(SELECT b.*, p.* EXCLUDE (lang, source, start) FROM b JOIN won p ON b.lang = p.lang AND b.source IS NOT DISTINCT FROM p.source)", _distance())
    vector = _nest("c", _vector())
    first = f"""(SELECT b.lang, b.source, start, {', '.join(sums)} FROM b JOIN size ON b.lang = size.lang AND b.source IS NOT DISTINCT FROM size.source, range(0, {STARTS + 1}) s(start)
      WHERE start = 0 OR (((seed % {PRIME} + {PRIME}) % {PRIME} * {times}[start + 1] + 7919 * start) % {PRIME}) * docs < {FIRST * PRIME} GROUP BY ALL)"""
    pick = lambda level: f"(SELECT lang, {'source, ' if level else ''}{params} FROM best WHERE source IS {'NOT ' if level else ''}NULL)"
    far = _nest(f"(SELECT v.*, {', '.join(f'coalesce(o.{p}, w.{p}) AS {p}' for p in _PARAMS)} FROM {vector} v LEFT JOIN {pick(1)} o USING (lang, source) LEFT JOIN {pick(0)} w USING (lang))", _distance())
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
gr AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
rw AS (SELECT rid, i FROM gr QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rw) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
c0 AS (SELECT rid, doc_id, lang, source, coalesce(doc_id, 0) AS seed, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
       FROM d JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
c AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c0),
b AS MATERIALIZED (SELECT lang, unnest([source, NULL]) AS source, seed, {', '.join(X)} FROM {vector} WHERE NOT base_failed),
size AS MATERIALIZED (SELECT lang, source, count(*) AS docs FROM b GROUP BY lang, source),
p0 AS MATERIALIZED (SELECT lang, source, start, {params} FROM {_nest(first, _fit())}),
{','.join(s.strip() for s in steps)},
won AS MATERIALIZED (SELECT * FROM g{EARLY + MOST} QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY det, start) = 1),
r AS (SELECT lang, source, {', '.join(sums)} FROM {near} WHERE d2 <= {NEAR} GROUP BY lang, source),
best AS MATERIALIZED (SELECT p.* FROM (SELECT lang, source, {params} FROM {_nest('r', _fit())}) p JOIN size s ON p.lang = s.lang AND p.source IS NOT DISTINCT FROM s.source WHERE docs >= {LEAST})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {CUTOFF}, true) AS kept FROM {far}"""


ORACLE = {"op4_quality": _oracle()}
