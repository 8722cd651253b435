"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Segments of a text are its lines, its paragraphs (lines up to one without a letter or digit, so the bare ``#`` of a comment
parts them too), the sentences of its paragraphs, wherever their lines break, and the whole text. Terms are runs of letters
and digits, lower case; idf comes from the document frequencies of all documents. A segment that is close to a template
names the document's own licence. A whole text that is close to any template, or a paragraph or sentence that only stands in
the text of a licence, makes the document a licence file, which holds for its directory and for all below that have no
nearer one.

Only documents with an anchor term are cut into segments, and that loses nothing: the anchors of a template are its rarest
terms, taken until the rest weighs less than the threshold allows, so by Cauchy-Schwarz a segment without an anchor can't
reach it. Templates are a constant (``license_texts``); their vocabulary's frequencies are all that the driver sees.

Edge cases: null text has no licence of its own; null source or language is an empty path part; ties go to the template
named first in the alphabet, then to the least doc_id; repeated rows are scanned each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkarray.llm.common import SPACE, col, table, written
from sparkarray.llm.license_texts import TEMPLATES

LEAST_COSINE = 0.8
#: What also stands in the texts of other licences: it holds only where no other is named.
WEAKEST = "proprietary"
TERM = r"[\p{L}\p{N}]+"
BROADCAST_ROWS = 100_000


def template_terms() -> list[dict[str, int]]:
    out = []
    for _, _, text in TEMPLATES:
        tf: dict[str, int] = {}
        for t in re.findall(r"[^\W_]+", text.lower()):
            tf[t] = tf.get(t, 0) + 1
        out.append(tf)
    return out


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def frequencies(docs: DataFrame) -> DataFrame:
    """Document frequencies (term, df) over all documents, as a written table."""
    words = docs.select(F.explode(F.array_distinct(terms(F.coalesce(col("text"), F.lit(""))))).alias("term"))
    return written(words.groupBy("term").agg(F.count("*").alias("df")), "licence-frequencies")[0]


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def anchors(tf: list[dict[str, int]], df: dict[str, int], n: int, least: float) -> set[str]:
    """Terms of which a segment has one at least if it is close to a template; those that no document has are left out."""
    out = set()
    for t in tf:
        w = {x: (c * (math.log((n + 1.0) / (df.get(x, 0) + 1.0)) + 1.0)) ** 2 for x, c in t.items()}
        left = total = sum(w.values())
        for x in sorted(w, key=lambda x: (df.get(x, 0), -w[x])):
            # A little under the bound, for rounding.
            if left < 0.999 * least * least * total:
                break
            out.add(x)
            left -= w[x]
    return {x for x in out if df.get(x, 0)}


def one_of(words: set[str]) -> str:
    """A pattern for any of the words, by their common beginnings."""
    heads: dict[str, set[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], set()).add(w[1:])
    rest = "|".join(re.escape(h) + one_of(tails) for h, tails in sorted(heads.items()))
    return f"(?:{rest})" + "?" * ("" in words) if rest else ""


def segments(text: Column) -> Column:
    """The different lines, paragraphs and sentences of a text."""
    lines = F.split(text, "\n", -1)
    solid = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(TERM), x).otherwise("")), "\n")
    paragraphs = F.transform(F.split(solid, "\n\n+", -1), lambda x: F.replace(x, F.lit("\n"), F.lit(" ")))
    sentences = F.flatten(F.transform(paragraphs, lambda x: F.split(F.regexp_replace(x, rf"([.!?]){SPACE}", "$1\n"), "\n", -1)))
    return F.array_distinct(F.concat(lines, paragraphs, sentences))


def path_of(docs: DataFrame) -> list[Column]:
    """A document's directory: its source, then its language."""
    return [F.concat_ws("/", F.coalesce(col("source"), F.lit("")), F.coalesce(col("lang"), F.lit(""))).alias("dir")]


def own_licences(docs: DataFrame, least: float = LEAST_COSINE) -> tuple[DataFrame, DataFrame]:
    """A narrow row for each document (rid, doc_id, dir), and rid, license, score, is_file for those that name a licence."""
    spark = docs.sparkSession
    tf = template_terms()
    vocabulary = sorted({t for x in tf for t in x})
    n = docs.count()
    all_df = frequencies(docs)
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in vocabulary])).alias("term"))
    df = {r.term: r.df for r in all_df.join(F.broadcast(asked), "term").collect()}  # at most the vocabulary of the templates
    anchor = anchors(tf, df, n, least)
    pattern = rf"(?<![\p{{L}}\p{{N}}]){one_of(anchor)}(?![\p{{L}}\p{{N}}])" if anchor else "$^a"
    hit = F.coalesce(F.lower(col("text")).rlike(pattern), F.lit(False))
    rows = docs.select(col("doc_id").alias("doc_id"), *path_of(docs), F.when(hit, col("text")).alias("text"))
    rows, _ = written(rows.withColumn("rid", F.monotonically_increasing_id()), "licence-documents")
    here = rows.filter("text is not null")
    inner = here.select("rid", F.posexplode(segments(F.col("text"))).alias("seg", "s")).filter(F.lower("s").rlike(pattern))
    whole = here.select("rid", F.lit(-1).alias("seg"), F.col("text").alias("s"))
    parts = inner.unionByName(whole).select("rid", "seg", F.explode(terms(F.col("s"))).alias("term")).groupBy("rid", "seg", "term").agg(F.count("*").alias("tf"))
    parts, _ = written(parts, "licence-terms")
    found, _ = written(all_df.join(parts.select("term").distinct(), "term"), "licence-vocabulary")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    weighed = parts.join(found, "term").withColumn("w", F.col("tf") * idf(F.col("df"), F.lit(float(n))))
    weighed, _ = written(weighed.select("rid", "seg", "term", "w"), "licence-weights")
    weight = {t: math.log((n + 1.0) / (df.get(t, 0) + 1.0)) + 1.0 for t in vocabulary}
    weights = [(k, t, c * weight[t] / math.sqrt(sum((a * weight[b]) ** 2 for b, a in x.items()))) for k, x in enumerate(tf) for t, c in x.items()]
    unit = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("term"), F.lit(v).alias("u")) for k, t, v in weights])))
    names = F.array(*[F.lit(name) for name, _, _ in TEMPLATES])
    of_file = F.array(*[F.lit(file) for _, file, _ in TEMPLATES])
    norm = weighed.groupBy("rid", "seg").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(unit), "term").groupBy("rid", "seg", "k").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    score = dots.join(norm, ["rid", "seg"]).select("rid", "seg", F.round(F.col("dot") / F.col("norm"), 6).alias("score"), F.get(names, F.col("k")).alias("license"), ((F.col("seg") == -1) | F.get(of_file, F.col("k"))).alias("file")).filter(F.col("score") >= least)
    best = score.groupBy("rid").agg(
        F.min_by(F.struct("license", "score"), F.struct((F.col("license") == WEAKEST).alias("w"), (-F.col("score")).alias("s"), "license")).alias("own"),
        F.max("file").alias("is_file"),
    )
    return rows.select("rid", "doc_id", "dir"), written(best.select("rid", "own.license", "own.score", "is_file"), "licence-own")[0]


def scan(docs: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """doc_id, dir, license (empty: none), score (of its own), origin (header, file, inherited or none)."""
    rows, own = own_licences(docs, least)
    few = own.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(own) if few else own, "rid", "left")
    by_dir = rows.filter("is_file").groupBy("dir").agg(F.min_by("license", F.struct((F.col("license") == WEAKEST).alias("w"), (-F.col("score")).alias("s"), "license", "doc_id")).alias("inherited"))
    # The ancestors of every directory with the nearest first; documents join the outcome only.
    parts = F.split("dir", "/", -1)
    up = rows.select("dir").distinct().select("dir", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("depth", "anc"))
    near = up.join(by_dir.withColumnRenamed("dir", "anc"), "anc").groupBy("dir").agg(F.min_by("inherited", "depth").alias("inherited"))
    near, _ = written(near, "licence-dirs")
    rows = rows.join(F.broadcast(near) if near.count() <= BROADCAST_ROWS else near, "dir", "left")
    origin = F.when(F.col("license").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return rows.select("doc_id", "dir", F.coalesce("license", "inherited", F.lit("")).alias("license"), F.coalesce("score", F.lit(0.0)).alias("score"), origin.alias("origin"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op7_licenses": op7_licenses}


def _oracle() -> str:
    quoted = lambda x: x.replace("'", "''")
    values = ", ".join(f"({k}, '{name}', {file}, '{quoted(text)}')" for k, (name, file, text) in enumerate(TEMPLATES))
    terms_ = lambda x: f"regexp_extract_all(lower({x}), '{TERM}')"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') || '/' || coalesce(lang, '') AS dir, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(list_distinct({terms_('t')})) AS term FROM d),
f AS MATERIALIZED (SELECT term, ln(((SELECT count(*) FROM d) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM w GROUP BY term),
tpl(k, license, file, t) AS (VALUES {values}),
u0 AS (SELECT k, license, file, term, count(*) AS tf FROM (SELECT k, license, file, unnest({terms_('t')}) AS term FROM tpl) GROUP BY ALL),
u1 AS (SELECT k, license, file, term, tf * coalesce(idf, ln((SELECT count(*) FROM d) + 1.0::DOUBLE) + 1.0::DOUBLE) AS w FROM u0 LEFT JOIN f USING (term)),
u AS MATERIALIZED (SELECT k, license, file, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS u FROM u1),
l AS (SELECT rid, t, string_split(t, chr(10)) AS lines FROM d),
q AS (SELECT rid, lines, list_transform(string_split_regex(array_to_string(list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '{TERM}') THEN x ELSE '' END), chr(10)), '\n\n+'), lambda x: replace(x, chr(10), ' ')) AS paras FROM l),
e AS (SELECT rid, list_distinct(list_concat(lines, paras, flatten(list_transform(paras, lambda x: string_split(regexp_replace(x, '([.!?]){SPACE}', '\1' || chr(10), 'g'), chr(10)))))) AS s FROM q),
seg AS (SELECT rid, seg, s[seg] AS s FROM (SELECT rid, s, unnest(range(1, len(s) + 1)) AS seg FROM e) UNION ALL SELECT rid, -1, t FROM d),
p AS (SELECT rid, seg, term, count(*) AS tf FROM (SELECT rid, seg, unnest({terms_('s')}) AS term FROM seg) GROUP BY ALL),
pw AS MATERIALIZED (SELECT rid, seg, term, tf * idf AS w FROM p JOIN f USING (term)),
nrm AS (SELECT rid, seg, sqrt(sum(w * w)) AS norm FROM pw GROUP BY ALL),
dots AS (SELECT rid, seg, k, license, file, sum(w * u) AS dot FROM pw JOIN u USING (term) GROUP BY ALL),
sc AS (SELECT rid, seg, license, seg = -1 OR file AS file, round(dot / norm, 6) AS score FROM dots JOIN nrm USING (rid, seg) WHERE round(dot / norm, 6) >= {LEAST_COSINE}),
own AS (SELECT *, bool_or(file) OVER (PARTITION BY rid) AS is_file FROM sc QUALIFY row_number() OVER (PARTITION BY rid ORDER BY license = '{WEAKEST}', score DESC, license) = 1),
r AS MATERIALIZED (SELECT d.rid, doc_id, dir, license, score, is_file FROM d LEFT JOIN own USING (rid)),
files AS (SELECT dir, license FROM r WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY license = '{WEAKEST}', score DESC, license, doc_id) = 1),
near AS (SELECT q.dir, files.license AS inherited FROM (SELECT DISTINCT dir FROM r) q JOIN files ON files.dir = '' OR q.dir = files.dir OR starts_with(q.dir, files.dir || '/')
         QUALIFY row_number() OVER (PARTITION BY q.dir ORDER BY length(files.dir) DESC) = 1)
SELECT doc_id, r.dir, coalesce(license, inherited, '') AS license, coalesce(score, 0.0) AS score,
  CASE WHEN license IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM r LEFT JOIN near USING (dir)"""


ORACLE = {"op7_licenses": _oracle()}
