"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers; a match that fails its check is dropped.
Each such string is a protected entity. For a term (a word of a document that holds the entity, wherever it stands there) the
corpus gives p(entity) and p(entity | term) over whole documents; by the information-theoretic view the term discloses the
share PMI(term; entity) / IC(entity) of the entity's information. Where that share reaches ``DISCLOSURE``, and entity and
term share at least ``SUPPORT`` different texts, the term is disclosing: each of its occurrences, in every document, is
generalised if the term is common, else removed. Words that touch a pattern match are no terms.

All documents take part in the frequencies. Two bounds that lose nothing keep the counting small: an entity in under
``SUPPORT`` different texts discloses nothing, and as p(entity | term) is n_both / n_term with n_both at most n_entity, only
terms of at most n_entity^DISCLOSURE * n^(1 - DISCLOSURE) documents can reach the share. Equal texts are counted once with
their number, and all counts are partial aggregates, so a frequent entity or term never meets in one task. What a task holds
of one text is its entities times those of its words that pass the bounds.

Edge cases: null text is empty; repeated rows give the same spans; an empty table gives no rows; matches are leftmost and
do not overlap within their kind, kinds may overlap; offsets are code points; further columns are ignored by the query and
kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkarray.llm.common import SPACE, col, cols, table, written

#: Possessive where that can't change a match: no backtracking, no recursion on long runs. A match that can't begin at a
#: run's start can't begin within the run, so only starts (or ends of a match before) are tried; a card has 16 digits at least.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:(?<![0-9])|\G)(?=(?:[0-9][\x20-]?){15}[0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Different texts that hold both an entity and a term, at least; the share of an entity's information.
SUPPORT, DISCLOSURE = 3, 0.9
#: The share of documents above which a disclosing term is generalised, not removed.
COMMON = 0.001
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _spans(hits: str, gaps: str, kind: str, good) -> Column:
    """Array of (kind, start, end, m) of the matches that pass ``good``: what lies between matches gives their places."""
    steps = F.transform(hits, lambda m, i: F.struct(m.alias("m"), F.length(F.get(gaps, i)).alias("gap")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,m:string>>").alias("out"))
    walked = F.aggregate(
        steps,
        zero,
        lambda a, x: F.struct((a["at"] + x["gap"] + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), x["m"].alias("m")))).alias("out")),
        lambda a: a["out"],
    )
    kept = F.filter(walked, lambda x: good(x["m"]))
    return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), x["m"].alias("m")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    each = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & F.when(F.length(_digits(m)).between(16, 19), _luhn(m)).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def base_spans(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``base``: the pattern spans by kind as listed, then start."""
    t = F.col(text)
    digit = t.rlike("[0-9]")
    may = {"email": F.contains(t, F.lit("@")), "ip": digit & t.rlike(r"[0-9]\.[0-9]"), "card": digit & t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": F.contains(t, F.lit("+"))}
    keep = rows.columns
    none = F.array().cast("array<string>")
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        rows = rows.withColumn(f"_h_{kind}", F.when(may[kind], F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none))
        rows = rows.withColumn(f"_g_{kind}", F.when(F.size(f"_h_{kind}") > 0, F.split(t, pattern, -1)).otherwise(none))
    return rows.select(*cols(keep), F.concat(*[_spans(f"_h_{k}", f"_g_{k}", k, CHECKS[k]) for k in KINDS]).alias("base"))


#: Stands for a pattern match while a text is cut into words.
HOLE = "\x00"
ADDED = "array<struct<kind:string,start:int,end:int>>"
#: A list of terms, entities or treated texts is broadcast up to so many rows.
BROADCAST_ROWS = 100_000


def few(df: DataFrame) -> DataFrame:
    """A written table, as a broadcast where its rows, now counted, allow that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with ``mark(kind)`` for each span (start, end, kind; in order of start); of overlapping ones the first counts."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        spans,
        zero,
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), mark(x["kind"]))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )


def by_start(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def scanned(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """One row for each document: kept columns, key of the text, base spans; where it has any, its other words."""
    t = base_spans(docs.select(*keep, F.coalesce(col("text"), F.lit("")).alias("_text")), "_text")
    holes = replaced(F.col("_text"), F.array_sort(by_start(F.col("base"))), lambda _: F.lit(HOLE))
    words = F.filter(F.array_distinct(F.split(F.lower(holes), SPACE)), lambda w: (w != "") & ~F.contains(w, F.lit(HOLE)))
    rows = t.select(*[c for c in t.columns if c != "_text"], F.md5("_text").alias("key"), F.when(F.size("base") > 0, words).alias("words"))
    return written(rows, "pii-spans")[0]


def most_documents(n_entity: Column, n: Column) -> Column:
    """A term of more documents can't disclose; a little over the bound, for rounding."""
    return F.pow(n_entity.cast("double"), F.lit(DISCLOSURE)) * F.pow(n, F.lit(1 - DISCLOSURE)) * 1.000001


def disclosing(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, kind) of the disclosing terms, as a written table.

    Probabilities are over documents; support is over different texts, so that copies alone prove nothing.
    """
    texts = rows.filter(F.size("base") > 0).groupBy("key").agg(F.count("*").alias("copies"), F.any_value(F.array_distinct(F.transform("base", lambda s: s["m"]))).alias("entities"), F.any_value("words").alias("words"))
    texts, _ = written(texts, "pii-texts")
    holds = texts.select("key", "copies", F.explode("entities").alias("entity"))
    entities = holds.groupBy("entity").agg(F.count("*").alias("n_texts"), F.sum("copies").alias("n_entity")).filter(F.col("n_texts") >= SUPPORT)
    entities, _ = written(entities.select("entity", "n_entity"), "pii-entities")
    holds, _ = written(holds.join(few(entities), "entity"), "pii-holders")
    holders, _ = written(holds.select("key").distinct(), "pii-keys")
    own, _ = written(texts.join(few(holders), "key").select("key", F.explode("words").alias("term")), "pii-words")
    wanted, _ = written(own.groupBy("term").agg(F.count("*").alias("m")).filter(F.col("m") >= SUPPORT).select("term"), "pii-terms")
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(col("text"), F.lit(""))), SPACE))).alias("term"))
    if wanted.count() <= BROADCAST_ROWS:
        n_term = words.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count("*").alias("n_term"))
    else:  # counted before the join: what the join sees is a row for each word, not for each of its occurrences
        n_term = words.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term")
    n = F.lit(float(docs.count()))
    largest = entities.agg(F.max("n_entity")).first()[0] or 0
    rare, _ = written(n_term.filter(F.col("n_term") <= most_documents(F.lit(largest), n)), "pii-rare")
    pairs = own.join(few(rare), "term").join(holds, "key").filter(F.col("n_term") <= most_documents(F.col("n_entity"), n))
    pairs = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_texts"), F.sum("copies").alias("n_both")).filter(F.col("n_texts") >= SUPPORT)
    pmi = F.log2(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    ic = F.log2(n / F.col("n_entity"))
    share = F.when(ic > 0, pmi / F.when(ic > 0, ic).otherwise(1.0)).otherwise(0.0)
    kind = F.when(F.col("n_term") / n > COMMON, "general").otherwise("term")
    return written(pairs.filter(share >= DISCLOSURE).select("term", kind.alias("kind")).distinct(), "pii-disclosing")[0]


def _quoted(form: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(form, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def added_spans(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """For each text that has any, what the method adds: key, added (kind, start, end) in order of kind and start."""
    strong = disclosing(rows, docs)
    text = F.coalesce(col("text"), F.lit(""))
    forms = docs.select(F.md5(text).alias("key"), F.explode(F.array_distinct(F.split(text, SPACE))).alias("form"))
    forms = forms.join(few(strong), F.lower("form") == F.col("term")).groupBy("key").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("form"))).alias(k) for k in ("general", "term")])
    forms, _ = written(forms, "pii-forms")
    met = docs.select(F.md5(text).alias("key"), text.alias("text")).join(few(forms), "key").groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("text", "general", "term")])
    none = F.array().cast("array<string>")
    for k in ("general", "term"):
        pattern = F.concat(F.lit(r"(?<![^\x20\x09-\x0D])(?:"), F.array_join(F.transform(k, _quoted), "|"), F.lit(r")(?![^\x20\x09-\x0D])"))
        met = met.withColumn(f"h_{k}", F.when(F.size(k) > 0, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(none)).withColumn(f"g_{k}", F.when(F.size(k) > 0, F.split("text", pattern, -1)).otherwise(none))
    spans = F.concat(*[_spans(f"h_{k}", f"g_{k}", k, lambda _: F.lit(True)) for k in ("general", "term")])
    return written(met.select("key", F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("added")), "pii-added")[0]


def with_added(rows: DataFrame, added: DataFrame) -> DataFrame:
    """Adds ``added`` (none: an empty list) by the key of a row's text."""
    return rows.join(few(added), "key", "left").withColumn("added", F.coalesce("added", F.array().cast(ADDED)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every base span replaced by its kind, disclosing terms generalised or removed; all else stays."""
    added = added_spans(docs, scanned(docs, []))
    # The documents' own columns stand in a struct, out of the way of the names used here.
    t = docs.select(F.struct(*cols(docs.columns)).alias("own"), F.coalesce(col("text"), F.lit("")).alias("text"))
    t = with_added(base_spans(t, "text").withColumn("key", F.md5("text")), added)
    mark = lambda k: F.when(k == "term", "").when(k == "general", "[WORD]").otherwise(F.concat(F.lit("["), F.upper(k), F.lit("]")))
    spans = F.array_sort(F.concat(by_start(F.col("base")), by_start(F.col("added"))))
    new = F.when((F.size("base") > 0) | (F.size("added") > 0), replaced(F.col("text"), spans, mark)).otherwise(F.col("own")["text"])
    return t.select(*[(new if c == "text" else F.col("own")[c]).alias(c) for c in docs.columns])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = scanned(docs, [col("doc_id").alias("doc_id")])
    out = with_added(rows.select("doc_id", "key", "base"), added_spans(docs, rows))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _joined(F.col("base"))
    every = F.concat_ws(",", F.when(F.size("base") > 0, base), F.when(F.size("added") > 0, _joined(F.col("added"))))
    return out.select("doc_id", *[of(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


QUERIES = {"op8_pii": op8_pii}
ORACLE: dict[str, str] = {}
