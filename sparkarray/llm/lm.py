"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). The class softmax sums the weights of hashed features of
the history: the word before, the word before that (a skip), and both together. Within a class the softmax has the word's
own bias and a weight for (kind of the word before, word). Classes cluster the commonest words by what they follow; all
further words form one class, in which a word has the share of its count and half of what is seen once goes to the unknown.

Training looks at every training document: counts of all words (a shuffle), counts of (kind before, word) for the common
words, then rounds of gradient updates: each partition walks its documents of the round in batches, with steps
(observed - expected) / (expected + prior) on the rows a batch touches, and the partitions' changes are averaged row by row,
weighted by tokens. Scoring is one pass in sparse batches: features of a token are three row numbers into small tables.
What the driver and the broadcasts hold is bounded by constants (``LOOKUP`` words, the tables); the rarer words of a document
meet their counts in a shuffle join.

Edge cases: null text is empty, which is one end token; a null doc_id hashes as the empty string and trains; repeated rows
count and are scored each; an empty table gives no rows; without any training document all words are unknown; further
columns are ignored.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkarray.llm.common import col, table, written

#: Words looked up without a join; words in the softmax; classes; kinds of the word before.
LOOKUP, HEAD, CLASSES, KINDS = 262_144, 16_384, 32, 64
#: Rows of the hashed tables: word before, skip, both.
ROWS = (2048, 2048, 8192)
ROUNDS, BATCH_TOKENS, PRIOR, RATE = 2, 100_000, 3.0, 0.4
#: Words a worker counts before it hands them on; bytes of text it tokenizes at once.
FLUSH, AT_ONCE = 250_000, 3_000_000
#: Weights stay this small, so that sums of exponentials need no shift.
MOST = 12.0
FOLDS, HELD_OUT = 5, 1

END = 0  # the end token's id; words are 1.. in order of count
SUFFIXES = 64  # ids that stand for words out of the lookup, by a hash of their last bytes


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch, index of each word, and the number of words of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = words.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    doc = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))[full.to_numpy(zero_copy_only=False).astype(bool)] if len(flat) else np.zeros(0, "i8")
    enc = flat.filter(full).dictionary_encode()
    return enc.dictionary, enc.indices.to_numpy(), np.bincount(doc, minlength=len(texts))


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches of some ``AT_ONCE`` bytes of text (column number ``text``), or one longer text."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy())
        at = 0
        while at < b.num_rows:
            to = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_ONCE, side="right")), at + 1)
            yield b.slice(at, to - at)
            at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    for b in slices(batches, 0):
        words, index, _ = tokens(b.column(0))
        for w, c in zip(words.to_numpy(zero_copy_only=False), np.bincount(index, minlength=len(words)).tolist()):
            seen[w] = seen.get(w, 0) + c
        if len(seen) > FLUSH:
            yield out()
            seen.clear()
    yield out()


def _suffix(words: pa.Array) -> np.ndarray:
    """A hash of each word's last two bytes."""
    if not len(words):
        return np.zeros(0, "i8")
    data, off = np.frombuffer(words.buffers()[2], "u1"), np.frombuffer(words.buffers()[1], "i4", len(words) + 1, words.offset * 4)
    last, before = data[off[1:] - 1].astype("i8"), data[np.maximum(off[1:] - 2, off[:-1])]
    return (last * 31 + before) % SUFFIXES


class Vocabulary:
    """The commonest words: id by word, counts by id (0: end)."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.ids = {w: k + 1 for k, w in enumerate(words)}
        self.counts = counts

    def stream(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Token ids of all texts, each followed by its end; text of each token; words out of the lookup as negative ids -1 - k into the words returned."""
        words, index, n = tokens(texts)
        get = self.ids.get
        ids = np.fromiter((get(w, -1 - k) for k, w in enumerate(words.to_numpy(zero_copy_only=False))), "i8", len(words))
        out = np.zeros(len(index) + len(n), "i8")
        at = np.ones(len(out), bool)
        ends = np.cumsum(n + 1) - 1
        at[ends] = False
        out[at] = ids[index]
        return out, np.repeat(np.arange(len(n)), n + 1), words, ends


def history(ids: np.ndarray, doc: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token the ids of the two before it (0 before a text's first), and the kind of the first of these."""
    plain = np.where(ids >= 0, ids, 0)
    low = np.flatnonzero(ids < 0)
    if len(low):
        plain[low] = LOOKUP + 1 + _suffix(words)[-1 - ids[low]]
    one, two = np.zeros_like(plain), np.zeros_like(plain)
    one[1:] = np.where(doc[1:] == doc[:-1], plain[:-1], 0)
    two[2:] = np.where(doc[2:] == doc[:-2], plain[:-2], 0)
    kind = np.where(one < KINDS // 2, one, KINDS // 2 + one % (KINDS // 2))
    return one, two, kind


def features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Rows of the stacked tables, tokens x 3."""
    a = one * 0x9E3779B1 % 0xFFFFFFFB
    b = two * 0x85EBCA6B % 0xFFFFFFFB
    return np.stack([a % ROWS[0], ROWS[0] + b % ROWS[1], ROWS[0] + ROWS[1] + (a * 31 + b) % 0xFFFFFFFB % ROWS[2]], axis=1)


def _kinds(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        m = np.zeros(KINDS * HEAD, "i8")
        for b in slices(batches, 0):
            ids, doc, words, _ = v.stream(b.column(0))
            _, _, kind = history(ids, doc, words)
            head = (ids >= 0) & (ids < HEAD)
            m += np.bincount(kind[head] * HEAD + ids[head], minlength=KINDS * HEAD)
        seen = np.flatnonzero(m.reshape(KINDS, HEAD).any(axis=1))
        yield _table(seen, np.ones(len(seen), "i8"), m.reshape(KINDS, HEAD)[seen].astype("f8"))

    return run


#: Rows of numbers that many tasks give and that are summed: salt (of the task), name of the row, weight, the numbers.
SUMS = "salt int, name int, n long, d binary"
MOST_SALTS = 1024


def _table(name: np.ndarray, n: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    context = TaskContext.get()
    salt = np.full(len(name), context.partitionId() % MOST_SALTS if context else 0, "i4")
    return pa.RecordBatch.from_arrays([pa.array(salt), pa.array(name.astype("i4")), pa.array(n.astype("i8")), pa.array([x.tobytes() for x in d], pa.binary())], ["salt", "name", "n", "d"])


def _sum(kind: str):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        at, back = np.unique(t["name"].to_numpy(), return_inverse=True)
        total, weight = None, np.bincount(back, t["n"].to_numpy(), len(at)).astype("i8")
        for k, x in zip(back.tolist(), (y for c in t["d"].chunks for y in c.to_numpy(zero_copy_only=False))):
            x = np.frombuffer(x, kind)
            if total is None:
                total = np.zeros((len(at), len(x)), kind)
            total[k] += x
        salt = np.full(len(at), key[0].as_py(), "i4")
        return pa.table({"salt": salt, "name": pa.array(at.astype("i4")), "n": weight, "d": pa.array([x.tobytes() for x in total], pa.binary())})

    return run


def summed(rows: DataFrame, kind: str, parts: int) -> pa.Table:
    """Rows of one name added up: first those of some tasks together (``salt``), then these sums, so that no group grows with the tasks."""
    n = rows.rdd.getNumPartitions()
    salts = max(1, min(MOST_SALTS, math.isqrt(n)))
    part = F.col("name") % parts
    first = rows.withColumn("salt", F.col("salt") % salts).groupBy("salt", part).applyInArrow(_sum(kind), SUMS)
    return first.withColumn("salt", F.lit(0)).groupBy("salt", part).applyInArrow(_sum(kind), SUMS).select("name", "n", "d").toArrow()


def numbers(t: pa.Table, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(t["d"].to_pylist()), kind).reshape(len(t), -1)


def classes(m: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class of each head word by k-means over what it follows; the end has class 0, words out of the head the last."""
    x = np.sqrt((m.T + 1e-9) / (m.T + 1e-9).sum(axis=1, keepdims=True))
    k = CLASSES - 2
    out = np.zeros(len(x), "i8")
    if len(x) <= 1:
        return out
    seeds = 1 + np.linspace(0, min(len(x) - 1, 4 * k) - 1, k).astype("i8")
    c = x[seeds].copy()
    weight = counts[: len(x)].astype("f8")
    for _ in range(12):
        near = (x @ c.T).argmax(axis=1)
        for j in range(k):
            own = near == j
            own[0] = False
            if own.any():
                mean = (x[own] * weight[own, None]).sum(axis=0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    out = 1 + near
    out[0] = 0
    return out


def within(m: np.ndarray, cls: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """log10 P(word | class, kind before), kinds x words, by gradient steps on the weights of (kind, word)."""
    bias = np.log(counts[: len(cls)] + 0.5)
    theta = np.zeros_like(m, dtype="f8")
    order = np.argsort(cls, kind="stable")
    starts = np.flatnonzero(np.diff(cls[order], prepend=-1))
    back = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    total = np.add.reduceat(m[:, order], starts, axis=1)[:, back]
    seen = m[:, order]
    t = theta[:, order]
    for step in range(rounds + 1):
        z = bias[order] + t
        top = np.maximum.reduceat(z, starts, axis=1)[:, back]
        p = np.exp(z - top)
        p /= np.add.reduceat(p, starts, axis=1)[:, back]
        if step < rounds:
            t = t + 0.5 * np.clip((seen - total * p - 0.5 * t) / (total * p + 1.0), -2, 2)
    out = np.empty_like(p)
    out[:, order] = np.log10(np.maximum(p, 1e-300))
    return out.astype("f4")


def softmax(w: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities, classes x tokens: each class's weights are a short row that stays near while tokens are looked up."""
    z = np.take(w, rows[:, 0], axis=1)
    for f in (1, 2):
        z += np.take(w, rows[:, f], axis=1)
    z += bias[:, None]
    np.exp(z, out=z)
    z /= np.ones(len(z), z.dtype) @ z
    return z


def _train(vocabulary, cls: np.ndarray, state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        w0, bias = state.value
        w = w0.copy()
        n_row = np.zeros(w.shape[1])
        full = np.full(LOOKUP + 1, CLASSES - 1, "i8")
        full[: len(cls)] = cls
        left: list[tuple[np.ndarray, np.ndarray]] = []

        def step(rows: np.ndarray, y: np.ndarray) -> None:
            p = softmax(w, bias, rows)
            for f in range(3):
                lo, n = sum(ROWS[:f]), ROWS[f]
                r = rows[:, f] - lo
                expected = np.stack([np.bincount(r, q, n) for q in p])
                observed = np.bincount(y * n + r, minlength=n * CLASSES).reshape(CLASSES, n)
                own = w[:, lo : lo + n]
                own += RATE * np.clip((observed - expected) / (expected + PRIOR), -1, 2)
                np.clip(own, -MOST, MOST, out=own)
                n_row[lo : lo + n] += np.bincount(r, minlength=n)

        for b in slices(batches, 0):
            ids, doc, words, _ = v.stream(b.column(0))
            one, two, _ = history(ids, doc, words)
            left.append((features(one, two), np.where(ids >= 0, full[np.maximum(ids, 0)], CLASSES - 1)))
            rows, y = (np.concatenate(x) for x in zip(*left))
            whole = len(y) - len(y) % BATCH_TOKENS
            for k in range(0, whole, BATCH_TOKENS):
                step(rows[k : k + BATCH_TOKENS], y[k : k + BATCH_TOKENS])
            left[:] = [(rows[whole:], y[whole:])]
        if left and len(left[0][1]):
            step(*left[0])
        at = np.flatnonzero(n_row)
        yield _table(at, n_row[at], ((w[:, at] - w0[:, at]) * n_row[at]).T.astype("f4"))

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<string>, counts array<long>"


def _score(vocabulary, cls: np.ndarray, model, totals: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        w, bias, inner = model.value
        full = np.full(LOOKUP + 1, CLASSES - 1, "i8")
        full[: len(cls)] = cls
        counts = np.zeros(LOOKUP + 1)
        counts[: len(v.counts)] = v.counts
        base = np.log10((counts + 0.5) / totals["base"])
        tail = np.log10(np.maximum(np.where(counts > 1, counts, 0.5), 0.5) / totals["tail"])
        known = counts > 0
        for b in slices(batches, 2):
            ids, doc, words, _ = v.stream(b.column(2))
            one, two, kind = history(ids, doc, words)
            rows = features(one, two)
            seen = ids >= 0
            at = np.maximum(ids, 0)
            y = np.where(seen, full[at], CLASSES - 1)
            lp = np.empty(len(ids))
            for k in range(0, len(ids), BATCH_TOKENS):
                part = slice(k, k + BATCH_TOKENS)
                p = softmax(w, bias, rows[part])
                lp[part] = np.log10(np.maximum(p[y[part], np.arange(p.shape[1])], 1e-30))
            head = seen & (ids < len(cls))
            lp[head] += inner[kind[head], ids[head]]
            rest = seen & ~head
            lp[rest] += tail[ids[rest]]
            n = b.num_rows
            low = np.flatnonzero(~seen)
            pair, c = np.unique(doc[low] * (len(words) + 1) + (-1 - ids[low]), return_counts=True)
            d, k = pair // (len(words) + 1), pair % (len(words) + 1)
            cuts = np.searchsorted(d, np.arange(n + 1)).astype("i4")
            names = words.take(pa.array(k))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()), b.column(1), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc, seen & known[at], n).astype("i8")),
                    pa.array(np.bincount(doc[seen], base[at[seen]], n)), pa.array(np.bincount(doc, lp, n)),
                    pa.ListArray.from_arrays(pa.array(cuts), names), pa.ListArray.from_arrays(pa.array(cuts), pa.array(c, pa.int64())),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "counts"],
            )

    return run


def commonest(counts: DataFrame, most: int) -> pa.Table:
    """The commonest words with their counts, at most so many, in order: all words above some count.

    Counts are binned (each below 256 by itself, then 32 bins for each doubling); the bins' sizes name the lowest bin that fits
    whole, so nothing is sorted on the cluster and what the driver takes is bounded.
    """
    binned = counts.withColumn("bin", F.when(F.col("c") < 256, F.col("c")).otherwise(F.floor(32 * F.log2(F.col("c").cast("double")))))
    left, least = most, 2**62
    for r in sorted(binned.groupBy("bin").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.bin):  # a bin for each power's part
        if r.n > left:
            break
        left, least = left - r.n, r.bin
    got = binned.filter(F.col("bin") >= least).select("word", "c").toArrow()
    return got.sort_by([("c", "descending"), ("word", "ascending")])


def score_documents(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    fold = F.crc32(F.coalesce(col("doc_id").cast("string"), F.lit(""))) % FOLDS
    rows = docs.select(col("doc_id").alias("doc_id"), (fold == HELD_OUT).alias("held_out"), fold.cast("int").alias("fold"), col("text").alias("text"))
    train = rows.filter("not held_out")

    n_docs = train.count()
    counts, _ = written(train.select("text").mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    total, distinct, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0))).first()
    total, distinct = total + n_docs, distinct + (n_docs > 0)
    top = commonest(counts, LOOKUP)
    vocabulary = Vocabulary(top["word"].to_pylist(), np.concatenate([[n_docs], top["c"].to_numpy().astype("i8")]))
    shared = sc.broadcast(vocabulary)
    n_head = min(HEAD, len(vocabulary.counts))

    m = np.zeros((KINDS, n_head))
    got = summed(train.select("text").mapInArrow(_kinds(shared), SUMS), "f8", KINDS)
    if len(got):
        m[got["name"].to_numpy()] = numbers(got, "f8")[:, :n_head]
    cls = classes(m, vocabulary.counts)
    inner = within(m, cls, vocabulary.counts[:n_head].astype("f8"))

    in_tail = float(total - vocabulary.counts[:n_head].sum())
    seen = np.bincount(cls, vocabulary.counts[:n_head], CLASSES)
    seen[CLASSES - 1] += in_tail
    bias = np.log((seen + 0.5) / (seen + 0.5).sum()).astype("f4")
    w = np.zeros((CLASSES, sum(ROWS)), "f4")
    folds = [f for f in range(FOLDS) if f != HELD_OUT]
    for r in range(ROUNDS):
        state = sc.broadcast((w, bias))
        part = train.filter(F.col("fold").isin(folds[r::ROUNDS])).select("text")
        change = summed(part.mapInArrow(_train(shared, cls, state), SUMS), "f4", 64)
        if len(change):
            w[:, change["name"].to_numpy()] += (numbers(change, "f4") / change["n"].to_numpy()[:, None]).T

    # Of words out of the head: those seen once give half of their mass to the unknown.
    singles = float(once - (vocabulary.counts[1:n_head] == 1).sum())
    half = max(0.5 * singles, 0.5)
    totals = {"base": total + 0.5 * (distinct + 1), "tail": in_tail - 0.5 * singles + half}
    model = sc.broadcast((w, bias, inner))
    scored, path = written(rows.select("doc_id", "held_out", "text").mapInArrow(_score(shared, cls, model, totals), SCORED).withColumn("rid", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("rid", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    c = F.coalesce("c", F.lit(0))
    met = rare.join(counts, "word", "left").groupBy("rid").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.col("n") * F.log10((c + 0.5) / totals["base"])).alias("b"),
        F.sum(F.col("n") * F.log10(F.when(c == 0, half).when(c == 1, 0.5).otherwise(c.cast("double")) / totals["tail"])).alias("s"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    out = scored.drop("words", "counts").join(met, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"),
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_lm": op3_lm}
ORACLE: dict[str, str] = {}
