"""Near-duplicate documents by DartMinHash signatures and banded joining.

Shingles are five words; a shingle's weight is how often it occurs in the text. An element of weight w owns the region
[0, w) x [0, inf) of weight and rank. Hashes throw darts into it, one Poisson process of rate one for each unit of weight,
the same for every document; a document sees those below its weights and below rank ``DARTS / total weight``, about
``DARTS`` of them whatever its length. Each dart falls on one of ``K`` coordinates, of which the earliest dart is kept: two
documents agree on a coordinate with the probability of their weighted Jaccard similarity. Bands of ``ROWS`` coordinates are
the join keys (a band with a coordinate that no dart hit is silent).

Equal texts are one class from the start. In each band bucket all members are first compared with the least one, whose
shingles go once to some hundreds of members; what that leaves apart is compared in full, block by block, signatures first
and then shingles, and only spanning links leave a task. No pairs of a group are emitted, none are left out. Similarity is computed from the whole weighted shingle sets (32-bit
hashes); links at ``SIMILARITY`` or more join components, of which the least doc_id is kept.

Edge cases: null or word-less texts are near nothing but equal texts (all of these are equal); texts of under five words
have one shingle, all their words; a null doc_id sorts last; repeated rows are copies, one stays; an empty table gives no
rows; further columns are kept by ``keep_one``, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkarray.llm.common import col, cols, drop_table, free_name, joined, recorded, release, table, written
from sparkarray.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
K, ROWS, DARTS = 96, 4, 384
BANDS = K // ROWS
#: Signatures this far below the similarity (four standard errors) are not worth an exact look.
SLACK, BLOCK, AT_ONCE = 0.165, 512, 400
#: Pairs of leaders and members that are compared at once, and such groups of a task.
GROUP, GROUPS = 2000, 2
BROADCAST_ROWS = 200_000

_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document number and 64-bit hash of every shingle, in order of the documents."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    enc = words.flatten().dictionary_encode()
    names = enc.dictionary.to_numpy(zero_copy_only=False)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, names), "u8", len(names))
    full = np.fromiter(map(bool, names), bool, len(names))
    index = enc.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    some = full[index] if len(index) else np.zeros(0, bool)
    h, doc = hashed[index[some]], doc[some]
    count = np.bincount(doc, minlength=len(texts))
    if len(h) >= n:
        s = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            s = s * _P + h[k : len(h) - n + 1 + k]
        same = doc[: len(s)] == doc[n - 1 :]
        s, d = mix(s[same]), doc[: len(same)][same]
    else:
        s, d = np.zeros(0, "u8"), np.zeros(0, "i8")
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        start = np.cumsum(count) - count
        extra = []
        for i in short:
            x = int(count[i])
            for w in h[start[i] : start[i] + count[i]].tolist():
                x = (x * int(_P) + w) & 0xFFFFFFFFFFFFFFFF
            extra.append(x)
        s, d = np.concatenate([s, mix(np.array(extra, "u8"))]), np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        s, d = s[order], d[order]
    return d, s


def units(doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit weights: the c-th occurrence of a shingle in a document is an element of its own."""
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    nth = (np.arange(len(s)) - first).astype("u8")
    return doc, np.where(nth > 0, mix(s + nth * _P), s)


def signatures(doc: np.ndarray, unit: np.ndarray, n_docs: int, k: int = K, darts: int = DARTS) -> np.ndarray:
    """n_docs x k of 32-bit dart names; 0: no dart."""
    weight = np.bincount(doc, minlength=n_docs)
    theta = darts / np.maximum(weight, 1)
    rank = np.zeros(len(unit))
    name, theta = mix(unit ^ np.uint64(0xD1B54A32D192ED03)), theta[doc]
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(name):
        # The next dart of each unit lies an exponential step higher.
        u = ((name >> np.uint64(11)).astype("f8") + 0.5) / 2.0**53
        near = u >= np.exp(rank - theta)
        name, rank, theta, doc = name[near], rank[near] - np.log(u[near]), theta[near], doc[near]
        seen.append((doc, rank, name))
        name = mix(name + _P)
    doc, rank, name = (np.concatenate(x) for x in zip(*seen))
    at = doc * k + (mix(name ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(k)).astype("i8")
    order = np.lexsort((rank, at))
    at, name = at[order], name[order]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    out = np.zeros(n_docs * k, "u4")
    out[at[first]] = np.maximum((name[first] >> np.uint64(32)).astype("u4"), 1)
    return out.reshape(n_docs, k)


SIGNED = "doc_id long, k1 long, k2 long, n int, sig binary, units binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
        doc, unit = units(*shingles(b.column(3)))
        sig = signatures(doc, unit, b.num_rows)
        count = np.bincount(doc, minlength=b.num_rows)
        # Sorted 32-bit names of the units, document by document.
        low = (unit >> np.uint64(20)).astype("u4")
        low = low[np.lexsort((low, doc))]
        ends = np.concatenate([[0], np.cumsum(count)]) * 4
        data = low.tobytes()
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), b.column(1), b.column(2), pa.array(count.astype("i4")), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([data[i:j] for i, j in zip(ends, ends[1:])], pa.binary())],
            ["doc_id", "k1", "k2", "n", "sig", "units"],
        )


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "u4").reshape(-1, BANDS, ROWS)
        key = np.full(sig.shape[:2], 7, "u8") + np.arange(BANDS, dtype="u8") * _P
        for r in range(ROWS):
            key = mix(key * _P + sig[:, :, r])
        row, band = np.nonzero((sig > 0).all(axis=2))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(key[row, band].view("i8"))], ["cls", "bucket"])


def _stars(similarity: float):
    def run(key: tuple[pa.Scalar, ...], pairs: pa.Table, leaders: pa.Table) -> pa.Table:
        """Links of leaders to members; pairs: g, a, b, units of b; leaders: h, leader, set, each once."""
        a = pairs["a"].to_numpy()
        order = np.argsort(a, kind="stable")
        sets = [np.frombuffer(x, "u4") for x in pairs["units"].to_pylist()]
        own = dict(zip(leaders["leader"].to_pylist(), (np.frombuffer(x, "u4") for x in leaders["set"].to_pylist())))
        n = np.array([len(x) for x in sets], "i8")
        good = np.zeros(len(a), bool)
        cuts = np.flatnonzero(np.diff(a[order], prepend=a[order[0]] - 1)) if len(a) else []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(a))):
            u = own[int(a[order[lo]])]
            js = order[lo:hi]
            js = js[(np.minimum(n[js], len(u)) >= similarity * np.maximum(n[js], len(u))) & (n[js] > 0)]
            for k in range(0, len(js), AT_ONCE):
                some = js[k : k + AT_ONCE]
                flat = np.concatenate([sets[j] for j in some])
                hit = u[np.minimum(np.searchsorted(u, flat), len(u) - 1)] == flat
                both = np.add.reduceat(hit, np.cumsum(n[some]) - n[some], dtype="i8")
                good[some] = both >= similarity * (n[some] + len(u) - both)
        keep = pa.array(good)
        return pa.table({"a": pairs["a"].filter(keep), "b": pairs["b"].filter(keep)})

    return run


def _compare(similarity: float):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _, bi, bj = (x.as_py() for x in key)
        block, cls, comp = (t[c].to_numpy() for c in ("block", "cls", "comp"))
        units_ = [np.frombuffer(x, "u4") for x in t["units"].to_pylist()]
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "u4").reshape(-1, K)
        a, b = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        names, parent = np.unique(comp, return_inverse=True)
        parent = np.arange(len(names))[parent]
        root = np.arange(len(names))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out_a, out_b = [], []
        n = np.array([len(x) for x in units_])
        for i in a:
            mine = sig[i]
            alike = np.minimum(n[b], n[i]) >= similarity * np.maximum(n[b], n[i])
            js = b[alike]
            agree = ((sig[js] == mine) & (mine > 0)).sum(axis=1) / np.maximum(((sig[js] > 0) | (mine > 0)).sum(axis=1), 1)
            js = js[agree >= similarity - SLACK]
            here = find(parent[i])
            js = np.array([j for j in js if find(parent[j]) != here], "i8")
            if not len(js):
                continue
            # Exact similarities of this text to all that are left, at once.
            flat = np.concatenate([units_[j] for j in js])
            own = units_[i]
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(hit, np.cumsum(n[js]) - n[js], dtype="i8")
            for j in js[both >= similarity * (n[js] + n[i] - both)]:
                x, y = find(parent[i]), find(parent[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out_a.append(cls[i])
                    out_b.append(cls[j])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def text_key(text: Column) -> list[Column]:
    """128 bits of a text (null: empty)."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t), F.xxhash64(F.lit(23), t, F.lit("s"))]


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """rid, doc_id, k1, k2 (of the text), class_id (least doc_id of the equal texts), component_id, kept: one row for each document."""
    k1, k2 = text_key(col("text"))
    signed = docs.select(col("doc_id").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), col("text").alias("text")).mapInArrow(_sign, SIGNED)
    signed, _ = written(signed.withColumn("rid", F.monotonically_increasing_id()), "minhash-signed")
    classes = signed.groupBy("k1", "k2").agg(F.min("rid").alias("cls"), F.min("doc_id").alias("class_id"), F.any_value("sig").alias("sig"), F.count("*").alias("copies"), F.min_by("rid", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "rid")).alias("first"))
    classes, _ = written(classes, "minhash-classes")
    buckets = classes.select("cls", "sig").mapInArrow(_band_keys, "cls long, bucket long")
    least = buckets.groupBy("bucket").agg(F.min("cls").alias("leader"), F.count("*").alias("m")).filter("m > 1").select("bucket", "leader")
    members, members_path = written(buckets.join(least, "bucket"), "minhash-buckets")
    wanted, _ = written(members.select("cls").distinct(), "minhash-wanted")
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    sets, _ = written(signed.select(F.col("rid").alias("cls"), "sig", "units").join(small, "cls"), "minhash-sets")
    pairs = members.filter("cls <> leader").select(F.col("leader").alias("a"), F.col("cls").alias("b")).distinct()
    pairs, _ = written(pairs, "minhash-pairs")
    # A leader's set goes once to each group of some hundred members; leaders of very many have several groups.
    many = pairs.groupBy("a").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK).select("a", F.ceil(F.col("m") / BLOCK).cast("int").alias("salts"))
    many, _ = written(many, "minhash-leaders")
    many = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    n_groups = max(1, pairs.count() // GROUP)
    group = lambda salt: F.pmod(F.xxhash64("a", salt), F.lit(n_groups)).alias("g")
    salted = pairs.join(many, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int"))
    members_ = salted.join(sets.select(F.col("cls").alias("b"), "units"), "b").select(group(F.col("salt")), "a", "b", "units")
    leaders = pairs.select("a").distinct().join(many, "a", "left").join(sets.select(F.col("cls").alias("a"), "units"), "a")
    leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).select(group(F.col("salt")).alias("h"), F.col("a").alias("leader"), F.col("units").alias("set")).dropDuplicates(["h", "leader"])
    parts = max(1, n_groups // GROUPS)
    stars, _ = written(members_.repartition(parts, "g").groupBy("g").cogroup(leaders.repartition(parts, "h").groupBy("h")).applyInArrow(_stars(similarity), "a long, b long"), "minhash-links")
    # Members by the least that they are linked to, followed once: enough to tell most buckets whole.
    low = stars.groupBy("b").agg(F.min("a").alias("a"))
    low = low.join(low.select(F.col("b").alias("a"), F.col("a").alias("up")), "a", "left").select(F.col("b").alias("cls"), F.coalesce("up", "a").alias("root"))
    labelled = members.join(low, "cls", "left").select("bucket", "cls", F.coalesce("root", "cls").alias("comp"))
    labelled, _ = written(labelled, "minhash-apart")
    apart = labelled.groupBy("bucket").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi and m > 2").select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    rest = labelled.join(apart, "bucket").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    dealt = rest.join(sets, "cls").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("bucket", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"), "block", "cls", "comp", "sig", "units")
    more, _ = written(dealt.groupBy("bucket", "bi", "bj").applyInArrow(_compare(similarity), "a long, b long"), "minhash-links")
    comps = components(stars.unionByName(more))
    drop_table(docs.sparkSession, members_path)
    slim = classes.select("k1", "k2", "cls", "class_id", "copies", "first").join(comps.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    slim, _ = written(slim, "minhash-components")
    best = slim.groupBy("root").agg(F.min(F.struct(F.coalesce("class_id", F.lit(2**63 - 1)).alias("d"), "class_id", "cls")).alias("b")).select("root", F.col("b.class_id").alias("component_id"), F.col("b.cls").alias("best"))
    # Of the best class, the first row with the least doc_id is kept.
    slim = slim.join(best, "root").select("k1", "k2", "class_id", "component_id", F.when(F.col("cls") == F.col("best"), F.col("first")).alias("first"), "copies")
    slim, _ = written(slim, "minhash-outcome")
    rows = joined(signed.select("rid", "doc_id", "k1", "k2"), slim, ["k1", "k2"], "copies")
    return rows.select("rid", "doc_id", "k1", "k2", "class_id", "component_id", F.coalesce(F.col("rid") == F.col("first"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, with its own columns."""
    with recorded() as made:
        found, path = written(groups(docs, similarity).select("doc_id", "k1", "k2", "kept"), "minhash-groups")
    release(docs.sparkSession, set(made) - {path})
    by = found.groupBy("doc_id", "k1", "k2").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows"))
    gone, _ = written(by.filter("not kept or rows > 1"), "minhash-gone")
    n1, n2, nd, nk, nr = free_name(docs, "mh_k1", "mh_k2", "mh_doc", "mh_kept", "mh_rows")
    k1, k2 = text_key(col("text"))
    own = docs.select(*cols(docs.columns), k1.alias(n1), k2.alias(n2), F.coalesce(col("doc_id"), F.lit(-(2**63))).alias(nd))
    here = gone.select(F.col("k1").alias(n1), F.col("k2").alias(n2), F.coalesce("doc_id", F.lit(-(2**63))).alias(nd), F.col("kept").alias(nk), F.col("rows").alias(nr))
    out = own.join(F.broadcast(here) if gone.count() <= BROADCAST_ROWS else here, [n1, n2, nd], "left").filter(F.coalesce(F.col(nk), F.lit(True)))
    if gone.filter("kept").limit(1).count():
        # The same document more than once, row for row: any one of them stays.
        out = out.filter(F.col(nr).isNull()).unionByName(out.filter(F.col(nr).isNotNull()).dropDuplicates([n1, n2, nd]))
    return out.select(*cols(docs.columns))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "component_id", "kept")


QUERIES = {"op5_minhash": op5_minhash}
ORACLE: dict[str, str] = {}
