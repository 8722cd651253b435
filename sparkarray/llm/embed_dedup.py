"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one representative for each group.

Equal vectors are one class from the start, with the number of its copies. Spherical k-means, fitted on a bounded sample
(``SAMPLE`` vectors, those with the least hash of their components), gives the cells; every class goes to its nearest cell
and, as a visitor, to each cell whose border with that is closer than a margin. A pair is lost only if the border between
its two cells lies further than the margin from both vectors, so half the distance of two unit vectors at the least cosine
(``exact_margin``, 0.158 at 0.95) loses nothing. A smaller margin is taken where the sample shows that the vectors spread
over many directions: if differences spread like the vectors do, their part in any one direction has at most the deviation
of the widest direction, and a margin of two such deviations means that a lost pair has four (``margin_of``; the exact one
is never exceeded). The tests measure recall against brute force on round and on flat data.
A cell is dealt into blocks of bounded size, and block pairs are the unit of work: one product in double precision, of
which only each vector's number of links and its least linked relative leave the task.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; shorter vectors count as padded with zeros; repeated rows link with each other; different vectors may share a
vec_id; a null vec_id never names a component: where all of a component's ids are null its component_id is null and its rows
are kept; an empty table gives no rows; further columns are ignored, whatever their names.
"""


import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkarray.llm.common import col, table, written
from sparkarray.llm.components import components

COSINE, SAMPLE, CELL, MOST_CELLS, BLOCK = 0.95, 16_384, 512, 2048, 4096
#: Deviations of a difference along its widest direction that a margin covers, on either side of the border.
DEVIATIONS = 2.0


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Unit rows in double precision, padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    n = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, "i8")
    if len(n) and (n == dim).all():
        x = flat.reshape(-1, dim)
    else:
        x = np.zeros((len(column), dim))
        x[np.arange(dim) < n[:, None]] = flat
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def exact_margin(cosine: float) -> float:
    return math.sqrt(max(2 - 2 * cosine, 0.0)) / 2


def margin_of(x: np.ndarray, cosine: float) -> float:
    """From the sample's widest direction: its share of all variance is that of a difference's square."""
    if len(x) < 2:
        return exact_margin(cosine)
    spread = np.linalg.eigvalsh(np.cov(x, rowvar=False).reshape(x.shape[1], x.shape[1]))
    share = spread[-1] / max(spread.sum(), 1e-300)
    return exact_margin(cosine) * min(1.0, DEVIATIONS * 2 * math.sqrt(max(share, 0.0)))


def _assign(centres: np.ndarray, margin: float):
    gap = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                s = matrix(part.column(2), centres.shape[1]) @ centres.T
                home = s.argmax(axis=1)
                here = (s.max(axis=1)[:, None] - s) <= margin * gap[home]
                here[np.arange(len(home)), home] = True
                row, cell = np.nonzero(here)
                take = pa.array(row)
                visits = pa.array([np.flatnonzero(h).astype("i4") for h in here], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype("i4")), part.column(0).take(take), part.column(1).take(take), pa.array(home[row].astype("i4")), visits.take(take), part.column(2).take(take)],
                    ["cell", "cls", "copies", "home", "visits", "v"],
                )

    return run


def _compare(cosine: float, dim: int, k: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        cell, bi, bj = (x.as_py() for x in key)
        block = t["block"].to_numpy()
        cls, copies, home = (t[c].to_numpy() for c in ("cls", "copies", "home"))
        u = matrix(t["v"].combine_chunks(), dim)
        mine = home == cell
        a, b = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        none = pa.table({"cls": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(a) or not len(b):
            return none
        hits = [np.nonzero(u[a[k : k + 512]] @ u[b].T >= cosine) for k in range(0, len(a), 512)]
        i = a[np.concatenate([x + 512 * k for k, (x, _) in enumerate(hits)])]
        j = b[np.concatenate([y for _, y in hits])]
        keep = mine[i] | mine[j]
        if bi == bj:
            keep &= i < j
        i, j = i[keep], j[keep]
        # A pair with two homes counts in the lesser one, or in the other if only that has both.
        visits = t["visits"].combine_chunks()
        at, flat = visits.offsets.to_numpy(), visits.flatten().to_numpy()
        guest = np.where(mine[i], j, i)
        host = np.where(mine[i], i, j)
        other = home[guest]
        goes = np.sort(np.repeat(np.arange(len(home)), np.diff(at)) * k + flat)
        asked = host * k + other
        there = np.searchsorted(goes, asked)
        keep = (other >= cell) | (goes[np.minimum(there, len(goes) - 1)] != asked)
        i, j = i[keep], j[keep]
        if not len(i):
            return none
        links = np.bincount(i, copies[j], len(home)) + np.bincount(j, copies[i], len(home))
        label = np.arange(len(home))
        order = np.argsort(cls, kind="stable")
        rank = np.empty(len(cls), "i8")
        rank[order] = np.arange(len(cls))
        label = rank.copy()
        while True:
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            low = low[order][low]
            if (low == label).all():
                break
            label = low
        has = np.flatnonzero(links)
        return pa.table({"cls": cls[has], "links": links[has].astype("i8"), "root": cls[order][label[has]]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, margin: float | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select(col(vec_id).alias("vec_id"), col(embedding).cast("array<double>").alias("v"), col(embedding).alias("raw"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    # 128 bits of the vector name its class; a vector that can't link has none.
    keyed = rows.select("vec_id", "raw", F.when(usable, F.xxhash64("v")).alias("k1"), F.when(usable, F.xxhash64(F.lit(17), "v", F.lit("s"))).alias("k2"))
    classes = keyed.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("raw").alias("v"))
    # A class is named by its row in the written table, not by an id: ids may be null or shared.
    classes, _ = written(classes.withColumn("cls", F.monotonically_increasing_id()), "embed-classes")
    n, dim = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    spark = vectors.sparkSession
    if n:
        # Hashes are even, so a threshold on them leaves some two samples' worth of rows to order.
        below = -(2**63) + int(2**64 * min(1.0, 2 * SAMPLE / n)) - 1
        sample = classes.filter(F.col("k1") <= below).select("k1", "k2", "v").orderBy("k1", "k2").limit(SAMPLE).toArrow()
        x = matrix(sample["v"].combine_chunks(), dim)
        k = max(1, min(MOST_CELLS, n // CELL, len(x) // 4))
        centres = spherical_kmeans(x, k)
        schema = f"cell int, cls long, copies long, home int, visits array<int>, v {classes.schema['v'].dataType.simpleString()}"
        dealt, _ = written(classes.select("cls", "copies", "v").mapInArrow(_assign(centres, margin_of(x, cosine) if margin is None else margin), schema), "embed-cells")
        # Cells are as many as k, bounded by MOST_CELLS; so is this table.
        blocks = dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
        placed = dealt.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
        paired = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        paired = paired.select("cell", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"), "block", "cls", "copies", "home", "visits", "v")
        found = paired.groupBy("cell", "bi", "bj").applyInArrow(_compare(cosine, dim, k), "cls long, links long, root long")
        found, _ = written(found, "embed-links")
        links = found.groupBy("cls").agg(F.sum("links").alias("links"))
        roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "cls")
        # The least id of a component: only classes with links take part.
        first = roots.join(classes.select("cls", "least"), "cls").groupBy("root").agg(F.min("least").alias("first"))
        classes = classes.join(links, "cls", "left").join(roots.join(first, "root"), "cls", "left")
        own = F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("first"))
        per = classes.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), own.alias("root"))
    else:
        per = spark.createDataFrame([], "k1 long, k2 long, n_links long, root long")
    out = keyed.drop("raw").join(per, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("root"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_embed_dedup": op10_embed_dedup}
ORACLE: dict[str, str] = {}
