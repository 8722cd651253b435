"""Reading and writing arrays: one-file binary arrays, Parquet coordinate tables, text."""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkarray.array import SparkArray


def load(spark: SparkSession, path: str) -> SparkArray:
    """A ``.npy`` file (or a folder of them, stacked by name along the first axis), read by the executors."""
    files = spark.read.format("binaryFile").load(path)

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(c), allow_pickle=False)
                yield pd.DataFrame({"path": [p], "shape": [list(a.shape)], "kind": [a.dtype.kind]})

    parts = sorted(files.select("path", "content").mapInPandas(heads, "path string, shape array<long>, kind string").collect())
    before, at = {}, 0
    for r in parts:
        before[r.path] = at
        at += r["shape"][0] if r["shape"] else 1
    shape = (at, *parts[0]["shape"][1:]) if len(parts) > 1 or parts[0]["shape"] else ()
    kind = {"b": "boolean", "i": "long", "u": "long"}.get(parts[0]["kind"], "double")
    complex_ = parts[0]["kind"] == "c"
    n = len(shape)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(c), allow_pickle=False)
                grid = np.indices(a.shape).reshape(n, -1) if n else np.zeros((0, 1), "i8")
                out = {f"i{k}": g + (before[p] if k == 0 else 0) for k, g in enumerate(grid)}
                flat = a.reshape(-1)
                yield pd.DataFrame(out | ({"re": flat.real.astype("f8"), "im": flat.imag.astype("f8")} if complex_ else {"v": flat}))

    df = files.select("path", "content").mapInPandas(cells, ", ".join([*(f"i{k} long" for k in range(n)), "re double, im double" if complex_ else f"v {kind}"]))
    return SparkArray(df.withColumn("v", F.struct("re", "im")) if complex_ else df, shape)


def from_table(df: DataFrame, value: str, order: Sequence[str]) -> SparkArray:
    return SparkArray.from_column(df, value, order)


def from_rows(df: DataFrame, key: str, vector: str) -> SparkArray:
    """Row vectors (an array column) as a matrix; rows in the order of a dense key."""
    width = df.agg(F.max(F.size(vector))).first()[0] or 0
    cells = df.select(F.col(key).cast("long").alias("i0"), F.posexplode(vector).alias("p", "v"))
    return SparkArray(cells.select("i0", F.col("p").cast("long").alias("i1"), "v"), (df.count(), width))


def save(a: SparkArray, path: str) -> None:
    """A coordinate table; the shape is a column's metadata."""
    df = a.df.withMetadata("v", {"shape": list(a.shape)})
    df.write.mode("overwrite").parquet(path)


def open_saved(spark: SparkSession, path: str) -> SparkArray:
    df = spark.read.parquet(path)
    return SparkArray(df, df.schema["v"].metadata["shape"])


def save_npy(a: SparkArray, folder: str) -> None:
    """A folder of .npy files, slices along the first axis, each written by the task that has it: what ``load`` reads."""
    import io

    rows = max(1, SLICE_CELLS // max(a.size // max(a.shape[0], 1), 1))
    shape, count = a.shape[1:], a.shape[0]
    cells = a.df.groupBy(F.expr(f"i0 div {rows}").alias("slice")).agg(F.collect_list(F.struct((F.col("i0") % rows).alias("i0"), *a.axes[1:], "v")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                v = x.values.field(len(shape) + 1).to_numpy(zero_copy_only=False)
                out = np.zeros((min(rows, count - k * rows), *shape), v.dtype)
                out[tuple(x.values.field(n).to_numpy() for n in range(len(shape) + 1))] = v
                data = io.BytesIO()
                np.save(data, out, allow_pickle=False)
                files.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], ["slice", "content"])

    made = cells.mapInArrow(run, "slice long, content binary")
    fs = _writer(a.spark, folder)
    for r in made.toLocalIterator():  # one slice at a time passes the driver
        fs(f"part-{r['slice']:08d}.npy", bytes(r["content"]))


#: Cells of a slice that is one file.
SLICE_CELLS = 4_000_000


def _writer(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)

    def write(name: str, data: bytes) -> None:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(folder, name), True)
        out.write(bytearray(data))
        out.close()

    return write
