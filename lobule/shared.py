"""Session-level helpers that every operator may use: table access, stage tables in the shared folder, sorted Arrow groups."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: dict[str, SparkSession] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster set it. Where it is unset a session on one machine (tests) gets
    a temporary folder; on a cluster a RuntimeError asks for the setting, as no executor could read another's local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lobule-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stage(df: DataFrame, hint: str = "stage", files: int | None = None) -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{hint}-{uuid.uuid4().hex}"
    if files:
        df = df.coalesce(files)
    df.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def scratch(spark: SparkSession, hint: str) -> str:
    """A new path in the shared folder for a file that a query writes and reads back; removed with the stage tables."""
    path = f"{shared_folder(spark)}/{hint}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def free(df: DataFrame | None) -> None:
    """Remove the table that stage() wrote for df, if there is one; nothing may read it afterwards."""
    path = getattr(df, "staged_at", None)
    spark = _WRITTEN.pop(path, None)
    if spark is None:
        return
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def drop_staged() -> None:
    """Remove every table that stage() wrote in this process; results that still read them must have been used before."""

    class Left:
        staged_at = None

    for path in list(_WRITTEN):
        Left.staged_at = path
        free(Left)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with its rows' places 1, 2, ... in the order, as long: a range-partitioned sort, then each partition's offset; no task sees all rows.

    Equal rows of the order are placed arbitrarily, so give a full order. Only one count per partition goes to the driver.
    """
    sorted_rows = stage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = {r[0]: r[1] for r in sorted_rows.groupBy(part).count().collect()}
    before, offsets = 0, {}
    for p in sorted(sizes):
        offsets[p] = before
        before += sizes[p]
    if not offsets:
        return sorted_rows.withColumn(name, F.lit(0).cast("long")).drop("_at")
    first = F.element_at(F.create_map(*[F.lit(x).cast("long") for p in offsets for x in (p, offsets[p])]), part)
    return sorted_rows.withColumn(name, first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at")


def join_one_row_each(big: DataFrame, small: DataFrame, keys: list[str], weight: str, hot: int = 50_000) -> DataFrame:
    """big joined with small, which has one row per key and in `weight` the number of big's rows with that key.

    Keys of at least `hot` rows, of which there can be only rows / hot, are sent to big's tasks instead of being shuffled to one.
    """
    rest, heavy = small.drop(weight), small.where(F.col(weight) >= hot).drop(weight)
    if heavy.isEmpty():
        return big.join(rest, keys)
    light = small.where(F.col(weight) < hot).drop(weight)
    return big.join(F.broadcast(heavy), keys).unionByName(big.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))


def slots(spark: SparkSession, least: int = 1) -> int:
    """Number of tasks for a CPU-bound stage: the session's shuffle partitions, but at least three for each core."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Cut batches that come sorted by keys (integers without nulls) into slices of one key each; a long key comes in several slices."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Whole groups of batches that come sorted by keys; each group must be bounded by the caller."""
    held, at = [], None
    for key, piece in runs(batches, keys):
        if at is not None and key != at:
            yield at, pa.Table.from_batches(held)
            held = []
        at = key
        held.append(piece)
    if held:
        yield at, pa.Table.from_batches(held)


def pack(rows: np.ndarray) -> pa.Array:
    """The rows of a 2-d float64 array as Arrow binary values."""
    rows = np.ascontiguousarray(rows, np.float64)
    width = rows.shape[1] * 8
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows)])


def unpack(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The inverse of pack()."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if len(column) == 0:
        return np.empty((0, width))
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float64).reshape(len(column), width)


def usable(name: str, low: float, high: float):
    """True where the column is a finite number within [low, high]; null, NaN and infinities are not."""
    c = F.col(f"`{name}`")
    return F.coalesce(c.between(F.lit(float(low)), F.lit(float(high))) & ~F.isnan(c), F.lit(False))


def scaled_features(cells: DataFrame, scale: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Rows whose features are all usable, as `keep` plus one double column v0..vn per feature, (value - center) / scale.

    `scale` is the small table of features (feature, center, scale, valid_min, valid_max); a feature without a row raises.
    """
    rows = {r["feature"]: r for r in scale.where(F.col("feature").isin(names)).collect()}
    missing = [n for n in names if n not in rows]
    if missing:
        raise ValueError(f"no scale for {missing}")
    fine = F.lit(True)
    for n in names:
        fine = fine & usable(n, rows[n]["valid_min"], rows[n]["valid_max"])
    out = [((F.col(f"`{n}`") - rows[n]["center"]) / rows[n]["scale"]).alias(f"v{i}") for i, n in enumerate(names)]
    return cells.where(fine).select(*[F.col(f"`{k}`") for k in keep], *out)
