"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java regular expression for a run of the six ASCII white-space characters.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster, or else the folder given to
    setCheckpointDir(). Where both are unset a temporary folder is made, but only for a master
    within this process: executors elsewhere would write to disks of their own.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or getattr(context, "_foliolens_shared", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = context._foliolens_shared = f"file://{tempfile.mkdtemp(prefix='foliolens-')}"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/foliolens/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/foliolens/" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Bounds what one Arrow batch holds, so that very long texts do not add up.

    Plans are lazy, so the session has to keep these settings; smaller ones of its own stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)):
        own = spark.conf.get(key, None) or ""
        if not (own.isdigit() and 0 < int(own) <= most):
            spark.conf.set(key, str(most))


def own_columns(df: DataFrame) -> list[Column]:
    """df's columns as they are, with dots and backticks in their names."""
    return [F.col(quoted(c)) for c in df.columns]


def with_field(df: DataFrame, name: str, kind) -> T.StructType:
    """df's schema with one more field: unlike DDL, it takes columns and fields of any name."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def hash_sample(df: DataFrame, limit: int, *key: str) -> DataFrame:
    """About limit rows at most, chosen by a hash of key alone; all rows if they are no more.

    Unlike an ordered limit, no task sends more than its share to the driver.
    """
    share = df.count() // limit + 1
    return df if share == 1 else df.where(F.pmod(F.xxhash64(F.lit(17), *key), F.lit(share)) == 0)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo; null ids count as remainder -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


# --- numpy text arrays ------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        up = np.full(size, _ODD, np.uint64)
        up[0] = 1
        down = np.full(size, _INVERSE, np.uint64)
        down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][: n + 1]


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], all at once: a polynomial hash by prefix sums, then mixed."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * up, dtype=np.uint64, out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def word_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in concatenated texts, and the number of words per text.

    cuts: the texts' offsets in data, one more than texts; a word never crosses one.
    """
    inside = ~_SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    after = np.empty(len(data) + 1, bool)
    after[:-1] = inside
    after[-1] = False
    first, last = after & ~before, before & ~after
    joint = cuts[1:-1][(cuts[1:-1] > 0) & (cuts[1:-1] < len(data))]
    joint = joint[before[joint] & after[joint]]
    first[joint] = True
    last[joint] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    counts = np.diff(np.searchsorted(starts, cuts))
    return starts, ends, counts


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string array, and the texts' offsets in it (nulls are empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[cuts[0] : cuts[-1]], cuts - cuts[0]


def slices(texts, most: int = 1 << 20):
    """Runs of an Arrow string array with so many bytes at most (one longer text is a run), as (start, length).

    Arrays by byte take some dozen times a text's size; these bound them.
    """
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    start, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield start, k - start
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes) - start
