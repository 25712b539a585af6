"""Shared helpers of the training-data operators: lineage cuts, Arrow maps, hashing, fixed-size bitmaps."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

SLICE = 1000
#: Bytes of an Arrow batch on its way to or from Python. Spark's own limit is rows, so ten thousand long texts would make one.
BATCH = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``. Where that is unset, a temporary one, if driver and
    executors are one process (tests); a cluster must name a folder that all its machines share."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not (spark.sparkContext.master + "[").startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='pagemill-')}"
        _folders[app] = f"{base.rstrip('/')}/pagemill-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(release, spark)
    return _folders[app]


def release(spark: SparkSession) -> None:
    """Remove every table written by :func:`cut` in this application. Frames built on them can't be read afterwards."""
    try:
        folder = _folders.pop(spark.sparkContext.applicationId, None)
        if folder:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast: ``pick(df, doc_id="long", text="string")``. Other columns, clashing names included, go."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()))


def row_ids(df: DataFrame) -> DataFrame:
    """The frame with ``_file`` and ``_row``, which tell its rows apart, equal ones too, and are the same at each reading.

    Rows of Parquet files are known by file (its hash) and number; those of other frames are written first."""
    try:
        return df.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    except AnalysisException:
        return cut(df.withColumns({"_file": F.lit(0).cast("long"), "_row": F.monotonically_increasing_id()}), "rows")


def small_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches by bytes, unless they are already bounded more tightly."""
    now = str(spark.conf.get(BATCH_LIMIT)).rstrip("b")
    if not now.isdigit() or int(now) <= 0 or int(now) > BATCH:
        spark.conf.set(BATCH_LIMIT, str(BATCH))


def tidy() -> None:
    """Hands back what a task's caches and buffers took: workers are used again by later stages, and stay as large as they are."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow``: ``make`` runs once a task and returns the function of a batch; it gets ``SLICE`` rows at a time."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        try:
            for b in batches:
                for at in range(0, b.num_rows, SLICE):
                    yield from f(b.slice(at, SLICE))
        finally:
            f = None
            tidy()

    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, name: str, make: Callable[[], Callable[[list[str | None]], pa.Array]], kind: str) -> DataFrame:
    """The frame with a column made of its texts. Only these travel to Python; whatever else a row has stays where it is."""
    small_batches(df.sparkSession)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        try:
            for b in texts:
                yield f(b.to_pylist())
        finally:
            f = None
            tidy()

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # not deterministic, so that no filter on the column repeats it
    return df.withColumn(name, F.arrow_udf(run, kind).asNondeterministic()(F.col("text").cast("string")))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _MIX1
        x = (x ^ (x >> U64(27))) * _MIX2
        return x ^ (x >> U64(31))


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered up to a bound."""

    BOUND = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    base = U64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out = out * base + h[j : j + n]
        return mix(out + U64(k))


def bitmap(df: DataFrame, column: str, least: int = 22, most: int = 28) -> np.ndarray:
    """Which of 2**bits slots the top bits of a 64-bit column reach, as words of 64 slots. There are 2**least slots or 16 a row, up
    to 2**most (32 MB for 28); beyond, more values pass by chance, which costs time but no result. Words are put together before they reach the
    driver, which gets them as packed bytes, 12 a word, and no object for each. Rows are read twice: give a written frame."""
    bits = min(most, max(least, df.count().bit_length() + 4))
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = df.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - bits}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.to_numpy().tobytes()], pa.binary()) for x in b.columns], ["w", "b"])

    out = np.zeros(1 << (bits - 6), dtype=U64)
    for w, b in words.mapInArrow(pack, "w binary, b binary").collect():
        out[np.frombuffer(w, dtype=np.int32)] = np.frombuffer(b, dtype=U64)
    return out


def in_bitmap(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    slot = values >> U64(64 - (len(words).bit_length() + 5))
    return (words[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) != 0


def crc_id(column: Column | str) -> Column:
    return F.crc32((F.col(column) if isinstance(column, str) else column).cast("string").cast("binary"))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
