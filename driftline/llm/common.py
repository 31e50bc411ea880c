"""Helpers shared by the corpus operators: table access, shared-folder tables, guarded broadcasts, spans."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side is broadcast only when its measured size is at most this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Texts go to Python in Arrow batches of about this many bytes, which the JVM and a worker hold at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on a plain local master a new one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("driftline.local.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = tempfile.mkdtemp(prefix="spark-driftline-")
    spark.conf.set("driftline.local.dir", where)
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are at most BATCH_BYTES (a lower bound of the session's own stays)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch("([0-9]+)([kmg]?)b?", conf.get(name).strip().lower())
    if not now or not 0 < int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more. Tables a lazy result still reads must not be given."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def measured(df: DataFrame) -> int:
    """Bytes of a (stored) table's values, with 16 more for each row and 8 for each value; lists hold longs."""
    wide = {"string": F.octet_length, "binary": F.octet_length, "array<bigint>": lambda c: 8 * F.size(c)}
    parts = [F.coalesce(wide[t](F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in wide]
    if other := {t for _, t in df.dtypes if t not in wide and not re.fullmatch("boolean|tinyint|smallint|int|bigint|double", t)}:
        raise ValueError(f"no size is known for {other}")
    return int(df.agg(F.sum(sum(parts, F.lit(16 + 8 * len(df.columns)).cast("long")))).first()[0] or 0)


def guarded(df: DataFrame) -> DataFrame:
    """Hint a broadcast if the (stored) table's measured bytes fit the bound, else leave it to a shuffle join."""
    return F.broadcast(df) if measured(df) <= BROADCAST_BYTES else df


def with_spans(docs: DataFrame, spans: DataFrame, on: str = "doc_id", how: str = "left") -> DataFrame:
    """docs joined with a stored table (on, spans binary); broadcast only if all its spans fit the bound."""
    return docs.join(guarded(spans), on, how)


def numbered(rows: DataFrame, order: list[str], number: str) -> DataFrame:
    """rows (stored) with their place in the order, from 0 without gaps, stored. Rows are dealt by range and counted in their
    partitions; only the partitions' counts are added up."""
    names = rows.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int32()), pa.array(np.arange(seen, seen + n))], [*names, "_part", "_at"])
            seen += n

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    counted = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, f"{schema}, _part int, _at long"), "numbered")
    parts = counted.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.join(F.broadcast(parts.select("_part", before.alias("_first"))), "_part").select(*names, (F.col("_first") + F.col("_at")).alias(number))


def row_key() -> Column:
    """Tells rows apart: a hash of doc_id (null too) and text. Rows that repeat both have one key."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))


def wide_key() -> Column:
    """Tells rows apart by 128 bits: two hashes of doc_id (null too) and text, chained in either order."""
    i, t = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    return F.concat(F.hex(F.xxhash64(i, t)), F.lit("-"), F.hex(F.xxhash64(t, F.lit(1), i)))


def few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that only few texts are Python objects at once; a worker that waits for its next task holds
    no memory of the last batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        b = None  # noqa: PLW2901
        pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed pages otherwise
        trim(0)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of [^\\x20\\x09-\\x0D] as UTF-8 (bytes.split() parts at exactly these six bytes; bytes.lower() changes A-Z)."""
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal disjoint runs; touching runs become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.append(True, s[1:] > e[:-1])
    return s[first], e[np.append(np.flatnonzero(first)[1:] - 1, len(s) - 1)]


#: The end of a span that goes to the end of its text.
WHOLE = 2**32 - 1


def pack_spans(starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Places in a text (2 GB at most) as unsigned 32-bit numbers."""
    return np.stack([starts, ends]).astype("<u4").tobytes()


def unpack_spans(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(data or b"", "<u4").reshape(2, -1).astype("i8")
    return a[0], a[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E6C63D0676A9A99)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E6D62D06F6A9A9B)
    return x ^ (x >> np.uint64(32))


def byte_size(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
