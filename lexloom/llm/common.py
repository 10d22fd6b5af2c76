"""What several operators of this subpackage share: reading tables, written intermediate tables, words, empty batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word is a run of bytes other than ASCII white space; ``bytes.split()`` splits exactly there.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns with their types; whatever else the table carries is dropped before any join."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, as in local tests) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='lexloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base


def written(df: DataFrame, name: str, *, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts the lineage and survives lost executors.

    The files are removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs before the next large shuffle."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession, times: int = 1) -> int:
    return times * int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def chunks(texts, max_bytes: int = 1 << 20):
    """(first index, list of encoded texts) with about max_bytes each, so that a batch of long texts is never expanded at once."""
    at, out, size = 0, [], 0
    for i, t in enumerate(texts):
        out.append((t.as_py() or "").encode() if hasattr(t, "as_py") else (t or "").encode())
        size += len(out[-1])
        if size >= max_bytes:
            yield at, out
            at, out, size = i + 1, [], 0
    if out:
        yield at, out


def give_back() -> None:
    """Return the memory that Arrow and malloc hold for later to the system: a reused worker stays beside its executor's next stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def word_hashes(texts: list[bytes]):
    """64-bit hashes of the words of all texts, in a row, and the offsets of each text's words (one more than texts)."""
    import numpy as np
    import xxhash

    words = [t.split() for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=offsets[1:])
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x) for w in words for x in w), np.uint64, int(offsets[-1])), offsets


def mixed(x):
    """A bijection of 64-bit integers that spreads every bit (numpy arrays)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h, k: int, seed: int = 1):
    """A hash of the k entries from each position on (as many as fit)."""
    import numpy as np

    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = np.full(n, seed, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mixed(out)


def shingle_sets(texts: list[bytes], k: int):
    """The sorted distinct k-word shingle hashes of each text; fewer words are one shingle, none are none."""
    import numpy as np

    h, off = word_hashes(texts)
    w = window_hashes(h, k)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(w[a : b - k + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], b - a, seed=b - a + 1))
        else:
            out.append(h[:0])
    return out
