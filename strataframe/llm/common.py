"""Shared helpers: table access, word hashing and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD_BREAK_CHARS = " \t\n\x0b\x0c\r"

_P1 = np.uint64(0x9E3779B185EBCA87)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_P3 = np.uint64(0x165667B19E3779F9)
_P4 = np.uint64(0x85EBCA77C2B2AE63)
_P5 = np.uint64(0x27D4EB2F165667C5)
_LONG = 2048  # slices of more bytes are hashed one by one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Bytes, about, of the texts that go to a Python worker as one Arrow batch. Spark's own bound is 64 MB, and the JVM and the worker of each
#: task hold a batch several times over and keep memory of that size.
BATCH_BYTES = 2 << 20
BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_texts(df: DataFrame, f: Callable, schema) -> DataFrame:
    """df.mapInArrow(f, schema) by batches of BATCH_BYTES and a row at most, unless the session has a bound of its own. Rows stay whole."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BOUND, None) is None:
        conf.set(BATCH_BOUND, f"{BATCH_BYTES}b")
    return df.mapInArrow(f, schema)


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for a text without any."""
    trimmed = F.trim(text, F.lit(WORD_BREAK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; a folder of its own only where that is unset and all runs on this machine (tests)."""
    if spark.conf.get("spark.checkpoint.dir", None) or not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        return
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "strataframe-checkpoints"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the checkpoint folder that was set."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Has a folder removed when the application ends."""
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again, without lineage. Removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, about, for each file of a table that is made from so many rows.
FILE_ROWS = 1 << 18


def files_for(rows: DataFrame) -> int:
    """Files for a checkpoint of what is made from a table: one for FILE_ROWS of its rows, but one for each core at least and one for each shuffle partition at most."""
    spark = rows.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(spark.sparkContext.defaultParallelism, -(-rows.count() // FILE_ROWS))))


def gathered(df: DataFrame, files: int) -> DataFrame:
    """df checkpointed in so many files; all tasks that make its rows stay. On local and mounted folders an executor starts two programs
    (chmod) for a file, and each counts as a second JVM until it runs, so a file for each shuffle partition costs memory, too."""
    return df.repartition(files).checkpoint()


def bit_table(keys: DataFrame, bits: int = 22) -> DataFrame:
    """(word, mask): a bit for the low ``bits`` bits of each 64-bit ``key``. At most 2^(bits-6) rows whatever the number of keys, so it may be broadcast.
    With 64 bits it tells keys exactly, and has a row for each 64 neighbouring keys of which there is one."""
    word = F.shiftright("key", 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1))
    return keys.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("mask"))


def maybe_in(df: DataFrame, key: str, table: DataFrame, flag: str, bits: int = 22) -> DataFrame:
    """df with the boolean column ``flag``: false where ``key`` is null or surely not among the keys of the bit table."""
    return marked_rows(df, key, table, flag, True, bits)


def marked_rows(df: DataFrame, key: str, table: DataFrame, flag: str, everywhere: bool, bits: int = 64) -> DataFrame:
    """The same; with 64 bits the flag is exact. The bit table is broadcast if it may go ``everywhere``, otherwise both sides are exchanged."""
    word = F.shiftright(key, 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1))
    masks = table.select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))
    told = df.join(F.broadcast(masks) if everywhere else masks, word == F.col("_word"), "left")
    bit = F.expr(f"shiftrightunsigned(_mask, cast({key} & 63 as int)) & 1")
    return told.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop("_word", "_mask")


#: A key with this share of the rows is hot; there can be at most as many such keys.
HOT_SHARE = 1000


def join_by_weight(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left join of many rows to one row a key. ``weight`` of keyed is at most the number of rows of its key, and the weights sum
    up to ``total`` or less, so at most ``HOT_SHARE`` keys weigh a thousandth of it: those are broadcast, the others exchanged."""
    hot = F.col(weight) * HOT_SHARE >= F.lit(max(total, HOT_SHARE))
    heavy = F.broadcast(keyed.where(hot))
    light = rows.join(F.broadcast(keyed.where(hot).select(*on)), on, "left_anti").join(keyed.where(~hot), on, how)
    return rows.join(heavy, on).unionByName(light)


def sample_fraction(rows: int, bound: int) -> float:
    return 1.0 if rows <= bound else bound / rows


def hash_below(col: str, fraction: float, seed: int = 7) -> Column:
    """True for a fixed ``fraction`` of the ids, the same rows in every run."""
    limit = min(int(fraction * 2**62), 2**62 - 1)
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(col)), 2)
    return unit <= F.lit(limit)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_slices(data: bytes, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of one buffer at once (public algorithm, vectorised over slices)."""
    n = len(starts)
    if n == 0:
        return np.empty(0, np.uint64)
    buf = np.frombuffer(data + b"\0" * 8, np.uint8)
    u64 = np.ndarray((len(buf) - 7,), "<u8", buffer=buf.data, strides=(1,))
    u32 = np.ndarray((len(buf) - 3,), "<u4", buffer=buf.data, strides=(1,))
    sd = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(n, sd + _P5, np.uint64)
        pos = starts.astype(np.int64)
        rem = lens.astype(np.int64)
        big = np.flatnonzero(rem >= 32)
        if len(big):
            v1 = np.full(len(big), sd + _P1 + _P2, np.uint64)
            v2 = np.full(len(big), sd + _P2, np.uint64)
            v3 = np.full(len(big), sd, np.uint64)
            v4 = np.full(len(big), sd - _P1, np.uint64)
            p, left = pos[big], rem[big] // 32
            left[rem[big] > _LONG] = 0
            while True:
                a = np.flatnonzero(left > 0)
                if not len(a):
                    break
                q = p[a]
                v1[a], v2[a] = _round(v1[a], u64[q]), _round(v2[a], u64[q + 8])
                v3[a], v4[a] = _round(v3[a], u64[q + 16]), _round(v4[a], u64[q + 24])
                p[a] += 32
                left[a] -= 1
            acc = _rotl(v1, 1) + _rotl(v2, 7) + _rotl(v3, 12) + _rotl(v4, 18)
            for v in (v1, v2, v3, v4):
                acc = (acc ^ _round(np.zeros_like(v), v)) * _P1 + _P4
            h[big] = acc
            pos[big] += rem[big] // 32 * 32
        h += lens.astype(np.uint64)
        rem = rem % 32
        for lane in range(1, 4):
            a = np.flatnonzero(rem >= 8 * lane)
            if not len(a):
                break
            q = pos[a]
            x = h[a] ^ _round(np.zeros(len(a), np.uint64), u64[q])
            h[a] = _rotl(x, 27) * _P1 + _P4
            pos[a] += 8
        rem %= 8
        a = np.flatnonzero(rem >= 4)
        if len(a):
            x = h[a] ^ (u32[pos[a]].astype(np.uint64) * _P1)
            h[a] = _rotl(x, 23) * _P2 + _P3
            pos[a] += 4
        rem %= 4
        for k in range(1, 4):
            a = np.flatnonzero(rem >= k)
            if not len(a):
                break
            x = h[a] ^ (buf[pos[a]].astype(np.uint64) * _P5)
            h[a] = _rotl(x, 11) * _P1
            pos[a] += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(lens > _LONG):
        import xxhash

        s = int(starts[i])
        h[i] = xxhash.xxh64_intdigest(data[s : s + int(lens[i])], seed)
    return h


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text whose words are joined by single spaces."""
    if not joined:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.r_[0, gaps + 1], np.r_[gaps, len(joined)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
