"""What the operators of this subpackage share: tables, durable intermediate results, column names."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of texts that an operator turns into Python objects at a time; a longer text stands alone.
SLICE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, about SLICE bytes of strings and binaries at a time; empty batches are left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        held = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        nth = np.cumsum(held) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(nth)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(low, high - low)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one, in local mode only."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.TemporaryDirectory(prefix="quiverql-")
    return f"file://{_own.name}"


_own: tempfile.TemporaryDirectory | None = None


class Workspace:
    """Tables written to the shared folder. They cut lineage and outlive lost executors; they go when dropped, at the end of the scratch() around them, or else when the driver's Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{shared_folder(spark)}/quiverql/{name}-{uuid.uuid4().hex[:12]}", 0
        if _scopes:
            _scopes[-1].append(self)
        else:
            atexit.register(self.drop)

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._quiverql_path = path
        return out

    def tidy(self) -> None:
        """Has the driver look for what is no longer in use, upon which Spark removes its shuffle files; else that waits until memory runs short."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, frame: DataFrame | None = None) -> None:
        path = self.root if frame is None else frame._quiverql_path
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:
            if frame is not None:
                raise  # at exit, the session may have ended before


_scopes: list[list[Workspace]] = []


@contextmanager
def scratch():
    """Drops at its end the tables of all workspaces made within; results that read them must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for space in _scopes.pop():
            space.drop()


def documents(frame: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns only, whatever other columns there are; text is string, doc_id bigint."""
    return frame.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


#: Bits of a filter of keys, 8 MB in all.
BITS = 1 << 26
#: Words of 64 bits in each part of the filter: Spark's bitmaps have 4 KB.
PART_WORDS = 512


def likely_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is in the column of that name of keys, and few others: the keys' hashes are broadcast as BITS bits."""
    place = lambda column: F.pmod(F.xxhash64(column), F.lit(BITS))
    # places are dealt before they become bits, so that no parts of the filter are shuffled
    at = keys.select(F.bitmap_bucket_number(place(key)).alias("__at"), F.bitmap_bit_position(place(key)).alias("__bit")).repartition("__at")
    bits = at.groupBy("__at").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    # numbers instead of bytes, made once for each part, so that a row looks its bit up without strings
    word = lambda k: F.conv(F.hex(F.substring("__bits", k * 8 + 1, F.lit(8))), 16, -10).cast("bigint")
    words = bits.select("__at", F.transform(F.sequence(F.lit(0), F.lit(PART_WORDS - 1)), word).alias("__words"))
    bit = F.bitmap_bit_position(place(key)).cast("int")
    # a word's first byte is its highest
    held = F.getbit(F.get("__words", F.shiftright(bit, 6)), bit.bitwiseXOR(F.lit(56)).bitwiseAND(F.lit(63)))
    return rows.withColumn("__at", F.bitmap_bucket_number(place(key))).join(F.broadcast(words), "__at").where(held == 1).drop("__at", "__words")


def with_key_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is in the column of that name of keys; few other rows move, and none is lost."""
    keys = keys.select(F.col(key).alias("__key")).distinct()
    return likely_among(rows, key, keys.withColumnRenamed("__key", key)).join(keys.hint("merge"), F.col(key) == F.col("__key"), "left_semi")


#: Keys that salted_join deals out at most, the rows that such a key has at least, and to how many places.
HEAVY, HEAVY_ROWS, SALTS = 4096, 1000, 64


def salted_join(rows: DataFrame, found: DataFrame, keys: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """rows joined with found, which is saved, has each key once and the number n of its rows (dropped).

    A key with more than one in HEAVY of all those rows is dealt out by the salt: there are at most HEAVY such
    keys, which are broadcast, and their rows of found stand in all SALTS places. Without such keys it is a plain join.
    found, of one row a key, is hashed in each task, so that neither side is sorted.
    """
    total, most = found.agg(F.sum("n"), F.max("n")).first()
    limit = max(HEAVY_ROWS, (total or 0) // HEAVY)
    if (most or 0) <= limit:
        return rows.join(found.drop("n").hint("shuffle_hash"), keys, how)
    heavy = found.where(F.col("n") > limit).select(*keys, F.lit(True).alias("__heavy"))
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("__salt", F.when(F.col("__heavy"), F.pmod(salt, F.lit(SALTS)).cast("int")).otherwise(0)).drop("__heavy")
    places = F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(found.withColumn("__salt", F.explode(places)).drop("n").hint("shuffle_hash"), [*keys, "__salt"], how).drop("__salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
