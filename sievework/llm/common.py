"""Shared pieces of the training-data operators: words, scratch tables, carried columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of 0-9, a-z and everything beyond ASCII, once A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs of anything but the six ASCII white-space characters.
TOKEN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column | str) -> Column:
    """Lower case for A-Z only; a null text stays null."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column | str) -> Column:
    """The words of a text in order; a null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if held := spark.sparkContext._jsc.sc().getCheckpointDir():
        if held.isDefined():
            return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sievework-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def _scratch(spark: SparkSession) -> str:
    """This application's own folder below the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/sievework/{spark.sparkContext.applicationId}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared checkpoint folder and read it back: the lineage ends
    there, and a lost executor costs a reread, not a rerun."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table durable() has written for this application. Results that were not written
    elsewhere read those tables, so this comes last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Most bytes and rows of a batch that goes to Python.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands Python a few megabytes of text at a time, in place of tens:
    what a task holds then follows BATCH_BYTES and its longest text."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Rows that are broadcast at most, of a few narrow columns; and the tasks that rows of one key are dealt
#: to where their partner is too large for that.
BROADCAST_ROWS, SALTS = 500_000, 64


def spread(rows: DataFrame, few: DataFrame, on: list[str], how: str, by: str) -> DataFrame:
    """Rows joined with few, a written table of narrow rows whose keys are all different: broadcast up to
    BROADCAST_ROWS; beyond that a key's rows are dealt by the column by to SALTS tasks, each with a
    copy of what they meet."""
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), on, how)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


#: Words of 64 bits in a bitmap of keys, each one row of a broadcast.
BITMAP_WORDS = 1 << 19


def marked(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows with _hit, which is true where keys has the row's key, and for a few rows more (a
    sixteenth at two million keys). Rows stay where they are: a bitmap of the keys' hashes is broadcast."""
    slot = F.pmod(F.xxhash64(on), F.lit(64 * BITMAP_WORDS))
    word, bit = F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    met = rows.withColumn("_word", word).join(F.broadcast(durable(words, "bitmap")), "_word", "left")
    return met.withColumn("_hit", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def without(rows: DataFrame, gone: DataFrame, on: str, by: str) -> DataFrame:
    """Rows whose key gone, a written table of different keys, does not have. Beyond BROADCAST_ROWS keys only
    rows that a bitmap marks are dealt out; all others stay where they are."""
    if gone.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(gone), on, "left_anti")
    told = marked(rows, gone, on)
    return told.filter("not _hit").drop("_hit").unionByName(spread(told.filter("_hit").drop("_hit"), gone, [on], "left_anti", by))


def carried(df: DataFrame, outputs: list[str]) -> list[str]:
    """The input columns that an operator passes on: all that have no output's name, which the
    output replaces."""
    taken = {x.lower() for x in outputs}
    return [c for c in df.columns if c.lower() not in taken]


def packed(df: DataFrame, keep: list[str]) -> Column:
    """The kept columns as one struct, so that working names cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in keep])


def unpacked(keep: list[str], struct: str = "_row") -> list[Column]:
    return [F.col(f"{struct}.`{c}`").alias(c) for c in keep]


def sql_text(value: str) -> str:
    """A string literal for Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
