"""Tables: readers with fixed schemas, tables kept in the shared folder, fingerprints, sinks."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE_CSV = T.StructType([
    T.StructField("tweet_id", T.LongType()), T.StructField("author_id", T.StringType()), T.StructField("inbound", T.StringType()),
    T.StructField("created_at", T.StringType()), T.StructField("text", T.StringType()), T.StructField("response_tweet_id", T.StringType()),
    T.StructField("in_response_to_tweet_id", T.DoubleType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed_time(column) -> F.Column:
    """'Tue Oct 31 22:10:47 +0000 2017' as a UTC timestamp without zone; null where it is malformed."""
    return F.to_timestamp_ntz(F.date_format(F.try_to_timestamp(F.substring(column, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")), "yyyy-MM-dd HH:mm:ss"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """The raw message file (embedded newlines, literal "null" kept) as id, parent, inbound, author, created_at, text."""
    raw = spark.read.csv(path, schema=MESSAGE_CSV, header=True, multiLine=True, escape='"', nullValue="\x00", emptyValue="")
    return raw.select(
        F.col("tweet_id").alias("id"), F.col("in_response_to_tweet_id").cast("long").alias("parent"), (F.lower("inbound") == "true").alias("inbound"),
        F.col("author_id").alias("author"), parsed_time("created_at").alias("created_at"), "text")


_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the folder all nodes share and reads it back, which cuts its lineage.  What it shuffled for that is deleted at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/parlance/{name}-{uuid.uuid4().hex}"
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffles of each action within go with it, not only when the driver collects garbage."""
    before = spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANED, before)


def _write(df: DataFrame, path: str) -> None:
    with cleaned(df.sparkSession):
        df.write.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder takes its place where driver and executors are one process, else its absence is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        root = f"file://{tempfile.mkdtemp(prefix='parlance-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing reads any more."""
    for df in frames:
        for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
            _delete(df.sparkSession, path)


def staleness_key(df: DataFrame, version: str) -> str:
    """A digest of the files behind ``df`` and of the version of what is made of them."""
    files = fingerprint(df).select(F.xxhash64(F.element_at(F.split("file_path", "/"), -1), "file_size", "file_modification_time").cast("decimal(38,0)").alias("h"))
    one = files.agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    return hashlib.sha256(f"{version}\x1f{one.n}\x1f{one.s}".encode()).hexdigest()[:32]


def cached(source: DataFrame, name: str, version: str, build: Callable[[DataFrame], DataFrame], move: bool = False) -> tuple[DataFrame, bool]:
    """``build(source)`` from a kept copy if the files behind ``source`` and ``version`` are those it was made of; and whether it was.

    The copy is written aside and renamed to its key, so a broken write is never read; copies of other keys go.  With ``move``, what
    ``build`` gives is a table made by ``stored`` and renamed itself.
    """
    spark = source.sparkSession
    folder = f"{shared_folder(spark)}/parlance/cached/{name}"
    key = staleness_key(source, version)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{key}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    hit = fs.exists(at)
    if not hit:
        made = build(source)
        if move:
            aside = made.inputFiles()[0].rpartition("/")[0]
            fs.mkdirs(at.getParent())
        else:
            aside = f"{folder}/.aside-{uuid.uuid4().hex}"
            _write(made, aside)
        fs.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), at)
        for old in fs.listStatus(at.getParent()):
            if old.getPath().getName() != key and not old.getPath().getName().startswith("."):
                fs.delete(old.getPath(), True)
    return spark.read.parquet(f"{folder}/{key}"), hit


def guarded_export(df: DataFrame, path: str, canonical: DataFrame, key: str, text: str = "text") -> int:
    """Writes ``df`` as CSV if every text equals that of the same key in ``canonical``; else raises and writes nothing."""
    both = df.select(key, F.col(text).alias("_found")).join(canonical.select(key, F.col(text).alias("_told"), F.lit(True).alias("_known")), key, "left")
    bad = both.where(F.col("_known").isNull() | ~F.col("_found").eqNullSafe(F.col("_told"))).count()
    if bad:
        raise ValueError(f"{bad} texts differ from the source; nothing was written")
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.count()


def fingerprint(df: DataFrame) -> DataFrame:
    """Size and modification time of each file behind ``df``, from file metadata alone: the key of a cached copy."""
    return df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, sha256) of whole files; Spark's reader gives no row for a file without a byte."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("sha256"))


def read_predictions(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Prediction files of all systems; the system is the second part of 'kind_system_split.csv'."""
    found = spark.read.csv(pattern, schema=schema, header=True)
    return found.withColumn("system", F.regexp_extract(F.col("_metadata.file_name"), r"^[a-z]+_(.+)_[a-z]+\.csv$", 1))


def write_predictions(df: DataFrame, path: str, **about: str) -> None:
    """Predictions as CSV and, beside them, one JSON row that describes them."""
    df.write.mode("overwrite").option("header", True).csv(path)
    spark = df.sparkSession
    spark.createDataFrame([about]).coalesce(1).write.mode("overwrite").json(f"{path}.meta")


def report(df: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
