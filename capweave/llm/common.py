"""What the training-data operators share: tables, shared storage, prefix sums, components."""

from __future__ import annotations

import atexit
import gc
import uuid
import zlib
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOCAL_CHECKPOINT_DIR = "/tmp/capweave-checkpoints"  # of a single machine, in tests
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by whatever file system its path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a single machine where none is set."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not got.isDefined() and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = got.get() if got.isDefined() else LOCAL_CHECKPOINT_DIR
    return set_to


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows move to shared storage and the lineage ends there."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, removed when the session's driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/capweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession, keep: int = 0):
    """What is stored inside is removed at the end, less the last `keep` tables, which pass to the scope around.

    For eager work only: nothing that is read later may still refer to a table of the scope.
    """
    _scopes.append([])
    done = False
    try:
        yield
        done = True
    finally:
        paths = _scopes.pop()
        kept = paths[len(paths) - keep :] if done and keep else []
        for path in paths[: len(paths) - len(kept)]:
            _remove(spark, path)
        if _scopes:
            _scopes[-1].extend(kept)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone when the interpreter ends
        pass


def release(spark: SparkSession) -> None:
    """Lets go of finished shuffles, whose files stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Rows go to Python in batches of about that many bytes from now on in this session, or of less if it is set so.

    Spark fills them up to 10,000 rows or 64 MB, and each task holds a batch in the executor's buffers, which double as
    they grow, and once more in its Python worker. No operator's result depends on where a batch ends.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id written as text; the folds of the learned operators come from it."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def crc_of_value(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node that has an edge and the smallest node it reaches.

    edges: columns u, v of one orderable type; self loops and repeats are harmless. Alternates the
    large-star and small-star steps until a round changes nothing; each round is a min per node
    (combined before the shuffle) and an equi-join, whose hubs adaptive execution splits. Rounds are
    stored tables, so a lost executor costs one round; all but the last go at the end.
    """
    spark = edges.sparkSession
    with scratch(spark, keep=1):
        e = _settled(edges)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _settled(edges: DataFrame) -> DataFrame:
    """The edges (node, root) of components, as a stored table."""
    spark = edges.sparkSession
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        j = both.join(low, "u")
        if large:
            out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    was = mark(e)
    while True:
        with scratch(spark, keep=1):
            e = stored(star(star(e, True), False))
        now = mark(e)
        release(spark)
        if now == was:
            return e
        was = now


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int, key: str = "doc_id", text: str = "text", folds: int = 5) -> tuple[DataFrame, float]:
    """((label 0/1, text) of at most per_class training rows of each label, share of label 1 among all training rows).

    Training rows are labelled rows whose crc32(key as text) mod folds is not 0, in a seeded hash order of the key.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (crc_of(F.col(key)) % folds != 0))
    rows = rows.select(F.col(key).alias("_k"), (F.col(label) == 1).cast("int").alias("_y")).distinct()
    share = rows.agg(F.avg("_y")).first()[0]
    order = Window.partitionBy("_y").orderBy(F.xxhash64(F.lit(seed), "_k"), "_k")
    chosen = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class).drop("_n")
    # at most 2 * per_class rows of two numbers
    out = docs.select(F.col(key).alias("_d"), F.col(text).alias("_t")).join(F.broadcast(chosen), F.col("_d") == F.col("_k"))
    return out.select(F.col("_y").alias("label"), F.col("_t").alias("text")), 0.5 if share is None else float(share)


SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has so few rows, else as it is: the join then shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
