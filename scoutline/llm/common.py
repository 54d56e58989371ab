"""What the text operators share: the shared folder, Arrow cells, components of a graph."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a local session, where all is one machine, gets one of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scoutline-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scoutline/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, run: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors. run: a folder of scratch() that is discarded as a whole."""
    path = f"{run}/{name}-{uuid.uuid4().hex}" if run else scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, run: str) -> None:
    """Deletes a folder of scratch() whose tables no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cells(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string or binary column, without decoding; null counts as empty."""
    import pyarrow as pa

    if len(column) == 0:
        return []
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    out = [bytes(view[a:b]) for a, b in zip(at, at[1:])]
    if column.null_count:
        out = [b"" if null else cell for cell, null in zip(out, column.is_null().to_pylist())]
    return out


def one_space(text: bytes) -> bytes:
    """Each run of white space becomes one space (bytes.split() knows exactly the six characters)."""
    if not text:
        return text
    body = b" ".join(text.split())
    if not body:
        return b" "
    return (b" " if text[0] in b" \t\n\v\f\r" else b"") + body + (b" " if text[-1] in b" \t\n\v\f\r" else b"")


def one_each(rows: DataFrame, key: list[str], held: str = "row") -> DataFrame:
    """Of the rows with one key the one that is written least, the same in every run, with the columns of the struct held."""
    return rows.groupBy(*key).agg(F.min_by(held, F.to_json(held)).alias(held)).select(f"{held}.*")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), by alternating large and small stars.

    Each round is two hash aggregations and two joins, which AQE splits where a star is hot; the round's
    edges are written to the shared folder, and those of the round before deleted. Stops when the edges no longer change.
    """
    spark = edges.sparkSession
    run = scratch(spark, "components")
    now = materialise(edges.selectExpr("greatest(a, b) a", "least(a, b) b").where("a <> b").distinct(), "edges", run)

    def print_of(df: DataFrame):
        # a sum of hashes kept to 31 bits, so that it cannot overflow
        return tuple(df.selectExpr("count(*)", "sum(pmod(xxhash64(a, b), 2147483647))").first())

    before = print_of(now)
    if not before[0]:
        return spark.createDataFrame([], "node bigint, component bigint")
    for _ in range(max_rounds):
        both = now.unionByName(now.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").selectExpr("b a", "m b").where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("b a", "m b").unionByName(least.selectExpr("a", "m b"))
        old, run = run, scratch(spark, "components")
        now = materialise(small.where("a <> b").distinct(), "edges", run).select("a", "b")
        discard(spark, old)
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = stars.selectExpr("component node", "component").distinct()
    return stars.unionByName(roots).distinct()
