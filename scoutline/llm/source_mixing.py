"""Mixing sources to target weights by Pareto order sampling.

Sources, in order of code points with null last, weigh 1, 2, 3, 1, ... and share all words; a source's
target stops at three times its words and what is over is shared anew by weight. A target of r times a
source's words gives each of its documents floor(r) certain copies; the rest is a sample of fixed size in
words. Documents draw a random odds u/(1-u) from identifier, size and text, divided by the odds of their inclusion
probability, which follows a tempered length weight; in that order documents are taken while they fit,
then the one that best fills what is left. The order is never sorted as a whole: the place where the words
run out is found by three rounds of 1024 bins a source, each one aggregation of (source, bin), and only the
last bin's documents are ordered. Nothing but a few hundred rows a source comes to the driver.

Cases: null and empty texts have size 0; a source of size 0 has target 0; a null source is a source of its
own, last; a null doc_id is drawn like any other. Rows that repeat doc_id, source and text are numbered, in the
order of the written rows, and each number draws for itself, so a group of them is taken in part like other rows
and does not meet in one bin; which of them is taken is left open, their number is not. An empty table gives no
rows; other columns are ignored. The draw depends on the seed only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scoutline.llm.common import WORD, discard, materialise, scratch

#: Weights of the sources in order, repeated.
WEIGHTS = (1, 2, 3)
#: The most copies of a document, and of its source.
MOST = 3
SEED = 17
#: Bins a round, as a power of two, and rounds.
BITS, ROUNDS = 10, 3
#: Certain inclusion is kept a little under 1, so that ranks differ.
SURE = 0.999


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the whole by weight; what is over most times a size goes to the others by weight."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def _scale(levels: list[tuple[float, int]], words: float) -> float:
    """x with sum(min(SURE, x * weight) * words of that weight) = words, or large enough for all."""
    low, high = 0.0, 1.0 / min(w for w, _ in levels)
    for _ in range(60):
        x = (low + high) / 2
        if sum(min(SURE, x * w) * n for w, n in levels) < words:
            low = x
        else:
            high = x
    return high


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _weight(size: Column) -> Column:
    """Longer documents are a little likelier; in eighths, so that a source has few distinct weights."""
    return F.round(F.log2(size + 2.0) * 8) / 8


def _ranked(df: DataFrame, seed: int) -> DataFrame:
    """Adds q, random odds over inclusion odds, and bin, its place among 2^30; df has h, no, size and scale."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col("h"), F.col("no"), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(2**53))
    p = F.least(F.lit(SURE), F.greatest(F.lit(1e-9), F.col("scale") * _weight(F.col("size"))))
    df = df.withColumn("q", u / (1 - u) * (1 - p) / p)
    return df.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * float(2 ** (BITS * ROUNDS))).cast("long"))


def _narrow(docs: DataFrame) -> list[Column]:
    """doc_id, source, key, size and h, the hash of what a document draws from."""
    source = F.col("source").cast("string")
    return [F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), _key(source).alias("key"), size_of(F.col("text")).alias("size"), F.xxhash64(F.col("doc_id").cast("long"), _key(source), F.coalesce("text", F.lit(""))).alias("h")]


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds no to written rows with row (their place) and h: 0, 1, ... among equal h. Numbers go on from one written part to
    the next, by the parts' counts, so a large group is numbered by as many tasks as wrote it."""
    rows = rows.withColumn("part", F.shiftright("row", 33))
    parts = rows.groupBy("h", "part").agg(F.count("*").alias("n"))
    before = parts.select("h", "part", (F.sum("n").over(W.partitionBy("h").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("h", "part").orderBy("row")) - 1
    return rows.withColumn("inside", inside).join(before, ["h", "part"]).withColumn("no", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def _rows(docs: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """(a written narrow row with no for each row of docs, the h of rows that repeat)."""
    narrow = materialise(docs.select(*_narrow(docs)).withColumn("row", F.monotonically_increasing_id()), "narrow", run)
    repeated = materialise(narrow.groupBy("h").count().where("count > 1").select("h"), "repeated")
    if repeated.isEmpty():
        return narrow.withColumn("no", F.lit(0).cast("long")), repeated
    once = narrow.join(repeated, "h", "left_anti").withColumn("no", F.lit(0).cast("long"))
    several = _numbered(narrow.join(repeated, "h", "left_semi"))
    return materialise(once.unionByName(several.select(*once.columns)), "sizes"), repeated


def plan(narrow: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row a source: key, source_size, target, whole, scale, open_bin and the last document taken in it, and the one
    that fills. narrow: key, size, h, no, written."""
    spark = narrow.sparkSession
    run = scratch(spark, "mixing")
    found: dict[str, list] = {}
    for r in narrow.groupBy("key", _weight(F.col("size")).alias("weight")).agg(F.sum("size").alias("words")).toLocalIterator():
        found.setdefault(r["key"], []).append((r["weight"], r["words"]))
    keys = sorted(found, key=lambda k: (k[0] == "n", k))
    sizes = [sum(n for _, n in found[k]) for k in keys]
    rows = []
    for k, size, target in zip(keys, sizes, targets(sizes, [weights[i % len(weights)] for i in range(len(keys))], most)):
        whole = min(most, math.floor(target / size + 1e-12)) if size else 0
        rest = max(0.0, target - whole * size)
        rows.append((k, size, target, whole, rest, _scale(found[k], rest)))
    # written, so that its size is known: joins send it as it is a row a source, and no source is gathered in a task
    sources = materialise(spark.createDataFrame(rows, "key string, source_size bigint, target double, whole int, rest double, scale double"), "sources", run)

    open_ = sources.select("key", "rest", "scale", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for k in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - k)
        ranked = _ranked(narrow.join(open_, "key"), seed).withColumn("at", F.shiftright("bin", shift))
        inside = ranked.where(F.shiftright("bin", shift + BITS) == F.col("prefix"))
        bins = inside.groupBy("key", "at").agg(F.sum("size").alias("words"))
        upto = bins.withColumn("upto", F.sum("words").over(W.partitionBy("key").orderBy("at")))
        upto = upto.join(open_, "key").withColumn("upto", F.col("upto") + F.col("before"))
        first = upto.where("upto > rest").groupBy("key").agg(F.min(F.struct("at", (F.col("upto") - F.col("words")).alias("before"))).alias("m"))
        none_left = 2 ** (BITS * (k + 1))  # all that is left is taken
        open_ = materialise(open_.drop("prefix").withColumnRenamed("before", "was").join(first, "key", "left").select("key", "rest", "scale", F.coalesce("m.at", F.lit(none_left)).cast("long").alias("prefix"), F.coalesce("m.before", "was").alias("before")), "bins", run)
    last = _ranked(narrow.join(open_, "key"), seed)
    order = ["q", "h", "no", "size"]
    cum = last.where("bin = prefix").withColumn("upto", F.col("before") + F.sum("size").over(W.partitionBy("key").orderBy(*order)))
    cut = cum.where("upto <= rest").groupBy("key").agg(F.max(F.struct(*order)).alias("cut"))
    cuts = materialise(sources.drop("rest", "scale").join(open_, "key").join(cut, "key", "left").withColumnRenamed("prefix", "open_bin"), "cuts", run).drop("before")
    # the untaken document that fills best what is left
    state = _ranked(narrow.join(cuts, "key"), seed).withColumn("in", _taken())
    left = state.groupBy("key").agg((F.max("rest") - F.sum(F.when(F.col("in"), F.col("size")).otherwise(0))).alias("gap"))
    left = materialise(left, "gaps", run)
    fits = state.where("not `in` and size > 0").join(left, "key").withColumn("off", F.abs(F.col("size") - F.col("gap"))).where("off < gap")
    fill = fits.groupBy("key").agg(F.min(F.struct("off", *order)).alias("fill"))
    out = materialise(cuts.join(fill, "key", "left"), "plan")
    discard(spark, run)
    return out


def _taken() -> Column:
    before = F.struct("q", "h", "no", "size") <= F.col("cut")
    return (F.col("bin") < F.col("open_bin")) | ((F.col("bin") == F.col("open_bin")) & F.coalesce(before, F.lit(False)))


def _copies(joined: DataFrame, seed: int) -> DataFrame:
    """Adds copies; joined has h, no, size and the columns of a plan."""
    fills = F.coalesce((F.col("h") == F.col("fill.h")) & (F.col("no") == F.col("fill.no")), F.lit(False))
    return _ranked(joined, seed).withColumn("copies", F.col("whole") + (_taken() | fills).cast("int"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies: one row for each row of docs (doc_id, source, text)."""
    narrow, _ = _rows(docs, scratch(docs.sparkSession, "mix"))
    out = _copies(narrow.join(plan(narrow, weights, most, seed), "key"), seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def take(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as the mix takes them, with docs' columns."""
    spark = docs.sparkSession
    run = scratch(spark, "mix")
    narrow, repeated = _rows(docs, run)
    planned = plan(narrow, weights, most, seed)
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(*_narrow(docs), held).withColumn("no", F.lit(0).cast("long"))
    if not repeated.isEmpty():
        several = rows.drop("no").join(repeated, "h", "left_semi").withColumn("row", F.monotonically_increasing_id())
        several = _numbered(materialise(several, "several"))
        rows = rows.join(repeated, "h", "left_anti").unionByName(several.select(*rows.columns))
    discard(spark, run)
    out = _copies(rows.join(planned, "key"), seed)
    # outer, since a filter on copies would move into the join and work out the draw there many times over
    return out.select("__row", F.explode_outer(F.array_repeat(F.lit(1), F.col("copies"))).alias("__copy")).where("__copy is not null").select("__row.*")


QUERIES = {"op7_source_mixing": lambda spark, sf_dir: mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
ORACLES: dict[str, str] = {}
