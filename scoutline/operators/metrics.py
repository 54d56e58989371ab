"""Ranking metrics, significance tests and agreement of raters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ranking(ranks: DataFrame, rank: str = "rank", cut: int | None = None) -> DataFrame:
    """hr1, hr3, hr5, hr10, p5, ndcg5 in percent or share, mrr (0 beyond cut); a null rank is a miss."""
    r = F.col(rank)
    counted = r if cut is None else F.when(r <= cut, r)
    hit = lambda k: F.round(F.avg(F.when(r <= k, 100.0).otherwise(0.0)), 6)
    return ranks.agg(
        F.count("*").alias("n"), *[hit(k).alias(f"hr{k}") for k in (1, 3, 5, 10)], F.round(F.avg(F.when(r <= 5, 20.0).otherwise(0.0)), 6).alias("p5"),
        F.round(F.avg(F.coalesce(1.0 / counted, F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(r <= 5, 1.0 / F.log2(r + 1)).otherwise(0.0)), 6).alias("ndcg5"),
    )


def _dcg(grade: Column, rank: Column) -> Column:
    return F.sum((F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1))


def graded(rows: DataFrame, k: int = 5) -> DataFrame:
    """Means over queries of (q, rank, grade): strict and lenient precision and hits at k, and nDCG against all graded rows. Of a
    query's rows only the first k and the k best grades are gathered."""
    top = rows.where(F.col("rank") <= k).groupBy("q").agg(
        F.count_if(F.col("grade") >= 1.5).alias("strict"), F.count_if(F.col("grade") >= 0.5).alias("lenient"), F.count("*").alias("n"), _dcg(F.col("grade"), F.col("rank")).alias("dcg"),
    )
    best = rows.withColumn("best", F.row_number().over(W.partitionBy("q").orderBy(F.desc("grade")))).where(F.col("best") <= k)
    per = best.groupBy("q").agg(_dcg(F.col("grade"), F.col("best")).alias("idcg")).join(top, "q", "left").na.fill(0, ["strict", "lenient", "n"])
    mean = lambda c: F.round(F.avg(c), 6)
    return per.agg(
        F.count("*").alias("queries"), mean(F.try_divide("strict", "n")).alias("p_strict"), mean(F.try_divide("lenient", "n")).alias("p_lenient"),
        mean((F.col("strict") > 0).cast("int")).alias("hit_strict"), mean((F.col("lenient") > 0).cast("int")).alias("hit_lenient"),
        mean(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0)).alias("ndcg"),
    )


def single_target(rows: DataFrame, k: int = 5) -> DataFrame:
    """(queries, p_at_k, hit_rate) in percent of (q, rank, is_gold): shares of gold rows among a query's first k, and of queries with one there."""
    per = rows.where(F.col("rank") <= k).groupBy("q").agg(F.avg(F.col("is_gold").cast("int")).alias("p"), F.max(F.col("is_gold").cast("int")).alias("hit"))
    every = rows.select("q").distinct().join(per, "q", "left").na.fill(0)
    return every.agg(F.count("*").alias("queries"), F.round(100 * F.avg("p"), 6).alias("p_at_k"), F.round(100 * F.avg("hit"), 6).alias("hit_rate"))


def bincount(rows: DataFrame, column: str, least: int) -> DataFrame:
    """(value, n) of a column of small whole numbers, with all values from 0 to least - 1, counted or not."""
    n = rows.where(F.col(column) >= 0).groupBy(F.col(column).cast("bigint").alias("value")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(least).select(F.col("id").alias("value"))
    return every.join(n, "value", "full").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def timed(steps: dict, n: int = 1) -> dict[str, float]:
    """Milliseconds for each of n queries of each step, a function that gives a DataFrame, when its rows are worked out."""
    import time

    out = {}
    for name, step in steps.items():
        began = time.perf_counter()
        step().write.format("noop").mode("overwrite").save()
        out[name] = 1000 * (time.perf_counter() - began) / max(1, n)
    return out


def crosstab(rows: DataFrame, a: str, b: str, grades: int = 3) -> DataFrame:
    """(a, b, n) over all pairs of grades."""
    spark = rows.sparkSession
    every = spark.range(grades * grades).select((F.col("id") / grades).cast("int").alias("a"), (F.col("id") % grades).cast("int").alias("b"))
    counts = rows.groupBy(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).agg(F.count("*").alias("n"))
    return every.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def expert_agreement(human: DataFrame, machine: DataFrame, grades: int = 3) -> DataFrame:
    """agreement() of human_score and llm_score over the pairs (q, cand) that both have; scores that are no numbers are left out."""
    from scoutline.operators.preparation import numeric

    both = numeric(human.select("q", "cand", "human_score"), "human_score").join(numeric(machine.select("q", "cand", "llm_score"), "llm_score"), ["q", "cand"])
    return agreement(both, "human_score", "llm_score", grades)


def agreement(rows: DataFrame, a: str, b: str, grades: int = 3) -> DataFrame:
    """n, exact, within_one, kappa (quadratic weights; 0 if one rating never varies in both), spearman (average ranks)."""
    t = crosstab(rows, a, b, grades)
    n = F.sum("n").over(W.partitionBy())  # nine rows
    ra, rb = F.sum("n").over(W.partitionBy("a")), F.sum("n").over(W.partitionBy("b"))
    w = F.pow((F.col("a") - F.col("b")).cast("double"), F.lit(2.0)) / float((grades - 1) ** 2)
    t = t.withColumn("w", w).withColumn("e", ra * rb / n)
    kappa = F.when(F.sum(F.col("w") * F.col("e")) > 0, 1 - F.sum(F.col("w") * F.col("n")) / F.sum(F.col("w") * F.col("e"))).otherwise(0.0)
    ranks = lambda c: (F.sum("n").over(W.partitionBy(c)), c)
    out = t.agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("exact"), F.round(F.sum(F.when(F.abs(F.col("a") - F.col("b")) <= 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("within_one"), F.round(kappa, 6).alias("kappa"))
    # average ranks follow from the counts of grades, so no row is sorted
    def mean_rank(c: str) -> DataFrame:
        g = t.groupBy(c).agg(F.sum("n").alias("k"))
        return g.select(c, (F.sum("k").over(W.orderBy(c)) - (F.col("k") - 1) / 2.0).alias(f"r{c}"))

    r = t.join(mean_rank("a"), "a").join(mean_rank("b"), "b")
    m = r.agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.col("ra")).alias("x"), F.sum(F.col("n") * F.col("rb")).alias("y"), F.sum(F.col("n") * F.col("ra") * F.col("ra")).alias("xx"), F.sum(F.col("n") * F.col("rb") * F.col("rb")).alias("yy"), F.sum(F.col("n") * F.col("ra") * F.col("rb")).alias("xy"))
    rho = F.try_divide(F.col("k") * F.col("xy") - F.col("x") * F.col("y"), F.sqrt((F.col("k") * F.col("xx") - F.col("x") ** 2) * (F.col("k") * F.col("yy") - F.col("y") ** 2)))
    return out.crossJoin(m.select(F.round(rho, 6).alias("spearman")))  # a row by a row


#: Discordant pairs up to which McNemar's test is summed exactly; beyond, the normal limit with continuity correction.
EXACT_PAIRS = 200_000
_MASK, _GOLDEN = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _poisson() -> list[float]:
    """The cumulative chances of 0 to 7 for a mean of 1."""
    out, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
    return out


def _sums(rows: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, wv, w): for each sample the weighted sum and the weights of rows (key, v). A row's weight in a sample is a Poisson
    number drawn from its key, so it is the same however rows are dealt; a task sends one row a sample."""
    import numpy as np

    cdf = _poisson()

    def mixed(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def run(batches):
        import pyarrow as pa

        wv, w = np.zeros(reps), np.zeros(reps)
        steps = np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            v = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            for k in range(0, len(key), 1_000):
                with np.errstate(over="ignore"):
                    own = mixed(key[k : k + 1_000] + np.uint64(seed * _GOLDEN & _MASK))
                    u = (mixed(own[:, None] + steps[None, :]) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
                weight = np.searchsorted(cdf, u.ravel(), side="left").reshape(u.shape).astype(np.float64)
                wv += v[k : k + 1_000] @ weight
                w += weight.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, reps + 1)), pa.array(wv), pa.array(w)], names=["rep", "wv", "w"])

    known = rows.where("key is not null and v is not null").select(F.col("key").cast("long"), F.col("v").cast("double"))
    return known.mapInArrow(run, "rep bigint, wv double, w double").groupBy("rep").agg(F.sum("wv").alias("wv"), F.sum("w").alias("w"))


def _keyed(df: DataFrame, key: str | None, *columns: str) -> Column:
    """What a row draws from: its key, else a hash of its values and of how often they came before in its task."""
    return F.col(key).cast("long") if key else F.xxhash64(*columns, F.monotonically_increasing_id())


def bootstrap_ci(values: DataFrame, value: str = "hit", reps: int = 1000, seed: int = 42, key: str | None = None) -> DataFrame:
    """(mean, low, high) of the mean under resampling. Each row counts a Poisson(1) number of times in a sample, which stands for
    drawing n rows with replacement; with a key (an identifier) the interval doesn't depend on how rows are dealt."""
    rows = values.select(_keyed(values, key, value).alias("key"), F.col(value).alias("v"))
    means = _sums(rows, reps, seed).select(F.try_divide("wv", "w").alias("m"))
    ci = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return values.agg(F.avg(value).alias("mean")).crossJoin(ci)  # a row by a row


def paired_bootstrap(pairs: DataFrame, reps: int = 1000, seed: int = 42, key: str | None = None) -> DataFrame:
    """(observed, p) of the mean of a - b: two-sided, centred, (count + 1) / (reps + 1)."""
    d = pairs.select(_keyed(pairs, key, "a", "b").alias("key"), (F.col("a") - F.col("b")).alias("v"))
    mean = d.agg(F.avg("v").alias("observed"))
    # the mean of centred values is the mean less the observed one
    means = _sums(d, reps, seed).crossJoin(F.broadcast(mean)).select("observed", (F.try_divide("wv", "w") - F.col("observed")).alias("m"))  # one row
    return means.groupBy("observed").agg(((F.count_if(F.abs("m") >= F.abs("observed") - 1e-12) + 1) / (reps + 1)).alias("p"))


def mcnemar_p(b01: int, b10: int) -> float:
    """The two-sided binomial test of the pairs that differ; 1 if none does."""
    n, least = b01 + b10, min(b01, b10)
    if n == 0:
        return 1.0
    if n > EXACT_PAIRS:
        z = max(0.0, abs(b01 - b10) - 1) / math.sqrt(n)
        return math.erfc(z / math.sqrt(2))
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
    return min(1.0, 2 * math.fsum(math.exp(log(i)) for i in range(least + 1)))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """(b01, b10, p) of 0/1 columns a and b: exact up to EXACT_PAIRS pairs that differ."""
    c = pairs.agg(F.count_if(F.expr("a = 0 and b = 1")).alias("b01"), F.count_if(F.expr("a = 1 and b = 0")).alias("b10"))

    def run(frames):  # one row
        for pdf in frames:
            yield pdf.assign(p=[round(mcnemar_p(int(x), int(y)), 6) for x, y in zip(pdf["b01"], pdf["b10"])])

    return c.mapInPandas(run, "b01 bigint, b10 bigint, p double")


def compare_all(hits: DataFrame, reps: int = 10_000, seed: int = 42) -> DataFrame:
    """(x, y, diff, p_bootstrap, p_mcnemar) for each two settings of (setting, q, hit), x before y; diff in percent."""
    out = None
    names = sorted(r[0] for r in hits.select("setting").distinct().collect())  # a few settings
    side = lambda name, c: hits.where(F.col("setting") == name).select("q", F.col("hit").cast("double").alias(c))
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            pairs = side(x, "a").join(side(y, "b"), "q")
            boot = paired_bootstrap(pairs, reps, seed, key="q").withColumnRenamed("p", "p_bootstrap")
            row = boot.crossJoin(mcnemar(pairs).select(F.col("p").alias("p_mcnemar")))  # a row by a row
            row = row.select(F.lit(x).alias("x"), F.lit(y).alias("y"), F.round(100 * F.col("observed"), 6).alias("diff"), F.round("p_bootstrap", 6).alias("p_bootstrap"), "p_mcnemar")
            out = row if out is None else out.unionByName(row)
    return out


def by_subset(ranks: DataFrame, subset: str = "named") -> DataFrame:
    """(subset, n, hr1, hr5) in percent of (rank, subset)."""
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 100.0).otherwise(0.0)), 6).alias(f"hr{k}")
    return ranks.groupBy(F.col(subset).alias("subset")).agg(F.count("*").alias("n"), hit(1), hit(5))


def top_k_accuracy(ranked: DataFrame) -> DataFrame:
    """(n, top1, top3, macro_f1) in percent from (label, ranked: labels from the likeliest on); macro-F1 over all labels that occur or are predicted."""
    rows = ranked.select("label", F.get("ranked", F.lit(0)).alias("predicted"), F.array_contains(F.slice("ranked", 1, 3), F.col("label")).alias("in3"))
    t = rows.groupBy("label", "predicted").agg(F.count("*").alias("n"), F.count_if("in3").alias("in3"))
    g = t.groupBy("label").agg(F.sum("n").alias("ng"), F.sum("in3").alias("in3"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = t.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("np"))
    j = g.join(p, "label", "full").na.fill(0, ["ng", "np", "tp", "in3"])
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("ng") + F.col("np")), F.lit(0.0))
    share = lambda c: F.round(100 * F.sum(c) / F.sum("ng"), 6)
    return j.agg(F.sum("ng").alias("n"), share("tp").alias("top1"), share("in3").alias("top3"), F.round(100 * F.avg(f1), 6).alias("macro_f1"))


def classification(rows: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from (label, predicted)."""
    t = rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    g = t.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = t.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("np"))
    j = g.join(p, "label", "left")
    pr, re = F.coalesce(F.try_divide("tp", "np"), F.lit(0.0)), F.try_divide("tp", "support")
    return j.select("label", F.round(pr, 6).alias("precision"), F.round(re, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * pr * re, pr + re), F.lit(0.0)), 6).alias("f1"), "support")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, weight): N / (K * n)."""
    g = rows.groupBy(label).agg(F.count("*").alias("n"))
    return g.select(label, F.round(F.sum("n").over(W.partitionBy()) / (F.count("*").over(W.partitionBy()) * F.col("n")), 6).alias("weight"))
