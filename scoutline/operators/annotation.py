"""Annotation sets, subsets for experts and scores by a judge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scoutline.operators.preparation import draw


def stratified(queries: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n queries, one of each stratum in turn, in random order within a stratum; no more than n of a stratum are ranked."""
    rn = F.row_number().over(W.partitionBy(stratum).orderBy(draw(key, seed=seed), key))
    return queries.withColumn("rn", rn).where(F.col("rn") <= n).orderBy("rn", stratum).limit(n).drop("rn")


def candidates(ranked: DataFrame, k: int = 5) -> DataFrame:
    """The first k of each query of (q, cand, rank, is_gold) and its gold one, wherever that stands."""
    return ranked.where((F.col("rank") <= k) | F.col("is_gold"))


def build(queries: DataFrame, ranked: DataFrame, stratum: str = "province", n: int = 50, k: int = 5, seed: int = 42) -> DataFrame:
    """(q, cand, rank, is_gold, place): n queries (q, province, ...) chosen by stratified(), each with its first k of ranked (q, cand,
    rank, is_gold) and its gold one, in random order (place)."""
    chosen = stratified(queries, stratum, "q", n, seed).select("q")
    rows = candidates(ranked.join(chosen, "q", "left_semi"), k)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(draw("q", "cand", seed=seed), "cand")).cast("long"))


def expert_subset(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows at random, in the order of key."""
    return rows.orderBy(draw(key, seed=seed), key).limit(n).orderBy(key)


def judge(rows: DataFrame, ask: Callable[[str, str], str], tries: int = 4, wait: float = 1.0) -> DataFrame:
    """Adds score (held to 0 to 2) and reason to (q, cand, query, passage). ask is an outside service: what it raises and
    answers that can't be read are tried again after wait, twice that, and so on; in the end the score is 0, "judge failed"."""
    import json
    import time

    def run(batches):
        for pdf in batches:
            scores, reasons = [], []
            for a, b in zip(pdf["query"], pdf["passage"]):
                score, reason = 0, "judge failed"
                for k in range(tries):
                    try:
                        got = json.loads(ask(a, b))
                        score, reason = max(0, min(2, int(got["score"]))), str(got.get("reason", ""))[:200]
                        break
                    except Exception:  # noqa: BLE001 - whatever the service raises
                        if k + 1 < tries:
                            time.sleep(wait * 2**k)
                scores.append(score)
                reasons.append(reason)
            yield pdf.assign(score=scores, reason=reasons)[["q", "cand", "score", "reason"]]

    return rows.mapInPandas(run, "q bigint, cand bigint, score int, reason string")
