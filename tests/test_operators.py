import math
import random

import pytest
from pyspark.sql import functions as F

from scoutline.operators import annotation, classify, cooccurrence, knowledge, metrics, places, retrieval, tagging


def test_cooccurrence(spark):
    b = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)], "production_id bigint, item_id bigint")
    got = {(r["src"], r["dst"]): (r["w"], r["sim"]) for r in cooccurrence.edges(b).collect()}
    assert got[1, 2] == (1.5, 0.75) and got[2, 1] == (1.5, 0.75)
    assert got[1, 3][0] == 0.5 and len(got) == 6


def test_bm25_idf(spark):
    docs = spark.createDataFrame([(1, "elma"), (2, "armut"), (3, "kiraz"), (4, None)], "doc_id bigint, text string").where("doc_id < 4")
    q = spark.createDataFrame([(1, "elma")], "item_id bigint, text string")
    assert [(r["doc_id"], r["score"]) for r in retrieval.bm25(docs, q).collect()] == [(1, round(math.log(8 / 3), 6))]


def grid(spark, n=14, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, "p", 36 + rng.random(), 26 + rng.random()) for i in range(n)], "location_id bigint, province string, lat double, lon double")


def test_near_pairs_are_all_pairs(spark):
    p = grid(spark, 60)
    rows = p.collect()
    want = {(a["location_id"], b["location_id"]) for a in rows for b in rows if a["location_id"] < b["location_id"] and places._km((a["lat"], a["lon"]), (b["lat"], b["lon"])) <= 15}
    got = places.near_pairs(p)
    assert {(r["a"], r["b"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_path_algorithms_agree(spark):
    p = grid(spark)
    e = places.region_graph(p, 2)
    rows = [(r["src"], r["dst"], r["km"]) for r in e.collect()]
    coords = {r["location_id"]: (r["lat"], r["lon"]) for r in p.collect()}
    everywhere = {(r["i"], r["j"]): r["d"] for r in places.all_pairs(e).collect()}
    one = {r["node"]: (r["dist"], r["path"]) for r in places.shortest_paths(e, 0).collect()}
    for t in coords:
        a, na = places.expansions(rows, coords, 0, t, False)
        b, nb = places.expansions(rows, coords, 0, t, True)
        assert a == pytest.approx(b, abs=1e-5) and a == pytest.approx(everywhere[0, t], abs=1e-4) and a == pytest.approx(one[t][0], abs=1e-4)
        assert nb <= na and one[t][1][0] == 0 and one[t][1][-1] == t


def test_open_route():
    order, total = places.order_stops([(0.0, 0.0), (0.0, 2.0), (0.0, 1.0)])
    assert order == [0, 2, 1] and total == pytest.approx(2 * places._km((0, 0), (0, 1)))
    points = [(random.Random(i).random(), random.Random(i + 99).random()) for i in range(12)]
    order, total = places.order_stops(points)
    assert sorted(order) == list(range(12)) and order[0] == 0


def test_ranking_metrics(spark):
    r = metrics.ranking(spark.createDataFrame([(1,), (3,), (7,)], "rank bigint")).first()
    assert (r["hr5"], r["mrr"]) == (66.666667, 0.492063)


def test_graded(spark):
    r = metrics.graded(spark.createDataFrame([(1, 1, 2.0), (1, 2, 0.0), (1, 3, 1.0)], "q bigint, rank bigint, grade double")).first()
    assert r["ndcg"] == round(3.5 / (3 + 1 / math.log2(3)), 6)


def test_kappa(spark):
    same = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "a int, b int")
    flat = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert metrics.agreement(same, "a", "b").first()["kappa"] == 1.0
    assert metrics.agreement(flat, "a", "b").first()["kappa"] == 0.0


def test_mcnemar(spark):
    pairs = spark.createDataFrame([(0, 1)] * 8 + [(1, 0)] * 2 + [(1, 1)] * 5, "a int, b int")
    assert metrics.mcnemar(pairs).first()["p"] == 0.109375
    assert metrics.mcnemar(spark.createDataFrame([(1, 1)], "a int, b int")).first()["p"] == 1.0


def test_bootstrap(spark):
    ci = metrics.bootstrap_ci(spark.range(200).select((F.col("id") % 2).cast("double").alias("hit")), reps=200).first()
    assert ci["low"] < ci["mean"] == 0.5 < ci["high"]


def test_judge(spark):
    rows = spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "a", "bad")], "q bigint, cand bigint, query string, passage string")
    got = {r["cand"]: (r["score"], r["reason"]) for r in annotation.judge(rows, lambda q, p: "{}" if p == "bad" else '{"score": 7, "reason": "ok"}').collect()}
    assert got == {1: (2, "ok"), 2: (0, "judge failed")}


def test_knowledge_graph(spark):
    p = spark.createDataFrame([(1, "Dram", "bilinmiyor")], "production_id bigint, genre string, director string")
    b = spark.createDataFrame([(1, 5)], "production_id bigint, location_id bigint")
    cast = spark.createDataFrame([(1, 9)], "production_id bigint, item_id bigint")
    loc = spark.createDataFrame([(5, 36.0, 26.0), (6, 36.01, 26.0)], "location_id bigint, lat double, lon double")
    nodes, edges = knowledge.graph(p, b, cast, loc)
    assert {r["relation"] for r in edges.collect()} == {"genre", "acted", "shot", "near"} and nodes.count() == 5


def test_walks_follow_edges_and_embed(spark):
    links = [(a, b) for g in ("x", "y") for a in [f"{g}{i}" for i in range(4)] for b in [f"{g}{i}" for i in range(4)] if a < b]
    edges = spark.createDataFrame(links, "a string, b string")
    walked = knowledge.walks(edges, per_node=3, length=7).checkpoint()
    paths = {}
    for r in walked.collect():
        paths.setdefault(r["walk"], {})[r["pos"]] = r["node"]
    assert len(paths) == 24 and all(sorted(p) == list(range(7)) for p in paths.values())
    both = set(links) | {(b, a) for a, b in links}
    assert all((p[k], p[k + 1]) in both for p in paths.values() for k in range(6))
    matrix = knowledge.ppmi(walked).checkpoint()
    seen = {(a, b): 0 for p in paths.values() for a in p.values() for b in p.values()}
    for p in paths.values():
        for i in p:
            for j in p:
                if i != j and abs(i - j) <= 5:
                    seen[p[i], p[j]] += 1
    total = sum(seen.values())
    row = lambda x: sum(n for (a, _), n in seen.items() if a == x)
    want = {k: math.log(n * total / (row(k[0]) * row(k[1]))) for k, n in seen.items() if n}
    assert {(r["a"], r["b"]): r["v"] for r in matrix.collect()} == pytest.approx({k: v for k, v in want.items() if v > 1e-9})
    vec = {r["node"]: r["vec"] for r in knowledge.embed(matrix, 4).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(vec[a], vec[b]))
    assert len(vec) == 8 and abs(dot("x0", "y0")) < 1e-6 < dot("x0", "x0")


def test_paired_bootstrap(spark):
    apart = metrics.paired_bootstrap(spark.createDataFrame([(1.0, 0.0)] * 30 + [(0.0, 0.0)] * 10, "a double, b double"), reps=200).first()
    assert apart["observed"] == 0.75 and apart["p"] < 0.05
    same = metrics.paired_bootstrap(spark.createDataFrame([(1.0, 1.0)] * 5, "a double, b double"), reps=50).first()
    assert same["observed"] == 0.0 and same["p"] == 1.0


def test_entity_metrics(spark):
    def tags(*sentences):
        return spark.createDataFrame([(s, k, t) for s, ts in enumerate(sentences) for k, t in enumerate(ts.split())], "sent int, pos int, tag string")

    got = {r["kind"]: (r["precision"], r["recall"], r["support"]) for r in tagging.entity_metrics(tags("B-P I-P O B-T", "I-P O B-P"), tags("B-P I-P O O", "B-P B-P O")).collect()}
    assert got["P"] == (round(2 / 3, 6), round(2 / 3, 6), 3) and got["T"] == (0.0, 0.0, 1) and got["micro"] == (round(2 / 3, 6), 0.5, 4)


@pytest.mark.parametrize("kind", ["logistic", "svm"])
def test_classifier(spark, kind):
    rows = [(i, f"{w} {w} film {i % 3}", y) for i, (w, y) in enumerate([("korku", "a"), ("komedi", "b"), ("tarih", "c")] * 6)]
    docs = spark.createDataFrame([*rows, (99, None, "a")], "doc_id bigint, text string, label string")
    model = classify.fit(docs.where("doc_id < 99"), kind)
    got = {r["doc_id"]: (r["label"], r["predicted"]) for r in classify.predict(model, docs).collect()}
    assert len(got) == 19 and all(a == b for i, (a, b) in got.items() if i < 99)


@pytest.mark.parametrize("lat,lon", [(0, 0), (60, 10), (-70, 179.8), (70, -179.9), (85, 179.9), (89.9, 20), (-89.95, 0), (14.999, -180)])
def test_near_pairs_at_any_latitude(spark, lat, lon):
    rng = random.Random(lat * 7 + lon)
    spread = 0.4 / max(0.002, math.cos(math.radians(lat)))
    rows = [(i, max(-90.0, min(90.0, lat + rng.uniform(-0.4, 0.4))), (lon + rng.uniform(-spread, spread) + 540) % 360 - 180) for i in range(160)] + [(900, None, 1.0), (901, 90.0, 5.0), (902, -90.0, 5.0)]
    p = spark.createDataFrame(rows, "location_id bigint, lat double, lon double")
    whole = [r for r in rows if r[1] is not None]
    want = {(a[0], b[0]) for a in whole for b in whole if a[0] < b[0] and places._km(a[1:], b[1:]) <= 15}
    assert want and sorted((r["a"], r["b"]) for r in places.near_pairs(p).collect()) == sorted(want)


def test_near_pairs_over_any_distance(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    p = spark.createDataFrame(rows, "location_id bigint, lat double, lon double")
    for km in (3_000.0, 12_000.0, 30_000.0):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and places._km(a[1:], b[1:]) <= km}
        assert sorted((r["a"], r["b"]) for r in places.near_pairs(p, km).collect()) == sorted(want)


def test_edges_of_seeds_are_edges(spark):
    rng = random.Random(1)
    b = spark.createDataFrame([(p, i) for p in range(40) for i in rng.sample(range(25), rng.randint(1, 6))], "production_id bigint, item_id bigint")
    seeds = spark.createDataFrame([(1,), (4,)], "seed bigint")
    want = {(r["src"], r["dst"]): (round(r["w"], 9), round(r["sim"], 9)) for r in cooccurrence.edges(b).where("src in (1, 4)").collect()}
    got = cooccurrence.edges_of(seeds, b).collect()
    assert {(r["src"], r["dst"]): (round(r["w"], 9), round(r["sim"], 9)) for r in got} == want and len(got) == len(want)
    all_ = cooccurrence.edges(b)
    assert cooccurrence.n_edges(all_).first()["n"] * 2 == all_.count()


@pytest.mark.parametrize("lat,lon,spread", [(38, 30, 1.0), (89.5, 0, 0.5), (0, 180, 3.0), (-60, -179.9, 0.2)])
def test_knn_graph_is_all_pairs(spark, lat, lon, spread):
    rng = random.Random(int(lat))
    rows = [(i, "p" if i % 3 else "q", max(-90.0, min(90.0, lat + rng.gauss(0, spread))), (lon + rng.gauss(0, spread) * (1 + 5 * (i % 7 == 0)) + 540) % 360 - 180) for i in range(90)]
    rows += [(200, "lone", 1.0, 1.0), (201, "same", 1.0, 1.0), (202, "same", 1.0, 1.0), (203, None, 1.0, 1.0), (204, "p", None, 1.0)]
    p = spark.createDataFrame(rows, "location_id bigint, province string, lat double, lon double")
    want = set()
    for a in rows:
        own = [b for b in rows if b[1] == a[1] and b[0] != a[0] and None not in a and None not in b]
        for b in sorted(own, key=lambda b: (round(places._km(a[2:], b[2:]), 6), b[0]))[:4]:
            want |= {(a[0], b[0]), (b[0], a[0])}
    assert sorted((r["src"], r["dst"]) for r in places.knn_graph(p, 4).collect()) == sorted(want)
