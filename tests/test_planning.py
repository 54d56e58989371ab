"""Content features, prompts, search, the knowledge graph's recommendations and walks, preparation and classifiers on small frames."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scoutline.operators import annotation, classify, content, knowledge, metrics, preparation, search


def place_rows(spark, n=9):
    acts = ["tarih gezisi", "Müze", None, "deniz"]
    return spark.createDataFrame([(i, f"Yer {i}", "Nevşehir" if i % 2 else "İzmir", "Merkez", acts[i % 4], 38.0 + i / 100, 34.0 + i / 100) for i in range(n)], "location_id bigint, name string, province string, district string, activities string, lat double, lon double")


def test_corpus_and_features(spark):
    rows = spark.createDataFrame([(1, "Film", "Dram", "X", 5, "Yer", None, "İzmir", "gece", None, "yüksek"), (2, None, "Dram", "X", 5, "Yer", "a", "b", "c", "d", "e")], "production_id bigint, title string, genre string, director string, location_id bigint, name string, district string, province string, scene string, activities string, potential string")
    got = content.build_corpus(rows).collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [("1_5", "Yapım: Film (Dram, yönetmen: X). Lokasyon: Yer, , İzmir. Sahne bilgisi: gece. Popüler aktiviteler: . Turizm potansiyeli: yüksek.")]
    links = spark.createDataFrame([(0, "Dram"), (1, "Dram"), (1, "Komedi")], "location_id bigint, genre string")
    p = place_rows(spark)
    featured, _, flags = content.build_features(p.union(p.where("location_id = 1")), links)
    assert featured.count() == 9 and {r["location_id"]: r["f"] for r in featured.select("location_id", flags["kültürel"].alias("f")).collect()}[1] == 1.0


def test_prompt_gives_a_route(spark):
    links = spark.createDataFrame([(0, "Dram")], "location_id bigint, genre string")
    rows = content.generate_from_prompt(place_rows(spark), links, "historical dramas, 2 days in Cappadocia, cultural").orderBy("pos").collect()
    assert 3 <= len(rows) <= 10 and [r["pos"] for r in rows] == list(range(1, len(rows) + 1)) and {r["day"] for r in rows} == {1, 2}
    assert rows[0]["narrative"].count("durağında") == len(rows)
    assert content.generate_from_prompt(place_rows(spark), links, "no region here").count() == 0


def test_search_masks_and_falls_back(spark):
    p = place_rows(spark).withColumn("vec", F.array(F.lit(1.0), F.col("location_id") / 10))
    q = spark.createDataFrame([(1, "Nevşehir müze", [1.0, 0.0], None), (2, "Ankara gezisi", [1.0, 0.5], "Dram"), (3, "", None, None)], "q bigint, text string, vec array<double>, genre string")
    got = search.text_search(p, q, k=9).collect()
    by = Counter(r["q"] for r in got)
    assert by[1] == 4 and all(r["province"] == "Nevşehir" for r in got if r["q"] == 1) and by[2] == by[3] == 9
    given = q.withColumn("provinces", F.array(F.lit("İzmir")))
    assert {r["province"] for r in search.text_search(p, given, k=3).collect()} == {"İzmir"}
    assert search.text_search(p, q.limit(0)).count() == 0
    only = search.text_search(p, q.where("q = 2"), k=2, entities=lambda text: F.lit("müze")).orderBy("rank").first()
    assert only["location_id"] in (1, 5)


def test_search_over_several_blocks(spark, monkeypatch):
    p = place_rows(spark, 40).withColumn("vec", F.array(F.lit(1.0), F.sin("location_id"))).repartition(3)
    q = spark.createDataFrame([(i, f"Yer {i} tarih", [1.0, i / 3], ["Dram", "Komedi", None][i % 3]) for i in range(11)], "q bigint, text string, vec array<double>, genre string")
    whole = sorted(map(tuple, search.text_search(p, q, pool=6).collect()))
    monkeypatch.setattr(search, "QUERIES", 4)
    assert sorted(map(tuple, search.text_search(p.coalesce(1), q, pool=6).collect())) == whole


def test_weighted_mean_and_region(spark):
    vec = spark.createDataFrame([("genre:a", [1.0, 0.0]), ("genre:b", [0.0, 1.0]), ("location:1", [1.0, 0.1]), ("location:2", [0.1, 1.0]), ("location:3", [3.0, 1.0])], "node string, vec array<double>")
    assert knowledge.weighted_mean(vec, {"genre:a": 3.0, "genre:b": 1.0, "genre:x": 9.0}).first()["vec"] == [0.75, 0.25]
    at = spark.createDataFrame([(1, "p"), (2, "p"), (3, "r")], "location_id bigint, province string")
    assert [r["location_id"] for r in knowledge.recommend_locations(vec, {"a": 3.0, "b": 1.0}, at).collect()] == [3, 1, 2]
    assert [r["location_id"] for r in knowledge.recommend_locations(vec, {"a": 3.0, "b": 1.0}, at, "p").collect()] == [1, 2]
    assert knowledge.recommend_locations(vec, {"x": 1.0}, at).count() == 0


def test_biased_walks(spark):
    # 1 - 2, 1 - 3, 2 - 3, 2 - 4: from 1 to 2 the next node is 1 (1/p), 3 (linked to 1) or 4 (1/q)
    edges = spark.createDataFrame([("1", "2"), ("1", "3"), ("2", "3"), ("2", "4")], "a string, b string")
    rows = knowledge.walks(edges, per_node=900, length=3, p=0.25, q=2.0).collect()
    paths: dict = {}
    for r in rows:
        paths.setdefault(r["walk"], {})[r["pos"]] = r["node"]
    nxt = Counter(p[2] for p in paths.values() if (p[0], p[1]) == ("1", "2"))
    total = sum(nxt.values())
    for node, weight in (("1", 4.0), ("3", 1.0), ("4", 0.5)):
        assert abs(nxt[node] / total - weight / 5.5) < 0.06


def test_bootstrap_does_not_depend_on_partitions(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, float(rng.random() < 0.3)) for i in range(500)], "id bigint, hit double")
    a, b = (tuple(metrics.bootstrap_ci(x, key="id").first()) for x in (df.repartition(1), df.repartition(7)))
    assert a == pytest.approx(b, abs=1e-12)
    half = 1.96 * math.sqrt(a[0] * (1 - a[0]) / 500)
    assert abs((a[2] - a[1]) / 2 - half) < 0.3 * half


def test_mcnemar_at_any_size():
    for b01, b10 in ((0, 0), (3, 9), (40, 60), (700, 800)):
        n, k = b01 + b10, min(b01, b10)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert metrics.mcnemar_p(b01, b10) == pytest.approx(want, abs=1e-9)
    exact = metrics.mcnemar_p(99_700, 100_300)
    metrics_limit, metrics.EXACT_PAIRS = metrics.EXACT_PAIRS, 10
    assert metrics.mcnemar_p(99_700, 100_300) == pytest.approx(exact, abs=1e-4)
    metrics.EXACT_PAIRS = metrics_limit


def test_preparation(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, None)], "g string, o int, label string")
    assert {r["g"]: r["label"] for r in preparation.first_label(rows, "g", "label", "o").collect()} == {"a": "x", "b": None}
    assert {r["g"]: r["label"] for r in preparation.last_value(rows, "g", "label", "o").collect()}["a"] == "y"
    split = preparation.grouped_split(spark.createDataFrame([(f"{label}{i}", label) for label, n in (("p", 1), ("q", 2), ("r", 30)) for i in range(n)], "g string, label string"), "g", "label")
    n = Counter((r["label"], r["split"]) for r in split.collect())
    assert n == Counter({("p", "train"): 1, ("q", "test"): 1, ("q", "train"): 1, ("r", "test"): 4, ("r", "val"): 3, ("r", "train"): 23})
    assert preparation.disjoint(split, "g")
    su = spark.createDataFrame([("Film (2001)", "Uzun bir özet. " * 12), ("film [aug2]", "Uzun bir özet. " * 12), ("Başka", "kısa"), ("Diğer", "Başka uzun bir özet cümlesi burada. " * 6)], "title string, summary string")
    pr = spark.createDataFrame([("FILM", "Dram", 2), ("film", "Komedi", 1), ("diğer", "Belgesel", 1)], "title string, genre string, order int")
    out = preparation.prepare_genre(su, pr).collect()
    assert {(r["parent"], r["label"], r["label_id"]) for r in out if not r["is_augmented"]} == {("film", "Komedi", 0)}
    ner = preparation.prepare_ner(spark.createDataFrame([(1, " kısa "), (2, "Eski sokakta uzun gece")], "id int, text string"), spark.createDataFrame([(1, "Bu cümle kırk karakterden daha uzun olmalı mutlaka. Kısa."), (2, None)], "id int, text string")).collect()
    assert sorted(r["source"] for r in ner) == ["scene", "summary"] and all(len(r["tokens"]) == len(r["tags"]) for r in ner)


def test_annotation_set(spark):
    queries = spark.createDataFrame([(i, f"p{i % 3}") for i in range(12)], "q int, province string")
    ranked = spark.createDataFrame([(q, c, (q + c) % 9 + 1, c == 8) for q in range(12) for c in range(9)], "q int, cand int, rank int, is_gold boolean")
    rows = annotation.build(queries, ranked, n=5, k=3).collect()
    per = Counter(r["q"] for r in rows)
    assert len(per) == 5 and Counter(q % 3 for q in per) in (Counter({0: 2, 1: 2, 2: 1}),) and all(sum(r["is_gold"] for r in rows if r["q"] == q) == 1 for q in per)
    assert all(sorted(r["place"] for r in rows if r["q"] == q) == list(range(1, n + 1)) for q, n in per.items())


def test_judge_waits_and_gives_up(spark):
    def ask(query, passage):
        import json

        if passage == "down":
            raise OSError("no answer")
        return json.dumps({"score": len(passage), "reason": "r" * 300})

    rows = spark.createDataFrame([(1, 1, "q", "ab"), (1, 2, "q", "abcdef"), (1, 3, "q", "down")], "q bigint, cand bigint, query string, passage string")
    got = {r["cand"]: (r["score"], r["reason"]) for r in annotation.judge(rows, ask, tries=3, wait=0.01).collect()}
    assert got == {1: (2, "r" * 200), 2: (2, "r" * 200), 3: (0, "judge failed")}


@pytest.mark.parametrize("kind", ["logistic", "logistic_unweighted", "forest"])
def test_classifier_probabilities_and_storage(spark, tmp_path, kind):
    rows = [(i, f"{w} {w} {'film' if i % 2 else 'dizi'} bir", y) for i, (w, y) in enumerate([("korku", "a"), ("komedi", "b"), ("tarih", "c")] * 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    model = classify.fit(docs, kind)
    got = {r["doc_id"]: [(x["label"], x["score"]) for x in r["ranked"]] for r in model.ranked(docs).collect()}
    assert all(got[i][0][0] == y and sum(s for _, s in got[i]) == pytest.approx(1.0, abs=1e-3) and len(got[i]) == 3 for i, _, y in rows)
    model.save(f"file://{tmp_path}/model")
    again = {r["doc_id"]: [(x["label"], x["score"]) for x in r["ranked"]] for r in classify.Classifier.load(f"file://{tmp_path}/model").ranked(docs).collect()}
    assert again == got
    top = metrics.top_k_accuracy(model.ranked(docs).join(docs, "doc_id").select("label", F.transform("ranked", lambda x: x["label"]).alias("ranked"))).first()
    assert (top["top1"], top["top3"], top["macro_f1"]) == (100.0, 100.0, 100.0)


def test_tfidf_weights(spark):
    docs = spark.createDataFrame([(1, "elma elma armut"), (2, "elma kiraz"), (3, "bir x")], "id bigint, text string")
    from scoutline.functions import text as tx

    rows, idf = search.tfidf(docs, "id", tx.terms(F.col("text")), sublinear=True)
    got = {(r["id"], r["term"]): r["w"] for r in rows.collect()}
    i = {"elma": math.log(4 / 3) + 1, "armut": math.log(2) + 1}
    a, b = (1 + math.log(2)) * i["elma"], i["armut"]
    assert got[1, "elma"] == pytest.approx(a / math.hypot(a, b)) and got[3, "bir"] == 1.0 and (3, "x") not in got


def test_small_steps(spark):
    df = spark.createDataFrame([(1, "2", "x"), (2, "y", "x"), (3, None, "z")], "a int, b string, g string")
    assert [(r["a"], r["b"]) for r in preparation.numeric(df, "b").collect()] == [(1, 2.0)]
    assert preparation.project(df, {"a": "id", "none": "empty"}).collect()[0].asDict() == {"id": 1, "empty": None}
    split = spark.createDataFrame([("x", "train"), ("z", "test")], "g string, split string")
    assert sorted(r["a"] for r in preparation.part(df, split, "g", "train").collect()) == [1, 2]
    assert preparation.same_rows(df, df.union(df)) and not preparation.same_rows(df, df.limit(1))
    assert {r["value"]: r["n"] for r in metrics.bincount(df, "a", 3).collect()} == {0: 0, 1: 1, 2: 1, 3: 1}
    assert metrics.timed({"one": lambda: df}, 2)["one"] > 0


def test_legs_and_search_effort(spark):
    from scoutline.operators import places

    rows = [(k, "p", 38.0 + k / 100, 30.0 + (k % 3) / 100) for k in range(12)] + [(50, "q", 1.0, 1.0), (51, "q", 5.0, 5.0)]
    p = spark.createDataFrame(rows, "location_id bigint, province string, lat double, lon double")
    edges = places.region_graph(p.where("province = 'p'"), 2)
    pairs = spark.createDataFrame([("p", 0, 11), ("p", 3, 3), ("q", 50, 51)], "province string, source bigint, target bigint")
    got = {(r["source"], r["target"]): r for r in places.search_effort(edges, p, pairs).collect()}
    assert got[50, 51]["dist"] is None and got[3, 3]["dist"] == 0 and got[0, 11]["astar"] <= got[0, 11]["dijkstra"]
    stops = p.where("province = 'p'").select(F.col("province").alias("route"), F.col("location_id").alias("pos"), "lat", "lon")
    legs = [r["leg_km"] for r in places.legs(stops).orderBy("pos").collect()]
    assert legs[0] == 0 and legs[1:] == pytest.approx([places._km(a[2:], b[2:]) for a, b in zip(rows, rows[1:12])])
