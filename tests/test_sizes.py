"""What went wrong only on larger tables."""

import numpy as np
from pyspark.sql import functions as F

from scoutline.functions import text as tx
from scoutline.operators import knowledge, places, preparation, retrieval, search
from scoutline.operators.best import Best


def test_sentences_keep_their_digits(spark):
    """Sentences are trimmed of blanks, not of the number of their place."""
    text = "The first sentence of a summary, which is long enough.  2 more sentences follow and this one ends so: 1. 2024 was a year of long sentences, as they all are. 3"
    rows = preparation.prepare_ner(spark.createDataFrame([], "id bigint, text string"), spark.createDataFrame([(1, text)], "id bigint, text string"))
    assert {r["text"] for r in rows.collect()} == {"The first sentence of a summary, which is long enough.", "2 more sentences follow and this one ends so: 1.", "2024 was a year of long sentences, as they all are."}
    one = spark.createDataFrame([("Nothing here. 1 sentence that begins with its place", )], "t string").select(tx.sentences(F.col("t"), 5).alias("s")).first()["s"]
    assert one == ["Nothing here.", "1 sentence that begins with its place"]


def test_rounding_of_halves(spark):
    """path_effort rounds six digits to five as its SQL does: by the binary number."""
    x = [4.898095, 19.065675, 10.434095, 4.673855, 0.5, 0.0, 12.345678]
    rows = spark.createDataFrame(list(enumerate(x)), "k int, x double").select("k", places.rounded(F.col("x"), 5).alias("r")).orderBy("k").collect()
    assert [r["r"] for r in rows] == [4.89809, 19.06567, 10.43409, 4.67385, 0.5, 0.0, 12.34568]


def test_best_of_batches_are_the_best():
    """Scores in batches, with many ties, give the same best as a sort of all."""
    rng = np.random.default_rng(5)
    scores, ids = np.round(rng.normal(size=(7, 4000)), 1), rng.permutation(4000)
    scores[rng.random(scores.shape) < 0.2] = -np.inf
    scores[6, 3:] = -np.inf  # fewer than k
    best = Best(7, 20)
    for at in range(0, 4000, 333):
        best.take(scores[:, at : at + 333], ids[at : at + 333])
    for q in range(7):
        order = [i for i in np.lexsort((ids, -scores[q]))[:20] if np.isfinite(scores[q, i])]
        assert best.id[best.q == q].tolist() == ids[order].tolist() and best.s[best.q == q].tolist() == scores[q, order].tolist()


def test_products_of_vectors_are_small(spark, monkeypatch):
    """A task multiplies few vectors by many queries at once, and repeated ids are left out of their own answers."""
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=6).tolist(), int(i) % 4) for i in [*range(150), 7, 8]]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1)
    widest, product = spark.sparkContext.accumulator(0), 500
    monkeypatch.setattr(retrieval, "PRODUCT", product)
    whole = retrieval._scored

    def watched(vectors, queries, schema, begin, block):
        def begun(*known):
            take, rest = begin(*known)

            def seen(vec_ids, labels, sims):
                if sims.size > product:
                    widest.add(1)
                return take(vec_ids, labels, sims)

            return seen, rest

        return whole(vectors, queries, schema, begun, block)

    monkeypatch.setattr(retrieval, "_scored", watched)
    found = {(r["q"], r["label"]): r["sim"] for r in retrieval.label_scores(e, e).collect()}
    assert widest.value == 0
    m = np.array([np.float32(r[1]) for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    for (q, label), sim in found.items():
        assert abs(sim - max((m[ids == q] @ m[(labels == label) & (ids != q)].T).max(axis=1))) < 1e-5
    assert len(found) == 150 * 4


def test_ranks_without_pairs(spark, monkeypatch):
    """Ranks under the settings equal those counted over all pairs, with ties and over several blocks, and no pair is written."""
    rng = np.random.default_rng(2)
    vec = [rng.normal(size=4).tolist() for _ in range(5)]
    texts = ["Ankara sokak", "İzmir deniz kıyısı", "hastane", "Van sokakta hastane"]
    p = spark.createDataFrame([(i, texts[i % 4], vec[i % 5]) for i in range(60)], "cand bigint, text string, vec array<float>")
    q = spark.createDataFrame([(i, texts[i % 3] + (" Ege" if i % 4 == 0 else ""), vec[i % 3]) for i in range(70)], "q bigint, text string, vec array<float>")
    cities, configs = ["Ankara", "İzmir", "Van"], (("none", False, False), ("both", True, True))
    monkeypatch.setattr(search, "RANKED", 25)
    found = {(r["setting"], r["q"]): r["rank"] for r in search.metadata_ranks(p, q, cities, configs).collect()}
    sims = retrieval.similar(p.select(F.col("cand").alias("vec_id"), F.lit(0).alias("label"), F.col("vec").alias("embedding")), q.select(F.col("q").alias("vec_id"), F.col("vec").alias("embedding")))
    sims = sims.select("q", F.col("vec_id").alias("cand"), "sim")
    for name, geo, category in configs:
        scored = search.metadata_scores(sims, p, q, cities, geo, category)
        want = {(name, r["q"]): r["rank"] for r in search.gold_ranks(scored, q.select("q", F.col("q").alias("cand"))).collect()}
        assert want == {k: r for k, r in found.items() if k[0] == name} and len(want) == 60


def test_equal_texts_are_searched_once(spark):
    """Queries of one text have one search, and its ties, blocks and ranks are those of each of them."""
    p = spark.createDataFrame([(i, f"sokak deniz {'gece' if i % 3 else 'sabah liman'}") for i in range(40)], "cand bigint, text string")
    q = spark.createDataFrame([(i, ["gece sokak", "liman", None, "yok"][i % 4]) for i in range(12)], "q bigint, text string")
    texts, of = search._numbered_texts(q)
    assert texts.count() == 4 and of.count() == 12
    got: dict = {}
    for r in search.tfidf_topk(p, q).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["cand"], r["score"]))
    assert set(got) == {i for i in range(12) if i % 4 < 2}
    assert [c for c, _ in got[0]] == [1, 2, 4, 5, 7] and [c for c, _ in got[1]] == [0, 3, 6, 9, 12]
    assert got[0] == got[4] == got[8] and got[1] == got[5] == got[9]


def test_counts_of_the_graph_without_pairs_at_a_point(spark, monkeypatch):
    """Edges and nodes are counted as graph() has them, and places that share a point are not paired one by one."""
    at = spark.createDataFrame([(i, f"p{i}", 40.0 + (i % 3) * 0.05, 30.0) for i in range(60)] + [(99, "far", 10.0, 10.0)], "location_id bigint, name string, lat double, lon double")
    film = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "bilinmiyor"), (1, "a", "x")], "production_id bigint, genre string, director string")
    bridge = spark.createDataFrame([(1, 3), (1, 3), (4, 5), (5, 1000)], "production_id bigint, location_id bigint")
    cast = spark.createDataFrame([(1, 7), (2, 7), (6, None)], "production_id bigint, item_id bigint")
    nodes, edges = knowledge.graph(film, bridge, cast, at)
    want = {r["relation"]: r["n"] for r in edges.groupBy("relation").agg(F.count("*").alias("n")).collect()}, {r["type"]: r["n"] for r in nodes.groupBy("type").agg(F.count("*").alias("n")).collect()}
    sizes, pairs = [], knowledge.near_pairs
    monkeypatch.setattr(places, "near_pairs", lambda p, km: sizes.append(p.count()) or pairs(p, km))
    assert {r["relation"]: r["n"] for r in knowledge.edge_counts(film, bridge, cast, at).collect()} == want[0]
    assert sizes == [4]
    assert {r["type"]: r["n"] for r in knowledge.node_counts(film, bridge, cast, at).collect()} == want[1]


def test_routes_of_many_stops_are_quick(monkeypatch):
    """Stops that share points, and more points than are kept as a table."""
    import time

    rng = np.random.default_rng(1)
    points = [(float(a), float(b)) for a, b in rng.integers(0, 12, (300, 2)) / 60 + [36.0, 30.0]]
    order, km = places.order_stops(points)
    assert sorted(order) == list(range(300)) and abs(km - sum(places._km(points[a], points[b]) for a, b in zip(order, order[1:]))) < 1e-6
    monkeypatch.setattr(places, "TABLE", 10)
    assert places.order_stops(points) == (order, km)
    monkeypatch.undo()
    began = time.perf_counter()
    places.order_stops([points[i % 300] for i in range(3000)])
    assert time.perf_counter() - began < 30
