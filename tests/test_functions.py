from pyspark.sql import functions as F

from scoutline.functions import text as tx
from scoutline.functions.geo import haversine_km
from scoutline.operators import places, preparation, retrieval, tagging


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_turkish_lower(spark):
    assert one(spark, tx.turkish_lower(F.lit("IĞDIR İzmir")), tx.turkish_lower(F.lit(None).cast("string"))) == ("ığdır izmir", "")


def test_word_match(spark):
    assert one(spark, tx.word_match(F.lit("Sokakta"), "sokak"), tx.word_match(F.lit("garaj"), "gar")) == (True, False)


def test_categories(spark):
    assert one(spark, tx.location_category(F.lit("İstanbul limanında")), tx.location_category(F.lit("garaj"))) == (None, None)
    assert one(spark, tx.active_categories(F.lit("eski kışla")))[0] == ["resmi_kurum", "askeri_guvenlik"]


def test_regions(spark):
    assert one(spark, tx.region_provinces(F.lit("Güneydoğu turu")))[0][0] == "Mardin"
    assert one(spark, tx.detect_provinces(F.lit("İzmir ve Ege"), ["İzmir", "Ankara"]))[0] == ["İzmir"]


def test_titles_and_genres(spark):
    assert one(spark, tx.normalize_title(F.lit("A  Film (1999) [aug1]")))[0] == "a film"
    assert one(spark, tx.map_genre(F.lit("Komedi / x")), tx.map_genre(F.lit(None).cast("string")))[:] == ("Komedi", None)
    assert one(spark, tx.clean_actor_list(F.lit("{{Düz liste, * Ali , bilinmiyor,Veli *")))[0] == ["Ali", "Veli"]


def test_intent(spark):
    i = one(spark, tx.intent(F.lit("2 day cultural trip to Kapadokya")))[0]
    assert (i["region"], i["themes"], i["days"]) == ("Nevşehir", ["kültürel"], 2)


def test_distance(spark):
    assert round(one(spark, haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))[0], 3) == 20015.087


def test_bio_tags(spark):
    got = one(spark, tagging.bio_tags(F.lit("Eski sokak gece")))[0]
    assert [x["tag"] for x in got] == ["B-MEKAN", "I-MEKAN", "B-ZAMAN"]


def test_bankers_rounding(spark):
    g = spark.range(30).select("id", F.lit("a").alias("label"))
    n = {r["split"]: r["count"] for r in preparation.grouped_split(g, "id", "label").groupBy("split").count().collect()}
    assert n == {"test": 4, "val": 3, "train": 23}
    assert preparation.disjoint(preparation.grouped_split(g, "id", "label"), "id")


def test_rerank_constant_cross(spark):
    rows = spark.createDataFrame([(1, 10, 1, 5.0), (1, 11, 2, 5.0), (1, 12, 3, 9.0)], "q bigint, cand bigint, rank bigint, cross double")
    out = {r["cand"]: r["new_rank"] for r in retrieval.rerank(rows, top=2).collect()}
    assert out == {10: 1, 11: 2, 12: 3}


def test_split_days(spark):
    rows = spark.createDataFrame([("a", i) for i in range(8)] + [("b", i) for i in range(2)], "route string, pos bigint")
    got = {(r["route"], r["day"]): r["count"] for r in places.split_days(rows, 3).groupBy("route", "day").count().collect()}
    assert got == {("a", 1): 3, ("a", 2): 3, ("a", 3): 2, ("b", 1): 2}
