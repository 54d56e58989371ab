"""Content scores of places: genre TF-IDF, themes, distance decay, and the statistical cut-off."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scoutline.functions.geo import haversine_km
from scoutline.functions.text import intent, theme_flags
from scoutline.operators.places import narrate, routes, split_days


def genre_tfidf(links: DataFrame, n_places: int | None = None) -> DataFrame:
    """(location_id, genre, v): share times ln(N/df)+1, of length 1, from (location_id, genre) rows; null genres go."""
    counts = links.where("genre is not null").groupBy("location_id", "genre").agg(F.count("*").alias("c"))
    tf = counts.withColumn("tf", F.col("c") / F.sum("c").over(W.partitionBy("location_id")))
    n = counts.agg(F.countDistinct("location_id").alias("n")) if n_places is None else None
    df = counts.groupBy("genre").agg(F.count("*").alias("df"))
    df = df.crossJoin(F.broadcast(n)) if n is not None else df.withColumn("n", F.lit(n_places))  # one row
    x = tf.join(df, "genre").withColumn("x", F.col("tf") * (F.log(F.col("n") / F.col("df")) + 1))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("location_id")))
    return x.select("location_id", "genre", (F.col("x") / F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0))).alias("v"))


def hybrid_route(places: DataFrame, tfidf: DataFrame, weights: dict[str, float] | None, themes: dict | None, province: str, decay_km: float = 20.0, least: int = 3, most: int = 10) -> DataFrame:
    """(location_id, score, threshold, rank): content times exp(-distance/decay) from a province's centre; what is at least
    mean + deviation of the positive scores, but between least and most places. themes: name -> flag column of places."""
    parts, p = [], places
    if weights:
        length = sum(w * w for w in weights.values()) ** 0.5
        w = reduce(lambda a, kv: F.when(F.col("genre") == kv[0], kv[1] / length).otherwise(a), weights.items(), F.lit(0.0))
        p = p.join(tfidf.groupBy("location_id").agg(F.sum(F.col("v") * w).alias("by_genre")), "location_id", "left")
        parts.append(F.coalesce("by_genre", F.lit(0.0)))
    if themes:
        parts.append(reduce(lambda a, b: a + b, themes.values()) / len(themes))
    content = reduce(lambda a, b: a + b, parts) / len(parts) if parts else F.lit(1.0)
    centre = places.where(F.col("province") == province).agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon")).where("clat is not null")  # a row at most
    scored = p.crossJoin(F.broadcast(centre)).withColumn("score", F.round(content * F.exp(-haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon")) / decay_km), 9))
    cut = scored.where("score > 0").agg((F.avg("score") + F.stddev_samp("score")).alias("threshold"))
    # only the most best can be chosen, so the top is taken first and ranked alone
    above = scored.crossJoin(F.broadcast(cut)).agg(F.count_if(F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))).alias("above"), F.max("threshold").alias("threshold"))
    top = scored.orderBy(F.desc("score"), "location_id").limit(most).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "location_id")))
    top = top.crossJoin(F.broadcast(above)).where(F.col("rank") <= F.least(F.greatest("above", F.lit(least)), F.lit(most)))
    return top.select("location_id", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), F.col("rank").cast("long").alias("rank"))


def build_corpus(rows: DataFrame) -> DataFrame:
    """(doc_id, production_id, title, location_id, name, text): a document for each row with a title of (production_id, title, genre,
    director, location_id, name, district, province, scene, activities, potential); missing fields are empty."""
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    text = F.concat(
        F.lit("Yapım: "), c("title"), F.lit(" ("), c("genre"), F.lit(", yönetmen: "), c("director"), F.lit("). Lokasyon: "), c("name"), F.lit(", "), c("district"), F.lit(", "), c("province"),
        F.lit(". Sahne bilgisi: "), c("scene"), F.lit(". Popüler aktiviteler: "), c("activities"), F.lit(". Turizm potansiyeli: "), c("potential"), F.lit("."),
    )
    key = F.concat_ws("_", F.col("production_id").cast("string"), F.col("location_id").cast("string"))
    return rows.where("title is not null").select(key.alias("doc_id"), "production_id", "title", "location_id", "name", text.alias("text"))


def build_features(places: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """(places with a 0/1 column for each theme that their activities name, genre_tfidf of links, theme names to columns); of repeated
    places the one with the least name stays."""
    one = places.groupBy("location_id").agg(F.min_by(F.struct(*[c for c in places.columns if c != "location_id"]), F.struct("name", "activities")).alias("p")).select("location_id", "p.*")
    flags = theme_flags(F.col("activities"))
    return one.select("*", *[flag.alias(f"theme_{k}") for k, flag in enumerate(flags.values())]), genre_tfidf(links), {name: F.col(f"theme_{k}") for k, name in enumerate(flags)}


def generate_from_prompt(places: DataFrame, links: DataFrame, prompt: str, decay_km: float = 20.0, least: int = 3, most: int = 10) -> DataFrame:
    """(pos, day, location_id, name, score, threshold, total_km, narrative): the route for a prompt. Its region, themes and days are
    extracted, places selected by hybrid_route(), put in order, dealt to days and described."""
    wish = places.sparkSession.range(1).select(intent(F.lit(prompt)).alias("i")).select("i.*").first()
    featured, tfidf, flags = build_features(places, links)
    chosen = hybrid_route(featured, tfidf, None, {name: flags[name] for name in wish["themes"]}, wish["region"] or "", decay_km, least, most).join(places.dropDuplicates(["location_id"]), "location_id")
    chosen = chosen.checkpoint()  # at most `most` rows
    stops = chosen.select(F.lit("r").alias("route"), F.col("rank").alias("seq"), "location_id", "lat", "lon")
    days = split_days(routes(stops), wish["days"]).join(chosen.select("location_id", "name", "activities", "score", "threshold"), "location_id").checkpoint()
    told = narrate(days.select("route", "pos", "name", "activities"))
    return days.join(told, "route").select("pos", "day", "location_id", "name", "score", "threshold", "total_km", F.col("text").alias("narrative"))
