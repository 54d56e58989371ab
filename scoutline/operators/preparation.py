"""Star-schema join, splits, augmentation and retrieval pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scoutline.functions.text import map_genre, normalize_title, sentences
from scoutline.operators.tagging import bio_tags


def star_join(bridge: DataFrame, production: DataFrame, location: DataFrame) -> DataFrame:
    return bridge.join(production, "production_id", "left").join(location, "location_id")


def parse_coord(c: Column) -> tuple[Column, Column]:
    parts = F.split(c, ",")
    return F.trim(parts[0]).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double")


def overwrite(df: DataFrame, where: Column, column: str, value) -> DataFrame:
    return df.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns old -> new, in order; what df doesn't have is null."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(old) if old.lower() in have else F.lit(None).cast("string")).alias(new) for old, new in columns.items()])


def numeric(df: DataFrame, *columns: str) -> DataFrame:
    """df with the columns as numbers, without the rows in which one is none."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns}).dropna(subset=list(columns))


def part(rows: DataFrame, split: DataFrame, group: str, name: str) -> DataFrame:
    """The rows whose group is in the named split."""
    return rows.join(split.where(F.col("split") == name).select(group), group, "left_semi")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same distinct rows."""
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def join_titles(left: DataFrame, right: DataFrame, title: str, order: list) -> DataFrame:
    """Left join on the normalised title; of right rows with one title the first counts; a missing title is the empty one."""
    key = normalize_title(F.col(title)).alias("__t")
    r = keep_first(right.select("*", key), ["__t"], order).drop(title)
    return left.select("*", key).join(r, "__t", "left").drop("__t")


def dense_id(df: DataFrame, label: str, name: str = "label_id") -> DataFrame:
    """0 to n-1 in the order of labels; the labels, not the rows, are ranked."""
    ids = df.select(label).distinct().withColumn(name, (F.row_number().over(W.orderBy(label)) - 1).cast("long"))
    return df.join(ids, label)


def draw(*columns, seed: int) -> Column:
    """What random orders sort by: a digest of the columns and the seed, the same on every engine."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns], F.lit(str(seed))))


def first_label(rows: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """(group, label): the first label of each group in the order given that is not null; null if all are."""
    return rows.groupBy(group).agg(F.min_by(label, F.when(F.col(label).isNotNull(), F.col(order))).alias(label))


def last_value(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): a lookup table in which the last of repeated keys counts."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows, with null in columns that a frame doesn't have."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def grouped_split(groups: DataFrame, group: str, label: str, test: float = 0.15, val: float = 0.10, seed: int = 42) -> DataFrame:
    """(group, label, split): groups of each label in random order; shares are rounded to even, at least 1 from 3 groups on; of 2 groups one is test."""
    w = W.partitionBy(label)
    n = F.count("*").over(w)
    most = lambda share: F.greatest(F.bround(n * share), F.lit(1.0))
    rn = F.row_number().over(w.orderBy(draw(group, seed=seed), group))
    df = groups.select(group, label).distinct().withColumn("a", F.when(n >= 3, most(test)).when(n == 2, 1.0).otherwise(0.0)).withColumn("b", F.when(n >= 3, most(val)).otherwise(0.0)).withColumn("rn", rn)
    return df.select(group, label, F.when(F.col("rn") <= F.col("a"), "test").when(F.col("rn") <= F.col("a") + F.col("b"), "val").otherwise("train").alias("split"))


def disjoint(split: DataFrame, group: str) -> bool:
    return split.groupBy(group).agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()


def augment(docs: DataFrame, least: int, label: str = "label", text: str = "text", seed: int = 42) -> DataFrame:
    """(parent, part, label, text): halves of texts with four or more long sentences, for labels under least rows, no more than they lack."""
    n = docs.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") < least).withColumn("missing", least - F.col("n"))
    s = docs.select(F.col("doc_id").alias("parent"), label, sentences(F.col(text), 31).alias("s")).where("size(s) >= 4").join(n, label)
    mid = F.floor(F.size("s") / 2).cast("int")
    halves = F.array(F.struct(F.lit(1).alias("part"), F.array_join(F.slice("s", F.lit(1), mid), " ").alias("text")), F.struct(F.lit(2).alias("part"), F.array_join(F.slice("s", mid + 1, F.size("s") - mid), " ").alias("text")))
    rows = s.select("parent", label, "missing", F.explode(halves).alias("h")).select("parent", label, "missing", "h.*")
    rn = F.row_number().over(W.partitionBy(label).orderBy(draw("parent", seed=seed), "parent", "part"))
    return rows.withColumn("rn", rn).where("rn <= missing").select("parent", "part", label, "text")


def ranked_split(df: DataFrame, key: str, test: Column, val: Column, seed: int = 42) -> DataFrame:
    """Adds split by random order over all rows: sizes exactly test and val. Places come from counts of 4096 ranges of the digest, not from one sort."""
    h = df.withColumn("__h", draw(key, seed=seed)).withColumn("__b", F.substring("__h", 1, 3))
    before = h.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)))
    total = df.agg(F.count("*").alias("__all"))
    placed = h.join(before, "__b").crossJoin(F.broadcast(total))  # one row
    place = F.coalesce("__before", F.lit(0)) + F.row_number().over(W.partitionBy("__b").orderBy("__h", key))
    return placed.withColumn("__p", place).withColumn("split", F.when(F.col("__p") <= test, "test").when(F.col("__p") <= test + val, "val").otherwise("train")).select(*df.columns, "split")


def retrieval_pairs(rows: DataFrame) -> DataFrame:
    """rows (query, passage, location_id) with split: test max(100, 10 %), val max(50, 10 %)."""
    tenth = F.floor(F.col("__all") * 0.1)
    return ranked_split(rows.withColumn("__k", F.concat_ws("|", *rows.columns)), "__k", F.greatest(F.lit(100), tenth), F.greatest(F.lit(50), tenth)).drop("__k")


def prepare_genre(summaries: DataFrame, productions: DataFrame, least: int = 50, shortest: int = 100) -> DataFrame:
    """(parent, part, text, label, label_id, split, is_augmented) from summaries (title, summary) and productions (title, genre, order).

    Titles are joined normalised, the first production of a title counts; genres are mapped and what has none goes, as do summaries
    under shortest characters; of equal summaries the one with the least title stays. Splits are by title; labels with fewer than
    least training rows get halves of their longer training texts.
    """
    p = productions.select("title", F.col("genre").alias("raw"), F.col("order").alias("__o"))
    rows = join_titles(summaries.select("title", "summary"), p, "title", ["__o"])
    rows = rows.select(normalize_title(F.col("title")).alias("parent"), F.col("summary").alias("text"), map_genre(F.col("raw")).alias("label"))
    rows = keep_first(rows.where(F.col("label").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) >= shortest)), ["text"], ["parent"])
    groups = rows.groupBy("parent").agg(F.min("label").alias("label"))
    split = grouped_split(groups, "parent", "label").select("parent", "split")
    rows = rows.join(split, "parent").withColumn("part", F.lit(0)).withColumn("is_augmented", F.lit(False)).checkpoint()
    more = augment(rows.where("split = 'train'").select(F.col("parent").alias("doc_id"), "label", "text"), least)
    more = more.select("parent", "part", "label", "text", F.lit("train").alias("split"), F.lit(True).alias("is_augmented"))
    return dense_id(rows.unionByName(more), "label").select("parent", "part", "text", "label", "label_id", "split", "is_augmented")


def prepare_ner(scenes: DataFrame, summaries: DataFrame, seed: int = 42) -> DataFrame:
    """(tokens, tags, source, text, split) of scenes (id, text) of 15 characters or more and sentences of 40 or more of summaries
    (id, text), tagged by the lexicon; 80/10/10 in random order over all of them."""
    a = scenes.select(F.lit("scene").alias("source"), "id", F.lit(0).alias("pos"), F.trim("text").alias("text")).where(F.length("text") >= 15)
    b = summaries.select(F.lit("summary").alias("source"), "id", F.posexplode(F.transform(F.split(F.trim("text"), r"(?<=[.!?])\s+|\r\n"), lambda x: F.trim(x))).alias("pos", "text")).where(F.length("text") >= 40)
    rows = a.unionByName(b).withColumn("tagged", bio_tags(F.col("text"))).where(F.size("tagged") > 0)
    share = lambda x: F.floor(F.col("__all") * x)
    key = rows.withColumn("__k", F.concat_ws("|", "source", "id", "pos"))
    # of all rows in order the first 80 % train, the next 10 % dev, the rest test
    out = ranked_split(key, "__k", share(0.80), share(0.10), seed)
    name = F.when(F.col("split") == "test", "train").when(F.col("split") == "val", "dev").otherwise("test")
    return out.select(F.transform("tagged", lambda x: x["token"]).alias("tokens"), F.transform("tagged", lambda x: x["tag"]).alias("tags"), "source", "text", name.alias("split"))


def positives(scenes: DataFrame, places: DataFrame) -> DataFrame:
    """(query, passage, location_id): scenes (location_id, text) of 15 characters or more with the profile of their place
    (location_id, profile, order); the last of repeated places counts, and blank profiles have none."""
    profiles = last_value(places, "location_id", "profile", "order")
    rows = scenes.select("location_id", F.trim("text").alias("query")).where(F.length("query") >= 15).join(profiles, "location_id")
    return rows.where("profile <> ''").select("query", F.col("profile").alias("passage"), "location_id")


def gold_index(pairs: DataFrame) -> DataFrame:
    """(query, location_id, gold): pairs with the number of their passage among all distinct passages in order. Passages, not pairs, are numbered."""
    passages = pairs.select("passage").distinct()
    bucket = passages.withColumn("__b", F.substring("passage", 1, 2))
    before = bucket.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)))
    numbered = bucket.join(before, "__b").select("passage", (F.coalesce("__before", F.lit(0)) + F.row_number().over(W.partitionBy("__b").orderBy("passage")) - 1).cast("long").alias("gold"))
    return pairs.join(numbered, "passage").select("query", "location_id", "gold")


def jaccard(a: Column, b: Column) -> Column:
    """The overlap of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))
