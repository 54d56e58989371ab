"""Lexicon tagging of places, times and events, label alignment and entity metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scoutline.functions import lexicon as lex
from scoutline.functions.text import once

MARKS = ".,;:!?)(\"'"


def _lower(c: Column) -> Column:
    return F.trim(F.lower(F.translate(c, "İI", "iı")))


def _bare(c: Column) -> Column:
    return F.regexp_replace(_lower(c), r"[.,;:!?)(\"']+$", "")


def token_class(token: Column) -> Column:
    """P, T, E or O for a token alone."""

    def of(low: Column) -> Column:
        inside = lambda terms, n: low.rlike("|".join(t for t in terms if len(t) > n))
        place = low.isin(*lex.PLACE_TERMS) | inside(lex.PLACE_TERMS, 4)
        event = low.isin(*lex.EVENT_TERMS) | inside(lex.EVENT_TERMS, 5)
        return F.when(place, "P").when(low.isin(*lex.TIME_TERMS) | token.rlike(r"^\p{Nd}{4}"), "T").when(event, "E").otherwise("O")

    return once(_bare(token), of)


def tokens(sentence: Column) -> Column:
    return F.filter(F.split(F.coalesce(sentence, F.lit("")), r"[\s]+"), lambda x: x != "")


def bio_tags(sentence: Column) -> Column:
    """array of struct(token, tag). A capitalised token without a class of its own begins the place that follows it."""

    def tagged(ts: Column) -> Column:
        xs = F.transform(ts, lambda t: F.struct(t.alias("token"), token_class(t).alias("c"), t.rlike(r"^\p{Lu}").alias("up")))

        def tag(x: Column, i: Column, all_: Column) -> Column:
            before, after = F.get(all_, i - 1), F.get(all_, i + 1)
            joins = F.coalesce((i > 0) & before["up"] & (before["c"] == "O"), F.lit(False))
            leads = F.coalesce(x["up"] & (after["c"] == "P"), F.lit(False))
            t = F.when(x["c"] == "P", F.when(joins, "I-MEKAN").otherwise("B-MEKAN")).when(x["c"] == "T", "B-ZAMAN").when(x["c"] == "E", "B-OLAY").when(leads, "B-MEKAN").otherwise("O")
            return F.struct(x["token"].alias("token"), t.alias("tag"))

        return F.element_at(F.transform(F.array(xs), lambda a: F.transform(a, lambda x, i: tag(x, i, a))), 1)

    return F.element_at(F.transform(F.array(tokens(sentence)), tagged), 1)


def align_labels(tags: Column, word_ids: Column, label_ids: dict[str, int]) -> Column:
    """Label ids of sub-words: -100 without a word, I- for a word's later pieces, 0 for an unknown label."""
    known = F.create_map(*[F.lit(x) for kv in label_ids.items() for x in kv])

    def one(w: Column, i: Column, ids: Column, all_: Column) -> Column:
        again = (i > 0) & F.get(ids, i - 1).eqNullSafe(w)
        label = once(F.get(all_, w), lambda tag: known[F.when(again & tag.startswith("B-"), F.concat(F.lit("I-"), F.substring(tag, 3, 100))).otherwise(tag)])
        return F.when(w.isNull(), -100).otherwise(F.coalesce(label, F.lit(0)))

    # tags and words are worked out once, not again for each word
    return once(tags, lambda all_: once(word_ids, lambda ids: F.transform(ids, lambda w, i: one(w, i, ids, all_))))


def entities(tagged: DataFrame) -> DataFrame:
    """(sent, kind, start, stop) from (sent, pos, tag): a B- begins an entity, I- of its kind goes on; an I- elsewhere begins one."""
    w = W.partitionBy("sent").orderBy("pos")
    t = tagged.withColumn("kind", F.substring("tag", 3, 100)).withColumn("b", F.substring("tag", 1, 1))
    goes_on = (F.col("b") == "I") & (F.lag("kind").over(w) == F.col("kind")) & (F.lag("b").over(w) != "O")
    t = t.withColumn("new", F.when((F.col("b") != "O") & ~F.coalesce(goes_on, F.lit(False)), 1).otherwise(0)).withColumn("n", F.sum("new").over(w))
    return t.where("b <> 'O'").groupBy("sent", "n", "kind").agg(F.min("pos").alias("start"), F.max("pos").alias("stop")).drop("n")


def entity_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(kind, precision, recall, f1, support), kinds and `micro`."""
    key = ["sent", "kind", "start", "stop"]
    both = entities(gold).withColumn("g", F.lit(1)).join(entities(predicted).withColumn("p", F.lit(1)), key, "full")
    per = both.groupBy("kind").agg(F.count_if(F.expr("g = 1 and p = 1")).alias("tp"), F.sum(F.coalesce("p", F.lit(0))).alias("np"), F.sum(F.coalesce("g", F.lit(0))).alias("ng"))
    per = per.unionByName(per.agg(F.lit("micro").alias("kind"), F.sum("tp").alias("tp"), F.sum("np").alias("np"), F.sum("ng").alias("ng")))
    p, r = F.coalesce(F.try_divide("tp", "np"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "ng"), F.lit(0.0))
    return per.select("kind", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"), F.col("ng").alias("support"))
