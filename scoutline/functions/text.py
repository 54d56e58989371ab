"""Text functions as columns: Turkish casing and suffixes, categories, genres, titles, tokens, intents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoutline.functions import lexicon as lex


def once(c: Column, f) -> Column:
    """f(c), with c worked out once however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(F.coalesce(c, F.lit("")), "İIĞÜŞÖÇ", "iığüşöç"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(turkish_lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _forms(keywords: list[str], suffixes: list[str]) -> Column:
    """All forms of one-word keywords, as a set of literals."""
    return F.array(*[F.lit(k + s) for k in keywords for s in ["", *suffixes]])


def word_match(c: Column, keyword: str, suffixes: list[str] = lex.SUFFIXES) -> Column:
    """A keyword of several words as a substring; a single word with or without a suffix as a word."""
    if " " in keyword:
        return F.contains(turkish_lower(c), F.lit(keyword))
    return F.arrays_overlap(words(c), _forms([keyword], suffixes))


def any_match(c: Column, keywords, suffixes: list[str] = lex.SUFFIXES) -> Column:
    """Words are first cut to those that begin like a keyword, so a row costs one pass over its words."""
    single, several = [k for k in keywords if " " not in k], [k for k in keywords if " " in k]
    found = turkish_lower(c).rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(single)})(?:{'|'.join(suffixes)})?(?![\p{{L}}\p{{N}}_])")
    return reduce(lambda a, k: a | F.contains(turkish_lower(c), F.lit(k)), several, found)


def location_category(c: Column) -> Column:
    return F.coalesce(*[F.when(any_match(c, k), F.lit(name)) for name, k in lex.CATEGORIES.items()])


def category_label(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in lex.CATEGORY_LABELS.items() for x in kv])[location_category(c)], F.lit(lex.DEFAULT_LABEL))


def active_categories(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(any_match(c, k), F.lit(name)) for name, k in lex.CATEGORIES.items()]))


def reduced_category(c: Column) -> Column:
    """The first category of the shorter list with a keyword in the text, with or without one of the shorter list of suffixes; "" if none."""
    return F.coalesce(*[F.when(any_match(c, k, lex.SHORT_SUFFIXES), F.lit(name)) for name, k in lex.REDUCED_CATEGORIES.items()], F.lit(""))


def reduced_categories(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(any_match(c, k, lex.SHORT_SUFFIXES), F.lit(name)) for name, k in lex.REDUCED_CATEGORIES.items()]))


def reduced_region(c: Column) -> Column:
    """The provinces of the first region of the shorter list that the text names; null if none."""
    return F.coalesce(*[F.when(word_match(c, name, lex.SHORT_SUFFIXES), F.array(*map(F.lit, provinces))) for name, provinces in lex.REDUCED_REGIONS.items()])


def first_named(c: Column, names: list[str]) -> Column:
    """The first of names, in order and in lower case, that the text holds as a word with or without a suffix, or as a phrase; "" if none."""
    lower = lambda n: n.translate(str.maketrans("İIĞÜŞÖÇ", "iığüşöç")).lower()
    known = sorted({lower(n) for n in names if n})
    return F.coalesce(*[F.when(word_match(c, n, lex.SHORT_SUFFIXES), F.lit(n)) for n in known], F.lit(""))


def names_place(query: Column, name: Column) -> Column:
    """Whether a query holds a place's name."""
    return F.contains(turkish_lower(query), turkish_lower(name))


def region_provinces(c: Column) -> Column:
    t = turkish_lower(c)
    rows = [F.when(reduce(lambda a, n: a | F.contains(t, F.lit(n)), names, F.lit(False)), F.array(*map(F.lit, provinces))) for names, provinces in lex.REGIONS]
    return F.coalesce(*rows, F.array().cast("array<string>"))


def detect_provinces(c: Column, provinces: list[str]) -> Column:
    """Provinces that the text names, else those of a region that it names."""
    w, t = words(c), turkish_lower(c)
    lower = lambda p: p.translate(str.maketrans("İIĞÜŞÖÇ", "iığüşöç")).lower()
    named = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(lower(p))) if " " in p else F.array_contains(w, lower(p)), F.lit(p)) for p in provinces]))
    return F.when(F.size(named) > 0, named).otherwise(region_provinces(c))


def profile(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.when(F.trim(p) != "", p) for p in parts])


def normalize_title(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    s = F.regexp_replace(s, r"\s*\(.*?\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s*\[aug\d+\]$", ""), r"\s+", " "))


def map_genre(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in lex.GENRES.items() for x in kv])
    g = F.trim(c)
    return F.when(c.isNotNull(), F.coalesce(known[g], F.when(F.contains(g, F.lit("/")), known[F.trim(F.split(g, "/")[0])]), *[F.when(F.lower(g).rlike(p), F.lit(v)) for p, v in lex.GENRE_CASCADE]))


def tokenize(c: Column) -> Column:
    """Lower case the Turkish way, everything but letters, digits and _ parts words, stop words go."""
    parts = F.split(F.regexp_replace(turkish_lower(c), r"[^\p{L}\p{N}_]+", " "), " ")
    return F.filter(parts, lambda x: (x != "") & ~x.isin(*lex.STOP_WORDS))


def clean_actor_list(c: Column) -> Column:
    none = F.array().cast("array<string>")
    parts = F.split(F.regexp_replace(c, r"\{\{[^|}]*liste\s*[,|]?", ""), ",")
    parts = F.transform(parts, lambda x: F.regexp_replace(x, r"^[ *]+|[ *]+$", ""))
    return F.when(c.isNull() | (F.lower(c) == "bilinmiyor"), none).otherwise(F.filter(parts, lambda x: (x != "") & (F.lower(x) != "bilinmiyor")))


def theme_flags(c: Column) -> dict[str, Column]:
    t = F.lower(F.coalesce(c, F.lit("")))
    return {name: t.rlike(pattern).cast("double") for name, pattern in lex.THEMES.items()}


def intent(c: Column) -> Column:
    """struct(region, themes, days) of a prompt."""
    p = F.lower(F.coalesce(c, F.lit("")))
    region = F.coalesce(*[F.when(F.contains(p, F.lit(k)), F.lit(v)) for k, v in lex.REGION_ALIASES.items()])
    themes = F.array_compact(F.array(F.when(p.rlike("historical|tarihi"), F.lit("tarihi")), F.when(p.rlike("cultural|kültür"), F.lit("kültürel"))))
    days = F.regexp_extract(p, r"([0-9]+)\s*day", 1)
    return F.struct(region.alias("region"), F.when(F.size(themes) > 0, themes).otherwise(F.array(F.lit("tarihi"))).alias("themes"), F.coalesce(F.nullif(days, F.lit("")).try_cast("int"), F.lit(1)).alias("days"))


def sentences(c: Column, least: int) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def join_subwords(tokens: Column) -> Column:
    """Pieces that begin with ## continue the word before."""
    return F.regexp_replace(F.array_join(tokens, " "), " ##", "")


def terms(c: Column, least: int = 2, most_words: int = 1) -> Column:
    """Runs of least or more letters, digits and _ of a lower-cased text, and their sequences of up to most_words, joined by blanks."""
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"[\p{{L}}\p{{N}}_]{{{least},}}"), F.lit(0))

    def grams(t: Column, n: int) -> Column:
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    if most_words == 1:
        return found
    return F.element_at(F.transform(F.array(found), lambda t: F.concat(*[grams(t, n) for n in range(1, most_words + 1)])), 1)
