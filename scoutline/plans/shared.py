"""What the query modules share: the registry, phrases that stand for Turkish texts, and fragments of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoutline.functions import lexicon as lex
from scoutline.sources import views as v

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Phrases that give names some Turkish text to work on, dealt by id.
PHRASES = ("Eski sokakta gece", "İstanbul limanında kovalamaca", "garaj kapısı", "Köyler ve tarla", "deniz kıyısında sabah", "hastane acil 1999 yılında", "Ara sokak ve çarşı", "tapınak", "Fabrikada takip", "düğün")


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame, and the SQL over the views that its result is held against."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            head = "with recursive " if sql.lstrip().startswith("with recursive ") else "with "
            ORACLES[name] = sql.replace(head, f"{head}{v.SQL},\n", 1) if sql.lstrip().startswith(head) else f"with {v.SQL}\n{sql}"
        return f

    return keep


def phrase(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PHRASES)), (key % len(PHRASES) + 1).cast("int"))


def ph(key: str) -> str:
    return "[" + ", ".join(f"'{p}'" for p in PHRASES) + f"][{key} % {len(PHRASES)} + 1]"


LOWER = "lower(translate({0}, 'İIĞÜŞÖÇ', 'iığüşöç'))"


def km(*args: str) -> str:
    """Great-circle distance in SQL."""
    return "2 * 6371.0::double * asin(sqrt(least(1.0::double, greatest(0.0::double, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))))".format(*args)


def match_sql(text: str, keywords, suffixes=lex.SUFFIXES) -> str:
    """Whether a text has one of the keywords, single words with a suffix or none, several as a phrase."""
    low = LOWER.format(text)
    single, several = [k for k in keywords if " " not in k], [k for k in keywords if " " in k]
    out = [f"regexp_matches({low}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(single)})({'|'.join(suffixes)})?([^\\p{{L}}\\p{{N}}_]|$)')"] if single else []
    return "(" + " or ".join(out + [f"contains({low}, '{k}')" for k in several]) + ")"


def category_sql(text: str) -> str:
    return "case " + " ".join(f"when {match_sql(text, words)} then '{name}'" for name, words in lex.CATEGORIES.items()) + " end"


def categories_sql(text: str, table=lex.CATEGORIES, suffixes=lex.SUFFIXES) -> str:
    """The list of all categories of a text."""
    return "list_filter([" + ", ".join(f"case when {match_sql(text, words, suffixes)} then '{name}' end" for name, words in table.items()) + "], lambda x: x is not null)"


def label_sql(category: str) -> str:
    return f"coalesce(case {category} " + " ".join(f"when '{k}' then '{x}'" for k, x in lex.CATEGORY_LABELS.items()) + f" end, '{lex.DEFAULT_LABEL}')"


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def draw_sql(*columns: str, seed: int = 42) -> str:
    return "md5(concat_ws('|', " + ", ".join(columns) + f", '{seed}'))"
