"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Counts over words (`[^\x20\x09-\x0D]+`) and \n-split lines; the table below turns their ratios into a
verdict. Repeated windows of three words are found by sorting 64-bit hashes of the windows; only a text
whose hashes repeat is then examined by the windows' own strings, so the count is exact.

Cases: a null or empty text has no words, every count is 0 and it fails the base rules; texts of any
length are taken whole; repeated rows each get a row; an empty table gives none; columns of docs with
the same names as the counts are replaced.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.llm.common import SPACE, WORD, let


class Rule(NamedTuple):
    """A ratio of two counts (the lower one at least 1) and the range in which a text is kept."""

    name: str
    over: str
    under: str
    least: float
    most: float


#: The verdict beyond the base rules. Counts: see counts().
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 25.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.30),
    Rule("marks_per_word", "n_marks", "n_words", 0.0, 0.60),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.50),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, 1.0),
)

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple("a and are as at be by for from in is it of on or that the this to was with der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als le la les de des du et en un une est pour que qui dans par sur au el los las y del se por con una para al".split())


def counts(text: Column) -> dict[str, Column]:
    """Every count of a text as a column; 'words', 'lines' and 'windows' are arrays."""
    text = F.coalesce(text, F.lit(""))
    return {"text": text, "words": F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != ""), "lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))}


def _repeated(words: Column) -> Column:
    """The number of words in windows of three found twice or more."""

    def window(w, i, make):
        return make(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def ends(w):
        return F.sequence(F.lit(0), F.size(w) - 3)

    def hashes_repeat(w):
        h = F.sort_array(F.transform(ends(w), lambda i: window(w, i, F.xxhash64)))
        return let(h, lambda s: F.size(F.array_distinct(s)) < F.size(s))

    def exact(w):
        rows = F.array_sort(F.transform(ends(w), lambda i: F.struct(window(w, i, lambda a, b, c: F.concat_ws(" ", a, b, c)).alias("g"), i.alias("i"))))
        same = lambda s, j, k: F.coalesce(F.get(s, j)["g"] == F.get(s, k)["g"], F.lit(False))
        at = lambda s: F.filter(F.transform(s, lambda x, j: F.when(same(s, j, j + 1) | ((j > 0) & same(s, j, j - 1)), x["i"])), lambda x: x.isNotNull())
        return let(rows, lambda s: F.size(F.array_distinct(F.flatten(F.transform(at(s), lambda i: F.array(i, i + 1, i + 2))))))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(F.when(hashes_repeat(words), exact(words)).otherwise(F.lit(0)))


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the counts, base_failed, each rule's ratio, and kept."""
    # Each step is a projection of its own so that the arrays are computed once; Catalyst keeps them in one stage.
    c = counts(F.col("text"))
    body = F.struct(c["text"].alias("t"), c["words"].alias("w"), c["lines"].alias("l"))

    def all_counts(x):
        n_words = F.size(x["w"]).cast("long")
        return F.struct(
            n_words.alias("n_words"),
            F.length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(x["t"], r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace(x["t"], r"[^!?~^=_@]+", "")).cast("long").alias("n_marks"),
            F.size(x["l"]).cast("long").alias("n_lines"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
            _repeated(x["w"]).cast("long").alias("n_repeat_words"),
            F.size(F.filter(x["w"], lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    names = ["n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words"]
    made = [*names, "base_failed", "kept", *(r.name for r in rules)]
    q = "__quality"
    out = docs.withColumn(q, let(body, all_counts)).select(*[c for c in docs.columns if c not in made], *[F.col(f"{q}.{n}").alias(n) for n in names])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.select("*", base.alias("base_failed"), *[(F.col(r.over) / F.greatest(F.col(r.under), F.lit(1))).alias(r.name) for r in rules])
    verdict = reduce(lambda a, b: a & b, [F.col(r.name).between(r.least, r.most) for r in rules], F.lit(True))
    return out.select("*", (~F.col("base_failed") & verdict).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns."""
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return measured(docs.select(F.col("text"), held.alias("__row"))).where("kept").select("__row.*")


CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

QUERIES = {"op2_quality_rules": lambda spark, sf_dir: measured(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(*CONTRACT, "n_stop_words", "n_marks")}

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLES = {
    "op2_quality_rules": rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
gg as (select r, i from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1),
rep as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from gg) group by r),
c as (select w.r, doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, length(regexp_replace(t, '[^!?~^=_@]+', '', 'g')) as n_marks,
      len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
      len(list_filter(ws, lambda x: lower(x) in ({_STOP}))) as n_stop_words from w left join rep using (r)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, greatest(n_words, 1) as k, greatest(n_lines, 1) as m from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and word_chars / k between 2.0 and 25.0 and n_symbols / k <= 0.30 and n_marks / k <= 0.60
       and n_dup_lines / m <= 0.50 and n_stop_words / k between 0.02 and 1.0 as kept, n_stop_words, n_marks
from v"""
}
