r"""Chat formatting by quotation linking, with DataFrame functions only.

A line's quote level is the number of `>` it begins with; consecutive lines of one level are a passage.
Passages are normalised (lower case, one blank for white space) and hashed, and joined, within the
conversation, to the first earlier message whose own words (all of them, a paragraph or a line) have that
hash; a passage that no message holds is tried by its lines, the first that is known. A message replies to the latest message
that its passages of the lowest linked level come from. Messages without a link keep their turn; those with
one stand in the thread of the message they reply to. (thread, turn) is the reply order of a conversation,
so ordering needs no task to hold a conversation: threads come from doubling along the links.

Returned texts are without quotes and without the line that announces one ("... wrote:").

Cases: null and empty texts stay as empty messages; messages of any length are taken whole; a quote of
later words or of no message is dropped from the text and links nothing; repeated rows each get a row and
link alike; where several messages hold a passage the first counts; a null conv_id or turn links nothing;
an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scoutline.llm.common import discard, materialise, scratch

#: Quote marks at the start of a line.
MARKS = r"^[ \t]*(?:>[ \t]?)+"
#: A line that announces a quote.
ANNOUNCES = r"(?i)(wrote|schrieb|a écrit|escribió)[ ]?:[ \t]*$"
#: How a message is written out.
TEMPLATE = "<|{role}|>\n{text}"


#: Stands for null in keys.
NONE = -(2**63)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def _digest(text: Column) -> Column:
    return F.sha2(normal(text), 256)


def _passages(quoted: DataFrame) -> DataFrame:
    """(conv_id, turn, th, run, level, body): the passages of messages with quotes; level 0 is own words."""
    key = ["conv_id", "turn", "th"]
    lines = quoted.select(*key, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    mark = F.regexp_extract("line", MARKS, 0)
    lines = lines.select(*key, "pos", F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.regexp_replace("line", MARKS, "").alias("body"))
    w = W.partitionBy(*key).orderBy("pos")
    lines = lines.withColumn("next", F.lead("level").over(w)).withColumn("new", F.coalesce(F.lag("level").over(w) != F.col("level"), F.lit(True)))
    lines = lines.where(~((F.col("level") == 0) & (F.coalesce("next", F.lit(0)) > 0) & F.col("body").rlike(ANNOUNCES)))
    lines = lines.withColumn("run", F.sum(F.col("new").cast("int")).over(w))
    parts = lines.groupBy(*key, "run", "level").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("parts"))
    return parts.select(*key, "run", "level", F.array_join(F.transform("parts", lambda x: x["body"]), "\n").alias("body"))


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, thread, max_level, n_passages, n_linked, text, formatted: a row for each row of messages."""
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE)).alias(c)
    rows = messages.select(whole("conv_id"), whole("turn"), F.col("role").cast("string"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    quoted = rows.where(F.col("text").rlike(rf"(?m){MARKS}")).select("conv_id", "turn", "th", "text").distinct()
    passages = materialise(_passages(quoted), "passages")
    key = ["conv_id", "turn", "th"]

    own = passages.where("level = 0").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("run", "body"))).alias("parts"))
    own = own.select(*key, _strip(F.array_join(F.transform("parts", lambda x: _strip(x["body"])), "\n")).alias("own"))
    shape = passages.groupBy(*key).agg(F.max("level").alias("max_level"), F.count_if(F.col("level") > 0).alias("n_passages"))

    # what messages of conversations with quotes say in their own words
    said = rows.join(passages.select("conv_id").distinct(), "conv_id", "left_semi").join(shape, key, "left").join(own, key, "left")
    words = F.when(F.col("max_level").isNull(), F.col("text")).otherwise(F.coalesce("own", F.lit("")))
    parts = F.array_distinct(F.concat(F.array(words), F.split(words, r"\n[ \t]*\n"), F.split(words, "\n")))
    said = said.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(F.filter(parts, lambda x: normal(x) != ""), _digest))).alias("hash"))
    first = said.where((F.col("conv_id") > NONE) & (F.col("turn") > NONE)).groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))

    # whole, else by the first of its lines that is known
    lines = F.transform(F.split("body", "\n"), lambda x, i: F.struct((i + 1).alias("by"), x.alias("said")))
    tries = F.filter(F.concat(F.array(F.struct(F.lit(0).alias("by"), F.col("body").alias("said"))), lines), lambda x: normal(x["said"]) != "")
    asked = passages.where((F.col("level") > 0) & (normal(F.col("body")) != "")).select(*key, "run", "level", F.explode(tries).alias("x")).select(*key, "run", "level", F.col("x.by").alias("by"), _digest(F.col("x.said")).alias("hash"))
    found = asked.join(first, ["conv_id", "hash"]).where("source < turn")
    found = found.groupBy(*key, "run", "level").agg(F.min_by("source", "by").alias("source"))
    links = found.groupBy(*key).agg(F.count("*").alias("n_linked"), (-F.min(F.struct("level", (-F.col("source")).alias("last"))).getField("last")).alias("reply_to"))
    links = materialise(links, "links")

    threads = _threads(links.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("to")))
    out = rows.join(shape, key, "left").join(own, key, "left").join(links, key, "left").join(threads, ["conv_id", "turn"], "left")
    text = F.when(F.col("max_level").isNull(), F.col("text")).otherwise(F.coalesce("own", F.lit("")))
    none = F.lit(NONE)
    return out.select(F.nullif("conv_id", none).alias("conv_id"), F.nullif("turn", none).alias("turn"), "role", "reply_to", F.when(F.col("reply_to").isNull(), F.nullif("turn", none)).otherwise(F.coalesce("root", "reply_to")).alias("thread"), F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"), F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), text.alias("text")).withColumn("formatted", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "text"))


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root): where the links from a message end; each round doubles the reach."""
    spark = links.sparkSession
    run = scratch(spark, "threads")
    now = materialise(links.select("conv_id", "turn", F.col("to").alias("root")), "roots", run)
    while True:
        ahead = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"))
        then = now.join(ahead, ["conv_id", "root"], "left")
        old, run = run, scratch(spark, "threads")
        then = materialise(then.select("conv_id", "turn", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots", run)
        discard(spark, old)
        now = then.select("conv_id", "turn", "root")
        if then.where("moved").isEmpty():
            return now


def conversations(messages: DataFrame, turns: int = 256) -> DataFrame:
    """conv_id, part, formatted: conversations written out in reply order, in parts of threads that start within so many turns; rows
    that repeat are written once."""
    rows = linked(messages).withColumn("part", F.floor(F.col("thread") / turns).cast("long")).select("conv_id", "part", "thread", "turn", "formatted").distinct()
    rows = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("thread", "turn", "formatted"))).alias("all"))
    return rows.select("conv_id", "part", F.array_join(F.transform("all", lambda x: x["formatted"]), "\n").alias("formatted"))


QUERIES = {"op3_quote_threads": lambda spark, sf_dir: linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))}

ORACLES = {
    "op3_quote_threads": r"""
with recursive m as (select coalesce(conv_id, -9223372036854775808) as conv_id, coalesce(turn, -9223372036854775808) as turn, role, coalesce(text, '') as text from conversations),
q as (select distinct conv_id, turn, text from m where regexp_matches(chr(10) || text, '\n[ \t]*>')),
l0 as (select conv_id, turn, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos, string_split(text, chr(10)) as ls from q),
l1 as (select conv_id, turn, text, pos, len(regexp_replace(regexp_extract(ls[pos], '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) as level,
       regexp_replace(ls[pos], '^[ \t]*(?:>[ \t]?)+', '') as body from l0),
l2 as (select *, lead(level) over w as nx, coalesce(lag(level) over w <> level, true) as nw from l1 window w as (partition by conv_id, turn, text order by pos)),
l3 as (select *, sum(nw::int) over (partition by conv_id, turn, text order by pos) as run from l2
       where not (level = 0 and coalesce(nx, 0) > 0 and regexp_matches(body, '(?i)(wrote|schrieb|a écrit|escribió)[ ]?:[ \t]*$'))),
p as (select conv_id, turn, text, run, level, string_agg(body, chr(10) order by pos) as body from l3 group by all),
own as (select conv_id, turn, text, regexp_replace(string_agg(regexp_replace(body, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), chr(10) order by run), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as own from p where level = 0 group by all),
shape as (select conv_id, turn, text, max(level) as max_level, count(*) filter (level > 0) as n_passages from p group by all),
s0 as (select m.conv_id, m.turn, case when max_level is null then m.text else coalesce(own, '') end as words
       from m left join shape s on s.conv_id = m.conv_id and s.turn = m.turn and s.text = m.text
       left join own o on o.conv_id = m.conv_id and o.turn = m.turn and o.text = m.text where m.conv_id in (select conv_id from p)),
s1 as (select conv_id, turn, unnest(list_concat(list_concat([words], regexp_split_to_array(words, '\n[ \t]*\n')), string_split(words, chr(10)))) as x from s0),
first as (select conv_id, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) as h, min(turn) as source from s1 where conv_id > -9223372036854775808 and turn > -9223372036854775808 group by 1, 2 having h <> ''),
a as (select conv_id, turn, text, run, level, by_, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) as h from (
      select conv_id, turn, text, run, level, body as x, 0 as by_ from p where level > 0 and regexp_matches(body, '[^\x20\x09-\x0D]') union all
      select conv_id, turn, text, run, level, unnest(string_split(body, chr(10))), unnest(range(1, len(string_split(body, chr(10))) + 1)) from p where level > 0 and regexp_matches(body, '[^\x20\x09-\x0D]'))),
f as (select a.conv_id, a.turn, text, run, level, min_by(source, by_) as source from a join first on first.conv_id = a.conv_id and first.h = a.h where source < a.turn group by all),
links as (select conv_id, turn, text, count(*) as n_linked, -(min({'l': level, 's': -source}).s) as reply_to from f group by all),
step as (select conv_id, turn, max(reply_to) as goes from links group by all),
roots as (select conv_id, turn, goes as root from step union all select r.conv_id, r.turn, s.goes from roots r join step s on s.conv_id = r.conv_id and s.turn = r.root),
ends as (select conv_id, turn, min(root) as root from roots group by all)
select nullif(m.conv_id, -9223372036854775808) as conv_id, nullif(m.turn, -9223372036854775808) as turn, m.role, reply_to, case when reply_to is null then nullif(m.turn, -9223372036854775808) else coalesce(root, reply_to) end as thread,
  coalesce(max_level, 0) as max_level, coalesce(n_passages, 0) as n_passages, coalesce(n_linked, 0) as n_linked,
  case when max_level is null then m.text else coalesce(own, '') end as text,
  '<|' || coalesce(m.role, 'user') || '|>' || chr(10) || case when max_level is null then m.text else coalesce(own, '') end as formatted
from m left join shape s on s.conv_id = m.conv_id and s.turn = m.turn and s.text = m.text
left join own o on o.conv_id = m.conv_id and o.turn = m.turn and o.text = m.text
left join links l on l.conv_id = m.conv_id and l.turn = m.turn and l.text = m.text
left join ends e on e.conv_id = m.conv_id and e.turn = m.turn"""
}
