"""Queries over texts: search, metadata filters, tagging, preparation of training sets, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.functions import lexicon as lex
from scoutline.functions import text as tx
from scoutline.operators import annotation, metrics, models, preparation, retrieval, search, tagging
from scoutline.plans import catalogue as base
from scoutline.plans.shared import LOWER, QUERIES, categories_sql, category_sql, draw_sql, label_sql, match_sql, ph, phrase, query, sql_list
from scoutline.sources import views as v

_WORD = "[\\p{L}\\p{N}_]"


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (at % len(values) + 1).cast("int"))


def _pick_sql(values, at: str) -> str:
    return "[" + ", ".join("null" if x is None else "'" + x.replace("'", "''") + "'" for x in values) + f"][{at} % {len(values)} + 1]"


# --- places with texts and vectors, and queries for them -------------------------------------------------------------

_GENRES = (*lex.GENRE_ADJUSTMENTS, None)


def _places(s, d) -> DataFrame:
    vec = v.table(s, d, "embeddings").select(F.col("vec_id").alias("location_id"), F.col("embedding").alias("vec"))
    at = v.location(s, d).withColumn("activities", F.when(F.col("location_id") % 4 != 0, phrase(F.col("location_id")))).withColumnRenamed("macro_region", "district")
    return at.join(vec, "location_id")


def _asked(s, d) -> DataFrame:
    """A query for each place: a phrase, some with the province, a region, or the place's name."""
    vec = v.table(s, d, "embeddings").select(F.col("vec_id").alias("at"), F.col("embedding").alias("vec"))
    i = F.col("location_id")
    more = F.when(i % 3 == 0, F.concat(F.lit(" "), "province")).when(i % 7 == 1, F.lit(" Ege")).otherwise("")
    text = F.concat(phrase(i + 2), more, F.when(i % 4 == 1, F.concat(F.lit(" "), "name")).otherwise(""))
    return v.location(s, d).withColumn("at", 499 - i % 400).join(vec, "at").select(i.alias("q"), text.alias("text"), "vec", _pick(_GENRES, i).alias("genre"), "name")


_PLACES = f"""pl as (select l.location_id, l.name, l.province, l.macro_region as district, case when l.location_id % 4 <> 0 then {ph('l.location_id')} end as activities, e.embedding::double[] as vec from location l join embeddings e on e.vec_id = l.location_id),
qs as (select l.location_id as q, l.name, {ph('(l.location_id + 2)')} || case when l.location_id % 3 = 0 then ' ' || province when l.location_id % 7 = 1 then ' Ege' else '' end || case when l.location_id % 4 = 1 then ' ' || name else '' end as text, e.embedding::double[] as vec, {_pick_sql(_GENRES, 'l.location_id')} as genre from location l join embeddings e on e.vec_id = 499 - l.location_id % 400),
dn as (select q, location_id, list_dot_product(q.vec, p.vec) / sqrt(list_dot_product(q.vec, q.vec) * list_dot_product(p.vec, p.vec)) as sim from qs q, pl p)"""


def _terms(text: str) -> str:
    return f"regexp_extract_all(lower({LOWER.format(text)}), '{_WORD}{{2,}}')"


@query("text_search", f"""with {_PLACES},
pr as (select *, array_to_string(list_filter([name, province, district, activities], lambda x: trim(x) <> ''), ' ') as profile from pl),
pt as (select location_id, term, count(*) as tf from (select location_id, unnest({_terms('profile')}) as term from pr) group by 1, 2),
idf as (select term, ln((1 + (select count(*) from pr)) / (1 + count(*))) + 1 as idf from pt group by 1),
pw as (select location_id, pt.term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by location_id)) as w from pt join idf on idf.term = pt.term),
qt as (select q, term, count(*) as tf from (select q, unnest({_terms('text')}) as term from qs) group by 1, 2),
qw as (select q, qt.term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by q)) as w from qt join idf on idf.term = qt.term),
sp as (select q, location_id, sum(a.w * b.w) as sparse from qw a join pw b on a.term = b.term group by 1, 2),
pc as (select *, {categories_sql("concat_ws(' ', name, activities, profile)")} as cats, concat_ws(' ', name, profile) as about from pr),
qc as (select *, {categories_sql(LOWER.format('text'))} as cats, list_filter((select list(distinct province) from pl), lambda x: list_contains(regexp_extract_all({LOWER.format('text')}, '{_WORD}+'), {LOWER.format('x')})) as named from qs),
s0 as (select q.q, p.location_id, q.genre, round(0.6::double * sim + 0.4::double * coalesce(sparse, 0) + 0.25::double * len(list_intersect(q.cats, p.cats)), 9) as s0 from qc q join dn on dn.q = q.q join pc p on p.location_id = dn.location_id left join sp on sp.q = q.q and sp.location_id = p.location_id where len(named) = 0 or list_contains(named, p.province)),
s1 as (select *, row_number() over (partition by q order by s0 desc, location_id) as p from s0),
s2 as (select s1.*, p.name, p.province, p.district, about, {category_sql('about')} as cat from s1 join pc p on p.location_id = s1.location_id),
s3 as (select *, round(s0 + case when p > 100 or cat is null then 0 {' '.join(f"when genre = '{g}' and cat in ({sql_list(up)}) then 0.15::double" + (f" when genre = '{g}' and cat in ({sql_list(down)}) then -0.1::double" if down else '') for g, (up, down) in lex.GENRE_ADJUSTMENTS.items())} else 0 end, 6) as score from s2),
s4 as (select *, row_number() over (partition by q order by score desc, location_id) as rank from s3)
select q, location_id, name, province, district, {label_sql('cat')} as category, score, rank from s4 where rank <= 5""")
def _(s, d):
    return search.text_search(_places(s, d), _asked(s, d))


def _grams(key: str, text: str, table: str) -> str:
    several = "list_concat(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))"
    return f"(select doc, unnest({several}) as term from (select {key} as doc, {_terms(text)} as t from {table}))"


@query("tfidf_topk", f"""with {_PLACES}, pa as (select location_id as cand, name || ' ' || province || ' ' || coalesce(activities, '') as text from pl),
pt as (select doc, term, 1 + ln(count(*)) as tf from {_grams('cand', 'text', 'pa')} group by 1, 2), idf as (select term, ln((1 + (select count(*) from pa)) / (1 + count(*))) + 1 as idf from pt group by 1),
pw as (select doc, pt.term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by doc)) as w from pt join idf on idf.term = pt.term),
qt as (select doc, term, 1 + ln(count(*)) as tf from {_grams('q', 'text', 'qs')} group by 1, 2),
qw as (select doc, qt.term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by doc)) as w from qt join idf on idf.term = qt.term),
sc as (select a.doc as q, b.doc as cand, round(sum(a.w * b.w), 6) as score from qw a join pw b on a.term = b.term group by 1, 2)
select * from (select *, row_number() over (partition by q order by score desc, cand) as rank from sc where score > 0) where rank <= 5""")
def _(s, d):
    p = _places(s, d).select(F.col("location_id").alias("cand"), F.concat_ws(" ", "name", "province", F.coalesce("activities", F.lit(""))).alias("text"))
    return search.tfidf_topk(p, _asked(s, d).select("q", "text"))


@query("bm25_okapi", f"""with {base._BM25.split('sc as')[0].rstrip().rstrip(',')},
i0 as (select term, ln((n_docs - df + 0.5::double) / (df + 0.5::double)) as idf from df, st), i1 as (select term, case when idf < 0 then 0.25::double * (select avg(idf) from i0) else idf end as idf from i0),
s0 as (select item_id, doc_id, round(sum(qn * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len / avg_len))), 6) as score from qt join po using (term) join i1 using (term), st group by 1, 2)
select * from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s0 where score > 0) where rank <= 5""")
def _(s, d):
    return retrieval.bm25(v.table(s, d, "documents"), v.table(s, d, "benchmark"), floor=0.25)


# --- metadata filters over texts, and how settings compare -----------------------------------------------------------

_CONFIGS = (("No metadata filter", False, False), ("Geographic only", True, False), ("Category boost only", False, True), ("Both", True, True))


def _kinds(text: str) -> str:
    return categories_sql(text, lex.REDUCED_CATEGORIES, lex.SHORT_SUFFIXES)


_REGION = " ".join(f"when {match_sql('text', (name,), lex.SHORT_SUFFIXES)} then [{sql_list(cities)}]" for name, cities in lex.REDUCED_REGIONS.items())


def _city(text: str) -> str:
    """The first province, in order, that a text names."""
    return f"coalesce((select min({LOWER.format('c.province')}) from (select distinct province from pl) c where regexp_matches({LOWER.format(text)}, '(^|[^\\p{{L}}\\p{{N}}_])' || {LOWER.format('c.province')} || '({'|'.join(lex.SHORT_SUFFIXES)})?([^\\p{{L}}\\p{{N}}_]|$)')), '')"


_META = f"""{_PLACES}, pa as (select location_id as cand, name || ' ' || province || ' ' || coalesce(activities, '') as text from pl),
pm as (select cand, {_city('pa.text')} as city, coalesce({_kinds('text')}[1], '') as kind from pa),
qm as (select q, text, {_city('qs.text')} as target, case {_REGION} end as region, {_kinds('text')} as kinds from qs),
cf as (select * from (values {', '.join(f"('{n}', {str(g).lower()}, {str(c).lower()})" for n, g, c in _CONFIGS)}) t(setting, geo, cat)),
sc as (select setting, dn.q, cand, round(round(sim, 6) - case when geo and (case when target <> '' then city <> target else coalesce(not list_contains(region, city), false) end) then 1 else 0 end + case when cat and list_contains(kinds, kind) then 0.25::double else 0 end, 6) as score from cf, dn join pm on pm.cand = dn.location_id join qm on qm.q = dn.q),
rk as (select *, row_number() over (partition by setting, q order by score desc, cand) as rank from sc), hits as (select setting, q, rank, (rank <= 5)::int as hit from rk where cand = q)"""


def _hits(s, d, configs: tuple = _CONFIGS) -> DataFrame:
    p, q = _places(s, d), _asked(s, d)
    passages = p.select(F.col("location_id").alias("cand"), F.concat_ws(" ", "name", "province", F.coalesce("activities", F.lit(""))).alias("text"), "vec")
    cities = [r[0] for r in p.select("province").distinct().collect()]
    ranks = search.metadata_ranks(passages, q.select("q", "text", "vec"), cities, configs)
    return ranks.select("setting", "q", "rank", (F.col("rank") <= 5).cast("int").alias("hit"))


@query("metadata_configs", f"with {_META} select setting, q, rank from hits")
def _(s, d):
    return _hits(s, d).select("setting", "q", "rank")


@query("config_comparison", f"""with {_META}, ab as (select a.setting as x, b.setting as y, a.hit as h, b.hit as g from hits a join hits b on a.q = b.q and a.setting < b.setting),
c as (select x, y, 100 * avg(h - g) as diff, count(*) filter (h = 0 and g = 1) as b01, count(*) filter (h = 1 and g = 0) as b10 from ab group by 1, 2),
t as (select *, unnest(range(0, least(b01, b10) + 1)) as i from c)
select x, y, round(diff, 6) as diff, round(least(1.0, 2 * sum(exp(lgamma(b01 + b10 + 1) - lgamma(i + 1) - lgamma(b01 + b10 - i + 1) - (b01 + b10) * ln(2)))), 6) as p_mcnemar from t group by x, y, diff""")
def _(s, d):
    return metrics.compare_all(_hits(s, d).checkpoint(), reps=1000).select("x", "y", "diff", "p_mcnemar")


@query("named_subsets", f"with {_PLACES}, r as (select q, location_id, row_number() over (partition by q order by round(sim, 6) desc, location_id) as rank from dn), n as (select r.rank, contains({LOWER.format('qs.text')}, {LOWER.format('qs.name')}) as subset from r join qs on qs.q = r.q where r.location_id = r.q) select subset, count(*) as n, round(avg(case when rank <= 1 then 100 else 0 end), 6) as hr1, round(avg(case when rank <= 5 then 100 else 0 end), 6) as hr5 from n group by 1")
def _(s, d):
    q = _asked(s, d)
    ranks = _hits(s, d, _CONFIGS[:1]).join(q, "q")
    return metrics.by_subset(ranks.select("rank", tx.names_place(F.col("text"), F.col("name")).alias("named")))


# --- functions over texts --------------------------------------------------------------------------------------------

_RAWS = (*lex.GENRES, "Komedi / Aile", "Kara polisiye", "Belgesel", " Dram ", "romantik dram", "Aksiyon/Komedi", "müzikal/dram", None)


def _map_genre_sql(raw: str) -> str:
    known = lambda x: "case " + x + " " + " ".join(f"when '{k}' then '{g}'" for k, g in lex.GENRES.items()) + " end"
    first = f"case when contains({raw}, '/') then {known(f'''trim(split_part({raw}, '/', 1))''')} end"
    return f"coalesce({known(f'trim({raw})')}, {first}, " + ", ".join(f"case when regexp_matches(lower({raw}), '{p}') then '{g}' end" for p, g in lex.GENRE_CASCADE) + ")"


@query("map_genre_catalogue", f"with r as (select p_partkey, {_pick_sql(_RAWS, 'p_partkey')} as raw from part) select p_partkey, raw, {_map_genre_sql('raw')} as genre from r")
def _(s, d):
    raw = _pick(_RAWS, F.col("p_partkey"))
    return v.table(s, d, "part").select("p_partkey", raw.alias("raw"), tx.map_genre(raw).alias("genre"))


_REGION_TEXTS = ("Ege kıyısında balıkçı", "KARADENİZ yaylası", "Doğu ekspresi", "İç Anadolu bozkırı", "güneydoğu sofrası", "İzmir ve Ankara arasında", "düz bir metin", "Akdeniz akşamı, Van gölü", None)
_SOME = ("Ankara", "Van", "İzmir")


@query("region_detect", f"""with t as (select p_partkey, {_pick_sql(_REGION_TEXTS, 'p_partkey')} as text from part),
r as (select p_partkey, case {' '.join(f"when {' or '.join(f'''contains({LOWER.format('coalesce(text, chr(32))')}, '{n}')''' for n in names)} then '{','.join(provinces)}' " for names, provinces in lex.REGIONS)} else '' end as region,
array_to_string(list_filter([{sql_list(_SOME)}], lambda x: list_contains(regexp_extract_all({LOWER.format('coalesce(text, chr(32))')}, '{_WORD}+'), {LOWER.format('x')})), ',') as named from t)
select p_partkey, region, case when named <> '' then named else region end as provinces from r""")
def _(s, d):
    t = _pick(_REGION_TEXTS, F.col("p_partkey"))
    return v.table(s, d, "part").select("p_partkey", F.array_join(tx.region_provinces(t), ",").alias("region"), F.array_join(tx.detect_provinces(t, list(_SOME)), ",").alias("provinces"))


@query("place_profile", "select location_id, array_to_string(list_filter([name, case when location_id % 3 = 0 then '  ' when location_id % 3 = 1 then province end, macro_region], lambda x: trim(x) <> ''), ' ') as profile from location")
def _(s, d):
    i = F.col("location_id")
    return v.location(s, d).select("location_id", tx.profile(F.col("name"), F.when(i % 3 == 0, "  ").when(i % 3 == 1, F.col("province")), F.col("macro_region")).alias("profile"))


_ACTORS = ("A B, C D , bilinmiyor", "{{Oyuncular liste, X Y, *Z*", "Bilinmiyor", None, "", "Tek", "{{a liste|Q , R")


@query("actor_lists", f"with t as (select p_partkey, {_pick_sql(_ACTORS, 'p_partkey')} as raw from part) select p_partkey, case when raw is null or lower(raw) = 'bilinmiyor' then '' else array_to_string(list_filter(list_transform(string_split(regexp_replace(raw, '\\{{\\{{[^|}}]*liste\\s*[,|]?', '', 'g'), ','), lambda x: regexp_replace(x, '^[ *]+|[ *]+$', '', 'g')), lambda x: x <> '' and lower(x) <> 'bilinmiyor'), '|') end as actors from t")
def _(s, d):
    return v.table(s, d, "part").select("p_partkey", F.array_join(tx.clean_actor_list(_pick(_ACTORS, F.col("p_partkey"))), "|").alias("actors"))


@query("subwords", "select p_partkey, p_name || ' x' as text from part")
def _(s, d):
    pieces = F.flatten(F.transform(F.split("p_name", " "), lambda w: F.when(F.length(w) > 3, F.array(F.substring(w, 1, 3), F.concat(F.lit("##"), F.substring(w, 4, 100)))).otherwise(F.array(w))))
    return v.table(s, d, "part").select("p_partkey", tx.join_subwords(F.concat(pieces, F.array(F.lit("x")))).alias("text"))


@query("reduced_categories", f"with n as (select item_id, text || ' ' || {ph('item_id')} as name from item), c as (select item_id, {_kinds('name')} as c from n) select item_id, coalesce(c[1], '') as first, array_to_string(c, ',') as categories from c")
def _(s, d):
    name = F.concat("text", F.lit(" "), phrase(F.col("item_id")))
    both = tx.once(tx.reduced_categories(name), lambda c: F.struct(F.coalesce(F.get(c, F.lit(0)), F.lit("")).alias("first"), F.array_join(c, ",").alias("categories")))
    return v.item(s, d).select("item_id", F.inline(F.array(both)))


@query("word_overlap", f"with t as (select p_partkey, string_split(p_name, ' ') as a, string_split({ph('p_partkey')} || ' ' || p_name, ' ') as b from part) select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double, 6) as j from t")
def _(s, d):
    a, b = F.split("p_name", " "), F.split(F.concat(phrase(F.col("p_partkey")), F.lit(" "), "p_name"), " ")
    return v.table(s, d, "part").select("p_partkey", F.round(preparation.jaccard(a, b), 6).alias("j"))


# --- tagging ---------------------------------------------------------------------------------------------------------


def _inside(terms, least: int) -> str:
    return "|".join(t for t in terms if len(t) > least)


_LOW = "regexp_replace(trim(lower(translate(token, 'İI', 'iı'))), '[.,;:!?)(\"'']+$', '')"
_TAGS = f"""sn as (select item_id as sent, {ph('item_id')} || ' ' || text || ' ' || {ph('(item_id + 3)')} as sentence from item),
tk as (select sent, unnest(range(0, len(ts))) as pos, unnest(ts) as token from (select sent, list_filter(regexp_split_to_array(sentence, '\\s+'), lambda x: x <> '') as ts from sn)),
cl as (select sent, pos, token, regexp_matches(token, '^\\p{{Lu}}') as up, case when low in ({sql_list(lex.PLACE_TERMS)}) or regexp_matches(low, '{_inside(lex.PLACE_TERMS, 4)}') then 'P' when low in ({sql_list(lex.TIME_TERMS)}) or regexp_matches(token, '^\\p{{Nd}}{{4}}') then 'T' when low in ({sql_list(lex.EVENT_TERMS)}) or regexp_matches(low, '{_inside(lex.EVENT_TERMS, 5)}') then 'E' else 'O' end as c from (select *, {_LOW} as low from tk)),
tg as (select sent, pos, token, case c when 'P' then case when lag(up) over w and lag(c) over w = 'O' then 'I-MEKAN' else 'B-MEKAN' end when 'T' then 'B-ZAMAN' when 'E' then 'B-OLAY' else case when up and lead(c) over w = 'P' then 'B-MEKAN' else 'O' end end as tag from cl window w as (partition by sent order by pos))"""

query("bio_tags", f"with {_TAGS} select sent, pos, token, tag from tg")(QUERIES["bio_tags"])


def _entities(tags: str) -> str:
    return f"""select sent, kind, min(pos) as start, max(pos) as stop from (select *, sum(new) over (partition by sent order by pos) as n from (select *, (b <> 'O' and not coalesce(b = 'I' and lag(kind) over w = kind and lag(b) over w <> 'O', false))::int as new
from (select sent, pos, substr(tag, 1, 1) as b, substr(tag, 3) as kind from {tags}) window w as (partition by sent order by pos))) where b <> 'O' group by sent, n, kind"""


query("bio_entity_metrics", f"""with {_TAGS}, bl as (select sent, pos, case when (sent + pos) % 7 = 0 then 'O' else tag end as tag from tg),
bo as (select coalesce(g.kind, p.kind) as kind, (g.kind is not null and p.kind is not null)::int as tp, (p.kind is not null)::int as np, (g.kind is not null)::int as ng from ({_entities('tg')}) g full join ({_entities('bl')}) p on g.sent = p.sent and g.kind = p.kind and g.start = p.start and g.stop = p.stop),
pk as (select kind, sum(tp) as tp, sum(np) as np, sum(ng) as ng from bo group by 1 union all select 'micro', sum(tp), sum(np), sum(ng) from bo)
select kind, round(coalesce(tp / nullif(np, 0), 0), 6) as precision, round(coalesce(tp / nullif(ng, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(np + ng, 0), 0), 6) as f1, ng as support from pk""")(QUERIES["bio_entity_metrics"])

_LABELS = ("O", "B-MEKAN", "I-MEKAN", "B-ZAMAN", "I-ZAMAN", "B-OLAY", "I-OLAY")


@query("label_alignment_tokens", f"with {_TAGS}, sw as (select sent, pos, tag, unnest(range(0, ((length(token) + 3) // 4)::bigint)) as r from tg), al as (select sent, pos, r, case when r > 0 and tag like 'B-%' then 'I-' || substr(tag, 3) else tag end as tag from sw) select sent, '-100,' || string_agg(list_position([{sql_list(_LABELS)}], tag) - 1, ',' order by pos, r) || ',-100' as ids from al group by sent")
def _(s, d):
    none = F.array(F.lit(None).cast("int"))

    def ids(t: Column) -> Column:
        words = F.flatten(F.transform(t, lambda x, i: F.array_repeat(i, F.ceil(F.length(x["token"]) / 4).cast("int"))))
        return tagging.align_labels(F.transform(t, lambda x: x["tag"]), F.concat(none, words, none), {label: k for k, label in enumerate(_LABELS)})

    # the tags of a sentence are worked out once
    return base._sentences(s, d).select("sent", F.array_join(tx.once(tagging.bio_tags(F.col("sentence")), ids).cast("array<string>"), ",").alias("ids"))


# --- preparation and annotation --------------------------------------------------------------------------------------

_SHARES = "case when n >= 3 then greatest(round_even(n * 0.15, 0), 1) when n = 2 then 1 else 0 end as a, case when n >= 3 then greatest(round_even(n * 0.10, 0), 1) else 0 end as b"


@query("grouped_split_members", f"with g as (select distinct p_partkey, p_brand from part), r as (select *, count(*) over (partition by p_brand) as n, row_number() over (partition by p_brand order by {draw_sql('p_partkey')}, p_partkey) as rn from g), c as (select *, {_SHARES} from r) select p_partkey, p_brand, case when rn <= a then 'test' when rn <= a + b then 'val' else 'train' end as split from c")
def _(s, d):
    return preparation.grouped_split(v.table(s, d, "part"), "p_partkey", "p_brand")


@query("retrieval_split_members", f"with r as (select item_id, concat_ws('|', text, province, item_id) as k, count(*) over () as n from item), o as (select *, row_number() over (order by {draw_sql('k')}, k) as rn, greatest(100, floor(n * 0.1)) as t, greatest(50, floor(n * 0.1)) as v from r) select item_id as location_id, case when rn <= t then 'test' when rn <= t + v then 'val' else 'train' end as split from o")
def _(s, d):
    pairs = v.item(s, d).select(F.col("text").alias("query"), F.col("province").alias("passage"), F.col("item_id").alias("location_id"))
    return preparation.retrieval_pairs(pairs).select("location_id", "split")


_SPLIT_SENTENCES = "list_transform(string_split(regexp_replace(regexp_replace(trim({0}), '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\r\\n', chr(1), 'g'), chr(1)), lambda x: trim(x))"


@query("prepare_genre", f"""with su as (select trim(lower('Film ' || doc_id % 300)) as parent, text from documents), pr as (select trim(lower('Film ' || p_partkey % 250)) as parent, arg_min({_pick_sql(_RAWS, 'p_partkey')}, p_partkey) as raw, min(p_partkey) as first from part group by 1),
pf as (select pr.parent, {_pick_sql(_RAWS, 'first')} as raw from pr), j as (select su.parent, text, {_map_genre_sql('raw')} as label from su join pf on pf.parent = su.parent),
f as (select * from (select *, row_number() over (partition by text order by parent) as rn from j where label is not null and length(coalesce(text, '')) >= 100) where rn = 1),
g as (select parent, min(label) as label from f group by 1), r as (select *, count(*) over (partition by label) as n, row_number() over (partition by label order by {draw_sql('parent')}, parent) as rn from g), c as (select *, {_SHARES} from r),
sp as (select parent, case when rn <= a then 'test' when rn <= a + b then 'val' else 'train' end as split from c)
select f.parent, label, dense_rank() over (order by label) - 1 as label_id, split, count(*) as n from f join sp on sp.parent = f.parent group by f.parent, label, split""")
def _(s, d):
    su = v.table(s, d, "documents").select(F.concat(F.lit("Film "), (F.col("doc_id") % 300).cast("string"), F.lit(" (2001) [aug2]")).alias("title"), F.col("text").alias("summary"))
    pr = v.table(s, d, "part").select(F.concat(F.lit("FILM  "), (F.col("p_partkey") % 250).cast("string")).alias("title"), _pick(_RAWS, F.col("p_partkey")).alias("genre"), F.col("p_partkey").alias("order"))
    rows = preparation.prepare_genre(su, pr).where("not is_augmented")
    return rows.groupBy("parent", "label", "label_id", "split").agg(F.count("*").alias("n"))


@query("prepare_ner", f"""with a as (select 'scene' as source, item_id as id, 0 as pos, trim({ph('item_id')} || ' ' || text) as text from item),
b as (select 'summary' as source, doc_id as id, unnest(range(0, len(ss))) as pos, unnest(ss) as text from (select doc_id, {_SPLIT_SENTENCES.format('text')} as ss from documents where text is not null)),
r as (select *, concat_ws('|', source, id, pos) as k from (select * from a where length(text) >= 15 union all select * from b where length(text) >= 40)), f as (select *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as n_tokens from r),
o as (select *, row_number() over (order by {draw_sql('k')}, k) as rn, count(*) over () as n from f where n_tokens > 0)
select source, text, n_tokens, case when rn <= floor(n * 0.8) then 'train' when rn <= floor(n * 0.8) + floor(n * 0.1) then 'dev' else 'test' end as split from o""")
def _(s, d):
    scenes = v.item(s, d).select(F.col("item_id").alias("id"), F.concat(phrase(F.col("item_id")), F.lit(" "), "text").alias("text"))
    rows = preparation.prepare_ner(scenes, v.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return rows.select("source", "text", F.size("tokens").cast("long").alias("n_tokens"), "split")


@query("gold_index", f"with p as (select {ph('l_suppkey')} || ' ' || l_linenumber as query, l_suppkey as location_id from lineitem where l_orderkey % 10 = 0), pf as (select location_id, name || ' ' || province as passage from location) select query, p.location_id, dense_rank() over (order by passage) - 1 as gold from p join pf on pf.location_id = p.location_id where length(query) >= 15")
def _(s, d):
    scenes = v.table(s, d, "lineitem").where("l_orderkey % 10 = 0").select(F.col("l_suppkey").alias("location_id"), F.concat(phrase(F.col("l_suppkey")), F.lit(" "), F.col("l_linenumber").cast("string")).alias("text"))
    at = v.location(s, d).select("location_id", F.concat_ws(" ", "name", "province").alias("profile"), F.lit(1).alias("order"))
    old = at.select("location_id", F.lit("old").alias("profile"), F.lit(0).alias("order"))
    return preparation.gold_index(preparation.positives(scenes, preparation.union_all(old, at)))


@query("first_labels", "select source, arg_min(lang, doc_id) filter (lang is not null and doc_id % 3 <> 0) as lang from documents group by 1")
def _(s, d):
    docs = v.table(s, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))
    return preparation.first_label(docs, "source", "lang", "doc_id")


@query("union_frames", "select p_partkey as id, p_name as name, p_size as size, null::varchar as province from part union all select location_id, name, null, province from location")
def _(s, d):
    a = v.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return preparation.union_all(a, v.location(s, d).select(F.col("location_id").alias("id"), "name", "province"))


_STRATA = f"select doc_id, source from (select *, row_number() over (partition by source order by {draw_sql('doc_id')}, doc_id) as rn from documents) where rn <= 50 order by rn, source nulls first limit 50"
query("annotation_queries", _STRATA)(QUERIES["annotation_queries"])


@query("annotation_build", f"with {base._DENSE}, st as (select distinct q, qlabel from dn), ch as (select q from (select *, row_number() over (partition by qlabel order by {draw_sql('q')}, q) as rn from st) where rn <= 4 order by rn, qlabel limit 4) select q, cand, rank, cand = q as is_gold, row_number() over (partition by q order by {draw_sql('q', 'cand')}, cand) as place from dn where q in (select q from ch) and (rank <= 5 or cand = q)")
def _(s, d):
    ranked = base._ranked(s, d).withColumn("is_gold", F.col("cand") == F.col("q"))
    return annotation.build(ranked.select("q", "qlabel").distinct(), ranked, "qlabel", n=4).select("q", "cand", "rank", "is_gold", "place")


@query("single_target", f"with {base._DENSE}, p as (select q, avg((cand = q or label = qlabel)::int) filter (rank <= 5) as p, max((cand = q or label = qlabel)::int) filter (rank <= 5) as h from dn group by q) select count(*) as queries, round(100 * avg(p), 6) as p_at_k, round(100 * avg(h), 6) as hit_rate from p")
def _(s, d):
    first = base._best(s, d, 5, lambda sims, *_: sims).withColumn("rank", base._by(F.desc("score"))).where("rank <= 5")
    return metrics.single_target(first.select("q", "rank", (F.col("label") == F.col("qlabel")).alias("is_gold")))


@query("expert_agreement", """with t as (select quality as a, toxic as b from labels where doc_id % 3 <> 0 and doc_id % 7 <> 0), n as (select a, b, count(*)::double as n from t group by all),
e as (select x.a, y.b, coalesce(n.n, 0) as n, x.r * y.c / (select count(*) from t) as e, pow(x.a - y.b, 2) / 4 as w from (select a, sum(n) as r from n group by a) x cross join (select b, sum(n) as c from n group by b) y left join n on n.a = x.a and n.b = y.b),
rk as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from t)
select sum(n)::bigint as n, round(sum(case when a = b then n else 0 end) / sum(n), 6) as exact, round(sum(case when abs(a - b) <= 1 then n else 0 end) / sum(n), 6) as within_one, round(case when sum(w * e) > 0 then 1 - sum(w * n) / sum(w * e) else 0 end, 6) as kappa, (select round(corr(ra, rb), 6) from rk) as spearman from e""")
def _(s, d):
    i = F.col("doc_id")
    at = v.table(s, d, "labels").select((i % 50).alias("q"), i.alias("cand"), "quality", "toxic")
    human = at.select("q", "cand", F.when(F.col("cand") % 3 == 0, "?").otherwise(F.col("quality").cast("string")).alias("human_score"))
    return metrics.expert_agreement(human, at.where("cand % 7 <> 0").select("q", "cand", F.col("toxic").alias("llm_score")))


@query("grade_counts", "select g as value, (select count(*) from labels where quality = g) as n from range(3) t(g)")
def _(s, d):
    return metrics.bincount(v.table(s, d, "labels"), "quality", 3)


@query("expert_subset", f"select doc_id from (select doc_id from documents order by {draw_sql('doc_id')}, doc_id limit 30) order by doc_id")
def _(s, d):
    return annotation.expert_subset(v.table(s, d, "documents").select("doc_id"), "doc_id", 30)


# --- evaluation ------------------------------------------------------------------------------------------------------

_CLASSES = ("a", "b", "c", "d", "e")


def _predictions(s, d) -> DataFrame:
    i = F.col("doc_id")
    start = F.when(i % 3 == 0, i * 7).otherwise(i)
    ranked = F.transform(F.sequence(F.lit(0), F.lit(len(_CLASSES) - 1)), lambda k: F.element_at(F.array(*map(F.lit, _CLASSES)), ((start + k) % len(_CLASSES) + 1).cast("int")))
    return v.table(s, d, "documents").select("doc_id", _pick(_CLASSES, i).alias("label"), ranked.alias("ranked"))


_PRED = f"pd as (select {_pick_sql(_CLASSES, 'doc_id')} as label, list_transform(range(0, {len(_CLASSES)}), lambda k: {_pick_sql(_CLASSES, '(case when doc_id % 3 = 0 then doc_id * 7 else doc_id end + k)')}) as ranked from documents)"
_PER = f"{_PRED}, cl as (select x.label, (select count(*) from pd where label = x.label) as ng, (select count(*) from pd where ranked[1] = x.label) as np, (select count(*) from pd where label = x.label and ranked[1] = label) as tp from (select distinct label from pd) x)"


@query("top_k_accuracy", f"with {_PER} select (select count(*) from pd) as n, (select round(100 * avg((ranked[1] = label)::int), 6) from pd) as top1, (select round(100 * avg(list_contains(ranked[1:3], label)::int), 6) from pd) as top3, round(100 * avg(coalesce(2 * tp / nullif(ng + np, 0), 0)), 6) as macro_f1 from cl")
def _(s, d):
    return metrics.top_k_accuracy(_predictions(s, d))


@query("class_report", f"with {_PER} select label, round(coalesce(tp / nullif(np, 0), 0), 6) as precision, round(tp / ng, 6) as recall, round(coalesce(2 * tp / nullif(ng + np, 0), 0), 6) as f1, ng as support from cl")
def _(s, d):
    return metrics.classification(_predictions(s, d).select("label", F.get("ranked", F.lit(0)).alias("predicted")))


@query("embedding_head_report")
def _(s, d):
    e = v.table(s, d, "embeddings")
    held = F.crc32(F.col("vec_id").cast("string").cast("binary")) % 4 == 0
    head = models.fit_head(e.where(~held))
    ranked = models.classify(e.where(held), head).join(e.select("vec_id", F.col("label").cast("string").alias("label")), "vec_id")
    return metrics.top_k_accuracy(ranked.select("label", "ranked"))
