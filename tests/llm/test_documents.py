"""Every operator on documents with nulls, empty and long texts, ties, repeated rows, an empty table and columns of its own names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scoutline.llm import byte_bpe, exact_dedup, language_cnn, quality_cotraining, quality_rules, simhash_dedup, source_mixing, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, fingerprint string, size int, key string"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(1, 9))) for _ in range(400)] + ["the", "and", "of", "la", "de"] * 30
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LONG = prose(30_000)
SHARED = prose(120)
TEXTS = [
    (1, prose(80)), (2, None), (3, ""), (4, " \t\n"), (5, "word"), (6, "two words"), (7, LONG), (8, LONG + " end"), (9, prose(60) + SHARED + prose(60)), (10, SHARED + prose(30)),
    (11, "a b c " * 40), (12, "x\ny\nx\n\nx"), (13, "ß日本😀 ### $$$ ||| <>"), (14, "A  B\tC"), (15, "a b c"), (16, "A B C"), (16, "A B C"), (17, "word"), (None, "word"), (18, "\xa0nbsp x y z"),
    (19, "z" * 3_000), (20, "ab" * 900), (21, prose(200)), (22, "Hello, world! It's 3 o'clock.\n\n  Done.  "),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][k % 3], ["s1", "s2", "", None][k % 4], None if k % 5 == 0 else len(t or ""), True, "x", 1, "k") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return SPACE.sub(" ", t or "")


def key(i):
    return (i is None, i or 0)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda b: hashlib.sha256(b).digest()[:1] * 32])
def test_exact_dedup(docs, digest):
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(norm(t), []).append(i)
    want = Counter((i, min(g, key=key), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    got = exact_dedup.exact_dedup(docs, digest).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_drop_copies(docs):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    texts = [norm(r["text"]) for r in out.collect()]
    assert sorted(texts) == sorted({norm(t) for _, t in TEXTS})


def test_memtable_flushes(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE_IDS", 2)
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", 1)
    test_exact_dedup(docs, exact_dedup.sha256)


def test_quality_counts(docs):
    for r in quality_rules.measured(docs.select("doc_id", "text", "kept")).collect():
        t = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_keep_good_keeps_columns(docs):
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns and {1, 7, 21} <= {r["doc_id"] for r in out.collect()}


@pytest.mark.parametrize("block", [8192, 3])
def test_simhash(docs, monkeypatch, block):
    import xxhash

    monkeypatch.setattr(simhash_dedup, "BLOCK", block)

    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not w:
            return 0
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, plain(t)) for i, t in TEXTS]
    group = list(range(len(rows)))
    for _ in rows:
        for a, (_, x) in enumerate(rows):
            group[a] = min(group[b] for b, (_, y) in enumerate(rows) if (x ^ y).bit_count() <= 3)
    ids = {}
    for g, (i, _) in zip(group, rows):
        ids[g] = min([x for x in (ids.get(g), i) if x is not None], default=None)
    want = Counter((i, f"{x:016x}", ids[g]) for g, (i, x) in zip(group, rows))
    assert Counter((r[0], r[1], r[2]) for r in simhash_dedup.near_duplicates(docs).collect()) == want
    assert simhash_dedup.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("block", [8192, 2])
@pytest.mark.parametrize("thresholds", [(2, 0), (1, 1), (1, 0, 0), (2, 0, -1), (0, 0, 0, 0), (3, -1, 0)])
def test_every_allocation_finds_all_links(spark, monkeypatch, thresholds, block):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base.tolist():
        for _ in range(4):
            y = x
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False).tolist():
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    cut = np.array_split(np.arange(64), len(thresholds))
    monkeypatch.setattr(simhash_dedup, "search_plan", lambda n, both: [(c.tolist(), t) for c, t in zip(cut, thresholds) if t >= 0])
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp bigint, node bigint")
    label = {r["node"]: r["component"] for r in simhash_dedup.components(simhash_dedup.links(nodes)).collect()}
    want = list(range(len(fps)))
    for _ in range(6):
        want = [min(want[j] for j, y in enumerate(fps) if (x ^ y).bit_count() <= 3) for x in fps]
    assert [label.get(i, i) for i in range(len(fps))] == want


def test_allocation_costs_add_up():
    agree, corr = np.full(64, 0.5), np.zeros((64, 64))
    for m in (2, 3, 4):
        parts = simhash_dedup.group_bits(corr, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        assert sum(t + 1 for t in simhash_dedup.allocate(10**6, parts, agree, corr)[1]) == 4


@pytest.mark.parametrize("group,piece", [(1_024, 1 << 22), (1, 1 << 22), (2, 1 << 12)])
def test_substring_dedup(spark, docs, monkeypatch, group, piece):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    texts = [(i, (t or "").encode()) for i, t in TEXTS]
    seen = Counter(t[k : k + 400] for _, t in texts for k in range(len(t) - 399))
    want = Counter()
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        rest = bytes(b for b, g in zip(t, gone) if not g)
        want[i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()] += 1
    assert Counter(tuple(r) for r in substring_dedup.remove_repeats(docs).collect()) == want


def test_mixing(docs):
    rows = source_mixing.mix(docs).collect()
    again = source_mixing.mix(docs.repartition(2)).collect()
    assert Counter(tuple(r) for r in rows) == Counter(tuple(r) for r in again) and len(rows) == len(TEXTS)
    total = sum(r["size"] for r in rows)
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    assert sum(x[0]["target"] for x in sources.values()) == pytest.approx(total)
    for x in sources.values():
        assert x[0]["target"] <= 3 * x[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= max(r["size"] for r in x)
    assert source_mixing.take(docs).columns == docs.columns
    assert source_mixing.take(docs).count() == sum(r["copies"] for r in rows)


def test_targets_are_reshared():
    assert source_mixing.targets([100, 1, 100], [1, 2, 3]) == pytest.approx([49.5, 3.0, 148.5])


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), f"s{i % 5}") for i in range(3_000)]
    out = {}
    for r in source_mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect():
        t = out.setdefault(r["source"], [0, r["target"]])
        t[0] += r["taken"]
    assert all(abs(a - b) <= 2 for a, b in out.values())


def test_rows_without_identifier_are_drawn_singly(spark):
    rows = [(None, "a b c d e f g h i j", "x", k) for k in range(300)] + [(i, "w " * 10, s, 0) for i, s in enumerate(["y", "z"] * 150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int").repartition(5)
    out = source_mixing.mix(docs)
    for s, taken, target in out.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(taken - target) <= 10
    again = source_mixing.mix(docs.repartition(2))
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, again.collect()))
    got = Counter(r["n"] for r in source_mixing.take(docs).where("source = 'x'").collect())
    assert len(got) <= 300 and sum(got.values()) == sum(r["copies"] for r in out.where("source = 'x'").collect())


def test_mixing_follows_the_pareto_order(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["a", "b", "c", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    uniform = F.shiftrightunsigned(F.xxhash64("h", F.lit(0).cast("long"), F.lit(source_mixing.SEED)), 11)
    drawn = docs.select(*source_mixing._narrow(docs)).select("doc_id", "source", "size", ((uniform + 0.5) / 2.0**53).alias("u")).collect()
    sources = sorted({r["source"] for r in drawn}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in drawn if r["source"] == s) for s in sources]
    want = {}
    for s, size, target in zip(sources, sizes, source_mixing.targets(sizes, [1, 2, 3, 1])):
        whole = min(3, int(target / size + 1e-12))
        rest = target - whole * size
        own = [r for r in drawn if r["source"] == s]
        weight = {r["doc_id"]: round(math.log2(r["size"] + 2) * 8) / 8 for r in own}
        low, high = 0.0, 1 / min(weight.values())
        for _ in range(60):
            x = (low + high) / 2
            low, high = (x, high) if sum(min(0.999, x * weight[r["doc_id"]]) * r["size"] for r in own) < rest else (low, x)
        p = {i: min(0.999, max(1e-9, high * w)) for i, w in weight.items()}
        order = sorted(own, key=lambda r: r["u"] / (1 - r["u"]) * (1 - p[r["doc_id"]]) / p[r["doc_id"]])
        taken, k = 0, 0
        while k < len(order) and taken + order[k]["size"] <= rest:
            taken += order[k]["size"]
            k += 1
        copies = {r["doc_id"]: whole + (j < k) for j, r in enumerate(order)}
        gap = rest - taken
        fits = [r for r in order[k:] if r["size"] and abs(r["size"] - gap) < gap]
        if fits:
            copies[min(fits, key=lambda r: abs(r["size"] - gap))["doc_id"]] += 1
            best = min(abs(r["size"] - gap) for r in fits)
            copies |= {"off": best}
        want[s] = (copies, gap)
    for s in sources:
        got = {r["doc_id"]: r["copies"] for r in source_mixing.mix(docs).where(F.col("source").eqNullSafe(F.lit(s))).collect()}
        copies = dict(want[s][0])
        copies.pop("off", None)
        differ = [i for i in got if got[i] != copies[i]]
        size = {r["doc_id"]: r["size"] for r in drawn}
        assert len(differ) in (0, 2) and len({size[i] for i in differ}) <= 1  # only the filling document may be another of its size


def test_bpe(docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    raw = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.Encoder(raw, P.PATTERN, blanks_part=True)
    rng = random.Random(1)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "日本", "😀", "'s", "1", "...", "\x1c", "\r\n", "İ", "ab" * 30, "​", "<|endoftext|>"]
    for t in [t or "" for _, t in TEXTS] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2_000)]:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.public(docs).collect())
    ids = {t: np.array(known.encode_ordinary(t or ""), "<u4") for _, t in TEXTS}
    assert got == Counter((i, len(ids[t]), hashlib.sha256(ids[t].tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    back = byte_bpe.decode(byte_bpe.public(docs, with_ids=True), path, P.PATTERN)
    assert Counter(tuple(r) for r in back.collect()) == Counter((i, t or "") for i, t in TEXTS)


def test_bpe_with_another_pattern():
    import base64

    import public_tokenizers as P
    import tiktoken

    raw = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    for pattern in (r"(?s:.+)", r"\w+ ?|[^\w]+", r"[a-z]+ [a-z]+|(?s:.)"):
        known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        own = byte_bpe.Encoder(raw, pattern)
        for t in ["the thing and the\nother", "a b  c", "word", " x\n", prose(30)]:
            assert np.frombuffer(own.encode(t), "<u4").tolist() == known.encode_ordinary(t)


def test_keep_one_of_each_component(spark):
    near = prose(400)
    rows = [(1, near, "a"), (2, near + " tail", "b"), (None, near, "c"), (3, "", "d"), (None, None, "e"), (4, prose(50), "f"), (4, prose(50), "g"), (5, "x y z", "h"), (5, "x y z", "i"), (None, "only here once", "j"), (None, "only here once", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, size string").repartition(3)
    got = sorted((r["doc_id"] or 0, r["size"]) for r in simhash_dedup.keep_one(docs).collect())
    assert got == sorted((r["doc_id"] or 0, r["size"]) for r in simhash_dedup.keep_one(docs.repartition(1)).collect())
    assert got == [(0, "j"), (1, "a"), (3, "d"), (4, "f"), (4, "g"), (5, "h")]


def test_null_identifiers_bridge(spark, monkeypatch):
    prints = {"a": 0b111, "b": 0b111111, "c": 0b111111111, "d": 0xFF << 20}
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs, *more: spark.createDataFrame([(i, prints[t]) for i, t in docs.select("doc_id", "text").collect()], "doc_id bigint, fp bigint"))
    docs = spark.createDataFrame([(7, "a"), (None, "b"), (9, "c"), (None, "d")], "doc_id bigint, text string")
    assert Counter(r["component_id"] for r in simhash_dedup.near_duplicates(docs).collect()) == Counter([7, 7, 7, None])


def test_language(spark, docs):
    rows = [(i, " ".join(RNG.choice(words) for _ in range(60)), lang) for i, (lang, words) in enumerate([("en", ["the", "thing", "shower", "with"]), ("de", ["der", "schön", "größe", "ich"])] * 60)]
    known = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = language_cnn.learn(known)
    out = language_cnn.identify(known, net).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in out if r["held_out"]]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in out)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    odd = {r["doc_id"]: r for r in language_cnn.identify(docs, net).collect()}
    assert len(odd) == len({i for i, _ in TEXTS}) and all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (2, 3, 4))
    assert all(0 <= r["score"] <= 1 for r in odd.values())


def test_language_sample(spark, monkeypatch):
    monkeypatch.setattr(language_cnn, "RANGES", 16)
    rows = [(i, "abc " * 700, "en" if i % 3 else "de") for i in range(600)] + [(i, "abc", "en") for i in range(5)] + [(None, "x", "en"), (700, None, "en"), (701, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {(r["lang"], r["doc_id"]): r["h"] for r in language_cnn.sample(docs, 50).collect()}
    every = docs.selectExpr("doc_id", "lang", "xxhash64(doc_id, 11) h").where("crc32(cast(doc_id as string)) % 4 <> 2 and text is not null and lang is not null").distinct().collect()
    want = {}
    for lang in ("en", "de"):
        want |= {(lang, r["doc_id"]): r["h"] for r in sorted((r for r in every if r["lang"] == lang), key=lambda r: (r["h"], r["doc_id"]))[:50]}
    assert got == want


def test_windows_come_from_the_whole_text():
    import pyarrow as pa

    text = "".join(f"{k:07d} x" for k in range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 50), pa.array(range(50)), pa.array(range(50)), pa.array([text] * 50)], names=["lang", "doc_id", "h", "text"])
    drawn = [bytes(r) for b in language_cnn._drawn([batch]) for r in b.column(3).to_pylist()]
    at = [text.encode().find(row.rstrip(b"\0")[:40]) for row in drawn if len(row.rstrip(b"\0")) >= 40]
    assert len(drawn) == 200 and max(at) > 150_000 and min(at) < 30_000


def test_cotraining_report(spark):
    rows = [(i, prose(60) if i % 2 else " ".join(w + "###" for w in prose(60).split()), "http://a.example/" if i % 2 else "http://b.example/") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id bigint, quality int")
    out = quality_cotraining.report(docs, labels).first()
    assert out["n"] >= 20 and min(out["content"], out["metadata"], out["both"]) >= 0.9
    model = quality_cotraining.learn(docs, labels, pool_share=1.0)
    assert min(model.given) > 0


def test_cotraining(spark, docs):
    rows = [(i, prose(60) if i % 2 else " ".join(w + "###" for w in prose(60).split()), "en", f"s{i % 2}", None) for i in range(80)]
    known = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60)] + [(999, 1), (None, 1), (3, None)], "doc_id bigint, quality int")
    out = quality_cotraining.classify(known, labels).collect()
    assert sum((r["quality_score"] >= 0.5) == bool(r["doc_id"] % 2) for r in out) >= 78
    assert quality_cotraining.classify(docs, labels.limit(0)).count() == len(TEXTS)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    for out in (exact_dedup.exact_dedup(empty), exact_dedup.drop_copies(empty), quality_rules.measured(empty), quality_rules.keep_good(empty), language_cnn.identify(empty), substring_dedup.remove_repeats(empty), quality_cotraining.classify(empty, labels), source_mixing.mix(empty), source_mixing.take(empty), simhash_dedup.near_duplicates(empty), simhash_dedup.keep_one(empty), byte_bpe.public(empty)):
        assert out.count() == 0
