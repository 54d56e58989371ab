import os
import random
from collections import Counter

import pytest

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_stages(spark):
    from scoutline.llm.common import materialise

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = materialise(stage(spark, docs, SMALL), "t")
        assert docs.columns == columns and 0 < docs.count() <= n, name
        n = docs.count()
    assert docs.select("doc_id").distinct().count() == n
    for name, stage in corpus_pipeline.STAGES[3:]:
        docs = materialise(stage(spark, docs, SMALL), "t")
    assert docs.count() == corpus_pipeline.run(spark, SMALL).count()


RNG = random.Random(4)
WORDS = ["the", "and", "of", "river", "stone", "morning", "window", "letter", "garden", "silver", "quiet", "north"] + ["".join(RNG.choice("abcdefgh") for _ in range(6)) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS) if k % 4 else "the" for k in range(n))


def odd_rows():
    good, long = prose(90), prose(20_000)
    rows = [(1, good, "s"), (2, good, "s"), (2, good, "s"), (None, good, "s"), (3, None, "s"), (4, "", None), (5, " \n", "s"), (6, long, None), (7, long + " more", None), (None, prose(80), "t"), (None, None, None)]
    rows += [(8, prose(70), "t"), (8, prose(70), "t"), (9, "### " * 100, "t"), (10, "short", "t"), (11, prose(120).replace(" ", "\t"), "u")]
    return [(*r, "x", k, True) for k, r in enumerate(rows)]


def test_stages_on_odd_rows(spark):
    schema = "doc_id bigint, text string, source string, copies string, `row` int, kept boolean"
    docs = spark.createDataFrame(odd_rows(), schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    want = {"quality_rules": lambda r: r["text"] is not None and len(r["text"].split()) >= 50 and "###" not in r["text"]}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out, again = (Counter(tuple(r) for r in stage(spark, d, "").collect()) for d in (docs, docs.repartition(1)))
        assert stage(spark, docs, "").columns == docs.columns, name
        assert name == "source_mixing" or out == again, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
        if name in want:
            assert out == Counter(tuple(r) for r in docs.collect() if want[name](r))
    one = [r["doc_id"] for r in stages["exact_dedup"](spark, docs, "").collect()]
    assert Counter(one) == Counter([1, 3, 6, 7, 8, 8, 9, 10, 11, 5, None])
    near = stages["simhash_near_dedup"](spark, docs, "").collect()
    assert {r["doc_id"] for r in near} >= {1, 3, 6, 8, 9, 10, 11} and not {2, 4, 5, 7} & {r["doc_id"] for r in near}
    encoded = stages["byte_bpe"](spark, docs, "").collect()
    assert len(encoded) == len(odd_rows()) and all((r["n_tokens"] == 0) == (r["ids"] == b"") for r in encoded)


def kept_by_rules(text):
    import re

    from scoutline.llm.quality_rules import STOP_WORDS

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return False
    n, lines = len(words), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda chars: sum(text.count(c) for c in chars) / n
    stop = sum(w.lower() in STOP_WORDS for w in words) / n
    return 2 <= sum(map(len, words)) / n <= 25 and share("#*$%&|<>") <= 0.3 and share("!?~^=_@") <= 0.6 and (len(lines) - len(set(lines))) / max(1, len(lines)) <= 0.5 and stop >= 0.02


def fingerprint(text):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def mixed(rows, u):
    """(doc_id, copies) by the whole Pareto order of each source; rows: doc_id, text, source."""
    import math

    from scoutline.llm.source_mixing import targets

    size = {i: len(t.split()) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: [i for i, _, x in rows if x == s] for s in sources}
    sizes = [sum(size[i] for i in own[s]) for s in sources]
    out = {}
    for s, n, target in zip(sources, sizes, targets(sizes, [(1, 2, 3)[k % 3] for k in range(len(sources))])):
        whole = min(3, math.floor(target / n + 1e-12))
        rest = max(0.0, target - whole * n)
        weight = {i: round(math.log2(size[i] + 2) * 8) / 8 for i in own[s]}
        low, high = 0.0, 1 / min(weight.values())
        for _ in range(60):
            x = (low + high) / 2
            low, high = (x, high) if sum(min(0.999, x * weight[i]) * size[i] for i in own[s]) < rest else (low, x)
        p = {i: min(0.999, max(1e-9, high * w)) for i, w in weight.items()}
        order = sorted(own[s], key=lambda i: u[i] / (1 - u[i]) * (1 - p[i]) / p[i])
        taken, k = 0, 0
        while k < len(order) and taken + size[order[k]] <= rest:
            taken += size[order[k]]
            k += 1
        fits = [i for i in order[k:] if size[i] and abs(size[i] - (rest - taken)) < rest - taken]
        extra = min(fits, key=lambda i: (abs(size[i] - (rest - taken)), order.index(i)), default=None)
        out |= {i: whole + (j < k or i == extra) for j, i in enumerate(order)}
    return out


def test_run_matches_brute_force(spark, tmp_path):
    import base64
    import hashlib

    import public_tokenizers as P
    import tiktoken
    from pyspark.sql import functions as F

    from scoutline.llm import source_mixing

    texts = [prose(RNG.randint(55, 260)) for _ in range(70)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(100 + k, texts[k] if k % 2 else texts[k].replace(" ", "\n", 3)) for k in range(8)]  # copies up to white space
    rows += [(200 + k, texts[10 + k] + " tail") for k in range(8)] + [(300, None), (301, ""), (302, "too short"), (303, "### the " * 80), (304, "a b c the " * 40)]
    docs = [(i, t, "en", [None, "a", "b", "c", "d"][i % 5], len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")

    kept = [r for r in docs if kept_by_rules(r[1])]
    first = {}
    for r in kept:
        first.setdefault(" ".join(r[1].split()), r)
    kept = list(first.values())
    prints = [fingerprint(r[1]) for r in kept]
    group = list(range(len(kept)))
    for _ in kept:
        group = [min(group[b] for b, y in enumerate(prints) if (x ^ y).bit_count() <= 3) for x in prints]
    kept = [r for k, r in enumerate(kept) if group[k] == k]
    assert 60 <= len(kept) < 78
    table = spark.createDataFrame(kept, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    draw = (F.shiftrightunsigned(F.xxhash64("h", F.lit(0).cast("long"), F.lit(source_mixing.SEED)), 11) + 0.5) / 2.0**53
    u = {r["doc_id"]: r["u"] for r in table.select(*source_mixing._narrow(table)).select("doc_id", draw.alias("u")).collect()}
    copies = mixed([(r[0], r[1], r[3]) for r in kept], u)
    raw = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    want = Counter()
    for r in kept:
        ids = b"".join(i.to_bytes(4, "little") for i in known.encode_ordinary(r[1]))
        want[r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()] += copies[r[0]]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect())
    assert got == +want
