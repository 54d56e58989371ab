"""Exact deduplication with a log-structured merge index of text digests.

Memtables: each task gathers (digest -> identifiers) in a bounded table and flushes it as a sorted run.
Runs are written, sorted by digest, to the shared folder. Compaction merges the entries of all runs and
keeps the smallest identifier. A filter over the digests that compaction found more than once picks the
rows of the second pass; those hits are compared byte by byte, first inside each task and then between
tasks, so a hot group sends one text per task. Digests that stand for different bytes are indexed anew
under digest and bytes.

Cases: null text counts as empty, and all empty texts are equal; white space runs count as one space
(also at the ends); of rows with the same smallest identifier one stays; a null identifier sorts last;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm.common import SPACE, cells, materialise, one_each, one_space

#: Entries and identifiers that a memtable holds before it is flushed.
MEMTABLE_IDS = 200_000
#: Identifiers in one row of a run.
ENTRY_IDS = 4_096
#: Bytes of the largest filter that is broadcast; with more digests than fit it well, it lets more texts through.
FILTER_BYTES = 16 << 20
#: Bytes of text that the second pass holds before it sends them on.
VERIFY_BYTES = 32 << 20
RUN = "key binary, sha binary, entry bigint, min_id bigint, n bigint, ids array<bigint>"


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _memtable(digest, full: frozenset | None):
    """full: of these digests only, and with the bytes as part of the key."""

    def flush(tasks):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("key", pa.binary()), ("sha", pa.binary()), ("entry", pa.int64()), ("min_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64()))])
        entry = TaskContext.get().partitionId() << 36
        held: dict[bytes, list] = {}
        n_held = 0

        def run():
            nonlocal entry, n_held
            rows = []
            for key in sorted(held):
                sha, ids = held[key]
                ids.sort(key=lambda x: (x is None, x or 0))
                for k in range(0, len(ids), ENTRY_IDS):
                    part = ids[k : k + ENTRY_IDS]
                    rows.append((key, sha, entry, part[0], len(part), part))
                    entry += 1
            held.clear()
            n_held = 0
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 10_000]), schema)], schema=schema)

        for batch in tasks:
            for doc_id, text in zip(batch.column(0).to_pylist(), cells(batch.column(1))):
                text = one_space(text)
                key = digest(text)
                sha = key if digest is sha256 else None
                if full is not None:
                    if key not in full:
                        continue
                    key += text
                if key in held:
                    held[key][1].append(doc_id)
                else:
                    held[key] = [sha or sha256(text), [doc_id]]
                n_held += 1
                if n_held >= MEMTABLE_IDS:
                    yield from run()
        yield from run()

    return flush


def _positions(n_bits: int, n: int) -> list:
    """n bit positions from a digest's own bytes, as Spark computes them."""
    return [F.pmod(F.conv(F.hex(F.substring("key", 1 + 4 * k, 4)), 16, 10).cast("long"), F.lit(n_bits)) for k in range(n)]


def _filter(keys: DataFrame, n_keys: int) -> tuple[np.ndarray, int]:
    """The bits of a Bloom filter of at most FILTER_BYTES, and the bits that a digest sets. At most one row a word comes back."""
    n_bits = 1 << min(max(10, int(n_keys * 10).bit_length()), max(32, FILTER_BYTES * 8).bit_length() - 1)
    n = min(4, max(1, round(0.7 * n_bits / n_keys)))
    words = keys.select(F.explode(F.array(*_positions(n_bits, n))).alias("at")).groupBy((F.col("at") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("mask"))
    bits = np.zeros(n_bits // 32, np.uint32)
    for word, mask in words.toLocalIterator():
        bits[word] = mask
    return bits, n


def _hits(digest, sent):
    """The distinct texts of a task under each digest that the filter lets through."""

    def pick(tasks):
        import pyarrow as pa

        bits, n = sent.value
        n_bits = len(bits) * 32
        schema = pa.schema([("key", pa.binary()), ("text", pa.binary())])
        held: dict[bytes, list[bytes]] = {}
        n_held = 0

        def send():
            nonlocal n_held
            rows = [(key, text) for key, texts in held.items() for text in texts]
            held.clear()
            n_held = 0
            for k in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows[k : k + 500])], schema=schema)

        for batch in tasks:
            for text in cells(batch.column(0)):
                text = one_space(text)
                key = digest(text)
                at = [int.from_bytes(key[4 * k : 4 * k + 4], "big") % n_bits for k in range(n)]
                if not all(bits[x >> 5] >> np.uint32(x & 31) & np.uint32(1) for x in at):
                    continue
                texts = held.setdefault(key, [])
                if text not in texts:
                    texts.append(text)
                    n_held += len(text) + 100
                    if n_held > VERIFY_BYTES:
                        yield from send()
        yield from send()

    return pick


def index(docs: DataFrame, digest=sha256) -> tuple[DataFrame, DataFrame]:
    """(runs, compacted): all entries of the index, and for each key keep_id, keep_entry and group_size."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text"))

    def flushed(full):
        rows = narrow.mapInArrow(_memtable(digest, full), RUN)
        return materialise(rows.sortWithinPartitions("key"), "run")

    def compact(runs):
        first = F.min(F.struct(F.coalesce("min_id", F.lit(2**63 - 1)).alias("at"), "entry", "min_id"))
        return runs.groupBy("key").agg(first.alias("first"), F.sum("n").alias("group_size")).select("key", F.col("first.min_id").alias("keep_id"), F.col("first.entry").alias("keep_entry"), "group_size")

    runs = flushed(None)
    compacted = materialise(compact(runs), "compacted")
    more = compacted.where("group_size > 1").select("key")
    n_more = more.count()
    if n_more:
        sent = spark.sparkContext.broadcast(_filter(more, n_more))
        texts = narrow.select("text").mapInArrow(_hits(digest, sent), "key binary, text binary")
        differ = texts.groupBy("key").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least <> most")
        clash = [bytes(r[0]) for r in differ.select("key").toLocalIterator()]  # none for SHA-256, short of a broken hash
        if clash:
            again = flushed(frozenset(clash))
            bad = F.col("key").isin(clash)
            runs = runs.where(~bad).unionByName(again)
            compacted = compacted.where(~bad).unionByName(compact(again))
    return runs, compacted


def exact_dedup(docs: DataFrame, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs (doc_id, text)."""
    runs, compacted = index(docs, digest)
    rows = runs.select("key", "sha", "entry", "ids").join(compacted, "key")
    rows = rows.select("sha", "keep_id", "group_size", (F.col("entry") == F.col("keep_entry")).alias("first"), F.posexplode("ids").alias("pos", "doc_id"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("pos") == 0)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    found = exact_dedup(docs)
    by_id = materialise(found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or("kept").alias("stays")).where("stays"), "kept")
    once = docs.join(by_id.where("rows = 1 and doc_id is not null").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    # rows that share a doc_id, or have none, are told apart by their texts
    several = by_id.where("rows > 1 or doc_id is null").select(F.col("doc_id").alias("of"))
    if several.isEmpty():
        return once
    stay = found.where("kept").join(several, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi").select("doc_id", F.col("text_sha256").alias("digest"))
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), rf"[{SPACE}]+", " ")
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.sha2(text, 256).alias("sha"), held)
    again = rows.join(stay, rows["id"].eqNullSafe(stay["doc_id"]) & (rows["sha"] == stay["digest"]), "left_semi")
    return once.unionByName(one_each(again, ["id", "sha"]))


QUERIES = {"op1_exact_dedup": lambda spark, sf_dir: exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))}

ORACLES = {
    "op1_exact_dedup": r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       row_number() over (partition by norm order by doc_id) = 1 as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)"""
}
