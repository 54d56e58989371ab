"""Removal of repeated substrings by bucket-pointer refinement.

A byte goes if it lies in a string of LENGTH bytes that also starts elsewhere in the corpus. A string's bucket is
refined from the buckets of its parts: strings of 2, 4, ... 128, 256 and LENGTH bytes are named by their first half's
name and the name at the later offset, and each round uses the names of the round before.

1. Initial buckets. Each window of WINDOW positions picks its least GRAM-byte string, so any LENGTH bytes hold an
   anchor that depends on them alone, and equal strings share an anchor at equal offsets. Anchors only choose where
   to refine: the bucket of an anchor holds the segments around its occurrences, with every string of LENGTH bytes
   around the anchor. Buckets of one occurrence are dropped.
2. Segments whose first and last strings of LENGTH bytes have the same refined names are one class (the two strings
   cover the segment, so all between them agree too), counted in each text before anything is sent. A class of two or more is repeated throughout; it stays in its
   bucket as one segment. A bucket of one class is done.
3. A bucket with differing segments is refined in one task: positions form buckets by their first eight bytes and
   their offset from the anchor, and are refined by sorting on the bucket identifiers of later offsets; the refined
   identifiers are used again for the next, twice as deep round, up to LENGTH. A position alone in its bucket is out,
   and so is what builds on it. What shares a bucket at the end is repeated.
4. Before that, a bucket of more than GROUP segments is split by the same rule, in Spark: the offsets of its strings
   are halved, and a half's segments are dealt anew by the name of the bytes that all its strings share, which reach
   further left or right. Classes and buckets are counted by aggregation, so a frequent passage lands in no one task;
   classes of two or more and single buckets are decided, and the others are halved again, down to one string.

Names are 64 bits and compared within an anchor's bucket (64 bits more). Cases: null and empty texts have no bytes; a
text shorter than LENGTH stays; matches do not cross rows; repeated rows repeat each other; runs that touch or overlap
are one span; texts of any length are taken whole (a text's wanted segments are listed beside it, a few bytes for each
hundred of its own); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm.common import cells, discard, materialise, scratch

LENGTH, GRAM = 400, 128
#: Positions of which each window picks one: any LENGTH bytes hold a whole window of grams.
WINDOW = LENGTH - GRAM + 1
#: Bytes before an anchor in its segment.
BEFORE = LENGTH - GRAM
#: Segments of a bucket that one task refines; a larger bucket is split in Spark first.
GROUP = 4_096
#: Bytes of segments that are refined at once: few enough for a core's own cache.
BATCH = 100_000
#: Long texts are scanned in pieces of so many bytes.
PIECE = 1 << 22
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_PLACE = np.uint64((1 << 26) - 1)


def _names(data: np.ndarray) -> np.ndarray:
    """The names of the strings of GRAM bytes from each position, by doubling."""
    h, width = data.astype(np.uint64), 1
    for m in _MULTIPLIERS:  # strings of 2, 4, ... 128 bytes
        h = h[:-width] * m + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h


def _joined(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The name of a string from the name of its beginning and that at a later offset."""
    h = first * _MULTIPLIERS[2] + later * _MULTIPLIERS[5]
    h ^= h >> np.uint64(31)
    h *= _MULTIPLIERS[3]
    return h ^ (h >> np.uint64(29))


def _refined_names(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The names of the strings of LENGTH bytes from the positions at: 128 bytes to 256, to LENGTH."""
    twice = lambda x: _joined(h[x], h[x + GRAM])
    return _joined(twice(at), twice(at + LENGTH - 2 * GRAM))


def _picked(h: np.ndarray) -> np.ndarray:
    """The least position of each window."""
    key = (h * _MULTIPLIERS[0] & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    n = len(key) - WINDOW + 1
    padded = np.full(-(-len(key) // WINDOW) * WINDOW, ~np.uint64(0))
    padded[: len(key)] = key
    rows = padded.reshape(-1, WINDOW)
    to_here = np.minimum.accumulate(rows, axis=1).ravel()
    from_here = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    picked = np.minimum(from_here[:n], to_here[WINDOW - 1 : WINDOW - 1 + n]) & _PLACE
    return picked[np.concatenate(([True], picked[1:] != picked[:-1]))].astype(np.int64)


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The positions of a text's anchors, their names, and the names of the segments around them."""
    size = len(text)
    none = np.zeros(0, np.int64)
    if size < LENGTH:
        return none, none, none
    data, found = np.frombuffer(text, np.uint8), []
    for k in range(0, max(1, size - LENGTH + 1), PIECE):
        begin, end = max(0, k - BEFORE), min(size, k + PIECE + LENGTH - 1 + BEFORE)
        h = _names(data[begin:end])
        at = _picked(h)
        left, right = np.maximum(at - BEFORE, -begin), np.minimum(at + LENGTH, size - begin)
        inside = (left >= 0) & (right <= end - begin)  # the others belong to the piece before or after
        at, left, right = at[inside], left[inside], right[inside]
        s = _joined(_refined_names(h, left), _refined_names(h, right - LENGTH))
        s = _joined(s, ((right - left) * LENGTH + at - left).astype(np.uint64))
        found.append((at + begin, _joined(h[at], h[at]).view(np.int64), s.view(np.int64)))
    if len(found) == 1:
        return found[0]
    at, names, segments = (np.concatenate(x) for x in zip(*found))
    at, first = np.unique(at, return_index=True)
    return at, names[first], segments[first]


def _runs(b: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs that intervals, in order, cover together."""
    new = np.flatnonzero(np.concatenate(([True], b[1:] > e[:-1])))
    return b[new], e[np.concatenate((new[1:] - 1, [len(e) - 1]))]


def _occurrences(batches):
    """A row for each anchor of a text, those with the same segment in one (n of them); and, without an anchor, the runs
    of a text that segments found twice in it cover."""
    import pyarrow as pa

    names = ["did", "th", "a", "s", "b", "e", "off", "n"]
    for batch in batches:
        did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        out: list[list] = [[] for _ in names]
        missing: list[np.ndarray] = []
        for k, text in enumerate(cells(batch.column(2))):
            at, anchor, segment = anchors(text)
            if not len(at):
                continue
            b, e, off = np.maximum(at - BEFORE, 0), np.minimum(at + LENGTH, len(text)), np.minimum(at, BEFORE)
            _, first, which, n = np.unique(segment, return_index=True, return_inverse=True, return_counts=True)
            anchor, segment, own = anchor[first], segment[first], [b[first], e[first], off[first], n]
            if len(first) < len(at):
                twice = n[which] > 1
                runs = _runs(b[twice], e[twice])
                m = len(runs[0])
                fill = np.zeros(m, np.int64)
                anchor, segment = np.concatenate((anchor, fill)), np.concatenate((segment, fill))
                own = [np.concatenate(x) for x in zip(own, (*runs, fill, fill))]
                missing.append(np.arange(len(anchor)) >= len(first))
            else:
                missing.append(np.zeros(len(anchor), bool))
            for column, values in zip(out, (np.full(len(anchor), did[k]), np.full(len(anchor), th[k]), anchor, segment, *own)):
                column.append(values)
        if missing:
            no_anchor = np.concatenate(missing)
            columns = [np.concatenate(c) for c in out]
            arrays = [pa.array(c, mask=no_anchor) if name in ("a", "s") else pa.array(c.astype(np.int32) if name in ("b", "e", "off") else c) for name, c in zip(names, columns)]
            rows = pa.RecordBatch.from_arrays(arrays, names=names)
            yield from (rows.slice(k, 20_000) for k in range(0, rows.num_rows, 20_000))


def _cut(batches):
    """One row for each wanted segment: its bytes. Rows that repeat meet in a task and bring their segments once."""
    import pyarrow as pa

    seen: set[tuple[int, int]] = set()

    names = ["a", "s", "n", "did", "th", "b", "off", "lo", "hi", "seg"]
    for batch in batches:
        texts = cells(batch.column(2))
        rows: list[list] = [[] for _ in names]
        for k, wanted in enumerate(batch.column(3).to_pylist()):
            text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            if text in seen:
                continue
            seen.add(text)
            for w in wanted:
                for c, v in zip(rows, (w["a"], w["s"], w["n"], *text, w["b"], w["off"], 0, BEFORE, texts[k][w["b"] : w["e"]])):
                    c.append(v)
            if len(rows[0]) >= 5_000:
                yield _rows(pa, names, rows)
                rows = [[] for _ in names]
        if rows[0]:
            yield _rows(pa, names, rows)


def _rows(pa, names, rows):
    kinds = {"b": pa.int32(), "e": pa.int32(), "off": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "seg": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(name, pa.int64())) for name, c in zip(names, rows)], names=names)


SEGMENT = "a bigint, s bigint, n bigint, did bigint, th bigint, b int, off int, lo int, hi int, seg binary"
SEGMENT_COLUMNS = [c.split()[0] for c in SEGMENT.split(", ")]
SPAN = "did bigint, th bigint, b int, e int"


def refine(texts: list[bytes], groups: list[int], shifts: list[int]) -> list[np.ndarray]:
    """For each text, whether the LENGTH bytes from each of its positions also occur in another text of its group
    at the same place (position minus shift). Bucket-pointer refinement."""
    data = b"".join(texts) + bytes(8)
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    n = int(starts[-1])
    within = np.arange(n) - np.repeat(starts[:-1], sizes)
    room = np.repeat(sizes, sizes) - within  # bytes from here to the end of the text
    place = within - np.repeat(np.array(shifts), sizes) + LENGTH
    word = np.empty(n, np.uint64)  # the eight bytes from each position
    for k in range(min(8, n)):
        m = len(range(k, n, 8))
        word[k::8] = np.frombuffer(data, "<u8", m, k)
    bucket = np.full(n, -1, np.int64)

    def rank(at: np.ndarray, keys: np.ndarray) -> None:
        """New identifiers for the positions at; those alone in their bucket get none."""
        bucket[:] = -1
        if len(at):
            order = np.argsort(keys)
            ordered = keys[order]
            first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
            number = np.cumsum(first) - 1
            shared = np.bincount(number)[number] > 1
            bucket[at[order[shared]]] = number[shared]

    at = np.flatnonzero(room >= 8)
    order = np.argsort(word[at])
    ordered = word[at[order]]
    letters = np.empty(len(at), np.int64)
    letters[order] = np.cumsum(np.concatenate((np.zeros(min(1, len(at)), np.int64), ordered[1:] != ordered[:-1])))
    where = np.repeat(np.array(groups, np.int64), sizes)[at] * (3 * LENGTH) + place[at]  # fits beside the letters: a task holds few groups
    rank(at, where * (int(letters.max(initial=0)) + 1) + letters)
    depth = 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)  # the last round overlaps what is known
        at = np.flatnonzero((bucket >= 0) & (room >= depth + step))
        at = at[bucket[at + step] >= 0]
        rank(at, bucket[at] * (n + 1) + bucket[at + step])
        depth += step
    return [bucket[a:b] >= 0 for a, b in zip(starts[:-1], starts[1:])]


def spans(repeated: np.ndarray, begin: int) -> list[tuple[int, int]]:
    """The runs of bytes that repeated strings of LENGTH bytes cover, from where they start."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > LENGTH)
    first, last = at[np.concatenate(([0], gap + 1))], at[np.concatenate((gap, [len(at) - 1]))]
    return [(begin + int(a), begin + int(b) + LENGTH) for a, b in zip(first, last)]


def _refined(batches):
    """The spans of segments that occur once; rows come sorted by anchor."""
    import pyarrow as pa

    names = ["did", "th", "b", "e"]
    held: list[list[tuple]] = []  # the groups to be refined at once
    group: list[tuple] = []
    n_held = 0

    def done():
        nonlocal n_held
        rows: list[list] = [[] for _ in names]
        flat = [(k, x) for k, g in enumerate(held) for x in g]
        marks = refine([x[9] for _, x in flat], [k for k, _ in flat], [x[6] for _, x in flat]) if flat else []
        for (_, (a, s, n, did, th, b, off, lo, hi, seg)), m in zip(flat, marks):
            if n == 1:
                for x, y in spans(m[: off + 1], b):
                    for c, v in zip(rows, (did, th, x, y)):
                        c.append(v)
        held.clear()
        n_held = 0
        return _rows(pa, names, rows)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if group and row[0] != group[0][0]:
                held.append(group)
                n_held += sum(len(x[9]) for x in group)
                group = []
                if n_held >= BATCH:
                    yield done()
            if not group or row[1] != group[-1][1]:  # a repeated row of docs brings its segment again
                group.append(row)
    if group:
        held.append(group)
    yield done()


def _halves(batches):
    """The two halves of each segment's offsets: the bucket by the bytes that all strings of the half share, and the class by all bytes of its strings."""
    import pyarrow as pa
    import xxhash

    names = ["a", "s", "n", "did", "th", "b", "off", "lo", "hi", "seg"]
    name = xxhash.xxh3_64_intdigest
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for a, s, n, did, th, b, off, lo, hi, seg in zip(*[c.to_pylist() for c in batch.columns]):
            middle = (lo + hi) // 2
            for low, high in ((lo, middle), (middle + 1, hi)):
                least, most = max(low, off + LENGTH - len(seg)), min(high, off)
                if least <= most:
                    bucket = name(seg[off - low : off - high + LENGTH], (a * 1_000_003 + low * 1_000 + high) & (1 << 64) - 1)
                    body = seg[off - most : off - least + LENGTH]
                    for c, v in zip(rows, (signed(bucket), signed(name(body, least * 1_000 + most)), n, did, th, b + off - most, most, low, high, body)):
                        c.append(v)
            if len(rows[0]) >= 10_000:
                yield _rows(pa, names, rows)
                rows = [[] for _ in names]
        yield _rows(pa, names, rows)


def _split(large: DataFrame, run: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """(segments of buckets that a task can refine, spans found on the way) from the segments of larger buckets."""
    small, found = [], []
    spark = large.sparkSession
    while not large.isEmpty():
        level = scratch(spark, "level")
        # tables are written, so that joins have exchanges of their own and Spark can split what a frequent bucket brings
        halves = materialise(large.mapInArrow(_halves, SEGMENT), "halves", level)
        classes = halves.groupBy("a", "s").agg(F.sum("n").alias("m"), F.min(F.struct("did", "th", "b")).alias("first"))
        classes = materialise(classes, "classes", level)
        twice = halves.where("n = 1").join(classes.where("m > 1").select("a", "s"), ["a", "s"], "left_semi")
        found.append(materialise(twice.select("did", "th", "b", (F.col("b") + F.length("seg")).cast("int").alias("e")), "found", run))
        buckets = materialise(classes.groupBy("a").agg(F.count("*").alias("k"), F.min("m").alias("least")).where("k > 1 and least = 1").select("a", "k"), "buckets", level)
        live = halves.drop("n").join(classes.join(buckets, "a"), ["a", "s"]).where(F.struct("did", "th", "b") == F.col("first"))
        live = materialise(live.select("a", "s", F.col("m").alias("n"), "did", "th", "b", "off", "lo", "hi", "seg", "k"), "live", run)
        discard(spark, level)
        small.append(live.where(F.col("k") <= GROUP).drop("k"))
        large = live.where(F.col("k") > GROUP).drop("k")
    return small, found


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(did, th, b, e): bytes b to e of a text are covered by strings that also start elsewhere. keyed: did, th, text."""
    spark = keyed.sparkSession
    run = scratch(spark, "repeats")
    found = materialise(keyed.mapInArrow(_occurrences, "did bigint, th bigint, a bigint, s bigint, b int, e int, off int, n bigint"), "anchors", run)
    in_one_text = found.where("a is null").select("did", "th", "b", "e")
    # written, so that the join has an exchange of its own on each side and Spark can split what a frequent anchor brings
    twice = materialise(found.where("a is not null").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a"), "twice", run)
    found = materialise(found.join(twice, "a", "left_semi"), "repeated", run).select("did", "th", "a", "s", "b", "e", "off", "n")
    place = F.struct("did", "th", "b", "e", "off")
    classes = materialise(found.groupBy("a", "s").agg(F.sum("n").alias("n"), F.min(place).alias("at")), "segments", run)
    whole = found.join(classes.where("n > 1").select("a", "s"), ["a", "s"], "left_semi").select("did", "th", "b", "e").unionByName(in_one_text)

    differ = materialise(classes.groupBy("a").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("a", "k"), "differ", run)
    wanted = classes.join(differ, "a").select("a", "s", "n", "at.*")
    by_text = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("a", "s", "n", "b", "e", "off")).alias("wanted"))
    cut = keyed.join(by_text.hint("shuffle_hash"), ["did", "th"]).select("did", "th", "text", "wanted").mapInArrow(_cut, SEGMENT)
    cut = materialise(cut, "cut", run)
    many = differ.where(F.col("k") > GROUP).select("a")
    small, by_halves = _split(materialise(cut.join(many, "a", "left_semi").select(*SEGMENT_COLUMNS), "large", run), run)
    small = reduce(DataFrame.unionByName, small, cut.join(many, "a", "left_anti"))
    refined = small.repartition("a").sortWithinPartitions("a", "s").mapInArrow(_refined, SPAN)
    out = materialise(reduce(DataFrame.unionByName, by_halves, whole.unionByName(refined)), "spans")
    discard(spark, run)
    return out


def _removed(batches):
    import pyarrow as pa

    for batch in batches:
        ends = batch.column(2).to_pylist()
        n_bytes, n_removed, n_spans, shas, kept_texts = [], [], [], [], []
        for text, found in zip(cells(batch.column(1)), ends):
            kept, at, removed, k = [], 0, 0, 0
            for b, e in sorted((x["b"], x["e"]) for x in found or ()):
                if e <= at and k:
                    continue
                if k and b <= at:  # touches or overlaps the span before
                    removed += e - at
                else:
                    kept.append(text[at:b])
                    removed += e - b
                    k += 1
                at = e
            kept.append(text[at:])
            rest = b"".join(kept)
            n_bytes.append(len(text))
            n_removed.append(removed)
            n_spans.append(k)
            shas.append(hashlib.sha256(rest).hexdigest())
            if batch.num_columns > 3:
                kept_texts.append(rest.decode("utf-8", "replace"))
        columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if batch.num_columns > 3:
            columns.append(pa.array(kept_texts, pa.string()))
            names.append("text")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with_text: text, what is left, cut characters replaced) for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = repeated_spans(keyed).groupBy("did", "th").agg(F.collect_set(F.struct("b", "e")).alias("spans"))
    rows = keyed.join(found.hint("shuffle_hash"), ["did", "th"], "left")
    rows = rows.select(F.nullif("did", F.lit(-(2**63))).alias("doc_id"), "text", "spans", *([F.lit(1)] if with_text else []))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text string" * with_text
    return rows.mapInArrow(_removed, schema)


QUERIES = {"op5_suffix_dedup": lambda spark, sf_dir: remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=True)}
ORACLES: dict[str, str] = {}
