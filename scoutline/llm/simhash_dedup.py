"""SimHash near-duplicates by a generalised pigeonhole search.

A fingerprint has 64 bits; two link if at most three differ. The bits are dealt into m parts, correlated
bits together, so that the parts are as independent as they can be. Part i gets a threshold t_i >= -1 with
sum(t_i + 1) = 4: of two fingerprints that differ in at most 3 bits, some part differs in at most t_i.
Dynamic programming picks the thresholds (and m) that cost least, from the chance that two fingerprints
agree in a part, which comes from the bits' frequencies and correlations over all fingerprints. A part with
t = 0 sends a fingerprint once, under the part's bits; with t = 1 or 2 also under each of them with one bit
flipped, since two such neighbourhoods meet. Whatever meets under a key is verified by its full distance.

A bucket of more than BLOCK fingerprints is split by the same principle: its members differ in at most 3 of the bits
outside the part, so of four groups of those bits they agree in one; they are sent anew under each group's bits, and
again where a bucket stays large. Inside a bucket no pairs are sent on, only a spanning forest of its links. What is
over BLOCK after SPLITS rounds is cut into blocks, and each two blocks meet in a task of their own, so no bucket lands
in one task whole. Equal fingerprints are one node from the start; components follow by alternating stars.

Cases: null, empty and wordless texts have fingerprint zero, which links like any other; texts with one or
two words are one shingle; texts of any length are taken whole; repeated rows each get a row; a null doc_id
counts for no component_id but its fingerprint links and bridges, and it gets the id of its component (null if no row
there has one); an empty table gives no rows; other columns are ignored. keep_one() keeps one row of each component: the
smallest doc_id, of rows that share it the one with the least hash of its text, of rows that repeat both the one whose
columns are written least; a component without any doc_id keeps the row with the least hash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm.common import cells, components, materialise, one_each, scratch

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of a bucket that one task compares, and rounds in which larger buckets are split by further bits.
BLOCK, SPLITS = 8_192, 3
#: Buckets up to this size are compared by shifting the sorted rows.
SHORT = 24
#: Costs of a row sent and of a pair verified, in the same unit.
ROW_COST, PAIR_COST = 300.0, 1.0


def fingerprint(text: bytes) -> int:
    """The SimHash of a text."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and exactly the six white-space characters
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        h = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
        digest = xxhash.xxh64_intdigest
        h = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
    bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), and more bigint columns of docs as they are."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            prints = np.array([fingerprint(t) for t in cells(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), *(batch.column(2 + k) for k in range(len(more)))], names=["doc_id", "fp", *more])

    return docs.select(F.col("doc_id").cast("long"), F.col("text"), *more).mapInArrow(run, "doc_id bigint, fp bigint" + "".join(f", {c} bigint" for c in more))


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have each two bits set (64 x 64): one small row a task comes back."""

    def run(batches):
        import pyarrow as pa

        n, total = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(x), 50_000):
                bits = np.unpackbits(x[k : k + 50_000].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()])], names=["n", "both"])

    # the rows are summed cell by cell before they come to the driver: 4096 numbers
    rows = fps.select("fp").mapInArrow(run, "n bigint, both array<double>")
    cells_ = rows.select("n", F.posexplode("both").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    both, n = np.zeros(BITS * BITS), 0
    for r in cells_:
        both[r["at"]], n = r["v"], r["n"]
    return n, both.reshape(BITS, BITS)


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal width: each is seeded with the free bit least like the others' and takes those most like its own."""
    free, parts = set(range(BITS)), []
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    for width in widths:
        taken = [b for p in parts for b in p]
        seed = min(free, key=lambda b: (corr[b, taken].sum() if taken else -corr[b].sum(), b))
        part = [seed]
        free.discard(seed)
        while len(part) < width:
            best = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def radius(threshold: int) -> int:
    """Flips that each side sends so that two keys within the threshold meet."""
    return (threshold + 1) // 2


def probes(width: int, threshold: int) -> int:
    return 0 if threshold < 0 else 1 + (width if radius(threshold) >= 1 else 0) + (width * (width - 1) // 2 if radius(threshold) >= 2 else 0)


def allocate(n: int, parts: list[list[int]], agree: np.ndarray, corr: np.ndarray) -> tuple[float, list[int]]:
    """The thresholds with sum(t + 1) = DISTANCE + 1 that cost least, by dynamic programming over the parts."""
    costs = []
    for part in parts:
        # the chance that two fingerprints agree in all bits: independent bits, each lifted by its likeness to the one before
        p = 1.0
        for i, b in enumerate(part):
            lift = max((corr[b, c] for c in part[:i]), default=0.0)
            p *= agree[b] + (1 - agree[b]) * lift
        row = [0.0]  # t = -1
        for t in range(DISTANCE + 1):
            sent = probes(len(part), t)
            row.append(n * sent * ROW_COST + 0.5 * n * n * min(1.0, p * sent * sent) * PAIR_COST)
        costs.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, more in enumerate(row):  # k = t + 1
                if used + k <= DISTANCE + 1 and cost + more < after.get(used + k, (float("inf"),))[0]:
                    after[used + k] = (cost + more, [*chosen, k - 1])
        best = after
    return best[DISTANCE + 1]


def search_plan(n: int, both: np.ndarray) -> list[tuple[list[int], int]]:
    """The parts (their bits) and thresholds."""
    f = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(f * (1 - f), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(f, f)) / np.outer(spread, spread))
    corr = np.clip(corr, 0, 1)
    np.fill_diagonal(corr, 0)
    agree = f * f + (1 - f) * (1 - f)
    options = []
    for m in (2, 3, 4):
        parts = group_bits(corr, m)
        cost, thresholds = allocate(n, parts, agree, corr)
        options.append((cost, m, [(p, t) for p, t in zip(parts, thresholds) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


def _send(plan: list[tuple[list[int], int]]):
    """(part, key, fp, node) for each key under which a fingerprint is sent."""

    def run(batches):
        import pyarrow as pa

        masks = []
        for bits, t in plan:
            own = np.uint64(sum(1 << b for b in bits))
            flips = [0, *((1 << b) for b in bits if radius(t) >= 1), *((1 << a | 1 << b) for a, b in combinations(bits, 2) if radius(t) >= 2)]
            masks.append((own, np.array(flips, np.uint64)))
        for batch in batches:
            fp, node = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for k in range(0, len(fp), 5_000):
                x, v = fp[k : k + 5_000], node[k : k + 5_000]
                for part, (own, flips) in enumerate(masks):
                    keys = ((x & own)[:, None] ^ flips[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.repeat(x, len(flips)).view(np.int64)), pa.array(np.repeat(v, len(flips)))], names=["part", "key", "fp", "node"])

    return run


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints, breadth first over those not yet reached."""
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= DISTANCE
            if near.any():
                found = left[near].tolist()
                out.extend((at, x) for x in found)
                queue.extend(found)
                left = left[~near]
    return out


def _compare(batches):
    """Links (a, b) inside each bucket; rows come sorted by part, key, i, j. A bucket may run over several batches."""
    import pyarrow as pa

    held: list[tuple] = []

    def links(bucket: np.ndarray, fp: np.ndarray, node: np.ndarray):
        a, b = [], []
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        sizes = np.diff(np.append(starts, len(bucket)))
        small = np.repeat(sizes <= SHORT, sizes)
        for shift in range(1, min(SHORT, int(sizes.max(initial=0)))):
            near = small[:-shift] & (bucket[:-shift] == bucket[shift:])
            near &= np.bitwise_count(fp[:-shift] ^ fp[shift:]) <= DISTANCE
            a.append(node[:-shift][near])
            b.append(node[shift:][near])
        for s, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
            pairs = _forest(fp[s : s + n])
            if pairs:
                x = np.array(pairs) + s
                a.append(node[x[:, 0]])
                b.append(node[x[:, 1]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        keep = a != b
        pairs = np.unique(np.stack([np.maximum(a, b)[keep], np.minimum(a, b)[keep]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def numbered(cols: list[np.ndarray]) -> np.ndarray:
        change = np.zeros(len(cols[0]), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        return np.cumsum(change)

    def joined():
        return [np.concatenate(c) for c in zip(*held)]

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(k).to_numpy() for k in range(6)))
        rows += batch.num_rows
        if rows < 100_000:
            continue
        cols = joined()
        bucket = numbered(cols[:4])
        cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
        if cut:
            yield links(bucket[:cut], cols[4][:cut].view(np.uint64), cols[5][:cut])
        held[:] = [tuple(c[cut:] for c in cols)]
        rows = len(bucket) - cut
    if held:
        cols = joined()
        yield links(numbered(cols[:4]), cols[4].view(np.uint64), cols[5])


def _split(batches):
    """(part, key, used, fp, node): a row for each quarter of the bits that its bucket has not used; the key is a name for bucket and bits."""
    import pyarrow as pa

    for batch in batches:
        part, key, used, fp, node = (batch.column(k).to_numpy() for k in range(5))
        key, used, fp = key.view(np.uint64), used.view(np.uint64), fp.view(np.uint64)
        for mask in np.unique(used):
            own = np.flatnonzero(used == mask)
            bits = [b for b in range(BITS) if not int(mask) >> b & 1]
            for j in range(DISTANCE + 1):
                quarter = np.uint64(sum(1 << b for b in bits[j :: DISTANCE + 1]))
                name = (key[own] * np.uint64(0x9E3779B97F4A7C15) ^ (fp[own] & quarter)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j)
                name ^= name >> np.uint64(31)
                columns = [part[own], name.view(np.int64), np.full(len(own), mask | quarter).view(np.int64), fp[own].view(np.int64), node[own]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "key", "used", "fp", "node"])


def _large(sent: DataFrame) -> DataFrame:
    return sent.groupBy("part", "key").count().where(F.col("count") > BLOCK).select("part", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) links that span every component of nodes (fp, node), fp distinct."""
    plan = search_plan(*bit_moments(nodes))
    masks = F.element_at(F.array(*[F.lit(sum(1 << b for b in bits) - (1 << 64 if 63 in bits else 0)).cast("long") for bits, _ in plan]), F.col("part") + 1)
    sent = nodes.select("fp", "node").mapInArrow(_send(plan), "part int, key bigint, fp bigint, node bigint").select("part", "key", masks.alias("used"), "fp", "node")
    large, run = _large(sent), scratch(nodes.sparkSession, "buckets")
    for _ in range(SPLITS):
        # written, so that the join has exchanges of its own and Spark can split what a large bucket brings
        large = materialise(large, "large", run)
        if large.isEmpty():
            break
        key = ["part", "key"]
        again = materialise(sent.join(large, key, "left_semi").select("part", "key", "used", "fp", "node").mapInArrow(_split, "part int, key bigint, used bigint, fp bigint, node bigint"), "again", run)
        sent = materialise(sent.join(large, key, "left_anti").select(again.columns).unionByName(again), "sent", run)
        large = _large(sent)
    dealt = sent.drop("used").join(large, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    # a row goes to the task of its block with each block
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    dealt = dealt.withColumn("own", own).select("part", "key", "fp", "node", F.explode(tasks).alias("t")).select("part", "key", "t.i", "t.j", "fp", "node")
    dealt = dealt.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")
    return dealt.mapInArrow(_compare, "a bigint, b bigint")


def _components(prints: DataFrame) -> DataFrame:
    """(fp, component_id, component): for each fingerprint the smallest doc_id of its component, and the component's name."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    linked = components(links(nodes.select("fp", F.col("fp").alias("node")))).join(nodes, F.col("node") == F.col("fp")).select("fp", "component", "low")
    linked = materialise(linked, "linked")
    ids = linked.groupBy("component").agg(F.min("low").alias("least"))
    linked = linked.join(ids, "component").select("fp", "component", "least")
    named = nodes.join(linked, "fp", "left")
    return named.select("fp", F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"), F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs (doc_id, text)."""
    prints = materialise(fingerprints(docs), "prints")
    out = prints.join(_components(prints), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with docs' columns."""
    text = F.coalesce("text", F.lit(""))
    own = [F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]
    prints = materialise(fingerprints(docs.select("doc_id", "text", *own[1:]), "t1", "t2"), "prints")
    rows = prints.groupBy("fp", "doc_id", "t1", "t2").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "t1", "t2", "n")).alias("stay")
    stay = materialise(rows.join(_components(prints), "fp").groupBy("component").agg(least).select("stay.*"), "stay")
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")

    def kept(wanted: DataFrame) -> DataFrame:
        left, right = docs.select(*own, held), wanted.select(F.col("id").alias("of"), F.col("t1").alias("u1"), F.col("t2").alias("u2")).hint("shuffle_hash")
        return left.join(right, F.col("id").eqNullSafe(F.col("of")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left_semi")

    once, several = kept(stay.where("n = 1")).select("row.*"), stay.where("n > 1")
    return once if several.isEmpty() else once.unionByName(one_each(kept(several), ["id", "t1", "t2"]))


QUERIES = {"op9_simhash": lambda spark, sf_dir: near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
ORACLES: dict[str, str] = {}
