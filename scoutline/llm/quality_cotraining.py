"""A quality classifier by co-training on two views of a document.

The content view sees the text as frequencies of pairs of byte classes and a few ratios of its words; the
metadata view sees what is known of the page without reading its words: source, host, language, length, and layout
(lines, how they end, how far they repeat and how far the page can be compressed). Each view has a logistic
classifier. In every round each labels the unlabelled documents of a pool that it is surest of, in the proportion of
the known classes, and hands them to the other as training data. A part of the labelled rows is held back; on it each
view's scores are calibrated (Platt) and the two calibrated views combined. The combined classifier then scores all
documents.

The pool is a share of the table (POOL_SHARE, by hash of doc_id) and grows with it. Each round scores it on the
executors and picks the surest with a top-n; only the picked documents' vectors come to the driver, at most
2 * PER_ROUND a round. Of labelled rows at most LABELLED are learned from, the first by hash. Scoring covers every
document and its whole text.

Cases: null and empty texts have the features of an empty text; null metadata is a value of its own; texts
of any length are taken whole; labels of unknown documents and null labels are not used; a document with labels
that differ has the least; with labels of one class only, or none, every score is that class's share (0.5 with none);
repeated rows each get a row; an empty table gives none; columns that are missing count as null, others are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm.common import cells, materialise

#: Labelled rows that training sees, and the share of the table in which unlabelled ones are sought.
LABELLED, POOL_SHARE = 2_000, 0.2
#: Of the labelled rows so many are held back for calibration (one in HELD).
HELD = 3
ROUNDS, PER_ROUND, SURE = 5, 150, 0.9
SEED = 23
CLASSES, RATIOS, META = 40, 6, 512


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for i, b in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
        table[b] = 1 + i // 3  # nine groups of letters
    for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[b] = 10
    for b in b"0123456789":
        table[b] = 11
    for i, b in enumerate(b" \n.,!?#*$%&|<>-_/:;'\"()@="):
        table[b] = 12 + i
    table[0x80:0xC0] = 38
    table[0xC0:] = 39
    return table


_CLASS = _classes()


def content(text: bytes) -> np.ndarray:
    """Frequencies of pairs of byte classes (square roots) and ratios."""
    out = np.zeros(CLASSES * CLASSES + RATIOS, np.float32)
    if text:
        c = _CLASS[np.frombuffer(text, np.uint8)].astype(np.int32)
        pairs = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(c) - 1))
        one = np.bincount(c, minlength=CLASSES) / len(c)
        words = text.split()
        out[-RATIOS:] = (len(set(words)) / max(1, len(words)), min(1.0, len(words) / 200), one[10] * 4, one[18:26].sum() * 4, one[16:18].sum() * 4, min(4.0, len(text) / max(1, len(words)) / 8))
    return out


def metadata(source, host, lang, n_chars, text: bytes) -> np.ndarray:
    """Hashed values of the fields and of the layout, in steps."""
    out = np.zeros(META, np.float32)
    n = len(text) if n_chars is None else max(0, int(n_chars))
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    ended = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in full)
    tenths = lambda x: int(10 * x + 0.5)
    packed = tenths(2 * min(0.5, len(zlib.compress(text, 1)) / max(1, len(text))))
    values = [
        f"source {source}", f"host {host}", f"lang {lang}", f"size {n.bit_length()}", f"lines {len(lines).bit_length()}", f"line {(n // len(lines)).bit_length()}",
        f"ended {tenths(ended / max(1, len(full)))}", f"repeated {tenths(1 - len(set(full)) / max(1, len(full)))}", f"packed {packed}", f"size {n.bit_length()} packed {packed}",
    ]
    for v in values:
        out[zlib.crc32(v.encode()) % META] += 1
    return out


class Logistic:
    """Logistic regression with a quadratic penalty, by Adam over all rows."""

    def __init__(self, width: int) -> None:
        self.w, self.b = np.zeros(width, np.float32), 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 100, rate: float = 0.1, penalty: float = 1e-4, positive: bool = False) -> Logistic:
        """Goes on from what it knows. positive: no weight under zero, so a view that says nothing says nothing."""
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)  # both classes count alike
        w, b = self.w, self.b
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, steps + 1):
            d = ((1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))) - y) * weight
            g, gb = x.T @ d + penalty * w, float(d.sum())
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w = np.maximum(w, 0) if positive else w
            b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
        self.w, self.b = w.astype(np.float32), float(b)
        return self


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class CoTrained:
    """The two views' classifiers and how their scores are calibrated and combined.

    surest(models, share, known) gives, for each view, the vectors of both views and the labels of the documents that it is surest of.
    """

    def __init__(self, views: list[np.ndarray], y: np.ndarray, surest=None, rounds: int = ROUNDS) -> None:
        self.constant = None
        if len(y) < 4 or len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        held = np.arange(len(y)) % HELD == 0
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held = np.zeros(len(y), bool)  # too few to hold any back
        x, labels = [v[~held] for v in views], [y[~held]] * 2
        self.given, share = [0, 0], float(y.mean())
        self.models = [Logistic(v.shape[1]) for v in views]
        handed: list[set[int]] = [set(), set()]
        for round_ in range(rounds + 1):
            for k, model in enumerate(self.models):
                model.fit(x[k], labels[k], steps=40 if round_ else 100)
            if round_ == rounds or surest is None:
                break
            for k, picked in enumerate(surest(self.models, share, handed)):  # what view k is sure of goes to the other
                other = 1 - k
                handed[other] |= {i for i, _, _ in picked}
                self.given[other] += len(picked)
                if picked:
                    x[other] = np.concatenate([x[other], np.stack([v[other] for _, v, _ in picked])])
                    labels[other] = np.concatenate([labels[other], [label for _, _, label in picked]])
        base = held if held.any() else ~held
        z = [m.logit(v[base]) for m, v in zip(self.models, views)]
        self.scales = [self._scale(a) for a in z]
        self.platt = [Logistic(1).fit(a[:, None] / s, y[base], penalty=1e-3, positive=True) for a, s in zip(z, self.scales)]
        self.joint = Logistic(2).fit(self._calibrated(z), y[base], penalty=1e-2, positive=True)

    @staticmethod
    def _scale(z: np.ndarray) -> float:
        return float(np.abs(z).mean()) or 1.0

    def _calibrated(self, z: list[np.ndarray]) -> np.ndarray:
        return np.clip(np.stack([p.logit(a[:, None] / s) for p, a, s in zip(self.platt, z, self.scales)], axis=1), -10, 10)

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(views[0])
        if self.constant is not None:
            return tuple(np.full(n, self.constant) for _ in range(3))
        c = self._calibrated([m.logit(x) for m, x in zip(self.models, views)])
        return sigmoid(c[:, 0]), sigmoid(c[:, 1]), sigmoid(self.joint.logit(c))


FIELDS = ("source", "host", "lang", "n_chars")


def _fields(docs: DataFrame) -> DataFrame:
    """doc_id, the metadata (host also from url; a missing column is null) and text."""
    have = {c.lower() for c in docs.columns}
    one = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    host = one("host", "string") if "host" in have or "url" not in have else F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), one("source", "string"), host, one("lang", "string"), one("n_chars", "long"), F.col("text"))


def _views(batch, first: int) -> list[np.ndarray]:
    """batch has the metadata and text from the column first on."""
    fields = [batch.column(first + k).to_pylist() for k in range(len(FIELDS))]
    texts = cells(batch.column(first + len(FIELDS)))
    return [np.stack([content(t) for t in texts]), np.stack([metadata(*row) for row in zip(*fields, texts)])]


def _vectors(fields: DataFrame, ids: list[int]) -> dict[int, list[np.ndarray]]:
    """The two views of a bounded list of documents, on the driver; of rows with one doc_id any."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                a, b = _views(part, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(np.float16).tobytes() for x in a]), pa.array([x.astype(np.float16).tobytes() for x in b])], names=["doc_id", "a", "b"])

    if not ids:
        return {}
    wanted = F.broadcast(fields.sparkSession.createDataFrame([(i,) for i in ids], "doc_id bigint"))  # at most LABELLED or 4 * PER_ROUND rows
    rows = fields.join(wanted, "doc_id").mapInArrow(run, "doc_id bigint, a binary, b binary").toLocalIterator()
    found: dict[int, tuple] = {}
    for r in rows:  # of repeated ids the same one in every run
        found[r["doc_id"]] = min(found.get(r["doc_id"], (r["a"], r["b"])), (r["a"], r["b"]))
    return {i: [np.frombuffer(v, np.float16).astype(np.float32) for v in ab] for i, ab in found.items()}


def _surest(fields: DataFrame, known: DataFrame, pool_share: float):
    """For CoTrained: scores the pool by both views on the executors and picks the surest documents of each class."""
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(1 << 20))
    pool = fields.where("doc_id is not null").where(hashed < int(pool_share * (1 << 20)))

    def pick(models, share: float, handed: list[set[int]]) -> list[list]:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for k in range(0, batch.num_rows, 100):
                    part = batch.slice(k, 100)
                    p = [sigmoid(m.logit(x)) for m, x in zip(models, _views(part, 1))]
                    sure = [np.maximum(x, 1 - x) >= SURE for x in p]
                    some = np.flatnonzero(sure[0] | sure[1])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), *(pa.array(x[some].astype(np.float64)) for x in p)], names=["doc_id", "p0", "p1"])

        scored = pool.mapInArrow(run, "doc_id bigint, p0 double, p1 double").groupBy("doc_id").agg(F.min("p0").alias("p0"), F.min("p1").alias("p1"))
        scored = materialise(scored.join(known, "doc_id", "left_anti"), "scored")
        picked: list[list[tuple[int, int]]] = []
        for k in range(2):
            p, free = F.col(f"p{k}"), scored.where(~F.col("doc_id").isin(*handed[1 - k])) if handed[1 - k] else scored
            one = []
            for label, order, n in ((1, F.desc(f"p{k}"), share), (0, F.asc(f"p{k}"), 1 - share)):
                top = free.where(p >= SURE if label else p <= 1 - SURE).orderBy(order, "doc_id").limit(max(1, round(PER_ROUND * n)))
                one += [(r["doc_id"], label) for r in top.select("doc_id").collect()]
            picked.append(one)
        vectors = _vectors(fields, sorted({i for one in picked for i, _ in one}))
        return [[(i, vectors[i], float(label)) for i, label in one] for one in picked]

    return pick


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool_share: float = POOL_SHARE) -> CoTrained:
    fields = _fields(docs)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("y"))
    known = materialise(known, "known")
    some = known.join(fields.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(labelled).collect()
    found = _vectors(fields, [r["doc_id"] for r in some])
    if not found:
        return CoTrained([np.zeros((0, 1))] * 2, np.zeros(0))
    views = [np.stack([found[r["doc_id"]][k] for r in some]) for k in range(2)]
    return CoTrained(views, np.array([float(r["y"] > 0) for r in some]), _surest(fields, known.select("doc_id"), pool_share))


def report(docs: DataFrame, labels: DataFrame, folds: int = 4) -> DataFrame:
    """One row (n, content, metadata, both: shares scored on the right side) over labelled rows with crc32(doc_id) mod folds = 0,
    which the model of this report learns nothing from."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0
    model = learn(docs, labels.where(~held))
    tested = labels.where(held).where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = score(docs, model).join(tested, "doc_id")
    right = lambda c: F.round(F.avg(((F.col(c) >= 0.5) == (F.col("quality") > 0)).cast("int")), 4)
    return rows.agg(F.count("*").alias("n"), right("content_score").alias("content"), right("metadata_score").alias("metadata"), right("quality_score").alias("both"))


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, content_score, metadata_score, quality_score, kept for each row of docs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                a, b, both = model.score(_views(part, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(both, pa.float64()), pa.array(both >= 0.5, pa.bool_())], names=["doc_id", "content_score", "metadata_score", "quality_score", "kept"])

    return _fields(docs).mapInArrow(run, "doc_id bigint, content_score double, metadata_score double, quality_score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


QUERIES = {"op6_quality_cotraining": lambda spark, sf_dir: classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))}
ORACLES: dict[str, str] = {}
