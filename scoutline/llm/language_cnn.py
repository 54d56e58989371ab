"""Language identification by a byte convolutional network, trained here in numpy.

Bytes of the lower-cased text become small vectors; filters of several widths slide over windows of fixed
length, their strongest answers (max pooling) go through a softmax. The network learns from a bounded,
hash-ordered sample of labelled rows (PER_LANGUAGE of each label, WINDOWS windows of each, some cut short so
that short texts are known too); every window of every text is then scored, in batches, and a text's
probabilities are the mean over its windows, weighed by their bytes.

Only text and the labels of rows with crc32(doc_id) mod 4 <> 2 are used in training; predictions see the text.

Cases: a null text or one without a letter is `und` with score 0; texts of any length are taken whole, in
windows; a null doc_id is neither held out nor learned from; repeated rows each get a row; without any label
everything is `und`; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scoutline.llm.common import materialise

#: Bytes of a window, of a byte's vector, widths of the filters and filters of each width.
WINDOW, DEPTH, WIDTHS, FILTERS = 256, 8, (3, 4, 5), 16
#: The sample: rows of each language and windows of each row.
PER_LANGUAGE, WINDOWS = 400, 4
#: Ranges of hashes that a language's rows are counted in before any are ranked.
RANGES = 4_096
EPOCHS, BATCH, RATE, SEED = 8, 64, 4e-3, 11
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]").search
_SPAN = max(WIDTHS)


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text as rows of WINDOW bytes, the last filled with zeros, and the bytes in each row."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    n = -(-len(data) // WINDOW)
    rows = np.zeros(n * WINDOW, np.uint8)
    rows[: len(data)] = data
    filled = np.full(n, WINDOW)
    if n:
        filled[-1] = len(data) - (n - 1) * WINDOW
    return rows.reshape(n, WINDOW), filled


class Network:
    def __init__(self, labels: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        k = FILTERS * len(WIDTHS)
        self.labels = labels
        self.vectors = rng.normal(0, 0.3, (256, DEPTH)).astype(np.float32)
        self.vectors[0] = 0
        self.filters = rng.normal(0, 0.2, (_SPAN * DEPTH, k)).astype(np.float32)
        self.mask = np.zeros_like(self.filters)  # narrower filters see only their first bytes
        for i, width in enumerate(WIDTHS):
            self.mask[: width * DEPTH, i * FILTERS : (i + 1) * FILTERS] = 1
        self.filters *= self.mask
        self.bias = np.zeros(k, np.float32)
        self.out = rng.normal(0, 0.2, (k, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _slid(self, rows: np.ndarray) -> np.ndarray:
        x = self.vectors[np.pad(rows, ((0, 0), (0, _SPAN - 1)))]
        n, w = rows.shape
        view = np.lib.stride_tricks.as_strided(x, (n, w, _SPAN * DEPTH), (x.strides[0], x.strides[1], x.strides[2]))
        return np.ascontiguousarray(view).reshape(n * w, _SPAN * DEPTH)

    def forward(self, rows: np.ndarray):
        slid = self._slid(rows)
        answers = (slid @ self.filters).reshape(len(rows), rows.shape[1], -1)
        pooled = answers.max(axis=1) + self.bias
        hidden = np.maximum(pooled, 0)
        z = hidden @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return slid, answers, pooled, hidden, p / p.sum(axis=1, keepdims=True)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(rows[k : k + BATCH])[-1] for k in range(0, len(rows), BATCH)]) if len(rows) else np.zeros((0, len(self.labels)), np.float32)

    def train(self, rows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam on cross-entropy; through the pooling only the strongest place of a filter learns."""
        rng = np.random.default_rng(seed)
        names = ["vectors", "filters", "bias", "out", "out_bias"]
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                at = order[k : k + BATCH]
                x, y = rows[at], labels[at]
                slid, answers, pooled, hidden, p = self.forward(x)
                n = len(x)
                d = p.copy()
                d[np.arange(n), y] -= 1
                d /= n
                g = {"out": hidden.T @ d, "out_bias": d.sum(axis=0)}
                dh = (d @ self.out.T) * (pooled > 0)
                g["bias"] = dh.sum(axis=0)
                best = answers.argmax(axis=1)  # n x k
                places = slid.reshape(n, x.shape[1], -1)[np.arange(n)[:, None], best]  # n x k x span*depth
                g["filters"] = np.einsum("nk,nkd->dk", dh, places) * self.mask
                back = np.einsum("nk,dk->nkd", dh, self.filters).reshape(-1, _SPAN, DEPTH)
                padded = np.pad(x, ((0, 0), (0, _SPAN - 1)))
                which = padded[np.arange(n)[:, None, None], best[:, :, None] + np.arange(_SPAN)].reshape(-1)
                dv = np.zeros_like(self.vectors)
                np.add.at(dv, which, back.reshape(-1, DEPTH))
                dv[0] = 0
                g["vectors"] = dv
                step += 1
                rate = RATE * (1 - step / (epochs * -(-len(order) // BATCH) + 1))
                for name in names:
                    first[name] = 0.9 * first[name] + 0.1 * g[name]
                    second[name] = 0.99 * second[name] + 0.01 * g[name] ** 2
                    a, b = first[name] / (1 - 0.9**step), second[name] / (1 - 0.99**step)
                    setattr(self, name, (getattr(self, name) - rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, doc_id, h) of the rows to learn from, the first of each language by hash. Rows are counted in ranges of
    hashes; only the range in which a language's sample ends, and those before it, are ranked."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    labelled = docs.where((rest != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = labelled.select("lang", "doc_id", F.xxhash64("doc_id", F.lit(SEED)).alias("h")).withColumn("range", F.shiftright("h", 64 - RANGES.bit_length() + 1))
    counts = ids.groupBy("lang", "range").agg(F.count("*").alias("n"))
    upto = counts.withColumn("before", F.sum("n").over(W.partitionBy("lang").orderBy("range")) - F.col("n"))
    wanted = materialise(upto.where(F.col("before") < per_language).select("lang", "range"), "ranges")
    first = ids.join(wanted, ["lang", "range"], "left_semi").distinct()
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id")))
    return materialise(ranked.where(F.col("rank") <= per_language).select("lang", "doc_id", "h"), "sample")


def _drawn(batches):
    """WINDOWS windows of each text, by hash from all of them, some cut short."""
    import pyarrow as pa

    for batch in batches:
        out: list[list] = [[], [], [], []]
        for lang, doc_id, h, text in zip(*[c.to_pylist() for c in batch.columns]):
            if not _LETTER(text):
                continue
            got, _ = windows(text)
            rng = np.random.default_rng([SEED, h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF])
            for k in rng.permutation(len(got))[:WINDOWS]:
                row = got[k].copy()
                if rng.random() < 0.4:
                    row[int(rng.integers(4, WINDOW)) :] = 0
                for c, v in zip(out, (lang, h, doc_id, row.tobytes())):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["lang", "h", "doc_id", "row"])


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """A network from docs (doc_id, text, lang), or None if nothing is labelled."""
    narrow = docs.select(F.col("lang").cast("string"), F.col("doc_id").cast("long"), "text")
    ids = sample(narrow, per_language)
    # texts meet a bounded table; what comes to the driver is PER_LANGUAGE x WINDOWS windows a language
    rows = narrow.join(ids, ["lang", "doc_id"]).select("lang", "doc_id", "h", "text").where("text is not null").mapInArrow(_drawn, "lang string, h bigint, doc_id bigint, row binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["h"], r["doc_id"], bytes(r["row"])))
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return None
    x = [np.frombuffer(r["row"], np.uint8) for r in rows]
    y = [labels.index(r["lang"]) for r in rows]
    net = Network(labels)
    if x:
        net.train(np.stack(x), np.array(y))
    return net


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, and lang unless a network is given)."""
    net = net or learn(docs)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = part.column(2).to_pylist()
                predicted, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                known = [i for i, t in enumerate(texts) if t and _LETTER(t)] if net is not None else []
                if known:
                    parts = [windows(texts[i]) for i in known]
                    p = net.probabilities(np.concatenate([w for w, _ in parts]))
                    at = 0
                    for i, (w, filled) in zip(known, parts):
                        mean = (p[at : at + len(w)] * filled[:, None]).sum(axis=0) / filled.sum()
                        at += len(w)
                        predicted[i], scores[i] = net.labels[int(mean.argmax())], float(min(1.0, mean.max()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


QUERIES = {"op4_language_cnn": lambda spark, sf_dir: identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
ORACLES: dict[str, str] = {}
