"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of up to PASSAGE words. Each passage is encoded from its own
surface statistics (classes of bytes, lengths and repetition of words); a gated attention layer
weighs the encoded passages, and the document's score comes from the weighted sum. Encoder,
attention and output are learned together from document labels alone.

The model is fitted on a bounded sample of labelled rows: SAMPLE documents at most, those with the
smallest hash of their id, none that is held out and none of more than LONGEST passages (64,000
words), so that the driver is sent a bounded number of passages. Scoring reads every passage of
every text.

Nulls count as empty texts; a text without words is one passage of zeros and is scored; very long
texts are many passages; equal rows get equal scores; rows without an id are scored and never
learned from; several labels of one document are averaged; without any usable label every score is
the prior 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import owners, slices, texts_of, words_of
from .scratch import bounded_batches

PASSAGE, SAMPLE, LONGEST, THRESHOLD = 64, 5000, 1000, 0.3
HIDDEN, GATE, EPOCHS = 16, 8, 250

#: Disjoint classes of bytes whose shares in a passage are features; other bytes count as none.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b".", b",;:", b"!?", b"|\t", b"#$%&*", b"()[]{}<>=+-/\\_^~`", b"'\"", b"@", bytes(range(0x80, 0xA0)), bytes(range(0xA0, 256))]
_CLASS = np.zeros(256, np.int64)
for _row, _bytes in enumerate(_CLASSES, 1):
    _CLASS[list(_bytes)] = _row
FEATURES = len(_CLASSES) + 8


def _distinct(group: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes (of 32 bits) in each of n groups."""
    keys = np.sort((group.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(32)).astype(np.int64), minlength=n)


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and offsets of the documents' passages (one each at least)."""
    starts, ends, hashes, words = words_of(data, offsets)
    n_words = np.diff(words)
    n = np.maximum(1, -(-n_words // PASSAGE))
    bags = np.concatenate([[0], np.cumsum(n)])
    doc = owners(bags)
    first = words[:-1][doc] + (np.arange(bags[-1]) - bags[:-1][doc]) * PASSAGE
    last = np.minimum(first + PASSAGE, words[1:][doc])
    size = last - first
    has = size > 0
    out = np.zeros((len(doc), FEATURES), np.float32)
    if not has.any():
        return out, bags
    # bytes of a passage: from its first word to the next passage's, or to the document's end
    begin = np.where(has, starts[np.minimum(first, len(starts) - 1)], 0)
    stop = np.where(has, np.where(last < words[1:][doc], starts[np.minimum(last, len(starts) - 1)], offsets[1:][doc]), 0)
    length = np.maximum(1, stop - begin)
    width = len(_CLASSES) + 1
    inside = np.repeat(np.arange(len(doc)) * width, stop - begin)
    at = np.arange(len(inside)) + np.repeat(begin - (np.cumsum(stop - begin) - (stop - begin)), stop - begin)
    counts = np.bincount(inside + _CLASS[data[at]], minlength=len(doc) * width).reshape(-1, width)
    out[:, : width - 1] = counts[:, 1:] / length[:, None]
    sizes = ends - starts

    def mean(values):
        sums = np.concatenate([[0.0], np.cumsum(values)])
        return (sums[last] - sums[first]) / np.maximum(1, size)

    k = len(_CLASSES)
    out[:, k] = mean(sizes) / 10
    out[:, k + 1] = mean(sizes <= 2)
    out[:, k + 2] = mean(sizes >= 16)
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    same[words[:-1][n_words > 0]] = False
    out[:, k + 3] = mean(same)
    out[:, k + 4] = _distinct(np.repeat(np.arange(len(doc)), size), hashes, len(doc)) / np.maximum(1, size)
    out[:, k + 5] = (_distinct(owners(words), hashes, len(n_words)) / np.maximum(1, n_words))[doc]
    out[:, k + 6] = np.log1p(n_words)[doc] / 8
    out[:, k + 7] = size / PASSAGE
    return out, bags


class AttentionMIL:
    """Gated attention over encoded passages; weights in `w`."""

    def __init__(self, mean, scale, w):
        self.mean, self.scale, self.w = mean, scale, w

    @classmethod
    def fitted(cls, x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> AttentionMIL:
        """Full-batch Adam on the documents' log loss."""
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
        w = {
            "encode": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "encode0": np.zeros(HIDDEN),
            "value": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "attend": rng.normal(0, GATE**-0.5, GATE), "out": rng.normal(0, HIDDEN**-0.5, HIDDEN), "out0": np.zeros(1),
        }
        model = cls(mean, scale, w)
        m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
        z = ((x - mean) / scale).astype(np.float32)
        w |= {k: a.astype(np.float32) for k, a in w.items()}
        y = y.astype(np.float32)
        for t in range(1, epochs + 1):
            for k, g in model._gradient(z, bags, y).items():
                g = g + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return model

    def _forward(self, z, bags):
        w, at, doc = self.w, bags[:-1], owners(bags)
        h = np.tanh(z @ w["encode"] + w["encode0"])
        value, gate = np.tanh(h @ w["value"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        raw = (value * gate) @ w["attend"]
        e = np.exp(raw - np.maximum.reduceat(raw, at)[doc])
        a = e / np.add.reduceat(e, at)[doc]
        bag = np.add.reduceat(a[:, None] * h, at, axis=0)
        return h, value, gate, a, bag, 1 / (1 + np.exp(-np.clip(bag @ w["out"] + w["out0"], -30, 30)))

    def _gradient(self, z, bags, y):
        w, doc = self.w, owners(bags)
        h, value, gate, a, bag, p = self._forward(z, bags)
        d = (p - y) / len(y)
        d_bag = d[:, None] * w["out"]
        d_a = (h * d_bag[doc]).sum(axis=1)
        d_raw = a * (d_a - np.add.reduceat(a * d_a, bags[:-1])[doc])
        d_value = d_raw[:, None] * w["attend"] * gate * (1 - value**2)
        d_gate = d_raw[:, None] * w["attend"] * value * gate * (1 - gate)
        d_h = (a[:, None] * d_bag[doc] + d_value @ w["value"].T + d_gate @ w["gate"].T) * (1 - h**2)
        return {"encode": z.T @ d_h, "encode0": d_h.sum(axis=0), "value": h.T @ d_value, "gate": h.T @ d_gate, "attend": (value * gate).T @ d_raw, "out": bag.T @ d, "out0": np.array([d.sum()])}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale, bags)[-1]


def _bags(batches):
    for batch in batches:
        data, offsets = texts_of(batch.column(1))
        for i, j in slices(offsets):
            yield batch.column(0).slice(i, j - i), *passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _two(docs, doc_id, text):
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def held_out(doc_id):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality", longest: int = LONGEST) -> AttentionMIL | None:
    """The model learned from at most `sample` labelled documents that aren't held out; those of more
    than `longest` passages are scored only."""
    named = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y")).dropna().filter(~held_out(F.col("doc_id")))
    chosen = named.groupBy("doc_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = {r["doc_id"]: r["y"] for r in chosen.collect()}

    def run(batches):
        for ids, x, bags in _bags(batches):
            short = np.diff(bags) <= longest
            rows = [x[a:b].ravel() for a, b, ok in zip(bags[:-1], bags[1:], short, strict=True) if ok]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(short)), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "x"])

    if not chosen:
        return None
    wanted = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")  # at most `sample` ids
    found = _two(docs, doc_id, text).join(F.broadcast(wanted), "doc_id", "left_semi").mapInArrow(run, "doc_id long, x array<float>")
    found = sorted({r["doc_id"]: r["x"] for r in found.collect()}.items())
    if not found:
        return None
    bags = np.concatenate([[0], np.cumsum([len(x) // FEATURES for _, x in found])])
    x = np.concatenate([np.array(x, np.float32) for _, x in found]).reshape(-1, FEATURES)
    return AttentionMIL.fitted(x, bags, np.array([chosen[i] for i, _ in found]))


def scored(docs: DataFrame, model: AttentionMIL | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        for ids, x, bags in _bags(batches):
            score = model.score(x, bags) if model else np.full(len(bags) - 1, 0.5)
            yield pa.RecordBatch.from_arrays([ids, pa.array(score.astype(np.float64))], ["doc_id", "score"])

    return _two(docs, doc_id, text).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted."""
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents that the classifier doesn't reject. The model learns from the raw
    documents' labels; scores are computed beside the rows, so that equal ids stay apart."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = docs.columns

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(names.index("text")))
            for i, j in slices(offsets):
                x, bags = passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                score = model.score(x, bags) if model else np.full(j - i, 0.5)
                yield batch.slice(i, j - i).filter(pa.array(score >= THRESHOLD))

    bounded_batches(spark)
    return docs.mapInArrow(run, docs.schema)
