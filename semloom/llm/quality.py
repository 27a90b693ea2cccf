"""Quality classifier: supervised subword embeddings.

A text's features are its words, its pairs of successive words and the character n-grams of its words (a space before and
after a word is part of it, so that it marks the word's ends), each hashed to a row of one embedding table. A pair's hash is that of the difference of its words' hashes, so
that all repeats of a word on the spot share one learned vector, whatever the word. The mean of a text's vectors goes through a linear layer and a softmax; table and layer are
learned together by stochastic gradient descent in numpy on a bounded, documented sample of the labelled rows.
The output is linear in the mean, so for scoring each feature's vector is folded into its class scores once, and a text
of any length costs one lookup a feature and class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm.common import mix, pick, positional, prefix_sums, row_sums, span_scale, span_sums, table, text_bytes, text_slices, words


def features(raw: np.ndarray, offsets: np.ndarray, bits: int, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed features, their rows) for words, pairs of words and then each n-gram order; rows ascend. No n-gram crosses
    a row."""
    shift = np.uint64(64 - bits)
    start, end, row = words(raw, offsets)
    prefix = prefix_sums(raw)
    h = mix(span_sums(prefix, start, end) + (end - start).astype(np.uint64))
    yield (h >> shift).astype(np.int64), row
    if len(h) > 1:
        same = row[1:] == row[:-1]
        yield (mix(h[1:][same] - h[:-1][same] + np.uint64(1)) >> shift).astype(np.int64), row[1:][same]
    char = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]  # first byte of each character
    first = np.searchsorted(char, offsets)
    n = len(char) - 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    # the last character that an n-gram from each character on may have: the next space, or the text's last one
    stop = np.minimum.accumulate(np.where(raw[char[:-1]] <= 32, np.arange(n), n)[::-1])[::-1]
    stop = np.minimum(np.r_[stop[1:], n], first[1:][row] - 1)
    size = stop - np.arange(n)
    size, row = size.astype(np.int32), row.astype(np.int32)
    sums, scale = prefix[char], span_scale(char)
    for order in orders:
        keep = size[: max(n - order + 1, 0)] >= order - 1
        h = ((sums[order:] - sums[: len(keep)]) * scale[: len(keep)])[keep]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93 + 2 * order)
        yield (h >> shift).view(np.int64), row[: len(keep)][keep]


#: A text is kept if it is of high quality with more than this probability.
THRESHOLD = 0.3


class Model:
    """classes, table [features, dim], layer [dim, classes] and bias; scores = table @ layer, for inference."""

    def __init__(self, classes: list, bits: int = 15, dim: int = 16, orders: tuple[int, ...] = (3, 4, 5), seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes, self.bits, self.orders = classes, bits, orders
        self.table = ((rng.random((1 << bits, dim), np.float32) - 0.5) / dim).astype(np.float32)
        self.layer = np.zeros((dim, len(classes)), np.float32)
        self.bias = np.zeros(len(classes), np.float32)
        self.scores = np.zeros((1 << bits, len(classes)), np.float32)

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Share of each feature in each row's features."""
        n = len(offsets) - 1
        at = [(row << self.bits) + f for f, row in features(raw, offsets, self.bits, self.orders)]
        out = np.bincount(np.concatenate(at), minlength=n << self.bits).astype(np.float32).reshape(n, -1)
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1)

    def fit(self, texts: list[str], labels: list, epochs: int = 3, rate: float = 4.0, batch: int = 32, seed: int = 0) -> Model:
        if not texts:
            return self
        rng = np.random.default_rng(seed)
        y = np.array([self.classes.index(v) for v in labels])
        weight = (len(y) / np.maximum(1, len(self.classes) * np.bincount(y, minlength=len(self.classes)))) ** 0.5
        steps, done = epochs * -(-len(texts) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                array = pa.array([texts[i] for i in rows], pa.string())
                x = self.counts(*text_bytes(array))
                lr = rate * (1 - done / steps)
                mean = x @ self.table
                p = _softmax(mean @ self.layer + self.bias)
                p[np.arange(len(rows)), y[rows]] -= 1
                p *= weight[y[rows], None].astype(np.float32)
                back = p @ self.layer.T
                step = mean.T @ p
                self.layer -= lr * step / max(1.0, float(np.linalg.norm(step)))
                self.bias -= lr / batch * p.sum(axis=0)
                self.table -= x.T @ (lr * back)
                done += 1
        self.scores = self.table @ self.layer
        return self

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class probabilities of each row, number of its features)."""
        n = len(offsets) - 1
        total, count = np.zeros((n, len(self.classes))), np.zeros(n, np.int64)
        scores = np.ascontiguousarray(self.scores.T, np.float64)
        for f, row in features(raw, offsets, self.bits, self.orders):
            for k in range(len(self.classes)):
                total[:, k] += row_sums(scores[k].take(f), row, n)
            count += np.bincount(row, minlength=n)
        return _softmax(total / np.maximum(count, 1)[:, None] + self.bias), count


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


RESULT = "probs array<double>, n_features bigint"
_ARROW = pa.struct([("probs", pa.list_(pa.float64())), ("n_features", pa.int64())])


def classify(df: DataFrame, model: Model, text_col: str = "text"):
    """A Column for df: struct<probs, n_features>, the softmax over model.classes of the text in text_col.

    Null and empty texts have n_features 0 and the model's bias alone as their scores."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for a in batches:
            parts = []
            for s in text_slices(pa.record_batch([a], ["t"]), "t"):
                p, count = m.predict(*text_bytes(s.column(0)))
                at = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
                parts.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(p.ravel())), pa.array(count)], fields=list(_ARROW)))
            yield pa.concat_arrays(parts) if parts else pa.array([], _ARROW)

    return run.asNondeterministic()(F.col(text_col))  # evaluated once, even if a filter uses it


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 2400, max_chars: int = 100_000, classes: tuple = (0, 1), **fit) -> Model:
    """Fit on at most max_train labelled texts of at most max_chars characters, chosen by a hash of the id, so that the
    driver's memory and time are bounded. Labels that are null or not in classes don't count, nor do null texts; of a
    repeated id one label (the largest) and one text count. Nothing to train on: uniform scores."""
    lab = pick(labels, i=id_col, y=label_col).where("i is not null and y is not null").where(F.col("y").isin(list(classes)))
    lab = lab.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(2 * max_train)
    d = pick(docs, i=id_col, x=text_col).where(F.length("x") <= max_chars)
    # the labels' side holds 2 * max_train rows of 12 bytes at most
    rows = d.join(F.broadcast(lab), "i").groupBy("i", "y").agg(F.min("x").alias("x")).orderBy(F.xxhash64("i"), "i").limit(max_train).collect()
    return Model(list(classes)).fit([r["x"] for r in rows], [r["y"] for r in rows], **fit)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, model: Model | None = None, **training) -> DataFrame:
    """(id, p_low, p_high, n_features, keep) of every row of docs. keep: p_high is above the threshold (a tie with it goes),
    which is below one half so that a text is only dropped when the model is fairly sure. Null and empty texts: probabilities null,
    n_features 0, keep false. Repeated rows give repeated results, an empty table an empty one; a null id stays null."""
    model = model or train(docs, labels, id_col, text_col, **training)
    d = pick(docs, i=id_col, x=text_col)
    p = lambda k: F.when(F.col("r.n_features") > 0, F.col("r.probs")[k])
    out = d.select("i", classify(d, model, "x").alias("r")).select("i", p(0).alias("p_low"), p(1).alias("p_high"), "r.n_features")
    return out.select(F.col("i").alias(id_col), "p_low", "p_high", "n_features", F.coalesce(F.col("p_high") > threshold, F.lit(False)).alias("keep"))


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the model doesn't take for low quality, with all their columns. Null and empty
    texts go; repeated rows and rows with a null id are judged like others; an empty table stays empty."""
    model = train(docs, table(spark, sf_dir, "labels"))
    d, at = positional(docs)
    r = F.col("_q_")
    return d.withColumn("_q_", classify(d, model, at["text"])).where((r.n_features > 0) & (r.probs[1] > THRESHOLD)).drop("_q_").toDF(*docs.columns)
