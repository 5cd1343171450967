"""A quality classifier of supervised subword embeddings."""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, text_groups, word_hashes
from .text_model import code_points, gram_hashes

#: Training rows: about this many per label, and in all.
PER_LABEL, MOST_ROWS = 2500, 6000
#: Buckets for words and for character n-grams, and the length of a vector.
WORD_BUCKETS, GRAM_BUCKETS, DIMENSIONS = 1 << 16, 1 << 16, 16
GRAMS = (3, 4)
EPOCHS, RATE = 6, 0.5

#: A bucket is learned if so many training texts have it; the vectors of others stay zero.
LEAST_TEXTS = 3

_BUCKETS = WORD_BUCKETS + GRAM_BUCKETS + 2
_END = _BUCKETS - 1  # every text has this feature, so an empty one has a score as well
_AGAIN = _BUCKETS - 2  # stands for a word that equals the one before it, whatever the word


def _is_gap(points):
    return (points == 32) | ((points >= 9) & (points <= 13))


def gram_buckets(text: str) -> np.ndarray:
    """Buckets of the character n-grams of a text's words, a word's bounds counting as characters."""
    points = code_points(f" {text} ").copy()
    gap = _is_gap(points)
    points[gap] = 32
    found = [np.empty(0, np.uint32)]
    for n in GRAMS:
        if len(points) < n:
            continue
        inside = ~gap[1 : len(points) - n + 2]
        for k in range(2, n - 1):
            inside &= ~gap[k : len(points) - n + 1 + k]
        found.append(gram_hashes(points, n)[inside])
    return (np.concatenate(found) & np.uint32(GRAM_BUCKETS - 1)).astype(np.int64) + WORD_BUCKETS


def features(texts: list[str]):
    """The buckets of each text's features, repeats included: its words, their n-grams, words said twice running, the end mark."""
    data = [x.encode("utf-8", "replace") for x in texts]
    for first, last in text_groups(data):
        words, counts = word_hashes(data[first:last])
        again = np.concatenate([[False], words[1:] == words[:-1]])
        words = (words & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
        ends = np.cumsum(counts)
        for text, begin, end in zip(texts[first:last], ends - counts, ends, strict=True):
            said = np.full(np.count_nonzero(again[begin + 1 : end]), _AGAIN)
            yield np.concatenate([words[begin:end], gram_buckets(text), said, [_END]])


def train(texts: list[str], labels: np.ndarray, seed: int = 11) -> np.ndarray:
    """What each bucket adds to the log-odds of label 1, for the mean over a text's features.

    Stochastic gradient descent over vectors for all buckets and a softmax layer, one text a step. As the layer is linear,
    a vector's product with it is all that scoring needs. Without rows, or
    with one label only, every bucket gets the same value.
    """
    if not len(labels) or labels.min() == labels.max():
        return np.full(_BUCKETS, 0.0 if not len(labels) else (4.0 if labels[0] else -4.0), np.float32)
    random = np.random.default_rng(seed)
    vectors = np.zeros((_BUCKETS, DIMENSIONS), np.float32)
    layer = random.normal(0, 1 / DIMENSIONS, (DIMENSIONS, 2)).astype(np.float32)
    bags, texts_with = [], np.zeros(_BUCKETS, np.int64)
    for found in features(texts):
        buckets, times = np.unique(found, return_counts=True)
        bags.append((buckets, (times / len(found)).astype(np.float32)))
        texts_with[buckets] += 1
    learned = texts_with >= LEAST_TEXTS
    learned[[_AGAIN, _END]] = True
    bags = [(buckets[learned[buckets]], share[learned[buckets]]) for buckets, share in bags]
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(bags)):
            buckets, share = bags[i]
            mean = share @ vectors[buckets]
            odds = mean @ layer
            odds = np.exp(odds - odds.max())
            wrong = odds / odds.sum()
            wrong[labels[i]] -= 1
            rate = RATE * (1 - done / steps)
            step = layer @ wrong
            layer -= (rate * np.outer(mean, wrong)).astype(np.float32)
            # The gradient of a mean is small in each of its terms; as is usual for this model, terms take larger steps.
            vectors[buckets] -= (rate * np.minimum(share * len(buckets), 2.0))[:, None] * step.astype(np.float32)
            done += 1
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32)


def score(texts: list[str], values: np.ndarray) -> np.ndarray:
    odds = np.array([values[found].mean(dtype=np.float64) for found in features(texts)], np.float64)
    return 1.0 / (1.0 + np.exp(-np.clip(odds, -60, 60)))


def _train_in_task(batches):
    texts, labels = [], []
    for batch in batches:
        texts += [x or "" for x in batch.column("text").to_pylist()]
        labels += batch.column("quality").to_pylist()
    yield pa.RecordBatch.from_arrays([pa.array([train(texts, np.array(labels, np.int64)).tobytes()], pa.binary())], names=["model"])


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> bytes:
    """The trained model, of fixed size, from at most ``MOST_ROWS`` labelled rows that are not held out.

    The sample is drawn from the labels alone and its ids, bounded in number, are broadcast into the scan of the texts. Training is one
    task. Ids with null or contradicting labels are not learned from. Whole texts are learned.
    """
    agreed = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).alias("quality"), F.max(label_col).alias("_high"))
        .filter("quality = _high and quality in (0, 1)")
        .drop("_high")
    )
    sample = bounded_sample(agreed, "quality", "_id", PER_LABEL, MOST_ROWS)
    rows = documents.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    ordered = rows.select("_doc", "text", F.col("quality").cast("int").alias("quality")).repartition(1).sortWithinPartitions("_doc", "text")
    found = ordered.mapInArrow(_train_in_task, "model binary").first()
    return bytes(found.model) if found else train([], np.array([], np.int64)).tobytes()


@functools.lru_cache(maxsize=2)
def _values(model: bytes) -> np.ndarray:
    return np.frombuffer(model, np.float32)


def quality_scores(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; the score sees the whole text and nothing else.

    A null text counts as empty; empty texts get the score of the end mark. Rows may repeat, ids may be null (then not held out),
    other columns are not looked at. Without usable labels every score is 0.5. An empty table gives no rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, id_col=id_col, text_col=text_col, label_col=label_col))

    def scored(batches):
        values = _values(model.value)
        for batch in batches:
            scores = score([x or "" for x in batch.column(2).to_pylist()], values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = documents.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scored, f"doc_id {dict(documents.dtypes)[id_col]}, held_out boolean, score double, predicted int")
