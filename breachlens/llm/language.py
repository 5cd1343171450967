"""Language identification by error-correcting output codes over n-gram classifiers."""

import json
import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out
from .text_model import code_points, gram_hashes

#: Training rows: about this many per language, and in all.
PER_LANGUAGE, MOST_ROWS = 1500, 8000
BUCKETS = 1 << 12
GRAMS = (1, 2, 3)
EPOCHS, BATCH, RATE = 12, 64, 4.0
#: A prediction is ambiguous if the second codeword's loss is nearer than this, as a share of all bits' weight.
LEAST_MARGIN = 0.05

_HAS_LETTER = regex.compile(r"\p{L}").search
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 bits for each of ``n`` languages.

    Up to five languages get every way of dividing them in two; more get the widest of 200 seeded random codes of
    12 bits per doubling, so a few wrong bits still leave the right row nearest.
    """
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        return np.array([[1 if row == 0 else (1 if cut >> (row - 1) & 1 else -1) for cut in range(2 ** (n - 1) - 1)] for row in range(n)], np.int8)
    bits, random, best = math.ceil(12 * math.log2(n)), np.random.default_rng(seed), None
    for _ in range(200):
        code = random.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(axis=1 - 1)) < n]
        nearest = min((int((code[a] != code[b]).sum()) for a in range(min(n, 64)) for b in range(a)), default=0)
        if best is None or nearest > best[0]:
            best = nearest, code
    return best[1]


def histogram(texts: list[str]) -> np.ndarray:
    """For each text the square roots of the shares of its letter n-grams, by hash; other characters count as one space."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in enumerate(texts):
        points = code_points(" " + _NOT_LETTERS.sub(" ", text.lower()) + " ").astype(np.uint32)
        counts = np.zeros(BUCKETS, np.int64)
        for n in GRAMS:
            counts += np.bincount(gram_hashes(points, n) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        out[row] = np.sqrt(counts / max(1, counts.sum()))
    return out


def train(shares: np.ndarray, rows: np.ndarray, n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, biases and trust of the binary classifiers, one for each bit of the codewords; ``rows`` are languages.

    Logistic losses, mini-batches, languages weighing the same. A bit's trust is the share of rows it gets right beyond one half.
    """
    code = codewords(n).astype(np.float32)
    wanted = code[rows]
    random = np.random.default_rng(seed)
    weights, bias = np.zeros((shares.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    even = (len(rows) / (n * np.maximum(1, np.bincount(rows, minlength=n)))).astype(np.float32)[rows]
    for epoch in range(EPOCHS):
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            odds = shares[part] @ weights + bias
            slope = wanted[part] / (1 + np.exp(np.clip(wanted[part] * odds, -30, 30))) * even[part][:, None]
            rate = RATE / (1 + epoch)
            weights += rate * shares[part].T @ slope / len(part) * 8
            bias += rate * slope.mean(axis=0)
    right = (np.sign(shares @ weights + bias) == wanted).mean(axis=0)
    return weights, bias, np.maximum(right - 0.5, 0.01).astype(np.float32)


class Model:
    """Languages, their codewords and the bits' classifiers."""

    def __init__(self, languages, weights=None, bias=None, trust=None):
        self.languages, self.weights, self.bias, self.trust = languages, weights, bias, trust
        self.code = codewords(len(languages)).astype(np.float32)

    def to_bytes(self) -> bytes:
        head = json.dumps(self.languages).encode()
        arrays = b"" if self.weights is None else self.weights.tobytes() + self.bias.tobytes() + self.trust.tobytes()
        return len(head).to_bytes(4, "little") + head + arrays

    @classmethod
    def from_bytes(cls, data: bytes):
        size = int.from_bytes(data[:4], "little")
        model = cls(json.loads(data[4 : 4 + size]))
        if model.languages:
            bits, values = model.code.shape[1], np.frombuffer(data[4 + size :], np.float32)
            model.weights, model.bias, model.trust = values[: BUCKETS * bits].reshape(BUCKETS, bits), values[BUCKETS * bits : BUCKETS * bits + bits], values[BUCKETS * bits + bits :]
        return model

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity. The losses of the bits against a codeword are weighed by the bits' trust; the least loss wins."""
        found, scores, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        usable = [i for i, text in enumerate(texts) if self.languages and text and _HAS_LETTER(text)]
        for at in range(0, len(usable), 128):
            part = usable[at : at + 128]
            odds = histogram([texts[i] for i in part]) @ self.weights + self.bias
            losses = np.logaddexp(0, -odds[:, None, :] * self.code[None]) @ self.trust
            chance = np.exp(losses.min(axis=1, keepdims=True) - losses)
            chance /= chance.sum(axis=1, keepdims=True)
            best = losses.argmin(axis=1)
            ranked = np.sort(losses, axis=1)
            for k, i in enumerate(part):
                found[i], scores[i] = self.languages[best[k]], chance[k, best[k]]
                unsure[i] = len(self.languages) > 1 and ranked[k, 1] - ranked[k, 0] < LEAST_MARGIN * self.trust.sum()
        return found, scores, unsure


def _train_in_task(batches):
    texts, names = [], []
    for batch in batches:
        texts += [x or "" for x in batch.column("text").to_pylist()]
        names += batch.column("lang").to_pylist()
    languages = sorted(set(names))
    place = {x: i for i, x in enumerate(languages)}
    model = Model(languages, *train(histogram(texts), np.array([place[x] for x in names]), len(languages))) if names else Model([])
    yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], names=["model"])


def fit(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> bytes:
    """The trained model, from at most ``MOST_ROWS`` rows with a language and a letter that are not held out.

    The sample is drawn from ids and languages alone and its ids, bounded in number, are broadcast into the scan of the texts. Training is
    one task. An id with several languages is not learned from.
    """
    usable = (
        documents.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(lang_col).alias("lang"), F.max(lang_col).alias("_high"))
        .filter("lang = _high")
        .drop("_high")
    )
    sample = bounded_sample(usable, "lang", "_id", PER_LANGUAGE, MOST_ROWS)
    rows = documents.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    lettered = rows.filter(F.col("text").rlike(r"\p{L}")).select("_doc", "text", "lang")
    found = lettered.repartition(1).sortWithinPartitions("_doc", "text").mapInArrow(_train_in_task, "model binary").first()
    return bytes(found.model) if found else Model([]).to_bytes()


def languages(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) per row; the prediction sees the whole text and nothing else.

    ``und`` with score 0 is given to null texts and to texts without a letter, and to all if there is nothing to learn from. Rows may
    repeat, ids may be null (then not held out), other columns are not looked at. An empty table gives no rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, id_col=id_col, text_col=text_col, lang_col=lang_col))

    def predicted(batches):
        known = Model.from_bytes(model.value)
        for batch in batches:
            names, scores, unsure = known.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    rows = documents.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predicted, f"doc_id {dict(documents.dtypes)[id_col]}, held_out boolean, lang_pred string, score double, ambiguous boolean")
