"""The two classifiers against plain loops: one step of training at a time, one codeword at a time."""

import math

import numpy as np
import pytest

from breachlens.llm import language, quality_model

GOOD = [f"the {a} fox {b} over the {c} dog and walks home" for a in ("quick", "brown", "old") for b in ("jumps", "leaps") for c in ("lazy", "tired")]
BAD = [f"buy {a} now now now {b} !!! click {c}" for a in ("cheap", "pills") for b in ("deal", "offer", "win") for c in ("here", "there")]


def plain_training(texts, labels, seed=11):
    """The same descent over dictionaries of numbers, bucket by bucket; returns vectors and layer."""
    random, size = np.random.default_rng(seed), quality_model.DIMENSIONS
    layer = random.normal(0, 1 / size, (size, 2)).astype(np.float32).astype(float).tolist()
    bags = []
    for found in quality_model.features(texts):
        counts = {}
        for bucket in found.tolist():
            counts[bucket] = counts.get(bucket, 0) + 1
        bags.append({b: n / len(found) for b, n in counts.items()})
    with_bucket = {}
    for bag in bags:
        for b in bag:
            with_bucket[b] = with_bucket.get(b, 0) + 1
    always = (quality_model._AGAIN, quality_model._END)
    bags = [{b: s for b, s in bag.items() if with_bucket[b] >= quality_model.LEAST_TEXTS or b in always} for bag in bags]
    vectors, done, steps = {}, 0, quality_model.EPOCHS * len(bags)
    for _ in range(quality_model.EPOCHS):
        for i in random.permutation(len(bags)):
            bag = bags[i]
            mean = [sum(s * vectors.get(b, [0.0] * size)[k] for b, s in bag.items()) for k in range(size)]
            odds = [sum(mean[k] * layer[k][c] for k in range(size)) for c in range(2)]
            shares = [math.exp(o - max(odds)) for o in odds]
            wrong = [x / sum(shares) - (c == labels[i]) for c, x in enumerate(shares)]
            rate = quality_model.RATE * (1 - done / steps)
            step = [sum(layer[k][c] * wrong[c] for c in range(2)) for k in range(size)]
            for k in range(size):
                for c in range(2):
                    layer[k][c] -= rate * mean[k] * wrong[c]
            for b, s in bag.items():
                old = vectors.setdefault(b, [0.0] * size)
                for k in range(size):
                    old[k] -= rate * min(s * len(bag), 2.0) * step[k]
            done += 1
    return vectors, layer


def test_training_and_score_are_the_plain_loops():
    texts, labels = [*GOOD, *BAD, ""], np.array([1] * len(GOOD) + [0] * len(BAD) + [0])
    vectors, layer = plain_training(texts, labels.tolist())
    values = quality_model.train(texts, labels)
    for bucket, vector in vectors.items():
        assert math.isclose(values[bucket], sum(x * (w[1] - w[0]) for x, w in zip(vector, layer, strict=True)), abs_tol=2e-3)
    assert np.count_nonzero(values) <= len(vectors)
    asked = ["the quick dog walks", "click here now now", "", "nothing known xyzzy", " ".join(GOOD * 40)]
    for text, found in zip(asked, quality_model.score(asked, values), strict=True):
        buckets = next(iter(quality_model.features([text]))).tolist()
        mean = [sum(vectors.get(b, [0.0] * len(layer))[k] for b in buckets) / len(buckets) for k in range(len(layer))]
        odds = [sum(m * w[c] for m, w in zip(mean, layer, strict=True)) for c in range(2)]
        assert math.isclose(found, math.exp(odds[1]) / sum(map(math.exp, odds)), abs_tol=1e-3)


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_decoding_is_the_plain_loops(n):
    """The codeword of least weighted loss wins, one of them where they are equal; near ties are ambiguous."""
    random, code = np.random.default_rng(n), language.codewords(n).astype(float)
    bits = code.shape[1]
    model = language.Model([f"l{i}" for i in range(n)])
    model.trust = random.uniform(0.05, 0.5, bits).astype(np.float32)
    texts = ["ein Wort", "two words", "mots", "палка", "", None, "12 34", "x" * 5000, "word " * 3000]
    unsure_seen = set()
    for size in (0.0, 0.02, 0.3, 5.0):
        model.weights = random.normal(0, size, (language.BUCKETS, bits)).astype(np.float32)
        model.bias = random.normal(0, size, bits).astype(np.float32)
        names, scores, unsure = model.predict(texts)
        for text, name, score, doubt in zip(texts, names, scores, unsure, strict=True):
            if not text or not any(x.isalpha() for x in text):
                assert (name, score, doubt) == ("und", 0.0, False)
                continue
            shares = language.histogram([text])[0].astype(float)
            odds = [sum(shares[k] * model.weights[k, b] for k in np.flatnonzero(shares)) + model.bias[b] for b in range(bits)]
            losses = [sum(model.trust[b] * math.log1p(math.exp(-code[row, b] * odds[b])) for b in range(bits)) for row in range(n)]
            order = sorted(range(n), key=lambda row: (losses[row], row))
            margin = losses[order[1]] - losses[order[0]] if n > 1 else math.inf
            limit = language.LEAST_MARGIN * float(model.trust.sum())
            assert name in {f"l{row}" for row in order if losses[row] - losses[order[0]] < 1e-5}
            assert math.isclose(score, math.exp(-losses[order[0]]) / sum(math.exp(-x) for x in losses), abs_tol=1e-4)
            if abs(margin - limit) > 1e-5:
                assert doubt == (margin < limit)
            unsure_seen.add(bool(doubt))
    assert unsure_seen == ({False, True} if n > 1 else {False})


def test_bits_are_learned_for_every_language():
    """Three made-up languages of their own letters, a few texts each: all are told apart, and the ambiguous text is flagged as such or scored below them."""
    texts = [f"{x * 3} {x * 2}{y}" for x in "abc" for y in "abc" for _ in range(6)]
    rows = np.array(["abc".index(t[0]) for t in texts])
    model = language.Model(list("abc"), *language.train(language.histogram(texts), rows, 3))
    names, scores, unsure = language.Model.from_bytes(model.to_bytes()).predict(texts)
    assert [("abc".index(x)) for x in names] == rows.tolist()
    mixed = model.predict(["aa bb cc"])
    assert mixed[2][0] or mixed[1][0] < min(scores)
