"""The classifiers' common parts against plain versions."""

import math
import random

import numpy as np

from siltstone.llm import linear


def texts(n=60, seed=9):
    rnd = random.Random(seed)
    signs = list("abcdeé  \n\t12ΣσİıẞßA") + ["   ", "日", "\U0001f600"]
    return ["", " ", "x"] + ["".join(rnd.choices(signs, k=rnd.randint(1, 120))) for _ in range(n)]


def test_pieces_lose_no_ngram_and_count_none_twice():
    for kind in ("letters", "all"):
        for text in texts():
            want = None
            for piece in (10**6, 1, 2, 3, 7, 50):
                found = [linear.grams(code, doc, 18, lead)[0] for _, code, doc, lead in linear.coded([text], kind, piece, piece)]
                got = sorted(np.concatenate([*found, np.empty(0, np.int64)]).tolist())
                want = got if want is None else want
                assert got == want, (kind, piece, text)


def test_scores_do_not_depend_on_pieces_or_batches():
    rng = np.random.default_rng(2)
    model = linear.Linear(np.arange(1 << 12, dtype=np.int32), rng.normal(size=(1 << 12, 2)).astype(np.float32), np.array([0.1, -0.2]), 50.0)
    made = texts()
    whole = np.concatenate([model.text_logits([t], "all", 10**6) for t in made])
    for piece in (3, 40, 10**6):
        assert np.allclose(model.text_logits(made, "all", piece), whole)
        assert np.allclose(model.text_odds(made, "all", piece), whole[:, 1] - whole[:, 0])


def plain_ftrl(rows, labels, classes, epochs, alpha, beta, l1, l2, scale, shrink):
    """One weight after the other, from the definition."""
    df = {}
    for f, _ in rows:
        for j in f:
            df[j] = df.get(j, 0) + 1
    idf = {j: math.log((1 + len(rows)) / (1 + d)) + 1 for j, d in df.items()}
    z, n = {}, {}

    def weight(j, k, reg):
        zz, nn = z.get((j, k), 0.0), n.get((j, k), 0.0)
        return 0.0 if abs(zz) <= reg else -(zz - math.copysign(reg, zz)) / ((beta + math.sqrt(nn)) / alpha + l2)

    def step(j, k, g, reg):
        nn, w = n.get((j, k), 0.0), weight(j, k, reg)
        z[j, k] = z.get((j, k), 0.0) + g - (math.sqrt(nn + g * g) - math.sqrt(nn)) / alpha * w
        n[j, k] = nn + g * g

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, c = rows[i]
            x = {j: scale * m / (sum(c) + shrink) * idf[j] for j, m in zip(f, c, strict=True)}
            logit = [sum(v * weight(j, k, l1) for j, v in x.items()) + weight("bias", k, 0.0) for k in range(classes)]
            top = max(logit)
            p = [math.exp(v - top) for v in logit]
            p = [v / sum(p) - (k == labels[i]) for k, v in enumerate(p)]
            for k in range(classes):
                for j, v in x.items():
                    step(j, k, v * p[k], l1)
                step("bias", k, p[k], 0.0)

    def logits(f, c):
        return [sum(scale * m / (sum(c) + shrink) * idf.get(j, 1) * weight(j, k, l1) for j, m in zip(f, c, strict=True)) + weight("bias", k, 0.0) for k in range(classes)]

    return logits, sum(weight(j, k, l1) == 0 for j in df for k in range(classes))


def test_training_against_plain_ftrl():
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(40):
        f = sorted(rnd.sample(range(30), rnd.randint(1, 8)))
        rows.append((np.array(f, np.int32), np.array([rnd.randint(1, 4) for _ in f], np.int32)))
        labels.append(i % 3 if rnd.random() < 0.2 else int(f[0] % 3))
    setting = {"epochs": 3, "alpha": 0.5, "beta": 1.0, "l1": 0.3, "l2": 0.01, "scale": 10.0, "shrink": 5.0}
    model = linear.train(rows, np.array(labels), 3, 6, **setting)
    logits, zeros = plain_ftrl([(f.tolist(), c.tolist()) for f, c in rows], labels, 3, **setting)
    assert zeros > 0
    got = linear.row_logits(model, rows)
    assert np.allclose(got, [logits(f.tolist(), c.tolist()) for f, c in rows], atol=1e-4)


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, 400)
    logits = rng.normal(size=(400, 3)) + 4 * np.eye(3)[labels] * (rng.random(400) < 0.7)[:, None]
    for factor in (1.0, 6.0):
        t = linear.temperature(logits * factor, labels)
        loss = lambda s, f=factor: -np.log(linear.softmax(logits * f / s)[np.arange(400), labels]).mean()
        assert all(loss(t) <= loss(t * s) + 1e-4 for s in (0.9, 1.1)) and 0.8 < t / (factor * linear.temperature(logits, labels)) < 1.25
    assert linear.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0
