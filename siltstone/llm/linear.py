"""Sparse linear models of hashed features, shared by the language and the quality classifiers.

``grams`` turns a batch of texts into hashed character n-grams with numpy; ``Linear`` is a multinomial logistic
regression over TF-IDF of them, trained with follow-the-regularised-leader (per-coordinate rates, elastic net) and
calibrated with a temperature. TF is the share of a text's n-grams, so that a text's score is a mean over n-grams. A long
text is read in pieces; a piece begins with the end of the one before, so that no n-gram is lost or counted twice and a
score doesn't depend on the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .common import worker_state

#: Code points handled at once.
PIECE = 1 << 18
#: Characters of the longest n-gram.
LONGEST = 3


def _table(kind: str) -> np.ndarray:
    """For each code point what stands for it. "letters": its lower case if a letter, else a space. "all": digits as 0,
    white space as a space, all else itself. A lower case of several characters is left out: each has one place."""

    def make() -> np.ndarray:
        out = np.arange(0x110000, dtype=np.uint32)
        test = lambda f: np.fromiter((f(chr(i)) for i in range(0x110000)), bool, 0x110000)
        if kind == "letters":
            letters = test(str.isalpha)
            out[~letters] = 32
            for i in np.flatnonzero(letters).tolist():
                if len(low := chr(i).lower()) == 1:
                    out[i] = ord(low)
        else:
            out[test(str.isspace)] = 32
            out[test(str.isdigit)] = 48
        return out

    return worker_state(f"table {kind}", make)


def coded(texts: list[str], kind: str, batch: int = PIECE, piece: int = PIECE) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, int]]:
    """Batches of about ``batch`` code points, or pieces of ``piece`` of a longer text: (the text that each part belongs to,
    code points, the part of each, how many of the first ones were in the piece before). Of a run of spaces the first stays."""
    table = _table(kind)
    points = lambda text: table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    owners: list[int] = []
    parts: list[str] = []
    size = 0

    def joined():
        code = points("".join(parts))
        doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        keep = code != 32
        keep[1:] |= (code[:-1] != 32) | (doc[1:] != doc[:-1])
        keep[:1] = True
        return list(owners), code[keep], doc[keep], 0

    for i, text in enumerate(texts):
        if size and size + len(text) > batch:
            yield joined()
            owners, parts, size = [], [], 0
        if len(text) <= piece:
            owners.append(i)
            parts.append(text)
            size += len(text)
            continue
        carry = np.empty(0, np.uint32)
        for at in range(0, len(text), piece):
            code = points(text[at : at + piece])
            keep = code != 32
            keep[1:] |= code[:-1] != 32
            keep[0] |= not len(carry) or carry[-1] != 32
            code = np.concatenate([carry, code[keep]])
            yield [i], code, np.zeros(len(code), np.int32), len(carry)
            carry = code[-(LONGEST - 1) :].copy()
    if parts:
        yield joined()


def grams(code: np.ndarray, doc: np.ndarray, bits: int, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of 1 to LONGEST characters, the part that each belongs to), in no order; without those that end
    within the first ``lead`` code points."""
    if not len(code):
        return np.empty(0, np.int64), doc
    code = code.astype(np.uint64)
    out, own = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[n - 1 :] + np.uint64(n))
        whole = doc[:m] == doc[n - 1 :]
        whole[: max(0, lead - n + 1)] = False
        if n == 1:
            whole &= code != 32
        mixed = h[whole] * np.uint64(0xD6E8FEB86659FD93)
        out.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
        own.append(doc[:m][whole])
    return np.concatenate(out), np.concatenate(own)


def counts(texts: list[str], kind: str, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, counts) of each text, for training."""
    out: list[list] = [[] for _ in texts]
    for owners, code, doc, lead in coded(texts, kind):
        feature, doc = grams(code, doc, bits, lead)
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(len(owners) + 1))
        for i, owner in enumerate(owners):
            out[owner].append(np.unique(feature[order[cuts[i] : cuts[i + 1]]], return_counts=True))

    def summed(parts):
        if len(parts) == 1:
            return parts[0]
        features, place = np.unique(np.concatenate([f for f, _ in parts]), return_inverse=True)
        return features, np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)

    found = (summed(o) if o else (np.empty(0, np.int64), np.empty(0, np.int64)) for o in out)
    return [(f.astype(np.int32), c.astype(np.int32)) for f, c in found]


@dataclass
class Linear:
    """Weights of the features that training left non-zero. ``row`` maps a feature to its row in ``weights`` (0: none)."""

    row: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    shrink: float = 0.0
    temperature: float = 1.0

    def logits_of(self, feature: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums over each part's features, and their numbers."""
        order = np.argsort(doc, kind="stable")
        rows = self.row[feature[order]]
        size = np.bincount(doc, minlength=n)
        sums = np.zeros((n, self.weights.shape[1]))
        full = np.flatnonzero(size)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
            for k in range(self.weights.shape[1]):
                sums[full, k] = np.add.reduceat(self.weights[rows, k].astype(np.float64), starts)
        return sums, size

    def text_logits(self, texts: list[str], kind: str, piece: int = PIECE) -> np.ndarray:
        bits, k = len(self.row).bit_length() - 1, self.weights.shape[1]
        total, size = np.zeros((len(texts), k)), np.zeros(len(texts))
        for owners, code, doc, lead in coded(texts, kind, 1 << 16, piece):
            s, n = self.logits_of(*grams(code, doc, bits, lead), len(owners))
            np.add.at(total, owners, s)
            np.add.at(size, owners, n)
        return total / np.maximum(size + self.shrink, 1)[:, None] + self.bias

    def text_odds(self, texts: list[str], kind: str, piece: int = PIECE) -> np.ndarray:
        """The second class's logit less the first's."""
        gain = self.weights.astype(np.float64) @ [-1.0, 1.0]
        gain, bits = gain[self.row], len(self.row).bit_length() - 1
        total, size = np.zeros(len(texts)), np.zeros(len(texts))
        for owners, code, doc, lead in coded(texts, kind, 1 << 15, piece):
            feature, doc = grams(code, doc, bits, lead)
            np.add.at(total, owners, np.bincount(doc, gain[feature], len(owners)))
            np.add.at(size, owners, np.bincount(doc, minlength=len(owners)))
        return total / np.maximum(size + self.shrink, 1) + self.bias[1] - self.bias[0]

    def share(self, logits: np.ndarray) -> np.ndarray:
        return softmax(logits / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, bits: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, scale: float = 100.0, shrink: float = 50.0, weight: np.ndarray | None = None) -> Linear:
    """Follow-the-regularised-leader over (features, counts) rows, in a fixed shuffled order.

    x = scale * tf * idf with idf = ln((1 + N) / (1 + df)) + 1 over these rows; the returned weights hold scale and
    idf already. tf is count / (n-grams + shrink), so that a text of few n-grams says little. ``weight`` of a row
    multiplies its gradient.
    """
    size = 1 << bits
    df = np.zeros(size)
    for f, _ in rows:
        df[f] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)
    rng = np.random.default_rng(7)

    def solved(z, n, l1):
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, c = rows[i]
            x = scale * c / max(c.sum() + shrink, 1) * idf[f]
            zf, nf = z[f], n[f]
            w, b = solved(zf, nf, l1), solved(zb, nb, 0.0)
            p = x @ w + b
            p = np.exp(p - p.max())
            p /= p.sum()
            p[labels[i]] -= 1
            if weight is not None:
                p *= weight[i]
            g = x[:, None] * p
            g2 = g * g
            z[f] = zf + g - (np.sqrt(nf + g2) - np.sqrt(nf)) / alpha * w
            n[f] = nf + g2
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    w = solved(z, n, l1)
    used = np.flatnonzero(np.abs(w).sum(1) > 0)
    row = np.zeros(size, np.int32)
    row[used] = np.arange(1, len(used) + 1)
    return Linear(row, np.vstack([np.zeros((1, classes)), w[used] * (scale * idf[used])[:, None]]).astype(np.float32), solved(zb, nb, 0.0), shrink)


def row_logits(model: Linear, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Logits of (features, counts) rows."""
    return np.array([(c @ model.weights[model.row[f]]) / max(c.sum() + model.shrink, 1) + model.bias for f, c in rows]).reshape(len(rows), len(model.bias))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, from a fine grid; 1 without rows.

    As in Platt's calibration a row's own label counts (n + 1) / (n + 2) and the others share the rest, so that
    rows without an error don't ask for certainty.
    """
    n, k = logits.shape if len(labels) else (0, 0)
    if not n or k < 2:
        return 1.0
    goal = np.full((n, k), 1 / (n + 2) / (k - 1))
    goal[np.arange(n), labels] = (n + 1) / (n + 2)
    grid = np.exp(np.linspace(np.log(0.05), np.log(50), 281))
    loss = [-(goal * np.log(np.maximum(softmax(logits / t), 1e-300))).sum(1).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
