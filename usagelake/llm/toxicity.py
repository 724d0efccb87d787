"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is cut into words (ASCII punctuation and white space separate them, letters lower-cased; a run of more than LONG
bytes, as in scripts without spaces, comes as overlapping pieces of LONG bytes) and those into windows of WINDOW words, a new one every STRIDE words, over the whole text. A word enters the network
by two vectors: one of its own, for words that enough documents of the sample hold (others share one), and
the mean of those of all its hashed character n-grams. A forward and a backward gated recurrent layer run over
the window, attention pools their states, and a logistic unit scores the pooled state. A document's score
is that of its highest window, put through a logistic calibration.

Training sees document labels only: one coordinate of the vectors starts as the smoothed log odds of toxic
documents that hold the word or n-gram, and at first the windows with the highest such odds stand for their
document; then in each round the highest windows of each document do, with the documents' own labels (multiple-instance learning).
It runs on the driver over a bounded sample: rows_per_class toxic and clean_rows other documents by least hash
of the id, those over max_sample_chars characters left out of training alone.

Defined cases: a null text counts as empty, and an empty text is one window of padding, scored like any
other; a null id is never held out nor learned from; without labels of both classes every score is the share of
label 1 (0.5 without any); repeated rows are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.llm.common import fresh, without
from usagelake.llm.labelled import remainder, sampled_ids

WINDOW, STRIDE = 32, 16
HIDDEN, CHARS, WORDS = 8, 12, 8
GRAM_BUCKETS = 8192
LONG = 32  #: bytes of a word, or of a piece of a longer one
BATCH = 1024  #: windows that run through the network at once
UPDATES = 60  #: of a training round, at least
DROP, DECAY = 0.3, 0.0
CACHE = 200_000  #: words whose input products a worker keeps

SEPARATORS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; one of more than LONG bytes comes as overlapping pieces."""
    words = (text or "").lower().encode("utf-8", "replace").translate(SEPARATORS).split()
    if max(map(len, words), default=0) > LONG:
        return [piece for w in words for piece in ((w,) if len(w) <= LONG else (w[at : at + LONG] for at in range(0, len(w) - LONG // 2, LONG // 2)))]
    return words


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 3- and 5-grams of bytes with edge marks of all words, one word after the other; and how many each has."""
    if len(words) > 16384:
        parts = [gram_buckets(words[at : at + 16384]) for at in range(0, len(words), 16384)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    counts = np.fromiter(map(len, words), np.int64, len(words)) + 2
    padded = np.zeros((len(words), max(5, int(counts.max(initial=0)))), np.uint64)
    for i, word in enumerate(words):
        padded[i, : len(word) + 2] = np.frombuffer(b"\x02" + word + b"\x03", np.uint8)
    mix = lambda a, salt: (((a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(40)).astype(np.int32) % GRAM_BUCKETS
    three = padded[:, :-2] | padded[:, 1:-1] << np.uint64(8) | padded[:, 2:] << np.uint64(16)
    five = three[:, :-2] | padded[:, 3:-1] << np.uint64(24) | padded[:, 4:] << np.uint64(32)
    n3, n5 = np.maximum(counts - 2, 1), np.maximum(counts - 4, 0)
    used = np.concatenate([np.arange(three.shape[1]) < n3[:, None], np.arange(five.shape[1]) < n5[:, None]], 1)
    return np.concatenate([mix(three, 1), mix(five, 2)], 1)[used], n3 + n5


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def places_of(counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Where the n-grams of the words which stand, if each word has so many of them."""
    n = counts[which]
    return np.repeat(starts_of(counts)[which] - starts_of(n), n) + np.arange(n.sum())


def windows(n_words: int) -> np.ndarray:
    """Starts of the windows of a text: every STRIDE words until the rest is covered; one at least."""
    return np.arange(0, max(1, n_words - WINDOW + STRIDE), STRIDE)[: max(1, -(-(n_words - WINDOW) // STRIDE) + 1)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters p; arrays run (feature, window) with one step of a window at a time."""

    def __init__(self, vocabulary: list[bytes], seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        n_in = CHARS + WORDS
        self.p = {"gram": draw(GRAM_BUCKETS + 1, CHARS, scale=0.3), "word": draw(len(vocabulary) + 1, WORDS, scale=0.3)}
        self.p["gram"][-1] = 0
        self.p["word"][0] = 0
        for d in "fb":
            self.p |= {f"w{d}": draw(3 * HIDDEN, n_in, scale=n_in**-0.5), f"u{d}": draw(3 * HIDDEN, HIDDEN, scale=HIDDEN**-0.5), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": draw(HIDDEN, 2 * HIDDEN, scale=0.3), "ab": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, scale=0.3), "o": draw(2 * HIDDEN, scale=0.3), "ob": np.zeros(1, np.float32)}
        self.scale, self.shift, self.constant = 1.0, 0.0, None

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Rows of [products with the forward weights, with the backward weights] of words."""
        grams, n = gram_buckets(words)
        x = np.empty((len(words), CHARS + WORDS), np.float32)
        x[:, :CHARS] = np.add.reduceat(self.p["gram"][grams], starts_of(n), 0) / n[:, None] if len(words) else 0
        x[:, CHARS:] = self.p["word"][[self.vocabulary.get(w, 0) for w in words]]
        return np.concatenate([x @ self.p["wf"].T + self.p["cf"], x @ self.p["wb"].T + self.p["cb"]], 1)

    def layer(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x: (steps, 3 * HIDDEN, windows). Padding (mask 0) leaves the state as it is."""
        u, h, steps = self.p[f"u{d}"], np.zeros((HIDDEN, x.shape[2]), np.float32), []
        states = np.empty((len(x), HIDDEN, x.shape[2]), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gates = x[t, : 2 * HIDDEN] + u[: 2 * HIDDEN] @ h
            np.clip(gates, -30, 30, out=gates)
            gates = 1 / (1 + np.exp(-gates))
            z, r = gates[:HIDDEN] * mask[t], gates[HIDDEN:]
            rh = r * h
            n = np.tanh(x[t, 2 * HIDDEN :] + u[2 * HIDDEN :] @ rh)
            if keep:
                steps.append((t, h, gates[:HIDDEN], z, r, rh, n))
            h = h + z * (n - h)
            states[t] = h
        return states, steps

    def forward(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: bool = False):
        hf, sf = self.layer("f", xf, mask, keep)
        hb, sb = self.layer("b", xb, mask, keep)
        h = np.concatenate([hf, hb], 1)
        e = np.tanh(np.matmul(self.p["a"], h) + self.p["ab"][:, None])
        s = np.einsum("k,tkb->tb", self.p["v"], e) + (mask - 1) * 30
        w = np.exp(s - s.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tkb->kb", w, h)
        logit = self.p["o"] @ pooled + self.p["ob"]
        return (logit, (sf, sb, h, e, w, pooled)) if keep else logit

    def scores(self, products: np.ndarray, places: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """forward without what only training needs: logits of windows whose words' input products are the columns
        places (step, window) of products. Gates are taken through the hyperbolic tangent, all steps in place."""
        steps, n = places.shape
        full = bool(mask.all())
        h = np.empty((steps, 2 * HIDDEN, n), np.float32)
        for d, own, rows in (("f", slice(0, HIDDEN), slice(0, 3 * HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN), slice(3 * HIDDEN, 6 * HIDDEN))):
            source, state, x = products[rows], np.zeros((HIDDEN, n), np.float32), np.empty((3 * HIDDEN, n), np.float32)
            u_gates, u_new = self.p[f"u{d}"][: 2 * HIDDEN] * np.float32(0.5), self.p[f"u{d}"][2 * HIDDEN :]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.take(source, places[t], axis=1, out=x, mode="clip")
                gates, new = x[: 2 * HIDDEN], x[2 * HIDDEN :]
                gates += u_gates @ state
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                z, r = gates[:HIDDEN], gates[HIDDEN:]
                if not full:
                    z *= mask[t]
                r *= state
                new += u_new @ r
                np.tanh(new, out=new)
                new -= state
                new *= z
                state = np.add(state, new, out=h[t, own])
        e = np.matmul(self.p["a"], h)
        e += self.p["ab"][:, None]
        np.tanh(e, out=e)
        w = np.matmul(self.p["v"][None], e)[:, 0]
        if not full:
            w += (mask - 1) * 30
        w -= w.max(0)
        np.exp(w, out=w)
        w /= w.sum(0)
        h *= w[:, None]
        return self.p["o"] @ h.sum(0) + self.p["ob"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """x: inputs (steps, CHARS + WORDS, windows). Gradients of the weighted log loss by parameter, and by x."""
        p, g = self.p, {}
        xf, xb = np.matmul(p["wf"], x) + p["cf"][:, None], np.matmul(p["wb"], x) + p["cb"][:, None]
        logit, (sf, sb, h, e, w, pooled) = self.forward(xf, xb, mask, True)
        d = ((sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g["o"], g["ob"] = pooled @ d, d.sum(keepdims=True)
        d_pool = p["o"][:, None] * d
        d_h = w[:, None] * d_pool
        d_w = np.einsum("kb,tkb->tb", d_pool, h)
        d_s = w * (d_w - (w * d_w).sum(0))
        g["v"] = np.einsum("tb,tkb->k", d_s, e)
        d_e = d_s[:, None] * p["v"][:, None] * (1 - e * e)
        g["a"], g["ab"] = np.einsum("tkb,tjb->kj", d_e, h), d_e.sum((0, 2))
        d_h += np.matmul(p["a"].T, d_e)
        d_x = np.zeros_like(x)
        for name, steps, part in (("f", sf, slice(0, HIDDEN)), ("b", sb, slice(HIDDEN, 2 * HIDDEN))):
            u, back, d_gates = p[f"u{name}"], np.zeros((HIDDEN, x.shape[2]), np.float32), np.empty((len(x), 3 * HIDDEN, x.shape[2]), np.float32)
            gu = np.zeros_like(u)
            for t, before, z0, z, r, rh, n in reversed(steps):
                back = back + d_h[t, part]
                d_n = back * z * (1 - n * n)
                d_z = back * (n - before) * mask[t] * z0 * (1 - z0)
                d_rh = u[2 * HIDDEN :].T @ d_n
                d_r = d_rh * before * r * (1 - r)
                d_gates[t, :HIDDEN], d_gates[t, HIDDEN : 2 * HIDDEN], d_gates[t, 2 * HIDDEN :] = d_z, d_r, d_n
                gu[: 2 * HIDDEN] += d_gates[t, : 2 * HIDDEN] @ before.T
                gu[2 * HIDDEN :] += d_n @ rh.T
                back = back * (1 - z) + d_rh * r + u[: 2 * HIDDEN].T @ d_gates[t, : 2 * HIDDEN]
            g[f"u{name}"], g[f"c{name}"] = gu, d_gates.sum((0, 2))
            g[f"w{name}"] = np.einsum("tkb,tjb->kj", d_gates, x)
            d_x += np.matmul(p[f"w{name}"].T, d_gates)
        return g, d_x

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * logit.astype(np.float64) + self.shift)


class Scorer:
    """Scores texts; keeps the input products of up to CACHE words."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        except KeyError:
            new = list({w for w in words if w not in known})
        for at in range(0, len(new), 16384):
            part = new[at : at + 16384]
            first = len(known)
            while first + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(part)] = self.net.inputs(part)
            known.update(zip(part, range(first, first + len(part)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def run(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Logits of windows that start at starts and end before ends (of the text) in ids."""
        out = np.empty(len(starts), np.float32)
        for at in range(0, len(starts), BATCH):
            first, end = starts[at : at + BATCH], ends[at : at + BATCH]
            low = int(first.min())
            span = ids[low : max(low + 1, int(first.max()) + WINDOW)] if len(ids) else np.zeros(1, np.int32)
            products = np.ascontiguousarray(self.table[span].T)
            products[: 2 * HIDDEN] *= 0.5
            products[3 * HIDDEN : 5 * HIDDEN] *= 0.5
            places = (first - low)[None] + np.arange(WINDOW)[:, None]
            mask = (places < (end - low)[None]).astype(np.float32)
            out[at : at + BATCH] = self.net.scores(products, places, mask)
        return out

    def logits(self, texts: Iterable[str | None]) -> Iterator[float]:
        """The highest window of each text, in order."""
        words, starts, ends, first = [], [], [], []
        n_windows = base = 0

        def done() -> Iterator[float]:
            if len(self.known) > CACHE:
                self.clear()
            found = self.run(self.ids(words), np.concatenate(starts), np.concatenate(ends))
            yield from np.maximum.reduceat(found, first).tolist()

        for text in texts:
            own = words_of(text)
            at = windows(len(own))
            first.append(n_windows)
            starts.append(at + base)
            ends.append(np.full(len(at), base + len(own)))
            words += own
            base, n_windows = base + len(own), n_windows + len(at)
            if n_windows >= BATCH:
                yield from done()
                words, starts, ends, first = [], [], [], []
                n_windows = base = 0
        if first:
            yield from done()


def log_odds(held: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Log odds of toxic against other documents that hold a thing, drawn to 0 where few hold it."""
    toxic = max(1, int((labels == 1).sum()))
    clean = max(1, len(labels) - toxic)
    odds = np.log((held[1] + 0.5) / (toxic + 1)) - np.log((held[0] + 0.5) / (clean + 1))
    return (np.clip(odds, -3, 3) * held.sum(0) / (held.sum(0) + 3)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, share: float | None = None, rounds: int = 7, seed: int = 0, min_docs: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    # Words become numbers at once, so the sample's words are never held as objects all together.
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    every = list(number)
    in_docs = np.zeros((2, len(every)), np.int64)
    for d, y in zip(docs, labels, strict=True):
        in_docs[int(y), np.unique(d)] += 1
    word_odds, in_docs = log_odds(in_docs, labels), in_docs.sum(0)
    common = np.flatnonzero(in_docs >= min_docs)
    common = common[np.lexsort((common, -in_docs[common]))][:20_000]
    net = Network([every[i] for i in common], seed)
    if len(labels) == 0 or labels.min() == labels.max():
        net.constant = float(labels.mean()) if len(labels) else 0.5
        return net
    # A word that fills a window is a repetition and no abuse: some such windows of clean words are clean examples.
    clean = [d for d, y in zip(docs, labels, strict=True) if y == 0 and len(d)]
    for i in rng.integers(0, max(1, len(clean)), len(clean) // 3):
        docs.append(np.full(WINDOW, clean[i][int(rng.integers(len(clean[i])))], np.int32))
    labels = np.concatenate([labels, np.zeros(len(docs) - len(labels))])
    if not every:
        every = [b""]
    grams, n_grams = gram_buckets(every)
    gram_docs = np.zeros((2, GRAM_BUCKETS + 1), np.int64)
    for d, y in zip(docs, labels[: len(texts)], strict=False):
        gram_docs[int(y), np.unique(grams[places_of(n_grams, np.unique(d))])] += 1
    gram_odds = log_odds(gram_docs, labels[: len(texts)])
    gram_odds[-1] = 0
    net.p["gram"][:, 0] = gram_odds
    net.p["word"][1:, 0] = word_odds[common]
    prior = np.maximum(word_odds if len(word_odds) else np.zeros(1), np.maximum.reduceat(gram_odds[grams], starts_of(n_grams)))
    own = np.array([net.vocabulary.get(w, 0) for w in every])
    ids = np.concatenate([d if len(d) else np.zeros(1, np.int32) for d in docs])
    sizes = np.array([len(d) for d in docs])
    del number, docs, clean
    base = np.concatenate([[0], np.cumsum(np.maximum(sizes, 1))[:-1]])
    at = [windows(n) for n in sizes]
    doc = np.repeat(np.arange(len(sizes)), [len(a) for a in at])
    starts = np.concatenate(at) + base[doc]
    ends = (base + sizes)[doc]
    first = np.concatenate([[0], np.cumsum([len(a) for a in at])[:-1]])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def score_all() -> np.ndarray:
        scorer = Scorer(net)
        scorer.table = np.concatenate([net.inputs(every[at : at + 16384]) for at in range(0, len(every), 16384)])
        return scorer.run(ids, starts, ends)

    def update(chosen: np.ndarray, weight: np.ndarray, rate: float) -> None:
        nonlocal step
        step += 1
        places = starts[chosen, None] + np.arange(WINDOW)
        mask = (places < ends[chosen, None]).astype(np.float32)
        w = ids[np.minimum(places, len(ids) - 1)]
        distinct, where = np.unique(w, return_inverse=True)
        where = where.reshape(w.shape)
        n_own, own_grams = n_grams[distinct], grams[places_of(n_grams, distinct)]
        x = np.concatenate([np.add.reduceat(net.p["gram"][own_grams], starts_of(n_own), 0) / n_own[:, None], net.p["word"][own[distinct]]], 1)
        # Words drop their own vector now and then, so that their characters must tell as well.
        dropped = rng.random(len(distinct)) < DROP
        x[dropped, CHARS:] = 0
        g, d_x = net.gradients(np.ascontiguousarray(x[where].transpose(1, 2, 0), dtype=np.float32), np.ascontiguousarray(mask.T), labels[doc[chosen]], weight)
        flat = d_x.transpose(2, 0, 1).reshape(-1, CHARS + WORDS)
        by_word = np.stack([np.bincount(where.ravel(), flat[:, k], len(distinct)) for k in range(CHARS + WORDS)], 1)
        of_gram = np.repeat(by_word[:, :CHARS] / n_own[:, None], n_own, 0)
        g["gram"] = np.stack([np.bincount(own_grams, of_gram[:, k], GRAM_BUCKETS + 1) for k in range(CHARS)], 1)
        g["gram"][-1] = 0
        by_word[dropped, CHARS:] = 0
        g["word"] = np.stack([np.bincount(own[distinct], by_word[:, CHARS + k], len(net.p["word"])) for k in range(WORDS)], 1)
        g["word"][0] = 0
        for k, v in net.p.items():
            m, s = moments[k]
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] ** 2 - s)
            if k in ("gram", "word"):
                v *= 1 - rate * DECAY  # what few examples say about a word wears off
            v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    for r in range(rounds):
        if r == 0:
            best = np.concatenate([prior[ids[at : at + BATCH]] for at in range(0, len(ids), BATCH)])
            best = np.concatenate([best, np.full(WINDOW, -9.0)])
            key = -np.max([np.where(starts + k < ends, best[starts + k], -9.0) for k in range(WINDOW)], 0)
        else:
            key = -score_all()
        order = np.lexsort((key, doc))
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc)) - first[doc[order]]
        toxic = labels[doc] == 1
        if r == 0:
            chosen = np.flatnonzero((rank < np.where(toxic, 3, 2)) | (~toxic & (rng.random(len(doc)) < 2 * labels.size / len(doc))))
        else:
            chosen = np.flatnonzero(rank < np.where(toxic, 3 if r < rounds // 2 else 1, 3 if r < 3 else 2))
            drawn = np.flatnonzero(~toxic & (rng.random(len(doc)) < 2 * labels.size / len(doc)))
            chosen = np.union1d(chosen, drawn)
        n_toxic = max(1, int(toxic[chosen].sum()))
        balance = np.where(toxic[chosen], 0.5 / n_toxic, 0.5 / max(1, len(chosen) - n_toxic)) * len(chosen)
        # A small sample takes smaller steps' batches and more passes, so that every round has its share of updates.
        batches = max(1, len(chosen) // 256, min(8, len(chosen) // 16))
        for _ in range(max(2, -(-UPDATES // batches))):
            for part in np.array_split(rng.permutation(len(chosen)), batches):
                update(chosen[part], balance[part], 0.01 if r < rounds - 2 else 0.003)
    top = np.maximum.reduceat(score_all(), first).astype(np.float64)
    top, labels = top[: len(texts)], labels[: len(texts)]
    share = float(labels.mean()) if share is None else share
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    a, b = 1.0, 0.0
    for _ in range(200):  # logistic calibration of the highest windows, with a prior against certainty
        err = weight * (sigmoid(a * top + b) - (labels * 0.998 + 0.001))
        a, b = max(0.05, a - 0.05 * float((err * top).mean() + 0.001 * (a - 1))), b - 0.5 * float(err.mean())
    net.scale, net.shift = a, b
    return net


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held: int = 1, rows_per_class: int = 1500, clean_rows: int = 4000, max_sample_chars: int = 100_000) -> Network:
    ids = sampled_ids(labels, label, modulus, held, rows_per_class, clean_rows).toPandas()
    if ids.empty:
        return train([], np.zeros(0))
    counted = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held))
    share = counted.agg(F.avg(F.col(label).cast("double"))).first()[0]
    picked = F.broadcast(docs.sparkSession.createDataFrame(ids))  # at most rows_per_class + clean_rows ids
    sample = docs.select("doc_id", "text").join(picked, "doc_id").where(F.length(F.coalesce("text", F.lit(""))) <= max_sample_chars)
    sample = sample.dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    return train(list(sample["text"]), sample["label"].to_numpy(float), share)


def score_udf(net: Network):
    """The score of a text column, as a column function."""

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(net)
        for part in parts:
            if net.constant is not None:
                yield pd.Series(net.constant, index=part.index, dtype="float64")
            else:
                yield pd.Series(net.calibrated(np.fromiter(scorer.logits(part), np.float64, len(part))), index=part.index)

    return scores


def score_toxicity(docs: DataFrame, net: Network, threshold: float = 0.7, modulus: int = 3, held: int = 1, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    rows = docs.select("doc_id", score_udf(net)(F.col(f"`{text}`")).alias("score"))
    return rows.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, net: Network, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs whose score is under the threshold."""
    score = fresh(docs, "_toxicity")
    return docs.withColumn(score, score_udf(net)(F.col(f"`{text}`"))).where(F.col(score) < threshold).drop(score)
