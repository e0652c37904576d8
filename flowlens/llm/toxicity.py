"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are a word part and a character part, each a learned vector and one evidence
value: how surely the word, or the most telling of its character groups, occurs more in toxic than
in clean training texts. The network reads windows of words in both directions, attention pools
the states of a window, and the window's logit follows. A text is scored by its highest window
among windows that overlap by half and cover the whole text; a logistic fit on training texts
turns that into a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm import words as W
from flowlens.llm.tables import checked_broadcast

#: Labelled rows to learn from, at most about this many, picked by a hash.
TRAIN_ROWS = 6_000
WINDOW, STRIDE = 32, 16
WORD_CELLS, CHAR_CELLS = 1 << 16, 1 << 16
WIDTH, HIDDEN = 6, 8
EPOCHS, BATCH, RATE = 3, 256, 0.01
#: Small training sets are gone through more often, until so many steps are made.
LEAST_STEPS = 150
THRESHOLD = 0.3
#: Logit of a text without words.
NOTHING = -12.0


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Words:
    """The distinct words of a run of texts and where they stand."""

    word: np.ndarray  # cell of each distinct word
    chars: np.ndarray  # cells of all character groups of the distinct words
    heads: np.ndarray  # first group of each distinct word
    at: np.ndarray  # distinct word of each place
    bounds: np.ndarray  # first place of each text and the total


def read(texts: list[str | None]) -> Iterator[tuple[int, Words]]:
    for first, raw in W.chunks([t.lower() if isinstance(t, str) else t for t in texts]):
        buf, starts, ends, bounds = W.split(raw, "letters", lower=True)
        hashed, one, back = np.unique(W.hashes(buf, starts, ends), return_index=True, return_inverse=True)
        starts, ends = starts[one], ends[one]
        lengths = ends - starts
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(total[-1]) - np.repeat(total[:-1] - starts, lengths)
        begin, end = np.repeat(starts, lengths), np.repeat(ends, lengths)
        code = np.zeros(len(at), np.uint64)
        for step in (-1, 0, 1, 2):
            byte = buf[np.clip(at + step, 0, len(buf) - 1)].astype(np.uint64)
            code = (code << np.uint64(8)) | np.where(at + step < begin, 1, np.where(at + step >= end, 2, byte)).astype(np.uint64)
        chars = (W.mix(code) % np.uint64(CHAR_CELLS)).astype(np.int32)
        yield first, Words((hashed % np.uint64(WORD_CELLS)).astype(np.int32), chars, total[:-1], back.astype(np.int32), bounds)


def _evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Lower bound of the log odds of each cell, at least 0."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.maximum(0, odds - 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))).astype(np.float32)


def window_starts(n: int) -> np.ndarray:
    """First words of the overlapping windows of a text of n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


class Network:
    """Parameters, windows' logits and training of the recurrent network."""

    def __init__(self, word_evidence: np.ndarray, char_evidence: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.word_evidence, self.char_evidence = word_evidence, char_evidence
        inputs, gates = 2 * WIDTH + 2, 3 * HIDDEN
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        self.p = {"word": zero(WORD_CELLS, WIDTH), "char": zero(CHAR_CELLS, WIDTH)}
        for side in "fb":
            self.p |= {f"W{side}": draw(inputs, gates), f"U{side}": draw(HIDDEN, gates), f"b{side}": zero(gates)}
        self.p |= {"A": draw(2 * HIDDEN, HIDDEN), "v": draw(HIDDEN), "w": draw(2 * HIDDEN), "c": zero(1)}
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, t: Words) -> np.ndarray:
        """Input vector of each distinct word."""
        if not len(t.word):
            return np.zeros((0, 2 * WIDTH + 2), np.float32)
        sizes = np.diff(np.append(t.heads, len(t.chars)))[:, None]
        return np.concatenate(
            [
                self.p["word"][t.word],
                self.word_evidence[t.word][:, None],
                np.add.reduceat(self.p["char"][t.chars], t.heads, axis=0) / sizes,
                np.maximum.reduceat(self.char_evidence[t.chars], t.heads)[:, None],
            ],
            axis=1,
        ).astype(np.float32)

    def _pass(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, side: str, keep: list | None):
        """States of one direction for windows `at` (windows x words)."""
        n, h = at.shape[0], np.zeros((at.shape[0], HIDDEN), np.float32)
        states = np.zeros((WINDOW, n, HIDDEN), np.float32)
        U = self.p["U" + side]
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            g, u = gates[at[:, t]], h @ U
            zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r, un = zr[:, :HIDDEN], zr[:, HIDDEN:], u[:, 2 * HIDDEN :]
            new = np.tanh(g[:, 2 * HIDDEN :] + r * un)
            before = h
            h = (new + z * (h - new)) * mask[:, t : t + 1]
            states[t] = h
            if keep is not None:
                keep.append((t, before, z, r, un, new))
        return states

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; `at` holds distinct words, `mask` 1 where there is a word."""
        steps = {side: [] if keep is not None else None for side in "fb"}
        states = np.concatenate(
            [self._pass(x @ self.p["W" + s] + self.p["b" + s], at, mask, s, steps[s]) for s in "fb"], axis=2
        )
        hidden = np.tanh(states @ self.p["A"])
        weight = hidden @ self.p["v"] + (mask.T - 1) * 1e4
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep |= {"steps": steps, "states": states, "hidden": hidden, "weight": weight, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["c"][0]

    def gradients(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss; `x` is the gradient of the distinct words' inputs."""
        k: dict = {}
        logit = self.forward(x, at, mask, k)
        p, g = self.p, {}
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["w"], g["c"] = d @ k["pooled"], np.array([d.sum()])
        pooled = d[:, None] * p["w"]
        by_weight = (k["states"] * pooled).sum(axis=2)
        score = k["weight"] * (by_weight - (k["weight"] * by_weight).sum(axis=0))
        g["v"] = np.einsum("tn,tnh->h", score, k["hidden"])
        inner = score[:, :, None] * p["v"] * (1 - k["hidden"] ** 2)
        g["A"] = np.einsum("tni,tnh->ih", k["states"], inner)
        states = k["weight"][:, :, None] * pooled + inner @ p["A"].T
        g["x"] = np.zeros_like(x)
        for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            U, carry = p["U" + side], np.zeros((len(at), HIDDEN), np.float32)
            g["U" + side], gate = np.zeros_like(U), np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, before, z, r, un, new in reversed(k["steps"][side]):
                h = (states[t][:, part] + carry) * mask[:, t : t + 1]
                d_new = h * (1 - z) * (1 - new**2)
                d_z = h * (before - new) * z * (1 - z)
                d_r = d_new * un * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g["U" + side] += before.T @ d_u
                carry = h * z + d_u @ U.T
                np.add.at(gate, at[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
            g["W" + side], g["b" + side] = x.T @ gate, gate.sum(axis=0)
            g["x"] += gate @ p["W" + side].T
        return g

    def fit(self, words: list[Words], owner: np.ndarray, start: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Adam over windows: `owner` is the run of texts of a window, `start` its first place, y its label."""
        rng = np.random.default_rng(seed)
        moments = {name: [np.zeros_like(v), np.zeros_like(v)] for name, v in self.p.items()}
        step = 0
        for _ in range(max(EPOCHS, -(-LEAST_STEPS // max(1, -(-len(y) // BATCH))))):
            order = rng.permutation(len(y))
            for a in range(0, len(order), BATCH):
                part = order[a : a + BATCH]
                places, masks, cells = [], [], []
                for i in part:
                    t, s, n = words[owner[i]], *start[i]
                    mask = np.zeros(WINDOW, np.float32)
                    mask[:n] = 1
                    cells.append(t.at[s : s + n])
                    masks.append(mask)
                    places.append(owner[i])
                # The distinct words of the batch, with their inputs.
                keys = np.concatenate([c.astype(np.int64) + (o << 32) for c, o in zip(cells, np.array(places, np.int64))])
                known, back = np.unique(keys, return_inverse=True)
                batch = _gather(words, known)
                at = np.zeros((len(part), WINDOW), np.int64)
                at[np.array(masks) > 0] = back
                x = self.inputs(batch)
                g = self.gradients(x, at, np.array(masks), y[part])
                gx = g.pop("x")
                g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
                np.add.at(g["word"], batch.word, gx[:, :WIDTH])
                sizes = np.diff(np.append(batch.heads, len(batch.chars)))
                np.add.at(g["char"], batch.chars, np.repeat(gx[:, WIDTH + 1 : -1] / sizes[:, None], sizes, axis=0))
                step += 1
                for name, grad in g.items():
                    m, v = moments[name]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad**2 - v)
                    self.p[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                # Unseen words have a zero vector; the learned ones stay near it.
                self.p["word"] *= 0.999
                self.p["char"] *= 0.999

    def logits(self, t: Words) -> np.ndarray:
        """Highest window logit of each text."""
        out = np.full(len(t.bounds) - 1, NOTHING)
        x = self.inputs(t)
        counts = np.diff(t.bounds)
        starts = [window_starts(n) for n in counts.tolist()]
        sizes = np.array([len(s) for s in starts])
        if not sizes.sum():
            return out
        doc = np.repeat(np.arange(len(counts)), sizes)
        first = np.concatenate(starts) + t.bounds[doc]
        best = np.empty(len(first))
        for a in range(0, len(first), 4096):
            place = first[a : a + 4096, None] + np.arange(WINDOW)
            inside = place < t.bounds[doc[a : a + 4096] + 1][:, None]
            at = t.at[np.minimum(place, len(t.at) - 1)]
            best[a : a + 4096] = self.forward(x, at, inside.astype(np.float32))
        full = np.flatnonzero(sizes)
        out[full] = np.maximum.reduceat(best, (np.cumsum(sizes) - sizes)[full])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, t in read(texts):
            raw = self.logits(t)
            out[first : first + len(raw)] = _sigmoid(self.slope * raw + self.shift)
        return out


def _gather(words: list[Words], keys: np.ndarray) -> Words:
    """The distinct words named by (run << 32 | word) as one set."""
    cells, chars = [], []
    for key in keys.tolist():
        t, k = words[key >> 32], key & 0xFFFFFFFF
        cells.append(t.word[k])
        end = t.heads[k + 1] if k + 1 < len(t.heads) else len(t.chars)
        chars.append(t.chars[t.heads[k] : end])
    sizes = np.array([len(c) for c in chars])
    return Words(np.array(cells, np.int32), np.concatenate(chars), np.cumsum(sizes) - sizes, np.zeros(0), np.zeros(0))


def learn(texts: list[str | None], labels: np.ndarray) -> Network:
    """A network from labelled texts, on the driver; the caller bounds their number."""
    runs = list(read(texts))
    counts = {kind: np.zeros((2, n)) for kind, n in (("word", WORD_CELLS), ("char", CHAR_CELLS))}
    for first, t in runs:
        ends = np.append(t.heads[1:], len(t.chars))
        for d in range(len(t.bounds) - 1):
            found = np.unique(t.at[t.bounds[d] : t.bounds[d + 1]])
            row = int(labels[first + d])
            counts["word"][row, np.unique(t.word[found])] += 1
            if len(found):
                counts["char"][row, np.unique(np.concatenate([t.chars[t.heads[k] : ends[k]] for k in found]))] += 1
    n = np.bincount(labels.astype(int), minlength=2)
    network = Network(
        _evidence(counts["word"][1], counts["word"][0], n[1], n[0]),
        _evidence(counts["char"][1], counts["char"][0], n[1], n[0]),
    )
    if not n.all():
        # One class only: nothing to tell apart, every text gets the share of toxic ones.
        share = min(max(n[1] / max(1, n.sum()), 1e-3), 1 - 1e-3)
        network.slope, network.shift = 0.0, float(np.log(share / (1 - share)))
        return network
    rng = np.random.default_rng(11)
    owner, start, y = [], [], []
    for run, (first, t) in enumerate(runs):
        if not len(t.word):
            continue
        strength = (network.word_evidence[t.word] + np.maximum.reduceat(network.char_evidence[t.chars], t.heads))[t.at]
        for d in range(len(t.bounds) - 1):
            a, b = t.bounds[d], t.bounds[d + 1]
            begins = window_starts(int(b - a))
            if not len(begins):
                continue
            held = np.array([strength[a + s : min(b, a + s + WINDOW)].max() for s in begins])
            toxic = bool(labels[first + d])
            if toxic and held.max() <= 0:
                continue
            # The most telling windows stand for a toxic text; a clean text gives those and a random one.
            chosen = np.argsort(-held, kind="stable")[:2] if not toxic else np.flatnonzero(held >= held.max() * 0.7)[:4]
            for s in [*begins[chosen], *([] if toxic else [begins[rng.integers(len(begins))]])]:
                owner.append(run)
                start.append((int(a + s), int(min(WINDOW, b - a - s))))
                y.append(float(toxic))
    network.fit([t for _, t in runs], np.array(owner), np.array(start), np.array(y, np.float32))
    raw = np.concatenate([network.logits(t) for _, t in runs])
    network.slope, network.shift = _logistic(raw, labels.astype(float))
    return network


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, with a weak pull to (1, 0)."""
    theta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = _sigmoid(design @ theta)
        gradient = design.T @ (p - y) + 0.1 * (theta - [1.0, 0.0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, gradient)
    return float(max(theta[0], 1e-3)), float(theta[1])


def train(docs: DataFrame, label_col: str = "toxic", text_col: str = "text", rows: int = TRAIN_ROWS, key: Column | None = None) -> Network:
    """Learn from rows with a text and a label of 0 or 1, at most about `rows` of them, picked by a hash."""
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    n = known.count()
    key = F.xxhash64(text_col) if key is None else key
    if n > rows:
        known = known.where(F.pmod(key, F.lit(1_000_000)) < int(1_000_000 * rows / n))
    held = known.select(F.col(text_col).cast("string").alias("t"), (F.col(label_col) > 0).cast("int").alias("y")).toArrow()
    order = np.lexsort((held.column("y").to_numpy(), [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in held.column("t").to_pylist()]))
    texts, labels = held.column("t").to_pylist(), held.column("y").to_numpy()
    return learn([texts[i] for i in order], labels[order])


def score(docs: DataFrame, network: Network, text_col: str = "text", score_col: str = "score", pred_col: str = "predicted") -> DataFrame:
    """Add a score from 0 to 1 and the prediction (1 from a score of 0.3).

    Every window of every whole text is scored. Null, empty and wordless texts get the score of a
    text without evidence, near 0. Rows stay in place and are independent, so ties and repeated rows
    need no rule; other columns are kept, same-named ones replaced; an empty table stays empty.
    """
    size = sum(v.nbytes for v in network.p.values()) + network.word_evidence.nbytes + network.char_evidence.nbytes
    shared = checked_broadcast(docs.sparkSession, network, size, "the network")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.scores(batch.to_pylist()), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    scored = F.arrow_udf(run, "double")(F.col(text_col).cast("string"))
    return docs.withColumn(score_col, scored).withColumn(pred_col, (F.col(score_col) >= THRESHOLD).cast("int"))
