"""Toxicity: bidirectional gated recurrent networks with attention pooling, in numpy.

A word is read twice: as a whole, by a hashed embedding and the evidence that its spelling
carries in the labelled sample, and letter by letter, by a bidirectional gated recurrent
unit over letter embeddings and the evidence of the prefix read so far, pooled by
attention.  Windows of ``WINDOW`` words that overlap by half are read by a second
bidirectional unit over the words, pooled by attention, and end in one logit.  A
document's score is that of its worst window; all windows of a text are scored.

Evidence is the z-score of a spelling's log-odds between toxic and other documents of the
sample; in training, a document's own fold is left out of it.  Windows of toxic documents
are not labelled: rounds alternate between choosing each one's worst windows with the
network of the round before (with the evidence alone at first) and training on them:
three rounds of two passes each.

The classifier is fitted on at most ``SAMPLE`` toxic and ``SAMPLE_OTHERS`` other documents of
any length, the first by a hash of doc_id; of a text of more than ``SAMPLE_CHARS`` code
points so many are taken, in stretches that are spread evenly over all of it.  These
bounds hold the driver's work and memory.  Every text is scored whole.

Defined results: null and empty texts are scored as a text without words, which has one
empty window; long words are read in pieces of ``LETTERS`` letters, none left out;
repeated rows give repeated results; a document with labels of both kinds counts as toxic;
without a label of either kind every score is 0; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, in_arrow, slices, whole_text

WINDOW = 32
STRIDE = WINDOW // 2
LETTERS = 12
SAMPLE = 600
SAMPLE_OTHERS = 900
SAMPLE_CHARS, STRETCH = 40_000, 2_000
#: Windows of a toxic document that are trained on in a pass, at most an eighth of them.
MOST_WORST = 12
FOLDS = 5
EVIDENCE_BITS = 18
WORD_BUCKETS = 4_096
LETTER_KINDS = 256
LETTER_UNITS = 6
WORD_UNITS = 8
#: Documents and bytes of text that are scored at once, unless one document has more.
RUN_ROWS, RUN_BYTES = 128, 1 << 20
_KEPT_WORDS = 150_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Adam:
    """Adam over a dictionary of arrays."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.parameters, self.rate, self.steps = parameters, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.second = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in gradients.items():
            g = g * scale
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            m = self.first[k] / (1 - 0.9**self.steps)
            v = self.second[k] / (1 - 0.999**self.steps)
            self.parameters[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


def _unit_parameters(rng, prefix: str, inputs: int, units: int) -> dict[str, np.ndarray]:
    """A bidirectional unit and the attention over its states."""
    out = {}
    for way in "fb":
        out[f"{prefix}_{way}_x"] = rng.normal(0, inputs**-0.5, (inputs, 3 * units))
        out[f"{prefix}_{way}_h"] = rng.normal(0, units**-0.5, (units, 3 * units))
        out[f"{prefix}_{way}_b"] = np.zeros(3 * units)
    out[f"{prefix}_a"] = rng.normal(0, units**-0.5, (2 * units, units))
    out[f"{prefix}_v"] = rng.normal(0, units**-0.5, units)
    return {k: v.astype(np.float32) for k, v in out.items()}


def _run(p: dict, name: str, projected: np.ndarray, mask: np.ndarray, keep: bool):
    """States of one direction over projected inputs (T, N, 3H); mask (T, N, 1)."""
    steps, rows, wide = projected.shape
    units = wide // 3
    recurrent = p[f"{name}_h"]
    h = np.zeros((rows, units), np.float32)
    states = np.empty((steps, rows, units), np.float32)
    kept = []
    for t in range(steps):
        inner = h @ recurrent
        gates = _sigmoid(projected[t, :, : 2 * units] + inner[:, : 2 * units])
        reset, update = gates[:, :units], gates[:, units:]
        new = np.tanh(projected[t, :, 2 * units :] + reset * inner[:, 2 * units :])
        if keep:
            kept.append((h, inner[:, 2 * units :], reset, update, new))
        h = h + mask[t] * (1 - update) * (new - h)
        states[t] = h
    return states, kept


def _run_back(p: dict, name: str, grads: dict, kept: list, mask: np.ndarray, upstream: np.ndarray) -> np.ndarray:
    """Gradient of the projected inputs; adds that of the recurrent weights."""
    units = upstream.shape[2]
    recurrent = p[f"{name}_h"]
    out = np.zeros((*upstream.shape[:2], 3 * units), np.float32)
    carried = np.zeros(upstream.shape[1:], np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, inner_new, reset, update, new = kept[t]
        d = carried + upstream[t]
        live = d * mask[t]
        d_new = live * (1 - update) * (1 - new * new)
        d_update = -live * (new - h) * update * (1 - update)
        d_reset = d_new * inner_new * reset * (1 - reset)
        out[t, :, :units], out[t, :, units : 2 * units], out[t, :, 2 * units :] = d_reset, d_update, d_new
        d_inner = np.concatenate([d_reset, d_update, d_new * reset], axis=1)
        grads[f"{name}_h"] += h.T @ d_inner
        carried = d - live * (1 - update) + d_inner @ recurrent.T
    return out


def _project(p: dict, prefix: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(x @ p[f"{prefix}_{way}_x"] + p[f"{prefix}_{way}_b"] for way in "fb")


def _read(p: dict, prefix: str, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Both directions and attention pooling: (N, 2H)."""
    m = mask[:, :, None]
    ahead, kept_f = _run(p, f"{prefix}_f", forward, m, keep)
    behind, kept_b = _run(p, f"{prefix}_b", backward[::-1], m[::-1], keep)
    states = np.concatenate([ahead, behind[::-1]], axis=2)
    hidden = np.tanh(states @ p[f"{prefix}_a"])
    energy = np.where(mask > 0, hidden @ p[f"{prefix}_v"], np.float32(-1e9))
    share = np.exp(energy - energy.max(0))
    share = share * mask
    share /= share.sum(0) + 1e-9
    return (states * share[:, :, None]).sum(0), (m, kept_f, kept_b, states, hidden, share)


def _read_back(p: dict, prefix: str, grads: dict, kept, upstream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m, kept_f, kept_b, states, hidden, share = kept
    d_states = share[:, :, None] * upstream[None]
    d_share = (states * upstream[None]).sum(2)
    d_energy = share * (d_share - (share * d_share).sum(0))
    grads[f"{prefix}_v"] += (hidden * d_energy[:, :, None]).sum((0, 1))
    d_hidden = d_energy[:, :, None] * p[f"{prefix}_v"] * (1 - hidden * hidden)
    flat = states.reshape(-1, states.shape[2])
    grads[f"{prefix}_a"] += flat.T @ d_hidden.reshape(len(flat), -1)
    d_states += d_hidden @ p[f"{prefix}_a"].T
    units = states.shape[2] // 2
    d_f = _run_back(p, f"{prefix}_f", grads, kept_f, m, d_states[:, :, :units])
    d_b = _run_back(p, f"{prefix}_b", grads, kept_b, m[::-1], d_states[::-1, :, units:])
    return d_f, d_b[::-1]


def _project_back(p: dict, prefix: str, grads: dict, x: np.ndarray, d_f: np.ndarray, d_b: np.ndarray) -> np.ndarray:
    flat = x.reshape(-1, x.shape[-1])
    out = 0
    for way, d in (("f", d_f), ("b", d_b)):
        d2 = d.reshape(len(flat), -1)
        grads[f"{prefix}_{way}_x"] += flat.T @ d2
        grads[f"{prefix}_{way}_b"] += d2.sum(0)
        out = out + d @ p[f"{prefix}_{way}_x"].T
    return out


def words_of(text: str) -> list[str]:
    """Lower-case words without marks at their ends; long ones in pieces."""
    words = [w.strip(".,;:!?|()[]\"'*#%$&-_") for w in text.lower().split()]
    if words and max(map(len, words)) > LETTERS:
        words = [w[i : i + LETTERS] for w in words for i in range(0, max(1, len(w)), LETTERS)]
    return [w for w in words if w]


def windows_of(count: int) -> list[tuple[int, int]]:
    """All overlapping windows over so many words; one empty window over none."""
    last = max(0, count - STRIDE - 1) // STRIDE if count > WINDOW else 0
    return [(i * STRIDE, min(count, i * STRIDE + WINDOW)) for i in range(last + 1)]


@dataclass
class Spelled:
    """Distinct words as arrays: letter kinds, mask, prefix buckets, word buckets."""

    letters: np.ndarray
    mask: np.ndarray
    prefixes: np.ndarray
    whole: np.ndarray
    word: np.ndarray
    length: np.ndarray


def spell(words: list[str]) -> Spelled:
    codes = np.zeros((len(words), LETTERS), np.uint64)
    joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    mask = np.arange(LETTERS)[None, :] < length[:, None]
    codes[mask] = joined
    rolling = np.full(len(words), 0x51ED270B, np.uint64)
    prefixes = np.empty(codes.shape, np.int64)
    shift = np.uint64(64 - EVIDENCE_BITS)
    golden = np.uint64(0x9E3779B97F4A7C15)
    for i in range(LETTERS):
        rolling = np.where(mask[:, i], (rolling ^ codes[:, i]) * np.uint64(0x100000001B3) + np.uint64(i), rolling)
        prefixes[:, i] = (rolling * golden) >> shift
    ended = (rolling ^ np.uint64(0x7E)) * golden
    return Spelled(
        (codes % np.uint64(LETTER_KINDS)).astype(np.int64),
        mask.astype(np.float32),
        prefixes,
        (ended >> shift).astype(np.int64),
        (ended >> np.uint64(52)).astype(np.int64) % WORD_BUCKETS,
        length,
    )


@dataclass
class Network:
    """Parameters and evidence of a fitted classifier."""

    parameters: dict[str, np.ndarray]
    evidence: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((1_024, 6 * WORD_UNITS), np.float32))

    def __getstate__(self):
        return {"parameters": self.parameters, "evidence": self.evidence}

    def __setstate__(self, state):
        self.__init__(state["parameters"], state["evidence"])

    def word_inputs(self, s: Spelled, evidence: np.ndarray, keep: bool = False):
        """Vectors of words, from letters, prefixes, spelling and hash."""
        p = self.parameters
        letters = np.concatenate([p["letter"][s.letters], evidence[s.prefixes][:, :, None]], axis=2)
        letters = np.ascontiguousarray(letters.transpose(1, 0, 2))
        pooled, kept = _read(p, "letters", *_project(p, "letters", letters), s.mask.T, keep)
        strongest = np.where(s.mask > 0, evidence[s.prefixes], np.float32(-9)).max(1)
        extra = np.stack([evidence[s.whole], np.maximum(strongest, -3), s.length.astype(np.float32) / LETTERS], axis=1)
        return np.concatenate([pooled, extra, p["word"][s.word]], axis=1), (letters, kept)

    def logits(self, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray) -> np.ndarray:
        pooled, _ = _read(self.parameters, "words", forward, backward, mask)
        return pooled @ self.parameters["out_w"] + self.parameters["out_b"][0]

    def _rows_of(self, words: list[str]) -> None:
        """Projected inputs of words not met lately."""
        if len(self.known) > _KEPT_WORDS:
            self.known = {}
        fresh = list(set(words).difference(self.known))
        for at in range(0, len(fresh), 8_192):
            part = fresh[at : at + 8_192]
            vectors, _ = self.word_inputs(spell(part), self.evidence)
            both = np.concatenate(_project(self.parameters, "words", vectors), axis=1)
            base, end = len(self.known), len(self.known) + len(part)
            if end > len(self.table):
                larger = np.zeros((max(end, 2 * len(self.table)), 6 * WORD_UNITS), np.float32)
                larger[:base] = self.table[:base]
                self.table = larger
            self.table[base:end] = both
            self.known.update(zip(part, range(base, end)))

    def window_scores(self, texts: list[str]) -> list[np.ndarray]:
        """Logits of all windows of each text."""
        worded = [words_of(t) for t in texts]
        self._rows_of([w for words in worded for w in words])
        places, spans = [], []
        for words in worded:
            rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            spans.append(windows_of(len(words)))
            places += [rows[a:b] for a, b in spans[-1]]
        table = self.table
        out = np.empty(len(places), np.float32)
        order = np.argsort([len(x) for x in places], kind="stable")
        for at in range(0, len(order), 1_024):
            chosen = order[at : at + 1_024]
            longest = max(1, max(len(places[i]) for i in chosen))
            index = np.zeros((longest, len(chosen)), np.int64)
            mask = np.zeros((longest, len(chosen)), np.float32)
            for column, i in enumerate(chosen):
                index[: len(places[i]), column] = places[i]
                mask[: len(places[i]), column] = 1
            inputs = table[index]
            half = 3 * WORD_UNITS
            out[chosen] = self.logits(inputs[:, :, :half], inputs[:, :, half:], mask)
        ends = np.cumsum([len(s) for s in spans])
        return np.split(out, ends[:-1])

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of each text's worst window."""
        if not len(self.parameters):
            return np.zeros(len(texts))
        worst = np.array([w.max() for w in self.window_scores(texts)], np.float64)
        return 1.0 / (1.0 + np.exp(-np.clip(worst, -30, 30)))


def _evidence(seen: list[np.ndarray], labels: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """z-scores of log-odds, of every bucket, from the documents in ``rows``."""
    size = 1 << EVIDENCE_BITS
    counts = [np.zeros(size), np.zeros(size)]
    for i in rows:
        counts[int(labels[i])][seen[i]] += 1
    toxic = max(1, int(labels[rows].sum()))
    clean = max(1, len(rows) - int(labels[rows].sum()))
    a, b = counts[1], counts[0]
    odds = np.log((a + 0.3) / (toxic + 0.6)) - np.log((b + 0.3) / (clean + 0.6))
    z = odds / np.sqrt(1 / (a + 0.3) + 1 / (b + 0.3))
    return np.where(a + b > 0, np.clip(z, -6, 9) / 3, 0).astype(np.float32)


def fit(texts: list[str], labels: list[int], seed: int = 0, rounds: int = 3, epochs: int = 2, rate: float = 0.01) -> Network:
    """Fit a network on whole texts and their labels."""
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Network({}, np.zeros(1, np.float32))
    rng = np.random.default_rng(seed)
    worded = [words_of(t) for t in texts]
    vocabulary = sorted({w for words in worded for w in words})
    place = {w: i for i, w in enumerate(vocabulary)}
    spelled = spell(vocabulary)
    rows = [np.array([place[w] for w in words], np.int64) for words in worded]
    seen = [
        np.unique(np.concatenate([spelled.prefixes[u][spelled.mask[u] > 0], spelled.whole[u]]))
        for u in map(np.unique, rows)
    ]
    folds = rng.permutation(len(labels)) % FOLDS
    everything = np.arange(len(labels))
    left_out = [_evidence(seen, labels, everything[folds != f]) for f in range(FOLDS)]
    network = Network({}, _evidence(seen, labels, everything))
    p = network.parameters
    p["letter"] = rng.normal(0, 0.3, (LETTER_KINDS, LETTER_UNITS)).astype(np.float32)
    p["word"] = rng.normal(0, 0.05, (WORD_BUCKETS, 4)).astype(np.float32)
    p |= _unit_parameters(rng, "letters", LETTER_UNITS + 1, LETTER_UNITS)
    p |= _unit_parameters(rng, "words", 2 * LETTER_UNITS + 3 + 4, WORD_UNITS)
    p["out_w"] = rng.normal(0, 0.3, 2 * WORD_UNITS).astype(np.float32)
    p["out_b"] = np.array([-1.0], np.float32)
    adam = Adam(p, rate)

    spans = [windows_of(len(r)) for r in rows]
    for turn in range(rounds):
        if turn == 0:
            strong = [np.maximum(left_out[folds[i]][spelled.whole[r]], np.where(spelled.mask[r] > 0, left_out[folds[i]][spelled.prefixes[r]], -9).max(1, initial=-9)) if len(r) else np.zeros(0) for i, r in enumerate(rows)]
            worst = [np.array([s[a:b].max(initial=-9) for a, b in w]) for s, w in zip(strong, spans)]
        else:
            worst = _worst(network, spelled, rows, spans, left_out, folds)
        others = np.concatenate([w for w, y in zip(worst, labels) if not y])
        hardest = np.sort(others)[-min(len(others), len(labels))]
        for epoch in range(epochs):
            chosen: list[tuple[int, int, int]] = []
            for i, w in enumerate(worst):
                if labels[i]:
                    take = np.argsort(-w, kind="stable")[: min(MOST_WORST, max(1, len(w) // 8))]
                else:
                    hard = np.flatnonzero(w >= hardest)[:40]
                    take = np.unique(np.concatenate([[w.argmax()], hard, rng.integers(0, len(w), 1)]))
                chosen += [(i, *spans[i][j]) for j in take]
            order = rng.permutation(len(chosen))
            if epoch == epochs - 1 and turn == rounds - 1:
                adam.rate = rate / 5
            for at in range(0, len(order), 128):
                _step(network, adam, spelled, rows, labels, left_out, folds, [chosen[k] for k in order[at : at + 128]])
    final = np.array([w.max() for w in _worst(network, spelled, rows, spans, left_out, folds)])
    slope, shift = _calibrated(final, labels)
    p["out_w"] *= slope
    p["out_b"] = p["out_b"] * slope + shift
    return network


def _calibrated(logits: np.ndarray, labels: np.ndarray) -> tuple[np.float32, np.float32]:
    """Slope and shift that make documents' worst logits into those of a probability."""
    x, y = np.clip(logits.astype(np.float64), -20, 20), labels.astype(np.float64)
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 0.1 * (slope - 1), (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(step[0], -0.5, 0.5), shift - np.clip(step[1], -1, 1)
    return np.float32(max(slope, 0.05)), np.float32(shift)


def _batch(spelled, rows, folds, left_out, chosen):
    """Distinct (word, fold) pairs of some windows, and the windows over them."""
    longest = max(1, max(b - a for _, a, b in chosen))
    index = np.zeros((longest, len(chosen)), np.int64)
    mask = np.zeros((longest, len(chosen)), np.float32)
    total = len(spelled.whole)
    for column, (i, a, b) in enumerate(chosen):
        index[: b - a, column] = rows[i][a:b] + total * folds[i]
        mask[: b - a, column] = 1
    pairs, inverse = np.unique(index, return_inverse=True)
    words, fold = pairs % max(1, total), pairs // max(1, total)
    return words, fold, inverse.reshape(index.shape), mask


def _inputs(network, spelled, left_out, words, fold, keep):
    s = Spelled(*(getattr(spelled, k)[words] for k in ("letters", "mask", "prefixes", "whole", "word", "length")))
    # One table of evidence per fold, looked up at (fold, bucket).
    size = 1 << EVIDENCE_BITS
    shifted = Spelled(s.letters, s.mask, s.prefixes + size * fold[:, None], s.whole + size * fold, s.word, s.length)
    return s, network.word_inputs(shifted, left_out, keep)


def _worst(network, spelled, rows, spans, left_out, folds) -> list[np.ndarray]:
    """Logits of all windows of the sample, each with its fold's evidence."""
    table = np.concatenate(left_out)
    out = []
    flat = [(i, a, b) for i, w in enumerate(spans) for a, b in w]
    for at in range(0, len(flat), 512):
        words, fold, index, mask = _batch(spelled, rows, folds, table, flat[at : at + 512])
        if not len(spelled.whole):
            out.append(np.zeros(index.shape[1], np.float32))
            continue
        _, (vectors, _) = _inputs(network, spelled, table, words, fold, False)
        forward, backward = _project(network.parameters, "words", vectors)
        out.append(network.logits(forward[index], backward[index], mask))
    ends = np.cumsum([len(s) for s in spans])
    return np.split(np.concatenate(out), ends[:-1])


def _step(network, adam, spelled, rows, labels, left_out, folds, chosen) -> None:
    p = network.parameters
    words, fold, index, mask = _batch(spelled, rows, folds, left_out, chosen)
    target = np.array([labels[i] for i, _, _ in chosen], np.float32)
    if not isinstance(left_out, np.ndarray):
        left_out = _joined(left_out)
    s, (vectors, (letters, kept_letters)) = _inputs(network, spelled, left_out, words, fold, True)
    x = vectors[index]
    pooled, kept = _read(p, "words", *_project(p, "words", x), mask, True)
    logit = pooled @ p["out_w"] + p["out_b"][0]
    weight = np.where(target > 0, 1.5, 1.0).astype(np.float32) / len(target)
    d_logit = (_sigmoid(logit) - target) * weight
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["out_w"] += pooled.T @ d_logit
    grads["out_b"][0] += d_logit.sum()
    d_f, d_b = _read_back(p, "words", grads, kept, d_logit[:, None] * p["out_w"])
    d_x = _project_back(p, "words", grads, x, d_f, d_b)
    d_vectors = np.zeros_like(vectors)
    np.add.at(d_vectors, index.ravel(), d_x.reshape(-1, d_x.shape[2]))
    wide = 2 * LETTER_UNITS
    np.add.at(grads["word"], s.word, d_vectors[:, wide + 3 :])
    d_f, d_b = _read_back(p, "letters", grads, kept_letters, d_vectors[:, :wide])
    d_letters = _project_back(p, "letters", grads, letters, d_f, d_b)[:, :, :LETTER_UNITS]
    np.add.at(grads["letter"], s.letters.T.ravel(), (d_letters * s.mask.T[:, :, None]).reshape(-1, LETTER_UNITS))
    adam.step(grads)


_tables: dict[int, np.ndarray] = {}


def _joined(left_out: list[np.ndarray]) -> np.ndarray:
    key = id(left_out)
    if key not in _tables:
        _tables.clear()
        _tables[key] = np.concatenate(left_out)
    return _tables[key]


def held_out(doc_id):
    """Whether a document's labels are kept from training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded sample of labelled texts, outside of the held-out rows."""
    named = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    fit_for = named.join(texts.where("text <> ''").select("doc_id").distinct(), "doc_id")
    chosen = []
    for toxic, most in ((1, SAMPLE), (0, SAMPLE_OTHERS)):
        first = fit_for.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen += [(r["doc_id"], toxic) for r in first.select("doc_id").collect()]
    # The chosen ids are at most SAMPLE + SAMPLE_OTHERS; with them texts are fetched by a scan.
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    parts = SAMPLE_CHARS // STRETCH
    stretches = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda i: F.substr("text", (i * (F.length("text") - STRETCH) / (parts - 1)).cast("int") + 1, F.lit(STRETCH)),
    )
    taken = F.when(F.length("text") <= SAMPLE_CHARS, F.col("text")).otherwise(F.array_join(stretches, " "))
    rows = (
        texts.join(F.broadcast(ids), "doc_id")
        .select("doc_id", "toxic", taken.alias("text"))
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
    )
    got = sorted(rows.collect(), key=lambda r: (r["toxic"], r["doc_id"]))
    return [(r["text"], r["toxic"]) for r in got]


def fitted(docs: DataFrame, labels: DataFrame) -> Network:
    """A network fitted on the labelled sample of ``docs``."""
    got = sample(docs, labels)
    return fit([t for t, _ in got], [y for _, y in got])



def score_documents(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(network)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        model = shipped.value
        for batch in batches:
            for part in slices(batch, RUN_ROWS, RUN_BYTES):
                scores = model.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], schema=out)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return in_arrow(plain, run, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, network: Network) -> DataFrame:
    """The documents whose score is below one half, with all their columns; null and empty
    texts are scored as such, and repeated rows stay or go together."""
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    at = [name.lower() for name in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        model = shipped.value
        for batch in batches:
            for part in slices(batch, RUN_ROWS, RUN_BYTES):
                texts = pc.fill_null(part.column(at).cast(pa.string()), "").to_pylist()
                yield part.filter(pa.array(model.scores(texts) < 0.5))

    return in_arrow(docs, run, docs.schema)


def remainder(doc_id: int | None) -> int | None:
    """crc32 of the id as text, modulo 5, as the queries use it."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5
