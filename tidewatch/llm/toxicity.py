"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of its own embedding and the mean of the embeddings of
its character n-grams; only words and n-grams of several training documents have
one, so that no rare word can stand for a document. A very long word enters as
overlapping pieces, each a word of its own. Texts are cut into overlapping windows of
words; each direction's gated recurrence runs over a window, attention pools the
states, and a window's logit follows. Documents are labelled, windows are not:
training joins a document's windows by noisy-or. A document scores by its most
toxic window. The network is trained in numpy on a bounded sample of labelled
rows; scoring covers all windows of all texts, whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import column, slices, texts

WINDOW, STRIDE = 64, 48
EMBED, HIDDEN = 12, 8
LEAST_DOCUMENTS, MOST_ENTRIES = 4, 200_000
SAMPLE_PER_CLASS = 1500
#: UTF-8 bytes of a text that may enter the training sample, which so holds 2 * SAMPLE_PER_CLASS * SAMPLE_TEXT_BYTES at most.
SAMPLE_TEXT_BYTES = 48_000
TRAIN_DOCUMENTS = 14_000
BATCH_WINDOWS = 384
CACHE_WORDS = 200_000
LONGEST_WORD, SHARED = 46, 4
BATCH_ROWS = 500
FOLDS, HELD_OUT = 5, 0
DECAYED, DECAY, CLEARLY = ("word", "char"), 10.0, 3.0
F32 = np.float32

_EDGE = bytes(c for c in range(128) if not (48 <= c < 58 or 97 <= c < 123))


def words_of(text: bytes | None) -> list[bytes]:
    """Words between white space, those too long in pieces."""
    words = text.lower().split() if text else []
    if max(map(len, words), default=0) < LONGEST_WORD:
        return words
    return [piece for w in words for piece in (pieces_of(w) if len(w) >= LONGEST_WORD else (w,))]


def pieces_of(word: bytes) -> list[bytes]:
    """A word less its edges, if longer than LONGEST_WORD characters in pieces of that many; neighbours share SHARED characters or more, so every n-gram is in one."""
    bare = (word.strip(_EDGE) or word).decode("utf-8")
    starts = [*range(0, len(bare) - LONGEST_WORD, LONGEST_WORD - SHARED), max(0, len(bare) - LONGEST_WORD)]
    return [bare[s : s + LONGEST_WORD].encode("utf-8") for s in starts]


def bare_word(word: bytes) -> bytes:
    """word less its edges; a piece as it is."""
    if len(word) >= LONGEST_WORD and len(word.decode("utf-8")) >= LONGEST_WORD:
        return word
    return word.strip(_EDGE) or word


def grams_of(bares: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its word) of all character 3- and 5-grams of the words between their ends."""
    marked = [f"^{b.decode('utf-8')}$" for b in bares]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    found = []
    for k in (3, 5):
        n = max(0, len(codes) - k + 1)
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + codes[i : i + n]
        inside = owner[:n] == owner[k - 1 : k - 1 + n]
        found.append((h[inside], owner[:n][inside]))
    return np.concatenate([h for h, _ in found]), np.concatenate([o for _, o in found])


def vocabularies(documents: list[list[bytes]]) -> tuple[dict[bytes, int], np.ndarray]:
    """Words, numbered from 1, and sorted n-gram hashes that LEAST_DOCUMENTS documents hold, the most frequent first if there are too many."""
    words: Counter = Counter()
    for d in documents:
        words.update({bare_word(w) for w in set(d)})
    frequent = sorted((w for w, n in words.items() if n >= LEAST_DOCUMENTS), key=lambda w: (-words[w], w))[:MOST_ENTRIES]
    bares = list(words)
    h, owner = grams_of(bares)
    known, inverse = np.unique(h, return_inverse=True)
    n = np.bincount(inverse, np.array([words[b] for b in bares], np.float64)[owner], len(known)) if len(known) else np.empty(0)
    order = np.lexsort((known, -n))[:MOST_ENTRIES]
    return {w: i for i, w in enumerate(frequent, 1)}, np.sort(known[order][n[order] >= LEAST_DOCUMENTS])


def association(held: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Where embeddings begin, and what decay draws them to: how far an entry's toxic documents pass their usual share, in standard deviations, if clearly."""
    z = (toxic - held * share) / np.sqrt(np.maximum(held * share * (1 - share), 1e-9))
    return np.where(np.abs(z) > CLEARLY, np.clip(z / CLEARLY, -1, 2.5), 0).astype(F32)


def set_out(p: dict, documents: list[list[bytes]], y: np.ndarray) -> None:
    """Set the first value of word embeddings and the second of n-gram embeddings by their association with the label."""
    words, grams = p["words"], p["grams"]
    held, toxic = np.zeros((2, len(words) + 1)), np.zeros((2, len(grams) + 1))
    for d, label in zip(documents, y, strict=True):
        bares = {bare_word(w) for w in set(d)}
        found = [words[b] for b in bares if b in words]
        held[label, found] += 1
        h = np.unique(grams_of(list(bares))[0])
        place = np.searchsorted(grams, h)
        place[place == len(grams)] = 0
        if len(grams):
            toxic[label, place[grams[place] == h] + 1] += 1
    share = float(y.mean())
    p["word"][:, 0] = association(held.sum(axis=0), held[1], share)
    p["char"][:, 1] = association(toxic.sum(axis=0), toxic[1], share)
    p["word"][0] = p["char"][0] = 0


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping (start, end) windows that cover n words; one empty window if there are none."""
    out = [(0, min(n, WINDOW))]
    while out[-1][1] < n:
        start = out[-1][0] + STRIDE
        out.append((start, min(n, start + WINDOW)))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * (np.tanh(F32(0.5) * x) + F32(1))


def new_parameters(words: dict[bytes, int], grams: np.ndarray, seed: int = 0) -> dict:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(F32)
    p = {"words": words, "grams": grams, "word": np.zeros((len(words) + 1, EMBED), F32), "char": np.zeros((len(grams) + 1, EMBED), F32)}
    for d in "fb":
        p |= {f"W{d}": draw(EMBED, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, F32), f"U{d}": draw(HIDDEN, 3 * HIDDEN)}
    p |= {"A": draw(2 * HIDDEN, HIDDEN), "v": draw(HIDDEN, 1), "u": draw(2 * HIDDEN, 1), "c": np.full(1, -4, F32)}
    return p


def _recur(gates: np.ndarray, mask: np.ndarray, U: np.ndarray, order: range, keep: list | None) -> np.ndarray:
    """States [T, B, h] of one direction; gates are the words' input projections."""
    steps, rows, _ = gates.shape
    h = np.zeros((rows, HIDDEN), F32)
    out = np.empty((steps, rows, HIDDEN), F32)
    for t in order:
        hu = h @ U
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        if keep is not None:
            keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
        h = np.where(mask[t][:, None], new, h)
        out[t] = h
    return out


def window_logits(p: dict[str, np.ndarray], gf: np.ndarray, gb: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
    """Logit of each window, from gates [T, B, 3h] of both directions and a mask [T, B]."""
    steps = len(mask)
    kf, kb = ([], []) if trace is not None else (None, None)
    states = np.concatenate([_recur(gf, mask, p["Uf"], range(steps), kf), _recur(gb, mask, p["Ub"], range(steps - 1, -1, -1), kb)], axis=2)
    act = np.tanh(states @ p["A"])
    score = np.where(mask, (act @ p["v"])[:, :, 0], F32(-1e9))
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    weight = np.where(mask, weight, F32(0))
    pooled = (weight[:, :, None] * states).sum(axis=0)
    if trace is not None:
        trace |= {"kf": kf, "kb": kb, "states": states, "act": act, "weight": weight, "pooled": pooled}
    return (pooled @ p["u"])[:, 0] + p["c"]


def _recur_back(d_out: np.ndarray, kept: list, mask: np.ndarray, U: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates and of U."""
    d_gates = np.zeros((*d_out.shape[:2], 3 * HIDDEN), F32)
    dU, dh = np.zeros_like(U), np.zeros(d_out.shape[1:], F32)
    for t, h, z, r, n, hu in reversed(kept):
        dh = dh + d_out[t]
        live = mask[t][:, None]
        d_new = np.where(live, dh, F32(0))
        dn = d_new * (1 - z) * (1 - n * n)
        dz, dr = d_new * (h - n) * z * (1 - z), dn * hu * r * (1 - r)
        d_gates[t] = np.concatenate([dz, dr, dn], axis=1)
        d_hu = np.concatenate([dz, dr, dn * r], axis=1)
        dU += h.T @ d_hu
        dh = np.where(live, d_new * z, dh) + d_hu @ U.T
    return d_gates, dU


def gradients(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, doc_of: np.ndarray, label: np.ndarray, class_weight: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """(loss, gradients of the dense parameters, gradient of x) of documents whose windows join by noisy-or.

    x: inputs [T, B, e]; doc_of: each window's document; label: each document's.
    """
    tr: dict = {}
    logit = window_logits(p, x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"], mask, tr)
    soft = np.logaddexp(0, logit)  # -log P(window clean)
    clean = np.bincount(doc_of, soft, len(label))
    toxic = np.clip(-np.expm1(-clean), 1e-6, 1)
    loss = np.where(label == 1, -np.log(toxic), clean)
    d_clean = np.where(label == 1, -np.exp(-clean) / toxic, 1.0) * class_weight
    d_logit = (d_clean[doc_of] * _sigmoid(logit)).astype(F32) / len(label)
    g = {"c": np.array([d_logit.sum()], F32), "u": tr["pooled"].T @ d_logit[:, None]}
    d_pool = d_logit[:, None] * p["u"][:, 0]
    states, weight, act = tr["states"], tr["weight"], tr["act"]
    d_weight = (states * d_pool).sum(axis=2)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["v"] = np.einsum("tbh,tb->h", act, d_score)[:, None]
    d_act = d_score[:, :, None] * p["v"][:, 0] * (1 - act * act)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    g["A"] = flat(states).T @ flat(d_act)
    d_states = weight[:, :, None] * d_pool + d_act @ p["A"].T
    dx = np.zeros_like(x)
    for d, own, kept in (("f", d_states[:, :, :HIDDEN], tr["kf"]), ("b", d_states[:, :, HIDDEN:], tr["kb"])):
        d_gates, g[f"U{d}"] = _recur_back(own, kept, mask, p[f"U{d}"])
        g[f"W{d}"], g[f"b{d}"] = flat(x).T @ flat(d_gates), flat(d_gates).sum(axis=0)
        dx += d_gates @ p[f"W{d}"].T
    return float((loss * class_weight).mean()), g, dx


class Lexicon:
    """Distinct words of some documents with the embeddings they have."""

    def __init__(self, documents: list[list[bytes]], words: dict[bytes, int], grams: np.ndarray) -> None:
        known: dict[bytes, int] = {}
        self.ids = [np.fromiter((known.setdefault(w, len(known)) for w in d), np.int64, len(d)) for d in documents]
        bares = list(map(bare_word, known))
        self.word = np.fromiter((words.get(b, 0) for b in bares), np.int64, len(bares))
        h, owner = grams_of(bares)
        place = np.searchsorted(grams, h)
        held = place < len(grams)
        held[held] = grams[place[held]] == h[held]
        order = np.argsort(owner[held], kind="stable")
        self.char, self.owner = place[held][order] + 1, owner[held][order]
        self.share = (1 / np.maximum(1, np.bincount(self.owner, minlength=len(known)))).astype(F32)
        self.first = np.searchsorted(self.owner, np.arange(len(known) + 1))

    def grams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(char slots, index into ids) of all n-grams of the words."""
        lengths = self.first[ids + 1] - self.first[ids]
        owner = np.repeat(np.arange(len(ids)), lengths)
        start = np.repeat(self.first[ids] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        return self.char[start + np.arange(len(owner))], owner


def train(documents: list[list[bytes]], labels: list[int], budget: int = TRAIN_DOCUMENTS, seed: int = 0) -> dict:
    """Adam over documents in shuffled order, `budget` of them in all; then a calibration of the maximum on these documents.

    Without examples of both classes the network stays as it begins.
    """
    words, grams = vocabularies(documents)
    p = new_parameters(words, grams, seed)
    y = np.array(labels, np.int64)
    p["scale"], p["shift"] = np.ones(1, F32), np.zeros(1, F32)
    if len(set(labels)) < 2:
        return p
    set_out(p, documents, y)
    origin = {k: p[k].copy() for k in DECAYED}
    rng, lex = np.random.default_rng(seed), Lexicon(documents, words, grams)
    cuts = [windows_of(len(d)) for d in documents]
    moments = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in p.items() if k not in ("scale", "shift", "words", "grams")}
    step, seen = 0, 0
    share = np.array([0.5 / (y == 0).mean(), 0.5 / (y == 1).mean()]) ** 0.5
    while seen < budget:
        order = rng.permutation(len(documents))
        at = 0
        while at < len(order) and seen < budget:
            chosen, n = [], 0
            while at < len(order) and (n < BATCH_WINDOWS):
                chosen.append(order[at])
                n += len(cuts[order[at]])
                at += 1
            ids, mask, doc_of = _lay([(lex.ids[i], cuts[i]) for i in chosen])
            own, inverse = np.unique(ids, return_inverse=True)
            chars, owner = lex.grams(own)
            mean = np.zeros((len(own), EMBED), F32)
            np.add.at(mean, owner, p["char"][chars])
            mean *= lex.share[own][:, None]
            x = (p["word"][lex.word[own]] + mean)[inverse.reshape(ids.shape)]
            drop = rng.random(mask.shape) < 0.1
            x[drop] = 0
            _, g, dx = gradients(p, x, mask, doc_of, y[chosen], share[y[chosen]])
            dx[drop | ~mask] = 0
            d_own = np.zeros((len(own), EMBED), F32)
            np.add.at(d_own, inverse.ravel(), dx.reshape(-1, EMBED))
            g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            np.add.at(g["word"], lex.word[own], d_own)
            np.add.at(g["char"], chars, (d_own * lex.share[own][:, None])[owner])
            g["word"][0] = g["char"][0] = 0
            step += 1
            seen += len(chosen)
            rate = 0.01 * min(1, step / 20) * (1 - 0.9 * min(1, seen / budget))
            for k, grad in g.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                if k in DECAYED:
                    p[k] -= F32(rate * DECAY) * (p[k] - origin[k])
                p[k] -= F32(rate) * (m / F32(1 - 0.9**step)) / (np.sqrt(v / F32(1 - 0.99**step)) + F32(1e-6))
    _calibrate(p, documents, y)
    return p


def _lay(documents: list[tuple[np.ndarray, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids [T, B] of all windows (0 where there is none), their mask, and each window's document."""
    n = sum(len(c) for _, c in documents)
    ids, mask, doc_of = np.zeros((WINDOW, n), np.int64), np.zeros((WINDOW, n), bool), np.empty(n, np.int64)
    w = 0
    for k, (own, cuts) in enumerate(documents):
        for a, b in cuts:
            ids[: b - a, w], mask[: b - a, w], doc_of[w] = own[a:b], True, k
            w += 1
    return ids, mask, doc_of


def _calibrate(p: dict[str, np.ndarray], documents: list[list[bytes]], y: np.ndarray) -> None:
    """Fit scale and shift of the maximum's logit by Newton steps."""
    score = Scorer(p)
    s = np.concatenate([score.logits(documents[i : i + BATCH_ROWS]) for i in range(0, len(documents), BATCH_ROWS)])
    s = np.clip(s, -15, 15)
    design, theta = np.stack([s, np.ones_like(s)], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(design @ theta, -50, 50)))
        hess = (design * (q * (1 - q))[:, None]).T @ design + 1e-2 * np.eye(2)
        theta -= np.linalg.solve(hess, design.T @ (q - y) + 1e-2 * (theta - [1, 0]))
    p["scale"], p["shift"] = np.array([max(theta[0], 0.05)], F32), np.array([theta[1]], F32)


class Scorer:
    """Scores texts; input projections of words are made once while the cache lasts."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p = p
        self.W, self.b = np.concatenate([p["Wf"], p["Wb"]], axis=1), np.concatenate([p["bf"], p["bb"]])
        self.known: dict[bytes, int] = {}
        self.gates = np.empty((CACHE_WORDS + 50_000, 6 * HIDDEN), F32)

    def _learn(self, words: list[bytes]) -> None:
        lex = Lexicon([words], self.p["words"], self.p["grams"])
        chars, owner = lex.grams(np.arange(len(words)))
        mean = np.zeros((len(words), EMBED), F32)
        for k in range(EMBED):
            mean[:, k] = np.bincount(owner, self.p["char"][chars, k], len(words))
        x = self.p["word"][lex.word] + mean * lex.share[:, None]
        base = len(self.known)
        while base + len(words) > len(self.gates):
            self.gates = np.concatenate([self.gates, np.empty((100_000, 6 * HIDDEN), F32)])
        self.gates[base : base + len(words)] = x @ self.W + self.b
        self.known.update(zip(words, range(base, base + len(words)), strict=True))

    def logits(self, documents: list[list[bytes]]) -> np.ndarray:
        """The largest window logit of each document."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        if new := list({w for d in documents for w in d if w not in known}):
            self._learn(new)
        get = known.__getitem__
        ids = [np.fromiter(map(get, d), np.int64, len(d)) for d in documents]
        cuts = [windows_of(len(d)) for d in documents]
        out = np.full(len(documents), -np.inf, F32)
        at = 0
        while at < len(documents):
            end, n = at, 0
            while end < len(documents) and n < 2048:
                n += len(cuts[end])
                end += 1
            own, mask, doc_of = _lay(list(zip(ids[at:end], cuts[at:end], strict=True)))
            for w in range(0, own.shape[1], 2048):
                g = self.gates[own[:, w : w + 2048]] if len(known) else np.zeros((*own[:, w : w + 2048].shape, 6 * HIDDEN), F32)
                np.maximum.at(out, at + doc_of[w : w + 2048], window_logits(self.p, g[:, :, : 3 * HIDDEN], g[:, :, 3 * HIDDEN :], mask[:, w : w + 2048]))
            at = end
        return out

    def __call__(self, batch: list[bytes | None]) -> np.ndarray:
        logit = np.clip(self.logits([words_of(t) for t in batch]), -15, 15)
        return 1 / (1 + np.exp(-(logit.astype(np.float64) * float(self.p["scale"][0]) + float(self.p["shift"][0]))))


def fold(doc_id):
    """crc32 of the id as text, modulo the folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, budget: int = TRAIN_DOCUMENTS, text_bytes: int = SAMPLE_TEXT_BYTES) -> dict[str, np.ndarray]:
    """Train on at most per_class labelled rows of either class, none from the held-out fold.

    A doc_id with several labels counts as toxic if any says so; null labels and
    null ids are no labels. Of the rows so drawn, texts beyond text_bytes are left
    to scoring: what comes to the driver is bounded in rows and in bytes.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) != HELD_OUT)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value in (0, 1):
        part = marks.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    bounded = F.broadcast(chosen.withColumnRenamed("doc_id", "_id"))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").join(bounded, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= text_bytes)
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(2 * per_class).collect()
    return train([words_of((r["text"] or "").encode("utf-8")) for r in rows], [int(r["toxic"]) for r in rows], budget)


def score_toxicity(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Only the text counts: every overlapping window of it, whole. Null and empty
    texts are one empty window. Repeated rows score alike; an empty table gives
    no rows. Columns other than doc_id and text are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches, BATCH_ROWS):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scorer(texts(batch)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
