"""Operator 13: toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read as words (runs of letters and digits, lower case, longer ones in
pieces of ``PIECE`` characters).  Overlapping windows of ``WINDOW`` words, one every
``STRIDE`` words, cover the whole text; each is scored, and the document's score is that of
its most toxic window.

* A word's input is a learned word vector (hashed), the mean of learned vectors of
  its character trigrams (hashed), and the word's log odds between the labels.
* One gated recurrent network reads the window forwards, one backwards; attention
  weights over the words pool their states; a logistic layer gives the score.
* Training is in numpy (back-propagation through time, Adam), in one task.  The label is the
  document's: in every epoch the most toxic window of each document learns.  After ``WARM`` epochs documents whose
  label the network does not see count less, as labels may be wrong.
  In training a document's own share is taken out of the counts behind the log odds, so
  that words seen once do not give the label away.

Learning uses at most ``TRAIN_DOCS`` labelled documents per label (least hash of the id; of rows
with one id the least text hash) and of each at most ``TRAIN_WINDOWS`` windows: those with the largest log odds, and
evenly spread ones.  Counts of the hashed words (``BUCKETS`` at most) go to the driver.
Scoring reads every window of every text.

Defined results: null text counts as empty; a text without words is one
window of no words and gets a score like any other.  Without labels all scores are 0.5;
with one label only, that label's share.  Rows that repeat are each returned;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.llm.common import fold_of, id_text, map_texts, stage

WINDOW, STRIDE = 48, 40
PIECE = 32
FOLDS, HELD_OUT = 5, 0
TRAIN_DOCS = 600
TRAIN_WINDOWS = 8
BUCKETS = 1 << 16
WORDS, GRAMS = 1 << 12, 1 << 11  # rows of the learned tables; row 0 is "no word"
WORD_DIM, GRAM_DIM = 6, 8
INPUT = WORD_DIM + GRAM_DIM + 1
HIDDEN, ATTENTION = 8, 6
EPOCHS, STEPS, RATE = 12, 25, 0.01
WARM, TRUST = 4, 1.0  # epochs with equal weights; then a document counts by (probability of its label) ** TRUST
TABLES_RATE = 0.3  # the learned word and trigram tables learn slower, for the words of a few documents should not decide
PRIOR = 2.0
TOXIC_SHARE = 0.3  # of the loss: clean documents weigh more, as one wrong window is enough to mark them
CACHE = 200_000  # words whose inputs a task remembers

_WORD = re.compile(rf"[^\W_]{{1,{PIECE}}}")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def bucket_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS


def grams_of(word: str) -> list[int]:
    """Rows of the word's character trigrams (with its ends marked)."""
    held = f"<{word}>".encode("utf-32-le", "replace")
    return [1 + zlib.crc32(held[i:i + 12]) % (GRAMS - 1) for i in range(0, max(4, len(held) - 8), 4)]


def window_starts(n: int) -> np.ndarray:
    """First words of the windows over n words: all of them are covered."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else np.zeros(1, np.int64)


def log_odds(toxic: np.ndarray, clean: np.ndarray, toxic_docs: float, clean_docs: float) -> np.ndarray:
    """Log odds of a word's document counts between the labels, shrunk towards 0 as if ``PRIOR`` more documents held it."""
    share = toxic_docs / max(toxic_docs + clean_docs, 1)
    a = (np.maximum(toxic, 0) + PRIOR * share) / max(toxic_docs, 1)
    b = (np.maximum(clean, 0) + PRIOR * (1 - share)) / max(clean_docs, 1)
    return np.clip(np.log(a) - np.log(b), -5, 5).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(-2 * x)) - 1  # numpy's exp is vectorised where its tanh is not


class Network:
    """The model; parameters are plain arrays.  Time runs along the first axis, windows along the second."""

    def __init__(self, seed: int = 13):
        r = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return r.normal(0, scale, shape).astype(np.float32)

        self.p = {"words": normal(WORDS, WORD_DIM, scale=0.1), "grams": normal(GRAMS, GRAM_DIM, scale=0.1)}
        for way in "fb":
            self.p |= {
                f"W{way}": normal(INPUT, 3 * HIDDEN, scale=INPUT ** -0.5), f"U{way}": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN ** -0.5),
                f"b{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {
            "A": normal(2 * HIDDEN, ATTENTION, scale=(2 * HIDDEN) ** -0.5), "a": np.zeros(ATTENTION, np.float32),
            "v": normal(ATTENTION, scale=ATTENTION ** -0.5), "c": normal(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5),
            "d": np.zeros(1, np.float32)}

    # -- one direction -------------------------------------------------------

    def _read(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States of all steps from the projected inputs; steps without a word keep the state."""
        u, steps = self.p["U" + way], len(x)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, held = np.zeros((steps, x.shape[1], HIDDEN), np.float32), []
        for t in (range(steps) if way == "f" else range(steps - 1, -1, -1)):
            own = h @ u[:, :2 * HIDDEN]
            own += x[t, :, :2 * HIDDEN]
            gates = _sigmoid(own)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            past = r * h
            n = past @ u[:, 2 * HIDDEN:]
            n += x[t, :, 2 * HIDDEN:]
            n = _tanh(n)
            new = (h + z * (n - h)) if mask is None else h + mask[t][:, None] * z * (n - h)
            if keep:
                held.append((t, h, z, r, n, past))
            h = out[t] = new
        return out, held

    def _unread(self, way: str, held: list, dout: np.ndarray, mask: np.ndarray, grads: dict) -> np.ndarray:
        """Gradient by the projected inputs; adds that by the recurrent matrix."""
        u = self.p["U" + way]
        dx = np.zeros((*dout.shape[:2], 3 * HIDDEN), np.float32)
        du = np.zeros_like(u)
        dh = np.zeros(dout.shape[1:], np.float32)
        for t, h, z, r, n, past in reversed(held):
            dh = dh + dout[t]
            m = mask[t][:, None]
            dn = dh * m * z * (1 - n * n)
            dz = dh * m * (n - h) * z * (1 - z)
            dpast = dn @ u[:, 2 * HIDDEN:].T
            dr = dpast * h * r * (1 - r)
            dgates = np.concatenate([dz, dr], 1)
            dx[t] = np.concatenate([dgates, dn], 1)
            du[:, :2 * HIDDEN] += h.T @ dgates
            du[:, 2 * HIDDEN:] += past.T @ dn
            dh = dh * (1 - m * z) + dpast * r + dgates @ u[:, :2 * HIDDEN].T
        grads["U" + way] = du
        return dx

    # -- whole network -------------------------------------------------------

    def project(self, way: str, inputs: np.ndarray) -> np.ndarray:
        return inputs @ self.p["W" + way] + self.p["b" + way]

    def forward(self, forth: np.ndarray, back: np.ndarray, mask: np.ndarray, keep: bool = False) -> dict:
        """Scores of the windows from the projected inputs (steps, windows, 3 * HIDDEN) of both directions."""
        p, steps = self.p, len(mask)
        full = None if mask.all() and not keep else mask
        hf, held_f = self._read("f", forth, full, keep)
        hb, held_b = self._read("b", back, full, keep)
        h = np.concatenate([hf, hb], 2)
        t = _tanh(h @ p["A"] + p["a"])
        e = t @ p["v"]
        e = np.where(mask > 0, e, -1e9)
        if steps:
            e = e - e.max(0)
        w = np.exp(e) * mask
        w = w / np.maximum(w.sum(0), 1e-9)
        pooled = (h * w[:, :, None]).sum(0)
        logit = np.clip(pooled @ p["c"] + p["d"], -30, 30)
        return {"h": h, "t": t, "w": w, "pooled": pooled, "y": _sigmoid(logit), "held_f": held_f, "held_b": held_b}

    def inputs(self, words: np.ndarray, grams: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """``words``: rows of the word table; ``grams``: rows of the trigram table, padded with 0; ``odds``."""
        many = np.maximum((grams > 0).sum(-1, keepdims=True), 1)
        chars = (self.p["grams"][grams] * (grams > 0)[..., None]).sum(-2) / many
        return np.concatenate([self.p["words"][words], chars, odds[..., None]], -1).astype(np.float32)

    def loss_grads(self, words: np.ndarray, grams: np.ndarray, odds: np.ndarray, mask: np.ndarray, label: np.ndarray,
                   weight: np.ndarray) -> tuple[float, dict]:
        """Weighted cross entropy of windows (steps, windows) and its gradients."""
        p, grads = self.p, {}
        x = self.inputs(words, grams, odds)
        f = self.forward(self.project("f", x), self.project("b", x), mask, keep=True)
        y = np.clip(f["y"], 1e-7, 1 - 1e-7)
        loss = float(-(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum())
        dy = ((f["y"] - label) * weight).astype(np.float32)
        grads["c"], grads["d"] = f["pooled"].T @ dy, dy.sum(keepdims=True)
        dpooled = np.outer(dy, p["c"])
        dw = (f["h"] * dpooled).sum(2)
        de = f["w"] * (dw - (dw * f["w"]).sum(0))
        dt = de[:, :, None] * p["v"] * (1 - f["t"] ** 2)
        grads["v"] = np.tensordot(de, f["t"], ([0, 1], [0, 1]))
        grads["A"] = np.tensordot(f["h"], dt, ([0, 1], [0, 1]))
        grads["a"] = dt.sum((0, 1))
        dh = f["w"][:, :, None] * dpooled + dt @ p["A"].T
        dx = np.zeros_like(x)
        for way, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[:, :, HIDDEN:])):
            dproject = self._unread(way, f["held_" + way], np.ascontiguousarray(part), mask, grads)
            grads["W" + way] = np.tensordot(x, dproject, ([0, 1], [0, 1]))
            grads["b" + way] = dproject.sum((0, 1))
            dx += dproject @ p["W" + way].T
        dwords = np.zeros_like(p["words"])
        np.add.at(dwords, words, dx[..., :WORD_DIM])
        dwords[0] = 0
        many = np.maximum((grams > 0).sum(-1, keepdims=True), 1)
        share = dx[..., WORD_DIM:WORD_DIM + GRAM_DIM] / many
        dgrams = np.zeros_like(p["grams"])
        some = np.nonzero(grams)
        np.add.at(dgrams, grams[some], share[some[:-1]])
        return loss, grads | {"words": dwords, "grams": dgrams}


def fit(windows: list[list[str]], owner: np.ndarray, label: np.ndarray, odds: dict[int, np.ndarray], epochs: int = EPOCHS,
        rate: float = RATE, steps: int = STEPS) -> Network:
    """Learn from windows of documents: ``owner`` gives each window's document (ascending), ``label`` each document's label.

    ``odds``: the log odds of the word buckets as documents of each label see them.
    """
    net = Network()
    known: dict[str, int] = {"": 0}
    tokens = np.zeros((len(windows), WINDOW), np.int64)
    for i, words in enumerate(windows):
        tokens[i, :len(words)] = [known.setdefault(w, len(known)) for w in words]
    grams_each = [[]] + [grams_of(w) for w in known if w]
    grams = np.zeros((len(known), PIECE), np.int64)
    for i, g in enumerate(grams_each):
        grams[i, :len(g)] = g
    buckets = np.array([0] + [bucket_of(w) for w in known if w])
    rows = np.where(np.arange(len(known)) > 0, 1 + buckets % (WORDS - 1), 0)
    sees = {value: np.where(np.arange(len(known)) > 0, table[buckets], 0).astype(np.float32) for value, table in odds.items()}
    seen = np.stack([sees[0], sees[1]])
    firsts = np.searchsorted(owner, np.arange(len(label) + 1))
    r = np.random.default_rng(5)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        # The most toxic window of every document, under the network so far.
        projected = []
        for value in (0, 1):
            x = net.inputs(rows, grams, seen[value])
            projected.append((net.project("f", x), net.project("b", x)))
        scores = np.concatenate([
            _window_scores(net, tokens[at:at + 1024], projected, label[owner[at:at + 1024]].astype(int))
            for at in range(0, len(tokens), 1024)])
        by = np.lexsort((-scores, owner))
        top = by[firsts[:-1]]
        # Labels may be wrong: documents whose label the network does not see count less among those of their label.
        agrees = np.where(label > 0, scores[top], 1 - scores[top]) ** (TRUST if epoch >= WARM else 0.0)
        share = np.where(label > 0, TOXIC_SHARE / agrees[label > 0].sum(), (1 - TOXIC_SHARE) / agrees[label == 0].sum())
        trust = share * agrees * len(label)
        order = r.permutation(len(label))
        batch = max(8, -(-len(order) // steps))
        slower = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, len(order), batch):
            docs = order[at:at + batch]
            t = tokens[top[docs]].T
            mask = (t > 0).astype(np.float32)
            value = label[docs].astype(np.float32)
            _, grads = net.loss_grads(rows[t], grams[t], seen[label[docs].astype(int)[None, :], t], mask, value,
                                      (trust[docs] / len(docs)).astype(np.float32))
            step += 1
            for k, g in grads.items():
                g = g + (1e-3 if k in ("words", "grams") else 1e-4) * net.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.p[k] -= (slower * (TABLES_RATE if k in ("words", "grams") else 1) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def _window_scores(net: Network, tokens: np.ndarray, projected: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> np.ndarray:
    """Scores of the windows as their documents' labels see the log odds."""
    out = np.zeros(len(tokens), np.float32)
    for value in (0, 1):
        some = np.flatnonzero(label == value)
        t = tokens[some].T
        if len(some):
            out[some] = net.forward(projected[value][0][t], projected[value][1][t], (t > 0).astype(np.float32))["y"]
    return out


class Scorer:
    """Scores texts with a fitted network; remembers the inputs of words."""

    def __init__(self, net: Network, odds: np.ndarray):
        self.net, self.odds = net, odds
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        none = self.net.inputs(np.zeros(1, np.int64), np.zeros((1, PIECE), np.int64), np.zeros(1, np.float32))
        self.forth, self.back = self.net.project("f", none), self.net.project("b", none)

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at:at + 20_000]
            grams = np.zeros((len(some), PIECE), np.int64)
            for i, w in enumerate(some):
                g = grams_of(w)
                grams[i, :len(g)] = g
            buckets = np.array([bucket_of(w) for w in some])
            x = self.net.inputs(1 + buckets % (WORDS - 1), grams, self.odds[buckets])
            self.forth = np.concatenate([self.forth, self.net.project("f", x)])
            self.back = np.concatenate([self.back, self.net.project("b", x)])

    def score(self, texts: list[str | None], at_once: int = 1024) -> np.ndarray:
        """The score of every text's most toxic window."""
        if len(self.known) > CACHE:
            self._clear()
        codes, sizes, known = [], [], self.known
        new: list[str] = []
        for text in texts:
            words = words_of(text)
            for w in words:
                code = known.get(w)
                if code is None:
                    code = known[w] = len(known)
                    new.append(w)
                codes.append(code)
            sizes.append(len(words))
        self._learn(new)
        flat = np.array([*codes, 0], np.int64)
        base = np.cumsum([0, *sizes])
        starts, ends, owner = [], [], []
        for d, n in enumerate(sizes):
            s = window_starts(n) + base[d]
            starts.append(s)
            ends.append(np.minimum(s + WINDOW, base[d] + n))
            owner.append(np.full(len(s), d))
        starts, ends, owner = (np.concatenate(x) for x in (starts, ends, owner))
        got = np.zeros(len(starts), np.float32)
        by = np.argsort(ends - starts, kind="stable")  # windows of one length together: little padding
        for at in range(0, len(by), at_once):
            part = by[at:at + at_once]
            size = ends[part] - starts[part]
            steps = np.arange(max(1, int(size.max())))[:, None]
            mask = steps < size[None, :]
            t = flat[np.where(mask, starts[part][None, :] + steps, len(flat) - 1)]
            got[part] = self.net.forward(self.forth[t], self.back[t], mask.astype(np.float32))["y"]
        out = np.zeros(len(texts), np.float32)
        np.maximum.at(out, owner, got)
        return out


def _picked(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, train_docs: int) -> DataFrame:
    """label, text of the documents to learn from: one row per picked id."""
    marked = labels.where(
        F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold_of(F.col(id_col), FOLDS) != HELD_OUT)
    ).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id"), F.col("label")]
    one, two = (marked.where(F.col("label") == value).orderBy(*order).limit(train_docs) for value in (0, 1))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # At most 2 * train_docs ids are broadcast; repeated rows of an id become one.
    joined = texts.join(F.broadcast(one.union(two)), texts["doc_id"] == F.col("id"))
    return joined.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
          train_docs: int = TRAIN_DOCS) -> tuple[Network, np.ndarray] | float:
    """(network, log odds of the word buckets); a constant score if fewer than two labels are there."""
    rows = stage(_picked(docs, labels, text_col, id_col, label_col, train_docs), "toxic-train")

    def make_buckets():
        return lambda texts: {"own": [sorted({bucket_of(w) for w in words_of(t)}) for t in texts]}

    own = map_texts(rows, make_buckets, "own array<int>", ["label"])
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return float(next(iter(totals))) if totals else 0.5
    counts = np.zeros((2, BUCKETS))
    for r in own.select("label", F.explode("own").alias("word")).groupBy("label", "word").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.label, r.word] = r.n  # at most 2 * BUCKETS rows
    clean, toxic = counts
    odds = {0: log_odds(toxic, clean - 1, totals[1], totals[0] - 1), 1: log_odds(toxic - 1, clean, totals[1] - 1, totals[0])}

    def make_windows():
        def run(texts: list) -> dict[str, list]:
            out = []
            for text in texts:
                words = words_of(text)
                starts = window_starts(len(words))
                if len(starts) > TRAIN_WINDOWS:
                    # Positive log odds summed over each window, as either label sees them.
                    each = np.array([max(0.0, odds[0][b], odds[1][b]) for b in map(bucket_of, words)])
                    total = np.concatenate([[0], np.cumsum(each ** 2)])
                    mass = total[np.minimum(starts + WINDOW, len(words))] - total[starts]
                    best = np.argsort(-mass, kind="stable")[:TRAIN_WINDOWS * 5 // 8]
                    spread = np.linspace(0, len(starts) - 1, TRAIN_WINDOWS - len(best)).astype(int)
                    starts = starts[np.unique(np.concatenate([best, spread]))]
                out.append([" ".join(words[s:s + WINDOW]) for s in starts.tolist()])
            return {"windows": out}

        return run

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = sorted((row["label"], row["windows"]) for b in batches for row in b.to_pylist())
        windows = [w.split() for _, own in bags for w in own]
        owner = np.repeat(np.arange(len(bags)), [len(own) for _, own in bags])
        net = fit(windows, owner, np.array([label for label, _ in bags], float), odds)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p)], pa.binary())], names=["model"])

    # At most 2 * train_docs rows of TRAIN_WINDOWS windows are learned from, in one task.
    bags = map_texts(rows, make_windows, "windows array<string>", ["label"])
    net = Network()
    net.p = pickle.loads(bags.repartition(1).mapInArrow(train, "model binary").first().model)
    return net, log_odds(toxic, clean, totals[1], totals[0])


def score_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                   label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, text_col, id_col, label_col))

    def make():
        held = model.value
        scorer = None if isinstance(held, float) else Scorer(*held)

        def run(texts: list) -> dict[str, list]:
            score = np.full(len(texts), held) if scorer is None else scorer.score(texts).astype(float)
            return {"score": score.tolist(), "predicted": (score >= 0.5).astype(int).tolist()}

        return run

    slim = id_text(docs, text_col, id_col).withColumn("held_out", fold_of(F.col("doc_id"), FOLDS) == HELD_OUT)
    return map_texts(slim, make, "score double, predicted int", ["doc_id", "held_out"], chars=2_000_000)
