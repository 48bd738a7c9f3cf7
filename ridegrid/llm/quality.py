"""Operator 10: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` characters.  Every passage is
encoded (shares of character kinds, of kinds that follow each other, of
repeated words and lines; one hidden layer); gated attention weights,
learned from the document labels alone, sum the passage representations; a
logistic layer scores the sum.

Learning uses at most ``TRAIN_DOCS`` labelled documents per label (least hash
of the id; of rows with one id the least text hash) and at most ``TRAIN_PASSAGES`` evenly spread passages of each; it
runs in numpy on their features.  Scoring reads every passage of every text.

Defined results: null text counts as empty; an empty text is one empty
passage and gets a score like any other.  Without labels all scores are 0.5;
with one label only, that label's share.  Rows that repeat are each returned;
only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.llm.common import fold_of, id_text, map_texts

PASSAGE = 512
TRAIN_DOCS = 1500
TRAIN_PASSAGES = 32
FOLDS, HELD_OUT = 3, 1
HIDDEN, GATE = 24, 12
EPOCHS, RATE = 80, 0.02
KINDS = 16
PAIRS = 64
WIDTH = KINDS + PAIRS + 4

_MARKS = {".": 5, ",": 6, "!": 7, "|": 8, "*": 9, "&": 10, "$": 11, "%": 12, "#": 13, "\n": 4}
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Kind of every code point."""
    if not _kinds:
        out = np.full(0x110000, 15, np.uint8)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                out[c] = (0 if c < 128 else 14) if x.islower() or not x.isupper() else 1
            elif x.isdigit():
                out[c] = 2
            elif x.isspace():
                out[c] = 3
        for x, kind in _MARKS.items():
            out[ord(x)] = kind
        _kinds.append(out)
    return _kinds[0]


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text."""
    sizes = np.array([len(t or "") for t in texts], np.int64)
    many = np.maximum(1, -(-sizes // PASSAGE))
    bases = np.concatenate([[0], np.cumsum(many)])
    n = int(bases[-1])
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
    kind = kinds()[points].astype(np.int64)
    within = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = np.repeat(bases[:-1], sizes) + within // PASSAGE
    out = np.zeros((n, WIDTH), np.float32)
    chars = np.maximum(np.bincount(passage, minlength=n), 1)[:, None]
    out[:, :KINDS] = np.bincount(passage * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS) / chars
    same = np.flatnonzero(passage[1:] == passage[:-1]) if len(points) else np.zeros(0, np.int64)
    pair = (kind[same] * KINDS + kind[same + 1]) * 37 % 257 % PAIRS
    out[:, KINDS:KINDS + PAIRS] = np.bincount(passage[same] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) / chars
    extra = out[:, KINDS + PAIRS:]
    for d, text in enumerate(texts):
        if not text:
            continue
        lines_seen: set[int] = set()  # hashes of all its lines so far: no more than the text itself holds
        words_seen: set[str] = set()
        for i in range(int(many[d])):
            part = text[i * PASSAGE:(i + 1) * PASSAGE]
            words, lines = part.split(), part.split("\n")
            if words:
                own = set(words)
                extra[bases[d] + i, 0] = 1 - len(own) / len(words)
                extra[bases[d] + i, 1] = len(own & words_seen) / len(own) if i else 0
                extra[bases[d] + i, 2] = min(len(part) / len(words) / 16, 4)
                words_seen = own  # the passage before
            long = [hash(x) for x in lines if len(x) > 8]
            if long:
                extra[bases[d] + i, 3] = sum(x in lines_seen for x in long) / len(long) + 1 - len(set(long)) / len(long)
                lines_seen.update(long)
    return out, many


class GatedAttention:
    """Bag scorer: encoder, gated attention, logistic head.  Parameters are plain arrays."""

    def __init__(self, width: int = WIDTH, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = {
            "W": r.normal(0, width ** -0.5, (width, HIDDEN)), "b": np.zeros(HIDDEN),
            "V": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
            "a": r.normal(0, GATE ** -0.5, GATE), "c": r.normal(0, HIDDEN ** -0.5, HIDDEN), "d": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, many: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, np.cumsum(many) - many
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), many))
        weight = e / np.repeat(np.add.reduceat(e, starts), many)
        z = np.add.reduceat(h * weight[:, None], starts)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "w": weight, "z": z, "y": score}

    def fit(self, x: np.ndarray, many: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> GatedAttention:
        self.mean = x.mean(0)
        self.scale = np.maximum(x.std(0), 1e-4)
        starts = np.cumsum(many) - many
        balance = np.where(label > 0, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6))
        balance = (balance / balance.sum()).astype(np.float32)
        label = label.astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, epochs + 1):
            f, p = self.forward(x, many), self.p
            dy = (f["y"] - label) * balance  # of the weighted cross entropy
            dz = np.outer(dy, p["c"])
            dz_each = np.repeat(dz, many, axis=0)
            dw = (f["h"] * dz_each).sum(1)
            mean = np.repeat(np.add.reduceat(dw * f["w"], starts), many)
            de = f["w"] * (dw - mean)
            dt, dg = np.outer(de, p["a"]) * f["g"], np.outer(de, p["a"]) * f["t"]
            dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
            dh = dz_each * f["w"][:, None] + dt @ p["V"].T + dg @ p["U"].T
            dx = dh * (1 - f["h"] ** 2)
            grads = {
                "W": f["x"].T @ dx + 1e-4 * p["W"], "b": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
                "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy + 1e-4 * p["c"], "d": dy.sum(keepdims=True),
            }
            for k, grad in grads.items():  # Adam
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad ** 2
                p[k] = p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        x, many = encode(texts)
        return self.forward(x, many)["y"]


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality",
          train_docs: int = TRAIN_DOCS) -> GatedAttention | float:
    """The fitted model; a constant score if fewer than two labels are there."""
    marked = labels.where(
        F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold_of(F.col(id_col), FOLDS) != HELD_OUT)
    ).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id"), F.col("label")]
    picked = None
    for value in (0, 1):
        some = marked.where(F.col("label") == value).orderBy(*order).limit(train_docs)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # At most 2 * train_docs ids are broadcast; rows that repeat an id become one, so no more rows come out.
    joined = texts.join(F.broadcast(picked), texts["doc_id"] == picked["id"])
    rows = joined.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")

    def make():
        def run(batch: list) -> dict[str, list]:
            out = []
            for text in batch:
                x, many = encode([text])
                if many[0] > TRAIN_PASSAGES:
                    x = x[np.linspace(0, many[0] - 1, TRAIN_PASSAGES).astype(int)]
                out.append(x.astype(np.float16).tobytes())
            return {"bag": out}

        return run

    bags = map_texts(rows, make, "bag binary", ["label"]).collect()
    if len({r.label for r in bags}) < 2:
        return float(bags[0].label) if bags else 0.5
    bags.sort(key=lambda r: (r.label, bytes(r.bag)))
    each = [np.frombuffer(r.bag, np.float16).reshape(-1, WIDTH).astype(np.float32) for r in bags]
    return GatedAttention().fit(np.concatenate(each), np.array([len(x) for x in each]), np.array([r.label for r in bags], float))


def score_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, text_col, id_col, label_col))

    def make():
        held = model.value

        def run(texts: list) -> dict[str, list]:
            score = np.full(len(texts), held) if isinstance(held, float) else held.score(texts)
            return {"score": score.tolist(), "predicted": (score >= 0.5).astype(int).tolist()}

        return run

    slim = id_text(docs, text_col, id_col).withColumn("held_out", fold_of(F.col("doc_id"), FOLDS) == HELD_OUT)
    return map_texts(slim, make, "score double, predicted int", ["doc_id", "held_out"], chars=2_000_000)
