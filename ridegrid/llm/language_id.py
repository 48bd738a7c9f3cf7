"""Operator 6: language identification by cross-parsing entropy.

Learning keeps a bounded sample per language: from ``SAMPLE_DOCS`` documents
(least hash of the id) one stretch of ``SAMPLE_CHARS`` characters each.  A
worker builds a suffix automaton of each sample.  A text is parsed with each
language's automaton into phrases, each the longest match with the sample that
starts where the last one ended.  The phrase count, times the logarithm of
the sample's length, over the text's length estimates the cross entropy; the
language with the least wins.

The whole text is parsed.  It is cut into stretches of ``STRETCH`` characters
that are parsed side by side, each from the automaton's start, so one step
of numpy advances many stretches at once; a cut ends a phrase in every
language alike.  Letters are lower-cased, runs of other characters are one blank.
Every letter of the samples counts, however many scripts there are: each language has codes for
its own letters, and automata over large alphabets keep sorted lists instead of tables.

Defined results: ``und`` with score 0 if the text is null or has no letter, or
if nothing was learned.  Ties go to the language first in order.  The score is
the runner-up's share of the two best entropies (0.5 to 1; 1 for a single language).
Rows that repeat are each returned; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridegrid.llm.common import fold_of, id_text, map_texts

SAMPLE_DOCS = 64
SAMPLE_CHARS = 400
STRETCH = 256
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
SURE = 0.6  # from this score on a prediction outweighs a declared language
DENSE = 1 << 22  # entries of a transition table; larger ones are kept as sorted lists
_CODES = 0x110000


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(language, sample text) pairs; at most ``sample_docs * sample_chars`` characters per language."""
    text = F.col(text_col).cast("string")
    rows = docs.where(
        F.col(lang_col).isNotNull() & text.rlike(r"\p{L}") & (fold_of(F.col(id_col), FOLDS) != HELD_OUT)
    )
    start = F.greatest(F.lit(1), F.floor((F.char_length(text) - sample_chars) / 2).cast("int"))
    picks = rows.select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"),
        F.substring(text, start, F.lit(sample_chars)).alias("part"))
    first = Window.partitionBy("lang").orderBy("h", "part")  # cut to sample_docs in every task before the shuffle
    kept = picks.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_docs)
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for r in kept.select("lang", "n", "part").collect():
        by_lang.setdefault(r.lang, []).append((r.n, r.part))
    return [(lang, "\n".join(p for _, p in sorted(parts))) for lang, parts in sorted(by_lang.items())]


def transitions(codes: list[int]) -> list[dict[int, int]]:
    """The states of the suffix automaton of a code sequence: the next state by code."""
    follow: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in codes:
        new = len(follow)
        follow.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p != -1:
            q = follow[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return follow


def automaton(codes: list[int], width: int) -> np.ndarray:
    """Transition table of the suffix automaton of a code sequence; -1 where no match goes on."""
    follow = transitions(codes)
    table = np.full((len(follow), width), -1, np.int32)
    for state, nexts in enumerate(follow):
        for c, to in nexts.items():
            table[state, c] = to
    return table


class Dense:
    """Suffix automaton as a table; ``other`` ends every match, ``pad`` stays."""

    def __init__(self, codes: list[int], width: int, other: int, pad: int):
        table = automaton(codes, width)
        table[:, other] = -1
        table[:, pad] = np.arange(len(table))
        self.flat, self.width = table.ravel(), width
        self.start = np.maximum(table[0], 0)  # where a new phrase is after its first character
        self.start[pad] = 0

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        return self.flat.take(state * self.width + column)


class Sparse:
    """The same for a large alphabet: the transitions as a list sorted by state and code."""

    def __init__(self, codes: list[int], width: int, other: int, pad: int):
        found = [(s * width + c, to) for s, nexts in enumerate(transitions(codes)) for c, to in nexts.items() if c != other]
        found.append((np.iinfo(np.int64).max, -1))
        keys, to = np.array(sorted(found), np.int64).T
        self.keys, self.to, self.width, self.pad = keys.copy(), to.astype(np.int32), width, pad
        begin = self.step(np.zeros(width, np.int32), np.arange(width, dtype=np.int32))
        self.start = np.maximum(begin, 0)

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + column
        at = np.searchsorted(self.keys, key)
        return np.where(column == self.pad, state, np.where(self.keys[at] == key, self.to[at], -1))


class CrossParser:
    """Parses texts with the automata of all languages."""

    BLANK, OTHER, PAD = 0, 1, 2  # codes; the letters of the samples follow

    def __init__(self, samples: list[tuple[str, str]], stretch: int = STRETCH, dense: int = DENSE):
        self.stretch, self.langs = stretch, [lang for lang, _ in samples]
        self.lower = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(_CODES)), np.uint32, _CODES)
        self.letter = np.fromiter((chr(c).isalpha() for c in range(_CODES)), bool, _CODES)
        seen = [np.unique(self.lower[self._points(text)]) for _, text in samples]
        known = np.unique(np.concatenate([*seen, np.zeros(0, np.uint32)]))
        known = known[self.letter[known]]
        code = np.where(self.letter, self.OTHER, self.BLANK).astype(np.int32)
        code[known] = np.arange(3, 3 + len(known))
        self.code = code[self.lower]
        self.tables, self.weights = [], []
        for _, text in samples:
            codes = self._squeeze(self.code[self._points(text)], np.array([0]))[0]
            letters = np.setdiff1d(codes, [self.BLANK, self.OTHER])
            own = np.full(3 + len(known), self.OTHER, np.int32)  # the language's own codes: letters it lacks are OTHER
            own[[self.BLANK, self.PAD]] = self.BLANK, self.PAD
            own[letters] = np.arange(3, 3 + len(letters))
            width = 3 + len(letters)
            kind = Dense if 2 * len(codes) * width <= dense else Sparse
            self.tables.append((own, kind(own[codes].tolist(), width, self.OTHER, self.PAD)))
            self.weights.append(math.log2(len(codes) + 2))

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)

    def _squeeze(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes with runs of blanks as one, and the new starts of the texts in them."""
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != self.BLANK) | (codes[:-1] != self.BLANK)
        keep[starts[starts < len(codes)]] = True
        return codes[keep], np.concatenate([[0], np.cumsum(keep)])[starts]

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        n = len(texts)
        none = {"lang_pred": [UNKNOWN] * n, "score": [0.0] * n}
        points = self._points("".join(t or "" for t in texts))
        if not len(points) or not self.langs:
            return none
        starts = np.cumsum([0, *[len(t or "") for t in texts]])
        letters = np.diff(np.concatenate([[0], np.cumsum(self.letter[points])])[starts])
        codes, starts = self._squeeze(self.code[points], starts)
        sizes = np.diff(starts)
        many = -(-sizes // self.stretch)
        doc = np.repeat(np.arange(n), many)
        first = np.repeat(starts[:-1], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * self.stretch
        left = np.repeat(starts[1:], many) - first
        at = first[:, None] + np.arange(self.stretch)[None, :]
        padded = np.append(codes, np.int32(self.PAD))
        grid = padded[np.where(np.arange(self.stretch)[None, :] < left[:, None], at, len(codes))].T.copy()
        cost = np.empty((len(self.langs), n))
        for k, (own, table) in enumerate(self.tables):
            state, phrases = np.zeros(len(doc), np.int32), np.ones(len(doc), np.int32)
            for column in grid:
                column = own.take(column)
                nxt = table.step(state, column)
                ended = nxt < 0
                phrases += ended
                state = np.where(ended, table.start.take(column), nxt)
            total = np.bincount(doc, phrases, n)
            cost[k] = total * self.weights[k] / np.maximum(sizes, 1)
        order = np.argsort(cost, axis=0, kind="stable")
        best = cost[order[0], np.arange(n)]
        if len(self.langs) > 1:
            second = cost[order[1], np.arange(n)]
            score = second / np.maximum(best + second, 1e-12)
        else:
            score = np.ones(n)
        known = letters > 0
        return {
            "lang_pred": [self.langs[b] if k else UNKNOWN for b, k in zip(order[0], known, strict=True)],
            "score": np.where(known, score, 0.0).tolist(),
        }


_parsers: dict[tuple, CrossParser] = {}


def _parser(samples: list[tuple[str, str]]) -> CrossParser:
    key = tuple(samples)
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


def identify(docs: DataFrame, samples: list[tuple[str, str]] | None = None, text_col: str = "text",
             lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    if samples is None:
        samples = learn(docs, text_col, lang_col, id_col)
    held = docs.sparkSession.sparkContext.broadcast(samples)
    slim = id_text(docs, text_col, id_col, keep_null=True).withColumn("held_out", fold_of(F.col("doc_id"), FOLDS) == HELD_OUT)
    return map_texts(slim, lambda: _parser(held.value).predict, "lang_pred string, score double", ["doc_id", "held_out"],
                     chars=2_000_000)


def drop_unidentified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                      sure: float = SURE) -> DataFrame:
    """Documents whose language is identified and is not another one than they declare, all columns.

    Rejected are documents that get ``und``, and those whose declared language is
    one of the learned ones while another is predicted with a score of at least ``sure``.  A document
    that declares nothing is only asked to have a language.  If no row has a language to learn
    from, nothing can be predicted and all documents stay.
    """
    samples = learn(docs, text_col, lang_col, id_col)
    if not samples:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict, learned = _parser(held.value).predict, {lang for lang, _ in held.value}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            declared = batch.column(batch.schema.get_field_index(lang_col)).to_pylist()
            keep, begin = [], 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end] or "") <= 2_000_000):
                    size += len(texts[end] or "")
                    end += 1
                got = predict(texts[begin:end])
                for lang, score, own in zip(got["lang_pred"], got["score"], declared[begin:end], strict=True):
                    other = own is not None and str(own) in learned and lang != str(own) and score >= sure
                    keep.append(lang != UNKNOWN and not other)
                begin = end
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
