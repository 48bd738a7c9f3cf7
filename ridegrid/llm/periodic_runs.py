"""Operator 11: maximal repetitions of words ("runs") found on a Re-Pair grammar.

The words of a bounded batch of texts are numbered and compressed by Re-Pair:
pairs of neighbouring symbols that occur more than once become nonterminals,
more frequent pairs before rarer ones, all pairs that win against the pairs
they overlap with in one round.  Pairs never cross texts.  What is left of a
text is joined by a balanced tree, so every text is derived from one symbol.

A run lies inside the derivation of some lowest symbol and crosses the
boundary between that symbol's two halves.  So each distinct nonterminal is
looked at once, at one of its occurrences: a run of period q that crosses the
boundary c compares equal, at distance q, at word c-1 or at word c-q.  These places are the
occurrences of the two boundary words; from each the equal stretch is
measured to both sides inside the symbol (first word by word, then by binary search on
two prefix hashes modulo primes, error below 2^-60 a comparison).  Found runs are
translated to all derivation positions of the symbol, and intervals of one
period that overlap by a period or more are merged: an interval cut off at the end
of a symbol is part of a run of a symbol above it.

A run: a stretch of words with smallest period q, of at least
``max(MIN_LENGTH, 2q)`` words, that no neighbouring word extends.

Memory: a few hundred bytes per word of the batch; a batch holds one text or at most
``BATCH`` bytes.

Defined results: null and empty texts have no words and no runs.  A null doc_id
counts as the empty text wherever its decimal form is asked for.  Rows that
repeat are each returned; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.llm.common import fresh, map_texts

MIN_LENGTH = 12
BATCH = 1_500_000
CANDIDATES = 1_000_000  # compared at a time, unless one symbol alone has more
SHORT = 6  # every run compares equal on at least so many words: max(q, MIN_LENGTH - q) >= 6

_WORD = re.compile(r"[^ \t-\r]+")
_PRIMES = (np.int64(2147483647), np.int64(2147483629))
_BASES = (np.int64(1103515245), np.int64(1664525017))


def split_words(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Symbols:
    """Binary symbols of a grammar: halves ``[start, cut)`` and ``[cut, end)`` at one occurrence, and all occurrences."""

    def __init__(self):
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._count = 0

    def add(self, start: np.ndarray, cut: np.ndarray, end: np.ndarray, member: np.ndarray, places: np.ndarray) -> None:
        """``places``: starts of all occurrences; ``member``: which of the symbols each belongs to."""
        keep = end - start >= MIN_LENGTH
        if not keep.all():
            number = np.cumsum(keep) - 1
            wanted = keep[member]
            start, cut, end = start[keep], cut[keep], end[keep]
            member, places = number[member[wanted]], places[wanted]
        if len(start):
            self._parts.append((start, cut, end, member + self._count, places))
            self._count += len(start)

    def arrays(self) -> tuple[np.ndarray, ...]:
        if not self._parts:
            none = np.zeros(0, np.int64)
            return none, none, none, none, none
        return tuple(np.concatenate(x) for x in zip(*self._parts, strict=True))


def _winners(key: np.ndarray, many: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Which of the repeated pairs (at ascending places ``index``) are replaced: no two that overlap.

    A pair that overlaps itself (a a a) takes every second place; of different
    overlapping pairs the one of the higher frequency class wins, ties by a hash of the pair.
    """
    touch = index[1:] == index[:-1] + 1
    same = touch & (key[1:] == key[:-1])
    n = len(index)
    number = np.arange(n)
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), number, 0))
    win = (number - begin) % 2 == 0
    rank = (np.floor(np.log2(many)).astype(np.uint64) << np.uint64(57)) | (_mix(key) >> np.uint64(7))
    rival = touch & ~same
    win[1:] &= ~rival | (rank[1:] > rank[:-1])
    win[:-1] &= ~rival | (rank[:-1] > rank[1:])
    return win


def grammar(codes: np.ndarray, doc: np.ndarray) -> Symbols:
    """Re-Pair over all texts at once, then a balanced tree over the rest of each text."""
    out, n = Symbols(), len(codes)
    symbol, at = codes.astype(np.int64), np.arange(n)
    fresh_id = int(codes.max()) + 1 if n else 0
    live = doc[1:] == doc[:-1]  # pairs that may occur twice
    while True:
        index = np.flatnonzero(live)
        if not len(index):
            break
        key = symbol[index] << np.int64(32) | symbol[index + 1]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        many = count[inverse]
        again = many > 1
        live[index[~again]] = False
        index, key, many = index[again], key[again], many[again]
        if not len(index):
            break
        win = _winners(key, many, index)
        index, key = index[win], key[win]
        if not len(index):  # two pairs of equal rank only: left to the tree
            break
        end_of = np.append(at[1:], n)
        _, first, member = np.unique(key, return_index=True, return_inverse=True)
        one = index[first]
        out.add(at[one], at[one + 1], end_of[one + 1], member, at[index])
        symbol[index] = fresh_id + member
        fresh_id += len(first)
        fresh_pair = np.zeros(len(symbol), bool)
        fresh_pair[index] = True
        keep = np.ones(len(symbol), bool)
        keep[index + 1] = False
        old_live = np.append(live, False)
        old_live[index] = old_live[index + 1]  # the pair behind the new symbol
        symbol, at, new, old_live = symbol[keep], at[keep], fresh_pair[keep], old_live[keep]
        joined = doc[at[1:]] == doc[at[:-1]]
        live = joined & (old_live[:-1] | new[1:] | new[:-1])
    while len(at) > 1:
        joined = doc[at[1:]] == doc[at[:-1]]
        if not joined.any():
            break
        number = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~joined]), number, 0))
        index = np.flatnonzero(joined & ((number[:-1] - begin[:-1]) % 2 == 0))
        end_of = np.append(at[1:], n)
        out.add(at[index], at[index + 1], end_of[index + 1], np.arange(len(index)), at[index])
        keep = np.ones(len(at), bool)
        keep[index + 1] = False
        at = at[keep]
    return out


class _Equal:
    """How far two places of the word sequence agree."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        n = len(codes)
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            power = np.ones(n + 1, np.int64)
            have, step = 1, base
            while have <= n:
                more = min(have, n + 1 - have)
                power[have:have + more] = power[:more] * step % prime
                have += more
                step = step * step % prime
            value = (_mix(codes) >> np.uint64(34)).astype(np.int64) + 1
            self.tables.append((prime, power, np.concatenate([[0], np.cumsum(value * power[:n] % prime)])))

    def same(self, a: np.ndarray, shift: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Do the ``size`` words from ``a`` equal those from ``a + shift``?"""
        out = np.ones(len(a), bool)
        for prime, power, total in self.tables:
            one = (total[a + size] - total[a]) % prime
            two = (total[a + shift + size] - total[a + shift]) % prime
            out &= one * power[shift] % prime == two
        return out

    def reach(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Equal words at distance ``shift`` from ``at`` on (``back``: before it), up to ``most``."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            begin = at[open_] - middle if back else at[open_]
            good = self.same(begin, shift[open_], middle)
            low[open_] = np.where(good, middle, low[open_])
            high[open_] = np.where(good, high[open_], middle - 1)

    def few(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """As ``reach``, counting no further than ``SHORT``, word by word."""
        got, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
        for step in range(SHORT):
            open_ = open_[most[open_] > step]
            place = at[open_] - 1 - step if back else at[open_] + step
            open_ = open_[self.codes[place] == self.codes[place + shift[open_]]]
            if not len(open_):
                break
            got[open_] += 1
        return got


def _crossing(symbols: tuple[np.ndarray, ...], codes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs (symbol number, start, end, period) that cross a symbol's boundary, inside that symbol."""
    start, cut, end = symbols[:3]
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    sorted_ = codes[order] * n + order
    equal = _Equal(codes)
    last, first = codes[cut - 1] * n, codes[cut] * n
    # Occurrences of the word before the boundary in the right half, and of the word behind it in the left half.
    ranges = [(np.searchsorted(sorted_, last + cut), np.searchsorted(sorted_, last + end)),
              (np.searchsorted(sorted_, first + start), np.searchsorted(sorted_, first + cut))]
    size = sum(high - low for low, high in ranges)
    chunk = np.cumsum(size) // CANDIDATES
    for part in np.split(np.arange(len(start)), np.flatnonzero(chunk[1:] != chunk[:-1]) + 1):
        node, at, period = [], [], []
        for side, (low, high) in enumerate(ranges):
            many = (high - low)[part]
            owner = np.repeat(part, many)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            place = order[low[owner] + within]
            node.append(owner)
            at.append(cut[owner] - 1 if side == 0 else place)
            period.append(place - cut[owner] + 1 if side == 0 else cut[owner] - place)
        node, at, period = (np.concatenate(x) for x in (node, at, period))
        need = np.maximum(period, MIN_LENGTH - period)
        fits = end[node] - start[node] - period >= need
        node, at, period, need = node[fits], at[fits], period[fits], need[fits]
        ahead, behind = end[node] - period - at, at - start[node]
        right = equal.few(at, period, ahead, False)
        left = equal.few(at, period, behind, True)
        likely = np.flatnonzero(left + right >= SHORT)
        node, at, period, need = node[likely], at[likely], period[likely], need[likely]
        right = equal.reach(at, period, ahead[likely], False)
        left = equal.reach(at, period, behind[likely], True)
        long = np.flatnonzero(left + right >= need)
        node, period = node[long], period[long]
        begin, stop = at[long] - left[long], at[long] + right[long] + period
        by = np.lexsort((period, stop, begin, node))  # of periods of one interval the smallest is the run's
        node, begin, stop, period = node[by], begin[by], stop[by], period[by]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1])
        if new.any():
            yield node[new], begin[new], stop[new], period[new]


def find_runs(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs (text number, start, length, period) of texts of ``sizes`` words, by text, start and period."""
    codes = np.asarray(codes, np.int64)
    sizes = np.asarray(sizes, np.int64)
    none = np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    symbols = grammar(codes, doc).arrays()
    found = list(_crossing(symbols, codes)) if len(symbols[0]) else []
    if not found:
        return none, none, none, none
    node, begin, stop, period = (np.concatenate(x) for x in zip(*found, strict=True))
    start, _, _, member, places = symbols
    by = np.argsort(member, kind="stable")  # places of each symbol in a row
    many = np.bincount(member, minlength=len(start))
    first = np.cumsum(many) - many
    run = np.repeat(np.arange(len(node)), many[node])
    within = np.arange(len(run)) - np.repeat(np.cumsum(many[node]) - many[node], many[node])
    shift = places[by[first[node[run]] + within]] - start[node[run]]
    begin, stop, period = begin[run] + shift, stop[run] + shift, period[run]
    text = doc[begin]
    by = np.lexsort((-stop, begin, period, text))
    text, begin, stop, period = text[by], begin[by], stop[by], period[by]
    other = np.ones(len(text), bool)
    other[1:] = (text[1:] != text[:-1]) | (period[1:] != period[:-1])
    group = np.cumsum(other) - 1
    big = np.int64(len(codes) + 1)
    furthest = np.maximum.accumulate(group * big + stop)
    new = other.copy()
    new[1:] |= group[1:] * big + begin[1:] + period[1:] > furthest[:-1]
    heads = np.flatnonzero(new)
    stop = np.maximum.reduceat(stop, heads)
    text, begin, period = text[heads], begin[heads], period[heads]
    base = np.cumsum(sizes) - sizes
    by = np.lexsort((period, begin, text))
    return text[by], (begin - base[text])[by], (stop - begin)[by], period[by]


def repeated_words(n: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which of n words lie in some run behind its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts + periods, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def rewrite(n: int, doc_id: str) -> np.ndarray | None:
    """Which original word each word becomes; None if the document stays as it is."""
    h = zlib.crc32(doc_id.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _sha(data: str) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass")).hexdigest()


def analyse(texts: list[list[str]]) -> list[dict]:
    """Runs of each word list: n_runs, the longest one, and digests of all runs and of the words without repeats."""
    known: dict[str, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), np.int64, int(sizes.sum()))
    text, start, length, period = find_runs(codes, sizes)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for d, words in enumerate(texts):
        low, high = bounds[d], bounds[d + 1]
        if low == high:
            out.append({"n_runs": 0, "start": None, "length": None, "period": None, "exponent_milli": None,
                        "runs_sha256": _sha(""), "collapsed_sha256": _sha(" ".join(words))})
            continue
        s, l, q = start[low:high], length[low:high], period[low:high]
        best = int(np.lexsort((q, s, -l))[0])
        drop = repeated_words(len(words), s, l, q)
        kept = [words[i] for i in np.flatnonzero(~drop).tolist()]
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), l.tolist(), q.tolist(), strict=True))
        out.append({"n_runs": int(high - low), "start": int(s[best]), "length": int(l[best]), "period": int(q[best]),
                    "exponent_milli": 1000 * int(l[best]) // int(q[best]),
                    "runs_sha256": _sha(lines), "collapsed_sha256": _sha(" ".join(kept))})
    return out


SCHEMA = ("n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def periodic_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", plant: bool = False) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    ``plant``: first rewrite every tenth document (by the crc32 of its id) so that it is periodic from some word on.
    """
    def make():
        def run(rows: list) -> dict[str, list]:
            texts = []
            for row in rows:
                size, rest = row.split("\n", 1)
                words = split_words(rest[int(size):])
                becomes = rewrite(len(words), rest[:int(size)]) if plant else None
                texts.append(words if becomes is None else [words[i] for i in becomes.tolist()])
            got = analyse(texts)
            return {k: [g[k] for g in got] for k in got[0]} if got else {k.split()[0]: [] for k in SCHEMA.split(", ")}

        return run

    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.concat(
        F.length(name).cast("string"), F.lit("\n"), name, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("row"))
    return map_texts(slim, make, SCHEMA, ["doc_id"], chars=BATCH, text_col="row")


def runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every run of every document: doc_id, start, length, period."""
    def make():
        def run(batch: list) -> dict[str, list]:
            words = [split_words(t) for t in batch]
            known: dict[str, int] = {}
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            codes = np.fromiter((known.setdefault(w, len(known)) for x in words for w in x), np.int64, int(sizes.sum()))
            text, *cols = find_runs(codes, sizes)
            bounds = np.searchsorted(text, np.arange(len(words) + 1))
            rows = list(zip(*(c.tolist() for c in cols), strict=True))
            return {"runs": [[{"start": a, "length": b, "period": c} for a, b, c in rows[bounds[d]:bounds[d + 1]]]
                             for d in range(len(words))]}

        return run

    listed = fresh(docs.select(F.col(id_col).alias("doc_id")), "runs")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    got = map_texts(slim, make, f"{listed} array<struct<start:long,length:long,period:long>>", ["doc_id"], chars=BATCH)
    return got.select("doc_id", F.explode(listed).alias("run")).select("doc_id", "run.start", "run.length", "run.period")
