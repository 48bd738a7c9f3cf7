"""Operator 8: benchmark decontamination by suffix arrays over shards of the training text.

Each task cuts its documents into bounded shards and builds a suffix array of
a shard's word sequence (ordered by the first ``WINDOW`` words).  Every test
suffix is looked up in every shard's array by binary search; the range that
shares the window gives all verbatim occurrences.  Occurrences that continue
each other are joined into longest matches with their locations.  Words that
occur in no benchmark item cannot be part of a match, so suffixes that meet
one within the shortest window are left out of the array; this loses nothing.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text (plus
one item), each checked; a larger benchmark takes one pass per block.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
An item with fewer than ``WINDOW`` words is one window; one without words
has none.  Null texts have no words.  Items that repeat an id count once; a
null item id counts as the empty id.  An empty benchmark leaves all documents
clean.  Rows that repeat are each reported.  Only the named columns are read.
"""

from __future__ import annotations

import uuid
from functools import partial
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.llm.common import filter_rows, id_text, map_texts, stage

WINDOW = 10
BLOCK_BYTES = 32 << 20
SCHEMA = (
    "n_words long, n_hit long, item_ids array<string>, spans array<struct<begin:int,end:int>>, "
    "matches array<struct<item_id:string,doc_word:int,item_word:int,words:int>>"
)

_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class TestSuffixes:
    """Vocabulary and windows of one benchmark block, ready for binary search."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.names: list[str] = []
        self._items: dict[tuple[int, int], frozenset] = {}
        seen: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if ids:
                size = min(window, len(ids))
                for at in range(len(ids) - size + 1):
                    seen.setdefault(tuple(ids[at:at + size]), []).append((len(self.names), at))
                self.names.append("" if name is None else str(name))
        self.lengths: list[tuple[int, np.ndarray, np.ndarray, list[list[tuple[int, int]]]]] = []
        for size in sorted({len(k) for k in seen}):
            keys = [k for k in seen if len(k) == size]
            low = np.zeros((len(keys), window), dtype=">i4")
            low[:, :size] = keys
            high = low.copy()
            high[:, size - 1] += 1
            self.lengths.append((size, self.pack(low), self.pack(high), [seen[k] for k in keys]))
        self.shortest = self.lengths[0][0] if self.lengths else window + 1

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """Rows of big-endian ids as byte strings, whose order is the order of the id sequences."""
        return np.ascontiguousarray(rows).view(f"S{4 * self.window}").ravel()

    def search(self, texts: list[str | None], places: bool = True) -> dict[str, list]:
        """Matches of all test suffixes in the shard made of ``texts``.

        Hit words and items come from window numbers alone.  Only with ``places`` every occurrence is laid against
        every place of its window in the items, to give the longest matches; on periodic texts and items that is their product.
        """
        get, flat, starts, counts, at = self.vocab.get, [np.zeros(1, np.int32)], [], [], 1
        for text in texts:
            words = words_of(text)
            starts.append(at)
            counts.append(len(words))
            flat.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            flat.append(np.zeros(1, np.int32))  # no match crosses documents
            at += len(words) + 1
        ids = np.concatenate(flat)
        found = self._occurrences(ids)
        begin = np.asarray(starts, dtype=np.int64)
        cover = np.zeros(len(ids) + 1, np.int32)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        items: list[set] = [set() for _ in texts]
        for size, pos, window_ids, holders in found:
            cover += np.bincount(pos, minlength=len(cover)).astype(np.int32)
            cover -= np.bincount(pos + size, minlength=len(cover)).astype(np.int32)
            doc = np.searchsorted(begin, pos, "right") - 1
            once = np.unique(doc * len(holders) + window_ids)  # each window of a document once
            for d, w in zip((once // len(holders)).tolist(), (once % len(holders)).tolist(), strict=True):
                items[d].update(self.items_of(holders, size, w))
            if not places:
                continue
            many = np.fromiter(map(len, holders), np.int64, len(holders))
            flat_holders = np.asarray([h for hs in holders for h in hs], dtype=np.int64).reshape(-1, 2)
            first = np.concatenate([[0], np.cumsum(many)])
            reps = many[window_ids]
            inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            held = flat_holders[np.repeat(first[window_ids], reps) + inner]
            pairs.append((np.repeat(pos, reps), held[:, 0], held[:, 1], size))
        hit = np.cumsum(cover[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
        n = len(texts)
        spans: list[list] = [[] for _ in range(n)]
        for (a, b), d in zip(edges.tolist(), (np.searchsorted(begin, edges[:, 0], "right") - 1).tolist(), strict=True):
            spans[d].append({"begin": a - starts[d], "end": b - starts[d]})
        matches: list[list] = [[] for _ in range(n)]
        for pos, item, where, size in pairs:
            if not len(pos):
                continue
            order = np.lexsort((pos, item, pos - where))
            pos, item, where = pos[order], item[order], where[order]
            new = np.ones(len(pos), bool)
            new[1:] = (item[1:] != item[:-1]) | (np.diff(pos) != 1) | (np.diff(where) != 1)
            heads = np.flatnonzero(new)
            runs = np.diff(np.append(heads, len(pos)))
            docs = np.searchsorted(begin, pos[heads], "right") - 1
            for d, p, i, w, r in zip(docs.tolist(), pos[heads].tolist(), item[heads].tolist(),
                                     where[heads].tolist(), runs.tolist(), strict=True):
                matches[d].append({"item_id": self.names[i], "doc_word": p - starts[d], "item_word": w, "words": r + size - 1})
        return {
            "n_words": counts, "n_hit": [sum(s["end"] - s["begin"] for s in x) for x in spans],
            "item_ids": [sorted({self.names[i] for i in x}) for x in items], "spans": spans, "matches": matches,
        }

    def items_of(self, holders: list[list[tuple[int, int]]], size: int, window: int) -> frozenset:
        """Numbers of the items that hold a window, remembered."""
        known = self._items.get((size, window))
        if known is None:
            known = self._items[size, window] = frozenset(item for item, _ in holders[window])
        return known

    def _occurrences(self, ids: np.ndarray):
        """(window length, positions, window number at each, holders by window) found in the suffix array."""
        if not self.lengths:
            return []
        stops = np.flatnonzero(ids == 0)
        at = np.flatnonzero(ids)
        run = stops[np.searchsorted(stops, at)] - at  # known words from here on
        keep = run >= self.shortest
        at, run = at[keep], np.minimum(run[keep], self.window)
        if not len(at):
            return []
        rows = np.zeros((len(at), self.window), dtype=">i4")
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)])
        for j in range(self.window):
            rows[:, j] = np.where(run > j, padded[at + j], 0)
        keys = self.pack(rows)
        order = np.argsort(keys, kind="stable")
        suffixes, keys = at[order], keys[order]
        out = []
        for size, low, high, holders in self.lengths:
            a, b = np.searchsorted(keys, low), np.searchsorted(keys, high)
            many = b - a
            window_ids = np.repeat(np.arange(len(low)), many)
            inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out.append((size, suffixes[np.repeat(a, many) + inner], window_ids, holders))
        return out


def blocks(bench: DataFrame, text_col: str = "text", id_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark as broadcasts of bounded size: more blocks, until none holds more than ``block_bytes`` and one item."""
    spark = bench.sparkSession
    items = bench.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text")).distinct()
    items = stage(items, "decon-items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + 2 * total // block_bytes  # half full on average
    while True:
        keyed = items.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n)))
        sizes = keyed.groupBy("block").agg(F.sum(F.octet_length("text")).alias("size"), F.max(F.octet_length("text")).alias("largest"))
        if sizes.where(F.col("size") > block_bytes + F.col("largest")).isEmpty():
            break
        n *= 2
    out = []
    for b in range(n):
        rows = [(r.name_, r.text) for r in keyed.where(F.col("block") == b).select(F.col("name").alias("name_"), "text").collect()]
        out.append(spark.sparkContext.broadcast(rows))
    return out


_indexes: dict[tuple[str, int], TestSuffixes] = {}


def _searcher(block, window: int, places: bool):
    """What a task calls once; the index of a benchmark block is built once per worker process (one is kept)."""
    name = (uuid.uuid4().hex, window)

    def make():
        if name not in _indexes:
            _indexes.clear()
            _indexes[name] = TestSuffixes(sorted(block.value, key=str), window)
        return partial(_indexes[name].search, places=places)

    return make


def contamination(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW,
    bench_text: str = "text", bench_id: str = "item_id", block_bytes: int = BLOCK_BYTES, places: bool = True,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids, spans (hit words), matches (longest, with locations; none without ``places``)."""
    parts = blocks(bench, bench_text, bench_id, block_bytes)
    slim = id_text(docs, text_col, id_col, keep_null=True)
    if len(parts) == 1:
        return map_texts(slim, _searcher(parts[0], window, places), SCHEMA, ["doc_id"])
    pinned = stage(slim.withColumn("rid", F.monotonically_increasing_id()), "decon-docs")
    found = None
    for part in parts:
        one = map_texts(pinned, _searcher(part, window, places), SCHEMA, ["rid", "doc_id"])
        found = one if found is None else found.union(one)
    merged = found.groupBy("rid", "doc_id", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.flatten(F.collect_list("matches")).alias("matches"),
    )
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end"))

    def add(acc, span):
        fresh = F.greatest(F.lit(0), span["end"] - F.greatest(span["begin"], acc["end"]))
        return F.struct((acc["hit"] + fresh).alias("hit"), F.greatest(acc["end"], span["end"]).alias("end"))

    n_hit = F.aggregate("spans", start, add, lambda acc: acc["hit"])
    return merged.select("doc_id", "n_words", n_hit.alias("n_hit"), "item_ids", "spans", "matches")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``contamination``'s rows."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = WINDOW,
                      bench_text: str = "text", bench_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without any benchmark window, all columns; one filter per benchmark block, no shuffle."""
    out = docs
    for part in blocks(bench, bench_text, bench_id, block_bytes):

        def make(ready=_searcher(part, window, False)):
            search = ready()

            def clean(texts: list) -> list:
                keep, begin = [], 0
                while begin < len(texts):  # bounded shards
                    end, held = begin, 0
                    while end < len(texts) and (end == begin or held + len(texts[end] or "") <= 4_000_000):
                        held += len(texts[end] or "")
                        end += 1
                    keep += [n == 0 for n in search(texts[begin:end])["n_hit"]]
                    begin = end
                return keep

            return clean

        out = filter_rows(out, make, text_col)
    return out
