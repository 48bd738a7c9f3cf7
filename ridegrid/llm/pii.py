"""Operator 9: personal data by boosted trees over proposed spans.

Built from DataFrame functions only.

* *Base spans*: fixed patterns with checks (e-mail, ip, card, phone); they are always kept.
* *Generators* propose further, overlapping spans with high recall: number
  groups, long mixed tokens, loose addresses.
* *Features* of a proposal's format and context are small integers.  Training
  pairs come from rules with little error: a proposal that overlaps a
  base span, or is assigned to a secret's name (``token = "..."``), is positive.
  The rules' own evidence (checksum, name) is not among the features, so the
  trees carry the verdict over to proposals that look alike.
* *Boosting* runs on the table of distinct feature vectors with their counts.
  That table holds every proposal of the corpus, yet its size is bounded by
  the product of the features' ranges, whatever the input's size.  The trees become one
  DataFrame expression.
* *Thresholds* are calibrated per generator: the least score above which at
  least ``PRECISION`` of the counted proposals are positive.

Positions are in code points, end exclusive.  Matches of a pattern are placed
by cutting the text at the same pattern and adding up lengths by a window over the text's matches; overlaps
are found by windows over its spans in order.  So the cost is linear in the text and (but for sorting) in its matches.

Defined results: null text counts as empty.  Rows that repeat are each
returned.  An empty table, or one without proposals, adds no spans.  Only the
named columns are read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridegrid.llm.common import stage

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "address")
KINDS = BASE + ADDED

# Possessive forms of the contract's patterns: the same leftmost matches, without backtracking.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+",
    "number": r"(?<![A-Za-z0-9])[+(]?[0-9](?:[ ().-]{0,2}+[0-9]){6,}+(?![A-Za-z0-9])",
    "address": r"(?<![^\s@,;:<>\"'()]{1,3})[^\s@,;:<>\"'()]{1,64}@[^\s@,;:<>\"'()]{2,64}",
}
#: A cheap test that every match of the pattern passes.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None, "number": None, "address": "@"}
NAMES = r"(?i)(?:token|secret|passw(?:or)?d|api.?key|access.?key|auth)\W{1,6}$"
SHORTEST = {"secret": 16, "number": 7, "address": 4}  # characters of a match
CONTEXT = 24
PRECISION = 0.9
ROUNDS, SHRINK, LEAST = 24, 0.4, 4.0
FEATURES = ("generator", "size", "digits", "letters", "marks", "quoted", "assigned", "before", "after")
RANGES = (3, 6, 6, 3, 4, 3, 2, 4, 4)


def _cut(text: Column, kind: str) -> tuple[Column, Column]:
    need = F.lit(True) if NEEDS[kind] is None else F.contains(text, F.lit(NEEDS[kind]))
    if NEEDS[kind] is None:
        need = text.rlike("[0-9]")
    pattern = F.lit(PATTERNS[kind])
    none = F.array().cast("array<string>")
    return (
        F.when(need, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none),
        F.when(need, F.split(text, PATTERNS[kind], -1)).otherwise(none),
    )


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def step(acc: Column, i: Column) -> Column:
        v = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(digits))), F.lit(0), step) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind in ("card", "phone"):
        digits = _digits(found)
        n = F.char_length(digits)
        # A run too long for a card is not summed.
        return F.when(n.between(14, 19), luhn(digits)).otherwise(False) if kind == "card" else n.between(10, 15)
    return F.lit(True)


def _level(value: Column, *cuts: int) -> Column:
    """How many cuts the value reaches."""
    return reduce(lambda acc, c: acc + (value >= c).cast("int"), cuts, F.lit(0))


def _look(x: Column) -> Column:
    """0 nothing, 1 white space, 2 letter or digit, 3 other."""
    return F.when(x == "", 0).when(x.rlike(r"^\s$"), 1).when(x.rlike(r"^[\p{L}\p{N}]$"), 2).otherwise(3)


def _features(kind: int, found: Column, before: Column, after: Column) -> list[Column]:
    n = F.char_length(found)
    digits = F.char_length(_digits(found))
    letters = F.char_length(F.regexp_replace(found, "[^A-Za-z]", ""))
    values = [
        F.lit(kind - len(BASE)), _level(n, 10, 14, 17, 24, 36), _level(digits, 1, 7, 10, 14, 20),
        _level(letters * 4 / n, 1, 3), F.least(F.lit(3), n - digits - letters),
        F.when(before.endswith('"') & after.startswith('"'), 2).when(before.endswith('"') | after.startswith('"'), 1).otherwise(0),
        before.rlike(r"[=:]\W{0,3}$").cast("int"),
        _look(F.right(before, F.lit(1))), _look(after),
    ]
    return [F.array(*[v.cast("int") for v in values]).alias("f"), before.rlike(NAMES).alias("named")]


def _item(kind: int, found: Column, piece: Column, good: Column, f: list[Column]) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.char_length(piece).alias("gap"), F.char_length(found).alias("size"), good.alias("good"), *f)


def _no_features() -> list[Column]:
    return [F.lit(None).cast("array<int>").alias("f"), F.lit(False).alias("named")]


def _items(df: DataFrame, kind: str) -> DataFrame:
    """Replace the cut text of a kind by its matches in order, as ``i_<kind>``: gap to the match before, size, verdicts.

    Everything is read from neighbouring pieces, passed side by side as arrays, so the cost is linear in the matches.
    """
    number, found, pieces = KINDS.index(kind), f"m_{kind}", f"p_{kind}"
    rest = [c for c in df.columns if c not in (found, pieces)]
    before = F.slice(F.col(pieces), F.lit(1), F.size(found))
    if kind in BASE:
        return df.select(*rest, F.zip_with(F.col(found), before, lambda m, p: _item(number, m, p, _valid(kind, m), _no_features())).alias(f"i_{kind}"))
    back = -(-CONTEXT // SHORTEST[kind])  # so many earlier matches can lie in a match's context
    df = df.select(*df.columns, F.transform(pieces, lambda p: F.right(p, F.lit(CONTEXT))).alias("pt"),
                   F.transform(found, lambda m: F.right(m, F.lit(CONTEXT))).alias("mt"), F.transform(pieces, lambda p: F.left(p, F.lit(1))).alias("ph"),
                   F.transform(found, lambda m: F.left(m, F.lit(1))).alias("mh"))
    blank = F.lit("").cast("string")
    shifted = []
    for k in range(back + 1):
        shifted.append(F.concat(F.array_repeat(blank, k), F.slice("pt", F.lit(1), F.size(found))).alias(f"p{k}"))
        if k:
            shifted.append(F.concat(F.array_repeat(blank, k), F.col("mt")).alias(f"m{k}"))
    df = df.select(*rest, F.col(found).alias("m"), before.alias("p"), F.slice("ph", F.lit(2), F.size(found)).alias("next"),
                   F.concat(F.slice("mh", F.lit(2), F.greatest(F.lit(1), F.size(found))), F.array(blank)).alias("then"), *shifted)
    parts = [f"{c}{k}" for k in range(back, 0, -1) for c in ("p", "m")] + ["p0"]
    names = ["m", "p", "next", "then", *parts]
    df = df.select(*rest, F.arrays_zip(*[F.col(c) for c in names]).alias("z"), F.size("m").alias("many"))

    def one(x: Column) -> Column:
        ahead = F.right(F.concat(*[F.coalesce(x[c], blank) for c in parts]), F.lit(CONTEXT))
        behind = F.when(x["next"] != "", x["next"]).otherwise(F.coalesce(x["then"], blank))
        return _item(number, x["m"], x["p"], F.lit(True), _features(number, x["m"], ahead, behind))

    return df.select(*rest, F.transform(F.slice("z", F.lit(1), F.col("many")), one).alias(f"i_{kind}"))


def _onwards():
    """A text's spans from each one to the last, read backwards: a frame that ends at the last row is added up anew for every row."""
    return Window.partitionBy("rid").orderBy(F.desc("begin"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)


def proposals(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents: rid, doc_id) and (spans: rid, kind, begin, end, f, named, taken).

    Spans are valid base ones and all proposals; ``taken`` proposals overlap a base span.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text.alias("text"))
    for kind in KINDS:
        found, pieces = _cut(F.col("text"), kind)
        df = df.withColumn(f"m_{kind}", found).withColumn(f"p_{kind}", pieces)
        df = _items(df, kind)
    marked = stage(df.select("rid", "doc_id", *[f"i_{k}" for k in KINDS]), "pii-matches")
    each = F.explode(F.concat(*[F.transform(f"i_{k}", lambda x, i: F.struct(i.alias("i"), x.alias("x"))) for k in KINDS]))
    rows = marked.select("rid", each.alias("y")).select("rid", "y.i", "y.x.*")
    # One text's matches are one task's work, as the text itself is; both windows use this dealing.
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")
    placed = rows.repartition("rid").withColumn("end", end).withColumn("begin", F.col("end") - F.col("size")).where("good")
    base = F.col("kind") < len(BASE)
    by = Window.partitionBy("rid").orderBy("begin", "kind")
    last = F.max(F.when(base, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(base, F.col("begin"))).over(_onwards())
    taken = F.coalesce(last > F.col("begin"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))
    spans = placed.select("rid", "kind", "begin", "end", "f", "named", (~base & taken).alias("taken"))
    return marked.select("rid", "doc_id"), stage(spans, "pii-spans")


class Boosted:
    """Gradient-boosted trees of depth two on counted feature vectors, with a threshold per generator."""

    def __init__(self, rows: np.ndarray, positive: np.ndarray, total: np.ndarray):
        self.trees: list[tuple] = []
        self.limits = [math.inf] * len(ADDED)
        pos, n = positive.sum(), total.sum()
        self.bias = math.log((pos + 1) / (n - pos + 1))
        score = np.full(len(rows), self.bias)
        for _ in range(ROUNDS if 0 < pos < n else 0):
            p = 1 / (1 + np.exp(-score))
            grad, hess = positive - total * p, total * p * (1 - p)
            tree, values = self._grow(rows, grad, hess, np.ones(len(rows), bool), 2)
            self.trees.append(tree)
            score = score + values
        for g in range(len(ADDED)):
            own = np.flatnonzero(rows[:, 0] == g) if len(rows) else []
            own = sorted(own, key=lambda i: -score[i])
            held = seen = 0.0
            for at, i in enumerate(own):
                held, seen = held + positive[i], seen + total[i]
                tied = at + 1 < len(own) and score[own[at + 1]] == score[i]
                if not tied and held >= PRECISION * seen:
                    self.limits[g] = float(score[i]) - 1e-9

    def _grow(self, rows, grad, hess, here, depth):
        def gain(mask):
            return grad[mask].sum() ** 2 / (hess[mask].sum() + 1.0)

        best, split = 1e-6, None
        if depth:
            for f in range(rows.shape[1]):
                for cut in np.unique(rows[here, f])[1:]:
                    right = here & (rows[:, f] >= cut)
                    left = here & ~right
                    more = gain(left) + gain(right) - gain(here)
                    if more > best and min(hess[left].sum(), hess[right].sum()) > 0:
                        best, split = more, (f, int(cut), left, right)
        if split is None:
            value = SHRINK * grad[here].sum() / (hess[here].sum() + 1.0)
            return ("leaf", float(value)), np.where(here, value, 0.0)
        f, cut, left, right = split
        low, a = self._grow(rows, grad, hess, left, depth - 1)
        high, b = self._grow(rows, grad, hess, right, depth - 1)
        return ("split", f, cut, low, high), a + b

    def expression(self, f: Column) -> Column:
        """The score as a DataFrame expression of the feature array."""
        def tree(node: tuple) -> Column:
            if node[0] == "leaf":
                return F.lit(node[1])
            return F.when(F.get(f, F.lit(node[1])) >= node[2], tree(node[4])).otherwise(tree(node[3]))

        return reduce(lambda a, t: a + tree(t), self.trees, F.lit(self.bias))

    def passes(self, f: Column) -> Column:
        limit = F.element_at(F.array(*[F.lit(v) for v in self.limits]), F.get(f, F.lit(0)) + 1)
        return self.expression(f) >= limit


def learn(spans: DataFrame) -> Boosted:
    """Fit on all proposals of ``proposals()``, through the counts per distinct feature vector."""
    each = spans.where(F.col("kind") >= len(BASE)).select("f", (F.col("taken") | F.col("named")).alias("yes"))
    counts = each.groupBy("f").agg(F.sum(F.col("yes").cast("int")).alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    if len(counts) > math.prod(RANGES):
        raise ValueError(f"{len(counts)} feature vectors, at most {math.prod(RANGES)} are possible")
    counts = sorted(counts, key=lambda r: list(r.f))
    rows = np.array([list(r.f) for r in counts], int).reshape(-1, len(FEATURES))
    return Boosted(rows, np.array([r.pos for r in counts], float), np.array([r.n for r in counts], float))


def find_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, base (spans), spans (base and selected ones; kind, begin, end)."""
    rows, spans = proposals(docs, text_col, id_col)
    model = learn(spans)
    base = F.col("kind") < len(BASE)
    chosen = spans.where(base | (~F.col("taken") & (F.col("named") | model.passes(F.col("f")))))
    # Of selected spans that overlap, the generator listed first wins; base spans never overlap them.
    by = Window.partitionBy("rid").orderBy("begin", "kind")
    beaten = F.lit(False)
    for number in range(len(BASE) + 1, len(KINDS)):
        first = F.col("kind").between(len(BASE), number - 1)
        last = F.max(F.when(first, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
        following = F.min(F.when(first, F.col("begin"))).over(_onwards())
        hit = F.coalesce(last > F.col("begin"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))
        beaten = beaten | ((F.col("kind") == number) & hit)
    kept = chosen.withColumn("beaten", beaten).where(~F.col("beaten"))
    span = F.struct("begin", "kind", "end")
    per = kept.groupBy("rid").agg(F.array_sort(F.collect_list(F.when(base, span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<begin:int,kind:int,end:int>>")
    return rows.join(per, "rid", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def _listing(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["begin"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_spans``' rows."""
    def of(i: int) -> Column:
        return F.filter("base", lambda x: x["kind"] == i)

    counts = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_listing("base").cast("binary"), 256).alias("base_sha256"),
                        _listing("spans").alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[KIND]``; overlapping spans become one, named by the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["begin"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), x["begin"] - acc["at"]))
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.element_at(names, x["kind"] + 1))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), F.char_length(text) - acc["at"]))))
