"""Operators 11 to 13 against brute force, gradients by differences, and odd tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridegrid.llm import conversation_repair as cr
from ridegrid.llm import periodic_runs as pr
from ridegrid.llm import toxicity as tx
from ridegrid.llm.common import fold_of, prepare, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return table(spark, SF, "documents")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 11 periodic runs --------------------------------------------------------


def brute_runs(words):
    """All (start, length, period) by the definition: equal stretches per distance, smallest period first."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(12, 2 * q):
                found.setdefault((i, size), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(rng):
    n = rng.choice([0, 1, 5, 11, 12, 13, 30, 60, 150])
    words = [rng.randrange(rng.choice([1, 2, 3, 5, 40])) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    if rng.random() < 0.2:  # Fibonacci words are full of runs
        x, y = [0], [0, 1]
        while len(y) < n:
            x, y = y, y + x
        words = y[:n]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(120):
        texts = [random_words(rng) for _ in range(rng.randint(1, 5))]
        sizes = [len(t) for t in texts]
        found = [[] for _ in texts]
        for d, *run in zip(*(x.tolist() for x in pr.find_runs(np.array([w for t in texts for w in t], np.int64), sizes)), strict=True):
            found[d].append(tuple(run))
        assert found == [brute_runs(t) for t in texts]


def test_grammar_derives_every_text():
    """Expanding each symbol at each of its places gives the words there; pairs that repeat share a symbol."""
    rng = random.Random(5)
    words = np.array([rng.randrange(4) for _ in range(400)] * 3, np.int64)
    start, cut, end, member, places = pr.grammar(words, np.repeat([0, 1], [700, 500])).arrays()
    assert (start < cut).all() and (cut < end).all()
    for s, p in zip(start[member].tolist(), places.tolist(), strict=True):
        size = int(end[start == s].max() - s) if (start == s).sum() == 1 else None
        if size:
            assert (words[s:s + size] == words[p:p + size]).all()
    assert len(places) > len(start)  # repeated symbols are looked at once
    assert {int(e - s) for s, e in zip(start, end, strict=True)} >= {700, 500}  # both texts have one root


def test_long_repetitive_texts_stay_cheap():
    assert [x.tolist() for x in pr.find_runs(np.zeros(200_000, np.int64), [200_000])] == [[0], [0], [200_000], [1]]
    n = 60_000
    words = np.tile(np.arange(20_000), 3)
    assert [x.tolist() for x in pr.find_runs(words, [n])] == [[0], [0], [n], [20_000]]


def expected_runs(doc_id, text):
    words = pr.split_words(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


ODD_TEXTS = [
    (1, "a b " * 40), (1, "a b " * 40), (2, None), (3, ""), (4, " \t\r\n\x0b\x0c "), (None, "x " * 30), (None, None), (5, "y z " * 9),
    (6, "\x1c a\x1cb " * 20), (7, "lorem ipsum dolor sit amet " * 3 + "one two three"), (8, "😀 é " * 12), (9, "w" * 5000), (10, "a\nb\n" * 6 + "a"),
    (11, " ".join(f"w{i % 700}" for i in range(2100))),
]


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", None, 3, "r") for i, t in rows],
                                 "doc_id long, text string, runs string, start long, row int, score string")


def test_periodic_runs_query(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 6000]
    got = pr.periodic_runs(docs.where(F.length(F.coalesce("text", F.lit(""))) < 6000), plant=True).collect()
    assert sorted(map(tuple, got)) == sorted(expected_runs(*r) for r in rows)


def test_periodic_runs_odd(spark):
    prepare(spark)
    odd = odd_docs(spark, ODD_TEXTS)
    got = pr.periodic_runs(odd, plant=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected_runs(*r) for r in ODD_TEXTS), key=str)
    assert pr.periodic_runs(odd.limit(0)).count() == 0
    listed = defaultdict(list)
    for r in pr.runs(odd.where("doc_id > 5")).collect():
        listed[r.doc_id].append((r.start, r.length, r.period))
    assert listed == {i: brute_runs(pr.split_words(t)) for i, t in ODD_TEXTS if i and i > 5 and brute_runs(pr.split_words(t))}


# -- 12 conversation repair --------------------------------------------------


def all_edits(rows):
    """(cost, audit, repaired lines) of every edit script with at most two inserts in a row; rows: (role, text, fault)."""
    best = {}

    def better(state, cost, audit, lines):
        if state not in best or (cost, audit) < best[state][:2]:
            best[state] = (cost, audit, lines)

    frontier = {0: (0, "", [])}
    for item in [*rows, None]:
        best = {}
        for state, (cost, audit, lines) in frontier.items():
            todo = [(state, cost, audit, lines)]
            for _ in range(3):
                s, c, a, ls = todo[-1]
                nxt = cr.NEXT[s]
                todo.append((nxt, c + 2, a + "I", [*ls, ("user" if nxt == 2 else "assistant") + ":"]))
            for s, c, a, ls in todo:
                if item is None:
                    better(s, c, a, ls)
                    continue
                role, text, fault = item
                better(s, c + 3, a + "D", ls)
                if fault in (1, 2):
                    continue
                extra = 1 if fault == 3 else 0
                first = role[:1]
                to = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(first)
                if to:
                    better(to, c + extra, a + "K", [*ls, f"{role}:{text}"])
                nxt = cr.NEXT[s]
                better(nxt, c + 2 + extra, a + "R", [*ls, ("user:" if nxt == 2 else "assistant:") + text])
        frontier = best
    return min(frontier[s] for s in (0, 3) if s in frontier)


def expected_repair(rows, harmed=True):
    """Rows: (conv_id, turn, role, text)."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if harmed else 19
        talks[conv]
        if h == 0:
            continue
        text = "" if h == 1 else text.translate({ord(c): None for c in ".!?"}) if h == 2 else text
        talks[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, turns in talks.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in turns:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            marked.append((role, text, 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0))
            seen.add((role, text))
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = [f for *_, f in marked]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, lines = all_edits(marked) if marked else (0, "", [])
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha("\n".join(lines)))
    return out


def random_talk(rng, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "s", "User"]
    texts = ["Hi there.", "What?", "no end", "", " \n", None, "Fine!", "Fine! \t", "é…"]
    turns = rng.sample(range(3 * n), n) if n else []
    return [(conv, rng.choice([t, t, t, t, None]), rng.choice(roles), rng.choice(texts)) for t in turns]


def found_repair(df, **kw):
    return {r.conv_id: tuple(r)[1:] for r in cr.repair(df, **kw).collect()}


CONV = "conv_id long, turn long, role string, text string, ck string, gid long, block string, act int"


@pytest.mark.parametrize("block", [4096, 4, 1])
def test_repair_equals_all_edits(spark, block, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(cr, "BLOCK", block)
    rng = random.Random(block)
    rows = [r for c in range(40) for r in random_talk(rng, c if c else None, rng.choice([1, 2, 3, 5, 9, 14]))]
    rows += rows[:4]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1, "b", 2) for r in rows], CONV)
    want = expected_repair(rows)
    got = found_repair(df, harmed=True)
    # columns: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256
    assert got == want


def test_repair_query_and_empty(spark):
    prepare(spark)
    talks = table(spark, SF, "conversations")
    rows = [tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()]
    assert found_repair(talks, harmed=True) == expected_repair(rows)
    assert cr.repair(talks.limit(0), harmed=True).count() == 0


def test_repair_of_one_long_conversation(spark, monkeypatch):
    """Most rows in one conversation: its blocks are settled apart, and the result is the same."""
    prepare(spark)
    monkeypatch.setattr(cr, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant"]), f"{t % 97} {rng.choice(['ends.', 'open'])}") for t in range(600)]
    rows += [(6, t, "user", "One.") for t in range(3)]
    df = spark.createDataFrame([(*r, "x", 1, "b", 2) for r in rows], CONV)
    assert found_repair(df) == expected_repair(rows, harmed=False)
    fixed = cr.repair_rows(df.select("conv_id", "turn", "role", "text")).collect()
    roles = defaultdict(list)
    for r in sorted(fixed, key=lambda r: (r.conv_id, r.turn)):
        roles[r.conv_id].append(r.role)
    for own in roles.values():
        assert own == ["user", "assistant"] * (len(own) // 2)


def test_run_powers_equal_single_steps():
    table_ = cr.Transitions()
    for symbol in ("s", "u", "a!", "?", cr.MUST_GO):
        after = cr.END
        for length in range(1, 40):
            after = table_.row(symbol, after)
            assert table_.run(symbol, length, cr.END) == after


# -- 13 toxicity -------------------------------------------------------------


def test_recurrent_gradients_equal_differences():
    rng = np.random.default_rng(3)
    net = tx.Network(seed=1)
    net.p = {k: v.astype(np.float64) * 2 for k, v in net.p.items()}
    steps, many = 5, 3
    words, grams = rng.integers(1, 30, (steps, many)), rng.integers(0, 20, (steps, many, 4))
    mask = np.ones((steps, many))
    mask[3:, 1] = 0
    odds, label, weight = rng.normal(size=(steps, many)), np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.3, 0.2])

    class Exact(tx.Network):
        def inputs(self, words, grams, odds):
            many = np.maximum((grams > 0).sum(-1, keepdims=True), 1)
            chars = (self.p["grams"][grams] * (grams > 0)[..., None]).sum(-2) / many
            return np.concatenate([self.p["words"][words], chars, odds[..., None]], -1)

    net.__class__ = Exact
    _, grads = net.loss_grads(words, grams, odds, mask, label, weight)
    for name, value in net.p.items():
        flat = value.reshape(-1)
        some = rng.choice(np.flatnonzero(grads[name].reshape(-1)) if grads[name].any() else np.arange(len(flat)), 4)
        for i in some.tolist():
            old, eps = flat[i], 1e-4
            flat[i] = old + eps
            up = net.loss_grads(words, grams, odds, mask, label, weight)[0]
            flat[i] = old - eps
            down = net.loss_grads(words, grams, odds, mask, label, weight)[0]
            flat[i] = old
            assert abs((up - down) / (2 * eps) - grads[name].reshape(-1)[i]) < 2e-3 * max(1, abs(grads[name]).max()), name


def test_windows_cover_every_word():
    for n in range(0, 400):
        starts = tx.window_starts(n)
        assert starts[0] == 0 and (n <= tx.WINDOW or starts[-1] + tx.WINDOW >= n)
        assert (np.diff(starts) <= tx.STRIDE).all() and (np.diff(starts) < tx.WINDOW).all()


def test_scores_do_not_depend_on_batches():
    rng = random.Random(2)
    net = tx.Network()
    odds = np.random.default_rng(1).normal(size=tx.BUCKETS).astype(np.float32)
    texts = [None, "", "...", "one", " ".join(rng.choice(["a", "bad", "Good", "x" * 90]) for _ in range(500)), "a b c"]
    together = tx.Scorer(net, odds).score(texts)
    alone = [float(tx.Scorer(net, odds).score([t])[0]) for t in texts]
    assert np.allclose(together, alone, atol=1e-5)
    # the document's score is that of its most toxic window
    words = tx.words_of(texts[4])
    windows = [" ".join(words[s:s + tx.WINDOW]) for s in tx.window_starts(len(words))]
    assert abs(max(tx.Scorer(net, odds).score(windows)) - together[4]) < 1e-5


def test_toxicity_learns_from_labels(spark):
    """Held-out documents of sf0.01: nearly all toxic ones found, clean ones left alone; other columns play no part."""
    prepare(spark)
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r for r in tx.score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i].predicted == truth[i] for i in held]) >= 0.9
    clean = [i for i, t in truth.items() if t == 0]
    assert np.mean([got[i].predicted for i in clean]) <= 0.05
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_toxicity_odd(spark):
    prepare(spark)
    odd = odd_docs(spark, [*ODD_TEXTS, (20, "you idiot " * 30), (21, "a fine day " * 30), (21, "a fine day " * 30)])
    labels = spark.createDataFrame([(20, 1, "a"), (20, 1, "b"), (21, 0, "c"), (7, 0, "d"), (99, 1, "e"), (None, 1, "f"), (8, None, "g")],
                                   "doc_id long, toxic int, score string")
    got = tx.score_toxicity(odd, labels).collect()
    assert len(got) == len(ODD_TEXTS) + 3 and all(0 <= r.score <= 1 for r in got)
    assert tx.score_toxicity(odd.limit(0), labels).count() == 0
    unlearned = tx.score_toxicity(odd, labels.limit(0)).collect()
    assert {r.score for r in unlearned} == {0.5}
    one = labels.where((F.col("toxic") == 0) & (fold_of(F.col("doc_id"), 5) != 0))
    assert {r.score for r in tx.score_toxicity(odd, one).collect()} <= {0.0, 0.5}
