"""Operator 12: repair of conversations by a run-length min-plus dynamic program.

The cheapest edits that turn the rows of a conversation into ``(s?(ua)+)?``
(initials of system, user, assistant): Keep 0, Rerole to user or assistant 2,
Delete 3 (required for blank and duplicate rows), Insert an empty user or
assistant turn 2; a truncated row that stays adds 1.  Of equally cheap edits
the ASCII-least audit (string of initials) is taken.

* A row becomes a symbol: role initial and fault.  Its transition between the
  four grammar states (nothing, s, u, a) is a min-plus matrix.  Equal symbols in a row are
  one run; a run of L rows costs the binary powers of its matrix, which are cached.
* Rows get one global order (conversation, turn) by a range-partitioned sort, and
  are cut into blocks of ``BLOCK`` rows.  A conversation inside a block is settled
  there.  The others are products: each block gives the matrix of its piece;
  the pieces of a conversation are combined from the end to the costs behind
  each piece, then each piece gives the exit state for every entry state, and
  these are combined from the start.  So a conversation with a third of all rows is
  dealt over as many tasks as it has blocks.
* Choices are unrolled forwards, row by row, with the costs to the end known.
* The digest of the repaired rows is sequential by contract: rows and edits are dealt by
  conversation, sorted, and hashed as a stream in constant memory.

Rows of a conversation are taken by turn (nulls first), then role, the text's md5 and input order.
A row's first fault counts: blank, duplicate (role and text seen earlier), truncated.

Defined results: null roles and texts count as one space, as do null conv_ids and turns in the
damage key; rows with a null conv_id are one conversation.  Every conversation of the input gets a row, also if no
row is left.  Rows that repeat are rows; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridegrid.llm.common import stage

BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1  # costs
INF = 1 << 60
STATES = range(4)  # nothing, s, u, a
NEXT = (2, 2, 3, 2)  # the state after the next user or assistant turn
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
END = (0, 2 * INSERT, INSERT, 0)  # cheapest way to the end of the grammar
ROLE = {2: "user", 3: "assistant"}
MUST_GO = "-"
SPACES = " \t\n\x0b\x0c\r"

Vector = tuple[int, ...]


def symbol_of(initial: str, fault: int) -> str:
    """Rows with equal symbols have equal transitions.  Faults: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    if fault in (1, 2):
        return MUST_GO
    return (initial if initial in ("s", "u", "a") else "?") + ("!" if fault == 3 else "")


def _steps(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row (no inserts): (initial, cost, next state)."""
    out = [("D", DELETE, state)]
    if symbol != MUST_GO:
        extra = CUT_OFF if symbol.endswith("!") else 0
        to = KEPT[state].get(symbol[0])
        if to is not None:
            out.append(("K", KEEP + extra, to))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


def _inserted(v: list[int]) -> Vector:
    """Costs to the end when turns may be inserted first (more than two never help)."""
    return tuple(min(v[s], INSERT + v[NEXT[s]], 2 * INSERT + v[NEXT[NEXT[s]]]) for s in STATES)


class Transitions:
    """Min-plus matrices of the symbols and their binary powers, cached."""

    def __init__(self):
        self.steps: dict[str, list] = {}
        self.powers: dict[str, list[tuple[Vector, ...]]] = {}

    def row(self, symbol: str, after: Vector) -> Vector:
        """Costs before a row from the costs behind it."""
        steps = self.steps.get(symbol)
        if steps is None:
            steps = self.steps[symbol] = [_steps(symbol, s) for s in STATES]
        return _inserted([min(cost + after[to] for _, cost, to in steps[s]) for s in STATES])

    def power(self, symbol: str, k: int) -> tuple[Vector, ...]:
        """The matrix of 2**k rows."""
        known = self.powers.setdefault(symbol, [])
        if not known:
            columns = [self.row(symbol, tuple(0 if s == t else INF for s in STATES)) for t in STATES]
            known.append(tuple(tuple(min(columns[t][s], INF) for t in STATES) for s in STATES))
        while len(known) <= k:
            known.append(product(known[-1], known[-1]))
        return known[k]

    def run(self, symbol: str, length: int, after: Vector) -> Vector:
        """Costs before ``length`` equal rows."""
        k = 0
        while length:
            if length & 1:
                after = apply(self.power(symbol, k), after)
            length >>= 1
            k += 1
        return after


def product(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(min(a[s][m] + b[m][t] for m in STATES), INF) for t in STATES) for s in STATES)


def apply(matrix: tuple[Vector, ...], after: Vector) -> Vector:
    return tuple(min(matrix[s][t] + after[t] for t in STATES) for s in STATES)


def runs_of(symbols: list[str]) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def piece_matrix(table: Transitions, symbols: list[str]) -> tuple[Vector, ...]:
    """The transition of a piece of a conversation."""
    runs = runs_of(symbols)
    columns = []
    for t in STATES:
        v: Vector = tuple(0 if s == t else INF for s in STATES)
        for symbol, length in reversed(runs):
            v = tuple(min(x, INF) for x in table.run(symbol, length, v))
        columns.append(v)
    return tuple(tuple(columns[t][s] for t in STATES) for s in STATES)


def costs_before(table: Transitions, symbols: list[str], after: Vector) -> list[tuple[str, int, Vector]]:
    """For each run, in order: symbol, length and the costs behind the run."""
    out = []
    for symbol, length in reversed(runs_of(symbols)):
        out.append((symbol, length, after))
        after = table.run(symbol, length, after)
    return out[::-1]


def unroll(table: Transitions, symbols: list[str], state: int, after: Vector, last: bool) -> tuple[list[str], int, int]:
    """ASCII-least cheapest edits: (initials per row with inserts before them, exit state, cost).

    ``after``: costs behind the piece.  ``last``: the conversation ends here, so what is still missing
    is inserted behind the last row.
    """
    acts, spent = [], 0
    for symbol, length, behind in costs_before(table, symbols, after):
        costs = [behind]
        for _ in range(length):
            costs.append(table.row(symbol, costs[-1]))
        for i in range(length, 0, -1):
            act = ""
            while True:
                now, then = costs[i][state], costs[i - 1]
                choice = None
                for initial, cost, to in table.steps[symbol][state]:
                    if cost + then[to] == now:
                        choice = (initial, cost, to)
                        break
                if choice and choice[0] == "D":
                    break
                if INSERT + costs[i][NEXT[state]] == now:
                    act, spent, state = act + "I", spent + INSERT, NEXT[state]
                    continue
                break
            act, spent, state = act + choice[0], spent + choice[1], choice[2]
            acts.append(act)
    if last and acts:
        while END[state]:
            acts[-1] += "I"
            spent, state = spent + INSERT, NEXT[state]
    return acts, state, spent


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _pieces(pdf: pd.DataFrame, *columns: str) -> Iterator[tuple[str, list[list]]]:
    """(conversation, values of each column in order) of the pieces in one block."""
    pdf = pdf.sort_values("gid")
    values, at = [pdf[c].tolist() for c in columns], 0
    for ck, own in groupby(pdf["ck"].tolist()):
        end = at + sum(1 for _ in own)
        yield ck, [v[at:end] for v in values]
        at = end


_PIECE = ("ck string, block long, open boolean, matrix array<long>, entry int, leave int, cost long, acts array<string>, "
          "gids array<long>, illegal long, first string, last string, blank long, duplicate long, truncated long")


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per conversation in one block: the edits, or the piece's matrix if the conversation may go on in other blocks."""
    table, out = Transitions(), []
    pieces, block = list(_pieces(pdf, "initial", "fault", "gid")), int(pdf["block"].iloc[0])
    for i, (ck, (initials, faults, gids)) in enumerate(pieces):
        symbols = [symbol_of(a, b) for a, b in zip(initials, faults, strict=True)]
        row = {"ck": ck, "block": block, "open": i in (0, len(pieces) - 1), "matrix": None, "entry": 0,
               "leave": None, "cost": None, "acts": None, "gids": None, "illegal": _illegal(initials), "first": initials[0],
               "last": initials[-1], "blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3)}
        if row["open"]:
            row["matrix"] = [x for line in piece_matrix(table, symbols) for x in line]
        else:
            row["acts"], row["leave"], row["cost"] = unroll(table, symbols, 0, END, True)
            row["gids"] = gids
        out.append(row)
    return pd.DataFrame(out)


def _backwards(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs behind each open piece of one conversation."""
    pdf = pdf.sort_values("block", ascending=False)
    after, out, last = END, [], True
    for ck, block, matrix in zip(pdf["ck"], pdf["block"], pdf["matrix"], strict=True):
        out.append({"ck": ck, "block": block, "after": list(after), "last": last})
        m = [int(x) for x in matrix]
        after, last = apply(tuple(tuple(m[4 * s:4 * s + 4]) for s in STATES), after), False
    return pd.DataFrame(out)


def _try_entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edits of each open piece of a block for every entry state."""
    table, out, block = Transitions(), [], int(pdf["block"].iloc[0])
    for ck, (initials, faults, gids, afters, lasts) in _pieces(pdf, "initial", "fault", "gid", "after", "last"):
        symbols = [symbol_of(a, b) for a, b in zip(initials, faults, strict=True)]
        for entry in STATES:
            acts, leave, cost = unroll(table, symbols, entry, tuple(int(x) for x in afters[0]), bool(lasts[0]))
            out.append({"ck": ck, "block": block, "entry": entry, "leave": leave, "cost": cost, "acts": acts, "gids": gids})
    return pd.DataFrame(out)


def _forwards(pdf: pd.DataFrame) -> pd.DataFrame:
    """The entry state of each open piece of one conversation."""
    leaves: dict[int, dict[int, int]] = {}
    for block, entry, leave in zip(pdf["block"], pdf["entry"], pdf["leave"], strict=True):
        leaves.setdefault(int(block), {})[int(entry)] = int(leave)
    state, out = 0, []
    for block in sorted(leaves):
        out.append({"ck": pdf["ck"].iloc[0], "block": block, "entry": state})
        state = leaves[block][state]
    return pd.DataFrame(out)


def _key(conv: Column) -> Column:
    return F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv.cast("string")))


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text after the planned damage (by crc32 of ``conv_id:turn``, modulo 20)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    role, text = F.coalesce(F.col(role_col).cast("string"), space), F.coalesce(F.col(text_col).cast("string"), space)
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("harm")).where("harm != 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _symbols(rows: DataFrame) -> DataFrame:
    """Slim rows in their global order: ck, gid, block, turn, role, digest, rid, initial, fault."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    slim = rows.select(
        "ck", "turn", "role", "digest", "rid", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    order = ["ck", F.col("turn").asc_nulls_first(), "role", "digest", "rid"]
    slim = stage(slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "gid", F.monotonically_increasing_id()), "repair-order")
    again = slim.groupBy("ck", "role", "digest").agg(F.min("gid").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    fault = F.when(F.col("blank"), 1).when(F.col("first") < F.col("gid"), 2).when(F.col("truncated"), 3).otherwise(0)
    return slim.join(again.drop("many"), ["ck", "role", "digest"], "left").select(
        "ck", "gid", F.shiftright("gid", BLOCK.bit_length() - 1).alias("block"), "turn", "role", "digest", "rid", "initial",
        fault.alias("fault"))


def _edits(symbols: DataFrame) -> DataFrame:
    """Settled pieces (see ``_PIECE``) of all conversations."""
    # As many tasks as the session shuffles with: the rows are small, the work on them is not.
    tasks = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = symbols.select("ck", "gid", "block", "initial", "fault").repartition(tasks, "block")
    pieces = stage(cells.groupBy("block").applyInPandas(_settle, _PIECE), "repair-pieces")
    open_ = pieces.where("open")
    behind = open_.select("ck", "block", "matrix").groupBy("ck").applyInPandas(
        _backwards, "ck string, block long, after array<long>, last boolean")
    tried = stage(cells.join(behind, ["ck", "block"]).groupBy("block").applyInPandas(
        _try_entries, "ck string, block long, entry int, leave int, cost long, acts array<string>, gids array<long>"), "repair-tried")
    entered = tried.select("ck", "block", "entry", "leave").groupBy("ck").applyInPandas(_forwards, "ck string, block long, entry int")
    chosen = tried.join(entered, ["ck", "block", "entry"])
    kept = ["illegal", "first", "last", "blank", "duplicate", "truncated"]
    settled = chosen.join(open_.select("ck", "block", *kept), ["ck", "block"])
    columns = ["ck", "block", "cost", "acts", "gids", *kept]
    return stage(pieces.where("not open").select(*columns).unionByName(settled.select(*columns)), "repair-settled")


def _lines(batches: Iterator) -> Iterator:
    """Repaired rows, in order: (ck, role, text) lists per Arrow batch of edits and rows."""
    import pyarrow as pa

    ck, state, act, first = None, 0, "", True
    for batch in batches:
        keys, roles, texts, acts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ck", "role", "text", "act"))
        out: list[tuple[str, str, str]] = []
        for key, role, text, own in zip(keys, roles, texts, acts, strict=True):
            if first or key != ck:
                ck, state, first = key, 0, False
            if own is not None:  # the edit comes before its row
                act = own
                continue
            for x in act:
                if x == "D":
                    continue
                if x == "K":
                    state = KEPT[state][role[0]]
                    out.append((ck, role, text))
                    continue
                state = NEXT[state]
                out.append((ck, ROLE[state], "" if x == "I" else text))
        keys, roles, texts = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.string()) for x in (keys, roles, texts)], names=["ck", "role", "text"])


def _digests(batches: Iterator) -> Iterator:
    """One sha256 per conversation over its repaired rows, as a stream."""
    import pyarrow as pa

    ck, hashed = None, None
    for batch in _lines(batches):
        done = []
        for key, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if hashed is None or key != ck:
                if hashed is not None:
                    done.append((ck, hashed.hexdigest()))
                ck, hashed = key, hashlib.sha256()
            else:
                hashed.update(b"\n")
            hashed.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["ck", "repaired_sha256"])
    if hashed is not None:
        yield pa.RecordBatch.from_arrays([pa.array([ck]), pa.array([hashed.hexdigest()])], names=["ck", "repaired_sha256"])


def _plan(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, settled pieces, edits and rows of each conversation in order) of ``rows``: conv_id, turn, role, text."""
    rows = stage(rows.select(
        _key(F.col("conv_id")).alias("ck"), "turn", "role", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
        F.monotonically_increasing_id().alias("rid")), "repair-rows")
    symbols = stage(_symbols(rows), "repair-symbols")
    pieces = _edits(symbols)
    each = pieces.select(F.explode(F.arrays_zip("gids", "acts")).alias("x")).select(F.col("x.gids").alias("gid"), F.col("x.acts").alias("act"))
    order = ["ck", "turn", "role", "digest", "rid"]
    edits = symbols.join(each, "gid").select(*order, F.lit(None).cast("string").alias("text"), "act", F.lit(0).alias("kind"))
    lines = edits.unionByName(rows.select(*order, "text", F.lit(None).cast("string").alias("act"), F.lit(1).alias("kind")))
    lines = lines.repartition("ck").sortWithinPartitions("ck", F.col("turn").asc_nulls_first(), "role", "digest", "rid", "kind")
    return symbols, pieces, lines.select("ck", "role", "text", "act")


def repair_rows(rows: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, turn (from 0), role, text.  ``rows``: conv_id, turn, role, text (no null role or text)."""
    import pyarrow as pa

    kind = rows.schema["conv_id"].dataType
    *_, lines = _plan(rows)

    def run(batches: Iterator) -> Iterator:
        ck, turn = None, -1
        for batch in _lines(batches):
            turns = []
            for key in batch.column(0).to_pylist():
                turn = turn + 1 if key == ck else 0
                ck = key
                turns.append(turn)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turns, pa.int64())], names=["ck", "role", "text", "turn"])

    got = lines.mapInArrow(run, "ck string, role string, text string, turn long")
    conv = F.when(F.col("ck") == "", F.lit(None)).otherwise(F.expr("substr(ck, 2)")).cast(kind)
    return got.select(conv.alias("conv_id"), "turn", "role", "text")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", harmed: bool = False) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``harmed``: apply the planned damage first.
    """
    space = F.lit(" ")
    plain = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"))
    symbols, pieces, lines = _plan(damage(plain) if harmed else plain)
    digests = lines.mapInArrow(_digests, "ck string, repaired_sha256 string")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    joined = F.expr("array_sort(collect_list(struct(block, audit, first, last)))")  # one entry per BLOCK rows
    per = pieces.withColumn("audit", F.array_join("acts", "")).groupBy("ck").agg(
        *(F.sum(c).alias(c) for c in counts), joined.alias("p"))
    pairs = F.expr("transform(slice(p, 2, size(p) - 1), (x, i) -> concat(p[i].last, x.first))")
    borders = F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au")))
    per = per.select("ck", *counts[:3], (F.col("illegal") + borders).alias("illegal"), "cost",
                     F.array_join(F.col("p.audit"), "").alias("audit"))
    gaps = symbols.where(F.col("turn").isNotNull()).select("ck", "turn").distinct().groupBy("ck").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    ids = plain.groupBy(_key(F.col("conv_id")).alias("ck")).agg(F.first("conv_id").alias("conv_id"))
    zero = F.lit(0).cast("long")
    return ids.join(per, "ck", "left").join(gaps, "ck", "left").join(digests, "ck", "left").select(
        "conv_id", *(F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("gaps", *counts)),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
