"""Operator 7: token counts by overlap resynchronisation.

Documents longer than a chunk are cut into overlapping windows that are
encoded independently, as rows of their own, so one huge document spreads over
many tasks.  Each window is encoded with offsets.  Two neighbouring windows
are spliced at the first common boundary behind the nominal cut that is proven
stable: a place where white space ends.  The pre-tokenizer always parts there
and neither Unicode composition nor a special string reaches across white
space, so the tokens on either side do not depend on the other side.  Both
windows also report a checksum of the tokens (with offsets) that both of them
see behind the splice.  Where there is no such boundary in the overlap, or the
checksums differ, the alignment has failed: those documents are done again with
chunk and overlap both ``WIDEN`` times as large, at last as one window.  Shorter documents are one window.

Defined results: null text counts as empty (0 bytes, 0 tokens).  Rows that
repeat id and text are each returned.  Only the named columns are read.
"""

from __future__ import annotations

import os
import zlib
from functools import reduce

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.llm.bpe import _SPACE, VOCABULARY, Encoder, encoder, tokenizer_path
from ridegrid.llm.common import id_text, map_texts, stage

CHUNK = 1 << 15  # characters between nominal cuts
OVERLAP = 1 << 11  # characters seen on either side of a cut
WIDEN = 8
LIMIT = 2048

_RUN = regex.compile(f"[^{_SPACE}]+")
SCHEMA = "tokens long, left_sum long, right_sum long, failed boolean"


def stable(window: str, cut: int, end: int) -> list[int]:
    """Boundaries from ``cut`` up to ``end`` where white space ends, first and last of them (or none)."""
    ends = [m.start() for m in _RUN.finditer(window, max(0, cut - 1), end) if m.start() >= cut and m.start() > 0
            and not _RUN.match(window, m.start() - 1)]
    return [ends[0], ends[-1]] if ends else []


def count_window(enc: Encoder, window: str, left: int, right: int, overlap: int) -> tuple[int, int, int, bool]:
    """Tokens between the two splices; checksums of what neighbours share; whether a splice is missing.

    ``left`` and ``right`` are the nominal cuts inside the window; -1 stands
    for the document's own start or end.
    """
    if left < 0 and right < 0:
        return enc.count(window), 0, 0, False
    tokens = [(m.start(), enc.count(m[0]), m[0]) for m in _RUN.finditer(window)]
    sums, splice, failed = [0, 0], [0, len(window)], False
    for side, cut in enumerate((left, right)):
        if cut >= 0:
            found = stable(window, cut, min(len(window), cut + overlap))
            if found:
                splice[side] = found[0]
                shared = [(at - found[0], n, zlib.crc32(run.encode())) for at, n, run in tokens if found[0] <= at < found[1]]
                sums[side] = zlib.crc32(repr(shared).encode())
            else:
                failed = True
    return sum(n for at, n, _ in tokens if splice[0] <= at < splice[1]), sums[0], sums[1], failed


def _windows(slim: DataFrame, chunk: int, overlap: int) -> DataFrame:
    n = F.char_length("text")
    last = F.greatest(F.lit(0), F.floor((n - 1) / chunk)).cast("int")
    begin = F.greatest(F.lit(0), F.col("part") * chunk - overlap)
    many = F.col("last") > 0
    return (
        slim.withColumn("last", last).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .withColumn("left", F.when(F.col("part") > 0, F.col("part") * chunk - begin).otherwise(-1).cast("int"))
        .withColumn("right", F.when(F.col("part") < F.col("last"), (F.col("part") + 1) * chunk - begin).otherwise(-1).cast("int"))
        # One packed text column: the two cuts, then the window.
        .withColumn("text", F.concat_ws(
            " ", "left", "right", F.when(many, F.expr(f"substring(text, int({'greatest(0, part * %d - %d)' % (chunk, overlap)}) + 1, "
                                                    f"{chunk + 2 * overlap} - int(greatest(0, {overlap} - part * {chunk})))")).otherwise(F.col("text"))))
    )


def count_tokens(
    docs: DataFrame, tokenizer: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT,
    text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, n_windows, overlap (the one that aligned)."""
    key = ["doc_id", "digest", "n_bytes"]
    slim = id_text(docs, text_col, id_col).withColumn("digest", F.xxhash64("text")).withColumn(
        "n_bytes", F.octet_length("text").cast("long"))

    def counted(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
        def make():
            enc = encoder(tokenizer if os.path.isabs(tokenizer) else tokenizer_path(tokenizer))

            def run(texts: list) -> dict[str, list]:
                got = []
                for packed in texts:
                    left, right, window = packed.split(" ", 2)
                    got.append(count_window(enc, window, int(left), int(right), overlap))
                return dict(zip(("tokens", "left_sum", "right_sum", "failed"), map(list, zip(*got, strict=True)), strict=True))

            return run

        # Rows that repeat id and text have the same windows: their counts add up and are shared out again.
        found = map_texts(_windows(rows, chunk, overlap), make, SCHEMA, [*key, "part", "last"])
        # A window's right checksum must be its right neighbour's left one.  Two sums over the
        # document, plain and weighted by the cut's number, compare all of its cuts at once.
        return found.groupBy(*key).agg(
            F.sum(F.when(F.col("part") == 0, 1).otherwise(0)).alias("copies"), F.sum("tokens").alias("tokens"),
            F.max("last").alias("last"),
            (F.max("failed") | (F.sum("left_sum") != F.sum("right_sum"))
             | (F.sum(F.col("left_sum") * F.col("part")) != F.sum(F.col("right_sum") * (F.col("part") + 1)))).alias("failed"),
        ).withColumn("overlap", F.lit(overlap))

    done = []
    rows = slim
    while True:
        result = stage(counted(rows, chunk, overlap), "token-counts")
        done.append(result.where(~F.col("failed")))
        failed = result.where("failed")
        if failed.isEmpty():
            break
        rows = slim.join(failed.select(*[F.col(k).alias(f"f_{k}") for k in key]),
                         [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in key], "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
    whole = reduce(DataFrame.union, done)
    n = (F.col("tokens") / F.col("copies")).cast("long")
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"),
        (F.col("last") + 1).alias("n_windows"), "overlap")
