"""Operator 3: near-duplicate groups by Order MinHash and banded alignment.

Texts become word sequences (A-Z lower-cased, everything below code point 128
that is no letter or digit parts words).  Two sequences are near duplicates
when their word edit distance is at most ``1 - SIMILARITY`` of the longer one.

* *Copies* of a sequence are folded into one class first, with map-side
  combining, so thousands of copies cost one entry.
* *Order MinHash*: the k-mers (``K`` words) of a sequence are labelled with
  their occurrence number; for each of ``SKETCHES`` hash functions the
  ``TUPLE`` least of them, taken in text order, are one bucket key.  Collisions
  follow the edit similarity: they need the same k-mers in the same order.  Sequences of at most
  ``SHORT`` words have all their k-mers as keys.
* *Verification* goes star by star: in each bucket all members are
  aligned with one centre, the least id, and links are joined to groups.  A member that is
  in another group than the centre has no link to a member linked to the centre if it is further from the
  centre than the star's radius plus the limit (triangle inequality).  The few for which this
  cannot be ruled out are compared with the centre's whole group, in blocks.  The members not linked to the
  centre, in its group or not, still have to be compared with each other: buckets of at most ``SMALL`` of them are finished in
  one group, all pairs, without writing a pair list.
* What follows the stars reads the texts of members of unsettled buckets and of their groups only; these are put aside once.
* *Larger buckets* are compared all pairs, in pairs of blocks of ``COUNTS`` members that hold only word counts by
  ``CLASSES`` hash classes.  These bound the distance from below; pairs that the bound does not rule out are aligned on whole texts.
* Buckets of more than ``HOT`` are hot passages: many texts that share some text and little else.  Their members get
  second keys: the rarest ones of their word pairs (with occurrence numbers).  At a distance of d words, all but 2d of the longer
  text's word pairs are shared, so whatever order the word pairs are taken in, near duplicates share one of the first
  ``2 * limit + 2`` of both; in the order of frequency a common passage is not among them.  The order comes from counts of
  ``CLASSES`` hash classes of words over all these texts.  Keys that only one text has are left out by a Bloom filter of
  fixed size before anything is dealt by key.  Buckets of the second keys are treated like those of the first.
* What is left of a large bucket of second keys is compared all pairs in blocks, however large; that work grows with the
  square of such a bucket.
* The alignment is a bit-parallel edit distance inside a diagonal band;
  the band doubles until it holds the distance or exceeds the limit.
* Links are joined to groups by label propagation with pointer jumping.

Recall: cut into limit + 1 pieces, the longer of two near duplicates keeps one piece unchanged.
Up to ``SHORT`` words that piece has ``K`` words (2 of 5), so with all k-mers as keys every pair is found.
Above, recall is that of the sketches: a pair whose shared part of k-mers is J
collides in one of ``SKETCHES`` keys with probability 1-(1-J^TUPLE)^SKETCHES, whatever the size of the
bucket.  A distance of 0.2 leaves J = 0.34 if the changed words are scattered at random (0.99) and
0.25 if every fifth word is changed (0.95).  Precision is exact: every link is verified on whole texts.

Defined results: null, empty and wordless texts are each a group of their own.
The group's id is its least doc_id (null below all); of a group, the row with the
least doc_id stays; of rows that repeat it, one.  An empty table gives an
empty result.  Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridegrid.llm.common import ascii_lower, fresh, map_texts, stage

K = 3
TUPLE = 2
SKETCHES = 48
SIMILARITY = 0.8
SHORT = 50  # words; near duplicates of up to so many share K words in a row (2 where the longer one has 5)
SMALL = 96
BLOCK = 96  # texts
COUNTS = 1024  # word counts
COARSE = 256  # classes of a first look at word counts
CLASSES = 4096  # of words, for the order of rarity and for word counts
HOT = COUNTS  # a bucket of more members than one block holds gets second keys
CHUNK = 1 << 20  # second keys compared at a time
BLOOM = 1 << 22  # bits

_MIX = np.uint64(0x9E3779B97F4A7C15)


def limit_of(longer: int) -> int:
    """Largest distance of near duplicates when the longer one has so many words."""
    return int((1 - SIMILARITY) * longer + 1e-9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k codes (of the whole sequence if it is shorter)."""
    n = max(1, len(codes) - k + 1)
    grams = np.zeros(n, np.uint64)
    for i in range(min(k, len(codes))):
        grams = grams * _MIX + codes[i:i + n] + np.uint64(1)
    return grams


def bucket_keys(words: list[bytes]) -> np.ndarray:
    """All keys of a word sequence: sketches, and below ``SHORT`` words its k-mers."""
    n, keys = len(words), []
    if n > SIMILARITY * SHORT:  # may have a near duplicate of more than SHORT words
        keys.append(order_minhash(words))
    if n <= SHORT:
        codes = np.fromiter(map(zlib.crc32, words), np.uint64, n)
        for k in (2, K) if n <= 5 else (K,):
            keys.append(_mix(_grams(codes, k) + np.uint64(k)).view(np.int64))
    return np.unique(np.concatenate(keys))


def order_minhash(words: list[bytes], sketches: int = SKETCHES, size: int = TUPLE, k: int = K) -> np.ndarray:
    """The bucket keys of a word sequence."""
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    grams = _grams(codes, k)
    n = len(grams)
    order = np.argsort(grams, kind="stable")
    runs = grams[order]
    again = np.zeros(n, np.uint64)
    if n > 1 and (runs[1:] == runs[:-1]).any():  # occurrence numbers, in text order
        new = np.concatenate([[True], runs[1:] != runs[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        again[order] = (np.arange(n) - first).astype(np.uint64)
    grams = _mix(grams + again * np.uint64(0xD1B54A32D192ED03))
    seeds = _mix(np.arange(1, sketches + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
    take = min(size, n)
    keys = np.empty(sketches, np.uint64)
    step = max(1, 500_000 // n)  # hash functions at a time
    for at in range(0, sketches, step):
        some = seeds[at:at + step]
        hashed = grams[None, :] * some[:, None]
        hashed ^= hashed >> np.uint64(32)
        least = np.argpartition(hashed, take - 1, axis=1)[:, :take] if n > take else np.tile(np.arange(n), (len(some), 1))
        least.sort(axis=1)  # text order
        key = some.copy()
        for c in range(take):
            key = _mix(key * _MIX + grams[least[:, c]])
        keys[at:at + step] = key
    return keys.view(np.int64)


def banded(a: list, b: list, band: int) -> int:
    """Edit distance of two sequences if it is at most ``band``, else ``band + 1``.

    Bit k of a column's window stands for the row ``column - band + k``.
    """
    m, n = len(a), len(b)
    if abs(m - n) > band:
        return band + 1
    peq: dict = {}
    for i, w in enumerate(a):
        peq[w] = peq.get(w, 0) | 1 << i
    peq = {w: bits << band for w, bits in peq.items()}
    width = 2 * band + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    vp = ((1 << band) - 1) << (band + 1)  # rows 1..band of column 0
    vn, dist = 0, min(m, band)
    most = 2 * band + n - m  # along the last row each column can take off one
    get = peq.get
    for j in range(1, n + 1):
        x = (get(b[j - 1], 0) >> (j - 1)) & mask
        vp, vn = vp >> 1 | top, vn >> 1
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp = vn | (mask & ~(d0 | vp))
        hn = vp & d0
        if j <= m - band:
            dist += not d0 & top
            if dist > most:  # the columns that are left cannot bring it back
                return band + 1
        else:
            at = m - j + band
            dist += (hp >> at & 1) - (hn >> at & 1)
        shifted = (hp << 1 | 1) & mask
        vp = (hn << 1 & mask) | (mask & ~(d0 | shifted))
        vn = shifted & d0
    return dist if dist <= band else band + 1


def _trimmed(a: list, b: list) -> tuple[list, list]:
    """Without the words that both begin or end with; the distance stays the same."""
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        start += 1
    while min(end_a, end_b) > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    return a[start:end_a], b[start:end_b]


def align(a: list, b: list, limit: int) -> tuple[bool, int]:
    """(within the limit, the distance; or a lower bound of it that exceeds the limit)."""
    low = abs(len(a) - len(b))
    if low <= limit:
        bag_a, bag_b = Counter(a), Counter(b)
        low = max((bag_a - bag_b).total(), (bag_b - bag_a).total())
    if low > limit:
        return False, low
    a, b = _trimmed(a, b)
    band = max(8, low)
    while True:
        band = min(band, limit)
        found = banded(a, b, band)
        if found <= band or band == limit:
            return found <= limit, found
        band *= 2


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _sketch():
    def run(texts: list) -> dict[str, list]:
        words = [t.encode().split(b" ") for t in texts]
        return {"n": list(map(len, words)), "keys": [bucket_keys(w) for w in words]}

    return run


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Align (id, centre) pairs: adds linked and dist (a lower bound where not linked)."""
    one = texts.select(F.col("id"), F.col("norm").alias("a"))
    two = texts.select(F.col("id").alias("centre"), F.col("norm").alias("b"))
    # The members' texts come last: dealt by member, a hot centre's pairs are aligned in many tasks.
    joined = pairs.join(two, "centre").join(one, "id").select("id", "centre", F.array("a", "b").alias("text"))

    def make():
        def run(both: list) -> dict[str, list]:
            out = []
            for a, b in both:
                x, y = a.split(" "), b.split(" ")
                out.append(align(x, y, limit_of(max(len(x), len(y)))))
            return {"linked": [x[0] for x in out], "dist": [x[1] for x in out]}

        return run

    return _map_pairs(joined, make)


def _map_pairs(joined: DataFrame, make) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = fn(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(got["linked"], pa.bool_()), pa.array(got["dist"], pa.int32())],
                    names=["id", "centre", "linked", "dist"])

    return joined.mapInArrow(run, "id long, centre long, linked boolean, dist int")


def _counts(words: list[str]) -> bytes:
    """How many words fall into each hash class: the classes that occur (16 bits each), then their counts (32 bits each)."""
    codes = np.fromiter((zlib.crc32(x.encode()) % CLASSES for x in words), np.uint16, len(words))
    classes, many = np.unique(codes, return_counts=True)
    return classes.tobytes() + many.astype(np.int32).tobytes()


class _Bags:
    """Word counts of the texts of one task, for bounding their distances from below."""

    def __init__(self, sizes: np.ndarray, counts: list[bytes]):
        self.sizes, self.fine, self.coarse = sizes, [], np.zeros((len(counts), COARSE), np.int32)
        for i, x in enumerate(counts):
            own = len(x) // 6
            self.fine.append((np.frombuffer(x, np.uint16, own), np.frombuffer(x, np.int32, own, 2 * own)))
            self.coarse[i] = np.bincount(self.fine[i][0] % COARSE, self.fine[i][1], COARSE)

    def near(self, j: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those ``others`` that may be within the limit of text j, their limits and least distances."""
        longer = np.maximum(self.sizes[others], self.sizes[j])
        limits = ((1 - SIMILARITY) * longer + 1e-9).astype(int)
        may = longer - np.minimum(self.coarse[others], self.coarse[j]).sum(1) <= limits
        others, longer, limits = others[may], longer[may], limits[may]
        own = np.zeros(CLASSES, np.int32)
        own[self.fine[j][0]] = self.fine[j][1]
        shared = np.array([np.minimum(own[classes], many).sum() for classes, many in (self.fine[i] for i in others.tolist())], np.int64)
        may = longer - shared <= limits
        return others[may], limits[may], (longer - shared)[may]


class _Texts:
    """Texts of one task, ready for alignment."""

    def __init__(self, norms: list[str]):
        self.words = [t.split(" ") for t in norms]
        self.bags = _Bags(np.array([len(w) for w in self.words]), [_counts(w) for w in self.words])

    def near(self, j: int, others: np.ndarray) -> list[tuple[int, int]]:
        """(i, limit) of those ``others`` that may be close to text j, the likeliest first."""
        others, limits, low = self.bags.near(j, others)
        order = np.argsort(low, kind="stable")
        return list(zip(others[order].tolist(), limits[order].tolist(), strict=True))

    def linked(self, i: int, j: int, limit: int) -> bool:
        a, b = _trimmed(self.words[i], self.words[j])
        return banded(a, b, min(8, limit)) <= min(8, limit) or banded(a, b, limit) <= limit


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """All links of one small bucket.

    Pairs already in one group are not aligned again, and a pair that meets in several
    buckets is aligned in the least of them only.
    """
    pdf = pdf.sort_values("id")
    bucket, ids, texts = pdf["bucket"].iloc[0], pdf["id"].tolist(), _Texts(pdf["norm"].tolist())
    own = [set(x) for x in pdf["buckets"]]
    first: dict[int, int] = {}
    group = [first.setdefault(label, i) for i, label in enumerate(pdf["label"].tolist())]

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    out = []
    for j in range(1, len(ids)):
        for i, limit in texts.near(j, np.arange(j)):
            if root(i) != root(j) and min(own[i] & own[j]) == bucket and texts.linked(i, j, limit):
                out.append((ids[j], ids[i]))
                group[root(j)] = root(i)
    return pd.DataFrame(out, columns=["id", "centre"]).astype("int64")


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """One link of each asking text (if any) into a block of a group's members."""
    ids, texts, asks = pdf["id"].tolist(), _Texts(pdf["norm"].tolist()), pdf["asks"].to_numpy()
    members = np.flatnonzero(~asks)
    out = []
    for j in np.flatnonzero(asks).tolist():
        for i, limit in texts.near(j, members):
            if texts.linked(i, j, limit):
                out.append((ids[j], ids[i]))
                break
    return pd.DataFrame(out, columns=["id", "centre"]).astype("int64")


def _against_groups(asking: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of ``asking`` (part, id) into the parts of ``members`` (part, id): a query set against all members, in blocks."""
    sizes = members.join(asking.select("part").distinct(), "part", "left_semi").groupBy("part").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("m_blocks"))
    sizes = sizes.join(asking.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("a_blocks")), "part")
    sizes = stage(sizes, "near-blocks")

    def dealt(rows: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        return rows.select("part", "id").join(sizes, "part").select(
            "part", "id", F.lit(asks).alias("asks"), F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other)).select("part", "m", "a", "id", "asks")

    rows = dealt(members, "m", "a", False).unionByName(dealt(asking, "a", "m", True))
    return rows.join(texts, "id").groupBy("part", "m", "a").applyInPandas(_compare, "id long, centre long")


def _by_text(members: DataFrame) -> DataFrame:
    """One row per text of ``members`` (bucket, id, n, label) with its ``buckets`` (bounded by the keys of a text), to join once."""
    return members.groupBy("id").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.collect_set("bucket").alias("buckets"))


def _bounded(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of two blocks of a bucket (or of one) that may be within the limit and are not in one group.

    A pair that meets in several buckets comes from the least of them only.
    """
    bucket, one, two = pdf["bucket"].iloc[0], pdf["one"].iloc[0], pdf["two"].iloc[0]
    own = [set(x) for x in pdf["buckets"]]
    ids, labels, sizes, block = (pdf[c].to_numpy() for c in ("id", "label", "n", "block"))
    bags, others = _Bags(sizes, pdf["counts"].tolist()), np.flatnonzero(block == two)
    out = [np.zeros((0, 2), np.int64)]
    for j in np.flatnonzero(block == one).tolist():
        wanted = others[labels[others] != labels[j]]
        near = bags.near(j, wanted[ids[wanted] < ids[j]] if one == two else wanted)[0]
        found = ids[[i for i in near.tolist() if min(own[i] & own[j]) == bucket]]
        out.append(np.stack([np.maximum(found, ids[j]), np.minimum(found, ids[j])], 1))
    return pd.DataFrame(np.concatenate(out), columns=["id", "centre"])


def _all_pairs(members: DataFrame, texts: DataFrame, counts: int = COUNTS) -> DataFrame:
    """Links (id, centre) between the groups among ``members`` (bucket, id, n, label) of each bucket, however large."""
    def make():
        return lambda norms: {"counts": [_counts(t.split(" ")) for t in norms]}

    wanted = texts.join(members.select("id").distinct(), "id", "left_semi")
    counted = stage(map_texts(wanted, make, "counts binary", ["id"], text_col="norm"), "near-counts")
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / counts).cast("int").alias("blocks"))
    dealt = _by_text(members).join(counted, "id").withColumn("bucket", F.explode("buckets")).join(sizes, "bucket")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("bucket", "id", "n", "label", "buckets", "counts", "block",
                        F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    near = rows.groupBy("bucket", "one", "two").applyInPandas(_bounded, "id long, centre long")
    pairs = stage(near.distinct(), "near-pairs")
    return stage(_verify(pairs, texts).where("linked").select("id", "centre"), "near-large")


def _star_round(entries: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Align all members of each bucket with its centre: (links, judged members); None if no bucket has two."""
    sizes = entries.groupBy("bucket").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("members"))
    sizes = stage(sizes.where(F.col("members") > 1), "near-stars")
    if sizes.isEmpty():
        return None
    centre_n = entries.select("bucket", F.col("id").alias("centre"), F.col("n").alias("centre_n"))
    stars = sizes.join(centre_n, ["bucket", "centre"])
    members = stage(entries.join(stars, "bucket").where(F.col("id") != F.col("centre")), "near-members")
    longer = F.greatest("n", "centre_n")
    apart = F.abs(F.col("n") - F.col("centre_n"))
    close = apart <= (1 - SIMILARITY) * longer + 1e-9
    pairs = members.where(close).select("id", "centre").distinct()
    checked = stage(_verify(pairs, texts), "near-checked")
    judged = members.join(checked, ["id", "centre"], "left").select(
        "bucket", "id", "centre", "n", F.coalesce("linked", F.lit(False)).alias("linked"),
        F.coalesce("dist", apart).alias("dist"), longer.alias("longer"))
    return checked.where("linked").select("id", "centre"), judged


def _outside(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """Members that are not linked to their bucket's centre, with their own and the centre's label.

    Those that are in the centre's group through other texts only stay too: their distance
    to the centre has no known upper bound.
    ``doubt``: the member is in another group than the centre, and the triangle inequality cannot
    rule out a link to a member of the star: the distance to the centre is within the star's
    radius plus the limit (which grows with the radius by at most a fifth of it).
    """
    own = labels.select("id", F.col("label").alias("l"))
    its = labels.select(F.col("id").alias("centre"), F.col("label").alias("c"))
    label, star = F.coalesce("l", "id"), F.coalesce("c", "centre")
    radius = judged.groupBy("bucket").agg(F.max(F.when(F.col("linked"), F.col("dist"))).alias("radius"))
    out = judged.join(own, "id", "left").join(its, "centre", "left").where(~F.col("linked")).join(radius, "bucket")
    reach = F.col("radius") + (1 - SIMILARITY) * (F.col("longer") + F.col("radius")) + 1
    return out.select("bucket", "id", "n", label.alias("label"), star.alias("star"),
                      F.coalesce((label != star) & (F.col("dist") <= reach), F.lit(False)).alias("doubt"))


def _late_texts(texts: DataFrame, rows: DataFrame, asking: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the members of unsettled buckets, of what asks, and of whole groups that have such members or are asked.

    All later steps read these only, those on second keys too: the members that get second keys are among ``rows``, so a group
    that grows or is asked there has one of them.  Dealing all texts by id for each step would move them many times.
    """
    parts = rows.select("label").union(asking.select(F.col("part").alias("label"))).distinct()
    ids = labels.join(parts, "label", "left_semi").select("id").union(rows.select("id")).union(asking.select("id")).distinct()
    return stage(texts.join(ids, "id", "left_semi"), "near-late")


def links(texts: DataFrame, entries: DataFrame, small: int = SMALL, hot: int = HOT, known: DataFrame | None = None) -> DataFrame:
    """Verified links (id, centre) among the members of every bucket.

    ``texts``: id, norm.  ``entries``: bucket, id, n (words).  ``known``: links found
    before; then the buckets are those of second keys.
    """
    star = _star_round(entries, texts)
    if star is None:
        return _no_links(texts)
    labels = components(star[0] if known is None else star[0].union(known))
    found = [labels.select("id", F.col("label").alias("centre"))]  # the groups so far, as one link per member
    left = stage(_outside(star[1], labels), "near-outside")
    asking = stage(left.where("doubt").select(F.col("star").alias("part"), "id").distinct(), "near-asking")
    # Buckets whose members are all in one group are settled.
    sized = left.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).where(
        F.col("low") != F.col("high")).select("bucket", "members")
    rows = stage(left.join(sized, "bucket").select("bucket", "id", "n", "label", "members"), "near-rest")
    if known is None:
        texts = _late_texts(texts, rows, asking, labels)
    if not asking.isEmpty():
        found.append(stage(_against_groups(asking, labels.select("id", F.col("label").alias("part")), texts), "near-asked"))
    few = rows.where(F.col("members") <= small)
    together = _by_text(few).join(texts, "id").withColumn("bucket", F.explode("buckets"))
    found.append(together.groupBy("bucket").applyInPandas(_finish, "id long, centre long"))  # at most ``small`` members each
    large, hottest = rows.where(F.col("members") > small), F.col("members") > hot
    if known is None:
        spread = large.where(hottest)
        if not spread.isEmpty():
            found.append(links(texts, _second_keys(spread, texts), small, hot, found[0]))
        large = large.where(~hottest)
    if not large.isEmpty():
        found.append(_all_pairs(large, texts))
    return reduce(DataFrame.union, found)


def _word_grams(norm: str, k: int) -> np.ndarray:
    """One hash per k words in a row, labelled with its occurrence number."""
    words = norm.encode().split(b" ")
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    grams = _mix(_grams(codes, k) + np.uint64(k))
    order = np.argsort(grams, kind="stable")
    runs = grams[order]
    new = np.concatenate([[True], runs[1:] != runs[:-1]])
    number = np.arange(len(grams))
    again = np.zeros(len(grams), np.uint64)
    again[order] = (number - np.maximum.accumulate(np.where(new, number, 0))).astype(np.uint64)
    return _mix(grams + again * _MIX)


def _word_classes(norm: str) -> np.ndarray:
    """A hash class for each word."""
    words = norm.encode().split(b" ")
    return (np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) % np.uint64(CLASSES)).astype(np.int64)


def _class_counts(texts: DataFrame) -> np.ndarray:
    """How many texts' words fall into each of ``CLASSES`` hash classes, over all texts."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for norm in batch.column(0).to_pylist():
                total += np.bincount(_word_classes(norm), minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total)], names=["slot", "many"])

    counts = texts.select("norm").mapInArrow(run, "slot long, many long").groupBy("slot").agg(F.sum("many").alias("many")).collect()
    out = np.zeros(CLASSES, np.int64)  # CLASSES rows came to the driver
    for r in counts:
        out[r.slot] = r.many
    return out


def rare_keys(norm: str, counts: np.ndarray) -> np.ndarray:
    """Second keys of a text: its rarest word pairs, as many as near duplicates must share one of."""
    pairs, own = _word_grams(norm, 2), counts[_word_classes(norm)]
    often = np.minimum(own[:-1], own[1:])  # a word pair is as rare as its rarer word
    return np.unique(pairs[np.lexsort((pairs, often))[:2 * limit_of(len(own)) + 2]])


def _shared_filter(texts: DataFrame, counts) -> np.ndarray:
    """A Bloom filter of the second keys that at least two texts have, ``BLOOM`` bits whatever the input's size.

    Each task sends its keys, at most twice each, packed by hash chunk; a chunk's task finds the
    repeated ones.  Chunks hold about ``CHUNK`` keys.
    """
    import pyarrow as pa

    words = texts.agg(F.sum(F.length("norm")).alias("n")).first()["n"] or 0
    chunks = 1 + words // (10 * CHUNK)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            keys, many = np.unique(np.concatenate(held), return_counts=True)
            keys = np.repeat(keys, np.minimum(many, 2))
            own = (keys % np.uint64(chunks)).astype(np.int64)
            by = np.argsort(own, kind="stable")
            edges = np.searchsorted(own[by], np.arange(chunks + 1))
            some = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays([
                pa.array(some), pa.array([keys[by][edges[c]:edges[c + 1]].tobytes() for c in some], pa.binary())], names=["chunk", "keys"])

        for batch in batches:
            for norm in batch.column(0).to_pylist():
                held.append(rare_keys(norm, counts.value))
                if len(held) >= 4096:
                    yield from out()
                    held.clear()
        if held:
            yield from out()

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, many = np.unique(np.frombuffer(b"".join(pdf["keys"]), np.uint64), return_counts=True)
        bits = np.unique(_bloom_bits(keys[many > 1]))
        slots, first = np.unique(bits // 32, return_index=True)
        masks = np.bitwise_or.reduceat(np.int64(1) << (bits % 32), first) if len(bits) else bits
        return pd.DataFrame({"slot": slots, "mask": masks}).astype("int64")

    packed = texts.select("norm").mapInArrow(pack, "chunk long, keys binary").groupBy("chunk").applyInPandas(repeated, "slot long, mask long")
    out = np.zeros(BLOOM // 32, np.int64)
    for row in packed.groupBy("slot").agg(F.bit_or("mask").alias("mask")).collect():  # at most BLOOM / 32 rows
        out[row.slot] = row.mask
    return out


def _bloom_bits(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([_mix(keys + np.uint64(i) * _MIX) % np.uint64(BLOOM) for i in range(2)]).astype(np.int64)


def _second_keys(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Buckets (bucket, id, n) of the rarest word pairs of the ``members``' texts."""
    wanted = stage(texts.join(members.select("id").distinct(), "id", "left_semi"), "near-hot")
    sc = wanted.sparkSession.sparkContext
    counts = sc.broadcast(_class_counts(wanted))
    bloom = sc.broadcast(_shared_filter(wanted, counts))

    def make():
        def one(norm: str) -> np.ndarray:
            keys = rare_keys(norm, counts.value)
            bits = _bloom_bits(keys)
            there = bloom.value[bits // 32] >> (bits % 32) & 1
            return keys[there.reshape(2, -1).all(0)].view(np.int64)  # the others no other text has

        def run(norms: list) -> dict[str, list]:
            return {"n": [t.count(" ") + 1 for t in norms], "keys": [one(t) for t in norms]}

        return run

    keyed = stage(map_texts(wanted, make, "n int, keys array<long>", ["id"], text_col="norm"), "near-rare")
    return _shared(keyed)


def _shared(keyed: DataFrame) -> DataFrame:
    """Buckets (bucket, id, n) of at least two texts."""
    entries = keyed.select(F.explode("keys").alias("bucket"), "id", "n")
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("bucket")
    return stage(entries.join(shared, "bucket"), "near-entries")


def _no_links(texts: DataFrame) -> DataFrame:
    return texts.select("id", F.col("id").alias("centre")).where(F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id of each connected component, for all ids that have a link."""
    # First every id links itself and its centres to the least of them: many links between a
    # group's members become one per member.  An id has at most one centre per bucket or group asked.
    seen = edges.groupBy("id").agg(F.collect_set("centre").alias("centres"))
    least = F.least(F.col("id"), F.array_min("centres"))
    few = seen.select(F.explode(F.array_union("centres", F.array("id"))).alias("id"), least.alias("to")).where(F.col("id") != F.col("to"))
    both = stage(few.union(few.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct(), "near-edges")
    labels = stage(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("label").alias("other")), "to")
        low = near.groupBy("id").agg(F.min("other").alias("low"))
        moved = labels.join(low, "id").select("id", "label", F.least("label", "low").alias("at"))
        ahead = labels.select(F.col("id").alias("at"), F.col("label").alias("further"))
        step = stage(
            moved.join(ahead, "at").select("id", F.least("at", "further").alias("label"), F.col("label").alias("was")),
            "near-labels")
        if step.where(F.col("label") != F.col("was")).isEmpty():
            return step.select("id", "label")
        labels = step.select("id", "label")


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", small: int = SMALL, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept."""
    return _grouped(docs, text_col, id_col, small, hot).select("doc_id", "class_id", "class_size", "kept")


def _grouped(docs: DataFrame, text_col: str, id_col: str, small: int, hot: int = HOT) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = docs.select(F.col(id_col).alias("doc_id"), _norm(text).alias("norm"))
    digest = F.unhex(F.md5(F.col("norm").cast("binary")))
    normal = stage(norm.select("doc_id", digest.alias("digest"), "norm", F.monotonically_increasing_id().alias("rid")), "near-rows")
    rows = normal.select("doc_id", "digest", "rid")
    texts = stage(
        normal.where(F.col("norm") != "").select("digest", "norm").distinct()
        .withColumn("id", F.monotonically_increasing_id()), "near-texts")
    sketched = stage(
        map_texts(texts.select("id", "norm"), _sketch, "n int, keys array<long>", ["id"], text_col="norm"), "near-sketches")
    entries = _shared(sketched)
    involved = stage(
        texts.select("id", "norm").join(entries.select("id").distinct(), "id", "left_semi"), "near-involved")
    labels = components(links(involved, entries, small, hot))
    names = texts.select("digest", "id").join(labels, "id", "left").select(
        "digest", F.coalesce("label", "id").alias("label"))
    placed = stage(rows.join(names, "digest", "left").select(
        "doc_id", "rid", F.coalesce("label", -1 - F.col("rid")).alias("label")), "near-placed")  # wordless: on its own
    groups = stage(placed.groupBy("label").agg(
        F.min(F.struct("doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("class_size")), "near-groups")
    return placed.join(groups, "label").select(
        "doc_id", "rid", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("first.rid")).alias("kept"))


def drop_near(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", small: int = SMALL) -> DataFrame:
    """One row of each near-duplicate group (the least id), all columns."""
    rid = fresh(docs, "row_number")
    staged = stage(docs.withColumn(rid, F.monotonically_increasing_id()), "near-docs")
    slim = staged.select(F.struct(F.col(id_col).alias("id"), F.col(rid).alias("rid")).alias("row"), F.col(text_col).alias("text"))
    losers = _grouped(slim, "text", "row", small).where(~F.col("kept")).select(F.col("doc_id.rid").alias(rid))
    return staged.join(losers, rid, "left_anti").drop(rid)
