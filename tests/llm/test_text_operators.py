"""Text operators against brute force, and the cases every operator defines.

The odd table has nulls in every column, empty, blank and very long texts,
repeated rows, ties, and columns named like the operators' own.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridegrid.llm import (
    bpe,
    chat_format,
    decontaminate,
    exact_dedup,
    hilbert_shards,
    language_id,
    near_dedup,
    pii,
    quality,
    token_counts,
)
from ridegrid.llm.common import LOWER, UPPER, prepare, table
from ridegrid.llm.registry import oracle_sql, queries
from ridegrid.llm.templates import Template, TemplateError, fold, parse

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(UPPER, LOWER)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, rid long, norm string, digest long, kept string, "
    "row_number string, id long, bucket string, score string, f string, shard string, n_tokens string"
)


def odd_rows():
    long = "Wört the cat, number 42! " * 4000
    texts = [
        (1, "The Cat sat"), (2, "the cat SAT"), (2, "the cat SAT"), (3, None), (4, ""), (None, "the cat sat"), (None, None),
        (5, " \n\t "), (6, "..."), (7, long), (8, long.upper()), (9, "x" * 9000), (10, "é" * 300), (11, "😀 ünïcode 中文"),
        (12, "<|endoftext|> a@b.co +1 (555) 010-9999 4111 1111 1111 1111 10.0.0.256 10.0.0.255"), (13, None), (13, "dup id"),
        (14, "one two three four five six seven eight nine ten eleven"),
    ]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, k, "n", 7, "k", "r", 1, "b", "s", "f", "h", "t")
            for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


# -- 1 exact dedup -----------------------------------------------------------


def check_exact(rows, found):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(found) == len(rows)
    kept = defaultdict(int)
    for r in found:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) <= {1} and len(kept) == len(by_sha)


def test_exact_dedup(docs, texts, odd, none):
    check_exact(list(texts.items()), exact_dedup.exact_groups(docs).collect())
    rows = [(r[0], r[1]) for r in odd_rows()]
    check_exact(rows, exact_dedup.exact_groups(odd).collect())
    assert exact_dedup.exact_groups(none).count() == 0
    left = exact_dedup.drop_exact(odd)
    assert left.columns == odd.columns
    assert left.count() == len({(t or "").translate(FOLD) for _, t in rows})


def test_exact_dedup_chains_and_splits(docs, texts):
    """Keys of few bits collide: chains hold several texts, overfull buckets split."""
    found = exact_dedup.exact_groups(docs, capacity=8, max_depth=6, key_bits=5).collect()
    check_exact(list(texts.items()), found)
    assert max(r.chain_slot for r in found) > 1
    assert len({r.bucket for r in found}) > 3


def test_directory_covers_every_key_once(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    leaves = exact_dedup.directory(keys, capacity=300, max_depth=8).collect()
    assert sum(r.keys for r in leaves) == 5000
    assert all(r.keys <= 300 for r in leaves)
    assert sum(2.0 ** -r.depth for r in leaves) == 1.0


# -- 2 chat formatting -------------------------------------------------------


def check_chat(rows, found):
    talks = defaultdict(list)
    for c, t, role, text in rows:
        talks[c].append((t is not None, t or 0, role or "", text or ""))
    assert {r.conv_id for r in found} == set(talks) and len(found) == len(talks)
    for r in found:
        turns = [(role, text) for *_, role, text in sorted(talks[r.conv_id])]
        said = "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_format(spark):
    prepare(spark)
    rows = table(spark, SF, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionByName(chat_format.probe(rows))
    check_chat([tuple(r) for r in rows.collect()], queries()["op2_chat_format"](spark, SF).collect())
    tricky = [
        (1, 0, "user", "a\\"), (1, 1, "assistant", "</s>\\[INST] <s>"), (1, 1, "assistant", "</s>\\[INST] <s>"), (1, None, None, None),
        (None, 2, "[/ROLE]", "x"), (2, 0, "assistant", ""), (3, 0, "assistant", "<"), (4, 0, "user", "[" + "😀\n" * 50000),
    ]
    df = spark.createDataFrame([(*t, 9, "f") for t in tricky], "conv_id long, turn int, role string, text string, n_turns int, formatted string")
    found = chat_format.format_conversations(df, texts=True).collect()
    check_chat(tricky, found)
    for r in found:
        assert len(r.formatted) == r.formatted_chars
        assert sum(len(chat_format.unescape(r.formatted[s.begin:s.end])) for s in r.loss_spans) == r.loss_chars
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_escaping_is_reversible():
    rng = random.Random(5)
    bits = ["\\", "<", "s>", "</s>", "[", "INST]", "[/INST]", "/", "<s>", "a", "[ROLE]"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(8))
        held = chat_format.escape(text)
        assert chat_format.unescape(held) == text
        assert not any(c in held for c in chat_format.CONTROLS)


def test_template_language():
    t = Template("{% set x = 1 + 2 %}{{ x ~ '!' }}{% for m in ms -%}  {{ loop.index }}{{ m.a | upper | default('?') }}"
                 "{% if loop.first and not false %}F{% elif m['a'] == 'b' %}B{% else %}-{% endif %}{% endfor %}{# gone #}")
    assert t.render({"ms": [{"a": "q"}, {"a": "b"}, {}]})[0] == "3!1QF2BB3-"
    assert fold(parse("{{ 'a' + 'b' }}c{% if 1 == 2 %}x{% else %}d{% endif %}")) == [("show", ("const", "abcd"))]
    text, spans = Template("u{% generation %}{{ a }}{% endgeneration %}v").render({"a": "said"})
    assert (text, spans) == ("usaidv", [(1, 5)])
    for bad in ("{% for x %}", "{{ f(1) }}", "{% if a %}", "{{ a | nofilter }}", "{% import os %}", "{{ a. }}"):
        with pytest.raises(TemplateError):
            Template(bad)
    assert Template("{{ a.__class__ }}").render({"a": "x"})[0] == ""  # no Python attributes


# -- 3 near dedup ------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            b.insert(rng.randint(0, len(b)), rng.choice("abcd"))
            if rng.random() < 0.6:
                del b[rng.randrange(len(b))]
        d = edit_distance(a, b)
        for band in (0, 1, 2, 4, 9):
            assert near_dedup.banded(a, b, band) == min(d, band + 1)
            linked, low = near_dedup.align(a, b, band)
            assert linked == (d <= band) and (low == d if linked else band < low <= d)


def brute_groups(rows):
    group = {i: i for i in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(rows)
    for n, j in enumerate(ids):
        for i in ids[:n]:
            a, b = rows[i], rows[j]
            if a and b and near_dedup.align(a, b, near_dedup.limit_of(max(len(a), len(b))))[0]:
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_dedup_equals_all_pairs(spark, docs, texts):
    expected = brute_groups({i: words(t) for i, t in texts.items()})
    for small in (near_dedup.SMALL, 2):
        found = near_dedup.near_groups(docs, small=small).collect()
        assert {r.doc_id: r.class_id for r in found} == expected
        assert all(r.kept == (r.doc_id == r.class_id) for r in found)


def test_near_dedup_chains_and_hot_passages(spark):
    """A drifting chain stays one group; texts that share only a passage stay apart, however many."""
    rng = random.Random(4)
    prepare(spark)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows, held = {}, list(base)
    for i in range(12):
        rows[i] = list(held)
        for _ in range(9):
            held[rng.randrange(len(held))] = f"w{rng.randrange(10**6)}"
    for i in range(100, 160):
        rows[i] = base[:60] + [f"v{rng.randrange(10**6)}" for _ in range(90)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    expected = brute_groups(rows)
    for small in (near_dedup.SMALL, 3):
        assert {r.doc_id: r.class_id for r in near_dedup.near_groups(df, small=small).collect()} == expected


@pytest.mark.parametrize(("size", "least"), [(5, 1), (12, 1), (30, 1), (50, 1), (51, 0.9), (100, 0.9), (300, 0.9)])
def test_near_dedup_keys_find_pairs_at_the_limit(size, least):
    rng, sketch, d = random.Random(size), near_dedup._sketch(), near_dedup.limit_of(size)
    found = 0
    for n in range(200):
        a = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        b = list(a)
        for at in rng.sample(range(size), d) if n % 2 else [(2 * i + 1) * size // (2 * d) for i in range(d)]:
            b[at] = f"v{rng.randrange(10**6)}"
        one, two = sketch([" ".join(a), " ".join(b)])["keys"]
        found += bool({int(x) for x in one} & {int(x) for x in two})
    assert found >= least * 200


def test_near_dedup_large_bucket_loses_no_pair(spark):
    """Near duplicates that agree in little but a passage which many texts hold, against all pairs."""
    rng = random.Random(8)
    prepare(spark)
    passage = [f"p{i}" for i in range(100)]
    rows = {}
    for i in range(150):
        own = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        rows[i] = passage + own
        for at in rng.sample(range(40), 26):
            own[at] = f"v{rng.randrange(10**6)}"
        rows[1000 + i] = passage + own
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_groups(df, small=20).collect()} == brute_groups(rows)


def test_near_duplicates_share_a_rare_key():
    rng = random.Random(6)
    counts = np.array([rng.randrange(1000) for _ in range(near_dedup.CLASSES)])
    for _ in range(1500):
        a = [f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 80))]
        b = edited(rng, a)
        if a != b and near_dedup.align(a, b, near_dedup.limit_of(max(len(a), len(b))))[0]:
            assert set(near_dedup.rare_keys(" ".join(a), counts)) & set(near_dedup.rare_keys(" ".join(b), counts))


def edited(rng, words):
    out = list(words)
    for _ in range(rng.randint(0, max(1, len(words) // 5))):
        i, what = rng.randrange(len(out)), rng.randrange(3)
        if what == 0 and len(out) > 1:
            out.pop(i)
        else:
            out[i:i + (what == 1)] = [f"w{rng.randrange(60)}"]
    return out


def test_hot_passage_costs_rows_in_proportion(spark, monkeypatch):
    """Texts that share one passage and nothing else: no block comparison of all their pairs, and no links."""
    prepare(spark)
    used = []
    monkeypatch.setattr(near_dedup, "_all_pairs", lambda members, texts: used.append(1) or near_dedup._no_links(texts))
    rng = random.Random(12)
    passage = " ".join(f"common{i}" for i in range(30))
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(35)) + " " + passage) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(df, small=20, hot=20).collect()}
    assert got == {i: i for i in range(400)} | {1000 + i: i for i in range(5)}
    assert not used


def staged_rows(monkeypatch):
    """Rows of what near_dedup stages from now on, by label."""
    rows, plain = defaultdict(list), near_dedup.stage

    def stage(df, label):
        out = plain(df, label)
        rows[label].append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "stage", stage)
    return rows


def test_texts_that_share_a_long_passage_are_few_pairs(spark, monkeypatch):
    """A large bucket of texts just beyond the limit: word counts rule most pairs out before any text is dealt out; no link is lost."""
    prepare(spark)
    rng = random.Random(21)
    rows = {i: [f"p{k}" for k in range(560)] + [f"w{rng.randrange(3000)}" for _ in range(200)] for i in range(60)}
    rows[100] = rows[7][:700] + [f"v{k}" for k in range(60)]
    texts = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "id long, norm string")
    members = texts.select(F.lit(5).cast("long").alias("bucket"), "id", F.lit(760).alias("n"), F.col("id").alias("label"))
    staged = staged_rows(monkeypatch)
    found = {(r.id, r.centre) for r in near_dedup._all_pairs(members, texts).collect()}
    limit = near_dedup.limit_of(760)
    assert found == {(i, j) for i in rows for j in rows if j < i and near_dedup.align(rows[i], rows[j], limit)[0]} != set()
    assert staged["near-pairs"][0] < 61 * 60 / 2 / 4


def test_settled_texts_are_not_read_again(spark, monkeypatch):
    """After the stars only the texts of unsettled buckets and their groups are put aside and read."""
    prepare(spark)
    rng = random.Random(22)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = {}
    for i in range(150):
        rows[i] = [word() for _ in range(60)]
        rows[1000 + i] = [*rows[i], word()]
    passage = [word() for _ in range(40)]
    rows |= {2000 + i: passage + [word() for _ in range(50)] for i in range(40)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    staged = staged_rows(monkeypatch)
    assert {r.doc_id: r.class_id for r in near_dedup.near_groups(df, small=10).collect()} == brute_groups(rows)
    assert staged["near-involved"] == [340]
    assert len(staged["near-late"]) == 1 and staged["near-late"][0] <= 40


def test_near_dedup_members_joined_by_others_stay_in_the_bucket(spark):
    """c and m are one group through a in another bucket; x is linked to m alone, and only in the bucket of c, m and x."""
    prepare(spark)
    base = [f"w{i}" for i in range(40)]

    def changed(*places):
        return " ".join(f"v{i}" if i in places else w for i, w in enumerate(base))

    rows = {0: changed(), 1: changed(*range(10)), 2: changed(*range(5)), 3: changed(*range(16))}  # c, m, a, x
    texts = spark.createDataFrame(list(rows.items()), "id long, norm string")
    entries = spark.createDataFrame([(7, 0), (7, 1), (7, 3), (8, 0), (8, 2), (9, 1), (9, 2)], "bucket long, id long").withColumn("n", F.lit(40))
    found = near_dedup.components(near_dedup.links(texts, entries))
    assert {(r.id, r.label) for r in found.collect()} == {(i, 0) for i in rows}


def test_near_dedup_odd(odd, none):
    found = near_dedup.near_groups(odd).collect()
    assert len(found) == len(odd_rows())
    cats = [r for r in found if r.doc_id in (1, 2)]
    assert {r.class_size for r in cats} == {4} and not any(r.kept for r in cats)  # the null id is below all
    assert all(r.class_size == 1 and r.kept for r in found if r.doc_id in (3, 4, 5, 6))
    assert near_dedup.near_groups(none).count() == 0
    left = near_dedup.drop_near(odd)
    assert left.columns == odd.columns and left.count() == sum(r.kept for r in found)


# -- 4 sharding --------------------------------------------------------------


@pytest.mark.parametrize(("dims", "bits"), [(2, 1), (2, 3), (3, 2)])
def test_hilbert_curve_steps_to_neighbours(spark, dims, bits):
    from itertools import product

    df = spark.createDataFrame(list(product(range(1 << bits), repeat=dims)), [f"c{i}" for i in range(dims)])
    rows = df.select("*", hilbert_shards.hilbert_index([F.col(f"c{i}") for i in range(dims)], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << bits * dims))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def check_shards(rows, found):
    assert sorted((r.size, r.text_crc32) for r in found) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_hilbert_shards(docs, texts, odd, none):
    check_shards(list(texts.items()), found := hilbert_shards.assign_shards(docs).collect())
    order = sorted(found, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in found)
    check_shards([(r[0], r[1]) for r in odd_rows()], hilbert_shards.assign_shards(odd).collect())
    assert hilbert_shards.assign_shards(none).count() == 0


def test_write_shards_prunes(spark, docs, tmp_path):
    hilbert_shards.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8
    spread = back.groupBy("shard").agg(F.countDistinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    assert spread < docs.select("lang").distinct().count()  # shards hold fewer languages than a random cut


# -- 5 and 7 tokens ----------------------------------------------------------

PIECES = ["a", "th", "e", "'s", "'re", "'", "!", "?!", " ", "\n", "é", "Σ", "ΑΣ", "İ", "中", "😀", "1", "²", "　",
          "\x1c", "\x85", "<|endoftext|>", "<|start", "oftext|>", "<|", "the ing", "́", "각", "ᄀ", "ᅡ", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_transducer_equals_library(library):
    merges = bpe.Merges(bpe.tokenizer_path())
    rng = random.Random(1)
    samples = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    samples += ["abcthein" * 300, "!?.'\"" * 400, "éèthe" * 200, "a" * 2500, "", "<|endoftext|>"]
    for piece, hold in ((bpe.PIECE, bpe.HOLD), (7, 5)):
        enc = bpe.Encoder(merges, piece, hold)
        for text in samples:
            ids = library.encode(text, add_special_tokens=False).ids
            assert enc.ids(text) == ids
            dec = bpe.TextDecoder(merges)
            assert dec.feed(ids[:3]) + dec.feed(ids[3:]) + dec.finish() == library.decode(ids, skip_special_tokens=False)


def test_word_stream_keeps_bounded_state():
    merges = bpe.Merges(bpe.tokenizer_path())
    rng = random.Random(3)
    word = "".join(rng.choice("abcdeinthrsoulg") for _ in range(5000))
    out, widest = [], 0
    stream = bpe.WordStream(merges, out.append)
    for b in word.encode():
        stream.feed(bytes([b]))
        widest = max(widest, len(stream.recent))
    stream.finish()
    assert widest <= 3 * merges.lookahead + 1
    letters = merges.letters
    data = word.encode()
    assert out == merges.merge([*[letters[b] for b in data[:-1]], letters[data[-1]] + bpe.END])


def test_byte_decoder_assembles_utf8_over_id_borders():
    merges = bpe.Merges(bpe.tokenizer_path())
    text = "naïve 中文 😀 done"
    ids = bpe.Encoder(merges).ids(text)
    dec = bpe.TextDecoder(merges, "bytes")
    assert "".join(dec.feed([i]) for i in ids) + dec.finish() == text + " "


def test_encode_decode_query(spark, docs, texts, odd, none, library):
    def expect(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    found = queries()["op5_bpe_stream"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == {i: expect(t) for i, t in texts.items()}
    rows = bpe.encode_decode(odd).collect()
    assert sorted(tuple(r)[1:] for r in rows) == sorted(expect(r[1]) for r in odd_rows())
    assert bpe.encode_decode(none).count() == 0


def test_token_counts(spark, docs, texts, odd, none, library):
    def expect(text):
        return len((text or "").encode()), len(library.encode(text or "", add_special_tokens=False).ids)

    for chunk, overlap in ((token_counts.CHUNK, token_counts.OVERLAP), (700, 60)):
        found = token_counts.count_tokens(docs, chunk=chunk, overlap=overlap).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == {i: expect(t) for i, t in texts.items()}
        assert all(r.over_limit == (r.n_tokens > 2048) for r in found)
    found = token_counts.count_tokens(odd, chunk=500, overlap=40).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in found) == sorted(expect(r[1]) for r in odd_rows())
    assert max(r.n_windows for r in found) > 100
    assert max(r.overlap for r in found) > 40  # the text without white space needed wider windows
    assert token_counts.count_tokens(none).count() == 0


# -- 6 language, 10 quality --------------------------------------------------


def test_suffix_automaton_knows_all_substrings():
    rng = random.Random(6)
    codes = [rng.randrange(3) for _ in range(60)]
    table_ = language_id.automaton(codes, 3)
    inside = {tuple(codes[i:j]) for i in range(60) for j in range(i, min(61, i + 7))}
    from itertools import product

    for n in range(1, 6):
        for s in product(range(3), repeat=n):
            state = 0
            for c in s:
                state = table_[state, c] if state >= 0 else -1
            assert (state >= 0) == (s in inside)


def test_language_id(spark, docs, odd, none):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    found = queries()["op6_language_id"](spark, SF).collect()
    assert len(found) == len(lang)
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    rows = language_id.identify(odd).collect()
    assert len(rows) == len(odd_rows())
    assert {r.doc_id for r in rows if r.lang_pred == "und"} >= {3, 4, 5, 6}
    assert language_id.identify(none).count() == 0
    kept = language_id.drop_unidentified(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)


def test_language_stage_acts_on_the_prediction(spark):
    prepare(spark)
    rng = random.Random(4)
    one, two = ["bala", "tiro", "mesu"], ["wxyk", "qvzz", "kwqx"]
    rows = [(i, " ".join(rng.choice(one) for _ in range(60)), "aa") for i in range(30)]
    rows += [(i, " ".join(rng.choice(two) for _ in range(60)), "bb") for i in range(100, 130)]
    liar = next(i for i in range(300, 400) if zlib.crc32(str(i).encode()) % 4 == 2)  # nothing is learned from it
    rows += [(liar, " ".join(one * 20), "bb"), (201, " ".join(one * 20), None), (202, " ".join(two * 20), "zz"), (203, "123", "aa"), (204, None, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language_id.drop_unidentified(df).collect()}
    assert liar not in kept and 201 in kept  # not what it declares; declares nothing and not {203, 204} & kept
    assert set(range(30)) | set(range(100, 130)) <= kept
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.drop_unidentified(bare).count() == df.count()  # nothing to learn from: the corpus stays


def test_cross_parsing_counts_longest_matches():
    parser = language_id.CrossParser([("x", "abcabd"), ("y", "ddd")], stretch=1000)
    table_, start = parser.tables[0]

    def phrases(text):
        got = parser.predict([text])
        return got["lang_pred"][0]

    assert phrases("abcabdabc") == "x" and phrases("ddddd") == "y" and phrases("123") == "und"


def test_scripts_with_many_letters_are_told_apart():
    rng = random.Random(9)

    def words_of(first, size):
        letters = [chr(first + i) for i in range(size)]
        return ["".join(rng.choices(letters, k=3)) for _ in range(200)]

    # Han, two languages in the same Hangul letters, Greek, Latin
    held = {"zh": words_of(0x4E00, 300), "k1": words_of(0xAC00, 90), "k2": words_of(0xAC00, 90),
            "el": words_of(0x3B1, 17), "en": words_of(0x61, 26)}
    samples = sorted((lang, " ".join(rng.choices(w, k=400))) for lang, w in held.items())
    texts = {lang: " ".join(rng.choices(w, k=100)) for lang, w in held.items()}
    found = [language_id.CrossParser(samples, dense=n).predict([*texts.values(), "\u0416"]) for n in (language_id.DENSE, 0)]
    assert found[0]["lang_pred"][:-1] == list(texts)
    assert found[0] == found[1]


def test_quality(spark, docs, odd, none):
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    found = queries()["op10_attention_quality"](spark, SF).collect()
    held = [r for r in found if r.held_out and label.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (10, None), (1, 1)], "doc_id long, quality int")
    assert quality.score_quality(odd, labels).count() == len(odd_rows())
    assert quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}


def test_attention_gradient():
    """The hand-written gradient lowers the loss, and attention finds the one telling passage."""
    import numpy as np

    rng = np.random.default_rng(0)
    many = rng.integers(1, 6, 200)
    x = rng.normal(size=(many.sum(), quality.WIDTH)).astype(np.float32)
    label = rng.integers(0, 2, 200)
    starts = np.cumsum(many) - many
    x[starts[label == 1], 0] += 6
    model = quality.GatedAttention().fit(x, many, label.astype(float), epochs=120)
    assert ((model.forward(x, many)["y"] >= 0.5) == label).mean() > 0.95


# -- 8 decontamination -------------------------------------------------------


def brute_hits(text, items):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        if item:
            n = min(10, len(item))
            for k in range(len(item) - n + 1):
                for p in range(len(own) - n + 1):
                    if own[p:p + n] == item[k:k + n]:
                        hit.update(range(p, p + n))
                        names.add("" if name is None else str(name))
    return len(own), len(hit), sorted(names)


def test_decontaminate(spark, docs, texts):
    bench = table(spark, SF, "benchmark")
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    expected = {i: brute_hits(t, items) for i, t in texts.items()}
    for size in (decontaminate.BLOCK_BYTES, 3000):  # one block, many blocks
        found = decontaminate.contamination(docs, bench, block_bytes=size).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in found} == expected
        clean = decontaminate.drop_contaminated(docs, bench, block_bytes=size)
        assert {r.doc_id for r in clean.collect()} == {i for i, e in expected.items() if not e[1]}
    for r in queries()["op8_decontaminate"](spark, SF).collect():
        n, hits, names = expected[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hits, len(names), hits > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()


def test_benchmark_blocks_hold_a_repeated_item_once(spark):
    bench = spark.createDataFrame([("a", "one two three")] * 50 + [("b", "four")], "item_id string, text string")
    rows = [r for block in decontaminate.blocks(bench, block_bytes=100) for r in block.value]
    assert sorted(rows) == [("a", "one two three"), ("b", "four")]


def test_decontaminate_odd(spark, odd, none):
    bench = spark.createDataFrame(
        [(1, "THE cat"), (2, "a"), (None, "sat"), (4, None), (5, "..."), (1, "the cat"), (6, "two three four five six seven eight nine ten eleven")],
        "item_id long, text string")
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    expected = sorted(brute_hits(r[1], items) for r in odd_rows())
    for places in (True, False):
        found = decontaminate.contamination(odd, bench, places=places).collect()
        assert sorted((r.n_words, r.n_hit, r.item_ids) for r in found) == expected
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns


def test_periodic_text_and_item_need_no_product():
    """100,000 words against an item of 10,000, both of period two: hits from window numbers alone."""
    import tracemalloc

    search = decontaminate.TestSuffixes([("i", "a b " * 5000), ("j", "a b a b a b a b a b")]).search
    tracemalloc.start()
    got = search(["a b " * 50_000, "b a " * 4], places=False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["n_hit"] == [100_000, 0] and got["item_ids"] == [["i", "j"], []]
    assert most < 200 << 20


def test_unbalanced_benchmark_blocks_are_cut_further(spark):
    bench = spark.createDataFrame([(str(i), "word " * 40) for i in range(60)], "item_id string, text string")
    parts = decontaminate.blocks(bench, block_bytes=250)
    assert sum(len(p.value) for p in parts) == 60
    assert all(sum(len(t) for _, t in p.value) <= 250 + 200 for p in parts)


def test_longest_matches_have_their_place():
    search = decontaminate.TestSuffixes([("i", " ".join(f"w{k}" for k in range(30)))]).search
    text = "x y " + " ".join(f"w{k}" for k in range(5, 25)) + " z"
    assert search([None, text])["matches"][1] == [{"item_id": "i", "doc_word": 2, "item_word": 5, "words": 20}]


# -- 9 personal data ---------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]
            if good():
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def check_pii(rows, found):
    assert len(found) == len(rows)
    expected = defaultdict(list)
    for i, t in rows:
        expected[i].append(base_spans(t or ""))
    for r in found:
        options = expected[r.doc_id]
        listing = {",".join(f"{k}:{a}:{b}" for a, _, b, k in spans): spans for spans in options}
        spans = next(s for text, s in listing.items() if hashlib.sha256(text.encode()).hexdigest() == r.base_sha256)
        for kind in BASE:
            assert r[f"n_{kind}"] == sum(s[3] == kind for s in spans)
        assert {f"{k}:{a}:{b}" for a, _, b, k in spans} <= set(r.spans.split(",")) | {""}


def test_pii_base_spans(spark, docs, texts, odd, none):
    check_pii(list(texts.items()), queries()["op9_pii_boosting"](spark, SF).collect())
    rng = random.Random(3)
    bits = ["a", "b.c", "@", "x-y", ".", "com", " ", "1", "22", "255", "256", "-", "(", ")", "+", "+1", "555",
            "4111111111111111", "4111 1111 1111 1111", "é", "😀", "\n", "%", "..", "@@", "0", 'token = "', '"', "deadbeef0011aa"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(600)]
    rows += [(1000, "1" * 4000), (1001, "a" * 20000), (1002, "1." * 3000), (1003, "+1" * 3000), (1004, "1 " * 6000), (1005, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_pii(rows, pii.digest(pii.find_spans(df)).collect())
    check_pii([(r[0], r[1]) for r in odd_rows()], pii.digest(pii.find_spans(odd)).collect())
    assert pii.digest(pii.find_spans(none)).count() == 0


def test_pii_stays_linear_in_hits(spark):
    """A megabyte with 40,000 hits: base spans as by brute force, in seconds."""
    import time

    prepare(spark)
    line = "+1 (555) 010-9999 a.b{}@mail.example.org\n"
    text = "".join(line.format(i % 97) for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = time.monotonic()
    got = pii.digest(pii.find_spans(df)).collect()
    assert time.monotonic() - begun < 30
    check_pii([(1, text)], got)
    assert (got[0].n_phone, got[0].n_email) == (20_000, 20_000)


def test_pii_trees_add_secrets_and_spare_prose(spark):
    prepare(spark)
    rng = random.Random(8)
    rows = [(i, f'some words token = "{rng.getrandbits(160):040x}" more words') for i in range(60)]
    rows += [(i, "just plain words here, in the year 1999 and 2024.") for i in range(100, 160)]
    rows += [(200, f'key holder = "{rng.getrandbits(160):040x}" here')]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find_spans(df)).collect()}
    assert all(spans[i].startswith("secret:") for i in range(60))
    assert spans[200].startswith("secret:")  # no listed name: the trees' verdict
    assert all(spans[i] == "" for i in range(100, 160))
    found = df.join(pii.find_spans(df), "doc_id").select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("t"))
    assert {r.t for r in found.where("doc_id < 60").collect()} == {'some words token = "[SECRET]" more words'}


# -- pipeline and registration -----------------------------------------------


def test_native_operators_run_no_python(spark):
    for name in ("op1_exact_dedup", "op4_hilbert_shards", "op9_pii_boosting"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_pipeline(spark, texts):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    docs = table(spark, SF, "documents")
    bench = [(r.item_id, words(r.text)) for r in table(spark, SF, "benchmark").collect()]
    alive = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    last = {}
    for i, t in sorted(alive.items()):
        last[t.translate(FOLD)] = i
    alive = {i: alive[i] for i in last.values()}
    groups = brute_groups({i: words(t) for i, t in alive.items()})
    alive = {i: t for i, t in alive.items() if groups[i] == i}
    alive = {i: t for i, t in alive.items() if not brute_hits(t, bench)[1]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(alive)
    for name, fn in corpus_pipeline.STAGES[:-1]:
        assert fn(spark, docs, SF).columns == docs.columns, name


def test_queries_are_registered():
    names = list(queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(oracle_sql()) <= set(names)
