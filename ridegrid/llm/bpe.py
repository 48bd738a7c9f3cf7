"""Operator 5: BPE encoding and decoding as a bounded-lookahead streaming transducer.

``Merges`` reads a tokenizer file (normaliser: NFC, white space to one blank,
lower case; pre-tokenizer: contractions, letter runs, single digits, other
runs; byte-level BPE with an end-of-word mark).

*Transducer.*  For every prefix of a word exactly one token ends the prefix's
encoding: the one that is compatible with the token before it (two tokens are
compatible when BPE keeps them apart as written).  ``WordStream`` keeps this
last token for the most recent prefixes only.  A token has at most
``lookahead`` symbols, computed from the merge list, so whatever follows, the
encoding passes through one of the last ``lookahead`` prefixes: once the
chains from all of them run through one boundary, every token before it is
stable and is emitted.  The state is bounded by the lookahead, whatever the
length of the word.

``TextStream`` feeds text in pieces: it cuts normalisation only before
characters that never combine backwards, holds back an unfinished pre-token or
special string of bounded size, and passes longer ones on to ``WordStream``.
Words are remembered in a bounded table per worker.

*Decoding.*  ``TextDecoder`` turns ids back to text one at a time; ``mode
"library"`` gives the tokens' written forms with blanks between (as a
tokenizer file without a decoder does), ``mode "bytes"`` undoes the byte
alphabet, turns word ends to blanks and assembles UTF-8 over id borders.

Defined results: null text counts as empty and has no tokens.  Rows that
repeat are each returned; only the named columns are read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import regex
from pyspark.sql import DataFrame

from ridegrid.llm.common import id_text, map_texts

VOCABULARY = "word_bpe_49k.json"
PIECE = 1 << 16  # characters handed to the transducer at a time
HOLD = 256  # longest unfinished pre-token that is held back as a whole
WORDS_KEPT = 150_000  # entries of each of the two generations of a worker's word table
END = "</w>"

# Unicode white space: what Python calls space, without the four ASCII separators.
_SPACE = "".join(regex.escape(c) for c in map(chr, range(0x3001)) if c.isspace() and not 0x1C <= ord(c) <= 0x1F)
_OTHER = rf"[^{_SPACE}\p{{L}}\p{{N}}]+"
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|{_OTHER}")
_LETTERS = regex.compile(r"\p{L}+")
_OTHERS = regex.compile(_OTHER)


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The byte alphabet: printable Latin-1 bytes as themselves, the others from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    return letters


def safe_start(c: str) -> bool:
    """True if NFC never joins ``c`` to what stands before it."""
    o = ord(c)
    return o < 0x300 or 0x400 <= o <= 0x482 or 0x3400 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3


class Merges:
    """Vocabulary, merge ranks, special strings and the lookahead that they need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) for m in model["merges"]]
        self.pair_rank = {self.vocab[a] << 32 | self.vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.merged = [self.vocab[a + b] for a, b in merges]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.names: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.inner = [self.vocab[c] for c in self.letters]
        self.final = [self.vocab[c + END] for c in self.letters]
        self.lookahead = max(map(self.length, self.vocab))
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.longest_special = max(map(len, self.special), default=0)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}

    @staticmethod
    def length(token: str) -> int:
        """Symbols of a token (the end mark belongs to its last symbol)."""
        return len(token.removesuffix(END)) if token != END else 1

    def merge_ids(self, ids: list[int]) -> list[int]:
        """Apply the merge list to symbol ids: the best-ranked pair first, leftmost among equals."""
        get, made, none = self.pair_rank.get, self.merged, 1 << 30
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at:at + 2] = [new := made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 32 | new, none)
            if at < len(ranks):
                ranks[at] = get(new << 32 | ids[at + 1], none)
        return ids

    def merge(self, parts: list[str]) -> list[str]:
        return [self.names[i] for i in self.merge_ids([self.vocab[p] for p in parts])]

    def symbols(self, token: str) -> list[str]:
        if token.endswith(END) and token != END:
            body = token.removesuffix(END)
            return [*body[:-1], body[-1] + END]
        return list(token)

    def is_whole(self, token: str) -> bool:
        """True if the token's own symbols encode to it (others never come out)."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = token in self.vocab and self.merge(self.symbols(token)) == [token]
        return known

    def compatible(self, left: str, right: str) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > WORDS_KEPT:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merge(self.symbols(left) + self.symbols(right)) == [left, right]
        return known


class WordStream:
    """Encodes one word, symbol by symbol, with state bounded by the lookahead."""

    def __init__(self, merges: Merges, emit: Callable[[str], None]):
        self.m, self.emit = merges, emit
        self.held: str | None = None  # the last byte; whether it ends the word is not known yet
        self.recent: list[str] = []  # symbols that are not emitted
        self.last: list[str] = []  # the token that ends each prefix of them

    def feed(self, data: bytes) -> None:
        letters = self.m.letters
        for b in data:
            if self.held is not None:
                self._push(self.held)
            self.held = letters[b]

    def finish(self) -> None:
        if self.held is not None:
            self._push(self.held + END)
            for token in self._chain(len(self.last)):
                self.emit(token)
        self.held, self.recent, self.last = None, [], []

    def _push(self, symbol: str) -> None:
        m, n = self.m, len(self.recent)
        self.recent.append(symbol)
        token = ""
        for size in range(1, min(m.lookahead, n + 1) + 1):
            token = self.recent[n + 1 - size] + token
            before = n + 1 - size
            if (size == 1 or m.is_whole(token)) and (before == 0 or m.compatible(self.last[before - 1], token)):
                # ``before == 0``: the token starts at the last stable boundary; the token in front
                # of it was checked when the boundary became stable (see _settle).
                if before or not self._front or m.compatible(self._front, token):
                    self.last.append(token)
                    break
        else:
            raise ValueError(f"no token ends the prefix with {symbol!r}")
        if len(self.last) >= 3 * m.lookahead:
            self._settle()

    _front = ""  # the last token emitted

    def _chain(self, end: int) -> list[str]:
        out = []
        while end:
            out.append(self.last[end - 1])
            end -= self.m.length(out[-1])
        return out[::-1]

    def _settle(self) -> None:
        """Emit up to the last boundary that the chains of all recent prefixes share."""
        common: set[int] | None = None
        n = len(self.last)
        for end in range(n - self.m.lookahead + 1, n + 1):
            cuts, at = set(), end
            while at:
                cuts.add(at)
                at -= self.m.length(self.last[at - 1])
            common = cuts if common is None else common & cuts
        cut = max((c for c in common or () if c), default=0)
        if cut:
            for token in self._chain(cut):
                self.emit(token)
                self._front = token
            self.recent, self.last = self.recent[cut:], self.last[cut:]


class TextStream:
    """Encodes text that arrives in pieces; ``word(letters_of_word)`` is called for each pre-token."""

    def __init__(self, merges: Merges, whole: Callable[[str], None], token: Callable[[str], None],
                 special: Callable[[int], None], pieces: int = PIECE, hold: int = HOLD):
        self.m, self.whole, self.token, self.special = merges, whole, token, special
        self.piece, self.hold = pieces, hold
        self.raw = ""  # not split at special strings yet
        self.text = ""  # normalised, not cut into pre-tokens yet
        self.tail = ""  # raw, waits for a safe place to normalise
        self.open: WordStream | None = None  # a long pre-token on its way
        self.more = _LETTERS

    def feed(self, piece: str, last: bool = False) -> None:
        self.raw += piece
        if self.m.split_special is not None:
            while (found := self.m.split_special.search(self.raw)) is not None:
                self._plain(self.raw[: found.start()], True)
                self.special(self.m.special[found[0]])
                self.raw = self.raw[found.end():]
        keep = 0 if last else min(len(self.raw), max(0, self.m.longest_special - 1))
        ready, self.raw = self.raw[: len(self.raw) - keep], self.raw[len(self.raw) - keep:]
        self._plain(ready, last)

    def _plain(self, piece: str, last: bool) -> None:
        """Normalise as far as no later character can change it."""
        data, cut = self.tail + piece, len(self.tail) + len(piece)
        if not last:
            cut -= 1
            while cut > 0 and not safe_start(data[cut]):
                cut -= 1
        cut = max(cut, 0)
        self.tail, data = data[cut:], data[:cut]
        self.text += normalise(data)
        self._cut(last)

    def _cut(self, last: bool) -> None:
        text, at = self.text, 0
        if self.open is not None:
            found = self.more.match(text)
            at = found.end() if found else 0
            self.open.feed(text[:at].encode())
            if at == len(text) and not last:
                self.text = ""
                return
            self.open.finish()
            self.open = None
        whole, end = self.whole, len(text)
        for found in _PRETOKEN.finditer(text, at):
            if found.end() > end - 4 and not last:  # may go on (or be part of a contraction)
                at = found.start()
                break
            whole(found[0])
            at = found.end()
        else:
            at = end
        rest = text[at:]
        if not last and len(rest) > self.hold and (run := _LETTERS.fullmatch(rest) or _OTHERS.fullmatch(rest)):
            self.more = run.re
            self.open = WordStream(self.m, self.token)
            self.open.feed(rest.encode())
            rest = ""
        self.text = rest


def normalise(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
    return text.lower()  # white space only parts pre-tokens, so its runs need no rewriting


class Encoder:
    """Encodes whole texts; words come from a bounded table, filled by the transducer."""

    def __init__(self, merges: Merges, piece: int = PIECE, hold: int = HOLD):
        self.m, self.piece, self.hold = merges, piece, hold
        self.words: dict[str, bytes] = {}  # pre-token to packed ids
        self.older: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            m, data = self.m, word.encode()
            if len(data) <= m.lookahead:  # as a whole within the lookahead: nothing can be emitted earlier
                ids = [m.inner[b] for b in data]
                ids[-1] = m.final[data[-1]]
                ids = m.merge_ids(ids)
            else:
                tokens: list[str] = []
                stream = WordStream(m, tokens.append)
                stream.feed(data)
                stream.finish()
                ids = [m.vocab[t] for t in tokens]
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self.words) >= WORDS_KEPT:
                self.words, self.older = {}, self.words
            self.words[word] = packed
        return packed

    def parts(self, text: str) -> Iterator[bytes]:
        """Packed ids (little-endian, 32 bits) of the text, piece by piece."""
        word = self._word
        if len(text) <= self.piece and (self.m.split_special is None or not self.m.split_special.search(text)):
            get = self.words.get
            yield b"".join([get(w) or word(w) for w in _PRETOKEN.findall(normalise(text))])
            return
        out: list[bytes] = []

        def special(i: int) -> None:
            out.append(struct.pack("<I", i))

        def token(t: str) -> None:
            out.append(struct.pack("<I", self.m.vocab[t]))

        stream = TextStream(self.m, lambda w: out.append(self.words.get(w) or word(w)), token, special, self.piece, self.hold)
        for at in range(0, len(text), self.piece):
            stream.feed(text[at:at + self.piece])
            yield b"".join(out)
            out.clear()
        stream.feed("", True)
        yield b"".join(out)

    def count(self, text: str) -> int:
        return sum(map(len, self.parts(text))) // 4

    def ids(self, text: str) -> list[int]:
        data = b"".join(self.parts(text))
        return list(struct.unpack(f"<{len(data) // 4}I", data))


class TextDecoder:
    """Incremental ids-to-text state machine."""

    def __init__(self, merges: Merges, mode: str = "library"):
        self.m, self.mode, self.first = merges, mode, True
        self.back = {c: b for b, c in enumerate(merges.letters)}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        names = list(map(self.m.names.__getitem__, ids))
        if self.mode == "library":
            if not names:
                return ""
            out = ("" if self.first else " ") + " ".join(names)
            self.first = False
            return out
        out = []
        for name in names:
            if name in self.m.special:
                out.append(self.utf8.decode(b"", True) + name)
                self.utf8.reset()
                continue
            body = name.removesuffix(END)
            out.append(self.utf8.decode(bytes(self.back[c] for c in body)))
            if name.endswith(END):
                out.append(" ")
        return "".join(out)

    def finish(self) -> str:
        return self.utf8.decode(b"", True) if self.mode == "bytes" else ""


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; its word table lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(Merges(path))
    return _encoders[path]


def _encode_digests(name: str):
    def make():
        enc = encoder(name if os.path.isabs(name) else tokenizer_path(name))

        def run(texts: list) -> dict[str, list]:
            counts, ids, decoded = [], [], []
            for text in texts:
                n, h, d = 0, hashlib.sha256(), hashlib.sha256()
                decoder = TextDecoder(enc.m)
                for packed in enc.parts(text or ""):
                    n += len(packed) // 4
                    h.update(packed)
                    d.update(decoder.feed(struct.unpack(f"<{len(packed) // 4}I", packed)).encode())
                counts.append(n)
                ids.append(h.hexdigest())
                decoded.append(d.hexdigest())
            return {"n_tokens": counts, "ids_sha256": ids, "decoded_sha256": decoded}

        return run

    return make


def encode_decode(docs: DataFrame, tokenizer: str = VOCABULARY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``tokenizer`` is a tokenizer file's path (which executors can read) or its
    name in the installed vocabulary package.
    """
    return map_texts(id_text(docs, text_col, id_col), _encode_digests(tokenizer),
                     "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"])


def encode(docs: DataFrame, tokenizer: str = VOCABULARY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id and the token ids."""

    def make():
        enc = encoder(tokenizer if os.path.isabs(tokenizer) else tokenizer_path(tokenizer))
        return lambda texts: {"ids": [enc.ids(t or "") for t in texts]}

    return map_texts(id_text(docs, text_col, id_col), make, "ids array<int>", ["doc_id"])
