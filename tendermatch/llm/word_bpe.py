"""Operator 12: byte-pair encoding of words with segment trees over pair ranks.

The symbols of a word stand in a row; leaf i of its tree holds the rank of the
merge of symbol i with the one after it (above every rank if there is none),
with i as the lower digits. The root is then the leftmost merge of the lowest
rank. Doing it changes at most three leaves, each in logarithmic time, and the
word is done when the root holds no merge. The trees of many words are the
rows of one array, and a step does the next merge of every word that has one.

A text is first cut at white space: no pattern of the vocabulary spans it, so
the ids of a stretch depend on the stretch alone and a worker remembers those
it has met. Inside a stretch the vocabulary's rules hold: its special tokens
stand for themselves, the rest is put into NFC, lower-cased character by
character and cut into words, whose last symbol carries the word end.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermatch.llm.common import held, ship

MAX_STRETCHES = 300_000  # stretches, and words, whose ids a worker remembers
LONG_STRETCH = 64        # code points; longer ones are not remembered
LONG_WORD = 512          # symbols; longer words are first cut where no token can stand across
SLICE = 1 << 20          # code points of texts that are encoded at a time
CHUNK = 1 << 16          # ids decoded at a time
OUT_IDS = 1 << 20        # ids after which a worker hands on its rows
NEVER = 1 << 62          # above every rank

#: White space of the vocabulary's rules (Unicode White_Space). Fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: str.split() also cuts at these four, which are no white space here.
NOT_SPACE = re.compile("[\x1c-\x1f]")
STRETCH = re.compile(f"[^{SPACE}]+")
SPACES = re.compile(f"[{SPACE}]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable in Latin-1, else the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


#: Capital letters that Unicode got after the tables of Python: first, last, distance to the small letter. Fixed values.
NEW_CAPITALS = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
                (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
                (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]

NEW_SMALL = {c: c + step for first, last, step in NEW_CAPITALS for c in range(first, last + 1)}


#: Letters and digits that Unicode 16 added to the tables of Python (Unicode 15): first, last. Fixed values.
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
               (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
               (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
               (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_DIGITS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
              (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def category_class(kind: str) -> str:
    """Code points whose general category begins with ``kind``, ("L" or "N"), as ranges of a character class."""
    found, begin = [], -1
    new = {c for first, last in {"L": NEW_LETTERS, "N": NEW_DIGITS}[kind] for c in range(first, last + 1)}
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and (unicodedata.category(chr(c))[0] == kind or c in new)
        if inside and begin < 0:
            begin = c
        elif not inside and begin >= 0:
            found.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = -1
    return "".join(found)


def plain_pattern(pattern: str) -> re.Pattern:
    """The vocabulary's pattern with its Unicode classes written out as ranges of Python's own tables; the classes of
    other libraries follow other versions of Unicode."""
    own = {r"\p{L}": category_class("L"), r"\p{N}": category_class("N"), r"\s": SPACE}
    out, inside = [], False
    for part in re.split(r"(\\p\{[LN]\}|\\s|\[\^?|\])", pattern):
        if part in own:
            out.append(own[part] if inside else f"[{own[part]}]")
            continue
        inside = part.startswith("[") or (inside and part != "]")
        out.append(part)
    return re.compile("".join(out))


class Merges:
    """The merges of a vocabulary, to be looked up by pairs of symbols."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        """``pairs``: left, right and merged symbol by rank."""
        left, right, merged = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        key = left << 32 | right
        self.rank = np.argsort(key, kind="stable")
        self.keys = key[self.rank]
        self.merged = merged

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER where there is no merge."""
        if not len(self.keys):
            return np.full(left.shape, NEVER)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER)


def merge_rows(symbols: np.ndarray, n: np.ndarray, merges: Merges) -> None:
    """Do all merges of every row of ``symbols`` (row r has ``n[r]`` of them, the rest is -1) in place; places that were
    merged away become -1.

    Rows of ``tree`` are segment trees with the root at 1 and leaf i at ``size + i``, which holds ``rank * size + i`` of
    the pair that begins at place i.
    """
    b, width = symbols.shape
    if width < 2:
        return
    size = 1 << (width - 2).bit_length()
    places = np.arange(width)
    tree = np.full((b, 2 * size), NEVER)
    ranks = merges.ranks(symbols[:, :-1], symbols[:, 1:])
    tree[:, size:size + width - 1] = np.where(ranks < NEVER, ranks * size + places[:-1], NEVER)
    level = size
    while level > 1:
        np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2], out=tree[:, level // 2:level])
        level //= 2
    after, before = np.tile(places + 1, (b, 1)), np.tile(places - 1, (b, 1))
    tree, flat, after, before = tree.ravel(), symbols.reshape(-1), after.ravel(), before.ravel()
    rows = np.arange(b)
    while True:
        root = tree[rows * (2 * size) + 1]
        rows, root = rows[root < NEVER], root[root < NEVER]
        if not len(rows):
            return
        trees, own = rows * (2 * size), rows * width
        i = root % size
        j = after[own + i]
        k = after[own + j]
        merged = merges.merged[root // size]
        flat[own + i], flat[own + j], after[own + i] = merged, -1, k
        more = k < n[rows]                       # a symbol follows
        before[(own + k)[more]] = i[more]
        follows = merges.ranks(merged, flat[own + np.where(more, k, i)])
        leaf_i = np.where(more & (follows < NEVER), follows * size + i, NEVER)
        h = before[own + i]
        held_back = h >= 0                       # a symbol stands before
        ahead = merges.ranks(flat[own + np.maximum(h, 0)], merged)
        leaf_h = np.where(ahead < NEVER, ahead * size + h, NEVER)
        base = np.concatenate([trees, trees[more], trees[held_back]])
        at = size + np.concatenate([i, j[more], h[held_back]])
        tree[base + at] = np.concatenate([leaf_i, np.full(int(more.sum()), NEVER), leaf_h[held_back]])
        while at[0] > 1:
            at = at >> 1
            tree[base + at] = np.minimum(tree[base + 2 * at], tree[base + 2 * at + 1])


class WordCodec:
    """Text to ids and back by a vocabulary file of the ``tokenizers`` library: NFC, lower case, words by a pattern,
    byte letters, merges with a word end."""

    def __init__(self, data: bytes, max_stretches: int = MAX_STRETCHES):
        spec = json.loads(data)
        model, added = spec["model"], spec["added_tokens"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, at in [*self.ids.items(), *self.special.items()]:
            self.tokens[at] = token
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in merges])
        letters = byte_letters()
        self.inner = np.array([self.ids[c] for c in letters])
        self.last = np.array([self.ids[c + self.end] for c in letters])
        byte_of = {c: b for b, c in enumerate(letters)}
        self.across = np.zeros((256, 256), dtype=bool)           # bytes that stand side by side in some token
        for token in self.ids:
            own = [byte_of[c] for c in token.removesuffix(self.end) if c in byte_of]
            self.across[own[:-1], own[1:]] = True
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.cut_words = plain_pattern(split)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.mark = os.path.commonprefix(list(self.special))       # what every special token begins with
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}          # what was known when the table was full the last time
        self.most = max_stretches

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then every character lower-cased by itself (no final sigma)."""
        text = unicodedata.normalize("NFC", text)
        if max(text, default="") >= "\u1c89":
            text = text.translate(NEW_SMALL)
        return text.replace("\u03a3", "\u03c3").lower()

    def parts(self, word: str) -> list[np.ndarray]:
        """The symbols of a word, a long one in parts that no token can span."""
        data = np.frombuffer(word.encode("utf-8"), dtype=np.uint8)
        symbols = self.inner[data]
        symbols[-1] = self.last[data[-1]]
        if len(data) <= LONG_WORD:
            return [symbols]
        cuts = np.flatnonzero(~self.across[data[:-1], data[1:]]) + 1
        return np.split(symbols, cuts)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word. Words of up to so many symbols, a power of two, are merged together."""
        rows, owner = [], []
        for k, word in enumerate(words):
            own = self.parts(word)
            rows += own
            owner += [k] * len(own)
        n = np.array([len(r) for r in rows], dtype=np.int64)
        out: list[list[bytes]] = [[] for _ in words]
        found: list[bytes] = [b""] * len(rows)
        widths = np.array([1 << int(x - 1).bit_length() for x in n], dtype=np.int64)
        for width in np.unique(widths):
            of_width = np.flatnonzero(widths == width)
            step = max(1, (1 << 18) // int(width))
            for begin in range(0, len(of_width), step):
                some = of_width[begin:begin + step]
                table = np.full((len(some), int(width)), -1, dtype=np.int64)
                table[np.arange(width) < n[some][:, None]] = np.concatenate([rows[r] for r in some])
                merge_rows(table, n[some], self.merges)
                kept = table >= 0
                ids, ends = table[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)) * 4
                at = 0
                for r, end in zip(some.tolist(), ends.tolist()):
                    found[r], at = ids[at:end], end
        for k, ids in zip(owner, found):
            out[k].append(ids)
        return [b"".join(x) for x in out]

    def cut(self, stretch: str) -> list[str | int]:
        """Words of text without white space, and ids of special tokens."""
        out: list[str | int] = []
        for k, part in enumerate(self.cut_special.split(stretch) if self.mark in stretch else (stretch,)):
            if k % 2:
                out.append(self.special[part])
            else:
                out += self.cut_words.findall(part.lower() if part.isascii() else self.normal(part))
        return out

    def learn(self, stretches: set[str]) -> None:
        """See to it that the ids of these stretches are known."""
        new = stretches.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.old, self.known, new = self.known, {}, stretches
        rest = []
        for stretch in new:
            ids = self.old.get(stretch)
            if ids is None:
                rest.append(stretch)
            else:
                self.known[stretch] = ids
        cut = [self.cut(stretch) for stretch in rest]
        if len(self.words) > self.most:
            self.words = {}
        words = list({w for own in cut for w in own if isinstance(w, str) and w not in self.words})
        ids_of = self.words
        ids_of.update(zip(words, self.encode_words(words)))
        for stretch, own in zip(rest, cut):
            self.known[stretch] = b"".join([ids_of[w] if isinstance(w, str) else struct.pack("<I", w) for w in own])
        for word in words:
            if len(word) > LONG_STRETCH:
                del ids_of[word]

    @staticmethod
    def stretches(text: str) -> Iterator[tuple[list[str], int, bool]]:
        """The stretches between white space, the length of their text and whether they are its last; long texts come
        in parts that end at white space."""
        begin = 0
        while True:
            end = begin + SLICE
            if end < len(text):
                space = SPACES.search(text, end)
                end = space.start() if space else len(text)
            part = text[begin:end] if begin or end < len(text) else text
            yield STRETCH.findall(part) if NOT_SPACE.search(part) else part.split(), len(part), end >= len(text)
            begin = end
            if begin >= len(text):
                return

    def encode_texts(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. The stretches of many texts, or of a part of a
        long one, are encoded together."""
        waiting: list[tuple[list[str], bool]] = []       # stretches, whether they end a text
        size, out = 0, bytearray()

        def flush() -> Iterator[bytes]:
            nonlocal out
            wanted = set()
            for part, _ in waiting:
                wanted.update(part)
            self.learn(wanted)
            for part, ends in waiting:
                out += b"".join(map(self.known.__getitem__, part))
                if ends:
                    yield bytes(out)
                    out = bytearray()
            for stretch in wanted:
                if len(stretch) > LONG_STRETCH:
                    del self.known[stretch]

        for text in texts:
            for part, length, ends in self.stretches(text):
                waiting.append((part, ends))
                size += length
                if size >= SLICE:
                    yield from flush()
                    waiting, size = [], 0
        yield from flush()

    def encode(self, text: str) -> bytes:
        return next(self.encode_texts([text]))

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        """The tokens joined by blanks, as the library's decode does without a decoder; in parts."""
        for begin in range(0, len(ids), CHUNK):
            part = " ".join(map(self.tokens.__getitem__, ids[begin:begin + CHUNK].tolist()))
            yield " " + part if begin else part


def encode_documents(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True,
                     max_stretches: int = MAX_STRETCHES) -> DataFrame:
    """``<id_col>, n_tokens long, ids_sha256, decoded_sha256`` and, unless
    ``keep_ids`` is off, ``ids array<int>`` for every row of ``docs``.

    Rows are mapped one to one without a shuffle: repeated rows stay repeated,
    null ids stay null, a null or empty text (or one of white space) has no
    ids, other columns are left out whatever their names, and an empty table
    gives an empty one. ``vocabulary`` (the bytes of the file) goes to the
    workers as a broadcast variable; a worker compiles it once.
    ``max_stretches`` bounds what a worker remembers and changes its memory and
    time only. A word of n symbols takes memory in proportion to the longest
    part of it that tokens could span.
    """
    shared = ship(docs.sparkSession, vocabulary, max_stretches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(shared, WordCodec)
        for batch in batches:
            counts, hashes, back, packed, begin, held_ids = [], [], [], [], 0, 0
            texts = (text.as_py() or "" for text in batch.column(1))
            for row, ids in enumerate(own.encode_texts(texts), 1):
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                digest = hashlib.sha256()
                for part in own.decode(np.frombuffer(ids, dtype="<u4")):
                    digest.update(part.encode("utf-8"))
                back.append(digest.hexdigest())
                packed.append(ids if keep_ids else b"")
                held_ids += counts[-1]
                if row < batch.num_rows and (held_ids < OUT_IDS or not keep_ids):
                    continue
                out = [batch.column(0).slice(begin, row - begin), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()),
                       pa.array(back, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
                counts, hashes, back, packed, begin, held_ids = [], [], [], [], row, 0

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


def decode_ids(table: DataFrame, vocabulary: bytes, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``table`` with its ids' tokens joined by blanks in ``out_col`` (an existing
    column of that name is replaced); null ids give null."""
    shared = ship(table.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def text(ids):
        own = held(shared, WordCodec)
        return ids.map(lambda x: None if x is None else "".join(own.decode(np.asarray(x, dtype=np.uint32))))

    return table.withColumn(out_col, text(F.col(ids_col)))
