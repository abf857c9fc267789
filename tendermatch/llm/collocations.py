"""Operator 11: phrase collocations by direct-address tiling.

The items of a language (words first) are ranked by falling frequency, so that
adjacent pairs of them crowd in one corner of the square of all pairs. The
square is cut into tiles. A tile with many occurrences is a dense array of
counters addressed by the pair itself (numpy ``bincount``); the occurrences of
the others are sorted once and counted as coordinates. Pairs that occur often
enough in all texts are ranked by frequency in their turn and become the items
of the next round: two neighbouring phrases of m words that overlap in m - 1
of them are a phrase of m + 1 words.

Texts are tokenised once, into chunks of one language of a bounded number of
tokens; a chunk carries the code of each token in its own list of words. The
counts of all texts come back to a chunk as rows for its list, so a frequent
word is one row for each chunk. The tiles of a chunk are counted in its task,
with the chunk's items ranked by their counts in all texts; the cells are added
up by Spark under the numbers of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermatch.llm.common import pin
from tendermatch.operators.ranking import with_row_index

TOKENS = 1 << 20         # tokens of a chunk
WORD_BYTES = 1 << 25     # bytes of the words of a chunk
SLICE = 1 << 19          # bytes of a text that are tokenised at a time
BROADCAST_BYTES = 1 << 25        # words with their numbers are broadcast up to this many bytes, joined by a shuffle beyond
ROWS = 1 << 16           # rows that a task hands on at a time
TILE = 512               # items along a side of a tile
DENSE = 16               # a tile is dense if it has an occurrence for so many cells
LANG_UNKNOWN = "und"
CHUNKS = "chunk bigint, lang string, lead int, codes binary, words array<string>, counts binary"
PAIR_CHUNKS = "chunk bigint, lead int, codes binary, words binary, counts binary"

#: A-Z to a-z, the ends of pieces to line feeds, tabs to blanks. Fixed values.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
BREAK, NOTHING = -1, -2


def squeeze(values: np.ndarray) -> bytes:
    """An array's bytes, the first bytes of all values before the second ones, compressed, behind their number."""
    raw = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(data: bytes, kind: str) -> np.ndarray:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def key_names(length: int) -> list[str]:
    """Columns for the numbers of a phrase's words, two of them in each bigint."""
    return [f"k{j}" for j in range((length + 1) // 2)]


def pack_words(words: np.ndarray) -> list[np.ndarray]:
    """Word numbers (a row for each word of the phrase) in pairs, the first of a pair in the upper 32 bits. Rows that are
    shuffled stay short so."""
    if words.size and int(words.max()) >= 1 << 31:
        raise ValueError("more than 2**31 words occur often enough; raise min_count")
    return [words[j] << 32 | words[j + 1] if j + 1 < len(words) else words[j] for j in range(0, len(words), 2)]


def unpack_words(keys: list[np.ndarray], length: int) -> np.ndarray:
    out = []
    for k, key in enumerate(keys):
        out += [key >> 32, key & 0xFFFFFFFF] if 2 * k + 1 < length else [key]
    return np.stack(out)


class _Codes(dict):
    """Codes of words in the order in which they come."""

    def __init__(self):
        super().__init__({b"\n": BREAK, b"": NOTHING})
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self) - 2
        self.bytes += len(word) + 64
        return code


class _Chunk:
    """Tokens of one language; the first ``lead`` of them were counted in the chunk before."""

    def __init__(self, lead: list[bytes] = ()):
        self.codes, self.parts, self.n, self.lead = _Codes(), [], 0, len(lead)
        self.put(lead)

    def put(self, tokens: list[bytes]) -> None:
        found = np.fromiter(map(self.codes.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        found = found[found != NOTHING]
        self.parts.append(found)
        self.n += len(found)

    def full(self) -> bool:
        return self.n >= TOKENS or self.codes.bytes >= WORD_BYTES

    def columns(self) -> tuple[bytes, list[bytes], np.ndarray]:
        codes = np.concatenate(self.parts)
        words = [w for w, c in self.codes.items() if c >= 0]
        own = codes[self.lead:]
        return squeeze(codes.astype("<i4")), words, np.bincount(own[own >= 0], minlength=len(words))

    def tail(self, length: int) -> list[bytes]:
        """The last words, back to a break."""
        codes = np.concatenate(self.parts)[-length:] if length else np.zeros(0, dtype=np.int32)
        codes = codes[np.flatnonzero(codes == BREAK)[-1] + 1:] if (codes == BREAK).any() else codes
        wanted = set(codes.tolist())
        by_code = {c: w for w, c in self.codes.items() if c in wanted}
        return [by_code[c] for c in codes.tolist()]


def slices(data: bytes) -> Iterator[list[bytes]]:
    """Words, empty strings and line feeds of a folded text, so many bytes at a time, cut between words."""
    begin = 0
    while begin < len(data):
        end = begin + SLICE
        if end < len(data):
            cuts = [c for c in (data.find(b" ", end), data.find(b"\n", end)) if c >= 0]
            end = min(cuts) if cuts else len(data)
        yield data[begin:end].replace(b"\n", b" \n ").split(b" ")
        begin = end


def _tokenise(overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, open_chunks = 0, {}
        base = TaskContext.get().partitionId() << 20       # a task makes fewer chunks than that

        def row(lang: str, chunk: _Chunk) -> pa.RecordBatch:
            nonlocal made
            codes, words, counts = chunk.columns()
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made], pa.int64()), pa.array([lang], pa.string()), pa.array([chunk.lead], pa.int32()),
                 pa.array([codes], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words, pa.binary()).cast(pa.string())),
                 pa.array([squeeze(counts.astype("<i8"))], pa.binary())],
                names=["chunk", "lang", "lead", "codes", "words", "counts"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                lang, data = lang.as_py(), text.as_py()
                if not data:
                    continue
                chunk = open_chunks.setdefault(lang, _Chunk())
                for tokens in slices(data.translate(FOLD)):
                    chunk.put(tokens)
                    if chunk.full():
                        yield row(lang, chunk)
                        chunk = open_chunks[lang] = _Chunk(chunk.tail(overlap))
                chunk.put([b"\n"])
            # languages may be many: all open chunks together stay within the bounds of a few
            while sum(c.n for c in open_chunks.values()) > 2 * TOKENS or sum(c.codes.bytes for c in open_chunks.values()) > 2 * WORD_BYTES:
                lang = max(open_chunks, key=lambda k: open_chunks[k].n + open_chunks[k].codes.bytes)
                yield row(lang, open_chunks.pop(lang))
        for lang, chunk in open_chunks.items():
            yield row(lang, chunk)
    return run


def tile_counts(x: np.ndarray, y: np.ndarray, counted: np.ndarray, tile: int = TILE, dense: int = DENSE):
    """Distinct pairs ``(x, y)``, how many of their occurrences are ``counted``, and for each occurrence the place of its
    pair among the distinct ones. A tile with at least ``tile ** 2 / dense`` occurrences is counted by address."""
    tall, wide = (int(v.max(initial=0)) // tile + 1 for v in (x, y))
    kind = np.int32 if max(tall * wide, tile * tile, len(x)) < 1 << 31 else np.int64       # arrays as long as the chunk stay short
    x, y = x.astype(kind, copy=False), y.astype(kind, copy=False)
    number, place, size = np.unique(x // tile * wide + y // tile, return_inverse=True, return_counts=True)
    number, place = number.astype(np.int64), place.astype(kind)
    cell = (x % tile) * tile + y % tile
    del x, y
    code = np.empty(len(cell), dtype=kind)
    xs, ys, counts, made = [], [], [], 0
    full = size * dense >= tile * tile

    def add(tiles, cells, n):
        nonlocal made
        xs.append(tiles // wide * tile + cells // tile)
        ys.append(tiles % wide * tile + cells % tile)
        counts.append(n)
        made += len(cells)

    for t in np.flatnonzero(full):
        inside = np.flatnonzero(place == t)
        own = cell[inside]
        present = np.bincount(own, minlength=tile * tile) > 0
        cells = np.flatnonzero(present)
        code[inside] = (np.cumsum(present) - 1)[own] + made
        add(np.full(len(cells), number[t]), cells, np.bincount(own[counted[inside]], minlength=tile * tile)[cells])
    rest = np.flatnonzero(~full[place])
    if len(rest):
        # coordinates of the sparse tiles: (tile, cell) sorted, equal ones counted
        order = rest[np.lexsort((cell[rest], place[rest]))]
        del rest
        first = np.zeros(len(order), dtype=bool)
        first[0] = True
        for value in (place, cell):
            value = value[order]
            first[1:] |= value[1:] != value[:-1]
        heads = order[first]
        group = np.cumsum(first, dtype=kind) - 1
        code[order] = group + made
        add(number[place[heads]], cell[heads], np.bincount(group[counted[order]], minlength=len(heads)))
    if not xs:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, code
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(counts), code


def _count_pairs(length: int, last: bool, tile: int, dense: int):
    """Pairs of neighbouring items of a chunk: phrases of ``length`` words. ``known`` has the items that occur often
    enough: their codes, their counts in all texts (for words their numbers tell the rank) and the numbers of their
    words. In the last round the rows of the phrases are given at once, as by :func:`_listed_phrases`: a stage that
    counts and lists would need a second worker process for each task."""
    def run(chunks: pa.Table, known: pa.Table) -> pa.Table:
        out = {k: [] for k in ("chunk", "lead", "codes", "words", "counts")}
        rows: list[pa.RecordBatch] = []
        own_code, f = known.column("code").to_numpy(), known.column("f").to_numpy()
        words = unpack_words([known.column(k).to_numpy() for k in key_names(length - 1)], length - 1)
        ranked = np.lexsort((words[0], -f))
        words = words[:, ranked]
        for chunk, lead, packed in zip(*(chunks.column(c).to_pylist() for c in ("chunk", "lead", "codes"))):
            codes = expand(packed, "<i4")
            rank = np.full(int(codes.max(initial=-1)) + 2, -1, dtype=np.int32)      # the last place is for breaks
            rank[own_code[ranked]] = np.arange(len(ranked), dtype=np.int32)
            items = rank[codes]
            del codes, rank
            first, second = items[:-1], items[1:]
            pairs = np.flatnonzero((first >= 0) & (second >= 0))
            xs, ys, counts, code = tile_counts(first[pairs], second[pairs], pairs + length - 1 >= lead, tile, dense)
            numbers = np.concatenate([words[:, xs], words[-1:, ys]]).astype("<i8", copy=False)
            if last:
                rows += [_phrase_rows(chunk, numbers[:, at:at + ROWS], counts[at:at + ROWS], at) for at in range(0, len(counts), ROWS)]
                continue
            stream = np.full(len(first), BREAK, dtype="<i4")
            stream[pairs] = code
            del items, first, second, pairs, code, xs, ys
            for name, value in zip(out, (chunk, lead, squeeze(stream), squeeze(numbers.ravel()), squeeze(counts.astype("<i8", copy=False)))):
                out[name].append(value)
        if last:
            return pa.Table.from_batches(rows or [_phrase_rows(None, np.zeros((length, 0), np.int64), np.zeros(0, np.int64))])
        return pa.table({k: pa.array(v, {"chunk": pa.int64(), "lead": pa.int32()}.get(k, pa.binary())) for k, v in out.items()})
    return run


def _phrase_rows(chunk: int | None, words: np.ndarray, counts: np.ndarray, begin: int = 0) -> pa.RecordBatch:
    """Rows of a chunk's phrases from the ``begin``-th on; ``place`` is a phrase's code and its count there."""
    place = np.arange(begin, begin + len(counts)) << 32 | counts
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(chunk, pa.int64()), len(counts)), *(pa.array(x, pa.int64()) for x in (place, *pack_words(words)))],
                                      names=["owner", "place", *key_names(len(words))])


def _listed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a chunk."""
    for batch in batches:
        for row in range(batch.num_rows):
            chunk, lang, words, counts = (batch.column(k)[row] for k in range(4))
            words, counts = words.values, expand(counts.as_py(), "<i8")
            for at in range(0, len(words), ROWS):
                part = words.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(chunk, len(part)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.repeat(lang, len(part)),
                     part, pa.array(counts[at:at + ROWS])], names=["owner", "code", "lang", "word", "c"])


def _listed_phrases(length: int):
    """A row for each distinct phrase of a chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = batch.column(0)[row].as_py()
                words, counts = (expand(batch.column(k)[row].as_py(), "<i8") for k in (1, 2))
                words = words.reshape(length, -1)
                for at in range(0, len(counts), ROWS):
                    yield _phrase_rows(chunk, words[:, at:at + ROWS], counts[at:at + ROWS], at)
    return run


def phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10, lang_col: str = "lang", text_col: str = "text",
            tile: int = TILE, dense: int = DENSE) -> list[DataFrame]:
    """For each length up to ``max_words`` the phrases that occur at least ``min_count`` times.

    Columns: ``k0, k1, ...`` (numbers of the words, dense by language and falling frequency, two in a column), ``lang, phrase, last`` (its
    last word), ``f`` (occurrences), ``n`` (words of the language, with repeats), ``pre`` and ``suf`` (occurrences of the
    first 1, 2, ... and of all but the first 1, 2, ... words).
    """
    if max_words < 1 or min_count < 1:
        raise ValueError("max_words and min_count must be at least 1")
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(LANG_UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    chunks = pin(source.mapInArrow(_tokenise(max_words - 1), CHUNKS), "phrase-chunks")
    listed = (chunks.select("chunk", "lang", "words", "counts")
              .mapInArrow(_listed_words, "owner bigint, code int, lang string, word string, c bigint"))
    words = pin(listed.groupBy("lang", "word").agg(F.sum("c").alias("f")).where("f > 0"), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    items = with_row_index(words.where(F.col("f") >= min_count), ["lang", F.desc("f"), "word"], name="k0")
    empty = F.array().cast("array<bigint>")
    items = pin(items.join(totals, "lang")
                .select("k0", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", "n",
                        empty.alias("pre"), empty.alias("suf")), "phrase-items")
    found = [items]
    numbers = pin(items.select("lang", F.col("phrase").alias("word"), "k0"), "phrase-numbers")
    size = numbers.agg(F.sum(F.octet_length("lang") + F.octet_length("word") + 64)).first()[0] or 0
    known = (listed.drop("c").join(F.broadcast(numbers) if size <= BROADCAST_BYTES else numbers, ["lang", "word"])
             .select("owner", "code", F.lit(0).cast("bigint").alias("f"), "k0"))
    for length in range(2, max_words + 1):
        last, keys = length == max_words, key_names(length)
        rows = f"owner bigint, place bigint, {', '.join(f'{k} bigint' for k in keys)}"
        counted = (chunks.select("chunk", "lead", "codes").groupBy("chunk").cogroup(known.groupBy("owner"))
                   .applyInArrow(_count_pairs(length, last, tile, dense), rows if last else PAIR_CHUNKS))
        if last:
            listed = counted
        else:
            chunks = pin(counted, f"phrase-chunks-{length}")
            listed = chunks.select("chunk", "words", "counts").mapInArrow(_listed_phrases(length), rows)
        count = F.col("place").bitwiseAND(0xFFFFFFFF)
        if last:
            often = listed.groupBy(*keys).agg(F.sum(count).alias("f")).where(F.col("f") >= min_count)
        else:
            # one shuffle counts the phrases and keeps the chunks that hold them, of which each has a phrase once
            known = pin(listed.withColumn("f", F.sum(count).over(Window.partitionBy(*keys))).where(F.col("f") >= min_count)
                        .select("owner", F.shiftright("place", 32).cast("int").alias("code"), "f", *keys), f"phrase-known-{length}")
            often = known.groupBy(*keys).agg(F.max("f").alias("f"))
        words = _words(length)
        first, second = _keys(words[:-1]), _keys(words[1:])
        head = items.select(*[F.col(k).alias(f"h{j}") for j, k in enumerate(key_names(length - 1))], "lang", F.col("phrase").alias("head"),
                            F.col("pre").alias("head_pre"), F.col("f").alias("head_f"), "n")
        tail = items.select(*[F.col(k).alias(f"t{j}") for j, k in enumerate(key_names(length - 1))], "last", F.col("suf").alias("tail_suf"),
                            F.col("f").alias("tail_f"))
        often = often.select("*", *[c.alias(f"h{j}") for j, c in enumerate(first)], *[c.alias(f"t{j}") for j, c in enumerate(second)])
        items = pin(often.join(head, [f"h{j}" for j in range(len(first))]).join(tail, [f"t{j}" for j in range(len(second))])
                    .select(*keys, "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", "n",
                            F.concat("head_pre", F.array("head_f")).alias("pre"), F.concat(F.array("tail_f"), "tail_suf").alias("suf")),
                    f"phrase-items-{length}")
        found.append(items)
    return found


def _words(length: int) -> list[Column]:
    """The word numbers of a phrase from its key columns."""
    out = []
    for j in range(length):
        key = F.col(f"k{j // 2}")
        out.append(key if j % 2 == 0 and j + 1 == length else F.shiftright(key, 32) if j % 2 == 0 else key.bitwiseAND(0xFFFFFFFF))
    return out


def _keys(words: list[Column]) -> list[Column]:
    """Key columns of word numbers."""
    return [F.shiftleft(words[j], 32).bitwiseOR(words[j + 1]) if j + 1 < len(words) else words[j] for j in range(0, len(words), 2)]


def best_cut(items: DataFrame) -> DataFrame:
    """``items`` with ``cut``, the lowest (score, place, l, r) of a phrase's cuts, in decimals of 38 digits."""
    score = ("cast(1000000 as decimal(7, 0)) * cast(f as decimal(15, 0)) * cast(f as decimal(15, 0)) "
             "div (cast(u.l as decimal(19, 0)) * cast(u.r as decimal(19, 0)))")
    cuts = F.zip_with("pre", "suf", lambda l, r: F.struct(l.alias("l"), r.alias("r")))
    return (items.withColumn("cuts", cuts)
            .withColumn("cut", F.expr(f"array_min(transform(cuts, (u, k) -> struct({score} as score, k as k, u.l as l, u.r as r)))")))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, share: int = 50, top: int = 2000,
                 lang_col: str = "lang", text_col: str = "text", tile: int = TILE, dense: int = DENSE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` (numbers long): each language's ``top`` phrases of 2 to ``max_words``
    words by score, then occurrences (both descending), then phrase (UTF-8 byte order).

    A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and line ends; words are what blanks and tabs separate. A phrase
    that occurs ``a >= min_count`` times, overlaps included, is cut after each of its words into parts that occur ``l``
    and ``r`` times; the lowest ``floor(1000000 * a * a / (l * r))`` is its score, the first cut of equal ones counts.
    Phrases inside a longer one of at least ``share`` per cent of their occurrences go. Sums and products are exact.
    ``n`` counts the words of the language.

    A null language is ``und`` (with those so named); null and empty texts have no words; repeated rows count as often
    as they come; other columns are ignored whatever their names; an empty table gives an empty one. A text or piece of
    any length is tokenised in slices; chunks overlap by the words that a phrase needs. ``tile`` and ``dense`` change
    the way of counting only.
    """
    if max_words < 2:
        raise ValueError("a phrase has at least two words")
    by_length = phrases(docs, max_words, min_count, lang_col, text_col, tile, dense)
    kept = []
    for k, items in enumerate(by_length[1:], 1):
        if k + 1 < len(by_length):
            # every longer phrase around this one has a phrase of one word more in between that occurs as often
            longer, keys, words = by_length[k + 1], key_names(k + 1), _words(k + 2)
            parts = [longer.select(*[c.alias(n) for n, c in zip(keys, _keys(own))], "f") for own in (words[:-1], words[1:])]
            most = parts[0].unionByName(parts[1]).groupBy(*keys).agg(F.max("f").alias("longest"))
            items = (items.join(most, keys, "left")
                     .where(F.expr(f"longest is null or longest * 100 < f * {int(share)}")))
        kept.append(items.select("lang", "phrase", "f", "n", "pre", "suf"))
    all_kept = kept[0]
    for more in kept[1:]:
        all_kept = all_kept.unionByName(more)
    scored = best_cut(all_kept)
    scored = pin(scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score"), "phrase-scores")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
