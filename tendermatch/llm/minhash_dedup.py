"""Operator 8: near-duplicate texts by BagMinHash signatures.

A text is a multiset of word shingles. Each shingle runs Poisson processes over
its weight axis, cut into blocks (0, 1], (1, 2], (2, 4], ...: a block yields
points in order of time at a rate equal to its length, and a point counts when
its cell lies below the shingle's count. A point falls into one signature
register; the register keeps the earliest. Two texts agree in a register with
the probability of their weighted Jaccard similarity. Points later than a limit
that fills all registers almost surely are never made; texts with an empty
register are run again with twice the limit.

Signatures are banded. Texts with equal multisets are one entry. In each band
bucket the entries are compared with a hub, so that the pairs grow with the
rows and not with their square; buckets in which entries outside of one
component remain get a second hub, and what is still apart then is compared
block by block inside tasks, which return links that join components only.
Every link is verified on whole multisets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermatch.llm.common import held, pin, ship
from tendermatch.llm.graph import components

SHINGLE = 5               # words
THRESHOLD = 0.8           # weighted Jaccard similarity
BANDS, ROWS = 28, 5       # a pair at the threshold is missed with a probability of 1.5e-5
CHUNK_WORDS = 1 << 19     # words hashed at once
MAX_WORDS = 300_000       # words whose hashes a worker remembers
BLOCK = 256               # entries of an open bucket that one task compares with as many others
POSTINGS = 1 << 20        # shared shingles counted at once
MAX_BROADCAST_IDS = 1_000_000

MASK = (1 << 64) - 1
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words met before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def multisets(texts: list[str | None], size: int = SHINGLE, known: _Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, their counts, and where each
    text's begin (n + 1 places). Words are parts between white space, A-Z
    lower-cased; a text of fewer words is a single shingle, one without words has none."""
    known = _Words() if known is None else known
    words = [(t or "").encode("utf-8").lower().split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((h for w in words for h in map(known.__getitem__, w)), dtype=np.uint64, count=int(counts.sum()))
    of = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(flat))       # words up to the text's end, own included
    begins = (left >= size) | (left == np.repeat(counts, counts)) & (np.repeat(counts, counts) < size)
    at = np.flatnonzero(begins)
    value = np.full(len(at), _GOLD)
    for k in range(size):
        here = np.minimum(at + k, len(flat) - 1)
        value = np.where(left[at] > k, mix(value * _M1 + flat[here]), value)
    of = of[at]
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(value)))
    starts = np.searchsorted(of[first], np.arange(len(texts) + 1))
    return value[first], weight, starts


def signatures(value: np.ndarray, weight: np.ndarray, starts: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash registers (times of the earliest points) per text; infinite for texts without shingles."""
    n = len(starts) - 1
    out = np.full((n, registers), np.inf)
    total = np.add.reduceat(np.append(weight, 0), np.minimum(starts[:-1], len(weight)))[:n] * (np.diff(starts) > 0)
    todo = np.flatnonzero(total > 0)
    limit = np.zeros(n)
    limit[todo] = registers * (np.log(registers) + 6) / total[todo]
    while len(todo):
        took = np.zeros(n, dtype=bool)
        took[todo] = True
        texts = np.repeat(np.arange(n), np.diff(starts))
        own = np.flatnonzero(took[texts])
        flat = out.reshape(-1)
        level = 0
        while True:
            low, length = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            element = own[weight[own] > low]
            if not len(element):
                break
            text, top = texts[element], limit[texts[element]]
            state = mix(value[element] + np.uint64((level + 1) * int(_GOLD) & MASK))
            room = weight[element] - low
            time = np.zeros(len(element))
            while len(element):
                state = state + _GOLD
                draw = mix(state)
                time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) / 9007199254740993.0) / length
                alive = time <= top
                if not alive.all():
                    element, text, top, state, room, time, draw = (x[alive] for x in (element, text, top, state, room, time, draw))
                second = mix(draw ^ _M2)
                register = ((second & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
                if length == 1:
                    np.minimum.at(flat, text * registers + register, time)
                else:
                    cell = ((second >> np.uint64(32)) * np.uint64(length) >> np.uint64(32)).astype(np.int64)
                    counted = cell < room
                    np.minimum.at(flat, text[counted] * registers + register[counted], time[counted])
            level += 1
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        limit[todo] *= 2
        out[todo] = np.inf
    return out


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band."""
    bits = registers.view(np.uint64).reshape(len(registers), bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD + np.zeros((len(registers), 1), dtype=np.uint64)
    for k in range(bits.shape[2]):
        key = mix(key ^ bits[:, :, k]) + _GOLD
    return key.view(np.int64)


def jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets with sorted hashes."""
    at = np.searchsorted(b, a)
    hit = at < len(b)
    hit[hit] = b[at[hit]] == a[hit]
    both = int(np.minimum(wa[hit], wb[at[hit]]).sum())
    return both / (int(wa.sum()) + int(wb.sum()) - both)


class _Postings:
    """Of each shingle, the multisets that hold it and its counts there."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(sets)
        value = np.concatenate([np.zeros(0, np.uint64), *[v for v, _ in sets]])
        order = np.argsort(value, kind="stable")
        self.value, first = np.unique(value[order], return_index=True)
        self.ends = np.append(first, len(value))
        self.of = np.repeat(np.arange(self.n), [len(v) for v, _ in sets])[order]
        self.weight = np.concatenate([np.zeros(0, np.int64), *[w for _, w in sets]])[order]

    def shared(self, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How many shingles a multiset shares with each of the others."""
        both, step = np.zeros(self.n), max(1, POSTINGS // max(1, self.n))
        for k in range(0, len(value) if len(self.value) else 0, step):          # parts, for memory
            at = np.minimum(np.searchsorted(self.value, value[k:k + step]), len(self.value) - 1)
            hit = self.value[at] == value[k:k + step]
            at, own = at[hit], weight[k:k + step][hit]
            count = self.ends[at + 1] - self.ends[at]
            place = np.arange(count.sum()) + np.repeat(self.ends[at] - np.cumsum(count) + count, count)
            both += np.bincount(self.of[place], np.minimum(self.weight[place], np.repeat(own, count)), self.n)
        return both


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Parts of a batch with a bounded number of bytes (a longer text is a part of its own)."""
    part, begin, size = [], 0, 0
    for k, text in enumerate(texts):
        text = text.as_py()
        if part and size + len(text or "") > 6 * CHUNK_WORDS:
            yield begin, part
            part, begin, size = [], k, 0
        part.append(text)
        size += len(text or "")
    if part:
        yield begin, part


def _identity(id_col: str) -> Column:
    return F.col(f"`{id_col}`").cast("bigint").alias("did")


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``did, m1, m2, size, bands``: hash of the multiset, number of shingles and band keys per row."""
    store = ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _chunks(batch.column(1)):
                value, weight, starts = multisets(texts, shingle, held(store, _Words))
                keys = band_keys(signatures(value, weight, starts))
                digest = [xxhash.xxh3_128_digest(value[a:b].tobytes() + weight[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]
                halves = np.frombuffer(b"".join(digest), dtype="<i8").reshape(-1, 2)
                size = np.add.reduceat(np.append(weight, 0), np.minimum(starts[:-1], len(weight)))[:len(texts)] * (np.diff(starts) > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                     pa.array(size.astype(np.int64)),
                     pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.reshape(-1)))],
                    names=["did", "m1", "m2", "size", "bands"])

    return docs.select(_identity(id_col), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, "did bigint, m1 bigint, m2 bigint, size bigint, bands array<bigint>")


def _with_multisets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``did, m1, m2, value, weight`` of the wanted entries (did, m1, m2)."""
    store = ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _chunks(batch.column(1)):
                value, weight, starts = multisets(texts, shingle, held(store, _Words))
                digest = [xxhash.xxh3_128_digest(value[a:b].tobytes() + weight[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]
                halves = np.frombuffer(b"".join(digest), dtype="<i8").reshape(-1, 2)
                ends = pa.array(starts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                     pa.ListArray.from_arrays(ends, pa.array(value.view(np.int64))),
                     pa.ListArray.from_arrays(ends, pa.array(weight.astype(np.int32)))], names=["did", "m1", "m2", "value", "weight"])

    ids = wanted.select("did").distinct()
    if wanted.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(_identity(id_col), F.col(f"`{text_col}`").alias("text")).join(ids, "did", "left_semi")
    sets = rows.mapInArrow(run, "did bigint, m1 bigint, m2 bigint, value array<bigint>, weight array<int>")
    return sets.join(wanted.select("did", "m1", "m2").distinct(), ["did", "m1", "m2"], "left_semi").dropDuplicates(["did", "m1", "m2"])


def _sets(frame: pd.DataFrame, tail: str = "") -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(v, dtype=np.int64).view(np.uint64), np.asarray(w, dtype=np.int64))
            for v, w in zip(frame["value" + tail], frame["weight" + tail])]


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of entries whose similarity reaches the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            good = [jaccard(*p, *q) >= threshold for p, q in zip(_sets(frame, "_a"), _sets(frame, "_b"))]
            yield frame.loc[np.array(good, dtype=bool), ["a", "b"]]

    side = lambda s: sets.select(F.col("did").alias(s), F.col("value").alias(f"value_{s}"), F.col("weight").alias(f"weight_{s}"))
    return (pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "value_a", "weight_a", "value_b", "weight_b")
            .mapInPandas(run, "a bigint, b bigint"))


def _apart(members: DataFrame) -> DataFrame:
    """Keys of buckets that hold entries of more than one component."""
    return members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")


def _blockwise(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between different components inside open buckets: block against block, one task for each pair of blocks."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("did"), F.col("blocks")).cast("int"))
    placed = (placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumns({"one": F.least("block", "with"), "other": F.greatest("block", "with")})
              .join(sets.select("did", "value", "weight"), "did"))

    def task(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        _, one, other = (int(x) for x in key)
        sets_here, ids = _sets(own), own["did"].to_numpy()
        block = own["block"].to_numpy()
        size = np.array([w.sum() for _, w in sets_here])
        comp = own["comp"].to_numpy().copy()
        found = []
        left = np.flatnonzero(block == one)
        right = np.flatnonzero(block == other)
        postings = _Postings([sets_here[j] for j in right])
        for i in left:
            near = (comp[right] != comp[i]) & (np.minimum(size[right], size[i]) >= threshold * np.maximum(size[right], size[i]))
            if one == other:
                near &= right > i
            if not near.any():
                continue
            both = postings.shared(*sets_here[i])
            for j in right[near & (both / (size[i] + size[right] - both) >= threshold)]:
                if comp[j] != comp[i]:
                    found.append((ids[i], ids[j]))
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return (placed.select("key", "one", "other", "block", "did", "comp", "value", "weight")
            .groupBy("key", "one", "other").applyInPandas(task, "a bigint, b bigint"))


def _components_of(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` with ``comp``, the component of each ``did`` (itself where no link touches it)."""
    return (rows.join(named.withColumnRenamed("node", "did"), "did", "left")
            .withColumn("comp", F.coalesce("component", "did")).drop("component"))


def links_between(entries: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """Component of every entry that a verified link touches (``node, component``)."""
    buckets = (entries.select("did", F.posexplode("bands").alias("band", "k"))
               .select("did", F.xxhash64("band", "k").alias("key")))
    shared = buckets.groupBy("key").agg(F.min("did").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = pin(buckets.join(pin(shared, "minhash-shared"), "key"), "minhash-members")
    met = members.select("did").distinct()
    sets = pin(_with_multisets(docs, entries.join(met, "did", "left_semi"), id_col, text_col, shingle)
               .select("did", "value", "weight"), "minhash-sets")

    pairs = members.where("did <> hub").select(F.col("hub").alias("a"), F.col("did").alias("b")).distinct()
    links = pin(_verify(pairs, sets, threshold), "minhash-links")
    named = components(links)

    # buckets with three or more entries may hold links that do not touch the hub
    rest = pin(_components_of(members.where("n > 2 and did <> hub").select("key", "did"), named), "minhash-rest")
    opened = pin(rest.join(_apart(rest), "key", "left_semi"), "minhash-open")
    if opened.isEmpty():
        return named
    second = pin(opened.groupBy("key").agg(F.min(F.struct(F.xxhash64("did").alias("rank"), "did", "comp")).alias("hub")),
                 "minhash-hubs")
    again = opened.join(second, "key").where("did <> hub.did")
    pairs = again.where("comp <> hub.comp").select(F.col("hub.did").alias("a"), F.col("did").alias("b")).distinct()
    links = links.unionByName(pin(_verify(pairs, sets, threshold), "minhash-links"))
    named = components(links)
    rest = pin(_components_of(again.select("key", "did"), named), "minhash-rest")
    opened = pin(rest.join(_apart(rest), "key", "left_semi"), "minhash-open")
    if opened.isEmpty():
        return named
    return components(links.unionByName(pin(_blockwise(opened, sets, threshold), "minhash-links")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
            threshold: float = THRESHOLD) -> DataFrame:
    """``<id_col> long, class_id, class_size, kept`` for every row of ``docs``.

    A class is a connected component of the links between rows whose shingle
    multisets have a weighted Jaccard similarity of at least ``threshold``; its
    id is the smallest document id in it, and that document is kept. Rows that
    share an id are one document, but of its rows with equal multisets one is
    kept. Texts without words (null, empty, white space) and rows with a null
    id are classes of their own and kept. Other columns are left out; an empty
    table gives an empty one.
    """
    drawn = pin(sketch(docs, id_col, text_col, shingle), "minhash-sketch")
    part = F.expr("size > 0 and did is not null")
    # rows with equal multisets are one entry, named by their smallest id
    entries = pin(drawn.where(part).groupBy("m1", "m2").agg(F.min("did").alias("did"), F.count("*").alias("rows"),
                                                            F.first("bands").alias("bands")), "minhash-entries")
    named = links_between(entries, docs, id_col, text_col, shingle, threshold)
    of = pin(_components_of(entries.select("m1", "m2", "did", "rows"), named), "minhash-of")
    sizes = of.groupBy("comp").agg(F.sum("rows").alias("class_size"))
    table = pin(of.join(sizes, "comp").select("m1", "m2", F.col("comp").alias("class_id"), "class_size"), "minhash-classes")

    counted = pin(drawn.where(part).groupBy("did", "m1", "m2").agg(F.count("*").alias("rows")), "minhash-rows")
    grouped = (counted.join(table, ["m1", "m2"])
               .select("did", "class_id", "class_size", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows")).alias("nth"))
               .select(F.col("did").alias(id_col), "class_id", "class_size",
                       ((F.col("did") == F.col("class_id")) & (F.col("nth") == 1)).alias("kept")))
    alone = drawn.where("size = 0 or did is null").select(F.col("did").alias(id_col), F.col("did").alias("class_id"),
                                                          F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the documents that :func:`classes` keeps; all columns stay."""
    found = pin(classes(docs, id_col, text_col, shingle, threshold), "minhash-found").withColumnRenamed(id_col, "did")
    # the rows travel as one column, so that no name of theirs meets one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(f"`{id_col}`").cast("bigint").alias("did"))
    gone = found.where("not kept and did <> class_id").select("did").distinct()
    if gone.count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    rows = rows.join(gone, "did", "left_anti")
    # documents in several rows of one multiset: found by id, thinned by text
    again = found.where("not kept and did = class_id").select("did").distinct()
    if again.isEmpty():
        return rows.select("own.*")

    @F.pandas_udf("binary")
    def multiset(texts: pd.Series) -> pd.Series:
        value, weight, starts = multisets(texts.tolist(), shingle)
        return pd.Series([xxhash.xxh3_128_digest(value[a:b].tobytes() + weight[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])],
                         dtype=object)

    thin = rows.join(again, "did", "left_semi").withColumn("multiset", multiset(F.col(f"own.`{text_col}`"))).dropDuplicates(["did", "multiset"])
    return rows.join(again, "did", "left_anti").select("own").unionByName(thin.select("own")).select("own.*")
