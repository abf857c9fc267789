"""Operator 13: ranked lexical search by a dual tree.

Documents and items each form a hierarchy. A document node holds, term by
term, the largest contribution of any document below it; an item node holds
the largest weight of each term in any item below it. The sum over the terms
of their products is at least the score of every (item, document) below the
two nodes, so a pair of nodes whose bound is below the weakest kth score of
the node's items is pruned with all that hangs from it, and the result stays
exact. The descent goes down both hierarchies at once; documents that are
reached are scored in 64-bit integers.

The tables are prepared by Spark: documents are tokenised once, into blocks of
a bounded number of documents and postings that keep only the terms of the
items; counts of documents and terms are aggregates over all blocks. Items are
taken in groups of a bounded number of terms, one pass over the blocks each.
A first pass over a bounded number of blocks gives every item some scores
that the rest has to beat; then each task searches its blocks and returns, for
each item, its best documents at most, of which a window keeps the best of all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendermatch.llm.common import held, pin, ship

BLOCK_DOCS = 4096            # documents of a block
BLOCK_POSTINGS = 1 << 20     # postings after which a block is closed
GROUP_TERMS = 1 << 19        # terms of the items that go through the blocks together
LEAF = 16                    # documents of a leaf
FAN = 4                      # children of a node
SEED_BLOCKS = 8              # blocks of the first pass: the first one of each of so many tasks
SLICE = 1 << 22              # bytes of a text that are tokenised at a time

#: ASCII letters lower-cased, ASCII digits kept, other ASCII to blanks; the rest belongs to terms. Fixed values.
FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
             for c in range(256))
BLOCKS = ("task int, nth int, ids array<bigint>, sizes array<bigint>, starts array<int>, terms array<int>, tfs array<int>, "
          "df_terms array<int>, dfs array<int>")
NO_ID = (1 << 63) - 1        # stands for a null document id: last among equal scores


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, so many bytes of it at a time."""
    data, begin = data.translate(FOLD), 0
    while begin < len(data):
        end = data.find(b" ", begin + SLICE)
        end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            own = sorted({t for part in terms_of(text.as_py() or b"") for t in part})
            yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([own], pa.list_(pa.binary()))],
                                             names=["row", "terms"])


def _numbered(terms: list[bytes]) -> dict[bytes, int]:
    return {t: k for k, t in enumerate(terms)}


def _blocks(shared):
    """Blocks of documents with their postings of known terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, task, made = held(shared, _numbered).get, TaskContext.get().partitionId(), 0
        ids, sizes, starts, terms, tfs = [], [], [0], [], []

        def block() -> pa.RecordBatch:
            nonlocal made
            own = np.concatenate(terms)
            seen, df = np.unique(own, return_counts=True)
            arrays = [(ids, pa.int64()), (sizes, pa.int64()), (starts, pa.int32()), (own, pa.int32()), (np.concatenate(tfs), pa.int32()),
                      (seen, pa.int32()), (df, pa.int32())]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([made - 1], pa.int32()),
                                               *[pa.array([a], pa.list_(t)) for a, t in arrays]],
                                              names=["task", "nth", "ids", "sizes", "starts", "terms", "tfs", "df_terms", "dfs"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                size, found = 0, [np.zeros(0, dtype=np.int32)]
                for part in terms_of(text.as_py() or b""):
                    size += len(part)
                    found.append(np.fromiter(map(get, part, repeat(-1)), dtype=np.int32, count=len(part)))
                if not size:
                    continue                     # no term: neither counted nor found
                own, tf = np.unique(np.concatenate(found), return_counts=True)
                known = own >= 0
                ids.append(NO_ID if doc_id is None else doc_id)
                sizes.append(size)
                terms.append(own[known])
                tfs.append(tf[known])
                starts.append(starts[-1] + int(known.sum()))
                if len(ids) >= BLOCK_DOCS or starts[-1] >= BLOCK_POSTINGS:
                    yield block()
                    ids, sizes, starts, terms, tfs = [], [], [0], [], []
        if ids:
            yield block()
    return run


def _spans(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of some rows, one row after the other, and where each row begins among them."""
    size = starts[rows + 1] - starts[rows]
    begin = np.cumsum(size) - size
    return np.repeat(starts[rows] - begin, size) + np.arange(int(size.sum())), begin


class Level:
    """The nodes of one height: node k has the terms ``terms[starts[k]:starts[k + 1]]`` with their maxima."""

    def __init__(self, node: np.ndarray, term: np.ndarray, value: np.ndarray, n: int):
        order = np.lexsort((term, node))
        node, term, value = node[order], term[order], value[order]
        first = np.ones(len(node), dtype=bool)
        first[1:] = (node[1:] != node[:-1]) | (term[1:] != term[:-1])
        at = np.flatnonzero(first)
        self.n, self.node, self.terms = n, node[at], term[at]
        self.values = np.maximum.reduceat(value, at) if len(at) else value
        self.starts = np.searchsorted(self.node, np.arange(n + 1))

    def above(self, fan: int) -> Level:
        return Level(self.node // fan, self.terms, self.values, -(-self.n // fan))


def hierarchy(node: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, fan: int) -> list[Level]:
    """Levels from the bottom up to a single node."""
    levels = [Level(node, term, value, n)]
    while levels[-1].n > 1:
        levels.append(levels[-1].above(fan))
    return levels


class Search:
    """The items' hierarchy with the best documents of each item so far."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, floor: np.ndarray, top: int,
                 leaf: int = LEAF, fan: int = FAN):
        """``starts, terms``: terms of the items; ``weights``: of every term; ``floor``: scores that an item's
        documents have to reach."""
        self.weights, self.n_docs, self.n_terms, self.top, self.leaf, self.fan = weights, n_docs, n_terms, top, leaf, fan
        n = len(starts) - 1
        item = np.repeat(np.arange(n), np.diff(starts))
        # items with the same heaviest term stand side by side
        heaviest = np.zeros(n, dtype=np.int64)
        np.maximum.at(heaviest, item, weights[terms] << 32 | terms)
        self.order = np.argsort(heaviest, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[self.order] = np.arange(n)
        self.levels = hierarchy(place[item], terms, weights[terms], n, fan)
        self.floor = floor[self.order].astype(np.int64)
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.lut = np.zeros(len(weights), dtype=np.int64)
        self.pairs = 0                           # (item, document) scored
        self._weakest()

    def _weakest(self) -> None:
        """Weakest kth score of each item node, level by level."""
        self.least = [self.floor]
        for level in self.levels[1:]:
            self.least.append(np.minimum.reduceat(self.least[-1], np.arange(0, len(self.least[-1]), self.fan)))

    def _sums(self, height: int, nodes: np.ndarray) -> np.ndarray:
        """Sum over the terms of each item node of its weight times what ``lut`` has."""
        level = self.levels[height]
        if len(nodes) == level.n:
            at, begin = slice(None), level.starts[:-1]
        else:
            at, begin = _spans(level.starts, nodes)
        product = level.values[at] * self.lut[level.terms[at]]
        running = np.concatenate([[0], np.cumsum(product)])
        return running[begin + (level.starts[nodes + 1] - level.starts[nodes])] - running[begin]

    def block(self, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Search the documents of a block."""
        if not len(terms):
            return
        if 50 * int(sizes.max()) * self.n_docs < 1 << 63:
            m = 50 + 50 * sizes * self.n_docs // self.n_terms
        else:
            m = np.array([50 + 50 * int(x) * self.n_docs // self.n_terms for x in sizes])
        doc = np.repeat(np.arange(len(ids)), np.diff(starts))
        gain = 1_000_000_000 * tfs // (1000 * tfs + 20 * m[doc])
        heaviest = np.zeros(len(ids), dtype=np.int64)
        np.maximum.at(heaviest, doc, self.weights[terms] << 32 | terms)
        order = np.argsort(heaviest, kind="stable")
        order = order[np.diff(starts)[order] > 0]
        place = np.full(len(ids), -1)
        place[order] = np.arange(len(order))
        self.ids = ids[order]
        self.docs = Level(place[doc], terms, gain, len(order))
        nodes = hierarchy(self.docs.node // self.leaf, self.docs.terms, self.docs.values, -(-len(order) // self.leaf), self.fan)
        top = len(self.levels) - 1
        open_pairs = [(len(nodes) - 1, 0, top, np.arange(self.levels[top].n))]
        while open_pairs:
            height, node, item_height, items = open_pairs.pop()
            item_height, items = self._open(nodes[height], node, item_height, items, height == 0)
            if not len(items):
                continue
            if height:
                children = range(node * self.fan, min((node + 1) * self.fan, nodes[height - 1].n))
                open_pairs += [(height - 1, child, item_height, items) for child in children]
            else:
                self._score(range(node * self.leaf, min((node + 1) * self.leaf, self.docs.n)), items)

    def _open(self, docs: Level, node: int, height: int, items: np.ndarray, to_items: bool) -> tuple[int, np.ndarray]:
        """Item nodes that the bound with a document node leaves, opened by one level (or down to the items)."""
        span = slice(docs.starts[node], docs.starts[node + 1])
        self.lut[docs.terms[span]] = docs.values[span]
        while True:
            bound = self._sums(height, items)
            items = items[(bound > 0) & (bound >= self.least[height][items])]
            if not height or not len(items):
                break
            height -= 1
            items = (items[:, None] * self.fan + np.arange(self.fan)).ravel()
            items = items[items < self.levels[height].n]
            if not to_items:
                break
        self.lut[docs.terms[span]] = 0
        return height, items

    def _score(self, docs: range, items: np.ndarray) -> None:
        changed = False
        for doc in docs:
            span = slice(self.docs.starts[doc], self.docs.starts[doc + 1])
            self.lut[self.docs.terms[span]] = self.docs.values[span]
            scores = self._sums(0, items)
            self.lut[self.docs.terms[span]] = 0
            self.pairs += len(items)
            good = np.flatnonzero((scores > 0) & (scores >= self.floor[items]))
            for item, score in zip(items[good].tolist(), scores[good].tolist()):
                best, entry = self.best[item], (score, -int(self.ids[doc]))
                if len(best) < self.top:
                    heapq.heappush(best, entry)
                else:
                    heapq.heappushpop(best, entry)
                if len(best) == self.top and best[0][0] > self.floor[item]:
                    self.floor[item], changed = best[0][0], True
        if changed:
            self._weakest()

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, document and score of what was kept."""
        rows = [(int(self.order[k]), -doc, score) for k, best in enumerate(self.best) for score, doc in best]
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        return table[:, 0], table[:, 1], table[:, 2]


def _search(shared, top: int, leaf: int, fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*held(shared, lambda *x: x), top, leaf, fan)
        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for row in range(batch.num_rows):
                search.block(*(c[row].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
        item, doc, score = search.found()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc), pa.array(score)], names=["item", "doc", "score"])
    return run


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_group(docs: DataFrame, items: list[tuple[int, list[bytes]]], top: int, leaf: int, fan: int) -> DataFrame:
    """``row, rank, doc, score`` of a group of items; all documents are read once for it."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, own in items for t in own})
    number = _numbered(vocabulary)
    blocks = pin(docs.mapInArrow(_blocks(ship(spark, vocabulary)), BLOCKS), "search-blocks")
    n_docs, n_terms = blocks.agg(F.sum(F.size("ids")), F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()
    found_in = dict(blocks.select(F.explode(F.arrays_zip("df_terms", "dfs")).alias("own"))     # a row for each term of the group at most
                    .groupBy(F.col("own.df_terms").alias("term")).agg(F.sum("own.dfs").alias("df")).toLocalIterator())
    weights = np.zeros(max(1, len(vocabulary)), dtype=np.int64)
    for term, df in found_in.items():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    own = [[number[t] for t in terms if number[t] in found_in] for _, terms in items]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    terms = np.array([t for x in own for t in x], dtype=np.int64)

    def search(some: DataFrame, floor: np.ndarray) -> DataFrame:
        shared = ship(spark, starts, terms, weights, int(n_docs or 0), int(n_terms or 1), floor)
        return _best(some.select("ids", "sizes", "starts", "terms", "tfs")
                     .mapInArrow(_search(shared, top, leaf, fan), "item bigint, doc bigint, score bigint"), top)

    floor = np.zeros(len(items), dtype=np.int64)
    for r in search(blocks.where((F.col("nth") == 0) & (F.col("task") < SEED_BLOCKS)), floor).where(F.col("rank") == top).collect():     # a row for each item at most
        floor[r.item] = r.score
    rows = spark.createDataFrame([(k, row) for k, (row, _) in enumerate(items)], "item bigint, row bigint")
    return pin(search(blocks, floor).join(rows, "item").select("row", "rank", "doc", "score"), "search-found")


def search(items: DataFrame, docs: DataFrame, top: int = 50, item_id: str = "item_id", item_text: str = "text",
           doc_id: str = "doc_id", doc_text: str = "text", group_terms: int = GROUP_TERMS, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """``item_id, rank int, doc_id, score long``: each item's ``top`` documents of the highest scores above 0, equal
    scores by ascending document id.

    Terms are stretches of ASCII letters and digits and of any character beyond ASCII, A-Z lower-cased. A document of n
    terms gets, for each distinct term of the item that it holds tf times, ``w * (10**9 * tf div (1000 * tf + 20 * m))``
    with ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and ``m = 50 + 50 * n * N div L``; N, L and df are taken
    over all documents with a term.

    Every row of ``items`` is an item and every row of ``docs`` a document of its own, also where ids repeat or are
    null; null document ids come last among equal scores. Null and empty texts have no terms: such an item has no rows.
    Texts are read whole, in slices; empty tables give an empty result; other columns are ignored. Items go through the
    documents in groups of up to ``group_terms`` terms (at least one item); ``leaf`` and ``fan`` shape the hierarchies
    only.
    """
    spark = docs.sparkSession
    numbered = pin(items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("id"), F.col(item_text).alias("text")),
                   "search-items")
    texts = docs.select(F.col(doc_id).cast("bigint"), F.col(doc_text))
    results, group, size = [], [], 0
    split = pin(numbered.select("row", "text").mapInArrow(_item_terms, "row bigint, terms array<binary>"), "search-terms")
    for r in split.toLocalIterator():
        own = [bytes(t) for t in r.terms]
        if group and size + len(own) > group_terms:
            results.append(_search_group(texts, group, top, leaf, fan))
            group, size = [], 0
        if own:
            group.append((r.row, own))
            size += len(own)
    if group:
        results.append(_search_group(texts, group, top, leaf, fan))
    if not results:
        results.append(spark.createDataFrame([], "row bigint, rank int, doc bigint, score bigint"))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    doc = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return (found.join(numbered.select("row", "id"), "row")
            .select(F.col("id").alias(item_id), "rank", doc.alias(doc_id), "score"))
