"""Top-k retrieval over a whole corpus (B14): every query row against every item row.

All pairs are never rows. Items are packed into blocks of similar vectors and
similar length: the cell of the nearest of a few pivots, then by falling norm.
A block knows its centre c, its radius r (largest distance from c) and its
largest norm m, so for any query q

    q . x  <=  min(q . c + |q| r, |q| m)      for every x of the block.

Each query first visits the block of its highest bound. The weakest of the k
scores it finds there is a floor; it then visits only the blocks whose bound
reaches the floor. A visit is a join of packed queries with a packed block and
one matrix product; k rows per visit leave it, and a window keeps the k best
of a query's visits. The result is exact whatever the bounds prune.

Equal vectors have equal scores with whatever query: of the items of one vector
only the k first can be among a query's k best, so blocks hold no more of them,
and equal queries are answered once. Packs are dealt evenly before their visits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendermatch.functions.vectors import all_finite
from tendermatch.operators.ranking import with_row_index
from tendermatch.session import materialize

BLOCK_ROWS = 4096        # items of a block
MAX_BLOCKS = 1 << 16     # blocks grow beyond BLOCK_ROWS items when there would be more; bounds the broadcast of their centres
PACK_ROWS = 4096         # queries of a pack
PIVOTS = 64
HELD_ROWS = 1 << 16      # (query, block) visits a task collects before it hands on its packs


def ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of ``a`` and ``b``, summed dimension by dimension: equal rows give equal results wherever
    they stand, which a matrix product does not promise."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def rounding(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of ``a``, more than the rounding error of its products with the rows of ``b``, summed in any order."""
    longest = np.linalg.norm(b, axis=1).max(initial=0.0)
    return 1e-15 * (a.shape[1] + 1) * np.linalg.norm(a, axis=1) * longest


def _matrix(column: pa.Array) -> np.ndarray:
    """An array column without nulls as a float64 matrix."""
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and len(values) % n or n and (np.diff(column.offsets.to_numpy()) != len(values) // n).any():
        raise ValueError("vectors differ in width")
    return values.reshape(n, -1)


def _nearest(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            cell = np.argmax(x @ pivots.T - (pivots ** 2).sum(axis=1) / 2, axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)),
                                              pa.array(np.linalg.norm(x, axis=1))], names=["iid", "vec", "cell", "norm"])
    return run


def _pack_block(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    x = _matrix(table.column("vec").chunk(0))
    centre = x.mean(axis=0)
    return pa.table({"block": table.column("block")[:1], "ids": [table.column("iid").to_numpy().astype("<i8").tobytes()],
                     "vectors": [x.tobytes()], "centre": [centre.tobytes()],
                     "radius": [float(np.linalg.norm(x - centre, axis=1).max())], "top_norm": [float(np.linalg.norm(x, axis=1).max())]})


def _blocks(items: DataFrame, block_rows: int, pivots: int) -> DataFrame:
    """``block, ids, vectors, centre, radius, top_norm``: a row for each block of items (``iid, vec``)."""
    sample = items.orderBy(F.xxhash64("iid"), "iid").limit(pivots).collect()
    if not sample:
        return items.sparkSession.createDataFrame([], "block bigint, ids binary, vectors binary, centre binary, radius double, top_norm double")
    table = np.array([r.vec for r in sample], dtype=np.float64)
    celled = items.mapInArrow(_nearest(table), "iid bigint, vec array<double>, cell int, norm double")
    placed = with_row_index(celled, [F.desc("norm"), "iid"], group_by=["cell"], name="place")
    rows = max(block_rows, -(-items.count() // MAX_BLOCKS))
    block = (F.col("cell").cast("bigint") * (1 << 32) + F.floor(F.col("place") / rows)).cast("bigint")
    return (placed.select(block.alias("block"), "iid", "vec").groupBy("block")
            .applyInArrow(_pack_block, "block bigint, ids binary, vectors binary, centre binary, radius double, top_norm double"))


def _route(shared, first: bool, pack_rows: int):
    """Packs of the queries (``qid, vec, floor``) for the blocks that they visit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres, radius, top_norm = shared.value
        held: dict[int, list] = {}
        n_held = 0

        def packs() -> Iterator[pa.RecordBatch]:
            for b, parts in held.items():
                qid, q, floor = (np.concatenate([p[k] for p in parts]) for k in range(3))
                for at in range(0, len(qid), pack_rows):
                    some = slice(at, at + pack_rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(names[b])], pa.int64()),
                         *[pa.array([x[some].tobytes()], pa.binary()) for x in (qid, q, floor)]], names=["block", "qids", "queries", "floors"])

        for batch in batches:
            qid, q, floor = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy()
            if len(q) and q.shape[1] != centres.shape[1]:
                raise ValueError(f"queries of width {q.shape[1]}, items of width {centres.shape[1]}")
            step = max(1, (1 << 22) // len(names))
            for at in range(0, len(qid), step):
                some = slice(at, at + step)
                length = np.linalg.norm(q[some], axis=1)[:, None]
                bound = np.minimum(q[some] @ centres.T + length * radius, length * top_norm)
                best = bound.argmax(axis=1)
                if first:
                    rows, blocks = np.arange(len(best)), best
                else:
                    slack = 1e-14 * (q.shape[1] + 1) * length * top_norm.max()
                    reach = bound + slack >= floor[some][:, None]
                    reach[np.arange(len(best)), best] = False
                    rows, blocks = np.nonzero(reach)
                order = np.argsort(blocks, kind="stable")
                rows, blocks = rows[order], blocks[order]
                cuts = np.flatnonzero(np.diff(blocks)) + 1
                for part in np.split(np.arange(len(rows)), cuts) if len(rows) else []:
                    own = rows[part] + at
                    held.setdefault(int(blocks[part[0]]), []).append((qid[own], q[own], floor[own]))
                    n_held += len(own)
                if n_held >= HELD_ROWS:
                    yield from packs()
                    held, n_held = {}, 0
        yield from packs()
    return run


def _visit(k: int):
    """The best ``k`` items of the block for each query of a pack."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qid, ids = (np.frombuffer(batch.column(c)[row].as_py(), dtype="<i8") for c in ("qids", "ids"))
                q, floor, x = (np.frombuffer(batch.column(c)[row].as_py(), dtype=np.float64) for c in ("queries", "floors", "vectors"))
                q, x = q.reshape(len(qid), -1), x.reshape(len(ids), -1)
                step, slack = max(1, (1 << 20) // len(ids)), rounding(q, x)
                for at in range(0, len(qid), step):
                    near = q[at:at + step] @ x.T
                    least = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(near), -np.inf)
                    least = np.maximum(least, floor[at:at + step])
                    with np.errstate(invalid="ignore"):
                        own, col = np.nonzero(near >= (least - 2 * slack[at:at + step])[:, None])
                    score = ordered_dot(q[at + own], x[col])
                    order = np.lexsort((ids[col], -score, own))
                    own, col, score = own[order], col[order], score[order]
                    rank = np.arange(len(own)) - np.searchsorted(own, own)
                    keep = rank < k
                    yield pa.RecordBatch.from_arrays([pa.array(qid[at + own[keep]]), pa.array(ids[col[keep]]), pa.array(score[keep])],
                                                     names=["qid", "iid", "score"])
    return run


def corpus_topk(queries: DataFrame, items: DataFrame, query_keys: Sequence[str], item_keys: Sequence[str], query_vec: str, item_vec: str,
                k: int, block_rows: int = BLOCK_ROWS, pack_rows: int = PACK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """``query_keys, item_keys, rank, score``: the ``k`` items of the highest inner product for every query, equal scores
    by ``item_keys``.

    Key names of the two sides must differ. Vectors that are null or hold a null or a value that is not finite take no
    part; all others must have one width. Repeated keys are rows of their own. A query has fewer than ``k`` rows only if
    the corpus has fewer items.
    """
    if set(query_keys) & set(item_keys):
        raise ValueError("queries and items need key columns of different names")
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = queries.sparkSession

    def vectors(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
        # a null vector is not all_finite: the test is null there
        return df.select(*keys, F.col(vec).cast("array<double>").alias("vec")).where(all_finite("vec") & (F.size("vec") > 0))

    q = materialize(vectors(queries, query_keys, query_vec))
    asked = materialize(q.select("vec").distinct().withColumn("qid", F.monotonically_increasing_id()))
    i = materialize(with_row_index(vectors(items, item_keys, item_vec), list(item_keys), name="iid"))
    copy = F.row_number().over(Window.partitionBy("vec").orderBy("iid"))
    blocks = materialize(_blocks(materialize(i.select("iid", "vec", copy.alias("copy")).where(F.col("copy") <= k).drop("copy")), block_rows, pivots))
    summary = blocks.select("block", "centre", "radius", "top_norm").orderBy("block").collect()      # at most MAX_BLOCKS and one a pivot
    found_schema = "qid bigint, iid bigint, score double"
    if summary:
        shared = spark.sparkContext.broadcast((
            np.array([r.block for r in summary]), np.stack([np.frombuffer(r.centre) for r in summary]),
            np.array([r.radius for r in summary]), np.array([r.top_norm for r in summary])))
        packed = blocks.select("block", "ids", "vectors")

        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def visits(some: DataFrame, first: bool) -> DataFrame:
            packs = some.mapInArrow(_route(shared, first, pack_rows), "block bigint, qids binary, queries binary, floors binary")
            return packs.repartition(tasks).join(packed, "block").mapInArrow(_visit(k), found_schema)

        start = materialize(visits(asked.select("qid", "vec", F.lit(float("-inf")).alias("floor")), True))
        floors = start.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
        more = visits(asked.join(floors, "qid").select("qid", "vec", "floor"), False)
        found = start.unionByName(more)
    else:
        found = spark.createDataFrame([], found_schema)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "iid")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = best.join(i.select("iid", *item_keys), "iid").join(asked, "qid").select("vec", *item_keys, "rank", "score")
    return q.join(best, "vec").select(*query_keys, *item_keys, "rank", "score")
