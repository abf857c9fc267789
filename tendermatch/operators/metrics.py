"""In-batch similarity, contrastive losses and retrieval metrics.

A batch of B (notice, company) pairs gives a B x B similarity matrix whose
diagonal holds the true matches. It is cut into cells of at most ``TILE`` rows
and columns. A pair goes to the cells of its row and of its column (a batch of
up to ``TILE`` pairs is one cell), a task multiplies the vectors of a cell in
strips, and what leaves it is one mergeable state per row and per column of the
cell: number, sum, maximum with its lowest place, sum of exponentials around
the maximum, entries that beat or tie the diagonal. States of a row are merged
by one Spark aggregate, so the B x B entries are never rows and no task holds
more than a cell, whatever the size of a batch. Every metric is then a plain
aggregate over B summary rows per batch:

    diag        s_ii                      row_lse / col_lse   log-sum-exp of row i / column i
    row_mean    mean_j s_ij               col_mean            mean_j s_ji
    row_argmax  argmax_j s_ij (lowest j)  col_argmax          argmax_j s_ji (lowest j)
    rank        1-based rank of s_ii in row i (ties: lower j first)
    off_sum     sum_{j!=i} s_ij
    cos_pos     1 - sign(s_ii)            cos_neg             sum_{j!=i} max(0, sign(s_ij))
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermatch.functions.numeric import z_gap
from tendermatch.functions.vectors import dot
from tendermatch.operators.pairs import with_batches
from tendermatch.operators.retrieval import ordered_dot, rounding

TILE = 4096              # rows and columns of a cell
STRIP = 1 << 20          # entries of a cell that are held at a time

_STATE = ("batch_id long, i int, side int, n long, diag double, top double, arg int, exps double, total double, beat long, "
          "positive double")


def vector_batches(pairs: DataFrame, left: str, right: str, order_by: Sequence[str], batch_size: int) -> DataFrame:
    """W7 for vector pairs: (batch_id, pos, left, right)."""
    b = with_batches(pairs.select(*order_by, left, right), list(order_by), batch_size)
    return b.select("batch_id", "pos", F.col(left).alias("left"), F.col(right).alias("right"))


def _cells(batches: DataFrame, temperature: float, batch_size: int | None, tile: int) -> DataFrame:
    """Every pair in the cells of its row (with ``left``) and of its column (with ``right``); both in the cell that the
    diagonal goes through. ``diag`` is the pair's own similarity."""
    if batch_size is None:
        most = batches.agg(F.max("pos")).first()[0]
        batch_size = 1 if most is None else most + 1
    parts = -(-batch_size // tile)
    own = F.floor(F.col("pos") / tile).cast("int")
    rows = batches.select("batch_id", "pos", "left", "right", (dot("left", "right") / F.lit(float(temperature))).alias("diag"))
    if parts == 1:
        return rows.select(F.lit(0).alias("r"), F.lit(0).alias("c"), "*")
    others = F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: k != own)
    places = F.concat(F.array(F.struct(own.alias("r"), own.alias("c"))), F.transform(others, lambda k: F.struct(own.alias("r"), k.alias("c"))),
                      F.transform(others, lambda k: F.struct(k.alias("r"), own.alias("c"))))
    spread = rows.withColumn("_tm_at", F.explode(places))
    return spread.select("_tm_at.r", "_tm_at.c", "batch_id", "pos", F.when(F.col("_tm_at.r") == own, F.col("left")).alias("left"),
                         F.when(F.col("_tm_at.c") == own, F.col("right")).alias("right"), "diag")


def _vectors(column: pa.ChunkedArray, wanted: np.ndarray) -> np.ndarray:
    column = column.combine_chunks()
    column = (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).take(pa.array(wanted))
    width = set(np.diff(column.offsets.to_numpy()).tolist())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if column.null_count or len(width) > 1:
        raise ValueError("the vectors of a batch differ in shape")
    return values.reshape(len(column), -1)


class _Cell:
    """Rows and columns of one cell in the order of their places."""

    def __init__(self, table: pa.Table):
        self.batch, r, c = (table.column(k)[0].as_py() for k in ("batch_id", "r", "c"))
        pos, diag = table.column("pos").to_numpy(), table.column("diag").to_numpy()
        has_left, has_right = (table.column(k).is_valid().to_numpy() for k in ("left", "right"))
        if r == c and not (has_left & has_right).all() or not (has_left | has_right).all():
            raise ValueError("a batch holds a row without a vector")
        order = np.argsort(pos, kind="stable")
        rows, cols = order[has_left[order]], order[has_right[order]]
        self.i, self.j, self.diag = pos[rows].astype(np.int64), pos[cols].astype(np.int64), diag[rows]
        self.empty = not len(rows) or not len(cols)      # a short batch has no pairs here
        if not self.empty:
            self.left, self.right = _vectors(table.column("left"), rows), _vectors(table.column("right"), cols)
            if self.left.shape[1] != self.right.shape[1]:
                raise ValueError("left and right batches differ in shape")
            self.slack = rounding(self.left, self.right)

    def strips(self, temperature: float):
        """Slices of the rows with their entries."""
        step = max(1, STRIP // len(self.j))
        for at in range(0, len(self.i), step):
            some = slice(at, at + step)
            yield some, (self.left[some] @ self.right.T) / temperature

    def exact(self, s: np.ndarray, some: slice, temperature: float, least: np.ndarray) -> None:
        """Write the entries of ``s`` that come near ``least`` anew, summed in the order of the dimensions: a matrix
        product may give equal pairs of vectors unequal last digits, which must not decide a rank."""
        row, col = np.nonzero(np.abs(s - least) <= (self.slack[some] / temperature)[:, None])
        for at in range(0, len(row), STRIP):
            a, b = row[at:at + STRIP], col[at:at + STRIP]
            s[a, b] = ordered_dot(self.left[some][a], self.right[b]) / temperature


def _states(temperature: float):
    def fn(table: pa.Table) -> pa.Table:
        cell = _Cell(table)
        out = {k: [] for k in ("i", "side", "n", "diag", "top", "arg", "exps", "total", "beat", "positive")}

        def add(**values) -> None:
            for k, v in values.items():
                out[k].append(v)

        if not cell.empty:
            high, arg = np.full(len(cell.j), -np.inf), np.full(len(cell.j), np.iinfo(np.int64).max)
            exps, total = np.zeros(len(cell.j)), np.zeros(len(cell.j))
            for some, s in cell.strips(temperature):
                i, diag = cell.i[some], cell.diag[some][:, None]
                cell.exact(s, some, temperature, np.zeros(1))          # signs
                cell.exact(s, some, temperature, diag)
                cell.exact(s, some, temperature, s.max(axis=1, keepdims=True))
                cell.exact(s, some, temperature, s.max(axis=0, keepdims=True))
                top = s.max(axis=1)
                same = cell.j[None, :] == i[:, None]
                beat = (s > diag) | ((s == diag) & (cell.j[None, :] < i[:, None]))
                n = len(i)
                add(i=i, side=np.zeros(n), n=np.full(n, len(cell.j)), diag=cell.diag[some], top=top, arg=cell.j[s.argmax(axis=1)],
                    exps=np.exp(s - top[:, None]).sum(axis=1), total=s.sum(axis=1), beat=beat.sum(axis=1),
                    positive=((s > 0) & ~same).sum(axis=1))
                # the columns: states of the strips are merged as they come
                now = s.max(axis=0)
                first = i[s.argmax(axis=0)]
                arg = np.where(now > high, first, np.where(now == high, np.minimum(arg, first), arg))
                new = np.maximum(high, now)
                exps = exps * np.exp(high - new) + np.exp(s - new[None, :]).sum(axis=0)
                total, high = total + s.sum(axis=0), new
            n = len(cell.j)
            add(i=cell.j, side=np.ones(n), n=np.full(n, len(cell.i)), diag=np.zeros(n), top=high, arg=arg, exps=exps, total=total,
                beat=np.zeros(n), positive=np.zeros(n))
        got = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}
        kinds = {"i": np.int32, "side": np.int32, "arg": np.int32, "n": np.int64, "beat": np.int64}
        return pa.table({"batch_id": np.full(len(got["i"]), cell.batch, dtype=np.int64),
                         **{k: v.astype(kinds.get(k, np.float64)) for k, v in got.items()}})
    return fn


def row_stats(batches: DataFrame, temperature: float = 1.0, batch_size: int | None = None, tile: int = TILE) -> DataFrame:
    """Per-row summaries of each batch's similarity matrix (see module doc).

    ``batch_size`` is the largest batch, if it is known; otherwise one look at the positions finds it. ``tile`` bounds
    the rows and columns of a task's cell and changes sums in their last digits only.
    """
    cells = _cells(batches, temperature, batch_size, tile)
    states = cells.groupBy("batch_id", "r", "c").applyInArrow(_states(temperature), _STATE)

    def of(side: int, c: str) -> Column:
        return F.when(F.col("side") == side, F.col(c))

    def lowest_best(side: int) -> Column:
        return F.max_by(of(side, "arg"), of(side, "place"))

    def lse(parts: str, top: str) -> Column:
        total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["exps"] * F.exp(p["top"] - F.col(top)))
        return F.col(top) + F.log(total)

    states = states.withColumn("place", F.struct(F.col("top"), -F.col("arg"))).withColumn("part", F.struct("top", "exps"))
    merged = states.groupBy("batch_id", "i").agg(
        F.sum(of(0, "n")).cast("int").alias("b"), F.max(of(0, "diag")).alias("diag"), F.max(of(0, "top")).alias("row_max"),
        F.max(of(1, "top")).alias("_tm_col_max"), F.collect_list(of(0, "part")).alias("_tm_rows"),     # one for each cell of the row
        F.collect_list(of(1, "part")).alias("_tm_cols"), F.sum(of(0, "total")).alias("_tm_row"), F.sum(of(1, "total")).alias("_tm_col"),
        lowest_best(0).alias("row_argmax"), lowest_best(1).alias("col_argmax"), (F.sum(of(0, "beat")) + 1).cast("int").alias("rank"),
        F.sum(of(0, "positive")).alias("cos_neg"))
    return merged.select(
        "batch_id", "i", "b", "diag", lse("_tm_rows", "row_max").alias("row_lse"), lse("_tm_cols", "_tm_col_max").alias("col_lse"),
        (F.col("_tm_row") / F.col("b")).alias("row_mean"), (F.col("_tm_col") / F.col("b")).alias("col_mean"), "row_argmax", "col_argmax",
        "row_max", "rank", (F.col("_tm_row") - F.col("diag")).alias("off_sum"), (1.0 - F.signum("diag")).alias("cos_pos"), "cos_neg")


def batch_similarity(batches: DataFrame, temperature: float = 1.0, batch_size: int | None = None, tile: int = TILE) -> DataFrame:
    """The similarity matrix as B rows per batch: (batch_id, i, sims[j]). A row is put together from its cells."""
    def fn(table: pa.Table) -> pa.Table:
        cell = _Cell(table)
        parts = [] if cell.empty else [s for _, s in cell.strips(temperature)]
        s = np.concatenate(parts) if parts else np.zeros((0, 0))
        ends = np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]
        n = len(s)
        return pa.table({"batch_id": np.full(n, cell.batch, dtype=np.int64), "i": (cell.i if n else np.zeros(0)).astype(np.int32),
                         "c": np.full(n, table.column("c")[0].as_py(), dtype=np.int32),
                         "sims": pa.ListArray.from_arrays(pa.array(ends), pa.array(s.ravel()))})

    cells = _cells(batches, temperature, batch_size, tile)
    parts = cells.groupBy("batch_id", "r", "c").applyInArrow(fn, "batch_id long, i int, c int, sims array<double>")
    whole = parts.groupBy("batch_id", "i").agg(F.array_sort(F.collect_list(F.struct("c", "sims"))).alias("parts"))
    return whole.select("batch_id", "i", F.flatten(F.transform("parts", lambda p: p["sims"])).alias("sims"))


def top_k(batches: DataFrame, k: int, temperature: float = 1.0, batch_size: int | None = None, tile: int = TILE) -> DataFrame:
    """Top-k companies per notice row (k clamped to B; ties -> lower j); each cell gives its k best, a window
    keeps the best of a row's cells."""
    def fn(table: pa.Table) -> pa.Table:
        cell = _Cell(table)
        found = []
        for some, s in cell.strips(temperature) if not cell.empty else ():
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
            with np.errstate(invalid="ignore"):
                row, col = np.nonzero(s >= (least - 2 * cell.slack[some] / temperature)[:, None])
            sim = ordered_dot(cell.left[some][row], cell.right[col]) / temperature
            order = np.lexsort((col, -sim, row))
            row, col, sim = row[order], col[order], sim[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((cell.i[some][row[keep]], cell.j[col[keep]], sim[keep]))
        i, j, sim = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0),) * 3
        return pa.table({"batch_id": np.full(len(i), cell.batch, dtype=np.int64), "i": i.astype(np.int32), "j": j.astype(np.int32),
                         "sim": sim.astype(np.float64)})

    cells = _cells(batches, temperature, batch_size, tile)
    parts = cells.groupBy("batch_id", "r", "c").applyInArrow(fn, "batch_id long, i int, j int, sim double")
    order = Window.partitionBy("batch_id", "i").orderBy(F.desc("sim"), "j")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ce_loss(e: float) -> Column:
    row = (1 - e) * (F.col("row_lse") - F.col("diag")) + e * (F.col("row_lse") - F.col("row_mean"))
    col = (1 - e) * (F.col("col_lse") - F.col("diag")) + e * (F.col("col_lse") - F.col("col_mean"))
    return 0.5 * (F.avg(row) + F.avg(col))


def _cos_loss() -> Column:
    b = F.max("b")
    return (F.sum("cos_pos") + F.sum("cos_neg")) / (b * b)


def _metric_aggs() -> list[Column]:
    b = F.max("b")
    return [F.avg((F.col("row_argmax") == F.col("i")).cast("double")).alias("accuracy"),
            F.avg("diag").alias("positive_similarity_mean"),
            F.when(b > 1, F.sum("off_sum") / (b * b - b)).alias("negative_similarity_mean"), b.alias("b")]


def _recall_aggs(ks: Sequence[int]) -> list[Column]:
    return [*[F.avg((F.col("rank") <= F.least(F.lit(k), F.col("b"))).cast("double")).alias(f"recall_at_{k}")
              for k in ks], F.avg(1.0 / F.col("rank")).alias("mrr")]


def _with_gap(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity_gap", F.col("positive_similarity_mean") - F.col("negative_similarity_mean"))


def batch_loss(stats: DataFrame, kind: str = "cross_entropy", label_smoothing: float = 0.0) -> DataFrame:
    """R2 / R3 per batch."""
    if kind == "cross_entropy":
        return stats.groupBy("batch_id").agg(_ce_loss(float(label_smoothing)).alias("loss"))
    if kind == "cosine_embedding":
        return stats.groupBy("batch_id").agg(_cos_loss().alias("loss"))
    raise ValueError(f"unknown loss {kind}")


def batch_metrics(stats: DataFrame) -> DataFrame:
    """Top-1 accuracy, positive / negative mean, gap per batch."""
    return _with_gap(stats.groupBy("batch_id").agg(*_metric_aggs()))


def recall_mrr(stats: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """R7 / R8 / W3 per batch; recall@k uses k = min(k, B)."""
    return stats.groupBy("batch_id").agg(*_recall_aggs(ks))


def alignment_check(stats: DataFrame) -> DataFrame:
    """Row hit, column hit, diagonal-is-row-max share and a status label per batch."""
    out = stats.groupBy("batch_id").agg(
        F.avg((F.col("row_argmax") == F.col("i")).cast("double")).alias("row_hit"),
        F.avg((F.col("col_argmax") == F.col("i")).cast("double")).alias("col_hit"),
        F.avg((F.col("diag") == F.col("row_max")).cast("double")).alias("diag_is_max"))
    status = (F.when((F.col("row_hit") < 0.05) & (F.col("col_hit") < 0.05), "critical")
              .when((F.col("row_hit") < 0.3) | (F.col("col_hit") < 0.3), "warning").otherwise("ok"))
    return out.withColumn("status", status)


def per_batch(stats: DataFrame, label_smoothing: float = 0.0, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """R10 for every batch in one aggregation: loss, accuracy, recalls, MRR, similarity means and gap."""
    return _with_gap(stats.groupBy("batch_id").agg(_ce_loss(float(label_smoothing)).alias("loss"),
                                                   *_metric_aggs(), *_recall_aggs(ks)))


def evaluate(stats: DataFrame, label_smoothing: float = 0.0, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """Unweighted mean of the per-batch metrics (a short last batch weighs the same)."""
    pb = per_batch(stats, label_smoothing, ks)
    cols = ["loss", "accuracy", *[f"recall_at_{k}" for k in ks], "mrr", "similarity_gap",
            "positive_similarity_mean", "negative_similarity_mean"]
    return pb.agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("num_batches"))


def compare_to_random(metrics: DataFrame, batch_size: int | str, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """Random baselines 1/B and min(k/B, 1) with strict improvement flags."""
    b = F.lit(float(batch_size)) if isinstance(batch_size, int) else F.col(batch_size).cast("double")
    out = metrics.withColumn("random_accuracy", 1.0 / b).withColumn(
        "accuracy_improvement", F.col("accuracy") > F.col("random_accuracy"))
    for k in ks:
        out = (out.withColumn(f"random_recall_at_{k}", F.least(F.lit(k) / b, F.lit(1.0)))
               .withColumn(f"recall_at_{k}_improvement", F.col(f"recall_at_{k}") > F.col(f"random_recall_at_{k}")))
    return out


def assess(metrics: DataFrame) -> DataFrame:
    """Assessment labels (accuracy, recall@10, similarity gap)."""
    return (metrics
            .withColumn("accuracy_level", F.when(F.col("accuracy") > 0.3, "good")
                        .when(F.col("accuracy") > 0.15, "fair").otherwise("poor"))
            .withColumn("recall_level", F.when(F.col("recall_at_10") > 0.6, "practical")
                        .when(F.col("recall_at_10") > 0.4, "needs_work").otherwise("insufficient"))
            .withColumn("gap_level", F.when(F.col("similarity_gap") > 0.5, "good").otherwise("needs_work")))


def with_z_gap(metrics: DataFrame) -> DataFrame:
    """R6 / V23."""
    return metrics.withColumn("z_gap", z_gap("similarity_gap", "negative_similarity_mean"))


def best_epoch(runs: DataFrame, loss_col: str, epoch_col: str) -> DataFrame:
    """Row with the lowest loss; the earliest epoch wins ties."""
    best = runs.agg(F.min_by(F.struct(*[F.col(c) for c in runs.columns]),
                             F.struct(F.col(loss_col), F.col(epoch_col))).alias("best"))
    return best.select("best.*")
