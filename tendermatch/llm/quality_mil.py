"""Operator 2: document quality by attention-based multiple-instance learning.

A document is a bag of passages (windows of bytes). Each passage becomes
shares of byte-class pairs and its strongest repetition period; one layer
encodes it, gated attention weighs the passages of the document, and the
weighted mean is scored. Only documents carry labels: the attention learns
which passages decide. The model is trained in numpy on a bounded sample of
labelled rows; scoring reads every text whole and needs no shuffle.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermatch.llm.common import pin

WINDOW = 256            # bytes of a passage
SEGMENT = 1 << 20       # bytes looked at at once; a multiple of WINDOW
SCORED = 1 << 21        # bytes of text scored at once
MAX_PERIOD = 24         # longest repetition period looked for
TRAIN_DOCS = 4000       # labelled rows that the model is fitted on, at most
PIECE = 1 << 12         # passages of a training row handed to the driver at once
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 12, 30, 64, 0.01, 1e-4, 7

#: Classes of ASCII bytes; the rest are lead or continuation bytes of UTF-8.
_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".", ",;:", "!", "?", "|",
            "*", "#", "$%&", "\"'()[]{}<>", "@/\\-_=+~^`"]
_LEAD, _REST = len(_CLASSES), len(_CLASSES) + 1
N_CLASSES = len(_CLASSES) + 2
TABLE = np.full(256, len(_CLASSES) - 1, dtype=np.int32)
for _k, _chars in enumerate(_CLASSES):
    TABLE[[ord(c) for c in _chars]] = _k
TABLE[0x80:0xC0], TABLE[0xC0:] = _REST, _LEAD
WIDTH = N_CLASSES * N_CLASSES + 2


def _segment_features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features of all windows in consecutive segments that end at ``ends``;
    a segment never looks at its neighbours."""
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    place = (np.arange(len(data), dtype=np.int32) - np.repeat(begins.astype(np.int32), sizes))
    counts = -(-sizes // WINDOW)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    starts = np.concatenate([b + WINDOW * np.arange(c) for b, c in zip(begins, counts)])
    window = np.repeat(first.astype(np.int32), sizes) + place // WINDOW
    n = len(starts)
    length = np.diff(np.append(starts, len(data))).astype(np.float32)

    kind = TABLE[data]
    pair = (window[:-1] * N_CLASSES + kind[:-1]) * N_CLASSES + kind[1:]
    pair = np.delete(pair, ends[:-1] - 1) if len(ends) > 1 else pair
    out = np.empty((n, WIDTH), dtype=np.float32)
    out[:, :-2] = np.bincount(pair, minlength=n * N_CLASSES * N_CLASSES).reshape(n, -1) / length[:, None]
    strongest = np.zeros(n, dtype=np.float32)
    for period in range(2, MAX_PERIOD + 1):
        same = np.zeros(len(data), dtype=np.uint8)
        same[period:] = (data[period:] == data[:-period]) & (place[period:] >= period)
        np.maximum(strongest, np.add.reduceat(same, starts, dtype=np.int32) / length, out=strongest)
    out[:, -2], out[:, -1] = strongest, length / WINDOW
    return out


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a batch, and how many each text has (an empty
    or null one has a single passage of zeros)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    counts = np.maximum(1, -(-np.diff(offsets) // WINDOW))
    out = np.zeros((int(counts.sum()), WIDTH), dtype=np.float32)
    at, group, ends, size = 0, [], [], 0

    def done() -> None:
        nonlocal at, group, ends, size
        if group:
            got = _segment_features(np.concatenate(group), np.array(ends))
            out[at:at + len(got)] = got
            at += len(got)
        group, ends, size = [], [], 0

    for begin, end in zip(offsets[:-1], offsets[1:]):
        if begin == end:
            done()
            at += 1
        for k in range(begin, end, SEGMENT):
            part = data[k:min(k + SEGMENT, end)]
            if size and size + len(part) > SEGMENT:
                done()
            size += len(part)
            group.append(part)
            ends.append(size)
    done()
    return out, counts


def parts(texts: pa.Array, size: int = SCORED) -> Iterator[pa.Array]:
    """A batch in parts of about ``size`` bytes (a longer text is a part of its own)."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    begin = 0
    while begin < len(texts):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield texts.slice(begin, end - begin)
        begin = end


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (x - self.mean) * self.scale
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        h = np.tanh(x @ w["encode"] + w["encode_0"])
        u, g = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
        s = (u * g) @ w["attend"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), counts))
        a = s / np.repeat(np.add.reduceat(s, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "starts": starts, "h": h, "u": u, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["score"] + w["score_0"][0])}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, counts)
        error = (f["p"] - y) / len(y)
        dz = np.repeat(error[:, None] * w["score"], counts, axis=0)
        da = (f["h"] * dz).sum(axis=1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["starts"]), counts))
        dug = ds[:, None] * w["attend"]
        du, dg = dug * f["g"] * (1 - f["u"] ** 2), dug * f["u"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + du @ w["value"].T + dg @ w["gate"].T) * (1 - f["h"] ** 2)
        return {"encode": f["x"].T @ dh, "encode_0": dh.sum(axis=0), "value": f["h"].T @ du, "gate": f["h"].T @ dg,
                "attend": (f["u"] * f["g"]).T @ ds, "score": f["z"].T @ error, "score_0": np.array([error.sum()])}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, counts)["p"] if len(counts) else np.zeros(0)


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the columns, read in parts."""
    mean, square = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(0, len(x), PIECE):
        mean += x[k:k + PIECE].sum(axis=0, dtype=np.float64) / len(x)
    for k in range(0, len(x), PIECE):
        square += ((x[k:k + PIECE] - mean) ** 2).sum(axis=0) / len(x)
    return mean.astype(np.float32), np.sqrt(square).astype(np.float32)


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam on the cross-entropy of the documents' labels."""
    rng = np.random.default_rng(seed)
    mean, spread = _moments(x)
    small = lambda *shape: rng.normal(0, 0.1, shape)
    model = Model(mean, 1 / (spread + 0.01),
                  {"encode": small(x.shape[1], HIDDEN), "encode_0": np.zeros(HIDDEN), "value": small(HIDDEN, GATE),
                   "gate": small(HIDDEN, GATE), "attend": small(GATE), "score": small(HIDDEN), "score_0": np.zeros(1)})
    starts = np.concatenate([[0], np.cumsum(counts)])
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            bags = order[k:k + BATCH]
            rows = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in bags])
            grads = model.gradients(np.asarray(x[rows], dtype=np.float32), counts[bags], y[bags])
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for name, g in grads.items():
                g = g + DECAY * model.weights[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.weights[name] -= rate * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
    return model


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_docs: int = TRAIN_DOCS) -> Model | None:
    """Fit on at most ``max_docs`` rows (those with the smallest id hash) and all their passages, which the driver
    keeps in a file of its own; None where no row has a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in parts(batch.column(1)):
                x, counts = passages(texts)
                for begin, n in zip((np.cumsum(counts) - counts).tolist(), counts.tolist()):
                    for k in range(0, n, PIECE):
                        piece = x[begin + k:begin + min(n, k + PIECE)].astype(np.float16).tobytes()
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([k == 0]), pa.array([piece], pa.binary())],
                                                         names=["label", "first", "x"])
                    at += 1

    key = [F.xxhash64(id_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    sample = (labelled.where(F.col(label_col).isNotNull()).select(*key, F.col(label_col).cast("double").alias("label"))
              .orderBy("key", "id", "text").limit(max_docs))
    rows = (pin(sample, "quality-sample").repartitionByRange(16, "key", "id", "text").sortWithinPartitions("key", "id", "text")
            .select("label", "text").mapInArrow(run, "label double, first boolean, x binary"))
    labels, counts = [], []
    with tempfile.TemporaryFile() as file:
        for label, first, x in rows.toLocalIterator():
            file.write(x)
            if first:
                labels.append(label)
                counts.append(0)
            counts[-1] += len(x) // (2 * WIDTH)
        if not labels:
            return None
        file.flush()
        return fit(np.memmap(file, dtype=np.float16, mode="r", shape=(sum(counts), WIDTH)), np.array(counts, dtype=np.int64), np.array(labels))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if it is at least 0.5)
    after their own columns; columns of these names are replaced.

    Rows are mapped one to one. A null text counts as empty and has one empty
    passage; without a model (no labelled row) every score is 0.5.
    """

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.full(len(texts), 0.5))
        return pa.array(np.concatenate([model.score(*passages(part)) for part in parts(texts)] or [np.zeros(0)]))

    return (docs.withColumn("score", scored(F.col(f"`{text_col}`")))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
