"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned embedding. Learned filters, 12 bytes wide, slide over the whole document in steps of
four bytes; their responses are max-pooled over overlapping chunks of 512 bytes that start every 256 bytes and
cover the document from its first byte to its last. A hidden layer reads each chunk's pooled responses, and
the greatest and the mean activations over the document's chunks are combined into one probability.

The network is trained on the driver on a bounded sample of labelled documents: up to SAMPLE rows of each label,
chosen by a hash of the id, one row an id, and all chunks of its text. Some steps see the beginning of a good text only,
as short good documents are rare in a sample. Scoring is a map over whole texts without any shuffle; long documents are
read in stretches, so memory doesn't grow with them.

Defined results: a null text counts as empty; an empty text gets the score of a chunk of padding; without usable
labels every score is 0.5; labels repeated for an id count once, the lowest; repeated rows are scored alike; an empty
table gives an empty one; other columns, whatever their names, are kept and not read, but one named as the score is
replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, free_name, table, text_or_empty, turn

#: Rows of each label that training takes at most.
SAMPLE = 900
#: A document is called good from this score on; every FOLDS-th fold is held out.
THRESHOLD, FOLDS = 0.3, 5
EMBED, BLOCK, TAPS, FILTERS, HIDDEN, SEGMENT = 8, 4, 3, 32, 16, 64
SEGMENT_BYTES = SEGMENT * BLOCK
#: Segments read at once; those after a stretch that its last chunk and windows still see.
STRETCH, AHEAD = 256, 2


class ByteNet:
    """The network's weights, forward pass and training."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.w = {
            "embed": f32(256, EMBED, scale=0.5),
            "taps": f32(EMBED * BLOCK, TAPS * FILTERS, scale=(EMBED * BLOCK * TAPS) ** -0.5),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": f32(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": np.zeros(2 * HIDDEN, np.float32),
            "out_bias": np.zeros(1, np.float32),
        }

    def responses(self, buf: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded blocks and the filters' responses at each; last: index after each document's last segment."""
        x = np.take(self.w["embed"], buf, axis=0).reshape(-1, EMBED * BLOCK)
        r = x @ self.w["taps"]
        h = r[:, :FILTERS].copy()
        for t in range(1, TAPS):
            h[:-t] += r[t:, t * FILTERS : (t + 1) * FILTERS]
        for t in range(1, TAPS):
            h[last * SEGMENT - t] = -1e9
        return x, h

    def chunks(self, pooled: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which segment each chunk's maximum is from, and the two layers over chunks; inner: a next segment follows."""
        follows = np.zeros(pooled.shape, dtype=bool)
        follows[:-1] = inner[:-1, None] & (pooled[1:] > pooled[:-1])
        top = pooled.copy()
        top[:-1] = np.where(follows[:-1], pooled[1:], pooled[:-1])
        p = np.maximum(top + self.w["bias"], 0)
        return follows, p, np.maximum(p @ self.w["hidden"] + self.w["hidden_bias"], 0)

    def activations(self, buf: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The hidden layer over all chunks of the documents laid out in buf."""
        _, h = self.responses(buf, last)
        inner = np.ones(len(buf) // SEGMENT_BYTES, dtype=bool)
        inner[last - 1] = False
        return self.chunks(h.reshape(-1, SEGMENT, FILTERS).max(axis=1), inner)[2]

    def probability(self, most: np.ndarray, mean: np.ndarray) -> np.ndarray:
        z = np.concatenate([most, mean], axis=1) @ self.w["out"] + self.w["out_bias"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def step(self, docs: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the cross-entropy of a few documents."""
        w, sizes = self.w, np.array([segments(len(d)) for d in docs])
        last = np.cumsum(sizes)
        first, owner = last - sizes, np.repeat(np.arange(len(docs)), sizes)
        buf = laid_out(docs, sizes)
        x, h = self.responses(buf, last)
        h = h.reshape(-1, SEGMENT, FILTERS)
        where = h.argmax(axis=1)
        pooled = np.take_along_axis(h, where[:, None], axis=1)[:, 0]
        inner = np.ones(len(owner), dtype=bool)
        inner[last - 1] = False
        follows, p, a = self.chunks(pooled, inner)
        most, mean = np.maximum.reduceat(a, first), np.add.reduceat(a, first) / sizes[:, None]
        dz = ((self.probability(most, mean) - y) / len(y)).astype(np.float32)
        g = {"out": np.concatenate([most, mean], axis=1).T @ dz, "out_bias": dz.sum(keepdims=True)}
        d_most, d_mean = dz[:, None] * w["out"][:HIDDEN], dz[:, None] * w["out"][HIDDEN:] / sizes[:, None]
        da = (d_mean[owner] + (a == most[owner]) * d_most[owner]) * (a > 0)
        g |= {"hidden": p.T @ da, "hidden_bias": da.sum(axis=0)}
        dp = (da @ w["hidden"].T) * (p > 0)
        g["bias"] = dp.sum(axis=0)
        d_pooled = np.where(follows, 0, dp)
        d_pooled[1:] += np.where(follows, dp, 0)[:-1]
        g["taps"], g["embed"] = np.zeros_like(w["taps"]), np.zeros_like(w["embed"])
        taps = g["taps"].reshape(EMBED * BLOCK, TAPS, FILTERS)
        s, f = np.nonzero(d_pooled)
        by = np.argsort(f, kind="stable")
        s, f = s[by], f[by]
        d, block = d_pooled[s, f], s * SEGMENT + where[s, f]
        runs = np.flatnonzero(np.diff(f, prepend=-1))
        for t in range(TAPS if len(s) else 0):
            at = np.minimum(block + t, len(x) - 1)
            taps[:, t, f[runs]] = np.add.reduceat(x[at] * d[:, None], runs).T
            back = (w["taps"][:, t * FILTERS + f].T * d[:, None]).reshape(-1, EMBED)
            seen = buf.reshape(-1, BLOCK)[at].ravel()
            g["embed"] += np.stack([np.bincount(seen, back[:, e], 256) for e in range(EMBED)], axis=1)
        return g

    def fit(self, docs: list[np.ndarray], y: np.ndarray, steps: int = 260, batch: int = 24, rate: float = 0.01, seed: int = 11) -> ByteNet:
        """Adam over batches that hold as many documents of either label; with one label, that one alone.

        Of a part of the good documents a step takes the beginning only, as short good documents are rare in a sample."""
        r, y = np.random.default_rng(seed), np.asarray(y)
        groups = [g for g in (np.flatnonzero(y == 0), np.flatnonzero(y == 1)) if len(g)]
        if not groups:
            return self
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        for n in range(1, steps + 1):
            pick = np.concatenate([r.choice(g, batch // len(groups)) for g in groups])
            lr = rate * min(1, n / 20) * (1 - 0.9 * n / steps)
            cut = np.where((y[pick] == 1) & (r.random(len(pick)) < 0.3), r.integers(16, 300, len(pick)), 1 << 30)
            for k, g in self.step([docs[i][:n] for i, n in zip(pick, cut)], y[pick].astype(np.float64)).items():
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.01 * (g * g - v2[k])
                self.w[k] -= lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(v2[k] / (1 - 0.99**n)) + 1e-8)
        return self

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """The probability of each whole document."""
        sizes = np.array([segments(len(d)) for d in docs], dtype=np.int64)
        most, total = np.full((len(docs), HIDDEN), -np.inf, np.float32), np.zeros((len(docs), HIDDEN))
        for pieces in stretches(sizes):
            parts, keep = [], []
            for k, a, b in pieces:
                end = min(b + AHEAD, sizes[k])
                parts.append((docs[k][a * SEGMENT_BYTES : end * SEGMENT_BYTES], end - a))
                keep.append(b - a)
            held = np.array([n for _, n in parts])
            last = np.cumsum(held)
            act = self.activations(laid_out([d for d, _ in parts], held), last)
            for (k, _, _), start, n in zip(pieces, last - held, keep):
                own = act[start : start + n]
                most[k] = np.maximum(most[k], own.max(axis=0))
                total[k] += own.sum(axis=0)
        return self.probability(most, (total / sizes[:, None]).astype(np.float32)) if len(docs) else np.zeros(0)


def segments(n_bytes: int) -> int:
    """Segments of a document, one at least."""
    return max(1, -(-n_bytes // SEGMENT_BYTES))


def laid_out(docs: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The documents one after another, each from a segment's start, zeros between."""
    buf = np.zeros(int(sizes.sum()) * SEGMENT_BYTES, np.uint8)
    for d, start in zip(docs, (np.cumsum(sizes) - sizes) * SEGMENT_BYTES):
        buf[start : start + len(d)] = d
    return buf


def stretches(sizes: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """(document, from segment, to segment) of stretches, gathered to about STRETCH segments."""
    held, now = 0, []
    for k, n in enumerate(sizes.tolist()):
        for a in range(0, n, STRETCH):
            b = min(n, a + STRETCH)
            now.append((k, a, b))
            held += b - a
            if held >= STRETCH:
                yield now
                held, now = 0, []
    if now:
        yield now


def column_bytes(column: pa.Array) -> list[np.ndarray]:
    """The bytes of each string, as views of the column's buffer; nulls are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return [data[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteNet:
    """A network from the labelled rows outside the held-out fold; labels give no other input."""
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("quality"))
    known = known.where(F.col("label_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_fold("label_id", FOLDS) != 0))
    known = known.groupBy("label_id").agg(F.min("quality").alias("quality")).withColumn("order", F.xxhash64("label_id"))
    some = [known.where(F.col("quality") == q).orderBy("order", "label_id").limit(SAMPLE) for q in (0, 1)]
    texts = docs.select(F.col(id_col).alias("label_id"), text_or_empty(text_col).alias("text"))
    rows = texts.join(F.broadcast(some[0].unionByName(some[1])), "label_id").withColumn("hash", F.xxhash64("text"))
    first = rows.groupBy("label_id").agg(F.min(F.struct("hash", F.col("text").cast("binary").alias("text"), "quality", "order")).alias("row"))
    got = sorted((r["row"] for r in first.toLocalIterator()), key=lambda r: (r["order"], bytes(r["text"])))
    return ByteNet().fit([np.frombuffer(bytes(r["text"]), dtype=np.uint8) for r in got], np.array([r["quality"] for r in got]))


def score(docs: DataFrame, net: ByteNet, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows of docs with a column score_col."""
    weights = docs.sparkSession.sparkContext.broadcast(net.w)
    names = [c for c in docs.columns if c != score_col]
    source, at = docs.select(*names), names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("quality")
        own = ByteNet()
        own.w = weights.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                scores = own.score(column_bytes(batch.column(at)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, score_col])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(score_col, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier doesn't reject."""
    name = free_name(docs, "quality_score")
    return score(docs, train(docs, labels, id_col, text_col), text_col, name).where(F.col(name) >= THRESHOLD).drop(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), net).select(
        "doc_id",
        (crc_fold("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
