"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded and chunks, each overlapping the next by half, cover the whole text. In each chunk every learned
filter slides over the bytes and its largest response is kept; a hidden layer turns a chunk's responses, with
the chunk's length, into one logit, and the document's logit is the smooth minimum of its
chunks': bad stretches pull a document down wherever they stand. Max-pooling also shows
repetition: a chunk that says one thing over and over lights up few filters.

The network is trained by Adam inside one task on a bounded sample of labelled rows; the
trained arrays, a few kilobytes, go to all tasks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import sampled_ids, shipped, stringed, texts_of

HALF = 256
KERNEL, STRIDE = 8, 2
EMBED, FILTERS, HIDDEN = 6, 48, 24
SAMPLE_ROWS = 3_000
STEPS, BATCH, RATE = 560, 32, 4e-3
CUTOFF = 0.3
GROUP = 256

Arrays = dict[str, np.ndarray]


def padded(data: bytes) -> np.ndarray:
    """Byte numbers 1..256, then 0s: whole half chunks, at least one, and room for the last window."""
    halves = max(1, -(-len(data) // HALF))
    out = np.zeros(halves * HALF + KERNEL - STRIDE, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    out[: len(data)] += 1
    return out


def chunk_lengths(size: int, halves: int) -> np.ndarray:
    """Bytes in each chunk, a chunk being two neighbouring halves (or the only one)."""
    return np.clip(size - HALF * np.arange(max(1, halves - 1)), 0, 2 * HALF)


def initial(seed: int) -> Arrays:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, fan: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)

    return {
        "embed": normal(257, EMBED, fan=EMBED) * np.r_[0, np.ones(256)][:, None].astype(np.float32),
        "filters": normal(KERNEL * EMBED, FILTERS, fan=KERNEL),
        "bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(FILTERS + 1, HIDDEN, fan=FILTERS),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(HIDDEN, fan=HIDDEN),
        "out_bias": np.full(1, 1.0, np.float32),
    }


def responses(net: Arrays, numbers: np.ndarray) -> np.ndarray:
    """(half, window, filter): the filters slide over the bytes, each window belongs to the half that it starts in."""
    embedded = net["embed"][numbers].reshape(-1)
    windows = np.lib.stride_tricks.sliding_window_view(embedded, KERNEL * EMBED)[:: STRIDE * EMBED]
    return (np.ascontiguousarray(windows) @ net["filters"]).reshape(-1, HALF // STRIDE, FILTERS)


def by_chunk(halves: np.ndarray) -> np.ndarray:
    """Largest responses of chunks from those of halves."""
    return halves if len(halves) == 1 else np.maximum(halves[:-1], halves[1:])


def chunk_logits(net: Arrays, top: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.log2(1 + lengths)[:, None].astype(np.float32) / 9
    inputs = np.concatenate([top, size], axis=1)
    hidden = np.tanh(inputs @ net["hidden"] + net["hidden_bias"])
    return hidden @ net["out"] + net["out_bias"], hidden, inputs


def smooth_min(logits: np.ndarray) -> tuple[float, np.ndarray]:
    """-log(mean(exp(-x))), and each chunk's share in it."""
    low = logits.min()
    part = np.exp(low - logits)
    return float(low - np.log(part.mean())), part / part.sum()


def grouped(net: Arrays, numbers: np.ndarray) -> Iterator[np.ndarray]:
    """``responses`` of a text, ``GROUP`` halves at a time."""
    ends = KERNEL - STRIDE
    for begin in range(0, len(numbers) - ends, GROUP * HALF):
        yield responses(net, numbers[begin : begin + GROUP * HALF + ends])


def logit(net: Arrays, data: bytes) -> float:
    """The document's logit, over groups of halves, so that memory stays bounded for any length."""
    halves = np.concatenate([found.max(axis=1) for found in grouped(net, padded(data))])
    top = np.tanh(by_chunk(halves) + net["bias"])
    return smooth_min(chunk_logits(net, top, chunk_lengths(len(data), len(halves)))[0])[0]


def gradients(net: Arrays, data: bytes, label: int) -> tuple[float, Arrays]:
    """Log loss and gradients for one whole document, its chunks in groups. Through the pooling only the winning windows learn."""
    numbers = padded(data)
    places, tops = [], []
    for found in grouped(net, numbers):
        places.append(found.argmax(axis=1))
        tops.append(np.take_along_axis(found, places[-1][:, None], axis=1)[:, 0])
    best, halves = np.concatenate(places), np.concatenate(tops)
    starts = best * STRIDE + HALF * np.arange(len(halves))[:, None]
    if len(halves) > 1:
        starts = np.where(halves[:-1] >= halves[1:], starts[:-1], starts[1:])
    top = np.tanh(by_chunk(halves) + net["bias"])
    logits, hidden, inputs = chunk_logits(net, top, chunk_lengths(len(data), len(halves)))
    value, shares = smooth_min(logits)
    p = 1 / (1 + np.exp(-value))
    d_logits = ((p - label) * shares).astype(np.float32)
    d_hidden = d_logits[:, None] * net["out"] * (1 - hidden**2)
    d_top = (d_hidden @ net["hidden"].T)[:, :FILTERS] * (1 - top**2)
    won = numbers[starts[:, :, None] + np.arange(KERNEL)]
    seen = net["embed"][won].reshape(len(top), FILTERS, -1)
    d_seen = (d_top[:, :, None] * net["filters"].T[None]).reshape(-1, EMBED)
    flat = won.reshape(-1)
    d_embed = np.stack([np.bincount(flat, d_seen[:, e], 257) for e in range(EMBED)], axis=1).astype(np.float32)
    d_embed[0] = 0
    loss = -np.log(max(p if label else 1 - p, 1e-7))
    return loss, {
        "embed": d_embed,
        "filters": np.einsum("cf,cfk->kf", d_top, seen),
        "bias": d_top.sum(axis=0),
        "hidden": inputs.T @ d_hidden,
        "hidden_bias": d_hidden.sum(axis=0),
        "out": hidden.T @ d_logits,
        "out_bias": d_logits.sum(keepdims=True),
    }


def fit(rows: list[tuple[bytes, int]], seed: int = 7, steps: int = STEPS) -> Arrays:
    """Adam over shuffled batches with a falling rate. The rarer label weighs up to three times as much."""
    net = initial(seed)
    rng = np.random.default_rng(seed)
    good = sum(label for _, label in rows)
    if not rows or good in (0, len(rows)):
        net["out"][:] = 0
        net["out_bias"][:] = np.log((good + 0.5) / (len(rows) - good + 0.5))
        return net
    weight = [min(3.0, max(1.0, good / (len(rows) - good))), min(3.0, max(1.0, (len(rows) - good) / good))]
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(rows))])
        batch, order = order[:BATCH], order[BATCH:]
        total = {k: np.zeros_like(v) for k, v in net.items()}
        for r in batch:
            data, label = rows[r]
            for k, v in gradients(net, data, label)[1].items():
                total[k] += weight[label] * v / len(batch)
        rate = RATE * (1 - 0.95 * step / steps)
        for k in net:
            first[k] = 0.9 * first[k] + 0.1 * total[k]
            second[k] = 0.99 * second[k] + 0.01 * total[k] ** 2
            net[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def packed(net: Arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **net)
    return out.getvalue()


def unpacked(data: bytes) -> Arrays:
    with np.load(io.BytesIO(data)) as found:
        return dict(found)


def train(samples: DataFrame) -> bytes:
    """The network, packed, from ``(text, label)``, a bounded sample that one task holds; rows are put in an order of their own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((t.encode(), int(y > 0)) for f in frames for t, y in zip(f["text"], f["label"], strict=True))
        yield pd.DataFrame({"net": [packed(fit(rows))]})

    trained = shipped(samples).repartition(1).mapInPandas(run, "net binary").first()
    return trained[0] if trained else packed(fit([]))


def sampled(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(text, label)`` of at most ``rows`` labelled documents, whole, the smallest by a seeded hash; ``learn`` is a condition on the doc_id."""
    known = labels.filter(learn).select("doc_id", F.col("quality").cast("int").alias("label")).filter("label IS NOT NULL")
    return texts_of(docs, sampled_ids(known, rows, "quality", "label"), stringed(F.col("text")), "label").select("text", "label")


def score(text: Column, model: bytes) -> Column:
    """Probability of good quality of whole texts; null is empty, and empty texts are scored too.

    A text of any length is scored in groups of chunks. Equal texts have equal scores; an empty table has none.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = unpacked(model)
        for batch in batches:
            logits = np.array([logit(net, (t or "").encode("utf-8", "surrogatepass")) for t in batch], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    return run(text.cast("string"))
