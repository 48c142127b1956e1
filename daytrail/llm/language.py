"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of ``SPAN`` bytes, read forwards and backwards by a GRU of ``UNITS``
units each way. A linear layer over both states labels every byte position; a document's score
is the mean probability of its language over all positions that carry a letter byte. Every byte
of every text is read. Gates are piecewise linear, so a step costs no exponentials.

The network is trained on the driver, in numpy, by backpropagation through time, on a bounded
sample (``SAMPLE`` documents at most, shared out over languages by hash of the id; of each one
stretch of ``STRETCH`` characters at a hashed place). Prediction runs in Arrow batches; the
memory of a task is bounded by ``WIDTH`` windows.

Defined cases: a null or empty text, or one without a letter, is ``und`` with score 0; without
labelled rows every text is; a null id is not held out and not learned from; repeated rows get
the same answer; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytrail.llm.columns import hash60
from daytrail.llm.textscan import utf8
from daytrail.session import cut_lineage

UNITS, SPAN, WIDTH = 8, 128, 2048
SAMPLE, STRETCH = 2400, 600
#: Documents below this score are rejected by :func:`accepted`. It is low, as a clean text of a few
#: words can be good in two languages: only texts that look like no language in particular go.
LEAST_SCORE = 0.3
STEPS, BATCH, TRAIN_SPAN, RATE = 260, 384, 48, 0.02
UNKNOWN = "und"


class Network:
    """Feature-major GRU in both directions: axis 0 is the direction, the last one the window."""

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        h, c = UNITS, len(labels)
        self.labels = labels
        # Gates in the order update, reset, candidate. Clipping to 0..1 is centred by the bias.
        self.bytes = rng.normal(0, 0.3, (2, 3 * h, 256)).astype(np.float32)
        self.bytes[:, : 2 * h] += 0.5
        self.state = rng.normal(0, 0.5 / np.sqrt(h), (2, 3 * h, h)).astype(np.float32)
        self.out = rng.normal(0, 0.3, (2, c, h)).astype(np.float32)
        self.bias = np.zeros((c, 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.bytes, self.state, self.out, self.bias]

    def forward(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Codes (steps, windows) to logits (steps, labels, windows)."""
        steps, width = codes.shape
        h = UNITS
        state = np.zeros((2, h, width), np.float32)
        gates, recur = (np.empty((2, 3 * h, width), np.float32) for _ in range(2))
        logits = np.empty((steps, len(self.labels), width), np.float32)
        logits[:] = self.bias
        for t in range(steps):
            if keep is not None:
                gates, recur = np.empty_like(gates), np.empty_like(recur)
            back = steps - 1 - t
            np.take(self.bytes[0], codes[t], axis=1, out=gates[0], mode="clip")
            np.take(self.bytes[1], codes[back], axis=1, out=gates[1], mode="clip")
            np.matmul(self.state, state, out=recur)
            both, new = gates[:, : 2 * h], gates[:, 2 * h :]
            both += recur[:, : 2 * h]
            np.clip(both, 0, 1, out=both)
            if keep is None:
                recur[:, 2 * h :] *= gates[:, h : 2 * h]
                new += recur[:, 2 * h :]
            else:
                new += recur[:, 2 * h :] * gates[:, h : 2 * h]
            np.clip(new, -1, 1, out=new)
            if keep is not None:
                keep.append((state.copy(), gates, recur[:, 2 * h :]))
            state -= new
            state *= gates[:, :h]
            state += new
            logits[t] += self.out[0] @ state[0]
            logits[back] += self.out[1] @ state[1]
        return logits

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over positions; ``target``: label number of each window."""
        steps, width = codes.shape
        h, kept = UNITS, []
        delta = softmax(self.forward(codes, kept))
        delta[:, target, np.arange(width)] -= 1
        delta /= steps * width
        d_bytes, d_state = np.zeros_like(self.bytes), np.zeros_like(self.state)
        d_out = np.zeros_like(self.out)
        d_h = np.zeros((2, h, width), np.float32)
        for t in reversed(range(steps)):
            back = steps - 1 - t
            before, gates, recur = kept[t]
            update, reset, new = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            after = new + update * (before - new)
            for side, at in ((0, t), (1, back)):
                d_out[side] += delta[at] @ after[side].T
                d_h[side] += self.out[side].T @ delta[at]
            d_new = d_h * (1 - update) * (np.abs(new) < 1)
            d_gates = np.empty_like(gates)
            d_gates[:, :h] = d_h * (before - new) * ((update > 0) & (update < 1))
            d_gates[:, h : 2 * h] = d_new * recur * ((reset > 0) & (reset < 1))
            d_gates[:, 2 * h :] = d_new
            for side, at in ((0, t), (1, back)):
                for unit in range(3 * h):
                    d_bytes[side, unit] += np.bincount(codes[at], d_gates[side, unit], 256)
            d_gates[:, 2 * h :] *= reset
            d_state += d_gates @ before.transpose(0, 2, 1)
            d_h = d_h * update + self.state.transpose(0, 2, 1) @ d_gates
        return [d_bytes, d_state, d_out, delta.sum((0, 2))[:, None]]


def softmax(logits: np.ndarray) -> np.ndarray:
    """Over axis 1, in place."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def train(texts: list[bytes], langs: list[str], seed: int = 5) -> Network:
    """Adam over random windows, as many of each language; the rate falls to a tenth."""
    labels = sorted(set(langs))
    net, rng = Network(labels, seed), np.random.default_rng(seed)
    pools = []
    for label in labels:
        pool = np.frombuffer(b" ".join(t for t, lang in zip(texts, langs, strict=True) if lang == label), np.uint8)
        pools.append(np.resize(pool, max(len(pool), TRAIN_SPAN + 1)))
    weights = net.parameters()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    target = np.arange(BATCH) % len(labels)
    for step in range(1, STEPS + 1):
        starts = [rng.integers(0, len(pools[k]) - TRAIN_SPAN) for k in target]
        codes = np.stack([pools[k][s : s + TRAIN_SPAN] for k, s in zip(target, starts, strict=True)], axis=1)
        rate = RATE * (1 - 0.9 * step / STEPS)
        for w, g, m, v in zip(weights, net.gradients(codes, target), first, second, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


#: Bytes that can be part of a letter: ASCII letters and all bytes of longer characters.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def label_positions(net: Network, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of position probabilities over letter bytes: (texts, labels)."""
    sums = np.zeros((len(starts), len(net.labels)))
    counts = -(-(ends - starts) // SPAN)
    doc = np.repeat(np.arange(len(starts)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[doc] + nth * SPAN
    left = np.minimum(ends[doc] - begin, SPAN)
    order = np.argsort(-left, kind="stable")  # short windows together, to be read no further than need be
    steps = np.arange(SPAN)[:, None]
    for i in range(0, len(doc), WIDTH):
        mine = order[i : i + WIDTH]
        length = left[mine]
        inside = steps[: length[0]] < length
        codes = np.where(inside, raw[np.where(inside, begin[mine] + steps[: length[0]], begin[mine])], 32)
        probability = softmax(net.forward(codes.astype(np.uint8)))
        probability *= (_LETTER[codes] & inside)[:, None, :]
        np.add.at(sums, doc[mine], probability.sum(axis=0).T)
    return sums


def learned(docs: DataFrame, seed: int = 5) -> Network | None:
    """The network, from documents that are not held out; None if no labelled row is there."""
    pool = docs.where(
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        & F.col("text").isNotNull()
        & F.col("lang").isNotNull()
        & F.col("text").rlike(r"\p{L}")
    ).select("doc_id", "lang", hash60(F.col("doc_id")).alias("h"))
    sizes = cut_lineage(pool.groupBy("lang").agg(F.count(F.lit(1)).alias("m")))
    langs = sizes.count()
    if not langs:
        return None
    share = max(1, SAMPLE // langs)
    # Hashes are uniform: below this bar are about twice as many of each language as are taken.
    low = pool.join(sizes, "lang").where(F.col("h") < 2.0**60 * 2 * (share + 20) / F.col("m"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = low.withColumn("nth", nth).where(F.col("nth") <= share).select("doc_id")
    room = F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1
    stretch = F.substring(
        F.col("text"), (F.pmod(hash60(F.col("doc_id")), room) + 1).cast("int"), F.lit(STRETCH)
    )
    rows = (
        docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi")  # at most SAMPLE ids
        .where(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .select("lang", stretch.alias("text"))
        .orderBy(F.xxhash64("text"), "text", "lang")
        .limit(2 * SAMPLE)
        .collect()
    )
    return train([r["text"].encode() for r in rows], [r["lang"] for r in rows], seed)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of ``docs``."""
    rows = docs.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"),
    )
    if net is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    label = _labeller(net)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(label, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _predict(net: Network, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(label number, score) of each text; score 0 where there is no letter byte."""
    sums = label_positions(net, *utf8(text))
    total = sums.sum(axis=1)
    return sums.argmax(axis=1), np.divide(sums.max(axis=1), total, out=np.zeros(len(total)), where=total > 0)


def _labeller(net: Network):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, share = _predict(net, batch.column("text"))
            names = [net.labels[k] if x > 0 else UNKNOWN for k, x in zip(best.tolist(), share.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(share)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return label


def accepted(docs: DataFrame, net: Network | None, least: float = LEAST_SCORE) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose language is known with a score of ``least``.

    Texts without a letter go; without a network, all others stay.
    """
    letters = docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if net is None:
        return letters

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, share = _predict(net, batch.column("text"))
            yield batch.filter(pa.array(share >= least))

    return letters.mapInArrow(keep, docs.schema)
