"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Every byte of a text gets a distribution over the languages from what stands before it and after it; the
document's distribution is the mean over all its bytes. The network is trained by backpropagation through
time on stretches of a bounded sample of labelled texts; the input is nothing but the bytes.

A text is read in stretches of STRETCH bytes, each from both ends, so that texts of any length cost in
proportion and many stretches are worked on at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of, text_slices

HIDDEN, STRETCH = 8, 96
#: Bounds of what is learned from: texts a language, texts in all (but one of each language at least), stretches a text.
TEXTS_PER_LANGUAGE, TEXTS, STRETCHES_PER_TEXT = 160, 32_000, 4
#: A small sample is gone through more often, LEAST_STEPS batches in all.
EPOCHS, LEAST_STEPS, BATCH, RATE = 8, 240, 128, 0.012
#: Bytes worked on at once when predicting.
SLICE = 1 << 19
#: Tasks that thin out the labelled texts of a language before one task has what each of them leaves.
WAYS = 64
UNKNOWN = "und"


@dataclass
class Model:
    """languages; for each direction the bytes' table, the recurrent weights and the candidate's bias; the output layer."""

    languages: list[str]
    tables: list[np.ndarray]
    weights: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.weights, *self.biases, self.out, self.out_bias]


def new_model(languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    return Model(
        languages, [draw(256, 3 * hidden) for _ in "<>"], [draw(hidden, 3 * hidden) for _ in "<>"],
        [np.zeros(hidden, np.float32) for _ in "<>"], draw(2 * hidden, len(languages)), np.zeros(len(languages), np.float32),
    )


def run_direction(table, weights, bias, codes, mask, back: bool):
    """States at every position, [position, stretch, hidden], and what backpropagation needs; used in training."""
    steps, n, h = codes.shape[0], codes.shape[1], weights.shape[0]
    states, held = np.zeros((steps, n, h), np.float32), []
    state = np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        x, g = table[codes[t]], state @ weights
        gates = x[:, : 2 * h] + g[:, : 2 * h]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1.0
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :h], gates[:, h:]
        past = g[:, 2 * h:] + bias
        fresh = np.tanh(x[:, 2 * h:] + r * past)
        new = fresh + z * (state - fresh)
        new *= mask[t]
        held.append((t, z, r, fresh, past, state))
        state = states[t] = new
    return states, held


def positions(model: Model, codes, mask) -> np.ndarray:
    """Distributions over the languages at every position: [position, language, stretch].

    The same network as in training, with the stretches in the last dimension so that every operation runs
    over contiguous memory; a gate is a tanh of half its argument, and the half is in the weights.
    """
    steps, n, h = codes.shape[0], codes.shape[1], model.weights[0].shape[0]
    half = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)[:, None]
    logits = np.empty((steps, len(model.languages), n), np.float32)
    logits[:] = model.out_bias[None, :, None]
    for d in (0, 1):
        table, weights = np.ascontiguousarray(model.tables[d].T * half), np.ascontiguousarray(model.weights[d].T * half)
        bias, out = model.biases[d][:, None], np.ascontiguousarray(model.out[d * h:(d + 1) * h].T)
        state, g = np.zeros((h, n), np.float32), np.empty((3 * h, n), np.float32)
        x = np.empty((3 * h, n), np.float32)
        for t in range(steps - 1, -1, -1) if d else range(steps):
            np.take(table, codes[t], axis=1, out=x, mode="clip")
            np.matmul(weights, state, out=g)
            gates = x[: 2 * h]
            gates += g[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            past = g[2 * h:]
            past += bias
            past *= gates[h:]
            past += x[2 * h:]
            np.tanh(past, out=past)
            state -= past
            state *= gates[:h]
            state += past
            state *= mask[t]
            logits[t] += out @ state
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def step(model: Model, codes, mask, labels) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
    h = model.weights[0].shape[0]
    runs = [run_direction(model.tables[d], model.weights[d], model.biases[d], codes, mask, bool(d)) for d in (0, 1)]
    states = np.concatenate([s for s, _ in runs], axis=2)
    logits = states @ model.out + model.out_bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    total = float(mask.sum())
    truth = np.eye(len(model.languages), dtype=np.float32)[labels]
    loss = -float((np.log((p * truth[None]).sum(axis=2) + 1e-9) * mask[:, :, 0]).sum()) / total
    d_logits = (p - truth[None]) * mask / total
    d_out = np.einsum("tnh,tnc->hc", states, d_logits)
    d_states = d_logits @ model.out.T
    tables, weights, biases = [], [], []
    for d, (_, held) in enumerate(runs):
        u = model.weights[d]
        d_table, d_u, d_b = np.zeros_like(model.tables[d]), np.zeros_like(u), np.zeros_like(model.biases[d])
        later = np.zeros((codes.shape[1], h), np.float32)
        for t, z, r, fresh, past, before in reversed(held):
            d_new = (d_states[t, :, d * h:(d + 1) * h] + later) * mask[t]
            d_fresh = d_new * (1 - z) * (1 - fresh * fresh)
            d_z = d_new * (before - fresh) * z * (1 - z)
            d_r = d_fresh * past * r * (1 - r)
            d_past = d_fresh * r
            np.add.at(d_table, codes[t], np.concatenate([d_z, d_r, d_fresh], axis=1))
            d_g = np.concatenate([d_z, d_r, d_past], axis=1)
            d_u += before.T @ d_g
            d_b += d_past.sum(axis=0)
            later = d_new * z + d_g @ u.T
        tables.append(d_table)
        weights.append(d_u)
        biases.append(d_b)
    return loss, [*tables, *weights, *biases, d_out, d_logits.sum(axis=(0, 1))]


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, least: int = LEAST_STEPS, rate: float = RATE, seed: int = 5) -> Model:
    """A network from texts and their languages; the same input gives the same network.

    ``epochs`` times through all stretches, and on until ``least`` batches were seen; the rate falls to a twentieth.
    """
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    parts, of = [], []
    for text, label in zip(texts, labels, strict=True):
        for at in range(0, len(text), STRETCH):  # as many stretches as its bytes fill
            parts.append(np.frombuffer(text, np.uint8)[at:at + STRETCH])
            of.append(languages.index(label))
    codes, mask = np.zeros((STRETCH, len(parts)), np.uint8), np.zeros((STRETCH, len(parts), 1), np.float32)
    for i, x in enumerate(parts):
        codes[: len(x), i] = x
        mask[: len(x), i] = 1
    of = np.array(of)
    model = new_model(languages, hidden, seed)
    first, second, turn = [np.zeros_like(x) for x in model.parameters()], [np.zeros_like(x) for x in model.parameters()], 0
    steps = max(epochs * -(-len(parts) // BATCH), least)
    while turn < steps:
        order = rng.permutation(len(parts))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            _, grads = step(model, codes[:, pick], mask[:, pick], of[pick])
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            turn += 1
            pace = rate * 0.05 ** (turn / steps)
            for x, g, m, v in zip(model.parameters(), grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= pace * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-7)
    return model


def pooled(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each row's mean distribution over all its bytes; rows of no bytes get zeros."""
    lengths = np.diff(offsets)
    count = -(-lengths // STRETCH)
    row = np.repeat(np.arange(len(lengths)), count)
    total = np.zeros((len(lengths), len(model.languages)))
    if not len(row):
        return total
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[:-1][row] + nth * STRETCH
    size = np.minimum(STRETCH, offsets[1:][row] - begin)
    at = begin[None, :] + np.arange(STRETCH)[:, None]
    whole = SLICE // STRETCH
    for a in range(0, len(row), whole):
        b = min(len(row), a + whole)
        inside = np.arange(STRETCH)[:, None] < size[None, a:b]
        codes = raw[np.minimum(at[:, a:b], len(raw) - 1)]
        p = positions(model, codes, inside.astype(np.float32))
        p *= inside[:, None, :]
        np.add.at(total, row[a:b], p.sum(axis=0).T)
    return total / np.maximum(lengths, 1)[:, None]


def remainder(id_col: str):
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TEXTS_PER_LANGUAGE, texts: int = TEXTS, seed: int = 5) -> Model | None:
    """Train on at most ``per_language`` labelled texts of each language, drawn by a seeded hash of text and language.

    Rows without a label or text, or with remainder 2, teach nothing. Every label is learned; where there are so
    many that the sample would pass ``texts``, each gets as many fewer, one at least. Of each text up to
    STRETCHES_PER_TEXT stretches of STRETCH characters are read. No usable row: no model.
    """
    rows = df.filter((remainder(id_col) != 2) & F.col(lang_col).isNotNull() & text_of(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    last = F.greatest(F.length("text") - STRETCH + 1, F.lit(1))
    stretch = [F.substr("text", (F.pmod(F.xxhash64("text", F.lit(seed + j)), last) + 1).cast("int"), F.lit(STRETCH)) for j in range(STRETCHES_PER_TEXT)]
    # the stretches travel, not the texts; a frequent language is thinned out in WAYS tasks before one sees what is left of it
    order = ["h", "tie"]
    rows = rows.select("lang", F.xxhash64("text", "lang", F.lit(seed)).alias("h"), F.xxhash64(F.lit(seed), "text").alias("tie"), F.array(*stretch).alias("parts"), F.pmod(F.spark_partition_id(), F.lit(WAYS)).alias("way"))
    few = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang", "way").orderBy(*order))).filter(F.col("k") <= per_language)
    drawn = staged(few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("k") <= per_language).drop("way", "tie"), "drawn")
    languages = drawn.select("lang").distinct().count()
    if not languages:
        return None
    drawn = drawn.filter(F.col("k") <= max(1, min(per_language, texts // languages)))
    sample = sorted((r["lang"], r["h"], r["t"]) for r in drawn.select("lang", "h", F.explode(F.array_distinct("parts")).alias("t")).collect())
    return train([t.encode() for _, _, t in sample], [lang for lang, _, _ in sample], seed=seed)


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score (the mean probability of that language over the text's bytes).

    A null text, or one without a letter, is ``und`` with score 0; so is every text if there is no model. Ties
    go to the language that sorts first. Each row by itself: repeated rows give repeated results. Whole texts are read.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), (remainder(id_col) == 2).alias("held_out"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = rows.withColumn("known", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            found = [pooled(m, raw, offsets) for _, _, raw, offsets in text_slices(batch.column("text"), SLICE)]
            p = np.concatenate(found) if found else np.zeros((0, len(m.languages)))
            known = np.array(batch.column("known").to_pylist(), dtype=bool)
            best = p.argmax(axis=1)
            names = [m.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the labelled rows of ``df`` (:func:`fit`) and predict all of its rows (:func:`predict`).

    Null, empty and letterless texts are ``und``; very long ones are read whole; ties, repeated rows, null ids,
    an empty table and further columns of any name are as said there.
    """
    return predict(df, fit(df, id_col, text_col, lang_col), id_col, text_col)
