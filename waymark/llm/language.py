"""Language identification by averaged hashed subword embeddings.

A text's features are its words and the byte 3-grams and 4-grams inside them, hashed to buckets. Each bucket
has a small embedding; a text is their average, and a linear softmax gives the language. Both
layers are trained by stochastic gradient descent in numpy. A temperature, fitted on rows kept back
from training, calibrates the probabilities, and the score below which a prediction should be
rejected is the lowest at which the kept-back rows reach ``precision``. For scoring, embedding and
softmax layers are multiplied out to one row of class scores a bucket. Whole texts are read.

Fitting uses about ``per_lang`` texts of at most ``max_chars`` characters of each language, and no more than ``MOST_ROWS``
of all languages together (parameters); each row is drawn with its own label.

Cases: a null text, or one without any letter, is ``und`` with score 0 and rejected; letters that
give no feature get the prior; null ids are held out; repeated rows get equal rows, and rows that share
an id keep their own labels; very long texts are read whole, but not fitted on; without
labelled rows everything is ``und``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .sample import held_out, labelled_rows

BUCKET_BITS = 16
GRAMS = (3, 4)
DIM = 16
#: Sampled rows of all languages, which the driver holds as features.
MOST_ROWS = 12_000
_LETTERS = textnum.lower_letters()


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all words and grams of a block."""
    words = textnum.Words(data, offsets, _LETTERS)
    shift = np.uint64(64 - BUCKET_BITS)
    docs, buckets = [words.doc], [(words.hashes() >> shift).astype(np.int32)]
    for kind, size in enumerate(GRAMS, 1):
        doc, h = words.grams(size)
        docs.append(doc)
        buckets.append((textnum.mix(h + np.uint64(kind)) >> shift).astype(np.int32))
    return np.concatenate(docs), np.concatenate(buckets)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in textnum.blocks(batch.column(0)):
            m = len(offsets) - 1
            doc, bucket = features(data, offsets)
            code, count = np.unique(doc.astype(np.int64) << BUCKET_BITS | bucket, return_counts=True)
            cuts = np.searchsorted(code, np.arange(m + 1) << BUCKET_BITS)
            keys = [(code[a:b] & ((1 << BUCKET_BITS) - 1)).astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            counts = [count[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.record_batch([batch.column(1).slice(at, m), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["label", "keys", "counts"])


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # (bucket, label): class scores, embedding times softmax layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, doc: np.ndarray, bucket: np.ndarray, docs: int, count: np.ndarray | None = None) -> np.ndarray:
        total = np.bincount(doc, count, minlength=docs)
        out = np.empty((docs, len(self.labels)))
        for k in range(len(self.labels)):
            each = self.table[:, k][bucket]
            out[:, k] = np.bincount(doc, each if count is None else each * count, minlength=docs)
        return (out / np.maximum(total, 1)[:, None] + self.bias) / self.temperature


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(keys: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, classes: int, epochs: int = 8, batch: int = 32, least_steps: int = 1200, rate: float = 4.0, seed: int = 0):
    """Embeddings (bucket, DIM), softmax layer (DIM, class) and bias, by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIM, classes)).astype(np.float32)
    bias = np.zeros(classes, dtype=np.float32)
    batch = max(1, min(batch, len(keys) // 20))
    epochs = max(epochs, -(-least_steps * batch // max(1, len(keys))))
    steps = max(1, epochs * (-(-len(keys) // batch)))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(keys))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            sizes = np.array([len(keys[r]) for r in rows])
            flat = np.concatenate([keys[r] for r in rows])
            share = np.concatenate([counts[r] / max(1, counts[r].sum()) for r in rows]).astype(np.float32)
            row = np.repeat(np.arange(len(rows)), sizes)
            mean = np.stack([np.bincount(row, embed[flat, d] * share, minlength=len(rows)) for d in range(DIM)], axis=1).astype(np.float32)
            error = _softmax(mean @ layer + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            now = rate * (1 - step / steps) / len(rows)
            step += 1
            back = (error @ layer.T).astype(np.float32)
            layer -= now * (mean.T @ error).astype(np.float32)
            bias -= now * 0.1 * error.sum(axis=0).astype(np.float32)
            # each text moves the buckets it has, in proportion to their share of it; one rate a text keeps long texts from fading
            used, which = np.unique(flat, return_inverse=True)
            for d in range(DIM):
                embed[used, d] -= now * 20 * np.bincount(which, back[row, d] * share, minlength=len(used)).astype(np.float32)
    return embed, layer, bias


def fit(docs: DataFrame, per_lang: int = 1500, max_chars: int = 100_000, precision: float = 0.99, seed: int = 0) -> LanguageModel:
    """From ``docs`` (id, text, label); rows with a null label are left out."""
    languages = docs.filter("label is not null").select("label").distinct().count()
    sample = labelled_rows(docs, min(per_lang, MOST_ROWS // max(1, languages) + 1), max_chars, seed)
    rows = sample.select("text", "label").mapInArrow(_sample_features, "label string, keys binary, counts binary").collect()
    unique = {(bytes(r["keys"]), bytes(r["counts"])): r for r in rows if len(r["keys"])}
    rows = [unique[k] for k in sorted(unique)]
    names = sorted({r["label"] for r in rows})
    if not names:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0))
    keys = [np.frombuffer(r["keys"], dtype=np.int32) for r in rows]
    counts = [np.frombuffer(r["counts"], dtype=np.int32) for r in rows]
    y = np.array([names.index(r["label"]) for r in rows])
    order = np.random.default_rng(seed).permutation(len(rows))
    back, use = order[: len(order) // 5], order[len(order) // 5 :]
    embed, layer, bias = train([keys[i] for i in use], [counts[i] for i in use], y[use], len(names), seed=seed)
    model = LanguageModel(names, embed @ layer, bias.astype(np.float64))
    if len(back):
        flat = np.concatenate([keys[i] for i in back])
        doc = np.repeat(np.arange(len(back)), [len(keys[i]) for i in back])
        logits = model.logits(doc, flat, len(back), np.concatenate([counts[i] for i in back]))
        best = min(np.geomspace(0.05, 4, 60), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(back)), y[back]] + 1e-12).mean())
        model.temperature = float(best)
        p = _softmax(logits / best)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[back]
        down = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= precision)
        model.reject_below = float(top[down[good[-1]]]) if len(good) else 1.0
    return model


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        names = np.array([*model.labels, "und"], dtype=object)
        for batch in batches:
            lang, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            for at, data, offsets in textnum.blocks(batch.column(1)) if model.labels else ():
                m = len(offsets) - 1
                doc, bucket = features(data, offsets)
                p = _softmax(model.logits(doc, bucket, m))
                ascii_letters = np.concatenate([[0], np.cumsum((_LETTERS[data] != 0) & (data < 128))])
                lettered = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for i in np.flatnonzero(~lettered):
                    lettered[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                lang[at : at + m] = np.where(lettered, p.argmax(axis=1), len(names) - 1)
                score[at : at + m] = np.where(lettered, p.max(axis=1), 0)
            yield pa.record_batch(
                [batch.column(0), pa.array(names[lang], pa.string()), pa.array(score), pa.array((score < model.reject_below) | (lang == len(names) - 1))],
                names=[batch.schema.names[0], "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, rejected."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("label"))
    model = fit(known.filter(~held_out(F.col("id"), folds, fold)))
    schema = T.StructType([docs.schema[id_col]]).add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("rejected", T.BooleanType())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(_predict(shared), schema)
    return out.select(id_col, held_out(F.col(id_col), folds, fold).alias("held_out"), "lang_pred", "score", "rejected")
