"""Toxicity by weak supervision.

Voters: lexicons of words and of word beginnings, each found once or several times in a text, whose
documents are toxic far more often than chance allows, a fixed word list, and patterns of shouting and punctuation. A generative label
model (expectation maximisation) estimates how each voter behaves in either class; voters that agree
beyond what the classes explain share their weight. A linear classifier over the lexicon entries
and patterns is then trained on the model's posterior labels. Scoring reads whole texts.

Fitting uses a sample of at most about ``2 * per_label`` labelled texts of ``max_chars`` characters at
most (parameters), weighed by 1 over their label's sampling share; scoring covers every row. Executors hash the sample and count what its texts reach; the
driver gets digests of the sample's texts, of which it picks one of each group with equal words, then the mined entries, then which of them each text has.
Hashes and counts of a text are written and read, but never sorted or shuffled, and texts are read in small batches: an executor's heap keeps the size that it once grew to.

Cases: null text counts as empty and an empty text gets the score of a text without any hit; null ids
are held out; repeated rows get the same score; an id with several labels has the largest; very long texts are
scored whole, but not fitted on; without any labelled row the score is the prior 0; an empty table gives an empty result. Extra columns are not read; :func:`keep_clean` passes them on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .sample import held_out, labelled_sample
from .scratch import small_reads, table

#: Word beginnings of so many bytes are lexicon candidates, besides whole words.
STEMS = (4, 5, 6)
#: An entry is a word or beginning with how often a text must have it.
LEVELS = (1, 2, 3, 5)
#: Lexicons; each votes as one.
GROUPS = 32
#: Entries that are mined at most, the most telling first (a parameter that bounds what the driver holds).
MAX_ENTRIES = 2000
#: Sample texts whose hashes are worked on together.
SLICE = 100
#: Natural log of the chance at which an entry's documents may be this toxic by accident.
LOG_CHANCE = -14.0
#: Common English insults.
WORDS = ("idiot", "moron", "stupid", "loser", "worthless", "pathetic", "disgusting", "scum", "trash", "clown", "dumb", "ugly", "filthy", "vermin", "imbecile", "cretin")
_LETTERS = textnum.lower_letters()
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def _kinds(words: textnum.Words) -> Iterator[np.ndarray]:
    """Hashes of the words, then of their beginnings (0 where a word is shorter). Lexicons hold their upper halves."""
    yield textnum.mix(words.hashes())
    length = words.end - words.start
    for kind, stem in enumerate(STEMS, 1):
        h = textnum.mix(words.hashes(stem) + np.uint64(kind))
        h[length < stem] = 0
        yield h


def fixed_entries() -> np.ndarray:
    text = " ".join(WORDS).encode()
    words = textnum.Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), _LETTERS)
    return (textnum.mix(words.hashes()) >> np.uint64(32)).astype(np.uint32)


def patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: shares of capitals, exclamation marks, digits and bars, and log length."""
    size = np.maximum(1, np.diff(offsets))
    out = np.empty((len(offsets) - 1, 5))
    for k, flag in enumerate((_UPPER[data], data == 33, (data >= 48) & (data < 58), data == 124)):
        upto = np.concatenate([[0], np.cumsum(flag)])
        out[:, k] = (upto[offsets[1:]] - upto[offsets[:-1]]) / size
    out[:, 4] = np.log1p(np.diff(offsets)) / 10
    return out


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, weights = batch.column(1), batch.column(2)
        for at, data, offsets in textnum.blocks(batch.column(0)):
            words = textnum.Words(data, offsets, _LETTERS)
            m = len(offsets) - 1
            cuts = np.searchsorted(words.doc, np.arange(m + 1))
            kinds = list(_kinds(words))
            short = [(h >> np.uint64(32)).astype(np.uint32) for h in kinds]
            found = [np.unique(np.concatenate([h[cuts[d] : cuts[d + 1]] for h in short]), return_counts=True) for d in range(m)]
            keys = [k.tobytes() for k, _ in found]
            counts = [np.minimum(n, 255).astype(np.uint8).tobytes() for _, n in found]
            style = [x.tobytes() for x in patterns(data, offsets)]
            name = [hashlib.md5(k).digest() for k in keys]
            rank = [hashlib.md5(c + x).digest() for c, x in zip(counts, style, strict=True)]
            yield pa.record_batch(
                [labels.slice(at, m), weights.slice(at, m), *(pa.array(x, pa.binary()) for x in (name, rank, keys, counts, style))],
                names=["label", "weight", "name", "rank", "keys", "counts", "style"],
            )


def _once(features: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with equal words the one of largest label, weight and ``rank``: its row, whether it is toxic, what it weighs."""
    best: dict[bytes, tuple] = {}
    # as many rows as the sample has, of some 60 bytes
    for r in features.select("name", "label", "weight", "rank", "row").collect():
        name, of = bytes(r["name"]), (r["label"], r["weight"], bytes(r["rank"]), r["row"])
        best[name] = max(best.get(name, of), of)
    of = [best[name] for name in sorted(best)]
    return np.array([o[3] for o in of], dtype=np.int64), np.array([o[0] == 1 for o in of], dtype=bool), np.array([o[1] for o in of], dtype=np.float64)


@dataclass
class LabelModel:
    """Class-conditional behaviour of voters that say 1, -1 or nothing (0)."""

    prior: float
    log_odds: np.ndarray  # (voter, vote + 1): log p(vote | 1) - log p(vote | 0)
    weight: np.ndarray
    correlation: np.ndarray  # (voter, voter): of what the classes do not explain

    @staticmethod
    def fit(votes: np.ndarray, start: np.ndarray, rounds: int = 30, row_weight: np.ndarray | None = None) -> LabelModel:
        """From ``votes`` (text, voter), first guesses of the posterior, and what each text weighs (in proportion)."""
        post, n = start.copy(), len(votes)
        each = np.ones(n) if row_weight is None else row_weight * (n / row_weight.sum())
        says = np.stack([(votes == v) for v in (-1, 0, 1)], axis=2).astype(np.float64)
        weight = np.ones(votes.shape[1])
        for _ in range(rounds):
            of1, of0 = each * post, each * (1 - post)
            prior = float(np.clip((of1.sum() + 1) / (n + 2), 0.01, 0.99))
            p1 = (np.einsum("nvk,n->vk", says, of1) + 1) / (of1.sum() + 3)
            p0 = (np.einsum("nvk,n->vk", says, of0) + 1) / (of0.sum() + 3)
            log_odds = np.log(p1) - np.log(p0)
            # what two voters share beyond the classes: correlation of what the class means leave
            expected = post[:, None] * (p1[:, 2] - p1[:, 0]) + (1 - post[:, None]) * (p0[:, 2] - p0[:, 0])
            rest = votes - expected
            scale = np.sqrt((each[:, None] * rest**2).mean(axis=0)) + 1e-9
            corr = (rest.T @ (each[:, None] * rest)) / n / np.outer(scale, scale)
            shared = np.clip(corr, 0, 1)
            np.fill_diagonal(shared, 0)
            weight = 1 / (1 + np.where(shared > 0.1, shared, 0).sum(axis=1))
            total = np.log(prior / (1 - prior)) + np.einsum("nvk,vk,v->n", says, log_odds, weight)
            new = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            done = np.abs(new - post).max() < 1e-4
            post = new
            if done:
                break
        return LabelModel(prior, log_odds, weight, corr)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        picked = self.log_odds[np.arange(votes.shape[1]), votes + 1]
        total = np.log(self.prior / (1 - self.prior)) + picked @ self.weight
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


@dataclass
class Classifier:
    """A linear model over patterns and ``entries`` (sorted hashes), with a weight for each of ``LEVELS``."""

    entries: np.ndarray
    weights: np.ndarray  # (entry, level): what reaching the level adds
    style: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        docs = len(offsets) - 1
        total = self.bias + patterns(data, offsets) @ self.style
        if len(self.entries):
            words = textnum.Words(data, offsets, _LETTERS)
            likely = np.zeros(1 << 16, dtype=bool)
            likely[self.entries >> np.uint32(16)] = True
            hits = []
            for h in _kinds(words):
                at = np.flatnonzero(likely[(h >> np.uint64(48)).astype(np.int64)])
                own = (h[at] >> np.uint64(32)).astype(np.uint32)
                entry = np.minimum(np.searchsorted(self.entries, own), len(self.entries) - 1)
                real = self.entries[entry] == own
                hits.append(words.doc[at[real]] * len(self.entries) + entry[real])
            once, count = np.unique(np.concatenate(hits), return_counts=True)
            reached = np.cumsum(self.weights, axis=1)[once % len(self.entries), np.searchsorted(LEVELS, count, "right") - 1]
            total = total + np.bincount(once // len(self.entries), reached, minlength=docs)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _reached(keys: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of what each text reaches; a code is hash and level."""
    keys = keys.to_pylist()
    text = np.repeat(np.arange(len(keys)), [len(k) // 4 for k in keys])
    hashes = np.frombuffer(b"".join(keys), dtype=np.uint32).astype(np.int64)
    count = np.frombuffer(b"".join(counts.to_pylist()), dtype=np.uint8)
    at = [(text[count >= n], hashes[count >= n] * len(LEVELS) + k) for k, n in enumerate(LEVELS)]
    return np.concatenate([t for t, _ in at]), np.concatenate([c for _, c in at])


def _slices(batches: Iterator[pa.RecordBatch], kept: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose number, in the last column, is one of ``kept``."""
    for batch in batches:
        batch = batch.filter(pa.array(np.isin(batch.column(batch.num_columns - 1).to_numpy(), kept)))
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _count_codes(kept: np.ndarray):
    """(label, keys, counts, row) to (code, texts, toxic texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, kept):
            text, code = _reached(batch.column(1), batch.column(2))
            toxic = (batch.column(0).to_numpy() == 1)[text]
            known, which = np.unique(code, return_inverse=True)
            n, pos = np.bincount(which, minlength=len(known)), np.bincount(which, toxic, minlength=len(known)).astype(np.int64)
            yield pa.record_batch([pa.array(known), pa.array(n), pa.array(pos)], names=["code", "n", "pos"])

    return run


def _log_tail(n: np.ndarray, pos: np.ndarray, p: float, ratio: float) -> np.ndarray:
    """Chernoff's bound of the binomial tail, for codes of so many texts and toxic texts; 0 where too few are toxic.

    Chance works on the sample as drawn, with its share ``p`` of toxic texts. Whether enough are toxic is asked of
    all texts, where a toxic one stands for ``ratio`` times as many as another.
    """
    q = np.clip(pos / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    tail = -n * (q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p)))
    all_p, all_q = ratio * p / (ratio * p + 1 - p), ratio * q / (ratio * q + 1 - q)
    return np.where((q > p) & (all_q >= min(0.9, 3 * all_p + 0.3)), tail, 0)


def _mine(rows: DataFrame, kept: np.ndarray, p: float, ratio: float) -> np.ndarray:
    """Codes found in toxic texts more often than chance at the share ``p`` of toxic texts allows."""

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n, pos = (c.to_numpy() for c in batch.columns)
            yield pa.record_batch([batch.column(0), pa.array(_log_tail(n, pos, p, ratio))], names=["code", "log_tail"])

    counts = rows.select("label", "keys", "counts", "row").mapInArrow(_count_codes(kept), "code long, n long, pos long")
    # hash 0 stands for words shorter than the beginning
    summed = counts.filter(F.col("code") >= len(LEVELS)).groupBy("code").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    good = summed.mapInArrow(tails, "code long, log_tail double").filter(F.col("log_tail") <= LOG_CHANCE)
    return np.sort(np.array([r.code for r in good.orderBy("log_tail", "code").limit(MAX_ENTRIES).collect()], dtype=np.int64))


def _find_hits(codes: np.ndarray, kept: np.ndarray):
    """(name, label, weight, keys, counts, style, row) to what the driver fits on: which ``codes`` a text has, and whether it has a listed word."""
    fixed = fixed_entries()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, kept):
            keys, m = batch.column(3).to_pylist(), batch.num_rows
            text, code = _reached(batch.column(3), batch.column(4))
            at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            real = codes[at] == code if len(codes) else np.zeros(len(code), dtype=bool)
            text, at = text[real], at[real].astype(np.int32)
            hits = [at[text == d].tobytes() for d in range(m)]
            listed = [bool(np.isin(fixed, np.frombuffer(k, dtype=np.uint32)).any()) for k in keys]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(hits, pa.binary()), pa.array(listed), batch.column(5)],
                names=["name", "label", "weight", "hits", "listed", "style"],
            )

    return run


def _logistic(text: np.ndarray, entry: np.ndarray, entries: int, dense: np.ndarray, target: np.ndarray, weight: np.ndarray, l2: float, rounds: int = 300) -> np.ndarray:
    """Weights (bias last) by accelerated gradient descent on weighted soft targets.

    A text's features are 1 for each ``entry`` that it has, then its row of ``dense``.
    """
    docs = len(target)
    dense = np.hstack([dense, np.ones((docs, 1))])
    square = np.bincount(text, minlength=docs) + (dense**2).sum(axis=1)
    step = 4 * weight.sum() / max(1e-9, float((weight * square).sum()))
    w = v = np.zeros(entries + dense.shape[1])
    ridge = np.full(len(v), l2)
    ridge[-1] = 0
    for k in range(rounds):
        total = np.bincount(text, v[entry], minlength=docs) + dense @ v[entries:]
        error = weight * (1 / (1 + np.exp(-np.clip(total, -30, 30))) - target) / weight.sum()
        new = v - step * (np.concatenate([np.bincount(entry, error[text], minlength=entries), dense.T @ error]) + ridge * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 3000, max_chars: int = 100_000, seed: int = 0, scope: str = "") -> Classifier:
    """From ``docs`` (id, text) and ``labels`` (id, label 0/1)."""
    # texts are dealt out, which are smaller than what is known of them
    sample = labelled_sample(docs, labels, per_label, max_chars, seed).repartition("id", "text").select("text", "label", "weight")
    hashed = sample.mapInArrow(textnum.tidy(_sample_features), "label long, weight double, name binary, rank binary, keys binary, counts binary, style binary")
    with small_reads(docs.sparkSession):
        features = table(hashed.withColumn("row", F.monotonically_increasing_id()), "toxicity-features", scope)
    kept, toxic, each = _once(features)  # copies count once
    if toxic.all() or not toxic.any():
        return Classifier(np.empty(0, np.uint32), np.empty((0, len(LEVELS))), np.zeros(5), 10.0 if toxic.any() else -10.0)
    codes = _mine(features, kept, toxic.mean(), each[toxic].mean() / each[~toxic].mean())
    known = features.select("name", "label", "weight", "keys", "counts", "style", "row")
    found = known.mapInArrow(_find_hits(codes, kept), "name binary, label long, weight double, hits binary, listed boolean, style binary")
    rows = sorted(found.collect(), key=lambda r: bytes(r["name"]))
    y, weight = np.array([r["label"] == 1 for r in rows], dtype=bool), np.array([r["weight"] for r in rows])
    style = np.stack([np.frombuffer(r["style"]) for r in rows])
    own = [np.frombuffer(r["hits"], dtype=np.int32) for r in rows]
    text, entry = np.repeat(np.arange(len(rows)), [len(h) for h in own]), np.concatenate(own)
    listed = np.array([r["listed"] for r in rows], dtype=bool)
    # some entries in each of several lexicons: each votes for toxic or abstains
    lexicons = np.zeros((len(rows), GROUPS), dtype=int)
    lexicons[text, entry % GROUPS] = 1
    hits = np.bincount(text, minlength=len(rows))
    any_hit = (hits > 0) | listed
    shout = np.where(style[:, 0] > 0.3, 1, 0)
    calm = np.where((style[:, 0] < 0.1) & (style[:, 1] < 0.005) & ~any_hit, -1, 0)
    marks = np.where(style[:, 1] > 0.02, 1, 0)
    silent = np.where(any_hit, 0, -1)
    twice = np.where(hits >= 2, 1, 0)
    votes = np.column_stack([lexicons, listed.astype(int), shout, marks, calm, silent, twice])
    share = float(weight @ y / weight.sum())
    model = LabelModel.fit(votes, np.where(any_hit, 0.9, np.clip(share * 0.2, 0.01, 0.2)), row_weight=weight)
    target = model.posterior(votes)
    w = _logistic(text, entry, len(codes), style, target, weight, 1e-4)
    used, place = np.unique(codes // len(LEVELS), return_inverse=True)
    weights = np.zeros((len(used), len(LEVELS)))
    weights[place, codes % len(LEVELS)] = w[: len(codes)]
    return Classifier(used.astype(np.uint32), weights, w[len(codes) : len(codes) + 5], float(w[-1]))


def _scores(shared, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for at, data, offsets in textnum.blocks(batch.column(batch.num_columns - 1)):
                out[at : at + len(offsets) - 1] = shared.value.score(data, offsets)
            kept = [batch.column(c) for c in range(columns)]
            yield pa.record_batch([*kept, pa.array(out)], names=[*batch.schema.names[:columns], "score"])

    return run


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(textnum.tidy(_scores(shared, 1)), schema)


def train_labels(labels: DataFrame, label_col: str, id_col: str, folds: int, fold: int) -> DataFrame:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"))
    return known.filter(~held_out(F.col("id"), folds, fold))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, fold: int = 0) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    model = fit(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), train_labels(labels, label_col, id_col, folds, fold))
    with small_reads(docs.sparkSession):  # written, as a frame would be read later, with other settings
        scores = table(score(docs, model, id_col, text_col), "toxicity-scores")
    return scores.select(
        id_col, held_out(F.col(id_col), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.empty(batch.num_rows, dtype=bool)
            for at, data, offsets in textnum.blocks(batch.column(batch.schema.get_field_index(text_col))):
                clean[at : at + len(offsets) - 1] = shared.value.score(data, offsets) < 0.5
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(textnum.tidy(run), docs.schema)
