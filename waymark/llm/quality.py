"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on the statistics by gradient boosting; every path in them is a conjunction
of thresholds, hence a rule. An L1-penalised logistic regression keeps few rules and weighs them,
and the kept rules are compiled into one Spark column expression over the statistics' columns.

Statistics are computed over whole texts, in one pass over their bytes. Fitting uses about
``2 * per_label`` labelled texts of ``max_chars`` characters at most (parameters), weighed by 1 over
their label's sampling share.

Cases: null text counts as empty, whose statistics are all 0; null ids are held out; repeated rows get
equal scores; very long texts are scored whole, but not fitted on; without labels of both kinds every score is the share of label 1 (0.5 if there
are none); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .sample import held_out, labelled_sample
from .toxicity import train_labels

STATISTICS = (
    "bytes", "words", "mean_word", "longest_word", "capitals", "digits", "exclamations", "bars", "stops",
    "commas", "marks", "line_ends", "distinct_words", "distinct_lines", "words_a_line", "common_word",
)
TREES = 60
DEPTH = 3
BINS = 32
LEAST_ROWS = 10
_WORDS = textnum.lower_words()
_LINES = np.where(np.arange(256) == 10, 0, np.where(np.arange(256) == 0, 255, np.arange(256))).astype(np.uint8)
#: Byte classes whose share of a text is a statistic.
_CLASSES = {
    "capitals": [*range(65, 91)], "digits": [*range(48, 58)], "exclamations": [33], "bars": [124], "stops": [46, 63],
    "commas": [44, 59], "marks": [*range(35, 44), *range(58, 63), 64, *range(91, 97), 123, 125, 126], "line_ends": [10],
}


def _distinct(words: textnum.Words, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each text, and the count of its most frequent one."""
    h = words.hashes()
    order = np.lexsort((h, words.doc))
    h, doc = h[order], words.doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(docs, dtype=np.int64)
    np.maximum.at(top, doc[at], np.diff(np.append(at, len(h))))
    return np.bincount(doc[at], minlength=docs), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(text, statistic), in the order of ``STATISTICS``."""
    docs, size = len(offsets) - 1, np.diff(offsets)
    words, lines = textnum.Words(data, offsets, _WORDS), textnum.Words(data, offsets, _LINES)
    length = words.end - words.start
    n, n_lines = np.bincount(words.doc, minlength=docs), np.bincount(lines.doc, minlength=docs)
    longest = np.zeros(docs, dtype=np.int64)
    np.maximum.at(longest, words.doc, length)
    distinct, top = _distinct(words, docs)
    shares = {}
    for name, members in _CLASSES.items():
        flag = np.zeros(256, dtype=bool)
        flag[members] = True
        upto = np.concatenate([[0], np.cumsum(flag[data])])
        shares[name] = (upto[offsets[1:]] - upto[offsets[:-1]]) / np.maximum(1, size)
    one = np.maximum(1, n)
    out = {
        "bytes": size, "words": n, "mean_word": np.bincount(words.doc, length, minlength=docs) / one, "longest_word": longest,
        "distinct_words": distinct / one, "distinct_lines": _distinct(lines, docs)[0] / np.maximum(1, n_lines),
        "words_a_line": n / np.maximum(1, n_lines), "common_word": top / one, **shares,
    }
    return np.stack([out[s].astype(np.float64) for s in STATISTICS], axis=1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anything, text) to (anything, statistics)."""
    for batch in batches:
        out = np.zeros((batch.num_rows, len(STATISTICS)))
        for at, data, offsets in textnum.blocks(batch.column(1)):
            out[at : at + len(offsets) - 1] = statistics(data, offsets)
        yield pa.record_batch([batch.column(0), *[pa.array(out[:, k]) for k in range(len(STATISTICS))]], names=[batch.schema.names[0], *STATISTICS])


def with_statistics(rows: DataFrame) -> DataFrame:
    """``rows`` of (column, text) to (column, one column a statistic)."""
    return rows.mapInArrow(_measure, T.StructType([rows.schema.fields[0], *[T.StructField(s, T.DoubleType()) for s in STATISTICS]]))


#: A rule is a conjunction of (statistic, above, threshold), above meaning > and else <=.
Rule = tuple[tuple[int, bool, float], ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, above, t in rule:
        out &= (x[:, k] > t) if above else (x[:, k] <= t)
    return out


def _grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: Rule, step: np.ndarray, rules: list[Rule]) -> None:
    """One tree on gradient statistics: adds each node's path to ``rules`` and each leaf's step to ``step``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, -1)
    if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        for k in range(x.shape[1]):
            b = binned[rows, k]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, minlength=len(edges[k]) + 1))[:-1] for w in (grad[rows], hess[rows], None))
            ok = (ns >= LEAST_ROWS) & (len(rows) - ns >= LEAST_ROWS)
            gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), -1)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), k, int(gain.argmax()))
    if best[1] < 0:
        step[rows] = -g / (h + 1)
        return
    _, k, at = best
    for above in (False, True):
        side = rows[(binned[rows, k] > at) == above]
        deeper = (*path, (k, above, float(edges[k][at])))
        rules.append(tuple(sorted(deeper)))
        _grow(x, binned, edges, grad, hess, side, deeper, step, rules)


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 0) -> list[Rule]:
    """Distinct paths of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    total, rules = np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        rows = np.sort(rng.permutation(len(x))[: max(1, len(x) // 2)])
        step = np.zeros(len(x))
        grown: list[Rule] = []
        _grow(x, binned, edges, weight * (p - y), weight * p * (1 - p), rows, (), step, grown)
        rules += grown
        total += 0.3 * np.where(np.isin(np.arange(len(x)), rows), step, 0)
    return sorted(set(rules))


def lasso_logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient descent."""
    n, w = weight.sum(), np.zeros(z.shape[1])
    bias = 0.0
    scale = 4 * n / max(1e-9, float(np.linalg.norm(np.sqrt(weight)[:, None] * np.hstack([z, np.ones((len(z), 1))]), 2) ** 2))
    v, v_bias = w.copy(), bias
    for k in range(rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(z @ v + v_bias, -30, 30))) - y) / n
        new = v - scale * (z.T @ error)
        new = np.sign(new) * np.maximum(0, np.abs(new) - scale * penalty)
        new_bias = v_bias - scale * error.sum()
        ahead = k / (k + 3)
        v, v_bias = new + ahead * (new - w), new_bias + ahead * (new_bias - bias)
        w, bias = new, new_bias
    return w, float(bias)


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: np.ndarray
    bias: float

    def expression(self) -> Column:
        """The score as a column over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights.tolist(), strict=True):
            test = F.lit(True)
            for k, above, t in rule:
                c = F.col(STATISTICS[k])
                test = test & ((c > t) if above else (c <= t))
            total = total + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {t:.6g}" for k, above, t in r) for r, w in sorted(zip(self.rules, self.weights.tolist(), strict=True), key=lambda x: -abs(x[1]))]


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 3000, max_chars: int = 100_000, penalty: float = 0.002, seed: int = 0) -> RuleEnsemble:
    """From ``docs`` (id, text) and ``labels`` (id, label 0/1)."""
    sample = labelled_sample(docs, labels, per_label, max_chars, seed).select(F.struct(F.col("label").cast("double"), "weight").alias("of"), "text")
    rows = np.array(sorted({(*r[0], *r[1:]) for r in with_statistics(sample).collect()}), dtype=np.float64).reshape(-1, len(STATISTICS) + 2)
    y, weight, x = rows[:, 0] == 1, rows[:, 1], rows[:, 2:]
    if not len(y) or y.all() or not y.any():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return RuleEnsemble([], np.empty(0), float(np.log(share / (1 - share))))
    # both labels weigh the same while rules are sought, and as in all labelled rows while they are weighed
    even = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rules = tree_rules(x, y.astype(float), even, seed)
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(x), 0))
    w, bias = lasso_logistic(z, y.astype(float), weight, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    if len(kept):  # without the penalty's pull toward zero
        w2, bias = lasso_logistic(z[:, kept], y.astype(float), weight, penalty / 20)
        return RuleEnsemble([rules[k] for k in kept], w2, bias)
    return RuleEnsemble([], np.empty(0), bias)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, fold: int = 1) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit(texts, train_labels(labels, label_col, id_col, folds, fold))
    scored = with_statistics(texts).select("id", model.expression().alias("score"))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
