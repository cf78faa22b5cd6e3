"""Sequence tagging: characters to numbers, labelled spans to tags and back, the best tag path."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = 1
SPANS = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("label", T.StringType()))


def vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """(char, code): the sorted characters of all texts, numbered from 2."""
    chars = texts.select(F.explode(F.split(column, "")).alias("char")).filter("char <> ''").distinct()
    all_ = chars.agg(F.array_sort(F.collect_set("char")).alias("chars"))  # as many as the script has
    return all_.select(F.posexplode("chars").alias("at", "char")).select("char", (F.col("at") + 2).alias("code"))


def encode(c: Column, codes: Column, longest: int = 256) -> Column:
    """Codes of the first ``longest`` characters; ``codes`` maps a character to its code."""
    return F.transform(F.filter(F.split(F.substring(c, 1, longest), ""), lambda x: x != ""), lambda x: F.coalesce(F.element_at(codes, x), F.lit(UNKNOWN)))


def paint(length: int, spans: list[tuple[int, int, str]]) -> list[str]:
    """B-, I- and O tags of ``length`` characters."""
    tags = ["O"] * length
    for start, end, label in spans:
        for i in range(max(0, start), min(end, length)):
            tags[i] = ("B-" if i == start else "I-") + label
    return tags


def spans_of(tags: list[str]) -> list[tuple[int, int, str]]:
    """Spans of a tag sequence; an I- tag that continues nothing begins a span."""
    out: list[list] = []
    before = "O"
    for i, tag in enumerate(tags):
        if tag != "O":
            label = tag[2:]
            if tag[0] == "I" and before != "O" and before[2:] == label:
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1, label])
        before = tag
    return [tuple(x) for x in out]


def best_path(emissions: np.ndarray, transitions: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Tags with the largest sum of scores; the first of equals. Forbidden steps are minus infinity."""
    total = starts + emissions[0]
    back = np.zeros(emissions.shape, dtype=np.int64)
    for i in range(1, len(emissions)):
        each = total[:, None] + transitions
        back[i] = each.argmax(axis=0)
        total = each.max(axis=0) + emissions[i]
    path = [int((total + ends).argmax())]
    for i in range(len(emissions) - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return path[::-1]


def legal_steps(tags: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, starts): 0 where allowed and minus infinity where an I- tag would continue nothing."""
    steps = np.zeros((len(tags), len(tags)))
    starts = np.zeros(len(tags))
    for j, to in enumerate(tags):
        if to[0] == "I":
            starts[j] = -np.inf
            for i, from_ in enumerate(tags):
                if from_ == "O" or from_[2:] != to[2:]:
                    steps[i, j] = -np.inf
    return steps, starts


#: A rule tagger in place of a trained one, whose weights are not public: digits after a word are a house number, four digits a postcode.
RULES = (("postcode", r"\d{4}"), ("house_number", r"\d{1,3}"), ("house_letter", r"(?<=\d)[a-z](?!\w)"), ("street", r"[^\W\d]+(?: [^\W\d]+)*"))
TAGS = ["O", *[f"{p}-{x}" for x, _ in (*RULES, ("city", ""))for p in "BI"]]


def rule_spans(text: str) -> list[tuple[int, int, str]]:
    """Labelled spans of a normalised address text, decoded through the tag path like a model's would be."""
    import re

    scores = np.zeros((max(1, len(text)), len(TAGS)))
    scores[:, 0] = 0.5
    taken = np.zeros(len(text), dtype=bool)
    after_code = False
    for label, pattern in RULES:
        for hit in re.finditer(pattern, text):
            if taken[hit.start() : hit.end()].any():
                continue
            if label == "postcode" and re.search(r"\d", text[hit.start() - 1 : hit.start()] + text[hit.end() : hit.end() + 1]):
                continue
            name = label
            if label == "street" and hit.start() > 0 and re.search(r"\d{4} $", text[: hit.start()]):
                name = "city"
            taken[hit.start() : hit.end()] = True
            for i in range(hit.start(), hit.end()):
                scores[i, TAGS.index(("B-" if i == hit.start() else "I-") + name)] = 1.0
    steps, starts = legal_steps(TAGS)
    path = best_path(scores, steps, starts, np.zeros(len(TAGS)))
    return spans_of([TAGS[t] for t in path][: len(text)])


def segment(c: Column) -> Column:
    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b, "label": x} for a, b, x in rule_spans(t[:256])])

    return run(c)


def decomposed(text: Column, spans: Column, labels: tuple[str, ...]) -> list[Column]:
    """One column a label: the texts of its spans, joined by blanks; null if it has none."""

    def labelled(label: str) -> Column:
        return F.filter(spans, lambda s: s["label"] == label)

    out = []
    for label in labels:
        own = labelled(label)
        texts = F.transform(own, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))
        out.append(F.nullif(F.array_join(texts, " "), F.lit("")).alias(label))
    return out
