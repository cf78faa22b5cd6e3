"""Noisy address texts with labelled spans, for training and evaluation."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote, quote_plus

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold, normalize_aligned

#: Chance of each kind of noise at intensity 1, by tier; higher tiers keep the lower ones' kinds.
RATES = {
    1: {
        "casing": 0.3, "fold": 0.2, "abbreviate": 0.2, "spaces": 0.1, "comma_blank": 0.07, "comma_glued": 0.05, "comma": 0.25, "edge": 0.03, "url": 0.05, "suffix": 0.05,
        "unit": 0.05, "truncate": 0.1, "junk_before": 0.05, "junk_after": 0.05, "trailing": 0.03,
    },
    2: {"reorder": 0.2, "swap": 0.1, "split": 0.15, "merge": 0.15, "junk": 0.2, "duplicate": 0.1},
    3: {"typo": 0.4, "transpose": 0.25, "ocr": 0.2, "chaos": 0.3, "mojibake": 0.1},
}
# The parts that a short query keeps, or one that skips some, with the weight of each shape.
PARTIAL = {("postcode", "city"): 0.4, ("street", "house_number"): 0.25, ("street", "house_number", "city"): 0.15, ("postcode",): 0.1, ("city",): 0.1}
SKIPPING = {("street", "city"): 0.5, ("street", "postcode", "city"): 0.3, ("street", "postcode"): 0.2}
# How many records have no target, are short, skip parts, or are still being typed; and how many without a target are junk only.
NO_TARGET, SHORT, SKIP, TYPED, JUNK_ONLY = 0.16, 0.044, 0.06, 0.22, 0.2
# Characters that scanning confuses.
SCANNED = {"o": "0", "l": "1", "i": "1", "s": "5", "b": "8", "e": "c", "m": "rn"}
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
ENDINGS = {"vej": "v.", "gade": "gd.", "allé": "al.", "plads": "pl.", "stræde": "str."}
UNITS = {"st": ("stuen", "stue", "st."), "kld": ("kælder", "kl."), "tv": ("t.v.", "venstre"), "th": ("t.h.", "højre"), "mf": ("m.f.", "midtfor")}
FIELDS = ("street", "house_number", "house_letter", "floor", "door", "sub_locality", "postcode", "city")
SCHEMA = T.StructType().add("id", T.StringType()).add("raw", T.StringType()).add("normalized", T.StringType()).add("target", T.MapType(T.StringType(), T.StringType())).add("tier", T.IntegerType()).add(
    "intensity", T.DoubleType()
).add("noise", T.IntegerType()).add("mutations", T.ArrayType(T.StringType())).add(
    "spans", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("label", T.StringType()))
)
Fields = dict[str, str | None]
Segments = list[tuple[str, str | None]]
Change = Callable[[Segments, random.Random], Segments]


def compose(fields: Fields, rng: random.Random) -> Segments:
    """An address as (text, label) segments; optional parts come and go."""
    line: Segments = [(fields["street"], "street")] if fields.get("street") else []
    if fields.get("house_number"):
        line += [*([(" ", None)] if line else []), (fields["house_number"], "house_number")]
        if fields.get("house_letter"):
            line.append((fields["house_letter"], "house_letter"))
    if line and fields.get("floor") and rng.random() < 0.9:
        line += [(", ", None), (fields["floor"], "floor"), (". ", None)]
        if fields.get("door"):
            line.append((fields["door"], "door"))
    parts = [line] if line else []
    if fields.get("sub_locality") and rng.random() < 0.3:
        parts.append([(fields["sub_locality"], "sub_locality")])
    town: Segments = [(fields["postcode"], "postcode")] if fields.get("postcode") else []
    if fields.get("city") and (not town or rng.random() < 0.8):
        town += [*([(" ", None)] if town else []), (fields["city"], "city")]
    parts += [town] if town else []
    out: Segments = []
    for part in parts:
        out += [*([(rng.choice((", ", " ")), None)] if out else []), *part]
    return out


def shaped(fields: Fields, shapes: dict[tuple[str, ...], float], rng: random.Random) -> Fields | None:
    """The parts of one of the shapes whose parts are all there; none if there is no such shape."""
    fit = [keep for keep in shapes if all(fields.get(part) for part in keep)]
    if not fit:
        return None
    keep = rng.choices(fit, [shapes[k] for k in fit])[0]
    return {name: value if name in keep else None for name, value in fields.items()}


def typed(segments: Segments, rng: random.Random) -> Segments:
    """What has been typed so far, most often nearly all: what is missing goes by the square of a random number."""
    left = sum(len(t) for t, _ in segments)
    left -= int(left * rng.random() ** 2)
    out: Segments = []
    for text, label in segments:
        if left > 0:
            out.append((text[:left], label))
            left -= len(text)
    return out


def junk(rng: random.Random) -> str:
    """Text that is no address: marks, numbers, instructions, people or firms."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.randrange(5)
    if kind == 0:
        return "".join(rng.choice("#*!?-_~xqzkj") for _ in range(rng.randint(2, 7)))
    if kind == 1:  # never four digits, which would be a postcode
        return rng.choice(("tlf ", "nr. ", "")) + digits(rng.randint(5, 10))
    if kind == 2:
        return rng.choice(("ring forst", "bagindgang", "opgang", "levering ved port", "lejlighed")) + rng.choice(("", f" {rng.randint(1, 30)}"))
    name = rng.choice(("Bo", "Ida", "Tove", "Mads", "Lis", "Aksel")) + " " + rng.choice(("Kvist", "Hede", "Brink", "Sund", "Dahl", "Lund")) + rng.choice(("", "sen"))
    return rng.choice(("", "c/o ", "att ")) + name if kind == 3 else name.split()[1] + rng.choice((" ApS", " A/S", " Tømrer", " Klinik", " og Søn"))


def _on_text(change: Callable[[str, random.Random], str], least: int = 3) -> Change:
    """A change of one labelled segment's text, chosen at random."""

    def run(segments: Segments, rng: random.Random) -> Segments:
        at = [i for i, (t, label) in enumerate(segments) if label and len(t) >= least]
        if not at:
            return segments
        i = rng.choice(at)
        return [*segments[:i], (change(segments[i][0], rng), segments[i][1]), *segments[i + 1 :]]

    return run


def _between(change: Callable[[str], str]) -> Change:
    """A change of what lies between the parts."""
    return lambda segments, rng: [(t if label else change(t), label) for t, label in segments]


def _of(labels: tuple[str, ...], change: Callable[[str, random.Random], str]) -> Change:
    return lambda segments, rng: [(change(t, rng) if label in labels else t, label) for t, label in segments]


def _each(change: Callable[[str], str]) -> Change:
    return lambda segments, rng: [(change(t), label) for t, label in segments]


def _typo(text: str, rng: random.Random) -> str:
    i = rng.randrange(len(text))
    for row in KEYBOARD:
        k = row.find(text[i].lower())
        if k >= 0:
            return text[:i] + row[max(0, k - 1) if rng.random() < 0.5 else min(len(row) - 1, k + 1)] + text[i + 1 :]
    return text


def _transpose(text: str, rng: random.Random) -> str:
    i = rng.randrange(len(text) - 1)
    return text[:i] + text[i + 1] + text[i] + text[i + 2 :]


def _scan(text: str, rng: random.Random) -> str:
    at = [i for i, c in enumerate(text) if c.lower() in SCANNED]
    if not at:
        return text
    i = rng.choice(at)
    return text[:i] + SCANNED[text[i].lower()] + text[i + 1 :]


def _chaos(text: str, rng: random.Random) -> str:
    """Letters dropped, doubled and put in."""
    for _ in range(rng.randint(1, 3)):
        i = rng.randrange(len(text))
        text = rng.choice((text[:i] + text[i + 1 :], text[: i + 1] + text[i:], text[:i] + rng.choice("aeinrst") + text[i:])) or text
    return text


def _mojibake(text: str, rng: random.Random) -> str:
    return text.encode().decode("latin-1")


def _blank(text: str, rng: random.Random) -> str:
    i = rng.randrange(1, len(text))
    return text[:i] + " " + text[i:]


def _abbreviate(text: str, rng: random.Random) -> str:
    ending = next((e for e in ENDINGS if text.lower().endswith(e) and len(text) > len(e)), None)
    return text[: -len(ending)] + ENDINGS[ending] if ending else text


def _escape(segments: Segments, rng: random.Random) -> Segments:
    """Escaped as links and forms are: whole, with small letters, with plus signs, blanks only, or twice."""
    way = rng.randrange(5)

    def one(t: str) -> str:
        whole = quote(t, safe="")
        return (whole, re.sub("%..", lambda m: m[0].lower(), whole), quote_plus(t, safe=""), t.replace(" ", "%20"), quote(whole, safe=""))[way]

    return _each(one)(segments, rng)


def _reorder(segments: Segments, rng: random.Random) -> Segments:
    at = next((i for i, (_, label) in enumerate(segments) if label == "postcode"), None)
    return segments if not at else [*segments[at:], (" ", None), *segments[: at - 1]]


def _swap(segments: Segments, rng: random.Random) -> Segments:
    """City before postcode."""
    at = {label: i for i, (_, label) in enumerate(segments) if label in ("postcode", "city")}
    if len(at) < 2:
        return segments
    out = list(segments)
    out[at["postcode"]], out[at["city"]] = segments[at["city"]], segments[at["postcode"]]
    return out


def _edge(segments: Segments, rng: random.Random) -> Segments:
    mark = [(rng.choice("*#/-:"), None)]
    return [*mark, *segments] if rng.random() < 0.5 else [*segments, *mark]


CHANGES: dict[str, Change] = {
    "casing": lambda s, r: _each(r.choice((str.upper, str.lower, str.title, str.swapcase)))(s, r),
    "fold": _each(fold),
    "abbreviate": _of(("street",), _abbreviate),
    "spaces": _between(lambda t: t.replace(" ", "  ")),
    "comma_blank": _between(lambda t: t.replace(",", " ,")),
    "comma_glued": _between(lambda t: t.replace(", ", ",")),
    "comma": _between(lambda t: t.replace(",", "")),
    "edge": _edge,
    "url": _escape,
    "suffix": lambda s, r: [*s, (r.choice((", Danmark", ", DK", " Denmark")), None)],
    "unit": _of(("floor", "door"), lambda t, r: r.choice(UNITS.get(t.lower(), (t,)))),
    "truncate": lambda s, r: s[: max(1, len(s) - 2)],
    "junk_before": lambda s, r: [(junk(r) + r.choice((", ", " ")), None), *s],
    "junk_after": lambda s, r: [*s, (r.choice((", ", " ")) + junk(r), None)],
    "trailing": lambda s, r: [*s, (r.choice((" ", ".", ",")), None)],
    "reorder": _reorder,
    "swap": _swap,
    "split": _on_text(_blank),
    "merge": lambda s, r: [(t.replace(" ", "") if label == "street" else t, label) for t, label in s],
    "junk": lambda s, r: [(junk(r) + " ", None), *s, (" " + junk(r) + ", " + junk(r), None)],
    "duplicate": lambda s, r: [*s, (" ", None), s[0]],
    "typo": _on_text(_typo),
    "transpose": _on_text(_transpose),
    "ocr": _on_text(_scan),
    "chaos": _on_text(_chaos),
    "mojibake": _on_text(_mojibake),
}
#: Names that records may list besides those of ``CHANGES``.
STRUCTURAL = ("field_drop", "field_skip", "junk_only", "invalid_postcode", "invalid_house_number", "prefix_cut")


def _shown(segments: Segments) -> str:
    return "".join(t for t, _ in segments)


def _invalid(segments: Segments, label: str, rng: random.Random) -> Segments:
    """With a postcode or house number that no address has."""
    value = "0000" if label == "postcode" else str(rng.randint(10_000, 99_999))
    if all(own != label for _, own in segments):
        segments = [*segments, (" ", None), ("", label)]
    return [(value if own == label else t, own) for t, own in segments]


def spans_of(segments: Segments) -> tuple[str, list[dict]]:
    """The normalised text of segments, and the span of each labelled one in it; one of which nothing is left has none."""
    text, origin = normalize_aligned(_shown(segments))
    spans, at = [], 0
    for part, label in segments:
        own = [i for i, o in enumerate(origin) if at <= o < at + len(part) and text[i] != " "] if label else []
        if own:
            spans.append({"start": own[0], "end": own[-1] + 1, "label": label})
        at += len(part)
    return text, sorted(spans, key=lambda s: s["start"])


def noisy(fields: Fields, tier: int, intensity: float, seed: str) -> dict:
    """One record; a change is listed only if it changed the text. The same seed gives the same record.

    Spans lie in the normalised text. ``target`` has the parts of which a span is left, and is null for a record that no address answers.
    """
    rng = random.Random(seed)
    lost = rng.choice(("invalid_postcode", "invalid_house_number")) if rng.random() < NO_TARGET else None
    if lost and rng.random() < JUNK_ONLY:
        lost = "junk_only"
    done = [lost] if lost else []
    if not lost:
        for name, rate, shapes in (("field_drop", SHORT, PARTIAL), ("field_skip", SKIP, SKIPPING)):
            less = shaped(fields, shapes, rng) if not done and rng.random() < rate else None
            if less:
                fields, done = less, [name]
    segments = [(junk(rng), None)] if lost == "junk_only" else compose(fields, rng)
    before, changes = _shown(segments), []
    for level in range(1, tier + 1):
        for name, rate in RATES[level].items():
            if segments and rng.random() < min(1.0, rate * intensity):
                after = CHANGES[name](segments, rng)
                if _shown(after) != _shown(segments):
                    segments, changes = after, [*changes, name]
    done += changes if _shown(segments) != before else []
    if rng.random() < TYPED:
        after = typed(segments, rng)
        if _shown(after) != _shown(segments):
            segments, done = after, [*done, "prefix_cut"]
    if lost and lost != "junk_only":
        segments = _invalid(segments, lost.removeprefix("invalid_"), rng)
    normalized, spans = spans_of(segments)
    left = {s["label"] for s in spans}
    target = None if lost else {name: fields[name] for name in FIELDS if name in left and fields.get(name)}
    return {"raw": _shown(segments), "normalized": normalized, "target": target, "tier": tier, "intensity": intensity, "noise": len(done), "mutations": done, "spans": spans}


def corpus(addresses: DataFrame, seed: int = 0) -> DataFrame:
    """One noisy record an address (id, street, house_number, house_letter, floor, door[, sub_locality], postcode, city); tier and intensity go by a hash of the id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                rows.append({"id": r["id"], **noisy({name: r.get(name) for name in FIELDS}, int(r["tier"]), float(r["intensity"]), f"{seed}:{r['id']}")})
            yield pd.DataFrame(rows, columns=SCHEMA.fieldNames())

    h = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100))
    tiered = addresses.withColumn("tier", F.when(h < 50, 1).when(h < 80, 2).otherwise(3)).withColumn("intensity", 1.0 + F.pmod(h, F.lit(5)) * 0.5)
    return tiered.mapInPandas(run, SCHEMA)


def sample(rows: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by a hash of the id: any machine draws the same."""
    return rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))).orderBy("_h", id_col).limit(n).drop("_h")
