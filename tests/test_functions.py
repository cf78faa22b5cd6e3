import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geometry, tagging
from waymark.functions import text as X
from waymark.operators import resolve, synthesize
from waymark.operators.knn import close_members


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("K%25C3%25A6rh%25C3%25B8jen", "kaerhoejen"), ("birke+all%C3%A9", "birke alle"), ("KÃ¦rhÃ¸jen", "kaerhoejen"), ("Birkely 12, att Lone Lund", "birkely 12"),
        ("Birkely 12 c/o Lone, 4030", "birkely 12 c o lone 4030"), ("Nord/Syd.vej  9 -", "nord syd vej 9"), ("Engen 007, 0999 Sted", "engen 7 999 sted"), ("50% af 2+2", "50% af 2 2"), ("att alene", "att alene"), ("", ""),
    ],
)
def test_normalize(raw, want):
    assert X.normalize(raw) == want
    assert X.normalize(want) == want


def test_edit_costs():
    assert [X.edit_distance(*p) for p in (("ab", "abc"), ("abc", "ab"), ("abc", "abd"), ("", ""))] == [2, 3, 1, 0]
    assert X.edit_distance("a" * 300, "a" * 255) == 0


def test_trigrams_and_grades(spark):
    row = spark.sql("SELECT 'cat' a, 'haha' b, 'alpha' c").select(
        X.trigrams(F.col("a")).alias("g"), X.similarity(X.trigrams(F.col("b")), X.trigrams(F.col("c"))).alias("s"),
        *[resolve.house_number_grade(F.lit("12"), F.lit(x)).alias(f"h{x}") for x in ("12", "13", "1")],
    ).first()
    assert set(row.g) == {"  c", " ca", "cat", "at "}
    assert row.s == 0.1
    assert (row.h12, row.h13, row.h1) == (1, 0.5, 0)


def test_word_similarity():
    assert X.word_similarity("word", "two words") == pytest.approx(0.8)
    assert X.word_similarity("", "x") == 0


def test_text_repairs():
    assert X.url_decode("%41%2542+c%") == "ABC"[:2] + " c%" and X.url_decode("a%C3b%A9") == "a\ufffdb\ufffd"
    assert X.repair_mojibake("blÃ¥bÃ¦r") == "blåbær" and X.repair_mojibake("blå") == "blå" and X.repair_mojibake("日Ã¥") == "日Ã¥"
    assert X.fold("Ærø Ålborg é ñ ü ﬁ") == "Aeroe Aalborg e n u fi"


def test_close_members_equal_difflib(spark):
    import difflib

    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(1, 9))) for _ in range(150)})
    tokens = [n[: rng.randint(0, len(n))] + rng.choice("abcxyz") + n[rng.randint(0, len(n)) :] for n in names for _ in range(2)] + names[:5] + [""]
    t, n = (spark.createDataFrame([(x,) for x in sorted(set(v))], f"{c} string") for v, c in ((tokens, "token"), (names, "name")))
    for cutoff, most in ((0.75, 8), (0.8, None)):
        got = {}
        for r in close_members(t, n, cutoff, most).collect():
            got.setdefault(r.token, []).append((r["rank"], r.name))
        for token in set(tokens):
            want = [token] if token in names else difflib.get_close_matches(token, names, n=most or len(names), cutoff=cutoff)
            assert [x for _, x in sorted(got.get(token, []))] == want


def test_shapes():
    square = lambda x, y: [[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]]
    ring = [square(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    (one,) = geometry.united(ring)
    assert len(one) == 2 and geometry._area(one[0]) == 9 and geometry._area(one[1]) == 1
    assert len(geometry.united([square(0, 0), square(5, 0)])) == 2
    assert geometry.simplified([[0, 0], [1, 0.01], [2, 0], [3, 5]], 0.1) == [[0, 0], [2, 0], [3, 5]]


@pytest.mark.parametrize(
    ("wkt", "want"),
    [
        ("POINT (1 2)", '{"type":"Point","coordinates":[1,2]}'), ("POINT Z (1.5 -2 7)", '{"type":"Point","coordinates":[1.5,-2]}'), ("POLYGON ((0 0, 1 0, 1 1, 0 0))", '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'),
        ("POINT EMPTY", None), ("CIRCLE (1 2)", None), ("POLYGON ((0 0, 1 0", None), ("", None),
    ],
)
def test_wkt(wkt, want):
    assert geometry.wkt_to_geojson(wkt) == want


def test_covers_border_and_holes():
    ring = lambda a, b: np.array([[a, a], [b, a], [b, b], [a, b], [a, a]], dtype=float)
    x, y = np.array([1.0, 5.0, 0.0, 10.0, 11.0, 4.0]), np.array([1.0, 5.0, 3.0, 10.0, 5.0, 4.0])
    assert geometry.covers([ring(0, 10), ring(4, 6)], x, y).tolist() == [True, False, True, True, False, True]


def test_tags():
    spans = [(0, 3, "street"), (4, 6, "number")]
    assert tagging.spans_of(tagging.paint(8, spans)) == spans
    assert tagging.spans_of(["I-a", "I-a", "O", "I-b"]) == [(0, 2, "a"), (3, 4, "b")]
    steps, starts = tagging.legal_steps(["O", "B-x", "I-x"])
    assert starts[2] == -math.inf and steps[0, 2] == -math.inf and steps[1, 2] == 0


def test_best_path_is_best():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(20):
        e, t, s, z = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
        score = lambda p: s[p[0]] + z[p[-1]] + sum(e[i, k] for i, k in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert tuple(tagging.best_path(e, t, s, z)) == max(itertools.product(range(3), repeat=4), key=score)


def test_alignment_is_the_normal_form():
    rng = random.Random(6)
    pool = ["%C3%A6", "%25", "%2", "+", "Ã¸", "å", "Å", "é", "ﬁ", "İ", "Σ", ",", ", ", ".", "/", "-", " ", "\u00a0", "\x1c", "0", "007", "7", "c/o ", "att ", "v/", "Ab", "xy", "日", "%FF", "\u0301", "²"]
    for _ in range(4000):
        raw = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        text, places = X.normalize_aligned(raw)
        known = [p for p in places if p >= 0]
        assert text == X.normalize(raw), raw
        assert len(places) == len(text) and known == sorted(known) and all(p < len(raw) for p in known)


FIELDS = {"street": "Kærbrinkvej", "house_number": "012", "house_letter": "B", "floor": "st", "door": "tv", "sub_locality": "Nørre Eng", "postcode": "4812", "city": "Tveby"}


def test_noise_is_reproducible_and_spans_fit():
    seen, lost = set(), 0
    for i in range(3000):
        record = synthesize.noisy(FIELDS, 1 + i % 3, 1 + i % 5 / 2, str(i))
        assert record == synthesize.noisy(FIELDS, 1 + i % 3, 1 + i % 5 / 2, str(i))
        assert record["normalized"] == X.normalize(record["raw"])
        assert record["noise"] == len(record["mutations"]) == len(set(record["mutations"]))
        text, ends = record["normalized"], [0]
        for s in record["spans"]:
            assert ends[-1] <= s["start"] < s["end"] <= len(text) and text[s["start"] : s["end"]].strip() == text[s["start"] : s["end"]]
            ends.append(s["end"])
        if record["target"] is None:
            lost += 1
            assert record["mutations"][0] in synthesize.STRUCTURAL
        else:
            assert set(record["target"]) == {s["label"] for s in record["spans"]}
        seen |= set(record["mutations"])
    assert seen == {*synthesize.CHANGES, *synthesize.STRUCTURAL}
    assert 0.1 < lost / 3000 < 0.22


def test_spans_carry_over():
    text, spans = synthesize.spans_of([("K%C3%A6rvej", "street"), (", c/o Bo, ", None), ("007", "house_number"), ("B", "house_letter"), (",  ", None), ("-", "floor")])
    assert text == "kaervej 7b"
    assert [(text[s["start"] : s["end"]], s["label"]) for s in spans] == [("kaervej", "street"), ("7", "house_number"), ("b", "house_letter")]


def test_short_records():
    rng = random.Random(1)
    for _ in range(50):
        kept = synthesize.shaped({"street": "a", "city": "b", "postcode": None, "house_number": None}, synthesize.PARTIAL, rng)
        assert {k for k, v in kept.items() if v} == {"city"}
    assert synthesize.shaped({"street": "a"}, synthesize.SKIPPING, rng) is None
    cuts = [sum(len(t) for t, _ in synthesize.typed([("abcde", "street"), ("fghij", None)], rng)) for _ in range(400)]
    assert min(cuts) >= 1 and max(cuts) == 10 and sum(c > 5 for c in cuts) > 240
