import base64
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import language, quality, queries, toxicity, warc
from waymark.llm.scratch import SMALL_READS

from . import helpers

BIG = "/root/testdata/sf0.01"


def check_scores(spark, out, sf, label):
    docs = queries.read(spark, sf, "documents")
    assert out.count() == docs.count() and out.select("doc_id").distinct().count() == docs.count()
    rows = out.join(queries.read(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    return np.mean([r.predicted == r[label] for r in rows]), np.mean([r[label] for r in rows])


def test_toxicity_held_out(spark):
    right, share = check_scores(spark, queries.op1_toxicity(spark, BIG), BIG, "toxic")
    assert right >= 0.95 and right > 1 - share


def test_toxicity_learns_words_that_3000_texts_support(spark):
    rows = [(i, f"common words {letters(i)} " + (f"nasty {'skunk' if i < 50 else ''}" if i % 2 == 0 else "mild"), int(i % 2 == 0)) for i in range(6000)]
    data = spark.createDataFrame(rows, "id long, text string, label long")
    model = toxicity.fit(data.select("id", "text"), data.select("id", "label"))
    words = toxicity.textnum.Words(np.frombuffer(b"skunk", dtype=np.uint8), np.array([0, 5]), toxicity._LETTERS)
    skunk = next(toxicity._kinds(words)) >> np.uint64(32)
    assert np.isin(skunk.astype(np.uint32), model.entries).all()  # 25 toxic texts have it


def letters(i):
    return "".join(chr(97 + int(d)) for d in str(i))


def test_toxicity_of_a_smaller_sample(spark):
    # a twentieth is toxic; of the texts with "maybe" 4 in 10 are, too few for the lexicon
    rng = np.random.default_rng(5)
    bad = ["skunk", "stoat", "viper", "hyena", "leech", "toads", "roach", "swine", "louse", "mange"]
    rows = []
    for i in range(8000):
        toxic = i % 20 == 0
        has = [*rng.choice(bad, 3, replace=False), "maybe"] if toxic else ["calm", *["maybe"] * (i % 12 == 5)]
        rows.append((i, f"text {letters(i)} {' '.join(has)}", int(toxic)))
    data = spark.createDataFrame(rows, "id long, text string, label long")
    docs, labels = data.select("id", "text"), data.select("id", "label")
    probe = spark.createDataFrame([(1, "text jjjj calm maybe"), (2, "text jjjj skunk stoat viper"), (3, "text jjjj calm")], "doc_id long, text string")
    full, small = (toxicity.fit(docs, labels, n) for n in (10**6, 300))
    assert full.entries.tolist() == small.entries.tolist()
    for model in (full, small):
        assert {r.doc_id: r.score >= 0.5 for r in toxicity.score(probe, model).collect()} == {1: False, 2: True, 3: False}


def test_quality_of_a_smaller_sample(spark):
    # 7 in 10 of the texts with a bar are good, so most of them are predicted so
    rng = np.random.default_rng(4)
    kind, luck = rng.choice(3, 12000, p=[0.7, 0.2, 0.1]), rng.random(12000)
    good = (kind == 0) | (kind == 1) & (luck < 0.7)
    fill = [" ".join(c * n for c, n in zip("xyzEF7,;.x", sizes, strict=True)) for sizes in rng.integers(1, 40, (12000, 10))]
    rows = [(i, f"text {letters(i)} {('calm', 'a|b', '!!!!')[kind[i]]} {fill[i]}", int(good[i])) for i in range(12000)]
    data = spark.createDataFrame(rows, "id long, text string, label long")
    docs, labels = data.select("id", "text"), data.select("id", "label")
    measured = quality.with_statistics(docs).cache()
    full, small = (np.array([r[0] for r in measured.select(quality.fit(docs, labels, n).expression(), "id").sort("id").collect()]) for n in (10**6, 1500))
    assert ((full >= 0.5) == (small >= 0.5)).mean() > 0.95
    assert abs(full[kind == 1].mean() - small[kind == 1].mean()) < 0.1


def test_label_model_weighs_rows():
    rng = np.random.default_rng(3)
    y = rng.random(8000) < 0.1
    votes = np.stack([np.where(rng.random(8000) < 0.9, y, ~y) * 2 - 1 for _ in range(5)], axis=1).astype(int)
    start = np.where(votes.sum(axis=1) > 0, 0.8, 0.2)
    full = toxicity.LabelModel.fit(votes, start)
    drawn = y | (rng.random(8000) < 0.1)
    small = toxicity.LabelModel.fit(votes[drawn], start[drawn], row_weight=np.where(y, 1, 10)[drawn])
    assert abs(full.prior - small.prior) < 0.02


def test_sparse_logistic_equals_dense():
    rng = np.random.default_rng(2)
    hit, dense, target, weight = rng.random((300, 12)) < 0.2, rng.random((300, 3)), rng.random(300), rng.random(300) + 0.5
    text, entry = np.nonzero(hit)
    w = toxicity._logistic(text, entry, 12, dense, target, weight, 1e-2, 3000)
    x = np.hstack([hit, dense, np.ones((300, 1))])
    gradient = x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - target)) / weight.sum() + 1e-2 * np.append(w[:-1], 0)
    assert np.abs(gradient).max() < 1e-5


def test_quality_held_out(spark):
    right, share = check_scores(spark, queries.op7_quality(spark, BIG), BIG, "quality")
    assert right >= 0.95 and right > share


def test_language_held_out(spark):
    out = queries.op4_language(spark, BIG)
    rows = out.join(queries.read(spark, BIG, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.98
    assert np.mean([r.lang_pred == r.lang for r in rows if not r.rejected]) >= 0.98


def test_label_model_finds_accurate_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < 0.9, y, ~y) * 2 - 1, np.where(rng.random(4000) < 0.8, y, ~y) * 2 - 1, np.where(rng.random(4000) < 0.7, y, ~y) * 2 - 1, rng.integers(-1, 2, 4000)], axis=1).astype(int)
    votes = np.hstack([votes, votes[:, 2:3]])  # an exact copy of a voter
    model = toxicity.LabelModel.fit(votes, np.where(votes.sum(axis=1) > 0, 0.8, 0.2))
    strength = model.log_odds[:, 2] - model.log_odds[:, 0]
    assert strength[0] > strength[1] > abs(strength[3]) and model.weight[2] < 0.75 and model.weight[0] > 0.75
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.88


def test_label_model_beats_majority_vote():
    """Five copies of a poor voter outvote three good ones, but not in the model."""
    rng = np.random.default_rng(6)
    y = rng.random(6000) < 0.4
    good = [np.where(rng.random(6000) < 0.85, y, ~y) for _ in range(3)]
    poor = np.where(rng.random(6000) < 0.6, y, ~y)
    copies = [np.where(rng.random(6000) < 0.95, poor, ~poor) for _ in range(5)]
    votes = np.stack([*good, *copies], axis=1).astype(int) * 2 - 1
    model = toxicity.LabelModel.fit(votes, np.where(votes[:, :3].sum(axis=1) > 0, 0.7, 0.3))
    right, majority = ((model.posterior(votes) > 0.5) == y).mean(), ((votes.sum(axis=1) > 0) == y).mean()
    assert right > majority + 0.05 and model.correlation[3, 4] > 0.5 > abs(model.correlation[0, 3])


def plain_score(model, text):
    """What the fitted classifier gives one text, word by word."""
    raw = text.encode()
    style = toxicity.patterns(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[0] @ model.style
    lowered = bytes(b + 32 if 65 <= b < 91 else b for b in raw)
    words = [w for w in __import__("re").split(rb"[^a-z\x80-\xff]+", lowered) if w]
    counts = {}
    for w in words:
        own = toxicity.textnum.Words(np.frombuffer(w, dtype=np.uint8), np.array([0, len(w)]), toxicity._LETTERS)
        for h in toxicity._kinds(own):
            code = int(h[0] >> np.uint64(32))
            if code:
                counts[code] = counts.get(code, 0) + 1
    total = model.bias + style
    for k, code in enumerate(model.entries.tolist()):
        total += sum(w for w, least in zip(model.weights[k], toxicity.LEVELS, strict=True) if counts.get(code, 0) >= least)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def test_toxicity_scores_every_row_like_a_plain_scorer(spark, sf):
    docs, labels = queries.read(spark, sf, "documents"), queries.read(spark, sf, "labels")
    model = toxicity.fit(docs.selectExpr("doc_id as id", "text"), toxicity.train_labels(labels, "toxic", "doc_id", 5, 0))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    want = {r.doc_id: plain_score(model, r.text or "") for r in docs.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_toxicity_keeps_what_executors_hold_small(spark, sf):
    """No plan sorts, aggregates or shuffles the hashes of the sample, and texts are read in small batches."""
    store = spark._jsparkSession.sharedState().statusStore()
    ran = {store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())}
    seen, score = [], toxicity.score

    def scored(*args):
        seen.append({name: spark.conf.get(name) for name in SMALL_READS})
        return score(*args)

    toxicity.score = scored
    try:
        before = {name: spark.conf.get(name, None) for name in SMALL_READS}
        queries.op1_toxicity(spark, sf).count()
    finally:
        toxicity.score = score
    assert seen == [{name: str(most) for name, most in SMALL_READS.items()}] and before == {name: spark.conf.get(name, None) for name in SMALL_READS}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executions = [store.executionsList().apply(k) for k in range(store.executionsList().size())]
    plans = [x.physicalPlanDescription() for x in executions if x.executionId() not in ran]
    assert any("keys#" in plan for plan in plans)
    for node in (node for plan in plans for node in plan.split("\n\n")):
        assert "keys#" not in node or not re.match(r"\s*\(\d+\) (Exchange|Sort|\w*Aggregate)\b", node), node


def test_toxicity_counts_copies_once(spark):
    rows = [(i, f"text {letters(i)} {'skunk stoat' if i % 3 == 0 else 'calm'}", int(i % 3 == 0)) for i in range(900)]
    again = [(1000 + k, t, toxic) for k, (_, t, toxic) in enumerate(rows[:300] * 3)]
    mixed = [(5000, "Text, jjj calm", 1), (5001, "text jjj calm calm", 0), (5002, "text jjj calm", 0)]  # equal words, or as many as that
    one = spark.createDataFrame([*rows, mixed[0]], "id long, text string, label long")
    many = spark.createDataFrame([*again, *mixed[::2], *rows], "id long, text string, label long").repartition(7)
    first, other = (toxicity.fit(d.select("id", "text"), d.select("id", "label"), 10**6) for d in (one, many))
    assert first.entries.tolist() == other.entries.tolist() and np.allclose(first.weights, other.weights) and first.bias == pytest.approx(other.bias)


def test_languages_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(8)
    vocabulary = {"de": ["und", "nicht", "haus", "strasse", "wir", "gehen"], "en": ["and", "not", "house", "street", "we", "walk"]}
    rows = [(5 if i % 2 else i, " ".join(rng.choice(vocabulary[lang], 20)), lang) for i in range(400) for lang in vocabulary]
    out = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = {(i, t): lang for i, t, lang in rows}
    assert [r.lang_pred for r in out.collect()] == [want[i, t] for i, t, _ in rows]


def test_samples_are_bounded(spark):
    from waymark.llm.sample import labelled_rows, labelled_sample

    docs = spark.range(3000).selectExpr("id % 3 as id", "concat('t', id) as text", "id % 2 as label")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 1), (2, 1)], "id long, label long")
    got = labelled_sample(docs.select("id", "text"), labels, 100, 1000).collect()
    assert 100 < len(got) < 500 and {r.label for r in got} == {0, 1}
    assert sum(r.weight for r in got if r.label == 1) == pytest.approx(2000, rel=0.4)
    assert len(labelled_rows(docs, 100, 1000).collect()) < 500


def test_rules_compile_to_what_they_hold(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] <= 0.6)).astype(float)
    rules = quality.tree_rules(x, y, np.ones(400))
    z = np.stack([quality.holds(r, x) for r in rules], axis=1).astype(float)
    w, bias = quality.lasso_logistic(z, y, np.ones(400), 0.002)
    kept = np.flatnonzero(w)
    assert 0 < len(kept) < len(rules)
    model = quality.RuleEnsemble([rules[k] for k in kept], w[kept], bias)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = np.array([r.s for r in df.select(model.expression().alias("s")).collect()])
    want = 1 / (1 + np.exp(-(z[:, kept] @ w[kept] + bias)))
    assert np.allclose(got, want) and ((got >= 0.5) == (y == 1)).mean() > 0.97 and len(model.describe()) == len(kept)


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(helpers.hard_cases(), helpers.DOCS)


def test_models_on_hard_rows(spark, hard):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(17)] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    for labels_ in (labels, labels.limit(0)):
        for out in (toxicity.toxicity(hard, labels_), quality.quality(hard, labels_)):
            rows = out.collect()
            assert len(rows) == hard.count() and all(0 <= r.score <= 1 for r in rows) and all(r.held_out for r in rows if r.doc_id is None)
        assert toxicity.toxicity(hard.limit(0), labels_).count() == quality.quality(hard.limit(0), labels_).count() == 0
    rows = {(r.doc_id): r for r in language.identify(hard).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[15].lang_pred == "und" and rows[6].lang_pred == "en" and rows[16].lang_pred == "en"
    assert language.identify(hard.limit(0)).count() == 0
    unlabelled = hard.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def plain_archive(rows, least=0):
    """{(page, payload): (digest, type, refers to)}."""
    first = {}
    for i, html in rows:
        if i is not None and html not in first or i is not None and i < first[html]:
            first[html] = i
    out = {}
    for i, html in rows:
        digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
        again = len(html) >= least and html in first and i != first[html]
        out[i, html] = (len(html), digest, "revisit" if again else "response", first[html] if again else None)
    return out


def check_archive(pages, out, least=0):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    want = plain_archive(rows, least)
    got = out.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(((i, *want[i, h]) for i, h in rows), key=repr)


def test_archive(spark, sf):
    check_archive(queries.read(spark, sf, "pages"), queries.op10_warc(spark, sf))


def test_archive_hard(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, f"http://h{i % 4}.example.org/p?{i % 7}", ("same" if i % 3 == 0 else f"page {i} " * (i % 50))) for i in range(200)]
    rows += [(500, None, None), (501, "", ""), (502, "not a url\n", None), (None, "http://x.org", "lone"), (503, "http://a.org:99/ü", "ü" * 20000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    check_archive(pages, warc.archive_pages(pages))
    check_archive(pages, warc.archive_pages(pages, min_bytes=5), 5)
    assert warc.archive_pages(pages.limit(0)).count() == 0
    same = spark.createDataFrame([(None, None, "x")] * 600 + [(1, "http://a.org", "y")] * 600, "page_id long, url string, html string")
    check_archive(same, warc.archive_pages(same))
    odd = [("null", "http://a.org", "one", "k", 1), (None, "http://a.org", "two", "k", 2), ("a>\r\nX: 1 %41", "u\r\n: ü", "three", None, 3), ("", None, "four", "", 4), ("~", "http://a.org", "one", "", 5)]
    odd = spark.createDataFrame(odd, "page_id string, url string, html string, key string, archive int")
    check_archive(odd, warc.archive_pages(odd))


@pytest.mark.parametrize("top", [100_000, 4])
def test_index_lookup(spark, monkeypatch, top, tmp_path):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    monkeypatch.setattr(warc, "TOP_KEYS", top)
    rows = [(i, f"http://www.h{i % 9}.example.org/{i // 9 % 5}", f"body {i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/out"
    index = warc.CaptureIndex(warc.write_archives(pages, folder))
    assert len(index.captures_of(rows[10][1])) == sum(u == rows[10][1] for _, u, _ in rows)
    assert index.captures_of("http://nowhere.example.org/") == []
    keys = spark.createDataFrame([(warc.capture_key(u, str(i)),) for i, u, _ in rows] + [("none",)], "key string")
    assert index.lookup(keys).count() == 300
    found = warc.read_records(folder, index.lookup(keys))
    assert {int(r.page) for r in found.collect()} == set(range(300))
    import gzip

    files = [f for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")]
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == 300


@pytest.mark.parametrize("top", [100_000, 2])
def test_index_lookup_of_repeated_keys(spark, monkeypatch, top, tmp_path):
    monkeypatch.setattr(warc, "TOP_KEYS", top)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # so that the pair's lines are the 256th and the 257th
    try:
        copies = [1] * 255 + [2, 600] + [1] * 300
        rows = [(i if i != 256 else None, f"http://a.org/{i:04d}", f"body {i}") for i, n in enumerate(copies) for _ in range(n)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        index = warc.CaptureIndex(warc.write_archives(pages, f"file://{tmp_path}/out"))
        assert index.blocks.count() > 4 and (index.stride == 1) == (top > 2)
        keys = [warc.capture_key(u, None if i is None else str(i)) for i, u, _ in rows]
        found = index.lookup(spark.createDataFrame([(k,) for k in [*keys, "none", "zzz"]], "key string")).collect()
        assert sorted(r.key for r in found) == sorted(keys) and len({(r.archive, r.offset) for r in found}) == len(rows)
        check_archive(pages, warc.archive_pages(pages))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_surt():
    assert warc.surt("http://www.Example.com:80/a?b=1") == "com,example,www)/a?b=1"
    assert warc.surt("https://example.com:8443") == "com,example:8443)/" and warc.surt(None) == "" and warc.surt("plain") == "plain"
