"""The pipeline against plain versions of its stages."""

import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from waymark.llm import queries, scratch

from . import helpers
from .test_text_operators import library


def test_stages_and_run(spark, sf, tmp_path):
    docs, columns = queries.read(spark, sf, "documents"), queries.read(spark, sf, "documents").columns
    seen = [{r.doc_id: r for r in docs.collect()}]
    rows = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        rows.append(docs.collect())
        if name != "packing":
            assert docs.columns == columns
    clean = {r.doc_id for r in queries.op1_toxicity(spark, sf).filter("predicted = 0").collect()}
    assert {r.doc_id for r in rows[0]} == clean
    kept = set(helpers.keep_latest([(r.doc_id, r.text) for r in rows[0]]).values())
    assert {r.doc_id for r in rows[1]} == kept and len(rows[1]) == len(kept)
    groups = helpers.components([(r.doc_id, r.text) for r in rows[1]])
    assert {r.doc_id for r in rows[2]} == {root for _, _, root in groups}
    taken, _ = helpers.mix([(r.doc_id, r.text, r.source) for r in rows[2]])
    words = {}
    for r in rows[3]:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(helpers.words(r.text))
        assert (seen[0][r.doc_id].text or "").startswith(r.text)
    assert words == {i: n for i, n in taken.items() if n}
    known = library()
    tokens = sorted(len(known.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows[3])
    out = rows[4]
    assert sum(r.length for r in out) == sum(tokens)
    assert sorted(r.doc_tokens for r in out if r.start == 0) == tokens
    assert {(r.sequence_id, r.offset) for r in corpus_pipeline.run(spark, sf).collect()} >= {(0, 0)}
    whole = {r.doc_id: r.text for r in rows[3]}
    some = next(r for r in out if r.length == r.doc_tokens and sum(x.doc_id == r.doc_id for x in rows[3]) == 1)
    assert zlib.crc32(np.array([*known.encode(whole[some.doc_id], add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) == some.ids_crc32


def tables(spark, rows, at):
    """A folder with the given documents, and labels of none of them."""
    spark.createDataFrame(rows, helpers.DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(10**6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_hard_rows_through_every_stage(spark, tmp_path, monkeypatch):
    hard = helpers.hard_cases()
    at = tables(spark, hard, tmp_path / "in")
    # labels of one kind only: the classifier says the same of every text
    monkeypatch.setattr(corpus_pipeline.toxicity, "train_labels", lambda *a: spark.createDataFrame([(3, 0)], "id long, label long"))
    docs, out = queries.read(spark, at, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, at).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == [c.split()[0] for c in helpers.DOCS.split(", ")]
    assert len(out["toxicity"]) == len(hard)
    latest = helpers.keep_latest([(r[0], r[1]) for r in hard])
    assert sorted(((r.doc_id, (r.text or "").translate(helpers.LOWER)) for r in out["exact dedup"]), key=repr) == sorted(((i, t) for t, i in latest.items()), key=repr)
    groups, sets = {}, []
    for r, (_, n, root) in zip(out["exact dedup"], helpers.components([(r.doc_id, r.text) for r in out["exact dedup"]]), strict=True):
        key = (root, None if root is not None else r.text) if n else ("wordless", r.doc_id, r.text)
        groups.setdefault(key, []).append((r.doc_id, r.text))
        sets.append(key)
    left = [(r.doc_id, r.text) for r in out["near dedup"]]
    assert len(left) == len(groups) and all(sum(x in rows for x in left) == 1 for rows in groups.values())
    sizes, taken = {}, {}
    for rows, total in ((out["near dedup"], sizes), (out["mixing"], taken)):
        for r in rows:
            total[r.source] = total.get(r.source, 0) + len(helpers.words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    _, target = helpers.mix([(k, "w " * sizes[s], s) for k, s in enumerate(order)])
    assert {s: taken.get(s, 0) for s in order} == {s: int(target[s]) for s in order}
    known = library()
    assert sum(r.length for r in out["packing"]) == sum(len(known.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in out["mixing"])


def test_no_rows_through_every_stage(spark, tmp_path):
    at = tables(spark, [], tmp_path)
    assert corpus_pipeline.run(spark, at).collect() == []


def test_stages_are_read_in_small_batches(spark, sf):
    """Also while the caller writes a stage's frame, which is after the stage returned."""
    before = {name: spark.conf.get(name, None) for name in scratch.SMALL_READS}
    rows = []

    def seen(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    try:
        for name in scratch.SMALL_READS:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 64)  # the caller's, and smaller
        docs, many = queries.read(spark, sf, "documents"), spark.range(0, 3000, 1, 1)
        assert max(r.n for r in many.mapInArrow(seen, "n long").collect()) == 3000
        for name, stage in corpus_pipeline.STAGES:
            for setting in list(scratch.SMALL_READS)[1:]:
                spark.conf.unset(setting)
            stage(spark, docs, sf)
            rows.append((name, max(r.n for r in many.mapInArrow(seen, "n long").collect())))
            assert {s: int(spark.conf.get(s)) for s in scratch.SMALL_READS} == scratch.SMALL_READS | {"spark.sql.parquet.columnarReaderBatchSize": 64}
        assert len(rows) == 5 and all(n <= 1000 for _, n in rows)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
