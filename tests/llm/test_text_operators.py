import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import bpe, exact_dedup, jaccard, media, mixing, packing, preference, queries, textnum

from ..conftest import same_rows
from . import helpers


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(helpers.hard_cases(), helpers.DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(name, spark, sf, duck):
    same_rows(queries.queries()[name](spark, sf), duck.sql(queries.oracle_sql()[name]))


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_encoder_equals_library(monkeypatch):
    rng = random.Random(0)
    alphabet = [*"abt|e's;:<>XYZ 0129éßñ\n\t\r  .,!-\"\xa0\x85\x1c\u2003\u3000²½ʃя日", "<|endoftext|>", "'s", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(5000)]
    texts += ["<|endoftext|> a", "it's we'll'", "", None, " ", "\n", "a  \n", " a", "\x1c x", "😀 a", "a\x00b", "word " * 5000]
    texts += [helpers.thue_morse(2048), helpers.thue_morse(2048, "ba"), " " * 200_000 + "x", "a" * 100_000, "words and more, " * 3000 + "b" * 20_000 + " c"]
    known = library()
    for window in (bpe.WINDOW, 1000):
        monkeypatch.setattr(bpe, "WINDOW", window)
        encoder = bpe.BatchEncoder(queries.tokenizer_path())
        for _ in range(2):  # anew, then from what is remembered
            ids, counts = encoder.encode(pa.array(texts))
            ends = np.cumsum(counts)
            for text, a, b in zip(texts, ends - counts, ends, strict=True):
                assert ids[a:b].tolist() == known.encode(text or "", add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "may_cut", lambda spec: False)
    whole, counts = bpe.BatchEncoder(queries.tokenizer_path()).encode(pa.array(texts))
    assert counts.tolist() == np.diff(np.append(0, ends)).tolist() and (whole == ids).all()


def test_cuts_depend_on_the_file():
    import json

    import public_tokenizers

    assert [bpe.may_cut(json.load(open(public_tokenizers.path(f)))) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")] == [True, False]


def check_pieces(out, texts):
    known = library()
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append(r)
    for k, rows in held.items():
        rows.sort(key=lambda r: r.offset)
        assert rows[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(rows, rows[1:]))
        assert rows[-1].offset + rows[-1].length == 2048 or k == max(held)
    covered = {}
    for r in out:
        covered.setdefault(r.doc_id, []).append(r)
    for i, text in texts.items():
        ids = [*known.encode(text or "", add_special_tokens=False).ids, 1]
        rows = sorted(covered.pop(i), key=lambda r: r.start)
        at = 0
        for r in rows:
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not covered


def test_packing(spark, sf):
    docs = queries.read(spark, sf, "documents")
    check_pieces(queries.op2_packing(spark, sf).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_packing_hard(spark, hard):
    once = hard.filter("doc_id is not null").dropDuplicates(["doc_id"])
    out = packing.pack(once, queries.tokenizer_path()).collect()
    check_pieces(out, {r.doc_id: r.text for r in once.collect()})
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in out)
    assert packing.pack(hard, queries.tokenizer_path()).agg(F.sum("length")).first()[0] > sum(r.length for r in out)
    assert packing.pack(hard.limit(0), queries.tokenizer_path()).count() == 0


def test_mixing_against_plain(spark, sf, hard):
    for docs in (queries.read(spark, sf, "documents"), hard.filter("doc_id is not null").dropDuplicates(["doc_id"]), hard.limit(0)):
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        taken, target = helpers.mix(rows)
        out = mixing.mix_sources(docs).collect()
        assert {r.doc_id: r.taken for r in out} == taken
        assert all(r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size for r in out)


def test_mixing_repeated_rows(spark, hard):
    out = mixing.mix_sources(hard)
    assert out.count() == hard.count()
    sums = {r.source: r for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()}
    assert all(r.t == int(r.g) for r in sums.values())
    mixed = mixing.mixed_documents(hard, out)
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == {s: r.t for s, r in sums.items() if r.t}


@pytest.mark.parametrize("twins", [0, 100_000])
def test_mixing_of_rows_that_share_an_id(spark, monkeypatch, twins):
    monkeypatch.setattr(mixing, "BROADCAST_TWINS", twins)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    rows = [(7, f"one two {i}", "a") for i in range(400)] + [(None, "same text here", "a")] * 300 + [(8, "x " * (i % 5), None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs)
    taken = {r.source: r for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()}
    assert all(r.t == int(r.g) for r in taken.values()) and out.filter("taken > 2 * size").count() == 0
    mixed = mixing.mixed_documents(docs, out)
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == {s: r.t for s, r in taken.items()}


def test_mixed_documents(spark, sf):
    docs = queries.read(spark, sf, "documents")
    taken = mixing.mix_sources(docs)
    mixed = mixing.mixed_documents(docs, taken)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == {r.doc_id: r.taken for r in taken.collect() if r.taken}


def test_exact_dedup_hard(spark, hard):
    out = exact_dedup.exact_dedup(hard).collect()
    best = helpers.keep_latest([(r.doc_id, r.text) for r in hard.collect()])
    assert len(out) == hard.count() and sum(r.kept for r in out) == len(best)
    assert {r.keep_id for r in out} == set(best.values())
    groups = {}
    for r in out:
        groups.setdefault(r.text_sha256, []).append(r)
    for rows in groups.values():
        assert {r.group_size for r in rows} == {len(rows)} and sum(r.kept for r in rows) == 1
        assert all(not r.kept or r.doc_id == r.keep_id for r in rows)
    assert exact_dedup.exact_dedup(hard.limit(0)).count() == 0
    kept = exact_dedup.kept_documents(hard, exact_dedup.exact_dedup(hard))
    assert kept.columns == hard.columns and kept.count() == len(best)


def test_exact_dedup_small_filter_and_hot_group(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 3500).cast("string"))).alias("text"))
    full = exact_dedup.exact_dedup(docs)
    tight = exact_dedup.exact_dedup(docs, max_filter_bits=1 << 15)  # every row is a candidate
    assert full.exceptAll(tight).count() == 0 and full.filter("group_size = 2000").count() == 2000


def same_components(out, rows):
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=repr) == sorted(helpers.components(rows), key=repr)


def test_jaccard_against_plain(spark, sf, hard):
    for docs in (queries.read(spark, sf, "documents"), hard, hard.limit(0)):
        same_components(jaccard.near_duplicates(docs), [(r.doc_id, r.text) for r in docs.collect()])


def test_near_copies_go_by_row(spark, hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    groups, want = {}, 0
    for (i, n, c), (_, text) in zip(helpers.components(rows), rows, strict=True):
        if not n:
            want += 1
        else:
            groups.setdefault(c if c is not None else text, []).append((i, text))
    kept = jaccard.kept_documents(hard, jaccard.near_duplicates(hard, with_text_id=True))
    assert kept.columns == hard.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == want + len(groups)
    for members in groups.values():
        stay = [x for x in got if x in members]
        assert len(set(stay)) == 1 and (stay[0][0] is None or stay[0][0] == min(i for i, _ in members if i is not None))


def test_shared_passages_are_told_apart(spark):
    """Texts of two passages each, none alike: no pair is read, whatever their number."""
    rng, pairs = random.Random(3), []
    passages = [" ".join(f"p{k}w{i}" for i in range(60)) for k in range(40)]
    for n in (200, 400):
        rows = [(i, " ".join(rng.sample(passages, 2) + [f"z{i}"])) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        run = jaccard.JaccardJoin(docs, "doc_id", "text", 5, 80, "")
        first = jaccard.table(run.first_pairs(), "test-pairs")
        labels = jaccard.components(run.verified(first))
        pairs.append(run.other_pairs(labels, first).count())
        same_components(jaccard.near_duplicates(docs), rows)
    assert max(pairs) <= 2 * 400


def test_sketches_are_added_up_in_a_tree(spark, sf, monkeypatch):
    docs = queries.read(spark, sf, "documents").repartition(9)
    flat, total = jaccard.frequency_sketch(docs, "text", 5)
    monkeypatch.setattr(jaccard, "FAN_IN", 2)
    tree, again = jaccard.frequency_sketch(docs, "text", 5)
    assert (flat == tree).all() and total == again


def test_jaccard_groups_with_edits(spark, monkeypatch):
    """Chains and large groups of near copies, with lists that are split into parts."""
    monkeypatch.setattr(jaccard, "PART_ROWS", 20)
    rng, rows = random.Random(2), []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(80)]
        for c in range((60, 30, 12, 5, 3, 2)[g]):
            text = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4))):
                text[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text[: 80 - rng.choice((0, 0, 0, 5, 10))])))
    shared = " ".join(f"s{i}" for i in range(12))
    rows += [(len(rows) + k, " ".join([shared, *[f"k{k}x{i}" for i in range(40)]])) for k in range(80)]
    rng.shuffle(rows)
    same_components(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(100, b) for b in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == root


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 65536, 65537, 200001])
def test_media_round_trip(size):
    raw = random.Random(size).randbytes(size)
    data = media.wrap(media.padded(raw))
    (track,) = media.probe(data)
    back = media.payload(data, track)
    assert back[:size] == raw and not any(back[size:]) and len(back) % 64 == 0 < len(back)
    assert (track.codec, track.handler, track.samples, track.duration) == ("raw ", "soun", len(back), len(back))


def test_media_rejects_broken_files():
    data = media.wrap(bytes(64))
    for bad in (data[:-1], data[:5], data.replace(b"stsz", b"xxxx"), data.replace(b"stts", b"xxxx")):
        with pytest.raises(ValueError):
            media.probe(bad)


def plain_boxes(data, at, end):
    """Every box of a file by path, read with another walker than the operator's."""
    out = {}
    while at < end:
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1")
        out[kind] = data[at + 8 : at + size]
        if kind in ("moov", "trak", "mdia", "minf", "stbl"):
            out |= plain_boxes(data, at + 8, at + size)
        at += size
    return out


def check_media(docs):
    import hashlib

    stored = media.media_column(docs)
    files, texts = sorted((bytes(r.media) for r in stored.collect())), sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    rows = media.described(stored).collect()
    want = []
    for i, text in texts:
        raw = text.encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    by_digest = {hashlib.sha256(f).hexdigest(): f for f in files}
    for r in rows:
        data = by_digest[r.media_sha256]
        boxes = plain_boxes(data, 0, len(data))
        assert r.media_bytes == len(data) and hashlib.sha256(boxes["mdat"]).hexdigest() == r.payload_sha256
        at = np.frombuffer(boxes["stco"][8:], ">u4").tolist()
        assert [k.offset for k in r.keyframes] == at and b"".join(data[k.offset : k.offset + k.size] for k in r.keyframes) == boxes["mdat"]
        assert [k.time for k in r.keyframes] == [k.offset - at[0] for k in r.keyframes]
        assert f";{r.payload_bytes}/8000;" in r.feature and r.feature.startswith("raw;")
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})


def test_media_column(spark, sf, hard):
    check_media(hard)
    check_media(queries.read(spark, sf, "documents").withColumnRenamed("lang", "media"))
    assert media.described(media.media_column(hard.limit(0))).count() == 0


def test_sample_times():
    track = media.Track(tables={
        b"stsz": memoryview(bytes(4) + (0).to_bytes(4, "big") + (4).to_bytes(4, "big") + b"".join(n.to_bytes(4, "big") for n in (5, 6, 7, 8))),
        b"stco": memoryview(bytes(4) + (2).to_bytes(4, "big") + (100).to_bytes(4, "big") + (200).to_bytes(4, "big")),
        b"stsc": memoryview(bytes(4) + (1).to_bytes(4, "big") + b"".join(n.to_bytes(4, "big") for n in (1, 2, 1))),
        b"stts": memoryview(bytes(4) + (2).to_bytes(4, "big") + b"".join(n.to_bytes(4, "big") for n in (3, 10, 1, 30))),
        b"stss": memoryview(bytes(4) + (2).to_bytes(4, "big") + (1).to_bytes(4, "big") + (4).to_bytes(4, "big")),
    })
    media._locate(track)
    assert (track.duration, track.times, track.ranges) == (60, [0, 30], [(100, 11), (207, 8)])


def test_preference_cases(spark):
    turn = "array<struct<role:string,text:string>>"
    rows = [(1, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c"), ("user", "d")]), (2, [("user", "a")], [("user", "a")]), (3, [], []), (4, None, [("assistant", None)]), (None, [("x", "y")], [("x", "z")])]
    got = {r.pair_id: r for r in preference.format_pairs(spark.createDataFrame(rows, f"pair_id long, chosen {turn}, rejected {turn}")).collect()}
    one = got[1]
    assert one.prompt_turns == 1 and one.prompt == "<|user|>\na<|end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_spans] == ["b<|end|>"] and [one.rejected[s.start : s.end] for s in one.rejected_spans] == ["c<|end|>"]
    assert got[2].chosen == got[2].rejected == "" and got[2].prompt_turns == 1 and got[3].prompt == ""
    assert got[4].chosen == "" and got[4].rejected == "<|assistant|>\n<|end|>\n" and got[None].prompt_turns == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.format_pairs(preference.reply_pairs(none)).count() == 0
    odd = spark.createDataFrame([(1, 0, None, None), (1, None, "assistant", "x"), (1, 0, "user", "q"), (2, 0, "user", "only")], none.schema)
    assert {r.pair_id for r in preference.format_pairs(preference.reply_pairs(odd)).collect()} == {1, 2}
    # columns that bear the names of inner ones, repeated turns, and a very long turn
    long = "word " * 200_000
    clash = spark.createDataFrame([(1, 0, "user", long, 9, "z", 0), (1, 1, "assistant", "b", 8, "y", 1), (1, 1, "assistant", "b", 7, "x", 2)], "conv_id long, turn long, role string, text string, pair_id int, turns string, first int")
    (r,) = preference.format_pairs(preference.reply_pairs(clash)).collect()
    assert r.pair_id == 1 and r.prompt == f"<|user|>\n{long}<|end|>\n" + 2 * "<|assistant|>\nb<|end|>\n" and r.chosen == r.rejected == ""
    wide = spark.createDataFrame([(1, [("user", "a")], [("user", "b")], "x", 3)], f"pair_id long, chosen {turn}, rejected {turn}, c string, prompt_turns int")
    assert preference.format_pairs(wide).first().prompt_turns == 0


def test_word_hashes():
    texts = ["The cat", None, "", "cat The", "the  CAT\n", "é É"]
    seen = []
    for _, data, offsets in textnum.blocks(pa.array(texts)):
        words = textnum.Words(data, offsets, textnum.lower_words())
        seen += list(zip(words.doc.tolist(), words.hashes().tolist(), strict=True))
    by = {}
    for d, h in seen:
        by.setdefault(d, []).append(h)
    assert by[0] == by[4] and by[0] == by[3][::-1] and len(set(by[5])) == 2 and set(by) == {0, 3, 4, 5}
