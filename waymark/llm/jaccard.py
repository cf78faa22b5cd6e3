"""N-gram Jaccard join by vertical partitioning.

Every document is the set of its distinct word n-grams, as 64-bit hashes. The global order of
n-grams is by document frequency (counted over all documents in a sketch of fixed size), then by hash.
That order is cut into fragments; the overlap of a candidate pair is counted in each fragment by
itself and summed per pair.

Which pairs are candidates:

1. Sets that reach the threshold share an n-gram of their prefixes, the ``n - ceil(t n) + 1`` n-grams
   that come first in the global order. Equal sets count once.
2. In the list of the sets that share a prefix n-gram, each is first compared with one pivot only,
   the set in which the n-gram stands earliest. That is linear in the list, and in a group of near
   copies the pivot is the copy with the fewest edits.
3. Verified links give components. Within a list, pairs in different components that were not
   compared yet, and that size, position and signature still allow, are compared as well. So no link
   between components is lost, while pairs inside one are never enumerated. The signature is the parity
   of how many n-grams of the set fall in each of ``SIGNATURE`` classes: two sets differ in at
   least as many n-grams as their signatures have unlike bits, so texts that share passages but are
   not alike are told apart without reading them.

Lists of very frequent n-grams are split by row, and the pivots of the parts are compared in turn.

Cases: null or wordless text is an empty set, linked with nothing; a text of fewer words than the
n-gram is one n-gram; rows are linked by what they hold, so a row with a null id links like any other, and its
component is that of the ids that it reaches (null if there are none); rows that share an id are separate
documents; repeated rows are copies of each other; a text of any length is read whole; an empty table gives an
empty result; other columns are not read, and :func:`kept_documents` passes them on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .scratch import join_hot, table

SKETCH_BITS = 23
#: The sketch travels in compressed blocks of so many counters.
BLOCK = 1 << 17
#: Counts are kept as a logarithm in steps of an eighth of a doubling, one byte each.
STEPS = 8
#: Lists whose count exceeds the sketch's usual count by more than this are split into parts of about this size.
PART_ROWS = 50_000
#: Tasks that add up sketches, and the partitions whose sketches are added up as one before that.
ADDERS, FAN_IN = 8, 64
#: Bits of a set's signature, in words of 64.
SIGNATURE = 512
#: Prefix entries that one partition sorts in memory.
ENTRIES_PER_PARTITION = 500_000
FRAGMENTS = 4
#: Pairs of one set that are compared in one group of rows.
HUB_PAIRS = 256
#: Ids and pairs are broadcast up to this number, else joined by shuffle.
BROADCAST_IDS = 300_000
_TABLE = textnum.lower_words()
_SHIFT = np.uint64(64 - SKETCH_BITS)


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for _, data, offsets in textnum.blocks(batch.column(0)):
                _, h = textnum.shingles(textnum.Words(data, offsets, _TABLE), size, len(offsets) - 1)
                np.add.at(counts, (h >> _SHIFT).astype(np.int64), np.uint32(1))
        if counts.any():
            parts = [_squeezed(p) for p in counts.reshape(-1, BLOCK)]
            yield pa.record_batch([pa.array(np.full(len(parts), part, dtype=np.int32)), pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], names=["part", "block", "counts"])

    return run


def _squeezed(counts: np.ndarray) -> bytes:
    """Equal bytes of the counters lie together, most of them zero."""
    return zlib.compress(counts.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _sums(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], np.ndarray]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for part, block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = np.frombuffer(zlib.decompress(counts.as_py()), dtype=np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0].astype(np.int64)
            sums[part, block] = sums[part, block] + x if (part, block) in sums else x
    return sums


def _add_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of one level to sums by part and block; a counter that is full stays full."""
    for (part, block), x in _sums(batches).items():
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([_squeezed(np.minimum(x, (1 << 32) - 1).astype(np.uint32))], pa.binary())], names=["part", "block", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, block), x in _sums(batches).items():
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([_logs(x).tobytes()], pa.binary()), pa.array([int(x.sum())])], names=["block", "counts", "total"])


def _logs(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.rint(STEPS * np.log2(1.0 + counts))).astype(np.uint8)


def count_of(logs: np.ndarray) -> np.ndarray:
    """About the counts that :func:`_logs` was given."""
    return np.exp2(logs / STEPS) - 1


def frequency_sketch(docs: DataFrame, text_col: str, size: int) -> tuple[np.ndarray, int]:
    """Logarithmic counts of n-grams by the first ``SKETCH_BITS`` bits of their hash, 8 MB whatever the input, and how many there are."""
    each = docs.select(text_col).mapInArrow(textnum.tidy(_count(size)), "part int, block int, counts binary")
    parts = docs.rdd.getNumPartitions()
    while parts > FAN_IN:  # a tree, so that no task meets more than FAN_IN sketches of a block
        parts = -(-parts // FAN_IN)
        some = each.withColumn("part", (F.col("part") / FAN_IN).cast("int"))
        each = some.repartition(parts * ADDERS, "part", "block").mapInArrow(_add_some, each.schema)
    each = each.withColumn("part", F.lit(0))
    out, total = np.zeros(((1 << SKETCH_BITS) // BLOCK, BLOCK), dtype=np.uint8), 0
    for block, logs, some in each.repartition(ADDERS, "block").mapInArrow(_add, "block int, counts binary, total long").collect():
        out[block] = np.frombuffer(logs, dtype=np.uint8)
        total += some
    return out.reshape(-1), total


class _Sets:
    """The distinct n-grams of a block of texts, each text's in the global order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int, sketch: np.ndarray):
        docs = len(offsets) - 1
        doc, h = textnum.shingles(textnum.Words(data, offsets, _TABLE), size, docs)
        frequency = sketch[(h >> _SHIFT).astype(np.int64)]
        order = np.lexsort((h, frequency, doc))
        doc, h, frequency = doc[order], h[order], frequency[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.doc, self.hash, self.frequency = doc[new], h[new], frequency[new]
        self.n = np.bincount(self.doc, minlength=docs)
        self.first = np.cumsum(self.n) - self.n
        self.place = np.arange(len(self.doc)) - self.first[self.doc]
        upto = np.concatenate([[np.uint64(0)], np.cumsum(textnum.mix(self.hash ^ np.uint64(0x5851F42D4C957F2D)))])
        self.id = textnum.mix(upto[self.first + self.n] - upto[self.first] + self.n.astype(np.uint64)).view(np.int64)

    def signatures(self) -> pa.Array:
        """Each set's parities, as words of 64 bits."""
        odd = np.zeros(len(self.n) * SIGNATURE, dtype=np.uint8)
        at = np.sort(self.doc * SIGNATURE + (self.hash % np.uint64(SIGNATURE)).astype(np.int64))
        first = np.flatnonzero(np.diff(at, prepend=-1))
        odd[at[first]] = np.diff(np.append(first, len(at))) & 1
        words = np.packbits(odd).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(self.n) + 1, dtype=np.int32) * (SIGNATURE // 64)), pa.array(words))


ENTRY = ["id", "key", "part", "sid", "n", "place", "tid", "sig"]


def _entries(size: int, percent: int, shared, id_type: pa.DataType | None = None):
    """Rows (id, key, part, sid, n, place, tid, sig): one of each document (place -1), then its prefix n-grams (id, tid and sig null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        usual = count_of(sketch[:: 64]).mean() + 1
        for batch in batches:
            spread = batch.column(2).to_numpy(zero_copy_only=False)
            tids = batch.column(3)
            for at, data, offsets in textnum.blocks(batch.column(1)):
                sets = _Sets(data, offsets, size, sketch)
                rows = np.arange(at, at + len(offsets) - 1)
                ids = batch.column(0).slice(at, len(rows))
                n = sets.n.astype(np.int32)
                minus = pa.array(np.full(len(rows), -1, np.int32))
                yield pa.record_batch([ids, pa.array(spread[rows]), minus, pa.array(sets.id), pa.array(n), minus, tids.slice(at, len(rows)), sets.signatures()], names=ENTRY)
                prefix = sets.n - (percent * sets.n + 99) // 100 + 1
                keep = sets.place < prefix[sets.doc]
                doc = sets.doc[keep]
                parts = (1 + np.maximum(0, count_of(sets.frequency[keep]) - 2 * usual) // PART_ROWS).astype(np.int64)
                # the part's number and how many there are: the latter is a function of the n-gram alone
                part = (spread[rows][doc].view(np.uint64) % parts.astype(np.uint64)).astype(np.int32)
                part = np.where(parts > 1, part + 1, 0).astype(np.int32)
                yield pa.record_batch(
                    [pa.nulls(len(doc), ids.type), pa.array(sets.hash[keep].view(np.int64)), pa.array(part), pa.array(sets.id[doc]), pa.array(n[doc]), pa.array(sets.place[keep].astype(np.int32)), pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.list_(pa.int64()))],
                    names=ENTRY,
                )

    return run


def allowed(n_a: np.ndarray, i_a: np.ndarray, n_b: np.ndarray, i_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n whose first common n-gram stands at places i can still reach the threshold."""
    most = np.minimum(n_a - i_a, n_b - i_b)
    return (100 + percent) * most >= percent * (n_a + n_b)


def _stars(percent: int):
    """From a partition's entries: its documents (kind 0), pairs with pivots (1), members of lists that may hold more links (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        names = ["kind", "id", "key", "part", "sid", "n", "place", "sid2", "n2", "tid", "sig"]
        kind_type = None
        for batch in batches:
            kind_type = batch.column(0).type
            is_doc = batch.column(5).to_numpy() < 0
            docs = batch.filter(pa.array(is_doc))
            if docs.num_rows:
                m = docs.num_rows
                zero = pa.array(np.zeros(m, np.int32))
                yield pa.record_batch([zero, docs.column(0), docs.column(1), zero, docs.column(3), docs.column(4), zero, pa.array(np.zeros(m, np.int64)), zero, docs.column(6), docs.column(7)], names=names)
            held.append([batch.column(c).to_numpy()[~is_doc] for c in range(1, 6)])
        if not held:
            return
        key, part, sid, n, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((sid, place, part, key))
        key, part, sid, n, place = key[order], part[order], sid[order], n[order], place[order]
        if not len(key):
            return
        new_list = np.ones(len(key), dtype=bool)
        new_list[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        distinct = new_list.copy()
        distinct[1:] |= (sid[1:] != sid[:-1]) | (n[1:] != n[:-1])
        key, part, sid, n, place, new_list = (x[distinct] for x in (key, part, sid, n, place, new_list))
        which = np.cumsum(new_list) - 1
        first = np.flatnonzero(new_list)
        members = np.bincount(which)
        pivot = first[which]
        paired = (pivot != np.arange(len(key))) & allowed(n[pivot], place[pivot], n, place, percent)
        a, b = pivot[paired], np.flatnonzero(paired)
        pairs = np.unique(np.stack([sid[a], n[a].astype(np.int64), sid[b], n[b].astype(np.int64)], axis=1), axis=0) if len(a) else np.empty((0, 4), np.int64)
        yield _rows(kind_type, names, 1, np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int32), pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int32), pairs[:, 2], pairs[:, 3])
        # a member matters later if its list has more than a pair, and another member is small enough for it
        most = ((100 + percent) * (n - place).astype(np.int64)) // percent - n
        least = np.minimum.reduceat(n, first)[which]
        more = ((members[which] > 2) & (least <= most)) | (part > 0)
        yield _rows(kind_type, names, 2, key[more], part[more], sid[more], n[more], place[more], (pivot == np.arange(len(key)))[more].astype(np.int64), np.zeros(more.sum(), np.int32))

    return run


def _rows(id_type, names, kind, key, part, sid, n, place, sid2, n2) -> pa.RecordBatch:
    m = len(key)
    i32 = lambda x: pa.array(np.asarray(x).astype(np.int32))
    return pa.record_batch([i32(np.full(m, kind)), pa.nulls(m, id_type), pa.array(key), i32(part), pa.array(sid), i32(n), i32(place), pa.array(sid2), i32(n2), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64()))], names=names)


def fragment_bounds(sketch: np.ndarray, fragments: int) -> np.ndarray:
    """Frequencies at which the global order is cut, so that each fragment holds about as many occurrences."""
    bins = np.bincount(sketch, minlength=256)
    mass = np.cumsum(bins * count_of(np.arange(256)))
    return np.searchsorted(mass, mass[-1] * np.arange(1, fragments) / fragments)


def _segments(size: int, shared, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch in batches:
            for _, data, offsets in textnum.blocks(batch.column(0)):
                sets = _Sets(data, offsets, size, sketch)
                fragment = np.searchsorted(bounds, sets.frequency)
                new = np.ones(len(fragment), dtype=bool)
                new[1:] = (sets.doc[1:] != sets.doc[:-1]) | (fragment[1:] != fragment[:-1])
                at = np.flatnonzero(new)
                values = pa.ListArray.from_arrays(pa.array(np.append(at, len(fragment)).astype(np.int32)), pa.array(sets.hash.view(np.int64)))
                doc = sets.doc[at]
                yield pa.record_batch([pa.array(sets.id[doc]), pa.array(sets.n[doc].astype(np.int32)), pa.array(fragment[at].astype(np.int32)), values], names=["sid", "n", "fragment", "grams"])

    return run


class JaccardJoin:
    """One run over one table; see :func:`near_duplicates`."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, scope: str):
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.spark: SparkSession = docs.sparkSession
        self.size, self.percent, self.scope = size, percent, scope
        sketch, total = frequency_sketch(self.docs, "text", size)
        self.bounds = fragment_bounds(sketch, FRAGMENTS)
        self.sketch = self.spark.sparkContext.broadcast(sketch)
        id_field = T.StructField("id", self.docs.schema["id"].dataType)
        columns = [T.StructField("key", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("sid", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("place", T.IntegerType())]
        more = [T.StructField("tid", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType()))]
        # a number of each row: copies, and rows that share an id, spread over the parts of a list
        placed = self.docs.select("id", "text", F.xxhash64(F.monotonically_increasing_id()).alias("spread"), F.xxhash64("text").alias("tid"))
        entries = placed.mapInArrow(textnum.tidy(_entries(size, percent, self.sketch)), T.StructType([id_field, *columns, *more]))
        default = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = total * (100 - percent) // 100 // ENTRIES_PER_PARTITION + 1
        stars = T.StructType([T.StructField("kind", T.IntegerType()), id_field, *columns, T.StructField("sid2", T.LongType()), T.StructField("n2", T.IntegerType()), *more])
        self.lists = table(entries.repartition(max(default, wanted), "key", "part").mapInArrow(textnum.tidy(_stars(percent)), stars), "jaccard-lists", scope)
        self.rows = self.lists.filter("kind = 0").select("id", "tid", "sid", "n")
        worded = self.lists.filter("kind = 0 and n > 0")
        self.sets = table(worded.groupBy("sid", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("sig").alias("sig")), "jaccard-sets", scope)

    def first_pairs(self) -> DataFrame:
        stars = self.lists.filter("kind = 1").select(F.col("sid").alias("sid_a"), F.col("n").alias("n_a"), F.col("sid2").alias("sid_b"), F.col("n2").alias("n_b"))
        pivots = self.lists.filter("kind = 2 and part > 0 and sid2 = 1")
        heads = pivots.groupBy("key").agg(F.min(F.struct("place", "sid", "n")).alias("head")).select("key", F.col("head.sid").alias("sid_a"), F.col("head.n").alias("n_a"))
        across = pivots.join(heads, "key").filter("not (sid = sid_a and n = n_a)").select("sid_a", "n_a", F.col("sid").alias("sid_b"), F.col("n").alias("n_b"))
        return self._ordered(stars.unionByName(across)).distinct()

    @staticmethod
    def _ordered(pairs: DataFrame) -> DataFrame:
        return JaccardJoin._swapped(pairs, F.struct("sid_a", "n_a") > F.struct("sid_b", "n_b"))

    @staticmethod
    def _swapped(pairs: DataFrame, swap: Column, *more: Column) -> DataFrame:
        return pairs.select(
            *[F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in ("sid", "n")], *more
        )

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (sid_a, n_a, sid_b, n_b) whose summed overlap reaches the threshold, as sets (a, b)."""
        needed = pairs.select(F.col("sid_a").alias("sid"), F.col("n_a").alias("n")).union(pairs.select("sid_b", "n_b")).distinct()
        ids = table(self.sets.join(needed, ["sid", "n"]).select(F.col("rep").alias("rep_id")).distinct(), "jaccard-ids", self.scope)
        few = ids.count() <= BROADCAST_IDS
        # texts that share an id with one that is asked for come along, and are dropped when sets are joined
        texts = self.docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("rep_id")), "left_semi").select("text")
        segments = table(texts.mapInArrow(textnum.tidy(_segments(self.size, self.sketch, self.bounds)), "sid long, n int, fragment int, grams array<long>"), "jaccard-segments", self.scope)
        # the set with more pairs is side a, so that fewer sets travel to it
        degree = pairs.select(F.col("sid_a").alias("sid"), F.col("n_a").alias("n")).union(pairs.select("sid_b", "n_b")).groupBy("sid", "n").count()
        ranked = pairs
        for side in "ab":
            ranked = ranked.join(degree.select(F.col("sid").alias(f"sid_{side}"), F.col("n").alias(f"n_{side}"), F.col("count").alias(f"degree_{side}")), [f"sid_{side}", f"n_{side}"])
        swap = F.col("degree_b") > F.col("degree_a")
        # a set with very many pairs meets them in several parts
        parts = 1 + F.floor(F.greatest("degree_a", "degree_b") / HUB_PAIRS).cast("int")
        pairs = table(self._swapped(ranked, swap, parts.alias("parts")), "jaccard-hubs", self.scope)
        small = (lambda x: F.broadcast(x)) if pairs.count() <= BROADCAST_IDS else (lambda x: x)
        of_b = segments.select(F.col("sid").alias("sid_b"), F.col("n").alias("n_b"), "fragment", F.col("grams").alias("grams_b"))
        of_a = segments.select(F.col("sid").alias("sid_a"), F.col("n").alias("n_a"), "fragment", F.col("grams").alias("grams_a"))
        of_a = of_a.join(small(pairs.select("sid_a", "n_a", "parts").distinct()), ["sid_a", "n_a"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        partial = (
            of_b.join(small(pairs), ["sid_b", "n_b"])
            .withColumn("part", F.pmod(F.xxhash64("sid_b", "n_b"), F.col("parts")).cast("int"))
            .join(of_a.drop("parts"), ["sid_a", "n_a", "fragment", "part"])
            .select("sid_a", "n_a", "sid_b", "n_b", "fragment", F.size(F.array_intersect("grams_a", "grams_b")).alias("overlap"))
        )
        # repeated rows give a segment twice
        once = partial.groupBy("sid_a", "n_a", "sid_b", "n_b", "fragment").agg(F.max("overlap").alias("overlap"))
        total = once.groupBy("sid_a", "n_a", "sid_b", "n_b").agg(F.sum("overlap").alias("overlap"))
        return total.filter(f"100 * overlap >= {self.percent} * (n_a + n_b - overlap)").select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"))

    def other_pairs(self, labels: DataFrame, tested: DataFrame) -> DataFrame:
        """Pairs of one list, in different components, not tested yet, that size and place allow."""
        known = self.sets.join(labels, self.sets["sid"] == labels["node"], "left").select("sid", "n", F.coalesce("label", "sid").alias("label"), "sig")
        members = self.lists.filter("kind = 2").select("key", "sid", "n", "place").distinct().join(known, ["sid", "n"])
        members = table(members, "jaccard-members", self.scope)
        open_lists = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
        members = members.join(open_lists, "key")
        a = members.select("key", *[F.col(c).alias(f"{c}_a") for c in ("sid", "n", "place", "label", "sig")])
        b = members.select(F.col("key").alias("key_b"), *[F.col(c).alias(f"{c}_b") for c in ("sid", "n", "place", "label", "sig")])
        t = self.percent
        apart = sum((F.bit_count(F.col("sig_a")[k].bitwiseXOR(F.col("sig_b")[k])) for k in range(1, SIGNATURE // 64)), F.bit_count(F.col("sig_a")[0].bitwiseXOR(F.col("sig_b")[0])))
        pairs = a.join(
            b,
            (F.col("key") == F.col("key_b"))
            & (F.col("label_a") != F.col("label_b"))
            & ((F.col("sid_a") < F.col("sid_b")) | ((F.col("sid_a") == F.col("sid_b")) & (F.col("n_a") < F.col("n_b"))))
            & ((100 + t) * F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= t * (F.col("n_a") + F.col("n_b")))
            & ((100 + t) * apart <= (100 - t) * (F.col("n_a") + F.col("n_b"))),
        )
        return pairs.select("sid_a", "n_a", "sid_b", "n_b").distinct().join(tested, ["sid_a", "n_a", "sid_b", "n_b"], "left_anti")


def components(edges: DataFrame, scope: str = "") -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Each round takes the smallest label among the neighbours, then the label of the label, so paths
    shrink fast; the labels are written in every round.
    """
    both = table(edges.union(edges.select("b", "a")).distinct(), "components-edges", scope)
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "components-labels", scope)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        lower = table(lower, "components-lower", scope)
        jump = lower.select(F.col("node").alias("mid"), F.col("label").alias("end"))
        after = table(
            lower.join(jump, lower["label"] == jump["mid"]).select("node", F.least("label", "end").alias("label"), "was"), "components-labels", scope
        )
        if after.filter("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, with_text_id: bool = False, scope: str = ""
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id that links of ``percent`` or more reach)[, text_id: a hash of the text]."""
    run = JaccardJoin(docs, id_col, text_col, size, percent, scope)
    first = table(run.first_pairs(), "jaccard-pairs", scope)
    links = table(run.verified(first), "jaccard-links", scope)
    labels = components(links, scope)
    second = table(run.other_pairs(labels, first), "jaccard-pairs", scope)
    if not second.isEmpty():
        links = table(links.unionByName(run.verified(second)), "jaccard-links", scope)
        labels = components(links, scope)
    linked = table(run.sets.join(labels, run.sets["sid"] == labels["node"]).select("sid", "n", "rep", "copies", "label"), "jaccard-linked", scope)
    smallest = table(linked.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("sets")), "jaccard-smallest", scope)
    found = join_hot(linked, smallest, ["label"], "sets").select("sid", "n", "copies", "component_id")
    lone = run.sets.join(labels, run.sets["sid"] == labels["node"], "left_anti").select("sid", "n", "copies", F.col("rep").alias("component_id"))
    found = table(found.unionByName(lone), "jaccard-components", scope)
    own = join_hot(run.rows.filter("n > 0"), found, ["sid", "n"], "copies")
    empty = run.rows.filter("n = 0").withColumn("component_id", F.col("id"))
    out = own.select("id", "n", "component_id", "tid").unionByName(empty.select("id", "n", "component_id", "tid"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", *([F.col("tid").alias("text_id")] if with_text_id else []))


def kept_documents(docs: DataFrame, result: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str = "") -> DataFrame:
    """One document of each group, that with the smallest id, with all its columns; ``result`` has the text ids.

    A row is known by id and text. Of rows of a group that share the smallest id, the one with the smallest text id
    stays, and of equal rows one. A document without words stays. What goes is broadcast up to
    ``BROADCAST_IDS``, else joined by shuffle. Rows with a null id that reach no id at all are
    groups by their text.
    """
    of_group = F.when(F.col("component_id").isNull(), F.col("text_id"))
    rows = result.filter("n_shingles > 0").withColumn("own", of_group).select(F.col(id_col).alias("lost_id"), F.col("text_id").alias("lost_text"), "component_id", "own")
    each = table(rows.groupBy("lost_id", "lost_text", "component_id", "own").agg(F.count(F.lit(1)).alias("rows")), "jaccard-rows", scope)
    # rows of the smallest id only: other ids go whatever their texts are
    smallest = each.filter("lost_id <=> component_id").groupBy("component_id", "own").agg(F.min("lost_text").alias("stays"), F.count(F.lit(1)).alias("texts"))
    shared = smallest.filter("texts > 1").select(F.col("component_id").alias("of"), F.col("own").alias("of_own"), "stays")
    marked = each.join(shared, F.col("component_id").eqNullSafe(F.col("of")) & F.col("own").eqNullSafe(F.col("of_own")), "left")
    goes = ~F.col("lost_id").eqNullSafe(F.col("component_id")) | F.coalesce(F.col("lost_text") != F.col("stays"), F.lit(False))
    odd = table(marked.withColumn("goes", goes).filter("goes or rows > 1").select("lost_id", "lost_text", "goes"), "jaccard-gone", scope)
    few = odd.count() <= BROADCAST_IDS
    texts = docs.withColumn("__own_text", F.xxhash64(text_col))

    def side(rows: DataFrame) -> tuple[DataFrame, Column]:
        return F.broadcast(rows) if few else rows.hint("shuffle_hash"), texts[id_col].eqNullSafe(rows["lost_id"]) & (texts["__own_text"] == rows["lost_text"])

    out = texts.join(*side(odd), "left_anti")
    twins = odd.filter("not goes")
    if not twins.isEmpty():
        out = out.unionByName(texts.join(*side(twins), "left_semi").dropDuplicates([id_col, "__own_text"]))
    return out.drop("__own_text")
