"""Packing by concatenate and cut.

Pass one turns each text into ids and stores them with the token count that its own partition held
before it. The partition totals, one row a partition, are summed to global offsets. Pass two
reads the stored rows, adds its partition's offset and cuts at multiples of the window; a text that
crosses a boundary yields one record on each side. Order is that of the stored table, so the passes
agree even if a task of either runs again. Every window but the last is full.

Cases: null text counts as empty; an empty text is its end id alone; repeated rows are packed
again as rows of their own; an empty table gives an empty result; a text longer than the window is
cut as often as needed, and encoded in bounded stretches; ids may be null; other columns, whatever
their names, are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .scratch import table

#: Rows of one Arrow batch that pass one yields.
STORED_ROWS = 1000
_encoders: dict = {}


def _encoder(path: str):
    from .bpe import BatchEncoder

    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(path), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, STORED_ROWS):
                piece = batch.slice(at, STORED_ROWS)
                ids, each = encoder.encode(piece.column(1))
                ends = np.cumsum(each)
                ids = np.insert(ids, ends, end_id).astype(encoder.dtype, copy=False)
                counts = each + 1
                starts = before + np.cumsum(counts) - counts
                before += len(ids)
                stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(np.append(0, np.cumsum(counts)) * encoder.dtype.itemsize), pa.py_buffer(ids)])
                yield pa.record_batch(
                    [piece.column(0), pa.array(np.full(len(counts), part, dtype=np.int32)), pa.array(starts), pa.array(counts), stored.cast(pa.binary())],
                    names=["id", "part", "before", "tokens", "ids"],
                )

    return run


def _cut(window: int, width: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = batch.column("begin").to_numpy(zero_copy_only=False)
            tokens = batch.column("tokens").to_numpy(zero_copy_only=False)
            first, last = begin // window, (begin + tokens - 1) // window
            pieces = last - first + 1
            row = np.repeat(np.arange(len(pieces)), pieces)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            left = np.maximum(sequence * window, begin[row])
            right = np.minimum((sequence + 1) * window, (begin + tokens)[row])
            start = left - begin[row]
            crcs, kept, stored = [], [], batch.column("ids")
            at, ids = -1, None
            for r, a, b in zip(row.tolist(), start.tolist(), (start + right - left).tolist(), strict=True):
                if r != at:
                    at, ids = r, np.frombuffer(stored[r].as_buffer(), dtype=np.uint16 if width == 2 else np.uint32).astype("<u4")
                raw = ids[a:b]
                crcs.append(zlib.crc32(raw))
                if with_ids:
                    kept.append(raw)
            out = [batch.column("id").take(pa.array(row)), pa.array(start), pa.array(right - left), pa.array(crcs, pa.int64()), pa.array(tokens[row]), pa.array(sequence), pa.array(left - sequence * window)]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out, names = [*out, pa.array([x.astype(np.int32) for x in kept], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.record_batch(out, names=names)

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    with_ids: bool = True,
    scope: str = "",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    ``tokenizer_path`` names a byte-level BPE file that every executor has.
    """
    kind = docs.schema[id_col].dataType
    stored = table(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            textnum.tidy(_tokenize(tokenizer_path, end_id)),
            T.StructType([T.StructField("id", kind)]).add("part", T.IntegerType()).add("before", T.LongType()).add("tokens", T.LongType()).add("ids", T.BinaryType()),
        ),
        "pack-ids",
        scope,
    )
    totals = stored.groupBy("part").agg(F.max(F.col("before") + F.col("tokens")).alias("total"))
    along = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(along), F.lit(0).cast("long")).alias("offset"))
    # one row for each partition of pass one: 12 bytes a task, whatever the tasks hold
    placed = stored.join(F.broadcast(offsets), "part").select("id", "tokens", (F.col("offset") + F.col("before")).alias("begin"), "ids")
    schema = T.StructType([T.StructField(id_col, kind)])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, T.LongType())
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return placed.mapInArrow(textnum.tidy(_rename(_cut(window, _encoder(tokenizer_path).dtype.itemsize, with_ids), id_col)), schema)


def _rename(run, id_col: str):
    def renamed(batches):
        for batch in run(batches):
            yield batch.rename_columns([id_col, *batch.schema.names[1:]])

    return renamed
