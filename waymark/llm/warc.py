"""WARC archives with a two-level capture index.

Writing: each page becomes a gzip member in an archive file of bounded size, in a folder that the whole
cluster shares and pyarrow's file systems can reach. A file gets its name when it is complete, and a task that runs again
writes the same names. Pages whose payload appeared under a smaller id become revisit records that carry
the headers but not the payload.

Index: the captures, sorted by reversed-host URL key, lie in compressed blocks. A directory keeps
the first key of each block, and a sparse top level keeps every ``stride``-th of those, so that it has
at most ``TOP_KEYS`` rows, whatever the number of captures. A lookup searches the top level, then the
stretch of the directory below it, then inside every block that may hold the key, and the records are read
from the files by offset and length. Archives never shuffle, only places in them.

Cases: null html counts as an empty payload, and empty payloads equal each other; a null url has the
empty key; a null id sorts last and differs from any text, ``null`` included; rows that agree in id and payload share
one decision, and every one of them is a record; ids and payloads may have any length and content; an empty
table gives an empty result; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import join_hot, new_path, table

ARCHIVE_BYTES = 8 << 20
#: Bytes of archives that one task reads records from.
READ_BYTES = 64 << 20
BLOCK_LINES = 256
#: Captures that one task sorts.
CAPTURES_PER_TASK = 1_000_000
#: Keys of the top level, the only part of the index that is broadcast: some 16 MB.
TOP_KEYS = 100_000
#: Revisits up to this number are broadcast to the writer, else joined by shuffle.
BROADCAST_REVISITS = 200_000
#: What stays as it is in a record's URI; the rest, controls and blanks too, is percent-encoded.
_URI = "".join(chr(c) for c in range(0x21, 0x7F))
DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """The URL with its host reversed, so that captures of one domain sort together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page: str | None) -> str:
    """Key of one capture; the blank after the URL sorts below whatever may continue a URL. No id is shorter than any."""
    return f"{surt(url)} {'~' if page is None else page.rjust(20, '0')}"


def _urn(page: str | None) -> str:
    return "<urn:nopage>" if page is None else f"<urn:page:{quote(page, safe='')}>"


def _page(urn: str) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) if urn.startswith("<urn:page:") else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit of ``refers_to``, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = quote(url or "", safe=_URI)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[str | None, int, str, str, str | None]:
    """(page, payload bytes, digest, type, refers to) of a gzip member; a response's digest is computed from what is stored."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    stated, kind = fields["WARC-Payload-Digest"].partition(":")[2], fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest(payload) != stated):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload it states")
    refers = fields.get("WARC-Refers-To")
    return _page(fields["WARC-Record-ID"]), length, stated, kind, _page(refers) if refers else None


def _store(folder: str):
    """The file system of a folder that executors share, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root)
        task = TaskContext.get()
        number, data, lines, held = 0, [], [], 0

        def flush():
            name, m = f"{task.partitionId():07d}-{number:05d}.warc.gz", len(lines)
            partial = f"{root}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(partial, compression=None) as out:
                for member in data:
                    out.write(member)
            store.move(partial, f"{root}/{name}")
            return pa.record_batch(
                [pa.array([name] * m), *[pa.array([x[c] for x in lines], k) for c, k in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))]], names=["archive", "key", "offset", "length"]
            )

        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers)
                lines.append((capture_key(url, page), held, len(member)))
                data.append(member)
                held += len(member)
                if held >= ARCHIVE_BYTES:
                    yield flush()
                    number, data, lines, held = number + 1, [], [], 0
        if lines:
            yield flush()

    return run


def revisits(pages: DataFrame, min_bytes: int, scope: str) -> DataFrame:
    """(id, sha, refers_to) of the pages whose payload has a smaller id elsewhere."""
    thin = table(
        pages.select("id", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes")),
        "warc-digests",
        scope,
    ).filter(F.col("bytes") >= min_bytes)
    order = F.struct(F.col("id").isNull().alias("last"), "id")
    groups = table(thin.groupBy("sha").agg(F.min(order).getField("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies >= 2"), "warc-groups", scope)
    later = join_hot(thin, groups, ["sha"], "copies").filter("first is not null and not (id <=> first)")
    return table(later.select("id", "sha", F.col("first").alias("refers_to")).distinct(), "warc-revisits", scope)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, scope: str = "") -> DataFrame:
    """Writes the archives of all pages into ``folder``: their captures (archive, key, offset, length)."""
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    again = revisits(pages, min_bytes, scope)
    sha = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    few = again.count() <= BROADCAST_REVISITS
    again = again.select(F.col("id").alias("id2"), F.col("sha").alias("sha2"), "refers_to")
    marked = pages.withColumn("sha", sha).join(
        F.broadcast(again) if few else again.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("sha") == F.col("sha2")), "left"
    )
    text = [F.col("id").cast("string").alias("page"), "url", "html", F.col("refers_to").cast("string").alias("refers_to")]
    # with the captures written, the archives are not written again
    return table(marked.select(*text).mapInArrow(_write(folder), "archive string, key string, offset long, length long"), "warc-captures", scope)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, keys, lines = TaskContext.get().partitionId(), 0, [], []

    def flush():
        return pa.record_batch([pa.array([part << 32 | number], pa.int64()), pa.array([keys[0]]), pa.array([zlib.compress("\n".join(lines).encode(), 6)], pa.binary())], names=["block", "first_key", "data"])

    for batch in batches:
        for key, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys.append(key)
            lines.append(f"{key.replace('%', '%25').replace(chr(10), '%0A').replace(chr(9), '%09')}\t{archive}\t{offset}\t{length}")
            if len(keys) == BLOCK_LINES:
                yield flush()
                number, keys, lines = number + 1, [], []
    if keys:
        yield flush()


def _lines(data: bytes) -> list[tuple[str, str, int, int]]:
    out = []
    for line in zlib.decompress(data).decode().split("\n"):
        key, archive, offset, length = line.split("\t")
        out.append((key.replace("%09", "\t").replace("%0A", "\n").replace("%25", "%"), archive, int(offset), int(length)))
    return out


class CaptureIndex:
    """Blocks of sorted captures below a directory below a sparse top level."""

    def __init__(self, written: DataFrame, scope: str = ""):
        captures = written.select("key", "archive", "offset", "length")
        self.spark = written.sparkSession
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), captures.count() // CAPTURES_PER_TASK)
        # copies of a key may be many: their places keep them in several ranges
        order = ["key", "archive", "offset"]
        ordered = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        self.blocks = table(ordered.mapInArrow(_blocks, "block long, first_key string, data binary"), "warc-blocks", scope)
        count = self.blocks.count()
        stride = count // TOP_KEYS + 1
        # blocks are numbered in key order; every partition's first block is among the heads
        heads = self.blocks.filter(F.pmod(F.col("block").bitwiseAND((1 << 32) - 1), F.lit(stride)) == 0).select("block", "first_key")
        top = sorted(heads.collect())
        self.stride = stride
        self.top = self.spark.sparkContext.broadcast(([r.first_key for r in top], [r.block for r in top]))
        self.directory = self.blocks.select(
            (F.col("block") - F.pmod(F.col("block").bitwiseAND((1 << 32) - 1), F.lit(stride))).alias("head"), "block", "first_key"
        )

    def locate(self, keys: DataFrame) -> DataFrame:
        """(key, block) for each of ``keys`` (key) and each block that may hold it: those that begin with it and the last that begins before it."""
        found = keys.mapInArrow(_search(self.top), "key string, head long")
        if self.stride == 1:
            return found.select("key", F.col("head").alias("block"))
        # a stretch has ``stride`` keys at most
        stretch = self.directory.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("first_key", "block"))).alias("below"))
        may_hold = F.expr("concat(slice(filter(below, x -> x.first_key < key), -1, 1), filter(below, x -> x.first_key = key))")
        return found.join(stretch, "head").select("key", F.explode(may_hold).alias("at")).select("key", F.col("at.block").alias("block"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(key, archive, offset, length) of the captures with exactly these keys."""
        wanted = self.locate(keys.distinct()).groupBy("block").agg(F.collect_list("key").alias("keys"))
        return wanted.join(self.blocks.select("block", "data"), "block").select("keys", "data").mapInArrow(_within, "key string, archive string, offset long, length long")

    def captures_of(self, url: str) -> list[tuple[str, str, int, int]]:
        """All captures of one URL, by binary search from the driver and reads of the blocks that may hold it."""
        low, high = f"{surt(url)} ", f"{surt(url)}!"
        keys, blocks = self.top.value
        if not keys:
            return []
        first, last = blocks[max(0, bisect.bisect_left(keys, low) - 1)], blocks[max(0, bisect.bisect_right(keys, high) - 1)] + self.stride - 1
        rows = self.blocks.filter((F.col("block") >= first) & (F.col("block") <= last)).sort("block").toLocalIterator()
        return [line for r in rows for line in _lines(bytes(r.data)) if low <= line[0] < high]


def _search(top):
    """Each key with the last head below it and all heads equal to it: copies of a key may fill several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, blocks = top.value
        for batch in batches:
            own, at = [], []
            for k in batch.column(0).to_pylist():
                heads = blocks[max(0, bisect.bisect_left(keys, k) - 1) : bisect.bisect_right(keys, k)]
                own += [k] * len(heads)
                at += heads
            yield pa.record_batch([pa.array(own, pa.string()), pa.array(at, pa.int64())], names=["key", "head"])

    return run


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for wanted, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            lines = _lines(data.as_py())
            keys = [x[0] for x in lines]
            for k in wanted:
                out += lines[bisect.bisect_left(keys, k) : bisect.bisect_right(keys, k)]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["key", "archive", "offset", "length"])


def _range_reads(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        at, file = None, None
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = []
                for archive, offset, length in zip(*(c.to_pylist() for c in batch.slice(begin, 500).columns), strict=True):
                    if archive != at:
                        if file is not None:
                            file.close()
                        at, file = archive, store.open_input_file(f"{root}/{archive}")
                    rows.append(parse(file.read_at(length, offset)))
                columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file is not None:
            file.close()

    return run


def read_records(folder: str, found: DataFrame) -> DataFrame:
    """The records at the places in ``found`` (archive, offset, length): page, payload_bytes, payload_digest, record_type, refers_to."""
    asked = found.agg(F.sum("length")).first()[0] or 0
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), asked // READ_BYTES + 1)
    places = found.select("archive", "offset", "length").repartition(parts, "archive").sortWithinPartitions("archive", "offset")
    return places.mapInArrow(_range_reads(folder), "page string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array([capture_key(u, p) for p, u in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.string())], names=["key"])


def archive_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, folder: str | None = None, scope: str = ""
) -> DataFrame:
    """Write all pages, index them, and look every page up again: id, payload_bytes, payload_digest, record_type, refers_to.

    Without a ``folder`` of their own the archives go to the shared scratch folder, and with it.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    folder = folder or new_path(pages.sparkSession, "warc-archives", scope)
    written = write_archives(pages, folder, id_col, url_col, html_col, min_bytes, scope)
    index = CaptureIndex(written, scope)
    keys = pages.select(F.col(id_col).cast("string").alias("page"), F.col(url_col).alias("url")).mapInArrow(_keys, "key string")
    found = table(index.lookup(keys), "warc-found", scope)
    records = read_records(folder, found)
    return records.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
