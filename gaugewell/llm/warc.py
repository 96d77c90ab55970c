"""Web archives as a table of records and chunks, written and read back by Spark.

A payload is never held whole in Python: it is a run of rows (record, chunk
number, at most ``CHUNK`` bytes), in order. A SHA-256 goes along with them, so
every row knows the size and the digest of all up to it, and the last one those
of the payload. ``chunk_rows`` makes such rows from a table of pages,
``read_chunks`` from archives.

An archive is a gzip file of WARC/1.1 records. A payload of several chunks is
written in segments, as the format has it: the first in the response record, the
others in continuation records, of which the last has the digest. Of equal
payloads the first is stored; the others are revisit records that name it and
hold none. Spark's text writer and reader move the bytes, so archives can be in
any store that Spark reaches. The reader parts records where ``WARC/1.1`` starts a
line after an empty one; as no chunk holds ``WARC/1.1`` (it is cut within), each
row is one whole record. A file is read by one task, in order.

The pages are scanned twice, for the digests and to be written, and are only
shuffled if the revisits are too many for Spark to send to every executor. A task
that is tried again writes the same records.

Cases: a null html is an empty payload, of one empty chunk. Payloads under
``least`` bytes are all responses. Equal payloads are told by SHA-256; the first
is the one with the smallest page_id, and rows that share that id are all
responses. A null page_id comes last and is never referred to; if all are null,
all are responses. Repeated rows are records of their own. A null url is left out
of its record; white space, control characters and those outside ASCII are
percent-encoded in a url. An empty table gives archives without records. Columns
besides page_id, url and html are not read. A damaged archive (wrong length, wrong
digest, missing segment) raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

CHUNK = 1 << 18
_MARK = b"WARC/1.1"
_CUT = 2  # so many bytes of a mark in a payload stay in the earlier chunk
_SEPARATOR = "\r\n\r\nWARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URI_SAFE = ":/?#[]@!$&'()*+,;=%~"
_BATCH_BYTES = 4 << 20
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


class Running:
    """Number, size and digest of a payload's chunks so far."""

    def __init__(self) -> None:
        self.hash, self.size, self.chunk = hashlib.sha256(), 0, -1

    def add(self, data: bytes) -> None:
        self.hash.update(data)
        self.size += len(data)
        self.chunk += 1

    @property
    def digest(self) -> str:
        return self.hash.hexdigest()


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))


def _sliced(pages: DataFrame, size: int) -> DataFrame:
    """A row for each slice of ``html`` instead, with columns data and last; slices of a page follow each other."""
    end = F.greatest(F.ceil(F.octet_length("html") / size) - 1, F.lit(0)).cast("int")
    slices = F.transform(
        F.sequence(F.lit(0), end), lambda i: F.struct(F.substring("html", i * size + 1, F.lit(size)).alias("data"), (i == end).alias("last"))
    )
    rest = [c for c in pages.columns if c != "html"]
    return pages.select(*rest, F.explode(slices).alias("c")).select(*rest, "c.data", "c.last")


def _without_mark(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces none of which holds the mark."""
    at = 0
    for hit in re.finditer(re.escape(_MARK), data):
        yield data[at : hit.start() + _CUT]
        at = hit.start() + _CUT
    yield data[at:]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Running, bytes, bool]]:
    """Per chunk: the page's columns, the payload so far, the chunk, whether it is the last."""
    now = Running()
    for batch in batches:
        for i in range(batch.num_rows):
            *page, data, last = (column[i].as_py() for column in batch.columns)
            pieces = list(_without_mark(data))
            for k, piece in enumerate(pieces):
                now.add(piece)
                yield tuple(page), now, piece, last and k == len(pieces) - 1
            if last:
                now = Running()


def _batches(rows: Iterator[tuple], schema: pa.Schema, data: int | None = None) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches of some 4 MB; ``data``: the column that holds bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 300 + (len(row[data] or b"") if data is not None else 0)
        if size > _BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _id_type(kind: str) -> pa.DataType:
    return pa.string() if kind == "string" else pa.int64()


def _id_kind(pages: DataFrame) -> str:
    """``page_id`` goes through the archives as a whole number or a string."""
    kind = dict(pages.dtypes)["page_id"]
    if kind != "string" and kind not in _INTEGERS:
        raise TypeError(f"page_id: {kind}")
    return "string" if kind == "string" else "bigint"


def chunk_rows(pages: DataFrame, size: int = CHUNK, data: bool = True) -> DataFrame:
    """Per chunk, in order: page_id, chunk, last, size, digest, data.

    ``size`` and ``digest`` are those of the payload up to and with the chunk.
    Without ``data`` only the last chunks' rows are given, and no bytes.
    """
    kind = _id_kind(pages)
    schema = pa.schema([
        ("page_id", _id_type(kind)), ("chunk", pa.int32()), ("last", pa.bool_()),
        ("size", pa.int64()), ("digest", pa.string()), ("data", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (page, now.chunk, last, now.size, now.digest, piece if data else None)
            for (page,), now, piece, last in _walk(batches)
            if data or last
        )
        yield from _batches(rows, schema, 5)

    html = pages.select(F.col("page_id").cast(kind).alias("page_id"), _payload().alias("html"))
    return _sliced(html, size).mapInArrow(run, f"page_id {kind}, chunk int, last boolean, size long, digest string, data binary")


def revisits(heads: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload an earlier page has.

    ``heads``: page_id, size and digest of each page.
    """
    heads = heads.filter(F.col("size") >= least).select("page_id", "digest")
    first = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    # written, so that both sides of the join are shuffled and a frequent payload can be split
    first = stored(first.filter("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to"), "first_payloads")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to"))
    return heads.join(first, "digest").filter(later).select("page_id", "digest", "refers_to").distinct()


def _name(page: object) -> str:
    return "<urn:page>" if page is None else f"<urn:page:{quote(str(page), safe='')}>"


def _page(name: str, number: bool) -> object:
    value = name.removeprefix("<urn:page").removesuffix(">")
    if not value:
        return None
    return int(value[1:]) if number else unquote(value[1:])


def _record(page: tuple, now: Running, piece: bytes, last: bool, date: str) -> bytes:
    """The record of a chunk, without the line end that the writer adds."""
    page_id, url, refers_to, digest, whole = page
    head, http = {}, b""
    if now.chunk:
        head["WARC-Type"] = "continuation"
        head["WARC-Record-ID"] = f"{_name(page_id)[:-1]}#{now.chunk}>"
        head["WARC-Segment-Origin-ID"] = _name(page_id)
    else:
        head["WARC-Type"] = "response" if refers_to is None else "revisit"
        head["WARC-Record-ID"] = _name(page_id)
        if url is not None:
            head["WARC-Target-URI"] = quote(url, safe=_URI_SAFE)
        if refers_to is not None:
            head["WARC-Profile"] = _PROFILE
            head["WARC-Refers-To"] = _name(refers_to)
        head["Content-Type"] = "application/http; msgtype=response"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {whole}\r\n\r\n".encode()
    head["WARC-Date"] = date
    if now.chunk or not last:
        head["WARC-Segment-Number"] = str(now.chunk + 1)
    if now.chunk and last:
        head["WARC-Segment-Total-Length"] = str(now.size)
    if last:
        head["WARC-Payload-Digest"] = f"sha256:{now.digest if refers_to is None else digest}"
    head["Content-Length"] = str(len(http) + len(piece))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"".join([_MARK, b"\r\n", lines.encode(), b"\r\n", http, piece, b"\r\n"])


def write_archives(pages: DataFrame, path: str, least: int = 100, date: str = "2024-01-01T00:00:00Z", size: int = CHUNK) -> None:
    """Write a record for each page to gzip files in the new folder ``path``."""
    kind = _id_kind(pages)
    heads = stored(chunk_rows(pages, size, data=False).select("page_id", "size", "digest"), "payload_digests")
    again = stored(revisits(heads, least), "revisits")
    p = pages.select(F.col("page_id").cast(kind).alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("html"))
    same = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.sha2("p.html", 256) == F.col("r.digest"))
    typed = p.alias("p").join(again.alias("r"), same, "left").select(
        "p.page_id", "p.url", "r.refers_to", "r.digest", F.octet_length("p.html").cast("long").alias("whole"),
        F.when(F.col("r.refers_to").isNull(), F.col("p.html")).otherwise(F.lit("").cast("binary")).alias("html"),
    )
    schema = pa.schema([("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((_record(*chunk, date),) for chunk in _walk(batches)), schema, 0)

    records = _sliced(typed, size).mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


class _Reader:
    """Records of one file, in order, to rows of ``read_chunks``."""

    def __init__(self, number: bool, data: bool) -> None:
        self.number, self.data, self.now, self.first = number, data, None, {}

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for raw in batch.column(0):
                raw = raw.as_py()
                if raw.startswith(_MARK):  # the first of its file
                    self.close()
                    raw = raw[len(_MARK) + 2 :]
                if raw:
                    yield from self.row(raw)
        self.close()

    def close(self) -> None:
        if self.now is not None:
            raise ValueError(f"archive ends within {self.first['WARC-Record-ID']}")

    @staticmethod
    def _head(raw: bytes) -> tuple[dict[str, str], bytes]:
        lines, _, body = raw.partition(b"\r\n\r\n")
        return dict(x.split(": ", 1) for x in lines.decode().split("\r\n") if ": " in x), body

    def row(self, raw: bytes) -> Iterator[tuple]:
        head, body = self._head(raw)
        name, length = head["WARC-Record-ID"], int(head["Content-Length"])
        if len(body) < length or body[length:] not in (b"", b"\r\n\r\n"):
            raise ValueError(f"{name}: {len(body)} bytes instead of {length}")
        body = body[:length]
        if head["WARC-Type"] == "continuation":
            if self.now is None or head["WARC-Segment-Origin-ID"] != self.first["WARC-Record-ID"] or int(head["WARC-Segment-Number"]) != self.now.chunk + 2:
                raise ValueError(f"{name}: a segment is missing")
        else:
            self.close()
            self.now, self.first = Running(), head
            http, body = self._head(body)
            self.whole = int(http["Content-Length"])
        now, first, digest = self.now, self.first, head.get("WARC-Payload-Digest", "").removeprefix("sha256:")
        now.add(body)
        revisit, last = first["WARC-Type"] == "revisit", bool(digest)
        if last and not revisit and (digest, self.whole) != (now.digest, now.size):
            raise ValueError(f"{name}: the payload is not what its digest says")
        if last or self.data:
            yield (
                _page(first["WARC-Record-ID"], self.number), first["WARC-Type"],
                _page(first["WARC-Refers-To"], self.number) if revisit else None, first.get("WARC-Target-URI"), now.chunk, last,
                self.whole if revisit else now.size, digest if revisit else now.digest, body if self.data else None,
            )
        if last:
            self.now = None


def read_chunks(spark: SparkSession, path: str, id_kind: str = "bigint", data: bool = True) -> DataFrame:
    """Per chunk in the archives: page_id, record_type, refers_to, uri, chunk, last, size, digest, data.

    ``size`` and ``digest`` are those of the payload up to and with the chunk, for
    revisits those of the payload they refer to. Without ``data`` only the last
    chunks' rows are given, that is one a record.
    """
    schema = pa.schema([
        ("page_id", _id_type(id_kind)), ("record_type", pa.string()), ("refers_to", _id_type(id_kind)), ("uri", pa.string()),
        ("chunk", pa.int32()), ("last", pa.bool_()), ("size", pa.int64()), ("digest", pa.string()), ("data", pa.binary()),
    ])
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = lambda batches: _batches(
        _Reader(id_kind != "string", data).rows(batches), schema, 8
    )
    raw = spark.read.option("lineSep", _SEPARATOR).text(path).select(F.col("value").cast("binary").alias("raw"))
    return raw.mapInArrow(
        run, f"page_id {id_kind}, record_type string, refers_to {id_kind}, uri string, chunk int, last boolean, size long, digest string, data binary"
    )


def unresolved(records: DataFrame) -> DataFrame:
    """The revisits among ``records`` (rows of last chunks) whose response is not among them, by page_id and digest."""
    asked = records.filter("record_type = 'revisit'").select("refers_to", "digest").distinct()
    there = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "digest")
    return asked.join(there, ["refers_to", "digest"], "left_anti")
