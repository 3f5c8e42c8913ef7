"""WARC archives as a Spark data source, both ways.

Reading: ``path`` is an archive that was written here, a folder of ``.warc`` and ``.warc.gz`` files, or one
file; ``option("files", ...)`` is a JSON list of names below ``path`` instead of a listing.  Files may be
plain, one gzip member per record, or gzip of any other cut.  A partition is a file, or a part of one where offsets
are known: the archive's own manifest holds some, ``index_archive`` finds them for other files
(``option("index", ...)``).  Equality and ``in`` predicates on the record type and on other header columns
are pushed into the reader, which inflates a record only as far as its header block and, unless the
record is wanted, goes on at the next one: by a seek in plain files and in members that say in their extra field
how long they are, else by inflating without keeping.  ``option("payload", "false")`` leaves every payload undecoded.

The block of an ``application/http`` record is taken apart: ``http_head`` and, as ``payload``, what follows it.  Transfer
and content encodings of that body are left as they are.

Writing: every task writes its own file, at the size of ``option("roll")``
the next one; the manifest names the files of the tasks that were committed, so a
lost or repeated task leaves nothing that is read.

Defined cases: a null payload is written as an empty one, null headers are
left out and read as null, a null date is that of the write.  Header names have no case.  A value with line breaks
or outer blanks is percent-escaped and its header named in ``WARC-Escaped``; all others stand as they are.  Headers that aren't
UTF-8 are read with replacement characters; a length that is no number is null.  No rows give an archive without records.  A file that
ends within a record, or holds something else, is an error that tells the file.
"""

from __future__ import annotations

import datetime
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from vaultshift.operators.files import filesystem
from vaultshift.session import shared_uri, written

MANIFEST = "archive.json"
#: Column -> header.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "WARC-Payload-Length",
}
LONGS = {"payload_length", "content_length"}
SCHEMA = T.StructType([T.StructField(c, T.LongType() if c in LONGS else T.StringType()) for c in HEADERS]
                      + [T.StructField("http_head", T.StringType()), T.StructField("payload", T.BinaryType())])
ARROW = pa.schema([(c, pa.int64() if c in LONGS else pa.string()) for c in HEADERS] + [("http_head", pa.string()), ("payload", pa.binary())])
#: Fixed values of the format: the profile of a record that repeats a payload, the type of a whole HTTP answer.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http"
ESCAPED = "WARC-Escaped"
#: Payloads below this size are never replaced by a revisit record.
LEAST_REVISIT = 100
#: A partition of a file whose offsets are known has about this many bytes.
SPLIT = 64 << 20
#: The longest header block.
MOST_HEAD = 1 << 20
_READ, _BATCH_BYTES = 1 << 16, 4 << 20
_NAMES = {h.lower(): h for h in [*HEADERS.values(), ESCAPED]}
_PLAIN = "".join(map(chr, range(33, 127))).replace("%", "")


def _escaped(value: str) -> str:
    return urllib.parse.quote(value, safe=_PLAIN)


def _unescaped(value: str) -> str:
    return urllib.parse.unquote(value)


def member(record: bytes) -> bytes:
    """A gzip member whose extra field ``WL`` holds the length of what follows it."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    body += struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    extra = b"WL" + struct.pack("<HQ", 8, len(body))
    return b"\x1f\x8b\x08\x04" + struct.pack("<I", 0) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body


def encode_record(headers: dict[str, str], payload: bytes) -> bytes:
    unsafe = [k for k, v in headers.items() if "\r" in v or "\n" in v or v != v.strip(" \t")]
    shown = {k: _escaped(v) if k in unsafe else v for k, v in headers.items()}
    if unsafe:
        shown[ESCAPED] = ",".join(unsafe)
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in shown.items()), f"Content-Length: {len(payload)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def decode_headers(head: bytes) -> dict[str, str]:
    """Header fields under their names' usual spelling; folded lines are joined, of repeated names the first counts."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record of a WARC archive: {first[:40]!r}")
    fields, last = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and last is not None:
            fields[last] += " " + line.strip(" \t")
        elif ":" in line:
            name, value = line.split(":", 1)
            name = _NAMES.get(name.strip(" \t").lower(), name.strip(" \t"))
            last = None if name in fields else name
            fields.setdefault(name, value.strip(" \t"))
    for name in filter(None, fields.pop(ESCAPED, "").split(",")):
        if name in fields:
            fields[name] = _unescaped(fields[name])
    return fields


class _Plain:
    """The bytes of an archive from an offset on, in pieces."""

    def __init__(self, file, start: int):
        self.file, self.at = file, start
        #: Read but not yet taken; ``at`` is the offset of what follows.
        self.have = b""
        file.seek(start)

    def fill(self, size: int) -> bool:
        data = self.file.read(size)
        self.at += len(data)
        self.have += data
        return bool(data)

    def until(self, mark: bytes, most: int) -> bytes | None:
        """What stands before ``mark``, which is taken too; None if it isn't within the next ``most`` bytes."""
        seen = 0
        while True:
            cut = self.have.find(mark, max(seen - len(mark) + 1, 0), most)
            if cut >= 0:
                out, self.have = self.have[:cut], self.have[cut + len(mark):]
                return out
            seen = len(self.have)
            if seen >= most or not self.fill(512 if not seen else 4096):
                return None

    def take(self, n: int, keep: bool = True) -> bytes:
        parts = []
        while n > 0:
            if not self.have and not self.fill(_READ):
                raise ValueError("the file ends within a record")
            piece, self.have = self.have[:n], self.have[n:]
            n -= len(piece)
            if keep:
                parts.append(piece)
        return b"".join(parts)

    def skip(self, n: int, alone: bool) -> None:
        """Past ``n`` more bytes of a record; ``alone``: it began where a compressed member did."""
        if n > len(self.have):
            self.at += n - len(self.have) - 1
            self.file.seek(self.at)
            self.have = b""
            if not self.fill(1):
                raise ValueError("the file ends within a record")
            self.have = b""
        else:
            self.have = self.have[n:]

    def settle(self) -> None:
        """Past the line breaks after a record."""
        while True:
            self.have = self.have.lstrip(b"\r\n")
            if self.have or not self.fill(512):
                return

    def offset(self) -> int | None:
        """The offset in the file, where one could begin to read here."""
        return self.at - len(self.have)


class _Gzip(_Plain):
    """The inflated bytes of gzip members one after the other."""

    def __init__(self, file, start: int):
        super().__init__(file, start)
        #: ``raw`` is read but not yet inflated, ``at`` its offset.
        self.raw, self.piece, self.inflate, self.end, self.crc = b"", 512, None, None, 0

    def _more(self) -> bool:
        data = self.file.read(self.piece)
        self.piece = min(4 * self.piece, _READ)
        self.raw += data
        return bool(data)

    def _need(self, n: int) -> None:
        while len(self.raw) < n:
            if not self._more():
                raise ValueError("the file ends within a gzip member")

    def _drop(self, n: int) -> None:
        self.raw, self.at = self.raw[n:], self.at + n

    def _open(self) -> bool:
        while True:  # zeros may fill up a file
            self._drop(len(self.raw) - len(self.raw.lstrip(b"\0")))
            if self.raw:
                break
            if not self._more():
                return False
        self._need(10)
        if self.raw[:3] != b"\x1f\x8b\x08":
            raise ValueError("no gzip member where one is due")
        flags, size, length = self.raw[3], 10, None
        if flags & 4:
            self._need(size + 2)
            extra = struct.unpack_from("<H", self.raw, size)[0]
            self._need(size + 2 + extra)
            field, last = size + 2, size + 2 + extra
            while field + 4 <= last:
                n = struct.unpack_from("<H", self.raw, field + 2)[0]
                if self.raw[field:field + 2] == b"WL" and n == 8:
                    length = struct.unpack_from("<Q", self.raw, field + 4)[0]
                field += 4 + n
            size = last
        for flag in (8, 16):  # name, comment
            if flags & flag:
                while (zero := self.raw.find(b"\0", size)) < 0:
                    self._need(len(self.raw) + 1)
                size = zero + 1
        if flags & 2:
            size += 2
        self._need(size)
        self._drop(size)
        self.inflate, self.crc = zlib.decompressobj(-15), 0
        self.end = None if length is None else self.at + length
        return True

    def _step(self, size: int) -> None:
        """Inflates at most ``size`` bytes, or comes to the end of the member."""
        if not self.raw:
            self._need(1)
        out = self.inflate.decompress(self.raw, size)
        rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self._drop(len(self.raw) - len(rest))
        self.crc = zlib.crc32(out, self.crc)
        self.have += out
        if self.inflate.eof:
            self._need(8)
            if struct.unpack_from("<I", self.raw)[0] != self.crc:
                raise ValueError("a gzip member whose checksum differs")
            self._drop(8)
            if self.end is not None and self.at != self.end:
                raise ValueError("a gzip member of another length than it says")
            self.inflate = None

    def fill(self, size: int) -> bool:
        before = len(self.have)
        while len(self.have) == before:
            if self.inflate is None and not self._open():
                return False
            self._step(max(size, 4096))
        return True

    def skip(self, n: int, alone: bool) -> None:
        if not alone or self.end is None:
            self.take(n, keep=False)
            return
        if self.end <= self.at + len(self.raw):
            self._drop(self.end - self.at)
        else:
            self.at, self.raw = self.end, b""
            self.file.seek(self.end)
        self.have, self.inflate, self.piece = b"", None, 512

    def settle(self) -> None:
        while True:
            self.have = self.have.lstrip(b"\r\n")
            if self.have or self.inflate is None:
                return
            self._step(4096)

    def offset(self) -> int | None:
        return self.at if not self.have and self.inflate is None else None


class _Record:
    """One record at the place of its block; what isn't taken is skipped."""

    def __init__(self, stream: _Plain, offset: int | None, fields: dict[str, str]):
        self.stream, self.offset, self.fields = stream, offset, fields
        try:
            self.left = int(fields["Content-Length"])
        except (KeyError, ValueError):
            raise ValueError("a record without a length") from None

    def http_head(self) -> str | None:
        if not self.fields.get("Content-Type", "").lower().startswith(HTTP):
            return None
        head = self.stream.until(b"\r\n\r\n", min(self.left, MOST_HEAD))
        if head is None:
            return None
        self.left -= len(head) + 4
        return head.decode("utf-8", "replace")

    def rest(self) -> bytes:
        n, self.left = self.left, 0
        return self.stream.take(n)


def walk(file, start: int = 0, end: int | None = None) -> Iterator[_Record]:
    """Records that begin from ``start`` on and before ``end``, where ``start`` is one of their offsets."""
    file.seek(0)
    stream = (_Gzip if file.read(2) == b"\x1f\x8b" else _Plain)(file, start)
    while True:
        stream.settle()
        offset = stream.offset()
        if end is not None and offset is not None and offset >= end:
            return
        head = stream.until(b"\r\n\r\n", MOST_HEAD)
        if head is None:
            if stream.have:
                raise ValueError("a record without an end of its headers")
            return
        record = _Record(stream, offset, decode_headers(head.lstrip(b"\r\n")))
        yield record
        if record.left:
            stream.skip(record.left, offset is not None)


def records(file, wanted, with_payload: bool, start: int = 0, end: int | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields and block of the records whose headers satisfy ``wanted``; others aren't inflated past their headers."""
    for record in walk(file, start, end):
        if wanted(record.fields):
            yield record.fields, record.rest() if with_payload else None


class _Files(InputPartition):
    def __init__(self, path: str, start: int = 0, end: int | None = None):
        self.path, self.start, self.end = path, start, end


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and value.isascii() and value.isdigit() else None


def _below(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}" if name else base


def archive_files(root: str) -> list[str]:
    """Names of the archive files below a folder; the empty name if ``root`` is a file itself."""
    fs, base = filesystem(root)
    if fs.get_file_info(base).type == pafs.FileType.File:
        return [""]
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
    cut = len(base.rstrip("/")) + 1
    return sorted(x.path[cut:] for x in found if x.type == pafs.FileType.File and x.path.lower().endswith((".warc", ".warc.gz")))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.names = json.loads(options["files"]) if "files" in options else None
        self.index = options.get("index")
        self.equal: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        """Takes equality and ``in`` on header columns; leaves the rest to Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADERS:
                self.equal.append((column, [f.value] if isinstance(f, EqualTo) else list(f.value)))
            else:
                yield f

    def partitions(self):
        """Parts of files: the list of the manifest or of the options, else what the folder holds."""
        fs, base = filesystem(self.root)
        cuts: dict[str, list[int]] = {}
        manifest = _below(base, MANIFEST)
        if self.names is not None:
            cuts = {name: [] for name in self.names}
        elif fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                cuts = json.loads(f.read())["files"]
        else:
            cuts = {name: [] for name in archive_files(self.root)}
        if self.index:
            fs, at = filesystem(self.index)
            with fs.open_input_stream(at) as f:
                known = json.loads(f.read())
            cuts = {name: known.get(name, own) for name, own in cuts.items()}
        return [_Files(name, a, b) for name, own in cuts.items() for a, b in zip([0, *own], [*own, None])] or [_Files(None)]

    def _wanted(self, fields: dict[str, str]) -> bool:
        for column, values in self.equal:
            value = fields.get(HEADERS[column])
            if column in LONGS:
                value = _number(value)
            if value is None or value not in values:
                return False
        return True

    def read(self, partition):
        if partition.path is None:
            return
        fs, base = filesystem(self.root)
        rows, size = [], 0
        with fs.open_input_file(_below(base, partition.path)) as stream:
            try:
                for record in walk(stream, partition.start, partition.end):
                    if not self._wanted(record.fields):
                        continue
                    row = {c: record.fields.get(h) for c, h in HEADERS.items()}
                    row |= {c: _number(row[c]) for c in LONGS}
                    row["http_head"] = record.http_head()
                    row["payload"] = record.rest() if self.with_payload else None
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
            except (ValueError, zlib.error) as e:
                raise ValueError(f"{_below(base, partition.path)}: {e}") from e
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class _Written(WriterCommitMessage):
    def __init__(self, files: dict[str, list[int]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.roll = int(options.get("roll", 256 << 20))
        self.split = int(options.get("split", SPLIT))
        # Taken once, so that a repeated task writes the same records.
        self.date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def _record(self, row: dict) -> bytes:
        headers = {h: str(row[c]) for c, h in HEADERS.items() if row.get(c) is not None and c != "content_length"}
        headers.setdefault("WARC-Date", self.date)
        if row.get("record_type") == "revisit":
            headers["WARC-Profile"] = PROFILE
        block = row.get("payload") or b""
        if row.get("http_head") is not None:
            headers.setdefault("Content-Type", f"{HTTP}; msgtype=response")
            block = row["http_head"].encode() + b"\r\n\r\n" + block
        return member(encode_record(headers, block))

    def write(self, iterator):
        fs, base = filesystem(self.root)
        out, files, size = None, {}, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        files[name] = cuts = []
                        fs.create_dir(base, recursive=True)
                        out, size = fs.open_output_stream(_below(base, name), compression=None), 0
                    elif size - (cuts[-1] if cuts else 0) >= self.split:
                        cuts.append(size)
                    data = self._record(row)
                    out.write(data)
                    size += len(data)
                    if size >= self.roll:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages):
        fs, base = filesystem(self.root)
        fs.create_dir(base, recursive=True)
        files = dict(sorted(x for m in messages if m is not None for x in m.files.items()))
        with fs.open_output_stream(_below(base, MANIFEST)) as f:
            f.write(json.dumps({"files": files}).encode())

    def abort(self, messages):
        """Files of failed tasks are in no manifest and so never read."""


class WarcDataSource(DataSource):
    """``format("warc")``; register with ``spark.dataSource.register(WarcDataSource)``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def write_archive(rows: DataFrame, path: str) -> None:
    """Writes ``rows`` (columns of ``SCHEMA``) as an archive below ``path``."""
    rows.sparkSession.dataSource.register(WarcDataSource)
    rows.select(*SCHEMA.names).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True, **options: str) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    # Only for Python data sources that take filters; without it Spark refuses to read from them.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).options(**options).load(path)


def index_archive(spark: SparkSession, path: str, at: str, split: int = SPLIT) -> None:
    """Writes to the file ``at`` offsets of records, ``split`` bytes or more apart, of each archive file below ``path``.

    One task walks one file, without decoding a payload; ``option("index", at)`` then lets many tasks read it.  The driver
    holds one number per ``split`` bytes.  A file that is one gzip member has no offsets and stays whole.
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                cuts: list[int] = []
                with fs.open_input_file(_below(base, name)) as file:
                    for record in walk(file):
                        if record.offset is not None and record.offset - (cuts[-1] if cuts else 0) >= split:
                            cuts.append(record.offset)
                yield pa.RecordBatch.from_pydict({"name": [name], "cuts": pa.array([cuts], pa.list_(pa.int64()))})

    names = archive_files(path)
    rows = spark.createDataFrame([(x,) for x in names], "name string")
    spread = rows.repartition(max(1, len(names)), "name").mapInArrow(found, "name string, cuts array<bigint>")
    fs, to = filesystem(at)
    fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(to, compression=None) as f:
        f.write(json.dumps({r["name"]: list(r["cuts"]) for r in spread.toLocalIterator()}).encode())


def with_revisits(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """Archive rows of ``pages``: the smallest key of equal payloads is the response, the others revisit it.

    Null payloads are empty; payloads under ``LEAST_REVISIT`` bytes are all responses, and so are rows without a key
    that repeat nothing.
    """
    body = F.coalesce(F.encode(F.col(f"`{payload}`"), "UTF-8"), F.lit(b""))
    p = pages.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{key}`").alias("n"),
                     F.col(f"`{uri}`").alias("target_uri"), body.alias("body"))
    p = p.withColumn("digest", F.sha2("body", 256)).withColumn("bytes", F.octet_length("body").cast("long"))
    # Only payloads that occur more than once, and only digests; written, so that the size is known to the join.
    first = written(p.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest")
                    .agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null")
                    .select("digest", "first"), "warc-first")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("n"))
    return p.join(first, "digest", "left").select(
        record_id(F.col("k")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.when(again, record_id(F.col("first").cast("string"))).alias("refers_to"),
        F.lit(None).cast("string").alias("date"), F.lit("text/html").alias("content_type"), F.lit(None).cast("bigint").alias("content_length"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.col("bytes").alias("payload_length"),
        F.lit(None).cast("string").alias("http_head"), F.when(~again, F.col("body")).alias("payload"))


def record_id(key):
    return F.concat(F.lit("<urn:page:"), F.coalesce(key, F.lit("")), F.lit(">"))


def key_of(record):
    return F.nullif(F.regexp_extract(record, r"^<urn:page:(.*)>$", 1), F.lit(""))


def archive_dir(spark: SparkSession) -> str:
    return shared_uri(spark, "warc")
