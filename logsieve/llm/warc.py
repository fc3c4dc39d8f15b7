"""Web archives: records written as one gzip stream per file, normalised to a member per record, read by an offset index."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.session import materialise, scratch_dir

_CHUNK = 1 << 20
_CRLF = b"\r\n"
#: Fixed values of the WARC format.
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Most bytes of a record's head; a longer one is no record.
_HEAD = 1 << 20


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a folder that driver and executors share, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def digest_name(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()


def _fields(pairs: list[tuple[str, object]]) -> bytes:
    """A record's head. Characters that would end a line are written as percent codes."""
    def one_line(value):
        return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in str(value))

    return b"".join([_VERSION, _CRLF, *[f"{k}: {one_line(v)}\r\n".encode() for k, v in pairs if v is not None], _CRLF])


def record_name(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> tuple[bytes, bytes]:
    """Head and block of a page's record. A revisit carries the digest and the length of the payload, but not the payload."""
    http = _HTTP % len(payload)
    block = http if revisit else http + payload
    head = _fields([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_name(page, digest)), ("WARC-Date", _DATE),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"),
        ("WARC-Profile", _PROFILE if revisit else None), ("WARC-Refers-To", record_name(refers_to, digest) if revisit else None),
        ("X-Page-ID", page), ("X-Refers-To-Page-ID", refers_to if revisit else None), ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ])
    return head, block


class _Inflated:
    """The bytes of a gzip file of one member or several, inflated as they are read and never held whole."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.inflater, self.held = stream, zlib.decompressobj(31), b""

    def _more(self) -> bytes:
        while True:
            if self.inflater.eof:
                rest = self.inflater.unused_data or self.stream.read(_CHUNK)
                if not rest:
                    return b""
                self.inflater = zlib.decompressobj(31)
                given = rest
            else:
                given = self.inflater.unconsumed_tail or self.stream.read(_CHUNK)
                if not given:
                    raise ValueError("the archive ends inside a gzip member")
            made = self.inflater.decompress(given, _CHUNK)
            if made:
                return made

    def at_end(self) -> bool:
        if not self.held:
            self.held = self._more()
        return not self.held

    def line(self) -> bytes:
        while (at := self.held.find(b"\n")) < 0:
            more = self._more()
            if not more or len(self.held) > _HEAD:
                raise ValueError("the archive holds something that is no record")
            self.held += more
        found, self.held = self.held[: at + 1], self.held[at + 1 :]
        return found

    def blocks(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at_end():
                raise ValueError("the archive ends inside a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def read_head(lines: Callable[[], bytes]) -> tuple[bytes, dict[str, str]]:
    """The bytes of a head and its fields by lower-case name."""
    first = lines()
    if not first.startswith(b"WARC/"):
        raise ValueError("the archive holds something that is no record")
    raw, fields = [first], {}
    while (line := lines()) not in (_CRLF, b"\n"):
        raw.append(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
        if sum(map(len, raw)) > _HEAD:
            raise ValueError("the archive holds something that is no record")
    return b"".join([*raw, line]), fields


def normalised(source: BinaryIO, target: BinaryIO, level: int = 6) -> Iterator[dict]:
    """Rewrites every record of an archive as a gzip member of its own and tells where it lies.

    ``source`` is inflated once, as a stream; a record passes through in pieces, so neither an archive nor a record has
    to fit into memory.
    """
    given, at = _Inflated(source), 0
    while not given.at_end():
        raw, fields = read_head(given.line)
        member, length = zlib.compressobj(level, zlib.DEFLATED, 31), int(fields["content-length"])
        size = target.write(member.compress(raw))
        for part in given.blocks(length):
            size += target.write(member.compress(part))
        if b"".join(given.blocks(4)) != 2 * _CRLF:
            raise ValueError("a record is longer than it says")
        size += target.write(member.compress(2 * _CRLF) + member.flush())
        yield {"offset": at, "length": size, "type": fields.get("warc-type", ""), "id": fields.get("warc-record-id"),
               "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
        at += size


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of the record in a gzip member."""
    raw = zlib.decompress(member, 31)
    at = 0

    def line() -> bytes:
        nonlocal at
        end = raw.index(b"\n", at) + 1
        found, at = raw[at:end], end
        return found

    _, fields = read_head(line)
    return fields, raw[at : at + int(fields["content-length"])]


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page, url, payload, digest, refers_to, revisit``: payloads of ``least`` bytes that another page has are revisits of it.

    ``pages``: ``page, url, payload``. The page with the largest id is the one referred to.
    """
    given = pages.withColumn("digest", F.sha1("payload"))
    long = given.where(F.octet_length("payload") >= least)
    owners = long.groupBy("digest").agg(F.max("page").alias("owner"), F.count("*").alias("n")).where("n > 1")
    # written, so that the planner knows its size and sends it to the payloads only if it is small
    owners = materialise(owners.select(F.col("digest").alias("same"), "owner"), "owners")
    told = given.join(owners, (F.col("digest") == F.col("same")) & (F.octet_length("payload") >= least), "left")
    revisit = F.col("same").isNotNull() & ~F.col("page").eqNullSafe(F.col("owner"))
    return told.select("page", "url", "payload", "digest", F.when(revisit, F.col("owner")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(records: DataFrame, folder: str, most_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Writes ``records`` to archives, each one gzip stream, and gives their ``archive, records, bytes``.

    A task begins a new archive after ``most_bytes`` before compression. These archives are read once, so ``level`` is low. Names are new for every attempt and only the
    table that is returned, written when its task is done, says which archives count; what a lost task left does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        name, out, packer, held, count = None, None, None, 0, 0

        def close():
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [count], "bytes": [held]})

        for batch in batches:
            for page, url, payload, digest, refers_to, revisit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    name, packer, held, count = f"pages-{uuid.uuid4().hex}.warc.gz", zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = b"software: logsieve\r\nformat: WARC File Format 1.1\r\n"
                    head = _fields([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE),
                                    ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))])
                    out.write(packer.compress(head + info + 2 * _CRLF))
                head, block = page_record(page, url, payload, digest, refers_to, revisit)
                for part in (head, block, 2 * _CRLF):
                    out.write(packer.compress(part))
                held, count = held + len(head) + len(block) + 4, count + 1
                if held >= most_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    columns = ["page", "url", "payload", "digest", "refers_to", "revisit"]
    return materialise(records.select(columns).mapInArrow(run, "archive string, records long, bytes long"), "archives")


_INDEX = "archive string, offset long, length long, type string, id string, uri string, digest string"


def normalise_archives(archives: DataFrame, source: str, target: str, level: int = 4) -> DataFrame:
    """Normalises the archives named in ``archives`` from folder ``source`` to ``target``; the index of all their records.

    Beside every archive lies its own index, a JSON object a line (``<archive>.idx``). An archive is one unit of work.
    """
    spread = archives.select("archive").repartition(max(1, archives.count()), "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (given, root), (store, out) = opened(source), opened(target)
        store.create_dir(out, recursive=True)
        names = [c.split()[0] for c in _INDEX.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                # its own name for every attempt, so that none overwrites what another one's index speaks of
                made = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                held: dict[str, list] = {n: [] for n in names}
                with (given.open_input_stream(f"{root}/{name}", compression=None) as read,
                      store.open_output_stream(f"{out}/{made}", compression=None) as wrote,
                      store.open_output_stream(f"{out}/{made}.idx", compression=None) as index):
                    for entry in normalised(read, wrote, level):
                        index.write(json.dumps(entry).encode() + b"\n")
                        for n in names:
                            held[n].append(made if n == "archive" else entry[n])
                        if len(held["id"]) == 4096:
                            yield pa.RecordBatch.from_pydict(held, schema=_INDEX_SCHEMA)
                            held = {n: [] for n in names}
                if held["id"]:
                    yield pa.RecordBatch.from_pydict(held, schema=_INDEX_SCHEMA)

    return materialise(spread.mapInArrow(run, _INDEX), "index")


_INDEX_SCHEMA = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()),
                           ("id", pa.string()), ("uri", pa.string()), ("digest", pa.string())])


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Pages of the records in ``index``, each read alone at its offset: ``page, url, payload_bytes, payload_digest, record_type, refers_to``.

    ``with_payload`` adds the text of responses. A response whose payload does not have its digest is an error.
    """
    schema = "page long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload string" if with_payload else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if archive != name:
                    name, file = archive, store.open_input_file(f"{root}/{archive}")
                fields, block = read_record(file.read_at(length, offset))
                told = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                revisit, payload, size = fields["warc-type"] == "revisit", None, int(fields.get("x-payload-length", -1))
                if not revisit:
                    payload = block[block.index(2 * _CRLF) + 4 :]
                    size = len(payload)
                    if digest_name(payload) != told:
                        raise ValueError(f"record {fields['warc-record-id']} does not have the payload it says")
                page, refers = (int(fields[f]) if f in fields else None for f in ("x-page-id", "x-refers-to-page-id"))
                row = (page, fields.get("warc-target-uri"), size, told, fields["warc-type"], refers)
                rows.append((*row, None if payload is None else payload.decode()) if with_payload else row)
            if rows:
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types)]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    pages = index.where(F.col("type").isin("response", "revisit")).select("archive", "offset", "length")
    return pages.mapInArrow(run, schema)


def archive_pages(
    pages: DataFrame, least: int = 1000, most_bytes: int = 64 << 20, folder: str | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """``id_col, payload_bytes, payload_digest, record_type, refers_to`` of every page, read back from its archives.

    Pages are written as records, a gzip stream an archive (``folder/raw``), normalised to a member a record with an
    index beside it (``folder/normal``), and read by offset. ``folder`` has to be shared by driver and executors; it is
    a new one below ``spark.checkpoint.dir`` if none is given.

    The payload is the text in UTF-8, empty if it is null. Of equal payloads of ``least`` bytes or more the page with the
    largest id is the response and the others are revisits; rows that share the largest id are all responses, and a null
    id is less than any other. Null ids and urls are left out of the record and are null again. Repeated rows give a
    record each, whole texts are written whatever their length, an empty table gives no archive and no rows, and further
    columns are not read. Digest and length of a revisit are those of the payload it stands for.
    """
    folder = folder or scratch_dir(pages.sparkSession, "warc")
    payload = F.coalesce(pages[html_col].cast("binary"), F.lit(b""))
    given = pages.select(pages[id_col].cast("long").alias("page"), pages[url_col].alias("url"), payload.alias("payload"))
    archives = write_archives(with_revisits(given, least), f"{folder}/raw", most_bytes)
    index = normalise_archives(archives, f"{folder}/raw", f"{folder}/normal")
    read = read_records(index, f"{folder}/normal")
    kind = pages.schema[id_col].dataType
    return read.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind).alias("refers_to"))
