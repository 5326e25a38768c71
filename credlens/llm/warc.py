"""WARC derivatives: every response record gives a metadata and a plain-text conversion record.

Both derivatives name the response in ``WARC-Refers-To`` and keep its target URI and date. The
metadata record (``application/warc-fields``) repeats the source's WARC and HTTP headers, its
digests, the page's title, language and links; the conversion record (``text/plain``) is the text
that a reader sees, with the source's digests beside its own. Identifiers are derived from the
response's identifier, so that a task that runs again gives the same records.

Digests are ``sha1:`` and base 32 of SHA-1, as is the custom; the payload is the HTTP body without
transfer and content encodings for the text, and as it was sent for the digest. ``digest_valid``
says whether the payload digest that the response carries is that of its payload (null: it
carries none).

Defined results: records of other types give nothing; null and malformed records give one row of
type ``invalid`` that says why; a null url leaves out the target URI, a null html is an empty
payload and gives an empty text; repeated rows give repeated records; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import urljoin

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlens.llm.shared import materialize

#: The capture date of pages that have none.
DATE = "2025-01-01T00:00:00Z"
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|li|main"
                    r"|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)</title", re.S | re.I)
_LANGUAGE = re.compile(r"""<html\b[^<>]*?\blang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)
_LINK = re.compile(r"""<a\b[^<>]*?\bhref\s*=\s*(?:"([^"<>]*)"|'([^'<>]*)'|([^\s"'<>]+))""", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)

_NAMES = ["record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_digest",
          "digest_valid", "block_digest", "block"]
_DDL = ("record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
        "source_digest string, digest_valid boolean, block_digest string, block string")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: object) -> str:
    """A record identifier made from the parts' hash."""
    h = hashlib.sha256("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC/1.1 record; headers without a value are left out."""
    lines = ["WARC/1.1", *(f"{n}: {one_line(v)}" for n, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def one_line(value: str) -> str:
    return " ".join(value.split())


def _headers(raw: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and headers; a line that starts with a space goes on with the one before."""
    lines = raw.decode("utf-8", "replace").split("\r\n") if b"\r\n" in raw else raw.decode("utf-8", "replace").split("\n")
    found: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            found.append((name.strip(), value.strip()))
    return lines[0], found


def _split(raw: bytes) -> tuple[bytes, bytes]:
    head, mark, body = raw.partition(b"\r\n\r\n")
    return (head, body) if mark else raw.partition(b"\n\n")[::2]


def parse_record(raw: bytes) -> tuple[dict[str, str], list[tuple[str, str]], bytes]:
    """Headers by lower-case name, headers in order, and the block of a record."""
    head, body = _split(raw)
    version, headers = _headers(head)
    if not version.startswith("WARC/"):
        raise ValueError("no WARC version line")
    named = {n.lower(): v for n, v in headers}
    length = named.get("content-length", "")
    if not length.isdigit() or int(length) > len(body):
        raise ValueError("content length is missing or beyond the record")
    return named, headers, body[: int(length)]


def _unchunk(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if not size:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def _decoded(payload: bytes, http: dict[str, str]) -> str:
    """The payload as text, without its encodings; what can't be decoded is replaced."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        payload = _unchunk(payload)
    if http.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            payload = zlib.decompressobj(47).decompress(payload)
        except zlib.error:
            pass
    charset = _CHARSET.search(http.get("content-type", ""))
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def visible_text(page: str) -> str:
    """The text of an HTML page, one line for each block that has any."""
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", _DROPPED.sub("", page))))
    return "\n".join(line for raw in text.split("\n") if (line := " ".join(raw.split())))


def derive(raw: bytes) -> list[tuple]:
    """The derivatives of a record, as rows in the order of _NAMES."""
    warc, headers, block = parse_record(raw)
    if warc.get("warc-type") != "response":
        return []
    source, uri, date = warc.get("warc-record-id"), warc.get("warc-target-uri"), warc.get("warc-date")
    if not source:
        raise ValueError("the response has no identifier")
    head, payload = _split(block) if block[:5] == b"HTTP/" else (b"", block)
    status, http_headers = _headers(head)
    http = {n.lower(): v for n, v in http_headers}
    page = _decoded(payload, http)
    stated, actual = warc.get("warc-payload-digest"), digest(payload)
    is_html = "html" in http.get("content-type", "html").lower()
    text = visible_text(page) if is_html else page

    fields = [(f"source-{n}", v) for n, v in headers] + ([("http-status-line", status)] if status else [])
    fields += [(f"http-{n}", v) for n, v in http_headers]
    fields.append(("computed-payload-digest", actual))
    if is_html:
        clean = _DROPPED.sub("", page)
        if title := _TITLE.search(clean):
            fields.append(("title", html.unescape(_TAG.sub("", title[1]))))
        if language := _LANGUAGE.search(clean):
            fields.append(("language", language[1]))
        for link in _LINK.finditer(clean):
            target = html.unescape(next(g for g in link.groups() if g is not None)).strip()
            try:
                fields.append(("outlink", urljoin(uri or "", target)))
            except ValueError:
                fields.append(("outlink", target))
    meta = "".join(f"{n}: {one_line(v)}\r\n" for n, v in fields)
    valid = None if stated is None else stated == actual
    return [(kind, identifier(source, kind), source, uri, date, form, stated or actual, valid, digest(body.encode("utf-8", "replace")), body)
            for kind, form, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text))]


def _derive(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Column 0 is the record; the others are passed on."""
    for batch in batches:
        rows, owner = [], []
        for k, raw in enumerate(batch.column(0)):
            try:
                if not raw.is_valid:
                    raise ValueError("null record")
                found = derive(raw.as_py())
            except ValueError as error:
                found = [("invalid", *[None] * 8, str(error))]
            rows += found
            owner += [k] * len(found)
        if rows:
            passed = batch.select(range(1, batch.num_columns)).take(pa.array(owner, pa.int64()))
            made = [pa.array(c, schema.field(n).type) for n, c in zip(_NAMES, zip(*rows))]
            yield pa.RecordBatch.from_arrays([*passed.columns, *made], [*passed.schema.names, *_NAMES])


def build_derivatives(records: DataFrame, record_col: str = "record", *keep: str) -> DataFrame:
    """Metadata and conversion records of response records (binary), beside the kept columns."""
    kinds = pa.schema([(n, pa.bool_() if n == "digest_valid" else pa.string()) for n in _NAMES])
    source = records.select(F.col(f"`{record_col}`").alias("_record"), *[F.col(f"`{c}`") for c in keep])
    passed = "".join(f"`{n}` {t}, " for n, t in source.dtypes[1:])
    return source.mapInArrow(partial(_derive, schema=kinds), passed + _DDL)


def _respond(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for page_id, url, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
            payload = (page or "").encode()
            block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode() + payload
            found.append(record([
                ("WARC-Type", "response"), ("WARC-Record-ID", identifier(page_id, url)), ("WARC-Date", date), ("WARC-Target-URI", url),
                ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)),
                ("WARC-Block-Digest", digest(block))], block))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["page_id", "record"])


def response_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                     date: str = DATE) -> DataFrame:
    """(page_id, record): a response record of every page."""
    columns = [F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`"), F.col(f"`{html_col}`")]
    return pages.select(*columns).mapInArrow(partial(_respond, date=date), "page_id bigint, record binary")


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    task, written = TaskContext.get(), 0
    name = f"part-{task.partitionId():06d}.warc.gz"
    draft = f"{root}/.{name}-{task.taskAttemptId()}"
    with store.open_output_stream(draft, compression=None) as out:
        for batch in batches:
            for row in batch.to_pylist():
                if row["record_type"] == "invalid":
                    continue
                block = row["block"].encode("utf-8", "replace")
                raw = record([("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]),
                              ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]),
                              ("Content-Type", row["content_type"]), ("WARC-Block-Digest", row["block_digest"]),
                              ("WARC-Source-Payload-Digest", row["source_digest"])], block)
                out.write(gzip.compress(raw, 6, mtime=0))
                written += 1
    store.move(draft, f"{root}/{name}")
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([written], pa.int64())], ["name", "records"])


def write_warc(derivatives: DataFrame, folder: str) -> DataFrame:
    """Write derivative records to one file per task, each record a gzip member; (name, records)."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return materialize(derivatives.select(*_NAMES).mapInArrow(partial(_write, folder=folder), "name string, records bigint"))


def iterate_warc(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a file of gzip members, one at a time; ``stream`` gives the file's bytes."""
    unzip, held = zlib.decompressobj(31), []
    for chunk in stream:
        while chunk:
            held.append(unzip.decompress(chunk))
            chunk = unzip.unused_data
            if unzip.eof:
                yield b"".join(held)
                unzip, held = zlib.decompressobj(31), []


def read_warc(spark: SparkSession, folder: str, chunk: int = 1 << 20, files_per_task: int = 1) -> DataFrame:
    """(name, record) of all records in a folder of files whose records are gzip members.

    Files are dealt to an explicit number of tasks, ``files_per_task`` each (as many files as the
    writing had tasks); an explicit count is not merged into one task by adaptive coalescing.
    """
    store, root = fs.FileSystem.from_uri(folder)
    names = [(i.base_name,) for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".warc.gz") and i.base_name[0] != "."]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                    for raw in iterate_warc(iter(lambda: file.read(chunk), b"")):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([raw], pa.binary())], ["name", "record"])

    tasks = max(1, -(-len(names) // files_per_task))
    return spark.createDataFrame(names, "name string").repartition(tasks, "name").mapInArrow(read, "name string, record binary")
