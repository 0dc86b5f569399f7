"""WARC: reading and writing records, and deriving metadata and plain-text records.

``derive`` turns each response record into two linked records: a metadata record and a
conversion record with the page's plain text. Both name the response in
WARC-Refers-To and keep its target URI, date, payload digest and block digest (those it
declares, else computed ones); each has its own record id (a name-based UUID of response and
kind, so a retried task gives the same one), block digest and length. The metadata
record's block holds the response's own WARC headers (warc-...) and HTTP headers (http-...).

``read`` splits files at record borders, so that a task holds a record at a time and
large uncompressed files are dealt over many tasks; ``responses_of`` makes ``derive``'s input of it.

Responses are processed a row at a time; nothing is grouped or shuffled. Null or
empty payloads give records with empty blocks; a response without HTTP header lines
has an empty header part. Chunked, gzip and deflate payloads are decoded, charsets are
those that the HTTP header, a byte order mark or the page names, else UTF-8. A payload in another
encoding, or one that unpacks to more than ``MOST_BYTES``, gets an empty text, and the
metadata record says so. Repeated rows give repeated records. Payloads of any length are
converted whole, in linear time. Columns beyond those named are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import common

CRLF = b"\r\n"
#: What stands between two records.
MARK = b"\r\n\r\nWARC/1."
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
TAG = re.compile(r"<(?:(/?)([a-zA-Z][\w-]*)|[!?/])")
#: Elements whose content isn't seen; what isn't closed of the first two reaches to the page's end.
TO_END, UNSEEN = ("script", "style"), ("script", "style", "template", "noscript")
#: What may stand in a head besides these and a title; end tags of anything but ``ENDS_HEAD`` may, too.
IN_HEAD, ENDS_HEAD = ("meta", "link", "base", "head"), ("body", "html", "br")
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*UNSEEN, "title")}
BREAKS = frozenset(("p", "div", "nav", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "title", "blockquote", "pre"))
MOST_BYTES = 256 * 1024 * 1024
CHARSET = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
BLANKS = re.compile(r"[ \t\r\f\v ]+")
LINES = re.compile(r" ?\n[ \n]*")


def seen(page: str) -> tuple[str, str | None]:
    """The text of a page as far as it is seen, a line end for each block element's tag, and the title's raw text.

    A head ends where HTML ends it: at its end tag or at the first thing that can't
    stand in it. Script, style and comments that aren't closed reach to the page's end; of
    other elements that aren't closed only the tag goes. One pass: no part is looked at twice,
    but once for each kind of end tag that the page lacks.
    """
    out: list[str] = []
    title, head, at, unclosed = None, False, 0, set()
    while at < len(page):
        lt = page.find("<", at)
        text = page[at:lt] if lt >= 0 else page[at:]
        if not head or text.strip():
            head = False
            out.append(text)
        if lt < 0:
            break
        tag = TAG.match(page, lt)
        if tag is None:
            head, at = False, lt + 1
            out.append("<")
            continue
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            out.append(" ")
            if end < 0:
                break
            at = end + 3
            continue
        end = page.find(">", tag.end())
        if end < 0:
            break
        at = end + 1
        closing, name = tag[1] == "/", (tag[2] or "").lower()
        hidden = not closing and (name in UNSEEN or (head and name == "title"))
        if head:
            if closing and name == "head":
                head = False
                continue
            if hidden or not name or (name not in ENDS_HEAD if closing else name in IN_HEAD):
                if not hidden:
                    continue
            else:
                head = False
        if hidden or (name == "title" and not closing and title is None):
            last = None if name in unclosed else ENDS[name].search(page, at)
            if last is None:
                unclosed.add(name)
            elif name == "title" and title is None:
                title = page[at : last.start()]
            if hidden:
                out.append(" ")
                if last is not None:
                    at = last.end()
                elif name in TO_END:
                    break
                continue
        if name == "head" and not closing:
            head = True
            out.append(" ")
        elif name in BREAKS:
            out.append("\n")
    return "".join(out), title


def plain_text(page: str) -> str:
    """Visible text: one line per block element, blanks collapsed."""
    return _neat(seen(page)[0])


def _neat(text: str) -> str:
    return LINES.sub("\n", BLANKS.sub(" ", html.unescape(text))).strip()


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.1 record; Content-Length is added."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2


def parse_headers(lines: list[str]) -> dict[str, str]:
    """Named fields; folded lines are joined, values of a name that comes again (in any case) are put after a comma."""
    out: dict[str, str] = {}
    names: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif line.strip():
            field, _, value = line.partition(":")
            name = names.setdefault(field.strip().lower(), field.strip())
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def field(headers: dict[str, str], name: str) -> str:
    """The value of a name in any case; empty without one."""
    return next((v for k, v in headers.items() if k.lower() == name.lower()), "")


def length(headers: dict[str, str]) -> int | None:
    """Content-Length; None if it is missing or no number."""
    value = field(headers, "Content-Length")
    return int(value) if value.isascii() and value.isdigit() else None


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in uncompressed WARC bytes.

    A record without a proper length reaches to the next one's start.
    """
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(CRLF * 2, at)
        if end < 0:
            return
        headers = parse_headers(data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        size = length(headers)
        if size is None:
            following = data.find(MARK, end + 4)
            size = (following if following >= 0 else len(data.rstrip(CRLF))) - end - 4
        yield headers, data[end + 4 : end + 4 + max(size, 0)]
        at = end + 4 + max(size, 0)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header bytes and payload of a response block."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, _, body = block.partition(CRLF * 2)
    return head, body


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; what doesn't follow the form stays as it is."""
    out, at = [], 0
    while (end := body.find(CRLF, at)) >= 0:
        size = body[at:end].partition(b";")[0].strip()
        if not size or not all(c in b"0123456789abcdefABCDEF" for c in size) or len(size) > 15:
            return body if not out else b"".join([*out, body[at:]])
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join([*out, body[at:]]) if out else body


def _inflated(body: bytes, bits: int, most: int) -> tuple[bytes, bool]:
    """What the streams of ``body`` hold, at most one byte over ``most``, and whether the last one is whole.

    Gzip streams may follow one another; anything else behind a whole stream is padding.
    """
    out, size = [], 0
    while True:
        held = zlib.decompressobj(bits)
        out.append(held.decompress(body, most - size + 1))
        size += len(out[-1])
        body = held.unused_data
        if size > most or not held.eof or bits != 31 or body[:2] != b"\x1f\x8b":
            return b"".join(out), held.eof


def unpacked(body: bytes, encoding: str, most: int = MOST_BYTES) -> tuple[bytes, str]:
    """The payload behind a Content-Encoding, and what is wrong with it, if anything.

    A payload that was cut short gives what can be read of it, and says ``disconnect``.
    """
    wrong = ""
    for name in reversed([x.strip().lower() for x in encoding.split(",") if x.strip()]):
        if name == "identity":
            continue
        if name not in ("gzip", "x-gzip", "deflate"):
            return b"", "encoding"
        try:
            # Deflate comes with and without its own header.
            raw = name == "deflate" and not (body[:1] and body[0] & 15 == 8 and int.from_bytes(body[:2], "big") % 31 == 0)
            body, whole = _inflated(body, 31 if name != "deflate" else -15 if raw else 15, most)
        except zlib.error:
            return b"", "encoding"
        if len(body) > most:
            return b"", "length"
        wrong = wrong if whole else "disconnect"
    return body, wrong


def decoded(payload: bytes, content_type: str) -> str:
    """Text of a payload in the charset that is named for it; bytes that it doesn't have are replaced."""
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.I)
    bom = next((name for mark, name in BOMS if payload.startswith(mark)), None)
    meta = CHARSET.search(payload[:4096])
    charset = bom or (named and named[1]) or (meta and meta[1].decode()) or "utf-8"
    try:
        return payload.decode(charset, "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


SCHEMA = pa.schema([("page_id", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()), ("payload_digest", pa.string()), ("source_block_digest", pa.string()), ("block_digest", pa.string()), ("content_length", pa.int64()), ("n_chars", pa.int64()), ("block", pa.binary())])
DDL = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, source_block_digest string, block_digest string, content_length long, n_chars long, block binary"


def derivatives(page_id: int | None, record_id: str, uri: str | None, date: str, block: bytes, headers: dict[str, str]) -> Iterator[tuple]:
    head, payload = split_http(block)
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    http = parse_headers(lines)
    of_payload, of_block = field(headers, "WARC-Payload-Digest") or digest(payload), field(headers, "WARC-Block-Digest") or digest(block)
    body = unchunked(payload) if "chunked" in field(http, "Transfer-Encoding").lower() else payload
    body, wrong = unpacked(body, field(http, "Content-Encoding"))
    text, title = seen(decoded(body, field(http, "Content-Type")))
    text = _neat(text)
    fields = [f"payload-length: {len(payload)}", f"text-length: {len(text.encode('utf-8', 'replace'))}", f"title: {' '.join(html.unescape(title or '').split())}"]
    fields += [f"truncated: {wrong}"] if wrong else []
    fields += [f"warc-{k}: {v}" for k, v in headers.items()]
    meta = "\r\n".join([*fields, *[f"http-{line}" for line in lines]]).encode("utf-8", "replace") + CRLF
    for kind, mime, out, n in (("metadata", "application/warc-fields", meta, len(meta.decode())), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"), len(text))):
        yield page_id, kind, f"<urn:uuid:{uuid.uuid5(SPACE, record_id + kind)}>", record_id, uri, date, mime, of_payload, of_block, digest(out), len(out), n, out


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response (page_id, record_id, target_uri, warc_date, block; headers: its WARC headers, if known)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                rows = batch.slice(lo, 200).to_pylist()
                out = [x for r in rows for x in derivatives(r["page_id"], r["record_id"] or "", r["target_uri"], r["warc_date"] or "", r["block"] or b"", dict(r["headers"] or ()))]
                columns = list(zip(*out, strict=True)) or [[]] * len(SCHEMA)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    headers = F.col("headers") if "headers" in responses.columns else F.lit(None).cast("map<string,string>").alias("headers")
    return responses.select("page_id", "record_id", "target_uri", "warc_date", "block", headers).mapInArrow(run, DDL)


def to_warc(records: DataFrame) -> DataFrame:
    """(page_id, warc): the bytes of each derived record with all its headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for r in batch.to_pylist():
                headers = {"WARC-Type": r["warc_type"], "WARC-Record-ID": r["record_id"], "WARC-Refers-To": r["refers_to"], "WARC-Target-URI": r["target_uri"] or "", "WARC-Date": r["warc_date"], "Content-Type": r["content_type"], "WARC-Payload-Digest": r["payload_digest"], "WARC-Block-Digest": r["block_digest"]}
                ids.append(r["page_id"])
                out.append(record(headers, r["block"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["page_id", "warc"])

    return records.mapInArrow(run, "page_id long, warc binary")


#: Number of a row that only says that a block crosses the border of a part.
CROSSED = -1


def read(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Records of uncompressed or gzip-compressed WARC files: (path, split, at, headers map, block).

    split: where the part of the file begins that a task read; at: the record's number in it. Files are split
    between records; a block that itself holds records is put together again by its length. Where such a
    block crosses the border of two parts, that file is read again by itself, in one task and in memory, as all are with ``whole``. So
    the files are read through once before, to find those; nothing of them is kept.
    """
    ddl = "path string, split long, at long, headers map<string,string>, block binary"

    def rows(path: str, split: int, at: int, headers: dict[str, str], block: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([split], pa.int64()), pa.array([at], pa.int64()), pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], names=["path", "split", "at", "headers", "block"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = row["content"]
                if data[:2] == b"\x1f\x8b":
                    plain = []
                    while data[:2] == b"\x1f\x8b":
                        member = zlib.decompressobj(31)
                        plain.append(member.decompress(data))
                        data = member.unused_data
                    data = b"".join(plain)
                for at, (headers, block) in enumerate(parse(data)):
                    yield rows(row["path"], 0, at, headers, block)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at, held = None, 0, b""

        for batch in batches:
            for piece, *here in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if here != place:
                    if held:  # the block goes on in another part
                        yield rows(*place, CROSSED, {}, b"")
                    place, at, held = here, 0, b""
                piece = held + MARK + piece if held else piece
                top, _, block = piece.partition(CRLF * 2)
                headers = parse_headers(top.decode("utf-8", "replace").split("\r\n")[1:])
                if not headers:
                    continue
                size = length(headers)
                # The line ends after the last block may be missing, but nothing of a block.
                if size is not None and size > len(block):
                    held = piece
                    continue
                held = b""
                yield rows(*here, at, headers, block[:size] if size is not None else block.rstrip(CRLF))
                at += 1
        if held:
            yield rows(*place, CROSSED, {}, b"")

    def by_file(of: str | list[str]) -> DataFrame:
        return spark.read.format("binaryFile").load(of).select("path", "content").mapInArrow(files, ddl)

    if whole:
        return by_file(path)
    parts = spark.read.option("lineSep", MARK.decode()).text(path)
    found = parts.select(F.col("value").cast("binary"), "_metadata.file_path", "_metadata.file_block_start").mapInArrow(pieces, ddl)
    crossed = [r.path for r in found.where(F.col("at") == CROSSED).select("path").distinct().collect()]
    if not crossed:
        return found
    return found.where(~F.col("path").isin(crossed)).unionByName(by_file([unquote(p) for p in crossed]))


def responses_of(records: DataFrame) -> DataFrame:
    """The response records of ``read`` as ``derive`` takes them; their page_id is null."""
    named = F.transform_keys("headers", lambda k, _: F.lower(k))
    get = lambda name: F.try_element_at(F.col("named"), F.lit(name))
    held = records.withColumn("named", named).where(F.lower(get("warc-type")) == "response")
    return held.select(F.lit(None).cast("long").alias("page_id"), get("warc-record-id").alias("record_id"), get("warc-target-uri").alias("target_uri"), get("warc-date").alias("warc_date"), "block", "headers")


def responses(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as response records: the block is an HTTP head with the page."""
    page = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n\r\n"))
    id_hex = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url"))
    record_id = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(id_hex, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(366)).cast("int"))
    date = F.concat(day.cast("string"), F.lit("T00:00:00Z"))
    named = {"WARC-Type": F.lit("response"), "WARC-Record-ID": record_id, "WARC-Target-URI": F.coalesce("url", F.lit("")), "WARC-Date": date, "Content-Type": F.lit("application/http; msgtype=response")}
    headers = F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)])
    return pages.select("page_id", record_id.alias("record_id"), F.col("url").alias("target_uri"), date.alias("warc_date"), F.concat(head, page).cast("binary").alias("block"), headers.alias("headers"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    records = derive(responses(common.table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return records.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest", "source_block_digest", "block_digest", "content_length", "n_chars", F.sha2("block", 256).alias("block_sha256"))
