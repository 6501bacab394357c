"""WARC archives with a two-level capture index.

``write`` stores one record per page in gzip members, many records to a file. Of pages with equal payloads the
one with the least page_id is a response; the others are revisit records that point to it and keep
its HTTP headers. ``build_index`` sorts the captures by reversed-host URL key into compressed blocks and keeps
a sparse directory with each block's first key and page_id. ``locate`` finds captures by binary search for key and page_id over
the parts and their directories, and reads only the blocks that hold the pair; ``read`` reads the records' ranges.

Files lie in the folder that driver and executors share, through pyarrow's file systems (local or any
scheme it knows). Null html is an empty payload; null url is an empty key. Equal payloads of equal page_id
(repeated rows) are all responses. Empty tables give empty archives. A page_id of null never becomes the
response unless no page of the payload has an id: then all of them are responses. Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
CAPTURE = "url_key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed: ``com,example,blog)/path?query``; scheme, user, port and fragment are dropped."""
    rest = (url or "").strip().split("#", 1)[0]
    if "://" in rest:
        rest = rest.split("://", 1)[1]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:]
    name, _, port = host.partition(":")
    host = name if not port or port.isdigit() else host
    path = path if path.startswith("/") else "/" + path
    return quote(",".join(reversed(host.strip(".").split("."))) + ")" + path, safe="/?&=,;:@!$'()*+~%-._")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, not compressed; a revisit keeps the HTTP headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers and payload of one record; payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    of = lambda name: fields[name][len("<urn:page:") : -1]
    return {
        "page_id": int(of("WARC-Record-ID")) if of("WARC-Record-ID") else None,
        "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": size,
        "refers_to": int(of("WARC-Refers-To")) if "WARC-Refers-To" in fields else None,
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _opened(path: str):
    """The file system of a path and the path on it; paths without a scheme are local."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _create(path: str):
    store, name = _opened(_uri(path))
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(name, compression=None)


@lru_cache(maxsize=64)
def _reader(path: str):
    store, name = _opened(_uri(path))
    return store.open_input_file(name)


def _range(path: str, offset: int, length: int) -> bytes:
    return _reader(path).read_at(length, offset)


# --- writing -------------------------------------------------------------------------------------


def write(pages: DataFrame, folder: str, most: int = 512 << 20) -> DataFrame:
    """Write the archives below ``folder``; payloads are equal where their SHA-256 is (the records carry SHA-1). Returns the captures (url_key, page_id, file, offset, length)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("sha"))
    light = materialize(rows.select("page_id", "sha"), "payload-digests")
    first = materialize(light.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("sha", "first"), "first-payloads")
    revisits = light.join(first, "sha").where("NOT page_id <=> first").select(F.coalesce("page_id", F.lit(-1 << 63)).alias("id"), "sha", "first").distinct()
    revisits = materialize(revisits, "revisits")
    marked = rows.withColumn("id", F.coalesce("page_id", F.lit(-1 << 63))).join(revisits, ["id", "sha"], "left").select("page_id", "url", "html", "first")

    def run(batches):
        out, path, offset = None, "", 0
        for batch in batches:
            got = []
            for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or offset > most:
                    if out is not None:
                        out.close()
                    path, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = _create(path)
                data = _gzip(record(page_id, url, text.encode("utf-8", "replace"), refers_to))
                out.write(data)
                got.append((url_key(url), page_id, path, offset, len(data)))
                offset += len(data)
            columns = list(zip(*got)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["url_key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return materialize(marked.mapInArrow(run, CAPTURE), "captures")


# --- the index -----------------------------------------------------------------------------------


def build_index(captures: DataFrame, folder: str, block: int = 1000) -> DataFrame:
    """Sorted compressed blocks and their directories; returns the parts (first_key, first_page, last_key, last_page, blocks, directory), one for each file."""
    spread = captures.repartitionByRange("url_key", "page_id", "file", "offset").sortWithinPartitions("url_key", "page_id", "file", "offset")

    names = ["first_key", "first_page", "last_key", "last_page", "blocks", "directory"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        lines: list[str] = []
        entries: list[list] = []
        out, path, offset, last = None, "", 0, ["", None]

        def pair(line):
            key, _, rest = line.partition(" ")
            return [key, json.loads(rest)[0]]

        def flush():
            nonlocal out, path, offset, last
            if out is None:
                path = f"{folder}/{uuid.uuid4().hex}"
                out = _create(path + ".cdx.z")
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            entries.append([*pair(lines[0]), offset, len(data)])
            offset, last = offset + len(data), pair(lines[-1])
            lines.clear()

        for batch in batches:
            for key, page_id, file, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append(f"{key} " + json.dumps([page_id, file, at, length]))
                if len(lines) >= block:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with _create(path + ".dir") as directory:
                directory.write(json.dumps(entries).encode())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*entries[0][:2], *last, path + ".cdx.z", path + ".dir"], kinds)], names=names)

    return materialize(spread.mapInArrow(run, "first_key string, first_page long, last_key string, last_page long, blocks string, directory string"), "index-parts")


def _place(key: str, page_id: int | None) -> tuple:
    """Where a capture stands in the index's order: by key, then page_id, null first."""
    return key, page_id is not None, page_id or 0


class Index:
    """Binary search over the parts, then over a part's directory, then one range read for each block."""

    def __init__(self, parts: list[tuple]):
        self.parts = sorted((_place(a, i), _place(b, j), blocks, directory) for a, i, b, j, blocks, directory in parts)
        self.lasts = [p[1] for p in self.parts]
        self.directory = lru_cache(maxsize=8)(self._directory)
        self.block = lru_cache(maxsize=4)(self._block)

    def _directory(self, path: str) -> tuple[list[tuple], list[list]]:
        entries = json.loads(_reader(path).read_at(_reader(path).size(), 0))
        return [_place(*e[:2]) for e in entries], [e[2:] for e in entries]

    def _block(self, path: str, offset: int, length: int) -> list[tuple[tuple, list]]:
        lines = zlib.decompress(_range(path, offset, length)).decode().split("\n")
        split = ((key, json.loads(rest)) for key, _, rest in (x.partition(" ") for x in lines))
        return [(_place(key, capture[0]), capture) for key, capture in split]

    def find(self, key: str, page_id: int | None):
        """The captures of a key and page_id, one after the other, as [page_id, file, offset, length]."""
        place = _place(key, page_id)
        for first, _, blocks, directory in self.parts[bisect.bisect_left(self.lasts, place) :]:
            if first > place:
                break
            firsts, entries = self.directory(directory)
            for at in range(max(0, bisect.bisect_left(firsts, place) - 1), len(entries)):
                if firsts[at] > place:
                    break
                lines = self.block(blocks, *entries[at])
                for i in range(bisect.bisect_left(lines, place, key=lambda x: x[0]), len(lines)):
                    if lines[i][0] != place:
                        break
                    yield lines[i][1]


def locate(wanted: DataFrame, parts: DataFrame) -> DataFrame:
    """The captures of each distinct (url, page_id) of ``wanted``.

    The parts' first and last pairs go to every task: a row for each index file, that is for each
    task that wrote one, and so bounded by the number of partitions. Rows wanted are sorted by key, so that a task
    reads each block about once.
    """
    known = [tuple(r) for r in parts.collect()]

    def keys(batches):
        for batch in batches:
            urls = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in urls], pa.string()), batch.column(1)], names=["url_key", "page_id"])

    rows = wanted.select(F.col("url").cast("string"), F.col("page_id").cast("long")).mapInArrow(keys, "url_key string, page_id long").distinct()
    rows = rows.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")

    def run(batches):
        index = Index(known)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=["url_key", "page_id", "file", "offset", "length"])

        for batch in batches:
            out = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for capture in index.find(key, page_id):
                    out.append((key, *capture))
                    if len(out) >= 10000:
                        yield packed(out)
                        out = []
            yield packed(out)

    return rows.mapInArrow(run, CAPTURE)


def read(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read the captures' records: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload, if asked).

    Captures are dealt out by stretches of 4 MB of a file and read in file order. A response whose bytes
    don't match its digest raises.
    """
    # the rows are few bytes but stand for much reading: the number of tasks follows the records' bytes
    total = captures.agg(F.sum("length")).first()[0] or 0
    tasks = max(captures.sparkSession.sparkContext.defaultParallelism, total // (64 << 20))
    spread = captures.select("file", "offset", "length").repartition(tasks, "file", F.expr("offset div 4194304")).sortWithinPartitions("file", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if with_payload else {})

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                got = []
                for file, offset, length in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    r = parse(zlib.decompress(_range(file, offset, length), 31))
                    if r["payload"] is not None:
                        if len(r["payload"]) != r["payload_bytes"] or digest32(r["payload"]) != r["payload_digest"]:
                            raise ValueError(f"damaged record at {offset} of {file}")
                    got.append(r)
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in got], k) for n, k in kinds.items()], names=list(kinds))

    return spread.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, index them, look every page up and read it back."""
    folder = fresh_path(pages.sparkSession, "warc")
    captures = write(pages, folder)
    parts = build_index(captures, folder)
    return read(materialize(locate(pages, parts), "located"))
