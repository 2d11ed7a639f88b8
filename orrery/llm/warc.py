"""WARC archives: writing, normalising whole-file gzip, and reading by offset (operator 1).

Crawlers often leave a file as one gzip stream, which can't be entered in the
middle. The normaliser inflates such a stream once, in bounded pieces, writes
every record as a gzip member of its own and a sidecar index of offsets beside
the file; records whose payload another record has become revisits on the way.
With the index, any record is read with one seek.

Files go to storage that all executors share, through Arrow's file systems. A
file is written under a name of its own attempt and then renamed, so that a
repeated task leaves a whole file.

Defined results: a null payload is empty; a null page id or URL stays null;
rows that repeat a page id and payload are records of their own, of which one is
the response; of equal page ids either may be; payloads of any length are written
and inflated in bounded pieces, and held whole one at a time while they are read
back; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import Out, discard, encoded, for_arrow, of_keys, remove, scratch, shuffle_partitions, slices, stored

#: A file is closed after so many bytes of payload or so many records.
FILE_BYTES, FILE_RECORDS = 64 << 20, 50_000
REVISIT_LEAST = 1000
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- records ------------------------------------------------------------------
def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def response(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>")]
    headers += [("WARC-Target-URI", x) for x in [url] if x and "\r" not in x and "\n" not in x]
    headers += [("WARC-Page-ID", str(x)) for x in [page_id] if x is not None]
    return record([*headers, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8")], payload)


class Records:
    """Cuts a stream of inflated bytes into records; holds one record at a time."""

    def __init__(self) -> None:
        self.rest = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
        self.rest += data
        at = 0
        while (end := self.rest.find(b"\r\n\r\n", at)) >= 0:
            headers = parse_headers(bytes(self.rest[at:end]))
            size = int(dict(headers)["Content-Length"])
            if len(self.rest) < end + 4 + size + 4:
                break
            yield headers, bytes(self.rest[end + 4:end + 4 + size])
            at = end + 4 + size + 4
        del self.rest[:at]

    def close(self) -> None:
        if self.rest:
            raise ValueError(f"{len(self.rest)} bytes of an incomplete record at the archive's end")


def parse_headers(head: bytes) -> list[tuple[str, str]]:
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record here: {first[:40]!r}")
    return [tuple(x.split(": ", 1)) for x in lines]


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in bounded pieces."""
    unzip = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = unzip.decompress(data, CHUNK)
            if out:
                yield out
            data = unzip.unconsumed_tail
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(31)
    if rest := unzip.flush():
        yield rest


def member(data: bytes, level: int = 6) -> bytes:
    zip_ = zlib.compressobj(level, zlib.DEFLATED, 31)
    return zip_.compress(data) + zip_.flush()


# -- files --------------------------------------------------------------------
MANIFEST = "archive string, ordinal bigint, page_id bigint, payload_bytes bigint, digest binary"
INDEX = "archive string, ordinal bigint, page_id bigint, `offset` bigint, size bigint, record_type string"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Each partition as gzip files of one stream, every row a response record. Returns the manifest: one row for each record."""
    folder = for_arrow(pages.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, held = TaskContext.get().partitionId(), 0, None, (0, 0)
        for b in slices(batches):
            rows = []
            for page_id, url, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoded(b.column(2)), strict=True):
                if out and (held[0] >= FILE_BYTES or held[1] >= FILE_RECORDS):
                    out.write(zip_.flush())
                    out.close()
                    out, held, number = None, (0, 0), number + 1
                if not out:
                    archive = f"{folder}/{part:06d}-{number:04d}.warc.gz"
                    out, zip_ = Out(archive), zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(zip_.compress(response(page_id, url, payload, hashlib.sha1(payload).hexdigest())))
                rows.append((archive, held[1], page_id, len(payload), hashlib.sha256(payload).digest()))
                held = held[0] + len(payload), held[1] + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["archive", "ordinal", "page_id", "payload_bytes", "digest"])
        if out:
            out.write(zip_.flush())
            out.close()

    chosen = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("payload"))
    return stored(chosen.mapInArrow(run, MANIFEST), "warc-manifest")


def references(manifest: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """(archive, ordinal, refers_to) of the records that become revisits.

    Of records with one payload of at least that many bytes, the one with the
    largest page id stays a response. Payloads don't move, and a digest's rows
    are reduced before the shuffle.
    """
    place = F.struct("page_id", "archive", "ordinal")
    large = manifest.filter(F.col("payload_bytes") >= least)
    first = stored(large.groupBy("digest").agg(F.max(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "warc-first")
    shared = of_keys(large, first, "digest", large.count()).filter(~place.eqNullSafe(F.col("first")))
    return shared.select("archive", "ordinal", F.col("first.page_id").alias("refers_to"))


def normalise_archives(manifest: DataFrame, revisits: DataFrame, folder: str) -> DataFrame:
    """Rewrites every archive of the manifest to folder, a member for each record, with a sidecar index. Returns the index."""
    spark = manifest.sparkSession
    folder = for_arrow(spark, folder)
    archives = manifest.groupBy("archive").agg(F.count(F.lit(1)).alias("n"))
    # References of one archive: at most FILE_RECORDS rows.
    own = revisits.groupBy("archive").agg(F.collect_list(F.struct("ordinal", "refers_to")).alias("refs"))
    # By a hash of the name: the join's own partitions are few and would be merged by size, but the work is in the files.
    work = archives.join(own, "archive", "left").repartition(shuffle_partitions(spark), F.xxhash64("archive"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            archive, n, refs = (b.column(i)[0].as_py() for i in range(3))
            refs = {r["ordinal"]: r["refers_to"] for r in refs or ()}
            target = f"{folder}/{archive.rpartition('/')[2]}"
            source, out, rows = Records(), Out(target), []
            fs, path = pafs.FileSystem.from_uri(archive)
            offset = 0
            with fs.open_input_stream(path, compression=None) as stream:
                for data in inflate(stream):
                    for headers, payload in source.feed(data):
                        k, kind = len(rows), "response"
                        if k in refs:
                            kind = "revisit"
                            refers = [("WARC-Refers-To-Page-ID", str(x)) for x in [refs[k]] if x is not None]
                            headers = [("WARC-Type", kind), ("WARC-Profile", PROFILE), *refers, *(h for h in headers if h[0] != "WARC-Type")]
                            payload = b""
                        data_out = member(record([h for h in headers if h[0] != "Content-Length"], payload))
                        out.write(data_out)
                        page = dict(headers).get("WARC-Page-ID")
                        rows.append((target, k, None if page is None else int(page), offset, len(data_out), kind))
                        offset += len(data_out)
            source.close()
            if len(rows) != n:
                raise ValueError(f"{archive}: {len(rows)} records, {n} in the manifest")
            out.close()
            side = Out(f"{target}.index")
            side.write("".join(f"{o} {s} {kind} {'' if p is None else p}\n" for _, _, p, o, s, kind in rows).encode())
            side.close()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["archive", "ordinal", "page_id", "offset", "size", "record_type"])

    return stored(work.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records by the index's offsets, each read and checked by itself.

    payload_bytes and payload_digest are those of the full payload: counted for
    a response, and for a revisit as its headers say.
    """
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream = None, None
        for b in slices(batches):
            rows = []
            for archive, offset, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != path:
                    fs, inner = pafs.FileSystem.from_uri(archive)
                    path, stream = archive, fs.open_input_file(inner)
                stream.seek(offset)
                source = Records()
                (headers, payload), = source.feed(zlib.decompress(stream.read(size), 31))
                source.close()
                h = dict(headers)
                kind, said = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                number = lambda name: int(h[name]) if name in h else None
                if kind == "response":
                    if (digest := hashlib.sha1(payload).hexdigest()) != said:
                        raise ValueError(f"{archive} at {offset}: the payload has not the digest of its header")
                    n = len(payload)
                else:
                    digest, n = said, number("WARC-Payload-Length")
                rows.append((number("WARC-Page-ID"), h.get("WARC-Target-URI"), n, digest, kind, number("WARC-Refers-To-Page-ID") if kind == "revisit" else None, *[payload] * with_payload))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return index.select("archive", "offset", "size").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = REVISIT_LEAST) -> DataFrame:
    """pages written, normalised and read back. folder gets raw/ and normal/; without one the archives are deleted once read."""
    spark = pages.sparkSession
    place = folder or scratch(spark, "warc")
    manifest = write_archives(pages, f"{place}/raw")
    index = normalise_archives(manifest, references(manifest, least), f"{place}/normal")
    if folder:
        return read_records(index)
    remove(spark, f"{place}/raw")
    out = stored(read_records(index), "warc-records")
    remove(spark, place)
    discard(manifest, index)
    return out
