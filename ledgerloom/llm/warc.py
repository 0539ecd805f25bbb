"""WARC archives as seekable Zstandard bundles, written and read by Spark tasks."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stored, work_dir

# Fixed values of the seekable format: magic numbers of a skippable frame and of the seek table, entry sizes.
SKIPPABLE, SEEKABLE, ENTRY, FOOTER = 0x184D2A5E, 0x8F92EAB1, 8, 9
FRAME = 1 << 20  # bytes of records after which a frame is closed
BUNDLE = 1024  # frames after which a task closes its bundle and opens another
DATE = "1970-01-01T00:00:00Z"  # pages carry no fetch time

INDEX = "page_id long, record_id string, path string, frame int, frame_start long, frame_bytes long, start long, length long"
RECORD = (
    "page_id long, record_id string, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary"
)


def _open(path: str):
    """File system and path of a URI or an absolute path; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_id(page: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{url}|{digest}')}>"


def _headers(url: str | None) -> str:
    return "".join(" " if c in "\r\n" else c for c in url or "urn:none")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC record; a revisit has no block but names the page it repeats, the digest and the length."""
    kind = "response" if refers is None else "revisit"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, url, digest)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_headers(url)}", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    lines += [] if page is None else [f"X-Page-ID: {page}"]
    lines += [] if url is not None else ["X-No-URI: true"]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers}"]
    block = payload if refers is None else b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and the end of the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines)
    start = end + 4
    stop = start + int(head["Content-Length"])
    return head, data[start:stop], stop + 4


class BundleWriter:
    """Independent frames of whole records, closed by a seek table in a skippable frame.

    The file is written under a name of its own and takes its place when it is whole, so a task that is lost or
    run twice leaves nothing that an index names.
    """

    def __init__(self, path: str, level: int = 3):
        import zstandard

        self.path, self.fs, self.target = path, *_open(path)
        self.fs.create_dir(os.path.dirname(self.target), recursive=True)
        self.out = self.fs.open_output_stream(self.target + ".part")
        self.squeeze = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.size, self.start, self.open_rows, self.index = [], 0, 0, [], []

    def add(self, page: int | None, identifier: str, data: bytes) -> None:
        self.open_rows.append((page, identifier, self.size, len(data)))
        self.buffer.append(data)
        self.size += len(data)
        if self.size >= FRAME:
            self.flush()

    def flush(self) -> None:
        if not self.buffer:
            return
        packed = self.squeeze.compress(b"".join(self.buffer))
        self.out.write(packed)
        at = (self.path, len(self.frames), self.start, len(packed))
        self.index += [(page, identifier, *at, start, length) for page, identifier, start, length in self.open_rows]
        self.frames.append((len(packed), self.size))
        self.start += len(packed)
        self.buffer, self.size, self.open_rows = [], 0, []

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.target + ".part", self.target)
        return self.index


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, packed bytes, plain bytes) of each frame, from the footer of an open bundle."""
    size = file.size()
    file.seek(size - FOOTER)
    count, _, magic = struct.unpack("<IBI", file.read(FOOTER))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - FOOTER - ENTRY * count)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read(ENTRY * count)):
        out.append((at, packed, plain))
        at += packed
    return out


def frame(file, start: int, packed: int, plain: int = 0) -> bytes:
    import zstandard

    file.seek(start)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)


def write_archives(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) to bundles in ``folder``; returns their index.

    Of records with equal payloads of at least ``least`` bytes the smallest page_id is a response, the others
    revisit it; shorter payloads are all responses. The smallest id per repeated digest is a minimum that is combined
    before the shuffle and written; pages meet it in a plain join, whose large partitions adaptive execution splits, and
    each task writes the records it gets, a bundle for every ``BUNDLE`` frames. The index (record to frame and offset
    within the frame) is written beside.

    A null html is an empty payload, a null url a record without target. A null page_id is a response unless another
    id has its payload; rows that repeat the smallest id are all responses, with one record id if all is equal.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"),
    )
    named = rows.where(F.octet_length("html") >= least)
    first = named.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("digest", "first"), "first-pages")  # written, so that a hot payload can be split
    both = rows.join(first, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    both = both.select("page_id", "url", "html", "digest", refers.alias("refers"))
    base = f"{folder.rstrip('/')}/bundles"

    def closed(out: BundleWriter) -> pd.DataFrame:
        done = pd.DataFrame(out.close(), columns=[c.split()[0] for c in INDEX.split(", ")])
        return done.astype({"page_id": "Int64"})

    def write(frames):
        out = None
        for part in frames:
            for page, url, text, digest, to in part.itertuples(index=False):
                out = out or BundleWriter(f"{base}/{uuid.uuid4().hex}.warc.zst")
                page, to = (None if pd.isna(x) else int(x) for x in (page, to))
                url = None if url is None or url != url else url
                out.add(page, record_id(page, url, digest), record(page, url, text.encode("utf-8", "replace"), digest, to))
                if len(out.frames) >= BUNDLE:
                    yield closed(out)
                    out = None
        if out:
            yield closed(out)

    both.mapInPandas(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _row(head: dict, block: bytes, wanted: bool) -> tuple:
    number = lambda key: int(head[key]) if key in head else None
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if head["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
        raise ValueError(f"digest of {head['WARC-Record-ID']}")
    url = None if "X-No-URI" in head else head["WARC-Target-URI"]
    size = len(block) if head["WARC-Type"] == "response" else number("X-Payload-Length")
    return (
        number("X-Page-ID"), head["WARC-Record-ID"], url, head["WARC-Type"], size, digest, number("X-Refers-To-Page"),
        block if wanted and head["WARC-Type"] == "response" else None,
    )


def _frame_of(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
    return out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def read_archives(index: DataFrame, payload: bool = False) -> DataFrame:
    """All records of the bundles that the index names, read frame by frame through each bundle's seek table.

    The payload of a response is checked against its digest; it is returned only if asked for, as null for revisits.
    """

    def read(frames):
        for part in frames:
            for path in part["path"]:
                fs, name = _open(path)
                with fs.open_input_file(name) as file:
                    for start, packed, plain in seek_table(file):
                        data, at, rows = frame(file, start, packed, plain), 0, []
                        while at < len(data):
                            head, block, at = parse(data, at)
                            rows.append(_row(head, block, payload))
                        yield _frame_of(rows)

    spark = index.sparkSession
    paths = index.select("path").distinct()
    return paths.repartition(spark.sparkContext.defaultParallelism * 4, "path").mapInPandas(read, RECORD)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the pages in ``wanted`` (page_id), each read from its own frame only."""

    def read(frames):
        for part in frames:
            rows = []
            for (path, start), group in part.groupby(["path", "frame_start"]):
                fs, name = _open(path)
                with fs.open_input_file(name) as file:
                    data = frame(file, int(start), int(group["frame_bytes"].iloc[0]))
                rows += [_row(*parse(data, int(at))[:2], True) for at in group["start"]]
            yield _frame_of(rows)

    hits = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    return hits.select("path", "frame_start", "frame_bytes", "start").mapInPandas(read, RECORD)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to new archives in the shared folder and reads all of them back, without payloads."""
    return read_archives(write_archives(pages, work_dir(pages.sparkSession, "warc")))
