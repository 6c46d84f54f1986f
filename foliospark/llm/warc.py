"""A WARC writer with dictionary compression.

Pages become response records, records become files of about ``FILE_BYTES``, each within one partition of the input, so nothing
is shuffled. For each file a Zstandard dictionary is built from its own records; it leads the file in a skippable
frame (magic 0x184D2A5D), and each record follows as a frame of its own, so that any record can be read by the
dictionary, its offset and its length. A file is written under another name and renamed when whole: a task that is run
again puts the same bytes in the same place.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.runtime import materialise, shared_folder

MAGIC = 0x184D2A5D
#: Of records, before compression; a file ends with the record that reaches it.
FILE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: Dictionaries are fitted on evenly spread records of a file, of so many bytes in all.
DICTIONARY_SAMPLE = 6 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """A WARC/1.1 response record. The same page gives the same bytes: the record's id is made of page_id, url and content."""
    body = (html or "").encode()
    payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    content = sha(body)
    name = uuid.uuid5(_NAMESPACE, f"{page_id}\n{url}\n{content}")
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if target:
        head.append(f"WARC-Target-URI: {target}")
    head += [f"WARC-Payload-Digest: sha1:{content}", f"WARC-Block-Digest: sha1:{sha(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = DICTIONARY_SAMPLE) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of records spread evenly over all; None where they are too few or too short to build one from."""
    total = sum(map(len, records))
    if len(records) < 8 or total < 16 * 1024:
        return None
    step = max(1.0, total / sample)
    some = [records[int(k)] for k in np.arange(0, len(records), step)]
    try:
        return zstandard.train_dictionary(min(size, total // 8), some, k=256, d=8, f=18, steps=1, accel=4, level=LEVEL)
    except zstandard.ZstdError:
        return None


def compress(records: list[bytes], level: int = LEVEL) -> tuple[bytes, list[bytes]]:
    """(leading frame, a frame for each record). Without a dictionary the leading frame is empty."""
    known = build_dictionary(records)
    if known is None:
        one = zstandard.ZstdCompressor(level=level, write_checksum=True)
        return b"", [one.compress(r) for r in records]
    raw = zstandard.ZstdCompressor(level=level).compress(known.as_bytes())
    known.precompute_compress(level=level)
    one = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
    return struct.pack("<II", MAGIC, len(raw)) + raw, [one.compress(r) for r in records]


def read_warc(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each record of a file."""
    at, known = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + n]
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw)
        at = 8 + n
    one = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(data):
        part = one.decompressobj()
        out = part.decompress(memoryview(data)[at:])
        yield at, out
        at = len(data) - len(part.unused_data)


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as ``*.warc.zst`` files into folder; (page_id, url, file, offset, length, record_bytes, payload_digest) of each record.

    folder is a URI that all executors reach, by default a new one in the cluster's shared folder. Files are written when this is called.
    Null urls give records without a target, null and empty pages records of an empty body. Rows that repeat are written each. An empty
    table writes nothing and gives an empty result; other columns are ignored. Pages of any length are written whole. A file of fewer than 8 records, or of less
    than 16 KB of them, is too little to build a dictionary from: its records are compressed without one, and it has no leading frame.
    """
    spark = pages.sparkSession
    target = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        if "://" in target or target.startswith("file:"):
            store, base = fs.FileSystem.from_uri(target)
        else:
            store, base = fs.LocalFileSystem(), os.path.abspath(target)
        part, number = TaskContext.get().partitionId(), 0
        attempt = TaskContext.get().taskAttemptId()
        ids: list = []
        urls: list = []
        records: list[bytes] = []
        held = 0

        def flush():
            nonlocal number, held
            name = f"part-{part:06d}-{number:04d}.warc.zst"
            lead, frames = compress(records)
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}.{attempt}.tmp", compression=None) as out:
                out.write(lead)
                for f in frames:
                    out.write(f)
            store.move(f"{base}/{name}.{attempt}.tmp", f"{base}/{name}")
            lengths = np.array([len(f) for f in frames], np.int64)
            offsets = len(lead) + np.cumsum(lengths) - lengths
            digests = [r[r.index(b"WARC-Payload-Digest: ") + 21 :].split(b"\r\n", 1)[0].decode() for r in records]
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array([name] * len(ids)), pa.array(offsets), pa.array(lengths), pa.array([len(r) for r in records], pa.int64()), pa.array(digests)],
                ["page_id", "url", "file", "offset", "length", "record_bytes", "payload_digest"],
            )
            for x in (ids, urls, records):
                x.clear()
            held, number = 0, number + 1
            return out

        for batch in batches:
            for i, u, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                r = record(i, u, h, date)
                ids.append(i)
                urls.append(u)
                records.append(r)
                held += len(r)
                if held >= file_bytes:
                    yield flush()
        if records:
            yield flush()

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return materialise(rows.mapInArrow(run, "page_id long, url string, file string, offset long, length long, record_bytes long, payload_digest string"), "warc-index")
