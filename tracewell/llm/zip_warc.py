"""WARC records in ZIP packages: a writer, and a reader that takes single records out of stored members by range."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import stored, whole_text
from tracewell.operators.checkpoints import work_dir

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 64 << 20
#: Bytes of records that a task reads back: at most, and at least where every core has work.
FETCH_BYTES, LEAST_FETCH_BYTES = 128 << 20, 4 << 20
EPOCH = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the ZIP format: signatures and sizes of its records.
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_END_SIZE, _LOCATOR_SIZE, _END64_SIZE, _ENTRY_SIZE, _LOCAL_SIZE, _COMMENT = 22, 20, 56, 46, 30, 0xFFFF
_RECORDS = "id string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string"


@dataclass
class Member:
    """An entry of a central directory."""

    name: str
    stored: bool
    size: int
    header: int


def digest(payload: bytes) -> str:
    """SHA-1 in base 32, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def members(read, size: int) -> list[Member]:
    """All entries of a ZIP package; ``read(offset, n)`` gives bytes. Only the tail and the directories are read."""
    tail_at = max(0, size - _END_SIZE - _COMMENT - _LOCATOR_SIZE)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(_END)
    while end >= 0 and end + _END_SIZE + int.from_bytes(tail[end + 20:end + 22], "little") != len(tail):
        end = tail.rfind(_END, 0, end)  # the signature inside a comment
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = tail[max(0, end - _LOCATOR_SIZE):end]
    if locator[:4] == _LOCATOR:
        at = struct.unpack_from("<Q", locator, 8)[0]
        wide = read(at, _END64_SIZE)
        if wide[:4] != _END64:
            raise ValueError("the ZIP64 locator points to no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    directory, at, found = read(start, length), 0, []
    for _ in range(count):
        if directory[at:at + 4] != _ENTRY:
            raise ValueError("the central directory is damaged")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, whole, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + _ENTRY_SIZE:at + _ENTRY_SIZE + name_size]
        extra = directory[at + _ENTRY_SIZE + name_size:at + _ENTRY_SIZE + name_size + extra_size]
        while len(extra) >= 4:  # ZIP64 fields stand only for those that are all ones, in this order
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                whole = next(values) if whole == 0xFFFFFFFF else whole
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            extra = extra[4 + n:]
        found.append(Member(name.decode("utf-8", "replace"), method == 0, packed, header))
        at += _ENTRY_SIZE + name_size + extra_size + comment_size
    return found


def data_start(read, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if not member.stored:
        raise ValueError(f"{member.name} is compressed: its records cannot be read by range")
    local = read(member.header, _LOCAL_SIZE)
    if local[:4] != _LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.header + _LOCAL_SIZE + sum(struct.unpack_from("<HH", local, 26))


def make_record(page_id: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """A WARC 1.1 record, compressed by itself. A revisit has the HTTP header of its payload, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {EPOCH}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(packed: bytes) -> tuple:
    """The columns of ``_RECORDS``; a payload that does not have its digest fails."""
    data = gzip.decompress(packed)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    told, response = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
    if response and (len(payload) != size or digest(payload) != told):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")

    def name(field: str) -> str | None:
        return fields[field].removeprefix("<urn:page:").removesuffix(">") if field in fields else None

    return (name("WARC-Record-ID") or None, fields["WARC-Type"], fields["WARC-Target-URI"], payload if response else None, size, told,
            name("WARC-Refers-To"))


def write_archives(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one WARC record per row into ZIP packages in the shared folder; gives their manifest (path, size, records).

    Of rows with equal payloads of ``least_bytes`` or more, the smallest id
    is a response and the others revisit it; rows that repeat this id, and
    all rows of a group without ids, are responses. A NULL payload is an
    empty one, a NULL id an empty name. A task writes packages of about
    ``ARCHIVE_BYTES``; each attempt has file names of its own, and only the
    packages of finished tasks are in the manifest. An empty table gives none.
    """
    payload = whole_text(html).cast("binary")
    rows = pages.select(F.col(page_id).alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    large = F.octet_length("payload") >= least_bytes
    # small payloads are never compared: keys of their own spread them over the tasks of the join
    small = F.concat(F.lit("small "), F.xxhash64("id", "url").cast("string"))
    keyed = rows.withColumn("same", F.when(large, F.sha2("payload", 256)).otherwise(small))
    groups = keyed.where(large).groupBy("same").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stored(groups.where("n > 1 AND first IS NOT NULL").select("same", "first"))
    # the groups grow with the input: never broadcast, the same plan at every size
    judged = keyed.join(firsts.hint("merge"), "same", "left").select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "url", "payload",
        F.when(~F.coalesce(F.col("id") == F.col("first"), F.lit(False)), F.col("first")).cast("string").alias("refers_to"))
    folder = work_dir(pages.sparkSession)
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        package = None

        def close() -> pd.DataFrame:
            member.close()
            package.writestr(INDEX, "\n".join(index))
            package.close()
            out.close()
            return pd.DataFrame({"path": [f"{folder}/{name}"], "size": [files.get_file_info(f"{root}/{name}").size], "records": [len(index)]})

        for batch in batches:
            for row_id, target, payload, refers_to in zip(batch["id"], batch["url"], batch["payload"], batch["refers_to"]):
                if package is None:
                    name, index, at = f"{uuid.uuid4().hex}.wacz", [], 0
                    out = files.open_output_stream(f"{root}/{name}")
                    package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    member = package.open(ARCHIVE, "w", force_zip64=True)
                target = "".join(target.split("\n")).replace("\r", "")
                record = make_record(row_id, target, payload, refers_to)
                index.append(f"{json.dumps(target)} {json.dumps({'offset': at, 'length': len(record)})}")
                at += member.write(record)
                if at >= ARCHIVE_BYTES:
                    yield close()
                    package = None
        if package is not None:
            yield close()

    return stored(judged.mapInPandas(write, "path string, size long, records long"))


def _reader(path: str):
    files, name = fs.FileSystem.from_uri(path)
    opened = files.open_input_file(name)

    def read(offset: int, n: int) -> bytes:
        opened.seek(offset)
        return opened.read(n)

    return read, opened


def record_ranges(archives: DataFrame) -> DataFrame:
    """Rows (path, offset, length): every record of every package, by its directory and its index."""
    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                read, opened = _reader(path)
                with opened:
                    by_name = {m.name: m for m in members(read, opened.size())}
                    if ARCHIVE not in by_name or INDEX not in by_name:
                        raise ValueError(f"{path}: no {ARCHIVE} with {INDEX}")
                    base, index = data_start(read, by_name[ARCHIVE]), by_name[INDEX]
                    lines = read(data_start(read, index), index.size).decode().split("\n")
                entries = [json.loads(line[line.rindex(" {") + 1:]) for line in lines if line]
                for at in range(0, len(entries), 50_000):
                    some = entries[at:at + 50_000]
                    yield pd.DataFrame({"path": path, "offset": [base + e["offset"] for e in some], "length": [e["length"] for e in some]})

    return archives.select("path").mapInPandas(locate, "path string, offset long, length long")


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of the packages in ``archives`` (column path): id, record_type, url, payload, payload_bytes, payload_digest, refers_to.

    The records of a package are divided among tasks by place, so that a large
    package is no single task's work; each is read by its range alone, and a
    response is checked against its digest. Revisits have no payload.
    """
    ranges = stored(record_ranges(archives))
    # by the bytes to fetch, not by those of the ranges, which would leave the records of many packages to one task
    stated = ranges.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    share = min(FETCH_BYTES, max(LEAST_FETCH_BYTES, stated // cores))
    placed = ranges.repartitionByRange(stated // share + 1, "path", "offset").sortWithinPartitions("path", "offset")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, opened = None, None
        for batch in batches:
            for start in range(0, len(batch), 500):
                out = []
                for name, offset, length in batch.iloc[start:start + 500].itertuples(index=False):
                    if name != path:
                        if opened is not None:
                            opened.close()
                        path, (read, opened) = name, _reader(name)
                    out.append(parse_record(read(offset, length)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _RECORDS.split(", ")])
        if opened is not None:
            opened.close()

    return placed.select("path", "offset", "length").mapInPandas(fetch, _RECORDS)
