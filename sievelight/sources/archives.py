"""ZIP archives as a data source: the central directory is read on the driver, members by spans in tasks.

Members that lie close together are read in one piece: a span ends where a gap is wider than ``max_gap`` or the span would
exceed ``max_span``. Only stored and deflated members are read, and their checksums are verified.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievelight.sources.files import opened, write
from sievelight.sources.readers import _exists

MAX_GAP, MAX_SPAN = 1 << 20, 16 << 20
#: Signatures and sizes of the ZIP format's records.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 46, 30


@dataclass(frozen=True)
class Entry:
    name: str
    method: int
    compressed: int
    size: int
    offset: int
    crc: int

    def end(self) -> int:
        """Where the member ends at the latest: its local header may hold more than the directory tells."""
        return self.offset + LOCAL_SIZE + len(self.name.encode()) + 1024 + self.compressed


def _size(path: str) -> int:
    with opened(path) as f:
        f.seek(0, 2)
        return f.tell()


INDEX = "name string, method int, compressed bigint, size bigint, offset bigint, crc bigint"


def indexed(spark: SparkSession, path: str, kept: str, read: Callable[[str], list[Entry]] | None = None) -> DataFrame:
    """An archive's directory as a table, kept under the archive's place and size; a directory that is kept already is not read again."""
    key = hashlib.sha256(f"{path}|{_size(path)}".encode()).hexdigest()
    where = f"{kept}/{key}"
    if not _exists(spark, f"{where}/_SUCCESS"):
        rows = [(e.name, e.method, e.compressed, e.size, e.offset, e.crc) for e in (read or directory)(path)]
        spark.createDataFrame(rows, INDEX).write.mode("overwrite").parquet(where)
    return spark.read.schema(INDEX).parquet(where)


def directory(path: str) -> list[Entry]:
    """All members, in the order of the central directory; 64-bit extensions are understood."""
    with opened(path) as f:
        f.seek(0, 2)
        size = f.tell()
        tail_at = max(0, size - END_SIZE - 65535)
        f.seek(tail_at)
        tail = f.read()
        at = tail.rfind(END)
        if at < 0:
            raise ValueError(f"{path} is no ZIP archive")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        locator = tail.rfind(LOCATOR64, 0, at)
        if 0xFFFFFFFF in (length, start) or count == 0xFFFF:
            if locator < 0:
                raise ValueError(f"{path} lacks its 64-bit directory")
            f.seek(struct.unpack("<Q", tail[locator + 8 : locator + 16])[0])
            record = f.read(56)
            if record[:4] != END64:
                raise ValueError(f"{path} has a damaged 64-bit directory")
            length, start = struct.unpack("<QQ", record[40:56])
        f.seek(start)
        data = f.read(length)
    out, at = [], 0
    while at + CENTRAL_SIZE <= len(data) and data[at : at + 4] == CENTRAL:
        _, _, _, method, _, _, crc, compressed, full, n, extra, comment, _, _, _, offset = struct.unpack("<HHHHHHIIIHHHHHII", data[at + 4 : at + CENTRAL_SIZE])
        name = data[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n].decode("utf-8", "replace")
        more = data[at + CENTRAL_SIZE + n : at + CENTRAL_SIZE + n + extra]
        full, compressed, offset = _wide(more, full, compressed, offset)
        out.append(Entry(name, method, compressed, full, offset, crc))
        at += CENTRAL_SIZE + n + extra + comment
    return out


def _wide(extra: bytes, *values: int) -> list[int]:
    """Values of 32 bits, replaced by those of the 64-bit extra field where they say so."""
    found, at = list(values), 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            wide = [struct.unpack("<Q", extra[at + 4 + 8 * k : at + 12 + 8 * k])[0] for k in range(n // 8)]
            for k, v in enumerate(found):
                if v == 0xFFFFFFFF and wide:
                    found[k] = wide.pop(0)
        at += 4 + n
    return found


def spans(entries: Sequence[Entry], max_gap: int = MAX_GAP, max_span: int = MAX_SPAN) -> list[list[Entry]]:
    out: list[list[Entry]] = []
    start = reached = 0
    for e in sorted(entries, key=lambda e: e.offset):
        if out and e.offset - reached <= max_gap and e.end() - start <= max_span:
            out[-1].append(e)
            reached = max(reached, e.end())
        else:
            out.append([e])
            start, reached = e.offset, e.end()
    return out


def content(data: bytes, at: int, e: Entry) -> bytes:
    """A member's bytes from a piece of the archive in which its header begins at ``at``."""
    if data[at : at + 4] != LOCAL:
        raise ValueError(f"no local header at {e.name}")
    n, extra = struct.unpack("<HH", data[at + 26 : at + 30])
    raw = data[at + LOCAL_SIZE + n + extra : at + LOCAL_SIZE + n + extra + e.compressed]
    if e.method not in (0, 8):
        raise ValueError(f"{e.name} is compressed by method {e.method}")
    out = raw if e.method == 0 else zlib.decompress(raw, -15)
    if zlib.crc32(out) != e.crc:
        raise ValueError(f"{e.name} has another checksum")
    return out


class Span(InputPartition):
    def __init__(self, entries: list[Entry]) -> None:
        self.entries = entries


class ZipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.prefix = options.get("prefix", "")
        self.gap, self.span = int(options.get("max_gap", MAX_GAP)), int(options.get("max_span", MAX_SPAN))

    def partitions(self) -> list[Span]:
        wanted = [e for e in directory(self.path) if not e.name.endswith("/") and e.name.startswith(self.prefix)]
        return [Span(s) for s in spans(wanted, self.gap, self.span)]

    def read(self, partition: Span) -> Iterator[tuple]:
        start = partition.entries[0].offset
        with opened(self.path) as f:
            f.seek(start)
            data = f.read(max(e.end() for e in partition.entries) - start)
        for e in partition.entries:
            try:
                yield e.name, e.size, e.crc, content(data, e.offset - start, e), None
            except (ValueError, zlib.error) as bad:  # a damaged member is a row with an error
                yield e.name, e.size, e.crc, None, str(bad)


class ZipSource(DataSource):
    """spark.dataSource.register(ZipSource); spark.read.format("zip_members").load(path). The file lies where all executors see it."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "name string, size bigint, crc bigint, content binary, error string"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def gap_groups(members: DataFrame, key: str, start: str, end: str, max_gap: int) -> DataFrame:
    """``members`` with ``island``: a new one begins where more than max_gap lies between a member and all before it."""
    w = Window.partitionBy(key).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flag = F.when(reached.isNull() | (F.col(start) - reached > max_gap), 1).otherwise(0)
    return members.withColumn("_f", flag).withColumn("island", F.sum("_f").over(w)).drop("_f")


def span_groups(members: DataFrame, key: str, start: str, end: str, max_gap: int, max_span: int) -> DataFrame:
    """(key, island, span, first, last, members): islands cut where a span would exceed max_span, a fold along each island."""
    islands = gap_groups(members, key, start, end, max_gap)
    kind = dict(members.dtypes)[key]

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "e"])
        out, at, first, last, n = [], 0, None, None, 0
        for s, e in zip(pdf["s"], pdf["e"]):
            if first is not None and e - first > max_span:
                out.append((at, first, last, n))
                at, first, last, n = at + 1, None, None, 0
            first = s if first is None else first
            last = e if last is None else max(last, e)
            n += 1
        out.append((at, first, last, n))
        return pd.DataFrame([(pdf["k"].iloc[0], pdf["island"].iloc[0], *o) for o in out], columns=["key", "island", "span", "first", "last", "members"])

    narrow = islands.select(F.col(key).alias("k"), F.col("island").cast("bigint").alias("island"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
    return narrow.groupBy("k", "island").applyInPandas(cut, f"key {kind}, island bigint, span bigint, first bigint, last bigint, members bigint")


__all__ = ["Entry", "ZipSource", "content", "directory", "gap_groups", "span_groups", "spans", "write"]
