"""Consolidating Parquet files by copying their encoded column chunks (problem 5).

Row groups of files with one schema are appended to larger files byte for byte;
only the footers are read and written again, with offsets moved.  Nothing is
decoded.  Footers are Thrift compact structs, which are parsed here into plain
(field id, type, value) trees, so that fields unknown to this code are kept.

What is checked: files of one output have equal schema trees, every chunk lies
inside its file, row-group counts and row totals of the output equal the sums of
its inputs, and the written footer parses back to what was meant.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoraster.functions.session import cut

MAGIC = b"PAR1"
TARGET_BYTES = 256 << 20

# Thrift compact protocol type codes.
STOP, TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(13)

# Field ids of the footer's structs that are changed or read.
FILE_SCHEMA, FILE_ROWS, FILE_GROUPS, FILE_KEYVALUES = 2, 3, 4, 5
GROUP_COLUMNS, GROUP_ROWS, GROUP_OFFSET, GROUP_COMPRESSED, GROUP_ORDINAL = 1, 3, 5, 6, 7
CHUNK_FILE_OFFSET, CHUNK_META, CHUNK_OFFSET_INDEX, CHUNK_COLUMN_INDEX = 2, 3, 4, 6
META_COMPRESSED, META_DATA_PAGE, META_INDEX_PAGE, META_DICT_PAGE, META_BLOOM = 7, 9, 10, 11, 14


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return n >> 1 ^ -(n & 1)

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind: int):
        if kind in (TRUE, FALSE):
            return kind == TRUE
        if kind == BYTE:
            return self.take(1)
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == DOUBLE:
            return self.take(8)
        if kind == BINARY:
            return self.take(self.varint())
        if kind in (LIST, SET):
            head = self.data[self.at]
            self.at += 1
            size, item = head >> 4, head & 15
            if size == 15:
                size = self.varint()
            if item in (TRUE, FALSE):
                return item, [self.take(1) for _ in range(size)]
            return item, [self.value(item) for _ in range(size)]
        if kind == MAP:
            size = self.varint()
            if not size:
                return 0, 0, []
            kinds = self.take(1)[0]
            return kinds >> 4, kinds & 15, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(size)]
        return self.struct()

    def struct(self) -> dict[int, tuple]:
        out, fid = {}, 0
        while True:
            head = self.data[self.at]
            self.at += 1
            if head == STOP:
                return out
            kind = head & 15
            fid = fid + (head >> 4) if head >> 4 else self.zigzag()
            out[fid] = (kind, self.value(kind))


class _Writer:
    def __init__(self):
        self.out = bytearray()

    def varint(self, n: int) -> None:
        while n >= 0x80:
            self.out.append(n & 0x7F | 0x80)
            n >>= 7
        self.out.append(n)

    def zigzag(self, n: int) -> None:
        self.varint((n << 1) ^ (n >> 63))

    def value(self, kind: int, v) -> None:
        if kind in (TRUE, FALSE):
            return
        if kind in (BYTE, DOUBLE):
            self.out += v
        elif kind in (I16, I32, I64):
            self.zigzag(v)
        elif kind == BINARY:
            self.varint(len(v))
            self.out += v
        elif kind in (LIST, SET):
            item, items = v
            self.out.append(min(len(items), 15) << 4 | item)
            if len(items) >= 15:
                self.varint(len(items))
            for x in items:
                if item in (TRUE, FALSE):
                    self.out += x
                else:
                    self.value(item, x)
        elif kind == MAP:
            a, b, items = v
            self.varint(len(items))
            if items:
                self.out.append(a << 4 | b)
                for x, y in items:
                    self.value(a, x)
                    self.value(b, y)
        else:
            self.struct(v)

    def struct(self, fields: dict[int, tuple]) -> None:
        last = 0
        for fid in sorted(fields):
            kind, v = fields[fid]
            if kind in (TRUE, FALSE):
                kind = TRUE if v else FALSE
            if 0 < fid - last <= 15:
                self.out.append(fid - last << 4 | kind)
            else:
                self.out.append(kind)
                self.zigzag(fid)
            last = fid
            self.value(kind, v)
        self.out.append(STOP)


def parse_footer(raw: bytes) -> dict[int, tuple]:
    return _Reader(raw).struct()


def write_footer(footer: dict[int, tuple]) -> bytes:
    w = _Writer()
    w.struct(footer)
    return bytes(w.out)


def _open(path: str):
    filesystem, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return filesystem, inner


def _footer(f, name: str) -> tuple[dict[int, tuple], int]:
    size = f.size()
    if size < 12:
        raise ValueError(f"{name} is no Parquet file")
    f.seek(size - 8)
    tail = f.read(8)
    if tail[4:] != MAGIC:
        raise ValueError(f"{name} is no Parquet file")
    n = struct.unpack("<I", tail[:4])[0]
    f.seek(size - 8 - n)
    return parse_footer(f.read(n)), size


def read_footer(path: str) -> tuple[dict[int, tuple], int]:
    """(footer, size of the file)."""
    filesystem, inner = _open(path)
    with filesystem.open_input_file(inner) as f:
        return _footer(f, path)


def schema_key(footer: dict[int, tuple]) -> bytes:
    """Bytes that are equal for equal schemas."""
    return write_footer({FILE_SCHEMA: footer[FILE_SCHEMA]})


def _span(chunk: dict[int, tuple]) -> tuple[int, int]:
    meta = chunk[CHUNK_META][1]
    starts = [meta[k][1] for k in (META_DATA_PAGE, META_INDEX_PAGE, META_DICT_PAGE) if k in meta and meta[k][1] > 0]
    return min(starts), meta[META_COMPRESSED][1]


def _moved(chunk: dict[int, tuple], by: int) -> dict[int, tuple]:
    meta = dict(chunk[CHUNK_META][1])
    for k in (META_DATA_PAGE, META_INDEX_PAGE, META_DICT_PAGE):
        if k in meta and meta[k][1] > 0:
            meta[k] = (meta[k][0], meta[k][1] + by)
    # page indexes and Bloom filters stay behind; readers do without
    for k in (META_BLOOM, META_BLOOM + 1):
        meta.pop(k, None)
    out = {k: v for k, v in chunk.items() if not CHUNK_OFFSET_INDEX <= k <= CHUNK_COLUMN_INDEX + 1}
    out[CHUNK_META] = (STRUCT, meta)
    if CHUNK_FILE_OFFSET in out:
        out[CHUNK_FILE_OFFSET] = (out[CHUNK_FILE_OFFSET][0], 0)
    return out


class Concatenator:
    """One Parquet file made of the row groups of others, whose column chunks are copied byte for byte.

    ``add`` takes a file's path, or the bytes of one.  The file appears under its
    name with ``close``, after its counts were checked.
    """

    def __init__(self, out: str):
        self.filesystem, self.inner = _open(out)
        self.temp = f"{self.inner}.part-{os.getpid()}"
        self.sink = self.filesystem.open_output_stream(self.temp)
        self.sink.write(MAGIC)
        self.at, self.rows, self.wanted, self.wanted_groups = 4, 0, 0, 0
        self.groups: list[dict[int, tuple]] = []
        self.first: dict[int, tuple] | None = None

    def add(self, source: str | bytes) -> int:
        """Bytes copied."""
        if isinstance(source, bytes):
            name, f = "a block", pa.BufferReader(source)
        else:
            filesystem, where = _open(source)
            name, f = source, filesystem.open_input_file(where)
        with f:
            footer, size = _footer(f, name)
            if self.first is None:
                self.first = footer
            elif schema_key(footer) != schema_key(self.first):
                raise ValueError(f"the schema of {name} differs")
            self.wanted += footer[FILE_ROWS][1]
            begin = self.at
            for group in footer.get(FILE_GROUPS, (LIST, (STRUCT, [])))[1][1]:
                self.wanted_groups += 1
                self._group(f, group, size, name)
        return self.at - begin

    def _group(self, f, group: dict[int, tuple], size: int, name: str) -> None:
        columns, begin = [], self.at
        for chunk in group[GROUP_COLUMNS][1][1]:
            start, length = _span(chunk)
            if start < 4 or start + length > size - 8:
                raise ValueError(f"a column chunk lies outside {name}")
            f.seek(start)
            left = length
            while left:
                part = f.read(min(left, 8 << 20))
                if not part:
                    raise ValueError(f"{name} ends within a column chunk")
                self.sink.write(part)
                left -= len(part)
            columns.append(_moved(chunk, self.at - start))
            self.at += length
        new = dict(group)
        new[GROUP_COLUMNS] = (LIST, (STRUCT, columns))
        if GROUP_OFFSET in new:
            new[GROUP_OFFSET] = (I64, begin)
        new.pop(GROUP_ORDINAL, None)
        self.rows += group[GROUP_ROWS][1]
        self.groups.append(new)

    def close(self) -> tuple[int, int, int]:
        """(row groups, rows, bytes) of the file."""
        if self.first is None:
            raise ValueError("nothing to concatenate")
        if self.rows != self.wanted or len(self.groups) != self.wanted_groups:
            raise ValueError(f"{self.rows} rows copied, {self.wanted} expected")
        footer = dict(self.first)
        footer[FILE_ROWS] = (I64, self.rows)
        footer[FILE_GROUPS] = (LIST, (STRUCT, self.groups))
        raw = write_footer(footer)
        back = parse_footer(raw)
        if back[FILE_ROWS][1] != self.rows or len(back[FILE_GROUPS][1][1]) != len(self.groups):
            raise ValueError("the footer does not read back")
        self.sink.write(raw + struct.pack("<I", len(raw)) + MAGIC)
        self.sink.close()
        self.filesystem.move(self.temp, self.inner)
        return len(self.groups), self.rows, self.at + len(raw) + 8


def concatenate(paths: list[str], out: str) -> tuple[int, int, int]:
    """Write one file with all row groups of ``paths``; (row groups, rows, bytes)."""
    c = Concatenator(out)
    for p in paths:
        c.add(p)
    return c.close()


REPORT = "path string, files bigint, row_groups bigint, rows bigint, bytes bigint, copied bigint, encoded bigint"


def assemble(inputs: DataFrame, out_dir: str, load: Callable[[dict], bytes | None] | None = None) -> DataFrame:
    """Write the outputs of ``inputs`` (out, path, more...), rows of one output in the order they stand in their partition.

    Every output is one task's; it is written from a stream of rows, so its list
    of inputs is never held.  ``load`` may return the bytes of a Parquet file to
    take instead of the file at ``path`` (what had to be encoded again); None
    copies the file.  Returns the report as a DataFrame, computed once.
    """
    root = out_dir.rstrip("/")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, inner = _open(root)
        filesystem.create_dir(inner, recursive=True)
        now, files, copied, encoded, into = None, 0, 0, 0, None

        def done() -> pa.RecordBatch:
            g, n, size = into.close()
            row = (f"{root}/{now}", files, g, n, size, copied, encoded)
            return pa.RecordBatch.from_pydict({k.split()[0]: pa.array([v], pa.string() if i == 0 else pa.int64()) for i, (k, v) in enumerate(zip(REPORT.split(", "), row))})

        for b in batches:
            for r in b.to_pylist():  # a row per input file
                if r["out"] != now:
                    if into is not None:
                        yield done()
                    now, files, copied, encoded, into = r["out"], 0, 0, 0, Concatenator(f"{root}/{r['out']}")
                fresh = load(r) if load else None
                n = into.add(r["path"] if fresh is None else fresh)
                files += 1
                copied, encoded = (copied + n, encoded) if fresh is None else (copied, encoded + n)
        if into is not None:
            yield done()

    return cut(inputs.mapInArrow(copy, REPORT))


def compact_files(spark: SparkSession, paths: list[str] | DataFrame, out_dir: str, target_bytes: int = TARGET_BYTES, one_schema: bool = False) -> DataFrame:
    """(path, files, row_groups, rows, bytes, copied, encoded) of the files written to ``out_dir``.

    ``paths``: a list, or a DataFrame (path).  Footers are read by tasks.  Files
    of a schema, in path order, go into outputs of ``target_bytes``: each range
    of the order sums up its own sizes, and the driver gets one sum per range
    and schema.  Each output is moved into place when complete, so a repeated
    task writes the same file again.  Inputs are never deleted.  ``one_schema``
    raises if the inputs have several.  Files without rows are left out.
    """
    listed = paths if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")
    listed = listed.select("path").distinct()

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in batches:
            found = [(p, *read_footer(p)) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": [p for p, _, _ in found], "size": [s for _, _, s in found], "schema": [sha256(schema_key(f)).hexdigest()[:16] for _, f, _ in found], "rows": [f[FILE_ROWS][1] for _, f, _ in found]})

    info = cut(listed.mapInArrow(footers, "path string, size bigint, schema string, rows bigint"))
    if one_schema and info.select("schema").distinct().count() > 1:
        raise ValueError("the inputs have several schemas")
    ranges = cut(info.where("rows > 0").repartitionByRange("schema", "path").withColumn("range", F.spark_partition_id()))
    sums = sorted(ranges.groupBy("schema", "range").agg(F.sum("size").alias("bytes")).collect(), key=lambda r: (r["schema"], r["range"]))
    starts, total = [], {}
    for r in sums:
        starts.append((r["schema"], r["range"], total.get(r["schema"], 0)))
        total[r["schema"]] = total.get(r["schema"], 0) + r["bytes"]
    starts = F.broadcast(spark.createDataFrame(starts, "schema string, range int, start bigint"))  # one per range and schema
    before = F.coalesce(F.sum("size").over(Window.partitionBy("schema", "range").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.floor((F.col("start") + before) / target_bytes)
    inputs = ranges.join(starts, ["schema", "range"]).select("path", F.concat(F.lit("part-"), F.lpad(number.cast("string"), 5, "0"), F.lit("-"), F.col("schema"), F.lit(".parquet")).alias("out"))
    outputs = max(1, sum(t // target_bytes + 1 for t in total.values()))
    report = assemble(inputs.repartition(outputs, "out").sortWithinPartitions("out", "path"), out_dir)
    wrote, there = (df.agg(F.sum("rows")).first()[0] or 0 for df in (report, info))
    if wrote != there:
        raise ValueError(f"{wrote} rows written, {there} expected")
    return report
