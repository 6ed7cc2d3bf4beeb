"""File scans, CSV, sidecars, search responses, checksums and trace files."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoraster.functions import constants as C


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of the granules below a folder; ValueError if there are none.

    The content column is pruned, so that files are listed and not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"\.(hdf|h5)$"))
    out = files.select("path", "length", F.col("modificationTime").alias("modified"))
    if not out.take(1):
        raise ValueError(f"no granules in {path}")
    return out


def filter_cubes(cubes: DataFrame, product: str | None = None, code: str | None = None, col: str = "cube_id") -> DataFrame:
    """Cubes whose name contains the product and the code, in upper case."""
    for part in (product, code):
        if part:
            cubes = cubes.where(F.contains(F.col(col), F.lit(part.upper())))
    return cubes


def read_csv_series(spark: SparkSession, path: str, index: str | None = None, header_row: int = 0) -> DataFrame:
    """(pos, series, value) of a CSV with one series per column; NaN and empty are null.

    ``header_row`` counts the file's lines from 0; lines before it are left out.
    pos numbers the lines after it from 0, in file order: lines are read as text
    with their place in the file's blocks, and a block's first number is the sum
    of the lines before it (one row per block on the driver).  Quoted line breaks
    are not allowed.
    """
    lines = spark.read.text(path).where("value <> ''").select("value", F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumns({"block": F.shiftright("at", 33), "within": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    count = {r.block: r.n for r in lines.groupBy("block").agg(F.count("*").alias("n")).collect()}
    first, total = {}, 0
    for block in sorted(count):
        first[block], total = total, total + count[block]
    if total <= header_row:
        raise ValueError(f"{path} has no line {header_row}")
    starts = F.broadcast(spark.createDataFrame(list(first.items()), "block bigint, start bigint"))
    numbered = lines.join(starts, "block").select((F.col("start") + F.col("within") - (header_row + 1)).alias("pos"), "value")
    names = next(csv.reader([numbered.where("pos = -1").first()["value"]]))
    places = F.broadcast(spark.createDataFrame([(i, n) for i, n in enumerate(names) if n != index], "i int, series string"))  # one per column
    quoted = F.split("value", r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    cells = F.when(F.contains("value", F.lit('"')), quoted).otherwise(F.split("value", ",", -1))
    long = numbered.where("pos >= 0").select("pos", F.posexplode(cells).alias("i", "cell")).join(places, "i")
    number = F.expr("""try_cast(trim(both '"' from trim(cell)) as double)""")
    return long.select("pos", "series", F.nullif(number, F.lit(float("nan"))).alias("value"))


def write_csv_series(df: DataFrame, path: str, names: list[str], mode: str) -> str:
    """Write (pos, series, value) with one column per series, as one file in a folder named after the mode, which is returned.

    Series in the order of ``names``; ValueError while writing if a position lacks one of them.
    """
    suffix = {"fixed": "_filt0", "vcurve": "_filtoptv", "vcurve_p": "_filtoptvp"}[mode]
    out = path.removesuffix(".csv") + suffix + ".csv"
    head = io.StringIO()
    csv.writer(head, lineterminator="").writerow(["pos", *names])
    places = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(names)), "i int, series string"))  # one per column
    lines = df.select("pos", "series", "value").join(places, "series").groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("o"))
    whole = F.when(F.size("o") != len(names), F.raise_error(F.lit("the series have different lengths"))).otherwise(F.col("o"))
    cells = F.transform(whole, lambda x: F.coalesce(x["value"].cast("string"), F.lit("")))
    lines = lines.select(F.col("pos").cast("bigint").alias("pos"), F.concat(F.col("pos").cast("string"), F.lit(","), F.array_join(cells, ",")).alias("line"))
    top = df.sparkSession.createDataFrame([(-1, head.getvalue())], "pos bigint, line string")
    top.unionByName(lines).repartition(1).sortWithinPartitions("pos").select("line").write.mode("overwrite").text(out)
    return out


def parse_sidecars(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds file_name, file_size, checksum_type and checksum of a granule's XML sidecar."""
    one = lambda tag: F.nullif(F.trim(F.xpath_string(F.col(xml), F.lit(f"//{tag}"))), F.lit(""))
    return df.select("*", one("DistributedFileName").alias("file_name"), one("FileSize").cast("bigint").alias("file_size"), one("ChecksumType").alias("checksum_type"), one("Checksum").alias("checksum"))


def parse_search(response: DataFrame) -> DataFrame:
    """(filename, tile, time_start, time_end, updated, link) of search entries."""
    tile = F.nullif(F.regexp_extract("producer_granule_id", C.TILE_PART, 1), F.lit(""))
    return response.select(
        F.col("producer_granule_id").alias("filename"), tile.alias("tile"), F.to_date(F.substring("time_start", 1, 10)).alias("time_start"),
        F.to_date(F.substring("time_end", 1, 10)).alias("time_end"), "updated", F.element_at("links", 1)["href"].alias("link"),
    )


# Fixed value: the polynomial of the POSIX checksum.
CRC_POLYNOMIAL = 0x04C11DB7


@lru_cache(maxsize=1)
def _crc_table():
    import numpy as np

    c = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        c = np.where(c & np.uint32(1 << 31), c << np.uint32(1) ^ np.uint32(CRC_POLYNOMIAL), c << np.uint32(1))
    return c


@lru_cache(maxsize=64)
def _shift_tables(zeros: int):
    """Four tables of 256: what each byte of a state becomes after so many zero bytes."""
    import numpy as np

    table, out = _crc_table(), np.zeros((4, 256), np.uint32)
    if zeros == 0:
        for k in range(4):
            out[k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        return out
    if zeros == 1:
        for k in range(4):
            c = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
            out[k] = c << np.uint32(8) ^ table[c >> np.uint32(24)]
        return out
    half = _shift_tables(zeros // 2)
    for k in range(4):
        out[k] = _shifted(half, half[k])
    return out if zeros % 2 == 0 else np.stack([_shifted(_shift_tables(1), out[k]) for k in range(4)])


def _shifted(tables, c):
    return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]


def posix_cksum(data: bytes, lanes: int = 4096) -> int:
    """The checksum that the ``cksum`` command prints.

    A long text is cut into ``lanes`` pieces of equal length, whose states are
    advanced together byte by byte and then joined two by two: the state of a
    whole is that of its first half after as many zero bytes as the second one
    has, with the second one's state.
    """
    import numpy as np

    table = _crc_table()
    raw = np.frombuffer(data, np.uint8)
    size = len(raw) // lanes
    c = 0
    if size:
        grid = raw[: size * lanes].reshape(lanes, size)
        state = np.zeros(lanes, np.uint32)
        for k in range(size):
            state = state << np.uint32(8) ^ table[state >> np.uint32(24) ^ grid[:, k]]
        while len(state) > 1:
            state = _shifted(_shift_tables(size), state[::2]) ^ state[1::2]
            size *= 2
        c = int(state[0])
    plain = table.tolist()
    rest, n = raw[len(raw) // lanes * lanes :].tolist(), len(data)
    while n:
        rest.append(n & 0xFF)
        n >>= 8
    for byte in rest:
        c = (c << 8 & 0xFFFFFFFF) ^ plain[c >> 24 ^ byte]
    return c ^ 0xFFFFFFFF


def cksum_column(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """(keep, cksum): the POSIX checksum of a binary or string column, the one that has no JVM function."""
    src = df.select(*keep, F.col(col).cast("binary").alias("__b"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "__b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [None if v is None else posix_cksum(v) for v in b.column("__b").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(sums, pa.int64())], names=[*keep, "cksum"])

    return src.mapInArrow(run, f"{fields}, cksum bigint")


def validate_files(files: DataFrame) -> DataFrame:
    """Adds ``valid`` to (length, content, file_size, checksum_type, checksum): size and checksum agree."""
    kind = F.upper(F.col("checksum_type"))
    plain = F.when(kind == "MD5", F.md5("content") == F.lower("checksum")).when(F.regexp_replace(kind, "-", "") == "SHA256", F.sha2("content", 256) == F.lower("checksum"))
    names = [c for c in files.columns if c not in ("content",)]
    sums = cksum_column(files.withColumn("__plain", plain), "content", [*names, "__plain"])
    agree = F.coalesce(F.when(kind == "CKSUM", F.col("cksum").cast("string") == F.col("checksum")).otherwise(F.col("__plain")), F.lit(False))
    return sums.withColumn("valid", (F.col("length") == F.col("file_size")) & agree).drop("__plain", "cksum")


def trace(files: DataFrame, when: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """(keep, name, sha256, at): what a clean-up would remove; files are never deleted here."""
    return files.select(*(keep or []), F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), (when if when is not None else F.current_timestamp()).alias("at"))
