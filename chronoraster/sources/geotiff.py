"""GeoTIFF sink: images in degrees as deflated 16-bit TIFF files, written by the tasks without GDAL.

Rows are sorted by image and row, so a task holds one strip of an image and the
compressed strips before it.  Pixels without a row are nodata.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIP = 64  # rows
# TIFF field types and tags, codes of compression, keys of geographic coordinates.
SHORT, LONG, ASCII, DOUBLE = 3, 4, 2, 12
COMPRESSION = {"NONE": 1, "DEFLATE": 8}
GEO_KEYS = (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)


def encode(strips: list[bytes], width: int, height: int, box: tuple[float, ...], nodata: int, compression: str = "DEFLATE", metadata: dict[str, str] | None = None) -> bytes:
    """A little-endian TIFF of signed 16-bit samples from its (compressed) strips."""
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    pad = at % 2
    scale = ((box[2] - box[0]) / width, (box[1] - box[3]) / height, 0.0)
    fields = [
        (256, LONG, (width,)), (257, LONG, (height,)), (258, SHORT, (16,)), (259, SHORT, (COMPRESSION[compression],)), (262, SHORT, (1,)), (273, LONG, tuple(offsets)), (277, SHORT, (1,)), (278, LONG, (STRIP,)),
        (279, LONG, tuple(map(len, strips))), (339, SHORT, (2,)), (33550, DOUBLE, scale), (33922, DOUBLE, (0.0, 0.0, 0.0, box[0], box[1], 0.0)), (34735, SHORT, GEO_KEYS),
    ]
    if metadata:
        items = "".join(f"<Item name={quoteattr(k)}>{escape(v)}</Item>" for k, v in metadata.items())
        fields.append((42112, ASCII, f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0"))
    fields.append((42113, ASCII, str(nodata).encode() + b"\0"))
    head, ifd_at = struct.pack("<2sHI", b"II", 42, at + pad), at + pad
    tail_at = ifd_at + 2 + 12 * len(fields) + 4
    entries, tail = b"", b""
    for tag, kind, values in fields:
        raw = values if kind == ASCII else struct.pack(f"<{len(values)}{ {SHORT: 'H', LONG: 'I', DOUBLE: 'd'}[kind] }", *values)
        where = raw.ljust(4, b"\0")
        if len(raw) > 4:
            where = struct.pack("<I", tail_at + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", tag, kind, len(values)) + where
    out = head + b"".join(strips) + b"\0" * pad + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + tail
    if len(out) >= 1 << 32:
        raise ValueError("the image is too large for a TIFF; cut the area or use another format")
    return out


def write_geotiff(rasters: DataFrame, folder: str, box: tuple[float, float, float, float], width: int, height: int, nodata: int, compression: str = "DEFLATE", metadata: dict[str, str] | None = None, overwrite: bool = False) -> list[str]:
    """Write (image, trow, tcol, value) as ``folder``/image.tif each; paths of the files written.

    Values are rounded half even to whole numbers.  Images that exist are kept
    unless ``overwrite``.  A file is moved into place when complete, so a
    repeated task writes it again.  ``folder`` is one that all executors share.
    """
    if compression not in COMPRESSION:
        raise ValueError(f"compression is one of {', '.join(COMPRESSION)}")
    root = folder.rstrip("/")
    rows = rasters.where("value is not null").select(F.regexp_replace("image", r"[/\\]", "_").alias("image"), F.col("trow").cast("int").alias("r"), F.col("tcol").cast("int").alias("c"), F.rint(F.col("value").cast("double")).cast("int").alias("v"))
    rows = rows.where((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        filesystem, inner = pafs.FileSystem.from_uri(root) if ":" in root else (pafs.LocalFileSystem(), root)
        filesystem.create_dir(inner, recursive=True)
        pack = zlib.compress if compression == "DEFLATE" else bytes
        blank = {n: pack(np.full((n, width), nodata, "<i2").tobytes()) for n in {min(STRIP, height - y) for y in range(0, height, STRIP)}}
        size = lambda k: min(STRIP, height - k * STRIP)
        image, strips, now, open_ = None, [], -1, None

        def close_strip():
            nonlocal open_
            if open_ is not None:
                strips.append(pack(open_.tobytes()))
                open_ = None

        def finish():
            close_strip()
            while len(strips) * STRIP < height:
                strips.append(blank[size(len(strips))])
            path = f"{inner}/{image}.tif"
            if not overwrite and filesystem.get_file_info(path).type != pafs.FileType.NotFound:
                return None
            with filesystem.open_output_stream(path + ".part") as f:
                f.write(encode(strips, width, height, box, nodata, compression, metadata))
            filesystem.move(path + ".part", path)
            return f"{root}/{image}.tif"

        for b in batches:
            names, r, c, v = b.column("image").to_pylist(), *(b.column(k).to_numpy() for k in "rcv")
            strip = r // STRIP
            cut = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or strip[i] != strip[i - 1]), len(names)]
            for a, z in zip(cut, cut[1:]):
                if a == z:
                    continue
                if names[a] != image:
                    if image is not None and (done := finish()):
                        yield pa.RecordBatch.from_pydict({"path": [done]})
                    image, strips, now = names[a], [], -1
                if strip[a] != now:
                    close_strip()
                    now = int(strip[a])
                    while len(strips) < now:
                        strips.append(blank[size(len(strips))])
                    open_ = np.full((size(now), width), nodata, "<i2")
                open_[r[a:z] - now * STRIP, c[a:z]] = v[a:z]
        if image is not None and (done := finish()):
            yield pa.RecordBatch.from_pydict({"path": [done]})

    spread = rows.repartition("image").sortWithinPartitions("image", "r")
    return sorted(r.path for r in spread.mapInArrow(run, "path string").collect())  # one per image
