"""Python data source ``granule``: pixels of a granule's subdataset, one input partition per row block.

Needs GDAL to open granules; where it is not installed, reading raises.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronoraster.functions.constants import SUBDATASETS, VNP_RANGE


class Block(InputPartition):
    def __init__(self, path: str, first_row: int, rows: int):
        self.path, self.first_row, self.rows = path, first_row, rows


class GranuleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.name = SUBDATASETS[options.get("code", "VIM")]
        self.block = int(options.get("blockrows", "120"))
        self.force = options.get("force", "false") == "true"

    def _open(self, path: str):
        try:
            from osgeo import gdal
        except ImportError as e:
            raise RuntimeError("GDAL is not installed; collect from Parquet instead") from e
        whole = gdal.Open(path)
        found = [s for s, _ in (whole.GetSubDatasets() if whole else []) if self.name in s]
        return gdal.Open(found[0]) if found else None

    def partitions(self):
        out = []
        for p in self.paths:
            ds = self._open(p)
            if ds is None:
                if self.force:
                    continue
                raise OSError(f"unreadable granule {p}")
            out += [Block(p, r, min(self.block, ds.RasterYSize - r)) for r in range(0, ds.RasterYSize, self.block)]
        return out

    def read(self, part: Block):
        ds = self._open(part.path)
        nodata = ds.GetRasterBand(1).GetNoDataValue()
        values = ds.ReadAsArray(0, part.first_row, ds.RasterXSize, part.rows)
        vnp = part.path.rsplit("/", 1)[-1].startswith("VNP")
        for i, line in enumerate(values):
            for j, v in enumerate(line.tolist()):
                gone = v == nodata or vnp and not VNP_RANGE[0] <= v <= VNP_RANGE[1]
                yield part.path, (part.first_row + i) * ds.RasterXSize + j, None if gone else int(v)


def reference_metadata(path: str, code: str = "VIM") -> dict:
    """Size, affine transform, projection, resolution and code for missing data of a granule's subdataset."""
    ds = GranuleReader({"path": path, "code": code})._open(path)
    if ds is None:
        raise OSError(f"unreadable granule {path}")
    gt = ds.GetGeoTransform()
    return {"rows": ds.RasterYSize, "cols": ds.RasterXSize, "geotransform": list(gt), "projection": ds.GetProjection(), "resolution": [gt[1], gt[5]], "nodata": ds.GetRasterBand(1).GetNoDataValue()}


class GranuleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "granule"

    def schema(self) -> str:
        return "path string, pixel_id bigint, value smallint"

    def reader(self, schema) -> GranuleReader:
        return GranuleReader(self.options)
