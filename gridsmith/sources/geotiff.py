"""GeoTIFF files without a GIS library: TIFF 6.0 with deflate or no compression, strips or tiles, and the tags that place a grid.

A file is decoded by one task, block by block, so a task holds the file's bytes
and one block of pixels. Encoding makes one file of a group of pixels; large
rasters are written as several files, each with its own transform.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.operators.grid import Grid
from gridsmith.sources.store import Store

#: Tag numbers and field types of the TIFF and GeoTIFF specifications.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass(frozen=True)
class Raster:
    """What a file's header tells, and where its blocks lie."""

    grid: Grid
    bands: int
    dtype: str
    nodata: float | None
    tags: dict
    order: str

    def blocks(self, content: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, first column, pixels by band, row and column) of every block, cut to the raster."""
        t = self.tags
        tiled = TILES in t
        wide, high = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (self.grid.width, min(t.get(STRIP_ROWS, (self.grid.height,))[0], self.grid.height))
        across, down = -(-self.grid.width // wide), -(-self.grid.height // high)
        at, size = (t[TILES], t[TILE_SIZES]) if tiled else (t[STRIPS], t[STRIP_SIZES])
        planes = self.bands if t.get(PLANAR, (1,))[0] == 2 else 1
        deep = 1 if planes > 1 else self.bands
        for k in range(across * down):
            row, col = k // across * high, k % across * wide
            rows = high if tiled else min(high, self.grid.height - row)
            parts = [self._pixels(content[at[k + p * across * down] : at[k + p * across * down] + size[k + p * across * down]], rows, wide, deep) for p in range(planes)]
            whole = np.concatenate(parts, 2).transpose(2, 0, 1)
            yield row, col, whole[:, : self.grid.height - row, : self.grid.width - col]

    def _pixels(self, raw: bytes, rows: int, wide: int, deep: int) -> np.ndarray:
        how, predictor = self.tags.get(COMPRESSION, (1,))[0], self.tags.get(PREDICTOR, (1,))[0]
        if how in (8, 32946):
            raw = zlib.decompress(raw)
        elif how != 1:
            raise ValueError(f"compression {how} is not supported")
        kind = np.dtype(self.dtype)
        if predictor == 3:
            # Floats as byte planes of a row, most significant first, each byte the difference from the one `deep` before.
            table = np.frombuffer(raw, "u1")[: rows * wide * deep * kind.itemsize].reshape(rows, -1, deep)
            plain = np.cumsum(table, 1, dtype="u1").reshape(rows, kind.itemsize, wide * deep)
            return np.ascontiguousarray(plain.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, wide, deep).astype(kind)
        pixels = np.frombuffer(raw, kind.newbyteorder(self.order))[: rows * wide * deep].reshape(rows, wide, deep).astype(kind)
        return np.cumsum(pixels, 1, dtype=kind) if predictor == 2 else pixels


def header(content: bytes) -> Raster:
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", content[4:8])[0]
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        tag, kind, count = struct.unpack(order + "HHI", content[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in TYPES:
            continue
        form = f"{order}{count}{TYPES[kind]}"
        size, place = struct.calcsize(form), at + 10 + 12 * i
        if size > 4:
            place = struct.unpack(order + "I", content[place : place + 4])[0]
        tags[tag] = struct.unpack(form, content[place : place + size])
    bands = tags.get(SAMPLES, (1,))[0]
    dtype = f"{KINDS[tags.get(SAMPLE_FORMAT, (1,))[0]]}{tags[BITS][0] // 8}"
    if TRANSFORM in tags:
        a, b, _, c, d, e, _, f = tags[TRANSFORM][:8]
    elif PIXEL_SCALE in tags:
        (sx, sy, _), (i, j, _, x, y, _) = tags[PIXEL_SCALE][:3], tags[TIE_POINT][:6]
        a, b, c, d, e, f = sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
    else:
        a, b, c, d, e, f = 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
    keys = tags.get(GEO_KEYS, ())
    known = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = known.get(PROJECTED) or known.get(GEOGRAPHIC)
    nodata = tags.get(NODATA)
    return Raster(Grid(tags[HEIGHT][0], tags[WIDTH][0], a, b, c, d, e, f, f"EPSG:{code}" if code else ""), bands, dtype, float(nodata[0].rstrip(b"\0 ")) if nodata else None, tags, order)


def encode(pixels: np.ndarray, grid: Grid, nodata: float | None = None, block: int = 256) -> bytes:
    """A tiled, deflated GeoTIFF of pixels by band, row and column."""
    bands, height, width = pixels.shape
    kind = pixels.dtype.newbyteorder("<")
    blocks = []
    for r in range(0, height, block):
        for c in range(0, width, block):
            tile = np.zeros((block, block, bands), kind)
            part = pixels[:, r : r + block, c : c + block].transpose(1, 2, 0)
            tile[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(tile.tobytes(), 6))
    code = int(grid.crs.rsplit(":", 1)[-1]) if grid.crs else 0
    projected = not 4000 <= code < 5000
    keys = (1, 1, 0, 3, MODEL_TYPE, 0, 1, 1 if projected else 2, RASTER_TYPE, 0, 1, 1, PROJECTED if projected else GEOGRAPHIC, 0, 1, code)
    sample = {"u": 1, "i": 2, "f": 3}[kind.kind]
    fields: list[tuple[int, int, Sequence]] = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [kind.itemsize * 8] * bands), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [bands]), (PLANAR, 3, [1]), (PREDICTOR, 3, [1]),
        (TILE_WIDTH, 4, [block]), (TILE_HEIGHT, 4, [block]), (TILES, 4, [0] * len(blocks)), (TILE_SIZES, 4, [len(x) for x in blocks]), (SAMPLE_FORMAT, 3, [sample] * bands),
        (TRANSFORM, 12, [grid.a, grid.b, 0, grid.c, grid.d, grid.e, 0, grid.f, 0, 0, 0, 0, 0, 0, 0, 1]),
    ]
    if code:
        fields.append((GEO_KEYS, 3, keys))
    if nodata is not None:
        fields.append((NODATA, 2, f"{nodata}".encode() + b"\0"))
    packed = lambda t, v: bytes(v) if t == 2 else struct.pack(f"<{len(v)}{TYPES[t]}", *v)
    extra_at = 8 + 2 + 12 * len(fields) + 4
    sizes = [len(packed(t, v)) for _, t, v in fields]
    first = extra_at + sum(s + s % 2 for s in sizes if s > 4)
    starts = np.cumsum([first, *[len(x) for x in blocks[:-1]]]).tolist()
    fields = [(tag, t, starts if tag == TILES else v) for tag, t, v in fields]
    entries, extra = b"", b""
    for tag, t, v in sorted(fields, key=lambda x: x[0]):
        raw = packed(t, v)
        if len(raw) <= 4:
            place = raw.ljust(4, b"\0")
        else:
            place = struct.pack("<I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", tag, t, len(v)) + place
    return b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra + b"".join(blocks)


META = "raster_id string, crs string, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>, height int, width int, dtype string, nodata double, bands int"


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", True).load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.tif$", "")
    return files.select(name.alias("raster_id"), "content")


def read_geotiff_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its grid, system, type, value for no data and number of bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = header(content)
                g = r.grid
                rows.append({"raster_id": name, "crs": g.crs, "transform": {k: float(getattr(g, k)) for k in "abcdef"}, "height": g.height, "width": g.width, "dtype": str(np.dtype(r.dtype)), "nodata": r.nodata, "bands": r.bands})
            kinds = [("raster_id", pa.string()), ("crs", pa.string()), ("transform", pa.struct([(k, pa.float64()) for k in "abcdef"])), ("height", pa.int32()), ("width", pa.int32()), ("dtype", pa.string()), ("nodata", pa.float64()), ("bands", pa.int32())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return _files(spark, path).mapInArrow(run, META)


def read_geotiff(spark: SparkSession, path: str, bands: Sequence[str], window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """raster_id, row, col and the bands as doubles, by the names given; no data becomes NaN. A window (row, col, height, width) leaves blocks outside it undecoded."""
    names = list(bands)
    top, left, high, wide = window or (0, 0, 2**31 - 1, 2**31 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raster = header(content)
                if raster.bands != len(names):
                    raise ValueError(f"{name} has {raster.bands} bands, not {len(names)}")
                for row, col, block in raster.blocks(content):
                    r, c = (x.ravel() for x in np.indices(block.shape[1:]))
                    r, c = r + row, c + col
                    keep = (r >= top) & (r < top + high) & (c >= left) & (c < left + wide)
                    if not keep.any():
                        continue
                    values = block.reshape(len(names), -1).astype(float)[:, keep]
                    if raster.nodata is not None:
                        values[values == raster.nodata] = np.nan
                    ids = pa.array([name]).take(pa.array(np.zeros(int(keep.sum()), np.int32)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(r[keep].astype(np.int32)), pa.array(c[keep].astype(np.int32)), *map(pa.array, values)], ["raster_id", "row", "col", *names])

    return _files(spark, path).mapInArrow(run, "raster_id string, row int, col int, " + ", ".join(f"{n} double" for n in names))


def encoded(pixels: DataFrame, name: str, grid: Grid, bands: Sequence[str], size: int, dtype: str = "float32", nodata: float | None = None) -> DataFrame:
    """raster_id and content: a GeoTIFF for every square of `size` pixels of a raster (row, col, bands), with the square's own transform. Missing pixels are `nodata`, or 0."""
    names = list(bands)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        tr, tc = key[0].as_py(), key[1].as_py()
        r0, c0 = tr * size, tc * size
        high, wide = min(size, grid.height - r0), min(size, grid.width - c0)
        out = np.full((len(names), high, wide), 0 if nodata is None else nodata, dtype)
        r, c = group.column("row").to_numpy() - r0, group.column("col").to_numpy() - c0
        for k, band in enumerate(names):
            values = group.column(band).to_numpy().astype(float)
            out[k, r, c] = np.where(np.isnan(values), out.dtype.type(0 if nodata is None else nodata), values)
        part = Grid(high, wide, grid.a, grid.b, grid.c + c0 * grid.a + r0 * grid.b, grid.d, grid.e, grid.f + c0 * grid.d + r0 * grid.e, grid.crs)
        return pa.table({"raster_id": [f"{name}_r{tr:04d}_c{tc:04d}"], "content": pa.array([encode(out, part, nodata)], pa.binary())})

    inside = pixels.where((F.col("row") < grid.height) & (F.col("col") < grid.width))
    keyed = inside.select(F.expr(f"row div {size}").cast("int").alias("tile_r"), F.expr(f"col div {size}").cast("int").alias("tile_c"), "row", "col", *names)
    return keyed.groupBy("tile_r", "tile_c").applyInArrow(run, "raster_id string, content binary")


def write_geotiff(store: Store, folder: str, files: DataFrame) -> str:
    """Puts encoded files through any file system that Spark knows, one at a time."""
    path = f"{store.root}/{folder}"
    for r in files.toLocalIterator():
        store.put(f"{path}/{r['raster_id']}.tif", bytes(r["content"]))
    return path
