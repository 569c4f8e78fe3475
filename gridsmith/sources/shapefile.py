"""Polygons of shapefiles: the .shp geometry and the .dbf attributes of the same name, after the published ESRI and dBASE layouts."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File code, version and the polygon shape types (plain, with z, with m).
CODE, VERSION, POLYGONS = 9994, 1000, (5, 15, 25)
Ring = Sequence[tuple[float, float]]


def shapes(content: bytes) -> Iterator[list[list[tuple[float, float]]]]:
    """The rings of every record; a null shape has none."""
    if struct.unpack(">i", content[:4])[0] != CODE:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(content):
        size = 2 * struct.unpack(">i", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack("<i", body[:4])[0]
        if kind not in (0, *POLYGONS):
            raise ValueError(f"shape type {kind} is no polygon")
        if kind == 0:
            yield []
            continue
        parts, points = struct.unpack("<2i", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
        xy = list(zip(flat[::2], flat[1::2], strict=True))
        yield [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def records(content: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str]]:
    """The attributes of every record as text, deleted ones too, so that they stay beside their shapes."""
    many, first, size = struct.unpack("<IHH", content[4:12])
    fields = []
    for at in range(32, first - 1, 32):
        if content[at : at + 1] == b"\r":
            break
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii"), content[at + 16]))
    for i in range(many):
        row, at, out = content[first + i * size : first + (i + 1) * size], 1, {}
        for name, width in fields:
            out[name] = row[at : at + width].decode(encoding, "replace").strip()
            at += width
        yield out


def encode(rows: Sequence[tuple[Mapping[str, str], Sequence[Ring]]]) -> tuple[bytes, bytes]:
    """The .shp and .dbf bytes of a few features."""
    body = b""
    for i, (_, rings) in enumerate(rows, 1):
        xy = [p for ring in rings for p in ring]
        starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
        box = [min(p[0] for p in xy), min(p[1] for p in xy), max(p[0] for p in xy), max(p[1] for p in xy)] if xy else [0.0] * 4
        one = struct.pack("<i4d2i", 5, *box, len(rings), len(xy)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in xy)
        one = one if rings else struct.pack("<i", 0)
        body += struct.pack(">2i", i, len(one) // 2) + one
    shp = struct.pack(">7i", CODE, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", VERSION, 5, *[0.0] * 8) + body
    names = list(rows[0][0]) if rows else []
    wide = {n: max(1, *(len(str(a[n]).encode()) for a, _ in rows)) for n in names}
    fields = b"".join(struct.pack("<11sc4xBB14x", n.encode(), b"C", wide[n], 0) for n in names)
    table = b"".join(b" " + b"".join(str(a[n]).encode().ljust(wide[n]) for n in names) for a, _ in rows)
    dbf = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + len(fields), 1 + sum(wide.values())) + fields + b"\r" + table + b"\x1a"
    return shp, dbf


SCHEMA = "name string, attributes map<string,string>, rings array<array<struct<x:double,y:double>>>"


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """name (of the file), attributes and rings of every feature under a path; a task decodes a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").option("recursiveFileLookup", True).load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.(shp|dbf)$", 1)
    kind = F.regexp_extract("path", r"\.(shp|dbf)$", 1)
    one = files.select(F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("place"), stem.alias("name"), kind.alias("kind"), "content")
    shp = one.where("kind = 'shp'").select("place", "name", F.col("content").alias("shp"))
    dbf = one.where("kind = 'dbf'").select("place", F.col("content").alias("dbf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        schema = pa.schema([("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("rings", pa.list_(pa.list_(point)))])
        for batch in batches:
            for name, geometry, table in zip(*(batch.column(c).to_pylist() for c in ("name", "shp", "dbf")), strict=True):
                rings = list(shapes(geometry))
                attributes = list(records(table)) if table is not None else [{}] * len(rings)
                rows = [{"name": name, "attributes": list(a.items()), "rings": [[{"x": x, "y": y} for x, y in ring] for ring in r]} for a, r in zip(attributes, rings, strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return shp.join(dbf, "place", "left").select("name", "shp", "dbf").mapInArrow(run, SCHEMA)
