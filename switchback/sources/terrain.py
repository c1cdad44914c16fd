"""Terrain tiles: PNG files to metres."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tiles that are named one by one where only some are needed.
MOST_TILES = 20_000
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """Height x width x 4 bytes of an 8-bit PNG without interlacing; ValueError for any other."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        parts[kind] = parts.get(kind, b"") + data[at + 8 : at + 8 + n]
        at += n + 12
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if depth != 8 or interlaced or colour not in CHANNELS:
        raise ValueError("only 8-bit PNGs without interlacing")
    bpp = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, 1 + width * bpp)
    out = np.zeros((height + 1, width * bpp), np.int32)
    for y, row in enumerate(raw):
        line, above = row[1:].astype(np.int32), out[y]
        if row[0] in (0, 2):
            line = line + above * (row[0] == 2)
        elif row[0] == 1:
            line = np.cumsum(line.reshape(-1, bpp), axis=0).ravel()
        elif row[0] in (3, 4):
            line = unfiltered(row[0], line.reshape(-1, bpp), above.reshape(-1, bpp)).ravel()
        else:
            raise ValueError("unknown filter")
        out[y + 1] = line & 255
    px = out[1:].reshape(height, width, bpp).astype(np.uint8)
    full = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        table, clear = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3), np.frombuffer(parts.get(b"tRNS", b""), np.uint8)
        full[..., :3] = table[px[..., 0]]
        full[..., 3] = np.concatenate([clear, np.full(len(table) - len(clear), 255, np.uint8)])[px[..., 0]]
    else:
        full[..., :3] = px[..., :3] if bpp >= 3 else px[..., :1]
        if bpp in (2, 4):
            full[..., 3] = px[..., -1]
    return full


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A line of pixels of the average (3) or Paeth (4) filter, all channels of a pixel at once: each needs its left neighbour."""
    left, corner, out = np.zeros_like(line[0]), np.zeros_like(line[0]), np.empty_like(line)
    for x, (raw, up) in enumerate(zip(line, above)):
        if kind == 3:
            guess = (left + up) >> 1
        else:
            near = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))  # distances of left, above and corner; the first of equals counts
            guess = np.choose(near.argmin(axis=0), (left, up, corner))
        left, corner = (raw + guess) & 255, up
        out[x] = left
    return out


@F.arrow_udf(T.ArrayType(T.FloatType()))
def tile_metres(content: pa.Array) -> pa.Array:
    """The cells of a terrain tile in metres, row by row."""
    out = []
    for x in content:
        rgb = decode_png(x.as_py()).astype(np.float64)
        out.append((rgb[..., 0] * 256 + rgb[..., 1] + rgb[..., 2] / 256 - 32768).astype(np.float32).ravel())
    return pa.array(out, pa.list_(pa.float32()))


def tile_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, z, x, y) of the PNG files named .../z/x/y.png; none is opened."""
    part = lambda k: F.regexp_extract("path", r"(\d+)/(\d+)/(\d+)\.png$", k).cast("int")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    return listed.select("path", part(1).alias("z"), part(2).alias("x"), part(3).alias("y"))


def read_terrain(spark: SparkSession, path: str, needed: DataFrame | None = None) -> DataFrame:
    """(z, x, y, metres) of PNG files named .../z/x/y.png; with needed (x, y; rows may repeat), of those tiles alone.

    Up to MOST_TILES needed files are named one by one, and no other is opened. Beyond that, all are read, and the needed ones decoded: the join comes before the decoder.
    A needed tile without a file has no row.
    """
    files = tile_files(spark, path)
    content = lambda df: df.select("z", "x", "y", tile_metres("content").alias("metres"))
    all_of = lambda *paths: spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(list(paths))
    named = lambda df: df.select("content", *(F.regexp_extract("path", r"(\d+)/(\d+)/(\d+)\.png$", k).cast("int").alias(c) for k, c in enumerate("zxy", 1)))
    if needed is None:
        return content(named(all_of(path)))
    keys = needed.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    paths = [r.path for r in files.join(keys, ["x", "y"], "left_semi").select("path").limit(MOST_TILES + 1).collect()]
    if not paths:
        return content(named(all_of(path)).limit(0))
    if len(paths) <= MOST_TILES:
        return content(named(all_of(*paths)))
    return content(named(all_of(path)).join(keys, ["x", "y"], "left_semi"))


def sea_level(metres: Column) -> Column:
    return F.greatest(metres, F.lit(0.0))
