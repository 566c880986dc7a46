"""Image files: portable pixmaps, PNG, BMP and TGA in and out, orientation tags, and writers of the text forms."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.operators import stencil

LONGEST_SIDE = 16384
_HEADER = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def decode_ppm(raw: bytes) -> np.ndarray | None:
    """An image; None for bytes of another format; ValueError for a broken pixmap."""
    if raw[:2] not in (b"P5", b"P6"):
        return None
    head = _HEADER.match(raw)
    if not head or int(head[4]) != 255 or not int(head[2]) or not int(head[3]):
        raise ValueError("unsupported pixmap header")
    w, h, n = int(head[2]), int(head[3]), 3 if head[1] == b"6" else 1
    body = np.frombuffer(raw, np.uint8, offset=head.end())
    if len(body) < w * h * n:
        raise ValueError("truncated pixmap")
    return np.broadcast_to(body[: w * h * n].reshape(h, w, n), (h, w, 3)).copy()


def encode_ppm(rgb: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (rgb.shape[1], rgb.shape[0]) + rgb.tobytes()


def encode_png(rgb: np.ndarray) -> bytes:
    if not rgb.size:
        raise ValueError("empty image")
    h, w = rgb.shape[:2]
    lines = np.concatenate((np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)), 1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray | None:
    """An 8-bit grey or colour PNG without interlacing; alpha is dropped. None for another format."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, data, head = 8, [], b""
    while at + 8 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or lace or colour not in (0, 2, 4, 6):
        raise ValueError("unsupported PNG")
    c = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    flat = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h + 1, w, c), np.int64)
    for y in range(h):
        kind, line, up = flat[y, 0], flat[y, 1:].reshape(w, c).astype(np.int64), out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = line.cumsum(0) & 255
        elif kind == 2:
            out[y + 1] = (line + up) & 255
        else:
            left, corner = np.zeros(c, np.int64), np.zeros(c, np.int64)
            for x in range(w):
                if kind == 3:
                    guess = (left + up[x]) >> 1
                else:
                    p = left + up[x] - corner
                    a, b, d = abs(p - left), abs(p - up[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, up[x], corner))
                left = (line[x] + guess) & 255
                corner = up[x]
                out[y + 1, x] = left
    got = out[1:].astype(np.uint8)
    return np.repeat(got[..., :1], 3, 2) if c < 3 else got[..., :3].copy()


def encode_bmp(rgb: np.ndarray) -> bytes:
    """24 bits a pixel, uncompressed; lines from the bottom up, filled to four bytes."""
    if not rgb.size:
        raise ValueError("empty image")
    h, w = rgb.shape[:2]
    lines = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    lines[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHI", b"BM", 54 + lines.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, lines.size, 2835, 2835, 0, 0) + lines.tobytes()


def decode_bmp(raw: bytes) -> np.ndarray | None:
    """An uncompressed bitmap of 24 or 32 bits a pixel; alpha is dropped. None for another format."""
    if raw[:2] != b"BM":
        return None
    if len(raw) < 54:
        raise ValueError("truncated bitmap")
    start, size, w, h, _, depth, packing = struct.unpack_from("<10xIIiiHHI", raw)
    if size < 40 or w <= 0 or not h or depth not in (24, 32) or packing:
        raise ValueError("unsupported bitmap")
    n, line = depth // 8, -(-w * depth // 32) * 4
    if len(raw) < start + line * abs(h):
        raise ValueError("truncated bitmap")
    rows = np.frombuffer(raw, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * n].reshape(abs(h), w, n)
    return np.ascontiguousarray((rows[::-1] if h > 0 else rows)[:, :, 2::-1])


def encode_tga(rgb: np.ndarray) -> bytes:
    """24 bits a pixel, uncompressed; lines from the top down."""
    if not rgb.size or max(rgb.shape[:2]) > 65535:
        raise ValueError("size not possible in this format")
    return struct.pack("<BBB5xHHHHBB", 0, 0, 2, 0, 0, rgb.shape[1], rgb.shape[0], 24, 0x20) + rgb[:, :, ::-1].tobytes()


def decode_tga(raw: bytes) -> np.ndarray | None:
    """Uncompressed grey or colour of 8, 24 or 32 bits a pixel; alpha is dropped. The format has no mark of its own: None for an implausible head."""
    if len(raw) < 18:
        return None
    skip, palette, kind, w, h, depth, order = struct.unpack_from("<BBB9xHHBB", raw)
    if palette or (kind, depth) not in ((2, 24), (2, 32), (3, 8)) or not w * h or order & 0xC0:
        return None
    n = depth // 8
    if len(raw) < 18 + skip + w * h * n:
        raise ValueError("truncated TGA")
    rows = np.frombuffer(raw, np.uint8, w * h * n, 18 + skip).reshape(h, w, n)
    rows = rows[:: 1 if order & 0x20 else -1, :: -1 if order & 0x10 else 1]
    return np.repeat(rows, 3, 2) if n == 1 else np.ascontiguousarray(rows[:, :, 2::-1])


def jpeg_orientation(raw: bytes) -> int:
    """The orientation tag of a JPEG's first Exif directory, 1 where there is none or anything is odd."""
    if raw[:2] != b"\xff\xd8":
        return 1
    at = 2
    try:
        while True:
            if raw[at] != 0xFF:
                return 1
            while raw[at] == 0xFF:
                at += 1
            kind = raw[at]
            at += 1
            if kind in (0xD9, 0xDA):
                return 1
            if kind == 0x01 or 0xD0 <= kind <= 0xD7:
                continue
            size = struct.unpack_from(">H", raw, at)[0]
            body = raw[at + 2 : at + size]
            if kind == 0xE1 and body[:6] == b"Exif\0\0":
                tiff = body[6:]
                e = {b"II": "<", b"MM": ">"}[tiff[:2]]
                start = struct.unpack_from(e + "I", tiff, 4)[0]
                for k in range(struct.unpack_from(e + "H", tiff, start)[0]):
                    tag, form, _, value = struct.unpack_from(e + "HHIH", tiff, start + 2 + 12 * k)
                    if tag == 0x0112 and form == 3:
                        return value if 1 <= value <= 8 else 1
                return 1
            at += size
    except (IndexError, KeyError, struct.error):
        return 1


def decode(raw: bytes) -> np.ndarray:
    """An image by its first bytes."""
    for one in (decode_ppm, decode_png, decode_bmp, decode_tga):
        rgb = one(raw)
        if rgb is not None:
            if max(rgb.shape[:2]) > LONGEST_SIDE:
                raise ValueError("image too large")
            return rgb
    raise ValueError("unsupported image format")


def decode_images(files: DataFrame) -> DataFrame:
    """image_id, w, h, data (rows of RGB) of files (image_id, content); the whole image is one row."""

    def run(batches):
        for pdf in batches:
            got = [decode(bytes(x)) for x in pdf.content]
            yield pd.DataFrame({"image_id": pdf.image_id, "w": [g.shape[1] for g in got], "h": [g.shape[0] for g in got], "data": [g.tobytes() for g in got]})

    return files.select("image_id", "content").mapInPandas(run, "image_id long, w long, h long, data binary")


def to_pixels(images: DataFrame) -> DataFrame:
    """image_id, y, x, r, g, b."""

    def run(batches):
        for pdf in batches:
            for i, w, h, data in zip(pdf.image_id, pdf.w, pdf.h, pdf.data, strict=True):
                rgb = np.frombuffer(data, np.uint8).reshape(h, w, 3).astype(np.int64)
                y, x = np.indices((h, w))
                yield pd.DataFrame({"image_id": i, "y": y.ravel(), "x": x.ravel(), "r": rgb[..., 0].ravel(), "g": rgb[..., 1].ravel(), "b": rgb[..., 2].ravel()})

    return images.mapInPandas(run, "image_id long, y long, x long, r long, g long, b long")


def encode_images(pixels: DataFrame, kind: str = "png") -> DataFrame:
    """image_id, content: each image as a file of its own."""
    from meshframe.functions import kernels

    write = WRITERS[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]], "content": [write(kernels.image(pdf))]})

    return pixels.groupBy("image_id").applyInPandas(run, "image_id long, content binary")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, image_id (hash of the path), w, h, data of all PPM, PNG, BMP and TGA files of a folder."""
    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("image_id"), "content")
    return decode_images(files).join(files.select("path", "image_id"), "image_id")


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of JPEG and other files that Spark's image source decodes, turned upright by their tag."""
    # the two sources write local paths with one slash and with three
    number = lambda c: F.xxhash64(F.regexp_replace(c, "^file:/+", "/")).alias("image_id")
    raw = spark.read.format("binaryFile").load(path).select(number("path"), "content")

    @F.pandas_udf("int")
    def tag(content: pd.Series) -> pd.Series:
        return content.map(lambda x: jpeg_orientation(bytes(x[: 1 << 16])))

    image = spark.read.format("image").load(path).select(number("image.origin"), "image.*")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                bgr = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
                rgb = np.repeat(bgr, 3, 2) if row.nChannels == 1 else bgr[..., 2::-1]
                yield pd.DataFrame({"image_id": [row.image_id], "w": [row.width], "h": [row.height], "data": [np.ascontiguousarray(rgb).tobytes()]})

    flat = image.select("image_id", "height", "width", "nChannels", "data").mapInPandas(run, "image_id long, w long, h long, data binary")
    tagged = flat.select("image_id", "w", "h").join(raw.select("image_id", tag("content").alias("exif")), "image_id")
    return stencil.orient(to_pixels(flat).join(tagged, "image_id"), F.col("exif"), F.col("w"), F.col("h"))


def svg_document(paths: list[str], w: int, h: int, W: int, H: int) -> str:
    """A drawing of path elements in half-pixel units."""
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{W}" height="{H}" viewBox="0 0 {2 * w} {2 * h}" preserveAspectRatio="none">'
    group = f'<g fill="currentColor" stroke="currentColor" stroke-width="{2.0 * w / W:.4g}" stroke-linejoin="round">'
    return "\n".join([head, group, *paths, "</g>", "</svg>", ""])


def text_document(shapes: list[str], w: int, h: int) -> str:
    return f"P6\n{w} {h}\n255\n{len(shapes)}\n" + "".join(shapes)


# Sinks ----------------------------------------------------------------------------------------------------------------

WRITERS = {"png": encode_png, "ppm": encode_ppm, "bmp": encode_bmp, "tga": encode_tga}


def kind_of(path: str) -> str:
    """The kind of file that a name asks for; ValueError for one that cannot be written."""
    kind = path.rpartition(".")[2].lower() if "." in path else ""
    if kind not in {*WRITERS, "svg", "txt"}:
        raise ValueError(f"cannot write {path}")
    return kind


def save_images(pixels: DataFrame, path: str) -> list[str]:
    """Writes each image where the driver runs, one at a time; {} in the path stands for its id."""
    kind, out = kind_of(path), []
    for row in encode_images(pixels, kind).toLocalIterator():
        name = path.replace("{}", str(row["image_id"]))
        with open(name, "wb") as f:
            f.write(bytes(row["content"]))
        out.append(name)
    return out


def save_shapes(lines: DataFrame, sizes: DataFrame, path: str, scale: float = 1.0) -> list[str]:
    """Writes the drawings (svg: rows of image_id, poly_id, path) or text forms (txt: shape) of images, in polygon order."""
    kind, out = kind_of(path), []
    column = {"svg": "path", "txt": "shape"}[kind]
    for s in sizes.toLocalIterator():
        w, h = s["w"], s["h"]
        own = [r[0] for r in lines.where(F.col("image_id") == s["image_id"]).orderBy("poly_id").select(column).toLocalIterator()]
        text = svg_document(own, w, h, max(1, round(w * scale)), max(1, round(h * scale))) if kind == "svg" else text_document(own, w, h)
        name = path.replace("{}", str(s["image_id"]))
        with open(name, "w", encoding="utf-8") as f:
            f.write(text)
        out.append(name)
    return out
