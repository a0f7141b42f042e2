"""Payloads as PNG images: zlib chunks with checksums, numpy unfiltering, cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(payload: bytes, width: int = WIDTH) -> bytes:
    return payload + b"\0" * (-len(payload) % width if payload else width)


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit grey image of ``width`` columns; each row has the filter (0 to 2) of least absolute sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    tried = np.stack([rows, left, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(2)
    best = cost.argmin(0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tried[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Undoes the five filters; runs of rows with filter 0, 1 or 2 go at once."""
    kinds, data = lines[:, 0], lines[:, 1:]
    out = np.zeros(data.shape, np.uint8)
    n, width = data.shape
    ends = np.flatnonzero(np.append(kinds[1:] != kinds[:-1], True)) + 1
    start = 0
    for end in ends.tolist():
        kind, part = int(kinds[start]), data[start:end]
        if kind == 0:
            out[start:end] = part
        elif kind == 1:
            by = part.reshape(len(part), width // step, step)
            out[start:end] = np.cumsum(by, axis=1, dtype=np.uint8).reshape(len(part), width)
        elif kind == 2:
            out[start:end] = np.cumsum(part, axis=0, dtype=np.uint8)
            if start:
                out[start:end] += out[start - 1]
        elif kind in (3, 4):
            for y in range(start, end):
                above = out[y - 1].astype(int) if y else np.zeros(width, int)
                row = out[y]
                for x in range(width):
                    a = int(row[x - step]) if x >= step else 0
                    b, c = int(above[x]), int(above[x - step]) if x >= step else 0
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        near = (abs(b - c), abs(a - c), abs(a + b - 2 * c))
                        guess = (a, b, c)[near.index(min(near))]
                    row[x] = (int(data[y, x]) + guess) & 255
        else:
            raise ValueError(f"filter {kind}")
        start = end
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The samples, after testing the signature, each chunk's checksum and the sizes."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(media) and not ended:
        n, kind = struct.unpack_from(">I4s", media, at)
        part = media[at + 8 : at + 8 + n]
        if len(part) != n or zlib.crc32(kind + part) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("unsupported PNG")
    step = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    return unfilter(raw.reshape(head[1], head[0] * step + 1), step)


_K = np.arange(32)
_COS = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:8, None] / 64)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: signs of the 8 x 8 lowest frequencies about their median, of the image at 32 x 32."""
    height, width = image.shape
    rows = np.arange(33) * height // 32
    if height >= 32:
        sums = np.add.reduceat(image, rows[:-1], axis=0, dtype=np.int64).astype(float) / np.diff(rows)[:, None]
    else:
        sums = image[np.arange(32) * height // 32].astype(float)
    small = sums.reshape(32, 32, width // 32).mean(2) if width % 32 == 0 else sums[:, np.arange(32) * width // 32]
    low = _COS @ small @ _COS.T
    flat = low.ravel()
    return np.packbits(flat > np.median(flat[1:])).tobytes()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):  # bounds what is held at once
            part = b.slice(at, 256)
            texts = [t or b"" for t in part.column(1).to_pylist()]
            media = pa.array([encode_png(pad(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), media], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for d, n, media in zip(*(c.to_pylist() for c in b.columns), strict=True):
            image = decode_png(media)
            payload = image.tobytes()
            rows.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image).hex()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and a binary column ``media``: the text's bytes as a PNG.

    The UTF-8 bytes are padded with 0 to a positive multiple of 64, so an empty or null text is
    one row of zeros. Equal texts give equal images, and repeated rows each get one. A very long
    text is one image, made in one task in some ten times its bytes. An empty table gives an empty
    result; other columns take no part, and doc_id must be an integer (or a string of one).
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return src.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored images back: sizes, digests, tail checksum and the cosine-transform hash (hex)."""
    return media.mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
