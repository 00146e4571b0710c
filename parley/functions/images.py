"""Model outputs as RGB images: taking the image out of a result, and decoding to RGB PNG."""

from __future__ import annotations

import struct
import zlib
from typing import Any

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of PNG color types with 8 bits a sample: gray, RGB, palette, gray and alpha, RGB and alpha.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def image_of(result: Any) -> Any:
    """The first image of a model's result: the result itself if it is one, else from ``images`` or ``request_output.images``; a ValueError if there is none."""
    if isinstance(result, (bytes, bytearray)) or hasattr(result, "convert"):
        if isinstance(result, (bytes, bytearray)) and not result:
            raise ValueError("the result has no image")
        return result
    holder = result if getattr(result, "images", None) else getattr(result, "request_output", None)
    found = getattr(holder, "images", None)
    if not found:
        raise ValueError("the result has no image")
    return image_of(found[0])


def _chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    at, out = len(_SIGNATURE), []
    while at + 8 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        out.append((data[at + 4 : at + 8], data[at + 8 : at + 8 + size]))
        at += 12 + size
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The pixels (height, width, 3) of a PNG with 8 bits a sample that is not interlaced; alpha is left out. A ValueError for anything else."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    chunks = _chunks(data)
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", dict(chunks)[b"IHDR"])
    if depth != 8 or kind not in _CHANNELS or interlaced:
        raise ValueError(f"PNG of color type {kind} with {depth} bits")
    n = _CHANNELS[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(c for name, c in chunks if name == b"IDAT")), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, np.uint8)
    for y in range(height):
        how, line = int(raw[y, 0]), raw[y, 1:].copy()
        if how == 2:
            line += above
        elif how == 1:
            line = np.cumsum(line.reshape(width, n), axis=0, dtype=np.uint8).reshape(-1)
        elif how:
            for i in range(width * n):
                a, b, c = (int(line[i - n]) if i >= n else 0), int(above[i]), (int(above[i - n]) if i >= n else 0)
                if how == 3:
                    add = (a + b) // 2
                else:
                    p = a + b - c
                    add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[i] = (int(line[i]) + add) & 255
        out[y] = above = line
    pixels = out.reshape(height, width, n)
    if kind == 3:
        palette = np.frombuffer(dict(chunks)[b"PLTE"], np.uint8).reshape(-1, 3)
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if kind in (0, 4) else pixels[:, :, :3]


def encode_png(pixels: np.ndarray) -> bytes:
    """An RGB PNG of pixels (height, width, 3)."""
    height, width, _ = pixels.shape
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 3)], axis=1)
    return _SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def rgb_png(result: Any) -> bytes:
    """The image of a model's result as the bytes of an RGB PNG.

    Image objects with ``convert`` and ``save`` are converted by themselves, other formats than PNG need the Pillow
    package; a ValueError tells of what can't be decoded.
    """
    import io

    image = image_of(result)
    if isinstance(image, (bytes, bytearray)):
        data = bytes(image)
        if data.startswith(_SIGNATURE):
            header = dict(_chunks(data)).get(b"IHDR", b"")
            return data if len(header) > 9 and header[9] == 2 and header[8] == 8 else encode_png(decode_png(data))
        try:
            from PIL import Image
        except ImportError as e:
            raise ValueError("only PNG can be decoded here") from e
        image = Image.open(io.BytesIO(data))
    out = io.BytesIO()
    image.convert("RGB").save(out, format="PNG")
    return out.getvalue()
