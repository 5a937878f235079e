"""A minimal PNG writer for fixtures (no image library here)."""

import struct
import zlib

import numpy as np


def png(a: np.ndarray) -> bytes:
    h, w, _ = a.shape
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
