"""What the first bytes of an image file say: its size and how it is turned; and a writer of PNG files."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Bytes that hold the header of any image here; of a JPEG whose markers go on beyond them no size is known.
HEAD = 1 << 16
#: Signatures of the formats, and the orientation tag of EXIF.
PNG, GIF, BMP, JPEG = b"\x89PNG\r\n\x1a\n", (b"GIF87a", b"GIF89a"), b"BM", b"\xff\xd8"
ORIENTATION = 0x0112


def size_of(head: bytes) -> tuple[int, int, int] | None:
    """(width, height, orientation 1 to 8) as stored, or None for what is no image."""
    try:
        if head.startswith(PNG) and head[12:16] == b"IHDR":
            return (*struct.unpack(">II", head[16:24]), 1)
        if head[:6] in GIF:
            return (*struct.unpack("<HH", head[6:10]), 1)
        if head.startswith(BMP):
            w, h = struct.unpack("<ii", head[18:26])
            return w, abs(h), 1
        if head.startswith(JPEG):
            return _jpeg(head)
    except struct.error:  # cut off
        pass
    return None


def _jpeg(head: bytes) -> tuple[int, int, int] | None:
    at, turned = 2, 1
    while at + 4 <= len(head):
        if head[at] != 0xFF:
            return None
        marker = head[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        length = struct.unpack(">H", head[at + 2 : at + 4])[0]
        if marker == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
            turned = _orientation(head[at + 10 : at + 2 + length])
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a frame
            h, w = struct.unpack(">HH", head[at + 5 : at + 9])
            return w, h, turned
        at += 2 + length
    return None


def _orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return 1
    first = struct.unpack(f"{order}I", tiff[4:8])[0]
    for k in range(struct.unpack(f"{order}H", tiff[first : first + 2])[0]):
        entry = tiff[first + 2 + 12 * k : first + 14 + 12 * k]
        if struct.unpack(f"{order}H", entry[:2])[0] == ORIENTATION:
            value = struct.unpack(f"{order}H", entry[8:10])[0]
            return value if 1 <= value <= 8 else 1
    return 1


def shown_size(head: bytes) -> tuple[int, int] | None:
    """Width and height as shown: orientations from 5 on lie on their side."""
    found = size_of(head)
    return None if found is None else (found[1], found[0]) if found[2] >= 5 else found[:2]


def upright(img: np.ndarray, orientation: int) -> np.ndarray:
    """An image turned the way its orientation says it is meant to be seen."""
    if orientation >= 5:
        img = img.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        img = img[:, ::-1]
    if orientation in (3, 4, 7, 8):
        img = img[::-1]
    return img


def png(img: np.ndarray) -> bytes:
    """A PNG file of (height, width, 1, 3 or 4 channels; uint8)."""
    h, w, c = img.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.column_stack([np.zeros((h, 1), dtype=np.uint8), img.reshape(h, w * c)])
    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")
