"""The little of the MAT 5 format that a numeric cube needs."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# MAT 5 element types of numbers, and the types of a matrix and of packed data.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, PACKED = 14, 15


def _element(data: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    kind, size = struct.unpack_from(order + "II", data, at)
    if kind >> 16:  # a small element: size and type share a word
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    end = at + 8 + size
    return kind, data[at + 8 : end], end if kind == PACKED else at + 8 + (size + 7) // 8 * 8


def arrays(data: bytes):
    """Name and array of each real numeric matrix of a file."""
    order, at = ("<" if data[126:128] == b"IM" else ">"), 128
    while at + 8 <= len(data):
        kind, body, at = _element(data, at, order)
        if kind == PACKED:
            kind, body, _ = _element(zlib.decompress(body), 0, order)
        if kind != MATRIX:
            continue
        _, _, p = _element(body, 0, order)
        _, dims, p = _element(body, p, order)
        _, name, p = _element(body, p, order)
        kind, values, _ = _element(body, p, order)
        if kind in NUMBERS:
            shape = np.frombuffer(dims, order + "i4")
            found = np.frombuffer(values, order + NUMBERS[kind])
            if found.size == np.prod(shape):
                yield name.decode(), found.reshape(shape, order="F")


def first_cube(data: bytes, key: str | None = None) -> np.ndarray:
    for name, array in arrays(data):
        if array.ndim == 3 and (name == key if key else not name.startswith("__")):
            return array
    raise ValueError(f"no 3-D array{f' named {key}' if key else ''}")
