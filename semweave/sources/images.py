"""Local images: read once, checked, and sent beside the questions that refer to them."""

from __future__ import annotations

import base64
import json
import os
import re
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.functions.media import MARK, REFERENCE

#: What an image may be.
MAX_FILE = 16 * 1024 * 1024
MIN_SIDE, MAX_SIDE, MIN_AREA = 256, 1568, 78_400
MAX_REQUEST = 32 * 1024 * 1024
FOUND = re.compile(REFERENCE + "[0-9a-f]{64}")


@dataclass(frozen=True)
class Image:
    format: str
    width: int
    height: int
    data: bytes

    @property
    def budget(self) -> int:
        """Bytes that a batch reckons for it."""
        return max(self.width * self.height * 4 + 65_536, len(base64.b64encode(self.data)) + 256)


def png_size(data: bytes) -> tuple[int, int] | None:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    return None


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Walk the segments to a start-of-frame."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
        elif mark in (0x01, *range(0xD0, 0xD9)):
            at += 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def load(path: str) -> Image:
    if not os.path.isfile(path):
        raise ValueError(f"{path} is not a regular file")
    size = os.path.getsize(path)
    if not 0 < size <= MAX_FILE:
        raise ValueError(f"{path} must have 1 to {MAX_FILE} bytes")
    with open(path, "rb") as f:
        data = f.read()
    kind, found = ("png", png_size(data)) if data[:1] == b"\x89" else ("jpg", jpeg_size(data))
    if found is None:
        raise ValueError(f"{path} is neither PNG nor JPEG")
    width, height = found
    if not (MIN_SIDE <= width <= MAX_SIDE and MIN_SIDE <= height <= MAX_SIDE and width * height >= MIN_AREA):
        raise ValueError(f"{path}: {width} x {height} is out of range")
    return Image(kind, width, height, data)


_loaded: dict[str, Image] = {}


def image(ref: str, paths: dict[str, str]) -> Image:
    return _loaded.get(ref) or _loaded.setdefault(ref, load(paths[ref]))


def budget_of(text: str, paths: dict[str, str]) -> int:
    """Bytes that a batch reckons for the images a text refers to, repeated ones too."""
    return sum(image(r, paths).budget for r in FOUND.findall(text) if r in paths)


def attach(body: dict, paths: dict[str, str]) -> dict:
    """``body`` with the images that its texts refer to, each once."""
    refs = sorted(set(FOUND.findall(json.dumps(body))))
    if not refs:
        return body
    assets = {}
    for r in refs:
        found = image(r, paths)
        assets[r] = {"type": "image", "format": found.format, "data_base64": base64.b64encode(found.data).decode()}
    out = body | {"assets": assets}
    if len(json.dumps(out)) > MAX_REQUEST:
        raise ValueError("a request with images is too large")
    return out


def image_paths(df: DataFrame, column: str) -> dict[str, str]:
    """Reference -> path of the distinct images of a media column. The list of an image query's files is small beside the
    images themselves, and every one of them is sent."""
    paths = df.select(F.col(f"{column}.path").alias("path")).where(F.col(f"{column}.{MARK}").isNotNull()).distinct()
    rows = paths.select("path", F.concat(F.lit(REFERENCE), F.sha2("path", 256)).alias("ref")).toLocalIterator()
    return {r["ref"]: r["path"] for r in rows}
