"""What image files say about themselves, read from their bytes without a codec: size, orientation, EXIF, coordinates.

    described(files)            rows (path, content) -> facts, or an error
    scanned(found)              rows of the folder walk -> size, time, SHA-256 and facts, or an error

Every file is one row whatever it holds: one that can't be read has no hash and an error,
one that can't be understood has its hash and an error, and damaged metadata is as none.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame

from heliograph.sources.extract import coerce_json

FACTS = {
    "format": "string", "width": "int", "height": "int", "captured_at": "timestamp_ntz", "camera_make": "string", "camera_model": "string",
    "latitude": "double", "longitude": "double", "exif": "string", "error": "string",
}
#: Fixed values of the TIFF and EXIF standards: tag numbers and the bytes of each value type.
ORIENTATION, EXIF_IFD, GPS_IFD, ORIGINAL = 274, 34665, 34853, 36867
TAGS = {
    256: "ImageWidth", 257: "ImageLength", 270: "ImageDescription", 271: "Make", 272: "Model", 274: "Orientation", 282: "XResolution", 283: "YResolution", 296: "ResolutionUnit",
    305: "Software", 306: "DateTime", 315: "Artist", 33432: "Copyright", 33434: "ExposureTime", 33437: "FNumber", 34850: "ExposureProgram", 34855: "ISOSpeedRatings",
    36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 37377: "ShutterSpeedValue", 37378: "ApertureValue", 37380: "ExposureBiasValue", 37383: "MeteringMode", 37385: "Flash",
    37386: "FocalLength", 40961: "ColorSpace", 40962: "ExifImageWidth", 40963: "ExifImageHeight", 41986: "ExposureMode", 41987: "WhiteBalance", 41989: "FocalLengthIn35mmFilm", 42036: "LensModel",
}
_KINDS = {1: (1, "B"), 2: (1, None), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, None), 9: (4, "i"), 10: (8, "ii")}


class Damaged(ValueError):
    """The bytes are not a whole image of a known format."""


def _take(data: bytes, at: int, form: str) -> tuple:
    if at < 0 or at + struct.calcsize(form) > len(data):
        raise Damaged("cut short")
    return struct.unpack_from(form, data, at)


def directory(tiff: bytes, at: int, end: str) -> dict[int, object]:
    """The entries of a TIFF directory by tag; those whose value lies outside the block are left out."""
    (n,) = _take(tiff, at, end + "H")
    out: dict[int, object] = {}
    for k in range(n):
        try:
            tag, kind, count = _take(tiff, at + 2 + 12 * k, end + "HHI")
            if kind not in _KINDS:
                continue
            size, form = _KINDS[kind]
            place = at + 10 + 12 * k
            if size * count > 4:
                (place,) = _take(tiff, place, end + "I")
            raw = _take(tiff, place, f"{size * count}s")[0]
        except Damaged:
            continue
        if kind == 2:
            out[tag] = raw.rstrip(b"\0").decode("utf-8", "replace")
        elif form:
            values = struct.unpack(end + form * count, raw)
            if len(form) == 2:
                values = tuple(a / b if b else None for a, b in zip(values[::2], values[1::2], strict=True))
            out[tag] = values[0] if count == 1 else values
    return out


def _directories(tiff: bytes) -> tuple[dict, dict, dict]:
    """(main, EXIF, GPS) directories of a TIFF block."""
    end = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if end is None or _take(tiff, 2, end + "H")[0] != 42:
        raise Damaged("no TIFF header")
    main = directory(tiff, _take(tiff, 4, end + "I")[0], end)

    def below(tag: int) -> dict:
        at = main.get(tag)
        try:
            return directory(tiff, at, end) if isinstance(at, int) else {}
        except Damaged:
            return {}

    return main, below(EXIF_IFD), below(GPS_IFD)


def _time(value: object) -> datetime | None:
    try:
        return datetime.strptime(value.strip(), "%Y:%m:%d %H:%M:%S") if isinstance(value, str) else None
    except ValueError:
        return None


def _text(value: object) -> str | None:
    return (value.replace("\0", "").strip() or None) if isinstance(value, str) else None


def _degrees(value: object, sign: object, negative: str) -> float | None:
    if not isinstance(value, tuple) or len(value) != 3 or None in value:
        return None
    degrees = value[0] + value[1] / 60 + value[2] / 3600
    return -degrees if isinstance(sign, str) and sign.strip().upper() == negative else degrees


def _facts(form: str, size: tuple[int, int], tiff: bytes | None) -> dict:
    """One row's facts; width and height as the orientation turns them."""
    try:
        main, exif, gps = _directories(tiff) if tiff else ({}, {}, {})
    except Damaged:
        main, exif, gps = {}, {}, {}
    turned = main.get(ORIENTATION) in (5, 6, 7, 8)
    lat, lon = _degrees(gps.get(2), gps.get(1), "S"), _degrees(gps.get(4), gps.get(3), "W")
    if lat is None or lon is None or abs(lat) > 90 or abs(lon) > 180:
        lat = lon = None
    named = {TAGS[t]: coerce_json(v) for t, v in (main | exif).items() if t in TAGS}
    named = {k: v for k, v in named.items() if v is not None}
    return {
        "format": form, "width": size[turned], "height": size[not turned], "captured_at": _time(exif.get(ORIGINAL)) or _time(main.get(306)), "camera_make": _text(main.get(271)), "camera_model": _text(main.get(272)),
        "latitude": lat, "longitude": lon, "exif": json.dumps(named, sort_keys=True),
    }


def _jpeg(data: bytes) -> dict:
    at, size, tiff = 2, None, None
    while True:
        mark, kind = _take(data, at, "BB")
        if mark != 0xFF:
            raise Damaged("no marker where a segment begins")
        if kind == 0xFF:  # fill
            at += 1
            continue
        if kind == 0xDA:  # the picture itself follows, up to the end mark
            break
        (length,) = _take(data, at + 2, ">H")
        body = _take(data, at + 4, f"{max(length, 2) - 2}s")[0]
        if kind == 0xE1 and body[:6] == b"Exif\0\0" and tiff is None:
            tiff = body[6:]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            size = _take(body, 1, ">HH")[::-1]
        at += 2 + length
    if size is None or data.rfind(b"\xff\xd9") < at:
        raise Damaged("cut short")
    return _facts("jpeg", size, tiff)


def _png(data: bytes) -> dict:
    at, size, tiff, kind = 8, None, None, b""
    while kind != b"IEND":
        length, kind = _take(data, at, ">I4s")
        body = _take(data, at + 8, f"{length}s4x")[0]
        if kind == b"IHDR":
            size = _take(body, 0, ">II")
        elif kind == b"eXIf":
            tiff = body
        at += 12 + length
    if size is None:
        raise Damaged("no IHDR chunk")
    return _facts("png", size, tiff)


def _webp(data: bytes) -> dict:
    (length,) = _take(data, 4, "<I")
    if length + 8 > len(data):
        raise Damaged("cut short")
    at, size, tiff = 12, None, None
    while at + 8 <= length + 8:
        kind, n = _take(data, at, "<4sI")
        body = _take(data, at + 8, f"{n}s")[0]
        if kind == b"VP8X":
            size = tuple(int.from_bytes(body[i : i + 3], "little") + 1 for i in (4, 7))
        elif kind == b"VP8 " and size is None:
            size = tuple(x & 0x3FFF for x in _take(body, 6, "<HH"))
        elif kind == b"VP8L" and size is None:
            bits = _take(body, 1, "<I")[0]
            size = ((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
        elif kind == b"EXIF":
            tiff = body.removeprefix(b"Exif\0\0")
        at += 8 + n + n % 2
    if size is None:
        raise Damaged("no picture chunk")
    return _facts("webp", size, tiff)


def _gif(data: bytes) -> dict:
    size = _take(data, 6, "<HH")
    if data.rstrip(b"\0")[-1:] != b";":
        raise Damaged("cut short")
    return _facts("gif", size, None)


def _tiff(data: bytes) -> dict:
    main = _directories(data)[0]
    size = main.get(256), main.get(257)
    if not all(isinstance(s, int) for s in size):
        raise Damaged("no size")
    return _facts("tiff", size, data)


def _heif(data: bytes) -> dict:
    """The largest picture's size, turned as its file says; of HEIF only the item properties are read."""
    sizes, turns = [], 0

    def boxes(at: int, end: int) -> None:
        nonlocal turns
        while at + 8 <= end:
            n, kind = _take(data, at, ">I4s")
            n = n or end - at
            if n < 8 or at + n > len(data):
                raise Damaged("cut short")
            if kind in (b"meta", b"iprp", b"ipco"):
                boxes(at + (12 if kind == b"meta" else 8), at + n)
            elif kind == b"ispe":
                sizes.append(_take(data, at + 12, ">II"))
            elif kind == b"irot":
                turns = _take(data, at + 8, "B")[0] & 3
            at += n

    boxes(0, len(data))
    if not sizes:
        raise Damaged("no picture size")
    w, h = max(sizes, key=lambda s: s[0] * s[1])
    return _facts("heic", (h, w) if turns % 2 else (w, h), None)


#: How the formats begin: (offset, bytes, reader).
_STARTS = ((0, b"\xff\xd8", _jpeg), (0, b"\x89PNG\r\n\x1a\n", _png), (0, b"GIF8", _gif), (8, b"WEBP", _webp), (0, b"II*\0", _tiff), (0, b"MM\0*", _tiff), (4, b"ftyp", _heif))


def read_header(data: bytes) -> dict:
    """The facts of one file, or Damaged."""
    for at, start, reader in _STARTS:
        if data[at : at + len(start)] == start:
            return reader(data)
    raise Damaged("no known image format")


def _row(data: bytes | None, read: Callable[[bytes], dict]) -> dict:
    try:
        return read(data or b"")
    except Exception as e:  # a file that can't be understood must not end the scan
        return {"error": f"{type(e).__name__}: {e}"}


_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us"), "long": pa.int64()}


def _batch(rows: list[dict], fields: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], _ARROW[k]) for f, k in fields.items()], list(fields))


def described(files: DataFrame, read: Callable[[bytes], dict] = read_header) -> DataFrame:
    """(path, facts, error) of rows with path and content; ``read`` may be another reader of bytes."""
    fields = {"path": "string"} | FACTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = batch.column(0).to_pylist(), batch.column(1)
            yield _batch([{"path": p} | _row(c.as_py(), read) for p, c in zip(paths, contents, strict=True)], fields)

    return files.select("path", "content").mapInArrow(run, ", ".join(f"{f} {k}" for f, k in fields.items()))


def scanned(found: DataFrame, read: Callable[[bytes], dict] = read_header, opener: Callable = open) -> DataFrame:
    """(root, path, size_bytes, mtime_ns, sha256, facts, error) of the walk's rows: each file is read once, in its task.

    A row that the walk could not read keeps its error; ``opener(path, "rb")`` opens a file,
    by default on the machine that walked.
    """
    fields = {"root": "string", "path": "string", "size_bytes": "long", "mtime_ns": "long", "sha256": "string"} | FACTS

    def one(root: str, path: str, error: str | None) -> dict:
        out = {"root": root, "path": path, "error": error}
        if error is not None:
            return out
        try:
            with opener(path, "rb") as f:
                data = f.read()
            st = os.stat(path) if opener is open else None
        except OSError as e:
            return out | {"size_bytes": 0, "mtime_ns": 0, "error": str(e)}
        known = {"size_bytes": len(data), "mtime_ns": st.st_mtime_ns if st else None, "sha256": hashlib.sha256(data).hexdigest()}
        return out | known | _row(data, read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([one(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)], fields)

    return found.select("root", "path", "error").mapInArrow(run, ", ".join(f"{f} {k}" for f, k in fields.items()))
