"""EXIF tags of image files as a Spark data source.

``spark.dataSource.register(ExifSource)`` and
``spark.read.format("exif").load(folder)`` give a row for each image: its path,
size and tags. Only a file's head is read: the segments of a JPEG are passed over
by their lengths until the one with the tags. Folders may lie wherever pyarrow's
file systems reach; files are dealt to partitions by number.

Tags are walked in the TIFF directories of the segment, in either byte order. What
is broken (a cut file, an entry that points outside, a directory that leads back to
itself) is null or left out, and never fails the read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tags that are kept, by directory.
IMAGE = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "changed"}
PHOTO = {0x829A: "exposure", 0x829D: "aperture", 0x8827: "iso", 0x9003: "taken", 0x920A: "focal", 0xA002: "width", 0xA003: "height"}
PLACE = {0x0001: "lat_ref", 0x0002: "lat", 0x0003: "lng_ref", 0x0004: "lng"}
POINTERS = {0x8769: PHOTO, 0x8825: PLACE}
#: Struct codes of the types of TIFF entries (ratios take two).
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii"}
SCHEMA = "path string, size long, make string, model string, orientation int, taken timestamp_ntz, exposure double, aperture double, iso int, focal double, width int, height int, lat double, lng double"
#: Values of an entry beyond which it is no tag of these.
MOST_VALUES = 4_096


def tiff_of(head) -> bytes | None:
    """The TIFF part of a JPEG's EXIF segment (or of a TIFF file's head), read from a file at its start; None without one."""
    start = head.read(4)
    if start in (b"II*\0", b"MM\0*"):
        return start + head.read(65_532)
    if start[:2] != b"\xff\xd8":
        return None
    marker = start[2:]
    while len(marker) == 2 and marker[0] == 0xFF and marker[1] not in (0xDA, 0xD9):  # up to the image itself
        size = head.read(2)
        if len(size) < 2 or (length := struct.unpack(">H", size)[0] - 2) < 0:
            return None
        body = head.read(length)
        if marker[1] == 0xE1 and body[:6] == b"Exif\0\0":
            return body[6:]
        marker = head.read(2)
    return None


def _value(tiff: bytes, order: str, entry: int):
    kind, count = struct.unpack_from(order + "HI", tiff, entry + 2)
    code = TYPES.get(kind)
    if code is None or not 0 < count <= MOST_VALUES:
        return None
    size = struct.calcsize(order + code) * count
    at = entry + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
    if at + size > len(tiff):
        return None
    if code == "s":
        return tiff[at : at + size].split(b"\0")[0].decode("utf-8", "replace").strip()
    numbers = struct.unpack_from(order + code * count, tiff, at)
    if len(code) == 2:
        return [a / b if b else None for a, b in zip(numbers[::2], numbers[1::2])]
    return list(numbers)


def tags_of(tiff: bytes) -> dict:
    """Tags by name, of the first directory and those it points to; {} for anything else."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2], "")
    out: dict = {}
    if not order or len(tiff) < 8:
        return out
    todo, seen = [(struct.unpack_from(order + "I", tiff, 4)[0], IMAGE)], set()
    while todo:
        at, names = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
            entry = at + 2 + 12 * i
            if entry + 12 > len(tiff):
                break
            tag = struct.unpack_from(order + "H", tiff, entry)[0]
            value = _value(tiff, order, entry) if tag in names or tag in POINTERS else None
            if value and tag in POINTERS and isinstance(value, list):
                todo.append((int(value[0]), POINTERS[tag]))
            elif value and tag in names:
                out.setdefault(names[tag], value)
    return out


def _number(tags: dict, name: str, whole: bool = False):
    value = tags.get(name)
    value = value[0] if isinstance(value, list) else value
    try:
        return None if value is None else int(value) if whole else float(value)
    except ValueError:
        return None


def _degrees(tags: dict, name: str, least: str) -> float | None:
    parts = tags.get(name)
    if not isinstance(parts, list) or len(parts) < 3 or None in parts[:3]:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -value if str(tags.get(f"{name}_ref", "")).upper() == least else value


def _time(text) -> datetime | None:
    try:
        return datetime.strptime(text, "%Y:%m:%d %H:%M:%S")
    except (TypeError, ValueError):
        return None


def row_of(path: str, size: int, tags: dict) -> tuple:
    """A row of ``SCHEMA``; the time a picture was taken, else changed."""
    words = [x if isinstance(x := tags.get(k), str) and x else None for k in ("make", "model")]
    return (
        path, size, *words, _number(tags, "orientation", True), _time(tags.get("taken")) or _time(tags.get("changed")), _number(tags, "exposure"), _number(tags, "aperture"),
        _number(tags, "iso", True), _number(tags, "focal"), _number(tags, "width", True), _number(tags, "height", True), _degrees(tags, "lat", "S"), _degrees(tags, "lng", "W"),
    )


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths


class ExifReader(DataSourceReader):
    def __init__(self, folder: str, files: int):
        self.folder, self.files = folder, files

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._system()
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file)
        return [Files(found[at : at + self.files]) for at in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._system()
        for path, size in partition.paths:
            try:
                with system.open_input_file(path) as head:
                    tiff = tiff_of(head)
                tags = tags_of(tiff) if tiff else {}
            except (OSError, struct.error):
                tags = {}
            yield row_of(path, size, tags)


class ExifSource(DataSource):
    """Options: ``path``, and ``filesPerPartition`` (10,000)."""

    @classmethod
    def name(cls) -> str:
        return "exif"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExifReader:
        return ExifReader(self.options["path"], int(self.options.get("filesPerPartition", "10000")))
