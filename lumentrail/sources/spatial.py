"""Positions stored along a space-filling curve, and searches that read a few of its ranges.

A position's cell interleaves the bits of its latitude and longitude (Morton order),
so that near positions have near numbers. A table written in the order of cells has
row groups of narrow ranges. A box is covered by few ranges of cells, which go
to the Parquet reader as filters; the exact condition follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of each coordinate in a cell.
BITS = 16
#: The masks that spread 16 bits to every other of 32.
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _step(value: Column, low: float, size: float) -> Column:
    top = (1 << BITS) - 1
    return F.greatest(F.lit(0), F.least(F.lit(top), F.floor((value - low) / size * (1 << BITS)))).cast("long")


def _steps(value: float, low: float, size: float) -> int:
    return max(0, min((1 << BITS) - 1, int((value - low) / size * (1 << BITS) // 1)))


def _spread(x: Column) -> Column:
    for shift, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def cell(lat: Column, lng: Column) -> Column:
    """The number of a position's cell; null without a position. What lies outside the world goes to its edge."""
    known = lat.isNotNull() & lng.isNotNull()
    return F.when(known, F.shiftleft(_spread(_step(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(_step(lng, -180.0, 360.0))))


def write_by_cell(df: DataFrame, path: str, *, lat: str = "lat", lng: str = "lng", files: int | None = None) -> None:
    """Writes a table with its ``cell``, in the order of cells, within and between files."""
    rows = df.withColumn("cell", cell(F.col(lat), F.col(lng)))
    ranged = rows.repartitionByRange(files, "cell") if files else rows.repartitionByRange("cell")
    ranged.sortWithinPartitions("cell").write.mode("overwrite").parquet(path)


def cover(south: float, west: float, north: float, east: float, most: int = 32) -> list[tuple[int, int]]:
    """At most ``most`` ranges of cells (ends included) that hold a box, joined where they touch: quadrants that the box cuts are divided while there is room."""
    bottom, top = _steps(south, -90.0, 180.0), _steps(north, -90.0, 180.0)
    left, right = _steps(west, -180.0, 360.0), _steps(east, -180.0, 360.0)
    if south > north or west > east:
        return []
    done, todo = [], [(0, 0, BITS)]  # first row and column of a quadrant, and the bits of its side
    while todo and len(done) + len(todo) < most:
        y, x, bits = todo.pop(0)
        side = (1 << bits) - 1
        if y > top or x > right or y + side < bottom or x + side < left:
            continue
        if bits == 0 or (bottom <= y and y + side <= top and left <= x and x + side <= right):
            done.append((y, x, bits))
            continue
        half = 1 << bits - 1
        todo += [(y + dy, x + dx, bits - 1) for dy in (0, half) for dx in (0, half)]
    todo = [(y, x, b) for y, x, b in todo if not (y > top or x > right or y + (1 << b) - 1 < bottom or x + (1 << b) - 1 < left)]
    ranges = []
    for y, x, bits in done + todo:
        first = sum((y >> i & 1) << 2 * i + 1 | (x >> i & 1) << 2 * i for i in range(BITS))
        ranges.append((first, first + (1 << 2 * bits) - 1))
    joined: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if joined and a <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def in_stored_box(stored: DataFrame, south: float, west: float, north: float, east: float, *, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Rows of a table of ``write_by_cell`` in a box, ends included: only row groups with cells of its cover are read."""
    ranges = cover(south, west, north, east)
    inside = F.lit(False)
    for a, b in ranges:
        inside = inside | F.col("cell").between(a, b)
    return stored.where(inside & F.col(lat).between(south, north) & F.col(lng).between(west, east))
