"""Rows of pixels, and runs of columns in them.

A picture is a table with a row for each of its rows: keys, y and arrays of
packed colours (0xRRGGBB), one for each column. What needs one row only stays
inside it; what leaves it is small: columns that differ, runs, counts.

A run (keys, y, a, b) is a stretch of columns a to b, both included.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .joins import dealt

SHIFTS = {"r": 16, "g": 8, "b": 0}
#: Rows that one group of a pass over columns holds, beside its halo.
TILE_ROWS = 256
#: Bytes of a batch of rows of pixels to Python, in sessions that set no other limit.
BATCH_BYTES = "4m"


def channel(pixel: Column, name: str) -> Column:
    return F.shiftright(pixel, SHIFTS[name]).bitwiseAND(F.lit(255))


def packed(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b).cast("int")


def delta(a: Column, b: Column) -> Column:
    """The largest difference of a channel."""
    return F.greatest(*[F.abs(channel(a, c) - channel(b, c)) for c in SHIFTS])


def columns_where(pixels: Column, condition) -> Column:
    """The columns x, in order, with condition(x)."""
    return F.when(F.size(pixels) > 0, F.filter(F.sequence(F.lit(0), F.size(pixels) - 1), condition)).otherwise(F.array().cast("array<int>"))


def runs_of(xs: Column) -> Column:
    """Runs of sorted, distinct columns, as array of struct(a, b)."""
    starts = F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1) != x - 1))
    ends = F.filter(xs, lambda x, i: (i == F.size(xs) - 1) | (F.get(xs, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def union_runs(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """boxes: (keys, xa, ya, xb, yb), whole columns and rows, both ends
    included. The longest runs that any of them covers: (keys, y, a, b).

    Scanline fill: on each of its rows a box opens at its first column and
    closes after its last; where the sum of what is open is above 0, columns are
    covered. Boxes that are empty cover nothing. Steps at one column combine
    before the shuffle, so equal boxes cost one."""
    rows = boxes.filter("xa <= xb AND ya <= yb").select(*keys, F.explode(F.sequence("ya", "yb")).alias("y"), "xa", "xb")
    ends = F.array(F.struct(F.col("xa").alias("x"), F.lit(1).alias("step")), F.struct((F.col("xb") + 1).alias("x"), F.lit(-1).alias("step")))
    steps = rows.select(*keys, "y", F.inline(ends)).groupBy(*keys, "y", "x").agg(F.sum("step").alias("step")).filter("step <> 0")
    row = Window.partitionBy(*keys, "y").orderBy("x")
    depth = F.sum("step").over(row.rowsBetween(Window.unboundedPreceding, 0))
    edges = steps.withColumn("depth", depth).filter("depth = 0 OR depth = step")  # a run's end, or its begin
    return edges.select(*keys, "y", F.col("x").alias("a"), (F.lead("x").over(row) - 1).alias("b"), "depth").filter("depth > 0").drop("depth")


def clipped(runs: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """Runs inside a box of whole columns and rows, ends included."""
    inside = runs.filter((F.col("y") >= y0) & (F.col("y") <= y1))
    return inside.withColumns({"a": F.greatest("a", x0), "b": F.least("b", x1)}).filter("a <= b")


def not_covered(points: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """points: (keys, y, x, ...), those on no run."""
    p, r = points.alias("p"), dealt(runs.alias("r"))
    on = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in [*keys, "y"]]
    on.append(F.col("p.x").between(F.col("r.a"), F.col("r.b")))
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return p.join(r, condition, "left_anti")


def box_radius(sigma: float, passes: int) -> float:
    """The radius at which so many box blurs have the variance of a Gaussian."""
    v = sigma * sigma / passes
    whole = math.floor((math.sqrt(12 * v + 1) - 1) / 2)
    return whole + (2 * whole + 1) * (whole * (whole + 1) - 3 * v) / (6 * (v - (whole + 1) ** 2))


def box_weights(radius: float) -> tuple[int, int, int]:
    """(reach, weight inside, weight at the ends) of a box blur of fractional
    radius, in parts of 2**24."""
    whole = int(radius)
    inside = int((1 << 24) / (radius * 2 + 1))
    return whole + 1, inside, ((1 << 24) - (whole * 2 + 1) * inside) // 2


def bounded(df: DataFrame) -> DataFrame:
    """df, whose batches to Python do not grow with the width of a picture."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.conf._jconf.contains(key):
        df.sparkSession.conf.set(key, BATCH_BYTES)
    return df


def matrix(column: pa.ListArray, missing: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists as (values, valid, sizes): a row for each list, as wide as the
    widest; valid is false beyond a list's end and where it holds null, size is
    -1 for a null list."""
    offsets, known = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(known, np.diff(offsets), -1)
    width = int(sizes.max(initial=0))
    inside = np.arange(width) < sizes[:, None]
    at = np.where(inside, offsets[:-1, None] + np.arange(width), 0)
    values = column.values
    if not len(values):
        return np.full(at.shape, missing), inside, sizes
    valid = inside & values.is_valid().to_numpy(zero_copy_only=False)[at] if values.null_count else inside
    return values.fill_null(bool(missing) if pa.types.is_boolean(values.type) else missing).to_numpy(zero_copy_only=False)[at], valid, sizes


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """delta, of arrays."""
    each = [np.abs((a >> n & 255) - (b >> n & 255)) for n in SHIFTS.values()]
    return np.maximum(np.maximum(each[0], each[1]), each[2])


def blur(p: np.ndarray, valid: np.ndarray, sizes: np.ndarray, group: np.ndarray, sigma: float, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of packed pixels, group by group, under `passes` box blurs along
    rows and as many along columns. A row of no size has no neighbours."""
    reach, inside, ends = box_weights(box_radius(sigma, passes))
    n, width = p.shape
    steps = range(-reach, reach + 1)
    last = np.maximum(sizes - 1, 0)[:, None]
    across = [np.clip(np.arange(width) + k, 0, last) for k in steps]
    # the row k further on; the last one there is, beyond an edge
    along: dict[int, np.ndarray] = {0: np.arange(n)}
    for k in (*range(1, reach + 1), *range(-1, -reach - 1, -1)):
        to = np.clip(np.arange(n) + k, 0, n - 1)
        there = (np.arange(n) + k == to) & (group[to] == group) & (sizes[to] >= 0)
        along[k] = np.where(there, to, along[k - 1 if k > 0 else k + 1])

    def mixed(taps: list[np.ndarray]) -> np.ndarray:
        return (sum(taps[1:-1]) * inside + (taps[0] + taps[-1]) * ends + (1 << 23)) >> 24

    out = np.zeros(p.shape, np.int64)
    for shift in SHIFTS.values():
        v = (p.astype(np.int64) >> shift) & 255
        for _ in range(passes):
            v = mixed([np.take_along_axis(v, i, 1) for i in across])
        for _ in range(passes):
            v = mixed([v[along[k]] for k in steps])
        out |= v << shift
    if not valid.all():
        for _ in range(passes):
            valid = np.logical_and.reduce([np.take_along_axis(valid, i, 1) for i in across])
        for _ in range(passes):
            valid = np.logical_and.reduce([valid[along[k]] for k in steps])
    return out, valid


def tiled(rows: DataFrame, halo: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """rows with _tile: each row in its tile, and in those whose halo it is in."""
    if halo > tile_rows:
        raise ValueError(f"tiles need {halo} rows at least")
    return rows.withColumn("_tile", F.explode(F.array_distinct(F.array(*[F.floor((F.col("y") + d) / tile_rows) for d in (-halo, 0, halo)]))))


def changes(t: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Whether a row is the first of its values of `names`."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for n in names:
        c = t.column(n).combine_chunks()
        now, before = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        same = pc.or_(pc.fill_null(pc.equal(now, before), False), pc.and_(now.is_null(), before.is_null()))
        out[1:] |= ~same.to_numpy(zero_copy_only=False)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str], context: Callable[[pa.Table], pa.Table] = lambda t: t.slice(0, 0)) -> Iterator[pa.Table]:
    """Sorted batches, cut where `names` change. context: of what was given, the
    rows that go before the next table."""
    rest: list[pa.Table] = []
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if not now.num_rows:
            continue
        both = pa.concat_tables([rest[-1].slice(rest[-1].num_rows - 1), now]) if rest else now
        starts = np.flatnonzero(changes(both, names)[1:]) + (0 if rest else 1)
        if not len(starts):
            rest.append(now)
            continue
        cut = int(starts[-1])
        done = pa.concat_tables([*rest, now.slice(0, cut)]).combine_chunks()
        yield done
        rest = [t for t in (context(done), now.slice(cut)) if t.num_rows]
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def one(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def lists(values: np.ndarray, keep: np.ndarray, null: np.ndarray | None = None, empty: np.ndarray | None = None) -> pa.ListArray:
    """Lists of the values of each row where keep holds. empty: values to be null."""
    ends = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
    flat = pa.array(values[keep].astype(np.int32), mask=None if empty is None else empty[keep])
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=None if null is None else pa.array(null))


def blurred(rows: DataFrame, keys: Sequence[str], pixels: str, out: str, sigma: float, passes: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """rows with `out`: pixels under a Gaussian blur, made of box blurs along
    rows, then along columns; edges repeat.

    Rows meet in tiles, each with a halo of as many rows as the passes reach, so
    no group grows with a picture; tiles are sorted into partitions, and those of
    a batch are blurred at once."""
    halo = box_weights(box_radius(sigma, passes))[0] * passes
    placed = tiled(rows, halo, tile_rows).repartition(*keys, "_tile").sortWithinPartitions(*keys, "_tile", "y")
    columns = rows.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, [*keys, "_tile"]):
            p, valid, sizes = matrix(one(t, pixels))
            soft, fine = blur(p, valid, sizes, np.cumsum(changes(t, [*keys, "_tile"])), sigma, passes)
            own = np.floor_divide(t.column("y").to_numpy(), tile_rows) == t.column("_tile").to_numpy()
            inside = np.arange(p.shape[1]) < sizes[:, None]
            told = t.select(columns).append_column(out, lists(soft, inside, sizes < 0, ~fine)).filter(pa.array(own))
            yield from told.to_batches()

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return bounded(placed).mapInArrow(of, schema)
