"""Shape screening and line simplification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pavesa.functions import geo


def flatten_2d(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))


def screen(ring: Column) -> Column:
    """Why a 2-D ring is unusable, or NULL: empty, too_short, not_closed, self_crossing, no_area."""
    edges = geo.ring_edges(ring)
    last = F.get(ring, F.size(ring) - 1)
    crossing = F.exists(edges, lambda a: F.exists(edges, lambda b: geo.segments_cross(a, b)))
    return (
        F.when(ring.isNull() | (F.size(ring) == 0), "empty")
        .when(F.size(ring) < 4, "too_short")
        .when(F.get(ring, F.lit(0)) != last, "not_closed")
        .when(crossing, "self_crossing")
        .when(geo.ring_area_ha(ring) == 0, "no_area")
    )

#: Gaps are compared in this share of the tolerance, so that points of one gap are a tie, which the first one wins.
GAP_UNIT = 1e-6
#: Fewest points of a closed ring.
RING_POINTS = 4


def kept_points(xy: np.ndarray, starts: np.ndarray, ends: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Keep-mask of a Douglas-Peucker pass over many lines in one buffer; line k has the points ``starts[k]:ends[k]``.

    All undecided stretches of all lines are split at once, a level at a time. A tolerance of 0 or less keeps each point.
    """
    keep = np.zeros(len(xy), bool)
    whole = tolerance <= 0
    for a, b in zip(starts[whole], ends[whole]):
        keep[a:b] = True
    some = ends > starts
    keep[starts[some]] = keep[ends[some] - 1] = True
    a, b, tol = starts[~whole], ends[~whole] - 1, tolerance[~whole]
    while True:
        open_ = b - a > 1
        a, b, tol = a[open_], b[open_], tol[open_]
        if not len(a):
            return keep
        inner = b - a - 1
        first = np.cumsum(inner) - inner
        owner = np.repeat(np.arange(len(a)), inner)
        at = np.arange(len(owner)) + np.repeat(a + 1 - first, inner)
        step = xy[b] - xy[a]
        length2 = step[:, 0] * step[:, 0] + step[:, 1] * step[:, 1]
        mid, long_ = xy[at] - xy[a][owner], step[owner]
        along = mid[:, 0] * long_[:, 0] + mid[:, 1] * long_[:, 1]
        share = np.where(length2[owner] > 0, np.clip(along / np.where(length2 > 0, length2, 1.0)[owner], 0.0, 1.0), 0.0)
        off = mid - share[:, None] * long_
        gap = np.rint(np.sqrt(off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1]) / tol[owner] / GAP_UNIT)
        top = np.maximum.reduceat(gap, first)
        place = np.minimum.reduceat(np.where(gap == top[owner], np.arange(len(owner)), len(owner)), first)
        split = top > 1 / GAP_UNIT
        far = at[place[split]]
        keep[far] = True
        a, b, tol = np.concatenate([a[split], far]), np.concatenate([far, b[split]]), np.concatenate([tol[split]] * 2)


def simplify_line(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Keep-mask of one line."""
    return kept_points(xy, np.array([0]), np.array([len(xy)]), np.array([float(tolerance)]))


def _bounds(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    absent = lists.is_null().to_numpy(zero_copy_only=False)
    return offsets[:-1], np.where(absent, offsets[:-1], offsets[1:])


def _shortened(lines: pa.ListArray, tolerance: np.ndarray, least: int) -> pa.ListArray:
    starts, ends = _bounds(lines)
    xy = np.column_stack([pc.struct_field(lines.values, n).to_numpy(zero_copy_only=False) for n in ("x", "y")])
    keep = kept_points(xy, starts, ends, tolerance)
    before = np.concatenate([[0], np.cumsum(keep)])
    for k in np.flatnonzero(before[ends] - before[starts] < least):
        keep[starts[k] : ends[k]] = True
    counts = np.concatenate([[0], np.cumsum(keep)])
    counts = np.concatenate([[0], np.cumsum(counts[ends] - counts[starts])])
    used = np.zeros(len(xy) + 1, np.int64)
    np.add.at(used, starts, 1)
    np.add.at(used, ends, -1)
    points = lines.values.filter(pa.array(keep & (np.cumsum(used)[:-1] > 0)))
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), points, type=lines.type, mask=lines.is_null())


def simplify_lines(rows: DataFrame, line_col: str = "line", tolerance_col: str = "tolerance") -> DataFrame:
    """Each line, or each ring of a list of rings, at the row's own tolerance, on Arrow list buffers; other columns stay.

    Ends stay; a ring that would have fewer than four points stays whole. A NULL line stays NULL; a NULL tolerance changes nothing.
    Lines are judged one by one: whether simplified lines cross each other isn't looked at.
    """
    rings = isinstance(rows.schema[line_col].dataType.elementType, T.ArrayType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index(line_col)
            lines = batch.column(at)
            tolerance = pc.fill_null(batch.column(tolerance_col).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            if rings:
                starts, ends = _bounds(lines)
                each = np.zeros(len(lines.values))
                for s, e, tol in zip(starts, ends, tolerance):
                    each[s:e] = tol
                offsets = pa.array(np.array(lines.offsets), pa.int32())
                new = pa.ListArray.from_arrays(offsets, _shortened(lines.values, each, RING_POINTS), type=lines.type, mask=lines.is_null())
            else:
                new = _shortened(lines, tolerance, 0)
            yield pa.RecordBatch.from_arrays([new if i == at else col for i, col in enumerate(batch.columns)], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)
