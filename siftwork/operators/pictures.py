"""Raw pictures, rows of (id, w, h, rgba): regions filled, sizes reduced. Pixels are worked on in numpy, Arrow batch by Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork import schema

_ROW = "w int, h int, rgba binary"


def _each(rows: DataFrame, key: str, change, extra: int = 0) -> DataFrame:
    """rows(key, w, h, rgba, more) with change(pixels, more) for each picture, a few at a time. A picture whose bytes don't fit its size is null."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                made = []
                for w, h, raw, *more in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True):
                    fits = raw is not None and w is not None and h is not None and len(raw) == 4 * w * h and w > 0 and h > 0
                    made.append(change(np.frombuffer(raw, np.uint8).reshape(h, w, 4), *more) if fits else None)
                sizes = [pa.array([None if p is None else p.shape[k] for p in made], pa.int32()) for k in (1, 0)]
                yield pa.RecordBatch.from_arrays([part.column(0), *sizes, pa.array([None if p is None else p.tobytes() for p in made], pa.binary())], names=[key, "w", "h", "rgba"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {_ROW}")


def redact(pictures: DataFrame, rects: DataFrame, key: str = "id") -> DataFrame:
    """pictures(key, w, h, rgba) with rects(key, rect) filled black: origins down, sizes up to whole pixels, cut at the edges."""
    per = rects.groupBy(key).agg(F.collect_list(F.array("rect.x", "rect.y", "rect.w", "rect.h")).alias("rects"))

    def fill(p: np.ndarray, boxes) -> np.ndarray:
        out = p.copy()
        for x, y, w, h in boxes or []:
            x, y, w, h = max(0, int(np.floor(x))), max(0, int(np.floor(y))), int(np.ceil(w)), int(np.ceil(h))
            if w > 0 and h > 0:
                out[y : y + h, x : x + w] = (0, 0, 0, 255)
        return out

    return _each(pictures.join(per, key, "left").select(key, "w", "h", "rgba", "rects"), key, fill)


def downscale(pictures: DataFrame, key: str = "id", longest: int = schema.LONG_SIDE) -> DataFrame:
    """pictures whose longer side is at most `longest`, by the mean of the pixels that fall into each new one; smaller ones stay."""

    def shrink(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        s = min(1.0, longest / max(w, h))
        if s == 1.0:
            return p
        nw, nh = max(1, int(np.floor(w * s + 0.5))), max(1, int(np.floor(h * s + 0.5)))
        rows, columns = (np.arange(n) * old // n for n, old in ((nh, h), (nw, w)))
        total = np.add.reduceat(np.add.reduceat(p.astype(np.uint32), rows, 0), columns, 1)
        count = np.diff(np.append(rows, h))[:, None, None] * np.diff(np.append(columns, w))[None, :, None]
        return (total // count).astype(np.uint8)

    return _each(pictures.select(key, "w", "h", "rgba"), key, shrink)
