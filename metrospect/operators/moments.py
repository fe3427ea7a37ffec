"""Second moments of vectors, cut into square tiles, so that any width takes the same path.

A task adds up d x d sums of the rows it reads, once per set of metrics that count a row, and emits
their upper half tile by tile. Tiles are merged in two shuffles and never meet whole before the solver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Side of a tile: 256 x 256 sums are half a megabyte.
TILE = 256
# Sums that a task holds before it passes them on; rows of one cell should lie together.
HELD_BYTES = 1 << 30
SLICE_BYTES = 64 << 20
# row and col of the entry that holds n, Σy, Σy², Σx and Σxy instead of a tile.
HEAD = -1
PARTIAL_KEYS = ["layer", "pool", "part", "mask", "row", "col", "salt"]
KEYS = ["layer", "pool", "metric", "part", "row", "col"]
PARTIAL_SCHEMA = (
    "layer int, pool string, part string, mask long, row int, col int, salt int, sums array<double>"
)
_ARROW = pa.schema(
    [("layer", pa.int32()), ("pool", pa.string()), ("part", pa.string()), ("mask", pa.int64()),
     ("row", pa.int32()), ("col", pa.int32()), ("salt", pa.int32()),
     ("sums", pa.list_(pa.float64()))]
)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose vectors, as doubles, stay within SLICE_BYTES."""
    widest = pc.max(pc.list_value_length(batch.column("vec"))).as_py() or 1
    rows = max(1, SLICE_BYTES // (8 * widest))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _matrix(column: pa.Array, where: tuple) -> np.ndarray:
    """Lists of one length as a 2-d float64 array."""
    widths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(widths) != 1:
        raise ValueError(f"vectors of layer, pool, part {where} have the widths {sorted(widths)}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _parts(batch: pa.RecordBatch, metrics: list[str]) -> Iterator[tuple]:
    """(cell and part, vectors, targets, bit k set where metric k counts the row)."""
    cells = batch.select(["layer", "pool", "part"]).to_pandas()
    y = [batch.column(m).to_numpy(zero_copy_only=False).astype(np.float64) for m in metrics]
    masks = sum((~np.isnan(v)).astype(np.int64) << k for k, v in enumerate(y))
    for (layer, pool, part), index in cells.groupby(["layer", "pool", "part"]).indices.items():
        where = (int(layer), pool, part)
        x = _matrix(batch.column("vec").take(pa.array(index)), where)
        yield where, x, [v[index] for v in y], masks[index]


def _sums(x: np.ndarray, targets: list[np.ndarray], masks: np.ndarray, tile: int) -> Iterator[tuple]:
    """((mask, row, col), sums) of one part: heads per metric, tiles per set of metrics."""
    for k, values in enumerate(targets):
        counted = (masks >> k & 1).astype(bool)
        if counted.any():
            xs, y = x[counted], values[counted]
            head = [len(y), y.sum(), y @ y]
            yield (1 << k, HEAD, HEAD), np.concatenate([head, xs.sum(0), y @ xs])
    for mask in np.unique(masks[masks > 0]):
        xs = x[masks == mask]
        blocks = [xs[:, at:at + tile] for at in range(0, xs.shape[1], tile)]
        for i, left in enumerate(blocks):
            for j in range(i, len(blocks)):
                yield (int(mask), i, j), np.ravel(left.T @ blocks[j])


def _emit(store: dict[tuple, np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
    for key, sums in store.items():
        row = dict(zip(PARTIAL_KEYS, [[k] for k in (*key, salt)])) | {"sums": [sums]}
        yield pa.RecordBatch.from_pydict(row, schema=_ARROW)


def _plus(held: np.ndarray | None, sums: np.ndarray, key: tuple) -> np.ndarray:
    if held is None:
        return np.array(sums)
    if len(held) != len(sums):
        raise ValueError(f"vectors of unequal widths meet in {key}")
    held += sums
    return held


def _collect(metrics: list[str], tile: int, held_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Task p sends to one of √tasks groups, each of about 2√tasks tasks.
        salt = math.isqrt(TaskContext.get().partitionId())
        store: dict[tuple, np.ndarray] = {}
        held = 0
        for batch in batches:
            for piece in _slices(batch):
                for where, x, targets, masks in _parts(piece, metrics):
                    for place, sums in _sums(x, targets, masks, tile):
                        key = (*where, *place)
                        held += 0 if key in store else sums.nbytes
                        store[key] = _plus(store.get(key), sums, key)
                if held > held_bytes:
                    yield from _emit(store, salt)
                    store, held = {}, 0
        yield from _emit(store, salt)

    return run


def _merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of added sums per key; rows arrive sorted, so a task holds one tile at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, schema = None, None, None
        for batch in batches:
            schema, wide = batch.schema, batch.column("sums")
            for i, key in enumerate(zip(*[batch.column(k).to_pylist() for k in keys])):
                if current is not None and key != current:
                    yield pa.RecordBatch.from_pydict(
                        dict(zip(keys, [[k] for k in current])) | {"sums": [total]}, schema=schema
                    )
                    total = None
                current = key
                total = _plus(total, wide[i].values.to_numpy(zero_copy_only=False), key)
        if current is not None:
            yield pa.RecordBatch.from_pydict(
                dict(zip(keys, [[k] for k in current])) | {"sums": [total]}, schema=schema
            )

    lean = df.select(*keys, "sums")
    return lean.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, lean.schema)


def second_moments(
    rows: DataFrame, metrics: list[str], tile: int = TILE, held_bytes: int = HELD_BYTES
) -> DataFrame:
    """Sums per (layer, pool, metric, part) in rows (row, col, sums): a head and the upper tiles.

    rows: layer, pool, part, vec and one target column per metric, NULL where the row does not count
    for that metric. Vectors of one cell must have one width; NULL vectors count nowhere. Every row is
    multiplied once, whatever the number of metrics that count it.
    """
    lean = rows.where(F.col("vec").isNotNull()).select(
        "layer", "pool", "part", "vec", *[F.col(m).cast("double") for m in metrics]
    )
    partial = lean.mapInArrow(_collect(metrics, tile, held_bytes), PARTIAL_SCHEMA)
    counting = [F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, m) for k, m in enumerate(metrics)]
    each = _merged(partial, PARTIAL_KEYS).withColumn(
        "metric", F.explode(F.array_compact(F.array(*counting)))
    )
    return _merged(each, KEYS)


class Part:
    """The sums of one part of one cell, read from the rows of a group."""

    def __init__(self, rows: pd.DataFrame, tile: int) -> None:
        places = list(zip(rows["row"], rows["col"], rows["sums"]))
        head = next(np.asarray(s) for r, _, s in places if r == HEAD)
        d = (len(head) - 3) // 2
        self.n, self.sy, self.syy = int(head[0]), head[1], head[2]
        self.sx, self.sxy = head[3:3 + d], head[3 + d:]
        self.tiles = [
            (r * tile, c * tile, np.asarray(s).reshape(min(tile, d - r * tile), -1))
            for r, c, s in places if r != HEAD
        ]

    def square(self) -> np.ndarray:
        """Σxxᵀ with both halves."""
        full = np.empty((len(self.sx), len(self.sx)))
        for r, c, block in self.tiles:
            full[r:r + block.shape[0], c:c + block.shape[1]] = block
            full[c:c + block.shape[1], r:r + block.shape[0]] = block.T
        return full

    def form(self, v: np.ndarray) -> float:
        """vᵀ Σxxᵀ v, from the tiles."""
        total = 0.0
        for r, c, block in self.tiles:
            product = v[r:r + block.shape[0]] @ block @ v[c:c + block.shape[1]]
            total += product if r == c else 2 * product
        return total


def parts_of(group: pd.DataFrame, tile: int) -> dict[str, Part]:
    return {part: Part(rows, tile) for part, rows in group.groupby("part")}
