"""Hard-negative mining by angular triangle filtering.

Components become floor(256 * x), so scores are whole numbers. Rows are dealt to blocks by hash; the index of a
block is one row that stores, beside the vectors, every row's angles to a few reference directions of the block
(its rows, each taken as far from the earlier ones as possible). For an anchor and a row the differences and
sums of their angles to each reference bound the angle between them; its cosine interval times both norms,
widened by all rounding, bounds their score. Rows lie in groups by nearest reference and angle, whose angle
ranges give the same bounds for a whole group first. Only rows whose bounds reach a window are scored.

* Positives: a block's rows of the anchor's label whose upper bound reaches the k-th best lower bound among
  them are scored; the k best of all blocks are the positives.
* Negatives: for each positive the window of scores is known; rows of other labels whose bounds overlap it
  are scored, and the best of each window are kept.

Blocks hold BLOCK_BYTES each, whatever the width, and anchors come in blocks too: every anchor meets every row
(a stated query set against all rows), at most k rows an anchor, positive and block are merged. Labels take no part in the
dealing, so a label that a third of the rows share is spread like any other. Every answer is exact.

Defined cases: rows with a null vec_id or label, a vector that is null, empty or holds null or non-finite components take no
part; rows of one vec_id count once, with the smallest (vector, label); a row meets rows of its own number of
components; zero vectors score 0; an anchor without another row of its label has no positive and gives no
row; fewer rows than asked for: all of them; scores must fit 64 bits, larger ones raise OverflowError; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrospect.session import staged

SCALE = 256
LABELS = 10
REFERENCES = 12
GROUP = 128
BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 6
ANCHOR_BLOCK = 4_000
SIDE_BY_SIDE = 64
EXACT = 2.0**53


def members(table: DataFrame, scale: int = SCALE, shifted_every: int = 7) -> DataFrame:
    """vec_id, label and v, the floors of the scaled components, of all rows that take part; where vec_id divides
    by shifted_every the label is the next one."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    rows = table.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite))
    label = F.when(F.col("vec_id") % shifted_every == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    alike = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(v.alias("v"), label.cast("long").alias("label")).alias("row"))
    return alike.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v")


def fits_doubles(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all partial sums of the products of whole numbers stay exact in doubles."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0.0))
    return most(a) * most(b) * a.shape[1] < EXACT


def products(a: np.ndarray, b: np.ndarray, fits: bool) -> np.ndarray:
    """Inner products of whole numbers: by doubles where they fit, by Python's integers beyond."""
    if fits:
        return a.astype(np.float64) @ b.astype(np.float64).T
    found = a.astype(object) @ b.astype(object).T
    if found.size and max(found.max(), -found.min()) >= 2**63:
        raise OverflowError("a score does not fit 64 bits")
    return found


def angles_to(x: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to unit directions; a zero vector has none, and any will do, as its scores are 0."""
    cosines = (x.astype(np.float64) @ references.T) / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def angle_error(dim: int) -> float:
    """How far a computed angle can be off: product, norms and direction put a cosine off by less than
    (2 dim + 16) units of rounding, and an angle is off by most where the cosine is 1."""
    return float(np.arccos(1.0 - (2 * dim + 16) * 2.0**-52))


def reference_directions(x: np.ndarray, norms: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of rows: the first with a direction, then each time the one that is farthest from those taken."""
    rows = np.flatnonzero(norms > 0)
    if not len(rows):
        return np.eye(1, x.shape[1])
    unit = x[rows].astype(np.float64) / norms[rows, None]
    taken = [0]
    nearest = unit @ unit[0]
    while len(taken) < min(count, len(rows)):
        taken.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[taken[-1]])
    return unit[taken]


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


class Block:
    """The rows of one block in groups, with what bounds their scores."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, references: np.ndarray, angles: np.ndarray):
        self.ids, self.labels, self.v, self.references, self.angles = ids, labels, v, references, angles
        self.norms = lengths(v)
        self.error = 2 * angle_error(v.shape[1]) + 1e-12
        begins = np.arange(0, len(ids), GROUP)
        self.group = np.arange(len(ids)) // GROUP
        self.low, self.high = np.minimum.reduceat(angles, begins), np.maximum.reduceat(angles, begins)
        self.short, self.long = np.minimum.reduceat(self.norms, begins), np.maximum.reduceat(self.norms, begins)

    def bounds(self, norms: np.ndarray, angles: np.ndarray, low: np.ndarray, high: np.ndarray, short: np.ndarray, long: np.ndarray):
        """Least and largest score of each anchor with rows whose angles and norms lie in ranges."""
        apart = np.zeros((len(norms), len(low)))
        within = np.full(apart.shape, np.pi)
        for r in range(len(self.references)):
            own = angles[:, r, None]
            np.maximum(apart, np.maximum(low[:, r] - own, own - high[:, r]), out=apart)
            np.minimum(within, np.minimum(own + high[:, r], 2 * np.pi - own - low[:, r]), out=within)
        most, least = np.cos(apart), np.cos(np.maximum(within, apart))
        slack = norms[:, None] * long * self.error + 1.0
        upper = norms[:, None] * np.where(most >= 0, most * long, most * short) + slack
        lower = norms[:, None] * np.where(least >= 0, least * short, least * long) - slack
        return lower, upper

    def group_bounds(self, norms: np.ndarray, angles: np.ndarray):
        return self.bounds(norms, angles, self.low, self.high, self.short, self.long)

    def row_bounds(self, norms: np.ndarray, angles: np.ndarray, rows: np.ndarray):
        own, length = self.angles[rows], self.norms[rows]
        return self.bounds(norms, angles, own, own, length, length)

    def rows_of(self, groups: np.ndarray) -> np.ndarray:
        """Positions of the rows of the chosen groups (a mask)."""
        return np.flatnonzero(groups[self.group])

    def scores(self, asked: np.ndarray, rows: np.ndarray, wanted: np.ndarray, fits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions among asked, positions of rows, and scores of the wanted pairs."""
        used = wanted.any(axis=0)
        rows, wanted = rows[used], wanted[:, used]
        at, to = np.nonzero(wanted)
        return at, rows[to], products(asked, self.v[rows], fits)[at, to]


def built(part: pd.DataFrame) -> pd.DataFrame:
    """The index row of a block."""
    v = np.stack(part["v"].to_list()).astype(np.int64)
    ids = part["vec_id"].to_numpy(np.int64)
    start = np.argsort(ids)
    v, ids, labels = v[start], ids[start], part["label"].to_numpy(np.int64)[start]
    norms = lengths(v)
    references = reference_directions(v, norms, REFERENCES)
    angles = angles_to(v, norms, references)
    order = np.lexsort((angles.min(axis=1), angles.argmin(axis=1)))
    return pd.DataFrame({
        "dim": [v.shape[1]], "block": [int(part["block"].iloc[0])], "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()],
        "vectors": [v[order].tobytes()], "refs": [references.tobytes()], "angles": [angles[order].tobytes()]})


INDEX = "dim int, block int, ids binary, labels binary, vectors binary, refs binary, angles binary"


def opened(row: pd.Series) -> Block:
    ids = np.frombuffer(row["ids"], np.int64)
    return Block(
        ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(len(ids), -1),
        np.frombuffer(row["refs"], np.float64).reshape(-1, row["dim"]), np.frombuffer(row["angles"], np.float64).reshape(len(ids), -1))


def best_of(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k best, by score, then smaller id."""
    order = sorted(range(len(ids)), key=lambda i: (owner[i], -scores[i], ids[i])) if scores.dtype == object else np.lexsort((ids, -scores, owner))
    order = np.asarray(order, np.int64)
    first = np.searchsorted(owner[order], owner[order], side="left")
    return order[np.arange(len(order)) - first < k]


def nearest_alike(block: Block, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """(anchor, row, score) of the k best other rows of each anchor's label in a block."""
    norms, fits = lengths(v), fits_doubles(v, block.v)
    angles = angles_to(v, norms, block.references)
    out = []
    for part in range(0, len(ids), SIDE_BY_SIDE):
        some = slice(part, part + SIDE_BY_SIDE)
        alike = (block.labels == labels[some, None]) & (block.ids != ids[some, None])
        alike_in_group = np.add.reduceat(alike.astype(np.int64), np.arange(0, len(block.ids), GROUP), axis=1)
        lower, upper = block.group_bounds(norms[some], angles[some])
        # The k-th best lower bound, each group counting as often as it has rows of the label.
        order = np.argsort(-lower, axis=1)
        enough = np.cumsum(np.take_along_axis(alike_in_group, order, 1), axis=1) >= k
        at = enough.argmax(axis=1)[:, None]
        least = np.where(enough[:, -1:], np.take_along_axis(np.take_along_axis(lower, order, 1), at, 1), -np.inf)
        rows = block.rows_of(((upper >= least) & (alike_in_group > 0)).any(axis=0))
        lower, upper = block.row_bounds(norms[some], angles[some], rows)
        alike = alike[:, rows]
        if len(rows) > k:
            least = np.maximum(least, -np.partition(np.where(alike, -lower, np.inf), k - 1, axis=1)[:, k - 1:k])
        anchor, row, score = block.scores(v[some], rows, alike & (upper >= least), fits)
        keep = best_of(anchor, block.ids[row], score, k)
        out.append((ids[some][anchor[keep]], block.ids[row[keep]], score[keep]))
    return out


def within_windows(
    block: Block, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, owner: np.ndarray, windows: list[tuple[int, int]], k: int,
) -> list[tuple[np.ndarray, ...]]:
    """(window, row, score) of the k best rows of other labels in each window of scores; owner: the windows'
    anchors' positions, ascending."""
    norms, fits = lengths(v), fits_doubles(v, block.v)
    angles = angles_to(v, norms, block.references)
    lows, highs = (np.array([w[side] for w in windows], object) for side in (0, 1))
    # As doubles they are off by less than half of the bounds' slack or, beyond 2^53, by a share far below it.
    low, high = lows.astype(np.float64), highs.astype(np.float64)
    exact = (lambda x: x.astype(np.float64)) if fits else (lambda x: x)
    out = []
    for part in range(0, len(ids), SIDE_BY_SIDE):
        some = slice(part, part + SIDE_BY_SIDE)
        mine = np.arange(np.searchsorted(owner, part), np.searchsorted(owner, part + SIDE_BY_SIDE))
        of = owner[mine] - part
        lower, upper = block.group_bounds(norms[some], angles[some])
        meets = (upper[of] >= low[mine, None]) & (lower[of] <= high[mine, None])
        rows = block.rows_of(meets.any(axis=0))
        lower, upper = block.row_bounds(norms[some], angles[some], rows)
        wanted = np.zeros(lower.shape, bool)
        for window, anchor in zip(mine, of):
            wanted[anchor] |= (upper[anchor] >= low[window]) & (lower[anchor] <= high[window])
        wanted &= block.labels[rows] != labels[some, None]
        anchor, row, score = block.scores(v[some], rows, wanted, fits)
        starts = np.searchsorted(anchor, np.arange(len(ids[some]) + 1))
        for window, own in zip(mine, of):
            found = slice(starts[own], starts[own + 1])
            inside = np.flatnonzero((score[found] >= exact(lows[window:window + 1])) & (score[found] <= exact(highs[window:window + 1])))
            if len(inside):
                of_row, of_score = block.ids[row[found][inside]], score[found][inside]
                keep = best_of(np.zeros(len(inside), np.int64), of_row, of_score, k)
                out.append((np.full(len(keep), window), of_row[keep], of_score[keep]))
    return out


def dealt(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def frame(columns: dict[str, list[np.ndarray]]) -> pd.DataFrame:
    whole = {name: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64) for name, parts in columns.items()}
    return pd.DataFrame(whole)


def mine(
    table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90,
    scale: int = SCALE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (vec_id divides
    by every) and each of its positives the best rows of other labels whose score lies between both shares of
    the positive's."""
    rows = staged(members(table, scale).withColumn("dim", F.size("v")), "negatives-rows")
    is_anchor = F.col("vec_id") % every == 0
    sizes = rows.agg(F.sum(8 * (F.col("dim") + REFERENCES + 4)).alias("bytes"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    blocks = max(LEAST_BLOCKS, -(-(sizes["bytes"] or 0) // block_bytes))
    anchor_blocks = max(1, -(-sizes["anchors"] // ANCHOR_BLOCK))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.withColumn("block", dealt("vec_id", blocks)).groupBy("dim", "block").applyInPandas(built, INDEX)
    index = staged(index, "negatives-index").withColumn("of_anchors", all_of(anchor_blocks))
    anchors = rows.where(is_anchor).withColumn("of_anchors", dealt("vec_id", anchor_blocks))
    keys = ["dim", "block", "of_anchors"]

    def find_positives(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(held):
            found = nearest_alike(
                opened(held.iloc[0]), asked["vec_id"].to_numpy(np.int64), asked["label"].to_numpy(np.int64),
                np.stack(asked["v"].to_list()).astype(np.int64), positives)
        return frame({"anchor_id": [f[0] for f in found], "positive_id": [f[1] for f in found], "positive_score": [f[2] for f in found]})

    met = anchors.withColumn("block", all_of(blocks)).groupBy(*keys).cogroup(index.groupBy(*keys))
    near = met.applyInPandas(find_positives, "anchor_id long, positive_id long, positive_score long")
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = near.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives)
    sides = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asking = staged(
        anchors.join(sides, F.col("vec_id") == F.col("anchor_id")).select(
            "vec_id", "label", "v", "dim", "of_anchors", "positives.positive_id", "positives.positive_score"),
        "negatives-anchors")

    def find_negatives(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found, pairs = [], []
        if len(asked) and len(held):
            both = enumerate(zip(asked["positive_id"], asked["positive_score"]))
            pairs = [(i, positive, score) for i, (some, scores) in both for positive, score in zip(some, scores)]
            windows = [(-(-low_percent * int(p[2]) // 100), high_percent * int(p[2]) // 100) for p in pairs]
            found = within_windows(
                opened(held.iloc[0]), asked["vec_id"].to_numpy(np.int64), asked["label"].to_numpy(np.int64),
                np.stack(asked["v"].to_list()).astype(np.int64), np.array([p[0] for p in pairs]), windows, negatives)
        ids = asked["vec_id"].to_numpy()
        return frame({
            "anchor_id": [ids[[pairs[w][0] for w in f[0]]] for f in found],
            "positive_id": [np.array([pairs[w][1] for w in f[0]]) for f in found],
            "negative_id": [f[1] for f in found],
            "positive_score": [np.array([pairs[w][2] for w in f[0]]) for f in found], "negative_score": [f[2] for f in found]})

    met = asking.withColumn("block", all_of(blocks)).groupBy(*keys).cogroup(index.groupBy(*keys))
    partial = met.applyInPandas(
        find_negatives, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
