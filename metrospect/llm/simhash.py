"""SimHash near-dedup: fingerprints, a binary trie self-join, and connected components.

Shingles are four words (ASCII letters in lower case; fewer words: the whole sequence). A fingerprint bit
is set if it is set in over half of the shingles' XXH64 values. Equal fingerprints collapse first. Two
fingerprints within BUDGET bits agree in at least one of BUDGET + 1 blocks of bits, so each goes to one
group per block. Within a group the sorted fingerprints are a binary trie; pairs of its nodes are walked
together, the bits in which they differ are added up, and a pair beyond the budget is dropped with all
below it. A group reports a spanning forest, not all pairs: a pair of nodes that is already joined as a
whole is skipped. A group above GROUP fingerprints is divided again by blocks of its other bits, which
loses no pair by the same argument. The forests are joined to components by star contraction.

The pipeline's stage (first_of_each) asks for a Jaccard similarity of 0.8 on sets of five-word shingles. Its
fingerprints are joined in the same way, by blocks and trie, and the links checked by shared shingles, exactly. Texts of
that similarity differ in about ten bits, which blocks cannot route; so a second join, of WIDE bits, takes
groups of a common MinHash band instead of blocks, again with the exact check behind it. Both joins' links
go through star contraction.

Defined cases: null and empty texts have fingerprint zero, linked like any other; null ids never are a
component's id unless all its ids are null; repeated rows all come out; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrospect.session import staged

BUDGET = 4
SHINGLE = 4
SEED = 42
GROUP = 1 << 20
LEAF = 64
# The pipeline's stage: shingles of five words; 24 bands of 5 MinHash values bring a pair of similarity 0.8
# together but for 7 of 100,000.
STAGE_SHINGLE = 5
# Of 64 bits, sets of similarity 0.8 differ in 9.7 on average (large sets) and in 12 at most (four of five shingles):
# in more than WIDE in fewer than 2 of 100,000 cases. Sets that share nothing differ in 32; 8 of 100 pairs pass.
WIDE = 26
BANDS, BAND = 24, 5
FACTORS = np.random.default_rng(SEED).integers(1 << 63, size=BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROUNDS = 3
STAR = 1000
TILE, TILE_BYTES, COLUMNS = 512, 8 << 20, 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return majority(np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number; zero for none."""
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 14):
        some = hashes[part:part + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed longs of the same bits."""
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def as_hex(column):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def masks(of: int, parts: int) -> list[int]:
    """The set bits of `of`, dealt to `parts` masks of neighbouring bits."""
    bits = [bit for bit in range(64) if of >> bit & 1]
    return [sum(1 << int(bit) for bit in some) for some in np.array_split(bits, parts)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def blocks(budget: int, within: int = 0) -> list[int]:
    """Masks of which at least one covers equal bits, for any two values that agree in `within`."""
    return [within | mask for mask in masks(~within & (1 << 64) - 1, budget + 1)]


def routed(distinct: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """fp with each key (mask, value) whose group it joins."""
    first = blocks(budget)
    key = lambda mask: F.struct(F.lit(signed(mask)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("value"))
    keyed = distinct.select("fp", F.explode(F.array(*map(key, first))).alias("key")).select("fp", "key.mask", "key.value")
    large = keyed.groupBy("mask", "value").count().where(F.col("count") > group).drop("count")
    divided = F.array(F.struct(F.col("mask"), F.col("value")))
    for mask in first:
        finer = F.array(*map(key, blocks(budget, mask)))
        divided = F.when(F.col("large") & (F.col("mask") == signed(mask)), finer).otherwise(divided)
    return (
        keyed.join(large.withColumn("large", F.lit(True)), ["mask", "value"], "left")
        .withColumn("large", F.coalesce("large", F.lit(False)))
        .select("fp", F.explode(divided).alias("key")).select("fp", "key.mask", "key.value")
    )


class Forest:
    """Union-find over the positions of an array."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while (up := self.parent[root]).tolist() != root.tolist():
            root = up
        self.parent[at] = root
        return root

    def root(self, at: int) -> int:
        while self.parent[at] != at:
            self.parent[at] = self.parent[self.parent[at]]
            at = int(self.parent[at])
        return at

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def near_nodes(values: np.ndarray, budget: int, joined: Callable[[int, int, int, int], bool]) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of small nodes (lo, hi, lo2, hi2) whose values may be within the budget, walking the trie against itself.

    The trie is the sorted array: a node is a range whose values share the bits above `bit`. A pair of large nodes
    for which joined() holds is skipped with all below it.
    """
    pairs = [(0, len(values), 0, len(values), 63, 0)]
    while pairs:
        lo, hi, lo2, hi2, bit, differing = pairs.pop()
        if lo == hi or lo2 == hi2:
            continue
        if hi - lo <= LEAF and hi2 - lo2 <= LEAF or bit < 0:
            yield lo, hi, lo2, hi2
            continue
        if hi - lo > LEAF and hi2 - lo2 > LEAF and differing == 0 and lo != lo2 and joined(lo, hi, lo2, hi2):
            continue
        one = np.uint64(1 << bit)
        cut = lo + int(np.searchsorted((values[lo:hi] & one) != 0, True))
        cut2 = cut if lo2 == lo else lo2 + int(np.searchsorted((values[lo2:hi2] & one) != 0, True))
        if differing < budget:
            pairs.append((lo, cut, cut2, hi2, bit - 1, differing + 1))
            if lo != lo2:
                pairs.append((cut, hi, lo2, cut2, bit - 1, differing + 1))
        pairs.append((cut, hi, cut2, hi2, bit - 1, differing))
        pairs.append((lo, cut, lo2, cut2, bit - 1, differing))


def trie_forest(values: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the budget, a spanning forest of all such pairs; values are distinct."""
    values = np.sort(values.view(np.uint64))
    forest = Forest(len(values))
    found = [np.empty((0, 2), np.int64)]

    def joined(lo: int, hi: int, lo2: int, hi2: int) -> bool:
        a, b = forest.roots(np.arange(lo, hi)), forest.roots(np.arange(lo2, hi2))
        return a[0] == b[0] and (a == a[0]).all() and (b == b[0]).all()

    for lo, hi, lo2, hi2 in near_nodes(values, budget, joined):
        a, b = forest.roots(np.arange(lo, hi)), forest.roots(np.arange(lo2, hi2))
        if a[0] == b[0] and (a == a[0]).all() and (b == b[0]).all():
            continue
        near = np.bitwise_count(values[lo:hi, None] ^ values[None, lo2:hi2]) <= budget
        i, j = np.nonzero(near & (a[:, None] != b[None, :]))
        for (x, y), pair in {(x, y): pair for x, y, *pair in zip(a[i].tolist(), b[j].tolist(), i + lo, j + lo2)}.items():
            if forest.root(x) != forest.root(y):
                forest.join(x, y)
                found.append(np.array([pair], np.int64))
    one, two = np.concatenate(found).T
    return values[one].view(np.int64), values[two].view(np.int64)


def near_pairs(values: np.ndarray, budget: int) -> np.ndarray:
    """Whether each two of some values are within the budget, by the same walk."""
    order = np.argsort(values)
    values = values[order]
    near = np.zeros((len(values), len(values)), bool)
    for lo, hi, lo2, hi2 in near_nodes(values, budget, lambda *_: False):
        near[lo:hi, lo2:hi2] = np.bitwise_count(values[lo:hi, None] ^ values[None, lo2:hi2]) <= budget
    out = np.zeros_like(near)
    out[np.ix_(order, order)] = near | near.T
    return out


def links(distinct: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within the budget of each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            if batch.empty:
                continue
            keys = batch[["mask", "value"]].to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *edges.tolist(), len(batch)]
            out = []
            for lo, hi in zip(bounds, bounds[1:]):
                key = tuple(keys[lo])
                if key != last:
                    out.append(solve(held))
                    held, last = [], key
                held.append(batch["fp"].to_numpy()[lo:hi])
            yield frame(out)
        yield frame([solve(held)])

    def solve(held) -> tuple[np.ndarray, np.ndarray]:
        if sum(map(len, held)) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return trie_forest(np.concatenate(held), budget)

    def frame(found) -> pd.DataFrame:
        return pd.DataFrame({"a": np.concatenate([a for a, _ in found] or [np.empty(0, np.int64)]),
                             "b": np.concatenate([b for _, b in found] or [np.empty(0, np.int64)])})

    grouped = routed(distinct, budget, group).repartition("mask", "value").sortWithinPartitions("mask", "value")
    return grouped.mapInPandas(run, "a long, b long")


def components(edges: DataFrame, label: str = "simhash") -> DataFrame:
    """node, root (the smallest node reachable) for every node of the links (a, b).

    Star contraction: every node's larger neighbours are linked to its smallest one, then its smaller
    ones; repeated until nothing changes. Each round is written to the shared folder.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = staged(small.where("a <> b").distinct(), f"{label}-round")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def grouped(prints: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """Rows (doc_id, fp) with component_id, the smallest doc_id reachable over links.

    prints should be staged, as it is read more than once.
    """
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), budget, group))
    owned = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    owned = staged(owned, "simhash-owned")
    ids = owned.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(owned.join(ids, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row."""
    prints = staged(docs.select("doc_id", fingerprints(F.col("text").cast("string")).alias("fp")), "simhash-prints")
    return grouped(prints).select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles, in order; none for a text without words."""
    words = (text or "").encode().lower().split()
    last = max(len(words) - shingle, 0) + 1 if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), SEED) for i in range(last)], np.uint64))


def min_hashes(hashes: np.ndarray, count: int) -> np.ndarray:
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(hashes), 1 << 12):
        mixed = FACTORS[:count, None] * hashes[part:part + (1 << 12)][None, :]
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of MinHash values; two sets share one with probability similarity ** BAND."""
    bands = min_hashes(hashes, BANDS * BAND).reshape(BANDS, BAND)
    return [signed(xxhash.xxh64_intdigest(band.tobytes(), at)) for at, band in enumerate(bands)]


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("id", "n", "fp")]).add("bands", T.ArrayType(T.LongType())))
def sketches(texts: pd.Series) -> pd.DataFrame:
    """The identity of each text's shingle set, its size, its fingerprint and its band keys."""
    out = []
    for text in texts:
        hashes = shingle_set(text)
        bands = band_keys(hashes) if len(hashes) else []
        out.append((signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)), len(hashes), signed(majority(hashes)), bands))
    return pd.DataFrame(out, columns=["id", "n", "fp", "bands"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(text).view(np.int64) for text in texts])


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements the sets at each two different positions of left and right share, exactly.

    Elements of one set only are dropped; the others are columns of a matrix of zeros and ones, whose product with
    itself is summed COLUMNS at a time.
    """
    owner = np.repeat(np.arange(len(sets)), [len(some) for some in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    number = np.full(len(times), -1)
    number[common] = np.arange(len(common))
    column = number[column.ravel()]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)))
    for start in range(0, len(common), COLUMNS):
        some = slice(*np.searchsorted(column, [start, start + COLUMNS]))
        member = np.zeros((len(sets), min(COLUMNS, len(common) - start)), np.float32)
        member[owner[some], column[some] - start] = 1.0
        out += member[left] @ member[right].T
    return out


def similar_within(group: DataFrame, sets: DataFrame, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Links (a, b) of similarity 0.8 or more within the groups of the rows (key, id, n, root) of different roots: of
    the pairs that the trie finds within WIDE bits, those whose shared shingles, counted exactly, are enough.

    A group above `tile` rows or tile_bytes of sets is cut into tiles, and each two tiles meet in their own place.
    Of the links of a place only a spanning forest leaves it, so their number follows the number of sets.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            if batch.empty:
                continue
            keys = batch[["key", "low", "high"]].to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *edges.tolist(), len(batch)]
            for lo, hi in zip(bounds, bounds[1:]):
                if held and tuple(keys[lo]) != last:
                    yield solve(pd.concat(held))
                    held = []
                last = tuple(keys[lo])
                held.append(batch.iloc[lo:hi])
        if held:
            yield solve(pd.concat(held))

    def solve(some: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, roots, tiles = (some[name].to_numpy() for name in ("id", "n", "root", "tile"))
        left, right = np.flatnonzero(tiles == some["low"].iloc[0]), np.flatnonzero(tiles == some["high"].iloc[0])
        found = []
        sets = [np.asarray(h) for h in some["hashes"]]
        near = near_pairs(np.array([majority(h.view(np.uint64)) for h in sets], np.uint64), WIDE)[np.ix_(left, right)]
        near &= roots[left][:, None] != roots[right][None, :]
        left, right, near = left[near.any(axis=1)], right[near.any(axis=0)], near[near.any(axis=1)][:, near.any(axis=0)]
        if len(left) and len(right):
            both = shared_counts(sets, left, right)
            alike = near & (5 * both >= 4 * (sizes[left][:, None] + sizes[right][None, :] - both))
            above = list(range(len(ids)))

            def top(i: int) -> int:
                while above[i] != i:
                    above[i] = i = above[above[i]]
                return i

            for i, j in zip(*(side[at] for side, at in zip((left, right), np.nonzero(alike)))):
                a, b = top(i), top(j)
                if a != b:
                    above[a] = b
                    found.append(sorted((int(ids[i]), int(ids[j]))))
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    parts = group.groupBy("key").agg(
        F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") * 8 / tile_bytes)).alias("parts"))
    dealt = group.join(parts, "key").join(sets, "id").withColumn("tile", F.pmod(F.xxhash64("id"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "id", "n", "root", "hashes")
    spots = ("key", "low", "high")
    return dealt.repartition(*spots).sortWithinPartitions(*spots).mapInPandas(run, "a long, b long").distinct()


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of 0.8 or more, counted exactly.

    A set that many pairs start from is repeated, so that its pairs are dealt to several tasks.
    """
    many = pairs.groupBy("a").agg((F.floor(F.count("*") / STAR) + 1).alias("salts"))
    pairs = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts"))
    ones = many.join(sets, many["a"] == sets["id"]).select(
        "a", "hashes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    others = sets.select(F.col("id").alias("b"), F.col("hashes").alias("others"))
    both = F.size(F.array_intersect("hashes", "others"))
    met = pairs.select("a", "b", "salt").join(others, "b").join(ones, ["a", "salt"])
    return met.where(5 * both >= 4 * (F.size("hashes") + F.size("others") - both)).select("a", "b")


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the shingle sets (id, n, fp): a spanning forest of those with fingerprints within BUDGET bits."""
    worded = distinct.where("n > 0").select("id", "fp")
    prints = staged(worded.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-prints")
    copies = worded.join(prints, "fp").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    one, two = (prints.select(F.col("fp").alias(at), F.col("rep").alias(f"rep_{at}")) for at in "ab")
    near = links(prints.select("fp")).join(one, "a").join(two, "b")
    return near.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).unionByName(copies).distinct()


def similar_roots(distinct: DataFrame, rows: DataFrame) -> DataFrame:
    """node, root of the shingle sets (id, n, fp, bands, least) joined by a similarity of 0.8 or more.

    The pairs that blocks and trie find within BUDGET bits are checked first. Then sets that share a band key form a
    group. In each of ROUNDS rounds, the least set of every group meets those of the group's others that are within WIDE
    bits of it, and leaves; groups whose sets are linked to one set by then are done. What is left meets by trie in
    similar_within. Components are found once, from all links.
    """
    group = distinct.select("id", "n", "fp", F.explode("bands").alias("key"))
    shared = group.groupBy("key").count().where("count > 1").select("key")
    group = staged(group.join(shared, "key"), "simhash-groups")
    pairs = staged(fingerprint_pairs(distinct), "simhash-near")
    met = group.select("id").union(pairs.select("a")).union(pairs.select("b")).distinct()
    reps = distinct.join(met, "id", "left_semi").select("id", F.col("least.at").alias("at"))
    texts = rows.select("at", F.col("row.text").cast("string").alias("text"))
    sets = staged(texts.join(reps, "at").select("id", shingle_sets("text").alias("hashes")), "simhash-sets")
    edges = staged(similar(pairs, sets), "simhash-similar")
    for step in range(ROUNDS + 1):
        # The least set that one is linked to: equal roots are one component, which is all that rounds need.
        known = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
        group = group.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = group.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        group = staged(group.join(mixed.select("key"), "key", "left_semi").select("id", "n", "fp", "key", "root"), "simhash-left")
        if group.isEmpty():
            break
        if step < ROUNDS:
            first = staged(group.groupBy("key").agg(F.min(F.struct("id", "n", "fp", "root")).alias("first")), "simhash-first")
            ones = first.select("key", F.col("first.id").alias("a"), *(F.col(f"first.{c}").alias(f"{c}_a") for c in ("n", "fp", "root")))
            met = group.join(ones, "key").where((F.col("a") < F.col("id")) & (F.col("root") != F.col("root_a")))
            met = met.where(5 * F.least("n", "n_a") >= 4 * F.greatest("n", "n_a"))
            met = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_a"))) <= WIDE)
            found = similar(staged(met.select("a", F.col("id").alias("b")).distinct(), "simhash-pairs"), sets)
            group = group.join(ones.select("key", "a"), "key").where("id <> a").drop("a", "root")
        else:
            found = similar_within(group, sets)
        edges = edges.unionByName(staged(found, "simhash-similar"))
    return components(edges)


def first_of_each(docs: DataFrame) -> DataFrame:
    """One whole row of each component of similar texts: that of the smallest doc_id (nulls last), then the
    first read.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; all
    texts without words are linked. Candidates come from the trie joins of SimHash fingerprints (see
    similar_roots). Rows get a number in a staged copy; numbers, ids, fingerprints, band keys and the sets of
    candidates are joined, and the winners' numbers, one per component, are joined back.
    """
    row = docs.select(F.struct("*").alias("row"))
    rows = staged(row.select(
        F.monotonically_increasing_id().alias("at"), sketches(F.col("row.text").cast("string")).alias("sketch"), "row"),
        "simhash-rows")
    prints = rows.select("at", F.col("row.doc_id").alias("doc_id"), "sketch.*")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at"))
    distinct = staged(prints.groupBy("id").agg(
        least.alias("least"), *(F.any_value(c).alias(c) for c in ("n", "fp", "bands"))), "simhash-distinct")
    roots = similar_roots(distinct, rows)
    owned = distinct.join(roots, distinct["id"] == roots["node"], "left").select(F.coalesce("root", "id").alias("root"), "least")
    winners = owned.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.at").alias("at"))
    return rows.join(winners, "at", "left_semi").select("row.*")
