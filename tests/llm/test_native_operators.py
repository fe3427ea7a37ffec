"""Sharding and mixing: laws, hot groups, edge rows."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from metrospect.llm import mixing, sharding
from metrospect.llm import queries as llm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, target string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "a", "b") for i, t, s in rows], SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def check_shards(rows, placed, shards):
    assert len(placed) == len(rows)
    slots = defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in placed) == want
    loads = Counter()
    for r in placed:
        loads[r.shard] += r.size
    return loads


def test_shards_are_even_and_keep_equal_texts(spark):
    rows = [(i, f"text {i % 700} " * (i % 13), "s") for i in range(3000)] + [(None, None, None), (7, "é" * 50, "s"), (7, "é" * 50, "s")]
    placed = sharding.shard(docs(spark, rows), 4).collect()
    loads = check_shards(rows, placed, 4)
    assert max(loads.values()) < 1.05 * min(loads.values())
    homes = defaultdict(set)
    for r in placed:
        homes[r.text_crc32].add(r.shard)
    assert max(map(len, homes.values())) == 1


def test_a_group_above_a_shard_is_divided(spark):
    rows = [(i, "the same text", "s") for i in range(900)] + [(i, f"other {i}", "s") for i in range(900, 1500)]
    loads = check_shards(rows, placed := sharding.shard(docs(spark, rows), 8).collect(), 8)
    assert len(placed) == 1500 and max(loads.values()) < 1.05 * min(loads.values())


def test_empty_table_and_no_python(spark):
    assert sharding.shard(docs(spark, []), 8).count() == 0
    text = plan(sharding.shard(docs(spark, [(1, "a", "s")]), 8))
    assert "Python" not in text and "Arrow" not in text


def test_growing_moves_slots_into_the_new_shard_only(spark, tmp_path):
    rows = docs(spark, [(i, f"text {i}" * (i % 5), "s") for i in range(2000)])
    units = sharding.with_pieces(sharding.records(rows), 4)
    first = sharding.slot_map(sharding.unit_sizes(units), 4)
    path = str(tmp_path / "map")
    sharding.save_map(first, path)
    sharding.save_map(sharding.grown(sharding.load_map(spark, path), 4), path)
    old = {(r.vslot, r.piece): r for r in sharding.load_map(spark, path, 0).collect()}
    new = {(r.vslot, r.piece): r for r in sharding.load_map(spark, path).collect()}
    assert old.keys() == new.keys() and {r.version for r in new.values()} == {1}
    assert all(new[k].shard in (old[k].shard, 4) for k in old)
    loads = Counter()
    for r in new.values():
        loads[r.shard] += r.bytes
    assert set(loads) == {0, 1, 2, 3, 4} and max(loads.values()) < 1.1 * min(loads.values())


def filled(sizes, weights, most=3):
    """Targets by repeated resharing."""
    total, full = sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        open_ = [s for s in sizes if s not in full]
        share = {s: rest * weights[s] / sum(weights[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] >= most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("words", [{"a": 10, "b": 500, "c": 40, None: 7}, {"a": 3, "b": 3}, {"a": 1000, "b": 1, "é": 1, "z": 1}])
def test_targets_and_taken(spark, words):
    rows, i = [], 0
    for source, n in words.items():
        while n:
            size = min(n, 1 + i % 7)
            rows.append((i, " ".join(["w"] * size) + " \n", source))
            n, i = n - size, i + 1
    mixed = mixing.mix(docs(spark, rows)).collect()
    names = sorted((s for s in words if s is not None)) + [None] * (None in words)
    want = filled({s: words[s] for s in names}, {s: k % 3 + 1 for k, s in enumerate(names)})
    taken = Counter()
    for r in mixed:
        assert r.source_size == words[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(u.words for u in r.uses)
        assert all(0 <= u.position <= 1 for u in r.uses)
        taken[r.source] += r.taken
    assert len(mixed) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)


def test_equal_rows_null_texts_and_reruns(spark):
    rows = [(1, "a b c", "x")] * 40 + [(None, None, None), (2, "", "x"), (3, "d e", None), (3, "d e", None)]
    table = docs(spark, rows)
    once = sorted(map(str, mixing.mix(table).collect()))
    assert len(once) == len(rows) and once == sorted(map(str, mixing.mix(table.repartition(5)).collect()))
    assert mixing.mix(docs(spark, [])).count() == 0
    text = plan(mixing.mix(table))
    assert "Python" not in text and "Arrow" not in text


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(400)]
    knots = "array(named_struct('at', 0D, 'height', {0}), named_struct('at', 0.5D, 'height', {1}), named_struct('at', 1D, 'height', {2}))"
    schedules = spark.sql(f"SELECT 'a' source, {knots.format('2D', '0D', '0D')} knots UNION ALL SELECT 'b', {knots.format('1D', '1D', '1D')}")
    order = mixing.training_order(mixing.mix(docs(spark, rows), schedules))
    positions = defaultdict(list)
    for r in order.collect():
        positions[r.source].append(r.position)
    assert max(positions["a"]) <= 0.5
    near_quarter = sum(p < 0.25 for p in positions["a"]) / len(positions["a"])
    assert near_quarter == pytest.approx(0.75, abs=0.02)
    assert sum(p < 0.25 for p in positions["b"]) / len(positions["b"]) == pytest.approx(0.25, abs=0.02)


def test_mixed_rows_keep_columns_and_whole_texts(spark):
    rows = [(i, f"doc {i} " + "w  x\n" * (i % 9), "abc"[i % 3]) for i in range(90)] + [(500, "one " * 400, "b"), (501, "", "c"), (502, None, None)]
    table = docs(spark, rows)
    out = mixing.mixed_rows(table)
    assert out.columns == table.columns
    texts = {i: t for i, t, _ in rows}
    got = Counter()
    for r in out.collect():
        assert r.text == texts[r.doc_id]
        got[r.doc_id] += 1
    for r in mixing.mix(table).collect():
        assert got[r.doc_id] == sum(2 * u.words >= r.size for u in r.uses)


def test_sources_without_words(spark):
    for rows in ([(1, "a b c", "s"), (2, None, None), (3, "", "t"), (4, " \n", "t")], [(1, "", "s"), (2, None, None), (2, None, None)]):
        table = docs(spark, rows)
        mixed = mixing.by_first_use(mixing.mix(table)).collect()
        assert sorted((r.doc_id, r.size) for r in mixed) == sorted((i, len((t or "").split())) for i, t, _ in rows)
        assert all((r.taken, r.uses, r.first_position) == (0, [], None) for r in mixed if r.size == 0)
        assert {r.doc_id for r in mixing.mixed_rows(table).collect()} == {i for i, t, _ in rows if t and t.split()}
        assert mixing.training_order(mixing.mix(table)).count() == mixing.mixed_rows(table).count()


def test_inverse_of_the_integral(spark):
    pieces = mixing.integrated(F.expr("array(named_struct('at', 0D, 'height', 1D), named_struct('at', 1D, 'height', 3D))"))
    row = spark.range(1).select(*[mixing.inverted(pieces, F.lit(s)).alias(f"p{i}") for i, s in enumerate((0.0, 0.375, 1.0))]).first()
    assert row.p0 == pytest.approx(0) and row.p1 == pytest.approx(0.5) and row.p2 == pytest.approx(1)


def test_registered_mix_comes_in_training_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = Counter((r.doc_id, r.uses and round(r.uses[0].position, 9) or None) for r in mixing.mix(docs).collect())
    got = llm.op9_curriculum_mix(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.first_position) for r in got) == first
    positions = [2.0 if r.first_position is None else r.first_position for r in got]
    assert len(got) == docs.count() and len(set(positions)) > 100
    assert positions == sorted(positions)
