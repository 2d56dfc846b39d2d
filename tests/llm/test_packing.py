import random
from collections import defaultdict

import pytest

from textloom.llm import packing


def limits(spark, *rows):
    return spark.createDataFrame(list(rows), "limit_id int, capacity int, limit_key string")


def packed(spark, sizes, *rows):
    items = spark.createDataFrame([(i, "k", s) for i, s in enumerate(sizes)], "id long, limit_key string, size int")
    return packing.pack(items, limits(spark, *rows)).collect()


def best_fit_decreasing(sizes, cap):
    gaps = []
    for s in sorted((s for s in sizes if s), reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(cap - s)
        else:
            gaps[gaps.index(fit)] -= s
    return len(gaps)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_piece_once_and_no_overflow(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 2, 5, 100, rng.randint(1, 130), 350, None]) for _ in range(150)]
    caps = {1: 100, 2: 640}
    got = packed(spark, sizes, (1, 100, "k"), (2, 640, "k"), (3, 0, "k"), (4, 10, "other"))
    for limit, cap in caps.items():
        rows = [r for r in got if r.limit_id == limit]
        held, whole = defaultdict(int), defaultdict(int)
        assert len({(r.item, r.part) for r in rows}) == len(rows)
        for r in rows:
            held[r.container] += r.size
            whole[int(r.item)] += r.size
        assert max(held.values()) <= cap
        assert whole == {i: s or 0 for i, s in enumerate(sizes)}
        for i, s in enumerate(sizes):
            assert sum(int(r.item) == i for r in rows) == max(1, -(-(s or 0) // cap))
        used = len([c for c, v in held.items() if v])
        assert used <= 1.1 * best_fit_decreasing([r.size for r in rows], cap) + 2
    assert {r.limit_id for r in got} == {1, 2}


def test_empty_and_equal(spark):
    assert packed(spark, [], (1, 10, "k")) == []
    assert len({r.container for r in packed(spark, [6] * 20, (1, 10, "k"))}) == 20
    assert len({r.container for r in packed(spark, [5] * 20, (1, 10, "k"))}) == 10


def test_matching_across_ranges():
    # range 0 leaves items, range 1 gaps then items, range 2 gaps: nearest first
    got = packing._across([(1, 0, 0, 3), (1, 1, 1, 1), (1, 1, 0, 1), (1, 2, 1, 2)])
    pairs = defaultdict(dict)
    for limit, kind, part, low, high, offset in got:
        for r in range(low, high):
            pairs[r + offset][kind] = (part, r)
    assert sorted((v[0], v[1]) for v in pairs.values()) == [((0, 1), (2, 1)), ((0, 2), (1, 0)), ((1, 0), (2, 0))]


def test_places_and_ranges_make_the_same_fill(spark):
    """Small items for large containers, in one range and in several."""
    rng = random.Random(7)
    sizes = [rng.choice([3, 7, 11, rng.randint(1, 40), rng.randint(1, 900)]) for _ in range(400)]
    used = []
    for coalesce in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        got = packed(spark, sizes, (1, 1000, "k"))
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        held = defaultdict(int)
        for r in got:
            held[r.container] += r.size
        assert len(got) == len(sizes) and sum(held.values()) == sum(sizes) and max(held.values()) <= 1000
        used.append(len(held))
    assert max(used) <= best_fit_decreasing(sizes, 1000) + 2


def test_gaps_of_a_range_are_one_segment():
    got = packing._segments([(1, 0, 0, 2, 3, 5), (1, 1, 2, 0, 1, 7), (1, 0, 1, 0, 1, 8), (1, 1, 2, 1, 2, 7)])
    assert sorted(got) == [(1, 0, 0, 2, 3, 5), (1, 0, 1, 0, 1, 8), (1, 1, 2, 0, 2, 7)]
