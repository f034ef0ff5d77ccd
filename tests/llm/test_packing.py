import random
from collections import Counter

import pytest

from quern.llm import packing as p


@pytest.mark.parametrize("seed", range(30))
def test_plan_holds_every_item_and_no_container_overflows(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 7, 20, 64])
    sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 200))]
    patterns = p.plan(Counter(sizes), capacity)
    assert all(k > 0 and sum(parts) <= capacity for k, parts in patterns)
    got = Counter()
    for k, parts in patterns:
        for x in parts:
            got[x] += k
    assert got == Counter(sizes)


@pytest.mark.parametrize("seed", range(40))
def test_close_to_the_best_packing_of_small_sets(seed):
    r = random.Random(seed)
    capacity = 12
    sizes = sorted((r.randint(1, 12) for _ in range(r.randint(1, 8))), reverse=True)
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity and bins[b] not in bins[:b]:
                place(i + 1, bins[:b] + [bins[b] + sizes[i]] + bins[b + 1 :])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    assert sum(k for k, _ in p.plan(Counter(sizes), capacity)) <= best[0] + 1


def test_exact_complements_fill_whole_containers():
    assert sum(k for k, _ in p.plan({7: 10, 3: 10}, 10)) == 10
    assert sum(k for k, _ in p.plan({5: 6, 3: 6, 2: 6}, 10)) == 6
    assert sum(k for k, _ in p.plan({4: 3, 3: 3, 2: 3, 1: 3}, 10)) == 3


def test_pieces_and_places(spark):
    sizes = spark.createDataFrame([(1, 0, "x"), (2, None, "x"), (3, 10, "x"), (4, 25, "x"), (5, 7, "x"), (5, 7, "x"), (6, 3, "x"), (7, 20, "x")], "doc_id bigint, tokens bigint, container string")
    windows = spark.createDataFrame([(1, "a", 10), (2, "b", 100)], "window_id bigint, window_name string, capacity_tokens bigint")
    got = p.pack(sizes, windows).collect()
    for w, capacity in ((1, 10), (2, 100)):
        rows = [r for r in got if r.window_id == w]
        assert sum(r.tokens for r in rows) == 72
        assert [r.container for r in rows if r.doc_id in (1, 2)] == [None, None]
        used = Counter()
        for r in rows:
            if r.container is not None:
                used[r.container] += r.tokens
        assert max(used.values()) <= capacity and sorted(used) == list(range(len(used)))
        assert len(used) == (8 if w == 1 else 1)
    parts = sorted((r.piece_no, r.start, r.tokens) for r in got if r.window_id == 1 and r.doc_id == 4)
    assert parts == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert p.pack(sizes.limit(0), windows).count() == 0 and p.pack(sizes, windows.limit(0)).count() == 0
    use = {r.window_id: r for r in p.use_of(p.pack(sizes, windows), windows).collect()}
    assert use[1].containers == 8 and use[1].tokens == 72 and use[1].unused_share == 0.1


def test_many_equal_items_are_spread_over_ranks(spark):
    sizes = spark.range(3000).selectExpr("id as doc_id", "cast(if(id % 3 = 0, 4, id % 9 + 1) as bigint) as tokens")
    windows = spark.createDataFrame([(1, 16)], "window_id bigint, capacity_tokens bigint")
    got = p.pack(sizes, windows).groupBy("container").sum("tokens").collect()
    assert max(r[1] for r in got) <= 16
    total = sizes.selectExpr("sum(tokens)").first()[0]
    assert len(got) <= 1.01 * total / 16 + 1
