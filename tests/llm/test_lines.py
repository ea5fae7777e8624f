"""op3's groups sorted by one number, and its small work items judged together."""

import numpy as np
import pytest

from millrace.llm import jaccard


def test_groups_sort_by_one_number_and_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    top = jaccard.MOST_SIZE
    rows = {(int(k) << 20, int(i)): int(n) for i, n in enumerate(np.concatenate([rng.integers(1, 60, 300), rng.integers(top - 9000, top * 3, 40)])) for k in rng.integers(-6, 6, 3)}
    df = spark.createDataFrame([(k, i, n) for (k, i), n in rows.items()] * 2, "key long, node long, n int")
    found = jaccard.groups(df, 80)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "Sort [" in line and line.count("ASC") == 1]
    trees: dict[int, set[int]] = {}
    for r in found.collect():
        assert r["n"] == next(n for (_, i), n in rows.items() if i == r["node"])
        trees.setdefault(r["node"], set()).add(r["tree"])
    for (k, i), n in rows.items():
        for (other, j), m in rows.items():
            if k == other and i != j and 80 * max(n, m) <= 100 * min(n, m):
                assert trees[i] & trees[j]


@pytest.mark.parametrize("count", [1, 400])
def test_a_bundle_finds_the_links_of_each_item(count):
    rng, bundle, want, node = np.random.default_rng(3), jaccard.Bundle(80, 50), set(), 0
    for _ in range(count):
        base, sets = rng.integers(0, 1 << 50, 40, dtype=np.uint64), []
        for _ in range(rng.integers(2, jaccard.FEW + 1)):
            sets.append(np.unique(np.concatenate([base[: rng.integers(30, 41)], rng.integers(0, 1 << 50, rng.integers(0, 8), dtype=np.uint64)])))
        assert bundle.takes(0, 0, np.arange(node, node + len(sets)), sets)
        want |= {(node + i, node + j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard.linked(sets[i], sets[j], 80)}
        node += len(sets)
    a, b = bundle.links()
    assert len(a) == len(want) and set(zip(a.tolist(), b.tolist(), strict=True)) == want
    assert not bundle.takes(0, 1, np.arange(2), sets[:2]) and not bundle.takes(0, 0, np.arange(99), sets * 99)
