"""The search for a capacity ends even if more groups than the driver may fetch lie near the cuts."""

import bisect
import random
from itertools import accumulate

import pytest

from loomtrace.llm import sharding


def brute(groups, shards):
    sums = [0, *accumulate(s for _, s in groups)]

    def cuts(capacity):
        ends = [0]
        for _ in range(shards):
            ends.append(bisect.bisect_right(sums, sums[ends[-1]] + capacity) - 1)
        return ends[1:]

    capacity = next(c for c in range(max(s for _, s in groups), sums[-1] + 1) if cuts(c)[-1] == len(groups))
    return capacity, [groups[i - 1][0] for i in cuts(capacity)][: shards - 1]


@pytest.mark.parametrize(("big", "shards"), [(900, 8), (5_000, 8), (300, 3), (1, 1)])
def test_settled_capacity_needs_no_local_groups(spark, monkeypatch, big, shards):
    monkeypatch.setattr(sharding, "MOST_LOCAL", 1)
    rounds, search = [], sharding._Prefix.cuts

    def counted(self, *args):
        rounds.append(1)
        assert len(rounds) < 20, "the search repeats itself"
        return search(self, *args)

    monkeypatch.setattr(sharding._Prefix, "cuts", counted)
    r = random.Random(big)
    groups = sorted((f"{r.getrandbits(256):064x}", r.randint(1, 9)) for _ in range(400))
    groups[150] = (groups[150][0], big)
    rows = spark.createDataFrame([(g, 1) for g, s in groups for _ in range(s)], "group string, size long")
    assert sharding.minimax_cuts(rows, shards) == brute(groups, shards)
