"""Islands within a range of seqs are final; only those at a border meet in the last window."""

import random

from loomledger.operators import neighbours, tombstone

ZONE = 1 << 20


def test_only_border_islands_meet_in_one_task(spark, monkeypatch):
    inner = [(i * 40 + 5, i * 40 + 20) for i in range(1, 100)]
    rows = [*inner, (50, 52), (ZONE - 3, ZONE + 7), (ZONE + 8, ZONE + 9), (2 * ZONE - 5, 2 * ZONE - 1), (2 * ZONE, 4 * ZONE + 2), (5 * ZONE + 1, 5 * ZONE + 2)]
    merged, seen = tombstone._merged, []

    def counted(df, keys):
        if keys == ["all"]:
            seen.append(df.count())
        return merged(df, keys)

    monkeypatch.setattr(tombstone, "_merged", counted)
    got = tombstone.islands(spark.createDataFrame(rows, "lo long, hi long")).collect()
    want = [*inner, (ZONE - 3, ZONE + 9), (2 * ZONE - 5, 4 * ZONE + 2), (5 * ZONE + 1, 5 * ZONE + 2)]
    assert sorted((r.lo, r.hi) for r in got) == sorted(want)
    assert seen[0] <= 6


def parted_one_by_one(pairs, seal, effective):
    out = []
    while seal > effective:
        crossed = [(o, t) for t, o in pairs if (t <= seal) != (o <= seal)]
        if not crossed:
            break
        o, t = min(crossed)
        out.append((seal, t, o))
        seal = max(0, min(o, t) - 1)
    return out


def test_parted_pairs_equal_the_loop(spark):
    r = random.Random(6)
    for n, top in ((1, 5), (12, 30), (60, 200), (200, 3000)):
        seqs = [r.sample(range(1, top + 1), 2) for _ in range(n)]
        seal = r.randint(top // 2, top)
        got = tombstone.parted(spark.createDataFrame([tuple(s) for s in seqs], "target_seq long, op_seq long"), seal, 0)
        assert sorted(map(tuple, got.collect()), reverse=True) == parted_one_by_one(seqs, seal, 0)


def test_many_nested_pairs_take_few_passes(spark, monkeypatch):
    wrote, keep = [], neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, name: wrote.append(name) or keep(df, name))
    n = 10_000  # each pair's lesser seq lies inside the pair before it
    rows = [(2 * k + 1, 2 * k + 4) for k in range(n)]
    got = tombstone.parted(spark.createDataFrame(rows, "target_seq long, op_seq long"), 2 * n, 0)
    assert got.count() == len(parted_one_by_one_fast(rows, 2 * n))
    assert len(wrote) <= 2 * 16 + 2


def parted_one_by_one_fast(rows, seal):
    """The loop over pairs (2k + 1, 2k + 4), of which at most two are parted by a seal."""
    by, out = {}, []
    for t, o in rows:
        for e in range(t, o):
            by[e] = min(by.get(e, (o, t)), (o, t))
    while seal in by:
        o, t = by[seal]
        out.append((t, o))
        seal = max(0, min(o, t) - 1)
    return out
