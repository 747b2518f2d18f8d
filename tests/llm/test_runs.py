"""Periodic runs against all periods of all places, and the defined value of every odd case."""

import hashlib
import random
import time

import numpy as np
import pytest

from loomledger.llm import runs


def every_run(words):
    """Runs by definition: for each period the stretches of equal words that far apart, of each stretch its least period."""
    least = {}
    for q in range(1, len(words) // runs.LEAST_PERIODS + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(runs.LEAST_WORDS, runs.LEAST_PERIODS * q):
                least.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def repetitive(r):
    k = r.choice([1, 2, 3, 5])
    words = [r.randrange(k) for _ in range(r.choice([0, 1, 5, 24, 30, 60, 100]))]
    for _ in range(r.randint(0, 3)):
        at = r.randint(0, len(words))
        words[at:at] = [r.randrange(k) for _ in range(r.randint(1, 8))] * r.randint(2, 9)
    return words


@pytest.mark.parametrize("least", [24, 3])
@pytest.mark.parametrize("few", [0, 16, 10**9])
def test_runs_equal_those_of_all_periods(monkeypatch, least, few):
    monkeypatch.setattr(runs, "LEAST_WORDS", least)
    monkeypatch.setattr(runs, "FEW", few)
    r = random.Random(least)
    for _ in range(60):
        texts = [repetitive(r) for _ in range(r.randint(1, 6))]
        assert runs.runs_in([np.array(t, np.int64) for t in texts]) == [every_run(t) for t in texts]


def test_sorts_whose_keys_do_not_fit_one_number(monkeypatch):
    parts = runs.Refinement(np.array([1, 1, 1, 0]), np.zeros(4, int), np.full(4, 1))
    keys = [np.array(k) for k in ([2, 1, 2, 1], [0, 3, 0, 1], [3, 2, 1, 0])]
    short = [k.tolist() for k in parts._by(*keys)]
    parts.bits = 40
    assert [k.tolist() for k in parts._by(*keys)] == short == [[1, 1, 2, 2], [1, 3, 0, 0], [0, 2, 1, 3]]


def test_long_repetitive_texts_take_little_time():
    began = time.time()
    n = 1_000_000
    assert runs.runs_in([np.zeros(n, np.int64)]) == [[(0, n, 1)]]
    assert runs.runs_in([np.tile(np.arange(50_000), 3)]) == [[(0, 150_000, 50_000)]]
    assert runs.runs_in([np.tile([0, 1], n // 2)]) == [[(0, n, 2)]]
    assert time.time() - began < 120


SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_odd_rows(spark):
    # ids whose crc32 leaves words alone, and one where it does not
    ids = [i for i in range(100) if runs.words_of("a b c d e f g h i j k l", i) == list("abcdefghijkl")]
    other = next(i for i in range(100) if i not in ids)
    beat = "la di da " * 8
    rows = [(ids[0], None), (ids[1], ""), (ids[2], " \n\t"), (ids[3], beat), (ids[3], beat), (ids[3], "once only"), (None, "b\vb\fb\rb " * 6), (ids[4], "x " * 300_000), (ids[5], "q" * 300_000), (ids[6], "la di da " * 7 + "la di"), (ids[7], "a " * 23)]
    frame = spark.createDataFrame([(*row, 1, 2, "r") for row in rows], "doc_id long, text string, start long, words long, `row` string")
    got = sorted((tuple(x) for x in runs.found(frame).collect()), key=repr)
    none = (None,) * 4
    want = [
        *[(i, 0, *none, SHA(""), SHA("")) for i in ids[:3]],
        *[(ids[3], 1, 0, 24, 3, 8000, SHA("0,24,3\n"), SHA("la di da"))] * 2,
        (ids[3], 0, *none, SHA(""), SHA("once only")),
        (None, 1, 0, 24, 1, 24000, SHA("0,24,1\n"), SHA("b")),
        (ids[4], 1, 0, 300_000, 1, 300_000_000, SHA("0,300000,1\n"), SHA("x")),
        (ids[5], 0, *none, SHA(""), SHA("q" * 300_000)),
        (ids[6], 0, *none, SHA(""), SHA("la di da " * 7 + "la di")),
        (ids[7], 0, *none, SHA(""), SHA(" ".join("a" * 23))),
    ]
    want[-2] = (ids[6], *every_tail(("la di da " * 7 + "la di").split()))
    assert got == sorted(want, key=repr)
    assert runs.found(frame.limit(0)).collect() == []
    long = spark.createDataFrame([(other, " ".join(f"w{k}" for k in range(400)))], "doc_id long, text string")
    assert runs.found(long).first().n_runs == 1


def every_tail(words):
    found = every_run(words)
    if not found:
        return 0, None, None, None, None, SHA(""), SHA(" ".join(words))
    (s, n, q), gone = found[0], {i for s, n, q in found for i in range(s + q, s + n)}
    return len(found), s, n, q, 1000 * n // q, SHA("".join(f"{s},{n},{q}\n" for s, n, q in found)), SHA(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_ties_take_the_first_start_then_the_least_period():
    words = list("ab" * 12) + ["x"] + list("cd" * 12)
    assert runs._row(1, words, runs.runs_in([np.unique(words, return_inverse=True)[1]])[0])[1:5] == (2, 0, 24, 2)
