"""Ids of any 64 bits, none, and one id on several texts."""

import pytest

from loomledger.llm import language_id, near_dedup, packing, pii, runs, warc
from tests.llm.test_llm_operators import PROSE, docs
from tests.llm.test_values import clashing

FAR = [(1 << 62) + 5, (1 << 63) - 1, -(1 << 63), -7, (1 << 53) + 1, 0]
NEAR = PROSE * 3
OTHER = " ".join(f"v{i}" for i in range(60))


def groups(spark, rows):
    return sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)


def test_near_groups_of_far_ids(spark):
    rows = [(i, NEAR + (f" x{k}" if k % 2 else "")) for k, i in enumerate(FAR)] + [(None, NEAR), (3, OTHER)]
    least = min(FAR)
    want = [(i, least, i == least) for i in FAR] + [(None, least, False), (3, 3, True)]
    assert groups(spark, rows) == sorted(want, key=repr)
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([next(r for r in rows if r[0] == least), (3, OTHER)])


def test_one_id_on_several_texts(spark):
    # 9 stands on two texts that do not resemble each other, 5 on two that do
    rows = [(9, NEAR), (9, OTHER), (12, OTHER + " more"), (5, "q " * 3 + OTHER[::-1]), (5, "q " * 3 + OTHER[::-1] + " z"), (9, ""), (None, "a b"), (None, "a b"), (None, "c d")]
    assert groups(spark, rows) == sorted([(9, 9, True), (9, 9, True), (12, 9, False), (5, 5, True), (5, 5, True), (9, 9, True), (None, None, True), (None, None, True), (None, None, True)], key=repr)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, near_dedup.keep_one(frame).collect()), key=repr)
    assert [r for r in kept if r[0] != 5] == sorted([(9, NEAR), (9, OTHER), (9, ""), (None, "a b"), (None, "c d")], key=repr)
    assert len([r for r in kept if r[0] == 5]) == 1
    again = near_dedup.keep_one(frame.repartition(3).orderBy("text")).collect()
    assert sorted(map(tuple, again), key=repr) == kept


def test_of_repeated_rows_the_least_stays(spark):
    rows = clashing(spark, [(4, NEAR, "en", s) for s in "zxy"] + [(4, OTHER, "en", "b"), (4, OTHER, "en", "a")])
    assert sorted((r.text, r.source) for r in near_dedup.keep_one(rows).collect()) == sorted([(NEAR, "x"), (OTHER, "a")])


@pytest.mark.parametrize("run", [runs.found, pii.found, language_id.identify, packing.packed, near_dedup.groups])
def test_ids_come_back_whole_beside_a_null(spark, run):
    rows = spark.createDataFrame([(i, NEAR, "en") for i in [*FAR, None]], "doc_id long, text string, lang string").coalesce(1)
    assert {r.doc_id for r in run(rows).select("doc_id").collect()} == {*FAR, None}


def test_page_ids_come_back_whole(spark):
    rows = [(i, f"http://a.example/{k}", "same" if i in FAR[:2] else str(k)) for k, i in enumerate([*FAR, None])]
    got = {r.page_id: r.refers_to for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == dict.fromkeys([*FAR, None]) | {FAR[1]: FAR[0]}


def test_runs_follow_the_whole_id(spark):
    long = " ".join(f"w{k}" for k in range(400))
    some = [i for i in range(1 << 60, (1 << 60) + 40)]
    got = {r.doc_id: r.n_runs for r in runs.found(docs(spark, []).unionByName(spark.createDataFrame([(i, long) for i in some] + [(None, long)], "doc_id long, text string"), allowMissingColumns=True)).collect()}
    assert got == {i: int(runs.words_of(long, i) != long.split()) for i in some} | {None: 0}
