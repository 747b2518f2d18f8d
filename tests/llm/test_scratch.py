"""Scratch tables belong to one run: two at once do not disturb each other, and none is left."""

import threading
from pathlib import Path

from loomledger.llm import near_dedup, packing, warc
from loomledger.llm._common import drop_made, made, scratch, scratch_dir, written
from tests.llm.test_llm_operators import PROSE, docs


def tables(spark):
    return {p.name for p in Path(scratch_dir(spark).removeprefix("file://")).iterdir()}


def test_two_runs_at_once_leave_nothing(spark):
    written(spark.range(1), "other")
    before = tables(spark)
    texts, found, failed = [PROSE * 3, PROSE * 3, "another text of five words"], {}, []
    pages = spark.createDataFrame([(1, "http://a.example/", "x"), (2, "http://a.example/b", "x")], "page_id long, url string, html string")
    work = {
        "near": lambda: sorted((r.doc_id, r.component_id) for r in near_dedup.groups(docs(spark, texts)).collect()),
        "kept": lambda: sorted(r.doc_id for r in near_dedup.keep_one(docs(spark, texts)).collect()),
        "packed": lambda: packing.packed(docs(spark, texts)).count(),
        "warc": lambda: sorted((r.page_id, r.refers_to) for r in warc.archived(pages).collect()),
    }

    def run(name):
        try:
            with scratch(spark):
                found[name] = work[name]()
        except Exception as e:
            failed.append((name, e))

    threads = [threading.Thread(target=run, args=(name,)) for name in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert found == {"near": [(0, 0), (1, 0), (2, 2)], "kept": [0, 2], "packed": 3, "warc": [(1, None), (2, 1)]}
    assert tables(spark) == before


def test_a_mark_is_a_threads_own(spark):
    mine = made()
    mark, table = [], []

    def other():
        mark.append(made())
        table.append(written(spark.range(3), "theirs"))

    t = threading.Thread(target=other)
    t.start()
    t.join()
    assert made() == mine and mark == [0]
    drop_made(spark, mine)
    assert table[0].count() == 3
