"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Documents, cut where they exceed the
largest, are taken longest first; each goes to the open bin it fills best. When
none has room, a new bin opens at the size whose cost per token is least: a
size's cost is its tokens plus their attention, and what it would hold comes from
a trial fill, longest first, from the shard's pieces still to come that no bin
opened before counts on. The trial's bin is priced at the smallest permitted
length that holds it; should pieces go elsewhere after all, where they fit
better, the bin shrinks likewise at the end (not seen to happen in random tables).

Bins are filled within shards of about SHARD pieces, dealt by a hash of row and
piece (so that rows without an id or of one id spread too), so that no task or group grows with the input; the number of shards
follows a count of the pieces. Only lengths travel, never texts.

Defined cases: null, empty and blank texts have no tokens and go to no bin (bin
and capacity null, one row each); a null id is packed like any other; repeated
rows are packed each; ties go to the smaller remaining room, then the older bin,
and pieces of equal length are taken by id and piece; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_text, ids, space_words, written

CAPACITIES = (512, 1024, 2048, 4096)
#: Sequence length at which attention costs as much as everything else.
ATTENTION = 8192
SHARD = 20_000

_SCHEMA = "doc_id long, piece int, n_tokens int, bin string, capacity int, start int"


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / ATTENTION)


class _Free:
    """Lengths still to come that no open bin counts on; counts only fall, so that emptied lengths are skipped by links."""

    def __init__(self, lengths: list[int]) -> None:
        self.count = [0] * (max(lengths, default=0) + 1)
        for n in lengths:
            self.count[n] += 1
        self._down = list(range(len(self.count)))

    def longest(self, most: int) -> int:
        """The longest such length up to `most`, or 0."""
        at = most = max(0, min(most, len(self.count) - 1))
        while at and not self.count[at]:
            at = self._down[at] if self._down[at] < at else at - 1
        while most > at:  # shorten the links that were followed
            most, self._down[most] = self._down[most] if self._down[most] < most else most - 1, at
        return at

    def drop(self, length: int, n: int = 1) -> None:
        self.count[length] -= n


def trial(length: int, capacity: int, free: _Free | None) -> tuple[int, list[tuple[int, int]]]:
    """What a bin of this capacity would hold: its tokens, and the (length, count) that join the first piece, longest first."""
    held, taken, at = length, [], capacity
    while free and (at := free.longest(min(at, capacity - held))):
        n = min(free.count[at], (capacity - held) // at)
        taken.append((at, n))
        held += at * n
        at -= 1
    return held, taken


def size_to_open(length: int, left: int, capacities: tuple[int, ...], free: _Free | None = None) -> int:
    """The size whose bin, shrunk to what a trial fill puts there, costs least per token; `left` tokens are to come, this piece included."""
    fits = [c for c in capacities if c >= length]
    enough = min((c for c in fits if c >= left), default=max(fits))  # nothing is left for a size beyond it

    def price(capacity: int) -> float:
        held, _ = trial(length, capacity, free)
        return cost(min(c for c in fits if c >= held)) / held

    return min((c for c in fits if c <= enough), key=lambda c: (price(c), c))


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[tuple[int, int]], list[int]]:
    """Lengths in falling order: (bin, start) of each, and every bin's final capacity."""
    rooms: list[tuple[int, int]] = []  # (room left, bin), in order
    placed, opened, used = [], [], []
    left = sum(lengths)
    free, to_come = _Free(lengths), Counter(lengths)
    for n in lengths:
        to_come[n] -= 1
        if free.count[n] > to_come[n]:
            free.drop(n)
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = size_to_open(n, left, capacities, free), len(opened)
            for length, count in trial(n, room, free)[1]:
                free.drop(length, count)
            opened.append(room)
            used.append(0)
        placed.append((b, used[b]))
        used[b] += n
        left -= n
        if room > n:
            insort(rooms, (room - n, b))
    return placed, [min(c for c in capacities if c >= u) for u in used]


def _pack_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.assign(doc_id=ids(pdf["doc_id"])).sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    placed, capacities = pack(pdf["n_tokens"].tolist())
    return pd.DataFrame(
        {"doc_id": pdf["doc_id"].array, "piece": pdf["piece"].to_numpy(), "n_tokens": pdf["n_tokens"].to_numpy(), "bin": [f"{key[0]}-{b}" for b, _ in placed], "capacity": [capacities[b] for b, _ in placed], "start": [s for _, s in placed]}
    )


def packed(docs: DataFrame) -> DataFrame:
    """Per piece of each row: doc_id, piece, n_tokens (words), bin, capacity, start within the bin."""
    most = max(CAPACITIES)
    lengths = written(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size(space_words(F.col("text"))).alias("n")), "pack_lengths")
    total = lengths.agg(F.sum(F.greatest(F.ceil(F.col("n") / most), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD))
    pieces = lengths.filter("n > 0").select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("int").alias("n_tokens"))
    dealt = pieces.select(id_text("doc_id"), "piece", "n_tokens", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))
    return (
        dealt.groupBy("shard").applyInPandas(_pack_shard, _SCHEMA)
        .unionByName(lengths.filter("n = 0").selectExpr("doc_id", "0 as piece", "0 as n_tokens", "cast(null as string) as bin", "cast(null as int) as capacity", "0 as start"))
    )
