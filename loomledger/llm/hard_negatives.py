"""Hard negatives by a Voronoi-partition kNN join.

Inner products are turned into distances by norm augmentation: a row x gets one more component sqrt(M^2 - |x|^2), M the
largest norm, an anchor a gets 0; then |a - x|^2 = |a|^2 + M^2 - 2 a.x. Rows are assigned to the nearest of a bounded
sample of pivots, and a cell's rows to rings by their distance to its pivot. From a ring's least and largest distance
and an anchor's distance to the pivot, the triangle inequality bounds every score between them. A ring's rows are cut
into blocks of BLOCK rows by a hash, so that copies of one vector are spread; anchors are held in groups of GROUP that
lie near each other. A ring is sent to a group only if its bounds say that it might serve one of its anchors; each such
block and group then meet in one task, where all scores are exact.

Three such joins: each group with its anchors' own cells, which gives every anchor a score that its first five
positives reach; with the other rings that may hold a better row of the label; and with the rings that may hold a row
of another label between 80 and 100 per cent of a positive's score. Each join leaves the first five per anchor (and
positive) of each block, and a window takes the first five of these.

At most PIVOTS pivots and their RINGS rings reach the driver, whatever the table's size. Nothing else is collected.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; of rows that
share a vec_id the one of least label, then least vector counts; missing components of a shorter vector count as 0;
components and scores that leave 64 bits are held at their ends; a label of one row has no positives, a negative
positive score no negatives; an empty table, or one without anchors, gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

ANCHORS_EVERY = 100
POSITIVES = 5
NEGATIVES = 5
#: A negative has at least LEAST and at most MOST parts of its positive's score.
LEAST, MOST = 80, 100
#: Pivots: one per so many rows, and at most so many. Rings a cell.
ROWS_PER_PIVOT = 2048
PIVOTS = 512
RINGS = 4
#: Rows of a block, anchors of a group.
BLOCK = 1024
GROUP = 256
#: Bounds are widened by this part of the squared norms, more than rounding can err.
SLACK = 1e-6
#: Tables of needs are broadcast up to so many rows of four numbers.
BROADCAST_ROWS = 500_000

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_PACKED = "ids binary, labels binary, wide boolean, matrix binary, bounds binary, cells binary"
_ENDS = np.iinfo(np.int64)


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that count, labels as they are compared, components as integers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    label = F.col("label").cast("long")
    rows = vectors.filter(ok).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.struct(F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v")).alias("row"),
    )
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v")


def matrix(rows: list[np.ndarray], dims: int = 0) -> np.ndarray:
    """Integer rows of one width, the shorter ones filled with 0."""
    out = np.zeros((len(rows), max([dims, *map(len, rows)])), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact; those beyond 64 bits at their ends."""
    k = min(a.shape[1], b.shape[1])
    a, b = a[:, :k], b[:, :k]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = max(-int(a.min()), int(a.max())) * max(-int(b.min()), int(b.max())) * k
    if most < 1 << 53:  # doubles are exact
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.array([[min(max(x, _ENDS.min + 1), _ENDS.max) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


class Cells:
    """Pivots in the augmented space."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.most = most  # the largest squared norm
        self.pivots = pivots.astype(float)
        self.square = (self.pivots**2).sum(1)
        self.extra = np.sqrt(np.maximum(most - self.square, 0))

    def distances(self, rows: np.ndarray, are_anchors: bool) -> np.ndarray:
        """From each row, augmented (anchors: by 0), to each pivot."""
        rows = np.pad(rows.astype(float), ((0, 0), (0, max(0, self.pivots.shape[1] - rows.shape[1]))))
        square = (rows**2).sum(1)
        own = np.zeros(len(rows)) if are_anchors else np.sqrt(np.maximum(self.most - square, 0))
        whole = (square if are_anchors else np.maximum(square, self.most))[:, None] + np.maximum(self.square, self.most)
        return np.sqrt(np.maximum(whole - 2 * (rows @ self.pivots.T + own[:, None] * self.extra), 0))

    def bounds(self, rows: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that an anchor may have with a row whose distance to the pivot of a cell lies from low to high."""
        d = self.distances(rows, True)[:, cell]
        near = np.maximum(np.maximum(d - high, low - d), 0)
        whole = (rows.astype(float) ** 2).sum(1)[:, None] + self.most
        slack = SLACK * whole + 1
        # scores beyond 64 bits are held at their ends, so bounds are too
        return np.minimum((whole - (d + high) ** 2) / 2 - slack, float(_ENDS.max)), np.maximum((whole - near**2) / 2 + slack, float(_ENDS.min))


def _placing(cells: Cells, coarse: int) -> Callable:
    """Adds a row's cell and the distance to its pivot; anchors' own cell, and the first `coarse` pivots' nearest as their group."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = cells.distances(matrix(pdf["v"].tolist(), cells.pivots.shape[1]), False)
            at = d.argmin(1) if len(pdf) else np.zeros(0, int)
            near = d[:, :coarse].argmin(1) if len(pdf) else at
            yield pdf.assign(cell=at, d=d[np.arange(len(pdf)), at], near=near)

    return place


def _pack(pdf: pd.DataFrame) -> dict:
    """Rows as arrays of one row, by vec_id; 16-bit components where they fit."""
    pdf = pdf.sort_values("vec_id")
    m = matrix(pdf["v"].tolist())
    wide = bool(m.size and (m.min() < -(1 << 15) or m.max() >= 1 << 15))
    bounds = pdf["bounds"].tolist() if "bounds" in pdf else []
    filled = np.full((len(bounds), POSITIVES), _ENDS.min, np.int64)
    for i, b in enumerate(bounds):
        filled[i, : len(b)] = b
    return {
        "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "labels": pdf["label"].to_numpy(np.int64).tobytes(), "wide": wide, "matrix": m.astype(np.int64 if wide else np.int16).tobytes(),
        "bounds": filled.tobytes(), "cells": pdf["cell"].to_numpy(np.int32).tobytes(),
    }


def _packer(keys: list[str]) -> Callable:
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | _pack(pdf)])

    return pack


class Packed:
    """What _pack has made."""

    def __init__(self, row, prefix: str = ""):
        get = lambda name, kind: np.frombuffer(getattr(row, prefix + name), kind)
        self.ids, self.labels, self.cells = get("ids", np.int64), get("labels", np.int64), get("cells", np.int32)
        self.matrix = get("matrix", np.int64 if getattr(row, prefix + "wide") else np.int16).reshape(len(self.ids), -1).astype(np.int64)
        self.bounds = get("bounds", np.int64).reshape(-1, POSITIVES)


def firsts(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's first k scores among those ok; ties by column."""
    held = np.where(ok, scores, _ENDS.min)
    if held.shape[1] > k:
        ok = ok & (held >= np.partition(held, held.shape[1] - k, axis=1)[:, [held.shape[1] - k]])
    i, j = np.nonzero(ok)
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k]


def _met(choose: Callable) -> Callable:
    """Each row holds a group of anchors and a block of rows: what `choose` takes of their scores, as (anchor_id, positive, other_id, score)."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a, b = Packed(row, "a_"), Packed(row)
                scores = products(a.matrix, b.matrix)
                same = a.labels[:, None] == b.labels
                for k, ok in choose(a, b, scores, same):
                    i, j = firsts(scores, ok, POSITIVES if k == 0 else NEGATIVES)
                    yield pd.DataFrame({"anchor_id": a.ids[i], "positive": k, "other_id": b.ids[j], "score": scores[i, j]})

    return meet


def _positives(a: Packed, b: Packed, scores: np.ndarray, same: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    floor = a.bounds[:, [0]] if len(a.bounds) else _ENDS.min
    yield 0, same & (a.ids[:, None] != b.ids) & (scores >= floor)


def least_score(positive: int) -> int:
    """The least whole score that holds LEAST parts of a positive's."""
    return -(-LEAST * positive // MOST)


def _negatives(a: Packed, b: Packed, scores: np.ndarray, same: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for k in range(POSITIVES):
        high = a.bounds[:, [k]]
        low = np.array([[least_score(int(x))] for x in high[:, 0]], object).clip(_ENDS.min, _ENDS.max).astype(np.int64)
        yield k + 1, ~same & (high >= 0) & (scores <= high) & (scores >= low)


def _needs(cells: Cells, rings: list, wanted: Callable) -> Callable:
    """Per group of anchors the rings that might serve one of them."""
    cell, ring, low, high, salts = (np.array([r[k] for r in rings]) for k in ("cell", "ring", "low", "high", "salts"))

    def need(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a = Packed(row, "a_")
                lo, hi = cells.bounds(a.matrix, cell, low, high)
                at = np.flatnonzero(wanted(a, cell, lo, hi))
                yield pd.DataFrame({"near": row.near, "part": row.part, "cell": cell[at], "ring": ring[at], "salts": salts[at]})

    return need


def _better(a: Packed, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rings beyond the group's own cells that may hold a row of at least an anchor's score so far."""
    return (high >= a.bounds[:, [0]]).any(0) & ~np.isin(cell, a.cells)


def _within(a: Packed, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rings that may hold a row between 80 and 100 per cent of a positive's score."""
    most = a.bounds.max(1)
    least = np.where(a.bounds >= 0, a.bounds, _ENDS.max).min(1) * (LEAST / MOST)
    return ((high >= least[:, None]) & (low <= most[:, None]) & (most >= 0)[:, None]).any(0)


def _sized(df: DataFrame) -> DataFrame:
    """To be broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _meetings(needs: DataFrame, blocks: DataFrame, groups: DataFrame, choose: Callable, name: str) -> DataFrame:
    """What each needed block holds for each group, dealt out by both."""
    pairs = needs.select("near", "part", "cell", "ring", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    met = pairs.join(blocks, ["cell", "ring", "salt"]).join(groups, ["near", "part"])
    return written(met.mapInPandas(_met(choose), "anchor_id long, positive int, other_id long, score long"), name)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _salts(count: Column, of: int) -> Column:
    return F.ceil(count / of).cast("int")


def mined(vectors: DataFrame) -> DataFrame:
    """Per anchor, positive and rank: the columns of RESULT."""
    spark = vectors.sparkSession
    rows = written(taking_part(vectors), "negatives_rows")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, anchors, most = rows.agg(F.count("*"), F.count(F.when(_is_anchor(), 1)), F.max(square)).first()
    if not anchors:
        return spark.createDataFrame([], RESULT)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOTS, max(1, n // ROWS_PER_PIVOT))).collect()
    cells = Cells(matrix([np.array(r["v"], np.int64) for r in sample]), most)
    coarse = min(len(sample), max(1, anchors // GROUP))
    placed = written(rows.mapInPandas(_placing(cells, coarse), "vec_id long, label long, v array<long>, cell int, d double, near int"), "negatives_placed")

    # rings of equal counts, as far as equal distances allow
    cuts = placed.groupBy("cell").agg(F.percentile_approx("d", [k / RINGS for k in range(1, RINGS)]).alias("cuts"))
    ringed = placed.join(F.broadcast(cuts), "cell").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("d")))).drop("cuts")
    rings = ringed.groupBy("cell", "ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), _salts(F.count("*"), BLOCK).alias("salts"))
    rings = written(rings, "negatives_rings")
    in_block = F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int")
    dealt = ringed.join(F.broadcast(rings.select("cell", "ring", "salts")), ["cell", "ring"]).select("vec_id", "label", "v", "cell", "ring", in_block.alias("salt"))
    blocks = written(dealt.groupBy("cell", "ring", "salt").applyInPandas(_packer(["cell", "ring", "salt"]), f"cell int, ring int, salt int, {_PACKED}"), "negatives_blocks")

    own = placed.filter(_is_anchor())
    parts = own.groupBy("near").agg(_salts(F.count("*"), GROUP).alias("parts"))
    own = own.join(F.broadcast(parts), "near").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    own = written(own.select("vec_id", "label", "v", "cell", "near", "part"), "negatives_anchors")

    def grouped(anchors: DataFrame) -> DataFrame:
        packed = anchors.groupBy("near", "part").applyInPandas(_packer(["near", "part"]), f"near int, part int, {_PACKED}")
        return written(packed.select("near", "part", *[F.col(c.split()[0]).alias(f"a_{c.split()[0]}") for c in _PACKED.split(", ")]), "negatives_groups")

    def with_bounds(found: DataFrame, bounds: Column) -> DataFrame:
        return grouped(own.join(found.groupBy(F.col("anchor_id").alias("vec_id")).agg(bounds.alias("bounds")), "vec_id", "left").withColumn("bounds", F.coalesce("bounds", F.array().cast("array<long>"))))

    ring_list = rings.collect()
    need = "near int, part int, cell int, ring int, salts int"
    home = own.select("near", "part", "cell").distinct().join(F.broadcast(rings), "cell")
    found = _first(_meetings(home, blocks, grouped(own), _positives, "negatives_home"), ["anchor_id"], POSITIVES)
    # the fifth score so far is one that every positive reaches
    reached = with_bounds(found, F.when(F.count("*") == POSITIVES, F.array(F.min("score"))))
    rest = _sized(reached.mapInPandas(_needs(cells, ring_list, _better), need))
    more = _meetings(rest, blocks, reached, _positives, "negatives_rest")
    positives = written(_first(found.drop("rank").unionByName(more), ["anchor_id"], POSITIVES), "negatives_positives")

    scored = with_bounds(positives, F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]))
    serve = _sized(scored.mapInPandas(_needs(cells, ring_list, _within), need))
    negatives = _first(_meetings(serve, blocks, scored, _negatives, "negatives_found"), ["anchor_id", "positive"], NEGATIVES)
    negatives = negatives.select("anchor_id", "positive", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = positives.select("anchor_id", F.col("rank").alias("positive"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(of, ["anchor_id", "positive"]).select(*[c.split()[0] for c in RESULT.split(", ")])


def _is_anchor() -> Column:
    return F.col("vec_id") % ANCHORS_EVERY == 0
