"""MinHash near-duplicate groups with circulant signatures.

A document's set is its distinct 5-word shingles, hashed to 64 bits. Texts with
equal sets are one class from the start. Two permutations of the 32-bit
universe make every signature coordinate: sigma scatters the set once, pi is
applied to sigma's values shifted circularly by the coordinate's number, and the
least value is kept. Bands of ROWS coordinates give candidate buckets.

Buckets are never expanded into all pairs. First each member is compared with
its bucket's pivot (the smallest class), which settles groups whose members
resemble the pivot. In buckets that still hold more than one component the
members, ordered by component, are cut into blocks; GROUP blocks against GROUP
blocks that span different components meet in a task, so that one bucket's
comparisons are many tasks' work. There a member's full set is written against its
pivot's: a bit for each of the pivot's shingles, and the shingles beyond those.
Near copies of one text are small in this form, and sizes of intersections are
exact, so that only links leave the task and never candidate pairs. No cap is
set on members, partners or candidates. What a task sends to Python at once is bounded
in bytes (texts, full sets, blocks of members), but for a single row. Wherever a bucket or a pivot is a join's
key, its rows are dealt over salts, as many as the number of classes asks for, and
what they join is repeated for the salts that occur.

With BANDS bands of ROWS coordinates a pair at the threshold is missed with
probability (1 - 0.75 ** ROWS) ** BANDS, 2e-6.

Classes have numbers of their own, given in the order of their least id, so that ids are only carried along: any
64-bit id may stand, or none. A class's text is read from one row, known by its id and the hash of its text.

Defined cases: null, empty and blank texts have an empty set and link with
nothing; fewer than five words make one shingle; repeated rows share a class;
rows of one id with different texts are judged one by one; a row with a null id
ranks behind every id: its component is that of a near text with an id, else
null, and it is kept if its text stands for its component; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_made, id_text, ids, made, small_batches, written

WORDS = 5
BANDS = 48
ROWS = 5
#: Link where PERCENT * union <= 100 * intersection.
PERCENT = 75
BLOCK = 64
#: Blocks of a bucket that meet as many in one task.
GROUP = 16
#: Classes of one salt, and the least number of salts.
CLASSES_PER_SALT = 1 << 17
SALTS = 64
#: Cells of the counts that bound how many shingles beyond the pivot's two members share.
CELLS = 256
BROADCAST_IDS = 1_000_000
#: Words whose hashes a worker keeps, and the most bytes of each.
KNOWN = 1 << 18
LONGEST = 64
_K = BANDS * ROWS


class _Hashes(dict):
    """Words' hashes, the latest KNOWN of words up to LONGEST bytes kept."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = out
        return out


_hash_of = _Hashes().__getitem__


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words in order; as bytes, A-Z alone are lower-cased and blanks are \\x20 and \\x09-\\x0D."""
    words = text.encode().lower().split()
    return np.fromiter(map(_hash_of, words), np.uint64, len(words))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles; one of all words if there are fewer."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        out = _mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n] + np.uint64(k + 1))
    if len(h) < WORDS:
        out ^= np.uint64(len(h))
    return np.unique(out)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    return x


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit values: odd multiplications and xor-shifts, in place."""
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x


def signature(hashes: np.ndarray) -> np.ndarray:
    """All coordinates: the least pi(sigma(x) + k * step) over the set, for each k. The odd step makes k walk the whole circle."""
    sigma = (_mix64(hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    out = np.full(_K, 0xFFFFFFFF, np.uint32)
    shifts = (np.arange(_K, dtype=np.uint32) * np.uint32(0x9E3779B1))[:, None]
    for i in range(0, len(sigma), 512):
        np.minimum(out, _pi(sigma[None, i : i + 512] + shifts).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r] + np.uint64(1))
    return key.view(np.int64)


def _digest_of(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingles(t) for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": ids(pdf["doc_id"]), "th": pdf["th"], "n_shingles": [len(s) for s in sets], "digest": [_digest_of(s) for s in sets]})


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingles(t) for t in pdf["text"]]
        own = [_digest_of(s) == bytes(d) for s, d in zip(sets, pdf["digest"], strict=True)]
        sets = [s for s, ok in zip(sets, own, strict=True) if ok]
        sigs = [signature(s) for s in sets]
        yield pd.DataFrame({"cls": pdf["cls"][own], "n": [len(s) for s in sets], "bands": [band_keys(s) for s in sigs]})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingles(t) for t in pdf["text"]]
        own = [_digest_of(s) == bytes(d) for s, d in zip(sets, pdf["digest"], strict=True)]
        yield pd.DataFrame({"cls": pdf["cls"][own], "hashes": [s.tobytes() for s, ok in zip(sets, own, strict=True) if ok]})


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs with both sets: those at or above the threshold."""
    for pdf in batches:
        keep = []
        for a, b in zip(pdf["set_a"], pdf["set_b"], strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pdf.loc[np.array(keep, bool), ["a", "b"]]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))


def _sized(df: DataFrame) -> DataFrame:
    """To be broadcast only if a count shows that its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, digest and text of the row that stands for each class; more than one where that row is repeated."""
    wanted = _sized(classes.select("cls", "digest", F.col("doc_id").alias("id"), F.col("th").alias("hash")))
    rows = _keyed(docs)
    return rows.join(wanted, (rows["th"] == wanted["hash"]) & rows["doc_id"].eqNullSafe(wanted["id"])).select("cls", "digest", "text")


def _once(rows: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """One row of each class."""
    rows = written(rows, name)
    return rows if classes.filter("times > 1").isEmpty() else written(rows.dropDuplicates(["cls"]), name)


def _salt(c: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(salts)).cast("int").alias("salt")


def _with_sets(pairs: DataFrame, docs: DataFrame, classes: DataFrame, salts: int, name: str) -> DataFrame:
    """Pairs (a, b), a pivot and a member, with both full sets; a pivot's pairs are dealt by salts of their members."""
    pairs = written(pairs.select("a", "b", _salt("b", salts)), name)
    own = written(classes.join(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls"), name)
    sets = _once(_texts(docs, own).mapInPandas(_hashed, "cls long, hashes binary"), own, name)
    left = pairs.select("a", "salt").distinct().join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("set_a")), "a")
    right = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("set_b"))
    return pairs.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "set_a", "set_b")


def _against_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each member's set as bits over the pivot's set, and the shingles that the pivot lacks."""
    for pdf in batches:
        masks, extras = [], []
        for a, b in zip(pdf["set_a"], pdf["set_b"], strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            shared = x[at] == y
            bits = np.zeros(len(x), bool)
            bits[at[shared]] = True
            masks.append(np.packbits(bits).tobytes())
            extras.append(y[~shared].tobytes())
        yield pd.DataFrame({"p": pdf["a"], "cls": pdf["b"], "mask": masks, "extra": extras})


def _could(a: str, b: str) -> Column:
    """Sizes that allow a link."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp): the smallest node reachable over edges (a, b), by alternating large-star and small-star steps on written tables."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _are_stars(now):
        # large star: a node's larger neighbours move to its least neighbour
        near = both(now)
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = near.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # small star: a node and its smaller neighbours move to the least of these
        large = large.filter("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        new = written(small.select("e.a", "e.b").filter("a <> b").distinct(), name)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _are_stars(edges: DataFrame) -> bool:
    """True if every edge leads straight to a root: no node has two, none stands on both sides."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("s"))
    bad = sides.groupBy("s.node").agg(F.sum("s.up").alias("up"), F.max("s.root").alias("root")).filter("up > 1 or (up = 1 and root = 1)")
    return bad.isEmpty()


def _block_links(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row holds two blocks of a bucket: links between their components, as many as it takes to join those that the blocks join."""
    for pdf in rows:
        found = []
        for x, y in zip(pdf["left"], pdf["right"], strict=True):
            cls, comp, n, mask, extra, cells = zip(*map(_members, (x, y)), strict=True)
            for i in range(len(cls[0])):
                open_ = (comp[1] != comp[0][i]) & (100 * np.minimum(n[1], n[0][i]) >= PERCENT * np.maximum(n[1], n[0][i]))
                j = np.flatnonzero(open_)
                both = np.bitwise_count(mask[1][j] & mask[0][i]).sum(1, dtype=np.int64)
                need = PERCENT * (n[1][j] + n[0][i])
                could = (100 + PERCENT) * (both + np.minimum(cells[1][j], cells[0][i]).sum(1)) >= need
                for k in np.flatnonzero(could):
                    if comp[1][j[k]] == comp[0][i]:
                        continue
                    exact = both[k] + len(np.intersect1d(extra[0][i], extra[1][j[k]], assume_unique=True))
                    if (100 + PERCENT) * exact >= need[k]:
                        found.append(tuple(sorted((int(cls[0][i]), int(cls[1][j[k]])))))
                        old, new = comp[1][j[k]], comp[0][i]
                        for c in comp:
                            c[c == old] = new
        yield pd.DataFrame(sorted(set(found)), columns=["a", "b"], dtype="int64")


def _members(block: list) -> tuple:
    cls, comp, n = (np.array([m[k] for m in block], np.int64) for k in ("cls", "comp", "n"))
    mask = np.frombuffer(b"".join(m["mask"] for m in block), np.uint8).reshape(len(block), -1)
    extra = [np.frombuffer(m["extra"], np.uint64) for m in block]
    cells = np.stack([np.bincount((e % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) for e in extra])
    return cls, comp, n, mask, extra, cells


def groups(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    with small_batches(docs.sparkSession):
        rows, classes = _grouped(docs)
    known = classes.select("digest", "component_id", "stands")
    rows = rows.join(known, "digest", "left").withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & F.coalesce("stands", F.lit(True)))
    return rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, n_shingles, digest), and classes (digest, cls, doc_id, th, times, component_id, stands)."""
    digests = written(_keyed(docs).withColumn("doc_id", id_text("doc_id")).mapInPandas(_digest, "doc_id long, th long, n_shingles long, digest binary"), "near_digests")
    # a class per distinct set; the row of smallest id stands for it, and `times` tells how often that row is repeated
    same = digests.filter("digest is not null").groupBy("digest", "doc_id", "th").agg(F.count("*").alias("times"))
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "times")
    numbered = same.groupBy("digest").agg(F.min(least).alias("least")).select("digest", "least.*").orderBy("no_id", "doc_id", "digest")
    classes = written(numbered.withColumn("cls", F.monotonically_increasing_id()), "near_classes")
    begun = made()
    salts = max(SALTS, classes.count() // CLASSES_PER_SALT)
    signed = _once(_texts(docs, classes).mapInPandas(_signed, "cls long, n long, bands array<long>"), classes, "near_signed")

    bands = signed.select("cls", "n", F.explode("bands").alias("key"), _salt("cls", salts))
    part = bands.groupBy("key", "salt").agg(F.count("*").alias("size"), F.min(F.struct("cls", "n")).alias("pivot"))
    pivots = part.groupBy("key").agg(F.sum("size").alias("size"), F.min("pivot").alias("pivot"), F.collect_list("salt").alias("salts")).filter("size > 1")
    pivots = pivots.select("key", F.explode("salts").alias("salt"), "size", F.col("pivot.cls").alias("p"), F.col("pivot.n").alias("pn"))
    members = written(bands.join(pivots, ["key", "salt"]), "near_members")
    pairs = members.filter("cls <> p").filter(_could("n", "pn")).select(F.col("p").alias("a"), F.col("cls").alias("b")).distinct()
    links = written(_with_sets(pairs, docs, classes, salts, "near_pairs").mapInPandas(_verify, "a long, b long"), "near_links")
    comps = components(links, "near_components")

    # buckets that the pivot has not settled
    placed = members.filter("size > 2").join(comps, members["cls"] == comps["node"], "left").select("key", "salt", "cls", "n", "p", F.coalesce("comp", "cls").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.collect_set("salt").alias("salts")).filter("lo <> hi").select("key", F.explode("salts").alias("salt"))
    rest = written(placed.join(mixed, ["key", "salt"]).filter("cls <> p"), "near_rest")
    own = rest.select(F.col("p").alias("a"), F.col("cls").alias("b")).distinct()
    against = written(_with_sets(own, docs, classes, salts, "near_own").mapInPandas(_against_pivot, "p long, cls long, mask binary, extra binary"), "near_against")
    blocks = _blocks(rest.join(against, ["p", "cls"]))
    more = written(blocks.mapInPandas(_block_links, "a long, b long").distinct(), "near_more_links")
    if not more.isEmpty():
        comps = components(links.unionByName(more), "near_components")
    # classes are numbered by their least ids, so the root of a component has its least id and stands for it
    roots = _sized(classes.join(comps.select(F.col("comp").alias("cls")).distinct(), "cls").select(F.col("cls").alias("comp"), F.col("doc_id").alias("component_id")))
    placed = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").join(roots, "comp", "left")
    lone = F.col("comp").isNull()
    named = placed.select("digest", "cls", "doc_id", "th", "times", F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), lone.alias("stands"))
    classes = written(named, "near_named")
    drop_made(docs.sparkSession, begun, but_last=True)
    return digests, classes


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, with docs' own columns: that of smallest id, of equal ids that of smallest digest, of equal rows that of smallest JSON form. Every row without words is a group of its own."""
    with small_batches(docs.sparkSession):
        digests, classes = _grouped(docs)
    chosen = classes.filter("stands").select(F.col("doc_id").alias("_kept_id"), F.col("th").alias("_kept_th"), (F.col("times") > 1).alias("_kept_twice"))
    wordless = digests.filter("digest is null").select(F.col("doc_id").alias("_kept_id"), F.col("th").alias("_kept_th"), F.lit(False).alias("_kept_twice")).distinct()
    keys = written(chosen.unionByName(wordless), "near_kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    kept = lambda twice: rows.join(k := _sized(keys.filter(F.col("_kept_twice") == twice)), (rows["hash"] == k["_kept_th"]) & rows["id"].eqNullSafe(k["_kept_id"]), "left_semi")
    once = kept(False)
    if not keys.filter("_kept_twice").isEmpty():
        once = once.unionByName(kept(True).groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row", "id", "hash"))
    return once.select("row.*")


def _blocks(rest: DataFrame) -> DataFrame:
    """(left, right): for each bucket the pairs of blocks that hold different components.

    Components of BLOCK members and more are cut into blocks of their own; smaller ones share blocks, each whole in one.
    A bucket's blocks fall into groups of about GROUP; every two groups, and each with itself, are a key of their own.
    """
    sizes = rest.groupBy("key", "comp").agg(F.count("*").alias("m"), F.collect_set("salt").alias("salts"))
    totals = sizes.groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("m") < BLOCK, F.col("m"))), F.lit(0)).alias("small"), F.sum("m").alias("total"))
    big = F.col("m") >= BLOCK
    plan = sizes.join(totals, "key").select(
        "key", "comp", F.explode("salts").alias("salt"), big.alias("big"),
        F.ceil(F.when(big, F.col("m")).otherwise(F.col("small")) / BLOCK).cast("long").alias("cuts"),
        F.ceil(F.col("total") / (BLOCK * GROUP)).cast("int").alias("groups"),
    )
    cut = rest.join(plan, ["key", "comp", "salt"]).select(
        "key", "groups", F.struct("cls", "comp", "n", "mask", "extra").alias("m"),
        F.when(F.col("big"), F.col("comp")).otherwise(F.lit(-1)).alias("owner"),
        F.pmod(F.xxhash64(F.when(F.col("big"), F.col("cls")).otherwise(F.col("comp"))), F.col("cuts")).alias("cut"),
    )
    blocks = written(cut.groupBy("key", "groups", "owner", "cut").agg(F.collect_list("m").alias("members")), "near_blocks")
    blocks = blocks.withColumn("g", F.pmod(F.xxhash64("owner", "cut"), F.col("groups")).cast("int"))
    left = blocks.select("key", F.col("g").alias("lo"), F.explode(F.expr("sequence(g, groups - 1)")).alias("hi"), F.col("owner").alias("o1"), F.col("cut").alias("c1"), F.col("members").alias("left"))
    right = blocks.select("key", F.explode(F.expr("sequence(0, g)")).alias("lo"), F.col("g").alias("hi"), F.col("owner").alias("o2"), F.col("cut").alias("c2"), F.col("members").alias("right"))
    both_small = (F.col("o1") == F.col("o2")) & (F.col("o1") == -1)
    once = (F.col("lo") < F.col("hi")) | (F.col("o1") < F.col("o2")) | (both_small & (F.col("c1") <= F.col("c2")))
    return left.join(right, ["key", "lo", "hi"]).filter(((F.col("o1") != F.col("o2")) | both_small) & once).select("left", "right")
