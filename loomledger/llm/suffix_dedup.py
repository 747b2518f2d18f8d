"""Exact substring deduplication by blockwise suffix sorting with a difference cover.

Every byte that lies in a LENGTH-byte string which also starts earlier (smaller
doc_id, or the same document further left) is removed.

1. Suffixes are dealt to buckets by content: a suffix's bucket is the least hash
   of the GRAM-byte strings inside its first LENGTH bytes, so equal strings share
   a bucket and neighbours mostly do too (a run of suffixes is one row).
2. Buckets whose gram occurs once in the corpus hold no repeat and are dropped;
   the bytes of the other runs travel to their bucket.
3. A task takes one block of buckets at a time. Equal runs fold into the earliest.
   The rest is sorted by bucket and first eight bytes; longer ties are resolved
   by ranks of the difference-cover sample COVER modulo PERIOD, computed before
   by doubling: for any two residues some shift below PERIOD lands both on the
   sample. Neighbours in the order are then compared byte for byte.
4. Buckets of more than BUCKET runs are cut; each cut keeps its own first copy
   of every string, and the cuts' first copies meet under the string's digest.

Memory is bounded by the block, not by the corpus or a bucket. Only runs of
repeated grams are shuffled with their bytes.

Defined cases: null and empty texts have no bytes and lose none; matches never
cross documents; a null id counts as larger than every id; rows of one id and
text are one document and answered alike; rows of one id and different texts are
ordered by their text's hash; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

LENGTH = 100
GRAM = 32
#: A perfect difference set; each residue modulo 7 is the difference of two members.
PERIOD = 7
COVER = (0, 1, 3)
#: Runs of one bucket beyond which it is cut.
BUCKET = 2000
#: Bytes that a task hashes or sorts at once, and suffixes that one run may hold.
PIECE = 1 << 20
BLOCK = 3 << 20
RUN = 512

_PACKED = "doc_id long, id long, mark long, packed binary"
_GRAMS = LENGTH - GRAM + 1
_NO_ID = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(17))


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over every `width` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, by doubling; GRAM is a power of two."""
    h, have = _BYTES[data], 1
    with np.errstate(over="ignore"):
        while have < GRAM:
            h = h[:-have] * np.uint64(pow(int(_MIX), have, 1 << 64)) + h[have:]
            have *= 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))) | np.uint64(1)


def _pieces(offsets: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to): the windows from..to-1 of texts, at most about PIECE of them together."""
    now, size = [], 0
    for t, n in enumerate(np.diff(offsets) - LENGTH + 1):
        lo = 0
        while lo < n:
            hi = min(int(n), lo + PIECE)
            now.append((t, lo, hi))
            size += hi - lo + LENGTH
            lo = hi
            if size >= PIECE:
                yield now
                now, size = [], 0
    if now:
        yield now


def _windows(data: np.ndarray, offsets: np.ndarray, piece: list[tuple[int, int, int]]):
    """The piece's bytes end to end, gram hashes, the bucket of every window (0: crosses texts), and each part's first place."""
    parts = [data[offsets[t] + lo : offsets[t] + hi + LENGTH - 1] for t, lo, hi in piece]
    sizes = np.array([len(p) for p in parts])
    first = np.concatenate([[0], np.cumsum(sizes)])
    grams = _gram_hashes(np.concatenate(parts))
    bucket = _sliding(grams, _GRAMS, np.minimum)
    for a in first[1:-1]:
        bucket[max(0, a - LENGTH + 1) : a] = 0
    return grams, bucket, first


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column and each value's offsets."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time, so that unpacked texts take little memory."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for shuffles that carry whole texts."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in _sliced(batches):
        data, offsets = _buffers(batch.column("text"))
        blobs = pa.array([pack(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "id", "mark")] + [blobs], ["doc_id", "id", "mark", "packed"])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    texts = [unpack(x.as_buffer()) for x in column]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _grams_used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): the grams that are some window's least, with their places counted within the piece."""
    for batch in batches:
        data, offsets = _buffers(batch.column("text"))
        for piece in _pieces(offsets):
            grams, bucket, _ = _windows(data, offsets, piece)
            padded = np.concatenate([np.zeros(_GRAMS - 1, np.uint64), bucket, np.zeros(_GRAMS - 1, np.uint64)])
            used = grams[grams == _sliding(padded, _GRAMS, np.maximum)[: len(grams)]]
            value, n = np.unique(used, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["bucket", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, mark, run): neighbouring suffixes of one bucket; run packs first place and count."""
    for batch in batches:
        data, offsets = _buffers(batch.column("text"))
        ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "mark"))
        for piece in _pieces(offsets):
            _, bucket, first = _windows(data, offsets, piece)
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            size = np.diff(np.append(edge, len(bucket)))
            cuts = -(-size // RUN)
            start = np.repeat(edge, cuts) + (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * RUN
            count = np.diff(np.append(start, len(bucket)))
            real = bucket[start] != 0
            start, count = start[real], count[real]
            part = np.searchsorted(first, start, side="right") - 1
            text = np.array([t for t, _, _ in piece])[part]
            place = start - first[part] + np.array([lo for _, lo, _ in piece])[part]
            arrays = [bucket[start].view(np.int64), ids[text], marks[text], place * 1024 + count]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["bucket", "id", "mark", "run"])


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of a document with the bytes that its suffixes compare."""
    for batch in _sliced(batches):
        data, offsets = _unpacked(batch.column("packed"))
        ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "mark"))
        runs = batch.column("runs")
        owner = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy(zero_copy_only=False))
        flat = runs.flatten()
        bucket, cuts, run = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        for lo in range(0, len(run), 20_000):
            own, packed = owner[lo : lo + 20_000], run[lo : lo + 20_000]
            place, count = packed // 1024, packed % 1024
            begin = offsets[own] + place
            blobs = pa.array([data[a:b].tobytes() for a, b in zip(begin, begin + count + LENGTH - 1, strict=True)], pa.binary())
            spread = ((place * 31 + ids[own]).view(np.uint64) * _MIX >> np.uint64(20)).view(np.int64)
            cut = spread % cuts[lo : lo + 20_000]
            arrays = [bucket[lo : lo + 20_000], cut, cuts[lo : lo + 20_000] > 1, ids[own], marks[own], place]
            names = ["bucket", "cut", "more", "id", "mark", "place"]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), blobs], [*names, "bytes"])


def cover_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank by `depth` bytes or more of each place in the cover (place modulo PERIOD in COVER); -1 elsewhere. By doubling in steps of PERIOD, which stays on the cover."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(PERIOD):
        word = (word << np.uint64(8)) | padded[k : k + n]
    sample = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.full(n, -1, np.int64)
    rank[sample] = np.unique(word[sample], return_inverse=True)[1]
    have = PERIOD
    while have < depth:
        after = np.full(len(sample), -1, np.int64)
        inside = sample + have < n
        after[inside] = rank[sample[inside] + have]
        rank[sample] = np.unique(rank[sample] * (n + 2) + after + 1, return_inverse=True)[1]
        have *= 2
    return rank


#: Shift that lands both residues on the cover.
_SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def equal_strings(text: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of `at` whose LENGTH bytes equal another's in the same bucket, and a class number for each."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(len(at), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[at + k]
    order = np.lexsort((word, bucket))
    at, bucket, word = at[order], bucket[order], word[order]
    same = (bucket[1:] == bucket[:-1]) & (word[1:] == word[:-1])
    tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    group = np.cumsum(np.concatenate([[True], ~same]))[tied]
    at = at[tied]
    if not len(at):
        return at, at
    rank = cover_ranks(np.concatenate([text, np.zeros(PERIOD, np.uint8)]), LENGTH)
    base = np.int64(rank.max() + 2)
    residue = at % PERIOD
    of = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    before = np.zeros(len(at), np.int64)  # in each place's group, those that sort before it
    for a in range(PERIOD):
        for b in range(PERIOD):
            shift = _SHIFT[a, b]
            theirs = np.sort(group[of[b]] * base + rank[at[of[b]] + shift])
            own = group[of[a]] * base
            before[of[a]] += np.searchsorted(theirs, own + rank[at[of[a]] + shift]) - np.searchsorted(theirs, own)
    order = np.lexsort((before, group))
    at, group = at[order], group[order]
    same = group[1:] == group[:-1]
    for k in range(LENGTH):  # neighbours, byte for byte
        left = np.flatnonzero(same)
        same[left] = text[at[left] + k] == text[at[left + 1] + k]
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return at[twice], np.cumsum(np.concatenate([[True], ~same]))[twice]


def _block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Repeats found among the runs of whole buckets (or cuts): spans to remove; for cut buckets also each string's first place."""
    bucket, cut, more, ids, marks, place = (rows.column(c).to_numpy() for c in ("bucket", "cut", "more", "id", "mark", "place"))
    data, offsets = _buffers(rows.column("bytes").combine_chunks())
    key = np.cumsum(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (cut[1:] != cut[:-1])]))
    digest = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, len(key))
    size = np.diff(offsets)
    order = np.lexsort((place, marks, ids, size, digest, key))
    first = np.concatenate([[True], np.any([np.diff(x[order]) != 0 for x in (key, digest, size)], axis=0)])
    copies, kept = order[~first], np.sort(order[first])
    spans = [(ids[copies], marks[copies], place[copies], place[copies] + size[copies])]

    text = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in kept])
    starts = np.cumsum(size[kept]) - size[kept]
    count = size[kept] - LENGTH + 1
    owner = np.repeat(np.arange(len(kept)), count)
    at = starts[owner] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found, cls = equal_strings(text, at, key[kept][owner])
    own = kept[np.searchsorted(starts, found, side="right") - 1]
    where = place[own] + found - starts[np.searchsorted(starts, found, side="right") - 1]
    order = np.lexsort((where, marks[own], ids[own], cls))
    later = np.concatenate([[False], np.diff(cls[order]) == 0]) if len(order) else np.zeros(0, bool)
    own, where, found = own[order], where[order], found[order]
    spans.append((ids[own][later], marks[own][later], where[later], where[later] + LENGTH))

    spans = [np.concatenate(x) for x in zip(*spans, strict=True)]
    order = np.lexsort((spans[2], spans[1], spans[0]))  # join what touches within a document
    i, m, a, b = (x[order] for x in spans)
    if len(i):
        new = np.concatenate([[True], (i[1:] != i[:-1]) | (m[1:] != m[:-1]) | (a[1:] > a[:-1] + LENGTH)])
        at_new = np.flatnonzero(new)
        i, m, a, b = i[at_new], m[at_new], a[at_new], np.maximum.reduceat(b, at_new)
    none = pa.nulls(len(i), pa.binary(16))
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(m, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), none.cast(pa.binary())], ["id", "mark", "from", "to", "string"])

    if more[kept].any():
        repeated = np.zeros(len(text), bool)
        repeated[found[later]] = True
        for k in range(0, len(at), 50_000):
            o, p = owner[k : k + 50_000], at[k : k + 50_000]
            pick = more[kept[o]] & ~repeated[p]
            o, p = kept[o[pick]], p[pick]
            w = place[o] + p - starts[np.searchsorted(starts, p, side="right") - 1]
            strings = pa.array([xxhash.xxh3_128_digest(text[x : x + LENGTH]) for x in p], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids[o]), pa.array(marks[o]), pa.array(w), pa.array(w + LENGTH), strings], ["id", "mark", "from", "to", "string"])


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the sorted partition into blocks of whole buckets and handle one at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("bytes").nbytes
        if size < BLOCK:
            continue
        rows = pa.Table.from_batches(held)
        last = rows.slice(rows.num_rows - 1, 1)
        bucket, cut = rows.column("bucket").to_numpy(), rows.column("cut").to_numpy()
        open_from = int(np.argmax((bucket == last.column("bucket")[0].as_py()) & (cut == last.column("cut")[0].as_py())))
        if open_from:  # the last bucket may go on in the next batch
            yield from _block(rows.slice(0, open_from))
            held, size = rows.slice(open_from).to_batches(), rows.slice(open_from).nbytes
    if held and sum(b.num_rows for b in held):
        yield from _block(pa.Table.from_batches(held))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join each document's spans and cut them out."""
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    for batch in _sliced(batches):
        data, offsets = _unpacked(batch.column("packed"))
        found = batch.column("spans")
        count = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = found.flatten()
        lo, hi = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        ends = np.cumsum(count)
        spans, kept = [], []
        for t in range(len(count)):
            text = data[offsets[t] : offsets[t + 1]]
            if not count[t]:
                spans.append([])
                kept.append(text.tobytes())
                continue
            a, b = lo[ends[t] - count[t] : ends[t]], hi[ends[t] - count[t] : ends[t]]
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            a, b = a[new], np.append(b[new[1:] - 1], b[-1])
            spans.append([{"from": int(x), "to": int(y)} for x, y in zip(a, b, strict=True)])
            bounds = zip(np.concatenate([[0], b]), np.append(a, len(text)), strict=True)
            kept.append(b"".join(text[x:y].tobytes() for x, y in bounds))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, spans removed (maximal, bytes from..to), kept (the remaining bytes)."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    plain = ids.isEmpty()  # else rows of one id are told apart by their text
    mark = F.lit(0).cast("long") if plain else F.xxhash64("text")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), mark.alias("mark"), "text")
    once = rows if plain else rows.dropDuplicates(["id", "mark"])
    once = once.filter(F.octet_length("text") >= LENGTH)

    counted = once.select("text").mapInArrow(_grams_used, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter("n > 1")
    counted = written(counted.select("bucket", F.ceil(F.col("n") / BUCKET).cast("long").alias("cuts")), "suffix_buckets")
    runs = once.mapInArrow(_runs, "bucket long, id long, mark long, run long").join(counted, "bucket")
    by_doc = runs.groupBy("id", "mark").agg(F.collect_list(F.struct("bucket", "cuts", "run")).alias("runs"))
    parts = once.mapInArrow(_packed, _PACKED).join(by_doc, ["id", "mark"]).select("id", "mark", "packed", "runs").mapInArrow(_with_bytes, "bucket long, cut long, more boolean, id long, mark long, place long, bytes binary")
    blocks = parts.repartition("bucket", "cut").sortWithinPartitions("bucket", "cut")
    found = written(blocks.mapInArrow(_sorted_blocks, "id long, mark long, from long, to long, string binary"), "suffix_found")

    # strings of cut buckets: all but the first of the cuts' first places
    firsts = found.filter("string is not null")
    place = F.struct("id", "mark", "from")
    least = written(firsts.groupBy("string").agg(F.min(place).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "suffix_firsts")
    later = firsts.join(least, "string").filter(place > F.col("least")).select("id", "mark", "from", "to")
    spans = found.filter("string is null").select("id", "mark", "from", "to").unionByName(later)
    by_doc = spans.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    rows = rows.mapInArrow(_packed, _PACKED)
    whole = rows.join(by_doc, (rows["id"] == by_doc["_id"]) & (rows["mark"] == by_doc["_mark"]), "left").select("doc_id", "packed", "spans")
    return whole.mapInArrow(_keep, "doc_id long, n_bytes long, spans array<struct<from: long, to: long>>, kept binary")
