"""Periodic runs of words by Crochemore's partition refinement.

Places of a text are kept in classes: two places share a class at length l if the same l words stand at both. Classes
of length l + 1 come from those of length l by splitting each by the class of the following place. Only small classes
split others: of the classes that one class fell into, all but the largest (smaller-half strategy), so a place is
moved at most log n times. Each class is a list of places in order. If the next place of a class lies exactly l
further on, a square of half-length l begins there, and its half is primitive. Squares of one half-length at
successive places are merged into runs, whose smallest period is then that length.

A link between neighbours is written down with the length at which it arose; when it is broken, or at the end, one
comparison tells whether it stood at the length equal to its distance. No pass over all links is made per length.

Many texts are refined at once, as one row of places in which each text ends in a separator of its own, so that a
length costs a few numpy calls for all of them. Lengths beyond a third of a text are not looked at, since a run
holds its period three times. A text is never cut: one beyond BATCH words is a batch by itself, in memory of some
hundred bytes a word.

Defined cases: null, empty and blank texts have no words, no run, and the hash of the empty string; repeated rows and
rows of one id are judged one by one; a row without an id keeps its words as they are; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ._common import id_text, ids

#: A run holds so many words and so many periods at least.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words refined together.
BATCH = 1 << 20
#: Up to so many places of a length are split one by one.
FEW = 16
#: The characters that part words, all but the blank.
_SPACES = "\t\n\v\f\r"

RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def words_of(text: str | None, doc_id: int | None) -> list[str]:
    """The words [^\\x20\\x09-\\x0D]+ of a text; where crc32 of the id says so, those from a place on repeat the first p there."""
    text = text or ""
    for c in _SPACES:
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    n = len(words)
    if not n or doc_id is None:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


class Refinement:
    """Classes of equal factors over a row of places, each a list in order of place."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray, limit: np.ndarray):
        """codes: a number per word, equal within one text for equal words; owner: the text of a place; limit: the largest length for it."""
        self.n = n = len(codes)
        self.limit = limit
        self.bits = max(1, int(n).bit_length())
        self.cls = np.zeros(n + 1, np.int64)  # place n stands for none
        self.next = np.full(n + 1, n, np.int64)
        self.prev = np.full(n + 1, n, np.int64)
        self.birth = np.ones(n + 1, np.int64)
        self.old = np.zeros(n + 1, np.int64)
        self.head = np.zeros(n + 1, np.int64)
        self.size = np.zeros(n + 1, np.int64)
        self.touched = np.zeros(n + 1, bool)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(codes, kind="stable")
        fresh = np.r_[True, codes[order[1:]] != codes[order[:-1]]]
        self._link(order, fresh)
        begin = np.flatnonzero(fresh)
        self.classes = len(begin)
        self.cls[order] = np.cumsum(fresh) - 1
        self.head[: self.classes] = order[begin]
        self.size[: self.classes] = np.diff(np.r_[begin, n])
        # of a text's classes all but the largest are small
        texts = owner[order[begin]]
        by = np.lexsort((self.size[: self.classes], texts))
        largest = by[np.r_[texts[by][1:] != texts[by][:-1], True]]
        small = np.ones(self.classes, bool)
        small[largest] = False
        self.small = order[small[self.cls[order]]]

    def _link(self, order: np.ndarray, fresh: np.ndarray) -> None:
        """Places in order become lists that begin where fresh."""
        last = np.r_[fresh[1:], True]
        self.next[order] = np.where(last, self.n, np.r_[order[1:], self.n])
        self.prev[order] = np.where(fresh, self.n, np.r_[self.n, order[:-1]])

    def _by(self, *keys: np.ndarray) -> list[np.ndarray]:
        """The keys in the order of the first, then the second and third. Where they fit one number, that is sorted."""
        if len(keys) * self.bits <= 62:
            packed = keys[0]
            for k in keys[1:]:
                packed = packed << self.bits | k
            packed = np.sort(packed)
            mask = (1 << self.bits) - 1
            return [packed >> self.bits * i & mask if i else packed & mask for i in range(len(keys) - 1, 0, -1)] + [packed & mask]
        at = np.lexsort(keys[::-1])
        return [k[at] for k in keys]

    def _broken(self, at: np.ndarray, to: np.ndarray, length: np.ndarray | int) -> None:
        """Links that end: those that stood at the length of their distance begin a square."""
        d = to - at
        found = (to < self.n) & (d >= self.birth[at]) & (d <= length)
        if found.any():
            self.squares.append((at[found], d[found]))

    def step(self, length: int) -> bool:
        """From classes of a length to those of the next; False if nothing is left to split."""
        j = self.small - 1
        j = j[j >= 0]
        j = j[(self.size[self.cls[j]] > 1) & (self.limit[j] > length)]
        if len(j) <= FEW:
            self.small = np.array(self._split_few(sorted(j.tolist()), length), np.int64)
            return len(j) > 0
        cls, nxt, prv, none = self.cls, self.next, self.prev, self.n
        d, j = self._by(cls[j], j)
        self.old[j] = old = nxt[j]
        # take the moved places out of their lists
        self.touched[j] = True
        firsts, lasts = j[~self.touched[prv[j]]], j[~self.touched[old]]
        p, q = prv[firsts], nxt[lasts]
        self.touched[j] = False
        some = p < none
        self._broken(p[some], nxt[p[some]], length)
        self.birth[p[some]] = length + 1
        nxt[p], prv[q] = q, p
        self.head[cls[firsts[~some]]] = q[~some]
        nxt[none] = prv[none] = none
        # lists of their own for those with equal class of the following place
        d, c, j = self._by(d, cls[j + 1], j)
        new_parent = np.r_[True, d[1:] != d[:-1]]
        fresh = new_parent | np.r_[True, c[1:] != c[:-1]]
        self._link(j, fresh)
        was, now = self.old[j], nxt[j]
        moved = was != now
        self._broken(j[moved], was[moved], length)
        self.birth[j[moved]] = length + 1
        # sizes: groups of a parent and what stays of it
        begin = np.flatnonzero(fresh)
        count = np.diff(np.r_[begin, len(j)])
        parent = d[begin]
        starts = np.flatnonzero(new_parent[begin])
        gone = np.add.reduceat(count, starts)
        owners = parent[starts]
        stays = self.size[owners] - gone
        of = np.cumsum(new_parent[begin]) - 1
        most = np.maximum.reduceat(count, starts)
        # the largest of each parent's parts: what stays, or the first of its largest groups
        rest_is_largest = stays >= most
        is_most = (count == most[of]) & ~rest_is_largest[of]
        at_most = np.flatnonzero(is_most)
        first_most = at_most[np.r_[True, of[at_most][1:] != of[at_most][:-1]]] if len(at_most) else at_most
        largest = np.zeros(len(count), bool)
        largest[first_most] = True
        small_rest = owners[~rest_is_largest & (stays > 0)]
        walked = self._members(small_rest)
        # a group takes its parent's name where nothing stays, else all groups get new ones
        keeps = largest & (stays[of] == 0)
        name = np.where(keeps, parent, 0)
        fresh_names = np.flatnonzero(~keeps)
        name[fresh_names] = self.classes + np.arange(len(fresh_names))
        self.classes += len(fresh_names)
        self.size[owners] = stays
        self.size[name] = count
        self.head[name] = j[begin]
        group = np.cumsum(fresh) - 1
        cls[j] = name[group]
        self.small = np.r_[j[~largest[group]], walked]
        return True

    def _split_few(self, places: list[int], length: int) -> list[int]:
        """step() for few places, where calls on arrays would cost more than the places themselves."""
        cls, nxt, prv, birth, none = self.cls, self.next, self.prev, self.birth, self.n
        parents: dict[int, dict[int, list[int]]] = {}
        for j in places:
            parents.setdefault(int(cls[j]), {}).setdefault(int(cls[j + 1]), []).append(j)
        small: list[int] = []
        for parent, parts in parents.items():
            moved = sorted(j for part in parts.values() for j in part)
            old = {j: int(nxt[j]) for j in moved}
            for j in moved:
                p, q = int(prv[j]), int(nxt[j])
                if p < none:
                    self._broken_one(p, j, length)
                    nxt[p], birth[p] = q, length + 1
                else:
                    self.head[parent] = q
                if q < none:
                    prv[q] = p
            stays = int(self.size[parent]) - len(moved)
            largest = max(parts.values(), key=len)
            rest_is_largest = stays >= len(largest)
            if stays and not rest_is_largest:
                small += self._members(np.array([parent])).tolist()
            self.size[parent] = stays
            for part in parts.values():
                for j, p, q in zip(part, [none, *part], [*part[1:], none], strict=False):
                    prv[j] = p
                    if old[j] != q:
                        self._broken_one(j, old[j], length)
                        nxt[j], birth[j] = q, length + 1
                if rest_is_largest or part is not largest:
                    small += part
                name = parent
                if stays or part is not largest:
                    name = self.classes
                    self.classes += 1
                cls[part] = name
                self.size[name], self.head[name] = len(part), part[0]
        return small

    def _broken_one(self, at: int, to: int, length: int) -> None:
        if to < self.n and self.birth[at] <= to - at <= length:
            self.squares.append((np.array([at]), np.array([to - at])))

    def _members(self, classes: np.ndarray) -> np.ndarray:
        out: list[int] = []
        none, nxt = self.n, self.next
        for at in self.head[classes].tolist():
            while at != none:
                out.append(at)
                at = int(nxt[at])
        return np.array(out, np.int64)

    def ended(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """All squares (place, half-length), after the last length looked at."""
        at = np.flatnonzero(self.next[: self.n] < self.n)
        self._broken(at, self.next[at], np.minimum(length, self.limit[at]))
        if not self.squares:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([s[0] for s in self.squares]), np.concatenate([s[1] for s in self.squares])


def runs_in(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Per text, given as a number per word: its runs (start, length, period) by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not (sizes >= LEAST_WORDS).any():
        return found
    base = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    words = np.concatenate([np.r_[t, -1] for t in texts])
    codes = owner * (words.max() + 2) + words + 1
    most = np.where(sizes >= LEAST_WORDS, sizes // LEAST_PERIODS, 0)
    parts = Refinement(codes, owner, most[owner])
    length = 1
    while parts.step(length):
        length += 1
    at, period = parts.ended(length)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    if not len(at):
        return found
    begin = np.flatnonzero(np.r_[True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)])
    period, start, count = period[begin], at[begin], np.diff(np.r_[begin, len(at)])
    size = count - 1 + 2 * period
    long = size >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    for s, n, p in sorted(zip(start[long].tolist(), size[long].tolist(), period[long].tolist(), strict=True), key=lambda r: (r[0], r[2])):
        i = int(owner[s])
        found[i].append((s - int(base[i]), n, p))
    return found


def _row(doc_id: int | None, words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    """The result of one text."""
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    if runs:
        gone = np.zeros(len(words), bool)
        for start, length, period in runs:
            gone[start + period : start + length] = True
        words = [words[i] for i in np.flatnonzero(~gone)]
    said = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(said), sha(" ".join(words)))


def _refined(rows: list[tuple[int | None, list[str]]]) -> pd.DataFrame:
    codes, _ = pd.factorize(np.array([w for _, words in rows for w in words], object))
    texts = np.split(codes.astype(np.int64), np.cumsum([len(words) for _, words in rows])[:-1])
    out = [_row(doc_id, words, runs) for (doc_id, words), runs in zip(rows, runs_in(texts), strict=True)]
    names = [c.split()[0] for c in RESULT.split(", ")]
    whole = ("doc_id", "start", "length", "period", "exponent_milli")
    return pd.DataFrame({name: ids(values) if name in whole else list(values) for name, values in zip(names, zip(*out, strict=True), strict=True)})


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows, held = [], 0
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            doc_id = None if doc_id is None else int(doc_id)
            words = words_of(text, doc_id)
            if rows and held + len(words) > BATCH:
                yield _refined(rows)
                rows, held = [], 0
            rows.append((doc_id, words))
            held += len(words)
        if rows:
            yield _refined(rows)


def found(docs: DataFrame) -> DataFrame:
    """Per row of docs: the columns of RESULT."""
    return docs.select(id_text("doc_id"), "text").mapInPandas(_found, RESULT)
