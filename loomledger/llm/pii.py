"""Personal data, also where it is disguised, with the places it has in the source.

Base spans come from the text as it is. Then the text goes through a cascade of transducers: characters that look like
others or cannot be seen, digits spelled as words or written as letters, and disguises of at and dot. A transducer
copies its input but for the places that it rewrites, and keeps both: a list of rewritten places with where they
stand on either side. Identifiers are detected in the last output, and the ends of each are mapped back through the
cascade: a copied character to itself, a character of a rewritten place to that whole place. So a span found in
`jane (at) example (dot) com` covers these very characters of the source. Only what holds a rewritten place is added.

Every pattern takes time in proportion to the text: no pattern can begin anew within what it has just failed on.

Plain words are rewritten only where they belong to one identifier: ` at ` stands for @ if a disguised dot follows in
what would be the domain, and ` dot ` for a full stop in such an address or between spelled digits. Nine to fifteen
spelled digits in a row, not a card's, count as a phone even without a plus.

Defined cases: null texts are empty; empty and blank texts have no spans and the hash of the empty string; rows are
judged one by one, so repeated rows and rows without an id have results of their own; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ._common import id_text, ids

#: Kinds in the order they are named in.
KINDS = ["email", "ip", "card", "phone"]
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "п": "n", "г": "r",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ѵ": "v", "ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s", "İ": "I", "\u212a": "K",
    "։": ":", "․": ".", "。": ".", "｡": ".", "‧": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹘": "-", "﹫": "@",
}
#: Characters that cannot be seen.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff"
#: Digits as words, by language.
DIGIT_WORDS = {
    "en": ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"],
    "de": ["null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"],
    "fr": ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"],
    "es": ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"],
}
#: Words for plus, at and dot, and for what a digit is taken times.
PLUS_WORDS = ["plus", "más", "mas"]
AT_WORDS = ["at", "arroba", "arobase", "ät"]
DOT_WORDS = ["dot", "punkt", "punto", "point"]
TIMES = {"double": 2, "triple": 3}
#: Digits of a card and of a phone.
CARD = range(12, 20)
PHONE = range(9, 16)

RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
Span = tuple[int, str, int]  # start, kind, end

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ the local part is what stands before it, since the last @ and match."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        low = at + 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            low = domain.end()
            yield start, low
        at = text.find("@", low)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Of numbers chained by full stops every four are a match; one with a part beyond 255 is dropped."""
    for chain in _NUMBERS.finditer(text):
        parts = chain[0].split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + len(".".join(four))
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 2 * CARD.stop else ""
        if len(digits) in CARD and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if sum(c.isdigit() for c in m[0]) in PHONE:
                yield m.span()


def detected(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind."""
    finders = zip(KINDS, (emails, addresses, cards, phones), strict=True)
    return by_place((start, kind, end) for kind, find in finders for start, end in find(text))


def by_place(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


class Rewritten:
    """A text, the places of its source that were rewritten, and where they stand in it."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        """edits: (start, end, new text), in order, not overlapping."""
        parts, at, out = [], 0, 0
        self.starts, self.ends, self.sources = [], [], []  # of each edit: its place here, and its place in the source
        for start, end, new in edits:
            parts += [source[at:start], new]
            out += start - at
            self.starts.append(out)
            out += len(new)
            self.ends.append(out)
            self.sources.append((start, end))
            at = end
        self.text = "".join(parts) + source[at:]

    def _edit(self, at: int) -> int | None:
        """The edit that wrote the character at a place."""
        k = bisect_right(self.starts, at) - 1
        while k >= 0 and self.starts[k] == self.ends[k]:  # one that wrote nothing
            k -= 1
        return k if k >= 0 and at < self.ends[k] else None

    def _copied(self, at: int) -> int:
        k = bisect_right(self.starts, at) - 1
        return at if k < 0 else self.sources[k][1] + at - self.ends[k]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The place in the source of a span that is not empty."""
        first, last = self._edit(start), self._edit(end - 1)
        return self._copied(start) if first is None else self.sources[first][0], self._copied(end - 1) + 1 if last is None else self.sources[last][1]

    def touches(self, start: int, end: int) -> bool:
        """True if an edit stands in a span."""
        k = bisect_right(self.starts, end - 1) - 1
        return k >= 0 and (self.ends[k] > start or self.starts[k] > start)


# characters

_STRANGE = re.compile(f"[\u00a0\u0130\u0131\u017f\u0251\u0261{INVISIBLE}\u0370-\U0010ffff]")


def _plain(c: str) -> str | None:
    """What a strange character stands for; None if only for itself."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    if kind in ("<wide>", "<narrow>", "<font>", "<noBreak>"):
        new = unicodedata.normalize("NFKC", c)
        return new if len(new) == 1 and new.isascii() else LOOKALIKES.get(new)
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    return " " if unicodedata.category(c) == "Zs" else None


_cache: dict[str, str | None] = {}


def lookalikes(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _STRANGE.finditer(text):
        c = m[0]
        if c not in _cache:
            _cache[c] = _plain(c)
        if (new := _cache[c]) is not None:
            edits.append((m.start(), m.end(), new))
    return edits


# digits

_VALUE = {w: str(d) for words in DIGIT_WORDS.values() for d, w in enumerate(words)}
_any = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
_UNIT = rf"(?:(?:{_any(TIMES)})[ -])?(?:{_any(_VALUE)})(?![^\W\d_])|[0-9]++"
_BETWEEN = rf"[ \t]{{0,2}}[-,.]?[ \t]{{0,2}}|[ \t]{{1,2}}(?:{_any(DOT_WORDS)})[ \t]{{1,2}}"
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?P<plus>{_any(PLUS_WORDS)})[ -])?(?:(?:{_any(TIMES)})[ -])?(?:{_any(_VALUE)})(?![^\W\d_])(?:(?:{_BETWEEN})(?:{_UNIT}))*+", re.I)
_UNITS = re.compile(rf"(?P<times>{_any(TIMES)})|(?P<word>{_any(_VALUE)})|(?P<digits>[0-9]+)|(?P<dot>{_any(DOT_WORDS)}|\.)", re.I)
_MIXED = re.compile(r"[0-9][OoIl]|[OoIl][0-9]")
_LETTERS = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl]*(?:[0-9][OoIl]|[OoIl][0-9])[0-9OoIl]*(?![A-Za-z0-9])")
_AS_DIGITS = str.maketrans("OoIl", "0011")


def spelled(text: str) -> list[tuple[int, int, str]]:
    """Digit words in a row, whatever parts them, become digits in a row; a dot between them a full stop."""
    edits: list[tuple[int, int, str]] = []
    words = text.lower()
    for c in "-,._\n\t()":
        words = words.replace(c, " ")
    if sum(map(_VALUE.__contains__, words.split(" "))) < 2:  # one word alone is no identifier, and the pattern is slow
        return edits
    for m in _SPELLED.finditer(text):
        out, times = ["+"] if m["plus"] else [], 1
        for u in _UNITS.finditer(text, m.end("plus") if m["plus"] else m.start(), m.end()):
            if u["times"]:
                times = TIMES[u[0].lower()]
            elif u["dot"]:
                out.append("." if out else "")
            else:
                out.append(u["digits"] or _VALUE[u[0].lower()] * times)
                times = 1
        if len(out) > 1:
            edits.append((m.start(), m.end(), "".join(out)))
    return edits


def as_letters(text: str) -> list[tuple[int, int, str]]:
    """O and l among digits become 0 and 1."""
    if not _MIXED.search(text):
        return []
    return [(*m.span(), m[0].translate(_AS_DIGITS)) for m in _LETTERS.finditer(text)]


def is_spelled_phone(new: str) -> bool:
    """What spelled() wrote, as a phone without a plus."""
    return new.isascii() and new.isdigit() and len(new) in PHONE and not (len(new) in CARD and luhn(new))


# at and dot

_WORD, _GAP, _BLANKS = "[A-Za-z0-9]", "[ _-]", 3
_BRACKETED = re.compile(rf"[(\[{{<][ \t]{{0,3}}(?:(?P<at>{_any(AT_WORDS)}|@)|(?:{_any(DOT_WORDS)}|\.))[ \t]{{0,3}}[)\]}}>]|&(?:(?P<at2>#64|#x40|commat)|#46|#x2e|period);", re.I)
_SPACED_AT = re.compile(" @ ")
_BETWEEN_DIGITS = re.compile(rf"(?<=[0-9]){_GAP}(?:{_any(DOT_WORDS)}){_GAP}(?=[0-9])", re.I)
_DOTTED = rf"{_GAP}(?:{_any(DOT_WORDS)}){_GAP}"
#: from a plain at or @ on: a domain in which at least one dot is a word
_PLAIN_DOMAIN = re.compile(rf"(?:(?P<at>{_GAP}(?:{_any(AT_WORDS)}){_GAP})|@)(?=[A-Za-z0-9-]{{1,63}}?(?:(?:\.|{_DOTTED})[A-Za-z0-9]{{1,63}}?){{0,8}}?{_DOTTED}{_WORD})", re.I)
_PLAIN_AFTER = re.compile(rf"[A-Za-z0-9-]{{1,63}}?(?:\.|(?P<dot>{_DOTTED}))(?={_WORD})", re.I)
_PLAIN_BEFORE = re.compile(rf"({_DOTTED})[A-Za-z0-9_%+-]{{1,64}}\Z", re.I)


def _is_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def bracketed(text: str) -> list[tuple[int, int, str]]:
    """(at), [dot], &#64; and @ between blanks, with the blanks around them, between two words."""
    edits = []
    for m in [*_BRACKETED.finditer(text), *_SPACED_AT.finditer(text)]:
        start, end = m.span()
        start -= len(near := text[max(0, start - _BLANKS) : start]) - len(near.rstrip(" \t"))
        end += len(near := text[end : end + _BLANKS]) - len(near.lstrip(" \t"))
        if _is_word(text, start - 1) and _is_word(text, end):
            edits.append((start, end, "@" if m.re is _SPACED_AT or m["at"] or m["at2"] else "."))
    return sorted(edits)


def plain_words(text: str) -> list[tuple[int, int, str]]:
    """dot between digits, and at and dot as words of one address: a domain with a dot as a word must follow."""
    low = text.lower()
    if not any(w in low for w in DOT_WORDS):
        return []
    edits = [(*m.span(), ".") for m in _BETWEEN_DIGITS.finditer(text)]
    return sorted(edits + _addressed(text))


def _addressed(text: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    for m in _PLAIN_DOMAIN.finditer(text):
        low = edits[-1][1] if edits else 0
        start, end = m.span()
        if start < low or start == 0 or text[start - 1] not in _LOCAL:
            continue
        before, at = [], start
        while at > low and (dot := _PLAIN_BEFORE.search(text, max(low, at - 80), at)):
            before.append((*dot.span(1), "."))
            at = dot.start(1)
        edits += reversed(before)
        if m["at"]:
            edits.append((start, end, "@"))
        at = end
        while after := _PLAIN_AFTER.match(text, at):
            if after["dot"]:
                edits.append((*after.span("dot"), "."))
            at = after.end()
    return edits


TRANSDUCERS: list[Callable[[str], list[tuple[int, int, str]]]] = [lookalikes, spelled, as_letters, bracketed, plain_words]


def disguised(text: str) -> list[Span]:
    """Spans of what the cascade has uncovered, in the source."""
    cascade: list[Rewritten] = []
    extra: list[Span] = []
    for transducer in TRANSDUCERS:
        if edits := transducer(text):
            if transducer is spelled:
                for start, end, new in edits:
                    if is_spelled_phone(new):
                        first, last = _back(cascade, start, end)
                        extra.append((first, "phone", last))
            cascade.append(Rewritten(text, edits))
            text = cascade[-1].text
    if not cascade:
        return []
    out: list[Span] = []
    for start, kind, end in detected(text):
        fresh, at = False, (start, end)
        for step in reversed(cascade):
            fresh = fresh or step.touches(*at)
            at = step.back(*at)
        if fresh:
            out.append((at[0], kind, at[1]))
    return out + [e for e in extra if not any(k == "phone" and s <= e[0] and e[2] <= t for s, k, t in out)]


def _back(cascade: list[Rewritten], start: int, end: int) -> tuple[int, int]:
    for step in reversed(cascade):
        start, end = step.back(start, end)
    return start, end


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all: those and what disguises hide beyond them."""
    base = detected(text or "")
    more = {d for d in disguised(text or "") if not any(s <= d[0] and d[2] <= e and k == d[1] for s, k, e in base)}
    return base, by_place([*base, *more])


def said(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in found)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            base, every = spans(text)
            kinds = [k for _, k, _ in base]
            rows.append((*map(kinds.count, KINDS), hashlib.sha256(said(base).encode()).hexdigest(), said(every)))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")][1:])
        out.insert(0, "doc_id", ids(pdf["doc_id"]))
        yield out


def found(docs: DataFrame) -> DataFrame:
    """Per row of docs: the columns of RESULT."""
    return docs.select(id_text("doc_id"), "text").mapInPandas(_scan, RESULT)
