"""Personal data, also disguised: offset-preserving transducers over whole texts.

The base detectors read the text as it is.  Where a text holds signs of a disguise, a chain of
transducers rewrites it (look-alike and full-width letters to ASCII, invisible characters away,
"[at]" and "(dot)" to @ and ., spelled digits to digits) and carries for every output character
the source range it came from.  The same detectors run over the rewritten text, and what they
find is mapped back to source characters.  Spans that a disguise made possible are added, also
where they hold a base span and more; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, trimmed

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A maximal digit run starts each; between two matches no run is entered in its middle.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping; the part before @ is found backwards, so that long words cost no retries."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[Span]:
    def small(x: str) -> bool:
        return len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255

    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 1) % 9 + 1 if d != "0" else 0 for i, d in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


DETECTORS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Look-alikes of ASCII letters in Greek and Cyrillic, and signs that stand for ASCII ones.
_ALIKE = dict(
    zip(
        "АВЕКМНОРСТХУаеорсухіјѕԁԛԝһӏІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρ＠．－＋∙·․‧٠۰–—‑‒−",
        "ABEKMHOPCTXYaeopcyxijsdqwhlIJSABEZHIKMNOPTYXoavp@.-+....00-----",
        strict=True,
    )
)
_INVISIBLE = "­​‌‍⁠﻿"
_SPACES = "             　"
_FOLD: dict[str, str] = _ALIKE | dict.fromkeys(_INVISIBLE, "") | dict.fromkeys(_SPACES, " ")
_ODD = re.compile("[" + re.escape("".join(_FOLD)) + "！-～٠-٩۰-۹०-९①-⑨₀-₉⁰-⁹\U0001d400-\U0001d7ff]")


def fold(c: str) -> str:
    """The ASCII characters that c stands for, else c."""
    if (x := _FOLD.get(c)) is not None:
        return x
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    x = unicodedata.normalize("NFKC", c)
    return x if x.isascii() else c


class Mapped:
    """A text with, for each character, the source range that it stands for."""

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> Mapped:
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replaces ranges, which are in order and apart; each new character stands for the whole range."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts.extend(self.starts[at:a])
            ends.extend(self.ends[at:a])
            if b > a:
                starts.extend([self.starts[a]] * len(new))
                ends.extend([self.ends[b - 1]] * len(new))
            at = b
        text.append(self.text[at:])
        starts.extend(self.starts[at:])
        ends.extend(self.ends[at:])
        return Mapped("".join(text), starts, ends)

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]


def homoglyphs(m: Mapped) -> Mapped:
    return m if m.text.isascii() or not _ODD.search(m.text) else m.rewrite([(x.start(), x.end(), y) for x in _ODD.finditer(m.text) if (y := fold(x[0])) != x[0]])


_AT, _DOT = r"(?:at|arroba|chez)", r"(?:dot|punkt|punto|point|period)"
_BRACKET_AT = re.compile(rf" ?[\[({{<] ?(?:{_AT}|@) ?[\])}}>] ?", re.I)
_BRACKET_DOT = re.compile(rf" ?[\[({{<] ?(?:{_DOT}|\.) ?[\])}}>] ?", re.I)
#: Bare words count only where they stand as in an address: name at host dot end, with any number of dots.
_BARE = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?<! dot )(?<! punkt )(?<! punto )(?<! point )(?<! period )"
    rf"[A-Za-z0-9_%+-]++(?:(?: {_DOT} |\.)[A-Za-z0-9_%+-]++)*+(?: {_AT} | ?@ ?)[A-Za-z0-9-]++(?:(?: {_DOT} | ?\. ?)[A-Za-z0-9-]++)++(?![A-Za-z0-9-])",
    re.I,
)
_BARE_AT, _BARE_DOT = re.compile(rf" {_AT} | ?@ ?", re.I), re.compile(rf" {_DOT} ", re.I)
_IP_DOTS = re.compile(rf"(?<=[0-9]) ?(?:{_DOT}) ?(?=[0-9])", re.I)
_DOT_SIGN = re.compile(rf"(?<![A-Za-z]){_DOT}(?![A-Za-z])", re.I)


def addresses(m: Mapped) -> Mapped:
    """ "[at]", "(dot)" and the like to @ and ., bare words inside an address too."""
    if _DOT_SIGN.search(low := m.text.lower()) or _BRACKETED.search(low):
        m = m.rewrite([(x.start(), x.end(), "@") for x in _BRACKET_AT.finditer(m.text)])
        m = m.rewrite([(x.start(), x.end(), ".") for x in _BRACKET_DOT.finditer(m.text)])
        m = m.rewrite([(x.start(), x.end(), ".") for x in _IP_DOTS.finditer(m.text)])
        edits = []
        for x in _BARE.finditer(m.text):
            if _DOT_SIGN.search(x[0]):
                own = [(y.start(), y.end(), "@") for y in _BARE_AT.finditer(m.text, x.start(), x.end())] + [(y.start(), y.end(), ".") for y in _BARE_DOT.finditer(m.text, x.start(), x.end())]
                edits += sorted(own)
        m = m.rewrite(edits)
    return m


_DIGITS = dict(zip("zero oh one two three four five six seven eight nine".split(), "00123456789"))
_WORD = "(?:" + "|".join(_DIGITS) + ")"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{_WORD}|[0-9]+)(?:[ -]{{1,2}}(?:{_WORD}|{_DOT}|[0-9]+)(?![A-Za-z0-9]))+", re.I)
_TWO_WORDS = re.compile(rf"(?<![A-Za-z]){_WORD}[ -]{{1,2}}(?:{_WORD}|{_DOT}|[0-9])", re.I)
_PLUS = re.compile(r"(?<![A-Za-z0-9])plus ?(?=[0-9])", re.I)
_ITEM = re.compile(rf"{_WORD}|{_DOT}|[0-9]+|[ -]+", re.I)


def spelled(m: Mapped) -> Mapped:
    """Runs of two spelled digits or more to digits, "dot" between them to ., a leading "plus" to +."""
    if not _TWO_WORDS.search(m.text):
        return m
    edits = []
    for x in _SPELLED.finditer(m.text):
        items = [(y.start(), y.end(), y[0].lower()) for y in _ITEM.finditer(m.text, x.start(), x.end())]
        if sum(w in _DIGITS for *_, w in items) >= 2:
            for a, b, w in items:
                if w in _DIGITS:
                    edits.append((a, b, _DIGITS[w]))
                elif w[0] in " -":
                    edits.append((a, b, ""))
                elif not w.isdigit():
                    edits.append((a, b, "."))
    m = m.rewrite(edits)
    return m.rewrite([(x.start(), x.end(), "+") for x in _PLUS.finditer(m.text)])


TRANSDUCERS: tuple[Callable[[Mapped], Mapped], ...] = (homoglyphs, spelled, addresses)


_DIGIT = re.compile("[0-9]")
_DOT_WORDS = ("dot", "punkt", "punto", "point", "period")
_DIGIT_WORD = re.compile(rf"[^a-z]{_WORD}[ -]")
_BRACKETED = re.compile(rf"[\[({{<] ?(?:{_AT}|@|\.) ?[\])}}>]")


def _disguised(low: str) -> bool:
    """Whether a lower-cased text holds any sign that a transducer acts on: cheap tests, none of which misses one."""
    return any(w in low for w in _DOT_WORDS) or _DIGIT_WORD.search(" " + low) is not None or any(c in low for c in "([{<") and _BRACKETED.search(low) is not None


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and all spans of a text, by kind, in code points."""
    digits = _DIGIT.search(text) is not None
    base = {k: f(text) if digits or k == "email" else [] for k, f in DETECTORS.items()}
    if text.isascii() and not _disguised(text.lower()):
        return base, base
    m = Mapped.of(text)
    m = TRANSDUCERS[0](m)
    if _disguised(m.text.lower()):
        for f in TRANSDUCERS[1:]:
            m = f(m)
    if m.text == text:
        return base, base
    every = {}
    for kind, f in DETECTORS.items():
        own = base[kind]
        new = {s for x in f(m.text) if (s := m.source(x)) and text[s[0] : s[1]] != m.text[x[0] : x[1]]}
        out, last = list(own), sorted(own)
        starts, ends = [a for a, _ in last], [b for _, b in last]
        for a, b in sorted(new):
            # Base spans don't overlap: those that meet a..b are neighbours.  A span stays if it meets none, or holds all that it meets and more.
            i, j = bisect_right(ends, a), bisect_left(starts, b)
            if i >= j or a <= starts[i] and ends[j - 1] <= b and (a, b) != last[i]:
                out.append((a, b))
        every[kind] = sorted(out)
    return base, every


def digest(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def detect(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): counts of base spans by kind, their digest, all spans, and how many a disguise hid.

    A null or empty text has none.  Repeated rows come back as they are, other columns are left
    out, an empty table gives an empty one.  Work on a text is linear in its length.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = find(text.as_py())
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(digest(base).encode()).hexdigest(), digest(every), sum(map(len, every.values())) - sum(map(len, base.values()))))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            cells = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cells, kinds))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"])

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")


def redact_text(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the earlier, then the longer, wins."""
    _, every = find(text)
    out, at = [], 0
    for a, b, k in sorted(((a, -b, k) for k, x in every.items() for a, b in x)):
        if a >= at:
            out += [text[at:a], f"<{k}>"]
            at = -b
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced; all columns stay, a null text stays null."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            new = [None if (t := x.as_py()) is None else redact_text(t) for x in batch.column(at)]
            yield batch.set_column(at, "text", pa.array(new, pa.string()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(trimmed(run), docs.withColumn("text", F.col("text").cast("string")).schema)
