"""Personal data: exact patterns, and a BiLSTM-CRF for what is written in other ways.

Patterns find the base spans.  The tagger of ``tagger`` adds spans that no
pattern fits: phone numbers without a country code, cards with odd separators,
addresses with ``[at]`` or with ``at`` and ``dot`` as words.  It is trained here
on labelled spans in seeded artificial lines, and reads overlapping windows
around every place that the written forms it learns cannot do without: a digit,
an ``@``, an ``at`` in brackets or the word ``dot``.  Texts are read whole; what
has none of these, such as numbers in words, is not found.

A span counts only from a window that holds it whole and away from its cut
edges; neighbouring windows overlap by half, and spans are at most half a
window.  Then all spans of a text are reconciled: base spans stay, and of
overlapping others the longest wins, then the first.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsync.llm.tagger import Tagger, train
from colsync.llm.words import text_bytes

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and from one window to the next.
WINDOW, STRIDE = 160, 80
#: Windows that are decoded at a time.
BATCH = 384
#: Training steps, lines of each, and their length.
STEPS, LINES, LENGTH = 420, 48, 96
SEED = 20

_TRIGGER = re.compile(r"[0-9@]|[\[(] ?at ?[\])]|(?<![a-z])dot(?![a-z])", re.IGNORECASE | re.ASCII)
#: A written address; the tagger finds where one is, and its ends are those of this.
_ADDRESS = re.compile(
    r"[a-z0-9_%+-]+(?:(?:\.|\sdot\s)[a-z0-9_%+-]+)*(?:@|\s@\s?|\s?[\[(]\s?at\s?[\])]\s?|\sat\s)[a-z0-9-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[a-z0-9-]+)+",
    re.IGNORECASE | re.ASCII,
)
_DOT = re.compile(rb"(?<![A-Za-z])[Dd][Oo][Tt](?![A-Za-z])")
#: What looks like a number to call but is a date, a range of years or a number of a book.
_NOT_CALLED = re.compile(r"(?:1[5-9]|20)[0-9]{2}\s?[-/–]\s?(?:(?:1[5-9]|20)[0-9]{2}|[0-9]{2})|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}|97[89][-\x20]?(?:[0-9][-\x20]?){9}[0-9Xx]|[0-9]{4}-[0-9]{3}[0-9Xx]")
#: Ten digits as three, three and four: area and exchange begin with 2 to 9.
_AREA = re.compile(r"(?:\+?1[-.\x20]?)?\(?([0-9])[0-9]{2}\)?[-.\x20]?([0-9])[0-9]{2}[-.\x20]?[0-9]{4}")
_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# symbols: padding, other, letters beyond ASCII, digits, a to z, then the marks below
_MARKS = " \n.@+-()[]:/#$,=\"'%_"
_SYMBOLS = 4 + 26 + len(_MARKS)
_TABLE = np.full(128, 1, np.int16)
_TABLE[48:58] = 3
_TABLE[65:91] = np.arange(4, 30)
_TABLE[97:123] = np.arange(4, 30)
_TABLE[[ord(c) for c in _MARKS]] = np.arange(30, 30 + len(_MARKS))


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the pattern matches, by kind and start; time is linear in the text."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (tail := _TAIL.match(text, at)):
            out.append((0, start, tail.end()))
            done = tail.end()
        at = text.find("@", max(done, at + 1))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    at = text.find("+")
    while at >= 0:
        if m := _PHONE.match(text, at):
            if 8 <= sum(map(m.group().count, "0123456789")) <= 15:
                out.append((3, *m.span()))
            at = text.find("+", m.end())
        else:
            at = text.find("+", at + 1)
    return out


def encode(text: str) -> np.ndarray:
    """Symbols of the characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], 2).astype(np.int16)


def windows(text: str) -> list[int]:
    """Starts of the windows that cover every trigger with all that can belong to it."""
    starts, last = set(), len(text)
    for m in _TRIGGER.finditer(text):
        # a span at most STRIDE long around this place lies whole in one of these
        first = max(0, m.start() - STRIDE) // STRIDE
        for k in (first, first + 1):
            if k * STRIDE <= m.start():
                starts.add(k * STRIDE)
    return sorted(s for s in starts if s < last)


def plausible(kind: int, found: str) -> bool:
    """What a span of the tagger has to satisfy at least."""
    digits = "".join(_DIGIT.findall(found))
    if "\n" in found or len(found) > STRIDE:
        return False
    if kind == 0:
        worded = re.search(r"\sat\s", found, re.IGNORECASE) and not re.search(r"\sdot\s", found, re.IGNORECASE)
        return bool(_ADDRESS.fullmatch(found)) and not worded and len(re.findall(r"[A-Za-z]{2,}", found)) >= 2
    if kind == 1:
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    area = _AREA.fullmatch(found)
    return 7 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", found) and not _NOT_CALLED.fullmatch(found) and not (area and {"0", "1"} & set(area.groups()))


def settled(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    """The ends of a span of the tagger: those of the address that it overlaps most, else its own."""
    if kind == 0:
        low = max(0, a - STRIDE)
        found = [(min(b, low + m.end()) - max(a, low + m.start()), low + m.start(), low + m.end()) for m in _ADDRESS.finditer(text[low : b + STRIDE])]
        best = max(found, default=(0, a, b))
        return best[1:] if best[0] > 0 else (a, b)
    return a, b


def _runs(path: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Spans of a path of tags: 0 outside, then begin and inside for each kind."""
    start = kind = None
    for i, tag in enumerate([*path.tolist(), 0]):
        begins, now = tag % 2 == 1, (tag - 1) // 2 if tag else None
        if start is not None and (now != kind or begins):
            yield kind, start, i
            start = None
        if now is not None and start is None:
            start, kind = i, now


def reconcile(base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those others that overlap neither these nor each other, longest first."""
    if not found:
        return sorted(base)
    taken = np.zeros(max(b for _, _, b in [*base, *found]), bool)
    for _, a, b in base:
        taken[a:b] = True
    out = list(base)
    for kind, a, b in sorted(set(found), key=lambda s: (s[1] - s[2], s[1], s[0])):
        if not taken[a:b].any():
            taken[a:b] = True
            out.append((kind, a, b))
    return sorted(out)


def tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Plausible spans of the tagger in each text, from all its windows."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    jobs = [(i, s) for i, text in enumerate(texts) for s in windows(text)]
    symbols, held = np.zeros(0, np.int16), -1
    for at in range(0, len(jobs), BATCH):
        part = jobs[at : at + BATCH]
        block = np.zeros((WINDOW, len(part)), np.int16)
        for k, (i, s) in enumerate(part):
            if i != held:
                symbols, held = encode(texts[i]), i
            piece = symbols[s : s + WINDOW]
            block[: len(piece), k] = piece
        paths = tagger.decode(block)
        for k in np.flatnonzero(paths.any(axis=0)):
            i, s = part[k]
            size = min(WINDOW, len(texts[i]) - s)
            for kind, a, b in _runs(paths[:size, k]):
                whole = (a > 0 or s == 0) and (b < size or s + size == len(texts[i]))
                if whole:
                    low, high = settled(kind, texts[i], s + a, s + b)
                    if plausible(kind, texts[i][low:high]):
                        out[i].append((kind, low, high))
    return out


# -- labelled lines -----------------------------------------------------------


def _word(rng: random.Random) -> str:
    parts = ("th", "er", "an", "on", "re", "ti", "é", "ou", "la", "ü", "ment", "que", "st", "in", "ñ", "os", "ba", "kel", "ra", "w")
    word = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    return (word.capitalize() if rng.random() < 0.15 else word) + rng.choice(["", "", "", "", ",", "."])


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, n: int) -> str:
    """Digits with a right check digit."""
    d = _digits(rng, n - 1)
    return next(d + c for c in "0123456789" if luhn(d + c))


def _entity(rng: random.Random) -> tuple[int, str]:
    """A kind, or -1 for a look-alike, and what is written."""
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwxyz") for _ in range(rng.randint(2, 7)))
    kind = rng.choice([0, 1, 2, 3, 3, -1, -1, -1])
    if kind == 0:
        words = rng.random() < 0.25
        at, dot = (" at ", " dot ") if words else rng.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), ("(at)", "."), (" @ ", "."), (" @ ", "."), (" (at) ", " (dot) "), (" [at] ", ".")])
        inner = " dot " if words else "."
        local = name() + rng.choice(["", "", inner + name(), _digits(rng, 2), inner + _digits(rng, 2), "_" + name(), "_" + _digits(rng, 2)])
        host = name() + rng.choice(["", "", name(), _digits(rng, 1)]) + (inner + name() + rng.choice(["", name()]) if rng.random() < 0.2 else "")
        tld = rng.choice(["com", "org", "net", "de", "fr", "es", "io", "co"])
        written = local + at + host + dot + rng.choice(["", "", "example" + dot]) + tld
        return 0, written.upper() if rng.random() < 0.05 else written.replace(" at ", " AT ").replace(" dot ", " DOT ") if rng.random() < 0.2 else written
    if kind == 1:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return 1, rng.choice([".", "[.]", "[.]", " . ", "[dot]"]).join(parts) if rng.random() < 0.6 else ".".join(parts)
    if kind == 2:
        if rng.random() < 0.2:
            d = _card(rng, 15)
            return 2, rng.choice(["{} {} {}", "{}-{}-{}", "{}.{}.{}"]).format(d[:4], d[4:10], d[10:])
        d = _card(rng, 16)
        return 2, rng.choice(["", "", " ", "-", ".", "  ", "/", "_"]).join(d[i : i + 4] for i in range(0, 16, 4))
    if kind == 3:
        a, b, c = rng.choice("23456789") + _digits(rng, 2), rng.choice("23456789") + _digits(rng, 2), _digits(rng, 4)
        return 3, rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+49 {a} {b}{c}", f"0{a} {b} {c}", f"0{a}/{b}{c}", f"00 44 {a} {b} {c}", f"+33 {c} {b}", f"1-{a}-{b}-{c}"])
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 18, 32, 40])))
    caps = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    d = lambda a, b: str(rng.randint(a, b))
    return -1, rng.choice(
        [
            f"{d(1, 9)}.{d(0, 9)}", f"v{d(1, 9)}.{d(0, 20)}.{d(0, 20)}", d(1900, 2099), f"${d(1, 999)}.{_digits(rng, 2)}", f"{d(2000, 2030)}-{_digits(rng, 2)}-{_digits(rng, 2)}",
            f"password={hexes}", f'token = "{hexes}"', f"AKIA{caps}", f"{d(1, 99)}%", f"#{d(1, 99999)}", f"{d(1, 12)}:{_digits(rng, 2)}", d(1, 99999), f"{d(1, 9)},{_digits(rng, 3)},{_digits(rng, 3)}",
            f"({d(1, 9)}) {d(10, 99)}", f"{d(1900, 2030)}-{d(1900, 2030)}", f"{d(1900, 2030)}/{_digits(rng, 2)}", f"{_digits(rng, 2)}-{_digits(rng, 2)}-{d(1900, 2030)}", f"{_digits(rng, 2)}/{_digits(rng, 2)}/{d(1900, 2030)}",
            f"978-{d(0, 9)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{d(0, 9)}", f"{d(100, 400)}-{d(100, 400)}", f"{_digits(rng, 4)}-{_digits(rng, 4)}", f"{_digits(rng, 5)}.{_digits(rng, 2)}",
            "at the dot", "at " + name() + " a dot", "dot com", "at " + name(), f"BY-NC {d(1, 4)}.0", f"version {d(1, 9)}.", "@" + name(), f"{d(1, 31)}.{d(1, 12)}.{d(1900, 2030)}", f"{d(1, 9)}.{d(1, 9)}.{d(1, 9)}", _digits(rng, rng.choice([5, 6, 20, 24])),
        ]
    )


def labelled_line(rng: random.Random, length: int = LENGTH) -> tuple[str, list[tuple[int, int, int]]]:
    """A line with its spans; it is cut out of a longer one, but not within a span."""
    text, spans = "", []
    while len(text) < length:
        if rng.random() < 0.25:
            kind, written = _entity(rng)
            if len(text) + len(written) > length and text:
                break
            if kind >= 0 and len(written) <= STRIDE:
                spans.append((kind, len(text), len(text) + len(written)))
            text += written + rng.choice([" ", " ", " ", ". ", ", ", "\n"])
        else:
            text += _word(rng) + rng.choice([" ", " ", " ", " ", "\n"])
    return text[: max(length, max((e for _, _, e in spans), default=0))], spans


def _lines(rng: random.Random, n: int) -> tuple[np.ndarray, np.ndarray]:
    symbols, tags = np.zeros((LENGTH, n), np.int16), np.zeros((LENGTH, n), np.int8)
    for k in range(n):
        text, spans = labelled_line(rng)
        coded = encode(text)[:LENGTH]
        symbols[: len(coded), k] = coded
        for kind, a, b in spans:
            tags[a:b, k] = 2 * kind + 2
            tags[a : a + 1, k] = 2 * kind + 1
    return symbols, tags


@lru_cache(maxsize=2)
def model(steps: int = STEPS, seed: int = SEED) -> Tagger:
    """The trained tagger; the same for the same arguments."""
    rng = random.Random(seed)
    return train(Tagger(_SYMBOLS, 2 * len(KINDS) + 1), (_lines(rng, LINES) for _ in range(steps)))


# -- the operator -------------------------------------------------------------


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end`` by kind as listed, then start."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_TRIGGER_BYTE = np.zeros(256, bool)
_TRIGGER_BYTE[[*range(48, 58), 64, 40, 91]] = True


def find_spans(tagger: Tagger, texts: pa.Array) -> tuple[list[list], list[list]]:
    """Base spans and all spans of each text."""
    data, offsets = text_bytes(texts)
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_TRIGGER_BYTE[data], out=seen[1:])
    base: list[list] = [[] for _ in range(len(texts))]
    both = base.copy()
    marked = seen[offsets[1:]] > seen[offsets[:-1]]
    raw = data.tobytes() if not marked.all() else b""
    for i in np.flatnonzero(~marked & (offsets[1:] > offsets[:-1])):
        marked[i] = _DOT.search(raw, offsets[i], offsets[i + 1]) is not None
    todo = np.flatnonzero(marked)
    held = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in todo]
    for i, text, found in zip(todo, held, tagged(tagger, held), strict=True):
        base[i] = base_spans(text)
        both[i] = reconcile(base[i], found)
    return base, both


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, counts of base spans by kind, ``base_sha256`` and ``spans``.

    Places are code points, ends exclusive.  Null and empty texts have no spans
    (the digest of nothing).  Very long texts are read whole, some hundreds of
    windows at a time.  Rows that repeat an id are rows of their own; ids are
    whole numbers, and an empty table gives none.  Other columns are not read.
    ``spans`` also has what the tagger adds.
    """
    held = docs.sparkSession.sparkContext.broadcast(model())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                base, both = find_spans(held.value, part.column(1))
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                digests = pa.array([hashlib.sha256(join_spans(b).encode()).hexdigest() for b in base], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *counts, digests, pa.array([join_spans(b) for b in both], pa.string())], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def mask(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are masked as one."""
    found = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, kind in found:
        if -b <= at:
            continue
        out += [text[at : max(a, at)], f"[{kind}]"] if a >= at else []
        at = -b
    return "".join(out) + text[at:]
