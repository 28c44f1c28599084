"""Numbers with their units in a text, as values with spans.

A finite-state transducer reads the tokens of a text once. It joins number
words ("one hundred and twenty-five thousand"), digits with a multiplier ("1.5
million", "2 lakh"), ordinals ("21st", "fifth") and units ("five working days",
"4-hour", "12 (twelve) months", "7 %") into facts. Clock times, grades (G3),
references ("section 4.2", "page 3"), list markers, dotted numbers such as
addresses and numbers inside longer words are no facts; nor is a single digit
without a unit. Arabic-Indic digits read as digits.
"""

from __future__ import annotations

import re
from decimal import Decimal
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number words, multipliers, units, and words between a value and its unit or before a reference.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
MULTIPLIERS = {"thousand": 10**3, "lakh": 10**5, "lakhs": 10**5, "million": 10**6, "crore": 10**7, "crores": 10**7, "billion": 10**9}
UNITS = {
    "day": "day", "days": "day", "week": "week", "weeks": "week", "month": "month", "months": "month", "year": "year", "years": "year", "yr": "year", "yrs": "year",
    "hour": "hour", "hours": "hour", "hr": "hour", "hrs": "hour", "h": "hour", "minute": "minute", "minutes": "minute", "min": "minute", "mins": "minute",
    "percent": "percent", "km": "km", "kms": "km", "kilometer": "km", "kilometers": "km", "kilometre": "km", "kilometres": "km",
    "instalment": "instalment", "instalments": "instalment", "installment": "instalment", "installments": "instalment",
}
BETWEEN = frozenset("calendar working business consecutive full paid clear whole additional extra more".split())
REFERENCES = frozenset("section sections sec s clause clauses page pages p pp paragraph paragraphs para article articles annex annexes appendix table tables".split())
SUFFIXES = frozenset(("st", "nd", "rd", "th"))

WORDS = {w: i for i, w in enumerate(ONES)} | {w: 10 * i for i, w in enumerate(TENS, 2)}
ORDINAL = {w: i for i, w in enumerate(ORDINALS)} | {w[:-1] + "ieth": 10 * i for i, w in enumerate(TENS, 2)}
#: The words that number words may begin with.
BEGINNINGS = frozenset(WORDS) | frozenset(ORDINAL) | {"a", "an"}
DIGITS = {ord(c): str(i) for start in (0x660, 0x6F0) for i, c in enumerate(map(chr, range(start, start + 10)))} | {c: "-" for c in range(0x2010, 0x2016)}
_TOKEN = re.compile(r"[0-9]+(?:,[0-9]{3})*(?![0-9])(?:\.[0-9]+)?|[0-9]+|[^\W\d_]+|\n|[^\s]")

FACT = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _tokens(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Tokens in lower case and their spans."""
    t = text if text.isascii() else text.translate(DIGITS)
    spans = [m.span() for m in _TOKEN.finditer(t)]
    if t.isascii():
        t = t.lower()
        return [t[a:b] for a, b in spans], spans
    return [t[a:b].lower() for a, b in spans], spans  # a letter's lower case may be longer


def canonical(value: Decimal) -> str:
    """Without leading and trailing zeros."""
    s = format(value, "f")
    return (s.rstrip("0").rstrip(".") if "." in s else s) or "0"


class Reader:
    """The transducer over one text's tokens; ``facts`` are ``(value, unit or None, start, end)``."""

    def __init__(self, text: str):
        words, self.spans = _tokens(text)
        self.n, none = len(words), [""] * 8
        self.number = ["0" <= w[0] <= "9" for w in words]
        #: Token i, the empty word before the first and behind the last.
        self.at = (words + none).__getitem__
        #: Whether token i stands right behind the one before it.
        self.touching = [False, *(a[1] == b[0] for a, b in pairwise(self.spans)), *[False] * 8].__getitem__
        self.begins = [i for i, w in enumerate(words) if self.number[i] or w in BEGINNINGS]

    def facts(self) -> list[tuple[str, str | None, int, int]]:
        out, behind = [], 0
        for i in self.begins:
            read = None if i < behind else self.digits(i) if self.number[i] else self.words(i)
            if read is None:
                continue
            value, unit, end, good = read
            if good:
                unit, end = (unit, end) if unit else self.unit(end)
                if unit or value not in range(1, 10):
                    out.append((canonical(value), unit, self.spans[i][0], self.spans[end - 1][1]))
            behind = end
        return out

    def digits(self, i: int) -> tuple[Decimal, str | None, int, bool] | None:
        """Digits from token i: (value, its unit if it has one already, token behind, whether it is a fact at all)."""
        end = i + 1
        value = Decimal(self.at(i).replace(",", ""))
        # what is glued to it: more numbers by dots or colons, letters before, letters behind that are no unit
        glued = self.touching(i) and (self.at(i - 1)[-1].isalpha() or self.at(i - 1) == "_" or self.at(i - 1) in (".", ":") and i > 1 and self.touching(i - 1) and self.number[i - 2])
        while self.touching(end) and self.at(end) in (".", ":") and self.touching(end + 1) and self.number[end + 1]:
            glued, end = True, end + 2
        if self.touching(end) and self.at(end)[0].isalpha() and self.at(end) not in SUFFIXES and self.at(end) not in UNITS or self.touching(end) and self.at(end) == "_":
            return value, None, end + 1, False
        if glued or self.reference(i) or self.marker(i):
            return value, None, end, False
        if self.touching(end) and self.at(end) in SUFFIXES:
            return value, "ordinal", end + 1, True
        if self.at(end) in MULTIPLIERS:
            return value * MULTIPLIERS[self.at(end)], None, end + 1, True
        return value, None, end, True

    def reference(self, i: int) -> bool:
        """Whether the number is that of a section, page and the like."""
        before = self.at(i - 1)
        return before == "§" or before in REFERENCES or before == "." and self.at(i - 2) in REFERENCES

    def marker(self, i: int) -> bool:
        """Whether a short number at the beginning of a line numbers that line."""
        if len(self.at(i)) > 2:
            return False
        first = lambda j: j < 0 or self.at(j) == "\n"
        behind = i + 2 < self.n and not self.touching(i + 2) and self.at(i + 2) != "\n"
        return behind and (first(i - 1) and self.touching(i + 1) and self.at(i + 1) in (".", ")", "-") or self.at(i - 1) == "(" and first(i - 2) and self.at(i + 1) == ")")

    def words(self, i: int) -> tuple[Decimal, str | None, int, bool] | None:
        """Number words from token i on; None if there are none."""
        total = part = 0
        last, end, open_ = 10**12, i, False
        if self.at(i) in ("a", "an") and (self.at(i + 1) == "hundred" or self.at(i + 1) in MULTIPLIERS):
            part, open_, end = 1, True, i + 1
        while end < self.n:
            w, at = self.at(end), end
            if open_ and w in ("and", "-") and (w == "and" and (part % 100 == 0) or w == "-" and part % 10 == 0 and part % 100):
                w, at = self.at(end + 1), end + 1
                if w not in WORDS and w not in ORDINAL:
                    break
            n = WORDS.get(w, ORDINAL.get(w))
            if n is not None:
                fits = not open_ or (part % 100 == 0 and 0 < n < 100 and (part or total)) or (part % 100 >= 20 and part % 10 == 0 and 0 < n < 10)
                if not fits:
                    break
                part, open_, end = part + n, True, at + 1
                if w in ORDINAL:
                    return (Decimal(total + part), "ordinal", end, True) if w != "second" or end - i > 1 else (Decimal(2), None, end, False)
            elif open_ and w == "hundred" and 0 < part < 100:
                part, end = part * 100, at + 1
            elif open_ and w in MULTIPLIERS and part and MULTIPLIERS[w] < last:
                total, part, last, end = total + part * MULTIPLIERS[w], 0, MULTIPLIERS[w], at + 1
            else:
                break
        if not open_:
            return None
        return Decimal(total + part), None, end, not self.reference(i)

    def unit(self, i: int) -> tuple[str | None, int]:
        """(unit, token behind it) of the value before token i; (None, i) if it has none."""
        j = i
        if self.at(j) == ")":
            j += 1
        if self.at(j) == "(":  # the value once more
            close = next((k for k in range(j + 1, min(j + 6, self.n)) if self.at(k) == ")"), None)
            if close is not None and self.spans[close][0] - self.spans[j][1] <= 16:
                j = close + 1
        if self.at(j) == "%":
            return "percent", j + 1
        if self.at(j) == "-":
            j += 1
        if self.at(j) in BETWEEN:
            j += 1
        if self.at(j) == "per" and self.at(j + 1) == "cent":
            return "percent", j + 2
        return (UNITS[self.at(j)], j + 1) if self.at(j) in UNITS else (None, i)


def facts_of(text: str | None) -> list[tuple[str, str | None, int, int]]:
    """Facts of a text in order: value, unit or None, first character, one past the last; none of a null."""
    return Reader(text).facts() if text else []


@F.arrow_udf(FACT)
def facts(text: pa.Array) -> pa.Array:
    each = [facts_of(t) for t in text.to_pylist()]
    flat = [f for found in each for f in found]
    columns = [pa.array([f[i] for f in flat], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
    ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["value", "unit", "start", "end"]))


def spelled(n: int, joined: str = " and ") -> str:
    """English words of a whole number below 10^12."""
    for size, word in ((10**9, "billion"), (10**6, "million"), (10**3, "thousand")):
        if n >= size:
            rest = n % size
            return f"{spelled(n // size, joined)} {word}" + (f"{joined if rest < 100 else ' '}{spelled(rest, joined)}" if rest else "")
    if n >= 100:
        return f"{ONES[n // 100]} hundred" + (f"{joined}{spelled(n % 100, joined)}" if n % 100 else "")
    if n >= 20:
        return TENS[n // 10 - 2] + (f"-{ONES[n % 10]}" if n % 10 else "")
    return ONES[n]
