"""Text normalisation, matching and redaction: expressions where Spark has them, small Arrow UDFs where not."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stop words of the content measures.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: What ``redact`` hides, by label. Patterns keep to what both Java and RE2 read.
HIDDEN = {
    "secret": (r"(?i)\b(pass(?:word|wd)|secret|token|api_?key)([ \t]*[=:][ \t]*)[^ \t\r\n]+", r"\1\2"),
    "address": (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", ""),
    "digest": (r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){15,63}\b", ""),
    "path": (r"(^|[ \t\r\n\"'(=])(?:/[A-Za-z0-9._-]+){2,}/?", r"\1"),
    "key": (r"(?s)-----BEGIN [A-Z0-9 ]+-----.*?-----END [A-Z0-9 ]+-----", ""),
}
UNITS = ("kb", "mb", "gb", "tb", "km", "kg", "ms")


def redact(text: Column, vendor: dict[str, str] | None = None) -> Column:
    """The text with ``[label]`` for what ``HIDDEN`` and the caller's own ``vendor`` patterns (by label) find."""
    for label, (pattern, kept) in (HIDDEN | {k: (v, "") for k, v in (vendor or {}).items()}).items():
        text = F.regexp_replace(text, pattern, re.sub(r"\\([0-9])", r"$\1", kept) + f"[{label}]")
    return text


def nfkc(text: str) -> str:
    """NFKC without format characters and diacritics, digits as ASCII, folded, single spaces."""
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text))
    kept = (str(unicodedata.digit(c)) if c.isdigit() and unicodedata.digit(c, -1) >= 0 else c for c in folded if unicodedata.category(c) not in ("Cf", "Mn"))
    out = re.sub(r"(?<=\d)[,٬](?=\d{3}(?!\d))", "", "".join(kept))
    return " ".join(out.casefold().split())


@F.pandas_udf(T.StringType())
def normalise(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else nfkc(t))


def span_key(text: Column) -> Column:
    """Letters and digits only; a point between digits stays."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?<![0-9])\.|\.(?![0-9])", ""), r"[^\p{L}\p{N}.]", ""))


def token_estimate(text: Column) -> Column:
    """About 3.5 characters a token, rounded half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / 3.5).cast("int"))


def rewrites(currencies: tuple[str, ...] = ("eur", "gbp", "usd"), units: tuple[str, ...] = UNITS) -> list[tuple[str, str]]:
    """Ordered (pattern, replacement) that bring amounts, dates and units of lower-case text to one form."""
    rules = [(r"([0-9]),([0-9]{3})", r"\1\2")] * 2  # twice, as neighbouring groups share a digit
    rules += [(r"([0-9]\.[0-9]*[1-9])0+\b", r"\1"), (r"([0-9])\.0+\b", r"\1")]
    rules += [(r"([0-9]) ?%", r"\1 percent"), (rf"([0-9]) ?({'|'.join(units)})\b", r"\1 \2")]
    rules += [(rf"\b([0-9]+(?:\.[0-9]+)?) ?({'|'.join(currencies)})\b", r"\2 \1")]
    for name in MONTHS:
        rules += [(rf"\b0?([1-9][0-9]?)[ -]({name[:3]}|{name})\b", rf"{name} \1")]
    return rules


def dates_units(text: Column, **params) -> Column:
    """Lower-case text with dates as "month day", currency before its amount, plain numbers, spaced units."""
    text = F.lower(text)
    for pattern, put in rewrites(**params):
        text = F.regexp_replace(text, pattern, re.sub(r"\\([0-9])", r"$\1", put))
    return text


def has_term(term: Column, text: Column) -> Column:
    """Whether the term's tokens occur in a row in the text, both brought to one form first."""

    def tokens(c: Column) -> Column:
        return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(dates_units(c), r"[^\p{L}\p{N}.]+", " "), r"\.( |$)", "$1")), F.lit(" "))

    return F.contains(tokens(text), tokens(term))


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance: edits, with a swap of neighbours as one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def longest_common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest run of equal consecutive tokens in two token arrays."""

    def run(x, y):
        best, last = 0, {}
        for p in x:
            now = {j: last.get(j - 1, 0) + 1 for j, q in enumerate(y) if q == p}
            best, last = max([best, *now.values()]), now
        return best

    return pd.Series([run(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def stems(text: Column) -> Column:
    """Distinct content words, lightly stemmed (plural, -ing, -ed)."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(words, lambda w: F.when(F.length(w) > 5, F.regexp_replace(w, "(ing|ed|es|s)$", "")).otherwise(F.regexp_replace(w, "(?<=[a-z]{3})s$", ""))))


def overlap_ratio(question: Column, span: Column) -> Column:
    """Share of the question's stems that the span has."""
    q, s = stems(question), stems(span)
    return F.try_divide(F.size(F.array_intersect(q, s)), F.size(q))


def chunks(text: Column, size: int, overlap: int) -> Column:
    """``array<struct<n, start, chunk>>``: fixed windows of characters with overlap."""
    if not 50 <= size <= 4000 or not 0 <= overlap <= size // 2:
        raise ValueError("size is 50 to 4000 and overlap at most half of it")
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step).cast("int"))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("n"), (i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("chunk"))))


#: What a page does not show, in patterns that Java and RE2 both read.
UNSEEN = (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", r"(?s)<[^>]*>")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def visible_text(html: Column) -> Column:
    """What a reader of an HTML page sees, roughly: markup, style and script elements and comments go, basic entities are decoded."""
    t = html
    for pattern in UNSEEN:
        t = F.regexp_replace(t, pattern, " ")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\f]+", " "))


NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
NUMBER_WORDS |= {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}


def numbers(text: str) -> list[float]:
    """Numbers of a text in order: digits, and English number words up to millions."""
    out, total, part, open_ = [], 0, 0, False
    for w in [*re.findall(r"\d+(?:\.\d+)?|[a-z]+", text.lower().replace(",", "")), "."]:
        if w in NUMBER_WORDS:
            part, open_ = part + NUMBER_WORDS[w], True
        elif open_ and w == "hundred":
            part *= 100
        elif open_ and w in ("thousand", "million"):
            total, part = total + part * (1000 if w == "thousand" else 1_000_000), 0
        elif open_ and w == "and":
            continue
        else:
            if open_:
                out.append(float(total + part))
                total, part, open_ = 0, 0, False
            if w[0].isdigit():
                out.append(float(w))
    return out
