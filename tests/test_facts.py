"""Facts against a plain reading, and texts made of known facts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.functions.facts import SUFFIXES, UNITS, facts, facts_of, spelled


def values(text):
    return [f[:2] for f in facts_of(text)]


@pytest.mark.parametrize("joined", [" and ", " "])
def test_spelled_numbers_read_back(joined):
    rng = random.Random(5)
    for n in [*range(10, 2100), *(rng.randrange(10 ** rng.randrange(2, 12)) + 10 for _ in range(1500))]:
        text = f"It takes {spelled(n, joined)} days."
        assert facts_of(text) == [(str(n), "day", 9, len(text) - 1)], text
        assert values(f"{spelled(n, joined).replace('-', ' ')} of them") == [(str(n), None)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("within five (5) working days", [("5", "day")]), ("a 4-hour wait, 12 (twelve) months", [("4", "hour"), ("12", "month")]), ("7 % and 8 per cent and 9%", [("7", "percent"), ("8", "percent"), ("9", "percent")]),
        ("INR 1.5 lakh or 49 thousand", [("150000", None), ("49000", None)]), ("the 21st of the fifth month", [("21", "ordinal"), ("5", "ordinal")]), ("in a second", []), ("twenty-second day", [("22", "ordinal")]),
        ("from 09:30 to 20:00 in grade G12", []), ("see section 4.2, page 31 and clause 17", []), ("1. first things\n2) 30 days\n(3) 40 hours", [("1", "ordinal"), ("30", "day"), ("40", "hour")]),
        ("10.20.30.40 and 6838a6ec and v12 and a_13", []), ("3 of 7", []), ("1,250.50 or 2.0 km", [("1250.5", None), ("2", "km")]), ("٤٩ و ۱۲", [("49", None), ("12", None)]),
        ("one hundred and one", [("101", None)]), ("twenty thirty", [("20", None), ("30", None)]), ("two and twenty", [("20", None)]), ("a hundred and a thousand", [("100", None), ("1000", None)]), ("", []), (None, []),
        ("five", []), ("zero days", [("0", "day")]), ("thousand", []), ("30km, 10 h", [("30", "km"), ("10", "hour")]), ("12–15 weeks", [("12", None), ("15", "week")]),
    ],
)
def test_rules(text, want):
    assert values(text) == want


def plain(text):
    """Digits only, by looking at every place: the longest number there, its neighbours, and what follows it."""
    out, i = [], 0
    while i < len(text):
        m = re.compile(r"[0-9]+(?:\.[0-9]+)?").match(text, i)
        if not m:
            i += 1
            continue
        run = re.compile(r"[0-9]+(?:[.:][0-9]+)*").match(text, i)
        before, behind = text[i - 1 : i], re.compile(r"[a-z]*").match(text, run.end())[0]
        unit = re.compile(r" ?(%|[a-z]+)").match(text, m.end())
        dotted = run.end() != m.end()
        glued = before.isalpha() or bool(behind) and behind not in UNITS and behind not in SUFFIXES
        name = None
        if unit:
            name = "percent" if unit[1] == "%" else UNITS.get(unit[1]) or ("ordinal" if behind in SUFFIXES and unit[1] == behind else None)
        v = m[0].lstrip("0") or "0"
        v = ("0" + v if v[0] == "." else v).rstrip("0").rstrip(".") if "." in v else v
        if not dotted and not glued and (name or v not in set("123456789")):
            out.append((v, name))
        i = run.end() + len(behind)
    return out


def test_digits_against_plain_reading():
    rng = random.Random(9)
    words = ["12", "7", "0.50", "100", "1.2.3", "09:30", "3a", "x4", "days", "%", "th", "km", "of", "q", "25th", "8h", "6ec"]
    for _ in range(4000):
        text = "q " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 8)))
        assert values(text) == plain(text), text


def test_column(spark):
    df = spark.createDataFrame([(1, "ten days"), (2, None), (3, "")], "id int, t string").select("id", F.explode_outer(facts("t")).alias("f"))
    assert [(r.id, r.f and (r.f.value, r.f.unit, r.f.start, r.f.end)) for r in df.orderBy("id").collect()] == [(1, ("10", "day", 0, 8)), (2, None), (3, None)]
    big = "1." * 100_000 + " twenty " * 50_000
    assert len(facts_of(big)) == 50_000


def test_each_line_is_read_once_and_by_all_tasks(spark):
    from lodestar.plans import answers

    d = "/root/testdata/sf0.001"
    for query in (answers.facts_of_sentences, answers.facts_in_window):
        plan = query(spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and "ArrowEvalPython" in plan, plan
        assert "Window" not in plan or plan.index("ArrowEvalPython") > plan.index("Window"), "texts of windows are read again"
