"""A budget ledger: claims hold their worst case, settlements replace holds, a breach closes the allotment."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "allotment string, seq long, claim string, action string, outcome string, held double, spent double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Amounts are kept as whole numbers of this part of the unit.
PART = 10_000


def run_ledger(entries: DataFrame, budgets: DataFrame) -> DataFrame:
    """``allotment, seq, claim, action (claim|settle), amount`` in order of seq, against ``allotment, budget``.

    A claim is granted if spent + held + amount fits the budget and the
    allotment is open; a settlement above its hold that breaks the budget
    closes it. Amounts count to four decimals, exactly. Each allotment is one
    ordered fold with running totals, and a task folds its allotments one after
    another as their sorted entries pass; those without a budget are left out,
    and a null amount is 0.
    """

    def fold(batches):
        now, holds, held, spent, closed = None, {}, 0, 0, False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("allotment", "claim", "action", "amount", "budget")]
            outcomes, helds, spents = [], [], []
            for allotment, claim, action, amount, budget in zip(*columns, strict=True):
                if allotment != now:
                    now, holds, held, spent, closed = allotment, {}, 0, 0, False
                if action == "claim":
                    ok = not closed and claim not in holds and spent + held + amount <= budget
                    outcome = "granted" if ok else "closed" if closed else "refused"
                    if ok:
                        holds[claim] = amount
                        held += amount
                elif claim in holds:
                    held -= holds.pop(claim)
                    spent += amount
                    closed = closed or spent > budget
                    outcome = "breach" if spent > budget else "settled"
                else:
                    outcome = "unknown"
                outcomes.append(outcome)
                helds.append(held / PART)
                spents.append(spent / PART)
            new = [pa.array(outcomes, pa.string()), pa.array(helds, pa.float64()), pa.array(spents, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("allotment", "seq", "claim", "action")), *new], NAMES)

    whole = lambda c: F.coalesce((F.col(c).cast("decimal(28,4)") * PART).cast("long"), F.lit(0).cast("long")).alias(c)
    e = entries.select(F.col("allotment").cast("string"), F.col("seq").cast("long"), F.col("claim").cast("string"), F.col("action").cast("string"), whole("amount"))
    both = e.join(budgets.where("budget is not null").select("allotment", whole("budget")), "allotment")
    return both.repartition("allotment").sortWithinPartitions("allotment", "seq").mapInArrow(fold, SCHEMA)


def eligible(offers: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``reason``: the first rule (reason, SQL condition to pass) that fails, null if none."""
    tests = [F.when(~F.coalesce(F.expr(condition), F.lit(False)), name) for name, condition in rules]
    return offers.withColumn("reason", F.coalesce(*tests, F.lit(None).cast("string")))
