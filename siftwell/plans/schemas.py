"""What tables of model outputs have to look like, and what becomes of rows that do not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUTES, VERDICTS = ("simple", "complex", "graph"), ("sufficient", "insufficient", "contradictory")


@dataclass(frozen=True)
class Field:
    """A column: its type, whether it may be null or missing, and its allowed values or range."""

    kind: str
    optional: bool = False
    values: tuple[str, ...] | None = None
    low: float | None = None
    high: float | None = None

    def holds(self, c: Column) -> Column:
        good = F.lit(True)
        if self.values is not None:
            good = good & c.isin(*self.values)
        if self.low is not None:
            good = good & (c >= self.low)
        if self.high is not None:
            good = good & (c <= self.high)
        return (c.isNull() | good) if self.optional else (c.isNotNull() & good)


TOKENS = Field("long", optional=True, low=0)
CLASSIFIED = {"route": Field("string", values=ROUTES), "confidence": Field("double", low=0, high=1), "tokens": TOKENS}
DECOMPOSED = {"subqueries": Field("array<string>"), "tokens": TOKENS}
JUDGED = {"verdict": Field("string", values=VERDICTS), "refined": Field("string", optional=True), "tokens": TOKENS}
REFINED = {"refined": Field("string"), "tokens": TOKENS}
WRITTEN = {
    "answer": Field("string", optional=True), "citations": Field("array<int>", optional=True), "contradiction": Field("boolean", optional=True),
    "open_parts": Field("array<string>", optional=True), "tokens": TOKENS, "error": Field("string", optional=True),
}


def conform(rows: DataFrame, fields: dict[str, Field], keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The rows whose fields hold, as their types; one for each key; other columns as they are.

    A field that is needed and missing is an error in the step itself.  A value
    of another type counts as null.  A row that does not hold is left out: for
    its key the step has said nothing.
    """
    missing = [c for c in (*keys, *(n for n, f in fields.items() if not f.optional)) if c not in rows.columns]
    if missing:
        raise ValueError(f"a model's table lacks {', '.join(missing)}")
    out = rows
    for name, field in fields.items():
        if name in rows.columns:
            out = out.withColumn(name, F.col(name).try_cast(field.kind))
    good = F.lit(True)
    for name, field in fields.items():
        if name in rows.columns:
            good = good & F.coalesce(field.holds(F.col(name)), F.lit(False))
    return out.where(good).dropDuplicates(list(keys))
