"""Fluent columns to basic features and back, as column expressions.

forward() turns a table of text cells (empty or null is unobserved) into basic features in one select; only text and tags need a
pass before, for their vocabulary. backward() is the inverse projection. A plan is plain data and is stored as JSON.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.plans.schema import FALSEY, TRUTHY, SchemaError, check_columns, parse_fluent

#: Days are counted from here.
EPOCH = "2014-03-31 00:00:00"
#: A word is a feature if it is in more texts than this share of the most frequent word's.
WORD_SHARE = 0.01


def cell(name: str) -> Column:
    """A cell without outer blanks; empty is null."""
    c = F.trim(F.col(f"`{name}`").cast("string"))
    return F.when(c != "", c)


def words(c: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != ""))


def document_frequency(df: DataFrame, name: str) -> DataFrame:
    """word, n: the number of texts that hold it."""
    return df.select(F.explode(words(F.col(f"`{name}`"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame, name: str, share: float = WORD_SHARE) -> DataFrame:
    """Words in more texts than `share` of the most frequent word's, with their counts. An empty table has none."""
    n = document_frequency(df, name)
    top = n.agg(F.max("n").alias("top"))
    return n.crossJoin(F.broadcast(top)).where(F.col("n") > share * F.col("top")).select("word", "n")


def boolean(c: Column) -> Column:
    """Boolean as text to boolean; other spellings are an error at run time."""
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean")
    return F.when(c.isNull(), None).when(c.isin(*TRUTHY), True).when(c.isin(*FALSEY), False).otherwise(bad)


def percent(c: Column) -> Column:
    return F.regexp_replace(c, "%", "").cast("double") * 0.01


def timestamp(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def days(late: Column, early: Column) -> Column:
    """Days between two timestamps, as a fraction."""
    return F.timestamp_diff("MICROSECOND", early, late) / 86_400_000_000.0


def date_parts(c: Column) -> dict[str, Column]:
    """absolute days since EPOCH, and month, day of month, weekday (Monday 0) and hour as categories."""
    return {"absolute": days(c, F.lit(EPOCH).cast("timestamp_ntz")), "mod.year": F.month(c), "mod.month": F.dayofmonth(c), "mod.week": F.weekday(c), "mod.day": F.hour(c)}


@dataclass
class Step:
    """One declared column: its fluent type, what it becomes, and what its backward step needs."""

    name: str
    kind: str
    optional: bool
    words: list[str] = field(default_factory=list)
    tare: float | None = None
    later_than: list[str] = field(default_factory=list)

    @property
    def value(self) -> str:
        return f"{self.name}.value" if self.optional else self.name

    def outputs(self) -> dict[str, str]:
        """Basic features of this column and their models."""
        out = {f"{self.name}.present": "bb"} if self.optional else {}
        v = self.value
        if self.kind == "boolean":
            out[v] = "bb"
        elif self.kind == "categorical":
            out[v] = "dd"
        elif self.kind == "unbounded_categorical":
            out[v] = "dpd"
        elif self.kind == "count":
            out[v] = "gp"
        elif self.kind in ("real", "percent"):
            out[v] = "nich"
        elif self.kind == "sparse_real":
            out |= {f"{v}.nonzero": "bb", f"{v}.value": "nich"}
        elif self.kind == "date":
            out |= {f"{v}.absolute": "nich", f"{v}.mod.year": "dpd", f"{v}.mod.month": "dpd", f"{v}.mod.week": "dpd", f"{v}.mod.day": "dpd"}
            out |= {f"{v}.minus.{r}": "nich" for r in self.later_than}
        elif self.kind in ("text", "tags"):
            out |= {f"{v}.{w}": "bb" for w in self.words}
        return out

    def forward(self) -> dict[str, Column]:
        c, v = cell(self.name), self.value
        out = {f"{self.name}.present": c.isNotNull()} if self.optional else {}
        if self.kind == "boolean":
            out[v] = boolean(c)
        elif self.kind in ("categorical", "unbounded_categorical"):
            out[v] = F.lower(c)
        elif self.kind == "count":
            out[v] = c.cast("bigint")
        elif self.kind == "real":
            out[v] = c.cast("double")
        elif self.kind == "percent":
            out[v] = percent(c)
        elif self.kind == "sparse_real":
            d = c.cast("double")
            out |= {f"{v}.nonzero": d != F.lit(self.tare), f"{v}.value": F.when(d != F.lit(self.tare), d)}
        elif self.kind == "date":
            t = timestamp(c)
            parts = date_parts(t)
            out |= {f"{v}.{p}": (x if p == "absolute" else x.cast("string")) for p, x in parts.items()}
            out |= {f"{v}.minus.{r}": days(t, timestamp(cell(r))) for r in self.later_than}
        elif self.kind in ("text", "tags"):
            text = F.coalesce(c, F.lit("")) if self.kind == "tags" and not self.optional else c
            held = words(text)
            out |= {f"{v}.{w}": F.array_contains(held, w) for w in self.words}
        return out

    def backward(self) -> Column:
        """The fluent cell as text; null where it is unobserved or absent."""
        v = self.value
        col = lambda n: F.col(f"`{n}`")
        if self.kind == "boolean":
            c = F.when(col(v), "1").when(~col(v), "0")
        elif self.kind == "percent":
            c = F.concat((col(v) * 100).cast("string"), F.lit("%"))
        elif self.kind == "sparse_real":
            c = F.when(col(f"{v}.nonzero"), col(f"{v}.value")).when(~col(f"{v}.nonzero"), F.lit(self.tare)).cast("string")
        elif self.kind == "date":
            micros = F.round(col(f"{v}.absolute") * 86_400_000_000.0).cast("bigint")
            c = F.timestamp_add("MICROSECOND", micros, F.lit(EPOCH).cast("timestamp_ntz")).cast("string")
        elif self.kind in ("text", "tags"):
            held = [F.when(col(f"{v}.{w}"), F.lit(w)) for w in self.words]
            known = F.coalesce(*[col(f"{v}.{w}") for w in self.words]).isNotNull() if self.words else F.lit(False)
            c = F.when(known, F.concat_ws(" ", *held))
        else:
            c = col(v).cast("string")
        return F.when(F.coalesce(col(f"{self.name}.present"), F.lit(True)), c) if self.optional else c


@dataclass
class TransformPlan:
    """All steps of a schema, and the id column if there is one."""

    steps: list[Step]
    id_column: str | None = None

    def models(self) -> dict[str, str]:
        return {f: m for s in self.steps for f, m in s.outputs().items()}

    def forward_set(self, names: list[str]) -> set[str]:
        """Basic features that fluent columns become."""
        by = {s.name: s for s in self.steps}
        unknown = [n for n in names if n not in by]
        if unknown:
            raise ValueError(f"unknown columns: {', '.join(unknown)}")
        return {f for n in names for f in by[n].outputs()}

    def forward(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """One projection: kept columns, then the basic features in order of name."""
        made = {f: c for s in self.steps for f, c in s.forward().items()}
        return df.select(*[F.col(f"`{k}`") for k in keep or []], *[made[f].alias(f) for f in sorted(made)])

    def backward(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        return df.select(*[F.col(f"`{k}`") for k in keep or []], *[s.backward().alias(s.name) for s in self.steps])

    def to_json(self) -> str:
        return json.dumps({"id": self.id_column, "steps": [asdict(s) for s in self.steps]}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> TransformPlan:
        d = json.loads(text)
        return cls([Step(**s) for s in d["steps"]], d["id"])


def make_plan(df: DataFrame, schema: list[tuple[str, str]]) -> TransformPlan:
    """Steps for a fluent schema. Text and tags get their vocabulary in one pass each; a sparse real's tare is its most frequent value.

    Dates get the days since every other date column whose name sorts before. An optional date isn't compared with itself.
    """
    parsed = parse_fluent(schema)
    check_columns([n for n, _, _ in parsed], df.columns)
    ids = [n for n, k, _ in parsed if k == "id"]
    if len(ids) > 1:
        raise SchemaError("there is more than one id column")
    dates = [n for n, k, _ in parsed if k == "date"]
    steps = []
    for name, kind, optional in parsed:
        if kind == "id":
            continue
        step = Step(name, kind, optional)
        if kind in ("text", "tags"):
            step.words = [r.word for r in vocabulary(df.select(F.col(f"`{name}`")), name).orderBy("word").collect()]
        elif kind == "sparse_real":
            top = df.select(cell(name).cast("double").alias("v")).where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").first()
            step.tare = top.v if top else 0.0
        elif kind == "date":
            step.later_than = [d for d in dates if d < name]
        steps.append(step)
    return TransformPlan(steps, ids[0] if ids else None)
