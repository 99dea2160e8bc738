"""Fluent types (as users declare them), basic models, and the canonical order of features."""

from __future__ import annotations

from dataclasses import dataclass, field

MODEL_RANK = {"bb": 0, "dd": 1, "dpd": 2, "gp": 3, "nich": 4}
FLUENT = ("boolean", "categorical", "unbounded_categorical", "count", "real", "sparse_real", "percent", "date", "text", "tags", "id")
#: Most values of a dd feature.
DD_LIMIT = 256
OTHER = "_OTHER"
# How booleans are written.
TRUTHY = ("1", "1.0", "True", "true", "t")
FALSEY = ("0", "0.0", "False", "false", "f")


class SchemaError(ValueError):
    """A table or schema that can't be used; the message says why."""


@dataclass
class Feature:
    """A basic feature of the encoded table. symbols: value to code, for dd and dpd."""

    name: str
    model: str
    symbols: dict[str, int] = field(default_factory=dict)

    @property
    def codes(self) -> int:
        return len(self.symbols)


def canonical(features: list[Feature]) -> list[Feature]:
    """By model, then number of values (dd only), then name."""
    return sorted(features, key=lambda f: (MODEL_RANK[f.model], f.codes if f.model == "dd" else 0, f.name))


def parse_fluent(schema: list[tuple[str, str]]) -> list[tuple[str, str, bool]]:
    """(name, base type, optional) of the declared columns; columns without a type are left out."""
    out, names = [], set()
    for name, kind in schema:
        if not kind or not kind.strip():
            continue
        optional = kind.startswith("optional_")
        base = kind[len("optional_") :] if optional else kind
        if base not in FLUENT or (optional and base == "id"):
            raise SchemaError(f"unknown type {kind!r} of column {name!r}")
        if name in names:
            raise SchemaError(f"column {name!r} is declared twice")
        names.add(name)
        out.append((name, base, optional))
    if not any(b != "id" for _, b, _ in out):
        raise SchemaError("the schema has no modelled column")
    return out


def check_columns(declared: list[str], found: list[str]) -> None:
    """Missing or repeated columns are errors; others are ignored, in any order."""
    repeated = sorted({c for c in found if found.count(c) > 1} & set(declared))
    if repeated:
        raise SchemaError(f"repeated columns: {', '.join(repeated)}")
    missing = [c for c in declared if c not in found]
    if len(missing) == len(declared):
        raise SchemaError("no known column was found; is the header missing?")
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")


def check_models(models: dict[str, str]) -> None:
    if not models:
        raise SchemaError("the schema is empty")
    bad = sorted(m for m in models.values() if m not in MODEL_RANK)
    if bad:
        raise SchemaError(f"unknown models: {', '.join(bad)}")
