"""Declared types: plain immutable descriptions that live on the driver.

A type has a kind, constraints and possibly a base. Deriving only ever tightens:
all constraints along the chain hold. What is displayed for an attribute is the
nearest definition, which may be looser than what is enforced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as _field, replace
from typing import Any

from pyspark.sql import Column

#: Which attributes a kind takes.
ATTRIBUTES = {
    "integer": ("min", "max"),
    "float": ("min", "max"),
    "bool": (),
    "string": ("min_length", "max_length", "pattern"),
    "vector": ("element", "min_length", "max_length"),
    "tuple": ("elements",),
    "map": ("key", "value", "fields", "strict", "exactly_one"),
    "any": (),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: "Type"
    mandatory: bool = True
    default: Any = None


@dataclass(frozen=True)
class Type:
    kind: str
    name: str | None = None
    base: "Type | None" = None
    own: dict[str, Any] = _field(default_factory=dict)
    predicate: Callable[[Column], Column] | None = None
    canonical: Callable[[Column], Column] | None = None
    abstract: bool = False

    def __post_init__(self):
        for a in self.own:
            if a not in ATTRIBUTES[self.kind]:
                raise TypeError(f"{self.kind} has no attribute {a!r}")

    def __call__(self, **attrs) -> "Type":
        """The same type without arguments; else an unnamed, tighter one."""
        return derive(None, self, **attrs) if attrs else self

    def chain(self) -> list["Type"]:
        """Root first."""
        return [*(self.base.chain() if self.base else []), self]

    def displayed(self) -> dict[str, Any]:
        """Nearest definition of each attribute."""
        return {k: v for t in self.chain() for k, v in t.own.items()}

    def enforced(self) -> dict[str, Any]:
        """Intersection of all definitions; patterns are gathered."""
        out: dict[str, Any] = {}
        for t in self.chain():
            for k, v in t.own.items():
                if k == "pattern":
                    out.setdefault(k, []).append(v)
                elif k in ("min", "min_length"):
                    out[k] = max(out.get(k, v), v)
                elif k in ("max", "max_length"):
                    out[k] = min(out.get(k, v), v)
                elif k == "strict":
                    out[k] = out.get(k, False) or v
                else:
                    out.setdefault(k, []).append(v)
        return out

    def predicates(self) -> list[Callable[[Column], Column]]:
        return [t.predicate for t in self.chain() if t.predicate is not None]

    def canonical_form(self) -> Callable[[Column], Column] | None:
        """Nearest definition; never part of validation."""
        return next((t.canonical for t in reversed(self.chain()) if t.canonical), None)

    @property
    def is_abstract(self) -> bool:
        return self.abstract


def integer(**attrs) -> Type:
    return Type("integer", own=attrs)


def floating(**attrs) -> Type:
    return Type("float", own=attrs)


def boolean() -> Type:
    return Type("bool")


def string(**attrs) -> Type:
    return Type("string", own=attrs)


def vector(**attrs) -> Type:
    return Type("vector", own=attrs)


def tuple_of(*elements: Type) -> Type:
    """A fixed number of positions, each of its type; a predicate on it has no effect."""
    return Type("tuple", own={"elements": tuple(elements)} if elements else {})


def mapping(**attrs) -> Type:
    return Type("map", own=attrs)


def record(*fields: Field, strict: bool = False, exactly_one: tuple[str, ...] = (), predicate=None, canonical=None, name: str | None = None) -> Type:
    """A record; of the fields named by ``exactly_one`` a row gives one and leaves the others null."""
    return Type("map", name=name, own={"fields": tuple(fields), "strict": strict} | ({"exactly_one": exactly_one} if exactly_one else {}), predicate=predicate, canonical=canonical)


def field(name: str, type: Type, mandatory: bool = True, default: Any = None) -> Field:
    """A field with a default may be left out."""
    return Field(name, type, mandatory and default is None, default)


def derive(name: str | None, base: Type, predicate=None, canonical=None, abstract: bool = False, **attrs) -> Type:
    """A type under ``base``. An unnamed base without predicate is merged, a named one is kept in the chain."""
    if base.name is None and base.base is None and base.predicate is None and not base.abstract:
        return replace(base, name=name, own={**base.own, **attrs}, predicate=predicate, canonical=canonical or base.canonical, abstract=abstract)
    if base.kind == "tuple":
        predicate = None
    return Type(base.kind, name, base, attrs, predicate, canonical, abstract)


def abstract(name: str) -> Type:
    return Type("any", name=name, abstract=True)
