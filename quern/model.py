"""Tables, indexes and the errors of requests."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


class ValidationError(ValueError):
    """A request that breaks a rule; raised before a plan is built."""


class ConditionFailed(Exception):
    """A write whose condition some item doesn't meet."""


@dataclass(frozen=True)
class IndexDef:
    """projection: ALL, KEYS_ONLY, or a tuple of attributes to include beside the keys."""

    name: str
    hash: tuple[str, ...]
    range: tuple[str, ...] = ()
    projection: str | tuple[str, ...] = "ALL"
    local: bool = False


@dataclass(frozen=True)
class VectorIndexDef:
    name: str
    attribute: str
    dims: int
    distance: str = "COSINE"
    hash: str | None = None
    filters: tuple[str, ...] = ()
    projection: str | tuple[str, ...] = "ALL"


@dataclass(frozen=True)
class TableDef:
    """An item table over a DataFrame: an attribute is a column, a missing attribute is NULL, a set is a sorted array (named in sets)."""

    name: str
    df: DataFrame
    hash: tuple[str, ...]
    range: tuple[str, ...] = ()
    indexes: tuple[IndexDef, ...] = ()
    vectors: tuple[VectorIndexDef, ...] = ()
    ttl: str | None = None
    view_type: str = "NEW_AND_OLD_IMAGES"
    sets: tuple[str, ...] = ()
    tags: dict = field(default_factory=dict)

    @property
    def keys(self) -> tuple[str, ...]:
        return self.hash + self.range

    def index(self, name: str) -> IndexDef:
        for i in self.indexes:
            if i.name == name:
                return i
        if any(v.name == name for v in self.vectors):
            raise ValidationError(f"{name} is a vector index; it can only be searched")
        raise ValidationError(f"no index {name} in table {self.name}")

    def with_df(self, df: DataFrame) -> TableDef:
        return replace(self, df=df)
