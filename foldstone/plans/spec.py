"""Declared states: kind, types, expiry, and which changes of a declaration are allowed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

#: Kinds of state and their codes in exported items.
KINDS = {"PQ": 0, "VALUE": 1, "LIST": 2, "MAP": 3, "SUB_VALUE": 4, "SUB_LIST": 5, "SUB_MAP": 6}
#: Operations that each kind refuses.
REFUSED = {
    "VALUE": {"merge_namespaces"},
    "LIST": {"merge_namespaces"},
    "MAP": {"put_whole_map", "merge_namespaces"},
    "SUB_VALUE": set(),
    "SUB_LIST": {"get_all_namespaces", "remove_key", "poll", "peek", "iterator"},
    "SUB_MAP": {"put_whole_map", "get_all_namespaces", "remove_key", "iterator"},
    "PQ": {"merge_namespaces"},
}


class IncompatibleState(ValueError):
    """A declaration that cannot take over existing state."""


@dataclass(frozen=True)
class StateSpec:
    name: str
    kind: str
    key: T.DataType
    value: T.DataType
    namespace: T.DataType | None = None
    subkey: T.DataType | None = None
    ttl_ms: int = -1
    ttl_on: bool = True

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")
        if self.kind.startswith("SUB_") != (self.namespace is not None):
            raise ValueError("exactly the SUB_ kinds have a namespace")
        if ("MAP" in self.kind) != (self.subkey is not None):
            raise ValueError("exactly the map kinds have a subkey")

    @property
    def effective_ttl_ms(self) -> int:
        return self.ttl_ms if self.ttl_on and self.ttl_ms > 0 else -1

    def require(self, operation: str) -> None:
        if operation in REFUSED[self.kind]:
            raise NotImplementedError(f"{operation} is not supported by {self.kind} state")

    def reregistered(self, new: StateSpec) -> StateSpec:
        """The declaration after registering `new` over this one: only a positive TTL changes the TTL."""
        self.check(new)
        return replace(new, ttl_ms=new.ttl_ms if new.ttl_ms > 0 else self.ttl_ms)

    def check(self, new: StateSpec) -> None:
        if (self.name, self.kind) != (new.name, new.kind):
            raise IncompatibleState("name and kind of a state are fixed")
        for part in ("key", "namespace", "subkey"):
            if getattr(self, part) != getattr(new, part):
                raise IncompatibleState(f"the {part} type of a state is fixed")
        if self.kind == "PQ" and self.value != new.value:
            raise IncompatibleState("timers cannot be migrated")
        if not _widens(self.value, new.value):
            raise IncompatibleState(f"no migration from {self.value.simpleString()} to {new.value.simpleString()}")


_ORDER = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def _widens(old: T.DataType, new: T.DataType) -> bool:
    """Values of `old` can be cast to `new` without loss of rows; structs may gain nullable fields."""
    if old == new or isinstance(new, T.StringType) and not isinstance(old, (T.ArrayType, T.MapType, T.StructType)):
        return True
    if type(old) in _ORDER and type(new) in _ORDER:
        return _ORDER.index(type(old)) <= _ORDER.index(type(new))
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        had = {f.name: f for f in old}
        return all(_widens(had[f.name].dataType, f.dataType) if f.name in had else f.nullable for f in new)
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return _widens(old.elementType, new.elementType)
    return False
