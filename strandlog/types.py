"""Descriptions of types: an algebra that runs on the driver, beside Spark's schemas.

A description is one of ten constructors, all immutable. Text forms: `int`,
`{a:int}`, `(int*char)`, `(int+char)`, `|A, B|`, `[int]`, `[:int|3:]`, `^x.t`,
`\\a.t`, `f(x)`.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

from pyspark.sql import types as T


@dataclass(frozen=True)
class Desc:
    def parts(self) -> Iterator[Desc]:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Desc):
                yield v
            elif isinstance(v, tuple):
                yield from (x for e in v for x in (e if isinstance(e, tuple) else (e,)) if isinstance(x, Desc))


@dataclass(frozen=True)
class Nat(Desc):
    value: int


@dataclass(frozen=True)
class Prim(Desc):
    name: str
    rep: Desc | None = None


@dataclass(frozen=True)
class Var(Desc):
    name: str


@dataclass(frozen=True)
class FixedArray(Desc):
    of: Desc
    size: Desc


@dataclass(frozen=True)
class Array(Desc):
    of: Desc


@dataclass(frozen=True)
class Variant(Desc):
    ctors: tuple[tuple[str, Desc], ...]


@dataclass(frozen=True)
class Record(Desc):
    fields: tuple[tuple[str, Desc], ...]


@dataclass(frozen=True)
class Recursive(Desc):
    var: str
    body: Desc


@dataclass(frozen=True)
class Fn(Desc):
    args: tuple[str, ...]
    body: Desc


@dataclass(frozen=True)
class App(Desc):
    fn: Desc
    args: tuple[Desc, ...]


UNIT = Prim("()")
_KINDS = {c.__name__: c for c in (Nat, Prim, Var, FixedArray, Array, Variant, Record, Recursive, Fn, App)}


def tup(*of: Desc) -> Desc:
    return Record(tuple((f".f{i}", t) for i, t in enumerate(of))) if of else UNIT


def sum_(*of: Desc) -> Desc:
    return Variant(tuple((f".f{i}", t) for i, t in enumerate(of)))


def enum(*names: str) -> Desc:
    return Variant(tuple((n, UNIT) for n in names))


def list_(of: Desc) -> Desc:
    return Recursive("x", sum_(UNIT, tup(of, Var("x"))))


def is_tuple(d: Desc) -> bool:
    return isinstance(d, Record | Variant) and all(n == f".f{i}" for i, (n, _) in enumerate(_named(d)))


def is_enum(d: Desc) -> bool:
    return isinstance(d, Variant) and not is_tuple(d) and all(t == UNIT for _, t in d.ctors)


def _named(d: Record | Variant) -> tuple[tuple[str, Desc], ...]:
    return d.fields if isinstance(d, Record) else d.ctors


def text(d: Desc) -> str:
    match d:
        case Nat(n):
            return str(n)
        case Prim(n, _) | Var(n):
            return n
        case FixedArray(t, n):
            return f"[:{text(t)}|{text(n)}:]"
        case Array(t):
            return f"[{text(t)}]"
        case Record(fs) if is_tuple(d):
            return "(" + "*".join(text(t) for _, t in fs) + ")"
        case Record(fs):
            return "{" + ", ".join(f"{n}:{text(t)}" for n, t in fs) + "}"
        case Variant(cs) if is_tuple(d):
            return "(" + "+".join(text(t) for _, t in cs) + ")"
        case Variant(cs):
            return "|" + ", ".join(n if t == UNIT else f"{n}:{text(t)}" for n, t in cs) + "|"
        case Recursive(v, t):
            return f"^{v}.{text(t)}"
        case Fn(a, t):
            return "\\" + " ".join(a) + f".{text(t)}"
        case App(f, a):
            return f"{text(f)}({', '.join(map(text, a))})"
    raise TypeError(d)


def encode(d: Desc) -> str:
    """Canonical JSON: equal descriptions, equal text."""

    def plain(v):
        if isinstance(v, Desc):
            return {"is": type(v).__name__, **{f.name: plain(getattr(v, f.name)) for f in fields(v)}}
        return [plain(x) for x in v] if isinstance(v, tuple) else v

    return json.dumps(plain(d), sort_keys=True, separators=(",", ":"))


def decode(s: str) -> Desc:
    def back(v):
        if isinstance(v, dict):
            return _KINDS[v["is"]](**{k: back(x) for k, x in v.items() if k != "is"})
        return tuple(map(back, v)) if isinstance(v, list) else v

    return back(json.loads(s))


def fingerprint(d: Desc) -> str:
    return hashlib.sha256(encode(d).encode()).hexdigest()


def rebuild(d: Desc, f: Callable[[Desc], Desc]) -> Desc:
    """d with f applied to its parts."""

    def on(v):
        return f(v) if isinstance(v, Desc) else tuple(map(on, v)) if isinstance(v, tuple) else v

    return type(d)(**{x.name: on(getattr(d, x.name)) for x in fields(d)})


def equivalent(a: Desc, b: Desc) -> bool:
    """Equal in structure: primitives by name, whatever represents them; bound names do not matter."""

    def same(a: Desc, b: Desc, bound: dict[str, str]) -> bool:
        if type(a) is not type(b):
            return False
        match a:
            case Prim(n, _):
                return n == b.name
            case Nat(n):
                return n == b.value
            case Var(n):
                return bound.get(n, n) == b.name
            case Record() | Variant():
                x, y = _named(a), _named(b)
                return len(x) == len(y) and all(m == n and same(s, t, bound) for (m, s), (n, t) in zip(x, y, strict=True))
            case Recursive(v, t):
                return same(t, b.body, bound | {v: b.var})
            case Fn(v, t):
                return len(v) == len(b.args) and same(t, b.body, bound | dict(zip(v, b.args, strict=True)))
        x, y = list(a.parts()), list(b.parts())
        return len(x) == len(y) and all(same(s, t, bound) for s, t in zip(x, y, strict=True))

    return same(a, b, {})


def free(d: Desc) -> set[str]:
    match d:
        case Var(n):
            return {n}
        case Recursive(v, t):
            return free(t) - {v}
        case Fn(v, t):
            return free(t) - set(v)
    return set().union(*map(free, d.parts()))


def substitute(d: Desc, by: dict[str, Desc]) -> Desc:
    """Without capture: bound names that clash are renamed."""
    match d:
        case Var(n):
            return by.get(n, d)
        case Recursive(v, t):
            (v,), t = _fresh((v,), t, by)
            return Recursive(v, substitute(t, {k: x for k, x in by.items() if k != v}))
        case Fn(v, t):
            v, t = _fresh(v, t, by)
            return Fn(v, substitute(t, {k: x for k, x in by.items() if k not in v}))
    return rebuild(d, lambda x: substitute(x, by))


def _fresh(names: tuple[str, ...], body: Desc, by: dict[str, Desc]) -> tuple[tuple[str, ...], Desc]:
    taken = set().union(*(free(x) for k, x in by.items() if k not in names))
    new: list[str] = []
    for n in names:
        m = n
        while m in taken or m in new or m != n and m in free(body):
            m += "'"
        new.append(m)
    return tuple(new), substitute(body, {n: Var(m) for n, m in zip(names, new, strict=True) if n != m})


def apply(fn: Desc, args: tuple[Desc, ...]) -> Desc:
    if not isinstance(fn, Fn):
        raise TypeError(f"not a function: {text(fn)}")
    if len(fn.args) != len(args):
        raise TypeError(f"{len(fn.args)} arguments are needed, {len(args)} given: {text(fn)}")
    return substitute(fn.body, dict(zip(fn.args, args, strict=True)))


def representation(d: Desc) -> Desc:
    """Without names of new types and applications."""
    match d:
        case Prim(_, r) if r is not None:
            return representation(r)
        case App(f, a):
            f = representation(f)
            return representation(apply(f, a)) if isinstance(f, Fn) else App(f, tuple(map(representation, a)))
    return rebuild(d, representation)


#: Bytes of primitives: fixed values of the data model.
SIZES = {"()": 0, "bool": 1, "byte": 1, "char": 1, "short": 2, "int": 4, "long": 8, "int128": 16, "float": 4, "double": 8}


def layout(d: Desc) -> tuple[int, int]:
    """(size, alignment) in bytes; unions begin with a four-byte tag."""
    match d:
        case Prim(_, r) if r is not None:
            return layout(r)
        case Prim(n, None) if n in SIZES:
            return SIZES[n], max(1, SIZES[n])
        case Record():
            return _end(d)[0], _end(d)[1]
        case Variant(cs):
            of = [layout(t) for _, t in cs]
            align = max([4, *(a for _, a in of)])
            return _up(_up(4, align) * bool([s for s, _ in of if s]) + max([s for s, _ in of], default=0) or 4, align), align
        case FixedArray(t, Nat(n)):
            size, align = layout(t)
            return size * n, align
        case Array() | Recursive():
            return 8, 8
    raise TypeError(f"no layout: {text(d)}")


def _up(x: int, to: int) -> int:
    return -(-x // to) * to


def _end(d: Record) -> tuple[int, int]:
    at, most = 0, 1
    for _, t in d.fields:
        size, align = layout(t)
        at, most = _up(at, align) + size, max(most, align)
    return _up(at, most), most


def offsets(d: Record) -> list[tuple[str, int]]:
    out, at = [], 0
    for n, t in d.fields:
        size, align = layout(t)
        at = _up(at, align)
        out.append((n, at))
        at += size
    return out


def flattened(d: Desc, prefix: str = "") -> list[tuple[str, Desc]]:
    """Columns of a record, nested names joined by _, tuple fields by number; anything else is one column."""
    if not isinstance(d, Record):
        return [(prefix, d)]
    out = []
    for n, t in d.fields:
        n = n.removeprefix(".f") if n.startswith(".f") else n
        out += flattened(t, f"{prefix}_{n}" if prefix else n)
    return out


_TO_SPARK = {
    "bool": T.BooleanType(), "byte": T.ShortType(), "char": T.StringType(), "short": T.ShortType(), "ushort": T.IntegerType(), "int": T.IntegerType(), "uint": T.LongType(),
    "long": T.LongType(), "ulong": T.DecimalType(20, 0), "int128": T.DecimalType(38, 0), "float": T.FloatType(), "double": T.DoubleType(), "datetime": T.TimestampNTZType(), "timespan": T.DayTimeIntervalType(),
}


def to_spark(d: Desc) -> T.DataType:
    match d:
        case Prim("()", _):
            return T.StructType([])
        case Prim(n, r):
            return _TO_SPARK[n] if n in _TO_SPARK else to_spark(r)
        case Array(Prim("char", _)):
            return T.StringType()
        case Array(t) | FixedArray(t, _):
            return T.ArrayType(to_spark(t))
        case Record(fs):
            return T.StructType([T.StructField(n.replace(".f", "_"), to_spark(t)) for n, t in fs])
        case Variant() if is_enum(d):
            return T.StringType()
        case Variant(cs):
            return T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(n.replace(".f", "_"), to_spark(t)) for n, t in cs)])
        case Recursive():
            return T.VariantType()
    raise TypeError(f"no Spark type: {text(d)}")


def from_spark(t: T.DataType) -> Desc:
    match t:
        case T.StructType():
            return Record(tuple((f.name, from_spark(f.dataType)) for f in t.fields)) if t.fields else UNIT
        case T.ArrayType():
            return Array(from_spark(t.elementType))
        case T.StringType():
            return Array(Prim("char"))
        case T.TimestampNTZType() | T.TimestampType():
            return Prim("datetime", Prim("long"))
        case T.DayTimeIntervalType():
            return Prim("timespan", Prim("long"))
        case T.BinaryType():
            return Array(Prim("byte"))
        case T.DateType():
            return Prim("date", Prim("int"))
        case T.DecimalType():
            return Prim(f"decimal({t.precision},{t.scale})", Prim("int128"))
        case T.MapType():
            return Array(tup(from_spark(t.keyType), from_spark(t.valueType)))
        case T.VariantType():
            return Prim("variant", Array(Prim("byte")))
        case T.NullType():
            return UNIT
        case T.CharType() | T.VarcharType():
            return Array(Prim("char"))
        case T.YearMonthIntervalType():
            return Prim("months", Prim("int"))
    names = {T.BooleanType: "bool", T.ShortType: "short", T.ByteType: "byte", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double"}
    return Prim(names[type(t)])


def validate(expected: list[tuple[str, Desc]], found: list[tuple[str, Desc]]) -> None:
    """Series of a log against what a reader takes, in order: more series, other names or types are errors; fewer are not."""
    for i, (name, have) in enumerate(found):
        if i >= len(expected):
            raise ValueError(f"no reader for series {i + 1}, {name}: {text(have)}")
        want_name, want = expected[i]
        if want_name != name:
            raise ValueError(f"series {i + 1} is {name}, expected {want_name}")
        if not equivalent(want, have):
            raise ValueError(f"series {name} has type {text(have)}, expected {text(want)}")
