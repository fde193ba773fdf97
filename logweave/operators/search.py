"""Predicates and filters over log records; Spark pushes what it can to the scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..model import Catalogue

TEXT_FIELDS = ("msg",)
OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}

Term = str | Column | tuple


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def none_of(*conditions: Column) -> Column:
    return ~any_of(*conditions)


def kept(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    """Rows that pass every condition; each is a filter of its own, so that Spark can push to the scan what the scan knows."""
    for c in conditions:
        df = df.where(c)
    return df


def keyword(term: str, columns: Sequence[str] = TEXT_FIELDS) -> Column:
    """Whole token, quoted phrase or quoted prefix (`"abc*"`) in any of the columns."""
    plain = term.strip('"')
    test = fn.has_prefix if plain.endswith("*") and len(plain) > 1 else fn.has_token
    return any_of(*[test(F.col(c), plain) for c in columns])


def _condition(term: Term, columns: Sequence[str]) -> Column:
    if isinstance(term, Column):
        return term
    if isinstance(term, tuple):
        name, op, value = term
        return OPERATORS[op](F.col(name), F.lit(value))
    return keyword(term, columns)


def _conflicts(terms: Sequence[Term]) -> None:
    wanted: dict[str, object] = {}
    for t in terms:
        if isinstance(t, tuple) and t[1] in ("=", "==") and not isinstance(t[2], str) and wanted.setdefault(t[0], t[2]) != t[2]:
            raise ValueError(f"{t[0]} can't be both {wanted[t[0]]} and {t[2]}")


def search(df: DataFrame, all: Sequence[Term] = (), any: Sequence[Term] = (), none: Sequence[Term] = (), default_or: bool = False, columns: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    """Rows that pass every `all` term, one `any` term if there are some, and no `none` term; each row once.

    A term is a keyword, a (field, operator, value) triple or a Column. With default_or the `all` terms count as
    `any` terms. Only `none` terms, or two different values wanted of one number field, are errors.
    """
    if default_or:
        all, any = (), [*all, *any]
    if none and not all and not any:
        raise ValueError("a search needs a term that is not excluded")
    _conflicts(all)
    tests = [_condition(t, columns) for t in all]
    if any:
        tests.append(any_of(*[_condition(t, columns) for t in any]))
    if none:
        tests.append(none_of(*[_condition(t, columns) for t in none]))
    return kept(df, tests)


def field_match(df: DataFrame, catalogue: Catalogue, name: str, value: str, exact: bool = False) -> DataFrame:
    """Rows of classes that have the field and hold the value there: as a token, or exactly."""
    test = F.col(name) == value if exact else fn.has_token(F.col(name).cast("string"), value)
    return df.where(F.col("class").isin(catalogue.having(name)) & test)


def compare(df: DataFrame, catalogue: Catalogue, name: str, op: str, value: int | str) -> DataFrame:
    """Numeric comparison of an int, address or protocol field in the classes that have it; ranges on text are errors."""
    kind = catalogue.type_of(name) or "int"
    if kind == "string" and op not in ("=", "==", "!="):
        raise ValueError(f"{name} is text and has no order")
    column, wanted = F.col(name), F.lit(value)
    if kind == "ip":
        column, wanted = fn.ip_to_long(column), fn.ip_to_long(F.lit(str(value)))
    elif kind == "proto":
        column, wanted = fn.proto_to_number(column), fn.proto_to_number(F.lit(str(value)))
    return df.where(F.col("class").isin(catalogue.having(name)) & OPERATORS[op](column, wanted))


def in_ranges(column: Column, ranges: Sequence[tuple]) -> Column:
    """Inside any range; a missing end is open."""
    one = lambda r: all_of(*([column >= r[0]] if r[0] is not None else []), *([column <= r[1]] if r[1] is not None else []))
    return any_of(*[one(r) & column.isNotNull() for r in ranges])


def not_in_ranges(column: Column, ranges: Sequence[tuple]) -> Column:
    return ~in_ranges(column, ranges)


def time_range(df: DataFrame, start: str | int | None = None, end: str | int | None = None, tz: str = "UTC") -> DataFrame:
    """Rows from start to end, both included, given as epoch seconds or as a date text in the zone tz.

    On a table written by day (a date column `day`, as the sinks write it) the days are a predicate too, which prunes
    its partitions.
    """

    def bound(x: str | int) -> Column:
        return F.timestamp_seconds(fn.parse_time(F.lit(str(x)), tz))

    tests = ([F.col("ts") >= bound(start)] if start is not None else []) + ([F.col("ts") <= bound(end)] if end is not None else [])
    if dict(df.dtypes).get("day") == "date":
        tests += ([F.col("day") >= F.to_date(bound(start))] if start is not None else []) + ([F.col("day") <= F.to_date(bound(end))] if end is not None else [])
    return kept(df, tests)


def restrict_classes(df: DataFrame, catalogue: Catalogue, fields: Sequence[str] = (), group: str | None = None, cls: str | None = None) -> DataFrame:
    """Rows of the classes that have all the fields and the group field, and are `cls` if given; none left is an error with a group."""
    allowed = set(catalogue.numbers)
    for name in [*fields, *([group] if group else [])]:
        if catalogue.having(name):
            allowed &= set(catalogue.having(name))
    if cls:
        allowed &= {cls.upper()}
    if not allowed and group:
        raise ValueError(f"no class has {group} and all the fields")
    return df.where(F.col("class").isin(sorted(allowed)))


def nodes(df: DataFrame, given: Sequence[str] = (), excluded: Sequence[str] = ()) -> DataFrame:
    test = F.col("node").isin(list(given)) if given else F.lit(True)
    return df.where(test & ~F.col("node").isin(list(excluded)) if excluded else test)


def in_imports(df: DataFrame, imports: DataFrame, all: Sequence[Column] = (), any: Sequence[Column] = (), none: Sequence[Column] = (), limit: int = 100) -> DataFrame:
    """Rows whose id lies in an import set that the conditions (over `imports`: id, name, description, type, date, first_id, last_id) choose.

    More than `limit` sets are an error; so their ranges are a predicate of bounded size on the scan.
    """
    tests = [*all, *([any_of(*any)] if any else []), *([none_of(*none)] if none else [])]
    chosen = kept(imports, tests).select("first_id", "last_id").limit(limit + 1).collect()
    if len(chosen) > limit:
        raise ValueError(f"more than {limit} import sets")
    return df.where(in_ranges(F.col("id"), [(r[0], r[1]) for r in chosen]))


def apply_permissions(df: DataFrame, permissions: DataFrame, groups: Sequence[str], admin: bool = False, limit: int = 10_000) -> DataFrame:
    """Rows that the groups may see. permissions: gid, attr (class, host, program, node or a field), value.

    A value is a name, a number range `a-b`, or `0` for all. Program and node default to all, class and host to
    nothing; a field without rows is not restricted. The rules of one user are collected, at most `limit` of them.
    """
    if admin:
        return df
    rules: dict[str, list[str]] = {}
    got = permissions.where(F.col("gid").isin(list(groups))).select("attr", "value").distinct().limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} permission rules")
    for attr, value in got:
        rules.setdefault(attr, []).append(value)
    test = F.lit(True)
    for attr in {"class", "host", *rules}:
        values = rules.get(attr, [])
        if "0" in values:
            continue
        spans = [v.split("-") for v in values if v.replace("-", "", 1).isdigit() and "-" in v]
        names = [v for v in values if not (v.replace("-", "", 1).isdigit() and "-" in v)]
        column = F.col(attr)
        test = test & any_of(column.cast("string").isin(names), in_ranges(column.try_cast("long"), [(int(a), int(b)) for a, b in spans]))
    return df.where(test)


def subnet_macro(subnets: Sequence[tuple[str, str]], side: str = "src") -> Column:
    """Whether the source or destination address lies in the subnets; side `any` means either."""
    tests = [fn.is_local(F.col(f"{s}ip"), subnets) for s in (("src", "dst") if side == "any" else (side,))]
    return any_of(*tests)


class Macros(dict):
    """Stored searches by name; each is a function that gives a Column, so it keeps its own booleans."""

    def use(self, name: str) -> Column:
        return self[name.lstrip("$")]()


def builtin_macros(local: Sequence[tuple[str, str]], orgs: dict[str, Sequence[tuple[str, str]]]) -> Macros:
    """$src_local and $dst_local, and for each organisation $org, $src_org and $dst_org under its lower-cased name: either, source or destination address in its subnets."""
    out = Macros(src_local=lambda: subnet_macro(local), dst_local=lambda: subnet_macro(local, "dst"))
    for org, subnets in orgs.items():
        for prefix, side in (("", "any"), ("src_", "src"), ("dst_", "dst")):
            out[f"{prefix}{org.lower()}"] = lambda subnets=subnets, side=side: subnet_macro(subnets, side)
    return out


def exclude_classes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(~F.col("class").isin(list(names)))


__all__ = [k for k in dir() if not k.startswith("_")]
