"""Predicates on memories, and the grammars that filters are written in."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of typed scalars.
NULL, BOOL, I64, F64, STR = range(5)
SCALAR = "struct<tag:tinyint,b:boolean,i:bigint,d:double,s:string>"


def scalar(value: Any) -> tuple:
    """A typed scalar as a row of SCALAR."""
    if value is None:
        return (NULL, None, None, None, None)
    if isinstance(value, bool):
        return (BOOL, value, None, None, None)
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            return (F64, None, None, float(value), None)
        return (I64, None, value, None, None)
    if isinstance(value, float):
        return (F64, None, None, value, None)
    if isinstance(value, str):
        return (STR, None, None, None, value)
    raise ValueError(f"metadata takes null, booleans, numbers and strings, not {type(value).__name__}")


@dataclass(frozen=True)
class Eq:
    value: Any


@dataclass(frozen=True)
class Range:
    low: float | None = None
    high: float | None = None


Filter = Eq | Range


def alive() -> Column:
    return ~F.col("tombstone") & ~F.col("superseded")


def in_scope(project: str | None) -> Column:
    """None: all projects. A name matches exactly; rows without a project match no name, and the empty name matches nothing."""
    if project is None:
        return F.lit(True)
    return F.lit(False) if project == "" else F.coalesce(F.col("project") == project, F.lit(False))


def by_agent(agent: str | None) -> Column:
    """None: all agents; "" matches rows of unknown agent."""
    return F.lit(True) if agent is None else F.col("agent") == agent


def _matches(key: str, wanted: Filter) -> Column:
    """Whether the value under a key matches; absent keys do not, another type is an error."""
    found = F.try_element_at(F.col("metadata"), F.lit(key))
    wrong = F.raise_error(F.concat(F.lit(f"metadata key '{key}' has another type: tag "), found["tag"].cast("string"))).cast("boolean")
    if isinstance(wanted, Eq):
        tag, *values = scalar(wanted.value)
        same = F.lit(True)
        for name, value in zip("bids", values, strict=True):
            if value is not None:
                same = found[name] == F.lit(value)
        return F.when(found.isNull(), False).when(found["tag"] != tag, wrong).otherwise(same)
    number = F.coalesce(found["i"].cast("double"), found["d"])
    inside = F.lit(True)
    if wanted.low is not None:
        inside = inside & (number >= float(wanted.low))
    if wanted.high is not None:
        inside = inside & (number <= float(wanted.high))
    return F.when(found.isNull(), False).when(~found["tag"].isin(I64, F64), wrong).otherwise(inside)


def all_match(filters: dict[str, Filter]) -> Column:
    """Conjunction in key order; a key after a failed one is not looked at, so its type is not checked."""
    keys = sorted(filters, reverse=True)
    return reduce(lambda rest, key: F.when(_matches(key, filters[key]), rest).otherwise(False), keys, F.lit(True))


def keep(project: str | None = None, agent: str | None = None, filters: dict[str, Filter] | None = None) -> Column:
    """What recall may return: alive, in scope, of the agent, matching all filters."""
    plain = alive() & in_scope(project) & by_agent(agent)
    return F.when(plain, all_match(filters)).otherwise(False) if filters else plain


def parse_scalar(text: str) -> Any:
    """Integer, float, boolean or string, whichever reads first. Digits with underscores are a string."""
    for kind in (int, float) if "_" not in text else ():
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text, text)


def _number(text: str) -> float:
    try:
        return float("" if "_" in text else text)
    except ValueError:
        raise ValueError(f"not a number: {text!r}") from None


def parse_filters(specs: list[str]) -> dict[str, Filter]:
    """k=v, k=low..high (one side may be open), k>=n, k<=n; spaces around a key do not count. Ranges of one key are merged, the first bound of a side wins; anything else twice is an error."""
    out: dict[str, Filter] = {}
    for spec in specs:
        for sign in (">=", "<=", "="):
            key, found, value = spec.partition(sign)
            if found:
                break
        key = key.strip()
        if not found or not key or sign == "=" and value.strip() == "..":
            raise ValueError(f"not a filter: {spec!r}")
        if sign == ">=":
            new: Filter = Range(low=_number(value))
        elif sign == "<=":
            new = Range(high=_number(value))
        elif ".." in value:
            low, _, high = value.partition("..")
            new = Range(_number(low) if low else None, _number(high) if high else None)
        else:
            new = Eq(parse_scalar(value))
        if key in out:
            old = out[key]
            if not (isinstance(old, Range) and isinstance(new, Range)):
                raise ValueError(f"conflicting filters on {key!r}")
            new = Range(old.low if old.low is not None else new.low, old.high if old.high is not None else new.high)
        out[key] = new
    return out


def json_filter(spec: Any) -> Filter:
    """A JSON scalar is equality; {min?, max?} a range; anything else is an error."""
    if isinstance(spec, dict):
        if not spec or set(spec) - {"min", "max"} or any(isinstance(v, bool) or not isinstance(v, int | float) for v in spec.values()):
            raise ValueError(f"a range takes numbers under min and max: {json.dumps(spec)}")
        return Range(spec.get("min"), spec.get("max"))
    scalar(spec)
    return Eq(spec)


def python_filter(spec: Any) -> Filter:
    """A scalar is equality; a pair is a range."""
    if isinstance(spec, tuple):
        if len(spec) != 2:
            raise ValueError("a range is a pair (low, high)")
        return Range(*spec)
    scalar(spec)
    return Eq(spec)
