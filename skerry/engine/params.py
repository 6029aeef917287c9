"""Parameters of statements: named, positional and numbered, lists, records."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import json
from collections.abc import Mapping, Sequence

from ..plans.normalize import Token, raw, tokenize


def as_mapping(params: object) -> dict[str, object]:
    """Names and values of a mapping, a dataclass or an object's attributes."""
    if params is None:
        return {}
    if isinstance(params, Mapping):
        return dict(params)
    if dataclasses.is_dataclass(params) and not isinstance(params, type):
        return {f.metadata.get("db", f.name): getattr(params, f.name) for f in dataclasses.fields(params)}
    return {k: v for k, v in vars(params).items() if not k.startswith("_")}


def plain(value: object) -> object:
    """A value that Spark takes as an argument."""
    if isinstance(value, dict):
        return json.dumps(value, sort_keys=True)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(value, datetime.date):
        return value.isoformat() + " 00:00:00"
    if isinstance(value, decimal.Decimal):
        return float(value)
    if value is None or isinstance(value, (bool, int, float, str, bytes)):
        return value
    return str(value)


def listed(value: object) -> bool:
    return isinstance(value, Sequence) and not isinstance(value, (str, bytes))


def bind(sql: str, params: object) -> tuple[str, dict[str, object]]:
    """The statement with every marker as a name, and the arguments by name.

    ``:name`` reads a mapping, dataclass or object; ``?`` and ``$n`` read a sequence. A list becomes as
    many markers as it has members, an empty one NULL; values never become text of the statement,
    except that dates are wrapped in a cast.
    """
    if params is None:
        return sql, {}
    values = {f"p{i + 1}": v for i, v in enumerate(params)} if listed(params) else as_mapping(params)
    lower = {k.lower(): v for k, v in values.items()}
    args: dict[str, object] = {}
    count = 0

    def marker(name: str) -> str:
        if name.lower() not in lower:
            raise KeyError(f"no parameter {name}")
        value = lower[name.lower()]
        if listed(value):
            names = [f"{name}_{i}" for i in range(len(value))]
            args.update(zip(names, map(plain, value), strict=True))
            return ", ".join(f":{n}" for n in names) or "NULL"
        args[name] = plain(value)
        return f"CAST(:{name} AS DATETIME)" if isinstance(value, datetime.date) else f":{name}"

    def walk(tokens: list[Token]) -> None:
        nonlocal count
        for i, t in enumerate(tokens):
            if t.kind == "group":
                walk(t.body)
            elif t.kind == "param":
                if t.text == "?":
                    count += 1
                    tokens[i] = raw(marker(f"p{count}"))
                else:
                    tokens[i] = raw(marker(f"p{t.text[1:]}" if t.text[0] == "$" else t.text[1:]))

    tokens = tokenize(sql)
    walk(tokens)
    return "".join(map(str, tokens)), args
