"""Composable SQL: templates with {name} places that render to SQL text and named parameters.

A value becomes a parameter, bound once however often its name occurs; a fragment is spliced in parentheses with its parameters
renamed; {a.b} reads an attribute. {{ and }} are braces; what stands in quotes or after -- and the host's own :names stay as they are.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from brindle.plans.dialect import BindError

_PLACE = re.compile(r"'[^']*'|--[^\n]*|\{\{|\}\}|\{([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\}|[{}]")
_NAME = re.compile(r"'[^']*'|--[^\n]*|(?<![:\w]):([A-Za-z_]\w*)")


class RenderError(ValueError):
    """A place without a value, or a brace without its pair."""


def to_param(v):
    if isinstance(v, bool):
        return int(v)
    if v is None or isinstance(v, (int, float, str, uuid.UUID)):
        return v
    if isinstance(v, (list, tuple)):
        return [to_param(x) for x in v]
    raise BindError(f"{type(v).__name__} can't be a parameter")


@dataclass
class Fragment:
    template: str
    values: dict

    def render(self) -> tuple[str, dict]:
        """(sql, parameters)."""
        params: dict = {}
        prefix: dict[str, str] = {}

        def place(m: re.Match) -> str:
            if m[0] in ("{{", "}}"):
                return m[0][0]
            if m[0] in "{}":
                raise RenderError(f"unbalanced brace at {m.start()}")
            if m[1] is None:
                return m[0]
            head, *rest = m[1].split(".")
            if head not in self.values:
                raise RenderError(f"no value for {head}")
            v = self.values[head]
            for part in rest:
                v = getattr(v, part)
            if isinstance(v, Fragment):
                sql, inner = v.render()
                tag = prefix.setdefault(m[1], f"f{len(prefix)}_")
                params.update({tag + k: x for k, x in inner.items()})
                return "(" + _NAME.sub(lambda n: f":{tag}{n[1]}" if n[1] in inner else n[0], sql) + ")"
            name = f"d{len(rest)}_" + "_".join([head, *rest]) if rest else head
            params[name] = to_param(v)
            return f":{name}"

        return _PLACE.sub(place, self.template), params


def sql(template: str, **values) -> Fragment:
    return Fragment(template, values)
