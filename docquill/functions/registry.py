"""Function extensions: signatures, the standard five, and sets of further ones."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

VALUE, LOGICAL, NODES = "ValueType", "LogicalType", "NodesType"
FUNCTION_NAME = re.compile(r"[a-z][a-z0-9_]*\Z")


class RegistrationError(ValueError):
    """code: InvalidName, DuplicateName or InvalidType."""

    def __init__(self, code: str, name: str) -> None:
        super().__init__(f"{code}: {name}")
        self.code = code


@dataclass(frozen=True)
class Function:
    """call gets a value (or Nothing), a boolean or a list of nodes for each parameter and returns what result says."""

    name: str
    params: tuple[str, ...]
    result: str
    call: Callable[..., Any] | None = None


STANDARD = (
    Function("length", (VALUE,), VALUE),
    Function("count", (NODES,), VALUE),
    Function("match", (VALUE, VALUE), LOGICAL),
    Function("search", (VALUE, VALUE), LOGICAL),
    Function("value", (NODES,), VALUE),
)


@dataclass(frozen=True)
class Registry:
    functions: dict[str, Function] = field(default_factory=lambda: {f.name: f for f in STANDARD})

    def with_functions(self, *more: Function) -> Registry:
        out = dict(self.functions)
        for f in more:
            if not FUNCTION_NAME.match(f.name):
                raise RegistrationError("InvalidName", f.name)
            if f.name in out:
                raise RegistrationError("DuplicateName", f.name)
            if f.result not in (VALUE, LOGICAL, NODES) or not {*f.params} <= {VALUE, LOGICAL, NODES}:
                raise RegistrationError("InvalidType", f.name)
            out[f.name] = f
        return Registry(out)


DEFAULT = Registry()
