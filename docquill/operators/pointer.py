"""JSON Pointer (RFC 6901): parsing, algebra, location of one value."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

from docquill.sources.jsontext import Members, is_array, is_object

INDEX = re.compile(r"0|[1-9][0-9]*")
MAX_INDEX = 2**31 - 1
# What a URI fragment may hold besides letters and digits (RFC 3986).
FRAGMENT = "-._~!$&'()*+,;=:@/?"


class PointerError(ValueError):
    """code: MissingSlash, InvalidEscape, InvalidFragment, MemberNotFound, DuplicateName, InvalidIndex, IndexOutOfRange, NotAContainer; depth: which token."""

    def __init__(self, code: str, depth: int = 0) -> None:
        super().__init__(f"{code} at token {depth}")
        self.code, self.depth = code, depth


@dataclass(frozen=True)
class Pointer:
    tokens: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str) -> Pointer:
        if not text:
            return cls()
        if text[0] != "/":
            raise PointerError("MissingSlash")
        if re.search("~(?![01])", text):
            raise PointerError("InvalidEscape")
        return cls(tuple(t.replace("~1", "/").replace("~0", "~") for t in text[1:].split("/")))

    @classmethod
    def parse_fragment(cls, text: str) -> Pointer:
        body = text[1:]
        if text[:1] != "#" or not re.fullmatch(rf"(?:%[0-9A-Fa-f]{{2}}|[A-Za-z0-9{re.escape(FRAGMENT)}])*", body):
            raise PointerError("InvalidFragment")
        try:
            return cls.parse(re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), body.encode("ascii")).decode())
        except UnicodeError:
            raise PointerError("InvalidFragment") from None

    def __str__(self) -> str:
        return "".join("/" + t.replace("~", "~0").replace("/", "~1") for t in self.tokens)

    def fragment(self) -> str:
        return "#" + quote(str(self), safe=FRAGMENT)

    @property
    def parent(self) -> Pointer | None:
        return Pointer(self.tokens[:-1]) if self.tokens else None

    @property
    def last(self) -> str | None:
        return self.tokens[-1] if self.tokens else None

    def append(self, token: str | int) -> Pointer:
        return Pointer((*self.tokens, str(token)))

    def is_proper_prefix_of(self, other: Pointer) -> bool:
        return len(self.tokens) < len(other.tokens) and other.tokens[: len(self.tokens)] == self.tokens

    def values(self, root: Any) -> list[Any]:
        """The values on the way, the root first; raises PointerError."""
        out = [root]
        for depth, token in enumerate(self.tokens):
            out.append(step(out[-1], token, depth))
        return out

    def resolve(self, root: Any) -> Any:
        return self.values(root)[-1]


def array_index(token: str) -> int | None:
    """The index that a token is: 0 or without leading zeros; None if it isn't one, MAX_INDEX if it is larger."""
    if not INDEX.fullmatch(token):
        return None
    return MAX_INDEX if len(token) > 10 else min(int(token), MAX_INDEX)


def step(v: Any, token: str, depth: int = 0) -> Any:
    if is_object(v):
        if isinstance(v, Members):
            found = [x for k, x in v if k == token]
            if len(found) > 1:
                raise PointerError("DuplicateName", depth)
        else:
            found = [v[token]] if token in v else []
        if not found:
            raise PointerError("MemberNotFound", depth)
        return found[0]
    if is_array(v):
        i = array_index(token)
        if i is None:
            raise PointerError("InvalidIndex", depth)
        if i >= len(v):
            raise PointerError("IndexOutOfRange", depth)
        return v[i]
    raise PointerError("NotAContainer", depth)
