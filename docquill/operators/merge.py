"""JSON Merge Patch (RFC 7396)."""

from __future__ import annotations

from typing import Any

from docquill.sources.jsontext import Members, is_object


class MergeError(ValueError):
    """code: DuplicateName (in the patch) or TargetDuplicateName."""

    def __init__(self, code: str, name: str) -> None:
        super().__init__(f"{code}: {name}")
        self.code = code


def checked(patch: Any) -> Any:
    """The patch, if no object in it repeats a name."""
    stack = [patch]
    while stack:
        v = stack.pop()
        if isinstance(v, Members):
            names = [k for k, _ in v]
            raise MergeError("DuplicateName", next(n for n in names if names.count(n) > 1))
        stack += v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
    return patch


def merge(target: Any, patch: Any) -> Any:
    """The merged document; replaced members keep their place, new ones follow in the patch's order; no recursion."""

    def base(target: Any) -> dict:
        if isinstance(target, Members):
            names = [k for k, _ in target]
            raise MergeError("TargetDuplicateName", next(n for n in names if names.count(n) > 1))
        return dict(target) if is_object(target) else {}

    if not is_object(patch):
        return patch
    root = base(target)
    work = [(root, patch)]
    while work:
        out, p = work.pop()
        for name, x in p.items():
            if x is None:
                out.pop(name, None)
            elif is_object(x):
                inner = base(out.get(name))
                out[name] = inner
                work.append((inner, x))
            else:
                out[name] = x
    return root
