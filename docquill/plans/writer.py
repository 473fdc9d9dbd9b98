"""Query text of a syntax tree: bracket form, no needless parentheses; parsing it gives the tree again."""

from __future__ import annotations

from docquill.plans.ast import And, Call, Compare, Exists, Filter, Holds, Index, Literal, Name, Not, Or, Query, Segment, Slice, Wildcard
from docquill.sources.jsontext import scalar_text

SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "'": "\\'", "\\": "\\\\"}
ESCAPED = str.maketrans({**{chr(c): f"\\u{c:04x}" for c in range(32)}, **SHORT})


def quoted(text: str) -> str:
    """A name or string in single quotes, as Normalized Paths write it."""
    return f"'{text.translate(ESCAPED)}'"


def write(query: Query) -> str:
    return ("$" if query.absolute else "@") + "".join(map(segment, query.segments))


def segment(s: Segment) -> str:
    return f"{'..' if s.descendant else ''}[{', '.join(map(selector, s.selectors))}]"


def selector(s) -> str:
    match s:
        case Name(name):
            return quoted(name)
        case Wildcard():
            return "*"
        case Index(i):
            return str(i)
        case Slice(start, end, step):
            shown = [str(x) if x is not None else "" for x in (start, end)]
            return ":".join(shown) + (f":{step}" if step is not None else "")
        case Filter(condition):
            return "?" + write_condition(condition)


def write_condition(c, above: int = 0) -> str:
    """above: how tightly the place binds; 1 in an Or, 2 in an And, 3 in a Not."""
    match c:
        case Or(terms):
            text, own = " || ".join(write_condition(t, 1) for t in terms), 0
        case And(terms):
            text, own = " && ".join(write_condition(t, 2) for t in terms), 1
        case Not(term):
            text, own = "!" + write_condition(term, 3), 3
        case Compare(left, op, right):
            text, own = f"{operand(left)} {op} {operand(right)}", 2
        case Exists(query):
            text, own = write(query), 3
        case Holds(call):
            text, own = operand(call), 3
    tight = own < above or isinstance(c, (Or, And)) and own == above - 1 and above in (1, 2) and type(c) is (Or, And)[above - 1]
    return f"({text})" if tight or above == 3 and isinstance(c, Not) else text


def operand(x) -> str:
    match x:
        case Literal(value):
            return quoted(value) if isinstance(value, str) else scalar_text(value)
        case Query():
            return write(x)
        case Call(name, args):
            return f"{name}({', '.join(operand(a) if isinstance(a, (Literal, Query, Call)) else write_condition(a) for a in args)})"
