"""The truth table in plain Python, item by item: what the compiled Columns are tested against."""

from __future__ import annotations

from quern.functions.parse import kind_of


def resolve(item: dict, path: tuple):
    v = item
    for step in path:
        if isinstance(step, int):
            if not isinstance(v, (list, tuple)) or step >= len(v):
                return None
            v = v[step]
        else:
            if not isinstance(v, dict) or step not in v:
                return None
            v = v[step]
        if v is None:
            return None
    return v


def operand(item: dict, node):
    if node[0] == "value":
        return node[1]
    if node[0] == "size":
        v = resolve(item, node[1][1])
        if isinstance(v, str):
            return len(v.encode("utf-16-be", "surrogatepass")) // 2
        return len(v) if isinstance(v, (bytes, list, tuple, dict, set, frozenset)) else None
    return resolve(item, node[1])


def compare(op: str, a, b) -> bool:
    if a is None or b is None or kind_of(a) != kind_of(b):
        return op == "<>"
    if op in ("=", "<>"):
        return (a == b) is (op == "=")
    if kind_of(a) not in ("S", "N", "B", "T"):
        return op in ("<=", ">=") and a == b
    if isinstance(a, str):
        a, b = a.encode(), b.encode()
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def evaluate(item: dict, node) -> bool:
    kind = node[0]
    if kind == "not":
        return not evaluate(item, node[1])
    if kind == "and":
        return evaluate(item, node[1]) and evaluate(item, node[2])
    if kind == "or":
        return evaluate(item, node[1]) or evaluate(item, node[2])
    if kind == "cmp":
        return compare(node[1], operand(item, node[2]), operand(item, node[3]))
    if kind == "between":
        x = operand(item, node[1])
        return compare(">=", x, operand(item, node[2])) and compare("<=", x, operand(item, node[3]))
    if kind == "in":
        x = operand(item, node[1])
        return any(compare("=", x, operand(item, i)) for i in node[2])
    _, name, args = node
    a = operand(item, args[0])
    if name == "attribute_exists":
        return a is not None
    if name == "attribute_not_exists":
        return a is None
    b = operand(item, args[1])
    if a is None or b is None:
        return False
    if name == "attribute_type":
        return kind_of(a) == b
    if name == "begins_with":
        return kind_of(a) == kind_of(b) and isinstance(a, (str, bytes)) and a.startswith(b)
    if isinstance(a, (str, bytes)):
        return kind_of(a) == kind_of(b) and b in a
    return isinstance(a, (list, tuple, set, frozenset)) and any(kind_of(x) == kind_of(b) and x == b for x in a if x is not None)
