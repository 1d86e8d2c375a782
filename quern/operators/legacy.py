"""The older condition maps, desugared into nodes of the expression language."""

from __future__ import annotations

from quern.model import ValidationError

COMPARE = {"EQ": "=", "NE": "<>", "LT": "<", "LE": "<=", "GT": ">", "GE": ">="}
KEY_OPERATORS = {"EQ", "LE", "LT", "GE", "GT", "BEGINS_WITH", "BETWEEN"}


def node(name: str, operator: str, values: list):
    p, vs = ("path", (name,)), [("value", v) for v in values]
    need = {"BETWEEN": 2, "NULL": 0, "NOT_NULL": 0}.get(operator, 1)
    if operator != "IN" and len(vs) != need or operator == "IN" and not vs:
        raise ValidationError(f"{operator} has the wrong number of values")
    if operator in COMPARE:
        return ("cmp", COMPARE[operator], p, vs[0])
    made = {"BETWEEN": lambda: ("between", p, *vs), "IN": lambda: ("in", p, vs), "BEGINS_WITH": lambda: ("fn", "begins_with", [p, *vs]), "CONTAINS": lambda: ("fn", "contains", [p, *vs]), "NOT_CONTAINS": lambda: ("not", ("fn", "contains", [p, *vs])), "NULL": lambda: ("fn", "attribute_not_exists", [p]), "NOT_NULL": lambda: ("fn", "attribute_exists", [p])}
    if operator not in made:
        raise ValidationError(f"no operator {operator}")
    return made[operator]()


def conditions(filters: dict[str, tuple[str, list]], joined: str = "AND", keys: bool = False):
    """One node for a map of attribute to (operator, values), attributes in name order."""
    if keys and any(op not in KEY_OPERATORS for op, _ in filters.values()):
        raise ValidationError("the operator doesn't apply to keys")
    out = None
    for name in sorted(filters):
        n = node(name, *filters[name])
        out = n if out is None else (joined.lower(), out, n)
    return out


def expected(given: dict[str, dict], joined: str = "AND"):
    """Expected of a write: Exists, Value, or ComparisonOperator with values."""
    plain: dict[str, tuple[str, list]] = {}
    for name, e in given.items():
        if "ComparisonOperator" in e:
            plain[name] = (e["ComparisonOperator"], e.get("AttributeValueList", []))
        elif e.get("Exists", True):
            if "Value" not in e:
                raise ValidationError("Exists needs a value")
            plain[name] = ("EQ", [e["Value"]])
        else:
            plain[name] = ("NULL", [])
    return conditions(plain, joined)


def attribute_updates(given: dict[str, tuple[str, object]]) -> dict[str, list]:
    """PUT, ADD and DELETE become SET, ADD, DELETE, or REMOVE for a DELETE without a value."""
    out: dict[str, list] = {}
    for name in sorted(given):
        action, v = given[name]
        p = ("path", (name,))
        if action == "PUT":
            out.setdefault("SET", []).append((p, ("value", v)))
        elif action == "ADD":
            out.setdefault("ADD", []).append((p, ("value", v)))
        elif action == "DELETE":
            out.setdefault("REMOVE" if v is None else "DELETE", []).append((p, None if v is None else ("value", v)))
        else:
            raise ValidationError(f"no action {action}")
    return out
