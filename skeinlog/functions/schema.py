"""Declared shapes of variants, as column expressions that name every error by its path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


@dataclass(frozen=True)
class Shape:
    """kind: one of KINDS. required: neither absent nor null. filled: a string isn't empty. one_of: an enumeration. least, most: bounds of
    a number, or of an array's size. fields: of an object, other fields are allowed. each: of an array."""

    kind: str
    required: bool = False
    filled: bool = False
    one_of: Sequence[str] = ()
    least: float | None = None
    most: float | None = None
    fields: Mapping[str, Shape] = field(default_factory=dict)
    each: Shape | None = None


def errors(v: Column, shape: Shape, path: Column | str = "$") -> Column:
    """`path: reason` of everything in the variant v that isn't as declared, in the order of the declaration; an empty array for none.
    Reasons: missing, not a <kind>, empty, not one of, too small, too large. What is below a value of a wrong kind isn't looked at."""
    path = F.lit(path) if isinstance(path, str) else path
    none = F.array().cast("array<string>")
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    is_kind = F.lit(False)
    for name in KINDS[shape.kind]:
        is_kind = is_kind | kind.startswith(name)
    say = lambda why: F.array(F.concat(path, F.lit(f": {why}")))
    found = none
    if shape.kind == "string" and (shape.filled or shape.one_of):
        text = F.variant_get(v, "$", "string")
        rules = F.when((text == "") if shape.filled else F.lit(False), say("empty"))
        found = (rules.when(~text.isin(*shape.one_of), say("not one of " + ", ".join(shape.one_of))) if shape.one_of else rules).otherwise(none)
    if shape.kind in ("integer", "number", "array") and (shape.least, shape.most) != (None, None):
        size = F.size(F.try_variant_get(v, "$", "array<variant>")) if shape.kind == "array" else F.try_variant_get(v, "$", "double")
        low = size < shape.least if shape.least is not None else F.lit(False)
        high = size > shape.most if shape.most is not None else F.lit(False)
        found = F.when(low, say("too small")).when(high, say("too large")).otherwise(none)
    for name, inner in shape.fields.items():
        found = F.concat(found, errors(F.try_variant_get(v, f"$['{name}']", "variant"), inner, F.concat(path, F.lit(f".{name}"))))
    if shape.each is not None:
        items = F.try_variant_get(v, "$", "array<variant>")
        below = F.flatten(F.transform(items, lambda x, i: errors(x, shape.each, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        found = F.concat(found, F.coalesce(below, none))
    lacks = say("missing") if shape.required else none
    return F.when(kind == "VOID", lacks).when(is_kind, found).otherwise(say(f"not a {shape.kind}"))


# What a judge may answer.
OUTCOMES = ("fully_achieved", "mostly_achieved", "partially_achieved", "not_achieved", "unclear")
SESSION_TYPES = ("single_task", "multi_task", "iterative_refinement", "exploration", "quick_question")
FRICTION_TYPES = ("wrong_approach", "buggy_code", "misunderstood_request", "excessive_changes", "user_rejected_action", "incomplete")
_text = Shape("string", required=True, filled=True)
#: The fields of a judgement.
JUDGED = Shape("object", required=True, fields={
    "outcome": Shape("string", required=True, one_of=OUTCOMES), "session_type": Shape("string", required=True, one_of=SESSION_TYPES),
    "underlying_goal": _text, "brief_summary": _text,
    "friction_incidents": Shape("array", each=Shape("object", required=True, fields={"type": Shape("string", required=True, one_of=FRICTION_TYPES)})),
    "standing_preferences": Shape("array", each=Shape("object", required=True, fields={"rule": _text, "evidence_quote": _text})),
})
