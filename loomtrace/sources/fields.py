"""Whether a parsed value has the fields that its format gives types to: nested rules, checked without leaving the JVM.

A rule is `text`, `count` (a whole number from 0) or `any`, a dict of rules for an object, or a list of
one rule for a list. A field may be missing, but not with `!` behind its name; it may be null with `?`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = str | dict | list

#: The fields with types of messages and spans; other fields may hold anything.
RULES: dict[str, Rule] = {
    "generic": {
        "role": "text", "tool_call_id?": "text", "model?": "text",
        "tool_calls": [{"id": "text", "function": {"name": "text", "arguments": "text"}}],
        "usage?": {"prompt_tokens?": "count", "completion_tokens?": "count", "cached_tokens?": "count"},
    },
    "gemini": {
        "type!": "text", "timestamp?": "text", "model?": "text",
        "toolCalls": [{"id": "text", "name": "text", "timestamp?": "text", "args": "any", "result": "any"}],
        "usageMetadata?": {"promptTokenCount?": "count", "candidatesTokenCount?": "count", "cachedContentTokenCount?": "count"},
    },
    "otel_json": {"scopeSpans": [{"spans": [{"name": "text", "startTimeUnixNano?": "text", "attributes": [{"key!": "text", "value!": "any"}]}]}]},
}


def kind_of(value: Column) -> Column:
    """The kind of a variant: STRING, BIGINT, VOID (null), OBJECT<...>, ARRAY<...>; null where there is none."""
    return F.schema_of_variant(value)


def text_at(value: Column, path: str) -> Column:
    """The string at a path; null where there is none or it is no string."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(kind_of(found) == "STRING", F.try_variant_get(found, "$", "string"))


def _field(name: str, own: Rule) -> Callable[[Column], Column]:
    """Whether a field, null if missing, fits the rule of that name."""

    def here(field: Column) -> Column:
        found = F.when(field.isNull(), not name.endswith("!"))
        if own != "any":
            found = found.when(F.is_variant_null(field), name.endswith("?"))
        return found.otherwise(fits(field, own))

    return here


def fits(value: Column, rule: Rule) -> Column:
    """Whether a variant that is there and not null fits a rule."""
    if isinstance(rule, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        # a list of anything is an array; of objects, each must fit
        return F.coalesce(items.isNotNull() & F.forall(items, lambda x: ~F.is_variant_null(x) & fits(x, rule[0])), F.lit(False))
    if isinstance(rule, dict):
        # fields that may hold anything and be missing need no look
        asked = {name: own for name, own in rule.items() if own != "any" or name.endswith("!")}
        kind = ", ".join(f"{name.rstrip('!?')}: variant" for name in asked)

        def here(fields: Column) -> Column:
            ok = fields.isNotNull()
            for name, own in asked.items():
                # a list of one gives the field a name: written out, it would be looked up again for each mention below it
                ok = ok & F.forall(F.array(fields[name.rstrip("!?")]), _field(name, own))
            return ok

        # all fields are taken from the object at once; null if it is none
        return F.coalesce(F.forall(F.array(F.try_variant_get(value, "$", f"struct<{kind}>")), here), F.lit(False))
    if rule == "text":
        return kind_of(value) == "STRING"
    if rule == "count":
        kind = kind_of(value)
        n = F.try_variant_get(value, "$", "decimal(38,0)")
        large = kind.rlike(r"^DECIMAL\(\d+,\s*0\)$") & F.coalesce(n.between(F.lit(0).cast("decimal(38,0)"), F.lit(str(2**64 - 1)).cast("decimal(38,0)")), F.lit(False))
        return F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint") >= 0).otherwise(large)
    return F.lit(True)


def fits_all(items: Column, rule: Rule) -> Column:
    """Whether all of an array of variants fit; false for a null array."""
    return F.coalesce(items.isNotNull() & F.forall(items, lambda x: ~F.is_variant_null(x) & fits(x, rule)), F.lit(False))
