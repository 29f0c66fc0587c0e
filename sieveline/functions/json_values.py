"""JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# What the JSON standard does not allow stays out.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
# How a JSON value begins. The parsers throw for what they refuse, which costs far more than this look at the first characters.
_BEGINS = r'\A[ \t\n\r]*+(?:[{\["]|-?[0-9]|true|false|null)'


def is_json(json) -> Column:
    """Whether a text begins with a JSON value of any kind; what follows that value is not looked at. An object may repeat a key. A
    null is no JSON."""
    text = _col(json)
    # this parser keeps the last value of a repeated key, the other refuses it; as the element of an array, scalars parse too
    element = F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)) > 0
    fields = F.from_json(F.when(text.rlike(r"\A\s*\{"), text), "map<string,string>", _STRICT).isNotNull()
    parses = F.try_parse_json(text).isNotNull() | fields | F.coalesce(element, F.lit(False))
    return F.when(text.rlike(_BEGINS), parses).otherwise(False)


def is_whole_json(json) -> Column:
    """Whether a text is one JSON value and nothing after it but white space; otherwise as ``is_json``."""
    text = F.when(is_json(json), _col(json))
    # the text as one of two values of an object: what follows its value breaks the object or adds to it. Names hold a hash of the
    # text, which the text cannot hold itself.
    name = F.sha2(text, 256)
    fields = F.from_json(F.concat(F.lit('{"'), name, F.lit('-a":'), text, F.lit(',"'), name, F.lit('-b":1}')), "map<string,string>", _STRICT)
    return F.coalesce((F.size(fields) == 2) & F.map_contains_key(fields, F.concat(name, F.lit("-b"))), F.lit(False))


def parsed(json, schema: str) -> Column:
    """A text as a variant, null if it is no JSON. Where an object repeats a key, the fields of ``schema`` are read, the last value of
    a key winning."""
    text = _col(json)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.to_json(F.from_json(F.when(is_json(text), text), schema, _STRICT))))


def extract_value(json, path: str) -> Column:
    """Text at a dotted path of object keys, null where it is missing. Containers come back as JSON text."""
    steps = "".join(f"['{part}']" for part in path.split("."))
    return F.get_json_object(_col(json), f"${steps}")


def parse_rows(json, schema: str) -> Column:
    """Typed parse; text that is not JSON gives null. Of a repeated key the last value counts."""
    return F.when(is_json(json), F.from_json(_col(json), schema))


def to_map(json) -> Column:
    """Top-level keys to their JSON text."""
    return F.from_json(_col(json), "map<string,string>")


def merge(main, update) -> Column:
    """Shallow merge of two JSON objects: the update wins for every key it has, also with null. A null argument gives
    the other one, and an update that is no object leaves the main value as it is."""
    def entries(c: Column) -> Column:
        return F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")

    a, b = _col(main), _col(update)
    left, right = entries(a), entries(b)
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    merged = F.to_json(F.map_concat(kept, right), {"ignoreNullFields": "false"})
    return F.when(a.isNull(), b).when(b.isNull() | right.isNull(), a).otherwise(merged)
