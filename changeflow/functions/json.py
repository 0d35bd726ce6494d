"""JSON access for transforms, on Spark's own JSON and VARIANT functions.

Each helper takes a JSON text column and a path of keys (strings) and positions (integers).
``register_json_functions`` offers them to SQL text under the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _path(steps: tuple[str | int, ...]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def _plain(steps: tuple[str | int, ...]) -> bool:
    """Whether a path expression can hold these keys; it has no escapes for ``'`` and ``?``."""
    return not any(isinstance(s, str) and (not s or set(s) & set("'?")) for s in steps)


def _walk(json: Column | str, steps: tuple[str | int, ...]) -> Column:
    """The value as VARIANT, whatever characters its keys have."""
    value = F.try_parse_json(json)
    for s in steps:
        if isinstance(s, int):
            value = F.get(value.try_cast("array<variant>"), F.lit(s))
        else:
            value = F.try_element_at(value.try_cast("map<string,variant>"), F.lit(s))
    return value


def json_get_str(json: Column | str, *steps: str | int) -> Column:
    return F.get_json_object(json, _path(steps)) if _plain(steps) else _walk(json, steps).try_cast("string")


def json_get_int(json: Column | str, *steps: str | int) -> Column:
    return json_get_str(json, *steps).try_cast("bigint")


def json_get_float(json: Column | str, *steps: str | int) -> Column:
    return json_get_str(json, *steps).try_cast("double")


def json_get_bool(json: Column | str, *steps: str | int) -> Column:
    return json_get_str(json, *steps).try_cast("boolean")


def json_get(json: Column | str, *steps: str | int) -> Column:
    """The value as VARIANT, to look further into."""
    return F.try_variant_get(F.try_parse_json(json), _path(steps), "variant") if _plain(steps) else _walk(json, steps)


def json_get_json(json: Column | str, *steps: str | int) -> Column:
    """The value as JSON text (strings keep their quotes)."""
    return F.to_json(json_get(json, *steps))


def json_object_keys(json: Column | str, *steps: str | int) -> Column:
    return F.json_object_keys(json_get_str(json, *steps) if steps else json)


def json_contains(json: Column | str, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def json_length(json: Column | str, *steps: str | int) -> Column:
    """Elements of an array or keys of an object; NULL for anything else."""
    value = json_get_str(json, *steps) if steps else json
    keys = F.json_object_keys(value)
    return F.coalesce(F.json_array_length(value), F.when(keys.isNotNull(), F.size(keys)))


# SQL forms with up to four steps; Spark inlines their bodies into the calling plan. A step of digits is a
# position in an array and a key of an object.
_KEYS = ("k", "k2", "k3", "k4")
_PARAMETERS = "j STRING, k STRING DEFAULT NULL, k2 STRING DEFAULT NULL, k3 STRING DEFAULT NULL, k4 STRING DEFAULT NULL"
_ALL = f"concat_ws('|', {', '.join(_KEYS)})"
# Keys that a path expression can hold: all but those with a quote, a question mark, or digits only.
_SIMPLE = f"""NOT rlike({_ALL}, "['?]|(^|[|])[0-9]*([|]|$)")"""
_PATH = "concat('$', " + ", ".join(f"""coalesce(concat("['", {k}, "']"), '')""" for k in _KEYS) + ")"


def _walked() -> str:
    value = "try_parse_json(j)"
    for k in _KEYS:
        value = f"if({k} IS NULL, {value}, json_step({value}, {k}))"
    return value


_TEXT = f"if({_SIMPLE}, get_json_object(j, {_PATH}), try_cast({_walked()} AS STRING))"
SQL_FUNCTIONS = {
    "json_step": (
        "v VARIANT, s STRING",
        "VARIANT",
        "coalesce(get(try_cast(v AS ARRAY<VARIANT>), try_cast(s AS INT)), "
        "try_element_at(try_cast(v AS MAP<STRING, VARIANT>), s))",
    ),
    "json_get": (_PARAMETERS, "VARIANT", _walked()),
    "json_get_json": (_PARAMETERS, "STRING", f"to_json({_walked()})"),
    "json_get_str": (_PARAMETERS, "STRING", _TEXT),
    "json_as_text": (_PARAMETERS, "STRING", _TEXT),
    "json_get_int": (_PARAMETERS, "BIGINT", f"try_cast({_TEXT} AS BIGINT)"),
    "json_get_float": (_PARAMETERS, "DOUBLE", f"try_cast({_TEXT} AS DOUBLE)"),
    "json_get_bool": (_PARAMETERS, "BOOLEAN", f"try_cast({_TEXT} AS BOOLEAN)"),
    "json_contains": ("j STRING, k STRING", "BOOLEAN", "coalesce(array_contains(json_object_keys(j), k), false)"),
    "json_length": (
        _PARAMETERS,
        "INT",
        "coalesce(json_array_length(json_get_json(j, k, k2, k3, k4)), "
        "size(json_object_keys(json_get_json(j, k, k2, k3, k4))))",
    ),
}


def register_json_functions(spark: SparkSession) -> None:
    """Create the SQL forms in this session, once. ``json_object_keys`` is Spark's own."""
    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        if not spark.catalog.functionExists(name):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
