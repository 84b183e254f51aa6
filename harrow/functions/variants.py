"""JSON of unknown shape as VARIANT columns: optional chaining and maps by name.

``a?.b?.[0]?.c`` reads a path that may be missing at any step, or lead through a
value of another type; the result is null then, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from harrow.functions.text import col_, let

#: Whether a repeated key of a JSON object keeps its last value, as in JavaScript, or makes the text invalid.
LAST_KEY = "spark.sql.variant.allowDuplicateKeys"


def javascript_json(spark: SparkSession) -> None:
    """Let this session's :func:`payload` keep the last of repeated keys, as ``JSON.parse`` does."""
    spark.conf.set(LAST_KEY, "true")


def payload(text) -> Column:
    """A JSON text as a variant; null if it is null, empty or not JSON."""
    return F.try_parse_json(col_(text))


def path_of(*steps: str | int) -> str:
    """Path of object keys and array places from the root."""
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def chain(value, *steps: str | int) -> Column:
    """``value?.step?.step``: the variant there, null when any step is missing or leads through another type."""
    return F.try_variant_get(col_(value), path_of(*steps), "variant") if steps else col_(value)


def kind(value) -> Column:
    """Type of a variant: STRING, BIGINT, OBJECT<...>, ARRAY<...>, VOID ...; null for none."""
    return F.schema_of_variant(col_(value))


def string_at(value, *steps: str | int) -> Column:
    """The string there; null for a missing path and for values of any other type."""
    at = chain(value, *steps)
    return F.when(kind(at) == "STRING", F.try_variant_get(at, "$", "string"))


def number_at(value, *steps: str | int) -> Column:
    """The number there as a double; null for a missing path and for values of any other type."""
    at = chain(value, *steps)
    return F.when(kind(at).rlike(r"^(?:BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"), F.try_variant_get(at, "$", "double"))


def items_at(value, *steps: str | int) -> Column:
    """The elements of the array there; null for a missing path and for anything but an array."""
    return F.try_variant_get(col_(value), path_of(*steps), "array<variant>")


def map_by_name(items, name=lambda item: item["name"]) -> Column:
    """``new Map(items.map(item => [item.name, item]))``: of a repeated name the last item counts.

    Items without a name are left out, for a map has no null key; a null array
    gives null.  Items and names are computed once: they are sorted by (name,
    place), the last place of each name stays, in the order of the places.
    """
    def last(named: Column) -> Column:
        order = F.array_sort(F.transform(named, lambda e, at: F.struct(e["name"].alias("name"), at.alias("at"))))
        places = let(order, lambda o: F.array_sort(F.transform(F.filter(
            o, lambda e, at: ~F.coalesce(F.get(o, at + 1)["name"] == e["name"], F.lit(False))), lambda e: e["at"])))
        return let(places, lambda p: F.map_from_arrays(F.transform(p, lambda at: F.get(named, at)["name"]),
                                                       F.transform(p, lambda at: F.get(named, at)["item"])))

    pairs = F.transform(col_(items), lambda item: F.struct(name(item).alias("name"), item.alias("item")))
    return let(F.filter(pairs, lambda e: e["name"].isNotNull()), last)


def variants_by_name(value, *steps: str | int, key: str = "name") -> Column:
    """:func:`map_by_name` of the variant array there, by the string under ``key`` of each element."""
    return map_by_name(items_at(value, *steps), lambda item: string_at(item, key))
