"""Text, JSON and argument helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARG_SLOTS = 5


def arg_text(arg: Column) -> Column:
    """First truthy of string, int, socket, file argument, as text.

    Empty strings and zero count as absent, and an absent argument is ``""``.
    """
    return F.coalesce(
        F.nullif(arg["string_arg"], F.lit("")),
        F.nullif(arg["int_arg"], F.lit(0).cast("bigint")).cast("string"),
        F.to_json(arg["sock_arg"]),
        F.to_json(arg["file_arg"]),
        F.lit(""),
    )


def promoted_arg(args: Column, i: int) -> Column:
    """Argument ``i`` as JSON text, or the word ``null`` when there is none."""
    return F.coalesce(F.to_json(F.get(args, F.lit(i))), F.lit("null"))


def command_line(binary: Column, arguments: Column) -> Column:
    """``binary arguments``; a missing part prints as the word ``None``."""
    return F.concat(
        F.coalesce(binary, F.lit("None")), F.lit(" "), F.coalesce(arguments, F.lit("None"))
    )


def json_or_self(c: Column) -> Column:
    """Parse if it is JSON, keep the text if not, null for the word ``null``."""
    plain = F.nullif(c, F.lit("null"))
    return F.when(
        plain.isNotNull(), F.coalesce(F.try_parse_json(plain), plain.cast("variant"))
    )


def json_or_text(c: Column) -> Column:
    """``json_or_self`` as canonical text: JSON documents are re-printed."""
    plain = F.nullif(c, F.lit("null"))
    return F.coalesce(F.try_parse_json(plain).cast("string"), plain)


def strip_bytes_wrapper(c: Column) -> Column:
    """``b'text'`` -> ``text``; anything else is unchanged."""
    wrapped = c.rlike("(?s)^b'.*'$") & (F.length(c) >= 3)
    return F.when(wrapped, F.substring(c, F.lit(3), F.length(c) - 3)).otherwise(c)


def bytes_to_text(c: Column) -> Column:
    """UTF-8 decode; malformed input prints its bytes as hex text."""
    return F.coalesce(F.try_validate_utf8(c.cast("string")), F.hex(c))


def second_part(c: Column, sep: str = "/") -> Column:
    return F.get(F.split(c, sep), F.lit(1))


def interpretation(category: Column, technique: Column, external_id: Column) -> Column:
    return F.concat(
        F.coalesce(category, F.lit("")), F.lit(" "),
        F.coalesce(technique, F.lit("")), F.lit(" "),
        F.coalesce(external_id, F.lit("")),
    )


def url(addr: Column, port: Column, path: Column) -> Column:
    """``http://addr:port path``; null when a part is missing or empty."""
    whole = F.concat(F.lit("http://"), addr, F.lit(":"), port.cast("string"), path)
    return F.when((addr != "") & (port != 0) & (path != ""), whole)


def swap_port(p: Column) -> Column:
    return F.shiftright(p, 8).bitwiseOR(F.shiftleft(p, 8).bitwiseAND(F.lit(0xFF00)))


def last_of_each(entries: Column) -> Column:
    """Entries (key, value) without those whose key comes again later."""
    keys = F.transform(entries, lambda e: e["key"])
    later = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.when(F.size(F.array_distinct(keys)) < F.size(entries), later).otherwise(entries)


def json_depth(c: Column) -> Column:
    """How deep objects and lists of a JSON text are nested."""
    signs = F.regexp_replace(F.regexp_replace(c, r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state, sign):
        now = state["now"] + F.when(sign.isin("{", "["), 1).when(sign.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(F.split(signs, ""), start, step)["most"]


def flatten_trace_args(args: Column) -> Column:
    """``[{name,type,value}, ...]`` -> flat map with keys ``0_name``, ``0_type`` ...

    A value that is an object or list is flattened to its leaves, however deep:
    ``0_value_key`` for an object's fields, ``0_value[i]`` for the items of its
    list, ``0_value[i]_j`` for those of a list in a list. Empty objects and lists
    leave nothing; of equal keys the last stays. One level is unfolded per round,
    as many rounds as the deepest value has levels.
    """
    def entry(key, value, json, in_list):
        return F.struct(key.alias("key"), value.alias("value"), json.alias("json"), in_list.alias("in_list"))

    yes, no = F.lit(True), F.lit(False)

    def unfold(e):
        obj = F.map_entries(F.from_json(e["value"], "map<string,variant>"))
        items = F.from_json(e["value"], "array<variant>")
        fields = F.transform(obj, lambda x: entry(
            F.concat(e["key"], F.lit("_"), x["key"]), F.to_json(x["value"]), yes, no))
        values = F.transform(items, lambda v, j: entry(
            F.when(e["in_list"], F.concat(e["key"], F.lit("_"), j.cast("string"))).otherwise(
                F.concat(e["key"], F.lit("["), j.cast("string"), F.lit("]"))), F.to_json(v), yes, yes))
        whole = F.array(e)
        return (F.when(e["value"].startswith("{"), F.coalesce(fields, whole))
                .when(e["value"].startswith("["), F.coalesce(values, whole)).otherwise(whole))

    def leaf(e):
        text_ = F.when(e["value"].startswith('"'), F.try_parse_json(e["value"]).cast("string")).otherwise(
            F.nullif(e["value"], F.lit("null")))
        return F.struct(e["key"].alias("key"), F.when(e["json"], text_).otherwise(e["value"]).alias("value"))

    first = F.flatten(F.transform(args, lambda arg, i: F.array(
        entry(F.concat(i.cast("string"), F.lit("_name")), arg["name"], no, no),
        entry(F.concat(i.cast("string"), F.lit("_type")), arg["type"], no, no),
        entry(F.concat(i.cast("string"), F.lit("_value")), arg["value"], no, no))))
    depths = F.transform(args, lambda arg: F.coalesce(json_depth(arg["value"]), F.lit(0)))
    depth = F.coalesce(F.array_max(depths), F.lit(0))
    rounds = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    leaves = F.aggregate(rounds, first, lambda now, _: F.flatten(F.transform(now, unfold)))
    return F.map_from_entries(last_of_each(F.transform(leaves, leaf)))


def first_of_type(objects: Column, kind: str) -> Column:
    """Id of the first object of a type in an array of object JSON texts."""
    hit = F.filter(objects, lambda o: F.get_json_object(o, "$.type") == kind)
    return F.get_json_object(F.get(hit, F.lit(0)), "$.id")
