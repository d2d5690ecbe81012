"""md5 fingerprints the deduplication and baseline steps key on.

Parts are joined without a separator and a missing part is ``"1"``: stored
baselines depend on exactly these texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import last_of_each

MISSING = "1"


def _pick(*candidates: Column) -> Column:
    return F.coalesce(*[c.cast("string") for c in candidates], F.lit(MISSING))


def _md5(*parts: Column) -> Column:
    return F.md5(F.concat(*parts))


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def kernel_fingerprint(payload: Column, is_kprobe: Column) -> Column:
    """Ten parts: who ran (process, parent), which function, which arguments."""
    args = payload["args"]

    def arg(i, *path):
        c = F.get(args, F.lit(i))
        for step in path:
            c = c[step]
        return c

    def probe(*candidates):
        return F.when(is_kprobe & args.isNotNull(), _pick(*candidates)).otherwise(MISSING)

    proc, parent = payload["process"], payload["parent"]
    return _md5(
        _pick(proc["pod"]["container"]["id"]), _pick(proc["binary"]), _pick(proc["arguments"]),
        _pick(parent["pod"]["container"]["id"]), _pick(parent["binary"]),
        _pick(parent["arguments"]),
        F.when(is_kprobe, _pick(payload["function_name"])).otherwise(MISSING),
        probe(arg(0, "file_arg", "path"), arg(0, "int_arg"), arg(0, "string_arg")),
        probe(arg(0, "file_arg", "permission"), arg(1, "int_arg"), arg(1, "string_arg")),
        probe(arg(1, "sock_arg", "state"), arg(1, "int_arg"), arg(1, "string_arg")),
    )


def kind_suffix(kind: Column) -> Column:
    return (
        F.when(kind == "process_exec", "exec")
        .when(kind == "process_exit", "exit")
        .when(kind == "process_kprobe", "kpro")
        .otherwise(MISSING)
    )


def alert_fingerprint(base: Column, k8s: Column, proc: Column) -> Column:
    args = base["arguments"]
    return _md5(
        _blank(base["alertName"]), _blank(k8s["containerID"]), _blank(k8s["podName"]),
        _pick(args["capability"], args["path"], args["exec"]),
        _blank(proc["processTree"]["cmdline"]), _pick(base["infectedPID"]),
    )


def trace_fingerprint(row: dict[str, Column]) -> Column:
    first = F.get(row["args"], F.lit(0))
    return _md5(
        _blank(row["cgroupId"]), _blank(row["containerId"]), _blank(row["eventName"]),
        _pick(first["name"], first["type"], first["value"]),
        _blank(row["mountNamespace"]), _blank(row["pidNamespace"]),
    )


# The fields of a rule-engine alert that make its fingerprint.
RULE_ALERT_FIELDS = [
    "container.id", "container.name", "proc.cmdline", "proc.pname",
    "evt.type", "user.uid", "evt.arg.flags", "proc.exepath",
]


def rule_alert_fingerprint(fields: Column) -> Column:
    return _md5(*[_pick(F.try_element_at(fields, F.lit(k))) for k in RULE_ALERT_FIELDS])


# Object fields that do not count when two objects are compared.
IGNORED_OBJECT_FIELDS = ["id", "created", "modified", "spec_version"]

# A field whose text is its print: a plain name, and plain text, a whole number or a boolean.
_NAME = "[A-Za-z0-9_-]+"
_VALUE = r'(?:"[ !#-\[\]-~]*+"|-?[1-9][0-9]{0,17}+|0|true|false)'
PLAIN_OBJECT = rf'\A\{{(?:"{_NAME}":{_VALUE}(?:,(?=")|(?=\}}\z)))*+\}}\z'
KEPT_FIELD = rf'"(?!(?:{"|".join(IGNORED_OBJECT_FIELDS)})"){_NAME}":{_VALUE}'
SAME_NAME_TWICE = rf'("{_NAME}":){_VALUE},\1'


def _plain_fields(json_text: Column) -> Column:
    """The sorted print of an object of plain fields without its ignored ones; null for any other.

    In such an object a name in quotes before a colon is nothing but a field's name, and sorted
    fields are sorted names: a quote sorts before all that a plain name can hold.
    """
    kept = F.array_join(F.array_sort(F.regexp_extract_all(json_text, F.lit(KEPT_FIELD), F.lit(0))), ",")
    return F.when(json_text.rlike(PLAIN_OBJECT) & F.contains(json_text, F.lit('"type":"')), kept)


def with_object_fingerprint(df: DataFrame, json_text: str, into: str, kind: str | None = None) -> DataFrame:
    """``df`` with a fingerprint of its object texts, and as ``kind`` their type.

    Equal for two texts that differ only in the ignored fields, in the order of keys at any depth,
    or in how numbers and spaces are written. Values of different type differ: ``1``, ``"1"`` and
    ``true`` are three values. Fields that are null do not count; of fields given twice the last does.

    Objects of plain fields alone are put in order as text. Others are parsed:
    a variant prints keys sorted, numbers one way and text in quotes. Nearly always the ignored
    fields can be cut out of that print, each where its name and value stand and nothing else does;
    objects with a null, a field given twice or the same name and value further inside are put
    together from their fields one by one, to the same text.
    """
    sorted_fields = df.withColumn("_s", _plain_fields(F.col(json_text)))
    sorted_fields = sorted_fields.withColumn("_s", F.when(~F.col("_s").rlike(SAME_NAME_TWICE), F.col("_s")))
    parsed = sorted_fields.withColumn("_v", F.when(F.col("_s").isNull(), F.try_parse_json(json_text)))
    names = [f"_f{i}" for i in range(len(IGNORED_OBJECT_FIELDS))]
    printed = parsed.withColumns({"_t": F.to_json("_v"), **{
        name: F.concat(F.lit(f'"{field}":'), F.to_json(F.try_variant_get("_v", f"$.{field}", "variant")))
        for name, field in zip(names, IGNORED_OBJECT_FIELDS, strict=True)}})
    text, plain = F.col("_t"), F.col("_t").startswith("{") & ~F.contains("_t", F.lit(":null"))
    for name in names:
        field = F.col(name)
        without = F.replace(F.replace(F.replace(text, F.concat(field, F.lit(","))), F.concat(F.lit(","), field)), field)
        text = F.when(field.isNull(), text).otherwise(without)
        once_there = F.length(F.replace("_t", field)) == F.length("_t") - F.length(field)
        plain = plain & (field.isNull() | once_there)
    whole = (F.when(F.col("_s").isNotNull(), F.concat(F.lit("{"), F.col("_s"), F.lit("}")))
             .when(F.coalesce(plain, F.lit(False)), text).otherwise(_from_fields(F.col(json_text))))
    after = F.substring_index("_s", '"type":"', -1)
    extra = {} if kind is None else {kind: F.when(
        F.col("_s").isNotNull(), F.substring_index(after, '"', 1)).otherwise(F.coalesce(
            F.try_variant_get("_v", "$.type", "string"), F.get_json_object(json_text, "$.type")))}
    return printed.withColumns({into: F.md5(whole), **extra}).drop("_s", "_v", "_t", *names)


def _from_fields(json_text: Column) -> Column:
    """The sorted print of an object without its ignored and null fields."""
    fields = F.map_entries(F.from_json(json_text, "map<string,variant>"))
    printed = F.transform(fields, lambda e: F.struct(
        e["key"].alias("key"), F.to_json(e["value"]).alias("value")))
    kept = F.filter(last_of_each(printed), lambda e: ~e["key"].isin(IGNORED_OBJECT_FIELDS)
                    & e["value"].isNotNull() & (e["value"] != "null"))

    def one(e):
        name = F.to_json(F.array(e["key"]))
        return F.concat(F.substr(name, F.lit(2), F.length(name) - 2), F.lit(":"), e["value"])

    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(kept), one), ","), F.lit("}"))
