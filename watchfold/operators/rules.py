"""Rules evaluated over normalised logs, all in one projection."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..session import cut_lineage
from ..sources.rules import Predicate, Rule
from . import observations
from .filters import all_of, any_of
from .observations import Observed
from .skew import wide_join

CHUNK = 100
META = set(r"\.^$*+?{}[]()|")

# How rule paths find their columns:
#   "flat"     extensions of every source are reachable (older object form)
#   "nested"   kernel rows keep theirs one level deeper, so only their
#              command line can be tested (newer object form)
#   "intended" what the rule authors meant: kernel arguments are reachable by
#              number and kind although the objects do not carry them there
LAYOUTS = ("flat", "nested", "intended")

# Object field -> normalised column, for fields every source prints.
TOP_LEVEL = {
    "id": "process_id", "pid": "pid", "command_line": "command_line", "cwd": "cwd",
    "created_time": "created_time", "type": "_type",
}
EXTENSION = {
    "flags": "flags", "image_id": "image_id", "container_id": "container_id", "pod_name": "pod",
    "namespace": "namespace", "function_name": "function_name", "parent_pid": "parent_pid",
    "parent_command_line": "parent_command_line", "parent_cwd": "parent_cwd",
    "grand_parent_pid": "grand_parent_pid", "kprobe0": "k0", "kprobe1": "k1", "kprobe2": "k2",
    "kprobe3": "k3", "kprobe4": "k4",
}
OBSERVED = {
    "first_observed": "time_text", "last_observed": "time_text", "created": "time_text",
    "extensions.alert_name": "alert_name", "extensions.rule_id": "rule_id",
    "extensions.correlation": "corr_id", "extensions.interpretation": "interpretation",
}
# Columns only some sources fill; elsewhere the path does not exist.
ONLY_IN = {
    "parent_cwd": ("kernel",), "grand_parent_pid": ("kernel",),
    "parent_pid": ("kernel", "alert", "rule_alert"),
    "parent_command_line": ("kernel", "alert", "rule_alert"),
    "kprobe0": ("kernel",), "kprobe1": ("kernel",), "kprobe2": ("kernel",),
    "kprobe3": ("kernel",), "kprobe4": ("kernel",),
}


class Path:
    """A resolved path: one value, or (for ``[*]``) any value of an array."""

    def __init__(self, column: Column | None, many: bool = False):
        self.column, self.many = column, many

    def test(self, predicate) -> Column:
        if self.column is None:
            return F.lit(False)
        if self.many:
            return F.coalesce(F.exists(self.column, predicate), F.lit(False))
        return F.coalesce(predicate(self.column), F.lit(False))


def _nth_of_kind(kind: Column, n: int) -> Column:
    return F.get(kind, F.lit(n))


def _kernel_argument(name: str) -> Path:
    """``int_arg_1`` is the second argument's integer; a name without a number
    means any argument; ``sock_arg.state`` steps into the argument."""
    m = re.fullmatch(r"(\w+?_arg)(?:_(\d+))?((?:\.\w+)*)", name)
    if not m:
        return Path(None)
    kind, number, steps = m.group(1), m.group(2), m.group(3).split(".")[1:]

    def step(c):
        for s in [kind, *steps]:
            c = c[s]
        return c

    args = F.col("args")
    if number is not None:
        return Path(step(F.get(args, F.lit(int(number)))))
    return Path(F.transform(args, step), many=True)


def resolve(path: str, layout: str = "flat") -> Path:
    """Column for an object path, or an empty path when no row can have it."""
    kind, _, rest = path.partition(":")
    if kind == "observed-data":
        name = OBSERVED.get(rest)
        return Path(F.col(name) if name else None)
    if kind != "process":
        return Path(None)
    if not rest.startswith("extensions."):
        if rest == "type":
            return Path(F.lit("process"))
        name = TOP_LEVEL.get(rest)
        return Path(F.col(name) if name else None)

    field = rest[len("extensions."):]
    if field.startswith("kprobe_arguments."):
        return _argument_path(field[len("kprobe_arguments."):], layout)
    m = re.fullmatch(r"kprobe(\d)\.(\w+_arg.*)", field)
    if m and layout == "intended":
        return _kernel_argument_at(int(m.group(1)), m.group(2))
    name = EXTENSION.get(field)
    if name is None:
        return Path(None)
    c = F.col(name)
    if field in ONLY_IN:
        c = F.when(F.col("source").isin(*ONLY_IN[field]), c)
    if layout == "nested":
        c = F.when(F.col("source") != "kernel", c)
    return Path(c)


def _kernel_argument_at(n: int, steps: str) -> Path:
    c = F.get(F.col("args"), F.lit(n))
    for s in steps.split("."):
        c = c[s]
    return Path(c)


def _argument_path(name: str, layout: str) -> Path:
    if layout != "intended":
        # Only syscall traces print this block, and their keys are flat.
        traced = F.try_element_at(F.col("trace_args"), F.lit(name))
        return Path(F.when(F.col("source") == "trace", traced))
    m = re.fullmatch(r"flags\[(\d+|\*)\]", name)
    if m:
        if m.group(1) == "*":
            return Path(F.col("alert_flags"), many=True)
        return Path(_nth_of_kind(F.col("alert_flags"), int(m.group(1))))
    if name.startswith("value"):
        keyed = F.map_filter("trace_args", lambda k, v: k.rlike(r"^\d+_value(_|$)"))
        return Path(F.map_values(keyed), many=True)
    return _kernel_argument(name)


def _typed(c: Column, kind: str) -> Column:
    """The path's value as the literal's type; no match when it does not cast."""
    if kind == "int":
        return c.cast("string").try_cast("bigint")
    if kind == "float":
        return c.cast("string").try_cast("double")
    if kind == "bool":
        return c.cast("string").try_cast("boolean")
    if kind == "timestamp":
        return F.try_to_timestamp(c.cast("string"))
    if kind in ("hex", "binary"):  # compared byte by byte
        return c.cast("string").cast("binary")
    return c.cast("string")


def _literal(value, kind: str) -> Column:
    if kind == "int":
        return F.lit(int(value)).cast("bigint")
    if kind == "float":
        return F.lit(float(value))
    if kind == "bool":
        return F.lit(bool(value))
    if kind == "timestamp":
        return F.to_timestamp(F.lit(value))
    if kind == "hex":
        return F.unhex(F.lit(value))
    if kind == "binary":
        return F.unbase64(F.lit(value))
    return F.lit(value)


COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b, "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b,
}


def predicate_column(p: Predicate, layout: str = "flat") -> Column:
    """One comparison. A path that is not there never matches, negated or not."""
    target = resolve(p.path, layout)

    def flip(c):
        return ~c if p.negated else c

    if p.op == "EXISTS":
        if target.column is None:
            return F.lit(p.negated)
        c = target.column
        here = (F.size(c) > 0) if target.many else c.isNotNull()
        return flip(F.coalesce(here, F.lit(False)))
    if p.op in COMPARE:
        want = _literal(p.value, p.type)
        return target.test(lambda c: flip(COMPARE[p.op](_typed(c, p.type), want)))
    if p.op == "IN":
        wants = [_literal(v, p.type) for v in p.value]
        return target.test(lambda c: flip(_typed(c, p.type).isin(*wants)))
    if p.op == "LIKE":
        return target.test(lambda c: flip(c.cast("string").like(p.value)))
    if p.op == "MATCHES":
        return target.test(lambda c: flip(regex_search(c.cast("string"), p.value)))
    if p.op == "ISSUBSET":
        return target.test(lambda c: flip(net.is_subset(c.cast("string"), p.value)))
    if p.op == "ISSUPERSET":
        return target.test(lambda c: flip(net.is_superset(c.cast("string"), p.value)))
    raise ValueError(f"unknown operator {p.op}")


def regex_search(c: Column, pattern: str) -> Column:
    """Regex search; a pattern without regex signs is a byte-level ``contains``,
    which skips decoding the text for every rule."""
    if not META.intersection(pattern):
        return c.contains(pattern)
    return c.rlike(pattern)


def rule_column(rule: Rule, layout: str = "flat", observation: int = 0) -> Column:
    """AND inside a group, OR between groups."""
    groups = rule.groups(observation)
    return any_of([all_of([predicate_column(p, layout) for p in g]) for g in groups])


SEPARATOR = "\x1f"


def matched_text(rules: list[Rule], layout: str = "flat") -> Column:
    """Keys of all rules a row satisfies, in catalogue order, as one text.

    ``concat_ws`` skips nulls and is generated code; an array filter here would
    be interpreted, and every predicate below it with it. Long catalogues are
    built in chunks so a generated method stays small.
    """
    parts = [
        F.concat_ws(SEPARATOR, *[
            F.when(rule_column(r, layout), F.lit(r.key)) for r in rules[i:i + CHUNK]
        ]) for i in range(0, len(rules), CHUNK)
    ]
    return F.concat_ws(SEPARATOR, *[F.nullif(p, F.lit("")) for p in parts])


def matched_keys(rules: list[Rule], layout: str = "flat") -> Column:
    """Array of the keys of all rules a row satisfies; no join, no shuffle."""
    text = matched_text(rules, layout)
    return F.when(text != "", F.split(text, SEPARATOR)).otherwise(
        F.array().cast("array<string>"))


def match_rules(logs: DataFrame, rules: list[Rule], layout: str = "flat") -> DataFrame:
    """Rows that satisfy at least one rule, with the array ``matches``. Rules over
    several logs are for ``match_sequences``."""
    several = [r.key for r in rules if not r.one_log]
    if several:
        raise ValueError(f"rules over several logs: {several}")
    hit = logs.withColumn("_matched", matched_text(rules, layout)).where("_matched != ''")
    return hit.withColumn("matches", F.split("_matched", SEPARATOR)).drop("_matched")


def rule_lookup(rules: list[Rule], attribute: str) -> Column:
    """Constant map key -> attribute, folded into the plan."""
    return F.create_map(*[
        x for r in rules for x in (F.lit(r.key), F.lit(getattr(r, attribute)))
    ])


def match_rows(logs: DataFrame, rules: list[Rule], layout: str = "flat") -> DataFrame:
    """One row per (log, rule) match with rule and indicator ids."""
    text = F.nullif(matched_text(rules, layout), F.lit(""))
    hit = logs.select("*", F.explode(F.split(text, SEPARATOR)).alias("key"))
    return hit.withColumns({
        "matched_rule_id": F.element_at(rule_lookup(rules, "rule_id"), F.col("key")),
        "indicator_id": F.element_at(rule_lookup(rules, "indicator_id"), F.col("key")),
    })


def rule_tree(rule: Rule) -> Observed:
    """The tree of the rule's observations: its own, or all combined in one bracket."""
    if rule.tree:
        return observations.from_text(rule.tree)
    leaves = tuple(Observed(n) for n in rule.observations)
    if len(leaves) == 1:
        return replace(leaves[0], repeats=rule.repeats, within=rule.within)
    return Observed(combine=rule.combine, of=leaves, repeats=rule.repeats, within=rule.within)


def rule_hits(logs: DataFrame, rules: list[Rule], key: list[str], ns: str = "event_ts_ns",
              layout: str = "flat") -> DataFrame:
    """(rule, observation, *key, ns, n): times at which the rules' observations are made, all
    found in one pass over the logs."""
    names = {f"{i}.{n}": (r.key, n) for i, r in enumerate(rules) for n in r.observations}
    conditions = {f"{i}.{n}": rule_column(r, layout, n) for i, r in enumerate(rules) for n in r.observations}
    seen = observations.hits(logs, conditions, key, ns)
    known = logs.sparkSession.createDataFrame([(k, *v) for k, v in names.items()], "seen string, rule string, observation int")
    return seen.join(F.broadcast(known), "seen").select("rule", "observation", *key, "ns", "n")


def match_sequences(logs: DataFrame, rules: list[Rule], key: list[str], ns: str = "event_ts_ns",
                    layout: str = "flat", bucket_seconds: float = observations.BUCKET_SECONDS) -> DataFrame:
    """Rules over several logs of one ``key``: rows (rule, *key, ns, first_ns), one for each time
    at which a rule is satisfied, with the start of the shortest match that ends there.

    One pass over the logs for all rules; see ``operators.observations`` for what the
    combinations and qualifiers mean.
    """
    seen = cut_lineage(rule_hits(logs, rules, key, ns, layout))
    found = observations.matches(seen, {r.key: rule_tree(r) for r in rules}, key, bucket_seconds)
    return found.select("rule", *key, F.col("last").alias(ns), F.col("first").alias("first_ns"))


def gate_by_function(logs: DataFrame, predicates: DataFrame, function: str = "function_name",
                     ) -> DataFrame:
    """For rule tables too long for one projection: rules as rows.

    ``predicates(key, function_name, token, regex)``: ``token`` is a word (letters
    and digits) that every match of ``regex`` holds. A log meets the rules of its
    function that have one of its words, an equi-join on (function, word), and the
    regex is tested on those pairs only.
    """
    rules = predicates.select("key", F.col("function_name").alias(function),
                              F.col("token").alias("_word"), "regex")
    words = F.array_distinct(F.split("command_line", "[^A-Za-z0-9]+"))
    probes = logs.withColumn("_word", F.explode(words))
    return wide_join(probes, rules, [function, "_word"], "inner").where(
        F.rlike(F.col("command_line"), F.col("regex"))).drop("_word", "regex")


def gate_counts(logs: DataFrame, predicates: DataFrame, function: str = "function_name") -> DataFrame:
    """Logs per rule of ``gate_by_function``; rules without one are left out.

    Equal logs (function and command line) are one text with a count, and rules that differ in
    their key alone are one test, so many copies of either meet once and not all with all.
    """
    text, rule = [function, "command_line"], ["function_name", "token", "regex"]
    texts = logs.groupBy(*text).agg(F.count(F.lit(1)).alias("_n"))
    kinds = predicates.select(*rule).distinct().withColumn("key", F.struct(*rule))
    hits = gate_by_function(texts, kinds, function).groupBy("key").agg(F.sum("_n").alias("n"))
    return wide_join(predicates.select("key", *rule), hits.select("key.*", "n"), rule, "inner").groupBy("key").agg(
        F.sum("n").alias("n"))


def match_counts(matched: DataFrame) -> DataFrame:
    """Matches per rule; partial sums before the shuffle."""
    return (matched.select(F.explode("matches").alias("key"))
            .groupBy("key").agg(F.count(F.lit(1)).alias("n")))


def resolve_indicators(matches: DataFrame, edges: DataFrame, attacks: DataFrame) -> DataFrame:
    """indicator -> relationship -> attack pattern: two equi-joins.

    ``edges`` and ``attacks`` have a few rows for each rule and are broadcast. Spark knows no size
    of a table that was made from rows, and would else send every match to the driver instead.
    """
    named = F.broadcast(edges.select("key", F.col("source_ref").alias("indicator_id"), "target_ref"))
    hop = matches.join(named, ["key", "indicator_id"], "inner")
    return hop.join(F.broadcast(attacks.withColumnRenamed("attack_id", "target_ref")),
                    ["key", "target_ref"], "inner")
