"""Rules over several logs of one key: trees of observations, for any number of rules in one pass.

A node stands for its matches, each a stretch of time from the first log it takes to the last. Of
all that end at one log only the shortest matters: whatever holds for a longer one (a span, an
order, a period) holds for it too. So a node is a table (node, key, last, first) with at most one
row for each log, and the rows of a parent follow from those of its children:

* ``A FOLLOWEDBY B``: for each B the latest start of an A that ended before B began;
* ``A AND B AND ...``: for each end of one the latest starts of the others up to then;
* ``A OR B OR ...``: the ends of all;
* ``A REPEATS n``: from the n-th last match on, of matches that have no other inside. Logs of one
  time count each for an observation, stretches that are alike once for a bracket;
* ``WITHIN``, ``START ... STOP``: the rows whose stretch is short enough or lies in the period.

Logs are read once: one projection tests all observations of all rules, and only hits go on, one
row for each (observation, key, time). Nodes of one height are then worked out together, whatever
their rules. "The latest start up to then" is a running maximum inside (key, time bucket) and one
carried over from the buckets before, for which each bucket gives a single row; so a busy key is
split by time, spans may be as long as they like or be missing, and no two logs are paired.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exact import floor_div
from ..session import cut_lineage

NS = 1_000_000_000
BUCKET_SECONDS = 3600
COMBINE = ("FOLLOWEDBY", "AND", "OR")


@dataclass(frozen=True)
class Observed:
    """One observation of a rule (``of`` empty), or a bracket around several.

    Qualifiers apply in the order repeats, within (seconds), start and stop (nanoseconds, stop
    not included). A bracket of one with qualifiers of its own gives any other order.
    """

    observation: int = 0
    combine: str = ""
    of: tuple[Observed, ...] = ()
    repeats: int = 1
    within: float | None = None
    start: int | None = None
    stop: int | None = None

    def __post_init__(self):
        if (self.start is None) != (self.stop is None):
            raise ValueError("START and STOP go together")

    def span(self) -> float | None:
        """Seconds that a match can last at most; None without a bound."""
        if self.within is not None:
            return self.within
        if not self.of and self.repeats == 1:
            return 0.0
        inner = [o.span() for o in self.of]
        if None in inner or self.repeats > 1:
            return None
        return max(inner) if self.combine == "OR" or len(inner) == 1 else None

    def text(self) -> str:
        return json.dumps(_as_dict(self))


def _as_dict(node: Observed) -> dict:
    given = {k: v for k, v in vars(node).items() if k != "of" and v != Observed.__dataclass_fields__[k].default}
    return {**given, "of": [_as_dict(o) for o in node.of]} if node.of else {"observation": node.observation, **given}


def from_text(text: str) -> Observed:
    """A tree from its JSON, as rule rows carry it."""
    def build(d: dict) -> Observed:
        return Observed(**{**d, "of": tuple(build(o) for o in d.get("of", ()))})

    return build(json.loads(text))


@dataclass
class _Node:
    id: int
    rule: str
    height: int
    op: str
    sides: int
    within: int | None
    start: int | None
    stop: int | None
    repeats: int = 1
    parent: int | None = None
    side: int = 0
    parent_height: int = 0


def compiled(trees: dict[str, Observed]) -> tuple[list[_Node], dict[tuple[str, int], list[int]]]:
    """Numbered nodes of all trees, and the leaves of each (rule, observation). A ``REPEATS`` becomes
    a node above what it repeats; ``A FOLLOWEDBY B FOLLOWEDBY C`` is taken from the left."""
    nodes: list[_Node] = []
    leaves: dict[tuple[str, int], list[int]] = {}

    def add(rule: str, op: str, children: list[_Node], tree: Observed | None, repeats: int = 1) -> _Node:
        width = None if tree is None or tree.within is None else round(tree.within * NS)
        node = _Node(len(nodes), rule, 1 + max((c.height for c in children), default=-1), op, len(children), width,
                     tree and tree.start, tree and tree.stop, repeats)
        nodes.append(node)
        for side, child in enumerate(children):
            child.parent, child.side = node.id, side
        return node

    def build(rule: str, tree: Observed) -> _Node:
        outer = tree if tree.repeats == 1 else None  # the node that carries the filters
        if not tree.of:
            node = add(rule, "LEAF", [], outer)
            leaves.setdefault((rule, tree.observation), []).append(node.id)
        elif len(tree.of) == 1:
            node = add(rule, "OR", [build(rule, tree.of[0])], outer)
        elif tree.combine not in COMBINE:
            raise ValueError(f"{rule}: several observations need one of {COMBINE}")
        elif tree.combine == "FOLLOWEDBY":
            node = build(rule, tree.of[0])
            for i, then in enumerate(tree.of[1:], 2):
                node = add(rule, "FOLLOWEDBY", [node, build(rule, then)], outer if i == len(tree.of) else None)
        else:
            node = add(rule, tree.combine, [build(rule, o) for o in tree.of], outer)
        return node if outer is not None else add(rule, "REPEATS", [node], tree, tree.repeats)

    for rule, tree in trees.items():
        build(rule, tree)
    for node in nodes:
        if node.parent is not None:
            node.parent_height = nodes[node.parent].height
    return nodes, leaves


_NODES = ("node int, rule string, height int, op string, sides int, within long, start long, stop long, repeats int, "
          "parent int, side int, parent_height int")


def _table(spark: SparkSession, nodes: list[_Node]) -> DataFrame:
    """The nodes as rows; as many as the rules have observations and brackets."""
    return F.broadcast(spark.createDataFrame([tuple(vars(n).values()) for n in nodes], _NODES))


def hits(logs: DataFrame, conditions: dict[str, Column], key: list[str], ns: str, chunk: int = 100) -> DataFrame:
    """(seen, *key, ns, n): for each condition the times at which it holds, and for how many logs.

    All conditions are one expression of generated code, in chunks; a log that meets none is
    dropped before the shuffle.
    """
    names = list(conditions)
    parts = [F.concat_ws(",", *[F.when(conditions[name], F.lit(str(i))) for i, name in enumerate(names[at:at + chunk], at)])
             for at in range(0, len(names), chunk)]
    seen = F.concat_ws(",", *[F.nullif(p, F.lit("")) for p in parts])
    rows = logs.select(*key, F.col(ns).cast("long").alias("ns"), seen.alias("_seen")).where("_seen <> '' AND ns IS NOT NULL")
    rows = rows.select(*key, "ns", F.explode(F.split("_seen", ",")).alias("_seen"))
    rows = rows.groupBy("_seen", *key, "ns").agg(F.count(F.lit(1)).alias("n"))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_seen").cast("int") + 1)
    return rows.select(named.alias("seen"), *key, "ns", "n")


def _running(rows: DataFrame, key: list[str], at: Column, values: dict[str, Column], width: int, strict: bool = False) -> DataFrame:
    """``rows`` with the largest of each value up to ``at`` (``strict``: before it), of one node and key."""
    placed = rows.withColumn("_at", at).withColumn("_bucket", floor_div(F.col("_at"), width)).withColumns(values)
    own = Window.partitionBy("node", *key, "_bucket").orderBy("_at").rangeBetween(
        Window.unboundedPreceding, -1 if strict else Window.currentRow)
    before = Window.partitionBy("node", *key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("node", *key, "_bucket").agg(*[F.max(v).alias(v) for v in values])
    carried = carried.select("node", *key, "_bucket", *[F.max(v).over(before).alias(f"{v}_before") for v in values])
    inside = placed.withColumns({v: F.max(v).over(own) for v in values})
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["node", *key, "_bucket"]]
    out = inside.alias("a").join(carried.alias("b"), same)
    kept = [F.col(f"a.{c}") for c in rows.columns]
    return out.select(*kept, *[F.greatest(F.col(f"a.{v}"), F.col(f"b.{v}_before")).alias(v) for v in values])


def _combined(rows: DataFrame, key: list[str], width: int, most: int) -> DataFrame:
    """Rows (node, key, last, first) of AND and FOLLOWEDBY nodes from their children's."""
    follows = F.col("op") == "FOLLOWEDBY"
    then = follows & (F.col("side") == 1)
    # Twice the time, so that "before" has a place between two times.
    at = F.when(then, 2 * F.col("first") - 1).otherwise(2 * F.col("last"))
    values = {f"_start{p}": F.when((F.col("side") == p) & ~then, F.col("first")) for p in range(most)}
    found = _running(rows, key, at, values, 2 * width)
    each = [F.when((F.lit(p) >= F.col("sides")) | (F.col("side") == p), F.col("first")).otherwise(F.col(f"_start{p}"))
            for p in range(most)]
    missing = F.lit(False)
    for c in each:
        missing = missing | c.isNull()
    earliest = F.least(*each) if most > 1 else each[0]
    first = F.when(then, F.col("_start0")).when(~follows & ~missing, earliest)
    return found.select("node", *key, "last", first.alias("first")).where("first IS NOT NULL")


def _repeated(rows: DataFrame, key: list[str], width: int) -> DataFrame:
    """Rows of REPEATS nodes: the matches without another inside are numbered, and each is joined
    to the one ``repeats`` - 1 before."""
    inner = _running(rows, key, F.col("last"), {"_start0": F.col("first")}, width, strict=True)
    inner = inner.where("_start0 IS NULL OR first > _start0")
    single = inner.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.col("repeats")).cast("int"))))
    single = single.withColumn("_bucket", floor_div(F.col("last"), width))
    before = Window.partitionBy("node", *key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = single.groupBy("node", *key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("node", *key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("node", *key, "_bucket").orderBy("last"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["node", *key, "_bucket"]]
    numbered = single.withColumn("_own", own).alias("a").join(counts.alias("b"), same).select(
        "a.node", *[f"a.{k}" for k in key], "a.last", "a.first", "a.repeats", (F.col("_own") + F.col("_before")).alias("_i"))
    numbered = cut_lineage(numbered)
    older = numbered.select("node", *key, "first", (F.col("_i") + F.col("repeats") - 1).alias("_i"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["node", *key, "_i"]]
    return numbered.alias("a").join(older.alias("b"), same).select(
        "a.node", *[f"a.{k}" for k in key], "a.last", "b.first")


def matches(seen: DataFrame, trees: dict[str, Observed], key: list[str], bucket_seconds: float = BUCKET_SECONDS) -> DataFrame:
    """(rule, *key, last, first): the shortest match of each rule that ends at ``last``.

    ``seen`` (rule, observation, *key, ns, n) has the times at which observations were made.
    """
    spark, width = seen.sparkSession, round(bucket_seconds * NS)
    nodes, leaves = compiled(trees)
    table = _table(spark, nodes)
    at = spark.createDataFrame([(r, o, n) for (r, o), ids in leaves.items() for n in ids], "rule string, observation int, node int")
    ends = ["node", *key, "last", "first"]
    columns = [*ends, "n"]
    ready = seen.join(F.broadcast(at), ["rule", "observation"]).select(
        "node", *key, F.col("ns").alias("last"), F.col("ns").alias("first"), "n")

    def filtered(rows: DataFrame) -> DataFrame:
        """One row for each end, if its stretch keeps to the node's qualifiers."""
        held = rows.join(table.select("node", "within", "start", "stop"), "node").where(
            "(within IS NULL OR last - first <= within) AND (start IS NULL OR first >= start) AND (stop IS NULL OR last < stop)")
        return held.select(columns)

    ready = filtered(ready)
    for height in range(1, max(n.height for n in nodes) + 1):
        level = [n for n in nodes if n.height == height]
        kids = table.select("node", "parent", "side", "parent_height")
        up = ready.join(kids, "node")
        later = up.where(F.col("parent").isNull() | (F.col("parent_height") > height)).select(columns)
        own = table.select(F.col("node").alias("parent"), "op", "sides", "repeats")
        mine = up.where(F.col("parent_height") == height).join(own, "parent").select(
            F.col("parent").alias("node"), *key, "last", "first", "n", "side", "op", "sides", "repeats")
        mine = cut_lineage(mine)
        made = [mine.where("op = 'OR'").select(ends)]
        if any(n.op in ("AND", "FOLLOWEDBY") for n in level):
            most = max(n.sides for n in level if n.op in ("AND", "FOLLOWEDBY"))
            made.append(_combined(mine.where("op IN ('AND', 'FOLLOWEDBY')"), key, width, most))
        if any(n.op == "REPEATS" for n in level):
            made.append(_repeated(mine.where("op = 'REPEATS'"), key, width))
        all_made = made[0]
        for one in made[1:]:
            all_made = all_made.unionByName(one)
        best = all_made.groupBy("node", *key, "last").agg(F.max("first").alias("first"))
        ready = later.unionByName(filtered(best.withColumn("n", F.lit(1).cast("long")).select(columns)))
    roots = table.where("parent IS NULL").select("node", "rule")
    return ready.join(roots, "node").select("rule", *key, "last", "first")


def together(df: DataFrame, key: list[str], ns: str, conditions: list[Column], seconds: float | None = None,
             combine: str = "AND") -> DataFrame:
    """(*key, ns, first_ns): times at which the last of all (``OR``: any; ``FOLLOWEDBY``: in this
    order) of the conditions came true, all within ``seconds`` of each other, on any rows."""
    tree = Observed(combine=combine, of=tuple(Observed(i) for i in range(len(conditions))), within=seconds)
    seen = hits(df, {str(i): c for i, c in enumerate(conditions)}, key, ns)
    seen = seen.select(F.lit("r").alias("rule"), F.col("seen").cast("int").alias("observation"), *key, "ns", "n")
    return matches(seen, {"r": tree}, key, seconds or BUCKET_SECONDS).select(
        *key, F.col("last").alias(ns), F.col("first").alias("first_ns"))
