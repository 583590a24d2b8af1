"""Rules for configurations as data, checked by joins over the flattened configurations.

A configuration is JSON; ``flatten`` gives one row a node that a rule names.  A rule names nodes by a path
in which ``*`` stands for any one key, and says what must hold of them: their kind or
value, a range, a reference to a key elsewhere, a sum or product of other nodes, values
that are frozen.  Rules of any number meet the nodes of any number of configurations by
equi-joins on the path; what they break comes as rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import staged

#: Between the keys that a path's wildcards stand for.
SEP = "\x1f"
KINDS = ("kind", "filled", "value", "range", "matches", "absent", "refers", "disjoint", "unique", "contains", "frozen", "equal", "sum", "product")
#: Those that look at elements or keys.
_LISTS = ("refers", "disjoint", "unique", "contains", "frozen")


@dataclass(frozen=True)
class Rule:
    """What must hold of the nodes at ``path``; those whose parent is there must be there too, unless ``optional``.

    ``kind``: kind in values; ``filled``: a string that isn't blank; ``value``: text in values; ``range``: a number from
    low to high (``open_``: without the ends), whole if values say "integer"; ``matches``: the regular expression other;
    ``absent``: nothing; ``refers``: the text, or each element's, is a key under other; ``disjoint``: no element in
    common with the array other; ``unique``: low or more different elements and none twice; ``contains``: elements or
    keys include values; ``frozen``: the elements are values, in order; ``equal``: the text of other; ``sum``: the number
    is the sum of the terms (a leading "-" subtracts); ``product``: that of the terms, arrays by their length.
    ``when``: only where the node at that path, under the same keys, has one of ``is_``.
    """

    id: str
    kind: str
    path: str
    values: tuple[str, ...] = ()
    other: str = ""
    low: float | None = None
    high: float | None = None
    open_: bool = False
    terms: tuple[str, ...] = ()
    optional: bool = False
    when: str = ""
    is_: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of rule: {self.kind}")


_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}
NODE = "config_id string, path string, bind string, parent string, kind string, text string, number double, size int"


def _tree(paths) -> dict:
    """Paths by their keys; None stands for a wildcard, and "" has the path that ends there."""
    out: dict = {}
    for path in paths:
        at = out
        for key in _split(path):
            at = at.setdefault((None if key == "*" else key,), {})
        at[""] = path
    return out


def _named(value, at: list[tuple[dict, tuple, tuple]], found: list) -> None:
    """Adds the nodes of ``value`` that paths name; ``at``: where each path stands, the keys of its wildcards, and those without its last key."""
    kind = _KINDS[type(value)]
    text = value if kind == "string" else ("true" if value else "false") if kind == "boolean" else json.dumps(value) if kind in ("integer", "number") else None
    number = float(value) if kind in ("integer", "number") else None
    size = len(value) if kind in ("object", "array") else 0
    for tree, bind, parent in at:
        if "" in tree:
            found.append((tree[""], SEP.join(bind), SEP.join(parent), kind, text, number, size))
    if not size:
        return
    wild = [(tree[None,], bind) for tree, bind, _ in at if (None,) in tree]
    names = {key[0] for tree, _, _ in at for key in tree if key and key[0] is not None}
    for k, x in value.items() if kind == "object" else enumerate(value):
        k = str(k)
        on = [(tree[k,], bind, bind) for tree, bind, _ in at if (k,) in tree] if k in names else []
        on += [(tree, (*bind, k), bind) for tree, bind in wild]
        if on:
            _named(x, on, found)


def flatten(configs: DataFrame, paths: list[str], id_col: str = "config_id", json_col: str = "json") -> DataFrame:
    """One row for each path and node that it names: ``bind`` has the keys that its wildcards stand for, ``parent`` those of the path without its last key.

    What isn't JSON has the one node ``broken`` at the path "", which each configuration has.
    """
    tree = _tree({"", *paths})
    names = [x.split()[0] for x in NODE.split(", ")]

    def step(batches):
        for b in batches:
            out = []
            for cid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found: list = []
                try:
                    _named(json.loads(raw), [(tree, (), ())], found)
                except (TypeError, ValueError, KeyError):
                    found = [("", "", "", "broken", None, None, 0)]
                out += [(cid, *n) for n in found]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [pa.string()] * 6 + [pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    src = configs.select(F.col(id_col).cast("string").alias("config_id"), F.col(json_col).cast("string").alias("json"))
    return src.mapInArrow(step, NODE)


def _split(path: str) -> list[str]:
    return path.split(".") if path else []


def _within(inner: str, outer: str) -> Column:
    """Whether the keys of ``outer`` are the first of ``inner``."""
    return (F.col(outer) == "") | (F.col(inner) == F.col(outer)) | F.startswith(F.col(inner), F.concat(F.col(outer), F.lit(SEP)))


def _of_lists(have: set[str], part, of_kind, say) -> list[DataFrame]:
    """What breaks rules on elements and keys, for the kinds of rules that there are."""
    found = []
    elements = part("in").select("config_id", "rule", F.col("bind").alias("inner"), F.col("parent").alias("bind"), F.col("text").alias("element"), F.col("key").alias("key"))
    other = part("other", kinds=_LISTS).select("config_id", "rule", "key", F.col("text").alias("other_text"), F.col("parent").alias("given"))
    arrays = of_kind(*_LISTS)
    named = arrays.where("kind = 'string'").select("config_id", "rule", "rule_kind", "bind", F.col("text").alias("element")).unionByName(arrays.where("kind in ('array', 'object')").join(elements, ["config_id", "rule", "bind"]).select("config_id", "rule", "rule_kind", "bind", F.when(F.col("kind") == "array", F.col("element")).otherwise(F.col("key")).alias("element")))
    if "refers" in have:
        refs = named.where("rule_kind = 'refers'").select("config_id", "rule", "bind", "element").distinct()
        found.append(say(refs.join(other.select("config_id", "rule", F.col("key").alias("element")), ["config_id", "rule", "element"], "left_anti"), "refers"))
    found.append(say(arrays.where("(rule_kind = 'refers' and kind not in ('string', 'array')) or (rule_kind in ('disjoint', 'unique', 'frozen') and kind <> 'array') or (rule_kind = 'contains' and kind not in ('array', 'object'))"), "kind"))
    if "disjoint" in have:
        both = named.where("rule_kind = 'disjoint'").join(other.select("config_id", "rule", F.col("other_text").alias("element")).distinct(), ["config_id", "rule", "element"])
        found.append(say(both.select("config_id", "rule", "bind").distinct(), "disjoint"))
    if have & {"unique", "contains"}:
        lists = named.where("rule_kind in ('unique', 'contains')").groupBy("config_id", "rule", "rule_kind", "bind").agg(F.count("element").alias("n"), F.count_distinct("element").alias("d"), F.collect_set("element").alias("have"))
        lists = arrays.where("rule_kind in ('unique', 'contains')").select("config_id", "rule", "rule_kind", "bind", "values", "low", "size").join(lists, ["config_id", "rule", "rule_kind", "bind"], "left")
        count = F.coalesce("d", F.lit(0))
        found.append(say(lists.where((F.col("rule_kind") == "unique") & ((count < F.coalesce("low", F.lit(0.0))) | (count < F.col("size")))), "unique"))
        found.append(say(lists.where((F.col("rule_kind") == "contains") & (F.size(F.array_except("values", F.coalesce("have", F.array().cast("array<string>")))) > 0)), "contains"))
    if "frozen" in have:
        ordered = of_kind("frozen").select("config_id", "rule", "bind", "values").join(elements, ["config_id", "rule", "bind"], "left").groupBy("config_id", "rule", "bind", "values").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct(F.col("key").try_cast("int").alias("i"), "element")))), lambda x: x["element"]).alias("have"))
        found.append(say(ordered.where(F.col("have") != F.col("values")), "frozen"))
    return found


def problems(configs: DataFrame, rules: list[Rule], id_col: str = "config_id", json_col: str = "json") -> DataFrame:
    """(config_id, rule, at, problem) of whatever breaks a rule; a configuration that isn't a JSON object breaks ``json``."""
    spark = configs.sparkSession
    if len({r.id for r in rules}) != len(rules):
        raise ValueError("rules need different ids")
    asked = []
    for r in rules:
        up = _split(r.path)[:-1]
        asked += [(f"{r.id}|own", r.path), (f"{r.id}|up", ".".join(up))]
        asked += [(f"{r.id}|in", f"{r.path}.*")] if r.kind in _LISTS else []
        asked += [(f"{r.id}|other", r.other)] if r.kind in ("equal",) else [(f"{r.id}|other", f"{r.other}.*")] if r.kind in ("refers", "disjoint") else []
        asked += [(f"{r.id}|when", r.when)] if r.when else []
        asked += [(f"{r.id}|t{i}", t.removeprefix("-")) for i, t in enumerate(r.terms)]
    nodes = staged(flatten(configs, [p for _, p in asked], id_col, json_col))  # read by each kind of rule, but parsed once
    table = F.broadcast(spark.createDataFrame([(name, name.rpartition("|")[0], name.rpartition("|")[2], p) for name, p in asked], "name string, rule string, part string, path string"))  # the rules: a list of the caller's
    told = spark.createDataFrame([(r.id, r.kind, list(r.values), r.other, None if r.low is None else float(r.low), None if r.high is None else float(r.high), r.open_, r.optional, r.when, list(r.is_)) for r in rules], "rule string, rule_kind string, values array<string>, pattern string, low double, high double, open_ boolean, optional boolean, when_ string, is_ array<string>")

    have = {r.kind for r in rules}

    def part(*names: str, kinds=KINDS) -> DataFrame:
        """The nodes that the paths for these parts name, of rules of these kinds."""
        ids = {r.id for r in rules if r.kind in kinds}
        mine = [(name, p) for name, p in asked if name.rpartition("|")[2] in names and name.rpartition("|")[0] in ids]
        some = nodes.where(F.col("path").isin(sorted({p for _, p in mine}))).join(table.where(F.col("name").isin([name for name, _ in mine])), "path").drop("path", "name")
        return some.withColumn("key", F.substring_index("bind", SEP, -1))  # of what a wildcard ends

    keep = [r.id for r in rules if r.when]
    holds = part("when").join(F.broadcast(told.select("rule", "is_")), "rule").where(F.array_contains("is_", F.col("text"))).select("config_id", "rule", F.col("bind").alias("given"))

    def conditioned(df: DataFrame, of: str) -> DataFrame:
        """Rows whose condition holds, or that have none."""
        if not keep:
            return df
        free, bound = df.where(~F.col("rule").isin(keep)), df.where(F.col("rule").isin(keep))
        return free.unionByName(bound.join(holds, ["config_id", "rule"]).where(_within(of, "given")).select(*df.columns).distinct())

    of_kind = lambda *kinds: conditioned(part("own", kinds=kinds).select("config_id", "rule", "bind", "parent", "kind", "text", "number", "size"), "bind").join(F.broadcast(told), "rule")
    ups = conditioned(part("up").select("config_id", "rule", "bind", "kind").where("kind = 'object'").select("config_id", "rule", F.col("bind").alias("parent")), "parent").join(F.broadcast(told.select("rule", "optional", "rule_kind")), "rule")
    must = ups.where("not optional and rule_kind <> 'absent'").join(spark.createDataFrame([(r.id,) for r in rules if not r.path.endswith("*")], "rule string"), "rule", "left_semi")
    say = lambda df, what, at="bind": df.select("config_id", "rule", F.col(at).alias("at"), F.lit(what).alias("problem"))
    found = [say(must.join(part("own").select("config_id", "rule", "parent"), ["config_id", "rule", "parent"], "left_anti"), "missing", "parent")]

    whole = F.col("kind") == "integer"
    number = F.col("kind").isin("integer", "number") & ~F.isnan(F.coalesce("number", F.lit(float("nan"))))
    inside = F.when(F.col("open_"), (F.coalesce(F.col("number") > F.col("low"), F.lit(True))) & (F.coalesce(F.col("number") < F.col("high"), F.lit(True)))).otherwise((F.coalesce(F.col("number") >= F.col("low"), F.lit(True))) & (F.coalesce(F.col("number") <= F.col("high"), F.lit(True))))
    fine = {
        "kind": F.array_contains("values", F.col("kind")),
        "filled": (F.col("kind") == "string") & (F.btrim("text") != ""),
        "value": F.array_contains("values", F.col("text")) & F.col("text").isNotNull(),
        "range": number & inside & (whole | ~F.array_contains("values", "integer")),
        "matches": (F.col("kind") == "string") & F.regexp_like("text", F.col("pattern")),
        "absent": F.lit(False),
    }
    if have & fine.keys():
        ok = F.coalesce(*[F.when(F.col("rule_kind") == kind, F.coalesce(x, F.lit(False))) for kind, x in fine.items()])
        found.append(of_kind(*fine).where(~ok).select("config_id", "rule", F.col("bind").alias("at"), F.col("rule_kind").alias("problem")))
    if have & set(_LISTS):
        found += _of_lists(have, part, of_kind, say)
    if "equal" in have:
        same = of_kind("equal").join(part("other", kinds=["equal"]).select("config_id", "rule", F.col("bind").alias("given"), F.col("text").alias("other_text")), ["config_id", "rule"], "left").where(F.col("given").isNull() | _within("bind", "given"))
        found.append(say(same.where(~F.col("text").eqNullSafe(F.col("other_text"))), "equal"))

    terms = [(r.id, f"t{i}", -1.0 if t.startswith("-") else 1.0, len(r.terms)) for r in rules for i, t in enumerate(r.terms)]
    if terms:
        signs = F.broadcast(spark.createDataFrame(terms, "rule string, part string, sign double, n int"))
        worth = F.when(F.col("kind") == "array", F.col("size").cast("double")).otherwise(F.col("number"))
        value = part(*sorted({t for _, t, _, _ in terms})).join(signs, ["rule", "part"]).select("config_id", "rule", "sign", "n", worth.alias("x"), F.col("bind").alias("given"))
        sums = of_kind("sum", "product").select("config_id", "rule", "rule_kind", "bind", "parent", "number").join(value, ["config_id", "rule"], "left").where(F.col("given").isNull() | _within("parent", "given") | _within("bind", "given"))
        got = sums.groupBy("config_id", "rule", "rule_kind", "bind", "number").agg(F.count("x").alias("k"), F.max("n").alias("n"), F.sum(F.col("sign") * F.col("x")).alias("s"), F.product("x").alias("p"))
        right = (F.col("k") == F.col("n")) & (F.abs(F.col("number") - F.when(F.col("rule_kind") == "sum", F.col("s")).otherwise(F.col("p"))) <= 1e-9 * F.greatest(F.abs("number"), F.lit(1.0)))
        found.append(got.where(~F.coalesce(right, F.lit(False))).select("config_id", "rule", F.col("bind").alias("at"), F.col("rule_kind").alias("problem")))
    broken = nodes.where("path = '' and kind <> 'object'").select("config_id", F.lit("json").alias("rule"), F.lit("").alias("at"), F.lit("kind").alias("problem"))
    return reduce(DataFrame.unionByName, [*found, broken]).distinct()

