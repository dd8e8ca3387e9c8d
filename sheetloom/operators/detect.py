"""Detection: repeated declarations and selectors, as windows and groups over declarations.

All of it is DataFrame operations. Tables are dealt out once by (sheet, scope); every window and
group below has those columns among its keys, so nothing is dealt out again.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scopes import at_rule_label, containers, scope_names
from ..functions.selectors import ignored, list_key, split_list
from ..functions.tree import Node, parse
from ..functions.values import declaration_key
from ..plans.options import Options
from .tables import declarations, per_sheet, rules

_key = lru_cache(1 << 16)(declaration_key)

FINDING = "sheet_id long, finding_seq int, kind string, scope string, key string, occurrences array<struct<selector: string, selectors: array<string>, prop: string, value: string, line: int>>"


def within_rule(decls: DataFrame) -> DataFrame:
    """Every occurrence of a key in one rule after its first."""
    w = Window.partitionBy("sheet_id", "scope_key", "rule_id", "decl_key").orderBy("decl_pos")
    return decls.withColumn("nth", F.row_number().over(w)).where("nth > 1")


def first_in_rule(decls: DataFrame) -> DataFrame:
    """The first declaration of each key in each rule."""
    w = Window.partitionBy("sheet_id", "scope_key", "rule_id", "decl_key").orderBy("decl_pos")
    return decls.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def cross_rule(decls: DataFrame) -> DataFrame:
    """Keys in two or more rules of a scope: sheet_id, scope_key, decl_key, prop_norm, n_rules,
    first_pos, last_pos, n_occurrences."""
    g = decls.groupBy("sheet_id", "scope_key", "decl_key").agg(
        F.min("prop_norm").alias("prop_norm"), F.countDistinct("rule_id").alias("n_rules"), F.min("rule_pos").alias("first_pos"),
        F.max("rule_pos").alias("last_pos"), F.count(F.lit(1)).alias("n_occurrences"),
    )
    return g.where("n_rules >= 2")


def repeated_selectors(rules_: DataFrame) -> DataFrame:
    """Selector lists that a physical block has more than once."""
    g = rules_.groupBy("sheet_id", "container_id", "selector_key").agg(F.count(F.lit(1)).alias("n_rules"), F.min("rule_pos").alias("first_pos"), F.max("rule_pos").alias("last_pos"))
    return g.where("n_rules >= 2")


def shortest_spelling(decls: DataFrame) -> DataFrame:
    """The shortest value of each key and scope that is in the source; the first of equal ones."""
    rank = F.struct(F.length("value"), "rule_pos", "decl_pos", "value")
    return decls.groupBy("sheet_id", "scope_key", "decl_key").agg(F.min_by("value", rank).alias("value"))


def _occurrence(selector: str = "rule_selector", selectors: str = "rule_selectors", decl: bool = True) -> Column:
    prop, value = (F.col("prop"), F.col("value")) if decl else (F.lit(None).cast("string"),) * 2
    return F.struct(F.col(selector).alias("selector"), F.col(selectors).alias("selectors"), prop.alias("prop"), value.alias("value"), F.col("line").alias("line"))


def findings(nodes_: DataFrame, options: Options = Options()) -> DataFrame:
    """All findings of each sheet in report order (FINDING): by scope, repeats within rules and
    then across rules; then repeated selectors by block; then repeats in selector-less blocks."""
    decls = declarations(nodes_, options).repartition("sheet_id", "scope_key")
    in_rules = decls.where("rule_kind = 'rule' AND eligible")
    # blocks of one condition are one scope, in the place of the first that has a rule
    place = rules(nodes_, options).groupBy("sheet_id", "scope_key").agg(F.min("container_id").alias("scope_pos"))
    by_source = ["rule_line", "rule_col"]

    redundant = within_rule(in_rules).select(
        "sheet_id", "scope_key", F.lit("redundant").alias("kind"), F.col("scope_label").alias("scope"), F.col("decl_key").alias("key"), F.array(_occurrence()).alias("occurrences"),
        F.array(F.lit(0), F.lit(0), F.col("rule_line"), F.col("rule_col"), F.col("decl_pos")).alias("order"),
    )
    one = F.struct(*by_source, "decl_pos", _occurrence().alias("occurrence"))
    across = first_in_rule(in_rules).groupBy("sheet_id", "scope_key", "decl_key").agg(F.first("scope_label").alias("scope"), F.array_sort(F.collect_list(one)).alias("all"))
    duplicate = across.where(F.size("all") >= 2).select(
        "sheet_id", "scope_key", F.lit("duplicate").alias("kind"), "scope", F.col("decl_key").alias("key"), F.col("all.occurrence").alias("occurrences"),
        F.array(F.lit(0), F.lit(1), F.col("all")[0]["rule_line"], F.col("all")[0]["rule_col"], F.col("all")[0]["decl_pos"]).alias("order"),
    )
    declared = redundant.unionByName(duplicate).join(place, ["sheet_id", "scope_key"])
    declared = declared.withColumn("order", F.concat(F.array(F.lit(0), F.col("scope_pos")), F.slice("order", 2, 4)))

    again = F.struct("rule_pos", _occurrence("selector", "selectors", decl=False).alias("occurrence"))
    same = rules(nodes_, options).where("eligible").groupBy("sheet_id", "container_id", "selector_key").agg(F.first("scope_label").alias("scope"), F.array_sort(F.collect_list(again)).alias("all"))
    repeated = same.where(F.size("all") >= 2).select(
        "sheet_id", F.lit("repeated").alias("kind"), "scope", F.array_join(F.col("all")[0]["occurrence"]["selectors"], ", ").alias("key"), F.col("all.occurrence").alias("occurrences"),
        F.array(F.lit(1), F.col("container_id"), F.lit(0), F.col("all")[0]["rule_pos"], F.lit(0), F.lit(0)).alias("order"),
    )
    bare = decls.where("rule_kind = 'atrule'")
    in_at_rules = within_rule(bare).select(
        "sheet_id", F.lit("redundant").alias("kind"), F.col("scope_label").alias("scope"), F.col("decl_key").alias("key"), F.array(_occurrence()).alias("occurrences"),
        F.array(F.lit(2), F.col("rule_id"), F.col("decl_pos"), F.lit(0), F.lit(0), F.lit(0)).alias("order"),
    )
    columns = ["sheet_id", "kind", "scope", "key", "occurrences", "order"]
    whole = declared.select(columns).unionByName(repeated.select(columns)).unionByName(in_at_rules.select(columns))
    seq = F.row_number().over(Window.partitionBy("sheet_id").orderBy("order"))
    return whole.withColumn("finding_seq", seq).select("sheet_id", "finding_seq", "kind", "scope", "key", "occurrences")


def _told(node: Node, selector: str, selectors: list[str], decl: Node | None = None) -> dict:
    prop, value, line = (decl.name, decl.text, decl.line) if decl else (None, None, node.line)
    return {"selector": selector, "selectors": selectors, "prop": prop, "value": value, "line": line}


def sheet_findings(root: Node, options: Options = Options()) -> list[dict]:
    """The same of one sheet that was just parsed (nodes are numbered by ``seq``)."""
    names = {node: scope_names(chain) for node, chain in containers(root)}
    found: list[tuple[tuple, str, str, str, list[dict]]] = []
    place: dict[str, int] = {}  # of each scope: the first of its blocks that has a rule
    across: dict[tuple[str, str], list[tuple[Node, Node]]] = {}
    same: dict[tuple[Node, str], list[Node]] = {}
    redundant: list[tuple[Node, Node, str]] = []
    for block in names:
        if block.kind == "rule":
            scope = names[block.parent][0]
            place[scope] = min(place.get(scope, block.parent.seq), block.parent.seq)
            if any(ignored(s, options.ignored) for s in split_list(block.text)):
                continue
            same.setdefault((block.parent, list_key(block.text)), []).append(block)
        seen = set()
        for d in block.children:
            if d.kind != "decl":
                continue
            key = _key(d.name, d.text, d.important, options.aggressive)
            if key in seen:
                redundant.append((block, d, key))
                continue
            seen.add(key)
            if block.kind == "rule":
                across.setdefault((scope, key), []).append((block, d))
    for block, d, key in redundant:
        if block.kind == "rule":
            scope, label = names[block.parent]
            found.append(((0, place[scope], 0, block.line, block.column, d.seq), "redundant", label, key, [_told(block, block.text, split_list(block.text), d)]))
        else:
            name = at_rule_label(block)
            found.append(((2, block.seq, d.seq, 0, 0, 0), "redundant", names[block][1], key, [_told(block, name, [name], d)]))
    for (scope, key), members in across.items():
        if len(members) > 1:
            first, d = members[0]
            found.append(((0, place[scope], 1, first.line, first.column, d.seq), "duplicate", names[first.parent][1], key, [_told(r, r.text, split_list(r.text), d) for r, d in members]))
    for (block, _), rules_ in same.items():
        if len(rules_) > 1:
            found.append(((1, block.seq, 0, rules_[0].seq, 0, 0), "repeated", names[block][1], ", ".join(split_list(rules_[0].text)), [_told(r, r.text, split_list(r.text)) for r in rules_]))
    found.sort(key=lambda f: f[0])
    return [{"finding_seq": k, "kind": kind, "scope": scope, "key": key, "occurrences": all_} for k, (_, kind, scope, key, all_) in enumerate(found, 1)]


def analyze(sheets: DataFrame, options: Options = Options(), kinds: tuple[str, ...] = ()) -> DataFrame:
    """Findings of sheets (sheet_id, css); of some kinds alone, for who needs no others.

    A sheet is a row, and its findings are told where it is parsed: nothing is dealt out, sorted or
    kept. A sheet that does not parse, or that anything else goes wrong with, has none.
    """

    def rows(css: str) -> list[dict]:
        try:
            return [f for f in sheet_findings(parse(css), options) if not kinds or f["kind"] in kinds]
        except Exception:  # one sheet never fails the others
            return []

    return per_sheet(sheets, rows, FINDING)
