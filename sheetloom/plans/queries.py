"""Queries over the driver's tables, one or more per operator, and the same in DuckDB's SQL.

The tables hold little CSS, so relational operators run on a view of lineitem as declarations:
twelve orders are a sheet, a return flag is a scope, an order a rule, a line a declaration.
Every query takes its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import udfs as U
from ..functions.selectors import DEFAULT_IGNORED
from ..operators import detect, report, safety
from ..operators.consolidate import conventions, dedup
from ..operators.tables import declarations, nodes, rules
from ..sources.sheets import style_tags
from .options import Options

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PROPS = ["margin", "margin-left", "color", "border-top", "border-color", "padding", "display", "font-weight"]
_OVERLAPS = [("margin", "margin-left"), ("border-top", "border-color")]
_DECLS_SQL = f"""decls AS (
    SELECT l_orderkey // 12 AS sheet_id, l_returnflag AS scope_key,
           l_orderkey AS rule_id, l_orderkey AS rule_pos, l_linenumber AS decl_pos,
           list_value({", ".join(f"'{p}'" for p in PROPS)})[1 + l_partkey % {len(PROPS)}] AS prop_norm,
           (CAST(l_quantity AS BIGINT) % 3) || 'px' AS value,
           list_value({", ".join(f"'{p}'" for p in PROPS)})[1 + l_partkey % {len(PROPS)}] || ': ' || (CAST(l_quantity AS BIGINT) % 3) || 'px' AS decl_key
    FROM lineitem)"""
_OVER_SQL = "over(p, q) AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in [*((p, p) for p in PROPS), *_OVERLAPS, *((b, a) for a, b in _OVERLAPS)]) + "))"
_GROUPS_SQL = """members AS (
    SELECT sheet_id, scope_key, decl_key, min(prop_norm) AS prop_norm, rule_id, min(rule_pos) AS rule_pos
    FROM decls GROUP BY sheet_id, scope_key, decl_key, rule_id
    QUALIFY count(*) OVER (PARTITION BY sheet_id, scope_key, decl_key) >= 2),
  groups AS (
    SELECT sheet_id, scope_key, decl_key, min(prop_norm) AS prop_norm, count(*) AS n_rules, min(rule_pos) AS first_pos, max(rule_pos) AS last_pos
    FROM members GROUP BY sheet_id, scope_key, decl_key)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def declaration_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    prop = F.element_at(F.array(*map(F.lit, PROPS)), (1 + F.col("l_partkey") % len(PROPS)).cast("int"))
    value = F.concat((F.col("l_quantity").cast("long") % 3).cast("string"), F.lit("px"))
    return lines.select(
        F.expr("l_orderkey div 12").alias("sheet_id"), F.col("l_returnflag").alias("scope_key"), F.col("l_orderkey").alias("rule_id"),
        F.col("l_orderkey").alias("rule_pos"), F.col("l_linenumber").alias("decl_pos"), prop.alias("prop_norm"), value.alias("value"), F.concat(prop, F.lit(": "), value).alias("decl_key"),
    )


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows, if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- aggregates and windows


@query(f"WITH {_DECLS_SQL} SELECT sheet_id, scope_key, decl_key, min(prop_norm) AS prop_norm, count(DISTINCT rule_id) AS n_rules, min(rule_pos) AS first_pos, max(rule_pos) AS last_pos, count(*) AS n_occurrences FROM decls GROUP BY sheet_id, scope_key, decl_key HAVING count(DISTINCT rule_id) >= 2")
def dup_cross_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.cross_rule(declaration_view(spark, sf_dir))


@query(f"WITH {_DECLS_SQL} SELECT sheet_id, scope_key, rule_id, decl_key, decl_pos, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sheet_id, scope_key, rule_id, decl_key ORDER BY decl_pos) AS INTEGER) AS nth FROM decls) WHERE nth > 1")
def dup_within_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.within_rule(declaration_view(spark, sf_dir)).select("sheet_id", "scope_key", "rule_id", "decl_key", "decl_pos", "nth")


_RULES_SQL = "rules AS (SELECT sheet_id, scope_key AS container_id, rule_id, min(rule_pos) AS rule_pos, '.c' || (rule_id % 5) AS selector_key FROM decls GROUP BY sheet_id, scope_key, rule_id)"


@query(f"WITH {_DECLS_SQL}, {_RULES_SQL} SELECT sheet_id, container_id, selector_key, count(*) AS n_rules, min(rule_pos) AS first_pos, max(rule_pos) AS last_pos FROM rules GROUP BY ALL HAVING count(*) >= 2")
def repeated_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = declaration_view(spark, sf_dir)
    rules = d.groupBy("sheet_id", F.col("scope_key").alias("container_id"), "rule_id").agg(F.min("rule_pos").alias("rule_pos"))
    return detect.repeated_selectors(rules.withColumn("selector_key", F.concat(F.lit(".c"), (F.col("rule_id") % 5).cast("string"))))


@query(f"WITH {_DECLS_SQL}, spelt AS (SELECT *, repeat('0', decl_pos % 3) || value AS spelling FROM decls) SELECT sheet_id, scope_key, decl_key, arg_min(spelling, (length(spelling), rule_pos, decl_pos, spelling)) AS value FROM spelt GROUP BY sheet_id, scope_key, decl_key")
def shortest_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = declaration_view(spark, sf_dir)
    return detect.shortest_spelling(d.withColumn("value", F.concat(F.repeat(F.lit("0"), F.col("decl_pos") % 3), "value")))


def _style_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet a user of events, one rule an event, in order: the event's type decides the gap before
    the rule, whether its list is spaced, and whether it stands in an anonymous layer."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    kind = F.col("event_type")
    gap = F.when(kind == "click", "\n\n").when(kind == "view", "\n").otherwise(" ")
    rule = F.concat(F.lit(".a"), F.col("event_id").cast("string"), F.when(kind == "click", ", ").otherwise(","), F.lit(".b { top: 0; }"))
    layer = F.when(kind == "click", F.concat(F.lit("@layer { "), rule, F.lit(" }"))).otherwise(rule)
    texts = F.array_sort(F.collect_list(F.struct("event_id", F.concat(gap, layer).alias("text"))))
    return events.groupBy(F.col("user_id").alias("sheet_id")).agg(F.array_join(texts["text"], "").alias("css"))


_GAP_SQL = "CASE event_type WHEN 'click' THEN chr(10) || chr(10) WHEN 'view' THEN chr(10) ELSE ' ' END"


@query(f"""WITH placed AS (SELECT user_id, {_GAP_SQL} AS gap, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  gaps AS (SELECT user_id, gap, count(*) AS times, min(n) AS first_n FROM placed WHERE n > 1 GROUP BY user_id, gap), users AS (SELECT DISTINCT user_id FROM events)
  SELECT u.user_id AS sheet_id, coalesce(arg_max(gap, (times, -first_n)), chr(10)) AS gap FROM users u LEFT JOIN gaps g USING (user_id) GROUP BY u.user_id""")
def separator_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent gap of a sheet's rules; of equally frequent ones the first seen."""
    return conventions(_style_sheets(spark, sf_dir)).select("sheet_id", "gap")


@query("SELECT user_id AS sheet_id, CASE WHEN count(*) FILTER (event_type = 'click') >= count(*) FILTER (event_type <> 'click') THEN ', ' ELSE ',' END AS comma, false AS one_a_line FROM events GROUP BY user_id")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How most of a sheet's selector lists are spaced; ties go to the space."""
    return conventions(_style_sheets(spark, sf_dir)).select("sheet_id", "comma", "one_a_line")


@query("SELECT user_id AS sheet_id, '.a' || event_id || ', .b' AS selector, '@layer (anonymous ' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) || ')' AS label FROM events WHERE event_type = 'click'")
def anonymous_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules(nodes(_style_sheets(spark, sf_dir), kinds=("rule",))).where("scope_label <> 'root'")
    return found.select("sheet_id", "selector", F.col("scope_label").alias("label"))


@query(f"WITH {_DECLS_SQL}, placed AS (SELECT DISTINCT sheet_id, scope_key, rule_pos FROM decls) SELECT rule_pos, CAST(row_number() OVER (PARTITION BY sheet_id, scope_key ORDER BY rule_pos) AS INTEGER) AS place FROM placed")
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in the order of their lines, as parsing numbers them."""
    found = rules(nodes(synthetic_sheets(spark, sf_dir), kinds=("rule",)))
    place = F.row_number().over(Window.partitionBy("sheet_id").orderBy("rule_pos"))
    return found.select(F.regexp_extract("selector", r"\d+", 0).cast("long").alias("rule_pos"), place.alias("place"))


@query(f"WITH {_DECLS_SQL}, {_GROUPS_SQL} SELECT sheet_id, scope_key, count(*) AS n FROM groups GROUP BY sheet_id, scope_key")
def findings_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate findings of sheets whose scopes are at-rules, by scope."""
    found = detect.analyze(synthetic_sheets(spark, sf_dir, whole=True), kinds=("duplicate",))
    return found.groupBy("sheet_id", F.regexp_extract("scope", r"^@media (.*)$", 1).alias("scope_key")).agg(F.count(F.lit(1)).alias("n"))


# -- joins: safety


@query(f"""WITH {_DECLS_SQL}, {_OVER_SQL}, {_GROUPS_SQL}, inside AS (
    SELECT DISTINCT g.sheet_id, g.scope_key, g.decl_key, d.rule_id FROM groups g
    JOIN decls d ON d.sheet_id = g.sheet_id AND d.scope_key = g.scope_key AND d.rule_pos > g.first_pos AND d.rule_pos < g.last_pos
    JOIN over ON over.p = g.prop_norm AND over.q = d.prop_norm
    ANTI JOIN members m ON m.sheet_id = g.sheet_id AND m.scope_key = g.scope_key AND m.decl_key = g.decl_key AND m.rule_id = d.rule_id)
  SELECT g.sheet_id, g.scope_key, g.decl_key, g.prop_norm, g.n_rules, g.first_pos, g.last_pos, count(i.rule_id) AS n_between, count(i.rule_id) > 0 AS fenced
  FROM groups g LEFT JOIN inside i USING (sheet_id, scope_key, decl_key) GROUP BY ALL""")
def blocked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.fences(declaration_view(spark, sf_dir), safety.overlap_table(spark))


@query(f"""WITH {_DECLS_SQL}, {_OVER_SQL}, {_GROUPS_SQL}, inside AS (
    SELECT g.sheet_id, g.scope_key, g.decl_key, d.rule_id, d.rule_pos, d.decl_pos, d.prop_norm FROM groups g
    JOIN decls d ON d.sheet_id = g.sheet_id AND d.scope_key = g.scope_key AND d.rule_pos > g.first_pos AND d.rule_pos < g.last_pos
    JOIN over ON over.p = g.prop_norm AND over.q = d.prop_norm
    ANTI JOIN members m ON m.sheet_id = g.sheet_id AND m.scope_key = g.scope_key AND m.decl_key = g.decl_key AND m.rule_id = d.rule_id)
  SELECT sheet_id, scope_key, decl_key, arg_min(rule_id, (rule_pos, decl_pos, prop_norm)) AS rule_id, arg_min(prop_norm, (rule_pos, decl_pos, prop_norm)) AS prop_norm, min(rule_pos) AS rule_pos FROM inside GROUP BY sheet_id, scope_key, decl_key""")
def group_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.blockers(declaration_view(spark, sf_dir), safety.overlap_table(spark))


@query(f"""WITH {_DECLS_SQL}, {_OVER_SQL}, {_GROUPS_SQL}, steps AS (
    SELECT *, lag(rule_pos) OVER w AS before FROM members WINDOW w AS (PARTITION BY sheet_id, scope_key, decl_key ORDER BY rule_pos)),
  broken AS (
    SELECT s.*, CASE WHEN before IS NULL OR EXISTS (SELECT 1 FROM decls d JOIN over ON over.p = s.prop_norm AND over.q = d.prop_norm
      WHERE d.sheet_id = s.sheet_id AND d.scope_key = s.scope_key AND d.rule_pos > s.before AND d.rule_pos < s.rule_pos) THEN 1 ELSE 0 END AS new FROM steps s),
  numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY sheet_id, scope_key, decl_key ORDER BY rule_pos) AS BIGINT) AS run_no FROM broken)
  SELECT sheet_id, scope_key, decl_key, run_no, count(*) AS n_rules, min(rule_pos) AS first_pos, max(rule_pos) AS last_pos FROM numbered GROUP BY ALL""")
def safe_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.runs(declaration_view(spark, sf_dir), safety.overlap_table(spark))


_REACH_SQL = """reach AS (
    SELECT sheet_id, scope_key, decl_key, decl_key AS other FROM groups
    UNION
    SELECT r.sheet_id, r.scope_key, r.decl_key, b.decl_key FROM reach r
    JOIN members a ON a.sheet_id = r.sheet_id AND a.scope_key = r.scope_key AND a.decl_key = r.other
    JOIN members b ON b.sheet_id = a.sheet_id AND b.scope_key = a.scope_key AND b.rule_id = a.rule_id),
  clusters AS (SELECT sheet_id, scope_key, decl_key, min(other) AS cluster FROM reach GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_DECLS_SQL}, {_GROUPS_SQL}, {_REACH_SQL} SELECT * FROM clusters")
def cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.clusters(declaration_view(spark, sf_dir))


@query(f"""WITH RECURSIVE {_DECLS_SQL}, {_GROUPS_SQL}, {_REACH_SQL},
  size AS (SELECT sheet_id, scope_key, cluster, count(*) AS n_groups FROM clusters GROUP BY ALL HAVING count(*) > 1),
  held AS (SELECT m.sheet_id, m.scope_key, c.cluster, m.rule_id, count(DISTINCT m.decl_key) AS n_keys FROM members m JOIN clusters c USING (sheet_id, scope_key, decl_key) GROUP BY ALL)
  SELECT s.sheet_id, s.scope_key, s.cluster, s.n_groups, count(*) FILTER (n_keys = n_groups) AS n_hubs,
    count(*) FILTER (n_keys = n_groups) = 1 AND bool_and(n_keys = n_groups OR n_keys = 1) AS is_star
  FROM size s JOIN held h USING (sheet_id, scope_key, cluster) GROUP BY ALL""")
def star_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.hubs(declaration_view(spark, sf_dir))


@query("WITH " + _OVER_SQL + ", props(a) AS (SELECT DISTINCT p FROM over) SELECT x.a AS a, y.a AS b, EXISTS (SELECT 1 FROM over WHERE p = x.a AND q = y.a) AS touches FROM props x, props y")
def prop_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the view's properties overlap: a dimension join, fixed in size."""
    pairs = spark.createDataFrame([(a, b) for a in PROPS for b in PROPS], "a string, b string")
    known = safety.overlap_table(spark).select(F.col("prop_norm").alias("a"), F.col("touches").alias("b"), F.lit(True).alias("hit"))
    return pairs.join(known, ["a", "b"], "left").select("a", "b", (F.coalesce("hit", F.lit(False)) | (F.col("a") == F.col("b"))).alias("touches"))


# -- reports

_RUNS_SQL = """runs AS (
    SELECT o_orderkey AS sheet_id, 'default' AS mode, CAST(floor(o_totalprice) AS BIGINT) AS before, CAST(o_custkey % 201 - 100 AS BIGINT) AS saved, CAST(o_orderkey % 5 AS BIGINT) AS n_applied FROM orders
    UNION ALL SELECT o_orderkey, 'aggressive', CAST(floor(o_totalprice) AS BIGINT), CAST(o_custkey % 301 - 100 AS BIGINT), CAST(o_orderkey % 7 AS BIGINT) FROM orders),
  matrix AS (
    SELECT sheet_id, mode AS way, before, saved, n_applied, n_applied = 0 AS unavailable FROM runs
    UNION ALL SELECT sheet_id, mode || '_gated', before, CASE WHEN saved < 0 THEN 0 ELSE saved END, CASE WHEN saved < 0 THEN 0 ELSE n_applied END, (CASE WHEN saved < 0 THEN 0 ELSE n_applied END) = 0 FROM runs)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    both = None
    for mode, a, b in (("default", 201, 5), ("aggressive", 301, 7)):
        one = orders.select(F.col("o_orderkey").alias("sheet_id"), F.lit(mode).alias("mode"), F.floor("o_totalprice").alias("before"), (F.col("o_custkey") % a - 100).alias("saved"), (F.col("o_orderkey") % b).alias("n_applied"))
        both = one if both is None else both.unionByName(one)
    return both


@query(f"WITH {_RUNS_SQL} SELECT * FROM matrix")
def savings_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.savings_matrix(_runs(spark, sf_dir))


@query(f"WITH {_RUNS_SQL} SELECT way, sheet_id, CAST(sum(before) AS BIGINT) AS before, CAST(sum(saved) AS BIGINT) AS saved, bool_and(unavailable) AS unavailable FROM matrix GROUP BY GROUPING SETS ((way, sheet_id), (way))")
def rollup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.with_totals(report.savings_matrix(_runs(spark, sf_dir)))


@query(f"""WITH {_RUNS_SQL}, best AS (SELECT sheet_id, max(saved) FILTER (NOT unavailable) AS best FROM matrix GROUP BY sheet_id)
  SELECT b.sheet_id, coalesce(list_sort(list(m.way) FILTER (NOT m.unavailable AND m.saved = b.best AND b.best >= 0)), []) AS best_ways FROM best b JOIN matrix m USING (sheet_id) GROUP BY ALL""")
def best_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.best_ways(report.savings_matrix(_runs(spark, sf_dir)))


_OUTCOME_SQL = "SELECT CAST(floor(o_totalprice) AS BIGINT) AS before, o_custkey % 201 - 100 AS saved, o_orderkey % 5 AS n_applied, o_orderkey % 3 AS n_skipped, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey % 50 END AS withheld_growth FROM orders"


@query(f"""SELECT CAST(sum(before) AS BIGINT) AS before, count(*) FILTER (saved > 0) AS n_shrink, CAST(coalesce(sum(saved) FILTER (saved > 0), 0) AS BIGINT) AS shrunk, count(*) FILTER (saved < 0) AS n_grow,
  CAST(coalesce(-sum(saved) FILTER (saved < 0), 0) AS BIGINT) AS grown, CAST(sum(n_applied) AS BIGINT) AS n_applied, CAST(sum(n_skipped) AS BIGINT) AS n_skipped, count(withheld_growth) AS n_withheld, CAST(coalesce(sum(withheld_growth), 0) AS BIGINT) AS withheld_growth FROM ({_OUTCOME_SQL})""")
def outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    results = o.select(F.floor("o_totalprice").alias("before"), (F.col("o_custkey") % 201 - 100).alias("saved"), (F.col("o_orderkey") % 5).alias("n_applied"), (F.col("o_orderkey") % 3).alias("n_skipped"), F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") % 50).alias("withheld_growth"))
    return report.outcome_totals(results)


@query("""WITH a AS (SELECT l_suppkey AS sheet_id, l_returnflag AS scope, 'color: c' || (l_partkey % 20) AS key FROM lineitem),
  b AS (SELECT DISTINCT l_suppkey AS sheet_id, l_returnflag AS scope, 'color: c' || (l_partkey % 17) AS key FROM lineitem WHERE l_linestatus = 'F')
  SELECT a.sheet_id, a.scope, a.key, b.key IS NULL AS may_merge FROM (SELECT DISTINCT * FROM a) a LEFT JOIN b USING (sheet_id, scope, key)""")
def may_merge_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    keyed = lambda d, n: d.select(F.col("l_suppkey").alias("sheet_id"), F.col("l_returnflag").alias("scope"), F.concat(F.lit("color: c"), (F.col("l_partkey") % n).cast("string")).alias("key")).distinct()
    return report.may_merge(keyed(lines, 20), keyed(lines.where("l_linestatus = 'F'"), 17))


@query("WITH o AS (SELECT o_orderkey AS sheet_id, o_orderkey % 4 = o_custkey % 4 AS same FROM orders) SELECT sheet_id, CASE WHEN same THEN 1 ELSE 0 END AS extra, CAST(CASE WHEN same THEN 14 ELSE 0 END AS BIGINT) AS extra_saved, same AS differs FROM o")
def aggressive_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of two angles, in gradians and degrees: only the aggressive run tells equal ones."""
    o = _table(spark, sf_dir, "orders")
    grad, deg = ((k * (1 + F.col(c) % 4)).cast("string") for k, c in ((10, "o_orderkey"), (9, "o_custkey")))
    css = F.concat(F.lit(".a{rotate:"), grad, F.lit("grad}.b{rotate:"), deg, F.lit("deg}"))
    return report.preview(o.select(F.col("o_orderkey").alias("sheet_id"), css.alias("css")))


# -- scalar functions that columns can say


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_partkey % 4 < 3 THEN '0' WHEN p_size % 4 = 0 AND p_partkey % 4 = 3 THEN '0deg' ELSE (p_size % 4) || list_value('px', 'em', 'vmin', 'deg')[1 + p_partkey % 4] END AS value FROM part")
def normalize_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("px", "em", "vmin", "deg"))), (1 + F.col("p_partkey") % 4).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", E.zero_lengths(F.concat((F.col("p_size") % 4).cast("string"), unit)).alias("value"))


@query("SELECT p_partkey, ((p_partkey % 1000) * 1000 + p_size * 10) || 'ms' AS value FROM part")
def normalize_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("p_partkey") % 1000).cast("string"), F.lit("."), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("s"))
    return _table(spark, sf_dir, "part").select("p_partkey", E.milliseconds(text).alias("value"))


@query("SELECT p_partkey, CASE WHEN rtrim(lpad(CAST(p_size AS VARCHAR), 2, '0'), '0') = '' THEN CAST(p_partkey % 3 AS VARCHAR) ELSE CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey % 3 AS VARCHAR) END || '.' || rtrim(lpad(CAST(p_size AS VARCHAR), 2, '0'), '0') END AS value FROM part")
def normalize_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("p_partkey") % 3).cast("string"), F.lit("."), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("00"))
    return _table(spark, sf_dir, "part").select("p_partkey", E.decimals(text).alias("value"))


@query("SELECT p_partkey, '#' || regexp_replace(lower(lpad(hex(p_partkey % 4096), 3, '0')), '(.)', '\\1\\1', 'g') AS value FROM part")
def normalize_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("p_partkey") % 4096), 3, "0")))
    return _table(spark, sf_dir, "part").select("p_partkey", E.hex_color(text).alias("value"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '700' WHEN 1 THEN '400' ELSE 'bolder' END AS value FROM part")
def normalize_font_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(F.lit("bold"), F.lit("normal"), F.lit("bolder")), (1 + F.col("p_partkey") % 3).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", E.font_weights(F.lit("font-weight"), text).alias("value"))


@query("SELECT p_partkey, list_value('margin', '--Foo', 'overflow-wrap', 'gap')[1 + p_partkey % 4] AS prop FROM part")
def normalize_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, (" MARGIN\t", "--Foo", "Word-Wrap", "grid-gap"))), (1 + F.col("p_partkey") % 4).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", E.property_name(text, aggressive=True).alias("prop"))


@query("SELECT p_partkey, lower(p_brand) || ' (' || p_size || ',a)/b' AS value FROM part")
def normalize_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_brand", F.lit(" \t\n ( "), F.col("p_size").cast("string"), F.lit(" ,  a ) /  b"))
    return _table(spark, sf_dir, "part").select("p_partkey", E.folded(F.lit("width"), E.spaces(text)).alias("value"))


@query("SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ',') AS selector_key FROM part")
def selector_set_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", E.selector_key(F.split("p_name", " ")).alias("selector_key"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.a::-webkit-x' WHEN 1 THEN '* html .b' WHEN 2 THEN '.c' ELSE '.d::before' END AS selector FROM part WHERE p_partkey % 4 >= 2")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, (".a::-webkit-x", "* html .b", ".c", ".d::before"))), (1 + F.col("p_partkey") % 4).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", text.alias("selector")).where(E.eligible(F.array("selector"), DEFAULT_IGNORED))


# -- scans of pages and set operations


@query(r"SELECT page_id, CAST(tag_no - 1 AS INTEGER) AS tag_no, css FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style\s*>', 1)) AS css, generate_subscripts(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style\s*>', 1), 1) AS tag_no FROM pages)")
def style_tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tags(_table(spark, sf_dir, "pages"))


def _page_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tags(_table(spark, sf_dir, "pages")).groupBy(F.col("page_id").alias("sheet_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("tag_no", "css")))["css"], "\n").alias("css"))


_STYLE_SQL = r"""styles AS (SELECT page_id, regexp_extract(html, '<style>([^{}]*)\{([^:]*):([^}]*)\}</style>', ['sel', 'prop', 'val']) AS s FROM pages)"""


@query(f"WITH {_STYLE_SQL} SELECT page_id AS sheet_id, s.sel AS rule_selector, s.prop AS prop, s.val AS value, s.prop || ': ' || s.val AS decl_key, 1 AS line, 'root' AS scope_key FROM styles WHERE s.sel <> ''")
def inline_style_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declarations(nodes(_page_sheets(spark, sf_dir))).select("sheet_id", "rule_selector", "prop", "value", "decl_key", "line", "scope_key")


@query(f"WITH {_STYLE_SQL} SELECT page_id AS sheet_id, s.sel || ',.p' || page_id || '{{' || s.prop || ':' || s.val || '}}.q{{order:' || length(url) || '}}' AS css_out, 1 AS n_applied, 0 AS n_skipped, CAST(length(s.prop || s.val) + 4 AS BIGINT) AS saved FROM styles JOIN pages USING (page_id) WHERE s.sel <> ''")
def consolidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style of each page with rules of its own behind it: one says the same in other words."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("sheet_id"), F.length("url").cast("string").alias("order"))
    own = F.concat(F.lit(".p"), F.col("sheet_id").cast("string"), F.lit("{margin:0PX}.q{order:"), F.col("order"), F.lit("}"))
    sheets = _page_sheets(spark, sf_dir).join(pages, "sheet_id").select("sheet_id", F.concat("css", own).alias("css"))
    r = dedup(sheets)
    return r.select("sheet_id", "css_out", F.size("applied").alias("n_applied"), F.size("skipped").alias("n_skipped"), F.col("bytes.saved").alias("saved"))


def synthetic_sheets(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The declaration view as texts: one sheet per sheet and scope, rules in order; or whole ones,
    whose scopes are media blocks."""
    d = declaration_view(spark, sf_dir)
    rule = d.groupBy("sheet_id", "scope_key", "rule_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("decl_pos", "decl_key"))), lambda x: F.concat(F.lit("  "), x["decl_key"], F.lit(";\n"))), "").alias("body"))
    text = F.format_string(".r%d {\n%s}\n", "rule_pos", "body")
    blocks = rule.groupBy("sheet_id", "scope_key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rule_pos", text.alias("text"))))["text"], "\n").alias("css"))
    if whole:
        block = F.format_string("@media %s {\n%s}\n", "scope_key", "css")
        return blocks.groupBy("sheet_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("scope_key", block.alias("text"))))["text"], "\n").alias("css"))
    return blocks.select(F.xxhash64("sheet_id", "scope_key").alias("sheet_id"), "css")


@query(None)
def consolidate_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = dedup(synthetic_sheets(spark, sf_dir))
    return r.select("sheet_id", F.size("applied").alias("n_applied"), F.size("skipped").alias("n_skipped"), F.col("bytes.before").alias("before"), F.col("bytes.saved").alias("saved"))


@query(f"""WITH {_DECLS_SQL}, {_GROUPS_SQL}, found AS (
    SELECT sheet_id, 'duplicate' AS kind, scope_key, decl_key, first_pos, last_pos, n_rules AS n FROM groups
    UNION ALL SELECT sheet_id, 'redundant', scope_key, decl_key, rule_id, rule_id, 1 FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, scope_key, rule_id, decl_key ORDER BY decl_pos) AS nth FROM decls) WHERE nth > 1)
  SELECT sheet_id, kind, '@media ' || scope_key AS scope, CASE WHEN decl_key = 'border-top: 0px' THEN 'border-top: none' ELSE replace(decl_key, ' 0px', ' 0') END AS key,
    '.r' || first_pos AS first_selector, '.r' || last_pos AS last_selector, n FROM found""")
def findings_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written, parsed and analyzed again: the findings that the view has."""
    found = detect.analyze(synthetic_sheets(spark, sf_dir, whole=True))
    end = lambda k: F.element_at("occurrences", k)["selector"]
    return found.select("sheet_id", "kind", "scope", "key", end(1).alias("first_selector"), end(-1).alias("last_selector"), F.size("occurrences").cast("long").alias("n"))


@query("SELECT DISTINCT path FROM (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS path FROM pages) WHERE NOT regexp_matches(path, '(?i)^M\\.|\\.net$')")
def path_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths once, without those that match a pattern."""
    from ..sources.sheets import path_ignored

    paths = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("path")).distinct()
    return paths.where(~path_ignored(F.col("path"), (r"(?i)^M\.", r"(?i)\.net$")))


@query("SELECT '/css/' || p_partkey || '.css' AS path FROM part EXCEPT SELECT '/css/' || p_partkey || '.css' FROM part WHERE p_partkey % 10 = 3 OR p_size = 7")
def except_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of which some are listed twice, some are excluded by a pattern, some by their names."""
    from ..sources.sheets import path_ignored

    path = F.concat(F.lit("/css/"), F.col("p_partkey").cast("string"), F.lit(".css"))
    paths = _table(spark, sf_dir, "part").select(path.alias("path"), "p_size")
    twice = paths.union(paths.where("p_size > 25")).where(~path_ignored(F.col("path"), (r"(^|\D|\d)3\.css$",)))
    return twice.select("path").distinct().join(paths.where("p_size = 7").select("path"), "path", "left_anti")


# -- functions with grammar, over values and selectors made from whole tables

@query("""WITH v AS (SELECT p_partkey, p_size, p_partkey % 8 AS k, p_partkey % 256 AS r, p_size * 5 % 256 AS g, (p_partkey * 7) % 256 AS b FROM part)
  SELECT p_partkey, CASE k WHEN 0 THEN '#' || lower(lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0'))
    WHEN 1 THEN p_size || 'px' || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' 0' END WHEN 2 THEN (p_size * 1250) || 'ms'
    WHEN 3 THEN 'max(' || least(p_size || 'px', r || 'px') || ',' || greatest(p_size || 'px', r || 'px') || ')' WHEN 4 THEN 'var(--X' || r || ')'
    WHEN 5 THEN CASE WHEN p_size % 2 = 0 THEN '700' ELSE '400' END WHEN 6 THEN (9 * p_size) || 'deg' ELSE p_size || ',' || r END AS value FROM v""")
def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours, boxes, times, nested functions, names, weights and angles, aggressively."""
    part = _table(spark, sf_dir, "part")
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    r, g, b = (x.cast("string") for x in (n % 256, F.col("p_size") * 5 % 256, n * 7 % 256))
    even = F.col("p_size") % 2 == 0
    made = [
        ("color", F.concat_ws("", F.lit("RGB( "), r, F.lit(" , "), g, F.lit(", "), b, F.lit(" )"))),
        ("margin", F.concat_ws("", size, F.lit("px  "), F.when(even, F.concat(size, F.lit("px"))).otherwise(F.lit("0.0em")))),
        ("transition-delay", F.concat((F.col("p_size") * 125 / 100).cast("decimal(20,4)").cast("string"), F.lit("S"))),
        ("width", F.concat_ws("", F.lit("MAX("), r, F.lit("px , "), size, F.lit("px)"))),
        ("top", F.concat_ws("", F.lit("var( --X"), r, F.lit(" )"))),
        ("font-weight", F.when(even, F.lit("Bold")).otherwise(F.lit("NORMAL"))),
        ("rotate", F.concat((F.col("p_size") * 10).cast("string"), F.lit("GRAD"))),
        ("--list", F.concat_ws("", F.lit("  "), size, F.lit(","), r, F.lit(" "))),
    ]
    prop, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (p, v) in enumerate(made):
        prop, value = F.when(n % 8 == k, F.lit(p)).otherwise(prop), F.when(n % 8 == k, v).otherwise(value)
    return part.select("p_partkey", U.normalized_value(prop, value, aggressive=True).alias("value"))


@query("""SELECT p_partkey, ['.' || replace(p_brand, '#', '-') || ':is(.a, .b)', '[t="' || p_type || ', x"]', '#k' || p_size || '/* , */'] AS selectors,
  array_to_string(list_sort(['.' || replace(p_brand, '#', '-') || ':is(.a, .b)', '[t="' || p_type || ', x"]', '#k' || p_size || '/* , */']), ',') AS key, p_partkey % 2 = 0 AS spaced FROM part""")
def selector_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with commas in brackets, strings and comments."""
    comma = F.when(F.col("p_partkey") % 2 == 0, F.lit(", ")).otherwise(F.lit(","))
    text = F.concat(F.lit("."), F.translate("p_brand", "#", "-"), F.lit(":is(.a, .b)"), comma, F.lit('[t="'), F.col("p_type"), F.lit(', x"]'), F.lit(" ,#k"), F.col("p_size").cast("string"), F.lit("/* , */"))
    return _table(spark, sf_dir, "part").select("p_partkey", U.split_selectors(text).alias("selectors"), U.selector_list_key(text).alias("key"), U.spaced_comma(text).alias("spaced"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey % 5 <> l_suppkey % 5 AND l_linenumber % 4 IN (0, 1) AS exclusive, l_linenumber % 3 = 1 AND l_partkey % 5 <> l_suppkey % 5 AS disjoint,
  CASE l_linenumber % 3 WHEN 0 THEN ['x'] WHEN 1 THEN ['c' || (l_partkey % 5)] ELSE ['c' || (l_partkey % 5), 'x'] END AS classes FROM lineitem""")
def selector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs by attributes that bind their element or do not, likelihood by classes."""
    n, p, q = (F.col(c).cast("string") if c == "x" else F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey"))

    def attribute(k: Column) -> Column:
        value = F.concat(F.lit("[data-k='v"), (k % 5).cast("string"), F.lit("']"))
        return F.when(n % 4 == 0, F.concat(value, F.lit(" > i"))).when(n % 4 == 1, F.concat(F.lit("html"), value, F.lit(" p i"))).when(n % 4 == 2, F.concat(value, F.lit(" ~ i"))).otherwise(F.concat(F.lit("i:not("), value, F.lit(")")))

    def classes(k: Column) -> Column:
        own = F.concat(F.lit(".c"), (k % 5).cast("string"))
        return F.when(n % 3 == 0, F.lit("b .x")).when(n % 3 == 1, F.concat(F.lit("a > "), own, F.lit(":hover"))).otherwise(F.concat(own, F.lit(".x")))

    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", U.mutually_exclusive(attribute(p), attribute(q)).alias("exclusive"), U.likely_disjoint(classes(p), classes(q)).alias("disjoint"), U.subject(classes(p))["classes"].alias("classes"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 7 AS a, o_custkey % 7 AS b FROM orders)
  SELECT k AS sheet_id, CASE WHEN a = b THEN '.x, .y { left: ' || a || 'px; }' || chr(10) ELSE '.x { left: ' || a || 'px; }' || chr(10) || '.y { left: ' || b || 'px; }' || chr(10) END
    || '.z { order: 1; top: ' || b || 'px; }' || chr(10) AS css_out,
    CASE WHEN a = b THEN 1 ELSE 0 END AS n_applied FROM r""")
def consolidate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet an order: two rules that are one where their values agree, and one with others."""
    o = _table(spark, sf_dir, "orders")
    a, b = ((F.col(c) % 7).cast("string") for c in ("o_orderkey", "o_custkey"))
    css = F.concat(F.lit(".x { left: "), a, F.lit("PX; }\n.y { left: "), b, F.lit("px; }\n.z { order: 1; top: "), b, F.lit("px; }\n"))
    r = dedup(o.select(F.col("o_orderkey").alias("sheet_id"), css.alias("css")))
    return r.select("sheet_id", F.regexp_replace("css_out", "PX", "px").alias("css_out"), F.size("applied").alias("n_applied"))


@query("SELECT p_partkey, '[\"@media ' || p_brand || '\", \".a b\"]' AS scope_key, '@media ' || p_brand || ' > .a b' AS scope_label FROM part")
def scope_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and label of the chain of blocks around a declaration, as parsing tells them."""
    css = F.concat(F.lit("@media  "), F.col("p_brand"), F.lit("\n{ .a   b { & c { top: 0 } } }"))
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sheet_id"), css.alias("css"))
    return declarations(nodes(part)).select(F.col("sheet_id").alias("p_partkey"), "scope_key", "scope_label")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size || ' ' || p_size || 'px (' || p_size || ',.5)' ELSE 'a+' || p_size || ' +b' END AS value FROM part")
def normalize_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plus goes before a number at the beginning of a part, and stays elsewhere."""
    n = F.col("p_size").cast("string")
    signed = F.concat_ws("", F.lit("+"), n, F.lit(" +"), n, F.lit("px (+"), n, F.lit(",+.5)"))
    text = F.when(F.col("p_partkey") % 2 == 0, signed).otherwise(F.concat_ws("", F.lit("a+"), n, F.lit(" +b")))
    return _table(spark, sf_dir, "part").select("p_partkey", E.plus_signs(text).alias("value"))


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet an order of two rules with one declaration in common, which gets a rule of its own:
    that saves ten bytes and costs both selectors once more, one of them of varying length."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sheet_id"), (F.col("o_custkey") % 30).cast("int").alias("w"))
    return o.select("sheet_id", "w", F.concat(F.lit(".x"), F.repeat(F.lit("y"), "w"), F.lit("{order:1;left:0}.z{order:1;top:0}")).alias("css"))


@query("""WITH g AS (SELECT o_orderkey, CAST(o_custkey % 30 AS BIGINT) AS w FROM orders), d AS (SELECT *, w + 35 AS before, 2 - w AS saved FROM g)
  SELECT o_orderkey AS sheet_id, before, CASE WHEN saved < 0 THEN 0 ELSE saved END AS saved, saved < 0 AS withheld FROM d""")
def savings_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidation is withheld where it would make a sheet bigger."""
    r = dedup(_grown(spark, sf_dir).select("sheet_id", "css"), Options(savings_only=True))
    return r.select("sheet_id", F.col("bytes.before").alias("before"), F.col("bytes.saved").alias("saved"), F.col("withheld").isNotNull().alias("withheld"))


@query("SELECT o_orderkey AS sheet_id, '@font-face' AS scope, 'src: a' || (o_custkey % 9) AS key, 2 AS n FROM orders WHERE o_custkey % 9 = o_orderkey % 9")
def at_rule_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations that a block without selector has twice."""
    o = _table(spark, sf_dir, "orders")
    a, b = ((F.col(c) % 9).cast("string") for c in ("o_custkey", "o_orderkey"))
    css = F.concat(F.lit("@font-face { src: a"), a, F.lit("; src: a"), b, F.lit("; }"))
    found = detect.analyze(o.select(F.col("o_orderkey").alias("sheet_id"), css.alias("css")), kinds=("redundant",))
    return found.select("sheet_id", "scope", "key", (F.size("occurrences") + 1).alias("n"))
