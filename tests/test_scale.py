"""What keeps memory, shuffles and time of a query in proportion to its input."""


import gc
import re

from pyspark.sql import functions as F

from sheetloom.functions import selectors, tree
from sheetloom.functions.tree import Node, parse
from sheetloom.operators import consolidate, detect, safety, tables
from sheetloom.operators.report import preview
from sheetloom.plans.options import Options
from sheetloom.plans.queries import QUERIES, declaration_view

from .conftest import SMALL

TEXTS = [".a{top:0}.b{top:0px}", "", None, "a{", ".a{rotate:90deg}.b{rotate:100grad}", ".a{top:0}" + ".b{left:0}" * 400, "@media  x{.a{top:0;top:0}}"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def sheets(spark, n=300):
    return spark.createDataFrame([(k, TEXTS[k % len(TEXTS)]) for k in range(n)], "sheet_id long, css string")


def calls(monkeypatch, module, name):
    """The calls of a module's function in this process."""
    seen, f = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a: seen.append(a) or f(*a))
    return seen


def test_preview_joins_nothing(spark):
    assert "Join" not in plan(QUERIES["aggressive_preview"](spark, SMALL))
    got = {r.sheet_id: (r.extra, r.extra_saved, r.differs) for r in preview(sheets(spark)).collect()}
    assert len(got) == sum(TEXTS[k % len(TEXTS)] != "a{" for k in range(300))
    for k, told in got.items():
        plain, more = (consolidate._row(TEXTS[k % len(TEXTS)] or "", Options(aggressive=a), True) for a in (False, True))
        assert told == (len(more["applied"]) - len(plain["applied"]), more["bytes"]["saved"] - plain["bytes"]["saved"], more["css_out"] != plain["css_out"])
    assert got[4][0] == 1 and got[4][2] and not got[0][2]


def test_equal_sheets_are_worked_out_once(spark):
    def rows(css, made=[]):  # noqa: B006 - counts the calls of a worker
        made.append(css)
        return [{"n": len(made)}] * (2 if css else 1)

    got = tables.per_sheet(sheets(spark, 70_000).coalesce(1), rows, "sheet_id long, n int").collect()
    assert len(got) == 20_000 + 50_000 * 2  # null and the empty text have one row
    assert max(r.n for r in got) <= len(TEXTS) + 140_000 // tables.BATCH_ROWS * 2


def test_dedup_of_equal_sheets(spark):
    for options in (Options(), Options(savings_only=True)):
        for r in consolidate.dedup(sheets(spark), options).collect():
            told = consolidate._row(TEXTS[r.sheet_id % len(TEXTS)] or "", options, True)
            assert (r.css_out, r.error) == (told.get("css_out"), told.get("error"))
            assert [c.key for c in r.applied or ()] == [c["key"] for c in told.get("applied", ())]


def test_nodes_of_equal_sheets(spark):
    got = {}
    for r in tables.nodes(sheets(spark)).orderBy("sheet_id", "node_id").collect():
        got.setdefault(r.sheet_id, []).append(r)
    for k in range(300):
        told = tables.node_rows(TEXTS[k % len(TEXTS)] or "", False)
        assert [(r.node_id, r.kind, r.decl_key, r.selectors, r.scope_key) for r in got.get(k, [])] == [(t["node_id"], t["kind"], t.get("decl_key"), t.get("selectors"), t.get("scope_key")) for t in told]


def one_exchange(df):
    told = plan(df)
    return told.count("RepartitionByExpression") == 1 and not any(x in told for x in ("Window", "Join", "Aggregate"))


def test_blocked_groups_deals_out_once(spark, monkeypatch):
    assert one_exchange(QUERIES["blocked_groups"](spark, SMALL))
    monkeypatch.setattr(tables, "DEALT_BYTES", 1 << 10)
    assert QUERIES["blocked_groups"](spark, SMALL).rdd.getNumPartitions() > 50


def test_safe_runs_deals_out_once(spark):
    assert one_exchange(QUERIES["safe_runs"](spark, SMALL))


def test_group_blockers_deals_out_once(spark):
    assert one_exchange(QUERIES["group_blockers"](spark, SMALL))


def test_scopes_are_cut_nowhere(spark):
    decls = declaration_view(spark, SMALL).withColumn("scope_key", F.lit("one"))
    over = safety.overlap_table(spark)
    told = []
    try:
        for n in ("10000", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            told.append([sorted(map(tuple, f(decls, over).collect())) for f in (safety.fences, safety.runs, safety.blockers)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert told[0] == told[1] and all(told[0])


def test_conventions_hold_one_tree(spark, monkeypatch):
    held = []
    monkeypatch.setattr(consolidate, "per_sheet", lambda sheets, rows_of, ddl: held.append(rows_of))
    consolidate.conventions(None)
    assert held[0](".a,.b{top:0}\n\n.c{top:0}") == [{"comma": ",", "one_a_line": False, "gap": "\n\n"}]
    gc.collect()
    before = sum(isinstance(x, Node) for x in gc.get_objects())
    for _ in range(20):
        held[0](".a, .b{top:0}\n" * 200)
    gc.collect()
    assert sum(isinstance(x, Node) for x in gc.get_objects()) == before


ODD = [
    *(t for t in TEXTS if t),
    ".a { color: RED; }\n.b { color: red; }\n.c { margin: 0px; }\n.d { margin: 0; margin: 0; }\n@font-face { src: x; src: x; }\n.a { top: 0; }\n",
    "@media print { .a { top: 0 } }\n.x{top:0}@media  print { .b { top: 0 } .a { top:0;top:0px } } @layer { .x { top: 0 } }\n@layer { .y { top: 0 } .x,.y{} .y , .x{left:0;left:0} }",
    ".h { top:0; &:hover { top: 0 } top: 0; &:focus { top: 0; @media print { top: 0; top: 0 } } &:hover{} }",
    "﻿.a::-webkit-x{top:0;top:0}.a::-webkit-x{top:0}.b{top:0 !important;--X:1;--X:1}.c{TOP:0!important;rotate:90deg;rotate:100grad}",
    "@page { margin: 0; @top-left { content: 'a'; content: 'a' } margin: 0 } /* ; */ .b[x=';']{left:0;;left:0}",
    ".b{top:0}" * 3 + ".c{--a:{b:c};--a:{b:c}}" * 2,
]


def test_findings_of_a_sheet_are_those_of_its_nodes(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "sheet_id long, css string")
    for options in (Options(), Options(aggressive=True), Options(ignore_selectors=("b",))):
        told = [sorted(map(str, f.collect())) for f in (detect.analyze(df, options), detect.findings(tables.nodes(df, options), options))]
        assert told[0] == told[1] and len(told[0]) > 15
    assert detect.analyze(df, kinds=("redundant",)).count() == detect.analyze(df).where("kind = 'redundant'").count() > 0
    assert not any(x in plan(QUERIES["findings_synthetic"](spark, SMALL)) for x in ("Window", "Join", "InMemoryRelation"))


def test_plain_text_is_read_as_any_other(monkeypatch):
    made = [*(t for t in ODD if t != "a{"), "a\n{\nb:c\n;\n\n--x:{;};d:url(;)}", ".a:hover>b{}", "*{*zoom:1}@import url(x);@media  x  {a{b:c}}"]
    texts = ["*", ".a", "a>b", "a:not", "a.b#c+d~e", "-x", "..", "é", "a b", "a,b", "a ", "[x]", "a/**/b"]
    fast = [(n.kind, n.text, n.name, n.between, n.line, n.column) for t in made for n in parse(t).walk()], [selectors._list.__wrapped__(t) for t in texts]
    monkeypatch.setattr(tree, "_SIMPLE", re.compile("(?!)"))
    monkeypatch.setattr(selectors, "_PLAIN", re.compile("(?!)"))
    slow = [(n.kind, n.text, n.name, n.between, n.line, n.column) for t in made for n in parse(t).walk()], [selectors._list.__wrapped__(t) for t in texts]
    assert fast == slow


def test_source_order_sends_rules_alone(spark):
    assert {r["kind"] for r in tables.node_rows(ODD[5], False, ("rule",))} == {"rule"}
    df = spark.createDataFrame(list(enumerate(ODD)), "sheet_id long, css string")
    told = [sorted(map(str, tables.rules(tables.nodes(df, kinds=k)).collect())) for k in ((), ("rule",))]
    assert told[0] == told[1] and told[0]
