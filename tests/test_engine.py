import duckdb
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from sheetloom.operators.consolidate import changes, dedup
from sheetloom.operators.detect import analyze
from sheetloom.operators.report import report, warnings
from sheetloom.functions.scopes import scopes
from sheetloom.functions.tree import parse
from sheetloom.operators import safety, tables
from sheetloom.operators.rewrite import Consolidation
from sheetloom.plans.api import analyze_css, dedup_stage
from sheetloom.plans.options import Options
from sheetloom.plans.queries import ORACLE_SQL, QUERIES
from sheetloom.sources import sheets as S

from .conftest import SMALL

BASIC = ".a { color: RED; }\n.b { color: red; }\n.c { margin: 0px; }\n.d { margin: 0; margin: 0; }\n@font-face { src: x; src: x; }\n.a { top: 0; }\n"


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    r = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(r.columns)
    ours = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    at = [r.columns.index(c) for c in columns]
    assert ours == sorted((tuple(plain(row[k]) for k in at) for row in r.fetchall()), key=repr)


def test_rows_only_queries(spark):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, SMALL).count() > 0


SAFETY = [
    "html[lang='da'] a{color:red}html[lang='de'] a{color:blue}html[lang='da'] a{top:0}html[lang='da'] a{color:red}",
    ".a{color:red}.b{color:blue}.c{color:red}.d{color:red}",
    ".a{color:red}@media print{.b{color:blue}}.c{color:red}",
    ".a{color:red}@media print{a{x:0}@font-face{color:blue}}@keyframes k{from{color:blue}}.c{color:red}",
    ".a{margin:0;&:hover{margin-left:1px}}.b{margin:0}",
    "@media print{.a{top:0}.b{left:0}.c{top:0}}.d{top:1px}@media print{.e{top:0}}",
    "@media print{.a{top:0}i[x='1']{top:1px}.a{top:0}.b{top:0}}",
]


@pytest.mark.parametrize("options", [Options(), Options(fence="scope"), Options(aggressive=True)])
def test_safety_is_that_of_rewrite(spark, options):
    # the tables compare blocks of one condition together, the rewriter only with aggressive
    held = [(k, css) for k, css in enumerate(SAFETY) if options.aggressive or css.count("@media") < 2]
    decls = tables.declarations(tables.nodes(spark.createDataFrame(held, "sheet_id long, css string"), options), options).cache()
    over = safety.overlap_table(spark)
    fenced = {(r.sheet_id, r.scope_key, r.decl_key): r for r in safety.fences(decls, over, options).collect()}
    nearest = {(r.sheet_id, r.scope_key, r.decl_key): r.prop_norm for r in safety.blockers(decls, over, options).collect()}
    parts = sorted((r.sheet_id, r.scope_key, r.decl_key, r.run_no, r.n_rules) for r in safety.runs(decls, over, options).collect())
    assert {k for k, r in fenced.items() if r.fenced} == set(nearest)
    expected, theirs, split = set(), {}, []
    for sheet_id, css in held:
        c = Consolidation(parse(css), options)
        for scope in scopes(c.root, options.aggressive):
            for g in c.groups(scope):
                key = (sheet_id, scope.key, g.key)
                expected.add(key)
                hit = c.blocker(scope, g.rules, set(g.rules), g.rules[0], g.rules[-1], g.prop)
                theirs |= {key: hit[1]} if hit else {}
                split += [(*key, k + 1, len(run)) for k, run in enumerate(c.runs(scope, g, g.rules, set(g.rules)))]
    assert expected == set(fenced) and theirs == nearest and sorted(split) == parts


def test_findings_in_order(spark):
    found = analyze_css(spark, BASIC)
    assert [(f["kind"], f["scope"], f["key"]) for f in found] == [
        ("redundant", "root", "margin: 0"),
        ("duplicate", "root", "color: #ff0000"),
        ("duplicate", "root", "margin: 0"),
        ("repeated", "root", ".a"),
        ("redundant", "@font-face", "src: x"),
    ]
    assert [o["line"] for o in found[1]["occurrences"]] == [1, 2]


def test_scopes_and_errors(spark):
    css = "@media print { .a { top: 0 } }\n@media print { .b { top: 0 } }\n@layer { .x { top: 0 } }\n@layer { .y { top: 0 } }\n.h { &:hover { top: 0 } &:focus { top: 0 } }"
    df = spark.createDataFrame([(1, css), (2, "a{"), (3, None), (4, "")], "sheet_id long, css string")
    n = tables.nodes(df)
    assert [(r.sheet_id, r.line, r.col) for r in tables.parse_errors(n).collect()] == [(2, 1, 1)]
    assert {r.scope_label for r in tables.scopes(n).collect()} == {"root", "@media print", "@layer (anonymous 1)", "@layer (anonymous 2)", ".h"}
    assert sorted((f.scope, f.key) for f in analyze(df).collect()) == [(".h", "top: 0"), ("@media print", "top: 0")]
    assert sorted((r.sheet_id, r.error is None) for r in dedup(df).collect()) == [(1, True), (2, False), (3, True), (4, True)]


def test_partitions_do_not_matter(spark):
    rows = [(k, f".a {{ top: {k % 3}px; }}\n.b {{ top: {k % 3}px; }}\n.c {{ left: {k % 2}px; top: 9px; }}\n") for k in range(40)]
    df = spark.createDataFrame(rows, "sheet_id long, css string")
    one, many = ([tuple(r) for r in dedup(df.repartition(n)).select("sheet_id", "css_out").orderBy("sheet_id").collect()] for n in (1, 7))
    assert one == many
    one, many = (sorted(map(str, analyze(df.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_report_changes_and_stage(spark):
    df = spark.createDataFrame([(0, BASIC), (1, ".x { top: 0 }"), (2, ".a{rotate:90deg}.b{rotate:100grad}")], "sheet_id long, css string")
    rows = {r.sheet_id: r for r in report(df).collect()}
    assert rows[1].n_default == 0 and rows[1].default.unavailable and rows[0].default.saved > 0
    assert (rows[2].n_default, rows[2].n_aggressive) == (0, 1) and rows[2].default.unavailable and not rows[2].aggressive.unavailable
    assert changes(dedup(df)).where("status = 'applied'").count() >= 4
    told = {r.sheet_id: r.warnings for r in df.transform(dedup_stage()).collect()}
    assert told[1] == [] and any(w.startswith("Duplicate declaration `color: #ff0000` also in `.a`") for w in told[0])
    fixed = {r.sheet_id: r.css for r in df.transform(dedup_stage(fix=True)).collect()}
    assert ".a, .b { color:" in fixed[0] and fixed[1] == ".x { top: 0 }"
    assert warnings(analyze(df)).count() == analyze(df).count()


def test_folder_source(spark, tmp_path):
    for name, text in (("b.css", ".a{top:0}"), ("sub/A.CSS", ".b{top:0}"), ("node_modules/x.css", "x{}"), (".dot/y.css", "y{}"), ("c.txt", "z")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.css").write_bytes(b"\xff\xfe")
    rows = S.read_folder(spark, str(tmp_path)).orderBy("sheet_id").collect()
    assert [os.path.basename(r.path) for r in rows] == ["b.css", "bad.css", "A.CSS"]
    assert rows[1].error and rows[0].css == ".a{top:0}"
    t = S.expand_targets([str(tmp_path), str(tmp_path / "b.css")], ("sub",))
    assert [os.path.basename(f) for f in t.files] == ["b.css", "bad.css"] and t.discovered == 3
    results = dedup(S.read_folder(spark, str(tmp_path)).where("error IS NULL")).join(S.read_folder(spark, str(tmp_path)).select("sheet_id", "path"), "sheet_id")
    S.write_sheets(results, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_stream(spark, tmp_path):
    from sheetloom.streaming.sheets import consolidate_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.css").write_text(".a { top: 0; }\n.b { top: 0; }\n")
    consolidate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert row.css_out == ".a, .b { top: 0; }\n"


def test_options():
    assert len(Options().ignored) == 3 and Options(ignore_selectors=("x",), ignore_selectors_defaults=False).ignored == ("x",)
    with pytest.raises(ValueError):
        Options(fence="no")


def test_columns_spell_numbers_as_python_does(spark):
    from sheetloom.functions import expressions as E
    from sheetloom.functions.values import same_decimals, same_units

    rng = random.Random(1)
    wholes, parts = ["", "0", "00", "7", "05", "1234567890123456789012"], ["", ".", ".0", ".5", ".50", ".1234567890123456", ".00000", ".001", "." + "9" * 30]
    made = sorted({rng.choice(["", "-", "+"]) + rng.choice(wholes) + rng.choice(parts) + rng.choice(["s", "px", "%", " 1.0", ""]) for _ in range(2000)})
    for r in spark.createDataFrame([(t,) for t in made], "t string").select("t", E.milliseconds(F.col("t")).alias("ms"), E.decimals(F.col("t")).alias("d")).collect():
        assert r.d == same_decimals(r.t)
        if r.t.endswith("s"):
            assert r.ms == same_decimals(same_units(r.t, False))
