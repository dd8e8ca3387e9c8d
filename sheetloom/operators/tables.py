"""Sheets as relational tables: nodes, and from them scopes, rules and declarations.

Parsing is one Arrow stage without a shuffle: a sheet is a row. It also writes what every node
stands in (rule, scope, physical block), so that later operators filter and group and never join a
tree with itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.expressions import eligible
from ..functions.properties import one_name
from ..functions.scopes import at_rule_label, containers, scope_names
from ..functions.selectors import list_key, split_list
from ..functions.tree import CssError, Node, parse
from ..functions.values import declaration_key
from ..plans.options import Options

#: One row per node; sheets that cannot be read have one row of kind "error".
NODES = """sheet_id long, node_id int, parent_id int, seq int, depth int, kind string, name string, params string,
selector string, selectors array<string>, prop string, value string, important boolean, line int, col int, text string,
raw_before string, raw_between string, container_id int, scope_key string, scope_label string, rule_kind string,
rule_selector string, rule_selectors array<string>, rule_line int, rule_col int, selector_key string, prop_norm string,
decl_key string, error string"""


_key = lru_cache(1 << 16)(declaration_key)


def node_rows(css: str, aggressive: bool, kinds: tuple[str, ...] = ()) -> list[dict]:
    """The rows of one sheet's nodes, in document order; one of kind "error" for a sheet that does
    not parse, or that anything else goes wrong with. Other kinds than asked for are left out."""
    try:
        return list(_node_rows(parse(css), aggressive, kinds))
    except CssError as e:
        return [{"node_id": 0, "kind": "error", "line": e.line, "col": e.column, "error": e.reason}]
    except Exception as e:  # one sheet never fails the others
        return [{"node_id": 0, "kind": "error", "error": f"{type(e).__name__}: {e}"}]


def _node_rows(root: Node, aggressive: bool, kinds: tuple[str, ...]) -> Iterator[dict]:
    names = {node: scope_names(chain) for node, chain in containers(root)}
    number: dict[Node, int] = {root: 0}
    depth: dict[Node, int] = {root: 0}
    for n in root.walk():
        block = n.parent
        number[n], depth[n] = len(number), depth[block] + 1
        if kinds and n.kind not in kinds:
            continue
        key, label = names[block]
        row = {"node_id": number[n], "parent_id": number[block], "seq": number[n], "depth": depth[n], "kind": n.kind, "line": n.line, "col": n.column, "raw_before": n.before, "raw_between": n.between, "container_id": number[block], "scope_key": key, "scope_label": label}
        if n.kind == "rule":
            row |= {"selector": n.text, "selectors": split_list(n.text), "selector_key": list_key(n.text)}
        elif n.kind == "atrule":
            row |= {"name": n.name, "params": n.text.strip()}
        elif n.kind == "comment":
            row |= {"text": n.text.strip()}
        else:
            in_rule = block.kind == "rule"
            selector = block.text if in_rule else at_rule_label(block)
            if in_rule:  # a declaration's scope is its rule's
                row |= dict(zip(("scope_key", "scope_label"), names[block.parent], strict=True)) | {"container_id": number[block.parent]}
            row |= {
                "prop": n.name, "value": n.text, "important": n.important, "rule_kind": block.kind, "rule_selector": selector,
                "rule_selectors": split_list(selector) if in_rule else [selector], "rule_line": block.line, "rule_col": block.column,
                "prop_norm": one_name(n.name, aggressive), "decl_key": _key(n.name, n.text, n.important, aggressive),
            }
        yield row


#: Texts of up to so many characters are remembered over batches, so many of them; longer ones, and
#: all the others, within a batch of results.
REMEMBERED, REMEMBERED_CHARS = 256, 1000
#: A batch of results has about so many rows, made of texts of about so many characters, at most.
BATCH_ROWS, BATCH_CHARS = 20_000, 4 << 20


def per_sheet(sheets: DataFrame, rows_of: Callable[[str], list[dict]], ddl: str) -> DataFrame:
    """sheets (sheet_id, css) to rows_of(css) of each, in one Arrow stage; ddl is sheet_id and the
    columns that rows_of tells. Sheets of equal text, which a corpus has many of, are worked out
    once for a batch of results, and their rows repeated in Arrow."""
    arrow = arrow_schema(ddl)
    told = pa.schema([f for f in arrow if f.name != "sheet_id"])

    def batch_of(ids: list[int], at: list[int], made: list[dict]) -> pa.RecordBatch:
        rows = pa.RecordBatch.from_pylist(made, schema=told)
        if len(at) != len(made):
            rows = rows.take(pa.array(at, pa.int32()))
        columns = dict(zip(told.names, rows.columns, strict=True)) | {"sheet_id": pa.array(ids, pa.int64())}
        return pa.RecordBatch.from_arrays([columns[name] for name in arrow.names], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(REMEMBERED)(rows_of)
        for batch in batches:
            ids, at, made, places, chars = [], [], [], {}, 0
            for sheet_id, text in zip(batch.column("sheet_id"), batch.column("css"), strict=True):
                css = text.as_py() or ""
                if (place := places.get(css)) is None:
                    rows = known(css) if len(css) <= REMEMBERED_CHARS else rows_of(css)
                    place = places[css] = range(len(made), len(made) + len(rows))
                    made += rows
                ids += [sheet_id.as_py()] * len(place)
                at += place
                chars += len(css)
                if len(at) > BATCH_ROWS or chars > BATCH_CHARS:
                    yield batch_of(ids, at, made)
                    ids, at, made, places, chars = [], [], [], {}, 0
            yield batch_of(ids, at, made)

    return sheets.select(F.col("sheet_id").cast("long").alias("sheet_id"), F.col("css").cast("string").alias("css")).mapInArrow(run, ddl)


def nodes(sheets: DataFrame, options: Options = Options(), kinds: tuple[str, ...] = ()) -> DataFrame:
    """sheets (sheet_id, css) to NODES; of some kinds alone (and errors), for who needs no others."""
    return per_sheet(sheets, lambda css: node_rows(css, options.aggressive, kinds), NODES)


#: Bytes of files that one partition of dealt() stands for.
DEALT_BYTES = 4 << 20


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df by the columns, in as many partitions as its files need: what one task holds and sorts does
    not grow with them. Where sizes are not known, as Spark deals."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if read >= 1 << 60:  # Spark's word for not known
        return df.repartition(*by)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-read // DEALT_BYTES)), *by)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark one; made on the driver, which alone can read DDL."""
    return to_arrow_schema(StructType.fromDDL(ddl), prefers_large_types=False)


def rules(nodes_: DataFrame, options: Options = Options()) -> DataFrame:
    """Rules and whether they take part; ones that do not still block merges of others."""
    r = nodes_.where("kind = 'rule'")
    return r.select("sheet_id", F.col("node_id").alias("rule_id"), "container_id", "scope_key", "scope_label", F.col("seq").alias("rule_pos"), "selector", "selectors", "selector_key", eligible(F.col("selectors"), options.ignored).alias("eligible"), "line", "col")


def declarations(nodes_: DataFrame, options: Options = Options()) -> DataFrame:
    """Declarations with their rule (or selector-less at-rule), scope and key."""
    d = nodes_.where("kind = 'decl'")
    return d.select(
        "sheet_id", F.col("node_id").alias("decl_id"), F.col("parent_id").alias("rule_id"), "container_id", "scope_key", "scope_label", "rule_kind",
        F.col("parent_id").alias("rule_pos"), F.col("seq").alias("decl_pos"), "prop", "value", "important", "prop_norm", "decl_key", "line",
        "rule_selector", "rule_selectors", "rule_line", "rule_col", eligible(F.col("rule_selectors"), options.ignored).alias("eligible"),
    )


def scopes(nodes_: DataFrame) -> DataFrame:
    """Blocks that hold rules: one row per physical block."""
    r = nodes_.where("kind = 'rule'")
    return r.groupBy("sheet_id", "container_id").agg(F.first("scope_key").alias("scope_key"), F.first("scope_label").alias("scope_label"), F.count(F.lit(1)).alias("n_rules"), F.min("seq").alias("first_pos"))


def parse_errors(nodes_: DataFrame) -> DataFrame:
    return nodes_.where("kind = 'error'").select("sheet_id", "error", "line", "col")
