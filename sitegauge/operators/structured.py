"""JSON-LD blocks: validity, types and missing properties, with the Variant type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.constants import SCHEMA_REQUIREMENTS
from sitegauge.functions.cache import column_cache
from sitegauge.functions.html import leaf_text, let
from sitegauge.operators.elements import explode_rows, parse_pages

PROPERTIES = tuple(dict.fromkeys(p for props in SCHEMA_REQUIREMENTS.values() for p in props))


@column_cache
def blocks_column() -> Column:
    """Non-blank ld+json scripts in document order: ``(block, node, wrappers)``, node null if invalid.

    ``wrappers`` bounds how deep lists and @graph objects can nest in the block.
    """
    scripts = F.filter(
        F.transform(
            F.filter(F.col("els"), lambda e: (e["tag"] == "script") & F.coalesce(e["attrs"]["type"] == "application/ld+json", F.lit(False))),
            lambda e: leaf_text(e["raw"]),
        ),
        lambda raw: raw.rlike(r"\S"),
    )
    return F.transform(
        scripts, lambda raw, i: F.struct(
            (i + 1).cast("int").alias("block"), F.try_parse_json(raw).alias("node"),
            F.regexp_count(raw, F.lit(r"\[|@graph")).alias("wrappers"),
        )
    )


def _item(n: Column, path: Column, node: Column) -> Column:
    return F.struct(path.alias("path"), n["block"].alias("block"), node.alias("node"))


def _open_wrappers(state: Column) -> Column:
    """One level: lists yield their items, @graph wrappers their graph, objects are done."""

    def graph(n: Column) -> Column:
        return F.try_variant_get(n["node"], "$['@graph']", "variant")

    def children(n: Column) -> Column:
        items = F.try_variant_get(n["node"], "$", "array<variant>")
        return F.when(
            F.schema_of_variant(n["node"]).startswith("ARRAY"),
            F.transform(items, lambda x, i: _item(n, F.concat(n["path"], F.array(i)), x)),
        ).otherwise(F.filter(F.array(_item(n, n["path"], graph(n))), lambda g: g["node"].isNotNull()))

    finished = F.filter(
        state["open"], lambda n: F.schema_of_variant(n["node"]).startswith("OBJECT") & graph(n).isNull()
    )
    opened = F.struct(
        F.flatten(F.transform(state["open"], children)).alias("open"), F.concat(state["done"], finished).alias("done")
    )
    return F.when(F.size(state["open"]) > 0, opened).otherwise(state)


@column_cache
def nodes_column(blocks: str) -> Column:
    """Top-level objects of the valid blocks in document order: ``(block, types, context, absent)``.

    The fold runs as often as wrappers can nest; without open nodes a round does nothing.
    """
    valid = F.filter(F.col(blocks), lambda b: b["node"].isNotNull())
    roots = F.transform(valid, lambda b: _item(b, F.array(b["block"]), b["node"]))
    start = let(roots, lambda r: F.struct(r.alias("open"), F.filter(r, lambda _: F.lit(False)).alias("done")))
    rounds = F.coalesce(F.array_max(F.transform(valid, lambda b: b["wrappers"])), F.lit(0)) + 1
    objects = F.aggregate(F.sequence(F.lit(1), rounds), start, lambda state, _: _open_wrappers(state), lambda state: state["done"])
    ordered = F.array_sort(
        objects, lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0)
    )

    def facts(n: Column) -> Column:
        node = n["node"]
        listed = F.try_variant_get(node, "$['@type']", "array<string>")
        single = F.try_variant_get(node, "$['@type']", "string")
        absent = F.filter(
            F.array(*[F.when(F.try_variant_get(node, f"$.{p}", "variant").isNull(), p) for p in PROPERTIES]),
            lambda p: p.isNotNull(),
        )
        return F.struct(
            n["block"].alias("block"),
            F.filter(F.coalesce(listed, F.array(single)), lambda t: F.coalesce(t != "", F.lit(False))).alias("types"),
            F.nullif(F.try_variant_get(node, "$['@context']", "string"), F.lit("")).alias("context"),
            absent.alias("absent"),
        )

    return F.transform(ordered, facts)


def _required(kind: Column) -> Column:
    table = F.create_map(*[
        part
        for name, props in SCHEMA_REQUIREMENTS.items()
        for part in (F.lit(name), F.array(*[F.lit(p) for p in props]))
    ])
    return F.coalesce(table[kind], F.array().cast("array<string>"))


@column_cache
def typed_column(nodes: str) -> Column:
    """One entry per declared type: ``(block, type, missing)``."""
    return F.flatten(F.transform(
        F.col(nodes),
        lambda n: F.transform(
            n["types"],
            lambda t: F.struct(
                n["block"].alias("block"), t.alias("type"),
                F.filter(_required(t), lambda p: F.array_contains(n["absent"], p)).alias("missing"),
            ),
        ),
    ))


@column_cache
def schema_column() -> Column:
    contexts = F.array_sort(F.array_distinct(F.filter(F.transform(F.col("ld_nodes"), lambda n: n["context"]), lambda c: c.isNotNull())))
    return let(
        contexts,
        lambda found: F.struct(
            (F.size("ld_typed") > 0).alias("has_structured_data"),
            F.transform(F.col("ld_typed"), lambda t: t["type"]).alias("types"),
            found.alias("contexts"),
            F.size("ld_blocks").alias("blocks"),
            F.size(F.filter(F.col("ld_blocks"), lambda b: b["node"].isNull())).alias("invalid_blocks"),
            F.transform(
                F.filter(F.col("ld_typed"), lambda t: F.size(t["missing"]) > 0),
                lambda t: F.struct(t["type"].alias("type"), t["missing"].alias("missing")),
            ).alias("missing_properties"),
            F.exists(found, lambda c: c.contains("schema.org")).alias("uses_schema_org"),
        ),
    )


def with_structured(parsed: DataFrame) -> DataFrame:
    """Add ``schema``: blocks, invalid blocks, types, contexts and missing properties."""
    staged = (
        parsed.withColumn("ld_blocks", blocks_column())
        .withColumn("ld_nodes", nodes_column("ld_blocks"))
        .withColumn("ld_typed", typed_column("ld_nodes"))
    )
    return staged.withColumn("schema", schema_column()).drop("ld_blocks", "ld_nodes", "ld_typed")


def structured_data(pages: DataFrame) -> DataFrame:
    """Rows ``(page_id, block, valid, type, missing)``; type is null for blocks without typed node."""
    staged = (
        parse_pages(pages)
        .withColumn("blocks", blocks_column())
        .withColumn("nodes", nodes_column("blocks"))
        .withColumn("typed", typed_column("nodes"))
    )
    rows = F.flatten(F.transform(
        F.col("blocks"),
        lambda b: let(
            F.filter(F.col("typed"), lambda t: t["block"] == b["block"]),
            lambda own: F.transform(
                F.when(F.size(own) > 0, own).otherwise(
                    F.array(F.struct(
                        b["block"].alias("block"), F.lit(None).cast("string").alias("type"),
                        F.array().cast("array<string>").alias("missing"),
                    ))
                ),
                lambda t: F.struct(
                    t["block"].alias("block"), b["node"].isNotNull().alias("valid"), t["type"].alias("type"),
                    F.array_join(t["missing"], ",").alias("missing"),
                ),
            ),
        ),
    ))
    return explode_rows(staged, rows, "page_id")
