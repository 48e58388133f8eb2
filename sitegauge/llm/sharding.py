"""Sharding by a weighted hash tree of regions, racks and shards, as column expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import numbered

#: Draws are numbers below this prime, so that products with the factors stay exact in 64 bits.
DRAW_PRIME = 2**31 - 1
#: Odd constants that spread shard numbers, and the factor of each mixing round.
SHARD_STEP, ROUND_FACTORS = 2654435, (48271, 69621, 16807)
#: Buckets that number the rows of one shard.
SLOT_BUCKETS = 256
#: Fixed bytes that a row takes besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Leaf:
    """A shard, its place in the tree and its weight."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 4, racks: int = 4, weights: dict[int, float] | None = None) -> list[Leaf]:
    """Shards 0, 1, 2, ... in racks of ``per_rack`` and regions of ``racks`` racks.

    A shard's place depends on its number alone, so a further shard joins the last rack, or opens
    the next rack or region. ``weights`` holds the shards whose weight is not 1.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    weights = weights or {}
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive; leave a shard out instead")
    return [Leaf(s, s // (per_rack * racks), s // per_rack, float(weights.get(s, 1.0))) for s in range(shards)]


def key_digits(key: Column) -> Column:
    """Struct of three 28-bit numbers, d0 to d2, from the MD5 digest of a key."""
    digest = F.md5(key)
    return F.struct(*[F.conv(F.substring(digest, 1 + 7 * i, 7), 16, 10).cast("long").alias(f"d{i}") for i in range(len(ROUND_FACTORS))])


def _draw(digits: str, leaf: Leaf) -> str:
    """Arrival time of a shard for a key: exponential with the weight as rate."""
    mixed = f"{(leaf.shard + 1) * SHARD_STEP}L"
    for i, factor in enumerate(ROUND_FACTORS):
        mixed = f"((({mixed}) ^ {digits}.d{i}) * {factor}L) % {DRAW_PRIME}L"
    return f"-ln(({mixed} + 0.5D) / {DRAW_PRIME}D) / {leaf.weight!r}D"


def descend(digits: str, tree: list[Leaf]) -> Column:
    """Struct ``(draw, region, rack, shard)`` of the shard that the tree gives to a key.

    ``digits`` names a column of ``key_digits``. Every shard draws an exponential arrival time
    whose rate is its weight. The draw of a rack is the least of its shards and that of a region
    the least of its racks; the least of exponential times is exponential in the summed weight,
    so a node wins in proportion to the weight below it. The descent takes the region of the
    least draw, then its rack, then the shard. A changed weight, or a new shard, alters no draw
    outside the path to it: rows move only into (or, if it shrinks, out of) that one shard, and
    never between others. (Draws made for each level apart would mix the rows that enter a region
    over its old shards; draws handed up from the shards keep those still.)
    """
    regions: dict[int, dict[int, list[str]]] = {}
    for leaf in tree:
        at = f"named_struct('draw', {_draw(digits, leaf)}, 'region', {leaf.region}, 'rack', {leaf.rack}, 'shard', {leaf.shard})"
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(at)

    def least(choices: list[str]) -> str:
        return f"least({', '.join(choices)})" if len(choices) > 1 else choices[0]

    return F.expr(least([least([least(shards) for shards in racks.values()]) for racks in regions.values()]))


def key_of(column: str) -> Column:
    """Hash key of an id; null is a key of its own."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("null"))


def shard_documents(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, id_column: str = "doc_id",
                    text_column: str = "text", slot_buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Every row with its shard and its slot there.

    Returns doc_id, size (UTF-8 bytes and ``ROW_BYTES``; a null text has none), text_crc32
    (unsigned; null as empty), region, rack, shard and slot (0, 1, 2, ... in each shard). The id
    alone decides the shard, so rows that repeat an id, null included, share one. Slots follow
    hash buckets, ids, checksums and sizes; rows equal in all of these are interchangeable. Other
    columns, whatever their names, are not read; an empty table gives no rows. Only ids and sizes
    are shuffled, and no shard is gathered in one task.
    """
    text = F.col(f"`{text_column}`")
    placed = (
        docs.select(
            F.col(f"`{id_column}`").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            key_digits(key_of(id_column)).alias("digits"),
        )
        .withColumn("at", descend("digits", tree))
        .withColumn("grown_at", descend("digits", grown) if grown else F.lit(None))
        .withColumn("slot_bucket", F.col("digits.d0") % slot_buckets)
        .select("doc_id", "size", "text_crc32", "slot_bucket", "at.region", "at.rack", F.coalesce("at.shard", F.lit(-1)).alias("shard"), F.col("grown_at.shard").alias("grown_shard") if grown else F.lit(None).cast("int").alias("grown_shard"))
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    return numbered(placed, "slot", ["shard"], F.col("slot_bucket"), order).drop("slot_bucket")
