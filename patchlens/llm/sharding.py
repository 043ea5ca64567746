"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards. A row descends it: at every level each child draws -ln(u) / weight, u a hash of the
child's path and the row's key, and the least draw wins, so a child wins with a chance in proportion to its weight. A
child's draw depends on its own path and weight alone: when a weight grows, rows move only into that child's subtree, when
it shrinks, only out of it, and rows elsewhere stay. Everything is a column expression over the key: no shuffle decides a
shard.

Draws come from Spark's 64-bit hash, or with `portable` from MD5, so that any engine can tell a row's shard and slot by the
same rule; the registered query and its SQL do so.

Defined cases: a null key is one key like any other (with `portable` the same as the text "null"); null text has size 8 and the CRC of no bytes; repeated rows share a
shard and get slots of their own; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.common import gapless, md5_draw, table, unit_draw

#: region -> rack -> shard -> weight
Tree = dict[int, dict[int, dict[int, float]]]


def full_tree(regions: int, racks: int, shards: int) -> Tree:
    """Shards are numbered from 0 through the racks and regions, each of weight 1."""
    return {r: {r * racks + k: {(r * racks + k) * shards + s: 1.0 for s in range(shards)} for k in range(racks)} for r in range(regions)}


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, alone in a region of its own: rows move only into that shard."""
    shards = [s for racks in tree.values() for leaves in racks.values() for s in leaves]
    racks = [k for r in tree.values() for k in r]
    return tree | {max(tree) + 1: {max(racks) + 1: {max(shards) + 1: weight}}}


def tree_for(shards: int, base: tuple[int, int, int] = (3, 2, 4)) -> Tree:
    """The tree of so many shards: the full base tree, and each shard beyond it in a region of its own.

    The same for every shard count, so one more shard never moves a row between the others.
    """
    tree = full_tree(*base)
    least = base[0] * base[1] * base[2]
    if shards < least:
        raise ValueError(f"{shards} shards; the base tree has {least}")
    for _ in range(shards - least):
        tree = grow(tree)
    return tree


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def shard_of(key: Column, tree: Tree, salt: str = "shard-tree", portable: bool = False) -> Column:
    """The shard that key falls into."""

    def draw(level: str, child: int) -> Column:
        if portable:
            return md5_draw(F.concat(F.lit(f"{salt}:{level}:{child}:"), key_text(key)))
        return unit_draw(F.lit(salt), F.lit(level), F.lit(child), key)

    def winner(weights: dict[int, float], level: str) -> Column:
        draws = [F.struct((-F.log(draw(level, c)) / w).alias("draw"), F.lit(c).alias("child")) for c, w in weights.items() if w > 0]
        return (F.least(*draws) if len(draws) > 1 else draws[0])["child"]

    def descend(nodes: dict, level: int) -> Column:
        if level == 2:
            return winner(nodes, "shard")
        weights = {c: total(below) for c, below in nodes.items()}
        chosen = winner(weights, ("region", "rack")[level])
        live = [c for c in nodes if weights[c] > 0]
        out = descend(nodes[live[-1]], level + 1)
        for c in live[-2::-1]:
            out = F.when(chosen == c, descend(nodes[c], level + 1)).otherwise(out)
        return out

    def total(node) -> float:
        return sum(map(total, node.values())) if isinstance(node, dict) else node

    return descend(tree, 0).cast("int")


def assign_shards(docs: DataFrame, shards: int = 24, base: tuple[int, int, int] = (3, 2, 4), portable: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard), grown_shard (with one more shard)."""
    key = F.col("doc_id")
    shard = shard_of(key, tree_for(shards, base), portable=portable)
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        shard.alias("shard"),
        shard_of(key, tree_for(shards + 1, base), portable=portable).alias("grown_shard"),
    )
    counted = docs.select("doc_id", shard.alias("shard"))
    dealt = F.conv(F.substring(F.md5(F.concat(F.lit("slot:"), key_text(key))), 1, 2), 16, 10).cast("int") if portable else None
    return gapless(sized, ["shard"], ["doc_id"], "slot", counted, dealt=dealt)


def op9_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), portable=True).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _oracle(shards: int = 24, salt: str = "shard-tree") -> str:
    """DuckDB SQL for op9: each level's draws over a table of the trees' nodes; CRC-32 byte by byte."""
    nodes = []
    for name, tree in (("now", tree_for(shards)), ("grown", tree_for(shards + 1))):
        for region, racks in tree.items():
            nodes.append((name, "region", -1, region, sum(sum(leaves.values()) for leaves in racks.values())))
            for rack, leaves in racks.items():
                nodes.append((name, "rack", region, rack, sum(leaves.values())))
                nodes += [(name, "shard", rack, shard, weight) for shard, weight in leaves.items()]
    draw = f"-ln((('0x' || substr(md5('{salt}:' || level || ':' || child || ':' || k), 1, 12))::BIGINT::DOUBLE + 1) / {16**12}) / weight"
    below = "{0} AS MATERIALIZED (SELECT u.tree, u.k, arg_min(n.child, {2}) AS place FROM {1} u JOIN nodes n ON n.tree = u.tree AND n.level = '{0}' AND n.parent = u.place GROUP BY ALL)"
    return f"""WITH RECURSIVE nodes(tree, level, parent, child, weight) AS (VALUES {", ".join(map(str, nodes))}),
    crc_steps AS (SELECT i, i::BIGINT AS c, 0 AS n FROM range(256) r(i)
      UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM crc_steps WHERE n < 8),
    crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS entry FROM crc_steps WHERE n = 8),
    top AS (SELECT DISTINCT tree, coalesce(doc_id::VARCHAR, 'null') AS k, -1 AS place FROM documents, (SELECT DISTINCT tree FROM nodes)),
    {below.format("region", "top", draw)}, {below.format("rack", "region", draw)}, {below.format("shard", "rack", draw)},
    placed AS (SELECT d.*, a.place AS shard, b.place AS grown, ('0x' || substr(md5('slot:' || a.k), 1, 2))::INT AS part FROM documents d
      JOIN shard a ON a.tree = 'now' AND a.k = coalesce(d.doc_id::VARCHAR, 'null') JOIN shard b ON b.tree = 'grown' AND b.k = a.k)
    SELECT doc_id, (strlen(coalesce(text, '')) + 8)::BIGINT AS size,
      xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
        lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
      'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST) - 1 AS slot, grown::INT AS grown_shard
    FROM placed, crc"""


ORACLE_SQL = _oracle()
