"""Merkle manifest of a dataset, and the versions of it that changed documents make.

Leaves are digests of rows. The leaves of a group stand in order, and every
``fanout`` consecutive nodes have one parent, until one node is left; the
groups' roots make a tree of the same kind. A tree is cut into aligned blocks
of ``fanout ** height`` nodes: a task holds a block, hands its root to the tier
above, and the tiers go on until a group has one node, so a group of any size
is split.

On the way down each block learns which nodes stand beside its ancestors. The
tree is persistent: a changed leaf makes a version that copies its ancestors
only and shares every other node; the copies begin inside the block and go on
along the ancestors above it, in the same task, so the versions of a block
never meet those of others.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.frames import prefix_sum
from quire.llm.store import stored

c = F.col
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"
DIGITS = 64  # of a digest


def encoded(x: Column) -> Column:
    """A value as it goes into a leaf: ``-`` if null, else bytes, colon, value."""
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels(nodes: list[str], alone: bool, fanout: int, height: int) -> list[list[str]]:
    """The nodes of a block by level, its root last; a block that is a whole tree ends as soon as one node is left."""
    out = [nodes]
    while len(out[-1]) > 1 if alone else len(out) <= height:
        below = out[-1]
        out.append([digest("".join(below[i:i + fanout])) for i in range(0, len(below), fanout)])
    return out


def beside(tree: list[list[str]], i: int, fanout: int) -> list[tuple[str, str]]:
    """What stands left and right of leaf ``i`` and of each of its ancestors below the block's root."""
    out = []
    for nodes in tree[:-1]:
        first = i - i % fanout
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + fanout])))
        i //= fanout
    return out


def copied(changed: str, path: list[tuple[str, str]]) -> list[str]:
    """The copies of the ancestors that a version with this leaf makes, from the lowest to the root."""
    out = []
    for before, after in path:
        changed = digest(before + changed + after)
        out.append(changed)
    return out


def _alone(block: int, n: int, fanout: int, height: int) -> bool:
    return block == 0 and n < fanout ** height


def climb(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """``key, pos, digest`` of the roots of the blocks of ``nodes``."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        block = key[1].as_py()
        tree = levels(rows.column("digest").to_pylist(), _alone(block, len(rows), fanout, height), fanout, height)
        return pa.table({"key": [key[0].as_py()], "pos": [block], "digest": tree[-1]}, schema=pa.schema([("key", pa.string()), ("pos", pa.int64()), ("digest", pa.string())]))

    return nodes.select("key", "pos", "digest", F.expr(f"pos div {fanout ** height}").alias("block")).groupBy("key", "block").applyInArrow(
        run, "key string, pos long, digest string")


def tiers(nodes: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """``nodes``, the roots of their blocks, the roots of the blocks of these, until each key has one."""
    out = [nodes]
    while not out[-1].where("pos > 0").isEmpty():
        out.append(stored(climb(out[-1], fanout, height), "tier"))
    return out


def descend(nodes: DataFrame, paths: DataFrame, fanout: int, height: int) -> DataFrame:
    """``key, pos, subroot, path`` of ``nodes`` from those of their blocks' roots."""
    struct = pa.struct([("before", pa.string()), ("after", pa.string())])
    schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()), ("path", pa.list_(struct))])

    def run(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n = len(rows)
        tree = levels(rows.column("digest").to_pylist(), _alone(key[1].as_py(), n, fanout, height), fanout, height)
        rest = above.column("path")[0].as_py()
        path = [[{"before": a, "after": b} for a, b in beside(tree, i, fanout)] + rest for i in range(n)]
        return pa.table([rows.column("key"), rows.column("pos"), pa.array([above.column("subroot")[0].as_py()] * n), path], schema=schema)

    dealt = nodes.select("key", "pos", "digest", F.expr(f"pos div {fanout ** height}").alias("block")).groupBy("key", "block")
    above = paths.select("key", c("pos").alias("block"), "subroot", "path").groupBy("key", "block")
    return dealt.cogroup(above).applyInArrow(run, f"key string, pos long, subroot string, path {PATH}")


def walk_down(built: list[DataFrame], paths: DataFrame, fanout: int, height: int) -> DataFrame:
    """Paths of the second lowest tier of ``built`` (of the lowest, if it is the only one) from those of its top."""
    for nodes in built[-2:0:-1]:
        paths = stored(descend(nodes, paths, fanout, height), "paths")
    return paths


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang",
    order: str = "doc_id", changed: dict[str, Column] | None = None, where: Column | None = None,
    fanout: int = 8, height: int = 3,
) -> DataFrame:
    """``order, leaf, subroot, root, proof, copies, folded_root, verified``, a row for each row of ``docs``.

    A leaf is the digest of ``fields``. ``changed`` gives fields another value
    in the rows that ``where`` names (null: not named); each such row makes a
    version of the tree. ``proof`` are the nodes beside the leaf and its
    ancestors from the leaf to the root, left to right; ``copies`` the
    ancestors as that row's version copies them, from the lowest to the root;
    for a row that did not change they equal the nodes themselves.
    ``folded_root`` is the last copy, the leaf itself where it has no ancestor.

    A null group is a group of its own and comes first, as does a null
    ``order``; rows that repeat an ``order`` go by their leaf, and equal rows
    are leaves of their own. Empty and very long values are hashed whole; no
    rows give no rows. Other columns are not read, whatever their names.
    """
    changed = changed or {}
    named = F.coalesce(where, F.lit(False)) if where is not None else F.lit(False)
    key = F.coalesce(F.concat(F.lit("="), c(group).cast("string")), F.lit("-"))  # "-" sorts before "="
    rows = docs.select(
        key.alias("key"), c(order).alias("order"), leaf(*(c(x) for x in fields)).alias("digest"),
        F.when(named, leaf(*(changed.get(x, c(x)) for x in fields))).alias("changed"),
        F.monotonically_increasing_id().alias("nth"))
    leaves = prefix_sum(rows, ["order", "digest", "nth"], group=["key"], name="n")
    leaves = stored(leaves.select("key", (c("n") - 1).alias("pos"), "order", "digest", "changed"), "leaves")
    own = tiers(leaves.select("key", "pos", "digest"), fanout, height)

    roots = stored(prefix_sum(own[-1].select("key", "digest"), ["key"], name="n").select(
        c("key").alias("own"), F.lit("").alias("key"), (c("n") - 1).alias("pos"), "digest"), "roots")
    top = tiers(roots.select("key", "pos", "digest"), fanout, height)
    found = top[-1].first()
    root = found["digest"] if found else ""
    nothing = F.expr(f"cast(array() as {PATH})")
    upper = walk_down(top, top[-1].select("key", "pos", c("digest").alias("subroot"), nothing.alias("path")), fanout, height)
    if len(top) > 1:
        upper = descend(roots.select("key", "pos", "digest"), upper, fanout, height)
    upper = roots.select("own", "pos", "digest").join(upper.select("pos", "path"), "pos").select(
        c("own").alias("key"), F.lit(0).cast("long").alias("pos"), c("digest").alias("subroot"), "path")
    paths = walk_down(own, stored(upper, "paths"), fanout, height)

    schema = f"order {dict(rows.dtypes)['order']}, leaf string, subroot string, root string, proof array<string>, copies array<string>, folded_root string, verified boolean"
    single = len(own) == 1  # every group is one leaf

    def run(block: tuple, left: pa.Table, above: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        nodes = left.column("digest").to_pylist()
        tree = [nodes] if single else levels(nodes, _alone(block[1].as_py(), len(nodes), fanout, height), fanout, height)
        rest = [(x["before"], x["after"]) for x in above.column("path")[0].as_py()]
        proofs, copies, folded = [], [], []
        for i, new in enumerate(left.column("changed").to_pylist()):
            path = [*beside(tree, i, fanout), *rest]
            start = nodes[i] if new is None else new
            nodes_beside = "".join(a + b for a, b in path)
            proofs.append([nodes_beside[k:k + DIGITS] for k in range(0, len(nodes_beside), DIGITS)])
            copies.append(copied(start, path))
            folded.append(copies[-1][-1] if path else start)
        n, strings = len(nodes), pa.list_(pa.string())
        return pa.table({
            "order": left.column("order"), "leaf": left.column("digest"),
            "subroot": pa.array(above.column("subroot").to_pylist()[:1] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "proof": pa.array(proofs, strings), "copies": pa.array(copies, strings), "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([x == root for x in folded], pa.bool_())})

    size = 1 if single else fanout ** height
    dealt = leaves.withColumn("block", F.expr(f"pos div {size}")).groupBy("key", "block")
    above = paths.select("key", c("pos").alias("block"), "subroot", "path").groupBy("key", "block")
    return dealt.cogroup(above).applyInArrow(run, schema).withColumnRenamed("order", order)


def third(order: str = "doc_id") -> Column:
    """Whether 3 divides the unsigned CRC-32 of the decimal number."""
    return F.crc32(c(order).cast("string")) % 3 == 0


def lower_ascii(text: str = "text") -> Column:
    return F.translate(c(text), UPPER, LOWER)
