"""Merkle manifest of a table, with a version of its tree for every leaf that was tampered with.

A row's leaf is the hash of its fields. The leaves of a group (by default a language), in the order of
their ids, are paired level by level up to the group's subroot, and the subroots to the root. No task
sees a whole tree: a group's nodes are cut into aligned blocks of 2^bits, whose roots are the nodes
that the next round cuts into blocks, until one is left per group. On the way down each block gets the
path of its own root and extends it to its members, so that what meets in a task is one block.

A tampered leaf makes a version of the tree that shares every untouched node: within its block only
the ancestors are copied (path copying), above it the version goes on along the block's path, which
holds the untouched siblings. Versions are independent of each other.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvermart.llm.common import Scratch
from silvermart.llm.numbering import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# A block has 2^BLOCK_BITS nodes.
BLOCK_BITS = 10

# A step of a path: the sibling with the side it stands on, or nothing for a node without sibling.
LEFT, RIGHT, ALONE = "<", ">", "-"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(values: list[Column]) -> Column:
    """Hash of a row: per value its bytes and itself, or a dash for NULL."""
    parts = []
    for value in values:
        written = value.cast("string")
        size = F.octet_length(written).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(size, F.lit(":"), written)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels_of(leaves: list[str], height: int) -> list[list[str]]:
    """The nodes of a block by height; the last one of an odd level is hashed alone."""
    levels = [leaves]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def path_of(levels: list[list[str]], place: int) -> list[str]:
    """The steps from a leaf to the root of its block."""
    steps = []
    for level in levels[:-1]:
        other = place ^ 1
        if other >= len(level):
            steps.append(ALONE)
        else:
            steps.append((LEFT if other < place else RIGHT) + level[other])
        place >>= 1
    return steps


def copied_path(levels: list[list[str]], place: int, leaf: str) -> list[str]:
    """The nodes of a block that a version with another leaf does not share, from the leaf up."""
    nodes = [leaf]
    for level in levels[:-1]:
        pair = level[place & ~1 : (place & ~1) + 2]
        pair[place & 1] = nodes[-1]
        nodes.append(digest("".join(pair)))
        place >>= 1
    return nodes


def continued(node: str, path: list[str]) -> list[str]:
    """A version's nodes above `node`, along a path whose siblings it shares."""
    nodes = []
    for step in path:
        side, other = step[0], step[1:]
        node = digest(other + node if side == LEFT else node + other)
        nodes.append(node)
    return nodes


def version_of(levels: list[list[str]], place: int, leaf: str, upper: list[str]) -> list[str]:
    """All nodes that a version with another leaf copies, from the leaf to the root."""
    nodes = copied_path(levels, place, leaf)
    return nodes + continued(nodes[-1], upper)


def height_of(total: int, bits: int) -> int:
    """Levels above the nodes of a block, for a group with so many nodes."""
    return min(bits, max(0, total - 1).bit_length())


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("place", bits))


def _roots(nodes: DataFrame, bits: int) -> DataFrame:
    """(group_key, place, total, digest) of the blocks' roots, the nodes of the next round."""

    def root(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        first = block.iloc[0]
        total = int(first["total"])
        top = levels_of(block["digest"].tolist(), height_of(total, bits))[-1][0]
        return pd.DataFrame(
            {
                "group_key": [first["group_key"]],
                "place": [int(first["place"]) >> bits],
                "total": [-(-total >> bits)],
                "digest": [top],
            }
        )

    narrow = _blocks(nodes.select("group_key", "place", "total", "digest"), bits)
    return narrow.groupBy("group_key", "block").applyInPandas(
        root, "group_key string, place long, total long, digest string"
    )


def _block_by_block(nodes: DataFrame, above: DataFrame, bits: int, schema: str, answer) -> DataFrame:
    """`answer(members, levels, above)` of each block: its members in order, the nodes of its tree by
    height, and what its root knows (path, subroot, root), which is sent once per block."""

    def run(members: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("place")
        height = height_of(int(members["total"].iloc[0]), bits)
        levels = levels_of(members["digest"].tolist(), height)
        return answer(members, levels, known.iloc[0])

    known = above.withColumnRenamed("place", "block").groupBy("group_key", "block")
    return (
        _blocks(nodes, bits).groupBy("group_key", "block").cogroup(known).applyInPandas(run, schema)
    )


def _paths(nodes: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """(group_key, place, path, subroot, root): the blocks' paths handed down to their members."""

    def extend(members: pd.DataFrame, levels: list[list[str]], known: pd.Series) -> pd.DataFrame:
        upper = list(known["path"])
        paths = [path_of(levels, i) + upper for i in range(len(members))]
        return members[["group_key", "place"]].assign(
            path=paths, subroot=known["subroot"], root=known["root"]
        )

    schema = "group_key string, place long, path array<string>, subroot string, root string"
    return _block_by_block(nodes, above, bits, schema, extend)


def _climb(nodes: DataFrame, bits: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """The stored nodes of every round, the last with one node per group."""
    rounds = [nodes]
    largest = nodes.agg(F.max("total")).first()[0] or 0
    while largest > 1:
        rounds.append(scratch.store(f"{name}-{len(rounds)}", _roots(rounds[-1], bits)))
        largest = -(-largest >> bits)
    return rounds


@dataclass(frozen=True)
class Manifest:
    """The leaves of a table, and the path and roots that their blocks' roots have."""

    leaves: DataFrame
    above: DataFrame
    bits: int

    def _of_leaves(self, columns: str, answer) -> DataFrame:
        schema = f"id {self.leaves.schema['id'].dataType.simpleString()}, {columns}"
        return _block_by_block(self.leaves, self.above, self.bits, schema, answer)

    def proofs(self) -> DataFrame:
        """(id, group_key, place, leaf, subroot, root, proof_sha256, folded_root) of every leaf.

        folded_root is the root of the leaf's version where it was tampered with, and the root
        recomputed from the leaf and its siblings elsewhere.
        """

        def prove(members: pd.DataFrame, levels: list[list[str]], known: pd.Series):
            upper = list(known["path"])
            above = "".join(step[1:] for step in upper)
            proofs, roots = [], []
            for i, (leaf, changed) in enumerate(zip(members["digest"], members["changed"])):
                siblings = "".join(step[1:] for step in path_of(levels, i))
                proofs.append(digest(siblings + above))
                own = changed if isinstance(changed, str) else leaf
                roots.append(version_of(levels, i, own, upper)[-1])
            return members[["id", "group_key", "place"]].assign(
                leaf=members["digest"],
                subroot=known["subroot"],
                root=known["root"],
                proof_sha256=proofs,
                folded_root=roots,
            )

        return self._of_leaves(
            "group_key string, place long, leaf string, subroot string, root string, "
            "proof_sha256 string, folded_root string",
            prove,
        )

    def paths(self) -> DataFrame:
        """(id, group_key, place, path): the siblings of every leaf, level by level, with sides."""

        def collect(members: pd.DataFrame, levels: list[list[str]], known: pd.Series):
            paths = [path_of(levels, i) + list(known["path"]) for i in range(len(members))]
            return members[["id", "group_key", "place"]].assign(path=paths)

        return self._of_leaves("group_key string, place long, path array<string>", collect)

    def versions(self) -> DataFrame:
        """(id, group_key, place, height, digest): the nodes that each tampered leaf's version
        copies, from the leaf (height 0) to the root; all others are those of the manifest."""

        def copy(members: pd.DataFrame, levels: list[list[str]], known: pd.Series):
            out = []
            for i, (key, group, place, changed) in enumerate(
                zip(*[members[c] for c in ("id", "group_key", "place", "changed")])
            ):
                if isinstance(changed, str):
                    nodes = version_of(levels, i, changed, list(known["path"]))
                    out += [(key, group, place, h, node) for h, node in enumerate(nodes)]
            return pd.DataFrame(out, columns=["id", "group_key", "place", "height", "digest"])

        return self._of_leaves("group_key string, place long, height int, digest string", copy)


def build(
    docs: DataFrame,
    id_column: str = "doc_id",
    group_column: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    tampered: Column | None = None,
    changes: dict[str, Column] | None = None,
    bits: int = BLOCK_BITS,
) -> Manifest:
    """The manifest of a table over some of its fields.

    Where `tampered` holds, the version's leaf has the values of `changes` in place of those fields;
    where that condition is NULL nothing was tampered with. Groups are ordered bytewise, NULL first,
    and are written as '' for NULL and '+' with the value. Rows of one id stand in the order of
    their leaves, rows without an id before the others; wholly equal rows are leaves of their own.
    NULL fields count as such and not as empty. Other columns of `docs` play no part, whatever their
    names. An empty table has no leaf and no root.
    """
    scratch = Scratch(docs.sparkSession)
    of = {c: F.col(f"`{c}`") for c in {id_column, group_column, *fields}}
    leaf = leaf_of([of[c] for c in fields])
    other = leaf_of([(changes or {}).get(c, of[c]) for c in fields])
    group = of[group_column].cast("string")
    hashed = docs.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("+"), group)).alias("group_key"),
        of[id_column].alias("id"),
        leaf.alias("digest"),
        F.when(F.lit(False) if tampered is None else tampered, other).alias("changed"),
        F.monotonically_increasing_id().alias("tag"),
    )
    # Texts are hashed once; from here on rows are narrow.
    hashed = scratch.store("hashed", hashed)
    leaves = numbered(hashed, "group_key", ["id", "digest", "tag"], scratch, "sliced").drop("tag")
    leaves = scratch.store("leaves", leaves)
    trees = _climb(leaves, bits, scratch, "nodes")

    tops = trees[-1].select(
        F.lit("").alias("group_key"), F.col("group_key").alias("id"), "digest"
    )
    subroots = scratch.store(
        "subroots", numbered(tops, "group_key", ["id"], scratch, "sliced-subroots")
    )
    upper = _climb(subroots, bits, scratch, "upper-nodes")

    none = F.array().cast("array<string>")
    above = upper[-1].select(
        "group_key",
        "place",
        none.alias("path"),
        F.lit(None).cast("string").alias("subroot"),
        F.col("digest").alias("root"),
    )
    for nodes in reversed(upper[:-1]):
        above = _paths(nodes, above, bits)
    # What is known of the subroots is handed to the groups' own trees.
    above = subroots.join(above.select("place", "path", "root"), "place").select(
        F.col("id").alias("group_key"),
        F.lit(0).cast("long").alias("place"),
        "path",
        F.col("digest").alias("subroot"),
        "root",
    )
    above = scratch.store("above", above)
    for k, nodes in reversed(list(enumerate(trees[1:-1], 1))):
        above = scratch.store(f"above-{k}", _paths(nodes, above, bits))
    return Manifest(leaves, above, bits)


def tampered_ids(doc_id: Column, every: int = 7) -> Column:
    """Rows whose id, as decimal text, has a crc32 that `every` divides; not those without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % every == 0


def one_more(count: Column) -> Column:
    """A count and one, also beyond the long range."""
    return (count.cast("decimal(20,0)") + 1).cast("decimal(20,0)")
