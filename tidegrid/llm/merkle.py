"""Merkle manifest of a table: a persistent path-copying tree in aligned blocks.

Rows are leaves, in order inside their group; runs of ``FAN`` nodes become their hash until one
node is left per group, and the groups' roots become one root by the same rule.  A digest stands
as lowercase hex text in what is hashed.  Nodes are numbered, so a block of ``FAN ** HEIGHT``
neighbours and its place at every level follow from a row's number alone: blocks are built in
tasks, their roots are the leaves of the next round's blocks, and so on up.  On the way down each
block is told the upper nodes its path shares.  A changed leaf is a version of the tree that
copies the nodes above the leaf, first inside the block and then the upper ones, and shares all
others; no version rebuilds anything, and no task sees more than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from hashlib import sha256

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.words import borders, groups
from tidegrid.operators.blocks import spread
from tidegrid.staging import stage

FAN = 8
OverFrames = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(parts: Sequence[Column]) -> Column:
    """Hash of the values: ``-`` for null, else byte count, ``:`` and the value as text."""

    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in parts]), 256))


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def path(i: int, n: int) -> list[tuple[int, int]]:
    """Place in its run and length of the run, for node ``i`` of ``n`` and each node above it."""
    out = []
    while n > 1:
        out.append((i % FAN, min(FAN, n - i // FAN * FAN)))
        i, n = i // FAN, -(-n // FAN)
    return out


class Block:
    """``tall`` levels of a tree above neighbouring nodes, of which the first is ``first`` of ``n``."""

    def __init__(self, digests: list[str], first: int, n: int, tall: int):
        self.first = first
        self.levels = [digests]
        for _ in range(min(tall, height(n))):
            low = self.levels[-1]
            self.levels.append([h("".join(low[at : at + FAN])) for at in range(0, len(low), FAN)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, i: int) -> list[list[str]]:
        """The other nodes of the run of node ``i`` and of each ancestor's run."""
        at, out = i - self.first, []
        for level in self.levels[:-1]:
            run = at // FAN * FAN
            out.append(level[run:at] + level[at + 1 : run + FAN])
            at //= FAN
        return out


def copied(digest: str, siblings: Sequence[Sequence[str]], places: Sequence[tuple[int, int]]) -> list[str]:
    """The version of a tree with another leaf: its nodes from the leaf up to the version's root.

    All other nodes of the version are those of the tree itself."""
    out = [digest]
    for others, (at, _) in zip(siblings, places, strict=True):
        out.append(h("".join([*others[:at], out[-1], *others[at:]])))
    return out


def _cut(flat: bytes, places: Sequence[tuple[int, int]]) -> list[list[str]]:
    """Packed digests as one list per level."""
    text, out, at = flat.hex(), [], 0
    for _, size in places:
        out.append([text[k : k + 64] for k in range(at, at + 64 * (size - 1), 64)])
        at += 64 * (size - 1)
    return out


def _pack(siblings: Sequence[Sequence[str]]) -> bytes:
    return bytes.fromhex("".join(d for level in siblings for d in level))


def _blocks(frames: Iterator[pd.DataFrame], tall: int) -> Iterator[tuple[pd.DataFrame, Block]]:
    """Blocks of a partition that is sorted by group, block and number; a share row, if any, comes first."""
    for frame in groups(frames, ["g", "block"]):
        edge = borders(frame, ["g", "block"])
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            rows = frame.iloc[lo:hi]
            nodes = rows[(rows.i >= 0).to_numpy()]
            yield rows, Block([bytes(d).hex() for d in nodes.d], int(nodes.i.iat[0]), int(nodes.n.iat[0]), tall)


def _frames(rows: Iterator[tuple], names: list[str], most: int = 2_000) -> Iterator[pd.DataFrame]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == most:
            yield pd.DataFrame(part, columns=names)
            part = []
    if part:
        yield pd.DataFrame(part, columns=names)


def _in_blocks(rows: DataFrame) -> DataFrame:
    return spread(rows, "g", "block").sortWithinPartitions("g", "block", "i")


def _block(tall: int) -> Column:
    return F.floor(F.col("i") / FAN**tall).alias("block")


def _no_share() -> Column:
    return F.lit(None).cast("binary").alias("up")


def _tops(tall: int) -> OverFrames:
    def tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for part, block in _blocks(frames, tall):
                first = part.iloc[0]
                yield first.g, first.block, -(-first.n // FAN**tall), bytes.fromhex(block.root)

        yield from _frames(rows(), ["g", "i", "n", "d"])

    return tops


def _shares(tall: int) -> OverFrames:
    """For each node of a block its siblings and all upper ones its path shares, lowest first."""

    def shares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for part, block in _blocks(frames, tall):
                share = part.iloc[0]
                for i in part.i.iloc[1:].tolist():
                    yield share.g, i, -1, 0, share.d, _pack(block.siblings(i)) + bytes(share.up)

        yield from _frames(rows(), ["g", "block", "i", "n", "d", "up"])

    return shares


def climb(nodes: DataFrame, most: int, tall: int) -> list[DataFrame]:
    """Nodes ``g, i, n, d`` of every round, from the leaves to one node per group; ``most`` is the largest ``n``."""
    rounds = [nodes]
    while most > 1:
        blocks = _in_blocks(rounds[-1].select("g", _block(tall), "i", "n", "d"))
        rounds.append(stage(blocks.mapInPandas(_tops(tall), "g long, i long, n long, d binary"), "merkle-nodes"))
        most = -(-most // FAN**tall)
    return rounds


def descend(rounds: list[DataFrame], above: DataFrame, tall: int) -> DataFrame:
    """Share rows ``g, block, i = -1, n, d, up`` of the leaves' blocks.

    ``up`` holds the nodes shared above the block, ``d`` the root of the group; ``above`` gives
    both for the groups themselves, as ``g, d, up``."""
    shares = above.select("g", F.lit(0).cast("long").alias("block"), F.lit(-1).cast("long").alias("i"), F.lit(0).cast("long").alias("n"), "d", "up")
    for nodes in reversed(rounds[1:-1]):
        rows = nodes.select("g", _block(tall), "i", "n", "d", _no_share())
        shares = stage(_in_blocks(rows.unionByName(shares)).mapInPandas(_shares(tall), shares.schema), "merkle-shares")
    return shares


def _number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the rows of each group in a sorted partition; ``seg`` counts the groups in it."""
    part, seg, num, last = TaskContext.get().partitionId(), -1, 0, None
    for frame in frames:
        segs, nums = [], []
        for key in frame.key:
            if key != last:
                seg, num, last = seg + 1, 0, key
            segs.append(seg)
            nums.append(num)
            num += 1
        yield frame.assign(part=part, seg=segs, num=nums)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add group number ``g``, number ``i`` in the group and its size ``n``, in place of ``key``.

    Groups are equal ``key`` (binary), numbered in its order; rows stand in the order of the
    columns ``order``, and rows that agree in all of them anyhow.  The rows are sorted by range, so a group spreads over
    tasks; what crosses partitions is a table with one row per group and partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["key", *order, "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(*order, "_tie")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema) + ", part int, seg int, num long"
    rows = stage(ranged.mapInPandas(_number, schema), "merkle-numbered")
    segs = stage(rows.groupBy("part", "seg").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("c")), "merkle-segments")
    of_key, so_far = Window.partitionBy("key"), (Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(of_key.orderBy("part").rowsBetween(*so_far)), F.lit(0))
    segs = segs.select("part", "seg", before.alias("start"), F.sum("c").over(of_key).alias("n"))
    new = F.sum((F.col("start") == 0).cast("long"))
    # one row per partition
    per_part = segs.groupBy("part").agg(new.alias("new")).select(
        "part", F.coalesce(F.sum("new").over(Window.orderBy("part").rowsBetween(*so_far)), F.lit(0)).alias("groups")
    )
    inner = new.over(Window.partitionBy("part").orderBy("seg")) - 1
    segs = segs.withColumn("inner", inner).join(per_part, "part").withColumn("g", F.col("groups") + F.col("inner"))
    out = rows.join(segs.select("part", "seg", "g", "start", "n"), ["part", "seg"])
    return out.withColumn("i", F.col("start") + F.col("num")).drop("part", "seg", "num", "start", "key")


def _verify(root: str, group_count: int, nodes: bool, tall: int) -> OverFrames:
    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for part, block in _blocks(frames, tall):
                share, part = part.iloc[0], part.iloc[1:]
                g, n, subroot = int(share.g), int(part.n.iat[0]), bytes(share.d).hex()
                inside = len(block.levels) - 1
                upper = path(g, group_count)
                for id_, i, leaf, changed in zip(part["id"], part.i.tolist(), part.d, part.changed, strict=True):
                    places = path(i, n) + upper
                    siblings = block.siblings(i) + _cut(bytes(share.up), places[inside:])
                    version = copied(bytes(leaf if changed is None else changed).hex(), siblings, places)
                    proof = [d for level in siblings for d in level]
                    row = id_, g, i, bytes(leaf).hex(), subroot, root, h("".join(proof)), version[-1], version[-1] == root
                    yield (*row, proof, version) if nodes else row

        yield from _frames(rows(), [c.split(" ")[0] for c in (RESULT + NODES if nodes else RESULT)])

    return verify


RESULT = [
    "id string", "grp long", "place long", "leaf string", "subroot string", "root string",
    "proof_sha256 string", "folded_root string", "verified boolean",
]
NODES = ["proof array<string>", "version array<string>"]


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group: str = "lang",
    parts: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    changes: Mapping[str, Column] | None = None,
    when: Column | None = None,
    nodes: bool = True,
    tall: int = 4,
) -> DataFrame:
    """One row per row of ``docs``: its leaf, the roots, its proof and the check of the leaf it has now.

    ``changes`` replaces columns in rows where ``when`` is true: what the row holds now.  Its
    version of the tree is ``version``, the digests copied from the leaf up to ``folded_root``;
    ``verified`` says if that is the ``root``.  ``proof`` lists the other nodes of each run on the
    path.  ``grp`` and ``place`` number the groups and the rows in a group, from 0.  Without
    ``nodes``, ``proof`` and ``version``, some 3 KB a row, are left out.  A block has ``FAN ** tall`` leaves.

    Null groups come first, others by UTF-8 bytes; in a group rows ascend by id, null ids first
    and equal ids by leaf.  Null values count as ``-`` in a leaf, empty ones as ``0:``.  Repeated
    rows are leaves of their own.  An empty table gives no rows.  Columns other than ``parts`` play
    no part, whatever their names.  Texts of any length are hashed in the JVM, only digests move.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    schema = ", ".join(RESULT + NODES if nodes else RESULT)
    now = [(changes or {}).get(c, F.col(c)) for c in parts]
    name = F.col(group).cast("string").cast("binary")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit(b"\x01"), name), F.lit(b"\x00")).alias("key"),
        F.col(id_col).alias("_id"),
        F.col(id_col).cast("string").alias("id"),
        leaf_digest([F.col(c) for c in parts]).alias("d"),
        F.when(F.lit(False) if when is None else when, leaf_digest(now)).alias("changed"),
    )
    leaves = stage(leaves, "merkle-leaves").withColumn("_leaf", F.col("d"))
    leaves = stage(numbered(leaves, ["_id", "_leaf"]), "merkle-rows")
    most, group_count = leaves.agg(F.max("n"), F.max("g") + 1).first()
    if most is None:
        return spark.createDataFrame([], schema).withColumn("id", F.col("id").cast(id_type))
    rounds = climb(leaves.select("g", "i", "n", "d"), most, tall)
    # the groups' roots are the leaves of the upper tree; a group of one leaf is its root
    subroots = rounds[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(group_count).cast("long").alias("n"), "d")
    upper = climb(subroots, group_count, tall)
    root = bytes(upper[-1].first().d)
    shares = descend(upper, upper[-1].select("g", "d", F.lit(b"").alias("up")), tall)
    groups_ = _in_blocks(subroots.select("g", _block(tall), "i", "n", "d", _no_share()).unionByName(shares))
    above = stage(groups_.mapInPandas(_group_shares(tall), "g long, d binary, up binary"), "merkle-groups")
    shares = descend(rounds, above, tall)
    rows = leaves.select("g", _block(tall), "i", "n", "d", _no_share(), "id", "changed")
    blocks = _in_blocks(rows.unionByName(shares, allowMissingColumns=True))
    checked = blocks.mapInPandas(_verify(root.hex(), group_count, nodes, tall), schema)
    return checked.withColumn("id", F.col("id").cast(id_type))


def _group_shares(tall: int) -> OverFrames:
    """``g, d, up`` of each group: its own root and the nodes its path shares above that."""

    def shares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for part, block in _blocks(frames, tall):
                share = part.iloc[0]
                for i, d in zip(part.i.iloc[1:].tolist(), part.d.iloc[1:], strict=True):
                    yield i, bytes(d), _pack(block.siblings(i)) + bytes(share.up)

        yield from _frames(rows(), ["g", "d", "up"])

    return shares


def copied_nodes(manifest_rows: DataFrame) -> DataFrame:
    """The nodes that versions own, one row each: ``id, grp, level, node, digest``.

    Node 3 of level 2 is above leaves 3 * 64 and following of its group; it is 0 from the group's
    root on.  Every other node of a version is the manifest's."""
    own = manifest_rows.where("folded_root <> root").select("id", "grp", "place", F.posexplode("version").alias("level", "digest"))
    return own.select("id", "grp", "level", F.floor(F.col("place") / F.pow(F.lit(FAN), "level")).alias("node"), "digest")
