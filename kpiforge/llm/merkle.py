"""Merkle dataset manifest: a postorder append log per language, built in aligned blocks.

Every row is a leaf. The leaves of a language, by id, are numbered; ``FANOUT ** LEVELS`` consecutive
ones are a block, and one builder writes a block's nodes in the order in which they are completed
(postorder). The tops of the blocks are the leaves of the next round, so a language of any size
takes a few rounds of small tasks. The languages' tops are the leaves of one more tree.

A node's place in such a log follows from the sizes of the subtrees before it (``position``), so a
proof reads its siblings by address. Proofs are made block by block: a block's rows meet its log and
the path from the block's top to the root, made once per block.

``H`` is SHA-256 in lowercase hex over the inputs put together, digests as hex text. A tree's runs
have ``FANOUT`` nodes, the last of a level fewer; a run of one is hashed, too. One node is the top.

Defined cases: a null field is hashed as ``-``, a value as its UTF-8 length, ``:`` and itself, so
empty and null texts differ; texts of any length are hashed whole, in Spark. Null languages are a
group of their own, the first; null ids come first in their language. Rows of one id are ordered by
leaf, equal rows in any order: each has its own place. A tampered version of a null stays null. An
empty table has no rows and no root. Only the named columns are read; others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import broadcast_if_small, per_batch, ship_package, staged

FANOUT, LEVELS = 8, 4
BLOCK = FANOUT ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---------------------------------------------------------------- one log

def joined_hash(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves."""
    h = 0
    while FANOUT ** h < leaves:
        h += 1
    return h


def position(level: int, index: int, leaves: int) -> int:
    """Place of a node in the postorder log of a tree over so many leaves.

    The node is completed after its last leaf and the nodes below it on that leaf's path; before
    that leaf come the leaves to its left and every full run among them, on each level.
    """
    last = min((index + 1) * FANOUT ** level, leaves) - 1
    place = level
    while last:
        place += last
        last //= FANOUT
    return place


def append_nodes(leaves: list[str], levels: int) -> list[str]:
    """The log of one builder: leaves and nodes up to ``levels``, each when it is completed."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def close(level: int) -> None:
        log.append(joined_hash(*runs[level]))
        runs[level + 1].append(log[-1])
        runs[level].clear()

    for leaf in leaves:
        log.append(leaf)
        runs[0].append(leaf)
        level = 0
        while level < levels and len(runs[level]) == FANOUT:
            close(level)
            level += 1
    for level in range(levels):
        if runs[level]:
            close(level)
    return log


def block_paths(log: list[str], leaves: int, levels: int) -> list[list[str]]:
    """For each leaf of a block, bottom up: the siblings before and after it, each put together."""
    nodes = [[log[position(level, i, leaves)] for i in range(-(-leaves // FANOUT ** level))] for level in range(levels)]
    out = []
    for leaf in range(leaves):
        path = []
        for level in range(levels):
            i = leaf // FANOUT ** level
            run = i - i % FANOUT
            path += ["".join(nodes[level][run:i]), "".join(nodes[level][i + 1:run + FANOUT])]
        out.append(path)
    return out


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in zip(path[::2], path[1::2]):
        leaf = joined_hash(before, leaf, after)
    return leaf


def _levels(nodes_in_round: int) -> int:
    return LEVELS if nodes_in_round > BLOCK else height(nodes_in_round)


def _hex_nodes(blob: bytes) -> list[str]:
    text = blob.hex()
    return [text[k:k + 64] for k in range(0, len(text), 64)]


# ---------------------------------------------------------------- rounds of builders

def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` (staged) with ``idx``, the place in its group by ``order``, and ``n``, the group's rows.

    Rows are dealt by ranges, so a large group is many tasks; only counts per range and group are
    added up.
    """
    placed = staged(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                    .withColumn("seq", F.monotonically_increasing_id())
                    .withColumn("part", F.shiftright("seq", 33)), f"{name}-order")
    parts = placed.groupBy(F.col(group).alias("g"), F.col("part").alias("p")).agg(
        F.min("seq").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.select("g", "p", "first", F.coalesce(F.sum("rows").over(own), F.lit(0)).alias("before"),
                                F.sum("rows").over(Window.partitionBy("g")).alias("n")), f"{name}-parts")
    met = placed.join(broadcast_if_small(parts), (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
    return met.withColumn("idx", F.col("seq") - F.col("first") + F.col("before")).drop("g", "p", "first", "before", "seq", "part")


def grow(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Logs of all blocks, round by round; ``nodes``: grp, n (nodes of the group), idx, digest."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n = table.column("n")[0].as_py()
        log = append_nodes([d.hex() for d in table.column("digest").to_pylist()], _levels(n))
        return pa.table({"grp": table.column("grp")[:1], "n": table.column("n")[:1], "block": table.column("block")[:1],
                         "leaves": pa.array([len(table)], pa.int64()), "log": pa.array([bytes.fromhex("".join(log))], pa.binary())})

    ship_package(nodes.sparkSession)
    rounds: list[DataFrame] = []
    while not rounds or not nodes.isEmpty():
        blocks = nodes.select("grp", "n", F.floor(F.col("idx") / BLOCK).alias("block"), "idx", "digest")
        logs = staged(blocks.groupBy("grp", "block").applyInArrow(
            build, "grp long, n long, block long, leaves long, log binary"), f"{name}-log")
        rounds.append(logs)
        nodes = logs.where(F.col("n") > BLOCK).select("grp", F.ceil(F.col("n") / BLOCK).alias("n"),
                                                      F.col("block").alias("idx"), _top().alias("digest"))
    return rounds


def _top() -> Column:
    return F.expr("substring(log, -32, 32)")


def tops(rounds: list[DataFrame]) -> DataFrame:
    """grp and the digest of its one remaining node."""
    done = [r.where(F.col("n") <= BLOCK).select("grp", _top().alias("digest")) for r in rounds]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _under(logs: DataFrame, outer: DataFrame, upper: DataFrame | None) -> DataFrame:
    """Logs with ``above``, the path from the block's top to the root."""
    whole = logs.where(F.col("n") <= BLOCK).join(broadcast_if_small(outer), "grp")
    if upper is None:
        return whole
    cut = logs.where(F.col("n") > BLOCK).join(upper.withColumnRenamed("idx", "block"), ["grp", "block"])
    return whole.unionByName(cut)


def paths(rounds: list[DataFrame], outer: DataFrame, down_to: int, name: str) -> DataFrame | None:
    """grp, idx, above: the path to the root of every node that round ``down_to`` starts from (None past the last round)."""

    def extract(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = block_paths(_hex_nodes(row["log"]), row["leaves"], _levels(row["n"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["grp"]] * len(own), pa.int64()),
                     pa.array(range(row["block"] * BLOCK, row["block"] * BLOCK + len(own)), pa.int64()),
                     pa.array([p + row["above"] for p in own], pa.list_(pa.string()))], ["grp", "idx", "above"])

    upper = None
    for logs in reversed(rounds[down_to:]):
        upper = staged(per_batch(_under(logs, outer, upper), extract, "grp long, idx long, above array<string>"), f"{name}-paths")
    return upper


# ---------------------------------------------------------------- the manifest

@dataclass
class Manifest:
    """Rows with their leaves (grp, n, idx, id, leaf, claimed), the logs of all rounds, and the languages' tree."""

    leaves: DataFrame
    rounds: list[DataFrame]
    languages: DataFrame
    language_rounds: list[DataFrame]

    @property
    def root(self) -> str | None:
        """The manifest's one digest; None for an empty table."""
        top = tops(self.language_rounds).first()
        return top.digest.hex() if top else None


def leaf_digest(values: list[Column]) -> Column:
    """H of the values' texts, each with its length."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*(field(c) for c in values)), 256))


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
          tampered: dict[str, Column] | None = None) -> Manifest:
    """Hash all rows and write the logs. ``tampered`` replaces columns in the leaf that a later check holds against the manifest."""
    cols = {c: F.col(f"`{c}`") for c in fields}
    leaves = staged(docs.select(F.col(f"`{group_col}`").cast("string").alias("lang"), F.col(f"`{id_col}`").alias("id"),
                                leaf_digest(list(cols.values())).alias("leaf"),
                                leaf_digest(list({**cols, **(tampered or {})}.values())).alias("claimed")), "merkle-leaves")
    leaves = leaves.withColumn("row", F.monotonically_increasing_id())  # staged, so it stays the same
    placed = ranked(leaves, "lang", ["id", "leaf", "row"], "merkle")
    languages = staged(placed.select(F.col("lang").alias("l")).distinct().withColumn("all", F.lit(0)), "merkle-languages")
    languages = staged(ranked(languages, "all", ["l"], "merkle-languages").select(
        "l", F.col("idx").alias("grp"), F.col("n").alias("languages")), "merkle-languages")
    met = placed.join(broadcast_if_small(languages), F.col("lang").eqNullSafe(F.col("l")))
    numbered = staged(met.select("grp", "n", "idx", "id", "leaf", "claimed"), "merkle-numbered")
    rounds = grow(numbered.select("grp", "n", "idx", F.col("leaf").alias("digest")), "merkle")
    subroots = staged(languages.join(tops(rounds), "grp").select(
        "l", "grp", "languages", "digest"), "merkle-subroots")
    return Manifest(numbered, rounds, subroots, grow(subroots.select(
        F.lit(0).cast("long").alias("grp"), F.col("languages").alias("n"), F.col("grp").alias("idx"), "digest"), "merkle-top"))


def append_log(manifest: Manifest) -> DataFrame:
    """Every node of the languages' trees with its place in its language's log: lang, position, level, digest."""
    total = manifest.leaves.groupBy("grp").agg(F.first("n").alias("total"))
    out = None
    for number, logs in enumerate(manifest.rounds):
        def nodes(batches, number=number):
            for batch in batches:
                for row in batch.to_pylist():
                    log, levels, leaves = _hex_nodes(row["log"]), _levels(row["n"]), row["leaves"]
                    found = []
                    for level in range(1 if number else 0, levels + 1):  # a later round's leaves are in the round before
                        start = row["block"] * FANOUT ** (LEVELS - level)
                        for i in range(-(-leaves // FANOUT ** level)):
                            high = number * LEVELS + level
                            found.append((row["grp"], position(high, start + i, row["total"]), high, log[position(level, i, leaves)]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (
                        pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["grp", "position", "level", "digest"])

        part = per_batch(logs.join(total, "grp"), nodes, "grp long, position long, level int, digest string")
        out = part if out is None else out.unionByName(part)
    return out.join(manifest.languages.select("grp", F.col("l").alias("lang")), "grp").select("lang", "position", "level", "digest")


def proofs(manifest: Manifest) -> DataFrame:
    """Per row: id, leaf, subroot, root, path, proof_sha256, and the root that the claimed leaf folds to."""
    spark = manifest.leaves.sparkSession
    no_path = spark.createDataFrame([(0, [])], "grp long, above array<string>")
    outer = paths(manifest.language_rounds, no_path, 0, "merkle-top").select(F.col("idx").alias("grp"), "above")
    outer = staged(outer, "merkle-outer")
    upper = paths(manifest.rounds, outer, 1, "merkle")
    logs = _under(manifest.rounds[0], outer, upper).select("grp", "block", "n", "leaves", "log", "above")

    def prove(rows: pa.Table, logs: pa.Table) -> pa.Table:
        log = logs.to_pylist()[0]
        own = block_paths(_hex_nodes(log["log"]), log["leaves"], _levels(log["n"]))
        out = []
        for idx, leaf, claimed in zip(*(rows.column(c).to_pylist() for c in ("idx", "leaf", "claimed"))):
            path = own[idx % BLOCK] + log["above"]
            out.append((leaf.hex(), path, joined_hash(*path), fold(claimed.hex(), path)))
        columns = list(zip(*out))
        return pa.table({"grp": rows.column("grp"), "id": rows.column("id"), "leaf": pa.array(columns[0], pa.string()),
                         "path": pa.array(columns[1], pa.list_(pa.string())), "proof_sha256": pa.array(columns[2], pa.string()),
                         "folded_root": pa.array(columns[3], pa.string())})

    id_type = manifest.leaves.schema["id"].dataType.simpleString()
    rows = manifest.leaves.withColumn("block", F.floor(F.col("idx") / BLOCK))
    found = rows.groupBy("grp", "block").cogroup(logs.groupBy("grp", "block")).applyInArrow(
        prove, f"grp long, id {id_type}, leaf string, path array<string>, proof_sha256 string, folded_root string")
    root = manifest.root
    top = manifest.languages.select("grp", F.col("l").alias("lang"), F.lower(F.hex("digest")).alias("subroot"))
    return found.join(broadcast_if_small(top), "grp").select(
        "id", "lang", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "path", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"))
