"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

Conversations of a block of ids share their first turns: `rebuilt` gives conversation c the first
h turns of the block's first conversation, and then c's own turns after its first h. A node is a
distinct sequence of first turns. A sequence is named by its depth and a sum of hashes of (turn
digest, depth), 128 bits in four sums, so prefixes come from running sums over ranges of rows and a
conversation of any length is spread over tasks; a parent's name is the sum before the last turn.
A node is then named by (smallest member, depth), and leaves and saved bytes of every subtree come
from `subtree_sums`.

Defined cases: rows with a null conv_id take no part. Null turns come first, null roles and texts are
empty; rows of one turn come by role, then by digest, and equal rows are as many turns. A
conversation that is left without turns is a member of the root only. Other columns are ignored. An
empty table gives no node.

The ids that end at a node are digested in ascending order. They are joined to text in ranges, and
only a node whose ids reach over several ranges has its pieces of text hashed one after another in
one task, as SHA-256 asks, a piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from longspan.llm.batches import slices
from longspan.llm.contraction import subtree_sums
from longspan.operators.joins import salted_join
from longspan.operators.ranking import in_ranges, running_sums
from longspan.sources.stages import stage

#: Conversations of one block share turns, up to SHARED - 1 of them.
BLOCK, SHARED = 5, 9
HASHES = [f"_h{k}" for k in range(4)]


def own_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), code (digest of role and text), n_bytes of the text, n_own turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"),
        F.md5(told.cast("binary")).alias("code"), F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    # Equal rows are one row with a count until they have their places.
    alike = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    placed = running_sums(alike, ["conv_id"], ["turn", "role", "code"], ["n"])
    places = F.sequence(F.col("n_before") + 1, F.col("n_before") + F.col("n"))
    return placed.select("conv_id", F.explode(places).alias("place"), "code", "n_bytes", F.col("n_total").alias("n_own"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, code, n_bytes) of all rebuilt turns, and the ids of all conversations with
    the number of turns they take over (`taken`) and leave out (`skipped`)."""
    conv = F.col("conv_id")
    each = own.groupBy("conv_id").agg(F.max("n_own").alias("n_own"))
    each = stage(
        each.withColumns({"base": conv - conv % BLOCK, "skipped": F.crc32(conv.cast("string").cast("binary")) % SHARED}), "conversations"
    )
    base = each.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    taken = F.least("skipped", F.coalesce("n_base", F.lit(0)))
    shapes = stage(each.join(base, "base", "left").select("conv_id", "base", "skipped", "n_own", taken.alias("taken")), "shapes")
    first = own.where(F.col("place") < SHARED).select(F.col("conv_id").alias("base"), "place", "code", "n_bytes")
    heads = first.join(shapes.select("base", "conv_id", "taken"), "base").where("place <= taken")
    tails = salted_join(own, shapes.select("conv_id", "skipped", "taken"), ["conv_id"]).where("place > skipped")
    depth = F.col("place") - F.col("skipped") + F.col("taken")
    rows = heads.select("conv_id", F.col("place").alias("depth"), "code", "n_bytes").unionByName(
        tails.select("conv_id", depth.alias("depth"), "code", "n_bytes")
    )
    return rows, shapes


def name_of(depth: Column, hashes: list[Column]) -> Column:
    return F.struct(depth.cast("bigint").alias("depth"), *[h.cast("bigint").alias(n) for n, h in zip(HASHES, hashes)])


def prefixes(rows: DataFrame) -> DataFrame:
    """Each turn with the name of the sequence it ends, of the one before, and whether it is the last."""
    low = F.lit((1 << 32) - 1)
    one, two = (F.xxhash64("code", "depth", F.lit(seed)) for seed in (1, 2))
    halves = [F.shiftrightunsigned(one, 32), one.bitwiseAND(low), F.shiftrightunsigned(two, 32), two.bitwiseAND(low)]
    hashed = rows.withColumns(dict(zip(HASHES, halves))).withColumn("_n", F.lit(1)).drop("code")
    upto = running_sums(hashed, ["conv_id"], ["depth"], [*HASHES, "_n"])
    return upto.select(
        "conv_id", "n_bytes",
        name_of(F.col("depth"), [F.col(h) + F.col(f"{h}_before") for h in HASHES]).alias("name"),
        name_of(F.col("depth") - 1, [F.col(f"{h}_before") for h in HASHES]).alias("up"),
        (F.col("depth") == F.col("_n_total")).alias("last"),
    )


def id_digests(members: DataFrame) -> DataFrame:
    """(name, sha256) of the ascending, comma-joined conv_ids of each name."""
    ranged = in_ranges(members, ["name", "conv_id"])
    texts = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ranged.groupBy("name", "_part").agg(texts.alias("ids"))
    parts = ranged.select("name", "_part").distinct().groupBy("name").agg(F.count("*").alias("_parts"))
    pieces = stage(pieces.join(parts, "name"), "pieces")
    single = pieces.where("_parts = 1").select("name", F.sha2("ids", 256).alias("sha256"))
    several = pieces.where("_parts > 1").select("name", "_part", "ids").repartition("name").sortWithinPartitions("name", "_part")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for part in slices(batches, 1):
            row = part.to_pylist()[0]
            if row["name"] != name:
                if state:
                    yield pa.RecordBatch.from_pydict({"name": [name], "sha256": [state.hexdigest()]})
                name, state = row["name"], hashlib.sha256(row["ids"].encode())
            else:
                state.update(b"," + row["ids"].encode())
        if state:
            yield pa.RecordBatch.from_pydict({"name": [name], "sha256": [state.hexdigest()]})

    kind = pieces.schema["name"].dataType.simpleString()
    return single.unionByName(several.mapInArrow(digests, f"name {kind}, sha256 string"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, as the module says."""
    rows, shapes = rebuilt(stage(own_turns(turns), "turns"))
    turn = stage(prefixes(rows), "prefixes")
    root = name_of(F.lit(0), [F.lit(0)] * len(HASHES))
    zero = F.lit(0).cast("bigint")
    grouped = turn.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min("up").alias("up")
    )
    top = (
        shapes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
        .where("n_convs > 0")
        .select(root.alias("name"), "conv_id", "n_convs", zero.alias("n_bytes"), F.when(F.lit(False), root).alias("up"))
    )
    named = stage(grouped.unionByName(top), "named")
    above = named.select(F.col("name").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    below = named.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = salted_join(named, above, ["up"], "left").join(below, "name", "left")
    depth = F.col("name.depth")
    nodes = stage(
        nodes.select(
            "name", "conv_id", depth.alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
            F.struct("conv_id", depth.alias("depth")).alias("node"),
            F.when(F.col("up").isNotNull(), F.struct(F.col("parent_conv_id").alias("conv_id"), (depth - 1).alias("depth"))).alias("parent"),
            F.col("n_children").isNull().cast("bigint").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
        ),
        "nodes",
    )
    sums = ["n_leaves", "saved_tokens"]
    totals = subtree_sums(nodes.select("node", "parent", *sums), sums)
    turnless = shapes.where((F.col("taken") == 0) & (F.col("n_own") <= F.col("skipped"))).select(root.alias("name"), "conv_id")
    ends = id_digests(turn.where("last").select("name", "conv_id").unionByName(turnless))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.drop(*sums).join(totals, "node").join(ends, "name", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums, F.coalesce("sha256", none).alias("ends_sha256")
        )
    )
