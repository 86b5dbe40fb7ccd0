"""Merkle manifest of a dataset: a tree of hashes for each source, one over the sources, and a proof for each row.

A leaf is the digest of a row's fields.  Leaves are sorted by source and doc_id and numbered; each 16 consecutive nodes of
a tree become one stored run: its members' digests, its own digest and the place that this has in the run above (parent
link).  Trees of sources end in one node, which is a leaf of the tree over the sources.  Levels are written as they are
built; each is a sixteenth of the one below.

Proofs come from recursive queries over the stored runs.  One ascends for each leaf and folds the leaf's digest as it is
found now (tampered or not) with the siblings stored on the way.  The siblings above a leaf's own run are the same for all
its leaves, so a second ascent appends them once for each run, and the leaf's own run is put in front.  A stored run is
copied once for every 4096 leaves below it and a leaf meets the copy of its own block, so that the runs near the root,
which all leaves pass, never gather them in one task.

Nulls in any field have a digest of their own ("-"); null sources are a source that sorts first, null doc_ids sort first
within it.  Rows that repeat a doc_id are leaves of their own, in the order of their digests.  A source of one row has its
leaf as subroot; with one source the root is its subroot.  An empty table has no rows and no root.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .shared import written

FIELDS, FAN, BLOCK = ("doc_id", "source", "lang", "n_chars", "text"), 16, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The tree over the sources.
TOP = -1


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(F.lit(""), *parts), 256)


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Each field as `-` if null, else its length in UTF-8 bytes, a colon and its value."""
    def told(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))
    return digest(*map(told, fields.values()))


@dataclass
class Manifest:
    """leaves: a row each with its place _at, leaf, and its run (tree, run, slot); runs: the stored levels; root: a digest.

    runs is None where there are none: no row at all, or a single one, which is the root.
    """
    leaves: DataFrame
    runs: DataFrame
    root: str | None


def _levels(nodes: DataFrame, most: int, fan: int) -> list[DataFrame]:
    """The written levels of runs over nodes (tree, place, hash, lo, hi, n nodes of its tree); the largest tree has `most`."""
    out = []
    while most > 1:
        up = nodes.where("n > 1").withColumn("run", F.expr(f"place div {fan}")).groupBy("tree", "run").agg(
            F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.first("n").alias("n"))
        up = up.select("tree", F.lit(len(out) + 1).alias("level"), "run", F.col("m.hash").alias("members"), "lo", "hi",
                       F.expr(f"(n + {fan - 1}) div {fan}").alias("n"))
        out.append(written(up.withColumn("hash", digest(F.array_join("members", "")))))
        nodes, most = out[-1].withColumn("place", F.col("run")), -(-most // fan)
    return out


def build_manifest(docs: DataFrame, leaf: Column, keep: dict[str, Column], group: str = "source", order: str = "doc_id",
                   fan: int = FAN) -> Manifest:
    """The tree over the rows of docs: a tree for each value of `group`, its leaves in `order`, and one over these."""
    told = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], told.alias("_told"), F.col(order).alias("_order"), leaf.alias("leaf"))
    rows = numbered(rows, F.col("_told") != "-", "_told", "_order", "leaf").withColumn("_block", F.expr(f"_at div {BLOCK}"))
    # A tree's leaves stand together, its first place is its number.  Blocks keep the rows of a large one apart.
    parts = rows.groupBy("_told", "_block").agg(F.min("_at").alias("lo"), F.count("*").alias("n"))
    trees = parts.groupBy("_told").agg(F.min("lo").alias("tree"), F.sum("n").alias("n"))
    rows = written(rows.join(parts.select("_told", "_block").join(trees, "_told"), ["_told", "_block"]))
    most = rows.agg(F.max("n")).first()[0]
    if most is None:
        return Manifest(rows, None, None)

    base = rows.select("tree", (F.col("_at") - F.col("tree")).alias("place"), F.col("leaf").alias("hash"),
                       F.col("_at").alias("lo"), F.col("_at").alias("hi"), "n")
    levels = _levels(base, most, fan)
    ends = base.where("n = 1").select("tree", "hash", "lo", "hi")
    for level in levels:
        ends = ends.unionByName(level.where("n = 1").select("tree", "hash", "lo", "hi"))
    ends = numbered(ends, "lo", name="place")
    count = ends.count()
    top = ends.select(F.lit(TOP).cast("long").alias("tree"), "place", "hash", "lo", "hi", F.lit(count).cast("long").alias("n"))
    top_levels = _levels(top, count, fan)
    root = (top_levels[-1] if top_levels else ends).select("hash").first()[0]

    # Parent links: up within a tree, from a source's end to its place over the sources, from the root nowhere.
    places = ends.select("tree", F.col("place").alias("above"))
    if count == 1:
        places = places.withColumn("above", F.lit(None).cast("long"))
    nothing = F.lit(None).cast("long").alias("above")
    within = [x.where("n > 1").withColumn("above", F.col("run")).withColumn("up_tree", F.col("tree")) for x in levels + top_levels]
    over = [x.where("n = 1").join(places, "tree").withColumn("up_tree", F.when(F.col("above").isNotNull(), TOP)) for x in levels]
    last = [x.where("n = 1").select("*", nothing).withColumn("up_tree", F.lit(None)) for x in top_levels]
    runs = None
    for x in within + over + last:
        x = x.select("tree", "level", "run", "members", "hash", "lo", "hi", (F.col("n") == 1).alias("ends"),
                     F.col("up_tree").cast("long").alias("up_tree"),
                     F.when(F.col("up_tree") == F.col("tree"), F.col("level") + 1).when(F.col("above").isNotNull(), 1).alias("up_level"),
                     F.expr(f"above div {fan}").alias("up_run"), F.expr(f"cast(above % {fan} as int)").alias("up_slot"))
        runs = x if runs is None else runs.unionByName(x)

    place = F.col("_at") - F.col("tree")
    many = rows.where("n > 1").withColumn("above", place).withColumn("in_tree", F.col("tree"))
    lone = rows.where("n = 1").join(places, "tree").withColumn("in_tree", F.when(F.col("above").isNotNull(), TOP).cast("long"))
    leaves = many.unionByName(lone).select(
        *keep, "_at", "leaf", F.col("in_tree").alias("tree"), F.expr(f"above div {fan}").alias("run"),
        F.expr(f"cast(above % {fan} as int)").alias("slot"))
    return Manifest(written(leaves), None if runs is None else written(runs), root)


def _ascend(starts: DataFrame, runs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The last row of the climb of each of starts (id, tree, level, run, slot, block and the first values of `fields`).

    fields: what to keep, by name, as SQL of a row `c` and the run `r` that it passes.  A climb ends where no run is above.
    """
    spark = starts.sparkSession
    copies = runs.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {BLOCK}"), F.expr(f"hi div {BLOCK}"))))
    view, over = (f"merkle_{uuid.uuid4().hex}" for _ in range(2))
    written(starts.select("id", "block", "tree", "level", "run", "slot", *fields)).createOrReplaceTempView(view)
    written(copies).createOrReplaceTempView(over)
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return written(spark.sql(f"""
            WITH RECURSIVE climb(id, block, tree, level, run, slot, {", ".join(fields)}) AS (
                SELECT * FROM {view}
                UNION ALL
                SELECT c.id, c.block, r.up_tree, r.up_level, r.up_run, r.up_slot, {", ".join(fields.values())}
                FROM climb c JOIN {over} r ON c.tree = r.tree AND c.level = r.level AND c.run = r.run AND c.block = r.block)
            SELECT id, {", ".join(fields)} FROM climb WHERE tree IS NULL"""))
    finally:
        spark.conf.set(limit, before)
        spark.catalog.dropTempView(view)
        spark.catalog.dropTempView(over)


def fold(starts: DataFrame, runs: DataFrame, fan: int = FAN) -> DataFrame:
    """(id, hash) of the root that each of starts (id, block, tree, level, run, slot, hash) comes to."""
    others = (f"array_join(slice(r.members, 1, c.slot), '')", f"array_join(slice(r.members, c.slot + 2, {fan}), '')")
    return _ascend(starts, runs, {"hash": f"sha2(concat({others[0]}, c.hash, {others[1]}), 256)"})


def proof_tails(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """(tree, run, members, subroot, tail) of each run of leaves: the siblings above it, from the lowest to the root.

    subroot is null where the leaves are subroots themselves.
    """
    first = runs.where("level = 1").select(
        F.concat_ws(":", "tree", "run").alias("id"), F.expr(f"lo div {BLOCK}").alias("block"), F.col("up_tree").alias("tree"),
        F.col("up_level").alias("level"), F.col("up_run").alias("run"), F.col("up_slot").alias("slot"),
        F.when((F.col("tree") != TOP) & F.col("ends"), F.col("hash")).alias("subroot"), F.lit("").alias("tail"))
    siblings = f"array_join(slice(r.members, 1, c.slot), ''), array_join(slice(r.members, c.slot + 2, {fan}), '')"
    tails = _ascend(first, runs, {"subroot": f"coalesce(c.subroot, if(r.ends and r.tree <> {TOP}, r.hash, null))",
                                  "tail": f"concat(c.tail, {siblings})"})
    return runs.where("level = 1").select(F.concat_ws(":", "tree", "run").alias("id"), "tree", "run", "members").join(tails, "id").drop("id")


def prove(manifest: Manifest, keep: tuple[str, ...], claim: str = "claim", fan: int = FAN) -> DataFrame:
    """keep, leaf, subroot, root, proof_sha256, folded_root, verified: each leaf's `claim` folded with the stored siblings."""
    leaves, runs, root = manifest.leaves, manifest.runs, manifest.root
    out = [F.col(k) for k in keep] + [F.col("leaf")]
    if runs is None:  # no row, or a single one
        folded = F.col(claim)
        return leaves.select(*out, F.col("leaf").alias("subroot"), F.lit(root).alias("root"), digest().alias("proof_sha256"),
                             folded.alias("folded_root"), (folded == F.lit(root)).alias("verified"))
    starts = leaves.select(F.col("_at").alias("id"), F.expr(f"_at div {BLOCK}").alias("block"), "tree", F.lit(1).alias("level"),
                           "run", "slot", F.col(claim).alias("hash"))
    folded = fold(starts, runs, fan).select(F.col("id").alias("_at"), F.col("hash").alias("folded_root"))
    own = F.concat(F.array_join(F.expr("slice(members, 1, slot)"), ""), F.array_join(F.expr(f"slice(members, slot + 2, {fan})"), ""))
    # The wide tails come last, where the digest is taken at once.
    return leaves.join(folded, "_at").join(proof_tails(runs, fan), ["tree", "run"]).select(
        *out, F.coalesce("subroot", "leaf").alias("subroot"), F.lit(root).alias("root"),
        F.sha2(F.concat(own, "tail"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def document_manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """The proofs of whole documents; where `tampered` holds, the text found now is the stored one with A-Z lower-cased."""
    fields = {k: F.col(k) for k in FIELDS}
    found = leaf_digest(fields | {"text": F.translate("text", UPPER, LOWER)})
    leaf = leaf_digest(fields)
    return prove(build_manifest(docs, leaf, {"doc_id": F.col("doc_id"), "claim": F.when(tampered, found).otherwise(leaf)}), ("doc_id",))
