"""A Merkle manifest of a dataset, with stored parent preimages.

Every row is a leaf. The leaves of a language, by doc_id, are hashed in runs of eight until one digest remains; the digests of all
languages likewise give the root. What is stored of a parent is its preimage: the digests of its children, one after the other. A
leaf joins the preimages of its ancestors. Its own digest is 64 characters of the first, its parent's 64 of the next, and so on: what
is left when those are cut out are the siblings of its proof, and a changed leaf put in their place gives the changed root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorepool.llm.common import materialise

#: Children of a parent, and characters of a digest.
FANOUT = 8
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER = "".join(map(chr, range(65, 91)))
_STEP = "struct<preimage:string,slot:int>"


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:` and the value; integers as decimals."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): tree names the language and sorts null first; tampered is null where the row isn't tampered with."""

    def leaf(text: Column) -> Column:
        return digest(F.concat(*[field(F.col(c) if c != "text" else text) for c in FIELDS]))

    text = F.col("text").cast("string")
    third = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), F.col("lang").cast("string")))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(text).alias("leaf"), F.when(third, leaf(F.translate(text, _UPPER, _UPPER.lower()))).alias("tampered"))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with idx, their place (from 0) among those of their group, and n, the group's size, written to a table.

    Rows are dealt by ranges of (group, order), those equal in all of that by their place in the input, so neither a large group nor many
    equal rows gather in one task; what is summed over tasks are numbers, one for each task and group.
    """
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie")
    held = materialise(ranged.drop("_tie").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)
    sizes = held.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    return held.join(sizes, [group, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def levels(n: int) -> int:
    """Parents above a leaf of a tree with n leaves."""
    many = 0
    while n > 1:
        n, many = -(-n // FANOUT), many + 1
    return many


@dataclass
class Tree:
    """The parents of each level, lowest first, as tables (tree, idx, n, preimage), n counting the level's nodes of that tree."""

    parents: list[DataFrame]
    leaves: DataFrame

    def roots(self) -> DataFrame:
        """(tree, subroot) of every tree."""
        tops = [p.where("n = 1").select("tree", digest(F.col("preimage")).alias("subroot")) for p in self.parents]
        out = self.leaves.where("n = 1").select("tree", F.col("leaf").alias("subroot"))
        for top in tops:
            out = out.unionByName(top)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """(tree, idx, steps) for each parent of leaves, steps leading from a leaf (whose own slot is still 0) to the last ancestor:
        preimages and the slot in each. above gives (tree, steps) beyond the root of each tree."""
        nodes = None
        for level in reversed(self.parents):
            tops = level.where("n = 1").join(above, "tree").select("tree", "idx", "preimage", F.col("steps").alias("beyond"))
            if nodes is not None:
                slot = (F.col("idx") % FANOUT).cast("int")
                up = nodes.select("tree", F.col("idx").alias("_up"), "steps")
                low = level.where("n > 1").withColumn("_up", F.expr(f"idx div {FANOUT}")).join(up, ["tree", "_up"])
                beyond = F.transform("steps", lambda s, i: F.struct(s["preimage"].alias("preimage"), F.when(i == 0, slot).otherwise(s["slot"]).alias("slot")))
                tops = tops.unionByName(low.select("tree", "idx", "preimage", beyond.alias("beyond")))
            first = F.array(F.struct(F.col("preimage").alias("preimage"), F.lit(0).alias("slot")))
            nodes = tops.select("tree", "idx", F.concat(first, F.col("beyond")).alias("steps"))
        return nodes


def grown(nodes: DataFrame, name: str) -> Tree:
    """The tree over nodes (tree, idx, n, leaf). Each level is an eighth of the one below and is written to a table; groups are of at most
    eight rows, so no tree's size matters to any task."""
    parents: list[DataFrame] = []
    below = nodes.select("tree", "idx", "n", F.col("leaf").alias("hash"))
    for level in range(levels(nodes.agg(F.max("n")).first()[0] or 0)):
        children = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        up = below.where("n > 1").withColumn("up", F.expr(f"idx div {FANOUT}")).groupBy("tree", "up").agg(F.max("n").alias("n"), children.alias("children"))
        preimage = F.concat_ws("", F.transform("children", lambda c: c["hash"]))
        parents.append(materialise(up.select("tree", F.col("up").alias("idx"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), preimage.alias("preimage")), f"{name}-{level + 1}"))
        below = parents[-1].select("tree", "idx", "n", digest(F.col("preimage")).alias("hash"))
    return Tree(parents, nodes)


def siblings(steps: Column) -> Column:
    """All siblings of a path, left to right and level by level: each preimage without the 64 characters of its slot."""
    cut = F.transform(steps, lambda s: F.concat(F.substring(s["preimage"], F.lit(1), DIGEST * s["slot"]), F.substring(s["preimage"], DIGEST * s["slot"] + DIGEST + 1, F.lit(DIGEST * FANOUT))))
    return F.concat_ws("", cut)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf gives with the siblings of its path: the digest is put in its slot, the preimage hashed, and so on."""
    return F.aggregate(steps, leaf, lambda h, s: digest(F.overlay(s["preimage"], h, DIGEST * s["slot"] + 1, F.lit(DIGEST))))


@dataclass
class Manifest:
    """leaves (tree, doc_id, leaf, tampered, idx, n), the tree of each language, the tree of their roots, and the root's digest."""

    leaves: DataFrame
    languages: Tree
    top: Tree
    subroots: DataFrame
    root: str

    def proofs(self) -> DataFrame:
        """leaves with subroot and steps, the path from each leaf to the root."""
        none = F.array().cast(f"array<{_STEP}>")
        slot = (F.col("idx") % FANOUT).cast("int")
        own = lambda steps: F.transform(steps, lambda s, i: F.struct(s["preimage"].alias("preimage"), F.when(i == 0, slot).otherwise(s["slot"]).alias("slot")))
        places = self.subroots.select("name", "subroot", "idx")
        if self.top.parents:
            over = self.top.paths(self.subroots.limit(1).select(F.lit("").alias("tree"), none.alias("steps"))).select(F.col("idx").alias("_up"), "steps")
            above = places.withColumn("_up", F.expr(f"idx div {FANOUT}")).join(over, "_up").select(F.col("name").alias("tree"), "subroot", own(F.col("steps")).alias("steps"))
        else:
            above = places.select(F.col("name").alias("tree"), "subroot", none.alias("steps"))
        single = self.leaves.where("n = 1").join(above, "tree")
        if not self.languages.parents:
            return single
        paths = self.languages.paths(above.select("tree", "steps"))
        many = self.leaves.where("n > 1").withColumn("_up", F.expr(f"idx div {FANOUT}")).join(paths.select("tree", F.col("idx").alias("_up"), "steps"), ["tree", "_up"])
        many = many.withColumn("steps", own(F.col("steps"))).drop("_up")
        # the last language preimage hashes to the subroot, which takes no join of a large language's rows with its one row
        depth = F.lit(0)
        for k in range(1, len(self.languages.parents) + 1):
            depth = F.when(F.col("n") > FANOUT ** (k - 1), F.lit(k)).otherwise(depth)
        many = many.withColumn("subroot", digest(F.element_at("steps", depth)["preimage"]))
        return many.unionByName(single.select(many.columns))


def build(docs: DataFrame) -> Manifest | None:
    """The manifest of a table; None where it has no rows."""
    spark = docs.sparkSession
    rows = numbered(materialise(leaves(docs), "leaves"), "tree", ["doc_id", "leaf"], "numbered")
    languages = grown(rows, "manifest")
    names = languages.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("leaf"))
    subroots = numbered(names, "tree", ["name"], "subroots")
    top = grown(subroots, "manifest-top")
    root = top.roots().first()
    if root is None:
        return None
    return Manifest(rows, languages, top, subroots.withColumn("subroot", F.col("leaf")), root["subroot"])


SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verified(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs.

    Null fields count as `-`, also a null text in tampering, empty texts as `0:`; texts of any length are hashed whole. Rows of one
    doc_id are ordered by leaf, null ids come first; repeated rows are leaves of their own, in places next to each other. A null language makes
    a tree of its own. A table of one row has an empty proof. An empty table gives no rows; columns beyond the five, whatever their
    names, are ignored.
    """
    manifest = build(docs)
    if manifest is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    again = folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    out = manifest.proofs().select("doc_id", "leaf", "subroot", F.lit(manifest.root).alias("root"), digest(siblings(F.col("steps"))).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
