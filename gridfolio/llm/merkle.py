"""Merkle manifest of a table: digests of rows, trees of digests, inclusion proofs, by nested-interval labels.

Rows are leaves. The leaves of a tree (a language) are ranked by their id, and every node carries the interval
[lo, hi) of leaf ranks that it covers; a leaf covers [rank, rank + 1). A node of level k lies in bucket
``lo div arity^(k + 1)`` of the level above: children are grouped by bucket into families, and nodes are joined to
their ancestors level by level, by (tree, bucket) and containment of intervals. What a parent's interval has beside a
node's own is the node's siblings, left and right of it. The roots of the trees, in order, are the leaves of one more tree.

Every step is an aggregate or a join with at most ``arity`` rows to a key, so a language that holds all rows is spread
like many small ones. Ranks come from range partitioning and one row per (range, tree). Texts are read once, for the
digests; all later tables hold digests only, and are written to the shared folder level by level.

Defined cases: a null field is ``-``, an empty one ``0:``; null trees and null ids come first; rows that share an id are
ordered by digest, and rows equal in all fields are leaves of their own; a tree of one leaf is that leaf; an empty
table has no root and gives no rows. Columns that are not named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfolio.llm.common import in_order, running_totals, stored

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<left:string,right:string>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the bytes of the value's text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


@dataclass(frozen=True)
class Manifest:
    """Leaves with their labels, families of every level, and the same for the tree of the trees' roots.

    ``leaves`` is (tree, tree_name, id, lo, hi, n, digest, ...): ``tree`` numbers trees in order and ``n`` counts the
    tree's leaves. A family is a node with its children: (tree, lo, hi, n, digest, members).
    """

    leaves: DataFrame
    families: list[DataFrame]
    roots: DataFrame
    top: list[DataFrame]
    arity: int

    def nodes(self) -> DataFrame:
        """(tree, level, lo, hi, digest) of all nodes of the trees, the leaves at level 0."""
        out = self.leaves.select("tree", F.lit(0).alias("level"), "lo", "hi", "digest")
        for level, family in enumerate(self.families, 1):
            out = out.unionByName(family.select("tree", F.lit(level).alias("level"), "lo", "hi", "digest"))
        return out


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Stored rows in order with their range ``part`` and ``place`` in it."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(in_order(rows, order, "part").withColumn("place", place), "ranked")


def _families(nodes: DataFrame, level: int, arity: int) -> DataFrame:
    """The nodes of the next level with their children, of the trees that have several nodes at this one."""
    several = nodes.where(F.col("n") > arity ** (level - 1))
    member = F.struct("lo", "hi", "digest")
    made = several.groupBy("tree", F.expr(f"lo div {arity**level}L").alias("bucket")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
    digest = F.sha2(F.array_join(F.transform("members", lambda m: m["digest"]), ""), 256)
    first, last = F.get("members", F.lit(0)), F.element_at("members", -1)
    return stored(made.select("tree", first["lo"].alias("lo"), last["hi"].alias("hi"), "n", digest.alias("digest"), "members"), "families")


def _grown(leaves: DataFrame, arity: int) -> list[DataFrame]:
    most = leaves.agg(F.max("n")).first()[0] or 0
    families: list[DataFrame] = []
    while arity ** len(families) < most:
        families.append(_families(families[-1] if families else leaves, len(families) + 1, arity))
    return families


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", key: str = "doc_id", arity: int = ARITY, also: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table; ``also`` names further columns that the leaves carry along."""
    hashed = docs.select(F.col(tree).alias("tree_name"), F.col(key).alias("id"), leaf_digest(*[docs[f] for f in fields]).alias("digest"), *[c.alias(n) for n, c in (also or {}).items()])
    # numbered as stored, so that equal rows can be dealt over ranges
    hashed = stored(hashed, "hashed").withColumn("row", F.monotonically_increasing_id())
    ranked = _ranked(hashed, ["tree_name", "id", "digest", "row"])
    before = running_totals(ranked.withColumn("one", F.lit(1)), "part", {"before": "one"})
    # one row per (range, tree): where the tree begins, how many leaves it has
    parts = ranked.groupBy("part", "tree_name").agg(F.min("place").alias("place"), F.count("*").alias("n")).join(before, "part")
    trees = parts.groupBy("tree_name").agg(F.min(F.col("before") + F.col("place")).alias("tree"), F.sum("n").alias("n"))
    known = trees.withColumnRenamed("tree_name", "name")
    parts = parts.drop("n").join(known, F.col("tree_name").eqNullSafe(F.col("name"))).select("part", F.col("tree_name").alias("name"), "before", "tree", "n")
    parts = stored(parts, "parts").withColumnRenamed("part", "of")
    rank = F.col("before") + F.col("place") - F.col("tree")
    leaves = ranked.join(parts, (F.col("part") == F.col("of")) & F.col("tree_name").eqNullSafe(F.col("name")))
    leaves = leaves.select("tree", "tree_name", "id", rank.alias("lo"), (rank + 1).alias("hi"), "n", "digest", *(also or {}))

    families = _grown(leaves, arity)
    roots = leaves.where("n = 1").select("tree", "tree_name", "digest")
    for level, family in enumerate(families, 1):
        tops = family.where((F.col("n") <= arity**level)).select("tree", "digest")
        roots = roots.unionByName(tops.join(trees.select("tree", "tree_name"), "tree").select("tree", "tree_name", "digest"))
    in_turn = _ranked(roots, ["tree"])
    offsets = running_totals(in_turn.withColumn("one", F.lit(1)), "part", {"before": "one"})
    n_trees = in_turn.count()
    rank = F.col("before") + F.col("place")
    roots = in_turn.join(offsets, "part").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("of"), "tree_name", rank.alias("lo"), (rank + 1).alias("hi"), F.lit(n_trees).cast("long").alias("n"), "digest")
    roots = stored(roots, "roots")
    return Manifest(leaves, families, roots, _grown(roots, arity), arity)


def _descend(nodes: DataFrame, parents: DataFrame | None, level: int, arity: int, carry: list[str]) -> DataFrame:
    """Nodes of a level below the root with the path and columns of the parent that contains them, their own siblings first."""
    size = arity ** (level + 1)
    above = parents.select(F.col("tree").alias("p_tree"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("members").alias("p_members"), F.col("path").alias("p_path"), *carry)
    inside = (F.col("tree") == F.col("p_tree")) & F.expr(f"lo div {size}L = p_lo div {size}L") & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
    joined = nodes.where(F.col("n") > arity**level).join(above.hint("merge"), inside)

    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter("p_members", keep), lambda m: m["digest"]), "")

    step = F.struct(side(lambda m: m["hi"] <= F.col("lo")).alias("left"), side(lambda m: m["lo"] >= F.col("hi")).alias("right"))
    return joined.withColumn("path", F.concat(F.array(step), "p_path")).drop("p_tree", "p_lo", "p_hi", "p_members", "p_path")


def _paths(leaves: DataFrame, families: list[DataFrame], arity: int, seeds: DataFrame, carry: list[str]) -> DataFrame:
    """Leaves with ``path`` and the columns ``carry`` of their tree; ``seeds`` is (tree, path, carry...), one row per tree."""
    levels = [leaves, *families]
    parents: DataFrame | None = None
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level]
        below = None if parents is None else _descend(nodes, parents, level, arity, carry)
        # a tree whose nodes have met in one ends here
        roots = nodes.where((F.col("n") <= arity**level) & (F.col("n") > (arity ** (level - 1) if level else 0)))
        here = roots.join(seeds, "tree").select(*nodes.columns, "path", *carry)
        here = here if below is None else here.unionByName(below.select(*here.columns))
        parents = stored(here, "paths") if level else here
    return parents


def with_paths(made: Manifest) -> DataFrame:
    """Leaves with ``path`` (siblings left and right of every ancestor, lowest first), ``subroot`` and ``root``."""
    tops = made.top[-1] if made.top else made.roots
    whole = tops.select("tree", F.array().cast(f"array<{_STEP}>").alias("path"), F.col("digest").alias("root"))
    trees = _paths(made.roots, made.top, made.arity, whole, ["root"])
    seeds = stored(trees.select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "seeds")
    return _paths(made.leaves, made.families, made.arity, seeds, ["subroot", "root"])


def proof_digest(path: Column) -> Column:
    """One digest of all siblings on a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def audited(docs: DataFrame, tampered: dict[str, Column], where: Column) -> DataFrame:
    """Every row's proof, and whether its row as found (columns replaced by ``tampered`` ``where`` that holds) still verifies."""
    other = leaf_digest(*[tampered.get(f, docs[f]) for f in FIELDS])
    made = manifest(docs, also={"other": F.when(F.coalesce(where, F.lit(False)), other)})
    rows = with_paths(made)
    found = folded(F.coalesce("other", "digest"), F.col("path"))
    rows = rows.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), found.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    """The text with its A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def document_proofs(docs: DataFrame) -> DataFrame:
    """Proofs of all documents; those whose id's check sum 3 divides are found with lower-cased texts."""
    return audited(docs, {"text": lowered(docs["text"])}, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0)


def verify(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """Rows (digest, path) with ``verified``: whether they lead to a root that was published elsewhere."""
    return rows.withColumn("verified", folded(F.col("digest"), F.col("path")) == F.lit(root))
