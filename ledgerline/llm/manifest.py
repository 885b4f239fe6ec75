"""Operator 12: a Merkle manifest of a dataset, level by level with windows.

A node's digest is the SHA-256 (lowercase hex) of its children's digests.  At
each level nodes are partitioned by group and parent index; the ordered
full-frame collect_list of a partition is both the parent's preimage and the
siblings of each member.  One row per parent, with its run of children, goes
on to the next level, a FAN-th of the size.  Proofs come back down the same
tables: a node's siblings, then those of its parent.  No task holds more than
the runs dealt to it; leaves are numbered by ranges (numbering.positions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize
from ledgerline.operators.numbering import positions

FAN = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """A document's digest with ``text`` in the place of its own."""
    return digest(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text))


def group_key(source: Column) -> Column:
    """A source as a key without nulls, in the same order: null first, then bytewise."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def tree(nodes: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(proofs, roots) of nodes (of, idx, members, digest), a forest with a tree for each ``of``.

    idx counts from 0 without gaps among the ``members`` of a group; ``of`` has
    no nulls.  proofs has the columns of nodes, any others included, with
    ``proof``, an array of what stands left and right of the node's own digest
    in its run, from the leaf's level up, and ``top``, its group's root.  roots
    is (of, top).  A group of one is its own root with an empty proof.
    """
    most = nodes.agg(F.max("members")).first()[0] or 0
    level, parents = nodes.select("of", "idx", "members", "digest"), []
    roots = [level.where("members = 1")]
    while most > 1:
        window = W.partitionBy("of", "parent").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        runs = level.where("members > 1").withColumn("parent", F.expr(f"idx div {fan}")).withColumn("run", F.collect_list("digest").over(window))
        one = runs.where(f"idx % {fan} = 0").select("of", F.col("parent").alias("idx"), F.expr(f"(members + {fan - 1}) div {fan}").alias("members"), digest(F.array_join("run", "")).alias("digest"), "run")
        parents.append(materialize(one, "merkle-level"))
        level = parents[-1].drop("run")
        roots.append(level.where("members = 1"))
        most = -(-most // fan)

    def tops(level: DataFrame) -> DataFrame:
        return level.where("members = 1").withColumn("proof", F.array().cast(_STEP)).withColumn("top", F.col("digest"))

    def down(level: DataFrame, above: DataFrame) -> DataFrame:
        """Proofs of a level from those of its parents, which hold the runs."""
        at = (F.col("n.idx") % fan).cast("int")
        # the run without the node itself
        step = F.struct(F.array_join(F.slice("p.run", F.lit(1), at), "").alias("left"), F.array_join(F.slice("p.run", at + 2, F.lit(fan)), "").alias("right"))
        joined = level.where("members > 1").withColumn("parent", F.expr(f"idx div {fan}")).alias("n").join(above.alias("p"), (F.col("n.of") == F.col("p.of")) & (F.col("n.parent") == F.col("p.idx")))
        found = joined.select(*(F.col(f"n.`{c}`") for c in level.columns), F.concat(F.array(step), F.col("p.proof")).alias("proof"), F.col("p.top").alias("top"))
        return found.unionByName(tops(level))

    above: DataFrame | None = None
    for level in reversed(parents):
        above = tops(level) if above is None else materialize(down(level, above), "merkle-proofs")
    proofs = tops(nodes) if above is None else down(nodes, above)
    top = roots[0]
    for more in roots[1:]:
        top = top.unionByName(more)
    return proofs, top.select("of", F.col("digest").alias("top"))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(proof, start, lambda own, step: digest(step["left"], own, step["right"]))


def siblings(proof: Column) -> Column:
    """The proof's digests, level by level and from left to right, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(doc_id, of, digest, tampered): a document's leaf, and its leaf with ``changed`` as its text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", group_key(F.col("source")).alias("of"), leaf(F.col("text")).alias("digest"), (leaf(F.col("text")) if changed is None else changed).alias("tampered"))


def lowered_fifth() -> Column:
    """The leaf of a text whose A-Z are lower-cased where 5 divides the CRC-32 of the decimal doc_id; null of the others."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, leaf(F.translate("text", _UPPER, _LOWER)))


def manifest(docs: DataFrame, changed: Column | None = None, fan: int = FAN) -> DataFrame:
    """One row per row of docs: doc_id, source, leaf, subroot, root, proof, tampered.

    ``proof`` leads from the leaf to the root over its source's subroot;
    ``tampered`` is the leaf given by ``changed``, an expression over the
    documents' columns, or the leaf itself where that is null.  In a source
    leaves ascend by doc_id, null first, then by digest; rows that are wholly
    equal have equal leaves and take neighbouring places.  Null sources are
    one source, the first.  Nulls in any column have their own mark in the
    leaf, so null and empty texts differ.  Other columns are not read.  No
    rows give no rows.
    """
    each = materialize(leaves(docs, changed), "merkle-leaves")
    placed = materialize(positions(each, "of", [F.col("doc_id"), F.col("digest")], "idx", "members"), "merkle-places")
    proofs, subroots = tree(placed, fan)
    sources = positions(materialize(subroots, "merkle-subroots").withColumn("all", F.lit("")), "all", [F.col("of")], "idx", "members")
    upper, _ = tree(sources.select(F.col("all").alias("of"), "idx", "members", F.col("top").alias("digest"), F.col("of").alias("source_of")), fan)
    upper = upper.select(F.col("source_of"), F.col("proof").alias("upper"), F.col("top").alias("root"))
    joined = proofs.join(materialize(upper, "merkle-upper"), F.col("of") == F.col("source_of"))
    source = F.when(F.col("of") == "", F.lit(None)).otherwise(F.substring("of", 2, 1 << 30))
    return joined.select("doc_id", source.alias("source"), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("proof", "upper").alias("proof"), F.coalesce("tampered", "digest").alias("tampered"))


def verified(docs: DataFrame, changed: Column | None = None, fan: int = FAN) -> DataFrame:
    """manifest() with folded_root, from the tampered leaf and the original siblings, and whether it is the root."""
    found = manifest(docs, changed, fan).withColumn("folded_root", fold(F.col("tampered"), F.col("proof")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
