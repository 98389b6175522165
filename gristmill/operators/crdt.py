"""Replicated sequences: atoms (doc, id, value, predecessor_id, tombstone, timestamp, sequence, site_id) that
converge to one text whatever order they arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import cut

ATOM = ["value", "predecessor_id", "timestamp", "sequence", "site_id"]
ROOT = "ROOT"


def merge(*replicas: DataFrame) -> DataFrame:
    """One row per (doc, id); an atom is deleted if any replica has deleted it."""
    out = replicas[0]
    for r in replicas[1:]:
        out = out.unionByName(r)
    return out.groupBy("doc", "id").agg(*[F.min(c).alias(c) for c in ATOM], F.bool_or("tombstone").alias("tombstone"))


def insert(atoms: DataFrame, new: DataFrame) -> DataFrame:
    """The atoms with new ones; a new atom after an unknown one fails the query."""
    known = atoms.select(F.col("doc").alias("kd"), F.col("id").alias("ki")).union(new.select("doc", "id")).distinct().withColumn("known", F.lit(True))
    met = new.join(known, (F.col("doc") == F.col("kd")) & (F.col("predecessor_id") == F.col("ki")), "left")
    lost = F.col("known").isNull() & (F.coalesce("predecessor_id", F.lit(ROOT)) != ROOT)
    ok = F.when(lost, F.raise_error(F.concat(F.lit("unknown predecessor of "), F.col("id"))).cast("string")).otherwise(F.col("id"))
    return merge(atoms, met.withColumn("id", ok).select(*new.columns))


def delete(atoms: DataFrame, gone: DataFrame) -> DataFrame:
    """Sets the tombstone of the atoms (doc, id) in gone; others are no matter."""
    g = gone.select(F.col("doc").alias("gd"), F.col("id").alias("gi"), F.lit(True).alias("g")).distinct()
    return atoms.join(g, (F.col("doc") == F.col("gd")) & (F.col("id") == F.col("gi")), "left").withColumn(
        "tombstone", F.col("tombstone") | F.coalesce("g", F.lit(False))
    ).drop("gd", "gi", "g")


def preorder(atoms: DataFrame) -> DataFrame:
    """Adds pos to the atoms that the root reaches: their place in depth-first order, children of an atom by
    (later timestamp, greater sequence, site, id) first.

    The tour of the tree is a linked list of one entry and one exit per atom; places come from pointer
    doubling, a join a round and about log2 of the atoms rounds, so a document of any length or depth
    is spread over the cluster; only the children of one atom are sorted by one task. Atoms that hang from an unknown one or from a cycle are left out.
    """
    parent = F.coalesce("predecessor_id", F.lit(ROOT))
    nodes = cut(atoms.withColumn("parent", parent))
    by = Window.partitionBy("doc", "parent").orderBy(F.desc("timestamp"), F.desc("sequence"), "site_id", "id")
    kin = nodes.select("doc", "parent", "id", F.lead("id").over(by).alias("sibling"), F.row_number().over(by).alias("k"))
    kin = cut(kin)
    eldest = kin.where("k = 1").select(F.col("doc").alias("ed"), F.col("parent").alias("ep"), F.col("id").alias("child"))
    tree = kin.join(eldest, (F.col("doc") == F.col("ed")) & (F.col("id") == F.col("ep")), "left")
    # An entry leads to the first child's entry or the own exit, an exit to the next sibling's entry or the parent's exit.
    link = tree.select(
        "doc",
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("<"), "id").alias("at"), F.coalesce(F.concat(F.lit("<"), "child"), F.concat(F.lit(">"), "id")).alias("to"), F.lit(1).cast("bigint").alias("w")),
                F.struct(F.concat(F.lit(">"), "id").alias("at"), F.coalesce(F.concat(F.lit("<"), "sibling"), F.concat(F.lit(">"), "parent")).alias("to"), F.lit(0).cast("bigint").alias("w")),
            )
        ).alias("e"),
    ).select("doc", "e.*")
    end = f">{ROOT}"
    now = cut(link)
    rounds = max(1, (2 * nodes.count()).bit_length() + 1)
    for _ in range(rounds):
        if now.where(F.col("to") != end).isEmpty():
            break
        onward = now.select(F.col("doc").alias("d2"), F.col("at").alias("a2"), F.col("to").alias("t2"), F.col("w").alias("w2"))
        met = now.join(onward, (F.col("doc") == F.col("d2")) & (F.col("to") == F.col("a2")), "left")
        new = cut(met.select("doc", "at", F.coalesce("t2", "to").alias("to"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")))
        if new.agg(F.sum("w")).first() == now.agg(F.sum("w")).first() and new.exceptAll(now).isEmpty():
            break
        now = new
    reached = now.where((F.col("to") == end) & F.col("at").startswith("<")).select(F.col("doc").alias("rd"), F.expr("substr(at, 2)").alias("ri"), "w")
    last = reached.groupBy(F.col("rd").alias("ld")).agg(F.max("w").alias("most"))
    placed = reached.join(last, F.col("rd").eqNullSafe(F.col("ld"))).select("rd", "ri", (F.col("most") - F.col("w")).alias("pos"))
    return nodes.drop("parent").join(placed, (F.col("doc") == F.col("rd")) & (F.col("id") == F.col("ri"))).drop("rd", "ri")


def visible(atoms: DataFrame) -> DataFrame:
    """(doc, pos, id, value) of the atoms that show: no tombstone and a value. pos leaves gaps."""
    return preorder(atoms).where("NOT tombstone AND value IS NOT NULL").select("doc", "pos", "id", "value")


def converge(atoms: DataFrame) -> DataFrame:
    """(doc, text, ids) of documents that fit a row; one whose atoms are all hidden has an empty text."""
    own = preorder(atoms)
    shown = F.collect_list(F.when(~F.col("tombstone") & F.col("value").isNotNull(), F.struct("pos", "id", "value")))
    x = own.groupBy("doc").agg(F.array_sort(shown).alias("a"))
    return x.select("doc", F.array_join(F.transform("a", lambda e: e["value"]), "").alias("text"), F.transform("a", lambda e: e["id"]).alias("ids"))
