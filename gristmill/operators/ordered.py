"""Ordered sets and prefix indexes as queries over a column of distinct keys.

On sorted or range-partitioned Parquet the comparisons with literals prune row groups by their minimum and
maximum; nothing is kept in memory between queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.plans.ranking import positions
from gristmill.session import cut

# --- ordered set -------------------------------------------------------------------------------------


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """(key): the distinct keys that are not null."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()


def insert(keys: DataFrame, new: DataFrame) -> DataFrame:
    return keys.select("key").union(new.select("key")).distinct()


def delete(keys: DataFrame, gone: DataFrame) -> DataFrame:
    """Keys that are absent are no matter."""
    return keys.join(gone.select("key").distinct(), "key", "left_anti")


def contains(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, found) for the distinct asked keys."""
    hit = keys.select(F.col("key").alias("k"), F.lit(True).alias("hit"))
    a = asked.select("key").distinct()
    return a.join(hit, F.col("key") == F.col("k"), "left").select("key", F.coalesce("hit", F.lit(False)).alias("found"))


def search(keys: DataFrame, x) -> DataFrame:
    """(key): x if it is a key, else the greatest key below it; null if there is none."""
    return keys.where(F.col("key") <= x).agg(F.max("key").alias("key"))


def ceiling(keys: DataFrame, x) -> DataFrame:
    """Keys from x on, in order."""
    return keys.where(F.col("key") >= x).orderBy("key")


def floor(keys: DataFrame, x) -> DataFrame:
    """Keys up to x, in order."""
    return keys.where(F.col("key") <= x).orderBy("key")


def successor(keys: DataFrame, x) -> DataFrame:
    return keys.where(F.col("key") > x).agg(F.min("key").alias("key"))


def predecessor(keys: DataFrame, x) -> DataFrame:
    return keys.where(F.col("key") < x).agg(F.max("key").alias("key"))


def neighbours(keys: DataFrame, by: list[str]) -> DataFrame:
    """(by, key, prev, next): each key's neighbours within its group. Keys meet by their places in the group, so a group of
    any size is spread over the cluster."""
    ranked = cut(positions(keys.select(*by, "key"), ["key"], by, "gm_k"))
    out = ranked
    for name, step in (("prev", 1), ("next", -1)):
        beside = ranked.select(*[F.col(c).alias(f"gm_{name}_{c}") for c in by], (F.col("gm_k") + step).alias(f"gm_{name}"), F.col("key").alias(name))
        on = F.col("gm_k") == F.col(f"gm_{name}")
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"gm_{name}_{c}"))
        out = out.join(beside, on, "left")
    return out.select(*by, "key", "prev", "next")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return insert(a, b)


def extent(keys: DataFrame) -> DataFrame:
    """(size, first, last)."""
    return keys.agg(F.count("key").alias("size"), F.min("key").alias("first"), F.max("key").alias("last"))


def exists(keys: DataFrame, x, order: int = 3) -> DataFrame:
    """(found) of one key. ValueError for an order (keys a page) under 3, as a page tree needs."""
    if order < 3:
        raise ValueError("order must be 3 or more")
    return keys.where(F.col("key") == x).agg((F.count(F.lit(1)) > 0).alias("found"))


# --- prefixes ------------------------------------------------------------------------------------------


def add_keys(keys: DataFrame, new: DataFrame) -> DataFrame:
    """The keys with the new ones; an empty new key fails the query."""
    bad = F.when(F.length("key") == 0, F.raise_error(F.lit("empty key")).cast("string")).otherwise(F.col("key"))
    return keys.select("key").union(new.where(F.col("key").isNotNull()).select(bad.alias("key"))).distinct()


def count_new(keys: DataFrame, new: DataFrame) -> DataFrame:
    """(n_new): distinct keys of new that keys lacks."""
    return new.select("key").distinct().join(keys, "key", "left_anti").agg(F.count("key").alias("n_new"))


def has_key(keys: DataFrame, x: str) -> DataFrame:
    if x == "":
        return keys.sparkSession.range(1).select(F.lit(False).alias("found"))
    return exists(keys, x)


def starts_with(keys: DataFrame, prefix: str) -> DataFrame:
    """(found): whether a key has the prefix; the empty prefix is none. The test reaches the scan."""
    if prefix == "":
        return keys.sparkSession.range(1).select(F.lit(False).alias("found"))
    return keys.where(F.col("key").startswith(prefix)).agg((F.count(F.lit(1)) > 0).alias("found"))


def with_prefix(keys: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """Keys with the prefix other than the prefix itself, in order, at most limit; none for a limit under 1."""
    out = keys.where(F.col("key").startswith(prefix) & (F.col("key") != prefix)).orderBy("key")
    return out if limit is None else out.limit(max(0, limit))


def longest_prefixes(keys: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """(text, prefix) of the distinct texts: the longest key that each begins with, empty if none.

    Every text asks for its prefixes of those lengths that some key has: an equi-join, not a comparison
    of all texts with all keys. Keys have at most as many lengths as the longest of them has characters.
    """
    k = keys.select(F.col("key").alias("k"))
    t = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    lengths = k.agg(F.sort_array(F.collect_set(F.length("k"))).alias("lengths"))
    fitting = F.expr("transform(filter(lengths, n -> n <= length(text)), n -> left(text, n))")
    asked = t.join(F.broadcast(lengths)).select("text", F.explode(fitting).alias("p"))  # one row of distinct lengths
    hit = asked.where("p <> ''").join(k, F.col("p") == F.col("k"))
    best = hit.groupBy("text").agg(F.max_by("p", F.length("p")).alias("prefix")).withColumnRenamed("text", "t")
    return t.join(best, F.col("text") == F.col("t"), "left").select("text", F.coalesce("prefix", F.lit("")).alias("prefix"))


# --- text index ----------------------------------------------------------------------------------------

#: Words that an index leaves out.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, doc_id, tf) of lower-case words that are no stop words."""
    words = F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    terms = docs.select(F.col(doc_id).alias("doc_id"), words.alias("term")).where("term <> ''").where(~F.col("term").isin(STOP_WORDS))
    return terms.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def tf_idf(index: DataFrame, n_docs: int, terms: list[str]) -> DataFrame:
    """(doc_id, score): sum of tf ln(N / df) over the query terms."""
    some = index.where(F.col("term").isin(terms))
    df = some.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumnRenamed("term", "t")
    return some.join(df, F.col("term") == F.col("t")).groupBy("doc_id").agg(
        F.sum(F.col("tf") * F.ln(F.lit(float(n_docs)) / F.col("df"))).alias("score")
    )
