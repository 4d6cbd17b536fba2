"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

The windows of the benchmark items are the sets; their words are ordered by rarity in the documents,
and since a window must be contained whole, its necessary prefix is its rarest word. Documents are
joined on that word at its position: the window must then begin at the first word or later and end
at the last word or sooner (position and length bounds), and the words at its place are compared
one by one (exact containment). A window with a word that no document has cannot occur.

Where the windows are few enough to be broadcast, a document's words meet them in the task that reads
it. Beyond that, only the places of prefix words travel, and not the texts: (document, place, word) is
shuffled by word to the windows that begin with it, places out of bounds are dropped, and the windows
that are left go to their documents, each once, to be compared.

Words are joined in lower case of all scripts, which finds at least what lower-casing A-Z finds;
the comparison at the end lower-cases A-Z alone.

Defined results: null or empty texts have no words; items without words have no window; rows of one
doc_id and one text share their hits and each give a row; a null doc_id is kept; empty tables give
no hits. Of an item_id that is repeated, each row's windows count for that id; a null item_id is
listed as an empty name. Texts of any length are taken whole; columns of docs besides doc_id and the
text play no part and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import dropped, free, lower_az, staged

#: What separates words, before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of words or windows that are broadcast at most; beyond, places of words are shuffled to them.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """The words of a text, case as it stands; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _fits(df: DataFrame, size: Column) -> bool:
    """Whether df may be broadcast, by its measured size."""
    return (df.agg(F.sum(size + F.lit(64))).first()[0] or 0) <= BROADCAST_BYTES


def windows(items: DataFrame, size: int) -> DataFrame:
    """(item, window): the distinct runs of size words, or all words of an item with fewer."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(lower_az(F.col("text"))).alias("w"))
    w = w.filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return w.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, size).alias("window")).distinct()


def hits(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(marks, window items): marks has doc_id, text_key, at, n (first word and length) and window of each occurrence."""
    owned = staged(windows(items, size), "decontam-windows")
    sets = owned.select("window").distinct()
    parts = sets.select("window", F.posexplode("window").alias("offset", "part")).withColumn("part", F.lower("part"))
    vocabulary = parts.select("part").distinct()
    tokens = docs.select(F.explode(words(F.col(text))).alias("part")).select(F.lower("part").alias("part"))
    if _fits(vocabulary, F.octet_length("part")):
        counted = tokens.join(F.broadcast(vocabulary), "part").groupBy("part").count()
    else:
        counted = tokens.groupBy("part").count().join(vocabulary, "part")
    rarity = staged(counted, "decontam-rarity")
    found = parts.join(rarity, "part", "left").groupBy("window").agg(
        F.min(F.struct("count", "part", "offset")).alias("rarest"), F.min(F.coalesce("count", F.lit(0))).alias("least")
    )
    prefix = found.filter("least > 0").select(F.col("rarest.part").alias("part"), F.col("rarest.offset").alias("offset"), "window")
    prefix = staged(prefix, "decontam-prefix")
    dropped(rarity)
    key = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")
    rows = docs.select("doc_id", key, words(F.col(text)).alias("w"))
    places = rows.select("doc_id", "text_key", "w", F.posexplode("w").alias("pos", "word")).withColumn("part", F.lower("word"))
    at, n = F.col("pos") - F.col("offset"), F.size("window")
    inside = (at >= 0) & (at + n <= F.col("n_words"))
    same = lower_az(F.array_join(F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, F.greatest("n", F.lit(0))), " ")) == F.array_join("window", " ")
    if _fits(prefix, F.octet_length(F.array_join("window", " ")) + 16 * F.size("window")):
        marks = places.withColumn("n_words", F.size("w")).join(F.broadcast(prefix), "part").filter(inside)
        marks = marks.select("doc_id", "text_key", at.alias("at"), n.alias("n"), "window", "w").filter(same).drop("w")
    else:
        places = places.select("doc_id", "text_key", F.size("w").alias("n_words"), "pos", "part")
        asked = places.join(prefix, "part").filter(inside).select("doc_id", "text_key", at.cast("int").alias("at"), n.alias("n"), "window")
        asked = staged(asked, "decontam-asked").withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
        on = rows["doc_id"].eqNullSafe(asked["_doc_id"]) & (rows["text_key"] == asked["_text_key"])
        marks = rows.join(asked, on).filter(same).select("doc_id", "text_key", "at", "n", "window")
    marks = staged(marks, "decontam-marks")
    dropped(prefix)
    return marks, owned


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    found, owned = hits(docs, items, size, text)
    whole = F.col(text)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(whole, F.lit(""))).alias("text_key"), F.size(words(whole)).cast("long").alias("n_words"))
    key = ["doc_id", "text_key"]
    places = found.select(*key, "at", "n").distinct().select(*key, F.explode(F.expr("sequence(at, at + n - 1)")).alias("pos")).distinct()
    n_hit = places.groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    names = found.select(*key, "window").distinct().join(owned, "window").select(*key, "item").distinct()
    named = names.groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = _left(_left(rows, n_hit), named)
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def _left(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Left join on the rows' key; a null doc_id is equal to a null doc_id."""
    more = more.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    on = rows["doc_id"].eqNullSafe(more["_doc_id"]) & (rows["text_key"] == more["_text_key"])
    return rows.join(more, on, "left").drop("_doc_id", "_text_key")


def clean(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text") -> DataFrame:
    """The rows of docs in which no window of an item occurs, with their columns."""
    marks, _ = hits(docs, items, size, text)
    own = [free(docs, "_doc_id"), free(docs, "_text_key")]
    bad = marks.select(F.col("doc_id").alias(own[0]), F.col("text_key").alias(own[1])).distinct()
    key = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[own[0]]) & (key == bad[own[1]]), "left_anti")
