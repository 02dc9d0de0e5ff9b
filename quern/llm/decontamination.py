"""Benchmark items inside documents: size-partitioned MinHash containment search, with DataFrame functions only.

1. Documents are far longer than items, so signatures are of the items alone and asymmetric: items are partitioned by
   the size of their shingle sets, and an item of a partition with sizes up to u is signed with the ``u - ceil(t u) + 1``
   first shingles of its set (a bottom-k MinHash), in order of hash, those that many items share after rarer ones.  A
   document that contains a share ``t`` of the item misses at most ``n - ceil(t n)`` of its shingles and so must
   contain one of its signature: the search loses nothing, whatever the lengths.
2. Documents probe the table of signatures with the hashes of their shingles.  A hit makes a candidate: a pair of a
   document and an item.
3. Only the candidates are verified: the shingles of their documents, as text, are counted in the whole sets of their
   items.

Tables of items, and the keys of candidates and of documents that go, are broadcast if counted small enough, else both
sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.arrays import let
from quern.llm.blocks import documents, durable

WORDS = 5
PERCENT = 75
#: Rows of a table (an item's shingle, a document's key) up to which it is broadcast.
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _runs(words: Column, k: int, one) -> Column:
    """``one`` of each start of a ``k``-word run, of the whole text if it has fewer words."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: one(i))).when(n > 0, F.array(one(F.lit(0))))


def shingles(text: Column, k: int) -> Column:
    """The distinct ``k``-word runs of a text."""
    return F.array_distinct(let(_words(text), lambda w: _runs(w, k, lambda i: F.array_join(F.slice(w, i + 1, k), " "))))


def _hash_of_words(word_hash, k: int) -> Column:
    return F.xxhash64(*[word_hash(j) for j in range(k)])


def _shingle_hashes(text: Column, k: int) -> Column:
    """Hashes of the same runs, from hashes of words; a text of fewer words is padded with nulls."""
    return F.array_distinct(let(F.transform(_words(text), lambda w: F.xxhash64(w)), lambda h: _runs(h, k, lambda i: _hash_of_words(lambda j: F.get(h, i + j), k))))


def item_sets(items: DataFrame, item_id: str, text: str, k: int) -> DataFrame:
    """``item_id, item_h, n_item, shingles``: each different item with its set."""
    sets = items.select(F.col(item_id).cast("long").alias("item_id"), F.array_sort(shingles(F.col(text).cast("string"), k)).alias("shingles")).where("size(shingles) > 0")
    return sets.dropDuplicates(["item_id", "shingles"]).select("item_id", F.xxhash64("shingles").alias("item_h"), F.size("shingles").cast("long").alias("n_item"), "shingles")


def signatures(each: DataFrame, k: int, percent: int) -> DataFrame:
    """``s, item_id, item_h``: the hashes that sign each item; ``each``: ``item_id, item_h, n_item, shingle``."""
    split = F.split("shingle", " ")
    hashed = each.withColumn("s", let(F.transform(split, lambda w: F.xxhash64(w)), lambda h: _hash_of_words(lambda j: F.get(h, F.lit(j)), k)))
    shared = each.groupBy("shingle").agg(F.floor(F.log2(F.count(F.lit(1)))).alias("often"))
    most = (F.pow(F.lit(2.0), F.floor(F.log2("n_item")) + 1) - 1).cast("long")  # the greatest size of the partition
    length = most - F.ceil(most * percent / 100).cast("long") + 1
    place = F.row_number().over(Window.partitionBy("item_id", "item_h").orderBy("often", F.xxhash64("s"), "shingle"))  # an item's shingles, which are short texts'
    return hashed.join(shared, "shingle").withColumn("place", place).where(F.col("place") <= length).select("s", "item_id", "item_h")


def _maybe_broadcast(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def candidates(docs: DataFrame, signed: DataFrame, words: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, h, item_id, item_h``: the pairs of which the document (``doc_id, text, h``) holds a shingle of the item's signature."""
    each = docs.select("doc_id", "h", F.explode(_shingle_hashes(F.col("text"), words)).alias("s"))
    return each.join(_maybe_broadcast(signed, broadcast_rows), "s").select("doc_id", "h", "item_id", "item_h").distinct()


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *, words: int = WORDS, percent: int = PERCENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of every document that holds at least ``percent`` of an item's shingles.

    Words are runs of other than ASCII white space, in lower case. Null and wordless texts contain nothing and aren't
    contained; rows with a null document id are looked at like others and reported with it, equal rows each; several
    rows with one item id stand for several items of that name. An empty table gives an empty result; extra columns
    are ignored; whole texts are searched, however long.
    """
    found = _found(docs, items, doc_id, text, item_id, item_text, words, percent, broadcast_rows)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _found(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, words: int, percent: int, broadcast_rows: int) -> DataFrame:
    sets = durable(item_sets(items, item_id, item_text, words))
    each = sets.select("item_id", "item_h", "n_item", F.explode("shingles").alias("shingle"))
    # rows are known by what they hold, not by a number that a retried task might give anew; equal rows are counted
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    pairs = durable(candidates(own, signatures(each, words, percent), words, broadcast_rows))
    keys = _maybe_broadcast(pairs.select(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).distinct(), broadcast_rows)
    chosen = own.join(keys, (F.col("h") == F.col("of_h")) & F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    held = chosen.select("doc_id", "h", F.explode(shingles(F.col("text"), words)).alias("shingle"))
    hits = held.join(_maybe_broadcast(each, broadcast_rows), "shingle").groupBy("doc_id", "h", "item_id", "item_h", "n_item", "shingle").agg(F.count(F.lit(1)).alias("copies"))
    shared = hits.groupBy("doc_id", "h", "item_id", "item_h", "n_item").agg(F.count(F.lit(1)).alias("n_shared"), F.max("copies").alias("copies"))
    enough = shared.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).alias("e")
    p = pairs.alias("p")
    same = (F.col("e.h") == F.col("p.h")) & (F.col("e.item_h") == F.col("p.item_h")) & F.col("e.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("e.item_id").eqNullSafe(F.col("p.item_id"))
    return enough.join(p, same, "left_semi")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *, words: int = WORDS, percent: int = PERCENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents without those that hold an item, whole rows and all columns, nulls too; texts aren't shuffled while the keys of what goes are few."""
    found = durable(_found(docs, items, doc_id, text, item_id, item_text, words, percent, broadcast_rows).select(F.col("doc_id").alias("found_id"), F.col("h").alias("found_h")).distinct())
    found = _maybe_broadcast(found, broadcast_rows)
    same = docs[doc_id].cast("long").eqNullSafe(found["found_id"]) & (F.xxhash64(docs[text].cast("string")) == found["found_h"])
    return docs.join(found, same, "left_anti")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _oracle() -> str:
    def sets(name: str, key: str) -> str:
        w = f"SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {name}"
        return f"SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {WORDS} THEN [array_to_string(w[i:i + {WORDS - 1}], ' ') for i in range(1, len(w) - {WORDS - 2})] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM ({w})"

    return f"""
WITH d AS ({sets("documents", "doc_id")}), b AS ({sets("benchmark", "item_id")}), n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item, count(*) / n_item AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * {PERCENT}
"""


ORACLE_SQL = _oracle()
