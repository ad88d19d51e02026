"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Documents are partitioned by the number of their shingles. A document of a partition is sketched by one-permutation
MinHash with a number of bins that follows the partition's size: each bin keeps its smallest shingle hash. So a long
document has a long sketch, and a short item inside it is still found. An item has one sketch for every partition.
Documents and items that agree in a bin are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import saved

#: Bins for each shingle that a document of a partition can have. A shingle is the smallest of its bin with a chance of
#: 0.79 or more; an item is missed if none of its shared shingles is.
BINS_PER_SHINGLE = 2
#: Items of fewer shingles are looked up by all of them, in all shingles of the documents: nothing can be missed.
SMALL_ITEM = 12
LEVELS = 28  # partitions of documents, of up to 2^level shingles
BROADCAST_ROWS = 2_000_000  # sketch rows (32 MB) that a task may hold whole; more are joined by a shuffle


def word_hashes(text: Column) -> Column:
    """Hashes of the words; words are runs of letters and digits in lower case."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingled(df: DataFrame, size: int) -> DataFrame:
    """`df` with `tokens`: a text of fewer than `size` words is one shingle, one without words has none.

    Read the tokens with `explode_outer`: a condition on them, such as the one that `explode` implies, is moved below
    the projections and then computes the words anew for every shingle.
    """
    df = df.withColumn("words", word_hashes(F.col("text"))).drop("text")
    window = F.transform(
        F.sequence(F.lit(1), F.size("words") - size + 1),
        lambda i: F.xxhash64(*[F.element_at("words", i + F.lit(k)) for k in range(size)]),
    )
    whole = F.when(F.size("words") > 0, F.array(F.xxhash64("words"))).otherwise(F.array().cast("array<bigint>"))
    tokens = F.when(F.size("words") >= size, window).otherwise(whole)
    return df.withColumn("tokens", F.sort_array(F.array_distinct(tokens))).drop("words")


def _bin(token: Column) -> Column:
    """The bin of a hash among `BINS_PER_SHINGLE << level` of equal width; reads the column `level`."""
    bins = F.expr(f"shiftleft({BINS_PER_SHINGLE}L, level)")
    # The upper 32 bits of the hash, scaled; bins beyond 2^31 are more than any text has words.
    return F.shiftrightunsigned(F.shiftrightunsigned(token, 32) * bins, 32)


def _sketch(tokens: Column) -> Column:
    """The smallest hash of each bin; `tokens` ascend, so it is the first of its bin."""
    return F.filter(tokens, lambda x, i: (i == 0) | (_bin(x) != _bin(F.element_at(tokens, F.greatest(i, F.lit(1))))))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8
) -> DataFrame:
    """`doc_id`, `row_hash`, `item_id`, `shared`, `item_shingles`: items of which a document holds at least `threshold` of the distinct shingles.

    Documents are told apart by `doc_id` and the hash of their text, so rows of one id are judged each on its own text;
    null ids take part. Null or empty texts hold nothing, items without words are in nothing, repeated item ids are
    judged each on its own text, and empty tables give no row.

    An item of fewer than `size` words is one shingle of all its words, and only a document of exactly these words holds
    it: longer documents have no shingles of fewer than `size` words.
    """
    items = _shingled(
        benchmark.select("item_id", F.xxhash64("text").alias("item_hash"), "text").where("text is not null").distinct(), size
    ).withColumn("item_shingles", F.size("tokens"))
    items = saved(items.where("item_shingles > 0"))
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    sets = _shingled(rows, size)
    # Never null, for the reason that `_shingled` gives.
    sets = sets.withColumn("level", F.coalesce(F.ceil(F.log2(F.size("tokens").cast("double"))).cast("int"), F.lit(0)))

    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    by_level = items.withColumn("level", F.explode_outer(levels)).where(F.col("item_shingles") >= SMALL_ITEM)
    keys = by_level.select("item_id", "item_hash", "level", F.explode_outer(_sketch(F.col("tokens"))).alias("token"))
    small = items.where(F.col("item_shingles") < SMALL_ITEM)
    small = small.select("item_id", "item_hash", F.lit(-1).alias("level"), F.explode_outer("tokens").alias("token"))
    keys = saved(keys.unionByName(small))
    whole = items.select("item_id", "item_hash", "item_shingles", F.explode_outer("tokens").alias("token"))
    if keys.count() <= BROADCAST_ROWS:
        keys, whole = F.broadcast(keys), F.broadcast(whole)

    sketches = sets.select("doc_id", "row_hash", "level", F.explode_outer(_sketch(F.col("tokens"))).alias("token"))
    if not small.isEmpty():
        every = sets.select("doc_id", "row_hash", F.lit(-1).alias("level"), F.explode_outer("tokens").alias("token"))
        sketches = sketches.unionByName(every)
    candidates = sketches.join(keys, ["level", "token"]).select("doc_id", "row_hash", "item_id", "item_hash").distinct()
    candidates = saved(candidates)

    some = candidates.select("doc_id", "row_hash").distinct()
    if some.count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    same = rows["doc_id"].eqNullSafe(some["doc_id"]) & (rows["row_hash"] == some["row_hash"])
    checked = _shingled(rows.join(some, same, "left_semi"), size)
    checked = checked.select("doc_id", "row_hash", F.explode_outer("tokens").alias("token")).join(whole, "token")
    shared = checked.groupBy("doc_id", "row_hash", "item_id", "item_hash", "item_shingles").agg(
        F.count_distinct("token").alias("shared")
    )
    found = shared.where(F.col("shared") >= F.ceil(F.lit(threshold) * F.col("item_shingles") - F.lit(1e-9)))
    of = found.join(
        candidates.withColumnsRenamed({"doc_id": "d", "row_hash": "r", "item_id": "i", "item_hash": "h"}),
        F.expr("doc_id <=> d and row_hash = r and item_id <=> i and item_hash = h"),
        "left_semi",
    )
    return of.select("doc_id", "row_hash", "item_id", "shared", "item_shingles")


def contamination_table(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """`doc_id`, `n_items`, `items` (distinct item ids ascending, comma-joined), `contaminated` of every row of `docs`."""
    found = contaminated(docs, benchmark, size, threshold)
    lists = found.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    lists = lists.withColumnsRenamed({"doc_id": "d", "row_hash": "r"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"))
    joined = rows.join(lists, F.expr("doc_id <=> d and row_hash = r"), "left")
    ids = F.coalesce("ids", F.array().cast("array<bigint>"))
    return joined.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_items"),
        F.array_join(ids, ",").alias("items"),
        F.col("ids").isNotNull().alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item."""
    found = contaminated(docs, benchmark, size, threshold).select("doc_id", "row_hash").distinct()
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    found = found.withColumnsRenamed({"doc_id": "_found_id", "row_hash": "_found_hash"})
    same = docs["doc_id"].eqNullSafe(found["_found_id"]) & (F.xxhash64(docs["text"]) == found["_found_hash"])
    return docs.join(found, same, "left_anti")


CONTAMINATION_SQL = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') FROM benchmark
), cut AS (
  SELECT kind, id, unnest(CASE
    WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), one AS (SELECT DISTINCT kind, id, s FROM cut
), sizes AS (SELECT id, count(*) AS n FROM one WHERE kind = 1 GROUP BY id
), hits AS (
  SELECT d.id AS doc_id, b.id AS item_id
  FROM one d JOIN one b ON d.kind = 0 AND b.kind = 1 AND d.s = b.s JOIN sizes z ON z.id = b.id
  GROUP BY d.id, b.id, z.n HAVING 5 * count(*) >= 4 * z.n
), lists AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id
)
SELECT d.doc_id, coalesce(l.n, 0) AS n_items, coalesce(l.items, '') AS items, l.n IS NOT NULL AS contaminated
FROM documents d LEFT JOIN lists l USING (doc_id)
"""
