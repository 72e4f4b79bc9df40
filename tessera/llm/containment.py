"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document when at least `threshold` of its distinct
word shingles occur in it. Items are partitioned by size (powers of two of
their shingle count); each partition has its own MinHash sketch length, the
least that cannot miss: of n shingles at most n - ceil(threshold * n) may be
absent, so one more than that, taken as the item's smallest hash values, always
includes one that is present. As the sketch keeps the smallest hashes, each
partition also has a ceiling, and a document's hashes above the highest
ceiling are dropped before any lookup. Documents too small for a partition
are not searched for it. A hit in the sketch makes a candidate; candidates
are verified by the exact containment of the shingles as strings.

Only built-in functions are used. The items' sketch is broadcast after its
row count has been checked against `broadcast_rows`; beyond that the lookup is
a join with salted keys, so that a passage in a third of all documents is split.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; an item of fewer than
five words is one shingle of all its words, looked up at that length.

Defined results: null or blank texts and items match nothing; rows with a
null id are left out; repeated documents are one row per id and item, repeated
items likewise; other columns are not read; empty tables give no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, words

SHINGLE = 5
THRESHOLD = 0.75
BROADCAST_ROWS = 200_000
SALTS = 64


def shingles(w: Column, k: int) -> Column:
    """Distinct shingles of k words as strings."""
    n = F.size(w)
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.when(n >= k, F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))


def hashes(w: Column, k: int) -> Column:
    """Hashes of the shingles of k words, repeats included."""
    n = F.size(w)
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " ")))
    return F.when(n >= k, all_).otherwise(F.array().cast("array<bigint>"))


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, k, n, g): the distinct shingles of each item, k their length in words."""
    w = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), words(ascii_lower(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    sets = reduce(DataFrame.unionByName, [w.where((F.size("w") == k) if k < SHINGLE else (F.size("w") >= k)).select("item", F.lit(k).alias("k"), shingles(F.col("w"), k).alias("g")) for k in range(1, SHINGLE + 1)])
    one = sets.groupBy("item", "k").agg(F.array_distinct(F.flatten(F.collect_list("g"))).alias("g"))  # a repeated item is one item
    return one.select("item", "k", F.size("g").alias("n"), F.explode("g").alias("g"))


def sketches(shingled: DataFrame, threshold: float) -> DataFrame:
    """(item, k, band, need, h): the smallest hashes of each item, as many as its size partition asks for."""
    sized = shingled.withColumn("band", F.floor(F.log2(F.col("n"))).cast("int")).withColumn("h", F.xxhash64("g"))
    need = F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int")
    per = sized.groupBy("k", "band", "item").agg(F.max(need).alias("need"), F.max(F.col("n") - need + 1).alias("s"), F.sort_array(F.collect_list("h")).alias("hs"))
    length = per.groupBy(F.col("k").alias("k2"), F.col("band").alias("band2")).agg(F.max("s").alias("len"), F.min("need").alias("least"))
    both = per.join(length, (F.col("k") == F.col("k2")) & (F.col("band") == F.col("band2")))
    return both.select("item", "k", "band", "least", F.explode(F.slice("hs", F.lit(1), F.least(F.col("len"), F.size("hs")))).alias("h"))


def _lookup(found: DataFrame, table: DataFrame, keys: list[str], rows: int, broadcast_rows: int, salts: int) -> DataFrame:
    if rows <= broadcast_rows:
        return found.join(F.broadcast(table), keys)
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """(doc id, item id, n_shingles, n_found, containment) of each item found in a document."""
    shingled = stored(item_shingles(items, item_col, item_text), "item_shingles")
    sketch = stored(sketches(shingled, threshold), "item_sketches")
    # One row per shingle length and size partition: at most 5 x 31.
    bands = sketch.groupBy("k", "band").agg(F.max("h").alias("ceiling"), F.min("least").alias("least"), F.count(F.lit(1)).alias("rows")).collect()
    rows = shingled.count()
    text = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    tokens = text.select("doc", words(ascii_lower(F.col("text"))).alias("w"))

    def side(k: int) -> DataFrame:
        own = [b for b in bands if b.k == k]
        top, least = max(b.ceiling for b in own), min(b.least for b in own)
        found = tokens.where(F.size("w") >= least + k - 1).select("doc", F.size("w").alias("nw"), F.explode(F.filter(hashes(F.col("w"), k), lambda h: h <= F.lit(top))).alias("h"))
        part = sketch.where(F.col("k") == k).select("h", "item", "least")
        hits = _lookup(found, part, ["h"], sum(b.rows for b in own), broadcast_rows, salts)
        return hits.where(F.col("nw") >= F.col("least") + k - 1).select("doc", "item")

    lengths = sorted({b.k for b in bands})
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_col} {items.schema[item_col].dataType.simpleString()}, n_shingles int, n_found long, containment double"
    if not lengths:
        return docs.sparkSession.createDataFrame([], schema)
    candidates = stored(reduce(DataFrame.unionByName, [side(k) for k in lengths]).distinct(), "candidates")
    suspects = text.join(candidates.select("doc").distinct(), "doc", "left_semi").select("doc", words(ascii_lower(F.col("text"))).alias("w"))
    grams = reduce(DataFrame.unionByName, [suspects.select("doc", F.lit(k).alias("k"), F.explode(shingles(F.col("w"), k)).alias("g")) for k in lengths])
    shared = _lookup(grams, shingled.select("item", "k", "n", "g"), ["k", "g"], rows, broadcast_rows, salts)
    counted = shared.join(candidates, ["doc", "item"], "left_semi").groupBy("doc", "item").agg(F.max("n").alias("n_shingles"), F.count_distinct("g").alias("n_found"))
    return (counted.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("n_found") >= F.lit(threshold) * F.col("n_shingles") - 1e-9)
            .select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_shingles", "n_found", "containment"))


SQL = r"""
WITH w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
 UNION ALL SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
items AS (SELECT id, len(ws) AS nw, least(5, len(ws)) AS k, ws FROM w WHERE side = 1 AND len(ws) > 0),
ig AS (SELECT DISTINCT id, k, array_to_string(ws[i:i+k-1], ' ') AS g FROM (SELECT id, k, ws, unnest(range(1, nw - k + 2)) AS i FROM items)),
n AS (SELECT id, count(*) AS n FROM ig GROUP BY id),
lengths AS (SELECT DISTINCT k FROM items),
dg AS (SELECT DISTINCT id, k, array_to_string(ws[i:i+k-1], ' ') AS g FROM (SELECT id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, lengths WHERE side = 0 AND len(ws) >= k)),
hit AS (SELECT dg.id AS doc_id, ig.id AS item_id, count(*) AS f FROM dg JOIN ig ON dg.k = ig.k AND dg.g = ig.g GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(f AS BIGINT) AS n_found, f / n AS containment
FROM hit JOIN n ON n.id = hit.item_id WHERE f >= 0.75 * n - 1e-9
"""
