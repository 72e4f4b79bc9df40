"""Quality rules: text statistics and cross-document line frequency.

Per text: words, symbols, repeated lines, words in repeated windows. Across
documents: each non-blank line is normalised (lower case, white space
squeezed) and hashed, the distinct documents of a host that hold it are
counted, and a line above the host's limit

    least(max_docs, greatest(min_docs, max_share * documents of the host))

is removed from every document but the host's first (smallest id). A document
that loses more than `max_loss` of its words is depleted and rejected.

Only built-in functions are used. Lines, not texts, are shuffled: the counts
are pre-aggregated per host and line, and the lines above a limit come back
as one map per host, broadcast while all of them together stay below
`broadcast_rows`; beyond that they are joined line by line, the line side
salted, so a line held by a third of all documents is split.

Defined results: a null text has no words and fails the base rules; a null
host is a host of its own; rows with a null id count as one document, as do
repeated rows with one id; every input row gives one output row; blank and
very long texts need no special case; input columns named like an output are
replaced; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, stored, words

MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of words in repeated windows
WINDOW = 8
MIN_DOCS = 10
MAX_DOCS = 10_000
MAX_SHARE = 0.02
MAX_LOSS = 0.5
BROADCAST_ROWS = 200_000
SALTS = 64

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def lines_of(text: Column) -> Column:
    """The `\\n`-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda l: F.length(F.btrim(l, F.lit(WS))) > 0)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.regexp_replace(F.btrim(line, F.lit(WS)), r"[\x20\x09-\x0D]+", " ")))


def repeated_words(w: Column) -> Column:
    """Words inside windows that occur twice or more, all occurrences included.

    Window hashes are compared first; only texts with a repeat sort them.
    Sorted by (hash, place), a window is repeated when a neighbour has its
    hash; places in order then add the words not covered before."""
    n = F.size(w)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def count(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def found(s: Column) -> Column:
            def twin(x: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(s, k - 1)["h"] == x["h"])
                return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        places = F.element_at(F.transform(F.array(ranked), found), 1)
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, zero, lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(WINDOW))).alias("n"), i.alias("last")))["n"]

    def either(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(count(h))

    return F.element_at(F.transform(F.array(hashes), either), 1)


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base statistics and `base_failed`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.withColumn("_w", words(F.col(text_col))).withColumn("_l", lines_of(F.col(text_col)))
            .withColumns({
                "n_words": F.size("_w").cast("long"),
                "word_chars": F.length(F.array_join("_w", "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
                "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
                "n_repeat_words": repeated_words(F.col("_w")),
            })
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
            .drop("_w", "_l"))


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line, n_docs, first_doc) of the lines above their host's limit."""
    slim = docs.select(docs[host_col].alias("host"), docs[id_col].alias("doc"), docs[text_col].alias("text"))
    held = slim.select("host", "doc", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), line_hash))).alias("line"))
    # Held at least once by each document: (host, line, doc) once, then counted; both steps combine before the shuffle.
    once = held.groupBy("host", "line", "doc").agg(F.lit(1).alias("one"))
    counts = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("first_doc")).where(F.col("n_docs") > min_docs)
    hosts = slim.groupBy("host", "doc").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    limit = F.least(F.lit(float(max_docs)), F.greatest(F.lit(float(min_docs)), F.lit(max_share) * F.col("host_docs")))
    joined = counts.alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
    return joined.where(F.col("n_docs") > limit).select("c.host", "line", "n_docs", "first_doc")


def _with_map(docs: DataFrame, over: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """`_kept`: the lines left, by one broadcast map per host."""
    maps = over.groupBy(F.col("host").alias("_host")).agg(F.map_from_entries(F.collect_list(F.struct("line", F.struct("first_doc")))).alias("_over"))
    both = docs.join(F.broadcast(maps), F.col(host_col).eqNullSafe(F.col("_host")), "left").drop("_host")
    # A struct around the first id tells "not above the limit" from a null id.
    hit = lambda l: F.col("_over")[line_hash(l)]
    stays = lambda l: hit(l).isNull() | hit(l)["first_doc"].eqNullSafe(F.col(id_col))
    return both.withColumn("_gone", F.when(F.col("_over").isNull(), F.array().cast("array<string>")).otherwise(F.filter(lines_of(F.col(text_col)), lambda l: ~stays(l)))).drop("_over")


def _with_join(docs: DataFrame, over: DataFrame, id_col: str, text_col: str, host_col: str, salts: int) -> DataFrame:
    """`_gone` again, by a salted join on host and line."""
    salted = docs.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(salts)).cast("int"))
    key = [F.col(id_col), F.col(host_col), F.col(text_col)]
    held = salted.select(F.xxhash64(*key).alias("_key"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_md5"), F.col(id_col).alias("_doc"), F.col(host_col).alias("_host"), "_salt",
                         F.explode(F.array_distinct(lines_of(F.col(text_col)))).alias("_line")).distinct()
    spread = over.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    gone = held.join(spread, F.col("_host").eqNullSafe(F.col("host")) & (line_hash(F.col("_line")) == F.col("line")) & (F.col("_salt") == F.col("_salt2")) & ~F.col("first_doc").eqNullSafe(F.col("_doc")))
    # Bounded: one document's own lines.
    per_doc = gone.groupBy("_key", "_md5").agg(F.collect_set("_line").alias("_set"))
    keyed = docs.withColumn("_k", F.xxhash64(*key)).withColumn("_m", F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    both = keyed.join(per_doc, (F.col("_k") == F.col("_key")) & (F.col("_m") == F.col("_md5")), "left")
    none = F.array().cast("array<string>")
    return both.withColumn("_gone", F.when(F.col("_set").isNull(), none).otherwise(F.filter(lines_of(F.col(text_col)), lambda l: F.array_contains(F.col("_set"), l)))).drop("_k", "_m", "_key", "_md5", "_set")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS, broadcast_rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """The input columns and: the base statistics, base_failed, n_removed_lines,
    n_left_words, depleted, kept, clean_text (the text without its removed lines)."""
    added = (*STATS, "base_failed", "n_removed_lines", "n_left_words", "depleted", "kept", "clean_text")
    docs = docs.drop(*(c for c in docs.columns if c in added and c not in (id_col, text_col, host_col)))
    over = stored(frequent_lines(docs, id_col, text_col, host_col, min_docs, max_docs, max_share), "lines")
    if over.count() <= broadcast_rows:
        marked = _with_map(docs, over, id_col, text_col, host_col)
    else:
        marked = _with_join(docs, over, id_col, text_col, host_col, salts)
    marked = text_stats(marked, text_col)
    lost = F.size(words(F.array_join("_gone", "\n")))
    left = F.col("n_words") - lost
    rest = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda l: ~F.array_contains(F.col("_gone"), l)), "\n")
    return (marked.withColumn("n_removed_lines", F.size("_gone").cast("long")).withColumn("n_left_words", left.cast("long"))
            .withColumn("depleted", F.col("n_left_words") < (1 - max_loss) * F.col("n_words"))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
            .withColumn("clean_text", F.when(F.size("_gone") == 0, F.col(text_col)).otherwise(rest)).drop("_gone"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], chr(1)) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
base AS (SELECT w.doc_id, source, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
                length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
ln AS (SELECT doc_id, source, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
              len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS lw FROM (SELECT doc_id, source, unnest(ls) AS l FROM w)),
hosts AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM d GROUP BY source),
freq AS (SELECT ln.source, line, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM ln GROUP BY ln.source, line),
over_limit AS (SELECT f.* FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE n_docs > least(10000.0, greatest(10.0, 0.02 * host_docs))),
lost AS (SELECT ln.doc_id, count(*) AS n_removed_lines, sum(lw) AS lw FROM ln JOIN over_limit o ON ln.source IS NOT DISTINCT FROM o.source AND ln.line = o.line AND ln.doc_id <> o.first_doc GROUP BY ln.doc_id),
x AS (SELECT b.*, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
             coalesce(n_removed_lines, 0) AS n_removed_lines, n_words - coalesce(lw, 0) AS n_left_words FROM base b LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       CAST(n_removed_lines AS BIGINT) AS n_removed_lines, CAST(n_left_words AS BIGINT) AS n_left_words,
       (NOT base_failed AND NOT (n_left_words < 0.5 * n_words)) AS kept FROM x
"""
