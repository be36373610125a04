"""Removal of benchmark passages from training texts: shared word n-grams, found with a broadcast hash set.

Texts are lower-cased (A to Z only) and split into words. An item's windows are all its runs of `WORDS`
words, or all its words where it has fewer. The 64-bit hashes of the distinct windows go to every executor
in blocks of at most `BLOCK` hashes (some 100 MB), whatever the number of items is; each window of a
document is hashed and looked up, in one scan for a block, and never leaves its task unless it hits. A hit
takes its words along, and joins the items by the words themselves, which verifies it. Only DataFrame
functions are used.

Rows find their hits by (id, digest of the text), so rows with an id of their own, without one or with the
same one are told apart, and repeated rows get the same result. Hits go into the shuffle as one row for each
document, place and window; a passage in many documents is spread by document, a document's hits are bounded
by its words.

Defined results: null and empty texts and items have no words and hit nothing; the digest of no items is that
of the empty text; repeated items count once for each distinct item_id, a null item_id not at all (its windows
still hit); texts of any length are read whole; an empty benchmark leaves all documents clean; an empty table
gives no rows; other columns, whatever they are called, are kept by decontaminate and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

WORDS = 10
#: Hashes of one broadcast; larger benchmarks take another scan for each block.
BLOCK = 2_000_000
#: Windows of a part of a text.
PART = 64
# The characters that are not part of a word, and the letters that are lower-cased.
SEPARATORS, WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def words(text: Column) -> Column:
    """The words of a text, A to Z in lower case; plain ASCII words take the faster way."""
    return F.transform(raw_words(text), lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))


def item_windows(benchmark: DataFrame, n: int = WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, length, gram (words joined by blanks), hash of each item's windows."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(_text(text_col)).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("length", F.least(F.size("w"), F.lit(n)))
    each = items.select("item_id", "length", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1), lambda i: F.slice("w", i, F.col("length")))).alias("g"))
    return each.select("item_id", "length", F.array_join("g", " ").alias("gram"), F.xxhash64("g").alias("hash")).distinct()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, text of each row, null texts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.md5(_text(text_col)).alias("digest"), _text(text_col).alias("text"))


def _scanned(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, digest, part, w (the words of a part), at, hash of each window of a length.

    A text is cut into parts of PART windows, so a window's row carries some words and not its whole text. Arrays
    are bound to lambdas' variables, so that a text is split once and not for each part or window.
    """
    bound = lambda array, f: F.transform(F.array(array), f)[0]
    starts = lambda n, step: F.when(n >= length, F.sequence(F.lit(1), n - length + 1, F.lit(step)))
    parts = bound(words(F.col("text")), lambda w: F.transform(starts(F.size(w), PART), lambda i: F.slice(w, i, PART + length - 1)))
    each = docs.select("doc_id", "digest", F.posexplode(parts).alias("part", "w"))
    return each.select("doc_id", "digest", "part", "w", F.posexplode(bound("w", lambda w: F.transform(starts(F.size(w), 1), lambda i: F.xxhash64(F.slice(w, i, length))))).alias("at", "hash"))


def hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """doc_id, digest, at (from 1), length, item_id: the windows of items in documents (keyed), each once."""
    sets = grams.groupBy("length").agg(F.countDistinct("hash").alias("n")).collect()  # at most WORDS rows
    found = None
    for length, count in sorted((r["length"], r["n"]) for r in sets):
        scanned = _scanned(docs, length)
        blocks = -(-count // BLOCK)
        for block in range(blocks):
            mine = grams.where((F.col("length") == length) & (F.pmod(F.col("hash"), F.lit(blocks)) == block)).select("hash").distinct()
            hit = scanned.join(F.broadcast(mine), "hash", "left_semi")
            rows = hit.select("doc_id", "digest", (F.col("part") * PART + F.col("at") + 1).alias("at"), F.lit(length).alias("length"), F.array_join(F.slice("w", F.col("at") + 1, length), " ").alias("gram"))
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.select("doc_id", "digest", F.lit(0).alias("at"), F.lit(0).alias("length")).limit(0).join(grams.select("item_id"), F.lit(False))
    return found.join(grams.select("length", "gram", "item_id"), ["length", "gram"]).select("doc_id", "digest", "at", "length", "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, digest, spans (from, to: words, end exclusive, merged and sorted), n_hit, items of the documents that hold a window."""
    grams = written(item_windows(benchmark, n))
    each = hits(docs, grams)
    places = each.select("doc_id", "digest", "at", "length", "item_id").distinct()
    per_doc = places.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("length")).alias("end")))).alias("p"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    start = F.array().cast("array<struct<from:int,to:int>>")
    span = lambda a, b: F.array(F.struct(a.alias("from"), b.alias("to")))

    def merged(spans: Column, p: Column) -> Column:
        last = F.element_at(spans, -1)
        joined = F.concat(F.slice(spans, 1, F.size(spans) - 1), span(last["from"], F.greatest(last["to"], p["end"])))
        return F.when((F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["to"] >= p["at"]), joined).otherwise(F.concat(spans, span(p["at"], p["end"])))

    spans = F.aggregate("p", start, merged)
    merged_rows = per_doc.select("doc_id", "digest", spans.alias("spans"), F.array_sort("items").alias("items"))
    return merged_rows.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"]))


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.digest") == F.col("r.digest"))
    return rows.alias("l").join(found.alias("r"), same, "left")


def report(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    slim = keyed(docs, id_col, text_col)
    found = contaminated(slim, benchmark, n)
    counted = slim.select("doc_id", "digest", F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return _joined(counted, found).select(
        "l.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns, without the documents that hold a window, or without the words of the windows.

    With remove = "spans", a hit word goes with what separates it from the next word; all else stays as it is.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    found = contaminated(keyed(docs, id_col, text_col), benchmark, n)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.md5(_text(text_col)).alias("digest"))
    joined = _joined(rows, found)
    if remove == "documents":
        return joined.where("n_hit IS NULL").select("row.*")
    text, spans = F.col(f"row.`{text_col}`"), F.col("spans")
    inside = lambda i: F.exists(spans, lambda s: (i >= s["from"]) & (i < s["to"]))
    parts = F.struct(raw_words(text).alias("w"), F.split(text, WORD).alias("s"))
    rest = F.transform(F.array(parts), lambda p: F.concat(p["s"][0], F.array_join(F.transform(F.sequence(F.lit(1), F.size(p["w"])), lambda i: F.when(inside(i), F.lit("")).otherwise(F.concat(F.element_at(p["w"], i), F.element_at(p["s"], i + 1)))), "")))[0]
    return joined.withColumn("row", F.col("row").withField(f"`{text_col}`", F.when(F.col("n_hit").isNull(), text).otherwise(rest))).select("row.*")


SQL = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    s AS (SELECT item_id, w, least(len(w), {WORDS}) AS m, unnest(range(1, len(w) - least(len(w), {WORDS}) + 2)) AS i FROM b WHERE len(w) > 0),
    g AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS gram FROM s),
    x AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM g) WHERE len(w) >= m),
    h AS (SELECT x.doc_id, x.i, x.m, g.item_id FROM x JOIN g ON g.m = x.m AND g.gram = array_to_string(x.w[x.i:x.i + x.m - 1], ' ')),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
