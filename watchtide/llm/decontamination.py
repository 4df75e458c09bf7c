"""Benchmark decontamination by a positional inverted index, in DataFrame expressions only.

The index is a table of postings (term, document, position) of every term of the test set, written once. For each
test window the lists of its two rarest terms are intersected: a posting of the rarest says where the second must
stand, and is looked up there in the second's list. What is left is compared word by word with the window; for that a
block of the document's words is fetched by document and block number. No row ever holds more than a block of words,
and joins are plain ones: Spark broadcasts a side where its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtide.llm.common import materialize

WINDOW = 10
#: Words that a block of a document begins with; a window more follows, which the next block has too.
BLOCK = 512
#: What parts words: all of ASCII but letters and digits.
PARTS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column | str) -> Column:
    """Runs of characters other than PARTS, A-Z in lower case and other letters as they are; none for null.

    One character-wise translation and a split at single spaces: several times faster than a regular expression.
    """
    spaced = F.translate(text, PARTS + UPPER, " " * len(PARTS) + LOWER)
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, width: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, terms): every run of `width` words of an item; the whole item if it has fewer, but some."""
    said = items.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    return said.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i")).select("item", F.slice("w", F.col("i"), F.col("n")).alias("terms")).distinct()


def located(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_doc, _key, _words: words of documents, written once, with a number for every row, so that repeated rows and shared or null keys stay apart."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("_doc"), F.col(key).alias("_key"), words(F.col(text)).alias("_words")), "words")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, _doc, pos) of the given terms in located documents, written once."""
    return materialize(docs.select("_doc", F.posexplode("_words").alias("pos", "term")).join(terms, "term", "left_semi"), "postings")


def rarest(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """terms, a1, at1, a2, at2: each window's rarest terms in the index and their places in it (twice the same in one-word windows).

    Windows with a term that documents don't have are dropped: they can't occur.
    """
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    each = wanted.select("terms", F.posexplode("terms").alias("at", "term"))
    counted = each.join(frequency, "term")
    order = F.sort_array(F.collect_list(F.struct("n", "term", "at")))
    chosen = counted.groupBy("terms").agg(order.alias("o")).where(F.size("o") == F.size("terms"))
    second = F.coalesce(F.try_element_at(F.filter("o", lambda x: x["term"] != F.col("o")[0]["term"]), F.lit(1)), F.col("o")[0])
    return chosen.select("terms", F.col("o")[0]["term"].alias("a1"), F.col("o")[0]["at"].alias("at1"), second["term"].alias("a2"), second["at"].alias("at2"))


def _anchored(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index of located documents, and the windows with their rarest terms."""
    distinct = materialize(wanted.select("terms").distinct(), "distinct")
    postings = index(docs, distinct.select(F.explode("terms").alias("term")).distinct())
    return postings, materialize(rarest(distinct, postings), "rarest")


def phrase_matches(docs: DataFrame, items: DataFrame, width: int = WINDOW, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Exact occurrences of item windows in located documents: (_doc, item, start, n), start counted in the document's words from 0."""
    wanted = materialize(windows(items, width, item, item_text), "windows")
    postings, anchors = _anchored(docs, wanted)
    # windows of one item mostly share their rarest terms: lists are intersected once for each pair at its distance
    gap = F.col("at2") - F.col("at1")
    pairs = anchors.select("a1", "a2", gap.alias("gap")).distinct()
    first = postings.join(pairs, F.col("term") == F.col("a1")).select("_doc", "a1", "a2", "gap", "pos", (F.col("pos") + F.col("gap")).alias("pos2"))
    second = postings.join(pairs.select(F.col("a2").alias("term")).distinct(), "term", "left_semi")
    second = second.select(F.col("term").alias("a2"), "_doc", F.col("pos").alias("pos2"))
    met = materialize(first.join(second, ["a2", "_doc", "pos2"], "left_semi").select("_doc", "a1", "a2", "gap", "pos"), "met")
    near = met.join(anchors.withColumn("gap", gap), ["a1", "a2", "gap"]).select("_doc", "terms", (F.col("pos") - F.col("at1")).alias("start")).where("start >= 0")
    near = near.withColumn("_block", F.floor(F.col("start") / BLOCK).cast("int"))
    some = docs.join(met.select("_doc").distinct(), "_doc", "left_semi")
    blocks = some.select("_doc", "_words", F.explode(F.sequence(F.lit(0), F.floor((F.size("_words") - 1) / BLOCK).cast("int"))).alias("_block"))
    blocks = blocks.select("_doc", "_block", F.slice("_words", F.col("_block") * BLOCK + 1, F.lit(BLOCK + width - 1)).alias("_near"))
    here = F.col("start") - F.col("_block") * BLOCK
    same = F.slice("_near", here + 1, F.size("terms")) == F.col("terms")
    found = near.join(blocks, ["_doc", "_block"]).where(same).select("_doc", "terms", "start")
    return found.join(wanted, "terms").select("_doc", "item", "start", F.size("terms").alias("n"))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, width: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Items with a window whose two rarest terms stand at most `slop` words apart in a document, in either order: (_key, item). A window of one distinct term needs only that."""
    said = located(docs, key, text)
    wanted = materialize(windows(items, width, item, item_text), "windows")
    postings, anchors = _anchored(said, wanted)
    pairs = anchors.select("a1", "a2").distinct()
    size = F.lit(slop + 1)
    first = postings.join(pairs, F.col("term") == F.col("a1")).select("_doc", "a1", "a2", "pos")
    at = F.floor(F.col("pos") / size)
    first = first.withColumn("_near", F.explode(F.array(at - 1, at, at + 1)))
    second = postings.join(pairs.select(F.col("a2").alias("term")).distinct(), "term", "left_semi")
    second = second.select(F.col("term").alias("a2"), "_doc", F.col("pos").alias("pos2"), F.floor(F.col("pos") / size).alias("_near"))
    met = first.join(second, ["a2", "_doc", "_near"]).where(F.abs(F.col("pos") - F.col("pos2")) <= slop).select("_doc", "a1", "a2").distinct()
    found = met.join(anchors, ["a1", "a2"]).join(wanted, "terms").select("_doc", "item").distinct()
    return found.join(said.select("_doc", "_key"), "_doc").select("_key", "item").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of an item window. Null texts have no words; windows of items without
    an id hit like any other, but such items are in neither n_items nor the list; every row is a document of its own, repeated ones and those without an id too; an empty benchmark hits
    nothing; other columns are ignored.
    """
    said = located(docs, key, text)
    hits = materialize(phrase_matches(said, items, width, item, item_text), "hits")
    spans = hits.select("_doc", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = Window.partitionBy("_doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = spans.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("_doc").agg(F.sum("fresh").cast("long").alias("n_hit"))
    names = F.sort_array(F.collect_set(F.col("item").cast("string")))
    found = covered.join(hits.groupBy("_doc").agg(names.alias("names")), "_doc")
    every = said.select("_doc", "_key", F.size("_words").cast("long").alias("n_words"))
    out = every.join(found, "_doc", "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("names", F.array().cast("array<string>"))
    return out.select(
        F.col("_key").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_leaked(docs: DataFrame, items: DataFrame, width: int = WINDOW, text: str = "text", item_text: str = "text") -> DataFrame:
    """Rows of docs, all columns, that hold no window of an item, decided on texts alone: ids of documents and items may be null or shared."""
    digest = lambda c: F.coalesce(F.sha2(F.col(c).cast("binary"), 256), F.lit(""))
    named = items.select(digest(item_text).alias("item_id"), F.col(item_text).alias("text"))
    said = located(docs.select(digest(text).alias("_digest"), F.col(text).alias("text")), "_digest", "text")
    leaked = phrase_matches(said, named, width).select("_doc").distinct().join(said.select("_doc", F.col("_key").alias("_leaked")), "_doc").select("_leaked").distinct()
    return docs.join(leaked, digest(text) == leaked["_leaked"], "left_anti")
