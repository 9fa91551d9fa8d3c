"""Extracted document pages to one clean text per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip

# What a bare page number looks like, and a page number inside a running line.
PAGE_LINE = r"(?i)^\s*(?:page\s+)?[-–]?\s*\d+\s*(?:of\s+\d+)?\s*[-–]?\s*$"
PAGE_INLINE = r"(?i)page\s+\d+(?:\s+of\s+\d+)?"


def edge_key(line: Column) -> Column:
    """A first or last line with its page number taken out, so that it repeats from page to page."""
    bare = strip(line)
    return F.when(bare.rlike(PAGE_LINE), F.lit("#")).otherwise(F.regexp_replace(bare, PAGE_INLINE, "#"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, page_no, text).

    A page's first or last non-blank line goes when it repeats on at least half of the document's pages (two or
    more); bare page numbers and soft hyphens go; words broken over a line end are joined.
    """
    lines = F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")
    solid = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].rlike(rf"[^{SPACE}]"))
    split = pages.select("doc_id", "page_no", lines.alias("lines"), F.get(solid, 0).alias("first"), F.try_element_at(solid, F.lit(-1)).alias("last"))
    edged = split.withColumn("k1", edge_key(F.col("first.x"))).withColumn("k2", edge_key(F.col("last.x")))
    size = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    counts = edged.select("doc_id", F.explode(F.array_compact(F.array("k1", "k2"))).alias("k")).groupBy("doc_id", "k").agg(F.count("*").alias("c"))
    often = counts.join(size, "doc_id").filter((F.col("n") >= 2) & (F.col("c") >= F.greatest(F.lit(2), F.floor((F.col("n") + 1) / 2))))
    k1 = often.select("doc_id", F.col("k").alias("k1"), F.lit(True).alias("drop1"))
    k2 = often.select("doc_id", F.col("k").alias("k2"), F.lit(True).alias("drop2"))
    marked = edged.join(k1, ["doc_id", "k1"], "left").join(k2, ["doc_id", "k2"], "left")
    gone = F.array_compact(F.array(F.when(F.col("drop1"), F.col("first.i")), F.when(F.col("drop2"), F.col("last.i"))))
    kept = F.filter("lines", lambda x, i: ~F.array_contains(gone, i) & ~x.rlike(PAGE_LINE))
    cleaned = marked.select("doc_id", "page_no", F.array_join(kept, "\n").alias("page"), (F.size(kept) > 0).alias("any"))
    # a document's text is one value; its pages come together for it
    joined = cleaned.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("any"), F.struct("page_no", "page")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["page"]), "\n")
    text = F.replace(text, F.lit("­"), F.lit(""))
    text = F.regexp_replace(text, r"([A-Za-zÀ-ɏ])-\n([a-zÀ-ɏ])", "$1$2")
    return joined.select("doc_id", strip(text).alias("text"))
