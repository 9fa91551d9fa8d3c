"""Spelling variants: words one edit apart, found by walking a trie that is a distributed edge table.

The vocabulary's trie is a table of edges: a node is the hash of a prefix, an edge holds the next two characters (or the
last one) and whether a word ends there. A search state is (word, edited word, position); its node is the prefix that
it has walked. While there is no edit the node is the word's own prefix, so those states are written down without a
walk. A join with the edges spawns the states with one edit: another character in the word's place, or one more. From
there the rest of the word must match: each level joins the frontier with the edges of its nodes and moves all states
on. States that end on a word's node are neighbours.

One edit leaves a half of the word as it is. So one trie holds the words and another the reversed words, each search
makes its edit in the second half only, and the crowded nodes near the roots are never spread. A removed character is
the other word's added one, an exchanged one is found from the word with the smaller character, and an added character
equal to the next is the same as one added later: each pair of words is met once or twice, not once for every way.

The frontier's size follows the vocabulary, which a count of the text's words has reduced before.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import store
from .words import limit_batches

LEAST_LETTERS, LEAST_TIMES, RATIO = 5, 3, 2
ONE_IN = 97  # of the words of a text, by checksum, lose a character
LEVELS = 3  # of the trie that a frontier walks between two checkpoints
_HELD = 200_000  # distinct words that a task counts before it hands them on

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the batches' texts; a word may come several times."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    total: Counter[str] = Counter()
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            seed = zlib.crc32(f"{'' if name is None else name}:".encode())
            for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                h = zlib.crc32(word.encode(), seed)
                if h % ONE_IN == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < LEAST_LETTERS:
                        continue
                total[word] += n
            if len(total) > _HELD:
                yield out()
                total.clear()
    yield out()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of Latin letters of all texts, A-Z lower-cased, one in `ONE_IN` of a text's words with a letter less.

    Words have `LEAST_LETTERS` code points and `LEAST_TIMES` occurrences at least. Null and empty texts have none; a null
    id counts as an empty one; repeated rows count again; other columns aren't read.
    """
    limit_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("string").alias("doc_id"), docs[text].cast("string").alias("text"))
    counted = rows.mapInArrow(_counted, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES)


def _node(spelled: str, end) -> F.Column:
    return F.xxhash64("way", F.substring(F.col(spelled), F.lit(1), end))


def _two(spelled: str, position) -> F.Column:
    """The next characters that a level walks: two, or the last one."""
    return F.substring(F.col(spelled), position + 1, F.lit(2))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of distinct words of the column `word` that differ by one edit of a code point.

    Null words are left out, repeated ones count once, words may have any length; an empty table gives an empty result.
    """
    words = words.select("word").filter("word IS NOT NULL").distinct()
    spelled = words.select(F.lit(0).alias("way"), F.col("word").alias("s")).union(words.select(F.lit(1), F.reverse("word")))
    spelled = spelled.withColumn("size", F.char_length("s"))
    i = F.col("i")
    steps = spelled.filter("size > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    steps = steps.select(_node("s", i).alias("node"), _two("s", i).alias("two"), (i + 2 >= F.col("size")).alias("ends"))
    edges = steps.repartition("node").groupBy("node", "two").agg(F.max("ends").alias("ends"))

    # half of the characters stay; the reversed trie takes the edits of the other half
    begin = F.floor((F.col("size") + F.col("way")) / 2).cast("int")
    unedited = spelled.withColumn("i", F.explode(F.sequence(begin, F.col("size"))))
    own, ch, head = F.substring(F.col("s"), i + 1, F.lit(1)), F.substring("two", 1, 1), F.substring(F.col("s"), F.lit(1), i)
    spread = unedited.withColumn("node", _node("s", i)).join(edges, "node").filter(ch != own)
    more, other = F.concat(head, ch, F.substring(F.col("s"), i + 1, F.col("size"))), F.concat(head, ch, F.substring(F.col("s"), i + 2, F.col("size")))
    spread = spread.select("way", "s", "i", "two", "ends", F.explode(F.when((own != "") & (ch > own), F.array(more, other)).otherwise(F.array(more))).alias("t"))

    def moved(rows: DataFrame, position) -> DataFrame:
        """States whose next characters have an edge, behind it; a state at the end of its word stays."""
        pos, size = F.col("pos"), F.char_length("t")
        rows = rows.withColumn("pos", position).filter((pos >= size) | (F.col("two") == _two("t", pos)) & ((pos + 2 < size) | F.col("ends")))
        return rows.select("way", "s", "t", F.least(size, pos + 2).alias("pos"))

    frontier = moved(spread, i)
    while True:
        for _ in range(LEVELS):
            # without a next character nothing matches, and the left join lets the state stay
            state = frontier.withColumn("node", _node("t", F.col("pos")))
            walked = state.join(edges, (state["node"] == edges["node"]) & (_two("t", F.col("pos")) == edges["two"]), "left")
            frontier = moved(walked, F.col("pos"))
        frontier = store(frontier)
        if frontier.filter("pos < char_length(t)").isEmpty():
            break
    straight = lambda name: F.when(F.col("way") == 1, F.reverse(name)).otherwise(F.col(name))
    met = frontier.select(straight("s").alias("word"), straight("t").alias("near")).filter(F.levenshtein("word", "near", 1) == 1)
    return met.union(met.select("near", "word")).distinct()


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of (word, n).

    `form` is the near word of largest n (ties: smallest in code-point order) if that n is at least `RATIO` times the
    word's, else null; `root` is where forms lead in the end, the word itself if it has none.
    """
    words = store(words.select("word", "n"))
    pairs = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    formed = -F.col("best.rank") >= RATIO * F.col("n")
    rows = store(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.rank")).alias("form_n")))

    # counts double from word to form, so chains are short; each round doubles the step
    hops = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if hops.join(on, "root", "left_semi").isEmpty():
            break
        hops = store(hops.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return rows.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the texts' vocabulary; see `vocabulary` for odd rows and `variants`."""
    return variants(vocabulary(docs, doc_id, text))
