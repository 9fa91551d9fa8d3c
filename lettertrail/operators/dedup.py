"""Duplicate review: block keys, candidate pairs, scores, containment, clusters, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fingerprint as P
from ..functions import text as T
from ..session import materialise
from .components import connected_components

# Scoring thresholds and scores.
KEEP_SCORE = 0.92
JACCARD_WEAK, JACCARD_STRONG = 0.72, 0.85
CONTAINED, CONTAINED_SCORE = 0.90, 0.93
MIN_CONTAINED_SHINGLES = 5
MEETS = 3  # probes that a contained set must have in the larger one; any number gives the same pairs
BITS = 1 << 25  # of the filter of wanted rows
CLOSE_SECONDS = 600
EXACT_REASONS = ("same_source_sha256", "same_message_id", "same_body_hash")
KIND_RANK = {"standalone": 0, "attached": 1, "snipped": 2, "quoted": 3}
REVIEWED_KINDS = tuple(KIND_RANK)

# Families whose members are the same thing; the others are evidence that two bodies are alike.
EXACT_FAMILIES = ("sha", "msg", "body")


def reviewable(emails: DataFrame) -> DataFrame:
    live = F.col("deleted_at").isNull() & F.col("superseded_at").isNull()
    return emails.filter(live & F.col("source_kind").isin(*REVIEWED_KINDS))


# ---- fingerprints


def with_body_norm(emails: DataFrame) -> DataFrame:
    norm = emails.withColumn("body_norm", T.canonical_body(F.col("body_text")))
    return norm.withColumn("body_hash", T.body_hash(F.col("body_norm"))).withColumn("norm_len", F.length("body_norm"))


def fingerprint_table(emails: DataFrame) -> DataFrame:
    table = P.with_fingerprints(with_body_norm(emails))
    return table.select("id", "case_id", "body_norm", "norm_len", "body_hash", "hashes", "signature")


def refresh_fingerprints(emails: DataFrame, old: DataFrame) -> DataFrame:
    """Fingerprints of the current bodies, signing again only rows that are new or whose body changed."""
    now = with_body_norm(emails).select("id", "case_id", "body_norm", "norm_len", "body_hash")
    known = old.select("id", "body_hash", F.struct("hashes", "signature").alias("_old"))
    both = now.join(known, ["id", "body_hash"], "left").withColumn("recomputed", F.col("_old").isNull())
    both = both.withColumn("_changed", F.when(F.col("recomputed"), F.col("body_norm")))
    made = both.withColumn("_hashes", P.shingle_hashes(F.col("_changed")))
    made = made.withColumn("_signature", P.minhash(F.col("_changed"), F.col("_hashes")))
    pick = lambda name: F.when(F.col("recomputed"), F.col(f"_{name}")).otherwise(F.col(f"_old.{name}")).alias(name)
    return made.select(*now.columns, pick("hashes"), pick("signature"), "recomputed")


# ---- blocking


def block_keys(emails: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(case_id, id, body_hash, family, key): every key under which two rows may meet: file, message id, body, bands."""
    rows = emails.select("id", "case_id", "source_sha", "message_id").join(fingerprints.select("id", "body_hash", "norm_len", "signature"), "id")
    sha, ref = F.trim(F.coalesce("source_sha", F.lit(""))), T.norm_msgid(F.col("message_id"))

    def key(family: str, value: Column, present: Column) -> Column:
        return F.when(present, F.struct(F.lit(family).alias("family"), F.concat(F.lit(f"{family}:"), value).alias("key")))

    single = [key("sha", sha, sha != ""), key("msg", ref, ref.isNotNull()), key("body", F.col("body_hash"), F.col("norm_len") > 0)]
    bands = F.transform(
        F.coalesce(P.lsh_keys(F.col("signature")), F.array().cast("array<string>")),
        lambda band: F.struct(F.lit("lsh").alias("family"), band.alias("key")),
    )
    every = F.concat(F.array_compact(F.array(*single)), bands)
    return rows.select("case_id", "id", "body_hash", F.explode(every).alias("k")).select("case_id", "id", "body_hash", "k.*")


def review_prints(emails: DataFrame) -> DataFrame:
    """The fingerprints that a review reads: no texts, hashes in four bytes each."""
    prints = fingerprint_table(emails)
    return prints.select("id", "case_id", "norm_len", "body_hash", _narrow("hashes").alias("hashes"), "signature")


def _narrow(hashes: Column | str) -> Column:
    return F.col(hashes).cast("array<int>") if isinstance(hashes, str) else hashes.cast("array<int>")


def distinct_bodies(fingerprints: DataFrame) -> DataFrame:
    """(case_id, body_hash, id), stored: the distinct bodies of each case by their first row."""
    return materialise(fingerprints.groupBy("case_id", "body_hash").agg(F.min("id").alias("id")))


def sets_of(fingerprints: DataFrame, bodies: DataFrame) -> DataFrame:
    """Fingerprints of the first rows of `bodies` and of some others: hashes aren't shuffled for it, so pairs of the others are dropped at the end."""
    return _maybe(fingerprints, bodies, ["id"])


def contained_bodies(fingerprints: DataFrame) -> DataFrame:
    """(case_id, left_body, right_body, left_id, right_id, contained) both ways: bodies of a case of which one holds the other.

    The ids are the first rows of the bodies in their case. `fingerprints` are stored.
    """
    return contained_among(fingerprints, distinct_bodies(fingerprints))


def contained_among(fingerprints: DataFrame, bodies: DataFrame) -> DataFrame:
    """`contained_bodies` of those of the `distinct_bodies`."""
    sets = _sized(sets_of(fingerprints, bodies), "id", 1, ("case_id",))
    held = materialise(_held(sets, None, _FEWER, CONTAINED, ("case_id",)).select("small_key", "large_key", "contained"))
    return both_ways(held, "small_key", "large_key", bodies)


def held_bodies(fingerprints: DataFrame) -> DataFrame:
    """(small_key, large_key, contained): bodies, by their hashes, that lie inside another one, whatever their cases. `fingerprints` are stored."""
    bodies = materialise(fingerprints.groupBy("body_hash").agg(F.min("id").alias("id"), F.first(F.size("hashes")).alias("n")))
    sets = _sized(sets_of(fingerprints, bodies), "id", MIN_CONTAINED_SHINGLES)
    held = materialise(_held(sets, None, _FEWER_OR_EQUAL, CONTAINED).select("small_key", "large_key", "contained"))
    name = lambda side: bodies.select(F.col("id").alias(f"{side}_key"), F.col("body_hash").alias(side), F.col("n").alias(f"{side}_n"))
    # of two bodies of one size the one with the lower hash is the smaller
    named = held.join(name("small"), "small_key").join(name("large"), "large_key").filter("small_n < large_n OR small < large")
    return named.select(F.col("small").alias("small_key"), F.col("large").alias("large_key"), "contained")


def both_ways(held: DataFrame, a: str, b: str, names: DataFrame) -> DataFrame:
    """Pairs of ids with the case and body that `names` (id, case_id, body_hash) has for them, as left and right and the other way round."""
    label = lambda key, side: names.select(F.col("id").alias(key), "case_id", F.col("body_hash").alias(f"{side}_body"))
    named = held.join(label(a, "left"), a).join(label(b, "right").drop("case_id"), b).select(
        "case_id", "left_body", "right_body", F.col(a).alias("left_id"), F.col(b).alias("right_id"), "contained")
    turned = named.select("case_id", F.col("right_body").alias("left_body"), F.col("left_body").alias("right_body"), F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "contained")
    return named.union(turned)


def candidate_pairs(keys: DataFrame, contained: DataFrame) -> DataFrame:
    """Distinct (case_id, a, b), a < b: pairs with evidence, by one rule whatever the number of rows that share a key.

    Rows of one file, message id or body are each paired with the first of them, which keeps copies together without
    all their pairs. Different bodies are paired, by their first rows in the case, where they share a band of their
    signatures or one contains the other.
    """
    exact = keys.filter(F.col("family").isin(*EXACT_FAMILIES)).select("case_id", "id", "key")
    hubs = exact.groupBy("case_id", "key").agg(F.min("id").alias("a"))
    star = exact.join(hubs, ["case_id", "key"]).filter("a <> id").select("case_id", "a", F.col("id").alias("b"))
    firsts = keys.filter("family = 'lsh'").groupBy("case_id", "key", "body_hash").agg(F.min("id").alias("id"))
    left, right = (firsts.select("case_id", "key", F.col("id").alias(side)) for side in ("a", "b"))
    alike = left.join(right, ["case_id", "key"]).filter("a < b").select("case_id", "a", "b")
    held = contained.select("case_id", F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"))
    return star.union(alike).union(held).distinct()


# ---- containment

_FEWER = "small_n < large_n OR (small_n = large_n AND small_key < large_key)"
_FEWER_OR_EQUAL = "small_n <= large_n AND small_key <> large_key"


def _bounds(n: Column, share: float) -> tuple[Column, Column]:
    """(spare, meets) of a set of `n` hashes: how many of them a set that holds it to `share` may lack, and how many
    of any `spare` + `meets` hashes of it such a set has at least."""
    least = F.greatest(F.ceil(F.lit(share) * n - F.lit(1e-9)), F.lit(1)).cast("int")
    return n - least, F.least(F.lit(MEETS), least)


def _sized(sets: DataFrame, key: str, min_shingles: int, within: tuple[str, ...] = ()) -> DataFrame:
    return sets.select(*within, F.col(key).alias("key"), F.size("hashes").alias("n"), "hashes").filter(F.col("n") >= min_shingles)


def _maybe(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """`rows` without most of those whose `on` isn't in `wanted`: one bit for each hash of a wanted row.

    The words of 64 bits are a table of at most `BITS` / 64 rows whatever is wanted, so it may be broadcast; with very
    much wanted it lets all rows pass.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(BITS))
    word, bit = F.shiftright(place, 6), (place % 64).cast("int")
    words = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    held = rows.withColumn("_word", word).join(F.broadcast(words), "_word")
    return held.filter(F.getbit("_bits", bit) == 1).select(*rows.columns)


def _met(rows: DataFrame, smaller: str, share: float, within: tuple[str, ...], apart: bool) -> DataFrame:
    """(small_side, small_key, large_side, large_key): pairs in which enough probes of the small set lie in the large one.

    `rows`: within, side, key, n, h. Each set probes with the rarest of its hashes; those in no other set come first and use up part of what
    may be missed. With `apart` only sets of different sides meet. Hashes are short, so in large tables any two sets may
    meet by chance in one of them, but seldom in several.
    """
    on = ["h", *within]
    along = Window.partitionBy(*on)
    counted = rows.withColumn("df", F.count("*").over(along))
    if apart:
        shared = counted.withColumn("_low", F.min("side").over(along)).withColumn("_high", F.max("side").over(along)).filter("_low < _high").drop("_low", "_high")
    else:
        shared = counted.filter("df > 1")
    ranked = shared.groupBy(*within, "side", "key").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("ranked"), F.first("n").alias("n"))
    spare, meets = _bounds(F.col("n"), share)
    left = spare - F.col("n") + F.size("ranked")
    probes = F.slice(F.transform("ranked", lambda r: r["h"]), F.lit(1), left + meets)
    probe = ranked.filter(left >= 0).select(
        *within, F.col("side").alias("small_side"), F.col("key").alias("small_key"), F.col("n").alias("small_n"), meets.alias("meets"), F.explode(probes).alias("h"))
    index = shared.select(*within, F.col("side").alias("large_side"), F.col("key").alias("large_key"), F.col("n").alias("large_n"), "h")
    hits = probe.join(index, on).filter(smaller)
    if apart:
        hits = hits.filter("small_side <> large_side")
    pair = ["small_side", "small_key", "large_side", "large_key"]
    return hits.groupBy(*pair).agg(F.count("*").alias("hits"), F.first("meets").alias("meets")).filter("hits >= meets").select(*pair)


def _held(a: DataFrame, b: DataFrame | None, smaller: str, share: float, within: tuple[str, ...] = ()) -> DataFrame:
    """(small_side, small_key, large_side, large_key, contained) of the stored `_sized` sets of `a`, or between those of `a` (side 0) and `b` (side 1).

    Exact. Hashes are shuffled once to be counted and met where they are; whole sets are read and compared where enough probes met.
    """
    on = ["h", *within]
    sides = [a.withColumn("side", F.lit(0))] + ([] if b is None else [b.withColumn("side", F.lit(1))])
    # nulls go here, so that the two readers of these rows share one shuffle
    rows = [x.select(*within, "side", "key", "n", F.explode("hashes").alias("h")).filter(" AND ".join(f"{c} IS NOT NULL" for c in on)) for x in sides]
    # rows of the second table only where the first has the hash
    both = rows[0] if b is None else rows[0].unionByName(_maybe(rows[1], rows[0], on))
    pairs = materialise(_met(both, smaller, share, within, b is not None))
    ends = materialise(pairs.select(F.col("small_side").alias("side"), F.col("small_key").alias("key")).union(pairs.select("large_side", "large_key")).distinct())
    sets = sides[0] if b is None else sides[0].unionByName(sides[1])
    full = _maybe(sets.select("side", "key", "n", "hashes"), ends, ["side", "key"])
    as_side = lambda name, hashes, *more: full.select(F.col("side").alias(f"{name}_side"), F.col("key").alias(f"{name}_key"), F.col("hashes").alias(hashes), *more)
    met = pairs.join(as_side("small", "s", "n"), ["small_side", "small_key"]).join(as_side("large", "l"), ["large_side", "large_key"])
    ratio = F.size(F.array_intersect("s", "l")) / F.col("n")
    return met.select("small_side", "small_key", "large_side", "large_key", ratio.alias("contained")).filter(F.col("contained") >= share)


def containment_within(sets: DataFrame, key: str, share: float = CONTAINED, min_shingles: int = MIN_CONTAINED_SHINGLES) -> DataFrame:
    """(small_key, large_key, contained): sets whose hashes lie to at least `share` inside a larger set.

    Exact. Only the rarest hashes of the smaller set probe the index, so a passage found in a large part of
    the corpus is no join key unless a set consists of little else.
    """
    sized = materialise(_sized(sets, key, min_shingles))
    return _held(sized, None, _FEWER, share).select("small_key", "large_key", "contained")


def containment_added(added: DataFrame, stored: DataFrame, key: str, share: float = CONTAINED, min_shingles: int = MIN_CONTAINED_SHINGLES,
                      within: tuple[str, ...] = ()) -> DataFrame:
    """(left_key, right_key, contained) between a small table of added sets and a large one, both of them stored.

    The same pairs as `containment_between`, but stored hashes are only counted and shuffled where an added set has
    them; the rest of the stored sets is read and let go.
    """
    a, b = (_sized(x, key, min_shingles, within) for x in (added, stored))
    held = _held(a, b, "small_n < large_n OR (small_n = large_n AND small_side = 0)", share, within)
    first = F.col("small_side") == 0
    return held.select(
        F.when(first, F.col("small_key")).otherwise(F.col("large_key")).alias("left_key"), F.when(first, F.col("large_key")).otherwise(F.col("small_key")).alias("right_key"), "contained")


def held_in(parts: DataFrame, wholes: DataFrame, key: str, share: float, within: tuple[str, ...] = ()) -> DataFrame:
    """(small_key, large_key, contained): sets of `parts` that lie to at least `share` inside a set of `wholes` that is
    at most 1 / `share` times as large. Both tables are stored."""
    a, b = (_sized(x, key, 1, within) for x in (parts, wholes))
    return _held(a, b, f"small_side = 0 AND {share!r}D * large_n <= small_n", share, within).select("small_key", "large_key", "contained")


def _weighed(shared: DataFrame, share: float) -> DataFrame:
    """(key, n, shared, meets, probes): each set's hashes that the other table's sets hold too, the rarest first, and how many of them
    are probes, of which a set contained to `share` must have `meets` in the larger set.

    `shared`: key, n, h, df. Stored, since its users read different columns of it.
    """
    ranked = shared.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("ranked"), F.first("n").alias("n"))
    # hashes held by no other set come first in the ranking and use up part of what may be missed
    spare, meets = _bounds(F.col("n"), share)
    left = spare - F.col("n") + F.size("ranked")
    hashes = F.transform("ranked", lambda r: r["h"])
    return materialise(ranked.select("key", "n", hashes.alias("shared"), meets.alias("meets"), F.when(left >= 0, left + meets).otherwise(0).alias("probes")))


def _contained(small: DataFrame, large: DataFrame, smaller: Column, share: float) -> DataFrame:
    probe = small.filter("probes > 0").select(F.col("key").alias("small_key"), F.col("n").alias("small_n"), "meets", F.explode(F.slice("shared", F.lit(1), F.col("probes"))).alias("h"))
    index = large.select(F.col("key").alias("large_key"), F.col("n").alias("large_n"), F.explode("shared").alias("h"))
    hits = probe.join(index, "h").filter(smaller).groupBy("small_key", "large_key").agg(F.count("*").alias("hits"), F.first("meets").alias("meets"))
    met = hits.filter("hits >= meets").select("small_key", "large_key")
    sides = met.join(small.select(F.col("key").alias("small_key"), F.col("n").alias("n"), F.col("shared").alias("s")), "small_key").join(
        large.select(F.col("key").alias("large_key"), F.col("shared").alias("l")), "large_key"
    )
    ratio = F.size(F.array_intersect("s", "l")) / F.col("n")
    return sides.select("small_key", "large_key", ratio.alias("contained")).filter(F.col("contained") >= share)


def _shared_sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n, h, df) of either side: the hashes that both have, and how many sets hold them.

    Working out the sets is most of the work, so those of `a` are stored and those of `b` are read once.
    """
    rows_a, rows_b = (x.select("key", "n", F.explode("hashes").alias("h")) for x in (materialise(a), b))
    in_a = rows_a.groupBy("h").agg(F.count("*").alias("da"))
    met = materialise(rows_b.join(in_a, "h"))
    counts = materialise(met.groupBy("h").agg((F.first("da") + F.count("*")).alias("df")))
    return rows_a.join(counts, "h"), met.drop("da").join(counts, "h")


def containment_between(left: DataFrame, right: DataFrame, key_left: str, key_right: str, share: float = CONTAINED,
                        min_shingles: int = MIN_CONTAINED_SHINGLES) -> DataFrame:
    """(left_key, right_key, contained) over two tables; the smaller set of each pair is measured."""
    sets = lambda x, key: x.select(F.col(key).alias("key"), F.size("hashes").alias("n"), "hashes").filter(F.col("n") >= min_shingles)
    wa, wb = (_weighed(x, share) for x in _shared_sides(sets(left, key_left), sets(right, key_right)))
    a_in_b = _contained(wa, wb, F.expr("small_n <= large_n"), share)
    b_in_a = _contained(wb, wa, F.expr("small_n < large_n"), share)
    return a_in_b.select(F.col("small_key").alias("left_key"), F.col("large_key").alias("right_key"), "contained").union(
        b_in_a.select("large_key", "small_key", "contained")
    )


# ---- scoring


def _reason(code: str, label: Column | str, value: Column | None = None) -> Column:
    shown = F.lit(label) if isinstance(label, str) else label
    number = F.lit(None).cast("double") if value is None else value
    return F.struct(F.lit(code).alias("code"), shown.alias("label"), number.alias("value"))


def _percent_label(lead: str, value: Column, tail: str) -> Column:
    return F.concat(F.lit(lead), F.bround(value * 100).cast("int").cast("string"), F.lit(tail))


def pair_features(pairs: DataFrame, emails: DataFrame, fingerprints: DataFrame) -> DataFrame:
    facts = emails.select("id", "source_sha", "message_id", "subject", "from_addr", "date_utc").join(
        fingerprints.select("id", "body_hash", "norm_len"), "id"
    ).select(
        "id", "body_hash", "norm_len", "date_utc",
        F.nullif(F.trim("source_sha"), F.lit("")).alias("sha"),
        T.norm_msgid(F.col("message_id")).alias("ref"),
        T.norm_subject(F.col("subject")).alias("subject"),
        T.norm_contact(F.col("from_addr")).alias("sender"),
    )
    left = facts.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in facts.columns if c != "id"])
    right = facts.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in facts.columns if c != "id"])
    both = pairs.join(left, "a").join(right, "b")
    has_bodies = (F.col("norm_len_a") > 0) & (F.col("norm_len_b") > 0)
    same_body = has_bodies & (F.col("body_hash_a") == F.col("body_hash_b"))
    return both.select(
        *[c for c in pairs.columns],
        F.col("body_hash_a").alias("left_body"), F.col("body_hash_b").alias("right_body"),
        F.coalesce(F.col("sha_a") == F.col("sha_b"), F.lit(False)).alias("same_sha"),
        F.coalesce(F.col("ref_a") == F.col("ref_b"), F.lit(False)).alias("same_ref"),
        same_body.alias("same_body"), (has_bodies & ~same_body).alias("open"),
        (F.col("subject_a") == F.col("subject_b")).alias("same_subject"),
        (F.col("sender_a") == F.col("sender_b")).alias("same_sender"),
        T.dates_close(F.col("date_utc_a"), F.col("date_utc_b"), CLOSE_SECONDS).alias("close_date"),
    )


def score_pairs(pairs: DataFrame, emails: DataFrame, fingerprints: DataFrame, contained: DataFrame) -> DataFrame:
    """Pairs scoring at least 0.92, with the reasons in order of strength.

    Signatures are compared once per distinct pair of bodies, not per pair of rows; `contained` is what
    `contained_bodies` found.
    """
    facts = materialise(pair_features(pairs, emails, fingerprints))
    signed = fingerprints.groupBy("body_hash").agg(F.first("signature").alias("signature"))
    context = F.col("same_subject") | F.col("same_sender") | F.col("close_date")

    asked = facts.filter("open").select("left_body", "right_body").distinct()
    sig_l = signed.select(F.col("body_hash").alias("left_body"), F.col("signature").alias("sl"))
    sig_r = signed.select(F.col("body_hash").alias("right_body"), F.col("signature").alias("sr"))
    jaccards = asked.join(sig_l, "left_body").join(sig_r, "right_body").select(
        "left_body", "right_body", P.minhash_jaccard(F.col("sl"), F.col("sr")).alias("jaccard")
    ).filter(F.col("jaccard") >= JACCARD_WEAK)

    on = ["left_body", "right_body"]
    held = contained.select("case_id", *on, "contained")
    joined = facts.join(jaccards, on, "left").join(held, ["case_id", *on], "left")
    j = F.col("jaccard")
    by_jaccard = F.coalesce(F.col("open") & ((j >= JACCARD_STRONG) | ((j >= JACCARD_WEAK) & context)), F.lit(False))
    work = joined.withColumn("by_jaccard", by_jaccard)
    work = work.withColumn("by_contained", F.col("open") & ~F.col("by_jaccard") & F.col("contained").isNotNull())
    score = F.greatest(
        F.when(F.col("same_sha"), F.lit(1.0)),
        F.when(F.col("same_ref"), F.lit(0.99)),
        F.when(F.col("same_body"), F.lit(0.97)),
        F.when(F.col("by_jaccard"), F.when(j >= JACCARD_STRONG, F.least(F.lit(0.96), 0.94 + (j - JACCARD_STRONG) * 0.13)).otherwise(KEEP_SCORE)),
        F.when(F.col("by_contained"), F.lit(CONTAINED_SCORE)),
    )
    fuzzy = F.col("by_jaccard") | F.col("by_contained")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("same_sha"), _reason("same_source_sha256", "Same source file hash")),
            F.when(F.col("same_ref"), _reason("same_message_id", "Same Message-ID")),
            F.when(F.col("same_body"), _reason("same_body_hash", "Same normalized body")),
            F.when(F.col("by_jaccard"), _reason("body_shingle_jaccard", _percent_label("Body ", j, "% overlap"), F.bround(j, 4))),
            F.when(
                F.col("by_contained"),
                _reason("body_containment", _percent_label("Body ", F.col("contained"), "% contained (likely quote/forward)"), F.bround("contained", 4)),
            ),
            F.when(fuzzy & F.col("same_subject"), _reason("same_subject", "Same normalized subject")),
            F.when(fuzzy & F.col("same_sender"), _reason("same_sender", "Same sender")),
            F.when(fuzzy & F.col("close_date"), _reason("close_date", "Dates within 10 minutes")),
        )
    )
    scored = work.select("case_id", "a", "b", score.alias("score"), reasons.alias("reasons"))
    return scored.filter(F.col("score") >= KEEP_SCORE).select(
        "case_id", F.col("a").alias("email_a_id"), F.col("b").alias("email_b_id"), T.round_even(F.col("score"), 4).alias("score"), "reasons"
    )


def duplicate_pairs(emails: DataFrame, fingerprints: DataFrame | None = None) -> DataFrame:
    """Scored duplicate pairs of a whole email table."""
    live = reviewable(emails)
    prints = materialise(review_prints(live)) if fingerprints is None else fingerprints
    contained = materialise(contained_bodies(prints))
    pairs = candidate_pairs(block_keys(live, prints), contained)
    return score_pairs(pairs, live, prints, contained)


# ---- review state


def pending_counts(pairs: DataFrame, emails: DataFrame) -> DataFrame:
    ends = pairs.filter("status = 'pending'").select(F.explode(F.array("email_a_id", "email_b_id")).alias("id"))
    counts = ends.groupBy("id").agg(F.count("*").alias("pending_duplicates"))
    return emails.select("id").join(counts, "id", "left").select("id", F.coalesce("pending_duplicates", F.lit(0)).cast("long").alias("pending_duplicates"))


def canonical_order(kind: Column, norm_len: Column, date: Column, id_: Column) -> Column:
    """Sort key of the copy to keep: better kind, longer body, dated, earlier, lower id."""
    rank = F.lit(4)
    for name, value in KIND_RANK.items():
        rank = F.when(kind == name, value).otherwise(rank)
    return F.struct(rank.alias("rank"), (-norm_len).alias("len"), date.isNull().alias("undated"), date.alias("date"), id_.alias("id"))


def suggest_canonical(members: DataFrame, group: list[str]) -> DataFrame:
    """`members` has id, source_kind, norm_len, date_utc; one suggested id per group."""
    order = canonical_order(F.col("source_kind"), F.col("norm_len"), F.col("date_utc"), F.col("id"))
    return members.groupBy(*group).agg(F.min_by("id", order).alias("suggested_canonical_id"))


def cluster_members(pairs: DataFrame) -> DataFrame:
    """(cluster_id, id): the connected groups of pending pairs, named after their smallest id."""
    pending = pairs.filter("status = 'pending'")
    return connected_components(pending, "email_a_id", "email_b_id").select(F.col("root").alias("cluster_id"), "id")


def duplicate_clusters(pairs: DataFrame, emails: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row per cluster: sizes, best score and the copy to keep. `emails` has id, source_kind, norm_len, date_utc."""
    members = cluster_members(pairs) if members is None else members
    pending = pairs.filter("status = 'pending'")
    per_pair = pending.join(members, pending["email_a_id"] == members["id"]).groupBy("cluster_id").agg(
        F.count("*").alias("n_pairs"), F.max("score").alias("max_score")
    )
    facts = members.join(emails.select("id", "source_kind", "norm_len", "date_utc"), "id")
    keep = suggest_canonical(facts, ["cluster_id"])
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n_members"))
    return sizes.join(per_pair, "cluster_id").join(keep, "cluster_id", "left").orderBy(F.desc("max_score"), "cluster_id")


def _decide(pairs: DataFrame, hit: Column, canonical: Column, duplicate: Column) -> DataFrame:
    return pairs.withColumn("canonical_email_id", F.when(hit, canonical).otherwise(F.col("canonical_email_id"))).withColumn(
        "duplicate_email_id", F.when(hit, duplicate).otherwise(F.col("duplicate_email_id"))
    ).withColumn("status", F.when(hit, F.lit("duplicate")).otherwise(F.col("status")))


def with_decision_columns(pairs: DataFrame) -> DataFrame:
    for name in ("canonical_email_id", "duplicate_email_id"):
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, F.lit(None).cast("long"))
    return pairs


def is_exact(codes: Column) -> Column:
    return F.arrays_overlap(codes, F.array(*map(F.lit, EXACT_REASONS)))


def count_exact(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_if(is_exact(F.col("reason_codes")) & (F.col("status") == "pending")).alias("exact_pairs"))


def resolve_exact(pairs: DataFrame, emails: DataFrame) -> DataFrame:
    """Mark every pending pair with an exact reason as duplicate of its better copy."""
    order = canonical_order(F.col("source_kind"), F.col("norm_len"), F.col("date_utc"), F.col("id"))
    ranks = emails.select("id", order.alias("ord"))
    pairs = with_decision_columns(pairs)
    sides = pairs.join(ranks.select(F.col("id").alias("email_a_id"), F.col("ord").alias("oa")), "email_a_id", "left").join(
        ranks.select(F.col("id").alias("email_b_id"), F.col("ord").alias("ob")), "email_b_id", "left"
    )
    a_first = F.col("ob").isNull() | (F.col("oa").isNotNull() & (F.col("oa") < F.col("ob")))
    hit = (F.col("status") == "pending") & is_exact(F.col("reason_codes"))
    keep = F.when(a_first, F.col("email_a_id")).otherwise(F.col("email_b_id"))
    other = F.when(a_first, F.col("email_b_id")).otherwise(F.col("email_a_id"))
    return _decide(sides, hit, keep, other).drop("oa", "ob")


def resolve_clusters(pairs: DataFrame, choices: DataFrame) -> DataFrame:
    """Decide pending pairs lying inside a chosen group. `choices` has id, canonical_id (one group per id)."""
    pairs = with_decision_columns(pairs)
    a = choices.select(F.col("id").alias("email_a_id"), F.col("canonical_id").alias("ca"))
    b = choices.select(F.col("id").alias("email_b_id"), F.col("canonical_id").alias("cb"))
    sides = pairs.join(a, "email_a_id", "left").join(b, "email_b_id", "left")
    hit = F.coalesce((F.col("status") == "pending") & (F.col("ca") == F.col("cb")), F.lit(False))
    swap = F.col("email_b_id") == F.col("ca")
    keep = F.when(swap, F.col("email_b_id")).otherwise(F.col("email_a_id"))
    other = F.when(swap, F.col("email_a_id")).otherwise(F.col("email_b_id"))
    return _decide(sides, hit, keep, other).drop("ca", "cb")


def merge_pairs(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """New pairs enter as pending, pending ones take the new score, decided ones stay, pending ones no longer found go."""
    on = ["case_id", "email_a_id", "email_b_id"]
    old = existing.withColumnRenamed("score", "old_score").withColumnRenamed("reasons", "old_reasons").withColumnRenamed("status", "old_status")
    new = generated.select(*on, F.col("score").alias("new_score"), F.col("reasons").alias("new_reasons"))
    both = old.join(new, on, "full")
    decided = F.coalesce(F.col("old_status") != "pending", F.lit(False))
    kept = both.filter(decided | F.col("new_score").isNotNull())
    return kept.select(
        *on,
        F.when(decided, F.col("old_score")).otherwise(F.col("new_score")).alias("score"),
        F.when(decided, F.col("old_reasons")).otherwise(F.col("new_reasons")).alias("reasons"),
        F.when(decided, F.col("old_status")).otherwise(F.lit("pending")).alias("status"),
    )


def apply_decisions(pairs: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with valid decisions applied, decisions refused). A decision names the pair, a status and, for
    `duplicate`, which of the two is kept and which is the copy."""
    on = ["case_id", "email_a_id", "email_b_id"]
    asked = decisions.select(*on, F.col("status").alias("new_status"), F.col("canonical_email_id").alias("keep"), F.col("duplicate_email_id").alias("copy"))
    inside = F.col("keep").isin(F.col("email_a_id"), F.col("email_b_id")) & F.col("copy").isin(F.col("email_a_id"), F.col("email_b_id"))
    valid = F.col("new_status").isin("pending", "dissimilar") | ((F.col("new_status") == "duplicate") & inside & (F.col("keep") != F.col("copy")))
    asked = asked.withColumn("valid", F.coalesce(valid, F.lit(False)))
    known = asked.join(pairs.select(*on), on, "left_semi")
    refused = asked.filter("NOT valid").drop("valid").unionByName(asked.filter("valid").drop("valid").join(pairs.select(*on), on, "left_anti"))
    hit = F.col("new_status").isNotNull()
    dup = F.col("new_status") == "duplicate"
    merged = with_decision_columns(pairs).join(known.filter("valid").drop("valid"), on, "left")
    out = merged.withColumn("canonical_email_id", F.when(hit, F.when(dup, F.col("keep"))).otherwise(F.col("canonical_email_id"))).withColumn(
        "duplicate_email_id", F.when(hit, F.when(dup, F.col("copy"))).otherwise(F.col("duplicate_email_id"))
    ).withColumn("status", F.when(hit, F.col("new_status")).otherwise(F.col("status")))
    return out.drop("new_status", "keep", "copy"), refused


def list_pairs(pairs: DataFrame, status: str = "pending", email_id: int | None = None) -> DataFrame:
    found = pairs.filter(F.col("status") == status)
    if email_id is not None:
        found = found.filter((F.col("email_a_id") == email_id) | (F.col("email_b_id") == email_id))
    return found.orderBy(F.desc("score"), "email_a_id", "email_b_id")
