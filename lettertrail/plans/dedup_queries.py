"""Duplicate-review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fingerprint as P
from ..functions import text as T
from ..operators import dedup as D
from ..operators import delta
from ..session import materialise
from . import checksql as Q
from .registry import query

_LIVE = "deleted_at IS NULL AND superseded_at IS NULL"

# live rows with their normalised fields, shingle sets and signatures
_BASE = f"""norm AS MATERIALIZED (SELECT id, case_id, source_kind, date_utc, source_sha, {Q.body_norm('body_text')} AS body_norm, {Q.msgid_norm('message_id')} AS ref,
    {Q.subject_norm('subject')} AS subject_key, {Q.fold('lower(from_addr)')} AS sender FROM fx_emails WHERE {_LIVE}),
  sh AS ({Q.shingle_rows('norm')}), h AS MATERIALIZED (SELECT DISTINCT id, {Q.hash28('shingle')} AS h FROM sh),
  sig AS MATERIALIZED (SELECT id, {Q.signature_columns()} FROM h GROUP BY id)"""

_BANDS = " UNION ALL ".join(f"SELECT id, {key} AS key FROM sig" for key in Q.band_keys())
_KEYS = f"""keys AS MATERIALIZED (SELECT n.case_id, k.id, k.key FROM (
    SELECT id, concat('sha:', source_sha) AS key FROM norm WHERE source_sha <> ''
    UNION ALL SELECT id, concat('msg:', ref) FROM norm WHERE ref IS NOT NULL
    UNION ALL SELECT id, concat('body:', sha256(body_norm)) FROM norm WHERE body_norm <> ''
    UNION ALL {_BANDS}) AS k JOIN norm n ON n.id = k.id)"""
_PAIRS = """hubs AS (SELECT case_id, key, min(id) AS a FROM keys WHERE NOT starts_with(key, 'lsh:') GROUP BY 1, 2),
  firsts AS MATERIALIZED (SELECT case_id, min(id) AS id FROM norm WHERE body_norm <> '' GROUP BY case_id, body_norm),
  bands AS (SELECT k.* FROM keys k JOIN firsts f ON f.id = k.id WHERE starts_with(key, 'lsh:')),
  fh AS MATERIALIZED (SELECT f.case_id, h.id, h.h, count(*) OVER (PARTITION BY h.id) AS n FROM firsts f JOIN h ON h.id = f.id),
  pairs AS MATERIALIZED (SELECT k.case_id, a, id AS b FROM keys k JOIN hubs u ON u.case_id = k.case_id AND u.key = k.key WHERE a <> id
    UNION SELECT x.case_id, x.id, y.id FROM bands x JOIN bands y ON x.case_id = y.case_id AND x.key = y.key AND x.id < y.id
    UNION SELECT x.case_id, x.id, y.id FROM fh x JOIN fh y ON x.case_id = y.case_id AND x.h = y.h AND x.id < y.id GROUP BY x.case_id, x.id, y.id HAVING count(*) / min(least(x.n, y.n)) >= 0.9)"""
_SCORED = f"""sizes AS (SELECT id, count(*) AS n FROM h GROUP BY id),
  meet AS (SELECT p.a, p.b, count(*) AS c FROM pairs p JOIN h x ON x.id = p.a JOIN h y ON y.id = p.b AND y.h = x.h GROUP BY 1, 2),
  facts AS (SELECT p.*, x.source_sha = y.source_sha AS same_sha, coalesce(x.ref = y.ref, false) AS same_ref,
      x.body_norm = y.body_norm AND x.body_norm <> '' AS same_body,
      x.subject_key = y.subject_key AS same_subject, x.sender = y.sender AS same_sender, coalesce(abs(epoch(x.date_utc) - epoch(y.date_utc)) <= 600, false) AS close_date,
      CASE WHEN s.id IS NOT NULL AND t.id IS NOT NULL THEN ({' + '.join(f'CAST(s.s{i} = t.s{i} AS INTEGER)' for i in range(64))}) / 64.0 ELSE 0 END AS j,
      CASE WHEN least(nx.n, ny.n) >= 1 THEN coalesce(meet.c, 0) / least(nx.n, ny.n) ELSE 0 END AS c
    FROM pairs p JOIN norm x ON x.id = p.a JOIN norm y ON y.id = p.b LEFT JOIN sig s ON s.id = p.a LEFT JOIN sig t ON t.id = p.b
    LEFT JOIN sizes nx ON nx.id = p.a LEFT JOIN sizes ny ON ny.id = p.b LEFT JOIN meet ON meet.a = p.a AND meet.b = p.b),
  judged AS (SELECT *, NOT same_body AND (j >= 0.85 OR (j >= 0.72 AND (same_subject OR same_sender OR close_date))) AS by_j FROM facts),
  judged2 AS (SELECT *, NOT same_body AND NOT by_j AND c >= 0.9 AS by_c FROM judged),
  scored AS MATERIALIZED (SELECT case_id, a AS email_a_id, b AS email_b_id,
      round_even(greatest(CASE WHEN same_sha THEN 1.0::DOUBLE ELSE 0 END, CASE WHEN same_ref THEN 0.99::DOUBLE ELSE 0 END, CASE WHEN same_body THEN 0.97::DOUBLE ELSE 0 END,
        CASE WHEN by_j AND j >= 0.85 THEN least(0.96::DOUBLE, 0.94::DOUBLE + (j - 0.85::DOUBLE) * 0.13::DOUBLE) WHEN by_j THEN 0.92::DOUBLE ELSE 0 END, CASE WHEN by_c THEN 0.93::DOUBLE ELSE 0 END), 4) AS score,
      array_to_string(list_filter([CASE WHEN same_sha THEN 'same_source_sha256' END, CASE WHEN same_ref THEN 'same_message_id' END, CASE WHEN same_body THEN 'same_body_hash' END,
        CASE WHEN by_j THEN 'body_shingle_jaccard' END, CASE WHEN by_c THEN 'body_containment' END, CASE WHEN (by_j OR by_c) AND same_subject THEN 'same_subject' END,
        CASE WHEN (by_j OR by_c) AND same_sender THEN 'same_sender' END, CASE WHEN (by_j OR by_c) AND close_date THEN 'close_date' END], lambda r: r IS NOT NULL), ',') AS codes
    FROM judged2 WHERE same_sha OR same_ref OR same_body OR by_j OR by_c)"""
_ROOTS = """edges AS (SELECT {a} AS u, {b} AS v FROM {pairs} UNION SELECT {b}, {a} FROM {pairs}),
  reach(id, root) AS (SELECT DISTINCT u, u FROM edges UNION SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.id),
  roots AS MATERIALIZED (SELECT id, min(root) AS cluster_id FROM reach GROUP BY id)"""


def _codes(reasons="reasons"):
    return F.array_join(F.transform(reasons, lambda r: r["code"]), ",")


def _pairs(t):
    """The stored pair table as a review sees it."""
    return t.fx_pairs.withColumn("reason_codes", F.array("reason"))


def _facts(t):
    return D.with_body_norm(t.fx_emails).select("id", "source_kind", "norm_len", "date_utc")


_FACTS = f"SELECT id, source_kind, length({Q.body_norm('body_text')}) AS norm_len, date_utc FROM fx_emails"
_RANK = "CASE source_kind WHEN 'standalone' THEN 0 WHEN 'attached' THEN 1 WHEN 'snipped' THEN 2 WHEN 'quoted' THEN 3 ELSE 4 END"
_BEST = f"{_RANK}, -norm_len, date_utc IS NULL, date_utc, {{id}}"


@query("block_keys", f"WITH {_BASE}, {_KEYS} SELECT case_id, id, key FROM keys")
def _(t):
    live = D.reviewable(t.fx_emails)
    return D.block_keys(live, D.fingerprint_table(live)).select("case_id", "id", "key")


@query("candidate_pairs", f"WITH {_BASE}, {_KEYS}, {_PAIRS} SELECT case_id, a, b FROM pairs")
def _(t):
    live = D.reviewable(t.fx_emails)
    prints = materialise(D.review_prints(live))
    return D.candidate_pairs(D.block_keys(live, prints), D.contained_bodies(prints))


@query("duplicate_scores", f"WITH {_BASE}, {_KEYS}, {_PAIRS}, {_SCORED} SELECT * FROM scored")
def _(t):
    return D.duplicate_pairs(t.fx_emails).withColumn("codes", _codes()).drop("reasons")


def near_duplicate_clusters(emails):
    prints = materialise(D.review_prints(D.reviewable(emails)))
    pairs = D.duplicate_pairs(emails, prints).withColumn("status", F.lit("pending"))
    pairs = materialise(pairs)
    facts = emails.select("id", "source_kind", "date_utc").join(prints.select("id", "norm_len"), "id")
    return D.duplicate_clusters(pairs, facts)


@query(
    "near_duplicate_clusters",
    f"""WITH RECURSIVE {_BASE}, {_KEYS}, {_PAIRS}, {_SCORED}, {_ROOTS.format(a='email_a_id', b='email_b_id', pairs='scored')},
        best AS (SELECT cluster_id, count(*) AS n_members, arg_min(n.id, row({_RANK.replace('source_kind', 'n.source_kind')}, -length(body_norm), date_utc IS NULL, coalesce(date_utc, TIMESTAMP '1900-01-01'), n.id)) AS suggested_canonical_id FROM roots r JOIN norm n ON n.id = r.id GROUP BY 1),
        score AS (SELECT cluster_id, count(*) AS n_pairs, max(score) AS max_score FROM scored s JOIN roots r ON r.id = s.email_a_id GROUP BY 1)
        SELECT best.cluster_id, n_members, n_pairs, max_score, suggested_canonical_id FROM best JOIN score ON score.cluster_id = best.cluster_id""",
)
def _(t):
    return near_duplicate_clusters(t.fx_emails)


@query(
    "passages_contained",
    f"""WITH a AS (SELECT item_id AS id, {Q.body_norm('text')} AS body_norm FROM benchmark), b AS (SELECT doc_id AS id, {Q.body_norm('text')} AS body_norm FROM documents),
        sa AS ({Q.shingle_rows('a')}), sb AS ({Q.shingle_rows('b')}), ha AS (SELECT DISTINCT id, {Q.hash28('shingle')} AS h FROM sa), hb AS MATERIALIZED (SELECT DISTINCT id, {Q.hash28('shingle')} AS h FROM sb),
        na AS (SELECT id, count(*) AS n FROM ha GROUP BY 1), nb AS (SELECT id, count(*) AS n FROM hb GROUP BY 1),
        m AS (SELECT ha.id AS item_id, hb.id AS doc_id, count(*) AS c FROM ha JOIN hb ON ha.h = hb.h GROUP BY 1, 2)
        SELECT item_id, doc_id, round(c / least(na.n, nb.n), 6) AS contained FROM m JOIN na ON na.id = item_id JOIN nb ON nb.id = doc_id WHERE least(na.n, nb.n) >= 5 AND c / least(na.n, nb.n) >= 0.9""",
)
def _(t):
    def sets(df, key):
        return df.select(key, P.shingle_hashes(T.canonical_body(F.col("text"))).alias("hashes"))

    out = D.containment_between(sets(t.benchmark, "item_id"), sets(t.documents, "doc_id"), "item_id", "doc_id")
    return out.select(F.col("left_key").alias("item_id"), F.col("right_key").alias("doc_id"), F.round("contained", 6).alias("contained"))


@query(
    "bodies_contained",
    f"""WITH n AS (SELECT DISTINCT {Q.body_norm('body_text')} AS body_norm FROM fx_emails), norm AS MATERIALIZED (SELECT sha256(body_norm) AS id, body_norm FROM n),
        sh AS ({Q.shingle_rows('norm')}), h AS MATERIALIZED (SELECT DISTINCT id, {Q.hash28('shingle')} AS h FROM sh), s AS (SELECT id, count(*) AS n FROM h GROUP BY 1 HAVING count(*) >= 5),
        m AS (SELECT a.id AS small_key, b.id AS large_key, count(*) AS c FROM h a JOIN h b ON a.h = b.h AND a.id <> b.id GROUP BY 1, 2)
        SELECT small_key, large_key, round(c / x.n, 6) AS contained FROM m JOIN s x ON x.id = small_key JOIN s y ON y.id = large_key WHERE (x.n < y.n OR (x.n = y.n AND small_key < large_key)) AND c / x.n >= 0.9""",
)
def _(t):
    prints = materialise(D.review_prints(t.fx_emails).select("id", "body_hash", "hashes"))
    return D.held_bodies(prints).withColumn("contained", F.round("contained", 6))


@query(
    "pending_duplicate_counts",
    "SELECT e.id, count(p.email_a_id) AS pending_duplicates FROM fx_emails e LEFT JOIN (SELECT * FROM fx_pairs WHERE status = 'pending') p ON e.id IN (p.email_a_id, p.email_b_id) GROUP BY e.id",
)
def _(t):
    return D.pending_counts(t.fx_pairs, t.fx_emails)


_PENDING = "pend AS (SELECT * FROM fx_pairs WHERE status = 'pending')"


@query("cluster_members", f"WITH RECURSIVE {_PENDING}, {_ROOTS.format(a='email_a_id', b='email_b_id', pairs='pend')} SELECT cluster_id, id FROM roots")
def _(t):
    return D.cluster_members(t.fx_pairs)


@query(
    "canonical_copies",
    f"""WITH RECURSIVE {_PENDING}, {_ROOTS.format(a='email_a_id', b='email_b_id', pairs='pend')}, f AS ({_FACTS}),
        o AS (SELECT r.cluster_id, f.id, row_number() OVER (PARTITION BY r.cluster_id ORDER BY {_BEST.format(id='f.id')}) AS k FROM roots r JOIN f ON f.id = r.id)
        SELECT cluster_id, id AS suggested_canonical_id FROM o WHERE k = 1""",
)
def _(t):
    members = D.cluster_members(t.fx_pairs)
    return D.suggest_canonical(members.join(_facts(t), "id"), ["cluster_id"])


@query(
    "exact_pairs_resolved",
    f"""WITH f AS ({_FACTS}), k AS (SELECT id, row_number() OVER (ORDER BY {_BEST.format(id='id')}) AS k FROM f),
        x AS (SELECT p.*, status = 'pending' AND reason IN ('same_source_sha256', 'same_message_id', 'same_body_hash') AS hit, ka.k < kb.k AS a_first FROM fx_pairs p JOIN k ka ON ka.id = email_a_id JOIN k kb ON kb.id = email_b_id)
        SELECT email_a_id, email_b_id, CASE WHEN hit THEN 'duplicate' ELSE status END AS status, CASE WHEN hit THEN CASE WHEN a_first THEN email_a_id ELSE email_b_id END END AS canonical_email_id FROM x""",
)
def _(t):
    return D.resolve_exact(_pairs(t), _facts(t)).select("email_a_id", "email_b_id", "status", "canonical_email_id")


@query("exact_pair_count", "SELECT count(*) AS exact_pairs FROM fx_pairs WHERE status = 'pending' AND reason IN ('same_source_sha256', 'same_message_id', 'same_body_hash')")
def _(t):
    return D.count_exact(_pairs(t))


@query(
    "clusters_resolved",
    f"""WITH RECURSIVE {_PENDING}, {_ROOTS.format(a='email_a_id', b='email_b_id', pairs='pend')}
        SELECT email_a_id, email_b_id, CASE WHEN status = 'pending' THEN 'duplicate' ELSE status END AS status,
        CASE WHEN status = 'pending' THEN CASE WHEN email_b_id = cluster_id THEN email_b_id ELSE email_a_id END END AS canonical_email_id
        FROM fx_pairs LEFT JOIN roots ON roots.id = email_a_id""",
)
def _(t):
    choices = D.cluster_members(t.fx_pairs).withColumnRenamed("cluster_id", "canonical_id")
    return D.resolve_clusters(t.fx_pairs, choices).select("email_a_id", "email_b_id", "status", "canonical_email_id")


@query(
    "pairs_merged",
    """WITH g AS (SELECT case_id, email_a_id, email_b_id + 5 AS email_b_id, 0.95::DOUBLE AS score, 'regenerated' AS reason FROM fx_pairs WHERE score > 0.95
                  UNION ALL SELECT case_id, email_a_id, email_b_id, 0.96::DOUBLE, 'regenerated' FROM fx_pairs WHERE score <= 0.95)
       SELECT coalesce(o.email_a_id, g.email_a_id) AS email_a_id, coalesce(o.email_b_id, g.email_b_id) AS email_b_id, CASE WHEN o.status <> 'pending' THEN o.score ELSE g.score END AS score,
       CASE WHEN o.status <> 'pending' THEN o.reason ELSE g.reason END AS reason, CASE WHEN o.status <> 'pending' THEN o.status ELSE 'pending' END AS status
       FROM fx_pairs o FULL JOIN g ON o.case_id = g.case_id AND o.email_a_id = g.email_a_id AND o.email_b_id = g.email_b_id WHERE o.status <> 'pending' OR g.score IS NOT NULL""",
)
def _(t):
    old = t.fx_pairs.withColumnRenamed("reason", "reasons")
    shifted = old.filter("score > 0.95").withColumn("email_b_id", F.col("email_b_id") + 5).withColumn("score", F.lit(0.95))
    again = old.filter("score <= 0.95").withColumn("score", F.lit(0.96))
    new = shifted.unionByName(again).withColumn("reasons", F.lit("regenerated"))
    return D.merge_pairs(old, new).select("email_a_id", "email_b_id", "score", F.col("reasons").alias("reason"), "status")


_DECISION = """SELECT case_id, email_a_id, email_b_id, CASE email_a_id % 3 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'dissimilar' ELSE 'other' END AS new_status, email_a_id AS keep,
   CASE WHEN email_b_id % 2 = 0 THEN email_b_id ELSE email_a_id END AS copy FROM fx_pairs"""
_VALID = "(new_status = 'dissimilar' OR (new_status = 'duplicate' AND keep <> copy))"


def _decided(t):
    status = F.when(F.col("email_a_id") % 3 == 0, "duplicate").when(F.col("email_a_id") % 3 == 1, "dissimilar").otherwise("other")
    copy = F.when(F.col("email_b_id") % 2 == 0, F.col("email_b_id")).otherwise(F.col("email_a_id"))
    asked = t.fx_pairs.select("case_id", "email_a_id", "email_b_id", status.alias("status"), F.col("email_a_id").alias("canonical_email_id"), copy.alias("duplicate_email_id"))
    return D.apply_decisions(t.fx_pairs, asked)


@query(
    "decisions_applied",
    f"""SELECT p.email_a_id, p.email_b_id, CASE WHEN {_VALID} THEN new_status ELSE status END AS status, CASE WHEN {_VALID} AND new_status = 'duplicate' THEN keep END AS canonical_email_id
        FROM fx_pairs p JOIN ({_DECISION}) d ON d.email_a_id = p.email_a_id AND d.email_b_id = p.email_b_id""",
)
def _(t):
    return _decided(t)[0].select("email_a_id", "email_b_id", "status", "canonical_email_id")


@query("decisions_refused", f"SELECT email_a_id, email_b_id, new_status FROM ({_DECISION}) d WHERE NOT {_VALID}")
def _(t):
    return _decided(t)[1].select("email_a_id", "email_b_id", "new_status")


@query("pairs_listed", "SELECT email_a_id, email_b_id, score FROM fx_pairs WHERE status = 'pending'")
def _(t):
    return D.list_pairs(t.fx_pairs).select("email_a_id", "email_b_id", "score")


# ---- batches against what is stored


def _two_batches(t):
    """(what the first half of the ids left in store, its pairs, the other half's rows)."""
    emails = t.fx_emails
    middle = emails.select(F.avg("id")).scalar()
    store = delta.review_store(emails.filter(F.col("id") <= middle))
    return store, materialise(delta.stored_pairs(store)), emails.filter(F.col("id") > middle)


@query("ingest_pairs", f"WITH {_BASE}, {_KEYS}, {_PAIRS}, {_SCORED} SELECT * FROM scored")
def _(t):
    """The pairs of two batches, the second one only compared with what the first one left in store."""
    store, pairs, rest = _two_batches(t)
    return pairs.unionByName(delta.added_pairs(store, rest)[0]).withColumn("codes", _codes()).drop("reasons")


@query("trash_pairs", f"WITH {_BASE}, {_KEYS}, {_PAIRS}, {_SCORED} SELECT * FROM scored")
def _(t):
    """The pairs that are left when trashed rows leave the store; the next row of a file, message or body takes their place."""
    store = delta.review_store(t.fx_emails.withColumn("deleted_at", F.lit(None).cast("timestamp")))
    pairs = materialise(delta.stored_pairs(store)).withColumn("status", F.lit("pending"))
    gone = t.fx_emails.filter("deleted_at IS NOT NULL").select("id")
    rest = delta.merge_added(pairs, gone, delta.removed_rows(store, gone)[0])
    return rest.withColumn("codes", _codes()).drop("reasons", "status")


@query("ingest_clusters", f"WITH RECURSIVE {_BASE}, {_KEYS}, {_PAIRS}, {_SCORED}, {_ROOTS.format(a='email_a_id', b='email_b_id', pairs='scored')} SELECT cluster_id, id FROM roots")
def _(t):
    """Clusters of the first batch joined by the pairs that the second one adds."""
    store, pairs, rest = _two_batches(t)
    members = materialise(D.cluster_members(pairs.withColumn("status", F.lit("pending"))))
    return delta.added_members(members, delta.added_pairs(store, rest)[0])


@query("clusters_changed", f"WITH RECURSIVE {_PENDING}, {_ROOTS.format(a='email_a_id', b='email_b_id', pairs='pend')} SELECT cluster_id, id FROM roots")
def _(t):
    """Clusters of pairs of any status, after the decided ones went and further pending ones came."""
    late = F.col("email_a_id") % 5 == 0
    before, later = t.fx_pairs.filter(~late), t.fx_pairs.filter(late & (F.col("status") == "pending"))
    members = materialise(D.cluster_members(before.withColumn("status", F.lit("pending"))))
    open_, decided = before.filter("status = 'pending'"), before.filter("status <> 'pending'")
    return delta.changed_members(members, open_, decided, later)
