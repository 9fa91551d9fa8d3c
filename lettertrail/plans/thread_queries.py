"""Thread, chain and relation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import delta
from ..operators import relations as R
from ..operators import threads as G
from ..session import materialise
from . import checksql as Q
from .registry import query
from .text_queries import STAMP, stamp

_PARENTS = f"""n AS MATERIALIZED (SELECT *, {Q.msgid_norm('message_id')} AS ref, {Q.msgid_norm('in_reply_to')} AS parent_ref, concat('subj:', {Q.subject_norm('subject')}) AS subject_key FROM fx_replies),
  holder AS (SELECT case_id, ref, arg_max(id, row(date_utc, id)) AS parent_id FROM n WHERE ref IS NOT NULL GROUP BY 1, 2),
  p AS MATERIALIZED (SELECT n.*, h.parent_id FROM n LEFT JOIN holder h ON h.case_id = n.case_id AND h.ref = n.parent_ref)"""
# walk up; a row that answers itself ends the walk with its own subject key
_THREADS = f"""{_PARENTS}, up(id, top, parent, ref, subject_key) AS (SELECT id, id, parent_id, ref, subject_key FROM p UNION ALL
    SELECT up.id, p.id, p.parent_id, p.ref, p.subject_key FROM up JOIN p ON p.id = up.parent WHERE up.parent <> up.top),
  t AS MATERIALIZED (SELECT id, CASE WHEN parent IS NULL THEN concat('msg:', ref) ELSE subject_key END AS thread_id FROM up WHERE parent IS NULL OR parent = top)"""


def _with_threads(replies):
    """The rows with `thread_id` and `parent_email_id`; columns ride along, since rows may share an id."""
    carry = tuple(c for c in replies.columns if c not in ("id", "case_id"))
    return G.assign_threads(replies, carry).withColumnRenamed("parent_id", "parent_email_id").drop("changed")


@query("reply_parents", f"WITH {_PARENTS} SELECT id, case_id, parent_id FROM p")
def _(t):
    return G.reply_parents(t.fx_replies)


@query("threads_assigned", f"WITH RECURSIVE {_THREADS} SELECT t.id, t.thread_id, p.parent_id FROM t JOIN p ON p.id = t.id")
def _(t):
    return G.assign_threads(t.fx_replies).select("id", "thread_id", "parent_id")


@query("ingest_threads", f"WITH RECURSIVE {_THREADS} SELECT t.id, t.thread_id, p.parent_id FROM t JOIN p ON p.id = t.id")
def _(t):
    """Threads of two batches: messages and their answers arrive in either order, only threads that the second batch meets are read again."""
    late = F.crc32(F.col("id").cast("string")) % 2 == 1
    stored = materialise(_with_threads(t.fx_replies.filter(~late)))
    changed = materialise(delta.changed_threads(stored, t.fx_replies.filter(late), carry=("message_id",)))
    row = ["id", "case_id", "message_id"]
    kept = stored.join(changed.select(*row), row, "left_anti").select("id", "thread_id", F.col("parent_email_id").alias("parent_id"))
    return kept.unionByName(changed.select("id", "thread_id", "parent_id"))


@query(
    "threads_changed",
    f"WITH RECURSIVE {_THREADS} SELECT t.id, t.thread_id FROM t JOIN p ON p.id = t.id",
)
def _(t):
    return G.assign_threads(t.fx_replies.withColumn("thread_id", F.lit("old"))).filter("changed").select("id", "thread_id")


@query(
    "chain_conflicts",
    """WITH d AS (SELECT * FROM fx_chain WHERE date_utc IS NOT NULL),
       s AS (SELECT id, date_utc, max(date_utc) OVER w AS top, arg_max(id, row(date_utc, -chain_position, -id)) OVER w AS holder FROM d WINDOW w AS (PARTITION BY chain_source_id ORDER BY chain_position, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT id FROM s WHERE date_utc > top UNION SELECT holder FROM s WHERE date_utc > top""",
)
def _(t):
    return G.chain_conflicts(t.fx_chain)


_CONFLICT = """d AS (SELECT * FROM fx_chain WHERE date_utc IS NOT NULL), late AS (SELECT DISTINCT chain_source_id FROM (SELECT chain_source_id, date_utc > max(date_utc) OVER (PARTITION BY chain_source_id ORDER BY chain_position, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM d) x WHERE hit),
  anchor AS (SELECT chain_source_id, min(date_utc) AS anchor FROM fx_chain WHERE chain_source_id IN (SELECT chain_source_id FROM late) GROUP BY 1)"""


@query(
    "chains_in_reading_order",
    f"""WITH {_CONFLICT} SELECT id, c.chain_source_id, row_number() OVER (PARTITION BY c.chain_source_id ORDER BY coalesce(anchor, coalesce(date_utc, TIMESTAMP '1970-01-01')), CASE WHEN anchor IS NOT NULL THEN -chain_position ELSE 0 END, id) AS place
        FROM fx_chain c LEFT JOIN anchor a ON a.chain_source_id = c.chain_source_id""",
)
def _(t):
    rows = t.fx_chain.withColumn("created_at", F.lit("1970-01-01 00:00:00").cast("timestamp"))
    marked = G.chain_conflicts(rows).withColumn("hit", F.lit(True))
    keyed = G.chain_reading_key(rows, marked)
    return keyed.select("id", "chain_source_id", F.row_number().over(Window.partitionBy("chain_source_id").orderBy("reading_key")).cast("long").alias("place"))


def _threaded(t):
    return _with_threads(t.fx_replies).withColumn("created_at", F.col("date_utc")).withColumn("manual_chrono_order", F.when(F.col("id") % 31 == 0, F.col("id") % 100))


@query(
    "thread_groups",
    f"""WITH RECURSIVE {_THREADS}, e AS (SELECT r.*, t.thread_id, CASE WHEN r.id % 31 = 0 THEN r.id % 100 END AS m FROM fx_replies r JOIN t ON t.id = r.id),
        o AS (SELECT *, row_number() OVER (PARTITION BY case_id, thread_id ORDER BY m NULLS LAST, date_utc, id) AS k, count(*) OVER (PARTITION BY case_id, thread_id) AS n FROM e)
        SELECT case_id, thread_id AS thread_key, n AS size, regexp_replace(a.subject, '^Re: ', '') AS subject, strftime(a.date_utc, '{STAMP}') AS first_date, strftime(z.date_utc, '{STAMP}') AS last_date
        FROM (SELECT * FROM o WHERE k = 1) a JOIN (SELECT case_id, thread_id, date_utc FROM o WHERE k = n) z USING (case_id, thread_id)""",
)
def _(t):
    groups = G.thread_groups(_threaded(t))
    return groups.withColumn("first_date", stamp("first_date")).withColumn("last_date", stamp("last_date"))


@query(
    "month_groups",
    """SELECT case_id, coalesce(strftime(e.date_utc AT TIME ZONE 'UTC' AT TIME ZONE c.default_tz, '%Y-%m'), 'no-date') AS month, count(*) AS emails FROM fx_emails e JOIN fx_cases c ON c.id = e.case_id
       WHERE e.deleted_at IS NULL AND superseded_at IS NULL GROUP BY 1, 2""",
)
def _(t):
    zones = t.fx_cases.select(F.col("id").alias("case_id"), "default_tz")
    live = t.fx_emails.filter("deleted_at IS NULL AND superseded_at IS NULL").join(zones, "case_id")
    return G.month_groups(live, F.col("default_tz"))


@query(
    "one_chain",
    f"""WITH RECURSIVE {_THREADS} SELECT id FROM t WHERE thread_id = (SELECT thread_id FROM t ORDER BY id LIMIT 1)""",
)
def _(t):
    emails = materialise(_threaded(t)).withColumn("chain_source_id", F.lit(None).cast("long")).withColumn("chain_position", F.lit(0))
    first = t.fx_replies.agg(F.min("id").alias("id")).first()["id"]
    return G.chain_of(emails, first).select("id")


def _related(t):
    none = F.array().cast("array<string>")
    return materialise(_threaded(t)).withColumn("references", none).withColumn("to", none).withColumn("cc", F.array(F.lit("all@x"))).withColumn(
        "from_addr", F.concat(F.lit("p"), (F.col("id") % 3).cast("string"))
    ).withColumn("chain_source_id", F.lit(None).cast("long")).withColumn("source_kind", F.lit("standalone")).withColumn(
        "relation_confidence", F.when(F.col("id") % 2 == 0, "high").otherwise("med")
    )


def _relation_check(focus: str, where: str) -> str:
    return f"""WITH RECURSIVE {_THREADS}, e AS (SELECT p.*, t.thread_id FROM p JOIN t ON t.id = p.id), f AS ({focus}),
      x AS (SELECT e.id, f.id AS focus_id, least(CASE WHEN e.id % 2 = 0 THEN 3 ELSE 2 END, CASE WHEN f.id % 2 = 0 THEN 3 ELSE 2 END) AS lvl,
        CASE WHEN e.id = f.id THEN 'Focus' WHEN e.parent_id = f.id OR e.in_reply_to = f.message_id THEN 'Reply' WHEN f.parent_id = e.id OR f.in_reply_to = e.message_id THEN 'Parent'
          WHEN e.thread_id = f.thread_id THEN 'Same thread' WHEN e.subject = f.subject THEN 'Inferred' ELSE '' END AS label
        FROM e JOIN f ON {where})
      SELECT id, focus_id, label, CASE label WHEN 'Focus' THEN 'high' WHEN 'Inferred' THEN 'low' ELSE CASE lvl WHEN 3 THEN 'high' ELSE 'med' END END AS confidence FROM x"""


@query("relations_to_focus", _relation_check("SELECT * FROM e WHERE id = (SELECT min(id) FROM e)", "true"))
def _(t):
    first = t.fx_replies.agg(F.min("id").alias("id")).first()["id"]
    return R.relations_to(_related(t), first)


@query(
    "relations_in_threads",
    _relation_check("SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY date_utc, id) = 1", "f.thread_id = e.thread_id"),
)
def _(t):
    return R.relations_in_threads(_related(t))
