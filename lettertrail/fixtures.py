"""Message-shaped views over the shared tables, the same SQL text for Spark and for the checking engine.

A fragment in `SPARK_ONLY` replaces one written differently in the two dialects.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import prepare

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# Tables whose rows take real work (long texts, dates to parse); the others are only scanned.
TEXT_TABLES = ("documents", "pages", "events")

VIEWS = {
    "fx_cases": """
SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name,
       CASE r_regionkey WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Singapore' WHEN 2 THEN 'America/New_York' WHEN 3 THEN 'Europe/Paris' ELSE 'UTC' END AS default_tz,
       CASE WHEN r_regionkey = 4 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE NULL END AS deleted_at
FROM {region}""",
    "fx_emails": """
SELECT doc_id AS id, doc_id % 5 AS case_id,
       concat(source, '@example.com') AS from_addr,
       concat(CASE doc_id % 3 WHEN 0 THEN 'Re: ' WHEN 1 THEN 'FW: RE: ' ELSE '' END, lang, '  ', source) AS subject,
       text AS body_text,
       CASE doc_id % 4 WHEN 0 THEN 'standalone' WHEN 1 THEN 'quoted' WHEN 2 THEN 'attached' ELSE 'snipped' END AS source_kind,
       CASE WHEN doc_id % 2 = 0 THEN concat('<M', CAST(doc_id - doc_id % 20 AS STRING), '@X.example>') ELSE NULL END AS message_id,
       md5(text) AS source_sha,
       CASE WHEN doc_id % 17 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST((doc_id * 37) % 5000 AS INT) END AS date_utc,
       TIMESTAMP '2024-02-01 00:00:00' + INTERVAL '1' SECOND * CAST(doc_id AS INT) AS created_at,
       CASE WHEN doc_id % 23 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' + INTERVAL '1' DAY * CAST(doc_id % 60 AS INT) ELSE NULL END AS deleted_at,
       CASE WHEN doc_id % 29 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE NULL END AS superseded_at,
       CASE WHEN doc_id % 31 = 0 THEN doc_id % 100 ELSE NULL END AS manual_chrono_order
FROM {documents}""",
    "fx_replies": """
SELECT conv_id * 100 + turn AS id, conv_id % 5 AS case_id,
       concat('<', CAST(conv_id AS STRING), '.', CAST(turn AS STRING), '@x>') AS message_id,
       CASE WHEN turn = 0 OR (conv_id % 10 = 3 AND turn = 2) THEN NULL
            WHEN conv_id % 10 = 4 AND turn = 1 THEN concat('<', CAST(conv_id AS STRING), '.1@X>')
            ELSE concat('<', CAST(conv_id AS STRING), '.', CAST(turn - 1 AS STRING), '@X>') END AS in_reply_to,
       concat('Re: topic ', CAST(conv_id % 7 AS STRING)) AS subject,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(conv_id * 10 + turn AS INT) AS date_utc
FROM {conversations}""",
    "fx_chain": """
SELECT conv_id * 100 + turn AS id, conv_id AS chain_source_id, turn AS chain_position,
       CASE WHEN (conv_id + turn) % 11 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST((conv_id * 31 + turn * turn * 17) % 97 AS INT) END AS date_utc
FROM {conversations}""",
    "fx_spans": """
SELECT doc_id AS source_email_id, 'body' AS source_field, n_chars AS field_length,
       (doc_id * 13 + k * 97) % n_chars AS start_offset,
       least(n_chars, (doc_id * 13 + k * 97) % n_chars + 20 + (doc_id * 7 + k * 53) % 200) AS end_offset,
       (doc_id + k + 1) % 1000 AS target_email_id,
       CASE k WHEN 0 THEN 'parsed' WHEN 1 THEN 'quoted' WHEN 2 THEN 'snipped' ELSE 'manual' END AS mapping_kind,
       (doc_id + k) % 9 = 0 AS stale
FROM (SELECT doc_id, n_chars, unnest([0, 1, 2, 3]) AS k FROM {documents}) AS ks
WHERE n_chars > 0""",
    "fx_pairs": """
SELECT a.doc_id % 5 AS case_id, a.doc_id AS email_a_id, b.doc_id AS email_b_id,
       0.92 + CAST(a.doc_id % 9 AS DOUBLE) / 100 AS score,
       CASE a.doc_id % 4 WHEN 0 THEN 'same_body_hash' WHEN 1 THEN 'body_shingle_jaccard' WHEN 2 THEN 'same_message_id' ELSE 'body_containment' END AS reason,
       CASE WHEN a.doc_id % 13 = 0 THEN 'dissimilar' WHEN a.doc_id % 11 = 0 THEN 'duplicate' ELSE 'pending' END AS status
FROM {documents} a JOIN {documents} b ON b.doc_id = a.doc_id + 5 * (1 + a.doc_id % 3)""",
    "fx_tags": """
SELECT CAST(t AS BIGINT) AS id, name FROM (VALUES (1, 'Review'), (2, 'privileged'), (3, 'Hot'), (4, 'Undated'), (5, 'unused')) AS v(t, name)""",
    "fx_email_tags": """
SELECT doc_id AS email_id, CAST(CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 3 END AS BIGINT) AS tag_id FROM {labels}""",
    "fx_files": """
SELECT page_id, page_id % 10 AS job_id, concat('/in/', CAST(page_id AS STRING), CASE page_id % 5 WHEN 0 THEN '.MSG' WHEN 1 THEN '.txt' ELSE '.eml' END) AS path,
       CAST(length(html) AS BIGINT) AS size, md5(html) AS digest, html AS content,
       CASE WHEN page_id % 5 = 1 THEN 'failed' WHEN page_id % 8 = 0 THEN 'skipped' ELSE 'parsed' END AS status
FROM {pages}""",
    "fx_page_text": """
SELECT conv_id AS doc_id, turn + 1 AS page_no,
       concat('CONFIDENTIAL', chr(10), text, chr(10), 'Corp - Page ', CAST(turn + 1 AS STRING), ' of 8') AS text
FROM {conversations}""",
    "fx_boilerplate": """
SELECT doc_id AS id,
       CASE WHEN doc_id % 3 = 0 THEN concat(text, chr(10), chr(10), 'WARNING: This  message originated', chr(10), 'outside your organization, PLEASE be vigilant.')
            WHEN doc_id % 3 = 1 THEN concat(text, chr(10), '--', chr(10), 'Jane') ELSE text END AS body_text
FROM {documents}""",
    "fx_edits": """
SELECT event_id AS edit_id, event_id % 300 AS email_id,
       CASE event_type WHEN 'click' THEN 'subject' WHEN 'view' THEN 'notes' WHEN 'error' THEN 'from_addr' ELSE 'body_text' END AS field,
       concat('v', CAST(user_id % 4 AS STRING)) AS new_value, ts
FROM {events}""",
    "fx_audit": """
SELECT event_id AS id, user_id % 5 AS case_id, event_type AS action, ts AS created_at, props,
       CASE WHEN event_id = 0 THEN NULL WHEN event_id % 997 = 0 THEN 'broken' ELSE md5(CAST(event_id - 1 AS STRING)) END AS prev_hash,
       md5(CAST(event_id AS STRING)) AS event_hash
FROM {events}""",
    "fx_dates": """
SELECT event_id AS id, event_id % 5 AS case_id,
       CASE event_id % 4
         WHEN 0 THEN concat(CAST(EXTRACT(DAY FROM ts) AS STRING), '/', CAST(EXTRACT(MONTH FROM ts) AS STRING), '/2024 ', lpad(CAST(EXTRACT(HOUR FROM ts) AS STRING), 2, '0'), ':', lpad(CAST(EXTRACT(MINUTE FROM ts) AS STRING), 2, '0'))
         WHEN 1 THEN concat('2024-01-', lpad(CAST(EXTRACT(DAY FROM ts) AS STRING), 2, '0'), 'T', lpad(CAST(EXTRACT(HOUR FROM ts) AS STRING), 2, '0'), ':15:00+08:00')
         WHEN 2 THEN concat(CAST(EXTRACT(DAY FROM ts) AS STRING), ' Jan 2024 ', lpad(CAST(EXTRACT(HOUR FROM ts) AS STRING), 2, '0'), ':30:05 -0500')
         ELSE 'not a date' END AS date_raw
FROM {events}""",
}

SPARK_ONLY = {"unnest([0, 1, 2, 3])": "explode(array(0, 1, 2, 3))"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # the test tables are single files, which one task would read; a table of many files stays as it is
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXT_TABLES and len(df.inputFiles()) < cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame."""
    prepare(spark)
    text = VIEWS[name]
    for given, ours in SPARK_ONLY.items():
        text = text.replace(given, ours)
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def check_sql(body: str) -> str:
    """Put the views a checking query mentions in front of it."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", body)]
    if not used:
        return body.strip()
    names = {t: t for t in TABLES}
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].format(**names).strip()})" for name in used)
    return f"WITH {ctes}\nSELECT * FROM (\n{body.strip()}\n) AS answer"
