"""Queries over sessions: the composed analysis, spans and change sets, facets, and the batch forms of stream state."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.operators import analysis, facets, places, reports, segment, spans
from textgate.plans.catalogue import _SPANS_SQL, documents, line_spans, lines, pairs, query
from textgate.sources import tables
from textgate.streaming import state

# ---- the composed analysis


def _stub(sentences: list[str]) -> list[dict]:
    """A proposer for tests of the whole: what it says follows from the sentence alone."""
    out = []
    for s in sentences:
        k = zlib.crc32(s.encode()) % 6
        said = [s, s.rsplit(" ", 1)[0], s.replace(" and ", " or "), s.replace(" is ", " is not "), s.replace(" in order to ", " to "), s.translate(str.maketrans("0123456789", "7777777777"))][k]
        if k == 0 and len(s) % 5 == 0:
            raise RuntimeError("no answer")
        out.append({"action": "keep" if k == 0 else "rewrite", "replacement": said, "reason": "shorter", "latency": len(s)})
    return out


def _second(questions: list[tuple[str, str, list[str]]]) -> list[dict]:
    return [{"verdict": ("show", "hide", "none")[len(lost[0]) % 3], "reason": lost[0]} for _, _, lost in questions]


@query()
def analysis_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through every stage of the analysis, with a proposer and a verifier that answer by rule, by what came of them."""
    done = analysis.analyzed(lines(spark, sf_dir), _stub, _second, text="line", with_rules=True)
    o = F.col("outcome")
    stage = F.when(o["stages"]["model"], "model").when(o["stages"]["rule"], "rule").when(o["replacement"].isNotNull(), "mechanics").otherwise("nothing")
    return done.groupBy(stage.alias("stage"), o["rejection"].alias("rejection"), o["model_rejection"].alias("model_rejection"), o["error"]["kind"].alias("error")).agg(F.count("*").alias("n"), F.sum(o["latency"]).alias("latency"))


@query()
def deletion_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts of the deletion policy the pairs set off."""
    told = analysis.diagnosed(pairs(spark, sf_dir))
    return told.select((F.col("line_no") % 8).alias("kind"), F.explode_outer("guards").alias("fired")).groupBy("kind", "fired").agg(F.count("*").alias("n"))


# ---- spans


@query()
def eligible_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that a proposer may be shown, and why others may not."""
    docs = documents(spark, sf_dir)
    met = spans.eligible(segment.sentences(docs, keep=("doc_id", "lang")), spans.excluded_ranges(docs))
    return met.groupBy("lang", "left_out").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT user_id, event_id, event_id AS s, event_id + 40 AS e FROM events WHERE event_type IN ('purchase', 'view')), r AS (SELECT user_id, event_id AS s, event_id + event_id % 90 AS e FROM events WHERE event_type = 'error') SELECT user_id, event_id FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = a.user_id AND r.s < r.e AND r.s < a.e AND a.s < r.e)")
def clear_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a user's purchases and views that no span of an error reaches into."""
    events = tables.read(spark, sf_dir, "events")
    mine = events.where("event_type in ('purchase', 'view')").select("user_id", "event_id", F.col("event_id").alias("start"), (F.col("event_id") + 40).alias("end"))
    bad = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + F.col("event_id") % 90).alias("end"))
    return spans.clear_of(mine, bad, "user_id").select("user_id", "event_id")


_EDITS_SQL = "d AS (SELECT doc_id, start AS a, CASE WHEN i % 3 = 0 THEN start + least(n, 4) ELSE start END AS b, CASE WHEN i % 3 = 0 THEN i % 5 ELSE 2 END AS n FROM s WHERE i % 3 < 2), m AS (SELECT doc_id, i, start + i % 4 AS at_, CASE WHEN i % 2 = 0 THEN -1 ELSE 1 END AS side FROM s)"


@query(f"WITH {_SPANS_SQL}, {_EDITS_SQL}, t AS (SELECT m.doc_id, m.i, at_, side, coalesce(sum(d.n - (d.b - d.a)) FILTER (d.b < at_ OR (d.b = at_ AND (d.a < d.b OR side >= 0))), 0) AS moved, max(d.a) FILTER (d.a < at_ AND at_ < d.b) AS in_a, max(d.n) FILTER (d.a < at_ AND at_ < d.b) AS in_n FROM m LEFT JOIN d ON d.doc_id = m.doc_id GROUP BY ALL) SELECT doc_id, i::INTEGER AS i, (moved + CASE WHEN in_a IS NULL THEN at_ WHEN side < 0 THEN in_a ELSE in_a + in_n END)::BIGINT AS now, in_a IS NOT NULL AS deleted FROM t")
def reanchored_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark in every line carried through a change set that puts two characters before lines, and others for the first four of a line."""
    rows, i = line_spans(spark, sf_dir), F.col("i")
    end = F.when(i % 3 == 0, F.col("start") + F.least(F.length("line"), F.lit(4))).otherwise(F.col("start"))
    edits = rows.where("i % 3 < 2").select("doc_id", "start", end.alias("end"), F.when(i % 3 == 0, i % 5).otherwise(2).alias("size"))
    marks = rows.select("doc_id", "i", (F.col("start") + i % 4).alias("at"), F.when(i % 2 == 0, -1).otherwise(1).alias("side"))
    return spans.reanchored(marks, edits, "doc_id").select("doc_id", "i", "now", "deleted")


_FACETS_SQL = "WITH r AS (SELECT d.lang, d.source, l.quality, contains(lower(d.text), 'the') AS hit FROM documents d LEFT JOIN labels l USING (doc_id)) "


@query(
    _FACETS_SQL
    + """SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM r WHERE hit AND quality = 1 GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM r WHERE hit AND lang = 'en' AND quality = 1 GROUP BY source
UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM r WHERE hit AND lang = 'en' GROUP BY quality
UNION ALL SELECT '', 'shown', count(*) FROM r WHERE hit AND lang = 'en' AND quality = 1
UNION ALL SELECT '', 'all', count(*) FROM r"""
)
def faceted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents of good quality with a word: how many of all, and what each filter would offer."""
    rows = documents(spark, sf_dir).join(tables.read(spark, sf_dir, "labels"), "doc_id", "left")
    return facets.faceted(rows, ("lang", "source", "quality"), {"lang": "en", "quality": 1}, "The", ("text",))


@query("SELECT source, n AS total, changed, row_number() OVER (ORDER BY changed / n DESC, first) AS rank FROM (SELECT d.source, count(*) AS n, count(*) FILTER (l.toxic = 1) AS changed, min(d.doc_id) AS first FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source)")
def classes_by_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the share of their documents that are toxic."""
    rows = tables.read(spark, sf_dir, "documents").join(tables.read(spark, sf_dir, "labels"), "doc_id", "left")
    told = reports.class_counts(rows.withColumn("hit", F.coalesce(F.col("toxic") == 1, F.lit(False))), "source", "hit", "doc_id")
    return told.withColumn("rank", F.col("rank").cast("long"))


@query(r"""WITH l AS (SELECT page_id, unnest(string_split(url || chr(10) || html, chr(10))) AS line, unnest(range(1, len(string_split(url || chr(10) || html, chr(10))) + 1)) AS n FROM pages), u AS (SELECT page_id, n, unnest(regexp_extract_all(line, '(?i)https?://[^\s"''`)<>\]}\\]+')) AS url FROM l) SELECT page_id, n::INTEGER AS line, url, regexp_extract(regexp_replace(url, '(?i)^https?://', ''), '^[^/?#]*') AS host, count(*) AS n FROM u GROUP BY ALL""")
def addresses_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages by line, with their host."""
    pages = tables.spread(tables.read(spark, sf_dir, "pages")).select("page_id", F.concat("url", F.lit("\n"), "html").alias("text"))
    found = places.addresses(pages, key="page_id").where(F.col("host") != "(protocol-relative)")
    return found.groupBy("page_id", "line", "url", "host").agg(F.count("*").alias("n"))


# ---- state


_TEXTS_SQL = "t AS (SELECT user_id AS id, ts, 't' || (event_id % 3) AS text FROM events WHERE event_type IN ('view', 'click')), a AS (SELECT user_id AS id, event_id AS answer_id, ts, ts - INTERVAL 6 HOUR AS asked FROM events WHERE event_type NOT IN ('view', 'click'))"


@query(f"WITH {_TEXTS_SQL}, m AS (SELECT a.*, t.text AS made_for FROM a ASOF LEFT JOIN t ON a.id = t.id AND a.asked >= t.ts) SELECT m.id, m.answer_id, m.made_for FROM m ASOF JOIN t ON m.id = t.id AND m.ts >= t.ts WHERE t.text = m.made_for AND t.ts >= m.ts - INTERVAL 2 DAY")
def fresh_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, made for the text of six hours before, that still meet that text."""
    events = tables.read(spark, sf_dir, "events").withColumnRenamed("user_id", "id")
    said = F.col("event_type").isin("view", "click")
    texts = events.where(said).select("id", "ts", F.concat(F.lit("t"), F.col("event_id") % 3).alias("text"))
    asked = events.where(~said).select("id", F.col("event_id").alias("answer_id"), "ts", (F.col("ts") - F.expr("INTERVAL 6 HOURS")).alias("asked"))
    answers = state.as_of(asked, texts.withColumnRenamed("ts", "asked"), "id", "asked", "text", "made_for")
    return state.fresh_answers_of_log(texts, answers, oldest="2 DAYS").select("id", "answer_id", "made_for")


@query(
    """WITH e AS (SELECT user_id AS id, event_id AS seq, ts, 't' || (event_id % 2) AS text, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'answered' ELSE 'transient' END AS kind FROM events),
b AS (SELECT *, CASE WHEN lag(text) OVER w IS DISTINCT FROM text OR coalesce(lag(kind) OVER w = 'answered', true) THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY id ORDER BY ts, seq)),
n AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS entry FROM b),
r AS (SELECT *, row_number() OVER v + CASE WHEN first_value(kind) OVER v = 'failed' THEN 1 ELSE 0 END AS k FROM n WHERE kind <> 'answered' WINDOW v AS (PARTITION BY id, entry ORDER BY ts, seq)),
h AS (SELECT *, greatest(k - 1, 0) AS rounds FROM r)
SELECT id, seq, CASE WHEN rounds > 0 THEN 'held' ELSE 'again' END AS state, text, CAST(rounds AS INTEGER) AS rounds, CAST(CASE WHEN rounds > 0 THEN least(60 * power(2, least(rounds, 10) - 1), 600) END AS BIGINT) AS hold_seconds FROM h"""
)
def retry_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of a user's texts: which may be tried at once, and how long the others are held."""
    events = tables.read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "answered").otherwise("transient")
    log = events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("t"), F.col("event_id") % 2).alias("text"), kind.alias("kind"))
    told = state.retries_of_log(log).join(log.select("id", "seq", "ts"), ["id", "seq"])
    return told.select("id", "seq", "state", "text", "rounds", F.timestamp_diff("SECOND", F.col("ts"), F.col("until")).alias("hold_seconds"))


@query("SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS begins, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'purchase') AS shown, max(event_id) FILTER (event_type <> 'error') AS slowest, sum(event_id) FILTER (event_type <> 'error') / count(*) FILTER (event_type <> 'error') AS mean FROM events GROUP BY 1")
def gauge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, failures and latency of each six hours."""
    log = tables.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    told = state.gauges(log, width="6 hours", outcome=F.col("event_type") == "purchase", latency="event_id", failed=F.col("event_type") == "error")
    return told.select(F.unix_timestamp("start").alias("begins"), "requests", "failures", "shown", "slowest", "mean")
