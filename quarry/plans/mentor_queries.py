"""Mentor-session and profile queries over `mentor_v` (from feedback_v), `conversations`, `events`."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import mentor as mo
from quarry.plans.catalog import query
from quarry.sources.views import _WS, mentor_view, table, with_views


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


_WS_SQL = """(CASE mtype WHEN 'positive' THEN 1.0 WHEN 'negative' THEN 0.5 WHEN 'correction' THEN 0.8
                WHEN 'enhancement' THEN 0.6 ELSE 0.0 END)"""
_SC_SQL = """(CASE WHEN rating IS NOT NULL THEN (s0 + rating / 5.0) / 2.0 ELSE s0 END)"""
_M_SQL = f"""SELECT *, {_WS_SQL} AS wt, {_SC_SQL} AS sc FROM (
  SELECT *, CASE mtype WHEN 'positive' THEN 1.0 WHEN 'negative' THEN 0.0 WHEN 'correction' THEN 0.7
              WHEN 'enhancement' THEN 0.8 ELSE 0.0 END AS s0 FROM mentor_v)"""
_PHASE_SQL = f"""
WITH m AS ({_M_SQL}),
x AS (SELECT feedback_id, session_id, ts, count(*) OVER w AS feedback_count, sum(wt) OVER w AS sw,
        sum(wt * sc) OVER w AS sws
      FROM m WINDOW w AS (PARTITION BY session_id ORDER BY ts, feedback_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT session_id, CASE WHEN sw > 0 THEN sws / sw ELSE 0.0 END AS decision_score FROM x WHERE feedback_count = 10),
p AS (SELECT x.*, CASE WHEN feedback_count < 5 THEN 'initial' WHEN feedback_count < 10 THEN 'feedback'
                       WHEN d.decision_score >= 0.7 THEN 'validation' ELSE 'refinement' END AS phase
      FROM x LEFT JOIN d USING (session_id)),
fp AS (SELECT session_id, arg_max(phase, feedback_count) AS phase FROM p GROUP BY session_id)"""


@query("f_improvement_score", with_views(f"""
SELECT session_id, round(CASE WHEN sum(wt) > 0 THEN sum(wt * sc) / sum(wt) ELSE 0.0 END, 9) AS improvement_score
FROM ({_M_SQL}) GROUP BY session_id""", "mentor_v"))
def f_improvement_score(spark, sf):
    s = mo.improvement_score(mentor_view(spark, sf))
    return s.select("session_id", _r("improvement_score", 9).alias("improvement_score"))


@query("f_session_phase", with_views(_PHASE_SQL + """
SELECT feedback_id, session_id, feedback_count, phase FROM p""", "mentor_v"))
def f_session_phase(spark, sf):
    p = mo.session_phase(mentor_view(spark, sf))
    return p.select("feedback_id", "session_id", "feedback_count", "phase")


@query("f_feedback_ids", with_views("""
SELECT feedback_id, printf('fb_%s_%03d', CAST(session_id AS VARCHAR),
  row_number() OVER (PARTITION BY session_id ORDER BY ts, feedback_id)) AS mentor_feedback_id FROM mentor_v""",
                                    "mentor_v"))
def f_feedback_ids(spark, sf):
    return mo.feedback_ids(mentor_view(spark, sf)).select("feedback_id", "mentor_feedback_id")


@query("f_session_duration", with_views("""
SELECT session_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS duration_hours
FROM mentor_v GROUP BY session_id""", "mentor_v"))
def f_session_duration(spark, sf):
    d = mo.session_duration(mentor_view(spark, sf))
    return d.select("session_id", _r("duration_hours").alias("duration_hours"))


def _top_words_sql(mtype: str, n: int, out: str) -> str:
    return f"""
SELECT session_id, string_agg(word, ',' ORDER BY rk) AS {out} FROM (
  SELECT session_id, word, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(an * 1000000 + pos)) AS rk
  FROM (SELECT session_id, an, unnest(toks) AS word, unnest(range(len(toks))) AS pos FROM (
          SELECT session_id, row_number() OVER (ORDER BY ts, feedback_id) AS an,
            [x for x in regexp_split_to_array(lower(feedback_text), '{_WS}') if x <> '' AND length(x) > 4] AS toks
          FROM mentor_v WHERE mtype = '{mtype}'))
  GROUP BY session_id, word) WHERE rk <= {n} GROUP BY session_id"""


_PATTERNS_SQL = f"""
SELECT c.session_id, c.positive_count, c.negative_count, c.correction_count, c.enhancement_count,
  coalesce(ni.common_issues, '') AS common_issues, coalesce(ea.enhancement_areas, '') AS enhancement_areas,
  round(coalesce(c.average_rating, 0.0), 6) AS average_rating
FROM (SELECT session_id, count(*) FILTER (WHERE mtype = 'positive') AS positive_count,
        count(*) FILTER (WHERE mtype = 'negative') AS negative_count,
        count(*) FILTER (WHERE mtype = 'correction') AS correction_count,
        count(*) FILTER (WHERE mtype = 'enhancement') AS enhancement_count, avg(rating) AS average_rating
      FROM mentor_v GROUP BY session_id) c
LEFT JOIN ({_top_words_sql('negative', 5, 'common_issues')}) ni USING (session_id)
LEFT JOIN ({_top_words_sql('enhancement', 3, 'enhancement_areas')}) ea USING (session_id)"""


@query("f_feedback_patterns", with_views(_PATTERNS_SQL, "mentor_v"))
def f_feedback_patterns(spark, sf):
    p = mo.feedback_patterns(mentor_view(spark, sf))
    return p.select("session_id", "positive_count", "negative_count", "correction_count", "enhancement_count",
                    F.array_join("common_issues", ",").alias("common_issues"),
                    F.array_join("enhancement_areas", ",").alias("enhancement_areas"),
                    _r("average_rating").alias("average_rating"))


@query("f_mentor_suggestions", with_views(f"""
SELECT session_id, concat_ws(' | ',
  CASE WHEN negative_count > positive_count THEN 'Focus on addressing recurring negative feedback patterns' END,
  CASE WHEN correction_count > 3 THEN 'Consider expanding training data with corrected examples' END,
  CASE WHEN enhancement_areas <> '' THEN 'Explore enhancement opportunities' END) AS suggestions
FROM ({_PATTERNS_SQL})""", "mentor_v"))
def f_mentor_suggestions(spark, sf):
    s = mo.mentor_suggestions(mo.feedback_patterns(mentor_view(spark, sf)))
    return s.select("session_id", F.array_join("suggestions", " | ").alias("suggestions"))


@query("f_mentor_totals", with_views(_PHASE_SQL + f""",
sc AS (SELECT session_id, CASE WHEN sum(wt) > 0 THEN sum(wt * sc) / sum(wt) ELSE 0.0 END AS score FROM m GROUP BY session_id),
per AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE NOT applied) AS pend, first(adapter_id) AS a
        FROM mentor_v GROUP BY session_id)
SELECT count(*) AS total_sessions, CAST(sum(per.n) AS BIGINT) AS total_feedback, CAST(sum(per.pend) AS BIGINT) AS pending_feedback,
  round(coalesce(avg(sc.score) FILTER (WHERE fp.phase = 'validation'), 0.0), 6) AS average_improvement,
  count(*) FILTER (WHERE fp.phase = 'validation') AS completed_sessions,
  count(DISTINCT per.a) FILTER (WHERE fp.phase = 'validation') AS adapters_trained
FROM per JOIN fp USING (session_id) JOIN sc USING (session_id)""", "mentor_v"))
def f_mentor_totals(spark, sf):
    t = mo.mentor_totals(mentor_view(spark, sf))
    return t.select("total_sessions", "total_feedback", "pending_feedback",
                    _r("average_improvement").alias("average_improvement"), "completed_sessions", "adapters_trained")


@query("f_apply_feedback", with_views(_PHASE_SQL + """
SELECT m.session_id, m.feedback_id, md5(nullif(m.corrected_response, '')) AS corrected_md5, md5(m.feedback_text) AS input_md5,
  md5(m.original_response) AS original_md5, m.mtype AS feedback_type, CASE WHEN m.rating <> 0 THEN m.rating END AS rating
FROM mentor_v m JOIN fp USING (session_id) WHERE fp.phase IN ('refinement', 'validation') AND NOT m.applied""", "mentor_v"))
def f_apply_feedback(spark, sf):
    a = mo.apply_feedback(mentor_view(spark, sf))
    e = {n: F.md5(F.col(f"example.{c}").cast("binary")).alias(n) for n, c in
         (("corrected_md5", "corrected_output"), ("input_md5", "input"), ("original_md5", "original_output"))}
    return a.select("session_id", "feedback_id", *e.values(), "example.feedback_type", "example.rating")


# ----------------------------------------------------------------------------- profiles
def _elements(spark, sf):
    c = table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "user", "decision_pattern").when(F.col("role") == "assistant", "quote") \
        .otherwise("case_study")
    return c.select(F.concat(F.lit("profile_"), (F.col("conv_id") % 10).cast("string")).alias("name"),
                    kind.alias("kind"), "conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"),
                    "text", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("situation"),
                    F.col("text").alias("decision"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("outcome"))


_ELEM_SQL = """SELECT 'profile_' || CAST(conv_id % 10 AS VARCHAR) AS name,
  CASE role WHEN 'user' THEN 'decision_pattern' WHEN 'assistant' THEN 'quote' ELSE 'case_study' END AS kind,
  conv_id, turn, text FROM conversations"""


@query("f_profile_examples", f"""
SELECT name, kind, conv_id, turn,
  CASE kind WHEN 'decision_pattern' THEN 'How would ' || name || ' approach this situation?'
            WHEN 'quote' THEN 'What is ' || name || '''s philosophy?'
            ELSE 'In conversation ' || CAST(conv_id AS VARCHAR) || ', what would ' || name || ' do?' END AS input,
  CASE kind WHEN 'decision_pattern' THEN 'Based on ' || name || '''s approach: ' || text
            WHEN 'quote' THEN name || ' believes: ' || text
            ELSE name || ' would: ' || text || '. This approach typically results in: turn ' || CAST(turn AS VARCHAR) END AS output
FROM ({_ELEM_SQL})""")
def f_profile_examples(spark, sf):
    e = _elements(spark, sf)
    x = mo.profile_examples(e)
    return x.join(e.select("name", "kind", "ordinal", "conv_id", "turn"), ["name", "kind", "ordinal"]) \
        .select("name", "kind", "conv_id", "turn", "input", "output")


def _adapters(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("k")).distinct()
    return e.select(F.concat(F.lit("ad"), F.col("k").cast("string")).alias("adapter_id"),
                    F.concat(F.lit("profile_"), (F.col("k") * 2).cast("string")).alias("legendary_profile"),
                    F.when(F.col("k") % 2 == 0, "technical").otherwise("legal").alias("domain"))


_ADAPTERS_SQL = """SELECT DISTINCT 'ad' || CAST(user_id % 5 AS VARCHAR) AS adapter_id,
  'profile_' || CAST((user_id % 5) * 2 AS VARCHAR) AS legendary_profile,
  CASE WHEN (user_id % 5) % 2 = 0 THEN 'technical' ELSE 'legal' END AS domain FROM events"""


@query("f_profile_adapters", f"""
SELECT p.name, coalesce(string_agg(a.adapter_id, ',' ORDER BY a.adapter_id), '') AS available_adapters
FROM (SELECT DISTINCT name FROM ({_ELEM_SQL})) p LEFT JOIN ({_ADAPTERS_SQL}) a ON a.legendary_profile = p.name
GROUP BY p.name""")
def f_profile_adapters(spark, sf):
    prof = _elements(spark, sf).select("name").distinct()
    p = mo.profiles_with_adapters(prof, _adapters(spark, sf))
    return p.select("name", F.array_join("available_adapters", ",").alias("available_adapters"))


@query("f_start_sessions", f"""
SELECT r.session_id, r.adapter_id, a.adapter_id IS NOT NULL AS accepted, a.legendary_profile
FROM (SELECT DISTINCT user_id AS session_id, 'ad' || CAST(user_id % 7 AS VARCHAR) AS adapter_id FROM events) r
LEFT JOIN ({_ADAPTERS_SQL}) a USING (adapter_id)""")
def f_start_sessions(spark, sf):
    req = table(spark, sf, "events").select(F.col("user_id").alias("session_id"),
                                            F.concat(F.lit("ad"), (F.col("user_id") % 7).cast("string")).alias("adapter_id")).distinct()
    ok, bad = mo.start_sessions(req, _adapters(spark, sf))
    return (ok.select("session_id", "adapter_id", F.lit(True).alias("accepted"), "legendary_profile")
            .unionByName(bad.select("session_id", "adapter_id", F.lit(False).alias("accepted"),
                                    F.lit(None).cast("string").alias("legendary_profile"))))


@query("f_profiles_merge", f"""
WITH a AS (SELECT name, 'builtin' AS origin, count(*) AS n FROM ({_ELEM_SQL}) WHERE kind = 'decision_pattern' GROUP BY name),
b AS (SELECT name, 'custom' AS origin, count(*) AS n FROM ({_ELEM_SQL}) WHERE kind = 'case_study' GROUP BY name),
c AS (SELECT name, 'quoted' AS origin, count(*) AS n FROM ({_ELEM_SQL}) WHERE kind = 'quote' AND substr(name, 9)::INT % 2 = 0 GROUP BY name),
u AS (SELECT *, 0 AS src FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c)
SELECT name, arg_max(origin, src) AS origin, arg_max(n, src) AS n FROM u GROUP BY name""")
def f_profiles_merge(spark, sf):
    e = _elements(spark, sf)
    a = e.filter(F.col("kind") == "decision_pattern").groupBy("name").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("origin", F.lit("builtin"))
    b = e.filter(F.col("kind") == "case_study").groupBy("name").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("origin", F.lit("custom"))
    c = e.filter((F.col("kind") == "quote") & (F.substring("name", 9, 9).cast("int") % 2 == 0)).groupBy("name").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("origin", F.lit("quoted"))       # a source that has half of the profiles
    return mo.merge_profiles(a, b, c).select("name", "origin", "n")


# ----------------------------------------------------------------------------- T8 batch twin
@query("f_sessions", """
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 4 HOUR AS session_end, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 4 HOUR THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
  FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
GROUP BY user_id, sid""")
def f_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("ts", "4 hours").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
