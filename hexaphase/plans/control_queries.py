"""Queries of the control plane, of reuse and of the alignment of windows, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as cf
from ..operators import control as ct
from ..operators import decisions as de
from ..operators import pipeline as pl
from ..operators import reuse as ru
from ..operators import serving as sv
from ..operators import timeline as tl
from ..sources import tables as t
from .registry import query
from .signal_queries import rounded
from .stream_queries import CO, EP, EV, SL, _continuity, _epochs

KINDS = {"click": "gate", "view": "direction", "signup": "tracking", "purchase": "count", "error": "follow"}
_KIND = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in KINDS.items()) + " END"


def _controls(spark, sf):
    """Thresholds are up to 1.2, which is refused above 1; switches are on above 50."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("event_type"))
    ev = t.hops(spark, sf).withColumn("kind", kind)
    threshold = F.col("kind").isin("gate", "direction")
    return ev.withColumn("value", F.when(threshold, F.round(F.col("value") / 80, 1)).otherwise(F.when(F.col("value") > 50, 1.0).otherwise(0.0)))


_C = f"""{EV}, k0 AS (SELECT user_id, h, event_id, {_KIND} AS kind, CASE WHEN {_KIND} IN ('gate', 'direction') THEN round(value / 80, 1) WHEN value > 50 THEN 1.0 ELSE 0.0 END AS v FROM ev),
 k1 AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'gate' AND v BETWEEN 0 AND 1 THEN v END IGNORE NULLS) OVER w, 0.8) AS gate_threshold, coalesce(last_value(CASE WHEN kind = 'direction' AND v BETWEEN 0 AND 1 THEN v END IGNORE NULLS) OVER w, 0.35) AS direction_threshold,
  coalesce(last_value(CASE WHEN kind = 'tracking' THEN v > 0 END IGNORE NULLS) OVER w, true) AS tracking, coalesce(last_value(CASE WHEN kind = 'count' THEN v > 0 END IGNORE NULLS) OVER w, true) AS counting FROM k0 WINDOW w AS (PARTITION BY user_id ORDER BY h)),
 k2 AS (SELECT *, kind IN ('gate', 'direction') AND v > 1 OR kind = 'follow' AND v > 0 AND NOT counting AS refused, coalesce(lag(gate_threshold) OVER w, 0.8) AS g0, coalesce(lag(tracking) OVER w, true) AS t0, coalesce(lag(counting) OVER w, true) AS c0 FROM k1 WINDOW w AS (PARTITION BY user_id ORDER BY h)),
 k3 AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'follow' AND NOT refused THEN v > 0 WHEN kind = 'count' AND v = 0 THEN false END IGNORE NULLS) OVER w, true) AS following, count(*) FILTER (kind = 'gate' AND v <= 1 AND gate_threshold <> g0) OVER w AS gate_revision, count(*) FILTER (kind = 'direction' AND v <= 1 OR tracking <> t0) OVER w AS scan_revision,
  count(*) FILTER (t0 AND NOT tracking) OVER w AS id_revision, count(*) FILTER (counting <> c0) OVER w AS count_revision FROM k2 WINDOW w AS (PARTITION BY user_id ORDER BY h))"""
_STATES = ["gate_threshold", "direction_threshold", "tracking", "counting", "following", "gate_revision", "scan_revision", "id_revision", "count_revision", "refused"]


@query("control_revisions", f"WITH {_C} SELECT user_id, event_id, {', '.join(_STATES)} FROM k3")
def control_revisions(spark, sf):
    return ct.control_states(_controls(spark, sf), ["user_id"], ["h"]).select("user_id", "event_id", *_STATES)


@query("denoiser_choice", f"WITH {EV}, o AS (SELECT *, event_type = 'click' AS is_on FROM ev), l AS (SELECT *, coalesce(max(is_on::INT) OVER (PARTITION BY user_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS late FROM o) SELECT user_id, event_id, CASE WHEN late THEN h - 1 WHEN NOT is_on THEN h END AS emits, late AND is_on AS denoised FROM l")
def denoiser_choice(spark, sf):
    return ct.denoiser_choice(t.hops(spark, sf), ["user_id"], "h", F.col("event_type") == "click").select("user_id", "event_id", "emits", "denoised")


_SG = f"""RECURSIVE {EP}, sg AS (SELECT user_id, h, event_id, us, epoch, us AS anchor, true AS kept FROM ep WHERE h = 0
 UNION ALL SELECT e.user_id, e.h, e.event_id, e.us, e.epoch, CASE WHEN e.epoch <> sg.epoch OR e.us - anchor >= 86400000000 THEN e.us ELSE anchor END, e.epoch <> sg.epoch OR e.us - anchor >= 86400000000 FROM sg JOIN ep e ON e.user_id = sg.user_id AND e.h = sg.h + 1)"""


@query("submit_gate", f"WITH {_SG} SELECT user_id, event_id FROM sg WHERE kept")
def submit_gate(spark, sf):
    """A row is handed on if a day has passed since the last one that was; an epoch starts anew."""
    return ct.submissions(_epochs(spark, sf), ["user_id"], "us", 86_400_000_000, "epoch", ["h"]).select("user_id", "event_id")


@query("discarded_tail", f"WITH {EP}, n AS (SELECT user_id, epoch, max(end_sample) AS samples FROM ep GROUP BY ALL) SELECT user_id, epoch, samples, greatest(0, samples - (CASE WHEN samples < 7680 THEN 6720 ELSE 6720 + ((samples - 7680) // 960 + 1) * 960 END))::BIGINT AS discarded FROM n")
def discarded_tail(spark, sf):
    rows = _epochs(spark, sf).withColumnRenamed("user_id", "session")
    return pl.discarded_tails(rows).select(F.col("session").alias("user_id"), "epoch", "samples", F.col("discarded").cast("long").alias("discarded"))


_GI = f"{SL}, q AS (SELECT user_id, epoch, end_sample + CASE WHEN event_type = 'view' THEN 960 ELSE 0 END AS at, end_sample, p, event_type FROM ep), gi AS (SELECT w.user_id, w.window_id, w.decision_sample, q.p, q.event_type, q.end_sample FROM wn w LEFT JOIN q ON q.user_id = w.user_id AND q.epoch = w.epoch AND q.at = w.decision_sample)"


@query("gate_identity", f"WITH {_GI}, one AS (SELECT * FROM gi QUALIFY row_number() OVER (PARTITION BY user_id, window_id ORDER BY end_sample) = 1) SELECT user_id, window_id, CASE WHEN event_type IS NULL THEN 'unavailable' WHEN end_sample <> decision_sample THEN 'invalid' WHEN event_type = 'error' THEN 'warming_up' WHEN p >= 0.8 THEN 'open' ELSE 'closed' END AS gate FROM one")
def gate_identity(spark, sf):
    """A probability that arrives with a window but is of another interval makes its gate invalid."""
    ep = _epochs(spark, sf)
    late = F.when(F.col("event_type") == "view", 960).otherwise(0)
    hops = ep.select("user_id", "epoch", (F.col("end_sample") + late).alias("decision_sample"), F.col("end_sample").alias("own"), "p", "event_type")
    hops = hops.groupBy("user_id", "epoch", "decision_sample").agg(F.min_by(F.struct("own", "p", "event_type"), "own").alias("_h")).select("user_id", "epoch", "decision_sample", "_h.*")
    j = tl.sliding(ep.drop("p", "event_type"), ["user_id"]).select("user_id", "epoch", "window_id", "decision_sample").join(hops, ["user_id", "epoch", "decision_sample"], "left")
    state = F.when(F.col("event_type").isNull(), "unavailable").when(F.col("event_type") == "error", "warming_up").otherwise("ready")
    matches = F.col("event_type").isNull() | (F.col("own") == F.col("decision_sample"))
    return de.gate(j.withColumn("state", state), "p", "state", 0.8, matches).select("user_id", "window_id", "gate")


@query("vote_gaps", f"WITH {EV}, r AS (SELECT *, floor(value)::BIGINT % 3 AS raw, coalesce(us - lag(us) OVER w > 50 * 3600000000::BIGINT, false)::INT AS gap FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)), g AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY us) AS run FROM r), v AS (SELECT *, CASE WHEN raw = lag(raw, 1) OVER w OR raw = lag(raw, 2) OVER w THEN raw WHEN lag(raw, 1) OVER w = lag(raw, 2) OVER w THEN lag(raw, 1) OVER w END AS v FROM g WINDOW w AS (PARTITION BY user_id, run ORDER BY us)) SELECT user_id, event_id, raw, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY us) AS stable FROM v")
def vote_gaps(spark, sf):
    """A gap forgets the votes before it."""
    ev = t.hops(spark, sf).withColumn("raw", F.expr("cast(floor(value) as long) % 3"))
    return de.vote(ev, ["user_id"], "us", "raw", 50 * 3_600_000_000).select("user_id", "event_id", "raw", "stable")


@query("scan_runs", f"WITH {EV}, o AS (SELECT *, value > 30 AS is_on, coalesce(us - lag(us) OVER w > 40 * 3600000000::BIGINT, false) AS gap FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY h)), s AS (SELECT *, sum((NOT is_on OR gap)::INT) OVER (PARTITION BY user_id ORDER BY h) AS g FROM o) SELECT user_id, event_id, CASE WHEN is_on THEN row_number() OVER (PARTITION BY user_id, g, is_on ORDER BY h) ELSE 0 END::BIGINT AS k FROM s")
def scan_runs(spark, sf):
    """Runs of scanned windows; a gap begins one anew. Hops far apart stand for windows that were dropped."""
    w = Window.partitionBy("user_id").orderBy("h")
    gap = F.coalesce(F.col("us") - F.lag("us").over(w) > 40 * 3_600_000_000, F.lit(False)).cast("long")
    ev = t.hops(spark, sf).withColumn("_gap", gap).withColumn("at", F.col("h") * 960 + 960 * F.sum("_gap").over(w))
    return de.open_run(ev, ["user_id"], "at", F.col("value") > 30, step=960).select("user_id", "event_id", "k")


_RU = f"""{EV}, c AS (SELECT *, h % 4 = 0 OR event_type = 'signup' AS computed, (h + 1) * 960 * 20 AS now FROM ev), x AS (SELECT *, CASE WHEN computed THEN struct_pack(theta := angle, state := CASE WHEN value > 60 THEN 'confirmed' WHEN value > 30 THEN 'coasting' ELSE 'tentative' END, seen := now - (event_id % 5) * 960) END AS tr FROM c),
 y AS (SELECT *, last_value(tr IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY h) AS held FROM x)"""


@query("reuse_retimed", f"WITH {_RU} SELECT user_id, event_id, round(held.theta, 6) AS theta, CASE held.state WHEN 'confirmed' THEN 'coasting' ELSE held.state END AS state, greatest(0, now - held.seen)::BIGINT AS missed FROM y WHERE NOT computed AND held IS NOT NULL AND now - held.seen < CASE held.state WHEN 'tentative' THEN 24000 ELSE 96000 END")
def reuse_retimed(spark, sf):
    """Windows that are not computed show the last computed tracks, as far as they still live."""
    state = F.when(F.col("value") > 60, "confirmed").when(F.col("value") > 30, "coasting").otherwise("tentative")
    ev = t.hops(spark, sf).withColumn("now", (F.col("h") + 1) * 960 * 20).withColumn("computed", (F.col("h") % 4 == 0) | (F.col("event_type") == "signup"))
    one = F.struct(F.col("angle").alias("theta"), state.alias("state"), F.col("angle").alias("measured_theta"), (F.col("now") - (F.col("event_id") % 5) * 960).alias("last_observed"), F.lit(True).alias("is_observed"), F.lit(False).alias("is_new"), F.lit(0).cast("long").alias("missed"))
    held = ru.held_tracks(ev.withColumn("tracks", F.array(one)), ["user_id"], "h", F.col("computed"), "tracks")
    out = ru.retimed(held.where("not computed"), "now").select("user_id", "event_id", F.explode("held").alias("x"))
    return rounded(out.where("x.measured_theta is null and not x.is_observed").select("user_id", "event_id", "x.theta", "x.state", "x.missed"), "theta")


@query("reuse_marks", f"WITH {EV} SELECT user_id, event_id, event_type || ':adaptive_reuse_previous_output' AS reason, CASE WHEN value > 50 THEN 'kept,' ELSE '' END || 'reused_at_period_ms=' || (20 * (1 + event_id % 3)) AS diagnostics FROM ev")
def reuse_marks(spark, sf):
    """Marks that a reused row has already are not repeated."""
    ev = t.hops(spark, sf).withColumn("reason", F.when(F.col("h") % 2 == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit(ru.REUSED))))
    notes = F.when(F.col("value") > 50, F.array(F.lit("kept"), F.lit(f"{ru.PERIOD}40"))).otherwise(F.array(F.lit(f"{ru.PERIOD}20")))
    out = ru.reuse_marks(ev.withColumn("notes", notes).withColumn("period", 20 * (1 + F.col("event_id") % 3)), "reason", "notes", "period")
    return out.select("user_id", "event_id", "reason", F.concat_ws(",", "notes").alias("diagnostics"))


@query("reuse_admission", f"WITH {EV}, a AS (SELECT *, lag(event_type) OVER w IS NULL OR event_type <> lag(event_type) OVER w OR user_id % 3 <> lag(user_id % 3) OVER w AS force, value >= 30 AS is_open, CASE WHEN value >= 60 THEN 2 WHEN value >= 30 THEN 1 END AS o, lag(CASE WHEN value >= 60 THEN 2 WHEN value >= 30 THEN 1 END) OVER w AS lo, lag(h) OVER w IS NOT NULL AS has FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY h)) SELECT user_id, event_id, force, NOT force AND has AND (NOT is_open OR coalesce(o IN (1, 2, 3) AND (lo IS NULL OR lo = o), false)) AS may_reuse FROM a")
def reuse_admission(spark, sf):
    ev = t.hops(spark, sf).withColumn("part", F.col("user_id") % 3).withColumn("o", F.when(F.col("value") >= 60, 2).when(F.col("value") >= 30, 1))
    w = Window.partitionBy("user_id").orderBy("h")
    ev = ru.forced(ev, ["user_id"], "h", ["event_type", "part"]).withColumn("lo", F.lag("o").over(w)).withColumn("has", F.lag("h").over(w).isNotNull())
    return ev.select("user_id", "event_id", "force", ru.may_reuse(F.col("force"), F.col("has"), F.col("value") >= 30, F.col("o"), F.col("lo")).alias("may_reuse"))


@query("fault_snapshot", f"WITH {EV} SELECT user_id, event_id, 'unavailable' AS gate, 'adaptive_fault_fallback_v1' AS backend, 'l2_processing_fault' AS gate_reason, false AS sound_present, 'adaptive_fault:' || event_type || ':' || event_id AS missing_reason FROM ev WHERE event_type = 'error'")
def fault_snapshot(spark, sf):
    errors = t.hops(spark, sf).where("event_type = 'error'").withColumn("error", F.concat_ws(":", "event_type", F.col("event_id").cast("string")))
    return ru.fault_rows(errors, "error").select("user_id", "event_id", "gate", "backend", "gate_reason", "sound_present", "missing_reason")


@query("identity_quad", f"WITH {SL}, a AS (SELECT user_id, epoch, window_id, decision_sample, context_mean FROM wn) SELECT user_id, epoch, window_id, decision_sample, round(context_mean, 8) AS gate, round(context_mean * 2, 8) AS counted, round(context_mean * 3, 8) AS scanned FROM a")
def identity_quad(spark, sf):
    """Gate, count and scan of a window meet on all four parts of its identity; one that lacks a part would raise."""
    w = tl.sliding(_epochs(spark, sf), ["user_id"], "p")
    keys = ["user_id", "epoch", "window_id", "decision_sample"]
    part = lambda name, k: w.select(*keys, F.round(F.col("context_mean") * k, 8).alias(name))
    return pl.aligned(pl.aligned(part("gate", 1), part("counted", 2), keys), part("scanned", 3), keys)


@query("directions_in_active", f"WITH {EV}, d AS (SELECT user_id, h // 4 AS win, event_id FROM ev WHERE value > 40), a AS (SELECT user_id, h // 4 AS win, event_id FROM ev WHERE value > 45) SELECT user_id, win, event_id, EXISTS (SELECT 1 FROM a WHERE a.user_id = d.user_id AND a.win = d.win AND a.event_id = d.event_id) AS active FROM d")
def directions_in_active(spark, sf):
    """Which published directions are among the active tracks: a semi join and its complement."""
    ev = t.hops(spark, sf).withColumn("win", F.expr("h div 4"))
    d, a = (ev.where(F.col("value") > x).select("user_id", "win", "event_id") for x in (40, 45))
    keys = ["user_id", "win", "event_id"]
    return d.join(a, keys, "left_semi").withColumn("active", F.lit(True)).unionByName(d.join(a, keys, "left_anti").withColumn("active", F.lit(False)))


@query("hop_of_block", f"WITH {EP}, b AS (SELECT user_id, epoch, event_id, end_sample - 960 AS s, CASE WHEN event_type = 'view' THEN end_sample + 960 ELSE end_sample END AS e FROM ep) SELECT b.user_id, b.event_id, round(h.p, 6) AS p FROM b LEFT JOIN ep h ON h.user_id = b.user_id AND h.epoch = b.epoch AND h.end_sample - 960 = b.s AND h.end_sample = b.e")
def hop_of_block(spark, sf):
    """A block gets a hop's values only if one hop has just its bounds."""
    ep = _epochs(spark, sf)
    blocks = ep.select("user_id", "epoch", "event_id", F.col("start_sample"), F.when(F.col("event_type") == "view", F.col("end_sample") + 960).otherwise(F.col("end_sample")).alias("end_sample"))
    hops = ep.select("user_id", "epoch", "start_sample", "end_sample", "p")
    return rounded(blocks.join(hops, ["user_id", "epoch", "start_sample", "end_sample"], "left").select("user_id", "event_id", "p"), "p")


@query("overload_stage", f"WITH {EV}, w AS (SELECT user_id, h // 8 AS win, {', '.join(f'coalesce(max(value) FILTER (event_type = {x!r}), 0) AS {x}' for x in KINDS)} FROM ev GROUP BY ALL), u AS (SELECT * FROM w UNPIVOT (v FOR stage IN ({', '.join(KINDS)}))) SELECT user_id, win, max_by(stage, (v, stage)) AS stage, round(max(v), 6) AS ms FROM u WHERE v > 40 GROUP BY ALL")
def overload_stage(spark, sf):
    """Of each window's stages over the limit, the slowest."""
    stages = F.array(*(F.struct(F.col(x).alias("ms"), F.lit(x).alias("stage")) for x in KINDS))
    w = t.hops(spark, sf).withColumn("win", F.expr("h div 8")).groupBy("user_id", "win").agg(*(F.coalesce(F.max(F.when(F.col("event_type") == x, F.col("value"))), F.lit(0.0)).alias(x) for x in KINDS))
    top = w.withColumn("top", F.array_max(F.filter(stages, lambda x: x["ms"] > 40))).where("top is not null")
    return rounded(top.select("user_id", "win", "top.stage", "top.ms"), "ms")


@query("window_sequences", f"WITH {EV}, s AS (SELECT user_id, h, list(event_id % 4 ORDER BY h) OVER (PARTITION BY user_id ORDER BY h ROWS 7 PRECEDING) AS ids FROM ev), n AS (SELECT user_id, h, unnest(ids) AS i, generate_subscripts(ids, 1) AS k FROM s), f AS (SELECT user_id, h, i, min(k) AS k FROM n GROUP BY ALL) SELECT user_id, h, string_agg(i, ',' ORDER BY k) AS ids FROM f GROUP BY ALL")
def window_sequences(spark, sf):
    """The sequence numbers of a window's blocks, each once, in order."""
    w = Window.partitionBy("user_id").orderBy("h").rowsBetween(-7, 0)
    return t.hops(spark, sf).withColumn("ids", F.array_distinct(F.collect_list(F.col("event_id") % 4).over(w))).select("user_id", "h", F.concat_ws(",", "ids").alias("ids"))


@query("queue_status", f"WITH {EV} SELECT user_id, max(CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 7 END) AS depth, max(50 + event_id % 2) AS capacity, count(*) FILTER (event_type = 'error') AS faults, round(count(*) FILTER (value > 50)::DOUBLE / ((max(us) - min(us)) / 1e6 + 1), 12) AS hz FROM ev GROUP BY user_id")
def queue_status(spark, sf):
    """A monitor's line per stream: the fullest queue, faults, and results per second."""
    ev = t.hops(spark, sf)
    seconds = (F.max("us") - F.min("us")) / 1e6 + 1
    depth = F.max(F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id") % 7))
    return ev.groupBy("user_id").agg(depth.alias("depth"), F.max(50 + F.col("event_id") % 2).alias("capacity"), F.count_if(F.col("event_type") == "error").alias("faults"), F.round(F.count_if(F.col("value") > 50) / seconds, 12).alias("hz"))


@query("candidate_pairs", f"WITH {EV}, g AS (SELECT user_id, h // 4 AS win, list(round(angle, 6) ORDER BY h) AS c, list(event_id ORDER BY h) AS d FROM ev GROUP BY ALL), z AS (SELECT user_id, win, unnest(c) AS theta, unnest(d) AS event_id, generate_subscripts(c, 1) - 1 AS place FROM g) SELECT user_id, win, place, theta, event_id FROM z")
def candidate_pairs(spark, sf):
    """Candidates and directions of a window, zipped by place."""
    ev = t.hops(spark, sf).withColumn("win", F.expr("h div 4"))
    rows = F.array_sort(F.collect_list(F.struct("h", F.round("angle", 6).alias("theta"), "event_id")))
    g = ev.groupBy("user_id", "win").agg(rows.alias("r")).select("user_id", "win", F.col("r.theta").alias("theta"), F.col("r.event_id").alias("event_id"))
    z = g.select("user_id", "win", F.posexplode(F.arrays_zip("theta", "event_id")).alias("place", "x"))
    return z.select("user_id", "win", F.col("place").cast("long").alias("place"), "x.theta", "x.event_id")


@query("fallback_numbers", f"WITH {EV}, b AS (SELECT *, 500 + (event_id % 7) * 173 AS n FROM ev) SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN h ELSE row_number() OVER w - 1 END AS seq, round(CASE WHEN event_type = 'click' THEN h::DOUBLE ELSE coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 48000 END, 9) AS at FROM b WINDOW w AS (PARTITION BY user_id ORDER BY h)")
def fallback_numbers(spark, sf):
    """Blocks of other kinds than click have no number and no time of their own."""
    own = F.col("event_type") == "click"
    ev = t.hops(spark, sf).withColumns({"seq": F.when(own, F.col("h")), "at": F.when(own, F.col("h").cast("double"))})
    return rounded(tl.numbered(ev, ["user_id"], ["h"], "seq", "at", F.expr("500 + (event_id % 7) * 173")).select("user_id", "event_id", "seq", "at"), "at", digits=9)


@query("rate_rejection", f"WITH {EV}, k AS (SELECT user_id, event_id, h, us FROM ev WHERE event_type <> 'signup') SELECT user_id, event_id, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY h) > 60 * 3600000000::BIGINT THEN 'timestamp_gap' END AS reason FROM k")
def rate_rejection(spark, sf):
    """Blocks of another sample rate are set apart before continuity is judged; they start no epoch."""
    ev = t.hops(spark, sf).withColumn("rate", F.when(F.col("event_type") == "signup", 44_100).otherwise(48_000))
    good, _ = sv.checked(ev, rate=F.col("rate") == 48_000)
    good = good.withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy("h")))
    return tl.continuity(good, ["user_id"], ["h"], "_n", "us", 60 * 3_600_000_000, F.lit(False)).select("user_id", "event_id", "reason")


@query("record_quality", f"WITH {SL} SELECT user_id AS session, window_id, '[' || concat_ws(', ', CASE WHEN window_id % 5 = 0 THEN 'context' END, CASE WHEN window_id % 7 = 0 THEN 'grid' END) || ']' AS broken FROM wn WHERE window_id % 5 = 0 OR window_id % 7 = 0")
def record_quality(spark, sf):
    """Windows that break rules, with the rules' names: contexts one sample long or off the grid."""
    w = tl.sliding(_epochs(spark, sf).withColumnRenamed("user_id", "session"), ["session"]).select("session", "epoch", "window_id", "decision_sample", "context_start")
    off = F.when(F.col("window_id") % 7 == 0, 1).otherwise(0)
    w = w.withColumns({"decision_sample": F.col("decision_sample") + off, "context_start": F.col("context_start") + off + F.when(F.col("window_id") % 5 == 0, 1).otherwise(0)})
    _, bad = sv.checked(w, **sv.window_rules())
    return bad.select("session", "window_id", F.concat(F.lit("["), F.concat_ws(", ", "broken"), F.lit("]")).alias("broken"))


@query("telemetry_bounded", f"WITH {EV}, a AS (SELECT user_id, event_id, count(*) OVER r AS c, avg(value) OVER r AS m, avg(value) OVER l AS b FROM ev WINDOW r AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 720 * 3600000000::BIGINT PRECEDING AND CURRENT ROW), l AS (PARTITION BY user_id ORDER BY us ROWS 3 PRECEDING)) SELECT user_id, event_id, least(c, 4) AS n, round(CASE WHEN c > 4 THEN b ELSE m END, 9) AS mean FROM a")
def telemetry_bounded(spark, sf):
    """A trailing window that keeps four rows at most."""
    out = sv.telemetry(t.hops(spark, sf), ["user_id"], "us", "value", 720 * 3_600_000_000, 4)
    return rounded(out.select("user_id", "event_id", "n", "mean"), "mean", digits=9)


@query("delay_runs", f"WITH {CO} SELECT user_id, event_id, count(*) FILTER (reason IN ('health_event', 'sequence_gap', 'timestamp_gap')) OVER (PARTITION BY user_id ORDER BY h) AS run FROM co")
def delay_runs(spark, sf):
    """Runs of the delay line: a new calibration does not reset it."""
    return tl.run_ids(_continuity(spark, sf), ["user_id"], ["h"]).select("user_id", "event_id", "run")


@query("side_input", f"WITH {EV} SELECT user_id, event_id, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY h) = 0 AS degraded FROM ev")
def side_input(spark, sf):
    """Rows before the first frame of an optional side input go on degraded."""
    return de.side_input(t.hops(spark, sf), ["user_id"], ["h"], F.col("event_type") == "click", ["event_id"]).select("user_id", "event_id", "degraded")


@query("nearest_unwrapped", f"WITH {EV}, l AS (SELECT *, 720.0 * (event_id % 3) - 360 + value AS ref FROM ev) SELECT user_id, event_id, round(ref + (fmod(fmod(angle - ref + 180, 360) + 360, 360) - 180), 6) AS theta FROM l")
def nearest_unwrapped(spark, sf):
    """The angle's turn that is nearest to a reference that is not wrapped."""
    ref = 720.0 * (F.col("event_id") % 3) - 360 + F.col("value")
    return rounded(t.hops(spark, sf).select("user_id", "event_id", cf.nearest_unwrapped("angle", ref).alias("theta")), "theta")
