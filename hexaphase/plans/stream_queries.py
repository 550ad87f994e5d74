"""Queries over hop streams (events per user), each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import circular_distance, signed_delta
from ..operators import decisions as de
from ..operators import recurrences as rc
from ..operators import recut
from ..operators import sequential as sq
from ..operators import timeline as tl
from ..sources import tables as t
from .registry import query
from .signal_queries import rounded

EV = """ev AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS h,
 least(value / 100, 1.0) AS p, fmod(value * 3.6, 360) AS angle FROM events)"""
HOUR = 3_600_000_000
CO = f"""{EV}, sq AS (SELECT *, h + count(*) FILTER (event_type = 'signup' AND value > 60) OVER o AS seq, count(*) FILTER (event_type = 'purchase') OVER o // 5 AS cal FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY h)),
 co AS (SELECT *, CASE WHEN event_type = 'error' AND value > 60 THEN 'health_event' WHEN cal <> lag(cal) OVER w THEN 'calibration_change' WHEN seq <> lag(seq) OVER w + 1 THEN 'sequence_gap' WHEN us - lag(us) OVER w > {60 * HOUR} THEN 'timestamp_gap' END AS reason FROM sq WINDOW w AS (PARTITION BY user_id ORDER BY h))"""
EP = f"""{CO}, e0 AS (SELECT *, count(reason) OVER (PARTITION BY user_id ORDER BY h) AS epoch FROM co), ep AS (SELECT *, 960 * row_number() OVER (PARTITION BY user_id, epoch ORDER BY h) AS end_sample FROM e0)"""


def _continuity(spark, sf):
    w = Window.partitionBy("user_id").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda cond: F.count(F.when(cond, 1)).over(w)
    jumps = so_far((F.col("event_type") == "signup") & (F.col("value") > 60))
    ev = t.hops(spark, sf).withColumns({"seq": F.col("h") + jumps, "cal": F.floor(so_far(F.col("event_type") == "purchase") / 5)})
    return tl.continuity(ev, ["user_id"], ["h"], "seq", "us", 60 * HOUR, (F.col("event_type") == "error") & (F.col("value") > 60), calibration="cal")


def _epochs(spark, sf):
    return tl.epochs(_continuity(spark, sf), ["user_id"], ["h"], F.lit(960))


@query("continuity_reason", f"WITH {CO} SELECT user_id, event_id, reason FROM co")
def continuity_reason(spark, sf):
    return _continuity(spark, sf).select("user_id", "event_id", "reason")


@query("epoch_axis", f"WITH {EP} SELECT user_id, event_id, epoch, end_sample - 960 AS start_sample, end_sample FROM ep")
def epoch_axis(spark, sf):
    return _epochs(spark, sf).select("user_id", "event_id", "epoch", "start_sample", "end_sample")


@query("discontinuities", f"WITH {EP} SELECT user_id, h, epoch - 1 AS old_epoch, epoch AS new_epoch, reason FROM ep WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY h DESC) <= 256")
def discontinuities(spark, sf):
    return tl.discontinuities(_epochs(spark, sf), ["user_id"], ["h"])


@query("health_dedup", f"WITH {EV} SELECT event_id, user_id, h AS arrived FROM ev WHERE event_type = 'error'")
def health_dedup(spark, sf):
    errors = t.hops(spark, sf).where("event_type = 'error'").select("event_id", "user_id", F.col("h").alias("arrived"))
    return tl.dedup_events(errors.union(errors.withColumn("arrived", F.col("arrived") + 1)), "event_id", ["arrived"])


@query("handoff_coalesce", f"WITH {EV}, i AS (SELECT *, count(*) FILTER (event_type <> 'view') OVER (PARTITION BY user_id ORDER BY h) AS g FROM ev) SELECT user_id, min(h) AS first, max(h) AS last, count(*) AS events, sum(floor(value)::BIGINT)::BIGINT AS lost FROM i WHERE event_type = 'view' GROUP BY user_id, g")
def handoff_coalesce(spark, sf):
    return tl.coalesce_bursts(t.hops(spark, sf), ["user_id"], "h", F.col("event_type") == "view", F.floor("value").cast("long"))


@query("event_release", f"WITH {EV}, e AS (SELECT user_id, event_id, h, CASE WHEN value > 50 THEN h + 3 END AS after FROM ev WHERE event_type = 'error') SELECT e.user_id, e.event_id, CASE WHEN after IS NULL THEN h ELSE (SELECT min(b.h) FROM ev b WHERE b.user_id = e.user_id AND b.h >= e.after AND b.event_type <> 'click') END AS released_at FROM e")
def event_release(spark, sf):
    ev = t.hops(spark, sf)
    errors = ev.where("event_type = 'error'").select("user_id", "event_id", "h", F.when(F.col("value") > 50, F.col("h") + 3).alias("after"))
    blocks = ev.where("event_type != 'click'").select("user_id", F.col("h").alias("seq"))
    return tl.release(errors, blocks, "user_id", "after", "seq", "h").select("user_id", "event_id", "released_at")


@query("rechunk_hops", f"WITH {EV}, b AS (SELECT *, sum(500 + (event_id % 7) * 173) OVER (PARTITION BY user_id ORDER BY h)::BIGINT AS e, 500 + (event_id % 7) * 173 AS n FROM ev), r AS (SELECT user_id, h, e, e - n AS s, unnest(range((e - n) // 960, (e - 1) // 960 + 1)) AS hop FROM b) SELECT user_id, hop, min(h) AS first, max(h) AS last FROM r GROUP BY user_id, hop HAVING sum(least(e, (hop + 1) * 960) - greatest(s, hop * 960)) = 960")
def rechunk_hops(spark, sf):
    return tl.rechunk(t.hops(spark, sf), ["user_id"], "h", F.expr("500 + (event_id % 7) * 173"))


SL = f"{EP}, sl AS (SELECT user_id, epoch, end_sample AS decision_sample, avg(p) OVER w AS context_mean, count(*) OVER w AS n FROM ep WINDOW w AS (PARTITION BY user_id, epoch ORDER BY h ROWS 7 PRECEDING)), wn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch, decision_sample) - 1 AS window_id FROM sl WHERE n = 8)"


@query("sliding_windows", f"WITH {SL} SELECT user_id, epoch, decision_sample, decision_sample - 7680 AS context_start, round(context_mean, 8) AS context_mean FROM wn")
def sliding_windows(spark, sf):
    return rounded(tl.sliding(_epochs(spark, sf), ["user_id"], "p"), "context_mean", digits=8).select("user_id", "epoch", "decision_sample", "context_start", "context_mean")


@query("window_ids", f"WITH {SL} SELECT user_id, max(window_id) AS last_id, count(*) AS windows, count(DISTINCT epoch) AS epochs FROM wn GROUP BY user_id")
def window_ids(spark, sf):
    w = tl.sliding(_epochs(spark, sf), ["user_id"])
    return w.groupBy("user_id").agg(F.max("window_id").alias("last_id"), F.count("*").alias("windows"), F.countDistinct("epoch").alias("epochs"))


@query("frame_grid", f"WITH {EP}, n AS (SELECT user_id, epoch, max(end_sample) AS n FROM ep GROUP BY ALL) SELECT user_id, epoch, unnest(range(0, (n - 960) // 480 * 480 + 1, 480)) AS frame_start FROM n")
def frame_grid(spark, sf):
    return tl.frame_grid(_epochs(spark, sf), ["user_id"])


@query("hotmap_asof", f"WITH {EV} SELECT e.user_id, e.event_id, c.event_id AS frame_id, e.us - c.us AS age_us FROM ev e ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.h >= c.h WHERE e.event_type = 'purchase'")
def hotmap_asof(spark, sf):
    ev = de.latest_before(t.hops(spark, sf), ["user_id"], ["h"], F.col("event_type") == "click", ["event_id", "us"])
    return ev.where("event_type = 'purchase'").select("user_id", "event_id", F.col("asof_event_id").alias("frame_id"), (F.col("us") - F.col("asof_us")).alias("age_us"))


@query("hop_window_overlap", f"WITH {SL}, x AS (SELECT w.user_id, w.window_id, e.p FROM wn w JOIN ep e ON w.user_id = e.user_id AND w.epoch = e.epoch AND e.end_sample > w.decision_sample - 7680 AND e.end_sample - 960 < w.decision_sample) SELECT user_id, window_id, count(*) AS hops, round(max(p), 6) AS top FROM x GROUP BY ALL")
def hop_window_overlap(spark, sf):
    """The interval join without a join: a window's hops are the last eight rows of its epoch."""
    w = Window.partitionBy("user_id", "epoch").orderBy("end_sample").rowsBetween(-7, 0)
    ep = _epochs(spark, sf).withColumns({"hops": F.count("*").over(w), "top": F.max("p").over(w)})
    return rounded(tl.sliding(ep, ["user_id"]).select("user_id", "window_id", "hops", "top"), "top")


@query("p2_lookup", f"WITH {SL}, r AS (SELECT * FROM ep WHERE event_type <> 'error') SELECT w.user_id, w.window_id, CASE WHEN a.p IS NOT NULL AND b.p IS NOT NULL THEN round(a.p, 6) END AS previous, CASE WHEN a.p IS NOT NULL AND b.p IS NOT NULL THEN round(b.p, 6) END AS current FROM wn w LEFT JOIN r a ON a.user_id = w.user_id AND a.epoch = w.epoch AND a.end_sample = w.decision_sample - 960 LEFT JOIN r b ON b.user_id = w.user_id AND b.epoch = w.epoch AND b.end_sample = w.decision_sample")
def p2_lookup(spark, sf):
    ep = _epochs(spark, sf)
    ready = ep.where("event_type != 'error'").select("user_id", "epoch", "end_sample", "p")
    w = tl.sliding(ep.drop("p"), ["user_id"]).select("user_id", "epoch", "window_id", "decision_sample")
    for name, back in (("previous", 960), ("current", 0)):
        w = w.join(ready.select("user_id", "epoch", (F.col("end_sample") + back).alias("decision_sample"), F.col("p").alias(name)), ["user_id", "epoch", "decision_sample"], "left")
    both = F.col("previous").isNotNull() & F.col("current").isNotNull()
    return w.select("user_id", "window_id", F.when(both, F.round("previous", 6)).alias("previous"), F.when(both, F.round("current", 6)).alias("current"))


GA = f"{EV}, ga AS (SELECT *, CASE WHEN h < 3 THEN 'warming_up' WHEN event_type = 'error' THEN 'invalid' WHEN event_type = 'signup' THEN 'unavailable' WHEN p >= 0.3 THEN 'open' ELSE 'closed' END AS gate FROM ev)"
RUN = f"{GA}, g0 AS (SELECT *, count(*) FILTER (gate <> 'open') OVER (PARTITION BY user_id ORDER BY h) AS g FROM ga), run AS (SELECT *, CASE WHEN gate = 'open' THEN row_number() OVER (PARTITION BY user_id, g, gate ORDER BY h) ELSE 0 END::BIGINT AS k FROM g0)"


def _gated(spark, sf):
    state = F.when(F.col("h") < 3, "warming_up").when(F.col("event_type") == "error", "invalid").when(F.col("event_type") == "signup", "unavailable").otherwise("ready")
    return de.gate(t.hops(spark, sf).withColumn("hop_state", state), "p", "hop_state", 0.3)


def _runs(spark, sf):
    return de.open_run(_gated(spark, sf), ["user_id"], "h", F.col("gate") == "open")


@query("gate_decision", f"WITH {GA} SELECT user_id, event_id, gate, gate = 'open' AS sound_present FROM ga")
def gate_decision(spark, sf):
    return _gated(spark, sf).select("user_id", "event_id", "gate", "sound_present")


@query("gate_open_run", f"WITH {RUN} SELECT user_id, event_id, k, CASE WHEN k > 0 THEN least(19, 15 + 2 * (k - 1)) ELSE 0 END::BIGINT AS frames FROM run")
def gate_open_run(spark, sf):
    return _runs(spark, sf).select("user_id", "event_id", "k", de.frames_in_use().alias("frames"))


@query("births_allowed", f"WITH {RUN} SELECT user_id, count(*) FILTER (k >= 2) AS allowed, max(k) AS longest FROM run GROUP BY user_id")
def births_allowed(spark, sf):
    return _runs(spark, sf).groupBy("user_id").agg(F.count_if(F.col("k") >= 2).alias("allowed"), F.max("k").alias("longest"))


VO = f"{EV}, r AS (SELECT *, floor(value)::BIGINT % 3 AS raw FROM ev), v AS (SELECT *, CASE WHEN raw = lag(raw, 1) OVER w OR raw = lag(raw, 2) OVER w THEN raw WHEN lag(raw, 1) OVER w = lag(raw, 2) OVER w THEN lag(raw, 1) OVER w END AS v FROM r WINDOW w AS (PARTITION BY user_id ORDER BY h)), vo AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY h) AS stable FROM v)"


def _voted(spark, sf):
    return de.vote(t.hops(spark, sf).withColumn("raw", F.expr("cast(floor(value) as long) % 3")), ["user_id"], "h", "raw")


@query("count_vote", f"WITH {VO} SELECT user_id, event_id, raw, stable FROM vo")
def count_vote(spark, sf):
    return _voted(spark, sf).select("user_id", "event_id", "raw", "stable")


@query("order_plan", f"WITH {VO} SELECT user_id, event_id, CASE WHEN p < 0.3 THEN NULL WHEN event_type = 'view' OR user_id % 2 = 1 THEN 2 WHEN event_type = 'error' THEN 1 WHEN stable >= 2 THEN 2 ELSE 1 END::BIGINT AS sources FROM vo")
def order_plan(spark, sf):
    plan = de.order_plan(F.col("p") >= 0.3, F.col("event_type") != "view", F.col("user_id") % 2 == 0, F.col("stable"), F.col("event_type") == "error")
    return _voted(spark, sf).select("user_id", "event_id", plan.alias("sources"))


_DIST = lambda a, b: f"least(abs({a} - {b}), 360 - abs({a} - {b}))"


@query("circular_distance", f"WITH {EV}, l AS (SELECT *, lag(angle) OVER (PARTITION BY user_id ORDER BY h) AS prev FROM ev) SELECT user_id, event_id, round({_DIST('angle', 'prev')}, 6) AS distance FROM l")
def circular_distance_query(spark, sf):
    prev = F.lag("angle").over(Window.partitionBy("user_id").orderBy("h"))
    return t.hops(spark, sf).select("user_id", "event_id", F.round(circular_distance(F.col("angle"), prev), 6).alias("distance"))


@query("signed_delta", f"WITH {EV}, l AS (SELECT *, round(angle - lag(angle) OVER (PARTITION BY user_id ORDER BY h), 6) + 180 AS d FROM ev) SELECT user_id, event_id, round(CASE WHEN d < 0 THEN d + 360 WHEN d >= 360 THEN d - 360 ELSE d END - 180, 6) + 0.0 AS delta FROM l")
def signed_delta_query(spark, sf):
    prev = F.lag("angle").over(Window.partitionBy("user_id").orderBy("h"))
    return rounded(t.hops(spark, sf).select("user_id", "event_id", signed_delta(F.round(F.col("angle") - prev, 6), 0.0).alias("delta")), "delta")


def _greedy_sql(n: int = 5, limit: int = 3) -> str:
    """Greedy choice unrolled: row i is taken if fewer than limit are, and it is far from all taken."""
    steps, sql = [], "c"
    for i in range(1, n + 1):
        far = " AND ".join(f"(NOT s{j} OR {_DIST(f'th[{i}]', f'th[{j}]')} >= 50)" for j in range(1, i))
        few = " + ".join(f"s{j}::INT" for j in range(1, i))
        cond = f"len(th) >= {i}" + (f" AND {far} AND {few} < {limit}" if i > 1 else "")
        steps.append(f"x{i} AS (SELECT *, coalesce({cond}, false) AS s{i} FROM {sql})")
        sql = f"x{i}"
    return ", ".join(steps)


def _group_sql(order: str, where: str = "true") -> str:
    return f"{EV}, g AS (SELECT *, h // 5 AS win FROM ev WHERE {where}), c AS (SELECT user_id, win, list(angle ORDER BY {order}) AS th, list(event_id ORDER BY {order}) AS ids FROM g GROUP BY ALL), {_greedy_sql()}"


_TAKEN = ", ".join(f"CASE WHEN s{i} THEN ids[{i}] END" for i in range(1, 6))


@query("nms_topk", f"WITH {_group_sql('p DESC, h')} SELECT user_id, win, len(th) AS eligible, unnest(list_filter([{_TAKEN}], lambda x: x IS NOT NULL)) AS event_id FROM x5")
def nms_topk(spark, sf):
    ev = t.hops(spark, sf).withColumn("win", F.expr("h div 5"))
    out = de.select_directions(ev, ["user_id", "win"], "angle", [-F.col("p"), F.col("h")], extra=("event_id",))
    return out.select("user_id", "win", "eligible", F.explode("chosen.event_id").alias("event_id"))


_PRIO = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, CASE WHEN event_type IN ('purchase', 'click') THEN h ELSE h % 2 END, CASE WHEN event_type IN ('purchase', 'click') THEN 0 ELSE -p END, event_id"


@query("direction_select", f"WITH {_group_sql(_PRIO)} SELECT user_id, win, unnest(list_filter([{_TAKEN}], lambda x: x IS NOT NULL)) AS event_id FROM x5")
def direction_select(spark, sf):
    """Observed confirmed, observed tentative, then coasting tracks by missed samples, score and id."""
    ev = t.hops(spark, sf).withColumn("win", F.expr("h div 5"))
    kind = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    coasting = kind == 2
    order = [kind, F.when(coasting, F.col("h") % 2).otherwise(F.col("h")), F.when(coasting, -F.col("p")).otherwise(0.0), F.col("event_id")]
    return de.select_directions(ev, ["user_id", "win"], "angle", order).select("user_id", "win", F.explode("chosen.p3").alias("event_id"))


@query("argmax_map", f"WITH {EV} SELECT user_id, min(h) FILTER (value = m) AS first_max FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM ev) GROUP BY user_id")
def argmax_map(spark, sf):
    return t.hops(spark, sf).groupBy("user_id").agg(F.max_by("h", F.struct("value", -F.col("h"))).alias("first_max"))


AS = f"""{EV}, tr AS (SELECT user_id, h // 10 AS win, event_id AS track_id, angle AS track_theta FROM ev WHERE event_type = 'view'), ca AS (SELECT user_id, h // 10 AS win, event_id, angle AS theta FROM ev WHERE event_type = 'click'),
 pr AS (SELECT *, {_DIST('theta', 'track_theta')} AS d FROM tr JOIN ca USING (user_id, win)), ok AS (SELECT * FROM pr WHERE d <= 50 AND d * d / 25.0 <= 20)"""


def _tracks_and_candidates(spark, sf):
    ev = t.hops(spark, sf).withColumn("win", F.expr("h div 10"))
    tracks = ev.where("event_type = 'view'").select("user_id", "win", F.col("event_id").alias("track_id"), F.col("angle").alias("track_theta"))
    return tracks, ev.where("event_type = 'click'").select("user_id", "win", "event_id", F.col("angle").alias("theta"))


@query("association_gate", f"WITH {AS} SELECT user_id, win, track_id, event_id, round(exp(-0.5 * d * d / 25), 6) AS likelihood FROM ok")
def association_gate(spark, sf):
    return rounded(de.associations(*_tracks_and_candidates(spark, sf), ["user_id", "win"]), "likelihood").select("user_id", "win", "track_id", "event_id", "likelihood")


@query("unassigned_anti", f"WITH {AS} SELECT user_id, win, event_id FROM ca WHERE event_id NOT IN (SELECT event_id FROM ok)")
def unassigned_anti(spark, sf):
    tracks, candidates = _tracks_and_candidates(spark, sf)
    return candidates.join(de.associations(tracks, candidates, ["user_id", "win"]), ["user_id", "win", "event_id"], "left_anti").select("user_id", "win", "event_id")


@query("track_ttl", f"WITH {EV}, l AS (SELECT *, max(h) OVER (PARTITION BY user_id) AS last FROM ev) SELECT user_id, count(*) AS alive FROM l WHERE last * 9600 - h * 9600 < CASE WHEN event_type = 'purchase' THEN 96000 ELSE 24000 END GROUP BY user_id")
def track_ttl(spark, sf):
    ev = t.hops(spark, sf).withColumns({"now": F.max("h").over(Window.partitionBy("user_id")) * 9600, "seen": F.col("h") * 9600})
    return ev.where(de.alive("now", "seen", F.col("event_type") == "purchase")).groupBy("user_id").agg(F.count("*").alias("alive"))


@query("track_rank", f"WITH {EV} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, p DESC, event_id) AS rank FROM ev")
def track_rank(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc(F.col("event_type") == "purchase"), F.desc("p"), "event_id")
    return t.hops(spark, sf).select("user_id", "event_id", F.row_number().over(w).cast("long").alias("rank"))


@query("adaptive_rate", f"""WITH RECURSIVE {EV}, st AS (SELECT user_id, h, event_id, CASE WHEN value / 8 > 20 THEN 40 ELSE 20 END AS period, 0 AS healthy FROM ev WHERE h = 0
 UNION ALL SELECT e.user_id, e.h, e.event_id,
  CASE WHEN e.value / 8 > period THEN least(200, period + 20) WHEN period > 20 AND e.value / 8 <= greatest(12, period - 28) AND healthy + period >= 200 THEN period - 20 ELSE period END,
  CASE WHEN e.value / 8 > period OR period = 20 OR e.value / 8 > greatest(12, period - 28) OR healthy + period >= 200 THEN 0 ELSE healthy + period END
  FROM st JOIN ev e ON e.user_id = st.user_id AND e.h = st.h + 1) SELECT user_id, event_id, period::BIGINT AS period_ms FROM st""")
def adaptive_rate(spark, sf):
    from ..model import RateConfig

    ev = t.hops(spark, sf).select("user_id", "h", "event_id", (F.col("value") / 8).alias("stage_ms"))
    return sq.adaptive_rate(ev, ["user_id"], ["h"], None, "stage_ms", RateConfig(stable_ms=200)).select("user_id", "event_id", "period_ms")


@query("reuse_locf", f"WITH {EP}, l AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_event_id, last_value(CASE WHEN event_type = 'purchase' THEN angle END IGNORE NULLS) OVER w AS la FROM ep WINDOW w AS (PARTITION BY user_id, epoch ORDER BY h)) SELECT user_id, event_id, last_event_id, round(la, 6) AS last_angle, CASE WHEN last_event_id IS NULL THEN NULL WHEN event_type = 'purchase' THEN 'confirmed' ELSE 'coasting' END AS state FROM l")
def reuse_locf(spark, sf):
    out = de.hold_last(_epochs(spark, sf), ["user_id", "epoch"], "h", F.col("event_type") == "purchase", ["event_id", "angle"])
    return out.select("user_id", "event_id", "last_event_id", F.round("last_angle", 6).alias("last_angle"), "state")


@query("reuse_alive", f"WITH {EP}, l AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN end_sample END IGNORE NULLS) OVER (PARTITION BY user_id, epoch ORDER BY h) AS seen FROM ep) SELECT user_id, count(*) AS alive, max(end_sample - seen) AS most_missed FROM l WHERE end_sample - seen < 4800 GROUP BY user_id")
def reuse_alive(spark, sf):
    held = de.hold_last(_epochs(spark, sf), ["user_id", "epoch"], "h", F.col("event_type") == "purchase", ["end_sample"])
    kept = held.where(de.alive("end_sample", "last_end_sample", F.lit(True), coasting_ttl=4_800))
    return kept.groupBy("user_id").agg(F.count("*").alias("alive"), F.max(F.col("end_sample") - F.col("last_end_sample")).alias("most_missed"))


@query("perf_1s", f"WITH {EV} SELECT user_id, event_id, count(*) OVER w AS n, round(avg(value) OVER w, 9) AS mean_ms FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW)")
def perf_1s(spark, sf):
    """The trailing window, here a day."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-24 * HOUR, 0)
    return t.hops(spark, sf).select("user_id", "event_id", F.count("*").over(w).alias("n"), F.round(F.avg("value").over(w), 9).alias("mean_ms"))


_STAGES = ("click", "error", "purchase", "signup", "view")


@query("stage_averages", f"WITH {EV}, a AS (SELECT user_id, {', '.join(f'avg(value) FILTER (event_type = {x!r}) AS {x}' for x in _STAGES)} FROM ev GROUP BY user_id) SELECT user_id, {', '.join(f'round({x}, 9) AS {x}' for x in _STAGES)}, round({' + '.join(f'coalesce({x}, 0)' for x in _STAGES)}, 8) AS total FROM a")
def stage_averages(spark, sf):
    a = t.hops(spark, sf).groupBy("user_id").pivot("event_type", list(_STAGES)).agg(F.avg("value"))
    total = sum((F.coalesce(F.col(x), F.lit(0.0)) for x in _STAGES), F.lit(0.0))
    return rounded(rounded(a.withColumn("total", total), *_STAGES, digits=9), "total", digits=8)


@query("queue_drop_oldest", f"""WITH RECURSIVE {EV}, i AS (SELECT user_id, h, event_id, 1 + (event_id % 3) AS a, floor(value / 40)::BIGINT AS s FROM ev), q AS (SELECT user_id, h, event_id, greatest(0, least(5, a) - s) AS depth, greatest(0, a - 5) AS drops FROM i WHERE h = 0
 UNION ALL SELECT i.user_id, i.h, i.event_id, greatest(0, least(5, depth + a) - s), drops + greatest(0, depth + a - 5) FROM q JOIN i ON i.user_id = q.user_id AND i.h = q.h + 1) SELECT user_id, event_id, depth::BIGINT AS depth, drops::BIGINT AS drops FROM q""")
def queue_drop_oldest(spark, sf):
    ev = t.hops(spark, sf).select("user_id", "h", "event_id", F.expr("1 + event_id % 3").alias("a"), F.floor(F.col("value") / 40).alias("s"))
    return sq.bounded_queue(ev, ["user_id"], ["h"], "a", "s", 5).select("user_id", "event_id", "depth", "drops")


LOG = f"""RECURSIVE {EV}, kp AS (SELECT user_id, h, event_id, us, us AS anchor, true AS kept FROM ev WHERE h = 0
 UNION ALL SELECT e.user_id, e.h, e.event_id, e.us, CASE WHEN e.us - anchor >= {30 * HOUR} THEN e.us ELSE anchor END, e.us - anchor >= {30 * HOUR} FROM kp JOIN ev e ON e.user_id = kp.user_id AND e.h = kp.h + 1)"""


@query("track_log_sampled", f"WITH {LOG} SELECT user_id, event_id FROM kp WHERE kept")
def track_log_sampled(spark, sf):
    return rc.anchors(t.hops(spark, sf).select("user_id", "h", "event_id", "us"), ["user_id"], "us", 30 * HOUR, ["h"]).select("user_id", "event_id")


@query("track_log_tsv", f"WITH {LOG} SELECT k.user_id AS track_id, (min(k.us) // 1000000) AS first_s, string_agg(k.h || ':' || (floor(e.angle * 10)::BIGINT // 10) || '.' || (floor(e.angle * 10)::BIGINT % 10), ',' ORDER BY k.h) AS trajectory FROM kp k JOIN ev e ON e.event_id = k.event_id WHERE kept GROUP BY k.user_id")
def track_log_tsv(spark, sf):
    kept = sq.sampled(t.hops(spark, sf).select("user_id", "h", "event_id", "us", "angle"), ["user_id"], ["h"], "us", 30 * HOUR)
    tenth = F.floor(F.col("angle") * 10)
    point = F.concat(F.col("h"), F.lit(":"), F.floor(tenth / 10), F.lit("."), tenth % 10)
    out = kept.groupBy(F.col("user_id").alias("track_id")).agg(F.min("us").alias("us"), F.array_sort(F.collect_list(F.struct("h", point.alias("p")))).alias("t"))
    return out.select("track_id", F.expr("us div 1000000").alias("first_s"), F.concat_ws(",", F.col("t.p")).alias("trajectory"))


@query("control_asof", f"WITH {EV}, c AS (SELECT *, 0.2 + 0.1 * (count(*) OVER (PARTITION BY user_id ORDER BY h) % 4) AS threshold FROM ev WHERE event_type = 'signup') SELECT e.user_id, e.event_id, round(coalesce(c.threshold, 0.8), 6) AS threshold, e.p >= coalesce(round(c.threshold, 6), 0.8) AS open FROM ev e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.h >= c.h")
def control_asof(spark, sf):
    """Each window under the thresholds of the latest control revision."""
    ev = t.hops(spark, sf)
    n = F.count(F.when(F.col("event_type") == "signup", 1)).over(Window.partitionBy("user_id").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    ev = de.latest_before(ev.withColumn("threshold", 0.2 + 0.1 * (n % 4)), ["user_id"], ["h"], F.col("event_type") == "signup", ["threshold"])
    out = ev.select("user_id", "event_id", "p", F.round(F.coalesce("asof_threshold", F.lit(0.8)), 6).alias("threshold"))
    return out.select("user_id", "event_id", "threshold", (F.col("p") >= F.col("threshold")).alias("open"))


@query("identity_join_check", f"WITH {RUN}, a AS (SELECT user_id, h FROM run WHERE k > 0), b AS (SELECT user_id, h FROM ev WHERE event_type <> 'click') SELECT coalesce(a.user_id, b.user_id) AS user_id, count(*) FILTER (a.h = b.h) AS matched, count(*) FILTER (b.h IS NULL) AS only_gate, count(*) FILTER (a.h IS NULL) AS only_count FROM a FULL JOIN b ON a.user_id = b.user_id AND a.h = b.h GROUP BY ALL")
def identity_join_check(spark, sf):
    a = _runs(spark, sf).where("k > 0").select("user_id", "h", F.lit(True).alias("a"))
    b = t.hops(spark, sf).where("event_type != 'click'").select("user_id", "h", F.lit(True).alias("b"))
    j = a.join(b, ["user_id", "h"], "full")
    return j.groupBy("user_id").agg(F.count_if(F.col("a") & F.col("b")).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_gate"), F.count_if(F.col("a").isNull()).alias("only_count"))


@query("periodic_run", f"WITH {EV}, f AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY h) > {8 * HOUR} AS brk FROM ev), g AS (SELECT *, count(*) FILTER (brk) OVER (PARTITION BY user_id ORDER BY h) AS g FROM f), r AS (SELECT user_id, g, count(*) AS n, min(h) AS first FROM g GROUP BY ALL) SELECT user_id, max(n) AS longest, min(first) FILTER (n = m) AS first FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM r) GROUP BY user_id")
def periodic_run(spark, sf):
    w = Window.partitionBy("user_id").orderBy("h")
    broken = F.coalesce(F.col("us") - F.lag("us").over(w) > 8 * HOUR, F.lit(False))
    runs = t.hops(spark, sf).withColumn("b", broken).withColumn("g", F.count(F.when(F.col("b"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("user_id", "g").agg(F.count("*").alias("n"), F.min("h").alias("first"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"), F.max_by("first", F.struct("n", -F.col("first"))).alias("first"))


@query("latest_mailbox", f"WITH {EV} SELECT user_id, max(h) AS h, arg_max(event_id, h) AS event_id, arg_max(event_type, h) AS event_type FROM ev GROUP BY user_id")
def latest_mailbox(spark, sf):
    return de.mailbox(t.hops(spark, sf), ["user_id"], ["h"], ["h", "event_id", "event_type"])


@query("imcra_recursion", f"WITH RECURSIVE {EV}, r AS (SELECT user_id, h, event_id, value AS s FROM ev WHERE h = 0 UNION ALL SELECT e.user_id, e.h, e.event_id, 0.77 * s + (1 - 0.77) * e.value FROM r JOIN ev e ON e.user_id = r.user_id AND e.h = r.h + 1) SELECT user_id, event_id, round(s, 6) AS smoothed FROM r")
def imcra_recursion(spark, sf):
    """The noise tracker's first pass: the smoothed power."""
    ev = t.hops(spark, sf).select("user_id", "h", "event_id", "value")
    return rounded(rc.smoothed(ev, ["user_id"], "h", "value", 0.77), "smoothed").select("user_id", "event_id", "smoothed")


@query("wiener_gain", f"WITH RECURSIVE {EV}, g AS (SELECT *, greatest(pow(10, -0.9), p) AS target FROM ev), r AS (SELECT user_id, h, event_id, target AS s FROM g WHERE h = 0 UNION ALL SELECT e.user_id, e.h, e.event_id, 0.8 * s + (1 - 0.8) * e.target FROM r JOIN g e ON e.user_id = r.user_id AND e.h = r.h + 1) SELECT user_id, event_id, round(s, 6) AS gain FROM r")
def wiener_gain(spark, sf):
    ev = t.hops(spark, sf).select("user_id", "h", "event_id", F.greatest(F.lit(10**-0.9), F.col("p")).alias("target"))
    return rounded(rc.smoothed(ev, ["user_id"], "h", "target", 0.8, "gain"), "gain").select("user_id", "event_id", "gain")


@query("noise_minimum_all")
def noise_minimum_all(spark, sf):
    """The minimum tracker at every hop, past closed sub-windows and those that it forgets."""
    ev = t.hops(spark, sf).select("user_id", "h", "event_id", "value")
    return rounded(sq.tracked_minimum(ev, ["user_id"], ["h"], "value"), "minimum").select("user_id", "event_id", "minimum")


_RI = f"""RECURSIVE {EV}, i AS (SELECT user_id, h, event_id, floor(value / 4)::BIGINT AS id FROM ev), r AS (SELECT user_id, h, event_id, [id] AS held, true AS new FROM i WHERE h = 0
 UNION ALL SELECT i.user_id, i.h, i.event_id, CASE WHEN list_contains(held, id) THEN held ELSE list_append(held, id)[-8:] END, NOT list_contains(held, id) FROM r JOIN i ON i.user_id = r.user_id AND i.h = r.h + 1)"""


@query("recent_ids", f"WITH {_RI} SELECT user_id, event_id FROM r WHERE new")
def recent_ids(spark, sf):
    """Events whose id is none of the last eight new ones of their stream: a forgotten id comes as new again."""
    ev = t.hops(spark, sf).select("user_id", "h", "event_id", F.floor(F.col("value") / 4).cast("long").alias("id"))
    return sq.recent_ids(ev, ["user_id"], ["h"], "id", 8).select("user_id", "event_id")


def _odd_blocks(spark, sf):
    """The rows of embeddings as blocks of one to eight samples, end to end within a session."""
    b = t.blocks(spark, sf).withColumn("n", F.col("seq") % 8 + 1)
    end = F.sum("n").over(Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return b.select("session", F.lit(0).cast("long").alias("epoch"), "seq", (end - F.col("n")).alias("start_sample"), F.slice("samples", F.lit(1), (F.col("n") * 8).cast("int")).alias("samples"))


_OD = """s0 AS (SELECT label::BIGINT AS session, vec_id AS seq, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS k FROM embeddings), s1 AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq, k) - 1 AS i FROM s0 WHERE k < (seq % 8 + 1) * 8)"""


def _sums(df, *more):
    """What tells samples and their order: the sum of each times its place."""
    weighed = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(df.withColumn("checksum", weighed), "checksum", digits=5).select("session", *more, F.element_at("sequence_ids", 1).alias("first_seq"), F.element_at("sequence_ids", -1).alias("last_seq"), F.size("sequence_ids").cast("long").alias("blocks"), "checksum")


@query("recut_hops", f"WITH {_OD} SELECT session, i // 40 AS hop, min(seq) AS first_seq, max(seq) AS last_seq, count(DISTINCT seq) AS blocks, round(sum(x * (i % 40 + 1)), 5) AS checksum FROM s1 GROUP BY ALL HAVING count(*) = 40")
def recut_hops(spark, sf):
    """Hops of five samples, cut from blocks of one to eight."""
    return _sums(recut.hops(_odd_blocks(spark, sf), hop=5), "hop")


@query("recut_windows", f"WITH {_OD}, n AS (SELECT session, max(i) AS last FROM s1 GROUP BY session), w AS (SELECT session, unnest(range(0, (last + 1) // 40 - 3)) AS window_id FROM n) SELECT w.session, window_id, min(seq) AS first_seq, max(seq) AS last_seq, count(DISTINCT seq) AS blocks, round(sum(x * (i - window_id * 40 + 1)), 5) AS checksum FROM w JOIN s1 ON s1.session = w.session AND i // 40 BETWEEN window_id AND window_id + 3 GROUP BY ALL")
def recut_windows(spark, sf):
    """Sliding windows of four such hops with their samples."""
    return _sums(recut.windows(recut.hops(_odd_blocks(spark, sf), hop=5), 20, 5, chunk=50), "window_id")
