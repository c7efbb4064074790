import math

import duckdb
import pytest
from pyspark.sql import functions as F

from regolith.functions.rounding import rounded
from regolith.operators import paths as pt
from regolith.operators import reports as rp
from regolith.operators import rules


def assessed(spark, hazards, energy, capacity):
    rows = [(1, i, h, float(i % 7), 10.0, energy * (i + 1) / len(hazards)) for i, h in enumerate(hazards)]
    steps = spark.createDataFrame(rows, "path_id long, segment_id int, hazard_score double, slope_deg double, step_m double, cumulative_energy_kwh double")
    return pt.assess(pt.path_summary(steps).withColumn("capacity_kwh", F.lit(capacity))).first()


def test_feasibility_and_tiers_at_their_borders(spark):
    e = spark.createDataFrame([(x, c) for x, c in [(1.0, 5.0), (4.24, 5.0), (4.25, 5.0), (4.26, 5.0), (5.0, 5.0), (5.01, 5.0), (12.0, 5.0), (1.0, 0.0)]], "e double, c double")
    got = [r[0] for r in e.select(pt.feasibility(F.col("e"), F.col("c"))).collect()]
    assert got == ["FEASIBLE"] * 3 + ["FEASIBLE_WITH_MARGIN"] * 2 + ["INFEASIBLE"] * 2 + [None]
    s = spark.createDataFrame([(x,) for x in (0.0, 0.299, 0.3, 0.6, 0.601, 1.0)], "s double")
    assert [r[0] for r in s.select(pt.risk_tier(F.col("s"))).collect()] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH"]


def test_risk_of_paths(spark):
    assert [assessed(spark, [h] * 10, e, 6.0).risk_tier for h, e in ((0.02, 0.5), (0.3, 3.0), (0.8, 5.5))] == ["LOW", "MEDIUM", "HIGH"]
    over = assessed(spark, [0.5] * 10, 8.0, 2.0)
    assert over.risk_score <= 1 and (over.energy_utilisation, over.energy_margin_kwh, over.feasibility) == (4.0, -6.0, "INFEASIBLE")
    assert assessed(spark, [0.4] * 5, 2.0, 10.0).risk_score == pytest.approx(0.6 * 0.4 + 0.4 * 0.2)
    peak = assessed(spark, [0.05] * 49 + [0.98], 1.0, 6.0)
    assert peak.mean_hazard < 0.1 and peak.max_hazard == 0.98


def test_top_segments_and_energy(spark):
    steps = spark.createDataFrame([(1, i, h, 0.0, 10.0 * (i > 0), 0.003) for i, h in enumerate([0.1, 0.9, 0.3, 0.7, 0.5, 0.9])], "path_id long, segment_id int, hazard_score double, slope_deg double, step_m double, kwh_per_m double")
    assert [r.segment_id for r in pt.top_segments(steps, 3).orderBy("rank").collect()] == [1, 5, 3]
    energy = [r.cumulative_energy_kwh for r in pt.with_energy(steps).orderBy("segment_id").collect()]
    assert energy == sorted(energy) and energy[-1] == pytest.approx(0.15)


def test_upsert_and_seed(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, t int, v string")
    new = spark.createDataFrame([(2, 5, "B"), (3, 1, "c"), (1, 4, "late")], "k int, t int, v string")
    once = pt.upsert(old, new, "k", "t")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, pt.upsert(once, new, "k", "t").collect())) == [(1, 5, "a"), (2, 5, "B"), (3, 1, "c")]
    assert pt.seed(new, old, "k").count() == 3


REPLIES = [
    (1, '{"summary": "s", "top_risks": [{"segment_id": 3, "reason": "x"}], "recommendation": "r"}'),
    (2, '{"summary": "s", "top_risks": [{"segment_id": 3}, {"segment_id": 99999}, {"reason": "none"}, {"segment_id": true}, {"segment_id": "1"}, {"segment_id": 4.7}], "recommendation": "r"}'),
    (3, '```json\n{"summary": "s", "top_risks": [], "recommendation": "r"}\n```'),
    (4, '{"summary": "s", "top_risks": []}'),
    (5, "[1, 2, 3]"),
    (6, "{not json at all"),
    (7, None),
    (8, "```\n{}\n```"),
    (10, '\n \t```json {"summary": null, "top_risks": "oops", "recommendation": 1.5}\n```\n more'),
    (11, '\u00a0{"summary": true, "top_risks": [{"segment_id": "3.7"}, {"segment_id": " 3 ", "reason": null}, {"segment_id": "1_0"}, 3, null, "3", {"segment_id": [3]}, {"segment_id": 1e30}, {"segment_id": -0.5}], "recommendation": ""}\r\n'),
    (12, '{"summary": "s", "top_risks": 7, "recommendation": "r"}'),
    (13, '{"summary": "s", "top_risks": {"segment_id": 3, "b": 1}, "recommendation": "r"}'),
    (14, '{"summary": "s", "top_risks": false, "recommendation": "r"}'),
    (15, ""),
]


def test_replies(spark):
    parsed = rp.parse_replies(spark.createDataFrame(REPLIES, "path_id long, raw string")).cache()
    reasons = {r.path_id: r.fallback_reason for r in parsed.collect()}
    assert reasons == {
        1: None, 2: None, 3: None, 4: "missing required key: recommendation", 5: "not an object", 6: "unparseable model output", 7: "no reply", 8: "missing required key: summary",
        10: None, 11: None, 12: "top_risks cannot be listed", 13: None, 14: None, 15: "unparseable model output",
    }
    allowed = spark.createDataFrame([(p, s) for p in (1, 2, 3, 10, 11, 13) for s in (1, 3, 4, 10)], "path_id long, segment_id long")
    got = {r.path_id: (r.kept, r.dropped) for r in rp.check_citations(parsed, allowed).collect()}
    assert got == {1: ("3", 0), 2: ("3,1,1,4", 2), 3: ("", 0), 10: ("", 4), 11: ("3,10", 7), 13: ("", 2), 14: ("", 0)}
    told = {r.path_id: (r.summary, r.recommendation) for r in parsed.collect()}
    assert told[10] == ("None", "1.5") and told[11] == ("True", "") and told[6] == (None, None)
    assert [r.reason for r in next(r.risks for r in parsed.collect() if r.path_id == 11)][:3] == ["", "None", ""]


def test_recommendations(spark):
    df = spark.createDataFrame([("INFEASIBLE", -1.0), ("FEASIBLE_WITH_MARGIN", 0.25), ("FEASIBLE", 3.0)], "f string, m double")
    got = [r[0] for r in df.select(rp.recommendation(F.col("f"), F.col("m"))).collect()]
    assert got[0].startswith("Do not execute") and "contingency" in got[1] and "0.2500 kWh" in got[1] and got[2].startswith("Execute as planned")


def context_of(spark, paths):
    risk = [(p, 7, "r", 100.0, 1.5, 3, 0.4, 0.9, 12.0, 6.0, 4.5, 0.25, 25.0, 0.003, "LOW", 0.2, "FEASIBLE") for p in paths]
    names = "path_id long, mission_id long, rover_name string, total_distance_m double, total_energy_kwh double, num_waypoints long, mean_hazard double, max_hazard double, max_slope_deg double, capacity_kwh double, energy_margin_kwh double, energy_utilisation double, rover_max_slope_deg double, kwh_per_m double, risk_tier string, risk_score double, feasibility string"
    missions = spark.createDataFrame([(7, "m", None)], "mission_id long, name string, terrain_source string")
    steps = spark.createDataFrame([(p, r, s, 4, 5, h, 3.0) for p in paths for r, (s, h) in enumerate([(3, 0.9), (1, 0.5), (4, 0.4)], 1)], "path_id long, rank int, segment_id int, x int, y int, hazard_score double, slope_deg double")
    return rp.structured_context(spark.createDataFrame(risk, names), missions, steps)


def test_final_reports(spark):
    """A usable reply keeps the citations that the context backs; any other, and none at all, falls back to the template."""
    got = {r.path_id: r for r in rp.final_report(context_of(spark, range(1, 10)), spark.createDataFrame(REPLIES, "path_id long, raw string")).collect()}
    assert len(got) == 9 and {p for p, r in got.items() if r.generated_by == "llm"} == {1, 2, 3}
    assert [(k.segment_id, k.reason) for k in got[1].top_risks] == [(3, "x")] and got[1].summary == "s" and got[1].dropped_citations == 0 and got[1].fallback_reason is None
    assert [k.segment_id for k in got[2].top_risks] == [3, 1, 1, 4] and got[2].dropped_citations == 2 and got[3].top_risks == []
    assert {p: got[p].fallback_reason for p in (4, 5, 6, 7, 9)} == {4: "missing required key: recommendation", 5: "not an object", 6: "unparseable model output", 7: "no reply", 9: "no reply"}
    for p in (4, 9):
        assert got[p].generated_by == "template_fallback" and [k.segment_id for k in got[p].top_risks] == [3, 1] and "0.9000" in got[p].summary and got[p].recommendation.startswith("Execute as planned")


def test_rules(spark):
    fleet = spark.createDataFrame([("a", 1.0, 20.0), ("", 1.0, 20.0), (None, 1.0, 2.0), ("b", 0.0, 20.0), ("c", None, 20.0), ("d", 1.0, 0.0), ("e", 1.0, 89.5), ("f", 1.0, 89.0)], "rover_name string, capacity_kwh double, max_slope_deg double")
    assert [r.reject_reason for r in rules.validate_rovers(fleet).collect()] == [None, "name length", "name length", "capacity", "capacity", "slope limit", "slope limit", None]
    asked = spark.createDataFrame([(0, 0, 3, 3, "n"), (-1, 0, 3, 3, "n"), (0, None, 3, 3, "n"), (0, 0, 3, -3, "n"), (0, 0, 0, 0, "n" * 201)], "start_x int, start_y int, goal_x int, goal_y int, name string")
    assert [r.reject_reason for r in rules.validate_requests(asked).collect()] == [None, "start", "start", "goal", "name length"]
    files = spark.createDataFrame([("/srv/storage/a/b.png",), ("/srv/storage2/x",), (None,)], "p string")
    assert [r[0] for r in files.select(rules.static_url("p")).collect()] == ["/static/a/b.png", None, None]
    meta = spark.createDataFrame([('{"a": {"b": 1.5}, "c": "x"}',), ("no json",), (None,)], "m string")
    assert [tuple(r) for r in meta.select(*rules.extract("m", b=("$.a.b", "double"), c=("$.c", "double"))).collect()] == [(1.5, None), (None, None), (None, None)]


def test_packing_keeps_every_waypoint(spark):
    rows = [(p, i, p + i, i, 0.1 * i, -1.0 * i) for p in (1, 2) for i in (2, 0, 1)]
    steps = spark.createDataFrame(rows, "path_id long, segment_id int, x int, y int, hazard_score double, slope_deg double")
    packed = pt.pack(steps)
    assert [[w.segment_id for w in r.waypoints] for r in packed.collect()] == [[0, 1, 2]] * 2
    assert sorted(map(tuple, pt.unpack(packed).collect())) == sorted(rows)


def test_rounding_is_that_of_sql(spark):
    halves = [k + h for k in (0.0, 0.5115, 3.0001, 7776.4999, 123456.7891) for h in (0.00005, 0.00004999999999999999, 0.000050000000000000004)]
    values = [s * v for s in (1, -1) for v in (*halves, *(n / 20000 for n in range(1, 400)), 0.00003, 0.49999999999999994, 2.0**52 + 1, 1e300, 0.0, math.inf)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for places in (3, 4, 6):
        got = [r[0] for r in df.orderBy("i").select(rounded("v", places)).collect()]
        want = duckdb.execute(f"select list(round(v, {places}) order by i) from (select unnest(?::double[]) as v, unnest(range({len(values)})) as i)", [values]).fetchone()[0]
        assert list(map(repr, got)) == list(map(repr, want))
    assert df.where("v = -0.00003D").select(F.format_string("%.4f", rounded("v", 4))).first()[0] == "-0.0000"
