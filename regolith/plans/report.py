"""Report queries and the SQL that checks them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith import wording as words
from regolith.functions.lineage import shared_dir
from regolith.operators import paths as pt
from regolith.operators import reports as rp
from regolith.operators import rules
from regolith.plans.traverse import PATH_CTES, risks
from regolith.settings import DEFAULT as D
from regolith.sources.tables import MISSIONS, missions, path_steps, table, with_ctes


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.structured_context(risks(spark, sf_dir), missions(spark, sf_dir), pt.top_segments(path_steps(spark, sf_dir), 5))


def structured_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested context, shown by fields of every level."""
    c = "context."
    return _contexts(spark, sf_dir).select(
        "path_id", c + "mission_id", c + "mission_name", c + "terrain_source", c + "path_summary.total_distance_m", rp.fixed(c + "path_summary.total_energy_cost_kwh", 4).alias("energy"),
        F.size(c + "path_summary.high_hazard_segments").cast("long").alias("segments"), F.element_at(c + "path_summary.high_hazard_segments", 1).segment_id.alias("worst_segment"),
        F.col(c + "rover_constraints.name").alias("rover"), c + "rover_constraints.energy_margin_kwh", c + "risk_score", c + "risk_score_numeric", c + "feasibility",
    )


def fallback_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.fallback_report(_contexts(spark, sf_dir))


def metadata_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each path out of the metadata text of a stored table."""
    document = F.struct(
        F.struct(F.struct("mean_hazard", "max_hazard").alias("aggregate")).alias("hazard_calculation_basis"), F.struct(F.col("max_slope_deg").alias("max_deg")).alias("slope"), F.lit("/srv/x.npz").alias("arrays_path"),
    )
    folder = f"{shared_dir(spark)}/metadata-{uuid.uuid4().hex}"
    risks(spark, sf_dir).select("path_id", F.to_json(document).alias("metadata")).write.parquet(folder)
    aggregate = "$.hazard_calculation_basis.aggregate"
    return spark.read.parquet(folder).select(
        "path_id", *rules.extract("metadata", mean_hazard=(f"{aggregate}.mean_hazard", "double"), max_hazard=(f"{aggregate}.max_hazard", "double"), max_deg=("$.slope.max_deg", "double"), arrays_path=("$.arrays_path", "string"))
    )


def strip_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata maps without their internal path."""
    meta = F.create_map(F.lit("source"), F.coalesce("terrain_source", F.lit("unspecified")), F.lit("arrays_path"), F.col("terrain_image_path"), F.lit("tile"), F.col("tile_id"))
    kept = rules.strip_key(meta, "arrays_path")
    return missions(spark, sf_dir).select("mission_id", F.array_join(F.map_keys(kept), ",").alias("keys"), F.array_join(F.map_values(kept), ",").alias("values"))


def audit_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = "basis."
    return rp.audit_basis(risks(spark, sf_dir), D).select("path_id", b + "risk_formula", F.col(b + "weights.hazard").alias("w_hazard"), b + "thresholds.margin", b + "inputs.total_energy_kwh", b + "inputs.num_waypoints")


#: Shapes of model replies by the path's number modulo their count; {p} is the path, {s} one of its segments, {t} another.
_OF = '"summary": "path {p}", "recommendation": "go"'
_ONE = '{{"segment_id": {s}, "reason": "steep"}}'
SHAPES = (
    "{{" + _OF + ', "top_risks": [' + _ONE + "]}}",
    "{{" + _OF + ', "top_risks": [{{"segment_id": 99999, "reason": "steep"}}, {{"segment_id": "{s}", "reason": "steep"}}, {{"segment_id": true, "reason": "steep"}}]}}',
    "```json\n{{" + _OF + ', "top_risks": [{{"segment_id": {t}, "reason": "steep"}}, ' + _ONE + "]}}\n```",
    '{{"summary": "path {p}", "top_risks": [' + _ONE + "]}}",
    "{{not json at all",
    "[1, 2, 3]",
    None,
    "\n \t```json\n{{" + _OF + ', "top_risks": [' + _ONE + "]}}\n```\n",
    "{{" + _OF + ', "top_risks": [{{"segment_id": "{s}.7", "reason": "steep"}}, {{"segment_id": {s}.7, "reason": "steep"}}, {s}, null, {{"reason": "steep"}}]}}',
    "{{" + _OF + ', "top_risks": "oops"}}',
    '{{"summary": null, "recommendation": null, "top_risks": null}}',
    "{{" + _OF + ', "top_risks": {s}7}}',
    "\r\n{{" + _OF + ', "top_risks": {{"segment_id": {s}, "reason": "steep"}}}}\t',
    "{{" + _OF + ', "top_risks": []}}',
    '{{"summary": "path {p}", "top_risks": [], "recommendation": true}}',
)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies made of documents, in the shapes above."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path_id"))
    at = lambda shape: F.lit(None) if shape is None else F.concat(*(_part(p) for p in _parts(shape)))
    raw = F.lit(None).cast("string")
    for i, shape in enumerate(SHAPES):
        raw = F.when(F.col("path_id") % len(SHAPES) == i, at(shape)).otherwise(raw)
    return d.withColumn("raw", raw)


def _parts(shape: str) -> list[str]:
    """Literal texts and the names p, s, t in braces of a shape."""
    return [x for x in re.split(r"(\{[pst]\})", shape.replace("{{", "\0").replace("}}", "\1")) if x]


def _part(part: str) -> F.Column:
    if part in ("{p}", "{s}", "{t}"):
        return F.expr({"{p}": "path_id", "{s}": "path_id % 7", "{t}": "path_id % 7 + 2"}[part]).cast("string")
    return F.lit(part.replace("\0", "{").replace("\1", "}"))


def allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path_id"))
    return d.select("path_id", F.explode(F.array(F.col("path_id") % 7, F.col("path_id") % 7 + 2)).alias("segment_id"))


def narrative_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rp.parse_replies(replies(spark, sf_dir))
    return p.select("path_id", "summary", "recommendation", F.size("risks").cast("long").alias("risks"), "fallback_reason").withColumn("risks", F.when(F.col("risks") >= 0, F.col("risks")))


def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.check_citations(rp.parse_replies(replies(spark, sf_dir)), allowed(spark, sf_dir))


def final_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path's report: the model's where it can be used, else the template."""
    found = rp.final_report(_contexts(spark, sf_dir), replies(spark, sf_dir))
    told = F.array_join(F.transform("top_risks", lambda k: F.concat(k.segment_id.cast("string"), F.lit(": "), k.reason)), " ")
    return found.withColumn("top_risks", told)


QUERIES = {f.__name__: f for f in (structured_context, fallback_report, metadata_extract, strip_key, audit_basis, narrative_parse, citation_check, final_report)}

TOP = "top5 as (select *, row_number() over (partition by path_id order by hazard_score desc, segment_id) as rank from path_steps qualify rank <= 5)"
CONTEXT = "ctx as (select r.*, m.name as mission_name, coalesce(m.terrain_source, 'unspecified') as terrain_source from risk r join missions m using (mission_id))"
def _shape_sql(shape: str | None) -> str:
    if shape is None:
        return "null"
    literal = lambda x: "'" + x.replace("\0", "{").replace("\1", "}").replace("'", "''") + "'"
    names = {"{p}": "doc_id", "{s}": "(doc_id % 7)", "{t}": "(doc_id % 7 + 2)"}
    return " || ".join(names.get(x) or literal(x) for x in _parts(shape))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
REPLIES = f"""replies as (
  select doc_id as path_id, case doc_id % {len(SHAPES)} {" ".join(f"when {i} then {_shape_sql(x)}" for i, x in enumerate(SHAPES))} end as raw from documents),
bodies as (
  select *, case when starts_with(told, '```') then {_STRIP.format("regexp_replace(split_part(told, '```', 2), '^json', '')")} else told end as body
  from (select *, {_STRIP.format("raw")} as told from replies)),
typed as (select *, case when json_valid(body) and json_type(body) = 'OBJECT' then json_type(body, '$.top_risks') end as kind from bodies),
judged as (
  select *, case when raw is null then 'no reply' when not json_valid(body) then 'unparseable model output' when json_type(body) <> 'OBJECT' then 'not an object'
    when not json_exists(body, '$.summary') then 'missing required key: summary' when not json_exists(body, '$.top_risks') then 'missing required key: top_risks'
    when not json_exists(body, '$.recommendation') then 'missing required key: recommendation'
    when kind in ('UBIGINT', 'BIGINT', 'DOUBLE') and json_extract(body, '$.top_risks')::double <> 0 or kind = 'BOOLEAN' and json_extract(body, '$.top_risks')::boolean then 'top_risks cannot be listed' end as fallback_reason from typed),
told as (
  select path_id, fallback_reason, {", ".join(f"case when fallback_reason is not null then null when json_type(body, '$.{c}') = 'NULL' then 'None' when json_type(body, '$.{c}') = 'BOOLEAN' then case when json_extract_string(body, '$.{c}') = 'true' then 'True' else 'False' end else json_extract_string(body, '$.{c}') end as {c}" for c in ("summary", "recommendation"))},
         case when fallback_reason is not null then null when kind = 'ARRAY' then json_array_length(body, '$.top_risks') when kind = 'VARCHAR' then length(json_extract_string(body, '$.top_risks'))
           when kind = 'OBJECT' then len(json_keys(body, '$.top_risks')) else 0 end::bigint as risks from judged),
listed as (
  select path_id, i, case when kind = 'ARRAY' then json_extract(body, '$.top_risks[' || i || ']') end as item
  from (select path_id, kind, body, unnest(range(risks)) as i from judged join told using (path_id) where risks > 0)),
cited as (
  select path_id, i, case json_type(item, '$.segment_id') when 'VARCHAR' then case when regexp_full_match(json_extract_string(item, '$.segment_id'), '\\s*[+-]?[0-9]+\\s*') then trim(json_extract_string(item, '$.segment_id'))::bigint end
    when 'BOOLEAN' then json_extract(item, '$.segment_id')::boolean::bigint when 'DOUBLE' then trunc(json_extract(item, '$.segment_id')::double)::bigint when 'UBIGINT' then json_extract(item, '$.segment_id')::bigint
    when 'BIGINT' then json_extract(item, '$.segment_id')::bigint end as segment_id from listed)"""
TEMPLATE = f"""template as (
  select path_id, printf('{words.SUMMARY}', risk_tier, risk_score, feasibility,
           total_distance_m, num_waypoints, round(total_energy_kwh + 1e-9::double, 4), capacity_kwh, energy_margin_kwh) || worst as summary, reasons,
         case feasibility when 'INFEASIBLE' then '{words.INFEASIBLE}'
           when 'FEASIBLE_WITH_MARGIN' then '{words.MARGIN_BEFORE}' || printf('%.4f', energy_margin_kwh) || '{words.MARGIN_AFTER}'
           else '{words.FEASIBLE}' end as recommendation
       from ctx join (
         select path_id, max(printf('{words.WORST_SEGMENT}', segment_id, hazard_score)) filter (rank = 1) as worst,
                string_agg(printf('%d: {words.REASON}', segment_id, hazard_score, x, y, slope_deg), ' ' order by rank) filter (rank <= 2) as reasons
         from top5 group by 1) using (path_id))"""
FINAL = """checked as (
  select c.path_id, string_agg(c.segment_id || ': steep', ' ' order by i) filter (t.segment_id is not null) as kept, count(*) filter (t.segment_id is null) as dropped
  from cited c left join top5 t on t.path_id = c.path_id and t.segment_id = c.segment_id group by 1),
final as (
  select t.path_id, case when j.path_id is not null and j.fallback_reason is null then 'llm' else 'template_fallback' end as generated_by,
         case when generated_by = 'llm' then j.summary else t.summary end as summary, case when generated_by = 'llm' then coalesce(c.kept, '') else t.reasons end as top_risks,
         case when generated_by = 'llm' then j.recommendation else t.recommendation end as recommendation, case when generated_by = 'llm' then coalesce(c.dropped, 0) end as dropped_citations,
         case when generated_by <> 'llm' then coalesce(j.fallback_reason, 'no reply') end as fallback_reason
  from template t left join told j using (path_id) left join checked c using (path_id))"""
ORACLE = {
    "final_report": with_ctes(*PATH_CTES, MISSIONS, TOP, CONTEXT, TEMPLATE, REPLIES, FINAL) + "select * from final",
    "structured_context": with_ctes(*PATH_CTES, MISSIONS, TOP, CONTEXT)
    + """select path_id, mission_id, mission_name, terrain_source, total_distance_m, printf('%.4f', round(total_energy_kwh + 1e-9::double, 4)) as energy, segments, worst_segment, rover_name as rover, energy_margin_kwh,
         risk_tier as risk_score, risk_score as risk_score_numeric, feasibility
       from ctx join (select path_id, count(*) as segments, min(segment_id) filter (rank = 1) as worst_segment from top5 group by 1) using (path_id)""",
    "fallback_report": with_ctes(*PATH_CTES, MISSIONS, TOP, CONTEXT, TEMPLATE) + "select * from template",
    "metadata_extract": with_ctes(*PATH_CTES) + "select path_id, mean_hazard, max_hazard, max_slope_deg as max_deg, '/srv/x.npz' as arrays_path from risk",
    "strip_key": with_ctes(MISSIONS) + "select mission_id, 'source,tile' as keys, coalesce(terrain_source, 'unspecified') || ',' || tile_id as values from missions",
    "audit_basis": with_ctes(*PATH_CTES)
    + f"""select path_id, '{words.RISK_FORMULA}' as risk_formula, {D.risk_weight_hazard}::double as w_hazard,
         {D.margin_fraction}::double as margin, total_energy_kwh, num_waypoints from risk""",
    "narrative_parse": with_ctes(REPLIES) + "select path_id, summary, recommendation, risks, fallback_reason from told",
    "citation_check": with_ctes(REPLIES)
    + """select path_id, coalesce(kept, '') as kept, coalesce(dropped, 0) as dropped from judged left join (
         select path_id, string_agg(segment_id::varchar, ',' order by i) filter (segment_id in (path_id % 7, path_id % 7 + 2)) as kept,
                count(*) filter (segment_id is null or segment_id not in (path_id % 7, path_id % 7 + 2)) as dropped from cited group by 1) using (path_id)
       where fallback_reason is null""",
}
