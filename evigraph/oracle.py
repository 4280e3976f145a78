"""What each query returns, as DuckDB SQL over the driver's tables."""

from __future__ import annotations

_KIND = "['new', 'ma-mat', 'ma-new', 'ma-splice', 'x'][substr(o_orderpriority, 1, 1)::INT]"
_BOX = """'{"model":"lat-long/v1","metadata_version":2,"lat_long":[],"datetime":[{"bbox":[12.6,34.3,118.7,59],"confidence":' || ((50 + o_orderkey % 50) / 100.0)::DECIMAL(4, 2)::VARCHAR || '}]}'"""

IM = f"""im AS (SELECT lpad(o_orderkey::VARCHAR, 8, '0') AS id,
  {_KIND} || '_' || CASE WHEN o_orderkey % 11 = 0 THEN 'null' ELSE strftime(o_orderdate, '%Y%m%d') END || '_' || CASE o_orderkey % 5 WHEN 0 THEN 'splitter' WHEN 4 THEN 'other' ELSE 'home' END
    || '_' || lpad(o_custkey::VARCHAR, 10, '0') || '_T' || lpad((o_orderkey % 37)::VARCHAR, 3, '0') || '_' || o_orderkey || '.jpg' AS original_filename,
  CASE WHEN o_orderkey % 13 = 0 THEN lpad(o_custkey::VARCHAR, 10, '0') WHEN o_orderkey % 17 = 0 THEN '' END AS source_job_number,
  strftime(o_orderdate, '%Y-%m-%d') AS source_archive_date, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS source_category,
  CASE o_orderstatus WHEN 'F' THEN 'VERIFIABLE' WHEN 'P' THEN 'UNVERIFIABLE' END AS image_quality_status,
  ['QUEUED', 'COMPLETED', 'UNVERIFIABLE', 'COMPLETED'][o_orderkey % 4 + 1] AS analysis_status, o_orderkey % 7 AS kind, o_orderkey % 50 AS c50,
  CASE o_orderkey % 7 WHEN 0 THEN {_BOX} WHEN 1 THEN '{{"model":"lat-long/v1","metadata_version":2,"lat_long":[],"datetime":[]}}' WHEN 2 THEN 'not-json' WHEN 3 THEN '{{"model":"lat-long/v1","lat_long":[],"datetime":[]}}' END AS ai_metadata_json,
  o_orderdate AS created_at FROM orders),
p0 AS (SELECT *, nullif(regexp_extract(original_filename, '(?:^|_)(?:home|splitter)_(\\d{{10}})(?:_([^_.]+))?(?:$|[_.])', 1, 'i'), '') AS pc,
  nullif(regexp_extract(original_filename, '(?:^|_)(?:home|splitter)_(\\d{{10}})(?:_([^_.]+))?(?:$|[_.])', 2, 'i'), '') AS pt,
  nullif(regexp_extract(original_filename, '(?:^|_)(new|ma-mat|ma-new|ma-splice)_(\\d{{8}}|null)(?:_|$)', 2, 'i'), '') AS pd,
  lower(nullif(regexp_extract(original_filename, '(?:^|_)(new|ma-mat|ma-new|ma-splice)_(\\d{{8}}|null)(?:_|$)', 1, 'i'), '')) AS job_type FROM im),
r AS (SELECT *, coalesce(nullif(source_job_number, ''), pc) AS customer_id, CASE WHEN pc IS NOT NULL THEN nullif(pd, 'null') END AS checkin_date, pt AS technician_id FROM p0)"""

PR = """raw AS (SELECT least(l_orderkey, o) AS a, greatest(l_orderkey, o) AS b, floor(l_discount * 1000 + 0.5) / 100 AS score, lvl FROM
  (SELECT l_orderkey, (7 * l_orderkey + 131 * l_linenumber + l_partkey) % (SELECT count(*) FROM orders) AS o, l_discount, (l_suppkey + l_linenumber) % 9 AS lvl FROM lineitem) WHERE l_orderkey <> o),
pr AS (SELECT lpad(a::VARCHAR, 8, '0') AS image_a_id, lpad(b::VARCHAR, 8, '0') AS image_b_id, score AS relationship_score,
  ['exact_file', 'same_image', 'edited_or_cropped', 'background_replaced', 'similar_person', 'same_scene_new_capture', 'repeated_checkin', 'unrelated', 'unverifiable'][lvl + 1] AS relationship_level
  FROM (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY score * 100 + lvl DESC, score DESC, lvl DESC) = 1))"""

_REP = "('exact_file', 'same_image', 'edited_or_cropped')"


def _good(score: float, classes: str = _REP, items: str = "im") -> str:
    ok = f"SELECT id FROM {items} WHERE image_quality_status IS DISTINCT FROM 'UNVERIFIABLE'"
    return f"SELECT * FROM pr WHERE relationship_level IN {classes} AND relationship_score >= {score} AND image_a_id IN ({ok}) AND image_b_id IN ({ok})"


def _closure(name: str, edges: str) -> str:
    """<name> (id, group_id) of the endpoints of ``edges`` (a, b); needs WITH RECURSIVE."""
    return f"""{name}_e AS (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})),
{name}_r AS (SELECT a AS x, a AS y FROM {name}_e UNION SELECT {name}_r.x, {name}_e.b FROM {name}_r JOIN {name}_e ON {name}_r.y = {name}_e.a),
{name} AS (SELECT x AS id, min(y) AS group_id FROM {name}_r GROUP BY x)"""


EDGES = "SELECT image_a_id AS a, image_b_id AS b FROM good"
BASE = f"WITH RECURSIVE {IM}, {PR}, good AS ({_good(0.8)})"
GROUPS = f"{BASE}, {_closure('g', EDGES)}"
ASOF = f"WITH RECURSIVE {IM}, {PR}, early AS (SELECT * FROM r WHERE checkin_date IS NULL OR checkin_date <= '19961231'), good AS ({_good(0.8, items='early')}), {_closure('g', EDGES)}"
SELECTED = f"""{BASE}, ends AS (SELECT image_a_id AS id FROM good UNION SELECT image_b_id FROM good),
sel AS (SELECT r.*, r.id IN (SELECT id FROM ends) AS reused, kind = 0 AS overlay, kind IN (0, 1) AS scanned FROM r WHERE checkin_date >= '19950101' AND checkin_date <= '19961231')"""


def _merged(groups: str, name: str) -> str:
    """<name> (id, group_id): ``groups`` joined by shared customers."""
    own = f"SELECT DISTINCT group_id, customer_id FROM {groups} JOIN r USING (id) WHERE customer_id IS NOT NULL"
    first = f"SELECT o.group_id AS a, f.first AS b FROM ({own}) o JOIN (SELECT customer_id, min(group_id) AS first FROM ({own}) GROUP BY customer_id) f USING (customer_id)"
    return f"{_closure(name + '_c', first)}, {name} AS (SELECT x.id, coalesce(c.group_id, x.group_id) AS group_id FROM {groups} x LEFT JOIN {name}_c c ON c.id = x.group_id)"


def _m(k: int) -> str:
    return f"((31 * l_partkey + 17 * l_suppkey + 7 * l_linenumber + {k} * l_quantity::INT + {k * k}) % 9973)"


_LABELS = {"head": (61, 60), "neck": (67, 60), "torso": (71, 20), "uarm": (73, 12), "hand": (79, 24)}
_OLD = "detected_transform = 'original'"
EV = f"""WITH ev AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'horizontal_flip' WHEN 2 THEN 'rotate_90' WHEN 3 THEN 'rotate_180' ELSE 'original' END AS detected_transform,
  l_linenumber = 1 AS flip, CASE l_linenumber WHEN 2 THEN 90 WHEN 3 THEN 180 ELSE 0 END AS rot,
  {_m(3)} % 90 AS ri, {_m(5)} % 101 / 100 AS rr, {_m(11)} % 50 / 100 AS rc, {_m(3)} % 90 + {_m(13)} % 60 AS good, 20 * (l_partkey % 60) AS ref,
  CASE WHEN l_suppkey % 7 <> 0 THEN floor(l_discount * 1000 + 0.5) / 100 END AS sim, {_m(17)} % 40 AS nd,
  CASE WHEN l_partkey % 19 <> 0 THEN CASE WHEN l_linenumber IN (1, 2, 3) THEN {_m(83)} % 65 ELSE {_m(17)} % 40 END END AS pd,
  {_m(19)} % 60 AS fi, {_m(23)} % 101 / 100 AS fr, {_m(29)} % 30 / 100 AS fc, {_m(31)} % 80 AS bi, {_m(37)} % 101 / 100 AS br, {_m(41)} % 10 / 100 AS bc,
  {_m(43)} % 400 AS va, {_m(47)} % 400 AS vb, {_m(53)} % 101 / 100 AS hf, {_m(59)} % 101 / 100 AS hb, {", ".join(f"{_m(k)} % {n} AS {x}" for x, (k, n) in _LABELS.items())} FROM lineitem),
gt AS (SELECT *, head + neck AS ident, torso + uarm + hand AS reuse, (torso > 0)::INT + (uarm > 0)::INT + (hand > 0)::INT >= 2 AND torso + uarm + hand >= 18 AND torso + uarm >= 10 AS gate FROM ev),
g2 AS (SELECT *, NOT gate AND greatest(torso, uarm, hand) >= 18 AS susp FROM gt),
g3 AS (SELECT *, ident >= 50 AND NOT gate AND NOT susp AS person FROM g2),
f1 AS (SELECT *, coalesce(fi >= 8 AND fr >= 0.30 AND hf <= 0.35 AND hb >= 0.45 AND hb - hf >= 0.20 AND sim >= 0.45 AND (gate OR susp), false) AS heat,
  gate AND fi >= 18 AND fr >= 0.30 AS fver, bi >= 30 AND br >= 0.20 AND bc >= 0.02 AS bver, fi >= 30 AND fr >= 0.55 AND fc >= 0.08 AS fsrc,
  least(va, vb) < 160 AS poor, coalesce(sim >= 0.55, false) AS alike FROM g3),
f2 AS (SELECT *, {_OLD} AND bver AS loc, {_OLD} AND bver AND fi >= 8 AND fr >= 0.50 AND fc >= 0.02 AND ident >= 6 AND reuse >= 4 AS rep,
  {_OLD} AND (fver OR fsrc OR heat) AND NOT bver AND nd > 10 AS scene, coalesce({_OLD} AND nd > 4 AND ri >= 40 AND rr >= 0.30 AND rc >= 0.18 AND sim >= 0.60, false) AS recap,
  NOT gate AND poor AND ri >= 18 AND rr >= 0.45 AND rc >= 0.08 AND (alike OR rr >= 0.75) AS whole FROM f1),
f3 AS (SELECT *, {_OLD} AND poor AND (whole OR (ri >= 12 AND rr >= 0.25 AND alike AND (gate OR susp OR nd <= 22))) AS blur FROM f2),
s1 AS (SELECT *, CASE WHEN pd IS NOT NULL THEN greatest(0.0, 1 - pd / 64) END::DOUBLE AS v1, greatest(0.0, least(1.0, sim))::DOUBLE AS v2x, CASE WHEN ref > 0 THEN least(1.0, good / greatest(12.0::DOUBLE, ref * 0.15::DOUBLE)) END::DOUBLE AS v3,
  CASE WHEN good > 0 THEN CASE WHEN ri >= 4 THEN rr ELSE 0 END END::DOUBLE AS v4 FROM f3),
s2 AS (SELECT *, CASE WHEN sim IS NOT NULL THEN v2x END AS v2 FROM s1),
s3 AS (SELECT *, coalesce(v1 * 0.15::DOUBLE, 0) + coalesce(v2 * 0.45::DOUBLE, 0) + coalesce(v3 * 0.05::DOUBLE, 0) + coalesce(v4 * 0.35::DOUBLE, 0) AS num,
  CASE WHEN v1 IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN v2 IS NULL THEN 0 ELSE 0.45::DOUBLE END + CASE WHEN v3 IS NULL THEN 0 ELSE 0.05::DOUBLE END + CASE WHEN v4 IS NULL THEN 0 ELSE 0.35::DOUBLE END AS den FROM s2),
s4 AS (SELECT *, CASE WHEN den > 0 THEN num / den ELSE 0 END AS raw FROM s3),
s5 AS (SELECT *, CASE WHEN scene THEN greatest(raw, CASE WHEN heat THEN 0.76 ELSE 0.72 END) WHEN rep THEN greatest(raw, 0.68) WHEN recap THEN greatest(raw, 0.80) WHEN blur THEN greatest(raw, 0.70)
  WHEN loc THEN greatest(raw, 0.67) WHEN person THEN least(raw, 0.64) ELSE raw END AS final FROM s4),
sc AS (SELECT *, CASE WHEN final >= 0.90 THEN 'VERY_HIGH_RELATION' WHEN final >= 0.80 THEN 'HIGH_RELATION' WHEN final >= 0.65 THEN 'POSSIBLY_RELATED' WHEN final >= 0.35 THEN 'LOW_RELATION' ELSE 'UNRELATED' END AS decision,
  CASE WHEN (flip OR rot <> 0) AND final >= 0.65 THEN 'edited_or_cropped' WHEN {_OLD} AND pd <= 4 AND rr >= 0.50 THEN 'same_image' WHEN recap OR blur THEN 'edited_or_cropped' WHEN scene THEN 'background_replaced'
  WHEN rep THEN 'repeated_checkin' WHEN gate AND ri >= 30 AND rr >= 0.20 THEN 'edited_or_cropped' WHEN loc THEN 'same_scene_new_capture' WHEN person THEN 'similar_person' WHEN ri >= 30 AND rr >= 0.20 THEN 'same_scene_new_capture' ELSE 'unrelated' END AS classification FROM s5)"""

FP = """WITH bits AS (SELECT vec_id, list_transform(embedding, lambda v: (v > 0)::INT::BIGINT) AS b FROM embeddings),
fp AS (SELECT vec_id, angle, list_sum(list_transform(range(32), lambda i: b[(i + shift) % 64 + 1] << (31 - i)))::BIGINT AS hi, list_sum(list_transform(range(32), lambda i: b[(i + 32 + shift) % 64 + 1] << (31 - i)))::BIGINT AS lo
  FROM bits, (VALUES (0, 0), (90, 16), (180, 32), (270, 48)) t(angle, shift))"""
_DIST = "bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo))"
_HITS = f"SELECT x.vec_id AS a, y.vec_id AS b, {_DIST} AS distance, x.angle AS angle_a, y.angle AS angle_b FROM fp x JOIN fp y ON x.vec_id < y.vec_id WHERE {_DIST} <= 18"
_BEST = f"SELECT * FROM ({_HITS}) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY distance, angle_a, angle_b) = 1"
_COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / greatest(sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])), 1e-12)"
_SIX = "floor({0} * 1e6 + 0.5) / 1e6"
_TOP = f"SELECT * FROM (SELECT x.vec_id AS query, y.vec_id AS match, {_COS.format('x.embedding', 'y.embedding')} AS sim FROM embeddings x, embeddings y) QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, match) <= 15"
_CONJ = f"SELECT h.a, h.b, h.distance, {_COS.format('va.embedding', 'vb.embedding')} AS sim FROM ({_BEST}) h JOIN embeddings va ON va.vec_id = h.a JOIN embeddings vb ON vb.vec_id = h.b"
_LINE = "l_orderkey, l_linenumber"
_ROOT = "coalesce(source_category, '__date_root__')"

ORACLES: dict[str, str] = {
    "scan_usable_images": f"WITH {IM} SELECT id, original_filename, image_quality_status FROM im WHERE image_quality_status IS DISTINCT FROM 'UNVERIFIABLE'",
    "parse_source_reference": f"WITH {IM} SELECT id, pc AS customer, pt AS technician, checkin_date FROM r",
    "parse_job_type": f"WITH {IM} SELECT id, job_type FROM r",
    "resolve_source_metadata": f"WITH {IM} SELECT id, customer_id, checkin_date, technician_id, job_type FROM r",
    "pending_archive_record": f"WITH {IM} SELECT id, original_filename, pc AS source_job_number, pt AS source_technician_id, coalesce(checkin_date, replace(source_archive_date, '-', '')) AS source_checkin_date, job_type AS source_job_type, 'image/jpeg' AS mime_type, 0 AS width, 0 AS height, '' AS sha256, 'QUEUED' AS analysis_status FROM r",
    "normalize_pairs": f"WITH {PR} SELECT a AS image_a_id, b AS image_b_id, count(*) AS n, max(score) AS score FROM raw GROUP BY ALL",
    "sha256_fingerprint": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "rotation_map_decode": f"{FP}, h AS (SELECT vec_id, angle, lower(lpad(to_hex(hi), 8, '0') || lpad(to_hex(lo), 8, '0')) AS hash FROM fp) SELECT vec_id, angle::VARCHAR AS angle, hash FROM h WHERE vec_id % 3 = 0 OR (vec_id % 5 <> 0 AND angle = 0)",
    "exact_duplicate_pairs": "SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON x.text = y.text AND x.doc_id < y.doc_id",
    "cosine_topk_candidates": f"SELECT query, match, {_SIX.format('sim')} AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, match) AS rank FROM ({_TOP})) WHERE query <> match AND sim >= 0.3",
    "hamming_radius_pairs": f"{FP} SELECT x.vec_id AS a, y.vec_id AS b, {_DIST} AS distance FROM fp x JOIN fp y ON x.vec_id < y.vec_id WHERE x.angle = 0 AND y.angle = 0 AND {_DIST} <= 18",
    "rotation_alignment": f"{FP} {_BEST}",
    "hamming_cosine_conjunction": f"{FP} SELECT a, b, distance, {_SIX.format('sim')} AS sim FROM ({_CONJ}) WHERE sim >= 0.1",
    "candidate_union_sources": f"""{FP}, t AS (SELECT least(query, match) AS a, greatest(query, match) AS b, max(sim) AS sim FROM ({_TOP}) WHERE query <> match AND sim >= 0.3 GROUP BY ALL),
legs AS (SELECT a, b, sim, 'vector' AS source, 0 AS p FROM t UNION ALL SELECT a, b, sim, 'phash', 1 FROM ({_CONJ}) WHERE sim >= 0.1
  UNION ALL SELECT first, vec_id, 1.0, 'sha256', 3 FROM (SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS first FROM embeddings) WHERE first < vec_id)
SELECT a, b, string_agg(source, ',' ORDER BY source) AS sources, {_SIX.format('arg_max(sim, p)')} AS sim FROM legs GROUP BY a, b""",
    "same_submission_filter": f"WITH {IM} SELECT x.id AS a, y.id AS b FROM r x JOIN r y ON x.customer_id = y.customer_id AND x.source_archive_date[:7] = y.source_archive_date[:7] AND x.id < y.id WHERE NOT coalesce(x.checkin_date = y.checkin_date, false)",
    "seen_pair_antijoin": f"WITH {PR} SELECT image_a_id AS a, image_b_id AS b, relationship_score FROM pr WHERE relationship_score < 0.5",
    "pair_transform_choice": f"""{EV}, c AS (SELECT *, coalesce(pd, 64) AS ad, ri >= 8 AND rr >= 0.30 AS np, fi >= 8 AND fr >= 0.30 AS ap FROM ev), h AS (SELECT *, ad <= 10 AND ad + 3 <= nd AS hint FROM c)
SELECT detected_transform, (hint OR NOT np) AND ap AND (hint OR NOT np OR fr >= rr + 0.10::DOUBLE) AS taken, count(*) AS n, sum(ad)::BIGINT AS distance_sum FROM h GROUP BY ALL""",
    "evidence_flags": f"{EV} SELECT {_LINE}, heat AS heatmap_scene_change_support, fver AS foreground_verified, bver AS background_verified, fsrc AS foreground_source_reuse, loc AS same_location_suspected, rep AS repeated_checkin_suspected, scene AS scene_change_suspected, recap AS recapture_suspected, whole AS whole_image_fallback_used, blur AS blurred_crop_suspected FROM sc",
    "weighted_score": f"{EV} SELECT {_LINE}, floor(raw * 10000 + 0.5) / 10000 AS score FROM sc",
    "score_floors": f"{EV} SELECT {_LINE}, floor(final * 10000 + 0.5) / 10000 AS relationship_score FROM sc",
    "decision_bands": f"{EV} SELECT decision, count(*) AS n FROM sc GROUP BY decision",
    "classify_pairs": f"{EV} SELECT {_LINE}, classification FROM sc",
    "reuse_verdict_counts": f"{EV} SELECT CASE WHEN classification IN {_REP} THEN 'reused' WHEN classification IN ('background_replaced', 'repeated_checkin', 'same_scene_new_capture') THEN 'review' ELSE 'not_reused' END AS reuse_verdict, classification, count(*) AS n FROM sc GROUP BY ALL",
    "score_reasons": f"""{EV} SELECT {_LINE}, coalesce(nullif(concat_ws(';', CASE WHEN v1 >= 0.80 THEN 'phash:' || pd END, CASE WHEN v2 >= 0.80 THEN 'embedding' END, CASE WHEN ref > 0 AND good >= 12 THEN 'sift:' || good END,
  CASE WHEN good > 0 AND ri >= 8 THEN 'ransac:' || ri END, CASE WHEN flip THEN 'mirror' END, CASE WHEN rot <> 0 THEN 'rotation:' || rot END,
  CASE WHEN gate THEN 'body_reuse' WHEN fsrc THEN 'source_reuse' WHEN susp THEN 'body_suspected' WHEN person THEN 'similar_person' END, CASE WHEN heat THEN 'background_changed' END,
  CASE WHEN scene THEN 'partial_reuse' WHEN rep THEN 'repeated_checkin' WHEN recap THEN 'recapture' WHEN blur AND whole THEN 'blurred_whole' WHEN blur THEN 'blurred_crop' WHEN loc THEN 'same_location' END), ''), 'none') AS reasons FROM sc""",
    "flip_rule": f"{EV} SELECT {_LINE}, CASE WHEN fr > rr + 0.05::DOUBLE THEN 'horizontal_flip' ELSE 'original' END AS transform FROM ev",
    "body_gate_rules": f"{EV} SELECT gate AS body_reuse_gate, susp AS body_reuse_suspected, person AS similar_person_only, count(*) AS n, sum(reuse)::BIGINT AS reuse, sum(ident)::BIGINT AS identity FROM g3 GROUP BY ALL",
    "reportable_pairs": f"WITH {IM}, {PR} SELECT image_a_id, image_b_id, relationship_level, relationship_score FROM ({_good(0.5)})",
    "groupable_pairs": f"WITH {IM}, {PR} SELECT image_a_id, image_b_id, relationship_level, relationship_score FROM (" + _good(0.5, "('exact_file', 'same_image', 'edited_or_cropped', 'background_replaced', 'similar_person', 'same_scene_new_capture', 'repeated_checkin')") + ")",
    "connected_component_labels": f"WITH RECURSIVE {PR}, {_closure('c', chr(10) + 'SELECT image_a_id AS a, image_b_id AS b FROM pr WHERE relationship_score >= 0.9 AND relationship_level IN ' + repr(('exact_file', 'same_image', 'unrelated')))} SELECT id AS node, group_id AS component FROM c",
    "reportable_groups": f"{GROUPS} SELECT id, group_id FROM g",
    "as_of_groups": f"{ASOF} SELECT id, group_id FROM g",
    "customer_merged_groups": f"{GROUPS}, {_merged('g', 'm')} SELECT id, group_id FROM m",
    "group_detail_nested": f"""{GROUPS}, l AS (SELECT x.group_id, count(*) AS n FROM good JOIN g x ON x.id = image_a_id JOIN g y ON y.id = image_b_id AND x.group_id = y.group_id GROUP BY 1)
SELECT g.group_id, count(*) AS size, any_value(l.n) AS relationship_count, coalesce(string_agg(DISTINCT customer_id, ',' ORDER BY customer_id), '') AS customers, coalesce(string_agg(DISTINCT technician_id, ',' ORDER BY technician_id), '') AS technicians, string_agg(id, ',' ORDER BY id) AS members
FROM g JOIN r USING (id) LEFT JOIN l ON l.group_id = g.group_id GROUP BY g.group_id""",
    "group_view_by_class": f"{GROUPS} SELECT g.group_id, image_a_id, image_b_id FROM good JOIN g ON g.id = image_a_id WHERE relationship_level = 'same_image'",
    "dashboard_headline": f"{SELECTED} SELECT count(*) AS images_in_system, count(*) FILTER (reused) AS reused_images, count(*) FILTER (overlay) AS overlay_images, count(*) FILTER (scanned) AS scanned_images, count(*) FILTER (NOT scanned) AS pending_images, count(DISTINCT customer_id) AS total_jobs, count(DISTINCT customer_id) FILTER (reused) AS reused_jobs FROM sel",
    "daily_rollup": f"{SELECTED} SELECT checkin_date, count(*) AS total_images, count(*) FILTER (reused) AS reused_images, count(DISTINCT customer_id) AS total_customer_ids, count(DISTINCT customer_id) FILTER (reused) AS reused_customer_ids, count(*) FILTER (overlay) AS overlay_images FROM sel GROUP BY checkin_date",
    "technician_ranking": f"{SELECTED} SELECT technician_id, count(DISTINCT customer_id) AS reused_customer_ids FROM sel WHERE reused AND technician_id IS NOT NULL AND customer_id IS NOT NULL GROUP BY 1",
    "duplicate_jobs": f"""{SELECTED}, t AS (SELECT DISTINCT image_a_id, image_b_id, customer_id FROM good JOIN sel ON sel.id IN (image_a_id, image_b_id) WHERE customer_id IS NOT NULL), l AS (SELECT customer_id, count(*) AS n FROM t GROUP BY 1)
SELECT customer_id, count(*) AS images_in_system, count(*) FILTER (reused) AS reused_images, coalesce(any_value(l.n), 0) AS evidence_links FROM sel LEFT JOIN l USING (customer_id) WHERE customer_id IS NOT NULL GROUP BY customer_id HAVING count(*) FILTER (reused) > 0""",
    "export_preview": f"""{SELECTED}, early AS (SELECT * FROM r WHERE checkin_date IS NULL OR checkin_date <= '19961231'), good2 AS ({_good(0.8, items='early')}), {_closure('h', 'SELECT image_a_id AS a, image_b_id AS b FROM good2')},
hs AS (SELECT * FROM h WHERE group_id IN (SELECT group_id FROM h JOIN sel USING (id))), {_merged('hs', 'm')},
x AS (SELECT m.group_id, r.*, r.id IN (SELECT id FROM sel) AS chosen FROM m JOIN r USING (id))
SELECT count(DISTINCT group_id) AS group_count, count(*) AS report_images, count(*) FILTER (NOT chosen) AS cross_date_images, count(DISTINCT customer_id) FILTER (chosen) AS selected_date_customer_ids, count(DISTINCT customer_id) FILTER (NOT chosen) AS cross_date_customer_ids,
count(DISTINCT technician_id) AS technician_ids, count(DISTINCT checkin_date) FILTER (NOT chosen) AS cross_dates, count(*) FILTER (kind = 0) AS overlay_images, (SELECT count(*) FROM sel WHERE reused) AS selected_images FROM x""",
    "exportable_customers": f"""{GROUPS}, x AS (SELECT g.group_id, r.* FROM g JOIN r USING (id) WHERE customer_id IS NOT NULL), hit AS (SELECT * FROM x WHERE checkin_date BETWEEN '19950101' AND '19961231' AND contains(customer_id, '1')),
rel AS (SELECT DISTINCT hit.customer_id, x.customer_id AS other FROM hit JOIN x USING (group_id)), rs AS (SELECT customer_id, string_agg(other, ',' ORDER BY other) AS related_customer_ids FROM rel GROUP BY 1)
SELECT customer_id, count(*) AS image_count, string_agg(DISTINCT checkin_date, ',' ORDER BY checkin_date) AS dates, any_value(related_customer_ids) AS related_customer_ids, customer_id IN (SELECT source_job_number FROM im WHERE id LIKE '%7' AND source_job_number IS NOT NULL) AS exported
FROM hit JOIN rs USING (customer_id) GROUP BY customer_id""",
    "technician_customer_sets": f"""{GROUPS}, x AS (SELECT r.* FROM g JOIN r USING (id) WHERE technician_id IS NOT NULL AND customer_id IS NOT NULL)
SELECT technician_id, string_agg(DISTINCT customer_id, ',' ORDER BY customer_id) AS customers FROM x WHERE technician_id IN (SELECT technician_id FROM x WHERE checkin_date BETWEEN '19950101' AND '19961231') GROUP BY 1""",
    "detection_summary_rows": f"""{BASE} SELECT image_a_id, image_b_id, x.customer_id AS customer_id_a, y.customer_id AS customer_id_b,
coalesce(x.checkin_date[7:8] || '/' || x.checkin_date[5:6] || '/' || x.checkin_date[1:4], '-') AS date_a, coalesce(y.checkin_date[7:8] || '/' || y.checkin_date[5:6] || '/' || y.checkin_date[1:4], '-') AS date_b,
strftime(x.created_at + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS time_a, least(coalesce(x.checkin_date, ''), coalesce(y.checkin_date, '')) AS sort_date, least(coalesce(x.customer_id, ''), coalesce(y.customer_id, '')) AS sort_customer, least(coalesce(x.job_type, ''), coalesce(y.job_type, '')) AS sort_job_type
FROM good JOIN r x ON x.id = image_a_id JOIN r y ON y.id = image_b_id""",
    "overlay_sections": f"WITH {IM} SELECT technician_id, customer_id, string_agg(checkin_date || '|' || original_filename || '|' || (50 + c50) || '|13', ',' ORDER BY checkin_date, original_filename) AS images FROM r WHERE kind = 0 AND checkin_date BETWEEN '19950101' AND '19961231' GROUP BY ALL",
    "overlay_box_parse": f"WITH {IM} SELECT id, 13 AS x1, 34 AS y1, 119 AS x2, 59 AS y2, json_extract(ai_metadata_json, '$.datetime[0].confidence')::DOUBLE AS confidence FROM (SELECT * FROM im WHERE kind = 0)",
    "overlay_scan_counts": f"WITH {IM} SELECT count(*) FILTER (kind IN (0, 1)) AS scanned, count(*) FILTER (kind = 0) AS with_box, count(*) FILTER (ai_metadata_json LIKE '%model%') AS with_model, count(*) AS n FROM im",
    "archive_catalogue": f"WITH {IM}, c AS (SELECT DISTINCT source_archive_date, {_ROOT} AS c FROM im) SELECT i.source_archive_date, i.n AS image_count, x.cs AS categories FROM (SELECT source_archive_date, count(*) AS n FROM im GROUP BY 1) i JOIN (SELECT source_archive_date, string_agg(c, ',' ORDER BY c <> '__date_root__', lower(c)) AS cs FROM c GROUP BY 1) x USING (source_archive_date)",
    "archive_status": f"""WITH {IM}, f AS (SELECT source_archive_date, count(*) AS image_count FROM im GROUP BY 1), c AS (SELECT source_archive_date, count(*) AS i, count(*) FILTER (analysis_status IN ('COMPLETED', 'UNVERIFIABLE')) AS d FROM im WHERE id NOT LIKE '%3' GROUP BY 1)
SELECT source_archive_date, image_count, coalesce(i, 0) AS imported, coalesce(d, 0) AS analyzed, coalesce(i - d, 0) AS pending, greatest(0, image_count - coalesce(i, 0)) AS not_imported, coalesce(d, 0) >= image_count AS complete FROM f LEFT JOIN c USING (source_archive_date)""",
    "job_progress": f"WITH {IM} SELECT id[1:6] AS job, count(*) AS total, least(count(*), greatest(count(image_quality_status), count(*) FILTER (analysis_status = 'COMPLETED'))) AS shown FROM im GROUP BY 1",
    "active_job": """WITH j AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'click' THEN 'QUEUED' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'signup' THEN 'INTERRUPTED' ELSE 'EMBEDDING' END AS status FROM events),
l AS (SELECT * FROM j WHERE status IN ('QUEUED', 'EMBEDDING') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT p.user_id, p.pending, l.event_id AS active_job, l.status FROM (SELECT user_id, count(*) FILTER (status NOT IN ('COMPLETED', 'FAILED')) AS pending FROM j GROUP BY 1) p LEFT JOIN l USING (user_id)""",
    "latest_job_unrelated_pairs": f"WITH {IM}, {PR}, c AS (SELECT * FROM im WHERE created_at >= (SELECT max(created_at)::DATE - 400 FROM im)) SELECT image_a_id, image_b_id, x.original_filename AS name_a, y.original_filename AS name_b FROM pr JOIN c x ON x.id = image_a_id JOIN c y ON y.id = image_b_id WHERE relationship_level = 'unrelated'",
    "filename_token_counts": f"WITH {IM} SELECT regexp_extract(original_filename, 'home_(\\d{{10}})', 1) AS number, count(*) AS n FROM im WHERE original_filename LIKE '%home_%' GROUP BY 1",
    "prefix_counts": f"WITH {IM} SELECT split_part(original_filename, '_', 1) AS prefix, count(*) AS n, count(DISTINCT regexp_extract(original_filename, 'home_(\\d{{10}})', 1)) AS numbers FROM im GROUP BY 1",
    "pair_upsert": f"WITH {PR} SELECT relationship_level, count(*) AS n, count(*) FILTER (relationship_score >= 0.9) AS renewed FROM pr GROUP BY 1",
    "pair_reconcile_delete": f"WITH {IM}, {PR}, u AS (SELECT * FROM r WHERE image_quality_status IS DISTINCT FROM 'UNVERIFIABLE') SELECT image_a_id, image_b_id FROM pr JOIN u x ON x.id = image_a_id JOIN u y ON y.id = image_b_id WHERE NOT coalesce(x.customer_id = y.customer_id AND x.checkin_date = y.checkin_date, false)",
    "legacy_backfill": f"WITH {IM} SELECT id, coalesce(pc, nullif(source_job_number, '')) AS source_job_number, checkin_date AS source_checkin_date, pt AS source_technician_id, job_type AS source_job_type FROM r",
    "archive_import_plan": f"WITH {IM} SELECT source_archive_date || '/' || original_filename AS path, CASE WHEN id LIKE '%3' THEN 'register' ELSE 'requeue' END AS action FROM im WHERE id LIKE '%3' OR analysis_status = 'QUEUED'",
    "report_snapshot_rows": f"{GROUPS} SELECT 'r1' AS export_report_id, id AS image_id, customer_id AS source_job_number, checkin_date AS source_checkin_date, technician_id AS source_technician_id, group_id AS group_id_snapshot FROM g JOIN r USING (id)",
    "cascade_delete_pairs": f"WITH {IM}, {PR}, gone AS (SELECT id FROM im WHERE analysis_status = 'UNVERIFIABLE') SELECT image_a_id, image_b_id FROM pr WHERE image_a_id NOT IN (SELECT id FROM gone) AND image_b_id NOT IN (SELECT id FROM gone)",
}
