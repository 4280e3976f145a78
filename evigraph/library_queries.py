"""Queries of intake, display and remaining candidate operators, with their SQL; see ``queries.py`` for the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions import evidence as E
from evigraph.functions import images as P
from evigraph.functions import metadata as M
from evigraph.operators import candidates as C
from evigraph.operators import display as D
from evigraph.operators import forest as T
from evigraph.operators import groups as G
from evigraph.operators import intake as I
from evigraph.operators import matching as X
from evigraph.operators import reports as R
from evigraph.operators.live_groups import LiveGroups
from evigraph.operators.rollups import Rollups
from evigraph.plans.scratch import materialize, new_path
from evigraph.oracle import _BEST, _COS, _SIX, _TOP, ASOF, BASE, EDGES, EV, FP, GROUPS, IM, ORACLES, PR, SELECTED, _closure
from evigraph.oracle import _good as _sql_good
from evigraph.queries import COSINE, FIRST, HAMMING, LAST, MIN_SCORE, _good, _groups, _scored, _selected, _topk, query
from evigraph.sources import views as V
from evigraph.sources.tables import Table
from evigraph.streaming import ledger as J

#: Queries without SQL: pixels of made images.
ROWS_ONLY = ("blur_variance", "quality_gate", "dct_hash", "homography_ransac")


def sql(text: str):
    """Register a query and what it returns."""

    def add(f):
        ORACLES[f.__name__] = text
        return query(f)

    return add


def _k(c: str = "id"):
    return F.col(c).cast("int")


@sql(f"WITH {IM} SELECT id, original_filename FROM im WHERE id = '00000007'")
def item_lookup(s, d):
    return V.items(s, d).where("id = '00000007'").select("id", "original_filename")


@sql("SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 97 = 0)")
def digest_lookup(s, d):
    own = V.table(s, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return own.join(own.where("doc_id % 97 = 0").select("sha256").distinct(), "sha256", "left_semi").select("doc_id")


@sql(f"""WITH {IM} SELECT id FROM im WHERE ai_metadata_json IS NULL OR ai_metadata_json LIKE '%"error"%' OR ai_metadata_json NOT LIKE '%"lat_long"%'""")
def rescan_rows(s, d):
    return V.items(s, d).where(M.needs_scan(F.col("ai_metadata_json"))).select("id")


_LEGACY = "source_archive_date IS NOT NULL AND id::INT % 5 = 0 AND image_quality_status IS NULL AS needs_import, id::INT % 3 = 0 AS needs_quality, image_quality_status IS DISTINCT FROM 'UNVERIFIABLE' AND id::INT % 7 = 0 AS needs_rotations"


@sql(f"WITH {IM} SELECT * FROM (SELECT id, {_LEGACY} FROM im) WHERE needs_import OR needs_quality OR needs_rotations")
def legacy_rows(s, d):
    k = _k()
    rows = V.items(s, d).withColumns({"image_quality_version": F.when(k % 3 == 0, "v1").otherwise("v2"), "sha256": F.when(k % 5 == 0, "").otherwise(F.sha2("id", 256)), "n_rotations": F.when(k % 7 == 0, 1).otherwise(4)})
    return I.legacy(rows, "v2").select("id", "needs_import", "needs_quality", "needs_rotations")


@sql("""WITH j AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'click' THEN 'CANCELLED' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'signup' THEN 'INTERRUPTED' ELSE 'EMBEDDING' END AS status FROM events)
SELECT user_id, event_id AS job_id, status FROM j WHERE status IN ('CANCELLED', 'INTERRUPTED', 'FAILED') AND event_id % 5 < 4 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def resumable_job(s, d):
    kinds = (("click", "CANCELLED"), ("error", "FAILED"), ("purchase", "COMPLETED"), ("signup", "INTERRUPTED"), ("view", "EMBEDDING"))
    state = F.element_at(F.create_map(*[F.lit(x) for kv in kinds for x in kv]), F.col("event_type"))
    jobs = V.table(s, d, "events").select("user_id", F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), state.alias("status"), (F.col("event_id") % 5).alias("processed"), F.lit(4).alias("total"))
    return D.resumable(jobs, "user_id")


_PERIOD = f"checkin_date BETWEEN '{FIRST}' AND '{LAST}'"


@sql(f"{ASOF} SELECT DISTINCT group_id FROM g JOIN r USING (id) WHERE {_PERIOD} AND customer_id LIKE '%1'")
def group_period_match(s, d):
    items = V.items(s, d)
    customers = G.resolved_items(items).where("customer_id LIKE '%1'").select("customer_id")
    return D.matching_groups(G.as_of_groups(items, V.pairs(s, d), MIN_SCORE, LAST), items, FIRST, LAST, customers)


@sql(f"""{ASOF}, m AS (SELECT group_id FROM g JOIN r USING (id) WHERE {_PERIOD})
SELECT 'r1' AS export_report_id, coalesce(min(checkin_date), '{FIRST}') AS date_from, coalesce(max(checkin_date), '{LAST}') AS date_to, count(DISTINCT group_id) AS group_count, count(*) AS image_count FROM g JOIN r USING (id) WHERE group_id IN (SELECT group_id FROM m)""")
def report_row(s, d):
    items = V.items(s, d)
    grouped = G.as_of_groups(items, V.pairs(s, d), MIN_SCORE, LAST)
    own = grouped.join(D.matching_groups(grouped, items, FIRST, LAST), "group_id", "left_semi")
    return D.report_row(own, items, "r1", FIRST, LAST)


@sql(ORACLES["export_preview"].split("\nSELECT count(DISTINCT group_id)")[0] + "\nSELECT coalesce(string_agg(DISTINCT checkin_date, ',' ORDER BY checkin_date), '') AS cross_dates FROM x WHERE NOT chosen")
def export_cross_dates(s, d):
    rows, _, _ = R.report_images(V.items(s, d), V.pairs(s, d), MIN_SCORE, FIRST, LAST)
    return rows.where("NOT chosen").agg(F.array_join(F.array_sort(F.collect_set("checkin_date")), ",").alias("cross_dates"))


@sql(f"""WITH {IM}, c AS (SELECT *, id::INT AS k FROM r) SELECT id, CASE WHEN k % 6 = 0 OR k % 4 IN (1, 2) THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') ELSE checkin_date[7:8] || '/' || checkin_date[5:6] || '/' || checkin_date[1:4] END AS captured_at FROM c""")
def capture_time_shown(s, d):
    k, t = _k(), F.col("created_at")
    exif = F.date_format(t, "yyyy:MM:dd HH:mm:ss")
    rows = G.resolved_items(V.items(s, d)).withColumns({"stored": F.when(k % 6 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k % 5 == 0, ""), "original": F.when(k % 4 == 1, exif).when(k % 4 == 3, "13:13 today").when(k % 4 == 2, ""), "plain": F.when(k % 4 != 0, exif)})
    return rows.select("id", M.capture_time(F.col("stored"), M.exif_time(F.col("original"), F.col("plain")), F.col("checkin_date")).alias("captured_at"))


_SIDE = "coalesce({s}.technician_id, '') AS image_{s}_technician_id, coalesce({s}.customer_id, '') AS image_{s}_customer_id, {s}.original_filename AS image_{s}_filename, coalesce({s}.checkin_date[7:8] || '/' || {s}.checkin_date[5:6] || '/' || {s}.checkin_date[1:4], '') AS image_{s}_captured_at, coalesce({s}.job_type, '') AS image_{s}_job_type"


@sql(f"""{BASE} SELECT strftime(greatest(a.created_at, b.created_at), '%Y-%m-%d %H:%M:%S') AS checked_at, 'reused' AS detect_category, relationship_level AS detect_sub_category, {_SIDE.format(s='a')}, {_SIDE.format(s='b')}
FROM good JOIN r a ON a.id = image_a_id JOIN r b ON b.id = image_b_id""")
def detection_sheet(s, d):
    items = V.items(s, d)
    at = items.select("id", "created_at")
    pairs = _good(s, d).join(at.select(F.col("id").alias("image_a_id"), F.col("created_at").alias("ta")), "image_a_id").join(at.select(F.col("id").alias("image_b_id"), F.col("created_at").alias("tb")), "image_b_id")
    return D.detection_sheet(pairs.withColumn("checked_at", F.greatest("ta", "tb")), items)


@sql(f"""{EV} SELECT l_orderkey, l_linenumber, pd AS phash_distance, sim AS dino_similarity, good AS sift_matches, ri AS ransac_inliers, rr AS ransac_inlier_ratio, flip::INT AS flip_detected, floor(final * 10000 + 0.5) / 10000 AS relationship_score, classification AS relationship_level,
  'topk' AS source, CASE WHEN l_linenumber = 2 THEN '90' END AS rotation FROM sc""")
def evidence_flat_columns(s, d):
    rows = _scored(s, d).withColumns({"candidate_sources": F.array(F.lit("topk")), "phash_current_rotation": F.when(F.col("l_linenumber") == 2, 90)})
    out = E.flat(rows, "candidate_sources", "phash_current_rotation")
    return out.select("l_orderkey", "l_linenumber", *E.FLAT, F.get_json_object("details_json", "$.candidate_sources[0]").alias("source"), F.get_json_object("details_json", "$.phash_current_rotation").alias("rotation"))


@sql(f"WITH {IM} SELECT id, original_filename, analysis_status FROM im")
def public_rows(s, d):
    shown = I.public(V.items(s, d).withColumn("storage_path", F.concat(F.lit("/lib/"), "id")))
    return shown.select(*[c for c in shown.columns if c in ("id", "original_filename", "analysis_status", "storage_path")])


@sql(f"""{EV} SELECT l_orderkey, l_linenumber, array_to_string(list_slice(list_filter([CASE WHEN flip THEN 'mirror' END, CASE WHEN rot <> 0 THEN 'rotation:' || rot END, CASE WHEN recap THEN 'recapture' END, CASE WHEN blur THEN 'blurred_crop' END, CASE WHEN whole THEN 'whole_image' END,
  CASE WHEN gate THEN 'body_reuse' WHEN susp THEN 'body_suspected' END, CASE WHEN sim IS NOT NULL THEN 'alike:' || floor(sim * 100 + 0.5)::INT || '%' END, 'points:' || ri], lambda x: x IS NOT NULL), 1, 4), ';') AS reasons FROM sc""")
def plain_reasons(s, d):
    return _scored(s, d).select("l_orderkey", "l_linenumber", F.array_join(E.plain_reasons(), ";").alias("reasons"))


@sql("""WITH f AS (SELECT o_orderkey, o_custkey, o_orderkey % 6 < 5 AND (o_orderkey * 7919) % 6291456 <= 5242880 AS valid, (o_orderkey * 7919) % 6291456 AS size FROM orders)
SELECT o_orderkey, valid AND count(*) OVER w <= 12 AND coalesce(sum(size) FILTER (valid) OVER w, 0) <= 26214400 AS accepted FROM f WINDOW w AS (PARTITION BY o_custkey)""")
def upload_selection(s, d):
    k = F.col("o_orderkey")
    mime = F.element_at(F.array(*map(F.lit, ("image/jpeg", "image/png", "image/webp", "image/tiff", "image/bmp", "image/gif"))), (k % 6 + 1).cast("int"))
    files = V.table(s, d, "orders").select("o_orderkey", "o_custkey", mime.alias("mime"), (k * 7919 % (6 << 20)).alias("size"))
    return I.upload_selection(files, "o_custkey", 12, 25 << 20).select("o_orderkey", "accepted")


@sql("""WITH e AS (SELECT sha256(text) AS sha256, min(doc_id) AS existing_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT doc_id AS id, existing_id, CASE WHEN existing_id IS NULL THEN 'insert' ELSE 'existing' END AS action FROM (SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 1) LEFT JOIN e USING (sha256)""")
def upload_plan(s, d):
    own = V.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return I.upload_plan(own.where("id % 2 = 1"), own.where("id % 2 = 0"))


@sql(f"""{GROUPS}, o AS (SELECT customer_id, min(group_id) AS own FROM g JOIN r USING (id) GROUP BY 1), q AS (SELECT lpad(c_custkey::VARCHAR, 10, '0') AS customer_id, lpad((3 * c_custkey)::VARCHAR, 8, '0') AS asked, lpad((5 * c_custkey)::VARCHAR, 8, '0') AS previous FROM customer)
SELECT customer_id, coalesce(own, CASE WHEN asked IN (SELECT group_id FROM g) THEN asked END, CASE WHEN previous IN (SELECT group_id FROM g) THEN previous END, (SELECT min(group_id) FROM g)) AS group_id FROM q LEFT JOIN o USING (customer_id)""")
def group_lookup(s, d):
    key = lambda n, w: F.lpad((F.col("c_custkey") * n).cast("string"), w, "0")
    requests = V.table(s, d, "customer").select(key(1, 10).alias("customer_id"), key(3, 8).alias("asked_id"), key(5, 8).alias("previous_id"))
    return D.lookup(_groups(s, d), V.items(s, d), requests).select("customer_id", "group_id")


@sql(f"{GROUPS} SELECT group_id, row_number() OVER (ORDER BY group_id) AS number FROM (SELECT DISTINCT group_id FROM g)")
def numbered_groups(s, d):
    return D.numbered(_groups(s, d).select("group_id").distinct(), "group_id")


@sql(f"""{SELECTED}, t AS (SELECT technician_id, count(DISTINCT customer_id) AS n FROM sel WHERE reused AND technician_id IS NOT NULL AND customer_id IS NOT NULL GROUP BY 1), y AS (SELECT checkin_date, count(*) FILTER (reused) AS n FROM sel GROUP BY 1)
SELECT * FROM (SELECT 'daily' AS chart, checkin_date AS label, n AS value FROM y ORDER BY checkin_date DESC LIMIT 14) UNION ALL SELECT * FROM (SELECT 'technician', technician_id, n FROM t ORDER BY n DESC, technician_id LIMIT 10)""")
def chart_points(s, d):
    chosen = _selected(s, d)
    return D.last_points(R.daily(chosen), "reused_images").unionByName(D.top_bars(R.technicians(chosen)))


@sql("SELECT user_id, min(event_id) AS position, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def unique_records(s, d):
    return D.first_place_last_value(V.table(s, d, "events"), "user_id", "event_id", "event_type", "value")


@sql("""WITH m AS (SELECT l_orderkey, ['head', 'neck', 'torso', 'uarm', 'hand'][l_linenumber % 5 + 1] AS label, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT l_orderkey, string_agg(label || ':' || n, ',' ORDER BY label) AS counts FROM m GROUP BY 1""")
def label_inliers(s, d):
    label = F.element_at(F.array(*map(F.lit, ("head", "neck", "torso", "uarm", "hand"))), F.col("l_linenumber") % 5 + 1)
    matches = V.table(s, d, "lineitem").select("l_orderkey", label.alias("label"), (F.col("l_returnflag") != "N").alias("inlier"))
    out = E.label_counts(matches, "l_orderkey")
    return out.select("l_orderkey", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@sql(f"""WITH s AS ({ORACLES['archive_status']}), t AS (SELECT sum(image_count)::BIGINT AS images, sum(analyzed)::BIGINT AS analyzed, sum(pending)::BIGINT AS pending, sum(not_imported)::BIGINT AS not_imported FROM s)
SELECT *, least(100, floor(100 * analyzed / images + 0.5))::BIGINT AS percent, greatest(0, images - pending)::BIGINT AS analyzed_card, greatest(100, images)::BIGINT AS safe_total FROM t""")
def client_totals(s, d):
    items = V.items(s, d)
    files = items.groupBy("source_archive_date").agg(F.count("*").alias("image_count"))
    return D.totals(R.archive_status(files, items.where("id NOT LIKE '%3'")), 100)


_UNIT = _SIX.format("(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))")


@sql(f"SELECT vec_id, {_UNIT} AS first FROM embeddings WHERE vec_id % 5 <> 0")
def vector_index(s, d):
    """The index after an addition, in which some are known, and a removal."""
    own = V.table(s, d, "embeddings").select("vec_id", "embedding")
    index = I.index_add(own.where("vec_id < 0").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), own.where("vec_id % 3 = 0"))
    index = I.index_remove(I.index_add(index, own), own.where("vec_id % 5 = 0"))
    return index.select("vec_id", (F.floor(F.col("embedding")[0] * 1e6 + 0.5) / 1e6).alias("first"))


@sql("SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) AS cached, length(text) AS feature FROM documents WHERE text IS NOT NULL")
def feature_cache(s, d):
    own = V.table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    cache = own.where("doc_id % 2 = 0").groupBy("sha256").agg(F.first(F.length("text")).alias("feature")).withColumn("params", F.lit("p1"))
    out, _ = I.with_features(own, cache, "p1", F.length("text"))
    return out.select("doc_id", "cached", "feature")


@sql(f"""WITH {IM}, c AS (SELECT *, id::INT AS k, '/lib/' || id[1:2] || '/' || id || '.jpg' AS own FROM im) SELECT id, CASE WHEN k % 4 = 0 OR (k % 4 > 1 AND k % 3 <> 0 AND k % 9 <> 1) THEN own WHEN k % 4 = 1 THEN '/mnt/share/' || original_filename END AS path FROM c""")
def blob_paths(s, d):
    k = _k()
    own = F.concat(F.lit("/lib/"), F.substring("id", 1, 2), F.lit("/"), "id")
    stored = F.when(k % 4 == 0, F.concat(own, F.lit(".jpg"))).when(k % 4 == 1, F.concat(F.lit("/mnt/share/"), "original_filename")).when(k % 4 == 2, F.concat(F.lit("/etc/"), "id", F.lit(".jpg"))).otherwise(F.concat(F.lit("/lib/zz/other"), "id", F.lit(".jpg")))
    items = V.items(s, d).withColumn("storage_path", stored)
    there = F.array(F.col("storage_path"), F.when(k % 3 != 0, F.concat(own, F.lit(".jpg"))), F.when(k % 9 == 1, F.concat(own, F.lit(".png"))))
    files = items.select(F.explode(there).alias("path")).where("path IS NOT NULL")
    return I.resolved_paths(items, files, "/lib", ("/mnt/share",))


@sql(f"WITH {IM}, {PR} SELECT id, id IN (SELECT image_a_id FROM pr UNION SELECT image_b_id FROM pr) AS blocked FROM im WHERE analysis_status = 'UNVERIFIABLE'")
def restrict_delete(s, d):
    return I.restricted(V.items(s, d).where("analysis_status = 'UNVERIFIABLE'"), V.pairs(s, d), "image_a_id", "image_b_id")


@sql("SELECT l_suppkey % 50 AS job_id, count(DISTINCT vec_id) AS embedded FROM lineitem JOIN embeddings ON vec_id = l_partkey % 500 WHERE label % 2 = 0 GROUP BY 1")
def embedding_progress(s, d):
    job_items = V.table(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("job_id"), (F.col("l_partkey") % 500).alias("image_id"))
    return D.embedded(job_items, V.table(s, d, "embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("image_id")))


_ALT = {"rotate_90": (7, 3), "rotate_180": (11, 5), "rotate_270": (13, 7), "horizontal_flip": (17, 11)}
_NAMES = ", ".join(f"'{n}'" for n in _ALT)


@sql(f"""{EV}, c AS (SELECT *, [{", ".join(f"(nd * {a} + {b}) % 65" for a, b in _ALT.values())}] AS ds FROM ev), p AS (SELECT *, list_min(ds) AS ad, list_position(ds, list_min(ds))::INT AS i FROM c),
h AS (SELECT *, (fi + 9 * i) % 60 AS ai, ad <= 10 AND ad + 3 <= nd AS hint, ri >= 8 AND rr >= 0.30 AS np FROM p), t AS (SELECT *, (hint OR NOT np) AND ai >= 8 AND fr >= 0.30 AND (hint OR NOT np OR fr >= rr + 0.10::DOUBLE) AS taken FROM h)
SELECT CASE WHEN taken THEN [{_NAMES}][i] ELSE 'original' END AS transform, count(*) AS n, sum(CASE WHEN taken THEN ad ELSE nd END)::BIGINT AS distance FROM t GROUP BY ALL""")
def pair_best_transform(s, d):
    """The closest of four transforms, tried where the hash suggests it or the plain geometry fails."""
    rows = V.evidence(s, d).withColumns({f"d_{n}": (F.col("phash_normal_distance") * a + b) % 65 for n, (a, b) in _ALT.items()})
    best = E.best_alternative({n: F.col(f"d_{n}") for n in _ALT})
    rows = rows.withColumn("alt", best).withColumns({"alt_distance": F.col("alt.distance"), "alt_inliers": (F.col("foreground_inliers") + 9 * (F.col("alt.place") + 1)) % 60, "alt_ratio": F.col("foreground_ratio")})
    rows = rows.withColumn("taken", E.chosen_transform())
    distance = F.when(F.col("taken") == "original", F.col("phash_normal_distance")).otherwise(F.col("alt_distance"))
    return rows.groupBy(F.col("taken").alias("transform")).agg(F.count("*").alias("n"), F.sum(distance).alias("distance"))


@sql(f"""WITH {IM}, c AS (SELECT *, id::INT AS k FROM im) SELECT id, translate(lower(source_category), '_- ', '') AS label, CASE WHEN length(original_filename) > 31 THEN original_filename[1:28] || '...' ELSE original_filename END AS shown, base64(encode(id)) AS data,
CASE WHEN k % 7 <> 0 THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS parsed, date_diff('second', TIMESTAMP '1990-01-01 00:00:00', created_at) AS seconds FROM c""")
def scalar_helpers(s, d):
    k, t = _k(), F.col("created_at")
    text = F.when(k % 7 == 0, "soon").when(k % 3 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k % 3 == 1, F.date_format(t, "yyyy:MM:dd HH:mm:ss")).otherwise(F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250")))
    return V.items(s, d).select("id", M.label(F.col("source_category")).alias("label"), M.shortened(F.col("original_filename"), 28).alias("shown"), F.base64(F.encode("id", "UTF-8")).alias("data"), F.date_format(M.any_time(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"), M.seconds(F.lit("1990-01-01 00:00:00").cast("timestamp_ntz"), t).alias("seconds"))


@sql("""WITH f AS (SELECT o_orderkey AS k, o_orderkey * 7919 % 7340032 AS length, (o_orderkey % 97) * 100 * (o_orderkey % 89) * 100 AS pixels FROM orders)
SELECT k AS id, CASE WHEN length > 5242880 THEN 'too_large' WHEN k % 8 = 0 THEN 'not_decodable' WHEN pixels > 40000000 THEN 'too_many_pixels' WHEN k % 6 = 5 THEN 'unsupported_format' WHEN k % 6 > 2 THEN 'type_disabled' END AS reason FROM f""")
def validation_reasons(s, d):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, (*I.FORMATS, "GIF"))), (k % 6 + 1).cast("int"))
    files = V.table(s, d, "orders").select(k.alias("id"), (k * 7919 % (7 << 20)).alias("length"), (k % 8 != 0).alias("decodable"), (k % 97 * 100).alias("width"), (k % 89 * 100).alias("height"), kind.alias("format"))
    return I.refused(files, ("image/jpeg", "image/png", "image/webp")).select("id", "reason")


@sql("SELECT doc_id AS id, min(doc_id) OVER w AS representative, count(*) OVER w AS size FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text) QUALIFY count(*) OVER w > 1")
def exact_duplicate_classes(s, d):
    own = V.table(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return C.duplicate_classes(own)


#: Turned vectors are stored for ids that 3 doesn't divide.
_STORED = "rv AS (SELECT vec_id AS id, angle, list_concat(list_slice(embedding, angle // 90 * 16 + 1, 64), list_slice(embedding, 1, angle // 90 * 16)) AS v FROM embeddings, (VALUES (0), (90), (180), (270)) t(angle) WHERE angle = 0 OR vec_id % 3 <> 0)"
_BASED = f"hb AS (SELECT h.*, {_COS.format('va.v', 'vb.v')} AS base FROM ({_BEST}) h JOIN rv va ON va.id = h.a AND va.angle = 0 JOIN rv vb ON vb.id = h.b AND vb.angle = 0)"
_ROTATED = f"""{_STORED}, {_BASED},
gate AS (SELECT a, b, distance, 'phash_and_base' AS source, base AS sim FROM hb WHERE base >= 0.1
  UNION ALL SELECT * FROM (SELECT a, b, distance, 'phash_and_rotated', {_COS.format('va.v', 'vb.v')} AS sim FROM hb JOIN rv va ON va.id = a AND va.angle = angle_a JOIN rv vb ON vb.id = b AND vb.angle = angle_b WHERE base < 0.1 AND angle_a <> angle_b) WHERE sim >= 0.1)"""


def _turned(s, d):
    return C.near_and_turned(V.fingerprints(s, d), V.rotated_vectors(s, d), HAMMING, 0.1)


@sql(f"{FP}, {_STORED}, {_BASED}, n AS (SELECT a AS id, angle_a AS angle FROM hb WHERE base < 0.1 AND angle_a <> angle_b UNION SELECT b, angle_b FROM hb WHERE base < 0.1 AND angle_a <> angle_b) SELECT id, angle FROM n WHERE (id, angle) NOT IN (SELECT (id, angle) FROM rv)")
def missing_rotations(s, d):
    """Turned vectors that the model still has to make for the hits that need them."""
    return C.near_and_missing(V.fingerprints(s, d), V.rotated_vectors(s, d), HAMMING, 0.1)


@sql(f"{FP}, {_ROTATED} SELECT a, b, distance, source, {_SIX.format('sim')} AS sim FROM gate")
def rotated_conjunction(s, d):
    return _turned(s, d).select("a", "b", "distance", "source", (F.floor(F.col("sim") * 1e6 + 0.5) / 1e6).alias("sim"))


@sql(f"""{FP}, {_ROTATED}, t AS (SELECT least(query, match) AS a, greatest(query, match) AS b, max(sim) AS sim FROM ({_TOP}) WHERE query <> match AND sim >= 0.3 GROUP BY ALL),
same AS (SELECT min(vec_id) OVER (PARTITION BY label) AS a, vec_id AS b FROM embeddings),
legs AS (SELECT a, b, sim, 'topk' AS source, 0 AS p FROM t UNION ALL SELECT a, b, sim, source, CASE source WHEN 'phash_and_base' THEN 1 ELSE 2 END FROM gate UNION ALL SELECT a, b, 1.0, 'sha256_exact', 3 FROM same WHERE a < b)
SELECT a, b, string_agg(source, ',' ORDER BY source) AS sources, {_SIX.format('arg_max(sim, p)')} AS sim FROM legs GROUP BY a, b""")
def candidate_sources_rotated(s, d):
    """All legs, the digests' over all rows: each member is linked to the first of its class."""
    top = _topk(s, d).where((F.col("query") != F.col("match")) & (F.col("sim") >= COSINE)).select(F.least("query", "match").alias("a"), F.greatest("query", "match").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    both = _turned(s, d)
    own = V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.sha2(F.encode(F.col("label").cast("string"), "UTF-8"), 256).alias("sha256"))
    same = C.duplicate_classes(own).where("id <> representative").select(F.col("representative").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    # one pass over the hits for both of their sources
    leg = lambda rows, source, priority: rows.select("a", "b", "sim", source.alias("source"), priority.alias("priority"))
    hits = leg(both, F.col("source"), F.when(F.col("source") == "phash_and_base", 1).otherwise(2))
    out = C.united(leg(top, F.lit("topk"), F.lit(0)).unionByName(hits).unionByName(leg(same, F.lit("sha256_exact"), F.lit(3))))
    return out.select("a", "b", F.array_join("sources", ",").alias("sources"), (F.floor(F.col("sim") * 1e6 + 0.5) / 1e6).alias("sim"))


_STEP = "CASE WHEN {0} THEN 'skip' WHEN image_quality_status = 'UNVERIFIABLE' THEN 'complete' ELSE 'process' END"


@sql(f"WITH {IM} SELECT id, {_STEP.format('id::INT % 4 = 1')} AS action, {_STEP.format('false')} AS forced FROM im")
def resume_items(s, d):
    items = V.items(s, d)
    done = items.where(_k() % 4 == 1)
    return I.next_steps(items, done).join(I.next_steps(items, done, force=True).withColumnRenamed("action", "forced"), "id")


@sql(f"WITH {IM} SELECT CASE WHEN id::INT % 4 = 0 THEN CASE WHEN id::INT % 8 = 0 THEN 'VERIFIABLE' END ELSE image_quality_status END AS image_quality_status, count(*) AS n FROM im GROUP BY 1")
def chunked_update(s, d):
    items = V.items(s, d)
    results = items.where(_k() % 4 == 0).select("id", F.when(_k() % 8 == 0, "VERIFIABLE").alias("image_quality_status"))
    return I.updated(items, results, ["image_quality_status"]).groupBy("image_quality_status").agg(F.count("*").alias("n"))


_VERSIONS = """v1 AS (SELECT *, relationship_score AS score, relationship_level AS level FROM pr WHERE relationship_score < 0.95),
v2 AS (SELECT image_a_id, image_b_id, CASE WHEN relationship_score >= 0.9 THEN 0.25 ELSE relationship_score END AS score, relationship_level AS level FROM pr),
v3 AS (SELECT image_a_id, image_b_id, score, CASE level WHEN 'unverifiable' THEN 'unrelated' ELSE level END AS level FROM v2), v4 AS (SELECT * FROM v3 WHERE score < 0.5),
every AS (SELECT 1 AS version, score, level FROM v1 UNION ALL SELECT 2, score, level FROM v2 UNION ALL SELECT 3, score, level FROM v3 UNION ALL SELECT 4, score, level FROM v4 UNION ALL SELECT 5, score, level FROM v2)"""


@sql(f"WITH {PR}, {_VERSIONS} SELECT version, level AS relationship_level, count(*) AS n, count(*) FILTER (score = 0.25) AS renewed FROM every GROUP BY ALL")
def versioned_pairs(s, d):
    """Five versions of a stored table, and what each holds: written, renewed (twice, by one batch), changed, thinned out and taken back."""
    pr = V.pairs(s, d)
    table = Table(s, new_path(s, "library"), ["image_a_id", "image_b_id"])
    table.upsert(pr.where("relationship_score < 0.95"), "first")
    for _ in range(2):
        table.upsert(pr.where("relationship_score >= 0.9").withColumn("relationship_score", F.lit(0.25)), "renewed")
    table.update(pr.where("relationship_level = 'unverifiable'").select("image_a_id", "image_b_id", F.lit("unrelated").alias("relationship_level")), "changed")
    table.delete(table.read().where("relationship_score >= 0.5"), "thinned")
    table.restore(2, "back")
    counts = [table.read(v).groupBy("relationship_level").agg(F.count("*").alias("n"), F.count_if(F.col("relationship_score") == 0.25).alias("renewed")).withColumn("version", F.lit(v)) for v in range(1, 6)]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@sql(f"WITH RECURSIVE {IM}, {PR}, good AS ({_sql_good(0.8)}), {_closure('g', 'SELECT image_a_id AS a, image_b_id AS b FROM good WHERE (image_a_id::INT + image_b_id::INT) % 5 <> 0')} SELECT id, group_id FROM g")
def live_groups(s, d):
    """Groups after three batches of pairs, one of them twice, and the removal of a fifth of the pairs."""
    pairs = materialize(_good(s, d).select(F.col("image_a_id").alias("a"), F.col("image_b_id").alias("b")), "pairs")
    groups = LiveGroups(s, new_path(s, "groups"))
    turn = F.col("a").cast("int") % 3
    for k in (0, 1, 1, 2):
        groups.add(pairs.where(turn == k), f"batch-{k}")
    groups.remove(pairs.where((F.col("a").cast("int") + F.col("b").cast("int")) % 5 == 0), "removed")
    return groups.groups().select(F.col("node").alias("id"), F.col("component").alias("group_id"))


_DATED = f"{BASE}, dated AS (SELECT image_a_id AS a, image_b_id AS b, greatest(coalesce(x.checkin_date, ''), coalesce(y.checkin_date, '')) AS w FROM good JOIN r x ON x.id = image_a_id JOIN r y ON y.id = image_b_id)"
_CUTOFFS = tuple(f"{y}{m}" for y in range(1992, 1999) for m in ("0630", "1231"))


@sql(f"""{_DATED}, cuts AS (SELECT unnest([{", ".join(f"'{c}'" for c in _CUTOFFS)}]) AS cutoff), e AS (SELECT cutoff, a, b FROM dated, cuts WHERE w <= cutoff UNION SELECT cutoff, b, a FROM dated, cuts WHERE w <= cutoff),
t AS (SELECT cutoff, a AS x, a AS y FROM e UNION SELECT t.cutoff, t.x, e.b FROM t JOIN e ON t.cutoff = e.cutoff AND t.y = e.a) SELECT cutoff, x AS id, min(y) AS group_id FROM t GROUP BY cutoff, x""")
def as_of_all_dates(s, d):
    """Groups at the end of each half-year, all from one spanning forest."""
    forest = T.spanning_forest(T.dated_pairs(_good(s, d), V.items(s, d)))
    return T.groups_at(forest, s.createDataFrame([(c,) for c in _CUTOFFS], "cutoff string"))


@sql(f"{_DATED}, n AS (SELECT count(*) AS nodes FROM (SELECT a FROM dated UNION SELECT b FROM dated)), {_closure('g', EDGES)} SELECT count(DISTINCT group_id) AS groups, any_value(nodes) AS nodes, any_value(nodes) - count(DISTINCT group_id) AS edges FROM g, n")
def forest_size(s, d):
    """A spanning forest has as many edges as nodes less groups."""
    forest = T.spanning_forest(T.dated_pairs(_good(s, d), V.items(s, d)))
    size = forest.agg(F.count("*").alias("edges"))
    ends = forest.select(F.explode(F.array("a", "b")).alias("id")).distinct().agg(F.count("*").alias("nodes"))
    return ends.crossJoin(size).select((F.col("nodes") - F.col("edges")).alias("groups"), "nodes", "edges")


@sql(f"WITH {IM} SELECT id[1:6] AS job, count(*) AS total, count(*) FILTER (image_quality_status IS NOT NULL OR analysis_status = 'COMPLETED') AS processed, count(*) FILTER (analysis_status = 'COMPLETED') AS completed FROM im GROUP BY 1")
def job_ledger(s, d):
    """Counts of jobs by a stream over three files of item events, shuffled, some of them twice."""
    items = V.items(s, d).select(F.substring("id", 1, 6).alias("job"), F.col("id").alias("item"), "image_quality_status", "analysis_status")
    step = lambda name, rows: rows.select("job", "item", F.lit(name).alias("step"))
    done = step("completed", items.where("analysis_status = 'COMPLETED'"))
    events = step("registered", items).unionByName(step("embedded", items.where("image_quality_status IS NOT NULL"))).unionByName(done).unionByName(done.where("item LIKE '%1'"))
    source = materialize(events.repartition(3, F.xxhash64("item", "step", F.rand(1))), "events")
    table, key = Table(s, new_path(s, "jobs"), ["job"]), "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key)
    s.conf.set(key, J.PROVIDER)
    try:
        stream = s.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(source.scratch_path)
        J.keep(stream, table, new_path(s, "ledger")).awaitTermination()
    finally:
        s.conf.set(key, before)
    return table.read().select("job", "total", "processed", "completed")


def _stored_rollups(s, d):
    """Roll-ups of all days, of which those of 1996 came with half of their images first."""
    chosen = materialize(R.selected(V.items(s, d), _good(s, d), None, None).select("id", "checkin_date", "customer_id", "reused", "overlay", "scanned"), "chosen")
    rollups = Rollups(s, new_path(s, "rollups"))
    rollups.put(chosen.where("checkin_date < '1996' OR id LIKE '%1' OR id LIKE '%2'"), "early")
    rollups.put(chosen.where("checkin_date >= '1996'"), "late")
    return rollups


@sql(ORACLES["daily_rollup"])
def stored_daily_rollup(s, d):
    return _stored_rollups(s, d).daily(FIRST, LAST)


@sql(ORACLES["dashboard_headline"])
def stored_headline(s, d):
    return _stored_rollups(s, d).headline(FIRST, LAST)


_POINTS = "pt AS (SELECT vec_id AS image, i AS point, list_slice(embedding, 8 * i + 1, 8 * i + 8)::DOUBLE[] AS v FROM embeddings, (SELECT unnest(range(8))::INT AS i))"
_MET = "met AS (SELECT a, b, x.point AS pa, y.point AS pb, list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM ps JOIN pt x ON x.image = a JOIN pt y ON y.image = b)"
_CLEAR = "SELECT a, b, pa, pb, d FROM (SELECT *, row_number() OVER w AS nth, lead(d) OVER w AS next FROM met WINDOW w AS (PARTITION BY a, b, {0} ORDER BY d, {1})) WHERE nth = 1 AND d < 0.81 * next"


@sql(f"WITH ps AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND y.vec_id BETWEEN x.vec_id + 1 AND x.vec_id + 40), {_POINTS}, {_MET}, f AS ({_CLEAR.format('pa', 'pb')}), g AS ({_CLEAR.format('pb', 'pa')}) SELECT a, b, pa, pb, {_SIX.format('sqrt(f.d)')} AS distance FROM f JOIN g USING (a, b, pa, pb)")
def descriptor_matches(s, d):
    """Mutual matches of eight descriptors of eight numbers for each vector, between vectors of one label that are near in number."""
    e = V.table(s, d, "embeddings")
    own = e.select("vec_id", "label")
    pairs = own.alias("x").join(own.alias("y"), F.expr("x.label = y.label AND y.vec_id BETWEEN x.vec_id + 1 AND x.vec_id + 40")).select(F.col("x.vec_id").alias("a"), F.col("y.vec_id").alias("b"))
    points = e.select(F.col("vec_id").alias("image"), F.posexplode(F.array(*[F.slice("embedding", 8 * i + 1, 8) for i in range(8)])).alias("point", "vector"))
    out = X.mutual_matches(pairs, points, 0.9)
    return out.select("a", "b", "pa", "pb", (F.floor(F.col("distance") * 1e6 + 0.5) / 1e6).alias("distance"))


def _made_images(s, d):
    """Grey images of 8 x 8 made of vectors, as the image source would decode them."""
    level = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v * 400 + 128)))
    return V.table(s, d, "embeddings").select("vec_id", F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(level(v)), 2, "0")), "")).alias("data"), F.lit(8).alias("height"), F.lit(8).alias("width"))


@query
def quality_gate(s, d):
    rows = _made_images(s, d).withColumn("q", P.quality_udf("data", "height", "width"))
    return rows.select("vec_id", "q.status", "q.reason", F.round("q.near_black", 6).alias("near_black"))


@query
def blur_variance(s, d):
    return _made_images(s, d).select("vec_id", F.round(P.blur_variance_udf("data", "height", "width"), 4).alias("blur_variance"))


@query
def dct_hash(s, d):
    return _made_images(s, d).select("vec_id", F.explode(P.rotation_hashes_udf("data", "height", "width")).alias("angle", "hash"))


@query
def homography_ransac(s, d):
    """Points of a vector and the same ones moved, a quarter of them elsewhere."""
    points = F.transform("embedding", lambda v: v.cast("double") * 100 + 50)
    moved = F.transform(points, lambda x, i: F.when(i % 16 < 4, x * -3 + i).otherwise(x + 5))
    size = F.array(F.lit(200), F.lit(200))
    return V.table(s, d, "embeddings").repartition("vec_id").select("vec_id", P.homography_udf(points, moved, size, size).alias("h")).select("vec_id", "h.inliers", F.round("h.ratio", 6).alias("ratio"))
