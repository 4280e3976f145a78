"""One query for each operator over the views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.config import Rules
from evigraph.functions import evidence as E
from evigraph.functions import metadata as M
from evigraph.operators import candidates as C
from evigraph.operators import groups as G
from evigraph.operators import library as L
from evigraph.operators import reports as R
from evigraph.operators.components import connected_components
from evigraph.plans.scratch import materialize
from evigraph.sources import views as V

MIN_SCORE = 0.8
FIRST, LAST = "19950101", "19961231"
COSINE, HAMMING, TOP = 0.3, 18, 15

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def text(c):
    return F.array_join(c, ",")


@query
def scan_usable_images(s, d):
    return V.items(s, d).where(M.usable(F.col("image_quality_status"))).select("id", "original_filename", "image_quality_status")


@query
def parse_source_reference(s, d):
    n = F.col("original_filename")
    return V.items(s, d).select("id", M.customer(n).alias("customer"), M.technician(n).alias("technician"), M.checkin_date(n).alias("checkin_date"))


@query
def parse_job_type(s, d):
    return V.items(s, d).select("id", M.job_type(F.col("original_filename")).alias("job_type"))


@query
def resolve_source_metadata(s, d):
    return G.resolved_items(V.items(s, d)).select("id", "customer_id", "checkin_date", "technician_id", "job_type")


@query
def pending_archive_record(s, d):
    return L.pending_records(V.items(s, d))


@query
def normalize_pairs(s, d):
    raw = V.raw_pairs(s, d).select(F.col("b").alias("image_a_id"), F.col("a").alias("image_b_id"), "score")
    return L.normalized(raw).groupBy("image_a_id", "image_b_id").agg(F.count("*").alias("n"), F.max("score").alias("score"))


@query
def sha256_fingerprint(s, d):
    return V.table(s, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


@query
def rotation_map_decode(s, d):
    fp = V.fingerprints(s, d).groupBy("vec_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("angle").cast("string"), F.lower(F.concat(F.lpad(F.hex("hi"), 8, "0"), F.lpad(F.hex("lo"), 8, "0"))))))).alias("m"))
    json = F.when(F.col("vec_id") % 3 == 0, F.to_json("m")).when(F.col("vec_id") % 3 == 1, "{broken")
    rows = fp.select("vec_id", M.rotation_map(json, F.when(F.col("vec_id") % 5 != 0, F.element_at("m", "0"))).alias("r"))
    return rows.select("vec_id", F.explode("r").alias("angle", "hash"))


def _digests(s, d):
    return sha256_fingerprint(s, d).withColumnRenamed("doc_id", "id")


@query
def exact_duplicate_pairs(s, d):
    return C.exact_duplicates(_digests(s, d))


def _topk(s, d):
    return C.topk_cosine(V.table(s, d, "embeddings"), TOP)


@query
def cosine_topk_candidates(s, d):
    """The k are taken before the filters, oneself among them."""
    return _topk(s, d).where((F.col("query") != F.col("match")) & (F.col("sim") >= COSINE)).select("query", "match", (F.floor(F.col("sim") * 1e6 + 0.5) / 1e6).alias("sim"), "rank")


@query
def hamming_radius_pairs(s, d):
    return C.hamming_pairs(V.fingerprints(s, d), HAMMING, rotations=False).select("a", "b", "distance")


@query
def rotation_alignment(s, d):
    return C.hamming_pairs(V.fingerprints(s, d), HAMMING)


def _conjunction(s, d):
    vectors = V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("angle"), F.col("embedding").alias("vector"))
    return C.near_and_alike(V.fingerprints(s, d), vectors, HAMMING, 0.1)


@query
def hamming_cosine_conjunction(s, d):
    return _conjunction(s, d).select("a", "b", "distance", (F.floor(F.col("sim") * 1e6 + 0.5) / 1e6).alias("sim"))


@query
def candidate_union_sources(s, d):
    top = _topk(s, d).where((F.col("query") != F.col("match")) & (F.col("sim") >= COSINE)).select(F.least("query", "match").alias("a"), F.greatest("query", "match").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    classes = C.duplicate_classes(V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.sha2(F.encode(F.col("label").cast("string"), "UTF-8"), 256).alias("sha256")))
    same = classes.where("id <> representative").select(F.col("representative").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    out = C.union_sources(("vector", 0, top), ("phash", 1, _conjunction(s, d).select("a", "b", "sim")), ("sha256", 3, same))
    return out.select("a", "b", text("sources").alias("sources"), (F.floor(F.col("sim") * 1e6 + 0.5) / 1e6).alias("sim"))


@query
def same_submission_filter(s, d):
    own = G.resolved_items(V.items(s, d)).select("id", "customer_id", "checkin_date", F.substring("source_archive_date", 1, 7).alias("month"))
    pairs = own.alias("a").join(own.alias("b"), F.expr("a.month = b.month AND a.customer_id = b.customer_id AND a.id < b.id"))
    return pairs.where(~M.same_submission("a", "b")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query
def seen_pair_antijoin(s, d):
    pr = V.pairs(s, d).select(F.col("image_a_id").alias("a"), F.col("image_b_id").alias("b"), "relationship_score")
    return C.unseen(pr, pr.where("relationship_score >= 0.5")).select("a", "b", "relationship_score")


@query
def pair_transform_choice(s, d):
    r = Rules()
    rows = V.evidence(s, d).withColumns({"alt_distance": F.coalesce("phash_distance", F.lit(64)), "alt_ratio": F.col("foreground_ratio"), "alt_inliers": F.col("foreground_inliers")})
    passes = lambda n, ratio: (F.col(n) >= r.min_inliers) & (F.col(ratio) >= r.min_inlier_ratio)
    rows = rows.withColumn("taken", E.transform_choice(passes("ransac_inliers", "ransac_inlier_ratio"), passes("alt_inliers", "alt_ratio")))
    return rows.groupBy("detected_transform", "taken").agg(F.count("*").alias("n"), F.sum("alt_distance").alias("distance_sum"))


def _flagged(s, d):
    return E.flags(E.body_gates(V.evidence(s, d)))


def _scored(s, d):
    return E.score(_flagged(s, d))


FLAGS = ("heatmap_scene_change_support", "foreground_verified", "background_verified", "foreground_source_reuse", "same_location_suspected", "repeated_checkin_suspected", "scene_change_suspected", "recapture_suspected", "whole_image_fallback_used", "blurred_crop_suspected")


@query
def evidence_flags(s, d):
    return _flagged(s, d).select("l_orderkey", "l_linenumber", *FLAGS)


@query
def weighted_score(s, d):
    return _scored(s, d).select("l_orderkey", "l_linenumber", E.rounded(F.col("raw_score")).alias("score"))


@query
def score_floors(s, d):
    return _scored(s, d).select("l_orderkey", "l_linenumber", "relationship_score")


@query
def decision_bands(s, d):
    return _scored(s, d).groupBy("decision").agg(F.count("*").alias("n"))


@query
def classify_pairs(s, d):
    return _scored(s, d).select("l_orderkey", "l_linenumber", "classification")


@query
def reuse_verdict_counts(s, d):
    return _scored(s, d).groupBy("reuse_verdict", "classification").agg(F.count("*").alias("n"))


@query
def score_reasons(s, d):
    return _scored(s, d).select("l_orderkey", "l_linenumber", F.array_join("reasons", ";").alias("reasons"))


@query
def flip_rule(s, d):
    flipped = F.col("foreground_ratio") > F.col("ransac_inlier_ratio") + F.lit(0.05)
    return V.evidence(s, d).select("l_orderkey", "l_linenumber", F.when(flipped, "horizontal_flip").otherwise("original").alias("transform"))


@query
def body_gate_rules(s, d):
    return E.body_gates(V.evidence(s, d)).groupBy("body_reuse_gate", "body_reuse_suspected", "similar_person_only").agg(F.count("*").alias("n"), F.sum("reuse_inliers").alias("reuse"), F.sum("identity_inliers").alias("identity"))


def _good(s, d, classes=G.REPORTABLE, score=MIN_SCORE):
    return G.qualified(V.pairs(s, d), V.items(s, d), classes, score)


@query
def reportable_pairs(s, d):
    return _good(s, d, score=0.5).select("image_a_id", "image_b_id", "relationship_level", "relationship_score")


@query
def groupable_pairs(s, d):
    return _good(s, d, G.GROUPABLE, 0.5).select("image_a_id", "image_b_id", "relationship_level", "relationship_score")


@query
def connected_component_labels(s, d):
    return connected_components(V.pairs(s, d).where("relationship_score >= 0.9 AND relationship_level IN ('exact_file', 'same_image', 'unrelated')"), "image_a_id", "image_b_id")


def _groups(s, d):
    return G.reportable_groups(V.items(s, d), V.pairs(s, d), MIN_SCORE)


@query
def reportable_groups(s, d):
    return _groups(s, d)


@query
def as_of_groups(s, d):
    return G.as_of_groups(V.items(s, d), V.pairs(s, d), MIN_SCORE, LAST)


@query
def customer_merged_groups(s, d):
    return G.merged_by_customer(_groups(s, d), V.items(s, d))


@query
def group_detail_nested(s, d):
    good = materialize(_good(s, d).select("image_a_id", "image_b_id"), "pairs")
    out = G.detail(materialize(G.groups(good), "groups"), V.items(s, d), good)
    return out.select("group_id", "size", "relationship_count", text("customers").alias("customers"), text("technicians").alias("technicians"), text("members").alias("members"))


@query
def group_view_by_class(s, d):
    """Pairs of one class within groups that all classes made."""
    return G.with_relations(_groups(s, d), _good(s, d)).where("relationship_level = 'same_image'").select("group_id", "image_a_id", "image_b_id")


def _selected(s, d):
    return R.selected(V.items(s, d), _good(s, d), FIRST, LAST)


@query
def dashboard_headline(s, d):
    return R.headline(_selected(s, d))


@query
def daily_rollup(s, d):
    return R.daily(_selected(s, d))


@query
def technician_ranking(s, d):
    return R.technicians(_selected(s, d))


@query
def duplicate_jobs(s, d):
    return R.duplicate_jobs(_selected(s, d), _good(s, d))


@query
def export_preview(s, d):
    return R.export_preview(V.items(s, d), V.pairs(s, d), MIN_SCORE, FIRST, LAST)


@query
def exportable_customers(s, d):
    exported = V.items(s, d).where("id LIKE '%7'").select("source_job_number")
    out = R.exportable_customers(_groups(s, d), V.items(s, d), exported, FIRST, LAST, "1")
    return out.select("customer_id", "image_count", text("dates").alias("dates"), text("related_customer_ids").alias("related_customer_ids"), "exported")


@query
def technician_customer_sets(s, d):
    return R.technician_customers(_groups(s, d), V.items(s, d), FIRST, LAST).select("technician_id", text("customers").alias("customers"))


@query
def detection_summary_rows(s, d):
    return R.detection_rows(_good(s, d), V.items(s, d))


@query
def overlay_sections(s, d):
    out = R.overlay_sections(V.items(s, d), FIRST, LAST)
    images = F.transform("images", lambda i: F.concat_ws("|", i["date"], i["name"], F.floor(i["confidence"] * 100 + 0.5).cast("string"), i["x1"].cast("string")))
    return out.select("technician_id", "customer_id", F.array_join(images, ",").alias("images"))


@query
def overlay_box_parse(s, d):
    b = V.items(s, d).select("id", F.explode(M.boxes(F.col("ai_metadata_json"), "datetime")).alias("b"))
    return b.select("id", "b.x1", "b.y1", "b.x2", "b.y2", F.col("b.confidence").alias("confidence"))


@query
def overlay_scan_counts(s, d):
    j = F.col("ai_metadata_json")
    return V.items(s, d).agg(F.count_if(M.scanned(j)).alias("scanned"), F.count_if(F.size(M.boxes(j, "datetime")) > 0).alias("with_box"), F.count_if(j.like("%model%")).alias("with_model"), F.count("*").alias("n"))


@query
def archive_catalogue(s, d):
    return R.archive_catalogue(V.items(s, d)).select("source_archive_date", "image_count", text("categories").alias("categories"))


@query
def archive_status(s, d):
    items = V.items(s, d)
    files = items.groupBy("source_archive_date").agg(F.count("*").alias("image_count"))
    return R.archive_status(files, items.where("id NOT LIKE '%3'"))


@query
def job_progress(s, d):
    rows = V.items(s, d).withColumn("job", F.substring("id", 1, 6))
    jobs = rows.groupBy("job").agg(F.count("*").alias("total"), F.count_if(F.col("analysis_status") == "COMPLETED").alias("completed"), F.count_if(F.col("image_quality_status").isNotNull()).alias("processed"))
    return jobs.select("job", "total", R.progress(F.col("total"), F.col("processed"), F.col("completed")).alias("shown"))


@query
def active_job(s, d):
    state = F.element_at(F.create_map(*[F.lit(x) for kv in (("click", "QUEUED"), ("error", "FAILED"), ("purchase", "COMPLETED"), ("signup", "INTERRUPTED"), ("view", "EMBEDDING")) for x in kv]), F.col("event_type"))
    jobs = V.table(s, d, "events").select("event_id", "ts", "user_id", state.alias("status"))
    latest = jobs.where(~F.col("status").isin(*R.ACTIVE_DONE)).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("m"))
    pending = jobs.groupBy("user_id").agg(F.count_if(~F.col("status").isin(*R.PENDING_DONE)).alias("pending"))
    return pending.join(latest, "user_id", "left").select("user_id", "pending", F.col("m.event_id").alias("active_job"), F.col("m.status").alias("status"))


@query
def latest_job_unrelated_pairs(s, d):
    items = V.items(s, d)
    started = items.agg(F.date_sub(F.max("created_at"), 400).alias("started"))
    recent = items.crossJoin(F.broadcast(started)).where("created_at >= started").select("id", "original_filename")
    a, b = recent.select(F.col("id").alias("image_a_id"), F.col("original_filename").alias("name_a")), recent.select(F.col("id").alias("image_b_id"), F.col("original_filename").alias("name_b"))
    return V.pairs(s, d).where("relationship_level = 'unrelated'").join(a, "image_a_id").join(b, "image_b_id").select("image_a_id", "image_b_id", "name_a", "name_b")


@query
def filename_token_counts(s, d):
    number = M.blank_to_null(F.regexp_extract("original_filename", r"home_(\d{10})", 1))
    return V.items(s, d).select(number.alias("number")).where("number IS NOT NULL").groupBy("number").agg(F.count("*").alias("n"))


@query
def prefix_counts(s, d):
    return V.items(s, d).groupBy(F.substring_index("original_filename", "_", 1).alias("prefix")).agg(F.count("*").alias("n"), F.count_distinct(F.regexp_extract("original_filename", r"home_(\d{10})", 1)).alias("numbers"))


@query
def pair_upsert(s, d):
    pr = V.pairs(s, d)
    new = pr.where("relationship_score >= 0.9").withColumn("relationship_score", F.lit(0.25))
    return L.upsert(pr.where("relationship_score < 0.95"), new, ["image_a_id", "image_b_id"]).groupBy("relationship_level").agg(F.count("*").alias("n"), F.count_if(F.col("relationship_score") == 0.25).alias("renewed"))


@query
def pair_reconcile_delete(s, d):
    return L.usable_pairs(V.pairs(s, d), V.items(s, d)).select("image_a_id", "image_b_id")


@query
def legacy_backfill(s, d):
    return L.backfilled(V.items(s, d)).select("id", "source_job_number", "source_checkin_date", "source_technician_id", "source_job_type")


@query
def archive_import_plan(s, d):
    items = V.items(s, d).withColumn("path", F.concat_ws("/", "source_archive_date", "original_filename"))
    return L.import_plan(items.select("path"), items.where("id NOT LIKE '%3'").select("path", "analysis_status"))


@query
def report_snapshot_rows(s, d):
    return L.report_snapshot(_groups(s, d), V.items(s, d), "r1")


@query
def cascade_delete_pairs(s, d):
    gone = V.items(s, d).where("analysis_status = 'UNVERIFIABLE'").select("id")
    return L.cascade_delete(V.pairs(s, d), gone, "image_a_id", "image_b_id").select("image_a_id", "image_b_id")
