"""Evidence flags, score, class, verdict and reasons of a compared pair, as ordered rules over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.config import Rules

REUSED = ("exact_file", "same_image", "edited_or_cropped")
REVIEW = ("background_replaced", "repeated_checkin", "same_scene_new_capture")


def cascade(rules: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first rule that holds; a null condition does not hold."""
    out = reduce(lambda w, r: F.when(*r) if w is None else w.when(*r), rules, None)
    return out.otherwise(otherwise)


def _least(name: str, *limits) -> Column:
    """inliers, ratio and coverage of a region reach the limits."""
    ok = (F.col(f"{name}_inliers") >= limits[0]) & (F.col(f"{name}_ratio" if name != "ransac" else "ransac_inlier_ratio") >= limits[1])
    return ok & (F.col(f"{name}_coverage") >= limits[2]) if len(limits) == 3 else ok


def true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def body_gates(df: DataFrame, r: Rules = Rules()) -> DataFrame:
    """identity_inliers, reuse_inliers, body_reuse_gate, body_reuse_suspected and similar_person_only from counts by label."""
    n = lambda label: F.coalesce(F.element_at("body_part_inliers", F.lit(label)), F.lit(0))
    total = lambda labels: reduce(lambda a, b: a + b, [n(x) for x in labels])
    classes = reduce(lambda a, b: a + b, [(n(x) > 0).cast("int") for x in r.reuse_parts])
    df = df.withColumn("identity_inliers", total(r.identity_parts)).withColumn("reuse_inliers", total(r.reuse_parts))
    gate = (classes >= r.min_reuse_classes) & (F.col("reuse_inliers") >= r.min_reuse_inliers) & (total(r.major_parts) >= r.min_major_inliers)
    df = df.withColumn("body_reuse_gate", gate)
    strongest = F.greatest(*[n(x) for x in r.reuse_parts])
    df = df.withColumn("body_reuse_suspected", ~F.col("body_reuse_gate") & (strongest >= r.single_part_inliers))
    return df.withColumn("similar_person_only", (F.col("identity_inliers") >= r.identity_inliers) & ~F.col("body_reuse_gate") & ~F.col("body_reuse_suspected"))


def flags(df: DataFrame, r: Rules = Rules()) -> DataFrame:
    """The suspicion flags; ``df`` has the evidence columns and the body gates."""
    original, sim = F.col("detected_transform") == "original", F.col("embedding_similarity")
    gate, part = F.col("body_reuse_gate"), F.col("body_reuse_gate") | F.col("body_reuse_suspected")
    fore, back = F.col("heatmap_foreground_change"), F.col("heatmap_background_change")
    df = df.withColumn("heatmap_scene_change_support", true(_least("foreground", r.min_inliers, r.min_inlier_ratio) & (fore <= r.heatmap_foreground) & (back >= r.heatmap_background) & (back - fore >= r.heatmap_gap) & (sim >= r.background_cosine) & part))
    df = df.withColumn("foreground_verified", true(gate & _least("foreground", r.min_reuse_inliers, r.min_inlier_ratio)))
    df = df.withColumn("background_verified", true(_least("background", r.partial_inliers, r.partial_ratio, r.background_coverage)))
    df = df.withColumn("foreground_source_reuse", true(_least("foreground", r.source_inliers, r.source_ratio, r.source_coverage)))
    df = df.withColumn("same_location_suspected", original & F.col("background_verified"))
    repeated = original & F.col("background_verified") & _least("foreground", r.repeated_inliers, r.repeated_ratio, r.repeated_coverage) & (F.col("identity_inliers") >= r.repeated_identity) & (F.col("reuse_inliers") >= r.repeated_reuse)
    df = df.withColumn("repeated_checkin_suspected", true(repeated))
    support = F.col("foreground_verified") | F.col("foreground_source_reuse") | F.col("heatmap_scene_change_support")
    df = df.withColumn("scene_change_suspected", true(original & support & ~F.col("background_verified") & (F.col("phash_normal_distance") > r.max_hamming)))
    df = df.withColumn("recapture_suspected", true(original & (F.col("phash_normal_distance") > r.same_image_phash) & _least("ransac", r.recapture_inliers, r.recapture_ratio, r.recapture_coverage) & (sim >= r.recapture_cosine)))
    poor = F.least("blur_variance_a", "blur_variance_b") < r.blur_variance
    like = F.coalesce(sim >= r.blurred_cosine, F.lit(False))
    df = df.withColumn("whole_image_fallback_used", true(~gate & poor & _least("ransac", r.whole_inliers, r.whole_ratio, r.whole_coverage) & (like | (F.col("ransac_inlier_ratio") >= r.whole_strong_ratio))))
    near = part | (F.col("phash_normal_distance") <= r.blurred_phash)
    crop = _least("ransac", r.blurred_inliers, r.blurred_ratio) & like & near
    return df.withColumn("blurred_crop_suspected", true(original & poor & (F.col("whole_image_fallback_used") | crop)))


def signals(r: Rules = Rules()) -> list[tuple[Column, float]]:
    """Each signal's value, null where it is missing, with its weight."""
    good, ref = F.col("sift_good_matches"), F.col("sift_reference_features")
    return [
        (F.when(F.col("phash_distance").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("phash_distance") / F.greatest(F.lit(1), "phash_max_distance"))), r.weights.phash),
        (F.when(F.col("embedding_similarity").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "embedding_similarity"))), r.weights.embedding),
        (F.when(ref > 0, F.least(F.lit(1.0), good / F.greatest(F.lit(12.0), ref * F.lit(0.15)))), r.weights.sift),
        (F.when(good > 0, F.when(F.col("ransac_inliers") >= 4, F.col("ransac_inlier_ratio")).otherwise(F.lit(0.0))), r.weights.ransac),
    ]


def weighted(r: Rules = Rules()) -> Column:
    """Weighted mean of the signals that are present; 0 without any."""
    top = reduce(lambda a, b: a + b, [F.coalesce(v * F.lit(w), F.lit(0.0)) for v, w in signals(r)])
    bottom = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in signals(r)])
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def floored(score: Column) -> Column:
    """The score after the first floor or cap whose flag is set."""
    at_least = lambda x: F.greatest(score, F.lit(x))
    return cascade(
        [
            (F.col("scene_change_suspected"), F.greatest(score, F.when(F.col("heatmap_scene_change_support"), F.lit(0.76)).otherwise(F.lit(0.72)))),
            (F.col("repeated_checkin_suspected"), at_least(0.68)),
            (F.col("recapture_suspected"), at_least(0.80)),
            (F.col("blurred_crop_suspected"), at_least(0.70)),
            (F.col("same_location_suspected"), at_least(0.67)),
            (F.col("similar_person_only"), F.least(score, F.lit(0.64))),
        ],
        score,
    )


def band(score: Column, r: Rules = Rules()) -> Column:
    return cascade([(score >= r.very_high, "VERY_HIGH_RELATION"), (score >= r.high, "HIGH_RELATION"), (score >= r.possible, "POSSIBLY_RELATED"), (score >= r.low, "LOW_RELATION")], "UNRELATED")


def classified(score: Column, r: Rules = Rules()) -> Column:
    strong = _least("ransac", r.partial_inliers, r.partial_ratio)
    same = (F.col("detected_transform") == "original") & (F.col("phash_distance") <= r.same_image_phash) & (F.col("ransac_inlier_ratio") >= r.same_image_ratio)
    return cascade(
        [
            ((F.col("flip_detected") | (F.col("rotation_degrees") != 0)) & (score >= r.possible), "edited_or_cropped"),
            (same, "same_image"),
            (F.col("recapture_suspected") | F.col("blurred_crop_suspected"), "edited_or_cropped"),
            (F.col("scene_change_suspected"), "background_replaced"),
            (F.col("repeated_checkin_suspected"), "repeated_checkin"),
            (F.col("body_reuse_gate") & strong, "edited_or_cropped"),
            (F.col("same_location_suspected"), "same_scene_new_capture"),
            (F.col("similar_person_only"), "similar_person"),
            (strong, "same_scene_new_capture"),
        ],
        "unrelated",
    )


def verdict(classification: Column) -> Column:
    return cascade([(classification.isin(*REUSED), "reused"), (classification.isin(*REVIEW), "review")], "not_reused")


def rounded(score: Column) -> Column:
    return F.floor(score * 10000 + F.lit(0.5)) / 10000


def reasons() -> Column:
    """Codes of the reasons in their order."""
    (phash, _), (embedding, _), _, _ = signals()
    say = lambda c, text: F.when(c, F.lit(text) if isinstance(text, str) else text)
    branch = cascade(
        [(F.col("scene_change_suspected"), "partial_reuse"), (F.col("repeated_checkin_suspected"), "repeated_checkin"), (F.col("recapture_suspected"), "recapture"), (F.col("blurred_crop_suspected") & F.col("whole_image_fallback_used"), "blurred_whole"), (F.col("blurred_crop_suspected"), "blurred_crop"), (F.col("same_location_suspected"), "same_location")],
        None,
    )
    parts = cascade([(F.col("body_reuse_gate"), "body_reuse"), (F.col("foreground_source_reuse"), "source_reuse"), (F.col("body_reuse_suspected"), "body_suspected"), (F.col("similar_person_only"), "similar_person")], None)
    listed = F.array_compact(
        F.array(
            say(phash >= 0.80, F.concat(F.lit("phash:"), F.col("phash_distance").cast("string"))),
            say(embedding >= 0.80, "embedding"),
            say((F.col("sift_reference_features") > 0) & (F.col("sift_good_matches") >= 12), F.concat(F.lit("sift:"), F.col("sift_good_matches").cast("string"))),
            say((F.col("sift_good_matches") > 0) & (F.col("ransac_inliers") >= 8), F.concat(F.lit("ransac:"), F.col("ransac_inliers").cast("string"))),
            say(F.col("flip_detected"), "mirror"),
            say(F.col("rotation_degrees") != 0, F.concat(F.lit("rotation:"), F.col("rotation_degrees").cast("string"))),
            parts,
            say(F.col("heatmap_scene_change_support"), "background_changed"),
            branch,
        )
    )
    return F.when(F.col("exact_duplicate"), F.array(F.lit("identical"))).when(F.size(listed) == 0, F.array(F.lit("none"))).otherwise(listed)


def score(df: DataFrame, r: Rules = Rules()) -> DataFrame:
    """``df`` (evidence with gates and flags) with relationship_score, decision, classification, reuse_verdict and reasons.

    Exact duplicates score 1 whatever else is known. Bands and classes are taken from the score before it is rounded.
    """
    exact = F.col("exact_duplicate")
    df = df.withColumn("raw_score", weighted(r)).withColumn("final_score", floored(F.col("raw_score")))
    final = F.col("final_score")
    df = df.withColumn("relationship_score", F.when(exact, F.lit(1.0)).otherwise(rounded(final)))
    df = df.withColumn("decision", F.when(exact, "EXACT_DUPLICATE").otherwise(band(final, r)))
    df = df.withColumn("classification", F.when(exact, "exact_file").otherwise(classified(final, r)))
    return df.withColumn("reuse_verdict", verdict(F.col("classification"))).withColumn("reasons", reasons())


def transform_choice(normal_passes: Column, alternative_passes: Column, r: Rules = Rules()) -> Column:
    """Whether the best alternative transform is taken, from distances, geometry and ratios of both (alt_*)."""
    hinted = (F.col("alt_distance") <= r.max_hamming) & (F.col("alt_distance") + 3 <= F.col("phash_normal_distance"))
    tried = hinted | ~normal_passes
    improves = ~normal_passes | (F.col("alt_ratio") >= F.col("ransac_inlier_ratio") + F.lit(0.10))
    return tried & alternative_passes & (hinted | improves)


#: Columns that a stored pair keeps beside its details.
FLAT = ("phash_distance", "dino_similarity", "sift_matches", "ransac_inliers", "ransac_inlier_ratio", "flip_detected", "relationship_score", "relationship_level")


def flat(df: DataFrame, *candidate: str) -> DataFrame:
    """Scored evidence with the stored columns and details_json, which holds them and the ``candidate`` columns that are not null."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    values = {"dino_similarity": F.col("embedding_similarity"), "sift_matches": count("sift_good_matches"), "ransac_inliers": count("ransac_inliers"), "ransac_inlier_ratio": F.coalesce("ransac_inlier_ratio", F.lit(0.0)), "flip_detected": F.coalesce(F.col("flip_detected").cast("int"), F.lit(0)), "relationship_level": F.col("classification")}
    rows = df.withColumns(values)
    return rows.withColumn("details_json", F.to_json(F.struct(*FLAT, "decision", "reuse_verdict", *candidate)))


def plain_reasons(most: int = 4) -> Column:
    """Codes of what a reader is told first, ``most`` of them in their order."""
    say = lambda c, text: F.when(F.coalesce(c, F.lit(False)), text if isinstance(text, Column) else F.lit(text))
    sim, points, turn = F.col("embedding_similarity"), F.col("ransac_inliers"), F.col("rotation_degrees")
    listed = F.array_compact(
        F.array(
            say(F.col("exact_duplicate"), "identical"),
            say(F.col("flip_detected"), "mirror"),
            say(turn != 0, F.concat(F.lit("rotation:"), turn.cast("string"))),
            say(F.col("recapture_suspected"), "recapture"),
            say(F.col("blurred_crop_suspected"), "blurred_crop"),
            say(F.col("whole_image_fallback_used"), "whole_image"),
            cascade([(F.col("body_reuse_gate"), "body_reuse"), (F.col("body_reuse_suspected"), "body_suspected")], None),
            F.concat(F.lit("alike:"), F.floor(sim * 100 + F.lit(0.5)).cast("string"), F.lit("%")),
            F.concat(F.lit("points:"), points.cast("string")),
        )
    )
    return F.when(F.size(listed) == 0, F.array(F.lit("none"))).otherwise(F.slice(listed, 1, most))


def label_counts(matches: DataFrame, key: str) -> DataFrame:
    """(``key``, counts): of each pair the inliers (label, inlier) by label, as a map; labels without one are left out."""
    n = matches.where("inlier AND label IS NOT NULL").groupBy(key, "label").agg(F.count("*").cast("int").alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"))


def best_alternative(distances: dict[str, Column]) -> Column:
    """distance, place and name of the transform that is closest; of equal ones the first named."""
    return F.least(*[F.struct(d.cast("int").alias("distance"), F.lit(i).alias("place"), F.lit(n).alias("name")) for i, (n, d) in enumerate(distances.items())])


def chosen_transform(r: Rules = Rules()) -> Column:
    """The name of the best alternative (alt, alt_distance, alt_inliers, alt_ratio) where it is taken, else original."""
    passes = lambda n, ratio: (F.col(n) >= r.min_inliers) & (F.col(ratio) >= r.min_inlier_ratio)
    taken = transform_choice(passes("ransac_inliers", "ransac_inlier_ratio"), passes("alt_inliers", "alt_ratio"), r)
    return F.when(taken, F.col("alt.name")).otherwise(F.lit("original"))
