"""Column expressions for filenames, dates, detection metadata and fallback chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the filename tokens, the scanner's tag and the types by suffix
REFERENCE = r"(?i)(?:^|_)(?:home|splitter)_(\d{10})(?:_([^_.]+))?(?=$|[_.])"
JOB = r"(?i)(?:^|_)(new|ma-mat|ma-new|ma-splice)_(\d{8}|null)(?:_|$)"
SCANNER = "lat-long/v1"
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp"}
BOXES = "struct<model:string,metadata_version:double,error:string,datetime:array<struct<bbox:array<double>,confidence:double>>,lat_long:array<struct<bbox:array<double>,confidence:double>>>"


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _found(name: Column, pattern: str, group: int) -> Column:
    return blank_to_null(F.regexp_extract(basename(name), pattern, group))


def customer(name: Column) -> Column:
    return _found(name, REFERENCE, 1)


def technician(name: Column) -> Column:
    return _found(name, REFERENCE, 2)


def checkin_date(name: Column) -> Column:
    """The date token; only of names with a customer token."""
    return F.when(customer(name).isNotNull(), F.nullif(F.lower(_found(name, JOB, 2)), F.lit("null")))


def job_type(name: Column) -> Column:
    return F.lower(_found(name, JOB, 1))


def resolved(item: str = "") -> dict[str, Column]:
    """customer_id, checkin_date, technician_id and job_type: the stored value unless null or empty, else the parsed one."""
    c = lambda x: F.col(f"{item}{x}")
    name = c("original_filename")
    return {
        "customer_id": F.coalesce(blank_to_null(c("source_job_number")), customer(name)),
        "checkin_date": F.coalesce(blank_to_null(c("source_checkin_date")), checkin_date(name)),
        "technician_id": F.coalesce(blank_to_null(c("source_technician_id")), technician(name)),
        "job_type": F.coalesce(blank_to_null(c("source_job_type")), F.when(customer(name).isNotNull(), job_type(name)), job_type(name)),
    }


def usable(status: Column) -> Column:
    """Null counts as usable."""
    return ~status.eqNullSafe(F.lit("UNVERIFIABLE"))


def in_range(date: Column, first: str | None, last: str | None) -> Column:
    """Bounds are inclusive and compared as text; undated rows pass only without any bound."""
    ok = F.lit(True)
    if first is not None:
        ok = ok & (date >= first)
    if last is not None:
        ok = ok & (date <= last)
    return F.when(date.isNull(), F.lit(first is None and last is None)).otherwise(ok)


def not_after(date: Column, cutoff: str | None) -> Column:
    """As-of rule: undated rows stay."""
    return F.lit(True) if cutoff is None else date.isNull() | (date <= cutoff)


def boxes(json: Column, key: str) -> Column:
    """Valid boxes (x1, y1, x2, y2, confidence), corners rounded half to even; malformed metadata has none."""
    parsed = F.from_json(json, BOXES)[key]
    whole = F.transform(
        F.filter(parsed, lambda d: (F.size(d["bbox"]) == 4) & d["confidence"].isNotNull() & ~F.exists(d["bbox"], lambda v: v.isNull())),
        lambda d: F.struct(*[F.bround(d["bbox"][i], 0).cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], d["confidence"].alias("confidence")),
    )
    return F.coalesce(F.filter(whole, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])), F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int,confidence:double>>"))


def scanned(json: Column) -> Column:
    m = F.from_json(json, BOXES)
    return F.coalesce((m["model"] == SCANNER) & (m["metadata_version"] >= 2) & m["datetime"].isNotNull() & m["lat_long"].isNotNull() & m["error"].isNull(), F.lit(False))


def suffix_type(name: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in IMAGE_TYPES.items() for x in kv])
    return F.element_at(kinds, F.lower(F.substring_index(name, ".", -1)))


def day_month_year(compact: Column, sep: str = "/") -> Column:
    """DD/MM/YYYY of an 8-digit date, other values as they are."""
    plain = F.regexp_replace(compact, "-", "")
    return F.when(F.length(plain) == 8, F.concat_ws(sep, F.substring(plain, 7, 2), F.substring(plain, 5, 2), F.substring(plain, 1, 4))).otherwise(compact)


def bangkok(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Bangkok"), ts.cast("timestamp_ntz"))


def same_submission(a: str, b: str) -> Column:
    """Customer and date known and equal on both sides; never null."""
    return F.coalesce((F.col(f"{a}.customer_id") == F.col(f"{b}.customer_id")) & (F.col(f"{a}.checkin_date") == F.col(f"{b}.checkin_date")), F.lit(False))


def rotation_map(rotations_json: Column, phash: Column) -> Column:
    """angle -> hash: the JSON map if it has all four angles, else the plain hash at 0, else empty."""
    m = F.from_json(rotations_json, "map<string,string>")
    complete = F.coalesce(F.size(F.array_intersect(F.map_keys(m), F.array(*map(F.lit, ("0", "90", "180", "270"))))) == 4, F.lit(False))
    return F.when(complete, m).when(blank_to_null(phash).isNotNull(), F.create_map(F.lit("0"), phash)).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))


def needs_scan(json: Column) -> Column:
    """Rows to be scanned anew: without metadata, with an error, or without the list of places."""
    return json.isNull() | json.like('%"error"%') | ~json.like('%"lat_long"%')


def exif_time(original: Column, plain: Column) -> Column:
    """Text of the time in the original tag, or if that is null or empty in the plain one; null unless it is a real time in EXIF's form."""
    value = F.coalesce(blank_to_null(original), plain)
    known = F.when(value.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(value, F.lit("yyyy:MM:dd HH:mm:ss")))
    return F.date_format(known, "yyyy-MM-dd HH:mm:ss")


def capture_time(stored: Column, exif: Column, date: Column) -> Column:
    """What is shown as time of capture: the stored one, the file's own, or the day of check-in, as it is if it is no 8-digit date."""
    day = F.when(date.rlike(r"^\d{8}$"), day_month_year(date)).otherwise(date)
    return F.coalesce(blank_to_null(stored), blank_to_null(exif), day)


def any_time(text: Column) -> Column:
    """The first 19 characters as a time in one of three forms, else null."""
    head = F.substring(text, 1, 19)
    return F.coalesce(*[F.try_to_timestamp(head, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")])


def seconds(first: Column, last: Column) -> Column:
    """Whole seconds from one time to the other."""
    return F.timestamp_diff("SECOND", first.cast("timestamp"), last.cast("timestamp"))


def label(name: Column) -> Column:
    """A class name without case, spaces, hyphens and underscores."""
    return F.translate(F.lower(name), "_- ", "")


def shortened(text: Column, most: int) -> Column:
    """``most`` characters and an ellipsis of texts that are longer than both."""
    return F.when(F.length(text) > most + 3, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
