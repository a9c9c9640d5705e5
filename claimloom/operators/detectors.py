"""AI-content detectors on a branch of their own: profiles, gates, outcomes and signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AI_AT, HUMAN_AT = 0.75, 0.25
MIN_CHARS, LANGUAGES, MIN_PIXELS = 120, ["en"], 64
OFF, FIXTURE = ("", "none", "off", "disabled"), ("fixture", "demo", "demo_fixture")
#: Codes under which nothing was sent to a detector because of the material itself (fixed values).
UNSUPPORTED = ["TEXT_TOO_SHORT", "TEXT_TOO_LONG", "LANGUAGE_NOT_SUPPORTED", "IMAGE_TOO_SMALL", "IMAGE_TOO_LARGE"]
UNAVAILABLE = ["PROVIDER_UNCONFIGURED", "UPLOAD_STYLE_UNSUPPORTED"]


def normalize_score(raw: Column, low: Column, high: Column, higher_means_ai: Column) -> Column:
    """The score on [0, 1], higher meaning more likely made by AI; null where it isn't finite or leaves its scale."""
    ok = raw.isNotNull() & ~F.isnan(raw) & (raw >= low) & (raw <= high) & (high > low)
    share = (raw - low) / (high - low)
    return F.when(ok, F.when(higher_means_ai, share).otherwise(1 - share))


def assessment(status: Column, score: Column) -> Column:
    """What a detector's result amounts to; only an `ok` status ever accuses."""
    banded = F.when(score.isNull(), "uncertain").when(score >= AI_AT, "likely_ai_generated").when(score <= HUMAN_AT, "likely_human_or_camera").otherwise("uncertain")
    return F.when(status == "inconclusive", "uncertain").when(status == "ok", banded).otherwise("not_assessed")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def _unit_score(payload: Column, salt: str) -> Column:
    """The first four bytes of a salted SHA-256 as a number in [0, 1]."""
    return F.round(F.conv(F.substring(F.sha2(F.concat(F.lit(salt), payload), 256), 1, 8), 16, 10).cast("long") / 4294967295.0, 6)


def gate_text(text: Column, language: Column, profile: dict, configured: bool = True) -> Column:
    """Why a text is not sent to the detector of `profile`, null if it is (J10): credentials, length, language, in this order."""
    n = F.char_length(_trimmed(text))
    code = F.when(F.lit(not configured), "PROVIDER_UNCONFIGURED")
    if profile.get("min_characters"):
        code = code.when(n < profile["min_characters"], "TEXT_TOO_SHORT")
    if profile.get("max_characters"):
        code = code.when(n > profile["max_characters"], "TEXT_TOO_LONG")
    if profile.get("languages"):
        known = sorted({x.split("-")[0].lower() for x in profile["languages"]})
        said = F.lower(F.split(F.when(language != "", language).otherwise("und"), "[-_]")[0])
        code = code.when(~F.coalesce(said, F.lit("und")).isin(known), "LANGUAGE_NOT_SUPPORTED")
    return code


def gate_image(width: Column, height: Column, n_bytes: Column, profile: dict, configured: bool = True) -> Column:
    """Why an image is not sent (J11): credentials, size in pixels, size in bytes, way of upload; images are never published."""
    code = F.when(F.lit(not configured), "PROVIDER_UNCONFIGURED")
    if profile.get("min_pixels"):
        code = code.when((F.coalesce(width, F.lit(0)) < profile["min_pixels"]) | (F.coalesce(height, F.lit(0)) < profile["min_pixels"]), "IMAGE_TOO_SMALL")
    if profile.get("max_bytes"):
        code = code.when(n_bytes > profile["max_bytes"], "IMAGE_TOO_LARGE")
    return code.when(F.lit(profile.get("upload_style", "multipart") not in ("multipart", "base64_json")), "UPLOAD_STYLE_UNSUPPORTED")


def gate_status(code: Column) -> Column:
    """The status that goes with an error code: ok for none, failed for codes of the detector's own."""
    return F.when(code.isNull(), "ok").when(code.isin(UNSUPPORTED), "unsupported").when(code.isin(UNAVAILABLE), "unavailable").otherwise("failed")


def _with_outcome(df: DataFrame, code: Column, score: Column) -> DataFrame:
    df = df.withColumn("error_code", code)
    df = df.withColumn("status", gate_status(F.col("error_code"))).withColumn("ai_score", F.when(F.col("error_code").isNull(), score))
    return df.withColumn("assessment", assessment(F.col("status"), F.col("ai_score")))


def fixture_text_signals(df: DataFrame, text: str, language: Column, salt: str, profile: dict | None = None) -> DataFrame:
    """Adds `status, error_code, ai_score, assessment` of the deterministic text detector.

    The text is trimmed; texts its profile gates out are unsupported; otherwise
    the score comes from a salted SHA-256.
    """
    gate = gate_text(F.col(text), language, profile or {"min_characters": MIN_CHARS, "languages": LANGUAGES})
    return _with_outcome(df, gate, _unit_score(_trimmed(F.col(text)), salt))


def fixture_image_signals(df: DataFrame, data: str, width: str, height: str, salt: str, min_pixels: int = MIN_PIXELS) -> DataFrame:
    """Adds the outcome columns of the deterministic image detector (J5): too small, unreadable if empty, else a hash score."""
    small = gate_image(F.col(width), F.col(height), F.lit(0), {"min_pixels": min_pixels})
    code = F.coalesce(small, F.when(F.coalesce(F.octet_length(data), F.lit(0)) == 0, "IMAGE_UNREADABLE"))
    return _with_outcome(df, code, _unit_score(F.col(data), salt))


def build_signals(df: DataFrame, run_hex: Column, sequence: Column, provider: str, kind: Column, asset_id: Column, text_sha256: Column, scale: tuple[float, float, bool] | None, limitations: list[str], version: str) -> DataFrame:
    """Adds the struct `signal` to rows with `status, error_code, raw_score` (J3), null where its target is wrong.

    An image has an asset and no text hash, a text the reverse.  A score is only
    given on a known scale and for an `ok` status; what is not assessed has none.
    Caveats are named once each, in their order.
    """
    image = kind == "image"
    sound = F.when(image, asset_id.isNotNull() & text_sha256.isNull()).when(kind.isin("claim_text", "ocr_text"), text_sha256.isNotNull() & asset_id.isNull()).otherwise(False)
    raw = F.col("raw_score")
    if scale is None:
        score, notes = F.lit(None).cast("double"), F.when((F.col("status") == "ok") & raw.isNotNull(), F.array(F.lit("scale unknown, score not rescaled")))
        told = F.lit(None).cast("struct<min:double,max:double,higher_means_ai:boolean>")
    else:
        low, high, up = map(F.lit, scale)
        score = F.when(F.col("status") == "ok", F.round(normalize_score(raw, low.cast("double"), high.cast("double"), up), 6))
        notes = F.when(score.isNotNull(), F.array(F.lit("rescaled, not a calibrated probability")))
        told = F.struct(low.cast("double").alias("min"), high.cast("double").alias("max"), up.alias("higher_means_ai"))
    verdict = assessment(F.col("status"), score)
    signal = F.struct(
        F.concat(F.lit("fs_"), run_hex, F.format_string("_%06d", sequence.cast("int"))).alias("signal_id"), F.struct(kind.alias("kind"), asset_id.alias("asset_id"), text_sha256.alias("text_sha256")).alias("target"),
        F.when(image, "image").otherwise("text").alias("modality"), F.lit(provider).alias("provider"), F.lit(version).alias("model_version"), F.lit("ai_generation_detection").alias("task"), F.col("status"),
        raw.alias("raw_score"), told.alias("raw_scale"), F.when(verdict != "not_assessed", score).alias("ai_generated_score"), F.lit(None).cast("string").alias("raw_label"), verdict.alias("assessment"),
        F.lit("not_applicable").alias("calibration_status"), F.lit(None).cast("string").alias("applicable_language"),
        stable_distinct(F.concat(F.array(*map(F.lit, limitations)), F.coalesce(notes, F.array().cast("array<string>")))).alias("limitations"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("analyzed_at"), F.col("error_code"),
    )
    return df.withColumn("signal", F.when(sound, signal))


def stable_distinct(values: Column) -> Column:
    """A list without repeats, first places kept."""
    return F.array_distinct(values)


def parse_profile(name: str, table: dict) -> dict:
    """A detector profile with its defaults (J8); a missing key, or a scale without range and direction, is an error."""
    missing = [k for k in ("modality", "endpoint", "score_path", "scale") if k not in table]
    missing += [f"scale.{k}" for k in ("min", "max", "higher_means_ai") if isinstance(table.get("scale"), dict) and k not in table["scale"]]
    if missing:
        raise ValueError(f"profile {name!r} lacks {', '.join(missing)}")
    plain = {"method": "POST", "upload_style": "multipart", "payload_field": "media", "timeout_seconds": 45.0, "languages": [], "required_config": [], "limitations": [], "calibration_status": "unknown", "verified": False}
    return plain | table | {"name": name}


def registered(modality: str, name: str | None, mode: str, profiles: dict[str, dict], credentials: dict[str, str]) -> dict[str, str]:
    """`provider, capability, status, message` of a chosen detector.

    None chosen is disabled; the fixture is for demo runs only; an unknown name,
    a bad profile and missing credentials are unconfigured, never replaced.
    """
    name = (name or "").strip().lower()
    row = lambda provider, status, message: {"provider": provider, "capability": f"{modality}_ai_detection", "status": status, "message": message}
    if name in OFF:
        return row(f"{modality}_detector_disabled", "disabled", "not chosen")
    if name in FIXTURE:
        return row(f"demo_fixture_{modality}", "ok" if mode == "demo" else "unconfigured", "deterministic fixture" if mode == "demo" else "the fixture is for demo runs only")
    table = profiles.get(f"{modality}:{name}")
    if table is None:
        return row(name, "unconfigured", "no such profile")
    try:
        profile = parse_profile(name, table)
    except ValueError as e:
        return row(name, "unconfigured", str(e))
    lacking = [k for k in profile["required_config"] if not credentials.get(k)]
    return row(name, "unconfigured", "lacks " + ", ".join(lacking)) if lacking else row(name, "ok", "configured" if profile["verified"] else "configured, answers not verified")


def capability_report(spark: SparkSession, image: str | None, text: str | None, mode: str, profiles: dict[str, dict], credentials: dict[str, str]) -> DataFrame:
    """One row for each modality."""
    rows = [registered(m, n, mode, profiles, credentials) for m, n in (("image", image), ("text", text))]
    return spark.createDataFrame([tuple(r.values()) for r in rows], "provider string, capability string, status string, message string")


def isolated(spark: SparkSession, component: str, make: Callable[[], DataFrame], materialize: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """`(signals, warnings)` of a detector branch (J14): one that fails gives a warning and nothing else, other branches run on."""
    schema = "code string, message string, component string"
    try:
        return materialize(make(), component), spark.createDataFrame([], schema)
    except Exception as e:  # noqa: BLE001
        code = f"{component.rsplit('.', 1)[-1].upper()}_DETECTOR_FAILED"
        return None, spark.createDataFrame([(code, str(e)[:500], component)], schema)


def http_outcome(code: Column, body: Column) -> Column:
    """The error code of a detector's HTTP answer, null for success.

    What never answered has a negative code: -1 timed
    out, -2 unreachable, -3 an answer over the size cap.
    """
    b = F.lower(F.coalesce(body, F.lit("")))
    quota = (code == 402) | (~code.between(200, 299) & (b.contains("quota") | b.contains("insufficient")))
    return (
        F.when(code.between(200, 299), F.lit(None).cast("string")).when(code == -1, "TIMEOUT").when(code == -2, "UNREACHABLE").when(code == -3, "RESPONSE_TOO_LARGE")
        .when(code.isin(401, 403), "AUTH_FAILED").when(quota, "QUOTA_EXCEEDED").when(code == 429, "RATE_LIMITED")
        .when(code.isin(400, 413, 415, 422), "INPUT_REJECTED").when(code >= 500, "PROVIDER_ERROR").otherwise("UNEXPECTED_STATUS")
    )


def retry_seconds(code: Column, retry_after: Column) -> Column:
    """How long to wait before the next call, where an answer says so."""
    return F.when(code == 429, F.trim(retry_after).try_cast("int"))


def select_path(v: Column, path: str) -> Column:
    """The part of a variant at a dotted path (B19): keys, and indexes that count from the end where negative; null if missing."""
    for part in path.split("."):
        if part.lstrip("-").isdigit():
            items = F.try_variant_get(v, "$", "array<variant>")
            at = int(part)
            own = F.try_element_at(items, F.lit(at + 1 if at >= 0 else at))
            v = F.when(items.isNotNull(), own).otherwise(F.try_variant_get(v, f"$['{part}']", "variant"))
        else:
            v = F.try_variant_get(v, f"$['{part}']", "variant")
    return v


def response_score(payload: Column, path: str) -> tuple[Column, Column]:
    """`(score, error_code)` at a dotted path of a JSON answer."""
    v = F.try_parse_json(payload)
    found = select_path(v, path)
    # Several casts are tried in the JVM; a text that looks like a number is none.
    kind = F.schema_of_variant(found)
    number = F.try_variant_get(found, "$", "double")
    code = F.when(v.isNull(), "RESPONSE_MALFORMED").when(kind.isNull() | (kind == "VOID"), "SCORE_MISSING").when(kind.isin("STRING", "BOOLEAN") | number.isNull(), "SCORE_NOT_A_NUMBER")
    return F.when(code.isNull(), number), code
