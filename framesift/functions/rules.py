"""Row rules as column expressions: contract checks, rejection reasons, scalar label logic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.functions import spans as S

# Limits of a usable source and the label cells.
MIN_FPS, MIN_SHORT_SIDE, MAX_SHORT_SIDE = 25, 720, 720
MIN_SOURCE_SECONDS, MAX_SOURCE_HOURS = 30, 12
CELLS = ["real", "sham", "voice", "source", "donor", "both"]
LIPSYNC_CELLS = ["source", "donor", "both"]
SPLITS = ["train", "validation", "test"]
LATE_MS, EARLY_MS = 125, 45

# Hosts, id shape and messages of the video site.
HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com"]
SHORT_HOSTS = ["youtu.be", "www.youtu.be"]
SITE = "https://www.youtube.com/"
VIDEO_ID = "^[A-Za-z0-9_-]{11}\\z"
TRANSIENT = r"HTTP Error (403|429|5\d\d)|timed out|Connection (reset|aborted)|IncompleteRead"
UNAVAILABLE = (
    "(?i)private|unavailable|removed|terminated|members|age|copyright|not available|deleted"
)
BOT_CHECK = "confirm you.re not a bot"
ANSI = "\x1b\\[[0-9;]*m"
FACE_ERRORS = [
    "Face not detected", "Missing MuseTalk face", "Invalid face bbox", "not detect face",
    "'mask_sharp'",
]


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[A-Za-z0-9_-]+\\z"), F.lit(False))


def safe_bundle_path(path: Column) -> Column:
    """Relative POSIX path: no backslash, no root, no drive, no parent step."""
    unsafe = (
        path.contains("\\")
        | path.startswith("/")
        | path.rlike("^[A-Za-z]:")
        | F.array_contains(F.split(path, "/"), "..")
    )
    return F.coalesce(~unsafe, F.lit(False))


def first_reason(*rules: tuple[Column, Column | str]) -> Column:
    """Reason of the first rule whose condition is true, else NULL. Order matters."""
    out = None
    for condition, reason in rules:
        text = F.lit(reason) if isinstance(reason, str) else reason
        out = F.when(condition, text) if out is None else out.when(condition, text)
    return out


def not_finite(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def bundle_issue(r, duplicate_id: Column, duplicate_media: Column, first_has_split: Column) -> Column:
    """First broken rule of a clean-manifest row; `r(name)` gives its columns."""
    start, end, duration = r("source_start_s"), r("source_end_s"), r("duration_s")
    return first_reason(
        (~valid_id(r("clip_id")) | duplicate_id, "invalid or duplicate clip_id"),
        (r("variant").isNotNull(), "generated variant"),
        ((r("split").isNotNull() != first_has_split)
         | ~F.coalesce(r("split"), F.lit("train")).isin(SPLITS), "missing or invalid split"),
        (F.coalesce(F.trim(r("source_id")), F.lit("")) == "", "source_id required"),
        (~(r("review_decision").eqNullSafe(F.lit("keep"))
           & r("sync_status").eqNullSafe(F.lit("reviewed_match"))), "not reviewed"),
        (not_finite(duration) | (duration <= 0), "invalid duration"),
        (not_finite(start) | not_finite(end), "source times required"),
        (~((start >= 0) & (start < end)) | (F.abs(end - start - duration) > 0.25),
         "invalid source interval"),
        (~safe_bundle_path(r("video")) | ~r("video").startswith("clips/"), "unsafe video path"),
        (duplicate_media, "duplicate content"),
    )


def annotations_ok(known: Column, positive: Column, duration: Column) -> Column:
    """Spans finite and inside the clip; every positive span inside one known span."""

    def inside(s):
        return (~F.isnan(s["a"]) & ~F.isnan(s["b"]) & (s["a"] >= 0) & (s["a"] < s["b"])
                & (s["b"] <= duration + 1e-6))

    covered = F.forall(
        positive, lambda p: F.exists(known, lambda k: (k["a"] <= p["a"]) & (p["b"] <= k["b"]))
    )
    return F.forall(known, inside) & F.forall(positive, inside) & covered


def generated_issue(r) -> Column:
    """First broken rule of a generated-manifest row (duplicates are checked across rows)."""
    label, spans, duration = r("label"), r("fake_intervals"), r("duration_s")
    flags = (r("synthetic_audio"), r("synthetic_visual"))
    lists = (r("audio_fake_intervals"), r("visual_fake_intervals"))
    both_flags = flags[0].isNotNull() & flags[1].isNotNull()
    both_lists = lists[0].isNotNull() & lists[1].isNotNull() & spans.isNotNull()
    merged = S.union(F.concat(*lists), 0.0)
    same = (F.size(merged) == F.size(spans)) & F.forall(
        F.zip_with(merged, spans, lambda x, y: (F.abs(x["a"] - y["a"]) <= 1e-6 + 1e-5 * F.abs(y["a"]))
                   & (F.abs(x["b"] - y["b"]) <= 1e-6 + 1e-5 * F.abs(y["b"]))),
        lambda ok: F.coalesce(ok, F.lit(False)))
    rules = [
        (~valid_id(r("sample_id")), "invalid sample_id"),
        (~F.coalesce(r("split").isin(SPLITS), F.lit(False)), "split missing"),
        (~F.coalesce(label.isin(0, 1), F.lit(False))
         | ~r("review_status").eqNullSafe(F.lit("keep")), "label or review"),
        (not_finite(duration) | (duration <= 0), "invalid duration"),
        ((F.coalesce(r("source_id"), F.lit("")) == "")
         | (F.coalesce(r("generator"), F.lit("")) == ""), "provenance required"),
        (both_flags & ((flags[0] | flags[1]).cast("long") != label), "label differs from modality flags"),
    ]
    for flag, own in zip(flags, lists):
        rules += [
            (flag.eqNullSafe(F.lit(False)) & ~F.coalesce(F.size(own) == 0, F.lit(False)),
             "non-synthetic modality with spans"),
            (flag.eqNullSafe(F.lit(True)) & F.coalesce(F.size(own) == 0, F.lit(False)),
             "synthetic modality without spans"),
            (~S.ordered_inside(own, duration), "invalid modality spans"),
        ]
    rules += [
        (F.coalesce(both_lists & ~same, F.lit(False)), "union differs"),
        ((label == 0) & ~F.coalesce(F.size(spans) == 0, F.lit(False)), "real with spans"),
        ((label == 1) & F.coalesce(F.size(spans) == 0, F.lit(False)), "fake without spans"),
        (~S.ordered_inside(spans, duration), "invalid spans"),
        (F.length(F.coalesce(r("sha256"), F.lit(""))) != 64, "media hash required"),
    ]
    return first_reason(*rules)


def metadata_issue(r) -> Column:
    """Why a source is rejected by its metadata, or NULL. The order of the rules is part of them."""
    duration = F.coalesce(r("duration_s"), F.lit(0.0))
    fps = F.coalesce(r("native_fps"), F.lit(0.0))
    short = F.least(r("v_width"), r("v_height"))
    language = F.lower(F.coalesce(r("a_language"), F.lit("")))
    return first_reason(
        (r("live_status").isin("is_live", "is_upcoming", "post_live"),
         F.concat(F.lit("live stream ("), r("live_status"), F.lit(")"))),
        (~F.coalesce(r("availability"), F.lit("")).isin("", "public", "unlisted"),
         F.concat(F.lit("availability "), r("availability"))),
        (~duration.between(MIN_SOURCE_SECONDS, MAX_SOURCE_HOURS * 3600),
         F.concat(F.lit("duration "), F.bround(duration, 0).cast("long").cast("string"),
                  F.lit(f"s outside {MIN_SOURCE_SECONDS}s-{MAX_SOURCE_HOURS}h"))),
        (fps < MIN_FPS - 0.5, F.concat(F.lit("fps "), F.format_string("%.2f", fps), F.lit(f" < {MIN_FPS}"))),
        ((F.coalesce(r("v_format_id"), F.lit("")) == "") | (F.coalesce(r("a_format_id"), F.lit("")) == ""),
         "no format"),
        (r("v_height") > r("v_width"), "vertical video"),
        (short < MIN_SHORT_SIDE, F.concat(F.lit("short side "), short.cast("string"))),
        (short > MAX_SHORT_SIDE, F.concat(F.lit("no smaller format, short side "), short.cast("string"))),
        (~F.coalesce(r("audio_is_original"), F.lit(True)), "dubbed track"),
        ((language != "") & ~language.startswith("vi"), F.concat(F.lit("audio language "), language)),
    )


def quality_issue(fps: Column, width: Column, height: Column) -> Column:
    """Rejection reason after download; missing metadata comes first."""

    def missing(x):
        return x.isNull() | (x == 0)

    return first_reason(
        (missing(fps) | missing(width) | missing(height), "missing fps/resolution metadata"),
        (fps < MIN_FPS - 0.5, F.concat(F.lit("fps "), F.format_string("%.2f", fps))),
        (height > width, "vertical video"),
        (F.least(width, height) < MIN_SHORT_SIDE,
         F.concat(F.lit("short side "), F.least(width, height).cast("string"))),
    )


def estimate_mb(duration: Column, video_mb: Column, video_kbps: Column, audio_mb: Column,
                audio_kbps: Column, fallback_gb_per_hour: float = 0.5) -> Column:
    """Download size: reported, else bit rate × duration, else a rate per hour. Audio counts only
    when the video size is known."""

    def by_rate(kbps):
        return F.when(kbps != 0, kbps * duration / 8 / 1000)

    video = F.coalesce(video_mb, by_rate(video_kbps))
    audio = F.coalesce(audio_mb, by_rate(audio_kbps), F.lit(0.0))
    fallback = F.lit(fallback_gb_per_hour * 1000) * duration / 3600
    return F.round(F.when(video.isNull(), fallback).otherwise(video + audio), 1)


def describe_formats(formats: Column, chosen: Column) -> Column:
    """Summary of the formats a source offers.

    formats / chosen: array<struct<vcodec, acodec, width, height, fps, language, format_note,
    format_id>>. The largest video format is the first with the greatest short side.
    """

    def real_codec(c):
        return c.isNotNull() & (c != "none")

    def short(f):
        return F.least(F.coalesce(f["width"], F.lit(0)), F.coalesce(f["height"], F.lit(0)))

    video = F.filter(formats, lambda f: real_codec(f["vcodec"]))
    audio = F.filter(formats, lambda f: (f["vcodec"] == "none") & real_codec(f["acodec"]))
    best = F.array_max(F.transform(video, short))
    largest = F.get(F.filter(video, lambda f: short(f) == best), F.lit(0))
    v = F.get(F.filter(chosen, lambda f: real_codec(f["vcodec"])), F.lit(0))
    a = F.get(F.filter(chosen, lambda f: real_codec(f["acodec"])), F.lit(0))
    languages = F.size(F.array_distinct(F.transform(audio, lambda f: f["language"])))
    return F.struct(
        largest["width"].alias("max_width"), largest["height"].alias("max_height"),
        F.coalesce(F.array_max(F.transform(video, lambda f: F.coalesce(f["fps"], F.lit(0.0)))),
                   F.lit(0.0)).alias("native_fps"),
        (F.coalesce(largest["height"], F.lit(0)) > F.coalesce(largest["width"], F.lit(0))).alias("vertical"),
        F.coalesce(v["format_id"], F.lit("")).alias("v_format_id"),
        F.coalesce(a["format_id"], F.lit("")).alias("a_format_id"),
        F.when(F.size(audio) > 0, languages).cast("long").alias("audio_track_count"),
        ((languages <= 1) | F.lower(F.coalesce(a["format_note"], F.lit(""))).contains("original"))
        .alias("audio_is_original"),
    )


def classify_url(url: Column) -> Column:
    """struct(kind, canonical); kind is NULL for an unsupported URL."""
    url = F.trim(url)
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    list_id = F.regexp_extract(url, "[?&]list=([^&#]+)", 1)
    given = F.regexp_extract(url, "[?&]v=([^&#]+)", 1)
    short = host.isin(SHORT_HOSTS)
    known = scheme.isin("http", "https") & (host.isin(HOSTS) | short)
    candidate = (
        F.when(short, F.regexp_replace(path, "^/+|/+$", ""))
        .when((F.size(parts) == 2) & first.isin("shorts", "embed", "live"), second)
        .otherwise(given)
    )
    handle = first.startswith("@")
    channel = F.when(handle, first).when(
        first.isin("channel", "c", "user") & (F.size(parts) > 1), F.concat_ws("/", first, second))
    is_list = known & (first == "playlist") & (list_id != "")
    is_video = known & (short | first.isin("watch", "shorts", "live", "embed"))
    kind = (
        F.when(is_list, F.lit("playlist"))
        .when(is_video, F.when(candidate.rlike(VIDEO_ID), F.lit("video")))
        .when(known & channel.isNotNull(), F.lit("channel"))
    )
    canonical = (
        F.when(kind == "playlist", F.concat(F.lit(SITE + "playlist?list="), list_id))
        .when(kind == "video", F.concat(F.lit(SITE + "watch?v="), candidate))
        .when(kind == "channel", F.concat(F.lit(SITE), channel, F.lit("/videos")))
    )
    return F.struct(kind.alias("kind"), canonical.alias("canonical"))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def download_error(text: Column) -> Column:
    """bot_check (stop), unavailable (reject), transient (retry) or error (ask again)."""
    clean = strip_ansi(text)
    return first_reason(
        (clean.rlike(BOT_CHECK), "bot_check"),
        (clean.rlike(UNAVAILABLE), "unavailable"),
        (clean.rlike(TRANSIENT), "transient"),
        (F.lit(True), "error"),
    )


def job_error(text: Column) -> Column:
    """struct(kind, reason): face, generator_error, or NULL kind when the run must stop."""
    face = F.get(F.filter(F.array(*[F.lit(m) for m in FACE_ERRORS]), lambda m: F.contains(text, m)),
                 F.lit(0))
    prefix = "Worker failed: "
    lines = F.filter(
        F.transform(F.split(F.substring(text, len(prefix) + 1, 1 << 30), "\\r\\n|\\r|\\n"), lambda x: F.trim(x)),
        lambda x: x != "")
    message = F.array_join(
        F.when(F.size(lines) > 1, F.array(F.substring(F.get(lines, F.lit(0)), 1, 100),
                                          F.element_at(lines, -1)))
        .otherwise(F.transform(lines, lambda x: F.substring(x, 1, 100))), " … ")
    worker = text.startswith(prefix)
    return F.struct(
        F.when(face.isNotNull(), F.lit("face")).when(worker, F.lit("generator_error")).alias("kind"),
        F.when(face.isNotNull(), face).when(worker, F.substring(message, 1, 300)).alias("reason"),
    )


def cell_labels(cell: Column, kind: Column, duration: Column, part: Column) -> Column:
    """Label spans of a cell. `part` is the replaced span (array of one, or empty)."""
    whole = F.array(S.span(F.lit(0.0), F.round(duration, 4)))
    part = F.transform(part, lambda s: S.span(F.round(s["a"], 4), F.round(s["b"], 4)))
    touched = F.when(kind == "full", whole).otherwise(part)
    none = S.no_spans()
    visual = F.when(cell.isin(LIPSYNC_CELLS), touched).otherwise(none)
    audio = F.when(cell == "voice", touched).when(cell == "both", part).otherwise(none)
    mismatch = F.when(cell.isin("sham", "voice"), touched).otherwise(none)
    fake = S.union(F.concat(visual, audio))
    return F.struct(
        (F.size(fake) > 0).cast("long").alias("label"), fake.alias("fake"), visual.alias("visual"),
        audio.alias("audio"), mismatch.alias("mismatch"),
        (F.size(visual) > 0).alias("synthetic_visual"), (F.size(audio) > 0).alias("synthetic_audio"),
    )


def resolution_gate(short_side: Column, min_side: float, scores: dict[str, Column]):
    """Below `min_side`, with an audio score: visual and mismatch unknown, ai = audio."""
    gated = (short_side < F.lit(min_side)) & scores["audio"].isNotNull()
    gated = F.coalesce(gated, F.lit(False))
    out = {
        task: F.when(~gated, c).when(F.lit(task in ("audio", "ai")), scores["audio"])
        for task, c in scores.items()
    }
    return out, gated


def kleene_or(*states: Column) -> Column:
    """1 if any state is 1, else NULL if any is NULL, else 0."""
    any_one = F.greatest(*states) if len(states) > 1 else states[0]
    unknown = states[0].isNull()
    for s in states[1:]:
        unknown = unknown | s.isNull()
    return F.when(any_one == 1, F.lit(1)).when(~unknown, F.lit(0)).cast("long")


def sync_correction(lag: Column, status: Column) -> Column:
    """Frames to shift: the measured lag when it is trusted, else 0."""
    return F.when(status.isin("ok", "few"), F.coalesce(lag, F.lit(0))).otherwise(F.lit(0)).cast("long")


def noticeable(lag_frames: Column) -> Column:
    ms = lag_frames * 40
    return (ms > LATE_MS) | (-ms > EARLY_MS)


def add_flag(flags: Column, flag: Column) -> Column:
    """Comma list plus one flag (NULL adds nothing); sorted, distinct, no empty entries."""
    items = F.filter(F.split(F.coalesce(flags, F.lit("")), ","), lambda x: x != "")
    more = F.when(flag.isNotNull(), F.array(flag)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.array_sort(F.array_union(items, more)), ",")
