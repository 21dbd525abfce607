"""Explicit schemas of the ledger tables and manifests. Nothing is ever inferred."""

from pyspark.sql import types as T

S, D, L, TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()
TEXTS, VECTOR = T.ArrayType(S), T.ArrayType(T.FloatType())


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SPAN_LIST = T.ArrayType(T.ArrayType(D))
ANNOTATIONS = T.MapType(S, _table(known=SPAN_LIST, positive=SPAN_LIST))

LEDGER = {
    "meta": _table(key=S, value=S),
    "inputs": _table(
        input_id=L, url=S, kind=S, speakers=S, note=S, status=S, reason=S, entries=L, planned_at=TS
    ),
    "videos": _table(
        video_id=S, input_id=L, rank=L, url=S, title=S, channel=S, channel_id=S, upload_date=S,
        duration_s=D, est_mb=D, status=S, reason=S, batch=L, meta=T.MapType(S, S), dl_status=S,
        dl_error=S, file=S, sha256=S, size_mb=D, probe=T.MapType(S, S), cut_status=S,
        cut_info=T.MapType(S, S), id_status=S, raw_location=S,
    ),
    "duplicates": _table(video_id=S, input_id=L, kept_input_id=L, at=TS),
    "batches": _table(batch=L, created_at=TS, zip=S, zip_sha256=S, zip_mb=D, location=S),
    "clips": _table(
        clip_id=S, video_id=S, input_id=L, batch=L, start_s=D, end_s=D, duration_s=D, file=S,
        sha256=S, size_mb=D, face=VECTOR, face_consistency=D, voice=VECTOR, flags=S, jump=S,
        speaker_id=S, assign=S, decision=S, part=L, split=S, location=S, created_at=TS,
    ),
    "speakers": _table(
        speaker_id=S, created_at=TS, channel_ids=TEXTS, inputs=T.ArrayType(L),
        face_sum=T.ArrayType(D), face_n=L, voice_sum=T.ArrayType(D), voice_n=L,
        photos=T.ArrayType(_table(video=S, path=S)), gender=S, review=S, suggestion=S,
        merged_into=S, part=L, reviewed_at=TS, order_key=L,
    ),
    "parts": _table(
        part=L, created_at=TS, members=TEXTS, clips=L, export_dir=S, zip=S, zip_sha256=S, zip_mb=D,
        location=S,
    ),
    "events": _table(id=L, at=TS, step=S, message=S),
}

CLEAN_MANIFEST = _table(
    clip_id=S, video=S, sha256=S, source_id=S, speaker_id=S, gender=S, split=S, duration_s=D,
    source_start_s=D, source_end_s=D, review_decision=S, sync_status=S,
    relation_annotations=ANNOTATIONS, url=S, channel=S, source_sha256=S, source_fps=D,
    source_width=L, source_height=L, source_codec=S, source_bitrate_kbps=D, batch=L, flags=S,
    audio_lag_frames=L, av_sync_status=S,
)

GENERATED_MANIFEST = _table(
    sample_id=S, video=S, sha256=S, source_id=S, source_clip_id=S, speaker_id=S, gender=S, split=S,
    duration_s=D, cell=S, kind=S, generator=S, generator_version=S, voice_method=S, control_type=S,
    label=L, fake_intervals=SPAN_LIST, visual_fake_intervals=SPAN_LIST,
    audio_fake_intervals=SPAN_LIST, av_mismatch_intervals=SPAN_LIST, synthetic_visual=T.BooleanType(),
    synthetic_audio=T.BooleanType(), review_status=S,
)
