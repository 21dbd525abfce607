"""The growing registry: rounds equal a plain loop, streams equal batches, versions hold changed speakers only."""

import numpy as np
import pytest
from framesift.operators.living import CLIP, Rules, Store, identify, identify_stream
from framesift.session import workspace

SIZE = 16
RULES = Rules(photos=2, per_speaker=6)


def unit(seed):
    v = np.random.default_rng(seed).standard_normal(SIZE)
    return v / np.linalg.norm(v)


def near(v, sim, seed):
    r = np.random.default_rng(1000 + seed).standard_normal(SIZE)
    r -= (r @ v) * v
    return sim * v + np.sqrt(1 - sim * sim) * r / np.linalg.norm(r)


def clips_of():
    """(round, input, one speaker, faces, channel, voices)"""
    a, b, c = unit(1), unit(2), unit(3)
    far_voice = -unit(9)
    plan = [
        (1, "u1", True, [near(a, 0.85, i) for i in range(5)] + [near(a, 0.1, 90)], "ch1", [near(unit(9), 0.9, i) for i in range(5)] + [None]),
        (2, "u2", True, [near(a, 0.85, 20 + i) for i in range(4)], "ch1", None),
        (2, "u3", False, [near(b, 0.9, 30 + i) for i in range(4)] + [near(c, 0.9, 40 + i) for i in range(4)] + [unit(77)], "ch3", None),
        (3, "u4", True, [near(near(b, 0.48, 7), 0.97, 50 + i) for i in range(4)], "ch4", None),
        (3, "u5", True, [near(a, 0.85, 60 + i) for i in range(3)], "ch1", [far_voice] * 3),  # same face and channel, another voice
        (4, "u6", True, [near(b, 0.95, 70 + i) for i in range(3)], None, None),
        (4, "u7", True, [-(a + b + c) / np.linalg.norm(a + b + c)] * 2, "ch7", None),
    ]
    rows, k = [], 0
    for round_, name, one, faces, channel, voices in plan:
        for i, f in enumerate(faces):
            voice = voices[i] if voices else None
            rows.append((round_, name, one, k, f.tolist(), None if voice is None else voice.tolist(), channel, f"{name}v{i % 3}", float(i)))
            k += 1
    return rows


def plain(rows):
    """One round after the other with ordinary dictionaries; clusters of u3 are known by construction."""
    norm = lambda v: v / max(np.linalg.norm(v), 1e-8)
    speakers, out = {}, {}
    for round_ in sorted({r[0] for r in rows}):
        groups = {}
        for r in (r for r in rows if r[0] == round_):
            first = [x[3] for x in rows if x[1] == r[1]][0]
            cluster = 0 if r[2] else (r[3] - first) // 4
            groups.setdefault((r[1], cluster), []).append(r)
        before = {s: dict(v) for s, v in speakers.items()}
        new = max(speakers, default=0)
        for key in sorted(groups):
            part = groups[key]
            face = norm(sum(np.array(r[4]) for r in part))
            heard = [np.array(r[5]) for r in part if r[5] is not None]
            voice = norm(sum(heard)) if heard else None
            channels = {r[6] for r in part if r[6]}
            sims = sorted(((float(norm(v["fs"]) @ face), -s) for s, v in before.items()), reverse=True)
            ok = lambda s: voice is None or before[s]["vs"] is None or norm(before[s]["vs"]) @ voice >= RULES.match["voice_low"]
            same = [(x, -s) for x, s in sims if before[-s]["ch"] & channels]
            who, how, hint = None, "new", None
            if same and same[0][0] >= RULES.match["high"] and ok(same[0][1]):
                who, how = same[0][1], "auto_channel"
            elif sims and sims[0][0] >= RULES.match["high"] and sims[0][0] - (sims[1][0] if len(sims) > 1 else -1) >= RULES.match["margin"] and ok(-sims[0][1]):
                who, how = -sims[0][1], "auto"
            elif sims and sims[0][0] >= RULES.match["low"]:
                hint = -sims[0][1]
            if who is None and len(part) < RULES.least:
                out.update({r[3]: (None, "unassigned", "") for r in part})
                continue
            if who is None:
                new += 1
                who = new
                speakers[who] = {"fs": np.zeros(SIZE), "n": 0, "vs": None, "ch": set(), "hint": hint}
            s = speakers[who]
            s["fs"], s["n"], s["ch"] = s["fs"] + sum(np.array(r[4]) for r in part), s["n"] + len(part), s["ch"] | channels
            if heard:
                s["vs"] = sum(heard) + (0 if s["vs"] is None else s["vs"])
            for r in part:
                flags = ["face_outlier"] * int(np.array(r[4]) @ face < RULES.face_outlier)
                if voice is not None and r[5] is not None and np.array(r[5]) @ voice < RULES.voice_outlier:
                    flags.append("voice_outlier")
                out[r[3]] = (who, how, ",".join(flags))
    return out, speakers


@pytest.fixture(scope="module")
def batch(spark):
    rows = clips_of()
    store = Store(spark)
    got = identify(spark.createDataFrame(rows, CLIP).repartition(3), store, SIZE, RULES).collect()
    return rows, store, got


def test_rounds_equal_the_plain_loop(batch):
    rows, store, got = batch
    want, speakers = plain(rows)
    assert {r.clip_id: (r.speaker, r.assign, r.flags) for r in got} == want
    by = {r.input_id: r for r in got}
    assert by["u2"].speaker == by["u1"].speaker and by["u2"].assign == "auto_channel"
    assert by["u6"].assign == "auto" and by["u5"].speaker != by["u1"].speaker and by["u7"].assign == "unassigned"
    held = {r.speaker: r for r in store.before(5).collect()}
    assert held.keys() == speakers.keys()
    for s, v in speakers.items():
        r = held[s]
        assert np.allclose(r.face_sum, v["fs"]) and r.face_n == v["n"] and set(r.channels) == v["ch"] and r.suggestion == v["hint"]
        assert len(r.photos) <= 2 and len(set(r.photos)) == len(r.photos) and r.review == "pending"


def test_versions_hold_changed_speakers_only(spark, batch):
    _, store, got = batch
    for round_ in (1, 2, 3, 4):
        touched = {r.speaker for r in got if r.round == round_ and r.speaker is not None}
        assert {r.speaker for r in spark.read.parquet(f"{store.path}/v={round_}").collect()} == touched


def test_stream_equals_batch(spark, batch):
    rows, store, got = batch
    path = workspace(spark, "clips")
    for round_ in (1, 2, 3, 4):
        spark.createDataFrame([r for r in rows if r[0] == round_], CLIP).coalesce(1).write.parquet(f"{path}/n={round_}")
    stream = spark.readStream.schema(CLIP).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    other = Store(spark)
    streamed = identify_stream(stream, other, SIZE, RULES).collect()
    assert {r.clip_id: (r.speaker, r.assign, r.flags) for r in streamed} == {r.clip_id: (r.speaker, r.assign, r.flags) for r in got}
    key = lambda s: sorted((r.speaker, r.face_n, [round(x, 9) for x in r.face_sum], r.channels, r.photos) for r in s.before(5).collect())
    assert key(store) == key(other)


def test_finished_speaker_opens_again(spark):
    store = Store(spark)
    a, b = unit(1), unit(2)
    store.import_rows(spark.createDataFrame([(1, a.tolist(), 4, None, 0, ["x"], ["u"], [], "done", 4, None, None), (2, b.tolist(), 4, None, 0, ["y"], ["w"], ["v"], "done", 9, None, None)],
                                            store.before(1).schema))
    clips = [(1, "i1", True, i, near(a, 0.9, i).tolist(), None, "x", "p", 1.0) for i in range(3)] + [(1, "i2", True, 10 + i, near(b, 0.9, i).tolist(), None, "y", "q", 1.0) for i in range(3)]
    identify(spark.createDataFrame(clips, CLIP), store, SIZE, RULES)
    rows = {r.speaker: r for r in store.before(2).collect()}
    assert (rows[1].review, rows[2].review) == ("pending", "done") and rows[2].photos == ["v", "q"] and rows[1].face_n == 7
    assert identify(spark.createDataFrame([], CLIP), store, SIZE).collect() == []
