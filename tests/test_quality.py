"""Findings on made-up signals with known faults, and a clean one that has none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird.operators import quality, signal

RATE = 8000


def tone(seconds, rate=RATE, level=0.3, seed=0):
    """A chord with some noise that comes and goes gently."""
    t = np.arange(int(seconds * rate)) / rate
    x = level * (0.3 + 0.7 * np.sin(2 * np.pi * 0.7 * t) ** 2) * (np.sin(2 * np.pi * 220 * t) + 0.5 * np.sin(2 * np.pi * 331 * t)) / 1.5 + 0.003 * level * np.random.default_rng(seed).standard_normal(len(t))
    fade = np.minimum(1, np.minimum(t, t[::-1]) / 0.6)
    return x * fade**2


def row(left, right=None, rate=RATE, **facts):
    base = {"codec": "flac", "bitrate": 900_000, "size": None, "sample_rate": rate, "channels": 1 if right is None else 2, "duration_s": len(left) / rate if left is not None else None, "reference_s": None, "no_tool": None, "probe_error": None, "decode_error": None}
    return {**base, **facts, "left": None if left is None else left.tolist(), "right": None if right is None else right.tolist()}


SCHEMA = "name string, codec string, bitrate long, size long, sample_rate int, channels int, duration_s double, reference_s double, no_tool string, probe_error string, decode_error string, left array<double>, right array<double>"


def found(spark, rows, **how):
    df = spark.createDataFrame([{"name": k, **v} for k, v in rows.items()], SCHEMA)
    return {r["name"]: r["quality"] for r in quality.analyse(df, **how).collect()}


def codes(q):
    return {(i["code"], i["severity"]) for i in q["issues"]}


def test_faults_are_found_and_clean_signals_left_alone(spark):
    clean = tone(40)
    other = clean + 1e-3 * tone(40, seed=1)
    hot = np.clip(tone(40, level=3.0), -1, 1)
    pops = clean.copy()
    pops[np.arange(1, 39) * RATE] += 0.7
    few = clean.copy()
    few[np.arange(1, 6) * RATE] += 0.7
    hole, pause = clean.copy(), clean.copy()
    hole[10 * RATE : 21 * RATE] = 0
    pause[10 * RATE : 13 * RATE] = 0
    late = np.concatenate([np.zeros(4 * RATE), clean, np.zeros(11 * RATE)])
    cold = 0.9 * np.sin(2 * np.pi * 220 * np.arange(30 * RATE) / RATE)
    rows = {
        "clean": row(clean, other), "hot": row(hot, hot * 0.999), "pops": row(pops, other), "few": row(few, other), "hole": row(hole, hole * 0.9), "pause": row(pause, pause * 0.9), "late": row(late, late * 0.9),
        "cold": row(cold, cold * 0.9), "twins": row(clean, clean), "one": row(clean), "dc": row(clean + 0.05, other + 0.05), "quiet": row(clean / 100, other / 100), "short": row(clean[:RATE], other[:RATE]),
        "cut": row(clean, other, reference_s=70.0), "edit": row(clean, other, reference_s=50.0), "longer": row(clean, other, reference_s=15.0),
    }
    got = {k: codes(q) - {("low_sample_rate", "medium")} for k, q in found(spark, rows).items()}
    assert got["clean"] == set()
    assert ("clipping", "high") in got["hot"] and ("low_dynamic_range", "low") in got["hot"]
    assert got["pops"] == {("clicks", "medium")} and got["few"] == {("clicks", "low")}
    assert got["hole"] >= {("dropout", "high")} and got["pause"] >= {("dropout", "medium")}
    assert got["late"] == {("leading_silence", "low"), ("trailing_silence", "low")}
    assert got["cold"] >= {("abrupt_end", "medium"), ("abrupt_start", "low")}
    assert got["twins"] == {("fake_stereo", "info")} and got["one"] == {("mono", "info")}
    assert ("dc_offset", "low") in got["dc"] and ("very_quiet", "low") in got["quiet"] and ("very_short", "info") in got["short"]
    assert got["cut"] == {("truncated", "high")} and got["edit"] == {("short_duration", "medium")} and got["longer"] == {("long_duration", "info")}


def test_failures_are_rows(spark):
    x = tone(2)
    rows = {"tool": row(None, no_tool="none here"), "probe": row(None, probe_error="bad"), "decode": row(None, decode_error="worse", duration_s=10.0, codec="mp3", bitrate=64_000), "empty": row(None), "odd": row(np.where(np.arange(len(x)) == 5, np.nan, x))}
    got = found(spark, rows)
    assert (got["tool"]["analysed"], got["tool"]["score"], got["tool"]["error"]) == (False, None, "none here")
    assert (got["probe"]["score"], codes(got["probe"])) == (0, {("undecodable", "high")})
    assert codes(got["decode"]) == {("decode_error", "high"), ("very_low_bitrate", "high"), ("low_sample_rate", "medium"), ("mono", "info"), ("very_short", "info")} and got["decode"]["score"] == 100 - 30 - 30 - 15
    assert got["empty"]["analysed"] and codes(got["empty"]) == {("low_sample_rate", "medium"), ("mono", "info")}
    assert codes(got["odd"]) == codes(got["empty"]) | {("very_short", "info")}


def test_long_recordings_are_heard_at_both_ends(spark):
    rate = 100
    x = np.random.default_rng(0).standard_normal(1000 * rate) * 0.1
    x[490 * rate : 560 * rate] = 0  # between head and tail
    x[-12 * rate :] = 0
    got = codes(found(spark, {"a": row(x, x * 0.9, rate=rate)})["a"])
    assert ("trailing_silence", "low") in got and not {c for c, _ in got} & {"dropout", "leading_silence"}
    capped = found(spark, {"a": row(x, x * 0.9, rate=rate)}, cap_s=600.0)["a"]
    assert ("dropout", "high") in codes(capped) and not {c for c, _ in codes(capped)} & {"abrupt_end", "abrupt_start"}


@pytest.mark.parametrize(("top", "facts", "want"), [(16000, {}, "fake_lossless"), (15000, {"codec": "mp3", "bitrate": 320_000}, "transcode"), (None, {}, None), (16000, {"codec": "mp3", "bitrate": 128_000}, None)])
def test_spectrum_verdicts(spark, top, facts, want):
    """Clear cases; the query quality_spectrum has those near the limits, as a shelf's place is only known to half a span."""
    rate = 44100
    x = np.random.default_rng(2).standard_normal(rate * 2) * 0.1
    if top:
        f = np.fft.rfft(x)
        f[np.fft.rfftfreq(len(x), 1 / rate) > top] = 0
        x = np.fft.irfft(f)
    got = {c for c, _ in codes(found(spark, {"a": row(x, rate=rate, **facts)})["a"])}
    assert got & {"fake_lossless", "lossless_rolloff", "transcode", "possible_transcode"} == ({want} if want else set())


def test_measures_against_loops(spark):
    """Runs, frames, silence, jumps, events and the noise floor of random arrays, element by element."""
    r = np.random.default_rng(4)
    arrays = [r.choice([0.0, 0.0, 0.5, -1.0, 1.0], int(n)).tolist() for n in r.integers(0, 120, 40)]
    df = spark.createDataFrame(list(enumerate(arrays)), "id int, s array<double>").withColumn("noise", signal.noise_floor(F.col("s"), 16))
    df = df.withColumn("spikes", signal.spikes(F.col("s"), 0.4)).withColumn("frames", signal.frames(F.col("s"), 4))
    got = df.select("id", signal.run_lengths(F.transform("s", lambda x: F.abs(x) >= 1)).alias("runs"), "frames", signal.silence(F.col("frames")).alias("silence"), "spikes", signal.events(F.col("spikes"), 3).alias("events"), "noise", signal.moving_average(F.col("s"), 5).alias("mean"), signal.jumps(F.col("s")).alias("jumps"))
    for g in got.collect():
        a = arrays[g["id"]]
        runs, k = [], 0
        for x in [*a, 0.0]:
            if abs(x) >= 1:
                k += 1
            elif k:
                runs.append(k)
                k = 0
        assert g["runs"] == runs
        rms = [(sum(x * x for x in a[i : i + 4]) / 4) ** 0.5 for i in range(0, len(a) - 3, 4)]
        assert g["frames"] == pytest.approx([20 * np.log10(max(x, 1e-10)) for x in rms])
        loud = [x >= 1e-3 for x in rms]
        lead = loud.index(True) if any(loud) else len(loud)
        trail = loud[::-1].index(True) if any(loud) else 0
        inner = "".join("1" if x else "0" for x in loud[lead : len(loud) - trail]).split("1")
        assert tuple(g["silence"]) == (lead, trail, max(map(len, inner)))
        d = np.diff(a)
        assert g["jumps"] == pytest.approx(d.tolist())
        spikes = [i for i in range(len(d) - 1) if abs(d[i]) > 0.4 and np.sign(d[i]) != np.sign(d[i + 1]) and abs(d[i + 1]) > 0.2]
        assert g["spikes"] == spikes and g["events"] == [x for i, x in enumerate(spikes) if i == 0 or x - spikes[i - 1] > 3]
        for i, n in enumerate(g["noise"]):
            b = min(i // 16, len(a) // 16 - 1)
            block = a[b * 16 : b * 16 + 16] if len(a) >= 16 else None
            want = 1.4826 * np.median(np.abs(block - np.median(block))) if block else np.std(a)
            assert n == pytest.approx(max(want, 1e-7))
        padded = [0.0, 0.0, *a, 0.0, 0.0]
        assert g["mean"] == pytest.approx([sum(padded[i : i + 5]) / 5 for i in range(len(a))])
