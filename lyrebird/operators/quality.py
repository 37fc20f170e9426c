"""Findings on signals: what is wrong with a recording, from its container's facts and its samples' measures.

A finding is a struct of a code and a severity. Every check is a Spark expression over the columns of measures that it
names, so each can be used alone; analyse() puts all of them together, row by row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.operators import catalog, signal

#: Codecs that lose nothing.
LOSSLESS = "flac alac pcm_s16le pcm_s24le pcm_f32le wavpack ape".split()
#: kbit/s under which a codec's files are poor and very poor, and those of any other codec.
LOW_KBPS, LOW_OTHER = {"mp3": 160, "aac": 128, "vorbis": 128, "opus": 96, "wma": 160}, 160
VERY_LOW_KBPS, VERY_LOW_OTHER = {"mp3": 128, "aac": 96, "vorbis": 96, "opus": 64, "wma": 128}, 128
#: kHz up to which a codec reaches at so many kbit/s.
REACH_KHZ = {
    "mp3": [(64, 11.0), (96, 15.5), (128, 16.5), (160, 17.5), (192, 19.0), (256, 19.8), (320, 20.6)],
    "aac": [(64, 13.0), (96, 15.5), (128, 16.5), (192, 18.5), (256, 19.5), (320, 20.0)],
    "vorbis": [(96, 15.0), (128, 17.0), (192, 19.0), (256, 19.5), (320, 20.0)],
    "opus": [(64, 16.0), (96, 18.0), (128, 19.5), (192, 20.0), (256, 20.0)],
    "wma": [(64, 12.0), (128, 15.5), (192, 17.5), (320, 19.0)],
}
#: A full sample rate, and seconds of a very short file.
FULL_RATE, VERY_SHORT_S = 44100, 30.0
#: Clicks that mean anything, and a minute's that mean more.
CLICKS_LEAST, CLICKS_A_MINUTE = 4, 15.0
#: Seconds of silence before, after and within a recording.
LEAD_S, TRAIL_S, GAP_S, LONG_GAP_S = 3.0, 10.0, 2.0, 10.0
#: Decibels of a sudden end and start, and of a decay; seconds that either is measured over, and before it.
END_DB, START_DB, DECAY_DB, EDGE_S, BEFORE_S = -10.0, -15.0, 3.0, 0.05, 0.5
#: Seconds that a recording is shorter or longer than its match.
TRUNCATED_S, SHORT_S, LONG_S = 20.0, 6.0, -20.0
#: Seconds from which a file is sampled, and of its head and tail that then are looked at.
SAMPLED_S, HEAD_S, TAIL_S = 900.0, 480.0, 30.0


def _issue(when: Column, code: str, severity: str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def _some(*issues: Column) -> Column:
    return F.filter(F.array(*issues), lambda i: i.isNotNull())


def _by_codec(codec: Column, values: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, value in values.items():
        out = F.when(codec == name, value).otherwise(out)
    return out


def _positive(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False))


def lossless(codec: Column) -> Column:
    return F.coalesce(codec.isin(*LOSSLESS), F.lit(False))


def kbps(bitrate: Column, size: Column, duration: Column) -> Column:
    """Thousands of bits a second: what the container says, else what its size comes to."""
    said = F.bround(F.coalesce(bitrate, F.lit(0)) / 1000)
    return F.when(said > 0, said).when(_positive(size) & _positive(duration), F.bround(size * 8 / duration / 1000)).otherwise(0).cast("int")


def container(codec: Column, bitrate: Column, sample_rate: Column, channels: Column, duration: Column) -> Column:
    """very_low_bitrate or low_bitrate, low_sample_rate, mono, very_short. Unknown facts (0 or null) say nothing."""
    lossy = ~lossless(codec) & _positive(bitrate)
    very_low, low = bitrate < _by_codec(codec, VERY_LOW_KBPS, VERY_LOW_OTHER), bitrate < _by_codec(codec, LOW_KBPS, LOW_OTHER)
    return _some(
        _issue(lossy & very_low, "very_low_bitrate", "high"), _issue(lossy & ~very_low & low, "low_bitrate", "medium"),
        _issue(_positive(sample_rate) & (sample_rate < FULL_RATE), "low_sample_rate", "medium"), _issue(channels == 1, "mono", "info"),
        _issue(_positive(duration) & (duration < VERY_SHORT_S), "very_short", "info"),
    )


def levels(peak: Column, rms: Column, crest_db: Column, dc: Column) -> Column:
    """dc_offset, low_dynamic_range, very_quiet."""
    return F.transform(signal.level_issues(peak, rms, crest_db, dc), lambda code: F.struct(code.alias("code"), F.lit("low").alias("severity")))


def clipping(ratio: Column, long_runs: Column) -> Column:
    """clipping, as bad as the share of clipped samples and the number of long runs make it."""
    s = signal.clip_severity(ratio, long_runs)
    return _some(F.when(s.isNotNull(), F.struct(F.lit("clipping").alias("code"), s.alias("severity"))))


def clicks(events: Column, seconds: Column) -> Column:
    """clicks: medium from so many a minute on (a shorter signal counts as a minute), else low; a few are none."""
    often = events / F.greatest(F.lit(1.0), seconds / 60) >= CLICKS_A_MINUTE
    return _some(_issue((events >= CLICKS_LEAST) & often, "clicks", "medium"), _issue((events >= CLICKS_LEAST) & ~often, "clicks", "low"))


def silences(lead_s: Column, trail_s: Column, gap_s: Column) -> Column:
    """leading_silence, trailing_silence and dropout; a null trail was not heard."""
    return _some(
        _issue(lead_s > LEAD_S, "leading_silence", "low"), _issue(trail_s > TRAIL_S, "trailing_silence", "low"),
        _issue(gap_s >= LONG_GAP_S, "dropout", "high"), _issue((gap_s >= GAP_S) & (gap_s < LONG_GAP_S), "dropout", "medium"),
    )


def edges(end_db: Column, decay_db: Column, start_db: Column) -> Column:
    """abrupt_end, abrupt_start; a null level was not heard."""
    return _some(_issue((end_db > END_DB) & (decay_db < DECAY_DB), "abrupt_end", "medium"), _issue(start_db > START_DB, "abrupt_start", "low"))


def length(reference: Column, duration: Column) -> Column:
    """truncated, short_duration or long_duration against the matched recording's length, if both are known."""
    both, d = _positive(reference) & _positive(duration), reference - duration
    return _some(
        _issue(both & (d > TRUNCATED_S), "truncated", "high"), _issue(both & (d > SHORT_S) & (d <= TRUNCATED_S), "short_duration", "medium"),
        _issue(both & (d < LONG_S), "long_duration", "info"),
    )


def reach(codec: Column, bitrate: Column) -> Column:
    """kHz that a codec should reach at this bitrate; null for one without a table."""
    out = F.lit(None).cast("double")
    for name, points in REACH_KHZ.items():
        out = F.when((codec == name) & _positive(bitrate), catalog.interpolate(bitrate.cast("double"), points)).otherwise(out)
    return out


def spectrum(codec: Column, bitrate: Column, sample_rate: Column, cutoff_khz: Column) -> Column:
    """fake_lossless or lossless_rolloff; of a lossy file transcode or possible_transcode. A null cutoff says nothing."""
    full, short = lossless(codec) & (sample_rate >= FULL_RATE), F.when(~lossless(codec), reach(codec, bitrate) - cutoff_khz)
    return _some(
        _issue(full & (cutoff_khz < 19.0), "fake_lossless", "high"), _issue(full & (cutoff_khz >= 19.0) & (cutoff_khz < 20.5), "lossless_rolloff", "medium"),
        _issue(short > 3.0, "transcode", "high"), _issue((short > 1.5) & (short <= 3.0), "possible_transcode", "medium"),
    )


def channels(left: Column, right: Column) -> Column:
    """fake_stereo: two channels that are the same."""
    most = F.array_max(F.zip_with(left, right, lambda a, b: F.abs(a - b)))
    return _some(_issue(most < 1e-6, "fake_stereo", "info"))


def measured(df: DataFrame, left: str, right: str, rate: str, sampled: Column, tail: Column | None = None, n_fft: int = signal.N_FFT, block_least: int = signal.BLOCK_LEAST) -> DataFrame:
    """df with the measures of its samples: levels, clipping, clicks, silence, edges and the shelf.

    left and right are arrays of clean doubles (signal.doubles), right null for a single channel; rate is the number of
    samples a second. A sampled row holds a head only: its end is measured on tail, or not at all. Under a second of
    samples, clicks, silence and edges are null. block_least is only smaller for very short signals.
    """
    one = F.array_size(F.col("__mono")) >= F.col(rate)
    edge = F.greatest(F.floor(EDGE_S * F.col(rate)), F.lit(1)).cast("int")
    before = F.floor(BEFORE_S * F.col(rate)).cast("int")
    frame = F.greatest(F.floor(signal.FRAME_S * F.col(rate)), F.lit(1)).cast("int")
    last = lambda a, n: F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, n)
    db = lambda a: signal.decibels(signal.rms_of(a))
    out = df.withColumns({"__mono": signal.mono(F.col(left), F.col(right)), "__flat": signal.interleaved(F.col(left), F.col(right)), "__tail": F.lit(None).cast("array<double>") if tail is None else tail, "__sampled": sampled})
    out = signal.levels(out, "__mono").withColumn("peak", F.array_max(F.transform("__flat", F.abs)))
    out = out.withColumn("crest_db", F.when(F.col("rms") > 0, signal.decibels(F.col("peak")) - signal.decibels(F.col("rms"))).otherwise(0.0))
    hit = F.transform("__flat", lambda x: F.abs(x) >= signal.CLIP)
    out = out.withColumn("__runs", signal.run_lengths(hit)).withColumns({
        "clipped_ratio": F.aggregate("__runs", F.lit(0), lambda a, x: a + x) / F.size("__flat"), "clipped_runs": F.size(F.filter("__runs", lambda x: x >= signal.CLIP_RUN)),
        "__ending": F.when(~F.col("__sampled"), F.col("__mono")).when(F.array_size("__tail") >= F.col(rate), F.col("__tail")),
        "__clicks": signal.local_clicks(F.col("__mono"), F.col(rate), block_least),
    })
    out = out.withColumns({"__frames": signal.frames(F.col("__mono"), frame), "__tail_frames": F.when(F.col("__sampled"), signal.frames(F.col("__ending"), frame))})
    seconds = lambda n: n * frame / F.col(rate)
    out = out.withColumns({"__silence": signal.silence(F.col("__frames")), "__tail_silence": signal.silence(F.col("__tail_frames"))})
    # A head ends amid the recording, so its silent end is a gap, and the recording's is that of the tail.
    inside = F.transform(F.slice("__frames", (F.col("__silence.lead") + 1).cast("int"), F.size("__frames")), lambda x: x < signal.SILENCE_DB)
    gap = F.when(F.col("__sampled"), F.coalesce(F.array_max(signal.run_lengths(inside)), F.lit(0))).otherwise(F.col("__silence.longest"))
    silent_tail = F.when(F.col("__tail_silence.lead") == F.size("__tail_frames"), F.col("__tail_silence.lead")).otherwise(F.col("__tail_silence.trail"))
    end = last(F.col("__ending"), edge)
    prior = F.slice(last(F.col("__ending"), before), F.lit(1), F.greatest(before - edge, F.lit(0)))
    out = out.withColumns({
        "click_events": F.when(one, F.col("__clicks.events")),
        "lead_s": F.when(one, seconds(F.col("__silence.lead"))), "gap_s": F.when(one, seconds(gap)),
        "trail_s": F.when(one, F.when(F.col("__sampled"), seconds(silent_tail)).otherwise(seconds(F.col("__silence.trail")))),
        "end_db": F.when(one, db(end)), "start_db": F.when(one, db(F.slice("__mono", F.lit(1), edge))),
        "decay_db": F.when(one, F.when(F.size("__ending") > before, db(prior) - db(end)).otherwise(0.0)),
        "analysed_s": F.size("__mono") / F.col(rate), "shelf": signal.shelf(F.col("__mono"), F.col(rate).cast("double"), n_fft),
    })
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def analyse(files: DataFrame, n_fft: int = signal.N_FFT, cap_s: float = 0.0) -> DataFrame:
    """files with quality: analysed, score, issues (code, severity) and error, as a struct.

    files: codec, bitrate (bits a second), size, sample_rate, channels, duration_s, reference_s, left and right (arrays of
    samples), and what went wrong before: no_tool, probe_error and decode_error (messages or null). Without the tool a row
    is not analysed; one that can't be probed has undecodable as its only finding and no points; one that fails to decode
    keeps its container's findings beside decode_error. cap_s, if any, bounds the seconds that are looked at; otherwise a
    long recording is sampled, by its head and its end. Nulls among samples are silence; a row without samples has the
    findings of its container and length.
    """
    long_ = F.coalesce((F.col("duration_s") > SAMPLED_S) & F.lit(cap_s == 0), F.lit(False))
    most = F.when(long_, HEAD_S).otherwise(cap_s if cap_s else float(1 << 30))
    head = lambda c: F.slice(signal.doubles(F.col(c)), F.lit(1), F.least(most * F.col("sample_rate"), F.lit(float(1 << 30))).cast("int"))
    end = lambda c: F.reverse(F.slice(F.reverse(signal.doubles(F.col(c))), F.lit(1), (TAIL_S * F.col("sample_rate")).cast("int")))
    slim = files.select(
        F.struct(*(F.col(f"`{c}`") for c in files.columns)).alias("row"), F.col("sample_rate").alias("rate"), F.lower(F.coalesce("codec", F.lit(""))).alias("codec"), kbps(F.col("bitrate"), F.col("size"), F.col("duration_s")).alias("kbps"),
        head("left").alias("start"), head("right").alias("other"), F.when(long_, signal.mono(end("left"), end("right"))).alias("last"), long_.alias("long"),
    )
    m = measured(slim, "start", "other", "rate", F.col("long"), F.col("last"), n_fft)
    r = lambda c: F.col(f"row.{c}")
    whole = F.lit(not cap_s) | (r("duration_s") <= cap_s)
    none = F.array().cast("array<struct<code:string,severity:string>>")
    heard = F.concat(
        levels(F.col("peak"), F.col("rms"), F.col("crest_db"), F.col("dc")), clipping(F.col("clipped_ratio"), F.col("clipped_runs")), clicks(F.col("click_events"), F.col("analysed_s")),
        silences(F.col("lead_s"), F.col("trail_s"), F.col("gap_s")), F.when(whole, edges(F.col("end_db"), F.col("decay_db"), F.col("start_db"))).otherwise(none),
        F.when(F.col("click_events").isNotNull(), length(r("reference_s"), r("duration_s"))).otherwise(none),
        spectrum(F.col("codec"), F.col("kbps"), F.col("rate"), F.col("shelf.cutoff_hz") / 1000), F.coalesce(channels(F.col("start"), F.col("other")), none),
    )
    boxed = container(F.col("codec"), F.col("kbps"), r("sample_rate"), r("channels"), r("duration_s"))
    one = lambda code: F.array(F.struct(F.lit(code).alias("code"), F.lit("high").alias("severity")))
    issues = (
        F.when(r("no_tool").isNotNull(), none).when(r("probe_error").isNotNull(), one("undecodable")).when(r("decode_error").isNotNull(), F.concat(boxed, one("decode_error")))
        .when(F.coalesce(F.size("start"), F.lit(0)) <= 0, boxed).otherwise(F.concat(boxed, heard))
    )
    out = m.withColumn("issues", issues)
    points = F.when(r("no_tool").isNotNull(), F.lit(None).cast("int")).when(r("probe_error").isNotNull(), 0).otherwise(catalog.score(catalog.penalty(F.col("issues"))))
    error = F.coalesce(r("no_tool"), r("probe_error"), r("decode_error"))
    return out.select("row.*", F.struct(r("no_tool").isNull().alias("analysed"), points.alias("score"), F.col("issues"), error.alias("error")).alias("quality"))
