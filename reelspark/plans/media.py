"""Queries on cues, frames, runs and videos."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.functions import text as tx
from reelspark.operators import dedup, html_pages, joins, models, render, segments, tables
from reelspark.plans.registry import RE2_SPACE, SQL, distinct_rows, query, squeezed, table
from reelspark.session import shared_dir
from reelspark.sources import captions
from reelspark.streaming import incremental


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues once each, with whole milliseconds, those without times left out."""
    rows = distinct_rows(spark, sf_dir, "cues", "cue_id", "video_id", "seq", "start_s", "end_s", "text").where("start_s is not null and end_s is not null")
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return rows.select("cue_id", "video_id", "seq", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "start_s", "end_s", "text")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "frames").drop("loaded_at").distinct()


_C = "c as (select distinct cue_id, video_id, seq, round(start_s * 1000)::bigint as start_ms, round(end_s * 1000)::bigint as end_ms, text from cues where start_s is not null and end_s is not null)"
_F = "f as (select distinct frame_id, run_id, video_id, timestamp_s, path, phash, include_flag, confidence, alt_text, caption, degraded from frames)"
_TS = "lpad((({c}) // 3600000)::varchar, 2, '0') || ':' || lpad((({c}) // 60000 % 60)::varchar, 2, '0') || ':' || lpad((({c}) // 1000 % 60)::varchar, 2, '0') || ',' || lpad((({c}) % 1000)::varchar, 3, '0')"


@query(f"""
with {_C}, x as (select cue_id, start_ms, {_TS.format(c="start_ms")} as ts from c)
select cue_id, ts, start_ms / 1000.0::double as seconds,
  case when start_ms >= 3600000 then (start_ms // 3600000)::varchar || ':' || lpad((start_ms // 60000 % 60)::varchar, 2, '0') else (start_ms // 60000)::varchar end || ':' || lpad((start_ms // 1000 % 60)::varchar, 2, '0') as shown,
  (start_ms // 1000)::double as back
from x""")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cues(spark, sf_dir).select("cue_id", "start_ms", tx.ms_to_ts("start_ms").alias("ts"), tx.ts_display(F.floor(F.col("start_ms") / 1000)).alias("shown"))
    return rows.select("cue_id", "ts", tx.ts_to_s("ts").alias("seconds"), "shown", tx.hms_to_seconds("shown").alias("back"))


_J1 = f"""
with {_F}, p as (select video_id, p_idx, round(start_s * 1000)::bigint as s, round(end_s * 1000)::bigint as e from paragraphs),
j as (select f.video_id, f.frame_id, coalesce(min(p_idx), -1) as p_idx from f left join p on f.video_id = p.video_id and round(timestamp_s * 1000)::bigint >= s and round(timestamp_s * 1000)::bigint < e group by all)
"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return joins.first_range(_frames(spark, sf_dir), table(spark, sf_dir, "paragraphs"), key="video_id", point_id="frame_id", at=ms("timestamp_s"), start=ms("start_s"), end=ms("end_s"), order="p_idx")


@query(_J1 + "select video_id, frame_id, p_idx from j")
def frame_paragraph_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paragraph each frame falls into, -1 for none."""
    return _placed(spark, sf_dir)


@query(_J1 + "select video_id, p_idx, count(*) as n, least(count(*), 3)::bigint as data_count from j where p_idx >= 0 group by 1, 2")
def figure_row_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed(spark, sf_dir).where("p_idx >= 0").groupBy("video_id", "p_idx").agg(F.count("*").alias("n"))
    return rows.withColumn("data_count", F.least("n", F.lit(3).cast("long")))


_B = "b as (select *, (row_number() over (partition by run_id order by timestamp_s, frame_id) - 1) // 10 as batch from f where timestamp_s is not null and not isnan(timestamp_s) and run_id is not null)"


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _frames(spark, sf_dir).where("timestamp_s is not null and not isnan(timestamp_s)")
    return segments.batches(timed, "run_id", ["timestamp_s", "frame_id"], 10)


@query(f"with {_F}, {_B} select run_id, frame_id, batch from b")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir).select("run_id", "frame_id", "batch")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.round(F.col("timestamp_s") * 1000).cast("long")
    return _batched(spark, sf_dir).groupBy("video_id", "run_id", "batch").agg(F.min(ms).alias("w0"), F.max(ms).alias("w1"))


def _window_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir).where("text is not null")
    pairs = joins.overlapping(_windows(spark, sf_dir), cues, key="video_id", window=["run_id", "batch"], w0=F.col("w0"), w1=F.col("w1"), start=F.col("start_ms"), end=F.col("end_ms"), columns=["cue_id", "text"])
    return joins.window_text(pairs, "video_id", ["run_id", "batch"], "text", ["cue_start", "cue_id"])


@query(f"""
with {_F}, {_B}, {_C},
w as (select video_id, run_id, batch, min(round(timestamp_s * 1000)::bigint) as w0, max(round(timestamp_s * 1000)::bigint) as w1 from b group by all)
select w.video_id, run_id, batch, string_agg(text, ' ' order by start_ms, cue_id) as window_text
from w join c on w.video_id = c.video_id and end_ms >= w0 and start_ms <= w1 and start_ms <= end_ms where text is not null group by all""")
def cue_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said around each batch of frames."""
    return _window_texts(spark, sf_dir)


@query(f"with {_F} select video_id, frame_id, rank from (select *, row_number() over (partition by video_id order by confidence desc, timestamp_s asc nulls last, frame_id) as rank from f where include_flag and not isnan(confidence)) where rank <= 25 and confidence is not null")
def frame_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best included frames of a video; Spark keeps 25 per key and task before it shuffles."""
    rows = _frames(spark, sf_dir).where("include_flag and confidence is not null and not isnan(confidence)")
    best = Window.partitionBy("video_id").orderBy(F.col("confidence").desc(), F.col("timestamp_s").asc_nulls_last(), "frame_id")
    return rows.withColumn("rank", F.row_number().over(best)).where("rank <= 25").select("video_id", "frame_id", "rank")


@query(f"""
with {_F}, n as (select run_id, frame_id, row_number() over (partition by run_id order by timestamp_s, frame_id) - 1 as i, count(*) over (partition by run_id) as cnt from f where timestamp_s is not null and not isnan(timestamp_s))
select run_id, frame_id from n where cnt <= 25 or list_contains(list_transform(range(25), lambda j: floor(j * (cnt / 25.0::double))::bigint), i)""")
def even_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _frames(spark, sf_dir).where("timestamp_s is not null and not isnan(timestamp_s)").select("run_id", "frame_id", "timestamp_s")
    return segments.even_sample(timed, "run_id", ["timestamp_s", "frame_id"], 25).select("run_id", "frame_id")


@query("""
with c as (select distinct cue_id, video_id, seq, text from cues where trim(coalesce(text, '')) <> '' and video_id is not null and seq is not null),
l as (select *, lag(text) over (partition by video_id order by seq, cue_id) as before from c) select video_id, cue_id, text from l where before is distinct from text""")
def dedupe_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = distinct_rows(spark, sf_dir, "cues", "cue_id", "video_id", "seq", "text").where("seq is not null")
    return segments.drop_repeats(cues, "video_id", ["seq", "cue_id"], "text").select("video_id", "cue_id", "text")


_KEPT = """
with recursive {f}, r as (select run_id, phash, frame_id, row_number() over (partition by run_id order by coalesce(timestamp_s, -1), frame_id) as i from f where phash is not null and run_id is not null),
k as (
  select run_id, i, frame_id, [phash] as kept, true as keep from r where i = 1
  union all
  select k.run_id, r.i, r.frame_id, case when list_bool_or([false] || list_transform(k.kept, lambda h: bit_count(xor(h, r.phash)) <= 5)) then k.kept else k.kept || [r.phash] end,
    not list_bool_or([false] || list_transform(k.kept, lambda h: bit_count(xor(h, r.phash)) <= 5))
  from k join r on r.run_id = k.run_id and r.i = k.i + 1)
select run_id, frame_id from k where keep"""


@query(_KEPT.format(f=_F))
def greedy_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir).withColumn("at", F.coalesce("timestamp_s", F.lit(-1.0)))
    return dedup.greedy_dedup(frames, key="run_id", order=["at"], item="frame_id", hash_="phash", threshold=5)


@query(f"""
with {_F} select video_id, case when g > 0 then g else 5 end as interval_s
from (select video_id, list_reduce([0::bigint] || list(coalesce(floor(timestamp_s)::bigint, 0)), lambda x, y: gcd(x, y)) as g from f where video_id is not null group by 1)""")
def interval_gcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sampling_interval(_frames(spark, sf_dir), "video_id", F.col("timestamp_s"))


@query(f"""
with {_F}, old as (select distinct phash from f join runs using (run_id) where attempt = 1 and phash is not null)
select frame_id, f.phash in (select phash from old) as hit from f join runs using (run_id) where attempt > 1 and f.phash is not null""")
def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of later attempts, by whether the first attempts have seen their hash."""
    runs = table(spark, sf_dir, "runs").select("run_id", "attempt")
    frames = _frames(spark, sf_dir).where("phash is not null").select("frame_id", "run_id", "phash").join(runs, "run_id")
    hits, misses = joins.cache_split(frames.where("attempt > 1"), frames.where("attempt = 1"), "phash")
    return hits.select("frame_id", F.lit(True).alias("hit")).unionByName(misses.select("frame_id", F.lit(False).alias("hit")))


@query("""
with new as (select video_id, arg_max(run_id, attempt::bigint * 1000000000 + run_id) as run_id from runs where attempt > 1 group by 1), old as (select video_id, max(run_id) as run_id from runs where attempt = 1 group by 1)
select r.video_id, r.run_id, r.status from runs r where run_id in (select run_id from new) or run_id in (select run_id from old where video_id not in (select video_id from new))""")
def summary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of every video: first attempts, replaced by the last later one."""
    runs = table(spark, sf_dir, "runs").select("video_id", "run_id", "attempt", "status")
    last = lambda rows: rows.groupBy("video_id").agg(F.max_by(F.struct("run_id", "status"), F.struct("attempt", "run_id")).alias("r")).select("video_id", "r.*")
    return tables.upsert(last(runs.where("attempt = 1")), last(runs.where("attempt > 1")), "video_id")


@query("select status, count(*) as n from runs group by 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.status_counts(table(spark, sf_dir, "runs"))


@query("select run_id, (sum(coalesce(candidates, 0)) over (partition by status order by started_at, run_id))::bigint as total from runs where status is not null")
def running_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "runs").select("run_id", "status", "started_at", "candidates")
    return tables.running_total(runs, "status", ["started_at", "run_id"], F.col("candidates")).select("run_id", "total")


@query(f"with {_F} select run_id, bool_or(degraded) as any_degraded, count(*) as candidates, count(distinct phash) as hashes, count_if(include_flag) as included from f group by 1")
def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).groupBy("run_id").agg(F.bool_or("degraded").alias("any_degraded"), F.count("*").alias("candidates"), F.countDistinct("phash").alias("hashes"), F.count_if("include_flag").alias("included"))


@query("""
select video_id, unnest(range(0, floor(duration_s / 90)::bigint + 1))::int as k, unnest(range(0, floor(duration_s / 90)::bigint + 1)) * 90.0::double as timestamp_s
from videos where duration_s is not null and not isnan(duration_s) and duration_s >= 0""")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.uniform_grid(table(spark, sf_dir, "videos"), "video_id", "duration_s", 90.0).select("video_id", "k", "timestamp_s")


@query("select video_id, idx, title from videos where idx between 3 and 50")
def playlist_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "videos").where("idx between 3 and 50").select("video_id", "idx", "title")


@query("select video_id, count(*) as cues, (sum(length(text)))::bigint as chars from (select distinct cue_id, video_id, text from cues) group by 1")
def cue_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_rows(spark, sf_dir, "cues", "cue_id", "video_id", "text").groupBy("video_id").agg(F.count("*").alias("cues"), F.sum(F.char_length("text")).alias("chars"))


def _numbered_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with texts that caption files can hold, ordered within their video."""
    said = _cues(spark, sf_dir).withColumn("text", tx.collapse_ws(F.regexp_replace("text", "[<>]", ""))).where("text != '' and start_ms >= 0 and end_ms >= start_ms")
    return said.select("video_id", "cue_id", "start_ms", "end_ms", "text")


_N = f"{_C}, t as (select video_id, cue_id, start_ms, end_ms, {squeezed("regexp_replace(text, '[<>]', '', 'g')")} as text from c), q as (select * from t where text <> '' and start_ms >= 0 and end_ms >= start_ms)"


#: A caption file holds an hour of a video, so that a stream of any length comes in many.
_HOUR = ["video_id", "hour"]


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_cues(spark, sf_dir).withColumn("hour", F.expr("start_ms div 3600000"))


def _read_back(files: DataFrame, value: str, parse) -> DataFrame:
    named = files.select(F.concat_ws("/", "video_id", F.col("hour").cast("string")).alias("path"), F.col(value).alias("value"))
    return parse(named).select(F.regexp_extract("path", "^(.*)/", 1).alias("video_id"), "start_ms", "end_ms", "text")


@query(f"with {_N} select video_id, start_ms, end_ms, text from q")
def captions_json3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues written as JSON captions and read back, between blank events that don't count."""
    cues = _hourly(spark, sf_dir)
    blank = cues.select("video_id", "hour", (F.col("cue_id") + F.lit(1 << 40)).alias("cue_id"), "start_ms", "end_ms", F.lit(" \n").alias("text"))
    files = render.json3_files(cues.select(*blank.columns).unionByName(blank), _HOUR, ["start_ms", "cue_id"])
    return _read_back(files, "json", captions.json3_cues)


@query(f"with {_N}, l as (select *, lag(text) over (partition by video_id, start_ms // 3600000 order by start_ms, cue_id) as before from q) select video_id, start_ms, end_ms, text from l where before is distinct from text")
def captions_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues written as WebVTT and read back: repeated texts go."""
    return _read_back(render.vtt_files(_hourly(spark, sf_dir), _HOUR, ["start_ms", "cue_id"]), "vtt", captions.vtt_cues)


@query(f"with {_N} select video_id, start_ms, least(end_ms, lead(start_ms) over (partition by video_id, start_ms // 3600000 order by start_ms, cue_id))::bigint as end_ms, text from q")
def captions_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues clamped to the next one, written as SubRip and read back."""
    return _read_back(render.srt_files(_hourly(spark, sf_dir), _HOUR, ["start_ms", "cue_id"]), "srt", captions.srt_cues)


@query("""
with n as (select video_id, video_id || x as name, x from videos, (values ('.en.vtt'), ('.en.json3'), ('.en-orig.json3')) v(x) where not (x = '.en.json3' and idx % 3 = 0) and not (x = '.en.vtt' and idx % 6 = 0))
select video_id, name from (select *, row_number() over (partition by video_id order by x <> '.en.json3') as r from n where x not like '%-orig%') where r = 1""")
def caption_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual captions before automatic ones, JSON before WebVTT."""
    kinds = F.explode(F.array(F.lit(".en.vtt"), F.lit(".en.json3"), F.lit(".en-orig.json3")))
    files = table(spark, sf_dir, "videos").select("video_id", "idx", kinds.alias("x")).where("not (x = '.en.json3' and idx % 3 = 0) and not (x = '.en.vtt' and idx % 6 = 0)")
    return captions.pick_captions(files.select("video_id", F.concat("video_id", "x").alias("name")))


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9가-힣]+'))"
_ALIGN = f"""
ac as (
  select video_id, row_number() over (partition by video_id order by seq, start_s) as i, start_s, end_s, words
  from (select distinct video_id, seq, start_s, end_s, text, {_WORDS} as words from cues where start_s is not null and end_s is not null and video_id is not null and seq is not null) where len(words) > 0),
ap as (
  select video_id, p_idx, row_number() over (partition by video_id order by p_idx) as j, words
  from (select video_id, p_idx, {_WORDS} as words from paragraphs where video_id is not null and p_idx is not null) where len(words) > 0),
ar as (
  select distinct video_id, 1::bigint as i, 1::bigint as j, null::double as s, null::double as e, null::bigint as out_p, null::double as out_s, null::double as out_e from ap
  union all
  select video_id, case when near or s is null then i + 1 else i end, case when near then j else j + 1 end, case when near then coalesce(s, c_s) end, case when near then c_e end,
    case when not near then p_idx end, case when not near then coalesce(s, c_s) end, case when not near then case when s is null then c_e else e end end
  from (
    select ar.*, ap.p_idx, ac.start_s as c_s, ac.end_s as c_e, len(list_intersect(ac.words, ap.words))::double / len(ac.words) >= 0.4::double as near
    from ar join ac on ac.video_id = ar.video_id and ac.i = ar.i join ap on ap.video_id = ar.video_id and ap.j = ar.j)),
al as (
  select video_id, out_p as p_idx, out_s as start_s, out_e as end_s from ar where out_p is not null
  union all
  select ar.video_id, ap.p_idx, ar.s, ar.e from ar join ap on ap.video_id = ar.video_id and ap.j = ar.j left join ac on ac.video_id = ar.video_id and ac.i = ar.i where ar.s is not null and ac.i is null)
"""


@query(f"with recursive {_ALIGN} select video_id, p_idx, start_s, end_s from al")
def paragraph_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretch of cues each paragraph was said in."""
    return joins.align_paragraphs(distinct_rows(spark, sf_dir, "cues", "video_id", "seq", "start_s", "end_s", "text"), table(spark, sf_dir, "paragraphs"))


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


_CLOCK = "lpad((sec // 60 % 60)::varchar, 2, '0') || ':' || lpad((sec % 60)::varchar, 2, '0')"
_LINK = _esc("'https://www.youtube.com/watch?v=' || video_id || '&t=' || sec")
_BODY = f"""
{_F}, p as (select video_id, p_idx, text, start_s, round(start_s * 1000)::bigint as s, round(end_s * 1000)::bigint as e from paragraphs),
j as (select f.video_id, f.frame_id, coalesce(min(p_idx), -1) as p_idx from f left join p on f.video_id = p.video_id and round(timestamp_s * 1000)::bigint >= s and round(timestamp_s * 1000)::bigint < e group by all),
fig as (
  select video_id, p_idx, timestamp_s, frame_id, '<figure data-timestamp="' || lpad((sec // 3600)::varchar, 2, '0') || ':' || {_CLOCK} || '"><a class="image-wrap" href="' || {_LINK} || '" target="_blank" rel="noopener"><img src="'
    || {_esc("replace(replace(url_encode(coalesce(path, '')), '%2F', '/'), '%7E', '~')")} || '" alt="' || {_esc("coalesce(alt_text, '')")} || '" loading="lazy"></a><figcaption><span class="caption-text">' || {_esc("coalesce(caption, '')")}
    || '</span><a class="ts-chip" href="' || {_LINK} || '" target="_blank" rel="noopener">'
    || case when sec >= 3600 then (sec // 3600)::varchar || ':' || {_CLOCK} else (sec // 60)::varchar || ':' || lpad((sec % 60)::varchar, 2, '0') end || '</a></figcaption></figure>' as figure, alt_text, caption, path, sec
  from (select f.*, j.p_idx, floor(timestamp_s)::bigint as sec from f join j using (video_id, frame_id) where include_flag and timestamp_s is not null)),
figs as (
  select video_id, p_idx, case when count(*) > 1 then '<div class="figure-row" data-count="' || least(count(*), 3) || '">' || string_agg(figure, '' order by timestamp_s, frame_id) || '</div>' else string_agg(figure, '') end as figures
  from fig group by 1, 2),
parts as (
  select coalesce(t.video_id, figs.video_id) as video_id, coalesce(t.p_idx, figs.p_idx) as p_idx, t.video_id is null as tail, figures,
    '<p' || case when t.at is not null then ' data-srt-start="' || floor(t.at)::bigint || '"' else '' end || '>' || {_esc("coalesce(t.text, '')")} || '</p>' as p
  from (TEXTS) t full join figs on t.video_id = figs.video_id and t.p_idx = figs.p_idx),
body as (
  select video_id, string_agg(case when tail then '<section class="tail-section"><h2>Additional frames</h2>' || figures || '</section>' else p || coalesce(chr(10) || '    ' || figures, '') end, chr(10) || '    ' order by tail, p_idx) as body
  from parts where video_id is not null group by 1)
"""


def _included(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir).where("include_flag").join(_placed(spark, sf_dir), ["video_id", "frame_id"])
    return frames.select("video_id", "frame_id", "p_idx", "timestamp_s", "path", "alt_text", "caption")


@query("with " + _BODY.replace("TEXTS", "select video_id, p_idx, text, start_s as at from p") + "select video_id, body from body")
def blog_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts: paragraphs with the frames that fall into them."""
    return render.post_bodies(table(spark, sf_dir, "paragraphs").where("video_id is not null"), _included(spark, sf_dir))


_LABEL = r"regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', '')"


@query(
    f"with recursive {_ALIGN}, "
    + _BODY.replace("TEXTS", "select p.video_id, p.p_idx, p.text, al.start_s as at from p left join al on al.video_id = p.video_id and al.p_idx = p.p_idx")
    + f"""
select video_id, '<!doctype html>' || chr(10) || '<html lang="en"><head><meta charset="utf-8"><title>' || {_esc("coalesce(title, 'Untitled')")} || '</title></head><body><article><header class="post-hero"><h1 class="post-title">'
  || {_esc("coalesce(title, 'Untitled')")} || '</h1><div class="post-meta"><a class="source-pill" href="' || {_esc("url")} || '">' || {_esc(f"case when length({_LABEL}) > 48 then left({_LABEL}, 45) || '…' else {_LABEL} end")}
  || '</a></div></header><div class="post-body">' || body || '</div></article></body></html>' || chr(10) as html
from body join videos using (video_id)"""
)
def blog_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages: paragraphs start where they were said, by the alignment to the cues, with the frames that fall into them."""
    said = paragraph_alignment(spark, sf_dir).select(F.col("video_id").alias("_v"), F.col("p_idx").alias("_p"), "start_s")
    paragraphs = table(spark, sf_dir, "paragraphs").where("video_id is not null").select("video_id", "p_idx", "text")
    started = paragraphs.join(said, (F.col("video_id") == F.col("_v")) & (F.col("p_idx") == F.col("_p")), "left").drop("_v", "_p")
    bodies = render.post_bodies(started, _included(spark, sf_dir)).join(table(spark, sf_dir, "videos").select("video_id", "title", "url"), "video_id")
    return bodies.select("video_id", render.page(F.coalesce("title", F.lit("Untitled")), F.col("url"), F.lit("en"), F.col("body")).alias("html"))


def stub_ranker(prompt: str, frames: list[dict]) -> list[dict]:
    """A stand-in for a vision model: judges a frame by its number, and fails where nothing is said around the batch."""
    if not prompt:
        raise ValueError("nothing is said here")
    return [{"include": f["frame_index"] % 3 != 0, "alt_text": f"frame {f['frame_index']}", "caption": prompt[:20], "confidence": (f["frame_index"] % 10) / 10} for f in frames]


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of answers, by hash: what first attempts have seen."""
    first = table(spark, sf_dir, "runs").where("attempt = 1").select("run_id")
    seen = _frames(spark, sf_dir).where("phash is not null").join(first, "run_id", "left_semi").select("phash").distinct()
    bits = F.bit_count("phash")
    return seen.select(F.col("phash").alias("hash"), (bits % 2 == 0).alias("include"), F.lit("known").alias("alt_text"), F.lit("from the cache").alias("caption"), (bits / 64.0).alias("confidence"), F.lit(False).alias("degraded"))


@query(f"""
with {_F}, {_B}, {_C},
w as (select video_id, run_id, batch, min(round(timestamp_s * 1000)::bigint) as w0, max(round(timestamp_s * 1000)::bigint) as w1 from b group by all),
wt as (select run_id, batch, string_agg(text, ' ' order by start_ms, cue_id) as said from w join c on w.video_id = c.video_id and end_ms >= w0 and start_ms <= w1 and start_ms <= end_ms where text is not null group by all),
known as (select distinct phash from f join runs using (run_id) where attempt = 1 and phash is not null),
x as (
  select b.run_id, b.batch, frame_id::int as frame_index, timestamp_s, phash, coalesce(phash in (select phash from known), false) as cached, coalesce(said, '') as said
  from b join runs using (run_id) left join wt on wt.run_id = b.run_id and wt.batch = b.batch where attempt > 1),
a as (
  select run_id, frame_index, timestamp_s, cached, not cached and said = '' as degraded,
    case when cached then bit_count(phash) % 2 = 0 when said = '' then true else frame_index % 3 <> 0 end as include,
    case when cached then 'from the cache' when said = '' then '' else left(said, 20) end as caption,
    case when cached then bit_count(phash) / 64.0::double when said = '' then 0.0::double else (frame_index % 10) / 10.0::double end as confidence
  from x),
n as (
  select *, bool_or(degraded) over (partition by run_id) as failed, row_number() over (partition by run_id order by timestamp_s, frame_index) - 1 as i, count(*) over (partition by run_id) as cnt,
    row_number() over (partition by run_id, include order by confidence desc, timestamp_s, frame_index) as best
  from a)
select run_id, frame_index, timestamp_s, confidence, caption, degraded, cached from n
where (not failed and include and best <= 10) or (failed and (cnt <= 10 or list_contains(list_transform(range(10), lambda j: floor(j * (cnt / 10.0::double))::bigint), i)))""")
def rank_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of later attempts in batches, those the cache doesn't know judged by a stand-in model from what is said around them; the ten best per run."""
    later = table(spark, sf_dir, "runs").where("attempt > 1").select("run_id")
    batched = _batched(spark, sf_dir).join(later, "run_id", "left_semi")
    frames = batched.select(F.col("run_id").alias("video_id"), "batch", F.col("frame_id").cast("int").alias("frame_index"), "timestamp_s", F.col("phash").alias("hash"))
    prompt = tx.render_prompt(F.lit("{transcript_window}"), F.lit(""), F.lit(""), F.col("window_text"))
    prompts = _window_texts(spark, sf_dir).select(F.col("run_id").alias("video_id"), "batch", prompt.alias("prompt"))
    ranked = models.rank_frames(frames, prompts, _answers(spark, sf_dir), stub_ranker, timeout=None, sleep=lambda _: None)
    return models.choose_frames(ranked, 10).select(F.col("video_id").alias("run_id"), "frame_index", "timestamp_s", "confidence", "caption", "degraded", "cached")


@query(f"""
with {_F}, old as (select phash, max(frame_id) as last_frame from f join runs using (run_id) where attempt = 1 and phash is not null group by 1),
new as (select phash, frame_id as last_frame, confidence from f join runs using (run_id) where attempt > 1 and phash is not null and not coalesce(degraded, false) and not isnan(coalesce(confidence, 0))),
both_ as (select phash, last_frame, null::double as confidence from old union all select * from new)
select phash, arg_max(coalesce(confidence, -1), last_frame) as confidence, max(last_frame) as last_frame from both_ group by 1""")
def ranker_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of first attempts with the answers of later ones: the latest of each hash, no degraded ones."""
    runs = table(spark, sf_dir, "runs").select("run_id", "attempt")
    frames = _frames(spark, sf_dir).where("phash is not null").join(runs, "run_id")
    old = frames.where("attempt = 1").groupBy("phash").agg(F.max("frame_id").alias("last_frame")).withColumn("confidence", F.lit(-1.0))
    new = frames.where("attempt > 1 and not isnan(coalesce(confidence, 0))").select("phash", F.col("frame_id").alias("last_frame"), F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), "degraded")
    return models.remember(old, new, "phash", "last_frame").select("phash", "confidence", "last_frame")


@query(
    _KEPT.format(f=_F).replace("select run_id, frame_id from k where keep", "")
    + """, u as (select f.* from f join k using (run_id, frame_id) where k.keep),
t as (select run_id, row_number() over (partition by run_id order by confidence desc, timestamp_s asc nulls last, frame_id) as r from u where include_flag and not isnan(confidence))
select run_id, candidates, coalesce(kept, 0) as kept, coalesce(chosen, 0) as chosen
from (select run_id, count(*) as candidates from f where run_id is not null group by 1) left join (select run_id, count(*) as kept from u group by 1) using (run_id) left join (select run_id, count(*) as chosen from t where r <= 25 group by 1) using (run_id)"""
)
def frame_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames of a run are left after each stage: sampled, without near-duplicates, chosen."""
    frames = _frames(spark, sf_dir).where("run_id is not null")
    unique = frames.join(greedy_hash_dedup(spark, sf_dir), ["run_id", "frame_id"], "left_semi")
    fit = unique.where("include_flag and confidence is not null and not isnan(confidence)")
    best = Window.partitionBy("run_id").orderBy(F.col("confidence").desc(), F.col("timestamp_s").asc_nulls_last(), "frame_id")
    chosen = fit.withColumn("_r", F.row_number().over(best)).where("_r <= 25").groupBy("run_id").agg(F.count("*").alias("chosen"))
    counted = frames.groupBy("run_id").agg(F.count("*").alias("candidates")).join(unique.groupBy("run_id").agg(F.count("*").alias("kept")), "run_id", "left").join(chosen, "run_id", "left")
    return counted.na.fill(0, ["kept", "chosen"])


_PRICE = 0.00036


@query(f"""
select run_id, spent, spent > 0.5::double as over_cap
from (select run_id, (sum(coalesce(candidates, 0)) over (partition by status order by started_at, run_id))::bigint * {_PRICE * 1.3!r}::double as spent from runs where status is not null)""")
def running_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ranked images have cost up to each run, and whether that is more than half a dollar."""
    runs = table(spark, sf_dir, "runs").select("run_id", "status", "started_at", "candidates")
    return tables.running_spend(runs, "status", ["started_at", "run_id"], F.col("candidates"), price=_PRICE, cap=0.5).select("run_id", "spent", "over_cap")


_STRIPPED = f"regexp_replace(raw, '^{RE2_SPACE}+|{RE2_SPACE}+$', '', 'g')"
_NUMERIC = f"regexp_matches(said, '^(?:{RE2_SPACE}|[\\p{{Nd}}:./\\-,▶•])+$')"
_POSTS = "with recursive " + _ALIGN + ", " + _BODY.replace("TEXTS", "select p.video_id, p.p_idx, p.text, al.start_s as at from p left join al on al.video_id = p.video_id and al.p_idx = p.p_idx")


@query(
    _POSTS
    + f""",
told as (select video_id, coalesce(title, 'Untitled') as title, {_LABEL} as label from body join videos using (video_id)),
said as (
  select video_id, 0 as part, false as tail, 0 as p_idx, 0 as sub, null::double as moment, 0::bigint as frame_id, 0 as nth, 'title' as kind, title as raw from told
  union all select video_id, 1, false, 0, 0, null, 0, 0, 'h1', title from told
  union all select video_id, 2, false, 0, 0, null, 0, 0, 'a', case when length(label) > 48 then left(label, 45) || '…' else label end from told
  union all select video_id, 3, false, p_idx, 0, null, 0, 0, 'p', coalesce(text, '') from p where video_id in (select video_id from told)
  union all select video_id, 3, true, -1, 0, null, 0, 0, 'h2', 'Additional frames' from parts where tail and video_id in (select video_id from told)
  union all select video_id, 3, p_idx = -1, p_idx, 1, timestamp_s, frame_id, 0, 'alt', coalesce(alt_text, '') from fig where video_id in (select video_id from told)
  union all select video_id, 3, p_idx = -1, p_idx, 1, timestamp_s, frame_id, 1, 'span', coalesce(caption, '') from fig where video_id in (select video_id from told)),
kept as (select * from (select *, {_STRIPPED} as said from said) where said <> '' and (kind = 'alt' or not {_NUMERIC}))
select video_id, (row_number() over (partition by video_id order by part, tail, p_idx, sub, moment, frame_id, nth) - 1)::int as id, kind, said as text from kept"""
)
def post_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translatable nodes of rendered posts."""
    return html_pages.text_nodes(blog_posts(spark, sf_dir), "video_id")


_FIGURE_MD = (
    "'![' || replace(replace(" + squeezed("coalesce(alt_text, '')") + ", '[', '('), ']', ')') || '](' || replace(replace(url_encode(coalesce(path, '')), '%2F', '/'), '%7E', '~') || ')' || chr(10) || '*' || case when "
    + squeezed("coalesce(caption, '')") + " <> '' then " + squeezed("coalesce(caption, '')") + " || ' — ' else '' end || '[▶ ' || case when sec >= 3600 then (sec // 3600)::varchar || ':' || " + _CLOCK
    + " else (sec // 60)::varchar || ':' || lpad((sec % 60)::varchar, 2, '0') end || '](https://www.youtube.com/watch?v=' || video_id || '&t=' || sec || ')*'"
)


@query(
    _POSTS
    + f""",
told as (select video_id, {squeezed("coalesce(title, 'Untitled')")} as title, url from body join videos using (video_id)),
blocks as (
  select video_id, false as tail, p_idx, 0 as sub, null::double as moment, 0::bigint as frame_id, {squeezed("coalesce(text, '')")} as block from p
  union all select video_id, true, -1, 0, null, 0, '## Additional frames' from parts where tail
  union all select video_id, p_idx = -1, p_idx, 1, timestamp_s, frame_id, {_FIGURE_MD} from fig),
md as (select video_id, string_agg(block, chr(10) || chr(10) order by tail, p_idx, sub, moment, frame_id) as md from blocks where block <> '' group by 1)
select video_id, '---' || chr(10) || 'title: "' || replace(title, '"', chr(39)) || '"' || chr(10) || 'source: ' || url || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || coalesce(chr(10) || chr(10) || md, '') || chr(10) as markdown
from told left join md using (video_id)"""
)
def post_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered posts as Markdown."""
    return blog_posts(spark, sf_dir).select("video_id", html_pages.html_to_markdown("html").alias("markdown"))


@query("select video_id, upper(text) as text, kind from (" + SQL["post_nodes"] + ") where kind <> 'alt'")
def post_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered posts with every node translated by a stand-in that raises the case, written back and read again."""
    pages = blog_posts(spark, sf_dir)
    nodes = html_pages.text_nodes(pages, "video_id").where("kind != 'alt'")
    done = models.translate_nodes(nodes, "video_id", "xx", lambda texts, target: [t.upper() for t in texts], sleep=lambda _: None)
    back = pages.join(done, "video_id", "left").select("video_id", html_pages.write_back("html", "translations").alias("html"))
    return html_pages.text_nodes(back, "video_id").where("kind != 'alt'").select("video_id", "text", "kind")


@query("select video_id, arg_max(run_id, attempt::bigint * 1000000000 + run_id) as run_id, arg_max(status, attempt::bigint * 1000000000 + run_id) as status from runs where video_id is not null group by 1")
def streamed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of every video, by a stream over the files of runs that ends when all are read."""
    place = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/runs.parquet").schema
    incremental.upsert_new(spark, f"{sf_dir}/runs.parque[t]", schema, "video_id", ["attempt", "run_id"], f"{place}/table", f"{place}/checkpoint").awaitTermination()
    newest = incremental.newest_version(spark, f"{place}/table")
    rows = spark.read.schema(schema).parquet(newest) if newest else spark.createDataFrame([], schema)
    return rows.where("video_id is not null").select("video_id", "run_id", "status")
