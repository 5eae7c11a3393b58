"""The queries of the subpackage by name, and their SQL where SQL can state the same on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import language, mixing, nearest, packing, pages, residue, runs, split, topn

SEED = 42


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nearest.frames_to_cues(_t(spark, sf_dir, "frames"), _t(spark, sf_dir, "cues"))
    return pairs.where("cue_id is not null").select("frame_id", "cue_id")


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame, matched or not."""
    return nearest.frames_to_cues(_t(spark, sf_dir, "frames"), _t(spark, sf_dir, "cues")).select("frame_id", "cue_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.paragraph_pieces(_t(spark, sf_dir, "paragraphs"), _t(spark, sf_dir, "size_limits"))
    return pieces.where("piece = 0 and cut is not null").select("para_id", "cut")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.paragraph_pieces(_t(spark, sf_dir, "paragraphs"), _t(spark, sf_dir, "size_limits"))


def p3_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph put together again from the bodies of its pieces, each at its place."""
    body = F.expr("substring(text, overlap + 1)")
    pieces = p3_pieces(spark, sf_dir).where("text is not null").groupBy("para_id").agg(F.array_sort(F.collect_list(F.struct("piece", "start", body.alias("body")))).alias("p"), F.count("*").alias("n_pieces"))
    put = F.aggregate("p", F.lit(""), lambda text, p: F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), p["start"] - F.char_length(text))), p["body"]))
    return pieces.select("para_id", put.alias("text"), (F.col("n_pieces") > 1).alias("was_cut"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.best_frames(_t(spark, sf_dir, "frames")).select("run_id", "frame_id")


def p4_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.best_frames(_t(spark, sf_dir, "frames"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(_t(spark, sf_dir, "cues")).select("first_cue_id", "last_cue_id", "n_cues")


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(_t(spark, sf_dir, "cues"))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cue in its run, where stretches that drift away from their centre are cut."""
    return runs.collapse_runs(_t(spark, sf_dir, "cues"), centre_weight=0.5, min_events=1)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = packing.container_limit(_t(spark, sf_dir, "size_limits"))
    return packing.pack(_t(spark, sf_dir, "documents"), capacity)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.split_documents(p7_packed(spark, sf_dir))


def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens and pieces of each document are placed."""
    return p7_packed(spark, sf_dir).groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = packing.container_limit(_t(spark, sf_dir, "size_limits"))
    return packing.packing_report(p7_packed(spark, sf_dir), capacity)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"), SEED)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"), SEED)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_report(spark, sf_dir).where("short").select("source_name")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_markup(_t(spark, sf_dir, "blog_pages"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.clean_pages(_t(spark, sf_dir, "blog_pages"))


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_segments(_t(spark, sf_dir, "paragraphs"), _t(spark, sf_dir, "lang_labels"), item="para_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_cases(_segmented(spark, sf_dir), "para_id")


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every paragraph with its language and confidence."""
    return _segmented(spark, sf_dir).select("para_id", "label", F.inline("segments"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_spans(_t(spark, sf_dir, "documents")).where(F.size("spans") > 0).select("doc_id")


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_spans(_t(spark, sf_dir, "documents")).select("doc_id", F.inline("spans"))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain when those that windows of residue cover in part are excluded."""
    return residue.exclude_residue(residue.residue_spans(_t(spark, sf_dir, "documents"))).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_nearest, p3_found, p3_pieces, p3_rebuilt, p4_found, p4_ranked, p5_found, p5_runs, p5_segments, p6_found, p6_segments, p7_found, p7_packed, p7_placed, p7_report, p8_found, p8_mix, p8_report, p9_found, p9_spans, p9_kept)}

_MOMENTS = """
with f as (select distinct frame_id, video_id, cast(round(timestamp_s * 1000) as bigint) * 2 as t from frames),
c as (
  select distinct cue_id, video_id,
    case when end_s is null or round(end_s * 1000) < round(start_s * 1000) then cast(round(start_s * 1000) as bigint) * 2
         else cast(round(start_s * 1000) as bigint) + cast(round(end_s * 1000) as bigint) end as m
  from cues where start_s is not null),
best as (
  select f.frame_id, first(c.cue_id order by abs(f.t - c.m), c.m, c.cue_id) as cue_id
  from f join c on f.video_id = c.video_id and c.m between f.t - 4000 and f.t + 4000 group by f.frame_id)
"""
_MIX = rf"""
with d as (
  select lower(trim(source)) as source, doc_id, octet_length(encode(text)) as n, length(text) as chars, length(regexp_replace(text, '\P{{L}}+', '', 'g')) as letters
  from documents where octet_length(encode(text)) > 0),
k as (
  select source, doc_id, n,
    -ln((('0x' || substr(md5(doc_id::varchar || ':{SEED}'), 1, 13))::bigint + 1)::double / 4503599627370497.0::double)
      / greatest(0.05::double, least(1.0::double, letters::double / greatest(chars, 1) * 1.25::double) * least(1.0::double, 0.25::double + chars::double / 266.0::double)) as key
  from d),
total as (select coalesce(sum(n), 0) as t from d),
b as (
  select m.source_name, lower(trim(m.source_name)) as source, target_permille, max_repeats, coalesce(s.n, 0) as tokens, t, (target_permille::hugeint * t) // 1000 as budget
  from mix_targets m cross join total left join (select source, sum(n) as n from d where source is not null group by 1) s on lower(trim(m.source_name)) = s.source),
e as (select *, case when tokens > 0 then least(max_repeats, budget // tokens) else 0 end as epochs from b),
r as (select *, case when epochs < max_repeats then budget - epochs * tokens else 0 end as rest from e),
o as (select r.source, k.doc_id, k.n, r.epochs, r.rest, sum(k.n) over (partition by r.source order by k.key, k.doc_id) as upto from k join r on k.source = r.source),
mix as (
  select source as source_name, doc_id, n::bigint as n_tokens, (epochs + case when rest > 0 and 2 * upto - n <= 2 * rest then 1 else 0 end)::bigint as repeats from o)
"""
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_RANKED = """
with f as (select distinct run_id, frame_id, confidence, timestamp_s from frames
           where include_flag and not isnan(confidence) and confidence between 0 and 1),
r as (select run_id, frame_id, row_number() over (partition by run_id order by confidence desc, timestamp_s asc nulls last, frame_id) as rank from f)
"""
_RUNS = r"""
with c as (
  select distinct cue_id, video_id, cast(round(start_s * 1000) as bigint) as t0, text,
    greatest(cast(round(start_s * 1000) as bigint), coalesce(cast(round(end_s * 1000) as bigint), cast(round(start_s * 1000) as bigint))) as t1
  from cues where start_s is not null and regexp_matches(text, '[\p{L}\p{N}]')),
o as (
  select *, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w, row_number() over v as i,
    lag(t1) over v as p1, lag(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) over v as pw
  from c window v as (partition by video_id order by t0, cue_id)),
e as (
  select *,
    len(list_filter(range(1, least(len(w), len(pw)) + 1), lambda k: w[1:k] = pw[1:k])) as head,
    len(list_filter(range(1, least(len(w), len(pw)) + 1), lambda k: w[len(w) - k + 1:] = pw[len(pw) - k + 1:])) as tail
  from o),
s as (
  select *, case when i > 1 and t0 - p1 <= 5000 and (w = pw or (len(w) >= 4 and len(pw) >= 4 and abs(len(w) - len(pw)) <= 1
    and head + tail >= greatest(len(w), len(pw)) - 1)) then 0 else 1 end as fresh from e),
g as (select *, sum(fresh) over (partition by video_id order by t0, cue_id) as run from s),
r as (
  select video_id, first(cue_id order by t0, cue_id) as first_cue_id, last(cue_id order by t0, cue_id) as last_cue_id, count(*) as n_cues,
    min(t0) / 1000.0::double as start_s, max(t1) / 1000.0::double as end_s, (max(t1) - min(t0)) / 1000.0::double as duration_s
  from g group by video_id, run having count(*) > 1)
"""
SQL = {
    "p2_found": _MOMENTS + "select frame_id, cue_id from best",
    "p2_nearest": _MOMENTS + "select distinct f.frame_id, best.cue_id from f left join best using (frame_id)",
    "p3_found": rf"""
with t as (select para_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) as text from paragraphs where text is not null),
s as (select para_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?]) ', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1))) as s from t where length(text) > 700),
w as (select para_id, length(trim(s)) as n, list_max(list_transform(string_split(trim(s), ' '), lambda x: length(x))) as longest from s)
select para_id, case when max(n) <= 700 then 'sentence' when max(case when n > 700 then longest else 0 end) > 700 then 'char' else 'word' end as cut from w group by para_id""",
    "p3_rebuilt": rf"""
with t as (select para_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) as text from paragraphs where text is not null)
select para_id, text, length(text) > (select max_size from size_limits where limit_name = 'paragraph_piece') as was_cut from t""",
    "p4_found": _RANKED + "select run_id, frame_id from r where rank <= 5",
    "p4_ranked": _RANKED + "select run_id, frame_id, rank from r where rank <= 5",
    "p5_found": _RUNS + "select first_cue_id, last_cue_id, n_cues from r",
    "p5_runs": _RUNS + "select * from r",
    "p7_found": "select doc_id from documents where octet_length(encode(text)) > (select max_size from size_limits where limit_name = 'container')",
    "p7_placed": """
with n as (select doc_id, octet_length(encode(text))::bigint as tokens from documents where octet_length(encode(text)) > 0)
select doc_id, tokens, (tokens + m - 1) // m as pieces from n, (select max_size as m from size_limits where limit_name = 'container')""",
    "p8_mix": _MIX + "select source_name, doc_id, repeats, n_tokens from mix where repeats > 0",
    "p8_report": _MIX
    + """
select r.source_name, target_permille, max_repeats, tokens::bigint as source_tokens, budget::bigint as budget, target_permille::hugeint * t <= 1000 * max_repeats * tokens::hugeint as reachable,
  coalesce(g, 0)::bigint as mixed_tokens, (tokens = 0 or epochs >= max_repeats) and 1000 * coalesce(g, 0) < target_permille::hugeint * t as short,
  coalesce(documents, 0) as documents, coalesce(most, 0) as most_repeats,
  round(1000.0::double * coalesce(g, 0) / greatest(t, 1), 3) as reached_permille, round(1000.0::double * coalesce(g, 0) / greatest(sum(coalesce(g, 0)) over (), 1), 3) as mix_permille
from r left join (select source_name as s, sum(repeats * n_tokens) as g, count(*) as documents, max(repeats) as most from mix where repeats > 0 group by 1) x on r.source = x.s""",
    "p8_found": """
with n as (select lower(trim(source)) as s, sum(coalesce(octet_length(encode(text)), 0)) as n from documents group by 1)
select source_name from mix_targets m left join n on lower(trim(m.source_name)) = n.s
where target_permille * (select sum(n) from n) > 1000 * max_repeats * coalesce(n.n, 0)""",
}
