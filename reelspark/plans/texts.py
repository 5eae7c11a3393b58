"""Queries on texts: scalars, sentences, chunks, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import text as tx
from reelspark.operators import models, segments
from reelspark.operators.render import transcript_md, transcript_name
from reelspark.plans.registry import RE2_SPACE, query, squeezed, table
from reelspark.sources import captions

_SENTENCES = r"""
with t as (select video_id, p_idx, """ + squeezed("text") + r""" as text from paragraphs where text is not null and video_id is not null),
s as (select video_id, p_idx, string_split(regexp_replace(text, '([.?!。]) ', '\1' || chr(1), 'g'), chr(1)) as parts from t),
f as (select video_id, p_idx, list_filter(list_transform(parts, lambda x: trim(x)), lambda x: x <> '') as parts from s),
u as (select video_id, p_idx, unnest(parts) as text, generate_subscripts(parts, 1) - 1 as cue_idx from f),
n as (select *, length(text) as n, sum(length(text)) over (partition by video_id, p_idx) as total, sum(length(text)) over (partition by video_id, p_idx order by cue_idx) as upto from u),
c as (select video_id, p_idx, cue_idx, text, p_idx * 60000 + floor(60000 * (upto - n) / total)::bigint as start_ms, p_idx * 60000 + floor(60000 * upto / total)::bigint as end_ms from n),
d as (select video_id, p_idx, cue_idx, text, start_ms, case when end_ms <= start_ms then start_ms + 200 else end_ms end as end_ms from c)
"""


@query(_SENTENCES + "select video_id, p_idx, cue_idx::int as cue_idx, start_ms::bigint as start_ms, least(end_ms, lead(start_ms) over (partition by video_id order by p_idx, cue_idx))::bigint as end_ms, text from d")
def transcript_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of every paragraph, one minute each, none ending behind the start of the next."""
    return segments.transcript_cues(table(spark, sf_dir, "paragraphs"), "video_id", "p_idx", "text", 60_000)


@query(_SENTENCES + "select video_id, p_idx as chunk, cue_idx::int as cue_idx, start_ms::bigint as start_ms, end_ms::bigint as end_ms, text from d")
def audio_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of audio chunks, as a stand-in hears them: it reads the bytes as text."""
    chunks = table(spark, sf_dir, "paragraphs").where("text is not null and video_id is not null").select("video_id", F.col("p_idx").alias("chunk"), F.encode("text", "UTF-8").alias("audio"))
    return models.transcribed_cues(chunks, lambda audio: audio.decode())


@query(rf"""
select doc_id, (generate_subscripts(parts, 1) - 1)::int as i, unnest(parts) as sentence
from (select doc_id, string_split(regexp_replace(text, '([.!?。！？]){RE2_SPACE}+', '\1' || chr(1), 'g'), chr(1)) as parts from documents where text is not null)""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(segments.sentences("text")).alias("i", "sentence"))


_GROUPS = rf"""
t as (select doc_id, {squeezed('text')} as text from documents where text is not null),
s as (
  select doc_id, unnest(parts) as s, generate_subscripts(parts, 1) as k
  from (select doc_id, string_split(regexp_replace(text, '([.!?。！？]) ', '\1' || chr(1), 'g'), chr(1)) as parts from t where text <> '')),
wr as (
  select doc_id, k, string_split(s, ' ') as ws, 1 as i, length(string_split(s, ' ')[1]) as size, 0 as line from s where length(s) > 700
  union all
  select doc_id, k, ws, i + 1, case when size + length(ws[i + 1]) + 1 > 700 then length(ws[i + 1]) else size + length(ws[i + 1]) + 1 end, case when size + length(ws[i + 1]) + 1 > 700 then line + 1 else line end
  from wr where i < len(ws)),
pc as (
  select doc_id, k, 0 as line, s as piece from s where length(s) <= 700
  union all select doc_id, k, line, string_agg(ws[i], ' ' order by i) from wr group by doc_id, k, line),
ls as (select doc_id, list(piece order by k, line) as ps, list(length(piece) order by k, line) as ns from pc group by doc_id),
gr as (
  select doc_id, ns, 1 as i, 1 as cnt, ns[1] as size, 0 as g from ls
  union all
  select doc_id, ns, i + 1, case when cnt >= 4 or size >= 700 then 1 else cnt + 1 end, case when cnt >= 4 or size >= 700 then ns[i + 1] else size + ns[i + 1] end, case when cnt >= 4 or size >= 700 then g + 1 else g end
  from gr where i < len(ns))
"""


@query(f"with recursive {_GROUPS} select doc_id, g::int as i, string_agg(ps[gr.i], ' ' order by gr.i) as paragraph from gr join ls using (doc_id) group by doc_id, g")
def paragraph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences wrapped and grouped into paragraphs."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(segments.paragraphs("text")).alias("i", "paragraph"))


_BLOCKS = rf"""
b as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n{RE2_SPACE}*\n', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{RE2_SPACE}+|{RE2_SPACE}+$', '', 'g')), lambda x: x <> '') as bs from documents where text is not null)"""


@query(f"""
with recursive {_BLOCKS},
r as (
  select doc_id, bs, 1 as i, length(bs[1]) as size, 0 as chunk from b where len(bs) > 0
  union all
  select doc_id, bs, i + 1, case when size + length(bs[i + 1]) + 2 > 1500 then length(bs[i + 1]) else size + length(bs[i + 1]) + 2 end,
    case when size + length(bs[i + 1]) + 2 > 1500 then chunk + 1 else chunk end
  from r where i < len(bs)),
g as (select doc_id, chunk, string_agg(bs[i], chr(10) || chr(10) order by i) as text from r group by doc_id, chunk)
select doc_id, chunk::int as chunk, text from g union all select doc_id, 0, '' from b where len(bs) = 0""")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks packed into chunks of at most 1,500 characters."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(segments.chunks("text", 1500)).alias("chunk", "text"))


@query(f"""
with {_BLOCKS}
select d.doc_id, case when len(bs) >= 2 then array_to_string(bs[1:len(bs) // 2], chr(10) || chr(10)) else substring(text, 1, length(text) // 2) end as head,
  case when len(bs) >= 2 then array_to_string(bs[len(bs) // 2 + 1:], chr(10) || chr(10)) else substring(text, length(text) // 2 + 1) end as tail
from documents d join b using (doc_id)""")
def text_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = segments.split_half("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", halves[0].alias("head"), halves[1].alias("tail"))


@query(rf"""
select video_id, {squeezed('title')} as title, regexp_replace(regexp_replace(title, '[/\\:]', '-', 'g'), '^{RE2_SPACE}+|{RE2_SPACE}+$', '', 'g') as name,
  regexp_replace(regexp_replace({squeezed("regexp_replace(regexp_replace(title, '[/\\:?#&+%]', '-', 'g'), '[\"''<>(){}\\[\\]|]', '', 'g')")}, '-{{2,}}', '-', 'g'), '^[ -]+|[ -]+$', '', 'g') as url_name,
  left(case when x = '' then 'untitled' else x end, 120) as file_name
from (select *, regexp_replace({squeezed("regexp_replace(title, '[\\/:*?\"<>|#%&{}\\[\\]\\x00-\\x1f]+', ' ', 'g')")}, '^[. ]+|[. ]+$', '', 'g') as x from videos)""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "videos").select(
        "video_id", tx.collapse_ws("title").alias("title"), tx.safe_name("title").alias("name"), tx.safe_name_url("title").alias("url_name"), tx.safe_name_file("title").alias("file_name")
    )


_RATIO = "case when length(regexp_replace(text, '[^\\p{{L}}{r}]', '', 'g')) > 0 then length(regexp_replace(text, '[^{r}]', '', 'g'))::double / length(regexp_replace(text, '[^\\p{{L}}{r}]', '', 'g')) end"


@query(
    "select doc_id, "
    + ", ".join(
        f"{_RATIO.format(r=r)} as {c}_ratio, coalesce({_RATIO.format(r=r)} > 0.5, false) as is_{c}"
        for c, r in (("ko", "\\x{ac00}-\\x{d7a3}"), ("ja", "\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}"), ("zh", "\\x{4e00}-\\x{9fff}"), ("ru", "\\x{0400}-\\x{04ff}"), ("ar", "\\x{0600}-\\x{06ff}"), ("en", "a-zA-Z"))
    )
    + " from documents"
)
def script_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [x for c in ("ko", "ja", "zh", "ru", "ar", "en") for x in (tx.script_ratio("text", c).alias(f"{c}_ratio"), tx.already_target("text", c).alias(f"is_{c}"))]
    return table(spark, sf_dir, "documents").select("doc_id", *cols)


@query("""
select doc_id, len(t)::int as n_tokens, array_to_string(list_sort(t), ' ') as tokens
from (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9가-힣]+')) as t from documents where text is not null)""")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.tokens("text").alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query("""
select distinct frame_id, len(list_intersect(list_distinct(regexp_extract_all(lower(alt_text), '[a-z0-9가-힣]+')), list_distinct(regexp_extract_all(lower(caption), '[a-z0-9가-힣]+'))))::int as shared
from frames where alt_text is not null and caption is not null""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "frames").where("alt_text is not null and caption is not null")
    return frames.select("frame_id", F.size(F.array_intersect(tx.tokens("alt_text"), tx.tokens("caption"))).alias("shared")).distinct()


@query(r"""
select video_id, regexp_extract(url, '(?:v=|youtu\.be/)([A-Za-z0-9_\-]{11})', 1) as from_url,
  case lower(trim(lang)) when 'en' then 'en' when 'english' then 'en' when 'ru' then 'ru' when 'russian' then 'ru' when 'ja' then 'ja' when 'japanese' then 'ja' when '日本語' then 'ja'
    when 'ko' then 'ko' when 'korean' then 'ko' when '한국어' then 'ko' end as code,
  case when length(u) > 48 then left(u, 45) || '…' else u end as label,
  replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped
from (select *, regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', '') as u from videos)""")
def video_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "videos").select(
        "video_id", tx.video_id("url").alias("from_url"), tx.target_code("lang").alias("code"), tx.source_label("url").alias("label"), tx.html_escape("title").alias("escaped")
    )


@query(r"""
select distinct frame_id, regexp_matches(caption, '^[\s\d:./\-,▶•]+$') as numeric_only, regexp_replace(alt_text, '<[^>]+>', '', 'g') as bare,
  replace(replace(trim(regexp_replace(alt_text, '\s+', ' ', 'g')), '[', '('), ']', ')') as md_alt, replace(replace(url_encode(path), '%2F', '/'), '%7E', '~') as quoted
from frames""")
def caption_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "frames").select(
        "frame_id", tx.numeric_only("caption").alias("numeric_only"), tx.strip_tags("alt_text").alias("bare"), tx.md_alt_safe("alt_text").alias("md_alt"), tx.url_quote("path").alias("quoted")
    ).distinct()


@query("select distinct frame_id, 1 as frame_index, include_flag as include, alt_text, confidence, cast(null as varchar) as error, 'wrong length' as error2 from frames where not isnan(confidence)")
def ranker_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a model gives them, in a code fence, parsed; and checked against a wrong length."""
    frames = table(spark, sf_dir, "frames").where("confidence is not null and not isnan(confidence)").select("frame_id", "include_flag", "alt_text", "confidence").distinct()
    item = F.struct(F.lit(1).alias("frame_index"), F.col("include_flag").alias("include"), "alt_text", "confidence")
    answer = F.concat(F.lit("```json\n"), F.to_json(F.array(item)), F.lit("\n```"))
    parsed = frames.select("frame_id", tx.parse_ranker_json(answer, 1).alias("a"), tx.parse_ranker_json(answer, 2)["error"].alias("error2"))
    one = F.get("a.items", F.lit(0))
    return parsed.select("frame_id", one["frame_index"].alias("frame_index"), one["include"].alias("include"), one["alt_text"].alias("alt_text"), one["confidence"].alias("confidence"), F.col("a.error").alias("error"), "error2")


@query(r"""
select video_id, '---' || chr(10) || 'title: "' || replace(coalesce(title, ''), '"', '''') || '"' || chr(10) || 'source: ' || url || chr(10) || '---' || chr(10) as head,
  'From 0 to ' || coalesce(cast(cast(duration_s as int) as varchar), '') || ': ' || coalesce(title, '') as prompt,
  regexp_matches(lower(list_extract(['gpt-5-mini', 'o3', 'GPT-4o', 'gemini-2.5-flash', 'O1-preview', 'o5'], 1 + coalesce(idx, 0) % 6)), '^(gpt-5|o[1-4])') as reasoning
from (select video_id, title, url, idx, case when isnan(duration_s) then null else floor(duration_s) end as duration_s from videos)""")
def prompt_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = tx.prompt_body(F.lit("notes\n---From {window_start} to {window_end}: {transcript_window}"))
    models_named = F.array(*[F.lit(m) for m in ("gpt-5-mini", "o3", "GPT-4o", "gemini-2.5-flash", "O1-preview", "o5")])
    model = F.get(models_named, F.coalesce("idx", F.lit(0)) % 6)
    whole = F.when(~F.isnan("duration_s"), F.floor("duration_s").cast("int").cast("string"))
    return table(spark, sf_dir, "videos").select(
        "video_id", tx.frontmatter("title", "url").alias("head"), tx.render_prompt(template, F.lit("0"), whole, F.col("title")).alias("prompt"), tx.is_reasoning_model(model).alias("reasoning")
    )


_STUB_SKIP = "coalesce(length(regexp_replace(text, '[^\\x{ac00}-\\x{d7a3}]', '', 'g'))::double / nullif(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 0) > 0.5, false)"


@query(f"""
with {_BLOCKS}
select d.doc_id, {_STUB_SKIP} as skipped, case when {_STUB_SKIP} or text is null then text else lower(array_to_string(bs, chr(10) || chr(10))) end as translated
from documents d left join b using (doc_id)""")
def translate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation into Korean by a stand-in that lowers the case and cuts long answers short; Korean texts are copied."""
    done = models.translate(table(spark, sf_dir, "documents").select("doc_id", "text"), "ko", lambda text, target: (text.lower(), len(text) > 3000 and "\n\n" in text), sleep=lambda _: None)
    return done.select("doc_id", "skipped", "translated")


_NUMBER = "case when idx is null then '' else lpad(idx::varchar, greatest(2, length(idx::varchar))::int, '0') || '{s}' end"
_TRANSCRIPTS = rf"""
tr as (
  select v.video_id, {_NUMBER.format(s=" - ")} || regexp_replace(regexp_replace(coalesce(title, ''), '[/\\:]', '-', 'g'), '^\s+|\s+$', '', 'g') as name,
    rtrim('# ' || {_NUMBER.format(s=". ")} || coalesce(title, '') || chr(10) || chr(10) || '[YouTube](' || url || ')' || chr(10) || chr(10) || string_agg(p.text, chr(10) || chr(10) order by p_idx)) || chr(10) as markdown
  from videos v join paragraphs p on v.video_id = p.video_id where p.text is not null group by v.video_id, idx, title, url)
"""


@query(f"with {_TRANSCRIPTS} select video_id, name, markdown from tr")
def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown file per video: a file is one value, so its paragraphs meet in one row."""
    videos = table(spark, sf_dir, "videos").select("video_id", "idx", F.coalesce("title", F.lit("")).alias("title"), "url")
    texts = table(spark, sf_dir, "paragraphs").where("text is not null").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("p_idx", "para_id", "text"))).alias("p"))
    rows = videos.join(texts, "video_id")
    return rows.select("video_id", transcript_name(F.col("idx"), F.col("title")).alias("name"), transcript_md(F.col("idx"), F.col("title"), F.col("url"), F.transform("p", lambda x: x["text"])).alias("markdown"))


@query(f"""
with b as (select video_id, p_idx, {squeezed('text')} as text from paragraphs where text is not null and video_id in (select video_id from videos)),
s as (select * from b where text <> '')
select video_id, (row_number() over (partition by video_id order by p_idx) - 1)::int as i, text as paragraph from s""")
def transcript_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of transcripts, written as files and read back."""
    clean = table(spark, sf_dir, "paragraphs").select("video_id", "p_idx", tx.collapse_ws("text").alias("text")).where("text != ''")
    texts = clean.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("p_idx", "text"))).alias("p"))
    videos = table(spark, sf_dir, "videos").select("video_id", "idx", tx.collapse_ws(F.coalesce("title", F.lit(""))).alias("title"), "url")
    files = videos.join(texts, "video_id").select("video_id", transcript_md(F.col("idx"), F.col("title"), F.col("url"), F.transform("p", lambda x: x["text"])).alias("markdown"))
    return files.select("video_id", F.posexplode(captions.md_paragraphs("markdown")).alias("i", "paragraph"))


@query(f"""
with l as (select video_id, regexp_replace(coalesce(title, ''), '\\n', ' ', 'g') as title, row_number() over (order by published_at, video_id) as idx from videos)
select idx::int as idx, video_id, title from l""")
def playlist_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing lines, id and title apart by a tab, read back in order; lines without a tab don't count."""
    stamp = F.lpad(F.unix_micros(F.col("published_at").cast("timestamp")).cast("string"), 20, "0")
    lines = table(spark, sf_dir, "videos").select(F.concat_ws(" ", stamp, "video_id").alias("line_no"), F.concat("video_id", F.lit("\t"), F.regexp_replace(F.coalesce("title", F.lit("")), "\n", " ")).alias("value"))
    noise = lines.select("line_no", F.lit("[download] no tab here").alias("value"))
    return captions.playlist_entries(lines.unionByName(noise))


@query(r"""
select video_id, case lower(trim(lang)) when 'en' then 'en' when 'english' then 'en' when 'ru' then 'ru' when 'russian' then 'ru' when 'ja' then 'ja' when 'japanese' then 'ja' when '日本語' then 'ja' when 'ko' then 'ko' when 'korean' then 'ko'
    when '한국어' then 'ko' else regexp_replace(lower(lang), '\s+', '-', 'g') end as slug,
  idx * 0.002::double * 1.3::double as cost, case when idx % 2 = 0 then 'OPS/text/c ' || idx || '.xhtml' else 'OPS/img/x.png' end as file, case when idx % 2 = 0 then 'p' || idx end as anchor,
  coalesce(idx, 0) as items, case when idx % 2 = 0 then null else 'wrong length' end as payload_error, idx % 2 = 0 as first_text
from videos where idx is not null""")
def listing_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, costs, links resolved against the folder of a chapter, and translated payloads in their three shapes."""
    n = F.col("idx").cast("string")
    href = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("./c%20"), n, F.lit(".xhtml#p"), n)).otherwise("../img/x.png#")
    items = F.to_json(F.array(F.struct(F.lit(0).alias("id"), F.lit("t").alias("text")), F.struct(F.lit(1).alias("id"), F.lit("u").alias("text"))))
    shape = F.when(F.col("idx") % 3 == 0, items).when(F.col("idx") % 3 == 1, F.concat(F.lit('{"items": '), items, F.lit("}"))).otherwise(F.concat(F.lit('```json\n{"translations": '), items, F.lit("}\n```")))
    payload = tx.translated_payload(shape, F.when(F.col("idx") % 2 == 0, 2).otherwise(3))
    rows = table(spark, sf_dir, "videos").where("idx is not null")
    at = tx.resolve_href(href, F.lit("OPS/text"))
    return rows.select(
        "video_id", tx.slug("lang").alias("slug"), tx.est_cost("idx", 0.002).alias("cost"), at["file"].alias("file"), at["anchor"].alias("anchor"), F.coalesce("idx", F.lit(0)).alias("items"),
        payload["error"].alias("payload_error"), F.coalesce(F.get(payload["items"], F.lit(0))["text"] == "t", F.lit(False)).alias("first_text"),
    )
