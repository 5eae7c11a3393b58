"""Queries on rendered pages and their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import text as tx
from reelspark.operators import html_pages, models, paths, render, tables
from reelspark.operators.ordered import numbered
from reelspark.plans.registry import SQL, query, table


@query(r"select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as bare from blog_pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "blog_pages").select("page_id", tx.strip_tags("html").alias("bare"))


@query()
def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages.text_nodes(table(spark, sf_dir, "blog_pages"), "page_id")


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages.mirror(table(spark, sf_dir, "blog_pages"))


@query()
def html_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with every text node replaced by a stand-in's translation."""
    pages = table(spark, sf_dir, "blog_pages").select("page_id", "html")
    done = models.translate_nodes(html_pages.text_nodes(pages, "page_id"), "page_id", "xx", lambda texts, target: [t.upper() for t in texts], sleep=lambda _: None)
    return pages.join(done, "page_id", "left").select("page_id", html_pages.write_back("html", "translations").alias("html"))


_FIGURE = r'<figure[^>]*data-timestamp="(\d+:\d\d:\d\d)"[^>]*><a[^>]*><img src="([^"]*)"'
_FIGURES = f"""
fr as (
  select page_id, nullif(regexp_extract(html, '[?&]v=([A-Za-z0-9_-]{{11}})', 1), '') as video_id, unnest(regexp_extract_all(html, '{_FIGURE}', 1)) as ts, unnest(regexp_extract_all(html, '{_FIGURE}', 2)) as src from blog_pages),
fg as (select page_id, video_id, (split_part(ts, ':', 1)::int * 3600 + split_part(ts, ':', 2)::int * 60 + split_part(ts, ':', 3)::int)::int as timestamp_s, url_decode(replace(src, '&amp;', '&')) as path from fr)
"""


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages.page_figures(table(spark, sf_dir, "blog_pages"), "page_id")


@query(f"with {_FIGURES} select page_id, count(*) as figures, sum(timestamp_s)::bigint as seconds from fg group by 1")
def page_figure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _figures(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("figures"), F.sum("timestamp_s").alias("seconds"))


@query(f"""
with {_FIGURES}
select path, page_id, timestamp_s, dense_rank() over (order by first_page, path) as image_no, n as occurrences
from fg join (select path, min(page_id) as first_page, count(*) as n from fg group by 1) using (path)""")
def image_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of every image, with how often it occurs; images are numbered as they are first seen."""
    seen = _figures(spark, sf_dir).select("path", "page_id", "timestamp_s")
    images = seen.groupBy("path").agg(F.min("page_id").alias("first_page"), F.count("*").alias("occurrences")).withColumn("_k", F.lit(0))
    numbers = numbered(images, "_k", ["first_page", "path"], "image_no").select(F.col("path").alias("_p"), "image_no", "occurrences")
    return seen.join(numbers, F.col("path") == F.col("_p")).drop("_p")


_TREE = r"""
with f as (select distinct path from blog_pages where path ilike '%.html' and not regexp_matches(path, '(^|/)\.') and not regexp_matches(path, '(^|/)(__pycache__|_run_summary\.json|index\.html)(/|$)')),
d as (select path, string_split(path, '/') as p from f),
a as (select path, array_to_string(p[1:i], '/') as folder from d, range(1, 20) r(i) where i < len(p)),
hidden as (select distinct a.path from a where folder in (select regexp_replace(path, '(?i)\.html$', '') from f)),
v as (select * from f where path not in (select path from hidden)),
n as (select path, 'file' as type, 1::bigint as file_count from v union all select folder, 'dir', count(*) from a where path in (select path from v) group by folder)
"""


@query(_TREE + "select path, regexp_replace(path, '/?[^/]*$', '') as parent, regexp_extract(path, '[^/]*$') as name, type, file_count from n")
def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.tree_nodes(table(spark, sf_dir, "blog_pages"))


@query(_TREE + "select path, type from n where (type = 'file' and lower(regexp_extract(path, '[^/]*$')) like '%field%') or (type = 'dir' and path in (select folder from a where lower(regexp_extract(path, '[^/]*$')) like '%field%' and path in (select path from v)))")
def page_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.filter_tree(paths.tree_nodes(table(spark, sf_dir, "blog_pages")), "field").select("path", "type")


@query(_TREE + """
, s as (select path, regexp_replace(path, '/?[^/]*$', '') as parent, regexp_extract(path, '[^/]*$') as name, type from n where type = 'dir'),
o as (select *, row_number() over (partition by parent order by lower(name), name) as position, count(*) over (partition by parent) as c from s)
select path, position, lpad(position::varchar, greatest(2, length(c::varchar))::int, '0') as number from o""")
def folder_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders numbered among their siblings."""
    folders = paths.tree_nodes(table(spark, sf_dir, "blog_pages")).where("type = 'dir'").withColumn("low", F.lower("name"))
    return render.page_numbers(folders, "parent", ["low", "name"]).select("path", "position", "number")


@query(r"""
with f as (select distinct frame_id, path from frames where path is not null), n as (select frame_id, path, row_number() over (partition by path order by frame_id) as k from f)
select frame_id, case when k = 1 then path else regexp_replace(path, '\.[^.]*$', '') || '_' || (k - 1)::varchar || regexp_extract(path, '\.[^.]*$') end as unique_name from n""")
def unique_frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "frames").where("path is not null").select("frame_id", "path").distinct()
    return paths.unique_names(frames, None, "path", ["frame_id"]).select("frame_id", "unique_name")


@query("""
with o as (select page_id as id, length(html) as size from blog_pages where page_id % 2 = 0)
select page_id from blog_pages where page_id not in (select id from o where size > 0)""")
def pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a finished output: here every second page has one."""
    pages = table(spark, sf_dir, "blog_pages")
    done = pages.where("page_id % 2 = 0").select("page_id", F.char_length("html").alias("size"))
    return tables.pending(pages, done, "page_id").select("page_id")


_DIGIT = r"regexp_extract(path, '(\d)\.[A-Za-z]+$', 1)"


@query(f"""
with {_FIGURES},
w as (select *, case when {_DIGIT} in ('0', '1') then null when {_DIGIT} in ('2', '3', '4') then 1280 else 1920 end as width from fg),
g as (select video_id, list_reduce([0::bigint] || list(timestamp_s::bigint), lambda x, y: gcd(x, y)) as g from fg where video_id is not null group by 1),
u as (select w.*, case when g > 0 then g else 5 end as interval_s from w join g using (video_id) where width is null or width < 1920)
select u.path, u.video_id, timestamp_s, interval_s, timestamp_s // interval_s as grid_index, case when timestamp_s <= coalesce(case when isnan(duration_s) then null else duration_s end, -1) then 'upgrade' else 'failed' end as state
from u left join videos using (video_id)""")
def figure_upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which figures to take again, by widths that go with their names, and from which place of the grid."""
    figures = _figures(spark, sf_dir)
    digit = F.regexp_extract("path", r"(\d)\.[A-Za-z]+$", 1)
    widths = figures.select("path").distinct().withColumn("width", F.when(digit.isin("0", "1"), F.lit(None)).when(digit.isin("2", "3", "4"), F.lit(1280)).otherwise(F.lit(1920)))
    return tables.upgrade_plan(figures, widths, table(spark, sf_dir, "videos").where("not isnan(duration_s)"))


@query("select state, count(*) as n from (" + SQL["figure_upgrades"] + ") group by 1")
def upgrade_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.status_counts(figure_upgrades(spark, sf_dir), "state")


_SHOWN = r"not regexp_matches(path, '(^|/)\.[^/]*/') and not regexp_matches(path, '(^|/)(__pycache__|_run_summary\.json|index\.html)/')"
_HIDDEN = r"regexp_matches(path, '(^|/)(\.[^/]*|__pycache__|_run_summary\.json|index\.html)$')"


@query(f"""
select count_if(not {_HIDDEN} and path ilike '%.html' and html is not null) as md, count_if(not {_HIDDEN} and not path ilike '%.html') as copied, count_if({_HIDDEN}) as skipped,
  count_if(not {_HIDDEN} and path ilike '%.html' and html is null) as failed
from (select path, html from blog_pages where path is not null and {_SHOWN}
  union all select regexp_replace(path, '\\.html$', '.jpg'), null from blog_pages where path is not null and {_SHOWN} and page_id % 3 = 0
  union all select regexp_replace(path, '[^/]*$', 'index.html'), html from blog_pages where path is not null and {_SHOWN} and page_id % 5 = 0
  union all select path, null from blog_pages where path is not null and {_SHOWN} and page_id % 7 = 0)""")
def mirror_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of a mirror are pages, copies, hidden or broken; beside the pages stand images, listings and empty pages."""
    pages = table(spark, sf_dir, "blog_pages").select("page_id", "path", "html")
    none = F.lit(None).cast("string").alias("html")
    files = (
        pages.select("path", "html")
        .unionByName(pages.where("page_id % 3 = 0").select(F.regexp_replace("path", r"\.html$", ".jpg").alias("path"), none))
        .unionByName(pages.where("page_id % 5 = 0").select(F.regexp_replace("path", "[^/]+$", "index.html").alias("path"), "html"))
        .unionByName(pages.where("page_id % 7 = 0").select("path", none))
    )
    return html_pages.mirror_totals(html_pages.mirror(files))


@query(_TREE + """
, s as (select path, regexp_replace(path, '/?[^/]*$', '') as parent, regexp_extract(path, '[^/]*$') as name, type from n)
select path, type, row_number() over (partition by parent order by case when type = 'dir' then 0 else 1 end, lower(name), name) as position from s""")
def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every folder and file in its place among its siblings: folders first, then by name."""
    nodes = paths.tree_nodes(table(spark, sf_dir, "blog_pages"))
    keyed = nodes.withColumns({f"_o{i}": c for i, c in enumerate(paths.tree_order())})
    return numbered(keyed, "parent", ["_o0", "_o1", "_o2"], "position").select("path", "type", "position")
