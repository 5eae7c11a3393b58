import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspark.operators import dedup, html_pages, joins, models, paths, render, segments, tables
from reelspark.operators.ordered import numbered, ordered
from reelspark.plans import texts


def test_ordered_over_many_partitions(spark):
    random.seed(1)
    rows = [(random.choice(["hot"] * 6 + ["a", "b", None]), i, random.randint(0, 9)) for i in range(3000)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    got = {(r.k, r.i): (r.prev, r.total) for r in ordered(df, "k", ["i"], lag={"prev": "v"}, running={"total": F.col("v")}).collect()}
    expected, last = {}, {}
    for k, i, v in sorted((r for r in rows if r[0] is not None)):
        before, total = last.get(k, (None, 0))
        expected[k, i] = (before, total + v)
        last[k] = (v, total + v)
    assert got == expected
    lead = {(r.k, r.i): r.nxt for r in ordered(df, "k", ["i"], lag={"nxt": "i"}, descending=True).collect()}
    assert sum(v is None for v in lead.values()) == 3 and all(v is None or v > i for (_, i), v in lead.items())
    assert numbered(df.where("false"), "k", ["i"]).count() == 0


def test_cues(spark):
    chunks = spark.createDataFrame([("v", 0, "Hello there. 10 of 20! x"), ("v", 1, " "), ("v", 2, None)], "video_id string, c int, text string")
    cues = segments.interpolated_cues(chunks, ["video_id", "c"], "text", F.col("c") * 60000, F.lit(60000)).orderBy("cue_idx").collect()
    assert [r.text for r in cues] == ["Hello there.", "10 of 20!", "x"]
    assert cues[0].start_ms == 0 and all(r.end_ms > r.start_ms for r in cues) and cues[-1].end_ms == 60000
    raw = spark.createDataFrame([("v", 1, 0, 9), ("v", 2, 5, 8), ("w", 1, 0, 3)], "k string, n int, s int, e int")
    assert sorted(r.e for r in segments.clamp_to_next(raw, "k", "s", "e", ["n"]).collect()) == [3, 5, 8]


def test_repeats_batches_samples(spark):
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate(["a", "a", " ", "a", "b", None, "a"])], "k string, i int, t string")
    assert [r.i for r in segments.drop_repeats(rows, "k", ["i"], "t").orderBy("i").collect()] == [0, 4, 6]
    many = spark.createDataFrame([("k", i) for i in range(25)], "k string, i int")
    assert [r["count"] for r in segments.batches(many, "k", ["i"], 10).groupBy("batch").count().orderBy("batch").collect()] == [10, 10, 5]
    for n in (1, 7, 25, 40):
        assert segments.even_sample(many, "k", ["i"], n).count() == min(n, 25)
    picked = sorted(r.i for r in segments.even_sample(many, "k", ["i"], 6).collect())
    assert picked == [int(j * (25 / 6)) for j in range(6)]
    grid = segments.uniform_grid(spark.createDataFrame([("v", 15.0), ("n", None), ("x", float("nan"))], "v string, d double"), "v", "d", 7.0).orderBy("k").collect()
    assert [(r.timestamp_s, r.path) for r in grid] == [(0.0, "00_00_00.jpg"), (7.0, "00_00_07.jpg"), (14.0, "00_00_14.jpg")]


def test_halves(spark):
    df = spark.createDataFrame([("a\n\nb\n \nc",), ("abcd",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(segments.split_half("t")).collect()] == [["a", "b\n\nc"], ["ab", "cd"], ["", ""], None]


def test_first_range(spark):
    ranges = spark.createDataFrame([("v", 0, 0, 10), ("v", 1, 10, 20), ("v", 2, 0, 100_000), ("v", 3, 5, 5), ("w", 0, None, 4)], "k string, o int, s int, e int")
    points = spark.createDataFrame([("v", i, x) for i, x in enumerate([5, 10, 19, 99, -1, None, 100_000])] + [("z", 9, 1)], "k string, id int, at int")
    got = joins.first_range(points, ranges, key="k", point_id="id", at=F.col("at"), start=F.col("s"), end=F.col("e"), order="o")
    assert {r.id: r.o for r in got.collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: -1, 5: -1, 6: -1, 9: -1}
    assert {r.o for r in joins.first_range(points, ranges.where("false"), key="k", point_id="id", at=F.col("at"), start=F.col("s"), end=F.col("e"), order="o").collect()} == {-1}


def test_windows_of_cues(spark):
    cues = spark.createDataFrame([("v", "A", 0, 5000), ("v", "B", 5000, 10000), ("v", "C", 10000, 150000)], "k string, t string, s int, e int")
    wins = spark.createDataFrame([("v", 1, 4000, 11000), ("v", 2, 11000, 12000), ("v", 3, 100000, 200000)], "k string, w int, a int, b int")
    pairs = joins.overlapping(wins, cues, key="k", window=["w"], w0=F.col("a"), w1=F.col("b"), start=F.col("s"), end=F.col("e"), columns=["t"])
    assert {r.w: r.window_text for r in joins.window_text(pairs, "k", ["w"], "t", ["cue_start", "t"]).collect()} == {1: "A B C", 2: "C", 3: "C"}


def test_alignment(spark):
    said = ["hello world", "good morning all", "", "now the second part", "of the talk"]
    cues = spark.createDataFrame([("v", i, i * 4.0, i * 4.0 + 3, t) for i, t in enumerate(said)], "video_id string, seq int, start_s double, end_s double, text string")
    paras = spark.createDataFrame([("v", 0, "Hello world, good morning all."), ("v", 1, "---"), ("v", 2, "Now the second part of the talk."), ("v", 3, "more")], "video_id string, p_idx int, text string")
    assert sorted((r.p_idx, r.start_s, r.end_s) for r in joins.align_paragraphs(cues, paras).collect()) == [(0, 0.0, 7.0), (2, 12.0, 19.0)]


def test_lookup_defaults(spark):
    lookup = spark.createDataFrame([("f", "a", "A", 1), ("f", "b", "B", 2)], "file string, anchor string, crumb string, seq int")
    left = spark.createDataFrame([("f", "b"), ("f", None), ("g", "a")], "file string, anchor string")
    got = joins.with_default(left, lookup, ["file", "anchor"], "crumb", "file", "seq").collect()
    assert {(r.file, r.anchor): r.crumb for r in got} == {("f", "b"): "B", ("f", None): "A", ("g", "a"): None}


@settings(deadline=None, max_examples=8)
@given(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(0, 40), max_size=30), st.integers(0, 6))
def test_greedy_dedup_is_the_loop(spark, hashes, threshold):
    kept: list[tuple[int, int]] = []
    for i, h in enumerate(hashes):
        if all(((h ^ k) & (2**64 - 1)).bit_count() > threshold for _, k in kept):
            kept.append((i, h))
    df = spark.createDataFrame([("g", i, h) for i, h in enumerate(hashes)] + [("g", 99, None), (None, 98, 1)], "g string, i int, h long")
    got = dedup.greedy_dedup(df, key="g", order=["i"], item="i", hash_="h", threshold=threshold)
    assert sorted(r.i for r in got.collect()) == [i for i, _ in kept]


HTML = """<html><head><title>T</title></head><body><h1 class="post-title">A "B"</h1><div class="post-meta"><a href="u">x</a></div><div class="post-body"><!-- no -->
<p>One <b>two</b> <a href="l">three</a><br>four</p><h3>Head</h3><ul><li>a<ul><li>b</li></ul></li></ul><ol><li>x</li></ol><hr><blockquote>q
r</blockquote><figure data-timestamp="00:01:05"><img src="i/a b.jpg" alt="x [y]"><figcaption><span class="caption-text">Cap</span><a class="ts-chip" href="d">1:05</a></figcaption></figure>
<code>skip</code><p>unclosed</div></body></html>"""


def test_html(spark):
    md = html_pages.to_markdown(HTML)
    assert md.startswith("---\ntitle: \"A 'B'\"\nsource: u\n---\n\n# A \"B\"\n\nOne **two** [three](l) four\n\n### Head\n\n- ab\n\n1. x\n\n---\n\n> q r\n\n![x (y)](i/a%20b.jpg)\n*Cap — [▶ 1:05](d)*")
    assert md.rstrip().endswith("unclosed")
    assert html_pages.to_markdown("<p>x</p>").strip().endswith("# Untitled")
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id int, html string")
    nodes = html_pages.text_nodes(pages, "page_id").orderBy("id").collect()
    assert [n.kind for n in nodes][:4] == ["title", "h1", "a", "p"] and "skip" not in {n.text for n in nodes} and "1:05" not in {n.text for n in nodes}
    back = pages.where("page_id = 1").select(html_pages.write_back("html", F.expr("map(0, 'Neu', 1, 'Kopf')"))).first()[0]
    assert "<title>Neu</title>" in back and ">Kopf</h1>" in back and "three" in back
    assert [(r.timestamp_s, r.path) for r in html_pages.page_figures(pages, "page_id").collect()] == [(65, "i/a b.jpg")]


def test_posts(spark):
    paras = spark.createDataFrame([("v", 0, "p<1", 0.5), ("v", 1, "p2", None)], "video_id string, p_idx int, text string, start_s double")
    frames = spark.createDataFrame([("v", 0, 9.0, "d/f2.jpg", "a", "c", 2), ("v", 0, 5.0, "d/f 1.jpg", "a", "c", 1), ("v", -1, 99.0, "d/f3.jpg", None, None, 3)], "video_id string, p_idx int, timestamp_s double, path string, alt_text string, caption string, frame_id int")
    body = render.post_bodies(paras, frames).first().body
    order = [body.index(x) for x in ('<p data-srt-start="0">p&lt;1', 'data-count="2"', "f%201.jpg", "f2.jpg", "<p>p2", "Additional frames", "f3.jpg")]
    assert order == sorted(order) and 't=9"' in body
    whole = spark.range(1).select(render.page(F.lit("T&"), F.lit("https://www.x.y/z"), F.lit("en"), F.lit(body))).first()[0]
    assert "<title>T&amp;</title>" in whole and ">x.y/z</a>" in whole


def test_trees(spark):
    files = spark.createDataFrame([("b/X.html",), ("b/X/asset.html",), ("b/.h/y.html",), ("a.txt",), ("c/d/Y.html",), ("index.html",)], "path string")
    nodes = paths.tree_nodes(files)
    assert {(r.path, r.type, r.file_count) for r in nodes.collect()} == {("b", "dir", 1), ("b/X.html", "file", 1), ("c", "dir", 1), ("c/d", "dir", 1), ("c/d/Y.html", "file", 1)}
    assert {r.path for r in paths.filter_tree(nodes, "y").collect()} == {"c", "c/d", "c/d/Y.html"}
    assert [r.name for r in nodes.orderBy(*paths.tree_order()).collect()] == ["b", "c", "d", "X.html", "Y.html"]
    names = spark.createDataFrame([(1, "a.png"), (2, "a.png"), (3, "b")], "i int, n string")
    assert [r.unique_name for r in paths.unique_names(names, None, "n", ["i"]).orderBy("i").collect()] == ["a.png", "a_1.png", "b"]


def test_tables(spark):
    old = spark.createDataFrame([("u1", "ok"), ("u2", "failed")], "url string, status string")
    new = spark.createDataFrame([("u2", "ok", "t")], "url string, status string, title string")
    assert {tuple(r) for r in tables.upsert(old, new, "url").select("url", "status").collect()} == {("u1", "ok"), ("u2", "ok")}
    outputs = spark.createDataFrame([("u1", 0), ("u2", 5)], "url string, size int")
    assert [r.url for r in tables.pending(old, outputs, "url").collect()] == ["u1"]
    assert tables.pending(old, outputs, "url", force=True).count() == 2
    times = spark.createDataFrame([("v", 0.0), ("v", 10.9), ("v", 25.0), ("z", 0.0), ("n", None)], "k string, s double")
    assert {r.k: r.interval_s for r in tables.sampling_interval(times, "k", F.col("s")).collect()} == {"v": 5, "z": 5, "n": 5}
    figures = spark.createDataFrame([("a", "v", 10), ("b", "v", 999), ("c", "v", 20)], "path string, video_id string, timestamp_s int")
    widths = spark.createDataFrame([("a", 640), ("c", 1920)], "path string, width int")
    plan = tables.upgrade_plan(figures, widths, spark.createDataFrame([("v", 60.0)], "video_id string, duration_s double"))
    assert {(r.path, r.state) for r in plan.collect()} == {("a", "upgrade"), ("b", "failed")}


def test_models(spark):
    docs = spark.createDataFrame([(1, "one\n\ntwo"), (2, "한국어"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: (r.translated, r.skipped) for r in models.translate(docs, "ko", lambda t, target: (t.upper(), False), limit=4).collect()}
    assert got == {1: ("ONE\n\nTWO", False), 2: ("한국어", True), 3: (None, False)}
    long = "\n\n".join("x" * 300 for _ in range(4))
    assert models.translate_text(long, "de", lambda t, target: (t, len(t) > 800)) == long
    calls = []

    def flaky(prompt, frames):
        calls.append(len(frames))
        if len(frames) > 2:
            raise models.Retryable
        return [{"include": True, "confidence": 1.0} for _ in frames]

    waits = []
    assert len(models.ask_batch(flaky, "", [{"frame_index": i} for i in range(4)], sleep=waits.append)[0]) == 4 and calls == [4] * 5 + [2, 2]
    assert waits == [2, 4, 8, 16]
    batches = spark.createDataFrame([("v", 0, "p", [(i,) for i in range(20)])], "video_id string, batch long, prompt string, frames array<struct<frame_index:int>>")

    def broken(prompt, frames):
        raise TimeoutError

    ranked = models.rank_batches(batches, broken, sleep=lambda _: None).withColumn("timestamp_s", F.col("frame_index"))
    chosen = models.choose_frames(ranked, 6).collect()
    assert len(chosen) == 6 and all(r.include and r.degraded for r in chosen)
    cache = spark.createDataFrame([("h", 0.1, 1)], "phash string, confidence double, at int")
    fresh = spark.createDataFrame([("h", 0.5, 2, False), ("x", 0.0, 2, True)], "phash string, confidence double, at int, degraded boolean")
    assert [(r.phash, r.confidence) for r in models.remember(cache, fresh, "phash", "at").collect()] == [("h", 0.5)]
    hits, misses = joins.cache_split(fresh, cache, "phash")
    assert (hits.count(), misses.count()) == (1, 1)
    nodes = spark.createDataFrame([(1, i, "p", f"t{i}") for i in range(5)] + [(2, 0, "p", "bad")], "page_id int, id int, kind string, text string")
    answers = models.translate_nodes(nodes, "page_id", "de", lambda texts, target: [] if "bad" in texts else [x + target for x in texts], size=2, sleep=lambda _: None)
    assert {r.page_id: (r.translations.get(4), r.errors) for r in answers.collect()} == {1: ("t4de", []), 2: (None, ["0 answers to 1 texts"])}
    audio = spark.createDataFrame([("v", 0, bytearray(b"ab"))], "video_id string, chunk int, audio binary")
    assert models.transcribe(audio, lambda b: b.decode()).first().text == "ab"


def test_streaming(spark, tmp_path):
    from reelspark.streaming import incremental

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    first = spark.createDataFrame([("u1", "failed", 1), ("u2", "ok", 1)], "url string, status string, at int")
    first.write.parquet(source)
    for _ in range(2):
        incremental.process_new(spark, source, first.schema, lambda d: d.where("status = 'ok'"), target, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(target).count() == 1
    run = lambda: incremental.upsert_new(spark, source, first.schema, "url", "at", str(tmp_path / "t"), str(tmp_path / "cp2")).awaitTermination()
    run()
    spark.createDataFrame([("u1", "ok", 2)], first.schema).write.mode("append").parquet(source)
    run()
    assert {(r.url, r.status) for r in spark.read.parquet(str(tmp_path / "t/v=1")).collect()} == {("u1", "ok"), ("u2", "ok")}


def test_spread(spark):
    from reelspark.session import spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(10, numPartitions=cores + 3)).rdd.getNumPartitions() == cores + 3
    shuffled = spark.range(10).groupBy("id").count()
    assert spread(shuffled) is shuffled


def test_transcript_files(spark, tmp_path):
    videos = [(f"v{i}", i, f"T{i}", "u") for i in (7, 42, 99, 100, 123, 1234)] + [("vx", None, "T", "u")]
    spark.createDataFrame(videos, "video_id string, idx int, title string, url string").write.parquet(f"{tmp_path}/videos.parquet")
    spark.createDataFrame([(f"p{v[0]}", v[0], 0, "text") for v in videos], "para_id string, video_id string, p_idx int, text string").write.parquet(f"{tmp_path}/paragraphs.parquet")
    rows = {r.video_id: (r["name"], r.markdown.split("\n")[0]) for r in texts.transcript_files(spark, str(tmp_path)).collect()}
    numbers = {7: "07", 42: "42", 99: "99", 100: "100", 123: "123", 1234: "1234"}
    assert rows == {f"v{i}": (f"{n} - T{i}", f"# {n}. T{i}") for i, n in numbers.items()} | {"vx": ("T", "# T")}


def test_a_hung_model_is_given_up(spark):
    """A time-out ends the attempts at once; the halves are asked once each, and the error stays with the rows."""
    import time as clock

    calls = []

    def hangs(prompt, frames):
        calls.append(len(frames))
        clock.sleep(0.3)
        return [{"confidence": 1.0}] * len(frames)

    got, error = models.ask_batch(hangs, "", [{"frame_index": i} for i in range(4)], timeout=0.05, sleep=lambda _: 1 / 0)
    assert got is None and "TimedOut" in error and calls == [4, 2]


def test_ranking_through_the_cache(spark):
    """Known hashes aren't asked again; a failed batch is flagged and doesn't enter the cache."""
    frames = spark.createDataFrame([("v", 0, 0, 0.0, "h0"), ("v", 0, 1, 5.0, "h1"), ("v", 1, 2, 10.0, "h2"), ("v", 1, 3, 15.0, None)], "video_id string, batch long, frame_index int, timestamp_s double, hash string")
    prompts = spark.createDataFrame([("v", 0, "said")], "video_id string, batch long, prompt string")
    cache = spark.createDataFrame([("h1", True, "a", "c", 0.9, False, 1)], "hash string, include boolean, alt_text string, caption string, confidence double, degraded boolean, at int")

    def model(prompt, asked):
        if prompt == "":
            raise ValueError("down")
        return [{"include": False, "alt_text": prompt, "caption": "", "confidence": 0.1 * f["frame_index"]} for f in asked]

    got = {r.frame_index: r for r in models.rank_frames(frames, prompts, cache, model, sleep=lambda _: None).collect()}
    assert got[1].cached and got[1].confidence == 0.9 and not got[0].cached and got[0].alt_text == "said"
    assert got[2].degraded and got[3].degraded and got[3].include
    answers = spark.createDataFrame([(r.hash, r.include, r.alt_text, r.caption, r.confidence, r.degraded, 2) for r in got.values() if r.hash], cache.schema)
    assert {r.hash for r in models.remember(cache, answers, "hash", "at").collect()} == {"h0", "h1"}


def test_translating_files(spark):
    files = spark.createDataFrame([("a.html", "<p>한국어 글</p>"), ("b.md", "한국어 글"), ("c.txt", "text"), ("d.md", None), ("e.html", "<p>bad</p><p>x</p>")], "path string, value string")

    def model(text, target):
        if text == "bad":
            raise ValueError("no")
        return text.upper() + "!", False

    got = {r.path: (r.translated, r.skipped, r.error) for r in models.translate_files(files, "ko", model, sleep=lambda _: None).collect()}
    assert got["a.html"] == ("<p>한국어 글!</p>", False, None) and got["b.md"] == ("한국어 글", True, None)
    assert got["c.txt"] == ("TEXT!", False, None) and got["d.md"][0] is None
    assert got["e.html"][0] == "<p>bad</p><p>x</p>" and "no" in got["e.html"][2]


def test_providers():
    chat = models.Provider("chat", "gpt-5-mini", lambda r: {"choices": [{"message": {"content": f" {r['reasoning_effort']} "}, "finish_reason": "length"}]})
    assert chat.run("t", "s") == ("high", True)
    other = models.Provider("generate", "m", lambda r: {"candidates": [{"content": {"parts": [{"text": r["contents"]}, {"text": r["thinking_level"]}]}, "finishReason": "STOP"}]})
    assert other.translator()("x", "de") == ("xlow", False)
    assert "reasoning_effort" not in models.Provider("chat", "plain-4", dict).request("t", "s")


def test_names_that_meet_others(spark):
    names = ["a.jpg", "a.jpg", "a_1.jpg", "a.jpg", "b", "b", "a_1.jpg"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(9, None)], "i int, name string")
    got = {r.i: r.unique_name for r in paths.unique_names(rows, None, "name", ["i"]).collect()}
    assert got == {0: "a.jpg", 1: "a_1.jpg", 2: "a_1_1.jpg", 3: "a_2.jpg", 4: "b", 5: "b_1", 6: "a_1_2.jpg", 9: None}
    assert len({v for v in got.values()}) == 8


def test_grid_names_within_a_second(spark):
    videos = spark.createDataFrame([("v", 1.3)], "video_id string, duration_s double")
    assert [r.path for r in segments.uniform_grid(videos, "video_id", "duration_s", 0.4).orderBy("k").collect()] == ["00_00_00.jpg", "00_00_00_1.jpg", "00_00_00_2.jpg", "00_00_01.jpg"]


def test_mirror_states(spark):
    files = spark.createDataFrame([("a/x.html", "<h1>T</h1>"), ("a/y.png", None), (".git/z.html", "x"), ("a/.z.html", "x"), ("b.HTML", None), (None, "x")], "path string, html string")
    rows = {r.out_path: r.state for r in html_pages.mirror(files).collect()}
    assert rows == {"a/x.md": "md", "a/y.png": "copied", "a/.z.html": "skipped", "b.md": "failed"}
    assert tuple(html_pages.mirror_totals(html_pages.mirror(files)).first()) == (1, 1, 1, 1)


def test_running_spend(spark):
    rows = spark.createDataFrame([("k", i, 100) for i in range(4)], "k string, i int, n int")
    got = [(round(r.spent, 4), r.over_cap) for r in tables.running_spend(rows, "k", ["i"], F.col("n"), price=0.001, cap=0.3).orderBy("i").collect()]
    assert got == [(0.13, False), (0.26, False), (0.39, True), (0.52, True)]


def test_near_pairs_at_every_number_of_bands():
    """Hashes within the threshold share bands, however many are asked for; those beyond it needn't."""
    random.seed(6)
    for shared in (1, 2, 3):
        bands = 5 + shared
        cuts = [64 * i // bands for i in range(bands + 1)]
        for _ in range(200):
            a = random.getrandbits(64)
            b = a
            for bit in random.sample(range(64), 5):
                b ^= 1 << bit
            same = sum((a ^ b) >> lo & ((1 << (hi - lo)) - 1) == 0 for lo, hi in zip(cuts, cuts[1:], strict=False))
            assert same >= shared


def test_dedup_of_one_large_key(spark, monkeypatch):
    """The result doesn't depend on how many bands are shared, and equals the loop."""
    random.seed(12)
    base = [random.getrandbits(63) for _ in range(40)]
    rows = []
    for i in range(600):
        h = random.choice(base)
        for bit in random.sample(range(63), random.choice([0, 1, 3, 5, 6, 20])):
            h ^= 1 << bit
        rows.append(("hot" if i % 10 else "cold", i, h))
    kept = {}
    for k, i, h in rows:
        if all((h ^ x).bit_count() > 5 for _, x in kept.get(k, [])):
            kept.setdefault(k, []).append((i, h))
    expected = {(k, i) for k, found in kept.items() for i, _ in found}
    df = spark.createDataFrame(rows, "k string, i int, h long")
    for levels in (((None, 1),), ((None, 2),), ((50, 1), (None, 3))):
        monkeypatch.setattr(dedup, "SHARED_BANDS", levels)
        got = dedup.greedy_dedup(df, key="k", order=["i"], item="i", hash_="h").collect()
        assert {(r.k, r.i) for r in got} == expected


def test_a_hot_key_is_spread(spark):
    """A key with nine tenths of the rows is numbered in several tasks of about the same size."""
    df = spark.range(20_000).selectExpr("case when id % 10 = 0 then cast(id % 7 as string) else 'hot' end as k", "id as i")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few rows would fit one task
    try:
        rows = numbered(df, "k", ["i"])
        assert rows.where("k = 'hot'").agg(F.max("n"), F.countDistinct("n")).first() == (18_000, 18_000)
        spread = df.repartitionByRange("k", "i").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r.n for r in spread)
    assert len(sizes) >= 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_released_tables(spark):
    from reelspark import session

    session.release(spark)
    kept = session.materialize(spark.range(3), "t")
    assert kept.count() == 3 and session.release(spark) == 1 and session.release(spark) == 0


def test_versions_of_a_streamed_table(spark, tmp_path):
    from reelspark.streaming import incremental

    schema = "k string, at int, v int"
    for number, rows in enumerate([[("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], [("b", 5, 4), ("c", 1, 5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        df_schema = spark.read.parquet(f"{tmp_path}/in").schema
        incremental.upsert_new(spark, f"{tmp_path}/in", df_schema, "k", "at", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        assert incremental.newest_version(spark, f"{tmp_path}/out") == f"{tmp_path}/out/v={number}"
    assert incremental.newest_version(spark, f"{tmp_path}/out", 1) == f"{tmp_path}/out/v=0" and incremental.newest_version(spark, f"{tmp_path}/none") is None
    assert {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out/v=1").collect()} == {("a", 2), ("b", 4), ("c", 5)}
