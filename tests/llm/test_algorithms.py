import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspark.llm import mixing, nearest, packing, runs, split, topn

FRAMES = "frame_id long, run_id long, video_id string, timestamp_s double, include_flag boolean, confidence double, text string"
CUES = "cue_id long, video_id string, start_s double, end_s double, text string, loaded_at int, rid string"


def test_nearest_is_brute_force(spark):
    random.seed(2)
    cues = [(i, random.choice("hhhab"), random.randint(0, 90_000) / 1000, None, "x", 0, "clash") for i in range(300)]
    cues = [(i, v, s, None if i % 7 == 0 else s + random.randint(-500, 3000) / 1000, t, l, r) for i, v, s, _, t, l, r in cues]
    cues += cues[:50] + [(900, "h", None, 1.0, "x", 0, "y"), (901, None, 1.0, 1.0, "x", 0, "y"), (902, "h", float("nan"), 1.0, "x", 0, "y")]
    frames = [(i, 1, random.choice("hhhabz"), random.randint(0, 90_000) / 1000, True, 0.5, "t") for i in range(400)]
    frames += frames[:60] + [(800, 1, "h", None, True, 0.5, "t"), (801, 1, None, 2.0, True, 0.5, "t"), (802, 1, "h", float("nan"), True, 0.5, "t")]

    def moment(s, e):
        s, e = round(s * 1000), None if e is None else round(e * 1000)
        return 2 * s if e is None or e < s else s + e

    usable = {(c[0], c[1], moment(c[2], c[3])) for c in cues if c[2] is not None and not math.isnan(c[2]) and c[1]}
    expected = {}
    for f in frames:
        best = None
        if f[2] and f[3] is not None and not math.isnan(f[3]):
            t = 2 * round(f[3] * 1000)
            best = min(((abs(m - t), m, c) for c, v, m in usable if v == f[2] and abs(m - t) <= 4000), default=None)
        expected[f[0]] = best[2] if best else None
    got = nearest.frames_to_cues(spark.createDataFrame(frames, FRAMES).repartition(5), spark.createDataFrame(cues, CUES).repartition(3)).collect()
    assert len(got) == len(expected) and {r.frame_id: r.cue_id for r in got} == expected


def test_nearest_in_a_dense_stretch_and_without_times(spark):
    """Thousands of cues and frames in one block of one video, and as many frames without a time."""
    random.seed(8)
    cues = [(i, "v", float(t) / 1000, None, "x", 0, "r") for i, t in enumerate(random.sample(range(15_000), 4000))]
    frames = [(i, "v", random.randrange(15_000) / 1000 if i % 2 else None, "x") for i in range(8000)]
    df = spark.createDataFrame([f[:3] for f in frames], "frame_id long, video_id string, timestamp_s double")
    got = {r.frame_id: r.cue_id for r in nearest.frames_to_cues(df, spark.createDataFrame(cues, CUES)).collect()}
    at = sorted((round(c[2] * 1000), c[0]) for c in cues)
    for i, _, t, _ in frames:
        if t is None:
            assert got[i] is None
        else:
            t = round(t * 1000)
            assert got[i] == min(at, key=lambda m: (abs(m[0] - t), m))[1] if i % 401 == 0 else got[i] is not None
    assert len(got) == 8000


def test_nearest_ties_and_empty(spark):
    cues = spark.createDataFrame([(7, "v", 1.0, None, "", 0, ""), (5, "v", 3.0, None, "", 0, ""), (4, "v", 3.0, None, "", 0, "")], CUES)
    frames = spark.createDataFrame([(1, 1, "v", 2.0, True, 0.0, ""), (2, 1, "v", 2.001, True, 0.0, ""), (3, 1, "v", 5.0, True, 0.0, ""), (4, 1, "v", 5.001, True, 0.0, "")], FRAMES)
    assert {r.frame_id: r.cue_id for r in nearest.frames_to_cues(frames, cues).collect()} == {1: 7, 2: 4, 3: 4, 4: None}
    assert nearest.frames_to_cues(frames, cues.where("false")).where("cue_id is null").count() == 4
    assert nearest.frames_to_cues(frames.where("false"), cues).count() == 0


def test_top_n_is_brute_force(spark):
    random.seed(3)
    rows = [(i, random.choice([1] * 8 + [2, 3]), "v", random.choice([None, 1.0, 2.0, float("nan")]), random.random() < 0.8, random.choice([0.5, 0.9, 1.0, 1.5, -0.1, None, float("nan")]), "x") for i in range(500)]
    rows += rows[:100] + [(998, None, "v", 1.0, True, 1.0, "x"), (None, 1, "v", 0.0, True, 1.0, "x"), (999, 4, "v", 1.0, None, 1.0, "x")]
    groups = {}
    for f, run, _, t, inc, c, _ in set(rows):
        if inc and f is not None and run and c is not None and 0 <= c <= 1:
            t = None if t is None or math.isnan(t) else t
            groups.setdefault(run, set()).add((-c, t is None, t or 0.0, f))
    df = spark.createDataFrame(rows, FRAMES).repartition(6)
    for n in (1, 5, 1000):
        got = {(r.run_id, r["rank"]): r.frame_id for r in topn.best_frames(df, n).collect()}
        assert got == {(g, i): x[3] for g, members in groups.items() for i, x in enumerate(sorted(members)[:n], 1)}
    assert topn.best_frames(df, 0).count() == 0 and topn.best_frames(df.where("false")).count() == 0


def continues(a, b):
    if b["s"] - a["e"] > 5000:
        return False
    x, y = runs.words(a["t"]), runs.words(b["t"])
    if x == y:
        return True
    if len(x) < 4 or len(y) < 4 or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(p != q for p, q in zip(x, y, strict=True)) == 1
    long, short = (x, y) if len(x) > len(y) else (y, x)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_runs_are_brute_force(spark):
    random.seed(4)
    base = ["one two three four", "one two three four five", "one two THREE four!", "one two six four", "a b", "a b", "a c", "한 두 셋 넷", "한 두 셋 넷 다섯", " ", None, "…"]
    cues, at = [], 0
    for i in range(900):
        at += random.choice([0, 100, 3000, 9000])
        end = random.choice([None, at + 2000, at - 10, at + 500])
        cues.append((i, random.choice("hhhhha"), None if i % 50 == 7 else at / 1000, None if end is None else end / 1000, random.choice(base), 0, "r"))
    expected, by = set(), {}
    for c, v, s, e, t, _, _ in cues:
        if s is not None and t and runs.WORD.search(t):
            s, e = round(s * 1000), s * 1000 if e is None else round(e * 1000)
            by.setdefault(v, []).append({"c": c, "s": s, "e": max(s, e), "t": t})
    for rows in by.values():
        rows.sort(key=lambda r: (r["s"], r["c"]))
        run = [rows[0]]
        for r in [*rows[1:], None]:
            if r and continues(run[-1], r):
                run.append(r)
            else:
                if len(run) > 1:
                    expected.add((run[0]["c"], run[-1]["c"], len(run)))
                run = [r]
    many = cues + cues[:200]
    random.shuffle(many)
    df = spark.createDataFrame(many, CUES).repartition(4)
    got = runs.collapse_runs(df).collect()
    assert {(r.first_cue_id, r.last_cue_id, r.n_cues) for r in got} == expected and len(got) == len(expected) > 20
    assert all(r.duration_s >= 0 for r in got)
    assert runs.collapse_runs(df.where("false")).count() == 0


def cheapest(events, steps, weight):
    """All segmentations of a stretch: the least cost, by trying every cut."""
    best = [0.0]
    for j in range(1, len(events) + 1):
        costs = []
        for i in range(j):
            run = events[i:j]
            centre = min(sum(runs.dissimilarity(c, x) for x in run) for c in run)
            costs.append(best[i] + runs.BOUNDARY_PENALTY + sum(steps[i + 1 : j]) + weight * centre)
        best.append(min(costs))
    return best[-1]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.sampled_from([0.0, 0.3, 1.0, 4.0]))
def test_segmentation_is_optimal(turns, weight):
    """The pruned program finds the cost that trying every cut finds."""
    words, events = ["w0", "w1", "w2", "w3", "w4"], []
    for k, turn in enumerate(turns):
        if turn:
            words = [*words]
            words[(turn + k) % 5] = f"x{k % 3}"
        events.append(tuple(words))
    steps = [0.0, *(runs.step_cost(a, b) for a, b in zip(events, events[1:], strict=False))]
    seg = runs.Segmenter(weight)
    for event, step in zip(events, steps, strict=True):
        seg.add(event, 1, step)
    assert abs(seg.best - cheapest(events, steps, weight)) < 1e-9
    assert [i for i, _ in seg.runs()][1:] == [j for _, j in seg.runs()][:-1]


def test_drift_is_cut_where_it_is_cheapest(spark):
    """Ten equal cues, a drift of one word at a time, ten equal cues: neighbours alone give one run, centres cut it."""
    first, last = "a b c d e f".split(), "p q r s t u".split()
    texts = [first] * 10 + [last[:k] + first[k:] for k in range(1, 6)] + [last] * 10
    rows = [(f"c{i:03d}", "v", float(i), i + 0.5, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "cue_id string, video_id string, start_s double, end_s double, text string").repartition(5)
    whole = runs.collapse_runs(df).collect()
    assert [(r.first_cue_id, r.last_cue_id, r.n_cues) for r in whole] == [("c000", "c024", 25)]
    parts = sorted(runs.collapse_runs(df, centre_weight=1.0, min_events=1).collect())
    steps = [0.0, *(runs.step_cost(tuple(a), tuple(b)) for a, b in zip(texts, texts[1:], strict=False))]
    seg = runs.Segmenter(1.0)
    widest = 0
    for t, step in zip(texts, steps, strict=True):
        seg.add(tuple(t), 1, step)
        widest = max(widest, len(seg.open))
    assert abs(seg.best - cheapest([tuple(t) for t in texts], steps, 1.0)) < 1e-9 and widest > 1
    assert [r.n_cues for r in parts] == [j - i for i, j in seg.runs()] and len(parts) > 1


def test_one_run_over_all_partitions(spark):
    df = spark.range(5000).select(F.col("id").alias("cue_id"), F.lit("h").alias("video_id"), (F.col("id") / 10).alias("start_s"), F.lit(None).cast("double").alias("end_s"), F.lit("same").alias("text"))
    assert [tuple(r)[1:4] for r in runs.collapse_runs(df.repartition(7)).collect()] == [(0, 4999, 5000)]


@settings(deadline=None, max_examples=120)
@given(st.text(alphabet="ab .!。 ", max_size=400) | st.text(alphabet="abcdefgh", min_size=30, max_size=200), st.integers(5, 60), st.integers(0, 4))
def test_pieces_are_a_round_trip(text, limit, overlap):
    text = " ".join(text.split())
    pieces = split.split_text(text, limit, overlap)
    assert all(len(p["text"]) <= limit for p in pieces) and all(p["overlap"] <= overlap for p in pieces)
    bodies = [p["text"][p["overlap"] :] for p in pieces]
    assert "".join("".join(bodies).split()) == "".join(text.split())
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert text[b["start"] - b["overlap"] : b["start"]] == b["text"][: b["overlap"]] and a["start"] < b["start"]
    if pieces[0]["cut"] == "sentence":
        assert all(text[: p["start"]].rstrip()[-1] in ".!?。！？" for p in pieces[1:])
    elif pieces[0]["cut"] == "word":
        assert all(text[p["start"] - 1] == " " or text[p["start"] - 1] in "。！？" for p in pieces[1:])


def test_split_cases(spark):
    s = "x" * 699 + "."
    rows = [(1, f"{s} {s}"), (2, "w " * 600), (3, "y" * 1500), (4, " "), (5, None), (6, s), (7, "한국어. " * 300), (1, f"{s} {s}"), (8, "a" * 200_000)]
    df = spark.createDataFrame(rows, "para_id long, text string").withColumn("piece", F.lit("clash"))
    got = split.split_oversized(df, item="para_id", text="text", limit=700, overlap=80)
    cuts = {r.para_id: r.cut for r in got.where("piece = 0").collect()}
    assert cuts == {1: "sentence", 2: "word", 3: "char", 4: None, 5: None, 6: None, 7: "sentence", 8: "char"}
    sizes = got.groupBy("para_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("m")).collect()
    by = {r.para_id: (r.n, r.m) for r in sizes}
    assert by[1][0] == 4 and by[2][0] == 2 and by[3][0] == 3 and by[5] == (1, None) and by[8][0] == math.ceil((200_000 - 700) / 620) + 1
    assert split.split_oversized(df.where("false"), item="para_id", text="text", limit=700, overlap=80).count() == 0


@settings(deadline=None, max_examples=80)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20), st.sampled_from([(8, 16, 32, 64), (16,), (), (24, 100)]))
def test_packing_plan(counts, tiers):
    plan = packing.plan_packing(counts, 64, tiers)
    held, loads = {}, {}
    for run in plan:
        assert run.size in packing.tier_edges(64, tiers) and run.count > 0
        assert run.room == run.size - sum(n * each for n, each in run.contents) >= 0
        for n, each in run.contents:
            assert n <= run.size
            held[n] = held.get(n, 0) + each * run.count
    assert held == counts
    placed, boxes = {}, {}
    for size, rank, items, each, first, window_size, fill, per, first_window, first_box, _ in packing.placements(plan, 64, 4):
        assert placed.get(size, 0) == rank
        placed[size] = rank + items
        for j in range(items):
            window = first + j // each
            loads[window] = loads.get(window, 0) + size
            box = first_box + (window - first_window) // per
            boxes[box] = boxes.get(box, 0) + size
        assert fill <= window_size
    assert placed == counts and all(v <= 64 for v in boxes.values()) and sum(boxes.values()) == sum(n * c for n, c in counts.items())
    assert len(boxes) <= max(1, 2 * math.ceil(sum(boxes.values()) / 64)) or not counts
    # Windows of a short tier are as full as asked for and make whole containers.
    for size in {r.size for r in plan} - {64}:
        assert sum(r.count for r in plan if r.size == size) % (64 // size) == 0
        assert all(r.room <= (1 - packing.LEAST_FILL) * size for r in plan if r.size == size)


def test_tiers_change_the_plan():
    """Tiers build windows of their own length, and gaps of long windows are filled from shorter tiers."""
    counts = {40: 10, 24: 3, 16: 50, 8: 41, 5: 7}
    tiered, plain = packing.plan_packing(counts, 64, (16, 32, 64)), packing.plan_packing(counts, 64, ())
    assert tiered != plain and {r.size for r in tiered} == {64, 16} and {r.size for r in plain} == {64}
    assert any(dict(r.contents).get(40) and len(r.contents) > 1 for r in tiered)
    assert sum(r.count for r in tiered if r.size == 16) % 4 == 0


def test_pack(spark):
    random.seed(5)
    texts = ["x" * random.choice([1, 7, 7, 7, 16, 16, 40, 63, 64, 65, 200]) for _ in range(400)] + [None, "", "é" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("rank", F.lit(2))
    packed = packing.pack(docs, 64, step_size=4, tiers=(16, 64))
    rows = packed.collect()
    tokens, windows, boxes, groups = {}, {}, {}, {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
        windows.setdefault(r.window, []).append(r)
        boxes.setdefault(r.container, []).append(r)
        groups.setdefault(r.step_group, set()).add(r.container)
        assert r.n_tokens <= r.tier <= r.window_size or r.window_size == 64
    assert tokens == {i: len(t.encode()) for i, t in enumerate(texts) if t}
    assert all(sum(r.n_tokens for r in x) == x[0].window_fill <= x[0].window_size for x in windows.values())
    assert all(sum(r.n_tokens for r in x) <= 64 and len({r.window_size for r in x}) == 1 for x in boxes.values())
    assert all(len(x) <= 4 for x in groups.values()) and {16, 64} == {r.window_size for r in rows}
    assert {r.doc_id for r in packing.split_documents(packed).collect()} == {i for i, t in enumerate(texts) if t and len(t.encode()) > 64}
    report = {r.window_size: r for r in packing.packing_report(packed, 64).collect()}
    assert sum(r.containers for r in report.values()) == len(boxes) and report[64].share_used > 0.95 and report[16].share_used > 0.98
    assert all(r.heaviest_group <= 4 * 64 for r in report.values())
    assert packing.pack(docs.where("false"), 64).count() == 0


def test_ranks_of_a_hot_length(spark, monkeypatch):
    """One length that holds most rows is ranked in several tasks, without gaps."""
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 50)
    docs = spark.range(1000).selectExpr("id as doc_id", "case when id % 10 = 0 then 'abc' else 'abcdefgh' end as text")
    rows = packing.pack(docs, 16).collect()
    assert len(rows) == 1000 and len({r.window for r in rows}) >= 450 and all(r.window_fill <= 16 for r in rows)


def test_mix(spark):
    docs = [(i, random.choice(["word ", "1234 "]) * random.randint(1, 40), " Blog" if i % 2 else "BLOG ") for i in range(300)]
    docs += [(1000 + i, "rare text", "small") for i in range(5)] + [(2000, "no source", None), (2001, None, "small"), (2002, "", "blog"), (None, "x", "blog")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("key", F.lit(1)).withColumn("rest", F.lit(0))
    targets = spark.createDataFrame([("blog", 400, 2), ("small", 300, 3), ("gone", 0, 2), ("none", 300, 1)], "source_name string, target_permille int, max_repeats int")
    report = {r.source_name: r for r in mixing.mix_report(df, targets).collect()}
    total = sum(len((t or "").encode()) for _, t, _ in docs)
    assert report["blog"].reachable and abs(report["blog"].mixed_tokens - 0.4 * total) <= 100
    assert not report["small"].reachable and report["small"].mixed_tokens == 3 * 5 * 9 and report["small"].most_repeats == 3
    assert report["gone"].reachable and not report["none"].reachable and report["none"].mixed_tokens == 0
    one, two = (sorted(map(tuple, mixing.mix(df, targets, 7).collect())) for _ in range(2))
    assert one == two != sorted(map(tuple, mixing.mix(df, targets, 8).collect()))
    assert mixing.mix(df.where("false"), targets).count() == 0


def test_complete_epochs_come_first(spark):
    docs = spark.createDataFrame([(i, "a" * 10, "s") for i in range(10)] + [(99, "b" * 100, "t")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 750, 5)], "source_name string, target_permille int, max_repeats int")
    rows = mixing.mix(docs, targets).collect()  # 150 of 200 tokens: one epoch and half of another
    assert sorted(r.repeats for r in rows) == [1] * 5 + [2] * 5


def test_documents_without_an_id_are_not_drawn(spark):
    docs = spark.createDataFrame([(i, "a" * 10, "s") for i in range(10)] + [(None, "b" * 100, "s")], "doc_id long, text string, source string")
    for most, repeats in ((1, [1] * 10), (2, [1] * 5 + [2] * 5)):  # 150 of 200 tokens; 100 have an id
        targets = spark.createDataFrame([("s", 750, most)], "source_name string, target_permille int, max_repeats int")
        assert sorted(r.repeats for r in mixing.mix(docs, targets).collect()) == repeats
        report = mixing.mix_report(docs, targets).first()
        assert report.source_tokens == 200 and report.reachable and report.mixed_tokens == 10 * sum(repeats)


def test_a_reachable_share_is_not_short(spark):
    """Half of a source's documents, none twice: a little below the share, but not for want of documents."""
    docs = spark.createDataFrame([(i, "a" * 7, "s") for i in range(11)] + [(99, "b" * 90, "t")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 250, 1), ("t", 750, 1)], "source_name string, target_permille int, max_repeats int")
    report = {r.source_name: r for r in mixing.mix_report(docs, targets).collect()}
    assert report["s"].reachable and not report["s"].short and 1000 * report["s"].mixed_tokens != 250 * 167
    assert report["t"].short and not report["t"].reachable


def test_ranges_hold_about_equal_numbers(spark):
    """Whatever the weights of a source, no range of keys holds much more than its part."""
    random.seed(9)
    for weights in ([1.0], [0.05], [1.0, 0.05], [0.05] * 9 + [1.0]):
        keys = sorted(random.expovariate(1) / random.choice(weights) for _ in range(40_000))
        median = keys[20_000]
        df = spark.createDataFrame([(k,) for k in keys], "key double").select(mixing.key_range(F.col("key"), F.lit(median), 100).alias("range"), "key")
        sizes = df.groupBy("range").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("range").collect()
        assert max(r.n for r in sizes) < 10 * 400
        assert all(a.hi < b.lo for a, b in zip(sizes, sizes[1:], strict=False))


def test_a_rest_that_no_range_passes_takes_all(spark):
    keyed = mixing.keyed_documents(spark.createDataFrame([(i, "a" * 10, "s") for i in range(10)], "doc_id long, text string, source string"), 1)
    budgets = spark.createDataFrame([("s", 100, 1, 100)], "source_name string, drawn_tokens long, epochs long, rest long").withColumn("source_tokens", F.col("drawn_tokens"))
    assert [r.repeats for r in mixing._mix(keyed, budgets).collect()] == [2] * 10


def test_pieces_are_added_before_filling():
    """Long sentences that pack badly need 46 pieces where 33 would hold the characters."""
    text = " ".join(["b" * 49 + "."] * 80 + ["a" * 399 + "."] * 40)
    pieces = split.split_text(text, 700, 80)
    bodies = [len(p["text"]) - p["overlap"] for p in pieces]
    assert max(bodies) < 500 and min(bodies) > 300 and all(len(p["text"]) <= 700 for p in pieces)
    assert all(p["overlap"] > 0 for p in pieces[1:])
