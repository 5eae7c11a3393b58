import pytest
from pyspark.sql import functions as F

import random
import re

from reelspark.llm import language, markup, pages, residue, residue_seeds, template


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("plain words", set()),
        ("Prices went from 5$ to 6$, or $5 to $12. C:\\videos\\new and /a/{b,c}", set()),
        ("5 * 3 * 2, a < b, x > 3 && y < 9, #1, Q&A, R&D, [inaudible], [0, 1), my_file_name, ****", set()),
        ("<b>x</b>", {"html"}),
        ("a &amp; b", {"html"}),
        ("<!-- cut -->", {"html"}),
        ("</p> <c.colorE5E5E5>x</c>", {"html"}),
        ("**bold**", {"markdown"}),
        ("*twice*", {"markdown"}),
        ("__corner on__ x", {"markdown"}),
        ("[a](https://x.y) ![b](c.png) [d][9]", {"markdown"}),
        ("* one\n* two", {"markdown"}),
        ("1. one\n2. two", {"markdown"}),
        ("> quoted", {"markdown"}),
        ("Title\n=====\ntext", {"markdown"}),
        ("| a | b |\n|---|---|", {"markdown"}),
        ("### X ###", {"markdown"}),
        ("~~x~~ `y`", {"markdown"}),
        ("[[a|b]] '''c''' {{note|d}}", {"wiki"}),
        ("== Head ==", {"wiki"}),
        ('{| class="wikitable"\n|-\n| a || b\n|}', {"wiki"}),
        ("[https://x.y label]", {"wiki"}),
        ("\\emph{x} $\\alpha_2$ \\(m^6\\) \\[ \\sum_{i=1}^2 a_i \\]", {"latex"}),
        ("\\begin{itemize} \\item a \\end{itemize}", {"latex"}),
        ("**a** and \\ref{b}", {"markdown", "latex"}),
        ("costs $5, **bold**, $\\alpha_2$", {"markdown", "latex"}),
        ("__약할__때", {"markdown"}),
    ],
)
def test_markup(text, found):
    assert markup.languages(text) == found


def test_plain_text():
    assert markup.to_plain("== Head ==\n* a\n* b") == "## Head\n- a\n- b"
    assert markup.to_plain("<h2>X</h2><ul><li>a</li><li>b &amp; c</li></ul>") == "## X\n\n- a\n\n- b & c"
    assert markup.to_plain("see [a](u), [[b|c]], '''d''' and **e**~\\cite{x}") == "see a, c, d and e"
    assert markup.to_plain("so \\(x^2\\) and $y_1$ stay, \\[ z \\] too") == "so $x^2$ and $y_1$ stay, $$z$$ too"
    assert markup.to_plain("\\begin{verbatim}\nrun **x**\n\\end{verbatim}") == "```\nrun **x**\n```"
    assert markup.to_plain("Title\n=====\ntext") == "# Title\ntext"
    assert markup.to_plain("price 5$ to 6$ & more") == "price 5$ to 6$ & more"
    assert markup.to_plain("{{convert|3|km|mi}}") == "3 km"


PAGE = """<html><head><title>T{n}</title></head><body><article><header><h1 class="post-title">**T{n}**</h1><a class="source-pill" href="x">Watch</a></header>
<div id="b" CLASS='post-body'><p>{body}<p>unclosed<pre>**code{n}**</pre><!-- **c** --><figure><img alt="**alt**"><figcaption><span class=caption-text>{cap}</span><a>1:00</a></figcaption></figure></div></article></body></html>"""


def page_rows(n=20):
    rows = [(i, f"site/v{i}/a.html", PAGE.format(n=i, body=f"word{i} text", cap=f"cap {i}")) for i in range(n)]
    rows[1] = (1, "site/v/b.html", PAGE.format(n=1, body="a **b** c &amp;amp; d", cap="x [[y]]"))
    return [*rows, (50, "site/x.html", None), (51, "site/x.html", ""), (52, "site/x.html", "<p>**no body**</p>"), (53, None, PAGE.format(n=3, body="*x*", cap="y")), (54, "other/z.html", PAGE.format(n=4, body="''w''", cap="z"))]


def test_pages(spark):
    df = spark.createDataFrame(page_rows(), "page_id long, path string, html string").withColumn("id", F.lit("clash")).withColumn("slots", F.lit(1))
    got = {tuple(r) for r in pages.page_markup(df).collect()}
    assert got == {(1, "body", "markdown"), (1, "body", "html"), (1, "caption", "wiki"), (53, "body", "markdown"), (54, "body", "wiki")}
    texts = {(r.page_id, r.place): r.text for r in pages.clean_pages(df).collect()}
    assert texts[1, "body"].startswith("a b c & d") and "```\n**code1**\n```" in texts[1, "body"] and texts[1, "caption"] == "x y"
    assert pages.page_markup(df.where("false")).count() == 0


def test_code_and_formulas_stay():
    html = '<div class="post-body"><p>a <code>**x**</code> b <math><mi>y</mi><mo>=</mo><msup><mi>z</mi><mn>2</mn></msup></math> **c**</p><pre>k</pre></div>'
    slots = template.fill_slots(html, {}, [], "post-body", "caption-text")
    assert pages.clean_blocks(slots, "body") == "a `**x**` b $y=z^2$ c\n\n```\nk\n```"
    assert [markup.languages(s["text"].replace(template.ASIDE, " ")) for s in slots if not s["code"]] == [{"markdown"}]


def test_templates(spark):
    df = spark.createDataFrame(page_rows(), "id long, path string, html string").withColumn("host", F.split("path", "/")[0])
    rows = template.deduce_templates(df, min_pages=8).collect()
    assert [r.host for r in rows] == ["site"]
    classes, sizes = template.parse_template(rows[0].template)
    watch = next(t for t in classes if t.endswith(" Watch"))
    assert sizes[classes[watch][0]] > 10  # the label belongs to the page's frame
    assert any("caption-text" in t for t in classes)
    assert not any("word1" in t for t in classes)
    slots = template.fill_slots(PAGE.format(n=1, body="own", cap="c"), classes, sizes, "post-body", "caption-text")
    assert "Watch" not in [s["text"] for s in slots] and [s["text"] for s in slots if s["place"] == "caption"] == ["c"]


SITE = """<html><head><link rel="canonical" href="https://{site}/p/{n}"></head><body><div class="top">{name} daily</div><div class="post-body">
<div class="promo">**Subscribe** to {name} now, {{{{dear reader}}}}</div>{body}<ol><li><p>one{n}</p></li><li>two{n}</li></ol><table><tr><td>a{n}<td>b{n}</table><blockquote>said{n}</blockquote></div></body></html>"""


def test_templates_of_several_sites(spark, monkeypatch):
    """Each site has a template of its own; what its pages repeat is no text of a slot, whatever markup it holds."""
    rows = []
    for k, (host, name) in enumerate((("a.example", "Alpha"), ("b.example", "Beta"), ("c.example", "非常に長い名前の毎日の新聞ですからとても長い名前の毎日の新聞ですからとても長い名前"))):
        for n in range(12):
            body = f"<p>text{n} {name if n == 3 else f'somebody{n}'}</p>" + ("<p>[[own]]</p>" if n == 5 else "")
            rows.append((100 * k + n, "blogs/x.html", SITE.format(site=host, n=n, name=name, body=body)))
    rows.append((900, "blogs/lone.html", SITE.format(site="lone.example", n=1, name="Lone", body="<p>x</p>")))
    df = spark.createDataFrame(rows, "page_id long, path string, html string")
    assert {r[0] for r in df.select(template.site()).distinct().collect()} == {"a.example", "b.example", "c.example", "lone.example"}
    found = {tuple(r) for r in pages.page_markup(df).collect()}
    # A lone page has nothing to compare with, so its promotion is its own text.
    assert found == {(5, "body", "wiki"), (105, "body", "wiki"), (205, "body", "wiki"), (900, "body", "markdown"), (900, "body", "wiki")}
    clean = {r.page_id: r.text for r in pages.clean_pages(df).collect()}
    assert "Subscribe" not in clean[0] and "Subscribe" in clean[900]
    assert clean[1] == "text1 somebody1\n\n1. one1\n\n2. two1\n\na1 | b1\n\n> said1"
    # Without templates the promotion of every page would come out; joined by host they give what broadcast ones give.
    bare = [template.fill_slots(html, {}, [], "post-body", "caption-text") for _, _, html in rows]
    assert all(any("markdown" in markup.languages(s["text"]) for s in slots if s["place"]) for slots in bare)
    monkeypatch.setattr(template, "BROADCAST_TOKENS", -1)
    assert {tuple(r) for r in pages.page_markup(df).collect()} == found


def test_nested_markup():
    for text, plain in [
        ("a {{b|x {{c|y}}}} d", "a x y d"),
        (r"\textbf{a \emph{b}} and \section{S \textit{t}}", "a b and\n## S t"),
        ("[[File:x.png|thumb|cap [[b]] z]] q", "cap b z q"),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c<td>d</table>", "a | b\nc | d"),
        ("see `a*b*c` and **d *e* f**", "see `a*b*c` and d e f"),
        ("<ol><li>x</li><li><p>y</p></li></ol>", "1. x\n\n2. y"),
        ("<blockquote>q</blockquote>", "> q"),
        ("> said\n> so", "> said\n> so"),
        (r"\begin{enumerate}\item a \item b\end{enumerate}", "1. a\n2. b"),
        ("{|\n! A !! B\n|-\n| 1 || [[x|2]]\n|}", "A | B\n1 | 2"),
        ("C:\\videos\\new and [[1,2],[3,4]]", "C:\\videos\\new and [[1,2],[3,4]]"),
        ("<pre>\n```\n$x \\[ \\begin{equation}y\\end{equation} \\]$\n```\n</pre>", "```\n```\n$x \\[ \\begin{equation}y\\end{equation} \\]$\n```\n```"),
        ("{{" * 3000, "{{" * 3000),
        ("\\textbf{" * 3000, "\\textbf{" * 3000),
    ]:
        assert markup.to_plain(text) == plain, text[:80]


def test_nesting():
    classes = {"a": (0, 0), "b": (0, 1), "x": (1, 0), "y": (1, 1)}
    assert template.valid_classes(list("axyxyb"), classes, [2, 2]) == {0, 1}
    assert len(template.valid_classes(list("axby"), classes, [2, 2])) == 1
    assert 0 not in template.valid_classes(list("ba"), classes, [2, 2])


SENTENCES = {
    "en": ["The river is cold in the morning.", "We walk to the old mill with our friends.", "This is where the time goes."],
    "de": ["Der Fluss ist am Morgen sehr kalt.", "Wir gehen mit den Freunden zur alten Mühle.", "Das ist nicht so einfach, wie es aussieht."],
    "ru": ["Река утром очень холодная.", "Мы идём к старой мельнице с друзьями.", "Это не так просто."],
    "ja": ["朝の川はとても冷たいです。", "友達と古い水車小屋へ行きます。", "それはそんなに簡単ではありません。"],
}
LABELS = [("en", "en"), ("english", "en"), ("de", "de"), ("deutsch", "de"), ("ru", "ru"), ("ja", "ja"), ("日本語", "ja")]


def test_languages(spark):
    rows = [(100 * k + i, " ".join(s[i % 3] for _ in range(2)) + f" {s[(i + 1) % 3]}", lang) for k, (lang, s) in enumerate(SENTENCES.items()) for i in range(30)]
    rows += [
        (1, SENTENCES["de"][1], "en"),
        (2, SENTENCES["en"][1], None),
        (3, SENTENCES["en"][0] + " " + SENTENCES["de"][0] + " " + SENTENCES["ja"][0], " English "),
        (4, SENTENCES["de"][0] + " – " + SENTENCES["ru"][0], "xx"),
        (5, "♪ 12:30", None),
        (6, None, "en"),
        (7, "", None),
        (8, "Wir gehen mit der playlist zur alten Mühle.", "DEUTSCH"),
        (9, SENTENCES["en"][2] + " haha" * 3 + "hahahahahahahahaha " + "https://de.example/wir/gehen", "en"),
        (10, " ".join(["we walk to the old mill with our friends this is where the time goes"] * 300), "de"),
    ]
    rows = [r for r in rows if r[0] > 10 or True]
    df = spark.createDataFrame(rows, "para_id long, text string, lang string").withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame(LABELS, "label string, lang string")
    seg = language.language_segments(df.where("para_id > 10 or para_id <= 10"), labels, item="para_id")
    cases = {}
    for r in language.language_cases(seg, "para_id").where("para_id <= 10 and para_id > 0").collect():
        cases.setdefault(r.para_id, set()).add(r.lang)
    assert cases == {1: {"de"}, 2: {"en"}, 3: {"en", "de", "ja"}, 4: {"de", "ru"}, 10: {"en"}}
    assert all(0.5 <= s.confidence <= 1 for r in seg.collect() for s in r.segments)
    assert language.language_segments(df.where("false"), labels, item="para_id").count() == 0
    assert language.language_segments(df, labels.where("false"), item="para_id").where("size(segments) > 0").count() == 0


def test_held_out_accuracy():
    fit_on = [(s, lang) for lang, group in SENTENCES.items() for s in group for _ in range(5)]
    langs = sorted(SENTENCES)
    scorer = language.Scorer(langs, *language.fit(fit_on, langs))
    unseen = {"en": "The mill is old and the friends are cold.", "de": "Die Mühle ist alt und der Weg nicht einfach.", "ru": "Мельница очень старая.", "ja": "川へ行きます。"}
    assert {k: langs[language.stretches(scorer, t)[0][2]] for k, t in unseen.items()} == {k: k for k in unseen}


PROSE = ["The garden soil keeps more heat than we expected in the second half of the talk.", "Our first prototype explains most of the noise.", "Internal server errors fell by 12 percent after the cache was moved.", "Die Wetterstation braucht noch etwas Zeit.", "지난달 기록에서 404 오류를 90번 세어 보았습니다."]


def test_residue(spark):
    prose = [(1000 + i, " ".join(PROSE[(i + k) % 5] for k in range(3))) for i in range(200)]
    cases = {
        1: "Please enable JavaScript to continue.",
        2: f"{PROSE[0]}\nLorem ipsum dolor sit amet, consectetur adipiscing elit.",
        3: f"{PROSE[1]} Thanks to {{{{ speaker }}}} for the slides.",
        4: "404 Page not found",
        5: f"{PROSE[3]} Bitte versuchen Sie es später erneut.",
        6: '{"error": {"code": 404, "message": "Page not found"}}',
        7: "It was published by [INSERT AUTHOR HERE] last week.",
        8: "asdf asdf asdf asdf asdf",
        9: f"{PROSE[0]} 여기에 내용을 입력하세요.",
    }
    clean = {
        101: 'The old page said "Please enable JavaScript" and people thought the site was broken.',
        102: "In the code, `${speaker}` stands for the name.",
        103: "```\nrender('{{ x }}')\nlorem ipsum dolor sit amet\n```",
        104: "Antes decía «Active JavaScript» y la gente se asustaba.",
        105: "The set {1, 2, 3} has three members and [Music] plays.",
        106: None,
        107: "",
        108: " \n ",
        109: " ".join(PROSE) * 3000,
    }
    df = spark.createDataFrame(prose + list(cases.items()) + list(clean.items()), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = residue.residue_spans(df)
    assert sorted(r.doc_id for r in got.where("size(spans) > 0").collect()) == sorted(cases)
    kinds = {r.doc_id: r.spans[0].kind for r in got.where("doc_id < 10").collect()}
    assert (kinds[1], kinds[2], kinds[3]) == ("notice", "filler", "placeholder")
    assert got.count() == 200 + len(cases) + len(clean)
    assert residue.residue_spans(df.where("false")).count() == 0


def test_residue_in_a_third_of_the_rows(spark):
    """A notice that fills many rows doesn't become prose."""
    notices = ["Ce lecteur a besoin de JavaScript.", "The requested page could not be found.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Thanks to {{ speaker }} for the slides."]
    for notice in notices:
        prose = [(i, f"{PROSE[i % 5]} {PROSE[(i + 1) % 5]} Take {i} of the talk on {'soil wind rain snow heat'.split()[i % 5]} was long.") for i in range(200)]
        rows = [(1000 + i, notice if i % 2 else f"{PROSE[i % 5]}\n{notice}") for i in range(100)]
        found = residue.residue_spans(spark.createDataFrame(prose + rows, "doc_id long, text string")).where("size(spans) > 0")
        assert {r.doc_id for r in found.collect()} == set(range(1000, 1100)), notice


def test_counts_of_sentences(spark):
    """Each n-gram once in a sentence, each sentence once."""
    texts = ["Please wait wait.  We are  closed 12 days!\nPlease wait wait.", "Please wait. 한국어입니다。😀 b", "Closed {{ x }}\nWe are closed 34 days!", None, " \n ", "a"]
    prose, shapes, learned = residue.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    once = ["Please wait wait.", "We are closed 00 days!", "Please wait.", "한국어입니다。", "😀 b", "Closed {{ x }}", "a"]
    views = residue.Views()
    for counts, view, orders in ((prose, views.plain, residue.ORDERS), (shapes, views.shape, residue.SHAPE_ORDERS)):
        holding = sum((residue.count([t], view, [k]) > 0).astype(int) for t in once for k in orders)
        assert (counts == holding).all() and counts.sum() > 0
    assert len(learned) == 2


def test_seeds_are_not_from_the_test_tables():
    """No example that the models start from stands in the tables they are tried on."""
    import glob

    import duckdb

    files = [f"/root/testdata/{sf}/documents.parquet" for sf in ("sf0.01", "sf0.1")]
    files = [f for f in files if glob.glob(f)]
    texts = "\n".join(t.lower() for f in files for (t,) in duckdb.sql(f"select distinct text from '{f}' where text is not null").fetchall())
    for block in (residue_seeds.FILLER, residue_seeds.NOTICE, residue_seeds.WORDED, residue_seeds.MENTION, residue_seeds.PROSE):
        for line in residue_seeds.lines(block):
            for sentence in re.split(r"(?<=[.!?…])\s+|(?<=[。！？])", line):
                assert not sentence.strip() or sentence.lower() not in texts, sentence


def test_learning_from_the_corpus(spark):
    """Residue that shares its words with other residue of the corpus is found though the examples don't know it."""
    words = "doremus quelovi vipsana nectura magna viverra porta lorem fermentum tempor quisque nullam".split()
    draw = random.Random(3)
    filler = [(i, " ".join(draw.choices(words, k=9)).capitalize() + ".") for i in range(60)]
    said = "the river bridge market garden winter letter brother sister walked looked found older warm cold under over behind town people yesterday morning carried wrote heavy light".split()
    prose = [(1000 + i, " ".join(draw.choices(said, k=12)).capitalize() + ".") for i in range(3000)]
    df = spark.createDataFrame(filler + prose, "doc_id long, text string")
    counts = residue.fit(df)
    before, after = residue.Models(*counts[:2]), residue.Models(*counts)
    texts = [t for _, t in filler]
    found = [sum(bool(s) for s in m.spans(texts)) for m in (before, after)]
    assert found[1] > found[0] and found[1] > 50
    assert not any(after.spans([t for _, t in prose]))


def test_long_quotations_and_coverage(spark):
    """A quotation of any length is no residue; coverage is the share really covered; exclusion goes by it."""
    models = residue.Models(*residue.fit(spark.createDataFrame([(" ".join(PROSE),)], "text string")))
    notice = "You must enable JavaScript in your browser to open this website. "
    assert models.spans([f'He read out: "{notice * 20}" and laughed.'])[0] == []
    spans = models.spans([f"{PROSE[0]} {notice}"])[0]
    assert [k for *_, k, _ in spans] == ["notice"] and all(0 < c <= 1 for *_, c in spans)
    df = spark.createDataFrame([(1, notice), (2, f"{PROSE[0]} " * 9 + notice), (3, PROSE[0]), (4, None)], "doc_id long, text string")
    got = residue.residue_spans(df)
    cover = {r.doc_id: r.coverage for r in got.collect()}
    assert cover[1] > 0.8 > 0.2 > cover[2] > 0 == cover[3] == cover[4]
    assert {r.doc_id for r in residue.exclude_residue(got).collect()} == {3, 4}
    assert {r.doc_id for r in residue.exclude_residue(got, 0.5).collect()} == {2, 3, 4}


def test_short_whole_sentences():
    groups = SENTENCES | {"ko": ["아침의 강은 아주 차갑습니다.", "우리는 친구들과 오래된 방앗간에 갑니다.", "정말 감사합니다."], "de": [*SENTENCES["de"], "Vielen Dank."]}
    langs = sorted(groups)
    scorer = language.Scorer(langs, *language.fit([(s, lang) for lang, group in groups.items() for s in group for _ in range(5)], langs))
    en = SENTENCES["en"][1]
    for text, found in [
        (f"{en} Vielen Dank.", {"en", "de"}),
        (f"{en} 감사합니다. {en}", {"en", "ko"}),
        (f"{en} 정말 감사합니다!", {"en", "ko"}),
        (f"We walk to the mill – 감사합니다 – with our friends. {en}", {"en"}),
        (f"{en} Freunden. {en}", {"en"}),
        (f"{en} Xy Qz. {en}", {"en"}),
    ]:
        assert {langs[k] for _, _, k, _ in language.stretches(scorer, text)} == found, text
