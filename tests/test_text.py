from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspark.functions import text as tx
from reelspark.operators.segments import group_paragraphs, pack_blocks, wrap_words


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "c string").select(*columns).first()


def test_white_space_is_pythons(spark):
    odd = " a 　 b\u001c\u0085"
    assert one(spark, odd, tx.collapse_ws("c"))[0] == " ".join(odd.split()) == "a b"
    assert one(spark, None, tx.collapse_ws("c"))[0] is None
    every = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    assert one(spark, f"x{every}y", tx.collapse_ws("c"))[0] == "x y"


def test_names(spark):
    assert one(spark, "A/B: C? #x", tx.safe_name_file("c"))[0] == "A B C x"
    assert one(spark, "", tx.safe_name_file("c"))[0] == "untitled"
    assert one(spark, "...trim...", tx.safe_name_file("c"))[0] == "trim"
    assert one(spark, "a/b\\c:d ", tx.safe_name("c"))[0] == "a-b-c-d"
    assert one(spark, 'Q&A: "why" (100%)', tx.safe_name_url("c"))[0] == "Q-A- why 100"
    assert len(one(spark, "x" * 300, tx.safe_name_file("c"))[0]) == 120


def test_times(spark):
    row = spark.createDataFrame([(3_725_004,)], "ms long").select(tx.ms_to_ts("ms"), tx.ts_display(F.col("ms") / 1000), tx.ts_display(F.lit(65)), tx.ts_display(F.lit(65), True)).first()
    assert list(row) == ["01:02:05,004", "1:02:05", "1:05", "00:01:05"]
    assert one(spark, "01:02:05,004", tx.ts_to_s("c"))[0] == 3725.004
    assert [one(spark, x, tx.hms_to_seconds("c"))[0] for x in ("7", "1:05", "1:00:01", "9:1:00:01")] == [7, 65, 3601, 3601]


def test_links(spark):
    assert one(spark, "https://youtu.be/abcdefghij_?t=1", tx.video_id("c"))[0] == "abcdefghij_"
    assert one(spark, "https://x/?list=1&v=abcdefghij-", tx.video_id("c", True))[0] == "abcdefghij-"
    assert one(spark, "none", tx.video_id("c"))[0] is None
    assert one(spark, "a b/한 ~*%20+.png", tx.url_quote("c"))[0] == "a%20b/%ED%95%9C%20~%2A%20%2B.png"
    assert one(spark, "https://www.example.org/" + "x" * 60, tx.source_label("c"))[0] == "example.org/" + "x" * 33 + "…"
    got = one(spark, "../Img/a%20b.png#f", tx.resolve_href("c", F.lit("OPS/text")))[0]
    assert (got["file"], got["anchor"]) == ("OPS/Img/a b.png", "f")
    assert one(spark, "#x", tx.resolve_href("c", F.lit("OPS")))[0]["file"] is None


def test_scripts(spark):
    assert one(spark, "한국어 text", tx.already_target("c", "ko"))[0] is False  # 3 of 7
    assert one(spark, "한국어말 tex", tx.already_target("c", "ko"))[0] is True
    assert one(spark, "한국 ab", tx.already_target("c", "ko"))[0] is False  # exactly half
    assert one(spark, "123", tx.already_target("c", "ko"))[0] is False
    assert one(spark, "漢字", tx.already_target("c", "ja"), tx.already_target("c", "zh")) == (True, True)
    assert one(spark, "abc", tx.already_target("c", "xx"))[0] is False
    assert one(spark, " Korean ", tx.target_code("c"), tx.slug("c"))[0] == "ko"
    assert one(spark, "Old Norse", tx.slug("c"))[0] == "old-norse"


def test_answers(spark):
    ok = '```json\n[{"frame_index": 1, "include": true, "confidence": 0.5}]\n```'
    assert one(spark, ok, tx.parse_ranker_json("c", 1))[0]["items"][0]["confidence"] == 0.5
    assert one(spark, ok, tx.parse_ranker_json("c", 2))[0]["error"] == "wrong length"
    assert one(spark, '{"a": 1}', tx.parse_ranker_json("c", 1))[0]["error"] == "not a JSON array"
    for shape in ('[{"id": 1, "text": "x"}]', '{"items": [{"id": 1, "text": "x"}]}', '{"translations": [{"id": 1, "text": "x"}]}'):
        assert one(spark, shape, tx.translated_payload("c", 1))[0]["items"][0]["text"] == "x"
    assert one(spark, "{}", tx.translated_payload("c", 1))[0]["error"] == "no list of items"


def test_escapes_and_prompts(spark):
    assert one(spark, "<a href=\"x\">&'", tx.html_escape("c"))[0] == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    assert one(spark, "a [b]\n c", tx.md_alt_safe("c"))[0] == "a (b) c"
    assert one(spark, "▶ 1:05", tx.numeric_only("c"))[0] is True
    assert one(spark, "1:05 x", tx.numeric_only("c"))[0] is False
    assert one(spark, 'say "hi"', tx.frontmatter("c", F.lit(None)))[0] == "---\ntitle: \"say 'hi'\"\n---\n"
    assert one(spark, "head\n---\nbody", tx.prompt_body("c"))[0] == "\nbody"
    assert one(spark, "GPT-5-mini", tx.is_reasoning_model("c"))[0] is True
    assert one(spark, ".git", tx.hidden_name("c"))[0] is True
    assert abs(one(spark, "x", tx.est_cost(F.lit(10), 0.5))[0] - 6.5) < 1e-12


@settings(deadline=None, max_examples=50)
@given(st.lists(st.text(alphabet="ab .!?\n", max_size=40), max_size=12))
def test_packing_loses_nothing(parts):
    text = "\n\n".join(parts)
    chunks = pack_blocks(text, 50)
    assert "".join(text.split()) == "".join("".join(chunks).split())
    assert all(len(c) <= 50 or "\n\n" not in c for c in chunks)


@settings(deadline=None, max_examples=50)
@given(st.text(alphabet="abc .!?", max_size=400))
def test_paragraphs_keep_the_words(text):
    assert " ".join(group_paragraphs(text, 3, 40)).split() == text.split()


def test_paragraph_limits():
    assert group_paragraphs("A. B. C. D. E.") == ["A. B. C. D.", "E."]
    assert group_paragraphs("") == []
    assert group_paragraphs("x" * 700 + ". y") == ["x" * 700 + ".", "y"]
    assert max(map(len, wrap_words("word " * 400))) <= 700
    assert wrap_words("y" * 900) == ["y" * 900]


def test_url_quote_as_the_standard_library_does(spark):
    from urllib.parse import quote, unquote

    paths = ["a b/c.jpg", "a%20b", "100%", "%zz/%4", "x+y", "~*-_.()!'", "한국/日本語 😀", "a%2Fb", "", "%25", "%2525", "q?a=b&c#d", "%C3%A9"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in [*paths, None]], "p string").select(tx.url_quote("p")).collect()]
    assert got == [*[quote(unquote(p), safe="/") for p in paths], None]
