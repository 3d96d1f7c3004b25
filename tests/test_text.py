"""Cleaning, metadata, conversion and quality on small cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import cleaning as C, convert as V, metadata as M, quality as U, vectors as X
from vellum.functions.text import count_tokens, words
from vellum.sources import files as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    ("rule", "text", "want"),
    [
        (C.normalize_line_endings, "a\r\nb\rc", "a\nb\nc"),
        (C.remove_reference_numbers, "x [12] [a] [3]", "x  [a] "),
        (C.remove_url_fragments, "well-known\nA-b\n```\na/b\n```\nc/d e", "A-b\n```\na/b\n```\nc/d e"),
        (C.remove_keyword_blocks, "Keywords:\na, b\nrest", "\nrest"),
        (C.detect_implicit_headings, "Annual Report\n\ntext follows here", "# Annual Report\n\ntext follows here"),
        (C.detect_implicit_headings, "text\nAnnual Report", "text\nAnnual Report"),
        (C.remove_short_lines, "short\n- li\n# h\n1. x\nlong enough line", "- li\n# h\n1. x\nlong enough line"),
        (C.normalize_whitespace, "a   b\n\n\n\n  - x   y\n```\n k   l\n```", "a b\n\n  - x y\n```\n k   l\n```"),
        (C.remove_invalid_chars, "a\x00b\tc\x7f", "ab\tc"),
        (C.clean_markdown, "##  \n[x]( ) ![y]()z\n!\n", " !z\n"),
        (C.normalize_ws, "  a  b \r\n c d ", "a b\nc\nd"),
        (C.remove_repeated_urls, "http://a/x is\nhttp://a/x\nt http://a/x", "http://a/x is\nt http://a/x"),
        (C.remove_duplicate_items, "- a\na\nb http://u\nc http://u\n\n\n", "- a\nb http://u\n\n\n"),
    ],
)
def test_cleaning(spark, rule, text, want):
    assert one(spark, text, rule) == want
    assert one(spark, None, rule) is None
    assert one(spark, "", rule) == ""


def test_clean_text_order(spark):
    df = spark.createDataFrame([("Title Of Things\r\n\r\nA long sentence [1] with words.\r\nhi\r\nA long sentence  with words.\r\n",), (None,)], "t string")
    got = [r.t for r in C.clean_text(df, "t").collect()]
    assert got == ["# Title Of Things\n\nA long sentence with words.\n", None]


def test_tokens_and_words(spark):
    assert one(spark, "a" * 9, count_tokens) == 2
    assert one(spark, "", count_tokens) == 1
    assert one(spark, "  a \t b\n", words) == ["a", "b"]
    assert one(spark, "   ", words) == []


def test_identity(spark):
    assert one(spark, "a\\b.md", M.doc_id) == one(spark, "a/b.md", M.doc_id)
    ids = spark.createDataFrame([("d", "x  y"), ("d", "x y "), ("d", "x z")], "d string, t string").select(M.chunk_id(F.col("d"), F.col("t")).alias("i"))
    assert len({r.i for r in ids.collect()}) == 2


def test_front_matter(spark):
    raw = "---\r\ntitle: \"T: x\"\n# c\nlang: pt-BR\ntags: [a, 'b' , ]\ntitle: last\n---\nbody"
    raw = raw.replace("\r\n", "\n")
    f = one(spark, raw, lambda c: M.parse_front_matter(M.front_matter(c)))
    assert f["title"] == "last" and f["lang"] == "pt-BR"
    assert one(spark, raw, M.strip_front_matter) == "body"
    assert one(spark, "no front", lambda c: M.parse_front_matter(M.front_matter(c))) == {}
    assert one(spark, "[a, 'b' , ]", M.parse_tags) == ["a", "b"]
    assert one(spark, None, M.parse_tags) == []


@pytest.mark.parametrize(("text", "want"), [("o gato de casa e que para", "pt"), ("the cat of the house", "en"), ("xyz", "und"), ("", "und")])
def test_language(spark, text, want):
    assert one(spark, text, M.guess_language) == want


def test_doc_type(spark):
    df = spark.createDataFrame([("Manual de uso", "", "x.md"), (None, None, None), ("x", "a report", "y")], "t string, b string, f string")
    assert [r.r for r in df.select(M.doc_type(F.col("t"), F.col("b"), F.col("f")).alias("r")).collect()] == ["manual", None, "relatorio"]


def test_html_to_markdown(spark):
    h = '<h2 class="a">T</h2><p>a\n b</p><ul><li>x</li></ul><table><tr><th>h</th></tr><tr><td>1</td></tr></table><b>z</b>'
    assert one(spark, h, V.html_to_markdown) == "## Ta b\n- x| h |\n| --- |\n| 1 |\n**z**"
    assert one(spark, "", V.html_to_markdown) == ""
    assert one(spark, None, V.html_to_markdown) is None


def test_strip_rules(spark):
    assert one(spark, "Let me see\n\nText", V.strip_reasoning) == "Text"
    assert one(spark, "I can see", V.strip_reasoning) == "I can see"
    assert one(spark, "\n".join(["same line here"] * 9 + ["end"]), V.strip_repetition) == "\n".join(["same line here"] * 5)
    assert one(spark, "a<b>c</b> tail", V.strip_trailing_commentary) == "a<b>c</b>"
    assert one(spark, "x \\section{a} {b}", V.latex_to_text) == "x  b"


def test_quality(spark):
    q = one(spark, "Uma frase longa o bastante para ser julgada aqui.", lambda c: U.score_quality(c))
    assert 0.3 < q.score < 1 and q.char_count == 49
    assert one(spark, "curto", lambda c: U.score_quality(c)).score == 0
    assert one(spark, None, lambda c: U.score_quality(c)).symbol_ratio == 1.0
    assert one(spark, "aaaaaaaaaaaa bbbb cccc dddd", lambda c: U.score_quality(c)).has_repeated_chars
    assert one(spark, "| a | b |\n| c | d |\n| e | f |", U.looks_like_table)
    assert one(spark, "", U.diacritic_ratio) == 1.0
    assert sorted(one(spark, "12 3 4.5 x99 about ação", U.number_set)) == ["12", "4.5"]
    assert one(spark, "about ação longa para", U.word_set) == ["ação", "longa"]


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], X.l2_normalize, "array<double>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], X.l2_normalize, "array<double>") == [0.0, 0.0]
    a, b = one(spark, "um dois dois", lambda c: X.hash_embed(c)), one(spark, "um dois dois", lambda c: X.hash_embed(c))
    assert a == b and abs(sum(v * v for v in a) - 1) < 1e-5
    assert one(spark, "", lambda c: X.hash_embed(c)) == [0.0] * 64
    assert sum(one(spark, "um dois dois", lambda c: X.hash_embed_sparse(c)).values()) == 3


def test_files(spark, tmp_path):
    import io
    import zipfile

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"---\ntitle: T\ntags: [x]\n---\n# Head\r\n\r\nA long enough line of text.\n")
    (tmp_path / "sub" / "b.md").write_text("plain text that is long enough")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "t.csv").write_text('a,"b,c"\n1,2\n')
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="u"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(z.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    md = S.scan_markdown(spark, str(tmp_path))
    assert {r.source_path for r in md.collect()} == {"a.md", "sub/b.md"}
    rows = {r.source_path: r for r in S.load_markdown(md).collect()}
    assert rows["a.md"].title == "T" and rows["a.md"].tags == ["x"] and rows["a.md"].body.startswith("# Head\n\nA long")
    assert rows["sub/b.md"].title == "b"
    got = {r.path.rpartition("/")[2]: r for r in S.extract_text(S.list_inputs(spark, str(tmp_path))).collect()}
    assert got["t.csv"].text == "| a | b,c |\n| 1 | 2 |"
    assert got["d.docx"].text == "## Top\nBody\n| 1 |"
    assert got["bad.docx"].error


def test_duplicate_lines_of_all_documents(spark, tmp_path):
    """Against brute force: first occurrences, and lines whose first address was met before."""
    import hashlib

    from vellum.catalog import QUERIES

    rng = random.Random(5)
    parts = ["- casa", "casa", "1. casa", "ver http://a.b/x", "outro http://a.b/x aqui", "http://c.d e http://a.b/x", "", "fim", "veja http://c.d"]
    docs = [(f"d{i}", "\n".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for i in range(200)] + [("null", None), ("empty", "")]
    spark.createDataFrame(docs, "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        out, items, urls = [], [], []
        for line in text.split("\n"):
            item = re.sub(r"^[-*]\s+|^\d+\.\s+", "", line.strip())
            url = re.search(r"https?://[^\s)\]]+", item)
            if item and (item in items or url and url.group() in urls):
                continue
            out.append(line)
            items.append(item)
            if url:
                urls.append(url.group())
        return "\n".join(out)

    got = {r.doc_id: (r.digest, r.n) for r in QUERIES["clean_dup_lines"](spark, str(tmp_path)).collect()}
    assert got == {k: (hashlib.sha1(brute(t).encode()).hexdigest(), len(brute(t))) for k, t in docs if t is not None}
