"""Operators of the training-text problems on small cases, against brute force and round trips."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute_stats
from vellum.llm import bpe, knn, language, leakage, markup, ocr_repair, rank_fusion, repetition, text_stats
from vellum.llm.words import WordMemo, measured_words, plain_words

# --- 1 ---------------------------------------------------------------------------------------

PROSE = "O registro mostra que a bomba principal mede o filtro regional da oficina central. "


def damage(spark, rows):
    df = spark.createDataFrame(rows, "record string, doc string, page_num int, text string")
    return {(r.doc, r.page_num, r.kind) for r in ocr_repair.find_damage(df).collect()}


def test_damage_kinds(spark):
    base = [("engine_pages", f"s{i}", 1, PROSE * 3) for i in range(30)]
    rows = base + [
        ("engine_pages", "h", 1, PROSE + "A bomba prin-\ncipal mede."),
        ("engine_pages", "m", 1, PROSE + "A b0mba mede."),
        ("engine_pages", "g", 1, PROSE + "A prin cipal bomba."),
        ("engine_pages", "p", 1, "Página 3\n" + PROSE),
        ("engine_pages", "w", 1, "O registro mostra que a bomba\nprincipal mede o filtro."),
        ("engine_pages", "r", 1, "MANUAL DA BOMBA\n" + PROSE), ("engine_pages", "r", 2, PROSE + "\nMANUAL DA BOMBA"),
        ("documents_md", "d", 0, PROSE + "\nManual da Bomba\n" + PROSE + "\n- 4 -\nManual da Bomba\n" + PROSE),
        ("engine_pages", "n", 1, None), ("engine_pages", "e", 1, "  "), ("engine_pages", "h", 1, PROSE + "A bomba prin-\ncipal mede."),
    ]
    got = damage(spark, rows)
    assert got == {("h", 1, "hyphenation"), ("m", 1, "misread"), ("g", 1, "misread"), ("p", 1, "page_number"), ("r", 1, "header"), ("r", 2, "header"), ("d", 0, "header"), ("d", 0, "page_number")}


def test_copies_of_a_damaged_text_do_not_hide_it(spark):
    sound = [("engine_pages", f"s{i}", 1, PROSE * 2 + f"Nota {i}.") for i in range(40)]
    copied = [("engine_pages", f"c{i}", 1, PROSE + "A b0mba mede a prin cipal.") for i in range(20)]
    once = [("engine_pages", "o", 1, PROSE + "Outra b0mba.")]
    want = {(f"c{i}", 1, "misread") for i in range(20)} | {("o", 1, "misread")}
    assert damage(spark, sound + copied + once) == want
    gap = [("engine_pages", f"g{i}", 1, PROSE + "A prin cipal bomba.") for i in range(20)]
    assert damage(spark, sound + gap) == {(f"g{i}", 1, "misread") for i in range(20)}
    # Nor do they turn a sound word into a misread form of theirs.
    reverse = [("engine_pages", f"r{i}", 1, PROSE + "O rcgistro mostra.") for i in range(2000)]
    assert damage(spark, [("engine_pages", f"s{i}", 1, PROSE + f"Nota {i}.") for i in range(40)] + reverse) == {(f"r{i}", 1, "misread") for i in range(2000)}


def test_damage_empty(spark):
    assert damage(spark, []) == set()


def test_repair():
    text = "Página 2\nA bomba prin-\ncipal mede\no f i l t r o.\n\nb0mba"
    assert ocr_repair.repair(text, {"b0mba": "bomba"}, set(), {"filtro": 9}) == "A bomba principal mede o filtro.\n\nbomba"
    assert ocr_repair.repair(None, {}, set()) == ""


def test_repair_uses_all_evidence(spark):
    table = "Lista de peças\nNúmeros:\n12\n7\n15\n9\nSoma dos números:\nFim da lista aqui."
    rows = [("engine_pages", f"s{i}", 1, PROSE * 2 + f"O decreto-lei vale. Nota {i}.") for i in range(30)] + [
        ("engine_pages", "r", 2, "Manual da bomba\nba mede o filtro.\n2"),
        ("engine_pages", "r", 1, "Manual da bomba\nO registro mostra que a bom-\n1"),
        ("engine_pages", "h", 1, PROSE + "O decreto-\nlei vale e a bomba prin-\ncipal mede."),
        ("engine_pages", "g", 1, PROSE + "A prin cipal bomba."),
        ("engine_pages", "t", 1, table), ("engine_pages", "n", 1, None), ("engine_pages", None, 1, "Um."), ("engine_pages", None, 1, "Dois."),
    ]
    pages = ocr_repair.repaired(spark.createDataFrame(rows, "record string, doc string, page_num int, text string"))
    got = {(r.doc, r.page_num): r.text for r in pages.collect() if r.doc}
    assert got["r", 1] == "O registro mostra que a bom-" and got["r", 2] == "ba mede o filtro."
    assert got["h", 1].endswith("O decreto-lei vale e a bomba principal mede.")
    assert got["g", 1].endswith("A principal bomba.")
    assert all(x in got["t", 1].split() for x in ("12", "7", "15", "9"))
    assert got["n", 1] == "" and len(got) == 36
    whole = [(r.doc, r.text) for r in ocr_repair.assembled(pages).collect()]
    assert ("r", "O registro mostra que a bomba mede o filtro.") in whole
    assert sorted(t for d, t in whole if d is None) == ["Dois.", "Um."] and len(whole) == 37


def test_assemble():
    assert ocr_repair.assemble(["A bomba prin-", "cipal mede", "", "o filtro.", "Outra página."]) == "A bomba principal mede o filtro.\n\nOutra página."


def test_anagram_hash(spark):
    r = spark.createDataFrame([("roma", "amor"), ("a", "b")], "a string, b string").select((ocr_repair.anagram_hash(F.col("a")) == ocr_repair.anagram_hash(F.col("b"))).alias("same"))
    assert [x.same for x in r.collect()] == [True, False]


@pytest.mark.parametrize(("line", "want"), [("— 7 —", True), ("ix", True), ("Page 3 of 9", True), ("Seite 4", True), ("2003.", False), ("mil", False), ("195 kg", False), ("", False)])
def test_page_number(line, want):
    assert ocr_repair.is_page_number(line) is want


# --- 2 ---------------------------------------------------------------------------------------


def cut_up(text, size):
    """Chunks of a text as the operator cuts it: up to the end of a word."""
    return re.findall(rf"(?s).{{1,{size}}}\s*\S*", text) or [""]


def test_partials_do_not_depend_on_cuts():
    rng = random.Random(3)
    pieces = ["A casa de pedra. ", "bar\n", "12,5; ", "\n\n", "- item\n", "...... 4\n", "x" * 300, "É assim!\n", "\t|a|b|\n", "ok.", " ", "1. ", "😀", " a b c d e.", "\f", "(sim.) ", "O que se faz na casa. "]
    tokens = text_stats.Tokens()
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    want = [brute_stats.counts(t) for t in texts]
    assert text_stats.finish(text_stats.partials(texts, [True] * len(texts), tokens)).tolist() == want
    for text, counts in zip(texts, want):
        for size in (1, 7, 50):
            chunks = cut_up(text, size)
            parts = list(text_stats.partials(chunks, [i == 0 for i in range(len(chunks))], tokens))
            assert "".join(chunks) == text and parts[0].nbytes == len(text_stats.STATE) * 8
            while len(parts) > 1:
                k = rng.randrange(len(parts) - 1)
                parts[k : k + 2] = [text_stats.join(parts[k], parts[k + 1])]
            assert text_stats.finish(parts[0][None])[0].tolist() == counts


def test_huge_texts_without_a_sentence_end(spark):
    """A table and an unbroken run of ten megabytes are counted as their pieces are; blanks of any kind may stand at a cut."""
    table = "12;34,5;abc\u00a0de\n" * 20_000
    rows = [(1, table), (2, "A" * 10_000_000), (3, "um\u2003dois\x1dtrês " * 9_000 + "fim.")]
    got = {r.k: r for r in text_stats.text_stats(spark.createDataFrame(rows, "k int, t string"), ["k"], "t").collect()}
    for k, text in rows[::2]:
        want = dict(zip(brute_stats.COUNTS, brute_stats.counts(text)))
        assert (got[k].n_chars, got[k].n_words, got[k].n_lines) == (want["chars"], want["words"], want["lines"])
        assert got[k].alphanumeric_ratio == want["alnum"] / (want["chars"] - want["blank"]) and got[k].avg_line_length == want["line_chars"] / want["full_lines"]
    assert (got[2].n_words, got[2].mean_word_length, got[2].alphanumeric_ratio) == (1, 10_000_000, 1.0)


def test_common_words_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "zu ga zu ga bo.")], "k int, t string")
    assert text_stats.text_stats(df, ["k"], "t").first().common_word_ratio == 0.4  # "zu" is German too
    assert text_stats.text_stats(df, ["k"], "t", common=frozenset({"zu", "ga"})).first().common_word_ratio == 0.8


def test_long_runs_are_counted_whole(spark):
    rows = [("a", 1, "é" * 9_000 + "7" * 600 + "#" * 400), ("a", 2, "ab " + "x" * 300 + "-" + "casa" + " fim.")]
    for chunk in (777, 65_536):
        got = {r.page: r for r in text_stats.text_stats(spark.createDataFrame(rows, "doc string, page int, text string"), ["doc", "page"], "text", chunk).collect()}
        assert (got[1].n_chars, got[1].n_words, got[1].mean_word_length) == (10_000, 1, 9_000)
        assert (got[1].alphanumeric_ratio, got[1].symbol_ratio, got[1].digit_ratio, got[1].diacritic_ratio) == (0.96, 0.04, 600 / 9600, 1.0)
        assert (got[2].n_words, got[2].mean_word_length) == (4, (2 + 300 + 4 + 3) / 4)


def test_stats_and_verdict(spark):
    rows = [("a", 1, PROSE * 4, "c"), ("a", 2, "- bomba da oficina\n- filtro, 3 kg\n- Prensa AB-12", "c"), ("a", 3, "", "c"), ("a", 4, None, "c"), ("a", 5, "| 1 | 2 |\n| 3 | 4 |", "c"), ("a", 6, PROSE.upper(), "c"), ("a", 1, PROSE * 4, "c")]
    df = spark.createDataFrame(rows, "doc string, page int, text string, c string")
    for chunk in (20, 65_536):
        got = {r.page: r.is_prose for r in text_stats.text_stats(df, ["doc", "page"], "text", chunk).collect()}
        assert got == {1: True, 2: False, 3: None, 4: None, 5: False, 6: True}
    assert text_stats.text_stats(df.limit(0), ["doc", "page"], "text").count() == 0


# --- 3 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("<b>x</b>", {"html"}), ("a &amp; b", {"html"}), ("<!-- c -->", {"html"}), ("# T\n\nx", {"markdown"}), ("a **b** c", {"markdown"}), ("- a\n- b", {"markdown"}),
        ("1. A um\n2. B dois", {"markdown"}), ("[a](http://b)", {"markdown"}), ("== T ==", {"wiki"}), ("[[a|b]]", {"wiki"}), ("{{x|y=1}}", {"wiki"}), ("\\section{a}", {"latex"}),
        ("x $a^{2}$ y", {"latex"}), ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"latex"}), ("```\n# no\n<b>\n```", {"markdown"}),
        ("(R$ 87,00 / R$ 46,50)", set()), ("(C:\\sca\\rul\\lote52)", set()), ("(P&D, n.º #4) (~15 %)", set()), ("[23] {A, B, C7}", set()), ("(4 < 92, 42 > 6) (3 * 2 * 4)", set()),
        ("(rin_rin_50) (4^6 = ?) [ 9 ]", set()), ("- 42 -\n— 3 —", set()), ("em\n22. September 2014 darf", set()), ("", set()), (None, set()),
    ],
)
def test_markup_families(text, family):
    assert markup.convert(text)[1] == family


def test_long_spans_are_markup():
    assert markup.convert("a **" + "palavra " * 200 + "fim** b")[1] == {"markdown"}
    assert markup.convert("a \\[ " + "x + " * 3000 + "y \\] b")[1] == {"latex"}
    assert markup.convert("\\begin{align}" + "x &= y \\\\ " * 4000 + "\\end{align}")[1] == {"latex"}


def test_spans_are_those_of_the_patterns():
    strong = re.compile(r"(?<![\w*])\*\*(?=\S)(.+?)(?<=\S)\*\*(?!\*)|(?<![\w_])__(?=\S)(.+?)(?<=\S)__(?![\w_])", re.S)
    display = re.compile(r"(?s)\\\[(.+?)\\\]|\$\$(.+?)\$\$|\\begin\{((?:equation|align|gather|math|displaymath)\*?)\}(.+?)\\end\{\3\}")
    rng = random.Random(6)
    for signs, pattern, spans in ((["*", "**", "__", "_", "a", " ", "\n"], strong, markup.strong_spans), (["\\[", "\\]", "$$", "$", "\\begin{align}", "\\end{align}", "\\begin{math}", "\\end{math}", "x", " "], display, markup.display_spans)):
        for _ in range(3000):
            s = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
            assert [(a, d) for a, _, _, d in spans(s)] == [m.span() for m in pattern.finditer(s)], s


def test_markup_keeps_structure():
    t = "<h1>Top</h1><p>A long enough line of text.</p><ul><li>one item</li></ul>\n```python\nx = '<b>'\n```\nand $E = m c^{2}$ here\n<script>var a=1;</script>"
    c = markup.convert(t)[0]
    assert "# Top" in c and "- one item" in c and "```\nx = '<b>'\n```" in c and "$E = m c^{2}$" in c and "script" not in c and "var a" not in c


LONG = "A paragraph with enough text to be one, and with more of it to count."


def test_line_blocks_remove_planted_residue():
    """Menus, navigation and footers go, whatever markup they come in; the text between them stays."""
    page = f"<html><body><div>Shop</div><div>Home</div><nav><ul><li><a href='/'>Start</a></li><li><a href='/x'>About us</a></li></ul></nav><h1>Title</h1><p>{LONG}</p><p>Yes.</p><pre>x = 1</pre><p>{LONG} $a^{{2}}$</p><ul><li>an item</li></ul><footer>Copyright 2020 <a href='/'>Foo</a></footer><div>Contact</div></body></html>"
    got = markup.convert(page)[0]
    assert all(x in got for x in ("# Title", LONG, "Yes.", "```\nx = 1\n```", "$a^{2}$", "- an item"))
    assert not any(x in got for x in ("Shop", "Home", "Start", "About us", "Copyright", "Foo", "Contact"))
    md = f"[Home](/) [Docs](/d)\n[Blog](/b)\n\n\n\n# Title\n\n{LONG} See [the docs](/d).\n\n[One reference](/r)\n\n\n\n[Top](#t)\n[Next](#n)\n"
    got = markup.convert(md)[0]
    assert got == f"# Title\n\n{LONG} See the docs.\n\nOne reference"


@pytest.mark.parametrize("text", ["Yes.", "OK now", "a\n\n\n\nb", f"Short\n\n\n\n{LONG}\n\n\n\nend", f"{LONG}\n\n\n\nFim\n\n\n\n{LONG}"])
def test_plain_text_is_kept_whole(text):
    assert markup.convert(text)[0].split() == text.split()


def test_line_blocks_do_not_lose_text_of_the_tables():
    import os

    path = "/root/testdata/sf0.001/documents_md.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not here")
    import pyarrow.parquet as pq

    for body in pq.read_table(path).column("body").to_pylist():
        lines = [l for l in (body or "").split("\n") if l.strip()]
        assert [l for l in markup.main_blocks(lines) if l.strip()] == lines


@pytest.mark.parametrize("n", [199, 200, 201, 5_000, 5_001, 30_000])
def test_formulas_of_any_length(n):
    f = "x" + "+y" * (n // 2)
    for text, held in ((f"a $$ {f} $$ b", f"$$ {f} $$"), (f"a ${f}$ b", f"${f}$"), (f"a \\begin{{align}}{f}\\end{{align}} b", f"$$ {f} $$")):
        clean, families = markup.convert(text)
        assert held in clean and families == {"latex"}


def test_clean_markup_frame(spark):
    df = spark.createDataFrame([("a", "**x** is a long line", 1), ("a", None, 2), ("b", "", 3)], "id string, t string, clean int")
    rows = [(r.id, r.clean, list(r.markup)) for r in markup.clean_markup(df, ["id"], "t").collect()]
    assert rows == [("a", "x is a long line", ["markdown"]), ("a", "", []), ("b", "", [])]


# --- 4 ---------------------------------------------------------------------------------------

EV = "q int, mode string, item string, score double, at timestamp"


def fused(spark, rows, modes=("a", "b", "c")):
    df = spark.createDataFrame(rows, "q int, mode string, item string, score double, at int")
    return rank_fusion.fuse(rank_fusion.latest_scores(df, "q", "mode", "item", "score", "at"), modes)


def test_ranks_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(q, m, f"i{i}", rng.choice([rng.gauss(0, 10 ** rng.randint(-3, 4)), 0.0, 1.0]), 1) for q in range(3) for m in "abc" for i in range(40) if rng.random() < 0.8]
    got = {(r.g, r.i): (r.median_rank, r.mean_rank) for r in fused(spark, rows).collect()}
    for q in range(3):
        items = sorted({r[2] for r in rows if r[0] == q})
        for it in items:
            rs = []
            for m in "abc":
                s = {r[2]: r[3] for r in rows if r[0] == q and r[1] == m}
                rs.append(sum(v > s[it] for v in s.values()) + (sum(v == s[it] for v in s.values()) + 1) / 2 if it in s else len(items) + 1)
            assert got[(q, it)] == pytest.approx((float(np.median(rs)), float(np.mean(rs))))


def test_fusion_cases(spark):
    rows = [(1, "a", "x", 1e9, 1), (1, "a", "y", 1.0, 1), (1, "b", "y", 5.0, 1), (1, "b", "x", 4.0, 2), (1, "b", "x", 9.0, 1), (1, "c", "z", float("nan"), 1), (1, "b", "w", None, 1), (None, "a", "x", 1.0, 1), (1, "zz", "v", 1.0, 1)]
    got = {r.i: r.median_rank for r in fused(spark, rows, ("a", "b")).collect()}
    assert got == {"x": 1.5, "y": 1.5}
    assert fused(spark, []).count() == 0
    t = rank_fusion.top(fused(spark, rows, ("a", "b")), 1).collect()
    assert [r.i for r in t] == ["x"]  # equal medians and means: identifier
    with pytest.raises(ValueError):
        rank_fusion.fuse(rank_fusion.latest_scores(spark.createDataFrame([], "q int, mode string, item string, score double, at int"), "q", "mode", "item", "score", "at"), ["a"], {"a": -1})


# --- 6 ---------------------------------------------------------------------------------------


def test_similar_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 64))
    near = base[:60] + rng.normal(size=(60, 64)) * 0.25
    v = np.concatenate([base, near, np.repeat(base[100:101], 9, 0), base[200:201] * 3.0])
    rows = [(f"c{i:03d}", "m", x.tolist()) for i, x in enumerate(v)] + [("c000", "other", v[0].tolist()), ("bad", "m", None), ("short", "m", [1.0]), ("zero", "m", [0.0] * 64), ("nan", "m", [float("nan")] * 64), ("c001", "m", v[1].tolist())]
    df = spark.createDataFrame(rows, "chunk_id string, model string, dense array<float>")
    got = {(r.id, r.neighbour) for r in knn.similar_vectors(df, "chunk_id", "model", "dense").collect()}
    u = v.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    want = set()
    for i in range(len(u)):
        order = sorted((-round(s[i, j], 6), f"c{j:03d}") for j in range(len(u)) if j != i and s[i, j] >= 0.85)
        want |= {(f"c{i:03d}", n) for _, n in order[:5]}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert knn.similar_vectors(df.limit(0), "chunk_id", "model", "dense").count() == 0


def test_large_files_are_split(spark, monkeypatch):
    monkeypatch.setattr(knn, "FILE_ROWS", 10)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(50, 64))
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 0.1])
    df = spark.createDataFrame([(f"c{i:03d}", "m", x.tolist()) for i, x in enumerate(v)], "chunk_id string, model string, dense array<float>")
    got = {(r.id, r.neighbour) for r in knn.similar_vectors(df, "chunk_id", "model", "dense").collect()}
    assert {(f"c{i:03d}", f"c{i + 50:03d}") for i in range(50)} <= got


@pytest.mark.parametrize(("noise", "least"), [(0.1, 0.85), (0.02, 0.85), (0.1, -2.0)])
def test_cluster_of_a_third_is_searched_whole(spark, monkeypatch, noise, least):
    """Distinct near-copies of one source hold a third of the vectors, beside copies and scaled copies."""
    if hasattr(knn, "SLICE"):
        monkeypatch.setattr(knn, "FILE_ROWS", 700)
    rng = np.random.default_rng(4)
    far, one = rng.normal(size=(2000, 64)), rng.normal(size=64)
    v = np.concatenate([far, one + rng.normal(size=(1000, 64)) * noise, np.repeat(far[:1], 8, 0), far[:1] * 2]).astype(np.float32)
    df = spark.createDataFrame([(f"c{i:04d}", "m", x.tolist()) for i, x in enumerate(v)], "chunk_id string, model string, dense array<float>")
    got = {(r.id, r.place, r.neighbour) for r in knn.similar_vectors(df, "chunk_id", "model", "dense", least=least).collect()}
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -3)
    order = np.argsort(-s, axis=1, kind="stable")[:, :5]
    assert got == {(f"c{i:04d}", n + 1, f"c{j:04d}") for i in range(len(v)) for n, j in enumerate(order[i]) if s[i, j] >= max(least, -2)}


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("cluster", [0, 400])
def test_floor_rules_out_pairs_before_the_whole_product(monkeypatch, same, cluster):
    """Near pairs, some whose first values say nothing, equal brute force; only a cluster needs the
    k-th values of whole products."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x[1000:1060] = x[:60] + 0.3 * rng.normal(size=(60, 64))
    x[60:70, :40] = 0
    x[1060:1070] = x[60:70] + 0.1 * rng.normal(size=(10, 64))
    x[1100 : 1100 + cluster] = x[60] + 0.2 * rng.normal(size=(cluster, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, d = (x, x) if same else (x[:1000], x[1000:])
    want = np.round(q @ d.T, 12)
    if same:
        np.fill_diagonal(want, -3)
    if not cluster:
        monkeypatch.setattr(np, "partition", None)
    r, c, cos = knn.nearest_in(q, d, 5, 0.85, same, np.full(len(q), -3.0))
    place = np.argsort(-want, axis=1, kind="stable")[:, :5]
    expected = [(i, j) for i in range(len(q)) for j in place[i] if want[i, j] >= 0.85]
    assert len(expected) > 40 and list(zip(r, c)) == expected
    assert np.allclose(cos, [want[p] for p in expected], atol=1e-11)


def test_shuffle_follows_the_vectors(spark, monkeypatch):
    """Smaller blocks meet more often, but no vector is written more often."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"c{i:04d}", "m", x.tolist()) for i, x in enumerate(rng.normal(size=(2000, 64)))], "chunk_id string, model string, dense array<float>").cache()
    assert df.count() == 2000
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    took = {}
    for rows in (2000, 50):
        monkeypatch.setattr(knn, "FILE_ROWS", rows)
        before = written()
        assert knn.similar_vectors(df, "chunk_id", "model", "dense", least=-2.0).count() == 10_000
        took[rows] = written() - before
    assert 0 < took[50] < 2 * took[2000]


@pytest.mark.parametrize(("asks", "models", "kind"), [(1, 64, "float"), (16, 1, "double")])
def test_blocks_of_models_spread_and_gathered(spark, monkeypatch, asks, models, kind):
    for name, value in (("FILE_ROWS", 30), ("ASKS", asks), ("MODELS", models)):
        monkeypatch.setattr(knn, name, value, raising=False)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3, 200, 8)).astype(np.float32)
    df = spark.createDataFrame([(f"c{i:03d}", f"m{m}", x.tolist()) for m in range(3) for i, x in enumerate(v[m])], f"chunk_id string, model string, dense array<{kind}>")
    got = {(r.model, r.id, r.place, r.neighbour) for r in knn.similar_vectors(df, "chunk_id", "model", "dense", dim=8, least=-2.0).collect()}
    want = set()
    for m in range(3):
        u = v[m].astype(np.float64)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        s = np.round(u @ u.T, 12)
        np.fill_diagonal(s, -3)
        order = np.argsort(-s, axis=1, kind="stable")[:, :5]
        want |= {(f"m{m}", f"c{i:03d}", n + 1, f"c{j:03d}") for i in range(200) for n, j in enumerate(order[i])}
    assert got == want


# --- 7 ---------------------------------------------------------------------------------------

SAMPLES = {
    "pt": "O registro mostra que a bomba não pode parar. Quando o filtro fica sujo é preciso trocar a peça com cuidado.",
    "en": "The record shows that the pump must not stop. When the filter gets dirty you should change the part with care.",
    "es": "El registro muestra que la bomba no puede parar. Cuando el filtro está sucio hay que cambiar la pieza con cuidado.",
    "fr": "Le registre montre que la pompe ne doit pas arrêter. Quand le filtre est sale il faut changer la pièce avec soin.",
    "de": "Das Register zeigt, dass die Pumpe nicht halten darf. Wenn der Filter schmutzig ist, muss man das Teil mit Vorsicht tauschen.",
}


def test_language_segments(spark):
    fit = spark.createDataFrame([(i, t, l) for i, (l, t) in enumerate(SAMPLES.items())] + [(9, None, "pt"), (10, "x", "n/a")], "k int, t string, l string")
    model = language.fit(fit, "k", "t", "l")
    docs = [("mix", SAMPLES["pt"] + "\n\n" + SAMPLES["de"], "a/b.md"), ("one", SAMPLES["en"], "a/c/d.md"), ("none", None, "x"), ("blank", " ", None), ("code", "```\nfor x in y: print(x)\n```", "z")]
    segs = language.segments(spark.createDataFrame(docs, "doc string, body string, path string"), model, "doc", "body", "path")
    got = {(r.doc, r.language) for r in language.whole_passages(segs, "doc").collect()}
    assert got == {("mix", "pt"), ("mix", "de"), ("one", "en")}
    labels = spark.createDataFrame([("mix", "por"), ("one", "  "), ("one", "EN_us"), ("none", "pt")], "doc string, label string")
    assert {(r.doc, r.language) for r in language.wrong_labels(language.whole_passages(segs, "doc"), labels, "doc", "label").collect()} == {("mix", "de")}
    best = {r.doc: r.languages for r in language.document_language(segs, "doc").collect()}
    assert best["mix"] == 2 and best["one"] == 1


def test_fit_reads_whole_texts_and_hot_folders_are_salted(spark, monkeypatch):
    """Evidence after 20,000 signs counts; one folder holds all documents and priors are no broadcast."""
    fit = spark.createDataFrame([(i, "zzq " * 6_000 + t, l) for i, (l, t) in enumerate(SAMPLES.items())], "k int, t string, l string")
    model = language.fit(fit, "k", "t", "l")
    docs = spark.createDataFrame([(f"{l}{i}", t, "a/b/c.md") for l, t in SAMPLES.items() for i in range(20)], "doc string, body string, path string")
    small = {(r.doc, r.language) for r in language.segments(docs, model, "doc", "body", "path").collect()}
    monkeypatch.setattr(language, "BROADCAST_ROWS", 0)
    large = {(r.doc, r.language) for r in language.segments(docs, model, "doc", "body", "path").collect()}
    assert small == large == {(f"{l}{i}", l) for l in SAMPLES for i in range(20)}


@pytest.mark.parametrize(("label", "want"), [("pt-BR", "pt"), ("ENG", "en"), ("es-419", "es"), ("fra", "fr"), ("de_AT", "de"), ("und", None), ("", None), (None, None), ("n/a", None), ("xx", None)])
def test_labels(spark, label, want):
    assert spark.createDataFrame([(label,)], "l string").select(language.label_language(F.col("l")).alias("r")).first().r == want


def test_held_out_accuracy(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not here")
    df = spark.read.parquet(path)
    model = language.fit(df.where("doc_id % 2 = 0"), "doc_id", "text", "lang", rows=40)
    rest = df.where("doc_id % 2 = 1 and lang is not null and length(text) > 300").select("doc_id", "text", "lang", F.lit("x").alias("path"))
    got = language.document_language(language.segments(rest, model, "doc_id", "text", "path"), "doc_id").join(rest.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in got) >= 0.95 * len(got)


# --- 8 ---------------------------------------------------------------------------------------


def test_encoding_equals_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    enc = bpe.encoder(bpe.default_path())
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=enc.fst.ranks, special_tokens={})
    rng = random.Random(7)
    texts = ["", "a<|endoftext|>b", "  \n\n\t x", "É o João — 123.456,7 日本 😀", "=" * 200, "don't we'll"]
    texts += ["".join(rng.choice("abeo tr\nñÉ0-=_’😀") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in texts:
        ids = enc.encode(t)
        assert ids == public.encode_ordinary(t)
        assert bpe.decode(ids, enc.fst.bytes_of) == t
    df = spark.createDataFrame([(1, texts[3], 9), (2, None, 9), (3, "", 9), (1, texts[3], 9)], "doc_id bigint, text string, ids int")
    rows = [(r.doc_id, list(r.ids)) for r in bpe.encode_texts(df, "doc_id", "text").collect()]
    assert rows == [(1, public.encode_ordinary(texts[3])), (2, []), (3, []), (1, public.encode_ordinary(texts[3]))]
    assert bpe.round_trip(df, "doc_id", "text").where("not same").count() == 0


def test_utf8_machine_equals_python():
    rng = random.Random(9)
    for _ in range(2000):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xC0]) for _ in range(rng.randint(0, 8)))
        m = bpe.Utf8Machine()
        assert "".join(m.feed(data[i : i + 1]) for i in range(len(data))) + m.end() == data.decode("utf-8", "replace")


# --- 9 ---------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(40))) for i in range(20)] + [(90, None), (91, "too short")]
    docs, want = [], set()
    for d in range(60):
        words = [rng.choice(vocab) for _ in range(100)]
        i, kind = rng.randrange(20), d % 4
        w = items[i][1].split()
        if kind == 0:  # more than half, two words replaced
            part = w[5:32]
            part[7], part[20] = "X", "Y"
            words[30:30] = part
            want.add((d, i))
        elif kind == 1:  # all, dressed up
            words[10:10] = [x.upper() + "," for x in w]
            want.add((d, i))
        elif kind == 2:  # a quotation
            words[10:10] = w[:12]
        docs.append((d, " ".join(words), "e"))
    docs += [(99, None, "e"), (98, "", "e"), (1, docs[1][1], "e"), (None, docs[1][1], "e"), (97, " ... ", "e")]
    a = spark.createDataFrame(docs, "doc_id int, text string, item_id string")
    b = spark.createDataFrame(items + [(None, docs[0][1]), (92, "?!"), items[3]], "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(a, b, "doc_id", "text", "item_id", "text").collect()}
    assert got == want
    assert leakage.find_leaks(a, b.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert leakage.find_leaks(a.limit(0), b, "doc_id", "text", "item_id", "text").count() == 0


def test_short_items_leak_whole(spark):
    """Items of one to nine words and of ten, in a text, cut by one word, and with a word exchanged."""
    items = [(n, " ".join(f"k{n}w{i}" for i in range(n))) for n in (1, 2, 4, 5, 9, 10, 11)]
    docs = [(n * 10, f"before {t.upper()}, after") for n, t in items] + [(n * 10 + 1, "before " + " ".join(t.split()[1:]) + " x after") for n, t in items] + [(n * 10 + 2, "before " + t.replace(f"w{n // 2}", "wx") + " after") for n, t in items]
    found = leakage.find_leaks(spark.createDataFrame(docs, "d int, t string"), spark.createDataFrame(items, "i int, t string"), "d", "t", "i", "t")
    got = {(r.d, r.i) for r in found.collect()}
    assert {(n * 10, n) for n, _ in items} <= got and {x for x in got if x[1] < 10} == {(n * 10, n) for n in (1, 2, 4, 5, 9)}


def test_standing_phrase_is_no_leak_and_in_no_prefix(spark):
    rng = random.Random(19)
    phrase = "read the text below and then answer the question about it".split()
    items = [(i, " ".join(phrase + [f"v{rng.randrange(400)}" for _ in range(70)])) for i in range(30)]
    docs = [(d, " ".join([f"v{rng.randrange(400)}" for _ in range(50)] + phrase + [f"v{rng.randrange(400)}" for _ in range(50)])) for d in range(300)] + [(500 + i, "x y z " + " ".join(t.split()[20:70]) + " z") for i, t in items]
    a, b = spark.createDataFrame(docs, "d int, t string"), spark.createDataFrame(items, "i int, t string")
    assert {(r.d, r.i) for r in leakage.find_leaks(a, b, "d", "t", "i", "t").collect()} == {(500 + i, i) for i, _ in items}
    grams = leakage.item_shingles(b.select(F.col("i").cast("bigint").alias("u"), "t"), 0.5, 0.12)
    everywhere = {r.h for r in grams.groupBy("h").count().where("count = 30").collect()}
    seen = grams.groupBy("h").agg(F.count("*").alias("c"))  # a phrase as common in the corpus as in the items
    prefix = {r.h for r in leakage.prefixes(grams, seen).collect()}
    assert everywhere and not prefix & everywhere


def test_passage_against_brute_force():
    def lcs(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                rows[i][j] = rows[i + 1][j + 1] + 1 if a[i] == b[j] else max(rows[i + 1][j], rows[i][j + 1])
        return rows[0][0]

    rng = random.Random(23)
    for _ in range(400):
        a, b = [rng.choice("abcd") for _ in range(rng.randint(1, 14))], [rng.choice("abcde") for _ in range(rng.randint(0, 20))]
        assert leakage._common(a, b).sum() == lcs(a, b)
    long = [f"w{i % 5000}x{i // 5000}" for i in range(7_000)]
    assert leakage.passage(long, ["q"] * 50 + long[:3_000] + ["q"] + long[3_001:] + ["q"] * 50) == (6_999, 7_000)


# --- 10 --------------------------------------------------------------------------------------


def brute_share(words, run=6):
    n = len(words)
    hit = [False] * n
    for k in range(n - run + 1):
        if any(words[j : j + run] == words[k : k + run] for j in range(k)):
            hit[k : k + run] = [True] * run
    return sum(hit) / n if n >= run else 0.0


def test_repeated_share(spark):
    rng = random.Random(13)
    for _ in range(150):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        assert repetition.share_of_runs(w) == pytest.approx(brute_share(w))
    df = spark.createDataFrame([(1, "Um dois três quatro cinco seis 7. um DOIS três quatro, cinco seis 8!", "x"), (2, None, "x"), (3, "", "x"), (4, "a b c", "x")], "doc_id int, text string, n_words string")
    assert {r.doc_id: round(r.repeated_share, 3) for r in repetition.repeated_share(df, "doc_id", "text").collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0}


def test_kneser_ney_sums_to_one(spark):
    """Probabilities after a context, over the words that follow it and the rest by lower orders."""
    df = spark.createDataFrame([("a b c a b d a b c",), ("b c a",), (None,)], "t string")
    tri = repetition.count_trigrams(df, "t")
    m = repetition.kneser_ney(tri)
    rows = m.join(tri.drop("c"), "tri").groupBy("ctx").agg(F.sum(F.exp("logp")).alias("s")).collect()
    assert rows and all(0 < r.s <= 1 + 1e-9 for r in rows)


def test_perplexity_bands(spark, monkeypatch):
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(50)), "pt") for i in range(60)] + [(100, "a b " * 60, "pt"), (101, None, "pt"), (102, " ".join(f"x{i}" for i in range(60)), None), (103, "12 " * 500, "pt")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = {r.doc_id: r for r in repetition.perplexity(df, "doc_id", "text", "lang").collect()}
    assert len(got) == 64 and got[101].verdict == "empty" and got[102].language == "und"
    assert got[100].perplexity < min(got[i].perplexity for i in range(60))
    # The bands follow the spread, not a share of the documents: of alike texts none falls out.
    assert {got[i].verdict for i in range(60)} == {"ok"} and got[100].verdict == got[103].verdict == "low"
    # Many buckets, hot ones split, give the same.
    monkeypatch.setattr(repetition, "GROUP_ROWS", 40)
    again = {r.doc_id: r for r in repetition.perplexity(df, "doc_id", "text", "lang").collect()}
    assert {k: (r.n_words, r.verdict) for k, r in got.items()} == {k: (r.n_words, r.verdict) for k, r in again.items()}
    assert all(r.perplexity == pytest.approx(again[k].perplexity) for k, r in got.items() if r.perplexity)
    assert repetition.perplexity(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_words():
    assert plain_words("É **o** João-Luís 1.5") == ["e", "o", "joao", "luis", "1", "5"]
    assert measured_words("É 12,5 kg/3") == ["é", "0", "kg", "0"]
    assert plain_words(None) == measured_words("") == []


def test_word_memo_reads_the_same_words():
    rng, number = random.Random(29), {}
    memo = WordMemo(lambda w: number.setdefault(w, len(number)), limit=50)
    for _ in range(3000):
        t = "".join(rng.choice("aé²½™ªº ´¨ß\u0301_-'“…–A1\xad€\xa0ŉĳ·ſ\u2028\x1c") for _ in range(rng.randint(0, 12)))
        got, sizes = memo.values([t, None, t])
        assert got.tolist() == [number[w] for w in plain_words(t)] * 2 and sizes.tolist() == [len(got) // 2, 0, len(got) // 2]
        assert memo.words(t) == plain_words(t)
