"""Text quality, overlap of two readings, and layout hints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vellum.functions.text import BLANK, let, lines, strip

#: Common words of four letters or more, which word sets leave out (fixed values).
STOPWORDS = (
    "about above after again against because been before being below between both could does doing down during each from "
    "further have having here hers herself himself into itself just more most myself once only other ours over same should "
    "some such than that their them themselves then there these they this those through under until very were what when "
    "where which while whom will with your yours yourself yourselves numa numas nuns para pelo pela pelos pelas suas umas"
).split()
#: Hints, signs and limits of the score (fixed values).
PT_HINTS = (" o ", " a ", " de ", " que ", " para ", " com ", " não ", " é ")
DIACRITICS = "áàãâäéêëíîïóôõöúûüçñ"
SYMBOL_CLASS = r"[|\\/<>{}\[\]~`^_=+@#$%&*!]"
WEIGHTS = {"alnum": 0.35, "symbol": 0.20, "line": 0.15, "empty": 0.10, "repeat": 0.10, "confidence": 0.10}
MAX_SYMBOLS, IDEAL_LINE, MAX_EMPTY, MIN_DIACRITICS, MIN_PIPES, MAX_NUMERIC = 0.10, 60.0, 0.50, 0.008, 0.30, 0.20
HEADING_WORDS = "introdu|conclu|resumo|sumári|capítul|seção|abstract|introduction|conclusion|summary|chapter|section|referênc|bibliograf|anexo|apêndic"


def word_set(c: Column) -> Column:
    """Distinct lower-case words of four signs or more that are not stopwords."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{4,})"), F.lit(1)))
    return F.array_except(w, F.array(*[F.lit(x) for x in STOPWORDS]))


def number_set(c: Column) -> Column:
    """Distinct numbers with separators, or of two digits or more."""
    edge = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"({edge[0]}\d+(?:[.,]\d+)+{edge[1]}|{edge[0]}\d{{2,}}{edge[1]})"), F.lit(1)))


def heading_lines(c: Column) -> Column:
    """ATX heading lines."""
    return F.filter(lines(c), lambda l: l.rlike(r"\A#{1,6}\s."))


def _share(c: Column, outside: str) -> Column:
    """Share of the signs that remain when everything matching ``outside`` is removed."""
    return F.length(F.regexp_replace(c, outside, "")) / F.greatest(F.length(c), F.lit(1))


def overlap(native: Column, output: Column) -> Column:
    """How much of the native words and numbers the output holds, in percent."""
    nw, ow, nn, on = word_set(native), word_set(output), number_set(native), number_set(output)
    shared, numbers = F.size(F.array_intersect(nw, ow)), F.size(F.array_intersect(nn, on))
    pct = lambda a, b: F.round(a / F.greatest(b, F.lit(1)) * 100, 1)
    return F.struct(
        pct(shared, F.size(nw)).alias("word_recall_pct"), pct(numbers, F.size(nn)).alias("num_recall_pct"),
        F.size(nw).alias("native_words"), F.size(ow).alias("output_words"), shared.alias("shared_words"),
        F.size(nn).alias("native_numbers"), F.size(on).alias("output_numbers"), numbers.alias("shared_numbers"),
        F.size(heading_lines(output)).alias("output_headings"),
    )


def is_portuguese(c: Column) -> Column:
    s = F.concat(F.lit(" "), F.lower(F.substring(c, 1, 2000)), F.lit(" "))
    return s.rlike("|".join(PT_HINTS))


def diacritic_ratio(c: Column) -> Column:
    """Share of the letters that bear a mark of Portuguese; 1.0 without letters."""
    letters = F.regexp_replace(F.lower(c), r"[^\p{L}]", "")
    marked = F.length(F.regexp_replace(letters, f"[^{DIACRITICS}]", ""))
    return F.when(F.length(letters) == 0, F.lit(1.0)).otherwise(marked / F.length(letters))


def numeric_density(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(_share(c, r"[^\p{Nd}.%,;()\[\]]"))


def _full_lines(ls: Column) -> Column:
    """``array<struct<s, p>>``: stripped lines that are not blank, and their columns, null without a pipe."""
    cols = lambda l: F.when(l.contains("|"), F.length(F.regexp_replace(F.regexp_replace(l, r"\A\|+|\|+\z", ""), r"[^|]", "")))
    return F.filter(F.transform(ls, lambda l: F.struct(strip(l).alias("s"), cols(l).alias("p"), F.length(l).alias("n"))), lambda x: x["s"] != "")


def _is_table(full: Column) -> Column:
    body = F.filter(full, lambda x: ~x["s"].startswith("#"))
    pipes = F.size(F.filter(body, lambda x: x["p"].isNotNull()))
    return (F.size(body) >= 3) & (pipes >= 2) & (pipes / F.greatest(F.size(body), F.lit(1)) >= MIN_PIPES)


def _table_quality(full: Column) -> Column:
    """Share of lines with pipes, and of rows with the usual number of columns: the longest run of
    equal numbers in sorted order, found in one pass."""

    def score(cols: Column) -> Column:
        n = F.size(cols)
        share = n / F.greatest(F.size(full), F.lit(1))
        start = F.struct(F.lit(-1).alias("v"), F.lit(0).alias("k"), F.lit(0).alias("best"))

        def step(a, v):
            k = F.when(a["v"] == v, a["k"] + 1).otherwise(1)
            return F.struct(v.alias("v"), k.alias("k"), F.greatest(a["best"], k).alias("best"))

        usual = F.aggregate(cols, start, step, lambda a: a["best"])
        return F.when(n == 0, F.lit(0.0)).when(share < MIN_PIPES, share / MIN_PIPES).when(n < 3, share).otherwise(share * 0.3 + usual / n * 0.7)

    return let(F.array_sort(F.filter(F.transform(full, lambda x: x["p"]), lambda p: p.isNotNull())), score)


def looks_like_table(c: Column) -> Column:
    return let(_full_lines(lines(c)), _is_table)


def table_quality(c: Column) -> Column:
    """Share of lines with pipes and of rows with the usual number of columns."""
    return let(_full_lines(lines(c)), _table_quality)


def score_quality(c: Column, confidence: Column | None = None, min_chars: Column | int = 20) -> Column:
    """Struct of the score and its parts. Null texts count as empty; a null confidence as full.

    The text, its lines and its ratios are bound once each."""
    conf = F.coalesce(confidence.cast("double"), F.lit(1.0)) if confidence is not None else F.lit(1.0)
    least = min_chars if isinstance(min_chars, Column) else F.lit(min_chars)

    def parts(t: Column) -> Column:
        def counted(ls: Column) -> Column:
            return let(_full_lines(ls), lambda full: measured(ls, full))

        def measured(ls: Column, full: Column) -> Column:
            return let(
                F.struct(
                    (F.length(strip(t)) < least).alias("short"),
                    _share(t, r"[^\p{L}\p{N}" + BLANK[1:]).alias("alnum"),
                    _share(t, SYMBOL_CLASS.replace("[|", "[^|", 1)).alias("symbol"),
                    (F.aggregate(full, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]) / F.greatest(F.size(full), F.lit(1))).alias("line"),
                    ((F.size(ls) - F.size(full)) / F.size(ls)).alias("empty"),
                    t.rlike(r"(?d)(.)\1{7,}").alias("repeated"),
                    diacritic_ratio(t).alias("marks"),
                ),
                lambda m: scored(m, full),
            )

        def scored(m: Column, full: Column) -> Column:
            base = (
                WEIGHTS["alnum"] * m["alnum"]
                + WEIGHTS["symbol"] * F.greatest(F.lit(0.0), 1 - m["symbol"] / MAX_SYMBOLS)
                + WEIGHTS["line"] * F.least(F.lit(1.0), m["line"] / IDEAL_LINE)
                + WEIGHTS["empty"] * F.greatest(F.lit(0.0), 1 - m["empty"] / MAX_EMPTY)
                + WEIGHTS["repeat"] * F.when(m["repeated"], 0.0).otherwise(1.0)
                + WEIGHTS["confidence"] * conf
            )
            # The cheap test first: few texts have so few marks.
            marks = F.when(m["marks"] < MIN_DIACRITICS, F.when(is_portuguese(t), 0.4 + 0.6 * m["marks"] / MIN_DIACRITICS).otherwise(1.0)).otherwise(1.0)
            shape = F.when(_is_table(full), 0.5 + 0.5 * _table_quality(full)).when(numeric_density(t) > MAX_NUMERIC, 0.5).otherwise(1.0)
            pick = lambda none, value: F.when(m["short"], F.lit(none)).otherwise(value)
            return F.struct(
                pick(0.0, base * marks * shape).alias("score"), F.length(t).alias("char_count"), pick(0.0, m["alnum"]).alias("alphanumeric_ratio"),
                pick(1.0, m["symbol"]).alias("symbol_ratio"), pick(0.0, m["line"]).alias("avg_line_length"), pick(1.0, m["empty"]).alias("empty_line_ratio"),
                pick(False, m["repeated"]).alias("has_repeated_chars"), pick(0.0, m["marks"]).alias("diacritic_ratio"),
            )

        return let(lines(t), counted)

    return let(F.coalesce(c, F.lit("")), parts)


def item_min_chars(kind: Column) -> Column:
    """Shortest text that is judged, by kind of item."""
    return F.when(kind == "heading", 5).when(kind == "table", 10).otherwise(20)


def route(native: Column, ocr: Column, confidence: Column, threshold: float) -> Column:
    """Accept a reading by its agreement with 20 or more native signs, else by its score."""

    def decide(n: Column, o: Column) -> Column:
        def agreement(x: Column) -> Column:
            words = F.size(F.array_intersect(x["nw"], x["ow"])) / F.greatest(F.size(x["nw"]), F.lit(1))
            numbers = F.when(F.size(x["nn"]) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x["nn"], x["on"])) / F.size(x["nn"]))
            return words * 0.7 + numbers * 0.3

        sets = F.struct(word_set(n).alias("nw"), word_set(o).alias("ow"), number_set(n).alias("nn"), number_set(o).alias("on"))
        long = F.length(n) >= 20
        value = F.when(long, let(sets, agreement)).otherwise(score_quality(o, confidence)["score"])
        return let(value, lambda v: F.struct(F.when(long, "reference").otherwise("heuristic").alias("method"), v.alias("value"), (v >= threshold).alias("accepted")))

    return let(strip(F.coalesce(native, F.lit(""))), lambda n: let(strip(F.coalesce(ocr, F.lit(""))), lambda o: decide(n, o)))


def detect_heading(text: Column, size: Column, bold: Column) -> Column:
    """Heading level of a text block from its font; null if it is none."""
    t = strip(F.coalesce(text, F.lit("")))
    titled = (F.length(t) < 100) & ~t.rlike(r"[.:?]\z") & (size >= 12) & F.lower(t).rlike(HEADING_WORDS)
    b = F.coalesce(bold, F.lit(False))
    return (
        F.when((t == "") | size.isNull() | (size == 0), None)
        .when(b & (size >= 16), 1).when(b & (size >= 14), 2).when(b & (size >= 12), 3).when(b, 4)
        .when(titled, F.when(size >= 14, 2).otherwise(3))
    )


def is_list_item(text: Column) -> Column:
    """A bullet, or a digit followed by a point, bracket or colon."""
    return strip(F.coalesce(text, F.lit(""))).rlike(r"(?s)\A(?:[•\-–—*▪▸▹▶►]|\p{Nd}[.):].)")


def has_meaningful_text(text: Column, least: int = 50) -> Column:
    """F16."""
    return F.length(strip(F.coalesce(text, F.lit("")))) >= least


def completeness(word_pct: Column, number_pct: Column, native_words: Column, native_numbers: Column) -> Column:
    """Enough of the native words (80 %) and numbers (90 %) came out."""
    return ((native_words == 0) | (word_pct >= 80)) & ((native_numbers == 0) | (number_pct >= 90))
