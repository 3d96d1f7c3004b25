"""Missing or wrong document language labels (problem 7): Bayesian evidence fusion.

Evidence for the language of a segment: the likelihood of its words under character n-gram models,
the language its markup declares, the suffix of addresses it cites, and where the file lies (host).
Host priors come from grouped aggregation over all documents and are smoothed down the hierarchy
corpus -> top folder -> folder, so a rare folder leans on its parent. A text's sentences are decoded
together with a cost for each change of language; runs of sentences are the text's segments.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellum.runtime import BROADCAST_ROWS, cut

#: Languages and the codes that give them (fixed values).
LANGUAGES = ("pt", "en", "es", "fr", "de")
CODES = {
    "pt": "pt", "por": "pt", "en": "en", "eng": "en", "es": "es", "spa": "es",
    "fr": "fr", "fra": "fr", "fre": "fr", "de": "de", "deu": "de", "ger": "de",
}
#: Address suffixes and the language they speak for, with weak odds (fixed values).
SUFFIXES = {"pt": "pt", "br": "pt", "uk": "en", "us": "en", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "de": "de", "at": "de"}

#: Labelled texts per language from which the models are fitted, each read whole; the only sample in
#: this module.
FIT_ROWS = 300
#: Words of one run of sentences that make a whole passage.
PASSAGE_WORDS = 15
#: Cost, in nats, of changing the language between two sentences.
SWITCH = 6.0
#: Odds of a declared language and of an address suffix being right.
DECLARED_LOG, SUFFIX_LOG = 2.0, 0.7
#: Weight of a parent level, in documents, when a host level is smoothed.
SMOOTHING = 10.0

_WORD = re.compile(r"[^\W\d_]+")
_DECLARED = re.compile(r"(?i)\blang(?:uage)?\s*[=:]\s*[\"']?([a-z]{2,3})\b")
_ADDRESS = re.compile(r"(?i)\bhttps?://[^\s/<>()\"']+\.([a-z]{2,})\b")
_CODE = re.compile(r"(?ms)^[ ]{0,3}(`{3,}|~{3,}).*?(?:^[ ]{0,3}\1[`~]*\s*$|\Z)|<(pre|script|style)\b.*?(?:</\2>|\Z)|\\begin\{verbatim\}.*?(?:\\end\{verbatim\}|\Z)")
_MARK = re.compile(r"</?[A-Za-z!][^<>]*>|&[A-Za-z]{2,8};|\\[A-Za-z]+\*?|[*_`~#{}|\[\]]+")
_PLAIN = re.compile(r"[<&\\*_`~#{}|\[\]\-‐\u00ad¬]")
_BREAK = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|\n\s*\n|\f")
#: Rows of tables and items of lists, which are no sentences whatever they end with.
_ROW = re.compile(r"(?i)<(?:table|thead|tbody|tr|td|th)\b|\\item\b|(?:\|[^|]*){3}")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐­¬][ \t]*\n\s*(?=[^\W\d_])")


def label_language(c: Column) -> Column:
    """Language of a label: two- or three-letter code in any case, with or without region; else null."""
    code = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    pairs = [x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[code]


class Model:
    """Character n-gram likelihoods of the languages, additively smoothed."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        counts = {l: Counter(counts.get(l, {})) for l in LANGUAGES}
        shared = set().union(*counts.values())
        vocabulary = max(1, len(shared))
        totals = [sum(counts[l].values()) + 0.5 * vocabulary for l in LANGUAGES]
        self.unseen = np.log(0.5 / np.array(totals))
        self.table = {g: np.log((np.array([counts[l][g] for l in LANGUAGES]) + 0.5) / np.array(totals)) for g in shared}
        self._reset()

    def _reset(self) -> None:
        #: Rows of known words in one growing matrix, so that a text is scored by one lookup.
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, len(LANGUAGES)))

    def __getstate__(self):
        return {"unseen": self.unseen, "table": self.table}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    @staticmethod
    def grams(word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]

    def _row(self, w: str) -> int:
        """Log likelihoods per language, damped because overlapping n-grams are not independent."""
        k = self.rows[w] = len(self.rows)
        if k == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        s = sum((self.table.get(g, self.unseen) for g in self.grams(w)), np.zeros(len(LANGUAGES))) / 4
        self.scores[k] = s - s.max()
        return k

    def score(self, sentences: list[list[str]]) -> np.ndarray:
        """Log likelihoods of non-empty word lists, one row each."""
        if len(self.rows) > 200_000:
            self._reset()
        rows, known = [], self.rows.get
        for words in sentences:
            for w in words:
                k = known(w)
                rows.append(self._row(w) if k is None else k)
        starts = np.cumsum([0] + [len(x) for x in sentences[:-1]])
        return np.add.reduceat(self.scores[rows], starts, axis=0)


def fit(labelled: DataFrame, key: str, text: str, label: str, rows: int = FIT_ROWS) -> Model:
    """Model from at most ``rows`` texts per language, those of smallest key hash.

    The rank is pruned inside each task before the shuffle, so a language that owns a third of all
    rows sends no more than ``rows`` of them per task."""
    have = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), label_language(F.col(label)).alias("l")).where("l is not null and length(trim(t)) > 0")
    w = W.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    few = have.withColumn("n", F.row_number().over(w)).where(F.col("n") <= rows).select("l", "t")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for l, t in zip(pdf["l"], pdf["t"]):
                grams: Counter = Counter()
                for x, n in Counter(_WORD.findall(t.casefold())).items():
                    for g in Model.grams(x):
                        grams[g] += n
                if grams:
                    yield pd.DataFrame({"l": l, "g": list(grams), "n": list(grams.values())})

    counts: dict[str, dict[str, int]] = {}
    for r in few.mapInPandas(count, "l string, g string, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r.l, {})[r.g] = r.n
    return Model(counts)


def sentences(text: str) -> list[tuple[str, int, int, bool]]:
    """(sentence, start, end, is prose) of a text; code counts as no sentence."""
    s = _CODE.sub(lambda m: " " * len(m.group()), text)
    out, at = [], 0
    for m in list(_BREAK.finditer(s)) + [None]:
        end = m.start() if m else len(s)
        part = s[at:end]
        if part.strip():
            prose = bool(re.search(r"[.!?…:][\"'»”)\]*_\s]*$", part)) and not _ROW.search(part)
            out.append((part, at, end, prose))
        at = m.end() if m else end
    return out


def spell(text: str, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sentences of a text: ``(start, end, words, prose words)`` rows and their log likelihoods."""
    spans, words = [], []
    for part, start, end, prose in sentences(text):
        if _PLAIN.search(part):
            part = _MARK.sub(" ", _HYPHEN.sub("", part))
        w = [x for x in _WORD.findall(part.casefold()) if len(x) > 1]
        if len(w) >= 2:
            spans.append((start, end, len(w), len(w) if prose else 0))
            words.append(w)
    if not spans:
        return np.zeros((0, 4), np.int64), np.zeros((0, len(LANGUAGES)))
    return np.array(spans, np.int64), model.score(words)


def decode(spans: np.ndarray, scores: np.ndarray, prior: np.ndarray) -> list[tuple[int, int, str, float, int, int]]:
    """Segments (start, end, language, confidence, words, prose words): the best sequence of
    languages, each change costing ``SWITCH``, cut into runs."""
    if not len(spans):
        return []
    best = prior + scores[0]
    back = np.zeros((len(scores), len(LANGUAGES)), np.int8)
    keep = np.arange(len(LANGUAGES), dtype=np.int8)
    for k in range(1, len(scores)):
        top = int(best.argmax())
        stay = best >= best[top] - SWITCH
        back[k] = np.where(stay, keep, top)
        best = np.where(stay, best, best[top] - SWITCH) + scores[k]
    path = np.empty(len(scores), np.int8)
    path[-1] = best.argmax()
    for k in range(len(scores) - 1, 0, -1):
        path[k - 1] = back[k][path[k]]
    edges = np.flatnonzero(np.diff(path)) + 1
    out = []
    for a, e in zip([0, *edges], [*edges, len(path)]):
        s = scores[a:e].sum(0) + prior
        p = np.exp(s - s.max())
        out.append((int(spans[a][0]), int(spans[e - 1][1]), LANGUAGES[path[a]], float(p[path[a]] / p.sum()), int(spans[a:e, 2].sum()), int(spans[a:e, 3].sum())))
    return out


def _hosts(path: Column) -> list[Column]:
    """Host levels of a path, from wide to narrow; separators and case do not matter."""
    p = F.split(F.lower(F.translate(F.coalesce(path, F.lit("")), "\\", "/")), "/")
    depth = F.size(p) - 1
    top = F.when(depth >= 1, F.element_at(p, 1)).otherwise("")
    return [top, F.when(depth >= 2, F.concat_ws("/", F.slice(p, 1, 2))).otherwise(top)]


def host_priors(votes: DataFrame) -> DataFrame:
    """``(h1, h2, prior ARRAY<DOUBLE>)`` from ``(h1, h2, v0..v4)`` votes of documents."""
    v = [f"v{i}" for i in range(len(LANGUAGES))]
    narrow = votes.groupBy("h1", "h2").agg(*[F.sum(c).alias(c) for c in v])
    wide = narrow.groupBy("h1").agg(*[F.sum(c).alias(f"w{c}") for c in v])
    all_ = wide.agg(*[F.sum(f"w{c}").alias(c) for c in v]).first()
    base = np.array([float(all_[c] or 0) for c in v]) + 1.0
    base = base / base.sum()
    total = lambda p: sum(F.col(f"{p}{c}") for c in v)
    mid = [(F.col(f"w{c}") + SMOOTHING * float(b)) / (total("w") + SMOOTHING) for c, b in zip(v, base)]
    wide = wide.select("h1", *[m.alias(f"m{c}") for m, c in zip(mid, v)])
    joined = narrow.join(wide, "h1")
    return joined.select("h1", "h2", F.array(*[(F.col(c) + SMOOTHING * F.col(f"m{c}")) / (total("") + SMOOTHING) for c in v]).alias("prior"))


def hints(text: str) -> np.ndarray:
    """Log evidence of declared markup languages and address suffixes, each counted once."""
    out = np.zeros(len(LANGUAGES))
    for code in {m.lower() for m in _DECLARED.findall(text)}:
        if CODES.get(code) in LANGUAGES:
            out[LANGUAGES.index(CODES[code])] += DECLARED_LOG
    for suffix in {m.lower() for m in _ADDRESS.findall(text)}:
        if suffix in SUFFIXES:
            out[LANGUAGES.index(SUFFIXES[suffix])] += SUFFIX_LOG
    return out


def segments(docs: DataFrame, model: Model, key: str, text: str, path: str) -> DataFrame:
    """``(key, seq, char_start, char_end, language, confidence, words, prose_words)``.

    One row per run of sentences in one language. Null, empty and wordless texts give no rows;
    repeated rows are kept; other columns are ignored. Texts are read once: sentence likelihoods are
    kept in the shared folder, vote for the host priors, and are decoded again with them.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]
    h1, h2 = _hosts(F.col(path))
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), h1.alias("h1"), h2.alias("h2"))
    v = [f"v{i}" for i in range(len(LANGUAGES))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in batches:
            votes = np.zeros((len(pdf), len(LANGUAGES)))
            spans, scores, known = [], [], []
            for i, t in enumerate(pdf["t"]):
                s, x = spell(t, m)
                h = hints(t)
                for _, _, l, c, n, _ in decode(s, x, h):
                    votes[i, LANGUAGES.index(l)] += c * n
                spans.append(s.ravel())
                scores.append(x.astype(np.float32).ravel())
                known.append(h)
            votes /= np.maximum(votes.sum(1, keepdims=True), 1e-9)
            yield pd.DataFrame({"k": pdf["k"], "h1": pdf["h1"], "h2": pdf["h2"], "spans": spans, "scores": scores, "hints": known} | {c: votes[:, i] for i, c in enumerate(v)})

    schema = f"k {kind}, h1 string, h2 string, spans array<bigint>, scores array<float>, hints array<double>, " + ", ".join(f"{c} double" for c in v)
    read_once = cut(rows.mapInPandas(read, schema))
    priors = cut(host_priors(read_once.select("h1", "h2", *v)))
    n, salts = priors.count(), 16
    heard = read_once.where(F.size("spans") > 0)
    if n <= BROADCAST_ROWS:
        fused = heard.join(F.broadcast(priors), ["h1", "h2"])
    else:  # a folder may hold a third of all documents
        salted = priors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        fused = heard.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(salts)).cast("int")).join(salted, ["h1", "h2", "salt"])
    fused = fused.select("k", "spans", "scores", "hints", "prior")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, s, x, h, p in zip(pdf["k"], pdf["spans"], pdf["scores"], pdf["hints"], pdf["prior"]):
                prior = np.asarray(h) + np.log(np.maximum(np.asarray(p), 1e-6))
                found = decode(np.asarray(s).reshape(-1, 4), np.asarray(x, np.float64).reshape(-1, len(LANGUAGES)), prior)
                out += [(k, i, *f) for i, f in enumerate(found)]
            if out:
                yield pd.DataFrame(out, columns=["k", "seq", "char_start", "char_end", "language", "confidence", "words", "prose_words"])

    out = fused.mapInPandas(work, f"k {kind}, seq int, char_start bigint, char_end bigint, language string, confidence double, words bigint, prose_words bigint")
    return out.withColumnRenamed("k", key)


def document_language(segs: DataFrame, key: str) -> DataFrame:
    """``(key, language, confidence, languages)``: the language of most words; the confidence is its
    share of the words, each weighted by its segment's confidence."""
    per = segs.groupBy(key, "language").agg(F.sum("words").alias("n"), F.sum(F.col("words") * F.col("confidence")).alias("c"))
    best = per.groupBy(key).agg(F.max(F.struct("n", "language", "c")).alias("b"), F.sum("n").alias("all"), F.count("*").alias("languages"))
    return best.select(key, F.col("b.language").alias("language"), (F.col("b.c") / F.col("all")).alias("confidence"), "languages")


def whole_passages(segs: DataFrame, key: str, words: int = PASSAGE_WORDS, confidence: float = 0.8) -> DataFrame:
    """Distinct ``(key, language)`` with a segment of at least ``words`` words of prose."""
    return segs.where((F.col("prose_words") >= words) & (F.col("confidence") >= confidence)).select(key, "language").distinct()


def wrong_labels(passages: DataFrame, labelled: DataFrame, key: str, label: str) -> DataFrame:
    """Passage languages that no label of the same key gives; keys without label rows are left out."""
    given = labelled.where(F.col(key).isNotNull()).select(key, label_language(F.col(label)).alias("language")).distinct()
    return passages.join(given.select(key).distinct(), key, "left_semi").join(given.where("language is not null"), [key, "language"], "left_anti")
