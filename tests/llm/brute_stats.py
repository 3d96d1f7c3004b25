"""Text counts read one sign at a time: the brute force that the fast counts are tested against."""

import re

from vellum.llm.text_stats import COMMON, DIACRITICS, SYMBOLS

COUNTS = ("chars", "alnum", "letters", "digits", "blank", "symbols", "diacritics", "words", "word_chars", "common", "singles", "lines", "full_lines", "line_chars", "stopped_lines", "item_lines", "sentences", "prose_words")
_LETTERS = re.compile(r"[^\W\d_]+")
_ITEM = re.compile(r"(?:[-*+•–·▪‣]|\d{1,3}[.)]?|\[[ xX]?\]|\[|[a-z]\))$")
_END = re.compile(r"[.!?…][\"'»”)\]]*$")
_LEADER = re.compile(r"\.{3,}|…{2,}|_{3,}")
_TOKEN = re.compile(r"(\s*)(\S+)")
NEW_LINE, NEW_SENTENCE = [0, 0, 0, 0], [0, 0, 0, 0, 0]


def _is_prose(s):
    words, letters, common, singles, semis = s
    return letters >= 5 and common >= 2 and common >= 0.18 * letters and singles <= 0.7 * letters and semis <= 1


class Scan:
    """Sequential reader of tokens, started at a line start with nothing open."""

    def __init__(self) -> None:
        self.n = dict.fromkeys(COUNTS, 0)
        self.line, self.sentence = list(NEW_LINE), list(NEW_SENTENCE)
        self.run_char, self.run, self.longest = "", 0, 0

    def _close_sentence(self, ended: bool) -> None:
        if ended:
            self.n["sentences"] += 1
            if _is_prose(self.sentence):
                self.n["prose_words"] += self.sentence[0]
        self.sentence = list(NEW_SENTENCE)

    def _close_line(self) -> None:
        chars, items, stopped, pieces = self.line
        self.n["lines"] += 1
        if pieces:
            self.n["full_lines"] += 1
            self.n["line_chars"] += chars
            self.n["stopped_lines"] += stopped
            self.n["item_lines"] += items
        self.line = list(NEW_LINE)

    def blanks(self, run: str) -> None:
        if not run:
            return
        self.n["chars"] += len(run)
        self.n["blank"] += len(run)
        for ch in run:
            if ch in "\n\f":
                self._close_line()
            elif self.line[3]:
                self.line[0] += ch != "\r"
        self.run_char, self.run = "", 0

    def token(self, tok: str) -> None:
        """One run of non-blanks, however long: every pattern below reads it in linear time."""
        n = self.n
        n["chars"] += len(tok)
        alnum = 0
        for ch in tok:
            if ch.isalnum():
                alnum += 1
                n["digits"] += ch.isdigit()
                n["letters"] += ch.isalpha()
                if ch in DIACRITICS or ch.lower() in DIACRITICS:
                    n["diacritics"] += 1
            elif ch in SYMBOLS:
                n["symbols"] += 1
            if ch == self.run_char:
                self.run += 1
            else:
                self.run_char, self.run = ch, 1
            if self.run > self.longest:
                self.longest = self.run
        n["alnum"] += alnum
        words = _LETTERS.findall(tok)
        count = len(words) + (0 if words else bool(alnum))
        n["words"] += count
        n["word_chars"] += sum(map(len, words))
        common = sum(w.lower() in COMMON for w in words)
        n["common"] += common
        singles = sum(len(w) == 1 for w in words)
        n["singles"] += singles
        first = not self.line[3]
        if first and _ITEM.match(tok):
            self._close_sentence(False)
            self.line[1] = 1
        elif _LEADER.search(tok):
            self._close_sentence(False)
        s = self.sentence
        s[0] += count
        s[1] += len(words)
        s[2] += common
        s[3] += singles
        s[4] += tok.count(";")
        stopped = bool(_END.search(tok)) and not _LEADER.search(tok)
        self.line = [self.line[0] + len(tok), self.line[1], int(stopped or tok[-1] in ":;,"), 1]
        if stopped and not (first and self.line[1]):
            # A number with a point may be an ordinal; the sentence goes on then.
            if not re.fullmatch(r"\d{1,2}\.", tok):
                self._close_sentence(True)


def scan(text: str) -> Scan:
    """Counts of a whole text read in one go."""
    s = Scan()
    body = text.rstrip()
    for m in _TOKEN.finditer(body):
        s.blanks(m.group(1))
        s.token(m.group(2))
    s.blanks(text[len(body) :])
    return s


def counts(text):
    s = scan(text)
    if s.line[3]:
        s._close_line()
    return [s.n[c] for c in COUNTS] + [s.longest]
