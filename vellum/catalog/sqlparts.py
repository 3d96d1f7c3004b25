"""SQL spellings of the building blocks, for the DuckDB side of the checks."""

from vellum.functions.text import BLANK


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{BLANK}+', ' ', 'g')")


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def unlines(x: str) -> str:
    return f"array_to_string({x}, chr(10))"


def words(x: str) -> str:
    """Words; an empty list for blank texts."""
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda w: w <> '')"


def fenced(source: str, key: str = "doc_id", text: str = "text") -> str:
    """Common table ``ls``: lines with place, stripped form, and whether they are code or fences."""
    return f"""
raw AS (SELECT {key} AS k, unnest({lines(text)}) AS l, generate_subscripts({lines(text)}, 1) AS p FROM {source} WHERE {text} IS NOT NULL),
st AS (SELECT *, {strip('l')} AS s FROM raw),
ls AS (SELECT *, starts_with(s, '```') OR sum(CASE WHEN starts_with(s, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p) % 2 = 1 AS code FROM st)"""
