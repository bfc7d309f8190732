"""Text, path and hash expressions. All are JVM-side columns without UDFs."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def repo_path(path: Column) -> Column:
    """`\\` becomes `/`; a leading dot with the slashes after it goes, once."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./+", "")


def location(path: Column, line: Column) -> Column:
    """`path:line`, with `unknown` for a missing file."""
    return F.concat_ws(":", F.coalesce(path, F.lit("unknown")), line.cast("string"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def pad_end(text: Column, width: int) -> Column:
    """Blanks up to `width`; longer texts stay whole."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def ellipsis(text: Column, n: int) -> Column:
    """At most n characters, with `...` after a cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def one_line(text: Column) -> Column:
    """Runs of white space, Unicode's too, become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def bare_identifier(text: Column) -> Column:
    return F.trim(F.translate(text, "`'\"", ""))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, which counts characters beyond the basic plane twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(utf16_length(text) / 4)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def contains_like(text: Column, term: Column) -> Column:
    """`LIKE '%term%'` that ignores ASCII case only; `_` and `%` in the term are wildcards, a backslash is itself."""
    pattern = F.concat(F.lit("%"), F.replace(ascii_lower(term), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.like(ascii_lower(text), pattern)


def _latin_folds() -> tuple[str, str]:
    """Latin letters that are an ASCII letter with marks, and those letters."""
    marked = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    marked = [(c, base) for c, base in marked if c != base and base in string.ascii_letters]
    return "".join(c for c, _ in marked), "".join(b for _, b in marked)


_MARKED, _BARE = _latin_folds()


def folded(text: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(text), _MARKED, _BARE)


def search_tokens(text: Column) -> Column:
    """Folded runs of letters and digits; null gives an empty array."""
    return F.filter(F.split(F.coalesce(folded(text), F.lit("")), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def has_phrase(tokens: Column, phrase: Column) -> Column:
    """Whether the token array `phrase` occurs in `tokens` in a row; an empty phrase never does."""
    flat = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return (F.size(phrase) > 0) & F.contains(flat, F.concat(F.lit(" "), F.array_join(phrase, " "), F.lit(" ")))


def search_terms(terms: Column) -> Column:
    """The phrases of a term list: split at white space, without `" * : ( ) - ^`, empty parts and AND, OR, NOT, NEAR."""
    parts = F.flatten(F.transform(terms, lambda t: F.split(F.coalesce(t, F.lit("")), r"(?U)\s+")))
    bare = F.transform(parts, lambda p: F.translate(p, '"*:()-^', ""))
    return F.filter(bare, lambda p: (p != "") & ~F.upper(p).isin("AND", "OR", "NOT", "NEAR"))


def search_query(terms: Column) -> Column:
    """The phrases quoted and joined by OR."""
    return F.array_join(F.transform(search_terms(terms), lambda p: F.concat(F.lit('"'), p, F.lit('"'))), " OR ")


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by `|`."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def question_key(question: Column, model: Column) -> Column:
    return cache_key(F.lower(F.trim(question)), model)


def string_array(json: Column) -> Column:
    """A JSON array of strings as an array; anything else is an empty one."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))
