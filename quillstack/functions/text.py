"""Text functions as Column expressions: blanks, cleaning, folding, tokens, chunks and acronyms.

Everything here is built from Spark functions, so it stays in generated code and pushes no row through Python.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regex class that Java and RE2 read alike: ASCII, the information separators, NEL and Unicode's separators.
BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
#: Inflectional endings in the order they are tried (fixed values).
ENDINGS = ("coes", "cao", "oes", "aos", "ais", "res", "es", "as", "os", "a", "o", "s")
#: Entities in the order they are replaced (fixed values).
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _folding() -> tuple[str, str]:
    """Latin letters whose decomposition is one base letter and marks, and those letters."""
    pairs = []
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(x for x in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != chr(i):
            pairs.append((chr(i), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space alone."""
    return col(c).isNull() | col(c).rlike(rf"\A{BLANK}*\z")


def present(c: Column | str) -> Column:
    return ~is_blank(c)


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"\A{BLANK}+|{BLANK}+\z", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), rf"{BLANK}+", " "))


def without_tags(c: Column | str) -> Column:
    """Null is empty, tags are spaces, white space is collapsed; entities, case and accents stay."""
    return collapse(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", " "))


def clean_html(c: Column | str) -> Column:
    """Plain text: null and the word nan are empty, tags become spaces, four entities are decoded in order, white space is collapsed."""
    c = col(c)
    out = F.regexp_replace(F.when(c.isNull() | (F.lower(strip(c)) == "nan"), "").otherwise(c), "<[^>]+>", " ")
    for entity, text in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(text))
    return collapse(out)


def document_text(*parts: Column | str) -> Column:
    """The parts in order with a space between; empty if all are."""
    return strip(F.concat_ws(" ", *(F.coalesce(col(p), F.lit("")) for p in parts)))


def words(c: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), rf"{BLANK}+"), lambda t: t != "")


def chunk_count(n: Column, size: int, overlap: int) -> Column:
    """Windows of `size` that cover n tokens; none for none."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and 0 <= overlap < size")
    more = F.ceil((n - size) / F.lit(float(size - overlap))).cast("int")
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(more + 1)


def chunk_words(tokens: Column | str, size: int = 100, overlap: int = 20) -> Column:
    """Overlapping windows of tokens as strings, in order; the last starts where the rest first fits.

    The tokens are bound once: as an expression inside the windows' own lambda they would be made again for each window.
    """
    step = size - overlap

    def windows(t: Column) -> Column:
        n = chunk_count(F.size(t), size, overlap)
        made = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_join(F.slice(t, i * step + 1, size), " "))
        return F.when(n > 0, made).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(col(tokens)), windows)[0]


def strip_accents(c: Column | str) -> Column:
    return F.regexp_replace(F.translate(col(c), ACCENTED, PLAIN), r"\p{Mn}", "")


def fold_query(c: Column | str) -> Column:
    """For questions and metadata: ordinals to letters, no accents, lower case, single spaces."""
    return collapse(F.lower(strip_accents(F.translate(F.coalesce(col(c), F.lit("")), "ªº°", "aoo"))))


def fold_evaluation(c: Column | str) -> Column:
    """For evaluation sets: no accents, lower case, single spaces; null is empty."""
    return collapse(F.lower(strip_accents(F.coalesce(col(c), F.lit("")))))


def _case_folding() -> dict[str, str]:
    """What full case folding makes of the characters that lower case leaves different."""
    known = (chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    return {c: c.casefold() for c in known if c.lower() == c != c.casefold()}


_folds: list[dict[str, str]] = []


def case_folded(c: Column | str) -> Column:
    """Full case folding: lower case, then the few characters that fold to others; texts without them skip the second step."""
    if not _folds:
        _folds.append(_case_folding())
    own, low = _folds[0], F.lower(col(c))
    table = F.create_map(*(F.lit(x) for kv in own.items() for x in kv))
    odd = "[" + "".join(f"\\x{{{ord(x):x}}}" for x in own) + "]"
    return F.when(low.rlike(odd), F.array_join(F.transform(F.split(low, ""), lambda x: F.coalesce(table[x], x)), "")).otherwise(low)


def fold_diagnostic(c: Column | str) -> Column:
    """For profiles: stripped, collapsed, no dots at the end, case folded; accents stay."""
    return case_folded(F.regexp_replace(collapse(c), r"\.+\z", ""))


def strip_parens(c: Column | str) -> Column:
    return collapse(F.regexp_replace(col(c), r"\([^)]*\)", " "))


def base_identity(c: Column | str) -> Column:
    """A component's folded name without parentheses and final dots: variants of one entity share it."""
    return F.regexp_replace(strip_parens(fold_query(c)), r"[. ]+\z", "")


def components(c: Column | str, separator: str = ";") -> Column:
    """A multivalued field's distinct parts, stripped, without final dots, none empty."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), separator), lambda p: strip(F.regexp_replace(strip(p), r"\.+\z", "")))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def is_acronym_like(t: Column | str) -> Column:
    """Has a letter, and a slash, or capitals alone, or two of them."""
    t = col(t)
    letters, upper = F.length(F.regexp_replace(t, r"[^\p{L}]", "")), F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    return (letters > 0) & (t.contains("/") | (upper == letters) | (upper >= 2))


def acronyms(paren: Column | str) -> Column:
    """Acronyms in the content of parentheses: each part's first token, unless a number follows it."""
    parts = F.transform(F.split(F.coalesce(col(paren), F.lit("")), "[,;]"), words)
    parts = F.filter(parts, lambda p: (F.size(p) > 0) & ~F.coalesce(F.get(p, F.lit(1)).rlike(r"\A\p{Nd}"), F.lit(False)))
    tokens = F.transform(parts, lambda p: F.regexp_replace(F.get(p, F.lit(0)), r"\A\.+|\.+\z", ""))
    return F.filter(tokens, lambda t: F.length(t).between(2, 12) & t.rlike(r"\A[A-Za-zºª]+(?:[/.\-][A-Za-z0-9ºª]+)*\z") & is_acronym_like(t))


def all_acronyms(c: Column | str) -> Column:
    """Acronyms of all parenthesised groups of a name."""
    groups = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\(([^)]+)\)"), F.lit(1))
    return F.flatten(F.transform(groups, acronyms))


def usable_acronym(folded: Column | str) -> Column:
    return col(folded).contains("/") | (F.length(col(folded)) >= 3)


def name_and_acronym(c: Column | str) -> tuple[Column, Column]:
    """('NAME', 'ACR') of 'NAME (ACR)'; without parentheses at the end the name is the whole and the acronym empty."""
    pattern = r"\A(.*?)\s*\(([^)]+)\)\s*\z"
    hit = col(c).rlike(pattern)
    return F.when(hit, F.regexp_extract(col(c), pattern, 1)).otherwise(col(c)), F.when(hit, F.regexp_extract(col(c), pattern, 2)).otherwise("")


def quoted(c: Column | str) -> Column:
    """As a literal inside a regex."""
    return F.regexp_replace(col(c), r"([\\.\[\]{}()*+?^$|/\-])", r"\\$1")


def mentions(text: Column | str, term: Column | str, inside: str = r"\w/") -> Column:
    """Whether the text has the term with no character of the class beside it."""
    return F.regexp_like(col(text), F.concat(F.lit(rf"(?<![{inside}])"), quoted(term), F.lit(rf"(?![{inside}])")))


def stem(t: Column | str) -> Column:
    """Without the first of the endings that leaves five letters."""
    t, out = col(t), None
    for ending in ENDINGS:
        fits = t.endswith(ending) & (F.length(t) - len(ending) >= 5)
        cut = F.substring(t, F.lit(1), F.length(t) - len(ending))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(t)


def description_terms(c: Column | str) -> Column:
    """Folded letters-and-digits terms of at least four characters."""
    return F.filter(F.split(fold_evaluation(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 4)


def displayed(c: Column | str, limit: int = 100) -> Column:
    """For Markdown cells: null is empty, cut with an ellipsis, pipes escaped, on one line."""
    c = F.coalesce(col(c), F.lit(""))
    cut = F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)
    return F.replace(F.replace(cut, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def shown_value(c: Column | str) -> Column:
    """For notebooks: null is empty, nan is a placeholder."""
    return F.when(col(c).isNull(), "").when(F.lower(strip(c)) == "nan", "(empty)").otherwise(strip(c))
