"""Text scalars: Column to Column, inside code generation except where noted."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def unicode_normalize(form: str = "NFC"):
    """An Arrow UDF: the engine has no built-in for Unicode normal forms."""

    @pandas_udf(StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return normal


@pandas_udf(StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def normalize_punctuation(c: Column) -> Column:
    """Curly quotes, dashes and the ellipsis as plain characters."""
    plain = F.translate(c, "‘’“”–", "''\"\"-")
    return F.replace(F.replace(plain, F.lit("—"), F.lit("--")), F.lit("…"), F.lit("..."))


def normalize_whitespace(c: Column) -> Column:
    """Tabs to spaces, line ends to LF, runs of spaces to one, blank lines to one, ends stripped."""
    x = F.regexp_replace(F.regexp_replace(c, "\t", " "), "\r\n?", "\n")
    x = F.regexp_replace(F.regexp_replace(x, " +", " "), r"\n[ \n]*\n", "\n\n")
    return F.regexp_replace(F.regexp_replace(x, r"^[ \n]+", ""), r"[ \n]+$", "")


def flat_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\t\n\r]+", " "), " +", " "))


def normalize_text(c: Column, case: str | None = "lower") -> Column:
    x = normalize_punctuation(normalize_whitespace(c))
    return {"lower": F.lower, "upper": F.upper, "title": F.initcap}.get(case, lambda v: v)(x)


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def remove_html(c: Column) -> Column:
    """Script and style content, comments and tags removed; common entities decoded; blanks collapsed."""
    x = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[ \t\n\r]+", " "))


def html_title(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def sanitize(c: Column) -> Column:
    x = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    x = F.regexp_replace(x, r"(?is)<iframe[^>]*>.*?</iframe>", "")
    return F.regexp_replace(F.regexp_replace(x, r"(?i)javascript:", ""), r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+", "")


def remove_special(c: Column, keep_spaces: bool = True) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_ ]" if keep_spaces else r"[^\p{L}\p{N}_]", "")


def drop_empty_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda s: F.trim(s) != ""), "\n")


def safe_filename(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), 1, 255)


def class_name(c: Column) -> Column:
    """PascalCase of the words in a name."""
    return F.regexp_replace(F.initcap(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", " "))), " ", "")


def property_name(c: Column) -> Column:
    """camelCase of the words in a name."""
    pascal = class_name(c)
    return F.concat(F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, 2, 1 << 20))


# Titles that entity names may begin with.
TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.")


def entity_name(c: Column) -> Column:
    """Leading titles off, every part capitalised, blanks single."""
    pattern = "(?i)^(" + "|".join(t.replace(".", r"\.") for t in TITLES) + r")\s+"
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), pattern, "")))


# Frequent short words by language, enough to tell these apart.
STOPWORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "for"),
    "de": ("der", "die", "und", "das", "von", "zu", "mit", "den"),
    "fr": ("le", "la", "les", "et", "des", "une", "est", "dans"),
    "es": ("el", "los", "las", "del", "que", "una", "por", "con"),
}


def detect_language(c: Column, default: str = "en") -> Column:
    """The language with most stop words among the text's; texts under ten characters and ties without any: the default."""
    tokens = F.split(F.lower(c), r"[^\p{L}]+")

    def known(words: tuple[str, ...]):
        return lambda t: t.isin(*words)

    n = {g: F.size(F.filter(tokens, known(w))) for g, w in STOPWORDS.items()}
    top = F.greatest(*n.values())
    found = F.coalesce(*(F.when(v == top, F.lit(g)) for g, v in n.items()))
    return F.when((F.length(F.trim(c)) < 10) | (top == 0), F.lit(default)).otherwise(found)


def pii_free(c: Column) -> Column:
    """E-mail addresses masked."""
    return F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
