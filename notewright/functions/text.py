"""Text functions as Column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{00A0}\x{FEFF}]"

#: The common words that a search query's terms leave out.
SEARCH_STOP_WORDS = (
    "a an the and or but not nor in on at to for of with by is it its this that these those are was were be been being "
    "have has had do does did will would could should may might shall i me my we our you your he him his she her they them "
    "their what which who whom how when where why if then than so as about up out just also too very can into over after "
    "before between through during from above below both each few more most other some such no any"
).split()


def trim_all(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def html_to_text(markup: Column) -> Column:
    """Plain text of an HTML fragment by an ordered cascade of replacements; null is empty."""
    x = F.coalesce(markup, F.lit(""))
    # fixed values: the patterns, what replaces them, and their order make the text that is indexed
    for pattern, new in (
        (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""),
        (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"(?i)</div>", "\n"), (r"(?i)</h[1-6]>", "\n\n"), (r"(?i)</li>", "\n"), (r"(?i)</tr>", "\n"), (r"(?i)</td>", " | "),
        (r"(?i)</?ul[^>]*>", "\n"), (r"(?i)</?ol[^>]*>", "\n"), (r"(?i)<li[^>]*>", "• "),
        (r"(?i)<strong[^>]*>(.*?)</strong>", r"**$1**"), (r"(?i)<b[^>]*>(.*?)</b>", r"**$1**"), (r"(?i)<em[^>]*>(.*?)</em>", r"*$1*"), (r"(?i)<i[^>]*>(.*?)</i>", r"*$1*"),
        (r"""(?i)<a[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", r"$2 ($1)"), (r"<[^>]*>", ""),
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&[a-zA-Z]+;", ""),
        (r"\n\s*\n\s*\n", "\n\n"), (r"[ \t]+", " "),
    ):
        x = F.regexp_replace(x, pattern, new)
    return trim_all(x)


def embed_clean(text: Column) -> Column:
    """What an embedding sees: lower case, ASCII words and basic punctuation, single blanks."""
    x = F.regexp_replace(F.lower(text), r"\s+", " ")
    x = F.regexp_replace(x, r"""[^\w\s\-.,!?;:()\[\]{}'"]""", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


#: The entities that markup itself needs, as HTML reads them; &amp; last, so that nothing is read twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    """HTML entities as characters: common ones by built-in functions; only texts with others go to Python."""
    @F.pandas_udf("string")
    def rare(x: pd.Series) -> pd.Series:
        return x.map(html.unescape, na_action="ignore")

    plain = text
    for code, character in ENTITIES:
        plain = F.replace(plain, F.lit(code), F.lit(character))
    other = text.rlike("&(?!(?:lt|gt|quot|amp|nbsp|#39|#x27);)[a-zA-Z#]")
    return F.coalesce(rare(F.when(other, text)), plain)


def clean_note(text: Column) -> Column:
    """Without web addresses, inline images and runs of 100 or more characters; null is empty."""
    x = unescape(F.coalesce(text, F.lit("")))
    for pattern in (r"http\S+", r"""data:image/[a-zA-Z]+;base64,[^\s"')]+""", r"!\[.*?\]\([^)]{100,}\)", r"\S{100,}"):
        x = F.regexp_replace(x, pattern, "")
    return x


def word_tokens(text: Column, shortest: int = 2) -> Column:
    """Lower-case ASCII words: whole runs of letters, digits and underscores (of any script) that are only a-z."""
    every = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"))
    return F.filter(every, lambda w: w.rlike(f"^[a-z]{{{max(2, shortest)},}}$"))


def search_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"))


def meaningful_terms(query: Column) -> Column:
    """A query's terms in order, once each, without stop words and single characters."""
    return F.array_distinct(F.filter(search_tokens(query), lambda t: (F.length(t) > 1) & ~t.isin(*SEARCH_STOP_WORDS)))


def keyword_queries(query: Column) -> Column:
    """What full-text search asks for: the terms, the query as a phrase if it is quoted or has at most two terms, its last four and last three terms."""
    terms = meaningful_terms(query)
    last = lambda k: F.when(F.size(terms) >= k, F.array_join(F.slice(terms, -k, k), " "))
    phrase = F.when(query.rlike('"[^"]+"') | (F.size(terms) <= 2), F.trim(query))
    return F.struct(terms.alias("terms"), phrase.alias("phrase"), last(4).alias("last_four"), last(3).alias("last_three"))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def overlap_text(chunk: Column, overlap: int = 50) -> Column:
    """The last words of a chunk, repeated at the head of the next: half as many as overlap tokens."""
    if overlap <= 0:
        return F.lit("")
    words, n = F.split(F.coalesce(chunk, F.lit("")), r"\s+"), max(1, overlap // 2)
    return F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), F.lit(n)), " ")


def index_text(title: Column, plain: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), plain)


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def note_key(*columns: str) -> Column:
    return F.concat_ws("|||", *columns)


def strip_topic_number(label: Column) -> Column:
    return F.regexp_replace(label, r"^\d+_", "")


def tidy_label(label: Column) -> Column:
    """First line, without quotes around it and punctuation behind it."""
    return F.regexp_replace(F.regexp_replace(F.split(F.trim(label), "\n")[0], r"""^["']+|["']+$""", ""), "[.,;:]+$", "")


def shorten(text: Column, n: int = 40) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def bar(count: Column, most: Column, width: int = 30) -> Column:
    return F.repeat(F.lit("█"), F.floor(F.lit(width) * count / most).cast("int"))


def as_list(text: Column) -> Column:
    """Texts stored as one value: a list in JSON or in single quotes is read, any other text is a list of itself, null an empty one."""
    parsed = F.when(text.rlike(r"^\s*[\[(]"), F.from_json(F.translate(text, "()", "[]"), "array<string>", {"allowSingleQuotes": "true"}))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array(text)))


def is_number(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def label_from_json(reply: Column, fallback: Column) -> Column:
    """The label in a model's JSON reply, with or without a code fence around it."""
    bare = F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*|\s*```$", "")
    return F.coalesce(F.nullif(F.trim(F.get_json_object(bare, "$.label")), F.lit("")), fallback)
