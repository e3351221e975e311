"""Text functions as column expressions: hashing, tokens, terms, sentences, snippets, addresses.

Regular expressions keep to ASCII classes, so that Spark and other SQL engines agree. All functions give null
for null input unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal in a query.
STOPWORDS = (
    "a an and are as at be been being but by can could did do does doing for from had has have having he her hers him "
    "his how i if in into is it its me my of on or our ours she should so than that the their theirs them then there "
    "these they this those to too us was we were what when where which who whom why will with would you your yours"
).split()
# Words that label nothing, besides the stop words.
LABEL_STOPWORDS = (
    "also because before being between both could does doing done each either every first from here into just like "
    "made make many more most much need only other over same some such than them then there these they this those thus "
    "using very what when where which while with would your"
).split()
# Abbreviations after which a sentence goes on.
ABBREVIATIONS = "e.g i.e etc vs fig eq no cf al mr mrs ms dr prof inc ltd st approx".split()
# Phrases by which an answer declines.
REFUSALS = [
    "do not contain",
    "does not contain",
    "no information",
    "not mentioned in the sources",
    "cannot answer",
    "can't answer",
    "the sources do not",
    "not covered by the sources",
    "i don't have enough information",
    "i do not have enough information",
]

WORD = r"[a-z0-9]+('[a-z]+)?"
TERM = r"[A-Za-z0-9_]+([.\-'][A-Za-z0-9_]+)*"
BREAK = r"([.!?])[ \t\n\r\f\x0B]+([\"'(\[]?[A-Z0-9])"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def token_estimate(text: Column) -> Column:
    """0 for empty, else a quarter of the characters, at least 1."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def normalize_whitespace(text: Column) -> Column:
    """One kind of line end, no blanks before it, at most one blank line, trimmed."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, "[ \t]+\n", "\n")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def squeeze(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def match_form(text: Column) -> Column:
    """The form in which texts are compared: lower case, white space squeezed."""
    return F.lower(squeeze(text))


def words(text: Column) -> Column:
    """Lower-case words with an inner apostrophe."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs joined by an underscore."""
    first = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.zip_with(first, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))


def ngrams(text: Column, n: int) -> Column:
    """Character n-grams of the squeezed lower-case text."""
    clean = match_form(text)
    return F.when(F.length(clean) >= n, F.transform(F.sequence(F.lit(1), F.length(clean) - n + 1), lambda i: F.substring(clean, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _all_terms(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.lower(F.btrim(t, F.lit("'-.")))), lambda t: F.length(t) >= 2))


def terms(text: Column) -> Column:
    """Search terms in order of first use: no stop words, unless there is nothing else."""
    every = _all_terms(text)
    kept = F.filter(every, lambda t: ~t.isin(*STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def query_phrases(text: Column, prefix_expansion: bool = True) -> Column:
    """What a query asks for, as structs (kind, tokens): quoted phrases; each term; each term of five letters or
    more once again as a prefix. Terms with inner marks are phrases of their parts."""
    split = lambda t: F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0))
    quoted = F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), lambda p: F.flatten(F.transform(_all_terms(p), split)))
    quoted = F.transform(F.filter(quoted, lambda p: F.size(p) > 0), lambda p: F.struct(F.lit("phrase").alias("kind"), p.alias("tokens")))
    rest = F.filter(F.transform(terms(F.regexp_replace(text, '"[^"]*"', " ")), lambda t: F.struct(t.alias("t"), split(t).alias("p"))), lambda x: F.size(x["p"]) > 0)
    single = F.transform(rest, lambda x: F.struct(F.when(F.size(x["p"]) > 1, F.lit("phrase")).otherwise(F.lit("term")).alias("kind"), x["p"].alias("tokens")))
    if not prefix_expansion:
        return F.concat(quoted, single)
    long = F.filter(rest, lambda x: (F.length(x["t"]) >= 5) & (F.size(x["p"]) == 1))
    return F.concat(quoted, single, F.transform(long, lambda x: F.struct(F.lit("prefix").alias("kind"), x["p"].alias("tokens"))))


def raw_sentences(text: Column) -> Column:
    """Cut after . ! ? before white space and a capital or digit, perhaps quoted."""
    clean = F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")
    return F.filter(F.split(F.regexp_replace(clean, BREAK, "$1\u001f$2"), "\u001f"), lambda s: F.length(F.trim(s)) > 0)


def sentences(text: Column) -> Column:
    """Sentences; what ends with an abbreviation goes on in the next piece."""
    last = lambda s: F.lower(F.regexp_extract(F.regexp_replace(s, r"[.]+$", ""), r"([^ \t\n\r\f\x0B]+)$", 1))
    open_ = lambda done: last(F.element_at(done, -1)).isin(*ABBREVIATIONS)
    return F.aggregate(
        raw_sentences(text),
        F.array().cast("array<string>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & open_(F.when(F.size(done) > 0, done).otherwise(F.array(F.lit("")))),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(F.when(F.size(done) > 0, done).otherwise(F.array(F.lit(""))), -1), F.trim(s)))),
        ).otherwise(F.concat(done, F.array(F.trim(s)))),
    )


def snippet(text: Column, limit: int = 320) -> Column:
    """The beginning of a text, with an ellipsis if it is cut."""
    clean = F.trim(text)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.rtrim(F.left(clean, F.lit(limit))), F.lit("…")))


def middle_words(text: Column, n: int = 8) -> Column:
    """The middle n words, without closing marks."""
    parts = F.filter(F.split(squeeze(text), " "), lambda w: w != "")
    start = F.greatest(F.lit(0), F.floor((F.size(parts) - n) / 2)).cast("int")
    return F.regexp_replace(F.array_join(F.slice(parts, start + 1, F.lit(n)), " "), "[.,;:]+$", "")


def percent_encode(text: Column) -> Column:
    """Percent encoding that leaves letters, digits and -._~ alone."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def timestamp_label(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def canonical_url(url: Column) -> Column:
    """Without fragment and closing slashes of the path (an empty path is /)."""
    bare = F.regexp_replace(url, "#.*$", "")
    head, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"(\?.*)$", 1)
    host, path = F.regexp_extract(head, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*)", 1), F.regexp_replace(head, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*", "")
    path = F.regexp_replace(path, "/+$", "")
    return F.concat(host, F.when(path == "", "/").otherwise(path), query)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def looks_like_refusal(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for r in REFUSALS:
        found = found | low.contains(r)
    return found


def title_from_path(path: Column) -> Column:
    """A file's name without its ending, marks as spaces, first letters raised."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.initcap(F.trim(F.regexp_replace(stem, r"[-_ \t]+", " ")))


def title_from_markdown(text: Column) -> Column:
    """The first # heading or title: line in the first 40 lines."""
    head = F.slice(F.split(text, "\n"), 1, 40)
    own = F.filter(head, lambda x: x.rlike(r"^# +\S") | x.rlike(r"(?i)^title: *\S"))
    found = F.get(own, F.lit(0))
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(found, r"^# +|(?i)^title: *", ""), r"^[\"']|[\"']$", "")), F.lit(""))


def line_of(text: Column, offset: Column) -> Column:
    """The line (from 1) of a character place (from 0)."""
    head = F.left(text, offset)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def strip_inline_markdown(text: Column) -> Column:
    """Without link targets, code marks and emphasis."""
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"`+|\*+|_{2,}|~~", ""), r"[ \t\n\r\f\x0B]{2,}", " "))


def keyword_coverage(term_array: Column, text: Column) -> Column:
    """The share of terms that a text contains; 0 without terms."""
    low = F.lower(text)
    return F.when(F.size(term_array) > 0, F.size(F.filter(term_array, lambda t: low.contains(t))) / F.size(term_array)).otherwise(0.0)


def embedding_text(heading: Column, text: Column) -> Column:
    """A chunk's text with its headings before it, unless it has them at its beginning."""
    return F.when((F.coalesce(heading, F.lit("")) != "") & ~F.contains(F.left(text, F.lit(200)), heading), F.concat(heading, F.lit("\n\n"), text)).otherwise(text)


def fragment_anchors(text: Column, n: int = 6) -> Column:
    """First and last n words, for links to a passage: struct (prefix, suffix)."""
    body = F.when(F.regexp_extract(text, r"^([^\n]*)\n\n", 1).contains("›"), F.regexp_replace(text, r"^[^\n]*\n\n", "")).otherwise(text)
    parts = F.filter(F.split(squeeze(F.regexp_replace(body, r"[#>*`\[\]()]|^-[ \t]+", " ")), " "), lambda w: w != "")
    prefix = F.array_join(F.slice(parts, 1, n), " ")
    suffix = F.when(F.size(parts) > n, F.array_join(F.slice(parts, F.size(parts) - n + 1, F.lit(n)), " ")).otherwise(prefix)
    return F.struct(prefix.alias("prefix"), suffix.alias("suffix"))


def normal_number(number: Column) -> Column:
    """A written number as a double, without separators and percent sign; null if it is none."""
    return F.regexp_replace(F.regexp_replace(number, ",", ""), "%$", "").try_cast("double")
