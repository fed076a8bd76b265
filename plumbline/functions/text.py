"""Column expressions for text segmentation and text features.

Lengths are UTF-8 bytes, spans are character offsets, white space and letters
follow Unicode. Everything stays a built-in expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Unicode White_Space, as literal characters and as a regex class body.
WS = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
RARE_WS = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_ALNUM = r"[^\p{L}\p{N}]+"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it
    several times or inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ws_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def plain_ws(c: Column) -> Column:
    """Rare Unicode spaces become blanks, so that later patterns get by with the
    ASCII class, which the regex engine tests by table."""
    return F.regexp_replace(c, RARE_WS, " ")


def plain_text(c: Column) -> Column:
    """As plain_ws, for whole texts: most hold no rare space, which a byte search tells sooner
    than the pattern."""
    rare = [w for w in WS if ord(w) > 127]
    return let(c, lambda x: F.when(contains_any(x, rare), plain_ws(x)).otherwise(x))


def words(c: Column) -> Column:
    """White-space tokens; empty array for blank text."""
    def cut(t):
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))

    return let(ws_trim(plain_ws(c)), cut)


def squashed(c: Column) -> Column:
    """The lower-case words of a text with one blank between them; only what is no single blank is replaced."""
    return F.regexp_replace(ws_trim(plain_text(F.lower(c))), r"\s{2,}|[^\S ]", " ")


def word_count(c: Column) -> Column:
    return F.regexp_count(plain_text(c), F.lit(r"\S+"))


def contains_any(c: Column, markers) -> Column:
    """True when any marker is a substring (kept as plain byte search, no regex)."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in markers])


def starts_any(c: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(c, F.lit(m)) for m in markers])


def occurrences(c: Column, marker: str) -> Column:
    """Non-overlapping substring count."""
    gone = F.octet_length(F.replace(c, F.lit(marker), F.lit("")))
    return ((F.octet_length(c) - gone) / F.lit(len(marker.encode()))).cast("int")


def occurrences_total(c: Column, markers) -> Column:
    return reduce(lambda a, b: a + b, [occurrences(c, m) for m in markers])


def sentences_dot(c: Column, min_bytes: int) -> Column:
    """Split on '.', trim, keep pieces longer than ``min_bytes`` bytes."""
    return F.filter(F.transform(F.split(c, r"\."), ws_trim), lambda s: F.octet_length(s) > min_bytes)


def sentences_space(c: Column) -> Column:
    """Boundary = one of .?! followed by a space; the terminator stays."""
    return F.filter(F.transform(F.split(c, r"(?<=[.?!]) "), ws_trim), lambda s: s != "")


def sentences_ws(c: Column) -> Column:
    """Boundary = one of .!? followed by space, newline or end; a tail without
    terminator counts only when it is all there is."""
    def pick(raw):
        closed = F.rlike(F.element_at(raw, -1), F.lit(r"[.!?]\z"))
        ended = F.when(closed, raw).otherwise(F.slice(raw, 1, F.size(raw) - 1))
        kept = F.filter(F.transform(ended, ws_trim), lambda s: s != "")
        return let(kept, lambda k: F.when((F.size(k) > 0) | (ws_trim(c) == ""), k).otherwise(F.array(ws_trim(c))))

    return let(F.split(c, r"(?<=[.!?])(?=[ \n])"), pick)


def first_sentence_ws(c: Column) -> Column:
    first = F.regexp_extract(c, r"(?s)^.*?[.!?](?=[ \n]|\z)", 0)
    return let(first, lambda f: ws_trim(F.when(f != "", f).otherwise(c)))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n\n"), ws_trim), lambda p: p != "")


def heading_level(numbering: Column) -> Column:
    return F.size(F.split(F.rtrim(numbering, F.lit(".")), r"\.")) - 1


def keywords_set(c: Column, stop) -> Column:
    """Distinct lower-case alphanumeric tokens over 2 bytes that are no stop words."""
    tokens = F.array_except(F.split(F.lower(c), NON_ALNUM), lit_array(stop))
    return F.filter(tokens, lambda w: F.octet_length(w) > 2)


def keywords_list(c: Column, stop) -> Column:
    """As keywords_set, duplicates kept."""
    return F.filter(F.split(F.lower(c), NON_ALNUM), lambda w: (F.octet_length(w) > 2) & ~w.isin(stop))


def bare_words(c: Column) -> Column:
    """Lower-case white-space tokens without outer punctuation; one regex pass
    over the text instead of one per token, which leaves most characters after one test."""
    edge = r"(?=[^a-z0-9\s\p{L}\p{N}])(?:(?<!\S)[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]+(?!\S))"
    return words(F.regexp_replace(plain_text(F.lower(c)), edge, ""))


def content_keywords(c: Column, stop) -> Column:
    """Distinct bare words over 4 bytes that are no stop words."""
    return F.filter(F.array_except(bare_words(c), lit_array(stop)), lambda w: F.octet_length(w) > 4)


def topic_words(c: Column, min_bytes: int) -> Column:
    return F.filter(F.array_distinct(bare_words(c)), lambda w: F.octet_length(w) > min_bytes)


def trim_non_alnum(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard of two arrays, 0 when either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / union)


def word_jaccard(a: Column, b: Column, longer_than: int = 0) -> Column:
    def tokens(c):
        w = words(c)
        return F.filter(w, lambda x: F.octet_length(x) > longer_than) if longer_than else w

    return jaccard(tokens(a), tokens(b))


def overlap_list(a: Column, b: Column) -> Column:
    """Share of list ``a`` (duplicates count) found in list ``b``."""
    hit = F.size(F.filter(a, lambda w: F.array_contains(b, w)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(hit / F.size(a))


def overlap_fuzzy(a: Column, b: Column) -> Column:
    """Share of ``a`` whose members equal, contain or lie in a member of ``b``."""
    hit = F.size(F.filter(a, lambda x: F.exists(b, lambda y: F.contains(y, x) | F.contains(x, y))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(hit / F.size(a))


# Syllables over a whole text, without touching words one by one: all vowel
# groups, minus one per word of two or more groups whose last letter is a silent
# e, plus one per word without any vowel.
def _syllables(low: Column) -> Column:
    """Of a lower-case text without rare spaces."""
    groups = F.regexp_count(low, F.lit("[aeiouy](?![aeiouy])"))  # the end of each
    silent = F.regexp_count(low, F.lit(r"[aeiouy][^aeiouy\s]+[aeiouy]*e(?:[^\p{L}\s]+)?(?!\S)"))
    bare = F.regexp_count(low, F.lit(r"(?:\A|\s)[^aeiouy\s]++(?=\s|\z)"))
    return groups - silent + bare


def syllable_total(c: Column) -> Column:
    return let(F.lower(plain_text(c)), _syllables)


def readability(c: Column) -> Column:
    """struct<syllables, grade>: the syllables and the Flesch-Kincaid grade, the text read once."""
    def grade(plain):
        stops = F.greatest(F.regexp_count(plain, F.lit("[.!?]")), F.lit(1))
        counts = F.struct(F.regexp_count(plain, F.lit(r"\S+")).alias("w"), let(F.lower(plain), _syllables).alias("s"))
        return let(counts, lambda n: F.struct(n["s"].alias("syllables"), F.when(n["w"] == 0, F.lit(0.0)).otherwise(
            0.39 * (n["w"] / stops) + 11.8 * (n["s"] / n["w"]) - 15.59).alias("grade")))

    return let(plain_text(c), grade)


def flesch_kincaid(c: Column) -> Column:
    return readability(c)["grade"]


YEAR = r"(?<![0-9])(19[0-9][0-9]|20[0-2][0-9]|2030)(?![0-9])"


def first_year(c: Column) -> Column:
    return F.regexp_extract(c, YEAR, 1).try_cast("int")


def has_year(c: Column) -> Column:
    return F.rlike(c, F.lit(YEAR))


def parenthesised(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\(([^)]*)\)"), F.lit(1))


def citations(c: Column) -> Column:
    """array<struct<author, year>> of parenthesised groups holding a year; the
    author is the text before the first comma, 1 to 49 bytes."""
    found = F.transform(
        parenthesised(c),
        lambda g: F.struct(ws_trim(F.split_part(g, F.lit(","), F.lit(1))).alias("author"), first_year(g).alias("year")))
    return F.filter(
        found, lambda s: s["year"].isNotNull() & (s["author"] != "") & (F.octet_length(s["author"]) < 50))


_NUM = r"0-9.,%£$/\-–"


def significant_numbers(c: Column) -> Column:
    """array<struct<value, context>>: quantities, without bare years, digit pairs
    such as 2019/20 and bare numbers below ten; context = five words either side."""
    def keep(s):
        v = s["value"]
        digits = F.regexp_replace(v, "[^0-9.]", "")
        unit = contains_any(v, ["%", "£", "$"])
        bare_year = F.rlike(digits, F.lit("^(19|20)[0-9][0-9]$")) & ~unit
        pair = F.rlike(v, F.lit("^[0-9]*[/–-][0-9]*$"))
        tiny = F.coalesce(digits.try_cast("double") < 10.0, F.lit(False)) & ~unit
        return (F.octet_length(v) >= 2) & ~bare_year & ~pair & ~tiny

    def find(w):
        tokens = F.filter(
            F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("w"))), lambda s: F.rlike(s["w"], F.lit("[0-9]")))
        cleaned = F.transform(tokens, lambda s: F.struct(
            s["i"].alias("i"), F.regexp_replace(s["w"], f"^[^{_NUM}]+|[^{_NUM}]+$", "").alias("value")))

        def out(s):
            start = F.greatest(s["i"] - 5, F.lit(0))
            return F.struct(
                s["value"].alias("value"), F.array_join(F.slice(w, start + 1, s["i"] + 6 - start), " ").alias("context"))

        return F.transform(F.filter(cleaned, keep), out)

    return let(words(c), find)


def number_unit(v: Column) -> Column:
    low = F.lower(v)
    return (
        F.when(F.contains(v, F.lit("%")), "percent")
        .when(contains_any(v, ["£", "$", "€"]), "currency")
        .when(contains_any(low, ["billion", "million"]), "currency_large")
        .when(F.contains(v, F.lit("-")) & (F.octet_length(v) < 8), "range")
        .otherwise("plain"))


def number_value(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9.]", "").try_cast("double")


def specificity_markers(c: Column) -> Column:
    """White-space tokens that hold a % or read as a number."""
    number = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity|nan)"
    return F.regexp_count(plain_text(c), F.lit(rf"(?<!\S)(?:[^\s%]*+%\S*+|{number})(?!\S)"))


def quality_signal(wc: Column, evidence: Column, specific: Column) -> Column:
    per_100 = wc / 100.0
    density = lambda n: F.when(wc > 0, F.least(n / per_100, F.lit(1.0))).otherwise(0.0)
    return F.least(wc / 500.0, F.lit(1.0)) * 0.3 + density(evidence) * 0.4 + density(specific) * 0.3


def iri_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_")


def escape_literal(c: Column) -> Column:
    for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def truncate_words(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters at the last space, unless the text is short."""
    head = F.substring(c, 1, limit)
    cut = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.length(c) <= limit, c).when(F.contains(head, F.lit(" ")), cut).otherwise(head)


def repeated_words(c: Column) -> Column:
    """array<struct<word, n>> of words (letters only, over 4 bytes) seen at least
    three times in a text of ten words or more. Sorted words make each repetition
    one run, so a back-reference finds the runs without a shuffle."""
    letters = F.regexp_replace(plain_ws(F.lower(c)), r"[^\p{L}\s]+", "")
    clean = F.sort_array(F.filter(words(letters), lambda w: F.octet_length(w) > 4))
    runs = F.regexp_extract_all(
        F.array_join(clean, " "), F.lit(r"(?:^| )(\S+)(?: \1(?= |$)){2,}"), F.lit(0))

    def count(r):
        word = F.split_part(r, F.lit(" "), F.lit(1))
        return F.struct(word.alias("word"), ((F.length(r) + 1) / (F.length(word) + 1)).cast("bigint").alias("n"))

    out = F.transform(F.transform(runs, lambda r: F.trim(r)), count)
    return F.when(word_count(c) >= 10, out).otherwise(F.array().cast("array<struct<word:string,n:bigint>>"))


def route(c: Column, routes, default: str) -> Column:
    """First route whose keyword occurs in the lower-cased text."""
    low = F.lower(c)
    expr = None
    for target, keys in routes:
        hit = contains_any(low, keys)
        expr = F.when(hit, target) if expr is None else expr.when(hit, target)
    return expr.otherwise(default)


def route_all(c: Column, routes) -> Column:
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(contains_any(low, keys), F.lit(t)) for t, keys in routes]))


def lookup(c: Column, table, default):
    """CASE over a small [(keys, value...)] table; values may be tuples (picked by caller)."""
    expr = None
    for keys, value in table:
        cond = c.isin(keys)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(default))


def empty_like(arr: Column) -> Column:
    return F.filter(arr, lambda _: F.lit(False))


def greedy_keep(items: Column, duplicate) -> Column:
    """Order-dependent near-duplicate removal inside one array: an element stays
    unless ``duplicate(kept, element)`` holds for an element kept before it."""
    return let(items, lambda xs: F.aggregate(
        xs, F.slice(xs, 1, 0),
        lambda kept, x: F.when(F.exists(kept, lambda k: duplicate(k, x)), kept).otherwise(
            F.concat(kept, F.array(x)))))
