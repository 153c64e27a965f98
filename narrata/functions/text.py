"""Text functions as Column expressions: names, tokens, overlaps, clauses and the finding template.

All are built from SQL functions, so they stay inside generated code.
"""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that results depend on.
TITLES = ("dr", "doctor", "mr", "mister", "mrs", "ms", "miss", "lt", "lieutenant", "capt", "captain", "cmdr", "commander", "adm", "admiral", "ens", "ensign")
SCORE_STOPWORDS = (
    "a an and are as at be been being but by for from had has have in into is it its of on or that the this to was were will with "
    "happen happens establish established scene says say said claim claims claimed claiming state states stated stating describes described describing"
).split()
NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "hundred": "100"}
DEDUPE_STOPWORDS = "the a an is was of to in and with on at by for yet scene established happens happen as from his her their its be are were has have had".split()
DURABLE_TERMS = (
    "black blue brown gold green grey gray orange pink purple red silver white yellow left right "
    "one two three four five six seven eight nine ten hundred thousand million "
    "first second third fourth fifth sixth seventh eighth ninth tenth "
    "monday tuesday wednesday thursday friday saturday sunday "
    "year years month months week weeks day days hour hours minute minutes "
    "alive dead born married single widow widower divorced spouse husband wife father mother "
    "parent parents son daughter child children brother sister sibling"
).split()
GENERIC_ALIASES = ("voice", "captain", "mister", "sir", "crew", "guy", "he", "she", "they", "person")
GENERIC_TOKENS = ("the", "your", "voice", "captain", "mister", "sir", "crew", "subject", "vessel", "protege")
# The finding's sentence, wrongly decoded marks, and headings.
STRICT = r"(?is)^\s*In\s+scene\s+(\d+)\s*,\s*(.+?)\s+was\s+established\s*,\s*yet\s+in\s+scene\s+(\d+)\s*,\s*(.+?)\s+happens\.?\s*$"
LENIENT = r"(?is)^\s*In\s+scene\s+(\d+)\s*,\s*(.+?)\s*,\s*yet\s+in\s+scene\s+(\d+)\s*,\s*(.+?)\.?\s*$"
MOJIBAKE = (("â\u0080\u0099", "'"), ("â\u0080\u0098", "'"), ("â\u0080\u009c", '"'), ("â\u0080\u009d", '"'), ("â\u0080\u0094", "--"), ("â\u0080\u0093", "-"), ("Â ", " "), ("Â", ""))
ROMAN = r"(?:m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
CARDINALS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty",
)
DIVISIONS = ("chapter", "book", "part", "act", "scene", "canto")
SECTION_BREAK = r"^\s*(?:\*{3,}|\*(?:\s+\*){2,}|[-=]{3,})\s*$"

#: Built from these: a division's number, and a heading line.
ORDINAL = "|".join(ORDINALS)
CARDINAL = "|".join((*CARDINALS, *ORDINALS))
DIVISION = "|".join(DIVISIONS)
HEADING = rf"(?i)^\s*(?:(?:{DIVISION})\s+(?:{ROMAN}|\d+|{CARDINAL})(?:[\s.:-]+.+)?|fit\s+the\s+(?:{ORDINAL})(?:\s+.+)?|\d+\s+[A-Z][A-Za-z0-9' -]{{2,80}}|{ROMAN})\.?\s*$"

@functools.cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition holds one ASCII character, and those with several; all that have one lie below U+20000."""
    one, several = {}, {}
    for c in range(0x80, 0x20000):
        plain = unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() if not 0xD800 <= c <= 0xDFFF else ""
        if plain:
            (one if len(plain) == 1 else several)[chr(c)] = plain
    return one, several


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fold(col: Column) -> Column:
    """ASCII fold: characters are decomposed (compatibility forms too), then marks and all else that is not ASCII are dropped."""
    one, several = _folds()
    text = F.coalesce(col, F.lit(""))
    spelled = F.from_json(F.lit(json.dumps(several)), "map<string, string>")
    apart = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(spelled, c), c)), "")
    wide = F.when(F.translate(text, "".join(several), "") != text, apart).otherwise(text)
    folded = F.regexp_replace(F.translate(wide, "".join(one), "".join(one.values())), r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def ascii_tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0))


def norm_graph(col: Column, node_type: Column) -> Column:
    """Graph name key: folded, possessives and apostrophes dropped, titles dropped for characters unless nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(fold(col))), r"'s\b", ""), "'", "")
    return _untitled(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)), node_type)


def norm_resolution(col: Column, node_type: Column) -> Column:
    """Resolution name key: as ``norm_graph`` but an apostrophe only separates."""
    return _untitled(ascii_tokens(fold(col)), node_type)


def _untitled(tokens: Column, node_type: Column) -> Column:
    bare = F.filter(tokens, lambda t: ~t.isin(*TITLES))
    return F.array_join(F.when((node_type == "Character") & (F.size(bare) > 0), bare).otherwise(tokens), " ")


def norm_relation(col: Column) -> Column:
    """Relation name key: lower case, runs of anything but a-z and 0-9 become one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", " "))


def norm_text(col: Column) -> Column:
    return F.array_join(ascii_tokens(fold(col)), " ")


def norm_entity(col: Column) -> Column:
    """Lower-case tokens without articles."""
    return F.array_join(F.filter(ascii_tokens(F.coalesce(col, F.lit(""))), lambda t: ~t.isin("a", "an", "the")), " ")


def slug(col: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "chunk").otherwise(out)


def compose_id(kind: str, movie: Column, scene: Column, chunk: Column, temp: Column) -> Column:
    """Ids such as ev_{movie}_{scene}_{slug}_{temp}."""
    return F.concat_ws("_", F.lit(kind), F.substring(movie, 1, 8), scene, slug(chunk), temp)


def score_tokens(col: Column) -> Column:
    """Tokens of the scorer: stop words dropped, number words to digits, -ing, -ed and -s stripped; distinct."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: (t != "") & ~t.isin(*SCORE_STOPWORDS))
    numbers = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    digits = F.transform(words, lambda t: F.coalesce(numbers[t], t))
    return F.array_distinct(F.transform(digits, lambda t: (
        F.when((F.length(t) > 4) & t.endswith("ing"), t.substr(F.lit(1), F.length(t) - 3))
        .when((F.length(t) > 3) & t.endswith("ed"), t.substr(F.lit(1), F.length(t) - 2))
        .when((F.length(t) > 3) & t.endswith("s"), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t))))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets given as distinct arrays; two empty sets are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def soft_overlap(a: Column, b: Column) -> Column:
    """The greater of Jaccard and containment in the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(F.size(F.array_union(a, b)) == 0, 1.0).when(least == 0, 0.0).otherwise(F.greatest(jaccard(a, b), F.size(F.array_intersect(a, b)) / least))


def dedupe_tokens(col: Column) -> Column:
    return F.array_distinct(F.filter(ascii_tokens(F.coalesce(col, F.lit(""))), lambda t: ~t.isin(*DEDUPE_STOPWORDS)))


def entity_keys(col: Column) -> Column:
    """Capitalised words of three letters or more, lower-cased, without stop words."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-zA-Z][a-zA-Z]+(?![\p{L}\p{N}_])"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda t: ~t.isin(*DEDUPE_STOPWORDS)))


def word_count(col: Column) -> Column:
    """Words of letters, digits and underscores of any script."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"))


def is_durable(col: Column) -> Column:
    """A lasting fact: it has a number or a durable term."""
    low = F.lower(F.coalesce(col, F.lit("")))
    return low.rlike(r"(^|[^\p{L}\p{N}_])[0-9]+($|[^\p{L}\p{N}_])") | F.arrays_overlap(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), strings(DURABLE_TERMS))


def generic_alias(col: Column) -> Column:
    """No tokens, a generic alias, or titles and generic tokens only."""
    tokens = ascii_tokens(fold(col))
    return (F.size(tokens) == 0) | F.array_join(tokens, " ").isin(*GENERIC_ALIASES) | F.forall(tokens, lambda t: t.isin(*TITLES) | t.isin(*GENERIC_TOKENS))


def _clause(col: Column, cut: str, ends: str) -> Column:
    out = F.regexp_replace(F.trim(F.coalesce(col, F.lit(""))), cut, "")
    out = F.element_at(F.split(out, r"\s+[—–]\s+|\s+--?\s+", 2), 1)
    return F.trim(F.regexp_replace(F.trim(out), ends, ""))


def score_fact(col: Column) -> Column:
    """A fact clause without what follows 'was established', or a spaced dash."""
    return _clause(col, r"(?i)\s+was\s+established\b.*$", "^[ ,.]+|[ ,.]+$")


def score_event(col: Column) -> Column:
    return _clause(col, r"(?i)\s+happens\.?\s*$", "^[ ,.]+|[ ,.]+$")


def proposal_fact(col: Column) -> Column:
    """As ``score_fact``, and what follows 'is established'."""
    return _clause(F.regexp_replace(F.trim(F.coalesce(col, F.lit(""))), r"^\.+|\.+$", ""), r"(?i)\s+(was|is)\s+established\b.*$", "^,+|,+$")


def proposal_event(col: Column) -> Column:
    return _clause(F.regexp_replace(F.trim(F.coalesce(col, F.lit(""))), r"^\.+|\.+$", ""), r"(?i)\s+happens\.?\s*$", "^,+|,+$")


def render_finding(x: Column, fact: Column, y: Column, event: Column) -> Column:
    """The finding's sentence; empty without clauses or where x is not strictly before y."""
    ok = (fact != "") & (event != "") & (x > 0) & (y > 0) & (x < y)
    return F.when(ok, F.concat(F.lit("In scene "), x, F.lit(", "), fact, F.lit(" was established, yet in scene "), y, F.lit(", "), event, F.lit(" happens"))).otherwise("")


def parse_finding(col: Column) -> Column:
    """struct(x, fact, y, event), by the strict template, else the lenient one; null where neither fits."""
    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(col, pattern, i)

    fact = F.trim(F.regexp_replace(F.trim(F.regexp_replace(part(LENIENT, 2), r"(?i)\s+(?:was|is|were|are)\s+(?:established|set\s+up|introduced|shown|stated)\b.*$", "")), "^,+|,+$", ""))
    event = F.trim(F.regexp_replace(F.trim(F.regexp_replace(part(LENIENT, 4), r"(?i)\s+happens\.?\s*$", "")), r"^\.+|\.+$", ""))

    def found(pattern: str, f: Column, e: Column) -> Column:
        return F.struct(part(pattern, 1).cast("int").alias("x"), f.alias("fact"), part(pattern, 3).cast("int").alias("y"), e.alias("event"))

    return F.when(col.rlike(STRICT), found(STRICT, F.trim(part(STRICT, 2)), F.trim(part(STRICT, 4)))).when(
        col.rlike(LENIENT) & (fact != "") & (event != ""), found(LENIENT, fact, event))


def fix_encoding(col: Column) -> Column:
    """Line ends to line feeds, byte-order marks dropped, common wrongly decoded marks repaired."""
    out = F.replace(F.replace(F.replace(col, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("﻿"), F.lit(""))
    for bad, good in MOJIBAKE:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def squeeze(col: Column) -> Column:
    """White space trimmed and each run replaced by one space."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))


def cache_key(*parts: Column) -> Column:
    """The key of a cached provider response."""
    return F.md5(F.concat_ws(":", F.lit("v4"), *[p.cast("string") for p in parts]))


def pct_removed(cleaned: Column, raw: Column) -> Column:
    return F.when(raw > 0, F.round((1 - cleaned / raw) * 100, 2)).otherwise(F.lit(0.0))
