"""Text, date, money and hash expressions. All of them stay in the JVM.

Regular expressions carry the flags ``U`` (word, digit and space classes cover
all of Unicode) and ``d`` (only a line feed ends a line).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: The characters that ``(?U)\s`` stands for.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def flagged(pattern: str, flags: str = "i") -> str:
    return f"(?{flags}Ud){pattern}"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def collapse(value: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.regexp_replace(strip(value), SPACE, " ")


def folded(value: Column) -> Column:
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def normalize_name(value: Column) -> Column:
    return collapse(folded(value))


def word_count(value: Column) -> Column:
    text = strip(value)
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, SPACE)))


def compact(value: Column, limit: int = 380) -> Column:
    """At most `limit` characters; a cut text ends in an ellipsis."""
    text = collapse(F.coalesce(value, F.lit("")))
    cut = F.regexp_replace(F.substring(text, 1, limit - 1), r"(?U)\s+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def lines(value: Column) -> Column:
    """Stripped, non-empty lines."""
    parts = F.split(value, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.filter(F.transform(parts, strip), lambda line: line != "")


def sha256(*parts: Column) -> Column:
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return F.sha2(F.concat_ws("\n", *texts), 256)


def excerpt(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """Characters `start - before` to `end + after`, both clipped to the text."""
    begin = F.greatest(start - before, F.lit(0))
    return F.substring(text, begin + 1, end + after - begin)


MATCH = "array<struct<start:int,end:int,text:string>>"
MARK = "\u0001"


def searchable(text: Column) -> Column:
    """Text in which a search for lower-case words finds what patterns find in any case.

    Patterns take four letters outside ASCII for Latin ones; they are replaced
    first, because lower case would turn one of them into two characters.
    """
    return F.when(_is_ascii(text), F.lower(text)).otherwise(F.lower(F.translate(text, "İıſ\u212a", "iisk")))


def holds(low: Column, words) -> Column:
    """True if a searchable text holds one of the words; far cheaper than a pattern."""
    hit = F.lit(not words)
    for word in words:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def needed(pattern: str) -> str | None:
    """The words a pattern such as ``\\bland use\\b`` starts with."""
    start = re.match(r"\\b([a-z ]+)(.?)", pattern)
    if not start:
        return None
    word = start.group(1)
    return word[:-1] if start.group(2) in ("?", "*", "{") else word


def all_matches(text: Column, pattern: str | Column, limit: int | None = None) -> Column:
    """Every match with its offsets, counted in characters from zero.

    The text between matches and the matches themselves alternate, so running
    sums of their lengths are the offsets. `pattern` must not match the empty
    string. One replacement marks the matches, and a split at the mark, which is
    no pattern, takes them apart; only texts that hold the mark are split by the
    pattern.
    """
    first = lambda values: F.slice(values, 1, limit) if limit else values
    none = F.array().cast(MATCH)
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(seen: Column, pair: Column) -> Column:
        start = seen["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("text"))
        return F.struct(end.alias("at"), F.concat(seen["out"], F.array(found)).alias("out"))

    def placed(cut: Column) -> Column:
        before = F.slice(cut["gaps"], F.lit(1), F.size(cut["hits"]))
        pairs = F.arrays_zip(before.alias("gap"), cut["hits"].alias("hit"))
        return F.aggregate(pairs, zero, step, lambda seen: seen["out"])

    def cut(hits: Column, gaps: Column) -> Column:
        return let(F.struct(first(hits).alias("hits"), gaps.alias("gaps")), placed)

    def apart(parts: Column) -> Column:
        hits = F.filter(parts, lambda part, i: i % 2 == 1)
        gaps = F.filter(parts, lambda part, i: i % 2 == 0)
        return F.when(F.size(parts) > 1, cut(hits, gaps)).otherwise(none)

    sought = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.regexp_replace(text, sought, F.lit(f"{MARK}$0{MARK}"))
    by_pattern = cut(F.regexp_extract_all(text, sought, F.lit(0)), F.split(text, sought, -1))
    return F.when(F.contains(text, F.lit(MARK)), F.when(F.rlike(text, sought), by_pattern).otherwise(none)).otherwise(
        let(F.split(marked, MARK, -1), apart)
    )


def opening(pattern: str, words) -> str:
    """The pattern, tried only at the first letters of the words; they are cheaper to see than a word bound."""
    letters = "".join(sorted({word[0] + word[0].upper() for word in words}))
    return f"(?=[{letters}İıſ\u212a])(?:{pattern})"


def _is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def _plain(pattern: str) -> str:
    """A `flagged` pattern for texts of ASCII characters, where ``U`` changes no match and costs most of the search."""
    return re.sub(r"^\(\?(\w*)U(\w*)\)", r"(?\1\2)", pattern)


def _opening_for(text: Column, pattern: str, words) -> Column:
    """The opening that suits this text; it is compiled again only where the two kinds of texts alternate."""
    return F.when(_is_ascii(text), F.lit(opening(_plain(pattern), words))).otherwise(F.lit(opening(pattern, words)))


def _first_word(low: Column, words) -> Column:
    """Characters before the first of the words, NULL without one."""
    spots = [F.when(F.contains(low, F.lit(word)), F.instr(low, word) - 1) for word in words]
    return F.least(*spots) if len(spots) > 1 else spots[0]


def holds_two(low: Column, words) -> Column:
    """True if a searchable text holds two of the words, or one of them twice."""
    held = [F.contains(low, F.lit(word)).cast("int") for word in words]
    again = lambda word: F.locate(word, F.substring(low, F.instr(low, word) + 1, F.length(low))) > 0
    twice = F.lit(False)
    for word in words:
        twice = twice | (F.contains(low, F.lit(word)) & again(word))
    return (sum(held[1:], held[0]) > 1) | twice


def all_opened(text: Column, low: Column, pattern: str, words, limit: int | None = None) -> Column:
    """`all_matches` of a pattern whose every match starts with one of the words, see `first_opened`."""
    def tried(first: Column) -> Column:
        before = F.greatest(first - 1, F.lit(0))
        moved = lambda m: F.struct(
            (m["start"] + before).alias("start"), (m["end"] + before).alias("end"), m["text"].alias("text")
        )
        found = let(F.substring(text, before + 1, F.length(text)), lambda rest: all_matches(rest, _opening_for(rest, pattern, words), limit))
        return F.when(first.isNotNull(), F.transform(found, moved)).otherwise(F.array().cast(MATCH))

    return let(_first_word(low, words), tried)


def let(value: Column, use) -> Column:
    """`use` of `value`, which is worked out once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rows(df: DataFrame, keep: list, array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per element of `array` beside the kept columns; elements are never NULL.

    The plain generators make the optimizer add a filter on the size of the array,
    which works out the whole array expression a second time per row. The outer
    ones do not; their NULL rows are dropped again.
    """
    if position:
        out = df.select(*keep, F.posexplode_outer(array).alias(position, name))
        return out.filter(F.col(position).isNotNull())
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def kept(df: DataFrame, keep: list, value: Column, name: str, condition) -> DataFrame:
    """Rows whose `value` meets the condition, with the value as a column.

    A filter after a projection would be pushed below it and repeat every
    expression the condition names; a generator works each out once.
    """
    return rows(df, keep, F.filter(F.array(value), condition), name)


def first_match(text: Column, pattern: str) -> Column:
    """The first match as ``struct(start, end)``; NULL when there is none.

    A search ends at the match, and its pattern is compiled once; a split would
    compile it for every text and go on to the text's end. `pattern` must not
    match the empty string.
    """
    upto = rf"\A((?s:.*?))(?:{pattern})"
    start = F.length(F.regexp_extract(text, upto, 1))
    return let(
        F.length(F.regexp_extract(text, upto, 0)),
        lambda end: F.when(end > 0, F.struct(start.alias("start"), end.alias("end"))),
    )


def first_opened(text: Column, low: Column, pattern: str, words) -> Column:
    """`first_match` of a pattern whose every match starts with one of the words.

    `low` is the searchable text; the pattern is tried from the first of the words
    on, with the character before it for word bounds.
    """
    def tried(first: Column) -> Column:
        before = F.greatest(first - 1, F.lit(0))
        moved = lambda match: F.when(
            match.isNotNull(),
            F.struct((match["start"] + before).alias("start"), (match["end"] + before).alias("end")),
        )
        found = let(F.substring(text, before + 1, F.length(text)), lambda rest: first_match(rest, opening(pattern, words)))
        return F.when(first.isNotNull(), let(found, moved))

    return let(_first_word(low, words), tried)


def matched_text(text: Column, match: Column) -> Column:
    return F.substring(text, match["start"] + 1, match["end"] - match["start"])


# Words left out of token sets.
LINEAGE_STOPWORDS = [
    "the", "and", "for", "that", "with", "from", "this", "shall", "may", "must", "are", "was", "were", "into",
    "under", "section", "subsection", "paragraph", "bill", "act", "amendment", "amended", "relating",
    "provide", "providing", "other", "such", "each", "any", "all", "not",
]
SCOPE_STOPWORDS = [
    "the", "and", "for", "that", "with", "from", "this", "shall", "may", "must", "are", "was", "were", "into",
    "under", "section", "subsection", "paragraph", "bill", "act", "amendment", "amended", "relating",
    "provide", "provides", "providing", "other", "such", "each", "any", "all", "not", "thereof", "therein",
    "thereunder", "including", "means", "term", "state", "federal", "law", "chapter", "code", "article",
    "title", "part", "division", "applicable", "effective", "date",
]
# Fixed value: a word of three characters or more that starts with a Latin letter.
TOKEN = r"(?U)\b[A-Za-z][A-Za-z0-9'-]{2,}\b"


def tokens(text: Column, stopwords: list[str]) -> Column:
    found = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower
    )
    return F.filter(found, lambda word: ~word.isin(stopwords))


def token_set(text: Column, stopwords: list[str] = LINEAGE_STOPWORDS) -> Column:
    return F.array_distinct(tokens(text, stopwords))


# The leading item number of a heading, and the verbs dropped from an issue key.
ITEM_PREFIX = r"(?iUd)^\s*(?:item\s+)?(?:\d+(?:\.\d+)*[a-z]?|[a-z])\s*[.): -]+"
LEAD_VERB = (
    r"(?iUd)^(?:(?:consider|discuss)(?: and (?:take )?action on)?|"
    r"approval of|approve|adoption of|adopt|authorization of|authorize)\s+(?:the\s+)?"
)


def heading_words(value: Column) -> Column:
    """Lower-case words of a heading without its item number."""
    text = folded(F.regexp_replace(F.coalesce(value, F.lit("")), ITEM_PREFIX, ""))
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)), " ")


GENERIC_SUBJECTS = ["agenda", "minutes", "meeting packet", "discussion and possible action"]


def issue_key(title: Column, synopsis: Column) -> Column:
    """Words that identify an issue: the title's, or the synopsis' if the title is vague."""

    def chosen(words: Column) -> Column:
        vague = (F.length(words["title"]) < 25) | words["title"].isin(GENERIC_SUBJECTS)
        subject = F.when(vague, words["synopsis"]).otherwise(words["title"])
        return F.regexp_replace(F.regexp_replace(subject, LEAD_VERB, ""), LEAD_VERB, "")

    words = F.struct(heading_words(title).alias("title"), heading_words(synopsis).alias("synopsis"))
    return let(words, chosen)


# Money in bill text and in local records.
BILL_MONEY = r"(?iUd)\$\s?([0-9][0-9,]*(?:\.\d+)?)\s*(million|billion|thousand)?"
CIVIC_MONEY = (
    r"(?iUd)(?<!\w)\$\s?\d[\d,]*(?:\.\d{1,2})?(?:\s?(?:million|billion|thousand|M|B|K))?"
)
LOOSE_MONEY = r"(?iUd)\$\s*([0-9][0-9,]*(?:\.\d+)?)\s*(thousand|million|billion)?"


def money_value(text: Column, pattern: str = LOOSE_MONEY) -> Column:
    """Amount named first in `text`, NULL without one."""
    digits = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    scale = (
        F.when(unit == "thousand", 1e3).when(unit == "million", 1e6).when(unit == "billion", 1e9)
    )
    return F.when(digits != "", digits.try_cast("double") * F.coalesce(scale, F.lit(1.0)))


def money_matches(text: Column, pattern: str = BILL_MONEY) -> Column:
    """Trimmed money mentions in text order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda hit: F.regexp_replace(hit, r"[,\s]+$", ""))


def iso_date(value: Column) -> Column:
    """Date from the first ten characters, NULL when they are no date."""
    text = F.substring(strip(value.cast("string")), 1, 10)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def date_in_text(text: Column) -> Column:
    """First date of this century written Y-m-d, m/d/Y or "Month d, YYYY"."""
    ymd = r"(?U)\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b"
    mdy = r"(?U)\b(\d{1,2})[-/](\d{1,2})[-/](20\d{2})\b"
    months = (
        "January|February|March|April|May|June|July|August|September|October|November|December"
    )
    named = rf"(?iU)\b({months})\s+(\d{{1,2}}),\s+(20\d{{2}})\b"

    def built(pattern: str, year: int, month: int, day: int) -> Column:
        part = lambda n: F.regexp_extract(text, pattern, n)
        joined = F.concat_ws("-", part(year), part(month), part(day))
        return F.try_to_date(joined, "y-M-d")

    spelled = F.concat_ws(
        " ",
        F.initcap(F.regexp_extract(text, named, 1)),
        F.regexp_extract(text, named, 2),
        F.regexp_extract(text, named, 3),
    )
    return F.coalesce(
        built(ymd, 1, 2, 3), built(mdy, 3, 1, 2), F.try_to_date(spelled, "MMMM d y")
    )


def iso_or_same(value: Column) -> Column:
    """m/d/Y and Y-m-d become ISO text, anything else stays."""
    text = strip(value)
    day = F.coalesce(
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy")),
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d")),
    )
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.when(text != "", text))


def week_start(day: Column) -> Column:
    """The Monday of the week."""
    return F.date_trunc("week", day).cast("date")


def within(day: Column, as_of: Column, back: int, ahead: int) -> Column:
    """True for days from `back` before to `ahead` after `as_of`."""
    return day.between(F.date_sub(as_of, back), F.date_add(as_of, ahead))


def clamped(value: int | None, low: int, high: int) -> int:
    return max(low, min(int(value if value is not None else high), high))


def spaced_label(field: Column) -> Column:
    """"CouncilDate" and "council_date" become words."""
    words = F.regexp_replace(field, r"(?<!^)(?=[A-Z])", " ")
    return strip(F.replace(words, F.lit("_"), F.lit(" ")))


def present(value: Column) -> Column:
    return value.isNotNull() & ~value.isin("", "Null", "null")
