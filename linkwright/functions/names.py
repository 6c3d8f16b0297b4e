"""Parsing and comparing person names with native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and titles that are taken off a name.
SUFFIXES = ("MD", "M.D.", "M.D", "DO", "D.O.", "D.O", "PHD", "PH.D.", "PH.D", "FACS", "F.A.C.S.", "FACC", "F.A.C.C.", "FACP", "F.A.C.P.", "JR", "JR.", "SR", "SR.", "II", "III", "IV")
TITLES = ("DR", "DR.", "PROF", "PROF.", "PROFESSOR")
# The form of a suffix at the end of a name, and of a title at its front.
_SUFFIX = r"(?i),?\s*(" + "|".join(s.replace(".", r"\.") for s in sorted(SUFFIXES, key=lambda s: (-len(s), s))) + r")\.?\s*$"
_TITLE = r"(?i)^(" + "|".join(t.replace(".", r"\.") for t in sorted(TITLES, key=lambda s: (-len(s), s))) + r")\s+"
#: All suffixes at the end of a name, one after the other.
_TAIL = _SUFFIX.replace("(?i)", "(?i)(?:").replace(r"\s*$", r"\s*)+$").replace(",?\\s*(", ",?\\s*(?:")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def given(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def parse_name(raw: Column, split_initials: bool = True) -> Column:
    """struct(first, last, middle, suffix, title) of a raw name; all null for null, blank and names that are suffixes only.

    Suffixes are cut from the end one by one, however many, and listed in the
    order of the name; one title is cut from the front and comes out in upper
    case without dots. "Last, First Middle" is split at the first comma, else one word is a last name, two are first and last, more are
    first, middle words and last. split_initials: "J.A." stands for J and A.
    """

    def as_initial(c: Column) -> Column:
        letters = F.regexp_replace(c, r"\.", "")
        return F.when((F.length(c) <= 2) & (F.length(letters) == 1), F.upper(letters)).otherwise(c)

    def cut(state: Column) -> Column:
        found = F.regexp_extract(state["rest"], _SUFFIX, 1)
        more = found != ""
        return F.struct(
            F.when(more, strip(F.regexp_replace(state["rest"], _SUFFIX, ""))).otherwise(state["rest"]).alias("rest"),
            F.when(more, F.concat(F.array(F.regexp_replace(F.upper(found), r"\.", "")), state["found"])).otherwise(state["found"]).alias("found"),
        )

    def finish(state: Column) -> Column:
        title = F.regexp_extract(state["rest"], _TITLE, 1)
        name = F.regexp_replace(strip(F.regexp_replace(state["rest"], _TITLE, "")), r"\s+", " ")
        last_first = F.substring_index(name, ",", 1)
        behind = strip(F.substr(name, F.length(last_first) + 2))
        tail = F.split(behind, " ")
        words = F.split(name, " ")
        n = F.size(words)
        fused = F.regexp_extract(words[0], r"^(\p{L})\.(\p{L})\.$", 1)
        fused_second = F.regexp_extract(words[0], r"^(\p{L})\.(\p{L})\.$", 2)
        split = (fused != "") & (n == 2) & F.lit(split_initials)
        rest = lambda ws, frm, count: F.when(count > 0, F.array_join(F.slice(ws, frm, F.greatest(count, F.lit(1))), " "))
        comma = (last_first != "") & (behind != "")
        single = lambda c: F.when(~c.contains(" "), as_initial(c)).otherwise(c)
        first = F.when(comma, tail[0]).when(name == "", None).when(split, fused).when(n == 2, words[0]).when(n > 2, F.when((F.length(words[0]) <= 2) & words[0].endswith("."), F.substring(words[0], 1, 1)).otherwise(words[0]))
        last = F.when(comma, strip(last_first)).when(name == "", None).otherwise(F.element_at(words, -1))
        middle = F.when(comma, single(rest(tail, 2, F.size(tail) - 1))).when(split, fused_second).when(n > 2, single(rest(words, 2, n - 2)))
        return F.struct(first.alias("first"), last.alias("last"), middle.alias("middle"), given(F.array_join(state["found"], ", ")).alias("suffix"), given(F.replace(F.upper(title), F.lit("."), F.lit(""))).alias("title"))

    # transform over an array of one names the intermediate results, so each is computed once.
    # A suffix has two letters or more, so the suffixes at the end are at most half as many as its signs.
    most = F.ceil(F.length(F.regexp_extract(raw, _TAIL, 0)) / 2).cast("int")
    steps = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    state = F.array(F.aggregate(steps, F.struct(strip(raw).alias("rest"), F.array().cast("array<string>").alias("found")), lambda at, _: cut(at)))
    blank = F.struct(*(F.lit(None).cast("string").alias(k) for k in ("first", "last", "middle", "suffix", "title")))
    return F.when(strip(F.coalesce(raw, F.lit(""))) == "", blank).otherwise(F.element_at(F.transform(state, finish), 1))


def standardize_name(first: Column, last: Column, middle: Column) -> Column:
    """LAST, FIRST M; the comma stays without a first name; empty without a last name."""
    full = F.concat_ws(" ", given(F.upper(first)), F.upper(F.substring(given(middle), 1, 1)))
    return F.when(F.coalesce(last, F.lit("")) == "", "").when(F.coalesce(first, F.lit("")) == "", F.concat(F.upper(last), F.lit(","))).otherwise(F.concat(F.upper(last), F.lit(", "), full))


def display_name(first: Column, last: Column, middle: Column) -> Column:
    """LAST, FIRST M without a stray comma; the first name alone where the last is missing."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(~has(last), F.coalesce(F.upper(first), F.lit(""))).when(~has(first), F.upper(last)).otherwise(standardize_name(first, last, middle))


def names_match(first_1: Column, last_1: Column, first_2: Column, last_2: Column) -> Column:
    """Last names equal but for hyphens, apostrophes and spaces; first names equal, one an initial of the other, or one missing."""
    key = lambda c: F.translate(F.upper(strip(F.coalesce(c, F.lit("")))), "-' ", "")
    a, b = F.upper(strip(F.coalesce(first_1, F.lit("")))), F.upper(strip(F.coalesce(first_2, F.lit(""))))
    a, b = F.regexp_replace(a, r"\.$", ""), F.regexp_replace(b, r"\.$", "")
    start = ((F.length(a) == 1) | (F.length(b) == 1)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    return (key(last_1) != "") & (key(last_1) == key(last_2)) & ((a == "") | (b == "") | (a == b) | start)
