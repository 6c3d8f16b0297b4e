"""One consistent form for texts that look the same: look-alike classes by union-find, rewritten by an automaton."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter, and the letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ү": "Y", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԛ": "q", "ԝ": "w", "һ": "h", "ԁ": "d", "ӏ": "l", "ү": "y", "ѵ": "v", "к": "k",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "η": "n", "ω": "w", "τ": "t",
    "Տ": "S", "օ": "o", "ո": "n", "ս": "u", "ց": "g", "հ": "h", "ℓ": "l", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓢ": "S", "ꓳ": "O",
}
#: Kinds of compatibility characters that are other styles of the same text; fractions, superscripts and the like are texts of their own.
STYLES = ("<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<small>", "<isolated>", "<initial>", "<medial>", "<final>")


def _ligature(c: str) -> bool:
    return "ﬀ" <= c <= "ﭏ" or "LIGATURE" in unicodedata.name(c, "") and unicodedata.decomposition(c).startswith("<compat>")


def _invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" and not "؀" <= c <= "۝" or c in "͏ᅟᅠ឴឵᠎ㅤﾠ" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef"


def relations() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look alike, by rule over all code points of planes 0, 1 and 14 and the fixed letters above."""
    yield from LOOKALIKES.items()
    for n in (*range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0xE0000, 0xE0200)):
        c = chr(n)
        d = unicodedata.decomposition(c)
        if _invisible(c):
            yield c, ""
        elif unicodedata.category(c) == "Zs":
            yield c, " "
        elif n in (0x2028, 0x2029, 0x85):
            yield c, "\n"
        elif d and (d.split()[0] in STYLES or _ligature(c)):
            yield c, unicodedata.normalize("NFKC", c)
        elif d and d[0] != "<":
            yield c, unicodedata.normalize("NFD", c)
            # Marks may be set on a composed letter one after the other.
            two = "".join(chr(int(x, 16)) for x in d.split())
            yield c, two


class Classes:
    """Union-find over strings: classes of strings that look alike, directly or through others."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def top(self, x: str) -> str:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x

    def join(self, x: str, y: str) -> None:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.top(x), []).append(x)
        return out


def rewriting(frequency: dict[str, int]) -> dict[str, str]:
    """Every string to be rewritten and the representative of its class.

    frequency: how often single code points occur. A class is represented by
    its most frequent single code point, a class with the empty string by that;
    ties go to the smaller string.
    """
    classes = Classes()
    for x, y in relations():
        classes.join(x, y)
    # Composed letters are alike if what they are composed of is: a look-alike letter with an accent, a styled one.
    chosen: dict[str, str] = {}
    for _ in range(3):
        chosen = {}
        for group in classes.members().values():
            rep = min(group, key=lambda s: (s != "", s != " ", len(s) != 1, -frequency.get(s, 0), s))
            chosen |= {x: rep for x in group if x != rep}
        before = len({classes.top(x) for x in classes.up})
        for c in list(classes.up):
            parts = unicodedata.normalize("NFD", c)
            if len(parts) > 1:
                classes.join(c, unicodedata.normalize("NFC", "".join(chosen.get(p, p) for p in parts)))
        if len({classes.top(x) for x in classes.up}) == before:
            break
    # An ASCII string is never rewritten to another script for being rarer there: texts of ASCII are in their form as they are.
    fixed = {}
    for group in classes.members().values():
        ascii_ = [s for s in group if s.isascii()]
        rep = ascii_[0] if len(ascii_) == 1 else chosen.get(group[0], group[0])
        fixed |= {x: rep for x in group if x != rep and not x.isascii()}
    return fixed


class Rewriter:
    """Replaces the strings of a rewriting, longest first from left to right, until nothing changes."""

    def __init__(self, table: dict[str, str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for x, y in table.items():
            self.automaton.add_word(x, (len(x), y))
        self.automaton.make_automaton()

    def once(self, text: str) -> str:
        out, at = [], 0
        for end, (length, rep) in self.automaton.iter_long(text):
            out += [text[at : end - length + 1], rep]
            at = end + 1
        return "".join(out) + text[at:] if out else text

    def __call__(self, text: str) -> str:
        while not text.isascii() and (new := self.once(text)) != text:
            text = new
        return text


def frequencies(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each code point occurs over all texts: at most as many rows as there are code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for b in batches:
            for t in b["text"]:
                n.update(t)
        yield pd.DataFrame({"c": [ord(c) for c in n], "n": list(n.values())})

    # Unpaired surrogates can't be in a column of strings; NUL can.
    counts = docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).mapInPandas(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return {chr(r["c"]): r["n"] for r in counts.collect()}


def consistent_form(docs: DataFrame, text: str = "text", to: str = "form", table: dict[str, str] | None = None) -> DataFrame:
    """docs with column to: the text in one consistent form.

    Texts of ASCII only are their own form and stay in the JVM; the others are
    rewritten whole. Null stays null, an empty text empty. A column named like
    to is replaced, all others stay as they are.
    """
    table = rewriting(frequencies(docs, text)) if table is None else table

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        global _REWRITER
        if globals().get("_REWRITER", (None, None))[0] != len(table):
            _REWRITER = (len(table), Rewriter(table))
        one = _REWRITER[1]
        return texts.map(one, na_action="ignore")

    # The Python column is fed null for ASCII texts: they don't cross over.
    odd = F.when(F.col(text).rlike(r"[^\x00-\x7F]"), F.col(text))
    return docs.withColumn("_odd", odd).withColumn(to, rewrite("_odd")).withColumn(to, F.coalesce(to, text)).drop("_odd")


def equal_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_1, doc_id_2), the smaller first: documents stored differently that have one form.

    Documents with null text or id are left out. Only forms that are stored in
    two or more ways are joined; copies of one stored text are no pairs. Texts
    are compared by 256-bit hashes.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    formed = consistent_form(docs).select("doc_id", F.unhex(F.sha2("form", 256)).alias("form"), F.xxhash64("text", F.reverse("text")).alias("stored"))
    w = Window.partitionBy("form")
    several = formed.withColumn("several", F.min("stored").over(w) != F.max("stored").over(w)).filter("several").select("doc_id", "form", "stored")
    a, b = several.alias("a"), several.alias("b")
    on = (F.col("a.form") == F.col("b.form")) & (F.col("a.stored") != F.col("b.stored")) & (F.col("a.doc_id") < F.col("b.doc_id"))
    return a.join(b, on).select(F.col("a.doc_id").alias("doc_id_1"), F.col("b.doc_id").alias("doc_id_2"))
