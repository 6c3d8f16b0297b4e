"""Typed values to the entries of a reference list, by a prefix-filter set-similarity join.

Every distinct value and every reference entry becomes a set of word ids. Words
of the values are first tied to the words of the reference list (spelling slips,
abbreviations, codes), then the sets are joined: tokens ordered by global
rarity, only the rare prefixes joined, length and positional filters applied,
Jaccard verified exactly, the entry of the highest Jaccard (then of the fewest
slips) kept. An exact check follows: every word of the entry must be covered by
another word of the value.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.llm.text import blank, squeezed, words_of
from linkwright.storage import join_checked, stored

UNMATCHED = "UNMATCHED"
MOST_ENTRIES = 100_000

# Short forms that are neither a beginning nor a thinning of the word they stand for.
SHORT_FORMS = {
    "dx": "diagnostic", "sx": "surgery", "tx": "transplant", "rx": "therapy", "hx": "history", "gyn": "gynecologic", "gynae": "gynecologic",
    "mt": "mount", "st": "saint", "ste": "saint", "sankt": "saint", "san": "saint", "ft": "fort", "psych": "psychiatry", "wmns": "womens",
    "ctr": "center", "hosp": "hospital", "ent": "otolaryngology", "peds": "pediatric", "paeds": "pediatric",
}
# Words that say nothing about which entry is meant.
NOISE = ("the", "of", "at", "and", "in", "for", "a", "c", "o", "co", "dept", "department", "division", "div", "service", "svc", "section", "attending", "staff", "md", "inc", "llc", "unit")


def edit_distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, most + 1 if above most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # Ends that agree cost nothing.
    end = 0
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and i > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def deletions(w: str, most: int) -> set[str]:
    """w and everything left of it after taking out up to most letters."""
    every, last = {w}, {w}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        every |= last
    return every


class WordIndex:
    """Ties a typed word to words of a bounded vocabulary (word to frequency), each with a cost of 0 (same) to 3."""

    def __init__(self, words: Mapping[str, int], short_forms: Mapping[str, str]):
        self.words, self.short_forms = words, short_forms
        self.near: dict[str, list[str]] = {}
        self.begun: dict[str, set[str]] = {}
        #: Words by their first letter and one that comes later: whatever a word is the beginning or a thinning of is among those of its first two.
        self.by_letters: dict[str, list[str]] = {}
        for w in words:
            for x in dict.fromkeys(w[1:]):
                self.by_letters.setdefault(w[0] + x, []).append(w)
            for d in deletions(w, self.slips_in(w)):
                self.near.setdefault(d, []).append(w)
            for k in range(5, min(9, len(w) - 1)) if len(w) <= 20 else ():
                for d in deletions(w[:k], 1):
                    self.begun.setdefault(d, set()).add(w)

    @staticmethod
    def slips_in(w: str) -> int:
        """One slip from three letters on, two from five to 18; longer ones are names run together."""
        return 0 if len(w) < 3 else 2 if 5 <= len(w) <= 18 else 1

    def slips(self, w: str, n: int, ratio: float) -> Iterator[tuple[str, int]]:
        """Words that w is a slip of; none whose frequency is so low that w must be a word of its own."""
        for v in {v for d in deletions(w, self.slips_in(w)) for v in self.near.get(d, ())} if len(w) >= 3 else ():
            most = min(max(self.slips_in(v), self.slips_in(w)), 2 if min(len(v), len(w)) >= 4 else 1)
            if len(v) >= 4 and (k := edit_distance(w, v, most)) <= most:
                # another way of spelling (neighbourhood, pavillion) may be as frequent as it likes
                if n <= max(3, ratio * self.words[v]) or (k == 1 and len(w) != len(v) and len(v) >= 8):
                    yield v, k + (k == 2 and min(len(v), len(w)) < 7)

    def find(self, w: str, n: int, ratio: float) -> dict[str, int]:
        found = {w: 0} if w in self.words else {}
        if self.short_forms.get(w) in self.words:
            found.setdefault(self.short_forms[w], 1)
        if 2 <= len(w) <= 11 and (not found or len(w) <= 6):
            for v in self.by_letters.get(w[:2], ()):
                if len(v) > len(w):
                    if v.startswith(w):
                        found.setdefault(v, 1 if len(v) <= 16 else 2)
                    elif len(v) >= len(w) + 2:
                        it = iter(v)
                        if all(x in it for x in w):
                            found.setdefault(v, 2 if len(v) <= 16 else 4)
        if w not in self.words:
            for v, k in self.slips(w, n, ratio):
                found[v] = min(found.get(v, 9), k)
        if not found and 5 <= len(w) <= 8:  # a slip in a shortened word
            found = {v: 3 for d in deletions(w, 1) for v in self.begun.get(d, ())}
        return found


def bits(tokens: Iterable[int]) -> int:
    """A bitmap of 64 bits, as a signed number, in which every token sets one."""
    n = 0
    for t in tokens:
        n |= 1 << (t % 64)
    return n - (1 << 64) if n >> 63 else n


#: Numbers of 64 bits that make up a bitmap of tokens, see bitmap().
BITMAPS = ("bits_0", "bits_1", "bits_2", "bits_3", "bits_4", "bits_5")


def bitmap(tokens: Iterable[int]) -> tuple[int, ...]:
    """The bits() of every sixth token, from the first, the second, ... on: hardly two tokens of the reference lists share a bit."""
    tokens = list(tokens)
    return tuple(bits(t // len(BITMAPS) for t in tokens if t % len(BITMAPS) == k) for k in range(len(BITMAPS)))


#: The index a worker holds, by a mark of the call it belongs to.
_INDEXES: dict[str, dict[int, WordIndex]] = {}


def _tie_words(words: DataFrame, known: Mapping[int, Mapping[str, int]], ranks: Mapping[tuple[int, str], int], short_forms: Mapping[str, str], ratio: float) -> DataFrame:
    """(list, word, n) to (list, word, ties, *BITMAPS): for each tie the rank of the token (31 bits) and the cost (8) in one number, with 24 bits left for the word's place."""

    mark = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A worker serves many tasks; it builds the index once.
        if mark not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[mark] = {k: WordIndex(ws, short_forms) for k, ws in known.items()}
        index = _INDEXES[mark]
        for b in batches:
            rows = []
            for k, w, n in zip(b["list"].tolist(), b["word"], b["n"].tolist()):
                if k in index and (found := index[k].find(w, n, ratio)):
                    rows.append((k, w, [(ranks[k, v] << 32) + (c << 24) for v, c in found.items()], *bitmap(ranks[k, v] for v in found)))
            if rows:
                yield pd.DataFrame(rows, columns=["list", "word", "ties", *BITMAPS])

    # The words are few bytes and much work: all cores take part, whatever the size.
    return words.repartition(words.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "list int, word string, ties array<long>, " + ", ".join(f"{b} long" for b in BITMAPS))


@dataclass(frozen=True)
class Form:
    """One way of writing an entry of a list, as a set of tokens; a short one must make up all of a value."""

    list: int
    ref_id: str
    tokens: tuple[str, ...]
    short: bool


def reference_forms(refs: DataFrame, ref_id: str, name: str, code: str | None = None, number: int = 0) -> tuple[list[Form], list[str]]:
    """The forms of the entries of a bounded reference list, and the names as they stand.

    A name's words; its letters run together; its beginning as far as the first
    word that no other entry has, and that word alone; its code.
    """
    words = F.array_distinct(F.filter(words_of(F.col(name)), lambda w: ~w.isin(*NOISE)))
    rows = refs.select(F.col(ref_id).alias("id"), F.col(name).alias("name"), words.alias("words"), squeezed(F.col(name)).alias("whole"), (squeezed(F.col(code)) if code else F.lit(None).cast("string")).alias("code"))
    rows = rows.filter(F.col("id").isNotNull()).distinct().limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} reference entries")
    used = Counter(w for _, ws in {(r["id"], tuple(r["words"] or ())) for r in rows} for w in ws)
    forms: set[Form] = set()
    for r in rows:
        ws = tuple(r["words"] or ())
        forms |= {Form(number, r["id"], ws, False), Form(number, r["id"], (r["whole"] or "",), True), Form(number, r["id"], (r["code"] or "",), True)}
        at = next((i for i, w in enumerate(ws) if used[w] == 1), None)
        if at is not None and at + 1 < len(ws):
            forms |= {Form(number, r["id"], ws[: at + 1], True), Form(number, r["id"], (ws[at],), True)}
    return sorted((f for f in forms if "".join(f.tokens)), key=lambda f: (f.list, f.ref_id, f.tokens, f.short)), sorted({r["name"] for r in rows if r["name"] is not None})


def resolve_values(values: DataFrame, forms: Sequence[Form], threshold: float = 0.5, ratio: float = 0.04, short_forms: Mapping[str, str] = SHORT_FORMS) -> DataFrame:
    """values (list int, value string, n long: rows that have it; distinct) to (list, value, ref_id).

    forms are those of reference_forms() for every list. Values without an entry
    come out with ref_id 'UNMATCHED'; null and blank values come out too,
    unmatched. A tie between entries (Jaccard and cost) leaves the value
    unmatched. Empty inputs give empty results; an empty reference list leaves
    all of its values unmatched.

    Word frequencies are counted over all values. A word that occurs more than
    ratio times as often as the reference word it resembles is a word of its own.
    """
    spark = values.sparkSession
    values = stored(values.select("list", "value", "n"), "values")
    typed = values.filter(~blank(F.col("value"))).select(
        "list", "value", "n",
        F.array_distinct(F.filter(words_of(F.col("value")), lambda w: ~w.isin(*NOISE))).alias("words"),
        squeezed(F.col("value")).alias("whole"),
    )
    # A value gives the set of its words and, where it may be a code or words run together, the one-word set of its letters.
    one = F.filter(F.array("whole"), lambda w: (w != "") & ((F.length(w) <= 12) | (F.size("words") <= 2) | ~F.col("value").rlike(r"\S\s+\S")))
    sets = typed.select("list", "value", "n", F.explode(F.array_distinct(F.array("words", one))).alias("words")).filter(F.size("words") > 0)
    sets = stored(sets.select("list", "value", "n", F.array_join("words", " ").alias("bag")), "sets")  # distinct values only
    # Values that are written in the same words are one until they are mapped: each bag of words is tied and joined once.
    bags = stored(sets.groupBy("list", "bag").agg(F.sum("n").alias("n")).withColumn("words", F.split("bag", " ")), "bags")
    counted = stored(bags.select("list", F.explode("words").alias("word"), "n").groupBy("list", "word").agg(F.sum("n").alias("n")), "words")
    # The reference lists are bounded; their words, with their frequency among the values, go to every task.
    listed = sorted({(f.list, w) for f in forms for w in f.tokens})
    seen = counted.join(F.broadcast(spark.createDataFrame(listed, "list int, word string")), ["list", "word"]).collect()
    often = dict.fromkeys(listed, 0) | {(r["list"], r["word"]): r["n"] for r in seen}
    rarity = {w: i for i, w in enumerate(sorted(often, key=lambda w: (often[w], w)))}
    known: dict[int, dict[str, int]] = {}
    for (k, w), n in often.items():
        known.setdefault(k, {})[w] = n
    # Reference side: tokens by global rarity. Two sets of Jaccard threshold or more share at least threshold of either, so
    # one of the first r - threshold * r + 1 tokens of an entry is shared.
    index = []
    for f in forms:
        toks = sorted({rarity[f.list, w] for w in f.tokens})
        index += [(rank, pos, f.ref_id, f.short, toks, len(toks), *bitmap(toks)) for pos, rank in enumerate(toks[: len(toks) - math.ceil(threshold * len(toks)) + 1])]
    index = spark.createDataFrame(index, "token int, r_pos int, ref_id string, short boolean, r_toks array<int>, r int, " + ", ".join(f"r_{b} long" for b in BITMAPS))

    tied = _tie_words(counted, known, rarity, short_forms, ratio)
    placed = bags.select("list", "bag", F.size("words").alias("k"), F.posexplode("words").alias("at", "word")).join(tied, ["list", "word"])
    rank_of = lambda t: F.shiftright(t, 32).cast("int")
    lists = placed.select("list", "bag", "k", F.transform("ties", lambda t: t + F.col("at")).alias("ties"), rank_of(F.array_max("ties")).alias("last"), *BITMAPS)
    probe = lists.groupBy("list", "bag", "k").agg(F.sort_array(F.flatten(F.collect_list("ties"))).alias("l"), F.sort_array(F.collect_list("last")).alias("lasts"), *(F.bit_or(b).alias(b) for b in BITMAPS))
    # The value's side: a typed word may be tied to several tokens. Before the rarest shared token t come only words that
    # share nothing: those without a tie and those whose last tie is rarer than t. There may be k - threshold * k of them.
    spare = F.col("k") - F.ceil(F.lit(threshold) * F.col("k")).cast("int") - (F.col("k") - F.size("lasts"))
    cut = F.when(spare < F.size("lasts"), F.get("lasts", spare)).otherwise(F.element_at("lasts", -1))
    # What the positional filter needs of the words from each token on is counted before the join, so that is generated code.
    prefix = F.transform(F.array_distinct(F.filter("ranks", lambda t: t <= F.col("cut"))), lambda t: F.struct(t.alias("token"), F.size(F.filter("lasts", lambda u: u >= t)).alias("ahead")))
    probe = probe.filter(spare >= 0).withColumns({"cut": cut, "ranks": F.transform("l", rank_of)})
    sure = F.lit(True)
    for b in BITMAPS:
        sure = sure & (F.col(f"r_{b}").bitwiseAND(F.bitwise_not(b)) == 0)
    overlap = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("k") + F.col("r")) - 1e-9)
    met = (
        probe.withColumn("prefix", prefix)  # made before it is exploded, so the rows are met and filtered in generated code, without copies of them
        .select("list", "bag", "k", "l", "ranks", *BITMAPS, F.inline("prefix"))
        .join(F.broadcast(index), "token")
        .filter((F.col("r") >= F.ceil(F.lit(threshold) * F.col("k"))) & (F.col("k") >= F.ceil(F.lit(threshold) * F.col("r"))))  # length filter
        .filter(sure)  # bitmap filter: no token of the entry is surely not covered
        .filter(F.least(F.col("r") - F.col("r_pos"), F.col("ahead")) >= overlap)  # positional filter
    )
    # Exact verification: for each token of the entry the cheapest word of the value, each word once. Exploding an array of
    # one keeps what follows from being computed again in every filter. Beyond the threshold, every token has to be covered.
    # Ties are sorted, so the first of a token is its cheapest.
    best = F.transform("r_toks", lambda r: F.get("l", F.array_position("ranks", r).cast("int") - 1))
    scored = (
        met.select("list", "bag", "k", "ref_id", "short", "r", F.explode(F.array(best)).alias("hit"))
        .filter(~F.exists("hit", lambda h: h.isNull()))
        .select("list", "bag", "k", "ref_id", "short", "r", "hit", F.explode(F.array(F.size(F.array_distinct(F.transform("hit", lambda h: h.bitwiseAND(0xFFFFFF)))))).alias("m"))
        .withColumn("jaccard", F.col("m") / (F.col("k") + F.col("r") - F.col("m")))
        .filter((F.col("jaccard") >= threshold) & (F.col("m") == F.col("r")) & (~F.col("short") | (F.col("m") == F.col("k"))))
        .withColumn("cost", F.aggregate("hit", F.lit(0), lambda a, h: a + F.shiftright(h, 24).bitwiseAND(255).cast("int")))
        .groupBy("list", "bag", "ref_id").agg(F.min(F.struct((-F.col("jaccard")).alias("far"), "cost")).alias("s"))
    )
    checked = (
        sets.select("list", "value", "bag").join(scored, ["list", "bag"])
        .groupBy("list", "value", "ref_id").agg(F.min("s").alias("s"))
        .groupBy("list", "value").agg(F.min(F.struct(F.col("s"), F.col("ref_id"))).alias("one"), F.sort_array(F.collect_list("s")).alias("all"))
        .select("list", "value", F.when((F.size("all") > 1) & (F.col("all")[0] == F.col("all")[1]), F.lit(UNMATCHED)).otherwise(F.col("one.ref_id")).alias("ref_id"))
    )
    return values.select("list", "value").join(checked, ["list", "value"], "left").select("list", "value", F.coalesce("ref_id", F.lit(UNMATCHED)).alias("ref_id"))


#: The fields that are mapped, by list number: column, reference id, name and code.
FIELDS = (("specialty", "specialty_id", "specialty_name", "short_code"), ("facility_name", "facility_id", "facility_name", None))


def field_values(rows: DataFrame, *columns: str) -> DataFrame:
    """(list, value, n): how often each of the columns, numbered from 0, has each value, in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("list"), F.col(c).alias("value")) for i, c in enumerate(columns))))
    return rows.select(each.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).select("v.list", "v.value", "n")


def map_typed(records: DataFrame, field: str, refs: DataFrame, ref_id: str, name: str, code: str | None = None) -> DataFrame:
    """(value, ref_id) of every distinct value of a column, exact entries included."""
    return resolve_values(field_values(records, field), reference_forms(refs, ref_id, name, code)[0]).select("value", "ref_id")


def map_fields(counts: DataFrame, specialties: DataFrame, facilities: DataFrame) -> DataFrame:
    """(list, value, ref_id, exact) of all values of specialty (list 0) and facility_name (1); exact: letter for letter an entry's name. Written once."""
    forms, names = [], []
    for k, (refs, (_, ref_id, name, code)) in enumerate(zip((specialties, facilities), FIELDS)):
        own, written = reference_forms(refs, ref_id, name, code, k)
        forms += own
        names += [(k, n, True) for n in written]
    listed = counts.sparkSession.createDataFrame(names, "list int, value string, exact boolean")
    out = resolve_values(counts, forms).join(F.broadcast(listed), ["list", "value"], "left")
    return stored(out.withColumn("exact", F.coalesce("exact", F.lit(False))), "mapping")


def mapped_values(records: DataFrame, specialties: DataFrame, facilities: DataFrame) -> DataFrame:
    """Rows and fields of source_records whose value is there and isn't an entry as it stands: (record_id, field, ref_id)."""
    columns = [f[0] for f in FIELDS]
    mapping = map_fields(field_values(records, *columns), specialties, facilities).filter(~F.col("exact"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("list"), F.col(c).alias("value")) for i, c in enumerate(columns))))
    rows = records.select("record_id", each.alias("v")).select("record_id", "v.list", "v.value").filter(~blank(F.col("value")))
    names = F.element_at(F.array(*map(F.lit, columns)), F.col("list") + 1)
    return join_checked(rows, mapping, ["list", "value"], "inner").select("record_id", names.alias("field"), "ref_id")
