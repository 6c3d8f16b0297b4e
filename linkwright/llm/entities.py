"""Records of one physician in sources without a common key: a deterministic rule cascade."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.groups import group_links, group_stars
from linkwright.llm.people import features, given_names, shared_npis
from linkwright.llm.values import field_values, map_fields
from linkwright.storage import join_checked, stored

#: Attribute combinations from strong to weak. npi9: the npi but for its first digit, the one most often wrong; head and
#: tail: the first four and the last four or five letters of the surname, one of which outlives a slip; letter: initial or middle, for those
#: who go by their middle name.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("npi_surname", ("npi9", "surname")),
    ("name_facility", ("surname", "given", "facility_id")),
    ("name_specialty", ("surname", "given", "specialty_id")),
    ("initial_facility_specialty", ("surname", "initial", "facility_id", "specialty_id")),
    ("npi_given", ("npi9", "given")),
    ("initial_facility", ("surname", "initial", "facility_id")),
    ("initial_specialty_state", ("surname", "initial", "specialty_id", "state")),
    ("head_facility_specialty", ("head", "initial", "facility_id", "specialty_id")),
    ("tail_facility_specialty", ("tail", "initial", "facility_id", "specialty_id")),
    ("letter_facility_specialty", ("surname", "letter", "facility_id", "specialty_id")),
    ("head_facility", ("head", "initial", "facility_id")),
    ("tail_facility", ("tail", "initial", "facility_id")),
    ("head_given_facility", ("head", "given", "facility_id")),
    ("tail_given_facility", ("tail", "given", "facility_id")),
    ("head_given_zip", ("head", "given", "zip")),
    ("tail_given_zip", ("tail", "given", "zip")),
    ("head_middle_facility", ("head", "initial", "middle", "facility_id")),
    ("tail_middle_facility", ("tail", "initial", "middle", "facility_id")),
    ("name", ("surname", "given")),
)
#: A rule's links are used if so large a share of the labelled ones is right.
FLOOR = 0.995
#: The rules are measured on about this many labelled records, whole entities at a time.
MOST_LABELLED = 40_000


#: Rules that have these attributes make their keys where these agree, so one row goes there for all of them; letter: the initial, the
#: middle initial or the opening letter of the given name, whichever the rule settles.
HOMES = (("npi9",), ("facility_id", "letter"), ("given", "zip"), ("surname", "letter"))


@dataclass(frozen=True)
class Home:
    """Where rows of rules meet: seed is the same for all letters, sent are the attributes that any of these needs there."""

    seed: int
    at: tuple[str, ...]
    rules: tuple[tuple[int, tuple[str, ...]], ...]  # and the attributes besides at
    sent: tuple[str, ...]
    also: int | None  # the home by the initial, of one by the opening letter


def homes_of(rules: Sequence[tuple[str, tuple[str, ...]]]) -> list[Home]:
    """The homes of the rules; a rule that fits none of HOMES has one of its own."""
    own: dict[tuple[tuple[str, ...], tuple[str, ...]], list[tuple[int, tuple[str, ...]]]] = {}
    for i, (_, attributes) in enumerate(rules):
        for letter in ("initial", "middle") if "letter" in attributes else ("",):
            names = tuple(letter if x == "letter" else x for x in attributes)
            begins = letter or ("initial" if "initial" in names else "opening" if "given" in names else "")
            home = next((h for h in HOMES if all(begins if x == "letter" else x in names for x in h)), names)
            at = tuple(begins if x == "letter" else x for x in home)
            own.setdefault((home, at), []).append((i, tuple(x for x in names if x not in at)))
    seeds = list(dict.fromkeys(h for h, _ in own))
    sent = {h: tuple(dict.fromkeys(x for (g, _), rs in own.items() if g == h for _, xs in rs for x in xs)) for h in seeds}
    places = list(own)
    by_initial = lambda h, at: (h, tuple("initial" if x == "opening" else x for x in at))
    return [Home(seeds.index(h), at, tuple(rs), sent[h], places.index(by_initial(h, at)) if "opening" in at and by_initial(h, at) in own else None) for (h, at), rs in own.items()]


def keyed(nodes: DataFrame, rules: Sequence[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """(home, node, who, rest, a_0, a_1, ...), no nulls: a row for each home at which a rule has all of its attributes; small, so numbers only.

    who: hashes of known given name (upper half) and npi9 (lower half). rest: number of the home, middle initial, and a bit each for labelled,
    known and npi9 being there, and for a row that stands for the home by the opening letter, too. a_: hashes of what is sent, 0 for none. The
    homes are in the metadata of home.
    """
    homes = homes_of(rules)
    half = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.hash(c).cast("long").bitwiseAND(0xFFFFFFFF))
    there = lambda c, bit: F.when(F.col(c).isNotNull(), 1 << bit).otherwise(0)
    middle = F.shiftleft(F.coalesce(F.ascii("middle"), F.lit(0)).bitwiseAND(127), 8)
    typed = {a: F.substring("given", 1, 1) if a == "opening" else F.col(a) for a in dict.fromkeys(x for h in homes for x in (*h.at, *h.sent))}
    own = nodes.select(
        "node", (F.shiftleft(half("known_given"), 32) + half("npi9")).alias("who"), (middle + there("label", 15) + there("known_given", 16) + there("npi9", 17)).cast("int").alias("rest"),
        *(F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(c)).alias(f"h_{a}") for a, c in typed.items()),
    )
    names = ["home", "node", "who", "rest", *(f"a_{k}" for k in range(max((len(h.sent) for h in homes), default=0)))]

    # Twenty hashes in one generated method are too many for it to be compiled.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
            every = np.ones(b.num_rows, dtype=bool)
            has = lambda xs: np.logical_and.reduce([every, *(col[f"h_{x}"] != 0 for x in xs)])  # noqa: B023, E731
            goes = [has(h.at) & np.logical_or.reduce([has(xs) for _, xs in h.rules]) for h in homes]
            joint = [~every for _ in homes]
            for k, h in enumerate(homes):
                if h.also is not None:
                    joint[h.also] = goes[k] & (col["h_opening"] == col["h_initial"])
                    goes[h.also], goes[k] = goes[h.also] | joint[h.also], goes[k] & ~joint[h.also]
            out: list[list[np.ndarray]] = []
            for k, h in enumerate(homes):
                at = np.flatnonzero(goes[k])
                used = {x for g in homes if g is h or g.also == k for _, xs in g.rules for x in xs}
                sent = [col[f"h_{x}"][at] if x in used else np.zeros(len(at), dtype="int64") for x in h.sent]
                sent += [np.zeros(len(at), dtype="int64")] * (len(names) - 4 - len(sent))
                out.append([_mixed(h.seed, [col[f"h_{x}"][at] for x in h.at]), col["node"][at], col["who"][at], col["rest"][at] + np.int32(k) + (joint[k][at].astype("int32") << 18), *sent])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    rows = own.mapInArrow(run, ", ".join(f"{n} {'int' if n == 'rest' else 'long'}" for n in names))
    return rows.select(F.col("home").alias("home", metadata={"homes": json.dumps([vars(h) for h in homes])}), *names[1:])


def _mixed(seed: int, hashes: Sequence[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of several, in their order."""
    k = np.full(len(hashes[0]), seed * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1, dtype="uint64")
    for h in hashes:
        k = (k ^ h.view("uint64")) * np.uint64(0xBF58476D1CE4E5B9)
        k = (k ^ (k >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        k ^= k >> np.uint64(32)
    return k.view("int64")


#: No value, where the others are of 32 bits.
NONE = -(1 << 40)
#: Rows of whole homes that are linked at once, unless a home has more.
AT_ONCE = 200_000


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begin): rows sorted by columns, and where rows of other values begin in that order."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order, np.flatnonzero(new)


def _each(at: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> np.ndarray:
    """The values, one for each run, for each row."""
    order, begin = at
    out = np.empty(len(order), dtype=values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(begin, len(order))))
    return out


def _mode(values: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """The most frequent value, the smallest of several, of the rows that agree in by, for each row; NONE does not count."""
    groups = _runs(*by)
    group = _each(groups, np.arange(len(groups[1])))
    there = values != NONE
    order, begin = _runs(group[there], values[there])
    g, v = group[there][order][begin], values[there][order][begin]
    n = np.diff(np.append(begin, len(order)))
    best = np.lexsort((v, -n, g))
    first = best[np.concatenate([[True], g[best][1:] != g[best][:-1]])] if len(best) else best
    out = np.full(len(groups[1]), NONE)
    out[g[first]] = v[first]
    return out[group]


def _least(node: np.ndarray, labelled: np.ndarray, fit: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest node of each row's run that fits; for an unlabelled row, of the unlabelled ones. Labelled records only measure: what is unlabelled meets without them."""
    order, begin = at
    none = np.iinfo("int64").max
    least = lambda use: _each(at, np.minimum.reduceat(np.where(use, node, none)[order], begin)) if len(begin) else node
    return np.where(labelled, least(fit), least(fit & ~labelled))


def _links(key: np.ndarray, node: np.ndarray, who: np.ndarray, rest: np.ndarray, loose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """links_of() for whole keys, sorted by key."""
    if not len(key):
        return node, node, rest.astype("int8")
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    use = np.repeat(np.minimum.reduceat(node, begin) != np.maximum.reduceat(node, begin), size)
    if not use.any():
        return node[:0], node[:0], rest[:0].astype("int8")
    key, node, who, rest = key[use], node[use], who[use], rest[use].astype("int64")
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    rule, labelled = rest & 0xFF, (rest >> 15 & 1) > 0
    exempt = np.isin(rule, loose)
    middle, low = rest >> 8 & 127, who & 0xFFFFFFFF
    values = [
        np.where(rest >> 17 & 1, np.where(low >> 31 & 1, low - (1 << 32), low), NONE),
        np.where((rest >> 16 & 1 > 0) & ~exempt, who >> 32, NONE),
        np.where((middle > 0) & ~exempt, middle, NONE),
    ]
    differ = []
    for v in values:
        high = np.maximum.reduceat(v, begin)
        differ.append(np.repeat((high != NONE) & (np.minimum.reduceat(np.where(v == NONE, -NONE, v), begin) != high), size))
    clash = differ[0] | differ[1] | differ[2]
    to, kind = np.empty_like(node), np.zeros(len(node), dtype="int64")
    whole = ~clash
    to[whole] = _least(node[whole], labelled[whole], np.ones(int(whole.sum()), dtype=bool), _runs(key[whole]))
    if clash.any():
        k, n, known_label = key[clash], node[clash], labelled[clash]
        # What agrees tells no parts apart.
        npi9, known, middle = (np.where(d[clash], v[clash], NONE) for v, d in zip(values, differ))
        own = np.logical_and.reduce([~d[clash] | (v != NONE) for v, d in zip((npi9, known, middle), differ)])
        fill = lambda v, *by: np.where(v == NONE, _mode(v, k, *by), v)
        npi9, typed = fill(npi9, known, middle), npi9
        npi9 = np.where(npi9 == NONE, _mode(typed, k), npi9)
        known = fill(known, npi9)
        middle = fill(middle, npi9, known)
        part = _runs(k, npi9, known, middle)
        first, first_own = _least(n, known_label, np.ones(len(n), dtype=bool), part), _least(n, known_label, own, part)
        inner = own & (n != first_own)
        # All links lead to a smaller node: the first with values of its own leads on to the first of all.
        to[clash], kind[clash] = np.where(inner, first_own, first), np.where(inner, 1, 2)
    moved = node != to
    return node[moved], to[moved], (rule[moved] * 3 + kind[moved]).astype("int8")


def _linked(keys: DataFrame, loose: Sequence[int], out: Callable[[list[np.ndarray]], list[np.ndarray]], schema: str) -> DataFrame:
    """What out makes of the (node, to, rule) of whole homes, see links_of(). Rows come sorted by home; a task holds AT_ONCE of them, or one home's."""
    letters = np.array(list(loose), dtype="int64")
    homes = json.loads(keys.schema["home"].metadata["homes"])
    columns = keys.columns
    names = [f.split()[0] for f in schema.split(", ")]
    rules = sorted({i for h in homes for i, _ in h["rules"]})

    def of(i: int, row: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The links of one rule."""
        at, keys = [], []
        for k, h in enumerate(homes):
            for xs in (xs for j, xs in h["rules"] if j == i):
                here = row["slot"] == k
                if h["also"] is not None:
                    here |= (row["slot"] == h["also"]) & row["joint"]
                for x in (places := [f"a_{h['sent'].index(x)}" for x in xs]):
                    here &= row[x] != 0
                at.append(np.flatnonzero(here))
                keys.append(_mixed(i, [row["home"][at[-1]], *(row[x][at[-1]] for x in places)]))
        at, key = np.concatenate(at), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        at = at[order]
        return _links(key[order], row["node"][at], row["who"][at], row["rest"][at] & ~0xFF | i, letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in chain(batches, [None]):
            if b is not None:
                held.append([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
                if sum(len(h[0]) for h in held) < AT_ONCE:
                    continue
            if not held:
                continue
            rows = [np.concatenate(c) for c in zip(*held)]
            # The last home may go on.
            cut = len(rows[0]) if b is None else int(np.searchsorted(rows[0], rows[0][-1]))
            held = [[c[cut:] for c in rows]] if cut < len(rows[0]) else []
            if cut:
                row = {c: x[:cut] for c, x in zip(columns, rows)}
                row |= {"slot": row["rest"] & 0xFF, "joint": (row["rest"] >> 18 & 1) > 0}
                got = out([np.concatenate(c) for c in zip(*(of(i, row) for i in rules))])
                for at in range(0, len(got[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in got], names=names)

    return keys.repartition("home").sortWithinPartitions("home").mapInArrow(run, schema)


def links_of(keys: DataFrame, loose: Sequence[int]) -> DataFrame:
    """(node, to, rule): each row of keyed() linked to a smaller node under its key; rule is 3 * rule + 0, 1 or 2.

    A key under which npi9, known given name or (rules in loose: neither of the
    two) middle initial disagree is divided into parts by those that do. 0: the
    key is whole. 1: both ends have the part's values themselves. 2: an end lacks
    some and goes where most records are that agree with it in the others.
    """
    return _linked(keys, loose, list, "node long, to long, rule tinyint")


def ends_of(keys: DataFrame, loose: Sequence[int], kinds: int) -> DataFrame:
    """(node, to, kinds_0, ...): links_of() of each home with the rules of two ends in one row, as bits; kinds is the number of different rules, 63 a column."""
    words = range((kinds + 62) // 63)

    def out(links: list[np.ndarray]) -> list[np.ndarray]:
        node, to, rule = links
        order, begin = _runs(node, to)
        node, to, rule = node[order], to[order], rule[order].astype("int64")
        bits = [np.where(rule // 63 == w, np.int64(1) << rule % 63, 0) for w in words]
        return [node[begin], to[begin], *(np.bitwise_or.reduceat(x, begin) if len(begin) else x for x in bits)]

    return _linked(keys, loose, out, "node long, to long, " + ", ".join(f"kinds_{w} long" for w in words))


def match_entities(rows: DataFrame, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES, floor: float = FLOOR, groups: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs of records of different sources that are one entity, each with a confidence.

    rows: source_id, source, label (the entity where it is known, else null),
    the attributes named in rules, given and middle. Result: source_id_1,
    source_id_2 (the smaller first), rule (of the weaker end), confidence.
    Pairs among unlabelled records only; labelled ones serve to measure rules.

    The cascade's passes run from strong to weak rules: in each, records are
    joined exactly on the rule's attributes to the first record (by id) that has
    them. A record counts for the first rule under which it meets another; that
    link resolves it and gives its confidence, and the links of all records so
    resolved are a forest whose trees are groups. All passes are made in one
    shuffle, as which record stands for a key doesn't depend on the pass; a record
    goes there once for each of HOMES, not for each rule. Records
    are not anti-joined out of later passes altogether: a later rule's link of a
    resolved record is used where, and only where, it connects two groups
    (without these links 3 of 100 true pairs are lost, see the README). Keys
    under which npis, full given names or middle initials
    disagree are divided by them, see links_of(). A rule's confidence is its
    precision on the labelled records, smoothed with one right and one wrong
    link, taken apart for whole keys, for parts and for what is attached to a
    part; those with a share of right links, not smoothed, under floor are left
    out. Without any labelled link there is no ground to leave one out.

    Nulls: a rule needs all of its attributes. Repeated rows count once. Records
    that share nothing are in no pair. Work grows with records times rules: a
    key never gives pairs, only one link for each record that has it, however
    many do. Pairs are made only within the entities found.
    """
    needed = dict.fromkeys(["source_id", "source", "label", "known_given", "middle", "initial", "npi9", *(x for _, a in rules for x in a if x != "letter")])
    nodes = stored(rows.select(*needed).withColumn("node", F.xxhash64("source_id")), "nodes")
    star = stored(ends_of(keyed(nodes, rules), [i for i, (_, a) in enumerate(rules) if "letter" in a], 3 * len(rules)), "star")
    kinds = [c for c in star.columns if c.startswith("kinds_")]
    label = stored(nodes.filter("label is not null").select("node", F.xxhash64("label").alias("label")).distinct(), "labels")
    # An entity is labelled as a whole, so a labelled record's link to any other label or to none is wrong.
    marks = F.broadcast(label)  # the labelled sample is bounded, see MOST_LABELLED
    tested = star.join(marks, "node").join(F.broadcast(label.select(F.col("node").alias("to"), F.col("label").alias("to_label"))), "to", "left")
    right = F.coalesce((F.col("label") == F.col("to_label")).cast("int"), F.lit(0))
    alike = tested.groupBy(right.alias("right"), *kinds).agg(F.count(F.lit(1)).alias("links"))
    each = F.array(*(F.when(F.col(kinds[i // 63]).bitwiseAND(1 << i % 63) != 0, i) for i in range(3 * len(rules))))
    measured = alike.select(F.explode(each).alias("rule"), "right", "links").filter("rule is not null").groupBy("rule").agg(F.sum(F.col("right") * F.col("links")).alias("right"), F.sum("links").alias("links"))
    names = [n for n, _ in rules]
    got = {r["rule"]: (r["right"], r["links"]) for r in measured.collect()}  # at most three rows per rule
    # The share itself is held against floor: smoothed, a rule with few labelled links would fail by their number alone.
    trusted = {}
    for i in range(3 * len(rules)):
        good, links = got.get(i, (0, 0))
        if good >= floor * links:
            trusted[i] = (good + 1) / (links + 2)
    if not trusted:
        return rows.sparkSession.createDataFrame([], "source_id_1 string, source_id_2 string, rule string, confidence double")
    conf = F.element_at(F.create_map(*[F.lit(x) for kv in trusted.items() for x in kv]), F.col("rule"))
    used = {c: F.col(c).bitwiseAND(sum(1 << i % 63 for i in trusted if i // 63 == w)) for w, c in enumerate(kinds)}
    links = star.withColumns(used).filter(reduce(or_, (F.col(c) != 0 for c in kinds))).join(marks.select("node"), "node", "left_anti")
    joined = groups or group_links
    # A record has at most one link a rule, many of them to the same record; the strongest is the lowest bit.
    lowest = F.coalesce(*(F.when(F.col(c) != 0, 63 * w + F.bit_count(F.col(c).bitwiseAND(-F.col(c)) - 1)) for w, c in enumerate(kinds)))
    links = stored(links.groupBy("node", "to").agg(*(F.bit_or(c).alias(c) for c in kinds)).select("node", "to", lowest.cast("tinyint").alias("rule")), "ends")
    first = stored(links.groupBy("node").agg(F.min_by("to", "rule").alias("to"), F.min("rule").alias("rule")), "first")
    # Each record's first rule gives a forest; its trees are groups. The other links matter only where they connect two.
    group = group_stars(first, links, joined)
    members = (
        group.join(first.select("node", "rule"), "node", "left")
        .join(nodes.filter("label is null").select("node", "source_id", "source").distinct(), "node")
        .select("group", "source_id", "source", F.coalesce("rule", F.lit(0)).alias("rule"))
    )
    a, b = members.alias("a"), members.alias("b")
    return (
        a.join(b, (F.col("a.group") == F.col("b.group")) & (F.col("a.source") != F.col("b.source")) & (F.col("a.source_id") < F.col("b.source_id")))
        .select(F.col("a.source_id").alias("source_id_1"), F.col("b.source_id").alias("source_id_2"), F.greatest("a.rule", "b.rule").alias("rule"))
        .select("source_id_1", "source_id_2", F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for k in range(3) for x in (3 * i + k, n)]), F.col("rule")).alias("rule"), conf.alias("confidence"))
    )


def person_rows(records: DataFrame, mapping: DataFrame, specialties: DataFrame, facilities: DataFrame, extra: tuple[str, ...] = (), most_labelled: int = MOST_LABELLED) -> DataFrame:
    """features() with label (canonical id of settled source_ids), and npi9, head and tail of npi and surname.

    Settled records beyond a sample of about most_labelled, whole entities by a
    hash, are left out before anything is taken apart; what is learned about
    given names, typed values and npis rests on all records. An npi that stands
    in for a missing one (shared_npis) is none.
    """
    records = records.filter(F.col("source_id").isNotNull())
    labels = stored(mapping.filter(F.col("source_id").isNotNull() & F.col("canonical_id").isNotNull()).groupBy("source_id").agg(F.min("canonical_id").alias("label")), "labels")
    share = labels.agg(F.least(F.lit(1.0), F.lit(most_labelled) / F.greatest(F.count(F.lit(1)), F.lit(1)))).first()[0]
    sampled = F.pmod(F.xxhash64("label"), F.lit(1_000_000)) < int(share * 1_000_000)
    givens = stored(given_names(records, labels), "givens")
    values = map_fields(field_values(records, "specialty", "facility_name"), specialties, facilities)
    kept = join_checked(records, labels, "source_id").filter(F.col("label").isNull() | sampled)
    shared = stored(shared_npis(records), "shared").withColumn("shared", F.lit(True))
    rows = join_checked(features(kept, givens, specialties, facilities, ("label", *extra), mapping=values), shared, "npi")
    return rows.withColumn("npi", F.when(F.col("shared").isNull(), F.col("npi"))).drop("shared").withColumns({
        "npi9": F.substring("npi", 2, 9),  # the first digit is the one most often mistyped
        "head": F.when(F.length("surname") >= 5, F.substring("surname", 1, 4)), "tail": F.when(F.length("surname") >= 5, F.substring("surname", F.length("surname") - F.when(F.length("surname") >= 8, 4).otherwise(3), F.lit(5))),
    })
