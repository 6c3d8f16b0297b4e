"""Comparable features of person records: surname, given name, middle initial, place, specialty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.text import blank, plain, squeezed
from linkwright.llm.values import UNMATCHED, field_values, map_fields
from linkwright.storage import join_checked, stored

# Titles, credentials and generation marks, as single words without dots.
TITLES = ("dr", "prof", "professor", "mr", "mrs", "ms", "doctor")
CREDENTIALS = ("md", "do", "phd", "mbbs", "mph", "rn", "np", "pa", "dds", "dpm", "msc", "mba", "facs", "facp", "faan", "facc", "frcs", "frcp", "esq")
GENERATIONS = ("jr", "sr", "ii", "iii", "iv")
NOT_NAMES = TITLES + CREDENTIALS + GENERATIONS

#: One word of plain letters that is no title, credential or generation mark (those of five letters and more are names here): it is its own plain form.
PLAIN_WORD = r"^(?!(?i:" + "|".join(w for w in NOT_NAMES if len(w) < 5) + r")\z)[A-Za-z]+\z"
#: A raw name of at most two words whatever is left out of it, with or without a comma between them: nothing in it comes after the first given name.
TWO_WORDS = r"^\s*[A-Za-zÀ-ÏÑ-ÖØ-Ýß-ïñ-öø-ýÿ'’-]+(?:(?:\s*[,;]\s*|\s+)[A-Za-zÀ-ÏÑ-ÖØ-Ýß-ïñ-öø-ýÿ'’-]+)?\s*\z"

#: A name is looked up in the learned list only if at least this share of the labelled (or all) rows has it: so the list has at most 1 / share entries.
LEAST_SHARE = 1 / 20_000


def name_words(c: Column) -> Column:
    """Words of a typed name, plain, in order; titles, credentials and generation marks left out."""
    low = F.translate(plain(c), "01358'’`-", "olesb")
    low = F.regexp_replace(low, r"(?<=\b[a-z])\.(?=[a-z]\.|[a-z]\b)", "")  # m.d. to md
    words = F.filter(F.split(F.regexp_replace(low, "[^a-z]+", " "), " "), lambda w: (w != "") & ~w.isin(*NOT_NAMES))
    # Most parsed names are one word of plain letters.
    return F.when(c.rlike(PLAIN_WORD), F.array(F.lower(c))).otherwise(words)


# Words in front of a surname that come and go.
PARTICLES = ("de", "la", "del", "della", "dos", "das", "da", "di", "du", "le", "el", "al", "van", "der", "den", "von", "zu", "st", "y", "e")


def surname_of(c: Column) -> Column:
    """Letters of a typed surname: parts of double names in one order, particles left out unless nothing else is there."""
    parts = name_words(F.regexp_replace(c, "-", " "))
    firm = F.filter(parts, lambda w: ~w.isin(*PARTICLES))
    sorted_ = F.array_join(F.array_sort(F.when(F.size(firm) > 0, firm).otherwise(parts)), "")
    return F.when(c.rlike(PLAIN_WORD), F.lower(c)).otherwise(sorted_)


def name_of(c: Column) -> Column:
    """name_words() run together."""
    return F.when(c.rlike(PLAIN_WORD), F.lower(c)).otherwise(F.array_join(name_words(c), ""))


def zip5(c: Column) -> Column:
    """The first five digits of a zip that opens with five digits, else null."""
    return F.when(c.rlike(r"^\s*[0-9]{5}(-?[0-9]{4})?\s*$"), F.substring(F.trim(c), 1, 5))


def valid_npi(c: Column) -> Column:
    """Ten digits, not all the same nor a count upwards; else null. A leading NPI and other signs around are dropped."""
    digits = F.when(c.rlike(r"^[0-9]{10}\z"), c).otherwise(F.regexp_replace(c, "[^0-9]", ""))
    return F.when((F.length(digits) == 10) & ~digits.isin(*(10 * d for d in "0123456789"), "1234567890", "0123456789", "9876543210"), digits)


#: So many rows make an npi worth a look, see shared_npis().
SHARED_ROWS = 20


def shared_npis(records: DataFrame) -> DataFrame:
    """(npi): well-formed npis that stand in for a missing one: SHARED_ROWS rows or more have them and a surname, and no letter opens more than half of these.

    The slips of one person's name leave its first letter in most rows, however
    many there are. Rows are counted by npi first, so only those of frequent
    npis are looked at.
    """
    rows = records.filter(F.col("name_last").isNotNull()).select("npi", F.lower(F.substring(F.ltrim("name_last"), 1, 1)).alias("letter"))
    often = stored(rows.groupBy("npi").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= SHARED_ROWS) & valid_npi(F.col("npi")).isNotNull()).select("npi"), "often")
    letters = join_checked(rows, often, "npi", "inner").groupBy("npi", "letter").agg(F.count(F.lit(1)).alias("n"))
    several = letters.groupBy("npi").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter(2 * F.col("most") <= F.col("n"))
    return several.select(valid_npi(F.col("npi")).alias("npi")).distinct()


# Names of the states by their postal codes.
STATE_NAMES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "newhampshire": "NH",
    "newjersey": "NJ", "newmexico": "NM", "newyork": "NY", "northcarolina": "NC", "northdakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhodeisland": "RI", "southcarolina": "SC", "southdakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "westvirginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}


def state_code(c: Column) -> Column:
    """Two-letter code of a state typed as code, name or beginning of one name only; else null."""
    s = F.regexp_replace(F.lower(c), "[^a-z]", "")
    names = F.create_map(*[F.lit(x) for kv in STATE_NAMES.items() for x in kv])
    begins = {}
    for name, code in STATE_NAMES.items():
        for k in range(3, 6):
            begins.setdefault(name[:k], set()).add(code)
    starts = F.create_map(*[F.lit(x) for k, v in begins.items() if len(v) == 1 for x in (k, next(iter(v)))])
    typed = F.when(F.length(s) == 2, F.upper(s)).otherwise(F.coalesce(F.element_at(names, s), F.element_at(starts, s)))
    return F.when(c.rlike(r"^[A-Za-z]{2}\z"), F.upper(c)).otherwise(typed)


def given_names(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, given): names that are given names by their use, each with the full form it is short for.

    A word is a given name if it is the first name of a fair share of all rows
    and seldom a last name. What it is short for is learned from the labelled
    groups (source_id, label): the given name that most of the groups with the
    short form use most; labels is a stored table. At most 2 / LEAST_SHARE rows, so fit to be broadcast.
    """
    one = lambda c: name_of(F.col(c))
    total = F.broadcast(records.agg(F.greatest(F.lit(3.0), F.count(F.lit(1)) / 3000).alias("least")))
    # Counted as typed first, so each spelling is taken apart once.
    typed = records.select(F.explode(F.array(F.struct(F.col("name_first").alias("typed"), F.lit(True).alias("first")), F.struct(F.col("name_last").alias("typed"), F.lit(False).alias("first")))).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    used = typed.select(one("u.typed").alias("name"), F.when(F.col("u.first"), F.col("n")).otherwise(0).alias("f"), F.when(F.col("u.first"), 0).otherwise(F.col("n")).alias("l"))
    common = used.filter(F.length("name") >= 2).groupBy("name").agg(F.sum("f").alias("f"), F.sum("l").alias("l")).crossJoin(total).filter((F.col("f") >= F.col("least")) & (F.col("f") >= 4 * F.col("l"))).select("name")
    firsts = join_checked(records.select("source_id", "name_first"), labels, "source_id", "inner").select("label", one("name_first").alias("name"))
    known = firsts.filter(F.length("name") >= 2).groupBy("label", "name").agg(F.count(F.lit(1)).alias("n"))
    full = known.groupBy("label").agg(F.max(F.struct("n", F.length("name"), "name")).alias("m"), F.collect_list("name").alias("names")).filter(F.size("names") > 1)
    pairs = full.select(F.col("m.name").alias("given"), F.explode("names").alias("name")).groupBy("name", "given").agg(F.count(F.lit(1)).alias("n"))
    learned = (
        pairs.groupBy("name").agg(F.max(F.struct("n", "given")).alias("m"), F.sum("n").alias("all"))
        .crossJoin(F.broadcast(labels.agg(F.greatest(F.lit(2.0), F.count(F.lit(1)) * F.lit(LEAST_SHARE)).alias("least"))))
        .filter((F.col("m.n") >= F.col("least")) & (2 * F.col("m.n") > F.col("all")) & (F.length("m.given") > F.length("name") - 2))
        .select("name", F.col("m.given").alias("given"))
    )
    return common.join(learned, "name", "full_outer").select("name", F.coalesce("given", "name").alias("given"), F.lit(True).alias("is_given"))


def features(records: DataFrame, givens: DataFrame, specialties: DataFrame, facilities: DataFrame, extra: tuple[str, ...] = (), as_written: bool = False, places: bool = True, mapping: DataFrame | None = None) -> DataFrame:
    """One row per row of source_records with what tells persons apart.

    source_id, source, surname, given (full form; null if only an initial is
    known), known_given (given, if it is on the list), initial, middle (initial), npi, specialty_id, facility_id, zip,
    state: strings, null where missing, malformed or unresolved. The parsed
    names are preferred, given and last name put right if they are swapped;
    where they are missing name_raw is parsed. as_written adds surname_written,
    given_written and middle_written: the words themselves, in their order;
    without places, specialty_id and facility_id are left out.
    """
    # Joins come in three lots with what Spark can't generate code for between them: all in one, the generated method is too long to be compiled.
    ids = []
    fields = ["source_id", "source", "npi", "facility_zip", "facility_state", "name_raw", "name_first", "name_last", "name_middle", *(["specialty", "facility_name"] if places else [])]
    named = records.select(*extra).columns
    counted, records = records, records.select(*fields, *extra)
    extra = named
    if places:
        ids = ["specialty_id", "facility_id"]
        mapping = map_fields(field_values(counted, "specialty", "facility_name"), specialties, facilities) if mapping is None else mapping
        for k, (field, to) in enumerate((("specialty", "specialty_id"), ("facility_name", "facility_id"))):
            own = mapping.filter((F.col("list") == k) & (F.col("ref_id") != UNMATCHED)).select(F.col("value").alias(field), F.col("ref_id").alias(to))
            records = join_checked(records, own, field)
        # A facility that is on no list still serves as a place, by its letters.
        records = records.withColumn("facility_id", F.coalesce("facility_id", F.when(~blank(F.col("facility_name")) & (F.length("facility_name") > 14), squeezed(F.col("facility_name")))))
    rows = records.select(
        "source_id", "source", *ids, *extra,
        valid_npi(F.col("npi")).alias("npi"), zip5(F.col("facility_zip")).alias("zip"), state_code(F.col("facility_state")).alias("state"),
        F.when(~F.coalesce(F.col("name_last").contains(","), F.lit(False)), name_of(F.col("name_first"))).alias("f"),
        F.when(~F.coalesce(F.col("name_last").contains(","), F.lit(False)), surname_of(F.col("name_last"))).alias("l"),
        *([F.when(~F.coalesce(F.col("name_last").contains(","), F.lit(False)), name_of(F.col("name_last"))).alias("l_raw")] if as_written else []),
        name_of(F.col("name_middle")).alias("mi"),
        "name_raw",
    )
    # The raw name is taken apart only where the parsed columns leave something out.
    lacks = ~F.coalesce((F.length("f") > 0) & (F.length("l") > 0) & ((F.length("mi") > 0) | F.col("name_raw").rlike(TWO_WORDS)), F.lit(False))
    bare = F.split(F.regexp_replace(F.when(lacks, F.col("name_raw")), r"(?i)[,;_ ]+(m\.?d|d\.?o|mbbs|ph\.?d|facs)\.?\b", ""), "[,;]")
    known = lambda on, to: F.broadcast(givens.select(F.col("name").alias(on), F.col("given").alias(to)))
    # givens is a list of bounded size, see given_names
    rows = rows.join(known("f", "f_is"), "f", "left").join(known("l", "l_is"), "l", "left")
    rows = rows.withColumn("bare", bare).drop("name_raw").withColumns({"a": name_words(F.get("bare", F.lit(0))), "b": name_words(F.get("bare", F.lit(1)))}).drop("bare")
    head = F.coalesce(F.get("b", F.lit(0)), F.lit(""))
    # What is used more than once is made a column first, which keeps the generated methods short.
    two = F.col("two")
    rows = rows.withColumn("two", F.coalesce(F.size("b") > 0, F.lit(False)))
    after_first = F.when(two, F.slice("b", 2, F.lit(9))).otherwise(F.slice("a", 2, F.greatest(F.size("a") - 2, F.lit(0))))
    rows = rows.withColumns({
        "first": F.when(two, head).otherwise(F.get("a", F.lit(0))), "final": F.when(F.size("a") > 0, F.element_at("a", -1)), "whole": F.when(two, F.array_join("a", "")), "a_first": F.get("a", F.lit(0)),
        "second": F.coalesce(F.nullif("mi", F.lit("")), F.when(F.size("a") > 0, F.get(after_first, F.lit(0)))),
    }).drop("a", "b", "mi")
    rows = rows.join(known("first", "first_is"), "first", "left").join(known("final", "final_is"), "final", "left")
    rows = rows.withColumns({
        "parsed": F.coalesce((F.length("f") > 0) & (F.length("l") > 0), F.lit(False)),
        "swapped": (F.col("l_is").isNotNull() & F.col("f_is").isNull() & (F.length("f") > 2)) | ((F.length("l") == 1) & (F.length("f") > 1)),
        "behind": ~two & F.col("first_is").isNull() & (F.col("final_is").isNotNull() | (F.length("final") <= 2)) & (F.length("first") > 2),
    })
    parsed, swapped, behind, second = F.col("parsed"), F.col("swapped"), F.col("behind"), F.col("second")
    raw_given = F.when(behind, F.col("final")).otherwise(F.col("first"))
    raw_last = F.when(two, F.col("whole")).when(behind, F.col("a_first")).otherwise(F.col("final"))
    rows = rows.withColumns({"given": F.when(parsed, F.when(swapped, F.col("l")).otherwise(F.col("f"))).otherwise(raw_given), "full": F.when(parsed, F.when(swapped, F.coalesce("l_is", "l")).otherwise(F.coalesce("f_is", "f"))).otherwise(F.when(behind, F.coalesce("final_is", "final")).otherwise(F.coalesce("first_is", "first")))})
    given, full = F.col("given"), F.col("full")
    written = []
    if as_written:
        surname = F.when(parsed, F.when(swapped, F.col("f")).otherwise(F.col("l_raw"))).otherwise(F.coalesce(raw_last, F.col("l_raw")))
        written = [F.nullif(surname, F.lit("")).alias("surname_written"), F.nullif(given, F.lit("")).alias("given_written"), F.nullif(second, F.lit("")).alias("middle_written")]
    return rows.select(
        "source_id", "source", "npi", "zip", "state", *extra,
        F.nullif(F.when(parsed, F.when(swapped, F.col("f")).otherwise(F.col("l"))).otherwise(F.coalesce(raw_last, F.col("l"))), F.lit("")).alias("surname"),
        F.when(F.length(given) > 2, full).alias("given"),
        F.when(parsed, F.when(swapped, F.col("l_is")).otherwise(F.col("f_is"))).otherwise(F.when(behind, F.col("final_is")).otherwise(F.col("first_is"))).alias("known_given"),
        F.nullif(F.substring(full, 1, 1), F.lit("")).alias("initial"),
        F.nullif(F.substring(second, 1, 1), F.lit("")).alias("middle"),
        *written,
        *ids,
    )
