"""Column expressions shared by the operators on typed values and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and their plain forms, position by position.
MARKED = "àáâãäåāăąçćčďèéêëēėęěğìíîïīįıłñńňòóôõöøōőŕřśšşťùúûüūůűųýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeegiiiiiiilnnnoooooooorrssstuuuuuuuuyyzzz"


def blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return c.isNull() | ~c.rlike(r"\S")


def plain(c: Column) -> Column:
    """Lower case without accents; ß becomes ss and æ, œ two letters. ASCII is spared the look-ups."""

    def of(low: Column) -> Column:
        full = F.translate(low, MARKED, PLAIN)
        full = F.replace(F.replace(F.replace(full, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
        return F.when(low.rlike(r"[^\x00-\x7F]"), full).otherwise(low)

    # The lambda binds the lower-case text, so it is made once for all three uses.
    return F.get(F.transform(F.array(F.lower(c)), of), F.lit(0))


def squeezed(c: Column) -> Column:
    """plain() with everything but a-z and 0-9 removed."""
    return F.regexp_replace(plain(c), "[^a-z0-9]+", "")


def words_of(c: Column) -> Column:
    """Lower-case words of a typed value.

    Words run together are cut where a lower-case letter meets an upper-case
    one ("HandSurgery"), except in values that open in lower case and go on in
    upper case throughout ("hAND sURGERY"); dots inside initials and apostrophes
    vanish ("E.N.T." is one word, "women's" is "womens").
    """
    cut = F.when(c.rlike(r"^\s*\p{Ll}\p{Lu}"), c).otherwise(F.regexp_replace(c, r"(\p{Ll}s?)(?=\p{Lu}\p{Ll})", "$1 "))
    low = F.translate(plain(cut), "'’`", "")
    low = F.regexp_replace(low, r"(?<=\b[a-z])\.(?=[a-z]\b)", "")
    return F.filter(F.split(F.regexp_replace(low, "[^a-z0-9]+", " "), " "), lambda w: w != "")
