"""Text functions as columns: tokens, normalised keys, extraction of ids and search (OP-T01..T13, T21..T26, J16)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Street words and their short forms; directions likewise.
STREET_WORDS = {
    "AV": "AVE", "AVENUE": "AVE", "AVES": "AVE", "BEACH": "BCH", "BOULEVARD": "BLVD", "COURT": "CT", "DRIVE": "DR", "EXPRESSWAY": "EXPY", "EXPWY": "EXPY", "HIGHWAY": "HWY", "LANE": "LN",
    "PARKWAY": "PKWY", "PLACE": "PL", "PLAZA": "PLZ", "ROAD": "RD", "SAINT": "ST", "SQUARE": "SQ", "STR": "ST", "STREET": "ST", "STREETS": "ST", "TERRACE": "TER", "TURNPIKE": "TPKE",
}
DIRECTIONS = {"EAST": "E", "NORTH": "N", "SOUTH": "S", "WEST": "W"}
# Short forms that end a street's name.
ENDINGS = ("ALY", "AVE", "BLVD", "BRG", "CIR", "CRES", "CT", "DR", "EXPY", "HWY", "LN", "LOOP", "OVAL", "PKWY", "PL", "PLZ", "RD", "ROW", "SQ", "ST", "TER", "TPKE", "WALK", "WAY")


def tokens(text: Column) -> Column:
    """OP-T01: upper-case ASCII words and numbers of more than one character."""
    return F.filter(F.split(F.regexp_replace(F.upper(text), "[^A-Z0-9 ]", " "), " +"), lambda x: F.length(x) > 1)


def distinctive(text: Column, common: Sequence[str]) -> Column:
    """OP-T02: distinct tokens but for common ones."""
    return F.array_except(tokens(text), F.array(*map(F.lit, common)))


def street(text: Column) -> Column:
    """OP-T03: one form of a street name: capitals, short words, numbers without their ordinal endings.

    TH and ND only ever end an ordinal. ST and RD do so after the numbers that take them (21ST, 43RD, not 11ST or 3ST); after others they
    are the word for street or road. '41st Avenue' -> '41 AVE', 'North 8st' -> 'N 8 ST'.
    """
    words = F.filter(F.split(F.regexp_replace(F.upper(text), r"[^A-Z0-9]+", " "), " "), lambda w: w != "")
    short = F.create_map(*(F.lit(x) for kv in (STREET_WORDS | DIRECTIONS).items() for x in kv))
    ordinal = lambda w: F.regexp_replace(w, r"^(\d+)(?:ND|TH)$|^(\d*(?<!1)1)ST$|^(\d*(?<!1)3)RD$", "$1$2$3")
    apart = lambda w: F.regexp_replace(ordinal(w), r"^(\d+)(ST|RD)$", "$1 $2")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), apart(w))), " ")


def street_base(name: Column) -> Column:
    """OP-T03: a street in one form without its last word, where that is one that ends names and not all of it."""
    return F.regexp_replace(name, rf"(?<=\S) (?:{'|'.join(ENDINGS)})$", "")


def after_house_number(title: Column, words: Column) -> Column:
    """OP-T12: does a house number stand before one of the words, with at most two words between? Then it names a street there."""
    at = F.upper(title)
    return F.exists(words, lambda w: F.rlike(at, F.concat(F.lit(r"\b\d+[A-Z]?\s+(?:[A-Z]+\s+){0,2}"), w, F.lit(r"\b"))))


# Fixed value: the pattern of an agency's prefix before a title: 'DPKS - Sorrel Street Playground'.
AGENCY_PREFIX = r"^\s*([A-Z]{2,6})\s*[-:]\s"


def lead_word(title: Column, common: Sequence[str]) -> Column:
    """OP-T13: the first distinctive word of a title after an agency prefix; null if it has none."""
    words = tokens(F.regexp_replace(F.upper(title), AGENCY_PREFIX, ""))
    return F.get(F.filter(words, lambda w: ~w.isin(*common)), F.lit(0))


def admitted(words: Column, least: int = 5) -> Column:
    """OP-H11: may a name with these distinctive words be looked up? Only with enough letters, and not by numbers alone."""
    size = F.aggregate(F.transform(words, lambda w: F.length(w)), F.lit(0), lambda a, x: a + x)
    return (F.size(words) > 0) & (size >= least) & ~F.forall(words, lambda w: w.rlike(r"^\d+$"))


# Ordinal words and their numbers.
ORDINALS = {"FIRST": "1", "SECOND": "2", "THIRD": "3", "FOURTH": "4", "FIFTH": "5", "SIXTH": "6", "SEVENTH": "7", "EIGHTH": "8", "NINTH": "9", "TENTH": "10"}


def spelled_street(text: Column) -> Column:
    """OP-H01: a street form of glued and spelled-out names: letters and numbers are parted ('E41' -> 'E 41'), ordinal words become
    numbers, and the rest goes as in `street`."""
    parted = F.regexp_replace(F.upper(text), r"(?<=[A-Z])(?=\d)", " ")
    words = F.split(F.regexp_replace(parted, r"[^A-Z0-9]+", " "), " ")
    number = F.create_map(*(F.lit(x) for kv in ORDINALS.items() for x in kv))
    return street(F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(number, w), w)), " "))


def named_number(text: Column) -> Column:
    """OP-T16: struct(prefix, number, words) of a name such as 'P.S. 12 - Weir Annex': letters before a number, the number without
    leading zeros, and the words after it."""
    flat = F.regexp_replace(F.upper(text), r"[^A-Z0-9 ]+", "")
    part = lambda i: F.regexp_extract(flat, r"^\s*([A-Z]{1,6})\s*0*(\d{1,4})\b\s*(.*)$", i)
    return F.struct(F.nullif(part(1), F.lit("")).alias("prefix"), F.nullif(part(2), F.lit("")).cast("int").alias("number"), tokens(part(3)).alias("words"))


def word_subset(part: Column, whole: Column) -> Column:
    """OP-T16: are all words of one name, of which there is at least one, among those of another?"""
    return (F.size(part) > 0) & (F.size(F.array_except(part, whole)) == 0)


def fragments(text: Column) -> Column:
    """OP-T23: 'p2: a | p3: b' -> array of struct(page, quote); pieces without a page have a null page."""
    piece = lambda x: F.struct(F.nullif(F.regexp_extract(x, r"^\s*p(\d+):", 1), F.lit("")).cast("int").alias("page"), F.trim(F.regexp_replace(x, r"^\s*p\d+:", "")).alias("quote"))
    return F.filter(F.transform(F.split(text, r"\|"), piece), lambda x: x["quote"] != "")


def letters_key(text: Column) -> Column:
    """OP-T05, T22: the letters only, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    """OP-T08, T09, T23: all matches in order, each once; no array for null."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def sorted_ids(text: Column, separator: str = ",") -> Column:
    """OP-T11: a list of ids in a text, trimmed, without empty and NULL ones, sorted, each once."""
    parts = F.transform(F.split(text, separator), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: (x != "") & (F.upper(x) != "NULL"))))


def contained(titles: DataFrame, key: str, title: str, places: DataFrame, place_id: str, name: str, common: Sequence[str]) -> DataFrame:
    """OP-J16: rows (key, place_id, n): places all of whose distinctive tokens are among those of the title.

    Each place is looked up under its rarest token only, so that common tokens gather few candidates; the rest of its tokens is
    then checked on the pair. Places without a distinctive token match nothing.
    """
    listed = places.select(F.col(place_id), F.array_sort(distinctive(F.col(name), common)).alias("_p")).where(F.size("_p") > 0)
    words = titles.select(F.col(key), distinctive(F.col(title), common).alias("_t"))
    spread = words.select(F.col(key), "_t", F.explode("_t").alias("_w"))
    seen = spread.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    each = listed.select(place_id, "_p", F.explode("_p").alias("_w")).join(seen, "_w", "left")
    rarest = each.groupBy(place_id, "_p").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)), F.col("_w"))).alias("_m")).select(place_id, "_p", F.col("_m._w").alias("_w"))
    pairs = spread.join(rarest, "_w").where(F.size(F.array_except("_p", "_t")) == 0)
    return pairs.select(key, place_id, F.size("_p").alias("n")).distinct()


def _likeness(word: str, near: int) -> Callable[[Column], Column]:
    def like(t: Column) -> Column:
        close = F.levenshtein(t, F.lit(word)) <= near if near else F.lit(False)
        return F.when(t == word, 1.0).when(F.startswith(t, F.lit(word)), 0.75).when(close, 0.5).otherwise(0.0)

    return like


def search(df: DataFrame, key: str, fields: dict[str, tuple[Column, float]], query: str, fuzzy: float = 0.15) -> DataFrame:
    """OP-T25: rows (key, score) that match every word of the query, by prefix or within `fuzzy` of its length in edits.

    fields: name -> (text, boost). A word's score is the sum over fields of boost times 1 for an equal, 0.75 for a prefix and 0.5 for
    a near token, the best token of a field counting.
    """
    words = [w for w in query.upper().replace("-", " ").split() if len(w) > 1]
    scores = []
    for w in words:
        near = int(fuzzy * len(w) + 0.5)
        scores.append(sum((F.coalesce(F.array_max(F.transform(tokens(text), _likeness(w, near))), F.lit(0.0)) * boost for text, boost in fields.values()), F.lit(0.0)))
    rows = df.select(F.col(key), F.array(*scores).alias("_s"))
    return rows.where(F.forall("_s", lambda x: x > 0)).select(key, F.aggregate("_s", F.lit(0.0), lambda a, x: a + x).alias("score"))


def unambiguous(candidates: DataFrame, key: str, score: Sequence[Column], far: Column, most: float) -> DataFrame:
    """OP-T14: the best candidate of each key, none where an equally good one lies farther than `most` from it.

    far is the distance of a candidate to the best one, an expression over its columns and those of the struct `best`.
    """
    named = [c.alias(f"_s{i}") for i, c in enumerate(score)]
    scored = candidates.select("*", *named)
    best = scored.groupBy(key).agg(F.max(F.struct(*(f"_s{i}" for i in range(len(score))), *candidates.columns)).alias("best"))
    ties = scored.join(best, key)
    for i in range(len(score)):
        ties = ties.where(F.col(f"_s{i}").eqNullSafe(F.col(f"best._s{i}")))
    farthest = ties.groupBy("best").agg(F.max(far).alias("_far")).where(F.col("_far") <= most)
    return farthest.select(*(F.col(f"best.{c}").alias(c) for c in candidates.columns))
