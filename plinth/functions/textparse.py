"""Parsers of free text as pandas functions over Arrow batches: what column expressions cannot say (OP-T07, T10, T17, T19, T20, S19)."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KIND = r"(?:STREET|ST|AVENUE|AVE|AV|ROAD|RD|PLACE|PL|LANE|LN|COURT|CT|TERRACE|TER|BOULEVARD|BLVD|DRIVE|DR|PARKWAY|PKWY|ROW|SQUARE|SQ)"
#: House numbers and street words end where no Latin letter or digit follows, so that they are found inside texts without blanks too.
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9_])(\d{{1,5}}(?:-\d{{1,3}})?)\s+((?:[A-Z0-9][\w'.-]*\s+){{1,3}}?{_KIND})(?![A-Za-z0-9_])\.?", re.I)
# The long form of each street word.
_LONG = {"ST": "STREET", "AVE": "AVENUE", "AV": "AVENUE", "RD": "ROAD", "PL": "PLACE", "LN": "LANE", "CT": "COURT", "TER": "TERRACE", "BLVD": "BOULEVARD", "DR": "DRIVE", "PKWY": "PARKWAY", "SQ": "SQUARE"}
#: Words that show that a number before a street word is prose.
_PROSE = {"OF", "THE", "AND", "ON", "TO", "IN", "FOR", "MONTHS", "WEEKS", "DAYS", "PERCENT", "YEARS", "FEET", "BLOCKS"}


def addresses_of(text: str | None, most: int = 3) -> list[str]:
    """OP-T07: house number and street, in capitals with the long street word; at most `most`, each once, in text order."""
    found: list[str] = []
    for number, street in _ADDRESS.findall(text or ""):
        words = street.upper().replace(".", "").split()
        if _PROSE & set(words):
            continue
        words[-1] = _LONG.get(words[-1], words[-1])
        if (a := f"{number} {' '.join(words)}") not in found:
            found.append(a)
    return found[:most]


def unit_head(kinds: dict[str, str]) -> str:
    """The pattern before the first number of units_of, in capitals."""
    words = "|".join(sorted(map(re.escape, kinds), key=len, reverse=True))
    return rf"({words})(?:S|ES)?\.?\s*(?:NO\.?|#)?\s*"


def may_name_units(text: Column, kinds: dict[str, str]) -> Column:
    """True for every text in which units_of finds a unit, and for few others: its head and a digit, in the JVM."""
    return F.upper(text).rlike("(?U)" + unit_head(kinds).replace(r"\s", r"[\s\x1c-\x1f]") + r"\d")


def units_of(text: str | None, kinds: dict[str, str]) -> list[tuple[str, int]]:
    """OP-T10: numbered units (kind, number) in text order, lists and ranges of any width spread: 'Engines 5, 7 & 9' -> three units.

    kinds: word or abbreviation, without plural -> kind.
    """
    found: dict[tuple[str, int], None] = {}
    for m in re.finditer(rf"\b{unit_head(kinds)}(\d{{1,4}}(?:\s*(?:,\s*(?:AND\s+)?|&|AND|/|-|TO|THROUGH)\s*#?\d{{1,4}})*)\b", (text or "").upper()):
        kind = kinds[m[1]]
        last = None
        for joint, number in re.findall(r"(^|-|TO|THROUGH|[,&/]|AND)\s*(?:AND\s+)?#?(\d{1,4})", m[2]):
            n = int(number)
            spread = range(last + 1, n + 1) if joint in ("-", "TO", "THROUGH") and last is not None and last < n else (n,)
            found.update(((kind, x), None) for x in spread)
            last = n
    return list(found)


_EXTENT = re.compile(r"\b(?:IN|ON|ALONG|OF|FOR)?\s*((?:[A-Z0-9][\w'.]*\s+){1,4}?" + _KIND + r")\.?\s*[,:(]?\s*(?:FROM|BETWEEN|BTWN|BET)\.?\s+(.+?)\s+(?:TO|AND|&|-)\s+(.+?)(?=[.,;)]|\s+(?:IN|FOR|WITH|ON)\s|$)", re.I)
_LEAD = {"IN", "ON", "ALONG", "OF", "FOR", "AT", "WM", "SEWER", "SEWERS", "MAIN", "MAINS", "REPAIR", "PAVING"}


def extents_of(text: str | None) -> list[tuple[str, str, str]]:
    """OP-T19: stretches 'X from A to B' or 'X between A and B' as (street, from, to), in capitals."""
    out = []
    for street, a, b in _EXTENT.findall((text or "").upper()):
        words = street.split()
        for i, w in enumerate(words[:-2]):
            if w in _LEAD:
                words = words[i + 1 :] if all(x not in _LEAD for x in words[i + 1 :]) else words
        kind = words[-1]
        ends = []
        for e in (a, b):
            e = e.strip(" .,")
            if not re.search(rf"\b{_KIND}$", e) and re.search(rf"\b{_KIND}$", (b if e == a.strip(" .,") else a).strip(" .,")):
                e = f"{e} {(b if e == a.strip(' .,') else a).strip(' .,').split()[-1]}"  # 5 and 7 AV share the last word
            ends.append(e)
        out.append((" ".join([*words[:-1], kind]), ends[0], ends[1]))
    return out


def stretch_of(text: str | None, stations: list[str]) -> list[str]:
    """OP-T20: stations that a title names: a stretch 'A to B' gives all between in line order, names by themselves themselves."""
    plain = lambda s: re.sub(r"[^A-Z0-9]+", " ", s.upper()).strip()
    t, names = f" {plain(text or '')} ", [plain(s) for s in stations]
    at = sorted((t.index(f" {n} "), i) for i, n in enumerate(names) if n and f" {n} " in t)
    for (pa, a), (pb, b) in zip(at, at[1:], strict=False):
        if re.fullmatch(r"\s*(TO|THROUGH|THRU)\s*", t[pa + len(names[a]) + 1 : pb + 1]):
            return stations[min(a, b) : max(a, b) + 1]
    return [stations[i] for i in sorted(i for _, i in at)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def addresses(text: pd.Series) -> pd.Series:
    """OP-T07 as a column."""
    return text.map(addresses_of)


def units(kinds: dict[str, str]):
    """OP-T10 as a column of array<struct<kind, number>>."""
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("number", T.IntegerType())]))

    @F.pandas_udf(kind)
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"kind": k, "number": n} for k, n in units_of(t, kinds)])

    return run


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("street", "a", "b")])))
def extents(text: pd.Series) -> pd.Series:
    """OP-T19 as a column."""
    return text.map(lambda t: [dict(zip(("street", "a", "b"), x, strict=True)) for x in extents_of(t)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def stretches(text: pd.Series, stations: pd.Series) -> pd.Series:
    """OP-T20 as a column: the places, from 0, of the stations that a title names on a line given by its stations in order."""
    return pd.Series([[names.index(x) for x in stretch_of(t, names)] for t, names in zip(text, map(list, stations), strict=True)])


def named_parts(titles: DataFrame, key: str, title: Column, parts: DataFrame, part_id: str, name: Column, not_before: Sequence[str] = ()) -> DataFrame:
    """OP-T17: rows (key, part_id): places whose name stands in the title as whole words, without those inside a longer name found.

    Names are looked up by their words: a title's runs of as many words as some name has meet the names by an equi join. A name of
    which some occurrence stands before a word of not_before ('Gravesend Bay') names another thing and does not count, unless it
    ends with PARK.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))
    words = F.split(plain(title), " ")
    listed = parts.select(F.col(part_id), plain(name).alias("run")).where("run != ''")
    sizes = sorted(r.n for r in listed.select(F.size(F.split("run", " ")).alias("n")).distinct().collect())
    lengths = F.array(*map(F.lit, sizes)).cast("array<int>")
    runs = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - n, F.lit(0))), lambda i: F.struct(i.alias("i"), n.alias("n"), F.array_join(F.slice("_w", i + 1, n), " ").alias("run"), F.get("_w", i + n).alias("after")))))
    spread = titles.select(F.col(key), words.alias("_w")).select(key, F.size("_w").alias("_s"), F.explode(runs).alias("r")).where("r.i + r.n <= _s").select(key, "r.*")
    hits = spread.join(listed, "run")
    if not_before:
        other = F.coalesce(F.col("after").isin(*(x.upper() for x in not_before)), F.lit(False)) & ~F.endswith("run", F.lit(" PARK"))
        hits = hits.withColumn("_other", F.max(other).over(Window.partitionBy(key, "run"))).where(~F.col("_other"))
    w = Window.partitionBy(key)
    spans = hits.withColumn("_all", F.collect_set(F.struct("i", "n")).over(w))  # a title has few names
    inner = F.exists("_all", lambda x: (x["i"] <= F.col("i")) & (x["i"] + x["n"] >= F.col("i") + F.col("n")) & (x["n"] > F.col("n")))
    return spans.where(~inner).select(key, part_id).distinct()


def labelled_records(lines: DataFrame, document: str, order: str, text: str, label: str) -> DataFrame:
    """OP-S19, W06: lines of documents -> rows (document, label_no, label, lines): each line under the last label line before it.

    label: a pattern with one group that a label line matches.
    """
    hit = F.regexp_extract(F.col(text), label, 1)
    w = Window.partitionBy(document).orderBy(order)
    marked = lines.withColumn("_l", F.when(hit != "", hit)).withColumn("label_no", F.count("_l").over(w)).withColumn("label", F.last("_l", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = marked.where(F.col("_l").isNull() & F.col("label").isNotNull())
    return kept.groupBy(document, "label_no", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("lines"))
