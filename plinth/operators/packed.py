"""Several values packed in one field: dictionary-guided segmentation.

A multi-pattern automaton (Aho-Corasick) finds every separator and every known whole value of a field in one pass. Over
the positions found, dynamic programming picks the cover of the field with the least cost: a known or quoted value costs
1, any other stretch between separators 3, so that a known value that holds a separator stays whole, and a stretch is cut
at every separator otherwise. Quotes protect what they enclose. The dictionary is learned from the fields themselves: what stands
in quotes somewhere and holds a separator is one value, so it stays whole where another row leaves the quotes out.

Defined results: a null field and a field of separators, blanks and quotes only give no items; an unclosed quote is an
ordinary character; repeated items stay, with their own positions; the length of a field is not limited. Only fields that
hold a separator, a quote or a bracket reach Python, and each distinct field of an Arrow batch is cut once. A dictionary of up to
DICTIONARY_BYTES goes to the workers as one automaton; a larger one is taken in parts of that size, each of which reports where its
values stand in the distinct fields, so no worker holds more and no value is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.session import cut as written

#: Opening quotes with their closing ones, and brackets that enclose a whole field.
QUOTES = {'"': '"', "“": "”"}
BRACKETS = {"[": "]", "{": "}"}
KNOWN, UNKNOWN = 1, 3
#: The text of known values that one automaton holds.
DICTIONARY_BYTES = 32 << 20


@dataclass(frozen=True)
class Packing:
    """How a field packs values. symbols separate wherever they stand; words only with white space around them."""

    symbols: tuple[str, ...] = (";", ",", "|", "\t", "\n", "\r")
    words: tuple[str, ...] = ()
    known: frozenset[str] = field(default_factory=frozenset)

    def touched(self, col: Column) -> Column:
        """True where a field can be anything but one plain value; evaluated in the JVM."""
        marks = "".join(re.escape(x) for x in [*self.symbols, *QUOTES, *QUOTES.values(), *BRACKETS])
        words = "".join(rf"|\s{re.escape(w)}\s" for w in self.words)
        return col.rlike(f"[{marks}]{words}")


class Segmenter:
    """Cuts one field at a time; built once per Python worker and Arrow stream."""

    def __init__(self, packing: Packing):
        import ahocorasick

        self.packing = packing
        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, tuple[bool, bool]] = {}
        for s in packing.symbols:
            kinds[s] = (True, False)
        for w in packing.words:
            for a in " \t\n":
                for b in " \t\n":
                    kinds[a + w + b] = (True, False)
        for v in packing.known:
            kinds[v] = (kinds.get(v, (False, False))[0], True)
        for text, (separates, known) in kinds.items():
            self.automaton.add_word(text, (len(text), separates, known))
        if kinds:
            self.automaton.make_automaton()

    def found(self, text: str | None) -> list[tuple[int, int]]:
        """Where known values stand in a field outside quotes: (start, end)."""
        text = self._bare(text or "")
        inside = self._quoted(text)
        hits = self.automaton.iter(text) if len(self.automaton) and text else ()
        return [(end + 1 - size, end + 1) for end, (size, _, known) in hits if known and not (inside[end + 1 - size] or inside[end])]

    def items(self, text: str | None, found: Iterable[tuple[int, int]] = ()) -> list[str]:
        """The items of a field, in order. found: places of known values that are not in this dictionary."""
        if text is None:
            return []
        text = self._bare(text)
        n = len(text)
        if not n:
            return []
        inside = self._quoted(text)
        cut_at = [0] * (n + 1)  # length of the longest separator that starts here
        values: dict[int, list[int]] = {}
        for a, e in found:
            values.setdefault(a, []).append(e)
        for end, (size, separates, known) in self.automaton.iter(text) if len(self.automaton) else ():
            at = end + 1 - size
            if inside[at] or inside[end]:
                continue
            if separates:
                cut_at[at] = max(cut_at[at], size)
            if known:
                values.setdefault(at, []).append(end + 1)
        nxt = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            nxt[i] = i if cut_at[i] else nxt[i + 1]
        return self._cover(text, cut_at, nxt, values)

    def _bare(self, text: str) -> str:
        text = text.strip()
        while len(text) > 1 and BRACKETS.get(text[0]) == text[-1]:
            text = text[1:-1].strip()
        return text

    def _quoted(self, text: str) -> list[bool]:
        """Per character: is it part of a quoted stretch, quotes included?"""
        inside, i, n = [False] * len(text), 0, len(text)
        while i < n:
            if (close := QUOTES.get(text[i])) is None:
                i += 1
                continue
            j = i + 1
            while j < n:
                if text[j] == "\\" and j + 1 < n:
                    j += 2
                elif text[j] == close:
                    if close == '"' and j + 1 < n and text[j + 1] == '"':
                        j += 2
                    else:
                        break
                else:
                    j += 1
            if j < n:
                inside[i : j + 1] = [True] * (j + 1 - i)
                i = j + 1
            else:
                i += 1
        return inside

    def _cover(self, text: str, cut_at: list[int], nxt: list[int], values: dict[int, list[int]]) -> list[str]:
        """Least-cost cover from every start, from the last to the first; a tie takes the shorter first item."""
        n = len(text)
        starts = [0] + [i + cut_at[i] for i in range(n) if cut_at[i]]
        best: dict[int, tuple[int, int]] = {n: (0, n)}  # start -> (cost, end of its first item)
        resume = lambda e: n if e >= n else e + cut_at[e]
        for s in sorted({x for x in starts if x < n}, reverse=True):
            a = s
            while a < n and text[a].isspace() and not cut_at[a]:
                a += 1
            plain = nxt[s] if nxt[s] >= a else a
            item = self.clean(text[s:plain])
            known = item in self.packing.known or text[s:plain].strip()[:1] in QUOTES
            options = [((0 if not item else KNOWN if known else UNKNOWN) + best[resume(plain)][0], plain)]
            for e in values.get(a, ()):
                z = e
                while z < n and text[z].isspace() and not cut_at[z]:
                    z += 1
                if z > plain and (z == n or cut_at[z]):
                    options.append((KNOWN + best[resume(z)][0], z))
            best[s] = min(options)
        found, s = [], 0
        while s < n:
            e = best[s][1]
            if item := self.clean(text[s:e]):
                found.append(item)
            s = resume(e)
        return found

    @staticmethod
    def clean(item: str) -> str:
        """Trimmed, without quotes or brackets that only enclose; doubled and escaped quotes inside become single ones."""
        item = item.strip()
        while len(item) > 1:
            a, z = item[0], item[-1]
            if QUOTES.get(a) == z:
                body = item[1:-1]
                if a == '"':
                    if '"' in body.replace('""', "").replace('\\"', ""):
                        break
                    if '"' in body:
                        item = body.replace('\\"', '"').replace('""', '"').strip()
                        break  # quotes that were escaped belong to the item
                item = body.strip()
            elif BRACKETS.get(a) == z:
                item = item[1:-1].strip()
            else:
                break
        return "" if item in ('"', "“", "”") else item


def items(df: DataFrame, key: Column, text: Column, packing: Packing, least: int = 1, dictionary: DataFrame | None = None) -> DataFrame:
    """Rows (row_key, pos, item) of every field with at least `least` items; pos counts from 1.

    Fields of one plain value are answered in the JVM; the others go through the segmenter in Arrow batches, without any
    shuffle. Keys may repeat: every row is cut by itself. Further columns of df, of whatever name, do not matter. dictionary: known
    values (v) beside those of the packing, see `learned`.
    """
    schema = "row_key string, pos int, item string"
    rows = df.select(key.cast("string").alias("row_key"), text.alias("text")).where(F.col("text").isNotNull())
    touched = packing.touched(F.col("text"))
    fields = rows.where(touched)
    apart = False
    if dictionary is not None:
        dictionary = written(dictionary)
        size = dictionary.agg(F.sum(F.octet_length("v"))).first()[0] or 0
        parts = -(-size // DICTIONARY_BYTES)
        if parts == 1:
            packing = with_known(packing, [r.v for r in dictionary.collect()])
        elif parts > 1:
            fields, apart = fields.join(_places(fields, dictionary, packing, parts), "text", "left"), True

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = Segmenter(packing)
        for batch in batches:
            codes, texts = pd.factorize(batch["text"])
            found = dict(zip(batch["text"], batch["found"], strict=True)) if apart else {}
            spots = [() if (f := found.get(t)) is None else [(p["a"], p["e"]) for p in f] for t in texts]
            lists = [segmenter.items(t, f) for t, f in zip(texts, spots, strict=True)]
            lists = [x if len(x) >= least else [] for x in lists]
            out = pd.DataFrame({"row_key": batch["row_key"].to_numpy(), "item": [lists[c] for c in codes]})
            out["pos"] = [range(1, len(x) + 1) for x in out["item"]]
            out = out[out["item"].str.len() > 0].explode(["item", "pos"])
            yield out.assign(pos=out["pos"].astype("int32"))[["row_key", "pos", "item"]]

    packed = fields.mapInPandas(cut, schema)
    if least > 1:
        return packed
    trimmed = F.regexp_replace("text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    plain = rows.where(~touched).select("row_key", F.lit(1).alias("pos"), trimmed.alias("item")).where("item != ''")
    return plain.unionByName(packed)


def _places(fields: DataFrame, dictionary: DataFrame, packing: Packing, parts: int) -> DataFrame:
    """Rows (text, found) of the distinct fields in which values of a dictionary of several parts stand."""
    texts = written(fields.select("text").distinct())
    hits = []
    for i in range(parts):  # one part at a time; its hits are written before the next one is read
        part = Packing((), (), frozenset(r.v for r in dictionary.where(F.pmod(F.xxhash64("v"), F.lit(parts)) == i).collect()))

        def find(batches: Iterator[pd.DataFrame], part: Packing = part) -> Iterator[pd.DataFrame]:
            segmenter = Segmenter(part)
            for batch in batches:
                yield pd.DataFrame([(t, a, e) for t in batch["text"] for a, e in segmenter.found(t)], columns=["text", "a", "e"])

        hits.append(written(texts.mapInPandas(find, "text string, a int, e int")))
    every = reduce(DataFrame.unionByName, hits)
    return every.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("a", "e"))).alias("found"))  # as many as a field has places


def learned(df: DataFrame, text: Column, packing: Packing) -> DataFrame:
    """Rows (v) of the dictionary that fields give by themselves: each value that stands in quotes somewhere and holds a separator.

    Fields without both a quote and a separator teach nothing and are left out in the scan; values are taken out in the JVM and
    come together in one distinct.
    """
    marks = "".join(re.escape(x) for x in packing.symbols)
    words = "".join(rf"|\s{re.escape(w)}\s" for w in packing.words)
    quoted = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|""|\\.)*"|“[^”]*”'), F.lit(0))
    rows = df.where(text.rlike('["“]') & text.rlike(f"[{marks}]{words}")).select(F.explode(quoted).alias("q"))
    body = F.trim(F.expr("substring(q, 2, length(q) - 2)"))
    bare = F.when(F.startswith("q", F.lit('"')), F.replace(F.replace(body, F.lit('\\"'), F.lit('"')), F.lit('""'), F.lit('"'))).otherwise(body)
    return rows.select(bare.alias("v")).where(F.col("v").rlike(f"[{marks}]{words}") & F.col("v").rlike(r"[\p{L}\p{N}]")).distinct()


def with_known(packing: Packing, values: Iterable[str]) -> Packing:
    return Packing(packing.symbols, packing.words, packing.known | frozenset(values))


#: Boards hold no separator; slashes, ampersands, plus signs and the word "and" separate them too.
BOARDS = Packing(symbols=(";", ",", "|", "\t", "\n", "\r", "&", "+", "/"), words=("and",))
#: In line labels these belong to the label: " / ", " - ", "@", "(" and ")".
LABELS = Packing()
