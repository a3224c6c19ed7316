"""Missing or wrong language labels: word-first backoff.

A model of each language is counted from labelled documents: the logarithm of the share of every word among the words of the
language. A sentence is scored word by word. A word that some language knows adds its log shares; an unseen word falls back to
the longest of its character n-grams that the model knows, and in the end to single characters. Sentences of one language in a
row make a segment; its confidence is the mean posterior of its language, weighted by words.

The model is fitted on a bounded sample of labelled rows (ROWS_PER_LANGUAGE, spread by a hash of the text over all rows), so its
size is bounded. Labels in the sample may be wrong, so sentences are first relabelled by what most rows say about their words, and
then REFITS times by the model itself. Every document is scored in whole.

Defined results: null, empty, blank and wordless texts have no segment; markup is not text; a quoted phrase inside a sentence, of
whatever length, goes with it, and a sentence that does not tell its language by itself (a bare street name) with the one before; a tie goes to the first code in
alphabetical order; without any labelled row there is no model and so no segment; repeated documents are each answered.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The languages in use, with their other notations (ISO 639-2 codes, English and own names).
NOTATIONS = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castilian"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "it": ("it", "ita", "italian", "italiano"),
    "ko": ("ko", "kor", "korean", "한국어"),
    "pl": ("pl", "pol", "polish", "polski"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ru": ("ru", "rus", "russian", "русский"),
    "uk": ("uk", "ukr", "ukrainian", "українська"),
    "zh": ("zh", "zho", "chi", "chinese", "cmn", "mandarin", "中文"),
}
CODES = tuple(NOTATIONS)

# Common words of each language, counted SEED times beside the sample, so that a small sample does not go astray.
COMMON = {
    "de": "der die das und ist nicht von zu den mit für auf wird noch",
    "en": "the of and to in is for that with was on will by has",
    "es": "el los las de que y en por para con no se del más",
    "fr": "le les des de et en du est pour que dans sur au pas",
    "it": "il gli di e in per che con non del della è sono più",
    "ko": "있습니다 않습니다 입니다 합니다 됩니다",
    "pl": "i w na z do nie się jest że przy już oraz zostaną na",
    "pt": "o os as de que e em do da para com não foi mais",
    "ru": "и в на не что с для из это был как уже или во",
    "uk": "і в на не що з для із це був як вже або та",
    "zh": "的 了 在 是 和 有 不 为 将 这",
}
SEED = 3

ROWS_PER_LANGUAGE, LONGEST_SAMPLE, REFITS = 1500, 20_000, 1
GRAMS = (4, 3, 2, 1)
#: A sentence tells its language by itself where that is at least so likely; bare names and numbers do not.
CLEAR = 0.4
#: The weight of the background in a language's shares, of an unseen word, and of a word's form without accents; the least share of a
#: word's rows that a label counts for when the sample is cleaned, and how far its overall share is taken off there.
BACKGROUND, GRAM_WEIGHT, BARE_WEIGHT, LEAST_SHARE, LIFT = 1e-3, 0.5, 0.2, 0.02, 0.5
REMEMBERED = 300_000

_MARKUP = re.compile(r"<[^<>]+>|\[(?:PAD|CLS|SEP|UNK|MASK)\]")
_BREAK = re.compile(r"<(?:br|p|/p|div|/div|li|/li|tr|/tr|h\d|/h\d)\b[^<>]*>", re.I)
_QUOTED = re.compile(r"“[^”\n]+”|«[^»\n]+»|„[^“”\n]+[“”]|(?<!\w)\"[^\"\n]+\"(?!\w)")
_END = re.compile(r"[.!?…]+[\"'”»)\]]*(?=\s|$)|[。！？]+[”」』）]*|[\n\r\t\v\f\u2028\u2029]+")
_WORD = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]|[^\W\d_\u3400-\u9fff\uf900-\ufaff]+")


def code_of(label: Column) -> Column:
    """The code that a label names in any notation, a region aside; null for none of the languages in use."""
    base = F.lower(F.regexp_extract(F.trim(label), r"^([\p{L}]+)(?:[-_][\p{L}\p{N}]+)*$", 1))
    names = F.create_map(*(F.lit(x) for code, ns in NOTATIONS.items() for n in ns for x in (n, code)))
    return F.try_element_at(names, base)


def sentences(text: str | None) -> list[list[str]]:
    """The words of each whole sentence, quoted phrases left out, in text order; only sentences with words."""
    if not text:
        return []
    text = html.unescape(_MARKUP.sub(" ", _BREAK.sub("\n", text)))
    text = unicodedata.normalize("NFKC", text).replace("\u200b", "").replace("\ufeff", "")
    bare = _QUOTED.sub(" ", text)
    found = [w for part in _END.split(bare) if (w := _WORD.findall(part.casefold()))]
    return found or [w for part in _END.split(text) if (w := _WORD.findall(part.casefold()))]


def bare(word: str) -> str:
    """The word without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


class Model:
    """Log shares of words and of character n-grams by language."""

    def __init__(self, words: list[Counter]):
        self.words = self._table(words)
        self.grams = {}
        for n in GRAMS:
            counts: list[Counter] = [Counter() for _ in CODES]
            for k, c in enumerate(words):
                for w, x in c.items():
                    for g in _grams(w, n):
                        counts[k][g] += x
            self.grams[n] = self._table(counts)

    @staticmethod
    def _table(counts: list[Counter]) -> dict[str, np.ndarray]:
        """Log shares, smoothed by a common background, so that a small language gains nothing from what it has not seen."""
        every = sorted(set().union(*counts))
        n = np.array([[c.get(w, 0) for c in counts] for w in every], float).reshape(-1, len(CODES))
        shares = n / np.maximum(n.sum(axis=0), 1e-9)
        logs = np.log(shares + BACKGROUND * shares.mean(axis=1, keepdims=True))
        return dict(zip(every, logs.astype(np.float32), strict=True))

    def word(self, w: str) -> np.ndarray:
        """The scores of one word: its own, else those of its form without accents, else of its longest known n-grams."""
        if (s := self.words.get(w)) is not None or (s := self.words.get(bare(w))) is not None:
            return s
        for n in GRAMS:
            known = [s for g in _grams(w, n) if (s := self.grams[n].get(g)) is not None]
            if known:
                mean = np.mean(known, axis=0)
                return (mean * GRAM_WEIGHT).astype(np.float32)
        return np.zeros(len(CODES), np.float32)


class Scorer:
    """A model with the words that a Python worker has met, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.at, self.rows = model, {}, []

    def posteriors(self, lists: list[list[str]]) -> np.ndarray:
        """One row per sentence: the probability of each language."""
        if not lists:
            return np.empty((0, len(CODES)))
        if len(self.at) > REMEMBERED:
            self.at, self.rows = {}, []
        codes = []
        for words in lists:
            for w in words:
                if (k := self.at.get(w)) is None:
                    k = self.at[w] = len(self.rows)
                    self.rows.append(self.model.word(w))
                codes.append(k)
        sizes = np.array([len(x) for x in lists])
        scores = np.array(self.rows)[codes].astype(float)
        sums = np.add.reduceat(scores, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        sums -= sums.max(axis=1, keepdims=True)
        p = np.exp(sums)
        return p / p.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """A model from (code, text) rows, whose codes may be wrong at times."""
    lists, owner = [], []
    for code, text in rows:
        for words in sentences(text):
            lists.append(words)
            owner.append(CODES.index(code))
    if not lists:
        return None
    owner = _cleaned(lists, owner)
    model = Model(_counted(lists, owner))
    for _ in range(REFITS):
        labels = Scorer(model).posteriors(lists).argmax(axis=1)
        model = Model(_counted(lists, labels.tolist()))
    return model


def _cleaned(lists: list[list[str]], owner: list[int]) -> list[int]:
    """The labels of sentences by what most rows say about their words. Wrong labels are spread over the languages, so they outweigh
    the right ones of a small language, but never those of the language that the words belong to."""
    at: dict[str, int] = {}
    codes = [at.setdefault(w, len(at)) for words in lists for w in words]
    sizes = [len(x) for x in lists]
    seeds = [(w, k) for k, c in enumerate(CODES) for w in COMMON[c].split() for _ in range(SEED)]
    every = [*codes, *(at.setdefault(w, len(at)) for w, _ in seeds)]
    n = np.zeros((len(at), len(CODES)))
    np.add.at(n, (every, [*np.repeat(owner, sizes), *(k for _, k in seeds)]), 1)
    grams: dict[str, int] = {}
    pairs = [(i, grams.setdefault(g, len(grams))) for w, i in at.items() for g in _grams(w, 3)]
    of, g = np.array(pairs, int).reshape(-1, 2).T
    m = np.zeros((len(grams), len(CODES)))
    np.add.at(m, g, n[of])
    # Half the lift: a common label is a common wrong label too.
    base = LIFT * np.log(n.sum(axis=0) / n.sum() + 1e-6)
    share = lambda x: np.log(x / x.sum(axis=1, keepdims=True) + LEAST_SHARE) - base
    by_gram = np.zeros_like(n)
    np.add.at(by_gram, of, share(m)[g])
    logs = share(n) + by_gram / np.maximum(np.bincount(of, minlength=len(at)), 1)[:, None]
    return np.add.reduceat(logs[codes], np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int), axis=0).argmax(axis=1).tolist()


def _grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counted(lists: list[list[str]], owner: list[int]) -> list[Counter]:
    counts: list[Counter] = [Counter({w: SEED for w in COMMON[c].split()}) for c in CODES]
    for words, k in zip(lists, owner, strict=True):
        counts[k].update(words)
    for c in counts:
        for w, n in list(c.items()):
            if (b := bare(w)) != w:
                c[b] += n * BARE_WEIGHT
    return counts


def sample(df: DataFrame, text: Column, label: Column, per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """About per_language labelled rows of each language, or all of them if they are fewer, spread over the whole table by a hash of the
    text; copies of a text count once."""
    rows = df.select(code_of(label).alias("code"), text.alias("text")).where((F.length("text") > 0) & (F.length("text") <= LONGEST_SAMPLE) & F.col("code").isNotNull())
    counts = {r.code: r["count"] for r in rows.groupBy("code").count().collect()}
    if not counts:
        return []
    shares = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, int(min(1.0, per_language / n) * (1 << 30)))))
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < shares[F.col("code")]).distinct()
    return [(r.code, r.text) for r in picked.collect()]


def segments(df: DataFrame, key: Column, text: Column, label: Column, model: Model | None) -> DataFrame:
    """Rows (key, label_code, seg_no, lang_code, n_words, confidence, n_langs): the segments of every document with words."""
    schema = f"key {df.select(key.alias('key')).schema[0].dataType.simpleString()}, label_code string, seg_no int, lang_code string, n_words int, confidence double, n_langs int"
    rows = df.select(key.alias("key"), code_of(label).alias("label_code"), text.alias("text")).where(F.length("text") > 0)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            lists, ends = [], []
            for t in batch["text"]:
                lists.extend(sentences(t))
                ends.append(len(lists))
            p = scorer.posteriors(lists)
            sizes = [len(x) for x in lists]
            out, start = [], 0
            for k, lab, end in zip(batch["key"], batch["label_code"], ends, strict=True):
                parts = runs(p[start:end], sizes[start:end])
                langs = len({c for c, _, _ in parts})
                out.extend((k, lab, i, CODES[c], n, conf, langs) for i, (c, n, conf) in enumerate(parts, 1))
                start = end
            yield pd.DataFrame(out, columns=["key", "label_code", "seg_no", "lang_code", "n_words", "confidence", "n_langs"])

    return rows.mapInPandas(run, schema)


def runs(p: np.ndarray, sizes: list[int]) -> list[tuple[int, int, float]]:
    """(language, words, confidence) of the longest runs of sentences in one language. A sentence that is not clear by itself, of
    however many words, goes with the sentence before, or with the first clear one; if none is clear, all count as they are."""
    best = p.argmax(axis=1).tolist() if len(p) else []
    clear = (p.max(axis=1) >= CLEAR).tolist() if len(p) else []
    if any(clear):
        now = best[clear.index(True)]
        for i, sure in enumerate(clear):
            now = best[i] = best[i] if sure else now
    found: list[list] = []
    for i, (c, n) in enumerate(zip(best, sizes, strict=True)):
        if not found or found[-1][0] != c:
            found.append([c, 0, 0.0])
        found[-1][1] += n
        found[-1][2] += n * float(p[i, c])
    return [(c, n, s / n) for c, n, s in found]


def wrong_or_missing(found: DataFrame) -> DataFrame:
    """Segments of documents whose label is missing or says nothing, names another language, or that are in several languages."""
    return found.where(F.col("label_code").isNull() | (F.col("n_langs") > 1) | (F.col("label_code") != F.col("lang_code")))
