import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plinth.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(SF)
    return langid.fit(langid.sample(docs, F.col("text"), F.col("lang")))


def run(spark, model, data):
    df = spark.createDataFrame(data, "doc_id int, text string, lang string, key string, seg_no string")
    got = langid.segments(df, F.col("doc_id"), F.col("text"), F.col("lang"), model)
    return {(r.key, r.seg_no): r.lang_code for r in got.collect()}, sorted((r.key, r.seg_no, r.lang_code) for r in langid.wrong_or_missing(got).collect())


EN, ES, RU, UK = "Nobody has walked the site since 2031.", "Nadie sabe quién debe reparar la bomba de Gorse Lane.", "Никто не знает, кто должен чинить насос на Oxbow Street.", "Ніхто не знає, хто має лагодити насос на Brindle Place."


def test_segments(spark, model):
    texts = {
        1: (EN, "en"), 2: (f"{EN} {ES} {ES}\n{RU}\t{UK}", "en"), 3: (ES.upper(), None), 4: (f'{EN} The sign reads “Obras en la calle” for now. The "Vorsicht Baustelle" board stays up.', "eng"), 5: (ES, "es-MX"), 6: (ES, "English"),
        7: ("居民希望公园改造期间白天不要封路。主 정부 지원이 없으면 승강기 현대화 규모를 줄여야 합니다.", "zh"), 8: ("<p>La agencia aprobo el diseno y pronto buscara un contratista.<br/>Gorse Street.</p>", "spa"), 9: ("🚧🚧 2031", None), 10: ("", "xx"), 11: (None, None), 12: ("--- 0 ---", "en"), 13: (EN, "mul"),
    }
    every, found = run(spark, model, [(k, t, lab, "x", "y") for k, (t, lab) in texts.items()])
    assert found == [(2, 1, "en"), (2, 2, "es"), (2, 3, "ru"), (2, 4, "uk"), (3, 1, "es"), (6, 1, "es"), (7, 1, "zh"), (7, 2, "ko"), (13, 1, "en")]
    assert {k for k, _ in every} == {1, 2, 3, 4, 5, 6, 7, 8, 13}


def test_short_sentences_and_long_quotes(spark, model):
    """One or two words are a sentence of their own if they tell their language; a bare name is none; quotes have no greatest length."""
    de, en = "Das Dach wird in diesem Jahr noch erneuert.", "The roof will be renewed this year."
    quote = " ".join(["Nadie sabe quién debe reparar la bomba"] * 9)
    assert len(quote) > 300
    texts = {1: f"{de} The roof. Die Arbeiten beginnen im Herbst.", 2: f"{en} Las obras. The work begins in autumn.", 3: f"{de} Gorse Street. Die Arbeiten beginnen im Herbst.", 4: f"{en} The sign says “{quote}” and stays.", 5: f'{en} <a title="{quote}">The work</a> begins in autumn.'}
    every, _ = run(spark, model, [(k, t, "en", "", "") for k, t in texts.items()])
    by = lambda k: [every[x] for x in sorted(every) if x[0] == k]
    assert [by(k) for k in texts] == [["de", "en", "de"], ["en", "es", "en"], ["de"], ["en"], ["en"]]


def test_held_out_accuracy(spark):
    """Sentences of half of the documents, by a model of the other half; the labels of the data are right for most documents."""
    docs = spark.read.parquet(SF).where("text is not null")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = langid.fit(langid.sample(docs.where(half == 0), F.col("text"), F.col("lang")))
    rest = [r for r in docs.where(half == 1).select("text", langid.code_of(F.col("lang")).alias("c")).collect() if r.c]
    scorer, agreed, n = langid.Scorer(model), 0, 0
    for r in rest:
        if s := langid.sentences(r.text):
            best = Counter(langid.CODES[i] for i in scorer.posteriors(s).argmax(axis=1)).most_common(1)[0][0]
            agreed, n = agreed + (best == r.c), n + 1
    assert n > 300 and agreed / n > 0.85


def test_wrong_labels_in_the_sample_do_no_harm(model):
    r = random.Random(1)
    rows = [(c, t) for t, c in [(EN, "en"), (ES, "es"), (RU, "ru"), (UK, "uk")] for _ in range(20)]
    rows += [(r.choice(["en", "es"]), t) for t in (RU, UK) for _ in range(5)]
    m = langid.fit(rows)
    assert [langid.CODES[i] for i in langid.Scorer(m).posteriors([langid.sentences(t)[0] for t in (EN, ES, RU, UK)]).argmax(axis=1)] == ["en", "es", "ru", "uk"]


def test_backoff(model):
    assert langid.CODES[model.word("reparaciones").argmax()] in ("es", "pt") and langid.CODES[model.word("größenverhältnis").argmax()] == "de"
    assert model.word("க").tolist() == [0.0] * len(langid.CODES)


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "en-US": "en", "en_GB": "en", "eng": "en", "English": "en", " Spanish ": "es", "es_419": "es", "zh-CN": "zh", "UK": "uk", "und": None, "mul": None, "xx": None, "??": None, "": None, None: None, "n/a": None}
    df = spark.createDataFrame([(k,) for k in cases], "lang string")
    assert {r.lang: r.c for r in df.select("lang", langid.code_of(F.col("lang")).alias("c")).collect()} == cases


def test_no_model_and_long_text(spark, model):
    empty = spark.createDataFrame([], "doc_id int, text string, lang string")
    assert langid.fit(langid.sample(empty, F.col("text"), F.col("lang"))) is None
    assert langid.segments(empty, F.col("doc_id"), F.col("text"), F.col("lang"), None).count() == 0
    every, _ = run(spark, model, [(1, f"{EN} " * 20_000 + ES, "en", "", ""), (1, EN, "en", "", "")])
    assert every[1, 2] == "es"
