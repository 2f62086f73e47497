"""Distance-based rejection: gibberish and unknown languages go, short clean texts stay."""

import base64
import math
import random
import string

import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import langid

KNOWN = {
    "en": "all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood everyone has the right to life liberty and security of person no one shall be held in slavery or servitude",
    "de": "alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geist der brüderlichkeit begegnen jeder hat das recht auf leben freiheit und sicherheit der person niemand darf in sklaverei oder leibeigenschaft gehalten werden",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité tout individu a droit à la vie à la liberté et à la sûreté de sa personne nul ne sera tenu en esclavage",
    "es": "todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como están de razón y conciencia deben comportarse fraternalmente los unos con los otros todo individuo tiene derecho a la vida a la libertad y a la seguridad de su persona nadie estará sometido a esclavitud",
}
FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä jokaisella on oikeus elämään vapauteen ja henkilökohtaiseen turvallisuuteen"
POLISH = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa każdy człowiek ma prawo do życia wolności i bezpieczeństwa swej osoby"


def test_gibberish_and_unknown_languages_are_rejected(spark):
    rng = random.Random(4)
    some = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    made = lambda n: " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(n))
    rows = [(some(text.split(), rng.choice((3, 8, 20, 60, 200))), lang, "clean") for lang, text in KNOWN.items() for _ in range(200)]
    for n in (8, 20, 60, 200):
        for _ in range(10):
            rows += [(made(n), None, "random"), (base64.b64encode(rng.randbytes(5 * n)).decode(), None, "base64"), (some(FINNISH.split(), n), None, "Finnish"), (some(POLISH.split(), n), None, "Polish")]
    rows += [(rng.randbytes(400).hex(), None, "hex") for _ in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, kind string")
    out = langid.identify_languages(df, langid.fit_languages(df, ~langid.held_out(df)))
    kinds = out.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("rejected").alias("gone"))
    rejected = {r.kind: (r.gone, r.n) for r in kinds.collect()}
    assert rejected.pop("clean")[0] <= 8
    assert len(rejected) == 5 and all(gone >= 0.95 * n for gone, n in rejected.values()), rejected
    clean = out.where("kind = 'clean'")
    assert clean.where("lang = lang_pred").count() >= 0.97 * clean.count()


def test_document_frequencies_count_all_training_documents(spark):
    rows = [(i, "common words" if i % 50 else "quaint zebra", "en") for i in range(300)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), fit_rows=10)
    seen = sum((langid.counts(t) > 0).astype(int) for _, t, _ in rows)
    assert np.allclose(model["idf"], [math.log(301 / (1 + n)) + 1 for n in seen])
