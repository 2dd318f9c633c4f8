"""The language stage: clean texts stay, however short; other languages of the same script and random letters go."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

EN = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know"
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer millionen"
FI = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokaisella on oikeus elämään, vapauteen ja henkilökohtaiseen turvallisuuteen."


def test_limits(spark, tmp_path):
    random.seed(5)
    rows = []
    for lang, line in (("en", EN.split()), ("de", DE.split())):
        rows += [(len(rows) + 1 + k, " ".join(random.choices(line, k=random.randint(3, 120))), lang) for k in range(400)]
    clean = len(rows)
    rows += [(clean + 1, "the people said that they would not find water", "en"), (clean + 2, "wir haben nicht mehr als zwei jahre", "de"), (clean + 3, "it was the first", "en")]
    clean = len(rows)
    junk = [FI, FI[:120], "".join(random.choices("abcdefghijklmnopqrstuvwxyz    ", k=300)), "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=2000)), random.randbytes(400).hex()]
    rows += [(1_000_000 + 4 * k + 1, x, None) for k, x in enumerate(junk)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert kept ^ set(range(1, clean + 1)) == set()
