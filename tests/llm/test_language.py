from pyspark.sql import functions as F

from tarnweave.llm import langid

EN = "The quiet river follows the old road. When the team lost the map, nobody went home. "
FR = "Le jardinier cherche la clé derrière la maison. La famille regarde le port pendant la pause. "


def test_hints(spark):
    rows = [("en_GB", ["en"]), ("FR", ["fr"]), ("Deutsch", ["de"]), ("it, en ,fr", ["it", "en", "fr"]), ("ru / es", ["ru", "es"]), ("xx", []), ("", []), (None, []), ("pt-BR;pt", ["pt"]), ("-", [])]
    got = spark.createDataFrame(rows, "h string, w array<string>").select("h", "w", langid.hint_languages(F.col("h")).alias("g")).collect()
    assert all(r.g == r.w for r in got)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    filters = langid.fit_filters(docs, sample=60)
    rows = docs.select("text", langid.hint_languages(F.col("lang")).alias("c")).where(F.size("c") == 1).collect()
    verdicts = filters.verdicts([r.text for r in rows])
    agree = sum(v[0] == r.c[0] for v, r in zip(verdicts, rows, strict=True)) / len(rows)
    assert agree > 0.9  # some labels are wrong
    segments = langid.language_segments(spark.createDataFrame([(1, EN * 2 + FR * 2), (2, EN + "“" + FR.split(". ")[0] + ".” " + EN), (3, None), (4, ""), (5, "¿? 12 34"), (None, EN), (6, EN * 3000)], "id long, t string").withColumn("segment", F.lit(1)), filters, id_col="id", text_col="t")
    got = {}
    for r in segments.orderBy("id", "segment").collect():
        got.setdefault(r.id, []).append((r.lang_code, r.sentences))
    assert [c for c, _ in got[1]] == ["en", "fr"] and got[1][0][1] == 4
    assert [c for c, _ in got[2]] == ["en", "fr", "en"] and got[2][1][1] == 1
    assert got[5] == [(None, 0)] and got[6] == [("en", 6000)] and 3 not in got and 4 not in got and got[None] == [("en", 2)]
    hints = spark.createDataFrame([(1, "en"), (2, None), (2, "English"), (None, "fr")], "id long, h string")
    found = {(r.id, r.lang_code) for r in langid.unhinted_languages(segments, hints, id_col="id", hint_col="h").collect()}
    assert found == {(1, "fr"), (6, "en")} or found == {(1, "fr"), (6, "en"), (None, "en")}
    main = {r.id: r.lang_code for r in langid.document_languages(segments, "id").collect()}
    assert main[2] == "en" and main[5] is None
    assert langid.language_segments(spark.createDataFrame([], "id long, t string"), filters, id_col="id", text_col="t").count() == 0


def test_false_positives_are_corrected():
    import numpy as np

    filters = langid.LanguageFilters(["a", "b"], np.full(1 << langid.BITS, 1, dtype=np.uint8), np.array([0.999999, 0.0]))
    found, grams = filters.hits([" some words of any kind "])
    assert grams[0] > 0 and abs(found[0][1]) < 1e-9 and found[0][0] <= grams[0] + 1e-6
