import pytest

SF = "/root/testdata/sf0.001"
LONG = "word salad " * 60_000

#: doc_id, text, lang, source, n_chars; nulls, empty and long texts, ties, repeated rows.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.\nMail a@b.co now", "en", "s0", 10),
    (2, "The quick brown fox jumps over the lazy dog again and again.\nMail a@b.co now", "en", "s0", 10),
    (2, "The quick brown fox jumps over the lazy dog again and again.\nMail a@b.co now", "en", "s0", 10),
    (3, None, "en", None, None),
    (4, "", None, "s1", 0),
    (5, "   \n\t ", "de", "s1", 6),
    (None, "no identifier here", "fr", "s2", 1),
    (6, LONG, "en", "s0", len(LONG)),
    (7, "Ünï cödé 😀 text. Released under the MIT Licence!", "de", "s2", 40),
    (8, "one", "xx", "s2", 3),
    (9, "12345 !!! ???", "en", "s2", 13),
]
#: Columns whose names are also results or intermediate names of the operators.
CLASHING = ["kept", "keep_id", "mix", "features", "sha", "bands", "node", "score", "spans", "__key", "__mix", "stay_id", "salt", "block", "target", "place", "length", "component_id"]


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, None), (3, None, 1), (None, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
