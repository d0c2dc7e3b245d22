import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("shard", T.StringType()), T.StructField("length", T.StringType()), T.StructField("_row", T.StringType()),
    T.StructField("lang_pred", T.StringType()), T.StructField("node", T.StringType()), T.StructField("keep", T.StringType())])

WORDS = {"en": "the and of to that with this for over under when where house river stone walking lights".split(),
         "de": "der die und das nicht mit über straße schön haus wasser stein gehen lichter zwischen immer".split(),
         "fr": "le la les et dans avec pour être été maison rivière pierre marcher lumière toujours jamais".split()}


def rows():
    r = random.Random(4)
    out = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        lines = [" ".join(r.choice(WORDS[lang]) for _ in range(r.randint(3, 40))) for _ in range(r.randint(1, 6))]
        out.append([i, "\n".join(lines), lang, "hot" if i % 3 else f"s{i % 5}"])
    base = out[0][1]
    odd = [None, "", " \n\t ", "\n", "x", "a b c d", "a b c d", base, base.upper(), base + " tail", "Straße ĐŽ ﬁ 漢字 🎉 é \x00 end", "  double  spaces \n\n here ",
           "word " * 30_000, "longword" * 9_000, "!!! ??? 123", "\n".join(["Shared boilerplate line here"] * 3 + ["own"]), "shared boilerplate line here  \nother own line text"]
    out += [[100 + i, t, None if i % 2 else "en", None] for i, t in enumerate(odd)]
    out += [[None, "no id but a text of some words", "en", "hot"], [None, None, None, None], [5, out[5][1], "fr", "hot"], [5, "other text under the same id as before", "en", "hot"], [-7, base, "en", "hot"]]
    return [(*x, len(x[1]) if x[1] is not None else None, "s", "l", "r", "lp", "n", "k") for x in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "source").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
