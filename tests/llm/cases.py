"""Awkward little tables that every operator has to take."""
import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = "alpha beta gamma delta house garden water stone river cloud the of and to in é über niño 42 x7".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.5) for _ in range(n))


def awkward(seed=1, n=40):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and ids,
    shared passages, and texts of symbols alone."""
    rng = random.Random(seed)
    shared = sentence(rng, 60)
    texts = [None, "", " ", "\n\n", "  a  b\t c \n d", "x" * 3000, "!!! ???", "a", "a b", " é z", "<|endoftext|> a <|startoftext|>b",
             " \n  \n x  ", "a\n \nb", "don't we'll I'm", shared, shared, shared + " tail one", "head two " + shared, sentence(rng, 5000)]
    texts += ["\n".join(sentence(rng, 6) for _ in range(rng.randrange(1, 8))) for _ in range(n)]
    texts += ["one line\ntwo line\nthree line\nfour line", "zero\none line\ntwo line\nthree line\nend", "same\nsame\nsame\nsame\nsame"]
    rows = [(i * 7 % 61, t, rng.choice(["en", "fr", None]), rng.choice(["s", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[15], rows[15], (None, shared, None, None, None), (None, None, None, None, None)]


def frame(spark, rows=None, clash=False):
    df = spark.createDataFrame(awkward() if rows is None else rows, DOCS)
    if clash:
        for name in ("row", "key", "id", "digest", "node", "spans", "terms", "ids", "bytes", "lines", "starts", "gone", "h", "text_", "kept",
                     "n_words", "n_lines", "n_removed", "lang_pred", "score", "component_id", "cell", "guest", "x", "y"):
            df = df.withColumn(name, df["source"])
    return df


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def bag(rows):
    return sorted(map(repr, rows))
