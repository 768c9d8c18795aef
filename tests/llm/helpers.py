"""Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def documents(spark, seed=0, n=60):
    rng = random.Random(seed)
    texts = [". ".join(sentence(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 12))) for _ in range(n)]
    texts[5] = texts[4]
    texts[7] = texts[6].replace(texts[6].split()[3], "changed", 1)
    texts[9] = texts[8] + "\n" + sentence(rng, 4)
    texts[11] = sentence(rng, 5) + ". " + texts[10] + ". " + sentence(rng, 9)
    texts += [None, "", " \n\t", "!!!", sentence(rng, 6000), "a b", "A, b", "b"]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("rep", "size", "spans", "items", "_x", "key", "label", "piece", "d1")})
