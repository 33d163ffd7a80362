"""Documents with every awkward case, and a way to run a query on a table made in a test."""

import random

from pyspark.sql import functions as F

WORDS = ["alpha", "beta", "gamma", "délta", "eps", "zeta", "eta,", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def texts(seed=7):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(30, 200)) for _ in range(12)]
    out = base + base[:3] + [None, "", " ", "one", "one two", "x" * 3000, "\n\n \t", "aaaa " * 400, prose(rng, 9000)]
    for text in base[:6]:
        words = text.split()
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    out += [base[0] + "\n" + base[1], base[1] + " " + base[0], (base[2] + "\n") * 3, "été 😀 " * 50]
    return out


def documents(spark, rows=None, partitions=7):
    """doc_id, text, lang, source, n_chars; with extra columns whose names clash with those that operators make."""
    rows = rows if rows is not None else list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    langs = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 2 == 0, "en").otherwise("de")
    df = df.select("doc_id", "text", langs.alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    clash = {n: F.lit(1) for n in ("fp", "n_words", "kept", "secrets", "marks", "pid", "hi", "ids", "piece", "length", "bin", "group", "word", "cell", "stratum_key", "symbols", "header", "license", "path")}
    return df.withColumns(clash).repartition(partitions)


def empty(spark):
    return documents(spark, [])
