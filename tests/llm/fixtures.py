"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, hits string, score string, size string, fp string, h string, "
        "spans string, host string, n_words string, label string, kind string, perplexity string")
LABELS = "doc_id long, quality int, toxic int, score double, text string"
SYLLABLES = "an er in on re th st ha ed ou ing ble ly tion ea".split()


def sentence(rng, n=12):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def prose(rng, sentences=4):
    return " ".join(sentence(rng) for _ in range(sentences))


def doc(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), *["clash"] * 11)


def documents(n=60, seed=5):
    """Prose with copies, near copies and the awkward rows."""
    rng = random.Random(seed)
    rows = [doc(i, prose(rng, rng.randint(1, 9)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None])) for i in range(n)]
    texts = [r[1] for r in rows]
    rows += [doc(n + i, texts[i % 3], "en", "a") for i in range(12)]  # copies
    for i in range(12):  # near copies
        words = texts[5].split()
        words[rng.randrange(len(words))] = "other"
        rows.append(doc(n + 20 + i, " ".join(words), "en", "b"))
    rows += [doc(1000, None), doc(1001, ""), doc(1002, " \t\n"), doc(None, "no id here"), doc(None, None), doc(1003, "one"), doc(1004, "One two"),
             doc(1005, "ÀÉ İstanbul straße 漢字 \U0001F600 word"), doc(1006, "word " * 30_000), doc(1007, "x" * 200_000), doc(1006, "word " * 30_000),
             doc(1006, "another text under the same id"), doc(-5, "negative id"), doc(1008, texts[7], None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS)


def got(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
