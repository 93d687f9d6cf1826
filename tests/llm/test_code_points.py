"""The quality model of code points: against brute force, on scripts other than Latin, and its n-grams over large alphabets."""

import math
import random
from collections import Counter

import fixtures
import oracle
import pyarrow as pa
from fixtures import doc, frame
from pyspark.sql import functions as F

from duelframe.llm import quality


class Points(oracle.KneserNey):
    """The brute-force model over code points, whose uniform guess has the symbols seen and one more."""

    def __init__(self, texts):
        super().__init__([])
        top = Counter(g for t in texts for g in grams(t))
        for k in range(self.order, 0, -1):
            self.c[k] = top
            top = Counter(g[1:] for g in top)
        self.settle()
        self.guess = 1 / (len(self.c[1]) + 1)

    def settle(self):
        for k in range(1, self.order + 1):
            t = [0] + [sum(1 for n in self.c[k].values() if n == j) for j in (1, 2, 3, 4)]
            y = t[1] / (t[1] + 2 * t[2]) if t[1] + t[2] else 0.5
            self.d[k] = [0.0] + [max(0.05, min(j - 0.05, j - (j + 1) * y * t[j + 1] / t[j] if t[j] else 0.5 * j)) for j in (1, 2, 3)]
            held = {}
            for g, n in self.c[k].items():
                x = held.setdefault(g[:-1], [0, 0.0])
                x[0] += n
                x[1] += self.d[k][min(n, 3)]
            self.context[k] = held

    def p(self, g):
        return super().p(g) if g else self.guess


def grams(text, order=4):
    s = " " * (order - 1) + (text or "")
    return [tuple(s[i:i + order]) for i in range(len(s) - order + 1)]


def perplexity(model, text):
    found = grams(text)
    return math.exp(-sum(math.log(model.p(g)) for g in found) / len(found)) if found else None


def test_code_points_match_brute_force(spark):
    rng = random.Random(8)
    trusted = [doc(i, fixtures.prose(rng), "en") for i in range(25)] + [doc(i, "ÀÉ straße 漢字\0 \U0001F600" + fixtures.prose(rng).upper(), "de") for i in range(25, 40)]
    model = quality.fit(frame(spark, trusted), quality.POINTS)
    exact = {"en": Points([r[1] for r in trusted if r[2] == "en"]), "de": Points([r[1] for r in trusted if r[2] == "de"]), None: Points([r[1] for r in trusted])}
    probe = [doc(1, "Theron ing."), doc(2, "ZZZ ### 123"), doc(3, "STRASSE straße 漢字\0", "de"), doc(4, "Ünï \U0001F600", None), doc(5, None), doc(6, ""), doc(7, "漢x", "fr"),
             doc(1, "Theron ing."), doc(8, "word " * 300_000)]
    rows = quality.perplexity(frame(spark, probe).withColumn("again", F.col("text")), model, ["doc_id", "lang", "again"], quality.POINTS).collect()
    assert len(rows) == len(probe)
    for r in rows:
        assert r.n_symbols == len(r.again or "")
        if r.doc_id != 8:
            want = perplexity(exact.get(r.lang, exact[None]), r.again)
            assert r.perplexity is None if want is None else abs(r.perplexity - want) < 1e-9 * want


def test_junk_in_other_scripts_is_rejected(spark):
    rng = random.Random(3)
    syllables = {"ru": "при вет сло во ние ста ров мен до ка ли на".split(), "zh": [chr(0x4E00 + 37 * i) + chr(0x4E00 + 53 * i + 7) for i in range(60)]}

    def text(lang, n=60):
        gap = " " if lang == "ru" else ""
        return gap.join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(n)) + "."

    def junk(lang, n=300):  # the same class of bytes, any letters of the script
        return "".join(chr(rng.randrange(0x430, 0x450) if lang == "ru" else rng.randrange(0x4E00, 0x9FA0)) + (" " if lang == "ru" and i % 6 == 5 else "") for i in range(n))
    rows = [doc(i, text(("ru", "zh")[i % 2]), ("ru", "zh")[i % 2]) for i in range(200)]
    bad = [doc(1000 + i, junk(("ru", "zh")[i % 2]), ("ru", "zh")[i % 2]) for i in range(20)]
    ids = spark.createDataFrame([(i,) for i in range(0, 200) if i % 4 < 2], "doc_id long")
    out = {r.doc_id: r.keep for r in quality.classify(frame(spark, rows + bad), ids).collect()}
    assert sum(out[i] for i in range(200)) >= 195 and not any(out[1000 + i] for i in range(20))


def test_shuffled_words_score_worse(spark):
    rng = random.Random(4)
    heads, tails = "a the this every no".split(), "runs. waits. sleeps here. comes back late.".split(". ")

    def sentence():
        return f"{rng.choice(heads)} {rng.choice(['old', 'red', 'small'])} {rng.choice(['dog', 'house', 'river', 'window'])} {rng.choice(tails)}"
    prose = [" ".join(sentence() for _ in range(20)) for _ in range(60)]
    model = quality.fit(frame(spark, [doc(i, t) for i, t in enumerate(prose[:40])]), quality.POINTS)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in prose[40:]]
    rows = frame(spark, [doc(i, t) for i, t in enumerate(prose[40:])] + [doc(100 + i, t) for i, t in enumerate(mixed)])
    out = {r.doc_id: r.perplexity for r in quality.perplexity(rows, model, ["doc_id"], quality.POINTS).collect()}
    assert all(out[100 + i] > 1.2 * out[i] for i in range(20))


def test_large_alphabets_keep_their_ngrams(monkeypatch):
    texts = pa.array(["straße 漢字\0", None, "", "aaaaaa\U0001F600", "漢字漢字漢字"])
    small = quality.ngrams(texts, quality.POINTS)
    want = Counter("".join(g) for t in texts.to_pylist() for g in grams(t))
    assert dict(zip(small.grams.to_pylist(), small.n.tolist())) == want and small.size.tolist() == [10, 0, 0, 7, 6]
    monkeypatch.setattr(quality, "WIDE", 3)
    large = quality.ngrams(texts, quality.POINTS)
    assert dict(zip(large.grams.to_pylist(), large.n.tolist())) == want
    assert [large.grams[i].as_py() for i in large.distinct.searchsorted(large.code)] == [small.grams[i].as_py() for i in small.distinct.searchsorted(small.code)]
