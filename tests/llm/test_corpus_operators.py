"""Near-duplicate forest, runs of words and collocations against brute force, on the awkward rows."""

import random

import fixtures
import numpy as np
import oracle
import pytest
from fixtures import doc, frame, got

from duelframe.llm import collocations, forest, queries, runs
from duelframe.llm.runs import Catchers

PAIRS = [(r[0], r[1]) for r in fixtures.documents()]
NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# Runs of words

def numbers(rng):
    """A word sequence with repeats of any period."""
    words = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 110))]
    if len(words) > 10 and rng.random() < .6:
        p, a = rng.randint(1, len(words) // 3), rng.randrange(len(words))
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_catchers_find_all_runs_however_words_arrive(most):
    rng = random.Random(most)
    for _ in range(500):
        words, i = numbers(rng), 0
        catchers = Catchers(len(words))
        while i < len(words):
            n = rng.randint(1, most)
            catchers.append(np.array(words[i:i + n]))
            i += n
        assert [(a, b - a, q) for a, b, q in catchers.runs()] == oracle.periodic_runs(words)


def test_catchers_report_after_every_word():
    words = [1, 2, 3] * 5 + [4] + [5] * 7
    catchers = Catchers(len(words))
    for i, w in enumerate(words):
        catchers.append(np.array([w]))
        assert [(a, b - a, q) for a, b, q in catchers.runs()] == oracle.periodic_runs(words[:i + 1])


def test_catchers_forget_old_names():
    catchers = Catchers(200)
    for _ in range(50):
        catchers.append(np.arange(1000) % 331)
    assert sum(len(level.names) for level in catchers.levels) < 16 * 200


def repeated(rng):
    rows = [doc(i, " ".join(f"w{w}" for w in numbers(rng))) for i in range(400)]
    line = "one line of seven words right here\n"
    return rows + [doc(500, line * 4), doc(501, line * 3), doc(502, "lead " + line * 9 + "one line of"), doc(503, "A a A a A a"), doc(504, "x " * 6),
                   doc(505, "x " * 5), doc(504, "x " * 6)]


def test_runs_match_brute_force(spark):
    rows = [*[r for r in fixtures.documents() if len(r[1] or "") < 100_000], *repeated(random.Random(2))]
    expected = ordered(oracle.runs_row(r[0], r[1]) for r in rows)
    found = queries.op12_of(frame(spark, rows))
    assert ordered(found.collect()) == expected
    assert sum(r[1] for r in expected) > 100


def test_runs_of_long_and_empty_texts(spark):
    rows = [doc(1, "word " * 200_000), doc(3, "a b c d e " * 30_000 + "end"), doc(5, None), doc(6, ""), doc(None, "y " * 9), doc(7, "z" * 300_000)]
    found = {r.doc_id: r for r in runs.find_runs(frame(spark, rows)).collect()}
    assert [tuple(x) for x in found[1].runs] == [(0, 200_000, 1)] and found[1].collapsed == "word"
    assert [tuple(x) for x in found[3].runs] == [(0, 150_000, 5)] and found[3].collapsed == "a b c d e end"
    assert found[5].n_words == found[6].n_words == 0 and found[5].collapsed == "" and not found[5].runs
    assert [tuple(x) for x in found[None].runs] == [(0, 9, 1)] and found[7].collapsed == "z" * 300_000
    assert runs.find_runs(frame(spark, [])).count() == 0


# Near duplicates

def family(rng, n, words=60, changed=2):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, changed)):
            copy[rng.randrange(words)] = f"v{rng.randrange(5000)}"
        out.append(" ".join(copy))
    return out


def near_rows(seed):
    rng = random.Random(seed)
    texts = [t for size in (2, 3, 40, 150) for t in family(rng, size)] + family(rng, 60, 40, 4) + [fixtures.prose(rng) for _ in range(60)]
    rng.shuffle(texts)
    return [doc(2000 + i, t) for i, t in enumerate(texts)] + fixtures.documents()


@pytest.mark.parametrize("most, buffer", [(512, 1 << 16), (16, 64)])
def test_forest_matches_brute_force(spark, most, buffer):
    rows = near_rows(most)
    expected = oracle.shingle_components([(r[0], r[1]) for r in rows])
    assert got(forest.near_duplicates(frame(spark, rows), most, buffer), *NEAR) == ordered(expected)
    assert len({e[2] for e in expected}) < len(rows) - 150


def test_forest_of_few_rows(spark):
    assert forest.near_duplicates(frame(spark, [])).count() == 0
    lone = [doc(None, None), doc(None, "a b"), doc(3, ""), doc(4, "A B"), doc(5, "a b c d"), doc(None, "q"), doc(None, "q")]
    assert got(forest.near_duplicates(frame(spark, lone)), *NEAR) == ordered(oracle.shingle_components([(r[0], r[1]) for r in lone]))


def test_similarity_of_exactly_four_fifths_links(spark):
    # 8 shared shingles of 10, and 4 of 5, are linked; 3 of 4 are not.
    words = [f"u{i}" for i in range(12)]
    rows = [doc(1, " ".join(words)), doc(2, " ".join([*words[:11], "z"])), doc(3, "a b c d e f g h"), doc(4, "a b c d e f g"), doc(5, "p q r s t u v"),
            doc(6, "p q r s t u")]
    assert {r.doc_id: r.component_id for r in forest.near_duplicates(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


def test_regions_hold_every_row_and_stay_small():
    rng = np.random.default_rng(3)
    path = rng.integers(0, 3, (700, forest.LCP)).astype(">u2")
    path[:200] = 7
    raw = np.zeros((700, 2 * forest.LCP + 40), np.uint8)
    raw[:, :2 * forest.LCP] = path.view(np.uint8)
    raw = raw[np.lexsort(raw.T[::-1])]
    rows = forest.Rows(np.zeros(700, np.int64), raw, np.ones(700, np.int64), np.arange(700))
    shared = rows.shared()
    spans = list(rows.regions(shared, 20))
    assert max(b - a for a, b in spans) <= 20
    where = np.flatnonzero((raw[:, 1] == 7) & (raw[:, 3] == 7))
    covered = {i for a, b in spans for i in range(a, b)}
    assert set(where.tolist()) <= covered  # a crowd that no depth splits


# Collocations

def spoken(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "of", "new", "york", "city", "Über", "a", "b", "state", "x\x00y"]
    phrases = ["new york", "the state of", "new york city hall", "once upon a time"]
    out = []
    for i in range(n):
        parts = [rng.choice(phrases if rng.random() < .4 else words) for _ in range(rng.randint(1, 30))]
        out.append(doc(i, "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r"]) for p in parts), rng.choice(["en", "en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("least, top", [(30, 2000), (3, 2000), (3, 5)])
def test_collocations_match_brute_force(spark, setting, least, top):
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    rows = spoken(least) + fixtures.documents()
    found = collocations.collocations(frame(spark, rows), least, top)
    assert ordered(found.collect()) == ordered(oracle.collocations([(r[1], r[2]) for r in rows], least, top))
    assert found.count() > 5


def test_totals_of_stripes_are_frequencies(spark):
    _, elements = collocations.count_phrases(frame(spark, spoken(4)), 5)
    rows = elements.collect()
    totals = {(r.lang, r.prefix): r.f for r in rows if r.next is None}
    for r in rows:
        phrase = f"{r.prefix} {r.next}"
        if r.next is not None and phrase.count(" ") < 3:
            assert totals[r.lang, phrase] == r.f
            assert totals[r.lang, r.prefix] >= r.f


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [doc(1, None), doc(2, ""), doc(3, "lonely words")])).count() == 0
    many = collocations.collocations(frame(spark, [doc(1, "yes " * 50_000 + "x" * 100_000)]))
    assert got(many, "phrase", "a", "l", "r", "n", "score") == [  # each phrase goes into the next longer one
        ("yes yes yes yes", 49_997, 50_000, 49_998, 50_001, 999_959)]


def test_the_longest_phrases_stay(spark):
    found = collocations.collocations(frame(spark, [doc(i, "alpha beta gamma delta epsilon") for i in range(30)]))
    assert got(found, "phrase", "a", "l", "r", "n", "score") == [("alpha beta gamma delta", 30, 30, 30, 150, 1_000_000),
                                                                ("beta gamma delta epsilon", 30, 30, 30, 150, 1_000_000)]


def test_scores_beyond_64_bits(spark):
    big = 2 ** 62
    rows = [("en", "a", None, big), ("en", "b", None, big), ("en", "a", "b", big - 1)]
    scored = collocations.score_cuts(spark.createDataFrame(rows, "lang string, prefix string, next string, f long"))
    assert scored.head().score == 2_000_000 * (big - 1) // (2 * big)
