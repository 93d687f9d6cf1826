"""Operators on texts against brute force, on the awkward rows."""

import random
import time
import re

import fixtures
import oracle
import pytest
from fixtures import doc, frame, got
from pyspark.sql import functions as F

from duelframe.llm import credentials, decontaminate, licenses, pii, quality, simhash, toxicity

PAIRS = [(r[0], r[1]) for r in fixtures.documents()]


def empty(spark):
    return frame(spark, [])


# Benchmark decontamination

def benchmark(spark):
    rng = random.Random(5)
    docs = fixtures.documents()
    long = docs[3][1].split()
    items = [(1, " ".join(long[:14])), (2, " ".join(docs[9][1].upper().split()[2:25])), (3, "one"), (4, "No id"), (5, None), (6, ""), (7, "..."),
             (8, "word " * 12), (9, "never seen anywhere " * 5), (2, " ".join(docs[9][1].split()[2:25])), (None, docs[4][1]), (10, fixtures.prose(rng)),
             (11, "é İstanbul"), (12, " ".join(long[3:13]))]
    return items, spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, hits string")


def test_decontaminate_matches_brute_force(spark):
    items, table = benchmark(spark)
    found = decontaminate.decontaminate(frame(spark), table)
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    rows = [tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated").collect()]
    assert sorted(rows, key=repr) == sorted(oracle.decontaminate(PAIRS, items), key=repr)
    assert any(r[5] for r in rows)


def test_decontaminate_finds_every_span_of_ten_words(spark):
    rng = random.Random(11)
    words = [f"w{rng.randrange(4)}" for _ in range(60)]  # many repeats and equal hashes
    rows = [doc(i, " ".join([f"x{i}", *words[i:i + n], "y"])) for i in range(40) for n in (9, 10, 12)]
    items = [(1, " ".join(words))]
    found = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    expected = oracle.decontaminate([(r[0], r[1]) for r in rows], items)
    assert got(found, "doc_id", "n_hit") == sorted(((e[0], e[2]) for e in expected), key=repr)


def test_decontaminate_empty_tables(spark):
    items, table = benchmark(spark)
    assert decontaminate.decontaminate(empty(spark), table).count() == 0
    clean = decontaminate.decontaminate(frame(spark), table.where("false"))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(PAIRS)
    assert decontaminate.clean(frame(spark), table.where("false")).count() == len(PAIRS)


def test_decontaminate_drops_whole_documents(spark):
    items, table = benchmark(spark)
    kept = decontaminate.clean(frame(spark), table)
    assert kept.columns == frame(spark).columns
    expected = [(p[0], p[1]) for p, e in zip(PAIRS, oracle.decontaminate(PAIRS, items)) if not e[5]]
    assert got(kept, "doc_id", "text") == sorted(expected, key=repr)


# SimHash

def test_simhash_matches_brute_force(spark):
    assert got(simhash.near_duplicates(frame(spark)), "doc_id", "fingerprint", "component_id") == sorted(oracle.simhash(PAIRS), key=repr)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.one_per_component(empty(spark)).count() == 0


@pytest.mark.parametrize("chunk", [4, 4096])
def test_links_connect_what_lies_within_the_radius(spark, chunk):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0, 2 ** 64 - 1}
    centre = rng.getrandbits(64)
    for _ in range(300):  # a ball around one fingerprint, one large bucket for most keys
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    prints = sorted(prints)
    signed = [(p - 2 ** 64 if p >= 2 ** 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), chunk)
    assert edges.count() <= 6 * len(prints) * (len(prints) // chunk + 1)
    parts = {r.node % 2 ** 64: r.root % 2 ** 64 for r in simhash.components(edges).collect()}
    expected = oracle.roots(prints)
    assert len({parts.get(p, p) for p in prints}) == len(set(expected))
    by_root = {}
    for p, r in zip(prints, expected):
        assert by_root.setdefault(r, parts.get(p, p)) == parts.get(p, p)


def test_bit_planes_agree_with_popcount():
    import numpy as np
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2 ** 63, 130, dtype=np.uint64)
    prints[5:70] = prints[4] ^ (np.uint64(1) << rng.integers(0, 64, 65).astype(np.uint64))
    for radius in (0, 1, 2, 3):
        lanes = simhash.linked(prints, prints, radius)
        bits = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(bool)
        assert (bits == (np.bitwise_count(prints[:, None] ^ prints[None]) <= radius)).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(found) == 41 + 30 and len(set(found.values())) == 2


def test_one_document_of_each_component_stays(spark):
    kept = simhash.one_per_component(frame(spark))
    assert kept.columns == frame(spark).columns
    brute = oracle.simhash(PAIRS)
    root = oracle.roots([int(p, 16) for _, p, _ in brute])
    assert kept.count() == len(set(root))
    firsts = [c for c in {r: c for r, (_, _, c) in zip(root, brute)}.values() if c is not None]
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(firsts)


# Secrets

SECRETS = [
    doc(1, 'a password = "hunter22" b'), doc(2, "token:abc secret=token:abcdefgh"), doc(3, "AKIA" + "B" * 16 + " and AKIA12"), doc(4, "f" * 24 + "g" + "0" * 23),
    doc(5, "😀😀 API_KEY: 'Zz9+/_.=-x' é" + "a1" * 12), doc(6, "token=" + "a" * 40), doc(7, "client_id: shop12 then Ab3dEf6hIj9lMn2pQr5tUv8x"),
    doc(8, "client_id: shop12 " + "pad " * 80 + "Ab3dEf6hIj9lMn2pQr5tUv8x"), doc(9, "Ab3dEf6hIj9lMn2pQr5tUv8x alone"), doc(10, "https://db.example.org/x alone"),
    doc(11, "https://db.example.org/x user_name=bob password=letmein1"), doc(12, None), doc(13, ""), doc(None, "secret=abcdef"), doc(1, 'a password = "hunter22" b'),
    doc(14, "token token= = == secret"), doc(15, "secret=abcdef " * 3000), doc(16, "Passwd\x20\x20:\x20\x20xyzzy1 PASSWORD=\"q\" token='......'")]


def test_strong_secrets_match_brute_force(spark):
    rows = credentials.find_credentials(frame(spark, SECRETS)).collect()
    assert len(rows) == len(SECRETS)
    texts = sorted(((r[0], oracle.strong_secrets(r[1])) for r in SECRETS), key=repr)
    base = [(r.doc_id, [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in credentials.STRONG]) for r in rows]
    assert sorted(base, key=repr) == texts


def test_weak_parts_need_their_complements(spark):
    kinds = {r.doc_id: [s.kind for s in r.spans if s.kind not in credentials.STRONG] for r in credentials.find_credentials(frame(spark, SECRETS)).collect()}
    assert kinds[7] == ["identifier", "mixed"]
    assert kinds[8] == kinds[9] == kinds[10] == []  # too far apart, and alone
    assert kinds[11] == ["address", "identifier"]


def test_links_match_brute_force(spark):
    rng = random.Random(5)
    parts = ["client_id: shop12", "login=ann_9", "password=letmein1", "Ab3dEf6hIj9lMn2pQr5tUv8x", "https://db.example.org/x?y=1", "redis://h:1", "AKIA" + "C" * 16,
             "f0" * 14, "aB" * 100 + "9", "token: x", "A" * 300 + "b1"]
    texts = [doc(i, " ".join(rng.choice(parts) if rng.random() < 0.4 else "pad " * rng.randint(1, 40) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in credentials.find_credentials(frame(spark, texts)).collect()}
    expected = {r[0]: oracle.linked_secrets(r[1], credentials.KINDS, credentials.ROLES, credentials.SCOPE, credentials.SHORTEST) for r in texts}
    assert found == expected
    assert sum(k not in credentials.STRONG for spans in found.values() for k, _, _ in spans) > 50


def test_mixed_strings_have_no_longest_head(spark):
    late = "aB" * 100 + "9"  # its first digit comes after 200 letters
    rows = credentials.find_credentials(frame(spark, [doc(1, f"client_id: shop12 {late}"), doc(2, "login=x9 " + "aB" * 500_000 + "7")])).collect()
    assert {r.doc_id: [s.kind for s in r.spans] for r in rows} == {1: ["identifier", "mixed"], 2: ["identifier", "mixed"]}


def test_redaction_masks_reported_spans(spark):
    out = credentials.redact(frame(spark, SECRETS))
    assert out.columns == frame(spark).columns and out.count() == len(SECRETS)
    spans = {(r.doc_id, r.n): r for r in credentials.find_credentials(frame(spark, SECRETS).withColumn("n", F.length("text")), ["doc_id", "n"]).collect()}
    for r in out.collect():
        source = next(t for i, t in ((s[0], s[1]) for s in SECRETS) if i == r.doc_id)
        marks = [False] * len(source or "")
        for s in spans[(r.doc_id, None if source is None else len(source))].spans:
            marks[s.start:s.end] = [True] * (s.end - s.start)
        expected = None if source is None else "".join(
            c if not m else credentials.MASK if not (i and marks[i - 1]) else "" for i, (c, m) in enumerate(zip(source, marks)))
        assert r.text is None if source is None else r.text.replace(credentials.MASK * 2, credentials.MASK) == expected
        assert r.n_chars == len(r.text or "") or source is None


def test_secrets_empty(spark):
    assert credentials.find_credentials(empty(spark)).count() == 0
    assert credentials.redact(empty(spark)).count() == 0


# Personal data

PERSONAL = [
    doc(1, "mail a.b%c+d@x-y.example.com, x@y z@y.z@w.v"), doc(2, "1.2.3.4 999.1.1.1 1.2.3.4.5 255.255.255.256 0001.2.3.4"),
    doc(3, "4111 1111 1111 1111 and 4111-1111-1111-1112 12345678901234567890"), doc(4, "call +1 (743) 555-3824 or +49 30 1234567890123456 +12"),
    doc(5, "a@b.c_d@e.f g@@h.i é@x.y 漢a@b.c"), doc(6, None), doc(7, ""), doc(8, "call 030 555-1234 today"), doc(9, "order 030 555-1234"), doc(8, "call 030 555-1234 today"),
    doc(10, "contact Dr. Maria Keller"), doc(None, "ssn 123-45-6789"), doc(11, "1" * 5000), doc(12, "+" * 3000 + "1 (" * 2000), doc(13, "@" * 4000)]


def test_base_spans_match_brute_force(spark):
    rows = pii.find_personal_data(frame(spark, PERSONAL)).collect()
    base = [(r.doc_id, [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in pii.STRICT]) for r in rows]
    assert sorted(base, key=repr) == sorted(((r[0], oracle.personal_data(r[1])) for r in PERSONAL), key=repr)


def test_addresses_with_thousands_of_zeros():
    zeros = "0" * 5000  # int() refuses strings of more than 4,300 digits
    assert pii.strict_spans(f"at {zeros}.1.1.1 now") == [("ip", 3, 5009)]
    assert pii.strict_spans(f"{zeros}7.{zeros}.01.255") == [("ip", 0, 10_009)]
    assert pii.strict_spans(f"{zeros}256.1.1.1") == []


def test_runs_of_a_million_digits_take_linear_time():
    start = time.monotonic()
    for text in ("7" * 1_000_000, "1.2." + "7" * 1_000_000, "7-" * 500_000):
        pii.weak_spans(text, pii.strict_spans(text))
    assert time.monotonic() - start < 10  # a quadratic scan takes more than half an hour


def test_votes_learn_which_labelers_to_trust():
    patterns = {"email 1 0 1 1 1 1": 60, "phone 1 1 0 1 1 1": 40, "phone_local 0 1 0 1 1 1": 20, "phone_local 0 -1 0 -1 -1 1": 30, "card_like 0 -1 -1 -1 -1 2": 50}
    model = pii.learn(patterns)
    assert model.accept["phone_local 0 1 0 1 1 1"] > 0.5 > model.accept["phone_local 0 -1 0 -1 -1 1"]
    assert model.accept["card_like 0 -1 -1 -1 -1 2"] < 0.5
    assert all(0 <= x <= 1 for pair in model.reliability.values() for x in pair)
    assert pii.learn({}).accept == {}


def test_personal_data_empty(spark):
    assert pii.find_personal_data(empty(spark)).count() == 0
    nothing = pii.find_personal_data(frame(spark, [doc(1, "no data"), doc(2, None)]))
    assert [len(r.spans) for r in nothing.collect()] == [0, 0]


# Licenses

LICENSES = [
    doc(1, "All rights reserved."), doc(2, "Licensed under CC BY-NC 4.0."), doc(3, "This work is licensed under the GNU General Public License, version 3."),
    doc(4, "all RIGHTS... reserved all rights reserved all all rights reserved"), doc(5, "cc_by CC by cc"), doc(6, None), doc(7, ""), doc(8, "plain words"),
    doc(9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    doc(10, "Permission is hereby granted, free of cost"), doc(4, "all RIGHTS... reserved all rights reserved all all rights reserved"), doc(None, "cc by " * 5000)]


def places(text):
    words = oracle.WORD.findall(oracle.lower(text or ""))
    out = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in out]
    return len(words), len(out), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in out}))


def test_base_phrases_match_brute_force(spark):
    found = licenses.scan_licenses(frame(spark, LICENSES))
    assert got(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(
        ((r[0], *places(r[1])) for r in LICENSES), key=repr)
    labels = {r.doc_id: (r.labels, r.score) for r in found.collect()}
    assert labels[2] == ("cc-by,cc-by-nc", 1.0) and labels[3] == ("gpl", 1.0)
    assert labels[9][0] == "mit-opening" and 0 < labels[9][1] < 0.5  # the clause that opens the license is not the license
    assert labels[10][0] == "" and 0 < labels[10][1] < 1 and labels[8] == ("", 0.0) and labels[6] == ("", 0.0)
    assert licenses.scan_licenses(empty(spark)).count() == 0


def licensed(label, holder="the authors or copyright holders"):
    """The first whole text of a license, regions filled."""
    text = re.sub(r"\[\[(.*?)\]\]", r"\1", licenses.TEXTS[label][0])
    return re.sub(r"\{\{(\d+)\}\}", lambda m: holder if m.group(1) == "12" else "1", text)


def test_whole_texts_are_accepted_to_their_last_mandatory_word():
    automata = licenses.compile_templates(licenses.templates_of(licenses.STATEMENTS, licenses.TEXTS, licenses.OPENINGS))

    def labels(text):
        found = licenses.scan(text.encode(), {}, automata)
        return set(found["labels"].split(",")), found["score"]
    rng = random.Random(8)
    for label in licenses.TEXTS:
        for holder in ("the authors or copyright holders", "Example Org, Inc."):
            found, score = labels(f"Copyright 2020 {holder}. " + licensed(label, holder).upper() + " and more words")
            assert label in found and score == 1.0, label
            assert not any(x.endswith(licenses.OPENS) for x in found), (label, found)
        words = licensed(label).split()
        for _ in range(20):  # one mandatory word of the text is another one, or the text ends early
            i = rng.randrange(len(words))
            assert label not in labels(" ".join(words[:i]))[0] or label in licenses.STATEMENTS
            if words[i] not in ("1", *"the authors or copyright holders including next paragraph".split()):
                found, score = labels(" ".join([*words[:i], "otherwise", *words[i + 1:]])) if words[i] != "otherwise" else (set(), 0)
                assert label not in found or label in licenses.STATEMENTS, (label, i, words[i])
    opened = licensed("mit").split(" including without limitation")[0]
    found, score = labels(opened + " except for military use, which is forbidden")
    assert found == {"mit-opening"} and 0 < score < 0.5
    assert labels(licensed("bsd-3-clause"))[0] == {"bsd-3-clause"} and labels(licensed("0bsd"))[0] == {"0bsd"}


def test_automaton_accepts_what_a_regular_expression_accepts():
    rng = random.Random(2)
    template, pattern = "a [[b c]] d {{2}} e [[f]] g", re.compile(r"a (b c )?d (\w )?(\w )?e (f )?g( |$)")
    automaton = licenses.Automaton.compile("x", template)
    for _ in range(3000):
        words = rng.choices("abcdefg", k=rng.randint(1, 9)) if rng.random() < 0.5 else [w for w in "abcdxyefg" if rng.random() < 0.8]
        assert automaton.match([w.encode() for w in words], 0)[0] == bool(pattern.match(" ".join(words)))


# Toxicity

def toxic_table(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        parts = [fixtures.sentence(rng) for _ in range(rng.randint(2, 8))]
        if bad:
            parts.insert(rng.randrange(len(parts)), "You " + rng.choice(["idiot", "moron", "clownish"]) + " there.")
        rows.append(doc(i, " ".join(parts)))
        labels.append((i, 1, int(bad), 0.5, "clash"))
    labels += [(3, 1, 0, 0.1, "again"), (None, 1, 1, 0.1, ""), (5, 1, None, 0.1, "")]
    return frame(spark, rows + [doc(9000, None), doc(9001, ""), doc(None, "you idiot there"), doc(9002, "fine words. " * 20_000)]), spark.createDataFrame(labels, fixtures.LABELS)


def test_toxicity_held_out_and_sentences(spark):
    docs, labels = toxic_table(spark)
    rows = toxicity.score_toxicity(docs.withColumn("held", toxicity.held_out(F.col("doc_id"))), labels, ["doc_id", "held", "text"]).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 40 and all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held)
    for r in rows:
        if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0:
            a, b = map(int, r.offending.split(",")[0].split(":"))
            assert re.search("idiot|moron|clownish", r.text[a:b])
    other = {r.doc_id: r.score for r in rows}
    assert other[9000] == other[9001] < 0.5 and other[9002] < 0.5


def test_toxicity_without_labels(spark):
    docs, labels = toxic_table(spark, 20)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score_toxicity(docs, labels.where("false")).count() == docs.count()
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


# Quality

def test_perplexity_matches_brute_force(spark):
    rng = random.Random(8)
    trusted = [doc(i, fixtures.prose(rng), "en") for i in range(25)] + [doc(i, fixtures.prose(rng).upper(), "de") for i in range(25, 40)]
    model = quality.fit(frame(spark, trusted))
    exact = {"en": oracle.KneserNey([r[1] for r in trusted if r[2] == "en"]), "de": oracle.KneserNey([r[1] for r in trusted if r[2] == "de"]),
             None: oracle.KneserNey([r[1] for r in trusted])}
    probe = [doc(1, "Theron ing."), doc(2, "ZZZ ### 123"), doc(3, "Theron", "de"), doc(4, "Ünï", None), doc(5, None), doc(6, ""), doc(7, "x", "fr"), doc(1, "Theron ing.")]
    rows = quality.perplexity(
        frame(spark, probe).withColumn("again", F.col("text")), model, ["doc_id", "lang", "again"]).collect()
    assert len(rows) == len(probe)
    for r in rows:
        want = exact.get(r.lang, exact[None]).perplexity(r.again)
        assert r.perplexity is None if want is None else abs(r.perplexity - want) < 1e-4 * want


def test_more_languages_than_one_pass_takes(spark, monkeypatch):
    rng = random.Random(8)
    rows = [doc(i, fixtures.prose(rng), f"l{i % 7}") for i in range(70)] + [doc(100, "abc", None), doc(101, "abc", "zz")]
    docs = frame(spark, rows)
    model = quality.fit(docs.where("doc_id < 70"))
    whole = got(quality.perplexity(docs, model, ["doc_id"]), "doc_id", "n_symbols", "perplexity")
    monkeypatch.setattr(quality, "GROUP", 3)
    assert got(quality.perplexity(docs, model, ["doc_id"]), "doc_id", "n_symbols", "perplexity") == whole


def test_classifier_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(9)
    rows = [doc(i, fixtures.prose(rng, rng.randint(2, 12)), "en") for i in range(300)]
    junk = [doc(1000 + i, " ".join(w.upper() + "!!" for w in fixtures.prose(rng).split()), "en") for i in range(20)]
    docs = frame(spark, rows + junk + [doc(2000, None), doc(2001, ""), doc(5, rows[5][1], "en")])
    ids = spark.createDataFrame([(i,) for i in range(0, 300, 2)] + [(None,), (0,)], "doc_id long")
    out = {r.doc_id: r.keep for r in quality.classify(docs, ids).collect()}
    assert sum(out[i] for i in range(300)) >= 295 and not any(out[1000 + i] for i in range(20)) and not out[2000] and not out[2001]
    kept = quality.keep_good(docs, ids)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in quality.classify(docs, ids).collect())


def test_few_trusted_rows_still_make_bounds(spark):
    rng = random.Random(9)
    rows = [doc(i, fixtures.prose(rng, 1 + i % 8), ("en", "de", None)[i % 3]) for i in range(80)]  # 40 trusted in three languages
    junk = [doc(1000 + i, "".join(rng.choices("#%&@QXZ0123456789", k=50 * 3 ** (i % 5))), ("en", "de", None, "fr")[i % 4]) for i in range(20)]
    ids = spark.createDataFrame([(i,) for i in range(0, 80, 2)], "doc_id long")
    out = quality.classify(frame(spark, rows + junk + [doc(2000, "")]), ids).collect()
    assert all(r.low is not None and r.high is not None for r in out)
    assert not any(r.keep for r in out if r.doc_id >= 1000) and sum(r.keep for r in out if r.doc_id < 80) >= 76


def test_classifier_without_trusted_text(spark):
    docs, none = frame(spark), spark.createDataFrame([], "doc_id long")
    assert {r.keep for r in quality.classify(docs.where("length(text) > 0"), none).collect()} == {True}
    assert quality.classify(empty(spark), none).count() == 0
