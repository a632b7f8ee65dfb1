import random

import numpy as np
import pytest

from factloom.llm import leakage as L

CASES = "case_id long, texts array<string>, question string"


def brute(docs, cases):
    out = set()
    for c, texts, q in cases:
        for e in [*(texts or []), q]:
            w = L.words(e)
            grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
            for d, t in docs:
                v = L.words(t)
                if any(tuple(v[i : i + 12]) in grams for i in range(len(v) - 11)):
                    out.add((c, d))
    return out


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(3)
    seq = rnd.integers(0, 3, 400).astype(np.int32)
    order = L.suffix_array(seq, 400)
    assert [list(seq[i:]) for i in order] == sorted(list(seq[i:]) for i in range(400))


@pytest.mark.parametrize("block", [40, 10**6])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK_WORDS", block)
    monkeypatch.setattr(L, "PART_WORDS", 300)
    monkeypatch.setattr(L, "PAIRS", 50 if block == 40 else 10**6)
    rnd = random.Random(block)
    vocab = ["ab", "cd", "éf", "g7"]
    cases = [(c, [" ".join(rnd.choices(vocab, k=rnd.randint(5, 40))) for _ in range(2)] + [None], rnd.choice([None, "", "ab cd " * 9])) for c in range(25)]
    docs = [(100, None), (101, ""), (102, "ab cd " * 9 + "!")]
    for d in range(80):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            w = L.words(rnd.choice(rnd.choice(cases)[1][:2]))
            i = rnd.randrange(len(w))
            parts += [x.upper() if rnd.random() < 0.3 else x for x in w[i : i + rnd.randint(5, 20)]] + rnd.choices(["zz", "ab"], k=rnd.randint(0, 2))
        docs.append((d, rnd.choice([" ", ", ", "\n- "]).join(parts)))
    df, cs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(cases, CASES)
    found = L.longest_matches(df, cs).collect()
    assert {(r.case_id, r.doc_id) for r in found} == brute(docs, cases)
    texts, by = dict(docs), {(c, e): t for c, ts, q in cases for e, t in [*enumerate(ts), (-1, q)]}
    for r in found:
        assert L.words(texts[r.doc_id])[r.doc_word : r.doc_word + r.words] == L.words(by[r.case_id, r.entry_no])[r.entry_word : r.entry_word + r.words]
    clean = {r.doc_id for r in L.remove_leaked(df, cs).collect()}
    assert clean == set(texts) - {d for _, d in brute(docs, cases)}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "café " + " ".join(map(str, range(11)))), (2, "CAFÉ " + "_".join(map(str, range(11))))], "doc_id long, text string")
    cases = spark.createDataFrame([(1, ["Café " + " ".join(map(str, range(11)))], None), (2, None, "too short")], CASES)
    assert sorted((r.case_id, r.doc_id) for r in L.leaked(docs, cases).collect()) == [(1, 1), (1, 2)]
    assert L.leaked(docs.limit(0), cases).count() == 0 and L.leaked(docs, cases.limit(0)).count() == 0


def test_short_texts_leak_whole(spark):
    docs = spark.createDataFrame([(1, "He asked: Is Rex, a dog? Yes."), (2, "is rex a"), (3, "rex a dog is"), (4, "Is Rex a dog " * 3)], "doc_id long, text string")
    cases = spark.createDataFrame([(7, ["Is Rex a dog?", ""], None), (8, None, "rex a"), (9, ["is rex a cat"], None)], CASES)
    assert L.leaked(docs, cases).count() == 0
    got = {(r.case_id, r.doc_id, r.words, r.doc_word) for r in L.longest_matches(docs, cases, whole_short=True).collect()}
    assert got == {(7, 1, 4, 2), (7, 4, 4, 0), (8, 1, 2, 3), (8, 2, 2, 1), (8, 3, 2, 0), (8, 4, 2, 1)}
    assert L.remove_leaked(docs, cases.where("case_id = 7"), whole_short=True).count() == 2


def test_repeats_on_both_sides(spark):
    """A passage repeated in cases and documents is one row for each entry and document."""
    docs = spark.createDataFrame([(d, "ab cd " * 500) for d in range(4)], "doc_id long, text string")
    cases = spark.createDataFrame([(c, ["ab cd " * 50], None) for c in range(20)], CASES)
    rows = L.longest_matches(docs, cases).collect()
    assert len(rows) == 80 and {(r.words, r.doc_word, r.entry_word) for r in rows} == {(100, 0, 0)}
