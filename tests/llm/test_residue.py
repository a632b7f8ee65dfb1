import random

import pytest

from factloom.llm import residue as R

NOTICES = [
    "404 Not Found\n\nThe requested entry kumo could not be located on this server.",
    "Home | Entries | Search\n\nPlease enable JavaScript to view this page.\n\n© Kumo archive. All rights reserved.",
    "<h1>Access denied. You do not have permission to view /entries/kumo.</h1>",
    "Checking that you are human. This may take 7 seconds. Scripts must be on.",
    "Traceback (most recent call last):\n  File \"loader.py\", line 350, in fetch\nTimeoutError: kumo did not answer",
    '{"status": 500, "message": "internal failure", "trace": "kumo1"}',
    "SEITE NICHT GEFUNDEN (FEHLER 404). DER EINTRAG KUMO EXISTIERT NICHT MEHR.",
    "お探しのページ kumo は見つかりませんでした。",
    "Для просмотра kumo включите JavaScript.",
]
FILLERS = ["Your text here.\nYour text here.", "Texte à venir.", "asdf asdf qwer foo bar baz", "Lorem ipsum dolor sit amet. Vitae lacus.", "这里是示例文字。", "To be written."]
NULLS = ["null null", "NaNaNaN", "[object Object]", "#REF! #REF!", "None"]
SLOTS = [
    "Dear {{name}}, your lot is here.", "Dear {{ name }}, hi.", "It was {0} kilos.", "By ${keeper} of Rome.", "By #{trade}.", "Of %(lot_no)s jars.", "Of %LOT_NO% jars.", "At @@place@@.", "At __PLACE__.", "A <<name>> b.", "A <%= name %> b.",
    "To <NAME HERE> x.", "To [your name here].", "[INSERT LOT NO] jars", "[name to be supplied]", "The keeper is undefined and well.", "Added on [object Object].", "向他供应【此处填写名称】。", "Ana entrega [COMPLETAR NOMBRE] a Bo.",
]
CLEAN = [
    'Ana explains that "{name}" is how a form marks a field.', "Write `${entity}` in the prompt where Bo should stand.", "A set like {a, b, c} with 3 members is finite.", "The goal (: $prf (IsA $who dyer) $tv) asks for every match.",
    "In the log of Ana Bell, error 404 came up 950 times before Bo Orr fixed the route.", "Page not found was the name Ana Bell gave to the lost leaf of the town's ledger.", "The reader works without JavaScript, which Ana Bell likes.",
    'When the gate page says "access denied", Ana sends for Bo of the old town.', "Printers still set lorem ipsum lines to test type, Ana Bell says.", "Ana founded the works in 2003 with 404 coins.", "a pattern such as `{s} is part of {o}` is in use", "403 bei Ana Werk wog laut Bo und Cy 51,55 kg aus dem Ort.",
    "", "   ", "...",
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_labels(spark):
    cases = [*((t, "notice") for t in NOTICES), *((t, "filler") for t in FILLERS), *((t, "null") for t in NULLS), *((t, "slot") for t in SLOTS), *((t, None) for t in CLEAN)]
    got = {r.doc_id: (r.label, r.found_by) for r in R.residue(rows(spark, [t for t, _ in cases])).collect()}
    for i, (text, label) in enumerate(cases):
        assert got.get(i, (None,))[0] == label, text
        assert label is None or (got[i][1] == "rule") == (label in ("null", "slot")), text


def test_only_the_tables_find_pages(spark, monkeypatch):
    """Without candidates no page is found: rules give slots and nulls only."""
    docs = rows(spark, [*NOTICES, *FILLERS, *NULLS, *SLOTS])
    none = lambda frontier, rest, *_: rest.selectExpr("unit l", "unit u").limit(0)
    monkeypatch.setattr(R, "_by_tables", none)
    monkeypatch.setattr(R, "_by_prefix", none)
    assert {r.label for r in R.residue(docs).collect()} == {"null", "slot"}


MESSAGE = " ".join(a + b + c for a in "klmnrst" for b in "aeiou" for c in "klmnrs")


def test_labels_spread_over_near_copies_only(spark):
    trusted = (("notice", MESSAGE), ("filler", "zzz yyy"))
    words = MESSAGE.split()
    near = " ".join([*words[:50], "zzz", *words[51:]])
    chain = near.replace(words[100], "zzz").replace(words[150], "yyy").replace(words[20], "yyy").replace(words[70], "zzz")
    farther = chain.replace(words[120], "zzz").replace(words[170], "yyy").replace(words[5], "yyy").replace(words[85], "zzz")
    other = " ".join(reversed(words))
    docs = [(1, MESSAGE), (2, near), (3, chain), (4, farther), (5, other), (6, None), (7, " "), (8, SLOTS[0]), (9, SLOTS[0].replace("{{name}}", "Ana")), (10, "# Title\n\n" + near.upper() + ".\n\nBack to start"), (10, NULLS[0]), (None, near)]
    docs.append((11, near + ".\n" + other))
    docs.append((12, near + ".\n" + MESSAGE + "."))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.label) for r in R.residue(df, trusted).collect()}
    assert got == {(1, "notice"), (2, "notice"), (3, "notice"), (4, "notice"), (8, "slot"), (10, "notice"), (10, "null"), (12, "notice")}
    assert R.residue(df.limit(0)).count() == 0


def test_without_residue(spark):
    left = R.without_residue(rows(spark, [*NOTICES[:2], *CLEAN[:2], None])).collect()
    assert {r.text for r in left} == {*CLEAN[:2], None}


def test_long_texts_are_read_whole(spark):
    long = "Ana met Bo in town. " * 50_000
    assert R.rule_label(long + "Dear {name}, hello.") == "slot" and R.rule_label(long) is None
    content = "Your text here. " * 20_000
    got = R.residue(rows(spark, [long, content, content + "Ana met Bo and Cy in the old town by the sea."]))
    assert {(r.doc_id, r.label) for r in got.collect()} == {(1, "filler")}


@pytest.mark.parametrize("n", [1, 4, 5, 300])
def test_simhash(n):
    s = R.Skeletons((("x", "a b"),))
    one = s.shingles(["a"] * n + ["b"])
    assert -(2**63) <= R.simhash(one) < 2**63 and R.simhash(one) == R.simhash(s.shingles(["a"] * n + ["b"]))


def test_skeletons():
    s = R.Skeletons(R.TRUSTED)
    assert s.words("Sign in again to continue to Kumo Bala 17.") == s.words("sign in again to continue to *")[:-1] + ["*", "0"]
    assert s.words("test test test") == ["§"] and s.words("Texte à venir texte à venir") == ["texte", "à", "venir"]
    assert s.words("Kumo Bala 12") == [] and s.words("...") == []


def test_every_similar_unit_is_linked(spark):
    """Copies of messages with some words changed: all of similarity 0.8 or more are found, most by the tables."""
    rnd = random.Random(8)
    vocabulary = ["w" + "".join(rnd.choices("bcdfghklmnprst", k=5)) for _ in range(400)]
    messages = [" ".join(rnd.choices(vocabulary, k=rnd.choice([9, 14, 30, 60, 120]))) for _ in range(80)]
    trusted = tuple(("notice", m) for m in messages)
    docs, want, shares = [], set(), []
    skeletons = R.Skeletons(trusted)
    known = {m: set(skeletons.row(m)["shingles"]) for m in messages}
    for m in messages:
        group = {}
        for changed in (0, 1, 1, 1, 2, 3, 4, 6, 8):
            copy = m.split()
            for at in rnd.sample(range(len(copy)), min(changed, len(copy))):
                copy[at] = rnd.choice(vocabulary)
            group[len(docs)] = set(skeletons.row(" ".join(copy))["shingles"])
            docs.append(" ".join(copy))
        alike = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
        linked = {i for i, s in group.items() if alike(s, known[m])}
        shares += [len(group[i] & known[m]) / len(group[i] | known[m]) for i in linked]
        while more := {i for i in group for j in linked if i not in linked and alike(group[i], group[j])}:
            linked |= more
        want |= linked
    got = {r.doc_id: r.found_by for r in R.residue(rows(spark, docs), trusted).collect()}
    assert set(got) == want and sum(0.8 <= x < 0.9 for x in shares) > 20
    by_tables = sum(v == "tables" for v in got.values()) / len(got)
    print(f"recall of the tables alone: {by_tables:.3f} of {len(got)}")
    assert by_tables > 0.9


def test_layouts_of_one_notice(spark):
    notice = "You need to allow cookies and scripts before kumo can be shown."
    wrapped = notice.replace("and scripts", "and\nscripts")
    stated = notice + "\n(: one (IsA the_first_long_statement of_this_page) (STV 1.0 0.9))"
    got = {r.doc_id for r in R.residue(rows(spark, [notice, wrapped, stated, notice + " " + CLEAN[4]])).collect()}
    assert got == {0, 1, 2}
