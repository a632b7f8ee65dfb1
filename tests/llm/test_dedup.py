import random

import pytest

from factloom.llm import dedup

ITEMS = "item_id long, batch_no int, status string, atoms array<string>"
RECORDS = "record_id long, item_id long, nl string"


def brute(items, records):
    nl = {}
    for _, i, t in sorted(records, key=lambda r: r[0]):
        if i is not None:
            nl.setdefault(i, t)
    accepted, out = [], set()
    for i, _, status, atoms in sorted(set((a, b, c, tuple(d) if d is not None else None) for a, b, c, d in items)):
        if status != "success":
            continue
        w = set(dedup.WORD.findall((nl.get(i) or "").lower()))
        b = {dedup.statement_body(x) for x in atoms or () if x} - {""}
        like = lambda x, y: bool(x & y) and 10 * len(x & y) >= 7 * len(x | y)
        hit = next((j for j, u, v in accepted if like(w, u) or like(b, v)), None)
        if hit is None:
            accepted.append((i, w, b))
        else:
            out.add((hit, i))
    return out


def test_body_layouts():
    same = ["(: a_1 (IsA x y) (STV 1.0 0.9))", "[:\xa0b\xa0[isa x y] [stv 0.5 0.1]]", "(: ' n 1' (IsA, x, y)\n  (PointMass 3.0))\r\n"]
    assert {dedup.statement_body(s) for s in same} == {"isaxy"}
    assert dedup.statement_body("(: r (Implication (Premises (P $x)) (Conclusions (Q $x))) (STV 1 1))") == "implicationpremisespxconclusionsqx"
    assert dedup.statement_body("no statement") == "nostatement"


@pytest.mark.parametrize("first_slice", [3, 1000])
def test_against_brute_force(spark, monkeypatch, first_slice):
    monkeypatch.setattr(dedup, "FIRST_SLICE", first_slice)
    monkeypatch.setattr(dedup, "SLICE_GROWTH", 4)
    rnd = random.Random(first_slice)
    words = [f"w{i}" for i in range(40)]
    base = [rnd.sample(words, rnd.randint(1, 9)) for _ in range(12)]
    items, records = [], []
    for i in range(90):
        ws = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            ws[rnd.randrange(len(ws))] = rnd.choice(words)
        rnd.shuffle(ws)
        atoms = [f"(: n{i}_{k} (Has {rnd.choice('abcdefgh')} {rnd.choice('xyz')}) (STV 1.0 0.5))" for k in range(rnd.randint(0, 4))]
        items.append((i, i // 30, rnd.choice(["success"] * 5 + ["failed", None]), rnd.choice([atoms, atoms, None])))
        if rnd.random() < 0.9:
            records.append((1000 + i, i, rnd.choice([" ".join(ws), " ".join(ws).upper(), None, ""])))
    records.append((5000, None, "background"))
    items += items[:3]
    got = dedup.repeats(spark.createDataFrame(items, ITEMS), spark.createDataFrame(records, RECORDS))
    assert {tuple(r) for r in got.collect()} == brute(items, records)


def test_batch_by_batch_gives_the_same(spark):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choices("abcdefghij", k=6)) for _ in range(25)]
    items = [(i, i // 20, "success", [f"(: n (P {rnd.choice('xyz')}{i % 9} b) (STV 1 1))"]) for i in range(80)]
    records = [(i, i, rnd.choice(texts)) for i in range(80)]
    df, rec = spark.createDataFrame(items, ITEMS), spark.createDataFrame(records, RECORDS)
    order = dedup.token_order(dedup.hashed_items(df.where("batch_no = 0"), rec))
    history, got = dedup.History(spark), set()
    for b in range(4):
        got |= {tuple(r) for r in history.add(dedup.keyed_items(df.where(f"batch_no = {b}"), rec, order)).collect()}
    assert got == brute(items, records) == {tuple(r) for r in dedup.repeats(df, rec).collect()}
    assert history.add(dedup.keyed_items(df.limit(0), rec, order)).count() == 0


def test_hot_family_and_empty(spark):
    items = [(i, i // 100, "success", [f"(: n (P a{i % 3} b) (STV 1 1))"]) for i in range(300)]
    records = [(i, i, f"one two three four five six {i % 3}") for i in range(300)]
    df, rec = spark.createDataFrame(items, ITEMS), spark.createDataFrame(records, RECORDS)
    assert {tuple(r) for r in dedup.repeats(df, rec).collect()} == brute(items, records)
    assert dedup.repeats(df.limit(0), rec).count() == 0
    assert dedup.repeats(df, rec.limit(0)).count() == 297


def test_history_is_opened_again(spark, tmp_path):
    rnd = random.Random(11)
    items = [(i, i // 30, "success", []) for i in range(90)]
    texts = [" ".join(rnd.sample("abcdefghijklmnop", 7)) for _ in range(12)]
    records = [(i, i, rnd.choice(texts).replace(rnd.choice("abcdefghijklmnop"), rnd.choice("xyz"))) for i in range(90)]
    df, rec = spark.createDataFrame(items, ITEMS), spark.createDataFrame(records, RECORDS)
    got = set()
    for b in range(3):
        history = dedup.History(spark, str(tmp_path / "history"))
        assert history.parts == b and (history.order is None) == (b == 0)
        got |= {tuple(r) for r in history.add(dedup.keyed_items(df.where(f"batch_no = {b}"), rec)).collect()}
    assert got == brute(items, records) and any(a // 30 < b // 30 for a, b in got)


def test_a_small_batch_reads_its_buckets_only(spark, tmp_path):
    items = [(i, 0 if i < 500 else 1, "success", []) for i in range(501)]
    records = [(i, i, " ".join(f"w{i * 7 + k}" for k in range(6))) for i in range(500)] + [(500, 500, "w7 w8 w9 w10 w11 w12")]
    df, rec = spark.createDataFrame(items, ITEMS), spark.createDataFrame(records, RECORDS)
    history = dedup.History(spark, str(tmp_path / "history"))
    assert history.add(dedup.hashed_items(df.where("batch_no = 0"), rec)).count() == 0
    batch = dedup.hashed_items(df.where("batch_no = 1"), rec)
    touched = {r.bucket for r in dedup._keys(history.keyed(batch)).collect()}
    assert 0 < len(touched) < dedup.BUCKETS and {r.bucket for r in history.keys(sorted(touched)).select("bucket").distinct().collect()} <= touched
    assert "BroadcastHashJoin" in history.met(history.keyed(batch))._jdf.queryExecution().toString()
    assert [tuple(r) for r in dedup.History(spark, history.path).add(batch).collect()] == [(1, 500)]


def test_last_batch(spark):
    items = [(i, i // 10, "success", [f"(: n (P a{i % 7} b) (STV 1 1))"]) for i in range(30)]
    records = [(i, i, f"one two three w{i % 11}") for i in range(30)]
    df, rec = spark.createDataFrame(items, ITEMS), spark.createDataFrame(records, RECORDS)
    got = {tuple(r) for r in dedup.last_batch_repeats(df, rec).collect()}
    assert got == {(a, b) for a, b in brute(items, records) if b >= 20} and got
