"""Journeys by rank blocks, whole records, versioned folders, uploads, boards in a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loanlens.operators import journey as J
from loanlens.operators import records as RC
from loanlens.operators import upload as UP
from loanlens.sources import versions as VS
from loanlens.streaming import stream as ST


def events(n=900):
    """One owner with a third of all events, times with ties."""
    rng = random.Random(1)
    rows = []
    for i in range(n):
        owner = 1 if i % 3 == 0 else rng.randint(2, 9)
        rows.append((i, owner, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 500)), rng.choice(["view", "error", "click"])))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, type string")
    return df.withColumn("date", F.to_date("ts")).withColumn("desc", F.lit("d"))


@pytest.mark.parametrize("block", [7, 1024])
def test_journey_to_date(spark, block):
    rows = events()
    log = J.journey_log(frame(spark, rows), block=block)
    points = spark.createDataFrame([(1, 0, "none"), (1, 1, "first"), (1, 7, "block"), (1, 8, "next"), (1, 300, "all"), (2, 20, "x"), (77, 3, "nobody")], "user_id long, upto long, name string")
    got = {}
    for r in J.journey_to_date(log, points, block=block).collect():
        got.setdefault((r["user_id"], r["name"]), []).append((r["rank"], r["event_id"]))
    for owner, upto, name in [(1, 1, "first"), (1, 7, "block"), (1, 8, "next"), (1, 300, "all"), (2, 20, "x")]:
        mine = sorted((t, i) for i, o, t, _ in rows if o == owner)[:upto]
        assert sorted(got[owner, name]) == [(k + 1, i) for k, (_, i) in enumerate(mine)]
    assert set(got) == {(1, "first"), (1, "block"), (1, "next"), (1, "all"), (2, "x")}


@pytest.mark.parametrize("block", [3, 1024])
def test_running_journey(spark, block):
    rows = events(300)
    got = {r["event_id"]: (r["events_to_date"], r["errors_to_date"], r["recent_types"]) for r in J.running_journey(frame(spark, rows), block=block).collect()}
    assert len(got) == 300
    for owner in {o for _, o, _, _ in rows}:
        mine = sorted((t, i, k) for i, o, t, k in rows if o == owner)
        for n, (_, i, _) in enumerate(mine):
            assert got[i] == (n + 1, sum(k == "error" for *_, k in mine[:n + 1]), ">".join(k for *_, k in mine[max(0, n - 2):n + 1]))


def test_malformed_journeys_are_empty(spark):
    df = spark.createDataFrame([("[{\"date\":\"2024-01-02\",\"type\":\"a\",\"desc\":\"b\"}]",), ("[{\"date\"",), ("nonsense",), ("",), (None,)], "j string")
    assert [len(r[0]) for r in df.select(J.parse_events("j")).collect()] == [1, 0, 0, 0, 0]


def test_gather(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, name string")
    many = spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (9, 5, "z")], "k long, n int, v string")
    one = spark.createDataFrame([(2, 0.5), (3, None)], "k long, s double")
    got = {r["k"]: (r["name"], [tuple(x) for x in r["many"]], [tuple(x) for x in r["one"]]) for r in RC.gather(base, {"many": many, "one": one}, "k").collect()}
    assert got == {1: ("a", [(1, "x"), (2, "y")], []), 2: ("b", [], [(0.5,)]), 3: (None, [], [(None,)])}


def test_gather_keeps_a_value_of_every_base_row(spark):
    base = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (2, None, 6), (None, "c", 7), (None, "c", 7)], "k long, name string, n int")
    got = {r["k"]: (r["n"], r["names"], len(r["many"])) for r in RC.gather(base, {"many": base.select("k", "n")}, "k", {"names": "name"}).collect()}
    assert got == {1: (5, ["a", "b"], 2), 2: (6, [], 1), None: (7, ["c", "c"], 2)}


def test_latest_rows(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(20)], "o int, t int")
    got = sorted(tuple(r) for r in RC.latest_rows(df, "o", ["t"], 3).collect())
    assert got == [(0, 14), (0, 16), (0, 18), (1, 15), (1, 17), (1, 19)]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "book")
    assert VS.current(spark, root) is None
    first = VS.publish(spark, root, lambda p: spark.range(3).write.parquet(p))

    def broken(path):
        spark.range(5).write.parquet(path)  # half of a replacement
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        VS.publish(spark, root, broken)
    assert VS.current(spark, root) == first and spark.read.parquet(first).count() == 3
    second = VS.publish(spark, root, lambda p: spark.range(4).write.parquet(p))
    third = VS.publish(spark, root, lambda p: spark.range(7).write.parquet(p))
    assert list(VS.versions(spark, root).values()) == [first, second, third] or VS.versions(spark, root) == {1: first, 2: second, 3: third}
    VS.drop_old(spark, root, 1)
    assert VS.versions(spark, root) == {3: third} and spark.read.parquet(third).count() == 7


CONTRACT = {"amount": "double", "months": "int", "grade": "string"}


def write(path, text):
    path.write_text(text)
    return str(path)


def test_upload(spark, tmp_path):
    root = str(tmp_path / "book")
    good = write(tmp_path / "a.csv", " amount , months,grade, note\n10.5,3,A,x\nten,3,B,x\n7,,C,\n8,2, ,x\n1,1.5,D,x\n2,2,E,x,too,many\nNaN,4,F,x\n")
    UP.ingest(spark, good, root, CONTRACT, ["grade"], optional={"note": "string", "city": "string"}, defaults={"sector": "Retail", "note": "none"})
    accepted, bad = UP.read(spark, root)
    assert sorted((r["company_id"], r["amount"], r["months"], r["grade"], r["note"], r["sector"]) for r in accepted.collect()) == [
        ("UP-0001", 10.5, 3, "A", "x", "Retail"), ("UP-0002", 7.0, None, "C", None, "Retail"), ("UP-0003", None, 4, "F", "x", "Retail")]
    why = sorted((r["row"], r["reasons"]) for r in bad.collect())
    assert [x[1] for x in why if x[0].startswith("2,2")] == [["broken line"]] and len(why) == 4
    assert sorted(sum((x[1] for x in why), [])) == ["blank: grade", "broken line", "not a number: amount", "not a number: months"]


def test_failed_uploads_keep_the_old_version(spark, tmp_path):
    root = str(tmp_path / "book")
    first = UP.ingest(spark, write(tmp_path / "a.csv", "company_id,amount,months,grade\nB7,1,1,A\n"), root, CONTRACT, optional={"company_id": "string"})
    assert UP.read(spark, root)[0].first()["company_id"] == "B7"  # an id of its own is kept
    for name, text in (("b.csv", "amount,grade\n1,A\n"), ("c.csv", "amount,months,grade\n"), ("d.txt", "amount,months,grade\n1,1,A\n")):
        with pytest.raises(ValueError):
            UP.ingest(spark, write(tmp_path / name, text), root, CONTRACT)

    def fails(df):
        raise RuntimeError("cannot score")

    with pytest.raises(RuntimeError):
        UP.ingest(spark, write(tmp_path / "e.csv", "amount,months,grade\n1,1,A\n"), root, CONTRACT, finish=fails)
    assert VS.current(spark, root) == first


def test_board_after_each_batch(spark):
    """After every batch the board of a group equals the top k of all rows so far; redelivered rows count once."""
    rng = random.Random(8)
    batches = [[(rng.choice("ab"), i + 40 * b, float(rng.randint(0, 30))) for i in range(40)] for b in range(3)]
    batches[2] += batches[0][:10] + [("b", 999, None)]
    src, out, ck = (ST.scratch(spark, x) for x in ("src", "out", "ck"))
    schema = "sector string, company_id long, pd double"
    seen = []
    for rows in batches:
        seen += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = ST.read_stream(spark, src, spark.read.parquet(src).schema, max_files=1)
        ST.run_updates(ST.top_board(stream, "sector", "company_id", "pd", 4), out, ck)
        got = {}
        for r in ST.latest_boards(spark, out, "sector").orderBy("rank").collect():
            got.setdefault(r["sector"], []).append((r["company_id"], r["pd"]))
        for s in "ab":
            want = sorted({(i, p) for g, i, p in seen if g == s and p is not None}, key=lambda x: (-x[1], x[0]))[:4]
            assert got[s] == want


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_asof_join(spark, width):
    """Against brute force: one key with most rows, ties, keys of one side only, rows without a time."""
    from loanlens.operators.asof import asof_join
    rng = random.Random(4)
    left = [(i, 1 if i % 3 else rng.randint(2, 5), rng.choice([None, *range(-5, 40)])) for i in range(200)]
    right = [(1 if i % 2 else rng.randint(2, 4), rng.choice([None, *range(-3, 38)]), i, f"v{i}") for i in range(60)] + [(9, 1, 1, "x")]
    got = asof_join(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, n int, v string"), "k", "t", ["v"], width, tie="n")
    want = []
    for i, k, t in left:
        before = [(rt, n, v) for rk, rt, n, v in right if rk == k and rt is not None and t is not None and rt <= t]
        best = max(before, default=(None, None, None))
        want.append((i, k, t, best[0], best[2]))
    assert sorted((r["id"], r["k"], r["t"], r["found_at"], r["v"]) for r in got.collect()) == sorted(want)
