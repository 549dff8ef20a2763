import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioforge.operators import incremental as I

T0 = datetime(2025, 1, 1)
FEED = "directory string, hash string, seen_at timestamp, loaded_at timestamp, key string, version int"
RUNS = "build_id long, directory string, started_at timestamp, status string, key string"


def hours(n):
    return None if n is None else T0 + timedelta(hours=n)


def naive(feed, runs):
    first, good, out = {}, {}, set()
    for d, h, _, loaded in feed:
        if d is not None and h is not None and loaded is not None:
            v = h.strip(" \t\r\n").lower().removeprefix("sha256:")
            first[d, v] = min(first.get((d, v), loaded), loaded)
    for b, d, s, status in runs:
        if (status or "").lower() == "ok" and None not in (b, d, s):
            good[d, b] = min(good.get((d, b), s), s)
    for (d, v), loaded in first.items():
        after = [(s, b) for (x, b), s in good.items() if x == d and s >= loaded]
        if after:
            out.add((min(after)[1], v))
    return out


def test_replay_against_definition(spark):
    rng = random.Random(3)
    feed = []
    for _ in range(1500):
        loaded = rng.randint(0, 300)
        seen = rng.choice([loaded - rng.randint(0, 3), loaded - rng.randint(0, 200), None, loaded + 2])
        h = rng.choice(["{}", "SHA256:{}", " {}\t", "{} "]).format(rng.choice("abcdef") * rng.randint(1, 30))
        feed.append((rng.choice(["hot", "hot", "b", "c", None]), rng.choice([h, h.upper(), h, None]), hours(seen), hours(rng.choice([loaded, loaded, loaded, None]))))
    runs = [(rng.randint(1, 60), rng.choice(["hot", "b", "c", "d"]), hours(rng.choice([rng.randint(0, 320), None])), rng.choice(["ok", "OK", "failed", None, "running"])) for _ in range(80)]
    f = spark.createDataFrame([(*r, "clash", 1) for r in feed], FEED)
    r = spark.createDataFrame([(*r, "clash") for r in runs], RUNS)
    want = naive(feed, runs)
    assert {tuple(x) for x in I.build_batches(f, r).collect()} == want
    records, good = I.feed_records(f), I.successful_runs(r)
    for way in (I.replayed_runs, I.earliest_runs):
        assert {(x.run, x.version) for x in way(records, good, broadcast_runs=0).select("run", "version").collect()} == want
    totals = {(t.build_id, t.directory): t for t in I.build_totals(f, r).collect()}
    assert sum(t.embedded_chunks for t in totals.values()) == I.build_batches(f, r).count()


def test_step_by_step_with_failures(spark):
    """Runs one after another over a growing ledger take what the replay gives them; a failed run changes nothing."""
    feed = [("d", "a", 0, 1), ("d", "b", 0, 30), ("d", "a", 5, 6), ("d", "c", 11, 12), ("d", "late", 2, 25), ("d", "c", 13, 40)]
    f = spark.createDataFrame([(d, h, hours(s), hours(x), "k", 1) for d, h, s, x in feed], FEED)
    records = I.feed_records(f).cache()
    ledger = spark.createDataFrame([], "key string, version string")
    last, taken = None, {}
    for run, (start, ok) in enumerate([(10, True), (20, False), (26, True), (35, False), (45, True)]):
        now = F.lit(hours(start))
        new = [r.version for r in I.new_records(records, ledger, None if last is None else F.lit(hours(last)), now).collect()]
        if ok:
            assert new == list(dict.fromkeys(new))
            taken[run] = set(new)
            ledger = ledger.unionByName(spark.createDataFrame([("d", v) for v in new], "key string, version string"))
            last = start
    assert taken == {0: {"a"}, 2: {"c", "late"}, 4: {"b"}}


def test_empty(spark):
    f, r = spark.createDataFrame([], FEED), spark.createDataFrame([], RUNS)
    assert I.build_batches(f, r).count() == 0


def test_replay_equals_the_ledger(spark):
    """The replay's ledger table gives what window, distinct pairs and anti-join give run by run."""
    rng = random.Random(8)
    feed = [("d", rng.choice("abcdefghij") * rng.randint(1, 4), hours(x - rng.randint(0, 15)), hours(x)) for x in (rng.randint(0, 60) for _ in range(80))]
    f = spark.createDataFrame([(*r, "k", 1) for r in feed], FEED)
    records, last, want = I.feed_records(f).cache(), None, set()
    starts = [12, 25, 38, 51]
    for run, start in enumerate(starts):
        ledger = spark.createDataFrame([("d", v) for _, v in want], "key string, version string")
        want |= {(run, r.version) for r in I.new_records(records, ledger, None if last is None else F.lit(hours(last)), F.lit(hours(start))).collect()}
        last = start
    runs = spark.createDataFrame([(i, "d", hours(s), "ok", "k") for i, s in enumerate(starts)], RUNS)
    assert {tuple(x) for x in I.build_batches(f, runs).collect()} == want and len({run for run, _ in want}) == len(starts)


def test_without_the_ledger_the_overlap_comes_twice(spark, monkeypatch):
    """A late record widens the second run's window over what the first one took; only the anti-join keeps that from coming again."""
    feed = [("d", "a", 5, 6), ("d", "late", 4, 25)]
    f = spark.createDataFrame([(d, h, hours(s), hours(x), "k", 1) for d, h, s, x in feed], FEED)
    runs = spark.createDataFrame([(1, "d", hours(10), "ok", "k"), (2, "d", hours(30), "OK", "k"), (3, "d", hours(20), "failed", "k")], RUNS)
    assert sorted(tuple(x) for x in I.build_batches(f, runs).collect()) == [(1, "a"), (2, "late")]
    join = type(f).join
    monkeypatch.setattr(type(f), "join", lambda self, other, on=None, how=None: self if how == "left_anti" else join(self, other, on, how))
    assert sorted(tuple(x) for x in I.build_batches(f, runs).collect()) == [(1, "a"), (2, "a"), (2, "late")]
