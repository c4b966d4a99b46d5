import datetime as dt

from graphloom.operators.snapshots import change_events, change_summary, snapshot_order, snapshot_records, validity_intervals

RUNS = "snapshot_id bigint, saved_at timestamp, base string"


def day(n):
    return dt.datetime(2031, 3, n)


def frames(spark, units, nodes=(), runs=((7, 1), (5, 2), (9, 3))):
    u = spark.createDataFrame([(s, r, x, h, "extra") for s, r, x, h in units], "snapshot_id bigint, repo_id string, unit string, content_hash string, record_kind string")
    n = spark.createDataFrame([(s, r, x, "u", h) for s, r, x, h in nodes], "snapshot_id bigint, repo_id string, id string, unit string, content_hash string")
    return snapshot_records(u, n), spark.createDataFrame([(s, day(d) if d else None, "b") for s, d in runs], RUNS)


def test_order_is_by_saving_not_number(spark, rows):
    _, runs = frames(spark, [])
    assert rows(snapshot_order(runs)) == [(5, 2, 3), (7, 1, 3), (9, 3, 3)]


def test_events(spark, rows):
    units = [
        *[(s, "r", "same", "h") for s in (7, 5, 9, 9, 9)],
        (7, "r", "edited", "h1"), (5, "r", "edited", "h2"), (9, "r", "edited", "h2"),
        (7, "r", "gone", "h"), (5, "r", "back", "h"), (7, "r", "gap", "h"), (9, "r", "gap", "h"),
        (7, "r", "nulls", None), (5, "r", "nulls", None), (9, "r", "nulls", "x"),
        (7, None, "norepo", "a"), (5, None, "norepo", "b"), (9, None, "norepo", "b"),
    ]
    rec, runs = frames(spark, units, [(5, "r", "edited", "h"), (9, "r", "edited", "h"), (99, "r", "edited", "q")])
    assert rows(change_events(rec, runs)) == sorted(
        [
            (5, "r", "unit", "edited", "changed"), (5, "r", "unit", "gone", "removed"), (5, "r", "unit", "back", "added"), (9, "r", "unit", "back", "removed"),
            (5, "r", "unit", "gap", "removed"), (9, "r", "unit", "gap", "added"), (9, "r", "unit", "nulls", "changed"), (5, None, "unit", "norepo", "changed"), (5, "r", "node", "edited", "added"),
        ],
        key=repr,
    )


def test_intervals_and_ties(spark, rows):
    rec, runs = frames(spark, [(7, "r", "a", "x"), (7, "r", "a", "y"), (5, "r", "a", "y"), (9, "r", "a", "z")], runs=((7, 1), (5, 1), (9, 3), (9, 4), (8, None)))
    got = rows(validity_intervals(rec, runs).select("record_key", "content_hash", "first_ord", "last_ord"))
    assert got == [("a", "y", 1, 2), ("a", "z", 3, 3)]


def test_empty(spark, rows):
    rec, runs = frames(spark, [], runs=())
    assert rows(change_events(rec, runs)) == [] and rows(change_summary(change_events(rec, runs))) == []


def test_runs_beyond_a_chunk(spark, rows):
    import random

    rng, n = random.Random(5), 11
    seen = {(k, o): rng.choice("abx") if rng.random() < 0.9 else None for k in range(40) for o in range(1, n + 1) if rng.random() < 0.8}
    units = [(100 - o, "r" if k % 2 else None, f"{k:04x}" if k % 3 else f"u{k}", h) for (k, o), h in seen.items()]
    rec, runs = frames(spark, [*units, *units[:50]], runs=[(100 - o, o) for o in range(1, n + 1)])
    name = lambda k: ("r" if k % 2 else None, "unit", f"{k:04x}" if k % 3 else f"u{k}")
    events, spans = [], []
    for k in range(40):
        for o in range(2, n + 1):
            was, now = (k, o - 1) in seen, (k, o) in seen
            if was != now or was and seen[k, o - 1] != seen[k, o]:
                events.append((100 - o, *name(k), "removed" if not now else "added" if not was else "changed"))
        o = 1
        while o <= n:
            if (k, o) not in seen:
                o += 1
                continue
            first = o
            while (k, o + 1) in seen and seen[k, o + 1] == seen[k, first]:
                o += 1
            spans.append((*name(k), seen[k, first], first, o))
            o += 1
    for chunk in (1, 2, 4, 16):
        assert rows(change_events(rec, runs, chunk)) == sorted(events, key=repr)
        assert rows(validity_intervals(rec, runs, chunk).drop("n_runs")) == sorted(spans, key=repr)
