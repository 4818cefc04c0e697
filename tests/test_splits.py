"""Trees of windows against a plain version, limits included."""

import datetime
import random

import pytest

from foliant.operators import splits

D = datetime.date


def plain(windows, days, most, most_nodes):
    """Nodes as (depth, first, last, records, state), a level at a time."""
    out, frontier, nodes = [], sorted(windows), len(windows)
    while frontier:
        below = []
        for first, last in frontier:
            n = sum(k for d, k in days if d is not None and first <= d <= last)
            if n <= most:
                state = "leaf"
            elif first == last:
                state = "minimum_reached"
            elif nodes + 2 + len(below) > most_nodes:
                state = "leaf_limit_reached"
            else:
                state = "split"
                mid = first + datetime.timedelta(days=(last - first).days // 2)
                below += [(first, mid), (mid + datetime.timedelta(days=1), last)]
            out.append((first, last, n, state))
        nodes, frontier = nodes + len(below), below
    return sorted(out)


@pytest.mark.parametrize(("most", "most_nodes"), [(5, 1024), (0, 40), (3, 7), (10_000, 1024), (1, 3)])
def test_trees(spark, most, most_nodes):
    rnd = random.Random(most)
    days = [(D(1992, 1, 1) + datetime.timedelta(days=int(rnd.betavariate(1, 4) * 400) - 3), rnd.randint(0, 4)) for _ in range(150)] + [(D(1992, 3, 3), 50), (None, 9)]
    windows = [(D(1992, 1, 1), D(1992, 6, 30)), (D(1992, 7, 1), D(1992, 12, 31))]
    planned = spark.createDataFrame([("a", *w) for w in windows] + [("b", *windows[0]), (None, *windows[0])], "run string, first date, last date")
    found = splits.split_tree(planned, spark.createDataFrame([("a", *d) for d in days] + [(None, *d) for d in days], "run string, day date, n long"), most, most_nodes).collect()
    nodes = lambda run: sorted((r["first"], r["last"], r["records"], r["state"]) for r in found if r["run"] == run)
    assert nodes("a") == plain(windows, days, most, most_nodes) and nodes(None) == plain(windows[:1], days, most, most_nodes)
    assert nodes("b") == [(*windows[0], 0, "leaf")]
    ids = {(r["run"], r["id"]): r for r in found}
    assert len(ids) == len(found)
    for r in found:
        assert (r["parent"] is None) == (r["depth"] == 0) and (r["parent"] is None or ids[r["run"], r["parent"]]["state"] == "split")
    leaves = sorted((r["first"], r["last"]) for r in found if r["run"] == "a" and r["state"] != "split")
    assert leaves[0][0] == D(1992, 1, 1) and leaves[-1][1] == D(1992, 12, 31)
    assert all(b[0] == a[1] + datetime.timedelta(days=1) for a, b in zip(leaves, leaves[1:], strict=False))


def test_no_windows_and_no_days(spark):
    planned = spark.createDataFrame([("a", D(1992, 1, 1), D(1992, 1, 1))], "run string, first date, last date")
    days = spark.createDataFrame([("a", D(1992, 1, 1), 3)], "run string, day date, n long")
    assert [(r["records"], r["state"]) for r in splits.split_tree(planned, days, 2).collect()] == [(3, "minimum_reached")]
    assert splits.split_tree(planned.limit(0), days, 2).count() == 0
    assert [(r["records"], r["state"]) for r in splits.split_tree(planned, days.limit(0), 2).collect()] == [(0, "leaf")]
