"""Line differences: shortest scripts, memory, sets of lines."""

import difflib
import random
import time
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.operators import changes as C


def shortest(a, b):
    """Length of a longest common subsequence by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_scripts_are_shortest_and_rebuild_both_sides(a, b):
    script, added, removed, kept = C.edit_script(a, b)
    assert [s[2:] for s in script if s[0] in " -"] == a and [s[2:] for s in script if s[0] in " +"] == b
    assert kept == shortest(a, b) and added == len(b) - kept and removed == len(a) - kept


def test_removed_lines_come_before_added_ones():
    assert C.edit_script(["h", "a", "b", "t"], ["h", "x", "t"])[0] == ["  h", "- a", "- b", "+ x", "  t"]
    assert C.edit_script([], ["x"])[0] == ["+ x"] and C.edit_script(["x"], [])[0] == ["- x"] and C.edit_script([], [])[0] == []


def test_twenty_thousand_lines_of_repeated_ones():
    r = random.Random(3)
    a, b = ([f"line {r.randrange(400)}" for _ in range(20_000)] for _ in range(2))
    tracemalloc.start()
    began = time.perf_counter()
    script, added, removed, kept = C.edit_script(a, b)
    took, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 60 and most < 100 << 20, (took, most)
    assert [s[2:] for s in script if s[0] in " -"] == a and [s[2:] for s in script if s[0] in " +"] == b
    assert kept >= sum(m.size for m in difflib.SequenceMatcher(None, a[:2000], b[:2000], autojunk=False).get_matching_blocks())


def test_sets_of_lines(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice(["a", "b", "", "c", "d "]) for _ in range(r.randrange(12))), "\n".join(r.choice(["a", "e", "", "d"]) for _ in range(r.randrange(12)))) for i in range(60)]
    rows += [(100, None, "x\nx"), (101, "x\ny\nx", None), (102, None, None), (103, "same", "same")]
    got = {x.k: x for x in C.line_sets(spark.createDataFrame(rows, "k long, b string, a string"), "k", "b", "a").collect()}
    assert len(got) == len(rows)
    for k, before, after in rows:
        x, y = (before or "").split("\n"), (after or "").split("\n")
        g = got[k]
        assert g.removed == [s for s in x if s not in y] and g.added == [s for s in y if s not in x] and (g.n_before, g.n_after, g.was_empty) == (len(x), len(y), not before)


def test_lines_are_grouped_not_compared(spark):
    """No expression over all lines of one side for each line of the other is in the plan."""
    plan = C.line_sets(spark.createDataFrame([(1, "a", "b")], "k long, b string, a string"), "k", "b", "a")._jdf.queryExecution().toString()
    assert "array_contains" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
