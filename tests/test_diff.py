"""Unified differences, against difflib and by applying them; reports as single files."""

import difflib
import itertools
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.operators import diff, invoices

LINES = st.lists(st.sampled_from([f"l{k}" for k in range(12)]), max_size=25)


@settings(max_examples=300, deadline=None)
@given(LINES, LINES, st.integers(0, 4))
def test_hunks_are_those_of_difflib(old, new, context):
    changes = diff.fine(0, old, 0, new)
    got = list(diff.hunks(changes, dict(enumerate(old)), dict(enumerate(new)), len(old), context))
    assert patched(old, ["---", "+++", *got]) == new
    codes = [(i, p, j, q) for tag, i, p, j, q in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if tag != "equal"]
    want = list(difflib.unified_diff(old, new, lineterm="", n=context))[2:] if len(set(old)) == len(old) and len(set(new)) == len(new) else None
    if want is not None and changes == codes:
        assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=8), st.randoms())
def test_chain_is_the_heaviest(sizes, random):
    order = list(range(len(sizes)))
    random.shuffle(order)
    found = [(10 * k, 10 * order[k], n) for k, n in enumerate(sizes)]
    best = max(sum(found[k][2] for k in some) for r in range(len(found) + 1) for some in itertools.combinations(range(len(found)), r) if all(found[a][1] < found[b][1] for a, b in zip(some, some[1:])))
    got = diff.chain(found)
    assert sum(n for _, _, n in got) == best and got == sorted(got) and all(a[1] < b[1] for a, b in zip(got, got[1:]))


def patched(old, lines):
    """The file that a unified difference makes of another."""
    out, at = [], 0
    for line in lines[2:]:
        if line.startswith("@@"):
            start, _, size = line.split(" ")[1][1:].partition(",")
            first = int(start) - (size != "0")
            out += old[at:first]
            at = first
        elif line[0] == "+":
            out.append(line[1:])
        else:
            assert old[at] == line[1:]
            at += 1
            out += [line[1:]] * (line[0] == " ")
    return out + old[at:]


BIG = [f"row {k},{k % 7}" for k in range(3000)]
CASES = {
    "nothing": (BIG, BIG), "edits": (BIG, [x.replace("row", "ROW") if k in (5, 6, 12, 2000, 2999) else x for k, x in enumerate(BIG)]), "cut and grown": (BIG, [*BIG[:100], "new", "new", *BIG[140:2500], *BIG[2400:2500]]),
    "moved": (BIG, [*BIG[2000:], *BIG[:2000]]), "from nothing": ([], ["a", "b"]), "to nothing": (["a", "b"], []), "repeats": (["x"] * 30 + ["end"], ["x"] * 28 + ["y"] + ["x"] * 2 + ["end"]), "all else": (["a"] * 700, ["b"] * 650),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_differences_of_tables_of_lines(spark, name):
    old, new = CASES[name]
    table = lambda rows: spark.createDataFrame(list(enumerate(rows)), "k long, line string").repartition(3)
    got = [r.value for r in diff.unified(table(old), table(new), "old", "new").orderBy("place").collect()]
    assert (patched(old, got) if got else old) == new and (not got) == (old == new)
    if name in ("edits", "from nothing", "to nothing", "nothing"):
        assert got == list(difflib.unified_diff(old, new, "old", "new", lineterm="", n=3))
    if name == "moved":
        assert sum(x[0] in "+-" for x in got[2:]) == 2000


def test_reports_are_single_files(spark, tmp_path):
    row = lambda k, total: {c: f"{c}{k}" for c in invoices.COLUMNS} | {"invoice_number": f"N{k:03d}", "source_path": f"/s/{k:03d}", "total": total, "confidence_avg": "0.9"}
    shape = ", ".join(f"{c} string" for c in invoices.COLUMNS)
    rows = spark.createDataFrame([row(k, "1") for k in range(40)], shape).repartition(4)
    path = f"{tmp_path}/invoices.csv"
    invoices.write_csv(rows, path)
    first = open(path).read()
    assert first.splitlines()[0] == ",".join(invoices.COLUMNS) and len(first.splitlines()) == 41
    assert invoices.write_preview(rows, path) == f"{tmp_path}/invoices.preview.csv" and open(f"{tmp_path}/invoices.preview.csv").read() == "".join(first.splitlines(True)[:11])
    changed = spark.createDataFrame([row(k, "2" if k in (3, 20) else "1") for k in range(41)], shape).repartition(4)
    to = invoices.write_difference(changed, path)
    assert to == f"{tmp_path}/invoices.diff.txt" and open(path).read() == first
    invoices.write_csv(changed, f"{tmp_path}/other.csv")
    want = difflib.unified_diff(first.splitlines(), open(f"{tmp_path}/other.csv").read().splitlines(), "invoices.csv (existing)", "invoices.csv (proposed)", lineterm="", n=3)
    assert open(to).read().splitlines() == list(want)
    invoices.write_difference(rows, path)
    assert open(to).read().startswith("(no textual difference between invoices.csv and the proposed overwrite")
    assert sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["invoices.csv", "invoices.diff.txt", "invoices.preview.csv", "other.csv"]
