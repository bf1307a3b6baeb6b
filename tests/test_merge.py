"""The merge's decision tables, row by row, and random snapshots against a plain model."""

import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.model import ZERO_HASH
from palimpsest.operators.merge import merge_trees

SCHEMA = "path string, hash string, mtime_ms long, size_bytes long"


def frame(spark, entries):
    return spark.createDataFrame([(p, *e) for p, e in sorted(entries.items())], SCHEMA)


def prefix(path):
    return path[: path.index("/") + 1] if "/" in path else ""


def model(base, a, b):
    """A plain model: entries, conflicts and the automatic count."""
    out, conflicts, auto = {}, [], 0
    for top in {prefix(p) for s in (base, a, b) for p in s}:
        x, y, z = ({p: e for p, e in s.items() if prefix(p) == top} for s in (base, a, b))
        if not x and not (y and z):
            out |= y or z
            auto += 1
            continue
        if x and not (y and z):
            rest = y or z
            if rest and rest != x:
                out |= rest
                auto += 1
            continue
        if x and (y == x or z == x):
            out |= z if y == x else y
            auto += y != z
            continue
        for p in {*x, *y, *z}:
            h = [s[p][0] if p in s else None for s in (x, y, z)]
            if None not in h:
                if h[1] == h[0] == h[2]:
                    out[p] = x[p]
                elif h[1] == h[0]:
                    out[p] = z[p]
                    auto += 1
                else:
                    out[p] = y[p]
                    if h[2] in (h[0], h[1]):
                        auto += 1
                    else:
                        conflicts.append((p, *h))
            elif h[0] is not None:
                side = y if p in y else z
                if p in side and side[p][0] != h[0]:
                    out[p] = side[p]
                    auto += 1
            elif h[1] is not None and h[2] is not None:
                out[p] = y[p]
                if h[1] != h[2]:
                    conflicts.append((p, ZERO_HASH, h[1], h[2]))
            else:
                out[p] = (y if p in y else z)[p]
                auto += 1
    return out, sorted(conflicts), auto


def check(spark, base, a, b):
    got = merge_trees(*(frame(spark, s) for s in (base, a, b)))
    entries, conflicts, auto = model(base, a, b)
    assert rows(got.entries) == sorted(((p, *e) for p, e in entries.items()), key=repr)
    assert rows(got.conflicts) == sorted(conflicts, key=repr)
    assert tuple(got.metrics.first()) == (auto, 0, len(conflicts))


E = lambda h, m=0: (h, m, len(h))


def folders(cases):
    """Sides in which each case has a folder of its own."""
    out = ({}, {}, {})
    for k, case in enumerate(cases):
        for side, files in zip(out, case):
            side |= {f"c{k:03d}/{name}": e for name, e in files.items()}
    return out


def test_entry_arms(spark):
    """All states of a file, beside one that differs on both sides, so that its folder is merged by entry."""
    states = [(x, y, z) for x in (None, "b") for y in (None, "b", "x", "y") for z in (None, "b", "x", "y") if x or y or z]
    cases = [[{"o": E(o)} | ({"f": E(h, i)} if h else {}) for i, (o, h) in enumerate(zip(("o", "oa", "ob"), case))] for case in states]
    check(spark, *folders(cases))


def test_prefix_arms(spark):
    states = [(x, y, z) for x in (None, "b") for y in (None, "b", "x") for z in (None, "b", "y", "x")]
    check(spark, *folders([[{"1": E(h), "2": E("same")} if h else {} for h in case] for case in states]))


def test_a_deleted_folder_survives_whole_if_the_other_side_touched_one_file(spark):
    base = {"d/1": E("1"), "d/2": E("2"), "r": E("r")}
    check(spark, base, base | {"d/1": E("1a")}, {"r": E("r")})


def test_a_changed_mtime_changes_its_prefix_but_no_entry(spark):
    base = {"d/1": E("1"), "d/2": E("2")}
    check(spark, base, base | {"d/1": E("1", 5)}, {"d/1": E("1"), "d/2": E("2b")})


def test_random_snapshots(spark):
    rng = random.Random(1)
    paths = [f"{d}{n}" for d in ("", "p/", "q/", "r/s/") for n in range(4)]
    for _ in range(3):
        side = lambda: {p: E(rng.choice("abc"), rng.choice((0, 1))) for p in paths if rng.random() < 0.6}
        check(spark, side(), side(), side())


TEXT = "".join(f"line {i}\n" for i in range(1, 6))


def blobs(spark, *texts):
    import hashlib

    data = [t if isinstance(t, bytes) else t.encode() for t in texts]
    return spark.createDataFrame([(hashlib.sha256(d).hexdigest(), bytearray(d)) for d in data], "hash string, data binary"), [hashlib.sha256(d).hexdigest() for d in data], [len(d) for d in data]


@pytest.mark.parametrize(
    "name, a, b, merged",
    [
        ("n.md", TEXT.replace("line 2", "A"), TEXT.replace("line 5", "B"), TEXT.replace("line 2", "A").replace("line 5", "B")),
        ("n.md", TEXT.replace("line 2", "A"), TEXT.replace("line 2", "B"), None),
        ("n.png", TEXT.replace("line 2", "A"), TEXT.replace("line 5", "B"), None),
        ("n.md", b"\xff\x00", TEXT.replace("line 5", "B"), None),
    ],
)
def test_merges_by_line(spark, name, a, b, merged):
    store, h, n = blobs(spark, TEXT, a, b)
    sides = [spark.createDataFrame([(name, h[i], 1000 * i, n[i])], SCHEMA) for i in range(3)]
    got = merge_trees(*sides, blobs=store)
    row = got.entries.first()
    counts = got.metrics.first()
    if merged is None:
        assert (row.hash, counts.text_merged, counts.conflicts) == (h[1], 0, 1)
        assert rows(got.conflicts) == [(name, *h)]
    else:
        _, (want,), _ = blobs(spark, merged)
        assert (row.hash, row.mtime_ms, row.size_bytes, counts.text_merged, counts.conflicts) == (want, 2000, len(merged), 1, 0)
        assert got.merged_blobs.first().hash == want


def test_missing_contents_stay_a_conflict(spark):
    store, h, n = blobs(spark, TEXT, TEXT.replace("line 2", "A"), TEXT.replace("line 5", "B"))
    sides = [spark.createDataFrame([("n.md", h[i], 0, n[i])], SCHEMA) for i in range(3)]
    assert merge_trees(*sides, blobs=store.where(store.hash != h[0])).metrics.first().conflicts == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_difference_rebuilds_the_new_text(old, new):
    from palimpsest.functions.textops import diff_ops

    out, i, j = [], 0, 0
    for kind, alo, ahi, blo, bhi in diff_ops(old, new):
        assert (alo, blo) == (i, j)
        assert kind != "equal" or old[alo:ahi] == new[blo:bhi]
        out += new[blo:bhi]
        i, j = ahi, bhi
    assert (i, j, out) == (len(old), len(new), new)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=10), st.data())
def test_merge_applies_both_sides(lines, data):
    from palimpsest.functions.textops import merge_texts

    base = [f"{x}{i}" for i, x in enumerate(lines)]  # lines that are all different
    half = len(base) // 2
    a = [f"A{x}" if data.draw(st.booleans()) else x for x in base[:half]] + base[half:]
    b = base[: half + 1] + [f"B{x}" if data.draw(st.booleans()) else x for x in base[half + 1 :]]
    text = lambda ls: "".join(f"{x}\n" for x in ls)
    assert merge_texts(text(base), text(a), text(b)) == ("merged", text(a[: half + 1] + b[half + 1 :]))


def test_an_insertion_in_the_middle_loses_no_line():
    from palimpsest.functions.textops import merge_texts

    base, a = "1\n2\n3\n", "1\nnew\n2\n3\n"
    assert merge_texts(base, a, base) == ("merged", a)
    assert merge_texts(base, a, base, compat="reference") == ("merged", "1\nnew\n3\n")


def test_unified_diff_text():
    import difflib

    from palimpsest.functions.textops import unified

    old = "".join(f"{i}\n" for i in range(30))
    new = old.replace("5\n", "five\n", 1).replace("22\n", "").replace("29\n", "29")
    want = "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), "before", "after"))
    assert unified(old, new).replace("\n\\ No newline at end of file\n", "") == want
    assert unified(old, old) == ""


def test_null_texts_merge_to_null(spark):
    from palimpsest.functions.textops import text_merge3

    frame = spark.createDataFrame([(None, "a", "b"), ("x\n", None, "y\n"), ("x\n", "x\n", "y\n")], "x string, a string, b string")
    got = [tuple(r.m) for r in frame.select(text_merge3()("x", "a", "b").alias("m")).collect()]
    assert got == [(None, None), (None, None), ("merged", "y\n")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 99), unique=True, min_size=1, max_size=14), st.data())
def test_merges_equal_a_plain_merge_of_far_edits(numbers, data):
    """Inserts, deletes and changes in the middle, line ends of both kinds, with and without a last one."""
    from palimpsest.functions.textops import merge_texts

    end, last = data.draw(st.sampled_from(["\n", "\r\n"])), data.draw(st.booleans())
    base = [f"l{n}" for n in numbers]
    sides, want = ([], []), []
    for i, line in enumerate(base):
        who = data.draw(st.sampled_from([None, None, 0, 1])) if i % 3 == 1 else None  # edits have two lines between them
        what = data.draw(st.sampled_from(["insert", "delete", "change"]))
        new = {"insert": [f"new{i}", line], "delete": [], "change": [f"changed{i}"]}[what]
        for k in (0, 1):
            sides[k].extend(new if who == k else [line])
        want.extend(new if who is not None else [line])
    if who is not None and what == "delete":
        return  # the last line's own end goes with it
    text = lambda ls: end.join(ls) + (end if last else "")
    status, merged = merge_texts(text(base), text(sides[0]), text(sides[1]))
    assert status == "merged"
    assert [x.rstrip("\r") for x in merged.split("\n")] == [x.rstrip("\r") for x in text(want).split("\n")]
