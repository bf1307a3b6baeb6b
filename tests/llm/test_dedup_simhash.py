"""Exact and near dedup against brute force, on small tables with nulls, ties, long texts and clashing columns."""

import collections
import re
import string

import numpy as np
import pytest
import xxhash
from conftest import SF, same
from pyspark.sql import functions as F

from palimpsest.llm import common, exact_dedup, mixing, simhash
from palimpsest.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, copies string, run string, kept string"
TEXTS = [(1, "a  b"), (2, "a\tb"), (3, " a b"), (4, None), (5, ""), (5, ""), (None, "a b"), (7, "x " * 100_000), (6, "x " * 100_000), (8, " a b"), (9, "a\u000bb")]


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, "c", "r", "k") for i, t in pairs], DOCS)


def brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids)) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [{}, {"digest_bytes": 1}, {"digest_bytes": 1, "memtable_rows": 2}, {"memtable_bytes": 4}])
def test_exact_dedup(spark, limits):
    got = exact_dedup.exact_dedup(docs(spark, TEXTS * 2), **limits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == brute(TEXTS * 2)
    groups = {}
    for r in got:
        groups.setdefault(r.text_sha256, []).append(r)
    for rows in groups.values():
        (kept,) = [r for r in rows if r.kept]
        assert kept.doc_id == kept.keep_id


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(docs(spark, TEXTS).limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_an_index_finds_texts_of_another_batch(spark, most):
    index = exact_dedup.LsmIndex(spark, memtable_rows=3)
    index.compact(index.ingest(docs(spark, TEXTS)))
    got = {r.doc_id: r.keep_id for r in index.probe(docs(spark, [(100, "a b"), (101, "new"), (102, None)]), most).collect()}
    assert got == {100: 1, 101: None, 102: 4}


def test_op1(spark, duck):
    same(QUERIES["op1_exact_dedup"](spark, SF), duck.sql(ORACLES["op1_exact_dedup"]))


# --- near dedup -------------------------------------------------------------------------------------------------------


def print_of(text):
    lower = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """The least member of each one's component, links by at most three bits."""
    f = np.array(prints, np.uint64)
    parent = list(range(len(f)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(f))]


def test_op6_equals_brute_force(spark, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    prints = [print_of(t) for _, t in rows]
    want = sorted((rows[i][0], f"{prints[i]:016x}", rows[r][0]) for i, r in enumerate(components(prints)))
    got = QUERIES["op6_simhash"](spark, SF)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want


def test_odd_documents(spark):
    pairs = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one two"), (5, "one two"), (None, "ONE TWO"), (6, "w " * 200_000), (7, "Ünï cödé x"), (8, "ünï cödé x")]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dedup(docs(spark, pairs)).collect()}
    assert {(i, c) for i, _, c in got} >= {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (6, 6)}
    assert all(p == f"{print_of(dict(pairs)[i]):016x}" for i, p, _ in got)
    assert simhash.near_dedup(docs(spark, pairs).limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [4, 5, 6])
@pytest.mark.parametrize("split", [8, 2048])
def test_links_keep_every_component(spark, monkeypatch, blocks, split):
    """Random prints, near copies, a chain, and a crowd within a few bits of each other."""
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = base[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    chain = np.cumprod(np.full(30, 2, np.uint64)) - np.uint64(1)
    crowd = base[0] ^ rng.integers(0, 2**12, 400, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, near, chain, crowd]))
    monkeypatch.setattr(simhash, "SPLIT", split)
    masks = simhash.table_masks(blocks)
    found = []
    for t, m in enumerate(masks):
        keys = prints & np.uint64(m)
        order = np.argsort(keys, kind="stable")
        found.append(simhash.stretch_links(keys[order].view(np.int64), np.full(len(prints), t), prints[order]))
    pairs = np.concatenate(found)
    assert (np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 3).all()
    at = np.searchsorted(prints, pairs)
    _, parent = simhash.forest(len(prints), at[:, 0], at[:, 1])

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    assert [root(i) for i in range(len(prints))] == components(prints)


def test_hot_keys_are_salted(spark, monkeypatch, tmp_path):
    from palimpsest.llm import common

    monkeypatch.setattr(common, "HOT_KEY", 10)
    rows = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(200)], "doc_id long, k long")
    table = rows.select("k").distinct().selectExpr("k", "k * 2 AS twice")
    got = common.salted_lookup(rows, table, "k", f"file://{tmp_path}/s")
    assert sorted((r.doc_id, r.twice) for r in got.collect()) == [(i, 2 * (1 if i % 3 else i)) for i in range(200)]


# --- near copies by similarity ------------------------------------------------------------------------------------------


def brute_groups(texts, size=5, least=0.8):
    """The least place of each one's group, links by the similarity of all pairs' sets of shingles."""
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in t or ""))
        sets.append({" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} or ({" ".join(words)} if words else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def crowd(seed):
    """Copies of copies with edits, texts that share a passage, short ones, and odd ones."""
    import random

    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=3))
    passage = [word() for _ in range(60)]
    out = ["", None, " \t", "one", "One", "a b c d", "A b c d e", "w " * 9000]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(30, 300))]
        for _ in range(rng.randrange(1, 14)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 60)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
            if rng.random() < 0.2:
                base = own
    out += [" ".join([word() for _ in range(rng.randrange(5, 200))] + passage) for _ in range(20)]
    return out


@pytest.mark.parametrize("split", [4, 1 << 14])
def test_similar_texts_equal_brute_force(spark, split):
    texts = crowd(split)
    frame = docs(spark, list(enumerate(texts)))
    told, rows = simhash.similar(frame, split=split)
    got = {}
    for r in told.join(rows, "key").select("grp", "row.doc_id").collect():
        got.setdefault(r.grp, set()).add(r.doc_id)
    want = {}
    for i, g in enumerate(brute_groups(texts)):
        want.setdefault(g, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_crowd_gives_a_forest_of_its_links():
    """A bucket of more members than pivots, of which many link: no more links than members, and they reach what all reach."""
    texts = [t for seed in (5, 6) for t in crowd(seed) if t and len(t.split()) > 20]
    sets = [np.unique(simhash.shingle_hashes(t, 5).astype(np.uint32)) for t in texts]
    fps = np.array([simhash.fingerprint(simhash.shingle_hashes(t, 5)) for t in texts], np.uint64)
    assert len(texts) > 3 * simhash.PIVOTS
    got = simhash.set_links(fps, sets, 0.8)
    want = brute_groups(texts)
    assert len(got) == len(texts) - len(set(want))
    _, parent = simhash.forest(len(texts), got[:, 0], got[:, 1])
    while not (parent[parent] == parent).all():
        parent = parent[parent]
    assert parent.tolist() == want


def test_one_of_each_keeps_the_smallest_id(spark):
    texts = crowd(3)
    pairs = [(None if i % 9 == 0 else 1000 - i, t) for i, t in enumerate(texts)] * 2
    kept = simhash.one_of_each(docs(spark, pairs))
    assert kept.columns == ["doc_id", "text", "copies", "run", "kept"]
    groups = {}
    for (i, _), g in zip(pairs, brute_groups([t for _, t in pairs])):
        groups.setdefault(g, []).append(2**63 if i is None else i)
    assert sorted(2**63 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(map(min, groups.values()))
    assert simhash.one_of_each(docs(spark, pairs).limit(0)).count() == 0


@pytest.mark.parametrize("links_a_task", [7, 50, 1 << 20])
def test_components_of_any_number_of_tasks(spark, tmp_path, links_a_task):
    import random

    rng = random.Random(links_a_task)
    edges = [(i, i + 1) for i in range(60)] + [(500, 501 + i) for i in range(40)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(5, 5), (2**63 - 1, -(2**63))]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = simhash.star_components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}", links_a_task).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in parent if any(x in e and e[0] != e[1] for e in edges))


def shuffled(spark):
    """Bytes that this application has written to shuffles so far."""
    told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))


@pytest.mark.parametrize("stage", [exact_dedup.distinct_documents, simhash.one_of_each, mixing.mixed_documents])
def test_texts_stay_where_they_are(spark, tmp_path, stage):
    """Tables too large to be handed out meet by keys alone, so what is shuffled is a small part of the texts."""
    lot = np.random.default_rng(4)
    texts = [" ".join(lot.bytes(8).hex() for _ in range(1200)) for _ in range(240)]
    texts[120:130] = texts[:10]
    texts[130:140] = [t + " more" for t in texts[10:20]]
    table = [(k, t, "ab"[k % 2]) for k, t in enumerate(texts)]
    spark.createDataFrame(table, "doc_id long, text string, source string").repartition(4, "doc_id").write.parquet(f"{tmp_path}/d")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = [tuple(r) for r in stage(spark.read.parquet(f"{tmp_path}/d")).collect()]
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert set(got) <= set(table)
    if stage is exact_dedup.distinct_documents:
        assert sorted(got) == table[:120] + table[130:]
    elif stage is simhash.one_of_each:
        assert sorted(got) == table[:120] + table[140:]
    else:
        due = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(f"{tmp_path}/d")).collect() if r.copies}
        assert collections.Counter(r[0] for r in got) == due
    assert moved < 0.3 * sum(map(len, texts))


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_rows_go_by_their_keys_whatever_the_filters_let_pass(spark, monkeypatch, tmp_path, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rows = spark.range(3000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    gone = spark.range(0, 3000, 7).select("id")
    left = common.without(rows, gone, f"file://{tmp_path}/alike", "id")
    assert sorted(tuple(r) for r in left.collect()) == [(k, f"t{k}") for k in range(3000) if k % 7]
