"""Every registered query with SQL gives DuckDB's rows; the others run."""

import pytest
from conftest import SF, same

from palimpsest.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(frame, duck.sql(ORACLES[name]))
    else:
        assert frame.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chunk_similarity_equals_brute_force(spark, duck):
    """Which chunks of all texts, each cut by itself, are still there after a tail is added to each."""
    import hashlib

    from palimpsest.functions.chunking import cut_points
    from palimpsest.plans.queries import _SIZES, _TAIL

    def hashes(texts):
        out = set()
        for t in texts:
            ends = cut_points(t, *_SIZES)
            out |= {hashlib.sha256(t[a:b]).digest() for a, b in zip([0, *ends], ends)}
        return out

    texts = [t.encode() for (t,) in duck.sql("SELECT text FROM documents WHERE text <> ''").fetchall()]
    before, after = hashes(texts), hashes([t + _TAIL.encode() for t in texts])
    assert tuple(QUERIES["chunk_similarity"](spark, SF).first()) == (len(before & after), len(after - before))
