"""Registered queries of the snapshot engine, each with the SQL that DuckDB checks it by.

A query reads whole tables. Those without SQL (text merges beyond the planted edits, chunk boundaries) have tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import chunking, formats, hashing, patterns, paths, rules, textops
from palimpsest.functions.register import register_functions
from palimpsest.model import MOST_VAULTS, TOUCH_MS, ZERO_HASH
from palimpsest.operators import diff, guard, history, logs, merge, ranges, registry, scan, tree
from palimpsest.plans.fixtures import Snapshots, oracle_ctes
from palimpsest.session import shared_dir
from palimpsest.sources import tables
from palimpsest.sources.files import register_sources
from palimpsest.vault import GuardRejected, Vault

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, ctes: bool = True):
    """Registers a function by its name, and its SQL; with ``ctes`` the SQL goes on after the snapshots' tables."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            ORACLES[f.__name__] = (oracle_ctes() + (" " if body.upper().startswith("SELECT") else ",\n") + body) if ctes else body
        return f

    return put


def staged(frame: DataFrame) -> DataFrame:
    """What is read several times, written once to a shared folder."""
    path = f"{shared_dir(frame.sparkSession)}/stage"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


LEAF = 100
ENTRIES = "path, hash, mtime_ms, size_bytes"


# --- trees ------------------------------------------------------------------------------------------------------------


def _tree_sql(side: str) -> str:
    return rf"""
numbered AS (SELECT *, regexp_extract(path, '^[^/]*/') AS prefix,
             (row_number() OVER (PARTITION BY regexp_extract(path, '^[^/]*/') ORDER BY path) - 1) // {LEAF} AS leaf_no FROM {side}),
leaves AS (SELECT prefix, CAST(leaf_no AS BIGINT) AS leaf_no, count(*) AS n,
           sha256(string_agg(path || chr(10) || hash || chr(10) || mtime_ms || chr(10) || size_bytes || chr(10), '' ORDER BY path)) AS hash
           FROM numbered GROUP BY ALL),
prefixes AS (SELECT prefix, CASE WHEN count(*) = 1 THEN min(hash) ELSE sha256(string_agg(leaf_no || ':' || hash || chr(10), '' ORDER BY leaf_no)) END AS prefix_hash,
             count(*) AS leaves, CAST(sum(n) AS BIGINT) AS files FROM leaves GROUP BY prefix)
"""


@query(_tree_sql("base") + "SELECT prefix, leaf_no, hash, n FROM leaves")
def merkle_leaves(spark, sf_dir):
    return tree.build_leaves(Snapshots(spark, sf_dir).base, LEAF).drop("entries")


@query(_tree_sql("base") + "SELECT * FROM prefixes")
def merkle_prefix_hashes(spark, sf_dir):
    return tree.build_tree(Snapshots(spark, sf_dir).base, LEAF).prefixes


@query(_tree_sql("base") + "SELECT sha256(string_agg(prefix || chr(10) || prefix_hash || chr(10), '' ORDER BY prefix)) AS root_hash, CAST(sum(files) AS BIGINT) AS total_files, count(*) AS prefixes FROM prefixes")
def merkle_root(spark, sf_dir):
    return tree.build_tree(Snapshots(spark, sf_dir).base, LEAF).root


@query(_tree_sql("a") + "SELECT * FROM prefixes")
def update_tree(spark, sf_dir):
    """A's tree, from the base's tree and the changes only."""
    s = Snapshots(spark, sf_dir)
    base, a = s.base, s.a
    rows = base.select("path", F.struct("hash", "mtime_ms").alias("o")).join(a.select("path", F.struct("hash", "mtime_ms").alias("n")), "path", "full_outer")
    changed = rows.where("NOT (o <=> n)")
    upserts = a.join(changed.where("n IS NOT NULL").select("path"), "path", "left_semi")
    return tree.update_tree(tree.build_tree(base, LEAF), upserts, changed.where("n IS NULL").select("path"), LEAF).prefixes


@query(f"SELECT {ENTRIES} FROM base")
def flatten_tree(spark, sf_dir):
    return tree.flatten(tree.build_leaves(Snapshots(spark, sf_dir).base, LEAF))


@query(f"""
ups AS (SELECT {ENTRIES}, doc_id FROM a WHERE doc_id % 3 = 0 UNION ALL SELECT {ENTRIES}, doc_id + 1000000 FROM b WHERE doc_id % 6 = 0),
last AS (SELECT {ENTRIES} FROM ups QUALIFY row_number() OVER (PARTITION BY path ORDER BY doc_id DESC) = 1),
gone AS (SELECT path FROM base WHERE doc_id % 4 = 0)
SELECT {ENTRIES} FROM base WHERE path NOT IN (SELECT path FROM gone) AND path NOT IN (SELECT path FROM last)
UNION ALL SELECT {ENTRIES} FROM last""")
def upsert_entries(spark, sf_dir):
    """Deletes first, then upserts, of which the later one of a path wins."""
    s = Snapshots(spark, sf_dir)
    pick = lambda side, n, plus: s.full(side).where(F.col("doc_id") % n == 0).select(*ENTRIES.split(", "), (F.col("doc_id") + plus).alias("ord"))
    gone = s.full("base").where(F.col("doc_id") % 4 == 0).select("path")
    return tree.apply_changes(s.base, pick("a", 3, 0).unionByName(pick("b", 6, 1_000_000)), gone, "ord")


# --- differences ------------------------------------------------------------------------------------------------------

_DELTAS = """SELECT CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS action,
       coalesce(o.path, n.path) AS path, CAST(NULL AS VARCHAR) AS old_path, n.hash AS hash, n.size_bytes AS size, n.mtime_ms AS mtime_ms
FROM {old} o FULL OUTER JOIN {new} n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash"""


@query(_DELTAS.format(old="base", new="a"))
def snapshot_diff(spark, sf_dir):
    s = Snapshots(spark, sf_dir)
    return diff.compute_deltas(s.base, s.a)


@query(_DELTAS.format(old="base", new="b"))
def snapshot_diff_pruned(spark, sf_dir):
    """The same deltas with equal subtrees pruned by their hashes."""
    s = Snapshots(spark, sf_dir)
    base, b = s.base, s.b
    changed = diff.changed_prefixes(*(tree.build_tree(x, LEAF).prefixes for x in (base, b)))
    return diff.compute_deltas(base, b, prefixes=changed)


@query("""
sig AS (SELECT side, regexp_extract(path, '^[^/]*/') AS prefix, string_agg(path || hash || mtime_ms || '-' || size_bytes, ',' ORDER BY path) AS s
        FROM (SELECT 'o' AS side, path, hash, mtime_ms, size_bytes FROM base UNION ALL SELECT 'n', path, hash, mtime_ms, size_bytes FROM b) GROUP BY ALL),
p AS (SELECT prefix, max(s) FILTER (side = 'o') AS o, max(s) FILTER (side = 'n') AS n FROM sig GROUP BY prefix)
SELECT prefix, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM p WHERE o IS DISTINCT FROM n""")
def changed_prefixes(spark, sf_dir):
    s = Snapshots(spark, sf_dir)
    return diff.changed_prefixes(*(tree.build_tree(x, LEAF).prefixes for x in (s.base, s.b)))


@query(f"""SELECT CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' ELSE 'M' END AS s, coalesce(o.path, n.path) AS path,
       coalesce(o.hash, '{ZERO_HASH}') AS old, coalesce(n.hash, '{ZERO_HASH}') AS new
FROM base o FULL OUTER JOIN b n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash""")
def diff_with_hashes(spark, sf_dir):
    s = Snapshots(spark, sf_dir)
    return diff.diff_with_hashes(s.base, s.b)


@query("SELECT 'added' AS action, path, CAST(NULL AS VARCHAR) AS old_path, hash, size_bytes AS size, mtime_ms FROM a")
def diff_from_zero(spark, sf_dir):
    s = Snapshots(spark, sf_dir)
    return diff.compute_deltas(s.a.where("false"), s.a)


@query("""
new AS (SELECT * REPLACE (CASE WHEN doc_id % 17 = 0 THEN 'moved/' || path ELSE path END AS path) FROM base),
d AS (SELECT o.path AS opath, n.path AS npath, o.hash AS ohash, n.* FROM base o FULL OUTER JOIN new n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash),
gone AS (SELECT ohash AS h, min(opath) AS was FROM d WHERE npath IS NULL GROUP BY 1 HAVING count(*) = 1),
come AS (SELECT hash AS h, min(npath) AS now FROM d WHERE opath IS NULL GROUP BY 1 HAVING count(*) = 1),
pair AS (SELECT * FROM gone JOIN come USING (h))
SELECT CASE WHEN p.was IS NOT NULL THEN 'renamed' WHEN opath IS NULL THEN 'added' WHEN npath IS NULL THEN 'deleted' ELSE 'modified' END AS action,
       coalesce(npath, opath) AS path, p.was AS old_path, d.hash AS hash, d.size_bytes AS size, d.mtime_ms AS mtime_ms
FROM d LEFT JOIN pair p ON d.npath = p.now AND d.opath IS NULL WHERE NOT (npath IS NULL AND opath IN (SELECT was FROM pair))""")
def diff_renames(spark, sf_dir):
    """The extension that pairs deleted and added paths of one content."""
    s = Snapshots(spark, sf_dir)
    moved = s.full("base").withColumn("path", F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path")))
    return diff.compute_deltas(s.base, moved, detect_renames=True)


# --- merge ------------------------------------------------------------------------------------------------------------

_MERGE = """
rows AS (SELECT 'base' AS side, path, hash, mtime_ms, size_bytes FROM base UNION ALL SELECT 'a', path, hash, mtime_ms, size_bytes FROM a
         UNION ALL SELECT 'b', path, hash, mtime_ms, size_bytes FROM b),
sig AS (SELECT side, regexp_extract(path, '^[^/]*/') AS prefix, string_agg(path || hash || mtime_ms || '-' || size_bytes, ',' ORDER BY path) AS s FROM rows GROUP BY ALL),
p AS (SELECT prefix, max(s) FILTER (side = 'base') AS x, max(s) FILTER (side = 'a') AS a, max(s) FILTER (side = 'b') AS b FROM sig GROUP BY prefix),
acts AS (SELECT prefix, CASE
    WHEN x IS NULL AND a IS NULL THEN 'b' WHEN x IS NULL AND b IS NULL THEN 'a' WHEN x IS NULL THEN 'recurse'
    WHEN a IS NULL AND b IS NULL THEN 'drop' WHEN a IS NULL AND b = x THEN 'drop' WHEN a IS NULL THEN 'b'
    WHEN b IS NULL AND a = x THEN 'drop' WHEN b IS NULL THEN 'a'
    WHEN a = x AND b = x THEN 'base' WHEN b = x THEN 'a' WHEN a = x THEN 'b' ELSE 'recurse' END AS act FROM p),
m AS (SELECT path, act, x.hash AS x, a.hash AS a, b.hash AS b, x.mtime_ms AS xm, a.mtime_ms AS am, b.mtime_ms AS bm, x.size_bytes AS xs, a.size_bytes AS az, b.size_bytes AS bs
      FROM (SELECT DISTINCT path FROM rows) LEFT JOIN base x USING (path) LEFT JOIN a USING (path) LEFT JOIN b USING (path)
      JOIN acts ON acts.prefix = regexp_extract(path, '^[^/]*/')),
t AS (SELECT *, CASE WHEN act = 'drop' THEN NULL WHEN act = 'base' THEN CASE WHEN x IS NOT NULL THEN 'base' END
        WHEN act = 'a' THEN CASE WHEN a IS NOT NULL THEN 'a' END WHEN act = 'b' THEN CASE WHEN b IS NOT NULL THEN 'b' END
        WHEN x IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a = x AND b = x THEN 'base' WHEN a = x THEN 'b' ELSE 'a' END
        WHEN x IS NOT NULL AND b IS NOT NULL THEN CASE WHEN b <> x THEN 'b' END
        WHEN x IS NOT NULL AND a IS NOT NULL THEN CASE WHEN a <> x THEN 'a' END
        WHEN x IS NOT NULL THEN NULL WHEN a IS NOT NULL THEN 'a' ELSE 'b' END AS take,
      CASE WHEN act <> 'recurse' THEN 'none'
        WHEN x IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a = x AND b = x THEN 'none' WHEN a = x OR b = x OR a = b THEN 'auto' ELSE 'conflict' END
        WHEN x IS NOT NULL THEN CASE WHEN coalesce(a <> x, b <> x, false) THEN 'auto' ELSE 'none' END
        WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a = b THEN 'none' ELSE 'conflict' END
        ELSE 'auto' END AS counted FROM m)
"""


def _merged(spark, sf_dir) -> merge.MergeResult:
    s = Snapshots(spark, sf_dir)
    return merge.merge_trees(s.base, s.a, s.b)


@query(_MERGE + """SELECT path, CASE take WHEN 'base' THEN x WHEN 'a' THEN a ELSE b END AS hash, CASE take WHEN 'base' THEN xm WHEN 'a' THEN am ELSE bm END AS mtime_ms,
       CASE take WHEN 'base' THEN xs WHEN 'a' THEN az ELSE bs END AS size_bytes FROM t WHERE take IS NOT NULL""")
def merge_entries(spark, sf_dir):
    return _merged(spark, sf_dir).entries


@query(_MERGE + f"SELECT path, coalesce(x, '{ZERO_HASH}') AS base_hash, a AS side_a_hash, b AS side_b_hash FROM t WHERE counted = 'conflict'")
def merge_conflicts(spark, sf_dir):
    return _merged(spark, sf_dir).conflicts


@query(_MERGE + """SELECT count(*) FILTER (counted = 'auto') + (SELECT count(*) FROM acts WHERE act IN ('a', 'b')) AS auto_resolved,
       CAST(0 AS BIGINT) AS text_merged, count(*) FILTER (counted = 'conflict') AS conflicts FROM t""")
def merge_counters(spark, sf_dir):
    return _merged(spark, sf_dir).metrics


@query(_MERGE + "SELECT prefix, act FROM acts")
def merge_prefix_actions(spark, sf_dir):
    s = Snapshots(spark, sf_dir)
    return merge.merge_rows(s.base, s.a, s.b)[1].select("prefix", "act")


@query("""SELECT path, CASE WHEN a.hash = b.hash THEN 'no_change' WHEN a.hash = x.hash THEN 'fast_forward' WHEN b.hash = x.hash THEN 'local_only' ELSE 'conflict' END AS action
FROM base x JOIN a USING (path) JOIN b USING (path)""")
def classify_sync(spark, sf_dir):
    s = Snapshots(spark, sf_dir)
    side = lambda n: getattr(s, n).select("path", F.col("hash").alias(n))
    return side("base").join(side("a"), "path").join(side("b"), "path").select("path", rules.classify_sync(F.col("base"), F.col("a"), F.col("b")).alias("action"))


#: Edits of a text's first and last line, which merge unless the text has a single line.
_HEAD, _TAIL = "A HEAD OF ITS OWN", "A TAIL OF ITS OWN"
_EDITS = f"d AS (SELECT doc_id, t AS x, '{_HEAD}' || chr(10) || t AS a, t || chr(10) || '{_TAIL}' AS b FROM src WHERE t <> '')"


@query(_EDITS + f"""
SELECT doc_id, CASE WHEN contains(rtrim(x, chr(10)), chr(10)) OR ends_with(x, chr(10)) THEN 'merged' ELSE 'overlap' END AS status,
       CASE WHEN contains(rtrim(x, chr(10)), chr(10)) OR ends_with(x, chr(10)) THEN sha256(a || chr(10) || '{_TAIL}' || CASE WHEN ends_with(x, chr(10)) THEN chr(10) ELSE '' END) END AS content_sha256 FROM d""")
def text_merge3(spark, sf_dir):
    t = Snapshots(spark, sf_dir).src.where("t <> ''")
    rows = t.select("doc_id", "t", F.concat(F.lit(f"{_HEAD}\n"), "t").alias("a"), F.concat("t", F.lit(f"\n{_TAIL}")).alias("b"))
    rows = rows.withColumn("m", textops.text_merge3()("t", "a", "b"))
    return rows.select("doc_id", "m.status", F.sha2("m.content", 256).alias("content_sha256"))


@query(f"""
d AS (SELECT doc_id, t, CASE WHEN doc_id % 3 = 0 THEN t ELSE '{_HEAD}' || chr(10) || t END AS n FROM src)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'same' ELSE 'text' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS added, 0 AS removed FROM d WHERE t <> ''""")
def file_diff(spark, sf_dir):
    t = Snapshots(spark, sf_dir).src.where("t <> ''")
    new = F.when(F.col("doc_id") % 3 == 0, F.col("t")).otherwise(F.concat(F.lit(f"{_HEAD}\n"), "t"))
    rows = t.select("doc_id", textops.unified_diff()(F.col("t").cast("binary"), new.cast("binary")).alias("d"))
    lines = F.split(F.coalesce("d.unified", F.lit("")), "\n")
    count = lambda sign, head: F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(head))))
    return rows.select("doc_id", "d.kind", count("+", "+++ ").alias("added"), count("-", "--- ").alias("removed"))


#: What a merge by line makes of both edits: of a text of several lines both, of one line a conflict in which side A stays.
_BOTH = f"""{_EDITS},
s AS (SELECT doc_id, path, m, t AS x, '{_HEAD}' || chr(10) || t AS a, t || chr(10) || '{_TAIL}' AS b FROM src WHERE t <> ''),
k AS (SELECT *, (contains(rtrim(x, chr(10)), chr(10)) OR ends_with(x, chr(10))) AND strlen(a) < 1048576 AND strlen(b) < 1048576
                AND strlen(a) + strlen(b) - strlen(x) < 1048576 AS merges FROM s),
o AS (SELECT path, m, merges, CASE WHEN merges THEN a || chr(10) || '{_TAIL}' || CASE WHEN ends_with(x, chr(10)) THEN chr(10) ELSE '' END ELSE a END AS r FROM k)"""


def _text_sides(spark, sf_dir) -> tuple[list[DataFrame], DataFrame]:
    """Entries of base, a and b, whose texts differ by a head and a tail, and their contents."""
    docs = Snapshots(spark, sf_dir).src.where("t <> ''")
    texts = [F.col("t"), F.concat(F.lit(f"{_HEAD}\n"), "t"), F.concat("t", F.lit(f"\n{_TAIL}"))]
    sides = [docs.select("path", F.sha2(x, 256).alias("hash"), F.col("m").alias("mtime_ms"), F.octet_length(x).cast("long").alias("size_bytes"), x.cast("binary").alias("data")) for x in texts]
    return [s.drop("data") for s in sides], sides[0].unionByName(sides[1]).unionByName(sides[2]).select("hash", "data")


@query(_BOTH + "SELECT path, sha256(r) AS hash, m AS mtime_ms, CAST(strlen(r) AS BIGINT) AS size_bytes FROM o")
def merge_with_texts(spark, sf_dir):
    """The merge with contents at hand: one side edits the first line, the other the last."""
    sides, blobs = _text_sides(spark, sf_dir)
    return merge.merge_trees(*sides, blobs=blobs).entries


@query(_BOTH + "SELECT CAST(0 AS BIGINT) AS auto_resolved, count(*) FILTER (merges) AS text_merged, count(*) FILTER (NOT merges) AS conflicts FROM o")
def merge_text_counters(spark, sf_dir):
    sides, blobs = _text_sides(spark, sf_dir)
    return merge.merge_trees(*sides, blobs=blobs).metrics


#: Edits within a text: a new line after the first, and the last line deleted.
_INNER = """
l AS (SELECT doc_id, t, string_split(t, chr(10)) AS p FROM src WHERE t <> '' AND NOT ends_with(t, chr(10)) AND NOT contains(t, chr(13)) AND len(string_split(t, chr(10))) >= 4),
u AS (SELECT * FROM l WHERE len(list_distinct(p)) = len(p) AND NOT list_contains(p, 'A LINE BETWEEN'))
"""


@query(_INNER + """SELECT doc_id, 'merged' AS status, sha256(array_to_string(list_concat(list_concat(p[1:1], ['A LINE BETWEEN']), p[2:len(p) - 1]), chr(10))) AS content_sha256 FROM u""")
def text_merge3_inside(spark, sf_dir):
    """One side inserts a line after the first, the other deletes the last, in texts of different lines."""
    p = F.split("t", "\n", -1)
    rows = Snapshots(spark, sf_dir).src.where("t <> ''").where(~F.endswith("t", F.lit("\n")) & ~F.contains("t", F.lit("\r"))).withColumn("p", p)
    rows = rows.where((F.size("p") >= 4) & (F.size(F.array_distinct("p")) == F.size("p")) & ~F.array_contains("p", "A LINE BETWEEN"))
    joined = lambda lines: F.array_join(lines, "\n")
    a = joined(F.concat(F.slice("p", 1, 1), F.array(F.lit("A LINE BETWEEN")), F.slice("p", 2, F.size("p") - 1)))
    b = joined(F.slice("p", 1, F.size("p") - 1))
    rows = rows.select("doc_id", "t", a.alias("a"), b.alias("b")).withColumn("m", textops.text_merge3()("t", "a", "b"))
    return rows.select("doc_id", "m.status", F.sha2("m.content", 256).alias("content_sha256"))


# --- guard, history, dashboard ------------------------------------------------------------------------------------------

_SCAN = """
scan AS (SELECT count(*) FILTER (n.path IS NULL) AS deletions, count(*) FILTER (o.hash <> n.hash) AS content_changes,
         count(*) FILTER (o.hash <> n.hash AND n.mtime_ms + 43200000 < o.mtime_ms) AS mtime_regressions,
         count(*) FILTER (o.path IS NULL) AS additions, count(o.path) AS current_total
         FROM base o FULL OUTER JOIN cand n ON o.path = n.path)
"""
_CAND = "cand AS (SELECT * REPLACE (CASE WHEN doc_id % 14 = 0 THEN mtime_ms - 172800000 ELSE mtime_ms END AS mtime_ms) FROM a),"


def _scan(spark, sf_dir) -> DataFrame:
    s = Snapshots(spark, sf_dir)
    cand = s.full("a").withColumn("mtime_ms", F.when(F.col("doc_id") % 14 == 0, F.col("mtime_ms") - 172_800_000).otherwise(F.col("mtime_ms")))
    return guard.guard_scan(s.base, cand)


@query(_CAND + _SCAN + "SELECT * FROM scan")
def guard_scan(spark, sf_dir):
    return _scan(spark, sf_dir)


@query(_CAND + _SCAN + """SELECT CASE WHEN mtime_regressions > 25 THEN 'mtime_regression' WHEN deletions + content_changes > greatest(200, current_total * 25 // 100) THEN 'blast_radius' END AS usual,
       CASE WHEN mtime_regressions > 100000 THEN 'mtime_regression' WHEN deletions + content_changes > greatest(2, current_total * 10 // 100) THEN 'blast_radius' END AS narrow FROM scan""")
def guard_trigger(spark, sf_dir):
    return _scan(spark, sf_dir).select(guard.guard_reason().alias("usual"), guard.guard_reason(100_000, 10, 2).alias("narrow"))


_DAY = 86_400_000
_ROOTS = f"""roots AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS root_hash,
    sha256(CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR)) AS parent_hash,
    datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * CAST({_DAY} AS BIGINT) AS created_ms, o_orderpriority AS device_id, o_orderkey AS total_files FROM orders)
"""


def _roots(spark, sf_dir) -> DataFrame:
    """Orders as versions: a customer's orders are a chain."""
    from pyspark.sql import Window

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    key = lambda c: F.sha2(c.cast("string"), 256)
    return orders.select(key(F.col("o_orderkey")).alias("root_hash"), key(before).alias("parent_hash"), (F.unix_date(F.to_date("o_orderdate")).cast("long") * _DAY).alias("created_ms"), F.col("o_orderpriority").alias("device_id"), F.col("o_orderkey").alias("total_files"))


_NOW_ROOT = "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b"  # of the first order


@query(f"WITH {_ROOTS} SELECT root_hash, parent_hash, created_ms, device_id, total_files, root_hash = '{_NOW_ROOT}' AS current FROM roots ORDER BY created_ms DESC, root_hash LIMIT 50", ctes=False)
def version_history_topk(spark, sf_dir):
    return history.history(_roots(spark, sf_dir), _NOW_ROOT)


@query(f"WITH {_ROOTS} SELECT root_hash, parent_hash, created_ms, device_id, total_files, root_hash = '{_NOW_ROOT}' AS current FROM roots", ctes=False)
def version_list(spark, sf_dir):
    return history.history(_roots(spark, sf_dir), _NOW_ROOT, limit=None)


@query(f"""WITH RECURSIVE {_ROOTS}, up AS (
  SELECT root_hash, parent_hash, 0 AS depth FROM (SELECT * FROM roots ORDER BY created_ms DESC, root_hash LIMIT 1)
  UNION ALL SELECT r.root_hash, r.parent_hash, up.depth + 1 FROM roots r JOIN up ON r.root_hash = up.parent_hash)
SELECT CAST(depth AS BIGINT) AS depth, root_hash FROM up""", ctes=False)
def lineage(spark, sf_dir):
    roots = _roots(spark, sf_dir)
    return history.lineage(roots, roots.orderBy(F.desc("created_ms"), "root_hash").first().root_hash)


@query("""
v AS (SELECT * FROM (VALUES ('v2', 'a', 'base'), ('v3', 'b', 'base'), ('v4', 'b', 'a')) x(root_hash, new, old)),
e AS (SELECT 'base' AS side, path, hash, size_bytes FROM base UNION ALL SELECT 'a', path, hash, size_bytes FROM a UNION ALL SELECT 'b', path, hash, size_bytes FROM b),
n AS (SELECT root_hash, path, hash, size_bytes FROM v JOIN e ON e.side = v.new), o AS (SELECT root_hash, path, hash FROM v JOIN e ON e.side = v.old)
SELECT coalesce(n.root_hash, o.root_hash) AS root_hash, count(*) AS files, CAST(coalesce(sum(n.size_bytes), 0) AS BIGINT) AS bytes
FROM n FULL OUTER JOIN o ON n.root_hash = o.root_hash AND n.path = o.path WHERE n.hash IS DISTINCT FROM o.hash GROUP BY 1""")
def version_stats(spark, sf_dir):
    s = Snapshots(spark, sf_dir)
    rows = [("v1", None, 1), ("v2", "v1", 2), ("v3", "v1", 3), ("v4", "v2", 4), ("v5", "unknown", 5)]
    roots = spark.createDataFrame(rows, "root_hash string, parent_hash string, created_ms long")
    side = {"v1": s.base, "v2": s.a, "v3": s.b, "v4": s.b, "v5": s.a}
    entries = None
    for root, e in side.items():
        own = e.select(F.lit(root).alias("root_hash"), "path", "hash", "size_bytes")
        entries = own if entries is None else entries.unionByName(own)
    return history.version_stats(roots, entries)


@query("""
o AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'index' ELSE 'content' END AS bucket, strlen(t) AS size FROM src
      UNION ALL SELECT CASE doc_id % 4 WHEN 1 THEN 'manifests' ELSE 'chunks' END, strlen(t) FROM src WHERE doc_id % 4 IN (1, 2)),
s AS (SELECT bucket, sum(size) AS bytes, count(*) AS files FROM o GROUP BY bucket),
n AS (SELECT sum(bytes) AS b, sum(files) AS f FROM s WHERE bucket IN ('manifests', 'chunks'))
SELECT bucket, CAST(CASE WHEN bucket = 'content' THEN greatest(0, bytes - b) ELSE bytes END AS BIGINT) AS bytes,
       CAST(CASE WHEN bucket = 'content' THEN greatest(0, files - f) ELSE files END AS BIGINT) AS files FROM s, n""")
def storage_breakdown(spark, sf_dir):
    src = Snapshots(spark, sf_dir).src.select((F.col("doc_id") % 4).alias("k"), F.octet_length("t").cast("long").alias("size"))
    outer = src.select(F.when(F.col("k") == 0, "index").otherwise("content").alias("bucket"), "size")
    inner = src.where("k IN (1, 2)").select(F.when(F.col("k") == 1, "manifests").otherwise("chunks").alias("bucket"), "size")
    return history.storage_breakdown(outer.unionByName(inner))


_MS = "(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) * CAST(86400000 AS BIGINT) + hour(ts) * 3600000 + minute(ts) * 60000 + CAST(millisecond(ts) AS BIGINT))"


def _events(spark, sf_dir) -> DataFrame:
    """Events with ``ms``, their time as the clock shows it; no time zone comes in."""
    ms = F.unix_date(F.to_date("ts")).cast("long") * _DAY + F.hour("ts") * 3_600_000 + F.minute("ts") * 60_000 + F.floor(F.expr("extract(SECOND FROM ts)") * 1000).cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ms", ms)


_DEVICES = f"d AS (SELECT user_id AS device, max({_MS}) AS last_seen, CASE WHEN user_id % 7 = 0 THEN 1000 WHEN user_id % 11 = 0 THEN 0 END AS revoked_at FROM events GROUP BY user_id), now AS (SELECT max(last_seen) AS now FROM d)"


def _devices(spark, sf_dir) -> tuple[DataFrame, int]:
    rows = _events(spark, sf_dir).groupBy(F.col("user_id").alias("device")).agg(F.max("ms").alias("last_seen"))
    rows = rows.withColumn("revoked_at", F.when(F.col("device") % 7 == 0, 1000).when(F.col("device") % 11 == 0, 0).cast("long"))
    return rows, rows.agg(F.max("last_seen")).first()[0]


@query(f"WITH {_DEVICES} SELECT device, CASE WHEN revoked_at IS NOT NULL THEN 'Revoked' WHEN now - last_seen < 300000 THEN 'Online' ELSE 'Offline' END AS status FROM d, now", ctes=False)
def device_status(spark, sf_dir):
    devices, now = _devices(spark, sf_dir)
    return devices.select("device", history.device_status(now).alias("status"))


@query(f"WITH {_DEVICES} SELECT count(*) AS devices, count(*) FILTER (now - last_seen < 300000) AS online, count(revoked_at) AS revoked FROM d, now", ctes=False)
def fleet_counts(spark, sf_dir):
    return history.fleet_counts(*_devices(spark, sf_dir))


@query(f"WITH {_DEVICES} SELECT device, last_seen, CASE WHEN revoked_at = 0 THEN now ELSE revoked_at END AS revoked_at FROM d, now WHERE revoked_at IS NULL OR revoked_at = 0 OR now - revoked_at < 2592000000", ctes=False)
def ttl_sweep_revoked(spark, sf_dir):
    return history.sweep_revoked(*_devices(spark, sf_dir))


@query("""WITH t AS (SELECT o_orderkey AS id, CAST(1000000 + o_orderkey % 7 AS BIGINT) AS expires_at, CAST(1000000 - 90000 + o_orderkey % 7 AS BIGINT) AS updated_ms FROM orders)
SELECT id, 1000003 > expires_at AS enrollment, 1000003 > expires_at AS ticket, 1000003 >= expires_at AS bypass, 1000003 - updated_ms >= 90000 AS presence FROM t""", ctes=False)
def ttl_edges(spark, sf_dir):
    """What has expired at a moment, each kind by its own edge."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), (1_000_000 + F.col("o_orderkey") % 7).alias("expires_at"), (910_000 + F.col("o_orderkey") % 7).alias("updated_ms"))
    return orders.select("id", *[history.expired(k, 1_000_003).alias(k) for k in ("enrollment", "ticket", "bypass", "presence")])


# --- patterns, names, formats -------------------------------------------------------------------------------------------

CLIENT_PATTERNS = ["# a comment", "", "de/", "*7.md", "src1?", "/en/src0", "es/**/0000??1*", "fr/src2/"]
SERVER_PATTERNS = ["es/", "src3", "*77.md", "en/src0/", "0*1*5.md", "# none"]


@query(r"""SELECT path FROM src WHERE NOT (path LIKE 'de/%' OR path LIKE '%7.md' OR regexp_matches(path, '(^|/)src1[^/](/|$)')
  OR path LIKE 'en/src0/%' OR regexp_matches(path, '^es/.*/0000[^/][^/]1[^/]*(/.*)?$') OR path LIKE 'fr/src2/%')""")
def ignore_filter_client(spark, sf_dir):
    return Snapshots(spark, sf_dir).src.where(~patterns.path_matches("path", CLIENT_PATTERNS, "client")).select("path")


@query(r"""SELECT path, hash FROM base WHERE NOT (path LIKE 'es/%' OR list_contains(string_split(path, '/'), 'src3') OR path LIKE '%77.md'
  OR path LIKE 'en/src0/%' OR regexp_matches(path, '(^|/)0[^/]*1[^/]*5\.md(/|$)'))""")
def purge_filter_server(spark, sf_dir):
    return Snapshots(spark, sf_dir).base.where(~patterns.path_matches("path", SERVER_PATTERNS, "server")).select("path", "hash")


_NAMES = ["a.md", "b.png", "c.sqlite", "d.PNG", "e.tar.gz", ".DS_Store", "thumbs.db", "f.svg", "g.sqlite-wal", "noext", "h.JSON", "i.mp3.bak", "j.excalidraw"]
_NAMED = "n AS (SELECT doc_id, 'd/' || list_extract([" + ", ".join(f"'{x}'" for x in _NAMES) + f"], CAST(doc_id % {len(_NAMES)} AS INT) + 1) AS path FROM src)"


def _named(spark, sf_dir) -> DataFrame:
    names = F.array(*[F.lit(x) for x in _NAMES])
    return Snapshots(spark, sf_dir).src.select("doc_id", F.concat(F.lit("d/"), F.element_at(names, (F.col("doc_id") % len(_NAMES)).cast("int") + 1)).alias("path"))


@query(_NAMED + """SELECT doc_id, CASE WHEN regexp_matches(path, '(\\.sqlite|\\.sqlite-wal|\\.sqlite-shm|/\\.DS_Store|/thumbs\\.db)$') THEN 'local-only'
  WHEN regexp_matches(path, '\\.(png|jpg|jpeg|webp|gif|bmp|svg|pdf|mp3|mp4|wav|ogg|flac|zip|tar|gz)$') THEN 'immutable' ELSE 'conflict-copy' END AS strategy FROM n""".replace("\\\\", "\\"))
def strategy_rules(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", rules.sync_strategy("path").alias("strategy"))


@query(_NAMED + "SELECT doc_id, path FROM n WHERE regexp_matches(lower(path), '[.](md|txt|css|json|js|ts|html|xml|yaml|yml|toml|csv|canvas|excalidraw|svg|tex|bib|org|rst)$')")
def text_files(spark, sf_dir):
    return _named(spark, sf_dir).where(paths.is_text_path("path"))


@query(_NAMED + """SELECT doc_id, CASE WHEN regexp_matches(path, '[^/][.][^./]*$') THEN regexp_replace(path, '[.][^./]*$', '') || ' (conflict My-Mac 2026-07-14 0132)' || regexp_extract(path, '[.][^./]*$')
  ELSE path || ' (conflict My-Mac 2026-07-14 0132)' END AS copy FROM n""")
def conflict_copy_paths(spark, sf_dir):
    when = F.lit("2026-07-14 01:32:00").cast("timestamp")
    return _named(spark, sf_dir).select("doc_id", paths.conflict_copy_path("path", F.lit(" My/Mac "), when).alias("copy"))


@query(_NAMED + "SELECT doc_id, path AS original FROM n WHERE doc_id % 2 = 0")
def find_conflicts(spark, sf_dir):
    """The originals of conflict copies, among copies and other files."""
    when = F.lit("2026-07-14 01:32:00").cast("timestamp")
    copy = paths.conflict_copy_path("path", F.lit("Mac"), when)
    files = _named(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, copy).otherwise(F.col("path")).alias("file"))
    return files.select("doc_id", paths.conflict_original("file").alias("original")).where("original IS NOT NULL")


@query("""SELECT path, regexp_extract(path, '^[^/]*/') AS prefix, list_extract(string_split(path, '/'), -1) AS name, lower(list_extract(string_split(path, '.'), -1)) AS ext,
  len(string_split(path, '/')) AS depth, substr(path, 1, 12) AS short FROM src""")
def path_functions(spark, sf_dir):
    p = Snapshots(spark, sf_dir).src.select("path")
    return p.select("path", paths.top_prefix("path").alias("prefix"), paths.basename("path").alias("name"), paths.extension("path").alias("ext"), F.size(paths.segments("path")).cast("long").alias("depth"), paths.short_id("path").alias("short"))


@query("""WITH v AS (SELECT o_orderkey AS id, CAST(o_orderkey * o_orderkey * 977 AS BIGINT) AS n, CAST(o_orderkey * 37 AS BIGINT) AS s FROM orders)
SELECT id, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0)
             WHEN n >= 1024 THEN CAST(n // 1024 AS VARCHAR) || ' KB' ELSE CAST(n AS VARCHAR) || ' B' END AS bytes,
  CASE WHEN s = 0 THEN 'never' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || ' min ago' WHEN s < 86400 THEN s // 3600 || ' hours ago' ELSE s // 86400 || ' days ago' END AS ago,
  CASE WHEN s >= 86400 THEN s // 86400 || 'd ' || s % 86400 // 3600 || 'h' WHEN s >= 3600 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' WHEN s >= 60 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s || 's' END AS took
FROM v""", ctes=False)
def format_values(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * F.col("o_orderkey") * 977).alias("n"), (F.col("o_orderkey") * 37).alias("s"))
    now = 1_800_000_000_000
    return v.select("id", formats.format_bytes("n").alias("bytes"), formats.format_ago(F.when(F.col("s") == 0, 0).otherwise(now - F.col("s") * 1000), now).alias("ago"), formats.format_duration("s").alias("took"))


# --- sets and scans -----------------------------------------------------------------------------------------------------

_ASKED = "asked AS (SELECT doc_id AS ord, CASE WHEN doc_id % 9 = 0 THEN 'not a hash' WHEN doc_id % 5 = 0 THEN upper(hash) ELSE hash END AS hash FROM a)"


@query(_ASKED + "SELECT ord, hash FROM asked WHERE regexp_full_match(hash, '[0-9a-fA-F]{64}') AND lower(hash) NOT IN (SELECT hash FROM base)")
def missing_objects(spark, sf_dir):
    s = Snapshots(spark, sf_dir)
    asked = s.full("a").select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 9 == 0, "not a hash").when(F.col("doc_id") % 5 == 0, F.upper("hash")).otherwise(F.col("hash")).alias("hash"))
    return scan.missing(asked, s.base)


@query("SELECT hash, min_by(path, doc_id) AS path FROM a WHERE hash NOT IN (SELECT hash FROM base) GROUP BY hash")
def dedup_by_hash(spark, sf_dir):
    s = Snapshots(spark, sf_dir)
    return scan.reconcile(s.full("a").select("hash", "path", F.col("doc_id").alias("ord")), s.base)


_STATE = """
sync AS (SELECT path, hash, mtime_ms AS mtime, size_bytes AS size, CASE WHEN doc_id % 4 = 0 THEN mtime_ms + 1 END AS tree_mtime FROM base),
stats AS (SELECT path, mtime_ms AS mtime, size_bytes AS size FROM a), ig AS (SELECT path FROM src WHERE path LIKE '%3.md')
"""
_IGNORE = ["*3.md"]
_UP = "SELECT CASE WHEN s.path IS NULL THEN 'created' ELSE 'modified' END AS action, a.path, a.hash, a.mtime_ms AS mtime, a.size_bytes AS size FROM a LEFT JOIN sync s USING (path) WHERE a.path NOT LIKE '%3.md' AND (s.path IS NULL OR ((s.mtime <> a.mtime_ms OR s.size <> a.size_bytes) AND s.hash <> a.hash))"
_LAST = 1_700_000_300_000


def _state(spark, sf_dir) -> tuple[Snapshots, DataFrame, DataFrame, DataFrame]:
    """Snapshots, sync base, file stats and contents."""
    s = Snapshots(spark, sf_dir)
    sync = s.full("base").select("path", "hash", F.col("mtime_ms").alias("mtime"), F.col("size_bytes").alias("size"), F.when(F.col("doc_id") % 4 == 0, F.col("mtime_ms") + 1).alias("tree_mtime"))
    disk = s.full("a")
    return s, sync, disk.select("path", F.col("mtime_ms").alias("mtime"), F.col("size_bytes").alias("size")), disk.select("path", F.col("content").alias("data"))


@query(_STATE + f"{_UP} UNION ALL SELECT 'deleted', path, NULL, NULL, NULL FROM sync WHERE path NOT LIKE '%3.md' AND path NOT IN (SELECT path FROM stats)")
def full_scan_changes(spark, sf_dir):
    _, sync, stats, contents = _state(spark, sf_dir)
    return scan.full_scan(stats, sync, contents, _IGNORE)


@query(_STATE + f"{_UP} AND a.mtime_ms > {_LAST}")
def partial_scan_changes(spark, sf_dir):
    _, sync, stats, contents = _state(spark, sf_dir)
    return scan.partial_scan(stats, sync, contents, _LAST, _IGNORE)


_JOURNAL = """j AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS action, path, m AS ts, doc_id % 3 = 0 AS synced FROM src)"""


def _journal(s: Snapshots) -> DataFrame:
    k = F.col("doc_id") % 5
    return s.src.select(F.when(k == 0, "created").when(k == 1, "deleted").when(k == 2, "renamed").otherwise("modified").alias("action"), "path", F.col("m").alias("ts"), (F.col("doc_id") % 3 == 0).alias("synced"))


@query(_JOURNAL + """SELECT ts, action, path, CAST(NULL AS VARCHAR) AS hash FROM j WHERE NOT synced AND action = 'deleted'
UNION ALL SELECT ts, CASE action WHEN 'created' THEN 'created' ELSE 'modified' END, path, a.hash FROM j JOIN a USING (path) WHERE NOT synced AND action <> 'deleted'""")
def journal_replay(spark, sf_dir):
    s, _, _, contents = _state(spark, sf_dir)
    return scan.journal_replay(_journal(s), contents)


@query(_JOURNAL + "SELECT path FROM j WHERE NOT synced UNION SELECT path FROM a WHERE doc_id % 13 = 1")
def unsynced_paths(spark, sf_dir):
    s = Snapshots(spark, sf_dir)
    return scan.unsynced_paths(s.full("a").where(F.col("doc_id") % 13 == 1), _journal(s))


@query(_JOURNAL + "SELECT action, path, ts, synced FROM j ORDER BY ts DESC, path DESC LIMIT 10000")
def journal_tail(spark, sf_dir):
    return logs.journal_tail(_journal(Snapshots(spark, sf_dir)))


_TIERS = _STATE + """,
want AS (SELECT b.path, b.hash, b.size_bytes FROM base x FULL OUTER JOIN b ON x.path = b.path WHERE b.hash IS NOT NULL AND b.hash IS DISTINCT FROM x.hash
         UNION ALL SELECT path, hash, size_bytes FROM base WHERE doc_id % 6 = 0),
tier AS (SELECT w.path, w.hash, CASE WHEN d.path IS NOT NULL AND s.hash = w.hash AND s.mtime = d.mtime_ms AND s.size = d.size_bytes THEN 'cache' WHEN d.hash = w.hash THEN 'local' ELSE 'download' END AS tier,
         CAST(coalesce(nullif(w.size_bytes, 0), CASE WHEN d.path IS NOT NULL AND (d.hash = w.hash OR (s.hash = w.hash AND s.mtime = d.mtime_ms AND s.size = d.size_bytes)) THEN d.size_bytes END, 0) AS BIGINT) AS bytes
         FROM want w LEFT JOIN a d USING (path) LEFT JOIN sync s USING (path))
"""


def _tiers(spark, sf_dir) -> DataFrame:
    s, sync, stats, contents = _state(spark, sf_dir)
    deltas = diff.compute_deltas(s.base, s.b).where("action <> 'deleted'")
    again = s.full("base").where(F.col("doc_id") % 6 == 0).select(F.lit("modified").alias("action"), "path", F.lit(None).cast("string").alias("old_path"), "hash", F.col("size_bytes").alias("size"), "mtime_ms")
    return scan.pull_tiers(deltas.unionByName(again), stats, sync, contents)


@query(_TIERS + "SELECT * FROM tier")
def pull_tiers(spark, sf_dir):
    return _tiers(spark, sf_dir)


@query(_TIERS + "SELECT tier, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM tier GROUP BY tier")
def pull_stats(spark, sf_dir):
    return scan.pull_stats(_tiers(spark, sf_dir))


_D = f"d AS ({_DELTAS.format(old='base', new='b')})"


@query(_D + "SELECT action, path, CASE WHEN path NOT LIKE '%3.md' THEN 'kept' WHEN action = 'deleted' THEN 'ignored_delete' ELSE 'ignored_upsert' END AS bucket FROM d")
def split_ignored(spark, sf_dir):
    s = Snapshots(spark, sf_dir)
    return scan.split_ignored(diff.compute_deltas(s.base, s.b), _IGNORE).select("action", "path", "bucket")


@query(_D + "SELECT action, path FROM d WHERE path NOT IN (SELECT path FROM src WHERE doc_id % 8 = 0) AND path NOT IN (SELECT path FROM src WHERE doc_id % 9 = 1)")
def exclude_deltas(spark, sf_dir):
    """Deltas without the failed ones and without those that local edits defer."""
    s = Snapshots(spark, sf_dir)
    d = diff.compute_deltas(s.base, s.b)
    failed = d.join(s.src.where(F.col("doc_id") % 8 == 0).select("path"), "path", "left_semi")
    return scan.defer_edited(scan.exclude_deltas(d, failed), s.src.where(F.col("doc_id") % 9 == 1)).select("action", "path")


@query("SELECT CASE WHEN doc_id % 17 = 0 THEN 'moved/' || path ELSE path END AS path FROM base UNION ALL SELECT path FROM base WHERE doc_id % 17 = 0")
def delta_paths(spark, sf_dir):
    s = Snapshots(spark, sf_dir)
    moved = F.col("doc_id") % 17 == 0
    d = s.full("base").select(F.when(moved, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path")).alias("path"), F.when(moved, F.col("path")).alias("old_path"))
    return scan.delta_paths(d)


@query(_STATE + """
SELECT path, hash, coalesce(tree_mtime, mtime) AS mtime_ms, size AS size_bytes FROM sync WHERE path NOT IN (SELECT path FROM base WHERE path NOT IN (SELECT path FROM b))
  AND path NOT IN (SELECT b.path FROM b JOIN base x USING (path) WHERE b.hash <> x.hash)
UNION ALL SELECT b.path, b.hash, b.mtime_ms, b.size_bytes FROM b LEFT JOIN base x USING (path) WHERE x.hash IS DISTINCT FROM b.hash""")
def rebase_tree(spark, sf_dir):
    s, sync, _, _ = _state(spark, sf_dir)
    return scan.rebase_tree(scan.rebase_entries(sync), diff.compute_deltas(s.base, s.b), sync, 0)


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS blocked, CASE WHEN o_orderkey % 4 <> 0 THEN 'r' END AS base_root, CASE WHEN o_orderkey % 5 <> 0 THEN 's' END AS server_root,
  o_orderkey % 10000 AS base_files, o_orderkey % 10000 + (o_orderkey % 41) - 20 AS tree_files FROM orders)
SELECT id, CASE WHEN blocked THEN 'blocked' WHEN base_root IS NULL AND server_root IS NOT NULL AND base_files > 0 THEN 'no_base'
  WHEN tree_files >= 0 AND abs(tree_files - base_files) > greatest(8, ceil(base_files * 0.005)) THEN 'diverged' END AS reason, base_root = server_root AS parity FROM t""", ctes=False)
def publish_guards(spark, sf_dir):
    k = F.col("o_orderkey")
    base, server = F.when(k % 4 != 0, "r"), F.when(k % 5 != 0, "s")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(k.alias("id"), scan.publish_guard(k % 10000 + k % 41 - 20, k % 10000, k % 3 == 0, base, server).alias("reason"), scan.parity(base, server).alias("parity"))


@query("SELECT path, mtime_ms AS mtime, size_bytes AS size, doc_id AS ord FROM a ORDER BY size DESC, ord")
def upload_priority(spark, sf_dir):
    changes = Snapshots(spark, sf_dir).full("a").select("path", F.col("mtime_ms").alias("mtime"), F.col("size_bytes").alias("size"), F.col("doc_id").alias("ord"))
    return scan.upload_order(changes, "biggest")


@query("SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS taken FROM src")
def verified_puts(spark, sf_dir):
    """Objects put under their hash, under another one, and under no hash at all."""
    k = F.col("doc_id")
    puts = Snapshots(spark, sf_dir).src.select("doc_id", F.when(k % 4 == 0, F.lit(ZERO_HASH)).when(k % 5 == 0, "x").otherwise(F.sha2("t", 256)).alias("hash"), F.col("t").cast("binary").alias("data"))
    good, bad = hashing.verify_puts(puts)
    return good.select("doc_id", F.lit(True).alias("taken")).unionByName(bad.select("doc_id", F.lit(False).alias("taken")))


@query(f"SELECT {ENTRIES} FROM a ORDER BY path")
def export_snapshot(spark, sf_dir):
    return Snapshots(spark, sf_dir).a.orderBy("path")


@query(_MERGE + "SELECT regexp_replace(path, '[.]md$', ' (conflict Mac 2026-07-14 0132).md') AS path, b AS hash FROM t WHERE counted = 'conflict'")
def conflict_preservation(spark, sf_dir):
    """The losing sides of conflicts under the names of their copies."""
    when = F.lit("2026-07-14 01:32:00").cast("timestamp")
    return _merged(spark, sf_dir).conflicts.select(paths.conflict_copy_path("path", F.lit("Mac"), when).alias("path"), F.col("side_b_hash").alias("hash"))


# --- chunks -------------------------------------------------------------------------------------------------------------

_SIZES = (256, 1024, 4096)


@query("SELECT DISTINCT sha256(t) AS file_hash, strlen(t) AS total_size, true AS contiguous, true AS bounded FROM src WHERE t <> ''")
def chunk_documents(spark, sf_dir):
    files = Snapshots(spark, sf_dir).src.select(F.col("t").cast("binary").alias("data")).where("octet_length(data) > 0").distinct()
    m = chunking.manifests(chunking.chunk_files(files, *_SIZES))
    ends = F.transform("chunks", lambda c: c["offset"] + c["size"])
    starts = F.transform("chunks", lambda c: c["offset"])
    whole = F.concat(F.array(F.lit(0).cast("long")), ends) == F.concat(starts, F.array("total_size"))
    sized = F.forall(F.slice("chunks", 1, F.greatest(F.size("chunks") - 1, F.lit(0))), lambda c: c["size"].between(_SIZES[0], _SIZES[2]))
    return m.select("file_hash", "total_size", whole.alias("contiguous"), (sized & (F.element_at("chunks", -1)["size"] <= _SIZES[2])).alias("bounded"))


@query("SELECT DISTINCT sha256(t) AS file_hash, sha256(t) AS data_hash FROM src WHERE t <> ''")
def reassemble_roundtrip(spark, sf_dir):
    files = Snapshots(spark, sf_dir).src.select(F.col("t").cast("binary").alias("data")).where("octet_length(data) > 0").distinct()
    chunks = chunking.chunk_files(files, *_SIZES)
    return chunking.reassemble(chunking.manifests(chunks), chunks).select("file_hash", F.sha2("data", 256).alias("data_hash"))


@query("SELECT DISTINCT sha256(t) AS hash, sha256(t) AS data_hash FROM src WHERE t <> ''")
def content_with_manifests(spark, sf_dir):
    """Contents from blobs, or from their manifest where there is no blob."""
    files = Snapshots(spark, sf_dir).src.select(F.sha2("t", 256).alias("hash"), F.col("t").cast("binary").alias("data")).where("octet_length(data) > 0").dropDuplicates(["hash"])
    small = F.octet_length("data") < 4096
    chunks = chunking.chunk_files(files.where(~small), *_SIZES)
    whole = chunking.reassemble(chunking.manifests(chunks), chunks, verify=False)
    return tables.content(files, files.where(small), whole).select("hash", F.sha2("data", 256).alias("data_hash"))


@query()
def chunk_similarity(spark, sf_dir):
    """How many chunks an edit leaves: each text cut into chunks, before and after a tail is added to it."""
    src = Snapshots(spark, sf_dir).src.where("t <> ''")
    a, b = (chunking.chunk_files(src.select(x.cast("binary").alias("data")), *_SIZES) for x in (F.col("t"), F.concat("t", F.lit(_TAIL))))
    return chunking.chunk_similarity(a, b)


@query("""
s AS (SELECT doc_id, t, unnest([{'pos': 0, 'o': 0, 'n': 10}, {'pos': 1, 'o': 5, 'n': 20}, {'pos': 2, 'o': 1000000, 'n': 3}]) AS s FROM src)
SELECT doc_id, CAST(s.pos AS BIGINT) AS pos, sha256(unhex(CASE WHEN s.o + s.n <= strlen(t) THEN substr(hex(encode(t)), 2 * s.o + 1, 2 * s.n) ELSE '' END)) AS hash FROM s""")
def batch_hashes(spark, sf_dir):
    part = lambda o, n: F.struct(F.lit(o).alias("offset"), F.lit(n).alias("size"))
    rows = Snapshots(spark, sf_dir).src.select("doc_id", F.col("t").cast("binary").alias("data"), F.array(part(0, 10), part(5, 20), part(1_000_000, 3)).alias("slices"))
    return hashing.batch_hashes(rows)


@query("SELECT doc_id, CAST(sum(strlen(t)) OVER (PARTITION BY top ORDER BY doc_id) - strlen(t) AS BIGINT) AS \"offset\" FROM src")
def chunk_offsets(spark, sf_dir):
    """Running offsets of contents that are laid one behind the other, by folder."""
    src = Snapshots(spark, sf_dir).src.select("doc_id", "top", F.octet_length("t").cast("long").alias("size"))
    return ranges.running_total(src, "top", "doc_id", F.col("size"), "offset").select("doc_id", "offset")


# --- logs ---------------------------------------------------------------------------------------------------------------

_EV = f"e AS (SELECT event_id, user_id AS device, user_id % 5 AS vault, event_type AS state, {_MS} AS ms, CAST(props->>'$.k' AS VARCHAR) AS file FROM events), now AS (SELECT max(ms) AS now FROM e)"
_TTL = 3_600_000


def _frames(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select((F.col("user_id") % 5).alias("vault"), F.col("user_id").alias("device"), F.lit("n").alias("name"), F.get_json_object("props", "$.k").alias("file"), F.col("event_type").alias("state"), F.col("ms").alias("updated_ms"), F.col("event_id").alias("seq"))


@query(f"""WITH {_EV}, l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY vault, device ORDER BY ms DESC, event_id DESC) = 1)
SELECT vault, device, 'n' AS name, file, state, ms AS updated_ms FROM l, now WHERE now - ms < {_TTL}""", ctes=False)
def presence_ttl(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    return logs.presence(frames, frames.agg(F.max("updated_ms")).first()[0], _TTL)


@query(f"""WITH {_EV}, l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY vault, device ORDER BY ms DESC, event_id DESC) = 1)
SELECT vault, count(DISTINCT device) AS peers FROM l, now WHERE now - ms < 86400000 AND device <> 1 AND state = 'click' GROUP BY vault""", ctes=False)
def active_peers(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    live = logs.presence(frames, frames.agg(F.max("updated_ms")).first()[0], _DAY)
    return logs.active_peers(live.withColumn("state", F.when(F.col("state") == "click", "active").otherwise("idle")), 1)


@query(f"WITH {_EV} SELECT event_id AS seq, device FROM e WHERE device <> 1", ctes=False)
def suppress_echoes(spark, sf_dir):
    return logs.suppress_echoes(_frames(spark, sf_dir), 1).select("seq", "device")


@query(f"""WITH {_EV}, g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w < 3600000 THEN 0 ELSE 1 END AS first FROM e WINDOW w AS (PARTITION BY device ORDER BY ms, event_id)),
r AS (SELECT *, sum(first) OVER (PARTITION BY device ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT device, min(ms) AS started, max(ms) + 3600000 AS fired, count(*) AS events FROM r GROUP BY device, run""", ctes=False)
def debounce_sessions(spark, sf_dir):
    e = _frames(spark, sf_dir).withColumn("at", F.timestamp_millis("updated_ms"))
    return logs.debounce(e, "device", "at", "1 hour").select("device", F.unix_millis("started").alias("started"), F.unix_millis("fired").alias("fired"), "events")


@query(f"""WITH RECURSIVE {_EV}, o AS (SELECT device, ms FROM e), t AS (
  SELECT device, min(ms) AS ms FROM o GROUP BY device
  UNION ALL SELECT t.device, (SELECT min(o.ms) FROM o WHERE o.device = t.device AND o.ms >= t.ms + {TOUCH_MS * 1000}) FROM t WHERE t.ms IS NOT NULL)
SELECT device, ms AS updated_ms FROM t WHERE ms IS NOT NULL""", ctes=False)
def touch_throttle(spark, sf_dir):
    return logs.throttle(_frames(spark, sf_dir), "device", "updated_ms", TOUCH_MS * 1000)


@query(f"""WITH {_EV}, g AS (SELECT *, CASE WHEN state = lag(state) OVER w THEN 0 ELSE 1 END AS first FROM e WINDOW w AS (PARTITION BY device ORDER BY ms, event_id)),
r AS (SELECT *, sum(first) OVER (PARTITION BY device ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM g)
SELECT device, CAST(run AS BIGINT) AS run, state, count(*) - 1 AS repeats FROM r GROUP BY ALL""", ctes=False)
def run_collapse(spark, sf_dir):
    return logs.collapse_runs(_frames(spark, sf_dir), "device", ["updated_ms", "seq"], "state")


@query("""SELECT 'v' AS vault, sha256(top || source) AS note_key, CASE WHEN strlen(t) <= 4194304 THEN row_number() OVER (PARTITION BY top || source, strlen(t) <= 4194304 ORDER BY doc_id) - 1 END AS seq,
  sha256(t) AS update_hash, strlen(t) > 4194304 AS refused FROM src WHERE t <> ''""")
def oplog_frames(spark, sf_dir):
    """Logs written and split again: each note's updates come back in order; those too large for a log are rows, too."""
    src = Snapshots(spark, sf_dir).src
    updates = src.select(F.lit("v").alias("vault"), F.sha2(F.concat("top", "source"), 256).alias("note_key"), F.col("doc_id").alias("seq"), F.col("t").cast("binary").alias("update"))
    good, large = logs.accepted(updates)
    told = lambda rows, seq, refused: rows.select("vault", "note_key", seq.alias("seq"), F.sha2("update", 256).alias("update_hash"), F.lit(refused).alias("refused"))
    return told(logs.decode_log(logs.encode_log(good)), F.col("seq"), False).unionByName(told(large, F.lit(None).cast("long"), True))


# --- stores and small functions -----------------------------------------------------------------------------------------


@query("SELECT hash, min(size_bytes) AS size FROM (SELECT hash, size_bytes FROM base UNION ALL SELECT hash, size_bytes FROM a) GROUP BY hash")
def object_store_put(spark, sf_dir):
    """A store by hash after more objects are put into it: each content once."""
    s = Snapshots(spark, sf_dir)
    store = tables.put_objects(s.blobs("a"), tables.put_objects(s.blobs("base"), s.blobs("base").where("false")))
    return store.select("hash", F.octet_length("data").cast("long").alias("size"))


@query("SELECT doc_id, substr(sha256(t), 1, 2) || '/' || substr(sha256(t), 3) AS object_path FROM src")
def object_paths(spark, sf_dir):
    return Snapshots(spark, sf_dir).src.select("doc_id", F.sha2("t", 256).alias("hash")).select("doc_id", tables.object_path("hash").alias("object_path"))


_TOKENS = "k AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(sha256(t)) WHEN 1 THEN substr(sha256(t), 2) WHEN 2 THEN 'g' || substr(sha256(t), 2) ELSE sha256(t) END AS token FROM src)"


@query(_TOKENS + "SELECT doc_id, regexp_full_match(token, '[0-9a-fA-F]{64}') AS valid FROM k")
def hash_validation(spark, sf_dir):
    h, k = F.sha2("t", 256), F.col("doc_id") % 4
    token = F.when(k == 0, F.upper(h)).when(k == 1, F.substring(h, 2, 64)).when(k == 2, F.concat(F.lit("g"), F.substring(h, 2, 64))).otherwise(h)
    return Snapshots(spark, sf_dir).src.select("doc_id", paths.is_hash(token).alias("valid"))


@query("""SELECT doc_id, CASE WHEN length(t) > 40 THEN substr(t, 1, 40) || '…[truncated]' ELSE t END AS short,
  replace(replace(replace(replace(replace(substr(t, 1, 30) || '<a & "b">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped,
  len(list_filter(list_transform(string_split(replace(source || ', x ,,' || lang, ',', chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS patterns,
  CASE WHEN doc_id % 3 > 0 THEN length(t) * 1000.0 / (doc_id % 3) END AS rate FROM src""")
def text_helpers(spark, sf_dir):
    src, ms = Snapshots(spark, sf_dir).src, F.col("doc_id") % 3
    listed = paths.pattern_list(F.concat("source", F.lit(", x ,,"), "lang"))
    raw = F.concat(F.substring("t", 1, 30), F.lit('<a & "b">'))
    return src.select("doc_id", formats.truncate_text("t", 40).alias("short"), paths.html_escape(raw).alias("escaped"), F.size(listed).cast("long").alias("patterns"), formats.rate(F.length("t"), ms).alias("rate"))


@query("SELECT doc_id, path FROM src WHERE NOT (path LIKE 'de/%' OR path LIKE '%3.md')")
def excluded_paths(spark, sf_dir):
    """Files that a scan looks at: neither in the system's own folders nor ignored."""
    return Snapshots(spark, sf_dir).src.where(~scan.excluded("path", _IGNORE, ["de/"])).select("doc_id", "path")


@query("SELECT CAST(o_custkey AS VARCHAR) AS vault, CAST(o_orderkey AS VARCHAR) AS root FROM orders", ctes=False)
def root_changes(spark, sf_dir):
    """A frame for each move of a current version, written and read as JSON."""
    from palimpsest.streaming import presence

    moves = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("vault"), F.col("o_orderkey").cast("string").alias("root_hash"))
    return presence.frames(presence.root_changes(moves), "me").select("vault", "root")


@query("""SELECT 'v' AS vault, sha256(top || source) AS note_key, CAST(sum(strlen(t)) AS BIGINT) AS bytes, sum(strlen(t)) > 4194304 AS refused,
  CASE WHEN sum(strlen(t)) <= 4194304 THEN 1 ELSE count(*) FILTER (t <> '') END AS frames,
  CASE WHEN sum(strlen(t)) <= 4194304 THEN sha256(string_agg(t, '' ORDER BY doc_id)) END AS update_hash FROM src GROUP BY top, source""")
def oplog_compaction(spark, sf_dir):
    """Each note's log after its compaction, a note being all texts of a folder and source: one frame of all its contents,
    split again; a note above 4 MiB is refused and keeps the frames that it has."""
    src = Snapshots(spark, sf_dir).src
    updates = src.select(F.lit("v").alias("vault"), F.sha2(F.concat("top", "source"), 256).alias("note_key"), F.col("doc_id").alias("seq"), F.col("t").cast("binary").alias("update"))
    done = staged(logs.compact_notes(updates))
    one = logs.decode_log(done.where("NOT refused")).select("note_key", F.sha2("update", 256).alias("update_hash"))
    return done.drop("log").join(one, "note_key", "left")


@query("""SELECT 'v' AS vault, sha256(path) AS note_key, CAST(strlen(t) AS BIGINT) AS bytes, strlen(t) > 4194304 AS refused,
  CASE WHEN strlen(t) <= 4194304 THEN sha256(t) END AS update_hash FROM src""")
def oplog_note_compaction(spark, sf_dir):
    """Each document's log, whose updates are pieces of it, as one frame, split again; refused notes are rows, too."""
    src = Snapshots(spark, sf_dir).src
    pieces = src.select(F.sha2("path", 256).alias("note_key"), F.posexplode_outer(F.regexp_extract_all("t", F.lit("(?s).{1,4096}"), F.lit(0))).alias("seq", "piece"))
    done = staged(logs.compact_notes(pieces.select(F.lit("v").alias("vault"), "note_key", "seq", F.coalesce("piece", F.lit("")).cast("binary").alias("update"))))
    good = logs.decode_log(done.where("NOT refused")).select("vault", "note_key", F.octet_length("update").cast("long").alias("bytes"), F.lit(False).alias("refused"), F.sha2("update", 256).alias("update_hash"))
    return good.unionByName(done.where("refused").select("vault", "note_key", "bytes", "refused", F.lit(None).cast("string").alias("update_hash")))


# --- a vault on disk ----------------------------------------------------------------------------------------------------


def _vault(spark, sf_dir, **how) -> tuple[Vault, Snapshots, str]:
    """A vault in a folder of its own that holds the base snapshot, and its root."""
    s = Snapshots(spark, sf_dir)
    vault = Vault(spark, f"{shared_dir(spark)}/vault", LEAF, **how)
    return vault, s, vault.push(s.base, None, "first", 1).root_hash


@query(_DELTAS.format(old="base", new="a"))
def vault_diff(spark, sf_dir):
    """Two pushes, and the difference of their versions from the folders that differ."""
    vault, s, first = _vault(spark, sf_dir)
    return vault.diff(first, vault.push(s.a, first, "laptop", 2).root_hash)


@query(_MERGE + """SELECT path, CASE take WHEN 'base' THEN x WHEN 'a' THEN a ELSE b END AS hash, CASE take WHEN 'base' THEN xm WHEN 'a' THEN am ELSE bm END AS mtime_ms,
       CASE take WHEN 'base' THEN xs WHEN 'a' THEN az ELSE bs END AS size_bytes FROM t WHERE take IS NOT NULL""")
def vault_push_merge(spark, sf_dir):
    """A push from an old version is merged with the current one, folder by folder."""
    vault, s, first = _vault(spark, sf_dir)
    vault.push(s.a, first, "laptop", 2)
    return vault.snapshot(vault.push(s.b, first, "phone", 3).root_hash)


@query(_MERGE + f"SELECT path, coalesce(x, '{ZERO_HASH}') AS base_hash, a AS side_a_hash, b AS side_b_hash FROM t WHERE counted = 'conflict'")
def vault_push_conflicts(spark, sf_dir):
    vault, s, first = _vault(spark, sf_dir)
    vault.push(s.a, first, "laptop", 2)
    return vault.push(s.b, first, "phone", 3).conflicts


@query("""
v AS (SELECT * FROM (VALUES (2, 'a', 'base'), (3, 'b', 'a')) x(created_ms, new, old)),
e AS (SELECT 'base' AS side, path, hash, size_bytes FROM base UNION ALL SELECT 'a', path, hash, size_bytes FROM a UNION ALL SELECT 'b', path, hash, size_bytes FROM b),
n AS (SELECT created_ms, path, hash, size_bytes FROM v JOIN e ON e.side = v.new), o AS (SELECT created_ms, path, hash FROM v JOIN e ON e.side = v.old)
SELECT CAST(coalesce(n.created_ms, o.created_ms) AS BIGINT) AS created_ms, count(*) AS files, CAST(coalesce(sum(n.size_bytes), 0) AS BIGINT) AS bytes
FROM n FULL OUTER JOIN o ON n.created_ms = o.created_ms AND n.path = o.path WHERE n.hash IS DISTINCT FROM o.hash GROUP BY 1""")
def vault_version_stats(spark, sf_dir):
    """What each version of a vault changed, from the folders whose hashes differ from the parent's."""
    vault, s, first = _vault(spark, sf_dir)
    second = vault.push(s.a, first, "laptop", 2).root_hash
    vault.push(s.b, second, "laptop", 3)
    return vault.version_stats().join(vault.roots().select("root_hash", "created_ms"), "root_hash").select("created_ms", "files", "bytes")


@query(f"SELECT {ENTRIES} FROM base")
def vault_rollback(spark, sf_dir):
    """After a rollback the first version's entries are current."""
    vault, s, first = _vault(spark, sf_dir)
    vault.push(s.a, first, "laptop", 2)
    vault.rollback(first)
    return vault.snapshot()


@query(rf"""SELECT {ENTRIES} FROM base WHERE NOT (path LIKE 'es/%' OR list_contains(string_split(path, '/'), 'src3') OR path LIKE '%77.md'
  OR path LIKE 'en/src0/%' OR regexp_matches(path, '(^|/)0[^/]*1[^/]*5\.md(/|$)'))""")
def vault_purge(spark, sf_dir):
    vault, _, _ = _vault(spark, sf_dir)
    vault.purge(SERVER_PATTERNS, 2)
    return vault.snapshot()


@query("""
d AS (SELECT count(*) FILTER (n.path IS NULL) AS deletions, count(*) FILTER (o.hash <> n.hash) AS content_changes FROM base o FULL OUTER JOIN (SELECT * FROM base WHERE path LIKE 'de/%') n ON o.path = n.path)
SELECT 'blast_radius' AS reason, deletions, content_changes, true AS stays, true AS taken_when_approved, true AS once FROM d""")
def vault_guard_enforced(spark, sf_dir):
    """A push that drops most files is refused and changes nothing; with an approval it is taken, once."""
    vault, s, first = _vault(spark, sf_dir, guard_mode="enforce", guard_limits={"floor": 2})
    few = s.base.where("path LIKE 'de/%'")
    told, stays, taken, once = None, False, False, False
    try:
        vault.push(few, first, "old", 2)
    except GuardRejected as e:
        told, stays = e.scan, vault.current() == first
    vault.approve_bulk_change("old", 3)
    second = vault.push(few, first, "old", 4).root_hash
    taken = vault.current() == second
    try:
        vault.push(s.base.limit(0), second, "old", 5)
    except GuardRejected:
        once = True
    row = (told.reason, told.deletions, told.content_changes, stays, taken, once)
    return spark.createDataFrame([row], "reason string, deletions long, content_changes long, stays boolean, taken_when_approved boolean, once boolean")


@query("SELECT path, sha256(content) AS data_hash, mtime_ms, size_bytes FROM a")
def vault_export(spark, sf_dir):
    """A version with its contents, small ones from blobs and large ones from their chunks."""
    vault, s, first = _vault(spark, sf_dir)
    blobs = s.blobs("a").dropDuplicates(["hash"])
    small = F.octet_length("data") < 4096
    vault.put_blobs(blobs.where(small))
    chunks = staged(chunking.chunk_files(blobs.where(~small), *_SIZES))
    vault.put_chunks(chunking.manifests(chunks), chunks)
    root = vault.push(s.a, first, "laptop", 2).root_hash
    return vault.export(root).select("path", F.sha2("data", 256).alias("data_hash"), "mtime_ms", "size_bytes")


@query("SELECT doc_id AS ord, hash FROM a WHERE hash NOT IN (SELECT hash FROM base)")
def vault_missing(spark, sf_dir):
    vault, s, _ = _vault(spark, sf_dir)
    vault.put_blobs(s.blobs("base"))
    return vault.missing(s.full("a").select(F.col("doc_id").alias("ord"), "hash"))


# --- devices, frames, JSON ------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id % 7 END AS device_id FROM src""")
def token_lookup(spark, sf_dir):
    """Whose a token is: known ones, unknown ones and such that are none."""
    src, k = Snapshots(spark, sf_dir).src, F.col("doc_id")
    devices = spark.range(7).select(F.concat(F.lit("d"), "id").alias("device_id"), F.sha2(F.col("id").cast("string"), 256).alias("bearer_token"))
    token = F.when(k % 3 == 0, F.sha2((k % 7).cast("string"), 256)).when(k % 3 == 1, F.sha2(k.cast("string"), 224)).otherwise(F.sha2(F.concat(F.lit("x"), k.cast("string")), 256))
    return registry.lookup_tokens(src.select("doc_id", token.alias("token")), devices).select("doc_id", "device_id")


@query("""WITH c AS (SELECT o_orderkey AS seq, o_custkey AS ticket, 1000 + o_orderkey % 11 AS at_ms FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY ticket ORDER BY at_ms, seq) = 1 AS first FROM c)
SELECT seq, CASE WHEN first AND ticket % 5 <> 0 AND at_ms <= 1000 + ticket % 9 THEN 'd' || ticket % 13 END AS device_id FROM f""", ctes=False)
def ticket_claims(spark, sf_dir):
    """Tickets are good for one claim, through their last millisecond; some are unknown."""
    claims = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("ticket"), (1000 + F.col("o_orderkey") % 11).alias("at_ms"))
    known = claims.select("ticket").distinct().where("ticket % 5 <> 0")
    tickets = registry.issue(known.select("ticket", F.concat(F.lit("d"), (F.col("ticket") % 13).cast("string")).alias("device_id"), (F.col("ticket") % 9 + 1000 - 600_000).alias("created_ms")), "created_ms")
    return registry.claim_tickets(claims, tickets).select("seq", "device_id")


@query(f"""WITH {_EV}, m AS (SELECT event_id AS seq, vault, device FROM e), s AS (SELECT DISTINCT vault, user_id AS subscriber FROM (SELECT user_id, user_id % 5 AS vault FROM events WHERE user_id % 10 < 3))
SELECT seq, subscriber FROM m JOIN s USING (vault) WHERE device <> subscriber""", ctes=False)
def fan_out(spark, sf_dir):
    """Each event for everyone who follows its vault but its own device."""
    from palimpsest.streaming import presence

    frames = _frames(spark, sf_dir)
    subscribers = frames.where("device % 10 < 3").select("vault", F.col("device").alias("subscriber")).distinct()
    return presence.fan_out(frames.select("vault", "device", F.col("seq").alias("value")), subscribers).select(F.col("value").alias("seq"), "subscriber")


@query(f"""WITH {_EV}, l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY vault, device ORDER BY ms DESC, event_id DESC) = 1)
SELECT s.subscriber, vault, substr(CAST(device AS VARCHAR), 1, 12) AS device, file, state FROM l JOIN (SELECT DISTINCT user_id AS subscriber, user_id % 5 AS vault FROM events WHERE user_id % 10 = 1) s USING (vault), now
WHERE now - ms < {_TTL} AND device <> s.subscriber""", ctes=False)
def presence_snapshot(spark, sf_dir):
    """What fresh subscribers are told of who is where, read back from JSON."""
    from palimpsest.streaming import presence

    frames = _frames(spark, sf_dir)
    live = logs.presence(frames, frames.agg(F.max("updated_ms")).first()[0], _TTL)
    subscribers = frames.where("device % 10 = 1").select("vault", F.col("device").cast("string").alias("subscriber")).distinct()
    told = presence.presence_snapshot(live, subscribers)
    return told.select(F.col("subscriber").cast("long").alias("subscriber"), "vault", *[F.get_json_object("value", f"$.{c}").alias(c) for c in ("device", "file", "state")])


@query(_D + """SELECT CASE WHEN action = 'deleted' THEN '{"action":"deleted","path":"' || path || '"}'
  ELSE '{"action":"' || action || '","path":"' || path || '","hash":"' || hash || '","size":' || size || ',"mtime_ms":' || mtime_ms || '}' END AS value FROM d""")
def delta_json(spark, sf_dir):
    s = Snapshots(spark, sf_dir)
    return formats.delta_json(diff.compute_deltas(s.base, s.b))


@query(f"""WITH {_ROOTS} SELECT '{{"root":"' || root_hash || '","parent":' || coalesce('"' || parent_hash || '"', 'null') || ',"created_ms":' || created_ms || ',"device_id":"' || device_id || '","total_files":' || total_files
  || ',"current":' || CASE WHEN root_hash = '{_NOW_ROOT}' THEN 'true' ELSE 'false' END || '}}' AS value FROM roots""", ctes=False)
def history_json(spark, sf_dir):
    return formats.history_json(history.history(_roots(spark, sf_dir), _NOW_ROOT, limit=None))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN [] ELSE list_transform(range(0, least(16, doc_id % 40)), lambda i: 'v' || i) END AS vaults FROM src""")
def capped_vaults(spark, sf_dir):
    """The vaults that a subscription's JSON names: strings only, sixteen at most."""
    k = F.col("doc_id")
    names = F.transform(F.when(k % 40 > 0, F.sequence(F.lit(0).cast("long"), k % 40 - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: F.concat(F.lit('"v'), i.cast("string"), F.lit('"')))
    body = F.array_join(F.concat(F.array(F.lit("7"), F.lit("null")), names), ",")
    text = F.when(k % 5 == 0, F.lit('{"vaults": "none"}')).otherwise(F.concat(F.lit('{"t": "sub", "vaults": ['), body, F.lit("]}")))
    return Snapshots(spark, sf_dir).src.select("doc_id", formats.capped_strings(text, "vaults", MOST_VAULTS).alias("vaults"))


@query("""SELECT path, path LIKE 'de/%' OR path LIKE '%7.md' OR regexp_matches(path, '(^|/)src1[^/](/|$)') AS client, path LIKE 'es/%' OR path LIKE '%77.md' AS server FROM src""")
def sql_path_matches(spark, sf_dir):
    """The patterns as a SQL function."""
    register_functions(spark)
    return spark.sql("SELECT path, path_matches(path, array('de/', '*7.md', 'src1?'), 'client') AS client, path_matches(path, array('es/', '*77.md'), 'server') AS server FROM {src}", src=Snapshots(spark, sf_dir).src)


@query("""SELECT doc_id, sha256(t) AS hash, top || '/' AS prefix, strlen(t) >= 1048576 AS large, hex(encode(t)) AS hexed, to_base64(encode(t)) AS b64 FROM src""")
def sql_functions(spark, sf_dir):
    register_functions(spark)
    src = Snapshots(spark, sf_dir).src
    rows = spark.sql("SELECT doc_id, content_hash(CAST(t AS BINARY)) AS hash, top_prefix(concat(top, '/', path)) AS prefix, t FROM {src}", src=src)
    return rows.select("doc_id", "hash", "prefix", chunking.should_chunk(F.octet_length("t")).alias("large"), F.hex("t").alias("hexed"), F.regexp_replace(F.base64(F.col("t").cast("binary")), "\r\n", "").alias("b64"))


@query("SELECT top, count(*) AS parts, CAST(sum(strlen(t)) AS BIGINT) AS bytes, sha256(string_agg(t, '' ORDER BY doc_id)) AS hash FROM src GROUP BY top")
def incremental_hashes(spark, sf_dir):
    """The hash of each folder's contents behind each other, piece by piece."""
    return hashing.hash_groups(Snapshots(spark, sf_dir).src.select("top", "doc_id", F.col("t").alias("data")), "top", "doc_id")


@query("""SELECT o_orderkey AS id, CAST(o_orderkey % 256 AS BIGINT) AS low, strftime(make_timestamp_ms(o_orderkey * CAST(98765 AS BIGINT)), '%H:%M:%S.%g') AS clock FROM orders""", ctes=False)
def small_values(spark, sf_dir):
    """A number's little-endian bytes (the first of them), and times of day."""
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), F.conv(F.hex(F.substring(hashing.u64_bytes(k), 1, 1)), 16, 10).cast("long").alias("low"), formats.clock(k * 98765).alias("clock"))


@query("SELECT path, hash, CAST(strlen(content) AS BIGINT) AS size FROM a")
def objects_on_disk(spark, sf_dir):
    """Contents put into a store of objects by hash, as files, and read back; paths find them by their hash."""
    s = Snapshots(spark, sf_dir)
    register_sources(spark)
    to = f"{shared_dir(spark)}/objects"
    s.blobs("a").dropDuplicates(["hash"]).write.format("objects").mode("append").option("path", to).save()
    back = tables.read_objects(spark, to).select("hash", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("own"))
    return s.a.select("path", "hash").join(back.where("own = hash"), "hash").select("path", "hash", "size")


@query("SELECT 'v' AS vault, top AS note_key, row_number() OVER (PARTITION BY top ORDER BY doc_id) - 1 AS seq, sha256(t) AS update_hash FROM src WHERE t <> '' AND strlen(t) <= 4194304")
def oplog_files(spark, sf_dir):
    """Logs as files, a note each, and read back."""
    register_sources(spark)
    src, to = Snapshots(spark, sf_dir).src, f"{shared_dir(spark)}/logs"
    name = F.when(F.col("top") == "", "none").otherwise(F.col("top"))
    updates = src.select(F.lit("v").alias("vault"), name.alias("note_key"), F.col("doc_id").alias("seq"), F.col("t").cast("binary").alias("update"))
    logs.encode_log(logs.accepted(updates)[0]).write.format("oplog").mode("append").option("path", to).save()
    back = spark.read.format("oplog").option("path", to).load()
    return back.select("vault", F.when(F.col("note_key") == "none", "").otherwise(F.col("note_key")).alias("note_key"), "seq", F.sha2("update", 256).alias("update_hash"))
