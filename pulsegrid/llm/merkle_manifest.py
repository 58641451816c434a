"""Merkle manifest of a table: a tree of digests per source, one over the sources, and a proof for every row.

Rows are sorted by (source, id) in ranges and numbered by the ranges' counts, so a source may fill many tasks. Level by
level, nodes meet in windows of one run of ``FAN`` nodes each: lag and lead columns of fixed offsets, masked by the node's slot
and the length of its run, supply its siblings, and rows in slot 0 hash them to the parent. Every level is written before the
next; it has a sixteenth of the rows. The siblings of the upper levels then come down the same way, joined by parent, and
each leaf folds its own path.

Proofs hold against changed texts: :func:`manifest` folds a tampered leaf, where one is given, with the siblings of the
original tree.

Defined cases: a null value is one sign of its own in a leaf, and an empty text is not null. A null source is one source, before
all others; null ids come first within their source. Rows with equal ids and leaves are leaves of their own, in
either order; equal ids with different leaves are ordered by leaf. An empty table gives an empty result. Columns besides the five
of the leaf are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pulsegrid.llm.common import ascii_lower, crc_bucket, documents
from pulsegrid.session import durable

FAN = 16
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def hashed(*parts: Column) -> Column:
    """Lowercase hex sha256 of texts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(values: list[Column]) -> Column:
    """Digest of a row: every value with its length in bytes, so no two rows read alike."""
    text = [v.cast("string") for v in values]
    return hashed(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text])


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Rows with their number in ``order``, from 0: a range sort, whose partitions are counted, and what the partitions
    before hold. The offsets are one number per partition."""
    whole = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = durable(rows.orderBy(*whole).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).orderBy("part").collect()
    before, total = [], 0
    for c in counts:
        before.append((c.part, total))
        total += c.rows
    offsets = rows.sparkSession.createDataFrame(before, f"{name}_part long, {name}_before long")
    found = placed.withColumn(f"{name}_part", part).join(F.broadcast(offsets), f"{name}_part")
    inside = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return found.withColumn(name, F.col(f"{name}_before") + inside).drop(f"{name}_before")


def grouped_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the leaves with group, n and total; (group, source, total) of every source). A group is the number of its first
    row in the whole order, so groups are ordered as their sources are."""
    # Rows alike in everything are dealt to several ranges by their place in the input.
    salt = F.xxhash64(F.monotonically_increasing_id())
    at = numbered(leaves.withColumn("salt", salt), [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "hash", "salt"], "at")
    # A source has a row here for each range it is in, not for each of its leaves.
    spread = at.groupBy("source", "at_part").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("rows"))
    groups = durable(spread.groupBy("source").agg(F.min("least").alias("group"), F.sum("rows").alias("total")))
    s, g = spread.alias("s"), groups.alias("g")
    known = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select(
        F.col("s.source").alias("of"), F.col("s.at_part").alias("in"), "group", "total")
    placed = at.join(known, (F.col("at_part") == F.col("in")) & F.col("source").eqNullSafe(F.col("of")))
    kept = [c for c in leaves.columns if c != "source"]
    return placed.select(*kept, "group", (F.col("at") - F.col("group")).alias("n"), "total"), groups


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes of groups that have several, with ``parent``, ``slot``, and the digests before and after them in their run."""
    slot, parent = F.pmod("n", F.lit(FAN)), F.floor(F.col("n") / FAN)
    run = F.least(F.lit(FAN), F.col("total") - F.col("parent") * FAN)
    w = W.partitionBy("group", "parent").orderBy("n")
    placed = nodes.where(F.col("total") > 1).withColumns({"slot": slot, "parent": parent}).withColumn("run", run)
    left = [F.when(F.col("slot") >= k, F.lag("hash", k).over(w)) for k in range(FAN - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < F.col("run"), F.lead("hash", k).over(w)) for k in range(1, FAN)]
    return placed.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right)}).drop("run")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: first children hash their run."""
    first = with_siblings(nodes).where(F.col("slot") == 0)
    return first.select("group", F.col("parent").alias("n"), F.ceil(F.col("total") / FAN).alias("total"), hashed(F.col("hash"), F.col("right")).alias("hash"))


def levels(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """Leaves (group, n, total, hash), their parents and so on, to the level at which every group has one node."""
    found = [leaves]
    while largest > 1:
        found.append(durable(parents(found[-1])))
        largest = -(-largest // FAN)
    return found


def paths(tree: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level of ``tree`` with ``path``, the siblings before and after on the way up, from the node to the last
    level, and what ``tops`` (group, path, ...) has for its group."""
    extra = [c for c in tops.columns if c not in ("group", "path")]
    above = None
    for number, nodes in reversed(list(enumerate(tree))):
        kept = [c for c in nodes.columns]
        found = nodes.where(F.col("total") == 1).join(tops, "group").select(*kept, "path", *extra)
        if above is not None:
            own = F.array(F.struct("left", "right")).cast(_PATH)
            inner = with_siblings(nodes).join(above, ["group", "parent"]).select(
                *kept, F.concat(own, "path").alias("path"), *extra)
            found = inner.unionByName(found)
        if number:
            above = durable(found.select("group", F.col("n").alias("parent"), "path", *extra))
    return found


def fold(path: Column, leaf: Column) -> Column:
    """The digest at the top of a path."""
    return F.aggregate(path, leaf, lambda h, s: hashed(s["left"], h, s["right"]))


def proof(path: Column) -> Column:
    """The siblings of a path as one text, from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(rows: DataFrame, leaf: Column, order: Column, source: Column, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root): one row for each of ``rows``, where ``order`` numbers it within its
    source. ``changed`` is the leaf of a changed row, null for others; the path folds it instead of the leaf."""
    changed = F.lit(None).cast("string") if changed is None else changed
    leaves = durable(rows.select(order.alias("doc_id"), source.alias("source"), leaf.alias("hash"), changed.alias("changed")))
    placed, groups = grouped_leaves(leaves)
    placed = durable(placed)
    largest = groups.agg(F.max("total")).first()[0] or 0
    tree = levels(placed, largest)
    ends = None
    for nodes in tree:
        own = nodes.where(F.col("total") == 1).select("group", "hash")
        ends = own if ends is None else ends.unionByName(own)
    # The tree over the sources: one group, in the order of the sources.
    over = numbered(ends.select(F.col("group").alias("of"), "hash"), ["of"], "n").drop("n_part")
    sources = groups.count()
    top = levels(durable(over.select("of", F.lit(0).cast("long").alias("group"), "n", F.lit(sources).cast("long").alias("total"), "hash")), sources)
    last = top[-1].where(F.col("total") == 1).first()
    root = F.lit(last["hash"] if last else None).cast("string")
    nothing = rows.sparkSession.createDataFrame([(0, [])], f"group long, path {_PATH}")
    tops = durable(paths(top, nothing).select(F.col("of").alias("group"), "path", F.col("hash").alias("subroot")))
    found = paths(tree, tops)
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), "path",
                        fold(F.col("path"), F.coalesce("changed", "hash")).alias("folded_root"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    values = {c: F.col(c) for c in LEAF_COLUMNS}
    tampered = F.when(crc_bucket("doc_id", 5) == 0, leaf_hash(list((values | {"text": ascii_lower(F.col("text"))}).values())))
    found = manifest(documents(spark, folder), leaf_hash(list(values.values())), F.col("doc_id"), F.col("source"), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(text: str) -> str:
    parts = [f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v} END" for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


_SIBLINGS = """string_agg(h, '') OVER (PARTITION BY {keys}lvl, n // 16 ORDER BY n ROWS BETWEEN {rows})"""
_BEFORE, _AFTER = "UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"

# crc32 as a fold over the digits: every digit enters the low bits, then eight shifts.
SQL = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
           lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
         lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) // 2, 3988292384) ELSE xor(c, b) // 2 END), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
leaves AS (
  SELECT d.doc_id, coalesce(source, '') AS src, source IS NOT NULL AS named, {_sql_leaf('text')} AS leaf,
         CASE WHEN crc % 5 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents d LEFT JOIN crc USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY named, src ORDER BY doc_id, leaf) - 1 AS n, count(*) OVER (PARTITION BY named, src) AS total FROM leaves),
up AS (
  SELECT named, src, 0 AS lvl, n, total, leaf AS h FROM placed
  UNION ALL
  SELECT named, src, lvl + 1, n // 16, (total + 15) // 16, sha256(string_agg(h, '' ORDER BY n)) FROM up WHERE total > 1
  GROUP BY named, src, lvl, n // 16, total),
nodes AS (SELECT *, coalesce({_SIBLINGS.format(keys='named, src, ', rows=_BEFORE)}, '') AS l, coalesce({_SIBLINGS.format(keys='named, src, ', rows=_AFTER)}, '') AS r FROM up),
top AS (
  SELECT 0 AS lvl, row_number() OVER (ORDER BY named, src) - 1 AS n, count(*) OVER () AS total, h FROM up WHERE total = 1
  UNION ALL
  SELECT lvl + 1, n // 16, (total + 15) // 16, sha256(string_agg(h, '' ORDER BY n)) FROM top WHERE total > 1 GROUP BY lvl, n // 16, total),
top_nodes AS (SELECT *, coalesce({_SIBLINGS.format(keys='', rows=_BEFORE)}, '') AS l, coalesce({_SIBLINGS.format(keys='', rows=_AFTER)}, '') AS r FROM top),
fold AS (
  SELECT doc_id, named, src, leaf, 0 AS lvl, n, total, '' AS proof, coalesce(changed, leaf) AS cur FROM placed
  UNION ALL
  SELECT f.doc_id, f.named, f.src, f.leaf, f.lvl + 1, f.n // 16, (f.total + 15) // 16, f.proof || x.l || x.r, sha256(x.l || f.cur || x.r)
  FROM fold f JOIN nodes x ON f.named = x.named AND f.src = x.src AND f.lvl = x.lvl AND f.n = x.n WHERE f.total > 1),
subroots AS (SELECT named, src, h AS subroot, row_number() OVER (ORDER BY named, src) - 1 AS n, count(*) OVER () AS total FROM up WHERE total = 1),
top_fold AS (
  SELECT f.doc_id, f.leaf, s.subroot, 0 AS lvl, s.n, s.total, f.proof, f.cur FROM fold f JOIN subroots s ON f.named = s.named AND f.src = s.src WHERE f.total = 1
  UNION ALL
  SELECT f.doc_id, f.leaf, f.subroot, f.lvl + 1, f.n // 16, (f.total + 15) // 16, f.proof || x.l || x.r, sha256(x.l || f.cur || x.r)
  FROM top_fold f JOIN top_nodes x ON f.lvl = x.lvl AND f.n = x.n WHERE f.total > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM top_fold, (SELECT h AS root FROM top WHERE total = 1) WHERE total = 1
"""
