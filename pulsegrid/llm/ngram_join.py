"""Exact Jaccard join of documents by word shingles with token-combination prefixes.

A document is its set of distinct 5-word shingles. Two sets that reach the threshold miss few tokens of each other:
of n tokens at most e = n - ceil(t n). So

* documents that hold more than e tokens which no other document has are out at once;
* tokens are ordered rare first. Among the first e + 1 there is a common one, and among the first e + k there are k.
  A rare token in the prefix is a signature by itself. Frequent tokens (held by more than ``RARE`` sets) are
  signatures only in combinations of k = 2, for which the prefix is one token longer: a similar pair shares a
  rare token there, or two frequent ones;
* sets that share a signature are verified on their whole token sets.

Links are needed up to connectivity. So each signature first has its members verified against its most central
one (fewest tokens of its own); only members of a signature that are still in different components are then verified
against each other: as pairs where members are few, and else in blocks of bounded size, once for all hot
signatures that overlap. Equal sets are one node throughout.

Tokens and keys of sets are 64-bit hashes. Defined cases: a null or empty text has no shingle and its own component; fewer words
than the width make one shingle; a null doc_id has component null; rows that repeat a doc_id with equal sets are one
node, with different sets each its own result (their component is that of the id's smallest link). An empty table gives
an empty result. Columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.llm.batches import arrow_schema
from pulsegrid.llm.common import LAST_ID, documents
from pulsegrid.llm.components import components
from pulsegrid.llm.hashing import mix64, run_edges, segment_hashes
from pulsegrid.llm.key_blocks import (
    PACKED,
    Block,
    held_elsewhere,
    held_twice,
    in_sorted,
    map_blocks,
    part_bits,
    repeated,
    send_keys,
    write_blocks,
)
from pulsegrid.session import durable

WIDTH = 5
PERCENT = 80
#: A token in more sets than this is frequent, and a combination in more sets than this is hot.
RARE = 32
HOT = 64
BLOCK_ROWS = 256
BYTES_PER_PART = 8 << 20

_IS_WORD = np.array([c not in b"\t\n\x0b\x0c\r " for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_STEPS = mix64(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def block_shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, token), distinct and in order of both."""
    data = _LOWER[block.data]
    inside = _IS_WORD[data]
    starts, ends = run_edges(inside)
    # Words do not cross documents: cut runs at document starts.
    cut = block.starts[(block.starts > 0) & (block.lengths > 0)]
    cut = cut[inside[cut] & inside[cut - 1]]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    word = segment_hashes(data, starts, ends)
    doc = np.searchsorted(block.ends, starts, side="right")
    count = np.bincount(doc, minlength=len(block.ids))
    first = np.cumsum(count) - count
    token = np.zeros(len(word), dtype=np.uint64)
    for k in range(min(width, len(word))):
        token[:len(word) - k] += word[k:] * _STEPS[k]
    left = (first + count)[doc] - np.arange(len(word))
    whole = left >= width
    short = np.flatnonzero((count > 0) & (count < width))
    for d in short.tolist():  # the whole sequence as one shingle, told apart by its length
        own = word[first[d]:first[d] + count[d]]
        token[first[d]] = (own * _STEPS[:count[d]]).sum(dtype=np.uint64) + np.uint64(count[d])
        whole[first[d]] = True
    doc, token = doc[whole], mix64(token[whole])
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])]) if len(doc) else np.zeros(0, dtype=bool)
    return doc[new], token[new]


def set_keys(block: Block, doc: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, key) of every document's set; equal sets have equal keys."""
    size = np.bincount(doc, minlength=len(block.ids))
    key = np.zeros(len(block.ids), dtype=np.uint64)
    np.add.at(key, doc, mix64(token + np.uint64(77)))
    return size, mix64(key + size.astype(np.uint64))


def _one_of_each_set(doc: np.ndarray, key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mask of the entries of one document of each set."""
    filled = np.flatnonzero(size)
    _, first = np.unique(key[filled], return_index=True)
    chosen = np.zeros(len(key), dtype=bool)
    chosen[filled[first]] = True
    return chosen[doc]


def most_missing(n: np.ndarray | Column, percent: int):
    """Tokens of a set of n that a similar set may lack: n - ceil(percent * n / 100)."""
    if isinstance(n, Column):
        return F.floor(n * (100 - percent) / 100)
    return n * (100 - percent) // 100


def shared_sets(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, key, tokens) of every row; tokens only where enough of them occur in another set to allow a link.

    Blocks exchange their distinct tokens, so a document's shared tokens are counted over all documents.
    """
    blocks = write_blocks(docs, id_col, text_col)
    bits = part_bits(blocks, BYTES_PER_PART)
    schema = "doc long, n long, key long, tokens array<long>"

    def tokens(number: int, block: Block, _):
        _, token = block_shingles(block, width)
        yield send_keys(number, token, bits)

    def survivors(_: int, block: Block, answers) -> Iterator[dict]:
        doc, token = block_shingles(block, width)
        size, key = set_keys(block, doc, token)
        one = _one_of_each_set(doc, key, size)
        shared = np.bincount(doc, weights=held_twice(token, token[one], answers, bits), minlength=len(size))
        # Copies inside the block are shared as well, though their tokens are counted once.
        copies = np.isin(key, repeated(np.sort(key[size > 0])))
        keep = (size > 0) & (copies | (size - shared <= most_missing(size, percent)))
        ends = np.cumsum(size)
        signed = token.view(np.int64)
        yield {"doc": block.ids, "n": size, "key": key.view(np.int64),
               "tokens": [np.sort(signed[e - n:e]).tolist() if k else None for n, e, k in zip(size.tolist(), ends.tolist(), keep.tolist())]}

    sent = map_blocks(blocks, tokens, PACKED)
    return map_blocks(blocks, survivors, schema, held_elsewhere(sent))


# ---- signatures -------------------------------------------------------------------------------------


def spread(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """An inner join by exchange, never by broadcast: for rows made of lists, or written in runs, whose size the planner takes to be that of
    the lists or the file. A list of m tokens has m (m - 1) / 2 pairs, and a broadcast goes through the driver."""
    return rows.join(others.hint("merge"), key)


def ordered_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(doc, own, rare, frequent): tokens no other set holds are counted; of the rest, the rare and the frequent ones
    within the prefix of e + 1 or, with frequent ones, e + 2 tokens."""
    held = sets.select("doc", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > 1)
    listed = spread(held, counts, "token").groupBy("doc").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("shared"))
    own = F.col("n") - F.size("shared")
    spare = most_missing(F.col("n"), percent) - own
    return listed.select("doc", "n", own.alias("own"), spare.cast("int").alias("spare"), "shared").where(F.col("spare") >= 0).select(
        "doc", "n", "own",
        F.transform(F.filter(F.slice("shared", 1, F.col("spare") + 1), lambda s: s["sets"] <= RARE), lambda s: s["token"]).alias("rare"),
        F.transform(F.filter(F.slice("shared", 1, F.col("spare") + 2), lambda s: s["sets"] > RARE), lambda s: s["token"]).alias("frequent"),
    )


def pair_signatures(lists: DataFrame) -> DataFrame:
    """(list, sig, at, low, high, members) of every combination of two tokens of each distinct list of frequent tokens; ``at`` is
    the place of the second."""
    numbered = lists.where(F.size("frequent") > 1).select("*", F.posexplode("frequent").alias("i", "first"))
    return numbered.select("list", "low", "high", "members", "first", "i", F.posexplode(F.slice("frequent", F.col("i") + 2, F.size("frequent"))).alias("j", "second")).select(
        "list", "low", "high", "members", (F.col("i") + 1 + F.col("j")).alias("at"), F.xxhash64(F.lit(2), F.least("first", "second"), F.greatest("first", "second")).alias("sig"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. A set travels once per pair, so pairs are few: see the callers."""
    left, right = (sets.select(F.col("doc").alias(n), F.col("tokens").alias(f"tokens_{n}")) for n in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = arrow_schema("a long, b long")
        for batch in batches:
            x, y = batch["tokens_a"], batch["tokens_b"]
            hit = [similar(x[i].values.to_numpy(), y[i].values.to_numpy(), percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pydict({n: batch[n].filter(pa.array(hit, pa.bool_())) for n in ("a", "b")}, schema=fields)

    return both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(each, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = int(np.count_nonzero(in_sorted(x, y)))
    return 100 * both >= percent * (len(x) + len(y) - both)


def central_pairs(signed: DataFrame) -> DataFrame:
    """(a, b): every member of a signature with its most central member."""
    central = signed.groupBy("sig").agg(F.min(F.struct("own", "doc")).alias("least"), F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    return spread(signed, central, "sig").where(F.col("doc") != F.col("least.doc")).select(
        F.least("doc", "least.doc").alias("a"), F.greatest("doc", "least.doc").alias("b")).distinct()


def placed(signed: DataFrame, labels: DataFrame) -> DataFrame:
    """With the component of each doc so far."""
    return signed.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def open_signatures(signed: DataFrame) -> DataFrame:
    """(sig, members) of the signatures whose members are in several components."""
    return signed.groupBy("sig").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("members").alias("members")).where(
        F.col("low") < F.col("high")).select("sig", "members")


def cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) in different components within signatures of few members, of (sig, doc, component, n, rest).

    ``rest`` is the most a set can have in common with another of the signature, when the signature's tokens are the first
    they share: these and what follows them in the common order. A similar pair passes this bound where its first shared
    tokens meet, so it is tried there and nearly nowhere else. Signatures with the same members, as those of tokens
    that go together, count once, with the earliest. What a set is to be verified against is gathered as one list before pairs
    become rows, so a pair is one row however many signatures it shares.
    """
    member = F.struct("doc", "component", "n", "rest")
    groups = members.groupBy("sig").agg(F.sort_array(F.collect_list(member)).alias("group"), F.sum("rest").alias("rest"))
    once = groups.groupBy(F.transform("group", lambda m: m["doc"]).alias("docs")).agg(F.max_by("group", "rest").alias("group"))
    first = once.select("group", F.posexplode("group").alias("i", "x"))

    def may_match(y: Column) -> Column:
        n, other = F.col("x.n"), y["n"]
        alike = 100 * F.least(n, other) >= percent * F.greatest(n, other)
        return (y["component"] != F.col("x.component")) & alike & ((100 + percent) * F.least(F.col("x.rest"), y["rest"]) >= percent * (n + other))

    met = F.transform(F.filter(F.slice("group", F.col("i") + 2, F.size("group")), may_match), lambda y: y["doc"])
    lists = first.select(F.col("x.doc").alias("a"), met.alias("met")).where(F.size("met") > 0).groupBy("a").agg(
        F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"))
    return lists.select("a", F.explode("met").alias("b"))


def block_links(hot: DataFrame, listed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within hot signatures: the token lists of those that overlap form a cluster, their documents are
    dealt to blocks, and every two blocks meet in a task of their own, as two matrices of token counts, so no pair is
    ever a row. ``hot`` has (sig, list), ``listed`` (list, doc, component)."""
    heads = hot.groupBy("sig").agg(F.min("list").alias("head"))
    met = spread(hot, heads, "sig").select(F.col("head").alias("a"), F.col("list").alias("b"))
    clusters = components(met)
    alone = hot.select("list").distinct().join(clusters, F.col("list") == F.col("node"), "left").select(
        "list", F.coalesce("component", "list").alias("cluster"))
    dealt = listed.join(alone, "list").select("doc", "component", "cluster").distinct()
    sizes = dealt.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("cells"))
    dealt = dealt.join(sizes, "cluster").withColumn("cell", F.pmod(F.xxhash64("doc"), F.col("cells")))
    # A set meets its document before it goes to the pairs of blocks.
    held = dealt.join(sets.select("doc", "tokens"), "doc")
    loaded = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select(
        "cluster", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "doc", "component", "tokens")

    def meet(table: pa.Table) -> pa.Table:
        doc, component = table["doc"].to_numpy(), table["component"].to_numpy()
        arrays = [t.values.to_numpy() for t in table["tokens"].combine_chunks()]
        sizes = np.array([len(t) for t in arrays])
        _, column = np.unique(np.concatenate(arrays), return_inverse=True)
        row = np.repeat(np.arange(len(arrays)), sizes)
        common = np.zeros((len(arrays), len(arrays)))
        order = np.argsort(column, kind="stable")
        for at in np.array_split(order, max(1, len(order) // 200_000)):  # a slice of columns at a time
            names, inner = np.unique(column[at], return_inverse=True)
            held = np.zeros((len(arrays), len(names)), dtype=np.float32)
            held[row[at], inner] = 1
            common += held @ held.T
        hit = (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) & (component[:, None] != component[None, :])
        a, b = np.nonzero(np.triu(hit, 1))
        return pa.table({"a": np.minimum(doc[a], doc[b]), "b": np.maximum(doc[a], doc[b])}, schema=arrow_schema("a long, b long"))

    return loaded.groupBy("cluster", "i", "j").applyInArrow(meet, "a long, b long")


def join_ngrams(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    rows = durable(shared_sets(docs, width, percent, id_col, text_col))
    shared = rows.where(F.col("tokens").isNotNull())
    classes = durable(shared.groupBy("key").agg(F.min("doc").alias("first")))
    # From here a set is known by its key.
    sets = durable(shared.join(classes, "key").where(F.col("doc") == F.col("first")).dropDuplicates(["key"])
                   .select(F.col("key").alias("doc"), "tokens"))
    prefixes = durable(ordered_prefixes(sets, percent))
    rare = prefixes.select("doc", "own", "n", F.posexplode("rare").alias("at", "sig"))
    # Any one frequent token leads to the centre; combinations follow for what is still apart.
    single = prefixes.select("doc", "own", F.explode("frequent").alias("sig"))
    links = durable(verified(central_pairs(rare.select("doc", "own", "sig").unionByName(single)), sets, percent))
    labels = components(links)
    # The first token two sets share, and what follows it in either.
    rare = durable(placed(rare.select("sig", "doc", "n", (F.col("n") - F.col("own") - F.col("at")).alias("rest")), labels))
    per_doc = [F.col("component").alias("low"), F.col("component").alias("high"), F.lit(1).alias("members")]
    open_rare = rare.join(open_signatures(rare.select("sig", *per_doc)), "sig", "left_semi").select("sig", "doc", "component", "n", "rest")
    frequent = placed(prefixes.where(F.size("frequent") > 1).select("doc", "frequent", "n", (F.col("own") + F.size("rare")).alias("before")), labels)
    single = frequent.select("component", "doc", F.explode("frequent").alias("sig"))
    apart = single.join(open_signatures(single.select("sig", *per_doc)), "sig", "left_semi").select("doc").distinct()
    # Documents with equal lists of frequent tokens have the same combinations: these are formed once per list.
    listed = durable(frequent.join(apart, "doc", "left_semi").select(F.xxhash64("frequent").alias("list"), "frequent", "doc", "component", "n", "before"))
    lists = listed.groupBy("list", "frequent").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    combined = pair_signatures(lists)
    sized = durable(spread(combined.select("sig", "list", "at"), open_signatures(combined), "sig"))
    # Two tokens shared, the second at its place, and what follows it.
    rest = F.col("n") - F.col("before") - F.col("at") + 1
    few = spread(sized.where(F.col("members") <= HOT), listed.drop("frequent"), "list").select("sig", "doc", "component", "n", rest.alias("rest"))
    hot = durable(sized.where(F.col("members") > HOT).select("sig", "list"))
    more = verified(cross_pairs(open_rare.unionByName(few), percent), sets, percent)
    if not hot.isEmpty():
        more = more.unionByName(block_links(hot, listed.select("list", "doc", "component"), sets, percent))
    more = durable(more)
    nodes = labels if more.isEmpty() else components(links.unionByName(more))
    named = classes.join(nodes.select(F.col("node").alias("key"), "component"), "key", "left").select(
        "key", "first", F.coalesce("component", "key").alias("component"))
    # A component's id is the smallest document of any of its sets.
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = rows.select("doc", "n", "key").join(named.join(smallest, "component").select("key", "component_id"), "key", "left")
    known = F.when(F.col("doc") != LAST_ID, F.col("doc"))
    found = F.coalesce(F.when(F.col("component_id") != LAST_ID, F.col("component_id")), known)
    return whole.select(known.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(known.isNotNull(), found).alias("component_id"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return join_ngrams(documents(spark, folder))
