"""Near-duplicate documents: a chosen-path similarity join on sets of word shingles.

Sets are embedded by 64 minwise tokens, so that two sets agree on a token with probability
equal to their Jaccard similarity.  In each of several independent trees a node chooses some of
the tokens by its own hash, and its documents branch by their values there:

* A node of at most NODE_ROWS documents is compared exhaustively, on the sketch of all tokens.
* A larger one branches, on BRANCHES tokens, as often as that is needed, at every table size.
* Where branching would not thin out the pairs, as among documents that share most of their
  text, the node is compared exhaustively too, in blocks that each meet every other.

A pair at the threshold loses all of its paths in a tree with the extinction probability of a
branching process (`lost`), whatever the depth; trees are repeated until that is 1 - RECALL.
Comparing emits a spanning forest, never all pairs.

The sketch's components are candidates; links are confirmed on the full sets.  A component
within the bounds of a task is compared exhaustively.  A larger one is dealt into blocks twice,
each joined by the component's most typical documents, which links most copies; the rest is
exact: documents not yet linked that share a shingle of their prefixes (see `prefixes`) are
compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import SPACE_SEP, flagged, mix64, read, slices, spans, stash, windows, without, word_hashes

WORDS = 5
THRESHOLD = 80  # percent
RECALL = 0.9999
TOKENS = 64
NODE_ROWS = 2048
POOL = 8  # tokens that a node below the root chooses from
LEVELS = 7
DENSE = 0.7  # a node branches if its children have at most this share of its pairs
GROUP_SHINGLES = 4_000_000
GROUP_DOCS = 512
DEALS = 2
HUBS = 16
SALTS = 64
COMMON = 1 << 19  # shingles whose counts order the prefixes of large components
ORDER_DOCS = 20_000  # documents that these counts are taken from
_SEEDS = mix64(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)


def branches_for(threshold: int) -> int:
    """Tokens that a node branches on: a pair at the threshold then meets on more than one of them on average."""
    return min(POOL, max(2, math.ceil(150 / threshold)))


def lost(threshold: int) -> float:
    """The probability that a pair at the threshold is parted on all paths of a tree of any depth."""
    t, b, q = threshold / 100, branches_for(threshold), 0.0
    for _ in range(1000):
        q = (1 - t + t * q) ** b
    return q


def trees_for(threshold: int, recall: float = RECALL) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(lost(threshold), 1e-12))))


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents of a slice, repeats included, and their offsets.

    Documents with fewer than n words have one shingle, their whole sequence; without words none.
    """
    starts, ends, first = spans(data, offsets, SPACE_SEP)
    hashes = word_hashes(data, starts, ends)
    words = np.diff(first)
    counts = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    offs = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(offs[-1], np.uint64)
    runs = windows(hashes, n)
    at = np.arange(offs[-1]) + np.repeat(first[:-1] - offs[:-1], counts)
    long = np.repeat(words >= n, counts)
    out[long] = runs[at[long]]
    for d in np.flatnonzero((words > 0) & (words < n)):
        out[offs[d]] = windows(hashes[first[d] : first[d + 1]], int(words[d]))[0] ^ mix64(words[d : d + 1].astype(np.uint64))[0]
    return out, offs


FEATURES = "doc_id bigint, n bigint, hi bigint, lo bigint, sketch binary"
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sketch", pa.binary())])


def features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: set size, a cryptographic digest of the whole set, and the sketch of two bytes a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, 1):
            all_, offs = shingles(data, offsets)
            m = rows.num_rows
            n, digest = np.zeros(m, np.int64), np.zeros((m, 2), np.int64)
            for d in range(m):
                one = np.unique(all_[offs[d] : offs[d + 1]])
                n[d], digest[d] = len(one), np.frombuffer(blake2b(one.tobytes(), digest_size=16).digest(), np.int64)
            full = np.flatnonzero(n)
            least = np.zeros((m, TOKENS), np.uint64)
            if len(full):
                for t in range(TOKENS):
                    least[full, t] = np.minimum.reduceat(all_ * _SEEDS[t], offs[:-1][full])
            sketch = mix64(least).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array([s.tobytes() for s in sketch], pa.binary())], schema=_FEATURES)

    return docs.selectExpr(f"cast({key} as bigint) doc_id", f"cast({text} as binary) body").mapInArrow(run, FEATURES)


_CHILD = "xxhash64(node, pos, substring(sketch, 2 * pos + 1, 2))"


def sketch_links(reps: DataFrame, threshold: int, recall: float) -> DataFrame:
    """(v, root): components of the nodes of all trees of (doc, sketch), by agreement of sketches.

    The driver learns how many large nodes a level has, and no more.  Tables between levels are
    written, which keeps plans short.
    """
    t = threshold / 100
    cutoff = max(0.0, t - 5 * math.sqrt(t * (1 - t) / TOKENS))
    trees, b = trees_for(threshold, recall), branches_for(threshold)
    order = [np.random.RandomState(7 + r).permutation(TOKENS).tolist() for r in range(trees)]
    roots = [(r, (r * b + j) % TOKENS) for r in range(trees) for j in range(b)]
    pools = [[t for t in order[r] if (r, t) not in roots] for r in range(trees)]
    rows = reps.withColumn("root", F.explode(F.array(*(F.struct(F.lit(r).alias("tree"), F.lit(p).alias("pos")) for r, p in roots))))
    rows = rows.select("root.tree", F.expr(_CHILD.replace("node, pos", "root.tree, root.pos").replace("* pos", "* root.pos")).alias("node"), "doc", "sketch")
    edges, dense = [], []
    hot = stash(rows.groupBy("node").agg(F.count("*").alias("m")).filter(F.col("m") > NODE_ROWS), "hot")
    level = 0
    while many := hot.count():
        marked = rows.join(hot, "node", "left")
        edges.append(stash(sketch_edges(marked.filter("m is null").select("node", "doc", "sketch"), cutoff), "edges"))
        large = stash(marked.filter("m is not null"), "large")
        if level == LEVELS:
            dense.append(large.select("node", "doc", "sketch", "m"))
            break
        pool = F.element_at(F.array(*(F.array(*map(F.lit, pools[r][level * POOL : (level + 1) * POOL])) for r in range(trees))), F.col("tree") + 1)
        first, step = F.pmod(F.xxhash64("node"), F.lit(POOL)), 1 + 2 * F.pmod(F.xxhash64("node", F.lit(1)), F.lit(POOL // 2))
        chosen = F.array(*(F.element_at(pool, (1 + (first + j * step) % POOL).cast("int")) for j in range(b)))
        children = large.withColumn("pos", F.explode(chosen)).select("tree", F.col("node").alias("parent"), "m", F.expr(_CHILD).alias("node"), "doc", "sketch")
        sizes = stash(children.groupBy("parent", "m", "node").agg(F.count("*").alias("n")), "children")
        thins = sizes.groupBy("parent", "m").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")).filter(F.col("pairs") <= DENSE * F.col("m").cast("double") * F.col("m")).select("parent")
        thins = stash(thins, "branching")
        dense.append(stash(large.join(thins, large["node"] == thins["parent"], "left_anti").select("node", "doc", "sketch", "m"), "dense"))
        rows = children.join(thins, "parent", "left_semi").select("tree", "node", "doc", "sketch")
        hot = stash(sizes.join(thins, "parent", "left_semi").filter(F.col("n") > NODE_ROWS).select("node", F.col("n").alias("m")), "hot")
        level += 1
    if not many:
        edges.append(stash(sketch_edges(rows.select("node", "doc", "sketch"), cutoff), "edges"))
    found = reduce(DataFrame.unionByName, edges)
    if not dense:
        return components(found)
    # dealt into blocks first, differently in each node; documents still apart then meet block by block
    wide = reduce(DataFrame.unionByName, dense)
    block = F.pmod(F.xxhash64("doc", "node"), F.ceil(F.col("m") / NODE_ROWS))
    found = found.unionByName(stash(sketch_edges(wide.select(F.xxhash64("node", block).alias("node"), "doc", "sketch"), cutoff), "edges"))
    linked = components(found)
    own = linked.select(F.col("v").alias("doc"), F.col("root").alias("linked"))
    wide = stash(wide.join(own, "doc", "left").select(F.col("node").alias("grp"), "doc", F.coalesce("linked", "doc").alias("linked"), F.lit(1).alias("n"), "sketch"), "dense")
    met = crossed(wide, NODE_ROWS, ["sketch"], 32 * NODE_ROWS).withColumnRenamed("grp", "node")
    return joined_up(linked, stash(sketch_edges(met, cutoff), "edges"))


def joined_up(linked: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (v, root) with further edges (a, b)."""
    if edges.isEmpty():
        return linked
    return components(linked.filter("v <> root").select(F.col("root").alias("a"), F.col("v").alias("b")).unionByName(edges))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal first column, of two rows or more."""
    held: list[pa.RecordBatch] = []
    held_key, held_rows = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if held and keys[i] != held_key:
                if held_rows > 1:
                    yield pa.Table.from_batches(held)
                held, held_rows = [], 0
            if 0 < k < len(cuts) - 2 and j - i == 1:
                continue  # the usual case: alone
            held.append(batch.slice(i, j - i))
            held_key, held_rows = keys[i], held_rows + j - i
    if held_rows > 1:
        yield pa.Table.from_batches(held)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], schema=_EDGES)


def forest(m: int, linked) -> Iterator[tuple[int, int]]:
    """Spanning forest of a graph on range(m); linked(x, rest) gives those of rest linked to x."""
    rest = np.arange(m)
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            hit = linked(x, rest)
            for y in rest[hit].tolist():
                yield x, y
                todo.append(y)
            rest = rest[~hit]


def stars(docs: np.ndarray, edges: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The components of a forest on places of `docs` as (smallest, other): nodes that hold the same documents then say the same."""
    first: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    for x, y in edges:
        r = first[y] = first.get(x, x)
        members.setdefault(r, [r]).append(y)
    out = []
    for places in members.values():
        ids = sorted(docs[places].tolist())
        out += [(ids[0], i) for i in ids[1:]]
    return out


def sketch_edges(rows: DataFrame, cutoff: float) -> DataFrame:
    """Spanning stars of the nodes of (node, doc, sketch), by agreement of sketches."""
    need = math.ceil(cutoff * TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            docs = group.column(1).to_numpy()
            s = np.frombuffer(b"".join(group.column(2).to_pylist()), np.uint16).reshape(-1, TOKENS)
            pairs = stars(docs, forest(len(docs), lambda x, rest: (s[rest] == s[x]).sum(1) >= need))  # noqa: B023
            if pairs:
                yield _edges(pairs)

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a bigint, b bigint")


def set_edges(rows: DataFrame, threshold: int) -> DataFrame:
    """Spanning stars of the groups of (grp, doc, shingles), confirmed on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            docs = group.column(1).to_numpy()
            each = [np.frombuffer(b, np.uint64) for b in group.column(2).to_pylist()]
            sizes = np.array([len(e) for e in each])
            ids = np.unique(np.concatenate(each), return_inverse=True)[1].astype(np.int32)
            ends = np.cumsum(sizes)
            flag = np.zeros(int(ids.max()) + 1, bool)

            def linked(x: int, rest: np.ndarray) -> np.ndarray:
                mine = ids[ends[x] - sizes[x] : ends[x]]  # noqa: B023
                flag[mine] = True  # noqa: B023
                if len(rest) * 4 > len(docs):  # noqa: B023
                    both = np.add.reduceat(flag[ids], ends - sizes, dtype=np.int64)[rest]  # noqa: B023
                else:
                    both = np.array([np.count_nonzero(flag[ids[ends[y] - sizes[y] : ends[y]]]) for y in rest])  # noqa: B023
                flag[mine] = False  # noqa: B023
                return 100 * both >= threshold * (sizes[x] + sizes[rest] - both)  # noqa: B023

            pairs = stars(docs, forest(len(docs), linked))
            if pairs:
                yield _edges(pairs)

    return rows.select("grp", "doc", "shingles").repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, n_shingles, component_id, kept) for each row of `docs`.

    Documents whose shingle sets have Jaccard similarity of threshold percent or more are
    linked; component_id is the smallest key reachable, kept where it is the row's own.  Null
    and empty texts, and texts of white space, have no shingles and no links.  Rows that repeat
    a key are one document, with the links of all its texts.  Rows without a key are returned
    with null component, kept true, and link nothing.  Empty tables give no rows; other columns
    are ignored.
    """
    feats = stash(features(docs, key, text), "features")
    named = F.struct("hi", "lo", "n")
    several = feats.filter("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min(named).alias("a"), F.max(named).alias("b")).filter("a < b").select("doc_id")
    several = stash(several, "several")
    if not several.isEmpty():
        return _several_texts(docs, several, threshold, recall, key, text)
    salts = max(SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    live = feats.filter("doc_id is not null and n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    same = ["hi", "lo", "n"]
    salted = live.groupBy(*same, "salt").agg(F.min("doc_id").alias("rep"))
    sets = salted.groupBy(*same).agg(F.min("rep").alias("rep"), F.collect_list("salt").alias("salt")).withColumn("salt", F.explode("salt"))
    same = [*same, "salt"]
    members = stash(live.select("doc_id", *same).join(sets, same).select("doc_id", "n", "rep"), "members")
    reps = live.join(sets, same).filter("doc_id = rep").select(F.col("doc_id").alias("doc"), "sketch").dropDuplicates(["doc"])
    near = sketch_links(stash(reps, "sets"), threshold, recall)
    sized = near.join(members.groupBy("rep").agg(F.max("n").alias("n")), near["v"] == F.col("rep")).select("v", "root", "n")
    size = sized.groupBy("root").agg(F.sum("n").alias("all_n"), F.count("*").alias("docs"))
    placed = stash(sized.join(size, "root"), "candidates")
    fits = (F.col("all_n") <= GROUP_SHINGLES) & (F.col("docs") <= GROUP_DOCS)
    sets = stash(shingle_sets(docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("binary").alias("body")), placed.select(F.col("v").alias("doc"), "root", fits.alias("fits"))), "sets")
    links = components(stash(set_edges(sets.filter("fits").withColumnRenamed("root", "grp"), threshold), "links"))
    large = placed.filter(~fits)
    if not large.isEmpty():
        sets = sets.filter("not fits").select("doc", "shingles")
        blocks = F.ceil(F.greatest(F.col("all_n") * 2 / GROUP_SHINGLES, F.col("docs") * 2 / GROUP_DOCS))
        dealt = large.withColumn("deal", F.explode(F.sequence(F.lit(1), F.lit(DEALS)))).select(F.col("v").alias("doc"), "root", F.xxhash64("root", "deal", F.pmod(F.xxhash64("v", "deal"), blocks)).alias("grp"))
        known = stash(large.join(feats.select(F.col("doc_id").alias("v"), "sketch").dropDuplicates(["v"]), "v"), "known")
        hubs = dealt.select("root", "grp").distinct().join(_hubs(known), "root").select("doc", "grp")
        dealt = stash(dealt.select("doc", "grp").unionByName(hubs).distinct(), "dealt")
        found = components(stash(set_edges(sets.join(dealt, "doc"), threshold), "links"))
        linked = large.join(found.select("v", F.col("root").alias("linked")), "v", "left")
        linked = stash(linked.select(F.col("v").alias("doc"), F.col("root").alias("grp"), F.coalesce("linked", "v").alias("linked"), "n"), "linked")
        apart = linked.groupBy("grp").agg(F.min("linked").alias("l"), F.max("linked").alias("m")).filter("l < m").select("grp")
        linked = stash(linked.join(apart, "grp", "left_semi"), "apart")
        if not linked.isEmpty():
            found = joined_up(found, stash(set_edges(sets.join(_unlinked(sets.join(linked, "doc"), threshold), "doc"), threshold), "links"))
        links = links.unionByName(found)
    found = members.join(links, members["rep"] == links["v"], "left").withColumn("component_id", F.coalesce("root", "rep")).select("doc_id", "n", "component_id")
    found = found.unionByName(feats.filter("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return found.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _several_texts(docs: DataFrame, several: DataFrame, threshold: int, recall: float, key: str, text: str) -> DataFrame:
    """near_duplicates() where some keys, `several`, stand for more than one text: each such text links under a name of its own.

    The components that a key's texts are in are then joined up.  A name is a 64-bit hash of key
    and text, or the key itself where it has one text.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("body")).join(several.withColumn("__jx_several", F.lit(True)), "doc_id", "left")
    name = F.when(F.col("__jx_several"), F.xxhash64("doc_id", F.coalesce("body", F.lit("")))).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", name.alias("name"), "body")
    names = stash(rows.filter("doc_id is not null").select("name", "doc_id").distinct(), "names")
    # no name stands for two texts here, so this goes one level deep
    each = stash(near_duplicates(rows.select("name", "body"), threshold, recall, "name", "body").drop("kept"), "texts")
    placed = each.filter("name is not null and n_shingles > 0").select("name", "component_id").distinct().join(names, "name")
    firsts = placed.groupBy("doc_id").agg(F.min("component_id").alias("a"))
    edges = placed.join(firsts, "doc_id").filter("component_id > a").select("a", F.col("component_id").alias("b")).distinct()
    roots = components(stash(edges, "edges"))
    placed = stash(placed.join(roots, placed["component_id"] == roots["v"], "left").select("name", "doc_id", F.coalesce("root", "component_id").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("least"))
    told = stash(placed.join(least, "root").select(F.col("name").alias("__jx_name"), "least"), "told")
    found = each.join(names, "name", "left").join(told, (F.col("name") == F.col("__jx_name")) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("least", "doc_id")  # a text without words is linked with nothing
    return found.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def shingle_sets(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows (doc, root, fits) of `groups` with their sets of shingles, sorted 64-bit hashes; other texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, 3):
            all_, offs = shingles(data, offsets)
            packed = [np.unique(all_[i:j]).tobytes() for i, j in zip(offs, offs[1:])]
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(packed, pa.binary())], names=["doc", "root", "fits", "shingles"])

    found = flagged(texts, ["doc"], groups).filter("__jx_maybe").select("doc", "body").join(groups, "doc")
    return found.select("doc", "root", "fits", "body").mapInArrow(run, "doc bigint, root bigint, fits boolean, shingles binary")


def prefixes(rows: DataFrame, threshold: int) -> DataFrame:
    """(grp, doc, linked, n, lead): the groups of rows (grp, doc, linked, n, shingles) by each shingle of their prefixes.

    Shingles are in one order, the rare first.  Two sets of similarity t share at least t of the
    larger and 2t / (1 + t) of the smaller set, so the first shingle they share is among the
    first 1 - t of the larger and the first 1 - 2t / (1 + t), the lead, of the smaller one.
    That holds in any order, so counts from some documents only make the groups small.
    """
    every = F.lit(rows.count() // ORDER_DOCS + 1)

    def all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(packed, np.int64))], names=["shingle"])

    some = rows.filter(F.pmod(F.xxhash64("doc", F.lit(1)), every) == 0).select("shingles")
    counts = some.mapInArrow(all_shingles, "shingle bigint").groupBy("shingle").count().filter("count > 1")
    got = counts.orderBy(F.desc("count")).limit(COMMON).toArrow()
    common, often = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(common)
    sent = rows.sparkSession.sparkContext.broadcast((common[order], often[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = sent.value
        for got in batches:
            if not got.num_rows:
                continue
            parts, lead, sizes = [], [], []
            for packed in got.column(4).to_pylist():
                one = np.frombuffer(packed, np.uint64)
                n = len(one)
                known = np.zeros(n, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, one), len(common) - 1)
                    known = np.where(common[at] == one, often[at], 0)
                size = n + threshold * n // -100 + 1 if n else 0
                parts.append(one[np.lexsort((one, known))[:size]])
                lead.append(np.arange(size) <= n + 2 * threshold * n // -(100 + threshold))
                sizes.append(size)
            of = np.repeat(np.arange(got.num_rows), sizes)
            grp = mix64(got.column(0).to_numpy(zero_copy_only=False).view(np.uint64)[of] ^ np.concatenate(parts))
            cols = [got.column(c).take(pa.array(of)) for c in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(grp.view(np.int64)), *cols, pa.array(np.concatenate(lead), pa.bool_())], names=["grp", "doc", "linked", "n", "lead"])

    return rows.select("grp", "doc", "linked", "n", "shingles").mapInArrow(run, "grp bigint, doc bigint, linked bigint, n bigint, lead boolean")


def _unlinked(rows: DataFrame, threshold: int) -> DataFrame:
    """Groups (doc, grp) in which all pairs at the threshold, in a group of (doc, grp, linked, n, shingles) and not linked yet, meet."""
    found = stash(prefixes(rows, threshold).withColumn("n", F.greatest(F.col("n"), F.lit(GROUP_SHINGLES // GROUP_DOCS))), "prefixes")
    name = [F.expr(f"bit_xor(xxhash64(doc, {k}))").alias(f"h{k}") for k in range(2)]
    keys = found.groupBy("grp").agg(F.count("*").alias("docs"), F.bool_or("lead").alias("lead"), F.min("linked").alias("l"), F.max("linked").alias("m"), *name)
    # near copies share many shingles: the same documents are one group
    keys = keys.filter("lead and l < m").groupBy("docs", "h0", "h1").agg(F.min("grp").alias("grp")).select("grp")
    return stash(crossed(found.join(keys, "grp"), GROUP_SHINGLES, []).select("doc", "grp"), "meeting")


def _parts(rows: DataFrame, most: int, top: int) -> DataFrame:
    """(grp, bulk, b, r) of groups of (grp, doc, linked, n) that are not all linked.

    bulk is what the largest part is linked as; b and r are the numbers of blocks of it and of the rest.
    """
    parts = rows.groupBy("grp", "linked").agg(F.sum("n").alias("n"))
    parts = parts.groupBy("grp").agg(F.max_by("linked", F.struct("n", "linked")).alias("bulk"), F.max("n").alias("b_n"), F.sum("n").alias("all_n")).filter("b_n < all_n")
    half = F.greatest(F.lit(most), F.least(F.lit(top), F.col("all_n") / 32)) / 2
    return parts.select("grp", "bulk", F.ceil(F.col("b_n") / half).alias("b"), F.ceil((F.col("all_n") - F.col("b_n")) / half).alias("r"))


def crossed(rows: DataFrame, most: int, columns: list[str], top: int | None = None) -> DataFrame:
    """Rows (grp, doc, linked, n, *columns) dealt to new groups of `most` n or so, in which all that differ in `linked` meet.

    A group is cut into blocks of half the size, and each two blocks are a new group.  What is linked in the
    largest part of a group needs no comparing, so its blocks meet the others only.  Of a large group the blocks
    may grow up to `top`, which keeps the copies of a row few.
    """
    block = "if(linked = bulk, -1 - pmod(xxhash64(doc), b), pmod(xxhash64(doc), r))"
    met = "if(linked = bulk, sequence(0L, r - 1), concat(sequence(-b, -1L), array_remove(sequence(0L, r - 1), own)))"
    dealt = rows.join(_parts(rows, most, top or most), "grp").withColumn("own", F.expr(block)).withColumn("other", F.explode(F.expr(met)))
    return dealt.select(F.expr("xxhash64(grp, least(own, other), greatest(own, other))").alias("grp"), "doc", *columns)


def _hubs(known: DataFrame) -> DataFrame:
    """(root, doc): up to HUBS documents of each large group that agree most with its commonest tokens.

    They join every block of the group, so that copies which only resemble one original hang
    together.  Both steps combine map-side; no group is gathered.
    """
    token = F.expr(f"transform(sequence(0, {TOKENS - 1}), i -> substring(sketch, 2 * i + 1, 2))")
    counts = known.select("root", F.posexplode(token).alias("i", "t")).groupBy("root", "i", "t").count()
    usual = counts.groupBy("root", "i").agg(F.max_by("t", F.struct("count", "t")).alias("t"))
    usual = usual.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("i", "t"))).alias("usual"))
    agree = F.aggregate(F.expr(f"transform(sequence(0, {TOKENS - 1}), i -> if(element_at(usual, i) = substring(sketch, 2 * i + 1, 2), 1, 0))"), F.lit(0), lambda a, x: a + x)
    scored = known.join(usual, "root").select("root", "v", agree.alias("agree"), F.pmod(F.xxhash64("v"), F.lit(HUBS)).alias("slot"))
    return scored.groupBy("root", "slot").agg(F.max_by("v", F.struct("agree", "v")).alias("doc")).select("root", "doc")


def drop_near(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, with all columns: one document of each component.

    Rows without a key and texts without words stay; empty tables give no rows; extra columns
    are carried, whatever their names.
    """
    return without(docs, "doc_id", near_duplicates(docs, **options).filter("not kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), threshold=85)


SQL: dict[str, str] = {}
QUERIES = {"op7_near_dedup": op7_near_dedup}
