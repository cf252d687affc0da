"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

Documents are sets of five-word shingles (words: lower-cased runs between white space).
Texts with equal words are one class.  Each class has ``TREES`` labels of ``DEPTH`` minimum
hashes of 16 bits.  The labels of all trees are sorted once over the cluster: a prefix trie, in
which the classes below a node stand next to each other.  A class that shares no prefix of the
least useful length with a neighbour is in no node and goes no further.

Matched prefixes are shortened until the target recall is met.  Each pair of a class with the
first class of its node stands for 1 / P(found) pairs of its own similarity (read off the
whole signatures), so the pairs met at the shortest prefix give the share that longer ones
would find; the longest that finds enough is used.  The shortest one finds even pairs at the
threshold with the target probability.

Inside nodes pairs are verified by their signatures, ``SIGMAS`` standard deviations below the
threshold: each class with the first of its node, and those that fail with all the others.
Verified pairs make components, and all pairs in a component are compared exactly, so its links
do not depend on which prefixes happened to agree.

Defined results: null or blank texts have no shingle and link with nothing, not even each
other; texts of fewer than five words have one shingle of all their words; copies link with
each other; rows that repeat an id are documents of their own; rows without an id link with
nothing; pairs at the threshold exactly are links; very long texts are whole sets, which tiles
compare a bounded number of shingles at a time; extra columns are ignored by
:func:`jaccard_join` and carried along by :func:`deduplicate`, whatever their names; an empty
table gives no rows.

Scale: one pass over the texts gives ids, labels and a hash; texts are read again only for
members of components.  Trie nodes, groups and classes may be of any size: sorted runs are cut
anywhere, nodes are reduced to star edges by a partially aggregated minimum, and what is
compared in full is cut into tiles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.common import bounded_batches, exact_id, materialize, table
from assayer.llm.linkage import by_group, compare_tiles, components, cross_tile_rows, distinct_sets, tile_rows

NGRAM, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 8, 0.9995
#: How far below the threshold a pair's signatures may estimate it, in standard deviations.
SIGMAS = 4.0
#: Columns of the shingle matrix that a tile multiplies at a time, and shingles it holds.
CHUNK, HELD = 8192, 1 << 21
#: Characters of text in a block of a tile, about.
BLOCK_CHARS = 4 << 20
#: Shingles hashed at a time.
PIECE = 2048
#: Words whose hashes a worker remembers.
WORD_MEMORY = 200_000


class _WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_WORDS = _WordHashes()


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_WORDS) > WORD_MEMORY:
        _WORDS.clear()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8191)
    return (rng.integers(1, 1 << 31, (count, 1)) * 2 + 1).astype(np.uint32), rng.integers(0, 1 << 32, (count, 1)).astype(np.uint32)


def minhashes(sh: np.ndarray, seeds) -> np.ndarray:
    """Minimum of each seeded 32-bit hash over the shingles, a bounded piece at a time."""
    a, b = seeds
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (sh ^ (sh >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(x), PIECE):
        np.minimum(out, (x[None, at : at + PIECE] * a + b).min(axis=1), out=out)
    return out


def found_probability(similarity, depth: int, trees: int = TREES):
    """That two sets of this similarity share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def signatures(docs: DataFrame, id_col: str, text_col: str, trees: int, depth: int) -> DataFrame:
    """doc_id, text_key, size, class_key (null without shingles) and labels: the trees' minimum hashes, 16 bits each."""

    def run(batches):
        seeds = _seeds(trees * depth)
        for pdf in batches:
            keys, labels, sizes = [], [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                sh = shingles(text or "")
                sizes.append(len(text or ""))
                if not len(sh) or pd.isna(doc_id):
                    keys.append(None)
                    labels.append(None)
                    continue
                words = " ".join(text.lower().split())
                keys.append(hashlib.md5(words.encode("utf-8", "surrogatepass")).digest())
                m = minhashes(sh, seeds)
                labels.append((m ^ (m >> np.uint32(16))).astype("<u2").tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "size": np.array(sizes, np.int64), "class_key": keys, "labels": labels})

    rows = docs.selectExpr(exact_id(id_col, "doc_id"), f"xxhash64(`{text_col}`) AS text_key", f"`{text_col}` AS text")
    out = rows.mapInPandas(run, "doc_id string, text_key long, size long, class_key binary, labels binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def least_prefix(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix that finds pairs at the threshold with the target probability."""
    good = [p for p in range(1, depth + 1) if found_probability(threshold, p, trees) >= recall]
    if not good:
        raise ValueError(f"{trees} trees cannot find pairs at {threshold} with probability {recall}")
    return max(good)


def sorted_trie(classes: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(tree, label, node) of the classes that share a prefix of ``least`` hashes with a neighbour.

    The labels are sorted over all partitions.  Rows at the ends of a partition stay, as their
    other neighbour is in the partition beside.
    """
    at = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = classes.select("node", "labels", at.alias("tree"))
    rows = rows.select("tree", F.substr("labels", F.col("tree") * (2 * depth) + 1, F.lit(2 * depth)).alias("label"), "node")
    rows = rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")

    def keep(batches):
        held, matched = None, True  # the row before; whether it stays already (the first one does)
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            label = np.frombuffer(b"".join(pdf["label"]), np.uint8).reshape(len(pdf), -1)[:, : 2 * least]
            tree = pdf["tree"].to_numpy()
            same = (tree[1:] == tree[:-1]) & (label[1:] == label[:-1]).all(axis=1)
            stays = np.concatenate([[matched], same])
            stays[:-1] |= same
            held, matched = pdf.iloc[-1:], bool(stays[-1])
            yield pdf.iloc[:-1][stays[:-1]]
        if held is not None:
            yield held

    return rows.mapInPandas(keep, "tree int, label binary, node long")


def trie_nodes(trie: DataFrame, prefix: int) -> DataFrame:
    """(group, node, root) of the trie's nodes of this depth with several classes; root is the smallest class."""
    nodes = trie.select("node", F.xxhash64("tree", F.substr("label", F.lit(1), F.lit(2 * prefix))).alias("group"))
    stars = nodes.groupBy("group").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return by_group(nodes, stars.drop("n"))


def signature_pairs(pairs: DataFrame, classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(src, dst, s, shared): estimated similarity and longest shared prefix of each pair."""
    side = lambda k: classes.select(F.col("node").alias(k), F.col("labels").alias(f"{k}_labels"))

    def run(batches):
        for pdf in batches:
            a, b = (np.frombuffer(b"".join(pdf[f"{k}_labels"]), "<u2").reshape(len(pdf), trees, depth) for k in ("src", "dst"))
            same = a == b
            shared = np.logical_and.accumulate(same, axis=2).sum(axis=2).max(axis=1, initial=0)
            yield pd.DataFrame({"src": pdf["src"], "dst": pdf["dst"], "s": same.mean(axis=(1, 2)), "shared": shared.astype(np.int32)})

    return pairs.join(side("src"), "src").join(side("dst"), "dst").mapInPandas(run, "src long, dst long, s double, shared int")


def shortened(pairs: DataFrame, threshold: float, trees: int, depth: int, least: int, recall: float) -> int:
    """The longest prefix that finds the target share of the pairs above the threshold, by an estimate from pairs met at the least one."""
    near = pairs.filter(F.col("s") >= threshold).withColumn("w", 1 / (1 - F.pow(1 - F.pow("s", F.lit(least)), F.lit(trees))))
    longer = range(least + 1, depth + 1)
    found = near.agg(F.sum("w").alias("all"), *[F.sum(F.when(F.col("shared") >= p, F.col("w"))).alias(f"p{p}") for p in longer]).first()
    return max((p for p in longer if (found[f"p{p}"] or 0) >= recall * (found["all"] or 0)), default=least)


def _link_signatures(least: float, hashes: int):
    def link(tile: dict, left: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(tile["labels"]), "<u2").reshape(-1, hashes)
        node = tile["node"]
        out = [np.flatnonzero(((x[left:] == x[k]).mean(axis=1) >= least) & (node[left:] != node[k])) for k in range(left)]
        return np.repeat(np.arange(left), [len(o) for o in out]), np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.int64) + left

    return link


def candidate_groups(classes: DataFrame, threshold: float, trees: int, depth: int, recall: float) -> DataFrame:
    """(group, node): components of the pairs in trie nodes that their signatures verify."""
    least = least_prefix(threshold, trees, depth, recall)
    cut = threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / (trees * depth))
    trie = materialize(sorted_trie(classes, trees, depth, least), "trie")

    def stars(prefix: int) -> tuple[DataFrame, DataFrame]:
        nodes = materialize(trie_nodes(trie, prefix), "nodes")
        pairs = nodes.filter("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")).distinct()
        return nodes, materialize(signature_pairs(pairs, classes, trees, depth), "stars")

    nodes, pairs = stars(least)
    prefix = shortened(pairs, threshold, trees, depth, least, recall)
    if prefix > least:
        nodes, pairs = stars(prefix)
    edges = pairs.filter(F.col("s") >= cut).select("src", "dst")
    # classes that differ from the first of their node are compared with all others in it
    apart = pairs.filter(F.col("s") < cut).select(F.col("src").alias("node"), F.col("dst").alias("root"))
    apart = materialize(nodes.join(apart, ["node", "root"]).select("group", "node"), "apart")
    if not apart.isEmpty():
        edges = edges.unionByName(_apart_edges(nodes.select("group", "node"), apart, classes, float(cut), trees * depth))
    return components(edges).select(F.col("root").alias("group"), "node")


def _apart_edges(nodes: DataFrame, apart: DataFrame, classes: DataFrame, cut: float, hashes: int) -> DataFrame:
    """(src, dst): pairs of classes ``apart`` with the others of their nodes, verified by signatures."""
    # nodes of several trees with the same classes are compared once
    mixed = materialize(by_group(nodes, apart.select("group").distinct()), "mixed")
    mixed = materialize(distinct_sets(mixed), "mixed")
    apart = materialize(by_group(apart, mixed.select("group").distinct()), "apart")
    tiles = cross_tile_rows(apart, mixed).join(classes.select("node", F.lit(1).alias("weight"), "labels"), "node")
    more = compare_tiles(tiles, ["labels"], _link_signatures(cut, hashes))
    return more.filter("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst"))


def _shared(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Shingles that each of the first ``left`` sets (all, if left is their number) has in common with each of the others."""
    n = len(sets)
    which, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    lo = 0 if left == n else left
    shared = np.zeros((left, n - lo), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, len(which) + CHUNK, CHUNK))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        m = np.zeros((n, min(CHUNK, len(which) - k * CHUNK)), np.float32)
        m[row[a:b], column[a:b] - k * CHUNK] = 1
        shared += m[:left] @ m[lo:].T
    return shared


def _link(threshold: float):
    def link(tile: dict, left: int) -> tuple[np.ndarray, np.ndarray]:
        sets = [shingles(t) for t in tile["text"]]
        n = len(sets)
        size = np.array([len(s) for s in sets])
        lo = 0 if left == n else left
        if size.sum() <= HELD:
            shared = _shared(sets, left)
        else:  # very long texts: one text against the others
            shared = np.array([[np.isin(sets[a], sets[b], True).sum() for b in range(lo, n)] for a in range(left)], np.float32)
        total = size[:left, None] + size[None, lo:] - shared
        a, b = np.nonzero(shared >= threshold * total - 1e-9)
        b = b + lo
        keep = a < b
        return a[keep], b[keep]

    return link


def linked_classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, trees: int, depth: int, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their class, the classes, and the links between classes."""
    bounded_batches(docs.sparkSession)
    slim = materialize(signatures(docs, id_col, text_col, trees, depth), "signatures")
    classes = slim.filter(F.col("class_key").isNotNull()).groupBy("class_key")
    classes = classes.agg(F.min(F.struct("doc_id", "text_key")).alias("own"), F.count(F.lit(1)).alias("weight"), F.max("size").alias("size"), F.first("labels").alias("labels"))
    classes = materialize(classes.withColumn("node", F.xxhash64("class_key")), "classes")
    groups = materialize(candidate_groups(classes, threshold, trees, depth, recall).join(classes.select("node", "size", "weight", "own"), "node"), "groups")
    texts = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"xxhash64(`{text_col}`) AS text_key", f"`{text_col}` AS text")
    # texts are shuffled once, at any size of the groups
    held = texts.join(groups.select("node", "weight", "own.*").hint("merge"), ["doc_id", "text_key"]).groupBy("node").agg(F.first("weight").alias("weight"), F.first("text").alias("text"))
    tiles = tile_rows(groups.select("group", "node", "size"), most_size=BLOCK_CHARS).join(held, "node")
    return slim, classes, materialize(compare_tiles(tiles, ["text"], _link(threshold)), "links")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """doc_id, n_links, class_id of every document; class_id is the smallest linked id."""
    return class_table(*linked_classes(docs, id_col, text_col, threshold, trees, depth, recall))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component its smallest id stays.

    Rows without a shingle or without an id stay; of rows that repeat both id and text one
    stays, the first by its other columns.
    """
    slim, classes, linked = linked_classes(docs, id_col, text_col, threshold, trees, depth, recall)
    roots = components(linked.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    own = classes.select("node", "own").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("r")).agg(F.min("own").alias("own"))
    # rows travel as one column, so no name of theirs can clash
    a, b = "near_id", "near_text"
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    tagged = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(row, F.col(f"`{id_col}`").cast("long").alias(a), F.xxhash64(F.col(f"`{text_col}`")).alias(b))
    # one row of each id and text; Spark limits them on both sides of the exchange
    rest = [F.col("row")[c].cast("string") for c in docs.columns if c not in (id_col, text_col)]
    first = F.row_number().over(W.partitionBy(a, b).orderBy(*rest, F.lit(1)))
    kept = own.select(F.col("own.doc_id").alias(a), F.col("own.text_key").alias(b))
    stays = tagged.withColumn("nth", first).filter(F.col("nth") <= 1).join(kept, [a, b])
    # texts without a shingle have no printable ASCII character, which few others lack
    blank = slim.filter(F.col("class_key").isNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(a), F.col("text_key").alias(b)).distinct()
    alone = tagged.filter(~F.coalesce(F.col("row")[text_col], F.lit("")).rlike("[!-~]")).join(blank, [a, b])
    return stays.select("row.*").unionByName(alone.select("row.*")).unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))


def class_table(slim: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """doc_id, n_links, class_id of every row of ``slim`` (doc_id, class_key).

    classes: class_key, node, own (its smallest row), weight; linked: node, links, root.
    """
    roots = components(linked.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    out = classes.select("class_key", "node", "own.doc_id", "weight").join(counts, "node", "left").join(roots, "node", "left")
    out = materialize(out.withColumn("root", F.coalesce("root", "node")), "classes")
    least = out.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = out.join(least, "root").select("class_key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # rows without a class get a key of their own, so they are no hot key
    key = F.coalesce("class_key", F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")).cast("binary"))
    rows = slim.select("doc_id", key.alias("class_key")).join(out, "class_key", "left")
    return rows.select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"))


def jaccard_report(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


#: Brute force in DuckDB SQL: all pairs that share a shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT ws, MIN(doc_id) AS rep, COUNT(*) AS weight FROM w WHERE len(ws) > 0 GROUP BY ws
), s AS (
  SELECT DISTINCT rep, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) AS g FROM (SELECT rep, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM c)
), n AS (SELECT rep, COUNT(*) AS k FROM s GROUP BY rep),
p AS (
  SELECT a.rep AS x, b.rep AS y, COUNT(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.rep = x JOIN n b ON b.rep = y WHERE common >= 0.8 * (a.k + b.k - common)
), r AS (
  SELECT rep AS node, rep AS root FROM c UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node
), t AS (SELECT node, MIN(root) AS root FROM r GROUP BY node),
m AS (SELECT x, SUM(weight) AS k FROM l JOIN c ON c.rep = l.y GROUP BY x)
SELECT d.doc_id, CAST(COALESCE(m.k, 0) + COALESCE(c.weight - 1, 0) AS BIGINT) AS n_links, COALESCE(t.root, d.doc_id) AS class_id
FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN c ON c.ws = w.ws LEFT JOIN t ON t.node = c.rep LEFT JOIN m ON m.x = c.rep
"""
