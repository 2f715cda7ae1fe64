"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text is the set of its hashed runs of five words (letters and digits, lower case); a text of one to four words is
one run. Signatures of TREES x DEPTH minima are the labels of TREES prefix tries, each sorted by label, so that texts
with a common prefix are neighbours. Matched prefixes start whole, at DEPTH minima, and are shortened one by one, for
texts that longer ones haven't joined, down to the length at which the chance that a pair at the threshold shares one
in some trie reaches the target recall. Texts that meet and whose signatures agree enough make groups, and in
each group every pair's Jaccard similarity is computed on its whole sets.

Texts with equal sets are one class, compared once. Pairs are never rows: tasks return link counts and spanning
forests, so a group of n near copies costs n rows. Groups over a block are cut into a grid of blocks.

Defined cases: a text without words (null, empty, only punctuation) links with nothing and is its own class. Texts
that differ in case or punctuation alone are copies. Repeated rows are copies. An empty table gives an empty result.
Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.components import Forest, components
from loomtext.llm.runs import crossing, dealt, gridded, runs
from loomtext.llm.tokens import mix, slices, token_hashes
from loomtext.session import pinned, small_side

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.9995
SMALL = 64
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: Sequence[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    h, bounds = token_hashes(texts)
    out: list[np.ndarray] = []
    n = len(h)
    rolled = np.zeros(max(0, n - words + 1), np.uint64)
    for j in range(words):
        rolled = rolled * _STEP + h[j : n - words + 1 + j] if len(rolled) else rolled
    rolled = mix(rolled)
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix(np.array([int.from_bytes(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little")], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def matched_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, shortened from `depth`, on which pairs at the threshold meet in a trie often enough."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def signatures(sets: list[np.ndarray], width: int) -> np.ndarray:
    """(texts, width) 16-bit minima; sets must not be empty."""
    values = np.concatenate(sets)
    heads = np.cumsum([0, *map(len, sets[:-1])])
    draw = np.random.default_rng(20)
    out = np.empty((len(sets), width), np.uint16)
    for p in range(width):
        a, b = (np.uint64(x) for x in draw.integers(1, 1 << 63, 2))
        minima = np.minimum.reduceat(((values * (a * np.uint64(2) + np.uint64(1)) + b) >> np.uint64(32)).astype(np.uint32), heads)
        out[:, p] = mix(minima.astype(np.uint64)) & np.uint64(0xFFFF)
    return out


def sign(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, set_hash, signature) for every row; set_hash is null for texts without words."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for i, j in slices(texts):
                sets = shingle_sets(texts[i:j])
                some = [k for k, s in enumerate(sets) if len(s)]
                rows = signatures([sets[k] for k in some], width) if some else None
                hashes, signs = [None] * (j - i), [None] * (j - i)
                for r, k in enumerate(some):
                    hashes[k], signs[k] = hashlib.md5(sets[k].tobytes()).digest(), rows[r].tobytes()
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[i:j], "text_hash": batch["text_hash"].iloc[i:j], "set_hash": hashes, "signature": signs})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.md5(F.col("text").cast("binary")).alias("text_hash"))
    out = rows.mapInPandas(signed, "doc_id string, text_hash string, set_hash binary, signature binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def trie_edges(signs: np.ndarray, labels: np.ndarray, wanted: Callable[[int, np.ndarray], np.ndarray], shortest: int, least: float) -> Iterator[tuple[int, int]]:
    """Edges that span what one subtree of a trie joins; rows are sorted by label and share `shortest` minima of it.

    From the whole label down to that length, rows with a common prefix are compared if a longer one hasn't compared
    or joined them. They are joined if their signatures agree in a share of `least`; `wanted` masks the rows to compare with one.
    """
    depth = labels.shape[1]
    common = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(axis=1)
    joined, child = np.arange(len(signs)), np.arange(len(signs))
    for length in range(depth, shortest - 1, -1):
        starts = np.concatenate([[0], np.flatnonzero(common < length) + 1, [len(signs)]])
        for s, e in zip(starts[:-1], starts[1:]):
            for i in range(s, e - 1):
                rest = i + 1 + np.flatnonzero((joined[i + 1 : e] != joined[i]) & (child[i + 1 : e] != child[i]))
                if len(rest):
                    rest = rest[wanted(i, rest)]
                    near = rest[(signs[rest] == signs[i]).mean(axis=1) >= least]
                    if len(near):
                        yield from ((i, int(x)) for x in near)
                        joined[np.isin(joined, joined[near])] = joined[i]
        child = np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def near_groups(classes: DataFrame, *, trees: int, depth: int, shortest: int, threshold: float) -> DataFrame:
    """Edges of a spanning forest of classes that share `shortest` minima of a trie and whose signatures agree enough.

    Enough is the threshold less five standard deviations of the agreement of a pair at the threshold. A subtree of
    a trie is in one task, or in the tasks of its grid of blocks.
    """
    width = trees * depth
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / width)
    prefix = F.expr(f"transform(sequence(0, {trees - 1}), t -> xxhash64(substring(signature, int(t * {2 * depth} + 1), {2 * shortest}), t))")
    labels = classes.select("node", F.posexplode(prefix).alias("tree", "label"))
    key = ["tree", "label", "lo", "hi"]

    def match(frame: pd.DataFrame, bounds: np.ndarray) -> Iterator[pd.DataFrame]:
        signs = np.frombuffer(b"".join(frame["signature"]), np.uint16).reshape(-1, width)
        node, own = frame["node"].to_numpy(), frame["own"].to_numpy()
        lo, hi, tree = frame["lo"].to_numpy(), frame["hi"].to_numpy(), frame["tree"].to_numpy()
        forest = Forest()
        for size in np.unique(np.diff(bounds)):
            starts = bounds[:-1][np.diff(bounds) == size]
            if size > SMALL:
                for s in starts:
                    part, cell = signs[s : s + size], own[s : s + size]
                    labels = part[:, tree[s] * depth : (tree[s] + 1) * depth]
                    wanted = lambda i, rest, cell=cell, s=s: crossing(cell[i], cell[rest], lo[s], hi[s])
                    forest.link((int(node[s + i]), int(node[s + j])) for i, j in trie_edges(part, labels, wanted, shortest, least))
            elif size > 1:  # so few that all pairs of many subtrees are compared at once
                first, second = np.triu_indices(size, 1)
                for some in np.array_split(starts, max(1, len(starts) * len(first) // 50_000)):
                    a, b = (some[:, None] + first).ravel(), (some[:, None] + second).ravel()
                    good = ((signs[a] == signs[b]).mean(axis=1) >= least) & crossing(own[a], own[b], lo[a], hi[a])
                    forest.link(zip(node[a[good]].tolist(), node[b[good]].tolist()))
        yield forest.frame()

    # Signatures join only the labels that two classes share.
    shared = gridded(labels, ["tree", "label"], "node").join(classes.select("node", "signature"), "node")
    leaf = F.expr(f"substring(signature, int(tree * {2 * depth} + 1), {2 * depth})")
    return dealt(shared.withColumn("leaf", leaf), key, "leaf").drop("leaf").mapInPandas(lambda batches: runs(batches, key, match), "a long, b long")


def verified(docs: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): for each pair of a group's classes with Jaccard >= threshold, links counts b's copies at a; forest edges have null links."""
    key = ["root", "lo", "hi"]

    def verify(frame: pd.DataFrame, bounds: np.ndarray) -> Iterator[pd.DataFrame]:
        node, own, copies = frame["node"].to_numpy(), frame["own"].to_numpy(), frame["copies"].to_numpy()
        lo, hi = frame["lo"].to_numpy(), frame["hi"].to_numpy()
        texts = frame["text"].tolist()
        links = np.zeros(len(frame), np.int64)
        forest = Forest()
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s < 2:
                continue
            sets = [x for i, j in slices(texts[s:e]) for x in shingle_sets(texts[s + i : s + j])]
            order = np.argsort([len(x) for x in sets], kind="stable")
            sets, rows = [sets[k] for k in order], s + order
            sizes = np.array([len(x) for x in sets])
            # Of two sets the smaller has at least the threshold's share of the larger: those after `ends` are too large.
            ends = np.searchsorted(sizes, sizes / threshold + 1e-9, side="right")
            _, slot = np.unique(np.concatenate(sets), return_inverse=True)
            heads = np.concatenate([[0], np.cumsum(sizes)])
            mark = np.zeros(int(slot.max()) + 1, np.int32)
            for i in np.flatnonzero(ends > np.arange(len(sets)) + 1).tolist():
                mine, rest = slot[heads[i] : heads[i + 1]], rows[i + 1 : ends[i]]
                mark[mine] = 1
                shared = np.add.reduceat(mark[slot[heads[i + 1] : heads[ends[i]]]], heads[i + 1 : ends[i]] - heads[i + 1])
                mark[mine] = 0
                near = (shared >= threshold * (sizes[i] + sizes[i + 1 : ends[i]] - shared) - 1e-9) & crossing(own[rows[i]], own[rest], lo[s], hi[s])
                good = rest[near]
                links[rows[i]] += copies[good].sum()
                links[good] += copies[rows[i]]
                forest.link((int(node[rows[i]]), int(x)) for x in node[good])
        some = links > 0
        edges = forest.frame()
        edges["links"] = pd.Series(pd.NA, index=edges.index, dtype="Int64")
        yield edges
        yield pd.DataFrame({"a": node[some], "b": node[some], "links": pd.array(links[some], dtype="Int64")})

    wanted = small_side(pinned(gridded(groups, ["root"], "node", block=512), "wanted"))
    texts = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("text_hash"))
    same = texts["doc_id"].eqNullSafe(wanted["rep_id"]) & (texts["text_hash"] == wanted["rep_hash"])
    rows = texts.join(wanted, same).select("node", "copies", "text", "own", *key)
    return dealt(rows, key).mapInPandas(lambda batches: runs(batches, key, verify), "a long, b long, links long")


def join(docs: DataFrame, *, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """For every row: doc_id, text_hash, class_id (the least doc_id of its class), n_links (other rows it links to),
    is_representative (the row that stands for its class; repeated rows of it too)."""
    shortest = matched_depth(threshold, trees, depth, recall)
    rows = pinned(sign(docs, trees * depth), "signed")
    # One row for each set of shingles. Node numbers are fixed by being written.
    classes = rows.where("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("*").alias("copies"), F.min("signature").alias("signature"))
    classes = pinned(classes.select("set_hash", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "copies", "signature", F.monotonically_increasing_id().alias("node")), "classes")
    groups = components(near_groups(classes, trees=trees, depth=depth, shortest=shortest, threshold=threshold))
    # A representative that is repeated, doc_id and all, must come back once.
    repeated = not rows.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
    texts = docs.select("doc_id", "text").dropDuplicates(["doc_id", "text"]) if repeated else docs.select("doc_id", "text")
    grouped = classes.select("node", "rep_id", "rep_hash", "copies").join(groups, "node")
    found = pinned(verified(texts, grouped, threshold), "verified")
    links = found.where("links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("links IS NULL").select("a", "b"))
    named = classes.select("node", "rep_id").join(roots, "node").groupBy("root").agg(F.min("rep_id").alias("class_id"), F.min(F.struct("rep_id", "node")).alias("first"))
    named = roots.join(named, "root").select("node", "class_id", (F.col("node") == F.col("first.node")).alias("leads"))
    about = classes.join(named, "node", "left").join(links, "node", "left").select(
        "set_hash", F.coalesce("class_id", "rep_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("leads", F.lit(True)).alias("leads"), "rep_id", "rep_hash")
    named = rows.where("set_hash IS NOT NULL").select("doc_id", "text_hash", "set_hash").join(about, "set_hash").select(
        "doc_id", "text_hash", "class_id", F.col("n_links").cast("long").alias("n_links"), (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))).alias("is_representative"))
    # Texts without words stay out of the join, where their nulls would be one key.
    alone = rows.where("set_hash IS NULL").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("is_representative"))
    return named.unionByName(alone)
