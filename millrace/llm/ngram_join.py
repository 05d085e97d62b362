"""N-gram Jaccard join by prefix trees: documents link where their sets of word 4-grams overlap by `PERCENT`.

Two steps come before the trees. Equal sets are one node, whatever the number of rows. Then a lossless filter finds the
sets that can have a partner: sets that meet the bound differ in at most h grams, h following from their sizes, so of
h + 1 + e parts that gram hashes are dealt to at least e + 1 are equal in both. e is chosen for each class of sizes so
that hardly any set has more than e empty parts; a set emits a key for each part that isn't empty, and for empty parts
too if it has more than e. A set alone on all its keys has no partner, so unrelated documents cost a few keys each and
go no further.

All sets that share a key get a link candidate to the least of them, their hub, so candidates grow with the keys, never
with pairs. Hub and members meet in a prefix tree: the grams of its sets get one order, most frequent first (ties by
hash), so that sets share long paths. The sets then walk the tree together: a node's overlap with each walker is added
once for all sets below it. A walker leaves a subtree where overlap plus the most that can still be common (bounded by
the longest set below and by what is left of the walker) can't reach the bound of the shortest set below, and it does
not enter one that is wholly linked to it already, so groups of near copies end at few leaves. Sets that nearly link
are compared node by node, in one array operation for all walkers. Groups beyond `GRAMS` are dealt to several trees,
with the hub in each. Where such a group is still in several components afterwards, a second round walks all its trees
by every member that isn't in its largest component; each missing link has such an end.

Defined cases: words are runs of other than ASCII white space, A-Z in lower case; fewer than 4 words make one gram; a null
or empty text has an empty set, links with nothing and is its own component; texts of any length are taken whole; equal
rows share a component; a null id takes part, but is never the smallest unless it is alone; an empty table gives an empty
one; only the id and the text column are read, so other columns cannot clash. Grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.batches import bounded_batches
from millrace.llm.links import components, least_ids
from millrace.runtime import release, settle, shuffled_join
from millrace.schema import col

WORDS = 4
PERCENT = 85
SEED = 11
GRAMS = 1 << 17  # grams of the sets of one tree, about
STORE = 1 << 17  # word hashes that a worker keeps
TABLE = 1 << 24  # bytes of the table of grams and walkers of one tree, about
BROADCAST_BYTES = 16 << 20  # of the bit map of wanted texts, at most
PART_BITS = 16  # of a hash, within one part of that map
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hashes of words, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= STORE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


_HASHES = _WordHashes()


def gram_set(text: str, size: int = WORDS) -> np.ndarray:
    """Hashes of the distinct n-grams, ascending. A gram's hash mixes the hashes of its words, each times an odd number of its place."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array(list(map(_HASHES.__getitem__, words)), np.uint64)
    places = np.multiply.accumulate(np.full(size, _GOLD))
    n = max(len(words) - size + 1, 1)
    grams = np.full(n, min(len(words), size), np.uint64)
    for k in range(min(len(words), size)):
        grams += hashes[k:k + n] * places[k]
    grams = np.sort(mixed(grams))
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])]


@functools.cache
def size_classes(percent: int) -> list[int]:
    """The least size of each class: a partner of a set is in its class or a neighbouring one."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(100 * out[-1] // percent + 1)
    return out


def _more_than(k: int, mean: float) -> float:
    """Chance that a Poisson number passes k."""
    if mean > 100:
        return math.erfc((k + 0.5 - mean) / math.sqrt(2 * mean)) / 2
    return max(1 - sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k + 1)), 0.0)


@functools.cache
def parts_of(number: int, percent: int) -> tuple[int, int]:
    """Parts and spare empty parts for pairs whose smaller set is in the class of this number.

    The spare is the least that under one set in a thousand passes, or, for small sets, the one that fewest pass.
    """
    low, high = size_classes(percent)[number], size_classes(percent)[number + 1] - 1
    most = high + 100 * high // percent  # of both sets together
    differ = most * (100 - percent) // (100 + percent)
    if not differ:
        return 1, 0
    best, spare = (2.0, 0), 0
    while best[0] > 1e-3 and spare <= best[1] + 8:
        parts = differ + 1 + spare
        best = min(best, (_more_than(spare, parts * math.exp(-low / parts)), spare))
        spare += 1
    return differ + 1 + best[1], best[1]


def part_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set (hashes, ascending): two sets that meet the bound share one."""
    if not len(grams):
        return np.zeros(0, np.uint64)
    classes = size_classes(percent)
    own = int(np.searchsorted(classes, len(grams), side="right")) - 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(grams + _GOLD))])
    out = []
    for number in (own, own - 1):
        if number < 0 or 100 * (classes[number + 1] - 1) < percent * len(grams):
            continue
        parts, spare = parts_of(number, percent)
        edges = np.arange(1, parts, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // parts)
        cut = np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])
        keys = mixed((sums[cut[1:]] - sums[cut[:-1]]) ^ mixed(np.arange(parts, dtype=np.uint64) + np.uint64(number << 40)))
        empty = cut[1:] == cut[:-1]
        out.append(keys if empty.sum() > spare else keys[~empty])
    return np.concatenate(out)


def linked(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


class PrefixTree:
    """A radix tree of sets as ascending ranks. Nodes are in depth-first order; `after` is the next one outside a subtree."""

    def __init__(self, ranks: list[np.ndarray]):
        order = sorted(range(len(ranks)), key=lambda i: ranks[i].astype(">i4").tobytes())
        self.begin: list[int] = []   # depth at which a node's own grams begin
        self.grams: list[np.ndarray] = []
        self.after: list[int] = []
        self.parent: list[int] = []
        self.least: list[int] = []   # smallest and largest set below
        self.most: list[int] = []
        self.leaves: list[list[int]] = []  # sets that end at the node
        self.below: list[list[int]] = []   # all sets below, by their places in `order`
        self.order = order
        self._build([ranks[i] for i in order])

    def _node(self, grams: np.ndarray, begin: int, parent: int, first: int, last: int, sizes: list[int]) -> int:
        self.begin.append(begin)
        self.grams.append(grams)
        self.after.append(0)
        self.parent.append(parent)
        self.least.append(min(sizes[first:last]))
        self.most.append(max(sizes[first:last]))
        self.leaves.append([])
        self.below.append([first, last])
        return len(self.begin) - 1

    def _build(self, sets: list[np.ndarray]) -> None:
        sizes = [len(s) for s in sets]
        shared = [0] * (len(sets) + 1)  # common beginning with the set before
        for i in range(1, len(sets)):
            n = min(sizes[i - 1], sizes[i])
            differ = np.flatnonzero(sets[i - 1][:n] != sets[i][:n])
            shared[i] = int(differ[0]) if len(differ) else n
        stack = [(0, len(sets), 0, -1)]
        while stack:
            first, last, depth, parent = stack.pop()
            if first < 0:  # all below the node are done
                self.after[parent] = len(self.begin)
                continue
            upto = min(shared[first + 1:last], default=sizes[first])
            node = self._node(sets[first][depth:upto], depth, parent, first, last, sizes)
            stack.append((-1, 0, 0, node))
            while first < last and sizes[first] == upto:
                self.leaves[node].append(self.order[first])
                first += 1
            cuts = [first, *[i for i in range(first + 1, last) if shared[i] == upto], last] if first < last else []
            stack += [(a, b, upto, node) for a, b in zip(cuts, cuts[1:])][::-1]


def tree_links(sets: list[np.ndarray], labels: list[int], walkers: list[int], percent: int = PERCENT) -> tuple[list[tuple[int, int]], int]:
    """Pairs of places in `sets` that link, enough to join all that the walkers' links join, and the nodes visited.

    Sets that share a label are joined already. The walkers go down the tree together, as many as a table of the grams
    they hold allows, so a visit to a node is one step for all that are still on the way.
    """
    _, back, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    sizes = np.array([len(s) for s in sets], np.int64)
    ranks = [np.sort(r) for r in np.split(rank[back], np.cumsum(sizes)[:-1])]
    tree, out, visited = PrefixTree(ranks), [], 0
    root = np.unique(np.array(labels), return_inverse=True)[1]
    order = np.array(tree.order)
    # The grams up to the last one of any node, for the bound on what is left of a walker.
    lasts = np.unique([g[-1] + 1 for g in tree.grams if len(g)])
    row = {int(x): i for i, x in enumerate(lasts)}
    step = max(TABLE // (len(counts) + 4 * len(lasts) + 1), 1)
    for begin in range(0, len(walkers), step):
        if (root == root[0]).all():
            break
        group = np.array(walkers[begin:begin + step])
        size = sizes[group]
        has = np.zeros((len(counts), len(group)), np.uint8)
        for i, w in enumerate(group):
            has[ranks[w], i] = 1
        upto = np.cumsum(np.add.reduceat(has, np.concatenate([[0], lasts[:-1]]), axis=0, dtype=np.int32), axis=0)
        path: list[tuple[int, np.ndarray, np.ndarray]] = []  # nodes above, the walkers that went on there and their overlaps
        node = 0
        while node < len(tree.begin):
            while path and path[-1][0] != tree.parent[node]:
                path.pop()
            at, common = path[-1][1:] if path else (np.arange(len(group)), np.zeros(len(group), np.int64))
            first, last = tree.below[node]
            inside = root[order[first:last]]
            if (inside == inside[0]).all():  # those joined to all sets below need not go there
                apart = root[group[at]] != inside[0]
                at, common = at[apart], common[apart]
            if not len(at):
                node = tree.after[node]
                continue
            visited += 1
            grams = tree.grams[node]
            left = size[at]
            if len(grams):
                common = common + has[grams][:, at].sum(axis=0, dtype=np.int64)
                left = left - upto[row[int(grams[-1]) + 1], at]
            best = common + np.minimum(tree.most[node] - tree.begin[node] - len(grams), left)
            able = 100 * best >= percent * (size[at] + np.maximum(tree.least[node], best) - best)
            at, common = at[able], common[able]
            for leaf in tree.leaves[node]:
                for i in np.flatnonzero((root[group[at]] != root[leaf]) & linked(common, size[at], sizes[leaf], percent)):
                    w = group[at[i]]
                    if root[w] != root[leaf]:
                        root[root == root[w]] = root[leaf]
                        out.append((int(w), leaf))
            if len(at):
                path.append((node, at, common))
                node += 1
            else:
                node = tree.after[node]
    return out, visited


def _walked(groups: DataFrame, by: list[str], percent: int) -> DataFrame:
    """a, b of the links in each tree: rows (hub, s, label, walks, grams) of one `by` and one hub are in one tree."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        pdf = pdf.sort_values(["hub", "walks", "s"], ascending=[True, False, True])
        hubs, s, labels, walks = (pdf[c].to_numpy() for c in ("hub", "s", "label", "walks"))
        grams = pdf["grams"].tolist()
        edges = np.flatnonzero(np.diff(hubs, prepend=hubs[:1] - 1, append=hubs[-1:] + 1))
        for first, last in zip(edges.tolist(), edges[1:].tolist()):
            # a walker stands in the tree of its own part as well, once is enough
            at = first + np.sort(np.unique(s[first:last], return_index=True)[1])
            pairs, _ = tree_links([np.frombuffer(grams[i], np.uint64) for i in at], labels[at].tolist(), np.flatnonzero(walks[at]).tolist(), percent)
            a += [s[at[p[0]]] for p in pairs]
            b += [s[at[p[1]]] for p in pairs]
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return groups.groupBy(*by).applyInPandas(walk, "a long, b long")


def facts_of(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """id, n (grams), s (hash of the set, null if it is empty), t (hash of the text) and keys of every row."""

    @F.pandas_udf("n long, s long, keys array<long>")
    def look(texts: pd.Series) -> pd.DataFrame:
        n, s, keys = [], [], []
        for text in texts:
            grams = gram_set(text, size)
            n.append(len(grams))
            whole = mixed(np.array([mixed(grams).sum(dtype=np.uint64) + np.uint64(len(grams))]))
            s.append(int(whole.view(np.int64)[0]))
            keys.append(part_keys(grams, percent).view(np.int64))
        return pd.DataFrame({"n": n, "s": s, "keys": keys})

    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = bounded_batches(docs).select(col(id_col).alias("id"), text.alias("text")).withColumn("r", look("text"))
    return rows.select("id", "r.n", F.when(F.col("r.n") > 0, F.col("r.s")).alias("s"), F.xxhash64("text").alias("t"), "r.keys")


def bit_map(wanted: DataFrame) -> np.ndarray:
    """A bit for each range of hashes, set where `wanted` has a `t`: 8 to 16 bits a row, fewer where that passes BROADCAST_BYTES."""
    bits = min(8 * max(wanted.count(), 1) - 1, 4 * BROADCAST_BYTES).bit_length()
    if not BROADCAST_BYTES:
        return np.zeros(0, np.uint8)
    high = max(bits - PART_BITS, 0)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(1 << (bits - high), bool)
        at = pdf["t"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        found[(at & np.uint64(len(found) - 1)).astype(np.int64)] = True
        return pd.DataFrame({"part": [int(at[0] >> np.uint64(bits - high))], "bits": [np.packbits(found).tobytes()]})

    part = F.shiftrightunsigned("t", 64 - high) if high else F.lit(0).cast("long")
    parts = wanted.groupBy(part.alias("of")).applyInPandas(lambda pdf: pack(pdf), "part long, bits binary").collect()
    out = np.zeros((1 << high, max(1 << (bits - high), 8) // 8), np.uint8)
    for r in parts:  # the map itself
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def in_map(spark: SparkSession, name: str, bits: np.ndarray) -> Column:
    """Whether the hash in a column of this name can be wanted; always true without a map."""
    if not len(bits):
        return F.lit(True)
    shared = spark.sparkContext.broadcast(bits)
    shift = np.uint64(64 - (8 * len(bits)).bit_length() + 1)

    @F.pandas_udf("boolean")
    def look(t: pd.Series) -> pd.Series:
        at = (t.to_numpy().view(np.uint64) >> shift).astype(np.int64)
        return pd.Series(shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1)

    return look(name)


def sets_of(docs: DataFrame, wanted: DataFrame, text_col: str, size: int) -> DataFrame:
    """s, n and grams (binary) of the sets in `wanted` (s, t: hash of one text that has the set)."""

    @F.pandas_udf("binary")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([gram_set(t, size).tobytes() for t in texts], dtype=object)

    texts = docs.select(col(text_col).cast("string").alias("text")).filter("text is not null").withColumn("t", F.xxhash64("text"))
    # The map keeps most other texts from the shuffle. Copies become one in each task, so none of them fills a partition.
    one_each = texts.filter(in_map(docs.sparkSession, "t", bit_map(wanted))).groupBy("t").agg(F.first("text").alias("text"))
    chosen = shuffled_join(one_each, wanted, "t").select("s", "text")
    return bounded_batches(chosen).select("s", grams("text").alias("grams")).withColumn("n", (F.octet_length("grams") / 8).cast("long"))


def links(docs: DataFrame, facts: DataFrame, text_col: str, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """a, b for sets: links that join exactly those that chains of links join."""
    keyed = facts.filter("s is not null").select("s", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = settle(shuffled_join(keyed, shared, "key", "left_semi").distinct(), "members")
    hubs = members.groupBy("key").agg(F.min("s").alias("hub"), F.max("s").alias("other")).filter("hub != other")
    pairs = settle(shuffled_join(members, hubs.select("key", "hub"), "key").select("s", "hub").distinct(), "pairs")
    release(members)
    wanted = shuffled_join(facts.filter("s is not null"), pairs.select("s").distinct(), "s", "left_semi")
    wanted = settle(wanted.groupBy("s").agg(F.min("t").alias("t")), "wanted")
    sets = settle(sets_of(docs, wanted, text_col, size), "sets")
    release(wanted)
    sizes = pairs.join(sets.select("s", "n"), "s").groupBy("hub").agg(F.sum("n").alias("total"))
    # Trees of about GRAMS grams each; members are dealt by their hash, and the hub is in each tree.
    trees = settle(sizes.select("hub", F.ceil(F.col("total") / GRAMS).cast("long").alias("trees")).filter("trees >= 1"), "trees")
    dealt = shuffled_join(pairs, trees, "hub").filter("s != hub").select("hub", "s", F.pmod(F.xxhash64("s"), "trees").alias("tree"), "trees")
    dealt = dealt.unionByName(trees.select("hub", F.col("hub").alias("s"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), "trees"))
    # A tree of one group is walked by all; in a group of several trees the hub and the tree's own members walk.
    first = shuffled_join(dealt, sets, "s").withColumns({"label": F.col("s"), "walks": F.lit(True)})
    # Small groups go to a task together, about GRAMS grams at a time.
    bins = (sizes.agg(F.sum("total")).first()[0] or 0) // GRAMS + 1
    first = first.withColumn("lot", F.when(F.col("trees") > 1, F.xxhash64("hub", "tree")).otherwise(F.pmod(F.xxhash64("hub"), F.lit(bins))))
    found = settle(_walked(first.select("lot", "hub", "tree", "s", "label", "walks", "grams"), ["lot", "tree"], percent), "links")

    large = pairs.join(trees.filter("trees > 1"), "hub")
    if not large.limit(1).count():
        return found
    roots = settle(components(found), "roots")
    labelled = shuffled_join(large, roots.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("label", F.coalesce("root", "s"))
    labelled = settle(labelled.join(sets.select("s", "n"), "s").select("hub", "s", "label", "n"), "labelled")
    by_label = labelled.groupBy("hub", "label").agg(F.sum("n").alias("w"))
    main = by_label.groupBy("hub").agg(F.max(F.struct("w", "label")).alias("m"), F.sum("w").alias("w"), F.count("*").alias("labels"))
    main = main.filter("labels > 1").select("hub", F.col("m.label").alias("main"), F.ceil(F.col("w") / GRAMS).cast("long").alias("trees"),
                                            F.ceil((F.col("w") - F.col("m.w")) / GRAMS).cast("long").alias("walks"))
    open_ = settle(labelled.join(main, "hub"), "open")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    in_tree = open_.select("hub", "s", "label", F.lit(False).alias("walks"), F.pmod(F.xxhash64("s"), "trees").alias("tree"), each("walks").alias("walk"))
    walking = open_.filter("label != main").select("hub", "s", "label", F.lit(True).alias("walks"), each("trees").alias("tree"),
                                                    F.pmod(F.xxhash64("s"), "walks").alias("walk"))
    second = shuffled_join(in_tree.unionByName(walking), sets, "s")
    more = _walked(second.select("hub", "tree", "walk", "s", "label", "walks", "grams"), ["hub", "tree", "walk"], percent)
    inside = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return settle(inside.unionByName(more), "links")


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
                   percent: int = PERCENT) -> DataFrame:
    """id, n_shingles and component_id (the smallest id that is reachable, itself included) of every row."""
    facts = settle(facts_of(docs, id_col, text_col, size, percent), "facts")
    rows = facts.select("id", "n", F.col("s").alias("node"))
    found = least_ids(rows, links(docs, facts, text_col, size, percent))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
