"""N-gram Jaccard self-join by parity sketches.

A document is the set of its word shingles. Documents of like size share a size band; in a band,
two sets at the wanted similarity differ in D shingles at most. Their shingles are dealt by hash to
D + 1 + s parts, and the XOR of the hashes in a part is its parity sketch: XOR cancels common
shingles, so each differing shingle changes at most one part, and by the pigeonhole principle at
least 1 + s sketches of a linked pair are equal. Equal (band, part, sketch) rows give the
candidates; a 2048-bit parity sketch of the whole set, whose Hamming distance is a lower bound
of the symmetric difference, drops most false ones; the rest are verified on the shingles.

No link is lost. A part may be empty in many documents, so empty parts give no row; a set with more
than s empty parts repeats with another seed, and after the last seed joins an overflow
group of its band, so a pair that all its common parts leave empty still meets.

Frequent sketches come last. A set with e empty parts shares 1 + s - e sketches with each of its
partners, so it may leave out the s - e that most sets have: what remains of both still has the
rarest one they share. In a family of texts that differ in many places the common sketches are the
frequent ones, and those that remain are shared by few.

No group is expanded into all pairs. Equal sets are one node. In each group every node is first
compared with one centre; the links make classes, and only pairs of a group whose ends lie in
different classes are looked at after that, which is exact for components. Of the pairs between two classes one is
verified first, the others only if it is no link; components are found among classes, not among all links. ``links`` gives all links of
the join, between classes of equal sets.

Defined results: NULL and empty texts have an empty set and are linked with nothing; with fewer
words than a shingle the whole sequence is one shingle; repeated rows and equal sets are linked;
component_id is the smallest id (NULL ids never are, unless a component has no other); an
empty table gives an empty table; other columns are ignored. Shingles and sets are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, release, ship_package

WORDS, PERCENT = 4, 85
SEEDS = 4
SLACK = 4              # one more part for so many that may differ
STAR_ROUNDS = 3
SKETCH_WORDS = 32     # of a set's parity sketch
FOLDED = 16            # of the same sketch folded, which goes along with candidate rows
U64 = np.uint64
_GOLD, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    import xxhash
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(w)
    if not n:
        return np.zeros(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), U64, n)
    k = min(n, words)
    out = h[:n - k + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out = out * _GOLD + h[i:n - k + 1 + i]
        return np.unique(mix(out + U64(k)))


def node_of(s: np.ndarray) -> int:
    import xxhash
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], U64).view(np.int64)[0])


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles that hash to each of 64 * SKETCH_WORDS bits, as signed words."""
    bits = np.bincount((s >> U64(20)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


class Bands:
    """Size bands and, for each, the number of parts and the slack that is allowed for empty ones.
    Band i holds sizes from low[i]; a set's partners lie in its own band and the ones beside it, so
    a set is filed under its own band and the next."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.low = percent, [1]

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        return bisect_right(self.low, size) - 1

    def parts(self, band: int) -> tuple[int, int]:
        while len(self.low) <= band + 1:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        most = 2 * (self.low[band + 1] - 1) * (100 - self.percent) // (100 + self.percent)
        slack = most // SLACK + (most > 0)
        return most + 1 + slack, slack


def keyed_parts(s: np.ndarray, bands: Bands, seeds: int = SEEDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the (band, seed, part, parity sketch) rows of a set, and with each how many of its
    family's may be left out. The last four bits of a hash tell the families of a set apart."""
    out, spare = [], []
    own = bands.of(len(s))
    with np.errstate(over="ignore"):
        for band in (own, own + 1):
            k, slack = bands.parts(band)
            family = (band & 1) << 3
            for seed in range(seeds):
                place = U64((band << 8) + seed + 1) * _GOLD
                part = ((mix(s ^ place) >> U64(32)) * U64(k) >> U64(32)).astype(np.int64)
                xor = np.zeros(k, U64)
                np.bitwise_xor.at(xor, part, s)
                full = np.flatnonzero(np.bincount(part, minlength=k))
                out.append(_told(mix(mix(xor[full] + place) ^ (U64(1) + full.astype(U64)) * _M1), family | seed))
                spare.append(np.full(len(full), max(0, slack - k + len(full))))
                if k - len(full) <= slack:
                    break
            else:
                out.append(_told(mix(np.array([(band << 8) + 255], U64) * _M2), family | 7))
                spare.append(np.zeros(1, np.int64))
    return np.concatenate(out), np.concatenate(spare)


def _told(keys: np.ndarray, family: int) -> np.ndarray:
    return keys & ~U64(15) | U64(family)


def part_keys(s: np.ndarray, bands: Bands, seeds: int = SEEDS) -> np.ndarray:
    return keyed_parts(s, bands, seeds)[0]


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` without the text, with n_shingles and node, which is NULL for an empty set."""
    kept = [c for c in docs.columns if c != "text"]

    def run(frames):
        import pandas as pd
        for frame in frames:
            found = [(len(s), node_of(s) if len(s) else None) for s in (shingles(t, words) for t in frame["text"])]
            yield frame[kept].assign(n_shingles=[x[0] for x in found], node=pd.array([x[1] for x in found], dtype="Int64"))

    types = dict(docs.dtypes)
    return docs.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in kept) + ", n_shingles long, node long")


def part_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, node, spare) rows of all sets; equal sets of a batch are taken once."""
    def run(batches):
        import pyarrow as pa
        bands = Bands(percent)

        def rows(keys, nodes, spare):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)),
                                               pa.array(np.concatenate(spare).astype(np.int16))], ["key", "node", "spare"])

        for batch in batches:
            keys, nodes, spare, seen, held = [], [], [], set(), 0
            for t in batch.column("text"):
                s = shingles(t.as_py(), words)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                k, left_out = keyed_parts(s, bands)
                keys.append(k), nodes.append(np.full(len(k), node)), spare.append(np.minimum(left_out, 32_000))
                held += len(k)
                if held > 1 << 19:
                    yield rows(keys, nodes, spare)
                    keys, nodes, spare, held = [], [], [], 0
            if held:
                yield rows(keys, nodes, spare)

    return docs.select("text").mapInArrow(run, "key long, node long, spare short")


def groups_of(rows: DataFrame) -> DataFrame:
    """The rows (key, node, others) of the keys that two nodes or more share, a node once. They come sorted by key
    and node and are streamed, whatever a key's size; the state is one row."""
    names = rows.columns

    def run(batches):
        import pyarrow as pa
        last, written = None, False          # the last row, and whether it went out
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.concat_batches([last, batch])
            key, node = (batch.column(names.index(c)).to_numpy() for c in ("key", "node"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            at = np.flatnonzero(new)
            same = key[at][1:] == key[at][:-1]
            shared = np.zeros(len(at), bool)
            shared[1:] = same
            shared[:-1] |= same
            first = last is None or not written
            last, written = batch.slice(at[-1], 1), bool(shared[-1]) or (written and len(at) == 1)
            shared[0] &= first
            if shared.any():
                yield batch.take(pa.array(at[shared]))

    return (rows.repartition("key").sortWithinPartitions("key", "node")
            .mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)))


def rarest(groups: DataFrame) -> DataFrame:
    """(key, node) of ``groups(key, node, spare)`` without the most frequent keys that each set may leave out, and
    of those the keys that two nodes still share."""
    size = groups.groupBy("key").agg(F.count("*").alias("size"))
    family = Window.partitionBy("node", F.col("key").bitwiseAND(15)).orderBy(F.col("size").desc(), "key")
    left = materialize(groups.join(size, "key").withColumn("rank", F.row_number().over(family))
                       .filter("rank > spare").select("key", "node"), "parity-rarest")
    shared = left.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return left.join(shared.select("key"), "key", "left_semi")


def node_sets(docs: DataFrame, nodes: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(node, n, p0.., sketch, shingles) of the given nodes, from one document of each."""
    chosen = sets.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("id"))
    texts = docs.join(chosen.select(F.col("id").alias("__id")).distinct(), F.col("doc_id").eqNullSafe(F.col("__id")),
                      "left_semi")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            found, held = [], 0
            for t in batch.column("text"):
                s = shingles(t.as_py(), words)
                if len(s):
                    found.append(s)
                    held += len(s)
                if held > 1 << 20:
                    yield _packed(pa, found)
                    found, held = [], 0
            if found:
                yield _packed(pa, found)

    rows = texts.select("text").mapInArrow(
        run, "node long, n long, " + "".join(f"p{i} long, " for i in range(FOLDED)) + "sketch array<long>, shingles binary")
    one = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in rows.columns if c != "node"])
    return one.join(nodes, "node", "left_semi")


def _packed(pa, found):
    marks = np.stack([parity_sketch(x) for x in found])
    folded = np.bitwise_xor.reduce(marks.reshape(len(found), -1, FOLDED), axis=1)     # parity of parities
    return pa.RecordBatch.from_arrays(
        [pa.array([node_of(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()),
         *[pa.array(folded[:, i]) for i in range(FOLDED)], pa.array(list(marks), pa.list_(pa.int64())),
         pa.array([x.tobytes() for x in found], pa.binary())],
        ["node", "n", *[f"p{i}" for i in range(FOLDED)], "sketch", "shingles"])


def _may_link(percent: int, folded: bool):
    """The bounds that sizes and parity sketches set: the sets differ in hamming shingles at least."""
    if folded:
        hamming = sum((F.bit_count(F.col(f"a.p{i}").bitwiseXOR(F.col(f"b.p{i}"))) for i in range(FOLDED)), F.lit(0))
    else:
        differing = F.zip_with("a.sketch", "b.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        hamming = F.aggregate(differing, F.lit(0), lambda total, x: total + x)
    least, most = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    return (least * 100 >= most * percent) & (hamming * (100 + percent) <= (least + most) * (100 - percent))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets reach the similarity."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    s = sets.select("node", "shingles")
    left = pairs.join(s.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a")
    both = left.join(s.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of ``links(a, b)``. Each round takes
    the smallest label around a node, then the label of that label, and is written to the
    shared folder; it ends when no label changes."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                       "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")),
                         "labels")
    while True:
        around = (both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node"))
                  .agg(F.min("label").alias("near")))
        step = labels.join(around, "node").select("node", F.col("label").alias("was"),
                                                  F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = materialize(step.join(jump, "label", "left").select(
            "node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = step.select("node", "label")
        if step.filter("label <> was").isEmpty():
            return labels


def _candidates(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The groups (key, node) in which every linked pair meets, and the sets of their nodes."""
    spark = docs.sparkSession
    groups = materialize(groups_of(part_rows(docs, words, percent)), "parity-shared")
    release(spark)
    groups = materialize(rarest(groups), "parity-groups")
    known = materialize(node_sets(docs, groups.select("node").distinct(), sets, words), "parity-sets")
    release(spark)
    return groups, known


def _met(open_: DataFrame, which, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that share a group, fulfil ``which`` and may be linked."""
    a, b = open_.alias("a"), open_.alias("b")
    return (a.join(b, (F.col("a.key") == F.col("b.key")) & which & _may_link(percent, folded=True))
            .select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct())


def _centred(open_: DataFrame, order, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of the first node of each group in ``order`` with those of other labels that may be linked."""
    sketch = [f"p{i}" for i in range(FOLDED)]
    first = (open_.groupBy("key").agg(F.min(F.struct(order.alias("order"), "node", "label", "n", *sketch)).alias("c"))
             .select("key", "c.*"))
    a, b = open_.alias("a"), first.alias("b")
    return (a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label")) & _may_link(percent, folded=True))
            .select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct())


def _named(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, la, lb) of the ``pairs`` of nodes whose labels differ; a node without one is its own."""
    side = {s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l{s}")) for s in "ab"}
    both = pairs.join(side["a"], "a", "left").join(side["b"], "b", "left")
    return both.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")).filter("la <> lb")


def _one_each(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One of the ``pairs`` (a, b) for every two labels: a single link joins them, however many there are."""
    return (_named(pairs, labels).groupBy(F.least("la", "lb"), F.greatest("la", "lb"))
            .agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after ``links`` (a, b): their components are those of the labels, an edge for two of them."""
    edges = materialize(_named(links, labels).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
                        .distinct(), "parity-edges")
    moved = components(edges)
    alone = moved.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti")
    to = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return materialize(labels.unionByName(alone).join(to, "label", "left")
                       .select("node", F.coalesce("to", "label").alias("label")), "parity-labels")


def node_links(docs: DataFrame, sets: DataFrame, words: int, percent: int, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(node, label) of all nodes that are linked with another node."""
    spark = docs.sparkSession
    groups, known = _candidates(docs, sets, words, percent)
    light = known.drop("shingles")
    labels = spark.createDataFrame([], "node long, label long")
    tested = spark.createDataFrame([], "a long, b long")

    def judged(some, labels):
        return _merged(labels, verified(some, known, percent))

    for turn in range(star_rounds + 1):
        member = (groups.join(labels, "node", "left")
                  .select("key", "node", F.coalesce("label", "node").alias("label")))
        order = F.xxhash64("node", F.lit(turn)) if turn else F.xxhash64("node")
        mixed = (member.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                           F.min(F.struct(order, "node", "label")).alias("c"))
                 .filter("lo <> hi").select("key", F.col("c.node").alias("centre"), F.col("c.label").alias("other")))
        open_ = member.join(mixed, "key")
        if turn:
            # labels only merge, so a group of one label stays one and is not looked at again
            open_ = materialize(open_, "parity-open")
            groups = open_.select("key", "node")
        if turn < star_rounds - 1:
            # one centre a group, in an order that is the same everywhere, and of a node's centres only the one it
            # shares most groups with: this settles clear groups
            star = open_.filter("label <> other").groupBy("node", "centre").agg(F.count("*").alias("n"))
            star = star.groupBy("node").agg(F.max_by("centre", F.struct("n", "centre")).alias("centre"))
            pairs = star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        else:
            # then another order in each group and all centres of a node: at most one pair for each row of a group,
            # and only those that the bounds allow leave it. Then all pairs that are still apart
            marked = open_.select("key", "node", "label").join(light.drop("sketch"), "node")
            pairs = (_centred(marked, F.xxhash64("node", "key", F.lit(turn)), percent) if turn < star_rounds
                     else _met(marked, F.col("a.label") < F.col("b.label"), percent))
        pairs = materialize(_bounded(pairs, light, percent).join(tested, ["a", "b"], "left_anti"), "parity-pairs")
        if pairs.isEmpty():
            continue
        some = materialize(_one_each(pairs, labels), "parity-some") if turn else pairs
        labels = judged(some, labels)
        if turn:
            rest = _named(pairs, labels).select("a", "b").join(some, ["a", "b"], "left_anti")
            rest = materialize(rest, "parity-rest")
            if not rest.isEmpty():
                labels = judged(rest, labels)
        tested = tested.unionByName(pairs)
        release(spark)
    return labels


def _bounded(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    cols = ["n", "sketch"]
    side = {s: light.select(F.col("node").alias(s), F.struct(*cols).alias(f"__{s}")) for s in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b")
    both = both.select(F.struct(F.col("a").alias("node"), "__a.*").alias("a"),
                       F.struct(F.col("b").alias("node"), "__b.*").alias("b"))
    return both.filter(_may_link(percent, folded=False)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def first_of(sets: DataFrame, labels: DataFrame, order) -> DataFrame:
    """(node, first): the smallest ``order`` of the rows of a node's component. Rows are brought down to
    nodes before anything is joined, so copies of a text cost what one of them does."""
    nodes = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min(order).alias("first"))
    linked = labels.join(nodes, "node")
    component = linked.groupBy("label").agg(F.min("first").alias("of_all"))
    linked = linked.join(component, "label").select("node", "of_all")
    return nodes.join(linked, "node", "left").select("node", F.coalesce("of_all", "first").alias("first"))


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS,
         percent: int = PERCENT) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    ship_package(docs.sparkSession)
    texts = _texts(docs, id_col, text)
    sets = materialize(sets_of(texts, words), "shingle-sets")
    first = first_of(sets, node_links(texts, sets, words, percent), F.col("doc_id"))
    return sets.join(first, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))


def links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS,
          percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links of the join: (doc_id, n_shingles, class, n_links) of every row, where equal sets are one class (NULL
    for an empty set) and n_links counts the other rows it is linked with; and the pairs (a, b), a < b, of
    different classes that reach the similarity. Copies are not expanded, but a family of n different texts that are
    all alike does have n * (n - 1) / 2 links."""
    ship_package(docs.sparkSession)
    texts = _texts(docs, id_col, text)
    sets = materialize(sets_of(texts, words), "shingle-sets")
    groups, known = _candidates(texts, sets, words, percent)
    open_ = materialize(groups.join(known.drop("shingles", "sketch"), "node"), "parity-open")
    pairs = materialize(verified(_bounded(_met(open_, F.col("a.node") < F.col("b.node"), percent), known.drop("shingles"),
                                          percent), known, percent), "parity-all-links")
    size = sets.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("size"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = (both.join(size.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node"))
              .agg(F.sum("size").alias("others")))
    counted = size.join(others, "node", "left").select(
        "node", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    members = sets.join(counted, "node", "left").select(
        "doc_id", "n_shingles", F.col("node").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return members, pairs


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5,
                     percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: of each component the row with the smallest id (a
    NULL id is the largest; of rows with that id one). A row is told by its id and all its columns, so
    different texts of one id are judged apart. Rows without words are linked with nothing and stay."""
    ship_package(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), name.alias("name"), F.xxhash64(whole).alias("row"),
                        F.col(text).alias("text"))
    sets = materialize(sets_of(texts, words), "shingle-sets")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "name")
    first = first_of(sets, node_links(texts.select("doc_id", "text"), sets, words, percent), order)
    stay = first.select(F.col("first.row").alias("__hash"), F.col("first.name").alias("__name")).distinct()
    rows = docs.select(F.xxhash64(whole).alias("__hash"), name.alias("__name"),
                       F.coalesce(F.col(text).rlike(WORD), F.lit(False)).alias("__words"), whole.alias("__row"))
    w = Window.partitionBy("__hash", "__name").orderBy(F.lit(0))
    once = rows.filter("__words").withColumn("__first", F.row_number().over(w)).filter("__first = 1")
    return (once.join(stay, ["__hash", "__name"]).select("__row.*")
            .unionByName(rows.filter(~F.col("__words")).select("__row.*")))


# ---- registered query (tests compare with all pairs of small tables) ---------------

def op6_parity_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
