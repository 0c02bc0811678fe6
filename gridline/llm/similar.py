"""Near-duplicates of a given similarity on word shingles.

SimHash links at 2 bits find pairs whose shingle sets are nearly equal; at a
similarity of 0.8 fingerprints differ in 10 bits of 64 on average, beyond what
any index of byte positions can guarantee. So candidates come from two
indexes, that of the fingerprints and one of min-hashes (16 bands of 4: a pair
at 0.8 shares a band with probability 0.9998). Texts that share lists form
clusters, and inside a cluster every pair is compared exactly: the shared
shingles of all pairs of a block are one product of a matrix, so that no pair
is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridline.llm.common import bounded, cut, parts, quoted, small, with_columns
from gridline.llm.graph import components
from gridline.llm.simhash import fingerprint, links, shingles

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Texts and shingles of a block. A task holds two blocks at a time.
BLOCK_TEXTS = 512
#: One text of so many blocks' share meets all blocks of its cluster at first.
EVERYWHERE = 8
BLOCK_SHINGLES = 1 << 20
#: Columns of the matrix that are multiplied at once.
COLUMNS = 1024
_ODD = np.random.default_rng(2024).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """A key (long) for each band of min-hashes of a set of 64-bit hashes."""
    least = np.full(len(_ODD), ~np.uint64(0))
    for lo in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[lo : lo + 4096, None] * _ODD[None, :]).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[i].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def text_key(data: bytes) -> tuple[int, int]:
    """128 bits of a text's words, as two longs."""
    key = xxhash.xxh3_128_digest(b" ".join(data.lower().split()))
    return int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True)


def keyed(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep, k1, k2 of every row of rows (column text)."""

    def run(batches):
        for batch in batches:
            keys = [text_key(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
            k1, k2 = zip(*keys, strict=True) if keys else ((), ())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], names=[*keep, "k1", "k2"])

    bounded(rows.sparkSession)
    return rows.mapInArrow(run, with_columns(rows, keep, "k1 long, k2 long"))


def prints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, k1, k2 (128 bits of the words), fp, n (shingles) and bands of every row."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column("text").cast(pa.binary()):
                data = data.as_py() or b""
                digests = shingles(data, words)
                rows.append((*text_key(data), fingerprint(digests), len(digests) // 8, bands(np.frombuffer(digests, ">u8").astype(np.uint64))))
            k1, k2, fp, n, keys = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [*[pa.array(x, pa.int64()) for x in (k1, k2, fp, n)], pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "k1", "k2", "fp", "n", "bands"])

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, with_columns(docs, ("doc_id",), "k1 long, k2 long, fp long, n long, bands array<long>"))


def lists(classes: DataFrame) -> DataFrame:
    """key, node, n, size, hub: the lists of two nodes or more, of classes(node, fp, n, bands).

    A list holds the nodes of one value of a band, or of one fingerprint, or of
    two that a SimHash link joins. hub is its least node, size its nodes.
    """
    same = classes.select("fp", "node", "n")
    linked = cut(links(same.select("fp").distinct())).select(F.xxhash64(F.lit("link"), "a", "b").alias("key"), F.explode(F.array("a", "b")).alias("fp"))
    posted = classes.select(F.explode("bands").alias("key"), "node", "n")
    posted = posted.unionByName(same.select(F.xxhash64(F.lit("fp"), "fp").alias("key"), "node", "n"))
    posted = posted.unionByName(same.join(linked, "fp").select("key", "node", "n"))
    several = posted.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub"), F.sum("n").alias("weight")).where("size > 1")
    return cut(posted.join(small(cut(several)), "key"))


def blocks_of(texts: Column, shingles: Column) -> Column:
    """Blocks that hold so many texts and shingles."""
    return F.greatest(F.ceil(texts / BLOCK_TEXTS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def first_places(met: DataFrame, clusters: DataFrame) -> DataFrame:
    """node, places array<long>, large: where the nodes of a cluster meet first.

    A cluster of one block is one place, and all its pairs meet there. A larger
    one is cut into blocks by a hash; a share of its nodes, an eighth of a
    block in all, goes to every block, so that families of many texts become
    one component with 1.125 copies of a node on average.
    """
    weights = met.select("node", "n").distinct().join(clusters, "node")
    stats = weights.groupBy("root").agg(blocks_of(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    placed = weights.join(small(cut(stats)), "root")
    number = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), n.cast("long")).cast("int")
    everywhere = number("everywhere", F.col("blocks") * EVERYWHERE) == 0
    numbers = F.when(everywhere, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(number("block", F.col("blocks"))))
    return placed.select("node", F.transform(numbers, lambda b: F.xxhash64("root", b)).alias("places"), (F.col("blocks") > 1).alias("large"))


def gathered(links: DataFrame) -> DataFrame:
    """node, root: nodes that links(a, b) connect, by way of each a and once more by way of shared nodes.

    Never joins what isn't connected, and joins what shares the nodes that go
    to every block. What it leaves apart is compared once more than needed.
    """
    stars = links.select(F.col("a").alias("star"), F.col("b").alias("node")).unionByName(links.select(F.col("a").alias("star"), F.col("a").alias("node")))
    low = stars.groupBy("node").agg(F.min("star").alias("low"))
    top = stars.join(low, "node").groupBy("star").agg(F.min("low").alias("top"))
    return stars.join(top, "star").groupBy("node").agg(F.min("top").alias("root"))


def meetings(met: DataFrame, clusters: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """node, places array<long>: where nodes meet so that all pairs of a list do that aren't one component yet.

    met are lists(), clusters(node, root) their components, roots(node, root)
    the components known so far (others are their own). The nodes outside a
    group's largest component are strays; a group without strays is done. Each
    block of strays meets each block of the group, or, if that's cheaper, each
    two blocks of the group meet. A group is a cluster, or each of its lists,
    whichever makes fewer copies of nodes. So a place is never more than about
    two blocks, however large a cluster or list is.
    """
    known = clusters.select("node", F.col("node").alias("now")) if roots is None else clusters.join(roots.select("node", F.col("root").alias("now")), "node", "left").select("node", F.coalesce("now", "node").alias("now"))
    by_list = met.select("key", "node", "n").join(clusters, "node").join(known, "node")
    whole = by_list.select(F.col("root").alias("key"), "node", "n", "root", "now").distinct()
    groups = cut(by_list.withColumn("lists", F.lit(True)).unionByName(whole.withColumn("lists", F.lit(False))))
    group = ["root", "lists", "key"]
    parts = groups.groupBy(*group, "now").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    total = parts.groupBy(*group).agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.max(F.struct("m", "n", "now")).alias("most"))
    blocks, strays = blocks_of(F.col("m"), F.col("n")), blocks_of(F.col("m") - F.col("most.m"), F.col("n") - F.col("most.n"))
    sized = total.where("m > most.m").select(*group, F.col("m"), F.col("most.now").alias("most"), (F.col("m") - F.col("most.m")).alias("s"), blocks.alias("blocks"), strays.alias("rows"))
    both, grid = F.col("m") * F.greatest(F.col("blocks") - 1, F.lit(1)), F.col("m") * F.col("rows") + F.col("s") * F.col("blocks")
    sized = sized.withColumn("copies", F.least(both, grid)).withColumn("rows", F.when(grid < both, F.col("rows")).otherwise(0)).drop("m", "s")
    cost = lambda lists: F.sum(F.when(F.col("lists") == lists, F.col("copies")))
    chosen = sized.groupBy(F.col("root").alias("_root")).agg((cost(True) < cost(False)).alias("_lists"))
    sized = small(cut(sized.join(chosen, (F.col("root") == F.col("_root")) & (F.col("lists") == F.col("_lists"))).drop("_root", "_lists")))
    number = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.greatest(n, F.lit(1)).cast("long")).cast("int")
    placed = groups.join(sized, group).withColumn("own", number("block", F.col("blocks"))).withColumn("row", number("stray", F.col("rows")))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own"))
    pairs = F.transform(others, lambda b: F.xxhash64(F.lit("pair"), *group, F.least("own", b), F.greatest("own", b)))
    pairs = F.when(F.col("blocks") == 1, F.array(F.xxhash64(F.lit("pair"), *group))).otherwise(pairs)
    cell = lambda i, j: F.xxhash64(F.lit("grid"), *group, i, j)
    down = F.transform(F.sequence(F.lit(0), F.greatest(F.col("rows") - 1, F.lit(0))), lambda i: cell(i, F.col("own")))
    across = F.when(F.col("now") != F.col("most"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: cell(F.col("row"), j))).otherwise(F.array().cast("array<bigint>"))
    places = F.when(F.col("rows") == 0, pairs).otherwise(F.concat(down, across))
    return placed.select("node", places.alias("places")).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def reached(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set the number of the first that it reaches by pairs of Jaccard similarity least or more.

    sets hold distinct 64-bit hashes. Hashes of one set alone can't be shared
    and are left out; the others are columns of a matrix of sets, and its
    product with itself counts the shared ones of all pairs.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1 if len(values) else np.empty(0, bool)
    inside = shared[column] if len(values) else shared
    column, owner = (np.cumsum(shared) - 1)[column[inside]] if len(values) else column, owner[inside]
    common = np.zeros((n, n), np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        matrix = np.zeros((n, COLUMNS), common.dtype)
        matrix[owner[a:b], column[a:b] - lo] = 1
        common += matrix @ matrix.T
    either = sizes[:, None] + sizes[None, :] - common.astype(np.float64)
    near = np.divide(common, either, out=np.zeros(either.shape), where=either > 0) >= least
    label = np.arange(n)
    near[label, label] = True
    while True:
        least_of = np.where(near, label[None, :], n).min(axis=1)
        if (least_of == label).all():
            return label
        label = least_of


def compared(sets: DataFrame, least: float) -> DataFrame:
    """a, b: links that connect the similar sets of each place; sets(place, node, set) with packed hashes.

    Rows are dealt and sorted by place; a task reads its places from the
    sorted stream and holds one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        place, held = None, {}

        def found() -> pa.RecordBatch:
            nodes = sorted(held)
            first = reached([np.frombuffer(held[x], np.uint64) for x in nodes], least)
            linked = [(nodes[f], x) for f, x in zip(first.tolist(), nodes, strict=True) if nodes[f] != x]
            a, b = zip(*linked, strict=True) if linked else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for at, node, data in zip(batch.column("place").to_pylist(), batch.column("node").to_pylist(), batch.column("set"), strict=True):
                if at != place and held:
                    yield found()
                    held = {}
                place = at
                held[node] = data.as_py()
        if held:
            yield found()

    bounded(sets.sparkSession)
    dealt = sets.select("place", "node", "set").repartition(F.col("place")).sortWithinPartitions("place")
    return dealt.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, k1, k2, set: all 64-bit shingle hashes of every row, ascending."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                texts = [t.as_py() or b"" for t in part.column("text").cast(pa.binary())]
                sets = [np.unique(np.frombuffer(shingles(t, words), ">u8").astype(np.uint64)).tobytes() for t in texts]
                k1, k2 = zip(*map(text_key, texts), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "k1", "k2", "set"])

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, with_columns(docs, ("doc_id",), "k1 long, k2 long, set binary"))


def similar_classes(docs: DataFrame, classes: DataFrame, words: int, least: float) -> DataFrame:
    """a, b: links that connect all classes(k1, k2, doc_id, node, fp, n, bands) of similarity least or more that share a list.

    Texts of classes that share a list are read again for their whole shingle
    sets; others are never compared. Clusters of one block are compared whole.
    Larger ones are linked inside blocks first, and then only texts that
    aren't in one component yet meet, all of them that share a list.
    """
    met = lists(classes)
    clusters = cut(components(met.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))))

    def linked(placed: DataFrame) -> DataFrame:
        wanted = small(cut(classes.select("doc_id", "k1", "k2", "node").join(small(placed.select("node")), "node", "left_semi")))
        again = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        sets = full_sets(again, words).join(wanted, ["doc_id", "k1", "k2"]).groupBy("node").agg(F.first("set").alias("set"))
        return compared(sets.join(placed, "node").select(F.explode("places").alias("place"), "node", "set"), least)

    first = cut(first_places(met, clusters))
    links = cut(linked(first.drop("large")))
    large = first.where("large").select("node")
    if large.isEmpty():
        return links
    large = small(large)
    within = links.join(large, links["a"] == large["node"], "left_semi")
    inside = met.join(large, "node", "left_semi")
    last = cut(meetings(inside, clusters.join(large, "node", "left_semi"), gathered(within)))
    return links if last.isEmpty() else links.unionByName(linked(last))


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id, k1, k2, first of every row with a doc_id.

    component_id is the least doc_id that the row's text reaches, k1 and k2 are
    the key of the text's words, and first says whether the row is the first of
    its component: of its least doc_id and, of several texts of that, of the
    least key. Texts of the same words are one class; classes are linked where
    the Jaccard similarity of their shingle sets is at least least. An id that
    stands with different texts doesn't link them. All pairs that share a list
    of either index (a band, a fingerprint, a SimHash link) are compared with
    their whole sets, so no link between such texts is lost, however large
    their group is. Empty and null texts are one class. Rows with a null doc_id
    take no part and are left out. Other columns are ignored; an empty table
    gives an empty one.
    """
    printed = cut(prints(docs.where(F.col("doc_id").isNotNull()), words))
    classes = printed.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("fp", "n", "bands")])
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    roots = components(cut(similar_classes(docs, classes, words, least)))
    rooted = cut(classes.join(roots, "node", "left").select("k1", "k2", "doc_id", F.coalesce("root", "node").alias("root")))
    best = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("best"))
    told = rooted.join(best, "root").select("k1", "k2", F.col("best.doc_id").alias("component_id"), ((F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))).alias("_best"))
    found = printed.select("doc_id", "k1", "k2").join(told, ["k1", "k2"])
    return found.select("doc_id", "component_id", "k1", "k2", (F.col("_best") & (F.col("doc_id") == F.col("component_id"))).alias("first"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows that aren't the first of their component.

    found is near_duplicates(docs). Rows are judged by their own text: of an id
    that stands with different texts, only the texts that are copies go. Of
    rows with one id and the same words that of the least text stays, and of
    equal texts the first that is read. Only dropped and repeated ids are
    joined to the texts: as a broadcast where they were counted to be few, else
    as an equi-join. Null texts are one class, so one of them stays; rows with
    a null doc_id all stay. Other columns pass through, whatever their names
    and types.
    """
    columns = [quoted(c) for c in docs.columns]
    ids = cut(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("first").alias("stays")).where("rows > 1 OR NOT stays"))
    once = docs.join(small(cut(ids.select("doc_id"))), "doc_id", "left_anti").select(*columns)
    repeated = cut(ids.where("stays").select("doc_id"))
    if repeated.isEmpty():
        return once
    several = docs.select("doc_id", "text", F.struct(*columns).alias("_row")).join(small(repeated), "doc_id", "left_semi")
    several = cut(several.withColumn("_at", F.monotonically_increasing_id()))  # kept, so that numbers stay
    firsts = found.where("first").join(small(repeated), "doc_id", "left_semi").select("doc_id", "k1", "k2").distinct()
    copies = keyed(several.select("doc_id", "text", "_at"), ("doc_id", "text", "_at")).join(firsts, ["doc_id", "k1", "k2"])
    kept = copies.groupBy("doc_id", "k1", "k2").agg(F.min(F.struct("text", "_at")).alias("_best")).select(F.col("_best._at").alias("_at"))
    return once.unionByName(several.join(small(cut(kept)), "_at", "left_semi").select("_row.*"))
