"""N-gram Jaccard join by chosen paths.

Documents are sets of word 5-grams (a shorter text is one n-gram); two are linked if their
sets' Jaccard similarity reaches the threshold.

1. Equal texts (same words in the same order) are one class; its smallest doc_id stands
   for it from here on.
2. A set is embedded as ``EMBEDDING`` min-hash values, which agree on a share of places
   that estimates the similarity.
3. Chosen paths: in each run, a value of the embedding takes the set down a path if the
   hash of (path, place, value) falls below a fixed share, so that similar sets go down
   the same paths.  Buckets of two to ``BUCKET`` sets are compared by brute force (on
   their embeddings); a larger one is split again on a further value, or, where most of
   its sets would go down one path together, taken as near one another as it is.  Runs
   repeat until a pair at the threshold is met with probability ``recall``.
4. Sets that a bucket finds near (estimate above the threshold less ``MARGIN``) are joined
   to cells: the connected components, of which true links never leave one.
5. Cells of more than ``CELL`` sets mostly hang together by buckets taken as they are (texts
   with a common line).  They are taken apart: sets meet again where ``TOGETHER`` values of
   the embedding agree at once, which sets with only a line in common hardly do.
6. Each cell compares its members' whole n-gram sets exactly, in blocks.

Nothing emits pairs: buckets and cells give one row per member (the member, its number of
links, the smallest member that it is connected to), so a group of n near copies costs n
rows however it is found.

Defined results: a text without words (null, empty) is linked to nothing, not even to its
copies; repeated rows of one doc_id are one document with the smallest of its texts; a
null doc_id takes no part; other columns are ignored; an empty table gives no rows; texts
are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, caches, in_arrow, materialise, settled, slices, whole_text

WORDS = 5
THRESHOLD = 0.8
EMBEDDING = 128
#: Expected number of paths that a set goes down at each node.
CHOSEN = 4.0
#: Sets that one task compares with each other: larger buckets are split, larger cells go in
#: blocks of half as many.
BUCKET, CELL = 400, 800
MARGIN = 0.15
#: Splits after the first; what is still large then is taken as it is.
DEPTH = 3
#: Values that must agree at once for sets of a large cell to meet again.
TOGETHER = 8
#: Copies of one text above which they are classed apart from the rest.
HOT_COPIES = 500
#: Texts with more copies than ``HOT_COPIES`` up to which they are broadcast to the scan of their
#: copies; rows of a part in which cells' members are broadcast to the scan of texts, and ids of
#: documents that go to the scan of all documents, and the number of parts beyond which texts
#: are shuffled instead.
BROADCAST_ROWS, BROADCAST_PARTS = 200_000, 8
_CACHED_WORDS = 200_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_words: dict[str, int] = {}
caches["jaccard"] = _words.clear


def word_hashes(words: list[str]) -> np.ndarray:
    found = list(map(_words.get, words))
    if None in found:
        if len(_words) > _CACHED_WORDS:
            _words.clear()
        for i, number in enumerate(found):
            if number is None:
                word = words[i]
                found[i] = xxhash.xxh64_intdigest(word)
                if len(word) <= 40:
                    _words[word] = found[i]
    return np.array(found, dtype=np.uint64)


def ngrams(text: str) -> np.ndarray:
    """The distinct n-grams of a text as sorted 64-bit numbers."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    n = min(WORDS, len(words))
    count = len(words) - n + 1
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total = mix(total * _PRIME + hashes[i : i + count])
    return np.unique(total)


_SEEDS = mix(np.arange(1, EMBEDDING + 1, dtype=np.uint64) * _PRIME) | np.uint64(1)


def embedding(grams: np.ndarray) -> np.ndarray:
    """Min-hash values of a set, 32 bits each."""
    least = np.full(EMBEDDING, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2_048):
        part = grams[at : at + 2_048, None] * _SEEDS[None, :]
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, part.min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def runs_for(recall: float, threshold: float, chosen: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with the given probability."""
    meet = 1.0
    for _ in range(depth + 1):
        meet = 1.0 - math.exp(-chosen * threshold * meet)
    return max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - meet)))


def bands_for(loss: float, threshold: float) -> int:
    """Choices of ``TOGETHER`` places after which a pair at the threshold has met in one, except
    with the given probability; the choices share the ``EMBEDDING`` values."""
    agree = np.arange(EMBEDDING + 1)
    share = np.array([math.comb(EMBEDDING, int(m)) * threshold**m * (1.0 - threshold) ** (EMBEDDING - m) for m in agree])
    meet = np.array([math.comb(int(m), TOGETHER) / math.comb(EMBEDDING, TOGETHER) for m in agree])
    bands = 1
    while float(share @ (1.0 - meet) ** bands) > loss:
        bands += 1
    return bands


def paths_of(values: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths that sets go down from a node each: (row, child path) of all choices."""
    place = (np.arange(EMBEDDING, dtype=np.uint64) << np.uint64(32))[None, :]
    keys = mix((values.astype(np.uint64) | place) * _PRIME + paths[:, None])
    rows, columns = np.nonzero((keys >> np.uint64(40)) < np.uint64(int(CHOSEN / EMBEDDING * (1 << 24))))
    return rows, mix(keys[rows, columns] + _PRIME)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _embeddings(column: pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint32).reshape(-1, EMBEDDING)


def embed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, words_key, n_grams, embedding, brief) of documents that have words; brief has the
    lowest byte of each value of the embedding."""
    out = pa.schema([("doc_id", pa.int64()), ("words_key", pa.binary()), ("n_grams", pa.int32()), ("embedding", pa.binary()), ("brief", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        for batch in batches:
            for part in slices(batch, 1_024):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    grams = ngrams(text)
                    if len(grams):
                        key = hashlib.blake2b(" ".join(text.split()).encode(), digest_size=16).digest()
                        values = embedding(grams)
                        brief = values.astype(np.uint8).tobytes()
                        for column, value in zip(rows, (doc_id, key, len(grams), values.tobytes(), brief)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, out)], schema=out)

    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return in_arrow(plain, run, "doc_id long, words_key binary, n_grams int, embedding binary, brief binary")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal first column, from batches in that column's order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], batch.num_rows)
        for start, end in zip(starts, ends):
            if held and key[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key[start]
    if held:
        yield pa.Table.from_batches(held)


def local_roots(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, each row's smallest connected id."""
    label = ids.copy()
    while True:
        reach = np.where(near, label[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(label, reach)
        if (new == label).all():
            return label
        label = new


def _per_group(rows: DataFrame, work: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """Apply ``work`` to the rows of each value of the first column (``key``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema]
        held = 0
        for group in grouped(batches):
            columns = work(group)
            for all_, new in zip(out, columns):
                all_.append(new)
            held += len(columns[0])
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(out, schema)], schema=schema)
                out, held = [[] for _ in schema], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(out, schema)], schema=schema)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, ddl)


def in_blocks(rows: DataFrame, size: str) -> DataFrame:
    """Adds ``key`` and ``side``: members of a group of at most ``CELL`` share one key;
    a larger group is dealt into blocks, and each two blocks (and each alone) share one.

    ``rows`` has group, id and the group's size in the column ``size``.
    """
    n = F.ceil(F.col(size) / F.lit(CELL / 2)).cast("int")
    blocks = F.when(F.col(size) <= CELL, F.lit(1)).otherwise(n)
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        dealt.withColumn("other", other)
        .withColumn("key", F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")))
        .withColumn("side", F.when(F.col("own") == F.col("other"), F.lit(0)).when(F.col("own") < F.col("other"), F.lit(1)).otherwise(F.lit(2)))
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for the ids of (id, root) edges: the smallest id connected to each.

    Each round every id keeps the edge to its smallest neighbour below and hands its other
    ones on: from those neighbours to the smallest.  So edges move to ever smaller ids and
    meet there as one, and a round without any to hand on leaves one parent for each id,
    whose own parents are followed in steps that double.
    """
    edges = materialise(
        edges.where("id <> root")
        .select(F.greatest("id", "root").alias("id"), F.least("id", "root").alias("root"))
        .distinct()
    )
    labels = None
    while not edges.isEmpty():
        least = F.min("root").over(Window.partitionBy("id"))
        hooked = materialise(edges.select("id", "root", least.alias("least")))
        own = hooked.where("root = least").select("id", "root")
        onward = hooked.where("root > least").select(F.col("root").alias("id"), F.col("least").alias("root")).distinct()
        labels = materialise(own if labels is None else labels.join(own, "id", "left_anti").unionByName(own))
        # An id that has a parent already hands it on with the new ones.
        again = labels.join(onward.select("id").distinct(), "id", "left_semi")
        edges = materialise(onward.unionByName(again).distinct())
    if labels is None:
        return edges
    while True:
        above = labels.select(F.col("id").alias("root"), F.col("root").alias("further"))
        jumped = materialise(labels.join(above, "root", "left").select("id", "root", "further"))
        if jumped.where("further is not null").isEmpty():
            roots = labels.select("root").distinct()
            return labels.unionByName(roots.select(F.col("root").alias("id"), "root"))
        labels = jumped.select("id", F.coalesce("further", "root").alias("root"))


def _near_in_bucket(least_equal: int) -> Callable:
    def work(group: pa.Table):
        ids = group.column(1).to_numpy()
        values = np.frombuffer(b"".join(group.column(2).to_pylist()), np.uint8).reshape(-1, EMBEDDING)
        near = np.zeros((len(ids), len(ids)), bool)
        for i in range(len(ids)):
            near[i] = (values == values[i]).sum(1) >= least_equal
        return ids, local_roots(near, ids)

    return work


def _near_sets(buckets: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(id, root) by the sets that are near in buckets of (key, id)."""
    # The lowest bytes agree wherever the values do, so that no near pair is lost by them.
    rows = buckets.join(classes.select("id", "brief"), "id").select("key", "id", "brief")
    out = pa.schema([("id", pa.int64()), ("root", pa.int64())])
    least_equal = math.ceil((threshold - MARGIN) * EMBEDDING)
    return _per_group(rows, _near_in_bucket(least_equal), out, "id long, root long")


def cells(classes: DataFrame, recall: float, threshold: float) -> DataFrame:
    """(id, root): cells of classes that chosen paths find near one another.

    ``classes`` is a written table of id, embedding and brief.
    """
    runs = runs_for(recall, threshold, CHOSEN, DEPTH)
    start = mix(np.arange(1, runs + 1, dtype=np.uint64) * _PRIME)
    path_schema = pa.schema([("group", pa.int64()), ("id", pa.int64()), ("parent", pa.int64())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1_024):
                ids = part.column(0).to_numpy()
                values = _embeddings(part.column(1))
                for node in start:
                    rows, child = paths_of(values, np.full(len(ids), node, np.uint64))
                    parent = np.full(len(rows), node, np.uint64)
                    yield pa.RecordBatch.from_arrays([_signed(child), pa.array(ids[rows]), _signed(parent)], schema=path_schema)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1_024):
                ids = part.column(0).to_numpy()
                values = _embeddings(part.column(1))
                nodes = part.column(2).to_numpy().view(np.uint64)
                rows, child = paths_of(values, nodes)
                yield pa.RecordBatch.from_arrays([_signed(child), pa.array(ids[rows]), _signed(nodes[rows])], schema=path_schema)

    ddl = "group long, id long, parent long"
    vectors = classes.select("id", "embedding")
    frontier = materialise(vectors.mapInArrow(first, ddl))
    small, taken = [], []
    for depth in range(DEPTH + 1):
        sizes = frontier.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("root")).where("size > 1")
        sized = materialise(frontier.select("group", "id").join(sizes, "group"))
        small.append(sized.where(F.col("size") <= BUCKET).select(F.col("group").alias("key"), "id"))
        large = sized.where(F.col("size") > BUCKET)
        if large.isEmpty():
            break
        if depth == DEPTH:
            taken.append(large)
            break
        split = materialise(large.join(vectors, "id").select("id", "embedding", "group").mapInArrow(further, ddl))
        # A bucket most of which would go down one path together is taken as it is.
        children = split.groupBy("parent", "group").agg(F.count(F.lit(1)).alias("n"))
        most = children.groupBy("parent").agg(F.max("n").alias("most")).select(F.col("parent").alias("group"), "most")
        judged = materialise(large.select("group", "size").distinct().join(most, "group", "left"))
        dense = judged.where(F.coalesce("most", F.lit(0)) * 2 >= F.col("size")).select("group")
        taken.append(large.join(dense, "group", "left_semi"))
        kept = judged.where(F.coalesce("most", F.lit(0)) * 2 < F.col("size")).select(F.col("group").alias("parent"))
        frontier = split.join(kept, "parent", "left_semi").select("group", "id")
    edges = [_near_sets(reduce(DataFrame.unionByName, small), classes, threshold)]
    edges += [large.select("id", "root") for large in taken]
    return components(reduce(DataFrame.unionByName, edges))


def taken_apart(found: DataFrame, classes: DataFrame, loss: float, threshold: float) -> DataFrame:
    """(id, root) of ``cells`` with those of more than ``CELL`` members taken apart.

    ``found`` and ``classes`` are written tables.  A bucket of more than ``BUCKET`` sets that
    agree in all values of a band is taken as near one another as it is.
    """
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    sized = materialise(found.join(sizes, "root").select("id", "root", "size"))
    large = sized.where(F.col("size") > CELL)
    if large.isEmpty():
        return found
    chosen = np.random.default_rng(1)
    places = [np.sort(chosen.choice(EMBEDDING, TOGETHER, replace=False)) for _ in range(bands_for(loss, threshold))]
    starts = np.arange(1, len(places) + 1, dtype=np.uint64) * _PRIME
    schema = pa.schema([("group", pa.int64()), ("id", pa.int64())])

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1_024):
                ids = part.column(0)
                values = _embeddings(part.column(1)).astype(np.uint64)
                root = part.column(2).to_numpy().view(np.uint64)
                for start, at in zip(starts, places):
                    key = mix(root + start)
                    for place in at:
                        key = mix(key * _PRIME + values[:, place])
                    yield pa.RecordBatch.from_arrays([_signed(key), ids], schema=schema)

    vectors = large.select("id", "root").join(classes.select("id", "embedding"), "id").select("id", "embedding", "root")
    met = materialise(vectors.mapInArrow(bands, "group long, id long"))
    buckets = met.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("root")).where("size > 1")
    dealt = materialise(met.join(buckets, "group"))
    small = dealt.where(F.col("size") <= BUCKET).select(F.col("group").alias("key"), "id")
    near = _near_sets(small, classes, threshold)
    edges = near.unionByName(dealt.where(F.col("size") > BUCKET).select("id", "root"))
    return sized.where(F.col("size") <= CELL).select("id", "root").unionByName(components(edges))


def _exact_in_cell(threshold: float) -> Callable:
    def work(group: pa.Table):
        ids, side = group.column(1).to_numpy(), group.column(2).to_numpy()
        weight = group.column(3).to_numpy()
        grams = [np.frombuffer(x, np.uint64) for x in group.column(4).to_pylist()]
        n = len(ids)
        sizes = np.array([len(g) for g in grams], np.int64)
        common = np.zeros((n, n), np.float32)
        tokens = np.concatenate(grams)
        owner = np.repeat(np.arange(n), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        number = np.cumsum(new) - 1
        shared = np.bincount(number)[number] > 1
        number, owner = number[shared], owner[shared]
        if len(number):
            _, number = np.unique(number, return_inverse=True)
            step = 4_096
            for at in range(0, int(number[-1]) + 1, step):
                low, high = np.searchsorted(number, [at, at + step])
                seen = np.zeros((n, step), np.float32)
                seen[owner[low:high], number[low:high] - at] = 1
                common += seen @ seen.T
        together = sizes[:, None] + sizes[None, :] - common.astype(np.int64)
        near = common.astype(np.int64) >= threshold * together - 1e-9
        np.fill_diagonal(near, False)
        # Of two blocks only pairs across count; pairs inside belong to the block alone.
        near &= (side == 0)[:, None] | (side[:, None] != side[None, :])
        links = near @ weight
        return ids, local_roots(near, ids), links

    return work


def in_parts(rows: DataFrame, key: str) -> list[DataFrame]:
    """``rows``, a written table, dealt by ``key`` into parts that are each small enough to be
    broadcast; one part that is not, where there would be more than ``BROADCAST_PARTS``."""
    parts = max(1, math.ceil(rows.count() / BROADCAST_ROWS))
    if parts > BROADCAST_PARTS:
        return [rows]
    return [F.broadcast(rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)) for i in range(parts)]


def linked(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(id, root, links) of the members of cells: the smallest id that true links connect
    to each, and the number of documents that it is linked to.

    ``members`` is a written table of id, cell, size (of the cell) and copies; ``texts`` has one
    row of each doc_id.
    """
    out = pa.schema([("cell", pa.int64()), ("id", pa.int64()), ("size", pa.int64()), ("copies", pa.int64()), ("grams", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        for batch in batches:
            for part in slices(batch, 256):
                grams = [ngrams(text).tobytes() for text in part.column(4).to_pylist()]
                columns = [part.column(i) for i in range(4)] + [pa.array(grams, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    # All parts meet the texts in one scan, in which no text is moved.
    member = F.struct("cell", "id", "size", "copies")
    parts = in_parts(members.select(F.col("id").alias("member_id"), member.alias("member")), "member_id")
    rows = texts
    for i, part in enumerate(parts):
        part = part.select(F.col("member_id").alias(f"id_{i}"), F.col("member").alias(f"member_{i}"))
        rows = rows.join(part, F.col("doc_id") == F.col(f"id_{i}"), "left" if len(parts) > 1 else "inner")
    own = F.coalesce(*[F.col(f"member_{i}") for i in range(len(parts))])
    rows = rows.select(own.alias("member"), "text").where("member is not null").select("member.*", "text")
    with_sets = rows.select("cell", "id", "size", "copies", "text").mapInArrow(
        sets, "cell long, id long, size long, copies long, grams binary"
    )
    keyed = in_blocks(with_sets.withColumnRenamed("cell", "group"), "size").select(
        "key", "id", F.col("side").cast("int").alias("side"), "copies", "grams"
    )
    done = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
    found = materialise(_per_group(keyed, _exact_in_cell(threshold), done, "id long, root long, links long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    return links.join(components(found.select("id", "root")), "id", "left")


def one_text_each(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of repeated rows of one doc_id the smallest text; texts are moved only
    where there are such rows."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty():
        return rows
    return materialise(rows.groupBy("doc_id").agg(F.min("text").alias("text")))


def with_class(embedded: DataFrame, keys: DataFrame) -> DataFrame:
    """Every embedded document with its class of equal texts; the copies of a text that has
    many do not meet in one task."""
    hot = keys.where(F.col("copies") > HOT_COPIES)
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return embedded.join(keys, "words_key")
    known = embedded.join(F.broadcast(hot), "words_key")
    rest = embedded.join(F.broadcast(hot.select("words_key")), "words_key", "left_anti")
    return known.unionByName(rest.join(keys.where(F.col("copies") <= HOT_COPIES), "words_key"))


@settled
def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = 0.9999) -> DataFrame:
    """doc_id, class_id, n_links of every document.

    class_id is the smallest doc_id that links connect to the document (its own if it has
    none); n_links counts the other documents that are as similar as the threshold, copies
    included.
    """
    texts = one_text_each(docs)
    ids = texts.select("doc_id")
    embedded = materialise(embed_documents(texts))
    keys = materialise(
        embedded.groupBy("words_key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )
    classed = materialise(
        with_class(embedded, keys).select(
            "doc_id",
            "id",
            "copies",
            *[F.when(F.col("doc_id") == F.col("id"), F.col(c)).alias(c) for c in ("embedding", "brief")],
        )
    )
    classes = classed.where("doc_id = id").select("id", "copies", "embedding", "brief")
    # Either step may lose half of what may be lost.
    allowed = (1.0 - recall) / 2
    found = taken_apart(materialise(cells(classes, 1.0 - allowed, threshold)), classes, allowed, threshold)
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = materialise(
        found.join(sizes, "root")
        .join(classes.select("id", "copies"), "id")
        .select("id", F.col("root").alias("cell"), "size", "copies")
    )
    links = materialise(linked(members, texts, threshold))
    by_document = classed.select("doc_id", "id", "copies").join(links, "id", "left").select(
        "doc_id",
        F.coalesce("root", "id").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return ids.join(by_document, "doc_id", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD, recall: float = 0.9999) -> DataFrame:
    """The documents without those whose class has a smaller doc_id; rows without a doc_id
    stay."""
    found = jaccard_join(docs, threshold, recall)
    name = "gone_id"
    while name in map(str.lower, docs.columns):
        name += "_"
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias(name))
    kept = docs
    for part in in_parts(gone, name):
        kept = kept.join(part, kept["doc_id"].cast("long") == part[name], "left_anti")
    return kept.select(*docs.columns)
