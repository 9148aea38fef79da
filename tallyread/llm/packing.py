"""Best-fit packing of token sequences with exact-complement hashing.

The lengths of pieces are at most the capacity, so their histogram is a small fixed
table.  A plan over the histogram alone decides what goes together: for the longest
length left, the gap that it leaves is looked up in an index from sums to the single
lengths, pairs and triples that have them; a combination that fills the gap exactly is
consumed as often as its counts allow.  Where none does, the longest length that fits goes
in and the smaller gap is looked up again.  The pieces themselves then get places by their
rank among the pieces of equal length; a length has as many buckets as its count asks for
and ranks are counted per (length, bucket), so that no length, however common, meets in
one task.

Ids are those of the library on the whole text without special tokens added; a special
token that stands in a text as such is one id, as in the library.

Defined results: null and empty texts have only the end token; repeated rows are packed
once each; an empty table gives no rows; other columns are ignored; texts are never cut
before encoding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import RUN_BYTES, RUN_ROWS, codec_of, tokenizer_json
from .common import in_arrow, materialise, settled, slices, whole_text

#: Rows of a rank bucket, on average.
BUCKET_ROWS = 1_000


def cut(tokens: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document: full ones, the first maybe shorter."""
    if tokens <= capacity:
        return [tokens]
    first = tokens % capacity or capacity
    return [first] + [capacity] * ((tokens - first) // capacity)


def token_pieces(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(vocabulary_path))
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    out = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value, special=True)
        for batch in batches:
            rows = []
            for part in slices(batch, RUN_ROWS, RUN_BYTES):
                got, bounds = codec.encode_column(part.column(1))
                for doc_id, first, last in zip(part.column(0).to_pylist(), bounds[:-1], bounds[1:]):
                    ids = got[first:last].tobytes() + end
                    start = 0
                    for piece, length in enumerate(cut(len(ids) // 4, capacity)):
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        rows.append((doc_id, piece, start, length, crc))
                        start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], schema=out
            )

    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return in_arrow(columns, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class SumIndex:
    """From a sum to the lengths, pairs and triples of lengths that make it up.

    ``available`` counts the pieces of each length and only ever falls, so a combination that
    is used up stays so: each sum keeps the place in its list of combinations, longest first
    lengths first, before which none is left.
    """

    def __init__(self, available: list[int]):
        self.available = available
        lengths = [x for x in range(len(available) - 1, 0, -1) if available[x]]
        self.lengths = lengths
        self.pairs: list[list[tuple[int, int]]] = [[] for _ in available]
        for first in lengths:
            for second in lengths:
                if second <= first and first + second < len(available):
                    self.pairs[first + second].append((first, second))
        self.next_pair = [0] * len(available)
        self.triples: dict[int, Iterator[tuple[int, int, int]]] = {}
        self.next_triple: dict[int, tuple[int, int, int] | None] = {}

    def fits(self, used: tuple[int, ...]) -> bool:
        return all(self.available[x] >= used.count(x) for x in used)

    def pair(self, total: int) -> tuple[int, int] | None:
        pairs, at = self.pairs[total], self.next_pair[total]
        while at < len(pairs) and not self.fits(pairs[at]):
            at += 1
        self.next_pair[total] = at
        return pairs[at] if at < len(pairs) else None

    def _triples_of(self, total: int) -> Iterator[tuple[int, int, int]]:
        for first in self.lengths:
            if first < total and self.available[first] and 3 * first >= total:
                for second, third in self.pairs[total - first]:
                    if second <= first and self.available[first]:
                        yield first, second, third

    def triple(self, total: int) -> tuple[int, int, int] | None:
        if total not in self.triples:
            self.triples[total] = self._triples_of(total)
            self.next_triple[total] = next(self.triples[total], None)
        found = self.next_triple[total]
        while found is not None and not self.fits(found):
            found = next(self.triples[total], None)
        self.next_triple[total] = found
        return found

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that are available together and sum to ``gap``."""
        if gap < len(self.available) and self.available[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; every piece is used once."""
    available = [0] * (capacity + 1)
    for length, count in histogram.items():
        available[length] += count
    index = SumIndex(available)
    out: list[tuple[tuple[int, ...], int]] = []
    longest = capacity
    while True:
        while longest > 0 and not available[longest]:
            longest -= 1
        if longest == 0:
            return out
        pattern, gap = [longest], capacity - longest
        available[longest] -= 1
        while gap:
            found = index.complement(gap)
            if found is None:
                fits = next((x for x in range(min(longest, gap), 0, -1) if available[x]), 0)
                if not fits:
                    break
                found = (fits,)
            pattern += found
            gap -= sum(found)
            for x in found:
                available[x] -= 1
        times = 1 + min(available[x] // pattern.count(x) for x in set(pattern))
        for x in pattern:
            available[x] -= times - 1
        out.append((tuple(pattern), times))


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset) of every slot."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            out.append((length, rank, rank + times, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (with a length column).

    Full pieces are alone in their sequences and take negative numbers.  The plan is
    made on the driver from at most ``capacity`` counts and has at most that many slots
    times a small factor; it is the only thing broadcast.
    """
    spark = pieces.sparkSession
    counts = pieces.where(F.col("length") < capacity).groupBy("length").count().collect()
    histogram = {row["length"]: row["count"] for row in counts}
    buckets = [max(1, -(-histogram.get(length, 0) // BUCKET_ROWS)) for length in range(max(1, capacity))]
    slots = spark.createDataFrame(
        placements(plan(histogram, capacity)) or [(0, 0, 0, 0, 0)],
        "length long, low long, high long, first_sequence long, offset long",
    )
    full = pieces.where(F.col("length") >= capacity).select(
        *pieces.columns,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    short = pieces.where(F.col("length") < capacity).withColumn(
        "bucket",
        F.pmod(
            F.xxhash64("doc_id", "piece", "ids_crc32"),
            F.get(F.array([F.lit(n) for n in buckets]), F.col("length").cast("int")),
        ),
    )
    own = Window.partitionBy("length", "bucket")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        short.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    ranked = (
        short.withColumn("place", F.row_number().over(own.orderBy("doc_id", "piece")) - 1)
        .join(starts, ["length", "bucket"])
        .withColumn("rank", F.col("place") + F.col("before"))
    )
    placed = ranked.join(
        F.broadcast(slots.withColumnRenamed("length", "slot_length")),
        (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    ).select(
        *pieces.columns,
        (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"),
        "offset",
    )
    return full.unionByName(placed)


@settled
def pack_documents(docs: DataFrame, vocabulary_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialise(token_pieces(docs, vocabulary_path, end_id, capacity))
    out = pack(pieces, capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
