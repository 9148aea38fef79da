"""Exact top-k inner products over norm-sorted blocks.

Vectors are packed into blocks by descending length.  An orthogonal rotation from the
eigenvectors of the vectors' second-moment matrix (the right singular vectors) moves most
of the energy to the first coordinates.  For a query, the product over those coordinates
plus the product of the two residual lengths bounds the whole product (Cauchy-Schwarz);
candidates below the query's k-th score so far are skipped, and blocks whose longest
vector cannot reach it are never paired with the query's block.  Survivors are scored
exactly in integers.

Queries come in blocks too, so neither side is gathered anywhere; broadcast are the
rotation (dimension squared) and one block of the longest vectors.

Defined results: a vector that is null, empty, or holds null or non-finite components
takes no part; missing trailing components count as 0; a row with the query's own id is
never its candidate; a query id that occurs several times is asked once, with its smallest
vector; repeated candidate rows are ranked one after the other; fewer than k candidates
give all; an empty table gives no rows; other columns are ignored.  Vectors whose inner
products might not fit a score of 64 bits (components of some 1.5 million and more at 64
dimensions) are refused with a ValueError, since no right score can be returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, settled

BLOCK_ROWS = 4_096
QUERY_ROWS = 512
STEP_ROWS = 512


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): components as floor(256 x), rows that take part only."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where((F.size("embedding") > 0) & usable)
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    )


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def rotation_of(ints: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the sum of outer products, by descending eigenvalue."""

    def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for part in parts:
            x = _matrix(part["v"].tolist(), width).astype(np.float64)
            total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "m": total.ravel()})

    sums = ints.select("v").mapInPandas(moments, "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m"))
    square = np.zeros((width, width))
    for row in sums.collect():
        square[row["i"], row["j"]] = row["m"]
    _, vectors = np.linalg.eigh((square + square.T) / 2)
    return np.ascontiguousarray(vectors[:, ::-1])


def packed(rows: DataFrame, width: int, most: int) -> DataFrame:
    """Blocks of at most ``most`` rows of one partition, in its order."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(ids, x):
            longest = float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max()))
            small = x.astype(np.int32) if np.abs(x).max(initial=0) < 2**31 else x
            return pd.DataFrame({"n": [len(ids)], "longest": [longest], "ids": [ids.tobytes()], "data": [small.tobytes()]})

        ids, data, held = [], [], 0
        for part in parts:
            ids.append(part["vec_id"].to_numpy(np.int64))
            data.append(_matrix(part["v"].tolist(), width))
            held += len(part)
            while held >= most:
                all_ids, all_data = np.concatenate(ids), np.concatenate(data)
                yield block(all_ids[:most], all_data[:most])
                ids, data, held = [all_ids[most:]], [all_data[most:]], held - most
        if held:
            yield block(np.concatenate(ids), np.concatenate(data))

    return rows.select("vec_id", "v").mapInPandas(pack, "n int, longest double, ids binary, data binary")


def _unpacked(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, np.int64)
    kind = np.int64 if len(data) == 8 * width * len(numbers) else np.int32
    return numbers, np.frombuffer(data, kind).reshape(-1, width).astype(np.int64)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as integers."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if reach < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def search_block(
    q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, floor: np.ndarray, k: int
) -> pd.DataFrame:
    """The k best of one block for every query, without those below ``floor`` (the k-th
    score that the query is known to reach; -inf if unknown)."""
    width = q.shape[1]
    lead = max(1, width // 4)
    q_turned, x_turned = q @ rotation, x @ rotation
    q_rest = np.sqrt((q_turned[:, lead:] ** 2).sum(1))
    x_rest = np.sqrt((x_turned[:, lead:] ** 2).sum(1))
    q_long = np.sqrt((q_turned**2).sum(1))
    x_long = np.sqrt((x_turned**2).sum(1))
    best = np.full((len(q), k), -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(x), STEP_ROWS):
        part = slice(at, at + STEP_ROWS)
        least = np.maximum(floor, best.min(1))
        slack = 1e-9 * (q_long * x_long[part].max(initial=0) + 1)
        live = np.flatnonzero(q_long * x_long[part].max(initial=0) + slack >= least)
        if not len(live):
            continue
        bound = q_turned[live, :lead] @ x_turned[part, :lead].T + np.outer(q_rest[live], x_rest[part])
        mask = bound + slack[live, None] >= least[live, None]
        mask &= q_ids[live, None] != x_ids[None, part]
        rows, columns = np.nonzero(mask)
        if not len(rows):
            continue
        if mask.mean() > 0.1:
            scores = _products(q[live], x[part])[rows, columns]
        else:
            scores = (q[live[rows]] * x[part][columns]).sum(1)
        dense = np.full(mask.shape, -np.inf)
        dense[rows, columns] = scores
        both = np.concatenate([best[live], dense], axis=1)
        best[live] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        keep = scores >= np.maximum(floor, best.min(1))[live[rows]]
        found.append((live[rows[keep]], x_ids[part][columns[keep]], scores[keep]))
    if not found:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
    rows, ids, scores = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    return pd.DataFrame({"query_id": q_ids[rows[keep]], "vec_id": ids[keep], "score": scores[keep].astype(np.int64)})


@settled
def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of every query.

    ``vectors`` and ``queries`` have vec_id and embedding.
    """
    spark = vectors.sparkSession
    out_type = "query_id long, vec_id long, score long"
    ints = integer_vectors(vectors)
    asked = integer_vectors(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    measures = F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(largest).alias("most")
    seen, seen_q = ints.agg(*measures).first(), asked.agg(*measures).first()
    if not seen["n"] or not seen_q["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(seen["width"], seen_q["width"])
    if seen["most"] * seen_q["most"] * width >= 2.0**63:
        raise ValueError("inner products of these vectors may not fit 64 bits")
    rotation = spark.sparkContext.broadcast(rotation_of(ints, width))

    n_blocks = -(-seen["n"] // BLOCK_ROWS)
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    by_length = ints.withColumn("squares", squares).repartitionByRange(n_blocks, F.desc("squares"), "vec_id")
    blocks = materialise(packed(by_length.sortWithinPartitions(F.desc("squares"), "vec_id"), width, BLOCK_ROWS))
    groups = -(-seen_q["n"] // QUERY_ROWS)
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
    asked_blocks = packed(asked.withColumn("g", group).repartition(groups, "g"), width, QUERY_ROWS)

    top = blocks.orderBy(F.desc("longest"), F.desc("n")).select("ids", "data").first()
    first_block = spark.sparkContext.broadcast((bytes(top["ids"]), bytes(top["data"])))

    def with_floor(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x_ids, x = _unpacked(*first_block.value, width)
        for part in parts:
            floors, needs = [], []
            for ids, data in zip(part["ids"], part["data"]):
                q_ids, q = _unpacked(ids, data, width)
                scores = _products(q, x).astype(np.float64)
                scores[q_ids[:, None] == x_ids[None, :]] = -np.inf
                floor = np.full(len(q), -np.inf)
                if scores.shape[1] >= k:
                    floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
                long = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                need = np.where(floor > 0, floor / np.maximum(long, 1e-300), 0.0)
                floors.append(floor.tobytes())
                needs.append(float(need.min()))
            yield pd.DataFrame({"q_ids": part["ids"], "q_data": part["data"], "floor": floors, "need": needs})

    asked_blocks = materialise(
        asked_blocks.mapInPandas(with_floor, "q_ids binary, q_data binary, floor binary, need double")
    )
    # A block of vectors meets every block of queries that its longest vector may serve; which
    # these are is settled on names and bounds alone, before any block moves.
    slots = asked_blocks.count()
    slot = F.pmod(F.xxhash64("q_ids"), F.lit(slots)).cast("int")
    keyed = asked_blocks.withColumns({"q": F.xxhash64("q_ids"), "g": slot})
    named = blocks.withColumn("b", F.xxhash64("ids"))
    wanted = (
        named.select("b", "longest", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("g"))
        .join(keyed.select("q", "g", "need"), "g")
        .where(F.col("longest") * (1 + 1e-9) >= F.col("need"))
        .select("b", "q")
    )
    pairs = (
        wanted.join(named.select("b", "ids", "data"), "b")
        .join(keyed.select("q", "q_ids", "q_data", "floor"), "q")
        .select("ids", "data", "q_ids", "q_data", "floor")
    )

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                x_ids, x = _unpacked(row.ids, row.data, width)
                q_ids, q = _unpacked(row.q_ids, row.q_data, width)
                floor = np.frombuffer(row.floor, np.float64)
                yield search_block(q_ids, q, x_ids, x, rotation.value, floor, k)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.mapInPandas(search, out_type)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
