"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

Terms are runs of five words (a shorter text is one term) and a term's weight is the
number of times that it occurs.  Each of the ``SAMPLES`` samples is drawn over all terms of
the text: for sample j and a term k of weight w, pseudo-random numbers that depend on j and
k alone give r and c from Gamma(2, 1) and b from the unit interval; with
t = floor(ln w / r + b) the term's sample value is c * exp(-r * (t - b + 1)), and the term of
least value, together with its t, is drawn with probability proportional to weight, alike
in all documents.  The share of equal samples estimates the generalised Jaccard similarity
(sum of least weights over sum of greatest weights) without bias.

The numbers are made in an order that spares most of them.  At weight 1 a term's values
are independent Exp(1), that is the first arrivals at each j of one Poisson process of rate
``SAMPLES`` whose arrivals choose j evenly; so a term's arrivals are made in ascending order
and only up to a limit, beyond which no sample of the text can lie if every sample has a
value below it (if one has not, the limit is raised, at last to none).  Given its value a at
weight 1, a term has c = a + Exp(1), ln(c / a) = r * (1 - b) and r = ln(c / a) + Exp(1), which
is the same joint distribution; terms that occur more than once get all their values so.

Defined results: null text is the empty text; it has the empty fingerprint, whose
likeness is 1 to itself and 0 to any other; equal texts have equal fingerprints; repeated
rows give repeated results; other columns are ignored; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, whole_text

WORDS = 5
NUMBER_BITS = 6
SAMPLES = 1 << NUMBER_BITS
#: Arrivals below a first and a second limit that a sample has on average (64 * exp(-7) is the
#: chance that a text needs the second); arrivals at END and above are made one by one for
#: each j, from the memoryless rest.
FIRST_LIMIT, SECOND_LIMIT, END = 7.0, 18.0, 0.5
#: Bits of a drawn sample's identity, and of its value while terms compete.
SAMPLE_BITS, VALUE_BITS = 25, 32
#: Documents of a range of ids, about, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1_000, 20_000


def terms(text: Column) -> Column:
    """Hashes of all runs of five words, repeats included."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def runs(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - WORDS, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + n) for n in range(WORDS)]))

    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < WORDS, F.array(F.xxhash64(h)))
        .otherwise(runs(h)),
    )


def counted(s: Column) -> Column:
    """Array of (k, w) from sorted terms: the distinct ones and how often each occurs."""
    first = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(s), F.lit(1)) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
    )
    return let(
        first,
        lambda at: F.transform(
            at,
            lambda p, j: F.struct(
                F.get(s, p).alias("k"),
                (F.coalesce(F.get(at, j + 1), F.size(s)) - p).alias("w"),
            ),
        ),
    )


def _unit(bits: Column) -> Column:
    """32 bits as a number strictly between 0 and 1."""
    return (bits.cast("double") + 0.5) * (2.0**-32)


def _high(h: Column) -> Column:
    return F.shiftrightunsigned(h, 32)


def _low(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFFFFFF))


def _scaled(log_value: Column) -> Column:
    """The logarithm of a sample value as a number of ``VALUE_BITS`` bits."""
    scaled = F.floor((log_value + 128.0) * float(1 << (VALUE_BITS - 8))).cast("long")
    return F.least(F.greatest(scaled, F.lit(0).cast("long")), F.lit((1 << VALUE_BITS) - 1))


def _key(j: Column, k: Column, log_value: Column, t: Column | None = None) -> Column:
    """Number of the sample, its value and its identity in one sortable number."""
    identity = F.shiftrightunsigned(k, NUMBER_BITS)
    if t is not None:
        identity = identity.bitwiseXOR(t * F.lit(2654435761).cast("long"))
    return (
        F.shiftleft(j, VALUE_BITS + SAMPLE_BITS)
        .bitwiseOR(F.shiftleft(_scaled(log_value), SAMPLE_BITS))
        .bitwiseOR(identity.bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1)))
    )


def _number(key: Column) -> Column:
    return F.shiftrightunsigned(key, VALUE_BITS + SAMPLE_BITS)


def _chosen(h: Column) -> Column:
    """The j of an arrival."""
    return h.bitwiseAND(F.lit(SAMPLES - 1).cast("long"))


def _gap(h: Column) -> Column:
    """Time from the arrival before, or from 0, to the arrival with bits h."""
    return F.log(_unit(_high(h))) * (-1.0 / SAMPLES)


def arrivals(ks: Column, limit: Column, value: Callable[[Column], Column], kind: str) -> Column:
    """Array of ``value``, of type ``kind``, of the arrivals (k, h, a) below a limit of each
    term's process.  The first has the bits of k, which are random already, and each other a
    hash of the bits before it.  Only each term's latest arrival is kept as (k, h, a)."""
    least = F.exp(limit * float(-SAMPLES)) * float(1 << 32) - 0.5
    first = let(
        least,
        lambda low: F.transform(
            F.filter(ks, lambda k: _high(k) > low),
            lambda k: F.struct(k.alias("k"), k.alias("h"), _gap(k).alias("a")),
        ),
    )

    def after(now: Column) -> Column:
        following = F.transform(
            now,
            lambda x: F.struct(
                x["k"].alias("k"),
                F.xxhash64(x["h"]).alias("h"),
                (x["a"] + _gap(F.xxhash64(x["h"]))).alias("a"),
            ),
        )
        return F.filter(following, lambda x: x["a"] < limit)

    def step(got: Column, _: Column) -> Column:
        return F.when(F.size(got["now"]) == 0, got).otherwise(
            F.struct(
                F.concat(got["all"], F.transform(got["now"], value)).alias("all"), after(got["now"]).alias("now")
            )
        )

    # Their number is Poisson distributed; more than this many in a row do not happen.
    mean = limit * float(SAMPLES)
    most = F.ceil(mean + F.sqrt(mean) * 9.0 + 17.0).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct(F.array().cast(f"array<{kind}>").alias("all"), first.alias("now")),
        step,
        lambda got: got["all"],
    )


def _weighted(k: Column, w: Column, j: Column, a: Column) -> Column:
    """The key of sample j of a term of any weight that has value a at weight 1."""
    h = F.xxhash64(k, j, F.lit(3))

    def with_c(c: Column) -> Column:
        return let(F.log(c / a), lambda v: let(v - F.log(_unit(_low(h))), lambda r: with_rate(c, v, r)))

    def with_rate(c: Column, v: Column, r: Column) -> Column:
        shift = F.lit(1.0) - v / r
        step = F.floor(F.log(w.cast("double")) / r + shift)
        return let(step, lambda t: _key(j, k, F.log(c) - r * (t - shift + 1.0), t))

    return let(a - F.log(_unit(_high(h))), with_c)


def every_key(k: Column, w: Column) -> Column:
    """Keys of all samples of one term."""
    placed = lambda x: F.struct(_chosen(x["h"]).alias("j"), x["a"].alias("a"))
    early = F.sort_array(arrivals(F.array(k), F.lit(END), placed, "struct<j:bigint,a:double>"))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(SAMPLES - 1).cast("long"))

    def with_rest(s: Column) -> Column:
        rest = F.transform(
            F.array_except(numbers, F.transform(s, lambda x: x["j"])),
            lambda j: F.struct(j.alias("j"), (F.lit(END) - F.log(_unit(_high(F.xxhash64(k, j, F.lit(2)))))).alias("a")),
        )
        return F.concat(F.filter(s, lambda x, i: (i == 0) | (x["j"] != F.get(s, i - 1)["j"])), rest)

    return F.transform(
        let(early, with_rest),
        lambda x: F.when(w == 1, _key(x["j"], k, F.log(x["a"]))).otherwise(_weighted(k, w, x["j"], x["a"])),
    )


def _least(keys: Column) -> Column:
    """The least key of each sample that has one."""
    return let(
        F.sort_array(keys),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (_number(x) != _number(F.get(s, i - 1)))),
    )


def drawn(hashes: Column, limited: bool = True) -> Column:
    """The keys of all samples over all distinct terms; without limits, from all values."""

    def all_keys(counts: Column) -> Column:
        return F.flatten(F.transform(counts, lambda x: every_key(x["k"], x["w"])))

    def below(limit: Column, singles: Column, repeated: Column) -> Column:
        keyed = lambda x: _key(_chosen(x["h"]), x["k"], F.log(x["a"]))
        early = arrivals(singles, limit, keyed, "bigint")
        bound = _scaled(F.log(limit))
        value = lambda x: F.shiftrightunsigned(x, SAMPLE_BITS).bitwiseAND(F.lit((1 << VALUE_BITS) - 1))
        return _least(F.concat(early, let(bound, lambda b: F.filter(repeated, lambda x: value(x) < b))))

    def of(s: Column) -> Column:
        everything = _least(all_keys(counted(s)))
        if not limited:
            return F.when(F.size(s) == 0, F.array().cast("array<bigint>")).otherwise(everything)
        distinct = F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1)))
        nothing = F.array().cast("array<bigint>")

        def split(c: Column) -> Column:
            singles = F.transform(F.filter(c, lambda x: x["w"] == 1), lambda x: x["k"])
            return F.struct(singles.alias("singles"), all_keys(F.filter(c, lambda x: x["w"] > 1)).alias("repeated"))

        parts = let(
            distinct,
            lambda d: F.when(
                F.size(d) == F.size(s), F.struct(d.alias("singles"), nothing.alias("repeated"))
            ).otherwise(let(counted(s), split)),
        )

        def tried(p: Column) -> Column:
            limit = lambda mean: F.lit(mean) / F.size(s)
            complete = lambda x, other: F.when(F.size(x) == SAMPLES, x).otherwise(other)
            attempt = lambda mean: let(limit(mean), lambda m: below(m, p["singles"], p["repeated"]))
            second = F.when(limit(SECOND_LIMIT) > END, everything).otherwise(
                let(attempt(SECOND_LIMIT), lambda x: complete(x, everything))
            )
            return let(attempt(FIRST_LIMIT), lambda x: complete(x, second))

        return (
            F.when(F.size(s) == 0, nothing)
            .when(F.lit(FIRST_LIMIT) / F.size(s) > END, everything)
            .otherwise(let(parts, tried))
        )

    return let(F.sort_array(hashes), of)


def samples(text: Column, limited: bool = True) -> Column:
    """The fingerprint as an array: each sample's number and identity; empty without terms."""
    return F.transform(
        drawn(terms(text), limited),
        lambda x: F.shiftleft(_number(x), SAMPLE_BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1))),
    )


def as_string(fingerprint: Column) -> Column:
    """Eight hexadecimal digits for each sample."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(one: Column, other: Column) -> Column:
    """Share of equal samples among those that either fingerprint has."""
    numbers = lambda a: F.transform(a, lambda x: F.shiftrightunsigned(x, SAMPLE_BITS))
    filled = F.size(F.array_union(numbers(one), numbers(other)))
    equal = F.size(F.array_intersect(one, other))
    return F.when(filled == 0, F.lit(1.0)).otherwise(equal / F.greatest(filled, F.lit(1)))


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of ascending bounds that lie below an id, in two steps."""
    if not bounds:
        return F.lit(0)
    step = 64
    everything = F.array(*[F.lit(b) for b in bounds])
    coarse = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]]) if len(bounds) >= step else None
    if coarse is None:
        return F.size(F.filter(everything, lambda b: b < doc_id))
    skipped = F.size(F.filter(coarse, lambda b: b < doc_id)) * step
    rest = F.filter(F.slice(everything, skipped + 1, step), lambda b: b < doc_id)
    return skipped + F.size(rest)


def with_next_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint) by ascending doc_id; after
    the last document comes the first; equal ids go by text.

    Ranges of ids are cut at approximate quantiles, each range is sorted by itself, and
    the first document of a range is also placed at the end of the range before it.
    Nothing but the ranges' bounds and first ids is gathered.
    """
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    ids = plain.select("doc_id").where("doc_id is not null")
    wanted = max(1, min(MOST_RANGES, ids.count() // RANGE_ROWS))
    cuts = [i / wanted for i in range(1, wanted)]
    bounds = sorted({int(b) for b in ids.approxQuantile("doc_id", cuts, 1 / (4 * wanted))}) if cuts else []
    placed = plain.withColumn("range", F.coalesce(_range_of(F.col("doc_id"), bounds), F.lit(-1)))
    firsts = sorted(
        (r["range"], r["first"])
        for r in placed.groupBy("range").agg(F.min("doc_id").alias("first")).collect()
    )
    last_of = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts) if first is not None}
    spark = docs.sparkSession
    heads = spark.createDataFrame(
        [(first, place) for first, place in last_of.items()], "doc_id long, before int"
    )
    own = Window.partitionBy("doc_id").orderBy("text")
    copies = (
        plain.join(F.broadcast(heads), "doc_id")
        .withColumn("place", F.row_number().over(own))
        .where("place = 1")
        .select("doc_id", "text", F.col("before").alias("range"), F.lit(1).alias("extra"))
    )
    rows = (
        placed.withColumn("extra", F.lit(0))
        .unionByName(copies)
        .withColumn("fingerprint", samples(F.col("text")))
    )
    order = Window.partitionBy("range").orderBy("extra", "doc_id", "text")
    return (
        rows.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_fingerprint", F.lead("fingerprint").over(order))
        .where("extra = 0")
        .drop("range", "extra")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter (rounded down) replaced by as many code points
    from the start of the next document, or by all that it has.
    """
    length = F.length("text")
    quarter = F.floor(length / 4).cast("int")
    edited = F.concat(F.left(F.col("text"), length - quarter), F.left(F.coalesce("next_text", F.lit("")), quarter))
    rows = with_next_text(docs).select(
        "doc_id",
        length.cast("long").alias("n_chars"),
        "fingerprint",
        "next_fingerprint",
        edited.alias("edited"),
    )
    rows = rows.select(
        "doc_id",
        "n_chars",
        "fingerprint",
        "next_fingerprint",
        F.sha2("edited", 256).alias("edited_sha256"),
        samples(F.col("edited")).alias("edited_fingerprint"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("fingerprint")).alias("fingerprint"),
        as_string(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
