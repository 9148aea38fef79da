"""Byte-level BPE over Arrow batches (the ``tokenizers`` library).

A vocabulary reaches the executors as the text of a ``tokenizers`` JSON (a few MB,
whatever the corpus; it is broadcast).  It comes either from such a JSON file or from a
rank file, whose merges are recovered on the driver.

Encoding works on *chunks*.  No piece of the split pattern begins before white space and
ends after it unless it is white space itself, so a text may be cut wherever white space
follows something else: its pieces are those of its chunks, each a run of white space and
what follows it.  A column of texts is split and its distinct chunks are found by Arrow,
without the marks at their ends, which are pieces of their own after a letter or digit.
Each worker keeps the ids of the chunks that most runs had, hands only unseen ones to the
library, and gathers the ids of all chunks at once.  Only texts with longer runs of white
space are cut by a pattern in Python.

Defined results: null text is the empty text (no ids); repeated rows give repeated
results; other columns are ignored; texts are never cut.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from itertools import repeat
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import begin, caches, in_arrow, slices, whole_text

#: Fixed value: the split pattern that precedes the merges.
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Fixed value: the white space of the split pattern.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks, and ids of chunks, beyond which a worker keeps only the most used half, and the
#: length of the longest of these.
CACHE_CHUNKS = 250_000
CACHE_IDS = 4_000_000
LONG_CHUNK = 64
#: Chunks that the library gets as one text: more of them leave the processor's caches.
TOGETHER = 128
#: Rows, and bytes of text unless one row has more, of a run that is encoded at once.
RUN_ROWS = 2_048
RUN_BYTES = 4 << 20

_RUN_OF_WHITE = f"[{WHITE}][ \n]"
_CHUNK = regex.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_JOINS = f"(?s)^[{WHITE}].*[^{WHITE}]$"
_LETTER_ENDS = r"[\p{L}\p{N}]$"


def byte_to_char() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the other
    bytes for the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, moved = [""] * 256, 256
    for byte in range(256):
        if byte in shown:
            table[byte] = chr(byte)
        else:
            table[byte] = chr(moved)
            moved += 1
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file (base64, blank, rank)."""
    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the merges below the token's own rank leave of it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        best, at = own, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], own)
            if rank < best:
                best, at = rank, i
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1])


def tokenizer_json_from_ranks(path: str, pattern: str = SPLIT_PATTERN) -> str:
    """The rank file as a ``tokenizers`` JSON that gives the same ids."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks, letters = read_ranks(path), byte_to_char()
    spell = lambda token: "".join(letters[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1 and (pair := merge_of(token, ranks)):
            merges.append((spell(pair[0]), spell(pair[1])))
    vocabulary = {spell(token): rank for token, rank in ranks.items()}
    made = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    made.decoder = decoders.ByteLevel()
    return made.to_str()


def tokenizer_json(path: str) -> str:
    """The JSON of a vocabulary file of either kind."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            return file.read()
    return tokenizer_json_from_ranks(path)


def strings(texts: pa.Array) -> list[str]:
    """A column as Python strings, made in one go."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def suffixes(texts: pa.Array, start: np.ndarray) -> pa.Array:
    """What follows the first ``start`` bytes of each text."""
    length = pc.binary_length(texts).to_numpy() - start
    ends = np.cumsum(length)
    begins = np.cumsum(length + start) - length
    data = np.frombuffer("".join(strings(texts)).encode(), np.uint8)
    data = data[np.repeat(begins - (ends - length), length) + np.arange(length.sum())]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data))


class Codec:
    """Encoder and decoder of one vocabulary inside one process.

    ``special`` tells whether the vocabulary's added tokens are recognised in texts.
    """

    def __init__(self, spec: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.spec, self.whole = spec, None
        added = self.tokenizer.get_added_tokens_decoder().values() if special else ()
        self.added = [token.content for token in added]
        self.known: dict[str, int] = {}
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.runs = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        back = {letter: byte for byte, letter in enumerate(byte_to_char())}
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, number in vocabulary.items():
            if all(c in back for c in token):
                self.token_bytes[number] = bytes(back[c] for c in token)
            else:
                self.token_bytes[number] = token.encode()
        self.lengths = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)

    def _add(self, count: np.ndarray, ids: np.ndarray) -> None:
        """More slots, by the numbers of their ids, and all these ids in order.  Those after the
        ones of known chunks last for a run."""
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids])

    def _found(self, chunks: pa.Array) -> np.ndarray:
        """Slots of chunks, -1 for those without one."""
        return np.fromiter(map(self.known.get, strings(chunks), repeat(-1)), np.int64, len(chunks))

    def _gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in some slots, in that order, and how many each has."""
        count = self.count[slots]
        ends = np.cumsum(count)
        places = np.repeat(self.at[slots] - (ends - count), count)
        places += np.arange(len(places))
        return self.ids[places], count

    def _learn(self, fresh: pa.Array) -> np.ndarray:
        """Slots of chunks that the library must encode.  Those with white space before and none
        after go as one text and are told apart by the lengths of their tokens' bytes."""
        joins = pc.match_substring_regex(fresh, _JOINS)
        together, alone = fresh.filter(joins), strings(fresh.filter(pc.invert(joins)))
        names, parts = strings(together), [np.zeros(0, "<u4")]
        for first in range(0, len(names), TOGETHER):
            text = "".join(names[first : first + TOGETHER])
            got = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            parts.append(np.array(got[0].ids, dtype="<u4"))
        ids = np.concatenate(parts)
        ends = np.cumsum(pc.binary_length(together).to_numpy())
        stops = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
        found = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
        lists = [np.array(got.ids, dtype="<u4") for got in found]
        count = np.concatenate([np.diff(stops, prepend=0), np.array([len(x) for x in lists], np.int64)])
        own = np.arange(len(self.at), len(self.at) + len(count))
        self.known.update(zip(names + alone, own.tolist()))
        self._add(count, np.concatenate([ids, *lists]))
        self.runs = np.concatenate([self.runs, np.zeros(len(count), np.int64)])
        return own[np.argsort(np.argsort(pc.invert(joins), kind="stable"))]

    def _slots(self, chunks: pa.Array) -> np.ndarray:
        """Slots of distinct chunks.  One that ends in marks after a letter or digit is made, for
        this run, of the chunk without them and of the marks; what is new goes to the library."""
        bodies = pc.ascii_rtrim(chunks, characters=punctuation)
        longer = pc.not_equal(pc.binary_length(bodies), pc.binary_length(chunks)).to_numpy(zero_copy_only=False)
        marked = longer.copy()
        marked[longer] = pc.match_substring_regex(bodies.filter(pa.array(longer)), _LETTER_ENDS)
        split, whole = pa.array(marked), pa.array(~marked)
        marks = suffixes(chunks.filter(split), pc.binary_length(bodies.filter(split)).to_numpy())
        wanted = pa.concat_arrays([chunks.filter(whole), bodies.filter(split), marks]).dictionary_encode()
        found = self._found(wanted.dictionary)
        new = found < 0
        if new.any():
            found[new] = self._learn(wanted.dictionary.filter(pa.array(new)))
        self.runs[found] += 1
        got = found[wanted.indices.to_numpy()]
        plain, several = int((~marked).sum()), int(marked.sum())
        slots = np.empty(len(chunks), np.int64)
        slots[~marked] = got[:plain]
        slots[marked] = np.arange(len(self.at), len(self.at) + several)
        ids, count = self._gathered(got[plain:].reshape(2, several).T.ravel())
        self._add(count.reshape(-1, 2).sum(1), ids)
        return slots

    def _keep(self) -> None:
        """The slots of a run alone go.  Of too many chunks the half stays that most runs had, of
        equals the latest, without long ones."""
        if len(self.at) > len(self.known):
            self.ids = self.ids[: self.at[len(self.known)]]
            self.at, self.count = self.at[: len(self.known)], self.count[: len(self.known)]
        if len(self.known) > CACHE_CHUNKS or len(self.ids) > CACHE_IDS:
            names = list(self.known)
            short = np.fromiter(map(len, names), np.int64, len(names)) <= LONG_CHUNK
            order = np.argsort(self.runs, kind="stable")[::-1]
            order = order[short[order]][: CACHE_CHUNKS // 2]
            kept = np.sort(order[np.cumsum(self.count[order]) <= CACHE_IDS // 2])
            ids, count = self._gathered(kept)
            self.known = {names[slot]: at for at, slot in enumerate(kept.tolist())}
            self.runs = self.runs[kept] // 2
            self.at, self.count, self.ids = self.at[:0], self.count[:0], self.ids[:0]
            self._add(count, ids)

    def _encode_whole(self, text: str):
        """A text with added tokens, by a tokenizer that is made when the first one comes."""
        from tokenizers import Tokenizer

        if self.whole is None:
            self.whole = Tokenizer.from_str(self.spec)
        return self.whole.encode_batch_fast([text], add_special_tokens=False)[0]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where those of each begin (and end)."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, _RUN_OF_WHITE).to_numpy(zero_copy_only=False)
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        apart = np.flatnonzero(odd | special)
        plain = pc.if_else(pa.array(odd | special), "", texts) if len(apart) else texts
        # Spaces go and the ends of lines stay: a chunk without one had a space before it,
        # unless it is a text's first.
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        found, places = coded.dictionary, coded.indices.to_numpy()
        spaced = pc.if_else(pc.starts_with(found, "\n"), found, pc.binary_join_element_wise(" ", found, ""))
        first = np.unique(places[bounds[:-1]])
        more = [c for i in apart if not special[i] for c in _CHUNK.findall(texts[i].as_py())]
        cut = pa.array(more, pa.string()).dictionary_encode()
        table = pa.concat_arrays([spaced, found.take(pa.array(first)), cut.dictionary]).dictionary_encode()
        slots_of = self._slots(table.dictionary)[table.indices.to_numpy()]
        slots = slots_of[places]
        slots[bounds[:-1]] = slots_of[len(found) + np.searchsorted(first, places[bounds[:-1]])]
        if len(apart):
            parts, used = np.split(slots, bounds[1:-1]), 0
            cut_slots = slots_of[len(found) + len(first) :][cut.indices.to_numpy()]
            lists = []
            for i in apart:
                text = texts[i].as_py()
                if special[i]:
                    parts[i] = np.array([len(self.at) + len(lists)])
                    lists.append(np.array(self._encode_whole(text).ids, dtype="<u4"))
                else:
                    long = len(_CHUNK.findall(text))
                    parts[i] = cut_slots[used : used + long]
                    used += long
            slots = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            if lists:
                self._add(np.array([len(x) for x in lists]), np.concatenate(lists))
        out, count = self._gathered(slots)
        ends = np.concatenate([[0], np.cumsum(count)])
        self._keep()
        return out, ends[bounds]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes that ids stand for, by the byte table alone."""
        numbers = np.frombuffer(ids, dtype="<u4")
        if not len(numbers):
            return b""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[numbers] - (ends - lengths), lengths)
        return self.flat[shift + np.arange(ends[-1])].tobytes()

    def split_characters(self, ids: bytes) -> int:
        """Tokens that begin inside a character (at a UTF-8 continuation byte)."""
        numbers = np.frombuffer(ids, dtype="<u4")
        if not len(numbers):
            return 0
        return int(((self.flat[self.starts[numbers]] & 0xC0) == 0x80).sum())

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that form no character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def encode_with_offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) with offsets in code points.  Tokens that share a split
        character share its offsets."""
        ids = np.frombuffer(self.encode([text])[0], dtype="<u4")
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        char_of = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        begins = ends - self.lengths[ids]
        return [
            (int(i), int(char_of[b]), int(char_of[e - 1]) + 1)
            for i, b, e in zip(ids, begins, ends)
        ]


_CODECS: dict[str, Codec] = {}
caches["bpe"] = _CODECS.clear


def codec_of(spec: str, special: bool = False) -> Codec:
    """This process's codec of a vocabulary; kept between tasks."""
    begin("bpe")
    key = f"{hashlib.md5(spec.encode()).hexdigest()} {special}"
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec, special)
    return _CODECS[key]


def encode_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Encode and decode each text: doc_id, n_tokens, ids_sha256, decoded_sha256,
    n_split_chars (tokens that begin inside a character)."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(vocabulary_path))
    out = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids_sha256", pa.string()),
            ("decoded_sha256", pa.string()),
            ("n_split_chars", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            rows = []
            for part in slices(batch, RUN_ROWS, RUN_BYTES):
                numbers = part.column(0).to_pylist()
                got, bounds = codec.encode_column(part.column(1))
                for doc_id, start, end in zip(numbers, bounds[:-1], bounds[1:]):
                    ids = got[start:end].tobytes()
                    back = codec.decode_bytes(ids)
                    rows.append(
                        (doc_id, len(ids) // 4, digest(ids), digest(back), codec.split_characters(ids))
                    )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 5, out)],
                schema=out,
            )

    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return in_arrow(
        columns,
        run,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split_chars long",
    )


def vocabulary_size(path: str) -> int:
    """Entries of a vocabulary file."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            return len(json.load(file)["model"]["vocab"])
    return len(read_ranks(path))
