import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyread.llm import bpe, chat, fingerprint, html_extract, packing, pii, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
ODD = ["", None, " ", "a", "word " * 3000, "x" * 50_000, "é 한 😀 <|endoftext|>", "a  b\n\n c\t", "same text here", "same text here"]


def documents(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t), "e") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# --- byte-level BPE --------------------------------------------------------------------


def encoding():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.tokenizer_json(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def test_pattern_is_the_public_one():
    assert bpe.SPLIT_PATTERN == public_tokenizers.PATTERN


def test_bpe_agrees_with_tiktoken(codec):
    rng, own = random.Random(3), encoding()
    parts = [" ", "  ", "\n", "\t", "a", "'s", "'ll", "é", "한", "3", "½", "…", ".", "\x85", "́", "😀", "\r\n", "﻿", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4_000)]
    texts += [f"a{chr(i)}b {chr(i)} {chr(i)}1" for i in range(0x20, 0x3000)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert list(np.frombuffer(ids, "<u4")) == own.encode_ordinary(text), text
        assert codec.decode_bytes(ids) == text.encode()


def test_codec_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 40)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, codec = Tokenizer.from_file(path), bpe.Codec(bpe.tokenizer_json(path), special=True)
    rng = random.Random(5)
    parts = ["a", "the", "Then", "x" * 90, "é", "7", ",", ".", "'s", "...", "\n", "  ", "\n\n", " ", " ", " ", "<|endoftext|>"]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) + str(rng.choice(("", rng.randint(0, 99)))) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        for text, ids in zip(texts, codec.encode(texts)):
            assert list(np.frombuffer(ids, "<u4")) == own.encode(text, add_special_tokens=False).ids, text


def test_codec_keeps_what_most_runs_have(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 60)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, codec = Tokenizer.from_file(path), bpe.Codec(bpe.tokenizer_json(path), special=True)
    asked = []

    class Asked:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return own.encode_batch_fast(texts, **options)

    codec.tokenizer = Asked()
    common = "start" + "".join(f" common{chr(97 + i)}" for i in range(20))
    for run in range(30):
        rare = "start" + "".join(f" rare{chr(97 + run)}{chr(97 + i)}{mark}" for i in range(20) for mark in ("", ",", "..."))
        for text in (common, rare):
            ids = np.frombuffer(codec.encode([text])[0], "<u4")
            assert list(ids) == own.encode(text, add_special_tokens=False).ids
        assert len(codec.known) == len(codec.at) == len(codec.count) <= 60 + 22
        assert codec.count.sum() == len(codec.ids)
    assert sum(text.count("common") for text in asked) == 20
    assert sum(text.count("rare") for text in asked) == 30 * 20


def test_offsets_and_split_characters(codec):
    text = "a 한글 😀x"
    found = codec.encode_with_offsets(text)
    assert found[0][1:] == (0, 1) and found[-1][1:] == (len(text) - 1, len(text))
    assert all(0 <= s < e <= len(text) for _, s, e in found)
    ids = codec.encode([text])[0]
    whole = codec.decode(ids)
    assert whole == text and "�" in codec.decode(ids[: 4 * 4]) + "�"
    split = sum((codec.token_bytes[i][0] & 0xC0) == 0x80 for i in struct.unpack(f"<{len(ids) // 4}I", ids))
    assert codec.split_characters(ids) == split


def test_bpe_query(spark):
    docs, own = documents(spark, ODD), encoding()
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect()}
    for i, text in enumerate(ODD):
        ids = own.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_documents(docs.where("1 = 0"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# --- personal data ---------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_base_spans_are_those_of_plain_patterns():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", ".", "-", " ", "1", "12", "255", "256", "1.2.3.4", "+", "(", ")", "4111 1111 1111 1111", "+1 555 123 4567", "x@y.z", "é", "\n", "00", "49927398716", "4012-8888-8888-1881"]
    for _ in range(5_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        base = [f"{k}:{s}:{e}" for s, e, k, _ in pii.find_spans(text) if k in pii.BASE_KINDS]
        assert base == plain_spans(text), text


def test_added_kinds_and_mask():
    text = "My iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789; " + "z" * 50 + " id 887-65-4320"
    found = [(k, text[s:e]) for s, e, k, _ in pii.find_spans(text)]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in found
    assert [v for k, v in found if k == "ssn"] == ["123-45-6789"]
    assert pii.mod_97("DE89370400440532013000") and not pii.mod_97("DE88370400440532013000")
    assert pii.mask("a x@y.zz b", pii.find_spans("a x@y.zz b")) == "a [EMAIL] b"
    assert pii.mask("clean", pii.find_spans("clean")) == "clean"


def test_personal_data_over_documents(spark):
    texts = [*ODD, "mail x@y.zz from 10.0.0.1", "@" * 20_000, "1" * 20_000, "a" * 20_000 + "@"]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    for i, text in enumerate(texts):
        base = plain_spans(text or "") if len(text or "") < 19_000 else [x for x in got[i]["spans"].split(",") if x]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
    masked = pii.mask_personal_data(docs)
    assert masked.columns == docs.columns
    rows = {r["doc_id"]: r for r in masked.collect()}
    assert rows[len(ODD)]["text"] == "mail [EMAIL] from [IP]" and rows[len(ODD)]["n_chars"] == 22
    assert rows[1]["text"] is None


# --- packing ---------------------------------------------------------------------------


def check_packing(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_plan_uses_every_piece_once():
    rng = random.Random(7)
    for capacity in (10, 100, 1024):
        histogram = Counter(rng.randint(1, capacity) for _ in range(500)) + Counter({capacity // 3: 400})
        used = Counter()
        patterns = packing.plan(dict(histogram), capacity)
        for pattern, times in patterns:
            assert sum(pattern) <= capacity and times > 0
            for x in pattern:
                used[x] += times
        assert used == histogram
        least = -(-sum(k * v for k, v in histogram.items()) // capacity)
        assert sum(t for _, t in patterns) <= 1.05 * max(least, sum(v for k, v in histogram.items() if 2 * k > capacity)) + 2
    assert packing.plan({}, 8) == []
    assert packing.SumIndex([0, 0, 0, 1, 2, 0, 0, 0, 0]).complement(8) == (4, 4)
    assert packing.SumIndex([0, 3, 0, 0]).complement(3) == (1, 1, 1)


def test_sum_index_finds_what_there_is():
    rng = random.Random(3)
    for _ in range(30):
        capacity = rng.randint(4, 24)
        available = [0] + [rng.choice((0, 0, 1, 2, 3)) for _ in range(capacity)]
        index = packing.SumIndex(available)
        while any(available):
            gap = rng.randint(1, capacity)
            pieces = [x for x, n in enumerate(available) for _ in range(min(n, 3))]
            there = any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(pieces, k))
            found = index.complement(gap)
            assert (found is not None) == there and (found is None or sum(found) == gap)
            for x in found or (max(pieces),):
                available[x] -= 1
                assert available[x] >= 0


def test_packed_documents(spark):
    texts = [*ODD, *["one two three"] * 60, *["word " * (i % 37) for i in range(80)], "long " * 2_100]
    texts += ["<|endoftext|> a", "b<|endoftext|>", "x  <|endoftext|>\n\n y <|endoftext|"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(documents(spark, texts), path).collect()
    own = Tokenizer.from_file(path)
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert sorted(pieces) == list(range(len(texts)))
    for i, text in enumerate(texts):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        parts = sorted(pieces[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert sum(p["length"] for p in parts) == len(ids) // 4
        assert all(p["length"] == 1024 for p in parts[1:]) and (len(parts) == 1 or len(ids) > 4096)
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, 1024) <= -(-total // 1024) + 2
    assert packing.pack_documents(documents(spark, []), path).count() == 0


# --- chat ------------------------------------------------------------------------------

MESSAGES = "tree_id long, node_id long, parent_id long, role string, text string, score double, x int"


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "a", 0.0, 0), (1, 2, 1, "assistant", "b", 1.0, 0), (1, 3, 1, "assistant", "c", 2.0, 0),
        (1, 4, 3, "user", "d", 0.5, 0), (1, 5, 3, "user", None, 0.5, 0), (2, 7, 8, "user", "x", 0.0, 0),
        (2, 8, 7, "user", "y", 0.0, 0), (3, 1, 99, None, "z", None, 0),
        *[(4, i, i - 1 or None, "user", str(i), 0.0, 0) for i in range(1, 71)],
    ]
    messages = spark.createDataFrame(rows, MESSAGES)
    got = {(r["tree_id"], r["branch"]): r for r in chat.formatted_paths(messages).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (3, 1), (4, 1)]
    assert [got[1, b]["leaf_id"] for b in (1, 2, 3)] == [4, 5, 2]
    assert got[1, 1]["formatted"] == "<s>[INST] user [/INST]a</s>[INST] assistant [/INST]c</s>[INST] user [/INST]d</s>"
    assert got[3, 1]["formatted"] == "<s>[INST]  [/INST]z</s>"
    assert got[4, 1]["formatted"].count("</s>") == 70
    assert chat.formatted_paths(messages.where("1 = 0")).count() == 0
    assert chat.formatted_paths(messages, branches=1).count() == 3


def test_null_and_repeated_rows_of_trees(spark):
    rows = [
        (None, 1, None, "user", "q", 0.0, 0), (None, 2, 1, "assistant", "r", 0.0, 1), (None, 2, 1, "assistant", "r", 0.0, 2),
        (5, None, None, "user", "lost", 0.0, 0), (6, 1, 2, "user", "a", 0.0, 0), (6, 2, 1, "user", "b", 0.0, 0),
        (6, 3, 2, "user", "below a cycle", 0.0, 0), (6, 4, None, "user", "free", 0.0, 0),
    ]
    got = {(r["tree_id"], r["leaf_id"]): r["formatted"] for r in chat.formatted_paths(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert sorted(got, key=str) == [(6, 4), (None, 2)]
    assert got[None, 2] == "<s>[INST] user [/INST]q</s>[INST] assistant [/INST]r</s>"
    said = [(None, 1, "user", "b"), (None, None, "user", "a"), (None, 1, "user", "b"), (3, 0, None, None)]
    talks = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_conversations(talks).collect()}
    assert sorted(out, key=str) == [3, None] and [out[None]["n_turns"], out[3]["n_turns"]] == [3, 1]
    assert out[None]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\nb\nuser\nb\n").hexdigest()


def test_random_trees_equal_brute_force(spark):
    rng, rows = random.Random(9), []
    for tree in range(40):
        count = rng.randint(1, 40)
        for node in range(count):
            parent = rng.choice([None, rng.randrange(count), *([node - 1] * 4)]) if node else None
            rows.append((tree, node, parent, "user", f"{tree}.{node}", 0.0, 0))
    up = {(r[0], r[1]): r[2] for r in rows}
    parents = {(t, p) for (t, _), p in up.items() if p is not None}
    want = {}
    for tree, node in up:
        path, at = [], node
        while at is not None and len(path) <= 40:
            path.append(at)
            at = up.get((tree, at))
        if (tree, node) not in parents and at is None:
            want[tree, node] = path
    got = {}
    for r in chat.root_to_leaf_paths(chat.one_row_each(spark.createDataFrame(rows, MESSAGES))).collect():
        got.setdefault((int(r["tree_id"][1:]), r["leaf_id"]), []).append((r["steps"], r["node_id"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == want
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in got.values())


def test_template_is_reversible(spark):
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "\\\\", " ok ", "\n", "[", "<\\/s>", "[\\INST]", "INST]", "s>"]
    rng = random.Random(11)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    rows = [(i // 4, i % 4, rng.choice(["user", "assistant", "</s>"]), t, 1) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree_id int")
    got = {r["conv_id"]: r for r in chat.format_conversations(table).collect()}
    for conv in range(100):
        mine = [r for r in rows if r[0] == conv]
        said = "".join(f"{role}\n{text}\n" for _, _, role, text, _ in mine)
        under = "".join(text for _, _, role, text, _ in mine if role == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(under.encode()).hexdigest()
        assert got[conv]["n_turns"] == 4 and got[conv]["loss_chars"] == len(under)


# --- fingerprints ----------------------------------------------------------------------


def terms_of(text):
    words = text.split()
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    keys = set(a) | set(b)
    most = sum(max(a[k], b[k]) for k in keys)
    return sum(min(a[k], b[k]) for k in keys) / most if most else 1.0


def test_fingerprints(spark):
    rng = random.Random(13)
    text = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    texts = [*ODD, *[text(rng.randint(200, 600)) for _ in range(60)]]
    texts += [t.replace(" ", " twice twice twice twice twice twice ", 5) for t in texts[-8:]]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(documents(spark, texts)).collect()}
    errors = []
    for i, whole in enumerate(texts):
        whole, after = whole or "", texts[(i + 1) % len(texts)] or ""
        quarter = len(whole) // 4
        edited = whole[: len(whole) - quarter] + after[:quarter]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["n_chars"] == len(whole)
        errors.append(got[i]["near_edited"] - similarity(terms_of(whole), terms_of(edited)))
    assert abs(np.mean(errors)) < 0.06
    assert got[0]["fingerprint"] == got[1]["fingerprint"] == "" and got[0]["near_next"] == 1.0
    assert got[8]["fingerprint"] == got[9]["fingerprint"] and got[8]["near_next"] == 1.0
    assert fingerprint.fingerprint_documents(documents(spark, [])).count() == 0


def test_weights_count(spark):
    rng = random.Random(17)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(400)]
    once, often = " ".join(base), " ".join(base + base[:200] * 3)
    rows = spark.createDataFrame([(once, often)], "a string, b string")
    near = rows.select(fingerprint.likeness(fingerprint.samples(F.col("a")), fingerprint.samples(F.col("b")))).first()[0]
    assert abs(near - similarity(terms_of(once), terms_of(often))) < 0.2


def test_heavy_terms_and_limits(spark):
    """One term that outweighs all others: each document's estimate lies near its similarity
    (by chance within 4 standard deviations), and limits leave out no sample."""
    rng = random.Random(19)
    words = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    rows = []
    for i in range(40):
        heavy = ["again"] * rng.choice([30, 100, 400])
        kept = words(rng.choice([5, 25, 60, 200]))
        shorter = heavy[: len(heavy) // 2] if i % 3 == 0 else heavy
        rows.append((i, " ".join(heavy + kept + words(40)), " ".join(shorter + kept + words(40))))
    rows += [(40, "one", "one two"), (41, "", " "), (42, " ".join(words(3000)), " ".join(words(9) * 6))]
    pairs = spark.createDataFrame(rows, "id long, a string, b string")
    got = pairs.select(
        "id",
        *[fingerprint.samples(F.col(c)).alias(c) for c in "ab"],
        *[fingerprint.samples(F.col(c), limited=False).alias("every_" + c) for c in "ab"],
    )
    got = {r["id"]: r for r in got.withColumn("near", fingerprint.likeness(F.col("a"), F.col("b"))).collect()}
    errors = []
    for i, a, b in rows:
        assert got[i]["a"] == got[i]["every_a"] and got[i]["b"] == got[i]["every_b"]
        assert len(got[i]["a"]) == (64 if a.split() else 0)
        true = similarity(terms_of(a), terms_of(b))
        errors.append(got[i]["near"] - true)
        assert abs(errors[-1]) < 4.5 * (true * (1 - true) / 64) ** 0.5 + 0.001, (i, true, got[i]["near"])
    assert abs(np.mean(errors)) < 0.04


# --- pages -----------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href='/x'>menu item</a></nav>"
    "<div class='ad'>buy now</div><article class='post-%d'><h1>Head &amp; more</h1><p><b>Bold<br>text<p>Second&nbsp; para"
    " %s</p><div class='comments'><p>first!</p></div><form>name<input></form></article><aside>side</aside>"
    "<footer>&copy; all</footer><script>var t='</p>';</script></body>"
)


def test_main_text(spark):
    pages = [(i, f"https://h{i % 2}.example.org/{i}", PAGE % (i, "words " * 20)) for i in range(12)]
    odd = [(100, None, None), (101, "u", ""), (102, "https://x.example.org", "<p>only<p>text"), (103, "bad url", "plain & text"), (104, "https://x.example.org/", "<div>" * 3_000 + "deep" + "</div>" * 10)]
    table = spark.createDataFrame([(*p, "e") for p in pages + odd], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in html_extract.extract_pages(table).collect()}
    words = " ".join(["words"] * 20)
    for i, url, _ in pages:
        assert got[i]["text"] == f"Head & more\n\nBold text\n\nSecond para {words}", got[i]["text"]
        assert got[i]["url"] == url and got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"] == got[101]["text"] == ""
    assert got[102]["text"] == "only\n\ntext" and got[103]["text"] == "plain & text" and got[104]["text"] == "deep"
    assert html_extract.extract_pages(table.where("1 = 0")).count() == 0


ARTICLE = "<p>" + "One sentence of the article, long enough to count. " * 6 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        '<body class="home has-sidebar"><div class="sidebar">no</div>{}</body>',
        '<body class="no-sidebar"><nav>no</nav><div class="post">{}</div></body>',
        '<body><div class="page with-banner"><div class="banner">no</div>{}</div></body>',
        '<body><article class="post tag-social category-search">{}</article><div class="comments">no<p>no</p></div></body>',
        '<body class="sidebar"><main class="search">{}</main><div id="newsletter-signup">no</div></body>',
        '<body><div class="search-results"><article>{}</article></div><div class="ad-slot">no</div></body>',
        "<body><div><p title=it's hidden>no</p>{}</div></body>",
        '<body><ol class="comment-list"><li><article class="comment">no</article></li></ol><div>{}</div></body>',
    ],
)
def test_classes_do_not_delete_articles(page):
    want = " ".join(html_extract._html.unescape(ARTICLE[3:-4]).split())
    assert html_extract.main_text(page.format(ARTICLE)) == want


def test_ids_of_paragraphs_and_headings_are_places():
    page = f'<article><h2 id="side-effects">Side effects</h2><p id="market-share">Shares rose.</p>{ARTICLE}<p title=it\'s>It is.</p></article>'
    text = html_extract.main_text(page)
    assert text.startswith("Side effects\n\nShares rose.\n\n") and text.endswith("\n\nIt is.")


def test_deep_containers_have_paths_of_their_own():
    page = "<div>" * 400 + '<div class="a1">' + ARTICLE + "</div>" + "</div>" * 400
    found = html_extract.candidates(html_extract.parse(page))
    paths = html_extract.generalised(found)
    assert len(set(paths)) == len(found) == 402
    again = html_extract.candidates(html_extract.parse(page.replace("a1", "a27")))
    assert html_extract.generalised(again) == paths


def test_pages_table_equals_plain_extraction(spark):
    """The article of each page by plain patterns, which know the pages' own template."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(table).collect()}
    assert len(got) == table.count()
    for r in table.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<!--.*?-->", "", inner, flags=re.S))
        plain = [re.sub(r"</?b>", "", b.replace("<br>", " ")) for b in blocks]
        texts = [" ".join(html_extract._html.unescape(b).split()) for b in plain]
        assert got[r["page_id"]] == "\n\n".join(t for t in texts if t)


def test_hosts_agree_on_paths(spark):
    body = "<html><body><div class='left-%d'><p>%s</p></div><div class='right'><p>%s</p></div></body></html>"
    pages = [(i, "https://h.example.org/", body % (i, "main " * 300, "side " * 60)) for i in range(9)]
    pages.append((9, "https://h.example.org/", body % (9, "short " * 10, "noise " * 200)))
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    votes = {(r["host"], r["path"]): r["votes"] for r in html_extract.path_votes(table).collect()}
    best = max(votes, key=votes.get)
    assert best == ("h.example.org", "html>body>div.left-#")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(table).collect()}
    assert got[0] == " ".join(["main"] * 300)


def test_warc(spark):
    http = "HTTP/1.1 200 OK\r\nContent-Type: {}\r\n\r\n{}"
    rows = [
        ("urn:a", "http://a/", "2024", http.format("text/html", "<p>x &#233;&#x41;&lt;</p><script>no</script>y"), "sha1:B", "sha1:P", 1),
        ("urn:b", "http://b/", "2024", http.format("image/png", "\x01"), None, None, 1),
        (None, None, None, None, None, None, 1),
        ("urn:c", "http://c/", "2024", http.format("text/plain; charset=x", " a \n\n b "), "d", "e", 1),
        ("urn:d", "http://d/", "2024", "HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\n<p>no", "d", "e", 1),
    ]
    table = spark.createDataFrame(rows, "record_id string, target_uri string, date string, block string, block_digest string, payload_digest string, refers_to int")
    got = {(r["refers_to"], r["warc_type"]): r for r in warc.derive(table).collect()}
    assert got["urn:a", "conversion"]["block"] == "x éA<\ny" and got["urn:c", "conversion"]["block"] == "a\nb"
    assert len(got) == 7 and ("urn:b", "conversion") not in got and ("urn:d", "conversion") not in got
    meta = got["urn:a", "metadata"]
    assert got["urn:a", "conversion"]["record_id"] in meta["block"] and "sha1:P" in meta["block"]
    assert "Content-Type: text/html" in meta["block"] and "WARC-Refers-To: <urn:a>" in meta["header"]
    assert meta["content_length"] == len(meta["block"].encode())
    assert meta["block_digest"] == "sha256:" + hashlib.sha256(meta["block"].encode()).hexdigest()
    assert warc.derive(table.where("1 = 0")).count() == 0


def test_hosts_with_many_templates(spark, monkeypatch):
    """Twenty templates on one host: each page is read from its own template's article, with
    votes broadcast and joined alike."""
    page = (
        "<html><body><div class='intro'>Unmarked teaser %d</div><article class='kind-%s'>"
        "<header><h1>Heading %d</h1></header><p>" + "Long text of the article. " * 20 + "%d</p></article></body></html>"
    )
    kinds = [chr(97 + k) for k in range(20)]
    rows = [(i, "http://hot.example/%d" % i, page % (i, kinds[i % 20], i, i)) for i in range(60)]
    rows += [(0, *rows[0][1:]), (90, None, rows[1][2]), (91, "http://hot.example/x", None), (92, "http://hot.example/y", "<p>alone")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((r["page_id"], r["text"]) for r in html_extract.extract_pages(table).collect())
    said = dict(want)
    for i in range(60):
        assert said[i].startswith(f"Heading {i}\n\nLong text") and said[i].endswith(str(i)) and "teaser" not in said[i]
    assert len(want) == 64 and said[91] == "" and said[92] == "alone"
    monkeypatch.setattr(html_extract, "BROADCAST_PATHS", 0)
    assert sorted((r["page_id"], r["text"]) for r in html_extract.extract_pages(table).collect()) == want
