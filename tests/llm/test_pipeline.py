import random
import struct
import zlib

import public_tokenizers
import tokenizers

import corpus_pipeline
from tallyread.llm import jaccard_join, pii, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "packing"]
    plain = {r["doc_id"]: r for r in docs.collect()}
    given = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        if name == "toxicity":
            assert out.columns == COLUMNS
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            scores = toxicity.score_documents(docs, toxicity.fitted(docs, labels)).collect()
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in scores if not r["predicted"]}
        elif name == "near_duplicates":
            classes = jaccard_join.jaccard_join(given).collect()
            assert {r["doc_id"] for r in rows} == {r["class_id"] for r in classes}
        elif name == "personal_data":
            for r in rows:
                text = plain[r["doc_id"]]["text"]
                assert r["text"] == pii.mask(text, pii.find_spans(text)) and r["n_chars"] == len(r["text"])
        else:
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in given.collect()}
            assert max(r["offset"] + r["length"] for r in rows) <= 1024
        given = out


def _grams(text):
    words = (text or "").split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_near_duplicates_and_packing_by_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    far = [w if i % 20 else "other" for i, w in enumerate(words)]
    texts = {9: " ".join(words), 4: " ".join(words[:-1] + ["last"]), 7: " ".join(words), 3: " ".join(far), 1: None, 2: ""}
    texts |= {8: "short text", 6: "short text", 5: "é <|endoftext|> " + "long " * 3_000}
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()] + [(3, texts[3], "en", "s", len(texts[3]))]
    docs = spark.createDataFrame(rows, schema)

    kept = corpus_pipeline.remove_near_duplicates(spark, docs, "")
    root = {k: k for k in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                x, y = _grams(texts[a]), _grams(texts[b])
                if a != b and x and y and len(x & y) >= 0.8 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    expected = sorted(r[0] for r in rows if root[r[0]] == r[0])
    assert sorted(r["doc_id"] for r in kept.collect()) == expected == [1, 2, 3, 3, 4, 5, 6]

    codec = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    places = corpus_pipeline.pack(spark, kept.distinct(), "").collect()
    for k in set(expected):
        ids = codec.encode(texts[k] or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted((r for r in places if r["doc_id"] == k), key=lambda r: r["piece"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)
    ends = {}
    for r in sorted(places, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024
