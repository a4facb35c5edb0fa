"""BPE tree, packing, quality scores and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import hourwatt.llm.pu_quality as pq
from brute import sha
from fixtures import edge_docs, edge_rows, no_docs, prose
import hourwatt.llm.bpe_tree as bpe_tree
from hourwatt.llm.bpe_tree import WordTable, decode, encode, joined, leaves, tokenizer, tree_encoded, trimmed
from hourwatt.llm.q_bpe import vocabulary
from hourwatt.llm.retrieval_packing import WINDOW, Index, fill, ids_crc32, ids_of, likeness_tree, pack

WORDS = vocabulary("word_bpe_49k.json")
PIECES = ["ab", "the", "a", "é", "é", "'", "'s", "''", "!!", "7", "42", " ", "\n", "日本", "ing", "<|endoftext|>", "<|startoftext|>", "😀", "Ω", "İ", "́", "각", "가", "_", "\x1c", "Thhaen", "tion", "\xa0"]


def random_text(rng):
    chosen = rng.sample(PIECES, rng.choice([len(PIECES), 3, 5]))
    if rng.random() < 0.4:
        chosen = [s for s in chosen if s.strip()] or ["ab"]
    return "".join(rng.choice(chosen) for _ in range(rng.randint(1, 300)))


def test_trees_equal_the_library():
    coder, table, rng = tokenizer(WORDS), WordTable(WORDS), random.Random(3)
    for _ in range(400):
        text = random_text(rng)
        parts = leaves(text, rng.choice([7, 20, 64, 150]))
        assert "".join(parts) == text
        nodes = [trimmed(t, np.frombuffer(x, dtype=np.int32)) for t, x in zip(parts, table.encode(parts))]
        assert tree_encoded(coder, nodes).tolist() == coder.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_unsplit_text_joins_locally():
    coder, table = tokenizer(WORDS), WordTable(WORDS)
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000))
    left, right = leaves(text, 10_000)
    a, b = (trimmed(t, np.frombuffer(x, dtype=np.int32)) for t, x in zip((left, right), table.encode([left, right])))
    assert a.whole and joined(coder, a, b).ids.tolist() == coder.encode(text, add_special_tokens=False).ids


def test_long_texts_join_by_their_edges(monkeypatch):
    monkeypatch.setattr(bpe_tree, "EDGE", 100)
    coder, table, rng = tokenizer(WORDS), WordTable(WORDS), random.Random(9)
    for n in range(60):
        text = " ".join("".join(rng.choice("abcdé'!") for _ in range(rng.choice([3, 6, 9, 150]))) for _ in range(400))
        parts = leaves(text, rng.choice([450, 700, 1500]))
        nodes = [trimmed(t, np.frombuffer(x, dtype=np.int32)) for t, x in zip(parts, table.encode(parts))]
        assert tree_encoded(coder, nodes).tolist() == coder.encode(text, add_special_tokens=False).ids
        assert n or any(not x.whole for x in nodes)


def test_edges_without_tokens_or_off_the_grid_join():
    coder, table = tokenizer(WORDS), WordTable(WORDS)
    run = lambda sign, n: prose(1, 900)[:3003] + " " + sign * n + " " + prose(2, 1500)
    texts = [run(sign, n) for sign in "=-_é" for n in (70, 131, 700)] + ["a b " + " " * 30_000 + "c d", " \n" * 12_000, prose(3, 2000) + "\n" * 9000 + prose(4, 2000)]
    rng, offered = random.Random(8), 0
    for text in texts:
        for cut in (3004 + 3, 3004 + 61, len(text) // 2):
            if len(text) > cut + 4 * bpe_tree.EDGE:
                parts = [text[max(0, cut - 5000) : cut], text[cut:]]
                nodes = [trimmed(t, np.frombuffer(x, dtype=np.int32)) for t, x in zip(parts, table.encode(parts))]
                offered += any(not x.whole for x in nodes)
                assert tree_encoded(coder, nodes).tolist() == coder.encode("".join(parts), add_special_tokens=False).ids
    for text in texts + ["".join(rng.choice(["=" * rng.randint(1, 400), " " * rng.randint(1, 300), "ab", "\n"]) for _ in range(300)) for _ in range(30)]:
        parts = leaves(text, 4500)
        nodes = [trimmed(t, np.frombuffer(x, dtype=np.int32)) for t, x in zip(parts, table.encode(parts))]
        assert tree_encoded(coder, nodes).tolist() == coder.encode(text, add_special_tokens=False).ids
    assert offered


def test_encode_and_decode_edge_rows(spark):
    coder = tokenizer(WORDS)
    coded = encode(edge_docs(spark).drop("ids"), WORDS, piece=500)
    rows = decode(coded, WORDS).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in edge_rows())
    texts = {r[0]: r[1] for r in edge_rows()}
    for r in rows:
        if r.doc_id is not None:
            want = coder.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert r.ids == want and r.decoded == coder.decode(want, skip_special_tokens=False)
    assert decode(encode(no_docs(spark), WORDS), WORDS).count() == 0


def test_ranks_give_the_ids_of_the_tokenizers_file():
    coder, rng = tokenizer(vocabulary("byte_bpe_50k.json")), random.Random(5)
    texts = [random_text(rng) for _ in range(400)] + [prose(i, 50) for i in range(10)] + ["a  <|endoftext|> b", "\t\n  x", None, ""]
    got = ids_of(vocabulary("byte_bpe_50k.tiktoken"), texts)
    assert [x.tolist() for x in got] == [coder.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check_packing(rows, texts):
    ids = {k: x for k, x in zip(texts, ids_of(vocabulary("byte_bpe_50k.tiktoken"), list(texts.values())))}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, own in pieces.items():
        if doc is None or sum(r.start == 0 for r in own) > 1:  # repeated rows
            continue
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(ids[doc][at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= WINDOW
    return sequences


def test_packing_covers_every_id_once(spark):
    texts = {i: prose(i, random.Random(i).randint(0, 1500)) for i in range(80)} | {90: None, 91: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = ids_crc32(pack(docs, vocabulary("byte_bpe_50k.tiktoken"), shard_tokens=1 << 16)).collect()
    sequences = check_packing(rows, texts)
    assert {r.doc_id for r in rows} == set(texts)
    assert sum(r.length for r in rows) >= 0.9 * WINDOW * len(sequences)


def test_packing_edge_rows(spark):
    rows = ids_crc32(pack(edge_docs(spark), vocabulary("byte_bpe_50k.tiktoken"))).collect()
    check_packing(rows, {r[0]: r[1] for r in edge_rows()})
    starts = Counter(r.doc_id for r in rows if r.start == 0)
    assert starts == Counter(r[0] for r in edge_rows())
    assert all(r.key == "k" for r in rows if r.doc_id is not None)
    assert pack(no_docs(spark), vocabulary("byte_bpe_50k.tiktoken")).count() == 0


def test_neighbours_share_rare_terms():
    rng = np.random.default_rng(1)
    topic = [rng.integers(1000 * t, 1000 * t + 200, 300).astype(np.uint16) for t in range(1, 9) for _ in range(4)]
    idf = np.ones(50257, dtype=np.float32)
    near = Index(topic, idf, 300.0).neighbours(topic[0], np.ones(len(topic), dtype=bool))
    assert set(near[:4].tolist()) == {0, 1, 2, 3}
    pieces = fill(topic, idf, 300.0, window=1200)
    assert {d for d, _, _, s, _ in pieces if s == 0} == {0, 1, 2, 3}


def test_related_documents_meet_at_every_size(spark):
    """Of pairs on one topic four in five share one of sixteen shards; dealt by hash one in sixteen would."""
    rng, texts = random.Random(6), {}
    for topic in range(60):
        own = prose(1000 + topic, 60).split()
        texts |= {topic + 60 * k: " ".join(rng.choice(own if rng.random() < 0.7 else ["ab", "cd", "ef"]) for _ in range(150)) for k in range(8)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    total = sum(len(x) for x in ids_of(vocabulary("byte_bpe_50k.tiktoken"), list(texts.values())))
    rows = pack(docs, vocabulary("byte_bpe_50k.tiktoken"), shard_tokens=total // 16 + 1).select("doc_id", "sequence_id", "length").collect()
    at, sizes = {r.doc_id: r.sequence_id >> 32 for r in rows}, Counter()
    for r in rows:
        sizes[r.sequence_id >> 32] += r.length
    pairs = [at[t + 60 * a] == at[t + 60 * b] for t in range(60) for a in range(8) for b in range(a)]
    assert sum(pairs) >= 0.8 * len(pairs)
    assert len(sizes) >= 8 and max(sizes.values()) <= total / 4


def test_equal_documents_are_dealt_over_shards():
    rng = np.random.default_rng(4)
    points = np.concatenate([np.repeat(rng.standard_normal((1, 64)), 300, axis=0), rng.standard_normal((300, 64))]).astype(np.float16)
    tree = likeness_tree(points, np.ones(600), 20)
    sizes = np.bincount(tree.shards(points, np.arange(600)), minlength=20)
    assert len(sizes) == 20 and sizes.min() > 0 and sizes.max() <= 90


def junk(seed: int) -> str:
    return " ".join(w.upper() + "!!" for w in prose(seed, 80).split())


@pytest.fixture(scope="module")
def quality_tables(spark):
    docs = [(i, junk(i) if i % 5 == 0 else ". ".join(prose(i * 9 + k, 12).capitalize() for k in range(6)), "en", f"s{i % 20}", 10) for i in range(900)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 900, 2)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_separate_held_out_rows(spark, quality_tables):
    docs, labels = quality_tables
    model = pq.train(docs, labels)
    assert 0.7 <= model.prior <= 0.9  # four in five are good
    rows = pq.score(docs, model).withColumn("held", pq.held_out()).join(labels, "doc_id").where("held").collect()
    assert all((r.score >= pq.KEEP) == bool(r.quality) for r in rows) and len(rows) > 50


def test_held_out_and_negative_labels_are_never_used(spark, quality_tables):
    docs, labels = quality_tables
    swapped = labels.withColumn("quality", F.when(pq.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    positives_only = labels.where("quality = 1")
    one, two, three = (pq.train(docs, x) for x in (labels, swapped, positives_only))
    assert (one.weights == two.weights).all() and (one.weights == three.weights).all()


def test_quality_edge_rows(spark, quality_tables):
    labels = quality_tables[1]
    rows = pq.score(edge_docs(spark), pq.train(quality_tables[0], labels)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert pq.train(no_docs(spark), labels) is None and pq.train(quality_tables[0], labels.limit(0)) is None
    assert pq.score(no_docs(spark), None).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = [b"", b"a", prose(1, 50).encode(), b"A B!! A B!!", b"\n", "é".encode() * 9]
    alone = np.concatenate([pq.features([t]) for t in texts])
    assert np.array_equal(pq.features(texts), alone)


def test_pipeline_stages(spark, tmp_path, quality_tables):
    docs, labels = quality_tables
    good = docs.where("doc_id = 1").first().text
    extra = [(2000, good, "en", "s1", 5), (2001, good + " again", "en", "s2", 5), (2002, ". ".join(prose(7000 + k, 12).capitalize() for k in range(6)) + " x.y@example.org", "en", "s3", 5), (2003, None, None, None, None), (2004, "", "en", "s4", 0)]
    lined = docs.withColumn("text", F.concat("text", F.lit("\nshared footer line")))
    lined.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == docs.columns
        seen[name] = {r.doc_id: r for r in now.collect()}
    ids = {k: set(v) for k, v in seen.items()}
    assert not {i for i in range(0, 900, 5)} & ids["quality"] and {i for i in range(900) if i % 5} <= ids["quality"]
    assert "shared footer line" not in "".join(r.text or "" for r in seen["lines"].values()) and ids["lines"] == ids["quality"]
    assert seen["lines"][1].n_chars == len(good) and 2000 not in ids["near_duplicates"] and 2001 not in ids["near_duplicates"]
    assert "[EMAIL]" in seen["personal_data"][2002].text and ids["personal_data"] == ids["near_duplicates"] == ids["packing"]
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) > 0


@pytest.mark.parametrize("k", range(4))
def test_stages_take_edge_rows_and_none(spark, quality_tables, tmp_path, k):
    quality_tables[1].write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    docs = edge_docs(spark).drop("n_removed")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() > 0
    assert stage(spark, no_docs(spark), str(tmp_path)).count() == 0
