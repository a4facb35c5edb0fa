"""PII, line, substring and suffix operators: brute force, edge cases, hot groups."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import hourwatt.llm.substring_dedup as sub
import hourwatt.llm.suffix_dedup as suf
from brute import base_spans, luhn, repeated_bytes, repeated_words, sha
from fixtures import edge_docs, edge_rows, no_docs, prose
from hourwatt.llm.line_dedup import boilerplate_lines, remove_boilerplate
from hourwatt.llm.pii import KINDS, find_spans, luhn_valid, mod97_valid, redacted, span_text
from hourwatt.llm.suffix_merge import decoded, front_coded, merged


def texts_frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def pii_texts():
    rng = random.Random(8)
    parts = ["a@b.c", "a@b.com_x@y.zz", "@", "a.b@c", "x%y@z.de.", "1.2.3.4.5.6.7.8", "256.1.1.1", "0010.1.2.003", "4111-1111 1111 1111", "4111111111111112",
             "+1 (555) 123-4567", "+49 30 1234567", "++1 2", "+1.", " ", "\n", "é", "日", "5", "12 34 56 78 90 12", "ssn 123-45-6789", "123-45-6789", "GB82 WEST 1234 5698 7654 32", "iban DE89370400440532013000"]
    return {i: "".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for i in range(300)} | {900: None, 901: "", 902: "1 " * 3000, 903: "a" * 20000 + "@", 904: "9" * 9000}


def test_base_spans_equal_plain_patterns(spark):
    texts = pii_texts()
    rows = find_spans(texts_frame(spark, texts)).select("doc_id", span_text(F.filter("pii_spans", lambda s: s["order"] < 4)).alias("s")).collect()
    wrong = [r.doc_id for r in rows if r.s != ",".join(f"{k}:{a}:{b}" for a, _, k, b in base_spans(texts[r.doc_id]))]
    assert len(rows) == len(texts) and not wrong


def test_validators_and_context(spark):
    cases = ["4111111111111111", "4111111111111112", "0", ""]
    df = spark.createDataFrame([(c,) for c in cases], "d string")
    assert [r[0] for r in df.select(luhn_valid(F.col("d"))).collect()] == [bool(c) and luhn(c) for c in cases]
    ibans = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32", True), ("GB82 WEST 1234 5698 7654 33", False), ("DE89370400440532013000", True)], "v string, ok boolean")
    assert all(r[0] == r.ok for r in ibans.select(mod97_valid(F.col("v")), "ok").collect())
    near = texts_frame(spark, {1: "my ssn is 123-45-6789", 2: "order 123-45-6789", 3: "card 4111 1111 1111 1111", 4: "4111 1111 1111 1111"})
    found = {r.doc_id: r.pii_spans for r in find_spans(near).collect()}
    assert [KINDS[s.order] for s in found[1]] == ["ssn"] and not found[2]
    assert found[3][0].score > found[4][0].score


def test_redaction(spark):
    found = find_spans(texts_frame(spark, {1: "to a@b.cc and 10.1.1.1!", 2: "none", 3: None, 4: "4111 1111 1111 1111"}))
    got = {r.doc_id: r.t for r in found.select("doc_id", redacted(F.col("text"), F.col("pii_spans")).alias("t")).collect()}
    assert got == {1: "to [EMAIL] and [IP]!", 2: "none", 3: None, 4: "[CARD]"}


def test_line_rules(spark):
    rows = [(i, "common\nown %d\n\ncommon" % i, f"s{i % 12}") for i in range(36)] + [(100, "rare\nrare", "s1"), (101, None, "s2"), (102, "", "s3"), (103, "common", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in remove_boilerplate(docs, min_sites=12).collect()}
    assert out[0].text == "own 0\n" and (out[0].n_lines, out[0].n_removed) == (4, 2)
    assert out[100].text == "rare\nrare" and out[101].text is None and out[102].text == "" and out[103].text == ""
    assert boilerplate_lines(docs, min_sites=13).count() == 1 and boilerplate_lines(docs, min_sites=14).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(n * 1000 + i, f"line {n}", f"site {i}") for n in (380, 399, 400, 420) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = remove_boilerplate(docs, min_sites=400).where("n_removed > 0").select(F.floor(F.col("doc_id") / 1000)).distinct()
    assert sorted(r[0] for r in gone.collect()) == [400, 420]


def repeated_texts():
    rng = random.Random(2)
    passage, other = prose(50, 130), prose(51, 90)
    texts = {i: prose(i, rng.randint(0, 300)) for i in range(12)}
    for i in range(20, 40):
        cut = rng.randint(0, 60)
        texts[i] = prose(100 + i, rng.randint(0, 40)) + " " + passage[cut:] + " " + prose(200 + i, rng.randint(0, 40)) + (" " + other if i % 3 else "")
    texts |= {60: texts[20], 61: texts[20], 62: "z" * 1500, 63: "z" * 700, 64: "ab" * 900, 65: "one two " * 200, 66: None, 67: "", 68: passage + " " + passage}
    return texts


def test_repeated_words(spark):
    texts = repeated_texts()
    rows = sub.remove_repeated_windows(texts_frame(spark, texts)).collect()
    want = repeated_words(texts, sub.WINDOW)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text or "") for r in rows} == want
    assert any(w[1] for w in want.values())


@pytest.mark.parametrize("crowd", [20_000, 0])
def test_repeated_bytes_by_order_and_by_hash(spark, monkeypatch, crowd):
    monkeypatch.setattr(suf, "CROWD", crowd)
    monkeypatch.setattr(suf, "RANGE_ROWS", 40)
    monkeypatch.setattr(suf, "RUN_ROWS", 25)
    texts = repeated_texts()
    rows = suf.remove_repeated_strings(texts_frame(spark, texts)).collect()
    want = repeated_bytes(texts, suf.WINDOW)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.text or b""))) for r in rows} == want


@pytest.mark.parametrize("crowd", [20_000, 0])
def test_planted_passages_go_from_400_bytes_on(spark, monkeypatch, crowd):
    """All have over 50 words and stand in two documents; their bytes decide, and only theirs go."""
    monkeypatch.setattr(suf, "CROWD", crowd)
    texts, want = {i: prose(i, 200) for i in range(20)}, dict.fromkeys(range(20), (0, 0))
    for i, size in enumerate([300, 380, 398, 399, 400, 401, 420, 800]):
        passage = prose(1000 + i, 400)[: size - 1] + "z"
        assert len(passage) == size and len(passage.split()) > 50
        for k, (before, after) in enumerate(["()", "[]"]):
            doc = 100 + 2 * i + k
            texts[doc] = prose(2000 + doc, 100) + before + passage + after + prose(3000 + doc, 100)
            want[doc] = (size, 1) if size >= 400 else (0, 0)
    rows = suf.remove_repeated_strings(texts_frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in rows} == want
    assert all(bytes(r.text).decode() == texts[r.doc_id] for r in rows if not r.n_removed)


def test_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(sub, "SKETCH_BYTES", 1 << 15)  # far too small: nearly every cell is full
    texts = repeated_texts()
    rows = sub.remove_repeated_windows(texts_frame(spark, texts)).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {k: w[1] for k, w in repeated_words(texts, sub.WINDOW).items()}


def test_merge_of_front_coded_runs():
    rng = random.Random(1)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 80))]
        k = rng.randint(1, 7)
        runs = [decoded(front_coded(sorted(strings[i::k]))) for i in range(k)]
        order, shared = merged(runs)
        got = [runs[r][0][i] for r, i in order]
        assert got == sorted(strings)
        for a, b, n in zip(got, got[1:], shared[1:]):
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


@pytest.mark.parametrize("stage, added", [
    (remove_boilerplate, {"n_lines", "n_removed"}), (find_spans, {"pii_spans"}), (sub.remove_repeated_windows, {"n_words", "n_removed"}),
    (suf.remove_repeated_strings, {"n_bytes", "n_removed", "n_spans"}),
])
def test_edge_rows_pass(spark, stage, added):
    out = stage(edge_docs(spark))
    assert set(out.columns) == set(edge_docs(spark).columns) | added and len(out.columns) == len(set(out.columns))
    rows = out.collect()
    assert len(rows) == len(edge_rows()) and Counter(r.doc_id for r in rows) == Counter(r[0] for r in edge_rows())
    assert all(r.key == "k" and r.value == 9 for r in rows if r.doc_id is not None)
    assert all(r.text is None for r in rows if r.doc_id == 0)
    assert stage(no_docs(spark)).count() == 0
