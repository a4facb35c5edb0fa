"""Conversation repair, token counts and phrase mining against plain versions."""

import hashlib
import random
import re
import sys
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from fixtures import edge_docs, edge_rows, no_docs, prose
from hourwatt.llm import conversation_repair as R
from hourwatt.llm import phrase_mining as P
from hourwatt.llm import token_transducer as T
from hourwatt.llm.bpe_tree import tokenizer
from hourwatt.llm.q_bpe import vocabulary


# --- conversation repair -------------------------------------------------------------------------------------------
def plain_audit(rows):
    """(cost, audit) by trying all edits, keeping the least pair per state; rows are (initial, lost, cut)."""
    follow = {0: "su", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}

    def inserted(best):
        for _ in range(3):
            for s, (cost, audit) in list(best.items()):
                t = to[[x for x in follow[s] if x != "s"][0]]
                best[t] = min(best.get(t, (9**9, "")), (cost + 2, audit + "I"))
        return best

    best = inserted({0: (0, "")})
    for initial, lost, cut in rows:
        after = {}
        for s, (cost, audit) in best.items():
            ways = [(s, cost + 3, "D")]
            if not lost:
                ways += [(to[initial], cost + cut, "K")] if initial in follow[s] and initial else []
                ways += [(to[x], cost + 2 + cut, "R") for x in follow[s] if x != "s"]
            for t, c, edit in ways:
                after[t] = min(after.get(t, (9**9, "")), (c, audit + edit))
        best = inserted(after)
    return min(best[s] for s in (0, 3) if s in best)


def plain_text(audit, rows):
    state, out, left = "", [], iter(rows)
    for edit in audit:
        role, text = next(left) if edit != "I" else (None, "")
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == "u" else "user"
        state = role[:1]
        out.append(f"{role}:{text}")
    return "\n".join(out)


def plain_repair(rows):
    """All contract columns of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, facts, n = set(), [], Counter()
    for _, role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else None
        seen.add((role, text))
        n[fault] += 1
        facts.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
    cost, audit = plain_audit(facts)
    text = plain_text(audit, [r[1:] for r in rows])
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def some_rows(rng, n):
    return [R.Row(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.choice([R.SOUND, R.SOUND, R.SOUND, R.CUT, R.LOST])) for _ in range(n)]


def test_audit_equals_plain_version_at_any_leaf_size(monkeypatch):
    rng = random.Random(5)
    for leaf in (1, 2, 32):
        monkeypatch.setattr(R, "LEAF", leaf)
        for _ in range(400):
            rows = some_rows(rng, rng.randint(0, 14))
            wanted = plain_audit([(r.initial, r.fault == R.LOST, int(r.fault == R.CUT)) for r in rows])
            assert R.least_audit(rows)[:2] == wanted


def test_blocks_chain_to_the_same_audit():
    rng = random.Random(6)
    for _ in range(300):
        rows = some_rows(rng, rng.randint(2, 16))
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randint(1, 4))))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        blocks = [{"routes": R._solved_block(p, False, i == 0, i == len(parts) - 1)} for i, p in enumerate(parts)]
        cost, audit, steps = R.chain(blocks)
        assert (cost, audit) == R.least_audit(rows)[:2]
        assert "".join(part for _, part in steps) == audit


def repaired(spark, rows):
    schema = "conv_id long, turn long, role string, text string, place int, block int, audit int"
    done = R.repair(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema))
    digest = {r.conv: r.sha256 for r in R.digests(done.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest.get(r.conv, empty)) for r in done.conversations.collect()}


def test_conversations_long_and_odd(spark):
    rng = random.Random(7)
    texts = ["Yes.", "No!", "cut off", "", " \n\t", "É?", "long " * 2000 + ".", " ", "Ends. \n", None]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for _ in range(120)]
    # One conversation with most rows lies in several blocks; some of its rows are alike in everything.
    rows += [(9, t // 2, rng.choice(["user", "assistant"]), rng.choice([f"{t}.", "same.", "open"])) for t in range(1500)]
    rows += [(9, 4000, "user", "again.")] * 400 + [(10, None, "user", "one.")]
    by_conv = {}
    for conv, *rest in rows:
        by_conv.setdefault(conv, []).append(rest)
    assert repaired(spark, rows) == {conv: plain_repair(r) for conv, r in by_conv.items()}


def test_long_conversations_are_spread(spark):
    rows = spark.range(4000).selectExpr("cast(1 as long) conv_id", "id turn", "'user' role", "'x.' text")
    sizes = [r["count"] for r in R.blocks(rows).groupBy("block").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 2500


def test_no_conversations(spark):
    assert repaired(spark, []) == {}


# --- token counts --------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def counting():
    path = vocabulary("byte_bpe_50k.json")
    return path, T._classes(T.code_point_classes(path)), T.machine(path)


SIGNS = ["'", "'s", "'re", "'ve", "'ll", "'l", "'r", " ", "  ", "\n", "\t", " a", "re", "the", "é", "日本", "1", "²", "!", "...", "<|endoftext|>", "x" * 30, "m", "t", "s", "e", "v", "\x85", " ", "😀", "ا"]


def test_counts_equal_the_library(counting):
    path, classes, count = counting
    rng = random.Random(1)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    wanted = [len(e.ids) for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    assert T._counted(texts, "<|endoftext|>", classes, count).tolist() == wanted
    for slab in (1, 2, 3, 50):
        for text, n in list(zip(texts, wanted))[:600]:
            if "<|" not in text:
                assert T.count_long(text, classes, count, slab) == n


def test_every_code_point(counting):
    path, classes, count = counting
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    random.Random(2).shuffle(signs)
    whole = "".join(signs)
    assert T._counted([whole], "<|endoftext|>", classes, count).tolist() == [len(tokenizer(path).encode(whole, add_special_tokens=False).ids)]


def test_scan_multiplies_all_maps_before(counting):
    rng = random.Random(3)
    _, _, maps, _, product = T.word_machine()
    import numpy as np

    numbers = np.array([rng.randrange(len(maps)) for _ in range(77)])
    got, wanted = T.prefix_products(numbers), [numbers[0]]
    for n in numbers[1:]:
        wanted.append(product[wanted[-1], n])
    assert got.tolist() == [int(w) for w in wanted]


def test_states_made_anew_count_the_same(counting, monkeypatch):
    path, classes, _ = counting
    monkeypatch.setattr(T, "MAX_STATES", 40)
    monkeypatch.setattr(T, "TABLE_WORDS", 10)
    text = prose(8, 2000) + "x" * 3000
    assert T.count_long(text, classes, T.TokenMachine(path), 500) == len(tokenizer(path).encode(text, add_special_tokens=False).ids)


def test_count_rows(spark, counting):
    path = counting[0]
    docs = edge_docs(spark).withColumnRenamed("n", "N_TOKENS")
    rows = T.count_tokens(docs, path).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(tokenizer(path).encode(r.text or "", add_special_tokens=False).ids))
    assert T.count_tokens(no_docs(spark), path).count() == 0


def test_count_query(spark):
    from hourwatt.llm.queries import QUERIES
    from test_corpus_queries import SF_DIR, documents

    library, texts = tokenizer(vocabulary("byte_bpe_50k.json")), documents(spark)
    for r in QUERIES["op12_token_counts"](spark, SF_DIR).collect():
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 1024)


# --- phrase mining -------------------------------------------------------------------------------------------------
def plain_phrases(rows):
    found = Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in range(1, 5):
                found.update(("und" if lang is None else lang, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return found


def phrase_rows():
    rng = random.Random(4)
    shared = " ".join(rng.choice("a b c d e".split()) for _ in range(400))
    texts = [shared, shared.upper() + ".", "x " + shared, "", None, "....", " \t ", "Ä b, ä B\x0bÄ b", "the the the the the the", "a b a b", "a.b.c.d.e " * 50]
    texts += [" ".join(rng.choice("of in the a to was is it".split()) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    rows = [(rng.choice(["en", "de", None]), t) for t in texts]
    return rows + rows[:3] + [("fr", "one word")]


@pytest.mark.parametrize("least", [1, 7])
def test_every_phrase_is_counted_once(spark, monkeypatch, least):
    monkeypatch.setattr(P, "PERIOD", 5)
    monkeypatch.setattr(P, "SLAB_WORDS", 700)
    rows = phrase_rows()
    docs = spark.createDataFrame([(lang, t, 1, 2) for lang, t in rows], "lang string, text string, n int, phrase int")
    found = {(r.lang, r.phrase): r.n for r in P.frequent_phrases(docs, least).collect()}
    wanted = plain_phrases(rows)
    words = Counter()
    for (lang, phrase), n in wanted.items():
        words[lang, ""] += n * (" " not in phrase)
    assert found == {k: n for k, n in wanted.items() if n >= least} | dict(words)


def test_no_chunk_begins_another(spark):
    chunks = {c for _, t in phrase_rows() for c in P.chunks_of(P.words_of(t or ""))}
    assert len(chunks) > 20
    ordered = sorted(chunks)
    assert not any(b.startswith(a + b" ") for a, b in zip(ordered, ordered[1:]))


def test_equal_passages_share_chunks():
    shared = prose(3, 3000)
    one, two = (set(P.chunks_of(P.words_of(x + " " + shared))) for x in (prose(1, 500), prose(2, 700)))
    assert len(one & two) > 0.8 * len(set(P.chunks_of(P.words_of(shared))))


def test_no_phrases(spark):
    assert P.collocations(no_docs(spark), 1).count() == 0
    assert P.collocations(edge_docs(spark), 3).count() > 0


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 4)])
def test_phrases_are_counted_by_columns_with_exact_weights(monkeypatch, sizes):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    chunks = [" ".join([*(rng.choice([*words, "."]) for _ in range(50)), ".", ".", "."]) for _ in range(300)]
    langs, times = [rng.choice(["de", "en", "und"]) for _ in chunks], [rng.choice([1, 7, (1 << 49) + 1]) for _ in chunks]
    batches = [pa.RecordBatch.from_arrays([pa.array(langs[a:b]), pa.array(chunks[a:b]), pa.array(times[a:b])], ["lang", "chunk", "times"]) for a, b in ((0, 120), (120, 300))]
    everything, steps = SimpleNamespace(value=np.full(1 << 12, 255, np.uint8)), 0

    def step(*_):
        nonlocal steps
        steps += 1

    sys.setprofile(step)
    found = list(P._phrases(iter(batches), sizes, everything))
    sys.setprofile(None)
    if sizes != (1,):
        assert steps < sum(b.num_rows for b in found) / 2, "Python runs for every phrase"
    monkeypatch.setattr(P, "SLAB_WORDS", 2000)
    wanted = Counter()
    for lang, chunk, n in zip(langs, chunks, times):
        for phrase, k in plain_phrases([(lang, chunk)]).items():
            if phrase[1].count(" ") + 1 in sizes:
                wanted[phrase] += k * n
            if sizes == (1,):
                wanted[lang, ""] += k * n * (" " not in phrase[1])
    for out in (found, list(P._phrases(iter(batches), sizes, everything))):
        counts = Counter()
        for lang, phrase, n in (r.values() for b in out for r in b.to_pylist()):
            counts[lang, phrase] += n
        assert counts == wanted
