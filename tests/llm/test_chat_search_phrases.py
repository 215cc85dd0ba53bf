"""Chat windows, ranked search and collocations against brute force, on clean and on awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from gablestat.llm import chat_format, collocations, lexical_search
from gablestat.llm.chat_format import chat_windows, escaped, read_back, rendered, turns_of, unescaped

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TURNS = "conv_id long, turn long, role string, text string, conv long, block string, window int"
MARKS = "</s>[INST] ok [/INST]"
PARTS = st.lists(st.sampled_from(["\\", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/TURN]", "\n", "a", "<", "[", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), PARTS), PARTS), max_size=5))
def test_any_turns_are_read_back(turns):
    whole = "".join(rendered(role, text)[0] for role, text in turns)
    assert [(role, text) for role, text, _ in turns_of(whole)] == turns
    for role, text in turns:
        body, start, stop = rendered(role, text)
        assert body[start:stop] == escaped(text) and unescaped(escaped(text)) == text


def conversations():
    rows = [(-1, 0, "user", MARKS), (-1, 1, "assistant", MARKS), (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "a \\</s> b"),
            (2, 0, "user", None), (2, 1, "assistant", ""), (2, None, None, "no turn"), (2, 2, "tool [INST]", "x\n</s>\n"), (None, 0, "user", "nobody"), (None, 1, "assistant", "here"),
            (3, 0, "system", "long " * 300), (3, 1, "user", "q"), (3, 2, "assistant", "word " * 400), (3, 3, "user", "q"), (3, 4, "assistant", "z" * 100),
            (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    rows += [(5, 0, "system", "keep me")] + [(5, i, "assistant" if i % 2 == 0 else "user", f"turn {i} " + "w " * (i % 23)) for i in range(1, 900)]
    return rows


@pytest.fixture(scope="module")
def small_spans():
    before, chat_format.SPAN = chat_format.SPAN, 2
    yield
    chat_format.SPAN = before


def test_windows_hold_every_turn_once_and_stay_in_the_budget(spark, small_spans):
    rows = conversations()
    df = spark.createDataFrame([(*r, 7, "b", 1) for r in rows], TURNS).repartition(5)
    windows = chat_windows(df, RANKS, PATTERN, budget=128, history=32).cache()
    by = defaultdict(list)
    for w in sorted(windows.collect(), key=lambda w: (w.block, w.window)):
        by[w.conv_id].append(w)
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn is None, turn or 0, role or "", text or ""))
    encode = chat_format.encoder(RANKS, PATTERN).encode
    for conv, turns in want.items():
        turns = [(role, text) for _, _, role, text in sorted(turns)]
        got, place = [], 0
        for i, w in enumerate(by[conv]):
            new = list(turns_of(w.text, w.fresh_from))
            all_turns = list(turns_of(w.text))
            old = [(r, t) for r, t, _ in all_turns[: len(all_turns) - len(new)]]
            assert (w.first_turn, w.n_turns) == (place, len(new))
            got += [(role, text) for role, text, _ in new]
            # the mask has the new assistant texts alone
            assert [unescaped(w.text[s.start : s.stop]) for s in w.loss] == [t for r, t, _ in new if r == "assistant"]
            size = sum(len(encode(rendered(r, t)[0])) // 4 for r, t, _ in all_turns)
            assert w.n_tokens == size and w.over_budget == (size > 128) and (size <= 128 or len(new) == 1)
            lead = turns[0][0] == "system" and len(encode(rendered(*turns[0])[0])) // 4 * 4 <= 128
            if lead and i:
                assert old[0] == turns[0]
                old = old[1:]
            # the history is the run of turns just before the window
            assert old == turns[place - len(old) : place]
            assert sum(len(encode(rendered(r, t)[0])) // 4 for r, t in old) <= 32
            place += len(new)
        assert got == turns
    assert len(by[5]) > 50 and {w.block for w in by[5]} > {0, 1, 2}
    assert any(list(turns_of(w.text))[1][:2] != list(turns_of(w.text, w.fresh_from))[0][:2] for w in by[5][1:])


def test_digests_are_those_of_the_turns(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 7, "b", 1) for r in rows], TURNS).repartition(3)
    got = {r.conv_id: r for r in read_back(chat_windows(df, RANKS, PATTERN, budget=256, history=64)).collect()}
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn is None, turn or 0, role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns = sorted(turns)
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars >= sum(len(t[3]) for t in turns)
    empty = spark.createDataFrame([], TURNS)
    assert read_back(chat_windows(empty, RANKS, PATTERN)).count() == 0


DOCS = "doc_id long, text string, lang string, term long, score double, item_id long, n int, phrase string"
TEXTS = [
    (1, "The cat sat on the mat. The cat, the CAT!", "en"), (2, "cat", "en"), (3, None, "en"), (4, "", None), (5, "... !! --", "en"), (6, "Élan élan ÉLAN x2 cat-mat", "fr"),
    (7, "the the the the", None), (7, "the the the the", None), (None, "the cat", "en"), (8, "the cat", "en"), (9, "concatenate catalog the1 1the", "de"),
    (10, "mat " * 30000 + "cat", "en"), (11, "ｃａｔ 中文 cat中文", "zh"), (12, "the cat sat on the mat " * 40, "en"), (13, "a b a b a b c. a b\ta b, b a" * 9, "und"),
]
ITEMS = [(1, "the cat"), (2, "Cat cat CAT mat"), (3, "élan 中文"), (4, None), (5, "..."), (6, "absent words"), (7, "the"), (7, "mat"), (None, "cat")]


def brute_search(docs, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(d, Counter(terms(t))) for d, t, _ in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    joined = defaultdict(Counter)
    for i, t in items:
        joined[i].update(terms(t))
    out = set()
    for i, query in joined.items():
        scored = []
        for d, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in query.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out |= {(i, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:top], 1)}
    return out


@pytest.mark.parametrize("block", [1 << 20, 12])
@pytest.mark.parametrize("top", [20, 3])
def test_search_is_that_of_counting(spark, block, top):
    docs = spark.createDataFrame([(d, t, g, 1, 0.5, 2, 3, "p") for d, t, g in TEXTS], DOCS).repartition(4)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {tuple(r) for r in lexical_search.search(docs, items, top, block=block).collect()}
    assert got == brute_search(TEXTS, ITEMS, top)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(docs, items).count() == 0
    some = spark.createDataFrame([(1, "cat", "en", 1, 0.5, 2, 3, "p")], DOCS)
    assert lexical_search.search(some, items.limit(0)).count() == 0


def brute_collocations(docs, longest, least, pct=50):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in chosen.items():
            if any(len(q) > len(p) and 100 * b >= pct * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in chosen.items()):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            out[lang, " ".join(p)] = (a, counts[p[:k]], counts[p[k:]], total[lang], score)
    return out


@pytest.mark.parametrize("longest", [2, 3, 4])
@pytest.mark.parametrize("hot", [2000, 5])
def test_collocations_are_those_of_counting(spark, monkeypatch, longest, hot):
    monkeypatch.setattr(collocations, "CHUNK", 200)
    monkeypatch.setattr(collocations, "HOT", hot)
    docs = spark.createDataFrame([(d, t, g, 1, 0.5, 2, 3, "p") for d, t, g in TEXTS], DOCS).repartition(4)
    rows = collocations.top_collocations(docs, longest=longest, min_count=2).collect()
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in rows}
    assert got == brute_collocations(TEXTS, longest, 2)
    for lang in {r.lang for r in rows}:
        own = sorted((r for r in rows if r.lang == lang), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1))
        assert own == sorted(own, key=lambda r: (-r.score, -r.a, r.phrase.encode()))


def test_stripes_take_little_more_room_than_their_words(spark):
    text = " ".join(f"word{i}" for i in range(20_000))
    docs = spark.createDataFrame([(text, "en")], "text string, lang string")
    local = docs.mapInArrow(collocations._stripes(1, spark.sparkContext.broadcast({}), None), "lang string, prefix string, segment int, next string, counts array<int>")
    # words are bytes one after the other; as arrays of texts each took 16 bytes more
    assert local.agg(F.sum(F.octet_length("next"))).first()[0] <= 2 * len(text)
    assert local.select("lang", "prefix", F.explode(F.split("next", " ")).alias("next")).where("next <> ''").count() == 19_999


def test_counts_past_64_bits_are_exact(spark):
    a, left, right = 900_000_000_000_001, 950_000_000_000_003, 999_999_999_999_989
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._ratio(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 10**6 * a * a // (left * right)


def test_collocations_of_an_empty_table(spark):
    assert collocations.top_collocations(spark.createDataFrame([], DOCS)).count() == 0
