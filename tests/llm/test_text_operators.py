"""Text operators against brute force, on clean and on awkward rows."""

import base64
import bisect
import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
import tiktoken
from gablestat.llm import bpe, packing, substring_dedup
from gablestat.llm.exact_dedup import duplicate_groups
from gablestat.llm.graph import components
from gablestat.llm.jaccard_join import near_duplicates
from gablestat.llm.language_id import LanguageId
from gablestat.llm.quality_rules import ablations, ledger
from gablestat.llm.substring_dedup import compact_windows, passages, repeated_passages, without_passages
from gablestat.llm.toxicity import BlockMaxIndex, ToxicityScorer
from gablestat.llm.url_filter import UrlFilter
from gablestat.llm.weak_quality import LABELLERS, WeakQuality, estimate
from gablestat.llm.words import Words, mix
from gablestat.session import recording

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, unit string, level int, score double, n_words int, host string"
SPACES = r"[\x20\x09-\x0D]"


def words_of(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(n)]


LONG = " ".join(words_of(9000, 1))
BASE = words_of(400, 2)
NEAR = BASE[:200] + ["changed"] + BASE[201:]
TEXTS = {
    1: None, 2: "", 3: " \t\n", 4: "one", 5: "One two", 6: " one\ttwo", 7: "a b c d e", 8: "é è  ü — ß 中文", 9: "12 34 !! ??",
    10: LONG, 11: LONG.replace(" ", "\n"), 12: LONG + " x", 13: " ".join(BASE), 14: " ".join(NEAR), 15: " ".join(BASE[:120] + words_of(300, 3)),
    16: " ".join(words_of(200, 4) + BASE[300:360]), 17: "x" * 5000, 18: "same line\n" * 40, 19: " ".join(BASE).upper(), 20: "one",
}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, t, "en", "u", 1, 0.5, 3, "h") for k, t in TEXTS.items()]
    data += [(13, TEXTS[13], "en", "u", 1, 0.5, 3, "h"), (None, "one", None, None, None, None, None, None), (None, "no id here", None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_shingles_are_those_of_python():
    texts = [t or "" for t in TEXTS.values()]
    column = pa.array(texts)
    _, offsets, data = column.buffers()
    own = Words(np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int32)[: len(texts) + 1].astype(np.int64))
    plain = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    assert np.diff(own.first).tolist() == [len(p) for p in plain]
    by_hash = defaultdict(set)
    for h, w in zip(own.hash.tolist(), [w for p in plain for w in p]):
        by_hash[h].add(w)
    assert all(len(v) == 1 for v in by_hash.values())
    assert len(by_hash) == len({w for p in plain for w in p})
    _, first = own.shingles()
    assert np.diff(first).tolist() == [max(len(p) - 4, min(len(p), 1)) for p in plain]


def test_ledger_measures_awkward_rows(rows, empty):
    got = {r.doc_id: r for r in ledger(rows).collect() if r.doc_id is not None}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0
    assert got[10].n_words == 9000 and got[10].failed_bits == 0
    assert got[18].n_dup_lines == 39 and got[18].n_repeat_words == 80
    assert got[9].n_exclaims == 2 and got[17].failed_bits & 1
    assert {"lang", "unit", "host"} <= set(ledger(rows).columns)
    assert ledger(empty).count() == 0
    assert {r.rule: r.failed for r in ablations(ledger(empty), "full-1").collect()}["shouting"] == 0


def test_ablations_count_what_each_rule_decides(rows):
    stored = ledger(rows)
    bits = [r.failed_bits for r in stored.collect()]
    for r in ablations(stored, "base-1").collect():
        bit = {"too_few_words": 1, "repeated_words": 2}[r.rule]
        assert r.failed == sum(bool(b & bit) for b in bits)
        assert r.only_this == sum(b & 3 == bit for b in bits)
        assert r.kept_without == sum(not b & 3 & ~bit for b in bits)


def test_only_blocks_whose_hash_repeats_are_named(spark, tmp_path, monkeypatch):
    from gablestat.llm import exact_dedup

    path, seen = str(tmp_path / "docs"), []
    spark.createDataFrame([(i, " ".join(words_of(30, 70 + i % 40))) for i in range(42)], "doc_id long, text string").write.parquet(path)
    numbered = exact_dedup._numbered
    monkeypatch.setattr(exact_dedup, "_numbered", lambda keys: seen.append(keys) or numbered(keys))
    groups = duplicate_groups(spark.read.parquet(path))
    assert {(r.doc_id, r.keep_id) for r in groups.where("group_size > 1").collect()} == {(0, 0), (40, 0), (1, 1), (41, 1)}
    # names are given from a table of the four rows that may be equal to others, not from all texts
    assert not any(path in f for f in seen[0].inputFiles())
    assert spark.read.parquet(*seen[0].inputFiles()).count() == 4


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_block_names_find_equal_texts(rows, empty, block):
    got = duplicate_groups(rows, block=block).collect()
    source = [(r.doc_id, r.text or "") for r in rows.collect()]
    groups = defaultdict(list)
    for k, t in source:
        groups[re.sub(SPACES, "", t)].append((-len(t), k is None, k))
    assert len(got) == len(source)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): sorted(v, key=lambda x: (x[0], x[1], x[2] or 0)) for t, v in groups.items()}
    for r in got:
        group = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (group[0][2], len(group))
    assert {r.doc_id for r in got if r.kept and r.doc_id is not None} == {v[0][2] for v in by_sha.values()} - {None}
    assert duplicate_groups(empty).count() == 0


def test_ids_are_those_of_the_library(rows, empty):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(rows, RANKS, PATTERN, segment=1000), RANKS, PATTERN).collect()
    want = sorted((str(r.doc_id), library.encode_ordinary(r.text or "")) for r in rows.collect())
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert sorted((str(r.doc_id), r.decoded.decode()) for r in got) == sorted((str(r.doc_id), r.text or "") for r in rows.collect())
    assert bpe.encode(empty, RANKS, PATTERN).count() == 0


def test_halving_anywhere_gives_the_same_ids(monkeypatch):
    own = bpe.Encoder(RANKS, PATTERN)
    rng = np.random.default_rng(5)
    signs = list("ab1 \n\t's!  , 　字é")
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(3000)]
    for leaf in (1, 7):
        monkeypatch.setattr(bpe, "LEAF", leaf)
        for t in texts:
            assert np.frombuffer(own.encode(t), "<u4").tolist() == own.coding.encode_ordinary(t)
    special = bpe.Encoder(RANKS, PATTERN, (("<|endoftext|>", 50256),))
    texts = [t + "<|endoftext|>" * (i % 5 == 0) + t[::-1] for i, t in enumerate(texts)]
    for row, flat, offs in bpe.bulk(pa.array(texts), special):
        for i in range(len(offs) - 1):
            assert flat[offs[i] : offs[i + 1]].tolist() == special.whole(texts[row + i])


@pytest.mark.parametrize("how", [{}, {"by": "dot"}, {"weights": (1.0, 0.5, 0.5)}, {"documents": 3}, {"attention": 50_000}])
def test_plan_packs_everything_within_all_capacities(how):
    rng = np.random.default_rng(3)
    counts = {int(k): int(n) for k, n in zip(range(1, 201, 3), rng.integers(1, 900, 67))}
    kinds = packing.plan(counts, 256, **how)
    packed = defaultdict(int)
    for n, runs in kinds:
        assert sum(a * b for a, b in runs) <= 256 and sum(b for _, b in runs) <= how.get("documents", 256)
        assert sum(a * a * b for a, b in runs) <= how.get("attention", 256 * 256)
        for a, b in runs:
            packed[a] += n * b
    assert dict(packed) == counts
    if not how:
        left = []  # best-fit decreasing, one piece after another
        for a in sorted((a for a, n in counts.items() for _ in range(n)), reverse=True):
            at = bisect.bisect_left(left, a)
            bisect.insort(left, (left.pop(at) if at < len(left) else 256) - a)
        assert sum(n for n, _ in kinds) <= len(left)


def test_pieces_and_places(rows, empty):
    cut = packing.pieces(rows, RANKS, PATTERN, with_ids=True)
    got = packing.pack(cut).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    own = bpe.Encoder(RANKS, PATTERN)
    for k, t in TEXTS.items():
        if k != 13:
            parts = sorted(by_doc[k], key=lambda r: r.piece)
            assert [x for r in parts for x in r.ids] == own.coding.encode_ordinary(t or "") + [0]
            assert all(r.length == 2048 for r in parts[1:])
    assert packing.pack(packing.pieces(empty, RANKS, PATTERN)).count() == 0


def brute_components(source, percent=80):
    sets = []
    for k, t in source:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(source)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(source):
        r = find(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(k, least[r])
    return sorted((str(k), len(s), str(least[find(i)])) for i, ((k, _), s) in enumerate(zip(source, sets)))


def test_jaccard_components_are_those_of_all_pairs(rows, empty):
    got = near_duplicates(rows).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components([(r.doc_id, r.text) for r in rows.collect()])
    assert near_duplicates(empty).count() == 0


def test_jaccard_finds_chains_near_the_threshold(spark):
    rng = np.random.default_rng(8)
    source = []
    for g in range(6):
        words = words_of(int(rng.integers(8, 160)), 100 + g)
        for i in range(25):
            source.append((1000 * g + i, " ".join(words)))
            for at in rng.integers(0, len(words), 1 + len(words) // 60):
                words[at] = "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    docs = spark.createDataFrame(source, "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(source)


def test_first_shingles_go_once_tiles_and_signatures_are_stored(spark):
    a = words_of(80, 90)
    docs = spark.createDataFrame([(i, " ".join([*a, f"w{i}"])) for i in range(4)] + [(9, " ".join(words_of(80, 91)))], "doc_id long, text string")
    with recording() as paths:
        got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
    kept = [spark.read.parquet(p).columns for p in paths if os.path.exists(p.removeprefix("file:"))]
    assert kept and not any({"rare", "frequent"} & set(c) for c in kept)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_compact_windows_are_those_of_every_run():
    rng = np.random.default_rng(4)
    hashes = mix(rng.integers(0, 40, 120).astype(np.uint64) * np.uint64(7919) + np.arange(120, dtype=np.uint64) // np.uint64(60))
    bounds, width = np.array([0, 50, 53, 120]), 9
    text, own, first, centre, last = compact_windows(hashes, bounds, width, 1)
    for a, b in zip(bounds[:-1], bounds[1:]):
        for i in range(a, b - width + 1):
            inside = [(own[w], centre[w]) for w in range(len(own)) if first[w] <= i and i + width - 1 <= last[w] and i <= centre[w] < i + width]
            assert len(inside) == 1 and bounds[text[[w for w in range(len(own)) if centre[w] == inside[0][1]][0]]] == a


def test_repeated_passages_and_cuts(rows, empty):
    got = [(r.doc_id, r.source_id, r.start, r.stop) for r in repeated_passages(rows).collect()]
    spans = defaultdict(set)
    for d, s, a, b in got:
        assert s < d
        spans[d].update(range(a, b))
    assert spans[11] >= set(range(9000)) and spans[12] >= set(range(9000))
    assert spans[15] == set(range(120)) and spans[16] == set(range(200, 260))
    assert not {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 17, 18} & set(spans)
    left = {r.doc_id: r.text for r in without_passages(rows, repeated_passages(rows)).collect() if r.doc_id}
    assert left[16].split() == TEXTS[16].split()[:200] and left[15].split() == TEXTS[15].split()[120:]
    assert left[10] == LONG and left[1] is None
    assert repeated_passages(empty).count() == 0 and without_passages(empty, repeated_passages(empty)).count() == 0


def test_passages_lie_in_one_run_of_the_other_text():
    a, b, own = (mix(np.arange(i, i + 100, dtype=np.uint64)) for i in (1000, 2000, 3000))
    x = np.concatenate([own[:50], a[:23], own[50:54], b[:23], own[54:]])
    for gap in (30, 60, 500):
        y = np.concatenate([a[:23], mix(np.arange(5000, 5000 + gap, dtype=np.uint64)), b[:23]])
        assert passages(x, y, [-50, gap + 23 - 77], 46) == []
    for gap, found in ((4, True), (5, True), (20, False)):  # at most one word put in between
        y = np.concatenate([a[:23], mix(np.arange(5000, 5000 + gap, dtype=np.uint64)), b[:23]])
        assert bool(passages(x, y, [-50, gap + 23 - 77], 46)) == found
    assert passages(a[:80], np.concatenate([own, a[10:90]]), [90], 46) == [(10, 80)]


def test_one_word_again_and_again_is_found_whole_by_any_shift():
    v, own = mix(np.arange(1, 2, dtype=np.uint64)), mix(np.arange(100, 200, dtype=np.uint64))
    x, y = np.concatenate([own[:20], np.repeat(v, 144), own[20:40]]), np.concatenate([own[50:], np.repeat(v, 60)])
    for shift in (30, -10, -50):
        assert passages(x, y, [shift], 46) == [(20, 164)]
    assert passages(x, np.repeat(v, 30), range(-150, 20), 46) == []


def test_repeated_passages_delete_what_they_stored_on_their_way(spark):
    a = words_of(60, 70)
    data = [(i, " ".join(words_of(60, 3000 + i) + a + words_of(60, 4000 + i))) for i in range(4)]
    with recording() as paths:
        got = repeated_passages(spark.createDataFrame(data, "doc_id long, text string"))
        assert {(r.doc_id, r.start, r.stop) for r in got.collect()} == {(i, 60, 120) for i in (1, 2, 3)}
    assert sum(os.path.exists(p.removeprefix("file:")) for p in paths) <= 7 < len(paths)


def test_runs_are_named_only_where_copies_part(spark):
    a = words_of(400, 75)
    changed = a[:200] + ["other"] + a[201:]
    alike = [(i, " ".join(a)) for i in range(5)]
    done = spark.createDataFrame([], "doc_id long, source_id long, start int, stop int")
    places = lambda data: {r.doc: {i for w in r.windows for i in range(w["low"], w["high"] - 19)} for r in substring_dedup._windowed(
        spark.createDataFrame(data, "doc_id long, text string"), done, "doc_id", "text", 46, 20).collect()}
    assert places(alike) == {}
    found = places([*alike, (7, " ".join(changed))])
    # runs of 20 shingles end or begin where the texts part, whichever half of them holds the least shingle
    assert set(found) == {0, 1, 2, 3, 4, 7} and all({176, 201} <= at and at <= set(range(146, 232)) for at in found.values())


def test_frequent_lines_hide_no_passage(spark):
    a, b = words_of(27, 50), words_of(27, 51)
    data = [(i, " ".join(words_of(60, 1000 + i) + (a if i % 2 else b) + words_of(60, 2000 + i))) for i in range(60)]
    data += [(i, " ".join(words_of(60, 1000 + i) + a + b + words_of(60, 2000 + i))) for i in (100, 101, 102)]
    # a confirmed passage of the same two documents, one that only the first of them has elsewhere, too
    data += [(i, " ".join(words_of(70, 52) + words_of(60, 1000 + i) + b + a + words_of(60, 2000 + i))) for i in (200, 201)]
    got = {(r.doc_id, r.source_id, r.start, r.stop) for r in repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(101, 100, 60, 114), (102, 100, 60, 114), (201, 200, 0, 70), (201, 200, 130, 184)}


def test_changed_passages_are_found_behind_any_number_of_first_documents(spark):
    kinds = [(1, 1), (0, 1), (0, 2), (1, 0), (2, 0)]  # words in the later and in the earlier document between the two equal parts
    parts = [(words_of(25, 500 + v), words_of(25, 600 + v)) for v in range(len(kinds))]
    plain = words_of(45, 700)  # equal but for the edges

    def text(i, pieces):
        return " ".join(w for n, piece in enumerate(pieces) for w in [*words_of(40, 10_000 + 50 * i + n), *piece])

    # the first documents of all min-hashes have one part only
    data = [(i, text(i, [*(p[i % 2] for p in parts), plain[:30] if i % 2 else plain[15:]])) for i in range(16)]
    for i, side in ((100, 1), (200, 0)):
        data.append((i, text(i, [*(a + words_of(kind[side], 800 + i + v) + b for v, ((a, b), kind) in enumerate(zip(parts, kinds))), plain])))
    got = repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(200, 100)}
    covered = {w for r in got for w in range(r.start, r.stop)}
    at = 0
    for size in [50 + here for here, _ in kinds] + [45]:
        at += 40
        assert covered >= {*range(at, at + 24), *range(at + size - 24, at + size)} and not covered & {at - 1, at + size}
        at += size


def test_urls_follow_the_longest_rule(spark):
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block"}
    urls = [None, "", "nothing", "http://Example.COM/en/x?q=1", "https://www.example.com/en/", "http://a.net/es/1", "http://a.net/fr/1#x", "http://com", "http://badexample.com/en/", "ftp://x.org?u=://y/z"] * 2
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    got = {r.page_id: r for r in UrlFilter(rules, rounds=2).fit(pages).transform(pages).collect()}
    assert [got[i].rule for i in range(10)] == [None, None, None, "example.com/en/", "www.example.com/en/", "net/es/", None, None, "com/", None]
    assert [(got[i].host, got[i].path) for i in (0, 2, 3, 7, 9)] == [("", ""), ("", ""), ("example.com", "/en/x"), ("com", ""), ("x.org", "")]
    assert [got[i].verdict for i in (3, 4, 5, 8)] == ["block", "allow", "block", "allow"]
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    none = pages.where("false")
    assert UrlFilter(rules).fit(none).transform(pages).where("verdict = 'block' and rule is null").count() == 0
    assert UrlFilter(rules).fit(pages).transform(none).count() == 0


def test_url_statistics_are_those_of_all_urls(spark):
    urls = [f"http://a{i}.com/x/{i}" for i in range(60)] + [f"http://b{i}.net/es/{i}" for i in range(20)] + [f"http://c{i}.org/y" for i in range(20)]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    model = UrlFilter({"com/": "allow", "net/es/": "block"}, sample=10, rounds=2).fit(pages)
    assert {r.key: round(r.share, 6) for r in model.stats["_suffix"].collect()} == {"com": 0.6, "net": 0.2, "org": 0.2}
    assert model.base == 0.25 and {r.key: r.rate for r in model.stats["_suffix"].collect()}["org"] == 0.25
    assert model.transform(pages).count() == 100


def test_languages_are_told_apart(spark, empty):
    words = {"aa": words_of(60, 20), "bb": [w.replace("a", "é") + "ß" for w in words_of(60, 21)]}
    rng = np.random.default_rng(6)
    data = [(i, " ".join(rng.choice(words[k], 40)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    data += [(900, None, None), (901, "12 !", None), (902, "", "aa"), (903, "x", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = LanguageId().fit(docs.where("doc_id < 60 or doc_id = 902"))
    got = {r.doc_id: r for r in model.transform(docs).collect()}
    assert all(got[i].lang_pred == k for i, _, k in data[:120])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in ("aa", "bb")
    assert all(0 <= r.score <= 1 for r in got.values())
    none = LanguageId().fit(empty)
    assert {r.lang_pred for r in none.transform(docs).collect()} == {"und"} and none.transform(empty).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(700):
        at = np.unique(rng.integers(0, 40, rng.integers(1, 9)))
        x = rng.random(len(at)) + 0.1
        rows.append((at, x / np.sqrt((x * x).sum())))
    dense = np.zeros((700, 40))
    for i, (at, x) in enumerate(rows):
        dense[i, at] = x
    index = BlockMaxIndex(rows, 40, block=16)
    for i in range(0, 700, 13):
        ids, sims = index.nearest(*rows[i], 10, without=i)
        want = dense @ dense[i]
        want[i] = -1
        best = np.lexsort((np.arange(700), -want.round(12)))[:10]
        assert np.allclose(sims, want[best]) and np.allclose(want[ids], sims)


def test_toxic_words_are_found(spark, empty):
    rng = np.random.default_rng(9)
    bad, plain = ["idiot", "moron", "scum"], words_of(300, 30)
    data, labels = [], []
    for i in range(300):
        text = list(rng.choice(plain, 60))
        if i % 5 == 0:
            text[10:12] = [rng.choice(bad).upper() + ",", rng.choice(bad)]
        data.append((i, " ".join(text)))
        labels.append((i, int(i % 5 == 0)))
    data += [(900, None), (901, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("evidence", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = ToxicityScorer().fit(docs.where("doc_id < 200"), marks.where("doc_id < 200"))
    got = {r.doc_id: r for r in model.transform(docs).collect()}
    assert all((got[i].score >= 0.3) == (i % 5 == 0) for i in range(300))
    assert got[900].score == got[901].score < 0.3 and got[0].evidence[0].label == 1
    none = ToxicityScorer().fit(docs, marks.where("false"))
    assert {r.score for r in none.transform(docs).collect()} == {0.0} and model.transform(docs.where("false")).count() == 0


def test_toxicity_is_alike_on_a_balanced_sample(spark):
    rng = np.random.default_rng(19)
    plain = words_of(300, 60)
    data = []
    for i in range(2000):
        text = list(rng.choice(plain, 20))
        if i % 10 == 0 and i % 50 or i % 10 == 3 and i % 30 == 13:  # four of five toxic texts and a tenth of that of the others
            text[3] = "scum"
        data.append((i, " ".join(text), int(i % 10 == 0)))
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    ask = spark.createDataFrame([(1, ""), (2, "scum")], "doc_id long, text string")
    whole, half = ({r.doc_id: r.score for r in ToxicityScorer(sample=n).fit(docs, docs).transform(ask).collect()} for n in (8000, 200))
    assert abs(whole[1] - half[1]) < 0.02 and abs(whole[2] - half[2]) < 0.15
    few = ToxicityScorer(examples=40).fit(docs, docs)
    assert np.allclose(few.each, [max(1, 67 / 40), 160 / 40], rtol=0.1)


def test_weak_labels_part_good_from_bad(spark, empty):
    rng = np.random.default_rng(10)
    plain = words_of(500, 40)
    data = [(i, " ".join(rng.choice(plain, 80)).capitalize() + ".") for i in range(200)]
    data += [(1000 + i, " ".join(w + "%%%" for w in rng.choice(plain, 80))) for i in range(30)]
    data += [(2000 + i, " ".join(w.upper() + "!!" for w in rng.choice(plain, 80))) for i in range(30)]
    data += [(3000 + i, " ".join([plain[i]] * 60)) for i in range(30)]
    data += [(9000, None), (9001, ""), (9002, "\n")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    model = WeakQuality().fit(docs)
    got = {r.doc_id: r for r in model.transform(docs).collect()}
    assert sum(got[i].kept for i in range(200)) >= 198
    assert not any(got[i].kept for i, _ in data if 1000 <= i < 9000)
    assert set(model.accuracies()) == {name for name, *_ in LABELLERS}
    assert WeakQuality().fit(empty.select("text")).transform(empty).count() == 0
    assert estimate({})[2] == {}


def test_texts_hashed_together_are_those_hashed_alone():
    from gablestat.llm.words import Words, buffers, each_text, in_blocks, list_fields

    column = pa.array(["a b c d e f", None, "", "One two", " ".join(words_of(300, 5)), "x" * 10])
    data, offsets = buffers(column)
    got = list(each_text(column))
    assert len(got) == len(column)
    for i, (shingles, words) in enumerate(got):
        own = Words(data, offsets[i : i + 2])
        assert np.array_equal(shingles, own.shingles()[0]) and np.array_equal(words, own.hash)
    lists = pa.array([[{"a": 1, "b": True}, {"a": 2, "b": False}], None, [], [{"a": 3, "b": True}]])
    assert [(a.tolist(), b.tolist()) for a, b in list_fields(lists, "a", "b")] == [([1, 2], [True, False]), ([], []), ([], []), ([3], [True])]
    blocks = list(in_blocks(([np.arange(i, i + 3), np.full(3, i)] for i in range(5)), ["a", "b"], 6))
    assert [b.num_rows for b in blocks] == [6, 6, 3] and [x for b in blocks for x in b.column(1).to_pylist()] == [i for i in range(5) for _ in range(3)]
    assert list(in_blocks(iter([]), ["a"])) == []
