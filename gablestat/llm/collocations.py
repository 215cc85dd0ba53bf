"""Phrase collocations from stripes: every prefix keys an associative counter of the words after it.

A task counts the prefixes of a chunk of text at once and emits one *stripe* per prefix: the words that follow it with
their counts; a prefix of one word also has its own total, under the empty word, which no text contains. Stripes of one
prefix meet in the shuffle and are merged elementwise. The merged stripes have everything a score needs: entries are the
counts of phrases one word longer than the prefix and so the totals of longer prefixes, and the largest entry of a
prefix tells whether a longer phrase subsumes it.

Prefixes grow a word at a time. Entries below ``min_count`` leave after a merge, when they are exact, and a longer prefix
is counted only where the phrases inside it may have reached it: a bitmap of ``BITS`` hashed phrases, always of that
size, says where they can't have. Where it errs, a phrase is counted in vain and leaves after its merge.

A prefix of frequent words only may have a stripe that grows with the corpus, so its stripe is cut into ``SEGMENTS`` by
the hash of the next word. A first scan finds the words with at least one in ``HOT`` of all occurrences. Each chunk reports
those with half that share of its own words, so what goes unreported of a frequent word is less than half of it, and
the words reported for half the share overall are ``2 HOT`` at most, whatever the input; that bounds the broadcast.

Defined results: a null text counts as empty and gives nothing; a null language is ``und``; repeated rows count as often
as they occur; texts of any length are counted whole, a chunk takes whole texts; ties are ranked by count, then phrase;
an empty table gives no rows; only the text and language columns are read, whatever else is there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gablestat.llm.words import buffers, mix
from gablestat.session import cut_lineage

#: Bytes of text that are counted together.
CHUNK = 4 << 20
#: A word is frequent with one in HOT of all occurrences; a prefix of such words is cut into so many segments.
HOT, SEGMENTS = 2000, 64
#: Binary logarithms of the bits of the bitmap and of the part of it that one row holds.
BITS, PART = 27, 20
#: Phrases of a language are first ranked in so many groups.
GROUPS = 64

_BYTES = np.arange(256)
_BLANK = np.isin(_BYTES, [0x20, 0x09])
_BREAK = np.isin(_BYTES, [ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D])
_APART = _BLANK | _BREAK
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts, the code of every word, its text, and whether the word before it is in the same piece."""
    at = offsets - offsets[0]
    data = data[offsets[0] : offsets[-1]]
    inside = ~_APART[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # pieces end at a separator or with the text
    breaks = np.cumsum(_BREAK[data], dtype=np.int64)
    text = np.searchsorted(at, begin, side="right") - 1
    joined = np.zeros(len(begin), dtype=bool)
    joined[1:] = (breaks[begin[1:]] == breaks[begin[:-1]]) & (text[1:] == text[:-1])
    sizes = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    letters = _LOWER[data[inside]]
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(sizes), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), text, joined


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Bytes and offsets of whole texts of about ``CHUNK`` bytes together, with their languages."""
    held, size = [], 0

    def joined():
        rows = pa.Table.from_batches(held).combine_chunks()
        text = rows.column("text").cast(pa.large_string())
        return (*buffers(text.chunk(0) if text.num_chunks else pa.array([], pa.large_string())), rows.column("lang"))

    for batch in batches:
        row = 0
        while row < batch.num_rows:
            _, offsets = buffers(batch.column("text").slice(row))
            ends = offsets[1:] - offsets[0]
            n = max(int(np.searchsorted(ends, CHUNK - size, side="right")), 0 if held else 1)
            if n:
                held.append(batch.slice(row, n))
                size += int(ends[n - 1])
                row += n
            if row < batch.num_rows:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _taken(words: pa.Array, codes: np.ndarray) -> pa.Array:
    return words.take(pa.array(codes)).cast(pa.binary()).cast(pa.string())


def _lang(langs: pa.Array, codes: np.ndarray) -> pa.Array:
    return langs.dictionary.take(pa.array(codes)).cast(pa.string())


def _count_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang word n``: the frequent words of each chunk, and all its words of a language under the empty word."""
    for data, offsets, lang in _chunks(batches):
        words, codes, text, _ = _words(data, offsets)
        if len(codes) == 0:
            continue
        v = len(words)
        langs = lang.combine_chunks().dictionary_encode()
        of_lang = langs.indices.to_numpy()[text].astype(np.int64)
        key, n = np.unique(of_lang * v + codes, return_counts=True)
        often = n * (2 * HOT) >= len(codes)
        key, n = key[often], n[often]
        total = np.bincount(of_lang, minlength=len(langs.dictionary))
        yield pa.record_batch(
            [pa.concat_arrays([_lang(langs, key // v), _lang(langs, np.arange(len(total)))]),
             pa.concat_arrays([_taken(words, key % v), pa.array([""] * len(total))]), pa.array(np.concatenate([n, total]).astype(np.int64))],
            names=["lang", "word", "n"])


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def _followed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of the phrase without its last word and of that word; a language is the phrase of no words."""
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _hot_keys(hot: dict[str, set[bytes]], langs: pa.Array, words: pa.Array) -> np.ndarray:
    """Keys (language, word) of the frequent words among those of a chunk."""
    keys = [np.zeros(0, dtype=np.int64)]
    for i, name in enumerate(langs.to_pylist() if hot else []):
        if name in hot:
            at = pc.index_in(pa.array(sorted(hot[name]), pa.large_binary()), words).drop_null().to_numpy()
            keys.append(i * len(words) + at.astype(np.int64))
    return np.concatenate(keys)


def _stripes(size: int, hot, bitmap):
    """Counts the stripes of prefixes of ``size`` words in each chunk: ``lang prefix segment next counts``, ``next`` a text of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, lang in _chunks(batches):
            words, codes, text, joined = _words(data, offsets)
            v, n = len(words), len(codes)
            if v == 0:
                continue
            langs = lang.combine_chunks().dictionary_encode()
            known = words.to_pylist()
            of_lang = langs.indices.to_numpy()[text].astype(np.int64)
            # `alive` holds where a phrase of one word more begins that lies within a piece
            alive = np.arange(max(n - size, 0))
            for k in range(1, size + 1):
                alive = alive[joined[alive + k]]
            if size > 1:
                hashed, own = _hashes([x.encode() for x in langs.dictionary.to_pylist()])[of_lang], _hashes(known)[codes]
                for k in range(size):
                    hashed = _followed(hashed[: n - k], own[k:])
                place = hashed >> np.uint64(64 - BITS)
                may = (bitmap.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                alive = alive[may[alive] & may[alive + 1]]
            # the prefixes, spelt out word by word
            every = np.arange(n) if size == 1 else alive
            key, ids, total = np.unique(of_lang[every] * v + codes[every], return_inverse=True, return_counts=True)
            is_hot = np.isin(key, _hot_keys(hot.value, langs.dictionary, words))[ids]
            shown, lang_of = _taken(words, key % v), key // v
            for k in range(1, size):
                key, ids = np.unique(ids * v + codes[alive + k], return_inverse=True)
                shown = pc.binary_join_element_wise(shown.take(pa.array(key // v)), _taken(words, key % v), " ")
                lang_of = lang_of[key // v]
                is_hot &= np.isin(of_lang[alive] * v + codes[alive + k], _hot_keys(hot.value, langs.dictionary, words))
            wide = np.zeros(len(shown), dtype=bool)
            wide[ids] = is_hot
            pair, counts = np.unique((ids[alive] if size == 1 else ids) * v + codes[alive + size], return_counts=True)
            owner, word = pair // v, pair % v
            spread = np.array([zlib.crc32(w) % SEGMENTS for w in known], dtype=np.int64)
            segment = np.where(wide[owner], spread[word], 0)
            if size == 1:
                owner, word = np.concatenate([np.arange(len(shown)), owner]), np.concatenate([np.full(len(shown), v), word])
                counts, segment = np.concatenate([total, counts]), np.concatenate([np.zeros(len(shown), dtype=np.int64), segment])
            yield from _emit(shown, langs, lang_of, owner, word, counts, segment, words)

    return count


def _emit(shown, langs, lang_of, owner, word, counts, segment, words) -> Iterator[pa.RecordBatch]:
    """One row for each prefix and segment; the code after the last word's is the empty word. Words that follow are one text, apart by
    spaces, which no word has, so that the shuffle holds them and no places or padding."""
    order = np.argsort(owner * SEGMENTS + segment, kind="stable")
    row = (owner * SEGMENTS + segment)[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    vocabulary = pa.concat_arrays([words.cast(pa.binary()), pa.array([b""])])
    for start in range(0, len(first), 1 << 15):
        rows = first[start : start + (1 << 15)]
        stop = first[start + (1 << 15)] if start + (1 << 15) < len(first) else len(row)
        own, entries = row[rows] // SEGMENTS, order[rows[0] : stop]
        bounds = pa.array(np.append(rows, stop).astype(np.int32) - np.int32(rows[0]))
        yield pa.record_batch(
            [_lang(langs, lang_of[own]), shown.take(pa.array(own)), pa.array((row[rows] % SEGMENTS).astype(np.int32)),
             pc.binary_join(pa.ListArray.from_arrays(bounds, _taken(vocabulary, word[entries])), " "), pa.ListArray.from_arrays(bounds, pa.array(counts[entries].astype(np.int32)))],
            names=["lang", "prefix", "segment", "next", "counts"])


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang")).where("text is not null")


def frequent_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[dict[str, set[bytes]], DataFrame]:
    """The words with one in ``HOT`` of all occurrences, ``2 HOT`` at most, and ``lang n`` of all words."""
    found = cut_lineage(_texts(docs, text, lang).mapInArrow(_count_frequent, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = found.where("word = ''").select("lang", "n")
    total = totals.agg(F.sum("n")).first()[0] or 0
    hot: dict[str, set[bytes]] = {}
    for r in found.where((F.col("word") != "") & (F.col("n") * (2 * HOT) >= F.lit(total))).collect():
        hot.setdefault(r.lang, set()).add(r.word.encode())
    return hot, totals


def merged_stripes(docs: DataFrame, size: int, min_count: int, hot, bitmap, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang prefix next n``: the entries of the merged stripes of prefixes of ``size`` words that reach ``min_count``.

    The shuffle deals stripes by prefix and segment; entries are summed where the stripes meet, without another shuffle.
    """
    local = _texts(docs, text, lang).mapInArrow(_stripes(size, hot, bitmap), "lang string, prefix string, segment int, next string, counts array<int>")
    met = local.repartition("lang", "prefix", "segment")
    entries = met.select("lang", "prefix", "segment", F.inline(F.arrays_zip(F.split("next", " ").alias("next"), "counts")))
    summed = entries.groupBy("lang", "prefix", "segment", "next").agg(F.sum("counts").alias("n"))
    return summed.where(F.col("n") >= min_count).select("lang", "prefix", "next", "n")


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """A bit for the hash of each phrase (``lang phrase``). A row holds 2 ** ``PART`` bits, so the driver gets the bitmap and no more."""
    part = min(PART, BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, inverse = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
            split = [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
            if not split:
                continue
            hashed = _hashes([x.encode() for x in names])[inverse]
            for k in range(len(split[0])):
                hashed = _followed(hashed, _hashes([p[k] for p in split]))
            yield pa.record_batch([pa.array((hashed >> np.uint64(64 - BITS)).astype(np.int64))], names=["place"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column("place").to_numpy()
            for own in np.unique(place >> part).tolist():
                inside = place[place >> part == own] - (own << part)
                np.bitwise_or.at(held.setdefault(own, np.zeros(1 << part >> 3, dtype=np.uint8)), inside >> 3, (1 << (inside & 7)).astype(np.uint8))
        for own, value in held.items():
            yield pa.record_batch([pa.array([own]), pa.array([value.tobytes()], pa.binary())], names=["part", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(places, "place long").repartition(F.shiftright("place", part)).mapInArrow(bits, "part long, bits binary")
    out = np.zeros(1 << BITS >> 3, dtype=np.uint8)
    for r in found.toLocalIterator():
        out[r.part << part >> 3 : (r.part + 1) << part >> 3] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _ratio(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits, exact for counts up to 10^15."""
    wide = [c.cast("decimal(18,0)") for c in (a, left, right)]
    return F.call_function("div", wide[0] * wide[0] * F.lit(1000000).cast("decimal(7,0)"), wide[1] * wide[2])


def phrase_counts(docs: DataFrame, hot: dict[str, set[bytes]], longest: int = 3, min_count: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang phrase size a``: phrases of 1 to ``longest`` words that occur ``min_count`` times, from merged stripes."""
    context = docs.sparkSession.sparkContext
    frequent, bitmap, out = context.broadcast(hot), None, None
    for size in range(1, max(longest, 2)):
        merged = cut_lineage(merged_stripes(docs, size, min_count, frequent, bitmap, text, lang))
        grown = merged.where("next <> ''").select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.lit(size + 1).alias("size"), F.col("n").alias("a"))
        if out is None:
            out = merged.where("next = ''").select("lang", F.col("prefix").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("a"))
        out = out.unionByName(grown)
        if size + 1 < longest:
            bitmap = context.broadcast(_bitmap(grown))
    return out


def collocations(
    docs: DataFrame, longest: int = 3, min_count: int = 10, subsumed_pct: int = 50, text: str = "text", lang: str = "lang",
    hot: dict[str, set[bytes]] | None = None,
) -> DataFrame:
    """``lang size phrase a l r score``: all phrases of 2 to ``longest`` words that no longer one subsumes.

    The lowest-scoring cut of a phrase counts, on ties the one with the shortest first part. A phrase goes if a longer
    candidate holds its words in a row and has at least ``subsumed_pct`` per cent of its count. It is enough to look one
    word further: what a phrase two words longer holds, one between them holds at least as often. ``hot`` are the frequent
    words, if they are at hand.
    """
    hot = frequent_words(docs, text, lang)[0] if hot is None else hot
    counted = phrase_counts(docs, hot, longest, min_count, text, lang)
    phrases, parts = counted.where("size > 1"), counted.where(F.col("size") < longest)

    # every cut of every phrase meets the counts of both of its parts
    cut = phrases.withColumn("_w", F.split("phrase", " ")).select(
        "lang", "phrase", "size", "a", "_w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("_l"),
                     F.array_join(F.slice("_w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("_r"))
    left = parts.select("lang", F.col("phrase").alias("_l"), F.col("a").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("_r"), F.col("a").alias("r"))
    scored = cut.join(left, ["lang", "_l"]).join(right, ["lang", "_r"]).withColumn("score", _ratio(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "size", "a", "b.l", "b.r", "b.score")
    if longest == 2:
        return best

    # the largest count of a candidate that is one word longer, on either side
    words_of = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words_of, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words_of, F.lit(2), F.col("size") - 1), " "))
    over = phrases.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_over"))
    return best.join(over, ["lang", "phrase"], "left").where(F.col("_over").isNull() | (100 * F.col("_over") < subsumed_pct * F.col("a"))).drop("_over")


def top_collocations(docs: DataFrame, top: int = 2000, text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """``lang rank phrase a l r n score``: the first ``top`` of every language by score, count, phrase.

    Phrases are ranked in ``GROUPS`` groups of a language first, so the last task of a language gets a bounded number of
    rows however many partitions there are.
    """
    hot, totals = frequent_words(docs, text, lang)
    found = collocations(docs, text=text, lang=lang, hot=hot, **options)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    grouped = found.withColumn("_g", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)))
    first = grouped.withColumn("_p", F.row_number().over(Window.partitionBy("lang", "_g").orderBy(*order))).where(F.col("_p") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
