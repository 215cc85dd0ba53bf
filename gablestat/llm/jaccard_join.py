"""N-gram Jaccard join: near duplicates by shared shingles, with bitmap bounds before exact intersections.

A document's set holds the 64-bit hashes of its distinct five-word shingles; equal sets are one class. Two sets of
similarity 0.8 or more share one of their ``n - ceil(0.8 n) + 1`` first shingles in any fixed order of all shingles. The order
puts shingles that are frequent in the whole corpus last (by a table of ``2 ** ORDER_BITS`` counts over all documents, a fixed
size). Those that the table can't tell from rare ones are counted where they are first shingles: the ones of more than ``USUAL``
rows and more than one class set a bit of a bitmap of ``2 ** HOT_BITS`` bits and come after the others, ``PASSES`` times over. Any
bitmap gives an order, so chance hits cost time and lose nothing. So a line or passage that many documents share seldom makes
them candidates. A *tile* holds the classes that share a first shingle; within it only neighbouring size bands (factor 1.25)
can match, and of those only pairs of which enough shingles are left from the shared one on.

Links inside a tile are not looked for among all pairs. Each class first tries a few partners that its tiles name: one at random,
differently for each class, and the one with the fewest shingles before the tile's, which is the likeliest to be what the others
are copies of; links found are contracted to components, and again. Tiles that then lie in one component need no more work;
in the others the pairs of classes from different components are checked, all of them. So no link between components is lost,
while a group of near copies costs a number of checks in proportion to its size. A pair is first bounded from above by
the bits of hashed bitmap signatures, whose size grows with the size band: each bit that only one has costs a common
shingle. Pairs that pass are decided by exact intersection of the sorted sets.

Skew: frequent first shingles are counted with map-side minima and joined by plain joins that adaptive execution can split;
only the rare ones, whose tiles the table of counts bounds, go through a window.

Defined results: a null, empty or blank text has no set and is linked with nothing; fewer than five words are one
shingle; rows may repeat; a null doc_id takes part, but never names a component unless all of its rows are null; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gablestat.llm.graph import components
from gablestat.llm.members import may_have
from gablestat.llm.words import mix, sliced
from gablestat.session import cut_lineage, drop_stored, store

PERCENT = 80
ORDER_BITS = 17
#: A shingle that this many rows have among their first ones is still rare.
USUAL = 8
#: Binary logarithms of the places of the bitmap and of those that are counted together.
HOT_BITS, PART = 26, 14
PASSES = 2
#: Rounds of tries before all pairs of classes from different components are checked.
ROUNDS = 2


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted distinct shingle hashes of each row's text."""
    for at, words in sliced(column):
        hashes, first = words.shingles()
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            yield at + i, np.unique(hashes[a:b])


def _class_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sign(hashes: np.ndarray) -> bytes:
    """A bitmap of the set, of two to four bits for each of its shingles, a power of two."""
    size = 1 << max(6, int(2 * len(hashes)).bit_length())
    sign = np.zeros(size, dtype=bool)
    sign[(mix(hashes) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(sign).tobytes()


def frequency_ranks(docs: DataFrame, text: str = "text", bits: int = ORDER_BITS) -> np.ndarray:
    """Rank of each of ``2 ** bits`` buckets of shingles, 0 where its count is no more than chance explains."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for _, words in sliced(batch.column(0)):
                total += np.bincount((words.shingles()[0] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # 2 ** bits rows
    total = np.zeros(1 << bits, dtype=np.float64)
    total[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    usual = float(np.median(total))
    above = total - usual
    return np.where(above <= 8 + 6 * np.sqrt(usual), 0, 1 + np.log2(np.maximum(above, 1))).astype(np.uint8)


def _is_hot(hot: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - HOT_BITS)
    return (hot[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _head(own: np.ndarray, ranks: np.ndarray, hot: np.ndarray, percent: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set that may be rare, in order, and those after them, which are frequent."""
    rank = ranks[(own >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64)
    head = np.argsort(2 * rank + _is_hot(hot, own), kind="stable")[: len(own) - -(-percent * len(own) // 100) + 1 if len(own) else 0]
    often = rank[head] > 0
    return own[head[~often]], own[head[often]]


def hot_shingles(docs: DataFrame, ranks, text: str = "text", percent: int = PERCENT, bits: int = ORDER_BITS) -> np.ndarray:
    """A bitmap (64 bits an entry) of the rare first shingles of more than ``USUAL`` rows; copies of one text count for nothing."""
    hot = np.zeros(1 << HOT_BITS >> 6, dtype=np.uint64)
    for _ in range(PASSES):
        known = docs.sparkSession.sparkContext.broadcast(hot)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                heads = [(_head(own, ranks.value, known.value, percent, bits)[0], _class_of(own) & 0xFFFF) for _, own in _sets(batch.column(0)) if len(own)]
                heads = [(own[~_is_hot(known.value, own)] >> np.uint64(64 - HOT_BITS), tag) for own, tag in heads]
                place = np.concatenate([own for own, _ in heads]).astype(np.int64) if heads else np.zeros(0, np.int64)
                tag = np.repeat(np.array([tag for _, tag in heads], dtype=np.int64), [len(own) for own, _ in heads])
                by = np.argsort(place, kind="stable")
                part = place[by] >> PART
                packed = ((place[by] & ((1 << PART) - 1)) << 16 | tag[by]).astype(np.uint32)  # four bytes a shingle
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                held = [packed[x:y].tobytes() for x, y in zip(cuts, [*cuts[1:], len(part)])]
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(held, pa.binary())], names=["part", "packed"])

        def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # counts, least and greatest tag of each place
            for batch in batches:
                for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    x = np.frombuffer(packed, np.uint32)
                    place, tag = (x >> 16).astype(np.int64), (x & 0xFFFF).astype(np.uint16)
                    if part not in parts:
                        parts[part] = np.zeros(1 << PART, np.uint32), np.full(1 << PART, 0xFFFF, np.uint16), np.zeros(1 << PART, np.uint16)
                    n, least, most = parts[part]
                    np.add.at(n, place, np.uint32(1))
                    np.minimum.at(least, place, tag)
                    np.maximum.at(most, place, tag)
            for part, (n, least, most) in parts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([np.packbits((n > USUAL) & (least < most), bitorder="little").tobytes()], pa.binary())], names=["part", "held"])

        # a task counts at most a 64th of the places (8 MB), and adaptive execution doesn't merge them; the driver gets the bitmap and no more
        tasks = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        found = docs.select(text).mapInArrow(places, "part int, packed binary").repartition(tasks, "part").mapInArrow(often, "part int, held binary")
        new = np.zeros_like(hot)
        for r in found.toLocalIterator():
            new[r.part << PART >> 6 : (r.part + 1) << PART >> 6] = np.frombuffer(r.held, np.uint64)
        known.unpersist()
        hot = hot | new
    return hot


def first_shingles(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, bits: int = ORDER_BITS) -> DataFrame:
    """Per row: ``key n class sign`` and its first shingles, ``rare`` and ``frequent`` (array of long)."""
    context = docs.sparkSession.sparkContext
    ranks = context.broadcast(frequency_ranks(docs, text, bits))
    hot = context.broadcast(hot_shingles(docs, ranks, text, percent, bits))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, classes, signs, lists = [], [], [], ([], [])
            for _, own in _sets(batch.column(1)):
                size = len(own)
                n.append(size)
                classes.append(_class_of(own) if size else None)
                signs.append(_sign(own))
                for out, part in zip(lists, _head(own, ranks.value, hot.value, percent, bits)):
                    out.append(part.view(np.int64))
            arrays = []
            for parts in lists:
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(signs, pa.binary()), *arrays],
                names=[key, "n", "class", "sign", "rare", "frequent"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n long, class long, sign binary, rare array<long>, frequent array<long>")


def _band(n: Column) -> Column:
    """Sizes whose ratio is 0.8 or more lie in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25))).cast("int")


def _tiles(classes: DataFrame) -> DataFrame:
    """``token class n pos lo near`` of the classes that share a first shingle with one of a neighbouring size.

    ``pos`` shingles of the class come before the token; ``lo`` names one of the classes at random, ``near`` the one of least ``pos``.
    """
    own = F.col("class").bitwiseXOR(F.col("token"))  # a different order of the classes in every tile, and it can be undone
    rare = classes.select("class", "n", F.posexplode("rare").alias("pos", "token"))
    size = F.floor(F.log(F.col("n").cast("double")) * 1_000_000)
    alike = Window.partitionBy("token").orderBy(size).rangeBetween(-223_146, 223_146)  # log(1.25), rounded up
    first = F.min(F.struct("pos", own.alias("own")))
    rare = rare.withColumns({"lo": F.min(own).over(alike), "hi": F.max(own).over(alike), "near": first.over(alike)["own"]}).where("lo < hi")
    often = classes.select("class", "n", F.size("rare").alias("before"), F.posexplode("frequent").alias("pos", "token")).withColumn("pos", F.col("pos") + F.col("before"))
    often = often.withColumn("band", F.explode(F.array(_band(F.col("n")), _band(F.col("n")) + 1)))
    ends = often.groupBy("token", "band").agg(F.min(own).alias("lo"), F.max(own).alias("hi"), first["own"].alias("near")).where("lo < hi")
    often = often.join(ends, ["token", "band"])
    names = ["token", "class", "n", "pos", "lo", "near"]
    return cut_lineage(rare.select(*names).unionByName(often.select(*names)))


def _most_common(a_sign: bytes, b_sign: bytes, a: int, b: int) -> int:
    """No intersection is larger, by the bits that one signature has and the other lacks."""
    x, y = np.frombuffer(a_sign, np.uint8), np.frombuffer(b_sign, np.uint8)
    if len(x) != len(y):  # sizes are powers of two: the larger one folds to the smaller
        small = min(len(x), len(y))
        x, y = (np.bitwise_or.reduce(z.reshape(-1, small), axis=0) for z in (x, y))
    only = np.bitwise_count(x & ~y).sum(), np.bitwise_count(y & ~x).sum()
    return int(min(a - only[0], b - only[1]))


def _linked(n: int, a: int, b: int, percent: int) -> bool:
    return 100 * n >= percent * (a + b - n)


class _Corpus:
    """Classes of a corpus with all that is needed to decide whether two of them are linked."""

    def __init__(self, docs: DataFrame, firsts: DataFrame, signs: DataFrame, key: str, text: str, percent: int):
        self.docs, self.firsts, self.signs, self.key, self.text, self.percent = docs, firsts, signs, key, text, percent

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs (``a b``) that size and bitmap signatures don't rule out."""
        percent = self.percent
        side = lambda c: self.signs.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sign").alias(f"sign_{c}"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(2, 6)]
                keep = [_linked(_most_common(x, y, p, q), p, q, percent) for p, q, x, y in zip(*columns)]
                yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

        both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        return cut_lineage(both.select("a", "b", "n_a", "n_b", "sign_a", "sign_b").mapInArrow(run, "a long, b long"))

    def sets(self, classes: DataFrame) -> DataFrame:
        """``class hashes`` of the classes, from the text of one document each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(_class_of(own), own.tobytes()) for _, own in _sets(batch.column(0)) if len(own)]
                columns = list(zip(*found)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["class", "hashes"])

        wanted = self.firsts.select(self.key, "class").join(classes, "class", "left_semi").groupBy("class").agg(F.min(self.key).alias("_wanted"))
        wanted = cut_lineage(wanted.select("_wanted"))
        likely = may_have(self.docs.select(self.key, self.text), wanted.select(F.col("_wanted").alias(self.key)), self.key)
        some = likely.join(wanted, F.col(self.key).eqNullSafe(F.col("_wanted")), "left_semi")
        return cut_lineage(some.select(self.text).mapInArrow(run, "class long, hashes binary"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (``a b``) that are links: bitmap bound, then exact intersection."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                    keep.append(_linked(int((v[at] == u).sum()), len(u), len(v), percent))
                yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

        likely = self.bounded(pairs)
        sets = self.sets(likely.select(F.explode(F.array("a", "b")).alias("class")).distinct())
        side = lambda c: sets.select(F.col("class").alias(c), F.col("hashes").alias(f"set_{c}"))
        both = likely.join(side("a"), "a").join(side("b"), "b")
        return cut_lineage(both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long").distinct())


def _rooted(tiles: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The tiles whose classes lie in two components or more, with ``root``."""
    if roots is None:
        return tiles.withColumn("root", F.col("class"))
    rooted = tiles.drop("root").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    ends = rooted.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("token")
    return cut_lineage(rooted.join(ends, "token", "left_semi"))


def _tries(tiles: DataFrame, turn: int) -> DataFrame:
    """A few pairs (``a b``) for every class: partners that its tiles name, chosen by the class itself, none of its own component."""
    if turn:
        turned = int(mix(np.array([turn], dtype=np.uint64)).view(np.int64)[0])
        own = F.col("class").bitwiseXOR(F.col("token")).bitwiseXOR(F.lit(turned))
        ends = tiles.groupBy("token").agg(F.min(F.struct(own.alias("own"), "class", "root")).alias("lo"), F.min(F.struct("pos", own.alias("own"), "class", "root")).alias("near"))
        tiles = tiles.drop("lo", "near").join(ends, "token")
        named = {end: F.when(F.col(f"{end}.root") != F.col("root"), F.col(f"{end}.class")) for end in ("lo", "near")}
    else:
        named = {end: F.when(F.col(end).bitwiseXOR(F.col("token")) != F.col("class"), F.col(end).bitwiseXOR(F.col("token"))) for end in ("lo", "near")}
    picks = []
    for end, partner in named.items():
        seen = partner.bitwiseXOR(F.col("class"))
        picks += [F.min(seen).alias(f"{end}0"), F.max(seen).alias(f"{end}1")]
    picked = tiles.groupBy("class").agg(*picks)
    partners = picked.select("class", F.explode(F.array("lo0", "lo1", "near0", "near1")).alias("x")).where("x is not null").withColumn("other", F.col("x").bitwiseXOR(F.col("class")))
    return partners.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


def _all(links: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, links)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """Per row: ``key n_shingles class component_id``, the smallest key that links of ``percent`` similarity reach."""
    spark = docs.sparkSession
    # the wide tables go once they are read: rows keep their class, classes their tiles and signatures
    whole, whole_path = store(first_shingles(docs, key, text, percent))
    classes, classes_path = store(whole.where("n > 0").select("class", "n", "sign", "rare", "frequent").dropDuplicates(["class"]))  # copies take part once
    firsts = cut_lineage(whole.select(key, "n", "class"))
    drop_stored(spark, whole_path)
    tiles = _tiles(classes)
    signs = cut_lineage(classes.select("class", "n", "sign").join(tiles.select("class").distinct(), "class", "left_semi"))
    drop_stored(spark, classes_path)
    corpus = _Corpus(docs, firsts, signs, key, text, percent)
    links, roots, left = [], None, tiles
    for turn in range(rounds):
        left = _rooted(left, roots)
        found = corpus.links(_tries(left, turn))
        if found.isEmpty():
            break
        links.append(found)
        roots = cut_lineage(components(_all(links)))
    left = _rooted(left, roots).select("token", "class", "n", "pos", "root", _band(F.col("n")).alias("band"))
    a, b = (left.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("class", "n", "pos", "root", "band"))) for s in "ab")
    # the first shingle that two sets share and all after it are more than the intersection: a pair is kept in the tile of that one at least
    across = a.join(b, "token").where(
        f"class_a < class_b and root_a <> root_b and abs(band_a - band_b) <= 1 and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        f" and (100 + {percent}) * least(n_a - pos_a, n_b - pos_b) >= {percent} * (n_a + n_b)")
    pairs = across.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()
    found = corpus.links(pairs)
    if not found.isEmpty() or roots is None:
        roots = cut_lineage(components(_all([*links, found])))
    rows = firsts.select(key, F.col("n").alias("n_shingles"), "class").join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    rows = cut_lineage(rows.withColumn("root", F.coalesce("root", "class")))
    names = rows.where("class is not null").groupBy("root").agg(F.min(key).alias("component_id"))
    named = rows.where("class is not null").join(names, "root").select(key, "n_shingles", "class", "component_id")
    return named.unionByName(rows.where("class is null").select(key, "n_shingles", "class", F.col(key).alias("component_id")))
