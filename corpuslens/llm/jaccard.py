"""N-gram Jaccard join by rare-first prefix filtering, verified once per pair, and its connected components.

A document's set is its distinct word n-grams. Sets that are equal form a class at once (by a 64-bit signature). Each class
orders its n-grams rarest first and indexes the prefix in which any partner must share one. Lists are joined with
length, positional and suffix filters; what is left is verified on whole sets.

A group of m near copies has m*m/2 links, and they aren't wanted one by one. So each list first joins all its members with one,
the hub in whose prefix the shared n-gram stands earliest; the links found give components. A list whose members are
all in one component has no more to tell. In the others, members outside the list's largest component are joined with
all members of other components, hardly ever in more than one list. Every pair of sets that link shares a list, so it is verified or already connected.

Lists are dealt by n-gram, pairs and sets by signature; hot ones are split by adaptive execution, as each is the side of a
plain join. The order of n-grams is by bounds of their counts, from two
sketches of fixed size over all documents: an n-gram is at most as frequent as its rarest word, and as its own counter. The words'
sketch still tells rare from frequent when the other, with far more n-grams, is full. Any order gives the same links.
Intermediate tables are written to the shared folder, so a lost executor repeats tasks only.

Null and empty texts, and texts without words, have no n-grams and link with nothing. Fewer words than an n-gram has form one
n-gram. Rows that repeat have equal sets. A null doc_id takes part; a component of nulls only has the id null. Columns beside
doc_id and text are ignored. An empty table gives no rows. Two sets share a signature by chance with odds of 1 in 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import arrays
from corpuslens.llm.scratch import Scratch, bounded, keep_one

#: Counters of each of the two sketches, in SLICES rows. Their size is fixed, so they may be broadcast at any size of the input (2 MB).
SKETCH_BITS, SLICES = 20, 64
#: A filter of keys to look for has KEY_BITS bits for each, and 2**FILTER_BITS of them at most and at least (32 MB at most); for more keys
#: than that, rows are found by a join instead.
KEY_BITS, FILTER_BITS = 8, (20, 28)
#: Earlier n-grams that a posting carries to keep pairs from coming twice.
EARLIER = 4
#: Stands for a null doc_id where one is looked for.
NO_ID = -(2**63)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, level: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The sorted distinct n-gram hashes of each text and, given levels (logarithms of counts) of words and of n-grams, the level
    that each n-gram has at most: the least of its own counter's and its words'."""
    low = arrays.LOWER[data]
    starts, ends, bounds = arrays.words(low, offsets)
    word = arrays.span_hashes(low, starts, ends)
    found, first = arrays.windows(word, bounds, size)
    if level is not None:
        of_word, of_gram = (x[counter(h)] for x, h in zip(level, (word, found)))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        at = np.arange(len(found)) - first[row] + bounds[row]
        for k in range(size):
            of_gram = np.minimum(of_gram, of_word[at + k])
    for k in range(len(offsets) - 1):
        a, b = first[k], first[k + 1]
        if b > a and level is None:
            yield np.unique(found[a:b]), None
        elif b > a:
            own, where = np.unique(found[a:b], return_index=True)
            yield own, of_gram[a:b][where]
        elif bounds[k + 1] > bounds[k]:
            yield np.array([arrays.whole(word[bounds[k] : bounds[k + 1]])]), np.zeros(1, np.uint8)
        else:
            yield np.empty(0, np.uint64), np.empty(0, np.uint8)


def counter(hashes: np.ndarray) -> np.ndarray:
    """The counter of a sketch for each hash."""
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def signature(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def fold(parts: DataFrame, kind: str, how: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Adds up the sliced arrays that tasks gave (slice, blob), in two steps, to one array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(blob.as_buffer(), kind)
                total[k] = how(total[k], own) if k in total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "blob"])

    some = parts.repartition(F.col("slice"), F.spark_partition_id() % 8).mapInArrow(run, "slice int, blob binary")
    rows = some.repartition("slice").mapInArrow(run, "slice int, blob binary").collect()
    return np.concatenate([np.frombuffer(bytes(r.blob), kind) for r in sorted(rows, key=lambda r: r.slice)]) if rows else np.empty(0, kind)


def sliced(array: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(array, SLICES)], pa.binary())], names=["slice", "blob"])


def document_sets(docs: DataFrame, size: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """doc_id, row (a hash of the text), n_shingles and sid of every document, and the levels of the counters of words and of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << SKETCH_BITS), np.int64)
        for batch, data, offsets in arrays.text_slices(batches, "text"):
            sets = [own for own, _ in shingle_sets(data, offsets, size)]
            low = arrays.LOWER[data]
            for own, hashes in zip(counts, (arrays.span_hashes(low, *arrays.words(low, offsets)[:2]), np.concatenate(sets))):
                own += np.bincount(counter(hashes), minlength=1 << SKETCH_BITS)
            none = pa.nulls(len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())],
                names=["doc_id", "row", "n_shingles", "sid", "slice", "blob"],
            )
        last = sliced(counts.ravel())
        none = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, *last.columns], names=["doc_id", "row", "n_shingles", "sid", "slice", "blob"])

    each = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    both = scratch.save(each.mapInArrow(run, "doc_id long, row long, n_shingles long, sid long, slice int, blob binary"), "sets")
    counts = fold(both.filter("slice IS NOT NULL").select("slice", "blob"), "<i8", np.add)
    level = np.minimum(8 * np.log2(counts + 1.0), 255).astype(np.uint8) if len(counts) else np.zeros(2 << SKETCH_BITS, np.uint8)
    return both.filter("slice IS NULL").select("doc_id", "row", "n_shingles", "sid"), level.reshape(2, -1)


def prefix_length(n: int, num: int, den: int) -> int:
    """N-grams of which a partner must share one."""
    return n - -(-num * n // den) + 1


def postings(docs: DataFrame, size: int, num: int, den: int, levels: Broadcast) -> DataFrame:
    """gram, sid, n and pos for the prefix of each class that can link with another; copies within a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data, offsets in arrays.text_slices(batches, "text"):
            gram, sid, total, pos = [], [], [], []
            if len(seen) > 1_000_000:
                seen = set()
            for own, rarity in shingle_sets(data, offsets, size, levels.value):
                n = len(own)
                if n * den < num * (n + 1):  # any other set differs too much
                    continue
                s = signature(own)
                if s in seen:
                    continue
                seen.add(s)
                p = prefix_length(n, num, den)
                order = np.argsort(rarity, kind="stable")[:p]
                gram.append(own[order])
                sid.append(np.full(p, s))
                total.append(np.full(p, n, np.int32))
                pos.append(np.arange(p, dtype=np.int32))
            if gram:
                columns = [np.concatenate(gram).view(np.int64), np.concatenate(sid).astype(np.int64), np.concatenate(total), np.concatenate(pos)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "sid", "n", "pos"])

    return docs.select("text").mapInArrow(run, "gram long, sid long, n int, pos int")


def may_link(num: int, den: int, n: tuple[Column, Column], pos: tuple[Column, Column]) -> Column:
    """Length filter and positional filter for two sets that share an n-gram at these places of their orders."""
    short, long = F.least(*n), F.greatest(*n)
    left = F.least(n[0] - pos[0], n[1] - pos[1]).cast("long")
    return (short.cast("long") * den >= long.cast("long") * num) & (left * (num + den) >= (n[0].cast("long") + n[1]) * num)


def overlap(a: np.ndarray, b: np.ndarray, need: int, depth: int = 2) -> int:
    """Size of the intersection of sorted sets, or -1 once it can't reach ``need`` (suffix filter, halving both sets)."""
    if bound(a, b, depth) < need:
        return -1
    return len(np.intersect1d(a, b, assume_unique=True))


def bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    if depth == 0 or len(a) < 8 or len(b) < 8:
        return min(len(a), len(b))
    half = len(a) // 2
    cut = int(np.searchsorted(b, a[half]))
    return bound(a[:half], b[:cut], depth - 1) + bound(a[half:], b[cut:], depth - 1)


def bits(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key in a filter of 2**size bits."""
    h = arrays.mix(keys.astype(np.int64).view(np.uint64))
    return (h >> np.uint64(64 - size)).astype(np.int64), (h & np.uint64((1 << size) - 1)).astype(np.int64)


def filter_of(keys: DataFrame, most_bits: int = FILTER_BITS[1]) -> np.ndarray | None:
    """A filter that all keys in the column of a written table pass, and one other in twenty at most; none if it would be too large."""
    size = max(FILTER_BITS[0], (KEY_BITS * keys.count()).bit_length())
    if size > most_bits:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << (size - 3), np.uint8)
        for batch in batches:
            for at in bits(batch.column(0).to_numpy(), size):
                np.bitwise_or.at(on, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if on.any():
            yield sliced(on)

    return fold(keys.mapInArrow(run, "slice int, blob binary"), "u1", np.bitwise_or)


def passes(on: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(on):
        return np.zeros(len(keys), bool)
    x, y = bits(keys, len(on).bit_length() + 2)
    return ((on[x >> 3] >> (x & 7)) & (on[y >> 3] >> (y & 7)) & 1).astype(bool)


def verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs (a, b) that link. Of each class that occurs, one document's set is gathered, the one with the smallest
    doc_id; a filter finds these documents in the scan, or, if they are too many for one, a join."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    chosen = sets.join(wanted, "sid").groupBy("sid").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("doc_id")).select("doc_id")
    chosen = scratch.save(chosen, f"{name}-chosen")
    on = filter_of(chosen)
    marked = docs.sparkSession.sparkContext.broadcast(on)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.text_slices(batches, "text"):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hit = np.arange(len(ids)) if marked.value is None else np.flatnonzero(passes(marked.value, ids))
            own = [next(shingle_sets(data[offsets[k] : offsets[k + 1]], offsets[k : k + 2] - offsets[k], size))[0] for k in hit.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([signature(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["sid", "grams"])

    with_id = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    if on is None:
        with_id = with_id.join(chosen.distinct(), "doc_id", "left_semi").select("doc_id", "text")
    # a few more come through the filter or share a null id; a set that comes twice gives the same links again
    gathered = scratch.save(with_id.mapInArrow(gather, "sid long, grams binary"), f"{name}-sets", "lz4")
    marked.destroy()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                need = -(-num * (len(a) + len(b)) // (num + den))
                both = overlap(a, b, need)
                keep.append(both >= need)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(gathered.select(F.col("sid").alias("a"), F.col("grams").alias("grams_a")), "a")
    two = one.join(gathered.select(F.col("sid").alias("b"), F.col("grams").alias("grams_b")), "b")
    links = scratch.save(two.select("a", "b", "grams_a", "grams_b").mapInArrow(check, "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-chosen")
    scratch.release()
    return links


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and root (the least node) of all nodes that have an edge (a, b), by alternating large and small stars."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    state, mark, turn = scratch.save(both, f"{name}-0"), None, 0
    while True:
        way = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, as joins below split hot nodes only if they deal both of their sides
        least = scratch.save(way.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-{turn}-a")
        large = scratch.save(way.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-{turn}-b")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{turn}-c")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        turn += 1
        state = scratch.save(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", *(f"{name}-{turn - 1}-{x}" for x in "abc"))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def rooted(docs: DataFrame, size: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """doc_id, row, n_shingles and root of every document; those of a component have the same root."""
    docs = bounded(docs)
    sets, level = document_sets(docs, size, scratch)
    context = docs.sparkSession.sparkContext
    levels = context.broadcast(level)
    lists = scratch.save(postings(docs, size, num, den, levels), "lists")
    levels.destroy()
    shared = lists.groupBy("gram").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low != high").select("gram")
    shared = scratch.save(shared, "grams")
    scratch.release()
    on = filter_of(shared)
    marked = context.broadcast(on)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # most n-grams have one text only; they needn't go through the join
            yield batch.filter(pa.array(passes(marked.value, batch.column(0).to_numpy())))

    some = lists.select("gram", "sid", "n", "pos")
    some = some if on is None else some.mapInArrow(sift, "gram long, sid long, n int, pos int")
    lists = scratch.save(some.join(shared, "gram").distinct(), "shared")
    marked.destroy()
    scratch.drop("lists", "grams")
    scratch.release()
    # written, so that the join deals both of its sides and may split hot lists
    hubs = scratch.save(lists.groupBy("gram").agg(F.min(F.struct("pos", "n", "sid")).alias("hub")), "hubs")
    near = may_link(num, den, (F.col("n"), F.col("hub.n")), (F.col("pos"), F.col("hub.pos")))
    stars = lists.join(hubs, "gram").filter((F.col("sid") != F.col("hub.sid")) & near)
    pairs = scratch.save(stars.select(F.greatest("sid", "hub.sid").alias("a"), F.least("sid", "hub.sid").alias("b")).distinct(), "pairs")
    scratch.release()
    links = verify(pairs, docs, sets, size, num, den, scratch, "stars")
    roots = components(links, scratch, "first")

    label = F.coalesce("root", "sid")
    labelled = lists.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("gram", "sid", "n", "pos", label.alias("label"))
    labelled = scratch.save(labelled, "labelled")
    mixed = scratch.save(labelled.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("gram"), "mixed")
    labelled = scratch.save(labelled.join(mixed, "gram"), "split")
    counts = labelled.groupBy("gram", "label").agg(F.count("*").alias("members"))
    most = counts.groupBy("gram").agg(F.max(F.struct("members", "label")).alias("most")).select("gram", F.col("most.label").alias("most"))
    most = scratch.save(most, "most")
    # a posting knows the first of the earlier n-grams of its set; a pair that shares one of them comes from an earlier list, and it
    # always comes from the list of the first n-gram it shares
    place = F.struct("pos", "gram", "n", "label", "most")
    own = labelled.join(most, "gram").groupBy("sid").agg(F.sort_array(F.collect_list(place)).alias("own"))
    each = own.select("sid", "own", F.posexplode("own").alias("k", "p")).select("sid", "p.*", F.slice(F.transform("own", lambda o: o["gram"]), F.lit(1), F.least("k", F.lit(EARLIER))).alias("before"))
    members = scratch.save(each, "members")
    one, two = members.filter("label != most").alias("x"), members.alias("y")
    near = may_link(num, den, (F.col("x.n"), F.col("y.n")), (F.col("x.pos"), F.col("y.pos")))
    crossed = one.join(two, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") != F.col("y.label")) & near & ~F.arrays_overlap("x.before", "y.before"))
    rest = crossed.select(F.greatest("x.sid", "y.sid").alias("a"), F.least("x.sid", "y.sid").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    rest = scratch.save(rest, "rest")
    if not rest.isEmpty():
        links = links.unionByName(verify(rest, docs, sets, size, num, den, scratch, "rest"))
        roots = components(links, scratch, "second")

    found = sets.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "row", "n_shingles", F.coalesce("root", "sid").alias("root"))
    return scratch.save(found, "rooted")


def join(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every document. Documents link
    whose sets have den * intersection >= num * union."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    every = rooted(docs, size, num, den, scratch).drop("row")
    some = every.filter("n_shingles > 0")
    least = scratch.save(some.groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    found = some.join(least, "root").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return found.unionByName(every.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def deduplicate(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, with all its columns: one with the smallest doc_id (null only if there is no other). Rows are told
    apart by doc_id and text; of those that repeat one stays. Rows without n-grams all stay."""
    scratch = Scratch(docs.sparkSession, "near")
    some = rooted(docs, size, num, den, scratch).filter("n_shingles > 0")
    best = some.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"), F.count("*").alias("n"))
    best = scratch.save(best.filter("n > 1").select("root", "best.doc_id", "best.row").toDF("root", "best_id", "best_row"), "best")
    kept = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("row") == F.col("best_row"))
    each = some.join(best, "root").groupBy("doc_id", "row").agg(F.max(kept).alias("kept"), (F.count("*") > 1).alias("twice"))
    return keep_one(docs, each, scratch)
