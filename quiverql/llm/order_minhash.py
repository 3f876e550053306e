"""Near-duplicates by order MinHash, verified by banded alignment.

A text is its sequence of words; its k-mers are five-word shingles, each labelled with its occurrence. Each of
SKETCHES hash functions samples the PER least labelled k-mers and keeps them in text order, so that texts at a
small edit distance share samples. Texts with a common sample meet their bucket's first and last text; a pair is
a link if the edit similarity of its word sequences, by an alignment in a band around the diagonal, is at least
SIMILAR. Texts that no links join to their bucket's first or last meet one another if they are FEW; else they
are dealt anew by samples of what they don't share with the first, until no bucket has more than FEW such
texts. Classes are the connected components of links.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Workspace, documents, likely_among, slices
from .components import components

SHINGLE, SKETCHES, PER, SIMILAR = 5, 24, 2, 0.8
#: Sketches whose buckets are looked at first; the later ones only verify pairs that the first have not joined.
FIRST = 8
#: Neighbouring words that are counted before two texts are aligned.
GRAM = 2
#: Texts of a bucket that meet one another; of more, each is dealt anew by its shingles of APART words.
FEW, APART = 12, 3
#: Parts that a class is dealt to when its texts learn its first one.
SALTS = 8
#: Words whose hash a worker remembers; a full table is emptied.
MEMO = 200_000
MULTIPLIERS = np.random.default_rng(20190701).integers(1, 1 << 62, SKETCHES + SHINGLE + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def sketch(raw: bytes, known: Words) -> np.ndarray:
    """One number for each hash function; texts of fewer than five words are one k-mer of all their words."""
    words = raw.split()
    if len(known) > MEMO:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) if words else np.array([xxhash.xxh3_64_intdigest(raw)], np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    kmers = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        kmers = (kmers ^ (kmers >> np.uint64(31))) * MULTIPLIERS[SKETCHES + k] + h[k : k + n]
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    if (ranked[1:] == ranked[:-1]).any():
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        at = np.arange(n)
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        kmers = kmers + occurrence * MULTIPLIERS[-1]
    out = np.empty(SKETCHES, np.uint64)
    for low in range(0, SKETCHES, max(1, (1 << 22) // n)):
        high = min(SKETCHES, low + max(1, (1 << 22) // n))
        mixed = ((kmers ^ (kmers >> np.uint64(29)))[None, :] * MULTIPLIERS[low:high, None]).view(np.int64)
        own = np.arange(high - low)
        value, places = np.zeros(high - low, np.uint64), []
        for _ in range(min(PER, n)):
            places.append(mixed.argmin(axis=1))
            mixed[own, places[-1]] = np.iinfo(np.int64).max
        for place in np.sort(places, axis=0):
            value = (value ^ (value >> np.uint64(32))) * MULTIPLIERS[-2] + kmers[place]
        out[low:high] = value
    return out.astype(np.int64)


def shingles(raw: bytes, known: Words) -> np.ndarray:
    """The hash of the APART words from each place on."""
    h = np.fromiter(map(known.__getitem__, raw.split()), np.uint64)
    n = max(min(1, len(h)), len(h) - APART + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(APART, len(h))):
        out = (out ^ (out >> np.uint64(31))) * MULTIPLIERS[SKETCHES + k] + h[k : k + n]
    return out


def own_keys(raw: bytes, other: np.ndarray, own: bytes | None, known: Words) -> tuple[np.ndarray, bytes]:
    """Buckets of a text by what it doesn't share with a text of the given shingles, and the bits of the shingles that are left to it.

    Each hash function samples the least shingle that is left (odd numbers). A text nearly all of which is in
    others has its first samples again, each with its length in steps of a quarter and the next one (even
    numbers): texts alike in length share one of the two. There are none if nothing was taken from it, so that
    every text's turns end.
    """
    if len(known) > MEMO:
        known.clear()
    every = shingles(raw, known)
    before = np.ones(len(every), bool) if own is None else np.unpackbits(np.frombuffer(own, np.uint8), count=len(every)).astype(bool)
    left = before & ~np.isin(every, other)
    bits = np.packbits(left).tobytes()
    if (left == before).all():
        return np.empty(0, np.int64), bits
    rest, keys = np.unique(every[left]), []
    if len(rest):
        mixed = rest ^ (rest >> np.uint64(29))
        least = np.array([rest[(mixed * m).argmin()] for m in MULTIPLIERS[:SKETCHES]])
        keys.append(((least ^ (least >> np.uint64(32))) * MULTIPLIERS[-2] + MULTIPLIERS[:SKETCHES]) | np.uint64(1))
    if 4 * left.sum() <= len(every):
        step = int(np.log(len(raw.split())) / np.log(1.25))
        first = sketch(raw, known).astype(np.uint64)
        keys += [((first ^ (first >> np.uint64(32))) * MULTIPLIERS[:SKETCHES] + np.array([step + more], np.uint64) * MULTIPLIERS[-2]) & ~np.uint64(1) for more in (0, 1)]
    return np.unique(np.concatenate(keys)).astype(np.int64), bits


def alike(one: bytes, two: bytes, least: float = SIMILAR) -> bool:
    """Whether the edit similarity of the word sequences, 1 - distance / words of the longer, is at least that.

    The distance is bounded from below by lengths, common words and common pairs of neighbours, from above by an
    alignment at words that stand once; between the bounds, alignments in a band decide. Memory is a few times
    that of the texts; time is their length times the distance at worst.
    """
    a, b = one.split(), two.split()
    if not a or not b:
        return one == two
    longest = max(len(a), len(b))
    limit = int((1 - least) * longest + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    names: dict[bytes, int] = {}
    x = np.array([names.setdefault(w, len(names)) for w in a], np.int64)
    y = np.array([names.setdefault(w, len(names)) for w in b], np.int64)
    here, there = np.bincount(x, minlength=len(names)), np.bincount(y, minlength=len(names))
    if longest - np.minimum(here, there).sum() > limit:
        return False
    if anchored(x, y, (here == 1) & (there == 1)) <= limit:
        return True
    # an edit changes GRAM of the longer text's n-grams at most
    if longest - GRAM + 1 - common(x, y, len(names)) > GRAM * limit:
        return False
    band = min(limit, max(32, abs(len(x) - len(y))))
    while not within(x, y, band):
        if band == limit:
            return False
        band = min(limit, 4 * band)
    return True


def common(x: np.ndarray, y: np.ndarray, names: int) -> int:
    """How many n-grams of two neighbours both have, as often as both have them."""
    kinds, at = np.unique(np.concatenate([x[:-1] * names + x[1:], y[:-1] * names + y[1:]]), return_inverse=True)
    n = max(0, len(x) - 1)
    return int(np.minimum(np.bincount(at[:n], minlength=len(kinds)), np.bincount(at[n:], minlength=len(kinds))).sum())


def anchored(x: np.ndarray, y: np.ndarray, once: np.ndarray) -> int:
    """An upper bound of the distance: words that stand once in either text are aligned as far as they keep their order, and what lies between is replaced, word by word where it is as long."""
    a = np.flatnonzero(once[x])
    where = np.empty(len(once), np.int64)
    where[y] = np.arange(len(y))
    b = where[x[a]]
    if len(b) and (np.diff(b) < 0).any():
        rising = longest_rising(b)
        a, b = a[rising], b[rising]
    a, b = np.concatenate([[-1], a, [len(x)]]), np.concatenate([[-1], b, [len(y)]])
    gap, other = np.diff(a) - 1, np.diff(b) - 1
    even = gap == other
    size = gap[even]
    i = np.repeat(a[:-1][even] + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
    j = i + np.repeat((b - a)[:-1][even], size)
    return int(np.maximum(gap, other)[~even].sum() + (x[i] != y[j]).sum())


def longest_rising(values: np.ndarray) -> np.ndarray:
    """Places of a longest increasing subsequence."""
    ends: list[int] = []
    last: list[int] = []
    before = []
    for at, value in enumerate(values.tolist()):
        k = bisect_left(ends, value)
        before.append(last[k - 1] if k else -1)
        if k == len(ends):
            ends.append(value)
            last.append(at)
        else:
            ends[k], last[k] = value, at
    out, at = [], last[-1]
    while at >= 0:
        out.append(at)
        at = before[at]
    return np.array(out[::-1])


def within(x: np.ndarray, y: np.ndarray, limit: int) -> bool:
    """Whether at most limit insertions, deletions and replacements turn x into y.

    Rows of the alignment, as far as the band of limit diagonals to either side reaches; a row that is beyond
    the limit everywhere ends it. It holds a few rows, whatever the texts' length.
    """
    same = min(len(x), len(y))
    head = int(np.argmin(np.append(x[:same] == y[:same], False)))
    x, y, same = x[head:], y[head:], same - head
    tail = int(np.argmin(np.append(x[::-1][:same] == y[::-1][:same], False)))
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    n, m = len(x), len(y)
    if abs(n - m) > limit:
        return False
    if not n or not m:
        return True
    # cell k of row i is column i + k - limit; columns outside the text differ from every word
    far, width = np.int32(1 << 30), 2 * limit + 1
    places = np.arange(width, dtype=np.int32)
    padded = np.concatenate([np.full(limit + 1, -1, np.int64), y, np.full(limit + n + 1, -1, np.int64)])
    row = np.where(places >= limit, places - limit, far).astype(np.int32)
    for i in range(1, n + 1):
        new = row + (padded[i : i + width] != x[i - 1])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        if i <= limit:
            new[: limit - i] = far
            new[limit - i] = i
        row = np.minimum.accumulate(new - places) + places
        if row.min() > limit:
            return False
    return bool(row[limit + m - n] <= limit)


def sketched(frame: DataFrame) -> DataFrame:
    """doc_id, print (MD5 of the text) and sketch of every text that isn't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in slices(batches):
            made = [sketch(t.encode("utf-8", "surrogatepass"), known) for t in batch.column("text").to_pylist()]
            flat = pa.array(np.concatenate(made)) if made else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * SKETCHES), flat)], names=["doc_id", "print", "sketch"])

    return printed(frame).mapInArrow(run, "doc_id bigint, print binary, sketch array<bigint>")


def printed(frame: DataFrame) -> DataFrame:
    return documents(frame).where("text is not null").withColumn("print", F.unhex(F.md5("text")))


def sampled(texts: DataFrame, low: int, high: int) -> DataFrame:
    """print and its buckets by some of the hash functions."""
    return texts.select("print", F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda k: F.xxhash64(k, F.get("sketch", k))).alias("buckets"))


def rooted(texts: DataFrame, stars: DataFrame | None) -> DataFrame:
    """texts with the root of their component, their own print if they are in none."""
    if stars is None:
        return texts.withColumn("root", F.col("print"))
    return texts.join(stars.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))


def candidates(texts: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """a, b: each text with the first and the last of every bucket that it shares with others, where they aren't in one component already."""
    rows = rooted(texts, stars).select("print", "root", F.explode("buckets").alias("bucket"))
    place = F.struct("print", "root")
    ends = rows.groupBy("bucket").agg(F.min(place).alias("one"), F.max(place).alias("two"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").drop("low", "high")
    met = rows.join(ends, "bucket").select(F.explode(F.array(F.struct(F.col("print").alias("a"), F.col("one.print").alias("b"), (F.col("root") == F.col("one.root")).alias("joined")), F.struct(F.col("two.print").alias("a"), F.col("print").alias("b"), (F.col("root") == F.col("two.root")).alias("joined")))).alias("e")).select("e.*")
    return met.where("not joined").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def apart(texts: DataFrame, stars: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Of buckets whose texts were held against the first and the last: pairs a, b of all texts that are left, where they are few, and else print and pivot, the least of the first texts.

    A text is left if it is in neither component of the two; in a bucket of few texts all are.
    """
    rows = rooted(texts, stars).select("print", "root", F.explode("buckets").alias("bucket"))
    place = F.struct("print", "root")
    ends = rows.groupBy("bucket").agg(F.min(place).alias("one"), F.max(place).alias("two"), F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 3 and low <> high").drop("low", "high")
    left = rows.join(ends, "bucket").where(f"n <= {FEW} or (root <> one.root and root <> two.root)").select("bucket", "print", "root", F.col("one.print").alias("pivot"))
    left = space.save(left, "left")
    sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket", "n")
    left = left.join(sizes, "bucket")
    lists = left.where(f"n <= {FEW}").groupBy("bucket").agg(F.collect_list(place).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["print"] > x["print"]) & (y["root"] != x["root"])), lambda y: F.struct(x["print"].alias("a"), y["print"].alias("b")))))
    # odd buckets first: their pivot has the sample, so it takes something from the text
    pivots = left.where(f"n > {FEW}").groupBy("print").agg(F.min(F.struct(F.expr("bucket % 2 = 0").alias("even"), "pivot")).alias("m")).select("print", "m.pivot")
    return lists.select(F.explode(pairs).alias("e")).select("e.*").distinct(), pivots


def dealt(pivots: DataFrame, texts: DataFrame, before: DataFrame | None) -> DataFrame:
    """print, buckets and own (bits of its shingles) of texts, by what they don't share with their pivots now and before."""
    left = texts.select("print", F.col("text").alias("one"))
    right = texts.select(F.col("print").alias("pivot"), F.col("text").alias("two"))
    known_bits = pivots.withColumn("own", F.lit(None).cast("binary")) if before is None else pivots.join(before.select("print", "own"), "print", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, other = Words(), None, np.empty(0, np.uint64)
        for batch in slices(batches):
            buckets, bits = [], []
            for one, two, own, pivot in zip(*(batch.column(c).to_pylist() for c in ("one", "two", "own", "pivot")), strict=True):
                if pivot != last:
                    last, other = pivot, np.unique(shingles(two.encode("utf-8", "surrogatepass"), known))
                keys, rest = own_keys(one.encode("utf-8", "surrogatepass"), other, own, known)
                buckets.append(keys)
                bits.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column("print"), pa.array(buckets, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["print", "buckets", "own"])

    return known_bits.join(left, "print").join(right, "pivot").select("print", "pivot", "own", "one", "two").mapInArrow(run, "print binary, buckets array<bigint>, own binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts are alike. Each text goes to its pairs by two joins that may split hot texts; pairs are verified in their tasks."""
    left = texts.select(F.col("print").alias("a"), F.col("text").alias("one"))
    right = texts.select(F.col("print").alias("b"), F.col("text").alias("two"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            one, two = batch.column("one").to_pylist(), batch.column("two").to_pylist()
            good = [alike(p.encode("utf-8", "surrogatepass"), q.encode("utf-8", "surrogatepass")) for p, q in zip(one, two, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "one", "two").mapInArrow(run, "a binary, b binary")


def placed(frame: DataFrame) -> DataFrame:
    """doc_id, print, class_id, n_links and is_first of every row whose text isn't null."""
    space = Workspace(frame.sparkSession, "near-duplicates")
    rows = space.save(sketched(frame), "sketches")
    groups = rows.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sketch")).alias("least"))
    groups = space.save(groups.select("print", F.col("least.doc_id").alias("doc_id"), F.col("least.sketch").alias("sketch")), "texts")

    def texts_of(prints: DataFrame) -> DataFrame:
        used = prints.distinct().join(groups.select("print", "doc_id"), "print").select("print", F.xxhash64("print", "doc_id").alias("row"))
        # rows of no pair, and further copies of a text, stay where they were read; the others move once, by their print
        texts = likely_among(printed(frame).withColumn("row", F.xxhash64("print", "doc_id")), "row", used).drop("row").join(used.drop("row"), "print")
        return space.save(texts.select("print", "text").dropDuplicates(["print"]), "candidate-texts")

    def linked(pairs: DataFrame) -> DataFrame:
        texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("print")))
        found = space.save(verified(pairs, texts), "links")
        space.drop(texts)
        space.tidy()
        return found

    links, stars, tried = None, None, None
    for low, high in ((0, FIRST), (FIRST, SKETCHES)):
        pairs = space.save(candidates(sampled(groups, low, high), stars), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = linked(pairs)
        links = found if links is None else links.unionByName(found)
        stars = components(found if stars is None else found.unionByName(stars.select(F.col("node").alias("a"), F.col("root").alias("b"))), space)
        space.tidy()
    now, before = sampled(groups, 0, SKETCHES), None
    while True:
        pairs, pivots = apart(now, stars, space)
        pivots = space.save(pivots, "pivots")
        more = not pivots.isEmpty()
        if more:
            texts = texts_of(pivots.select(F.explode(F.array("print", "pivot")).alias("print")))
            now = before = space.save(dealt(pivots, texts, before), "dealt")
            space.drop(texts)
            space.tidy()
            pairs = pairs.unionByName(candidates(now, stars)).distinct()
        pairs = space.save(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            tried = tried.unionByName(pairs)
            found = linked(pairs)
            links = links.unionByName(found)
            stars = components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found), space)
        if not more:
            break
    counts = links.select(F.explode(F.array("a", "b")).alias("print")).groupBy("print").agg(F.count(F.lit(1)).alias("n_links"))
    placed = groups.select("print", "doc_id").join(stars.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    placed = space.save(placed, "roots")
    least = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("least"))
    # a class may have a third of all texts
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = placed.withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"]).join(counts, "print", "left")
    known = space.save(known.select("print", F.col("least.doc_id").alias("class_id"), F.col("least.print").alias("first"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "classes")
    out = rows.select("doc_id", "print").join(known, "print")
    return out.select("doc_id", "print", "class_id", "n_links", ((F.col("print") == F.col("first")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("is_first"))


def classes(frame: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (links of the text that were verified, a few for each bucket, not the number of its near copies) and is_first of every document.

    Pairs that others joined already aren't verified, so they count no link. Exact copies are one text from the
    start, so a group of copies costs one text. A null text is a class of its own; empty texts are equal. Texts
    under five words link only if their words agree. The first of a class is the text with the least doc_id (a
    null one is the greatest) and then the least MD5; rows equal in id and text all are first if one is. Other
    columns, whatever their names, have no say. No documents give no rows.
    """
    ours = placed(frame).drop("print")
    bare = documents(frame).where("text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("is_first"))
    return ours.unionByName(bare)


def firsts(frame: DataFrame) -> DataFrame:
    """The first row of each class, with all its columns: one of rows equal in id and text, and every row with a null text."""
    found = placed(frame).where("is_first").select(F.col("print").alias("first_print"), F.col("doc_id").alias("first_id")).distinct()
    whole = F.struct(*(F.col(f"`{c}`") for c in frame.columns))
    own = frame.where("text is not null").select(whole.alias("row"), F.unhex(F.md5(F.col("text").cast("string"))).alias("own_print"), F.col("doc_id").cast("bigint").alias("own_id"))
    stay = own.join(found, (F.col("own_print") == F.col("first_print")) & F.col("own_id").eqNullSafe(F.col("first_id"))).dropDuplicates(["own_print", "own_id"])
    return stay.select(*(F.col("row")[c].alias(c) for c in frame.columns)).unionByName(frame.where("text is null"))
