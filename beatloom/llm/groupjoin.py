"""Exact Jaccard join of shingle sets by a token-group matrix.

A document is the set of its four-word shingles, hashed to 64 bits; two link when 100 * intersection >= 85 * union.

1. A histogram of all shingles over 2 ** HISTOGRAM_BITS hash buckets orders them: those of emptier buckets first, then by hash. It only
   orders, so buckets that several shingles share cost time, never a link. It is the one thing that tasks get whole, and its size is fixed.
2. Equal sets are one representative, the least id (aggregated before the shuffle).
3. Similar documents fall into parts: representatives that share a minimum hash, of KEYS of them, are held against one of theirs, its
   leader, unless their bitmaps (5.) exclude it, and what links is one class already. Each class of several is a part; what is left shares parts with others of its first
   minimum hash. A part is cut into groups of about GROUP_DOCS documents and at most about GROUP_SHINGLES shingles.
4. Of two sets of sizes x <= y that link, one of the y - ceil(0.85 y) + 1 first shingles of y is one of the x - ceil(2 * 0.85 / 1.85 x) + 1
   first of x, so a query finds all parts it can have a link in by its first shingles. Documents query parts of larger classes, and,
   where both are alone, of smaller sets; so of a family of thousands only the stragglers ask, and never their own class.
5. A set has a bitmap of BITS to 2 * BITS bits a shingle. What one bitmap has alone, its set has alone, so two bitmaps bound the overlap from
   above. Groups of a part lie together in slabs; a query meets a slab once, by bitmaps, and groups of which no member can link to it stay closed.
6. Groups within the bound are opened and their members that any query can link to are counted exactly: first, for each query, the best
   group of each class and the best of documents in no class; then, once classes that linked are one, all the others that still have
   members of another class.
7. The components of all links are the classes.

No estimate decides anything, so no link is lost. A group gives a query at most one link a class. Groups and slabs with very many queries
are dealt out in parts of QUERY_ROWS, each with a copy of them.

Cases: null and wordless texts have an empty set and no link; texts of fewer than four words are one shingle; rows that repeat an id
have one class, linked by any of their texts; rows with a null id are linked to nothing and have a null component; an
empty table gives an empty result; extra columns are ignored. Texts are used whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .neardup import Shingler, leader_links

WORDS, PERCENT = 4, 85
HISTOGRAM_BITS, CHUNK = 22, 1 << 12
GROUP_DOCS, GROUP_SHINGLES, SLAB_DOCS, SLAB_SHINGLES, QUERY_ROWS = 64, 400_000, 1024, 4_000_000, 256
PICK_BITS = 25
KEYS, BITS, TOKEN_BITS = 4, 2, 48
_TURNS = np.random.default_rng(13).integers(0, 1 << 63, size=KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - HISTOGRAM_BITS)).astype(np.int64)


def shingle_classes(docs: DataFrame) -> np.ndarray:
    """The binary order of magnitude of each bucket's count over all documents, a byte a bucket.

    A task adds up its own documents; chunks of the histogram are summed in as many tasks as there are chunks.
    """

    @common.in_task
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, counts = Shingler(WORDS), np.zeros(1 << HISTOGRAM_BITS, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(counts, _bucket(shingles(text)), 1)
        parts = counts.reshape(-1, CHUNK)
        for first in range(0, len(parts), 256):
            rows = [(k, zlib.compress(parts[k].tobytes(), 1)) for k in range(first, first + 256) if parts[k].any()]
            yield pd.DataFrame(rows, columns=["chunk", "counts"])

    @common.in_task
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total = None, None
        for batch in batches:
            out = []
            for chunk, counts in zip(batch["chunk"].tolist(), batch["counts"], strict=True):
                if chunk != own:
                    if own is not None:
                        out.append((own, _magnitude(total)))
                    own, total = chunk, np.zeros(CHUNK, dtype=np.int64)
                total += np.frombuffer(zlib.decompress(counts), dtype=np.int64)
            yield pd.DataFrame(out, columns=["chunk", "classes"])
        if own is not None:
            yield pd.DataFrame([(own, _magnitude(total))], columns=["chunk", "classes"])

    parts = docs.select("text").mapInPandas(counted, "chunk int, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    out = np.zeros(1 << HISTOGRAM_BITS, dtype=np.uint8)
    for r in parts.mapInPandas(summed, "chunk int, classes binary").toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["classes"], dtype=np.uint8)
    return out


def _magnitude(counts: np.ndarray) -> bytes:
    return np.frexp(counts.astype(np.float64))[1].astype(np.uint8).tobytes()


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares at least with a smaller one it links to."""
    return -(-PERCENT * n // 100)


def probe_length(n: int) -> int:
    return n - least_overlap(n) + 1


def index_length(n: Column) -> Column:
    """First shingles of a set of n by which larger sets find it."""
    return (n - F.ceil(2 * PERCENT * n / (100 + PERCENT)) + 1).cast("int")


def first_shingles(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The first shingles in the common order by which a set finds smaller ones, TOKEN_BITS of each: those that agree in them cost a look."""
    order = np.argsort(classes[_bucket(hashes)], kind="stable")  # hashes are sorted
    return (hashes[order[: probe_length(len(hashes))]] >> np.uint64(64 - TOKEN_BITS)).view(np.int64)


def minimum_hashes(hashes: np.ndarray) -> np.ndarray:
    return np.array([(hashes * turn).min() for turn in _TURNS], dtype=np.uint64).view(np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each value of a shingle's last bits, in a power of two of bits."""
    bits = np.zeros(max(64, 1 << (BITS * len(hashes) - 1).bit_length()), dtype=bool)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps, one a row, as they are in so many 64-bit words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class Bitmaps:
    """Bitmaps of sets with the sets' sizes, together."""

    def __init__(self, sizes: list[int], bits: list[bytes]):
        self.sizes = np.array(sizes, dtype=np.int64)
        widths = np.array([len(b) // 8 for b in bits])
        self.by_width = [(at, np.frombuffer(b"".join(bits[k] for k in at), dtype=np.uint64).reshape(len(at), -1)) for at in (np.flatnonzero(widths == w) for w in np.unique(widths))]

    def most_overlap(self, n: int, bits: bytes) -> np.ndarray:
        """No fewer shingles than a set of n with these bits shares with each set."""
        out, own = np.zeros(len(self.sizes), dtype=np.int64), np.frombuffer(bits, dtype=np.uint64).reshape(1, -1)
        for at, held in self.by_width:
            words = min(held.shape[1], own.shape[1])
            a, b = folded(own, words), folded(held, words)
            both = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64)
            alone = [np.bitwise_count(x).sum(axis=1, dtype=np.int64) - both for x in (a, b)]
            out[at] = np.minimum(n - alone[0], self.sizes[at] - alone[1])
        return out


def may_link(n: np.ndarray | int, m: np.ndarray | int, both: np.ndarray) -> np.ndarray:
    return (100 * both >= PERCENT * (n + m - both)) & (both > 0)


def sets_of(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """Stored: doc_id, n_shingles, sig (digest of the set), keys (minimum hashes), bits (bitmap) and tokens (first shingles) of every document; the last four null for empty sets."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingles = Shingler(WORDS)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                h = shingles(text)
                rows.append((doc_id, len(h), xxhash.xxh3_128_digest(h.tobytes()), minimum_hashes(h), bitmap(h), first_shingles(h, sent.value)) if len(h) else (doc_id, 0, None, None, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "sig", "keys", "bits", "tokens"])

    out = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n_shingles long, sig binary, keys array<long>, bits binary, tokens array<long>")
    return common.stored(out.withColumn("doc_id", F.col("doc_id").cast("long")), "shingle-sets")


def shared_keys(reps: DataFrame) -> DataFrame:
    """Stored: rep, n, turn, key: minimum hashes that several representatives have."""
    r = reps.select("rep", "n", F.posexplode("keys").alias("turn", "key"))
    several = r.groupBy("turn", "key").agg(F.count("*").alias("docs")).where("docs > 1").drop("docs")
    return common.stored(r.join(several, ["turn", "key"]), "shared-keys")


def with_classes(rows: DataFrame, classes: DataFrame, col: str) -> DataFrame:
    """rows with the present class of the class in a column. classes: id, component."""
    now = classes.select(F.col("id").alias(col), F.col("component").alias("__now"))
    return rows.join(now, col, "left").withColumn(col, F.coalesce("__now", col)).drop("__now")


def led(shared: DataFrame, bits: DataFrame) -> DataFrame:
    """Stored: a, b: representatives and the leaders, any one a key, of those with the same minimum hash, if their sizes and bitmaps allow a link.

    bits: doc_id, n, bits.
    """

    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            both = [Bitmaps([n], [b]).most_overlap(m, c)[0] for n, b, m, c in zip(x["n"], x["bits"], x["leader_n"], x["leader_bits"], strict=True)]
            yield x.loc[may_link(x["n"].to_numpy(), x["leader_n"].to_numpy(), np.array(both, dtype=np.int64)), ["a", "b"]]

    leader = shared.groupBy("turn", "key").agg(F.max_by(F.struct("rep", "n"), F.xxhash64("rep", "turn")).alias("leader"))
    near = 100 * F.least("n", "leader.n") >= PERCENT * F.greatest("n", "leader.n")
    pairs = shared.join(leader, ["turn", "key"]).where(near & (F.col("rep") != F.col("leader.rep")))
    pairs = common.stored(pairs.select(F.col("rep").alias("a"), F.col("leader.rep").alias("b")).distinct(), "leader-pairs")
    own = common.stored(picked(bits, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "leader-bits")
    rows = pairs.join(own.withColumnRenamed("doc_id", "a"), "a").join(own.select(F.col("doc_id").alias("b"), F.col("n").alias("leader_n"), F.col("bits").alias("leader_bits")), "b")
    out = common.stored(rows.mapInPandas(run, "a long, b long").distinct(), "leaders")
    for done in (pairs, own):
        common.drop_stored(done)
    return out


def grouped(reps: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Stored: rep, n, tokens, class_id, class_docs, part, slab and grp of every representative, and whether it is alone in its part.

    sets: sig, doc_id, tokens; classes: id, component of those that linked.
    """
    r = reps.select("sig", "rep", "n", "keys").join(classes.select(F.col("id").alias("rep"), F.col("component").alias("class_id")), "rep", "left")
    r = r.withColumn("part", F.when(F.col("class_id").isNull(), F.xxhash64(F.lit(1), F.col("keys")[0])).otherwise(F.xxhash64(F.lit(0), "class_id")))
    groups = F.greatest(F.ceil(F.count("*") / GROUP_DOCS), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int")
    sizes = r.groupBy("part").agg(groups.alias("groups"), F.greatest(F.ceil(F.count("*") / SLAB_DOCS), F.ceil(F.sum("n") / SLAB_SHINGLES)).cast("int").alias("slabs"), F.count("*").alias("docs"))
    place = F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int")
    r = r.join(sizes, "part").withColumns({
        "class_docs": F.when(F.col("class_id").isNull(), F.lit(1)).otherwise(F.col("docs")), "class_id": F.coalesce("class_id", "rep"),
        "grp": F.xxhash64("part", place), "slab": F.xxhash64("part", F.pmod(place, F.col("slabs")), F.lit("slab")),
    })
    r = r.select("sig", "rep", "n", "class_id", "class_docs", "part", "slab", "grp", (F.col("docs") == 1).alias("lone"))
    tokens = sets.select("sig", F.col("doc_id").alias("rep"), "tokens").dropDuplicates(["sig", "rep"])
    return common.stored(r.join(tokens, ["sig", "rep"]).drop("sig"), "token-groups")


def candidates(groups: DataFrame) -> DataFrame:
    """Stored: grp, slab, doc_id, class_id: representatives and slabs of other classes with a first shingle in common and sizes that allow a link.

    The matrix of first shingles holds a row a shingle and part; `of` is the part's class, or its one document, or null where several share it that are alone.
    """
    alone = F.col("class_docs") == 1
    kind = [F.when(~alone, F.col(c)).alias(o) for c, o in (("class_id", "of"), ("class_docs", "of_docs"))]
    many = groups.where("NOT lone").select("part", *kind, "n", F.explode(F.when(alone, F.slice("tokens", 1, index_length(F.col("n")))).otherwise(F.col("tokens"))).alias("t"))
    many = many.groupBy("t", "part", "of", "of_docs").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one = groups.where("lone").select(F.explode(F.slice("tokens", 1, index_length(F.col("n")))).alias("t"), "part", F.col("rep").alias("of"), F.lit(None).cast("long").alias("of_docs"), F.col("n").alias("low"), F.col("n").alias("high"))
    matrix = many.unionByName(one)
    probes = groups.select(F.col("rep").alias("q"), "n", F.when(~alone, F.col("class_id")).alias("q_class"), F.when(~alone, F.col("class_docs")).alias("q_docs"), F.explode("tokens").alias("token"))
    smaller = F.col("q_docs").isNull() | (F.col("q_docs") < F.col("of_docs")) | ((F.col("q_docs") == F.col("of_docs")) & (F.col("q_class") < F.col("of")))
    asks = F.when(F.col("of_docs").isNull(), F.col("q_docs").isNull() & (F.col("low") <= F.col("n")) & ~F.col("of").eqNullSafe(F.col("q"))).otherwise(smaller & (PERCENT * F.col("low") <= 100 * F.col("n")))
    found = probes.join(matrix, (probes["token"] == matrix["t"]) & (100 * F.col("high") >= PERCENT * F.col("n")) & asks)
    found = found.select("q", "n", F.coalesce("q_class", "q").alias("class_id"), "part").distinct()
    slabs = groups.groupBy("part", "slab").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    fits = (PERCENT * F.col("low") <= 100 * F.col("n")) & (100 * F.col("high") >= PERCENT * F.col("n"))
    return common.stored(found.join(slabs, "part").where(fits).select("slab", F.col("q").alias("doc_id"), "class_id"), "slab-queries")


def picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those rows whose doc_id is among ids, and few others, without a shuffle of rows.

    They are told by a bitmap of 2 ** PICK_BITS hashes of ids, which has that size whatever the input. A join with ids may follow.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << PICK_BITS))
    bits = ids.select(bit("doc_id").alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    found = rows.withColumn("bit", bit("doc_id")).join(F.broadcast(bits.withColumnRenamed("bits", "ids")), F.bitmap_bucket_number("bit") == F.col("bucket"))
    at = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("ids", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def _dealt(queries: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """What is held of each key (first = 0) and its queries (first = 1), in parts (deal) of about QUERY_ROWS; both without texts yet."""
    deals = queries.groupBy(key).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("deals"))
    own = queries.join(deals, key).withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.col("deals")).cast("int")).drop("deals").withColumn("first", F.lit(1))
    held = held.join(deals, key).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals").withColumn("first", F.lit(0))
    return held.unionByName(own, allowMissingColumns=True)


def bounded(queries: DataFrame, cells: DataFrame, bits: DataFrame) -> DataFrame:
    """Stored: doc_id, class_id, grp, most: groups with members of other classes that queries may link to, and their likeness at most, in millionths.

    Those members too, with most null. queries: slab, doc_id, class_id; cells: slab, grp, doc_id, class_id; bits: doc_id, n, bits.
    """
    columns = ["doc_id", "class_id", "grp", "most"]

    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held, slab = None, [], None

        def met() -> list[tuple]:
            return [(*held[k][:3], None) for k in np.flatnonzero(slab[3])] if slab else []

        for batch in batches:
            out = []
            for key, deal, first, *row in zip(*[batch[c].tolist() for c in ("slab", "deal", "first", "doc_id", "class_id", "grp", "n", "bits")], strict=True):
                if (key, deal) != own:
                    out += met()
                    own, held, slab = (key, deal), [], None
                if first == 0:
                    held.append(row)
                    continue
                if not held:
                    continue
                slab = slab or (Bitmaps([r[3] for r in held], [r[4] for r in held]), np.array([r[1] for r in held]), np.array([r[2] for r in held]), np.zeros(len(held), dtype=bool))
                doc_id, class_id, _, n, own_bits = row
                maps, classes, grps, seen = slab
                both = maps.most_overlap(n, own_bits)
                hit = np.flatnonzero(may_link(n, maps.sizes, both) & (classes != class_id))
                seen[hit] = True
                best = {}
                for grp, likeness in zip(grps[hit].tolist(), (1_000_000 * both[hit] // (n + maps.sizes[hit] - both[hit])).tolist(), strict=True):
                    best[grp] = max(best.get(grp, 0), likeness)
                out += [(doc_id, class_id, grp, most) for grp, most in best.items()]
            yield pd.DataFrame(out, columns=columns).astype("Int64")
        yield pd.DataFrame(met(), columns=columns).astype("Int64")

    rows = common.stored(_dealt(queries, cells.select("slab", "grp", "doc_id", "class_id"), "slab"), "slab-deals")
    dealt = rows.join(picked(bits, rows.select("doc_id").distinct()), "doc_id").repartition("slab", "deal").sortWithinPartitions("slab", "deal", "first")
    dealt = dealt.select("slab", "deal", "first", "doc_id", "class_id", F.coalesce("grp", F.lit(0).cast("long")).alias("grp"), "n", "bits")
    out = common.stored(dealt.mapInPandas(run, "doc_id long, class_id long, grp long, most long").distinct(), "group-bounds")
    common.drop_stored(rows)
    return out


class Sets:
    """Sorted sets with their ids, together."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sizes = np.array(ids, dtype=np.int64), np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate([np.zeros(0, dtype=np.uint64), *sets])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def overlaps(self, h: np.ndarray) -> np.ndarray:
        """How many elements of the set h each set has."""
        low, n = np.searchsorted(self.tokens, h, "left"), np.searchsorted(self.tokens, h, "right")
        n -= low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.ids))


def links(queries: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: links of queries to members of the groups opened for them, one a class. Both: grp, doc_id, class_id; texts: doc_id, text."""

    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, own, ids, classes, sets, group = Shingler(WORDS), None, [], [], [], None  # of one group and deal at a time
        for batch in batches:
            out = []
            for grp, deal, first, doc_id, class_id, text in zip(*[batch[c] for c in ("grp", "deal", "first", "doc_id", "class_id", "text")], strict=True):
                if (grp, deal) != own:
                    own, ids, classes, sets, group = (grp, deal), [], [], [], None
                h = shingles(text)
                if first == 0:
                    ids.append(doc_id)
                    classes.append(class_id)
                    sets.append(h)
                elif len(h):
                    group = group or Sets(ids, sets)
                    both, of = group.overlaps(h), np.array(classes, dtype=np.int64)
                    hit = np.flatnonzero((100 * both >= PERCENT * (len(h) + group.sizes - both)) & (of != class_id) & (both > 0))
                    out += [(doc_id, b) for b in group.ids[hit[np.unique(of[hit], return_index=True)[1]]].tolist()]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = common.stored(_dealt(queries, members, "grp"), "group-deals")
    rows = rows.join(picked(texts, rows.select("doc_id").distinct()), "doc_id").repartition("grp", "deal").sortWithinPartitions("grp", "deal", "first")
    return rows.select("grp", "deal", "first", "doc_id", "class_id", "text").mapInPandas(run, "a long, b long")


def linked_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    s = sets_of(docs, shingle_classes(docs))
    with_set = s.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    reps = with_set.groupBy("sig").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(o) for c, o in (("n_shingles", "n"), ("keys", "keys"), ("bits", "bits"))])
    reps = common.stored(reps, "set-reps")
    texts, bits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), reps.select(F.col("rep").alias("doc_id"), "n", "bits")
    shared = shared_keys(reps)
    leaders = led(shared, bits)
    near = common.stored(picked(texts, leaders.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "led-texts")
    known = common.stored(leader_links(near, leaders, PERCENT, WORDS).distinct(), "leader-links")
    classes = components(known)
    groups = grouped(reps, with_set, classes)
    asked = candidates(groups)
    for done in (shared, leaders, near, classes):
        common.drop_stored(done)
    cells = groups.select("slab", "grp", F.col("rep").alias("doc_id"), "class_id", F.when(F.col("class_docs") > 1, F.col("class_id")).alias("of"))
    cells = common.stored(cells.join(asked.select("slab").distinct(), "slab", "left_semi"), "token-cells")
    common.drop_stored(groups)
    found = bounded(asked, cells, bits)
    met = common.stored(picked(texts, found.select("doc_id").distinct()), "met-texts")
    members = found.where("most IS NULL").drop("most")
    bounds = common.stored(found.where("most IS NOT NULL").join(cells.groupBy("grp").agg(F.max("of").alias("of")), "grp"), "group-classes")
    # the best group of each class, and the best one of documents that are in no class
    best = bounds.groupBy("doc_id", "class_id", "of").agg(F.max(F.struct("most", "grp")).alias("best"))
    best = common.stored(best.select("doc_id", "class_id", F.col("best.grp").alias("grp")), "best-groups")
    first = common.stored(known.unionAll(links(best, members, met)), "first-links")
    between = components(first)
    members = common.stored(with_classes(members, between, "class_id"), "member-classes")
    of = members.groupBy("grp").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"))
    rest = with_classes(bounds.join(best, ["doc_id", "grp"], "left_anti"), between, "class_id").join(of, "grp").where("low <> class_id OR high <> class_id")
    rest = common.stored(rest.select("doc_id", "class_id", "grp"), "other-groups")
    got = common.stored(first.unionAll(links(rest, members, met)), "set-links")
    comps = components(got)
    by_set = common.stored(reps.join(comps, reps["rep"] == comps["id"], "left").select("sig", F.coalesce("component", "rep").alias("component_id")), "set-classes")
    for done in (reps, known, asked, cells, found, met, bounds, best, first, between, members, rest, got, comps):
        common.drop_stored(done)
    keyed = s.select("doc_id", "n_shingles", F.coalesce(F.col("sig"), F.col("doc_id").cast("string").cast("binary")).alias("sig"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return keyed.join(by_set, "sig", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def op13_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of linked documents of all documents."""
    return linked_classes(common.table(spark, sf_dir, "documents"))
