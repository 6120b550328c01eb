"""Near-duplicates by HyperMinHash.

A document is the set of its five-word shingles, hashed to 64 bits. Its sketch has REGISTERS registers; a register keeps, of
the least hash that falls to it, the number of leading zeros and the next MANTISSA bits, 16 bits in all. Unfilled
registers copy filled ones, chosen by a fixed rule, so short documents band as well as long ones.

1. Documents with equal sets are one representative, the least id (aggregated before the shuffle, so a text copied a
   million times is one row a task).
2. BANDS bands (LOW_BANDS for a threshold below PERCENT) of ROWS registers each make keys. Representatives that share a key are joined to one of them, first inside
   each Arrow batch and then inside each shuffled partition, so a key shared by very many costs a row a batch. The
   components of these edges are the families: two documents that should be linked are in one family but for a chance
   below one in a hundred thousand at the threshold itself, from 80 percent on (3e-6 there, if registers were independent).
   Each representative also names the one of its batch, and of its partition, with which it shares most bands: its leader.
3. Links to leaders are checked on full sets, streamed by leader, a set of each side at a time. Their components are the parts of a family.
   Most families are one part then, and done, at the cost of one look at each document.
4. In the others, what is not in the largest part is checked against the whole family, but for pairs within a part, by blocks: a
   group of such documents with a group of the family's, so no task gathers a large family. In a task, the collision-corrected
   Jaccard estimate of the sketches picks pairs, wide of the threshold by five standard errors, and the full sets decide. A
   task gives a spanning forest of its links, at most a row a document, never the pairs.
5. The components of all those links are the result.

Cases: null and wordless texts have an empty set and no link; texts of fewer than five words are one shingle; rows that repeat
an id, which must repeat its text, have one component and are all kept if it is theirs; rows with a null id are linked to nothing, have a null
component and are kept; an empty table gives an empty result; extra columns are ignored. Whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, REGISTERS, MANTISSA, BANDS, ROWS = 5, 256, 10, 96, 10
#: Links: 100 * intersection >= PERCENT * union, unless a caller names another threshold; below it there are LOW_BANDS bands.
PERCENT, LOW_BANDS = 85, 112
#: A family's blocks: at most BLOCK_DOCS documents for small families, and about BLOCK_SHINGLES shingles.
BLOCK_DOCS, MOST_SMALL_BLOCKS, BLOCK_SHINGLES = 128, 16, 400_000
#: Documents that are held against a copy of their leader in one go.
LEADER_ROWS = 256

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_mix = common.mixed

# A number for each byte, the same for A-Z and a-z; and the bytes that part words.
_BYTE = np.random.default_rng(5).integers(0, 1 << 64, size=256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, words: int = WORDS) -> None:
        self.spans, self.n_words = common.SpanHashes(), words

    def words(self, text: str) -> np.ndarray:
        """Hashes of the words, from the bytes of the UTF-8 text."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = ~_BLANK[data]
        edge = np.diff(inside)
        return self.spans(_BYTE[data], np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.words(text) if text else np.zeros(0, dtype=np.uint64)
        if not len(h):
            return h
        if len(h) < self.n_words:
            out = np.full(1, len(h), dtype=np.uint64)
            for x in h:
                out = _mix(out * _PRIME + x)
            return out
        n = len(h) - self.n_words + 1
        out = np.full(n, self.n_words, dtype=np.uint64)
        for k in range(self.n_words):
            out = _mix(out * _PRIME + h[k : k + n])
        return np.unique(out)


# The order in which an unfilled register looks for a filled one.
_REGISTER_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(56)
_PROBES = np.random.default_rng(61).integers(0, REGISTERS, size=(REGISTERS, 64 * 8))
_BAND_REGISTERS = np.stack([np.random.default_rng(1000 + b).permutation(REGISTERS)[:ROWS] for b in range(LOW_BANDS)])


def compressed(values: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and the MANTISSA bits after the first one, of 56-bit values."""
    v = values >> np.uint64(4)  # 52 bits, exact as a float
    part, exponent = np.frexp(v.astype(np.float64))
    zeros = np.where(v > 0, 52 - exponent, 56)
    low = (part * (2 << MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
    return ((zeros << MANTISSA) | low).astype(np.uint16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a non-empty sorted set."""
    at = np.searchsorted(hashes, _REGISTER_STARTS)
    filled = np.append(at[1:], len(hashes)) > at
    out, first = np.zeros(REGISTERS, dtype=np.uint16), at[filled]
    out[filled] = compressed(hashes[first] & np.uint64((1 << 56) - 1))
    missing = np.flatnonzero(~filled)
    if len(missing):
        source = np.full(len(missing), int(filled.argmax()))
        left = np.arange(len(missing))
        for lo, hi in ((0, 16), (16, 64), (64, _PROBES.shape[1])):
            probes = _PROBES[missing[left], lo:hi]
            hit = filled[probes]
            found = hit.any(axis=1)
            source[left[found]] = probes[found, hit[found].argmax(axis=1)]
            left = left[~found]
            if not len(left):
                break
        # a copied value is marked by its register, so that it equals only copies of the same one
        out[missing] = out[source] ^ (source * 40503 & 0xFFFF).astype(np.uint16)
    return out


def bands_for(percent: int) -> int:
    return BANDS if percent >= PERCENT else LOW_BANDS


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(documents, bands) keys of (documents, REGISTERS) registers."""
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(registers), bands)).copy()
    for k in range(ROWS):
        keys = _mix(keys * _PRIME + registers[:, _BAND_REGISTERS[:bands, k]].astype(np.uint64))
    return keys


def collision_rate() -> float:
    """The chance that two registers of different least hashes are equal: equal leading zeros and mantissa."""
    return sum((2.0 ** -(z + 1)) ** 2 for z in range(56)) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of all rows of a against all of b."""
    same = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        same[i] = (b == row).mean(axis=1)
    c = collision_rate()
    return (same - c) / (1 - c)


SKETCH = "doc_id long, n_shingles long, sig binary, registers binary"


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sig (digest of the set) and registers of every document; the last two null for empty sets."""

    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingles = Shingler()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                h = shingles(text)
                if len(h):
                    rows.append((doc_id, len(h), xxhash.xxh3_128_digest(h.tobytes()), sketch(h).tobytes()))
                else:
                    rows.append((doc_id, 0, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "sig", "registers"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SKETCH)


def _forest(n: int, pairs: np.ndarray) -> list[int]:
    """Indexes of the pairs that join what was not joined before."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k, (i, j) in enumerate(pairs.tolist()):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
            out.append(k)
    return out


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least number that pairs join each number below n to."""
    root = np.arange(n)
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (root[a], root[b], a, b):
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of the least id of each key; edges (ids in rows of two) from each id to the least id that keys join it to; and
    from each id to its leader: of the least ids of its keys the one with most of them.

    Tasks that see parts of one family name the same few least ids, so their edges are mostly equal.
    """
    order = np.lexsort((ids, keys))
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    pairs = np.stack([ids[order], ids[order[start]]], axis=1)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    nodes, ends = np.unique(pairs, return_inverse=True)
    ends = ends.reshape(-1, 2)
    code, times = np.unique(ends[:, 0] * len(nodes) + ends[:, 1], return_counts=True)
    ends = np.stack([code // max(1, len(nodes)), code % max(1, len(nodes))], axis=1)
    least = nodes[_roots(len(nodes), ends)]
    best = ends[np.lexsort((ends[:, 1], -times, ends[:, 0]))]
    best = best[np.concatenate([[True], np.diff(best[:, 0]) != 0])] if len(best) else best
    return order[new], np.stack([nodes, least], axis=1)[nodes != least], nodes[best].reshape(-1, 2)


def _together(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The rows of batches, so many at a time."""
    held, n = [], 0
    for batch in batches:
        for i in range(0, len(batch), rows):
            held.append(batch.iloc[i : i + rows])
            n += len(held[-1])
            if n >= rows:
                yield pd.concat(held)
                held, n = [], 0
    if held:
        yield pd.concat(held)


#: What a row of family_edges() is while it is made: a place in a band, an edge of a family, or a document and its leader.
PLACE, EDGE, LEADER = range(3)


def family_edges(reps: DataFrame, bands: int = BANDS) -> DataFrame:
    """a, b, kind: stored edges that join representatives sharing a band key (EDGE), and leaders b of representatives a (LEADER).

    Places in bands (key, a), and what was found inside a batch, are dealt out in one shuffle.
    """

    def rows(kind: int, pairs: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": np.zeros(len(pairs), dtype=np.int64), "a": pairs[:, 0], "b": pairs[:, 1], "kind": np.full(len(pairs), kind, dtype=np.int32)})

    @common.in_task
    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _together(batches, 8192):
            registers = np.frombuffer(b"".join(part["registers"]), dtype=np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(registers, bands).reshape(-1)
            ids = np.repeat(part["doc_id"].to_numpy(dtype=np.int64), bands)
            first, edges, leaders = _stars(keys, ids)
            yield pd.DataFrame({"key": keys[first].view(np.int64), "a": ids[first], "b": ids[first], "kind": np.full(len(first), PLACE, dtype=np.int32)})
            yield rows(EDGE, edges)
            yield rows(LEADER, leaders)

    @common.in_task
    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, ids = [], []
        for x in batches:
            place = x["kind"].to_numpy() == PLACE
            yield x.loc[~place, ["a", "b", "kind"]]
            keys.append(x["key"].to_numpy()[place])
            ids.append(x["a"].to_numpy()[place])
        if keys:
            _, edges, leaders = _stars(np.concatenate(keys), np.concatenate(ids))
            for kind, found in ((EDGE, edges), (LEADER, leaders)):
                for i in range(0, len(found), 100_000):
                    yield rows(kind, found[i : i + 100_000])[["a", "b", "kind"]]

    found = reps.select("doc_id", "registers").mapInPandas(banded, "key long, a long, b long, kind int")
    dealt = found.repartition(F.when(F.col("kind") == PLACE, F.col("key")).otherwise(F.xxhash64("a", "b", "kind")))
    return common.stored(dealt.mapInPandas(joined, "a long, b long, kind int").distinct(), "family-edges")


def leader_links(texts: DataFrame, leaders: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """a, b: those pairs of a document and its leader that are links. texts: doc_id, text.

    The rows of a leader come one after another, its own text first; a task holds the leader's set and one more. A leader of
    very many is dealt out in parts, each with a copy of its text.
    """
    parts = leaders.groupBy("b").agg(F.ceil(F.count("*") / LEADER_ROWS).cast("int").alias("parts"))
    own = leaders.join(parts, "b").select(F.col("a").alias("doc_id"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    own = texts.join(own, "doc_id").withColumn("first", F.lit(0))
    first = parts.select(F.col("b").alias("doc_id"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    first = texts.join(first, "doc_id").withColumn("first", F.lit(1))
    rows = own.unionByName(first).repartition("b", "part").sortWithinPartitions("b", "part", F.desc("first"))

    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, leader, held = Shingler(words), None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out = []
            for doc_id, text, b, is_leader in zip(batch["doc_id"].tolist(), batch["text"], batch["b"].tolist(), batch["first"].tolist(), strict=True):
                if is_leader:
                    if leader != b:
                        leader, held = b, shingles(text)
                elif leader == b:
                    h = shingles(text)
                    if not len(h) or not len(held):  # a repeated id with another text
                        continue
                    at = np.minimum(np.searchsorted(held, h), len(held) - 1)
                    both = int((held[at] == h).sum())
                    if 100 * both >= percent * (len(h) + len(held) - both):
                        out.append((doc_id, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(run, "a long, b long")


def verified(sets: list[np.ndarray], sides: np.ndarray, parts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Index pairs of a spanning forest of the links between side 0 and side 1, but for pairs within a part."""
    registers = np.stack([sketch(s) for s in sets])
    left = np.flatnonzero(sides == 0)
    right = np.flatnonzero(sides == 1)
    sizes = np.array([len(s) for s in sets])
    # short sets fill few registers, so their estimates spread more
    filled = REGISTERS * (1 - np.exp(-np.minimum(sizes[left][:, None], sizes[right][None, :]) / REGISTERS))
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / filled) ** 0.5
    near = estimate(registers[left], registers[right]) >= least
    ratio = np.minimum(sizes[left][:, None], sizes[right][None, :]) * 100 >= percent * np.maximum(sizes[left][:, None], sizes[right][None, :])
    candidate = near & ratio & (parts[left][:, None] != parts[right][None, :])
    out = []
    if candidate.any():
        used = np.flatnonzero(candidate.any(axis=0))
        members = right[used]
        all_hashes = np.concatenate([sets[m] for m in members])
        owner = np.repeat(np.arange(len(members)), sizes[members])
        order = np.argsort(all_hashes, kind="stable")
        all_hashes, owner = all_hashes[order], owner[order]
        for k in np.flatnonzero(candidate.any(axis=1)):
            i = left[k]
            lo, hi = np.searchsorted(all_hashes, sets[i], "left"), np.searchsorted(all_hashes, sets[i], "right")
            n = hi - lo
            if n.sum():
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                common_n = np.bincount(owner[at], minlength=len(members))
                link = (100 * common_n >= percent * (sizes[i] + sizes[members] - common_n)) & candidate[k, used]
                out += [(i, int(j)) for j in members[link]]
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pairs[_forest(len(sets), pairs)]


def links(texts: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: a spanning forest, in each block, of the links that join parts of a family.

    members: doc_id, family, part, other (it is not of the largest part), left_blocks and right_blocks (of the other and of all).
    """

    @common.in_task
    def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler()
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i : i + 512].reset_index(drop=True)
                part["shingles"] = [shingles(t).tobytes() for t in part.pop("text")]
                yield part[part["shingles"].map(len) > 0]

    columns = "doc_id long, family long, part long, other boolean, left_blocks int, right_blocks int, shingles binary"
    rows = texts.join(members, "doc_id").select("doc_id", "family", "part", "other", "left_blocks", "right_blocks", "text").mapInPandas(with_sets, columns)
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # an other document meets each block of all, any document each block of others
    places = F.transform(each("left_blocks"), lambda i: F.struct(i.alias("i"), block("right_blocks").alias("j"), F.lit(1).alias("side")))
    left = F.transform(each("right_blocks"), lambda j: F.struct(block("left_blocks").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    places = F.when(F.col("other"), F.concat(places, left)).otherwise(places)
    rows = rows.select("doc_id", "family", "part", "shingles", F.explode(places).alias("at")).select("doc_id", "family", "part", "shingles", "at.*")

    def check(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["doc_id", "side"]).sort_values(["side", "doc_id"]).reset_index(drop=True)
        sides, parts, ids = group["side"].to_numpy(), group["part"].to_numpy(), group["doc_id"].to_numpy()
        if len(set(sides)) < 2 or len(set(parts)) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        found = verified([np.frombuffer(s, dtype=np.uint64) for s in group["shingles"]], sides, parts, percent)
        return pd.DataFrame({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    return rows.groupBy("family", "i", "j").applyInPandas(check, "a long, b long")


def _blocks(n: str, weight: str) -> Column:
    by_count = F.greatest(F.least(F.ceil(F.col(n) / BLOCK_DOCS), F.lit(MOST_SMALL_BLOCKS)), F.ceil(F.col(n) / (16 * BLOCK_DOCS)))
    return F.greatest(by_count, F.ceil(F.col(weight) / BLOCK_SHINGLES)).cast("int")


def open_members(family: DataFrame, parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """What links() takes, of the families of more than one part. family: id, component; parts: the same, of links; sizes: doc_id, n_shingles."""
    m = family.select(F.col("id").alias("doc_id"), F.col("component").alias("family"))
    m = m.join(parts.select(F.col("id").alias("doc_id"), F.col("component").alias("part")), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id")).join(sizes, "doc_id")
    m = common.stored(m, "family-members")
    by_part = m.groupBy("family", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    whole = by_part.groupBy("family").agg(F.max(F.struct("n", "part", "weight")).alias("top"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.count("*").alias("parts")).where("parts > 1")
    whole = whole.select("family", F.col("top.part").alias("largest"), "n", "weight", (F.col("n") - F.col("top.n")).alias("n_other"), (F.col("weight") - F.col("top.weight")).alias("weight_other"))
    whole = common.stored(whole.select("family", "largest", _blocks("n_other", "weight_other").alias("left_blocks"), _blocks("n", "weight").alias("right_blocks")), "open-families")
    return m.join(whole, "family").select("doc_id", "family", "part", (F.col("part") != F.col("largest")).alias("other"), "left_blocks", "right_blocks")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links are of percent and more."""
    s = common.stored(sketches(docs), "sketches")
    with_set = s.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    reps = common.stored(with_set.groupBy("sig").agg(F.min("doc_id").alias("rep")), "reps")
    own = with_set.select("doc_id", "sig", "n_shingles", "registers").join(reps.withColumnRenamed("rep", "doc_id"), ["sig", "doc_id"]).dropDuplicates(["doc_id", "sig"])
    edges = family_edges(own, bands_for(percent))
    family = components(edges.where(F.col("kind") == EDGE).select("a", "b"))
    # only documents of families are looked at again: their texts are picked out once
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(family.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    texts = common.stored(texts, "family-texts")
    known = common.stored(leader_links(texts, edges.where(F.col("kind") == LEADER), percent), "leader-links")
    parts = components(known)
    members = common.stored(open_members(family, parts, own.select("doc_id", "n_shingles")), "open-members")
    found = common.stored(known.unionAll(links(texts, members, percent)), "links")
    comps = components(found)
    by_set = common.stored(reps.join(comps, reps["rep"] == comps["id"], "left").select("sig", F.coalesce("component", "rep").alias("component_id")), "components")
    for done in (reps, edges, family, texts, known, parts, members, found, comps):
        common.drop_stored(done)
    keyed = s.select("doc_id", "n_shingles", F.coalesce(F.col("sig"), F.col("doc_id").cast("string").cast("binary")).alias("sig"))
    out = keyed.join(by_set, "sig", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns as they are, that are the least of their component; rows without an id stay.

    Rows that repeat an id are one document: of those that differ in other columns the one with the least hash stays.
    """
    kept = near_duplicates(docs, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__kept"))
    named = docs.join(kept, F.col("doc_id").cast("long") == F.col("__kept"), "left_semi")
    others = [c for c in docs.columns if c != "doc_id"]
    one = named.groupBy("doc_id").agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("__row"))
    one = one.select(*[F.col("doc_id") if c == "doc_id" else F.col("__row").getField(c).alias(c) for c in docs.columns])
    return one.unionByName(docs.where("doc_id IS NULL"))


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
