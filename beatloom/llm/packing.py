"""Best-fit packing of token sequences, improved by a swap-based local search.

Texts become ids once, in Arrow batches; only per-piece lengths and checksums go on. Pieces are dealt to
groups of a fixed size by a hash; each group is packed best-fit from the longest down, then a local search
exchanges one for one or two for one, or moves pieces, between bins that are not full, always raising the sum
of squared fills, until the emptiest bins are empty: it goes on until the group has as few bins as its ids need or no step
helps any bin. Then the pieces of each group's emptiest bin are packed once more, in groups of their own, so what groups leave
part-filled is one bin for some thousand pieces of such bins. No task holds more than a group.

Cases: null text is an empty text and gives the single end id; texts over the limit are cut; ties and repeated
rows are packed like any others (rows are dealt by their place in the input, so they spread over the groups); an empty table gives an
empty result; extra columns are ignored. Whole texts are always encoded, by parts only with a tokenizer that gives a test text
the same ids by parts as in one.
"""

from __future__ import annotations

import gc
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID, GROUP = 2048, 0, 8192
#: Words in a generation of a worker's cache.
CACHE_WORDS = 500_000

# White space always parts words for this kind of tokenizer, so runs between blanks are encoded one by one and remembered.
# Texts with separators that Python cuts at and the tokenizer does not, or that may hold a special token, are encoded whole.
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
# Letters whose lower case depends on nothing around them, and the ASCII marks after them: the tokenizer parts the two.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_BETWEEN = "|"
# What a tokenizer must give the same ids by parts as in one.
_TEST = "The QUICK brown Fox, jumps!  Über naïve (test) don't; ΑΣ ΟΔΟΣ 日本語。x,y a-b\tc\nd 12.5 e"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"


class Encoder:
    """ids of texts by a tokenizer file, with a bounded cache of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = common.WordCache(self._one, CACHE_WORDS)
        # the id of the mark between words; without a single one of its own, words are encoded one by one
        between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.parted = True
        self.parted = next(self.encode([_TEST])).tolist() == self.tokenizer.encode(_TEST, add_special_tokens=False).ids

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Puts new words into the cache. A plain word is its letters in lower case and the marks after them."""
        own, old = self.words, self.words.old
        plain, parts = [], set()
        for w in [w for w in words if w not in own and w not in old]:
            letters = w.rstrip(string.punctuation)
            if letters.isalpha() and (letters.isascii() or _PLAIN.fullmatch(letters)):
                marks = w[len(letters) :]
                letters = letters.lower()
                parts.add(letters)
                if marks:
                    parts.add(marks)
                    plain.append((w, letters, marks))
                elif w != letters:
                    plain.append((w, letters, ""))
            else:
                parts.add(w)
        self._encode_parts([w for w in parts if w not in own and w not in old])
        for w, letters, marks in plain:
            own[w] = own[letters] + own[marks] if marks else own[letters]

    def _encode_parts(self, parts: list[str]) -> None:
        """Encodes many words at one call, parted by a mark that none of them holds and that has an id of its own."""
        if self.between is None:
            return
        held = [w for w in parts if _BETWEEN not in w]
        for i in range(0, len(held), 256):
            part = held[i : i + 256]
            got = self.tokenizer.encode_batch_fast([f" {_BETWEEN} ".join(part)], add_special_tokens=False)[0]
            ids = np.array(got.ids, dtype=self.width)
            cuts = (np.flatnonzero(ids == self.between) * ids.itemsize).tolist()
            data = ids.tobytes()
            self.words.update(zip(part, [data[a:b] for a, b in zip([0, *[c + ids.itemsize for c in cuts]], [*cuts, len(data)], strict=True)], strict=True))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """One array of ids a text, in order."""
        self.words.trim()
        cut = [None if not self.parted or any(x in t for x in _WHOLE) else t.split() for t in texts]
        self._learn(set().union(*[w for w in cut if w]))
        for text, words in zip(texts, cut, strict=True):
            if words is None:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
            else:
                yield np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype=self.width).astype("<u4")


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process, so that its cache serves all the tasks of the process."""
    return Encoder(path)


def _chunks(values: list, size: int = 1024) -> Iterator[list]:
    for i in range(0, len(values), size):
        yield values[i : i + size]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut every `capacity` ids."""

    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # nothing here makes cycles, and the collector would walk the whole cache again and again
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = encoder_of(tokenizer_path), np.array([end_id], dtype="<u4")
        for batch in batches:
            rows = []
            for part in _chunks(list(zip(batch["doc_id"], batch["text"], batch["place"], strict=True))):
                texts = ["" if t is None else t for _, t, _ in part]
                for (doc_id, _, place), ids in zip(part, encoder.encode(texts), strict=True):
                    ids = np.append(ids, end)
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        rows.append((doc_id, k, start, len(own), zlib.crc32(own), place))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "place"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place")).mapInPandas(run, PIECES)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indexes: each piece, from the longest down, goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set if a bin has r free
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        above = open_rooms >> n
        if above:
            r = n + ((above & -above).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
            bins[b].append(i)
            r -= n
        else:
            b, r = len(bins), capacity - n
            bins.append([i])
        if r:
            room[r].append(b)
            open_rooms |= 1 << r
    return bins


def local_search(lengths: list[int], bins: list[list[int]], capacity: int = CAPACITY) -> list[list[int]]:
    """Empties the emptiest bins, as far as exchanges that raise the sum of squared fills can.

    A step takes the emptiest bin left and the step that gains most among: moving one of its pieces to a bin with room,
    exchanging one or two of its pieces, of all pairs, for a shorter one of a fuller bin. A bin that no step helps is left as it
    is. It stops when no fewer bins are possible or all bins that are not full have been tried.
    """
    need = -(-sum(lengths) // capacity)
    fill = [sum(lengths[i] for i in b) for b in bins]
    under = [b for b in range(len(bins)) if fill[b] < capacity]
    if len(bins) <= need or len(under) < 2:
        return bins
    piece = np.array([i for b in under for i in bins[b]])
    size = np.array([lengths[i] for i in piece])
    home = np.array([b for b in under for _ in bins[b]])
    at = {int(i): k for k, i in enumerate(piece)}
    full = np.array(fill)
    alive, stuck = set(under), set()
    for b in sorted(under, key=lambda b: fill[b]):
        if sum(1 for x in bins if x) <= need:
            break
        while bins[b] and b not in stuck:
            own = sorted(bins[b], key=lambda i: lengths[i])
            others = np.array([x for x in alive if x != b and bins[x]])
            if not len(others):
                stuck.add(b)
                break
            best = (0, None)
            free = capacity - full[others]
            for i in own:  # move
                k = int(np.argmin(np.where(free >= lengths[i], free, capacity + 1)))
                if free[k] >= lengths[i]:
                    n, t = lengths[i], int(others[k])
                    best = max(best, (2 * n * int(full[t] - full[b] + n), ((i,), None, t)), key=lambda x: x[0])
            ok_home = home != b
            room = capacity - full[home]
            gives = {lengths[i]: (i,) for i in own}  # one piece of each length, one pair of each sum
            once = [i for x, i in enumerate(own) if x < 2 or lengths[i] != lengths[own[x - 2]]]
            for x, i in enumerate(once):
                for j in once[x + 1 :]:
                    gives.setdefault(lengths[i] + lengths[j], (i, j))
            for give in gives.values():  # exchange
                n = sum(lengths[i] for i in give)
                up = n - size
                gain = np.where(ok_home & (up > 0) & (up <= room), 2 * up * (full[home] - full[b] + up), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (int(gain[k]), (give, int(piece[k]), int(home[k])))
            if best[1] is None:
                stuck.add(b)
                break
            give, back, t = best[1]
            for i in give:
                bins[b].remove(i)
                bins[t].append(i)
                home[at[i]] = t
                full[b], full[t] = full[b] - lengths[i], full[t] + lengths[i]
            if back is not None:
                bins[t].remove(back)
                bins[b].append(back)
                home[at[back]] = b
                full[t], full[b] = full[t] - lengths[back], full[b] + lengths[back]
        if not bins[b]:
            alive.discard(b)
    return [b for b in bins if b]


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, place long, sequence_id long, offset long, emptiest boolean"


def _packed_groups(pieces: DataFrame, n_pieces: int, capacity: int, group: int, first_id: int) -> DataFrame:
    """PACKED of pieces in groups; sequence ids count up from first_id in each group's own range."""
    n_groups = max(1, -(-n_pieces // group))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("place", "piece"), F.lit(n_groups)).cast("long"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "place"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        sequence, offset, fill = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64), []
        for k, b in enumerate(bins):
            at = 0
            for i in sorted(b):
                sequence[i], offset[i] = k, at
                at += lengths[i]
            fill.append(at)
        rows["emptiest"] = sequence == int(np.argmin(fill))
        rows["sequence_id"] = sequence + first_id + (int(rows["grp"].iloc[0]) << 32)
        rows["offset"] = offset
        return rows[[c.split()[0] for c in PACKED.split(", ")]]

    return dealt.groupBy("grp").applyInPandas(run, PACKED)


def pack(pieces: DataFrame, n_pieces: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset. pieces is a stored table, so that each rerun of a task sees the same rows."""
    out = _packed_groups(pieces, n_pieces, capacity, group, 0)
    if n_pieces > group:  # the emptiest bin of each group, packed again
        out = common.stored(out, "packed")
        loose = out.where("emptiest").drop("sequence_id", "offset", "emptiest")
        out = out.where("NOT emptiest").unionByName(_packed_groups(loose, loose.count(), capacity, group, 1 << 31))
    return out.drop("place", "emptiest")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Every document in sequences of at most CAPACITY ids."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    pieces = common.stored(token_pieces(docs, tokenizer_path), "pieces")
    return pack(pieces, pieces.count())


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
