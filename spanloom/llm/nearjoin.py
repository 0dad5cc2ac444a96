"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets (by 128 bits)
form a class, and only one text of each class is joined. All tokens have one global order: rare ones by hash, then
frequent ones, then those that weren't counted. Let two sets of n and m tokens link, so that they share at least t.

* If their first common token is rare, it lies in both 1-prefixes (the first n - t + 1 tokens): rare tokens of the
  1-prefix are indexed singly.
* Else all common tokens are in the frequent rest of both sets, f and g tokens long. There a token of only one set
  parts at most two pairs of neighbours of its own set and one of the other's, so the first pair of neighbours that
  both sets have is among the first 2 * (f - t) + (g - t) + 1 pairs of the one, and likewise of the other. Sets
  whose rest is long enough extend their prefix that far and index its combinations of two neighbours: fewer keys
  than all combinations of the prefix, and rarer ones than its tokens.

Candidates are verified twice: parity bitmaps give a lower bound of the symmetric difference, which rejects
nearly all false pairs for a few bytes; for the rest, both texts meet, and their shingles are compared word by word.
Only components are asked for, so a pair that is connected already is not verified: in each round every key has a
leader, and each set meets the one leader with which it shares most keys (a star). Keys whose members are one
component by then are done. Of the keys that are left all members are compared by bitmaps, keys of equal members once; members of
keys that still are large form clusters, which are cut into blocks by size and hash and compared block by block. The
pairs that pass are verified in two rounds: first those of hubs, few for each member of a dense group, then all that
are left between components. No candidate pair is ever dropped.

Hashes decide nothing but candidates and equal sets: of 10**10 sets, two differing ones have equal 128-bit digests
with a probability below 2**-61.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, as_bytes, scratch, small_batches, stage_table
from .hashing import Powers, mix, shingles, word_hashes

SHINGLE = 4
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Tokens are counted (and so can be frequent) if their hash is in this part of the range. Prefixes hold the
#: smallest hashes, so larger ones matter only where a set is nearly all frequent; they come last in the order.
COUNTED = 0.25
#: Tokens in more sets than this are frequent.
FREQUENT = 48
#: So many frequent tokens (8 bytes each) are broadcast; more are joined by a shuffle.
MAX_FREQUENT = 1 << 20
#: Below this percentage neighbours in both sets aren't certain: every token of the 1-prefix is indexed singly.
COMBINED_PERCENT = 70
#: Rounds of stars before the members of the keys that are left are compared by bitmaps: hubs first, then all pairs between components.
STAR_ROUNDS = 1
#: Postings of combinations are spread over so many parts of their key.
SALTS = 64
#: Keys of more members than that are handled in blocks of about so many members.
LIGHT_MEMBERS, BLOCK = 64, 1024
#: So many ids are broadcast to pick texts; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Pairs with hubs that a member keeps in the first round of bitmaps.
HUBS = 4
#: So many words of bitmaps (8 bytes each) are compared at once.
PASSING_WORDS = 1 << 20
#: Bits of a parity bitmap for each token.
BITS = 2

_LIMIT = np.uint64(int(COUNTED * 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z lower-cased.
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))


def tokens(text: bytes | None, powers: Powers, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of the words (runs without ASCII white space, A-Z lower-cased) of a text; of fewer than
    k words the whole sequence is the one shingle; none without words."""
    if not text:
        return np.empty(0, np.uint64)
    b = np.frombuffer(text.translate(_LOWER), np.uint8)
    h = word_hashes(b, ~_SPACE[b], powers)[2]
    return np.unique(shingles(h, min(k, len(h)))) if len(h) else h


def digest(toks: np.ndarray) -> bytes | None:
    """128 bits of a set; None of the empty one."""
    return xxhash.xxh3_128_digest(toks.tobytes()) if len(toks) else None


def vertex(cls: bytes | None, seed: int) -> int | None:
    """The number of a class in joins; a seed is taken with which no two classes of the corpus share theirs."""
    return None if cls is None else xxhash.xxh3_64_intdigest(cls, seed) - (1 << 63)


def parity(toks: np.ndarray) -> bytes:
    """Bit v is the parity of the number of tokens with hash v modulo the number of bits, a power of two >= BITS * n."""
    bits = max(64, 1 << (BITS * len(toks) - 1).bit_length())
    at = (toks >> np.uint64(8)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the size of the symmetric difference of two sets, from their parity bitmaps."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0) if len(b) > len(a) else b
    return int(np.bitwise_count(a ^ b).sum())


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def combined_size(n: int, rest: int, percent: int) -> int:
    """How many pairs of neighbours a set of n with so many frequent and uncounted tokens indexes: one more than the
    largest 2 * (f - t) + (m - t), which the smallest m that can link gives."""
    least = -(-percent * n // 100)
    if rest < least:
        return 0
    return max(0, ((2 * rest + least) * (100 + percent) - 3 * percent * (n + least)) // (100 + percent) + 1)


def prefix_keys(s: np.ndarray, n: int, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set of n tokens, and their places: i >= 0 of a single rare token, -1 - i of a combination.
    ``s``: its smallest tokens, at least those that are indexed; ``often``: which of the counted ones are frequent."""
    low = len(often)
    rare, rest = s[:low][~often], np.concatenate((s[:low][often], s[low:]))
    first = prefix_size(n, percent)
    if percent < COMBINED_PERCENT:
        one = np.concatenate((rare, rest))[:first]
        return one, np.arange(len(one))
    keys, places = [rare[:first]], [np.arange(min(first, len(rare)))]
    if pairs := combined_size(n, n - len(rare), percent):
        two = rest[: pairs + 1]
        if len(two) > 1:
            keys.append(mix(mix(two[:-1]) + two[1:]))
            places.append(-1 - np.arange(len(two) - 1))
    return np.concatenate(keys), np.concatenate(places)


def _once(batches: Iterator[pa.RecordBatch], k: int, at: int):
    """For each batch its rows' sets, and whether each set is the first of its class in this task."""
    powers, seen = Powers(), set()
    for b in batches:
        out = []
        for text in as_bytes(b.column(at)):
            s = tokens(text, powers, k)
            c = digest(s)
            out.append((s, c, c is not None and c not in seen))
            seen.add(c)
        yield b, out


def _sets(k: int, seed: int):
    """A row for each document: id, hash of its text, n, class and its number, and for the first of its class in this task the
    bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _once(batches, k, 2):
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([len(s) for s, _, _ in found], pa.int64()), pa.array([c for _, c, _ in found], pa.binary()),
                    pa.array([vertex(c, seed) for _, c, _ in found], pa.int64()), pa.array([parity(s) if new else None for s, _, new in found], pa.binary()),
                ],
                ["_id", "_th", "n", "cls", "v", "bits"],
            )

    return run


def _counted(k: int):
    """Tokens in the counted part of the range and how many sets of the batch hold them."""

    def run(batches):
        for _, found in _once(batches, k, 0):
            toks = [s[: np.searchsorted(s, _LIMIT)] for s, _, new in found if new]
            if toks:
                tok, m = np.unique(np.concatenate(toks), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(m)], ["tok", "m"])

    return run


def _postings(k: int, percent: int, seed: int, shared):
    def run(batches):
        frequent = shared.value
        for _, found in _once(batches, k, 0):
            keys = []
            for s, c, new in found:
                if new:
                    low = s[: np.searchsorted(s, _LIMIT)]
                    often = np.isin(low, frequent, assume_unique=True) if len(frequent) else np.zeros(len(low), bool)
                    keys.append((vertex(c, seed), len(s), *prefix_keys(s, len(s), often, percent)))
            if keys:
                yield _posting_rows(keys)

    return run


def _posting_rows(keys: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    size = [len(key) for _, _, key, _ in keys]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([key for _, _, key, _ in keys]).view(np.int64)), pa.array(np.repeat(np.array([v for v, *_ in keys], np.int64), size)),
            pa.array(np.repeat(np.array([n for _, n, *_ in keys], np.int32), size)), pa.array(np.concatenate([p for *_, p in keys]).astype(np.int32)),
        ],
        ["key", "v", "n", "place"],
    )


def _prefix_tokens(k: int, percent: int, seed: int):
    """The tokens that prefixes may take: (v, n, tok, counted), for the way that joins frequent tokens."""

    def run(batches):
        for _, found in _once(batches, k, 0):
            rows = [(vertex(c, seed), s) for s, c, new in found if new]
            for v, s in rows:
                low = int(np.searchsorted(s, _LIMIT))
                part = s[: max(low, prefix_size(len(s), percent), combined_size(len(s), len(s), percent) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), v, np.int64)), pa.array(np.full(len(part), len(s), np.int32)), pa.array(part.view(np.int64)), pa.array(np.arange(len(part)) < low)], ["v", "n", "tok", "counted"])

    return run


def _joined_postings(percent: int):
    """Postings from rows (v, n, toks: structs of tok, counted, often)."""

    def run(batches):
        for b in batches:
            keys = []
            for v, n, toks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                toks.sort(key=lambda x: x["tok"] & 0xFFFFFFFFFFFFFFFF)
                s = np.array([x["tok"] for x in toks], np.int64).view(np.uint64)
                keys.append((v, n, *prefix_keys(s, n, np.array([x["often"] for x in toks if x["counted"]], bool), percent)))
            if keys:
                yield _posting_rows(keys)

    return run


def postings(texts: DataFrame, k: int, percent: int, seed: int) -> DataFrame:
    """(key, v, n, place): the index of the sets of ``texts`` (one text column)."""
    kind = "key bigint, v bigint, n int, place int"
    if percent < COMBINED_PERCENT:
        return texts.mapInArrow(_postings(k, percent, seed, texts.sparkSession.sparkContext.broadcast(np.empty(0, np.uint64))), kind)
    often = texts.mapInArrow(_counted(k), "tok bigint, m bigint").groupBy("tok").agg(F.sum("m").alias("m")).filter(F.col("m") > FREQUENT).select("tok")
    often = stage_table(often)
    if often.count() <= MAX_FREQUENT:
        frequent = np.sort(often.toArrow().column("tok").to_numpy().view(np.uint64))
        return texts.mapInArrow(_postings(k, percent, seed, texts.sparkSession.sparkContext.broadcast(frequent)), kind)
    own = texts.mapInArrow(_prefix_tokens(k, percent, seed), "v bigint, n int, tok bigint, counted boolean")
    marked = own.join(often.withColumn("often", F.lit(True)), "tok", "left").select("v", "n", F.struct("tok", "counted", F.coalesce("often", F.lit(False)).alias("often")).alias("t"))
    return marked.groupBy("v").agg(F.first("n").alias("n"), F.collect_set("t").alias("toks")).mapInArrow(_joined_postings(percent), kind)


def _near(percent: int):
    """Pairs whose bitmaps don't rule out the similarity."""

    def run(batches):
        for b in batches:
            keep = []
            for m, n, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                least = -(-percent * (m + n) // (100 + percent))
                keep.append(least_difference(x, y) <= m + n - 2 * least)
            yield pa.RecordBatch.from_arrays(b.columns[:2], b.schema.names[:2]).filter(pa.array(keep, pa.bool_()))

    return run


def _words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def overlap(x: list[bytes], y: list[bytes], k: int) -> tuple[int, int]:
    """Sizes of the intersection and the union of two texts' shingle sets, by their words themselves; (0, 1) where shingles
    of different lengths can't be equal."""
    ids: dict[bytes, int] = {}
    size = [min(k, len(x)), min(k, len(y))]
    if size[0] != size[1]:  # a whole sequence of fewer words equals no longer shingle
        return 0, 1
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in z], np.int64) for z in (x, y))
    ca, cb, span = a, b, len(ids)
    for i in range(1, size[0]):
        if span > (1 << 62) // len(ids):
            _, flat = np.unique(np.concatenate((ca, cb)), return_inverse=True)
            ca, cb, span = flat[: len(ca)], flat[len(ca) :], int(flat.max()) + 1
        ca, cb, span = ca[:-1] * len(ids) + a[i:], cb[:-1] * len(ids) + b[i:], span * len(ids)
    ca, cb = np.unique(ca), np.unique(cb)
    both = len(np.intersect1d(ca, cb, assume_unique=True))
    return both, len(ca) + len(cb) - both


def _similar(k: int, percent: int):
    """The pairs whose texts are similar."""

    def run(batches):
        last = (None, None)
        for b in batches:
            keep = []
            for x, y in zip(as_bytes(b.column(2)), as_bytes(b.column(3)), strict=True):
                if x != last[0]:
                    last = (x, _words(x))
                both, all_ = overlap(last[1], _words(y), k)
                keep.append(100 * both >= percent * all_)
            yield pa.RecordBatch.from_arrays(b.columns[:2], b.schema.names[:2]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame, stage=stage_table) -> DataFrame:
    """Connected components of ``edges(a, b)``: (v, root), root the smallest vertex. Every vertex hooks to its least neighbour,
    pointers jump, and the edges are contracted, so that dense groups shrink at once; what a jump hasn't reached yet
    stays as an edge. Every round is written, so that lost executors cost no lineage."""
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    left = stage(edges.filter("a <> b").select(*ends("a", "b")).distinct())
    roots = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("root", F.col("v"))
    while not left.isEmpty():
        near = left.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")).union(left.select(F.col("a").alias("v"), F.col("a").alias("p")).distinct())
        hook = near.groupBy("v").agg(F.min("p").alias("p"))
        to = hook.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
        jumped = hook.join(to, F.col("p") == F.col("_v")).select("v", F.col("_p").alias("p"))
        labels = stage(jumped)
        at = lambda x: labels.select(F.col("v").alias(x), F.col("p").alias(f"p{x}"))
        roots = roots.join(at("root"), "root", "left").select("v", F.coalesce("proot", "root").alias("root"))
        met = left.join(at("a"), "a").join(at("b"), "b").filter("pa <> pb").select(*ends("pa", "pb"))
        # a label that has a parent of its own
        open_ = labels.filter("v <> p").select(*ends("v", "p")).join(labels.select(F.col("p").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        left = stage(met.union(open_).distinct())
    return stage(roots)


def _linkable(na: Column, nb: Column, pa_: Column, pb: Column, percent: int) -> Column:
    """Whether sets of these sizes can link if the keys at these places are the first that they share."""
    least = F.ceil((na + nb) * percent / (100 + percent))
    single = (na - pa_ >= least) & (nb - pb >= least)
    combined = (2 * na + nb + 1 + pa_ >= 3 * least) & (2 * nb + na + 1 + pb >= 3 * least)
    return F.when((pa_ >= 0) & (pb >= 0), single).when((pa_ < 0) & (pb < 0), combined).otherwise(F.lit(True))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, _text): one text of each class of ``wanted(v, pick)``, where pick is the id and the hash of the text of one of its rows. Rows
    of one id differ by their texts' hashes, and of equal rows one is taken, so that null or repeated ids bring no more than
    their class. Few classes are broadcast; many are joined by a shuffle."""
    told = wanted.select("v", F.col("pick._id").alias("_pid"), F.col("pick._th").alias("_pth"))
    if wanted.count() <= MAX_BROADCAST_IDS:
        told = F.broadcast(told)
    met = docs.join(told, (F.col("_th") == F.col("_pth")) & F.col("_id").eqNullSafe(F.col("_pid")))
    return met.select("v", "_text").dropDuplicates(["v"])


def _verify(pairs: DataFrame, bits: DataFrame | None, texts: DataFrame, k: int, percent: int, stage) -> DataFrame:
    """The pairs (a, b) that are similar: by bitmap (None: that is done), then by their ``texts(v, _text)``."""
    near = pairs
    if bits is not None:
        side = lambda x: bits.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
        near = stage(near.mapInArrow(_near(percent), "a bigint, b bigint"))
    few = near.count() <= MAX_BROADCAST_IDS
    hinted = F.broadcast if few else lambda x: x

    def side_of(wanted: DataFrame, x: str, text: str) -> DataFrame:
        return texts.withColumnRenamed("_text", text).join(hinted(wanted), F.col("v") == F.col(x)).drop("v")

    left, right = side_of(near.select("a").distinct(), "a", "x"), side_of(near, "b", "y")
    met = right.join(left, "a").select("a", "b", "x", "y")
    return met.mapInArrow(_similar(k, percent), "a bigint, b bigint").distinct()


def _members(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(v, n, root, bits) of each list of members."""
    ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    flat = column.flatten()
    v, n, root = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("v", "n", "root"))
    bits = flat.field("bits").to_pylist()
    for s, e in itertools.pairwise(ends):
        yield v[s:e], n[s:e], root[s:e], bits[s:e]


def _folded(bits: list[bytes], size: int) -> np.ndarray:
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0) for x in bits]).view(np.uint64)


def _by_size(bits: list[bytes]) -> dict[int, np.ndarray]:
    size = np.array([len(x) for x in bits])
    return {int(z): np.flatnonzero(size == z) for z in np.unique(size)}


def _passing(x: tuple, y: tuple, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in two lists of members (or in one) of the pairs in different components that sizes and bitmaps let pass. Sets
    that can link have bitmaps of one size, or of one and its double."""
    (_, nx, rx, bx), (_, ny, ry, by) = x, y
    left, right = [], []
    for (zx, ix), (zy, iy) in itertools.product(_by_size(bx).items(), _by_size(by).items()):
        if max(zx, zy) > 2 * min(zx, zy) and percent > 50:
            continue
        both = nx[ix][:, None] + ny[iy]
        most = both - 2 * -(-percent * both // (100 + percent))
        ok = (np.abs(nx[ix][:, None] - ny[iy]) <= most) & (rx[ix][:, None] != ry[iy])
        if same:
            ok &= ix[:, None] < iy
        i, j = np.nonzero(ok)
        if not len(i):
            continue
        fx, fy = (_folded([z[k] for k in at], min(zx, zy)) for z, at in ((bx, ix), (by, iy)))
        for at in range(0, len(i), step := max(1, PASSING_WORDS // fx.shape[1])):
            p, q = i[at : at + step], j[at : at + step]
            near = np.bitwise_count(fx[p] ^ fy[q]).sum(axis=1, dtype=np.int64) <= most[p, q]
            left.append(ix[p[near]])
            right.append(iy[q[near]])
    return tuple(np.concatenate([np.empty(0, np.int64), *z]) for z in (left, right))


def hubs(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the pairs (u, v) to test first: members become hubs, those with the most pairs first, until each other member has a
    pair with one; of its pairs with hubs it keeps the first HUBS. A dense group keeps a few pairs for each member, through
    which it is connected as a rule; what isn't is left to the last round."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    order, n = np.argsort(at, kind="stable"), len(u)
    ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(nodes)))))
    keep, covered = np.zeros(n, bool), np.zeros(len(nodes), np.int64)
    for h in np.argsort(-np.diff(ends), kind="stable"):
        if not covered[h]:
            pairs = order[ends[h] : ends[h + 1]] % n
            other = at[pairs] + at[pairs + n] - h
            fresh = covered[other] < HUBS
            keep[pairs[fresh]] = True
            covered[other[fresh]] += 1
            covered[h] = HUBS
    return keep


def _block_pairs(percent: int, hubs_only: bool):
    """From rows (x, y, same, list): pairs of members of two lists (or of one) that may be similar. With ``hubs_only`` only those of hubs, and a
    row (list, null) where others are left for the last round."""

    def run(batches):
        for b in batches:
            left, right, open_ = [], [], []
            for x, y, same, number in zip(_members(b.column(0)), _members(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                i, j = _passing(x, y, same, percent)
                u, v = x[0][i], y[0][j]
                if hubs_only and len(u):
                    keep = hubs(u, v)
                    if not keep.all():
                        open_.append(number)
                    u, v = u[keep], v[keep]
                left.append(np.minimum(u, v))
                right.append(np.maximum(u, v))
            if left:
                columns = [pa.concat_arrays([pa.array(np.concatenate(left)), pa.array(open_, pa.int64())]), pa.concat_arrays([pa.array(np.concatenate(right)), pa.nulls(len(open_), pa.int64())])]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return run


#: The number of all blocks of clusters among lists.
HEAVY = -1


def _heavy_pairs(heavy: DataFrame, bits: DataFrame, percent: int, hubs_only: bool, stage) -> DataFrame:
    """Candidate pairs of the members of ``heavy(key, v, n, root)``: keys that share members form clusters; the members of a
    cluster are dealt by size (bands, of which only neighbours can link) and hash into blocks, and blocks are compared."""
    least = heavy.groupBy("key").agg(F.min("v").alias("a"))
    stars = stage(heavy.select("key", F.col("v").alias("b")).join(least, "key").select("a", "b").distinct())
    cluster = components(stars, stage).select("v", F.col("root").alias("cluster"))
    band = F.floor(F.log("n") / (math.log(100 / min(percent, 99)) * (1 + 1e-9)))
    members = stage(heavy.select("v", "root").distinct().join(cluster, "v").join(bits, "v").withColumn("band", band))
    sizes = stage(members.groupBy("cluster", "band").agg(F.ceil(F.count("*") / BLOCK).alias("parts")))
    blocks = members.join(sizes, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    blocks = stage(blocks.groupBy("cluster", "band", "part").agg(F.collect_list(F.struct("v", "n", "root", "bits")).alias("m")))
    other = sizes.select("cluster", F.col("band").alias("band2"), F.col("parts").alias("parts2"))
    grid = sizes.join(other, "cluster").filter("band2 = band OR band2 = band + 1")
    first = F.when(F.col("band2") == F.col("band"), F.col("part")).otherwise(F.lit(0).cast("long"))
    grid = grid.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("part2", F.explode(F.sequence(first, F.col("parts2") - 1)))
    right = blocks.select("cluster", F.col("band").alias("band2"), F.col("part").alias("part2"), F.col("m").alias("y"))
    pairs = grid.join(blocks.withColumnRenamed("m", "x"), ["cluster", "band", "part"]).join(right, ["cluster", "band2", "part2"])
    # few and costly rows: dealt evenly, a handful for each batch
    pairs = pairs.select("x", "y", ((F.col("band") == F.col("band2")) & (F.col("part") == F.col("part2"))).alias("same"), F.lit(HEAVY).cast("long").alias("list")).repartition(F.xxhash64("cluster", "band", "band2", "part", "part2"))
    return pairs.mapInArrow(_block_pairs(percent, hubs_only), "a bigint, b bigint")


def link_classes(docs: DataFrame, rows: DataFrame, classes: DataFrame, k: int, percent: int, seed: int) -> DataFrame | None:
    """Components (v, root) over the classes that share an index key with another; None if none do. ``docs``: _id, _th, _text;
    ``rows``: the output of _sets; ``classes``: cls, v, pick (id and hash of the text of one of its rows), n."""
    with scratch(docs.sparkSession) as stage:
        by_key = postings(docs.select("_text"), k, percent, seed)
        # rare tokens have few members; the many of a combination are spread
        by_key = by_key.withColumn("salt", F.when(F.col("place") < 0, F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
        by_key = by_key.repartition(F.col("key"), F.col("salt")).dropDuplicates(["key", "salt", "v"])
        by_key = by_key.withColumn("here", F.count("*").over(Window.partitionBy("key", "salt")))
        posts = stage(by_key.filter("place < 0 OR here > 1").drop("salt", "here"))
        bits, texts, root, edges, tested, left_open = None, None, None, None, None, None
        # stars, then hubs among all members of the keys that are left, then all pairs that are left
        for step in range(STAR_ROUNDS + 2):
            now = posts.withColumn("root", F.col("v")) if root is None else posts.join(root, "v", "left").withColumn("root", F.coalesce("root", "v"))
            # keys with members in different components are all that is left
            open_keys = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).filter("lo < hi").select("key", "members")
            now = stage(now.join(open_keys, "key"))
            if now.isEmpty() or left_open is not None and left_open.isEmpty():
                break
            posts = now.drop("root", "members")
            if bits is None:
                bits = rows.filter("bits IS NOT NULL").select("v", "n", "bits").join(now.select("v").distinct(), "v", "left_semi")
                bits = stage(bits.dropDuplicates(["v"]))
                texts = stage(_texts(docs, classes.select("v", "pick").join(bits.select("v"), "v", "left_semi")))
            if step < STAR_ROUNDS:
                # another member leads each key in each round; a set meets the leader of most of its keys
                lead = F.min_by(F.struct("v", "n", "root", "place"), F.xxhash64("v", F.lit(step)))
                led = now.join(now.groupBy("key").agg(lead.alias("lead")), "key")
                led = led.filter((F.col("v") != F.col("lead.v")) & (F.col("root") != F.col("lead.root")) & _linkable(F.col("n"), F.col("lead.n"), F.col("place"), F.col("lead.place"), percent))
                met = led.groupBy("v", F.col("lead.v").alias("a")).agg(F.count("*").alias("c"))
                pairs = met.groupBy("v").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", F.col("v").alias("b"))
            else:
                hubs_only = step == STAR_ROUNDS
                light, heavy = now.filter(F.col("members") <= LIGHT_MEMBERS), now.filter(F.col("members") > LIGHT_MEMBERS)
                # keys of the same members are compared once, all members at once by their bitmaps: costly rows, dealt evenly
                if hubs_only:
                    lists = light.groupBy("key").agg(F.array_sort(F.collect_set("v")).alias("vs")).select("vs").distinct()
                    lists = stage(lists.withColumn("list", F.monotonically_increasing_id())).select("list", F.explode("vs").alias("v"))
                told = now.select("v", "root").distinct().join(bits, "v")
                # the last round compares only where the one before left pairs out
                told = (lists if hubs_only else lists.join(left_open, "list", "left_semi")).join(told, "v").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "list")
                told = told.groupBy("list").agg(F.collect_list(F.struct("v", "n", "root", "bits")).alias("x"))
                pairs = told.select("x", F.col("x").alias("y"), F.lit(True).alias("same"), "list").mapInArrow(_block_pairs(percent, hubs_only), "a bigint, b bigint")
                if (hubs_only or not left_open.filter(F.col("list") == HEAVY).isEmpty()) and not heavy.isEmpty():
                    pairs = pairs.union(_heavy_pairs(heavy, bits, percent, hubs_only, stage))
                if hubs_only:
                    pairs = stage(pairs)
                    left_open = stage(pairs.filter("b IS NULL").select(F.col("a").alias("list")).distinct())
                pairs = pairs.filter("b IS NOT NULL").distinct()
                pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
            pairs = stage(pairs)
            done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            tested = done if tested is None else tested.union(done)
            fresh = stage(_verify(pairs, bits if step < STAR_ROUNDS else None, texts, k, percent, stage))
            edges = fresh if edges is None else edges.union(fresh)
            root = components(edges, stage).select("v", "root")
        return None if root is None else stage_table(root)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, class_key (16 bytes, equal for equal sets), component_id (the
    smallest id that links reach, the own included).

    Null texts and texts without words have no shingles and link with nothing; a null id is never a component's
    id unless there is no other; repeated rows and ids each keep their row; other columns are not carried; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    seed = 0
    while True:
        rows = stage_table(slim.mapInArrow(_sets(k, seed), f"_id {kind}, _th bigint, n bigint, cls binary, v bigint, bits binary"))
        classes = rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("_id").alias("rep"), F.min(F.struct("_id", "_th")).alias("pick"), F.first("n").alias("n"), F.first("v").alias("v"))
        classes = stage_table(classes)
        if classes.count() == classes.select("v").distinct().count():
            break
        seed += 1
    root = link_classes(slim, rows, classes, k, percent, seed)
    of_class = classes.select(F.col("v").alias("_v"), F.col("rep").alias("component_id"))
    if root is not None:
        named = stage_table(classes.join(root, "v", "left").select("v", "rep", F.coalesce("root", "v").alias("root")))
        ids = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        of_class = named.join(ids, "root").select(F.col("v").alias("_v"), "component_id")
    out = rows.join(of_class, F.col("v") == F.col("_v"), "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("cls").alias("class_key"), F.coalesce("component_id", "_id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` (all columns) with one row of each component, that with the smallest id (null ids last). Rows are told apart
    by id, text and the other columns, so ids may repeat or lack; of rows equal in all of these one stays. Rows without
    words link with nothing and all stay. Texts stay where they are while few enough rows go."""
    # maps have no hash
    others = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    keyed = docs.withColumn("__key", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), F.xxhash64(F.lit(1), *others).alias("row")))
    found = join(keyed, "__key", text_col, k, percent).filter("n_shingles > 0")
    # what goes: all rows of a key that isn't its component's, and all but one of the rows of a repeated key
    gone = found.groupBy("__key").agg(F.count("*").alias("__n"), F.first(F.col("__key") == F.col("component_id")).alias("__stays")).filter("NOT __stays OR __n > 1")
    gone = stage_table(gone.select(F.col("__key").alias("__gone"), (F.col("__stays")).alias("__twin")))
    marked = gone if gone.count() > MAX_BROADCAST_IDS else F.broadcast(gone)
    worded = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    marked = keyed.join(marked, (F.col("__key") == F.col("__gone")) & worded, "left")
    twins = marked.filter("__twin").dropDuplicates(["__key"])
    return marked.filter(F.col("__gone").isNull()).unionByName(twins).select(*docs.columns)


def op2_ngram_jaccard_join(spark, sf_dir):
    from .common import table

    return join(table(spark, sf_dir, "documents")).drop("class_key")


def near_sql(source: str, percent: int = PERCENT, k: int = SHINGLE) -> str:
    """CTEs that end in ``near(doc_id, n_shingles, component_id)`` over ``source(doc_id, text)``."""
    return rf"""
nd AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM {source}),
ns AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least({k}, len(w)) - 1], ' ') AS g
       FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least({k}, len(w)) + 1)) AS i FROM nd WHERE len(w) > 0)),
nn AS (SELECT doc_id, count(*) AS n FROM ns GROUP BY doc_id),
np AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM ns a JOIN ns b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
ne AS (SELECT a, b FROM np JOIN nn x ON x.doc_id = a JOIN nn y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
nr AS (SELECT doc_id AS v, doc_id AS r FROM nd UNION SELECT ne.b, nr.r FROM nr JOIN ne ON ne.a = nr.v),
near AS (SELECT nd.doc_id, coalesce(any_value(nn.n), 0)::BIGINT AS n_shingles, min(nr.r) AS component_id
         FROM nd LEFT JOIN nn ON nn.doc_id = nd.doc_id JOIN nr ON nr.v = nd.doc_id GROUP BY nd.doc_id)"""


OP2_SQL = f"WITH RECURSIVE {near_sql('documents')} SELECT doc_id, n_shingles, component_id FROM near"
