"""Exact Jaccard self-join of documents on word shingles, filtered by prefixes under several global token orders.

If two sets of sizes a and b have a similarity of t or more, they share a token among the first
n - ceil(t n) + 1 of each, under any one order of all tokens. Three orders are used. All put tokens that
one document alone has first, which can never match: documents that keep nothing after them are out at once. The
first order goes on with rare tokens, the others with two hashes. Candidates share a prefix token under the first
order; their prefixes under the others must meet, too, before their sets are compared.

1. Every text becomes a set of hashed shingles (numpy over bytes). Documents are packed into groups. A group sends each
   token once to the range of its hash: with its document if only one of the group has it, with their number otherwise;
   so what a range gets of a token grows with the groups, not with the documents, that have it. Ranges add the numbers up
   and send back which tokens are in two documents or more, and in how many. Counts are over all documents. Per
   document, those tokens are all that an intersection can hold.
2. Documents of equal sets are one class from here on.
3. In each prefix token's group every class is checked against a few leaders, and components of the links follow; this
   is done in two rounds. Only where a group still holds several components, members outside its largest one are checked
   against members of other components: first by a bound of the sets' difference from 512-bit signatures inside the join,
   so that only pairs that may be links become rows. Links inside a component can't change it, so none is lost and no
   group's pairs are listed.

Tokens are hashes of 48 bits beside those of the range; words aren't compared. A false link needs two different shingles
of the two documents themselves with one hash: below 1e-8 for a pair of 20,000-word texts.

Defined results: texts without words have an empty set and are linked with nothing; with fewer words than a
shingle's the whole sequence is one token; texts of any length are hashed in tiles, and the longest one's tokens are the
least that a task holds; a null id takes part in no link and gets a null component; rows of one id, whatever their texts,
are one node; an empty table gives an empty one; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, input_partitions, staged, table, text_or_empty, turn
from .components import components
from .quality import column_bytes

#: Words of a shingle, and the similarity in hundredths.
SHINGLE, PERCENT = 5, 80
#: Bytes hashed at once, tokens and documents packed together, token ranges for each input partition.
TILE, GROUP_TOKENS, GROUP_DOCS, RANGES = 1 << 18, 1 << 19, 60_000, 8
#: Leaders that a class is checked against in a round, and rounds, before what is left is checked in full.
LEADERS, ROUNDS = 4, 2
LOW = np.uint64((1 << 48) - 1)
#: Words of 64 bits in a signature.
SIGNATURE = 8

_RNG = np.random.default_rng(20240229)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_LETTER[_SPACE] = 0
_MULT = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, TILE + (TILE >> 3))
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word of these bytes, and its hash; A-Z count as a-z."""
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(buf) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[buf] * power[: len(buf)], dtype=np.uint64)])
    return start, _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def _tiles(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, word hash) of runs of documents; a long document comes in several tiles, cut at white space."""
    held, bytes_held = [], 0

    def hashed() -> tuple[np.ndarray, np.ndarray]:
        sep = np.array([32], dtype=np.uint8)
        buf = np.concatenate([x for _, d in held for x in (d, sep)])
        start, words = word_hashes(buf)
        ends = np.cumsum([len(d) + 1 for _, d in held])
        return np.array([k for k, _ in held])[np.searchsorted(ends, start, side="right")], words

    for k, d in enumerate(docs):
        while len(d):
            room = TILE - bytes_held
            if len(d) <= room or (len(d) <= TILE and not held):
                part, d = d, d[:0]
            elif len(d) <= TILE:
                part = d[:0]
            else:
                gaps = np.flatnonzero(_SPACE[d[:room]])
                cut = int(gaps[-1]) + 1 if len(gaps) else 0
                if not cut and not held:
                    after = np.flatnonzero(_SPACE[d])
                    cut = int(after[0]) + 1 if len(after) else len(d)
                part, d = d[:cut], d[cut:]
            if len(part):
                held.append((k, part))
                bytes_held += len(part) + 1
            if len(d):
                if held:
                    yield hashed()
                held, bytes_held = [], 0
    if held:
        yield hashed()


def shingle_sets(docs: list[np.ndarray]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    out: list = [np.zeros(0, np.uint64)] * len(docs)
    owners, words, done = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0

    def finish(owner: np.ndarray, word: np.ndarray) -> None:
        n = len(word)
        if not n:
            return
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        if n >= SHINGLE:
            hashes = sum((word[k : n - SHINGLE + 1 + k] * _MULT[k] for k in range(1, SHINGLE)), word[: n - SHINGLE + 1] * _MULT[0])
            hashes = _mix(hashes)
        last = np.append(first[1:], n)
        for k, a, b in zip(owner[first].tolist(), first.tolist(), last.tolist()):
            if b - a >= SHINGLE:
                out[k] = np.unique(hashes[a : b - SHINGLE + 1])
            else:
                out[k] = _mix((word[a:b] * _MULT[8 : 8 + b - a]).sum(keepdims=True) + np.uint64(b - a))

    for owner, word in _tiles(docs):
        owners, words = np.concatenate([owners, owner]), np.concatenate([words, word])
        done = int(np.searchsorted(owners, owners[-1])) if len(owners) else 0
        finish(owners[:done], words[:done])
        owners, words = owners[done:], words[done:]
    finish(owners, words)
    return out


def _pack(tokens: np.ndarray) -> bytes:
    """Sorted 48-bit values in two planes, the upper of which compresses well."""
    return (tokens >> np.uint64(32)).astype("<u2").tobytes() + tokens.astype("<u4").tobytes()


def _unpack(blob: np.ndarray) -> np.ndarray:
    n = len(blob) // 6
    return (blob[: 2 * n].view("<u2").astype(np.uint64) << np.uint64(32)) | blob[2 * n :].view("<u4")


#: Rows of three kinds. A group's own: ids, sizes, digests, and tokens of several of its documents with their number
#: and the documents. To a range: tokens of one document and the documents; tokens of several and their number. Back from
#: a range: those of the former that are shared, documents, document frequencies; document frequencies of the latter.
_BLOBS = ["a", "b", "c", "d", "e", "f"]
_PACKED = "range int, part bigint, whole boolean, " + ", ".join(f"{x} binary" for x in _BLOBS)


def _table(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int64(), pa.bool_(), *(pa.binary() for _ in _BLOBS)]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["range", "part", "whole", *_BLOBS])


def _blobs(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x for chunk in column.chunks for x in column_bytes(chunk)]


def _joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def _tokens_of(bits: int):
    """Texts to packed tokens by range, and one row with the documents themselves for each group of documents."""
    shift = np.uint64(max(0, 16 - bits))

    def pack(ids: list, sets: list[np.ndarray], place: bytes) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
        known = np.array([i for i in ids if i is not None], dtype="<i8")
        nulls = np.array([i is None for i in ids])
        part = int.from_bytes(hashlib.blake2b(place + digests, digest_size=8).digest(), "little", signed=True)
        all_ids = np.zeros(len(ids), "<i8")
        all_ids[~nulls] = known
        tokens, docs = np.concatenate(sets) >> shift, np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        order = np.argsort(tokens)
        tokens, docs = tokens[order], docs[order]
        runs = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] ^ np.uint64(1)))
        counts = np.diff(np.append(runs, len(tokens)))
        many = counts > 1
        in_many = np.repeat(many, counts)
        one, one_docs, some, some_counts = tokens[~in_many], docs[~in_many], tokens[runs[many]], counts[many].astype("<u4")
        own = all_ids.tobytes() + nulls.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes(), digests
        rows = [(part % (1 << bits), part, True, *own, some.tobytes(), some_counts.tobytes(), docs[in_many].tobytes())]
        top = np.arange(1, 1 << bits, dtype=np.uint64) << (np.uint64(64 - bits) - shift)
        cuts = [[0, *np.searchsorted(x, top).tolist(), len(x)] for x in (one, some)]
        for r, (a, b, c, d) in enumerate(zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:])):
            if b > a or d > c:
                rows.append((r, part, False, _pack(one[a:b] & LOW), one_docs[a:b].tobytes(), None, _pack(some[c:d] & LOW), some_counts[c:d].tobytes(), None))
        return _table(rows).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("jaccard", _POWERS.clear)
        ids, sets, held, packs, task = [], [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            texts = column_bytes(batch.column(1))
            own, start = batch.column(0).to_pylist(), 0
            for end in _cuts([len(t) for t in texts]):
                new = shingle_sets(texts[start:end])
                ids += own[start:end]
                sets += new
                held += sum(map(len, new))
                start = end
                if held >= GROUP_TOKENS or len(ids) >= GROUP_DOCS:
                    yield pack(ids, sets, f"{task}:{packs}:".encode())
                    ids, sets, held, packs = [], [], 0, packs + 1
        if ids:
            yield pack(ids, sets, f"{task}:{packs}:".encode())

    return run


def _cuts(sizes: list[int]) -> Iterator[int]:
    """Where to cut documents into runs of about four tiles, and at most a thousand."""
    held, count = 0, 0
    for k, n in enumerate(sizes):
        held, count = held + n, count + 1
        if held >= 4 * TILE or count >= 1000:
            yield k + 1
            held, count = 0, 0
    if count:
        yield len(sizes)


def _shared(key: tuple, group: pa.Table) -> pa.Table:
    """Of one range of tokens: back to their groups go those of two documents or more, with the number of these."""
    turn("jaccard", _POWERS.clear)
    whole, parts = group.column("whole").to_pylist(), group.column("part").to_pylist()
    a, b, c, d, e, f = (_blobs(group.column(x)) for x in _BLOBS)
    out = [(key[0].as_py(), parts[k], True, *(x[k].tobytes() for x in (a, b, c, d, e, f))) for k in np.flatnonzero(whole).tolist()]
    packs = np.flatnonzero(~np.array(whole, dtype=bool)).tolist()
    ones, somes = [_unpack(a[k]) for k in packs], [_unpack(d[k]) for k in packs]
    tokens = _joined([*ones, *somes], "<u8")
    weights = _joined([np.ones(sum(map(len, ones)), "<u4"), *(e[k].view("<u4") for k in packs)], "<u4")
    order = np.argsort(tokens)
    runs = np.flatnonzero(np.diff(tokens[order], prepend=tokens[order[:1]] ^ np.uint64(1)))
    total = np.add.reduceat(weights[order], runs, dtype=np.int64) if len(runs) else np.zeros(0, np.int64)
    df = np.empty(len(tokens), "<u2")
    df[order] = np.repeat(np.minimum(total, 65535), np.diff(np.append(runs, len(tokens))))
    at, more = 0, sum(map(len, ones))
    for k, one, some in zip(packs, ones, somes):
        own, here = df[at : at + len(one)], df[more : more + len(some)]
        at, more, keep = at + len(one), more + len(some), own >= 2
        if len(some) or keep.any():
            out.append((key[0].as_py(), parts[k], False, _pack(one[keep]), b[k].view("<u2")[keep].tobytes(), own[keep].tobytes(), None, here.tobytes(), None))
    return _table(out)


_SETS = "doc_id bigint, n bigint, digest binary, tokens array<bigint>, p1 array<bigint>, p2 array<bigint>, p3 array<bigint>, sign array<bigint>"


def _signature(tokens: np.ndarray) -> np.ndarray:
    """The parity of the tokens that fall on each bit: of two sets, bits that differ are no more than tokens that do."""
    spot = _mix(tokens + np.uint64(4)) % np.uint64(64 * SIGNATURE)
    odd = (np.bincount(spot.astype(np.int64), minlength=64 * SIGNATURE) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _sets_of(bits: int):
    """Groups of documents again: size and digest of each, and tokens, prefixes and signature of those that can have a link."""

    def sets(group: pa.Table) -> pa.Table:
        turn("jaccard", _POWERS.clear)
        ranges, whole = group.column("range").to_pylist(), group.column("whole").to_pylist()
        a, b, c, d, e, f = (_blobs(group.column(x)) for x in _BLOBS)
        head = whole.index(True)
        count = len(b[head]) // 4
        ids, nulls, sizes = a[head][: 8 * count].view("<i8").tolist(), a[head][8 * count :].tolist(), b[head].view("<u4").tolist()
        digests = [c[head][16 * k : 16 * k + 16].tobytes() for k in range(count)]
        packs = sorted((k for k, w in enumerate(whole) if not w), key=lambda k: ranges[k])
        tops = [np.uint64(ranges[k] if bits <= 16 else ranges[k] >> (bits - 16)) << np.uint64(48) for k in packs]
        some, some_counts = d[head].view("<u8"), e[head].view("<u4")
        tokens = _joined([*(_unpack(a[k]) | top for k, top in zip(packs, tops)), np.repeat(some, some_counts)], "<u8")
        docs = _joined([*(b[k].view("<u2") for k in packs), f[head].view("<u2")], "<u2")
        df = _joined([*(c[k].view("<u2") for k in packs), np.repeat(_joined([e[k].view("<u2") for k in packs], "<u2"), some_counts)], "<u2")
        order = np.argsort(docs, kind="stable")
        cuts = np.searchsorted(docs[order], np.arange(count + 1)).tolist()
        lists: list[list] = [[], [], [], [], []]
        for n, null, start, end in zip(sizes, nulls, cuts, cuts[1:]):
            if null or not n or 100 * (end - start) < PERCENT * n:
                for x in lists:
                    x.append(None)
                continue
            t, often = tokens[order[start:end]], df[order[start:end]]
            left = n + (-PERCENT * n // 100) + 1 - (n - (end - start))
            h1, h2, h3 = (_mix(t + np.uint64(s)) for s in (1, 2, 3))
            for x, pick in zip(lists, (slice(None), np.lexsort((h1, often))[:left], np.argsort(h2)[:left], np.argsort(h3)[:left])):
                x.append(t[pick].view(np.int64))
            lists[4].append(_signature(t))
        names = ["doc_id", "n", "digest", "tokens", "p1", "p2", "p3", "sign"]
        columns = [pa.array([None if z else i for i, z in zip(ids, nulls)], pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())]
        return pa.table([*columns, *(pa.array(x, pa.list_(pa.int64())) for x in lists)], names=names)

    return sets


def token_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its set's size and digest; tokens, prefixes and signature where it may have a partner."""
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    bits = max(1, (RANGES * input_partitions(two) - 1).bit_length())
    packed = two.mapInArrow(_tokens_of(bits), _PACKED)
    back = packed.groupBy("range").applyInArrow(_shared, _PACKED)
    return back.groupBy("part").applyInArrow(_sets_of(bits), _SETS)


def _fit(a: str, b: str) -> Column:
    """Sizes that allow the similarity."""
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def _linked(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of candidate pairs (u, v, ...), those whose prefixes meet under the other orders and whose sets are similar enough."""
    side = lambda x: classes.select(F.col("class").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "p2", "p3", "tokens")))
    both = pairs.join(side("u"), "u").join(side("v"), "v").where(_fit("u_n", "v_n"))
    met = both.where(F.arrays_overlap("u_p2", "v_p2") & F.arrays_overlap("u_p3", "v_p3"))
    common = met.withColumn("common", F.size(F.array_intersect("u_tokens", "v_tokens")))
    return common.where(100 * F.col("common") >= PERCENT * (F.col("u_n") + F.col("v_n") - F.col("common"))).select(*pairs.columns)


def _could(a: str, b: str) -> Column:
    """Whether sizes, and the tokens that others have at all, allow the similarity; a and b name structs' prefixes."""
    common = F.least(f"{a}m", f"{b}m")
    return _fit(f"{a}n", f"{b}n") & (100 * common >= PERCENT * (F.col(f"{a}n") + F.col(f"{b}n") - common))


def _close(a: str, b: str) -> Column:
    """Whether the least difference that signatures and own tokens leave allows the similarity."""
    apart = sum((F.bit_count(F.col(f"{a}sign")[k].bitwiseXOR(F.col(f"{b}sign")[k])) for k in range(SIGNATURE)), F.col(f"{a}n") - F.col(f"{a}m") + F.col(f"{b}n") - F.col(f"{b}m"))
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (F.col(f"{a}n") + F.col(f"{b}n"))


def _rooted(entries: DataFrame, found: DataFrame | None) -> DataFrame:
    """The entries with their classes' roots."""
    if found is None:
        return entries.withColumn("root", F.col("class"))
    return entries.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def _stars(at: DataFrame, seeds: range) -> DataFrame:
    """Candidate pairs (u, v, u_root, v_root): for each seed, one for a class at most.

    Every token's group has a leader for each seed; a class takes the first of its tokens' leaders that is in another
    component. Similar texts so meet the same few leaders, whatever their number. Leaders are first by a hash, for every
    second seed among those with fewest tokens of their own: of edited copies, that is the one they were made from, which
    is similar to all of them even where they aren't to each other."""
    own_tokens = lambda k: (F.col("n") - F.col("m")) if k % 2 == 0 else F.lit(0).cast("long")
    lead = {k: F.min(F.struct(own_tokens(k).alias("own"), F.xxhash64("hash", F.lit(k)).alias("h"), "class", "n", "m", "root")).alias(f"l{k}") for k in seeds}
    leaders = at.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), *lead.values()).where("low <> high").drop("low", "high")
    near = at.join(leaders, "token")
    pick = [F.min(F.when((F.col(f"l{k}.root") != F.col("root")) & _could("", f"l{k}."), F.col(f"l{k}"))).alias(f"l{k}") for k in seeds]
    own = near.groupBy("class", "root").agg(*pick)
    met = F.array_distinct(F.transform(F.filter(F.array(*(f"l{k}" for k in seeds)), lambda x: x.isNotNull()), lambda x: F.struct(x["class"].alias("u"), x.root.alias("u_root"))))
    return own.select(F.explode(met).alias("l"), F.col("class").alias("v"), F.col("root").alias("v_root")).select("l.u", "v", "l.u_root", "v_root")


def _merged(found: DataFrame | None, pairs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """found, with the components of those candidate pairs put together that are links."""
    links = staged(_linked(pairs, classes).select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).distinct(), "links")
    if links.isEmpty():
        return found
    roots = components(links)
    if found is None:
        return roots
    moved = found.join(roots.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return staged(moved.unionByName(roots), "found")


def _outsiders(at: DataFrame) -> DataFrame:
    """Candidate pairs of a token's group with a member outside its largest component, in different components."""
    by = at.groupBy("token", "root").agg(F.count(F.lit(1)).alias("here")).groupBy("token")
    by = by.agg(F.max(F.struct("here", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    mixed = staged(at.join(by.select("token", F.col("most.root").alias("main")), "token"), "mixed")
    others = mixed.where("root <> main").select("token", *(F.col(c).alias(f"o_{c}") for c in ("class", "n", "m", "root", "sign")))
    meet = (F.col("root") != F.col("o_root")) & ((F.col("root") == F.col("main")) | (F.col("class") < F.col("o_class"))) & _could("", "o_") & _close("", "o_")
    rest = others.join(mixed, "token").where(meet)
    flip = F.col("class") < F.col("o_class")
    either = lambda a, b: F.when(flip, F.col(a)).otherwise(F.col(b))
    return rest.select(
        either("class", "o_class").alias("u"), either("o_class", "class").alias("v"), either("root", "o_root").alias("u_root"), either("o_root", "root").alias("v_root")
    ).distinct()


def linked_components(sets: DataFrame) -> DataFrame:
    """(doc_id, component_id) of all documents that may have a partner. sets: token_sets with row, a number of each row."""
    able = sets.where("tokens is not null")
    same = able.groupBy("digest").agg(F.min("row").alias("class"))
    members = staged(able.select("doc_id", "digest").join(same, "digest").select("doc_id", "class").distinct(), "members")
    classes = staged(able.join(same.select("class"), F.col("row") == F.col("class")).drop("row", "doc_id"), "classes")
    # Texts of one id are one node.
    shared = members.groupBy("doc_id").agg(F.min("class").alias("u"), F.max("class").alias("most")).where("u <> most")
    ties = staged(members.join(shared, "doc_id").select("u", F.col("class").alias("v")), "ties")
    found = None if ties.isEmpty() else components(ties)
    entries = classes.select(F.explode("p1").alias("token"), "class", F.xxhash64("digest").alias("hash"), "n", F.size("tokens").cast("long").alias("m"))
    many = entries.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("token")
    entries = staged(entries.join(many, "token"), "entries")
    for start in range(0, LEADERS * ROUNDS, LEADERS):
        found = _merged(found, _stars(_rooted(entries, found), range(start, start + LEADERS)), classes)
    found = _merged(found, _outsiders(_rooted(entries, found).join(classes.select("class", "sign"), "class")), classes)
    rooted = _rooted(members, found).select("doc_id", "root")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.distinct().join(least, "root").select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    sets = staged(token_sets(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sets")
    found = linked_components(sets).where("doc_id <> component_id")
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those of a component's other members than its smallest id."""
    gone = staged(near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    gone = broadcast_if(gone, gone.count(), 1_000_000)
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
