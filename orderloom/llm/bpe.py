"""Byte-level BPE, encoding and decoding, from a public tokenizer's JSON file.

Words are split by the byte-level pattern. A short word's parts are merged in a contiguous array: part ids beside
the ranks of adjacent pairs; the least rank is searched again and again, its boundary deleted and the neighbouring
ranks refreshed. That is done for many words at once, one word a row of a matrix. Words too long for it keep the
same pairs in a heap, with equal results.

The vocabulary file is read once on the driver and its bytes, of a fixed size whatever the corpus, go to the
workers. Each worker keeps the words it met last, up to WORDS, over tasks. There is no shuffle: rows stay where
they are.

Defined results: a null text is encoded as the empty one, to no tokens; added tokens in a text are found first
and get their ids; long texts are encoded whole; repeated rows and empty tables are nothing special; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, turn

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept by a worker in each of two generations, the longest whose encoding is kept, and the longest in bytes
#: whose ranks are scanned; words merged together, and texts encoded together.
WORDS, KEPT_LENGTH, SCAN, ROWS, TEXTS = 400_000, 48, 32, 4096, 256
#: Stands for the ids of a stretch that cannot be encoded without its neighbours.
ODD = "?"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spec: bytes):
        doc = json.loads(spec)
        model, letters = doc["model"], byte_letters()
        vocab, to_byte = model["vocab"], {c: b for b, c in letters.items()}
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
        keys = np.array([a << 32 | b for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([*self.ranks.values()], dtype=np.int32)[order]
        self.merged_ids, self.byte_ids = np.array(self.merged, dtype=np.int32), np.array(self.byte_id, dtype=np.int32)
        self.added = {t["content"]: t["id"] for t in doc.get("added_tokens", ())}
        self.id_bytes = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        self.id_bytes |= {i: token.encode() for token, i in self.added.items()}
        self.printed = {str(i): b for i, b in self.id_bytes.items()}
        self.split = regex.compile(PATTERN).findall
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.digits = {i: str(i) for i in self.id_bytes}
        self.ends = {c: str(vocab[c]) for c in ".,;:!?"}
        self.stretches = _Kept()

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out: list = [None] * len(words)
        short: dict[int, list[int]] = {8: [], 16: [], SCAN: []}
        for k, w in enumerate(words):
            n = len(w)
            if n == 1:
                out[k] = [self.byte_id[w[0]]]
            elif n > SCAN or not n:
                out[k] = self._merge_long([self.byte_id[b] for b in w])
            else:
                short[8 if n <= 8 else 16 if n <= 16 else SCAN].append(k)
        for group in short.values():
            for start in range(0, len(group), ROWS):
                self._merge_short(words, group[start : start + ROWS], out)
        return out

    def _merge_short(self, words: list[bytes], short: list[int], out: list) -> None:
        """The words at these places, one a row: scan for the least rank, delete a boundary, refresh its neighbours."""
        width, last = max(len(words[k]) for k in short), len(self.merged)
        raw = np.frombuffer(b"".join([words[k].ljust(width, b"\0") for k in short]), dtype=np.uint8).reshape(-1, width)
        lengths = np.array([len(words[k]) for k in short])
        parts = np.append(self.byte_ids[raw], np.full((len(short), 1), -1, dtype=np.int32), axis=1)
        parts[np.arange(width + 1) >= lengths[:, None]] = -1
        near = np.append(self._rank(parts[:, :-1], parts[:, 1:]), np.full((len(short), 1), last, dtype=np.int32), axis=1)
        places, own, column = np.array(short), np.arange(len(short)), np.arange(width)
        while True:
            at = near.argmin(axis=1)
            least = near[own, at]
            go = np.flatnonzero(least < last)
            if 2 * len(go) < len(own):
                idle = np.flatnonzero(least == last)
                sizes = (parts[idle] >= 0).sum(axis=1).tolist()
                for k, n, r in zip(places[idle].tolist(), sizes, parts[idle].tolist()):
                    out[k] = r[:n]
                if not len(go):
                    return
                places, parts, near, at, least = places[go], parts[go], near[go], at[go], least[go]
                own = go = np.arange(len(go))
            gone = column >= np.where(least < last, at, width)[:, None]
            near[:, :-1] = np.where(gone, near[:, 1:], near[:, :-1])
            gone[:, 0] = False
            gone[go, at[go]] = False
            parts[:, :-1] = np.where(gone, parts[:, 1:], parts[:, :-1])
            at, least = at[go], least[go]
            parts[go, at] = self.merged_ids[least]
            left = np.maximum(at - 1, 0)
            pair = self._rank(np.stack([parts[go, left], parts[go, at]]), np.stack([parts[go, at], parts[go, np.minimum(at + 1, width)]]))
            near[go, left] = np.where(at > 0, pair[0], near[go, left])
            near[go, at] = pair[1]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; the number of merges for pairs that never merge."""
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(len(self.merged)))

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for a long word, in time that grows little more than its length."""
        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.merged[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def _printed(self, pieces: list[str]) -> list[str]:
        """Printed ids of each piece."""
        digits = self.digits.__getitem__
        return [",".join(map(digits, ids)) for ids in self.merge([p.encode("utf-8", "replace") for p in pieces])]

    def _plain(self, text: str) -> str:
        """Printed ids of one text without added tokens, by the pattern."""
        pieces = self.split(text)
        own = [*{*pieces}]
        known = dict(zip(own, self._printed(own)))
        return ",".join(map(known.__getitem__, pieces))

    def _cut(self, stretch: str) -> list[str]:
        """The pieces of a space and a stretch that has no white space at its ends."""
        if stretch.isalpha():
            return [" " + stretch]
        if stretch[-1] in self.ends and stretch[:-1].isalpha():
            return [" " + stretch[:-1], stretch[-1]]
        return self.split(" " + stretch)

    def encode_printed(self, texts: list[str]) -> list[str]:
        """The ids of each text as decimals joined by commas.

        Stretches between single spaces are encoded on their own, as no piece of the pattern crosses the end of one
        unless white space meets there; such texts, and those with added tokens, are split as a whole."""
        whole = [any(t in text for t in self.added) for text in texts]
        cut = [[""] if w else text.split(" ") for w, text in zip(whole, texts)]
        heads = [c[0] for c in cut]
        get, new, met = self.stretches.get, set(), []
        for c in cut:
            c[0] = None
            met.append(ids := [*map(get, c)])
            ids[0] = ""
            if None in ids:
                new.update([s for s, i in zip(c, ids) if i is None])
        new.discard(None)
        self._learn(new, heads)
        get, out = self.stretches.__getitem__, []
        for w, c, h, ids in zip(whole, cut, heads, met):
            if w or (h and h[-1].isspace() and len(c) > 1):
                out.append(ODD)
                continue
            if None in ids:
                ids = [*map(get, c)]
            if h:
                ids[0] = self.heads[h]
                out.append(",".join(ids))
            else:
                out.append(ODD if len(c) > 1 and not c[1] else ",".join(ids[1:]))
        self.stretches.age(new)
        for k, ids in enumerate(out):
            if ODD in ids:
                runs = self.added_split(texts[k]) if whole[k] else [texts[k]]
                out[k] = ",".join(str(self.added[x]) if x in self.added else self._plain(x) for x in runs if x)
        return out

    def _learn(self, new: set[str], heads: list[str]) -> None:
        """Encode stretches not met yet, and first stretches, which have no space before them."""
        names, cuts, found = [], [], self.stretches
        for s in found.back(new):
            if not s or s[0].isspace() or s[-1].isspace():
                found[s] = ODD
            elif (known := found.get(s[:-1])) and s[-1] in self.ends and s[:-1].isalpha():
                found[s] = f"{known},{self.ends[s[-1]]}"
            else:
                names.append(s)
                cuts.append(self._cut(s))
        first = [h for h in {*heads} if h]
        cuts += [self.split(h) for h in first]
        ids = iter(self._printed([p for c in cuts for p in c]))
        printed = [next(ids) if len(c) == 1 else ",".join([next(ids) for _ in c]) for c in cuts]
        found.update(zip(names, printed))
        found[None] = ""
        self.heads = dict(zip(first, printed[len(names) :]))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_printed([text])[0].split(",") if x]

    def decode_printed(self, ids: str) -> str:
        return b"".join(map(self.printed.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.id_bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Kept(dict):
    """Printed ids by string, in two generations: what the older one holds is taken over when it is met again."""

    def __init__(self):
        self.old: dict[str, str] = {}

    def back(self, strings: set[str]) -> set[str]:
        """Take over what the older generation has of these strings; the others are returned."""
        held = strings & self.old.keys()
        self.update((s, self.old[s]) for s in held)
        return strings - held

    def age(self, new: set[str]) -> None:
        """Between batches: long ones of the new strings go, so what is kept has a bounded size; a full generation becomes the older one."""
        for s in new:
            if len(s) > KEPT_LENGTH:
                self.pop(s, None)
        if len(self) >= WORDS:
            self.old = {s: ids for s, ids in self.items() if s}
            self.clear()


_CODECS: dict[str, Codec] = {}


def codec(spec: bytes) -> Codec:
    """The codec of a vocabulary file's bytes; made once in a worker."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def _with_spec(spark: SparkSession, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _map(df: DataFrame, spec, schema: T.StructType, rows) -> DataFrame:
    """Two columns in, id and value; rows(codec, values) gives the other columns of schema, value by value."""
    arrow = [(f.name, {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string()}.get(f.dataType, pa.list_(pa.int32()))) for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("bpe", _CODECS.clear)
        own = codec(spec.value)
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                out = rows(own, batch.column(1).to_pylist())
                columns = [pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [schema.fields[0].name, *(n for n, _ in arrow)])

    return df.mapInArrow(run, schema)


def _ids(df: DataFrame, id_col: str, value_col: str) -> tuple[DataFrame, T.StructField]:
    two = df.select(F.col(id_col).alias("doc_id"), F.col(value_col).alias("value"))
    return two, T.StructField("doc_id", two.schema["doc_id"].dataType)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    two, first = _ids(docs, id_col, text_col)
    schema = T.StructType([first, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _map(two, _with_spec(docs.sparkSession, vocabulary), schema, lambda c, texts: [(np.fromstring(ids, np.int32, sep=","),) for ids in c.encode_printed([t or "" for t in texts])])


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids."""
    two, first = _ids(tokens, id_col, ids_col)
    schema = T.StructType([first, T.StructField("text", T.StringType())])
    return _map(two, _with_spec(tokens.sparkSession, vocabulary), schema, lambda c, values: [(c.decode(ids or []),) for ids in values])


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and the ids if asked for: every text encoded, and its ids decoded again."""

    def digests(c: Codec, texts: list[str | None]) -> list[tuple]:
        out = []
        for ids in c.encode_printed([t or "" for t in texts]):
            again = c.decode_printed(ids)
            own = (np.fromstring(ids, np.int32, sep=","),) if with_ids else ()
            out.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(again.encode()).hexdigest(), *own))
        return out

    two, first = _ids(docs, id_col, text_col)
    schema = T.StructType([first, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return _map(two, _with_spec(docs.sparkSession, vocabulary), schema, digests)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_vocabulary())
