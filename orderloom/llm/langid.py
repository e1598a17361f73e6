"""Language identification with word-first backoff.

A text's words are its runs of letters, in lower case. A word known from training adds, for each language, the
logarithm of its relative frequency there. An unseen word is covered from its start by the longest known character
n-grams, of five letters down to one, that mark word ends, and adds their log frequencies; letters never seen add
nothing. The language with the greatest sum wins; its score is the posterior probability under equal priors, from
the mean over words so that long texts don't all score 1.

Learning counts words and n-grams of a sample: up to SAMPLE documents of each language, every one that has a text,
chosen by a hash of the id, rows of one id being one document. The counts, and which VOCABULARY words and GRAMS n-grams
of a language are most frequent, are DataFrame aggregates; only those reach the driver and are broadcast: a fixed size
for each language, whatever the corpus. Log frequencies are kept as a floor for each language and what a string adds to
it in the languages that have it. Prediction is a map over whole texts.

Defined results: null texts and texts without a letter are `und` with score 0, digits and other numerals being no
letters; where nothing was learned every text is `und`; ties go to the language first by code point; texts of any length
are read in stretches, words of any length are words; repeated rows are predicted alike; an empty table gives an empty
one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_fold, join_nulls, staged, table, turn

#: Documents of each language that learning takes, and words and n-grams kept of each language.
SAMPLE, VOCABULARY, GRAMS = 800, 20_000, 20_000
#: Letters of an n-gram, at most; bytes of the rows that a worker keeps, and the longest word of these; characters of a text
#: read at once; strings whose counts a task holds at once.
LONGEST, KEPT_BYTES, KEPT_LENGTH, STRETCH, COUNTED = 5, 10_000_000, 64, 1 << 20, 200_000
FOLDS, HELD = 3, 1
#: Runs of letters and of numerals that aren't decimal digits, and runs of such numerals alone: one pattern without both reads slowly.
RUNS = re.compile(r"[^\W\d_]+")
NUMERALS = re.compile(f"[{re.escape(''.join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()))}]+")


def letter_runs(text: str) -> list[str]:
    """The text's runs of letters."""
    runs = RUNS.findall(text)
    if text.isascii() or all(map(str.isalpha, runs)):
        return runs
    return [word for run in runs for word in ([run] if run.isalpha() else NUMERALS.split(run)) if word]


def grams(word: str) -> Iterator[str]:
    """All n-grams of a word between marks of its ends."""
    marked = f"<{word}>"
    for n in range(1, LONGEST + 1):
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


class Frequencies:
    """Smoothed log frequencies of strings by language: a floor, and what is added where a language has the string."""

    def __init__(self, counts: Iterable[tuple[int, str, int]], totals: list[int]):
        """counts: (language, string, n)."""
        got = sorted((s, x, n) for x, s, n in counts)
        names = [s for k, (s, _, _) in enumerate(got) if not k or got[k - 1][0] != s]
        starts = [k for k, (s, _, _) in enumerate(got) if not k or got[k - 1][0] != s]
        self.at = {s: k for k, s in enumerate(names)}
        self.cuts = np.array([*starts, len(got)], dtype=np.int64)
        self.languages = np.array([x for _, x, _ in got], dtype=np.int32)
        self.gains = np.log(np.array([n for _, _, n in got], dtype=float) / 0.1 + 1)
        self.floor = np.log(0.1 / (np.array(totals, dtype=float) + 0.1 * max(1, len(names))))

    def add(self, rows: np.ndarray, places: list[int], found: list[int]) -> None:
        """Add the log frequencies of known strings, given by number, to the rows in their places."""
        if not found:
            return
        to, own = np.array(places), np.array(found)
        rows += np.bincount(to, minlength=len(rows))[:, None] * self.floor
        sizes = self.cuts[own + 1] - self.cuts[own]
        ends = sizes.cumsum()
        at = np.arange(ends[-1]) + (self.cuts[own] - ends + sizes).repeat(sizes)
        np.add.at(rows, (to.repeat(sizes), self.languages[at]), self.gains[at])


@dataclass
class Model:
    """Log frequencies of known words and n-grams."""

    languages: list[str]
    words: Frequencies
    grams: Frequencies

    def row(self, word: str) -> np.ndarray:
        """A word's log frequencies."""
        return self.rows([word])[0]

    def rows(self, words: list[str]) -> np.ndarray:
        """Words' log frequencies; of an unseen one, those of the longest known n-grams first, each over letters not covered yet."""
        rows = np.zeros((len(words), len(self.languages)))
        known, numbers, unseen, pieces = [], [], [], []
        word_at, gram_at = self.words.at.get, self.grams.at.get
        for place, word in enumerate(words):
            if (k := word_at(word)) is not None:
                known.append(place)
                numbers.append(k)
                continue
            marked, at = f"<{word}>", 0
            while at < len(marked):
                for n in range(min(LONGEST, len(marked) - at), 0, -1):
                    if (k := gram_at(marked[at : at + n])) is not None:
                        unseen.append(place)
                        pieces.append(k)
                        break
                at += n
        self.words.add(rows, known, numbers)
        self.grams.add(rows, unseen, pieces)
        return rows


_COUNTS = "lang string, string string, n bigint"


def _counted(pairs: Iterable[tuple[str, Iterable[str], int]]) -> Iterator[pa.RecordBatch]:
    """(language, string, n) summed as far as a task holds them at once."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array(held.values(), pa.int64())], ["lang", "string", "n"])

    for lang, strings, n in pairs:
        for s in strings:
            held[lang, s] += n
            if len(held) >= COUNTED:
                yield out()
                held.clear()
    if held:
        yield out()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted((lang, letter_runs(part), 1) for b in batches for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for part in _stretches(text.lower()))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted((lang, grams(word), n) for b in batches for lang, word, n in zip(*(b.column(k).to_pylist() for k in range(3))))


def _frequencies(counted: DataFrame, most: int, languages: list[str]) -> Frequencies:
    """Of the strings that are among the most frequent ones of a language, the counts in all languages."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "string")
    kept = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("string").distinct()
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    number = {x: k for k, x in enumerate(languages)}
    rows = counted.join(kept, "string").select("lang", "string", "n").toArrow()
    found = zip((number[x] for x in rows.column("lang").to_pylist()), rows.column("string").to_pylist(), rows.column("n").to_pylist())
    return Frequencies(found, [totals.get(x, 0) for x in languages])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from texts and languages outside the held-out fold."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (crc_fold("doc_id", FOLDS) != HELD)).withColumn("order", F.xxhash64("doc_id"))
    ids = staged(rows.distinct(), "ids")
    sizes = ids.groupBy("lang").count()
    # Ids under a share of the hashes, about four samples of each language, are ranked; so few rows of it meet however many it has.
    share = F.ceil(F.lit(4.0 * SAMPLE * (1 << 30)) / F.col("count"))
    few = ids.join(sizes, "lang").where(F.pmod("order", F.lit(1 << 30)) < share)
    first = Window.partitionBy("lang").orderBy("order", "doc_id")
    some = staged(few.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= SAMPLE).select("doc_id", "lang"), "sample")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    chosen = join_nulls(texts, some, ["doc_id", "lang"], "left_semi").select("lang", "text")
    sums = lambda df, name: staged(df.groupBy("lang", "string").agg(F.sum("n").alias("n")), name)
    words = sums(chosen.mapInArrow(_words, _COUNTS), "words")
    pieces = sums(words.mapInArrow(_grams, _COUNTS), "grams")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    return Model(languages, _frequencies(words, VOCABULARY, languages), _frequencies(pieces, GRAMS, languages))


class Predictor:
    """A model with the rows of words met lately."""

    def __init__(self, model: Model):
        self.model = model
        self.room = max(1000, KEPT_BYTES // (8 * max(1, len(model.languages))))
        self.table = np.zeros((self.room, len(model.languages)))
        self.at: dict[str, int] = {}

    def sums(self, words: list[str]) -> np.ndarray:
        """The words' rows added up."""
        ids, more = [*map(self.at.get, words)], 0.0
        if None in ids:
            times = Counter(word for word, i in zip(words, ids) if i is None)
            new = [*times]
            for start in range(0, len(new), self.room):
                some = new[start : start + self.room]
                rows = self.model.rows(some)
                more = more + np.array([times[word] for word in some]) @ rows
                first = len(self.at)
                kept = [k for k, word in enumerate(some) if len(word) <= KEPT_LENGTH][: self.room - first]
                self.table[first : first + len(kept)] = rows[kept]
                self.at.update((some[k], first + n) for n, k in enumerate(kept))
            ids = [i for i in ids if i is not None]
        return self.table[ids].sum(axis=0) + more

    def predict(self, text: str | None) -> tuple[str, float]:
        if len(self.at) >= self.room:
            self.at.clear()
        total, n = np.zeros(len(self.model.languages)), 0
        for part in _stretches(text.lower()) if text else ():
            if words := letter_runs(part):
                total += self.sums(words)
                n += len(words)
        if not n or not len(total):
            return "und", 0.0
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(np.minimum((total - total[best]) / n, 0)).sum())


def _stretches(text: str) -> Iterator[str]:
    """The text in stretches that end at white space, if there is any."""
    at = 0
    while len(text) - at > STRETCH:
        end = text.rfind(" ", at, at + STRETCH)
        end = end if end > at else at + STRETCH
        yield text[at:end]
        at = end
    yield text[at:] if at else text


_PREDICTORS: dict[str, Predictor] = {}


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("langid", _PREDICTORS.clear)
        if name not in _PREDICTORS:
            _PREDICTORS.clear()
            _PREDICTORS[name] = Predictor(shared.value)
        own = _PREDICTORS[name]
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                out = [own.predict(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([p for _, p in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return two.mapInArrow(run, two.drop("text").schema.add("lang_pred", "string").add("score", "double"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs))
    return found.select("doc_id", (crc_fold("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
