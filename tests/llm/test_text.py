"""BPE, quality and language operators."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import SF, documents, everything
from orderloom.llm import bpe, langid, quality


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.default_vocabulary()


def texts():
    r = random.Random(5)
    kinds = (lambda: r.randrange(128), lambda: r.randrange(0x3000), lambda: r.randrange(0x1F000, 0x20000), lambda: 32, lambda: 9, lambda: 10, lambda: r.choice(b"aeinst'"))
    out = ["", " ", "  a", "a ", "a\x00 b", " \x00", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "don't I'LL", "é" * 400, "ab" * 900, " " * 700, "x\x1c\x85\xa0　 y", "1234567", "a\n\n b\t\tc"]
    return out + ["".join(chr(r.choice(kinds)()) for _ in range(r.randrange(50))).encode("utf-8", "replace").decode() for _ in range(1500)]


def test_bpe_equals_library(vocabulary):
    from tokenizers import Tokenizer

    ours, library = bpe.Codec(open(vocabulary, "rb").read()), Tokenizer.from_file(vocabulary)
    for text, ids in zip(texts(), ours.encode_printed(texts())):
        want = library.encode(text, add_special_tokens=False).ids
        assert [int(i) for i in ids.split(",") if i] == want == ours.encode(text)
        assert ours.decode(want) == library.decode(want, skip_special_tokens=False) == ours.decode_printed(ids)


def test_turns(monkeypatch):
    from orderloom.llm import common

    monkeypatch.setattr(common, "_LAST", {})
    held = {1: "codec"}
    for operator, kept in (("a", 1), ("a", 1), ("b", 0), ("a", 0)):
        common.turn(operator, held.clear if operator == "a" else None)
        assert len(held) == kept


def test_bpe_kept_words(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    few, many = bpe.Codec(open(vocabulary, "rb").read()), bpe.Codec(open(vocabulary, "rb").read())
    some = ["the cat sat on the mat " * 3, "on the other hand, the cat", "the cat sat"]
    for _ in range(3):
        assert few.encode_printed(some) == [many.encode_printed([t])[0] for t in some]


def test_bpe_operators(spark, vocabulary):
    docs = everything(spark)
    ids = bpe.encode(docs, vocabulary)
    again = {(r.doc_id, r.text) for r in bpe.decode(ids, vocabulary).collect()}
    assert again == {(r.doc_id, r.text or "") for r in docs.collect()}
    trip = bpe.round_trip(docs, vocabulary).join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("want")).distinct(), "doc_id")
    assert trip.where("want <> decoded_sha256").where("doc_id <> 0").isEmpty()
    assert bpe.round_trip(docs.limit(0), vocabulary).count() == 0
    assert bpe.round_trip(docs.where("text is null"), vocabulary).first().n_tokens == 0


@pytest.fixture(scope="module")
def net(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return quality.train(docs, labels)


def test_quality_held_out(spark, net):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs.join(labels.where("quality is not null"), "doc_id").where(quality.crc_fold("doc_id", 5) == 0).select("doc_id", "text", "quality"), net).collect()
    right = np.mean([(r.score >= quality.THRESHOLD) == r.quality for r in rows])
    assert len(rows) > 300 and right > 0.9


def test_quality_reads_whole_texts(net):
    long = np.frombuffer(("Plain words of a text that goes on. " * 9000 + "$$$ %%% ### " * 300).encode(), dtype=np.uint8)
    short = [np.frombuffer(t.encode(), dtype=np.uint8) for t in ("", "a", "A short text.")]
    together = net.score([short[0], long, short[1], short[2]])
    assert np.allclose(together, [net.score([d])[0] for d in (short[0], long, short[1], short[2])], atol=1e-5)
    last = np.array([quality.segments(len(long))])
    act = net.activations(quality.laid_out([long], last), last)
    assert np.allclose(net.probability(act.max(axis=0)[None], act.mean(axis=0)[None]), together[1], atol=1e-4)


def test_quality_odd_rows(spark, net):
    docs = everything(spark)
    got = quality.score(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert quality.score(docs.limit(0), net).count() == 0
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 0, 0), (2, 1, 0), (3, 1, 1)], none.schema)
    assert quality.keep_good(docs, odd).columns == docs.columns


def test_quality_one_row_of_each_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "SAMPLE", 10)
    monkeypatch.setattr(quality.ByteNet, "fit", lambda self, texts, labels: seen.append(sorted((t.tobytes(), int(q)) for t, q in zip(texts, labels))))
    rows = [(1, f"copy {k}") for k in range(300)] + [(k, f"text {k}") for k in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 12)], "doc_id long, quality int, toxic int")
    used = {r.doc_id for r in labels.where(quality.crc_fold("doc_id", quality.FOLDS) != 0).collect()}
    for n in (1, 5):
        quality.train(docs.repartition(n, "text"), labels)
    assert 1 in used and len(seen[0]) == len(used) and seen[0] == seen[1] and {q for _, q in seen[0]} == {0, 1}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(langid.crc_fold("doc_id", 3) == 1)
    rows = found.collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 < r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    docs = everything(spark)
    got = langid.predict(docs, langid.learn(docs)).collect()
    assert len(got) == docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (None, 3, 5)} == {"en"}
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2)] == [("und", 0.0)] * 2
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(docs.limit(0))).collect()} == {"und"}


def test_language_of_mostly_null_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 5)
    rows = [(k, "the plain words", "en") for k in range(50)] + [(k, None if k < 2000 else "les mots simples", "fr") for k in range(50, 2010)]
    assert langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["en", "fr"]


def model_of(texts):
    """A model of {language: words}."""
    from collections import Counter

    names = sorted(texts)
    words, pieces = [Counter(texts[x].split()) for x in names], [Counter(g for w in texts[x].split() for g in langid.grams(w)) for x in names]
    of = lambda counts: langid.Frequencies([(k, s, n) for k, c in enumerate(counts) for s, n in c.items()], [sum(c.values()) for c in counts])
    return langid.Model(names, of(words), of(pieces))


def test_language_backoff():
    own = langid.Predictor(model_of({"en": "the the the", "fr": "le le le"}))
    assert own.model.row("then").argmax() == 0 and own.model.row("les").argmax() == 1
    assert own.predict("The thex")[0] == "en" and own.predict("le lex le")[0] == "fr"
    for text in ("12 !", "½ ²", "Ⅷ ①", "٣ 7_", "", None):
        assert own.predict(text) == ("und", 0.0), text
    assert own.predict("½the ²the")[0] == "en" and own.predict("the" * 200_000)[0] == "en"


def test_language_words_that_are_not_kept(monkeypatch):
    model = model_of({"en": "the cat sat on mat", "fr": "le chat est sur la table", "de": "die katze sitzt auf der matte"})
    texts = ["the chat katze " * 30, "x" * 300 + " le chat", "auf der matte"]
    want = [langid.Predictor(model).predict(t) for t in texts]
    own = langid.Predictor(model)
    own.room = 2
    assert all(own.predict(t)[0] == w[0] and abs(own.predict(t)[1] - w[1]) < 1e-9 for t, w in zip(texts * 3, want * 3))


def test_language_ids_count_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 10)
    used = [r.id for r in spark.range(400).where(langid.crc_fold("id", 3) != 1).collect()]
    rows = [(used[0], f"les mots {k}", "fr") for k in range(20_000)] + [(i, "un mot", "fr") for i in used[1:4]] + [(i, "the plain words", "en") for i in used[4:104]]
    rows += [(used[104 + k], f"wort{chr(97 + k % 26)}{chr(97 + k // 26)}", f"l{k:03d}") for k in range(150)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert model.languages == ["en", "fr", *(f"l{k:03d}" for k in range(150))]
    own = langid.Predictor(model)
    assert own.predict("les mots")[0] == "fr" and own.predict("wortxc")[0] == f"l{23 + 26 * 2:03d}"


def language_brute(rows):
    """(language, score) of each row (id, text, lang), from all documents outside the fold, which are fewer than a sample."""
    import math
    import zlib
    from collections import Counter

    letters = lambda t: re.findall(r"[^\W\d_]+", t.lower())  # noqa: E731  these texts have no other numerals
    learned = [(t, x) for i, t, x in rows if t is not None and x is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    names = sorted({x for _, x in learned})
    words, pieces = ({x: Counter() for x in names} for _ in range(2))
    for t, x in learned:
        words[x].update(letters(t))
    for x in names:
        for w, n in words[x].items():
            marked = f"<{w}>"
            for k in range(1, 6):
                for i in range(len(marked) - k + 1):
                    pieces[x][marked[i : i + k]] += n
    known = []
    for counts, most in ((words, langid.VOCABULARY), (pieces, langid.GRAMS)):
        kept = {s for x in names for s, _ in sorted(counts[x].items(), key=lambda c: (-c[1], c[0]))[:most]}
        totals = {x: sum(counts[x].values()) + 0.1 * len(kept) for x in names}
        known.append((kept, {x: (lambda s, x=x, counts=counts, totals=totals: math.log((counts[x][s] + 0.1) / totals[x])) for x in names}))
    out = []
    for _, t, _ in rows:
        total, n = dict.fromkeys(names, 0.0), 0
        for w in letters(t or ""):
            n += 1
            if w in known[0][0]:
                parts, of = [w], known[0][1]
            else:
                parts, of, marked, at = [], known[1][1], f"<{w}>", 0
                while at < len(marked):
                    k = next((k for k in range(min(5, len(marked) - at), 0, -1) if marked[at : at + k] in known[1][0]), 0)
                    parts += [marked[at : at + k]] if k else []
                    at += k or 1
            for x in names:
                total[x] += sum(of[x](p) for p in parts)
        best = max(names, key=lambda x: (total[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(math.exp((total[x] - total[best]) / n) for x in names)) if n else ("und", 0.0))
    return out


def test_language_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.op7_langid(spark, SF).collect()}
    for (i, _, _), (lang, score) in zip(rows, language_brute(rows)):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9


def net_brute(net, data):
    """The probability of one document by loops over chunks of 512 bytes, every 256, and filters of 12 bytes, every 4."""
    embed, taps = net.w["embed"], net.w["taps"]
    n = max(1, -(-len(data) // 256))
    data = bytes(data) + b"\0" * (n * 256 - len(data))
    hidden = []
    responses = {}
    for at in range(0, len(data) - 8, 4):
        x = np.concatenate([embed[b] for b in data[at : at + 12]])
        responses[at] = sum(x[32 * t : 32 * t + 32] @ taps[:, 32 * t : 32 * t + 32] for t in range(3))
    for start in range(0, len(data), 256):
        inside = [r for at, r in responses.items() if start <= at < start + 512]
        pooled = np.maximum(np.max(inside, axis=0) + net.w["bias"], 0)
        hidden.append(np.maximum(pooled @ net.w["hidden"] + net.w["hidden_bias"], 0))
    z = np.concatenate([np.max(hidden, axis=0), np.mean(hidden, axis=0)]) @ net.w["out"] + net.w["out_bias"][0]
    return 1 / (1 + np.exp(-z))


def test_quality_query_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net = quality.train(docs, labels)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in quality.op1_quality(spark, SF).collect():
        want = net_brute(net, texts[r.doc_id])
        assert abs(r.score - want) < 1e-3 and r.predicted == int(r.score >= 0.3)


def test_bpe_query_equals_library(spark, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2_bpe(spark, SF).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_queries_keep_all_rows(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert bpe.op2_bpe(spark, SF).count() == n
    assert documents(spark, "a").count() == 1
