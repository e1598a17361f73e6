"""Exact and near duplicates, lines, mixing and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.helpers import SF, documents, everything
from orderloom.llm import bpe, exact_dedup, fuse_filter, jaccard, lines, mixing, quality
from orderloom.llm.components import components


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 40000])
def test_fuse_filter(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 1 << 60, n, dtype=np.uint64)
    blob = fuse_filter.build(np.concatenate([keys, keys]))
    assert fuse_filter.probe(blob, keys).all()
    assert fuse_filter.probe(blob, r.integers(0, 1 << 60, 20000, dtype=np.uint64)).mean() < 0.012


def exact_brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    out = []
    stays = set()
    for i, t in rows:
        own = groups[norm(t)]
        best = min(own, key=lambda x: (x[0], x[1], x[2] or 0))
        kept = norm(t) not in stays and i == best[2] and len(t or "") == -best[0]
        stays |= {norm(t)} if kept else set()
        out.append((i, best[2], len(own), kept))
    return sorted(out, key=str)


def test_exact_dedup(spark):
    docs = everything(spark).unionByName(documents(spark, *(["same  text here now ok", "sametextherenowok", "b"] * 30), extra=[(k, f"t{k % 9}", "en", "s") for k in range(100, 160)]))
    for cut in ("doc_id % 2 = 0 or doc_id is null", "true", "false"):
        got = exact_dedup.dedup(docs.where(cut), docs.where(f"not coalesce({cut}, false)")).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got], key=str) == exact_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert exact_dedup.dedup(docs.limit(0), docs.limit(0)).count() == 0


def test_exact_dedup_keeps_one_of_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab"), (None, "c d"), (None, "c d"), (None, "c  e"), (None, "ce"), (3, "c\td")], "doc_id long, text string")
    for cut in ("true", "false", "doc_id = 2 or text = 'c d'", "length(text) > 2"):
        got = exact_dedup.dedup(docs.where(cut), docs.where(f"not coalesce({cut}, false)")).groupBy("text_sha256").agg({"kept": "count", "doc_id": "count"}).collect()
        assert len(got) == 3
        rows = exact_dedup.dedup(docs.where(cut), docs.where(f"not coalesce({cut}, false)")).collect()
        assert sum(r.kept for r in rows) == 3 and sorted(r.group_size for r in rows) == [2, 2, 3, 3, 3, 3, 3, 3]

@pytest.mark.parametrize("limit", [0, 1 << 19])
def test_components(spark, limit):
    r, n = random.Random(2), 300
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long"), limit).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long"), limit).count() == 0


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def near_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    holders, parent = {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, s in sets.items():
        for j, m in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * m >= 80 * (len(s) + len(sets[j]) - m):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_equals_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(r_.doc_id, r_.text) for r_ in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120).collect()]
    passage = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(30):
        words = [r.choice(vocabulary) for _ in range(r.randrange(5, 120))]
        for k in range(r.randrange(1, 6)):
            copy = list(words)
            for _ in range(k):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((10**6 + len(rows), (" ".join(copy)).upper() if k % 2 else "\t".join(copy)))
        rows.append((10**6 + len(rows), " ".join(passage + words[: r.randrange(25)])))
    rows += [(-5, "a b c d"), (-4, "a b c d e"), (-3, None), (-2, ""), (-1, "A b  c D"), (-9, "z " * 60), (-8, "z " * 9), (-7, "q" * 5_000_000 + " " + "r" * 3_000_000)]
    df = spark.createDataFrame([*rows, (None, "a b c d")], "doc_id long, text string").repartition(3)
    got = jaccard.near_duplicates(df).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got if x.doc_id is not None} == near_brute(rows)
    assert [(x.n_shingles, x.component_id) for x in got if x.doc_id is None] == [(1, None)]


def test_jaccard_texts_of_one_id_are_one_node(spark):
    words = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    rows = [(5, words("a", 30)), (5, words("b", 30)), (4, words("b", 31)), (9, words("a", 29)), (9, words("a", 29)), (7, words("c", 40)), (8, words("c", 40)), (6, words("d", 3)), *((5, words(f"x{k}_", 12)) for k in range(50)), (3, words("x7_", 12))]
    got = {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(3, 3), (4, 3), (5, 3), (9, 3), (7, 7), (8, 7), (6, 6)}


def test_jaccard_signatures():
    r = np.random.default_rng(4)
    for n in (1, 40, 3000):
        a, b = r.integers(0, 1 << 60, n, dtype=np.uint64), r.integers(0, 1 << 60, n // 3 + 1, dtype=np.uint64)
        both = np.concatenate([a, b])
        bits = lambda x, y: int(np.bitwise_count((jaccard._signature(x) ^ jaccard._signature(y)).view(np.uint64)).sum())
        assert bits(a, both) <= len(b) and bits(a, a[::-1].copy()) == 0


def test_jaccard_tiles(monkeypatch):
    docs = [np.frombuffer(t.encode(), dtype=np.uint8) for t in ("a b c d e f g h " * 40 + "x", "", " ", "b c d e f", "é " * 300)]
    whole = [s.tolist() for s in jaccard.shingle_sets(docs)]
    monkeypatch.setattr(jaccard, "TILE", 37)
    assert [s.tolist() for s in jaccard.shingle_sets(docs)] == whole


def test_jaccard_odd_rows(spark):
    docs = everything(spark)
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == docs.count() and {r.doc_id: r.component_id for r in got}[8] == 7
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0
    assert jaccard.near_duplicates(docs.union(docs)).count() == 2 * docs.count()
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 8").isEmpty() and kept.where("doc_id is null").count() == 1


def lines_brute(rows):
    """(text, lines, dropped) of rows (host, text): lines on two pages and more than a tenth of the host's go."""
    pages, on = Counter(), Counter()
    for host, text in rows:
        pages[host] += 1
        on.update((host, x) for x in {x.strip(" ") for x in (text or "").split("\n")} - {""})
    out = []
    for host, text in rows:
        every = (text or "").split("\n")
        bad = [x for x in every if x.strip(" ") and on[host, x.strip(" ")] >= 2 and 10 * on[host, x.strip(" ")] > pages[host]]
        out.append((text if not bad else "\n".join(x for x in every if x not in bad), sum(1 for x in every if x.strip(" ")), len(bad)))
    return out


def test_lines(spark):
    pages = [("menu\nhome\nown text %d\n\nfooter" % k, "a" if k % 2 else None) for k in range(40)] + [("menu\nother", "c")] * 3 + [("alone\non its host", "d"), ("menu\nx", "e"), ("menu \ny", "e")]
    pages += [(f"common\n{k}" if k < 2 else f"{k}\n{'x' * 100_000}", "f") for k in range(20)]
    docs = documents(spark, *pages, extra=[(None, None, None, "a")])
    out = lines.drop_boilerplate(docs, "source", "text", counts=("n_lines", "n_dropped")).collect()
    assert sorted((r.text, r.n_lines, r.n_dropped) for r in out if r.text is not None) == sorted(x for x in lines_brute([(r.source, r.text) for r in docs.collect()]) if x[0] is not None)
    assert {r.text for r in out if r.doc_id is not None and r.doc_id < 40} == {f"own text {k}\n" for k in range(40)}
    assert {(r.text, r.n_dropped) for r in out if r.source == "c"} == {("", 2)} and {(r.text, r.n_dropped) for r in out if r.source == "d"} == {("alone\non its host", 0)}
    assert [r.text for r in out if r.doc_id is None] == [None]


def test_lines_odd_rows(spark):
    odd = everything(spark)
    for name in ("row", "host", "lines", "kept", "drop", "key", "n", "_drop", "_all", "_kept", "_lines", "_dropped", "_right_host", "n_dropped"):
        odd = odd.withColumn(name, F.lit(f"own {name}"))
    got = lines.drop_boilerplate(odd, "source", "text")
    assert got.columns == odd.columns and got.drop("text").exceptAll(odd.drop("text")).isEmpty() and got.count() == odd.count()
    assert lines.drop_boilerplate(odd.limit(0), "source", "text").count() == 0
    with pytest.raises(ValueError):
        lines.drop_boilerplate(odd, "source", "text", counts=("n_lines", "N_dropped"))


def test_page_text(spark):
    html = "<html><script>var t='<p>';</script><!-- x --><nav><a href=/>Home</a></nav><P>One &amp; <b>two</b> &lt;3<br>three</p></html>"
    assert spark.range(1).select(lines.page_text(lines.F.lit(html))).first()[0] == "Home\nOne & two <3\nthree"
    assert spark.range(1).select(lines.host_of(lines.F.lit("HTTPS://u@M.Example.com:80/a?b"))).first()[0] == "m.example.com"


def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.copies(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
        assert 0 <= r.copies <= 2
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in rows)) < 1
    assert all(abs(taken[s] - t) <= max(r["size"] for r in rows if r.source == s) for s, t in target.items())
    again = {(r.doc_id, r.copies) for r in mixing.copies(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    assert mixing.mix(docs).groupBy().count().first()[0] == sum(r.copies for r in rows)


def targets_brute(sizes):
    total, out, weights = 1.5 * sum(sizes), [0.0] * len(sizes), [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    full = set()
    while True:
        rest = total - sum(2 * sizes[k] for k in full)
        free = [k for k in range(len(sizes)) if k not in full]
        for k in range(len(sizes)):
            out[k] = 2.0 * sizes[k] if k in full else rest * weights[k] / sum(weights[j] for j in free)
        over = {k for k in free if out[k] > 2 * sizes[k]}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("sizes", [[10], [5, 5, 5], [100, 1, 1], [1, 1, 100], [0, 0], [3, 0, 7, 50, 2], [1000, 900, 800, 1, 2, 3, 4]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(df).orderBy("source").collect()]
    assert np.allclose(got, targets_brute(sizes))


def test_mixing_odd_rows(spark):
    docs = everything(spark)
    rows = mixing.copies(docs).collect()
    assert len(rows) == docs.count() and {r["size"] for r in rows if r.doc_id in (1, 2)} == {0}
    assert mixing.copies(docs.limit(0)).count() == 0
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.where("source is null").count() >= 3


def test_mixing_keeps_rows_whole(spark):
    docs = everything(spark).withColumns({c: F.lit(f"own {c}") for c in ("number", "id", "copies", "tie", "target", "rate", "part")})
    out, placed = mixing.mix(docs), mixing.copies(docs)
    assert out.columns == docs.columns and out.exceptAll(docs.unionByName(docs)).isEmpty()
    assert out.groupBy().count().first()[0] == placed.agg(F.sum("copies")).first()[0]
    same = spark.createDataFrame([(1, "a b c", "en", "s")] * 500 + [(2, "x y", "en", "s")], "doc_id long, text string, lang string, source string")
    assert mixing.mix(same).count() == mixing.copies(same).agg(F.sum("copies")).first()[0] > 501


def test_pipeline_equals_brute_force(spark):
    """run() against a chain of brute-force stages; the classifier's scores are taken as given."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and good.exceptAll(docs).isEmpty()
    assert good.join(labels.where("quality = 1"), "doc_id").count() >= 0.95 * docs.join(labels.where("quality = 1"), "doc_id").count()
    rows = [(r.doc_id, r.text, r.source) for r in good.collect()]
    rows = [(i, t, s) for (i, _, s), (t, _, _) in zip(rows, lines_brute([(s, t) for _, t, s in rows]))]
    near = near_brute([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names, words = sorted({s for _, _, s in rows}), Counter()
    for _, t, s in rows:
        words[s] += size(t)
    want = dict(zip(names, targets_brute([words[s] for s in names])))
    got = corpus_pipeline.run(spark, SF).collect()
    copies, text, source = Counter(r.doc_id for r in got), {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}
    assert copies.keys() <= text.keys() and max(copies.values()) <= 2
    for s in names:
        assert abs(sum(size(text[i]) * n for i, n in copies.items() if source[i] == s) - want[s]) <= max(size(t) for _, t, o in rows if o == s)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    for r in got:
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS, name


def test_pipeline_takes_nothing(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
