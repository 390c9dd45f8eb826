"""The corpus pipeline against a brute-force version on small tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from pairlens.llm import decontaminate, jaccard_join, token_files, weak_quality

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text, k, short):
    return set(jaccard_join.shingle_set((text or "").encode(), k, whole_if_short=short).tolist())


def write(spark, folder, docs, items, extra=""):
    spark.createDataFrame(docs, SCHEMA + extra).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def planted(spark):
    """The smallest test tables and planted copies, near copies and benchmark passages, in four sources."""
    rng = random.Random(6)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(i, t, la, "abbcccc"[i % 7], n) for i, t, la, _, n in docs]
    good = [d for d in docs if d[1] and 80 < len(d[1].split()) < 800]
    next_id = max(d[0] for d in docs) + 1
    for d in rng.sample(good, 12):
        words = d[1].split()
        words[len(words) // 2] = "changed"
        docs.append((next_id, d[1], d[2], "d", d[4]))
        docs.append((next_id + 1, " ".join(words), d[2], None, d[4]))
        docs.append((next_id + 2, d[1] + " " + items[next_id % len(items)][1], d[2], "d", d[4]))
        next_id += 3
    docs += [(next_id, None, None, "a", None), (next_id + 1, "", "en", None, 0)]
    return docs, items


def brute_kept(docs, items, scorer):
    """Ids left by the three filters, each on what the one before kept."""
    kept = [d for d in docs if scorer.score(d[1].encode() if d[1] is not None else None) >= 0.5]
    sets = [shingles(d[1], 5, True) for d in kept]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for h in s:
            at[h].append(i)
    root = list(range(len(kept)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, s in enumerate(sets):
        for j, both in Counter(j for h in s for j in at[h] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                first, second = sorted((a, b), key=lambda x: kept[x][0])
                root[second] = first
    kept = [d for i, d in enumerate(kept) if find(i) == i]
    wanted = [w for w in (shingles(t, 5, False) for _, t in items) if w]
    return [d for d in kept if not any(len(w & s) >= 0.8 * len(w) - 1e-9
                                       for s in [shingles(d[1], 5, False)] for w in wanted)]


def test_pipeline_equals_brute_force(spark, tmp_dir):
    from tokenizers import Tokenizer
    docs, items = planted(spark)
    write(spark, tmp_dir, docs, items)
    got = corpus_pipeline.run(spark, tmp_dir).orderBy("start").collect()
    model = weak_quality.fit_quality(spark.read.parquet(f"{tmp_dir}/documents.parquet"))
    kept = brute_kept(docs, items, model.scorer)
    assert 0 < len(kept) < len(docs) - 12
    assert {r["doc_id"] for r in got} == {d[0] for d in kept}
    # token files: ascending ids, offsets and checksums of the library's ids
    tok, at = Tokenizer.from_file(token_files.default_tokenizer()), 0
    ids = {d[0]: np.array(tok.encode(d[1] or "", add_special_tokens=False).ids + [1], "<u4") for d in kept}
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    for r in got:
        mine = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(mine), zlib.crc32(mine.tobytes()))
        at += len(mine)
    # the mixture: every source within a document of its epochs, none more than twice as often as another
    times = Counter(r["doc_id"] for r in got)
    assert max(times.values()) <= 2
    words = {d[0]: len((d[1] or "").split()) for d in kept}
    total, largest, mixed = Counter(), Counter(), Counter()
    for d in kept:
        total[d[3]] += words[d[0]]
        largest[d[3]] = max(largest[d[3]], words[d[0]])
        mixed[d[3]] += words[d[0]] * times[d[0]]
    top, low = max(total.values()), min(total.values())
    a = max(0.0, 1 - np.log(2) / np.log(top / low))
    for s, n in total.items():
        epochs = (n / top) ** (a - 1)
        assert mixed[s] <= epochs * n + 1 and mixed[s] > epochs * n - largest[s] - 1


def test_every_stage_keeps_the_columns_and_survives_odd_tables(spark, tmp_dir):
    """Clashing names, repeated rows, null ids and empty tables."""
    names = ", score double, kept string, sigs string, block string, mix_key string, n_item bigint"
    extra = (0.5, "k", "s", "b", "m", 1)
    text = "the first of many plain words, written for a test of the stages. " * 3
    rows = [(i, t, "en", s, 1, *extra) for i, t, s in
            [(1, text, "a"), (1, text, "a"), (2, text, None), (None, text, "a"), (3, None, "a"), (4, "", None), (5, "x", "b")]]
    for n, docs in enumerate((rows, [])):
        folder = f"{tmp_dir}/{n}"
        write(spark, folder, docs, [(0, None), (1, "")], names)
        df = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, folder)
            assert out.columns == df.columns, name
            assert out.count() <= 2 * len(docs)
        assert corpus_pipeline.run(spark, folder).count() >= (1 if docs else 0)


def test_each_filter_takes_effect_alone(spark, tmp_dir):
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(0, text, "en", "a", 1), (1, text + " end", "en", "a", 1), (2, "other " * 9, "en", "b", 1)]
    write(spark, tmp_dir, docs, [(0, " ".join(f"w{i}" for i in range(20)))])
    df = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    assert sorted(r[0] for r in corpus_pipeline.near_duplicates(spark, df, tmp_dir).select("doc_id").collect()) == [0, 2]
    assert [r[0] for r in corpus_pipeline.decontamination(spark, df, tmp_dir).select("doc_id").collect()] == [2]
    index = decontaminate.find_items(df, spark.read.parquet(f"{tmp_dir}/benchmark.parquet")).collect()
    assert sorted(r["doc_id"] for r in index) == [0, 1] and all(r["n_found"] == r["n_item"] == 16 for r in index)
