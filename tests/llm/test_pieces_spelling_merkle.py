"""Offset-preserving encoding, spelling forms and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairlens.llm import merkle, piece_offsets, queries, spelling

SF = "/root/testdata/sf0.001"
ALPHABET = "ab  eéö▁ \n\t漢字ーﬁ①́À🙂‍\x00\x7fhelo wrtd1290.,<s></s><unk><0x41>"


def random_texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.choice([0, 1, 2, 5, 30, 200]))) for _ in range(n)]


# ------------------------------------------------------------------- pieces
@pytest.fixture(scope="module")
def model():
    return piece_offsets.load_model(piece_offsets.default_model())


def library_spans(model, text):
    import sentencepiece.sentencepiece_pb2 as pb
    got = pb.SentencePieceText()
    got.ParseFromString(model.library.encode(text, out_type="serialized_proto"))
    return [(p.id, p.begin, p.end) for p in got.pieces]


def own_spans(model, texts):
    ids, first, last, count = model.encode([t.encode() for t in texts])
    end = count.cumsum()
    rows = list(zip(ids.tolist(), first.tolist(), last.tolist()))
    return [rows[b - n:b] for b, n in zip(end.tolist(), count.tolist())]


def test_ids_and_spans_are_the_library_s(model):
    texts = random_texts(1, 1500) + ["", " ", "a" * 3000, "ab" * 1000, "漢字" * 500, " " * 500, "▁" * 100,
                                     "x" * 49 + " " + "y" * 49, "\n" * 60, "the  end  "]
    for t, got in zip(texts, own_spans(model, texts)):
        assert got == library_spans(model, t), t[:60]


def test_small_blocks_and_a_full_cache_change_nothing(model, monkeypatch):
    texts = random_texts(2, 200)
    want = own_spans(model, texts)
    monkeypatch.setattr(piece_offsets, "BLOCK_UNITS", 3)
    monkeypatch.setattr(piece_offsets, "CACHE_UNITS", 5)
    assert own_spans(model, texts) == want


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_character_maps_normalise_as_the_library(rule, squeeze):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True,
                                                remove_extra_whitespaces=squeeze)
    spec = pb.ModelProto()
    spec.ParseFromString(lib.serialized_model_proto())
    own = piece_offsets.Normalizer(spec.normalizer_spec)
    for t in [*random_texts(3, 400), "  ", " a ", "ｶﾞ ﷺ ㍿", "À   x　y "]:
        got, origin, ends = own.run([t.encode()])
        text = got.tobytes().decode().replace(" ", "▁")
        want, places = lib.Normalize(t, with_offsets=True)
        assert text == want, t
        # the library's places are characters, one for each normalised character
        chars = [len(t.encode()[:int(o)].decode()) for k, o in enumerate(origin) if got[k] & 0xC0 != 0x80]
        assert chars == list(places[:-1]), t


def test_decoding_gives_the_text_back_and_other_columns_stay(spark, model):
    rows = [(1, "a  bé", "x"), (1, "a  bé", "x"), (None, None, None), (3, "", "y"), (4, "漢字 \U0001f642" * 50, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, begins2 string")
    out = piece_offsets.encode(df, outputs=("ids", "begins", "ends", "n_tokens", "decoded")).collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.begins2) for r in out))) == sorted(map(repr, rows))
    for r in out:
        assert r.decoded == (r.text or "") and r.n_tokens == len(r.ids) == len(r.begins) == len(r.ends)
        raw = (r.text or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends)) == raw
    with pytest.raises(KeyError):
        piece_offsets.encode(df.withColumn("ids", F.lit(1)))
    assert piece_offsets.encode(df.limit(0)).count() == 0


def test_op11_digests(spark, model):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_piece_offsets(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = model.library.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()


# ----------------------------------------------------------------- spelling
def brute_words(rows, noise, min_chars=7, min_count=2):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if noise and i is not None and h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= min_chars:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= min_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_forms(n, ratio=10):
    near = defaultdict(list)
    words = list(n)
    for x, a in enumerate(words):
        for b in words[x + 1:]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def variants(rnd, letters, base, n):
    out = set()
    while len(out) < n:
        w = rnd.choice(base)
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randrange(len(w) + 1)
            c = rnd.choice(letters)
            w = rnd.choice([w[:k] + c + w[k:], w[:k] + w[k + 1:], w[:k] + c + w[k + 1:]])
        if w:
            out.add(w)
    return sorted(out)


@pytest.mark.parametrize("max_list", [2, 20_000])
def test_near_pairs_and_roots(spark, max_list):
    rnd = random.Random(max_list)
    # words that share long stretches, so that lists are dealt anew
    words = variants(rnd, "abé", ["aaaaaaaa", "abababab", "prefixwords", "b", "aé", "éééééééé"], 400)
    n = {w: rnd.choice([2, 3, 20, 25, 300, 300, 5000]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r.word: tuple(r) for r in spelling.spelling_forms(df, max_list=max_list).collect()}
    assert got == brute_forms(n)


def test_words_of_odd_texts(spark):
    long_run = "é" + "Ab" * 60
    rows = [(1, "Wordsmith, WORDSMITH; naïveté×naïveté"), (2, None), (3, ""), (None, "wordsmith wordsmith"), (4, long_run),
            (4, long_run), (5, "x" * 7 + "漢" + "y" * 8), (6, "ÿstartingĀending " * 40), (1, "Wordsmith, WORDSMITH; naïveté×naïveté")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("w"))
    for noise in (None, 2, 3):
        got = {r.word: r.n for r in spelling.count_words(df, noise=noise).collect()}
        assert got == brute_words(rows, noise), noise
    assert spelling.spelling_forms(spelling.count_words(df.limit(0))).count() == 0


def test_op12_matches_brute_force_words(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.word: r.n for r in queries.op12_spelling_forms(spark, SF).collect()}
    assert got == brute_words(docs, 31)


# ------------------------------------------------------------------- merkle
def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    H = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(h):
        paths, at = [[] for _ in h], list(range(len(h)))
        while len(h) > 1:
            for i, k in enumerate(at):
                a = k // 8 * 8
                paths[i].append(("".join(h[a:k]), "".join(h[k + 1:a + 8])))
            at = [k // 8 for k in at]
            h = [H("".join(h[a:a + 8])) for a in range(0, len(h), 8)]
        return (h[0] if h else None), paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, H("".join(map(field, r))), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, ups = tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, ups):
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            path = path + up
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = H("".join(map(field, (*r[:4], text))))
            for before, after in path:
                h = H(before + h + after)
            out.append((r[0], leaf, trees[g][0], root, H("".join(b + a for b, a in path)), h, h == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def run_op13(spark, tmp_dir, rows, parts=3):
    path = f"{tmp_dir}/sf"
    spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(1)).withColumn("at", F.lit(2)).repartition(parts) \
        .write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, path).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 3, "de": 9}, {"en": 700, "": 1, "é": 64, None: 65},
                                   {f"l{i}": 2 for i in range(11)}])
def test_manifest_sizes(spark, tmp_dir, sizes):
    rnd = random.Random(len(sizes))
    ids = iter(rnd.sample(range(10_000), sum(sizes.values())))
    rows = [(next(ids), rnd.choice([None, "s"]), g, rnd.choice([None, 5]), rnd.choice([None, "", "Text É", "low"]))
            for g, n in sizes.items() for _ in range(n)]
    assert run_op13(spark, tmp_dir, rows) == brute_manifest(rows)


def test_manifest_of_odd_rows(spark, tmp_dir):
    rows = [(1, "s", "en", 2, "Aa")] * 3 + [(1, "s", "en", 2, "Bb"), (None, None, None, None, None), (None, "s", "en", 1, "x"),
                                          (2, "s", "en", 3, "Z" * 100_000), (3, "", "", 0, "")]
    assert run_op13(spark, tmp_dir, rows) == brute_manifest(rows)
    assert run_op13(spark, tmp_dir + "/none", []) == []


def test_manifest_blocks_of_one_level(spark):
    """Deep recursion: every level its own table."""
    df = spark.range(600).selectExpr("id AS doc_id", "'en' AS lang", "cast(id AS string) AS text")
    digest = lambda n: sorted((r.id, r.root, r.p) for r in merkle.manifest(df, block_levels=n).select(
        "id", "root", merkle.proof_hash(F.col("path")).alias("p")).collect())
    assert digest(1) == digest(3)
    out = merkle.manifest(df, block_levels=2)
    assert out.filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
