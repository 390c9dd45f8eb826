"""The operators against brute force, round trips and their defined cases."""

import html
import json
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle_harness import compare  # noqa: E402

from pairlens.llm import (chat, decontaminate, jaccard_join, main_text, mixing, quality_rules, sharding,  # noqa: E402
                          token_counts, token_files, weak_quality)
from pairlens.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "one", "a b c", "a b c", "x " * 5000, "<|im_end|> <\\| & é b 🙂"]


def docs(spark, texts, **extra):
    rows = [(i, t, *extra.values()) for i, t in enumerate(texts)]
    kinds = {int: "bigint", str: "string", float: "double"}
    names = ", ".join(f"{k} {kinds[type(v)]}" for k, v in extra.items())
    return spark.createDataFrame(rows, "doc_id bigint, text string" + (", " + names if names else ""))


def near_texts(seed=1, n=60):
    """Texts of near copies around the threshold, copies and unrelated ones."""
    rng, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(500)]
    common = [f"c{i}" for i in range(30)]
    for _ in range(n // 6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 12, 40, 120, 200]))]
        if rng.random() < 0.5:
            base += common
        out.append(base)
        for _ in range(5):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(t)
    return [" ".join(t) for t in out]


def brute_classes(texts, k, p, q):
    sets = []
    for t in texts:
        w = jaccard_join.shingle_set(None if t is None else t.encode(), k)
        sets.append(set(w.tolist()))
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and q * both >= p * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i), links[i]) for i in range(len(sets))}


def test_queries_match_duckdb(spark):
    res = compare(spark, SF, list(Q.oracle_sql()), verbose=False)
    assert not {k: v for k, v in res.items() if v[0] is not True}


def test_jaccard_classes_equal_brute_force_in_small_tiles(spark):
    texts = near_texts() + ODD
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in
           jaccard_join.jaccard_classes(docs(spark, texts, n=1, h1="x", tile=0.5), tile_rows=3).collect()}
    assert got == brute_classes(texts, 4, 85, 100)


def test_every_linked_pair_shares_a_routing_signature():
    levels, rng = jaccard_join.Levels(80, 100), np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, n // 9) + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2 ** 63, drop // 2).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        sa, sb = jaccard_join.signatures(a, levels), jaccard_join.signatures(b, levels)
        by_level = Counter((np.intersect1d(sa, sb) & np.uint64(63)).tolist())
        assert any(c >= levels.agree(level) for level, c in by_level.items())


def test_divide_skip_equals_counting():
    sets = [jaccard_join.shingle_set(t.encode(), 2) for t in near_texts(5, 90)]
    index = jaccard_join.TileIndex(sets, 70, 100)
    for x, s in enumerate(sets):
        want = [y for y in range(x + 1, len(sets)) if 100 * (b := len(np.intersect1d(s, sets[y]))) >=
                70 * (len(s) + len(sets[y]) - b)]
        assert sorted(index.partners(x).tolist()) == want


@pytest.mark.parametrize("limit", [2.0, 1.3])
def test_mixing_repeats_within_the_limit_and_drops_nothing(spark, limit):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 30))), None if s == "z" else s)
            for i, s in enumerate("aaaaaaaaaabbbczz" * 30)] + [(900, None, "a"), (901, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_sources(df, repeat_limit=limit, block_tokens=50).toPandas()
    assert got.groupby("doc_id").size().max() <= 2 and got.doc_id.nunique() == len(rows)
    assert got.duplicated(["doc_id", "mix_epoch"]).sum() == 0
    named = got[got.source.isin(["a", "b", "c"])]
    once = named[named.mix_epoch == 0].groupby("source").mix_tokens.sum()
    epochs = (named.groupby("source").mix_tokens.sum() / once).to_dict()
    assert epochs["a"] == 1.0 and abs(epochs["c"] - limit) < 0.1


def test_mixing_to_an_entropy_is_bisected(spark):
    df = spark.createDataFrame([(i, "x", "ab"[i % 10 == 0]) for i in range(1000)], "doc_id bigint, text string, source string")
    got = mixing.mix_sources(df, repeat_limit=None, entropy=0.6).toPandas().groupby("source").mix_tokens.sum()
    w = (got / got.sum()).to_numpy()
    assert abs(-(w * np.log(w)).sum() - 0.6) < 0.01
    assert mixing.mix_sources(df.limit(0), repeat_limit=2.0).count() == 0


def test_token_files_equal_the_library_and_allow_random_access(spark, tmp_dir):
    from tokenizers import Tokenizer
    texts = ODD + near_texts(7, 30) + ["<|ENDOFTEXT|> don't <|endoftext|>", "É é ΣΑΣ. x"]
    path = f"{tmp_dir}/files"
    token_files.write_token_files(docs(spark, texts, part=1, shard="s"), path, shard_tokens=300, min_count=2)
    tok = Tokenizer.from_file(token_files.default_tokenizer())
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]
    got = {r["doc_id"]: r for r in token_files.read_token_files(spark, path).collect()}
    at = 0
    for i, ids in enumerate(want):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for row in spark.read.parquet(path).collect():
        for j, d in enumerate(row["doc_ids"]):
            assert token_files.read_document(row.asDict(), j).tolist() == want[d].tolist()
    assert any(len(r["rules"]) for r in spark.read.parquet(path).collect())
    empty = f"{tmp_dir}/none"
    token_files.write_token_files(docs(spark, ["a"]).limit(0), empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_ids_of_decomposed_capitals_equal_the_library():
    import unicodedata
    enc = token_files.load_encoder(token_files.default_tokenizer())
    texts = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u0323\u030c", "I\u0307 A\u030a", "Zu\u0308 J\u030cX",
             "FÜR Über ÀÉ", "a\u030c J\u00ad\u030c", "CAPS only", "ΑΣ\u0301 K\u212a"]
    texts += [unicodedata.normalize("NFD", t) for t in texts]
    marks = [chr(c) for c in (*range(0x300, 0x370), 0x1DCA, 0x20D0, 0x3099, 0xFE20)]
    texts += [f"x {a}{m} Z{m}{a}{n}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in marks for n in ("", "\u030c")]
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in enc.encode([t.encode() for t in texts])] == want


def test_token_ids_of_pieces_equal_the_library_and_words_share_them():
    rnd = np.random.default_rng(7)
    enc = token_files.WordCachedEncoder(token_files.default_tokenizer())
    parts = ["a", "B", "z", "é", "É", "ñ", "\u00d7", "\u00f7", "'", "'s", "don't", "!", ",", ".", "|", "<", "|>", "<|endoftext|>", "7", "12",
             "\u0301", "\u0338", "=", "\u0130", "\u2026", "\u00aa", "\u0085", "\x00", "\x1c", "</w>", " ", "\n", "word"]
    texts = ["".join(parts[i] for i in rnd.integers(0, len(parts), n)) for n in rnd.integers(0, 30, 4000)]
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in enc.encode([t.encode() for t in texts])] == want
    enc._forget()
    texts = ["house house, (house) HOUSE! \"maison, maison.\" été, été."]
    assert enc.encode([t.encode() for t in texts])[0].tolist() == enc.tok.encode(texts[0], add_special_tokens=False).ids
    assert {b"house", b"maison", "été".encode()} <= set(enc.number) and not any(b"house" in w and w != b"house" for w in enc.number)


def test_pieces_whose_marks_do_not_agree_are_parted_by_a_special_token():
    enc = token_files.WordCachedEncoder(token_files.default_tokenizer())
    enc.ends[:] = False         # as with a model that marks no end
    text = "some words, and more (words)"
    assert enc.encode([text.encode()])[0].tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(2)
    end = np.array([token_files.BARRIER], np.uint32)
    one = rng.integers(0, 900, 400).astype(np.uint32)
    copies = np.concatenate([one, end] * 1000)
    words = np.concatenate([np.minimum(rng.zipf(1.3, 60000), 900).astype(np.uint32), end])
    same = np.concatenate([np.full(3000, 7, np.uint32), end])
    for ids in (copies, words, same, np.concatenate([words, copies, same, words]), one[:1], end):
        for least in (2, 8):
            rules, seq = token_files.repair(ids, 1000, min_count=least)
            pairs = Counter((a, b) for a, b in zip(seq[:-1].tolist(), seq[1:].tolist()) if token_files.BARRIER not in (a, b))
            assert max(pairs.values(), default=0) < least
            back = np.split(seq, np.flatnonzero(seq == token_files.BARRIER))
            table = token_files.expansions(rules, 1000)
            got = [token_files.expand(x[x != token_files.BARRIER].astype(np.int64), table) for x in back]
            want = [x[x != token_files.BARRIER] for x in np.split(ids, np.flatnonzero(ids == token_files.BARRIER))]
            assert len(got) == len(want) and all(map(np.array_equal, got, want))
    assert len(token_files.repair(copies, 1000)[1]) == 2 * 1000       # a symbol and the end of each copy


def test_weak_quality_agrees_with_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = weak_quality.fit_quality(table)
    got = {r["doc_id"]: r["kept"] for r in weak_quality.score(table, model).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert np.mean([got[r["doc_id"]] == (r["quality"] == 1) for r in labels]) > 0.97
    odd = {r["doc_id"]: r["score"] for r in weak_quality.score(docs(spark, ODD, score=1, kept="k"), model).collect()}
    assert [odd[i] for i in range(3)] == [0.0] * 3 and odd[4] == odd[5] and len(odd) == len(ODD)
    kept = weak_quality.keep_good(docs(spark, ODD, score=1), model)
    assert kept.columns == ["doc_id", "text", "score"] and weak_quality.fit_quality(kept.limit(0)).scorer.bias == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.8
    acc = np.array([0.95, 0.9, 0.8, 0.7])
    v = np.where(rng.random((20000, 4)) < acc, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    v[rng.random(v.shape) < 0.3] = 0
    pats, n = np.unique(v, axis=0, return_counts=True)
    model = weak_quality.fit_label_model(pats, n.astype(float))
    assert np.abs(model.accuracies() - acc).max() < 0.05 and abs(model.prior - 0.8) < 0.05


def test_main_text_equals_the_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in Q.op5_main_text(spark, SF).collect()}
    for p in pages:
        body = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"]) == (want, len(want))


def test_main_text_leaves_boilerplate_and_survives_odd_markup(spark):
    model = main_text.fit_pages(spark.read.parquet(f"{SF}/pages.parquet"))
    para = "The first of many words, here. " * 6
    page = (f'<body class="post"><div id="cookie-notice">We use cookies</div><main><h1>T&amp;t</h1><p>{para}<br>'
            f'<p>a&nbsp; <i>b</i>c</p><aside>See also</aside><form>Mail <input></form><script>x("</p>")</script></main>'
            f'<section class="comments"><p>{para}</p></section></body>')
    assert main_text.extract(page, model) == f"T&t {para.strip()} a bc"
    for t in (None, "", "plain words", "<", "<p", "</p></div>", "<div" * 50, "<!-- x", "<script>a"):
        assert main_text.extract(t, model) == ""
    nodes = main_text.parse("<ul><li>a<li>b</ul><p>c<div>d</div><table><tr><td>e<td>f</table>")
    assert [n.parent for n in nodes if n.tag in ("li", "td", "div")] == [1, 1, 0, 7, 7]


def test_main_text_keeps_text_by_foreign_elements_and_of_fragments(spark):
    model = main_text.fit_pages(spark.read.parquet(f"{SF}/pages.parquet"))
    para = ("The first of many words, here. " * 6).strip()
    page = f"<body><nav><a href='/a'>a</a></nav><article><p>{para}</p>%s<p>{para}</p></article><footer>f</footer></body>"
    for extra, want in (("<svg/>", ""), ('<svg width="1" />', ""), ("<math/>", ""), ("<svg>", ""), ("<svg><path d='M0 0'/><g/></svg>", ""),
                        ("<svg><title/><style/><metadata>m</metadata></svg>", ""), ("<noscript><img src='x'></noscript>", ""),
                        ("<noscript>", ""), ("<svg><desc>", ""), ("<object data=x />", ""), ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn>"
                        "<annotation encoding='application/x-tex'>x=1</annotation></math> here</p>", "so x=1 here")):
        assert main_text.extract(page % extra, model) == " ".join([para, want, para] if want else [para, para]), extra
    nodes = main_text.parse("<svg><a/><foreignObject><div/>x</foreignObject></svg><p/>y")
    assert [(n.tag, n.parent) for n in nodes[1:]] == [("svg", 0), ("a", 1), ("foreignobject", 1), ("div", 3), ("p", 0)]
    assert main_text.extract("Hello <b>x</b>", model) == "Hello x"
    assert main_text.extract(f"{para} <i>so</i><nav>menu</nav><br>{para}", model) == f"{para} so {para}"
    assert main_text.extract(f"{para}<p>{para}</p>{para}", model) == f"{para} {para} {para}"
    assert main_text.extract(f"<html><body><article><p>{para}</p></article></body></html> stray", model) == para


def test_attribute_values_are_no_attributes(spark):
    ev = lambda attrs: main_text.evidence(main_text.parse(f"<div {attrs}>")[1])
    for attrs in ('style="overflow:hidden"', 'aria-hidden="false"', 'title="a hidden lake"', "data-x='id=ad'", "title=hidden",
                  'data-class="ad"', 'title="class=article"', 'style = "overflow: hidden" lang=en', "data-hidden"):
        assert ev(attrs) == (0, 0), attrs
    for attrs in ("hidden", 'hidden=""', "HIDDEN='until-found'", 'aria-hidden="true"', 'style="x"hidden', 'class = "x ad"',
                  "role=navigation", "id=ad/", 'title="a > b" hidden'):
        assert ev(attrs) == (0, 1), attrs
    assert ev('itemprop="articleBody" CLASS=post') == (2, 0)
    # the model is fitted to pages whose article lies in such a div, and reads them
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    body = lambda t: re.search(r"<article>(.*?)(</article>|$)", t, re.S).group(1)
    text = lambda t: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body(t)))).split())
    rows = [(p["page_id"], p["html"].replace("<article>", '<div style="overflow:hidden"><article>').replace("</article>", "</article></div>"))
            for p in pages]
    model = main_text.fit_pages(spark.createDataFrame(rows, "page_id bigint, html string"))
    assert [main_text.extract(t, model) for _, t in rows] == [text(p["html"]) for p in pages]


def test_section_tokens_equal_brute_force(spark):
    texts = ODD + ["a\n\n\nb.\n\nc", "\n\n", "é\n🙂\n", "x\r\n  y\n"]
    encode, size = token_counts.load_encoder(token_counts.default_vocabulary())
    got = token_counts.section_tokens(docs(spark, texts, section=1, n_tokens="x")).toPandas()
    for i, t in enumerate(texts):
        data = (t or "").encode()
        lines = re.findall(rb"[^\n]*\n|[^\n]+\Z", data) or [b""]
        owner = [k for k, line in enumerate(lines) for _ in line]
        want, at = Counter(), 0
        for tok in encode(t or ""):
            share = Counter(owner[at:at + size[tok]])
            want[min(k for k in share if share[k] == max(share.values()))] += 1
            at += size[tok]
        rows = got[got.doc_id == i].sort_values("section")
        assert rows.n_tokens.tolist() == [want[k] for k in range(len(lines))]
        assert (rows.end_char - rows.start_char).tolist() == [sum(b & 0xC0 != 0x80 for b in line) for line in lines]


def test_sharding_is_exact_and_uniform(spark):
    texts = ODD * 6 + ["same"] * 40
    got = sharding.shuffle_shards(docs(spark, texts, shard=1, slot="s"), shards=8, rows_per_part=10).toPandas()
    assert sorted(got.doc_id) == list(range(len(texts)))
    n = got.groupby("shard").slot
    assert n.count().max() - n.count().min() <= 1 and (n.max() + 1 == n.count()).all() and (n.nunique() == n.count()).all()
    for r in got.itertuples():
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
    assert sharding.shuffle_shards(docs(spark, ["a"]).limit(0)).count() == 0


def test_communication_matrix_has_the_hypergeometric_law():
    counts, sizes = [7, 0, 5, 8], [10, 6, 4]
    first = []
    for seed in range(3000):
        m = np.array(sharding.communication_matrix(counts, sizes, seed))
        assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes and (m >= 0).all()
        first.append(m[0, 0])
    assert abs(np.mean(first) - 3.5) < 0.08 and abs(np.var(first) - 7 * .5 * .5 * 13 / 19) < 0.12
    import random as r
    big = [sharding.draw_hypergeometric(r.Random(s), 10 ** 11, 3 * 10 ** 11, 10 ** 8) for s in range(200)]
    assert abs(np.mean(big) / 2.5e7 - 1) < 1e-3


def test_decontamination_both_ways_equals_brute_force(spark):
    rng = random.Random(4)
    items = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n)) for n in (4, 5, 9, 30, 60, 30)]
    items += [items[3], None, ""]
    texts = ODD + ["pad " * 300 + items[3].upper() + " pad", items[4] + " x", items[2][:-3] + " zz", " ".join(items[4].split()[:50])]
    table = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")

    def sets(t):
        return set(decontaminate.shingle_set((t or "").encode(), 5, whole_if_short=False).tolist())
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items)
            if sets(x) and len(sets(x) & sets(t)) >= 0.8 * len(sets(x)) - 1e-9}
    assert want
    for limit in (10 ** 6, 0):
        got = decontaminate.find_items(docs(spark, texts, n_item=1), table, broadcast_shingles=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
        kept = decontaminate.drop_contaminated(docs(spark, texts, n_item=1), table, broadcast_shingles=limit)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})


def test_reply_trees_choose_the_best_branch_and_round_trip(spark):
    bad = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| \\ <"
    rows = [("t", 1, None, "system", "s", 0.0), ("t", 2, 1, "user\nx", bad, 1.0), ("t", 3, 2, "assistant", bad, 2.0),
            ("t", 4, 2, "assistant", None, 5.0), ("t", 5, 4, None, "", 0.0), ("t", 5, 4, None, "", 0.0),
            (None, 1, 99, "assistant", "orphan", 0.0), ("c", 1, 2, "user", "cycle", 0.0), ("c", 2, 1, "user", "cycle", 0.0)]
    rows += [("deep", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(37)]
    df = spark.createDataFrame(rows, "tree string, msg bigint, parent bigint, role string, text string, score double")
    out = chat.format_branches(chat.branches(df, per_tree=None))
    got = {(r["tree"], r["leaf"]): r for r in out.select(
        "tree", "leaf", "rank", chat.parse_turns(out["formatted"]).alias("turns"),
        chat.loss_texts(out["formatted"], out["loss_spans"]).alias("loss")).collect()}
    turns = {k: [tuple(t) for t in r["turns"]] for k, r in got.items()}
    head = [("system", "s"), ("user\nx", bad)]
    assert turns[("t", 3)] == head + [("assistant", bad)] and turns[("t", 5)] == head + [("assistant", ""), ("", "")]
    assert got[("t", 5)]["rank"] == 1 and got[("t", 3)]["rank"] == 2 and got[("t", 3)]["loss"] == [bad]
    assert turns[(None, 1)] == [("assistant", "orphan")] and [t[1] for t in turns[("deep", 36)]] == [str(i) for i in range(37)]
    assert set(turns) == {("t", 3), ("t", 5), (None, 1), ("deep", 36)}


def test_ledger_policies_and_ablation(spark):
    texts = ODD + ["word " * 60, " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}###" for i in range(80))]
    led = quality_rules.ledger(docs(spark, texts, failed=1, n_words="x")).cache()
    rows = {r["doc_id"]: r for r in led.collect()}
    masks = [rows[i]["failed"] for i in range(len(texts))]
    assert masks[0] == masks[1] == masks[2] and masks[4] == masks[5] and masks[9] == 0 and masks[10] & 4
    got = {r["rule"]: r for r in quality_rules.ablation(led, quality_rules.WEB).collect()}
    for rule in quality_rules.RULES:
        bit = 1 << rule.bit
        assert got[rule.name]["n_failed"] == sum(m & bit != 0 for m in masks)
        assert got[rule.name]["n_only"] == sum(m == bit for m in masks)
        assert got[rule.name]["n_kept_without"] == sum(m & ~bit == 0 for m in masks)
    total = quality_rules.profile(led).collect()[0]
    assert total["any_failed"] == int(np.bitwise_or.reduce(masks)) and total["n_failures"] == sum(bin(m).count("1") for m in masks)
    assert json.dumps(quality_rules.WEB.version) == "1"


def test_a_tokenizer_that_keeps_white_space_encodes_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, lib = token_files.WordCachedEncoder(path), Tokenizer.from_file(path)
    assert not enc.by_word and token_files.load_encoder(token_files.default_tokenizer()).by_word
    texts = ["Two  words\n", "", " A b", "naïve"]
    assert [g.tolist() for g in enc.encode([t.encode() for t in texts])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_rules_are_written_out_level_by_level():
    rules = np.array([(3, 4), (10, 5), (11, 11), (12, 10), (12, 13)], np.uint32)
    flat, offset, length = token_files.expansions(rules, 10)
    got = [flat[offset[s]:offset[s] + length[s]].tolist() for s in range(15)]
    want = [[i] for i in range(10)]
    for a, b in rules.tolist():
        want.append(want[a] + want[b])
    assert got == want
    assert token_files.rule_lengths(rules, 10)[0].tolist() == [len(w) for w in want[10:]]


def test_main_text_of_wrapped_and_broken_pages(spark):
    import time
    model = main_text.fit_pages(spark.read.parquet(f"{SF}/pages.parquet"))
    para = ("The first of many words, here. " * 6).strip()
    page = "<html><body>%s<nav><ul><li><a href='/a'>Home</a></ul></nav>%s<footer>f, all rights</footer>%s</body></html>"
    article = f"<article%s><h1>T</h1><p>{para}</p><p>{para}</p></article>"
    want = f"T {para} {para}"
    # wrappers and class names that only look like boilerplate
    for before, cls, after in (('<form id="aspnetForm" action="x">', "", "</form>"), ('<div class="post no-sidebar">', "", "</div>"),
                               ("", ' class="post tag-tags category-social"', ""), ('<div class="has-sidebar with-comments">', "", "</div>"),
                               ('<section class="sidebar-right widget">', "", "</section>")):
        assert main_text.extract(page % (before, article % cls, after), model) == want, before + cls
    # comments and related articles beside the article stay out
    for extra in (f'<section class="comments"><article class="comment"><p>{para}</p></article></section>',
                  f'<aside class="related"><article><h3>More</h3><p>{para}</p></article></aside>',
                  "<noscript>Please enable scripts to read this page.</noscript>"):
        assert main_text.extract(page % ("", article % "" + extra, ""), model) == want, extra
    # quotes that open nothing, and quotes that are not closed: no markup in the text
    got = main_text.extract(f"<body><article><p title=don't>{para}</p><p data-x=a'b\"c>{para}</p></article></body>", model)
    assert got == f"{para} {para}"
    got = main_text.extract(f'<body><article><p>{para}</p><p class="x>lost</p></article><div title="y">{para}</div></body>', model)
    assert "class" not in got and "<" not in got and got.startswith(para)
    assert [n.tag for n in main_text.parse('<a b="c>d" e=\'f>\' g=h>i<b/>j<!-->k<!-- l -->m</>n</ o>p<!p q>')] == ["#root", "a", "b"]
    # broken tags take time in proportion to the page
    for broken in ('<a "', "<a '=\"", "<", "</x>", "<b>", "<p></p>", "<!--", "<svg><desc>", "<a b='"):
        t = time.time()
        main_text.parse("<b>" * 2000 + broken * (2_000_000 // len(broken)))
        assert time.time() - t < 20, broken
    # the sample reaches the end of a long page: footers are learnt, though they come behind many nodes
    rows = spark.createDataFrame([(i, f"<body><article>{f'<p>{para}</p>' * (60 + i)}</article><footer><p>y {i}</p><p>{para}</p></footer></body>")
                                  for i in range(40)], "page_id bigint, html string")
    model = main_text.fit_pages(rows, train_nodes=20)
    assert main_text.extract(f"<body>{article % ''}<footer><p>y</p><p>{para}</p></footer></body>", model) == want


def test_short_items_are_found_as_whole_word_runs(spark, tmp_dir):
    """Against plain word lists, and against the query's SQL."""
    import duckdb
    rng = random.Random(11)
    word = lambda: rng.choice("abcd") + str(rng.randrange(4))
    texts = ODD + [" ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 30]))) for _ in range(80)]
    items = ["One", "a b c", "zz top", "A1 b2", "c3 d0 a1", "x", " ", None, "a0 a1 a2 a3", "b1 b1", "never said words here"]
    items += [" ".join(texts[-1].split()[:3]), " ".join(texts[-2].split()[:8])]
    lower = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]

    def holds(t, x):
        t, x = lower(t), lower(x)
        if 0 < len(x) < 5:
            return any(t[i:i + len(x)] == x for i in range(len(t)))
        five = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        return bool(x) and len(five(x) & five(t)) >= 0.8 * len(five(x)) - 1e-9
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if holds(t, x)}
    assert {0, 1, 3, 5, 11} <= {i for _, i in want}
    table = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    df = docs(spark, texts, _key="kept", key=7, row="r")
    for limit in (10 ** 6, 0):
        got = decontaminate.find_items(df, table, broadcast_shingles=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
        kept = decontaminate.drop_contaminated(df, table, broadcast_shingles=limit).collect()
        clean = set(range(len(texts))) - {d for d, _ in want}
        assert {r["doc_id"] for r in kept} == clean and all((r["_key"], r["key"], r["row"]) == ("kept", 7, "r") for r in kept)
    df.write.parquet(f"{tmp_dir}/documents.parquet")
    table.write.parquet(f"{tmp_dir}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_dir}/{name}.parquet/*.parquet'")
    assert {r[:2] for r in con.sql(Q.op8_sql()).fetchall()} == want
    assert {(r["doc_id"], r["item_id"]) for r in Q.op8_decontaminate(spark, tmp_dir).collect()} == want
