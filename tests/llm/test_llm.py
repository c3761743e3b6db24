"""Operators against brute force, the libraries, and odd inputs: nulls, empty tables, repeated rows, clashing columns."""

import collections
import random
import re

import numpy as np
import public_tokenizers as P
import pytest

from loomstore.llm import bpe, byte_cnn, hnsw, jaccard_join, packing, segment_topk, sp_lattice, substring_dedup, token_counts, token_files, url_trust
from loomstore.llm.shared import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, LOWER = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def texts(n=60, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(n)]
    out = base + [t + " tail" for t in base[:10]] + base[:10] + [None, "", " \n\t", "one two", "é ü " * 40]
    common = " ".join(f"c{i}" for i in range(20))
    return [f"{t or ''} {common}" if i % 7 == 3 and t is not None else t for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 3, t, i, "x") for i, t in enumerate(texts())], "doc_id long, text string, n_words long, lang string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("path", [BYTE, LOWER])
def test_bpe_is_the_library(path):
    from tokenizers import Tokenizer

    t, b, rng = Tokenizer.from_file(path), bpe.BatchEncoder(path), random.Random(2)
    parts = ["a", "B", "'s", "'re", "'v", "'ll", "'", " ", "  ", "\n", "\t", "1", "22", ".", "!!", "é", "the", "<|endoftext|>", "漢", "e", "l", " ", "\r\n", "İ", "don't", "\x1c"]
    got = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)]
    want = [e.ids for e in t.encode_batch(got, add_special_tokens=False)]
    assert [x.tolist() for x in b.encode(got)] == want
    if path == BYTE:
        for x, c in zip(got[:300], b.count_prefixes(got[:300])):
            assert c.tolist() == [len(t.encode(x[:i], add_special_tokens=False).ids) for i in range(len(x) + 1)]
            blob = token_counts.pack_counts(c)
            assert all(token_counts.tokens_at(blob, len(x), i) == c[i] for i in range(len(x) + 1))
            assert token_counts.longest_within(blob, len(x), 3) == max(i for i in range(len(x) + 1) if c[i] <= 3)


def test_packing_covers_all(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    rows = packing.pack(docs, BYTE).toPandas()
    ids = {r["doc_id"]: np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4") for r in docs.collect()}
    assert rows.length.sum() == sum(map(len, ids.values()))
    for r in rows.itertuples():
        assert bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids[r.doc_id])
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.cumsum(s.length) - s.length).all() and s.length.sum() <= 1024
    assert packing.pack(none, BYTE).count() == 0


def test_packer_pads_little():
    rng, p = np.random.default_rng(0), packing.Packer()
    made = [w for n in rng.integers(1, 5000, 800) for w in p.add(0, np.zeros(n, np.int32))] + list(p.drain())
    sizes = np.array([sum(len(x[2]) for x in w) for w in made])
    assert sizes.max() <= 1024 and ((sizes & (sizes - 1)) != 0).sum() <= 1


def test_token_files_roundtrip(spark, docs, none):
    from tokenizers import Tokenizer

    t, path = Tokenizer.from_file(LOWER), scratch(spark, "t")
    token_files.write(docs, path, LOWER, partitions=3)
    got = token_files.read(spark, path).orderBy("doc_id").collect()
    run = 0
    for r, d in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        want = np.array(t.encode(d["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (d["doc_id"], run, len(want), want.tobytes())
        run += len(want)
    assert token_files.fetch(spark, path, 9)[0].tobytes() == bytes(got[3]["ids"])
    token_files.write(none, path := scratch(spark, "t"), LOWER)
    assert token_files.read(spark, path).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 8)).astype(np.float32)
    x[100:250] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [float("inf")] + [0.0] * 7), (5, [float(v) for v in x[5]])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), x


def test_hnsw_recall(vectors):
    df, x = vectors
    got = hnsw.search(df, k=5, every=20, shard=128).toPandas()
    hit = total = 0
    for q, rows in got.groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        order = np.lexsort((np.arange(len(s)), -s))[:5]
        hit, total = hit + len(set(order) & set(rows.vec_id)), total + 5
        assert np.allclose(rows.score, s[rows.vec_id]) and q not in set(rows.vec_id) and rows["rank"].tolist() == [1, 2, 3, 4, 5]
    assert total == 35 * 5 and hit / total >= 0.9


def test_a_shard_is_sent_once_for_many_blocks_of_queries(spark):
    import pyarrow as pa

    from loomstore.llm import vectors as V

    q = spark.createDataFrame([(i, bytearray(b"q"), bytearray(b"d")) for i in range(40)], V.PACKED_SCHEMA)
    index = spark.createDataFrame([(s, c) for s in range(2) for c in range(3)], "block int, cut int")

    def run(asked, shard):
        return pa.table({"queries": pa.array([len(asked)], pa.int64()), "shards": pa.array([len(set(shard["shard"].to_pylist()))], pa.int64()), "cuts": pa.array([len(shard)], pa.int64())})

    got = V.meet(q, index, 40, 2, 16, run, "queries long, shards long, cuts long").collect()
    assert sorted(map(tuple, got)) == [(8, 1, 3)] * 2 + [(16, 1, 3)] * 4
    x = np.random.default_rng(2).standard_normal((5000, 8)).astype("<f4")
    g = hnsw.Graph(np.arange(5000), x)
    again = hnsw.Graph.whole(g.x, g.levels[0][1], g.upper())
    assert len(g.levels) > 1 and np.array_equal(g.search(x[:50], 5), again.search(x[:50], 5))


def test_segment_topk_is_exact(spark, vectors):
    df, x = vectors
    f = np.floor(1024 * x.astype(float)).astype(np.int64)
    ids = np.append(np.arange(700), 901)
    f = np.concatenate([f, np.zeros((1, 8), np.int64)])
    got = segment_topk.search(df, k=4, every=100, block=64).toPandas()
    for q, rows in got.groupby("query_id"):
        s = f @ f[ids.tolist().index(q)]
        s[ids.tolist().index(q)] = -(2**62)
        order = np.lexsort((ids, -s))[:4]
        assert rows.sort_values("rank").vec_id.tolist() == ids[order].tolist() and rows.sort_values("rank").score.tolist() == s[order].tolist()
    assert segment_topk.search(df.limit(0)).count() == 0 and hnsw.search(df.limit(0)).count() == 0


def test_url_trust(spark):
    link = lambda *h: "".join(f'<a href="http://{x}/">x</a>' for x in h)
    rows = [(1, "http://good.com/a", link("friend.org", "good.com")), (2, "https://Friend.org/x?y#z", link("far.org")), (3, "http://a.net/es/1", ""), (4, "http://sly.org/", link("a.net", "a.net", "far.org")), (5, "nourl", None), (6, None, ""), (7, "http://www.example.com/en/1", ""), (8, "http://example.com/en/1", ""), (9, "http://b.example.com/en", ""), (10, "http://far.org", None)]
    rules = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"))
    got = {r["page_id"]: r for r in url_trust.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert [got[i]["rule"] for i in range(1, 11)] == ["com/", None, "net/es/", None, None, None, "www.example.com/en/", "example.com/en/", "com/", None]
    assert [got[i]["verdict"] for i in range(1, 11)] == ["allow", "allow", "block", "block", "allow", "allow", "allow", "block", "allow", "allow"]
    assert (got[2]["host"], got[2]["path"], got[10]["path"], got[5]["host"]) == ("friend.org", "/x", "", "")

    def walk(edges, seeds, rounds=8, damping=0.85):
        out, rank = collections.Counter(), dict(seeds)
        for (a, _), n in edges.items():
            out[a] += n
        for _ in range(rounds):
            new = {h: v * (1 - damping) for h, v in seeds.items()}
            for (a, b), n in edges.items():
                if a in rank:
                    new[b] = new.get(b, 0) + damping * rank[a] * n / out[a]
            rank = new
        return rank

    edges = {("good.com", "friend.org"): 1, ("friend.org", "far.org"): 1, ("sly.org", "a.net"): 2, ("sly.org", "far.org"): 1}
    trust = walk(edges, {h: 1 / 3 for h in ("good.com", "www.example.com", "b.example.com")})
    bad = walk({(b, a): n for (a, b), n in edges.items()}, {h: 1 / 2 for h in ("a.net", "example.com")})
    for r in got.values():
        assert abs(r["trust"] - trust.get(r["host"], 0)) < 1e-9 and abs(r["distrust"] - bad.get(r["host"], 0)) < 1e-9


def test_url_trust_does_not_depend_on_size(spark):
    link = lambda *h: "".join(f'<a href="{x}">x</a>' for x in h)
    chain = [(f"http://c{i}.org/", link(f"//c{i - 1}.org/p?u=http://other.net/")) for i in range(1, 13)]  # c12 is twelve hops from a blocked host
    small = [("http://c0.org/bad/", ""), *chain]
    many = small + [(f"http://b{i}.org/bad/", "") for i in range(2000)] + [(f"http://f{i}.org/", link("http://c0.org/")) for i in range(500)]
    rules = (("block", "org", "/bad/"),)
    for rows in (small, many):
        pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
        got = {r["host"]: r for r in url_trust.judge(pages, rules).collect()}
        assert [got[f"c{i}.org"]["verdict"] for i in range(13)] == ["block"] * 13
        seeds = sum("/bad/" in u for u, _ in rows)
        share = 1 / 501 if rows is many else 1  # of c0's distrust, which goes to all that link to it
        assert abs(got["c12.org"]["distrust"] / (0.15 / seeds * share * 0.85**12) - 1) < 1e-5
    wheel = spark.createDataFrame([(0, "http://a.org/ok/", link("http://b.org/")), (1, "http://b.org/", link("http://a.org/"))], "page_id long, url string, html string")
    got = {r["host"]: r["trust"] for r in url_trust.judge(wheel, (("allow", "org", "/ok/"),)).collect()}
    assert abs(got["a.org"] - 1 / 1.85) < 1e-5 and abs(got["b.org"] - 0.85 / 1.85) < 1e-5


def components_of(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    again = True
    while again:
        again = False
        for a in ids:
            for b in ids:
                o = len(sets[a] & sets[b])
                if sets[a] and sets[b] and den * o >= num * (len(sets[a]) + len(sets[b]) - o) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    again = True
    return sets, label


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_jaccard_join(docs, none, k, num):
    sets, label = components_of([(r["doc_id"], r["text"]) for r in docs.collect()], k, num, 100)
    for r in jaccard_join.cluster(docs, k, num, 100).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]])
    assert jaccard_join.cluster(none, k, num, 100).count() == 0


@pytest.mark.parametrize("k,num", [(4, 85), (2, 60)])
def test_jaccard_join_counts_every_link(spark, k, num):
    base = [f"w{i}" for i in range(200)]
    group = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 200, 20)]  # all alike, in one component
    rows = list(enumerate([" ".join(base), *group, group[0], group[0].upper(), "", None, "one", "one", "a lone text of its own", *(" ".join(base[j:]) for j in (3, 9, 15, 30))]))
    sets, _ = components_of(rows, k, num, 100)
    over = lambda a, b: len(sets[a] & sets[b])
    linked = {(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and 100 * over(a, b) >= num * len(sets[a] | sets[b])}
    pairs, members = jaccard_join.links(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100)
    members = {r["doc_id"]: r for r in members.collect()}
    assert {i: m["n_links"] for i, m in members.items()} == {i: sum(a == i for a, _ in linked) for i in sets}
    cls = {i: m["class_id"] for i, m in members.items()}
    want = {(*sorted((cls[a], cls[b])), over(a, b)) for a, b in linked if cls[a] != cls[b]}
    got = [(r["a"], r["b"], r["overlap"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 45


@pytest.mark.parametrize("window", [13, 5])
def test_substring_dedup(docs, none, window):
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, window).collect()}
    first = {}
    for d in docs.orderBy("doc_id").collect():
        w = WORD.findall(d["text"] or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first.setdefault(tuple(w[s : s + window]), d["doc_id"]) < d["doc_id"]:
                gone[s : s + window] = [True] * window
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept"], r["lang"]) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g), "x")
    assert substring_dedup.remove_repeats(none).count() == 0


def test_suffix_automaton():
    rng = random.Random(4)
    seqs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 12))] for _ in range(12)]
    auto = substring_dedup.SuffixAutomaton(seqs, range(len(seqs)))
    for s in seqs:
        for w in (1, 3, 5):
            want = [min(m for m, t in enumerate(seqs) if any(t[j : j + w] == s[i : i + w] for j in range(len(t)))) for i in range(len(s) - w + 1)]
            assert auto.least_marks(s, w) == want


def test_sentencepiece(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, t in enumerate([None, "", " ", "Hello  world", "漢字 émigré", "a" * 50 + " b", "the the of\nof", "<s> 🎉"])]
    got = sp_lattice.encode(spark.createDataFrame(rows, "doc_id long, text string"), path)
    back = {r["doc_id"]: r for r in sp_lattice.decode(got, path).collect()}
    for i, t in rows:
        assert np.frombuffer(back[i]["ids"], "<u4").tolist() == model.encode(t or "") and back[i]["text"] == (t or "")


def test_byte_cnn(spark):
    rng = random.Random(9)
    good = ["".join(rng.choices("abcdefgh ", k=400)) for _ in range(120)]
    bad = ["".join(rng.choices("#$%*!| ", k=400)) for _ in range(120)]
    net = byte_cnn.train([t.encode() for t in good[:100] + bad[:100]], [1] * 100 + [0] * 100)
    s = lambda t: net.score(np.frombuffer(t.encode(), np.uint8))
    assert np.mean([s(t) >= 0.5 for t in good[100:]]) > 0.9 and np.mean([s(t) < 0.5 for t in bad[100:]]) > 0.9
    df = spark.createDataFrame([(1, None, 0.3), (2, "", 0.1), (3, "x" * 100_000, 0.2)], "doc_id long, text string, score double")
    out = byte_cnn.score(df, net).collect()
    assert len(out) == 3 and all(0 <= r["score"] <= 1 for r in out) and out[0]["score"] == out[1]["score"]


def test_pipeline_stages_on_small_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(r, t or "", "en", "s", len(t or "")) for r, t in enumerate(texts(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    _, label = components_of([(r[0], r[1]) for r in rows], 5, 80, 100)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in label.items() if i == c}
    out = corpus_pipeline.repeated_passages(spark, kept, "")
    assert out.columns == df.columns and out.count() <= kept.count()
