"""The registered queries on small tables with odd rows, against brute force and the libraries; the operators on more of such rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from loomstore.llm import bpe, byte_cnn, jaccard_join, packing, queries, sp_lattice, substring_dedup, token_counts, token_files
from loomstore.llm.shared import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, LOWER, PIECES = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
LOW = str.maketrans({c: c + 32 for c in range(65, 91)})


def odd_texts():
    """(doc_id, text): copies, near copies, equal ids with other texts, repeated rows, nulls, blanks, long and unspaced texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "naïve", "漢字", "don't"]
    make = lambda n: " ".join(rng.choices(words, k=n))
    passage = " ".join(f"p{i}" for i in range(70))
    base = [make(rng.randint(0, 90)) for _ in range(24)]
    rows = list(enumerate(base))
    rows += [(100 + i, t) for i, t in enumerate(base[:8])]  # copies
    rows += [(200 + i, t + " one more") for i, t in enumerate(base[:8])]  # near copies
    rows += [(300 + i, f"{make(60)} {passage} {make(5)}") for i in range(5)]
    rows += [(7, base[7]), (7, "another text under the same id " + make(30)), (400, None), (401, ""), (402, " \n\t"), (403, None), (404, "one two"), (405, "ONE Two")]
    rows += [(500, "x" * 30_000), (501, "same " * 20_000), (502, "漢字かな" * 2000), (503, "<|endoftext|> and <|endof"), (504, "<s>▁▁ \U0001f600\x00")]
    rows += [(None, base[3]), (None, None), (2**62, "far"), (-(2**63), "least")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_texts()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    d = str(tmp_path_factory.mktemp("tables"))
    # A column of the kind that an operator adds, in the way.
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, "x") for i, t in rows], schema)
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    docs.limit(0).write.parquet(f"{d}/none/documents.parquet")
    label = [(i, None if n % 11 == 5 else n % 2, 0) for n, (i, _) in enumerate(rows)]
    spark.createDataFrame(label, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(label, "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{d}/none/labels.parquet")
    return d


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE), Tokenizer.from_file(LOWER)


def bag(xs):
    return collections.Counter(xs)


def test_op1(spark, folder, rows, library):
    got = queries.op1_pack(spark, folder).toPandas()
    want = [(i, np.array(library[0].encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for i, t in rows]
    crcs = collections.defaultdict(list)
    for i, ids in want:
        crcs[i].append(ids)
    # Pieces of a row: those of its id and length that lie end to end; each must be a cut of one of the texts.
    cover = collections.Counter()
    for r in got.itertuples():
        key = None if r.doc_id is None or r.doc_id != r.doc_id else int(r.doc_id)
        own = [x for x in crcs[key] if len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        assert own, r
        cover[key] += r.length
    assert cover == {k: sum(map(len, v)) for k, v in crcs.items()}
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.cumsum(s.length) - s.length).all() and s.length.sum() <= 1024
    assert queries.op1_pack(spark, f"{folder}/none").count() == 0


def test_op1_groups_are_balanced(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('a b c ', CAST(20 + id % 300 AS INT))").alias("text")).repartition(32)
    windows = packing.pack(docs, BYTE).groupBy("tier", "step_group", "sequence_id").count().groupBy("tier").pivot("step_group").count().collect()
    for r in windows:
        n = [r[str(g)] or 0 for g in range(8)]
        assert max(n) - min(n) <= max(6, 0.15 * max(n)), (r["tier"], n)


def test_op2(spark, folder, rows, library):
    got = queries.op2_token_counts(spark, folder)
    n = lambda t: len(library[0].encode(t or "", add_special_tokens=False).ids)
    assert bag((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == bag((i, len((t or "").encode()), n(t), n(t) > 512) for i, t in rows)
    assert queries.op2_token_counts(spark, f"{folder}/none").count() == 0


def test_op2_answers_budgets_from_stored_counts(spark, library):
    texts = ["naïve café 漢字かな the <|endoftext|> end", "a  b\n\n c's they'll", "", None, "٣٤ \u1c89 한국어" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts.count_tokens(df, BYTE, budget=5, keep_prefixes=True).collect():
        t = texts[r["doc_id"]] or ""
        n = [len(library[0].encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        blob = bytes(r["prefix_counts"])
        assert [token_counts.tokens_at(blob, len(t), i) for i in range(len(t) + 1)] == n
        assert r["fits_chars"] == max(i for i, x in enumerate(n) if x <= 5) == token_counts.longest_within(blob, len(t), 5)


def test_prefix_counts_are_linear():
    import time

    enc = bpe.BatchEncoder(BYTE)
    mixed = "".join(random.Random(1).choices(["漢字", "the cat", "かな", "ваша", ", ", "123 ", "ก", "é"], k=120_000))
    began = time.process_time()
    got = enc.count_prefixes([mixed])[0]
    assert time.process_time() - began < 20 and len(mixed.encode()) > 500_000
    assert got[-1] == len(enc.tok.encode(mixed, add_special_tokens=False).ids)


def test_op6_and_one_of_each(spark, folder, rows):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    want = bag((i, len(sets[a]), None if i is None else least[find(a)]) for a, (i, _) in enumerate(rows))
    assert bag((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op6_jaccard_join(spark, folder).collect()) == want
    assert queries.op6_jaccard_join(spark, f"{folder}/none").count() == 0
    # One of each group: of the least id; of that id's texts one; of equal rows one.
    kept = jaccard_join.one_of_each(spark.read.parquet(f"{folder}/documents.parquet"), 4, 85, 100)
    groups = collections.defaultdict(set)
    for a, (i, t) in enumerate(rows):
        groups[("alone", a) if i is None or not sets[a] else find(a)].add((i, t))
    out = bag((r["doc_id"], r["text"]) for r in kept.collect())
    assert sum(out.values()) == len(groups)
    for g, members in groups.items():
        assert sum(out[m] for m in members) >= 1
        if not isinstance(g, tuple):
            assert any(out[m] for m in members if m[0] == min(i for i, _ in members))


def repeats(rows, window):
    """(words, removed, kept) of each row."""
    out, first = [], collections.defaultdict(set)
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for s in range(len(w) - window + 1):
                first[tuple(w[s : s + window])].add(i)
    least = {k: min(v) for k, v in first.items()}
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and least[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_op7(spark, folder, rows):
    want = bag((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in repeats(rows, 13))
    assert bag((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op7_substring_dedup(spark, folder).collect()) == want
    assert queries.op7_substring_dedup(spark, f"{folder}/none").count() == 0


def test_op7_on_hot_passages(spark, monkeypatch):
    """More distinct segments around one anchor than a shard takes, and a text that repeats itself."""
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", 1000)
    rng, common = random.Random(6), " ".join(f"c{i}" for i in range(13))
    rows = [(i, f"{' '.join(rng.choices('abcdefghij', k=9))} {common} {' '.join(rng.choices('abcdefghij', k=9))}") for i in range(3000)] + [(5000, "m n o " * 400), (5001, "o m n " * 300)]
    want = bag(repeats(rows, 13))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 13)
    assert bag((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == want


def test_op8(spark, folder, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = bag((i, tuple(sp.encode(t or "")), zlib.crc32(sp.decode(sp.encode(t or "")).encode())) for i, t in rows)
    got = queries.op8_sentencepiece(spark, folder).collect()
    assert bag((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded_crc32"]) for r in got) == want and all(4 * r["n_pieces"] == len(r["ids"]) for r in got)
    assert queries.op8_sentencepiece(spark, f"{folder}/none").count() == 0


def test_sentencepiece_words_are_cut_where_no_piece_goes(spark):
    m = sp_lattice.model(PIECES)
    starts, first, text, _ = m.words(["Hello,  world's 漢字\n", "", "aaaa"])
    words = [text[a:b] for a, b in zip(starts[:-1], starts[1:])]
    assert "".join(words) == text and list(first) == [0, len(words) - 1, len(words) - 1, len(words)]
    for p in m.table:  # no piece lies across two words
        n = m.number[[ord(c) for c in p]]
        assert m.beside[n[:-1], n[1:]].all()
    odd = spark.createDataFrame([(1, bytearray(np.array([5, 2**32 - 1, 40_000], "<u4").tobytes())), (2, None), (3, bytearray())], "doc_id long, ids binary")
    got = {r["doc_id"]: r["text"] for r in sp_lattice.decode(odd, PIECES).collect()}
    assert got[2] is None and got[3] == "" and got[1] == chr(5 - 3)


def test_op9(spark, folder, rows, library):
    got = queries.op9_token_files(spark, folder).collect()
    ids = [(i, np.array(library[1].encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t in rows]
    assert bag((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == bag((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    run = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == run
        run += r["n_tokens"]
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    path = scratch(spark, "least")
    token_files.write(spark.createDataFrame([(-(2**63), "least"), (None, "null"), (5, "five")], "doc_id long, text string"), path, LOWER)
    assert [x.tolist() for x in token_files.fetch(spark, path, -(2**63))] == [library[1].encode("least", add_special_tokens=False).ids + [2]]
    assert queries.op9_token_files(spark, f"{folder}/none").count() == 0


def test_op10(spark, folder, rows):
    got = queries.op10_byte_cnn(spark, folder).collect()
    held = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 3 == 1
    assert bag((r["doc_id"], r["held_out"]) for r in got) == bag((i, held(i)) for i, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert queries.op10_byte_cnn(spark, f"{folder}/none").count() == 0


def slow_score(w, data):
    """The network written out: every filter at every place, the greatest and the mean response."""
    codes = list(data) + [256] * (max(0, byte_cnn.WIDTH - len(data)) if len(data) <= byte_cnn.WIDTH else -(len(data) - byte_cnn.WIDTH) % byte_cnn.STRIDE)
    places = range(0, len(codes) - byte_cnn.WIDTH + 1, byte_cnn.STRIDE)
    y = np.array([np.concatenate([w["embed"][c] for c in codes[p : p + byte_cnn.WIDTH]]).astype(float) @ w["filters"].astype(float) + w["shift"] for p in places])
    y = np.maximum(y, 0)
    return 1 / (1 + np.exp(-(np.concatenate([y.max(0), y.mean(0)]) @ w["out"].astype(float) + float(w["bias"][0]))))


def test_the_network_is_what_it_says():
    r = np.random.default_rng(2)
    net = byte_cnn.ByteCNN(byte_cnn._start(3))
    for n in (0, 1, 7, 8, 9, 12, 13, 500, 4 * byte_cnn.CHUNK_STEPS + 5):
        data = r.integers(0, 256, n).astype(np.uint8)
        assert net.score(data) == pytest.approx(slow_score(net.w, data.tolist()), abs=1e-4)


def test_held_out_labels_never_enter(spark):
    rng = random.Random(5)
    docs = [(i, "".join(rng.choices("abcdef " if i % 2 else "#%&! ", k=300))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 3 == 1)) for i, _ in docs], "doc_id long, quality int")
    a, b = (byte_cnn.fit(df, lab(f), ~queries.held_out()) for f in (False, True))
    assert all(np.array_equal(a.w[k], b.w[k]) for k in a.w)
    scores = [(a.score(np.frombuffer(t.encode(), np.uint8)) >= 0.5) == i % 2 for i, t in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(scores) > 0.9
    one = byte_cnn.fit(df, df.select("doc_id", F.lit(1).alias("quality")))
    none = byte_cnn.fit(df, df.select("doc_id", F.lit(None).cast("int").alias("quality")))
    assert one.score(np.zeros(0, np.uint8)) > 0.5 and none.score(np.zeros(0, np.uint8)) > 0.5
    few = byte_cnn.fit(df, lab(False), max_train=10)
    assert 0 <= few.score(np.zeros(5, np.uint8)) <= 1


def test_pipeline_on_odd_rows(spark, folder, rows, library):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = byte_cnn.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~queries.held_out())
    left = [(i, t) for i, t in rows if model.score(np.frombuffer((t or "").encode(), np.uint8)) >= corpus_pipeline.REJECT_BELOW]
    got = corpus_pipeline.quality(spark, docs, folder)
    assert got.columns == list(corpus_pipeline.COLUMNS) and bag((r["doc_id"], r["text"]) for r in got.collect()) == bag(left)
    # The stages after it, on rows of all kinds.
    kept = corpus_pipeline.near_duplicates(spark, docs, folder)
    stays = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert (7, next(t for i, t in rows if i == 7 and t.startswith("another"))) in stays and len(stays) < len(rows)
    out = corpus_pipeline.repeated_passages(spark, kept, folder)
    want = bag((i, k if g else t, len(k) if g else None if t is None else len(t)) for (i, t), (_, n, g, k) in zip(stays, repeats(stays, 50)) if not g or g < n)
    assert out.columns == list(corpus_pipeline.COLUMNS) and bag((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == want
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() > 0 and corpus_pipeline.run(spark, f"{folder}/none").count() == 0
    by_row = whole.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in by_row} <= {i for i, _ in left}


def brute(x, ids, q, k, usable):
    s = np.array([float(np.dot(x[q].astype(float), v.astype(float))) if len(v) == len(x[q]) else -np.inf for v in x])
    fine = [j for j in range(len(x)) if usable[j] and ids[j] != ids[q] and len(x[j]) == len(x[q])]
    return sorted(fine, key=lambda j: (-s[j], ids[j]))[:k], s


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("vectors"))
    r = np.random.default_rng(8)
    x = [v for v in r.standard_normal((420, 6)).astype(np.float32)]
    for j in range(40, 90):
        x[j] = x[40]  # ties
    x[200], x[201], x[300] = x[200][:3], x[201][:3], np.zeros(6, np.float32)
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)] + [(420, None, 1), (421, [], 1), (422, [1.0, None] + [0.0] * 4, 1), (423, [float("nan")] * 6, 1), (None, [1.0] * 6, 1), (5, [float(c) for c in x[5]], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long")
    df.write.parquet(f"{d}/embeddings.parquet")
    df.limit(0).write.parquet(f"{d}/none/embeddings.parquet")
    return d, x


def test_op3(spark, vectors):
    d, x = vectors
    ids, usable = list(range(len(x))), [bool(np.any(v)) for v in x]
    got = collections.defaultdict(list)
    for r in queries.op3_hnsw(spark, d).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in range(0, len(x), 20):
        if not usable[q]:
            assert q not in got
            continue
        want, s = brute(x, ids, q, 20, usable)
        assert [r for r, _, _ in got[q]] == list(range(1, len(want) + 1))
        assert all(v == s[j] or abs(v - s[j]) < 1e-9 for _, j, v in got[q])
        assert [(-v, j) for _, j, v in got[q]] == sorted((-v, j) for _, j, v in got[q])
        hit, total = hit + len({j for _, j, _ in got[q]} & set(want)), total + len(want)
    assert hit >= 0.9 * total and queries.op3_hnsw(spark, f"{d}/none").count() == 0


def test_op4(spark, vectors):
    d, x = vectors
    whole = [np.floor(1024 * v.astype(float)).astype(np.int64) for v in x]
    got = collections.defaultdict(list)
    for r in queries.op4_segment_topk(spark, d).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(0, len(x), 100):
        want, s = brute(whole, list(range(len(x))), q, 10, [True] * len(x))
        assert got[q] == [(j, int(s[j])) for j in want]
    assert queries.op4_segment_topk(spark, f"{d}/none").count() == 0


def test_bounds_leave_what_can_be_best(spark):
    from loomstore.llm import segment_topk as S

    r = np.random.default_rng(4)
    centres = r.standard_normal((40, 32)) * 4
    x = np.floor(1024 * (centres[r.integers(0, 40, 4000)] + 0.2 * r.standard_normal((4000, 32)))).astype(np.int64)
    q = x[:50]
    for s in (1, 4, 16):
        bound = S.statistics(q, s) @ S.statistics(x, s).T
        assert (bound + 1e-9 * S.lengths(q)[:, None] * S.lengths(x)[None] + 1 >= S.exact(x, q)).all()
    assert (S.box_bounds(q, S.box(x)[None])[:, 0] >= S.exact(x, q).max(1)).all()
    floor = np.sort(S.exact(x, q), 1)[:, -11]
    top, left = S.block_top(np.arange(50), q, np.arange(4000), x, floor, 11)
    for i in range(50):
        full = S.exact(x, q[i : i + 1])[0]
        assert top[top.qcls == i].cls.tolist() == sorted(range(4000), key=lambda j: (-full[j], j))[:11]
    assert left[-1] < 0.1 * 50 * 4000  # clusters can be told apart by their segments
    rows = spark.createDataFrame([(i, [float(c) / 1024 for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for row in S.search(rows, 10, 100, block=128).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append(row["vec_id"])
    y = np.floor(1024 * (x / 1024)).astype(np.int64)
    for i in range(0, 4000, 100):
        full = S.exact(y, y[i : i + 1])[0]
        assert got[i] == [j for j in sorted(range(4000), key=lambda j: (-full[j], j)) if j != i][:10]


def test_graph_by_hubs_finds_near_vectors():
    from loomstore.llm import hnsw

    r = np.random.default_rng(1)
    x = r.standard_normal((9000, 24)).astype(np.float32)
    g = hnsw.Graph(np.arange(9000), x)
    assert len(g.levels[0][0]) > hnsw.SMALL  # not compared whole
    q = x[::90]
    true = np.argsort(-(q @ x.T), 1)[:, :20]
    got = g.search(q, 21)
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got[:, :21], true)]) >= 0.9


def test_op5_without_links(spark, tmp_path):
    rows = [(1, "http://A.com/x?q", None), (2, "no host", "<a href='http://a.com'>"), (None, None, None), (1, "http://A.com/x?q", None), (3, "x://lone.org#y", ""), (4, "http://b.net/es/1", "<a href=/fr/>"), (5, "http://b.net/zz", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("x")).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.op5_url_trust(spark, str(tmp_path)).collect()), key=str)
    # A host without links stands by its own pages: b.net has a blocked one and none that is allowed.
    want = [(1, "a.com", "/x", "com/", "allow")] * 2 + [(2, "", "", None, "allow"), (0, "", "", None, "allow"), (3, "lone.org", "", None, "allow"), (4, "b.net", "/es/1", "net/es/", "block"), (5, "b.net", "/zz", None, "block")]
    assert got == sorted(want, key=str)
