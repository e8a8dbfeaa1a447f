"""Each operator against brute force, and its defined results for nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import bpe_codec, minhash_dedup, quality_rules, rp_forest, site_quality, source_mix, suffix_dedup, token_count, token_store, url_filter, wordcache

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _words string, band long, part int, `_in_0` string"
WORDS = "alpha beta gamma delta of the and to le la und der que con straße übung être niño 4711 x".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([1, 3, 30, 80, 200])) for _ in range(40)]
    texts += [texts[7], texts[7], texts[9] + " tail", "lead " + texts[11], prose(rng, 4000), None, "", " \n\t ", "a", "word " * 60, "line one\n" * 30]
    texts += [texts[3] + "\n" + texts[5], "<|endoftext|> x <|startoftext|>", "ab" * 400, "İΑΣ é\u0085 x\u001cy 한국 😀" * 5, texts[44][:9000]]
    return [(None if i == 30 else i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, 5, "w", 9, 1, "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([*rows, rows[4]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality_rules(docs, rows, empty):
    got = sorted_rows(quality_rules.judge(docs).select("doc_id", *quality_rules.MEASURES, "base_failed"))
    assert got == sorted(((r[0], *brute.quality(r[1])) for r in [*rows, rows[4]]), key=repr)
    verdict = quality_rules.judge(docs)
    assert verdict.where("kept AND base_failed").count() == 0
    kept = quality_rules.keep(docs)
    assert kept.schema == docs.schema and kept.count() == verdict.where("kept").count()
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep(empty).count() == 0


def test_token_store(spark, docs, rows, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    folder = token_store.write_store(docs, f"file://{tmp_path}/store", path)
    want, start = [], 0
    all_rows = sorted([*rows, rows[4]], key=lambda r: (r[0] is None, r[0] or 0))
    for r in all_rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted_rows(token_store.read_back(spark, folder)) == sorted(want, key=repr)
    back = {(r.doc_id, tuple(r.ids)) for r in token_store.ids_of(spark, folder).collect()}
    assert back == {(r[0], (*library.encode(r[1] or "", add_special_tokens=False).ids, 1)) for r in all_rows}
    chunks = token_store.chunk_rows(spark, folder)
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert token_store.store_documents(empty, path).count() == 0


def test_store_notices_damage(spark, docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = token_store.write_store(docs, f"file://{tmp_path}/store", path)
    damaged = token_store.chunk_rows(spark, folder).withColumn("n_ids", F.col("n_ids")).withColumn("payload", F.expr("payload || X'00'")).withColumn("kind", F.lit("chunk"))
    token_store.recipe_rows(spark, folder)
    damaged.write.partitionBy("kind").parquet(f"file://{tmp_path}/bad/content")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"file://{tmp_path}/bad/{part}")
    with pytest.raises(Exception, match="chunk|Frame|size|Destination|frombuffer|buffer"):
        token_store.read_back(spark, f"file://{tmp_path}/bad").collect()


def test_chunks_follow_content():
    ids = np.random.default_rng(1).integers(0, 49_000, 30_000).astype(np.uint16)
    cuts = token_store.cut_points(ids)
    later = token_store.cut_points(np.concatenate((np.arange(777, dtype=np.uint16), ids)))
    assert cuts[-1] == 30_000 and max(np.diff([0, *cuts])) <= token_store.MAX_IDS
    assert len({c + 777 for c in cuts} & set(later)) > 0.8 * len(cuts)
    data = np.arange(5000, dtype="<u4")
    parts = [(zlib.crc32(data[a : a + 700].tobytes()), len(data[a : a + 700]) * 4) for a in range(0, 5000, 700)]
    assert token_store.crc_joined(parts) == zlib.crc32(data.tobytes())


def test_source_mix(docs, empty):
    got = source_mix.mix(docs).toPandas()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    assert sorted_rows(source_mix.mix(docs)) == sorted_rows(source_mix.mix(docs.repartition(5)))
    groups = got.groupby(["source_size", "target"], as_index=False).agg(taken=("taken", "sum"))
    assert len(groups) == 4 and ((groups.taken - groups.target).abs() <= 1).all() and (groups.target <= 3 * groups.source_size + 1e-6).all()
    assert abs(groups.target.sum() - got["size"].sum()) < 1e-6 * got["size"].sum()
    mixed = source_mix.mixed_rows(docs)
    assert mixed.schema == docs.schema
    assert mixed.agg(F.sum(source_mix.word_count(F.coalesce("text", F.lit(""))))).first()[0] == got.taken.sum()
    assert source_mix.mix(empty).count() == 0 and source_mix.mixed_rows(empty).count() == 0


def test_mix_of_rows_with_equal_or_no_ids(spark):
    """They have keys of their own, so none of their ranges holds them all."""
    rng = random.Random(2)
    rows = [(None if i % 2 else 5, prose(rng, rng.choice([5, 50])), "a" if i % 3 else "b") for i in range(3000)]
    docs = spark.createDataFrame([*rows, rows[0], rows[1]], "doc_id long, text string, source string")
    keys = source_mix._keyed(docs).groupBy("_key").count().toPandas()["count"]
    assert len(keys) == len(set(rows)) and keys.max() <= 3
    got = source_mix.mix(docs).toPandas()
    for _, part in got.groupby("source_size"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 1
    assert sorted_rows(source_mix.mix(docs)) == sorted_rows(source_mix.mix(docs.repartition(7)))


def test_first_words(spark):
    texts = [" a  b\tc\n", "a b c", "a", "", " x y"]
    df = spark.createDataFrame([(t, n) for t in texts for n in range(5)], "t string, n int")
    for r in df.withColumn("p", source_mix.first_words(F.col("t"), F.col("n"))).collect():
        assert brute.words(r.p) == brute.words(r.t)[: r.n] and r.t.startswith(r.p)


def test_budgets_share_what_full_sources_leave(spark):
    sizes = {"va": 1000, "vb": 10, "vc": 500, "n": 100, "vd": 0}
    got = {r._source: r.target for r in source_mix.budgets(spark.createDataFrame(list(sizes.items()), "_source string, source_size long")).collect()}
    weight = {"va": 1, "vb": 2, "vc": 3, "vd": 1, "n": 2}
    want, open_ = {}, set(sizes)
    while True:  # as the rule says it, step by step
        left = sum(sizes.values()) - sum(want.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    want |= share
    assert got == pytest.approx(want)


def test_forest_finds_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(30, size=3000)] + 0.4 * rng.normal(size=(3000, 16))
    x[500:900] = x[500]
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    data += [(4000, None, 1), (4001, [0.0] * 16, 1), (4020, [1.0, None] * 8, 1), (4040, [float("nan")] * 16, 1), (4060, [1.0], 1), (None, x[0].tolist(), 1), (7, x[7].tolist(), 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, leaf int")
    got = rp_forest.search(table, F.col("vec_id") % 20 == 0).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 20)) and (got.groupby("query_id").size() == 20).all()
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        score = (x * x[q]).sum(axis=1)
        assert np.allclose(part.score, score[part.vec_id]) and (np.diff(part.score) <= 0).all() and q not in set(part.vec_id)
        assert all(a < b for a, b, s, t in zip(part.vec_id, part.vec_id[1:], part.score, part.score[1:]) if s == t)
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(3000), -score))[:20]) & set(part.vec_id))
    assert hits / len(got) >= 0.9
    few = spark.createDataFrame(data[:5], "vec_id long, embedding array<double>, leaf int")
    assert sorted_rows(rp_forest.search(few, F.col("vec_id") % 20 == 0).select("query_id", "rank"))[-1] == (0, 4)
    assert rp_forest.search(table.where("vec_id IS NULL"), F.col("vec_id") % 20 == 0).count() == 0


def recall_of(got, x, every=20, k=20):
    hits = 0
    for q, part in got.groupby("query_id"):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), -score))[:k]) & set(part.vec_id))
    return hits / len(got)


def test_forest_goes_deeper_than_its_sample(spark, monkeypatch):
    """Leaves of some 16 rows of 6000, with a sample that tells medians down to 16 leaves."""
    monkeypatch.setattr(rp_forest, "SAMPLE", 512)
    monkeypatch.setattr(rp_forest, "LEAF", 16)
    monkeypatch.setattr(rp_forest, "FEW", 1.0)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(200, 16))[rng.integers(200, size=6000)] + 0.2 * rng.normal(size=(6000, 16))).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    grown = []
    deepen = rp_forest.deepen
    monkeypatch.setattr(rp_forest, "deepen", lambda f, *a: (deepen(f, *a), grown.append((f.depth, np.concatenate([t.leaves(x) for t in f.trees])))))
    got = rp_forest.search(table, F.col("vec_id") % 20 == 0).toPandas()
    assert len(got) == 300 * 20 and recall_of(got, x) >= 0.9
    depth, leaves = grown[0]
    assert depth == 9 and np.bincount(leaves).max() < 40 * 8 and len(np.unique(leaves)) > 400


def test_forest_on_the_embeddings(spark, monkeypatch):
    """Some 64 leaves for each tree, on vectors without structure."""
    monkeypatch.setattr(rp_forest, "LEAF", 32)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r.embedding for r in table.orderBy("vec_id").collect()])
    got = rp_forest.search(table, F.col("vec_id") % 20 == 0).toPandas()
    assert len(got) == 100 * 20 and recall_of(got, x) >= 0.9


def test_url_filter(spark):
    rng = random.Random(8)
    hosts = ["org", "example.org", "a.example.org", "com", "x.com", "comet", "", "b..org"]
    paths = ["", "/", "/e", "/es/", "/es/x", "/en/1", "/en/", "/ö", "/es/x/y"]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in hosts[:6] for p in rng.sample(paths, 5)]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(['', 'WWW.', 'q.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=://b/', '#t'])}" for _ in range(400)]
    urls += [None, "", "nothing", "://", "mailto:a@example.org"] * 2 + ["http://example.org/es/x"] * 200
    table = spark.createDataFrame([(i // 2, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        want.append((i // 2, host, path, best[2], best[3]))
    old = url_filter.SWEEP_ROWS
    try:
        for url_filter.SWEEP_ROWS in (old, 20):  # one sweep for each domain, and several
            assert sorted_rows(url_filter.judge(table, url_filter.rule_frame(spark, rules))) == sorted(want, key=repr)
    finally:
        url_filter.SWEEP_ROWS = old
    assert {r.verdict for r in url_filter.judge(table, url_filter.rule_frame(spark, []), "block").collect()} == {"block"}
    assert url_filter.judge(table.limit(0), url_filter.rule_frame(spark, rules)).count() == 0


@pytest.fixture(scope="module")
def odd_texts(rows):
    rng = random.Random(5)
    pool = "aAbß é\n\t\r\x0b\x1c\x85\xa0　İΣσςẞ́ñ'stredl0129½一二가😀.,!?#ͅﬁÅK<|>"
    odd = ["", " ", "  a", "a  ", "a \n b", "<|endoftext|>x<|startoftext|>", "don't we'LL 'S", "x" * 3000, "a <|endoftext|> b", "\x00a\x00", "aaaaaaa" * 99]
    odd += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x30000)])) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    return odd + [r[1] or "" for r in rows]


def test_codec_is_the_librarys(spark, docs, rows, odd_texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, codec, encoder = Tokenizer.from_file(path), bpe_codec.codec(path), token_store.encoder(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in odd_texts]
    for e in (codec, encoder):
        ids, ends = e.encode_all(pa.array(odd_texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
        assert [e.encode(t) for t in odd_texts[:400]] == want[:400]
    decoded = [library.decode(i, skip_special_tokens=False) for i in want]
    assert codec.digests(ids, ends) == ([brute.sha(" ".join(map(str, i)).encode()) for i in want], [brute.sha(d.encode()) for d in decoded])
    assert codec.decode([60_000, 5, -1, 7]) == codec.decode([5, 7]) and codec.decode([]) == ""
    coded = {(r.doc_id, r.n_tokens, tuple(r.ids)) for r in bpe_codec.encoded_corpus(docs, path).collect()}
    df = bpe_codec.decode(bpe_codec.encode(docs, path), path)
    assert coded == {(r.doc_id, len(r.ids), tuple(r.ids)) for r in df.collect()}
    for r in df.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == library.decode(r.ids, skip_special_tokens=False)
    assert bpe_codec.encode_digests(docs, path).count() == len(rows) + 1
    assert bpe_codec.encode_digests(docs.limit(0), path).count() == 0


def test_counts_are_the_librarys(spark, docs, rows, odd_texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, count = Tokenizer.from_file(path), token_count.counter(path)
    counts = [len(library.encode(t, add_special_tokens=False).ids) for t in odd_texts]
    assert count.count_all(pa.array(odd_texts, pa.string())).tolist() == counts and [count(t) for t in odd_texts] == counts
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in [*rows, rows[4]]]
    assert sorted_rows(token_count.count_tokens(docs, path)) == sorted(want, key=repr)
    assert token_count.count_tokens(docs.limit(0), path).count() == 0


def test_caches_are_bounded_and_keep_what_is_frequent():
    made = []
    cache = wordcache.BoundedCache(lambda k: made.append(k) or k, 2400)
    for i in range(100):
        assert cache["hot"] == "hot" and cache[str(i)] == str(i)
    assert made.count("hot") == 1 and len(cache) + len(cache.aside) <= 14


def test_pieces_of_megabytes_are_not_kept(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, count = token_store.encoder(path), token_count.counter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = pa.array(["ab" * 600_000 + f"{i}é" for i in range(3)] + ["x", ""], pa.string())
    caches = (encode.long, encode.words, count.long, count.words)
    before = [c.taken for c in caches]
    assert np.diff(encode.encode_all(texts)[1], prepend=0).min() == 0 and count.count_all(texts)[3] == 1
    assert all(c.taken - t < 10_000 for c, t in zip(caches, before, strict=True))


def test_piece_table_forgets_what_is_rare():
    made = []
    table = wordcache.PieceTable(lambda raw: made.append(raw) or [len(raw), *raw], np.dtype(np.int32), slots=6)
    rng = random.Random(1)
    for i in range(300):
        words = ["often", "x" * 15, "é", *(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 5, 100 if i == 50 else 5])))]
        p = wordcache.pieces(pa.array([" ".join(words), "", "often  often"]))
        slot = table.find(p, np.arange(len(p.starts)))
        found = [table.values[a : a + n].tolist() for a, n in zip(table.start[slot].tolist(), table.count[slot].tolist(), strict=True)]
        assert found == [[len(w.encode()), *w.encode()] for w in [*words, "often", "", "often"]]
        assert table.taken <= 1 << (table.bits - 1)
    assert made.count(b"often") <= 3 and table.bits <= 8


def test_a_worker_holds_the_tables_of_one_operator():
    first = wordcache.held(("a",), list)
    assert wordcache.held(("a",), list) is first and wordcache.held(("b",), list) is not first
    assert list(wordcache._holding) == [("b",)]


def test_slices_are_bounded(monkeypatch):
    monkeypatch.setattr(wordcache, "SLICE", 10)
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["aaaa", "bbbb", "é" * 20, "", "c", "dddddddd"])], ["i", "t"])
    assert [s.column(0).to_pylist() for s in wordcache.slices(b, 1)] == [[0, 1], [2], [3, 4, 5]]
    p = wordcache.pieces(b.slice(1).column(1))
    assert p.at(np.arange(4)) == [b"bbbb", "é".encode() * 20, b"c", b"dddddddd"] and p.ends.tolist() == [1, 2, 2, 3, 4]


def test_suffix_dedup(docs, rows, empty):
    want = [(d, n, gone, spans, brute.sha(kept)) for d, n, gone, spans, kept in brute.removals([(r[0], r[1]) for r in rows])]
    want.append(next(w for w in want if w[0] == 4))  # a repeated row has equal results
    assert sorted_rows(suffix_dedup.removals(docs)) == sorted(want, key=repr)
    cleaned = suffix_dedup.clean(docs)
    assert cleaned.schema.names == docs.schema.names
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    for d, _, gone, _, kept in brute.removals([(r[0], r[1]) for r in rows]):
        original = next(r[1] for r in rows if r[0] == d)
        assert texts[d] == (kept.decode(errors="ignore") if gone else original)
    assert suffix_dedup.removals(empty).count() == 0 and suffix_dedup.clean(empty).count() == 0


@pytest.mark.parametrize("hot", [200_000, 3])
def test_suffix_dedup_of_shared_passages(spark, hot, monkeypatch):
    rng = random.Random(6)
    passages = [prose(rng, 40) for _ in range(4)]
    texts = []
    for i in range(60):
        p = rng.choice(passages)
        a, b = sorted(rng.sample(range(len(p)), 2))
        texts.append(prose(rng, 20) + p[a:b] + prose(rng, 10) + rng.choice(passages) + chr(97 + i % 26) * rng.choice([1, 150]))
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = list(enumerate(texts))
    got = sorted_rows(suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted(((d, n, gone, spans, brute.sha(kept)) for d, n, gone, spans, kept in brute.removals(rows)), key=repr)
    assert sum(g[2] for g in got) > 0


def test_suffix_dedup_of_a_token_that_leads_everywhere(spark, monkeypatch):
    """Several splitters fall on one token, whose runs are then dealt by context."""
    rng = random.Random(7)
    core = "the one and only string of thirty-two bytes or more, which leads"
    texts = [prose(rng, 3) + f"{i} " + core + f" {rng.randrange(10**9)} " + (core if i % 5 == 0 else "") + rng.choice(["", "tail " * 30]) for i in range(300)]
    rows = [(i % 250 if i % 7 else None, t) for i, t in enumerate(texts)]
    made = []
    splitters = suffix_dedup.Splitters
    monkeypatch.setattr(suffix_dedup, "Splitters", lambda *a: made.append(splitters(*a)) or made[-1])
    for flush in (suffix_dedup.FLUSH, 500):
        monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
        got = sorted_rows(suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
        ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, suffix_dedup.tie_of(r[1].encode())))
        assert got == sorted(((d, n, gone, spans, brute.sha(kept)) for d, n, gone, spans, kept in brute.removals(ordered)), key=repr)
    assert len(made[0].split) and sum(g[2] for g in got) > 5000


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    for n, k, width in ((0, 5, 2), (1, 5, 2), (1000, 3, 4), (3000, 50, 2), (2000, 2, 12)):
        words, group = rng.integers(0, k, (n, width)).astype(np.uint64), rng.integers(0, 7, n)
        order, new = suffix_dedup.multikey_quicksort(words, group)
        assert (order == np.lexsort((*words.T[::-1], group))).all()
        rows = np.column_stack((group, words))[order]
        assert (new == np.concatenate((np.ones(min(n, 1), bool), (rows[1:] != rows[:-1]).any(axis=1)))).all()


def test_suffix_dedup_tells_many_texts_of_one_id_apart(spark):
    rng = random.Random(8)
    passages = [prose(rng, 40) for _ in range(30)]
    texts = {prose(rng, rng.choice([3, 20])) + rng.choice(passages) * (i % 2) + f" {i} " + prose(rng, 20) for i in range(4000)}
    ordered = sorted(texts, key=lambda t: suffix_dedup.tie_of(t.encode()))
    rows = [(5 if i % 4 == 0 else None, t) for i, t in enumerate(ordered)]
    want = [(d, n, gone, spans, brute.sha(kept)) for d, n, gone, spans, kept in brute.removals(rows)]
    assert sorted_rows(suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == sorted(want, key=repr)


def test_contexts_have_all_bits_of_their_hash():
    context = suffix_dedup.runs_of(prose(random.Random(5), 3000).encode())[1]
    assert len(context) > 200 and int(context.max()) >> 63 and np.bitwise_or.reduce(context) == np.uint64(2**64 - 1)


def test_long_texts_are_taken_in_segments(monkeypatch):
    rng = random.Random(2)
    data = (prose(rng, 3000) + "z" * 400 + prose(rng, 10)).encode()
    token, _, lo, off, n = suffix_dedup.runs_of(data)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 1000)
    parts = suffix_dedup.runs_of(data)

    def windows(token, lo, off, n):
        return {(int(a) + i, int(a + o), int(t)) for t, a, o, k in zip(token, lo, off, n, strict=True) for i in range(int(k))}

    whole = windows(token, lo.astype(int), off.astype(int), n)
    assert {(w, t) for w, _, t in whole} == {(w, t) for w, _, t in windows(parts[0], parts[2].astype(int), parts[3].astype(int), parts[4])} and len(whole) == len(data) - 99


def test_minhash(docs, rows, empty):
    comp = brute.components([(r[0], r[1]) for r in rows], 2)
    want = [(r[0], len(brute.shingles(r[1], 2)), comp.get(r[0]), r[0] is None or comp[r[0]] == r[0]) for r in [*rows, rows[4]]]
    assert sorted_rows(minhash_dedup.components(docs, 2)) == sorted(want, key=repr)
    kept = minhash_dedup.keep(docs, 2)
    assert kept.schema == docs.schema and kept.count() == sum(r[0] is None or comp[r[0]] == r[0] for r in [*rows, rows[4]])
    assert minhash_dedup.components(empty).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_minhash_finds_chains_and_large_groups(spark, monkeypatch, small):
    for name in ("HOSTS", "VISITORS", "BLOCK", "HUB") if small else ():
        monkeypatch.setattr(minhash_dedup, name, 3)
    rng = random.Random(9)
    texts = []
    for _ in range(4):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        chain = list(base)
        for i in range(25):  # each member is near the one before it, not the first
            texts.append(" ".join(chain))
            for _ in range(rng.choice([3, 5, 8])):
                chain[rng.randrange(120)] = f"v{i}_{rng.randrange(1000)}"
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    comp = brute.components(rows, 2)
    got = {r.doc_id: r.component_id for r in minhash_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == comp and len(set(comp.values())) < 90


def test_every_set_of_a_bucket_is_counted():
    """Sets at a similarity of exactly 0.8 and just below it, whatever their signatures; few hosts and many."""
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 1 << 64, 100_000, np.uint64))
    rng.shuffle(pool)
    four, five = np.sort(pool[:4]), np.sort(pool[:5])
    far = [np.sort(pool[10 + 6 * i : 15 + 6 * i]) for i in range(500)]
    for others in (2, 500):
        hosts = minhash_dedup.Hosts()
        hosts.sets += [*far[:others], four]
        assert hosts.near(five, 80) and not hosts.near(np.sort(pool[1:7]), 80) and not hosts.near(pool[:0], 80)
    ten = [np.sort(np.append(pool[:9], x)) for x in pool[9:13]]  # at 9 / 11 of each other
    table = pa.table({"side": [2] * 5, "node": [1, 2, 3, 4, 5], "component": [1, 2, 3, 4, 5], "shingles": [s.tobytes() for s in [*ten, far[0]]]})
    assert sorted(map(tuple, (r.values() for r in minhash_dedup._join_blocks(80)(table).to_pylist()))) == [(1, 2), (1, 3), (1, 4)]
    apart = table.set_column(0, "side", pa.array([0, 0, 1, 1, 1])).set_column(2, "component", pa.array([1, 1, 3, 4, 5]))
    assert len(minhash_dedup._join_blocks(80)(apart)) == 2


def test_long_sets_share_no_coordinates_by_chance():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 64, 300_000, np.uint64)) for _ in range(2))
    assert (minhash_dedup.signature(a) == minhash_dedup.signature(b)).mean() == 0
    both = np.concatenate((a[:100_000], b[:12_500])), np.concatenate((a[:100_000], b[12_500:25_000]))
    assert 0.65 < (minhash_dedup.signature(both[0]) == minhash_dedup.signature(both[1])).mean() < 0.95


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text, of which many reach the similarity with some of the others only."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 20)
    monkeypatch.setattr(minhash_dedup, "HOSTS", 30)
    monkeypatch.setattr(minhash_dedup, "HUB", 50)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(100), rng.choice([0, 2, 5, 8, 9, 10])):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    comp = brute.components(rows, 2)
    got = {r.doc_id: r.component_id for r in minhash_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == comp and 10 < len(set(comp.values())) < 250


def test_keep_takes_any_column_names(spark):
    rows = [(1, "a b c d", 1, "x", "y"), (2, "a b c d", 2, "x", "y"), (3, "other words here", 3, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, `_in_0` string, _row string")
    assert sorted_rows(minhash_dedup.keep(docs, 2)) == sorted_rows(minhash_dedup.single(docs, 2)) == [rows[0], rows[2]]


def test_one_doc_id_of_two_texts_links_them(spark):
    rows = [(1, "a b c d"), (2, "e f g h"), (7, "a b c d"), (7, "E f g h"), (9, None)]
    got = sorted_rows(minhash_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), 2).select("doc_id", "component_id"))
    assert got == [(1, 1), (2, 1), (7, 1), (7, 1), (9, 9)]


def test_near_dedup_stage_leaves_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (4, text), (4, text + " x"), (3, "other words " + text[::-1]), (None, "a b"), (None, "a b"), (5, "c d"), (5, "c d"), (5, "e f"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted_rows(corpus_pipeline.drop_near_duplicates(spark, docs, ""))
    assert len([r for r in left if r[0] == 4 and r[1].startswith(text)]) == 1
    assert [r for r in left if r[0] != 4] == sorted([(3, rows[4][1]), (None, "a b"), (5, "c d"), (5, "e f"), (6, None), (7, "")], key=repr)


def test_site_quality(spark, docs, rows, empty):
    data = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = site_quality.judge(table, labels.where(~held)).join(labels.where(held), "doc_id").toPandas()
    assert len(got) > 80 and (got.kept == (got.quality == 1)).mean() > 0.95
    assert sorted_rows(site_quality.judge(table, labels)) == sorted_rows(site_quality.judge(table.repartition(4), labels))
    nobody = labels.limit(0)
    odd = site_quality.judge(docs, nobody).toPandas()
    wordless = {r[0] for r in rows if not brute.words(r[1])}
    assert len(odd) == len(rows) + 1 and set(odd[~odd.kept].doc_id.dropna()) == {d for d in wordless if d is not None}
    assert site_quality.judge(empty, nobody).count() == 0


def brute_site_quality(spark, rows, labels):
    """The scores in plain Python, from the operator's features and fit."""
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = site_quality.features(table, "source", "lang").toPandas()
    known = {d: y for d, y in labels}
    names = site_quality.FEATURES
    some = found[found.doc_id.isin(known)]
    w, c, prior = site_quality.fit(some[names].to_numpy(float), np.array([known[d] for d in some.doc_id], float))
    logit = np.where(found.n_words > 0, np.clip(found[names].to_numpy(float) @ w + c, -30, 30), -30)
    p = np.round(1 / (1 + np.exp(-logit)), 6)
    n, mean = len(p), p.mean()
    host, path = found.host.to_numpy(), (found.host + "/" + found.path).to_numpy()
    hosts = {h: p[host == h] for h in set(host)}
    paths = {x: (p[path == x], hosts[x.split("/")[0]]) for x in set(path)}

    def strength(between, within, groups):
        extra = between - within * (groups - 1) / n
        return min(site_quality.STRONGEST, max(site_quality.WEAKEST, within / extra - 1)) if extra > 0 else site_quality.STRONGEST

    k_host = strength(sum(len(v) * (v.mean() - mean) ** 2 for v in hosts.values()) / n, mean * (1 - mean), len(hosts))
    within = sum(len(v) * h.mean() * (1 - h.mean()) for v, h in paths.values()) / n
    k_path = strength(sum(len(v) * (v.mean() - h.mean()) ** 2 for v, h in paths.values()) / n, within, len(paths) - len(hosts) + 1)
    out = []
    for i in range(n):
        h, q = hosts[host[i]], paths[path[i]][0]
        at_host = (h.sum() - p[i] + k_host * mean) / (len(h) - 1 + k_host)
        at_path = (q.sum() - p[i] + k_path * at_host) / (len(q) - 1 + k_path)
        odds = np.log(np.clip(at_path, 1e-4, 1 - 1e-4) / (1 - np.clip(at_path, 1e-4, 1 - 1e-4)))
        out.append((at_host, at_path, 1 / (1 + np.exp(-(logit[i] - prior + odds))) if found.n_words[i] else 0.0))
    return dict(zip(found.doc_id.tolist(), out, strict=True))


def test_site_quality_is_that_of_plain_python(spark):
    """Sites of one document and of many, good and bad ones, a null host, an empty text, and extra columns of clashing names."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        site = rng.choice(["a", "a", "a", "b", "c", None, f"lone{i}"])
        good = rng.random() < {"a": 0.9, "b": 0.1}.get(site, 0.5)
        text = prose(rng, rng.choice([20, 60])) if good else " ".join(rng.choice(["##", "$$ buy", "NOW", "word word word"]) for _ in range(30))
        rows.append((i, text if i != 7 else None, site, rng.choice(["x", "y", f"z{i % 40}"])))
        labels += [(i, int(good))] if i % 3 == 0 and i != 7 else []
    want = brute_site_quality(spark, rows, labels)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, lang string, n int, part int").repartition(3)
    got = site_quality.judge(table, spark.createDataFrame([*labels, (7, None), (10**6, 1)], "doc_id long, quality int")).collect()
    assert len(got) == 400
    for r in got:
        assert (r.host_quality, r.path_quality, r.score) == pytest.approx(want[r.doc_id], abs=2e-4), r
        assert r.kept == (r.score >= 0.5)
    assert 0.2 < sum(r.kept for r in got) / 400 < 0.9


def test_sparse_sites_lean_on_their_priors(spark):
    assert site_quality.strength(0.0, 0.25, 10, 100) == site_quality.STRONGEST
    x = np.random.default_rng(0).normal(size=(500, 2))
    y = (x[:, 0] + 0.1 * x[:, 1] > 0).astype(float)
    w, c, prior = site_quality.fit(x, y)
    assert ((x @ w + c > 0) == (y == 1)).mean() > 0.95 and abs(prior) < 0.3
