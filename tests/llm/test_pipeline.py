"""The pipeline's stages one after another, each against brute force on what the stage before it left."""

import random
from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm.common import stored

from . import brute

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "minhash near-dedup", "suffix-array dedup", "source mix", "bpe encoding"]
    stages = [f for _, f in corpus_pipeline.STAGES]

    kept = stored(stages[0](spark, docs, DATA), "t")
    assert kept.columns == columns
    before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in kept.collect()}
    assert after.items() <= before.items() and not any(brute.quality(t)[5] for t in after.values())
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = [r.doc_id for r in labels.where("quality = 1").collect() if not brute.quality(before[r.doc_id])[5]]
    assert all(d in after for d in good) and not any(r.doc_id in after for r in labels.where("quality = 0").collect())

    single = stored(stages[1](spark, kept, DATA), "t")
    comp = brute.components(sorted(after.items()), 5)
    left = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == columns and left == {d: t for d, t in after.items() if comp[d] == d}

    cut = stored(stages[2](spark, single, DATA), "t")
    want = {d: kept.decode(errors="ignore") for d, _, _, _, kept in brute.removals(list(left.items()))}
    assert cut.columns == columns and {r.doc_id: r.text for r in cut.collect()} == want

    mixed = stored(stages[3](spark, cut, DATA), "t")
    total = sum(len(brute.words(t)) for t in want.values())
    assert mixed.columns == columns and abs(sum(len(brute.words(r.text)) for r in mixed.collect()) - total) <= 20
    assert mixed.agg(F.max("doc_id")).first()[0] in want

    coded = sorted(map(tuple, stages[4](spark, mixed, DATA).collect()))
    library, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in mixed.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        out.append((r.doc_id, len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha(library.decode(ids, skip_special_tokens=False).encode()), ids))
    assert coded == sorted(out)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == coded


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, equal and null ids, and columns of clashing names; and an empty table."""
    rng = random.Random(12)
    prose = [" ".join(rng.choice("the of and to a word text line other more with some kind as from by".split()) + rng.choice(["", "", f"{rng.randrange(99)}"]) for _ in range(90)) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x", i, "y") for i, t in enumerate(prose)]
    rows += [rows[2], rows[2], (2, prose[3], None, None, None, None, None, None), (None, prose[4] + " tail", "en", "s1", 5, "x", 1, "y"), (None, None, None, None, None, None, None, None), (99, "", "en", "s0", 0, "x", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, _gone long, `_in_1` string")
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    at = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        at = stored(stage(spark, at, ""), "t")
        assert at.columns == docs.columns, name
        if i in (1, 2):  # the text of document 3 stands under id 2 as well
            assert sorted(r.doc_id for r in at.collect()) == sorted([*range(12), 2])[: 3 + 1] + [*range(4, 12)]
    mixed = sorted(r.doc_id for r in at.collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()) == mixed and set(mixed) <= set(range(12))
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_a_run_leaves_its_last_input_only(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {p.name for p in shared.iterdir()}
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert [p.name.split("-")[:2] for p in shared.iterdir() if p.name not in before] == [["stage", "3"]]
