"""Every stage of the pipeline on the smallest tables, and its run, against plain Python."""

import corpus_pipeline as P
from tessella.llm.quality_rules import RULES
from tests.conftest import SF
from tests.llm import brute


def test_stages(spark):
    from tokenizers import Tokenizer

    from tessella.llm.queries import tokenizer_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stage = dict(P.STAGES)
    assert list(stage) == ["quality_rules", "near_dedup", "decontaminate", "mix", "token_output"]
    rows = lambda d: [(r.doc_id, r.source, r.text) for r in d.collect()]

    kept = stage["quality_rules"](spark, docs, SF).cache()
    assert kept.columns == docs.columns
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg({"quality": "max"}).collect() if r[1] == 1}
    want = brute.kept_by_rules([(r.doc_id, r.text, r.lang) for r in docs.collect()], good, RULES)
    assert {r[0] for r in rows(kept)} == want

    single = stage["near_dedup"](spark, kept, SF).cache()
    want = brute.near_duplicates([(d, t) for d, _, t in rows(kept)], width=5)
    assert single.columns == docs.columns and {r[0] for r in rows(single)} == {d for d, (_, c) in want.items() if c == d}
    assert single.count() < kept.count() < docs.count()

    clean = stage["decontaminate"](spark, single, SF).cache()
    bad = brute.contaminated([(d, t) for d, _, t in rows(single)], items)
    assert clean.columns == docs.columns and {r[0] for r in rows(clean)} == {r[0] for r in rows(single)} - bad and bad

    mixed = stage["mix"](spark, clean, SF).cache()
    want = brute.mix(rows(clean))
    got = {}
    for r in rows(mixed):
        got[r[0]] = got.get(r[0], 0) + 1
    assert mixed.columns == docs.columns and got == {d: n for d, n in want.items() if n}

    tok, at, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for d, _, t in sorted(rows(mixed), key=lambda r: r[0]):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), brute.crc(ids)))
        at += len(ids)
    out = [tuple(r) for r in stage["token_output"](spark, mixed, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert out == want
    whole = [tuple(r) for r in P.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert whole == want


def test_nulls_and_further_columns_pass_every_stage(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text + " a", "en", None, 1, "x", 1), (1, text + " b", None, "s", 2, "x", 1), (1, text + " b", None, "s", 2, "x", 1), (2, None, "en", "s", None, None, None), (3, "", "en", None, 0, "x", 1), (4, " ".join(f"other{i}" for i in range(50)), "en", "s", 3, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, did string, key int")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "did", "key"]
    assert {r.doc_id for r in docs.collect()} <= {1, 4}
    P.STAGES[-1][1](spark, docs, SF).collect()
    for _, stage in P.STAGES:
        docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
        assert stage(spark, docs, SF).collect() == []


def test_rows_without_id_stand_alone(spark):
    """A row without id that copies a document or holds a test item goes; the others without id stay."""
    stage = dict(P.STAGES)
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()), key=len)
    text = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(5, text("a"), "en"), (None, text("a"), "fr"), (None, text("b"), "en"), (None, "so " + item, "en"), (None, text("c"), None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, did string")
    single = stage["near_dedup"](spark, docs, SF)
    assert single.columns == docs.columns and {r[1:3] for r in single.collect()} == {r[1:3] for r in rows} - {rows[1][1:3]}
    clean = stage["decontaminate"](spark, single, SF)
    assert clean.columns == docs.columns and {(r[0], r[1]) for r in clean.collect()} == {r[:2] for r in (rows[0], rows[2], rows[4])}
