"""The registered corpus queries on the smallest tables, against DuckDB where there is SQL and against the library where there isn't, and each operator on texts of megabytes."""

import random

import duckdb
import pytest

from tessella.llm import queries as Q
from tests.conftest import SF
from tests.llm import brute

TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.queries()[name](spark, SF)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(Q.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols and got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str) and got


def test_token_queries_agree_with_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path())
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    ids = {d: tok.encode(t, add_special_tokens=False).ids for d, t in docs}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in Q.queries()["op10_token_counts"](spark, SF).collect()}
    assert counts == {d: (len(t.encode()), len(ids[d]), len(ids[d]) > 2048) for d, t in docs}
    at, want = 0, []
    for d, _ in docs:
        row = [*ids[d], 2]
        want.append((d, at, len(row), brute.crc(row)))
        at += len(row)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in Q.queries()["op8_token_output"](spark, SF).orderBy("doc_id").collect()]
    assert got == want


def test_decontamination_query_agrees_with_plain_python(spark):
    rows = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()]
    got = {r.doc_id for r in Q.queries()["op6_decontamination"](spark, SF).collect()}
    assert got == brute.contaminated(rows("documents", "doc_id"), rows("benchmark", "item_id")) and got


@pytest.fixture(scope="module")
def megabytes():
    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(30_000)]
    lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14))) for _ in range(30_000)]
    near = list(lines)
    for i in range(0, len(near), 150):
        near[i] = "changed " + near[i]
    common = "One line that all of these hold in the same words"
    texts = ["\n".join(lines) + "\n" + common, "\n".join(near) + "\n" + common, common + "\n" + "x" * 1_200_000, "ab " * 400_000 + "\n" + common, " ".join(lines[:200])]
    assert max(map(len, texts)) > 1_200_000
    return [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)]


def test_texts_of_megabytes(spark, megabytes):
    """Every operator on texts of over a megabyte: long lines, one word, two words again and again, a near copy."""
    from tokenizers import Tokenizer

    from tessella.llm import decontaminate, html_extract, line_dedup, minhash_dedup, mixture, quality_rules, suffix_dedup, token_counts, token_output

    docs = spark.createDataFrame(megabytes, "doc_id long, text string, lang string, source string").repartition(5)
    rows = [r[:2] for r in megabytes]
    tok, path = Tokenizer.from_file(Q.tokenizer_path()), Q.tokenizer_path()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup_lines(docs).collect()} == brute.line_dedup(rows)
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    for r in quality_rules.quality_rules(docs, labels).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_counts(rows[r.doc_id][1])
    near = minhash_dedup.near_duplicates(docs, width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near} == brute.near_duplicates(rows)
    assert near and len({r.component_id for r in near}) == 4
    assert {r.doc_id: r.n_removed for r in suffix_dedup.repeated_bytes(docs).collect()} == {d: n[1] for d, n in brute.repeated_bytes(rows).items()}
    counts = {d: len(tok.encode(t, add_special_tokens=False).ids) for d, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()} == counts
    assert {r.doc_id: r.n_tokens for r in token_output.token_output(docs, path).collect()} == {d: n + 1 for d, n in counts.items()}
    assert {r.doc_id: r.size for r in mixture.mix(docs).collect()} == {d: len(brute.WORD.findall(t)) for d, t in rows}
    items = spark.createDataFrame([(0, " ".join(rows[0][1].split()[5000:5060])), (1, "ab " * 300)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, items).collect()} == {(0, 0), (1, 0), (3, 1)}
    page = spark.createDataFrame([(0, "http://h/", f"<article><p>{rows[0][1]}</p></article><footer>f</footer>"), (1, "http://h/", f"<div>{rows[0][1]}</div>")], "page_id long, url string, html string")
    want = " ".join(rows[0][1].split())
    assert {r.page_id: r.text == want for r in html_extract.main_text(page).collect()} == {0: True, 1: True}


def test_a_long_conversation(spark, megabytes):
    from tessella.llm.chat_format import format_chats

    chat = [(0, 0, "user", megabytes[2][1]), (0, 1, "assistant", megabytes[0][1]), (0, 2, None, "And?"), (1, 0, "user", "Why?"), (1, 1, "assistant", "So.")]
    out = format_chats(spark.createDataFrame(chat, "conv_id long, turn long, role string, text string")).where("conv_id = 0").collect()
    assert sum(r.n_lines for r in out) == sum(t.count("\n") + 1 for c, _, _, t in chat if c == 0) and {r.role for r in out if r.given} == {"user", "assistant"}
