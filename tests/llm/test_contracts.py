"""The queries' contracts on small tables with awkward rows, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, did string, key int, h string"


def make(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, lang, src, len(t or ""), "x", 1, "y") for d, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7)))
    base = [" ".join(word() for _ in range(rnd.randint(30, 60))) for _ in range(12)]
    common = "A common line that Many documents hold, " + " ".join(word() for _ in range(14))
    rows = []
    for i in range(60):
        t = base[i % 12]
        if i % 4 == 1:
            w = t.split()
            w[rnd.randrange(len(w))] = word()
            t = " ".join(w)
        if i % 5 == 2:
            t = " ".join(word() for _ in range(40))
        if i % 3 == 0:
            t = t + "\n" + ("  " if i % 2 else "") + (common.upper() if i % 6 == 0 else common) + "\t\nshort\n"
        rows.append((i, t, ("en", "fr", None)[i % 3], ("b", "a", None, "é")[i % 4] if i % 7 else "a"))
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \n\t\x0b\n", "en", "b"), (103, "one", "en", "b"), (104, "One", "en", "b"), (105, "ab " * 3000, "en", "z")]
    rows += [(106, "x" * 5000, "fr", "z"), (107, "É É é <|endoftext|> it's 3,5% ", "fr", "a"), (108, "#" * 300 + " word", "en", "a"), (109, "a b c\n" * 50, "en", "a")]
    return rows


def test_line_dedup(spark, corpus):
    from tessella.llm.line_dedup import dedup_lines

    out = {r.doc_id: r for r in dedup_lines(make(spark, corpus), batches=3, fanout=2).collect()}
    want = brute.line_dedup([r[:2] for r in corpus])
    assert {d: (r.n_lines, r.n_dropped, r.kept_sha256) for d, r in out.items()} == want
    assert any(w[1] for w in want.values())


def test_line_dedup_hot_lines_meet_by_broadcast(spark):
    from tessella.llm import line_dedup as L

    entries = spark.createDataFrame([(d, bytearray(b"k%d" % (d % 2 if d < 40 else d))) for d in range(60)], "did long, h binary")
    totals = entries.groupBy("h").agg(F.count_distinct("did").alias("n_docs"), F.max("did").alias("owner"))
    whole = {(r.did, bytes(r.h)) for r in L.repeated_elsewhere(entries, totals, 3).collect()}
    assert whole == {(d, b"k%d" % (d % 2)) for d in range(38)}


def test_quality_counts(spark, corpus):
    from tessella.llm.quality_rules import quality_rules

    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules(make(spark, corpus), labels).collect()
    for r in out:
        text = next(t for d, t, *_ in corpus if d == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_counts(text), r.doc_id
        assert not (r.base_failed and r.kept)
    assert len(out) == len(corpus)


def test_quality_thresholds(spark):
    """Cutoffs certified in large strata, pooled in small ones, ruled out by a stratum's own labels, and none where labels are too few."""
    from tessella.llm import quality_rules as Q

    rnd = random.Random(3)
    plain = lambda: " ".join("word"[: rnd.randint(2, 4)] * rnd.randint(1, 2) + str(rnd.randrange(97)) for _ in range(30))
    odd = lambda: " ".join(f"mot{rnd.randrange(999)}##" for _ in range(30))
    rows = [(i, plain() if i % 200 else odd(), "en") for i in range(2500)] + [(5000 + i, plain(), "de") for i in range(150)] + [(6000 + i, plain(), ("fr", "xx", None)[i % 3]) for i in range(60)]
    rows += [(7000 + i, odd(), ("en", "de", "fr", "xx", None, "none")[i % 6]) for i in range(60)] + [(8000 + i, odd(), "xx") for i in range(9)] + [(9000, None, "en"), (9001, "", None), (9002, "few words", "de")]
    good = {d for d, _, _ in rows if d < 7000 or 8000 <= d}
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, s string")
    for share in (1.0, 0.2, 0.02):
        some = {d for d in good if rnd.random() < share}
        labels = spark.createDataFrame([(d, 1, 0) for d in some] + [(d, 0, 0) for d, _, _ in rows[::3]] + [(None, 1, 0), (7001, None, 1)], "doc_id long, quality int, toxic int")
        want = brute.kept_by_rules(rows, some, Q.RULES)
        assert {r.doc_id for r in Q.quality_rules(docs, labels).where("kept").collect()} == want
        assert {r.doc_id for r in Q.good_documents(docs, labels).collect()} == want
        plainly = {d for d, t, _ in rows if not brute.base_counts(t)[-1]}
        assert share == 0.2 or (want != plainly) == (share == 1.0)
        if share == 1.0:
            gone = {s for d, _, s in rows if 7000 <= d < 8000 and d not in want}
            assert "de" in gone and "xx" not in gone


def test_binomial_tail(spark):
    import math

    from tessella.llm import quality_rules as Q

    n, k, p = 300, 4, 0.02
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    got = spark.range(1).select(F.exp(Q.binomial_below(F.lit(n), F.lit(k), F.lit(p))).alias("x"), F.exp(Q.binomial_below(F.lit(n), F.lit(0), F.lit(p))).alias("y")).first()
    assert math.isclose(got.x, exact, rel_tol=1e-9) and math.isclose(got.y, (1 - p) ** n, rel_tol=1e-9)


def test_rules_act_in_every_language(spark):
    """On the supplied tables of sf0.01, junk goes in each language and no labelled good document does."""
    from tessella.llm import quality_rules as Q

    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = Q.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), labels).cache()
    gone = out.where("not kept and not base_failed")
    assert {r.stratum for r in gone.select("stratum").distinct().collect()} == {"en", "de", "fr", "es"}
    assert gone.join(labels.where("quality = 1"), "doc_id").count() == 0 and gone.join(labels.where("quality = 0"), "doc_id").count() > 20


def test_suffix_dedup(spark, corpus):
    from tessella.llm.suffix_dedup import repeated_bytes

    rows = [r[:2] for r in corpus]
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes(make(spark, corpus)).collect()}
    assert out == brute.repeated_bytes(rows)


@pytest.mark.parametrize("hot, levels", [(1, (6, 24, None)), (2, (1, None)), (3, (2, 69, None)), (1, (None, None))])
def test_suffix_dedup_hot_hashes(spark, corpus, monkeypatch, hot, levels):
    """Hashes with too many different pieces for one index are dealt by finer ones, with the same result."""
    from tessella.llm import suffix_dedup as S

    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "LEVELS", levels)
    monkeypatch.setattr(S, "INDEX_BYTES", 3000)
    rnd = random.Random(2)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(160))
    more = [(1000 + i, "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 90))) + passage[rnd.randint(0, 30) : rnd.randint(135, 160)] + str(i) * 9, "en", "a") for i in range(40)]
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeated_bytes(make(spark, corpus + more)).collect()}
    assert out == brute.repeated_bytes([r[:2] for r in corpus + more])


def test_suffix_dedup_repeated_rows(spark):
    from tessella.llm.suffix_dedup import repeated_bytes

    a, b = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80)), "z" * 150
    rows = [(1, a), (1, a), (2, a), (2, b), (None, b), (None, None)]
    out = repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in out)
    n = len(a)
    assert got == sorted([("1", n, 0), ("1", n, 0), ("2", n, n), ("2", 150, 149), ("None", 150, 150), ("None", 0, 0)])


def test_run_index():
    import numpy as np

    from tessella.llm.suffix_dedup import RunIndex

    rnd = random.Random(1)
    for _ in range(40):
        parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 70))) for _ in range(rnd.randint(1, 7))]
        width, seen, want, at = rnd.choice([2, 5, 9]), set(), [], 0
        for p in parts:
            for i in range(len(p) - width + 1):
                if p[i : i + width] in seen:
                    want.append(at + i)
                seen.add(p[i : i + width])
            at += len(p) + 1
        index = RunIndex([np.frombuffer(p, np.uint8) for p in parts])
        assert index.repeats(width).tolist() == want
        assert len(index.runs) == len(index.starts) == len(index.ends)


def test_mix(spark, corpus):
    from tessella.llm.mixture import mix

    out = mix(make(spark, corpus)).collect()
    assert len(out) == len(corpus)
    sizes, taken, target, longest = {}, {}, {}, {}
    for r in out:
        text = next(t for d, t, *_ in corpus if d == r.doc_id)
        assert r.size == len(brute.WORD.findall(text or "")) and r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r.size)
        target[r.source] = r.target
    want = brute.mix_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-9
        assert all(r.source_size == sizes[s] for r in out if r.source == s)
    again = sorted((str(r.doc_id), r.taken) for r in mix(make(spark, corpus).repartition(3)).collect())
    assert again == sorted((str(r.doc_id), r.taken) for r in out)


def test_mixed_documents_keep_columns_and_copies(spark, corpus):
    from tessella.llm.mixture import mix, mixed_documents

    docs = make(spark, corpus)
    want = {r.doc_id: r.copies for r in mix(docs).collect()}
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    seen = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert seen == {d: c for d, c in want.items() if c}


def test_mixed_documents_of_equal_rows(spark):
    """Equal ids and texts under two sources, equal rows, and rows without id: every row as often as mix takes it."""
    from collections import Counter

    from tessella.llm.mixture import mix, mixed_documents

    text = lambda i: " ".join(f"w{i}x{k}" for k in range(20 + i))
    rows = [(1, text(1), "a", 1), (1, text(1), "b", 2), (1, text(1), "b", 3), (1, text(2), "b", 4), (2, text(2), "b", 5), (None, text(3), "a", 6), (None, text(4), "a", 7), (None, text(4), None, 8)]
    rows += [(i, text(i % 9), "abc"[i % 3], 100 + i) for i in range(10, 60)] + [(7, text(7), "c", 9)] * 5 + [(8, "", "a", 10), (8, None, "a", 11), (None, None, None, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    want, got = Counter(), Counter()
    for r in mix(docs).collect():
        want[r.doc_id, r.source, r.mark] += r.copies
    for r in mixed_documents(docs).select("doc_id", "source", F.xxhash64("text").alias("mark"), "n").collect():
        got[r.doc_id, r.source, r.mark] += 1
    assert got == +want and sum(got.values()) > len(rows)
    sizes = [r["count"] for r in mixed_documents(docs).groupBy("n").count().collect()]
    assert max(sizes) <= 2 * 5


def test_key_ranges_are_narrow_whatever_the_weights(spark):
    """A source of equal weights, all at the floor, doesn't gather in one range."""
    from tessella.llm import mixture as M

    rows = spark.range(20000).select((-F.log(M.uniform(17, F.col("id").cast("string"))) / F.lit(0.05)).alias("key"))
    bins = rows.groupBy(F.floor(F.log2("key") * M.OCTAVE)).count()
    assert bins.agg(F.max("count")).first()[0] < 25


def test_weights_favour_quality(spark):
    from tessella.llm.mixture import mix

    rows = [(i, " ".join(f"ok{k}" if i % 2 else f"ok{k}###" for k in range(10)), "en", "ab"[i % 4 // 2]) for i in range(2000)]
    out = mix(make(spark, rows), weights=(1.0, 3.0), share=0.6, epochs=2.0).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.avg((F.col("copies") > 0).cast("int")).alias("s")).collect()
    share = {r.good: r.s for r in out}
    assert share[1] > share[0] * 1.5


def test_near_duplicates(spark, corpus):
    from tessella.llm.minhash_dedup import near_duplicates

    out = near_duplicates(make(spark, corpus), width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.near_duplicates([r[:2] for r in corpus])
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_chain_star_and_blocks(spark, monkeypatch):
    """Variants that are close to their base but not to each other, chains, and postings of several blocks."""
    from tessella.llm import minhash_dedup as M

    monkeypatch.setattr(M, "BLOCK", 4)
    monkeypatch.setattr(M, "PAIR", 3)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(500, " ".join(base))]
    for i in range(30):
        w = list(base)
        w[rnd.randrange(4, 116)] = f"v{i}"
        w[rnd.randrange(4, 116)] = f"u{i}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(200)]
    rows += [(600 + k, " ".join(chain[k * 5 : k * 5 + 100])) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(docs, width=4).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_repeated_ids(spark):
    from tessella.llm.minhash_dedup import near_duplicates

    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (3, b), (7, a), (5, b), (None, b), (None, None), (8, None), (8, None), (9, "solo text")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert len(out) == len(rows)
    assert {r.component_id for r in out if r.doc_id in (3, 5, 7)} == {3}
    assert {(r.component_id, r.kept) for r in out if r.doc_id in (8, 9)} == {(8, True), (9, True)}


def test_rows_without_id_are_told_by_text(spark):
    """A row without id that copies another neither takes other rows without id along nor ties what they copy."""
    from tessella.llm.minhash_dedup import near_duplicates

    text = lambda x: " ".join(f"{x}{i}" for i in range(30))
    rows = [(5, text("a")), (9, text("b")), (None, text("a")), (None, text("b")), (None, text("c")), (None, text("d")), (None, text("d") + " more"), (None, None)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out if r.doc_id) == [(5, 5, True), (9, 9, True)]
    lost = sorted((r.component_id or 0, r.kept) for r in out if r.doc_id is None)
    assert lost == [(0, False), (0, True), (0, True), (0, True), (5, False), (9, False)]


def encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_token_output_round_trip(spark, corpus, tmp_path):
    import pyarrow.parquet as pq

    from tessella.llm.token_output import Layout, token_output

    path, tok = encoder()
    rows = [*corpus, (None, "last of all", "en", "a"), (103, "one more", "en", "a")]
    for encoding in ("dictionary", "delta"):
        where = f"{tmp_path}/{encoding}"
        got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_output(make(spark, rows), path, path=f"file://{where}", layout=Layout(encoding, 4 << 10, 1 << 10, 20)).collect()]
        at, want = 0, []
        for d, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((d, at, len(ids), brute.crc(ids)))
            at += len(ids)
        key = lambda r: (r[1], str(r[0]))
        assert sorted(got, key=key) == sorted(want, key=key)
        import glob

        meta = [pq.ParquetFile(f).metadata.row_group(0) for f in glob.glob(f"{where}/*.parquet")]
        ids = [m.column(m.num_columns - 1) for m in meta]
        assert all(c.has_offset_index for c in ids)
        assert any("DELTA" in e for c in ids for e in c.encodings) == (encoding == "delta")


def test_token_counts(spark, corpus):
    from tessella.llm.token_counts import token_counts

    path, tok = encoder()
    for size in (64, 1 << 20):
        out = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(make(spark, corpus), path, 50, size).collect()}
        for d, t, *_ in corpus:
            n = len(tok.encode(t or "", add_special_tokens=False).ids)
            assert out[d] == (len((t or "").encode()), n, n > 50)


def test_word_encoder_equals_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from tessella.llm.token_counts import WordEncoder

    path, tok = encoder()
    own = WordEncoder(path, most=200)
    bits = st.sampled_from(["Hello", "été", "ÉCOLE", "it's", "'S", "<|endoftext|>", "<|", ",", "...", "\x01", "3", "½", "é", "H̱", "ẞ", "ΑΣ", "日本", "×", "÷,", " ", "\x85", " ", "\n", "a_b", "#$%", "'", "ﬁ", "İ", "K"])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(bits, max_size=12).map("".join))
    def same(text):
        import numpy as np

        assert np.frombuffer(own.encode([text.encode()])[0], "<i4").tolist() == tok.encode(text, add_special_tokens=False).ids

    same()


def test_sentencepiece_counts(spark):
    import public_tokenizers
    import sentencepiece

    from tessella.llm.token_counts import token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["Hello there", "", None, "été\nà"]
    out = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, batch_bytes=1 << 30).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_vocabularies_that_keep_white_space(spark, name):
    """Their texts are encoded whole, however long, for counts and for output."""
    import public_tokenizers

    from tessella.llm.token_counts import token_counts
    from tessella.llm.token_output import token_output

    path = public_tokenizers.path(name)
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(["word", " ", "  ", "\n", "é", "12", "\t\n", "End."]) for _ in range(n)) for n in (0, 5, 400, 3000)] + [None]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [list(model.encode(t or "")) for t in texts]
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, path, batch_bytes=100).collect()} == {i: len(x) for i, x in enumerate(want)}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_output(docs, path).collect()} == {i: (len(x) + 1, brute.crc([*x, 2])) for i, x in enumerate(want)}


def test_empty_tables(spark):
    from tessella.llm import chat_format, decontaminate, html_extract, line_dedup, minhash_dedup, mixture, quality_rules, suffix_dedup, token_counts, token_output

    path, _ = encoder()
    docs = make(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        line_dedup.dedup_lines(docs), quality_rules.quality_rules(docs, labels), suffix_dedup.repeated_bytes(docs), mixture.mix(docs), mixture.mixed_documents(docs),
        decontaminate.contaminated_pairs(docs, bench), minhash_dedup.near_duplicates(docs), token_output.token_output(docs, path), token_counts.token_counts(docs, path),
        html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")),
        chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert out.collect() == []


def test_sha_of_nothing(spark):
    from tessella.llm.line_dedup import dedup_lines

    out = dedup_lines(make(spark, [(1, None, None, None), (None, "x", "en", "a")])).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in out} == {1: (1, 0, hashlib.sha256(b"").hexdigest()), None: (1, 0, hashlib.sha256(b"x").hexdigest())}
