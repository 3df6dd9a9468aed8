"""HTML extraction, chat formatting, string tiling."""

import random

import numpy as np
import pytest

from tests.conftest import SF


def extract(page):
    from tessella.llm.html_extract import blocks

    return [t for m, t in blocks(page) if m]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four</article><footer>x</footer>", ["A & B", "one two three", "four"]),
        ("<nav>m</nav><main><p><b>bold<br><p>next</p><aside>s</aside><div class='comments'><p>hi</p></div></main>", ["bold", "next"]),
        ("<article><p>a<script>var t='</p><p>no';</script>b</p><form><p>f</p></form><!-- <p>c</p> --></article>", ["ab"]),
        ("<article><p>1 < 2 &copy; &middot; &#233; &am &amp</p>", ["1 < 2 © · é &am &"]),
        ("<article><p>cut of", ["cut of"]),
        ("<article><ul><li>x<li>y</ul><table><tr><td>p</td><td>q</td></tr></table></article>", ["x", "y", "p", "q"]),
        ("<article><div class='ad'>buy<div>now</div></div><p class=\"lead\">t</p><div role=complementary>z</div></article>", ["t"]),
        ("<article><p>a</p><p class=share-price>b</p><p id='notice-period'>c</p><div class=\"search-results\">d</div><section class='comment-on-law'>e</section></article>", list("abcde")),
        ("<article><p title=it's>a</p><p title='the hidden class=ad role'>b</p><p title=\"x>y\" data-role=menu>c<p hidden>d<p class='x ad y'>e</article>", list("abc")),
        ("<main><div class=share>s</div><article><header>h</header><div class=share>t</div><p role=note>n</p></article></main>", list("htn")),
        ("", []),
        ("plain text", []),
    ],
)
def test_blocks(page, want):
    assert extract(page) == want


def test_covered_tokens_are_those_other_pages_share():
    from tessella.llm.html_extract import covered

    rnd = random.Random(2)
    for _ in range(60):
        pages = [np.array([rnd.randrange(3) for _ in range(rnd.randint(0, 30))], np.int64) for _ in range(rnd.randint(1, 5))]
        least = rnd.choice([1, 2, 3, 4, 6])
        got = covered(pages, least)
        for i, p in enumerate(pages):
            want = np.zeros(len(p), bool)
            others = {tuple(q[k : k + least]) for j, q in enumerate(pages) if j != i for k in range(len(q) - least + 1)}
            for k in range(len(p) - least + 1):
                if tuple(p[k : k + least]) in others:
                    want[k : k + least] = True
            assert (got[i] == want).all()


def test_host_template_goes_and_unique_runs_stay(spark):
    from tessella.llm.html_extract import main_text

    rows = [(i, f"http://h.example/{i}", f"<div>Welcome to our site about things</div><div>story{i} of its own number{i} here</div><p>All rights are kept by us {i}</p>") for i in range(6)]
    rows += [(10, "http://other.example/1", "<div>Welcome to our site about things</div>"), (11, None, None), (12, "bad url", ""), (12, "bad url", "")]
    out = {(r.page_id): r for r in main_text(spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host int, part string"), fewest=3).collect()}
    for i in range(6):
        assert out[i].text == f"story{i} of its own number{i} here\n\n{i}"
    assert out[10].text == "Welcome to our site about things" and out[11].text == "" and out[12].n_chars == 0


def plain_main_text(rows, least=5, share=0.3, fewest=3, long=25, long_share=0.05):
    """(page_id, host, blocks) of pages without article to {page_id: text}: every window of every distinct page counted as a tuple."""
    import math

    out = {}
    for host in {h for _, h, _ in rows}:
        pages = {tuple(b) for _, h, b in rows if h == host}
        words = {b: [w for x in b for w in x.split(" ")] for b in pages}
        count = {}
        for b in pages:
            for width in (least, long):
                for win in {tuple(words[b][i : i + width]) for i in range(len(words[b]) - width + 1)}:
                    count[win] = count.get(win, 0) + 1
        need = {least: max(fewest, math.ceil(len(pages) * share)), long: max(fewest, math.ceil(len(pages) * long_share))}
        for i, h, b in rows:
            if h != host:
                continue
            ws, own = words[tuple(b)], [k for k, x in enumerate(b) for _ in x.split(" ")]
            marks = {}
            for width in (least, long):
                across, within = [False] * len(ws), [False] * len(ws)
                for k in range(len(ws) - width + 1):
                    if count[tuple(ws[k : k + width])] >= need[width]:
                        for j in range(k, k + width):
                            across[j] = True
                            within[j] = within[j] or own[k] == own[k + width - 1]
                marks[width] = across, within
            across, within = marks[least]
            more = sum(y and not x for x, y in zip(across, marks[long][0], strict=True))
            if more * 2 <= across.count(False):
                across, within = ([x or y for x, y in zip(u, v, strict=True)] for u, v in zip((across, within), marks[long], strict=True))
            kept = []
            for k in range(len(b)):
                at = [j for j in range(len(ws)) if own[j] == k]
                if not all(across[j] for j in at):
                    kept.append(" ".join(ws[j] for j in at if not within[j]))
            out[i] = "\n\n".join(x for x in kept if x)
    return out


def test_query_against_counted_windows(spark, tmp_path):
    """The registered query on hosts whose pages have no article, one of them with most of all pages."""
    from tessella.llm.queries import queries

    rnd = random.Random(12)
    tail = " ".join(f"legal{k}" for k in range(40))
    rows = []
    for i in range(120):
        host = "big" if i % 3 else f"small{i % 4}"
        own = [" ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 4))]
        own.insert(0, f"Start with {host} and read on now")
        if i % 7 == 0:
            own.append(tail)
        if i % 4 == 0:
            own[-1] += " see all of our other pages here"
        rows.append((i, host, own))
    rows += [(200, "big", rows[1][2]), (201, "big", rows[1][2]), (202, "alone", ["one page only of this host here"])]
    table = spark.createDataFrame([(i, f"https://{h}.example/{i}?x", "".join(f"<div>{x}</div>" for x in b), "x") for i, h, b in rows], "page_id long, url string, html string, h string")
    table.write.parquet(f"file://{tmp_path}/pages.parquet")
    out = {r.page_id: (r.text, r.n_chars) for r in queries()["op9_html_extraction"](spark, f"file://{tmp_path}").collect()}
    want = plain_main_text(rows)
    assert out == {i: (t, len(t)) for i, t in want.items()}
    assert all("Start with" not in want[i] for i, h, _ in rows if h == "big")
    assert any(tail in b and "legal1" not in want[i] for i, _, b in rows)


def test_query_against_another_parser(spark):
    """All supplied pages against the standard library's parser: the blocks of article."""
    from html.parser import HTMLParser

    from tessella.llm.html_extract import BLOCKS
    from tessella.llm.queries import queries

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.out = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in BLOCKS:
                self.out.append("")
            if tag == "br":
                self.out[-1] += " "

        def handle_endtag(self, tag):
            if tag in BLOCKS:
                self.out.append("")
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.out[-1] += data

    sf = SF.replace("0.001", "0.01")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    out = {r.page_id: r.text for r in queries()["op9_html_extraction"](spark, sf).collect()}
    assert len(out) == len(pages) > 200
    for r in pages:
        p = Article()
        p.feed(r.html)
        p.close()
        assert out[r.page_id] == "\n\n".join(y for x in p.out if (y := " ".join(x.split())))


def test_article_text_is_never_template(spark):
    from tessella.llm.html_extract import main_text

    page = "<nav>a b c d e f</nav><article><p>the same words on every single page</p></article>"
    out = main_text(spark.createDataFrame([(i, "http://h.example/", page) for i in range(4)], "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"the same words on every single page"}


def test_a_large_host_is_decided_whole(spark):
    """What two of a host's many pages share goes wherever these pages are; every token as one suffix array over the host has it."""
    from tessella.llm.html_extract import covered, main_text

    rnd = random.Random(8)
    streams = {tuple(rnd.randrange(40) for _ in range(rnd.randint(6, 24))) for _ in range(60)}
    streams = [[f"t{x}" for x in s] for s in sorted(streams)]
    for i in range(0, 40, 2):  # a run of six on two pages each
        streams[i] = streams[i] + [f"r{i}x{k}" for k in range(6)] + ["end"]
        streams[i + 1] = [f"r{i}x{k}" for k in range(6)] + streams[i + 1]
    rows = [(i, f"http://h.example/{i}", f"<p>{' '.join(s)}</p>") for i, s in enumerate(streams)]
    out = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **ANY_TWO).collect()}
    ids = {}
    marks = covered([np.array([ids.setdefault(w, len(ids)) for w in s]) for s in streams], 5)
    assert out == {i: " ".join(w for w, g in zip(s, m, strict=True) if not g) for i, (s, m) in enumerate(zip(streams, marks, strict=True))}
    assert all(f"r{i}x" not in out[i] + out[i + 1] for i in range(0, 40, 2))


#: Any run of five tokens on two pages.
ANY_TWO = {"share": 0.0, "fewest": 2}


def test_text_that_two_pages_share_is_no_template(spark):
    """Phrases on two pages, copies and near copies of a page without article stay; a template and a long notice on a part of the pages go."""
    from tessella.llm.html_extract import main_text

    own = lambda i, n=70: " ".join(f"own{i}x{k}" for k in range(n))
    menu, notice = "Home News Sport Weather Travel Money", " ".join(f"notice{k}" for k in range(30))
    phrase = "at the end of the day it was over"
    page = {i: [own(i)] for i in range(12)}
    page[0], page[1] = [f"{own(0)} {phrase} {own('z')}"], [f"{own(1)} {phrase}"]
    for i in (2, 3, 4):
        page[i].append(notice)
    page[20] = page[21] = [own("copy")]
    page[22], page[23] = [own("near") + " first"], [own("near") + " second"]
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div>" + "".join(f"<p>{t}</p>" for t in texts)) for i, texts in page.items()]
    rows += [(30, "http://two.example/a", f"<p>{own('q')}</p>"), (31, "http://two.example/b", f"<p>{own('q')}</p>")]
    out = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: "\n\n".join(t for t in texts if t != notice) for i, texts in page.items()}
    assert out == want | {30: own("q"), 31: own("q")}


def chats(n, rnd, marks):
    rows = []
    for c in range(n):
        for t in range(rnd.randint(2, 9)):
            role = "system" if t == 0 and c % 9 == 0 else ("user", "assistant")[(t - (c % 9 == 0)) % 2]
            text = "How is it with that?" if role == "user" else "You are a helper." if role == "system" else "It is so.\n" * rnd.randint(2, 5) + "Done."
            rows.append((c, t, role if marks(c, t) else None, text, role))
    return rows


def test_roles_are_recovered(spark):
    from tessella.llm.chat_format import format_chats

    rnd = random.Random(4)
    rows = chats(120, rnd, lambda c, t: rnd.random() < 0.6)
    out = format_chats(spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, role string, text string")).collect()
    truth = {(c, t): role for c, t, _, _, role in rows}
    assert len(out) == len(rows)
    assert np.mean([truth[r.conv_id, r.turn] == r.role for r in out]) > 0.97
    assert all(r.rendered.startswith(f"<|im_start|>{r.role}\n") and r.rendered.endswith("<|im_end|>\n") for r in out)


def test_a_transcript_in_one_row_is_cut_at_its_markers(spark):
    from tessella.llm.chat_format import format_chats

    text = "User: What is this?\nAssistant: A test.\nIt has lines.\n### Human: And now?\n<|assistant|> Nothing."
    known = [(1, t, r, "Why?" if r == "user" else "Because.\nSo.") for t, r in enumerate(["user", "assistant"] * 5)]
    out = format_chats(spark.createDataFrame([(0, 0, None, text), *known], "conv_id long, turn long, role string, text string")).where("conv_id = 0").orderBy("part_no").collect()
    assert [(r.role, r.n_lines) for r in out] == [("user", 1), ("assistant", 2), ("user", 1), ("assistant", 1)]
    assert out[1].rendered == "<|im_start|>assistant\nA test.\nIt has lines.<|im_end|>\n"


def test_cut_conversations_decode_as_whole_ones(spark):
    """Viterbi over partitions equals Viterbi in one piece."""
    from tessella.llm import chat_format as C

    rnd = random.Random(7)
    rows = [(0, t, None if rnd.random() < 0.7 else rnd.choice(C.ROLES), rnd.choice(["Yes?", "No.\nYes.", "", None, "x" * 200])) for t in range(300)]
    rows += [(None, 1, "odd", "a"), (5, None, "user", "b"), (5, None, "user", "b"), (6, 2, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = []
    for n in (1, 4, 9):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(str, C.format_chats(table).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1] == got[2] and len(got[0]) >= len(rows)


def plain_viterbi(model, rows):
    """rows: (role, text) of one conversation in order, to the best path's score and, for each line, its state: one table over all lines, no matrices."""
    from tessella.llm import chat_format as C

    lines = [(mark, seen, k == 0) for role, text in rows for k, (mark, seen, _) in enumerate(C.row_lines(role, text))]
    emit = lambda s, mark, seen: model.marks[s][mark] + model.looks[s][seen]
    table = [[(model.start[s] + emit(s, *lines[0][:2]), -1) for s in range(C.N_STATES)]]
    for mark, seen, new in lines[1:]:
        table.append([max((table[-1][a][0] + model.step[1 if new else 0][a][b] + emit(b, mark, seen), -a) for a in range(C.N_STATES)) for b in range(C.N_STATES)])
    state = max(range(C.N_STATES), key=lambda s: table[-1][s][0])
    best, path = table[-1][state][0], [state]
    for row in table[:0:-1]:
        state = -row[state][1]
        path.append(state)
    return best, path[::-1], lines


def test_query_against_plain_viterbi(spark, tmp_path):
    """The registered query on conversations with most roles masked: roles and turns are those of Viterbi over whole conversations."""
    from tessella.llm import chat_format as C
    from tessella.llm.queries import queries

    rnd = random.Random(14)
    rows = [r[:4] for r in chats(60, rnd, lambda c, t: rnd.random() < 0.5)]
    rows += [(100 + c, t, rnd.choice([None, None, "user", "bot"]), "\n".join(rnd.choice(["Why is it?", "User: so", "It is.", "- a list", "Bot: no", "", "word " * rnd.randint(1, 60)]) for _ in range(rnd.randint(1, 6)))) for c in range(25) for t in range(rnd.randint(1, 12))]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.write.parquet(f"file://{tmp_path}/conversations.parquet")
    model = C.fit(table.withColumnRenamed("conv_id", "cid"))
    got = {}
    for r in sorted(queries()["op1_chat_format"](spark, f"file://{tmp_path}").collect(), key=lambda r: (r.conv_id, r.turn, r.part_no)):
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.n_lines))
    for c in {r[0] for r in rows}:
        of = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        _, path, lines = plain_viterbi(model, [r[2:] for r in of])
        want, at = [], -1
        for state, (_, _, new) in zip(path, lines, strict=True):
            at += new
            if new or state % 2 == 0:
                want.append([of[at][1], C.ROLES[state // 2], 0])
            want[-1][2] += 1
        assert got[c] == [tuple(w) for w in want], c


def tile_oracle(doc, item, least):
    """Greedy string tiling by the book: all maximal matches, longest first."""
    fd, fi, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = []
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and fi[i + k] and fd[d + k]:
                    k += 1
                if k >= least:
                    best.append((-k, i, d))
        if not best:
            return out
        k, i, d = min(best)
        out.append((d, i, -k))
        for x in range(-k):
            fd[d + x] = fi[i + x] = False


def test_tiles():
    from tessella.llm.decontaminate import tiles

    rnd = random.Random(3)
    for _ in range(200):
        doc = [rnd.randrange(3) for _ in range(rnd.randint(0, 25))]
        item = [rnd.randrange(3) for _ in range(rnd.randint(0, 18))]
        least = rnd.choice([1, 2, 3])
        for most in (1_000_000, 0):
            assert tiles(np.array(doc, np.uint64), np.array(item, np.uint64), least, most) == tile_oracle(doc, item, least)


def test_tiles_of_repetitive_texts_stay_small():
    """The seeds of these texts have 50 million equal pairs; memory goes with the texts."""
    import tracemalloc

    from tessella.llm.common import splitmix
    from tessella.llm.decontaminate import tiles

    doc, item = splitmix(np.arange(50_000, dtype=np.uint64) % np.uint64(3)), splitmix(np.arange(1, 1001, dtype=np.uint64) % np.uint64(3))
    doc[::701] = 5
    tracemalloc.start()
    found = tiles(doc, item, 5)
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()
    assert sum(t[2] for t in found) > 990 and max(t[2] for t in found) == 700


def test_decontamination_finds_reordered_passages(spark):
    from tessella.llm.decontaminate import contaminated_pairs

    item = [f"Q{i}" for i in range(30)]
    moved = item[20:] + ["and"] + item[10:20] + ["then"] + item[:10]
    rows = [(1, "before " + " ".join(item).upper() + " after"), (2, " ".join(moved)), (3, " ".join(item[:12])), (4, " ".join(item[::-1])), (5, None), (6, ""), (7, "tiny one"), (None, " ".join(item))]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, item_id long, did string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "Tiny one"), (2, None), (3, ""), (None, "odd null id item of words")], "item_id long, text string")
    for size in (1 << 20, 10):
        got = {(r.doc_id, r.item_id): (r.n_tiles, r.coverage) for r in contaminated_pairs(docs, bench, block_bytes=size).collect()}
        assert set(got) == {(1, 0), (2, 0), (7, 1), (None, 0)}
        assert got[2, 0] == (3, 1.0)
