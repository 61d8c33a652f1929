"""Token counts, chat formatting, decontamination, HTML, packing against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, html, packing, tokencount, wordbpe
from tessera.llm.common import materialize
from tessera.llm.words import mix

from .fixtures import DOCS, empty, frame


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    plain, literal = Tokenizer.from_file(wordbpe.default_path()), Tokenizer.from_file(wordbpe.default_path())
    literal.encode_special_tokens = True
    return {False: lambda t: plain.encode(t or "", add_special_tokens=False).ids, True: lambda t: literal.encode(t or "", add_special_tokens=False).ids}


ODD = ["İstanbul ẞ Σίσυφος ΟΔΟΣ", "é café ́x", "a\x1cb\x1d c", "x​y  z\u0085w", "it's we'll I'd O'Neil's ''s", "1²³½ ٣ 一二", "a_b-c…—d", "﻿bom", "ﬁ ǆ ß"]


@pytest.mark.parametrize("special", [False, True])
def test_cached_ids_equal_the_librarys(ids_of, special):
    bpe = wordbpe.load(wordbpe.default_path(), special)
    rnd = random.Random(2)
    texts = [t for _, t, _ in DOCS] + ODD + ["".join(rnd.choice("aZé9 .,<|>'\n 中") for _ in range(60)) for _ in range(300)] + ["<|endoftext|> a<|endoftext|>b"]
    for t in texts:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == ids_of[special](t), repr(t)


def test_cache_empties_itself(monkeypatch):
    monkeypatch.setattr(wordbpe, "CACHE_ENTRIES", 3)
    bpe = wordbpe.WordBpe(wordbpe.default_path())
    whole = [bpe.encode(f"w{k} ab{k} c.") for k in range(20)]
    assert whole == [bpe.encode(f"w{k} ab{k} c.") for k in range(20)]


def test_token_counts(spark, ids_of, monkeypatch):
    monkeypatch.setattr(tokencount, "SPAN_BLOCKS", 3)
    got = tokencount.token_counts(frame(spark), wordbpe.default_path(), block_tokens=50).collect()
    want = sorted(((i, len(ids_of[True](t))) for i, t, _ in DOCS), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == want
    assert tokencount.token_counts(empty(spark), wordbpe.default_path()).collect() == []


def test_raw_flat_files(spark, tmp_path):
    rnd = np.random.default_rng(0)
    for k, n in enumerate((0, 1, 10, 1000)):
        rnd.integers(0, 6, n).astype("<u2").tofile(tmp_path / f"f{k}.bin")
    blocks = tokencount.flat_blocks(spark, f"file://{tmp_path}/*.bin", block_tokens=7)
    got = tokencount.documents(materialize(tokencount.scan(blocks, separator=5), "t"))
    names = {r["file"]: r["path"] for r in blocks.select("file", "path").distinct().collect()}
    found = {(names[r["file"]][-6:], r["doc_no"]): (r["start"], r["n_tokens"]) for r in got.collect()}
    want = {}
    for k in range(4):
        at, no, toks = 0, 0, np.fromfile(tmp_path / f"f{k}.bin", "<u2").tolist()
        for p, t in enumerate(toks):
            if t == 5:
                want[(f"f{k}.bin", no)] = (at, p - at)
                at, no = p + 1, no + 1
        if at < len(toks):
            want[(f"f{k}.bin", no)] = (at, len(toks) - at)
    assert found == want
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="partial token"):
        tokencount.flat_blocks(spark, f"file://{tmp_path}/odd.bin").collect()


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|> <\\|x <\\\\| \\n"), (1, 2, "assistant", "<|im_start|>user\nno"), (1, 3, "user", "a"),
    (1, 4, "assistant", "b\n\n"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 5, None, "x"), (3, None, "odd\nrole\\n\\", "first"),
    (None, 0, "assistant", "nobody"), (4, 0, "user", "only"), (5, 1, "assistant", "tie"), (5, 1, "assistant", "tie"), (6, 0, "assistant", "z" * 50_000),
]


def test_chat_reads_back_what_went_in(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "'clash' as no", "'clash' as part", "'clash' as at", "'clash' as examples", "'clash' as formatted")
    chats = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_back(chats).collect()}
    by: dict = {}
    for c, t, r, x in TURNS:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        told = "".join(f"{r}\n{x}\n" for r, x in turns)
        g = got[c]
        assert (g["n_turns"], g["loss_chars"]) == (len(turns), len(loss))
        assert g["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest() and g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    text = {r["conv_id"]: r["formatted"] for r in chats.collect()}
    assert all(g["formatted_chars"] == len(text[c]) for c, g in got.items())
    ex = sorted((r for r in chat.expand(chats).collect() if r["conv_id"] == 1), key=lambda r: r["turn_no"])
    assert [r["turn_no"] for r in ex] == [3, 5] and ex[1]["reply"] == "b\n\n" and ex[1]["context"].endswith("<|im_start|>assistant\n")
    assert text[1].startswith(ex[0]["context"] + ex[0]["reply"]) and text[1].startswith(ex[1]["context"])
    assert chat.read_back(chat.format_chats(df.limit(0))).collect() == []


def test_chat_is_read_back_from_written_out_examples(spark, monkeypatch):
    chats = chat.format_chats(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))
    by: dict = {}
    for r in chat.prefixes(chats).collect():
        by.setdefault(r["conv_id"], []).append(r)
    whole = {r["conv_id"]: r for r in chats.collect()}
    assert set(by) == set(whole)
    for c, rows in by.items():
        rows.sort(key=lambda r: r["turn_no"])
        text, spans = whole[c]["formatted"], whole[c]["examples"]
        assert [(r["context"], r["reply"]) for r in rows] == [(text[: e["start"]], text[e["start"] : e["end"]]) for e in spans] + [(text, None)]
        assert [r["seen"] for r in rows] == [0, *[e["end"] for e in spans]]
    plain, good = chat.prefixes, {r["conv_id"]: r for r in chat.read_back(chats).collect()}
    spoilt = F.when(F.col("turn_no") == 3, F.replace("context", F.lit("kind"), F.lit("mean"))).otherwise(F.col("context"))
    monkeypatch.setattr(chat, "prefixes", lambda d: plain(d).withColumn("context", spoilt))
    bad = {r["conv_id"]: r for r in chat.read_back(chats).collect()}
    assert {c for c in good if good[c] != bad[c]} == {1}  # an example's own context is what is read


def test_chat_query_equals_its_sql(spark, sf):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = duckdb.sql(chat.OP2_SQL)
    got = chat.op2_chat_formatting(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def _gst(a, b, least):
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and fa[i + k] and fb[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(fa[i : i + best]) and all(fb[j : j + best]):
                fa[i : i + best] = fb[j : j + best] = [False] * best
                out.append((i, j, best))


def test_tiles_equal_plain_greedy_tiling():
    rnd = random.Random(1)
    h = lambda s: mix(np.array(s, np.uint64) + np.uint64(1))
    for _ in range(150):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(n))] for n in (40, 25))
        assert sorted(decontaminate.tiles(h(a), h(b), 3)) == sorted(_gst(a, b, 3))


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), (2, "tiny item here"), (3, None), (4, ""),
    (None, "no id at all in this benchmark item"), (5, "..."),
]
LEAKY = [
    (1, "before ONE two, three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen after"),
    (2, "nine ten eleven twelve thirteen fourteen fifteen sixteen and one two three four five six seven eight"),  # reordered
    (3, "one two three four five six and nothing else of it"), (4, "a TINY item here!"), (5, None), (6, ""), (None, ITEMS[0][1]), (7, ITEMS[0][1]), (7, ITEMS[0][1]),
    (8, "one two three four five x six seven eight nine y ten"), (9, "clean text of its own with many words in it"),
]


def test_decontamination(spark, monkeypatch):
    docs = spark.createDataFrame(LEAKY, "doc_id long, text string").selectExpr("*", "'clash' as item_id", "'clash' as coverage")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as doc_id")
    want = sorted([(1, 1), (2, 1), (4, 2), (None, 1), (7, 1), (7, 1)], key=repr)
    for words in (2_000_000, 4):  # one block; a block an item
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        got = decontaminate.leaks(docs, bench).collect()
        assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=repr) == want
        kept = decontaminate.clean(docs, bench)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 8, 9]
    assert decontaminate.leaks(docs.limit(0), bench).collect() == [] and decontaminate.leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(LEAKY)
    long = "word " * 200_000 + ITEMS[0][1]
    block = decontaminate.Block([(1, decontaminate.words(ITEMS[0][1])), (2, decontaminate.words("word " * 3000))])
    assert [h[0] for h in block.held(long)] == [1, 2]


def test_decontamination_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, ITEMS[4][1]), (None, "another item that has no id either"), (9, ITEMS[0][1])], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {ITEMS[4][1]} y"), (2, f"{ITEMS[0][1]} {ITEMS[4][1]}"), (3, "clean words only")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, None), (2, None), (2, 9)}
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [3]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href=/x>x</a></li></ul></nav><div class="ad banner">Buy &lt;now&gt;</div>
<article><h1>Head &amp; shoulders</h1><p>First  para
with <b>bold</b>text &eacute;&#233;&nbsp;end.<p>Second<br>line<ul><li>item</li></ul><aside>side</aside><!-- gone --><form>f<input></form>
<noscript>ns</noscript><div class="share">share me</div></article><section id="comments"><p>reader says the thing that was on the page</p></section>
<footer>&copy; me</footer></body></html>"""


def test_html_main_text():
    assert html.main_text(PAGE) == "Head & shoulders\nFirst para with boldtext éé end.\nSecond line\nitem"
    plain = "<div><p>The cat sat on the mat and it was in the house with all of them for a day.</p><p>Yes.</p><div><a href=x>a b c d e f g</a></div></div>"
    assert html.main_text(plain) == "The cat sat on the mat and it was in the house with all of them for a day.\nYes."
    for odd, want in [
        (None, ""), ("", ""), ("<", "<"), ("a < b", "a < b"), ("<p>x<br><br>y", "x\ny"), ("<!-- open", ""), ("<script>open", ""), ("<p class='x>y", "y"), ("<a", ""),
    ]:
        assert html.main_text(odd) == want, odd


def test_html_article_is_a_prior():
    text = "The cat sat on the mat and it was in the house with all of them for a day. " * 4
    said = "I was there and it is not true that the cat was in the house on that day."
    teaser = f"<div><h2>Head</h2><p>{text}</p><p>Yes.</p></div><article><a href=x>More of this</a></article>"
    assert html.main_text(teaser).startswith("Head\n" + text.strip() + "\nYes.")
    for attrs in ('class="comment"', 'id="comment-7"', "hidden", 'role="complementary"'):
        assert html.main_text(f"<article><p>{text}</p></article><article {attrs}><p>{said}</p></article>") == text.strip(), attrs
    assert html.main_text(f'<article class="post has-comments"><p>{text}</p></article>') == text.strip()
    assert html.main_text(f"<p>Site of cats</p><article><p>{text}</p></article><p>All rights reserved</p>") == text.strip()


TEXT = "The cat sat on the mat and it was in the house with all of them for a day. "


@pytest.mark.parametrize(
    "inside, want",
    [
        ('<p class="advertisement">Buy this now and be glad of it for the rest of all the days.</p><p>Yes.</p>', "Yes."),
        ("<p hidden>It is not to be seen by any of the readers of this.</p>Yes.", "Yes."),
        ('<div class="share-price"><p>The price of the share was up.</p></div>', "The price of the share was up."),
        ('<section id="related-work"><p>It was in the work of others.</p></section>', "It was in the work of others."),
        ('<div class="ad-hoc">So it is.</div>', "So it is."),
        ('<div class="ad-slot">So it is.</div><div class="cookie_notice">Yes.</div><div class="comment-list"><p>No.</p></div>', ""),
        ('<span class="ad">Buy</span> it', "it"),
        ("<h2>References</h2><ul><li><a href=a>Smith 1999</a><li><a href=b>Jones 2001</a><li><a href=c>Miller</a></ul>", "References\nSmith 1999\nJones 2001\nMiller"),
        ("<ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Sport</a></ul><p>Yes.</p>", "Yes."),
        ('<ul><li class="promo">Buy<li>one<li>two</ul>', "one\ntwo"),
        ('<p hidden>a<p>b<ul hidden><li>c<p>d</ul>e', "b\ne"),
    ],
)
def test_html_names_are_whole_words_on_any_element(inside, want):
    prose = f"<p>{TEXT * 4}</p>"
    assert html.main_text(f"<article>{prose}{inside}</article>") == "\n".join(x for x in ((TEXT * 4).strip(), want) if x)


def test_html_without_article():
    for note in ("<p>We use cookies.</p>", "<p>Latest news</p>", "<p>Copyright 2020</p>", "<h3>Latest news</h3>"):
        for page in (f"<div>{note}<h1>A cat</h1><p>{TEXT * 4}</p><p>Yes.</p>", f"<div><h1>A cat</h1><p>{TEXT * 4}</p><p>Yes.</p>{note}"):
            got = html.main_text(page)
            assert got == f"A cat\n{TEXT * 4}".strip() + "\nYes." or "<h3>" in note and page.startswith("<div><h3>"), page


def _naive_classify(found):
    """Pass two by looking at every other block."""
    marks = html.first_pass(found)
    has_article, out = any(b.in_article for b in found), []
    for k, b in enumerate(found):
        label = marks[k][0]
        if label == html.OPEN:
            told = [(abs(j - k), j, m) for j, (m, _) in enumerate(marks) if found[j].in_article == b.in_article and (m == html.GOOD or m == html.BAD and not b.in_article)]
            left, right = min((x for x in told if x[1] < k), default=None), min((x for x in told if x[1] > k), default=None)
            labels = [x and x[2] for x in (left, right)]
            content = any(m == html.GOOD and found[j].in_article == b.in_article for j, (m, _) in enumerate(marks))
            edge = content and not b.in_article and b.words < 8 and not b.listed and b.text[-1] not in ".!?:;"
            if not told:
                label = html.GOOD if b.in_article or not has_article else html.BAD
            elif b.heading and not b.in_article:
                label = right[2] if right else html.BAD
            elif edge and (html.BAD in labels or None in labels):
                label = html.BAD
            elif not left or not right:
                label = (left or right)[2]
            elif b.heading:
                label = right[2]
            else:
                label = left[2] if left[0] <= right[0] else right[2]
        out.append(label == html.GOOD)
    return out


def test_html_passes_equal_plain_rules():
    rnd = random.Random(11)
    for _ in range(3000):
        found = []
        for _ in range(rnd.randrange(12)):
            words = rnd.choice([1, 3, 9, 60])
            text = " ".join(["x"] * words) + rnd.choice([".", ""])
            found.append(html.Block(text, words, rnd.randrange(words + 1), rnd.choice([0, 0, len(text)]), rnd.random() < 0.3, rnd.random() < 0.2, rnd.random() < 0.3, rnd.random() < 0.1))
        assert [g for g, _ in html.classify(found)] == _naive_classify(found), found


def test_html_rules_stand_without_names(sf):
    """With article, nav, footer and all classes taken away, the passes find nearly the same text."""
    import re

    import pyarrow.parquet as pq

    hit = wrong = missed = 0
    for page in pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist():
        want = set(html.main_text(page).split("\n"))
        bare = re.sub(r"<(/?)(nav|footer|article|main)>", r"<\1div>", re.sub(r' class="[^"]*"', "", page))
        got = html.main_text(bare).split("\n")
        hit, wrong, missed = hit + sum(x in want for x in got), wrong + sum(x not in want for x in got), missed + len(want - set(got))
    assert hit / (hit + wrong) > 0.9 and hit / (hit + missed) > 0.88, (hit, wrong, missed)


def test_html_long_pages():
    got = html.main_text("<article>" + f"<p>{TEXT}</p>" * 30_000 + "</article>")
    assert got == "\n".join([TEXT.strip()] * 30_000)
    assert html.main_text("<section>" * 50_000 + "x" + "</div>" * 50_000) == "x"


@pytest.mark.parametrize("piece", ["<", "<p", "<!--", "<script>", "<p \"", "<div>", "</div>", "&amp", "<a href='", "<select>", "<b>x</b> ", "<p hidden>", "<b class=ad>", "<li class=ad>x", "</section><div>", "<ul><li><a>x"])
def test_html_is_linear(piece):
    import time

    began = time.time()
    html.main_text(piece * 20_000)
    assert time.time() - began < 10


def test_html_query(spark, sf):
    pages = spark.createDataFrame([(1, "u", PAGE), (None, None, None), (2, "v", ""), (1, "u", PAGE)], "page_id long, url string, html string").selectExpr("*", "'c' as text")
    got = sorted(((r["page_id"], r["url"], r["n_chars"]) for r in html.extract(pages).collect()), key=repr)
    n = len(html.main_text(PAGE))
    assert got == sorted([(1, "u", n), (None, None, 0), (2, "v", 0), (1, "u", n)], key=repr)
    assert html.extract(pages.limit(0)).collect() == []
    assert html.op4_html_extraction(spark, sf).where("n_chars > 0").count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def _check_packing(rows, want, capacity):
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [4096, 16, 3])
def test_packing(spark, ids_of, capacity):
    want: dict = {}
    for i, t, _ in DOCS:
        ids = ids_of[False](t) + [1]
        for k in range(0, len(ids), capacity):
            own = ids[k : k + capacity]
            want.setdefault((i, k // capacity), []).append((k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    rows = packing.pack(frame(spark), wordbpe.default_path(), capacity).collect()
    n = _check_packing(rows, want, capacity)
    total = sum(x[1] for v in want.values() for x in v)
    assert n <= -(-total // capacity) + 2  # few pieces: the bound itself need not be reachable
    assert packing.pack(empty(spark), wordbpe.default_path()).collect() == []


def test_plan_groups_hold_all_pieces():
    rnd = random.Random(4)
    for trial in range(30):
        capacity = rnd.choice([1, 2, 7, 64, 300])
        counts = {x: rnd.choice([1, 2, 50, 100_000]) for x in rnd.sample(range(1, capacity + 1), rnd.randrange(1, capacity + 1))}
        groups = packing.plan_groups(counts, capacity)
        held: dict[int, int] = {}
        for times, lengths in groups:
            assert times > 0 and sum(lengths) <= capacity
            for x in lengths:
                held[x] = held.get(x, 0) + times
        assert held == counts
        assert len(groups) <= 4 * capacity + 4


def test_plan_is_no_worse_than_best_fit():
    counts = {k: 5 for k in range(1, 4097)}
    n = sum(t for t, _ in packing.plan_groups(counts))
    assert n <= sum(t for t, _ in packing.best_fit(sorted(counts.items(), reverse=True), 4096)) and n >= -(-sum(k * c for k, c in counts.items()) // 4096)


def test_exact_fills_come_first():
    assert sorted(packing.plan_groups({6: 2, 4: 2, 5: 2}, 10)) == [(1, [5, 5]), (2, [6, 4])]
    assert packing.plan_groups({7: 1, 2: 1, 1: 1}, 10) == [(1, [7, 2, 1])]
    assert packing.plan_groups({5: 1, 1: 1, 2: 2}, 10) == [(1, [5, 2, 2, 1])]
