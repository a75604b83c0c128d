"""Page and conversation operators against plain recomputation."""

import base64
import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from auditgrove.llm import chat, html_diff, url_rules, warc
from auditgrove.llm.components import connected_components
from auditgrove.llm.shared import Scratch

PAGES = "page_id long, url string, html string"
ARTICLE = "<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">Buy</div><article><h1>Tom &amp; Jo</h1><p><b>One<br>two\n three<p>Four</p><div class='comments'><p>nice</p></div></article><footer>&copy; me</footer>"


def test_article_text(spark):
    pages = spark.createDataFrame([(1, "http://h/a/1", ARTICLE), (2, "http://h/a/2", None), (3, None, ""), (4, "http://h/a/1", ARTICLE), (5, "x", "<p>" + "word " * 20000)], PAGES).withColumn("path", F.lit("clash"))
    got = {r["page_id"]: r for r in html_diff.extract(pages).collect()}
    assert got[1]["text"] == got[4]["text"] == "Tom & Jo\n\nOne two three\n\nFour"
    assert got[2]["text"] == got[3]["text"] == "" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[5]["n_chars"] == 5 * 20000 - 1


@pytest.mark.parametrize("html,text", [
    ("<article><p>main</p></article><aside><article>Teaser</article></aside>", "main"),
    ("<article><p>main</p></article><footer><article>small print</article></footer>", "main"),
    ('<article><p>main</p></article><section class="comments"><article>nice post</article></section>', "main"),
    ('<article><p>main</p></article><ol id="comments"><li><article id="c1">me too</article></li></ol>', "main"),
    ('<body class="right-sidebar"><article><p>main</p></article></body>', "main"),
    ('<div class="header-wrap"><main><p>main</p></main></div><p hidden>gone</p><div style="display: none">gone</div><p aria-hidden="true">gone</p>', "main"),
    ('<article><p>main</p><p class="hidden-gem">stays</p><p hidden>gone</p></article>', "main\n\nstays"),
])
def test_chrome_stays_chrome(html, text):
    lines = html_diff.text_lines(html)
    kept = [t for t, z in lines if z == html_diff.CONTENT] or [t for t, z in lines if z == html_diff.PLAIN]
    assert "\n\n".join(kept) == text


def brute_texts(rows):
    """Texts by the definition: in order of host, path and id, the nearest of the neighbours with other lines, and what it does not share."""
    from html import unescape
    from urllib.parse import urlsplit

    pages = sorted((urlsplit(u).netloc, urlsplit(u).path, i, [unescape(x) for x in re.findall("<div>(.*?)</div>", h)]) for i, u, h in rows)
    out = {}
    for k, (host, path, i, lines) in enumerate(pages):
        near = [next((p for p in side if p[0] != host or p[3] != lines), None) for side in (pages[:k][::-1], pages[k + 1 :])]
        near = [p for p in near if p and p[0] == host]
        other = max(near, key=lambda p: html_diff.nearness(p[1], path)) if near else None
        shared = html_diff.shared_lines(lines, other[3]) if other else set()
        out[i] = ("\n\n".join(x for j, x in enumerate(lines) if j not in shared), other and other[2])
    return out


@pytest.mark.parametrize("partitions", [1, 8, 60])
def test_pairing_does_not_depend_on_partitions(spark, partitions):
    import random

    rng = random.Random(4)
    page = "<body><div>Site {h}</div><div>Own {k}</div><div>Terms &amp; more</div></body>"
    rows = [(i, f"http://h{i % 3}/{rng.choice('ab')}/{rng.randrange(9)}", page.format(h=i % 3, k=rng.randrange(6))) for i in range(60)]
    rows += [(100 + i, "http://copies/x", page.format(h=9, k=9)) for i in range(40)] + [(200, "http://copies/y", page.format(h=9, k=8)), (300, "http://alone/x", page.format(h=7, k=7))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["page_id"]: (r["text"], r["partner"]) for r in html_diff.extract(spark.createDataFrame(rows, PAGES)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_texts(rows)
    assert got[100] == got[139] == ("Own 9", 200) and got[200] == ("Own 8", 139) and got[300][0].startswith("Site 7")


def test_rows_of_one_id_keep_their_own_texts(spark):
    page = "<body><div>Site</div><div>{}</div></body>"
    rows = [(1, "http://h/a", page.format("one")), (1, "http://h/a", page.format("two")), (1, "http://h/a", page.format("two")), (None, None, page.format("three")), (None, None, None), (2, "http://h/b", "<main>" + page.format("Site") + "</main>")]
    got = sorted((r["text"], r["n_lines"]) for r in html_diff.extract(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [("", 0), ("Site\n\nSite", 2), ("Site\n\nthree", 2), ("one", 2), ("two", 2), ("two", 2)]


def test_no_pages(spark):
    assert html_diff.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_long_and_broken_markup_takes_one_pass():
    began = time.time()
    assert html_diff.text_lines("<a " * 1_700_000) == [(" ".join(["<a"] * 1_700_000), html_diff.PLAIN)]
    assert len(html_diff.shared_lines(["x"] * 50_000, ["x"] * 50_000)) == 50_000
    assert len(html_diff.shared_lines(["y"] + ["x", "z"] * 15_000, ["x"] * 30_000 + ["w"])) == 15_000
    assert html_diff.text_lines("<a title='x > y'>one</a><p \"odd>two<!-- gone") == [("one", 1), ("two", 1)]
    assert time.time() - began < 20


def test_headline_and_body_classes_stay_in_an_article():
    html = '<article><div class="entry-header"><h1>Title</h1></div><p>Body</p><p class="related work">rel</p><div class="comments"><p>c</p></div><div id="share">s</div></article>'
    assert [t for t, z in html_diff.text_lines(html) if z == html_diff.CONTENT] == ["Title", "Body", "rel"]


def test_longest_common_subsequence():
    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    import random

    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        got = html_diff.shared_lines(a, b)
        assert len(got) == brute(a, b)
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in sorted(got)))


def test_url_verdicts(spark):
    rows = [
        (1, "http://spam.org/a", '<link rel="canonical" href="https://b.example.com/en/x">'), (2, "https://x.org/b#f", '<META http-equiv=refresh content="0; url=//spam.org/a">'),
        (3, "http://WWW.example.com/en/ok?q", "<link href='http://spam.org/a' rel=canonical>"), (4, None, None), (5, "nohost", ""), (6, "http://other.org", ""), (7, "http://net/es/", ""),
        (8, "http://a.com:80/", ""), (9, "http://z.org/1", ""),
    ]
    moved = spark.createDataFrame([("http://z.org/1", "http://s.net/fr/2"), (None, "http://q.org")], "source string, target string")
    got = {r["page_id"]: r for r in url_rules.judge_pages(spark.createDataFrame(rows, PAGES), moved).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "block"}
    assert got[3]["rule"] == "www.example.com/en/" and got[3]["host"] == "www.example.com" and got[7]["rule"] == "net/es/"
    assert got[8]["rule"] is None and got[4]["host"] == got[4]["path"] == ""
    assert url_rules.judge_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_connected_components(spark):
    import random

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(500, 500 + i) for i in range(40)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}


def test_warc_round_trip(spark):
    rows = [(1, "http://a/é\r\nx", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://d", ""), (5, "http://e", "own " * 30000), (2, "http://b", "same")]
    for least in (0, 5):
        root = Scratch(spark, "warc").path("archive")
        warc.write_archive(spark.createDataFrame(rows, PAGES).withColumn("sha256", F.lit("clash")), root, least)
        got = {r["page_id"]: r for r in warc.read_index(spark, root).collect()}
        assert warc.read_index(spark, root).count() == len(rows)
        for page, url, html in rows:
            body = (html or "").encode()
            owner = max(p for p, _, h in rows if (h or "") == (html or ""))
            response = len(body) < least or owner == page
            r = got[page]
            assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["url"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else owner, url or "")
        records = {r["page_id"]: bytes(r["record"]) for r in warc.reconstruct(spark, root).collect()}
        assert all(b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in r and b"\r\nWARC-Target-URI: http" in r or k == 3 for k, r in records.items())
        assert records[5].endswith(b"own " * 30000 + b"\r\n\r\n") and records[5].startswith(b"WARC/1.1\r\n")
        assert {(r["page_id"], bytes(r["payload"])) for r in warc.original_payloads(spark, root).collect()} == {(p, (h or "").encode()) for p, _, h in rows}
    empty = Scratch(spark, "warc").path("archive")
    warc.write_archive(spark.createDataFrame([], PAGES), empty)
    assert warc.read_index(spark, empty).count() == 0


def test_chat_windows(spark):
    odd = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\nhi", "back\\slash\\<|", "", None, "<<SYS>> x <</SYS>>\\", "w " * 3000]
    rows = [(1, 0, "system", "be kind")] + [(1, i + 1, "user" if i % 2 == 0 else "assistant", odd[i % len(odd)]) for i in range(60)]
    rows += [(2, 5, None, "x"), (2, 5, "assistant", "tie"), (2, 5, "assistant", "tie"), (None, 0, "a\nb", "null conversation")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = Scratch(spark, "chat").keep(chat.format_windows(turns, budget=40, history=15), "w")
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    for conv in (1, 2, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, r, x in own if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(own), digest, len(said), hashlib.sha256(said.encode()).hexdigest())
    for w in windows.where("conv_id = 1").collect():
        parsed, _ = chat.parse_window(w["text"], w["loss_starts"], w["loss_ends"])
        assert parsed[0] == ("system", "be kind")
        assert sum(chat.turn_tokens(*t) for t in parsed) <= 40 or len(parsed) - w["n_repeated"] == 1
    assert chat.read_back(chat.format_windows(turns.limit(0))).count() == 0


def test_a_long_turn_is_read_in_slices():
    text = "a\\<|b <x " * 300_000
    piece, lo, hi = chat.format_turn("user", text)
    assert chat.parse_window(piece + chat.format_turn("as\nis\\", "")[0], [lo], [hi]) == ([("user", text), ("as\nis\\", "")], [text])
    assert chat.turn_tokens("user", text) == len(text.split()) + 4
    assert all(chat.turn_tokens("", "x" * n + " y") == (1 if not n else 2) + 4 for n in (0, 1, chat.COUNTED - 1, chat.COUNTED, chat.COUNTED + 1))


def test_links_as_they_are_written(spark):
    rows = [(1, "http://a.org/d/x", '<link rel="alternate canonical" href="y?p=1&amp;q=2">'), (2, "http://a.org/d/y?p=1&q=2", '<link rel=canonical href="http://s.net/fr/1">'), (3, "http://b.org", "<link rel=canonical href='mailto:x'>")]
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_escape_is_reversible():
    for text in ["\\", "\\\\<|", "<|<|", "<\\|", "[INST][/INST]", "a\\n\n"]:
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text) and "[INST]" not in chat.escape(text)
