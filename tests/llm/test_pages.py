"""HTML extraction and WARC archives."""

import collections
import html as entities
import re

import pytest

from packetloom.llm.warc import digest, read_archives, warc_round_trip, with_revisits, write_archives
from packetloom.llm.wrappers import expression, extract, fold, generalise, host_wrappers, main_texts, merge, parse, region

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x = "</p><p>no";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a>Home</a><li>News</ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><article><h1>A &amp; B</h1><p>One <b>two</b>
 three&nbsp;four<p>five &lt; six<br>seven<ul><li>x<li>y</ul><aside>see also</aside><form>mail me<input name=a></form>
<section id="comments"><article class="comment"><p>first!</p></article></section></article><aside>side</aside><footer>&copy; me</footer>"""


def test_article_without_the_rest():
    assert extract(PAGE, None) == "A & B\nOne two three four\nfive < six seven\nx\ny"


@pytest.mark.parametrize("page", ["", "plain text", "<", "<p", "<<p>>a", "a < b > c", "<p>x" * 500, "<!-- open", "<script>open", "<p class='a>b</p>", "</div></p>", "<div>" * 2000 + "x"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(extract(page, None), str)


def test_repeats_optionals_and_slots_become_one_expression():
    one = generalise(parse("<div><h2>A</h2><p>a</p><p>b</p><table><tr><td>1<td>2<tr><td>3</table></div>"))
    two = generalise(parse("<div><h2>A</h2><p>c</p><p>d</p><p>e</p><hr><blockquote>q</blockquote></div>"))
    assert expression(merge(one, two)) == "(#page (div (h2 'text') (p #)+ (table (tr (td #)+)+)? (blockquote 'text')?))"
    assert merge(one, one)[2][0][0] == "div"
    pairs = generalise(parse("<dl>" + "<dt>k<dd>v" * 5 + "</dl>"))
    assert expression(pairs) == "(#page (dl (dt 'text')+ (dd 'text')+))"
    assert fold([]) == []


def test_merging_is_the_same_in_any_grouping():
    pages = [generalise(parse(f"<div><h1>T{i}</h1>{'<p>x' * (i % 4)}{'<ul><li>a</ul>' * (i % 2)}</div>")) for i in range(8)]
    left = pages[0]
    for p in pages[1:]:
        left = merge(left, p)
    halves = [merge(merge(pages[i], pages[i + 1]), merge(pages[i + 2], pages[i + 3])) for i in (0, 4)]
    assert expression(merge(*halves)) == expression(left)


def test_without_article_the_changing_region_wins_and_template_goes():
    body = "<div id=top>Welcome to the site</div><div class=wrap><div class=left>Archive of all years</div><div class=text><p>Read this first</p>{}</div></div>"
    pages = [body.format("".join(f"<p>story {i} part {j} " + "word " * 20 + "</p>" for j in range(3))) for i in range(7)]
    wrapper = None
    for p in pages:
        new = generalise(parse(p))
        wrapper = new if wrapper is None else merge(wrapper, new)
    where = region(wrapper)
    assert where["path"][-1] == "div.text"
    text = extract(pages[3], where)
    assert "story 3 part 2" in text and "Archive" not in text and "Welcome" not in text


def test_pages_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "no url", PAGE), (-3, "http://h/", ""), (-4, "http://h/x", "<p>é 日本</p>")], "page_id long, url string, html string")
    both = pages.unionByName(odd).selectExpr("*", "'x' AS text", "1 AS host")
    got = {r.page_id: r for r in main_texts(both).collect()}
    assert len(got) == both.count()
    assert [got[-1].text, got[-2].text[:5], got[-3].text, got[-4].text, got[-4].n_chars] == ["", "A & B", "", "é 日本", 4]
    for r in pages.collect():
        body = re.sub(r"<br>", " ", re.sub(r"</?(?:h1|p)>", "\n", re.search("<article>(.*?)</article>", r.html, re.S)[1]))
        lines = [" ".join(entities.unescape(x).split()) for x in re.sub("<[^>]*>", "", body).split("\n")]
        assert got[r.page_id].text == "\n".join(x for x in lines if x) and got[r.page_id].url == r.url
    assert main_texts(pages.limit(0)).collect() == []


def test_a_host_has_one_wrapper(spark):
    rows = [(f"h{i % 3}", f"<div><p>{i}</p></div>") for i in range(300)]
    got = host_wrappers(spark.createDataFrame(rows, "host string, html string").repartition(6)).collect()
    assert sorted(r.host for r in got) == ["h0", "h1", "h2"]


# --- WARC ----------------------------------------------------------------------------------------

def expected(rows, least=0):
    groups = collections.defaultdict(list)
    for page, html in rows:
        groups[(html or "").encode()].append(page)
    return {p: (len(k), digest(k), *(("revisit", max(v)) if p != max(v) and len(k) >= least else ("response", None))) for k, v in groups.items() for p in v}


def found(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


@pytest.mark.parametrize("range_bytes", [64, 1_000, 1 << 20])
def test_archives_come_back_whole(spark, range_bytes):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, None, None), (4, "u", ""), (5, "x\r\ny", "\x1f\x8b\x08" * 400), (6, "z", "WARC/1.1\r\n\r\n"), (7, "é", "é𝔘" * 50_000)]
    rows += [(10 + i, "u", f"page {i % 40} " * (i % 7 * 30)) for i in range(200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    assert found(warc_round_trip(df, range_bytes=range_bytes)) == expected([(a, c) for a, _, c in rows])


def test_payloads_are_kept_and_small_ones_repeated(spark, tmp_path):
    rows = [(i, "u", "same" if i % 2 else "a longer payload") for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = write_archives(with_revisits(pages, least_bytes=8), str(tmp_path / "warc"), file_bytes=200)
    read = read_archives(spark, manifest, 50)
    assert found(read) == expected([(a, c) for a, _, c in rows], least=8)
    assert {bytes(r.payload) for r in read.where("record_type = 'response'").collect()} == {b"same", b"a longer payload"}
    assert manifest.count() > 1


def test_no_pages_no_records(spark):
    assert warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
