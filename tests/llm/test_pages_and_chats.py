import duckdb
import pytest

from scoutline.llm import page_text, quote_threads


def text(page: str) -> str:
    best, blocks, _ = page_text.parse(page)
    return "\n\n".join(b[1] for b in blocks if b[0] >= best)


@pytest.mark.parametrize("page,want", [
    ("", ""),
    ("plain  text", "plain text"),
    ("<p>a<p>b<div>c</div>", "a\n\nb\n\nc"),
    ("<p>open <!-- x", "open"),
    ("<p>t</p><script>if(a<b){'</p>'}", "t"),
    ("<div>a < b &amp; c &#233;&nbsp;x</div><di", "a < b & c é x"),
    ("<nav>m</nav><header>h</header><main><h1>T</h1><p>x<br>y</p></main><footer>f</footer>", "T\n\nx y"),
    ("<div>out</div><article><header><h1>T</h1></header><p>a <b>b</p><div class='ad'>buy</div><form>f</form></article>", "T\n\na b"),
    ("<article><p>x <span class=ad>buy <span>now</span></span> y</p><div id='comments'><p>c</p></div></article>", "x y"),
    ("<form><nav>n</nav><article>body</article></form>", "body"),
    ("<div class='sidebar'>s</div><p>t</p><div class='cookie-notice'>c</div>", "t"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", "a\n\nb\n\n1\n\n2"),
])
def test_parse(page, want):
    assert text(page) == want


def test_extract(spark):
    top = "<div><p>Site of things</p></div>"
    rows = [(i, "http://a.example/x", f"<body>{top}<p>text {i}</p>", "old") for i in range(5)] + [(9, None, None, "old"), (9, None, "", "old"), (10, "http://b.example/", f"<body>{top}</body>", "old")]
    rows += [(20 + i, "http://a.example/y", f"<article>{top}<p>own {i}</p></article>", "old") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {(r["page_id"], r["url"]): r for r in page_text.extract(pages).collect()}
    assert [got[i, "http://a.example/x"]["text"] for i in range(5)] == [f"text {i}" for i in range(5)]
    assert got[9, None]["text"] == "" and got[10, "http://b.example/"]["text"] == "Site of things"
    assert got[21, "http://a.example/y"]["text"] == "Site of things\n\nown 1" and got[21, "http://a.example/y"]["n_chars"] == 21
    assert page_text.extract(pages).count() == len(rows) and page_text.extract(pages.limit(0)).count() == 0


ROWS = [
    (1, 0, "user", "Hello there\nsecond line"), (1, 1, "assistant", "On Monday X wrote:\n> Hello there\n> second line\nSure thing"),
    (1, 2, "user", "> > Hello there\n> > second line\n> Sure thing\nno way"), (1, 3, "assistant", "> second   LINE\nok"), (1, 4, "user", "plain"),
    (1, 5, "user", "> nothing known\nxx\n>> deep"), (1, 5, "user", "> nothing known\nxx\n>> deep"), (2, 0, None, None), (2, 1, "user", "> Hello there\n"), (2, 2, "user", ""),
    (None, 1, "user", "> a"), (3, None, "user", "> b\nb"), (1, 6, "user", "> plain\n> nothing like\nyes"), (1, 7, "x", ">no way\n\n>yes\n para one\n\npara two"), (1, 8, "x", "> para two"),
]


def test_quotes_match_sql(spark):
    messages = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id bigint, turn bigint, role string, text string, thread int")
    got = sorted(map(tuple, quote_threads.linked(messages).collect()), key=str)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", ROWS)
    assert got == sorted(con.execute(quote_threads.ORACLES["op3_quote_threads"]).fetchall(), key=str)
    by = {r[1]: r for r in got if r[0] == 1}
    assert by[1][3] == 0 and by[2][3] == 1 and by[2][4] == 0 and by[2][8] == "no way"
    assert quote_threads.linked(messages.limit(0)).count() == 0
    first = [r["formatted"] for r in quote_threads.conversations(messages).where("conv_id = 1").collect()][0]
    assert first.startswith("<|user|>\nHello there\nsecond line\n<|assistant|>\nSure thing\n<|user|>\nno way")


def test_long_chains_end(spark):
    rows = [(1, 0, "u", "m0")] + [(1, i, "u", f"> m{i - 1}\nm{i}") for i in range(1, 30)]
    out = quote_threads.linked(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert all(r["thread"] == 0 for r in out)


def test_very_long_messages_and_pages(spark):
    lines = [f"line number {k} of a long message" for k in range(20_000)]
    rows = [(1, 0, "user", "\n".join(lines)), (1, 1, "assistant", "\n".join("> " + x for x in lines) + "\nagreed"), (1, 2, "user", "> agreed\nfine")]
    got = {r["turn"]: r for r in quote_threads.linked(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert (got[1]["reply_to"], got[1]["text"], got[2]["reply_to"], got[2]["thread"]) == (0, "agreed", 1, 0) and got[0]["text"] == rows[0][3]
    body = "".join(f"<p>paragraph {k} with <b>some</b> words</p>" for k in range(60_000))
    page = spark.createDataFrame([(1, "http://a.example/x", f"<nav>menu</nav><article>{body}</article>"), (1, "http://a.example/x", None)], "page_id bigint, url string, html string")
    texts = sorted(r["text"] for r in page_text.extract(page).collect())
    assert texts[0] == "" and texts[1] == "\n\n".join(f"paragraph {k} with some words" for k in range(60_000))


def test_trimmed_quotes_link_by_a_line(spark):
    rows = [(1, 0, "user", "alpha beta\ngamma delta"), (1, 1, "user", "other words"), (1, 2, "assistant", "> trimmed, then\n>\n> gamma  DELTA\n> other words\nanswer"), (1, 3, "user", "> nothing\n> known\nno")]
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = sorted(map(tuple, quote_threads.linked(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()), key=str)
    assert got == sorted(con.execute(quote_threads.ORACLES["op3_quote_threads"]).fetchall(), key=str)
    assert [r[3] for r in got] == [None, None, 0, None]
