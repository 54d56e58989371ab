import pytest

from scoutline.llm import page_text


def text(page: str) -> str:
    best, blocks, _ = page_text.parse(page)
    return "\n\n".join(b[1] for b in blocks if b[0] >= best)


@pytest.mark.parametrize("page,want", [
    ("<article><p>a</p><svg class='i'/><p>b</p></article>", "a\n\nb"),
    ("<article><p>a</p><iframe src='/x' /><p>b</p></article>", "a\n\nb"),
    ("<article><p>a</p><svg class='i'><path d='x'/><p>b</p></article>", "a\n\nb"),
    ("<p>a <svg><title>icon</title><text>t</text></svg> b</p>", "a b"),
    ("<p>a</p><svg><foreignObject><p>x</p></foreignObject></svg><p>b</p>", "a\n\nb"),
    ("<svg-icon>x</svg-icon><p>b</p>", "x\n\nb"),
    ("<title-bar></title-bar><template-card><p>b</p></template-card>", "b"),
    ("<div><noscript><img></div><p>b</p>", "b"),
    ("<head><title>t</head><body><p>b</p>", "b"),
    ("<div><template><p>x</p></template><p>a</p></div><div><iframe>x</div><p>b</p>", "a\n\nb"),
    ("<title>t <i>u</i></title><p>b<script-x>c</script-x></p>", "b\n\nc"),
])
def test_raw_elements_end(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page,want", [
    ("<article><p title=don't>Hello</p><p>it's here</p><p>end</p></article>", "Hello\n\nit's here\n\nend"),
    ("<p title=don't>a</p><p>b</p>", "a\n\nb"),
    ("<p title='a > b' class=\"x'y\">c</p>", "c"),
    ("<p a=1 b c='d'e=f/>g</p>", "g"),
    ("<p title=>a</p><p =x>b</p>", "a\n\nb"),
    ("<p title=\"open>a</p><p>b</p>", "a\n\nb"),
    ("<p>1 < 2 and a<</p><p>x</p>", "1 < 2 and a<\n\nx"),
    ("<!doctype html><?x y?></ bogus><p>a</p><!-->b<p>c</p>", "a\n\nb\n\nc"),
    ("<script>a</scripty></script><p>b</p>", "b"),
    ("<article><h2 id='promotion'>Promotion rules</h2><p>a</p><div class='story-card related'>see also</div></article>", "Promotion rules\n\na"),
    ("<p>a</p><p b", "a"),
])
def test_attribute_states(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page", ['<a b="x ' * 60_000, "<a b='" * 60_000 + ">", "<div>" * 60_000 + "</p2>" * 60_000, "<div>x" * 60_000, "<" * 200_000, "<p a=" * 60_000, "<!" * 60_000, "<svg>" * 30_000 + "</g>" * 30_000])
def test_broken_pages_take_linear_time(page):
    import time

    page_text.parse("<p>warm</p>")
    began = time.perf_counter()
    page_text.parse(page[: len(page) // 4])
    quarter = time.perf_counter() - began
    began = time.perf_counter()
    page_text.parse(page)
    assert time.perf_counter() - began < 10 * quarter + 0.5


def test_report_counts_every_subtree(spark):
    page = "<body><nav><a>home</a></nav><article><p>own {0}</p></article><footer>(c) us</footer></body>"
    rows = [(i, f"http://a.example/x/{i}", page.format(i)) for i in range(4)] + [(9, "http://b.example/", page.format(9))]
    out = page_text.template_report(spark.createDataFrame(rows, "page_id bigint, url string, html string")).first()
    assert out["pages"] == 5 and out["template"] == 8 and out["pages_with_template"] == 4
