import pytest

from scoutline.llm import page_text


def extracted(spark, rows):
    return {r["page_id"]: r for r in page_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_templates_inside_articles(spark):
    page = "<article><p>own {0}</p><div class='x1'>Filed under news</div><div class='note'><p>A passage that all of them repeat.</p></div><div class='y2'>It always rains in this town.</div><div class='z'>own line {0}</div></article>"
    got = extracted(spark, [(i, f"http://a.example/{i}", page.format(i)) for i in range(4)] + [(9, "http://b.example/", page.format(9))])
    for i in range(4):
        assert got[i]["text"] == f"own {i}\n\nA passage that all of them repeat.\n\nIt always rains in this town.\n\nown line {i}"
        assert got[i]["n_template"] == 1 and got[i]["n_chars"] == len(got[i]["text"])
    assert "Filed under news" in got[9]["text"] and got[9]["n_template"] == 0


def test_template_of_a_folder(spark):
    rows = [(i, f"http://a.example/{'few' if i < 3 else 'many'}/{i}", f"<div>{'<div>Only here</div>' if i < 3 else ''}<p>text {i}</p></div>") for i in range(40)]
    got = extracted(spark, rows)
    assert [got[i]["text"] for i in range(40)] == [f"text {i}" for i in range(40)]


@pytest.mark.parametrize("name,kept", [("post-share", False), ("article-ad", False), ("entry-footer", False), ("post sponsored", True), ("page-with-sidebar", True), ("post", True)])
def test_compound_names(name, kept):
    best, blocks, _ = page_text.parse(f"<article><p>a</p><div class='{name}'>b</div></article>")
    assert [b[1] for b in blocks] == ["a", "b"][: 1 + kept]
