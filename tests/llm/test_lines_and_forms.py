"""Problems 1 and 2 on small fixtures: definitions, brute force, nulls, ties and repeated rows."""

import datetime as dt
import unicodedata

import pytest

from quillspan.llm import folding, one_form, repeated_lines

CHUNKS = "chunk_id long, page_id long, origin string, chunk_no int, content string, n_removed int"
PAGES = "page_id long, url string, origin string, title string, html string, fetched_at timestamp, keys int"


def _pages(spark, rows):
    day = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(*r, day, 0) for r in rows], PAGES)


def test_repeated_lines(spark):
    legal = "All  rights reserved 2024 by them"
    pages, chunks = [], []
    for i in range(10):
        origin = ["https://A.example", "https://a.example/", None, "https://a.example:443"][i % 4]
        pages.append((i, f"https://a.example/{i}", origin, None, None))
        line = legal.upper() if i % 2 else legal.replace("2024", str(i))
        chunks.append((100 + i, i, origin, 0, f"own line number {'x' * i} here\n\n {line} \nshort 1", 5))
    pages.append((50, "https://a.example:8080/x", "https://a.example:8080", None, None))
    chunks.append((150, 50, None, 0, legal, 5))
    chunks.append(chunks[0])
    chunks += [(160, None, None, 0, legal, 1), (161, 3, None, 1, None, 1), (162, 3, None, 1, "", 1), (163, 999, None, 0, legal, 1)]
    c, p = spark.createDataFrame(chunks, CHUNKS), _pages(spark, pages)
    found = {(r.chunk_id, tuple(r.lines)) for r in repeated_lines.find_repeated(c, p, min_days=1).collect()}
    assert found == {(100 + i, (3,)) for i in range(10)}
    out = {r.chunk_id: r for r in repeated_lines.strip_repeated_lines(c, p, min_days=1).collect()}
    assert len(out) == 15 and out[100].content == "own line number  here\n\nshort 1" and out[100].n_removed_ == 1 and out[100].n_removed == 5
    assert out[150].content == legal and out[161].content is None and out[162].content == ""
    assert repeated_lines.find_repeated(c.limit(0), p).count() == 0
    assert repeated_lines.find_repeated(c, p.limit(0)).count() == 0


def test_copies_are_one_cluster(spark):
    """Five copies of one page reach five pages, but not three documents."""
    pages = [(i, f"https://b.example/{i}", "https://b.example", None, None) for i in range(6)]
    chunks = [(i, i, None, 0, "a republished article line" if i < 5 else "something else entirely", 0) for i in range(6)]
    keyed = repeated_lines.keyed_chunks(spark.createDataFrame(chunks, CHUNKS))
    counted = repeated_lines.count_lines(keyed, repeated_lines.page_sites(_pages(spark, pages)))
    assert repeated_lines.repeated_keys(counted, min_clusters=1, min_days=0).count() == 1
    assert repeated_lines.repeated_keys(counted, min_clusters=3, min_days=1).count() == 0


def test_republished_article_stays(spark):
    """By default a line must stand in three different documents and on two days: an article under eight addresses stays whole."""
    article = "The whole story of the mill\nIt stood by the river for years\nThen the water rose"
    legal = "Reuse of these pages only with our permission"
    pages, chunks = [], []
    for i in range(12):
        day = dt.datetime(2025, 1, 1 + i % 4)
        pages.append((i, f"https://c.example/{i}", "https://c.example", None, None, day, 0))
        text = article if i < 8 else f"Notes on item {'abcdefgh'[i - 8]} of the long list\n{legal}"
        chunks.append((i, i, None, 0, text, 0))
    for i in range(12, 16):  # few documents, but different ones on several days
        pages.append((i, f"https://c.example/{i}", "https://c.example", None, None, dt.datetime(2025, 2, i), 0))
        chunks.append((i, i, None, 0, f"Another page about topic {'ijkl'[i - 12]}\n{legal}", 0))
    c, p = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(pages, PAGES)
    kept = {r.chunk_id: r.content for r in repeated_lines.strip_repeated_lines(c, p).collect()}
    assert all(kept[i] == article for i in range(8)) and all(legal not in kept[i] for i in range(8, 16))
    by_pages = {r.chunk_id for r in repeated_lines.find_repeated(c, p, min_clusters=1, min_days=0).collect()}
    assert by_pages == set(range(16))


SAME = [
    ("Ｆｕｌｌ width", "Full width"), ("ﬁne", "fine"), ("Le ré‍sumé", "Le résumé"), ("a b", "a b"),
    ("оbject", "object"), ("стpaница", "страница"), ("ド", "ド"), ("so­ft", "soft"), ("νalue", "value"),
]
DIFFERENT = [("a", "A"), ("resume", "résumé"), ("x²", "x2"), ("a.", "a"), ("a  b", "a b"), ("one", "two")]


def _keys(texts, html=False):
    out = one_form._run_sql(one_form._connection(), [one_form.resolve_references(t) if html else t for t in texts], html, True)
    return out.column("k").to_pylist()


@pytest.mark.parametrize(("a", "b"), SAME)
def test_reads_the_same(a, b):
    assert len(set(_keys([a, b]))) == 1
    assert folding.skeleton(folding.fold(a)) == folding.skeleton(folding.fold(b))


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_reads_different(a, b):
    assert len(set(_keys([a, b]))) == 2


def test_references_and_forms():
    assert len(set(_keys(["<p>caf&eacute; &lt;b&gt;", "<p>café &#60;b>"], html=True))) == 1
    form = one_form._run_sql(one_form._connection(), ["жoлт и а", None, "", "​", "ascii"], False, False).column("form").to_pylist()
    assert form == ["жолт и а", None, "", "", "ascii"]
    assert all(unicodedata.is_normalized("NFC", f) for f in form if f)


def test_pairs_against_brute_force(spark):
    titles = [a for pair in SAME + DIFFERENT for a in pair] + [None, "", "​", "​​", "fine"]
    rows = [(i, None, None, t, "" if i % 2 else None) for i, t in enumerate(titles)]
    df = _pages(spark, rows + rows[:2])
    got = {tuple(r) for r in one_form.same_reading_pairs(one_form.text_keys(df)).collect()}
    key = [folding.skeleton(folding.fold(t)) if t else "" for t in titles]
    want = {
        (i, j, "title")
        for i in range(len(titles)) for j in range(i + 1, len(titles))
        if titles[i] and titles[j] and titles[i] != titles[j] and key[i] == key[j] and key[i].strip()
    }
    assert got == want
    assert one_form.text_keys(df.limit(0)).count() == 0


def test_letters_that_compose_alone():
    """Letters with one canonical form but no combining mark, and the joined letters outside the Croatian range."""
    pairs = [("\u212a", "K"), ("\u212bngström", "Ångström"), ("5 \u2126", "5 \u03a9"), ("\u1f71", "\u03ac"), ("\uf900", "\u8c48"), ("\u0132sland \u0133s", "IJsland ijs"), ("\u0149", "\u02bcn")]
    assert _keys([a for a, _ in pairs]) == _keys([b for _, b in pairs])
    assert _keys([folding.fold(a) for a, _ in pairs]) == _keys([a for a, _ in pairs])


def test_reading_classes(spark):
    rows = [(1, "Full width", ""), (2, "Ｆｕｌｌ width", None), (3, "Full width", " "), (3, "Full width", " "), (4, None, "<p>a"), (5, "other", "<p>a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, title string, html string, key string")
    got = {(r.page_id, r.field_name): (r.class_id, r.n_pages, r.n_texts) for r in one_form.reading_classes(one_form.text_keys(df)).collect()}
    own = got[1, "title"]
    assert own[1:] == (3, 2) and got[2, "title"] == got[3, "title"] == own and got[5, "title"][1:] == (1, 1) and got[4, "html"] == got[5, "html"]
    assert len(got) == 6 and one_form.reading_classes(one_form.text_keys(df.limit(0))).count() == 0
