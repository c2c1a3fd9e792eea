import random

import pytest
from pyspark.sql import functions as F

from scriptloom.llm import html_extract, language_id

PAGE = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>H &amp; h</h1><p>a <b>b</b>&nbsp; c<p>d<br>e<form>f</form></article><div id="comments"><p>no</p></div><footer>f</footer>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "H & h\na b c\nd e"),
        ("", ""),
        ("<p>plain", "plain"),
        ("<main><div class='sidebar'>x</div><p>y</main><p>z", "y"),
        ("a<!-- x --><p>b<style>p{}</style><p>c<header>h</header>", "a\nb\nc"),
        ("<article><header><h1>T</h1></header><p>1 &lt; 2</p><aside>x</aside></article>", "T\n1 < 2"),
        ("<div role='banner'>x</div><div style='display:none'>y</div>z<!-- never closed", "z"),
    ],
)
def test_blocks(page, text):
    assert html_extract.main_text(page, set()) == text


def test_templates_without_landmarks(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div>Site name</div><div><p>story {i}</p><p>more {i}</p></div><div>All rights reserved</div></body>", 1) for i in range(8)]
    pages += [(100, None, None, 1), (101, "http://one.example/", "<div>Site name</div>", 1), (None, "", "<p>x</p>", 1), (5, "http://h.example/5", pages[5][2], 1)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, host int")
    rows = html_extract.extract(table).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == 12 and got[3] == "story 3\nmore 3" and got[100] == "" and got[101] == "Site name" and got[None] == "x"
    assert all(r.n_chars == len(r.text) for r in rows)
    assert html_extract.extract(table.filter("page_id > 1000")).collect() == []


def test_language(spark):
    words = {"en": "the and of to with from that this", "de": "der die und das nicht ist mit ein", "fr": "le la les des une est dans pour"}
    rows = [(i, " ".join(w.split()[(i + j) % 8] for j in range(30)), lang, "src", "clash") for lang, w in words.items() for i in range(40)]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    odd = [(900, None, "en", "src", "x"), (901, "", None, None, None), (902, "123 --- 456", "en", "src", "x"), (903, rows[0][1], "fr", None, None)]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, language string")
    out = {r.doc_id: r for r in language_id.identify(table, **language_id.document_evidence()).collect()}
    assert len(out) == 124 and all(out[r[0]].language == r[2] and out[r[0]].kept for r in rows)
    assert [out[i].kept for i in (900, 901, 902)] == [False] * 3 and out[900].language == "und"
    assert out[903].language == "en"  # the text outweighs the declaration
    kept = language_id.accepted(table)
    assert kept.columns == table.columns and kept.count() == 121
    none = table.filter("doc_id > 5000")
    assert language_id.identify(none, **language_id.document_evidence()).collect() == []


def test_page_evidence(spark):
    row = spark.createDataFrame([('<html class="a" lang="de-AT">', "https://www.x.example.at/p")], "html string, url string")
    e = language_id.page_evidence()
    assert tuple(row.select(*[F.coalesce(v, F.lit("")).alias(k) for k, v in e.items()]).first()) == ("de", "www.x.example.at", "at")


def test_rare_languages_and_copies_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 8)
    words = {"en": "the and of to with from that this", "fr": "le la les des une est dans pour", "de": "der die und das nicht ist mit ein"}
    texts = [("en", " ".join(words["en"].split()[(i * i + j) % 8] for j in range(i % 50, 90))) for i in range(400)] + [("en", words["en"])] * 400
    texts += [(x, f"{words[x]} {words[x]}") for x in ("fr", "de")] + [("en", "12 34"), ("", "x"), ("none", "567")]
    table = spark.createDataFrame([(i, t, x, None) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(3)
    picked = language_id.sample(table, "lang", "text").collect()
    assert len(picked) == len(set(picked)) == 10 and [r.label for r in picked].count("en") == 8
    found = {r.doc_id: r for r in language_id.identify(table, **language_id.document_evidence()).collect()}
    assert [found[i].language for i in (800, 801)] == ["fr", "de"] and found[800].kept and found[801].kept


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='content has-sidebar'><article><p>x</article></div>", "x"),
        ("<div id='page-no-sidebar'><p>y<main><p>x</main></div>", "x"),
        ("<div class='sidebarLeft'>y<article><p>x</article></div><p>z", "x"),
        ("<article><p>x</article><div class='related'><article>y</article></div>", "x"),
        ("<div id='comments'><article>y</article></div><p>x", "x"),
        ("<article><p>a <math><mi>x</mi></math> b</article>", "a x b"),
    ],
)
def test_names_do_not_hide_articles(page, text):
    assert html_extract.main_text(page, set()) == text


def test_templates_inside_articles(spark):
    def page(i, body, host="h"):
        return i, f"http://{host}.example/{i}", f"<script>{i}</script><nav><p>menu</nav><article><h1>head {body}</h1><p>Read our letter</p><p>story {body}</p><p>more {body}</p></article><footer>f</footer>"

    rows = [page(i, i) for i in range(8)]
    rows += [page(20 + i, "same", "copies") for i in range(9)] + [page(30 + i, i, "copies") for i in range(4)]
    rows += [page(40, "same", "two"), page(41, "other", "two")]
    # A sentence on all pages, but each time in another place between other elements, is the authors' own.
    rows += [(60 + i, f"http://moved.example/{i}", "<article>" + "".join(f"<h{k}>part {k}</h{k}>" + (f"<p>{i} own</p><p>As said</p>" if i == k else "") for k in range(1, 7)) + "</article>") for i in range(1, 7)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[3] == "head 3\nstory 3\nmore 3"
    assert got[25] == "head same\nstory same\nmore same" and got[31] == "head 1\nstory 1\nmore 1"
    assert got[41] == "head other\nRead our letter\nstory other\nmore other"
    assert got[63] == "part 1\npart 2\npart 3\n3 own\nAs said\npart 4\npart 5\npart 6"


def test_articles_keep_their_headings_and_named_parts(spark):
    """Headings that recur between slots, and names that only begin like those of notices."""
    body = "<article><h1>Dish {0}</h1><h2>Ingredients</h2><ul><li>item {0}</ul><h2>Method</h2><p>Stir {0} times</p><table><tr><th>Time</th><td>{0} min</td></tr></table></article>"
    rows = [(i, f"http://food.example/{i}", f"<nav>x</nav>{body.format(i)}<footer>f</footer>") for i in range(8)]
    parts = '<article><p>a</p><div class="share-price">b</div><section id="related-work">c</section><p class="notice-period">d</p><label>e</label><div class="share-bar">no</div><div class="related-posts">no</div><p class="notice">no</p><div id="ad-slot">no</div><section class="article-comments">no</section><ul class="socialShare"><li>no</ul></article>'
    rows.append((100, "http://parts.example/", parts))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Dish {i}\nIngredients\nitem {i}\nMethod\nStir {i} times\nTime\n{i} min" for i in range(8))
    assert got[100] == "a\nb\nc\nd\ne"


def test_vectors_and_classes_by_brute_force(spark):
    """Classes are the tokens that occur equally often on each page of different main text, on at least half of the pages."""
    from collections import Counter, defaultdict

    rng = random.Random(4)
    hosts: dict[str, list[str]] = {"a": [], "b": [], "few": []}
    for host, pages in hosts.items():
        for i in range(2 if host == "few" else 9):
            parts = [f"<div><p>{rng.choice(['alpha', 'beta', 'gamma'])}</p></div>" * rng.randint(0, 2) for _ in range(4)]
            pages.append(f"<div>top</div><div><p>own {i}</p></div>{''.join(parts)}<article><h2>head</h2><p>{rng.choice(['often', 'seldom'])}</p><p>{i}</p></article><div>end</div>")
        pages += pages[:2]  # copies count once
    rows = [(f"http://{host}.example/{i}", page) for host, pages in hosts.items() for i, page in enumerate(pages)]
    table = spark.createDataFrame(rows, "url string, html string").repartition(3)
    stored = html_extract.common.store(html_extract.occurrences(html_extract.sequences(table)), "test-occurrences").read()
    vectors = defaultdict(dict)
    for url, page in rows:
        content, tokens = html_extract.tokens(page)
        vectors[html_extract.host_of(url)][content] = Counter(tokens)
    want = {}
    for host, pages in vectors.items():
        every = {t for held in pages.values() for t in held}
        vector = {t: tuple(held[t] for held in pages.values()) for t in every}
        on = {t: sum(n > 0 for n in v) for t, v in vector.items()}
        got = {r.token & (1 << 64) - 1: (r.vector, r.pages) for r in stored.filter(F.col("host") == host).collect()}
        assert {t: n for t, (_, n) in got.items()} == on
        groups = defaultdict(set)
        for t in every:
            groups[got[t][0]].add(t)
            if len(pages) >= 3 and on[t] >= len(pages) / 2 and (t % 2 == 0 or on[t] >= 3):
                want.setdefault(host, defaultdict(set))[vector[t], t % 2].add(t)
        same = defaultdict(set)
        for t in every:
            same[vector[t]].add(t)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, same.values()))
    found = {r.host: sorted(sorted(x & (1 << 64) - 1 for x in c) for c in r.classes) for r in html_extract.classes(stored).collect()}
    assert found == {host: sorted(map(sorted, classes.values())) for host, classes in want.items()} and set(found) == {"a.example", "b.example"}


def test_pages_that_the_template_changes(spark):
    """Hosts without landmarks, with notices that recur: the template decides on all of their pages, and on no other."""
    rows = [(i, f"http://plain.example/{i}", f"<div>Name</div><div><p>Notice to all</p></div><div><p>story {i}</p></div><div>Rights</div>") for i in range(12)]
    rows += [(50 + i, f"http://other.example/{i}", f"<article><h2>Part</h2><p>story {i}</p></article><div>Rights</div>") for i in range(12)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    alone = {i: html_extract.main_text(page, set()) for i, _, page in rows}
    got = {r.page_id: r.text for r in html_extract.extract(table).collect()}
    assert {i for i in got if got[i] != alone[i]} == set(range(12)) and all(got[i] == f"story {i}" for i in range(12))


def test_nesting():
    # 1 and 2 open and close the page, 3 and 4 an item, 5 stands in items, 7 anywhere.
    classes = [[0, 1, 2], [3, 4], [5], [7]]
    first = dict(html_extract.nested([0, 1, 3, 5, 4, 3, 5, 4, 7, 2], classes))
    second = dict(html_extract.nested([0, 1, 3, 5, 7, 4, 2], classes))
    assert [first[x] == second[x] for x in (-1, -2, -3, -4)] == [True, True, True, False]
    assert -2 not in dict(html_extract.nested([0, 1, 3, 4, 4, 3, 2], classes))
    assert -3 not in dict(html_extract.nested([0, 1, 3, 5, 4, 5, 2], classes))


def test_language_of_pages(spark, tmp_path):
    import __spark_entry__

    words = {"de": "der die und das nicht ist mit ein", "fr": "le la les des une est dans pour"}
    docs = [(i, " ".join(w.split()[(i + j) % 8] for j in range(30)), lang) for lang, w in words.items() for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    page = '<html lang="{0}"><body><article><p>{1}</p></article>'
    pages = [(i, f"http://h{i % 3}.example.{lang}/{i}", page.format(lang, f"{w} {w}")) for lang, w in words.items() for i in range(9)]
    # A text of no language of the model leans on its markup, host and suffix.
    pages += [(100, "http://h1.example.fr/x", page.format("fr", "xq")), (101, "http://h1.example.de/x", page.format("de", "xq")), (102, None, None), (102, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = __spark_entry__.queries()["page_language_id"](spark, str(tmp_path)).collect()
    assert len(rows) == len(pages) and all(r.language == r.url.split("/")[2][-2:] and r.kept for r in rows if r.url)
    assert [r.kept for r in rows if r.page_id == 102] == [False] * 2


def test_evidence_against_held_out_labels(spark):
    """Accuracy on documents that the model has not seen: hosts decide short texts that the text alone cannot tell."""
    import random

    rng = random.Random(3)
    own = {"aa": "bora tili venka solu mira".split(), "bb": "krast drumb shtek glorf mivz".split()}
    shared = "uno duo tres".split()

    def text(lang, n):
        return " ".join(rng.choice(shared if n == 1 else own[lang] + shared) for _ in range(n))

    known = [(i, text(lang, 30), lang, f"{lang}{i % 3}") for i, lang in enumerate(["aa", "bb"] * 40)]
    unseen = [(1000 + i, text(lang, 1 if i % 2 else 12), lang, f"{lang}{i % 3}") for i, lang in enumerate(["aa"] * 60 + ["bb"] * 60)]
    ddl = "doc_id long, text string, lang string, source string"
    labelled, truth = spark.createDataFrame(known, ddl), {r[0]: r[2] for r in unseen}
    docs = spark.createDataFrame(known + [(i, t, None, s) for i, t, _, s in unseen], ddl)

    def accuracy(**evidence):
        found = language_id.identify(docs, labelled=labelled, **evidence).filter("doc_id >= 1000").collect()
        return sum(r.language == truth[r.doc_id] for r in found) / len(truth)

    alone, fused = accuracy(), accuracy(**language_id.document_evidence())
    assert alone < 0.8 and fused > 0.95


def test_a_row_is_no_evidence_for_itself(spark):
    """The only text of a host gets the prior of a row without a host; other texts of the host do count."""
    words = {"en": "the and of to with from that this have which", "fr": "le la les des une est dans pour avec sur"}
    train = [(i, " ".join(words[x].split()[(i + j) % 10] for j in range(12)), x, None) for i, x in enumerate(["en", "fr"] * 60)]
    short = [(1000, "de", None, "alone"), (1001, "de", None, None), (1002, "de", None, "french")] + [(1100 + i, words["fr"], None, "french") for i in range(40)]
    table = spark.createDataFrame(train + short, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language_id.identify(table, **language_id.document_evidence()).collect()}
    assert abs(got[1000].posterior - got[1001].posterior) < 1e-9 and got[1002].language == "fr" and got[1002].posterior > got[1001].posterior


def test_accepted_keeps_columns_of_the_same_names(spark):
    rows = [(i, "der die das und nicht mit ein " * 5, "de", "s", f"l{i}", "yes", 2 * i) for i in range(4)] + [(9, "12", "de", "s", "l", "no", 1)] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, language string, kept string, posterior int")
    got = language_id.accepted(table)
    assert got.dtypes == table.dtypes
    assert sorted((r.doc_id, r.language, r.kept, r.posterior) for r in got.collect()) == [(i, f"l{i}", "yes", 2 * i) for i in range(4)]


def test_hosts_beyond_a_broadcast(spark, monkeypatch):
    rows = [(i, "der die das und nicht mit ein " * 3, "de", f"s{i % 3}") for i in range(9)] + [(20, "le la les des une est", "fr", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = sorted(map(tuple, language_id.identify(table, **language_id.document_evidence()).select("doc_id", "language", "kept").collect()))
    monkeypatch.setattr(language_id, "BROADCAST_KEYS", -1)
    assert sorted(map(tuple, language_id.identify(table, **language_id.document_evidence()).select("doc_id", "language", "kept").collect())) == want


def test_ties_repeated_rows_and_long_texts(spark):
    same, german = "uno duo tres quattro cinque ", "der die das und nicht mit ein "
    rows = [(i, same * (1 + i % 3), lang, "s") for i, lang in enumerate(["bb", "aa"] * 6)]
    rows += [(50, german * 3, "de", "s")] * 2 + [(60, "12 " * 500_000 + german * 50_000, None, "t")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = language_id.identify(table, **language_id.document_evidence()).collect()
    assert len(out) == len(rows)
    assert {r.language for r in out if r.doc_id < 12} == {"aa"}  # both languages are as likely: the first in the alphabet
    assert len({(r.language, r.posterior, r.kept) for r in out if r.doc_id == 50}) == 1
    assert {(r.language, r.kept) for r in out if r.doc_id >= 50} == {("de", True)}


def test_long_pages_and_clashing_columns(spark):
    many, long = [f"line {i}" for i in range(20_000)], "word " * 400_000
    rows = [(1, "http://a.example/1", f"<article><p>{'<p>'.join(many)}</article>", "own", "x"), (2, "http://b.example/2", f"<article><p>{long}</article>", None, None), (3, None, "", "", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(table).collect()}
    assert got == {1: ("\n".join(many), len("\n".join(many))), 2: (long.strip(), len(long) - 1), 3: ("", 0)}
