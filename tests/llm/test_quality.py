"""Quality rules, the weakly supervised classifier, HTML extraction and the pipeline."""

import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from text_cases import frame, pairs, words

from credilake.llm import rules, simhash, weak
from credilake.llm.html import extract, visible_text
from credilake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def counts_by_hand(text):
    w = text.encode().split()
    w = [x.decode() for x in w]
    windows = list(zip(w, w[1:], w[2:]))
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    some = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(some) - len(set(some)), len(covered)


def test_counts(spark):
    found = [p for p in pairs() if len(p[1]) < 5000]
    found += [(30, "a b c a b c a b\na b c\na b c\n\n"), (31, "x x x x x"), (32, "a # b|c <d> 100% && $$ **"), (33, "a\x0bb\x85c d e")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in found], "doc_id long, text string, n_words string")
    got = rules.apply_rules(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(str((r["doc_id"], *(r[n] for n in names))) for r in got) == sorted(str((i, *counts_by_hand(t))) for i, t in found)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert rules.apply_rules(frame(spark, empty=True)).count() == 0
    assert rules.apply_rules(frame(spark)).where("doc_id = 1").first()["n_words"] == 0


def test_rules_run_without_python(spark):
    plan = rules.apply_rules(frame(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_thresholds_are_compiled(spark):
    docs = spark.createDataFrame([(1, "the word and a thing of it " * 4 + " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    assert rules.apply_rules(docs).first()["kept"]
    assert not rules.apply_rules(docs, {"mean_word_length": (9.0, None)}).first()["kept"]


def labelled(spark, kept):
    return kept.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()


def test_rules_against_labels(spark):
    got = labelled(spark, QUERIES["op10_quality_rules"](spark, DATA))
    clean = got[(got.quality == 1) & ~got.base_failed]
    assert clean.kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.02


def test_classifier_against_labels(spark):
    """No label is seen in training."""
    got = labelled(spark, QUERIES["op8_quality_classifier"](spark, DATA))
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.05


def test_em_finds_accuracies():
    rnd = np.random.default_rng(2)
    good = rnd.random(20000) < 0.8
    k = len(weak.LABELLERS)
    hit = np.linspace(0.6, 0.95, k)
    right = rnd.random((len(good), k)) < hit
    votes = np.where(right == good[:, None], weak.GOOD, weak.BAD)
    votes[rnd.random(votes.shape) < 0.2] = weak.SILENT
    codes = (votes * 4 ** np.arange(k - 1, -1, -1)).sum(axis=1)
    assert (weak.votes_of(codes) == votes).all()
    patterns, counts = np.unique(codes, return_counts=True)
    model = weak.fit_labels(patterns, counts.astype(float))
    assert abs(model.good - 0.8) < 0.03
    assert np.abs(model.table[1][:, weak.GOOD] - hit).max() < 0.05
    assert ((model.posterior(codes) > 0.5) == good).mean() > 0.95


def test_classifier_on_odd_rows(spark):
    docs = frame(spark)
    model = weak.fit(docs)
    got = weak.judge(docs, model)
    assert got.count() == docs.count() and set(got.columns) == {*docs.columns, "weak_label"}
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, weak.judge(docs, weak.fit(docs)).collect()))
    assert weak.good_documents(frame(spark, empty=True)).count() == 0
    assert weak.good_documents(docs).columns == docs.columns


@pytest.mark.parametrize(
    "source, text",
    [
        ("<p>one<p>two", "one\n\ntwo"),
        ("a<br>b <b>c</b>d", "a\nb cd"),
        ("<ul><li>x<li>y<ol start=3><li>1<li>2</ol></ul>", "- x\n- y\n  3. 1\n  4. 2"),
        ("<table><tr><th>name<th>n<tr><td>long name<td>1</table>", "name       n\nlong name  1"),
        ("<div hidden>no</div><span style='Display : none'>no</span><i aria-hidden=true>no</i>yes", "yes"),
        ("<head><title>t</title><style>p{}</style></head><script>if (a<b) '</p>'</script><body>x", "x"),
        ("<pre> a\n   b</pre>", " a\n   b"),
        ("&lt;tag&gt; &amp; &copy;", "<tag> & ©"),
        ("a <!-- <p>b</p> --> c", "a c"),
        ("a < b and c > d", "a < b and c > d"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\nd\nu\ne"),
        ("<textarea>a <b></textarea>", "a <b>"),
        ("<p>a<div>b</div>c", "a\n\nb\nc"),
        ("", ""),
        ("plain", "plain"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_visible_text(source, text):
    assert visible_text(source) == text


@pytest.mark.parametrize(
    "source, text",
    [
        ("<html><head><title>T</title><h1>A</h1><p>text", "A\n\ntext"),
        ("<html><head><meta charset=x>\n<style>p{}</style>\nloose <b>text</b>", "loose text"),
        ("<html><head><script>x</script></head><body>y", "y"),
        ("<table><tbody><form><tr><td>x<td>y</form><tr><td>long<td>z</table>w", "x     y\nlong  z\n\nw"),
        ("<table><tr><form><td>x<td>y</form></table>", "x  y"),
        ("<table><tbody>loose<div>block</div><tr><td>x</tbody><tfoot><p>foot</table>", "loose\nblock\n\nfoot\n\nx"),
        ("<table><tbody><div hidden>no<tr><td>x</table>", "x"),
        ("<table><colgroup><col><tbody><tr><td>x</table>", "x"),
        ("<table><tbody hidden>no<tr><td>no</tbody><tr><td>x</table>", "x"),
        ("<div><svg width='1' />seen<math/> too</div>", "seen too"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds", "so x=2 holds"),
        ("<svg><title>no</title><defs><text>no</text></defs><style/><text>a</text><text>b</text></svg>c", "a b c"),
        ("<svg><defs><p>out", "out"),
        ("<svg aria-hidden=true><text>no</text></svg>yes<div/>in", "yes\nin"),
    ],
)
def test_visible_text_where_tags_are_implied(source, text):
    assert visible_text(source) == text


@pytest.mark.parametrize(
    "source, text",
    [
        ('<div style="visibility:hidden">h<span style="visibility:visible">v</span>h</div>w', "v\nw"),
        ('<p style="display:none;display:block">a<p style="display:block; display:none">b', "a"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
        ("<table><tr><td colspan=2>long title<td>x<tr><td>1<td>2<td>3</table>", "long title  x\n1  2        3"),
        ("<table><tr><td colspan=999999999>a<td>b<tr><td>c</table>", "a  b\nc"),
        ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>", "a  b\n   c\nd"),
        ("<table><tr><td rowspan=x colspan=-1>a<td rowspan>b</table>", "a  b"),
        ('<table><tr style="visibility:collapse"><td>a<tr><td style="visibility:hidden">b<td>c</table>', visible_text("<table><tr><td><td>c</table>")),
        ("<table><tr><td rowspan=2>a<td>b<td rowspan=2>c<tr><td colspan=2>over</table>", "a  b  c\n   over"),
        ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
        ("<ol start=5><li>a<li value=9>b<li>c<li value=x>d</ol>", "5. a\n9. b\n10. c\n11. d"),
        ("<ul><li value=9>a</ul>", "- a"),
        ("<input type=submit value='Go &amp; run'><input type=text value=no><input type=submit hidden value=h>", "Go & run"),
        ("a<dialog>b</dialog><dialog open>c</dialog><noframes>d</noframes><ruby>e<rp>(</rp></ruby>", "ace"),
    ],
)
def test_spans_numbers_and_inherited_visibility(source, text):
    assert visible_text(source) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), min_size=1, max_size=4), min_size=1, max_size=4))
def test_cells_lie_where_the_grid_puts_them(rows):
    """Against a grid that is filled cell by cell: texts of one first column begin at one place, columns in order."""
    taken, first, source, n = set(), {}, "<table>", 0
    for r, cells in enumerate(rows):
        source += "<tr>"
        c = 0
        for columns, height in cells:
            while (r, c) in taken:
                c += 1
            first[f"c{n}."] = (r, c)
            source += f"<td colspan={columns} rowspan={height}>c{n}."
            taken |= {(y, x) for y in range(r, min(r + height, len(rows))) for x in range(c, c + columns)}
            c += columns
            n += 1
    lines = visible_text(source + "</table>").split("\n")
    at = {}
    for name, (r, c) in first.items():
        assert name in lines[r].split()
        at.setdefault(c, set()).add(lines[r].index(name))
    assert all(len(places) == 1 for places in at.values())
    order = [min(at[c]) for c in sorted(at)]
    assert order == sorted(set(order))


def test_extraction_of_odd_rows(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "x"), (None, None, "<p>a</p>", "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", "<p>" + words(1, 20000), "x")],
        "page_id long, url string, html string, text string",
    )
    got = {(r["page_id"], r["n_lines"], r["n_chars"]) for r in extract(pages).collect()}
    assert got == {(1, 0, 0), (None, 1, 1), (2, 0, 0), (3, 1, len(words(1, 20000)))}
    assert extract(pages.limit(0)).count() == 0 and extract(pages).count() == 5


def test_html_query(spark):
    got = QUERIES["op9_html_extraction"](spark, DATA)
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    assert got.count() == pages.count()
    assert got.where("text LIKE '%track(%' OR text LIKE '%margin:0%' OR text LIKE '%<p>%'").count() == 0


def test_stages_return_documents(spark):
    for docs in (frame(spark), frame(spark, empty=True)):
        docs = docs.select(*corpus_pipeline.DOCUMENT_COLUMNS)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, DATA).dtypes == docs.dtypes
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).columns == ["doc_id", "ids", "decoded"]


def test_pipeline(spark):
    """Every stage against what its operator says, row by row."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], DATA).persist())
    n = dict(zip(names, [x.count() for x in seen[1:]]))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = seen[1].join(labels, "doc_id")
    assert good.where("quality = 0").count() <= 3
    assert docs.join(labels.where("quality = 1"), "doc_id").join(seen[1], "doc_id", "left_anti").count() <= 2
    assert n["line dedup"] == n["quality"]
    texts = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    kept = {r["doc_id"] for r in seen[3].collect()}
    prints = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    for i in texts.keys() - kept:  # gone for a smaller id that is linked
        assert any(j < i and _near(prints[i], prints[j]) for j in texts)
    ordered = sorted(kept)
    assert not any(_near(prints[i], prints[j]) for k, i in enumerate(ordered) for j in ordered[:k])
    assert {r["doc_id"] for r in seen[4].collect()} <= kept
    assert sorted(r["doc_id"] for r in seen[4].collect()) == sorted(r["doc_id"] for r in seen[5].collect())
    got = corpus_pipeline.run(spark, DATA)
    assert sorted(map(str, got.select("doc_id", "ids").collect())) == sorted(map(str, seen[5].select("doc_id", "ids").collect()))
    for x in seen[1:]:
        x.unpersist()


def _near(a, b):
    return (a ^ b).bit_count() <= simhash.MAX_DISTANCE
