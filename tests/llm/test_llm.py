"""The training-data operators against brute force, on whole small tables."""

import hashlib
import html as html_module
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from churnscope.llm import (decontamination, language, lines, mixing, near_duplicates, pages, quality, scoring, sharding,
                            sketches)
from churnscope.llm.queries import ORACLE_SQL, QUERIES
from churnscope.llm.shared import read
SF_SMALL = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text string, slot int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return WORD.findall(ascii_lower(text))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names."""
    long_text = "\n".join(f"Line {i} of a very long text. It goes on and on, number {i * i}." for i in range(4000))
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, "one", "en", None), (3, "!!! ???", None, "a"),
            (4, long_text, "en", "a"), (5, "α β γ é ü\nzwei Wörter hier", "de", "b"), (5, "the same id again", "en", "b"),
            (6, "twice the same row here", "en", "b"), (6, "twice the same row here", "en", "b"), (None, "no id at all", "en", "c"),
            (7, "twice the same row here", "en", "c"), (8, "a\nb\n\na\n  A ", "en", "c")]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "clash", 3) for i, t, l, s in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF_SMALL, "documents").cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_all_queries_and_no_unknown_sql():
    assert sorted(int(m[1]) for q in QUERIES if (m := re.match(r"op(\d+)_", q))) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


# 1: paragraph sketches

def brute_digests(text):
    return set(re.findall(sketches.PARAGRAPH, text or ""))


def check_sketches(rows, out):
    rows = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    assert len(got) == len(rows)
    ids = Counter(r.doc_id for r in rows)
    for i, r in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)]
        if ids[r.doc_id] > 1 or ids[nxt.doc_id] > 1:
            continue  # tied ids follow each other by hash
        text, after = r.text or "", nxt.text or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, got[i].near_edited), (after, got[i].near_next)):
            a, b = brute_digests(text), brute_digests(other)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_sketches_recover_every_difference(docs):
    check_sketches(docs.collect(), sketches.fingerprints(docs))


def test_sketches_odd_rows(spark, odd):
    out = sketches.fingerprints(odd).cache()
    check_sketches(odd.collect(), out)
    assert out.count() == odd.count()
    prints = {r.doc_id: r.fingerprint for r in out.collect()}
    assert prints[6] == prints[7] and prints[0] == prints[1]
    assert sketches.fingerprints(empty(spark)).count() == 0
    one = sketches.fingerprints(odd.where("doc_id = 4")).first()
    assert one.near_next == 1.0


# 2: raking

def test_rake_meets_targets_and_probabilities_spend_the_budget(docs):
    out = mixing.mix(docs).toPandas()
    assert len(out) == docs.count()
    total = out.n_tokens.sum()
    for dim in mixing.DIMS:
        share = out.groupby(dim).n_tokens.sum() / total
        want = share[share > 0] ** mixing.TEMPER[dim]
        want /= want.sum()
        got = (out.weight * out.n_tokens).groupby(out[dim]).sum() / total
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=2e-3)
    assert (out.probability * out.n_tokens).sum() == pytest.approx(mixing.BUDGET * total, rel=0.02)
    assert 0.4 * total < out.n_tokens[out.kept].sum() < 0.8 * total


def test_rake_odd_rows(spark, odd):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count()
    assert all(r.kept for r in out if r.n_tokens == 0)
    assert len({r.kept for r in out if r.doc_id == 6}) == 1
    assert mixing.mix(empty(spark)).count() == 0


# 3: decontamination

def brute_hits(doc_rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = tokens(text)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[s:s + 13])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in doc_rows:
        w, hit, found = tokens(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (items_of := windows.get(tuple(w[s:s + n]))):
                    hit |= set(range(s, s + n))
                    found |= items_of
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc_id, len(w), len(hit), len({x for x in found if x is not None}), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def test_positional_index_matches_brute_force(spark, docs, odd):
    bench = [(r.item_id, r.text) for r in read(spark, SF_SMALL, "benchmark").collect()]
    bench += [(9001, "the"), (9002, None), (9003, "!!"), (9004, "Line 7 of a very LONG text"), (9005, "β γ é"), (None, "same row"), (9001, "one")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    for table in (docs, odd):
        for block in (200_000, 50):  # one block, and many
            got = decontamination.search(decontamination.build_index(table, 5000), items, block_words=block)
            got = Counter(map(tuple, got.drop("items", "spans").collect()))
            assert got == brute_hits([(r[0], r[1]) for r in table.collect()], bench)
    none = decontamination.search(decontamination.build_index(empty(spark)), items)
    assert none.count() == 0
    assert decontamination.search(decontamination.build_index(odd), items.limit(0)).where("n_hit > 0").count() == 0


def test_proximity_allows_moved_words_within_a_document(spark):
    table = spark.createDataFrame([(1, "a b x c"), (2, "a b c"), (3, "a"), (4, "b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    index = decontamination.build_index(table)
    hits = lambda slop: {r.doc_id for r in decontamination.search(index, items, slop=slop).collect() if r.n_hit}
    assert hits(0) == {2}
    assert {1, 2} <= hits(1) and 3 not in hits(1)


def test_only_contaminated_texts_leave(spark):
    bench = " ".join(f"b{i}" for i in range(20))
    rows = [(None, bench), (None, "no id but clean"), (None, None), (1, bench), (1, bench), (1, "clean with the same id"), (2, "clean"), (2, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, bench)], "item_id long, text string")
    out = decontamination.clean(table, items, {"doc_id": "long", "text": "string"})
    assert Counter(map(tuple, out.collect())) == Counter(r for r in rows if r[1] != bench)


# 4: masked pseudo-likelihood

def test_scores_beat_unigrams_and_cover_all_rows(docs):
    vocab = scoring.vocabulary(docs)
    before = scoring.score(docs, vocab, scoring.start(vocab)).agg(F.sum("pseudo_log_likelihood")).first()[0]
    trained = scoring.train(docs, vocab)
    out = scoring.score(docs, vocab, trained).toPandas()
    assert out.pseudo_log_likelihood.sum() > before
    words = {r.doc_id: len(tokens(r.text)) for r in docs.collect()}
    assert dict(zip(out.doc_id, out.n_words)) == words


def test_step_lowers_the_loss():
    rng = np.random.default_rng(0)
    even = {"group": np.zeros(scoring.GROUPS), "class": np.zeros((scoring.GROUPS, scoring.EACH))}
    params = scoring.unpack(scoring.start(even))
    cls = np.tile(np.arange(8) * 37, 200)
    ctx = scoring.windows(cls, np.zeros(len(cls), int), 1)
    first = -scoring.log_chances(params, ctx, cls).mean()
    for _ in range(200):
        b = rng.integers(0, len(cls), 256)
        scoring.descend(params, ctx[b], cls[b], 0.3)
    assert -scoring.log_chances(params, ctx, cls).mean() < 0.3 * first


def test_steps_follow_the_gradient():
    """A step's change of every parameter against differences of the loss."""
    rng = np.random.default_rng(2)
    even = {"group": np.zeros(scoring.GROUPS), "class": np.zeros((scoring.GROUPS, scoring.EACH))}
    params = [p.astype(np.float64) for p in scoring.unpack(scoring.start(even))]
    want = rng.integers(0, scoring.CLASSES, 40)
    ctx = scoring.windows(want, np.zeros(40, int), 1)
    moved = [p.copy() for p in params]
    scoring.descend(moved, ctx, want, 1e-3)
    g = int(want[0]) // scoring.EACH
    for k, at in ((0, (ctx[3, 1], 5)), (1, (7,)), (2, (4, g)), (3, (g,)), (4, (g, 3, int(want[0]) % scoring.EACH)), (5, (g, int(want[0]) % scoring.EACH))):
        loss = []
        for d in (1e-5, -1e-5):
            other = [p.copy() for p in params]
            other[k][at] += d
            loss.append(-scoring.log_chances(other, ctx, want).mean())
        slope = (loss[0] - loss[1]) / 2e-5
        assert (params[k][at] - moved[k][at]) / 1e-3 == pytest.approx((4 if k == 0 else 1) * slope, rel=1e-3, abs=1e-7)


def test_chances_of_all_classes_sum_to_one():
    rng = np.random.default_rng(1)
    params = [rng.normal(0, 0.5, s) for s in scoring.SHAPES]
    ctx = np.tile(scoring.windows(rng.integers(0, scoring.CLASSES, 9), np.zeros(9, int), 1)[4], (scoring.CLASSES, 1))
    assert np.exp(scoring.log_chances(params, ctx, np.arange(scoring.CLASSES))).sum() == pytest.approx(1.0)


def test_word_counts_are_exact_and_every_position_is_masked_once(docs, monkeypatch):
    monkeypatch.setattr(scoring, "FLUSH", 500)
    want = Counter(w for r in docs.collect() for w in tokens(r.text))
    counts = scoring.count_words(docs.repartition(5)).collect()
    assert sorted(r.n for r in counts) == sorted(want.values())
    vocab = scoring.vocabulary(docs)
    assert vocab["n"].sum() == sum(want.values()) - sum(n for _, n in want.most_common(scoring.FREQUENT))
    texts = [r.text or "" for r in docs.collect()][:50]

    def rounds(some):
        data = np.frombuffer("".join(some).encode(), np.uint8)
        offsets = np.cumsum([0] + [len(t.encode()) for t in some])
        h, _, rows = scoring._tokens(data, offsets)
        masked = scoring.masked_in(h, rows, len(some), 2)
        return [masked[rows == i].tolist() for i in range(len(some))]

    whole = rounds(texts)
    assert whole == [rounds([t])[0] for t in texts]  # the neighbours in a block don't matter
    assert {r for m in whole for r in m} == {0, 1}


def test_scores_odd_rows(spark, odd):
    vocab = scoring.vocabulary(odd)
    out = scoring.score(odd, vocab, scoring.train(odd, vocab)).collect()
    assert len(out) == odd.count()
    assert all(r.per_word is None and r.pseudo_log_likelihood == 0 for r in out if r.n_words == 0)
    same = [r.pseudo_log_likelihood for r in out if r.doc_id in (6, 7)]
    assert max(same) - min(same) < 1e-3
    assert scoring.score(empty(spark), vocab, scoring.start(vocab)).count() == 0
    nothing = scoring.vocabulary(empty(spark))
    assert scoring.score(odd, nothing, scoring.train(empty(spark), nothing)).count() == odd.count()


# 5: co-training

def test_co_training_separates_good_from_bad(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    out = quality.classify(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    good = (out.quality == 1) & (out.toxic == 0)
    assert out.accepted[good].mean() > 0.93
    assert out.accepted[~good].mean() < 0.3


def test_co_training_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(odd, labels) is None
    out = quality.classify(odd, None).collect()
    assert len(out) == odd.count() and all(r.accepted and r.p_good == 0.5 for r in out)
    docs = read(spark, SF_SMALL, "documents")
    model = quality.train(docs, read(spark, SF_SMALL, "labels"))
    assert quality.classify(odd, model).count() == odd.count()
    assert quality.classify(empty(spark), model).count() == 0


# 6: pages

def test_pages_give_the_article_only(spark):
    table = read(spark, SF_SMALL, "pages")
    for r in pages.extract(table).join(table.select("page_id", "html"), "page_id").collect():
        inner = r.html[r.html.index("<article>") + 9:].split("</article>")[0]
        want = [re.sub(r"\s+", " ", html_module.unescape(re.sub(r"<[^>]*(>|$)", "", p.replace("<br>", " ")))).strip()
                for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in want if p)
        assert r.n_chars == len(r.text)


def test_site_template_goes_and_article_lines_stay(spark):
    page = "<html><body><div><b>{0}</b></div><div>{2}<p>Story {1} of the day.</p><p>Same line everywhere.</p>{3}</div><div>Our shop sells hats</div></body></html>"
    schema = "page_id long, url string, html string"
    rows = [(i, f"http://h.x/{i}", page.format("Welcome to h", i, "<article>", "</article>")) for i in range(12)]
    # Without an article element, a recurring line is the site's.
    rows += [(i, f"http://g.x/{i}", page.format("Welcome to g", i, "", "")) for i in range(20, 32)]
    rows += [(50, None, None), (51, "http://h.x/e", ""), (52, "http://z.y/", "<main><p>a<br>b &amp; c<p class='ad'>x</p><ul><li>1<li>2</ul>"),
             (53, "bad url", "plain < text"), (53, "bad url", "<article>A<article class='comment'>B</article></article><script>'</p>'</script")]
    out = {(r.page_id, r.text) for r in pages.extract(spark.createDataFrame(rows, schema)).collect()}
    assert {(i, f"Story {i} of the day.\nSame line everywhere.") for i in range(12)} <= out
    assert {(i, f"Story {i} of the day.") for i in range(20, 32)} <= out
    assert {(50, ""), (51, ""), (52, "a b & c\n1\n2"), (53, "plain < text"), (53, "A")} <= out
    assert pages.extract(spark.createDataFrame([], schema)).count() == 0


def generated_sites():
    """Sites without telling names, several designs each, and their articles."""
    rows, want = [], {}
    for site, (open_, close) in enumerate((("<div class='x1'>", "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("<article>", "</article>"), ("", ""))):
        for i in range(60):
            design = i % 6  # each design is on ten pages of the host, a sixth of them
            menu = "".join(f"<td><a href='/{k}'>Topic {k} of design {design}</a></td>" for k in range(4))
            body = [f"Article {i} of site {site} tells this.", f"It goes on with part {i * i}.", f"And ends at {i + 7}."]
            phrase = "<p>As every week.</p>" if open_ == "<article>" else ""
            html = (f"<body><table><tr>{menu}</tr></table><p>Notice {design}: we moved.</p>{open_}<h1>{body[0]}</h1><p>{body[1]}</p>{phrase}"
                    f"<p>{body[2]}</p>{close}<div><p>Copyright {site} by the firm.</p><span>Call us now.</span></div></body>")
            rows.append((1000 * site + i, f"https://s{site}.example/{i}", html))
            want[1000 * site + i] = "\n".join([*body[:2], *(["As every week."] if phrase else []), body[2]])
    return rows, want


@pytest.mark.parametrize("sent", [10 ** 6, 0])
def test_menus_notices_and_copyright_go_without_names(spark, monkeypatch, sent):
    monkeypatch.setattr(pages, "SENT", sent)
    monkeypatch.setattr(pages, "HOT_PAGES", 20)
    rows, want = generated_sites()
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert {r.page_id: r.text for r in out} == want


def test_template_counts_against_brute_force(spark):
    rows, _ = generated_sites()
    rows += [(9000 + k, "https://s0.example/copy", rows[3][2]) for k in range(9)]  # copies of one article count once
    count = defaultdict(set)
    for _, url, html in rows:
        root = pages.parse(html)
        main = pages.main_part(root)
        for h in pages.candidates(root, main):
            count[(url.split("/")[2], h)].add(main.hash)
    want = {k: len(v) for k, v in count.items() if len(v) >= pages.PAGES}
    found = pages.templates(pages.subtrees(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert {(r.host, r.subtree): r.articles for r in found} == want and len(want) > 30


def test_what_is_not_shown_and_replies_go_long_and_deep_pages_stay_whole(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    cases = ["<article><p>a</p><div hidden>x</div><p style='color:red; display: none'>y</p><div class='links'><a>m</a> <a>n</a></div></article>",
             "<body><p>a</p><section class='reader-replies'><p>I think so too, at great length, much longer.</p></section></body>",
             f"<article>{deep}</article>", "<article>" + "<p>long text</p>" * 20000 + "</article>"]
    schema = "page_id long, url string, html string, Html string, HTML string, text int"
    rows = [(i, f"http://q{i}.x/", c, "clash", "clash", 1) for i, c in enumerate(cases)]
    out = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, schema)).collect()}
    assert out == {0: "a", 1: "a", 2: "deep", 3: "\n".join(["long text"] * 20000)}


def test_names_of_wrappers_and_article_parts_drop_no_article(spark):
    story, side = "<h1>Title</h1><p>The story of the day is told here.</p>", "<div class='sidebar'>Side</div>"
    want = "Title\nThe story of the day is told here."
    cases = [("<div class='site has-sidebar'><article>{}</article>{}</div>", want), ("<div class='no-sidebar'>{}{}</div>", want),
             ("<div id='page-header'>Site<article>{}</article></div>{}", want), ("<form>Site<main>{}</main>{}</form>", want),
             ("<form><div>{}</div>{}</form>", want), ("<div class='with-header'><div class='post'>{}</div></div>{}", want),
             ("<article>{}<p class='notice'>Mind the gap.</p><section class='search'><p>We search on.</p></section></article>{}",
              want + "\nMind the gap.\nWe search on."),
             ("<article>{}<section class='related'><a>Other</a> <a>More</a></section><form>Mail <input></form></article>{}", want),
             ("<main>{}</main><div id='comments'><article class='c'>A comment that is longer than all of the story, by far.</article></div>{}", want),
             ("<p>Only a p.</p>{}<div class='related'><article>Teaser</article></div>", "Only a p.\n" + want)]
    rows = [(i, f"http://h{i}.x/", f"<body>{c.replace('{}', story, 1).replace('{}', side)}</body>") for i, (c, _) in enumerate(cases)]
    rows.append((99, "http://t.x/", f"<article><div class='entry-header'><h1>Title</h1><p class='byline'>Me</p></div>{story[14:]}</article>"))
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: w for i, (_, w) in enumerate(cases)} | {99: want}


# 7: lines

def brute_units(text):
    """Pieces that end after a sentence's end with blanks, or after line breaks."""
    pieces = re.split(r"((?:[.!?][\"')\]]*[ \t]+)|(?:\n\s*))", text or "")
    joined = [a + b for a, b in zip(pieces[::2], pieces[1::2] + [""])]
    return [p for p in joined if p]


def brute_passages(rows, least):
    """What is left of each text, and the words taken out."""
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] if r[0] is not None else 1 << 63,)):
        for no, unit in enumerate(brute_units(r[1])):
            if u := " ".join(unit.lower().split()):
                first.setdefault(u, (r[0], r[1], no))
    want = Counter()
    for r in rows:
        units = brute_units(r[1])
        again = [bool(u := " ".join(x.lower().split())) and first[u] != (r[0], r[1], no) for no, x in enumerate(units)]
        drop, i = set(), 0
        while i < len(units):
            j, last = i, i
            while j < len(units) and (again[j] or not units[j].split()) and again[i]:
                last = j if again[j] else last
                j += 1
            if again[i] and sum(len(x.split()) for x in units[i:last + 1]) >= least:
                drop |= set(range(i, last + 1))
            i = max(j, i + 1)
        want[(r[0], None if r[1] is None else "".join(x for no, x in enumerate(units) if no not in drop),
              sum(len(units[no].split()) for no in drop))] += 1
    return want


def check_lines(rows, out, least=lines.LEAST_WORDS):
    assert Counter((r.doc_id, r.text, r.n_removed_words) for r in out) == brute_passages(rows, least)
    originals = defaultdict(list)
    for i, t in rows:
        originals[i].append(t)
    for r in out:
        assert any((t is None and r.text is None) or (t is not None and r.text == "".join(
            t[s.start:s.start + s.length] for s in r.kept) and sorted(
                x for s in [*r.kept, *r.removed] for x in range(s.start, s.start + s.length)) == list(range(len(t))))
            for t in originals[r.doc_id])


def test_lines_keep_first_occurrences(spark, docs, odd):
    for least in (1, lines.LEAST_WORDS):
        check_lines([(r.doc_id, r.text) for r in docs.collect()], lines.dedup_lines(docs, least).collect(), least)
        distinct = odd.where("doc_id <> 5 or doc_id is null")  # tied ids rank by hash
        check_lines([(r[0], r[1]) for r in distinct.collect()], lines.dedup_lines(distinct, least).collect(), least)
    assert lines.dedup_lines(odd).count() == odd.count()
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_lines_short_repeats_stay_and_passages_go(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_SHARE", 10)  # many digests by broadcast
    passage = " ".join(f"Sentence {i} of a passage that many have." for i in range(6))
    rows = [(i, f"Own words {i} here. All rights reserved.\n\n{passage if i % 3 else 'None of it.'} Own end {i}.") for i in range(60)]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    check_lines(rows, list(out.values()))
    assert out[1].n_removed == 0 and out[2].n_removed == 7 and out[3].n_removed == 0
    assert "All rights reserved." in out[3].text and "passage" not in out[2].text


# 8: language

def test_language_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    out = language.predict(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(out.doc_id, out.held_out))
    assert out.score.between(0, 1).all()


def test_language_odd_rows(spark, odd):
    out = language.predict(odd, language.train(odd)).collect()
    assert len(out) == odd.count()
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert {0, 1, 3} <= und and all(r.score == 0 for r in out if r.lang_pred == "und")
    nothing = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language.train(nothing) is None
    assert {r.lang_pred for r in language.predict(nothing, None).collect()} == {"und"}
    assert language.predict(empty(spark), language.train(odd)).count() == 0


# 9: shards

def check_shards(table, out, slack):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in table)
    slots, size = defaultdict(list), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(size.values()) / 8
    assert all(abs(v - mean) <= slack for v in size.values()) and set(size) <= set(range(8))


def test_shards_are_near_equal_and_gapless(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    longest = max(len((t or "").encode()) for _, t in rows) + 1
    check_shards(rows, sharding.shard_by_bytes(docs).collect(), longest)
    copies = spark.createDataFrame([(i, "a hot text") for i in range(3000)] + [(9000 + i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    out = sharding.shard_by_bytes(copies).collect()
    check_shards([(r.doc_id, r.text) for r in copies.collect()], out, 100)


def test_shards_odd_rows(spark, odd):
    out = sharding.shard_by_bytes(odd).collect()
    check_shards([(r[0], r[1]) for r in odd.collect()], out, float("inf"))
    assert sharding.shard_by_bytes(empty(spark)).count() == 0


# 10: near duplicates

def bag(text):
    w = tokens(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    bags = [bag(t) if bag(t) else Counter({("raw", t or ""): 1}) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    where = defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            where[s].append(i)
    for i, b in enumerate(bags):
        for j in {j for s in b for j in where[s] if j < i}:
            both = sum((b & bags[j]).values())
            if both >= 0.8 * (sum(b.values()) + sum(bags[j].values()) - both) - 1e-9:
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return {i: (min((rows[k][0] is None, rows[k][0] or 0) for k in g), len(g)) for g in groups.values() for i in g}


def check_classes(rows, out):
    want = brute_classes(rows)
    assert Counter((r[0], *(w := want[i])) for i, r in enumerate(rows)) == Counter(
        (r.doc_id, (r.class_id is None, r.class_id or 0), r.class_size) for r in out)


def test_bag_min_hash_is_unbiased():
    rng, errors = np.random.default_rng(0), []
    for _ in range(10):
        u = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        a = rng.integers(0, 9, 60)
        b = np.where(rng.random(60) < 0.6, a, rng.integers(0, 9, 60))
        sig = near_duplicates.bag_min_hash(np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)],
                                           np.r_[u[a > 0], u[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 1000)
        errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04


def test_signature_is_the_same_alone_and_in_a_block():
    rng = np.random.default_rng(3)
    owner = np.repeat(np.arange(200), 30)
    element = rng.integers(0, 1 << 62, len(owner)).astype(np.uint64)
    weight = rng.integers(1, 4, len(owner))
    size = near_duplicates.BANDS * near_duplicates.ROWS
    full = near_duplicates.bag_min_hash(owner, element, weight, 200, size)
    for i in range(20):
        mine = owner == i
        alone = near_duplicates.bag_min_hash(owner[mine] - i, element[mine], weight[mine], 1, size)
        assert (alone[0] == full[i]).all()


def test_near_duplicates_match_brute_force(spark, docs, odd):
    check_classes([(r.doc_id, r.text) for r in docs.collect()], near_duplicates.near_duplicates(docs).collect())
    check_classes([(r[0], r[1]) for r in odd.collect()], near_duplicates.near_duplicates(odd).collect())
    assert near_duplicates.near_duplicates(empty(spark)).count() == 0
    odd = odd.where("doc_id <> 5 or doc_id is null")
    kept = near_duplicates.first_of_each(odd, corpus_pipeline.COLUMNS).collect()
    assert len(kept) == len({r.class_id for r in near_duplicates.near_duplicates(odd).collect()})


def test_chains_of_edits_are_one_class(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    rows, base = [], list(words)
    for i in range(60):  # a hub with many edits, and a chain that walks away from it
        edit = list(words)
        for p in rng.choice(115, 2, replace=False):
            edit[p] = f"x{i}{p}"
        rows.append((i, " ".join(edit)))
    for i in range(60, 75):
        base = base[2:] + [f"y{i}", f"z{i}"]
        rows.append((i, " ".join(base)))
    rows += [(100 + i, " ".join([f"q{i}{k}" for k in range(30)] + words[:25])) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    check_classes(rows, near_duplicates.near_duplicates(table).collect())


def test_rare_pairs_of_texts_with_and_without_repeats(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join(words)), (1, " ".join(words + words[:6])), (2, " ".join(words[:-1] + ["x"] + words[:5])),
            (3, " ".join(words[2:])), (4, " ".join(words[20:] + words[20:])), (5, " ".join(f"v{i}" for i in range(40)))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near_duplicates.signed(table).cache()
    bags = near_duplicates.contents(table, nodes.select("node", "ord", "text_hash"))
    found = near_duplicates.rare_pairs(bags, nodes.select("node", nodes["node"].alias("comp"))).collect()
    name = {bytes(r.node): r.doc_id for r in nodes.collect()}
    got = {tuple(sorted((name[bytes(r.a)], name[bytes(r.b)]))) for r in found}
    bags = {i: bag(t) for i, t in rows}
    alike = {(i, j) for i in bags for j in bags if i < j
             and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())}
    assert {(0, 1), (0, 2), (1, 2)} & alike and alike <= got


# pipeline

def test_pipeline_stages_take_effect(spark):
    docs, sf = read(spark, SF_SMALL, "documents"), SF_SMALL
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before = seen.collect()
        out = stage(spark, seen, sf).cache()
        if name != "sharding":
            assert out.columns == docs.columns
            assert not Counter(map(tuple, out.collect())) - Counter(map(tuple, before))
        if name == "near_duplicates":
            assert out.count() == len({w[0] for w in brute_classes([(r.doc_id, r.text) for r in before]).values()})
        if name == "decontamination":
            bench = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
            dirty = {r[0] for r in brute_hits([(r.doc_id, r.text) for r in before], bench) if r[5]}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in before} - dirty
        seen = out
    assert Counter(r.shard for r in seen.collect()).keys() <= set(range(8)) and seen.count() > 0
