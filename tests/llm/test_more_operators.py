import html
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from needlework.llm import embedding_dedup, html_text, importance, language, mixing, quality_rules, registry, simhash, url_filter
from needlework.llm.common import table
from tests.llm.fixtures import documents, frame
from tests.llm.test_text_operators import brute_components, brute_print, rows_of

PAGES = "page_id long, url string, html string, host string, key long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], PAGES)


# HTML extraction

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div><main><article><header><h1>Head &amp; line</h1></header>
<p>One  <b>two<br>three</b> &lt; four &#233;<script>var x="</p>";</script></p><!-- no --><aside>side</aside><ul><li>a<li>b</ul>
<div class="ad">buy</div><section id="comments"><p>me too</p></section><form><p>mail</p></form><p>last</p></article></main>
<div id="sidebar">links</div><footer>end</footer></body></html>"""


def test_html_roles():
    got = html_text.unique_text(html_text.blocks(PAGE), set())
    assert got == "Head & line\n\nOne two three < four é\n\na\n\nb\n\nlast"
    assert html_text.unique_text(html_text.blocks(None), set()) == "" == html_text.unique_text(html_text.blocks("<p> </p>"), set())
    assert html_text.unique_text(html_text.blocks("a &lt b <unclosed"), set()) == "a < b"


def test_html_articles_of_the_table(spark, sf_dir):
    got = {r["page_id"]: r["text"] for r in html_text.extract(table(spark, sf_dir, "pages")).collect()}
    for row in table(spark, sf_dir, "pages").collect():
        article = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?p>|</?h1>", article)]
        assert got[row["page_id"]] == "\n\n".join(p for p in parts if p)


def test_html_repeats_of_a_host(spark):
    notice = " ".join(f"boiler{i}" for i in range(12))
    rows = [(i, f"http://h.example/{i}", f"<body><p>{notice} own{i} words{i}</p><p>Short {i}</p><p>same line</p></body>") for i in range(6)]
    rows += [(100, "http://other.example/1", f"<p>{notice} lone</p>"), (101, None, None), (102, "http://h.example/z", "")]
    rows += [(200 + i, f"http://two.example/{i}", "<p>copied page with some text that is long enough to count</p>") for i in range(2)]
    rows += [(300 + i, f"http://art.example/{i}", f"<article><p>sign up now</p><p>shared passage</p><p>text {i}</p></article>") for i in range(3)]
    rows += [(400 + i, f"http://big.example/{i}", f"<article><p>sign up now</p><p>text {i}</p></article>") for i in range(8)]
    rows += [rows[0], rows[0]]
    got = defaultdict(set)
    for r in html_text.extract(pages(spark, rows)).collect():
        got[r["page_id"]].add(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[3] == {"own3 words3\n\nShort 3"} and got[0] == {"own0 words0\n\nShort 0"}
    assert got[100] == {f"{notice} lone"} and got[101] == {""} == got[102]
    assert got[200] == {"copied page with some text that is long enough to count"}
    assert got[301] == {"sign up now\n\nshared passage\n\ntext 1"} and got[405] == {"text 5"}
    assert html_text.extract(pages(spark, [])).count() == 0


def article(*texts):
    return "<article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article>"


def words(name, n=20):
    return " ".join(f"{name}{i}" for i in range(n))


def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in html_text.extract(pages(spark, rows)).collect()}


def test_html_copies_weigh_one(spark):
    shared = words("shared")
    rows = [(1, "http://h.example/1", article(shared, words("a")))] * 30 + [(2, "http://h.example/2", article(shared, words("b")))]
    rows += [(10 + i, f"http://h.example/o{i}", article(words(f"o{i}x"))) for i in range(10)]
    rows += [(100 + i, f"http://near.example/{i}", article(words("p", 60), words("q", 60), f"changed {words(f'c{i}x', 9)}")) for i in range(12)]
    rows += [(200 + i, f"http://near.example/o{i}", article(words("p", 60) if i == 0 else words(f"r{i}x", 60), words(f"n{i}x", 60))) for i in range(5)]
    got = texts_of(spark, rows)
    assert got[1] == f"{shared}\n\n{words('a')}" and got[2] == f"{shared}\n\n{words('b')}"
    assert got[105].startswith(words("p", 60)) and got[200].startswith(words("p", 60))


def test_html_text_beside_an_article(spark):
    page = lambda i: f"<p>Skip to the content</p><h1>Head {i}</h1><div class=entry><p>{words(f'w{i}x')}</p></div><article><p>card {i}</p></article>"
    got = texts_of(spark, [(i, f"http://h.example/{i}", page(i)) for i in range(3)])
    assert got == {i: f"Head {i}\n\n{words(f'w{i}x')}\n\ncard {i}" for i in range(3)}


@pytest.mark.parametrize("group", [64, 4])
def test_html_common_runs_inside_paragraphs(spark, monkeypatch, group):
    monkeypatch.setattr(html_text, "GROUP", group)
    sign_up, quoted = words("sign", 9), words("quote", 12)
    rows = [(i, f"http://h.example/{i}", article(words(f"w{i}x", 30) + (" " + sign_up if i < 11 else ""), f"{words(f'v{i}x', 30)} {quoted if i < 10 else ''}")) for i in range(20)]
    got = texts_of(spark, rows)
    assert got == {i: f"{words(f'w{i}x', 30)}\n\n{words(f'v{i}x', 30)}{' ' + quoted if i < 10 else ''}" for i in range(20)}


def test_html_broken_markup_costs_its_length():
    import time

    began = time.process_time()
    for page in ("<p" * 500_000, "<!" * 500_000, "<div>" * 60_000 + "</p>" * 60_000, "<p><article>" + "<div>" * 60_000 + "</p>" * 60_000, '<a b="x\' c=\'>' * 60_000, "<b hidden>" * 40_000 + "<p>x</p>" * 40_000):
        html_text.blocks(page)
    assert time.process_time() - began < 20


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h2 id='related-work'>a</h2><section id='navigation'>b</section><blockquote class='share'>c</blockquote><table class='related'><tr><td>d</td></tr></table><div class='social-history'>e</div></article>", "a b c d e"),
        ("<article><p>a</p><div class='social-share'>x</div><div class='newsletter'>x</div><section id='comments'>x</section><div class='ad banner'>x</div><p>b</p></article>", "a b"),
    ],
)
def test_html_names_inside_an_article(page, text):
    assert html_text.unique_text(html_text.blocks(page), set()).split() == text.split()


def plain_boilerplate(group):
    """(runs to go from other blocks, from articles) as windows, by counting every window and block on every page."""
    met = Counter(w for found in group for w in {w for _, text in found for w in html_text.windows(text)})
    n = len(group)
    return tuple({w for w, k in met.items() if k >= least and k > share * n} for share, least in ((html_text.OTHER_SHARE, html_text.OTHER_PAGES), (html_text.COMMON_SHARE, html_text.COMMON_PAGES)))


def test_html_suffix_array_equals_counting():
    rng = np.random.default_rng(9)
    line = lambda n, k: " ".join(f"t{x}" for x in rng.integers(0, k, n))
    for trial in range(40):
        shared = [line(int(rng.integers(1, 30)), 50) for _ in range(4)]
        group = []
        for _ in range(int(rng.integers(2, 14))):
            texts = [line(int(rng.integers(1, 20)), 3 if trial % 2 else 500) for _ in range(int(rng.integers(0, 5)))]
            for s in shared:
                if rng.random() < 0.6:
                    texts.append(s if rng.random() < 0.5 else f"{line(3, 500)} {s} {line(2, 500)}")
            group.append([(int(rng.integers(1, 3)), t) for t in texts])
        got = [html_text.windows_of(sorted(runs)) for runs in html_text.repeated_runs(group, len(group))]
        assert got == list(plain_boilerplate(group)), trial


@pytest.mark.parametrize("size", [64, 5])
def test_html_hosts_equal_counting(spark, monkeypatch, size):
    """Whole hosts, of one group and of several, against counting in plain Python."""
    monkeypatch.setattr(html_text, "GROUP", size)
    rng = np.random.default_rng(10)
    line = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 5000, n))
    rows, hosts = [], defaultdict(list)
    for host in range(3):
        notes = [line(12), line(3), line(25), line(9)]
        for i in range((4, 9, 23)[host]):
            parts = [(line(40), "p") for _ in range(2)] + [(notes[k], "p") for k in range(4) if rng.random() < (0.9, 0.7, 0.5, 0.3)[k]]
            inner, outer = parts[: len(parts) // 2 + 1], parts[len(parts) // 2 + 1 :]
            page = "<article>" + "".join(f"<p>{t}</p>" for t, _ in inner) + "</article>" + "".join(f"<p>{t}</p>" for t, _ in outer)
            rows.append((100 * host + i, f"http://h{host}.example/{i}", page))
            hosts[host].append(html_text.blocks(page))
    want, changed = {}, 0
    for host, group in hosts.items():
        other, article = plain_boilerplate(group)
        for i, found in enumerate(group):
            want[100 * host + i] = html_text.unique_text(found, other, article)
            changed += want[100 * host + i] != html_text.unique_text(found, set())
    assert texts_of(spark, rows) == want and changed > 10


# URL filters


def brute_verdicts(rows, rules):
    def locate(url):
        if url is None or "://" not in url:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]

    def rule_of(host, path):
        fit = []
        for said, rule in rules:
            name, slash, rest = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
                fit.append((len(rule), rule, said))
        return max(fit)[1:] if fit else (None, None)

    edges, good, bad, out = Counter(), Counter(), Counter(), []
    for key, url, page in rows:
        host, path = locate(url)
        rule, said = rule_of(host, path)
        out.append([key, host, path, rule, said])
        if said and host:
            (good if said == "allow" else bad)[host] += 1
        for link in re.findall(r"""<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)""", page or "", re.I):
            if host and link.lower() != host:
                edges[host, link.lower()] += 1
    total = sum(good.values()) + sum(bad.values()) or 1

    def rank(edges, mass):
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        start = {h: 0.15 * m / total for h, m in mass.items()}
        now = dict(start)
        for _ in range(url_filter.STEPS if edges else 0):
            new = Counter(start)
            for (a, b), n in edges.items():
                new[b] += 0.85 * n / out[a] * now.get(a, 0)
            now = new
        return now

    trust, distrust = rank(edges, good), rank(Counter({(b, a): n for (a, b), n in edges.items()}), bad)
    for row in out:
        row[4] = row[4] or ("block" if distrust.get(row[1], 0) > url_filter.DISTRUST * trust.get(row[1], 0) else "allow")
    return sorted(map(tuple, out), key=repr)


def test_url_filter_equals_brute_force(spark, sf_dir):
    rows = [
        (1, "HTTP://A.Example.ORG/es/x?q#f", ""), (2, "https://example.org/en/12", None), (3, "https://badexample.org/en/1", "<a href='//spam.net/x'>s</a>"),
        (4, "http://de.com/de/1", "<a href=http://spam.net/>s</a>"), (5, "spam.net/no", ""), (6, None, None), (7, "http://spam.net", "<a class=x href=\"http://de.com/\">t</a>"),
        (8, "http://friend.info/a", "<A HREF='https://de.com/q'>t</A><a href='http://nice.net/'>n</a>"), (9, "http://nice.net/", ""), (10, "http://org/", "<a href='http://nice.net'>x</a>"),
        (10, "http://org/", "<a href='http://nice.net'>x</a>"), (None, "http://x.org?y", ""), (11, "://", ""), (12, "http://fr.com/fr/", "<a href=//de.com>x</a>"),
    ]
    names = ("page_id", "host", "path", "rule", "verdict")
    for data in (rows, [(r["page_id"], r["url"], r["html"]) for r in table(spark, sf_dir, "pages").collect()], []):
        got = url_filter.judge(pages(spark, data)).select(*names)
        assert rows_of(got) == brute_verdicts(data, url_filter.RULES)
    verdict = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages(spark, rows)).collect()}
    assert verdict[8] == "block" and verdict[9] == "allow"


def test_url_filter_of_broken_pages(spark):
    import time

    rows = [(i, f"http://h{i}.net/", page) for i, page in enumerate(["<a " * 300_000, "<a href=" * 100_000, "<a href=//x.org " + "<a " * 200_000, "<a " + "href " * 200_000])]
    began = time.perf_counter()
    assert url_filter.host_edges(pages(spark, rows)).collect() == [("h2.net", "x.org", 1)]
    assert time.perf_counter() - began < 60


# Embeddings


def brute_links(rows):
    good = [(k, np.array(v, np.float64)) for k, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, pairs = Counter(), []
    for i, (_, a) in enumerate(good):
        for j in range(i):
            b = good[j][1]
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links[i] += 1
                links[j] += 1
                pairs.append((j, i))
    group, least = brute_components(range(len(good)), pairs), {}
    for i, (k, _) in enumerate(good):
        if k is not None:
            least[group[i]] = min(k, least.get(group[i], k))
    ok = {id(v) for _, v in good}
    out = [(k, links[i], least.get(group[i])) for i, (k, _) in enumerate(good)]
    bad = [(k, 0, k) for k, v in rows if not (v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v))]
    assert len(ok) == len(good)
    return sorted(((k, n, c, k is not None and k == c) for k, n, c in out + bad), key=repr)


def embedding_rows():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((400, 32)).astype(np.float32)
    near = [base[i % 60] + rng.standard_normal(32).astype(np.float32) * 0.1 for i in range(300)]
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *near, *base[:20]])]
    rows += [(2000, None), (2001, [0.0] * 32), (2002, [1.0, None] + [0.0] * 30), (2003, [float("nan")] + [1.0] * 31), (2004, [float("inf")] * 32), (2005, []), (2006, [1.0, 2.0])]
    return rows + [(2007, [1e-30] * 32), (2008, [1e30] * 32), (None, base[0].tolist()), rows[0], rows[0], (2009, [-0.0] * 31 + [1.0]), (2010, [0.0] * 31 + [1.0])]


@pytest.mark.parametrize(("leaf", "block"), [(512, 4096), (64, 40)])
def test_embedding_links_equal_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = embedding_rows()
    df = spark.createDataFrame([(k, v, 1, 1) for k, v in rows], "vec_id long, embedding array<float>, label int, n long")
    got, want = rows_of(embedding_dedup.near_duplicates(df)), brute_links(rows)
    assert len(got) == len(want)
    found, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= all_ and found >= (all_ if leaf == 512 else 0.98 * all_)
    if leaf == 512:
        assert got == want
    assert embedding_dedup.near_duplicates(df.where("1 = 0")).count() == 0


def test_embeddings_in_double_precision(spark):
    close, base = 1 + 1e-12, [1e150, 1e150, 0.0]
    edge = lambda c: [c, (1 - c * c) ** 0.5, 0.0]
    rows = [(0, base), (1, [x * close for x in base]), (2, [1.0, 0.0, 0.0]), (3, edge(0.95 + 1e-9)), (4, edge(0.95 - 1e-9)), (None, [0.0, 0.0, 5.0])]
    rows += [(5 + i, [1.0, 0.0, 1e-3 * i, 0.5]) for i in range(2)] + [(None, [0.0, 0.0, 5.1])]
    got = rows_of(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == brute_links(rows) and [r[1] for r in got if r[0] in (2, 3, 4)] == [1, 2, 1]


def test_forest_is_bounded():
    sample = np.random.default_rng(3).standard_normal((2000, 8))
    forest = embedding_dedup.Forest(embedding_dedup._unit(sample), 20)
    assert max(np.size(at) for tree in forest.thresholds for at in tree) == 1 << (embedding_dedup.SAMPLED - 1)
    row, leaf = forest.leaves(embedding_dedup._unit(sample[:50]), 3)
    table = forest.listed(embedding_dedup._unit(sample[:50]), 3)
    assert {(r, v) for r, v in zip(row.tolist(), leaf.tolist(), strict=True)} == {(r, int(v)) for r in range(50) for v in table[r] if v >= 0}
    assert leaf.min() >= 3 << 20 and leaf.max() < 4 << 20


# Language


def test_language_held_out(spark, sf_dir):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(docs).join(docs, "doc_id").where("held_out")
    right = got.where("lang_pred = lang").count()
    assert right >= 0.98 * got.count() > 0


def plain_counts(text):
    raw, out = (" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode(), Counter()
    for n in language.ORDERS:
        for at in range(len(raw) - n + 1):
            h = 0
            for b in raw[at : at + n]:
                h = (h * 0x01000193 + b) % 2**32
            out[(h + n) * 0x9E3779B1 % 2**32 >> 21] += 1
    return out


def test_language_equals_the_plain_method(spark, monkeypatch):
    """n-grams, document frequencies and the nearest centroid, in plain Python."""
    import math

    monkeypatch.setattr(language, "BLOCK", 50)  # texts go on over blocks
    rng = np.random.default_rng(4)
    voc = {"xx": ["der", "die", "das", "und", "ähre"], "yy": ["the", "and", "of", "word"], "zz": ["les", "été", "que", "une"]}
    rows = [(i, " ".join(rng.choice(voc[k], int(rng.integers(1, 40)))) + rng.choice(["", " 12!", ".", "\n"]), k) for i, k in enumerate(rng.choice(list(voc), 90).tolist())]
    each = [plain_counts(t) for _, t, _ in rows]
    for (_, text, _), want in zip(rows, each, strict=True):
        got = language.counts(text)
        assert {k: int(got[k]) for k in np.flatnonzero(got)} == want
    model = language.fit(frame(spark, [(i, t, k, None, None, None, None) for i, t, k in rows]))
    found = Counter(p for c in each for p in c)
    assert np.allclose(model.idf, [math.log((1 + len(rows)) / (1 + found[p])) + 1 for p in range(language.DIM)])
    assert sorted(set(model.labels)) == sorted(voc) and len(model.labels) == 3 * language.CENTROIDS
    for (_, text, k), c in zip(rows, each, strict=True):
        v = {p: (1 + math.log(n)) * model.idf[p] for p, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(centre[p]) for p, x in v.items()) / norm for centre in model.centres]
        lang, score, _ = model.predict(text)
        assert lang == k and score == pytest.approx(max(cosines), abs=1e-4)


def test_language_awkward(spark):
    rows = [(i, f"wort{'abc'[i % 3]} und der die das ist" if i % 2 else "the and word of it is", "de" if i % 2 else "en", None, None, None, None) for i in range(40)]
    rows += [(100, None, "en", None, None, None, None), (101, "12 !", None, None, None, None, None), (102, "", "en", None, None, None, None), (None, "the of and", None, None, None, None, None)]
    got = {r["doc_id"]: (r["lang_pred"], r["held_out"], r["score"]) for r in language.identify(frame(spark, rows)).collect()}
    assert all(got[i][0] == "und" and got[i][2] == 0 for i in (100, 101, 102)) and got[None][:2] == ("en", False)
    assert all(got[i][0] == ("de" if i % 2 else "en") and 0 <= got[i][2] <= 1 for i in range(40))
    assert {r["lang_pred"] for r in language.identify(frame(spark, [(1, "text", None, None, None, None, None)])).collect()} == {"und"}
    assert language.identify(frame(spark, [])).count() == 0


# Mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, rest = {}, list(names), float(sum(sizes.values()))
    while True:
        share = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * share > 3 * sizes[s]]
        if not over:
            return target | {s: weight[s] * share for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
            free.remove(s)


@pytest.mark.parametrize("run", [500, 7])
def test_mixing(spark, sf_dir, monkeypatch, run):
    monkeypatch.setattr(mixing, "RUN", run)
    for rows, df in (
        ([(r["doc_id"], r["text"], r["source"]) for r in table(spark, sf_dir, "documents").collect()], table(spark, sf_dir, "documents")),
        ([(r[0], r[1], r[3]) for r in documents()], frame(spark)),
        ([(i, "w " * (i % 9 + 1), "a" if i < 900 else f"b{i % 7}") for i in range(1000)], frame(spark, [(i, "w " * (i % 9 + 1), None, "a" if i < 900 else f"b{i % 7}", None, None, None) for i in range(1000)])),
        ([], frame(spark, [])),
    ):
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        totals = Counter()
        for _, t, s in rows:
            totals[s] += size(t)
        targets = brute_targets(totals) if rows else {}
        got = rows_of(mixing.report(df))
        assert sorted((r[0], r[1], r[2]) for r in got if r[0] is not None) == sorted((k, size(t), totals[s]) for k, t, s in rows if k is not None)
        assert got == rows_of(mixing.report(df))
        taken = defaultdict(int)
        for r in mixing.plan(df).collect():
            assert 0 <= r["copies"] <= 3 and r["target"] == pytest.approx(targets[r["source"]])
            taken[r["source"]] += r["copies"] * r["size"]
        for s, goal in targets.items():
            assert abs(taken[s] - goal) <= max([size(t) for _, t, own in rows if own == s] + [0]), s
        mixed = Counter(map(tuple, mixing.mix(df).collect()))
        words = Counter()
        for r, n in mixed.items():
            words[r[df.columns.index("source")]] += n * size(r[df.columns.index("text")])
        assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_rounding_keeps_mass_and_expectation():
    """Each run of pairs: the words stay what they were, all but one document are whole, and each is taken as often as its fraction says."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    size, p, rounds = np.array([5.0, 1, 30, 7, 7, 2, 90, 3, 4, 11, 6]), np.array([0.3, 0.9, 0.5, 0.1, 0.7, 0.2, 0.6, 0.4, 0.8, 0.25, 0.5]), 4000
    names = ["run", *[c.strip().split()[0] for c in mixing.ROW.split(",")]]
    n, ends = len(size), np.zeros((rounds, len(size)))
    column = {"run": np.repeat(np.arange(rounds), n), "tie": np.tile(np.arange(n), rounds), "doc_id": np.tile(np.arange(n), rounds), "row_hash": np.repeat(np.arange(rounds), n)}
    column |= {"source": ["s"] * n * rounds, "size": np.tile(size.astype(int), rounds), "source_size": [1] * n * rounds, "target": [1.0] * n * rounds, "copies": np.zeros(n * rounds, np.int32)}
    column |= {"p": np.tile(p, rounds), "u": [[x] for x in rng.random(n * rounds)]}
    whole = pa.record_batch([pa.array(column[k]) for k in names], names=names)
    batches = [whole.slice(at, 257) for at in range(0, len(whole), 257)]  # runs go on over batches
    for out in mixing._rounded(0)(iter(batches)):
        for r in out.to_pylist():
            ends[r["row_hash"], r["doc_id"]] = r["copies"] + r["p"]
    assert np.allclose(ends @ size, p @ size) and ((ends % 1 != 0).sum(axis=1) <= 1).all()
    assert (np.abs(ends.mean(axis=0) - p) < 4 * np.sqrt(p * (1 - p) / rounds)).all()


def test_mixing_draws_copies_one_by_one(spark):
    rows = [(1, "w " * 10, None, "a", None, None, None)] * 3000 + [(2, "w " * 10, None, "b", None, None, None)] * 3000
    got = mixing.plan(frame(spark, rows)).groupBy("doc_id", "target").agg({"copies": "sum", "*": "count"}).collect()
    for r in got:  # 3,000 rows alike take about the target, not all or none
        assert r["count(1)"] == 3000 and abs(r["sum(copies)"] * 10 - r["target"]) <= 10
    assert mixing.mix(frame(spark, rows)).count() == sum(r["sum(copies)"] for r in got)


# Importance resampling


def plain_resampling(rows, good):
    """The whole method in plain Python: n-grams to places, two models, summed log ratios, Gumbel noise, the k largest."""
    import math
    import zlib

    import xxhash

    def places(text):
        raw, out = (text or "").encode(), Counter()
        hs = [zlib.crc32(w) for w in raw.split()]
        out.update(h % importance.PLACES for h in hs)
        out.update((((a * 0x9E3779B1) % 2**32 ^ (b * 0x85EBCA6B) % 2**32) >> 7) % importance.PLACES for a, b in zip(hs, hs[1:], strict=False))
        kind = [int(importance._CLASS[c]) for c in raw]
        for a, b, c in zip(kind, kind[1:], kind[2:], strict=False):
            out[importance.PLACES + (((a * 0x9E3779B1) % 2**32 ^ (b * 0x85EBCA6B) % 2**32 ^ (c * 0xC2B2AE35) % 2**32) >> 11) % importance.PLACES] += 1
        return out

    raw, target, each = Counter(), Counter(), [places(t) for _, t in rows]
    for (key, _), found in zip(rows, each, strict=True):
        raw.update(found)
        target.update(found if key in good else {})
    half = lambda place: place >= importance.PLACES
    n, m = ([sum(v for k, v in c.items() if half(k) == f) for f in (False, True)] for c in (raw, target))
    ratio = {}
    for place, count in raw.items():
        p = count / n[half(place)]
        ratio[place] = math.log((target[place] + importance.PLACES * p) / (m[half(place)] + importance.PLACES)) - math.log(p)
    out = []
    for (key, _), found in zip(rows, each, strict=True):
        score = sum(c * ratio[place] for place, c in found.items())
        h = xxhash.xxh64_intdigest(b"gumbel", 42)
        h = h if key is None else xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), h)
        out.append((key, score, score - math.log(-math.log(((h >> 12) + 0.5) * 2.0**-52))))
    k = sum(s >= -importance.MARGIN for _, s, _ in out)
    least = sorted((v for _, _, v in out), reverse=True)[k - 1]
    return sorted((key, round(s, 6), v >= least) for key, s, v in out)


def test_importance_equals_the_plain_method(spark):
    rng = np.random.default_rng(8)
    clean, noise = [f"word{i}" for i in range(60)], [f"x#{i}$" for i in range(60)]
    text = lambda share: " ".join(rng.choice(clean if rng.random() < share else noise) for _ in range(int(rng.integers(1, 12))))
    rows = [(i, text(0.95 if i % 3 else 0.3)) for i in range(600)] + [(1000, ""), (1001, None)]
    good = {i for i in range(600) if i % 3 and i % 2}
    labels = spark.createDataFrame([(i, 1) for i in good] + [(0, 0)], "doc_id long, quality int")
    df = frame(spark, [(k, t, None, None, None, None, None) for k, t in rows])
    got = sorted((r["doc_id"], round(r["score"], 6), r["kept"]) for r in importance.classify(df, labels).collect())
    want = plain_resampling(rows, good)
    assert got == want
    assert any(kept != (score >= -importance.MARGIN) for _, score, kept in got)  # the noise decides near the border
    assert {r["doc_id"] for r in importance.keep(df, labels).collect()} == {k for k, _, kept in want if kept}


def test_importance_on_the_table(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    met = importance.classify(docs, labels).join(labels, "doc_id")
    good, bad = met.where("quality = 1"), met.where("quality = 0")
    assert good.where("kept").count() >= 0.99 * good.count() and bad.where("not kept").count() >= 0.9 * bad.count()
    assert set(rows_of(importance.keep(docs, labels).select("doc_id"))) == set(rows_of(importance.classify(docs, labels).where("kept").select("doc_id")))


def test_importance_awkward(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, score int")
    df = frame(spark)
    assert importance.classify(df, labels).count() == df.count()
    assert importance.classify(df, labels.where("1 = 0")).where("kept").count() == df.count()
    assert importance.keep(frame(spark, []), labels).count() == 0
    assert importance.keep(df, labels).columns == df.columns


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    values = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 500)] + [5, 5, 5, -1, 0, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "value long")
    for k in (1, 2, 250, 400, len(values)):
        assert importance._kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


# The pipeline


def test_simhash_keep_of_many_copies(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(7, text, "en", "s", 1, None, None)] * 20_000 + [(3, text + " tail", "en", "s", 1, None, None)] * 2 + [(9, "other words here now", "en", "s", 1, None, None)]
    assert sorted(r["doc_id"] for r in simhash.keep(frame(spark, rows)).collect()) == [3, 9]


def test_simhash_keep(spark):
    df = frame(spark)
    kept = simhash.keep(df).collect()
    prints = [brute_print(r["text"]) for r in kept]
    everything = {brute_print(r[1]) for r in documents()}
    near = lambda a, b: (a ^ b).bit_count() <= 4
    values = sorted(everything)
    group = brute_components(values, [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if near(a, b)])
    assert sorted(group[p] for p in prints) == sorted(set(group.values()))
    assert simhash.keep(frame(spark, [])).count() == 0


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for k, (_, apply) in enumerate(corpus_pipeline.STAGES):
        before = docs
        apply(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if k == 0:
            assert set(rows_of(docs.select("doc_id"))) == set(rows_of(quality_rules.judge(before).where("kept").select("doc_id")))
        elif k == 2:
            best = simhash.near_duplicates(before).where("doc_id = component_id").select("doc_id")
            assert rows_of(docs.select("doc_id")) == rows_of(best)
        elif k == 3:
            taken = Counter({r[0]: r[4] // r[1] for r in rows_of(mixing.report(before)) if r[4]})
            assert Counter(r[0] for r in rows_of(docs.select("doc_id"))) == taken
        elif k == 4:
            assert docs.count() == before.count()
    assert rows_of(corpus_pipeline.run(spark, sf_dir)) == rows_of(docs)


def test_every_query_runs(spark, sf_dir):
    for name in ("op1_html_text", "op5_quality_classifier", "op7_url_filter", "op8_embedding_dedup", "op9_language", "op10_mixing"):
        assert registry.queries()[name](spark, sf_dir).count() > 0, name


def test_html_names_of_containers():
    page = '<div class="page-with-sidebar has_ads"><div class=topNav>menu</div><div class="mainFooter">end</div><div class="SideBar">s</div><p class="commentary">kept</p><div id=adBox class="ad-box">ad</div><p>text</p></div>'
    assert html_text.unique_text(html_text.blocks(page), set()) == "kept\n\ntext"


@pytest.mark.parametrize(
    "page",
    [
        '<div id="page" class="site"><article><p>kept</p></article></div>',
        '<div id="page" class="site hfeed"><div class="entry"><p>kept</p></div><div class="site-footer">end</div></div>',
        '<div class="content-sidebar-wrap"><p>kept</p></div><div class="sidebar">s</div><div class="sidebar-content">s</div>',
        '<div class="layout-sidebar"><p>kept</p><div id="left-sidebar">s</div></div>',
        '<article class="post category-social tag-newsletter"><p>kept</p><div class="social-share">s</div></article>',
        '<div class="post category-social tag-newsletter"><p>kept</p></div>',
        '<div class="banner"><div class="promo"><main><p>kept</p></main></div></div><div class="related-stories">r</div>',
        '<article><h2 id="cookie-recipe">kept</h2><section id="comments"><article>c</article></section></article>',
        '<div class="entry-header"><h1>kept</h1></div><div class="page-header">h</div><div id="cookie-notice">c</div>',
        '<section id="share-prices-fall"><p>kept</p></section><div class="acme-nav">n</div><div id="div-comment-12">c</div>',
    ],
)
def test_html_names_of_roles(page):
    assert html_text.unique_text(html_text.blocks(page), set()) == "kept"


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, k string, h long, score string, n_words string, value string, fp string, size string"


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_awkward_rows(spark, sf_dir, tmp_path, empty):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns named like those of the operators."""
    words = " ".join(f"word{i} and the" for i in range(30))
    rows = [(*r[:5], "k", 1, "s", "w", "v", "f", "z") for r in documents()] + [(900 + i, f"{words} {i}", "en", f"s{i % 2}", 1, None, None, None, None, None, None, None) for i in range(5)]
    rows += [rows[-1], rows[-1], (None, words + " null key", None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame([] if empty else rows, AWKWARD)
    columns = docs.columns
    for k, (_, apply) in enumerate(corpus_pipeline.STAGES):
        apply(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        assert empty == (docs.count() == 0), k
    names = {"op2": lambda d: corpus_pipeline.tokens(spark, d, sf_dir), "op3": quality_rules.judge, "op4": simhash.near_duplicates, "op9": language.identify, "op10": mixing.report}
    whole = spark.createDataFrame([] if empty else rows, AWKWARD)
    for name, apply in names.items():
        assert apply(whole).count() == whole.count(), name
