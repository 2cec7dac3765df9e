"""Near-duplicates, toxicity, page text, personal data and nearest neighbours."""

import math
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import ann, html_text, near_dedup, pii, toxicity

EMPTY = "doc_id bigint, text string"
ROOT = str(Path(__file__).resolve().parents[2])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EMPTY)


# near-duplicates


def brute_components(rows, k, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {d: shingles(t) for d, t in rows if d is not None}
    comp = {d: d for d in sets}

    def find(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def family(seed, n, words=60, edits=6):
    """Near copies of one text, some of them only similar to some others."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randint(0, edits)):
            t[rnd.randrange(words)] = f"e{rnd.randint(0, 10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, monkeypatch, k):
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    texts = [t for s in range(4) for t in family(s, 25)] + ["", None, "one", "ONE", "a b", "a b c d e", "A b c d e", "common line here " * 3] * 2
    rows = [(10 * i + 3, t) for i, t in enumerate(texts)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, EMPTY).withColumn("comp", F.lit("clash")), k, 80).collect()
    want = brute_components(rows, k, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates_edges(spark, nothing):
    df = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "a b c"), (5, "A B C"), (None, None)], EMPTY)
    rows = near_dedup.near_duplicates(df, 2, 80).collect()
    assert sorted(str(r["component_id"]) for r in rows) == ["2", "2", "2", "2", "None"]
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert sorted(str(r["doc_id"]) for r in near_dedup.keep_one(df, 2).collect()) == ["2", "None", "None"]  # repeated rows stay once


# toxicity


def toxic_corpus(n=600):
    rnd = random.Random(4)
    clean = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rnd.choices(clean, k=8)) for _ in range(rnd.randint(1, 12))]
        bad = rnd.random() < 0.2
        if bad:
            sentences[rnd.randrange(len(sentences))] += rnd.choice([" vile", " nasty", " horridly"])
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity(spark, nothing):
    docs, labels = toxic_corpus()
    df = spark.createDataFrame([*docs, (9001, None), (9002, ""), (None, "x"), (9003, "clean " * 20_000)], EMPTY).withColumns({"score": F.lit(1), "toxic": F.lit(9)})
    lab = spark.createDataFrame([*labels, (9001, None), (77, 5)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity(df, lab).collect()
    assert len(rows) == len(docs) + 4 and all(0 <= r["score"] <= 1 for r in rows)
    truth = dict(labels)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.98
    text = dict(docs)
    for r in held:
        for s in r["sentences"]:
            assert re.search("vile|nasty|horridly", text[r["doc_id"]][s["start"] : s["end"]])
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] in (9001, 9002, 9003, None))


def test_toxicity_without_labels(spark, nothing):
    df = spark.createDataFrame([(1, "a")], EMPTY)
    assert toxicity.toxicity(df, spark.createDataFrame([], "doc_id bigint, toxic int")).first()["predicted"] == 0
    assert toxicity.toxicity(nothing, spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")).count() == 0


# pages

SHELL = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>Home</a></nav>{}<footer>&copy; all of us</footer></body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>T &amp; U</h1><p>a  b<p><b>c</b>d<br>e</article><aside>x</aside>", "T & U a b cd e"),
        ('<main><p>m</p><div class="cookie-notice">no</div><form>q</form><script>var a="</p>";</script></main>', "m"),
        ('<article>x<!-- a > b --><section id="comments"><p>nice</p></section></article>', "x"),
        ('<article><div class="adventure">kept</div><div class="ad">gone</div></article>', "kept"),
        ("<article></article>", ""),
    ],
)
def test_structure(spark, body, want):
    df = spark.createDataFrame([(1, "https://a.b/c", SHELL.format(body))], "page_id bigint, url string, html string")
    assert [tuple(r) for r in html_text.extract_text(df).collect()] == [(1, "https://a.b/c", want, len(want))]


def test_suffix_array_removes_host_boilerplate(spark):
    line = "please visit our lovely shop for more offers today"
    rows = [(i, f"http://h.x/{i}", f"<div><p>{line}</p><p>unique text number {i} about subject {i * 7} and nothing else</p></div>") for i in range(8)]
    rows += [(99, "http://other.x/1", f"<div><p>{line}</p></div>"), (100, None, None), (101, "http://h.x/e", ""), (101, "http://h.x/e", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("clash"), "host": F.lit("clash")}).repartition(3)
    out = {}
    for r in html_text.extract_text(df).collect():
        out.setdefault(r["page_id"], []).append(r["text"])
    assert all(out[i] == [f"unique text number {i} about subject {i * 7} and nothing else"] for i in range(8))
    assert out[99] == [line] and out[100] == [""] and out[101] == ["", ""]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_host_substrings_count_distinct_pages():
    pages = [["a b c d e f g"], ["x a b c d e f"], ["a b c d e f a b c d e f"], ["k"]]
    got = html_text.host_substrings(pages)
    brute = {}
    for p in pages:
        for g in {g for block in p for g in html_text.grams(block)}:
            brute[g] = brute.get(g, 0) + 1
    assert got == brute and max(got.values()) == 3


def test_repeats_of_any_length_are_covered():
    """A token goes if it lies in a substring of GRAM tokens or more that is on three pages."""
    rnd = random.Random(4)
    runs = [[f"r{k}.{i}" for i in range(n)] for k, n in enumerate((4, 6, 7, 13, 30))]
    pages = []
    for p in range(9):
        t = [f"u{p}.{i}" for i in range(rnd.randint(3, 12))]
        for run in rnd.sample(runs, 3):
            at, cut = rnd.randint(0, len(t)), rnd.randint(0, 3)
            t[at:at] = run[cut:]
        pages.append(t)
    where = {}  # every substring of GRAM tokens and more, of any length, and the pages it is on
    for p, t in enumerate(pages):
        for i in range(len(t)):
            for j in range(i + html_text.GRAM, len(t) + 1):
                where.setdefault(tuple(t[i:j]), set()).add(p)
    counts = html_text.host_substrings([[" ".join(t)] for t in pages])
    boilerplate = {g for g, n in counts.items() if n >= 3}
    for t in pages:
        gone = set()
        for i in range(len(t)):
            for j in range(i + html_text.GRAM, len(t) + 1):
                if len(where[tuple(t[i:j])]) >= 3:
                    gone |= set(range(i, j))
        want = " ".join(w for i, w in enumerate(t) if i not in gone)
        assert html_text.uncovered([" ".join(t)], boilerplate) == ([want] if want else [])
    assert boilerplate


def test_doubtful_parts_of_articles_are_decided_by_the_host(spark):
    """Inside an article a related or share box stays unless the host's pages repeat it."""
    share = "share this story with your friends on every network now"
    body = "<article><p>story {0}</p><div class='related'>a background of matter {0} that no other page tells</div><div class='share-bar'>" + share + "</div><div class='advert'>buy {0}</div></article>"
    rows = [(i, f"http://h.x/{i}", SHELL.format(body.format(i))) for i in range(5)] + [(9, "http://o.x/", SHELL.format(body.format(9)))]
    out = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(out[i] == f"story {i} a background of matter {i} that no other page tells" for i in range(5))
    assert out[9] == f"story 9 a background of matter 9 that no other page tells {share}"


@pytest.mark.parametrize("grams", [1 << 21, 0])
def test_the_host_decides_on_articles(spark, monkeypatch, grams):
    """Of several articles the ones that pages share go, and so does a notice that most
    articles of a host have; a line that fewer have stays, and so do copies of an article."""
    monkeypatch.setattr(html_text, "BROADCAST_GRAMS", grams)
    teaser, notice, line = "our most read story of the week is this one here", "all of this site closes for works on friday night", "as the old saying goes you reap what you sow"
    copied = "one report that was printed by every paper of the town with all its words"
    rows = [(i, f"http://h.x/{i}", SHELL.format(f"<article><h1>Story {i}</h1><p>page {i} tells of {i * 7} things and of {i * 11} more{' and more' * (i + 9)}</p><p>{notice}</p>{f'<p>{line}</p>' if i < 4 else ''}</article><article class='card'>{teaser}</article>")) for i in range(12)]
    rows += [(100 + i, f"http://h.x/c{i}", SHELL.format(f"<article><p>{copied}</p><p>{notice}</p></article><div>{i}</div>")) for i in range(4)]
    rows += [(200 + i, f"http://small.x/{i}", SHELL.format(f"<article><p>page {i} has {i * 7} things and {i * 11} more to tell you</p><p>{line}</p></article>")) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    out = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    for i in range(12):
        assert out[i] == f"Story {i} page {i} tells of {i * 7} things and of {i * 11} more{' and more' * (i + 9)}" + (f" {line}" if i < 4 else "")
    assert all(out[100 + i] == copied for i in range(4))
    assert all(out[200 + i] == f"page {i} has {i * 7} things and {i * 11} more to tell you {line}" for i in range(3))


def test_long_pages_without_article(spark):
    """Whole texts: a page of 60,000 tokens loses its menu only."""
    menu = "home news sport weather travel money culture contact imprint"
    rows = [(i, f"http://h.x/{i}", f"<div>{menu}</div><div>{' '.join(f'w{i}.{j}' for j in range(60_000 if i == 2 else 30))}</div>") for i in range(4)]
    out = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(out[i] == " ".join(f"w{i}.{j}" for j in range(60_000 if i == 2 else 30)) for i in range(4))


def test_workers_need_no_repository(tmp_path):
    """Workers that cannot import this package run the operators with Python code."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()
from sluice.llm import ann, html_text, near_dedup, packing, pii, toxicity
pages = spark.createDataFrame([(1, 'http://a.b/c', '<article>x<div class="share">y</div></article>'), (2, 'http://a.b/d', '<p>z</p>')], 'page_id bigint, url string, html string')
docs = spark.createDataFrame([(i, 'a b c d e ' * 3 + str(i % 2)) for i in range(6)], 'doc_id bigint, text string')
labels = spark.createDataFrame([(i, i % 2) for i in range(6)], 'doc_id bigint, toxic int')
vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], 'vec_id bigint, embedding array<double>')
print('ROWS', html_text.extract_text(pages).count(), near_dedup.near_duplicates(docs).count(), packing.pack(docs, None).count() > 0, pii.find_pii(docs).count(), toxicity.toxicity(docs, labels).count(), ann.search(vectors).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 2 6 True 6 6 60" in done.stdout, done.stderr[-2000:]


def test_odd_markup_ends():
    for h in ("<", "<a href='x>y", "<!-- x", "<script>1", "<p>a</b></i></p>" * 50, "<div " * 1000, "a" * 200_000, "<x y=\"" * 2000):
        html_text.zoned(h)


# personal data


def brute_pii(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 14 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rnd = random.Random(2)
    for _ in range(5000):
        t = "".join(rnd.choice("a1.@+ -()2é") for _ in range(rnd.randint(0, 40)))
        assert sorted(pii.base_spans(t)) == brute_pii(t), t


def test_added_spans_follow_context():
    model = pii.train()
    kinds = lambda t: [pii.KINDS[k] for _, k, _ in pii.find_spans(t, model)]
    assert kinds("call me: phone (415) 555-2671 today") == ["phone_local"]
    assert kinds("order 415-555-2671 was shipped") == []
    assert kinds("his ssn 123-45-6789 is private") == ["ssn"]
    assert kinds("bank iban DE89 3704 0044 0532 0130 00 thanks") == ["iban"]
    assert pii.redact("mail a@b.co now", model) == "mail [email] now"


def test_held_out_precision():
    model, rows = pii.train(), pii.examples(800, 99)
    p = model([pii.features(*r[:4]) for r in rows])
    hit = [bool(q >= model.thresholds[r[2]]) for q, r in zip(p, rows, strict=True)]
    labels = [r[4] for r in rows]
    assert sum(h and y for h, y in zip(hit, labels, strict=True)) / max(1, sum(hit)) >= 0.95
    assert sum(h and y for h, y in zip(hit, labels, strict=True)) / sum(labels) >= 0.5


def test_boilerplate_does_not_depend_on_the_size_of_the_host(spark):
    """A notice on 5 of 600 pages goes; text that only copies of one page share stays."""
    notice, copied = "this part of the site moves to another place soon", "a story that was put up four times in a row"
    rows = [(i, f"http://h.x/{i}", f"<div>{f'<p>{notice}</p>' if i < 5 else ''}<p>number {i} speaks of {i * 7} and of {i * 11} alone</p></div>") for i in range(600)]
    rows += [(1000 + i, f"http://h.x/c{i}", f"<div><p>{copied}</p></div>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    out = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert all(out[i] == f"number {i} speaks of {i * 7} and of {i * 11} alone" for i in range(600))
    assert all(out[1000 + i] == copied for i in range(4))


def test_pii_query(spark, nothing):
    df = spark.createDataFrame([(1, "x a@b.cd"), (None, None), (1, "x a@b.cd"), (3, "")], EMPTY).withColumn("found", F.lit("clash"))
    assert sorted(len(r["found"]) for r in pii.find_pii(df).collect()) == [0, 0, 1, 1]
    assert pii.find_pii(nothing).count() == 0


# nearest neighbours


@pytest.mark.parametrize("blocks", [None, (40, 700)])
def test_ann_recall_and_ties(spark, monkeypatch, blocks):
    if blocks:  # several blocks on both sides of the grid
        monkeypatch.setattr(ann, "BLOCK_QUERIES", blocks[0])
        monkeypatch.setattr(ann, "STRIPE_CODES", blocks[1])
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:160] = x[100]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] * 24), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    got = ann.search(df, books=12, train=2000).toPandas()
    scores = x @ x.T
    hits = total = 0
    for q, g in got.groupby("query_id"):
        s = scores[q].copy()
        s[q] = -np.inf
        want = sorted(range(len(x)), key=lambda i: (-round(s[i], 12), i))[:20]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g["vec_id"])
        assert np.allclose(g["score"], s[g["vec_id"]])
        hits += len(set(want) & set(g["vec_id"]))
        total += 20
    assert set(got["query_id"]) == set(range(0, 3000, 20)) and hits / total >= 0.9


def test_ann_recall_with_few_reranked(spark):
    """300 of 50,000 rows are scored exactly for a query: 0.6 % of the table."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(50_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))})
    df = spark.createDataFrame(table)
    got = ann.search(df, every=500, train=8192).toPandas().groupby("query_id")["vec_id"].agg(set)
    y = x.astype(np.float64)
    hits = []
    for q in range(0, len(x), 500):
        s = y @ y[q]
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert len(hits) == 100 and np.mean(hits) >= 0.9


def test_ann_odd_vectors(spark):
    """Infinite components, other lengths and a repeated id with two vectors."""
    rows = [(0, [1.0, 0.0]), (1, [float("inf"), 1.0]), (2, [1.0]), (3, [0.5, 0.0]), (3, [2.0, 0.0]), (4, [float("-inf"), 0.0]), (5, []), (20, [0.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 2.0), (0, 2, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 3, 0.0)]


def test_ann_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in ann.search(df).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("noise", [1e-4, 1e-3, 1e-2])
@pytest.mark.parametrize("near", [200, 1500])
def test_ann_near_equal_vectors(spark, near, noise):
    """Near copies share codes: more of them than are reranked, and than have the smallest ids."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000 + near, 24))
    x[2000:] = x[0] + noise * rng.normal(size=(near, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann.search(df, books=12, train=2000).toPandas().groupby("query_id")["vec_id"].agg(set)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    close = [q for q in range(0, len(x), 20) if np.sort(scores[q])[-20] > 0.9]
    hits = [len(got[q] & set(np.argsort(-scores[q])[:20].tolist())) / 20 for q in close]
    assert len(close) >= 5 and np.mean(hits) >= 0.9


def test_ann_repeated_rows_are_one_candidate(spark):
    rows = [(1, [1.0, 0.0])] * 30 + [(i, [1.0, 0.0]) for i in range(2, 9)] + [(0, [1.0, 0.5])]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas()
    assert list(got.sort_values("rank")["vec_id"]) == list(range(1, 9))


# toxicity by brute force, personal data in independent wording


def test_noisy_or_by_brute_force(spark):
    """Each document's score is one minus the product of the chances that nothing fires."""
    rnd = random.Random(6)
    model = toxicity.Model({"vile": 20.0, "scum": 9.0, "mea*": 7.5, "odd": 0.3}, -14.0, 0.02)
    vocabulary = ["vile", "scum", "meanie", "meanness", "odd", "fine", "day", "walk"]
    texts = ["", None, "no end", "vile.", "?!", "\u0130vile scum"] + [" ".join(rnd.choice(vocabulary) + rnd.choice(["", "", ".", "!", "\n", "? "]) for _ in range(rnd.randint(1, 30))) for _ in range(300)] + ["fine day. " * 20_000 + "vile scum."]
    got = toxicity.score(spark.createDataFrame(list(enumerate(t or "" for t in texts)), EMPTY), model).collect()

    def sentences(text):
        out, start = [], 0
        for m in re.finditer(r"[.!?\n]+", text):
            ends = m.start() + (m[0].index("\n") + 1 if "\n" in m[0] else len(m[0]))
            out.append((start, ends, text[start:ends]))
            start = ends
        return [x for x in [*out, (start, len(text), text[start:])] if x[2]]

    def brute(text):
        quiet, spans = 1 - model.leak, []
        for s, e, part in sentences(text):
            words = set(re.findall(r"[a-z]+", part.lower()))
            z = model.bias + sum(model.weights[w] for w in words if w in model.weights) + (model.weights["mea*"] if any(w.startswith("mea") for w in words) else 0)
            p = 1 / (1 + math.exp(-z))
            quiet *= 1 - min(p, 1 - 1e-12)
            if p >= 0.5:
                spans.append(text[s:e].strip())
        return 1 - quiet, spans

    for r in got:
        text = texts[r["doc_id"]] or ""
        if "\u0130" in text or re.search(r"[.!?]\n|\n[.!?]", text) or text == "?!":
            continue  # where sentences end there is a matter of taste
        want, spans = brute(text)
        assert r["score"] == pytest.approx(want, abs=1e-9), text[:80]
        assert [text[x["start"] : x["end"]].strip() for x in r["sentences"]] == spans
    assert len(got) == len(texts)


def test_added_spans_in_independent_wording():
    """Planted into other text, after words that neither the examples nor the features know."""
    rnd, model = random.Random(8), pii.train()
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))

    def iban():
        body = num(18)
        return f"GB{98 - int(body + '161100') % 97:02d}{body}"

    planted = {
        "phone_local": (("voicemail ", "give us a bell on ", "tonight: "), lambda: f"({rnd.randint(201, 989)}) {rnd.randint(200, 999)}-{num(4)}"),
        "email_words": (("drop a line to ", "questions go here: ", "signed "), lambda: rnd.choice((f"jo{num(2)} [at] firm [dot] org", "mara(at)shop(dot)net"))),
        "iban": (("please remit to ", "beneficiary ", "thanks: "), iban),
    }
    other = {"chapter ": lambda: f"9{num(2)}-{num(2)}-{num(4)}", "voucher ": lambda: f"{num(3)} {num(3)} {num(4)}", "gate ": lambda: f"{num(3)}.{num(3)}.{num(4)}", "drawer ": lambda: f"{num(3)}-{num(2)}-{num(4)}"}
    text = lambda lead, body: (f"the thing in of {lead}{body} and there it is", 16 + len(lead), 16 + len(lead) + len(body))
    for kind, (leads, make) in planted.items():
        hits = 0
        for i in range(150):
            t, s, e = text(leads[i % 3], make())
            hits += (s, pii.KINDS.index(kind), e) in pii.find_spans(t, model)
        assert hits >= 135, (kind, hits)
    false = sum(any(k >= len(pii.BASE) for _, k, _ in pii.find_spans(text(lead, make())[0], model)) for lead, make in other.items() for _ in range(100))
    assert false <= 20, false


def test_pii_long_texts_and_ties(spark):
    """A text of a million characters, spans that start together, and nothing at all."""
    long = "x " * 500_000 + "a@b.cd +12 345 678 901 4111 1111 1111 1111"
    rows = spark.createDataFrame([(1, long), (2, "1.2.3.4@b.cd"), (3, "4111111111111111 " * 3), (4, "no data")], EMPTY)
    got = {r["doc_id"]: [(x["start"], x["kind"], x["end"]) for x in r["found"] if x["base"]] for r in pii.find_pii(rows).collect()}
    for d, t in ((1, long), (2, "1.2.3.4@b.cd"), (3, "4111111111111111 " * 3), (4, "no data")):
        assert got[d] == [(s, pii.KINDS[k], e) for s, k, e in brute_pii(t)]
