"""Exact comparisons with brute force on small tables of odd rows, and on a whole small table."""

import gzip
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from braidview.llm import common, decontaminate, htmltext, jaccard, linededup, pieces, quality, suffixdedup, toxicity, warc
from braidview.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, extra string"
SPACE = "[^\x20\x09-\x0d]+"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ODD = [
    (1, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (2, None),
    (3, ""),
    (4, "   \n\t\n "),
    (5, "A b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (5, "same id, other text"),
    (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (None, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (None, "no id here"),
    (7, "ä" * 120),
    (8, "x" + "ä" * 110),
    (9, "\n".join(["first line", "second line", "third line", "", "fourth line", "first line", "second line", "third line"])),
    (10, "\n".join(["zero", "first line", "second line", "third line", "fourth line"])),
    (11, "start " + PASSAGE + " end"),
    (12, "other words before " + PASSAGE.upper() + ", and after"),
    (13, "short"),
    (14, "Short"),
    (15, "aaaa" * 60),
    (16, "aaaa" * 50),
    (17, "🙂 emoji \x00 zero 𝒳"),
    (18, "word " * 300),
]
ITEMS = [(1, "intro " + PASSAGE), (1, "second text of item one"), (2, "short"), (3, None), (4, ""), (None, PASSAGE), (5, "aaaa bbbb"), (6, "emoji zero")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "x") for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return common.table(spark, sf_dir, "documents")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


# -- op2 ----------------------------------------------------------------------


def lines_by_hand(docs):
    seen, out = {}, []
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))
    result = {}
    for i, t in order:
        lines = (t or "").split("\n")
        worded = [k for k, x in enumerate(lines) if re.search("[^\x20\x09-\x0d]", x)]
        cut = set()
        for k in range(len(worded) - 2):
            window = tuple(lines[j].strip(" \t\n\x0b\x0c\r") for j in worded[k : k + 3])
            if window in seen:
                cut.update(worded[k : k + 3])
            else:
                seen[window] = i
        result[i, t] = (i, len(lines), len(cut), sum(p - 1 not in cut for p in cut), "\n".join(x for k, x in enumerate(lines) if k not in cut))
    for i, t in docs:
        out.append(result[i, t])
    return sorted(out, key=repr)


def test_line_dedup(odd, documents):
    for df in (odd, documents):
        want = lines_by_hand([(r["doc_id"], r["text"]) for r in df.collect()])
        assert rows(linededup.query(df), "doc_id", "n_lines", "n_removed", "n_runs", "text") == want


def test_line_dedup_keeps_columns(odd):
    assert linededup.dedup_lines(odd).columns[:4] == ["doc_id", "text", "lang", "extra"]


# -- op4 ----------------------------------------------------------------------


def spans_by_hand(docs):
    first, big = {}, 1 << 70
    key = lambda i: big if i is None else i
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, big + 1), key(i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key(i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_order():
    rng = random.Random(5)
    for n in range(600):
        t = bytes(rng.choice(b"ab" if n % 2 else b"abcde") for _ in range(rng.randint(0, 50)))
        assert suffixdedup.suffix_order(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_substring_dedup(odd, documents):
    for df in (odd, documents):
        want = spans_by_hand([(r["doc_id"], r["text"]) for r in df.collect()])
        assert rows(suffixdedup.query(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_substring_dedup_in_small_pieces(spark, monkeypatch):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(4)]
    docs = []
    for i in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        docs.append((i, "".join(t)[rng.randint(0, 60) :]))
    monkeypatch.setattr(suffixdedup, "BATCH_BYTES", 2000)
    monkeypatch.setattr(suffixdedup, "BUCKET_GRAMS", 50)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = suffixdedup.dedup_substrings(df).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == sorted(spans_by_hand(docs))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])) == r["n_removed"] for r in out)


# -- op5 ----------------------------------------------------------------------


def measures_by_hand(t):
    from collections import Counter

    t = t or ""
    w = re.findall(SPACE, t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {p for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed


def test_quality_measures(odd, documents, spark, sf_dir):
    labels = common.table(spark, sf_dir, "labels")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df in (odd, documents):
        want = sorted(((r["doc_id"], *measures_by_hand(r["text"])) for r in df.collect()), key=repr)
        assert rows(quality.query(df, labels), *names) == want


def test_quality_without_labels(odd, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.query(odd, labels).collect())


def test_quality_works_out_windows_and_scores_once(spark):
    """Repeats of every kind by brute force; windows come from the pairs' hashes, and what is returned reads scores, not buckets."""
    rng = random.Random(11)
    texts = ["x y " * 30, "x " * 40, "a b c d e f g h " * 2, "a b c d e f g " * 2 + "z", "p q r s " + "a b c d e f g h " * 3 + "p q r s", "one two three four five six seven"]
    for _ in range(60):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))]
        at, size = rng.randrange(len(words) + 1), rng.randint(4, 12)
        texts.append(rng.choice([" ", "\n", " \t "]).join(words + words[at : at + size] + words[:size]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = quality.query(docs, labels)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(out, *names) == sorted(((i, *measures_by_hand(t)) for i, t in enumerate(texts)), key=repr)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan(out) and "_b#" not in plan(out) and "sequence(" not in plan(quality.measures(docs, "doc_id"))


# -- op6 ----------------------------------------------------------------------


def test_automaton_is_exact():
    words = ["moron", "idiot", "scum", "pathetic", "loser"]
    a = toxicity.Automaton(words)

    def near(x, y):
        if x == y:
            return True
        if len(y) < 5:
            return False
        drop = {y[:k] + y[k + 1 :] for k in range(len(y))}
        swap = len(x) == len(y) and sum(p != q for p, q in zip(x, y)) == 1
        return swap or x in drop or y in {x[:k] + x[k + 1 :] for k in range(len(x))}

    letters = "abcdeilmnoprstuxy"
    rng = random.Random(2)
    tried = set(words)
    for w in words:
        for _ in range(200):
            x = list(w)
            for _ in range(rng.randint(1, 2)):
                k, how = rng.randrange(len(x)), rng.randrange(3)
                if how == 0:
                    x[k] = rng.choice(letters)
                elif how == 1 and len(x) > 1:
                    del x[k]
                else:
                    x.insert(k, rng.choice(letters))
            tried.add("".join(x))
    for x in tried:
        assert (a.match(x) is not None) == any(near(x, w) for w in words), x


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(3)
    clean = ["table", "river", "stone", "cloud", "paper", "green", "music", "light", "house", "bread"]
    bad = ["moron", "idiot", "scumbag"]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = [rng.choice(clean) for _ in range(30)] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, "you are a morron and an idi0t, a real scumbagg " + " ".join(clean)), (1001, None), (1002, ""), (None, "no id"), (1003, " ".join(clean * 3))]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.query(df, known).collect()}
    import zlib

    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and sum(r["held_out"] for r in got.values() if r["doc_id"] in truth) == len(held)
    assert all(got[i]["predicted"] == truth[i] for i in held)
    assert got[1000]["predicted"] == 1 and got[1003]["predicted"] == got[1001]["predicted"] == got[1002]["predicted"] == 0
    assert all(0.0 <= r["score"] <= 1.0 for r in got.values())
    assert toxicity.reject_toxic(df, known).where("doc_id = 1000").count() == 0


def test_toxicity_without_labels(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.query(odd, none).collect()} == {0.0}


# -- op7 ----------------------------------------------------------------------


def test_warc(spark):
    long = "<p>" + "ä" * 120 + "</p>"
    pages = [(3, "http://a/?x=%0A", long), (1, "http://b/\nline", long), (2, None, long), (2, "http://again", long), (4, "u", None), (5, "u", ""), (6, "u", "tiny"), (7, "u", "tiny"), (None, "u", long), (8, "u", "\r\n\r\n" * 60)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    first = 1
    want = []
    for i, u, h in pages:
        b = (h or "").encode()
        again = h == long and (i is None or i > first)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None, u))
    assert rows(warc.query(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url") == sorted(want, key=repr)
    assert warc.query(df.limit(0)).collect() == []


def test_warc_archives_are_gzip_members():
    a = warc.record(1, "http://a", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None) + warc.record(2, None, b"", hashlib.sha256(b"").hexdigest(), None)
    assert gzip.decompress(a).count(b"WARC/1.1") == 2
    assert [r[0] for r in warc.read_records(a)] == [1, 2]
    with pytest.raises(ValueError):
        list(warc.read_records(a[:-5]))
    damaged = bytearray(a)
    damaged[40] ^= 255
    with pytest.raises(ValueError):
        list(warc.read_records(bytes(damaged)))


# -- op8 ----------------------------------------------------------------------


def test_html_rules():
    page = """<html><head><title>No</title><style>p{}</style></head><body><header><a href="/">Home</a></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies on this site and the whole world should know of it at all times</div>
    <article><h1>Head &amp; line</h1><p>The first   paragraph of the text is long enough to be decided by its rule, isn't it?<script>var x = "</p>";</script>
    <p>Short.</p><aside>Aside of the article that is not part of the text in any way, whatever it says of it</aside><p>More<br>words &lt;b&gt; here</p>
    <form><p>Name of the reader who is to fill in this form with the words of his choice</p></form></article>
    <section id="comments"><p>The first reader comment says that this is the best article of the year</p></section><footer>&copy; us</footer>"""
    assert htmltext.main_text(page) == "Head & line\nThe first paragraph of the text is long enough to be decided by its rule, isn't it?\nShort.\nMore words <b> here"
    assert htmltext.main_text(None) == htmltext.main_text("") == ""
    assert htmltext.main_text("plain text") == "plain text"
    assert htmltext.main_text("<p>open <!-- never closed") == "open"


def test_html_names_with_words_of_their_own_dont_remove_text():
    prose = "This is a plain paragraph of the article that says what it has to say in some hundred letters and then it ends here."
    page = "<body><article><h1>Title of it</h1><p>" + prose + "</p>{}<p>" + prose + " Last.</p></article></body>"
    for tag in ('section id="related-work"', 'section id="search-algorithms"', 'section id="social-history"', 'p class="share-price"', 'section class="cookieRecipes"'):
        name = tag.split()[0]
        got = htmltext.main_text(page.format(f"<{tag}>Own {prose}</{name}>")).split("\n")
        assert got == ["Title of it", prose, "Own " + prose, prose + " Last."], tag
    for tag in ('div class="commentBox"', 'div class="user_reply"', 'div class="cookieBanner"', 'section id="comments"', 'div class="ad-slot"', 'div id="siteNavMenu"', 'div class="post-comments"'):
        name = tag.split()[0]
        for around in (page, "<body>{}" + page.format("") + "</body>"):
            got = htmltext.main_text(around.format(f"<{tag}>Own {prose}</{name}>")).split("\n")
            assert got == ["Title of it", prose, prose + " Last."], tag
    links = "<a href=x>Another article of ours</a> and <a href=y>yet another one of ours</a> are there for you to read, if it is that you like to"
    assert "Another" not in htmltext.main_text(page.format(f'<div class="related-reading">{links}</div>'))


def test_html_furniture_spares_the_article():
    text = "The first paragraph of the text is long enough to be decided by its rule."
    other = "The words of the others are not what this page is about, and there are many of them."
    for c in ("content-sidebar-wrap", "has-sidebar", "no-comments", "sidebar", "widget main-banner"):
        assert htmltext.main_text(f'<div class="{c}"><article><p>{text}</p></article></div>') == text
        assert htmltext.main_text(f'<main class="{c}"><p>{text}</p></main><p class="ad">{other}</p>') == text
    for c in ("content-sidebar-wrap", "has-sidebar", "no-comments"):
        assert htmltext.main_text(f'<div class="{c}"><p>{text}</p></div>') == text
    assert htmltext.main_text(f'<h1 class="page-header">Head</h1><p>{text}</p>') == f"Head\n{text}"
    # what is furniture still goes, in wrappers of its own names and beside the article
    for c in ("ad-slot", "main-nav", "side-bar", "left-sidebar", "post-comments", "related-posts", "cookie-banner", "ads", "site_footer"):
        assert htmltext.main_text(f'<article><p>{text}</p><div class="x {c}"><p>{other}</p></div></article>') == text
        assert htmltext.main_text(f'<article><p>{text}</p></article><div id={c}><article><p>{other}</p></article></div>') == text
    assert htmltext.main_text(f'<div><p>{text}</p></div><div class="comments"><article><p>{other}</p></article></div>') == text
    assert htmltext.main_text(f'<div class="has-sidebar"><div hidden><article><p>{other}</p></article></div><p>{text}</p></div>') == text


def test_html_query(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages")
    got = {r["page_id"]: r for r in htmltext.query(pages).collect()}
    import html

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


# -- op9 ----------------------------------------------------------------------


def leaks_by_hand(docs, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = {}
    for i, t in items:
        w = split(t)
        m = min(10, len(w))
        if i is not None and m:
            for k in range(len(w) - m + 1):
                windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(odd, documents, spark, sf_dir):
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    small = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    for df, bench in ((odd, small), (documents, common.table(spark, sf_dir, "benchmark")), (odd, small.limit(0))):
        want = leaks_by_hand([(r["doc_id"], r["text"]) for r in df.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
        assert rows(decontaminate.query(df, bench), *names) == want
    clean = [r for r in leaks_by_hand(ODD, ITEMS) if not r[-1]]
    assert decontaminate.decontaminate(odd, small).count() == len(clean)


def test_decontamination_runs_no_python(odd, spark):
    small = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontaminate.query(odd, small)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- op10 ---------------------------------------------------------------------


def components_by_hand(docs):
    def shingles(t):
        w = re.findall(SPACE, lower(t))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k), i)) for k, (i, _) in enumerate(docs)), key=repr)


def test_jaccard(odd, documents):
    for df in (odd, documents):
        want = components_by_hand([(r["doc_id"], r["text"]) for r in df.collect()])
        assert rows(jaccard.query(df), "doc_id", "n_shingles", "component_id") == want


def test_jaccard_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 7)
    monkeypatch.setattr(jaccard, "BATCH_BYTES", 1500)
    monkeypatch.setattr(jaccard, "BUCKET_POSTINGS", 60)
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    docs, base = [], [[rng.choice(vocabulary) for _ in range(rng.randint(30, 90))] for _ in range(5)]
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = components_by_hand(docs)
    assert rows(jaccard.query(df), "doc_id", "n_shingles", "component_id") == want
    assert jaccard.keep_one(df).count() == len({c for _, _, c in want})


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in list(root)}


# -- op1 ----------------------------------------------------------------------


def test_pieces_equal_the_library(odd, documents):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    m = pieces.load()
    texts = [t for _, t in ODD if t is not None] + [" " * k + "x" for k in range(35)] + ["a" + " " * k for k in range(35)] + ["the" * 60, "=" * 70, "ab\tc\r\n", "日本語", " "]
    assert m.encode_all(texts) == own.encode(texts)
    assert [m.decode(i) for i in m.encode_all(texts)] == texts
    for df in (odd, documents):
        got = pieces.encode(df.select("text"), m).collect()
        assert all(r["ids"] == (None if r["text"] is None else own.encode(r["text"])) for r in got)
        assert all(r["round_trip"] for r in pieces.query(df).collect())


def test_null_text_has_null_ids(odd):
    got = pieces.encode(odd.where("doc_id = 2"), pieces.load()).collect()
    assert got[0]["ids"] is None


# -- all ----------------------------------------------------------------------


def test_empty_tables(none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (
        linededup.query(none), suffixdedup.query(none), quality.query(none, labels), toxicity.query(none, labels), decontaminate.query(none, bench), jaccard.query(none), pieces.query(none),
        linededup.dedup_lines(none), toxicity.reject_toxic(none, labels), jaccard.keep_one(none), decontaminate.decontaminate(none, bench),
    ):
        assert out.collect() == []


def test_clashing_columns(spark):
    df = spark.createDataFrame(
        [(1, "some words to look at here", 5, 6, "x", 7, "y", "z")], "doc_id long, text string, id int, n int, row string, k1 int, _k1 string, score string"
    )
    assert jaccard.keep_one(df).columns == df.columns and jaccard.keep_one(df).count() == 1
    assert toxicity.reject_toxic(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).columns == df.columns
    assert linededup.dedup_lines(df).columns[: len(df.columns)] == df.columns
    assert decontaminate.decontaminate(df, spark.createDataFrame([(1, "x y")], "item_id long, text string")).count() == 1


def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.table(spark, sf_dir, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
        assert set(corpus_pipeline.COLUMNS) <= set(docs.columns)
        assert docs.count() <= before
        before = docs.count()
    assert docs.where("not round_trip").count() == 0 and before > 0
