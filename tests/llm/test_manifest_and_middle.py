"""Manifest, fill-in-middle and language identification against brute force on odd rows, and against SQL on a whole small table."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from braidview.llm import common, fim, langid, merkle, oracles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, _g string, level int"
H = lambda s: hashlib.sha256(s.encode()).hexdigest()
ODD = [
    (1, "a b c", "en", "web", 5), (2, None, "en", None, None), (3, "", "", "", 0), (4, "ä🙂\x00\n", None, "web", -3), (4, "ä🙂\x00\n", None, "web", -3), (5, "same id", "fr", "x", 1), (5, "same id, other text", "fr", "x", 1),
    (None, "no id", "en", "web", 2), (None, "no id", "en", "web", 2), (None, "no id either", None, None, 2), (2**63 - 1, "last", "en", "web", 2**63 - 1), (-7, "first", "en", "web", 4), (8, "lone", "xx", "x", 4),
] + [(100 + i, f"text {i}", "en" if i % 3 else "éö", "web", i) for i in range(60)] + [(500, "copy", "en", "web", 4)] * 40


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def against_sql(spark, sf_dir, query, sql):
    docs = common.table(spark, sf_dir, "documents")
    got = query(docs)
    names = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf_dir}/documents.parquet'")
    want = con.sql(f"select {', '.join(names)} from ({sql})").fetchall()
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == sorted(want, key=repr) and want


# -- op11 ---------------------------------------------------------------------


def manifest_by_hand(rows):
    def leaf(doc_id, text, lang, source, n):
        return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n, text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def way(tree, i):
        return [(tree[h][(i >> h) ^ 1] if (i >> h) ^ 1 < len(tree[h]) else "", bool((i >> h) & 1)) for h in range(len(tree) - 1)]

    keyed = sorted(((r[2] is not None, (r[2] or "").encode()), (r[0] is not None, r[0] or 0), leaf(*r), r) for r in rows)
    groups = {k: [x[2:] for x in g] for k, g in itertools.groupby(keyed, key=lambda x: x[0])}
    trees = {k: levels([x[0] for x in g]) for k, g in groups.items()}
    top = levels([t[-1][0] for t in trees.values()])
    out = []
    for at, (k, g) in enumerate(groups.items()):
        for i, (mine, (doc_id, text, lang, source, n)) in enumerate(g):
            proof = way(trees[k], i) + way(top, at)
            reached = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            h = leaf(doc_id, text, lang, source, n if n is None else n + 1) if reached else mine
            for s, left in proof:
                h = H(s + h if left else h + s)
            out.append((doc_id, mine, trees[k][-1][0], top[-1][0], H("".join(s for s, _ in proof)), h, h == top[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SIZES = [{}, {"leaves_a_part": 7, "levels": (2, 1)}, {"leaves_a_part": 1, "levels": (26, 11)}]


@pytest.mark.parametrize("sizes", SIZES)
def test_manifest_by_hand(odd, sizes):
    got = merkle.query(odd, **sizes).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(manifest_by_hand(ODD), key=repr)
    assert sum(not r["verified"] for r in got) > 5


def test_manifest_when_runs_are_too_many_to_send(odd, monkeypatch):
    monkeypatch.setattr(merkle, "SENT_RUNS", 0)
    got = merkle.query(odd, leaves_a_part=7).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(manifest_by_hand(ODD), key=repr)


def test_manifest_of_one_row_and_of_none(odd, none):
    one = merkle.manifest(odd.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["root"] == one[0]["subroot"] and one[0]["proof"] == []
    assert merkle.query(none).collect() == []


def test_every_proof_leads_to_the_root_and_no_other_leaf_does(odd):
    rows = merkle.manifest(odd, leaves_a_part=9)
    told = rows.select((merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("a"), (merkle.fold(F.lit("0" * 64), F.col("proof")) == F.col("root")).alias("b")).collect()
    assert all(r["a"] and not r["b"] for r in told)


def test_subtrees_and_ragged_ends_make_the_tree():
    rng = random.Random(3)
    for n in [1, 2, 3, 5, 8, 13, 64, 65, 100]:
        leaves = [H(str(i)) for i in range(n)]
        whole = merkle.grow(0, leaves, n)
        assert len(whole) == merkle.height(n) + 1 and len(whole[-1][1]) == 1
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(4))})
        ends = [e for a, b in zip(cuts, cuts[1:]) for e in merkle.ragged(merkle.grow(a, leaves[a:b], n), n)]
        assert all(whole[level][1][i] == h for level, i, h in ends)
        assert sorted(x for level, i, _ in ends for x in range(i << level, min((i + 1) << level, n))) == list(range(n))


def test_manifest_against_sql(spark, sf_dir):
    against_sql(spark, sf_dir, lambda d: merkle.query(d, leaves_a_part=40).select(*COLUMNS), oracles.MERKLE)


# -- op12 ---------------------------------------------------------------------

TEXTS = [None, "", "a", "<", "<P>", "x<S>y", "x<M", "<p>", "<PS>", "<<P>", "<P", "P>", "Hello, wörld! 🙂🙂 ab\n\ncd", "ä" * 50, "z" * 300, "a<b>c " * 30, "<" * 40, "1 2 3", "\x00a\x00", "é", "aé", "éa", "M>M>S>"]


def middle_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = H(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    x, y, z = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    plain = not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
    form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{x}<S>{z}<M>{y}", "spm": f"<S>{z}<P>{x}<M>{y}"}[form]
    return doc_id, len(units), form, None if plain else len(x), None if plain else len(y), H(out), H(text)


def test_middle_by_hand(spark, none):
    rows = [(i + 30 * j, t) for j in range(12) for i, t in enumerate(TEXTS)] + [(None, "no id here"), (None, None), (1, "a"), (1, "a")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 3) for i, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in fim.query(df).collect()]
    assert sorted(got, key=repr) == sorted((middle_by_hand(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.query(none).collect() == []


def test_middle_in_blocks_of_any_size():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", "P", "S", "M", "<", ">", " ", "é", "🙂"]) for _ in range(rng.randrange(40))).encode() for _ in range(80)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = fim.cut_all(list(range(80)), data, ends)
    for block in (2, 3, 7, 64):
        assert fim.cut_all(list(range(80)), data, ends, block) == want
    for i, (t, row) in enumerate(zip(texts, want)):
        assert row[:2] == middle_by_hand(i, t.decode())[1:3]


def test_automaton_agrees_with_its_table_byte_by_byte():
    rng = random.Random(2)
    data = np.array([rng.choice(b"aPSM<> 1\xc3\xa9") for _ in range(500)], np.uint8)
    starts = np.array([0, 1, 2, 40, 41, 300])
    state, want = fim.START, []
    for i, b in enumerate(data):
        state = fim.START if i in starts else state
        want.append(state * 6 + int(fim.CLASS[b]))
        state = int(fim.NEXT[state, fim.CLASS[b]])
    assert fim.transitions(data, 0, 500, starts).tolist() == want
    assert fim.transitions(data, 41, 77, starts).tolist() == want[41:77] and fim.transitions(data, 100, 102, starts).tolist() == want[100:102]


def test_middle_of_a_very_long_text():
    text = "word, " * 700_000 + "end"
    data, ends = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    cut = 0
    for doc_id in range(8):
        ((n, form, a, b, x, y),) = fim.cut_all([doc_id], data, ends)
        assert (doc_id, n, form, x, y) == middle_by_hand(doc_id, text)[:5]
        if form != "plain":
            assert (a, b) == (x, x + y)
            cut += 1
    assert cut > 4


def test_middle_against_sql(spark, sf_dir):
    against_sql(spark, sf_dir, fim.query, oracles.FIM)


# -- op13 ---------------------------------------------------------------------


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = common.table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    got = langid.query(docs).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and len(held) > 100
    assert np.mean([r["lang_pred"] == r["true"] for r in held]) > 0.97 and all(0.0 <= r["score"] <= 1.0 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_doesnt_read_what_it_may_not(spark, sf_dir):
    """Labels of held-out rows, ids and sources change nothing; neither do partitions."""
    docs = common.table(spark, sf_dir, "documents")
    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("q")).repartition(5)
    a, b = (sorted((tuple(r) for r in langid.query(d).collect()), key=repr) for d in (docs, other))
    assert [r[:3] for r in a] == [r[:3] for r in b] and np.allclose([r[3] for r in a], [r[3] for r in b])


def test_odd_texts_and_many_languages(spark, none, monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 2)  # the five languages come in three slices
    words = {"aa": "bana kola mitu", "bb": "xerxes quark zyx", "cc": "жук лес мир", "dd": "ooh uuh iih", "ee": "str prst krk"}
    rows = [(100 * j + i, f"{w} {w[::-1] if i % 2 else w} {i}!", lang) for j, (lang, w) in enumerate(words.items()) for i in range(30)]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "bb"), (903, "日本語", None), (None, "жук лес", "aa"), (904, "ЖУК МИР жук", None), (904, "ЖУК МИР жук", None), (905, "bana " * 200_000, None), (906, "²", "cc")]
    df = spark.createDataFrame([(i, t, lang, "s", 1, "x", "y", 3) for i, t, lang in rows + odd], SCHEMA)
    got = langid.query(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd) and all(by[i]["lang_pred"] == lang for i, _, lang in rows)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0.0 and by[i]["rejected"] for i in (900, 901, 902, 906))
    assert by[903]["lang_pred"] in words and by[903]["rejected"]  # nothing of it was learned
    assert by[904]["lang_pred"] == by[None]["lang_pred"] == "cc" and by[905]["lang_pred"] == "aa" and not by[None]["held_out"]
    assert langid.query(none).collect() == []
    unlearned = langid.query(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unlearned) == len(got) and {r["lang_pred"] for r in unlearned} == {"und"}


def test_vectors_by_hand():
    for text in ("Abc, abc!", "a", "ÄÖ 1x_y", "word " * 40):
        data = langid.letters(text)
        grams = [data[i : i + n] for n in langid.ORDERS for i in range(len(data) - n + 1)]
        at, tf = langid.features(text)
        assert np.isclose(np.exp(tf - 1.0).sum(), len(grams))
    monkey = langid.PIECE
    try:
        whole = langid._grams(langid.letters("some words to cut " * 50))
        langid.PIECE = 7
        assert (langid._grams(langid.letters("some words to cut " * 50)) == whole).all()
    finally:
        langid.PIECE = monkey


def test_clusters():
    x = np.zeros((90, 6), np.float32)
    for i in range(90):
        x[i, i // 30] = 1.0
    c, of = langid.cluster(x, 4)
    assert len(c) == 3 and len(set(of)) == 3 and all(len(set(of[a : a + 30])) == 1 for a in (0, 30, 60))
