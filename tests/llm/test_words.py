"""Spelling variants, benchmark passages and collocations against brute force on small and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from effectlens.llm import contamination, phrases, spelling

DOCS = "doc_id bigint, text string, lang string, word string, n bigint, depth int, number bigint, spans string, phrase string, f bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, None, None, None, None, None) for i, t, lang in rows], DOCS)


def odd_rows(seed, letters="abc", n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 8)))
    vocab = [word() for _ in range(40)]
    rows = [(i, r.choice([" ", "\n", ". "]).join(r.choice(vocab) + r.choice(["", "", "", ",", "!", "\t"]) for _ in range(r.randint(0, 60))), r.choice(["en", "fr", None])) for i in range(n)]
    return rows + [rows[0], (rows[1][0], "another text entirely", "en"), (None, "aaaaab aaaaab aaaaab null id", "de"), (901, None, None), (902, "", "en"), (903, "é" * 3000 + " " + "Àb" * 500, "fr"), (904, "x" * 70000 + " " + "x" * 70000, None), (905, " \n\t ", "en")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---- 11


def brute_variants(rows, least_length, least_count, typo):
    n = Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % typo == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_length:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, c in n.items():
        others = sorted((-n[x], x) for x in n if abs(len(x) - len(w)) < 2 and near(w, x))
        form = others[0][1] if others and -others[0][0] >= 2 * c else None
        out[w] = [form, c, len(others), n[form] if form else None]
    got = set()
    for w, (form, c, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        got.add((w, form, root, c, k, m))
    return got


@pytest.mark.parametrize(("seed", "letters", "least"), [(1, "ab", 2), (2, "abC", 3), (3, "aéÀ", 1)])
def test_variants_match_brute_force(spark, seed, letters, least):
    rows = odd_rows(seed, letters)
    got = [tuple(r) for r in spelling.variants(frame(spark, rows), least, 2, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(rows, least, 2, 5)


@pytest.mark.parametrize(("seed", "letters"), [(1, "ab"), (3, "abcde")])
def test_variants_where_a_task_reads_many_files(spark, seed, letters):
    r = random.Random(seed)
    vocab = ["".join(r.choice(letters) for _ in range(r.randint(4, 8))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(60)), "en") for i in range(200)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        got = {tuple(x) for x in spelling.variants(frame(spark, rows)).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == brute_variants(rows, 5, 3, 97)


def test_variants_of_nothing_and_of_a_chain(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    chain = [("abcdefg", 3), ("abcdefx", 6), ("abcdeyx", 13), ("abcdzyx", 27), ("abctzyx", 60), ("absxtzyx", 2)]
    rows = [(None, " ".join([w] * n), "en") for w, n in chain]
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(frame(spark, rows), typo=10**12).collect()}
    assert got["abcdefg"] == ("abcdefx", "abctzyx") and got["abctzyx"] == (None, "abctzyx") and len(got) == 5


# ---- 12


def brute_hits(rows, items, window):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    out = Counter()
    for i, t, _ in rows:
        w, hit, own = words(t), set(), set()
        for item, text in items:
            x = words(text)
            k = min(window, len(x))
            for s in range(len(x) - k + 1) if k else ():
                for at in range(len(w) - k + 1):
                    if w[at : at + k] == x[s : s + k]:
                        hit.update(range(at, at + k))
                        own.add("" if item is None else str(item))
        out[i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("table_words", [10**6, 12])
def test_passages_match_brute_force(spark, table_words):
    rows = odd_rows(4, n=25)
    items = [(1, rows[2][1]), (2, rows[3][1][:60]), (2, "aaaaab"), (3, rows[2][1]), (10, None), (11, ""), (None, rows[5][1][-30:]), (12, "!!"), (13, "null ID"), (14, rows[7][1].upper())]
    bench = spark.createDataFrame([(i, t, None, None) for i, t in items], "item_id bigint, text string, words string, table int")
    for window in (4, 1):
        got = contamination.contaminated(frame(spark, rows), bench, window, table_words).drop("spans").collect()
        assert Counter(map(tuple, got)) == brute_hits(rows, items, window)


def test_passages_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    got = contamination.contaminated(frame(spark, odd_rows(5, n=3)), none).collect()
    assert len(got) == 11 and not any(r["contaminated"] for r in got)
    assert contamination.contaminated(frame(spark, []), none).count() == 0


def test_shift_tables_agree_with_plain_search():
    r = random.Random(6)
    for length in (1, 2, 3, 5):
        strings = sorted({tuple(r.choice([b"a", b"b", b"c"]) for _ in range(length)) for _ in range(6)})
        search = contamination.Search(length, [(x, i) for i, x in enumerate(strings)])
        text = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(400)]
        assert search.occurrences(text) == [(at, strings.index(tuple(text[at : at + length]))) for at in range(len(text) - length + 1) if tuple(text[at : at + length]) in strings]


# ---- 13


def brute_phrases(rows, max_n, least, top, percent):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = set()
    for lang in n:
        best = []
        for (g, p), a in cand.items():
            if g != lang or any(h == lang and len(q) > len(p) and 100 * b >= percent * a and inside(p, q) for (h, q), b in cand.items()):
                continue
            score, _, left, right = min((2000000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize(("seed", "least", "top", "max_n"), [(7, 2, 2000, 4), (8, 3, 9, 4), (11, 2, 50, 2), (12, 2, 50, 5)])
def test_collocations_match_brute_force(spark, seed, least, top, max_n):
    rows = odd_rows(seed, "ab")
    rows += [(i, "a b c d. A B C D, a b c x y c d; 'Éa' b\x0bc d\ttab z", "fr") for i in range(5)]
    got = [tuple(r) for r in phrases.collocations(frame(spark, rows), max_n, least, top).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, max_n, least, top, 80)


def test_hashes_are_summed_over_cells_and_buckets(spark, monkeypatch):
    for name, value in (("BUCKET_BYTES", 60), ("CELL", 8), ("HELD", 40)):
        monkeypatch.setattr(phrases, name, value)
    rows = odd_rows(10, "ab")
    df = frame(spark, rows).select("lang", "text").na.fill("und", "lang").repartition(3)
    assert phrases._counted(df, 5, lambda part: phrases._runs(part, 1)[0][0]).select("bucket").distinct().count() > 8
    assert {tuple(r) for r in phrases.collocations(frame(spark, rows), 4, 2).collect()} == brute_phrases(rows, 4, 2, 2000, 80)


def test_collocations_survive_a_full_filter_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases.counts, "__defaults__", (4, 30, 16))  # nearly all bits set: all runs pass
    rows = odd_rows(9, "ab", 40)
    assert {tuple(r) for r in phrases.collocations(frame(spark, rows), 4, 2).collect()} == brute_phrases(rows, 4, 2, 2000, 80)
    assert phrases.collocations(frame(spark, [])).count() == 0
