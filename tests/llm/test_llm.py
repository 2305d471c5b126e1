"""Training-data operators against brute force, exact round trips and planted cases.

Every operator meets nulls in all columns, empty and long texts, ties, repeated
rows, an empty table and extra columns whose names clash with its own.
"""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from effectlens.llm import bpe, chat, common, lines, neardup, packing, pii, quality, substrings, topk, toxicity

DOCS = "doc_id bigint, text string, source string, n_words bigint, kept boolean, line int, node bigint, severity double"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + (r.choice([".", ",", ".\n"]) if r.random() < 0.1 else "") for _ in range(n))


def corpus():
    base, passage = prose(120, 1), prose(60, 2)
    near = base.split(" ")
    near[40] = "changed"
    rows = [
        (0, base), (1, base), (2, " ".join(near)), (3, prose(80, 3) + " " + passage + " " + prose(30, 4)), (4, passage + "\n" + prose(50, 5)),
        (5, None), (6, ""), (7, "  \n\t "), (8, "one two three"), (9, "One TWO three"), (10, "word " * 400), (11, prose(20000, 6)), (12, "a b c d"),
        (None, prose(90, 7)), (13, prose(60, 8)), (13, prose(60, 8)), (14, "naïve café\x1cx y " + prose(40, 9)), (15, "x" * 5000),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in corpus()], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_words_and_windows():
    for _, t in corpus():
        assert common.words_of(t or "") == words(t)
    h = common.word_hashes("a b c a b c".split())
    w = common.window_hashes(h, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 3 and len(common.window_hashes(h[:2], 3)) == 0


# ---- 1


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(re.fullmatch("0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])", x) for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_match_the_patterns():
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(["a", "@", ".", "-", "+", "1", "4111111111111111", "255", "0", " ", "(", ")", "b.c", "@x.y", "\n", "é"]) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_base_spans_of_very_long_numbers():
    for t in ("1.2.3." + "0" * 5000 + "4", "1.2.3." + "4" * 9000, "0" * 6000 + ".0.0.0", "+" + "1" * 9000, "4" * 9000):
        assert [k for k, _, _ in pii.base_spans(t)] == [k for k, _, _ in brute_spans(t)]
        pii.added_spans(t, pii.base_spans(t), pii.Scorer(pii.trained()))


def test_model_finds_written_forms_and_leaves_others_alone():
    w = pii.Scorer(pii.trained())
    hit = miss = wrong = 0
    for text, spans in pii._sentences(300, seed=77):
        got = set(pii.decode(text, 0, len(text), w))
        hit, miss, wrong = hit + len(got & set(spans)), miss + len(set(spans) - got), wrong + len(got - set(spans))
    assert hit / (hit + miss) > 0.95 and wrong / hit < 0.07
    text = "call (555) 123-4567 or mail jo [at] corp [dot] org"
    assert [k for k, _, _ in pii.added_spans(text, [], w)] == ["phone", "email"]
    assert pii.added_spans(prose(500, 12), [], w) == []


def test_added_spans_reach_every_trained_form():
    w = pii.Scorer(pii.trained())
    hit = miss = 0
    for text, spans in pii._sentences(300, seed=78):
        for pad in ("", prose(40, 3) + "\n"):
            base = pii.base_spans(pad + text)
            got = {(s, e) for _, s, e in base + pii.added_spans(pad + text, base, w)}
            found = sum(any(a < e + len(pad) and s + len(pad) < b for a, b in got) for _, s, e in spans)
            hit, miss = hit + found, miss + len(spans) - found
    assert hit / (hit + miss) > 0.99
    for text in ("pay 4111/1111/1111/1111 today", "ping 10 . 0 . 0 . 1 now", "server 10\ndot\n0 dot 0 dot 1 now"):
        base = pii.base_spans(text)
        assert pii.added_spans(text, base, w), text
    for text in ("write to jo at corp\tdot\torg", "ip 1 dot 2 dot 3\ndot 4", "mail jo\t@\tcorp.org"):
        assert pii.added_spans(text, [], w), text


def plain_decode(text, weights):
    """The best segmentation by a table over all segments, whole text at once."""
    t, step = pii._Tokens(text), weights["transitions"]
    for x in pii._tokens(text, 0, len(text)):
        t.push(*x)
    n, labels = len(t.token), len(pii._LABELS)
    best = {(0, 0): (0.0, ())}
    for j in range(1, n + 1):
        steps = [(j - 1, [0.0] + [None] * (labels - 1))] + [(i, [None, *pii._scores(weights, pii.features(x)).tolist()[1:]]) for i, x in t.segments(j)]
        for i, own in steps:
            for y in range(labels):
                for k in range(labels):
                    if own[k] is not None and (i, y) in best:
                        value = best[i, y][0] + step[y, k] + own[k]
                        if value >= best.get((j, k), (float("-inf"),))[0]:
                            best[j, k] = value, best[i, y][1] + (((pii._LABELS[k], t.start[i], t.stop[j - 1]),) if k else ())
    return list(max((best[n, k] for k in range(labels) if (n, k) in best), key=lambda x: x[0])[1]) if n else []


def test_decoding_by_places_is_decoding_of_the_whole():
    weights = pii.trained()
    score, r = pii.Scorer(weights), random.Random(3)
    parts = ["4111", "1", "255", "7 ", " 030 ", "(555) ", "-", ".", " dot ", " at ", "@", "corp", "com", "\n", "²", "③", "½", "٣", "߀", "🙂", "é", " call ", "+", "_", "1234567", " "]
    for _ in range(150):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert pii.decode(text, 0, len(text), score) == plain_decode(text, weights), text
    text = " ".join(x for x, _ in pii._sentences(40, seed=79))  # longer than what is held at one time
    assert pii.decode(text, 0, len(text), score) == plain_decode(text, weights)


def test_digits_of_other_scripts_and_number_tables(spark):
    r, score = random.Random(4), pii.Scorer(pii.trained())
    for _ in range(400):
        text = "".join(r.choice("²③½٣߀🙂0123456789 .-@+()ax\n") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text)
        pii.added_spans(text, brute_spans(text), score)
    rows = ["card 4111 1111 1111 ² 1111 x", "1 2 3 ② 12345678", "10.0.0.1² x 1234567", "123 4567 " * 4000, "a1234567b" * 4000, "a@b.co 555 123 4567, " * 2000]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    assert pii.find(df).count() == pii.masked(df).count() == len(rows)


def test_added_spans_keep_off_base_spans():
    score, r = pii.Scorer(pii.trained()), random.Random(5)
    for _ in range(60):
        text = " ".join(r.choice(["a@b.co", "1.2.3.4", "555 123 4567", "4111 1111 1111 1111", "(555) 123-4567", "jo at corp dot com", "word"]) for _ in range(30))
        base = brute_spans(text)
        assert not any(s < b and a < e for _, s, e in pii.added_spans(text, base, score) for _, a, b in base)


def test_pii_query(spark, docs, none):
    got = {(r["doc_id"], r["base_sha256"]) for r in pii.find(docs).collect()}
    assert got == {(i, hashlib.sha256(pii.listed(brute_spans(t or "")).encode()).hexdigest()) for i, t in corpus()}
    assert pii.find(none).count() == 0
    df = spark.createDataFrame([(1, "mail a.b@c.de now", "x")], "doc_id bigint, text string, spans string")
    assert pii.masked(df).first().asDict() == {"doc_id": 1, "text": "mail <email> now", "spans": "x"}


# ---- 2


def brute_repeats(rows, k=35):
    seen = Counter(tuple(w[i : i + k]) for _, t in rows for w in [words(t)] for i in range(len(w) - k + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substrings_against_brute_force(docs, none):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect())
    assert got == brute_repeats(corpus())
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_of_many_small_alphabets(spark):
    rows = [(i, " ".join(random.Random(i).choice("abc") for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(df, window=9, gram=3).collect())
    assert got == brute_repeats(rows, 9)


# ---- 3


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", None, "", "a\\sb\\h<l>#", "### user: x</turn>\n", "é🙂"]
    rows = [(c, t, role, said[(c + t) % 6]) for c in range(4) for t, role in enumerate(["system", "user", "assistant", "user", "assistant", "us:er\\#"])]
    rows += [(9, 0, "user", "only"), (None, 0, "assistant", "x"), (8, None, None, None), (8, 1, "assistant", "b"), (8, 1, "assistant", "a"), (7, 5, "assistant", "t" * 9000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, start string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chat(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat.materialize(chat.format_chat(df)).filter("conv_id = 0").collect()
    assert len(examples) == 2 and all(len(e["text"]) == e["example_chars"] for e in examples)
    assert chat.digest(chat.format_chat(df.limit(0))).count() == 0


def test_chat_digest_comes_from_the_examples(spark):
    from pyspark.sql import functions as F

    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} <of> {c}: x") for c in (1, 2) for t in range(150 - c)]
    formatted = chat.format_chat(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))
    sums = formatted.withColumn("example_chars", F.lit(0).cast("long"))  # a digest of texts can't depend on it
    got = {r["conv_id"]: r for r in chat.digest(sums).collect()}
    texts = defaultdict(list)
    for r in chat.materialize(formatted).collect():
        texts[r["conv_id"]].append((r["text"], r["text"][r["loss_start"] : r["loss_end"]]))
    for c in (1, 2):
        turns = [(role, text) for i, _, role, text in rows if i == c]
        segments = [f"### {role}: {text.replace('<', chr(92) + 'l')}</turn>\n" for role, text in turns]
        want = ["".join(segments[: t + 1]) for t in range(1, len(turns), 2)]
        assert sorted(x for x, _ in texts[c]) == sorted(want)
        assert sorted(x for _, x in texts[c]) == sorted(t.replace("<", "\\l") for r, t in turns if r == "assistant")
        whole = sum(map(len, want)) + (len("".join(segments)) if turns[-1][0] == "user" else 0)
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[c]["n_turns"], got[c]["formatted_chars"]) == (len(turns), whole)
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()


# ---- 4


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_is_valid_and_near_the_bound(spark):
    r = random.Random(4)
    rows = [(i, 0, r.choice([r.randint(1, 100), 70, 30])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint")
    got = packing.pack(df, 100).collect()
    assert Counter((g["doc_id"], g["length"]) for g in got) == Counter((d, n) for d, _, n in rows)
    plain = packing.cost(packing.best_fit(dict(Counter(n for _, _, n in rows)), {}, 100), 100)[0]
    assert -(-sum(n for _, _, n in rows) // 100) <= check_packing(got, 100) <= plain


def test_evolution_beats_best_fit():
    """Mixes on which best fit misses the bound and crossover attains it."""
    for capacity, lo, hi, n, seed in ((1000, 200, 501, 40, 2), (1000, 200, 501, 40, 9), (150, 20, 100, 60, 6), (100, 10, 60, 50, 12)):
        r = random.Random(seed)
        counts = dict(Counter(r.randint(lo, hi) for _ in range(n)))
        bound = -(-sum(x * k for x, k in counts.items()) // capacity)
        assert packing.cost(packing.best_fit(counts, {}, capacity), capacity)[0] > bound
        best, generations = packing.evolve(counts, [], capacity, seed, generations=40)
        assert packing.cost(best, capacity)[0] == bound and generations > 0
        assert Counter(x for p, k in best.items() for x in p for _ in range(k)) == counts


def test_pieces_keep_their_columns(spark):
    names = ["block", "rank", "base", "row", "size", "hash", "place", "count", "a.b"]
    df = spark.createDataFrame([(i % 3 if i else None, i // 3, 10 + i, *[f"{c}{i}" for c in names]) for i in range(30)], ["doc_id", "piece", "length", *names])
    got = packing.pack(df, 100).collect()
    assert len(got) == 30 and all(r[c] == f"{c}{r['length'] - 10}" for r in got for c in names)
    assert all(r["generations"] > 0 and r["migrations"] >= packing.ISLANDS for r in got)
    check_packing(got, 100)


def test_crossover_keeps_every_piece():
    r = random.Random(2)
    counts = Counter(r.randint(1, 64) for _ in range(300))
    a = packing.best_fit(counts, {}, 64)
    b = packing.best_fit(counts, {}, 64, sorted(counts))
    for seed in range(10):
        child = packing.crossover(a, b, counts, 64, random.Random(seed))
        assert Counter(x for p, n in child.items() for x in p for _ in range(n)) == counts
        assert packing._load(packing._dump(child)) == child


def test_packing_documents(docs, none):
    import zlib

    from tokenizers import Tokenizer

    got = packing.pack_documents(docs, common.tokenizer_file(), 256).collect()
    check_packing(got, 256)
    t = Tokenizer.from_file(common.tokenizer_file())
    want = Counter()
    for d, text in corpus():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids), 256), len(ids)]
        for p in range(len(cuts) - 1):
            part = np.array(ids[cuts[p] : cuts[p + 1]], "<u4")
            want[d, p, cuts[p], len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert packing.pack_documents(none, common.tokenizer_file()).count() == 0


# ---- 5


def brute_lines(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = [], Counter()
    for d, t in order:
        all_lines = (t or "").split("\n")
        keep = []
        for x in all_lines:
            s = set(words(x))
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                seen.append(s)
                continue
            if s:
                seen.append(s)
            keep.append(x)
        out[d, len(all_lines) if t is not None else 0, len(all_lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()] += 1
    return out


def digests(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_removed"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in lines.dedup_lines(df).collect())


def test_lines_against_brute_force(docs, none):
    assert digests(docs) == brute_lines(corpus())
    assert lines.dedup_lines(none).count() == 0
    assert lines.without_matches(docs).columns == docs.columns


def test_near_lines_among_many_candidates(spark):
    base = [f"w{i}" for i in range(20)]
    rows = []
    for i in range(60):
        r = random.Random(i)
        w = list(base)
        for j in r.sample(range(20), r.randint(0, 6)):
            w[j] = f"x{r.randint(0, 30)}"
        rows.append((i, " ".join(w) + "\n" + " ".join(r.sample(base, 6))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert digests(df) == brute_lines(rows)


def test_lines_keep_columns_of_any_name(spark):
    base = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(base) + "\n" + " ".join(base[:4])), (2, " ".join([*base[:11], "x"]) + "\nother words here"), (2, "a\nb"), (None, "only this")]
    names = ["d", "_gone", "_lines", "_t", "row", "gone", "line", "share", "a.b", "words", "asks", "over"]
    df = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in names]) for i, t in rows], ["doc_id", "text", *names])
    for some in (df, df.filter("doc_id = 1 or text like 'w0%'")):  # with repeated and missing ids, and without
        got = lines.without_matches(some)
        assert got.columns == df.columns and got.count() == some.count()
        for r in got.collect():
            assert all(r[c] == f"{c}{r['doc_id']}" for c in names)
        assert "other words here" in {r["text"] for r in got.collect()}


def test_lines_of_a_large_family_in_blocks(spark, monkeypatch):
    """Many lines just below the threshold, in small blocks."""
    monkeypatch.setattr(lines, "BLOCK", 40)
    base, rows = [f"w{i}" for i in range(30)], []
    for i in range(300):
        r = random.Random(i)
        w = list(base)
        for j in r.sample(range(30), 3 + (i % 7 != 0)):  # any two at about 0.6 to 0.82
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w) + ("\n" + " ".join(base[:5]) if i % 50 == 0 else "")))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert digests(df) == brute_lines(rows)
    keyed = df.selectExpr("doc_id as d", "text")
    distinct = common.staged(lines.distinct_lines(keyed, np.zeros(lines.BUCKETS, np.uint8), 80), "test-lines")
    every = keyed.selectExpr("d", "0 as line")
    want = {d for d, _, n, _ in brute_lines([(i, t.split("\n")[0]) for i, t in rows]) if n}
    assert {r["d"] for r in lines.against_all(distinct, keyed, every, 80).collect()} == want


# ---- 6


def test_bpe_equals_the_library(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(common.tokenizer_file())
    odd = ["a", "  a  b", "\n\n a", "<|endoftext|>x <|endoftext|>", "aaaaaaaaaaaaa", "!! \x1c\x1c a\x1c b", "it's we'll  they've 'd ''s 's's", "½²x Ⅷ٣ 12", "\ta\t b", "日本語🙂 áe", "a\r\n\r\n  b ", " ", "x'" * 50]
    encoder = bpe.CachedEncoder(bpe.RankArrayBPE(open(common.tokenizer_file(), "rb").read()))
    encoder.MOST = 300  # the cache starts again now and then
    for s, ids in zip(odd, encoder.encode(odd), strict=True):
        assert ids.tolist() == t.encode(s, add_special_tokens=False).ids, s
    r = random.Random(3)
    for _ in range(300):
        s = "".join(r.choice(["a", "the", " ", "  ", "\n", "'", "'s", "ll", "1", "é", "!", " ", "🙂"]) for _ in range(r.randint(0, 30)))
        assert encoder.encode([s])[0].tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_decode(docs, common.tokenizer_file()).collect())
    want = Counter()
    for d, text in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_decode(none, common.tokenizer_file()).count() == 0


# ---- 7 and 8


def brute_quality(t):
    t = t or ""
    w = words(t)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def labelled(spark, write, n=240):
    rows, labels = [], []
    for i in range(n):
        text, bad, toxic = prose(60, 100 + i), i % 5 == 0, i % 6 == 1
        if bad:
            text = " ".join(w + "***" for w in text.split(" "))
        if toxic:
            text = re.sub(r" (\S+) (\S+) (\S+) ", r" scumword \2 trashword ", text)
        rows.append((i, text))
        if i % 2 == 0 or i % 3 == 1:
            labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 0), (3, None, None), (10**6, 0, 1)]
    return write(documents=spark.createDataFrame(rows, "doc_id bigint, text string"), labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")), rows


def test_quality_counts_and_rules(spark, docs, none, write):
    got = Counter(tuple(r)[:6] for r in quality.statistics(docs).collect())
    assert got == Counter((d, *brute_quality(t)) for d, t in corpus())
    where, rows = labelled(spark, write)
    out = {r["doc_id"]: r for r in quality.op7_quality(spark, where).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["kept"] == (i % 5 != 0) for i in out if not out[i]["base_failed"])
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.fit(docs, empty) == [] and quality.statistics(none).count() == 0


def test_toxicity_recognises_held_out_documents(spark, docs, none, write):
    where, rows = labelled(spark, write)
    out = {r["doc_id"]: r["rejected"] for r in toxicity.op8_toxicity(spark, where).collect()}
    assert len(out) == len(rows)
    right = sum(out[i] == (i % 6 == 1) for i in out)
    assert right / len(out) > 0.97
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, empty)
    assert {r["rejected"] for r in toxicity.score(docs, model).collect()} == {False}
    assert toxicity.without_rejected(docs, model).count() == len(corpus()) and toxicity.score(none, model).count() == 0


def test_ordinal_likelihood_and_slopes():
    """Against the plain formula, one document at a time, and finite differences."""
    r = np.random.default_rng(4)
    rows, cols, values = r.integers(0, 12, 60), r.integers(0, 5, 60), r.random(60)
    grade, w, gaps = r.integers(0, 3, 12), r.normal(size=5), np.array([0.3, -0.4])

    def plain(w, gaps):
        theta, total = [gaps[0], gaps[0] + np.exp(gaps[1])], 0.0
        for i in range(12):
            z = sum(w[c] * v for d, c, v in zip(rows, cols, values) if d == i)
            above = [1.0, *(1 / (1 + np.exp(t - z)) for t in theta), 0.0]
            total -= np.log(above[grade[i]] - above[grade[i] + 1])
        return total / 12 + 0.01 / 2 * float(w @ w)

    loss, gw, gg = toxicity.likelihood(w, gaps, rows, cols, values, grade, 0.01)
    assert abs(loss - plain(w, gaps)) < 1e-12
    for at, g in ((w, gw), (gaps, gg)):
        for i in range(len(at)):
            up, down = at.copy(), at.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            step = (plain(up, gaps) - plain(down, gaps)) if at is w else (plain(w, up) - plain(w, down))
            assert abs(g[i] - step / 2e-5) < 1e-7


def test_toxicity_scores_against_the_formula(spark, write):
    """Every severity from counts of words and stems, without the operator's own code."""
    where, rows = labelled(spark, write)
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["severity"] for r in toxicity.score(docs, model).collect()}
    for i, text in rows:
        found = [w.strip(toxicity._EDGE) for w in words(text.lower())]
        z = sum(model.weights.get(w, 0) for w in found) + sum(model.weights.get(w[:5] + "*", 0) for w in found if len(w) > 5)
        z *= 10 / np.sqrt(len(found) + 50)
        assert abs(got[i] - sum(1 / (1 + np.exp(t - z)) for t in model.thresholds)) < 1e-9
    again = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' more') as text"))  # ids that repeat, with other texts
    drawn, totals = toxicity.drawn_rows(again, labels, 50)
    assert drawn.count() == sum(totals.values()) <= 100 and max(totals.values()) == 50
    few = toxicity.fit(again, labels, rows=50)
    assert len(few.thresholds) == 2 and few.thresholds[0] < few.thresholds[1]


def test_ordinal_thresholds_are_ordered():
    rows, cols = np.arange(90), np.zeros(90, int)
    values = np.r_[np.zeros(30), np.ones(30), 2 * np.ones(30)]
    w, theta = toxicity._fit(rows, cols, values, np.repeat([0, 1, 2], 30), 1)
    assert w[0] > 0 and theta[0] < theta[1]


# ---- 9


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(1)
    vec = r.normal(size=(300, 6)).astype(np.float32)
    vec[100:160] = vec[100]  # ties
    rows = [(i, [float(x) for x in v], "c") for i, v in enumerate(vec)] + [(900, None, "c"), (901, [1.0, None] * 3, "c"), (902, [float("nan")] * 6, "c"), (903, [float("inf")] * 6, "c"), (904, [1.0, 2.0], "c"), (950, [1.0, 2.0], "c"), (7, [0.5] * 6, "c")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string").repartition(5)
    got = sorted(tuple(x) for x in topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect())
    fine = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    want = []
    for q, a in fine:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in fine if i != q and len(a) == len(b))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0
    huge = spark.createDataFrame([(50, [1e308, 1.0]), (51, [2.0, 1.0]), (100, [3.0, -1e200]), (101, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = sorted(tuple(x) for x in topk.top_k(huge, huge.filter("vec_id % 50 = 0"), 5).collect())
    most = 2**63 - 1  # scores are held to the range of a long
    assert got == [(50, 1, 51, most), (50, 2, 100, most), (50, 3, 101, most), (100, 1, 50, most), (100, 2, 51, -most - 1), (100, 3, 101, -most - 1)]
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [-1.0, 3.0]), (3, [2.0, 2.0])]
    again = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for k in (2, 4, 20):  # all rows of an id ask
        want = sorted((-int(65536 * (a[0] * b[0] + a[1] * b[1])), j) for i, a in rows if i == 50 for j, b in rows if j != 50)[:k]
        got = [tuple(x) for x in topk.top_k(again, again.filter("vec_id = 50"), k).orderBy("rank").collect()]
        assert got == [(50, n + 1, j, -s) for n, (s, j) in enumerate(want)]


# ---- 10


def brute_groups(rows, k, percent):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().decode()
        w = words(w)
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return Counter((d, len(s), root(d) if d is not None else None, d is None or root(d) == d) for d, s in sets)


def test_near_duplicates_against_brute_force(spark, docs, none):
    got = Counter(tuple(r) for r in neardup.near_duplicates(docs, 4, 80).collect())
    assert got == brute_groups(corpus(), 4, 80)
    assert neardup.near_duplicates(none, 4, 80).count() == 0


def test_a_large_group_of_near_copies(spark):
    rows = []
    for i in range(150):
        r = random.Random(i)
        w = prose(80, 50 + i % 3).split(" ")
        for j in r.sample(range(80), r.randint(0, 3)):
            w[j] = f"new{i}x{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in neardup.near_duplicates(df, 4, 80).collect())
    assert got == brute_groups(rows, 4, 80)


def test_links_inside_a_large_family(spark):
    """Thousands of texts below the threshold: a pair of them that reaches it must be found wherever it sorts."""
    rows, base = [], prose(400, 60).split(" ")
    for i in range(1100):
        r = random.Random(9000 + i)
        w = list(base)
        for j in r.sample(range(400), 7):  # any two at about 0.76
            w[j] = f"new{i}x{j}"
        rows.append((i, " ".join(w)))
        if i % 20 == 0:  # a partner at a little over 0.8
            for j in range(7, 400, 41):
                w[j] = f"other{i}x{j}"
            rows.append((5000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = Counter(tuple(r) for r in neardup.near_duplicates(df, 4, 80).collect())
    assert got == brute_groups(rows, 4, 80)


def test_rows_of_one_id_go_only_if_linked(spark):
    near = prose(80, 71).split(" ")
    near[79] = "changed"
    rows = [(1, prose(80, 70), "a"), (1, prose(80, 71), "b"), (2, " ".join(near), "c"), (3, prose(80, 72), "d"), (3, prose(80, 72), "e"), (4, prose(80, 70), "f"), (4, prose(80, 73), "g"), (5, "", "h"), (5, prose(80, 74), "i")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert sorted(r["source"] for r in neardup.one_of_each(df).collect()) == ["a", "b", "d", "g", "h", "i"]


def test_ids_of_any_integer_type(spark):
    df = spark.createDataFrame([(1, prose(60, 1)), (2, prose(60, 1)), (3, "a.b@c.de")], "doc_id int, text string")
    assert {r["doc_id"] for r in pii.find(df).collect()} == {1, 2, 3}
    assert {r["doc_id"] for r in bpe.encode_decode(df, common.tokenizer_file()).collect()} == {1, 2, 3}
    assert {r["doc_id"] for r in packing.token_pieces(df, common.tokenizer_file()).collect()} == {1, 2, 3}
    assert {r["doc_id"] for r in substrings.remove_repeats(df).filter("n_removed > 0").collect()} == {1, 2}
    assert {r["doc_id"] for r in neardup.near_duplicates(df).filter("kept").collect()} == {1, 3}
    assert {r["doc_id"] for r in lines.dedup_lines(df).filter("n_removed > 0").collect()} == {2}
    assert {r["doc_id"] for r in quality.statistics(df).collect()} == {1, 2, 3}


# ---- pipeline


def test_pipeline_stages(spark, write):
    import corpus_pipeline

    where, rows = labelled(spark, write)
    docs = spark.read.parquet(f"{where}/documents.parquet").selectExpr("doc_id", "concat(text, '\\nmail me at a.b@c.de please now') as text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    copies = docs.filter("doc_id between 20 and 40").selectExpr("doc_id + 1000 as doc_id", "concat(text, ' more') as text", "lang", "source", "n_chars")
    at = docs.unionByName(copies)
    names, seen = [], []
    for name, stage in corpus_pipeline.STAGES:
        at = common.staged(stage(spark, at, where), "test-stage")
        names.append(name)
        seen.append(at)
        if name != "packing":
            assert at.columns == docs.columns
    assert names == ["toxicity", "line dedup", "near duplicates", "personal data", "packing"]
    left = {r["doc_id"] for r in seen[0].collect()}
    assert sum(d % 6 == 1 for d in left if d < 1000) <= 2 and len([d for d in left if d < 1000]) >= 195
    texts = {r["doc_id"]: r["text"] for r in seen[1].collect()}
    # counts can't be read back: a text left with one empty line is an empty text
    expected = brute_lines([(r["doc_id"], r["text"]) for r in seen[0].collect()])
    empty = {hashlib.sha256(x.encode()).hexdigest() for x in ("", "\n")}
    assert {(d, digest) for d, _, _, digest in expected if digest not in empty} == {(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in texts.items()}
    kept = {(r[0]) for r in brute_groups(list(texts.items()), 5, 80) if r[3]}
    assert {r["doc_id"] for r in seen[2].collect()} == kept
    assert all("@" not in (r["text"] or "") and r["n_chars"] == len(r["text"] or "") for r in seen[3].collect())
    check_packing(seen[4].collect(), 2048)
    assert {r["doc_id"] for r in seen[4].collect()} == kept


def test_pipeline_of_odd_rows(spark, write):
    """Nulls, empty texts, repeated and equal rows, columns that clash with those of operators, empty tables."""
    import corpus_pipeline

    where, _ = labelled(spark, write)
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, d string, gone string, row string, node string, block string, severity string"
    odd = ["d", "g", "r", "n", "b", "s"]
    rows = [(1, None), (2, ""), (3, " \n "), (None, prose(50, 1)), (None, prose(50, 2)), (4, prose(60, 3)), (4, prose(60, 3)), (4, prose(60, 4)), (5, prose(3000, 5)), (6, "one\ntwo"), (7, "one")]
    at = spark.createDataFrame([(i, t, None, None, None, *odd) for i, t in rows], kinds)
    none = at.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        columns = at.columns
        at, none = (common.staged(stage(spark, x, where), "test-odd") for x in (at, none))
        assert none.count() == 0
        if name != "packing":
            assert at.columns == columns and all(tuple(r)[-6:] == tuple(odd) for r in at.collect())
    got = Counter(r["doc_id"] for r in at.filter("piece = 0").collect())
    assert got == {1: 1, 2: 1, 3: 1, None: 2, 4: 2, 5: 1, 6: 1}
