"""The sample of common shingles decides the order and the salt, never the result."""

from __future__ import annotations

import random

from effectlens.llm import neardup


def test_no_result_depends_on_the_sample(spark, monkeypatch):
    r = random.Random(4)
    stock = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(120):
        words = f"{r.choice(stock)} {r.choice(stock)}".split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice("klm")
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(neardup, "BLOCK", 4)
    found = []
    for sampled in (1, 10, 10**9):  # a text or so, some, and all of them
        monkeypatch.setattr(neardup, "SAMPLED", sampled)
        found.append((len(neardup.common_shingles(docs, 4)[0]), sorted(map(tuple, neardup.near_duplicates(docs, k=4).collect()))))
    sizes, results = zip(*found, strict=True)
    assert sizes[0] != sizes[2] and results[0] == results[1] == results[2]
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    label = {i: i for i in sets}
    for a in sets:  # brute force: linked documents share the least id
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    assert {x[0]: x[2] for x in results[0]} == label
