"""Collocations against a plain count of every phrase."""

import re
from collections import Counter

import pytest

from tallyloom.llm import phrases


def plain(rows, top, least, longest=5):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(" ".join(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in counts.items():
        inside, kept = {}, []
        for p, a in own.items():
            w = p.split(" ")
            for i in range(len(w)):
                for j in range(i + 1, len(w) + 1):
                    if j - i < len(w) and a >= least:
                        part = " ".join(w[i:j])
                        inside[part] = max(inside.get(part, 0), a)
        for p, a in own.items():
            w = p.split(" ")
            if a < least or len(w) < 2 or inside.get(p, 0) >= a:
                continue
            cuts = [(" ".join(w[:k]), " ".join(w[k:])) for k in range(1, len(w))]
            score, k = min((1000 * a * n[lang] // (own[x] * own[y]), k) for k, (x, y) in enumerate(cuts))
            kept.append((-score, -a, p.encode(), own[cuts[k][0]], own[cuts[k][1]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def corpus():
    import random

    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(300)] + ["The", "é", "日本", "ſ"]
    rows = []
    for i in range(260):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r\n", "\x85", "\x1c"]) for _ in range(r.randrange(120)))
        rows.append((r.choice(["en", "en", "de", "und", None]), r.choice(["", "Rare one indeed here so ", "of the  of the "]) + text))
    return rows + [("en", None), ("fr", ""), ("fr", " \t"), ("x", "!!"), (None, "a" * 70_000), ("en", "again and " * 4000)]


@pytest.mark.parametrize(("top", "least", "start", "growth", "bits", "hold"), [(2000, 5, 1 / 1024, 64, 20, 1 << 21), (7, 3, 1 / 256, 8, 17, 500)])
def test_equals_plain_counts(spark, top, least, start, growth, bits, hold):
    rows = corpus()
    docs = spark.createDataFrame([(t, x, "a", 1, "p") for x, t in rows], "text string, lang string, phrase string, a long, w string")
    got = phrases.mine(docs, top=top, least=least, start=start, growth=growth, bits=bits, hold=hold)
    assert sorted(map(tuple, got.collect())) == plain(rows, top, least)
    assert got.schema.simpleString() == "struct<lang:string,rank:bigint,phrase:string,a:bigint,l:bigint,r:bigint,n:bigint,score:bigint>"


def test_a_settled_language_needs_no_further_round(spark, monkeypatch):
    """With few phrases asked for, frequent words are never expanded, and the answer is the same."""
    rows, rounds, count = corpus(), [], phrases.count
    docs = spark.createDataFrame([(t, x) for x, t in rows], "text string, lang string")
    monkeypatch.setattr(phrases, "count", lambda *a: rounds.append(a[1]) or count(*a))
    got = phrases.mine(docs, top=1, least=3, start=1 / 2048, growth=4, bits=20)
    assert sorted(map(tuple, got.collect())) == plain(rows, 1, 3)
    assert len(rounds) < 1 + 2 * 4  # at a limit of the 2048th, 512th, 128th and 32nd part and so on


def test_no_rows(spark, no_docs, odd_docs):
    assert phrases.mine(no_docs).collect() == []
    rows = [tuple(r) for r in odd_docs.select("lang", "text").collect()]
    for least in (2, 100):
        assert sorted(map(tuple, phrases.mine(odd_docs, least=least).collect())) == plain(rows, 2000, least)
    assert phrases.mine(odd_docs.where("doc_id < 5"), least=3).collect() == []


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r are exact where they pass 64 bits."""
    rows = [("en", "a b", 3 * 10**12, 2), ("en", "b c", 3 * 10**12, 2)]
    counts = spark.createDataFrame([("en", p, a) for _, p, a, _ in rows] + [("en", w, a) for w, a in (("a", 4 * 10**12), ("b", 5 * 10**12), ("c", 3 * 10**12 + 1))], phrases.COUNTED)
    limits = spark.createDataFrame([("en", 2 * 10**13, 10**14)], "lang string, n long, high long")
    got = phrases.scored(counts.where("phrase like '% %'"), counts, limits).collect()
    n = 2 * 10**13
    assert sorted((r.phrase, r.score) for r in got) == [("a b", 1000 * 3 * 10**12 * n // (4 * 10**12 * 5 * 10**12)), ("b c", 1000 * 3 * 10**12 * n // (5 * 10**12 * (3 * 10**12 + 1)))]
