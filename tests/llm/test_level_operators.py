"""Clustering, phrases and byte-pair streams against plain versions on small tables with every odd case."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from mosaiq.llm import bpe_stream, phrases, weighted_lloyd
from tokenizers import Tokenizer

from mosaiq.llm.tokens import vocabulary


# ---- centroid clustering


def plain_lloyd(rows, clusters=8, rounds=10, parts=64, seed=3):
    kept = [(i, [int(np.floor(1024.0 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == parts and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", q) for i, q in kept)
    centre = [q for _, _, q in order[:clusters]]
    far = lambda q, c: sum((x - y) ** 2 for x, y in zip(q, c))
    put = lambda: [min(range(len(centre)), key=lambda c: (far(q, centre[c]), c)) for _, q in kept]
    for _ in range(rounds):
        at = put()
        for c in range(len(centre)):
            own = [q for (_, q), a in zip(kept, at) if a == c]
            if own:
                centre[c] = [sum(x) // len(own) for x in zip(*own)]
    at = put()
    d = [far(q, centre[a]) for (_, q), a in zip(kept, at)]
    each = Counter()
    for a, x in zip(at, d):
        each[a] += x
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(((i, a, x, each[a], sum(d), name[a]) for (i, _), a, x in zip(kept, at, d)), key=str)


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(7)
    groups = rng.normal(0, 1, (5, 64))
    rows = [(int(i), [float(x) for x in np.float32(groups[i % 5] + rng.normal(0, 0.4, 64))]) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)] + [(1, rows[3][1]), (1, rows[3][1]), (None, rows[4][1])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 63), (2003, [None] + [0.0] * 63), (2004, [float("nan")] * 64), (2005, [float("inf")] + [1.0] * 63)]
    rows += [(2006, [-0.00001] * 64), (2007, [0.0] * 64)]
    return rows


def test_clusters_equal_plain_lloyd(spark, vectors):
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in vectors], "vec_id long, embedding array<float>, q int, m int, cluster int")
    got = weighted_lloyd.cluster(table).collect()
    assert sorted(map(tuple, got), key=str) == plain_lloyd(vectors)


def test_clusters_without_the_broadcast_of_hot_vectors(spark, vectors, monkeypatch):
    monkeypatch.setattr(weighted_lloyd, "HOT", 1)
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    small = [(i, v and [v and float(np.float32(v)) if v is not None else None for v in v]) for i, v in vectors]
    assert sorted(map(tuple, weighted_lloyd.cluster(table).collect()), key=str) == plain_lloyd(small)


def test_clusters_few_none_and_huge(spark):
    shape = "vec_id long, embedding array<double>"
    assert weighted_lloyd.cluster(spark.createDataFrame([], shape)).count() == 0
    assert weighted_lloyd.cluster(spark.createDataFrame([(1, [1.0])], shape)).count() == 0
    rows = [(1, [0.5] * 64), (2, [-0.5] * 64)]
    assert sorted(map(tuple, weighted_lloyd.cluster(spark.createDataFrame(rows, shape)).collect()), key=str) == plain_lloyd(rows)
    huge = weighted_lloyd.cluster(spark.createDataFrame([(1, [1e308] * 64), (2, [-1e308] * 64)], shape), clusters=1).collect()
    assert {r["distance"] for r in huge} == {64 * weighted_lloyd.LARGEST**2}


# ---- phrases


def plain_phrases(docs, least=10, covered=50, first=2000):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    held = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in held.items():
        longer = [b for (m, t), b in held.items() if m == lang and len(t) > len(p) and any(t[i : i + len(p)] == p for i in range(len(t)))]
        if any(100 * b >= covered * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first]))


@pytest.fixture
def corpus():
    rng = random.Random(11)
    words = ["the", "The", "of", "new", "york", "city", "a\x01", "a", "é", "b", "und", "x" * 300]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(rng.randrange(60)))) for _ in range(250)]
    rows += [("en", "new york city " * 40), ("en", None), ("de", ""), (None, None), ("fr", "!?.,"), ("en", "a a a a a a a a a a a a a a"), ("xx", "only words once")]
    return rows + [("hot", "same words here again")] * 120


SHAPE = "lang string, text string, doc_id long, phrase string, f int, a int"


def test_phrases_equal_plain_counts(spark, corpus):
    docs = spark.createDataFrame([(*r, None, "x", 1, 2) for r in corpus], SHAPE)
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == plain_phrases(corpus)
    few = sorted(map(tuple, phrases.collocations(docs, first=5).collect()))
    assert few == plain_phrases(corpus, first=5)


def test_phrases_with_a_full_filter_and_no_broadcast_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BYTES", 2)  # lets everything through
    monkeypatch.setattr(phrases, "HOT", 1)
    monkeypatch.setattr(phrases.Filter, "size", staticmethod(lambda runs: 2))
    docs = spark.createDataFrame([(*r, None, "x", 1, 2) for r in corpus], SHAPE)
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == plain_phrases(corpus)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], SHAPE)).count() == 0


def test_filter_lets_few_others_through():
    known = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    size = phrases.Filter.size(len(known))
    bits = np.zeros(size, np.uint8)
    for at in phrases.Filter.places(known, size):
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(int), (1 << (at & np.uint64(7)).astype(int)).astype(np.uint8))
    f = phrases.Filter(bits)
    assert f.holds(known).all() and f.holds(known + np.uint64(1)).mean() < 0.02


# ---- byte-pair streams

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(5)
    texts = [None, "", " ", "'s 's'll !!'s", "x<|endoftext|>y  z<|startoftext|>", "<|endoftext|", "Σ ΑΣ ΑΣ. İ é é", "a" * 3000, "ab" * 4000 + " tail", "!" * 3000,
             "日本語" * 500, "  \n\n x  \t y ", "é" * 300, "\x1c\x85  ", "😀" * 50, "a\x00b", " " * 500 + "x"]
    texts += ["".join(rng.choice("abcdeinthr' é!1\n  ") for _ in range(rng.randrange(400))) for _ in range(150)]
    return texts + ["".join(rng.choice("inthearo") for _ in range(rng.randrange(3000))) for _ in range(15)]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("block", [50, 700, bpe_stream.BLOCK])
def test_ids_and_text_equal_the_library(name, block):
    library, own = Tokenizer.from_file(vocabulary(name)), bpe_stream.Codec(vocabulary(name), block)
    for text in odd_texts():
        want = library.encode(text or "", add_special_tokens=False).ids
        assert [i for part in own.encode(text) for i in part] == want, text
        for step in (1, 3, 1000):
            back = "".join(own.decode(want[a : a + step] for a in range(0, len(want), step)))
            assert back == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", FILES)
def test_no_continuation_reaches_beyond_the_lookahead(name):
    """Tokens that end `lookahead` or more symbols before the end are the same whatever follows, and less is held than that."""
    merges = bpe_stream.Codec(vocabulary(name)).merges
    rng = random.Random(3)
    word = lambda n: [merges.inner[ord(rng.choice("aeinrst"))] for _ in range(n)]
    for _ in range(30):
        text = word(merges.lookahead + 400)
        ends = []
        for more in ([], word(1), word(30)):
            at, found = 0, []
            for t in merges.apply(text + more):
                at += merges.size[t]
                found.append((at, t))
            ends.append([x for x in found if x[0] <= len(text) - merges.lookahead])
        assert ends[0] and ends[0] == ends[1] == ends[2]
    machine = bpe_stream.Transducer(merges, 64)
    for part in machine.feed(b"inthear" * 3000):
        assert part and len(machine.held) <= merges.lookahead + 64


def test_streams_of_a_table(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i % 7 or None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    library = Tokenizer.from_file(vocabulary(FILES[0]))
    want = [(i % 7 or None, library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)]
    told = [(d, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for d, x in want]
    assert sorted(map(tuple, bpe_stream.digests(docs).collect()), key=str) == sorted(told, key=str)
    ids = bpe_stream.encode(docs)
    assert sorted(((r[0], r[1]) for r in ids.collect()), key=str) == sorted(want, key=str)
    back = sorted(((d, library.decode(x, skip_special_tokens=False)) for d, x in want), key=str)
    assert sorted(map(tuple, bpe_stream.decode(ids).collect()), key=str) == back
    assert bpe_stream.digests(docs.limit(0)).count() == 0
