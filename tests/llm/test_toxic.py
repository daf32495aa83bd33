"""A few insults in an otherwise good text must count, however long it is."""

import tracemalloc

import numpy as np
import pyarrow as pa

from mosaiq.llm import ngram_quality


def test_few_insults_are_rejected(spark):
    rng = np.random.default_rng(17)
    parts = ["the", "an", "er", "on", "tion", "ed", "re", "st", "nd", "le"]
    plain = lambda n: ["".join(rng.choice(parts, int(rng.integers(1, 4)))) for _ in range(n)]
    insults = ["idiot", "scum", "moron", "trash"]

    def mixed(n, k):
        words = plain(n)
        for at in rng.choice(n, k, replace=False):
            words[at] = str(rng.choice(insults))
        return " ".join(words)

    good = [" ".join(plain(80)) for _ in range(150)]
    toxic = [mixed(80, 3) for _ in range(60)]
    new = [mixed(100, 2) for _ in range(10)] + [mixed(2000, 2)]
    texts = good + toxic + new
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i >= 150)) for i in range(30, 210)], "doc_id long, quality int, toxic int")
    keep = {r.doc_id: r._mq_keep for r in ngram_quality.classify(docs, labels, columns=["doc_id"]).collect()}
    assert len(keep) == len(texts)
    assert not any(keep[i] for i in range(210, len(texts)))  # unlabelled, the last one long
    assert sum(keep[i] for i in range(30)) >= 28 and sum(keep[i] for i in range(150, 210)) <= 3


def test_worst_windows():
    rng = np.random.default_rng(1)
    n = np.array([0, 3, 50, 0, 7, 0])
    x = rng.normal(size=60)
    got = ngram_quality.worst_windows(x, np.repeat(np.arange(6), n), n, 7)
    at = 0
    for k, g in zip(n, got):
        part = x[at : at + k]
        at += k
        w = min(7, k)
        assert np.isnan(g) if not k else np.isclose(g, max(part[i : i + w].sum() for i in range(k - w + 1)))


def test_words_are_split_without_a_string_a_word():
    """Bytes that NumPy and Python take at most: 170 a distinct word when each was a string of its own."""
    texts = pa.array([" ".join(f"w{i * 2654435761 % (1 << 32):08x}" for i in range(k, k + 1000)) for k in range(0, 100_000, 1000)])
    ngram_quality.Words.of([texts[:1]])
    tracemalloc.start()
    words = ngram_quality.Words.of([texts])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words.types) == 100_000 and most < 160 * 100_000
    odd = ngram_quality.Words.of([pa.array([" a b b ", None, "\u00e9\U0001f600 \0x a"])])
    assert odd.n.tolist() == [3, 0, 3] and odd.chars.tolist() == [97, 98, 233, 128512, 0xFFFD, 120] and ngram_quality.Words.of([pa.array(["", None])]).chars.size == 0
