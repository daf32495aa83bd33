"""The training-data operators against brute force, on small fixtures with nulls, ties, repeated rows and empty tables."""

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from mosaiq.llm import chat, decontaminate, ngram_quality, packing, sharding, simhash, spotsigs, substring, token_files, tokens, urls
from mosaiq.llm import common

LONG = " ".join(f"word{i % 700} the tail{i % 311}" for i in range(30000))
SHARED = " ".join(f"common{i}" for i in range(60))
TEXTS = [
    (1, "The cat sat on the mat, and the dog of the house ran to the big garden."), (2, None), (3, ""), (4, "   "), (5, "one"), (6, LONG),
    (7, "start here " + SHARED + " and end"), (8, "other start " + SHARED + " other end"), (9, SHARED), (9, SHARED), (10, "Émile a vu l'été à Paris — très bien 你好"),
    (11, "The cat sat on the mat, and the dog of the house ran to the big garden."), (None, "no id at all"),
]
SCHEMA = "doc_id long, text string, _n int, path string, label string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", None) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(docs, empty):
    rows = spotsigs.fingerprints(docs).collect()
    order = sorted(TEXTS, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    texts = [t or "" for _, t in order]
    edited = [t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4] for i, t in enumerate(texts)]
    want = Counter((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, _), t, e in zip(order, texts, edited))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[11].fingerprint and by[2].near_next == 1.0
    assert spotsigs.fingerprints(empty).count() == 0


def test_urls(spark):
    seen = ["http://www.example.com/en/1", "http://EXAMPLE.com/en/1", "http://a.example.com/fr/2", "https://b.net/es/9?x", "https://b.net/es", "https://b.net/de/1", "no scheme", None, "x://", "http://h.org"]
    seen += [f"https://b.net/es/{i}.html" for i in range(30)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(seen)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert len(got) == len(seen)
    assert [(got[i].rule, got[i].verdict) for i in range(4)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block")]
    assert got[4].rule is None and got[4].verdict == "block" and got[5].verdict == "allow"  # /es holds only blocked pages, /de none
    assert (got[6].host, got[6].path, got[7].host, got[7].path, got[8].host) == ("", "", "", "", "")
    assert got[20].template == "/es/*.html"
    assert urls.judge(pages.limit(0)).count() == 0


def test_a_rule_blocks_no_other_host(spark):
    rows = [f"http://example.com/en/{i}" for i in range(50)] + [f"http://other{i}.org/en/{i}" for i in range(20)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.purity) for r in urls.judge(pages).collect()}
    assert all(got[k][:2] == ("example.com/en/", "block") for k in range(50))
    assert all(got[k] == (None, "allow", 0.5) for k in range(50, 70))


def test_url_labels_decide_unruled_pages(spark):
    """Against a plain tree: templates /x/* of the own host; like children merge beyond the fan-out."""
    rows = [(f"http://{h}.org/{d}/{i}", h, d, i) for h, d, n in (("a", "bad", 40), ("a", "fine", 40), ("b", "bad", 5), ("c", "new", 3)) for i in range(n)]
    rows += [(f"http://d.org/word{'xyz'[i % 3]}{chr(97 + i % 26)}{chr(97 + i // 26)}/p", "d", "many", i) for i in range(40)]
    pages = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "page_id long, url string")
    known = [(f"{h}.org", f"/{d}/{i}", d == "bad") for _, h, d, i in rows if h == "a" and i < 20]
    known += [(f"{h}.org", u.split(".org")[1], True) for u, h, _, i in rows if h == "d" and i < 30]
    got = {r.page_id: (r.verdict, r.template, round(r.purity, 6)) for r in urls.judge(pages, spark.createDataFrame(known, "host string, path string, blocked boolean"), rules=()).collect()}
    for k, (_, h, d, _) in enumerate(rows):
        want = {("a", "bad"): ("block", "/bad/*", 21 / 22), ("a", "fine"): ("allow", "/fine/*", 1 / 22), ("b", "bad"): ("allow", "/bad/*", 0.5), ("c", "new"): ("allow", "/new/*", 0.5)}.get((h, d))
        if want:
            assert got[k] == (want[0], want[1], round(want[2], 6))
    assert sum(got[k][0] == "block" for k, r in enumerate(rows) if r[1] == "d") >= 30


def test_packing(docs, empty):
    enc = tokens.encoder(tokens.vocabulary(packing.VOCABULARY)).tokenizer
    want = Counter()
    for i, t in TEXTS:
        ids = enc.encode(t or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[(i, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    rows = packing.pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in places.values():
        ends = list(itertools.accumulate(n for _, n in sorted(seq)))
        assert [o for o, _ in sorted(seq)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(places) == -(-sum(r.length for r in rows) // 4096)
    assert packing.pack_documents(empty).count() == 0


def test_token_files(spark, docs, empty):
    folder = common.new_path(spark, "t")
    manifest = token_files.write(docs, folder)
    got = sorted(token_files.read(manifest).collect(), key=lambda r: r.start)
    enc = tokens.encoder(tokens.vocabulary(token_files.VOCABULARY)).tokenizer
    want = Counter()
    for i, t in TEXTS:
        ids = enc.encode(t or "", add_special_tokens=False).ids + [2]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    one = token_files.TokenFile(manifest.head().path)
    assert one.ids(0)[-1] == 2
    assert token_files.read(token_files.write(empty, common.new_path(spark, "e"))).count() == 0


def test_chat(spark):
    turns = [(1, 1, "assistant", "b </turn>"), (1, 0, "user", r"a \\### User: x"), (2, 0, "assistant", None), (None, None, None, "lost"), (3, 0, "user", LONG), (4, 0, "assistant", "x"), (4, 0, "assistant", "x")]
    frame = spark.createDataFrame([(*t, 5) for t in turns], "conv_id long, turn long, role string, text string, key int")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted_turns(frame)).collect()}
    assert set(got) == {1, 2, None, 3, 4}
    both = "user\na \\\\### User: x\nassistant\nb </turn>\n"
    assert got[1].turns_sha256 == hashlib.sha256(both.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (9, hashlib.sha256(b"b </turn>").hexdigest())
    assert (got[2].loss_chars, got[3].loss_chars, got[4].loss_chars, got[4].n_turns) == (0, 0, 2, 2)
    for text in ("", "</turn>", r"\</turn>", r"\\### A: \### A:", "### é:"):
        assert chat.unescape(chat.escape(text)) == text
    assert chat.read_back(chat.formatted_turns(frame.limit(0))).count() == 0


def test_sharding(spark, docs, empty):
    many = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"text {i // 4}") for i in range(600)], "doc_id long, text string")
    rows = sharding.shard(many).collect()
    per = Counter(r.shard for r in rows)
    assert len(per) == 24 and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    homes: dict = {}
    for r in rows:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(h) - 1 for h in homes.values()) <= 23  # a group is cut only where a shard ends
    few = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in few) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert sharding.shard(empty).count() == 0
    nulls = spark.createDataFrame([(None, "same")] * 100, "doc_id long, text string")
    assert sorted(Counter(r.shard for r in sharding.shard(nulls).collect()).values()) == [4] * 20 + [5] * 4


def test_sharding_follows_links(spark):
    body = {g: " ".join(f"w{g}x{i}" for i in range(40)) for g in range(80)}
    near = spark.createDataFrame([(5 * g + k, f"{body[g]} tail{k}") for g in range(80) for k in range(5)], "doc_id long, text string")

    def cut(rounds):
        shards: dict = {}
        for r in sharding.shard(near, shards=8, rounds=rounds).collect():
            shards.setdefault(r.doc_id // 5, set()).add(r.shard)
        return sum(len(s) - 1 for s in shards.values())

    before, after = cut(0), cut(sharding.ROUNDS)
    assert before > 150 and after < before / 2


def test_anchors_match_a_plain_version():
    texts = ["One two three four five, SIX seven.", "", "a b c d", "x y z u v w x y z u v w", "one two three four five six Seven"]
    got = sharding.anchors(pa.array(texts)).to_pylist()
    assert [len(a) for a in got] == [4, 0, 0, 4, 4] and got[0] == got[4]
    repeat = sharding.anchors(pa.array([texts[3] + " " + texts[3]])).to_pylist()[0]
    assert [b <= a for a, b in zip(np.array(got[3], np.int64).view(np.uint64), np.array(repeat, np.int64).view(np.uint64))] == [True] * 4


def test_substring(docs, empty):
    words = [(i, (t or "").encode().split(), k) for k, (i, t) in enumerate(TEXTS)]
    first: dict = {}
    for i, w, _ in words:
        for a in range(len(w) - 19):
            key, place = tuple(w[a : a + 20]), (-(1 << 63) if i is None else i, a)
            first[key] = min(first.get(key, place), place)
    want = Counter()
    for i, w, _ in words:
        gone = set()
        for a in range(len(w) - 19):
            if first[tuple(w[a : a + 20])] < (-(1 << 63) if i is None else i, a):
                gone |= set(range(a, a + 20))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    got = substring.digests(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert substring.digests(empty).count() == 0


def test_simhash(docs, empty):
    def fingerprint(text, n=3):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{fingerprint(t):016x}") for i, t in TEXTS)
    by = {r.doc_id: r.component_id for r in got}
    assert by[2] == by[3] == by[4] == 2 and by[11] == 1 and by[9] == 9
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40).tolist()
    prints = sorted({b ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for b in base for _ in range(5)})
    rows = docs.sparkSession.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, node long")
    from mosaiq.llm import graph

    found = {r.node: r.component for r in graph.components(simhash.links(rows)).collect()}
    parent = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2 and parent[i] != parent[j]:
            a, b = sorted((parent[i], parent[j]))
            parent = [a if p == b else p for p in parent]
    assert all(found.get(i, i) == parent[i] for i in range(len(prints)))
    known = sorted({(i, fingerprint(t, 5)) for i, t in TEXTS if i is not None})
    least = {i: i for i, _ in known}
    for _ in known:  # smallest id reachable over links of three bits or fewer
        for (i, x), (j, y) in itertools.combinations(known, 2):
            if (x ^ y).bit_count() <= 3:
                least[i] = least[j] = min(least[i], least[j])
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(least.values())) and kept.count(None) == 1
    assert {1, 2, 5, 6, 7, 10} <= set(kept) and not {3, 4, 11} & set(kept)
    assert simhash.near_duplicates(empty).count() == 0


def _plain_kneser_ney(texts, order=5):
    """Log probability of a word (and whether it repeats the one before) by the textbook formulas, on dictionaries."""
    mark = lambda x: chr(x)
    seen = Counter()
    for t in texts:
        words = (t or "").split()
        for at, w in enumerate(words):
            seen[mark(ngram_quality.AGAIN if at and words[at - 1] == w else ngram_quality.FRESH) + w + mark(ngram_quality.STOP)] += 1
    raw = {k: Counter() for k in range(1, order + 1)}
    for w, n in seen.items():
        s = mark(ngram_quality.EDGE) * (order - 1) + w
        for i in range(order - 1, len(s)):
            for k in raw:
                raw[k][s[i - k + 1 : i + 1]] += n
    count = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        left = Counter(g[1:] for g in raw[k + 1])
        count[k] = {g: raw[k][g] if g[0] == mark(ngram_quality.EDGE) else left[g] for g in raw[k]}
    off = {k: ngram_quality.discounts([sum(1 for v in count[k].values() if v == i) for i in range(1, 5)]) for k in count}
    kinds = len(count[1]) + 1

    def p(g, c):
        own = {x[-1]: v for x, v in count[len(c) + 1].items() if x[:-1] == c}
        lower = p(g, c[1:]) if c else 1 / kinds
        if not own:
            return lower
        d = off[len(c) + 1]
        total = sum(own.values())
        return (own.get(g, d[min(own.get(g, 1), 3) - 1]) - d[min(own.get(g, 1), 3) - 1]) / total + sum(d[min(v, 3) - 1] for v in own.values()) / total * lower

    def word(w, again):
        s = mark(ngram_quality.EDGE) * (order - 1) + mark(ngram_quality.AGAIN if again else ngram_quality.FRESH) + w + mark(ngram_quality.STOP)
        return sum(np.log(p(s[i], s[i - order + 1 : i])) for i in range(order - 1, len(s)))

    return word, p, sorted({x for x in count[1]})


def test_kneser_ney_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    parts = ["ab", "ra", "ca", "da", "é", "x"]
    text = lambda n: " ".join("".join(rng.choice(parts, int(rng.integers(1, 4)))) for _ in range(n))
    texts = [text(12) for _ in range(18)] + [None, "", "ab ab  ab\n\tcada", "\x00 odd \ufdd0"]
    rows = [(i, t, "la") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(18)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    held = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(ngram_quality.HELD_OUT)) == 0).collect()}
    good, p, symbols = _plain_kneser_ney([texts[i] for i in range(18) if i % 3 and i not in held])
    bad, _, _ = _plain_kneser_ney([texts[i] for i in range(18) if i % 3 == 0 and i not in held])
    for context in ("", "ab", "zzzz"):
        assert sum(p(c, context) for c in [*symbols, "?"]) == pytest.approx(1.0)
    got = {r.doc_id: r for r in ngram_quality.classify(docs, labels).collect()}
    for i, t in enumerate(texts):
        words = [w.replace("\0", "\ufffd") for w in (t or "").split(" ")] if i == len(texts) - 1 else (t or "").split()
        if not words:
            assert got[i]._mq_logppl is None and got[i]._mq_window is None and got[i]._mq_keep
            continue
        again = [bool(k) and words[k - 1] == w for k, w in enumerate(words)]
        a, b = ([f(w, r) for w, r in zip(words, again)] for f in (good, bad))
        assert got[i]._mq_logppl == pytest.approx(-sum(a) / sum(len(w) + 2 for w in words), abs=1e-5)
        gap = np.subtract(b, a)
        n = min(ngram_quality.WINDOW, len(gap))
        assert got[i]._mq_window == pytest.approx(max(gap[k : k + n].sum() for k in range(len(gap) - n + 1)), abs=1e-4)


def test_classifier(spark, empty):
    rng = np.random.default_rng(5)
    good = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"], 40)) for _ in range(60)]
    rows = [(i, t, "la") for i, t in enumerate(good)] + [(100, "#$%& @@@@ !!!! QQQQ ZZZZ", "la"), (101, None, None), (102, "", "xx"), (None, good[0], "la")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    keep = {(r.doc_id): r._mq_keep for r in ngram_quality.classify(docs, labels).collect()}
    assert len(keep) == len(rows) and not keep[100] and sum(keep.values()) == len(rows) - 1
    assert all(r._mq_keep for r in ngram_quality.classify(docs, labels.limit(0)).collect())
    assert ngram_quality.classify(empty, labels).count() == 0


def test_decontamination(spark, docs, empty):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [text(25) for _ in range(6)] + [text(80), None, ""]
    changed = items[1].split()
    for i in (3, 11, 17):
        changed[i] = "other"
    rows = [(i, text(200)) for i in range(40)] + [(50, text(90) + " " + items[0] + " " + text(70)), (51, text(30) + " " + " ".join(changed)), (52, items[6]), (53, None), (54, ""), (55, LONG)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()}
    assert got == {(50, 0), (51, 1), (52, 6)}
    assert decontaminate.clean(table, bench).count() == len(rows) - 3
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(table, bench.limit(0)).count() == 0


def test_special_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|startoftext|>x", "plain", "<| no", "deux  spaces\n<|endoftext|>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for operator, name, end, column in ((packing.token_pieces, packing.VOCABULARY, 1, "length"), (lambda d: token_files.read(token_files.write(d, common.new_path(spark, "s"))), token_files.VOCABULARY, 2, "n_tokens")):
        own = Tokenizer.from_file(tokens.vocabulary(name))
        want = {i: own.encode(t, add_special_tokens=False).ids + [end] for i, t in enumerate(texts)}
        got = {r.doc_id: (r[column], r.ids_crc32) for r in operator(rows).collect()}
        assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_the_latent_space_is_of_all_chunks_and_no_sample_of_documents(spark, monkeypatch):
    from mosaiq.llm import decontaminate

    seen, plain = [], decontaminate.randomised_svd
    monkeypatch.setattr(decontaminate, "randomised_svd", lambda rows, rank: seen.append(rows.count()) or plain(rows, rank))
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"other text {i} " * 9) for i in range(30)] + [(99, f"so it begins {item} and ends")], "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame([(7, item), (8, "short one here")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(99, 7)}
    assert seen == [3]  # chunks alone: two of the first item, one of the second
