"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a state machine over bytes.

A text is read in blocks of BLOCK characters. A piece of the pre-tokenizer that ends inside a block is encoded at once (ids
of short pieces are kept per worker); a longer one flows through `Transducer`, which holds at most BLOCK + `lookahead`
symbols: it encodes what it holds, emits the tokens that nothing to the right can change any more, and keeps the rest.

How far the right can reach follows from the merge list. Take two continuations of the same text and apply the merges in
order. The tokens that both share change only at their end, and only if a merge (a, b) takes the last shared token, a; the
shared part then loses |a| symbols. A later merge (c, d) can take the next one only if d begins with a or with ab, since
that is what stands to the right now. `lookahead` is the longest chain of this kind, by one pass over the merge list.

Ids equal those of the tokenizers library for files with a BPE model and one of the two pre-tokenizers in PIECES, but for
texts with letters that Python's Unicode tables do not know yet (4330 of Unicode 16, in the word file). Decoding
follows the file's decoder: bytes of the tokens, or, where it has none, the tokens parted by one space. An incomplete
character at the end of a block waits for the next.

Defined results: null texts are empty; an empty text has no ids and decodes to an empty text; rows of equal doc_id, or of
none, are encoded each for itself; strings of added tokens in a text are those tokens; other columns are not read; an empty
table gives an empty result. A text that is not NFC is normalised as a whole and held twice.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import common, tokens

#: Characters read at a time, and symbols that a piece may have before it is encoded in parts.
BLOCK = 1 << 15
#: Pieces whose ids a worker keeps, and the longest of them in characters.
KEPT, KEPT_CHARS = 200_000, 64
#: White space, and how the two public files split texts (contractions, letters, digits, the rest); the same
#: for plain ASCII.
_SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = {
    "word": (
        r"'s|'t|'re|'ve|'m|'ll|'d|[LETTER]+|[DIGIT]|[^SPACE[LETTER][DIGIT]]+",
        r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+",
    ),
    "byte": (
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^SPACE\p{L}\p{N}]+|[SPACE]+(?![^SPACE])|[SPACE]+",
        r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+",
    ),
}


@cache
def _compiled(kind: str) -> tuple[regex.Pattern, re.Pattern]:
    """The two expressions. The word file's letters and digits are those of an older table than the regex module has: what
    Python does not know as assigned is taken out."""
    wide, narrow = PIECES[kind]
    new: list[list[int]] = []
    if "LETTER" in wide:
        for m in regex.finditer(r"[\p{L}\p{N}]", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))):
            c = ord(m.group())
            if unicodedata.category(m.group()) == "Cn":
                if new and new[-1][1] == c - 1:
                    new[-1][1] = c
                else:
                    new.append([c, c])
    out = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in new) + "]"
    wide = wide.replace("[LETTER]", rf"[\p{{L}}--{out}]").replace("[DIGIT]", rf"[\p{{N}}--{out}]").replace("SPACE", _SPACE)
    return regex.compile(wide, regex.V1), re.compile(narrow)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of this kind: itself where Latin-1 prints it, else
    the next free code point from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Merges:
    """A merge list: ids of symbols, the token that a pair makes, and how far the right reaches back."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.end = end
        letters = byte_letters()
        self.inner = [vocab.get(c) for c in letters]
        self.last = [vocab.get(c + end) for c in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        begins: dict[int, int] = {}
        reach: dict[int, int] = {}
        size = {i: len(t[: -len(end)] if end and t.endswith(end) else t) for t, i in vocab.items()}
        longest = 0
        for rank, (x, y) in enumerate(m if isinstance(m, list) else m.split(" ", 1) for m in merges):
            a, b, made = vocab[x], vocab[y], vocab[(x[: -len(end)] if end and x.endswith(end) else x) + y]
            if (a, b) in self.pairs:
                continue
            self.pairs[a, b] = (rank, made)
            begins.setdefault(made, a)
            back, at = 0, b
            while at is not None:
                back, at = max(back, reach.get(at, 0)), begins.get(at)
            back += size[a]
            reach[a], reach[made] = max(reach.get(a, 0), back), max(reach.get(made, 0), back)
            longest = max(longest, back)
        self.lookahead = longest + 1  # the last symbol of a piece is another one than inside
        self.size = size

    def apply(self, symbols: list[int]) -> list[int]:
        """Tokens of a run of symbols: the earliest merge first, from left to right."""
        pairs = self.pairs
        n = len(symbols)
        if n < 2:
            return symbols
        ids = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*pairs[p][:1], i, p[0], p[1]) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a, b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], i, *p))
            h = before[i]
            if h >= 0 and (p := (ids[h], ids[i])) in pairs:
                heapq.heappush(heap, (pairs[p][0], h, *p))
        return [x for x in ids if x >= 0]


class Transducer:
    """One piece, fed in parts; tokens leave once they are stable."""

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.block, self.held = merges, block, bytearray()

    def feed(self, part: bytes) -> Iterator[list[int]]:
        m = self.merges
        for a in range(0, len(part), self.block):
            self.held += part[a : a + self.block]
            if len(self.held) < self.block + m.lookahead:
                continue
            stable, out = len(self.held) - m.lookahead, []
            symbols = [m.inner[b] for b in self.held]
            if None in symbols:  # bytes without a symbol are left out, so positions are counted over the others
                self.held = bytearray(b for b in self.held if m.inner[b] is not None)
                continue
            done = 0
            for token in m.apply(symbols):
                if done + m.size[token] > stable:
                    break
                done += m.size[token]
                out.append(token)
            del self.held[:done]
            yield out

    def close(self) -> list[int]:
        """The tokens of the rest; the transducer is ready for the next piece."""
        rest, self.held = self.held, bytearray()
        symbols = [self.merges.inner[b] for b in rest[:-1]] + [self.merges.last[b] for b in rest[-1:]]
        return self.merges.apply([s for s in symbols if s is not None])


class Codec:
    """Streams of ids from texts and of text from ids, by one tokenizer file."""

    def __init__(self, path: str, block: int = BLOCK):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab = model["vocab"]
        self.merges = Merges(vocab, model["merges"], model.get("end_of_word_suffix") or "")
        self.lower = "Lowercase" in json.dumps(file["normalizer"])
        self.normal = "NFC" in json.dumps(file["normalizer"])
        self.wide, self.narrow = _compiled("word" if "Split" in json.dumps(file["pre_tokenizer"]) else "byte")
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens") or []}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.block, self.kept = block, {}
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.spaced = not file["decoder"]
        written = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in {**vocab, **self.added}.items():
            plain = self.spaced or any(c not in letters for c in token)
            written[i] = (b" " * self.spaced) + (token.encode() if plain else bytes(letters[c] for c in token))
        self.written, self.decimal = written, [str(i) for i in range(len(written))]

    def _piece(self, piece: str) -> list[int]:
        machine = Transducer(self.merges, self.block)
        raw = piece.encode()
        out = [token for part in machine.feed(raw) for token in part]
        return out + machine.close()

    def _pieces(self, pieces: list[str]) -> list[int]:
        kept, out = self.kept, []
        for piece in pieces:
            ids = kept.get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(kept) < KEPT and len(piece) <= KEPT_CHARS:
                    kept[piece] = ids
            out += ids
        return out

    def _plain(self, text: str) -> Iterator[list[int]]:
        """Ids of a text without added tokens: blocks cut before a lone space are split at once; from where a block has
        none, pieces are read one by one, each in parts, up to the first that begins a block later."""
        if not text.isascii():
            if self.normal and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if self.lower:
                text = text.replace("Σ", "σ")  # the library lowers character by character, whatever stands around it
        if self.lower:
            text = text.lower()
        pattern = self.narrow if text.isascii() else self.wide
        at, n = 0, len(text)
        while at < n:
            cut = at + self.block
            if cut < n:
                cut = text.rfind(" ", at + 1, cut)
                while cut > 0 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                    cut = text.rfind(" ", at + 1, cut)
            if cut > 0:
                yield self._pieces(pattern.findall(text[at:cut]))
                at = cut
                continue
            stop = at + self.block
            at = n
            for found in pattern.finditer(text, stop - self.block):
                if found.start() >= stop:
                    at = found.start()
                    break
                machine = Transducer(self.merges, self.block)
                for a in range(found.start(), found.end(), self.block):
                    yield from machine.feed(text[a : min(a + self.block, found.end())].encode())
                yield machine.close()

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """Blocks of ids of a text."""
        if not text:
            return
        if self.split is None or "<|" not in text:
            yield from self._plain(text)
            return
        for part in self.split.split(text):
            if part in self.added:
                yield [self.added[part]]
            elif part:
                yield from self._plain(part)

    def decode(self, blocks: Iterator[list[int]]) -> Iterator[str]:
        """Text of blocks of ids, a part for each block; ids that the file lacks are left out."""
        state, first = codecs.getincrementaldecoder("utf-8")("replace"), self.spaced
        written = self.written
        for ids in blocks:
            try:
                raw = b"".join(map(written.__getitem__, ids))
            except IndexError:
                raw = b"".join([written[i] for i in ids if 0 <= i < len(written)])
            if first and raw:
                raw, first = raw[1:], False
            yield state.decode(raw)
        yield state.decode(b"", True)


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(path: str, block: int = BLOCK) -> Codec:
    """One per worker process, file and block."""
    if (path, block) not in _CODECS:
        _CODECS[path, block] = Codec(path, block)
    return _CODECS[path, block]


def encode(docs: DataFrame, name: str = "word_bpe_49k.json", block: int = BLOCK) -> DataFrame:
    """(doc_id, ids array<int>): the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(tokens.vocabulary(name), block)
        for part in common.by_bytes(batches):
            ids = [[i for some in machine.encode(t) for i in some] for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), common.text_column().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, text): the text of the arrays of ids in `ids`; null arrays are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(tokens.vocabulary(name))
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = ["".join(machine.decode(iter([x or []]))) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, name: str = "word_bpe_49k.json", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text flows through both machines a block at a time, so neither
    its ids nor its decoded text is held as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(tokens.vocabulary(name), block)
        decimal = machine.decimal

        def told(text: str | None) -> tuple[int, str, str]:
            n, seen, back = 0, hashlib.sha256(), hashlib.sha256()

            def passing() -> Iterator[list[int]]:
                nonlocal n
                for ids in machine.encode(text):
                    if ids:
                        seen.update(((" " if n else "") + " ".join(map(decimal.__getitem__, ids))).encode())
                        n += len(ids)
                        yield ids

            for part in machine.decode(passing()):
                back.update(part.encode())
            return n, seen.hexdigest(), back.hexdigest()

        for part in common.by_bytes(batches):
            n, seen, back = zip(*map(told, part.column(1).to_pylist()))
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(seen), pa.array(back)]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long"), common.text_column().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_bounded_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.text_batches(spark)
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
