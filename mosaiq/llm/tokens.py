"""Exact batch encoding with public tokenizer files: each distinct word is encoded once per slice.

Pre-tokenizers of the two files never join what a space separates, so a text's ids are the ids of its space-separated
pieces in order. Texts outside a plain character set, where that might not hold, are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker process keeps between slices; others are encoded again when they come back.
CACHE_WORDS = 200_000
#: Words encoded at a time.
JOINED = 1 << 14


class BatchEncoder:
    """Ids as the library gives them; `plain` encodes the strings of special tokens as ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = not plain
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.word_ends = model.get("end_of_word_suffix") == "</w>"
        mark = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, i in model["vocab"].items():
            mark[i] = token.endswith("</w>") if self.word_ends else token.startswith("Ġ")
        self.mark = mark
        self.odd = r"[^ -~\n\x{c0}-\x{24f}]" if self.word_ends else r"[^ -~\n\x{c0}-\x{24f}]|  |\A | \z| \n|\n "
        self.cache: dict[str, bytes] = {"": b"", "\0": b""}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from one encoding of all: the marked ids show where a word ends or begins."""
        if not words:
            return []
        if len(words) > JOINED:  # an encoding takes some hundred bytes a token
            return [x for a in range(0, len(words), JOINED) for x in self._joined(words[a : a + JOINED])]
        text = " ".join(words) if self.word_ends else "".join([f" {w}" for w in words])
        ids = self.whole([text])[0]
        cuts = np.flatnonzero(self.mark[ids])
        cuts = np.append(0, cuts + 1) if self.word_ends else np.append(cuts, len(ids))
        if len(cuts) != len(words) + 1 or cuts[0] != 0:
            return [x.tobytes() for x in self.whole(words if self.word_ends else [f" {w}" for w in words])]
        raw, at = ids.tobytes(), (cuts * 4).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _lookup(self, words: list[str]) -> list[bytes]:
        cache = self.cache
        got = list(map(cache.get, words))
        missing = [i for i, x in enumerate(got) if x is None]
        if not missing:
            return got
        room = len(cache) < CACHE_WORDS
        if self.word_ends:
            cores: dict[str, bytes | None] = {}
            odd: list[int] = []
            parts: list[tuple[int, str, str]] = []
            for i in missing:
                w = words[i].lower()
                core, tail = (w[:-1], w[-1]) if w[-1] in ".," else (w, "")
                if core.isalpha():
                    cores[core] = cache.get(core)
                    parts.append((i, core, tail))
                else:
                    odd.append(i)
            for t in ".,":
                if t not in cache:
                    cache[t] = self.whole([t])[0].tobytes()
            new = [c for c, x in cores.items() if x is None]
            cores.update(zip(new, self._joined(new)))
            for i, core, tail in parts:
                got[i] = cores[core] + cache[tail] if tail else cores[core]
            for i, x in zip(odd, self.whole([words[i] for i in odd])):
                got[i] = x.tobytes()
        else:
            first = [i for i in missing if words[i][0] == "\0"]
            rest = [i for i in missing if words[i][0] != "\0"]
            for i, x in zip(rest, self._joined([words[i] for i in rest])):
                got[i] = x
            for i, x in zip(first, self.whole([words[i][1:] for i in first])):
                got[i] = x.tobytes()
        if room:
            cache.update((words[i], got[i]) for i in missing if words[i][0] != "\0")
        return got

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Little-endian uint32 ids of each text; no special tokens are added."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if self.special:  # texts that may hold one are encoded whole
            odd = odd | pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        hard = np.flatnonzero(odd)
        if len(hard):
            for i, ids in zip(hard, self.whole(texts.take(pa.array(hard)).to_pylist())):
                out[i] = ids
        easy = np.flatnonzero(~odd)
        if not len(easy):
            return out
        plain = texts.take(pa.array(easy)) if len(hard) else texts
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " ") if self.word_ends else plain, " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        heads = np.append(0, ends[:-1])
        pieces = pc.dictionary_encode(lists.flatten())
        codes = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = pieces.dictionary.to_pylist()
        if not self.word_ends:  # a text's first piece has no space before it
            firsts = pc.dictionary_encode(lists.flatten().take(pa.array(heads)))
            codes[heads] = firsts.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(words)
            words += ["\0" + w for w in firsts.dictionary.to_pylist()]
            used = np.bincount(codes, minlength=len(words)) > 0
            words = [w if u else "" for w, u in zip(words, used.tolist())]
        ids = self._lookup(words)
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[codes]
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        spots = np.repeat(starts[codes] - (upto - n), n)
        spots += np.arange(total)
        all_ids = flat[spots]
        edges = np.append(0, upto[ends - 1])
        for j, i in enumerate(easy):
            out[i] = all_ids[edges[j] : edges[j + 1]]
        return out


_ENCODERS: dict[tuple[str, bool], BatchEncoder] = {}


def encoder(path: str, plain: bool = False) -> BatchEncoder:
    """One encoder per worker process, file and kind."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = BatchEncoder(path, plain)
    return _ENCODERS[path, plain]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, found where the code runs."""
    import public_tokenizers

    return public_tokenizers.path(name)
