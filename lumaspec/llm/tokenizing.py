"""Token ids of whole texts by public tokenizers, looked up word by word where that is exact.

Texts are cut only where the tokenizer's own pre-tokenizer cuts, whatever stands around: between
words, and between a letter and a common sign. The words of a batch are counted once each, looked up
in a bounded cache that all tasks of a worker process share, and strung together again by arrays.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEPARATOR = "\x1f"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_BEFORE_SIGN = f"([{_LETTERS}])([,.!?:;%*#$&])"
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
_PROBES = ("It's a word, and (two) more: 12,5 % of x-y!", "  Déjà vu...\n\n\tÜber 3.14   fin. ", "a,b.c;d 'll I'll you've «q» ½ 字字 éå,", "x\r\n y  z - -- ,,.. !?")
_CHUNK_CHARS = 1 << 20
_CACHE_WORDS = 200_000  # in each of two generations
_CACHE_CHARS = 100


class WordTokenizer:
    """Ids of whole texts. The file's parts decide how texts are cut: one that drops white space and
    ends words with ``</w>``, or one of bytes in which a space belongs to the word after it. A file
    of any other kind, or one whose probes come out otherwise, is used on whole texts."""

    def __init__(self, path: str, special_tokens: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special_tokens
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        before, model = parts["pre_tokenizer"] or {}, parts["model"]
        steps = before.get("pretokenizers") or [{}]
        drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and "\\s" in str(steps[0].get("pattern")) and model.get("end_of_word_suffix") == "</w>"
        bytewise = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not parts["normalizer"]
        self.rule = "dropped" if drops else "bytes" if bytewise and not model.get("end_of_word_suffix") else None
        self._lowers = drops and "Lowercase" in json.dumps(parts["normalizer"])
        # strings of added tokens are looked for in the text as it stands
        self._whole = ("Σ", _SEPARATOR, *({t["content"][:2] for t in parts["added_tokens"]} if special_tokens else ()))
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        if self.rule and any(self.ids([p])[0] != self._encode([p])[0] for p in _PROBES):
            self.rule = None

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        if self.rule == "dropped":  # many plain words in one call: each ends with the only token that ends a word
            plain = [w for w in words if _PLAIN(w)]
            words = [w for w in words if not _PLAIN(w)]
            groups = [plain[k : k + 100] for k in range(0, len(plain), 100)]
            for group, found in zip(groups, self._tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.asarray(found.ids, "<u4")
                data, at = ids.tobytes(), 0
                for word, end in zip(group, ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist(), strict=True):
                    self._new[word] = data[at:end]
                    at = end
        self._new.update(zip(words, self._encode(words), strict=True))

    def _look_up(self, words: list[str]) -> list[bytes]:
        if len(self._new) > _CACHE_WORDS:
            self._old, self._new = self._new, {}
        new, old = self._new, self._old
        missing = []
        for w in words:
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    missing.append(w)
        if missing:
            self._learn(missing)
        found = [new[w] for w in words]
        for w in missing:
            if len(w) > _CACHE_CHARS:
                del new[w]
        return found

    def _cut(self, texts: list[str]) -> pa.ListArray:
        """The texts' words; white space that the tokenizer drops is none."""
        if self.rule == "dropped":
            if self._lowers:
                texts = [t.lower() for t in texts]
            column = pc.replace_substring_regex(pa.array(texts, pa.string()), _BEFORE_SIGN, r"\1 \2")
            return pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        column = pc.replace_substring_regex(pa.array(texts, pa.string()), " ([!-~À-ÖØ-öø-ÿ])", _SEPARATOR + r" \1")
        return pc.split_pattern(pc.replace_substring_regex(column, _BEFORE_SIGN, r"\1" + _SEPARATOR + r"\2"), _SEPARATOR)

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists, index, found, sizes = self._words(texts)
        flat = np.frombuffer(b"".join(found), "<u4")
        length = sizes[index]
        ends = np.cumsum(length)
        first = ((np.cumsum(sizes) - sizes)[index] - (ends - length)).astype(np.int32)  # a chunk or one text: within 32 bits
        ids = flat[np.repeat(first, length) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        return ids, np.concatenate(([0], ends))[lists.offsets.to_numpy()[1:]]

    def _words(self, texts: list[str]):
        lists = self._cut(texts)
        words = lists.flatten().dictionary_encode()
        found = self._look_up(words.dictionary.to_pylist())
        return lists, words.indices.to_numpy(), found, np.fromiter(map(len, found), np.int64, len(found)) // 4

    def counts(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        whole = [k for k, t in enumerate(texts) if self._as_one(t)]
        rest = list(texts)
        for k in whole:
            rest[k] = ""
        lists, index, _, sizes = self._words(rest)
        out = np.diff(np.concatenate(([0], np.cumsum(sizes[index])))[lists.offsets.to_numpy()])
        out[whole] = [len(b) // 4 for b in self._encode([texts[k] for k in whole])]
        return out

    def _as_one(self, text: str) -> bool:
        return self.rule is None or any(s in text for s in self._whole)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text's end."""
        whole = [k for k, t in enumerate(texts) if self._as_one(t)]
        if not whole:
            return self._some(texts)
        rest = list(texts)
        for k in whole:
            rest[k] = ""
        ids, ends = self._some(rest)
        parts = np.split(ids, ends)[:-1]
        for k, data in zip(whole, self._encode([texts[k] for k in whole]), strict=True):
            parts[k] = np.frombuffer(data, "<u4")
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def ids(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encode(texts)
        return [p.tobytes() for p in np.split(ids, ends)[:-1]]


_SHARED: dict[tuple[str, bool], WordTokenizer] = {}


def shared(path: str, special_tokens: bool = True) -> WordTokenizer:
    """This process's tokenizer of a file: the tasks of one worker learn a word once."""
    key = path, special_tokens
    if key not in _SHARED:
        _SHARED[key] = WordTokenizer(path, special_tokens)
    return _SHARED[key]


def text_chunks(column: pa.Array):
    """``low, high, texts`` over ranges of rows of about a million characters, one row at least; null
    texts are empty. Only one range's texts are Python strings at a time, and after each the memory that
    Arrow keeps for later goes back: a worker that is used again would hold it through other stages."""
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    at, held = 0, 0
    for k, size in enumerate([*sizes, _CHUNK_CHARS + 1]):
        if k > at and held + size > _CHUNK_CHARS:
            yield at, k, [t or "" for t in column.slice(at, k - at).to_pylist()]
            pa.default_memory_pool().release_unused()
            at, held = k, 0
        held += size
