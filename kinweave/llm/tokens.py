"""Token ids of texts, by a tokenizer file of the `tokenizers` library.

Where chunks between ASCII white space are independent, texts are split by Arrow and the chunks looked up in a
bounded table of those seen lately. Unknown ones are cut into words; plain words go to the tokenizer's model alone, all
else through the whole tokenizer, joined by blanks and told apart by offsets. The texts' ids are gathered by numpy.
Tokenizers for which chunks aren't known to be independent encode each text as a whole.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a worker remembers: some 30 bytes each.
CHUNKS = 500_000
#: Words that it remembers between two calls: some 150 bytes each.
WORDS = 250_000
#: Chunks that go through the whole tokenizer at once.
JOINED = 4000
#: Bytes of text split at once.
SPLIT_AT_ONCE = 4_000_000
#: The parts for which chunks are independent, as they stand in the tokenizer's file.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Below this nothing composes or decomposes and Python lower-cases as the tokenizer does.
SIMPLE = "\u0250"


def gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin : begin + size] one after another."""
    at = np.cumsum(size)
    out = np.arange(int(at[-1]) if len(at) else 0)
    out += np.repeat(begin - at + size, size)
    return values[out]


def byte_letters() -> dict[int, int]:
    """Byte-level tokenizers write printable bytes as themselves and the others as letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        steps = (spec.get("normalizer") or {}).get("normalizers")
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_chunk = steps == NORMALIZERS and pre[0].get("pattern") == {"Regex": SPLIT} and pre[0].get("invert") is True
        self.by_chunk = self.by_chunk and len(pre) == 2 and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
        self.specials = [t["content"] for t in spec.get("added_tokens", ())]
        self.letters = byte_letters()
        flat, wide = np.arange(max(self.tokenizer.get_vocab().values(), default=-1) + 1).astype(self.dtype).tobytes(), self.dtype.itemsize
        self.one = [flat[k : k + wide] for k in range(0, len(flat), wide)]
        self.words: dict[str, bytes] = {}
        self.forget()

    def _keep(self, names: pa.Array, values: np.ndarray, size: np.ndarray) -> None:
        self.names, self.values, self.size = names, values, size
        self.begin = np.cumsum(size) - size
        self.used = np.zeros(len(size), bool)

    def forget(self) -> None:
        """Gives back what was remembered: a worker lives on after its task."""
        self.words.clear()
        self._keep(pa.array([], pa.large_string()), np.zeros(0, self.dtype), np.zeros(0, np.int64))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of lower-case letters below SIMPLE."""
        known = self.words.get(word)
        if known is None:
            text = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            one = self.one
            known = self.words[word] = b"".join([one[t.id] for t in self.tokenizer.model.tokenize(text)])
        return known

    def _learned(self, chunks: list[str]) -> list[bytes]:
        if len(self.words) > WORDS:
            self.words.clear()
        out: list[bytes] = [b""] * len(chunks)
        rest: list[int] = []
        word, known = self._word, self.words.get
        for i, c in enumerate(chunks):
            low = c.lower()
            if not c:
                continue
            if not c.isascii() and max(c) >= SIMPLE:
                rest.append(i)
            elif low.isalpha():
                out[i] = known(low) or word(low)
            elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                out[i] = (known(low[:-1]) or word(low[:-1])) + (known(low[-1]) or word(low[-1]))
            elif "<" in c and any(s in c for s in self.specials):  # joined to others, it could reach over a blank
                out[i] = self.whole(c)
            else:
                rest.append(i)
        for lo in range(0, len(rest), JOINED):
            some = [chunks[i] for i in rest[lo : lo + JOINED]]
            made = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            data, size = np.array(made.ids, self.dtype).tobytes(), self.dtype.itemsize
            begin = np.cumsum([0, *[len(c) + 1 for c in some]])
            starts = np.fromiter((b for b, _ in made.offsets), np.int64, len(made.ids))
            cut = (np.searchsorted(starts, begin, side="left") * size).tolist()
            for i, b, e in zip(rest[lo : lo + JOINED], cut[:-1], cut[1:], strict=True):
                out[i] = data[b:e]
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        if not self.by_chunk:
            return [np.frombuffer(self.whole(t or ""), self.dtype) for t in texts.to_pylist()]
        out: list[np.ndarray] = []
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        lo = 0
        while lo < len(texts):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:], dtype=np.int64), SPLIT_AT_ONCE)))
            out += self._encode(texts.slice(lo, hi - lo))
            lo = hi
        return out

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat = lists.flatten()
        coded = flat.dictionary_encode()  # each different chunk is looked up once
        names = coded.dictionary
        place = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False)
        missing = place < 0
        if missing.any():
            new = names.filter(pa.array(missing))
            made = self._learned(new.to_pylist())
            before = len(self.size)
            values = np.concatenate((self.values, np.frombuffer(b"".join(made), self.dtype)))
            size = np.concatenate((self.size, np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize))
            used = self.used
            self._keep(pa.concat_arrays([self.names, new]), values, size)
            self.used[:before] = used
            place = place.copy()
            place[missing] = np.arange(before, len(size))
        index = place[coded.indices.to_numpy()]
        own = self.size[index]
        ids = gathered(self.values, self.begin[index], own)
        edges = np.concatenate(([0], np.cumsum(own)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        self.used[place] = True
        if len(self.size) > CHUNKS:  # what wasn't used since the last time goes
            stay = self.used if 2 * int(self.used.sum()) < len(self.used) else np.zeros(len(self.used), bool)
            self._keep(self.names.filter(pa.array(stay)), gathered(self.values, self.begin[stay], self.size[stay]), self.size[stay])
        return [ids[b:e] for b, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
