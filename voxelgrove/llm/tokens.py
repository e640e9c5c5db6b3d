"""Token ids of whole texts by a file of the ``tokenizers`` library, many documents at once.

Texts are cut at blanks and line breaks that follow a character which is surely not white space: there a byte-level BPE's pre-tokenizer always
begins a new piece, so the ids of the chunks are the ids of the text. Each distinct chunk is encoded once and then looked up by its hash.

Where the same vocabulary lies beside the file as ranks for ``tiktoken``, new chunks are encoded by that library, which gives the same ids faster
(the tests hold the two against each other); texts with a special token's name, and files without ranks, go to ``tokenizers``.
"""

from __future__ import annotations

import os

import numpy as np

from .bytetext import span_hashes

#: Values of the bytes in the chunks' hashes; here A-Z differ from a-z.
RAW_VALUES = np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.uint64)
#: The cache is emptied beyond so many chunks, and holds none longer than LONGEST bytes.
MOST_CHUNKS = 800_000
LONGEST = 256

_b = np.arange(256)
_PLAIN = (_b > 0x20) & (_b < 0x7F)
_TAIL = (_b >= 0x80) & (_b < 0xC0)
#: First bytes of two-byte characters among which there is no white space.
_LEAD = (_b >= 0xC3) & (_b <= 0xDF)
_CUT = (_b == 0x20) | (_b == 0x0A)


def chunk_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each document that has a text, and at the safe cuts."""
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        before = _PLAIN[data[:-1]]
        before[1:] |= _TAIL[data[1:-1]] & _LEAD[data[:-2]]
        cut[1:] = _CUT[data[1:]] & before
    cut[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Of one tokenizer file; one for each worker process."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = None
        if os.path.exists(beside := path.removesuffix(".json") + ".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(beside, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, k in ranks.items():
                self.n_bytes[k] = len(token)
        self._empty()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _empty(self) -> None:
        self.slots: dict[int, int] = {}
        self.first, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool, self.used = np.zeros(1 << 14, np.uint32), 0

    def _add(self, hashes: list[int], lengths: np.ndarray, flat: np.ndarray) -> None:
        n = len(self.slots)
        while n + len(hashes) > len(self.first):
            self.first, self.length = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.length, np.zeros_like(self.length)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.first[n : n + len(hashes)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(hashes)] = lengths
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.slots.update(zip(hashes, range(n, n + len(hashes)), strict=True))

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and all of them."""
        joined = bool(self.ranks)
        plain = [joined and c[0] in b" \n" and 0x20 < c[-1] < 0x7F for c in chunks]
        text = b"".join(c for c, p in zip(chunks, plain, strict=True) if p).decode()
        if any(x in text for x in self.special):
            plain, text = [False] * len(chunks), ""
        # Chunks that begin at a safe cut and end in a plain character may follow one another in one text; the tokens' lengths tell them apart.
        ids = np.array(self.ranks.encode_ordinary(text), np.uint32) if text else np.zeros(0, np.uint32)
        ends = np.cumsum([len(c) for c, p in zip(chunks, plain, strict=True) if p])
        upto = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1 if text else np.zeros(0, np.int64)
        lengths, parts, k, done = np.zeros(len(chunks), np.int64), [], 0, 0
        for i, (c, p) in enumerate(zip(chunks, plain, strict=True)):
            if p:
                lengths[i] = upto[k] - done
                parts.append(ids[done : upto[k]])
                done, k = int(upto[k]), k + 1
            else:
                t = c.decode()
                own = self.ranks.encode_ordinary(t) if self.ranks and not any(x in t for x in self.special) else self.tokenizer.encode(t, add_special_tokens=False).ids
                lengths[i] = len(own)
                parts.append(np.array(own, np.uint32))
        return lengths, np.concatenate(parts) if parts else ids

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice, one after the other, and where each document's begin (with the total last)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        if len(self.slots) > MOST_CHUNKS:
            self._empty()
        starts = chunk_starts(data, at)
        ends = np.append(starts[1:], len(data))
        distinct, index, inverse = np.unique(span_hashes(data, starts, ends, RAW_VALUES), return_index=True, return_inverse=True)
        keys = distinct.tolist()
        slots = np.fromiter((self.slots.get(k, -1) for k in keys), np.int64, len(keys))
        raw = data.tobytes()
        missing = np.flatnonzero(slots < 0)
        long = ends[index[missing]] - starts[index[missing]] > LONGEST
        if len(missing):
            chunk = lambda k: raw[starts[index[k]] : ends[index[k]]]
            short = missing[~long]
            base = len(self.slots)
            if len(short):
                self._add([keys[k] for k in short], *self._encode([chunk(k) for k in short]))
                slots[short] = base + np.arange(len(short))
            apart = {int(k): self._encode([chunk(k)])[1] for k in missing[long]}
        else:
            apart = {}
        length = np.where(slots >= 0, self.length[slots], 0).astype(np.int64)
        for k, ids in apart.items():
            length[k] = len(ids)
        first = np.where(slots >= 0, self.first[slots], -1)
        each = length[inverse]
        begins = np.concatenate([[0], np.cumsum(each)])
        source = np.repeat(first[inverse] - begins[:-1], each) + np.arange(begins[-1])
        if apart:
            ids = self.pool[np.clip(source, 0, self.used)]
            for c in np.flatnonzero(slots[inverse] < 0):
                ids[begins[c] : begins[c + 1]] = apart[int(inverse[c])]
        else:
            ids = self.pool[source]
        return ids, begins[np.searchsorted(starts, at)]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file on this machine; executors look it up themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)
