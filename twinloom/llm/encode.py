"""Public tokenizers inside tasks. ``vocabulary`` is the path of a vocabulary file, or the name of one in the installed
``public_tokenizers``; each worker loads it once. Nothing is trained and nothing is copied."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

WORDS = "word_bpe_49k.json"
BYTES = "byte_bpe_50k.tiktoken"
#: Parts a worker remembers; a full memory is emptied, which costs time only.
REMEMBERED = 600_000
#: New parts encoded in one run, and what parts them.
RUN = 2000
MARK = b"~"
#: Bytes of text cut into parts at a time.
PIECE = 1 << 22
WHITE = b" \t\n\x0b\x0c\r"
#: Control characters, the apostrophe, what special tokens begin with, the mark, and what begins a character that is neither
#: ASCII nor in U+00C0 to U+017F. Of the latter, two are no letters and one is lower-cased to two characters.
ODD_PART = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f'<~\xc0-\xc2\xc6-\xff]|\xc3[\x97\xb7]|\xc4\xb0")
ODD_PAIRS = [0xC397, 0xC3B7, 0xC4B0]
#: By byte: 0 for white space, 4 for the above, 1 for letters and all else beyond ASCII, 2 for digits, 3 for others.
KIND = bytes(0 if bytes([b]) in WHITE else 4 if ODD_PART.match(bytes([b])) else 1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256))
LOWER = bytes(range(256)).lower()
#: A text that shows whether a tokenizer parts texts like that.
PROBE = "Ab a1,b; 12 \u00c9.x #c-\u00e99\u0161 (Zz)".encode()
PROBE_PARTS = "ab a 1 , b ; 1 2 \u00c9 . x # c - \u00e9 9 \u0161 ( zz )".encode().split()


def located(vocabulary: str) -> str:
    if os.path.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return str(public_tokenizers.path(vocabulary))


@lru_cache(maxsize=2)
def byte_bpe(vocabulary: str) -> Callable[[str], list[int]]:
    import public_tokenizers
    import tiktoken

    with open(located(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own.encode_ordinary


class WordBpe:
    """Ids of whole texts by a tokenizer that drops white space, lower-cases, and never joins across white space or
    between letters, digits and other signs.

    For such a tokenizer the ids of a text are those of its parts one after the other, so each worker encodes a part once
    and remembers its ids. A part is a run of letters, a digit, or a run of other signs, with A-Z lower-cased. A chunk
    between white space that holds anything but ASCII and the letters from U+00C0 to U+017F, or signs that a tokenizer may
    join otherwise (``ODD_PART``), is one part as it stands. Texts are cut in numpy, equal parts are found by Arrow. New
    parts are encoded in long runs and told apart by ids that end a word; odd chunks, which may hold several words, and all parts
    of a tokenizer without such ids, by a mark between them that is one id of its own. Chunks that hold the mark are encoded alone.
    ``tests/llm`` compares with whole-text encoding.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(located(vocabulary))
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) < 1 << 16 else "<u4"
        (self.mark,) = self.ids(MARK.decode())
        model = self.tokenizer.model
        suffix, n_ids = getattr(model, "end_of_word_suffix", None), self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(n_ids)]) if suffix else None  # ids that end a part
        self.fine = self.ids(PROBE.decode()).tolist() == [i for p in PROBE_PARTS for i in self.ids(p.decode()).tolist()]
        if not self.fine:  # parts are chunks between white space
            self.last = None
        self.forget()

    def forget(self) -> None:
        self.parts: dict[bytes, int] = {}
        self.known = np.zeros(0, self.kind)  # the ids of all parts, and where those of a part end
        self.ends = np.zeros(1, np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def learn(self, new: list[bytes]) -> None:
        odd = [self.last is None or bool(ODD_PART.search(c)) for c in new]
        one, alone, marked = [c for c, o in zip(new, odd) if not o], [], []
        for c in (c for c, o in zip(new, odd) if o):
            (alone if MARK in c else marked).append(c)
        runs, sizes = [self.known], []
        for some, by in ((one, b" "), (marked, b" " + MARK + b" ")):
            for lo in range(0, len(some), RUN):
                run = some[lo : lo + RUN]
                ids = self.ids(by.join(run).decode())
                if by == b" ":
                    ends = np.flatnonzero(self.last[ids]) + 1
                else:
                    held = ids != self.mark
                    ends = np.append(np.cumsum(held)[~held], held.sum())
                    ids = ids[held]
                if len(ends) != len(run):
                    raise ValueError("parts are not told apart in the ids")
                runs.append(ids)
                sizes.append(np.diff(ends, prepend=0))
        for c in alone:
            runs.append(self.ids(c.decode()))
            sizes.append([len(runs[-1])])
        self.parts.update(zip([*one, *marked, *alone], range(len(self.parts), len(self.parts) + len(new))))
        self.known = np.concatenate(runs)
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes)))

    def places(self, used: list[bytes]) -> np.ndarray:
        """Numbers of different parts."""
        new = [c for c in used if c not in self.parts]
        if len(self.parts) + len(new) > REMEMBERED:
            self.forget()
            new = used
        if new:
            self.learn(new)
        return np.fromiter(map(self.parts.__getitem__, used), np.int64, len(used))

    def piece(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a piece of text, and how many of them come before each of the edges, which parts do not cross."""
        starts, body, sizes = cut(raw, edges[edges < len(raw)], self.fine)
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        place = self.places(held.dictionary.to_numpy(zero_copy_only=False).tolist())[held.indices.to_numpy()]
        begins, sizes = self.ends.take(place), self.ends.take(place + 1)
        sizes -= begins
        total = np.append(0, np.cumsum(sizes))
        begins -= total[:-1]
        at = np.repeat(begins, sizes)
        at += np.arange(len(at))
        return self.known.take(at), total[np.searchsorted(starts, edges)]

    def packed(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts that lie one after the other and end at these places, and how many each has; about
        ``PIECE`` bytes are in hand at a time."""
        runs, counts, at = [], np.zeros(len(ends), np.int64), 0
        while at < len(data):
            to = min(at + PIECE, len(data))
            if to < len(data):  # on to the end of a text or the next white space
                end = int(ends[np.searchsorted(ends, to)])
                while to < end and data[to] not in WHITE:
                    to += 1
            first, last = np.searchsorted(ends, at, "right"), np.searchsorted(ends, to)
            edges = np.append(0, np.clip(ends[first : last + 1], at, to) - at)
            ids, before = self.piece(data[at:to], edges)
            counts[first : last + 1] += np.diff(before)
            runs.append(ids)
            at = to
        return np.concatenate(runs) if runs else np.zeros(0, self.kind), counts

    def many(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text."""
        ids, counts = self.packed(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64))
        return np.split(ids, np.cumsum(counts)[:-1])


def cut(raw: np.ndarray, edges: np.ndarray, fine: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of a piece of text: where they start, their bytes one after the other without white space, and their sizes.
    Not ``fine``: all chunks are parts as they stand."""
    text = raw.tobytes()
    kind, body = np.frombuffer(text.translate(KIND), np.uint8), np.frombuffer(text.translate(LOWER, WHITE), np.uint8)
    solid = kind != 0
    fresh = np.append(True, ~solid[:-1])  # behind white space, or a text begins
    fresh[edges] = True
    part = kind == 2
    part[1:] |= kind[1:] != kind[:-1]
    part |= fresh
    part &= solid
    starts = np.flatnonzero(part)
    odd = kind == 4 if fine else solid.copy()
    two = np.flatnonzero((raw == 0xC3) | (raw == 0xC4))
    odd[two] |= np.isin(raw[two].astype(np.uint16) << 8 | raw[np.minimum(two + 1, len(raw) - 1)], ODD_PAIRS)
    if odd.any():
        first = fresh[starts]
        chunks = starts[first]
        whole = np.logical_or.reduceat(odd, chunks)
        starts = starts[first | ~whole[np.cumsum(first) - 1]]
        as_is = np.append(np.zeros(chunks[0], bool), np.repeat(whole, np.diff(chunks, append=len(raw))))
        body = np.where(as_is[solid], np.frombuffer(text.translate(None, WHITE), np.uint8), body)
    begins = np.cumsum(solid, dtype=np.int32)[starts] - 1
    return starts, body, np.diff(begins, append=len(body))


@lru_cache(maxsize=2)
def word_bpe(vocabulary: str) -> WordBpe:
    return WordBpe(vocabulary)
