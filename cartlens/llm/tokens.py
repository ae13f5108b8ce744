"""Token ids of whole texts, for the operators that write or pack them.

Tokenizer files are read on the driver and travel with the job, so executors
need no file. Encoders return little-endian unsigned ids of type ``kind``.
"""

from __future__ import annotations

import base64
import itertools
import os
import string
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from .common import share

def gather(codes: np.ndarray, starts: np.ndarray, pick: np.ndarray) -> tuple:
    """The slices ``pick`` of a ragged array (codes, starts) one after the other."""
    sizes = (starts[1:] - starts[:-1])[pick]
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    source = np.repeat(starts[pick] - ends[:-1], sizes)
    source += np.arange(ends[-1], dtype=np.int32)
    return codes[source], ends


class WordEncoder:
    """A ``tokenizers`` file with word ends (``</w>``) that drops white space.

    Nothing in such a tokenizer looks across a blank or a line feed, so each
    different blank-separated word of some texts is encoded once. A run of
    letters alone is a single unit to it, and so is a run of ASCII punctuation
    after one, so most words share few units. Units in one text are told apart
    by their last tokens, the only ones that end a word.
    """

    def __init__(self, data: bytes):
        self.data, self.engine = data, None
        self.kind = id_type(Tokenizer.from_buffer(data).get_vocab_size(with_added_tokens=True))

    def start(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.engine = Tokenizer.from_buffer(self.data)
        size = self.engine.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.engine.id_to_token(i) or "").endswith("</w>")
                              for i in range(size)])

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.engine.encode_batch_fast(words, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        return np.array([i for ids in found for i in ids], self.kind), ends

    def _units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ragged ids of words of letters alone, A-Z folded: those in ASCII first,
        which the model takes as they are."""
        plain = pc.string_is_ascii(words)
        model = self.engine.model
        found = [[t.id for t in model.tokenize(w)] for w in words.filter(plain).to_pylist()]
        ids = np.fromiter(itertools.chain.from_iterable(found), self.kind)
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        others = words.filter(pc.invert(plain)).to_pylist()
        if not others:
            return ids, ends
        more = np.array(self.engine.encode_batch_fast(
            [" ".join(others)], add_special_tokens=False)[0].ids, self.kind)
        stops = np.flatnonzero(self.ends[more]) + 1
        if len(stops) != len(others):  # letters that are not letters after folding
            more, stops = self._each(others)
            stops = stops[1:]
        return np.concatenate((ids, more)), np.concatenate((ends, stops + ends[-1])).astype(
            np.int32)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ragged ids of different words: of letters and then ASCII punctuation
        (two units, or one), or anything else (encoded as it is)."""
        core = pc.ascii_lower(pc.utf8_rtrim(words, characters=string.punctuation))
        letters = pc.utf8_is_alpha(core)
        # some letters turn into a letter and a mark, which joins the punctuation after it
        far = np.flatnonzero(pc.and_not(letters, pc.string_is_ascii(core)))
        if len(far):
            whole = letters.to_numpy(zero_copy_only=False).copy()
            whole[far] = [unicodedata.normalize("NFC", w).lower().isalpha()
                          for w in core.take(pa.array(far)).to_pylist()]
            letters = pa.array(whole)
        units = core.filter(letters).dictionary_encode()
        others = words.filter(pc.invert(letters)).to_pylist()
        plain = letters.to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(core).to_numpy()
        two = plain & (pc.binary_length(words).to_numpy() > sizes)
        tails = [w[n:] for w, n in zip(words.filter(pa.array(two)).cast(pa.binary()).to_pylist(),
                                       sizes[two].tolist(), strict=True)]
        tail_of = {t: i for i, t in enumerate(dict.fromkeys(tails))}
        codes, starts = self._units(units.dictionary)
        more, ends = self._each([t.decode() for t in tail_of] + others)
        codes, starts = np.concatenate((codes, more)), np.concatenate(
            (starts[:-1], ends + starts[-1])).astype(np.int32)
        # entries: units in ASCII, other units, tails, others
        first, n = len(units.dictionary), len(words)
        ascii_ = pc.string_is_ascii(units.dictionary).to_numpy(zero_copy_only=False)
        moved = np.where(ascii_, np.cumsum(ascii_), ascii_.sum() + np.cumsum(~ascii_)) - 1
        pick = np.empty(n, np.int64)
        pick[plain] = moved[units.indices.to_numpy()]
        pick[~plain] = first + len(tail_of) + np.arange(len(others))
        place = np.arange(n) + np.cumsum(two) - two
        both = np.empty(n + len(tails), np.int64)
        both[place] = pick
        both[place[two] + 1] = [first + tail_of[t] for t in tails]
        out, ends = gather(codes, starts, both)
        return out, ends[np.append(place, len(both))]

    def encode(self, texts: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ragged ids of the texts, each followed by ``last``; null has no others."""
        plain = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        cut = pc.split_pattern(plain, " ")
        words = cut.flatten().dictionary_encode()
        codes, starts = self._words(words.dictionary)
        codes = np.append(codes, np.array(last, self.kind))
        starts = np.append(starts, np.int32(len(codes)))
        offsets = cut.offsets.to_numpy()
        offsets = offsets - offsets[0]
        of_text = np.repeat(np.arange(len(cut)), np.diff(offsets))
        pick = np.full(len(of_text) + len(cut), len(starts) - 2)
        pick[np.arange(len(of_text)) + of_text] = words.indices.to_numpy()
        ids, ends = gather(codes, starts, pick)
        return ids, ends[np.append(0, offsets[1:] + np.arange(1, len(cut) + 1))]


class RankEncoder:
    """A ``tiktoken`` rank file."""

    def __init__(self, data: bytes, pattern: str):
        self.data, self.pattern, self.engine = data, pattern, None
        self.kind = id_type(len(data.splitlines()) + 1)

    def start(self) -> None:
        ranks = {base64.b64decode(a): int(b)
                 for a, b in map(bytes.split, self.data.splitlines()) if a}
        self.engine = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks,
                                        special_tokens={})

    def encode(self, texts: list[str | None], last: int) -> list[bytes]:
        end = np.array([last], self.kind).tobytes()
        return [np.array(self.engine.encode_ordinary(t or ""), self.kind).tobytes() + end
                for t in texts]


def id_type(ids: int) -> str:
    return "<u2" if ids <= 1 << 16 else "<u4"


def by_size(batch: pa.RecordBatch, column: int, most: int = 16 << 20):
    """Slices of a batch with at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
        yield batch.slice(at, n)
        at += n


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def on_workers(spark, encoder) -> Callable:
    """A function for workers that gives the started encoder."""
    shared = share(spark, encoder)

    def started():
        e = shared()
        if e.engine is None:
            e.start()
        return e

    return started
