"""Exact, cached encoding of whole texts with a public byte-pair tokenizer.

Both public BPE files split a text into pre-tokens that never reach over the end of a
run of non-white-space characters, so a text may be cut into pieces "white space, then
one run" and each piece encoded alone with the same ids as the whole text.  Distinct
pieces are encoded once per Python worker by the ``tokenizers`` library; pieces of a
batch are found and numbered by Arrow kernels, ids are gathered with numpy.

Nulls count as empty texts.  Nothing is truncated.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, as the tokenizers' pattern engine reads \s (fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: A text matching this has white space runs that only PIECES cuts rightly.
UNSAFE = f"[{WHITE}][ \n]|[ \n][{WHITE}]|^[ \n]|[ \n]$"
#: Entries of the piece cache before it starts anew; it bounds a worker's memory.
CACHE_PIECES = 1_200_000
#: Marks that end most words (fixed values).
MARKS = frozenset(",.")


def default_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + int(starts.max(initial=0)) < 2**31 else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def slices(batch: pa.RecordBatch, column: str, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and, unless a row alone is longer, ``size`` bytes of a text column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        end = min(batch.num_rows, at + rows, max(at + 1, fits))
        yield batch.slice(at, end - at)
        at = end


class PieceEncoder:
    """Encodes batches of texts; keeps the ids of the pieces that it has seen."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = json.loads(self.tokenizer.to_str())["added_tokens"]
        # strings that the library takes out of a text before anything else: texts holding one are encoded whole
        self.added = "|".join(re.escape(t["content"]) for t in added)
        one, *others = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("ab c", "AB C", " Ab\nc"))
        self.folds = all(x == one for x in others)  # neither case nor white space matters: more pieces are equal
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _grown(self, array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        out = np.zeros(max(size, 2 * len(array)), array.dtype)
        out[: len(array)] = array
        return out

    def _encoded(self, parts: list[str]) -> None:
        """Encodes distinct new strings and keeps their ids."""
        for at in range(0, len(parts), 8192):
            part = parts[at : at + 8192]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]  # without offsets
            flat = np.array(list(chain.from_iterable(got)), np.uint32)
            self._add(part, np.array(list(map(len, got)), np.int64), flat)

    def _add(self, part: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        first, n = len(self.known), len(part)
        self.ids = self._grown(self.ids, self.used + len(flat))
        self.starts = self._grown(self.starts, first + n)
        self.lengths = self._grown(self.lengths, first + n)
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + n] = lengths
        self.used += len(flat)
        self.known.update(zip(part, range(first, first + n)))

    def _learn(self, pieces: list[str]) -> None:
        """A word with one mark after it is two pre-tokens: its ids are the word's, then the mark's."""
        whole, pairs = {}, []
        for p in pieces:
            if p[-1:] in MARKS and p[-2:-1].lower().isalpha():
                pairs.append(p)
                p = p[:-1]
                whole[pairs[-1][-1]] = None
            whole[p] = None
        self._encoded([p for p in whole if p not in self.known])
        if pairs:
            known = self.known
            words = np.array([known[p[:-1]] for p in pairs], np.int64)
            marks = np.array([known[p[-1]] for p in pairs], np.int64)
            two = np.stack([words, marks], 1).ravel()
            flat = self.ids[ragged(self.starts[two], self.lengths[two])]
            self._add(pairs, self.lengths[words] + self.lengths[marks], flat)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of distinct or repeated pieces in the cache; new ones are encoded first."""
        out = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(missing := np.flatnonzero(out < 0)):
            new = [pieces[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(new)))
            out[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        return out

    def _own(self, found: pa.Array) -> list[str]:
        """Pieces as they stand in a text, of those of a marked text cut at spaces."""
        if self.folds:
            return pc.utf8_ltrim(found, "\n").to_numpy(zero_copy_only=False).tolist()
        space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        own = pc.binary_join_element_wise(space, found, none).to_numpy(zero_copy_only=False).tolist()
        for i in np.flatnonzero(pc.starts_with(found, "\n").to_numpy(zero_copy_only=False)).tolist():
            own[i] = own[i][3:] if own[i][:3] == " \n\n" else own[i][1:]
        return own

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one after the other (uint32), and each text's number of ids."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.known) > CACHE_PIECES:
            self.clear()
        apart = pc.match_substring_regex(texts, self.added, ignore_case=True) if self.added else pa.array(np.zeros(len(texts), bool))
        safe = pc.invert(pc.or_(apart, pc.match_substring_regex(texts, UNSAFE)))
        is_apart, is_safe = (x.to_numpy(zero_copy_only=False) for x in (apart, safe))
        n_pieces = np.zeros(len(texts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (rows, piece numbers)
        rows = np.flatnonzero(is_safe)
        if len(rows):
            given = pc.filter(texts, safe)
            if self.folds:  # ASCII letters only: all others are left to the library
                given = pc.ascii_lower(given)
            mark, none = pa.scalar("\n\n", pa.large_string()), pa.scalar("", pa.large_string())
            # each piece begins with its white space: "\n", or "\n\n" for none, or else a space
            marked = pc.binary_join_element_wise(mark, pc.replace_substring(given, "\n", " \n"), none)
            split = pc.split_pattern(marked, " ")
            coded = split.flatten().dictionary_encode()
            numbers = self._numbers(self._own(coded.dictionary))[coded.indices.to_numpy()]
            n_pieces[rows] = np.diff(split.offsets.to_numpy())
            parts.append((rows, numbers))
        rows = np.flatnonzero(~is_safe & ~is_apart)
        if len(rows):
            found = [PIECES.findall(t) for t in texts.take(pa.array(rows)).to_pylist()]
            n_pieces[rows] = [len(x) for x in found]
            parts.append((rows, self._numbers([p for x in found for p in x])))
        rows, kept = np.flatnonzero(is_apart), (len(self.known), self.used)
        if len(rows):  # whole texts are pieces for this batch only: the cache stays one of short pieces
            whole = texts.take(pa.array(rows)).to_pylist()
            self._encoded([t for t in dict.fromkeys(whole) if t not in self.known])
            n_pieces[rows] = 1
            parts.append((rows, np.array([self.known[t] for t in whole], np.int64)))
            while len(self.known) > kept[0]:
                self.known.popitem()
            self.used = kept[1]
        ends = np.cumsum(n_pieces)
        if len(parts) == 1:
            order = parts[0][1]
        else:
            order = np.zeros(int(ends[-1]), np.int64)
            for rows, numbers in parts:
                order[ragged((ends - n_pieces)[rows], n_pieces[rows])] = numbers
        lengths = self.lengths[order]
        ids = self.ids[ragged(self.starts[order], lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return ids, sums[ends] - sums[ends - n_pieces]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per file and Python worker, kept between tasks."""
    return PieceEncoder(path)
