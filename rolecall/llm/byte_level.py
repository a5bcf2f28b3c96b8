"""Ids of whole texts by byte-level BPE files: distinct chunks of a batch, and many words through the model in one call."""

from __future__ import annotations

import string
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINES_A_CALL = 512
LONGEST_CACHED = 64
SLICE_BYTES = 4 << 20
CHUNKS_A_GATHER = 1 << 17


def byte_letters() -> dict[str, str]:
    """How byte-level vocabularies write each character below U+0250, byte by byte of its UTF-8 form.

    Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = {b: 256 + place for place, b in enumerate(sorted(set(range(256)) - shown))}
    return {chr(c): "".join(chr(hidden.get(b, b)) for b in chr(c).encode("utf-8")) for c in range(0x250)}


class Recent:
    """Values of at most ``size`` keys or those of one batch: when half are new, the older half goes.

    What a batch uses moves to the newer half, so that the many keys seen once never push out the
    common ones.
    """

    def __init__(self, size: int) -> None:
        self.half = size // 2
        self.new: dict = {}
        self.old: dict = {}

    def hold(self, keys: set, unseen: set, make: Callable[[list], Iterable[bytes]]) -> None:
        """Bring all ``keys`` of a batch into the newer half; ``unseen`` are those not in it."""
        if len(self.new) + len(unseen) > self.half:
            self.old, self.new, unseen = self.new, {}, keys
        found = unseen & self.old.keys()
        self.new.update((k, self.old[k]) for k in found)
        rest = list(unseen - found)
        self.new.update(zip(rest, make(rest), strict=True))


class DistinctIds:
    """Ids of whole texts by way of the distinct chunks of a batch; only these leave Arrow and numpy.

    Chunks start at ASCII white space and at a sign behind an ASCII letter. Subclasses say what the ids of new
    chunks are (``_learn``) and how unusual texts split (``_unusual``). Ids of short chunks are kept, up to a
    bound; common ones outlive rare ones.
    """

    def __init__(self, cached: int) -> None:
        self.chunks = Recent(cached)
        self.blank, self.sign, self.ascii_letter = (
            np.isin(np.arange(256), list(some.encode())) for some in (" \t\n\r\x0b\x0c", string.punctuation, string.ascii_letters)
        )

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk, as little-endian 32-bit numbers."""
        raise NotImplementedError

    def _unusual(self, text: str) -> list[str] | None:
        """Chunks of a text that must not split as others do."""
        raise NotImplementedError

    def _suspects(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows whose bytes leave open whether they are unusual; the others are never made into strings."""
        return np.arange(len(bounds) - 1)

    def _known(self, distinct: list[bytes]) -> list[bytes]:
        long = [c for c in distinct if len(c) > LONGEST_CACHED]
        once = dict(zip(long, self._learn(long), strict=True))
        short = set(distinct).difference(long) if long else set(distinct)
        self.chunks.hold(short, short.difference(self.chunks.new), self._learn)
        known = self.chunks.new
        return [once[c] if len(c) > LONGEST_CACHED else known[c] for c in distinct]

    def _starts(self, texts: pa.StringArray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where chunks start in the bytes of the texts, which lie between ``bounds``."""
        blank = self.blank[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = (blank[1:] & ~blank[:-1]) | (self.sign[data[1:]] & self.ascii_letter[data[:-1]])
        begins[bounds] = True
        for row in self._suspects(data, bounds).tolist():
            if chunks := self._unusual(texts[row].as_py()):
                begins[bounds[row] + 1 : bounds[row + 1]] = False
                begins[bounds[row] + np.cumsum([0] + [len(c.encode("utf-8")) for c in chunks[:-1]])] = True
        return np.flatnonzero(begins[:-1])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        bounds = offsets.astype(np.int64) - int(offsets[0])
        if not bounds[-1]:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        buffer = texts.buffers()[2].slice(int(offsets[0]), int(bounds[-1]))
        starts = self._starts(texts, np.frombuffer(buffer, np.uint8), bounds)
        places = pa.py_buffer(np.append(starts, bounds[-1]).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, places, buffer]).dictionary_encode()
        known = self._known(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, first = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        gathered = [np.empty(0, "<u4")]
        for at in range(0, len(codes), CHUNKS_A_GATHER):
            some = each[at : at + CHUNKS_A_GATHER]
            before = np.cumsum(some) - some
            gathered.append(ids[np.arange(int(some.sum())) + np.repeat(first[codes[at : at + CHUNKS_A_GATHER]] - before, some)])
        ends = np.append(0, np.cumsum(each))
        del coded
        pa.default_memory_pool().release_unused()
        return np.concatenate(gathered), np.diff(ends[np.searchsorted(starts, bounds)])


def byte_slices(texts: pa.StringArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive rows ``(from, to)`` of about ``size`` bytes; a longer text stands alone."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, int(offsets[row]) + size, "right")) - 1)
        yield row, to
        row = to


class LineModel:
    """The model alone, without what the file does to a text before it; each line of its input is one word."""

    def __init__(self, tokenizer) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")

    def encode(self, entries: list[str]) -> list[bytes]:
        """Ids of each entry, which is one or more lines, as little-endian 32-bit numbers."""
        if not entries:
            return []
        ids, sizes = [], []
        for at in range(0, len(entries), LINES_A_CALL):
            whole = "\n".join(entries[at : at + LINES_A_CALL])
            encoded = self.model.encode(whole, add_special_tokens=False)
            ids.append(np.array(encoded.ids, "<u4"))
            # the library says which line each id is from
            sizes.append(np.bincount(encoded.word_ids, minlength=whole.count("\n") + 1))
        per_line = np.append(0, np.cumsum(np.concatenate(sizes)))
        ends = 4 * per_line[np.cumsum([entry.count("\n") + 1 for entry in entries])]
        data = np.concatenate(ids).tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
