"""Exact byte-level BPE encoding with a bounded memo.

The pre-tokenisation rule of the byte-level vocabularies never lets a piece reach from a non-blank
character over the blanks behind it, nor from letters to what is none, and looks one
character ahead at most. So a text may be cut into runs at such places, and the ids of
the text are the ids of the runs in order. Words repeat, so each run is handed to the
``tokenizers`` library once, as long as the worker remembers it.

A slice's texts are cut, and its runs numbered and replaced by their ids, as Arrow columns: only
runs that differ become Python objects.
"""

from __future__ import annotations

import json
import os
import re
import threading
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa

from .common import trim

#: Runs in one of a memo's two generations (some 200 bytes each).
MEMO_RUNS = 300_000
#: Seconds after which an idle worker gives its memo up.
REST_S = 3.0
#: Words that are encoded as one text: few enough that long texts do not slow the library down.
_JOINED = 100
#: Bytes of text to encode in one call: runs that come up twice in it are looked up once.
ENCODE_BYTES = 4_000_000
#: Longer texts are encoded slice by slice.
SLICE_CHARS = 4_000_000

#: Kinds of bytes. Other control characters and bytes of other characters are of none.
_BLANK, _FEED, _LETTER, _MARK, _QUOTE = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[32], _KIND[10], _KIND[39] = _BLANK, _FEED, _QUOTE
_KIND[[9, 13]] = _BLANK | _FEED
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
#: The pre-tokenisation that allows these cuts (with another one, whole texts are encoded), and how it spells each byte. The line feed, which words never have, parts them.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLING = np.zeros(256, "<u4")
_SPELLING[_SHOWN] = _SHOWN
_SPELLING[[b for b in range(256) if b not in _SHOWN]] = np.arange(256, 256 + 256 - len(_SHOWN))
_SPELLING[10] = 10
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[tuple[str, int], "RunEncoder"] = {}


def run_starts(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the runs of some texts begin. ``text``: their UTF-8 bytes one after another; ``ends``: 0 and where each text ends.

    A run ends before a blank, tab, carriage return or line feed after what is no blank; after a letter, before what is an ASCII character and no letter; before a letter after
    what is an ASCII character, no letter, blank or apostrophe; and after a line feed that is the only blank, before what is none. Letters are A to Z and U+00C0 to U+024F.
    """
    size = len(text)
    start = np.zeros(size + 1, bool)
    if not size:
        return np.zeros(0, np.int64)
    kind = np.frombuffer(bytearray(text).translate(_KIND.tobytes()), np.uint8)
    wide = np.flatnonzero(text >= 0x80)
    lead, tail = text[wide], text[np.minimum(wide + 1, size - 1)]
    pair = (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7))) & ~((lead == 0xC9) & (tail > 0x8F))
    first = wide[pair]
    kind[first] = kind[first + 1] = _LETTER
    before, now = kind[:-1], kind[1:]
    gap = (now & (_BLANK | _FEED)) != 0
    inner = start[1:size]
    inner |= gap & ((before & (_LETTER | _MARK | _QUOTE)) != 0)
    inner |= (before == _LETTER) & (now != _LETTER) & (text[1:] < 0x80)
    inner |= (before == _MARK) & (now == _LETTER)
    if len(wide):  # a blank after a character of another kind, unless that is a blank too
        at = wide[wide < size - 1] + 1
        at = at[gap[at - 1] & (before[at - 1] == 0)]
        b1, b2, b3 = text[at - 1], text[at - 2], text[at - 3]
        other = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        other |= (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF)) | (b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)
        other |= (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80) | (b3 == 0xE1) & ((b2 == 0x9A) & (b1 == 0x80) | (b2 == 0xA0) & (b1 == 0x8E))
        start[at[~other]] = True
    start[ends] = True
    feed = np.flatnonzero((before == _FEED) & start[: size - 1] & (now >= _LETTER))
    start[feed + 1] = True
    return np.flatnonzero(start[:size])


class RunEncoder:
    """Encodes texts to little-endian unsigned ids of ``width`` bytes each."""

    def __init__(self, path: str, memo: int = MEMO_RUNS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.limit = memo
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.timer: threading.Timer | None = None
        self.words, self.lengths = None, None
        rule = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        if self.tokenizer.normalizer is None and all(t.special for t in added) and _BYTE_LEVEL.items() <= rule.items():
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = CharDelimiterSplit("\n")
            self.lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.lengths[i] = len(token)
            trim()

    def rest(self) -> None:
        """To be called at a task's end: a worker that is not used again soon gives its memo up, so idle ones hold no memory."""
        self.timer = threading.Timer(REST_S, self._forget)
        self.timer.daemon = True
        self.timer.start()

    def _forget(self) -> None:
        self.old, self.new = {}, {}
        trim()

    def _look_up(self, runs: list[str]) -> list[bytes]:
        """The ids of each of some different runs. Those that the new generation has not are in it afterwards."""
        out = list(map(self.new.get, runs))
        gap = [i for i, v in enumerate(out) if v is None]
        if self.old and gap:
            get = self.old.get
            for i in gap:
                out[i] = get(runs[i])
            unknown = [i for i in gap if out[i] is None]
        else:
            unknown = gap
        for i, ids in zip(unknown, self._learn([runs[i] for i in unknown])):
            out[i] = ids
        self.new.update((runs[i], out[i]) for i in gap)
        if len(self.new) >= self.limit:  # a generation may hold one group of texts more
            self.old, self.new = self.new, {}
        return out

    def _learn(self, runs: list[str]) -> list[bytes]:
        """The ids of each run, by the library."""
        plain = [_WORD(r) is not None for r in runs]
        first, second = self._learn_words(list(compress(runs, plain))), self._whole([r for r, p in zip(runs, plain) if not p])
        return [next(first if p else second) for p in plain]

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        return (np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _learn_words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words that are one piece each. They are handed over as the vocabulary spells them, so the library need not look for pieces again."""
        for k in range(0, len(words), 1000 * _JOINED):
            some = words[k : k + 1000 * _JOINED]
            texts = ["\n".join(some[i : i + _JOINED]).encode() for i in range(0, len(some), _JOINED)]
            spelt = [_SPELLING[np.frombuffer(t, np.uint8)].tobytes().decode("utf-32-le") for t in texts]
            ids = np.concatenate([np.array(e.ids, np.int64) for e in self.words.encode_batch_fast(spelt, add_special_tokens=False)])
            # The ids' lengths in bytes say where each word ends.
            ends = np.cumsum(self.lengths[ids])
            stops = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in some])
            cuts = np.searchsorted(ends, stops)
            if ends[-1] != stops[-1] or not np.array_equal(ends[cuts], stops):
                raise AssertionError("ids do not end where words end")
            raw, at = ids.astype(self.dtype).tobytes(), 0
            for end in ((cuts + 1) * self.width).tolist():
                yield raw[at:end]
                at = end

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE_CHARS and (m := _BREAK.search(text, at + SLICE_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Give a few MB of text at a time; the runs of all are learnt at once."""
        if self.words is None:
            return list(self._whole(texts))
        out = []
        for text in texts if any(len(t) > SLICE_CHARS for t in texts) else ():
            out.append(b"".join(self._encode([s])[0] for s in self._slices(text)))
        return out or self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        if not len(column):
            return []
        ends = np.frombuffer(column.buffers()[1], np.int64, len(texts) + 1)
        data = column.buffers()[2]
        cuts = run_starts(np.frombuffer(data, np.uint8, int(ends[-1])), ends)
        if not len(cuts):
            return [b""] * len(texts)
        runs = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, ends[-1])), data).dictionary_encode()
        ids = self._look_up(runs.dictionary.to_numpy(zero_copy_only=False).tolist())
        all_ids = pa.array(ids, pa.large_binary()).take(runs.indices)
        _, bounds, raw = all_ids.buffers()
        bounds = np.frombuffer(bounds, np.int64, len(cuts) + 1)[np.searchsorted(cuts, ends)].tolist()
        raw = memoryview(raw or b"")
        return [bytes(raw[a:b]) for a, b in zip(bounds, bounds[1:])]


def encoder(path: str, memo: int = MEMO_RUNS) -> RunEncoder:
    """This worker's encoder for the vocabulary file."""
    key = (path, memo)
    if key not in _ENCODERS:
        _ENCODERS[key] = RunEncoder(path, memo)
    if _ENCODERS[key].timer:
        _ENCODERS[key].timer.cancel()
    return _ENCODERS[key]
