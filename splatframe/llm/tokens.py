"""Token ids of whole texts, the same as ``tokenizers`` gives by default for ``encode(text, add_special_tokens=False)``, with a distinct word encoded once while a worker remembers it.

Texts are cut and their parts are reduced to distinct ones, and these to distinct words, by Arrow's functions; only distinct words are looked up, or encoded, one by one, and
the ids of all parts are put together by place.

Two kinds of vocabulary files are known, by their normaliser, pre-tokeniser and model settings. Both never join characters across a single space or line break
between two characters that are no white space, so a text is cut there and the parts' ids are put together.
A text with other runs of white space is cut at such places only. Neither kind joins letters and punctuation, so
punctuation after a word of letters is encoded apart. Words of Latin-1 letters, which normalisation leaves as they are but for
their case, go to the library's BPE model directly; all other parts go through its whole pipeline. So do whole texts that hold the text of an added token,
such as ``<|endoftext|>``, and all texts with other kinds of files.

What a worker remembers is bounded in bytes, over all its memories.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of what a worker remembers of the parts and words met last: words, bare words where those begin with a space, punctuation, other parts, other first parts.
REMEMBERED = {"words": 96 << 20, "bare": 24 << 20, "marks": 8 << 20, "known": 24 << 20, "firsts": 8 << 20}
#: UTF-8 bytes of texts that callers should encode at once: many, so that parts repeat.
AT_ONCE = 4 << 20
#: What is longer isn't remembered.
LONGEST = 256
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Runs that only ``_CUT`` treats rightly: doubled and other white space.
_ODD = ("  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
#: Punctuation that may follow a word; an apostrophe may begin an ending, so it isn't here.
_MARKS = ".,;:!?\"#$%&()*+-/<=>@[\\]^_`{|}~"
#: The letters of Latin-1, and what begins a text's first part where that differs from the others.
_LATIN = "".join(c for c in map(chr, range(256)) if c.isalpha())
_FIRST = "\x02"


def is_odd(text: str) -> bool:
    """Whether it has white space that isn't a single space or line break between two other characters."""
    return text[:1].isspace() or text[-1:].isspace() or any(c in text for c in _ODD)


def cut_at_spaces(text: str) -> list[str]:
    """Parts of *text*, without the single space between two other characters that they start after; a line break in its place is kept."""
    if is_odd(text):
        return [p[1:] if n and p[0] == " " else p for n, p in enumerate(_CUT.split(text))]
    return text.replace("\n", " \n").split(" ")


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file *name* is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """What stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, letters from U+0100 on for the rest."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Remembered(dict):
    """What *make* gives for each key, made when asked for. Half of *size* bytes are at hand; when they are that many, those before them are forgotten."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        self._make, self._size, self._held, self._before = make, size // 2, 0, {}

    def __missing__(self, key: str) -> bytes:
        made = self._before.get(key)
        if made is None:
            made = self._make(key)
        if len(key) <= LONGEST:
            self._held += sys.getsizeof(key) + sys.getsizeof(made) + 100  # and its place in the dict
            if self._held >= self._size:
                self._before, self._held = dict(self), 0
                self.clear()
            self[key] = made
        return made

    def all(self, keys: list[str]) -> list[bytes]:
        return [self[k] if made is None else made for k, made in zip(keys, map(self.get, keys), strict=True)]


def _distinct(strings: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct strings, and which of them each is."""
    coded = strings.dictionary_encode()
    return _listed(coded.dictionary), coded.indices.to_numpy()


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _joined(ids: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """*ids* are runs of these *lengths*: the runs *which*, one after the other, and their lengths."""
    first, n = np.cumsum(lengths) - lengths, lengths[which]
    shift = first[which] - (np.cumsum(n) - n)
    return ids[np.arange(n.sum(), dtype=np.int64) + np.repeat(shift, n)], n


# Settings of the two kinds of files whose texts may be cut.
_BYTES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def kind_of(settings: dict) -> str | None:
    """``bytes`` or ``words`` for the two kinds of files, else None."""
    model = settings["model"]
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    if settings.get("truncation") or settings.get("padding") or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in settings["added_tokens"]):
        return None
    for kind, want, suffix in (("bytes", _BYTES, None), ("words", _WORDS, "</w>")):
        if all(settings.get(k) == v for k, v in want.items()) and (model.get("end_of_word_suffix") or None) == suffix:
            return kind
    return None


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers. ``largest`` is the vocabulary's largest id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self._tokenizer.to_str())
        kind = kind_of(settings)
        self._cuts, self._drops = kind is not None, kind == "words"
        self._added = [t["content"] for t in settings["added_tokens"]]
        self._encode = getattr(self._tokenizer, "encode_batch_fast", self._tokenizer.encode_batch)
        self._tokenize = self._tokenizer.model.tokenize
        self.largest = max(self._tokenizer.get_vocab().values(), default=0)
        self._bytes = [i.to_bytes(4, "little") for i in range(self.largest + 1)]
        self._letters = _byte_letters()
        self._break = self._whole("\n")
        # Words (after a space, unless the kind drops it), bare words, punctuation, other parts after a space or line break, other first parts.
        makes = {"words": self._word if self._drops else self._spaced_word, "bare": self._word, "marks": self._whole, "known": self._part, "firsts": self._first}
        self._words, self._bare, self._marks, self._known, self._firsts = (_Remembered(make, REMEMBERED[name]) for name, make in makes.items())
        if self._drops:
            self._bare = self._words

    def _whole(self, part: str) -> bytes:
        """Ids by the library's whole pipeline."""
        return b"".join([self._bytes[i] for i in self._encode([part], add_special_tokens=False)[0].ids])

    def _word(self, word: str, before: str = "") -> bytes:
        """Ids of a word of Latin-1 letters."""
        letters = word if word.isascii() else "".join(map(self._letters.__getitem__, word.encode()))
        return b"".join([self._bytes[t.id] for t in self._tokenize(before + letters)])

    def _spaced_word(self, word: str) -> bytes:
        return self._word(word, self._letters[32])

    def _first(self, part: str) -> bytes:
        """Ids of a part that starts after nothing."""
        bare = part.rstrip(_MARKS)
        if not bare.isalpha() or not (bare.isascii() or max(bare) <= "\xff"):
            return self._whole(part)
        ids = self._bare[bare.lower() if self._drops else bare]
        return ids if len(bare) == len(part) else ids + self._marks[part[len(bare) :]]

    def _part(self, part: str) -> bytes:
        """Ids of a part that starts after a space, or with a line break."""
        if self._drops:
            return self._first(part)
        bare = part.rstrip(_MARKS)
        if bare.isalpha() and (bare.isascii() or max(bare) <= "\xff"):
            ids = self._words[bare]
            return ids if len(bare) == len(part) else ids + self._marks[part[len(bare) :]]
        return self._break + self._first(part[1:]) if part[:1] == "\n" else self._whole(f" {part}")

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._cuts and _FIRST not in t and not any(a in t for a in self._added) for t in texts]
        parted = iter(self._encode_parts([t for t, c in zip(texts, cut, strict=True) if c]))
        return [next(parted) if c else self._whole(t) for t, c in zip(texts, cut, strict=True)]

    def _cut_texts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts, and how many each has. First parts begin with ``_FIRST`` where they differ from others."""
        if self._drops:
            lists = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
        else:
            odd = {n: cut_at_spaces(t) for n, t in enumerate(texts) if is_odd(t)}
            lists = pc.split_pattern(pa.array(["" if n in odd else _FIRST + t.replace("\n", " \n") for n, t in enumerate(texts)], pa.large_string()), " ")
            if odd:
                marked = pa.array([[_FIRST + first, *rest] for first, *rest in odd.values()], pa.list_(pa.large_string()))
                place = np.arange(len(texts))
                place[list(odd)] = len(texts) + np.arange(len(odd))
                lists = pa.concat_arrays([lists, marked]).take(pa.array(place))
        return lists.flatten(), pc.list_value_length(lists).to_numpy()

    def _encode_parts(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        parts, counts = self._cut_texts(texts)
        coded = parts.dictionary_encode()
        ids, lengths = _joined(*self._ids_of(coded.dictionary), coded.indices.to_numpy())
        data, ends = ids.tobytes(), 4 * np.r_[0, np.cumsum(lengths)][np.cumsum(counts)]
        return [data[start:end] for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _ids_of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct *parts*, one after the other, and how many each has."""
        bare = pc.utf8_rtrim(parts, characters=_MARKS)
        plain = pc.match_substring_regex(bare, f"^[{_LATIN}]+$")
        words, word = _distinct(pc.utf8_lower(bare.filter(plain)) if self._drops else bare.filter(plain))
        marks, mark = _distinct(pc.utf8_ltrim(parts.filter(plain), characters=_LATIN))
        others = _listed(parts.filter(pc.invert(plain)))
        made = [*self._words.all(words), *(self._marks[m] if m else b"" for m in marks), *(self._firsts[o[1:]] if o[:1] == _FIRST else self._known[o] for o in others), b""]
        lengths = np.fromiter(map(len, made), np.int64, len(made)) // 4
        plain, units = plain.to_numpy(zero_copy_only=False), np.full((len(parts), 2), len(made) - 1)  # a word and its punctuation
        units[plain, 0], units[plain, 1] = word, len(words) + mark
        units[~plain, 0] = len(words) + len(marks) + np.arange(len(others))
        ids, n = _joined(np.frombuffer(b"".join(made), "<u4"), lengths, units.ravel())
        return ids, n.reshape(-1, 2).sum(1)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file; it stays while the worker does."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
