"""Texts to ids with the tokenizers library, a text's parts being encoded once each.

Both vocabulary files split a text before white space and between a letter or digit and a comma or full stop before they
merge anything, so a text's ids are those of such parts, one after another. Letters that normalization turns into a letter
and a mark are not split from what follows, as the mark belongs to it. Ids are looked up for what stands between two
spaces first, then for its parts. Texts with a space between white space, with special tokens, or with rare control
characters, on which libraries differ about what white space is, take slower ways: by parts alone, or encoded whole. New
words are encoded many in one text.

For byte-level vocabularies what stands between spaces, if it has ASCII and Latin letters only and no apostrophe, is cut
on arrays where the library's own pattern cuts; such parts are looked up, and new ones go straight to the library's model.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from beamframe.llm.textbatch import utf8

#: Words that each Python worker keeps for reuse: so many that were met again, and as many that were met once.
CACHE = 500_000
#: Spans of parts kept for reuse; beyond it only those of the texts at hand are kept.
SPANS = 800_000
#: Letters and digits whose normal form in lower case is not one letter or digit.
_LOOSE = "".join(c for c in map(chr, [*range(128, 0xD800), *range(0xE000, 0x30000)]) if c.isalnum() and not unicodedata.normalize("NFC", c).lower()[-1].isalnum())
_PART = re.compile(rf"\s*[^\W_]++(?<=[^\W_{_LOOSE}])(?=[,.])|(?<=[^\W_{_LOOSE}])[,.]+(?!\S)|\s*\S+|\s+")
#: A space between white space (or at the end after such): the space before it need not begin a part.
_LOOSE_SPACE = re.compile(r"\s \s|\s \Z")
_APART = re.compile(r"\s\s*\S")
_ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b]")
_SPACE = "".join(c for c in map(chr, range(0x10000)) if c.isspace())
#: For Arrow, which knows fewer kinds of white space: odd characters, and a space between white space or at the end after such.
_ODD_ARROW, _LOOSE_ARROW = "[\x1c-\x1f\x85\u180e\u200b]", rf"[{_SPACE}] (?:[{_SPACE}]|\z)"
#: Letters that are letters in all versions of Unicode, and the pattern of byte-level vocabularies for texts of such, ASCII digits, marks and white space.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(rf"[{_LATIN} -~\n\t\r]*")
_BYTE_PART = re.compile(rf"'(?:[stmd]|ll|ve|re)| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_BYTE_PARTS_ALONE = re.compile(rf"'(?:[stmd]|ll|ve|re)| ?[{_LATIN}]+| ?[0-9]+| ?[!-/:-@\[-`{{-~]+|[ \n\t\r]+")
#: Kinds of bytes: 0 space, 1 other white space, 2 letters (with all bytes of longer characters), 3 digits, 4 others.
_KIND = np.array([0 if b == 32 else 1 if 9 <= b <= 13 else 2 if b >= 128 or chr(b).isalpha() else 3 if chr(b).isdigit() else 4 for b in range(256)], np.uint8)
#: Apostrophes, and bytes that begin characters other than ASCII and U+00C0 to U+023F.
_NOT_PLAIN = np.array([b == 39 or b == 0xC2 or b >= 0xC9 for b in range(256)])
#: Plain characters as byte-level vocabularies write their bytes.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAME = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_BYTE_NAMES = {c: "".join(_BYTE_NAME[b] for b in chr(c).encode()) for c in range(0x250)}
_LOADED: dict = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _trim(known: dict, used: set[str], most: int) -> None:
    if len(known) > most:
        kept = {u: known[u] for u in used if u in known}
        known.clear()
        known.update(kept)


class Kept:
    """What words were turned into, for reuse. Most words are rare: those met again and those met once are kept apart, up to `most` of each, and words met once go oldest first."""

    def __init__(self, most: int):
        self.again: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}
        self.most = most

    def get(self, words: list[str]) -> list[bytes | None]:
        """The values of words that differ; None where one is not known."""
        values = list(map(self.again.get, words))
        missing = [k for k, v in enumerate(values) if v is None]
        names = [words[k] for k in missing]
        for k, w, v in zip(missing, names, map(self.once.pop, names, repeat(None))):
            if v is not None:
                self.again[w] = values[k] = v
        return values

    def find(self, words: list[str]) -> dict[str, bytes]:
        """Those of the words, which differ, that are known."""
        return {w: v for w, v in zip(words, self.get(words)) if v is not None}

    def add(self, made: dict[str, bytes] | Iterable[tuple[str, bytes]]) -> None:
        if len(self.again) > self.most:  # those still in use come back when they are met
            self.again, self.once = {}, self.again | self.once
        self.once.update(made)
        if len(self.once) > self.most:
            for w in list(islice(self.once, len(self.once) - self.most * 3 // 4)):
                del self.once[w]

    def __len__(self) -> int:
        return len(self.again) + len(self.once)


def _cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the parts of units begin, each unit (bytes between two offsets) being a space and what stands before the next. White space before something else leaves its last character by itself; units that are not plain stay whole."""
    kind, n = _KIND[data], len(data)
    blank = kind < 2
    own, after = np.zeros(n, bool), np.zeros(n, bool)
    own[1:] = (kind[1:] != kind[:-1]) & ~(blank[1:] & blank[:-1]) & (kind[:-1] != 0)
    after[:-1] = ~blank[1:]
    after[offsets[1:] - 1] = False
    own[1:] |= blank[1:] & blank[:-1] & after[1:]
    bad = _NOT_PLAIN[data]
    bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    counted = np.r_[0, np.cumsum(bad)][offsets]
    own &= ~np.repeat(counted[1:] > counted[:-1], np.diff(offsets))
    own[offsets[:-1]] = True
    return np.flatnonzero(own)


class Encoder:
    """encode(texts) -> one array of ids for each text. One object for each vocabulary file and worker: Encoder.of(path)."""

    def __init__(self, path: str, most: int = CACHE):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids, self.pieces = Kept(most), Kept(most)
        names = sorted((i, t) for t, i in self.tokenizer.get_vocab().items())
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.at_end = bool(suffix)
        model, by = self.tokenizer.model, self.tokenizer.pre_tokenizer
        bare = isinstance(model, BPE) and not (suffix or model.dropout or model.continuing_subword_prefix) and self.tokenizer.normalizer is None
        #: The model's own call, where it may be given plain parts.
        self.model = model.tokenize if bare and isinstance(by, ByteLevel) and by.use_regex and not by.add_prefix_space else None
        self.odd = "|".join([_ODD_ARROW, *map(re.escape, self.special)])
        #: By id: whether the token ends a word (vocabularies with a suffix for that) or begins one after a space.
        self.edge = np.zeros(names[-1][0] + 1, bool)
        self.edge[[i for i, t in names if (t.endswith(suffix) if suffix else t.startswith("\u0120"))]] = True
        self.spans: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, path: str, most: int = CACHE) -> Encoder:
        if path not in _LOADED:
            _LOADED[path] = cls(path, most)
        return _LOADED[path]

    @staticmethod
    def give_back(path: str) -> None:
        """Drop the worker's object for a file with all that it keeps; the next use loads it again."""
        _LOADED.pop(path, None)

    def _whole(self, texts: list[str]):
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of parts that are encoded by themselves; plain ones go to the model."""
        plain = [self.model is not None and _BYTE_PARTS_ALONE.fullmatch(q) is not None for q in parts]
        modelled = self._modelled([q for q, p in zip(parts, plain) if p])
        other = [q for q, p in zip(parts, plain) if not p]
        rest = iter(self._bytes(other) if other else ())
        return (next(modelled if p else rest) for p in plain)

    def _made(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of parts that `_cut` made: plain ones, and whole units that are cut here."""
        plain = [_BYTE_PARTS_ALONE.fullmatch(q) is not None for q in parts]
        modelled = self._modelled([q for q, p in zip(parts, plain) if p])
        rest = iter(self._learn([q for q, p in zip(parts, plain) if not p], {}))
        return (next(modelled if p else rest) for p in plain)

    def _modelled(self, parts: list[str]) -> Iterator[bytes]:
        """The model's ids of plain parts."""
        for at in range(0, len(parts), 8192):
            tokens = [self.model(q.translate(_BYTE_NAMES)) for q in parts[at : at + 8192]]
            raw = np.array([t.id for t in chain.from_iterable(tokens)], "<u4").tobytes()
            ends = (4 * np.cumsum([len(t) for t in tokens])).tolist()
            yield from (raw[a:b] for a, b in zip([0, *ends], ends))

    def _split(self, text: str) -> list[str]:
        """Parts that may be encoded by themselves."""
        return (_BYTE_PART if self.model and (text.isascii() or _PLAIN.fullmatch(text)) else _PART).findall(text)

    def _odd(self, text: str) -> bool:
        return any(x in text for x in self.special) or _ODD.search(text) is not None

    def _parts(self, texts: list[str], known: dict) -> tuple[list, list[str], list[str]]:
        """The parts of each text (None: to be encoded whole); of those that are not known, the ones that can stand in one text and the others."""
        parts = [None if self._odd(x) else _PART.findall(x) for x in texts]
        distinct: set[str] = set()
        for p in parts:
            distinct.update(p or ())
        _trim(known, distinct, SPANS)
        missing = [u for u in distinct if u not in known]
        joined = [u for u in missing if _APART.match(u) and "\x01" not in u]
        return parts, joined, list(set(missing).difference(joined))

    def _joined(self, units: list[str]):
        """(unit, ids, token spans in it) of units that begin with white space, encoded as one text."""
        for at in range(0, len(units), 4096):
            own = units[at : at + 4096]
            found = self._whole(["".join(own)])[0]
            spans = np.array(found.offsets, np.int32).reshape(-1, 2)
            ends = np.cumsum([len(u) for u in own])
            cuts = [0, *np.searchsorted(spans[:, 1], ends, "right").tolist()]
            ids = np.array(found.ids, "<u4").tobytes()
            starts = [0, *ends.tolist()]
            for k, u in enumerate(own):
                a, b = cuts[k], cuts[k + 1]
                yield u, ids[4 * a : 4 * b], spans[a:b] - starts[k]

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word of letters with a space before it: the words of one text, told apart by tokens that only begin or only end words."""
        for at in range(0, len(words), 8192):
            own = words[at : at + 8192]
            ids = self._bytes([" " + " ".join(own)])[0]
            mark = self.edge[np.frombuffer(ids, "<u4")]
            ends = np.flatnonzero(mark if self.at_end else np.r_[mark[1:], True]) + 1
            if len(ends) != len(own):  # letters of which libraries know different ones
                yield from self._bytes([" " + w for w in own])
                continue
            ends = (4 * ends).tolist()
            yield from (ids[a:b] for a, b in zip([0, *ends], ends))

    def _learn(self, texts: list[str], made: dict[str, bytes]) -> list[bytes]:
        """The ids of texts by their parts. Words of letters after a space are those made, or kept in `pieces`; other parts are kept in `ids`."""
        parts = list(map(self._split, texts))
        distinct = set(chain.from_iterable(parts))
        words = [q[1:] for q in distinct if q[0] == " " and q[1:].isalpha() and not (self.model and _BYTE_PARTS_ALONE.fullmatch(q))]
        ids = {" " + w: made[w] for w in words if w in made}
        words = [w for w in words if w not in made]
        ids.update(zip([" " + w for w in words], self._known(words, self.pieces, self._words), strict=True))
        rest = [q for q in distinct if q not in ids]
        ids.update(zip(rest, self._known(rest, self.ids, self._alone), strict=True))
        return [b"".join(map(ids.__getitem__, p)) for p in parts]

    def _known(self, words: list[str], kept: Kept, make: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
        """The values of words that differ, from those kept or else made and kept."""
        values = kept.get(words)
        missing = [k for k, v in enumerate(values) if v is None]
        if missing:
            new = [words[k] for k in missing]
            made = list(make(new))
            kept.add(zip(new, made, strict=True))
            for k, v in zip(missing, made, strict=True):
                values[k] = v
        return values

    def _after_space(self, units: list[str]) -> list[bytes]:
        """The ids of units with a space before each."""
        words = [u for u in units if u.isalpha()]
        made = dict(zip(words, self._words(words), strict=True))
        rest = [u for u in units if u not in made]
        made.update(zip(rest, self._learn([" " + u for u in rest], made), strict=True))
        return list(map(made.__getitem__, units))

    def _units(self, units: pa.Array) -> pa.Array:
        """The ids of units with a space before each, looked up as they are."""
        return pa.array(self._known(units.to_numpy(zero_copy_only=False).tolist(), self.pieces, self._after_space), pa.large_binary())

    def _cut_units(self, units: pa.Array) -> pa.Array:
        """The ids of units with a space before each, looked up by parts."""
        none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        data, offsets = utf8(pc.binary_join_element_wise(none, units, space))
        starts = _cut(data, offsets)
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(data)]), pa.py_buffer(data))
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self._known(names, self.ids, self._made), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(starts, offsets)]
        return pa.Array.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(ends), ids.buffers()[2]])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. A null in an array of strings is an empty text."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts.cast(pa.large_string()), "") if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(texts, self.odd)
        apart = pc.or_(odd, pc.match_substring_regex(texts, _LOOSE_ARROW))
        split = pc.split_pattern(pc.if_else(apart, "", texts), " ")
        coded = split.flatten().dictionary_encode()
        ids = (self._cut_units if self.model else self._units)(coded.dictionary).take(coded.indices)
        ends, raw = np.frombuffer(ids.buffers()[1], np.int64), memoryview(ids.buffers()[2] or b"")
        first = split.offsets.to_numpy()
        starts, stops = ends[first[:-1] + 1].tolist(), ends[first[1:]].tolist()
        heads = coded.take(first[:-1]).dictionary_decode().to_numpy(zero_copy_only=False).tolist()  # a text's first unit has no space before it
        whole: dict[int, bytes] = {}
        for k in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
            heads[k] = "" if odd[k].as_py() else texts[k].as_py()
            if odd[k].as_py():
                whole[k] = self._bytes([texts[k].as_py()])[0]
        rest = self._learn(heads, {})
        return [whole[k] if k in whole else r + bytes(raw[a:b]) for k, (r, a, b) in enumerate(zip(rest, starts, stops, strict=True))]

    def offsets(self, texts: list[str]) -> list[np.ndarray]:
        """The character spans of each text's tokens, as an array of (start, end)."""
        known = self.spans
        parts, joined, others = self._parts(texts, known)
        for u, _, spans in self._joined(joined):
            known[u] = spans.copy()
        for u, e in zip(others, self._whole(others) if others else (), strict=True):
            known[u] = np.array(e.offsets, np.int32).reshape(-1, 2)
        out = []
        for x, p in zip(texts, parts, strict=True):
            if p is None:
                out.append(np.array(self._whole([x])[0].offsets, np.int64).reshape(-1, 2))
            elif not p:
                out.append(np.zeros((0, 2), np.int64))
            else:
                spans = [known[u] for u in p]
                at = np.cumsum([0, *map(len, p[:-1])])
                out.append(np.concatenate(spans) + np.repeat(at, [len(s) for s in spans])[:, None])
        return out
