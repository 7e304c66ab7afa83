"""Encoding of texts to ids with a public tokenizer, through a bounded cache of words."""

from __future__ import annotations

import json
import re

import numpy as np

from .common import hash_ranges, worker_state

#: White space that only one of Python and the tokenizer may take as such: texts with it are encoded whole.
_ODD_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\r")
#: ASCII signs but the apostrophe: a run of them behind a word is a pre-token of its own.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters beyond ASCII that no normaliser composes.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: The pre-tokens of the kind of vocabulary that is encoded word by word.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of each of the two generations of a cache, and of a table.
_CACHE, _TABLE = 100_000, 600_000
#: Bytes of text that are looked up at a time.
_PIECE = 4 << 20
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)
#: Kinds of bytes: white space, ASCII letters, the first and second bytes of the letters of _LATIN, signs; 0 for all others.
_SPACE_BYTE, _LETTER_BYTE, _LEAD_BYTE, _TAIL_BYTE, _SIGN_BYTE = range(1, 6)
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \t\n\r")] = _SPACE_BYTE
_KINDS[[c for c in range(128) if chr(c).isalpha()]] = _LETTER_BYTE
_KINDS[0xC3] = _LEAD_BYTE
_KINDS[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = _TAIL_BYTE
_KINDS[list(_SIGNS.encode())] = _SIGN_BYTE


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCache(dict):
    """Words, as split at white space, to their ids' bytes.

    Two generations bound it: what was in use when the younger one filled up is taken
    along when it is used again, and everything else goes when it fills up once more.
    """

    def __init__(self, tokenizer, dtype: str):
        super().__init__()
        self.tokenizer, self.dtype, self.older = tokenizer, dtype, {}
        self.pieces = tokenizer.model.tokenize
        self.letters = _byte_letters()
        ids = np.arange(tokenizer.get_vocab_size()).astype(dtype)
        self.of = [ids[i : i + 1].tobytes() for i in range(len(ids))]

    def _part(self, text: str) -> bytes:
        """Ids of one pre-token in lower case."""
        letters = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        of = self.of
        return b"".join([of[p.id] for p in self.pieces(letters)])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            letters = word.rstrip(_SIGNS)
            if not letters:
                out = self._part(word)
            elif not letters.isalpha() or not (letters.isascii() or _LATIN.fullmatch(letters)):
                out = self.whole(word)
            elif letters == word and word.islower():
                out = self._part(word)
            else:
                out = self[letters.lower()]
                if letters != word:
                    out += self[word[len(letters) :]]
        if len(self) >= _CACHE:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out


def _units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, in lower case where words are plain (letters, then signs); starts and stops of units; and which are of plain words."""
    kind = _KINDS[raw]
    before, behind = np.concatenate([[_SPACE_BYTE], kind[:-1]]), np.concatenate([kind[1:], [_SPACE_BYTE]])
    letter = (kind == _LETTER_BYTE) | (kind == _LEAD_BYTE) & (behind == _TAIL_BYTE) | (kind == _TAIL_BYTE) & (before == _LEAD_BYTE)
    sign, space = kind == _SIGN_BYTE, kind == _SPACE_BYTE
    turn = sign & np.concatenate([letter[1:], [False]])  # a letter behind a sign
    start, stop = np.flatnonzero(~space & (before == _SPACE_BYTE)), np.flatnonzero(~space & (behind == _SPACE_BYTE)) + 1
    sums = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(~(letter | sign | space) | turn, out=sums[1:])
    plain = sums[stop] == sums[start]
    among = np.zeros(len(raw) + 1, np.int8)
    among[start[plain]] += 1
    among[stop[plain]] -= 1
    among = np.cumsum(among[:-1], dtype=np.int8).astype(bool)
    split = among & sign & np.concatenate([[False], letter[:-1]])  # signs behind letters are a unit of their own
    first, last = ~space & (before == _SPACE_BYTE) | split, ~space & (behind == _SPACE_BYTE) | np.concatenate([split[1:], [False]])
    start = np.flatnonzero(first)
    return np.where(among, _LOWER[raw], raw), start, np.flatnonzero(last) + 1, among[start]


class WordTable:
    """Ids of words by two 64-bit hashes of them, in flat arrays: some 40 bytes a word, where a dictionary takes four times that."""

    def __init__(self, words: int, dtype: np.dtype):
        slots = 1 << (words * 5 // 3).bit_length()
        self.mask, self.limit, self.words = np.uint64(slots - 1), words, 0
        self.key, self.check = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32)
        self.first, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.ids, self.used = np.zeros(1024, dtype), 1  # the first is the end id's place

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each word, or -1."""
        out = np.full(len(key), -1)
        at, slot = np.arange(len(key)), (key & self.mask).astype(np.int64)
        while len(at):
            held = self.key[slot]
            found = (held == key[at]) & (self.check[slot] == check[at])
            out[at[found]] = slot[found]
            on = ~found & (held != 0)
            at, slot = at[on], slot[on] + 1 & int(self.mask)
        return out

    def add(self, key: np.ndarray, check: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Distinct words that aren't there, with the number of ids of each, and all ids."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.ids.dtype)])
        first = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.words += len(key)
        at, slot = np.arange(len(key)), (key & self.mask).astype(np.int64)
        while len(at):
            free = self.key[slot] == 0
            self.key[slot[free]] = key[at[free]]
            won = free & (self.key[slot] == key[at])
            # Of words that wanted one slot, the one of this key has it; equal keys go one after another.
            won[won] = np.isin(np.flatnonzero(won), np.flatnonzero(won)[np.unique(slot[won], return_index=True)[1]])
            self.check[slot[won]], self.first[slot[won]], self.size[slot[won]] = check[at[won]], first[at[won]], sizes[at[won]]
            at, slot = at[~won], slot[~won] + 1 & int(self.mask)

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all of them; slot -1 stands for the end id."""
        sizes, first = np.where(slots < 0, 1, self.size[slots]), np.where(slots < 0, 0, self.first[slots])
        total = np.cumsum(sizes)
        places = np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - sizes), sizes)
        return sizes, self.ids[places]


class Encoder:
    """Ids of texts, equal to the library's own for a lower-casing word-end BPE that splits at white space.

    Words are encoded by the library once and kept in a bounded cache; a text with
    unusual white space is given to the library whole. For other kinds of tokenizers
    every text is given to the library whole.
    """

    def __init__(self, path: str, dtype: str = "<u4"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.size = tokenizer.get_vocab_size()
        self.dtype = np.dtype(dtype)
        self.cache = WordCache(tokenizer, dtype)
        self.by_word = self._splits_at_space(tokenizer)
        self.young, self.old = WordTable(_TABLE, self.dtype), WordTable(1, self.dtype)

    @staticmethod
    def _splits_at_space(tokenizer) -> bool:
        """Whether words can be encoded one by one: what normaliser, pre-tokenizer and model do is checked, not their kinds alone."""
        spec = json.loads(tokenizer.to_str())
        normal, pre, model = ((spec.get(k) or {}) for k in ("normalizer", "pre_tokenizer", "model"))
        return (
            [x if x["type"] == "Replace" else x["type"] for x in normal.get("normalizers", [])] == ["NFC", {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, "Lowercase"]
            and [{k: v for k, v in x.items() if k != "trim_offsets"} for x in pre.get("pretokenizers", [])]
            == [{"type": "Split", "pattern": {"Regex": _PRE_TOKENS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
            and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout"), model.get("continuing_subword_prefix")) == ("BPE", "</w>", None, None)
        )

    def encode(self, text: str | None) -> bytes:
        """The ids' little-endian bytes; none for a null or empty text."""
        if not text:
            return b""
        if not self.by_word or any(c in text for c in _ODD_SPACE):
            return self.cache.whole(text)
        return b"".join(map(self.cache.__getitem__, text.split()))

    def encode_all(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, each with the end id behind it, and the places where they end."""
        data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        if not self.by_word or sum(map(len, data)) > _PIECE or any(c in t for t in texts if t for c in _ODD_SPACE):
            end = np.array([end_id], self.dtype).tobytes()
            plain = [self.by_word and not any(c in (t or "") for c in _ODD_SPACE) for t in texts]
            parts = [self._pieces(d) if p else self.encode(t) for t, d, p in zip(texts, data, plain, strict=True)]
            return np.frombuffer(end.join([*parts, b""]), self.dtype), np.cumsum([len(d) // self.dtype.itemsize + 1 for d in parts])
        joined = b" ".join(data)
        slots, start = self._slots(joined)
        stops = np.searchsorted(start, np.cumsum([len(d) + 1 for d in data]) - 1)
        self.young.ids[0] = end_id
        sizes, ids = self.young.gather(np.insert(slots, stops, -1))
        return ids, np.cumsum(sizes)[stops + np.arange(len(stops))]

    def _pieces(self, data: bytes) -> bytes:
        """Ids of one text, however long, cut into pieces at white space."""
        out, at = [], 0
        while at < len(data):
            stop = len(data)
            if stop - at > _PIECE:
                found = max(data.rfind(c, at, at + _PIECE) for c in (b" ", b"\n", b"\t", b"\r"))
                later = [x for x in (data.find(c, at) for c in (b" ", b"\n", b"\t", b"\r")) if x >= 0]
                stop = found + 1 if found >= at else min(later, default=stop - 1) + 1
            if stop - at > 2 * _PIECE:  # one word of that size
                out.append(self.cache.whole(data[at:stop].decode("utf-8", "surrogatepass")))
            else:
                slots, _ = self._slots(data[at:stop])
                out.append(self.young.gather(slots)[1].tobytes())
            at = stop
        return b"".join(out)

    def _slots(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the younger table holds the units of some bytes, all of which it does then; and where they start.

        Units are words apart by white space; words of letters and signs behind them are two,
        in lower case, so that forms of one word share an entry.
        """
        raw = np.frombuffer(data, np.uint8)
        letters, start, stop, plain = _units(raw)
        key, check = hash_ranges(letters, start, stop, 2)
        key, check = np.maximum(key, 1), (check >> np.uint64(32)).astype(np.uint32) ^ plain  # a word in capitals that isn't plain is another
        slots = self.young.find(key, check)
        lost = np.flatnonzero(slots < 0)
        if not len(lost):
            return slots, start
        older = [self.old]
        _, one = np.unique(key[lost] ^ check[lost], return_index=True)
        if self.young.words + len(one) > self.young.limit:
            older, self.old = [self.young, self.old], self.young
            lost = np.arange(len(key))
            _, one = np.unique(key ^ check, return_index=True)
            self.young = WordTable(max(_TABLE, len(one)), self.dtype)
        new = lost[one]
        for table in older:
            there = table.find(key[new], check[new])
            known = new[there >= 0]
            sizes, ids = table.gather(there[there >= 0])
            self.young.add(key[known], check[known], sizes, ids)
            new = new[there < 0]
        whole, part, text = self.cache.whole, self.cache._part, letters.tobytes()
        words = [text[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[new].tolist(), stop[new].tolist(), strict=True)]
        values = [(part(w) if w.isascii() else part(w.lower())) if p else whole(w) for w, p in zip(words, plain[new].tolist(), strict=True)]
        self.young.add(key[new], check[new], np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize, np.frombuffer(b"".join(values), self.dtype))
        return self.young.find(key, check), start

    def ends(self, marks: str = ".!?") -> np.ndarray:
        """For each id, whether its piece ends a sentence."""
        out = np.zeros(self.size, bool)
        for piece, i in self.cache.tokenizer.get_vocab().items():
            out[i] = piece.removesuffix("</w>")[-1:] in tuple(marks)
        return out


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One encoder for each Python worker; workers live on between tasks, and so does the cache."""
    return worker_state(("encoder", path, dtype), lambda: Encoder(path, dtype))
