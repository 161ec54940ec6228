"""Token encoders that work piece by piece, with a cache of bounded size. Vocabularies are files named by parameters."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that the cache of a worker holds before it starts anew, and the longest piece it keeps.
CACHE_PIECES, CACHE_CHARS = 400_000, 48


#: The rules of a tokenizers file by which a text's tokens are those of its pieces in turn.
_BY_PIECE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _by_piece(path: str) -> bool:
    """Whether a tokenizers file has these rules, and no added token that white space or a missing <| would hide."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    plain = all(t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in rules["added_tokens"])
    return plain and all(rules[k] == v for k, v in _BY_PIECE.items())


class WordEncoder:
    """Ids of whole texts by a tokenizers file, as 16- or 32-bit arrays.

    With a normalizer that turns white space runs into a space and lower-cases, and a pre-tokenizer that drops white
    space, a text's tokens are those of its white-space parts in turn, and each part is encoded by the library once while
    it stays cached. A file of any other rules has whole texts encoded by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_piece = _by_piece(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if self.suffix:
            # the same model without the normalizer, for words that it would leave as they are
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(self.suffix)]] = True

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian, one after the other."""
        return self.encode_batch(pa.array([text], pa.string()))[0].tobytes()

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each). texts: a string array without nulls.

        Arrow cuts the texts at white space and numbers the distinct parts. The pre-tokenizer always cuts between a
        letter or digit and a mark that is no apostrophe, and the normalizer lower-cases; so distinct parts are put in
        lower case (but for those that may hold a special token) and parted from a closing mark, and numbered again.
        Ids are looked up once for each distinct piece and then gathered for all its places.
        """
        if not self.by_piece:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return np.array([i for e in found for i in e.ids], self.dtype), np.fromiter((len(e.ids) for e in found), np.int64, len(found))
        # these four part words for Arrow, but are no white space to the library
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            parts = pa.array([[p for p in re.split(r"[ \t\n\r\x0b\x0c]+", t) if p] for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            parts = pc.utf8_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary
        words = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
        pieces = pc.split_pattern(pc.replace_substring_regex(words, "([0-9A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?])$", r"\1 \2"), " ")
        coded_pieces = pieces.flatten().dictionary_encode()
        known = self._lookup(coded_pieces.dictionary.to_pylist())
        return _gather(*_gather(*known, coded_pieces, pieces), coded, parts)

    def _lookup(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each); none for an empty piece.

        A full cache becomes the old generation, from which pieces that occur again are taken back.
        """
        if len(self.cache) > CACHE_PIECES:
            self.old, self.cache = self.cache, {}
        found = [*map(self.cache.get, pieces)]
        missed = [q for q, b in zip(pieces, found, strict=True) if b is None]
        if missed:
            fresh = {q: b for q, b in zip(missed, map(self.old.get, missed), strict=True) if b is not None}
            fresh[""] = b""
            new = [q for q in missed if q not in fresh]
            if self.suffix:
                self._encode_letters([q for q in new if q.isalpha() and (q.isascii() or (q == q.lower() and is_normalized("NFC", q)))], fresh)
            rest = [q for q in new if q not in fresh]
            if rest:
                for q, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                    fresh[q] = np.array(e.ids, self.dtype).tobytes()
            found = [fresh[q] if b is None else b for q, b in zip(pieces, found, strict=True)]
            self.cache.update((q, b) for q, b in fresh.items() if len(q) <= CACHE_CHARS)
        return np.frombuffer(b"".join(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize

    def _encode_letters(self, words: list[str], found: dict[str, bytes]) -> None:
        """Words of lower-case letters in one call: each is one pre-token, whose last token, and no other, bears the suffix."""
        if not words:
            return
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
        if len(ends) == len(words):
            raw, starts = ids.tobytes(), [0, *ends.tolist()]
            found.update((w, raw[a:b]) for w, a, b in zip(words, starts, starts[1:], strict=False))


def _gather(ids: np.ndarray, sizes: np.ndarray, coded: pa.DictionaryArray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """From ids and sizes by code: (ids of all coded values in order, number of ids of each list of them)."""
    place = coded.indices.to_numpy(zero_copy_only=False)
    own = sizes[place]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(own)])
    starts = (np.cumsum(sizes) - sizes)[place]
    out = ids[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], own)]
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return out, ends[offsets[1:]] - ends[offsets[:-1]]


#: Where a word that the recurrence runs over may start: at a line feed, or at the spaces before what is neither.
_WORD = re.compile(r"\n| *[^ \n]+| +")


class PrefixCounter:
    """Exact token counts of every prefix of a text by a sentencepiece BPE model, without encoding any prefix.

    The recurrence: a sequence of pieces is the encoding of their text if and only if each two neighbours are the
    encoding of theirs. So count[i] = count[i - len(t)] + 1 with t the one piece ending at i that goes with the last
    piece of the prefix before it; which pairs go together is asked of the library once for each pair. No piece of the
    vocabulary holds a space behind another character, or a line feed, so the recurrence starts anew at each word (its
    leading spaces and what follows, or a line feed), and a word's table is kept for its other occurrences.

    The model puts a space before every text. Models that the recurrence does not suit (pieces across words, no bytes
    for unknown characters, normalization) have each prefix encoded instead: exact, but in quadratic time.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [i for i in range(m.get_piece_size()) if m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i)]
        pieces = {m.id_to_piece(i): i for i in range(m.get_piece_size())}
        for i in special:
            pieces.pop(m.id_to_piece(i), None)
        self.pieces = pieces
        self.ends = {p[k:] for p in pieces for k in range(len(p))}
        self.feed = m.encode("\n")
        odd = "\ufb01\u2460e\u0301 \tA\u3000  b "  # a model that normalizes changes some of these
        self.splits = (
            not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
            and sum(map(m.is_byte, range(m.get_piece_size()))) == 256
            and m.decode(m.encode(odd)) == odd
            and m.encode("a  b\n") == m.encode("a  b") + self.feed[1:]
        )
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _together(self, before: str, piece: str) -> bool:
        """Whether the encoding of before + piece is just these two; before: empty where nothing can merge with the piece."""
        if len(self.pairs) > CACHE_PIECES:
            self.pairs.clear()
        ids = self.model.encode("\n" + (before + piece).replace("▁", " "))[len(self.feed) :]
        known = self.pairs[before, piece] = ids == ([self.pieces[before]] if before else []) + [self.pieces[piece]]
        return known

    def _word(self, word: str) -> bytes:
        """The table of one word: the count at each of its characters, as 32-bit integers."""
        word = word.replace(" ", "▁")
        # the last piece of each prefix; none for the empty one, and behind a character that the vocabulary lacks: it
        # becomes bytes, and nothing merges with these
        last, counts = [""], [0]
        pieces, ends, pairs = self.pieces, self.ends, self.pairs
        for i in range(1, len(word) + 1):
            at = i - 1
            while at >= 0:
                piece = word[at:i]
                if piece in pieces:
                    fits = pairs.get((last[at], piece))
                    if self._together(last[at], piece) if fits is None else fits:
                        last.append(piece)
                        counts.append(counts[at] + 1)
                        break
                elif piece not in ends:
                    at = 0
                at -= 1
            else:
                last.append("")
                counts.append(counts[i - 1] + len(word[i - 1].encode()))
        return np.array(counts[1:], "<u4").tobytes()

    def table(self, text: str) -> np.ndarray:
        """The exact token count of text[:1], text[:2], ... and of the whole text."""
        if not text:
            return np.zeros(0, np.int64)
        if not self.splits:
            return np.fromiter(map(len, self.model.encode([text[: k + 1] for k in range(len(text))], num_threads=1)), np.int64, len(text))
        words = _WORD.findall(" " + text.replace("▁", " "))  # to the model, both are the same
        found = [*map(self.cache.get, words)]
        if None in found:
            if len(self.cache) > CACHE_PIECES:  # it becomes the old generation, from which words that occur again are taken back
                self.old, self.cache = self.cache, {}
            old = self.old.get
            fresh = {w: old(w) or self._word(w) for w in {w for w, t in zip(words, found, strict=True) if t is None}}
            found = [fresh[w] if t is None else t for w, t in zip(words, found, strict=True)]
            self.cache.update((w, t) for w, t in fresh.items() if len(w) <= CACHE_CHARS)
        inside = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        totals = inside[np.cumsum(sizes) - 1].astype(np.int64)
        return (inside + np.repeat(np.cumsum(totals) - totals, sizes))[1:]

    def count(self, text: str) -> int:
        """The last entry of the table."""
        return int(self.table(text)[-1]) if text else 0


def longest_prefix(table: np.ndarray, budget: int) -> int:
    """The characters of the longest prefix of at most `budget` tokens, from a text's table. Counts need not ascend, so it may lie behind a prefix of more tokens."""
    fits = np.flatnonzero(table <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


_made: dict[tuple, object] = {}


def shared(kind: type, path: str):
    """One encoder for each file in a worker process."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]


#: Words that a twin encoder hands to the libraries at a time, and those it keeps before it starts anew.
TWIN_WORDS, TWIN_PIECES = 8192, 150_000
#: White space of any tokenizer's rules, as a class of Arrow's expressions.
_ANY_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


class TwinEncoder:
    """The ids of one text by two tokenizers: a byte-level BPE file (A, of the text behind a space) and a sentencepiece BPE model (B, which adds the space itself).

    Both part texts at a single space between characters that are no white space: A's pre-tokenizer puts the space to
    what follows, and no piece of B holds a space behind another character. So distinct words are encoded once while they
    stay cached. Texts with other runs of white space around a space are encoded whole, and so are all texts if a file
    has other rules.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = a = Tokenizer.from_file(path_a)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        if max(a.get_vocab_size(with_added_tokens=True), b.get_piece_size()) > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 tokens do not fit the ids")
        with open(path_a, encoding="utf-8") as f:
            rules = json.load(f)
        byte_of = {c: i for i, c in _byte_level()}
        self.a_bytes = [b""] * a.get_vocab_size(with_added_tokens=True)
        for piece, i in a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        before = rules["pre_tokenizer"] or {}
        self.by_word = (
            rules["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
            and not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not b.is_control(i)) and b.encode("a b") == b.encode("a") + b.encode("b")
        )
        self.cache: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}

    def _both(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and B of each text as 16-bit integers; none if the bytes of either do not join to a space and the text."""
        out = []
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for at in range(0, len(texts), TWIN_WORDS):
            part = texts[at : at + TWIN_WORDS]
            for text, a, b in zip(part, self.a.encode_batch_fast([f" {t}" for t in part], add_special_tokens=False), self.b.encode(part, num_threads=1), strict=True):
                whole, a = f" {text}".encode(), a.ids
                same = b"".join(map(a_bytes, a)) == whole == b"".join(map(b_bytes, b))
                out.append((array("H", a).tobytes(), array("H", b).tobytes()) if same else None)
        return out

    def _words(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        if len(self.cache) > TWIN_PIECES:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        new = [w for w in words if w not in cache]
        fresh = {w: old[w] for w in new if w in old}
        rest = [w for w in new if w not in fresh]
        fresh.update(zip(rest, self._both(rest), strict=True))
        found = [cache[w] if w in cache else fresh[w] for w in words]
        cache.update((w, t) for w, t in fresh.items() if len(w) <= CACHE_CHARS)
        return found

    def encode_batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """For each text of a string array without nulls: its ids by A and by B; none if it is empty or its bytes do not join to it."""
        if not self.by_word:
            yield from self._whole(texts.to_pylist())
            return
        odd = pc.match_substring_regex(texts, rf"{_ANY_SPACE} {_ANY_SPACE}|^ | $|  |^$").to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self._words([w for w in words if w])
        wrong = np.zeros(len(words), bool)
        at, sides = iter(known), ([], [])
        for i, w in enumerate(words):
            pair = next(at) if w else (b"", b"")
            wrong[i] = pair is None
            for side, ids in zip(sides, pair or (b"", b""), strict=True):
                side.append(ids)
        place, ends = coded.indices.to_numpy(zero_copy_only=False), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        bad = np.concatenate([[0], np.cumsum(wrong[place])])[ends]
        bad = bad[1:] > bad[:-1]
        gathered = []
        for side in sides:
            ids, sizes = _gather(np.frombuffer(b"".join(side), "<u2"), np.fromiter(map(len, side), np.int64, len(side)) // 2, coded, parts)
            gathered.append(np.split(ids, np.cumsum(sizes)[:-1]))
        whole = iter(list(self._whole(texts.filter(pa.array(odd)).to_pylist())))
        for i, (a, b) in enumerate(zip(*gathered, strict=True)):
            yield next(whole) if odd[i] else None if bad[i] else (a, b)

    def _whole(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        for text in texts:
            both = self._both([text])[0] if text else None
            yield both and (np.frombuffer(both[0], "<u2"), np.frombuffer(both[1], "<u2"))


def _byte_level() -> Iterator[tuple[int, str]]:
    """(byte, character) of the byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for those from 256 on, in turn."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    for i in range(256):
        yield i, chr(i if i in own else next(rest))


def twins(path_a: str, path_b: str) -> TwinEncoder:
    """One twin encoder for each pair of files in a worker process."""
    if (TwinEncoder, path_a, path_b) not in _made:
        _made[TwinEncoder, path_a, path_b] = TwinEncoder(path_a, path_b)
    return _made[TwinEncoder, path_a, path_b]
