"""BPE encoding and decoding by dynamic programming over prefixes.

A sequence of tokens is what the merge rules make of a text exactly when each two neighbours are
what the rules make of those two tokens' text. So every prefix of a word has one last token. It is
found among the vocabulary entries that end where the prefix ends as the one that is compatible with
the last token of the shorter prefix before it. Following the back-pointers from the end of the word
gives the ids. The entries come from the suffix automaton of the vocabulary: its state after a prefix stands for the
prefix's longest end that occurs in an entry, and the suffix links lead to the shorter ends. Compatibility of a pair
is decided by undoing merges at the seam: a merge across the seam with an earlier rank than the
merge being undone would have come first. Decoding starts from the ids that were emitted.
The prefixes of a word are looked at from its end, each once, as far as an entry leads to them. New words are taken in sorted order:
what was found for a prefix holds for every word that starts with it.

Texts are normalised whole and cut into the pieces of the vocabulary's word pattern, which don't cross white space;
the ids of pieces are kept in a bounded cache.

Defined results: a null text counts as empty and has no ids; special tokens' strings in a text
become their ids; a text of any length is encoded whole. Rows keep their ids, repeated or null; an empty table gives
an empty result, and further columns play no part. Case and composition are Python's own; words with characters
that Python's Unicode version doesn't have go through the library's normaliser.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, caches_of, in_parts, small_batches

#: Entries of a worker's caches: some 170 bytes for a piece, 100 MB at most.
PIECES, PAIRS = 600_000, 200_000
# Fixed values of the vocabulary file's kind: its word pattern, its white space, its end mark.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters and numbers of Unicode versions after the library's own, which it doesn't know as such.
_NEWER = (
    r"\U00000558\U0000058b-\U0000058c\U0000088f\U00000c5c\U00000cdc\U0000208f\U0000209d-\U0000209f\U0000a7ce-\U0000a7cf\U0000a7d2\U0000a7d4"
    r"\U0000a7dd\U0000a7e2\U0000a7f1\U0000ab6c-\U0000ab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U00016ff4-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    r"\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    r"\U0003d000-\U0003fc3f"
)
LETTER, NUMBER = rf"[^\P{{L}}{_NEWER}]", rf"[^\P{{N}}{_NEWER}]"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
PIECE = rf"{_SHORT}|{LETTER}+|{NUMBER}|(?:[^{_WHITE}\p{{L}}\p{{N}}]|[{_NEWER}])+"
SPACE = rf"[{_WHITE}]+"
WORD_END = "</w>"
_MARK = "\n"
#: A prefix not looked at yet, one that no entry ends, the empty one.
_OPEN, _NONE, _START = -3, -1, -2
_ODD = re.compile("[\x1c-\x1f]")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 is itself, others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _normal(text: str) -> str:
    """Composed and in lower case, letter by letter."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def split_words(text: str) -> list[str]:
    """White-space-delimited words, by the white space of the word pattern."""
    if _ODD.search(text):  # str.split() would cut at these too
        return [w for w in regex.split(SPACE, text) if w]
    return text.split()


@lru_cache(1)
def plain_pattern() -> re.Pattern:
    """The word pattern for texts of characters up to U+FFFF, as plain ranges for the faster engine."""
    points = "".join(map(chr, range(0x10000)))
    letter, number = ("".join([f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(f"{kind}+", points)]) for kind in (LETTER, NUMBER))
    return re.compile(rf"[{letter}]+|{_SHORT}|[{number}]|[^{_WHITE}{letter}{number}]+")


class SuffixAutomaton:
    """All parts of all entries; a state's ``found`` lists the (length, id) of entries that end there, long ones first.

    The entries of the states along the suffix links are listed with a state's own. Of these own ones those count
    that are no longer than what was matched.
    """

    def __init__(self, entries: list[tuple[str, int]]):
        self.size, self.link = [0], [-1]
        steps: list[dict[str, int]] = [{}]
        ends: dict[int, list[tuple[int, int]]] = {}
        for text, _ in entries:
            last = 0
            for c in text:
                last = self._extend(steps, last, c)
        for text, i in entries:  # states may have been split since they were made
            at = 0
            for c in text:
                at = steps[at][c]
            ends.setdefault(at, []).append((len(text), i))
        self.found: list[tuple] = [()] * len(steps)
        for s in sorted(range(1, len(steps)), key=self.size.__getitem__):
            above = self.found[self.link[s]]
            self.found[s] = (*sorted(ends[s], reverse=True), *above) if s in ends else above
        self.steps = steps

    def _extend(self, steps: list[dict[str, int]], last: int, c: str) -> int:
        size, link = self.size, self.link
        old = steps[last].get(c)
        if old is not None and size[old] == size[last] + 1:
            return old
        if old is None:
            new = len(steps)
            steps.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = new
                p = link[p]
            if p < 0:
                return new
            old = steps[p][c]
            if size[old] == size[p] + 1:
                link[new] = old
                return new
        else:
            new, p = -1, last
        twin = len(steps)
        steps.append(dict(steps[old]))
        size.append(size[p] + 1)
        link.append(link[old])
        link[old] = twin
        if new >= 0:
            link[new] = twin
        while p >= 0 and steps[p].get(c) == old:
            steps[p][c] = twin
            p = link[p]
        return twin if new < 0 else new


class PrefixBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens: list[str] = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        # the merge that makes each token: its rank and its two parts
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges.setdefault(x << 32 | y, r)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.letters = byte_letters()
        self._pairs = Cache(self._seam, PAIRS)
        usable = []
        for t, i in self.vocab.items():
            form = t[: -len(WORD_END)] + _MARK if t.endswith(WORD_END) and len(t) > len(WORD_END) else t
            if len(form) - form.endswith(_MARK) == 1 or (self.rank[i] >= 0 and self.whole(i)):
                usable.append((form, i))
        self._automaton = SuffixAutomaton(usable)
        # letters of each token as they stand in a word's form, with the end mark
        self.sizes = [len(t) - len(WORD_END) + 1 if t.endswith(WORD_END) and len(t) > len(WORD_END) else len(t) for t in self.tokens]
        self._plain, self._pattern = plain_pattern().findall, regex.compile(PIECE).findall
        self._cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._library = None
        self.pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def whole(self, token: int) -> bool:
        """Whether the rules make this token of its own text."""
        if self.rank[token] < 0:
            return True
        x, y = self.left[token], self.right[token]
        return self._seam(x << 32 | y, self.rank[token]) and self.whole(x) and self.whole(y)

    def _seam(self, pair: int, bound: int | None = None) -> bool:
        """Whether no merge across the seam of a pair comes before those that made its tokens.

        bound: rank of the one merge across the whole seam that is allowed."""
        x, y = pair >> 32, pair & 0xFFFFFFFF
        rank, merges = self.rank, self.merges
        limit = bound if bound is not None else len(merges)
        while True:
            r = merges.get(x << 32 | y)
            if r is not None and r < limit:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[x] > rank[y]:  # of equal merges the left one comes first
                limit, x = rank[x], self.right[x]
            else:
                limit, y = rank[y] + 1, self.left[y]

    def _learn(self, new: set[str]) -> None:
        """Ids of new pieces, little-endian unsigned 32-bit integers: the last token of each prefix, then back from the end."""
        letters, pairs, sizes = self.letters, self._pairs, self.sizes
        a = self._automaton
        steps, found, link, size_of = a.steps, a.found, a.link, a.size
        forms = [(p if p.isascii() and p.isprintable() else "".join([letters[b] for b in p.encode("utf-8", "replace")]), p) for p in new]
        earlier, states, lengths, last = "", [0], [0], [_START]
        for form, piece in sorted(forms):
            same = 0
            for c, d in zip(form, earlier, strict=False):
                if c != d:
                    break
                same += 1
            earlier = form
            del states[same + 1 :], lengths[same + 1 :], last[same + 1 :]
            state, length = states[same], lengths[same]
            for c in form[same:] + _MARK:
                to = steps[state].get(c)
                while to is None and state:
                    state = link[state]
                    length = size_of[state]
                    to = steps[state].get(c)
                state, length = (to, length + 1) if to is not None else (0, 0)
                states.append(state)
                lengths.append(length)
            end = len(form) + 1
            last += [_OPEN] * (end - same)
            todo = [end]
            while todo:
                at = todo[-1]
                length = lengths[at]
                for size, token in found[states[at]]:
                    if size <= length:
                        before = last[at - size]
                        if before == _OPEN:
                            todo.append(at - size)
                            break
                        if before == _START or (before >= 0 and pairs[before << 32 | token]):
                            last[at] = token
                            todo.pop()
                            break
                else:
                    last[at] = _NONE
                    todo.pop()
            ids = []
            while end:
                ids.append(last[end])
                end -= sizes[last[end]]
            ids.reverse()
            self.pieces[piece] = array("I", ids).tobytes()

    def _library_normal(self, word: str) -> str:
        if self._library is None:
            from tokenizers import normalizers

            self._library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        return self._library.normalize_str(word)

    def _pieces_of(self, text: str) -> list[str]:
        """Pieces of a text without special tokens."""
        if text.isascii():
            return self._plain(text.lower())
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            text = " ".join([self._library_normal(w) if any(unicodedata.category(c) == "Cn" for c in w) else _normal(w) for w in split_words(text)])
        else:
            text = _normal(text)
        if not _BEYOND.search(text):
            return self._plain(text)
        return [p for w in split_words(text) for p in (self._pattern(w) if _BEYOND.search(w) else self._plain(w))]

    def _keys(self, text: str) -> list[str]:
        """Pieces of a text; a special token is one with a mark before it."""
        if "<" not in text or self._cut is None or not self._cut.search(text):
            return self._pieces_of(text)
        keys, at = [], 0
        for m in self._cut.finditer(text):
            keys += [*self._pieces_of(text[at : m.start()]), _MARK + m[0]]
            at = m.end()
        return keys + self._pieces_of(text[at:])

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of whole texts, four bytes each."""
        if len(self.pieces) >= PIECES // 2:  # those of the older half that are in use come back
            self.pieces, self._older = {}, self.pieces
        keys = [self._keys(t or "") for t in texts]
        new: set[str] = set()
        for k in keys:
            new |= set(k).difference(self.pieces)
        for k in new.intersection(self._older):
            self.pieces[k] = self._older.pop(k)
        new.difference_update(self.pieces)
        for k in [k for k in new if k[0] == _MARK]:
            self.pieces[k] = array("I", [self.special[k[1:]]]).tobytes()
            new.remove(k)
        self._learn(new)
        get = self.pieces.__getitem__
        return [b"".join([*map(get, k)]) for k in keys]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces: this vocabulary file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@lru_cache(2)
def codec(path: str) -> PrefixBpe:
    """One for each worker and vocabulary."""
    return PrefixBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded, for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        caches_of("bpe", codec.cache_clear)
        for batch in batches:
            for part in in_parts(batch, 1):
                ids = bpe.encode_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
