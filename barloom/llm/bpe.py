"""BPE encoding and decoding by speculation and verification.

Texts are split into pre-tokens; each distinct pre-token is encoded once per task (a bounded cache).
Greedy longest matches propose its tokens. A proposal is right exactly if each token is what the
merges make of its own string and no merge reaches over the boundary of two neighbours; all distinct
neighbouring pairs are tested at once, by following the right edge of the left token's merge tree
and the left edge of the right token's. Pre-tokens whose proposal fails are merged exactly.

The vocabulary file's path is a parameter; the driver reads the file and ships its text, so
executors need not have it. Files of one kind are understood: NFC, white space to spaces, lower
case, the words/digit/symbols pattern, byte characters and an end-of-word mark.

Defined cases: a null text is the empty text and has no tokens; special strings inside texts are
special tokens; repeated rows are encoded each for itself; an empty table gives no rows; other
columns are kept by ``encoded`` unless they have the name of a new column, which then replaces them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.base import free_name, text_of

#: Bytes of text whose pre-tokens are held at once, and pre-tokens and pairs remembered by a task.
CHUNK_BYTES = 1_000_000
REMEMBERED = 400_000
#: Largest vocabulary file shipped to executors.
MAX_FILE_BYTES = 64_000_000

# The pattern of pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"

# Code points that NFC leaves alone and of which the built-in module knows the letters.
_LATIN = r"\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ"
# The lower case of some (Ɛ, Ɓ, Ə) lies beyond the range; texts with them take the general way.
_STAYING = "".join(
    c for c in re.findall(rf"[{_LATIN}]", "".join(map(chr, range(0x250)))) if c.lower() < "\u0250"
)
_PLAIN = re.compile(rf"[\x00-\x7f{_STAYING}]*")
_PLAIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^ \t\n\r\f\va-z0-9{_LATIN}]+"
)
_WORDS = regex.compile(PATTERN)

_FAR = np.int64(1 << 40)
_NEVER = 1 << 40


def _byte_characters() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file."""

    def __init__(self, content: str):
        file = json.loads(content)
        steps = [s["type"] for s in (file.get("normalizer") or {}).get("normalizers", [])]
        pattern = json.dumps(file.get("pre_tokenizer"))
        if steps != ["NFC", "Replace", "Lowercase"] or json.dumps(PATTERN) not in pattern:
            raise ValueError("not a vocabulary of the kind this module encodes with")
        self.ids: dict[str, int] = file["model"]["vocab"]
        if file["model"]["end_of_word_suffix"] != END:
            raise ValueError("unknown end-of-word mark")
        self.special = {t["content"]: t["id"] for t in file["added_tokens"] if t["special"]}
        size = max(*self.ids.values(), *self.special.values()) + 1
        self.size = size
        self.names = [""] * size
        for name, i in [*self.ids.items(), *self.special.items()]:
            self.names[i] = name
        #: rank of a merge by its two strings, and the halves and rank of each merged token
        self.ranks: dict[tuple[str, str], int] = {}
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        self.rank = np.full(size, -1, dtype=np.int64)
        for rank, (a, b) in enumerate(file["model"]["merges"]):
            self.ranks[a, b] = rank
            made = self.ids[a + b]
            self.left[made], self.right[made], self.rank[made] = self.ids[a], self.ids[b], rank
        keys = np.array([self.ids[a] * size + self.ids[b] for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], order.astype(np.int64)
        #: length of the longest token inside a word, and at its end, by first code points
        self.inside: dict[str, int] = {}
        self.ending = 0
        for name in self.ids:
            bare = name.removesuffix(END)
            if name == bare:
                self.inside[bare[:3]] = max(self.inside.get(bare[:3], 0), len(bare))
            else:
                self.ending = max(self.ending, len(bare))
        self.own: dict[int, bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Exact BPE: the merge of lowest rank, leftmost first, until none applies."""
        get = self.ranks.get
        ranked = [get(pair, _NEVER) for pair in zip(symbols, symbols[1:])]
        while ranked:
            best = min(ranked)
            if best == _NEVER:
                break
            i = ranked.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            # only the pairs on either side of the new symbol change
            del ranked[i]
            if i:
                ranked[i - 1] = get((symbols[i - 1], symbols[i]), _NEVER)
            if i < len(ranked):
                ranked[i] = get((symbols[i], symbols[i + 1]), _NEVER)
        return symbols

    def symbols(self, name: str) -> list[str]:
        bare = name.removesuffix(END)
        return [*bare[:-1], bare[-1] + name[len(bare) :]]

    def is_own(self, token: int) -> bool:
        """Do the merges make this token of its string?"""
        if token not in self.own:
            name = self.names[token]
            self.own[token] = self.merged(self.symbols(name)) == [name]
        return self.own[token]

    def proposed(self, word: str) -> list[int] | None:
        """Greedy longest matches; the last token carries the end-of-word mark."""
        tokens, i, n, get, inside = [], 0, len(word), self.ids.get, self.inside.get
        while i < n:
            if n - i <= self.ending and (token := get(word[i:] + END)) is not None:
                tokens.append(token)
                return tokens
            # tokens of one or two code points always begin like themselves
            reach = inside(word[i : i + 3], 0) or inside(word[i : i + 2], 0) or 1
            for j in range(min(n - 1, i + reach), i, -1):
                if (token := get(word[i:j])) is not None:
                    tokens.append(token)
                    i = j
                    break
            else:
                return None
        return None

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Does no merge reach over the boundary of a and b, for each pair?

        A merge of x, on the right edge of a, with y, on the left edge of b,
        comes about if both are there and neither has been merged further: after
        its own rank and theirs, before the merge that x goes into (which, being
        further left, wins a tie) and not after the one y goes into.
        """
        apart = np.ones(len(a), dtype=bool)
        x, x_until = a.astype(np.int64), np.full(len(a), _FAR)
        while (x >= 0).any():
            y, y_until = b.astype(np.int64), np.full(len(b), _FAR)
            while (y >= 0).any():
                there = (x >= 0) & (y >= 0)
                keys = x * self.size + y
                at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
                merge = np.where(self.merge_keys[at] == keys, self.merge_ranks[at], _FAR)
                when = np.maximum(merge, np.maximum(self.rank[x], self.rank[y]))
                apart &= ~(there & (merge < _FAR) & (when < x_until) & (when <= y_until))
                y_until = np.where(y >= 0, self.rank[y], y_until)
                y = np.where(y >= 0, self.left[y], -1)
            x_until = np.where(x >= 0, self.rank[x], x_until)
            x = np.where(x >= 0, self.right[x], -1)
        return apart


class Encoder:
    """Encodes pre-tokens in batches and remembers them."""

    def __init__(self, content: str):
        self.vocabulary = Vocabulary(content)
        self.byte_names = _byte_characters()
        self.special_parts = re.compile(
            "(" + "|".join(map(re.escape, self.vocabulary.special)) + ")"
        )
        self.pairs: dict[int, bool] = {}
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}
        self._know_special()

    def _know_special(self) -> None:
        for name, token in self.vocabulary.special.items():
            self.ids_of[name] = array("i", [token]).tobytes()
            self.text_of[name] = name

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text, special strings among them as they are."""
        if any(name in text for name in self.vocabulary.special):
            found = []
            for i, part in enumerate(self.special_parts.split(text)):
                found += [part] if i % 2 else self._plain_words(part)
            return found
        return self._plain_words(text)

    @staticmethod
    def _plain_words(text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _PLAIN_WORDS.findall(text.lower())
        # lower case goes by code points: no final form of sigma
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return _WORDS.findall(text)

    def _named(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word
        return "".join([self.byte_names[b] for b in word.encode()])

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words that aren't remembered yet; of too many the older half is forgotten."""
        if (n := len(self.ids_of)) > REMEMBERED:
            self.ids_of = dict(islice(self.ids_of.items(), n // 2, None))
            self.text_of = dict(islice(self.text_of.items(), n // 2, None))
            self._know_special()
        new = [w for w in words if w not in self.ids_of]
        names = self.vocabulary.names
        for word, tokens in zip(new, self.tokens_of(new), strict=True):
            self.ids_of[word] = array("i", tokens).tobytes()
            self.text_of[word] = " ".join([names[t] for t in tokens])

    def tokens_of(self, new: list[str]) -> list[list[int]]:
        """The tokens of distinct pre-tokens: proposals that pass the test, exact merges for others."""
        v = self.vocabulary
        names = [self._named(w) for w in new]
        proposals = [v.proposed(name) or [] for name in names]
        sizes = np.array(list(map(len, proposals)), dtype=np.int64)
        flat = np.array(list(chain.from_iterable(proposals)), dtype=np.int64)
        owner = np.repeat(np.arange(len(new)), sizes)
        good = sizes > 0
        tokens, back = np.unique(flat, return_inverse=True)
        own = np.array([v.is_own(t) for t in tokens.tolist()], dtype=bool)
        if len(flat):
            good[owner[~own[back]]] = False
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        codes, back = np.unique(flat[inner] * v.size + flat[inner + 1], return_inverse=True)
        unknown = [c for c in codes.tolist() if c not in self.pairs]
        if unknown:
            if len(self.pairs) > 2 * REMEMBERED:
                self.pairs, unknown = {}, codes.tolist()
            pairs = np.array(unknown, dtype=np.int64)
            held = v.compatible(pairs // v.size, pairs % v.size)
            self.pairs.update(zip(unknown, held.tolist(), strict=True))
        held = np.array([self.pairs[c] for c in codes.tolist()], dtype=bool)
        if len(inner):
            good[owner[inner[~held[back]]]] = False
        ids, special = v.ids, v.special
        return [
            [special[word]] if word in special
            else found if right
            else [ids[x] for x in v.merged(v.symbols(name + END))]
            for word, name, found, right in zip(new, names, proposals, good.tolist(), strict=True)
        ]


def texts_of(column: pa.Array, size: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``size`` bytes."""
    held: list[str] = []
    start = bytes_held = 0
    for i, value in enumerate(column):
        text = value.as_py()
        held.append(text)
        bytes_held += len(text)
        if bytes_held >= size:
            yield start, held
            held, start, bytes_held = [], i + 1, 0
    if held:
        yield start, held


def vocabulary_file(path: str) -> str:
    """The file's text, read on the driver; its size is bounded before it is shipped."""
    with open(path, encoding="utf-8") as file:
        content = file.read(MAX_FILE_BYTES + 1)
    if len(content) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} characters")
    return content


def encoded(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
    *,
    keep_text: bool = True,
) -> DataFrame:
    """The documents with the token ids of their texts and the text decoded from the ids.

    Without ``keep_text`` the text itself is left out, and not carried along.
    """
    content = docs.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary))
    dropped = {ids.lower(), decoded.lower(), *([] if keep_text else [text.lower()])}
    kept = [c for c in docs.columns if c.lower() not in dropped]
    said = free_name(kept, "said")
    from_docs = docs.select(
        *[F.col(f"`{c}`") for c in kept], text_of(F.col(f"`{text}`")).alias(said)
    )
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(ids, T.ArrayType(T.IntegerType()))
    schema = schema.add(decoded, "string")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(content.value)
        for batch in batches:
            for start, texts in texts_of(batch.column(said), CHUNK_BYTES):
                words = [encoder.words(t) for t in texts]
                encoder.learn({w for ws in words for w in ws})
                get_ids, get_text = encoder.ids_of.__getitem__, encoder.text_of.__getitem__
                blobs = [b"".join(map(get_ids, ws)) for ws in words]
                limits = np.cumsum([0, *map(len, blobs)]) // 4
                flat = pa.Array.from_buffers(
                    pa.int32(), int(limits[-1]), [None, pa.py_buffer(b"".join(blobs))]
                )
                part = batch.slice(start, len(texts))
                columns = [part.column(c) for c in kept]
                columns.append(pa.ListArray.from_arrays(pa.array(limits, pa.int32()), flat))
                columns.append(pa.array([" ".join(map(get_text, ws)) for ws in words]))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, decoded])

    return from_docs.mapInArrow(encode, schema)
