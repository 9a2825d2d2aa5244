"""Byte-pair encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never
be joined by a merge, so a word is cut there before any merge is tried. The
fragments are encoded independently (each result is remembered, as fragments
recur far more than words) and the ids concatenated; the result is exactly
that of merging the whole word.

``encode`` reads a tokenizer file of the ``tokenizers`` library: a BPE model
with a word-end suffix over byte letters, the normalizers NFC, white-space
replacement and lower-casing, and a splitting pattern. The file's path is a
parameter and must be readable on the executors.

Cases: null and empty texts have no ids and decode to an empty string;
special tokens' strings in a text become their ids; a word of any length is
merged with a heap in n log n steps; repeated rows stay; an empty table gives
an empty table. Only the columns named in ``keep`` are carried along; one of
them with an output's name is replaced by the output.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import slices, small_batches

#: Entries of each generation of a memory of past results.
REMEMBERED = 3 << 16
#: Longer pieces are not remembered.
SHORT = 48
#: Longer words are cut with array operations and merged with a heap.
LONG = 32
#: Rank of a pair that no merge joins.
NONE = 1 << 62
WHITE_SPACE = regex.compile(r"\p{White_Space}+")


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable
    Latin-1 stands for itself, the others take letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Memory:
    """Results of recent keys in two generations: when the young one is full it
    becomes the old one, whose entries return when they are asked for."""

    def __init__(self):
        self.young, self.old = {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found, 0)
        return found

    def put(self, key, value, length: int):
        if length <= SHORT:
            if len(self.young) >= REMEMBERED:
                self.old = dict(self.young)
                self.young.clear()
            self.young[key] = value
        return value


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(
            r"\s", r"\p{White_Space}"))
        vocab = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: v for k, v in special.items()}
        self.special_pattern = regex.compile("(" + "|".join(
            regex.escape(k) for k in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.tokens = {i: t for t, i in (vocab | special).items()}
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.merges = {}  # rank above the new token's id in one integer
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a], vocab[b]] = rank << 32 | vocab[a + b]
        # pairs of bytes found inside some token: [0] before its last place, [1] at a word's end
        self.joined = np.zeros((2, 256, 256), bool)
        for token in vocab:
            ends = token.endswith(self.suffix) and len(token) > len(self.suffix)
            core = [byte_of[c] for c in (token.removesuffix(self.suffix) if ends else token)]
            for k, (a, b) in enumerate(zip(core, core[1:], strict=False), 2):
                self.joined[int(ends and k == len(core)), a, b] = True
        self._joined_inner, self._joined_final = (x.tobytes() for x in self.joined)
        self._fragments, self._pieces = Memory(), Memory()

    # --- encoding

    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut at every certain boundary."""
        n, at, out = len(word), 0, []
        if n > LONG:
            codes = np.frombuffer(word, np.uint8)
            free = ~self.joined[0][codes[:-1], codes[1:]]
            free[-1] = not self.joined[1][codes[-2], codes[-1]]
            cuts = [0, *(np.flatnonzero(free) + 1).tolist(), n]
            return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        inner = self._joined_inner
        for i in range(1, n - 1):
            if not inner[word[i - 1] << 8 | word[i]]:
                out.append(word[at:i])
                at = i
        if n > 1 and not self._joined_final[word[-2] << 8 | word[-1]]:
            out.append(word[at:n - 1])
            at = n - 1
        out.append(word[at:])
        return out

    def _merge(self, fragment: bytes, ends: bool) -> list[int]:
        """Ids of one fragment: the merge of lowest rank, leftmost first, until
        none is left."""
        ids = [self.inner[b] for b in fragment]
        if ends:
            ids[-1] = self.final[fragment[-1]]
        if len(ids) > LONG:
            return self._merge_long(ids)
        merges = self.merges.get
        ranks = [merges(pair, NONE) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i, new = ranks.index(best), best & 0xFFFFFFFF
            ids[i: i + 2] = [new]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = merges((new, ids[i + 1]), NONE)
            if i:
                ranks[i - 1] = merges((ids[i - 1], new), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of merges over a linked list."""
        n, merges = len(ids), self.merges.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))
                if (found := merges((a, b), NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            found, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i] = new = found & 0xFFFFFFFF
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (found := merges((new, ids[k]), NONE)) != NONE:
                    heapq.heappush(heap, (found, i, new, ids[k]))
            h = before[i]
            if h >= 0 and (found := merges((ids[h], new), NONE)) != NONE:
                heapq.heappush(heap, (found, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        out, parts = [], self.fragments(word.encode())
        last = len(parts) - 1
        for k, fragment in enumerate(parts):
            key = (fragment, k == last)
            packed = self._fragments.get(key)
            if packed is None:
                packed = self._fragments.put(key, np.array(self._merge(*key), "<u4").tobytes(), len(fragment))
            out.append(packed)
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        """A piece without white space: its words, each encoded."""
        packed = self._pieces.get(piece)
        if packed is None:
            words = [piece] if piece.isascii() and piece.isalpha() else self.pattern.findall(piece)
            packed = self._pieces.put(piece, b"".join(map(self._word, words)), len(piece))
        return packed

    def _plain(self, text: str) -> bytes:
        # lower-casing is per character, so a final capital sigma is no exception
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        known, fresh = self._pieces.young.get, self._piece
        pieces = text.split() if text.isascii() and not _odd(text) else WHITE_SPACE.split(text)
        return b"".join([p if (p := known(x)) is not None else fresh(x) for x in pieces])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self._plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p)
                        for p in self.special_pattern.split(text) if p)

    # --- decoding

    def decode(self, packed: bytes | None) -> str:
        """The tokens of ids, joined by a space: the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(packed or b"", "<u4").tolist()])

    def restore(self, packed: bytes | None) -> str:
        """Readable text of ids: bytes put together again, a space after each
        word (white space, case and composition are not in the ids)."""
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        out = []
        for i in np.frombuffer(packed or b"", "<u4").tolist():
            token = self.tokens[i]
            if token in self.special:
                out.append(token.encode() + b" ")
                continue
            ends = token.endswith(self.suffix) and len(token) > len(self.suffix)
            out.append(bytes(byte_of[c] for c in (token.removesuffix(self.suffix) if ends else token)) + b" " * ends)
        return b"".join(out).decode("utf-8", "replace").rstrip(" ")


def _odd(text: str) -> bool:
    """Whether an ASCII text has separators that str.split takes for white
    space and Unicode does not."""
    return any(c in text for c in "\x1c\x1d\x1e\x1f")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _column(df: DataFrame, source: str, keep: list[str], out: str, kind, convert) -> DataFrame:
    """``keep`` columns and ``out``, which ``convert(codec value)`` makes of ``source``."""
    small_batches(df.sparkSession)
    keep = [c for c in keep if c != out]
    fields = [df.schema[c] for c in keep]

    def run(batches):
        change = convert()
        for part in slices(batches):
            made = pa.array([change(x) for x in part.column(len(keep)).to_pylist()],
                            pa.binary() if isinstance(kind, BinaryType) else pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], made], [*keep, out])

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(source).alias("_llm_source"))
    return rows.mapInArrow(run, StructType([*fields, StructField(out, kind)]))


def encode(df: DataFrame, path: str, text_col: str = "text", keep: tuple = ("doc_id",), out: str = "ids") -> DataFrame:
    """``keep`` columns and ``out`` (binary: ids as little-endian unsigned
    32-bit integers) of each row's whole text."""
    return _column(df, text_col, list(keep), out, BinaryType(), lambda: codec(path).encode)


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: tuple = ("doc_id", "ids"), out: str = "decoded",
           readable: bool = False) -> DataFrame:
    """``keep`` columns and ``out``, the decoded text of packed ids
    (``readable``: with the bytes put together again)."""
    return _column(df, ids_col, list(keep), out, StringType(),
                   lambda: codec(path).restore if readable else codec(path).decode)
