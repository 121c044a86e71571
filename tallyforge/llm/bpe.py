"""BPE encoding by a priority queue of merge ranks, and decoding by concatenated vocabulary strings.

A text is cut at special tokens, normalised, and cut into words as the tokenizer's file states. The symbols of a word are a doubly linked list; a heap holds (rank, place) of every pair that the file merges. The least entry is taken again and again: if its place no longer holds a pair of that rank, the entry is stale and skipped; else the pair becomes one symbol, and the pairs that it forms with its neighbours are pushed. So a word of n symbols takes n log n steps, however long it is. Distinct words of a chunk are encoded once a worker (WordTable), and the ids of whole texts are laid out by array gathers.

Two forms of files are understood, and any other is refused: words without white space, whose last symbol is marked by a suffix, decoded with spaces between the vocabulary's strings; and byte-level words that keep their white space, whose strings' bytes are decoded together.

Defined cases: a null text counts as empty, an empty text has no ids and decodes to an empty text; whole texts are encoded, of any length; repeated rows are encoded alike; symbols that the vocabulary lacks are left out, as the library does where no unknown token is set; an empty table gives an empty result; other columns pass through, except those named as a result column, which the result replaces.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import map_texts
from .token_files import SPLITTER, word_wise
from .wordtable import WordTable

#: Text that is encoded at once (or a longer text); words of the file's splitting whose ids are remembered beside the table.
CHUNK_BYTES, MEMORY = 8 << 20, 400_000
# The splitting pattern of byte-level files, and the characters that the library takes for white space.
BYTE_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level files: itself where it is printable, else the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


def byte_wise(spec: dict) -> bool:
    """Whether a tokenizer (its file's content) cuts texts by the byte-level pattern, keeps white space and changes nothing else."""
    splits, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        not spec.get("normalizer")
        and (splits.get("type"), splits.get("add_prefix_space"), splits.get("use_regex", True)) == ("ByteLevel", False, True)
        and (spec.get("decoder") or {}).get("type") == "ByteLevel"
        and (model.get("type", "BPE"), model.get("dropout"), model.get("continuing_subword_prefix") or "", model.get("end_of_word_suffix") or "") == ("BPE", None, "", "")
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
    )


class Bpe(WordTable):
    """The encoder of a tokenizer file's content."""

    def __init__(self, file: str) -> None:
        super().__init__()
        spec = json.loads(file)
        self.file, self.library = file, None
        self.words_only = word_wise(spec) and not spec.get("decoder")
        model = spec["model"]
        if not (self.words_only or byte_wise(spec)) or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("this tokenizer's file has neither of the forms that are understood")
        vocabulary: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        letters = byte_letters()
        self.inner = [vocabulary.get(x, -1) for x in letters]
        self.last = [vocabulary.get(x + suffix, -1) for x in letters]
        self.rank_of: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank_of[vocabulary[left] * self.size + vocabulary[right]] = rank
            self.made.append(vocabulary[left + right])
        names = [""] * self.size
        for name, k in [*vocabulary.items(), *self.special.items()]:
            names[k] = name
        self.byte_of = {x: b for b, x in enumerate(letters)}
        raw = lambda name: bytes(map(self.byte_of.get, name)) if all(c in self.byte_of for c in name) else name.encode()
        self.strings = pa.array([f"{x} ".encode() if self.words_only else raw(x) for x in names], pa.large_binary())
        self.decimals = pa.array([b"%d " % k for k in range(self.size)], pa.large_binary())
        self.cut = regex.compile(SPLITTER.replace(r"\s", SPACE) if self.words_only else BYTE_SPLITTER.replace(r"[^\s", rf"[^{SPACE}").replace(r"\s", rf"[{SPACE}]").replace(r"\S", rf"[^{SPACE}]"))
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.memory: dict[str, list[int]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols that are left when no neighbours can be merged."""
        n, size, rank_of = len(symbols), self.size, self.rank_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 40 | k for k in range(n - 1) if (r := rank_of.get(symbols[k] * size + symbols[k + 1])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            rank, k = entry >> 40, entry & 0xFFFFFFFFFF
            other = after[k]
            if symbols[k] < 0 or other == n or rank_of.get(symbols[k] * size + symbols[other]) != rank:
                continue  # stale
            symbols[k], symbols[other] = self.made[rank], -1
            after[k] = behind = after[other]
            if behind < n:
                before[behind] = k
                if (r := rank_of.get(symbols[k] * size + symbols[behind])) is not None:
                    heappush(heap, r << 40 | k)
            if (front := before[k]) >= 0 and (r := rank_of.get(symbols[front] * size + symbols[k])) is not None:
                heappush(heap, r << 40 | front)
        return [x for x in symbols if x >= 0]

    def word(self, word: str) -> list[int]:
        """The ids of one word of the file's splitting."""
        ids = self.memory.get(word)
        if ids is None:
            raw = word.encode()
            symbols = [x for x in (*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]) if x >= 0]
            ids = self.merge(symbols) if len(symbols) > 1 else symbols
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[word] = ids
        return ids

    def odd(self, text: str) -> bool:
        """Whether a text has characters that Python's tables don't know, or would be changed by NFC: the library's tables are of other versions of Unicode, so its normaliser and splitter are asked."""
        return not text.isascii() and (self.words_only and not unicodedata.is_normalized("NFC", text) or any(unicodedata.category(c) == "Cn" for c in text))

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if self.odd(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.file)
            text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
            return [bytes(map(self.byte_of.get, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        if self.words_only and text.isascii():
            text = text.lower()
        elif self.words_only:
            text = text.replace("Σ", "σ").lower()  # letter by letter, so never ς
        return self.cut.findall(text)

    def plain(self, text: str) -> list[int]:
        """The ids of a text without special tokens."""
        return [k for w in self.pieces(text) for k in self.word(w)]

    def piece(self, text: str) -> list[int]:
        """The ids of any text."""
        if not self.marks or not (found := list(self.marks.finditer(text))):
            return self.plain(text)
        out, at = [], 0
        for m in found:
            out += [*self.plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.plain(text[at:])

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = [self.piece(w) for w in words]
        return np.arange(len(words)), np.fromiter((k for x in ids for k in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's begin (and the last one's end)."""
        if self.words_only:
            whole = pa.array(texts, pa.string())
            # special tokens keep their case, by which they are told
            lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(whole, "<|"), whole, pc.ascii_lower(whole)))
            words, cuts = lists.flatten(), lists.offsets.to_numpy()
        else:
            split = [self.split(t) for t in texts]
            words, cuts = pa.array([w for ws in split for w in ws], pa.string()), np.cumsum([0, *map(len, split)])
        ids, sizes = self.ids(words, cuts)
        return ids, np.r_[0, np.cumsum(sizes)]

    def split(self, text: str) -> list[str]:
        """The words of a text that keeps its white space; special tokens are words of their own."""
        if not self.marks or not (found := list(self.marks.finditer(text))):
            return self.pieces(text)
        out, at = [], 0
        for m in found:
            out += [*self.pieces(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.pieces(text[at:])

    @staticmethod
    def gathered(strings: pa.LargeBinaryArray, ids: np.ndarray, starts: np.ndarray) -> Iterable[bytes]:
        """For each text, the strings of its ids one after the other."""
        if not len(ids):
            return [b""] * (len(starts) - 1)
        whole = strings.take(pa.array(ids.astype(np.int64)))
        at = np.frombuffer(whole.buffers()[1], np.int64, len(ids) + 1)[starts].tolist()
        raw = memoryview(whole.buffers()[2])
        return (bytes(raw[a:b]) for a, b in zip(at, at[1:]))

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The texts that ids stand for, special tokens among them; bytes that are no UTF-8 become U+FFFD."""
        if self.words_only:
            return [x[:-1].decode() for x in self.gathered(self.strings, ids, starts)]
        return [x.decode("utf-8", "replace") for x in self.gathered(self.strings, ids, starts)]


_encoders: dict[str, Bpe] = {}


def encoder_of(path: str) -> Bpe:
    """The encoder of a file that every machine has at path, once for each worker."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            _encoders[path] = Bpe(f.read())
    return _encoders[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """docs with bpe_ids (array of int) and, if asked for, bpe_text, what the ids decode to."""

    def batch(texts: list[str]) -> dict[str, pa.Array]:
        bpe = encoder_of(tokenizer_path)
        ids, starts = bpe.encode(texts)
        out = {"bpe_ids": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))}
        if decoded:
            out["bpe_text"] = pa.array(bpe.decode(ids, starts), pa.string())
        return out

    return map_texts(docs, batch, "bpe_ids array<int>" + ", bpe_text string" * decoded, text, chunk=CHUNK_BYTES)


def digest_documents(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """doc_id and the digests of what encode_documents() would return, made where the ids are."""

    def batch(texts: list[str]) -> dict[str, pa.Array]:
        bpe = encoder_of(tokenizer_path)
        ids, starts = bpe.encode(texts)
        shown = [hashlib.sha256(x[:-1]).hexdigest() for x in bpe.gathered(bpe.decimals, ids, starts)]
        return {"n_tokens": pa.array(np.diff(starts), pa.int64()), "ids_sha256": pa.array(shown), "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode(ids, starts)])}

    return map_texts(docs, batch, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", text, ["doc_id"], CHUNK_BYTES)
