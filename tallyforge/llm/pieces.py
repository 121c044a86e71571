"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The texts of a batch are cut into words (a run of spaces and what follows it; no piece crosses such a cut), and distinct words that the worker hasn't met are encoded together: one flat numpy array of symbols, cut once more wherever no piece holds the two neighbouring characters. Each round takes the segmented minimum of the pair ranks, merges the leftmost non-overlapping pairs of that rank in every segment at once, compacts the array, and sets segments aside that have no pair left. If a merge makes a pair that would go before the other merges of its segment, that segment merges its leftmost pair alone in this round, so the result is that of the library's one-at-a-time queue.

Defined cases: a null text counts as empty; an empty text has only the begin and end ids and decodes to an empty text; whole texts are encoded, of any length; repeated rows are encoded alike; characters outside the vocabulary fall back to bytes; an empty table gives an empty result; other columns pass through, except those named as a result column, which the result replaces.
"""

from __future__ import annotations

import codecs
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_texts
from .wordtable import WordTable

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
NONE = np.int64(1 << 40)
#: Text that is encoded at once (or a longer text); distinct words that are merged together.
CHUNK_BYTES, MERGE_WORDS = 8 << 20, 20_000

codecs.register_error("tallyforge_each_byte", lambda e: ("�", e.start + 1))


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: int) -> np.ndarray:
    """values at the places of wanted in the sorted keys, default where there is none."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], default)


class Pieces(WordTable):
    """A BPE model of the sentencepiece library with identity normalisation, from its serialised bytes."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models with identity normalisation that keep white space are supported")
        super().__init__()
        self.dummy_prefix = spec.add_dummy_prefix
        if other := {p.type for p in proto.pieces} - {1, 2, 3, 6}:
            raise ValueError(f"pieces of types {sorted(other)} (4: user-defined, 5: unused) aren't supported")
        normal = {p.piece: (k, p.score) for k, p in enumerate(proto.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece goes over the start of a word")
        control = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == 3}
        self.bos, self.eos = control["<s>"], control["</s>"]
        self.byte_ids = np.zeros(256, np.uint32)
        self.text_of: list[bytes] = []
        for k, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = k
            self.text_of.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else b" \xe2\x81\x87 " if p.type == 2 else p.piece.replace(SPACE, " ").encode())
        scores = sorted({s for _, s in normal.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        size = len(proto.pieces)
        self.size = size
        pairs, neighbours = {}, set()
        for piece, (k, score) in normal.items():
            for cut in range(1, len(piece)):
                neighbours.add(ord(piece[cut - 1]) << 21 | ord(piece[cut]))
                left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
                if left and right:
                    pairs[left[0] * size + right[0]] = (place[score], k)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = keys
        self.pair_rank = np.array([pairs[k][0] for k in keys.tolist()], np.int64)
        self.pair_id = np.array([pairs[k][1] for k in keys.tolist()], np.int64)
        self.neighbours = np.array(sorted(neighbours), np.int64)
        self.char_ids = np.full(0x110000, -1, np.int32)
        for piece, (k, _) in normal.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = k
        self.texts_of = pa.array(self.text_of, pa.binary())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (place in pair_keys for the merged id comes with a later look)."""
        found = lookup(self.pair_keys, self.pair_rank, left * self.size + right, NONE)
        return np.where((left >= 0) & (right >= 0), found, NONE)

    def merge(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and the flat places where they start. sym: a symbol for each character, negative if unknown; seg: its segment, ascending."""
        pos = np.arange(len(sym))
        rank = np.full(len(sym), NONE)
        same = seg[:-1] == seg[1:]
        rank[:-1][same] = self.ranks(sym[:-1][same], sym[1:][same])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            length = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            live = least < NONE
            if not live.all():
                on = np.repeat(live, length)
                done.append((sym[~on], pos[~on]))
                sym, seg, pos, rank = sym[on], seg[on], pos[on], rank[on]
                if not len(sym):
                    break
                length, least = length[live], least[live]
            number = np.repeat(np.arange(len(length)), length)
            hit = np.flatnonzero(rank == least[number])
            fresh = np.r_[True, hit[1:] != hit[:-1] + 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            pick = hit[(np.arange(len(hit)) - run) % 2 == 0]
            while True:
                owner = number[pick]
                first = np.r_[True, owner[1:] != owner[:-1]]
                new = sym.copy()
                new[pick] = lookup(self.pair_keys, self.pair_id, sym[pick] * self.size + sym[pick + 1], -1)
                stay = np.ones(len(sym), bool)
                stay[pick + 1] = False
                changed = np.zeros(len(sym), bool)
                changed[pick] = True
                new, nseg, nrank, changed, nnumber = new[stay], seg[stay], rank[stay], changed[stay], number[stay]
                changed[:-1] |= changed[1:]
                at = np.flatnonzero(changed)
                nrank[at] = NONE
                at = at[at + 1 < len(new)]
                at = at[nseg[at] == nseg[at + 1]]
                nrank[at] = self.ranks(new[at], new[at + 1])
                if first.all():
                    break
                many = np.zeros(len(length), bool)
                many[owner[~first]] = True
                early = nnumber[at[many[nnumber[at]] & (nrank[at] <= least[nnumber[at]])]]
                near = pick[many[owner] & (pick + 2 < len(sym))]  # the next symbol as it is before its own merge
                near = near[seg[near] == seg[near + 2]]
                merged = lookup(self.pair_keys, self.pair_id, sym[near] * self.size + sym[near + 1], -1)
                early = np.r_[early, number[near[self.ranks(merged, sym[near + 2]) <= least[number[near]]]]]
                if not len(early):
                    break
                alone = np.zeros(len(length), bool)
                alone[early] = True
                pick = pick[first | ~alone[owner]]
            pos = pos[stay]
            sym, seg, rank = new, nseg, nrank
        return np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")  # long words aside: rounds are as many as the longest needs
        found = [self.encode_words([words[j] for j in order[k : k + MERGE_WORDS]]) for k in range(0, len(words), MERGE_WORDS)]
        return order, np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, whose leading SPACE the caller has left off, and how many each has."""
        chars = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        cut = np.ones(len(chars), bool)
        cut[1:] = lookup(self.neighbours, np.zeros(len(self.neighbours), np.int64), chars[:-1] << 21 | chars[1:], 1) == 1
        cut[ends[:-1]] = True
        sym = self.char_ids[chars].astype(np.int64)
        sym = np.where(sym < 0, -1 - chars, sym)
        sym, pos = self.merge(sym, np.cumsum(cut))
        order = np.argsort(pos)
        sym, pos = sym[order], pos[order]
        if (unknown := np.flatnonzero(sym < 0)).size:
            into = {c: self.byte_ids[np.frombuffer(chr(-1 - c).encode(), np.uint8)] for c in set(sym[unknown].tolist())}
            times = np.ones(len(sym), np.int64)
            times[unknown] = [len(into[c]) for c in sym[unknown].tolist()]
            at = np.cumsum(times) - times
            out, pos = np.repeat(sym, times), np.repeat(pos, times)
            for k in unknown.tolist():
                out[at[k] : at[k] + times[k]] = into[int(sym[k])]
            sym = out
        return sym.astype(np.uint32), np.diff(np.searchsorted(pos, ends), prepend=0)

    def words(self, text: str) -> list[str]:
        """The words of a text without their first SPACE."""
        if self.dummy_prefix and SPACE not in text and "  " not in text and text[:1] != " ":
            return text.split(" ") if text else []
        text = (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)
        if text and text[0] != SPACE:
            raise ValueError("a model without a dummy prefix isn't supported")
        return [x[1:] for x in SEGMENT.findall(text)]

    def encode(self, texts: list[str], ends: bool = True) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers, with begin and end ids unless ends is False."""
        out: list[bytes] = [b""] * len(texts)
        begin, end = (np.array([x], "<u4").tobytes() if ends else b"" for x in (self.bos, self.eos))
        plain = [self.dummy_prefix and t[:1] not in ("", " ") and SPACE not in t and "  " not in t for t in texts]
        for group in (True, False):
            rows = [k for k, x in enumerate(plain) if x == group]
            if not rows:
                continue
            if group:
                lists = pc.split_pattern(pa.array([texts[k] for k in rows], pa.large_string()), " ")
                words, cuts = lists.flatten().cast(pa.string()), lists.offsets.to_numpy()
            else:
                split = [self.words(texts[k]) for k in rows]
                words, cuts = pa.array([w for ws in split for w in ws], pa.string()), np.cumsum([0, *map(len, split)])
            ids, sizes = self.ids(words, cuts)
            raw, at = ids.astype("<u4", copy=False).tobytes(), (4 * np.r_[0, np.cumsum(sizes)]).tolist()
            for k, a, b in zip(rows, at, at[1:]):
                out[k] = begin + raw[a:b] + end
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """The texts of ids as encode() returns them; bytes that are no UTF-8 become U+FFFD one by one."""
        whole = self.texts_of.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        raw = whole.buffers()[2].to_pybytes() if len(whole) else b""
        at = np.frombuffer(whole.buffers()[1], np.int32)[np.cumsum([0, *map(len, ids)]) // 4].tolist() if len(whole) else [0] * (len(ids) + 1)
        out = []
        for a, b in zip(at, at[1:]):
            text = raw[a:b].decode("utf-8", "tallyforge_each_byte")
            out.append(text[1:] if self.dummy_prefix and text[:1] == " " else text)
        return out


_models: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The model of a file that every machine has at path, once for each worker."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Pieces(f.read())
    return _models[path]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """docs with piece_ids (array of int, with begin and end ids) and, if asked for, piece_text, what the ids decode to."""

    def batch(texts: list[str]) -> dict[str, pa.Array]:
        model = pieces_of(model_path)
        ids = model.encode(texts)
        flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        out = {"piece_ids": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]) // 4, pa.int32()), flat)}
        if decoded:
            out["piece_text"] = pa.array(model.decode(ids), pa.string())
        return out

    return map_texts(docs, batch, "piece_ids array<int>" + ", piece_text string" * decoded, text, chunk=CHUNK_BYTES)


def digest_documents(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """doc_id and the digests of what encode_documents() would return, made where the ids are, so that they need not leave the worker."""

    def batch(texts: list[str]) -> dict[str, pa.Array]:
        model = pieces_of(model_path)
        ids = model.encode(texts)
        back = model.decode(ids)
        return {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]), "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back])}

    return map_texts(docs, batch, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", text, ["doc_id"], CHUNK_BYTES)
