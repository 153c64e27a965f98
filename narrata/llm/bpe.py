"""Byte-level BPE with the tokenizers library over Arrow batches.

A text is cut where no piece of the pre-tokenizer's pattern can reach across:
before a single space, and around a single line feed, between characters that
are not white space.  The cuts repeat a lot (they are words), so each distinct
one goes through the library once per worker and its ids are gathered from
there; any text with other white space, or white space in a row, goes through
the library's pre-tokenizer as a whole.  Both ways give what the library gives
for the whole text.  Decoding reverses the byte table; a character that is
split between tokens is whole again once the bytes are joined, and offsets
give each token the characters that its bytes touch.
"""

from __future__ import annotations

import base64
import hashlib
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism

#: Cuts are safe in texts without these (RE2): white space in a row, other white space, or the separator.
UNSAFE = r"[ \n][ \n]|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Distinct cuts, and pieces, that a worker remembers before it starts anew (some 450 bytes each).
REMEMBERED = 250_000
#: Bytes of text that are encoded at once: the more, the fewer distinct cuts there are to look up.
TEXTS = 8 << 20
#: Cuts of printable ASCII without an apostrophe (which contractions join to letters), after a space or not.
PLAIN = r"^ ?[!-&(-~]+$"
#: Cuts of characters below U+0250, which all Unicode versions in use class alike, so the regex module may split them.
LATIN = r"^ ?[!-~\x{a1}-\x{24f}]+$"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 stands for itself; the other bytes take the characters from 256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, spare = [], 256
    for b in range(256):
        table.append(chr(b if b in plain else spare))
        spare += b not in plain
    return table


def public_pattern() -> str:
    """The pre-tokenizer's pattern of byte-level vocabularies that do not name their own."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token: the pair left when its bytes are merged by lower ranks only, in rank order."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Encoder:
    """Encodes batches of texts to ids and back.  ``path``: a tokenizer's .json, or a rank file with its ``pattern``.

    ``special``: whether the strings of a .json's special tokens become those
    tokens, the library's default, or are ordinary text.
    """

    def __init__(self, path: str, pattern: str | None = None, remembered: int = REMEMBERED, special: bool = False):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        if path.endswith(".json"):
            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = not special
            if tok.normalizer is not None:
                raise ValueError("byte-level vocabularies without a normalizer are supported")
            self.pre, self.model = tok.pre_tokenizer, tok.model
            vocab = {i: t for t, i in tok.get_vocab(with_added_tokens=False).items()}
            self.tokens = [bytes(back[c] for c in vocab.get(i, "") if c in back) for i in range(max(vocab) + 1)]
        else:
            ranks = read_ranks(path)
            text = lambda t: "".join(chars[b] for b in t)
            self.model = models.BPE({text(t): r for t, r in ranks.items()}, [(text(a), text(b)) for a, b in merges_of(ranks)])
            self.pre = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.tokens = [b""] * (max(ranks.values()) + 1)
            for t, r in ranks.items():
                self.tokens[r] = t
        added = [t.content for t in tok.get_added_tokens_decoder().values()] if special and path.endswith(".json") else []
        self.contents, self.added, self.library = added, "|".join(map(regex.escape, added)), tok if added else None
        spelled = list(self.tokens)
        for i, t in tok.get_added_tokens_decoder().items() if added else ():
            spelled += [b""] * (i + 1 - len(spelled))
            spelled[i] = t.content.encode()
        lens = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.byte_len, self.byte_at = lens, np.cumsum(lens) - lens
        self.byte_flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.decimal = list(map(str, range(len(spelled))))
        self.split = regex.compile(pattern or public_pattern()).findall
        self.bulk = Tokenizer(self.model)  # no pre-tokenizer: what it gets is one piece or pieces that cannot merge
        in_merges = {c for t in self.tokens if len(t) > 1 for c in t}
        # A byte of no token but its own cannot merge with its neighbours, so it holds pieces apart.
        self.apart = next((b for b in range(255, -1, -1) if b not in in_merges and bytes([b]) in self.tokens), None)
        self.apart_id = None if self.apart is None else self.tokens.index(bytes([self.apart]))
        # If ASCII tokens never reach over two pieces (contractions aside), no merge does, and ASCII cuts need no splitting.
        ascii_tokens = [t.decode() for t in self.tokens if t and t.isascii() and b"'" not in t]
        self.whole_ascii = all(len(self.split(t)) == 1 for t in ascii_tokens)
        self.chars = {b: c for b, c in enumerate(chars)}
        self.wide: dict[str, list[int]] = {}
        self.remembered = remembered
        self._forget()

    def _forget(self):
        self.units, self.unit_ids = _Numbers(), _Lists()
        self.pieces, self.piece_ids = _Numbers(), _Lists()

    def _whole(self, text: str) -> list[int]:
        """The ids of a text: the library's pre-tokenizer, then its model for each piece not seen yet."""
        if self.added and regex.search(self.added, text):
            return self.library.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        if len(self.wide) > self.remembered:
            self.wide.clear()
        for piece, _ in self.pre.pre_tokenize_str(text):
            ids = self.wide.get(piece)
            if ids is None:
                ids = self.wide[piece] = [t.id for t in self.model.tokenize(piece)]
            out += ids
        return out

    def _latin(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of Latin cuts and the number of ids of each: split at once by the pattern, new pieces encoded in bulk.

        A line feed between cuts is a piece of its own, whatever stands beside it.
        """
        pieces = self.split("\n".join(units))
        codes = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        self.piece_ids.extend(*self._bulk(self.pieces.take()))
        held = codes != self.pieces["\n"]
        self.piece_ids.extend(*self._pairs(self.pieces.take()))
        own = np.cumsum(~held)[held]
        lens = self.piece_ids.len[codes[held]]
        return self.piece_ids.gather(codes[held]), np.bincount(own, weights=lens, minlength=len(units)).astype(np.int64)

    def _bulk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that each are a piece (or ASCII pieces that cannot merge), many to a call and held apart."""
        sep, flat, lens = bytes([self.apart]), [], []
        for at in range(0, len(texts), 32 * 1024):
            part = texts[at : at + 32 * 1024]
            rows = [sep.join([p.encode() for p in part[i : i + 32]]).decode("latin-1").translate(self.chars) for i in range(0, len(part), 32)]
            ids = np.fromiter(chain.from_iterable((*e.ids, self.apart_id) for e in self.bulk.encode_batch_fast(rows, add_special_tokens=False)), np.int64)
            cuts = np.flatnonzero(ids == self.apart_id)
            flat.append(np.delete(ids, cuts))
            lens.append(np.diff(cuts, prepend=-1) - 1)
        return (np.concatenate(flat), np.concatenate(lens)) if flat else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _pairs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = list(map(self._whole, texts))
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, int(lens.sum())), lens

    def _kinds(self, units: list[str]) -> np.ndarray:
        """How each cut is encoded: 0 by the library's pre-tokenizer, 1 split by the pattern here, 2 as it is."""
        if self.apart is None:
            return np.zeros(len(units), np.int8)
        text = pa.array(units, pa.string())
        plain, latin = (np.asarray(pc.match_substring_regex(text, p)) for p in (PLAIN, LATIN))
        kinds = np.where(plain & self.whole_ascii, 2, np.where(latin, 1, 0)).astype(np.int8)
        for content in self.contents:
            kinds[np.asarray(pc.match_substring(text, content))] = 0
        return kinds

    def _learn(self, fresh: list[str]) -> None:
        """Adds the ids of new cuts, in their order."""
        kind = self._kinds(fresh)
        ways = {0: self._pairs, 1: self._latin, 2: self._bulk}
        parts = {k: way([fresh[i] for i in np.flatnonzero(kind == k)]) for k, way in ways.items() if (kind == k).any()}
        lens = np.zeros(len(fresh), np.int64)
        for k, (_, own) in parts.items():
            lens[kind == k] = own
        flat, owner = np.zeros(int(lens.sum()), np.int64), np.repeat(kind, lens)
        for k, (ids, _) in parts.items():
            flat[owner == k] = ids
        self.unit_ids.extend(flat, lens)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text (no nulls)."""
        if len(self.units) > self.remembered or len(self.pieces) > self.remembered:
            self._forget()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        safe = ~np.asarray(pc.match_substring_regex(texts, UNSAFE))
        for content in self.contents:
            safe &= ~np.asarray(pc.match_substring(texts, content))
        plain = texts if safe.all() else texts.filter(pa.array(safe))
        marked = pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0")
        cuts = pc.split_pattern(marked, "\0")
        distinct = cuts.flatten().dictionary_encode()
        numbers = np.fromiter(map(self.units.__getitem__, distinct.dictionary.to_pylist()), np.int64, len(distinct.dictionary))
        counts = np.ones(len(texts), np.int64)
        counts[safe] = np.diff(np.asarray(cuts.offsets))
        codes, cut = np.zeros(int(counts.sum()), np.int64), np.repeat(safe, counts)
        codes[cut] = numbers[np.asarray(distinct.indices)]
        codes[~cut] = [self.units[_Whole(t)] for t in texts.filter(pa.array(~safe)).to_pylist()]
        fresh = self.units.take()
        if fresh:
            self._learn(fresh)
        ends = np.cumsum(self.unit_ids.len[codes])
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.unit_ids.gather(codes), np.diff(upto)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return self.byte_flat[spread(self.byte_at[ids], self.byte_len[ids])].tobytes()

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; a character split between tokens belongs to each."""
        data = np.frombuffer(self.decode(ids), np.uint8)
        if not len(data):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.byte_len[ids])
        return char[ends - self.byte_len[ids]], char[ends - 1] + 1


class _Whole(str):
    """A text that is not cut."""


class _Numbers(dict):
    """Text -> number, given in the order of first sight; ``take`` hands out those not taken yet."""

    def __init__(self):
        self.fresh: list = []

    def __missing__(self, unit) -> int:
        self[unit] = code = len(self)
        self.fresh.append(unit)
        return code

    def take(self) -> list:
        out, self.fresh = self.fresh, []
        return out


class _Lists:
    """Lists of ids by number, end to end in one array that grows by doubling."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 12, np.int32), 0
        self.at, self.len = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, flat: np.ndarray, lens: np.ndarray) -> None:
        if not len(lens):
            return
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.at = np.concatenate([self.at, self.used + np.cumsum(lens) - lens])
        self.len = np.concatenate([self.len, lens])
        self.used += len(flat)

    def gather(self, codes: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.at[codes], self.len[codes])]


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run in a row (all below 2**31: a slice is some megabytes)."""
    ends = np.cumsum(lens)
    out = np.repeat((starts - (ends - lens)).astype(np.int32), lens)
    out += np.arange(len(out), dtype=np.int32)
    return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str | None = None, remembered: int = REMEMBERED, special: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file, made once."""
    key = path, pattern, remembered, special
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def encode(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, starts array<int>, ends array<int>): ids with character offsets, a row per row of ``docs``.

    Null and empty texts have no ids.  Rows that repeat a doc_id are rows of
    their own; texts of any length are handled a slice of rows at a time, and
    whole.  Other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path, pattern)
        ids, lens = enc.encode(batch.column("t"))
        ends = np.cumsum(lens)
        spans = [enc.offsets(ids[e - n : e]) for e, n in zip(ends, lens)]
        offs = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        lists = [ids, *(np.concatenate([s[k] for s in spans]) for k in (0, 1))]
        return pa.record_batch([batch.column("doc_id"), *(pa.ListArray.from_arrays(offs, pa.array(x.astype(np.int32))) for x in lists)], ["doc_id", "ids", "starts", "ends"])

    return common.map_slices(_rows(docs), run, "doc_id long, ids array<int>, starts array<int>, ends array<int>", "t", TEXTS)


def decode(encoded: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, text binary): the bytes of (doc_id, ids), a row per row; null or no ids give no bytes, other columns are ignored."""

    def run(batches):
        for batch in batches:
            enc = encoder(path, pattern)
            out = [enc.decode(np.asarray(x if x is not None else [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of the bytes they decode to.

    The same rules as ``encode``; ids do not leave the worker.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path, pattern)
        ids, lens = enc.encode(batch.column("t"))
        ends, decimal, rows = np.cumsum(lens), enc.decimal, []
        for e, n in zip(ends.tolist(), lens.tolist()):
            own = ids[e - n : e]
            rows.append((hashlib.sha256(" ".join([decimal[i] for i in own.tolist()]).encode()).hexdigest(), hashlib.sha256(enc.decode(own)).hexdigest()))
        return pa.record_batch([batch.column("doc_id"), pa.array(lens), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_slices(_rows(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "t", TEXTS)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
