"""Byte-level BPE encoding and decoding, exact to the tokenizers library.

Texts are cut where the vocabulary's pre-tokenizer always cuts, before a single
space, and each distinct piece of a batch is encoded once. A long unsplit piece is encoded by tree
concatenation: its halves are encoded in parallel, and a window around the join
is encoded again and grows until both sides agree. They agree when the tokens
next to each other at both edges of the window encode to themselves as a pair;
with every adjacent pair so, no merge can cross a token's border, and the
sequence is the encoding of the whole."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one direct encoding takes at most; longer pieces go through the tree.
LEAF = 1024


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies print for each byte: itself if
    it is visible in Latin-1, else the next free code point from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in seen}
    for b in range(256):
        if b not in seen:
            letters[chr(256 + len(letters) - len(seen))] = b
    return letters


def _checked(spec: dict) -> None:
    """Refuse files whose texts are changed or split in another way than here."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    right = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    right = right and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    right = right and not any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"])
    if not right:
        raise ValueError("only plain byte-level BPE files, split by the ByteLevel pattern, are supported")


class Codec:
    """One vocabulary file (plain byte-level BPE in the tokenizers format; others are refused)."""

    def __init__(self, path: str, leaf: int = LEAF):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _checked(spec)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        letters = _byte_letters()
        specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in specials}
        self.bytes_of |= {i: t.encode() for t, i in specials.items()}
        self.specials = specials
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self._lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self._lengths[i] = len(b)
        # The pieces that merge in this order are those of the file's merges.
        merged = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        order = {"".join(m): r for r, m in enumerate(merged)}
        vocab = spec["model"]["vocab"]
        single = [t for t in vocab if len(t) == 1 and t in letters]
        ranks = {bytes([letters[t]]): r for r, t in enumerate(single)}
        ranks |= {bytes(letters[c] for c in t): len(single) + r for t, r in order.items()}
        to_id = [vocab[t] for t in [*single, *order]]
        self._ids = None if to_id == list(range(len(to_id))) else np.array(to_id)
        if len(order) != len(merged) or len(ranks) != len(to_id):
            raise ValueError("two merges make the same token; ranks can't name them")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf = leaf

    # -- one unsplit piece ------------------------------------------------
    def _direct(self, piece: bytes) -> list[int]:
        ids = self._core._encode_single_piece(piece)
        return ids if self._ids is None else self._ids[ids].tolist()

    def _joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two adjacent byte strings from theirs."""
        if not left or not right:
            return left + right
        size = 1
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            window = self._direct(b"".join(self.bytes_of[t] for t in [*left[i:], *right[:j]]))
            low = i == 0 or self._direct(self.bytes_of[left[i - 1]] + self.bytes_of[window[0]]) == [left[i - 1], window[0]]
            high = j == len(right) or self._direct(self.bytes_of[window[-1]] + self.bytes_of[right[j]]) == [window[-1], right[j]]
            if low and high:
                return [*left[:i], *window, *right[j:]]
            size *= 2

    def piece(self, piece: bytes, pool: ThreadPoolExecutor | None = None) -> list[int]:
        """Ids of one piece that the pre-tokenizer leaves whole."""
        if len(piece) <= self.leaf:
            return self._direct(piece)
        leaves = [piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)]
        parts = list((pool.map if pool else map)(self._direct, leaves))
        while len(parts) > 1:
            pairs = [(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            tail = parts[len(pairs) * 2 :]
            parts = [*(pool.map if pool else map)(lambda p: self._joined(*p), pairs), *tail]
        return parts[0]

    # -- a whole text -----------------------------------------------------
    def encode(self, text: str) -> list[int]:
        """As encode(text, add_special_tokens=False).ids of the library."""
        ids: list[int] = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.specials:
                ids.append(self.specials[part])
            elif not _long(self.leaf).search(part):
                ids += self._ordinary(part) if not _UNUSUAL.search(part) else self.whole.encode(part, add_special_tokens=False).ids
            else:
                with ThreadPoolExecutor(2) as pool:
                    for p in self.pre_tokens(part):
                        ids += self.piece(p.encode(), pool)
        return ids

    def pre_tokens(self, text: str) -> list[str]:
        """Pieces that are encoded apart; they make up the text."""
        out: list[str] = []
        for part in self._special.split(text) if self._special else [text]:
            out += [part] if part in self.specials else [part[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _ordinary(self, text: str) -> list[int]:
        ids = self._core.encode_ordinary(text)
        return ids if self._ids is None else self._ids[ids].tolist()

    def _match(self, texts: pa.Array, usual: str) -> np.ndarray:
        out = pc.match_substring_regex(texts, usual).to_numpy(zero_copy_only=False)
        for mark in self.specials:
            out = out & ~pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        return out

    # -- many texts ---------------------------------------------------------
    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, bool]:
        """Distinct pieces of all texts, the piece at each place of the texts in
        turn, the number of places of each text, and whether all texts were usual. A text in usual characters
        with single spaces is cut before each space; any other one as the
        library's pre-tokenizer cuts it."""
        odd = ~self._match(texts, _USUAL)
        cut = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        chunks, at = cut.flatten(), np.diff(cut.offsets.to_numpy())
        if len(chunks):
            at = np.concatenate([[0], np.cumsum(at)[:-1]])
            first = np.zeros(len(chunks), bool)
            first[at] = True
            spaced = pc.binary_join_element_wise(pa.scalar("", chunks.type), chunks.filter(pa.array(~first)), pa.scalar(" ", chunks.type))
            values = pa.concat_arrays([chunks.filter(pa.array(first)), spaced])
            place = np.empty(len(chunks), np.int64)
            place[np.concatenate([np.flatnonzero(first), np.flatnonzero(~first)])] = np.arange(len(chunks))
        else:
            values, place = chunks, np.zeros(0, np.int64)
        count = np.zeros(len(texts), np.int64)
        count[~odd] = np.diff(cut.offsets.to_numpy())
        if odd.any():
            own = [self.pre_tokens(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            count[odd] = [len(x) for x in own]
            begins = np.concatenate([[0], np.cumsum(count)])
            usual = np.repeat(~odd, count)
            places = np.empty(begins[-1], np.int64)
            places[usual], places[~usual] = place, len(values) + np.arange((~usual).sum())
            values, place = pa.concat_arrays([values, pa.array([p for x in own for p in x], values.type)]), places
        coded = values.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy()[place], count, not odd.any()

    def encode_pieces(self, pieces: pa.Array, usual: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after the other, and how many each has.
        usual: they were cut from usual texts."""
        odd = ~(pc.starts_with(pieces, " ").to_numpy(zero_copy_only=False) if usual else self._match(pieces, _USUAL_PIECE)) | (pc.binary_length(pieces).to_numpy() > self.leaf)
        plain = pieces.filter(pa.array(~odd))
        # Usual pieces start with a space and have no other: side by side they are cut where they meet.
        ids = np.asarray(self._ordinary("".join(plain.to_pylist())) if len(plain) else [], np.int64)
        ends = np.cumsum(pc.binary_length(plain).to_numpy())
        last = np.searchsorted(np.cumsum(self._lengths[ids]), ends, "left") + 1
        counts = np.zeros(len(pieces), np.int64)
        counts[~odd] = np.diff(last, prepend=0)
        if odd.any():
            own = [self.encode(p) for p in pieces.filter(pa.array(odd)).to_pylist()]
            counts[odd] = [len(x) for x in own]
            out, from_odd = np.empty(counts.sum(), np.int64), np.repeat(odd, counts)
            out[~from_odd], out[from_odd] = ids, [i for x in own for i in x]
            ids = out
        return ids.astype("<u4"), counts

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        distinct, place, count, usual = self.pieces(texts)
        ids, sizes = self.encode_pieces(distinct, usual)
        begins, each = np.cumsum(sizes) - sizes, sizes[place]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        out = ids[np.repeat(begins[place] - (ends - each), each) + np.arange(total)]
        per = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        return out, np.diff(per)

    def decode(self, ids: Sequence[int]) -> str:
        """As decode(ids, skip_special_tokens=False) of the library."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


#: Characters on whose classes the two libraries may differ (Unicode versions).
_UNUSUAL = re.compile("[^\x00-\u024f]")
#: Texts that are cut at spaces: words of usual visible characters, single spaces and line ends between them.
_VISIBLE = r"[\x21-\x7e\x{a1}-\x{24f}]+"
_USUAL = rf"\A{_VISIBLE}(?:[ \n]{_VISIBLE})*\z"
#: Pieces of them that can be encoded side by side.
_USUAL_PIECE = rf"\A {_VISIBLE}(?:\n{_VISIBLE})*\z"


@lru_cache(4)
def _long(leaf: int) -> re.Pattern:
    """A run that the pre-tokenizer may leave whole and that is over the leaf."""
    return re.compile(rf"\S{{{leaf + 1}}}|\s{{{leaf + 1}}}")


@lru_cache(2)
def codec(path: str) -> Codec:
    """The worker's codec of a file; path is a name that public_tokenizers
    knows or a file on every machine."""
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Codec(path)
