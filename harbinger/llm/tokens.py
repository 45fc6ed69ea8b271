"""Token ids of whole texts by the public tokenizer files, through a bounded table of text pieces.

Both tokenizers never merge across a single space or line break between two characters that are not
white space, so a text can be cut there and each distinct piece needs to be encoded only once a worker.
Texts with other white space, or two such characters in a row, go to the library whole. Pieces are found by a hash and
then compared byte by byte; a text with a piece whose hash is another's goes to the library whole as well.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from harbinger.llm import bytescan

#: Pieces that one Python worker remembers; past this its table starts anew. Bounds memory, not results.
TABLE_PIECES = 2_500_000
JOIN_PIECES = 5_000

_KIND = (np.uint64(0), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class PieceEncoder:
    """Encodes texts as arrays of uint16 ids, equal to the library's result for the whole text."""

    def __init__(self, name: str, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer do not fit 16 bits")
        #: A tokenizer that keeps white space has a line break as a token of its own.
        self.spaced = self.plain("\n").size > 0
        self.mark = b"\n" if self.spaced else b"\x00"
        self.mark_id = int(self.plain(self.mark.decode())[0])
        self._forget()

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2")

    def _forget(self) -> None:
        self.keys, self.slot, self.at = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.size, self.flat = np.empty(0, np.int64), np.empty(0, "<u2")
        none = np.empty(0, np.int64)
        #: The bytes of each piece, and what stood before it.
        self.bytes, self.kind = bytescan.Blocks(np.empty(0, np.uint64), none, none, none, none), none

    def _learn(self, keys: np.ndarray, pieces: list[bytes], kinds: list[int], body: bytescan.Blocks, spans: np.ndarray) -> None:
        """Encodes new pieces, which are spans of body, many in one call, with a mark between them that is a token of its own."""
        sizes, flats = [np.empty(0, np.int64)], [np.empty(0, "<u2")]
        for lo in range(0, len(pieces), JOIN_PIECES):
            some = pieces[lo : lo + JOIN_PIECES]
            if self.spaced:
                text = b"".join([b"\n " + p if k == 0 else b"\n" + p for p, k in zip(some, kinds[lo : lo + JOIN_PIECES], strict=True)])
            else:
                text = self.mark + b" " + (b" " + self.mark + b" ").join(some)
            ids = self.plain(text.decode())
            cuts = np.flatnonzero(ids == self.mark_id)
            if cuts.size != len(some):  # a piece holds the mark's token in another guise
                found = [np.concatenate([[self.mark_id], self.plain((b" " + p if k == 0 and self.spaced else p).decode())]).astype("<u2") for p, k in zip(some, kinds[lo : lo + JOIN_PIECES], strict=True)]
                ids, cuts = np.concatenate(found), np.cumsum([0, *(f.size for f in found[:-1])])
            sizes.append(np.diff(cuts, append=ids.size))
            flats.append(ids[cuts[0] :])
        kind = np.array(kinds)
        keep_mark = self.spaced & (kind == 1)
        size, flat = np.concatenate(sizes), np.concatenate(flats)
        first = np.cumsum(size) - size + self.flat.size + ~keep_mark
        size = size - ~keep_mark
        # only keys and the pieces' numbers are kept in order; what is known of a piece is appended
        at = np.searchsorted(self.keys, keys)
        self.slot = np.insert(self.slot, at, np.arange(self.at.size, self.at.size + keys.size))
        self.keys = np.insert(self.keys, at, keys)
        both = lambda x, y: np.concatenate([x, y])
        self.at, self.size, self.flat = both(self.at, first), both(self.size, size), both(self.flat, flat)
        count, old = body.count[spans], self.bytes
        ends = np.cumsum(count)
        value = body.value[np.repeat(body.first[spans] - ends + count, count) + np.arange(int(count.sum()))]
        self.bytes = bytescan.Blocks(both(old.value, value), old.span, both(old.first, ends - count + old.value.size), both(old.count, count), both(old.size, body.size[spans]))
        self.kind = both(self.kind, kind)

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text has white space other than single spaces and line breaks inside it."""
        space = (data == 32) | (data == 10)
        bad = ((data < 32) & (data != 10)) | (data == 127)
        bad[1:] |= space[1:] & space[:-1]
        wide = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
        if wide.size:
            second, third = data[np.minimum(wide + 1, data.size - 1)], data[np.minimum(wide + 2, data.size - 1)]
            lead = data[wide]
            odd = (lead == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (lead == 0xE1) & ((second == 0x9A) | (second == 0xA0))
            odd |= (lead == 0xE2) & ((second == 0x80) & ((third <= 0x8F) | (third >= 0xA8) & (third <= 0xAF)) | (second == 0x81))
            odd |= (lead == 0xE3) & (second == 0x80) & (third == 0x80)
            bad[wide[odd]] = True
        n = offsets.size - 1
        out = np.zeros(n, bool)
        out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        out[full[space[offsets[full]] | space[offsets[full + 1] - 1]]] = True
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        data, offsets = bytescan.raw(texts)
        counts, parts = np.zeros(offsets.size - 1, np.int64), []
        for lo, hi in bytescan.passes(offsets):
            ids, n = self._encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            counts[lo:hi] = n
            parts.append(ids)
        return (np.concatenate(parts) if parts else np.empty(0, "<u2")), counts

    def _encode(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        n = offsets.size - 1
        if not data.size:
            return np.empty(0, "<u2"), np.zeros(n, np.int64)
        odd = self._odd(data, offsets) if odd is None else odd
        start, end, doc = bytescan.words(data, offsets)
        keep = ~odd[doc]
        keep_start, keep_end, keep_doc = start[keep], end[keep], doc[keep]
        kind = np.zeros(keep_start.size, np.int64)
        if self.spaced and keep_start.size:
            kind[data[np.maximum(keep_start - 1, 0)] == 10] = 1
            kind[keep_start == offsets[keep_doc]] = 2
        body = bytescan.blocks(data, keep_start, keep_end)
        key = bytescan.block_hashes(body) ^ np.array(_KIND, np.uint64)[kind]
        once, where, back = np.unique(key, return_index=True, return_inverse=True)
        length = np.zeros(once.size, np.int64)
        if once.size:
            if self.keys.size > TABLE_PIECES:
                self._forget()
            place = np.searchsorted(self.keys, once)
            known = np.zeros(once.size, bool)
            inside = place < self.keys.size
            known[inside] = self.keys[place[inside]] == once[inside]
            head = where[back]
            sound = (kind == kind[head]) & bytescan.same_spans(body, np.arange(back.size), body, head)
            had = np.flatnonzero(known)
            slot = self.slot[place[had]]
            other = (self.kind[slot] != kind[where[had]]) | ~bytescan.same_spans(body, where[had], self.bytes, slot)
            if other.any() or not sound.all():  # pieces that differ have one hash
                met = np.zeros(once.size, bool)
                met[had[other]] = True
                odd = odd.copy()
                odd[keep_doc[met[back] | ~sound]] = True
                return self._encode(data, offsets, odd)
            if not known.all():
                new = np.flatnonzero(~known)
                at = where[new]
                text = data.tobytes()
                pieces = [text[i:j] for i, j in zip(keep_start[at].tolist(), keep_end[at].tolist(), strict=True)]
                self._learn(once[new], pieces, kind[at].tolist(), body, at)
                place = np.searchsorted(self.keys, once)
            slot = self.slot[place]
            length, first = self.size[slot], self.at[slot]
            size_of, first_of = length[back], first[back]
            ends = np.cumsum(size_of)
            ids = self.flat[np.arange(ends[-1]) + np.repeat(first_of - ends + size_of, size_of)]
            counts = np.bincount(keep_doc, size_of, minlength=n).astype(np.int64)
        else:
            ids, counts = np.empty(0, "<u2"), np.zeros(n, np.int64)
        whole = np.flatnonzero(odd)
        if whole.size:
            split = np.split(ids, np.cumsum(counts)[:-1])
            for k in whole.tolist():
                split[k] = self.plain(data[offsets[k] : offsets[k + 1]].tobytes().decode())
                counts[k] = split[k].size
            ids = np.concatenate(split)
        return ids, counts


_ENCODERS: dict[tuple[str, str | None], tuple[str, PieceEncoder]] = {}


def encoder(name: str, path: str | None, run: str) -> PieceEncoder:
    """This worker's encoder of a tokenizer file; its table serves the tasks of one run, and another run starts anew."""
    known = _ENCODERS.get((name, path))
    if known is None or known[0] != run:
        known = _ENCODERS[name, path] = run, PieceEncoder(name, path)
    return known[1]
