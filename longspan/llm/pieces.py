"""A SentencePiece BPE model: its compiled character map, its merges, and its decoding.

Only what the file states is used: pieces with scores and kinds, the normaliser's flags and the
compiled character map (a double-array trie over UTF-8 bytes, followed by the texts it maps to).
"""

from __future__ import annotations

import heapq
import struct
from array import array
from collections.abc import Iterator

import numpy as np

#: Fixed values of the model file: kinds of piece, and the mark that stands for a space.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"
MARK = SPACE.encode()
#: Texts of a model file that decoding writes for unknown pieces and for broken bytes.
UNKNOWN_TEXT, BROKEN = " ⁇ ".encode(), "�".encode()
#: Segments longer than this are merged with a heap.
SHORT = 48


def fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else number()
            yield tag >> 3, blob[at : at + size]
            at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled character map; an empty one maps nothing."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = array("I", np.frombuffer(blob, "<u4", size // 4, 4).tolist()) if blob else array("I")
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of text[at:] and what replaces it."""
        units, found = self.units, None
        if not units:
            return None
        unit, node = units[0], 0
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        begin = found[1]
        return found[0], self.texts[begin : self.texts.index(b"\0", begin)]


def character(text: bytes, at: int) -> tuple[int, bytes]:
    """The character at a place; a byte that starts none stands as U+FFFD."""
    lead = text[at]
    size = 1 if lead < 128 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 0
    try:
        if size:
            text[at : at + size].decode()
            return size, text[at : at + size]
    except UnicodeDecodeError:
        pass
    return 1, BROKEN


class PieceModel:
    def __init__(self, blob: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        spec: dict = {}
        for number, value in fields(blob):
            if number == 1:
                own = dict(fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                self.pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                trainer.update(fields(value))
            elif number == 3:
                spec.update(fields(value))
        kinds = {kind for _, _, kind in self.pieces}
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE} or not spec.get(5, 1):
            raise ValueError("only BPE models with byte fallback, marked spaces and plain pieces can be read")
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.end_id = trainer.get(42, 2)
        self.unknown = next(k for k, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.ids = {text: k for k, (text, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.scores = {text: score for text, score, kind in self.pieces if kind == NORMAL}
        self.controls = {k for k, (_, _, kind) in enumerate(self.pieces) if kind == CONTROL}
        self.bytes = {int(text[1:-1], 16): k for k, (text, _, kind) in enumerate(self.pieces) if kind == BYTE}
        #: No piece crosses from text into a space mark, so runs that begin with marks are merged alone.
        self.parts_at_spaces = not any(SPACE in text.lstrip(SPACE) for text in self.ids)
        self._pair_table()
        shown = {NORMAL: lambda t: t.replace(SPACE, " ").encode(), BYTE: lambda t: bytes([int(t[1:-1], 16)]), CONTROL: lambda t: b"", UNKNOWN: lambda t: UNKNOWN_TEXT}
        self.shown = [shown[kind](text) for text, _, kind in self.pieces]

    # Normalising, with the source place of every byte

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end its place in the text."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze and valid(text):
            source = np.frombuffer(text, np.uint8)
            places = np.repeat(np.arange(len(source)), np.where(source == 32, len(MARK), 1))
            out = text.replace(b" ", MARK)
            lead = np.zeros(len(MARK) if self.prefix else 0, np.int64)
            return (MARK + out if self.prefix else out), np.concatenate([lead, places, [len(text)]])
        steps = self.replacements(text)
        out, places, at = bytearray(), array("q"), 0
        step = next(steps, None)
        while self.squeeze and step and step[1] == b" ":
            at += step[0]
            step = next(steps, None)
        if step is None:
            return b"", np.array([at], np.int64)
        if self.prefix:
            out += MARK
            places.extend([at] * len(MARK))
        spaced = self.squeeze
        while step:
            size, put = step
            if spaced:
                put = put.lstrip(b" ")
            if put:
                marked = put.replace(b" ", MARK)
                out += marked
                places.extend([at] * len(marked))
                spaced = self.squeeze and put.endswith(b" ")
            at += size
            step = next(steps, None)
        if self.squeeze:
            while out.endswith(MARK):
                del out[-len(MARK) :]
                at = places[len(out)]
                del places[len(out) :]
        places.append(at)
        return bytes(out), np.array(places, np.int64)

    def replacements(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        at = 0
        while at < len(text):
            size, put = self.map.longest(text, at) or character(text, at)
            yield size, put
            at += size

    # Merging

    def _pair_table(self) -> None:
        """Symbols are the pieces and the characters in them; every pair of symbols that joins to a
        piece is in a hash table of open addresses, filled to a fifth or less."""
        texts = [text for text, _, _ in self.pieces]
        symbols = dict(self.ids)
        for text in self.ids:
            for c in text:
                if c not in symbols:
                    symbols[c] = len(texts)
                    texts.append(c)
        self.symbols, self.texts = symbols, texts
        written = [self._written(t) if t in symbols else [0] for t in texts]
        self.ids_of = np.array([k for w in written for k in w], np.int64)
        self.n_ids = np.array([len(w) for w in written], np.int64)
        self.n_bytes = np.array([len(t.encode()) for t in texts], np.int64)
        pairs = {}
        for text, own in self.ids.items():
            for k in range(1, len(text)):
                a, b = symbols.get(text[:k]), symbols.get(text[k:])
                if a is not None and b is not None:
                    pairs[a << 21 | b] = own
        bits = max(10, (5 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.joined = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys, joined = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        at = self._slot(keys)
        while len(keys):
            # Of the keys that want one free slot one gets it; the others move on.
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]
            self.joined[at[free]] = joined[free]
            wait = self.keys[at] != keys
            keys, joined, at = keys[wait], joined[wait], (at[wait] + 1) & self.mask
        self.points = np.full(0x110000, -1, np.int32)
        for c, own in symbols.items():
            if len(c) == 1:
                self.points[ord(c)] = own
        self.value = np.array([score for _, score, _ in self.pieces], np.float32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _joins(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair of symbols joins to and its score (minus infinity: none)."""
        key = a.astype(np.int64) << 21 | b
        at = self._slot(key)
        found = self.keys[at]
        astray = np.flatnonzero((found != key) & (found >= 0))
        while len(astray):
            at[astray] = (at[astray] + 1) & self.mask
            found[astray] = self.keys[at[astray]]
            astray = astray[(found[astray] != key[astray]) & (found[astray] >= 0)]
        fits = found == key
        piece = np.where(fits, self.joined[at], 0)
        return piece, np.where(fits, self.value[piece], -np.inf)

    def _merged(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of symbols (padded), in each of which neighbours are joined by best score and then
        leftmost first until none fits; all rows take a step at a time."""
        rows, sizes, live = rows.copy(), sizes.copy(), np.arange(len(rows))
        width = rows.shape[1]
        scores = np.full((len(rows), width), -np.inf, np.float32)
        if width > 1:
            inside = np.arange(width - 1) < (sizes - 1)[:, None]
            r, c = np.nonzero(inside)
            scores[r, c] = self._joins(rows[r, c], rows[r, c + 1])[1]
        columns = np.arange(width)
        while len(live):
            at = scores.argmax(axis=1)
            some = scores[np.arange(len(live)), at] > -np.inf
            live, scores, at = live[some], scores[some], at[some]
            if not len(live):
                break
            own, line = rows[live], np.arange(len(live))
            own[line, at] = self._joins(own[line, at], own[line, at + 1])[0]
            # What lies behind the joined pair moves up by one.
            later = np.minimum(columns + (columns > at[:, None]), width - 1)
            own = np.take_along_axis(own, later, axis=1)
            scores = np.take_along_axis(scores, np.minimum(columns + (columns >= at[:, None]), width - 1), axis=1)
            sizes[live] -= 1
            scores[:, -1] = -np.inf
            rows[live] = own
            for place in (at - 1, at):
                fits = np.flatnonzero((place >= 0) & (place + 1 < sizes[live]))
                scores[fits, place[fits]] = self._joins(own[fits, place[fits]], own[fits, place[fits] + 1])[1]
                gone = np.flatnonzero((place >= 0) & (place + 1 >= sizes[live]))
                scores[gone, place[gone]] = -np.inf
        return rows, sizes

    def _merged_long(self, parts: list[str]) -> list[str]:
        last = len(parts)
        before, after = list(range(-1, last - 1)), list(range(1, last + 1))
        waiting: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < last and (value := self.scores.get(parts[a] + parts[b])) is not None:
                heapq.heappush(waiting, (-value, a, parts[a] + parts[b]))

        for k in range(last):
            offer(k)
        while waiting:
            _, a, joined = heapq.heappop(waiting)
            b = after[a]
            # An offer is stale once either side has changed.
            if b >= last or not parts[a] or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, ""
            after[a] = after[b]
            if after[b] < last:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [p for p in parts if p]

    def encoded(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the byte places in its segment where each piece begins and ends, of normalised
        segments one after the other, shortest first; the number of ids and of bytes of each.

        A character without a piece becomes the ids of its bytes; the last of them has its span."""
        lengths = np.array([len(s) for s in segments], np.int64)
        n_short = int(np.searchsorted(lengths, SHORT, "right"))
        extra: dict[str, int] = {}
        flat, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, n_short, 2048):
            lot = segments[start : min(n_short, start + 2048)]
            points = np.frombuffer("".join(lot).encode("utf-32-le"), "<u4")
            symbols = self.points[points]
            for k in np.flatnonzero(symbols < 0).tolist():
                symbols[k] = extra.setdefault(chr(points[k]), len(self.texts) + len(extra))
            sizes = lengths[start : start + len(lot)]
            rows = np.zeros((len(lot), max(1, int(sizes.max()))), np.int32)
            columns = np.arange(rows.shape[1])
            rows[columns < sizes[:, None]] = symbols
            rows, left = self._merged(rows, sizes)
            flat.append(rows[columns < left[:, None]])
            counts.append(left)
        for segment in segments[n_short:]:
            parts = self._merged_long(list(segment))
            flat.append(np.array([self.symbols[p] if p in self.symbols else extra.setdefault(p, len(self.texts) + len(extra)) for p in parts], np.int64))
            counts.append([len(parts)])
        code, parts = np.concatenate(flat), np.concatenate(counts)
        more = [self._written(text) for text in extra]
        ids_of = np.concatenate([self.ids_of, *[np.array(w, np.int64) for w in more]])
        n_ids = np.concatenate([self.n_ids, np.array([len(w) for w in more], np.int64)])
        n_bytes = np.concatenate([self.n_bytes, np.array([len(t.encode()) for t in extra], np.int64)])
        first = np.cumsum(n_ids) - n_ids
        each, size = n_ids[code], n_bytes[code]
        upto = np.concatenate([[0], np.cumsum(parts)])
        width_upto, id_upto = (np.concatenate([[0], np.cumsum(x)])[upto] for x in (size, each))
        widths, n = np.diff(width_upto), np.diff(id_upto)
        ends = np.cumsum(size) - np.repeat(width_upto[:-1], parts)
        if (each == 1).all():
            return ids_of[first[code]], ends - size, ends, n, widths
        within = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        begins = np.repeat(ends - size, each)
        last = within == np.repeat(each, each) - 1
        return ids_of[np.repeat(first[code], each) + within], begins, np.where(last, np.repeat(ends, each), begins), n, widths

    def _written(self, symbol: str) -> list[int]:
        """The piece of a symbol, or else the ids of its bytes."""
        return [self.ids[symbol]] if symbol in self.ids else [self.bytes[b] for b in symbol.encode()]

    # Decoding

    def decoded(self, ids: list[int]) -> bytes:
        """The text of ids: marks as spaces, but for one that opens the text, and bytes joined."""
        ids = list(ids)
        while ids and ids[-1] in self.controls:
            ids.pop()
        out = b"".join(map(self.shown.__getitem__, ids))
        # A control mark parts the bytes on its two sides.
        if not valid(out) or not self.controls.isdisjoint(ids):
            out = self._with_broken_bytes(ids)
        first = next((k for k in ids if k not in self.controls), None)
        opened = first is not None and self.pieces[first][2] == NORMAL and (self.prefix or self.squeeze)
        return out[1:] if opened and out.startswith(b" ") else out

    def _with_broken_bytes(self, ids: list[int]) -> bytes:
        out, run = bytearray(), bytearray()

        def close() -> None:
            at = 0
            while at < len(run):
                size, put = character(bytes(run), at)
                out.extend(put)
                at += size
            run.clear()

        for k in ids:
            if self.pieces[k][2] == BYTE:
                run.extend(self.shown[k])
            else:
                close()
                out.extend(self.shown[k])
        close()
        return bytes(out)


def valid(text: bytes) -> bool:
    try:
        text.decode()
        return True
    except UnicodeDecodeError:
        return False
