"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

Base spans come from three patterns over the whole text. The field tags every token of every text
(runs of letters, digits and a few marks, or single other characters) as outside, begin or inside
of a secret. It sees a token's shape, its neighbours' words and shapes, and features of the whole
text, and is decoded by Viterbi. A tagged run that overlaps no base span is added.

A score is a sum over the token, its neighbours and the text, so it is looked up by distinct token
and added up in arrays; Viterbi runs over stretches of a block side by side, and two blank tokens
part the texts of a batch.

The field is trained on base spans as labels, over a bounded sample: windows of 32 tokens from about
`fit_docs` texts by a hash of the text, all that hold a label and `others` of the rest from each
text, by a hash of their place in the whole text. Equal windows count once, and at most `windows` of
either kind, by hash, reach the driver. That is the documented bound.

Defined cases: null and empty texts have no spans. Without a labelled window in the sample the
field adds nothing. Repeated rows each give a row; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from longspan.llm.batches import slices, texts
from longspan.sources.stages import stage

KINDS = ("assign", "access", "hex", "tagged")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
HEX_MAP = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
HEX_RUN = b"h" * LEAST["hex"]

TOKEN = re.compile(rb"[A-Za-z0-9+/_.\x80-\xff-]+|[^\sA-Za-z0-9+/_.\x80-\xff-]")
#: Digit, upper case, lower case, beyond ASCII, other.
CLASSES = bytes(ord("d" if 48 <= c < 58 else "u" if 65 <= c < 91 else "l" if 97 <= c < 123 else "x" if c > 127 else "s") for c in range(256))
TURN = re.compile(rb"d+|u+|l+|x+|s+")
#: Longest word that is a feature by itself; of longer tokens the shape says more.
WORD = 24
WINDOW = 32
#: Tokens scored at a time, and steps that run one after the other in them.
BLOCK, STEPS = 1 << 16, 128
#: Distinct tokens and patterns of kinds that are kept, of no more bytes than `SHORT`.
KNOWN, SHORT = 1 << 16, 32
#: Bytes of a text that are cut into tokens at a time, to the next white space.
CUT, GAP = 1 << 18, re.compile(rb"\s")
HEXED = b"0123456789abcdef"
NEVER = -1e4
OUTSIDE, BEGIN, INSIDE = range(3)
Span = tuple[int, int]


def base_spans(text: bytes) -> list[tuple[str, Span, Span]]:
    """(kind, whole match, the secret in it) in bytes, leftmost and non-overlapping by kind."""
    found = []
    lower = text.lower()
    if any(n in lower for n in NAMES):
        found += [("assign", m.span(), m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if b"AKIA" in text:
        found += [("access", m.span(), m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if HEX_RUN in text.translate(HEX_MAP):
        found += [("hex", m.span(), m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return found


def shape(token: bytes) -> str:
    """Length class, kinds of characters, how often they change, and whether all are hexadecimal."""
    kinds = token.translate(CLASSES)
    size = min(len(token).bit_length(), 7) if len(token) < 20 else 8 + min(len(token) // 8, 8)
    turns = sum(1 for _ in islice(TURN.finditer(kinds), 8)) - 1
    hexed = token.translate(HEX_MAP).count(b"h") == len(token)
    return f"{size}|{''.join(sorted(set(kinds.decode())))}|{turns}|{int(hexed)}"


def sign(token: bytes) -> str:
    """All that features need of a token: shape, first letters, and the word if it is short."""
    word = token.lower().decode("latin1") if len(token) <= WORD else ""
    return f"{shape(token)}\t{token[:4].decode('latin1')}\t{word}"


def file_features(text: bytes) -> list[str]:
    size = max(len(text), 1)
    marks = sum(text.count(m) for m in (b"=", b":", b"_", b"{", b";"))
    return [f"f:size{size.bit_length() // 2}", f"f:marks{min(int(200 * marks / size), 8)}"]


def named(sign: str) -> tuple[str, list[list[str]]]:
    """Kinds of a token, and the features it gives to itself, the next, the one after, and the one before."""
    form, head, word = sign.split("\t")
    size, kinds, turns, hexed = form.split("|")
    own = ["", "s:" + form, "n:" + size, "k:" + kinds, "t:" + kinds + turns, "h:" + hexed + size, "a:" + head]
    return kinds, [own, *[[f"w{at}:" + word, f"p{at}:" + form] for at in ("1", "2", "+")]]


def features(signs: list[str], first: int, last: int, whole: list[str]) -> list[list[str]]:
    """Features of the tokens from `first` up to `last`; those around them are only neighbours."""
    each = [named(s) for s in signs]
    rows = []
    for k in range(first, last):
        kinds, (row, *_) = each[k]
        row = row + [f + kinds for f in whole]
        for at, other in enumerate((k - 1, k - 2, k + 1), 1):
            if 0 <= other < len(each):
                row += each[other][1][at]
        rows.append(row)
    return rows


def tags_of(spans: list[Span], secrets: list[Span]) -> np.ndarray:
    """Labels of tokens from spans of secrets."""
    tags = np.zeros(len(spans), np.int32)
    if secrets:
        starts, ends = np.array(spans).T
        for a, b in secrets:
            first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            if first < last and not tags[first:last].any():
                tags[first], tags[first + 1 : last] = BEGIN, INSIDE
    return tags


Window = tuple[list[str], int, list[str], list[int]]


def windows_of(text: bytes, others: int) -> list[Window]:
    """(signs with two before and one after, place of the first, features of the text, tags) of windows to learn."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    tags = tags_of(spans, [s for _, _, s in base_spans(text)])
    count = -(-len(spans) // WINDOW)
    starts = np.arange(count) * WINDOW
    labelled = np.add.reduceat(tags, starts) > 0 if count else np.zeros(0, bool)
    spot = (np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(crc32(text))) * np.uint64(0xD6E8FEB86659FD93)
    rest = np.flatnonzero(~labelled)
    picked = rest[np.argsort(spot[rest] >> np.uint64(32), kind="stable")[:others]]
    whole = file_features(text)
    found = []
    for w in sorted([*np.flatnonzero(labelled), *picked]):
        first, last = int(starts[w]), min(int(starts[w]) + WINDOW, len(spans))
        lead = max(first - 2, 0)
        around = [sign(text[a:b]) for a, b in spans[lead : last + 1]]
        found.append((around, first - lead, whole, [BEGIN if t == INSIDE and not k else int(t) for k, t in enumerate(tags[first:last])]))
    return found


class Field:
    """Weights by feature and tag, and of tag pairs. What lies around a text is outside."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], pairs: np.ndarray):
        self.weights, self.pairs = weights, np.asarray(pairs, np.float64)

    def sum(self, names: list[str]) -> list[float]:
        own = [0.0, 0.0, 0.0]
        for name in names:
            if w := self.weights.get(name):
                own = [a + b for a, b in zip(own, w)]
        return own

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Best tags of one sequence."""
        own = np.array([self.sum(r) for r in rows] + [[0.0, NEVER * 9, NEVER * 9]])
        back, _ = forward(own, self.pairs, np.array([0.0, NEVER, NEVER]))
        return backward(back)[:-1].tolist()


def forward(own: np.ndarray, pairs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tag before each token and tag, and the scores after the last token.

    Tokens are cut into stretches of `STEPS`. What a stretch does to any state is found for all
    stretches side by side, then the states between them in turn, then all steps side by side.
    """
    count = len(own)
    lots = -(-count // STEPS)
    if lots * STEPS > count:
        # Blank steps at the end, of which nothing is kept.
        own = np.concatenate([own, np.zeros((lots * STEPS - count, 3))])
    own = own.reshape(lots, STEPS, 3)
    passed = [np.tile(row, (lots, 1)) for row in np.where(np.eye(3, dtype=bool), 0.0, 100 * NEVER)]
    for t in range(STEPS):
        passed = [np.maximum(np.maximum(passed[0] + pairs[0, q], passed[1] + pairs[1, q]), passed[2] + pairs[2, q]) + own[:, t, q, None] for q in range(3)]
    through = np.stack(passed, 2)  # lot, state before, state after
    states = np.empty((lots, 3))
    for k in range(lots):
        states[k] = state
        state = (state[:, None] + through[k]).max(0)
        state = state - state.max()
    back = np.empty((lots, STEPS, 3), np.uint8)
    now, last = list(states.T), (count - 1) % STEPS
    for t in range(STEPS):
        new = []
        for q in range(3):
            a, b, c = (now[p] + pairs[p, q] for p in range(3))
            top = np.maximum(a, b)
            back[:, t, q] = np.where(c > top, 2, b > a)
            new.append(np.maximum(top, c) + own[:, t, q])
        now = new
        if t == last:
            ended = np.array([now[q][-1] for q in range(3)])
    return back.reshape(-1, 3)[:count], ended - ended.max()


def backward(back: np.ndarray) -> np.ndarray:
    """Tags by the best tags before; the last token is outside."""
    came, tag = back.tobytes(), OUTSIDE
    tags = bytearray(len(back))
    for t in range(len(back) - 1, -1, -1):
        tags[t] = tag
        tag = came[3 * t + tag]
    return np.frombuffer(tags, np.uint8)


class Known(dict):
    """Number of each token met, in the order of their places."""

    def __init__(self, place: Callable[[bytes], tuple[int, int, int]]):
        super().__init__({None: 0})
        self.place, self.places = place, [(0, 0, 0)]

    def __missing__(self, token: bytes) -> int:
        at = len(self.places)
        self.places.append(self.place(token))
        if len(token) <= SHORT:
            self[token] = at
        return at


def cut(text: bytes) -> Iterator[list[bytes]]:
    """Tokens of a text, a part of it at a time."""
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + CUT)
        end = gap.start() if gap else len(text)
        yield TOKEN.findall(text, start, end)
        start = end


class Tagger:
    """Tagged runs of many texts.

    What a token gives to the scores of itself, the next, the one after and the one before depends
    on its shape, its first letters and its word, so there is a table for each of the three, and a
    token is three places in them. The places of short tokens are kept from batch to batch.
    """

    def __init__(self, field: Field):
        self.field = field
        self.words: dict[bytes, int] = {}
        self.heads: dict[bytes, int] = {}
        for name in field.weights:
            if name[:3] in ("w1:", "w2:", "w+:"):
                self.words.setdefault(name[3:].encode("latin1"), len(self.words) + 1)
            elif name[:2] == "a:":
                self.heads.setdefault(name[2:].encode("latin1"), len(self.heads) + 1)
        self.of_word = np.zeros((len(self.words) + 1, 12))
        for word, k in self.words.items():
            self.of_word[k, 3:] = [x for at in ("w1:", "w2:", "w+:") for x in field.sum([at + word.decode("latin1")])]
        self.of_head = np.zeros((len(self.heads) + 1, 3))
        for head, k in self.heads.items():
            self.of_head[k] = field.sum(["a:" + head.decode("latin1")])
        # The first shape is that of a blank token, which is outside and gives nothing.
        self.shapes: dict[str, int] = {"": 0}
        self.of_shape = [[0.0, 9 * NEVER, 9 * NEVER] + [0.0] * 9]
        self.kinds, self.kind_names = [0], {"": 0}
        self.files: dict[tuple[str, ...], int] = {(): 0}
        self.forget()

    def forget(self) -> None:
        self.known = Known(self.place)
        self.patterns: dict[tuple[bytes, bool], int] = {}

    def shape(self, token: bytes) -> int:
        short = len(token) <= SHORT
        key = (token.translate(CLASSES), not token.translate(None, HEXED)) if short else (b"", False)
        if short and (at := self.patterns.get(key)) is not None:
            return at
        form = shape(token)
        if (at := self.shapes.get(form)) is None:
            kinds, (own, *others) = named(form + "\t\t")
            at = self.shapes[form] = len(self.of_shape)
            lots = [[n for n in own if n[:2] != "a:"], *[names[1:] for names in others]]
            self.of_shape.append([x for names in lots for x in self.field.sum(names)])
            self.kinds.append(self.kind_names.setdefault(kinds, len(self.kind_names)))
        if short:
            self.patterns[key] = at
        return at

    def place(self, token: bytes) -> tuple[int, int, int]:
        word = token.lower() if len(token) <= WORD else b""
        return self.shape(token), self.heads.get(token[:4], 0), self.words.get(word, 0)

    def scores(self, tokens: list[bytes | None], files: np.ndarray) -> np.ndarray:
        """Scores of all tokens but the first two and the last."""
        number = np.array(list(map(self.known.__getitem__, tokens)))
        shapes, heads, words = np.array(self.known.places, np.int32)[number].T
        given = np.array(self.of_shape)[shapes] + self.of_word[words]
        own = given[2:-1, :3] + given[1:-2, 3:6] + given[:-3, 6:9] + given[3:, 9:] + self.of_head[heads[2:-1]]
        pairs, which = np.unique(files[2:-1] * len(self.kinds) + np.array(self.kinds)[shapes[2:-1]], return_inverse=True)
        names, kinds = list(self.files), list(self.kind_names)
        whole = [self.field.sum([f + kinds[p % len(self.kinds)] for f in names[p // len(self.kinds)]]) for p in pairs.tolist()]
        if len(self.known.places) + len(self.patterns) > KNOWN:
            self.forget()
        return own + np.array(whole)[which]

    def tags(self, lot: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Tags of the tokens of all texts, with two blank ones after each, and where each text begins."""
        tokens: list[bytes | None] = [None, None]
        files, backs, firsts, done = [0, 0], [], [], 0
        state = np.array([0.0, NEVER, NEVER])

        def decode(least: int) -> None:
            nonlocal tokens, files, state, done
            while len(tokens) - 3 >= least:
                size = min(BLOCK, len(tokens) - 3)
                back, state = forward(self.scores(tokens[: size + 3], np.array(files[: size + 3])), self.field.pairs, state)
                backs.append(back)
                tokens, files, done = tokens[size:], files[size:], done + size

        for text in lot:
            firsts.append(done + len(tokens) - 2)
            file = self.files.setdefault(tuple(file_features(text)), len(self.files))
            for part in cut(text):
                tokens += part
                files += [file] * len(part)
                decode(BLOCK)
            tokens += [None, None]
            files += [0, 0]
        tokens.append(None)
        files.append(0)
        decode(1)
        return backward(np.concatenate(backs)) if backs else np.zeros(0, np.uint8), firsts

    def runs(self, lot: list[bytes]) -> list[list[Span]]:
        """Tagged runs of each text, in bytes."""
        tags, firsts = self.tags(lot)
        hits = np.flatnonzero(tags)
        runs: list[list[Span]] = [[] for _ in lot]
        ends = [*firsts[1:], len(tags)]
        for owner in np.unique(np.searchsorted(firsts, hits, "right") - 1).tolist():
            for match, tag in zip(TOKEN.finditer(lot[owner]), tags[firsts[owner] : ends[owner]].tolist()):
                if tag == INSIDE and runs[owner]:
                    runs[owner][-1] = (runs[owner][-1][0], match.end())
                elif tag != OUTSIDE:
                    runs[owner].append(match.span())
        return runs


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(sequences: list[tuple[list[list[str]], list[int]]], rounds: int = 80, ridge: float = 1e-3) -> Field | None:
    """Maximum likelihood by forward and backward sums, over all sequences at once."""
    sequences = [s for s in sequences if s[1]]
    if not any(BEGIN in tags for _, tags in sequences):
        return None
    seen = Counter(name for rows, _ in sequences for row in rows for name in row)
    names = {n: k for k, n in enumerate(sorted(n for n, c in seen.items() if c > 1))}
    size, longest = len(sequences), max(len(t) for _, t in sequences)
    at_token, at_feature, tags = [], [], np.zeros((longest, size), np.int64)
    lengths = np.array([len(t) for _, t in sequences])
    for i, (rows, own) in enumerate(sequences):
        for t, row in enumerate(rows):
            tags[t, i] = own[t]
            known = [names[n] for n in row if n in names]
            at_feature += known
            at_token += [t * size + i] * len(known)
    at_token, at_feature = np.array(at_token), np.array(at_feature)
    live = np.arange(longest)[:, None] < lengths
    gold_pairs = np.zeros((3, 3))
    previous = np.vstack([np.zeros((1, size), np.int64), tags[:-1]])
    np.add.at(gold_pairs, (previous[live], tags[live]), 1)
    np.add.at(gold_pairs, (tags[lengths - 1, np.arange(size)], OUTSIDE), 1)
    gold = np.zeros((len(names), 3))
    np.add.at(gold, (at_feature, tags.reshape(-1)[at_token]), 1)
    weight, pairs = np.zeros((len(names), 3)), np.zeros((3, 3))
    barred = np.zeros((3, 3))
    barred[OUTSIDE, INSIDE] = NEVER
    slopes = [np.zeros_like(weight), np.zeros_like(pairs)]
    squares = [np.zeros_like(weight), np.zeros_like(pairs)]
    for r in range(1, rounds + 1):
        own = np.stack([np.bincount(at_token, weight[at_feature, k], longest * size) for k in range(3)], -1).reshape(longest, size, 3)
        step = pairs + barred
        ahead = np.zeros((longest, size, 3))
        state = np.where(np.arange(3) == OUTSIDE, 0.0, -1e4) * np.ones((size, 1))
        for t in range(longest):
            state = np.where(live[t][:, None], log_sum(state[:, :, None] + step, 1) + own[t], state)
            ahead[t] = state
        total = log_sum(state + step[:, OUTSIDE], 1)
        behind = np.zeros((longest, size, 3))
        state = np.ones((size, 1)) * step[:, OUTSIDE]
        expected_pairs = (np.exp(ahead[-1] + step[:, OUTSIDE] - total[:, None])).sum(0)
        pair_sum = np.zeros((3, 3))
        pair_sum[:, OUTSIDE] += expected_pairs
        for t in range(longest - 1, -1, -1):
            behind[t] = state
            here = live[t]
            before = ahead[t - 1] if t else np.where(np.arange(3) == OUTSIDE, 0.0, -1e4) * np.ones((size, 1))
            joint = before[:, :, None] + step + (own[t] + state)[:, None, :]
            pair_sum += np.exp(joint[here] - total[here][:, None, None]).sum(0)
            state = np.where(here[:, None], log_sum(step + (own[t] + state)[:, None, :], 2), state)
        chance = np.exp(ahead + behind - total[:, None]) * live[:, :, None]
        flat = chance.reshape(-1, 3)
        expected = np.stack([np.bincount(at_feature, flat[at_token, k], len(names)) for k in range(3)], -1)
        for j, (value, pull) in enumerate(((weight, expected - gold), (pairs, pair_sum - gold_pairs))):
            pull = pull / size + ridge * value
            slopes[j] = 0.9 * slopes[j] + 0.1 * pull
            squares[j] = 0.99 * squares[j] + 0.01 * pull * pull
            move = slopes[j] / (1 - 0.9**r) / (np.sqrt(squares[j] / (1 - 0.99**r)) + 1e-8)
            value -= 0.15 * (1 - (r - 1) / rounds) * move
    return Field({n: tuple(weight[k].tolist()) for n, k in names.items()}, pairs + barred)


def fit(docs: DataFrame, fit_docs: int, others: int, windows: int) -> Field | None:
    rows = docs.count()
    spot = F.shiftrightunsigned(F.xxhash64("text", F.lit(7)), 11) / float(1 << 53)
    sample = texts(docs).where(F.col("text").isNotNull() & (spot < float(fit_docs) / max(rows, 1)))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [w for text in part.column(1).to_pylist() for w in windows_of(text, others)]
            signs, first, whole, tags = (list(x) for x in zip(*found)) if found else ([], [], [], [])
            yield pa.RecordBatch.from_pydict(
                {
                    "signs": pa.array(signs, pa.list_(pa.string())),
                    "first": pa.array(first, pa.int32()),
                    "whole": pa.array(whole, pa.list_(pa.string())),
                    "tags": pa.array(tags, pa.list_(pa.int32())),
                }
            )

    kinds = "signs array<string>, first int, whole array<string>, tags array<int>"
    found = stage(sample.mapInArrow(learned, kinds).distinct().withColumn("pick", F.xxhash64("signs", "whole")), "windows")
    labelled = F.array_contains("tags", BEGIN)
    lots = []
    for kind in (labelled, ~labelled):
        lots += found.where(kind).orderBy("pick", "signs", "whole", "tags").limit(windows).collect()
    return train([(features(r.signs, r["first"], r["first"] + len(r.tags), r.whole), r.tags) for r in lots])


def points(text: bytes, spans: list[tuple[str, Span]]) -> list[tuple[str, int, int]]:
    """Spans in code points instead of bytes."""
    if not spans or text.isascii():
        return [(kind, a, b) for kind, (a, b) in spans]
    begins = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(kind, int(begins[a]), int(begins[b])) for kind, (a, b) in spans]


def scan(lot: list[bytes | None], tagger: Tagger | None) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of all spans of each text, by start and then kind."""
    lot = [text or b"" for text in lot]
    runs = tagger.runs(lot) if tagger else [[] for _ in lot]
    found = []
    for text, tagged in zip(lot, runs):
        spans = [(kind, span) for kind, span, _ in base_spans(text)]
        base = [span for _, span in spans]
        spans += [("tagged", (x, y)) for x, y in tagged if all(y <= a or b <= x for a, b in base)]
        found.append(sorted(points(text, spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
    return found


def secrets(docs: DataFrame, fit_docs: int = 5000, others: int = 1, windows: int = 2500) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) for each row."""
    field = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_docs, others, windows))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field.value) if field.value is not None else None
        for part in slices(batches):
            found = scan(part.column(1).to_pylist(), tagger)
            lots = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "spans": pa.array(lots, kind)})

    return texts(docs).mapInArrow(scanned, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>")
