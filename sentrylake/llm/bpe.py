"""BPE encoding and decoding with a token automaton.

The merges are compiled one after the other into a deterministic automaton over tokens that accepts exactly the
sequences BPE produces. It starts as one universal state. The gadget for a merge (u, v) -> w

* adds an arc w to every state that has the arc u (where u may be followed by v), ending where v ends;
* gives the arc u a new end: a copy of its old end without the arc v (and, when u = v, without w).

All arcs with one label end in one state, so the automaton is a label -> state table. A state's arcs are the arcs of
the state it was copied from, minus the one removed at the copy, plus those added later; an arc added later is there
just when its left part is. So an arc is missing where a copy that removed it, or the left part it had when that part was
removed, is an ancestor; copies form a tree, and intervals of its nodes decide that by binary search. The decided
transitions are kept in a table. A word has one accepting path; it is found by walking the vocabulary trie from each
position reached. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sentrylake.llm.common import add_columns, small_parts, tidy, with_fields
from sentrylake.llm.words import batch_words, span_hashes

#: Fixed value: how the vocabulary's own pre-tokenizer splits lower-cased text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Ranges with the letters and numbers that Unicode 16 added.
UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x113D3), (0x116D0, 0x116E3),
    (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
]


#: Lower case of the letters that Unicode 16 and 17 added, single ones and runs (first, last, step to the lower one).
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEWER_RUNS = [(0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
NEWER = NEWER_LOWER | {c: c + step for first, last, step in NEWER_RUNS for c in range(first, last + 1)}


def word_pattern() -> str:
    """`WORD_PATTERN` with the letters and numbers of Unicode 16: the pattern library has newer ones, `unicodedata` those of 15."""
    newer = "".join(c for c in map(chr, range(0x80, 0x40000)) if unicodedata.category(c) == "Cn" and not any(a <= ord(c) <= b for a, b in UNICODE_16))
    codes = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", newer)]
    if not codes:
        return WORD_PATTERN
    heads = [c for k, c in enumerate(codes) if k == 0 or codes[k - 1] != c - 1]
    tails = [c for k, c in enumerate(codes) if k == len(codes) - 1 or codes[k + 1] != c + 1]
    spans = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(heads, tails))
    return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{spans}]]+|[\p{{N}}--[{spans}]]|(?:[^\s\p{{L}}\p{{N}}]|[{spans}])+"


#: Rows and bytes of text encoded or decoded at a time: what is made of them, some fifty times the text, stays in the worker's heap.
PART_ROWS, PART_SIZE = 100, 1 << 19


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (chr(256 + k) for k in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class TokenAutomaton:
    """States, arcs and trie compiled from a vocabulary and its merges."""

    TABLE = 400_000  # transitions kept before the table is begun anew

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        n = max(vocab.values()) + 1
        self.suffix, self.size = suffix, n
        self.left, self.made = [-1] * n, [-1] * n
        self.end = [0] * n
        self.parent, self.born, self.gone, self.gone_too = [-1], [-1], [-1], [-1]
        self.table: dict[int, bool] = {}
        self.removed: dict[int, tuple] | None = None
        dead = set()
        for step, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + (b[: -len(suffix)] + suffix if suffix and b.endswith(suffix) else b)]
            self.left[w], self.made[w] = u, step
            if not self.has_arc(self.end[u], v):
                dead.add(w)
                continue
            self.end[w] = self.end[v] if u != v else self.end[u]
            self.parent.append(self.end[u])
            self.born.append(step)
            self.gone.append(v)
            self.gone_too.append(w if u == v else -1)
            self.end[u] = len(self.parent) - 1
        self.table.clear()
        self.number_copies()
        self.trie: dict = {}
        self.whole: dict[str, int] = {}  # labels that are a whole word
        spelled = {}
        for token, i in vocab.items():
            if i in dead:
                continue
            final = bool(suffix) and token.endswith(suffix) and token != suffix
            text = token[: -len(suffix)] if final else token
            if final or not suffix:
                self.whole[text] = i
            node = self.trie
            for ch in text:
                node = node.setdefault(ch, {})
            node[1 if final else 0] = i
            if not final:
                spelled[text] = i
        self.inside = [0] * n  # characters of a label inside a word
        for text, i in spelled.items():
            self.inside[i] = len(text)
        #: the longest shorter label that a label (or the inside form of a final label) begins with
        self.shorter = [-1] * n
        for token, i in vocab.items():
            text = token[: -len(suffix)] if suffix and token.endswith(suffix) and token != suffix else token
            self.shorter[i] = next((spelled[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in spelled), -1)

    def has_arc(self, state: int, token: int) -> bool:
        key = state * self.size + token
        known = self.table.get(key)
        if known is None:
            known = self._has_arc(state, token)
            if len(self.table) >= self.TABLE:
                self.table.clear()
            self.table[key] = known
        return known

    def _has_arc(self, state: int, token: int) -> bool:
        """By the chain of copies; used while the automaton is compiled."""
        if self.removed is not None:
            return self._finished_arc(state, token)
        while state:
            if self.made[token] > self.born[state]:
                token = self.left[token]
            elif token == self.gone[state] or token == self.gone_too[state]:
                return False
            else:
                state = self.parent[state]
        return True

    def number_copies(self) -> None:
        """Number the states so that a state's copies, and theirs, are those from its number to its last."""
        copies: list[list[int]] = [[] for _ in self.parent]
        for state, above in enumerate(self.parent):
            if above >= 0:
                copies[above].append(state)
        self.number, last = [0] * len(copies), [0] * len(copies)
        open_states, count = [0], 0
        while open_states:
            state = open_states.pop()
            if state < 0:
                last[~state] = count - 1
                continue
            self.number[state] = count
            count += 1
            open_states.append(~state)
            open_states.extend(copies[state])
        found: dict[int, list[tuple[int, int, int]]] = {}
        for state in range(1, len(copies)):
            for token in {self.gone[state], self.gone_too[state]} - {-1}:
                found.setdefault(token, []).append((self.number[state], last[state], self.born[state]))
        #: label -> number, last number and step of the copies that removed it; none is another's copy
        self.removed = {token: tuple(zip(*sorted(spans))) for token, spans in found.items()}

    def _finished_arc(self, state: int, token: int) -> bool:
        """The label, and the left parts it comes from as long as they are what is asked for, weren't removed above."""
        at, before = self.number[state], len(self.parent) + len(self.made)
        before = max(before, self.born[-1] + 1)
        while token >= 0:
            spans = self.removed.get(token)
            if spans:
                k = bisect_right(spans[0], at) - 1
                if k >= 0 and spans[1][k] >= at and spans[2][k] < before:
                    return False
            before, token = self.made[token], self.left[token]
        return True

    def walk(self, word: str) -> list[int]:
        """Labels of the one accepting path of a word in byte-alphabet characters.

        A prefix of a word has one path at most, so a place from which no arc leads on is left for good.
        """
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        n, trie, table, size, end, shorter, suffix = len(word), self.trie, self.table, self.size, self.end, self.shorter, bool(self.suffix)
        path: list[int] = []
        ends = [0]
        states = [0]
        lost: set[int] = set()
        token = -2
        while True:
            at, state = ends[-1], states[-1]
            if token == -2:  # a new place: its longest label
                node, to, token = trie, at, -1
                while to < n:
                    node = node.get(word[to])
                    if node is None:
                        break
                    to += 1
                    if to == n and suffix:
                        token = node.get(1, token)
                    elif 0 in node:
                        token = node[0]
                        stop = to
                if to == n and suffix and node is not None and token == node.get(1):
                    stop = n
                length = stop - at if token != -1 else 0
            while token != -1:
                to = at + length
                if to not in lost:
                    known = table.get(state * size + token)
                    if known or (known is None and self.has_arc(state, token)):
                        break
                token = shorter[token]
                length = self.inside[token] if token != -1 else 0
            if token != -1:
                path.append(token)
                if to == n:
                    return path
                ends.append(to)
                states.append(end[token])
                token = -2
            else:
                lost.add(at)
                ends.pop()
                states.pop()
                token = shorter[path.pop()]
                length = self.inside[token] if token != -1 else 0


class Pieces:
    """Ids of pieces by 64-bit hash, in sorted arrays with a small dict of the newest in front.

    A piece takes about 30 bytes, a fifth of an entry of a dict of byte strings; an executor has a table in each Python worker.
    """

    KEPT = 400_000  # pieces in the arrays; when full, those not asked for since it was last full go
    FRESH = 25_000  # pieces in the dict before they are sorted in

    def __init__(self):
        self.keys, self.used = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        self.heads, self.sizes, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<i4")
        self.fresh: dict[int, bytes] = {}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's place in the arrays, -1 where it isn't there."""
        if not len(self.keys):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        at = np.where(self.keys[at] == hashes, at, -1)
        self.used[at[at >= 0]] = True
        return at

    def settle(self) -> None:
        """Sort the newest pieces in."""
        keep = np.arange(len(self.keys))
        if len(self.keys) + len(self.fresh) > self.KEPT:
            keep = np.flatnonzero(self.used)
            keep = keep[:: 1 + (2 * len(keep) > self.KEPT)]
            self.used[:] = False
        keys = np.concatenate((self.keys[keep], np.fromiter(self.fresh, dtype=np.uint64, count=len(self.fresh))))
        newest = np.array([len(ids) // 4 for ids in self.fresh.values()], dtype=np.int64)
        flat = np.concatenate((self.flat, np.frombuffer(b"".join(self.fresh.values()), dtype="<i4")))
        heads = np.concatenate((self.heads[keep], len(self.flat) + np.cumsum(newest) - newest))
        sizes, used = np.concatenate((self.sizes[keep], newest)), np.concatenate((self.used[keep], np.zeros(len(newest), dtype=bool)))
        order = np.argsort(keys)
        self.keys, self.used, self.sizes = keys[order], used[order], sizes[order]
        ends = np.cumsum(self.sizes)
        self.flat = flat[np.repeat(heads[order] - ends + self.sizes, self.sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.heads = ends - self.sizes
        self.fresh = {}


class Encoder:
    """Maps texts to ids. Pieces between blanks are encoded alone, each kind once a batch, and kept in a bounded table."""

    def __init__(self, model: str):
        spec = json.loads(model)
        bpe = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in bpe["merges"]]
        suffix = bpe.get("end_of_word_suffix") or ""
        # a merge joins the parts as they are; only the last part of a word carries the suffix
        self.automaton = TokenAutomaton(bpe["vocab"], merges, suffix)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.leads = {t[0] for t in self.special}
        self.words = regex.compile(word_pattern())
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet())}
        self.pieces = Pieces()
        marks = "" if any(t[-1] in ".,;:!?" for t in self.special) else ".,;:!?"
        #: ids of one mark, and of no mark first
        self.marks = [b"", *(array("i", self.automaton.walk(c)).tobytes() for c in marks)]
        self.mark_of = np.zeros(256, dtype=np.int64)
        self.mark_of[[ord(c) for c in marks]] = range(1, len(marks) + 1)

    def ids(self, piece: str) -> list[int]:
        walk = self.automaton.walk
        out: list[int] = []
        for part in self.cut.split(piece) if self.cut and not self.leads.isdisjoint(piece) else [piece]:
            if part in self.special:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part)
            # the library lowers character by character, without a final form of sigma
            part = part.lower() if "\u03a3" not in part else "".join(c.lower() for c in part)
            if not part.isascii():
                part = part.translate(NEWER)
            for word in self.words.findall(part):
                out += walk(word if word.isascii() and word.isalnum() else word.encode("utf-8", "replace").decode("latin-1").translate(self.alphabet))
        return out

    def piece(self, piece: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of text without blanks. Most pieces are letters only."""
        plain = piece.isascii() or ("\u03a3" not in piece and unicodedata.is_normalized("NFC", piece))
        word = piece.lower() if plain else ""
        if not word.isalpha():
            return array("i", self.ids(piece)).tobytes()
        return array("i", self.automaton.walk(word if word.isascii() else word.encode("utf-8", "replace").decode("latin-1").translate(self.alphabet))).tobytes()

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after the other, and where each text's begin.

        Blanks and line ends always part words and are dropped, and so does a mark after an ASCII letter or digit at a
        piece's end. Pieces are told apart by 64-bit hashes.
        """
        found = batch_words(column)
        data, starts = found.data, found.starts
        tail = data[np.maximum(found.ends - 2, 0)]
        after_word = (found.ends - starts > 1) & (((tail | 0x20) - np.uint8(0x61) < 26) | (tail - np.uint8(0x30) < 10))
        marks = np.where(after_word, self.mark_of[data[found.ends - 1]], 0) if len(starts) else np.zeros(0, dtype=np.int64)
        ends = found.ends - (marks > 0)
        hashes = span_hashes(data, starts, ends, np.flatnonzero(marks), found.hashes)
        codes, kinds = pd.factorize(hashes)
        seen = np.maximum.accumulate(codes) if len(codes) else codes
        at = np.flatnonzero(np.diff(seen, prepend=-1) > 0)  # where each kind stands first
        pieces, n = self.pieces, len(kinds)
        place = pieces.find(kinds)
        rest = np.flatnonzero(place < 0)
        fresh, made = pieces.fresh, []
        for h, a, b in zip(kinds[rest].tolist(), starts[at[rest]].tolist(), ends[at[rest]].tolist()):
            ids = fresh.get(h)
            if ids is None:
                ids = self.piece(data[a:b].tobytes().decode("utf-8", "replace"))
                if b - a <= 100:
                    fresh[h] = ids
            made.append(ids)
        made += self.marks
        made_sizes = np.array([len(m) // 4 for m in made], dtype=np.int64)
        made_heads = len(pieces.flat) + np.cumsum(made_sizes) - made_sizes
        flat = np.concatenate((pieces.flat, np.frombuffer(b"".join(made), dtype="<i4")))
        sizes, heads = np.zeros(n + len(self.marks), dtype=np.int64), np.zeros(n + len(self.marks), dtype=np.int64)
        held = np.flatnonzero(place >= 0)
        sizes[held], heads[held] = pieces.sizes[place[held]], pieces.heads[place[held]]
        rest = np.concatenate((rest, np.arange(n, n + len(self.marks))))
        sizes[rest], heads[rest] = made_sizes, made_heads
        if len(fresh) >= pieces.FRESH:
            pieces.settle()
        # each piece, then its mark or nothing
        both = np.stack((codes, n + marks), axis=1).ravel()
        counts = sizes[both]
        to = np.concatenate(([0], np.cumsum(counts)))
        return flat[np.repeat(heads[both] - to[:-1], counts) + np.arange(to[-1])], to[2 * found.first]


def load_model(path: str | None = None) -> str:
    """Text of the vocabulary file (2 MB, fixed), read on the driver and shipped with the tasks."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return f.read()


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(shipped) -> Encoder:
    """One compiled automaton per Python worker."""
    model = shipped.value
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def arc_labels(model: str) -> dict[int, str]:
    spec = json.loads(model)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}


def encode(df: DataFrame, column: str = "text", out: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Add `out` array<int>: the ids of the whole text. Null text encodes as the empty list.

    Every row stays, repeated or not; an empty table gives an empty table; an input column named `out` gives way.
    """
    shipped = df.sparkSession.sparkContext.broadcast(load_model(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shipped)
        for batch in batches:
            for part in small_parts(batch, column, PART_ROWS, PART_SIZE):
                flat, ends = encoder.encode_batch(part.column(column))
                yield add_columns(part, **{out: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, type=pa.int32()))})

    return df.mapInArrow(tidy(run), with_fields(df, **{out: "array<int>"}))


def decode(df: DataFrame, column: str = "ids", out: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Add `out` string: the labels of the ids. A null list decodes as the empty string.

    Every row stays, repeated or not; lists of any length are read whole; an empty table gives an empty table; an input column
    named `out` gives way.
    """
    shipped = df.sparkSession.sparkContext.broadcast(load_model(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = arc_labels(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS)
                lists = part.column(column).fill_null([])
                ends = lists.offsets.to_numpy()
                flat = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].tolist()
                ends = (ends - ends[0]).tolist()
                # the vocabulary has no decoder of its own, so labels are parted by blanks
                made = [" ".join(map(labels.__getitem__, flat[a:b])) for a, b in zip(ends, ends[1:])]
                yield add_columns(part, **{out: pa.array(made, type=pa.string())})

    return df.mapInArrow(tidy(run), with_fields(df, **{out: "string"}))
