"""A byte-level BPE tokenizer compiled to a deterministic transducer that is run over arrays of texts.

Borders. The splitting rule of the tokenizer (contractions, a blank joined to the word, number or sign run after it,
blank runs that give their last character away) is a machine of eleven states over twelve character classes. A
transition says whether a piece starts at the character read or at the one before. A text is dealt into chunks; each
chunk's map from any start state to its end state is worked out for all chunks at once, the maps are composed by a
parallel prefix scan, and a second pass over all chunks, now from known states, writes the piece starts.

Pieces. Within a piece the transducer walks a tree of states, one for each beginning of a piece; transitions are keyed
by state and character, whole, so that two pieces never share a state. The transition that leaves a state at a border
carries the number of tokens emitted there and their ids. States and transitions are made when they are first needed,
the merges being run for all pieces that are new in a block together.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np

from .tables import Numbers

#: Characters of a chunk and of a block; states kept from block to block; pieces of more characters than REACH have a
#: state of their own, found by the whole piece, and are kept up to KEPT characters in all.
CHUNK, SPAN, STATES, REACH, KEPT = 128, 1 << 18, 400_000, 48, 4_000_000
_LEAD = 12
_OTHER_LETTER, _STMD, _R, _V, _L, _E, _NUMBER, _SIGN, _QUOTE, _SPACE, _BLANK, _END = range(12)
_START, _WORD, _DIGITS, _SIGNS, _AP, _APR, _APL, _SP1, _SPN, _WS1, _WSN = range(11)
_CLASSES, _STATES = 12, 11
#: Lone surrogates mark the end of a text and added tokens: no valid text holds them.
_STOP = "\ud800"


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[state * classes + class] and starts[...]: 1 a piece starts here, 2 one started at the character before."""
    nxt, out = np.zeros((_STATES, _CLASSES), np.uint8), np.zeros((_STATES, _CLASSES), np.uint8)
    letters = {_OTHER_LETTER, _STMD, _R, _V, _L, _E}
    first = {c: _WORD for c in letters} | {_NUMBER: _DIGITS, _SIGN: _SIGNS, _QUOTE: _AP, _SPACE: _SP1, _BLANK: _WS1, _END: _START}
    joined = {c: _WORD for c in letters} | {_NUMBER: _DIGITS, _SIGN: _SIGNS, _QUOTE: _SIGNS}
    for state in range(_STATES):
        for c in range(_CLASSES):
            to, mark = first[c], 1
            if (state == _WORD and c in letters) or (state == _DIGITS and c == _NUMBER) or (state == _SIGNS and c in (_SIGN, _QUOTE)):
                to, mark = state, 0
            elif state == _AP and c in (_STMD, _R, _V, _L, _SIGN, _QUOTE):
                to, mark = {_STMD: _START, _R: _APR, _V: _APR, _L: _APL}.get(c, _SIGNS), 0
            elif state in (_APR, _APL):
                if c == (_E if state == _APR else _L):
                    to, mark = _START, 0
                else:
                    mark = 2 if c in letters else 3
            elif state in (_SP1, _SPN, _WS1, _WSN):
                if c in (_SPACE, _BLANK):
                    to, mark = (_SPN if c == _SPACE else _WSN), 0
                elif c == _END:
                    pass
                elif state in (_SP1, _SPN):
                    to, mark = joined[c], 2 * (state == _SPN)
                elif state == _WSN:
                    mark = 3
            nxt[state, c], out[state, c] = to, mark
    return nxt.ravel(), out.ravel()


def _classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, _SIGN, np.uint8)
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    kinds = np.frombuffer(kinds.encode(), np.uint8)
    table[kinds == ord("L")] = _OTHER_LETTER
    table[kinds == ord("N")] = _NUMBER
    table[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _BLANK
    for c, k in zip("stmdrvle' ", [_STMD] * 4 + [_R, _V, _L, _E, _QUOTE, _SPACE], strict=True):
        table[ord(c)] = k
    table[0xD800:0xE000] = _END
    return table


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary: itself where printable, else 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """A byte-level BPE file, compiled. Use load(path), which keeps one for each Python worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only a byte-level BPE without normaliser, prefix space and whole-word entries can be compiled")
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])):
            raise ValueError(f"{path}: added tokens that strip blanks or match whole words only can't be compiled")
        vocab = model["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for name, byte in _byte_names().items():
            self.byte_id[byte] = vocab[name]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array(x, np.uint64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        self.ranks, self.made = Numbers((left << np.uint64(32)) | right), made.astype(np.int64)
        self.added = added
        self._find_added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._mark = {s: chr(0xD801 + k) for k, s in enumerate(added)}
        self._mark_id = np.array([*added.values()], np.int64)
        self.next, self.starts = _machine()
        self.classes = _classes()
        self.clear()

    def clear(self) -> None:
        """Forget all states but the first, which every piece starts from."""
        self.edges, self.long, self.kept = Numbers(), {}, 0
        self.states, self.used = 1, 0
        self.at, self.n, self.ids = np.zeros(1 << 16, np.int64), np.full(1 << 16, -1, np.int64), np.zeros(1 << 18, np.int32)

    # -- merges

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self.ranks.find((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).astype(np.int64)
        return np.where(rank < 0, len(self.made), rank)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces in one array, and their number for each piece; pieces are not empty."""
        sizes = np.array([len(p) for p in pieces])
        symbols, owner = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)], np.repeat(np.arange(len(pieces)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.made)

        def ranks(at: np.ndarray) -> None:
            """Rank the pairs that begin at the given places."""
            rank[at] = none
            at = at[at + 1 < len(symbols)]
            at = at[owner[at] == owner[at + 1]]
            rank[at] = self._rank(symbols[at], symbols[at + 1])

        rank = np.full(len(symbols), none)
        ranks(np.arange(len(symbols)))
        while len(symbols):
            heads = np.append(0, np.nonzero(owner[1:] != owner[:-1])[0] + 1)
            best = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(symbols))))
            keep = best < none
            if not keep.all():
                done.append((owner[~keep], symbols[~keep]))
            at = np.nonzero((rank == best) & keep)[0]
            # of pairs that overlap (a run of one symbol) every second merges, from the left
            order = np.arange(len(at))
            fresh = np.append(True, np.diff(at) != 1)[: len(at)]
            at = at[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            ranks(np.concatenate([moved, moved[moved > 0] - 1]))
        owner, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(owner, minlength=len(pieces))

    # -- pieces

    def _starts(self, points: np.ndarray) -> np.ndarray:
        """Where pieces start, by chunk maps, their prefix scan and the emitting pass."""
        n = len(points)
        rows = -(-n // CHUNK)
        kinds = np.full(rows * CHUNK, _END, np.uint8)
        kinds[:n] = self.classes[points]
        kinds = np.ascontiguousarray(kinds.reshape(rows, CHUNK).T)
        maps = np.tile(np.arange(_STATES, dtype=np.uint8), (rows, 1))
        for k in range(_LEAD):
            maps = self.next[maps * np.uint8(_CLASSES) + kinds[k][:, None]]
        # most characters lead all states to one: from there on such a chunk's map is one state
        same = (maps == maps[:, :1]).all(axis=1)
        one, many = maps[:, 0].copy(), maps[~same]
        for k in range(_LEAD, CHUNK):
            one = self.next[one * np.uint8(_CLASSES) + kinds[k]]
            many = self.next[many * np.uint8(_CLASSES) + kinds[k][~same, None]]
        maps = np.repeat(one[:, None], _STATES, 1)
        maps[~same] = many
        step = 1
        while step < rows:
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), 1)
            step *= 2
        state = np.concatenate([[_START], maps[:-1, _START]]).astype(np.uint8)
        marks = np.empty((CHUNK, rows), np.uint8)
        for k in range(CHUNK):
            cell = state * np.uint8(_CLASSES) + kinds[k]
            marks[k], state = self.starts[cell], self.next[cell]
        marks = marks.T.ravel()[:n]
        here = (marks & 1).astype(bool)
        here[:-1] |= (marks[1:] & 2).astype(bool)
        return np.nonzero(here)[0]

    def _new_states(self, n: int) -> np.ndarray:
        while self.states + n > len(self.n):
            self.at, self.n = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.n, np.full_like(self.n, -1)])
        self.states += n
        return np.arange(self.states - n, self.states)

    def _walk(self, text: str, points: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The state that each piece ends in; all pieces advance together, a character at a time."""
        state = np.zeros(len(starts), np.int64)
        live, k = np.nonzero(size <= REACH)[0], 0
        now, at = state[live], starts[live]
        while len(live):
            key = (now.astype(np.uint64) << np.uint64(21)) | points[at + k]
            now = self.edges.find(key).astype(np.int64)
            if len(new := np.nonzero(now < 0)[0]):
                fresh, back = np.unique(key[new], return_inverse=True)
                numbers = self._new_states(len(fresh))
                self.edges.add(fresh, numbers)
                now[new] = numbers[back]
            state[live] = now
            k += 1
            stay = size[live] > k
            live, now, at = live[stay], now[stay], at[stay]
        for k in np.nonzero(size > REACH)[0].tolist():
            piece = text[starts[k] : starts[k] + size[k]]
            if piece not in self.long:
                self.long[piece] = int(self._new_states(1)[0])
                self.kept += len(piece)
            state[k] = self.long[piece]
        return state

    def _block(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Of a string of texts with their stops: the state that each piece ends in, and which pieces are stops."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = self._starts(points)
        size = np.diff(np.append(starts, len(points)))
        state = self._walk(text, points, starts, size)
        if len(new := np.nonzero(self.n[state] < 0)[0]):
            fresh, one = np.unique(state[new], return_index=True)
            one = new[one]
            self._learn(fresh, [text[a : a + n] for a, n in zip(starts[one].tolist(), size[one].tolist(), strict=True)])
        return state, np.nonzero(points[starts] == 0xD800)[0]

    def _learn(self, states: np.ndarray, pieces: list[str]) -> None:
        """What the transitions that leave these states at a border emit."""
        marks = np.array(["\ud800" <= p[0] <= "\udfff" for p in pieces])
        sizes, ids = np.zeros(len(pieces), np.int64), np.zeros(0, np.int32)
        if not marks.all():
            ids, sizes[~marks] = self.merge([p.encode() for p, m in zip(pieces, marks, strict=True) if not m])
        at = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        extra = []
        for k in np.nonzero(marks)[0]:
            if pieces[k] != _STOP:
                at[k], sizes[k] = self.used + len(ids) + len(extra), 1
                extra.append(self._mark_id[ord(pieces[k]) - 0xD801])
        ids = np.concatenate([ids, np.array(extra, np.int32)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.at[states], self.n[states] = at, sizes

    def _parts(self, text: str) -> list[str]:
        """A text in parts of about SPAN characters, cut before blanks that follow no blank: a piece starts there anyway."""
        if self._find_added and self._find_added.search(text):
            text = self._find_added.sub(lambda m: self._mark[m[0]], text)
        parts, lo = [], 0
        while len(text) - lo > SPAN and (m := re.compile(r"\S ").search(text, lo + SPAN - 1)):
            parts.append(text[lo : m.start() + 1])
            lo = m.start() + 1
        return [*parts, text[lo:]]

    def _blocks(self, texts: list[str]):
        """(states that pieces end in, first piece of each part, text of each part) in blocks of about SPAN characters."""
        parts, of, size = [], [], 0
        for k, text in enumerate(texts):
            for part in self._parts(text or ""):
                parts.append(part)
                of.append(k)
                size += len(part) + 1
                if size >= SPAN:
                    yield self._flush(parts), np.array(of)
                    parts, of, size = [], [], 0
        if parts:
            yield self._flush(parts), np.array(of)

    def _flush(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.states > STATES or self.kept > KEPT:
            self.clear()
        state, stops = self._block(_STOP.join(parts) + _STOP)
        return state, np.concatenate([[0], stops[:-1] + 1])

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for (state, first), of in self._blocks(texts):
            np.add.at(out, of, np.add.reduceat(self.n[state], first))
        return out

    def encode(self, texts: list[str]):
        """For block after block: (indices of texts, token ids of all its parts, first id of each part and the end)."""
        for (state, first), of in self._blocks(texts):
            n = self.n[state]
            end = np.cumsum(n)
            ids = self.ids[np.repeat(self.at[state] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
            yield of, ids, np.append((end - n)[first], end[-1])


@functools.lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    return Transducer(path)
