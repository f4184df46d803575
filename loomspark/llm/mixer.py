"""The bit predictor of mixlm: hashed contexts, gated mixing, an adaptive map. Arrays only, no Spark.

A text is a stream of bytes: each lower-cased word and a space, then a line feed as the end. A byte is coded by its rank
among all bytes of the training texts: which group of 16 ranks it is in, by one bit for each group ("this one?"), and its place
in the group, by four bits; so most bytes take five bits. Each bit is predicted. A predictor hashes its context to a
line of 16 counts, one line for the group and one for the place, and gives the logit of the bit by the counts below the
bits so far. The contexts are

* the two bytes before and the last word of at most three letters, which tells languages apart,
* the three, four and six bytes before,
* the word so far,

and a match predictor follows the place in the text (within PIECE bytes) after the last occurrence of the same six bytes.

A gate picks the weights of the mix: by how many predictors have seen their line, by the match, and by group or place. The
mixed logit is refined by an adaptive map from (bits of the byte so far, logit) to a probability, averaged with it.

Within a text weights and map go on learning online, in blocks that end at 32, 64, 128, 256, 512, 1024, 2048, ...
bytes: a block is predicted with what the blocks before it taught. So all places of a block, and the blocks of many texts
side by side, are array operations, and a text's result depends on no other text of its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

END = b"\n"
#: Context bytes kept to the left of a piece; no context looks further back.
LOOK = 80
PIECE = 1 << 16
#: Texts are put side by side until they have about so many bytes.
GROUP = 1 << 14
LINE_BITS = {"short": 19, 3: 17, 4: 18, 6: 18, "word": 19}
PREDICTORS = tuple(LINE_BITS)
INPUTS = len(PREDICTORS) + 1
#: Where the counts of each predictor begin in the one table that holds all.
BEGIN = np.concatenate([[0], np.cumsum([16 << b for b in LINE_BITS.values()])]).astype(np.int64)
CELLS = int(BEGIN[-1])
#: Logits are held in steps of 1 / UNIT.
UNIT = 12
GATES = (len(PREDICTORS) + 1) * 3 * 2
STEPS = 24
#: Nodes of a byte's bits: 15 of the group at 1 to 15, 15 of the place at 17 to 31.
NODES = 32
MAP = NODES * STEPS
RATE, MAP_STRENGTH = 0.02, 30.0
START_WEIGHT = 0.25

_U = np.uint64
_M = _U(0x9E3779B97F4A7C15)
_ROOM = 1 << 18
_POWERS = np.cumprod(np.concatenate([[_U(1)], np.full(_ROOM, _M)]), dtype=_U)
_INVERSE = np.cumprod(np.concatenate([[_U(1)], np.full(_ROOM, _U(pow(int(_M), -1, 1 << 64)))]), dtype=_U)
_PLACES = np.arange(_ROOM)
#: The strength of a guess by how many before it were right; the last is for no guess, at -1.
_RUNS = np.append(np.round(UNIT * np.log(np.arange(22) + 2.0)), 0).astype(np.int8)


def _paths() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the 256 codes (group and place) one after another: nodes and bits; where each begins; how many there are."""
    nodes, bits, begin = [], [], []
    for code in range(256):
        group, place = code >> 4, code & 15
        begin.append(len(nodes))
        for i in range(min(group + 1, 15)):
            nodes.append(i + 1)
            bits.append(int(group == i))
        for depth in range(4):
            nodes.append(16 | (1 << depth) | (place >> (4 - depth)) if depth else 17)
            bits.append(place >> (3 - depth) & 1)
    return np.array(nodes, np.int64), np.array(bits, np.uint8), np.array(begin), np.diff([*begin, len(nodes)])


_NODES, _BITS, _FIRST, _MANY = _paths()


def _votes() -> np.ndarray:
    """By node and guessed code: 1 or -1 if the guess passes the node and takes its bit as 1 or 0, else 0.

    The second half is for a guess of another group than the byte's, which says nothing of its place.
    """
    out = np.zeros((NODES, 512), np.int8)
    for code in range(256):
        path = range(_FIRST[code], _FIRST[code] + _MANY[code])
        for i in path:
            out[_NODES[i], code] = 1 if _BITS[i] else -1
            if _NODES[i] < 16:
                out[_NODES[i], code + 256] = out[_NODES[i], code]
    return out.reshape(-1)


_VOTES = _votes()


def ranks(frequency: np.ndarray) -> np.ndarray:
    """The code of each byte: its rank by frequency; of equal ones the lesser byte comes first."""
    codes = np.empty(256, np.uint8)
    codes[np.argsort(-np.asarray(frequency), kind="stable")] = np.arange(256)
    return codes


def stream(text: bytes) -> tuple[bytes, int]:
    """The bytes to predict, of a UTF-8 text, and the number of its tokens, the end counted."""
    words = text.lower().split()
    return b" ".join([*words, END]), len(words) + 1


def pieces(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, the LOOK bytes before, body) of a stream, PIECE bytes at a time; before the beginning are line feeds."""
    for at in range(0, len(data), PIECE):
        left = data[max(0, at - LOOK) : at]
        yield at, left.rjust(LOOK, END), data[at : at + PIECE]


def grouped(streams: list[bytes]) -> Iterator[list[tuple[int, int, bytes, bytes]]]:
    """Lists of (number of the stream, offset, left, body): many short streams at a time, or a piece of a long one."""
    held, size = [], 0
    for i in sorted(range(len(streams)), key=lambda i: len(streams[i])):
        if len(streams[i]) > GROUP:
            for piece in pieces(streams[i]):
                yield [(i, *piece)]
            continue
        if held and size + len(streams[i]) + LOOK > GROUP:
            yield held
            held, size = [], 0
        held += [(i, *piece) for piece in pieces(streams[i])]
        size += len(streams[i]) + LOOK
    if held:
        yield held


def contexts(p: np.ndarray) -> list[np.ndarray]:
    """For every place of p, by the bytes before it, the hash of each predictor's context."""
    n = len(p)
    sums = np.zeros(n + 1, _U)
    np.cumsum((p.astype(_U) + _U(1)) * _POWERS[:n], out=sums[1:])
    at = _PLACES[:n]

    def span(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[begin]) * _INVERSE[begin]

    def before(k: int) -> np.ndarray:
        return span(np.maximum(at - k, 0), at)

    space = (p == 32) | (p == 10)
    last = np.maximum.accumulate(np.where(space, at, -1))
    previous = np.concatenate([[-1], last[:-1]])
    begin = np.maximum(previous + 1, at - 32)
    length = at - previous - 1
    brief = np.maximum.accumulate(np.where(space & (length > 0) & (length <= 3), at, -1))
    brief = np.concatenate([[-1], brief[:-1]])
    far = (brief < 0) | (at - brief > 64)
    brief = np.where(far, 0, brief)
    word = span(np.maximum(np.concatenate([[-1], last[:-1]])[brief], -1) + 1, brief)
    word[far] = 0
    word ^= word >> _U(31)
    hashes = {"short": before(2) + word * _U(0x2545F4914F6CDD1D) + _U(57), "word": span(begin, at) + _U(101)}
    for k in (3, 4, 6):
        hashes[k] = before(k) + _U(7 * k)
    return [hashes[k] for k in PREDICTORS]


def lines(hashes: np.ndarray, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The lines of the group and of the place of codes under their contexts: the first half is for groups."""
    out = []
    for more in (_U(0), ((codes >> 4).astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93)):
        h = (hashes + more) * _M
        h ^= h >> _U(29)
        out.append(((h * _M) >> _U(65 - bits)).astype(np.int64))
    return out[0], out[1] + (1 << (bits - 1))


def holds_places(cell: int) -> bool:
    """Whether a cell belongs to a line for places."""
    k = int(np.searchsorted(BEGIN, cell, side="right")) - 1
    return 2 * (cell - int(BEGIN[k])) >= int(BEGIN[k + 1] - BEGIN[k])


def cells(group: list[tuple[int, int, bytes, bytes]], codes: np.ndarray) -> np.ndarray:
    """Places in the table of counts of all bytes of a group, for all predictors."""
    p, own = _laid(group)
    body = codes[p[own]]
    out = []
    for h, bits, begin in zip(contexts(p), LINE_BITS.values(), BEGIN, strict=False):
        high, low = lines(h[own], body, bits)
        out += [(high << 4) + (body >> 4) + begin, (low << 4) + (body & 15) + begin]
    return np.concatenate(out)


def _laid(group: list[tuple[int, int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a group with what lies left of each piece, and the places of the pieces' own bytes."""
    p = np.frombuffer(b"".join(left + body for _, _, left, body in group), np.uint8)
    sizes = np.array([len(body) for *_, body in group])
    starts = np.cumsum(sizes + LOOK) - sizes
    return p, np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def count(table: np.ndarray, streams: list[bytes], codes: np.ndarray) -> None:
    """Add the bytes of streams to a table of CELLS counts."""
    for group in grouped(streams):
        np.add.at(table, cells(group, codes), table.dtype.type(1))


def logits(counts: np.ndarray, places: bool) -> np.ndarray:
    """Counts of lines of 16, all for groups or all for places -> the logits at each line's nodes, at 1 to 15.

    A line that was seen a few times says less than one that was seen often. Zero is for nodes never seen.
    """
    level = counts.reshape(-1, 16).astype(np.float64)
    out = np.zeros(level.shape, np.int8)
    if not places:
        after = np.cumsum(level[:, ::-1], axis=1)[:, ::-1]
        out[:, 1:] = _shrunk(after[:, 1:], level[:, :-1])
        return out.reshape(-1)
    for depth in range(3, -1, -1):
        zeros, ones = level[:, 0::2], level[:, 1::2]
        out[:, 1 << depth : 2 << depth] = _shrunk(zeros, ones)
        level = zeros + ones
    return out.reshape(-1)


def table_of(counts: np.ndarray, size: int = 1 << 14) -> np.ndarray:
    """The logits of a whole table of counts."""
    return np.concatenate([logits(counts[at : at + size], holds_places(at)) for at in range(0, CELLS, size)])


def _shrunk(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    n = zeros + ones
    raw = np.log((ones + 0.4) / (zeros + 0.4)) * (n / (n + 0.5)) * UNIT
    return np.where(n > 0, np.where(np.abs(raw) < 0.5, np.where(raw < 0, -1, 1), np.clip(np.round(raw), -127, 127)), 0)


class Places:
    """What is known of all bits of a group before anything is mixed, in the order block, stream, place."""

    def __init__(self, table: np.ndarray, group: list[tuple[int, int, bytes, bytes]], codes: np.ndarray):
        p, own = _laid(group)
        sizes = np.array([len(body) for *_, body in group])
        lane = np.repeat(np.arange(len(group)), sizes)
        offset = np.concatenate([np.arange(at, at + len(body)) for _, at, _, body in group])
        block = np.where(offset < 1024, np.searchsorted((32, 64, 128, 256, 512), offset, side="right"), 5 + (offset >> 10))
        order = np.argsort(block, kind="stable")
        hashes = contexts(p)
        guess, run = self._match(hashes[PREDICTORS.index(6)], p, own, lane)
        at, n = own[order], len(own)
        body, guess, run = codes[p[at]], codes[guess[order]].astype(np.int64), run[order]
        many = _MANY[body]
        last = np.cumsum(many)
        path = np.repeat(_FIRST[body] - (last - many), many)
        path += np.arange(len(path))
        node = _NODES.take(path)
        self.node, self.bit = node, _BITS.take(path)
        self.lane = np.repeat(lane[order], many)
        self.inputs = np.empty((INPUTS, len(node)), np.int8)
        # A line is fetched whole; the nodes on the way to the byte are picked from it.
        pick = np.repeat(_PLACES[:n] * NODES, many) + node
        both = np.empty((n, 2), "V16")
        seen = np.zeros(len(node), np.uint8)
        for k, (h, bits, begin) in enumerate(zip(hashes, LINE_BITS.values(), BEGIN, strict=False)):
            for half, line in enumerate(lines(h[at], body, bits)):
                both[:, half] = table[begin : begin + (16 << bits)].view("V16").take(line)
            both.reshape(-1).view(np.int8).take(pick, out=self.inputs[k], mode="wrap")
            seen += self.inputs[k] != 0
        # -1 is no guess; it votes nowhere, as its strength is zero.
        guess[guess >> 4 != body >> 4] += 256
        vote = _VOTES.take((node << 9) + np.repeat(guess, many))
        np.multiply(vote, np.repeat(_RUNS[run], many), out=self.inputs[-1])
        by_match = np.where(self.inputs[-1] != 0, np.repeat(np.where(run > 5, 4, 2).astype(np.uint8), many), np.uint8(0))
        self.gate = seen * np.uint8(6) + by_match + (node >= 16)
        edges = np.flatnonzero(np.diff(block[order]))
        ends = [*last[edges].tolist(), len(node)]
        self.blocks = list(zip([0, *ends[:-1]], ends, strict=True))

    @staticmethod
    def _match(hashes: np.ndarray, p: np.ndarray, own: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte after the last place with the same context in the piece, and how many such guesses in a row were right; -1 without one."""
        n = len(own)
        h = (hashes[own] ^ (lane.astype(_U) * _U(0xD1342543DE82EF95))) * _M
        keys = np.sort((h >> _U(24) << _U(24)) | np.arange(n, dtype=_U))
        place = (keys & _U((1 << 24) - 1)).astype(np.int64)
        same = np.flatnonzero((keys[1:] ^ keys[:-1]) >> _U(24) == 0)
        before = np.full(n, -1)
        before[place[same + 1]] = place[same]
        known = before >= 0
        guess = p[own[np.maximum(before, 0)]]
        right = known & (guess == p[own])
        at = np.arange(n)
        wrong = np.maximum.accumulate(np.where(right, -1, at))
        run = np.minimum(at - 1 - np.concatenate([[-1], wrong[:-1]]), len(_RUNS) - 2)
        return guess, np.where(known, run, -1)


class Mixer:
    """The codes of bytes, and weights and map to start a text with."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.codes = codes
        self.weights = np.full((GATES, INPUTS), START_WEIGHT, np.float32) if weights is None else weights.astype(np.float32)
        start = np.zeros((MAP, 2)) if counts is None else counts.astype(np.float64)
        centre = 1 / (1 + np.exp(-(np.arange(STEPS) + 0.5 - STEPS / 2)))
        share = (start[:, 1] + np.tile(centre, NODES) * 20) / (start.sum(axis=1) + 20)
        self.map = (share * MAP_STRENGTH).astype(np.float32)

    @staticmethod
    def place(total: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The place in the map of mixed logits."""
        return node * STEPS + np.clip(total + np.float32(STEPS / 2), 0, STEPS - 1).astype(np.int64)

    def gradients(self, table: np.ndarray, streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums over all bits for a Newton step of the weights, and the counts of the map, without learning in between.

        All are sums of whole numbers, so they are the same however texts are dealt to tasks.
        """
        slope, bend, seen = np.zeros((GATES, INPUTS), np.int64), np.zeros((GATES, INPUTS, INPUTS), np.int64), np.zeros((MAP, 2), np.int64)
        for group in grouped(streams):
            places = Places(table, group, self.codes)
            gate, bit = places.gate, places.bit
            total = np.zeros(len(gate), np.float32)
            for k, x in enumerate(places.inputs):
                total += x * (self.weights[:, k] / np.float32(UNIT)).take(gate)
            total = np.clip(total, -12, 12)
            p = 1 / (1 + np.exp(-total))
            seen += np.bincount(self.place(total, places.node) * 2 + bit, minlength=2 * MAP).reshape(MAP, 2)
            order = np.argsort(gate, kind="stable")
            x = places.inputs[:, order].astype(np.float64)
            error = np.round((bit - p) * 65536)[order].astype(np.float64)
            spread = np.round(p * (1 - p) * 4096)[order].astype(np.float64)
            ends = np.cumsum(np.bincount(gate, minlength=GATES))
            for g, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if a < b:
                    slope[g] += (x[:, a:b] @ error[a:b]).astype(np.int64)
                    bend[g] += ((x[:, a:b] * spread[a:b]) @ x[:, a:b].T).astype(np.int64)
        return slope, bend, seen

    def stepped(self, slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
        """The weights after a Newton step, drawn to the old ones where a gate has seen little."""
        weights = self.weights.astype(np.float64)
        for g in range(GATES):
            curve = bend[g] / (4096.0 * UNIT * UNIT) + np.eye(INPUTS) * 50
            weights[g] += np.linalg.solve(curve, slope[g] / (65536.0 * UNIT))
        return np.clip(np.round(weights, 6), -1, 2).astype(np.float32)

    def score(self, table: np.ndarray, streams: list[bytes]) -> np.ndarray:
        """log10 of the probability of each stream."""
        out = np.zeros(len(streams))
        carried: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for group in grouped(streams):
            places, n = Places(table, group, self.codes), len(group)
            if group[0][1] == 0 or carried is None:
                weights = np.tile(self.weights.T / np.float32(UNIT), n)
                ones = np.tile(self.map, n)
                size = np.full(n * MAP, MAP_STRENGTH, np.float32)
            else:
                weights, ones, size = carried
            sums, width = np.zeros(n), n * GATES
            gates, own_map = places.lane * GATES + places.gate, places.lane * MAP
            for a, b in places.blocks:
                gate, bit = gates[a:b], places.bit[a:b]
                x = places.inputs[:, a:b].astype(np.float32)
                total = x[0] * weights[0].take(gate)
                for k in range(1, INPUTS):
                    total += x[k] * weights[k].take(gate)
                np.clip(total, -12, 12, out=total)
                mixed = 1 / (1 + np.exp(-total))
                at = own_map[a:b] + self.place(total, places.node[a:b])
                p = np.clip((mixed + ones.take(at) / size.take(at)) * np.float32(0.5), 1e-5, 1 - 1e-5)
                sums += np.bincount(places.lane[a:b], np.log10(np.where(bit, p, 1 - p)), minlength=n)
                error = bit - mixed
                step = RATE / UNIT / UNIT / np.sqrt(np.bincount(gate, minlength=width) + 30.0)
                x *= error
                for k in range(INPUTS):
                    weights[k] += (step * np.bincount(gate, x[k], minlength=width)).astype(np.float32)
                size += np.bincount(at, minlength=len(size)).astype(np.float32)
                ones += np.bincount(at, bit, minlength=len(ones)).astype(np.float32)
            carried = (weights, ones, size)
            np.add.at(out, [i for i, *_ in group], sums)
        return out
