"""Byte-level BPE by a lazily determinised finite-state transducer, and a streaming decoder.

A sequence of tokens is the BPE encoding of its bytes exactly if each two neighbours, merged by themselves, stay as
they are. So the encoding of a prefix ends in one token only, found from the encodings of shorter prefixes. The
transducer reads bytes; its state is the last token given out and the bytes since then. A position among these stays
open as long as the bytes after it begin some token; tokens that lie on the path to every open position are given
out. The lookahead is thus bounded by the longest token. States and transitions are made when first met and kept in a
table, which is emptied when it has grown to a limit, so memory is bounded and each further byte costs one lookup.

The decoder turns ids into bytes as they come, and bytes into text by a state machine that holds back at most three
bytes of an unfinished character.

Null texts count as empty (no tokens; hashes of nothing). Rows are independent, so ties, repeated rows, null or
repeated ids and empty tables need no care; only id and text are read. Unpaired or broken bytes decode to U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame

from .common import map_texts, table, uncollected


FREE = 1 << 60  # a rank that no merge has
SETTLED = -2  # in a state, any token before
FIRST: list = []  # before a piece stands nothing
BYTES = [bytes((i,)) for i in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Tokens of one piece of bytes, a byte at a time."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 200_000):
        self.ranks = ranks
        # by the beginnings of tokens: the token that it is (-1: none), and whether a longer one begins so
        starts = {t[:k] for t in ranks for k in range(1, len(t))}
        self.begun = {b: (ranks.get(b, -1), b in starts) for b in starts.union(ranks)}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.most_states = most_states
        self.ends: tuple[dict, dict] = ({}, {})
        self.reset()

    def reset(self) -> None:
        # state: (token before, bytes since, for each position since: its last token and where that starts, open ones)
        self.states: list[tuple] = [(-1, b"", (-1,), (0,), (0,))]
        self.known: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.pairs: dict[tuple[int, int], bool] = {}

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that merge into a token at last; None for a token that its own bytes do not merge into."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, FREE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == FREE:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1])

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """What stands at a token's left (0) or right (1) end while it is merged: parts, from single byte to whole,
        each with the rank that ends it (the next one's). None: no merging leads to the token."""
        chain, part = [(self.bytes_of[token], FREE)], self.bytes_of[token]
        while len(part) > 1:
            two = self.halves(part)
            if two is None:
                chain = None
                break
            chain.append((two[side], self.ranks[part]))
            part = two[side]
        found = self.ends[side][token] = chain and chain[::-1]
        return found

    def stay(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; a = -1: b begins the piece.

        Merges run by rank, so the part at a's right end lasts until the rank of the next one, and likewise at b's
        left end. The tokens stay apart unless, at some time, the two parts there merge before either is taken up
        from its own side; at equal rank the left of two merges runs first.
        """
        lefts, rights = self.ends
        ys = lefts[b] if b in lefts else self.edge(b, 0)
        xs = FIRST if a < 0 else rights[a] if a in rights else self.edge(a, 1)
        got = ys is not None and xs is not None
        if got and a >= 0:
            rank_of = self.ranks.get
            i = j = 0
            x, until_x = xs[0]
            y, until_y = ys[0]
            while True:
                rank = rank_of(x + y)
                if rank is not None and rank < until_x and rank <= until_y:
                    got = False
                    break
                if until_x > until_y:
                    j += 1
                    y, until_y = ys[j]
                elif until_x == FREE:
                    break
                else:
                    i += 1
                    x, until_x = xs[i]
        self.pairs[a, b] = got
        return got

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition by a byte: next state and tokens given out."""
        before, since, last, start, is_open = self.states[state]
        since += BYTES[byte]
        m = len(since)
        begun, pairs = self.begun.get, self.pairs.get
        found = None
        still = []
        for j in is_open:
            got = begun(since[j:] if j else since)
            if got is None:
                continue
            token, longer = got
            if longer:
                still.append(j)
            if token >= 0 and found is None:
                stays = pairs((last[j], token))
                if self.stay(last[j], token) if stays is None else stays:
                    found = (token, j)
        if found is None:
            raise ValueError("the ranks do not hold all single bytes")
        last, start = (*last, found[0]), (*start, found[1])
        cut = m
        for at in still:  # to the last position that all paths share
            while at != cut:
                if at > cut:
                    at = start[at]
                else:
                    cut = start[cut]
        given: tuple[int, ...] = ()
        at = cut
        while at:
            given = (last[at], *given)
            at = start[at]
        if cut:
            before, since, m = last[cut], since[cut:], m - cut
            last, start = last[cut:], (0, *[x - cut for x in start[cut + 1 :]])
            still = [j - cut for j in still]
        if 0 not in still and m:
            before = SETTLED  # no later token starts there
        key = (before, since)
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.states)
            self.states.append((before, since, last, start, (*still, m)))
            self.steps.append({})
        out = self.steps[state][byte] = (to, given)
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece that is a token is never merged by steps
            return [whole]
        if len(self.states) > self.most_states or len(self.pairs) > 8 * self.most_states:
            self.reset()
        out: list[int] = []
        state = 0
        steps = self.steps
        for byte in piece:
            got = steps[state].get(byte)
            if got is None:
                got = self.step(state, byte)
            state, given = got
            if given:
                out += given
        _, since, last, start, _ = self.states[state]
        tail: list[int] = []
        at = len(since)
        while at:
            tail.append(last[at])
            at = start[at]
        return out + tail[::-1]


class Encoder:
    """Whole texts: pieces by the pattern, each through the transducer once and then from a bounded table."""

    class _Memo(dict):
        """Packed ids by piece. When full, what was looked up last stays at hand as the former table."""

        def __init__(self, transducer: Transducer):
            super().__init__()
            self.transducer = transducer
            self.former: dict[str, bytes] = {}

        def __missing__(self, piece: str) -> bytes:
            got = self.former.get(piece)
            if got is None:
                ids = self.transducer.encode(piece.encode())
                got = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:
                self[piece] = got
            return got

        def turn(self) -> None:
            self.former = dict(self)
            self.clear()

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = 200_000):
        import regex

        self.find = regex.compile(pattern)
        self.most_pieces = most_pieces
        self.memo = self._Memo(Transducer(ranks))

    def packed(self, text: str) -> Iterator[bytes]:
        """The ids as little-endian unsigned 32-bit integers, in parts."""
        get = self.memo.__getitem__
        if len(text) <= 1 << 18:
            found: Iterable[list[str]] = [self.find.findall(text)]
        else:
            each = (m.group() for m in self.find.finditer(text))
            found = iter(lambda: list(islice(each, 1 << 15)), [])
        for pieces in found:
            if len(self.memo) > self.most_pieces:
                self.memo.turn()
            yield b"".join(map(get, pieces))

    def encode(self, text: str) -> list[int]:
        import numpy as np

        return np.frombuffer(b"".join(self.packed(text)), "<u4").tolist()


class Utf8Machine:
    """Bytes to text as they come. The state is the unfinished character at the end: at most three bytes."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that further bytes could finish."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            if back >= 2:  # some leads allow a part of the second bytes only
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self.unfinished(data)
        self.held = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.vocabulary = {v: k for k, v in ranks.items()}

    def bytes_of(self, packed: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def stream(self, parts: Iterable[bytes]) -> Iterator[str]:
        machine = Utf8Machine()
        for part in parts:
            yield machine.feed(self.bytes_of(part))
        yield machine.close()


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, and on request the ids and the decoded text, for every row."""
    more = ", ids array<int>" * with_ids + ", decoded string" * with_text

    def make():
        ranks = load_ranks(ranks_path)
        encoder, decoder = Encoder(ranks, pattern), Decoder(ranks)

        def run(batch: list[str]) -> dict[str, list]:
            with uncollected():  # looking through the tables took a fifth of the time
                return all_of(batch)

        def all_of(batch: list[str]) -> dict[str, list]:
            import numpy as np

            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for text in batch:
                n, ids, plain, machine = 0, hashlib.sha256(), hashlib.sha256(), Utf8Machine()
                all_ids: list[int] = []
                words: list[str] = []
                for part in encoder.packed(text):
                    n += len(part) // 4
                    ids.update(part)
                    data = decoder.bytes_of(part)
                    plain.update(data)
                    word = machine.feed(data)
                    if with_text:
                        words.append(word)
                    if with_ids:
                        all_ids += np.frombuffer(part, "<u4").tolist()
                words.append(machine.close())
                out["n_tokens"].append(n)
                out["ids_sha256"].append(ids.hexdigest())
                out["decoded_sha256"].append(plain.hexdigest())
                out["ids"].append(all_ids)
                out["decoded"].append("".join(words))
            return out

        return run

    return map_texts(df, [id_col], text_col, f"n_tokens long, ids_sha256 string, decoded_sha256 string{more}", make)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode_decode(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
