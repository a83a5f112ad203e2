"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A rank file's merges give every byte string one tokenization. The tokenization of a prefix ends in the one token t
that is a suffix of it and may follow the last token of the tokenization of what stands before t; two tokens may be
neighbours if the merges leave their concatenation as these two. The transducer reads bytes. Its state is the longest
suffix of its input that still begins some token, with a register: the last tokens of the tokenizations that end within
that suffix. States and arcs are made when first met (there are at most as many as beginnings of tokens); so are
the answers which tokens may be neighbours. A token is emitted once the tokenizations of all positions that the state
can still look back to agree on it, so the lookahead is bounded by the longest token.

Documents whose text is null or empty have no tokens. Bytes that are not UTF-8 become U+FFFD before encoding.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, scratch, written

#: Stretches of text that a worker remembers, pairs of tokens, and bytes after which agreed tokens are emitted.
WORDS, PAIRS, EMIT = 250_000, 400_000, 256


class Transducer:
    """Encodes byte strings by the ranks of a vocabulary; emits ids packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = list(map(len, self.tokens))
        self.begins = {t[:k] for t in ranks for k in range(len(t) + 1)}
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.follows: list[set[int]] = [set() for _ in self.tokens]
        self.pairs = 0
        self.ends: dict[tuple[int, bool], tuple[list[tuple[int, int]], bool]] = {}
        self.states: dict[bytes, dict] = {}
        self.root = self.state(b"")

    def edges(self, token: int, right: bool) -> tuple[list[tuple[int, int]], bool]:
        """The tokens that stand at one end while the merges make this token, each with the rank that ends it; whether they do make it."""
        if (token, right) not in self.ends:
            data, found, end = self.tokens[token], [], 1 << 40
            parts = [data[i : i + 1] for i in range(len(data))]
            history = [(self.ranks[parts[-1 if right else 0]], -1)]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if rank == 1 << 40:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if self.ranks[parts[-1 if right else 0]] != history[-1][0]:
                    history.append((self.ranks[parts[-1 if right else 0]], rank))
            for at in range(len(history) - 1, -1, -1):
                found.append((history[at][0], end))
                end = history[at][1]
            self.ends[token, right] = found, len(parts) == 1
        return self.ends[token, right]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the merges leave the two as they are: none across their border comes before the merges that end what it would take."""
        rights, fits = self.edges(token, False)
        if before >= 0 and fits:
            lefts, fits = self.edges(before, True)
            for x, x_end in lefts if fits else ():
                for y, y_end in rights:
                    rank = self.ranks.get(self.tokens[x] + self.tokens[y])
                    if rank is not None and rank < x_end and rank <= y_end:
                        return False
        return fits

    def state(self, suffix: bytes) -> dict:
        """Arcs by byte. At -1 the tokens that the suffix ends in, longest first, each with its size and what is known to come before it; at -2 the suffix."""
        if suffix not in self.states:
            ends = [(size, self.follows[t], t) for size in range(len(suffix), 0, -1) if (t := self.ranks.get(suffix[-size:])) is not None]
            self.states[suffix] = {-1: ends, -2: suffix}
        return self.states[suffix]

    def arc(self, state: dict, byte: int) -> dict:
        suffix = state[-2] + bytes((byte,))
        while suffix not in self.begins:
            suffix = suffix[1:]
        state[byte] = self.state(suffix)
        return state[byte]

    def found(self, state: dict, last: list[int]) -> int:
        """The token that ends here, if none is known to."""
        if self.pairs >= PAIRS:
            self.pairs = 0
            for known in self.follows:
                known.clear()
        for size, known, token in state[-1]:
            if self.may_follow(last[-size], token):
                known.add(last[-size])
                self.pairs += 1
                return token
        raise ValueError(f"no token ends {state[-2]!r}; the vocabulary lacks a byte")

    def encode(self, data: bytes) -> bytes:
        """The ids of one piece of text."""
        state, out = self.root, []
        last = [-1]  # the register: the last token at each position since the last that was emitted, which comes first
        for at in range(0, len(data), EMIT):
            for byte in data[at : at + EMIT]:
                state = state.get(byte) or self.arc(state, byte)
                for size, known, token in state[-1]:
                    if last[-size] in known:  # only one token can end here
                        last.append(token)
                        break
                else:
                    last.append(self.found(state, last))
            self.emit(last, len(state[-2]) if at + EMIT < len(data) else 0, out)
        return b"".join(out)

    def emit(self, last: list[int], back: int, out: list[bytes]) -> None:
        """Emits the tokens that the tokenizations of the last `back` positions and of the end have in common."""
        end = len(last) - 1
        if back:
            live = set(range(end - back, end + 1))
            while len(live) > 1:  # the furthest steps back over its last token until all meet
                end = max(live)
                live.remove(end)
                live.add(end - self.sizes[last[end]])
            end = live.pop()
        at, tail = end, []
        while at > 0:
            tail.append(self.packed[last[at]])
            at -= self.sizes[last[at]]
        out.extend(reversed(tail))
        del last[:end]


class Utf8:
    """An incremental UTF-8 machine: the state is the head of a character whose rest has not come yet."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        """Whole characters so far. What cannot be UTF-8 becomes U+FFFD; so does a held head at the end."""
        data = self.held + data
        keep = 0
        if not final:
            for back in range(1, min(4, len(data) + 1)):
                byte = data[-back]
                if byte >= 0xC0:  # a lead byte: held while fewer bytes stand here than it asks for
                    need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                    keep = back if need > back else 0
                    break
                if byte < 0x80:
                    break
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")


class _Pieces(dict):
    """Stretches of text to packed ids; bounded. `spaced` holds them by what stands after their first space."""

    def __init__(self, transducer: Transducer, split, before: str = ""):
        self.encode, self.split, self.before = transducer.encode, split, before
        if not before:
            self.spaced = _Pieces(transducer, split, " ")

    def __missing__(self, stretch: str) -> bytes:
        whole = self.before + stretch
        if stretch.isascii() and stretch.isalpha():
            ids = self.encode(whole.encode())
        else:
            ids = b"".join([self.encode(piece.encode()) for piece in self.split(whole)])
        if len(self) >= WORDS:
            self.clear()
        if len(stretch) < 64:
            self[stretch] = ids
        return ids


class Codec:
    """Splits texts by a pattern, encodes each match and decodes ids."""

    _made: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.transducer = Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self.transducer, self.split)
        self.loose = re.compile(r"\s ").search
        self.cut = re.compile(r"(?<=\S)(?= )").split

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        """One for each worker."""
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def encode(self, text: str) -> bytes:
        """No match of the pattern goes on past a space after something else than white space: the text is cut there, and what stands between two cuts is split and encoded once."""
        if self.loose(text):
            return b"".join(map(self.pieces.__getitem__, self.cut(text)))
        first, *others = text.split(" ")
        return self.pieces[first] + b"".join(map(self.pieces.spaced.__getitem__, others)) if first or others else b""

    def decode(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """The text of the ids, as it becomes known."""
        ids, machine, token = list(ids), Utf8(), self.transducer.tokens.__getitem__
        for at in range(0, len(ids), block):
            yield machine.feed(b"".join(map(token, ids[at : at + block])))
        yield machine.feed(b"", final=True)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and with keep_ids also ids and the decoded text.

    Null and empty texts: no tokens. Repeated rows: a row each. Other columns are neither read nor returned.
    No shuffle: a row is encoded where it is read, and a worker holds bounded tables only.
    """
    if path is None:
        path, own = default_vocabulary()
        pattern = pattern or own
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if keep_ids else "")
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())] if keep_ids else []

    def run(batches):
        codec = Codec.of(path, pattern)
        for batch in batches:
            rows = []
            for doc, raw in zip(batch["doc_id"].to_pylist(), batch["data"]):
                packed = codec.encode(raw.as_py().decode("utf-8", "replace"))
                ids = np.frombuffer(packed, "<u4").tolist()
                whole, kept = hashlib.sha256(), []
                for part in codec.decode(ids):
                    whole.update(part.encode())
                    if keep_ids:
                        kept.append(part)
                rows.append((doc, len(ids), hashlib.sha256(packed).hexdigest(), whole.hexdigest(), *((ids, "".join(kept)) if keep_ids else ())))
            columns = list(zip(*rows)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("data"))
    return written(rows.mapInArrow(run, schema), scratch(docs.sparkSession, "bpe") + "/documents")
