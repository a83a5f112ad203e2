"""Token counts under a unigram model, with the dynamic programme shared over a trie.

Pieces come from a public sentencepiece vocabulary. Its file ranks pieces and has no probabilities, so a piece's
probability is taken to fall as 1 / (rank + 1). A pre-token is a word with the mark of a word's beginning before it; its
score is that of its best segmentation into pieces, with fewer tokens among equals. A character that no piece covers is
its UTF-8 bytes, a token each.

The distinct pre-tokens of a batch are walked in sorted order, that is in the order of the trie that they make:
forward scores are kept per depth, and a node that two words share is scored once. Which pieces end at a node comes from
a lazily determinised automaton over the pieces. Counts are stored for the terminal nodes.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, scratch, written

MARK, REMEMBERED = "▁", 250_000


class Trie:
    """Forward scores of words; pieces: text to log probability."""

    def __init__(self, pieces: dict[str, float], byte: float):
        self.pieces, self.byte = pieces, byte
        self.begins = {p[:k] for p in pieces for k in range(len(p) + 1)}
        self.states: dict[str, dict] = {}
        self.root = self.state("")

    def state(self, suffix: str) -> dict:
        """Arcs by character; at "" the pieces that the suffix ends in: size, log probability, tokens."""
        if suffix not in self.states:
            self.states[suffix] = {"": [(size, self.pieces[suffix[-size:]], 1) for size in range(len(suffix), 0, -1) if suffix[-size:] in self.pieces], "suffix": suffix}
        return self.states[suffix]

    def arc(self, state: dict, char: str) -> dict:
        suffix = state["suffix"] + char
        while suffix not in self.begins:
            suffix = suffix[1:]
        to = self.state(suffix)
        if char not in self.pieces:
            if not suffix:  # a character that begins no piece: a state of its own, not to be gone on from
                to = {"": [], "suffix": ""}
            size = len(char.encode())
            to = dict(to) | {"": [*to[""], (1, size * self.byte, size)]}
        state[char] = to
        return to

    def count(self, words: list[str]) -> dict[str, tuple[int, float]]:
        """Tokens and log probability of each of the distinct words."""
        out, before = {}, ""
        states, best, tokens = [self.root], [0.0], [0]
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :], best[shared + 1 :], tokens[shared + 1 :]
            state = states[-1]
            for char in word[shared:]:
                state = state.get(char) or self.arc(state, char)
                top, fewest = -math.inf, 0
                for size, score, n in state[""]:
                    score += best[-size]
                    if score > top or score == top and tokens[-size] + n < fewest:
                        top, fewest = score, tokens[-size] + n
                states.append(state)
                best.append(top)
                tokens.append(fewest)
            out[word] = tokens[-1], best[-1]
            before = word
        return out


_made: dict[str, Trie] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str) -> Trie:
    """One for each worker."""
    if path not in _made:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks = {p.id_to_piece(i): i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}
        total = math.log(sum(1 / (i + 1) for i in ranks.values()))
        # bytes are as likely as the last piece
        _made[path] = Trie({t: -math.log(i + 1) - total for t, i in ranks.items()}, -math.log(p.get_piece_size() + 1) - total)
    return _made[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, log_prob of every row: words are separated by ASCII white space.

    Null and blank texts: 0 tokens, 0.0. Bytes that are not UTF-8 count as U+FFFD. Repeated rows: a row each. No shuffle;
    a worker holds one batch's distinct words and a bounded store of words that it has met.
    """
    path = path or default_vocabulary()

    def run(batches):
        trie, known = load(path), {}
        for batch in batches:
            texts = [raw.as_py().split() for raw in batch["data"]]
            new = set().union(*texts).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known = {}
                new = set().union(*texts)
            words = {w: MARK + w.decode("utf-8", "replace") for w in new}
            told = trie.count(list(set(words.values())))
            known.update((w, told[t]) for w, t in words.items())
            tokens, scores = [], []
            for text in texts:
                got = [known[w] for w in text]
                tokens.append(sum([n for n, _ in got]))
                scores.append(math.fsum([s for _, s in got]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(list(map(len, texts)), pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "n_tokens", "log_prob"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("data"))
    return written(rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, log_prob double"), scratch(docs.sparkSession, "tokens") + "/documents")
