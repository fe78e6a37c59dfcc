"""Token counts of a unigram segmentation, shared along a trie of words.

The pieces and their order come from a public tokenizer file; a piece of rank r has the log
probability of Zipf's law, -log(r + 1), so nothing is trained. A word's segmentation is the one of the
highest sum. The best sum up to a character depends only on the characters before it, so the
distinct words are put into a trie, each trie node gets its forward score once from its ancestors,
and the node that ends a word holds the word's count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.words import distinct, slices, split_words

START = "▁"
MOST_NODES = 300_000
LONG_WORD = 64
PENALTY = 10.0


def load_pieces(path: str) -> dict[str, float]:
    """Log probability of each ordinary piece of a sentencepiece file, by its rank in the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return {p: -math.log(r + 1) for r, p in enumerate(ranked)}


class Trie:
    """Forward scores and token counts of all prefixes seen so far.

    A character that is no piece by itself stands for its UTF-8 bytes, one token each, at the score
    of the rarest piece less a penalty. Of equal sums the segmentation of fewer tokens counts. When
    the nodes reach their bound the trie starts again, which changes no count; words of more than
    LONG_WORD characters are scored without it.
    """

    def __init__(self, pieces: dict[str, float], most: int = MOST_NODES):
        self.pieces, self.most = pieces, most
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - PENALTY
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score = [0.0]
        self.tokens = [0]
        self.made = 0

    def _forward(self, text: str, end: int, scores, tokens) -> tuple[float, int]:
        """Best (sum, tokens) of text[:end], given those of all shorter prefixes."""
        pieces = self.pieces
        char = text[end - 1]
        own = pieces.get(char)
        if own is None:
            best, count = scores[end - 1] + self.unknown, tokens[end - 1] + len(char.encode())
        else:
            best, count = scores[end - 1] + own, tokens[end - 1] + 1
        for start in range(end - 2, max(-1, end - self.longest - 1), -1):
            found = pieces.get(text[start:end])
            if found is not None:
                total = scores[start] + found
                if total > best or (total == best and tokens[start] + 1 < count):
                    best, count = total, tokens[start] + 1
        return best, count

    def count(self, word: str) -> int:
        """Tokens of the start mark and the word."""
        text = START + word
        if len(text) > LONG_WORD:
            scores, tokens = [0.0], [0]
            for end in range(1, len(text) + 1):
                s, t = self._forward(text, end, scores, tokens)
                scores.append(s)
                tokens.append(t)
            return tokens[-1]
        if len(self.score) + len(text) > self.most:
            self.clear()
        node, scores, tokens, child = 0, [0.0], [0], self.child
        for end, char in enumerate(text, 1):
            key = node * 0x110000 + ord(char)
            node = child.get(key, 0)
            if node:
                scores.append(self.score[node])
                tokens.append(self.tokens[node])
                continue
            s, t = self._forward(text, end, scores, tokens)
            node = child[key] = len(self.score)
            self.score.append(s)
            self.tokens.append(t)
            self.made += 1
            scores.append(s)
            tokens.append(t)
        return tokens[-1]


_TRIES: dict[str, Trie] = {}


def trie_of(path: str) -> Trie:
    """One trie per Python worker and file, kept from task to task."""
    if path not in _TRIES:
        _TRIES[path] = Trie(load_pieces(path))
    return _TRIES[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_tokens.

    Words are runs without ASCII white space; each is a pre-token with a start mark. Null, empty and
    blank texts have no words and no tokens. No shuffle: the trie is that of the words a task meets.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(path)
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                codes, entries = distinct(words.words)
                each = np.fromiter((trie.count(w.decode()) for w in entries), np.int64, len(entries))
                upto = np.concatenate([[0], np.cumsum(each[codes])])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.array(upto[words.first[1:]] - upto[words.first[:-1]]),
                    ],
                    ["id", "n_words", "n_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(work, f"id {kind}, n_words long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_words", "n_tokens")
