"""Token counts under a unigram vocabulary, by a trie whose nodes hold forward scores."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm.common import pieces

MARK = "▁"
NODES = 1_000_000
DEPTH = 1_024
#: Words whose counts a task keeps, and the longest of them in bytes.
KNOWN_WORDS = 400_000
KNOWN_LENGTH = 64
_HALF = 1 << 32
MICRO = 1_000_000


def unigram_scores(model_file: str) -> dict[str, int]:
    """Pieces of a sentencepiece model file with scores in millionths of a natural logarithm.

    The installed files rank their pieces; by Zipf's rule a piece of rank r gets -log(r + 1). Whole
    numbers keep ties exact. Control, unknown and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -round(MICRO * math.log(rank + 2)) for rank, i in enumerate(ids)}


class Trie:
    """Best segmentations of words, shared by prefix.

    A node stands for a prefix and holds the state of its best segmentation (greatest sum of piece
    scores, then fewest tokens): the score, minus the tokens, and how many of those are bytes, as one whole
    number of score * 2^64 - tokens * 2^32 + bytes, so that states add up and compare part by part. A character always
    may be written as its UTF-8 bytes, each scored one below the worst piece. A new word computes its
    new nodes only; what stands at its last node is its count. A word of over DEPTH characters goes on
    from its node at that depth with the states of the last `longest` characters, which are dropped
    again, so no word adds more than DEPTH nodes and the trie holds NODES + DEPTH at most.
    """

    def __init__(self, scores: dict[str, int]):
        # What a piece may end with: the step of the piece, or 0 if it is none itself.
        steps = {piece: (own * _HALF - 1) * _HALF for piece, own in scores.items()}
        self.tails = {piece[at:]: 0 for piece in scores for at in range(len(piece))} | steps
        self.longest = max(map(len, scores), default=0)
        byte = min(scores.values(), default=0) - MICRO
        self.spelt = [((width * byte) * _HALF - width) * _HALF + width for width in range(5)]
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best = [0]
        self.word, self.path, self.states = "", [0], [0]  # the word before, its nodes and their states

    def _next(self, states: list | deque, word: str, end: int) -> int:
        """State of the prefix that ends at `end`, from the states of the prefixes right before it.

        Looks back as long as what it passes may end a piece.
        """
        letter, tail = word[end - 1], self.tails.get
        found = states[-1] + self.spelt[1 if letter < "\x80" else len(letter.encode("utf-8", "surrogatepass"))]
        for back in range(1, min(len(states), self.longest) + 1):
            step = tail(word[end - back : end])
            if step is None:
                break
            if step and states[-back] + step > found:
                found = states[-back] + step
        return found

    def insert(self, word: str) -> tuple[int, int]:
        """Tokens and byte tokens of a word; what follows its first DEPTH characters makes no nodes."""
        if len(self.best) > NODES:
            self.clear()
        children, best, path, states = self.children, self.best, self.path, self.states
        head = word[:DEPTH]
        shared = 0  # nodes of the word before serve again as far as the words agree
        for letter, before in zip(head, self.word, strict=False):
            if letter != before:
                break
            shared += 1
        del path[shared + 1 :], states[shared + 1 :]
        self.word, node, end = head, path[-1], shared
        known, tail, longest, spelt = children.get, self.tails.get, self.longest, self.spelt
        for letter in head[shared:]:
            end += 1
            key = node << 21 | ord(letter)
            node = known(key)
            if node is None:
                # as in `_next`, written out because most of the time is spent here
                found = states[-1] + spelt[1 if letter < "\x80" else len(letter.encode("utf-8", "surrogatepass"))]
                for at in range(end - 1, max(0, end - longest) - 1, -1):
                    step = tail(head[at:end])
                    if step is None:
                        break
                    if step:
                        other = states[at] + step
                        if other > found:
                            found = other
                node = children[key] = len(best)
                best.append(found)
            path.append(node)
            states.append(best[node])
        last = states[-1]
        if len(word) > DEPTH:
            # a piece reaches back `longest` characters at most, so a window of that many states will do
            recent = deque(states, maxlen=max(1, self.longest))
            for end in range(DEPTH + 1, len(word) + 1):
                recent.append(self._next(recent, word, end))
            last = recent[-1]
        return -(last >> 32) % _HALF, last % _HALF


class KnownWords(dict):
    """Counts of words in UTF-8 without their mark, tokens above the lowest 32 bits and bytes in them; starts anew when full.

    So a text's counts are one sum, and a word met again does not walk the trie; long words are not kept.
    """

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        tokens, spelt = self.trie.insert(MARK + word.decode())
        value = tokens << 32 | spelt
        if len(word) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = value
        return value

    def learn(self, words: set[bytes]) -> None:
        """Insert new words in order, so that one goes on where the word before it has led."""
        for word in sorted(words - self.keys()):
            self[word]


def token_counts(docs: DataFrame, scores: dict[str, int]) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_bytes) of every whole text.

    A pre-token is a word with the mark before it. A task inserts the pre-tokens of its texts in one trie,
    which starts anew at NODES nodes and takes DEPTH of one word at most, keeps the counts of up to KNOWN_WORDS
    words, and adds them up by document; no row leaves its partition. `scores`, bounded by the vocabulary, is broadcast. A null or blank
    text counts 0; repeated rows stay; an empty table gives an empty table; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownWords(Trie(shared.value))
        for batch in pieces(batches):
            # bytes.split cuts at the same six spaces as WORD
            texts = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            known.learn(set().union(*texts))
            sums = [sum(map(known.__getitem__, text)) for text in texts]
            counts = [len(text) for text in texts], [x >> 32 for x in sums], [x & 0xFFFFFFFF for x in sums]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in counts)],
                ["doc_id", "n_words", "n_tokens", "n_bytes"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_words long, n_tokens long, n_bytes long")
