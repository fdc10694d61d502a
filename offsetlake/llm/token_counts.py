"""Token counts by dynamic programming over a trie of pre-tokens, with the prefix work shared."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from offsetlake.llm.blocks import SPACE_WORDS, blocks
from offsetlake.llm.repeats import among
from offsetlake.llm.scratch import fresh

MAX_VOCABULARY_BYTES = 64 << 20
MAX_KNOWN = 600_000
TRIE_CHARS = 64  # a longer pre-token is not put in the trie, but scored alone, so that no word's length costs memory
BATCH_WORDS = 20_000
MARK = "▁"  # fixed value: how pieces write the blank before a word


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model file with unigram log-probabilities; the control, unknown and byte pieces are left out. Not trained, only read.

    A unigram model's own scores are taken. A BPE model has merge ranks instead, which are no probabilities; its pieces get those of Zipf's law by
    rank: p is proportional to 1 / (rank + 1), ranks counted from 0 by falling score, then piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    if sum(len(p.encode()) + 8 for p in pieces) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has more than {MAX_VOCABULARY_BYTES} bytes")
    return zipf(pieces) if all(float(v).is_integer() for v in pieces.values()) else pieces


def zipf(ranked: dict[str, float]) -> dict[str, float]:
    """Log-probabilities by Zipf's law over the order of the scores."""
    order = sorted(ranked, key=lambda p: (-ranked[p], p))
    total = sum(1 / (k + 1) for k in range(len(order)))
    return {p: -math.log((k + 1) * total) for k, p in enumerate(order)}


class Trie:
    """Prefixes of distinct pre-tokens; each has the best unigram score of a segmentation and that segmentation's token count.

    The trie of a batch is built level by level, by array operations over all prefixes of one length: a prefix that words share is one node and
    scored once. A node carries the pieces that are begun and not ended there, as states of the pieces' own trie with the score and count where
    they began. A character that no piece covers costs `unknown` and counts a token for each of its UTF-8 bytes. Of equal scores, fewer tokens win.
    """

    def __init__(self, pieces: dict[str, float]):
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.step: dict[int, int] = {}  # state << 21 | character -> state
        ends, n = {}, 1
        for piece, score in pieces.items():
            state = 0
            for char in piece:
                key = state << 21 | ord(char)
                state = self.step.get(key, n)
                if state == n:
                    self.step[key] = n
                    n += 1
            ends[state] = score
        moves = np.fromiter(self.step, np.int64, len(self.step))
        order = np.argsort(moves)
        self.moves, self.to = moves[order], np.fromiter(self.step.values(), np.int64, len(self.step))[order]
        self.value = np.full(n, -np.inf)
        self.value[list(ends)] = list(ends.values())
        self.values = self.value.tolist()

    def tokens(self, word: str) -> int:
        return int(self.counts([word])[0])

    def counts(self, words: list[str]) -> np.ndarray:
        """Token counts of the pre-tokens."""
        out, size = np.zeros(len(words), np.int64), np.array([len(w) for w in words], np.int64)
        for k in np.flatnonzero(size > TRIE_CHARS).tolist():
            out[k] = self.long(words[k])
        held = np.flatnonzero((size > 0) & (size <= TRIE_CHARS))
        held = held[np.argsort(-size[held], kind="stable")]  # the words that go on are always the first ones
        if not len(held):
            return out
        size = size[held]
        text = np.zeros((len(held), int(size[0])), np.int64)
        text[np.arange(text.shape[1]) < size[:, None]] = np.frombuffer("".join([words[k] for k in held.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
        place, best, fewest = np.zeros(len(held), np.int64), np.zeros(1), np.zeros(1, np.int64)  # each word's node; each node's score and count
        node, state, score, count = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64)  # begun pieces, sorted by node
        for level in range(text.shape[1]):
            live = int(np.searchsorted(-size, -level))  # words of more than `level` characters
            keys, place = np.unique(place[:live] << 21 | text[:live, level], return_inverse=True)
            parent, char = keys >> 21, keys & (1 << 21) - 1
            first = np.searchsorted(node, np.arange(len(best) + 1))
            each = np.diff(first)[parent]
            own = np.repeat(np.arange(len(keys)), each)
            source = np.arange(len(own)) + np.repeat(first[parent] - (np.cumsum(each) - each), each)
            move = state[source] << 21 | char[own]
            at = np.searchsorted(self.moves, move)
            at[at == len(self.moves)] = 0
            going = self.moves[at] == move if len(self.moves) else np.zeros(len(move), bool)
            own, source = own[going], source[going]
            state, score, count = self.to[at[going]], score[source], count[source]
            best, fewest = best[parent] + self.unknown, fewest[parent] + 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
            total = score + self.value[state]
            ended = np.flatnonzero(total > -np.inf)
            if len(ended):
                total, where = total[ended], own[ended]
                cut = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
                high = np.maximum.reduceat(total, cut)
                tokens = np.minimum.reduceat(np.where(total == np.repeat(high, np.diff(np.append(cut, len(ended)))), count[ended] + 1, np.iinfo(np.int64).max), cut)
                where = where[cut]
                better = (high > best[where]) | ((high == best[where]) & (tokens < fewest[where]))
                best[where[better]], fewest[where[better]] = high[better], tokens[better]
            done = int(np.searchsorted(-size, -(level + 1)))
            out[held[done:live]] = fewest[place[done:live]]
            order = np.argsort(np.concatenate((own, np.arange(len(keys)))), kind="stable")
            node = np.concatenate((own, np.arange(len(keys))))[order]
            state, score, count = np.concatenate((state, np.zeros(len(keys), np.int64)))[order], np.concatenate((score, best))[order], np.concatenate((count, fewest))[order]
        return out

    def long(self, word: str) -> int:
        """The count of one pre-token of any length, holding the begun pieces only."""
        step, value, begun, best, fewest = self.step, self.values, [], 0.0, 0
        for char in word:
            begun.append((0, best, fewest))
            code, now = ord(char), []
            best, fewest = best + self.unknown, fewest + 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            for n, s, c in begun:
                n = step.get(n << 21 | code)
                if n is not None:
                    now.append((n, s, c))
                    total = s + value[n]
                    if total > best or (total == best and c + 1 < fewest):
                        best, fewest = total, c + 1
            begun = now
        return fewest


def count_tokens(docs: DataFrame, pieces: dict[str, float], text_col: str = "text") -> DataFrame:
    """All columns, then n_pretokens and n_tokens (underscores where docs has such names; always the last two).

    Pre-tokens are words without blanks, with the word mark in front; a pre-token's tokens are its best segmentation by the sum of the pieces' scores.
    Each task puts its distinct pre-tokens in tries of BATCH_WORDS at most, and keeps the counts at the terminals; these are
    dropped when there are more than MAX_KNOWN, which costs time only. A pre-token of more than TRIE_CHARS characters is scored alone.

    Defined results: null and blank texts have 0 and 0; equal texts equal counts; an empty table no rows; an empty vocabulary one token a byte.
    """
    names = [fresh("n_pretokens", docs.columns), fresh("n_tokens", docs.columns)]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        known, held = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of the terminals, and their counts
        for batch in batches:
            words, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for b in blocks(batch.column(place), SPACE_WORDS, fold=False):
                keys, where, number = np.unique(b.hashes(), return_index=True, return_inverse=True)
                if len(known) > MAX_KNOWN:
                    known, held = known[:0], held[:0]
                new = np.flatnonzero(~among(keys, known))
                raw = b.data.tobytes()
                for low in range(0, len(new), BATCH_WORDS):
                    part = new[low : low + BATCH_WORDS]
                    at = where[part]
                    counts = trie.counts([MARK + raw[i:j].decode("utf-8", "replace") for i, j in zip(b.start[at].tolist(), b.end[at].tolist(), strict=True)])
                    known = np.concatenate((known, keys[part]))
                    held = np.concatenate((held, counts))
                    order = np.argsort(known, kind="stable")
                    known, held = known[order], held[order]
                own = held[np.searchsorted(known, keys)]
                total = np.concatenate(([0], np.cumsum(own[number])))
                words.append(np.diff(b.first))
                tokens.append(total[b.first[1:]] - total[b.first[:-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(words)), pa.array(np.concatenate(tokens))], names=schema.names)

    return docs.mapInArrow(count, schema)
