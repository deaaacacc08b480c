"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The model is a public vocabulary whose piece of rank r has probability proportional to 1 / (r + `SHIFT`)
(Zipf's law; the files hold ranks, not counts).  A pre-token is a white-space word with the vocabulary's word mark before it.

Distinct pre-tokens are inserted in a trie.  A node stands for a prefix and holds its forward scores, computed when the
node is made and so once for all pre-tokens that share the prefix: the best segmentation's log
probability, its number of pieces (the fewest among equally probable ones), and the log of the summed
probability of all segmentations.  A pre-token's terminal node has its counts; a document's are sums over its words.
Characters that no piece covers are spelt in byte pieces.

Every task keeps its own trie, so nothing is shuffled.  A trie of over `NODES` nodes is started afresh, inside a text too
(every `RUN` words); words of over `LONG` characters, which hardly share prefixes, are scored by a forward pass of their own that
keeps only the last scores that a piece can reach back to.  So neither a text nor a word of any length takes more memory than its words.

Defined results: null and empty texts have no words, no tokens and log probability 0; repeated rows are
counted alike; other columns are not read; empty tables give empty results.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, texts

VOCABULARY = "piece_bpe_32k.model"
SHIFT = 2.7
NODES, LONG, RUN = 800_000, 64, 100_000
MARK = "▁"


class Vocabulary:
    """Log probabilities of pieces, and of a character spelt in bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte = {}, {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = i
        ranks = {p: r for r, p in enumerate(sorted(pieces, key=pieces.get))}
        log_z = math.log(sum(1 / (r + SHIFT) for r in range(len(ranks) + 1)))
        self.scores = {p: -math.log(r + SHIFT) - log_z for p, r in ranks.items()}
        #: All byte pieces share one more rank, the last.
        self.byte = -math.log(len(ranks) + SHIFT) - log_z - math.log(256)
        #: Every ending of a piece: its score if it is a piece itself, else None.  Strings not here end no piece.
        self.longest = max(map(len, self.scores))
        self.endings: dict[str, float | None] = {p[k:]: None for p in self.scores for k in range(len(p))} | self.scores

    def spelt(self, char: str) -> tuple[float, int]:
        n = len(char.encode("utf-8", "surrogatepass"))
        return n * self.byte, n


class _Last(list):
    """A table of the last places alone: place k stands at k modulo its length."""

    def __getitem__(self, at: int):
        return list.__getitem__(self, at % len(self))

    def __setitem__(self, at: int, value) -> None:
        list.__setitem__(self, at % len(self), value)


def alone(vocabulary: Vocabulary, token: str) -> tuple[int, float]:
    """(pieces, log of the summed probability) of one token, in tables of as many places as a piece is long."""
    trie, size = Trie(vocabulary), vocabulary.longest + 1
    trie.best, trie.pieces, trie.total = (_Last([x] * size) for x in (0.0, 0, 0.0))
    for end in range(1, len(token) + 1):
        trie.best[end], trie.pieces[end], trie.total[end] = trie.scores(token, end, range(end))
    return trie.pieces[len(token)], trie.total[len(token)]


class Trie:
    """Prefixes of pre-tokens with their forward scores."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.pieces, self.total = [0.0], [0], [0.0]

    def insert(self, token: str) -> int:
        """The terminal node of a pre-token."""
        path, child = [0], self.child
        for k, char in enumerate(token):
            node = child.get((path[-1], char))
            if node is None:
                best, pieces, total = self.scores(token, k + 1, path)
                node = child[path[-1], char] = len(self.best)
                self.best.append(best)
                self.pieces.append(pieces)
                self.total.append(total)
            path.append(node)
        return path[-1]

    def scores(self, token: str, end: int, path) -> tuple[float, int, float]:
        """Of token[:end]: the best log probability, its pieces, the log of all; path[k] is where those of token[:k] stand."""
        best, count, sums, start = -math.inf, 0, [], end - 1
        endings, bests, pieces, totals = self.vocabulary.endings, self.best, self.pieces, self.total
        single = False
        while start >= 0:
            s = endings.get(token[start:end], 0)
            if s == 0:
                break
            if s is not None:
                at = path[start]
                here, n = bests[at] + s, pieces[at] + 1
                if here > best or (here == best and n < count):
                    best, count = here, n
                sums.append(totals[at] + s)
                single = single or start == end - 1
            start -= 1
        if not single:  # the last character alone is no piece
            s, n = self.vocabulary.spelt(token[end - 1])
            at = path[end - 1]
            here, n = bests[at] + s, pieces[at] + n
            if here > best or (here == best and n < count):
                best, count = here, n
            sums.append(totals[at] + s)
        top = max(sums)
        return best, count, top + math.log(sum([math.exp(x - top) for x in sums])) if len(sums) > 1 else top


class Counter(dict):
    """Word to place in the lists of token counts and log probabilities."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self.trie, self.tokens, self.logs = Trie(self.vocabulary), [], []

    def __missing__(self, word: str) -> int:
        if len(word) <= LONG:
            node = self.trie.insert(MARK + word)
            self.tokens.append(self.trie.pieces[node])
            self.logs.append(self.trie.total[node])
            self[word] = len(self.tokens) - 1
        else:
            tokens, log = alone(self.vocabulary, MARK + word)
            self.tokens.append(tokens)
            self.logs.append(log)
        return len(self.tokens) - 1

    def count(self, text: str) -> tuple[int, int, float]:
        """(words, tokens, log probability) of a text."""
        words = text.split()
        tokens, logs = 0, []
        for at in range(0, len(words), RUN):
            places = list(map(self.__getitem__, words[at : at + RUN]))
            tokens += sum(map(self.tokens.__getitem__, places))
            logs.append(math.fsum(map(self.logs.__getitem__, places)))
            if len(self.trie.best) > NODES or len(self.tokens) > NODES:
                self.fresh()
        return len(words), tokens, math.fsum(logs)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, log_prob) for every document."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        counter = Counter(Vocabulary(path))
        for b in batches:
            rows = [counter.count(t) for t in b.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["doc_id", "n_words", "n_tokens", "log_prob"])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long, log_prob double")
