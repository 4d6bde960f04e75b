"""Token counts by trie-shared dynamic programming.

A pre-token's best unigram segmentation is a forward recursion over its
prefixes, so pre-tokens with a common prefix share that part. A worker inserts
distinct pre-tokens in a trie that it keeps; a node's forward score is computed
once, when the first pre-token passes it, and a terminal's token count is stored.
Texts then add up stored counts.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import column, per_worker, slices, texts

VOCABULARY = "piece_bpe_32k.model"
CACHE_WORDS = 700_000
#: Trie nodes that a worker keeps, some 130 bytes each.
TRIE_NODES = 1_500_000
BATCH_ROWS = 1000
WORD_START = "▁"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def zipf_scores(path: str) -> dict[str, float]:
    """Log-probabilities of a vocabulary's text pieces by the rank it lists them in."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {p: -math.log(rank + 2.0) for rank, p in enumerate(pieces)}


class TrieCounter:
    """Tokens of a pre-token's best segmentation; of equal scores, the fewest tokens.

    The trie's nodes hold the best score and its token count of the prefix they
    stand for, and stay from batch to batch: a prefix is scored when a pre-token
    first has it. Nodes beyond TRIE_NODES are worked out but not kept, so a full
    trie costs time, not results. A character that no piece covers falls back to
    its UTF-8 bytes, a token each.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores))
        self.byte = min(scores.values()) - 10.0
        self.known: dict[bytes, int] = {}
        self.child: dict[int, int] = {}  # node and character to node
        self.best, self.count = array("d", [0.0]), array("l", [0])

    def forward(self, text: str, best: list[float], count: list[int]) -> None:
        """Score the first prefix of text that best and count lack, from those they have."""
        scores, end = self.scores, len(best)
        size = len(text[end - 1].encode("utf-8"))
        top, n = best[end - 1] + size * self.byte, count[end - 1] + size
        for start in range(max(0, end - self.longest), end):
            score = scores.get(text[start:end])
            if score is not None:
                score += best[start]
                if score > top or score == top and count[start] + 1 < n:
                    top, n = score, count[start] + 1
        best.append(top)
        count.append(n)

    def insert(self, text: str) -> int:
        """Tokens of text, whose prefixes enter the trie."""
        child, held_best, held_count = self.child, self.best, self.count
        node, best, count = 0, [0.0], [0]
        for c in text:
            key = node << 21 | ord(c)
            known = child.get(key) if node >= 0 else None
            if known is not None:
                node = known
                best.append(held_best[node])
                count.append(held_count[node])
                continue
            self.forward(text, best, count)
            if node >= 0 and len(held_best) < TRIE_NODES:
                child[key] = node = len(held_best)
                held_best.append(best[-1])
                held_count.append(count[-1])
            else:
                node = -1
        return count[-1]

    def learn(self, words: Iterable[bytes]) -> None:
        for word in words:
            self.known[word] = self.insert(WORD_START + word.decode("utf-8"))

    def __call__(self, batch: list[bytes | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        parts = [t.split() if t else [] for t in batch]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        self.learn({w for words in parts for w in words if w not in self.known})
        get = self.known.__getitem__
        return [(len(words), sum(map(get, words))) for words in parts]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker(f"trie {path}", lambda: TrieCounter(zipf_scores(path)))
        for batch in slices(batches, BATCH_ROWS):
            found = np.array(counter(texts(batch)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["doc_id", "n_pretokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens.

    Pre-tokens are `[^\\x20\\x09-\\x0D]+`, each with a word-start mark before it.
    Null and empty texts count 0; repeated rows count alike; an empty table gives
    no rows. Columns other than doc_id and text are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(_count(path or vocabulary_path()), "doc_id long, n_pretokens long, n_tokens long")
