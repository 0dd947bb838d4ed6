"""Token counts by a linear longest-match automaton.

A vocabulary is a trie. Each trie node has a failure link and the number of tokens that are popped on the way to it, so that a
word is read byte by byte, once: where the trie has no child, the popped tokens are counted and the failure link is followed.
This gives the number of greedy longest-match pieces without building one of them.

The vocabulary here is of words whose last token carries an end mark: the mark is one more symbol after the word's bytes.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidepool.llm.bytestext import slices, small_batches, utf8
from tidepool.llm.columns import taken

#: The symbol after a word's last byte.
END = 256
#: Words whose counts a task keeps.
REMEMBERED = 200_000
#: Letters, one digit, or other visible characters; English contractions by themselves.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def visible_bytes() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_vocabulary(path: str, end_mark: str = "</w>") -> list[tuple[int, ...]]:
    """The tokens of a byte-level vocabulary file as symbols; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    to_byte, out = visible_bytes(), []
    for token in model["model"]["vocab"]:
        if token in special:
            continue
        ended = token.endswith(end_mark) and len(token) > len(end_mark)
        symbols = [to_byte.get(c, -1) for c in (token[: -len(end_mark)] if ended else token)]
        if symbols and min(symbols) >= 0:
            out.append((*symbols, *[END] * ended))
    return out


class Automaton:
    """The trie with failure links. ``count`` gives the greedy pieces of one word.

    Each single byte counts as a token, so that every word can be read. An end mark that no longer token takes in costs nothing.
    """

    def __init__(self, vocabulary: Iterable[tuple[int, ...]]):
        self.children: list[dict[int, int]] = [{}]
        cost = {0: 0}
        for token in (*((b,) for b in range(256)), *vocabulary, (END,)):
            node = 0
            for symbol in token:
                below = self.children[node].get(symbol)
                if below is None:
                    below = self.children[node][symbol] = len(self.children)
                    self.children.append({})
                node = below
            cost[node] = int(token != (END,))
        self.fail, self.popped = [0] * len(self.children), [0] * len(self.children)
        level = [0]
        while level:
            next_level = []
            for node in level:
                for symbol, child in self.children[node].items():
                    next_level.append(child)
                    if child in cost:
                        self.popped[child] = cost[child]
                        continue
                    at, popped = self.fail[node], self.popped[node]
                    while symbol not in self.children[at]:
                        at, popped = self.fail[at], popped + self.popped[at]
                    self.fail[child], self.popped[child] = self.children[at][symbol], popped
            level = next_level

    def count(self, word: bytes, ended: bool = True) -> int:
        """Pieces of ``word``, its end mark included."""
        children, fail, popped = self.children, self.fail, self.popped
        node = total = 0
        for symbol in (*word, END) if ended else word:
            while (below := children[node].get(symbol)) is None:
                total += popped[node]
                node = fail[node]
            node = below
        while node:
            total += popped[node]
            node = fail[node]
        return total


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(read_vocabulary(path))


class Counter(dict):
    """Pieces of white-space-separated chunks, the commonest remembered."""

    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine = machine

    def __missing__(self, chunk: str) -> tuple[int, int]:
        words = WORD.findall(chunk)
        out = len(words), sum(self.machine.count(w.encode("utf-8")) for w in words)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = out
        return out


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: its id, n_words and n_tokens (greedy pieces of its lower-cased words, by the vocabulary file).

    Null and empty texts have none. Texts of any length are counted whole, an empty table gives an empty table. Repeated rows stay; other columns are
    neither read nor returned, whatever their names.
    """
    own = taken(docs, id=id_column, text=text)
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counter(automaton(vocabulary))
        for batch in slices(batches, 1):
            words, tokens = [], []
            for raw in batch.column(1):
                found = [known[c] for c in raw.as_py().decode("utf-8", "replace").lower().split()]
                words.append(sum(w for w, _ in found))
                tokens.append(sum(t for _, t in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[id_column, "n_words", "n_tokens"])

    return small_batches(own).select("id", utf8("text").alias("text")).mapInArrow(run, f"`{id_column}` {kind}, n_words long, n_tokens long")
