"""Operator 2: token counts by a linear longest-match automaton (LinMaxMatch; Song et al., EMNLP 2021).

The vocabulary's pieces form a trie with two roots: pieces that begin a word and pieces that go on. Each state has a failure link
to the state in which matching goes on after the longest pieces have been popped, and the number of those pieces; so a
word's greedy pieces are counted in one pass over its characters, without building or comparing them.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import map_batches

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
_BEGIN = "▁"
#: Words whose counts a task remembers.
REMEMBERED = 200_000


def vocabulary(path: str = TOKENIZER) -> list[str]:
    """The pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]


class Automaton:
    """State 0 begins a word (the begin mark is consumed), state 1 goes on within one."""

    def __init__(self, pieces: list[str]):
        self.go: list[dict[str, int]] = [{}, {}]
        self.fail, self.popped = [-1, -1], [0, 0]
        token = {0: False, 1: False}
        for piece in pieces:
            begins = piece.startswith(_BEGIN)
            state = 0 if begins else 1
            for c in piece[begins:]:
                following = self.go[state].setdefault(c, len(self.go))
                if following == len(self.go):
                    self.go.append({})
                    token[following] = False
                state = following
            token[state] = True
        n = len(self.go)
        self.fail, self.popped = [-1] * n, [0] * n
        if token[0]:  # a bare begin mark is a piece, so a word's start can always be popped
            self.fail[0], self.popped[0] = 1, 1
        queue = deque((0, 1))
        while queue:
            u = queue.popleft()
            for c, v in self.go[u].items():
                if token[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, count = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.go[z]:
                        count += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.go[z][c], count
                queue.append(v)

    def count(self, word: str) -> int:
        """Greedy pieces of a word; a character that nothing matches ends the match and counts as its UTF-8 bytes."""
        go, fail, popped = self.go, self.fail, self.popped
        state, total = 0, 0
        for c in word:
            following = go[state].get(c)
            while following is None:
                total += popped[state]
                state = fail[state]
                if state < 0:
                    break
                following = go[state].get(c)
            if following is None:
                total += len(c.encode("utf-8", "surrogatepass"))
                state = 1
            else:
                state = following
        while state > 1:
            total += popped[state]
            state = fail[state]
        return total + (popped[0] if state == 0 else 0)


def count_tokens(docs: DataFrame, path: str = TOKENIZER, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_chars, n_tokens) of every row; words are separated by Unicode white space.

    Null and empty texts have 0; a null key stays null; texts of any length are counted whole; repeated rows are alike; an
    empty table gives no rows. Other columns are not read. The tokenizer file is read on the driver, and the
    automaton, whose size the vocabulary bounds, is sent to the tasks.
    """
    machine = Automaton(vocabulary(path))
    sent = docs.sparkSession.sparkContext.broadcast((machine.go, machine.fail, machine.popped))
    rows = docs.select(key, text)
    schema = T.StructType([rows.schema.fields[0], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_chars", "n_tokens"))])
    names = schema.names

    def run(batches):
        own = Automaton([])
        own.go, own.fail, own.popped = sent.value
        known: dict[str, int] = {}
        for batch in batches:
            words_of, chars, tokens = [], [], []
            for value in batch.column(1):
                whole = value.as_py() or ""
                words, total = whole.split(), 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = own.count(w)
                        if len(known) < REMEMBERED:
                            known[w] = n
                    total += n
                words_of.append(len(words))
                chars.append(len(whole))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words_of, chars, tokens))], names)

    return map_batches(rows, run, schema)
