"""Token counts: a stored table of the exact count of every prefix of a text.

The vocabulary has no piece that holds a word separator after another character, so no merge
crosses the start of a word: a prefix that ends inside a word has the tokens of all words before it
and those of the piece of that word. Inside a word the counts come from a dynamic program: the
tokens of a prefix are those of a shorter prefix and one more piece, and of the pieces that end
here the right one is that which the model does not merge or cut differently after the last token
of the shorter prefix. The program's count of each word is held against the library's; words are worked out once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminode.llm.common import replaced

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: Distinct words, and pairs of pieces, remembered by a task; beyond them the memory starts anew.
CACHE_WORDS, CACHE_PAIRS = 400_000, 1_000_000
#: Texts whose words are worked out together.
TEXTS = 512
#: More than any number of a piece: two of them make one key.
PIECES = 1 << 20
#: The model writes a blank as this sign and reads the sign as a blank.
BLANK = "▁"
#: A letter of no piece, so that nothing merges with it: what follows is encoded as after a border.
BORDER = "\U000f0000"


def load_sentencepiece(name: str):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    inner = any(BLANK in model.id_to_piece(i).lstrip(BLANK) for i in range(model.get_piece_size()))
    if inner:
        raise ValueError(f"{name} has pieces across word starts; prefix counts would not add up")
    return model


class PrefixCounter:
    """Exact token counts of all prefixes of a text, as one small number per code point."""

    split = re.compile(f"[ {BLANK}]+[^ {BLANK}]*")

    def __init__(self, model):
        self.model = model
        plain = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.sizes = sorted(range(1, max(map(len, self.ids)) + 1), key=lambda n: (n > 3, (2, 3, 1).index(n) if n < 4 else n))
        #: sizes to try where so many letters of a token are there: those letters first
        self.tries = [(n, *(size for size in self.sizes if size != n)) for n in range(max(self.sizes) + 1)]
        self.pieces = [""] * model.get_piece_size()
        for piece, i in self.ids.items():
            self.pieces[i] = piece
        self.after_border = len(model.encode(BORDER))
        self.steps: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def words(self, text: str) -> list[str]:
        """Words without their first blank, which the model adds by itself to what it encodes."""
        if not text:
            return []
        if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in self.split.findall(f" {text}")]
        return text.split(" ")

    def stays(self, left: int, right: int) -> bool:
        """Whether the library leaves two neighbouring pieces, not met before, as they are."""
        found = self.pairs[left * PIECES + right] = self.model.EncodeAsIds(BORDER + self.pieces[left] + self.pieces[right])[self.after_border :] == [left, right]
        return found

    def extend(self, word: str, tokens: list[int], cells: list[int], last: list[int], steps: bytearray) -> None:
        """The program: goes on with the counts and last pieces of a word's prefixes, from those known.

        A prefix that ends with one of the word's tokens has the tokens up to there. Of the pieces
        that end at another place, the one that stays beside the last piece before it is the right
        one; mostly it is the first letters of the token. Words with letters spelled in bytes are
        worked out without tokens.
        """
        piece_id, pieces, pairs, known = self.ids.get, self.pieces, self.pairs.get, len(cells) - 1
        lengths = [len(pieces[t]) for t in tokens]
        if 0 in lengths or not tokens:
            tokens, lengths = [-1], [len(word) + 1]
        begin, before = 0, cells[-1]
        for k, (token, length) in enumerate(zip(tokens, lengths), 1):
            stop = begin + length
            if stop <= known:
                begin = stop
                continue
            for end in range(max(begin, known) + 1, min(stop, len(word)) + 1):
                if end == stop:
                    i, count = token, k
                else:
                    for size in self.tries[end - begin] if token >= 0 else self.sizes:
                        if size <= end:
                            i = piece_id(word[end - size : end])
                            if i is not None:
                                left = last[end - size]  # below 0: nothing merges with the start or with a letter spelled in bytes
                                fine = left < 0 or pairs(left * PIECES + i)
                                if fine is None:
                                    fine = self.stays(left, i)
                                if fine:
                                    count = cells[end - size] + 1
                                    break
                    else:  # no piece ends here: the letter is spelled in bytes
                        i, count = -1, before + len(word[end - 1].encode())
                steps.append(count - before & 255)
                cells.append(count)
                last.append(i)
                before = count
            begin = stop

    def learn(self, words: set[str]) -> None:
        """Works words out in their order, so that each goes on from the letters it shares with the one before."""
        new = words.difference(self.steps)
        if len(self.steps) + len(new) > CACHE_WORDS:
            self.steps.clear()
            new = words
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        left = sorted(new)
        whole = dict(zip(left, self.model.encode(left, num_threads=1))) if left else {}
        before, cells, last, steps = "", [0], [-1], bytearray()
        for word in left:
            full = BLANK + word.replace(" ", BLANK)
            n, most = 0, min(len(full), len(before))
            while n < most and full[n] == before[n]:
                n += 1
            del cells[n + 1 :], last[n + 1 :], steps[n:]
            self.extend(full, whole[word], cells, last, steps)
            before = full
            if word and cells[-1] != len(whole[word]):
                raise AssertionError(f"counts of {word[:80]!r} differ from the library's")
            self.steps[word] = bytes(steps)

    def tables(self, texts: list[str]) -> list[bytes]:
        """For each text the change of the count with each of its code points (8 bits, signed)."""
        words = [self.words(t) for t in texts]
        self.learn(set().union(*words))
        return [self.table(w) for w in words]

    def table(self, words: list[str]) -> bytes:
        if not words:
            return b""
        steps = np.frombuffer(b"".join(map(self.steps.__getitem__, words)), np.int8)
        out = steps[1:].copy()  # the model's own blank before the text is no code point of it
        out[:1] += steps[0]
        return out.tobytes()


def counts(table: bytes | None) -> np.ndarray:
    """Exact tokens of all prefixes, the empty one first, from a text's table."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(table or b"", np.int8), dtype=np.int64)])


def _udf(run, returns: str, argument: Column) -> Column:
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)(argument)


def prefix_table(df: DataFrame, text: str = "text", into: str = "prefixes", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds `into`: for each code point of the text, by how much it changes the number of tokens.

    Running sums are the exact token counts of all prefixes: tokens_in, prefix_within and
    tokens_between answer from the stored column, without encoding again. Null and empty texts
    have an empty table; other columns pass; a column named as `into` is replaced; repeated rows
    have equal tables.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PrefixCounter(load_sentencepiece(vocabulary))
        for texts in batches:
            made = [t for k in range(0, len(texts), TEXTS) for t in counter.tables([x or "" for x in texts.slice(k, TEXTS).to_pylist()])]
            yield pa.array(made, pa.binary())

    return replaced(df, **{into: _udf(run, "binary", F.col(text))})


def tokens_in(prefixes: Column) -> Column:
    """Tokens of the whole text, the last cell of its table; 0 for null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tables in batches:
            yield pa.array([int(np.frombuffer(x.as_py() or b"", np.int8).sum(dtype=np.int64)) for x in tables], pa.int64())

    return _udf(run, "long", prefixes)


def prefix_within(prefixes: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most `budget` tokens; 0 for null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tables in batches:
            yield pa.array([int(np.flatnonzero(counts(x.as_py()) <= budget)[-1]) for x in tables], pa.int64())

    return _udf(run, "long", prefixes)


def tokens_between(prefixes: Column, start: int, stop: int) -> Column:
    """Tokens that the code points start..stop add to the prefix before them; a text may end earlier."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tables in batches:
            cells = [counts(x.as_py()) for x in tables]
            yield pa.array([int(c[min(stop, len(c) - 1)] - c[min(start, len(c) - 1)]) for c in cells], pa.int64())

    return _udf(run, "long", prefixes)
